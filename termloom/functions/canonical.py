"""Reports as canonical JSON: sorted keys, no spaces, ASCII, nulls and the spelling of numbers kept."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MATCH = (
    "struct<canonical_id:string,entry_id:string,surface_form:string,span_start:int,span_end:int,score_tier:string,"
    "matched_locale:string,correction:string,metadata:string>"
)
ERROR = "struct<message:string,canonical_id:string,locale:string,field:string>"
REPORT = f"struct<prompt:string,locale:string,matches:array<{MATCH}>,error:{ERROR}>"
_PLAIN = ("canonical_id", "entry_id", "surface_form", "score_tier", "matched_locale", "correction")


def canonical(value) -> str:
    return json.dumps(value, sort_keys=True, separators=(",", ":"))


def serialize(report: dict) -> str:
    matches = [
        {**{k: m[k] for k in _PLAIN}, "span": [int(m["span_start"]), int(m["span_end"])], "metadata": json.loads(m["metadata"])}
        for m in report["matches"]
    ]
    return canonical({"prompt": report["prompt"], "locale": report["locale"], "matches": matches})


def deserialize(text: str) -> dict:
    doc = json.loads(text)
    matches = [
        {**{k: m[k] for k in _PLAIN}, "span_start": m["span"][0], "span_end": m["span"][1], "metadata": canonical(m["metadata"])}
        for m in doc["matches"]
    ]
    return {"prompt": doc["prompt"], "locale": doc["locale"], "matches": matches, "error": None}


def report_json(report: Column) -> Column:
    """serialize() as a column; null for rows without a report and for rejected prompts."""

    def over(frame: pd.DataFrame) -> pd.Series:
        return pd.Series([
            None if r["matches"] is None or r["prompt"] is None else serialize(r) for r in frame.to_dict("records")
        ])

    return F.pandas_udf(over, "string")(report)


def report_from_json(text: Column) -> Column:
    """deserialize() as a column."""

    def over(texts: pd.Series) -> pd.DataFrame:
        rows = [deserialize(t) if t is not None else dict.fromkeys(("prompt", "locale", "matches", "error")) for t in texts]
        return pd.DataFrame(rows, columns=["prompt", "locale", "matches", "error"])

    return F.pandas_udf(over, REPORT.removeprefix("struct<").removesuffix(">"))(text)
