"""Substring dedup by hashing units of text: the earliest occurrence of a passage stays, the others go."""

from __future__ import annotations

import hashlib
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BLANKS, ascii_lower, free_name, slices, small_batches, small_or_not

#: A unit ends at a line's end, and where a line goes on after one of these and a blank.
BREAK = r"([.!?][\x20\x09\x0B-\x0D])"
#: Words that a unit must have to be looked at, and that a stretch of repeated units must have to go.
UNIT_WORDS, MIN_WORDS = 3, 25


def unit_keys(text: Column) -> Column:
    """For each unit (a sentence of a line) its key: A-Z lower-cased, each run of blanks one space, none at the ends."""
    squeezed = F.regexp_replace(ascii_lower(text), r"[\x20\x09\x0B-\x0D]+", " ")
    return F.transform(F.split(F.regexp_replace(squeezed, r"([.!?] )", "$1\n"), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))


SPAN = "start:long,end:long,units:int,keeper:long,keeper_unit:int"
REMOVED = f"n_units long, n_removed long, spans array<struct<{SPAN}>>, n_chars_removed long, kept string, kept_sha256 string"
_BREAK, _WORD = re.compile(BREAK), re.compile(r"[^\x20\x09-\x0D]+")


def cut(text: str, repeated: dict[int, tuple], min_words: int) -> tuple[int, int, list[tuple]]:
    """The number of units, of those in what goes, and the stretches that go; `repeated` has the keeper by unit."""
    units = _BREAK.sub("\\1\n", text).split("\n")
    if not repeated:
        return len(units), 0, []
    spans, removed, run, n_words, at = [], 0, [], 0, 0

    def close():
        nonlocal removed
        if n_words >= min_words:
            removed += len(run)
            spans.append((run[0][0], run[-1][1], len(run), *run[0][2]))

    for i, unit in enumerate(units):
        words = len(_WORD.findall(unit))
        if words >= UNIT_WORDS:
            if (keeper := repeated.get(i)) is None:
                close()
                run, n_words = [], 0
            else:
                run.append((at, at + len(unit), keeper))
                n_words += words
        at += len(unit) + (_BREAK.fullmatch(unit[-2:]) is None)  # after a break of our own no newline follows
    close()
    return len(units), removed, spans


def _cut(min_words: int):
    def over(text: pd.Series, repeated: pd.Series) -> pd.DataFrame:
        rows = []
        for t, r in zip(text, repeated, strict=True):
            n, removed, spans = cut(t, {} if r is None else {x["unit"]: (x["keeper"], x["keeper_unit"]) for x in r}, min_words)
            edges = [0, *(x for s in spans for x in s[:2]), len(t)]
            kept = "".join(t[a:z] for a, z in zip(edges[::2], edges[1::2], strict=True))
            rows.append((n, removed, spans, len(t) - len(kept), kept, hashlib.sha256(kept.encode()).hexdigest()))
        return pd.DataFrame(rows, columns=["n_units", "n_removed", "spans", "n_chars_removed", "kept", "kept_sha256"])

    return over


def substring_dedup(docs: DataFrame, doc_id="doc_id", text="text", min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with a struct `sd`: n_units, n_removed (units), spans (start and end in code points of the original text,
    units, and the id and unit of the first one's keeper), n_chars_removed, kept (the text without the spans) and
    kept_sha256.

    Units are lines, cut further after each sentence, so that a passage is found inside longer lines too; keys drop case
    and spacing. A unit of fewer than three words is passed over. Of all occurrences of a key, anywhere, the one with the
    smallest (id, unit) stays; the others are repeated. A stretch of repeated units with nothing but units that are
    passed over between them goes if it has `min_words` words, so that a passage goes and a phrase or a licence line
    that happens to recur stays. Digests (MD5) meet in one aggregation with partial sums; only keys that occur twice go
    on, broadcast if they are few, else to a join that is free to be split where a key is hot.

    Null or empty text is one empty unit. Ties cannot be: (id, unit) is a total order; rows that repeat an id are one
    document, and all of them lose the same. Rows without an id keep everything and displace nothing. No rows give no
    rows. A text of any length is one row of one task, which holds it and its units; nothing is cut short. Other columns
    are passed through; where one is called `sd`, the struct is `_sd`.
    """
    who, out, gone = (free_name(small_batches(docs), x) for x in ("sd_id", "sd", "sd_gone"))
    whole = F.coalesce(F.col(text), F.lit(""))
    held = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias(who), F.posexplode(unit_keys(whole)).alias("unit", "key"))
    held = held.where(F.col("key").like("% " * (UNIT_WORDS - 1) + "%")).select(who, "unit", F.unhex(F.md5("key")).alias("h"))
    first = held.groupBy("h").agg(F.min(F.struct(F.col(who).alias("id"), "unit")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1")
    lost = (
        held.join(small_or_not(first.drop("n"), slices(docs)), "h")
        .where((F.col(who) != F.col("first.id")) | (F.col("unit") != F.col("first.unit")))
        .groupBy(who)
        .agg(F.collect_list(F.struct("unit", F.col("first.id").alias("keeper"), F.col("first.unit").alias("keeper_unit"))).alias(gone))
    )
    df = docs.join(lost, F.col(doc_id) == F.col(who), "left")
    return df.withColumn(out, F.pandas_udf(_cut(min_words), REMOVED)(whole, F.col(gone))).drop(who, gone)
