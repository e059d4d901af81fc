"""Chat formatting around a template that is only ever called, never looked into."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from os.path import commonprefix

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Strings that mark turns in common templates (fixed values); inside a text they are broken up.
CONTROL = ("<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
_CONTROL = re.compile("|".join(map(re.escape, (*CONTROL, "\\"))))
_ESCAPED = re.compile(r"\\(\\?)")


def escape(text: str) -> str:
    """Backslashes are doubled; a control string gets a backslash after its first character."""
    return _CONTROL.sub(lambda m: "\\\\" if m[0] == "\\" else f"{m[0][0]}\\{m[0][1:]}", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


Template = Callable[[list[dict], bool], str]


def chat_template(turns: list[dict], ask: bool = False) -> str:
    """Turns as `<|im_start|>role\\ntext<|im_end|>\\n`; with `ask`, the opening of an answer at the end."""
    role = lambda r: escape(r).replace("\n", "\\n")  # noqa: E731  after escape() no single backslash stands before an n
    out = "".join(f"<|im_start|>{role(t['role'])}\n{escape(t['text'])}<|im_end|>\n" for t in turns)
    return out + "<|im_start|>assistant\n" * ask


def read_turn(formatted: str) -> tuple[str, str]:
    """Role and text of one turn as chat_template() writes it."""
    head, _, rest = formatted.removeprefix("<|im_start|>").partition("\n")
    role = re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], head)
    return role, unescape(rest.removesuffix("<|im_end|>\n"))


def render(turns: list[dict], template: Template = chat_template) -> dict:
    """The formatted conversation, each turn's span in it, the spans under the loss mask, and whether the template
    rewrites history.

    Each prefix of the turns is rendered and compared with the one before: where it only adds, what it adds is the
    turn's span. Where it changes what was there, `rewrites` is true and the spans count from the last character that
    both share. An answer's text begins where the rendering with the opening of an answer ends, and ends where the
    same turn rendered without text goes on; a template that rewrites what the opening follows is compared with the
    turn without text alone, and if that changes elsewhere too, the whole turn counts as the answer.
    """
    before, spans, loss, rewrites = template([], False), [], [], False
    for k in range(len(turns)):
        now = template(turns[: k + 1], False)
        at = len(before)
        if not now.startswith(before):
            rewrites = True
            at = len(commonprefix((before, now)))
            spans = [(a, min(b, at)) for a, b in spans if a < at]
            loss = [(a, min(b, at)) for a, b in loss if a < at]
        spans.append((at, len(now)))
        if turns[k]["role"] == "assistant":
            opened = template(turns[:k], True)
            empty = template([*turns[:k], {**turns[k], "text": ""}], False)
            n = len(now) - len(empty)
            begin = len(opened) if now.startswith(opened) and empty.startswith(opened) else len(commonprefix((now, empty)))
            whole = n >= 0 and now[:begin] + now[begin + n :] == empty
            loss.append((begin, begin + n) if whole else (at, len(now)))
        before = now
    return {"formatted": before, "spans": spans, "loss": loss, "rewrites": rewrites}


OUT = "conv_id long, n_turns long, formatted string, spans array<struct<start:long,end:long>>, loss array<struct<start:long,end:long>>, rewrites boolean"


def _formatter(template: Template):
    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for conv, turns in zip(f["conv_id"], f["turns"], strict=True):
                r = render([{"role": t["role"], "text": t["text"]} for t in turns], template)
                rows.append((None if conv is None else int(conv), len(turns), r["formatted"], r["spans"], r["loss"], r["rewrites"]))
            out = pd.DataFrame(rows, columns=["conv_id", "n_turns", "formatted", "spans", "loss", "rewrites"])
            yield out.astype({"conv_id": "Int64"})

    return over


def format_chats(rows: DataFrame, template: Template = chat_template, conv_id="conv_id", turn="turn", role="role", text="text") -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, spans (code points, one per turn), loss (spans of the
    assistant's texts) and rewrites.

    Rows go in the order of turn, then role and text where turns tie or are null (nulls first). A null role or text is
    empty; rows that repeat are turns of their own; rows without a conv_id are one conversation without id; no rows
    give no rows. A conversation is what a template takes, so its rows, however long their texts, meet in one task; other
    columns, whatever their names, aren't read.
    """
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = rows.groupBy(F.col(conv_id).cast("long").alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    # As text, since pandas would turn ids into floats beside a null.
    return turns.withColumn("conv_id", F.col("conv_id").cast("string")).mapInPandas(_formatter(template), OUT)
