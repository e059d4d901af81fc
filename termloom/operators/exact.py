"""Exact occurrences of forms in texts, as an equi-join on an anchor word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def occurs() -> Column:
    """Whether the form of a joined row really stands at its anchor, and alone.

    A form's anchor is its longest run of word characters. Where a form stands alone, that run is a whole word of the
    text, so joining words with anchors finds every occurrence, nested and overlapping ones too, each once. Which
    characters belong to words is told by the function that cut them.
    """
    left, right = F.expr("substr(folded, 1, anchor_off)"), F.expr("substr(folded, anchor_off + 1)")
    start = F.char_length("before") - F.col("anchor_off")  # in `edges`
    outer = F.when(start > 0, F.substring("edges", start, F.lit(1))).otherwise(F.lit(""))
    tail = F.substring("edges", start + F.col("form_len") + 1, F.lit(1))
    around = F.col("before").endswith(left) & F.col("after").startswith(right) & (outer != "w") & (tail != "w")
    return F.col("plain") | ~F.col("word") | around


def exact_hits(words: DataFrame, forms: DataFrame) -> DataFrame:
    """words (key, chain, strip and the fields of TOKEN) with the forms (chain, pos, strip, ...) that stand there: a
    broadcast hash join, as forms are few. Adds start, end in the folded and ostart, oend in the original text."""
    hits = words.join(forms, (words["chain"] == forms["f_chain"]) & (words["strip"] == forms["f_strip"]) & (words["t"] == forms["anchor"]) & (words["word"] != forms["wordless"]))
    hits = hits.where(occurs())
    start = F.col("s") - F.col("anchor_off")
    end = start + F.col("form_len")
    # Positions in `origins` count from the start of `before`.
    base = F.char_length("before") - F.col("anchor_off")
    moved = F.col("origins").isNotNull()
    simple = F.col("plain") | ~F.col("word")
    ostart = F.when(simple, F.col("os")).when(moved, F.get("origins", base)).otherwise(start)
    oend = F.when(simple, F.col("oe")).when(moved, F.get("origins", base + F.col("form_len") - 1) + 1).otherwise(end)
    return hits.select("key", "pos", "form_id", start.alias("start"), end.alias("end"), ostart.alias("ostart"), oend.alias("oend"))
