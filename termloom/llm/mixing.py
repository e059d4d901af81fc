"""Mixing sources to target weights, in DataFrame functions throughout."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from termloom.llm.common import WORD, free_name, small_or_not

#: Weights of the sources in the order of their names' code points (null last), repeating.
WEIGHTS = (1, 2, 3)
#: No document is taken more often than this.
MOST = 3


def source_targets(sizes: DataFrame, source: str, size: str, weights=WEIGHTS, most: int = MOST) -> DataFrame:
    """One row per source: its size, its target and the rate target / size.

    The targets share the total size by weight. A target stops at `most` times its source's size and the excess is
    shared anew among the rest, by weight: the level L solves sum(min(most * size, L * weight)) = total. With the
    sources in the order of most * size / weight, L is found where (what is left) / (the weights left) first stays
    under the next source's own limit. The windows run over one row per source, after aggregation.
    """
    by_source = sizes.groupBy(F.col(source).alias("source")).agg(F.sum(size).alias("source_size"))
    n = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.lit(list(weights)), (F.pmod(n - 1, F.lit(len(weights))) + 1).cast("int"))
    rows = by_source.select("source", "source_size", weight.cast("long").alias("weight"))
    order = Window.orderBy("limit", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing).orderBy(F.lit(1))
    rows = (
        rows.withColumn("limit", most * F.col("source_size").cast("double") / F.col("weight"))
        .withColumn("total", F.sum("source_size").over(everything))
        .withColumn("full", most * F.coalesce(F.sum("source_size").over(before), F.lit(0)))
        .withColumn("open", F.sum("weight").over(after))
        .withColumn("level", (F.col("total") - F.col("full")).cast("double") / F.col("open"))
        .withColumn("place", F.row_number().over(order))
    )
    fits = F.when(F.col("level") <= F.col("limit"), F.col("place"))
    rows = rows.withColumn("at", F.min(fits).over(everything))
    rows = rows.withColumn("level", F.max(F.when(F.col("place") == F.col("at"), F.col("level"))).over(everything))
    target = F.least(most * F.col("source_size").cast("double"), F.col("level") * F.col("weight"))
    rows = rows.select("source", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))
    rate = F.when(F.col("source_size") > 0, F.least(F.col("target") / F.col("source_size"), F.lit(float(most))))
    return rows.withColumn("rate", F.coalesce(rate, F.lit(0.0)))


def draw(doc_id: str, text: str, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed and the document's id only (its text where the id is null)."""
    who = F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(F.col(text), F.lit(""))))
    digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|"), who)), 1, 13)
    return F.conv(digits, 16, 10).cast("long").cast("double") / float(1 << 52)


def mix_sources(
    docs: DataFrame, doc_id="doc_id", text="text", source="source", weights=WEIGHTS, most: int = MOST, seed: int = 17
) -> DataFrame:
    """`docs` with mix_size, mix_source_size, mix_target, mix_copies (underscores are put before a name that is taken).

    Each document is taken floor(rate) times, plus once more with a probability equal to the rest of the rate, by a
    draw seeded with its id; reruns and other partitionings agree. Null text has size 0; null source is a source of
    its own, last in order; a source without words has rate 0; rows that repeat an id share its draw, and ties of
    limits go by the source's name; no rows give no rows; texts of any length are only counted. Other columns pass
    through. Targets take one task, which holds one row per source: up to some million sources, not one per document.
    """
    size, key = free_name(docs, "mix_size"), free_name(docs, "mix_key")
    n = F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long")
    targets = source_targets(docs.select(F.col(source), n.alias(size)), source, size, weights, most)
    names = {c: free_name(docs, f"mix_{c}") for c in ("source_size", "target", "rate", "copies")}
    targets = small_or_not(targets.select(F.col("source").alias(key), *(F.col(c).alias(names[c]) for c in ("source_size", "target", "rate"))), 1)
    out = docs.withColumn(size, n).join(targets, F.col(source).eqNullSafe(F.col(key)), "left").drop(key)
    rate = F.col(names["rate"])
    extra = (draw(doc_id, text, seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(names["copies"], F.floor(rate) + extra).drop(names["rate"])


def emit_copies(mixed: DataFrame, copies: str = "mix_copies") -> DataFrame:
    """Each row as often as `copies` says."""
    n = free_name(mixed, "mix_n")
    return mixed.where(F.col(copies) > 0).withColumn(n, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).drop(n)
