"""Connected components of a table of links."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import snug


def _forest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Of a partition's links as many as its nodes: each node and the least one that it is linked with in the partition."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.setdefault(x, x)) != x:
            root[x] = x = root[y]
        return x

    for f in frames:
        for a, b in zip(f["a"].tolist(), f["b"].tolist(), strict=True):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    yield pd.DataFrame([(x, find(x)) for x in list(root)], columns=["a", "b"], dtype="int64")


def components(links: DataFrame, rows: int = 1 << 14) -> DataFrame:
    """(node, root) for each node of `links` (columns a, b), root being the smallest node that it is linked with.

    Each partition of some `rows` links first leaves a forest of its own; links that one partition holds are done then.
    Else the large-star and small-star steps of Kiveris et al. (2014) alternate until nothing changes: each round is a
    few aggregations with partial results and joins that can be split where a node has many links, and is cut off in the
    shared checkpoint folder. Links stay in the table throughout. A node linked with itself alone is its own root; no
    links give no rows.
    """
    known = snug(links.where("a is not null and b is not null").select(F.col("a").cast("long"), F.col("b").cast("long")), None, rows)
    forest = known.mapInPandas(_forest, "a long, b long")
    if known.rdd.getNumPartitions() == 1:
        return forest.select(F.col("a").alias("node"), F.col("b").alias("root"))
    edges, mark = snug(forest.select(F.col("a").alias("u"), F.col("b").alias("v")).distinct(), None, rows), None
    while True:
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == tuple(now):
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        mark = tuple(now)
        # Each node keeps its link to itself, so that it is never lost.
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(both.groupBy("u").agg(F.min("v").alias("m")), "u").where("v >= u").select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = snug(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct(), None, rows)
