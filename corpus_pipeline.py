"""A training corpus from raw documents, in five stages. Each stage takes what the one before kept.

What holds for every stage: a null text counts as empty; rows without an id are judged by their own text, displace nothing
and, where a verdict hangs on ids, stay; rows that repeat an id share its fate; ties can't be, as ids decide them; no rows
give no rows; texts of any length are taken whole, one row at a time; other columns pass through, whatever their names.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.common import shared_folder, slices, small_or_not, table
from termloom.llm.decontamination import decontaminate
from termloom.llm.jaccard_join import jaccard_components
from termloom.llm.line_dedup import line_dedup
from termloom.llm.mixing import emit_copies, mix_sources
from termloom.llm.quality_rules import quality_rules


def _recounted(docs: DataFrame, text: Column) -> DataFrame:
    """`docs` with another text, and with the length that it has."""
    return docs.withColumn("text", text).withColumn("n_chars", F.char_length("text").cast("long"))


def _added(out: DataFrame, docs: DataFrame, name: str) -> str:
    """What an operator has called the column `name` that it added, as it puts underscores before a name that is taken."""
    return next(c for c in out.columns if c not in docs.columns and c.lstrip("_") == name)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    out = quality_rules(docs)
    return out.where(F.col(_added(out, docs, "q_kept"))).select(docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many of them share."""
    out = line_dedup(docs)
    return _recounted(out, F.col("text")).select(docs.columns).coalesce(slices(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest id of each group of near duplicates, and what has no id."""
    others = jaccard_components(docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(small_or_not(others, slices(docs), 500_000), "doc_id", "left_anti").select(docs.columns).coalesce(slices(docs))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't contaminated; passages of the benchmark in the others are cut out."""
    out = decontaminate(docs, table(spark, sf_dir, "benchmark"))
    dc = _added(out, docs, "dc")
    out = out.where(f"not {dc}.contaminated")
    rest = F.lit(1 << 30)
    cut = F.aggregate(
        f"{dc}.spans",
        F.struct(F.lit("").alias("kept"), F.lit(0).alias("at")),
        lambda a, s: F.struct(
            F.concat(a["kept"], F.substring("text", a["at"] + 1, s["start"].cast("int") - a["at"])).alias("kept"),
            s["end"].cast("int").alias("at"),
        ),
        lambda a: F.concat(a["kept"], F.substring("text", a["at"] + 1, rest)),
    )
    return _recounted(out, F.when(F.size(f"{dc}.spans") > 0, cut).otherwise(F.col("text"))).select(docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's target asks for."""
    out = mix_sources(docs)
    return emit_copies(out, _added(out, docs, "mix_copies")).select(docs.columns)


STAGES = [
    ("quality rules", quality),
    ("line dedup", lines),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_free),
    ("mixing sources to target weights", mixture),
]

#: Components of a similarity graph and cuts inside texts are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table; each one's result is a table in the shared folder, which the next one reads."""
    docs, folder = table(spark, sf_dir, "documents"), f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
