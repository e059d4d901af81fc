"""The queries op1 ... op10 over whole tables, with the production parameters, and their SQL."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.llm.chat_format import format_chats, read_turn, unescape
from termloom.llm.common import table
from termloom.llm.decontamination import decontaminate
from termloom.llm.html_extract import extract
from termloom.llm.jaccard_join import jaccard_components
from termloom.llm.line_dedup import line_dedup
from termloom.llm.lm_scoring import lm_score
from termloom.llm.mixing import MOST, WEIGHTS, mix_sources
from termloom.llm.quality_rules import RULES, STOP_WORDS, quality_rules
from termloom.llm.substring_dedup import MIN_WORDS, UNIT_WORDS, substring_dedup
from termloom.llm.suffix_dedup import suffix_dedup


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = substring_dedup(table(spark, sf_dir, "documents"))
    spans = F.array_join(F.transform("sd.spans", lambda s: F.concat_ws(":", s["start"], s["end"], s["keeper"], s["keeper_unit"])), ",")
    return out.select("doc_id", "sd.n_units", "sd.n_removed", "sd.n_chars_removed", spans.alias("spans"), "sd.kept_sha256")


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = lm_score(table(spark, sf_dir, "documents"))
    names = ("held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score")
    return out.select("doc_id", *(F.col(f"lm_{c}").alias(c) for c in names))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = suffix_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), "kept_sha256")


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "dc.n_words", "dc.n_hit", F.size("dc.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("dc.items", ","), 256).alias("items_sha256"), "dc.contaminated",
    )


def _turns_read_back(formatted: pd.Series, spans: pd.Series, loss: pd.Series) -> pd.DataFrame:
    rows = []
    for f, turns, answers in zip(formatted, spans, loss, strict=True):
        read = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in (read_turn(f[s["start"] : s["end"]]) for s in turns)).encode())
        said = "".join(unescape(f[s["start"] : s["end"]]) for s in answers)
        rows.append((read.hexdigest(), len(said), hashlib.sha256(said.encode()).hexdigest(), len(f)))
    return pd.DataFrame(rows, columns=["turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    tricky = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(tricky).alias("text"),
    )
    out = format_chats(rows.unionByName(own))
    kind = "turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    read = F.pandas_udf(_turns_read_back, kind)("formatted", "spans", "loss")
    return out.withColumn("r", read).select("conv_id", "n_turns", "r.turns_sha256", "r.loss_chars", "r.loss_sha256", "r.formatted_chars")


def op8_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = extract(table(spark, sf_dir, "pages"))
    return out.select("page_id", "url", F.col("main_text").alias("text"), F.char_length("main_text").cast("long").alias("n_chars"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup(table(spark, sf_dir, "documents"))
    return out.select("doc_id", F.col("ld_n_lines").alias("n_lines"), F.col("ld_n_dropped").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = quality_rules(table(spark, sf_dir, "documents"))
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
    return out.select("doc_id", *(F.col(f"q_{c}").alias(c) for c in names))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = mix_sources(table(spark, sf_dir, "documents"))
    return out.select(
        "doc_id", F.col("mix_size").alias("size"), F.col("mix_source_size").alias("source_size"),
        F.col("mix_target").alias("target"), (F.col("mix_size") * F.col("mix_copies")).alias("taken"),
    )


QUERIES = {f.__name__: f for f in (op1_substring_dedup, op2_lm_scoring, op3_jaccard_join, op4_suffix_dedup, op5_decontamination, op6_chat_format, op7_line_dedup, op8_html_extract, op9_quality_rules, op10_mixing)}

_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_BLANKS = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_WORD = r"[^\x20\x09-\x0D]+"

_OP1 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, string_split(regexp_replace(coalesce(text, ''), '([.!?][\x20\x09\x0B-\x0D])', '\1' || chr(10), 'g'), chr(10)) AS units FROM documents),
u AS (SELECT doc_id, unnest(units) AS line, unnest(range(len(units))) AS unit FROM d),
k AS (SELECT doc_id, unit, line, trim(regexp_replace(translate(line, '{_UP}', '{_LOW}'), '[\x20\x09\x0B-\x0D]+', ' ', 'g'), {_BLANKS}) AS key,
        length(line) + (NOT regexp_matches(line, '[.!?][\x20\x09\x0B-\x0D]$'))::INT AS wide FROM u),
p AS (SELECT *, coalesce(sum(wide) OVER (PARTITION BY doc_id ORDER BY unit ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos0,
        len(string_split(key, ' ')) AS words FROM k),
f AS (SELECT *, first_value(doc_id) OVER w AS kd, first_value(unit) OVER w AS ku FROM p WHERE words >= {UNIT_WORDS}
      WINDOW w AS (PARTITION BY key ORDER BY doc_id, unit ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
g AS (SELECT *, kd <> doc_id OR ku <> unit AS again FROM f),
i AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY unit) - row_number() OVER (PARTITION BY doc_id, again ORDER BY unit) AS island FROM g),
r AS (SELECT doc_id, min(pos0) AS a, max(pos0 + length(line)) AS z, count(*) AS n, arg_min(kd, unit) AS kd, arg_min(ku, unit) AS ku
      FROM i WHERE again GROUP BY doc_id, island HAVING sum(words) >= {MIN_WORDS}),
s AS (SELECT *, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM r),
e AS (SELECT doc_id, sum(n)::BIGINT AS n_removed, sum(z - a)::BIGINT AS gone, max(z) AS last, string_agg(a || ':' || z || ':' || kd || ':' || ku, ',' ORDER BY a) AS spans FROM s GROUP BY doc_id),
t AS (SELECT doc_id, string_agg(substring(text, before + 1, a - before), '' ORDER BY a) AS kept FROM s JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, len(units)::BIGINT AS n_units, coalesce(n_removed, 0) AS n_removed, coalesce(gone, 0) AS n_chars_removed, coalesce(spans, '') AS spans,
  sha256(CASE WHEN kept IS NULL THEN text ELSE kept || substring(text, last + 1) END) AS kept_sha256
FROM d LEFT JOIN e USING (doc_id) LEFT JOIN t USING (doc_id)
"""

_OP7 = f"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
u AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS unit FROM d),
k AS (SELECT *, translate(trim(line, {_BLANKS}), '{_UP}', '{_LOW}') AS key FROM u),
c AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
g AS (SELECT k.*, coalesce(c.last <> k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (gone)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY unit) FILTER (NOT gone), '')) AS kept_sha256
FROM g GROUP BY doc_id
"""

_OP9_MEASURES = {
    "n_words": "n_words", "mean_word_chars": "word_chars::DOUBLE / greatest(n_words, 1)", "symbol_ratio": "n_symbols::DOUBLE / greatest(n_words, 1)",
    "stop_ratio": "(n_stop + 1)::DOUBLE / greatest(n_words, 1)", "dup_line_ratio": "n_dup_lines::DOUBLE / greatest(n_lines, 1)",
    "repeat_ratio": "n_repeat_words::DOUBLE / greatest(n_words, 1)",
}


def op9_sql(documents: str = "documents") -> str:
    """The rows of op9 over `documents`, and the rules' verdict from the same table of thresholds."""
    kept = " AND ".join(f"{_OP9_MEASURES[m]} {op} {v}" for m, op, v in RULES)
    stops = ", ".join(f"'{w}'" for w in STOP_WORDS)
    return rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w,
             list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM {documents}),
g AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' '))) AS s, unnest(range(1, len(w) - 3)) AS i FROM d WHERE len(w) >= 5),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, s) > 1),
c AS (SELECT doc_id, sum(least(5, nxt - i)) AS n FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 5) AS nxt FROM r) GROUP BY doc_id),
m AS (SELECT d.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
        coalesce(n, 0)::BIGINT AS n_repeat_words, len(l) AS n_lines, len(list_filter(w, lambda x: lower(x) IN ({stops}))) AS n_stop
      FROM d LEFT JOIN c ON d.doc_id = c.doc_id),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {kept} AS kept FROM b
"""


_OP10 = f"""
WITH d AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '{_WORD}'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ([{', '.join(map(str, WEIGHTS))}])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % {len(WEIGHTS)} + 1]::BIGINT AS weight FROM s),
l AS (SELECT *, {MOST} * source_size::DOUBLE / weight AS lim FROM w),
o AS (SELECT *, row_number() OVER v AS place, sum(weight) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS open,
        {MOST} * coalesce(sum(source_size) OVER (ORDER BY lim, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS filled,
        sum(source_size) OVER () AS total FROM l WINDOW v AS (ORDER BY lim, source NULLS LAST)),
e AS (SELECT *, (total - filled)::DOUBLE / open::DOUBLE AS level FROM o),
f AS (SELECT min_by(level, place) AS level FROM e WHERE level <= lim),
t AS (SELECT source, source_size, coalesce(least({MOST} * source_size::DOUBLE, f.level * weight), 0.0) AS target FROM e, f),
r AS (SELECT *, CASE WHEN source_size > 0 THEN least(target / source_size, {MOST}.0) ELSE 0.0 END AS rate FROM t)
SELECT doc_id, size, source_size, target, (size * (floor(rate)::BIGINT +
  (('0x' || md5('17|' || coalesce(doc_id::VARCHAR, md5(coalesce(text, ''))))[1:13])::BIGINT::DOUBLE / {1 << 52} < rate - floor(rate))::BIGINT))::BIGINT AS taken
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source
"""

SQL = {"op1_substring_dedup": _OP1, "op7_line_dedup": _OP7, "op9_quality_rules": op9_sql(), "op10_mixing": _OP10}
