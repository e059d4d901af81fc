"""The queries of the resolver over the driver's tables, by name, and SQL that gives the same rows."""

from __future__ import annotations

import json
import uuid
from functools import cache
from string import Template

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from termloom.functions.canonical import report_json
from termloom.functions.folding import folded, words_of
from termloom.functions.similarity import distances
from termloom.operators.chain import chain_key
from termloom.operators.folders import shared_folder
from termloom.operators.guards import is_blank, is_oversize
from termloom.plans.lexicons import EVENTS, ODD, ODD_PROMPTS, SHOP, TALK
from termloom.plans.resolver import EntityResolver
from termloom.sources.lexicon import Lexicon
from termloom.streaming.resolve import entity_windows, resolve_stream

TYPO = "dg", "gd"  # what typed part names have instead of what


LEXICONS = {"shop": SHOP, "talk": TALK, "events": EVENTS, "odd": ODD}


@cache
def resolver(name: str, fuzzy: bool = True, chain: tuple | None = None) -> EntityResolver:
    return EntityResolver(Lexicon.from_dict(LEXICONS[name]), fuzzy=fuzzy, fallback_chain=chain)


def _table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _parts(spark, sf_dir, typed: bool = False, locale=None):
    name = F.replace(F.replace("p_name", F.lit(TYPO[0]), F.lit(TYPO[1])), F.lit("nv"), F.lit("vn")) if typed else F.col("p_name")
    return _table(spark, sf_dir, "part").select("p_partkey", name.alias("prompt"), (F.lit("en") if locale is None else locale).alias("locale"))


def _docs(spark, sf_dir):
    return _table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("prompt"), F.col("lang").alias("locale"), "source")


_FIELDS = ("canonical_id", "entry_id", "surface_form", "span_start", "span_end", "score_tier", "matched_locale", "correction", "metadata")


def fold_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = folded(F.col("text"), F.lit(True))
    return _table(spark, sf_dir, "documents").withColumn("f", t).select("doc_id", F.md5("f").alias("folded_md5"), F.char_length("f").cast("long").alias("folded_chars"))


def token_frequency(spark, sf_dir):
    out = words_of(_table(spark, sf_dir, "documents"), F.col("text"), True)
    return out.groupBy("token").agg(F.count(F.lit(1)).alias("n"))


def guards(spark, sf_dir):
    d = _table(spark, sf_dir, "documents")
    return d.groupBy("lang").agg(
        F.count_if(is_oversize(F.col("text"))).alias("n_oversize"), F.count_if(is_blank(F.col("text"))).alias("n_blank"), F.count(F.lit(1)).alias("n"),
    )


def rejected_documents(spark, sf_dir):
    out = resolver("talk", False).transform(_docs(spark, sf_dir))
    return out.where("report.error is not null").select("doc_id", F.col("report.error.field").alias("field"), F.size("report.matches").cast("long").alias("n_matches"))


def forms_catalog(spark, sf_dir):
    return resolver("shop").forms_table(spark).where("f_chain = 'de-at'").select("pos", "locale", "entry_id", "folded", "tier", "form_len", "budget")


def exact_hits_parts(spark, sf_dir):
    r = resolver("shop", False)
    texts = _parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), "prompt", F.lit("en").alias("chain"))
    forms = r.forms_table(spark).select("form_id", "folded", "tier").distinct()
    return r.hits(texts).join(r.small(forms), "form_id").select(F.col("key").alias("p_partkey"), "folded", "tier", "start", "end")


def whole_words_only(spark, sf_dir):
    """Names joined by a hyphen, at which words end, or by an underscore, which is part of a word."""
    joined = F.replace("prompt", F.lit(" "), F.when(F.col("p_partkey") % 2 == 0, "-").otherwise("_"))
    return resolver("shop", False).matches(_parts(spark, sf_dir).withColumn("prompt", joined)).select("p_partkey", *_FIELDS)


def odd_forms_parts(spark, sf_dir):
    """Punctuated and Arabic forms, accents apart from their letters, chains of overlaps; the lexicon is ODD."""
    said = F.element_at(F.array(*map(F.lit, ODD_PROMPTS)), (F.pmod("p_partkey", F.lit(len(ODD_PROMPTS))) + 1).cast("int"))
    tag = F.when(F.pmod("p_partkey", F.lit(2)) == 0, "ar-EG").otherwise("en")
    prompts = _table(spark, sf_dir, "part").select("p_partkey", F.concat(said, F.lit(" "), "p_name").alias("prompt"), tag.alias("locale"))
    return resolver("odd", False).matches(prompts).select("p_partkey", "entry_id", "span_start", "span_end", "matched_locale")


def exact_parts(spark, sf_dir):
    return resolver("shop", False).matches(_parts(spark, sf_dir)).select("p_partkey", "match_no", *_FIELDS)


def flagship_resolve_parts(spark, sf_dir):
    return resolver("shop").matches(_parts(spark, sf_dir)).select("p_partkey", "match_no", *_FIELDS)


def fuzzy_resolve_parts(spark, sf_dir):
    return resolver("shop").matches(_parts(spark, sf_dir, typed=True)).select("p_partkey", "match_no", *_FIELDS)


def exact_only_typed_parts(spark, sf_dir):
    return resolver("shop", False).matches(_parts(spark, sf_dir, typed=True)).select("p_partkey", "match_no", *_FIELDS)


def string_distances(spark, sf_dir):
    words = _parts(spark, sf_dir, typed=True).select(F.explode(F.split("prompt", " ")).alias("token")).distinct()
    forms = sorted({f["folded"] for f in resolver("shop").forms if f["locale"] == "en"})
    out = words.withColumn("folded", F.explode(F.array(*map(F.lit, forms)))).withColumn("d", distances(F.col("token"), F.col("folded")))
    return out.select("token", "folded", F.col("d.dist").alias("dist"), F.round("d.sim", 9).alias("sim"))


def fuzzy_swapped(spark, sf_dir):
    words = F.split("prompt", " ")
    swapped = _parts(spark, sf_dir, typed=True).withColumn("prompt", F.concat_ws(" ", F.get(words, F.lit(1)), F.get(words, F.lit(0))))
    return resolver("shop").matches(swapped).where("surface_form like '% %'").select("p_partkey", *_FIELDS)


REQUESTED = ("en", "en-GB", "de-AT", "de-LU", "fr-FR", "DE-de", "it")


def locale_chain(spark, sf_dir):
    r = resolver("shop")
    rows = [(k, i, tag) for k, chain in r.chains.items() for i, tag in enumerate(chain)]
    chains = spark.createDataFrame(rows, "key string, pos int, locale string")
    asked = spark.createDataFrame([(x,) for x in REQUESTED], "requested string")
    return asked.join(r.small(chains), chain_key(F.col("requested"), r.chains) == F.col("key")).select("requested", "pos", "locale")


def _requested():
    return F.element_at(F.array(*map(F.lit, REQUESTED)), (F.pmod("p_partkey", F.lit(len(REQUESTED))) + 1).cast("int"))


def fallback_first_match(spark, sf_dir):
    out = resolver("shop", False).transform(_parts(spark, sf_dir, locale=_requested()))
    return out.select("p_partkey", F.col("report.locale").alias("answered"), F.size("report.matches").cast("long").alias("n_matches"))


def explicit_chain(spark, sf_dir):
    out = resolver("shop", False, ("de-AT", "fr-FR")).transform(_parts(spark, sf_dir))
    return out.select("p_partkey", F.col("report.locale").alias("answered"), F.size("report.matches").cast("long").alias("n_matches"))


def span_backtranslation(spark, sf_dir):
    accented = F.concat(F.lit("½ É "), F.upper("prompt"))
    out = resolver("shop", False).matches(_parts(spark, sf_dir).withColumn("prompt", accented))
    return out.select("p_partkey", "match_no", "span_start", "span_end", F.expr("substr(prompt, span_start + 1, span_end - span_start)").alias("slice"))


def shared_entities(spark, sf_dir):
    m = resolver("shop").matches(_parts(spark, sf_dir))
    return m.groupBy("canonical_id", "entry_id", "metadata").agg(F.count(F.lit(1)).alias("n"))


def report_json_parts(spark, sf_dir):
    out = resolver("shop", False).transform(_parts(spark, sf_dir))
    return out.select("p_partkey", report_json(F.col("report")).alias("json"))


def residue_words(spark, sf_dir):
    r = resolver("shop", False)
    texts = _parts(spark, sf_dir).select(F.col("p_partkey").alias("key"), "prompt", F.lit("en").alias("chain"))
    words, hits = r.words(texts), r.hits(texts).select(F.col("key").alias("k"), "start", "end")
    left = words.join(hits, (F.col("key") == F.col("k")) & (F.col("s") < F.col("end")) & (F.col("start") < F.col("e")), "left_anti")
    return left.groupBy(F.col("t").alias("token")).agg(F.count(F.lit(1)).alias("n"))


def resolve_documents(spark, sf_dir):
    m = resolver("talk").matches(_docs(spark, sf_dir))
    return m.groupBy("doc_id", "matched_locale", "canonical_id", "entry_id", "surface_form", "score_tier").agg(F.count(F.lit(1)).alias("n"), F.count("correction").alias("n_corrected"))


def matches_by_language(spark, sf_dir):
    m = resolver("talk", False).matches(_docs(spark, sf_dir))
    return m.rollup("matched_locale", "canonical_id").agg(F.count(F.lit(1)).alias("n"))


def coverage_by_label(spark, sf_dir):
    r = resolver("talk", False).transform(_docs(spark, sf_dir)).select("doc_id", F.coalesce(F.size("report.matches"), F.lit(0)).alias("n"))
    return r.join(_table(spark, sf_dir, "labels"), "doc_id").groupBy("quality", "toxic").agg(F.count(F.lit(1)).alias("docs"), F.sum("n").alias("matches"))


def resolve_conversations(spark, sf_dir):
    rows = _table(spark, sf_dir, "conversations").select("conv_id", "turn", F.col("text").alias("prompt"), F.lit("en").alias("locale"))
    m = resolver("talk").matches(rows)
    return m.groupBy("conv_id", "turn", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.count("correction").alias("n_corrected"))


def entity_windows_events(spark, sf_dir):
    rows = _table(spark, sf_dir, "events").select(F.col("ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("prompt"), F.lit("en").alias("locale"))
    return entity_windows(resolver("events").matches(rows), "ts", "1 day")


def streaming_resolve(spark, sf_dir):
    """The stream reads the same table file by file; what it wrote is read again."""
    path = f"{sf_dir}/conversations.parquet"
    schema = spark.read.parquet(path).schema
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    stream = spark.readStream.schema(schema).parquet(path + "*")
    prompts = stream.select("conv_id", "turn", F.col("text").alias("prompt"), F.lit("en").alias("locale"))
    resolve_stream(resolver("talk"), prompts, f"{out}/matches", f"{out}/state").awaitTermination()
    m = spark.read.parquet(f"{out}/matches")
    return m.groupBy("conv_id", "turn", "entry_id").agg(F.count(F.lit(1)).alias("n"), F.count("correction").alias("n_corrected"))


QUERIES = {
    f.__name__: f
    for f in (
        flagship_resolve_parts, fold_text, token_frequency, guards, rejected_documents, forms_catalog, exact_hits_parts, whole_words_only, odd_forms_parts, exact_parts,
        fuzzy_resolve_parts, exact_only_typed_parts, string_distances, fuzzy_swapped, locale_chain, fallback_first_match, explicit_chain,
        span_backtranslation, shared_entities, report_json_parts, residue_words, resolve_documents, matches_by_language, coverage_by_label,
        resolve_conversations, entity_windows_events, streaming_resolve,
    )
}

# ---------------------------------------------------------------- SQL


_FOLD = "replace(strip_accents(lower({})), 'ß', 'ss')"


def _values(name: str, chains=None) -> str:
    """CTEs that read a lexicon's document with DuckDB's own functions: `chain` (f_chain, pos, locale) has the chains by
    their keys, and `f` the forms, one row per chain that leads to them."""
    where = "" if chains is None else f"WHERE f_chain IN ({', '.join(repr(c) for c in chains)})"
    fold = "CASE WHEN lower(locale) LIKE 'ar%' THEN lower(form) ELSE " + _FOLD.format("form") + " END"
    quoted = json.dumps(LEXICONS[name], ensure_ascii=False).replace("'", "''")
    return rf"""doc AS (SELECT '{quoted}'::JSON AS j),
ent AS (SELECT e.key AS entry_id, e.value AS v FROM doc, json_each(j, '$.entities') e),
loc AS (SELECT entry_id, coalesce(v->>'canonicalId', entry_id) AS canonical_id, coalesce(v->'metadata', '{{}}'::JSON) AS held, l.key AS locale, l.value AS w FROM ent, json_each(v, '$.locales') l),
every AS (SELECT *, w->>'$.preferred.singular' AS form, 0 AS tier_rank, 0 AS nth FROM loc UNION ALL SELECT *, w->>'$.preferred.plural', 0, 1 FROM loc UNION ALL
  SELECT loc.*, a.value->>'$', 1, 2 + a.id::INT FROM loc, json_each(w, '$.alternates') a UNION ALL SELECT *, entry_id, 2, 1000000 FROM loc),
once AS (SELECT *, {fold} AS folded FROM every WHERE form IS NOT NULL QUALIFY row_number() OVER (PARTITION BY locale, entry_id, folded ORDER BY nth) = 1),
tags AS (SELECT DISTINCT locale, lower(locale) AS l, split_part(lower(locale), '-', 1) AS lang FROM loc),
ckey AS (SELECT l AS k FROM tags UNION SELECT lang FROM tags UNION SELECT ''),
cand AS (SELECT k, locale, l, CASE WHEN l = k THEN 0 WHEN lang = split_part(k, '-', 1) THEN 1 ELSE 2 END AS r FROM ckey, tags, doc WHERE lang = split_part(k, '-', 1) OR l = lower(j->>'defaultLocale')),
chain AS (SELECT k AS f_chain, (row_number() OVER (PARTITION BY k ORDER BY r, l) - 1)::INT AS pos, locale FROM cand),
f AS (SELECT f_chain, pos, locale, folded, length(folded) AS form_len, CASE WHEN length(folded) < 4 THEN 0 WHEN length(folded) < 6 THEN 1 ELSE 2 END AS budget,
  entry_id, canonical_id, form AS surface_form, ['preferred', 'alternate', 'canonical'][tier_rank + 1] AS tier, tier_rank,
  '{{' || coalesce(array_to_string(list_transform(list_sort(json_keys(held)), lambda k: to_json(k)::VARCHAR || ':' || (held->k)::VARCHAR), ','), '') || '}}' AS metadata
  FROM once JOIN chain USING (locale) {where})"""


_WORDS = r"'[\p{L}\p{N}_]+'"

#: Claims on a table p(id, prompt, chain) of one-spaced ASCII prompts: h has exact hits, z fuzzy ones, k what is kept.
_CLAIMS = r"""
h AS (SELECT id, pos, f.*, strpos(' ' || prompt || ' ', ' ' || folded || ' ') - 1 AS s, 0 AS fuzzy FROM p JOIN f ON f_chain = chain
      WHERE contains(' ' || prompt || ' ', ' ' || folded || ' ')),
w AS (SELECT id, prompt, chain, split_part(prompt, ' ', 1) AS a, split_part(prompt, ' ', 2) AS b FROM p),
t AS (SELECT id, chain, a AS x, 0 AS turn, 0 AS s, length(a) AS n, false AS pair FROM w UNION ALL
      SELECT id, chain, b, 0, length(a) + 1, length(b), false FROM w WHERE b <> '' UNION ALL
      SELECT id, chain, a || ' ' || b, 0, 0, length(prompt), true FROM w WHERE b <> '' UNION ALL
      SELECT id, chain, b || ' ' || a, 1, 0, length(prompt), true FROM w WHERE b <> ''),
c AS (SELECT t.*, f.*, damerau_levenshtein(x, folded) AS dist, jaro_winkler_similarity(x, folded) AS sim FROM t JOIN f ON f_chain = chain
      WHERE tier <> 'canonical' AND budget > 0 AND pair = contains(folded, ' ')),
z AS (SELECT * FROM c WHERE dist <= budget AND sim >= 0.9 AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = c.id AND h.pos = c.pos AND h.s < c.s + c.n AND c.s < h.s + h.form_len)
      QUALIFY row_number() OVER (PARTITION BY id, pos, s, n, pair ORDER BY turn, sim DESC, dist, tier_rank, canonical_id, entry_id, folded) = 1),
g AS (SELECT id, pos, s, form_len AS n, 0 AS fuzzy, canonical_id, entry_id, surface_form, tier, tier_rank, locale, metadata FROM h
      UNION ALL SELECT id, pos, s, n, 1, canonical_id, entry_id, surface_form, tier, tier_rank, locale, metadata FROM z WHERE {fuzzy}),
o AS (SELECT *, row_number() OVER (PARTITION BY id, pos ORDER BY fuzzy, -n, tier_rank, s, canonical_id, entry_id) AS r FROM g),
k0 AS (SELECT o.*, NOT EXISTS (SELECT 1 FROM o b WHERE b.id = o.id AND b.pos = o.pos AND b.r < o.r AND b.s < o.s + o.n AND o.s < b.s + b.n
        AND NOT EXISTS (SELECT 1 FROM o e WHERE e.id = o.id AND e.pos = o.pos AND e.r < b.r AND e.s < b.s + b.n AND b.s < e.s + e.n)) AS keep FROM o),
k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s, n) - 1 AS match_no FROM (SELECT * FROM k0 WHERE keep QUALIFY pos = min(pos) OVER (PARTITION BY id)))
"""


def _claims(prompt: str, fuzzy: bool, table: str = "part", chain: str = "'en'") -> str:
    """Two-word prompts have claims at most two deep, so one level of NOT EXISTS settles the greedy choice."""
    p = f"p AS (SELECT p_partkey AS id, {prompt} AS prompt, {chain} AS chain FROM {table})"
    return f"WITH {_values('shop')}, {p}, {_CLAIMS.replace('{fuzzy}', str(fuzzy))}"


_TYPED = f"replace(replace(p_name, '{TYPO[0]}', '{TYPO[1]}'), 'nv', 'vn')"
_SWAPPED = f"split_part({_TYPED}, ' ', 2) || ' ' || split_part({_TYPED}, ' ', 1)"
_MATCH = """SELECT id AS p_partkey, {no} canonical_id, entry_id, surface_form, s::INT AS span_start, (s + n)::INT AS span_end, tier AS score_tier,
  locale AS matched_locale, CASE WHEN fuzzy = 1 THEN substr(prompt, s + 1, n) END AS correction, metadata FROM k JOIN p USING (id)"""
_NO = "match_no::INT AS match_no,"

_CASES = " ".join(f"WHEN {i} THEN '{x}'" for i, x in enumerate(REQUESTED))
_KEY = "CASE WHEN lower({0}) IN (SELECT k FROM ckey) THEN lower({0}) WHEN split_part(lower({0}), '-', 1) IN (SELECT k FROM ckey) THEN split_part(lower({0}), '-', 1) ELSE '' END"
_CHAIN_OF = _KEY.format("q")

#: Single-word forms: a word is an exact claim if it equals a form of its chain, else perhaps a correction.
_DOC_WORDS = rf"""
d AS (SELECT $ids, $prompt AS prompt, $locale AS chain FROM $table WHERE length($prompt) <= 10000),
w AS (SELECT $ids, chain, unnest(regexp_extract_all({_FOLD.format('prompt')}, {_WORDS})) AS x FROM d),
v AS (SELECT DISTINCT chain, x FROM w),
e AS (SELECT v.*, f.*, 0 AS fuzzy FROM v JOIN f ON f_chain = chain AND folded = x QUALIFY row_number() OVER (PARTITION BY chain, pos, x ORDER BY tier_rank, canonical_id, entry_id) = 1),
z AS (SELECT v.*, f.*, damerau_levenshtein(x, folded) AS dist, jaro_winkler_similarity(x, folded) AS sim FROM v JOIN f ON f_chain = chain
      WHERE tier <> 'canonical' AND budget > 0 AND abs(length(x) - form_len) <= budget),
b AS (SELECT * FROM z WHERE dist <= budget AND sim >= 0.9 AND NOT EXISTS (SELECT 1 FROM e WHERE e.chain = z.chain AND e.pos = z.pos AND e.x = z.x)
      QUALIFY row_number() OVER (PARTITION BY chain, pos, x ORDER BY sim DESC, dist, tier_rank, canonical_id, entry_id, folded) = 1),
m AS (SELECT chain, x, pos, locale, canonical_id, entry_id, surface_form, tier, 0 AS fuzzy FROM e UNION ALL SELECT chain, x, pos, locale, canonical_id, entry_id, surface_form, tier, 1 FROM b WHERE $fuzzy),
k AS (SELECT w.*, m.* EXCLUDE (chain, x) FROM w JOIN m USING (chain, x) QUALIFY pos = min(pos) OVER (PARTITION BY $ids))
"""


def _doc_words(fuzzy: bool, table="documents", ids="doc_id", prompt="text", locale="lang") -> str:
    rest = Template(_DOC_WORDS).substitute(fuzzy=fuzzy, table=table, ids=ids, prompt=prompt, locale=locale)
    return f"WITH {_values('talk', ('en', 'de', 'fr', 'es'))}, {rest}"


#: Any forms in any text: every place is tried, and the greedy choice goes claim by claim.
_ODD = rf"""WITH RECURSIVE {_values('odd')},
p AS (SELECT p_partkey, list_value({', '.join("'" + x.replace("'", "''") + "'" for x in ODD_PROMPTS)})[p_partkey % {len(ODD_PROMPTS)} + 1] || ' ' || p_name AS prompt, CASE WHEN p_partkey % 2 = 0 THEN 'ar-eg' ELSE 'en' END AS c FROM part),
l AS (SELECT p_partkey, pos, c, unnest(regexp_extract_all(prompt, '(?s).')) AS x, unnest(range(length(prompt))) AS i, chain.locale FROM p JOIN chain ON f_chain = c),
m AS (SELECT *, CASE WHEN locale LIKE 'ar%' THEN lower(x) WHEN x = '½' THEN '1⁄2' ELSE regexp_replace(replace(strip_accents(lower(x)), 'ß', 'ss'), '^[\x{{0300}}-\x{{036F}}\x{{064B}}-\x{{0655}}]$', '') END AS y FROM l),
x AS (SELECT p_partkey, pos, c, i, unnest(regexp_extract_all(y, '(?s).')) AS y FROM m),
n AS (SELECT *, row_number() OVER (PARTITION BY p_partkey, pos ORDER BY i) AS k FROM x),
t AS (SELECT p_partkey, pos, c, string_agg(y, '' ORDER BY k) AS y, list(i ORDER BY k) AS origins FROM n GROUP BY ALL),
h AS (SELECT * FROM (SELECT t.*, f.* EXCLUDE (pos), unnest(range(1, length(y) - form_len + 2)) AS s FROM t JOIN f ON f_chain = c AND f.pos = t.pos)
  WHERE substr(y, s, form_len) = folded AND NOT (s > 1 AND regexp_matches(substr(y, s - 1, 1), '^[\p{{L}}\p{{N}}_]')) AND NOT regexp_matches(substr(y, s + form_len, 1), '^[\p{{L}}\p{{N}}_]')),
o AS (SELECT *, row_number() OVER (PARTITION BY p_partkey ORDER BY -form_len, tier_rank, s, canonical_id, entry_id) AS r FROM (SELECT * FROM h QUALIFY pos = min(pos) OVER (PARTITION BY p_partkey))),
g AS (SELECT DISTINCT p_partkey, 0::BIGINT AS r, []::STRUCT(a BIGINT, z BIGINT)[] AS taken FROM o UNION ALL
  SELECT o.p_partkey, o.r, CASE WHEN len(list_filter(taken, lambda q: q.a < o.s + o.form_len AND o.s < q.z)) = 0 THEN list_append(taken, {{'a': o.s, 'z': o.s + o.form_len}}) ELSE taken END
  FROM g JOIN o ON o.p_partkey = g.p_partkey AND o.r = g.r + 1),
b AS (SELECT p_partkey, unnest(arg_max(taken, r)) AS q FROM g GROUP BY p_partkey)
SELECT p_partkey, entry_id, origins[s]::INT AS span_start, (origins[s + form_len - 1] + 1)::INT AS span_end, locale AS matched_locale
FROM b JOIN o USING (p_partkey) WHERE o.s = b.q.a AND o.s + form_len = b.q.z QUALIFY row_number() OVER (PARTITION BY p_partkey, s ORDER BY r) = 1"""

_CONVERSATIONS = _doc_words(True, "conversations", "conv_id, turn", "text", "'en'") + "SELECT conv_id, turn, entry_id, count(*) AS n, count(*) FILTER (fuzzy = 1) AS n_corrected FROM k GROUP BY ALL"

SQL = {
    "flagship_resolve_parts": _claims("p_name", True) + _MATCH.format(no=_NO),
    "exact_parts": _claims("p_name", False) + _MATCH.format(no=_NO),
    "fuzzy_resolve_parts": _claims(_TYPED, True) + _MATCH.format(no=_NO),
    "exact_only_typed_parts": _claims(_TYPED, False) + _MATCH.format(no=_NO),
    "fuzzy_swapped": _claims(_SWAPPED, True) + _MATCH.format(no="") + " WHERE contains(surface_form, ' ')",
    "whole_words_only": f"WITH {_values('shop')}, w AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS x, unnest([0, 1 + length(split_part(p_name, ' ', 1))]) AS s FROM part WHERE p_partkey % 2 = 0"
    " UNION ALL SELECT p_partkey, replace(p_name, ' ', '-'), 0 FROM part WHERE p_partkey % 2 = 0 AND contains(p_name, ' '))"
    " SELECT p_partkey, canonical_id, entry_id, surface_form, s::INT AS span_start, (s + form_len)::INT AS span_end, tier AS score_tier, locale AS matched_locale, NULL::VARCHAR AS correction, metadata FROM w JOIN f ON f_chain = 'en' AND folded = x"
    " QUALIFY contains(folded, '-') = max(contains(folded, '-')) OVER (PARTITION BY p_partkey)",
    "odd_forms_parts": _ODD,
    "fold_text": f"SELECT doc_id, md5({_FOLD.format('text')}) AS folded_md5, length({_FOLD.format('text')}) AS folded_chars FROM documents",
    "token_frequency": f"SELECT token, count(*) AS n FROM (SELECT unnest(regexp_extract_all({_FOLD.format('text')}, {_WORDS})) AS token FROM documents) GROUP BY token",
    "guards": r"SELECT lang, count(*) FILTER (length(text) > 10000) AS n_oversize, count(*) FILTER (regexp_full_match(text, '\s*')) AS n_blank, count(*) AS n FROM documents GROUP BY lang",
    "rejected_documents": "SELECT doc_id, 'prompt' AS field, 0::BIGINT AS n_matches FROM documents WHERE length(text) > 10000",
    "forms_catalog": f"WITH {_values('shop')} SELECT pos, locale, entry_id, folded, tier, form_len, budget FROM f WHERE f_chain = 'de-at'",
    "exact_hits_parts": _claims("p_name", False) + 'SELECT id AS p_partkey, folded, tier, s::INT AS start, (s + form_len)::INT AS "end" FROM h',
    "string_distances": f"WITH {_values('shop')}, w AS (SELECT DISTINCT unnest(string_split({_TYPED}, ' ')) AS token FROM part) SELECT token, folded, damerau_levenshtein(token, folded)::INT AS dist, round(jaro_winkler_similarity(token, folded), 9) AS sim FROM w, (SELECT DISTINCT folded FROM f WHERE f_chain = 'en')",
    "locale_chain": f"WITH {_values('shop')}, q AS (SELECT unnest({list(REQUESTED)}) AS requested) SELECT requested, pos, locale FROM q JOIN chain ON f_chain = {_KEY.format('requested')}",
    "fallback_first_match": _claims("p_name", False, f"(SELECT *, CASE p_partkey % {len(REQUESTED)} {_CASES} END AS q FROM part)", _CHAIN_OF)
    + f"SELECT p_partkey, coalesce(any_value(locale), any_value(CASE p_partkey % {len(REQUESTED)} {_CASES} END)) AS answered, count(locale) AS n_matches FROM part LEFT JOIN k ON id = p_partkey GROUP BY p_partkey",
    "explicit_chain": "SELECT p_partkey, CASE WHEN p_name LIKE '%plate' THEN 'de-AT' WHEN p_name LIKE '%bolt' THEN 'de-AT' WHEN p_name LIKE '%gizmo' THEN 'fr-FR' ELSE 'en' END AS answered, (p_name LIKE '%plate' OR p_name LIKE '%gizmo' OR p_name LIKE '%bolt')::BIGINT AS n_matches FROM part",
    "span_backtranslation": _claims("p_name", False) + "SELECT id AS p_partkey, match_no::INT AS match_no, (s + 4)::INT AS span_start, (s + 4 + n)::INT AS span_end, upper(substr(prompt, s + 1, n)) AS slice FROM k JOIN p USING (id)",
    "shared_entities": _claims("p_name", True) + "SELECT canonical_id, entry_id, metadata, count(*) AS n FROM k GROUP BY ALL",
    "report_json_parts": _claims("p_name", False)
    + """SELECT p_partkey, '{"locale":"en","matches":[' || coalesce(string_agg('{"canonical_id":"' || canonical_id || '","correction":null,"entry_id":"' || entry_id || '","matched_locale":"en","metadata":' || metadata || ',"score_tier":"' || tier || '","span":[' || s || ',' || (s + n) || '],"surface_form":"' || surface_form || '"}', ',' ORDER BY match_no), '') || '],"prompt":"' || p_name || '"}' AS json FROM part LEFT JOIN k ON id = p_partkey GROUP BY p_partkey, p_name""",
    "residue_words": _claims("p_name", False) + "SELECT x AS token, count(*) AS n FROM t WHERE NOT pair AND NOT EXISTS (SELECT 1 FROM h WHERE h.id = t.id AND h.s < t.s + t.n AND t.s < h.s + h.form_len) GROUP BY x",
    "resolve_documents": _doc_words(True) + "SELECT doc_id, locale AS matched_locale, canonical_id, entry_id, surface_form, tier AS score_tier, count(*) AS n, count(*) FILTER (fuzzy = 1) AS n_corrected FROM k GROUP BY ALL",
    "matches_by_language": _doc_words(False) + "SELECT locale AS matched_locale, canonical_id, count(*) AS n FROM k GROUP BY ROLLUP (locale, canonical_id)",
    "coverage_by_label": _doc_words(False) + "SELECT quality, toxic, count(*) AS docs, sum(coalesce(n, 0))::BIGINT AS matches FROM labels LEFT JOIN (SELECT doc_id, count(*) AS n FROM k GROUP BY doc_id) USING (doc_id) GROUP BY ALL",
    "resolve_conversations": _CONVERSATIONS,
    "streaming_resolve": _CONVERSATIONS,
    "entity_windows_events": "SELECT time_bucket(INTERVAL 1 DAY, ts) AS window_start, CASE event_type WHEN 'purchase' THEN 'conversion' WHEN 'signup' THEN 'conversion' WHEN 'error' THEN 'failure' ELSE 'visit' END AS canonical_id, count(*) AS n FROM events GROUP BY ALL",
}
