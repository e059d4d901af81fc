import json
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from core_helpers import lexicon
from termloom.cli import main
from termloom.functions.folding import fold, stretches, words_of
from termloom.plans import catalogue
from termloom.plans.lexicons import EVENTS
from termloom.plans.resolver import EntityResolver
from termloom.plans.sql import register_functions, register_lexicon, register_table_function, resolve_view
from termloom.sources.outcomes import filter_text, marked
from termloom.streaming.resolve import entity_windows, resolve_stream

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "part documents conversations labels events benchmark".split():
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return con


def rows(df):
    df = df[sorted(df.columns)].astype(object)
    return sorted(map(repr, df.where(df.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_queries_equal_their_sql(spark, duck, name):
    assert rows(catalogue.QUERIES[name](spark, SF).toPandas()) == rows(duck.execute(catalogue.SQL[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_plan_has_no_cartesian_product(spark):
    resolver = catalogue.resolver("shop")
    df = spark.read.parquet(f"{SF}/part.parquet").selectExpr("p_name as prompt", "'en' as locale")
    plan = resolver.transform(df)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan and "ReadSchema: struct<p_name:string>" in plan


def test_partitioning_does_not_matter(spark):
    df = catalogue._docs(spark, SF)
    resolver = catalogue.resolver("talk")
    one, other = (resolver.matches(x).select("doc_id", "match_no", "span_start", "entry_id").toPandas() for x in (df, df.repartition(7)))
    assert rows(one) == rows(other)


def test_words_of_a_batch_are_not_held_at_once(spark, tmp_path, monkeypatch):
    """500 texts of 40 KB come in one Arrow batch; lists of their five million words would take 300 MB. The workers are new
    ones, told from others by their environment."""
    spark.range(0, 500, 1, 1).select(F.repeat(F.concat(F.lit("Ab c"), F.col("id") % 10, F.lit(" ")), 6667).alias("text")).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setitem(spark.sparkContext.environment, "TERMLOOM_TEST", str(tmp_path))
    got = {r["token"]: r["n"] for r in catalogue.token_frequency(spark, str(tmp_path)).collect()}
    assert got == {"ab": 500 * 6667} | {f"c{i}": 50 * 6667 for i in range(10)}
    mine = []
    for p in Path("/proc").glob("[0-9]*"):
        try:
            if f"TERMLOOM_TEST={tmp_path}".encode() in (p / "environ").read_bytes():
                mine.append(int(re.search(r"VmHWM:\s+(\d+) kB", (p / "status").read_text())[1]) >> 10)
        except (OSError, TypeError):  # ended, or not ours
            continue
    assert mine and max(mine) < 300, mine


def test_words_across_stretches(spark):
    text = "Straße½ é\u00a0x" + "\u3000Ünder_score-" * 9 + "w" * 40 + "\n\u0130 e\u0301\x85z "
    want = re.findall(r"\w+", fold(text))
    for size in (1, 2, 3, 7, 50, 1000):
        parts = list(stretches(text, size))
        assert "".join(parts) == text and [w for p in parts for w in re.findall(r"\w+", fold(p))] == want
    assert len(list(stretches(text, 3))) > 5 and list(stretches("")) == [""]
    long = text * 30_000  # a row of several stretches
    got = words_of(spark.createDataFrame([(long,), (None,), ("",), ("x",)], "text string"), F.col("text"), True)
    assert {r["token"]: r["count"] for r in got.groupBy("token").count().collect()} == {w: n * 30_000 + (w == "x") for w, n in Counter(want).items()}


def test_cli(tmp_path, capsys):
    good, bad = tmp_path / "good.json", tmp_path / "bad.json"
    good.write_text(json.dumps(lexicon(lamp="lantern")), "utf-8")
    bad.write_text(json.dumps(lexicon(product="")), "utf-8")
    assert main(["validate", str(good)]) == 0 and "valid lexicon" in capsys.readouterr().out
    assert main(["validate", str(bad)]) == 1 and "preferred.singular" in capsys.readouterr().err
    assert main(["validate", str(tmp_path / "none.json")]) == 3 and "cannot read" in capsys.readouterr().err
    bad.write_text("{", "utf-8")
    assert main(["validate", str(bad)]) == 3 and "not valid JSON" in capsys.readouterr().err
    assert main(["try", str(good), "--locale", "de-DE", "the lantren"]) == 0
    said = capsys.readouterr().out
    assert "[lantren]" in said and 'correction: "lantren"' in said and "1 match:" in said
    assert main(["try", str(good), "--locale", "de-DE", "nichts"]) == 4 and "no match" in capsys.readouterr().out
    assert main(["try", str(good), "--locale", "de-DE", "x" * 10_001]) == 5
    assert main(["schema"]) == 0 and json.loads(capsys.readouterr().out)["type"] == "object"


def test_text_of_reports():
    assert marked("ab cd", [{"span_start": 0, "span_end": 2}, {"span_start": 3, "span_end": 5}]) == "[ab] [cd]"
    assert filter_text('{"a":true,"b":["x","y"],"c":"z","d":1.5}') == "a=true, b=x|y, c=z, d=1.5"


def test_sql_surface(spark):
    register_functions(spark)
    row = spark.sql("SELECT fold_text('Straße', true), dl_distance('tabel', 'table'), round(jw_similarity('marble', 'marbel'), 3)").first()
    assert tuple(row) == ("strasse", 1, 0.967)
    resolver = EntityResolver.from_dict(lexicon(lamp="lantern"))
    register_lexicon(spark, resolver, "lex")
    assert spark.sql("SELECT count(*) FROM lex_forms JOIN lex_chains ON f_chain = chain AND lex_forms.pos = lex_chains.pos").first()[0] > 0
    spark.createDataFrame([("the lantrenf", "de-DE")], "prompt string, locale string").createOrReplaceTempView("asked")
    resolve_view(spark, resolver, "asked", "answered")
    assert spark.sql("SELECT canonical_id, span_start FROM answered").first() == ("lamp", 4)
    register_table_function(spark, resolver)
    assert spark.sql("SELECT f.entry_id, span_start FROM asked, LATERAL resolve_prompt(prompt, locale) f").collect() == [("lamp", 4)]


def test_streams(spark, tmp_path):
    resolver = EntityResolver.from_dict(EVENTS)
    src = tmp_path / "in"
    spark.createDataFrame([("view", "en", "2024-01-01 00:10:00"), ("error", "en", "2024-01-01 00:20:00"), ("buy", "en", "2024-01-01 03:00:00")], "prompt string, locale string, ts string").selectExpr("prompt", "locale", "to_timestamp(ts) ts").write.parquet(str(src))
    schema = spark.read.parquet(str(src)).schema
    stream = spark.readStream.schema(schema).parquet(str(src))
    resolve_stream(resolver, stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out"))
    assert {r["canonical_id"] for r in got.collect()} == {"visit", "failure"}
    counts = entity_windows(got, "ts").collect()
    assert sum(r["n"] for r in counts) == 2
    live = spark.readStream.schema(got.schema).parquet(str(tmp_path / "out") + "/batch=0")
    query = entity_windows(live, "ts", late="10 minutes").writeStream.format("memory").queryName("live").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("live").count() == 2
