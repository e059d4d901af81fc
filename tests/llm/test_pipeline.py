import brute
import corpus_pipeline
from llm_helpers import SCHEMA
from termloom.llm.decontamination import without_spans


def test_stages_like_brute_force(spark, rows, tmp_path):
    text = next(t for _, t, *_ in rows if t and len(t.split()) > 80)
    items = [("b", " ".join(text.split()[3:20]))]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, SCHEMA)
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    state, source = {r[0]: r[1] for r in rows}, {r[0]: r[3] for r in rows}
    steps = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        docs.write.parquet(str(tmp_path / name.replace(" ", "_")))
        docs = spark.read.parquet(str(tmp_path / name.replace(" ", "_")))
        steps[name] = [(r["doc_id"], r["text"]) for r in docs.collect()]
        if name != "mixing sources to target weights":
            assert all(r["n_chars"] == len(r["text"]) for r in docs.collect())
    kept = dict(steps["quality rules"])
    assert set(kept) <= set(state) and all(state[i] == t for i, t in kept.items()) and len(kept) > 40
    kept = brute.line_dedup(kept.items())
    assert dict(steps["line dedup"]) == kept
    kept = {i: t for i, t in kept.items() if brute.jaccard(kept.items())[i][1] == i}
    assert dict(steps["n-gram Jaccard join"]) == kept
    hit = brute.hit_words(kept.items(), items)
    kept = {i: t for i, t in kept.items() if 20 * len(hit[i][1]) < hit[i][0] or not hit[i][1]}
    left = dict(steps["benchmark decontamination"])
    assert left.keys() == kept.keys() and all(left[i] == t for i, t in kept.items() if not hit[i][1])
    assert not any(h for _, h, _ in brute.hit_words(left.items(), items).values())
    sizes = {}
    for i, t in left.items():
        sizes[source[i]] = sizes.get(source[i], 0) + len(brute.words(t))
    want = brute.targets(sizes)
    copies = {}
    for i, t in steps["mixing sources to target weights"]:
        assert left[i] == t
        copies[i] = copies.get(i, 0) + 1
    for i in left:
        rate = want[source[i]] / sizes[source[i]]
        assert abs(copies.get(i, 0) - rate) < 1
    again = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted((r["doc_id"], r["text"]) for r in again.collect()) == sorted(steps["mixing sources to target weights"])


def test_stages_take_odd_and_empty_tables(spark, odd_docs, tmp_path):
    spark.createDataFrame([], "item_id string, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for docs in (odd_docs, spark.createDataFrame([], SCHEMA)):
        for _, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            assert out.columns == docs.columns and out.count() <= 3 * docs.count()


def test_spans_are_cut_out():
    assert without_spans("abcdef", [{"start": 1, "end": 3}, {"start": 5, "end": 6}]) == "ade" and without_spans(None, []) is None
