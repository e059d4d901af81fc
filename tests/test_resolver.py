import random

import pytest

from core_helpers import lexicon
from oracle import resolve
from termloom.functions.canonical import deserialize, report_from_json, report_json, serialize
from termloom.functions.folding import alone, fold, fold_with_origins, original_span
from termloom.functions.similarity import damerau_levenshtein, jaro_winkler
from termloom.operators.chain import default_chain
from termloom.plans.resolver import EntityResolver
from termloom.sources.lexicon import ValidationError


def reports(spark, document, rows, **options):
    df = spark.createDataFrame([(i, p, loc) for i, (p, loc) in enumerate(rows)], "id int, prompt string, locale string")
    out = EntityResolver.from_dict(document, **options).transform(df).orderBy("id").select("report").collect()
    return [r[0] for r in out]


def found(report):
    return [tuple(m) for m in report["matches"]]


def brief(report):
    return [(m["canonical_id"], m["span_start"], m["span_end"], m["score_tier"], m["correction"]) for m in report["matches"]]


def forms(singular, *alternates, **more):
    return {"preferred": {"singular": singular} | more, "alternates": list(alternates)}


def test_a_form_and_a_typo(spark):
    """A six- or seven-letter form allows two edits and a similarity of 0.90; a shorter one fewer."""
    prompts = ["the lantern went out", "the lantren went out", "lante", "lan", "lanteoo", "antern", "zirkel", "\n \t"]
    got = reports(spark, lexicon(lamp="lantern"), [(p, "de-DE") for p in prompts])
    typed = [("lamp", 4, 11, "preferred", "lantren")], [("lamp", 0, 5, "preferred", "lante")], [("lamp", 0, 6, "preferred", "antern")]
    assert [brief(r) for r in got] == [[("lamp", 4, 11, "preferred", None)], typed[0], typed[1], [], [], typed[2], [], []]
    assert got[3]["locale"] == "de-DE" and got[0]["error"] is None
    got = reports(spark, lexicon("en", metal="zinc", tin="tin", gold="gold"), [(p, "en") for p in ("znic", "zinnc", "tinn", "tn", "goldd", "zznicc")])
    assert [bool(r["matches"]) for r in got] == [True, True, False, False, True, False]


def test_rankings_of_corrections(spark):
    """The most similar, then the least distant, the better tier, the lesser entity."""
    cases = [
        ("marble", lexicon("en", swapped="marbel", changed="mardle"), "swapped"),
        ("monitr", lexicon("en", whole="monitor", off="monitox"), "whole"),
        ("marble", lexicon("en", first=forms("qqqqqq", "mardle"), second="margle"), "second"),
        ("marble", lexicon("en", pebble="mardle", agate="margle"), "agate"),
    ]
    for typed, document, winner in cases:
        assert [b[0] for b in brief(reports(spark, document, [(f"one {typed} more", "en")])[0])] == [winner]


def test_pairs_of_words(spark):
    prompts = ["to the invoce dsek please", "to the desk invoice please", "invoce desk", "invoixx deks", "invoice-desk", "desk  invoce"]
    got = reports(spark, lexicon("en", counter="invoice desk"), [(p, "en") for p in prompts])
    assert [bool(r["matches"]) for r in got] == [True, True, True, False, True, True]
    assert brief(got[1]) == [("counter", 7, 19, "preferred", "desk invoice")]


def test_overlaps(spark):
    en = "en"
    three = lexicon(en, a1="north sea oil", b1="oil rig west", c1="west wing", d1="wing mirror glass")
    got = reports(spark, three, [("north sea oil rig west wing mirror glass", en), ("oil rig west wing mirror", en), ("north sea oil rig west wing", en)])
    assert [[b[0] for b in brief(r)] for r in got] == [["a1", "d1"], ["b1"], ["a1", "c1"]]
    got = reports(spark, lexicon(en, part="mirror", whole="wing mirror"), [("a wing mirror fell", en)])
    assert brief(got[0]) == [("whole", 2, 13, "preferred", None)]
    got = reports(spark, lexicon(en, later="oil rig", alternate=forms("zz", "sea oil")), [("sea oil rig", en)])
    assert brief(got[0]) == [("later", 4, 11, "preferred", None)]
    # What an exact form touches is never corrected, even where that form loses.
    got = reports(spark, lexicon(en, arrow="=>", counter="invoice desk"), [("invoice => dsek", en)])
    assert [b[0] for b in brief(got[0])] == ["arrow"]


def test_folding_and_spans(spark):
    got = reports(spark, lexicon(fee="gebühr", street="strasse"), [("eine gebürh zahlen", "de-DE"), ("die Straße und", "de-DE"), ("½ é Straße", "de-DE"), ("GEBU\u0308HR", "de-DE")])
    assert brief(got[0]) == [("fee", 5, 11, "preferred", "gebürh")]
    assert [r["prompt"][m["span_start"] : m["span_end"]] for r in got[1:] for m in r["matches"]] == ["Straße", "Straße", "GEBU\u0308HR"]
    # Arabic keeps its marks: a form without them is another word.
    got = reports(spark, lexicon("ar-EG", coffee="قهوة"), [("شرب قهوة", "ar-EG"), ("شرب قَهوة", "ar-EG"), ("الـقهوة", "ar-EG")], fuzzy=False)
    assert [bool(r["matches"]) for r in got] == [True, False, False]
    assert fold("Straße ÉÀ") == "strasse ea" and fold("أ", False) == "أ" and fold("أ") == "ا"
    text, origins = fold_with_origins("½a")
    assert text == "1⁄2a" and original_span(origins, 1, 4) == (0, 2) and original_span(None, 1, 2) == (1, 2)
    with pytest.raises(ValueError):
        original_span(None, 2, 2)


def test_words_by_pythons_notion_of_them(spark):
    got = reports(spark, lexicon("en", language="c++"), [(p, "en") for p in ("c++", "c++_x", "c++x", "(c++)", "c++\u0301", "xc++", "c++²")])
    assert [bool(r["matches"]) for r in got] == [True, False, False, True, True, False, False]


def test_fallback(spark):
    both = {"locales": {"de-DE": {"preferred": {"singular": "quittung"}}, "de-AT": {"preferred": {"singular": "quittung"}}}}
    doc = lexicon(lamp="lantern", receipt=both)
    got = reports(spark, doc, [("eine lantern", "de-AT"), ("die quittung bitte", "de-AT"), ("lantern", "fr-FR"), ("nichts", "fr-FR")])
    assert [r["locale"] for r in got] == ["de-DE", "de-AT", "de-DE", "fr-FR"]
    near = lexicon(lamp={"locales": {"de-AT": {"preferred": {"singular": "lanterne"}}, "de-DE": {"preferred": {"singular": "lantern"}}}})
    got = reports(spark, near, [("eine lantern", "de-AT")])[0]
    assert (got["locale"], got["matches"][0]["surface_form"], got["matches"][0]["correction"]) == ("de-AT", "lanterne", "lantern")
    declared = {x.casefold(): x for x in ("de-DE", "de-CH", "de-AT")}
    assert default_chain("de-LU", declared, "de-DE") == ["de-AT", "de-CH", "de-DE"]
    with pytest.raises(ValidationError) as e:
        EntityResolver.from_dict(doc, fallback_chain="fr")
    assert e.value.field == "fallback_chain"


def test_guards(spark):
    rows = [("x" * 10_000, "de-DE"), ("x" * 10_001, "de-DE"), ("lantern", None), (None, "de-DE"), ("a" + "́" * 9_000 + " lantern", "de-DE")]
    r = reports(spark, lexicon(lamp="lantern"), rows)
    assert r[0]["error"] is None and r[1]["error"]["field"] == "prompt" and r[2]["error"]["field"] == "locale" and r[3] is None
    assert brief(r[4])[0][:2] == ("lamp", 9_002)
    resolver = EntityResolver.from_dict(lexicon(lamp="lantern"))
    with pytest.raises(Exception, match="10001"):
        df = spark.createDataFrame([("x" * 10_001, "de-DE")], "prompt string, locale string")
        resolver.transform(df, on_error="raise").collect()
    with pytest.raises(ValidationError):
        resolver.transform("a\ud800b", "de-DE")
    with pytest.raises(ValidationError):
        resolver.transform("lantern", None)


def test_extra_columns_stay_and_rows_repeat(spark):
    names = ["id", "text", "tag", "key", "_key", "_found", "_key_of", "metadata", "match_no", "report", "_m"]
    df = spark.createDataFrame([(1, "lantern", "de-DE", *"abcdefgh")] * 2, names)
    resolver = EntityResolver.from_dict(lexicon(lamp="lantern"))
    out = resolver.matches(df, "text", "tag")
    assert out.columns == [*names, "_match_no", "canonical_id", "entry_id", "surface_form", "span_start", "span_end", "score_tier", "matched_locale", "correction", "_metadata"]
    assert [tuple(r)[:11] for r in out.collect()] == [(1, "lantern", "de-DE", *"abcdefgh")] * 2
    assert resolver.transform(df.limit(0), "text", "tag").count() == 0


def test_one_pass_over_the_rows(spark):
    """One scan, one Arrow function, and no row moves, whoever repeats."""
    df = spark.range(1000).selectExpr("id", "if(id % 3 = 0, 'a lantren', concat('nr ', id)) as prompt", "if(id % 5 = 0, null, 'de-DE') as locale")
    out = EntityResolver.from_dict(lexicon(lamp="lantern")).matches(df)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Exchange" not in plan and "Join" not in plan and plan.count("Range") == 1
    assert out.count() == sum(i % 3 == 0 and i % 5 != 0 for i in range(1000))


def test_public_names_and_single_prompts():
    import termloom

    assert len(termloom.__all__) == 15 and all(hasattr(termloom, n) for n in termloom.__all__)
    doc = lexicon(lamp={"metadata": {"kind": ["oil", "gas"], "rank": 2}, "locales": {"de-DE": {"preferred": {"singular": "lantern"}}}})
    report = termloom.EntityResolver(termloom.Lexicon.from_dict(doc)).transform("the lantren", "de-AT")
    match = report.matches[0]
    assert (report.locale, match.span, match.score_tier, match.correction) == ("de-DE", (4, 11), termloom.ScoreTier.PREFERRED, "lantren")
    assert dict(match.metadata) == {"kind": ("oil", "gas"), "rank": 2} and hash(report) == hash(report)
    assert termloom.deserialize_report(termloom.serialize_report(report)) == report


def test_reports_as_json(spark):
    doc = {"schemaVersion": "1", "defaultLocale": "de-DE", "entities": {"movie": {"canonicalId": "product", "metadata": {"rank": 12.0, "genre": ["drama", "thriller"]}, "locales": {"de-DE": {"preferred": {"singular": "fiłm"}}}}}}
    df = spark.createDataFrame([("der fiłm", "de-DE"), ("", "de-DE")], "prompt string, locale string")
    out = EntityResolver.from_dict(doc).transform(df).withColumn("j", report_json("report")).withColumn("back", report_from_json("j"))
    rows = {r["prompt"]: r for r in out.collect()}
    said = rows["der fiłm"]["j"]
    assert said == '{"locale":"de-DE","matches":[{"canonical_id":"product","correction":null,"entry_id":"movie","matched_locale":"de-DE","metadata":{"genre":["drama","thriller"],"rank":12.0},"score_tier":"preferred","span":[4,8],"surface_form":"fi\\u0142m"}],"prompt":"der fi\\u0142m"}'
    assert rows["der fiłm"]["back"] == rows["der fiłm"]["report"] and serialize(deserialize(said)) == said
    assert rows[""]["j"] == '{"locale":"de-DE","matches":[],"prompt":""}'


def test_distances():
    assert damerau_levenshtein("ca", "abc") == 2 and damerau_levenshtein("tabel", "table") == 1 and damerau_levenshtein("", "ab") == 2
    assert round(jaro_winkler("marble", "marbel"), 3) == 0.967 and round(jaro_winkler("narble", "marble"), 3) == 0.889
    assert jaro_winkler("marble", "mardle") == jaro_winkler("marble", "margle") and jaro_winkler("lan", "lantern") < 0.9


def _random_case(rng):
    letters = "abdeéilo"
    word = lambda n=None: "".join(rng.choice(letters) for _ in range(n or rng.randint(1, 7)))
    pool = [rng.choice([word(), word(), f"{word(4)} {word(5)}", f"{word(3)}++", "->", f"{word(3)}-{word(3)}", "½" + word(2)]) for _ in range(8)]
    doc, used = lexicon("de-DE", x="zzzzzzzz"), set()
    for i in range(5):
        locales = {}
        for tag in rng.sample(["de-DE", "de-AT", "ar-EG", "en"], rng.randint(1, 3)):
            mine = [f for f in dict.fromkeys(rng.sample(pool, 3)) if (tag, f.casefold()) not in used]
            if mine:
                used.update((tag, f.casefold()) for f in mine)
                locales[tag] = {"preferred": {"singular": mine[0]}, "alternates": [f for f in mine[1:] if f != mine[0]]}
        if locales:
            doc["entities"][f"e{i}"] = {"locales": locales, "canonicalId": rng.choice([f"e{i}", "shared"]), "metadata": {"n": i}}
    prompts = []
    for _ in range(12):
        parts = []
        for _ in range(rng.randint(1, 6)):
            p = rng.choice([*pool, word()])
            if rng.random() < 0.4 and len(p) > 3:
                k = rng.randrange(len(p) - 1)
                p = p[:k] + p[k + 1] + p[k] + p[k + 2 :]
            parts.append(p.upper() if rng.random() < 0.2 else p)
        prompts.append((rng.choice([" ", "  ", ", ", "-", ""]).join(parts), rng.choice(["de-DE", "de-AT", "de-LU", "fr", "ar", "EN-gb"])))
    return doc, prompts


@pytest.mark.parametrize("seed", range(6))
def test_like_straight_line_python(spark, seed):
    """The plan, the same in this process, and the places of all forms by joins."""
    doc, prompts = _random_case(random.Random(seed))
    for fuzzy in (True, False):
        got = reports(spark, doc, prompts, fuzzy=fuzzy)
        resolver = EntityResolver.from_dict(doc, fuzzy=fuzzy)
        for (prompt, locale), r in zip(prompts, got, strict=True):
            assert (r["locale"], found(r)) == resolve(doc, prompt, locale, fuzzy), (prompt, locale)
            assert resolver.report_of(prompt, locale) == r.asDict(recursive=True)
    texts = spark.createDataFrame([(i, p, resolver.compiled.key(loc)) for i, (p, loc) in enumerate(prompts)], "key int, prompt string, chain string")
    placed = {(r["key"], r["pos"], r["form_id"], r["start"], r["end"]) for r in resolver.hits(texts).collect()}
    for i, (prompt, loc) in enumerate(prompts):
        for pos, tag in enumerate(resolver.chains[resolver.compiled.key(loc)]):
            text = fold(prompt, not tag.startswith("ar"))
            for f in (f for f in resolver.forms if f["locale"] == tag):
                for k in range(len(text)):
                    stands = text.startswith(f["folded"], k) and alone(text, k, k + f["form_len"])
                    assert ((i, pos, f["form_id"], k, k + f["form_len"]) in placed) == stands
