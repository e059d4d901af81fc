import hashlib
import random
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import brute
from gold_pages import GOLD, P1
from llm_helpers import SCHEMA
from termloom.llm import jaccard_join, queries, suffix_dedup as sd
from termloom.llm.chat_format import chat_template, escape, format_chats, read_turn, render, unescape
from termloom.llm.decontamination import FMIndex, WaveletTree, decontaminate, suffix_array, without_spans
from termloom.llm.graph import components
from termloom.llm.html_extract import INLINE, UNSEEN, extract, features, labelled_page, leaf_blocks, main_text, trained
from termloom.llm.jaccard_join import Signatures, jaccard_components, needed, prefix_length, set_digests, shingle_sets, signatures
from termloom.llm.line_dedup import line_dedup
from termloom.llm.lm_scoring import lm_score
from termloom.llm.mixing import emit_copies, mix_sources
from termloom.llm.quality_rules import quality_rules
from termloom.llm.substring_dedup import substring_dedup
from termloom.llm.suffix_dedup import suffix_dedup


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# 1 ---------------------------------------------------------------------------


def test_substring_dedup(docs, odd_docs, empty, rows):
    for df in (docs, odd_docs):
        out = substring_dedup(df)
        name = "sd" if df is docs else "_sd"
        assert out.columns == [*df.columns, name] and out.count() == df.count()
        want = brute.substring_dedup(pairs(rows))
        for r in out.where("doc_id is not null").collect():
            spans = [(s["start"], s["end"], s["keeper"], s["keeper_unit"]) for s in r[name]["spans"]]
            assert (spans, r[name]["kept"]) == want[r["doc_id"]]
            assert all(r["text"][s["start"] : s["end"]].strip() for s in r[name]["spans"])
        assert any(s for s, _ in want.values())
    assert substring_dedup(empty).count() == 0


def test_passages_inside_lines(spark):
    """A passage is found wherever it stands in a line; a phrase that recurs stays; a text repeats itself; long texts."""
    rng = random.Random(8)
    say = lambda k: " ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(k))
    passage = " ".join(f"{say(12).capitalize()}." for _ in range(5))
    phrase = f"{say(9)}."
    long = "\n".join(" ".join(f"{say(9)}!" for _ in range(20)) for _ in range(2000))
    rows = [
        (1, f"{say(4)} {say(5)}. {passage} {say(7)}"), (2, f"{say(30)} x. {passage.upper()}  {say(3)}"), (3, f"{say(20)}. {phrase}"), (4, f"{say(20)}. {phrase}"),
        (5, f"{passage}\n{passage}"), (6, long), (7, f"{long} {say(4)}"), (8, passage.replace(". ", ".\n")), (9, "no. " * 50_000),
    ]
    got = {r["doc_id"]: r["sd"] for r in substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.substring_dedup(rows)
    assert {i: ([(s["start"], s["end"], s["keeper"], s["keeper_unit"]) for s in r["spans"]], r["kept"]) for i, r in got.items()} == want
    assert sorted(i for i, r in got.items() if r["n_removed"]) == [2, 5, 7, 8] and got[5]["kept"].strip() == "" and got[4]["n_chars_removed"] == 0


# 2 ---------------------------------------------------------------------------


@pytest.mark.parametrize("order", [1, 2, 3])
def test_lm_score(docs, odd_docs, empty, rows, order):
    want = brute.lm(pairs(rows), order)
    got = {r[0]: tuple(r)[1:] for r in lm_score(docs, order=order, block=1 << 14).collect()}
    assert got.keys() == want.keys()
    for i, w in want.items():
        assert got[i][:4] == w[:4] and np.allclose(got[i][4:], w[4:], rtol=1e-9), i
    assert lm_score(odd_docs).count() == odd_docs.count()
    assert lm_score(empty).count() == 0


def test_probabilities_sum_to_one():
    from termloom.llm.lm_scoring import Automaton, Block

    texts = ["a b a b c", "b c a", "a a a", "zz", "c zz"]
    trains = np.array([True, True, True, False, False])
    for order in (1, 2, 3):
        block = Block(texts, trains, order)
        totals = [c.copy() for c in block.counts]
        n, v = int(totals[0].sum()), int((totals[0] > 0).sum())
        automaton = Automaton(block, totals, n, v, 3.0)
        words = np.arange(len(totals[0]))  # a, b, c, the end, and one that was never seen
        for state in range(len(automaton.fail)):
            _, p = automaton.read(np.full(len(words), state), words)
            assert abs((10.0**p).sum() - 1) < 1e-9


# 3 ---------------------------------------------------------------------------


def test_jaccard_components(spark, docs, odd_docs, empty, rows):
    want = brute.jaccard(pairs(rows))
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(docs).collect()}
    assert got == want and len({c for _, c in want.values()}) < len(want)
    odd = jaccard_components(odd_docs).collect()
    assert len(odd) == odd_docs.count()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in odd if r["doc_id"] is not None} == want
    assert all(r["component_id"] is None for r in odd if r["doc_id"] is None)
    assert jaccard_components(empty).count() == 0


def test_jaccard_groups_of_near_copies(spark):
    """A group whose members aren't all linked with each other, and a passage that many texts share."""
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(3000)]
    base, shared = rng.choices(vocabulary, k=90), rng.choices(vocabulary, k=40)
    rows = []
    for i in range(120):
        w = list(base)
        for _ in range(rng.randint(0, 7)):
            w[rng.randrange(90)] = rng.choice(vocabulary)
        rows.append((i, " ".join(w)))
    rows += [(200 + i, " ".join([*rng.choices(vocabulary, k=rng.choice([4, 8, 30])), *shared])) for i in range(60)]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_jaccard_of_repeated_ids_and_more_ids_than_a_filter_holds(spark, monkeypatch):
    """An id with two texts has the links of both; ids beyond the filter's bound are joined; pairs are dealt to many tasks."""
    from termloom.llm import jaccard_join

    say = lambda a, z: " ".join(f"w{k}" for k in range(a, z))
    rows = [(1, say(0, 80)), (5, say(0, 81)), (5, say(200, 280)), (7, say(200, 281)), (9, say(500, 580)), *[(5, say(0, 81))] * 300, *[(None, say(0, 80))] * 300, *[(i, say(900, 990 + i % 3)) for i in range(20, 60)]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "FILTERED", 3)
    monkeypatch.setattr(jaccard_join, "TOKENS", 400)
    monkeypatch.setattr(jaccard_join, "SIDE", 2)
    got = jaccard_components(df).collect()
    assert len(got) == len(rows) and {(r["doc_id"], r["component_id"]) for r in got} == {(1, 1), (5, 1), (7, 1), (9, 9), (None, None), *((i, 20) for i in range(20, 60))}


def test_bounds_of_similar_sets():
    for n in range(1, 120):
        for m in range(n, 160):
            least = needed(n, m)
            assert (100 * least >= 75 * (n + m - least)) and not (100 * (least - 1) >= 75 * (n + m - least + 1))
        assert prefix_length(n) == n - -(-3 * n // 4) + 1
    import pyarrow as pa

    rng = np.random.default_rng(1)
    texts = [" ".join(map(str, rng.integers(0, 40, k))) for k in (5, 30, 200, 900, 3000, 3)]
    (s, at), = shingle_sets(pa.array(texts))
    sigs = Signatures(signatures(s, at))
    for i in range(len(texts)):
        for j in range(len(texts)):
            apart = len(np.setxor1d(s[at[i] : at[i + 1]], s[at[j] : at[j + 1]]))
            assert sigs.differ(np.array([i]), np.array([j]))[0] <= apart
    assert len(set(zip(*map(np.ndarray.tolist, set_digests(s, at)), strict=True))) == len(texts)


@pytest.mark.parametrize("seed", range(6))
def test_stars_hold_pairs_that_fit_and_little_else(seed):
    """What a token's sets exchange: each pair that fits is in one star, a set that fits no other is in none."""
    rng = np.random.default_rng(seed)
    rows = np.empty(900, jaccard_join.ROW)
    rows["token"], rows["hi"] = np.sort(rng.integers(0, 300, 900)), rng.integers(0, 500, 900)
    rows["n"] = (rng.permutation(500) ** (1 + seed % 3) // 9 + 1)[rows["hi"]]
    rows["rest"] = rows["n"] - rng.integers(0, 1 << 30, 900) % prefix_length(rows["n"].astype(np.int64))
    blobs = [jaccard_join._packed(rows[k::3]) for k in range(3)]
    assert (np.concatenate([jaccard_join._unpacked(b) for b in blobs]) == np.concatenate([rows[k::3] for k in range(3)])).all()
    want, alone = set(), 0
    for token in range(300):
        some = np.unique(rows[rows["token"] == token])
        fit = {(i, j) for i in range(len(some)) for j in range(i) if jaccard_join._fits(some[[i]], some[[j]])[0]}
        want |= {(token, *sorted((some["hi"][i], some["hi"][j]))) for i, j in fit}
        alone += len(some) > 1 and not fit
    held, at = jaccard_join._groups(blobs)
    groups = [held[i:j] for i, j in zip(at[:-1], at[1:], strict=True)]
    got = {(g["token"][0], *sorted((x, y))) for g in groups for k, x in enumerate(g["hi"]) for y in g["hi"][:k]}
    assert alone and want <= got
    assert all(any(jaccard_join._fits(g[[i]], g[[j]])[0] for j in range(len(g)) if j != i) for g in groups for i in range(len(g)))
    stars = jaccard_join._stars(pd.DataFrame({"rows": blobs}))
    assert len(stars) <= len(held) - len(groups)


def test_sets_that_agree_in_half_of_their_digests(spark, monkeypatch):
    """Copies with another last word, which agree with their originals in size and in most places of their prefixes."""
    whole, rng = jaccard_join.set_digests, random.Random(4)
    monkeypatch.setattr(jaccard_join, "set_digests", lambda s, at: (np.diff(at).astype(np.int64), whole(s, at)[1]))
    rows = []
    for i in range(8):
        words = [f"w{rng.randrange(10**6)}" for _ in range(40 + i)]
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join([*words[:-1], "other"]))]
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute.jaccard(rows)


def test_prefixes_come_in_few_bytes_however_many_buckets():
    rng = random.Random(3)
    texts = [" ".join(rng.choices("abcdefghijkl", k=400)) for _ in range(400)]
    batches = [pa.RecordBatch.from_arrays([pa.array(texts[k : k + 100])], ["text"]) for k in range(0, 400, 100)]
    sent = [x for b in jaccard_join._prefixes(np.zeros(1 << jaccard_join.SLOT_BITS, np.uint8), 1000)(iter(batches)) for x in zip(*(c.to_pylist() for c in b.columns), strict=True)]
    assert len(sent) == len(dict(sent)) <= 1000
    sizes = [len(s) for s, _ in (next(shingle_sets(pa.array([x]))) for x in texts)]
    n = sum(prefix_length(x) for x in sizes)
    assert sum(len(x) for _, x in sent) == 20 * n
    assert len(pa.Codec("lz4").compress(b"".join(x for _, x in sent))) < 18 * n


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 440)]
    root = {x: x for e in links for x in e}
    for _ in range(500):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    for size in (1 << 14, 20):  # in one partition, and in rounds
        got = components(spark.createDataFrame(links, "a long, b long").repartition(7), size).collect()
        assert {r["node"]: r["root"] for r in got} == root and len(got) == len(root)
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


# 4 ---------------------------------------------------------------------------


@pytest.mark.parametrize("hot", [sd.HOT, 3, -1])
def test_suffix_dedup(docs, odd_docs, empty, rows, monkeypatch, hot):
    monkeypatch.setattr(sd, "HOT", hot)
    monkeypatch.setattr(sd, "BLOCK", 1 << 14)
    monkeypatch.setattr(sd, "PER_BUCKET", 1 << 13)
    monkeypatch.setattr(sd, "PIECE", 1 << 12)
    want = brute.suffix_dedup(pairs(rows))
    read = lambda df: {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup(df).collect() if r["doc_id"] is not None}
    assert read(docs) == want and any(w[1] for w in want.values())
    assert read(odd_docs) == want and suffix_dedup(odd_docs).count() == odd_docs.count()
    assert suffix_dedup(empty).count() == 0


def test_a_short_string_in_many_contexts(spark, monkeypatch):
    """What stands around it is spread over the buckets, and the result is that of brute force."""
    rng = random.Random(9)
    say = lambda k: "".join(rng.choices("abcdefghijklmnop ", k=k))
    rows = [(i, f"{say(rng.randint(0, 60))}-=-= the same words in each of them =-=-{say(rng.randint(0, 60))}") for i in range(600)]
    rows += [(1000 + i, rows[i * 7][1][5:] + say(9)) for i in range(60)]
    largest = {}
    for hot in (1 << 14, 50):
        monkeypatch.setattr(sd, "HOT", hot)
        frame = pd.DataFrame(rows, columns=["doc_id", "text"]).assign(block=0)
        told = pd.concat([sd._tell(f) for _, f in sd._ask(500)(frame).groupby("bucket")])
        sent = sd._send(500)(frame, told)
        largest[hot] = sent["strings"].str.len().max()
    assert largest[50] * 3 < largest[1 << 14]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], len(r["spans"]), r["kept_sha256"]) for r in suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = brute.suffix_dedup(rows)
    assert got == want and sum(w[1] for w in want.values()) > 2000
    # Short strings meet, but no string of 50 bytes is repeated.
    assert suffix_dedup(spark.createDataFrame(rows[:40], "doc_id long, text string")).agg(F.sum("n_removed")).first()[0] == sum(w[1] for w in brute.suffix_dedup(rows[:40]).values())


@pytest.mark.parametrize("seed", range(12))
def test_merged_transforms(seed):
    rng = random.Random(seed)
    pool = [bytes(rng.choice(b"ab c") for _ in range(120)) for _ in range(3)]
    strings = set()
    while len(strings) < rng.randint(2, 40):
        p, a = rng.choice(pool), rng.randint(0, 60)
        x = p[a : a + rng.randint(50, 90)]
        if rng.random() < 0.5:
            x = x[: len(x) // 2] + bytes([rng.choice(b"abcd")]) + x[len(x) // 2 :]
        if len(x) >= 50:
            strings.add(x)
    strings = sorted(strings, key=lambda _: rng.random())
    owner = np.array([rng.randint(0, 30) for _ in strings])
    least = {}
    for x, o in zip(strings, owner.tolist(), strict=True):
        for k in range(len(x) - 49):
            least[x[k : k + 50]] = min(least.get(x[k : k + 50], 99), o)
    want = [least.get(x[k : k + 50] if k + 50 <= len(x) else None, np.iinfo(np.int64).max) for x in strings for k in range(len(x))]
    data = np.frombuffer(b"".join(strings), np.uint8) + np.uint8(1)
    for shard in (60, 400, 1 << 20):
        assert sd.least_owner(data, np.array([len(x) for x in strings]), owner, shard).tolist() == want


def test_common_prefixes_of_a_merge():
    strings = [b"banana bandana", b"bandana banana", b"ananas and bananas"]
    data = [np.frombuffer(x, np.uint8) for x in strings]
    shards = [sd.Shard(d, np.array([len(d)]), i) for i, d in enumerate(data)]
    rows, shared = sd.merge(shards, 50)
    string, offset = (np.concatenate([getattr(s, a) for s in shards])[rows] for a in ("string", "offset"))
    suffixes = [strings[s][o:] for s, o in zip(string, offset, strict=True)]
    assert suffixes == sorted(suffixes)
    for a, b, n in zip(suffixes, suffixes[1:], shared[1:], strict=False):
        k = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
        assert n == k or n == 50 and a == b


# 5 ---------------------------------------------------------------------------


def test_fm_index():
    rng = np.random.default_rng(3)
    for size in (1, 5, 40, 300):
        s = np.append(rng.integers(1, 6, size), 0)
        assert [s[k:].tolist() for k in suffix_array(s)] == sorted(s[k:].tolist() for k in range(len(s)))
        tree = WaveletTree(s)
        c, i = rng.integers(0, 7, 50), rng.integers(0, len(s) + 1, 50)
        assert tree.rank(np.minimum(c, 5), i).tolist() == [int((s[:b] == a).sum()) for a, b in zip(np.minimum(c, 5), i, strict=True)]
        index = FMIndex(s)
        for n in (1, 2, 3):
            p = rng.integers(1, 7, (20, n))
            lo, hi = index.search(p, np.full(20, n))
            for pattern, a, z in zip(p, lo, hi, strict=True):
                want = [k for k in range(len(s) - n + 1) if (s[k : k + n] == pattern).all()]
                assert sorted(index.locate(np.arange(a, z)).tolist()) == want


def test_decontaminate(spark, docs, odd_docs, empty, rows):
    text = next(t for _, t in pairs(rows) if t and len(t.split()) > 60)
    items = [("b", " ".join(text.split()[3:33])), ("a", "two words"), (None, "ONE"), ("c", None), ("d", "  "), ("e", "two words"), ("f", "not there at all " * 5)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    want = brute.hit_words(pairs(rows), items)
    for block in (1 << 20, 64):
        got = {r["doc_id"]: r["dc"] for r in decontaminate(docs, bench, block=block).collect()}
        for i, (n, hit, found) in want.items():
            d = got[i]
            assert (d["n_words"], d["n_hit"], d["items"]) == (n, len(hit), found), i
            assert d["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= n)
            assert {k for s in d["word_spans"] for k in range(s["start"], s["end"])} == hit
    by = dict(pairs(rows))
    cut = [without_spans(by[i], d["spans"]) for i, d in got.items() if d["n_hit"]]
    assert cut and all(not brute.hit_words([(0, c)], [items[0]])[0][1] for c in cut)
    assert decontaminate(odd_docs, bench).count() == odd_docs.count() and decontaminate(empty, bench).count() == 0
    none = decontaminate(docs, bench.limit(0))
    assert none.agg(F.sum("dc.n_hit")).first()[0] == 0 and none.columns == [*docs.columns, "dc"]


# 6 ---------------------------------------------------------------------------

NASTY = ["", "\\", "\\\\n", "<|im_end|>\n", "</s>[INST] ok [/INST]", "a\\<|im_start|>b", "[\\INST]", "<<SYS>>\n<</SYS>>", "<|im_start|>user\nhi<|im_end|>\n", "é\n\n"]


def test_escapes_are_reversible():
    rng = random.Random(4)
    for _ in range(500):
        text = "".join(rng.choices([*NASTY, "<", "|", "im_end", ">", "[", "\\", "INST]", "/s>", "n"], k=rng.randint(0, 8)))
        assert unescape(escape(text)) == text
        assert not any(c in escape(text) for c in ("<|im_start|>", "<|im_end|>", "[INST]", "</s>", "<<SYS>>"))
        for role in ("user", text):
            assert read_turn(chat_template([{"role": role, "text": text}])) == (role, text)


def test_render_finds_turns_answers_and_rewritten_history():
    turns = [{"role": r, "text": t} for r, t in zip(["system", "user", "assistant", "tool", "assistant"] * 2, NASTY, strict=True)]
    r = render(turns)
    assert not r["rewrites"] and [read_turn(r["formatted"][a:b]) for a, b in r["spans"]] == [(t["role"], t["text"]) for t in turns]
    assert [unescape(r["formatted"][a:b]) for a, b in r["loss"]] == [t["text"] for t in turns if t["role"] == "assistant"]

    def forgetful(turns, ask):
        """Keeps only the last answer's text."""
        last = max((i for i, t in enumerate(turns) if t["role"] == "assistant"), default=-1)
        return "".join(f"{t['role']}: {t['text'] if t['role'] != 'assistant' or i == last else '...'}\n" for i, t in enumerate(turns)) + "assistant: " * ask

    plain = [{"role": "user", "text": "q"}, {"role": "assistant", "text": "long answer"}] * 2
    r = render(plain, forgetful)
    assert r["rewrites"] and r["formatted"][slice(*r["loss"][-1])] == "long answer"


def test_format_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (2, 0, None, None), (2, 0, None, None), (None, 5, "user", "x"), (3, None, "user", "late"), (3, None, "system", "early")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1))
    got = {r["conv_id"]: r for r in format_chats(df).collect()}
    turns = {k: [read_turn(r["formatted"][s["start"] : s["end"]]) for s in r["spans"]] for k, r in got.items()}
    assert turns == {1: [("user", "a"), ("assistant", "b")], 2: [("", "")] * 2, None: [("user", "x")], 3: [("system", "early"), ("user", "late")]}
    assert format_chats(df.limit(0)).count() == 0


# 7 ---------------------------------------------------------------------------


def test_line_dedup(docs, odd_docs, empty, rows):
    want = brute.line_dedup(pairs(rows))
    for df in (docs, odd_docs):
        out = line_dedup(df)
        assert out.count() == df.count() and set(df.columns) <= set(out.columns)
        assert {r["doc_id"]: r["text"] for r in out.collect() if r["doc_id"] is not None} == want
    assert any(want[i] != (t or "") for i, t in pairs(rows)) and line_dedup(empty).count() == 0


# 8 ---------------------------------------------------------------------------


def test_html_blocks():
    html = "<p>a &amp; b<b>c</b>\n d<br>e<script>var x='</p>';</script><!-- <p>no</p> --><ul><li>one<li>two</ul>tail<style>p{}</style>&copy &am"
    assert [b[0] for b in leaf_blocks(html)] == ["a & bc d", "e", "one", "two", "tail© &am"]
    assert leaf_blocks("") == [] and leaf_blocks("<p>x<foo bar=\"") == [("x", frozenset({"<p>"}), 0, 1)]
    assert [b[0] for b in leaf_blocks("<div>" * 3000 + "deep" + "<" * 50 + "</p>" * 9)][0].startswith("deep")


def test_gold_pages():
    """Hand-labelled pages of layouts that training doesn't know: 22 of 24 are right to the letter."""
    field = trained()
    wrong = [html for html, want in GOLD if main_text(html, field) != want]
    assert len(wrong) <= 2
    for odd in ("<svg/>", "<svg><path/></svg>", "<p hidden>no</p>", "<p style='display:none'>no</p>"):
        assert P1 in main_text(f"<body><article>{odd}<p>{P1}</p></article>", field) and "no" not in [b[0] for b in leaf_blocks(odd)]


def test_blocks_and_labels_by_brute_force(spark):
    field, n = trained(), 0
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        blocks = leaf_blocks(r["html"])
        assert [b[0] for b in blocks] == brute.shown_blocks(r["html"], UNSEEN, INLINE)
        for k in range(0, len(blocks), 9):
            f = features(blocks)[k : k + 9]
            assert field.decode(f) == brute.likeliest(field.scores(f).tolist(), field.move.tolist())
            n += 1
    assert n > 100


def test_held_out_accuracy():
    field, rng = trained(), random.Random(77)
    right = total = 0
    for _ in range(200):
        html, labels = labelled_page(rng)
        blocks = leaf_blocks(html)
        assert len(blocks) == len(labels)
        right += sum(a == b for a, b in zip(field.decode(features(blocks)), labels, strict=True))
        total += len(labels)
    assert right / total > 0.97


def test_extract(spark):
    page = "<html><head><title>t</title></head><body><nav><a href=#>Home</a></nav><article><h1>Title &amp; more</h1><p>First  part\nof it.</p><p>Second part, longer.</article><div class=comments><p>I disagree.</p></div><footer>&copy; x</footer>"
    df = spark.createDataFrame([(1, "u", page), (1, "u", page), (2, None, None), (3, "v", ""), (4, "w", "x" * 200_000)], "page_id long, url string, html string").withColumn("main_text", F.lit("mine"))
    got = [(r["page_id"], r["_main_text"]) for r in extract(df).orderBy("page_id").collect()]
    assert got[0] == got[1] == (1, "Title & more First part of it. Second part, longer.") and got[2] == (2, "") and got[3] == (3, "")
    assert extract(df.limit(0)).count() == 0 and main_text(None, trained()) == ""


# 9 ---------------------------------------------------------------------------


def test_quality_rules(docs, odd_docs, empty, rows):
    got = {r["doc_id"]: r for r in quality_rules(docs).collect()}
    for i, t in pairs(rows):
        w, lines, r = brute.words(t), [x for x in (t or "").split("\n") if brute.words(x)], got[i]
        n = brute.repeated_words(w)
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t or ""), len(lines) - len(set(lines)), n, len(w) < 10 or 100 * n > 20 * len(w))
        assert tuple(r[f"q_{c}"] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == want
        assert not (r["q_kept"] and r["q_base_failed"])
    assert quality_rules(docs).where("q_kept").count() == sum(r["q_kept"] for r in got.values())
    plan = quality_rules(docs)._jdf.queryExecution().optimizedPlan().toString()
    assert "Python" not in plan and "_q_kept" in quality_rules(odd_docs).columns and quality_rules(empty).count() == 0


# 10 --------------------------------------------------------------------------


def test_mixing(spark, docs, odd_docs, empty, rows):
    sizes = Counter()
    for _, t, _, s, _ in rows:
        sizes[s] += len(brute.words(t))
    want = brute.targets(sizes)
    out = mix_sources(docs)
    for r in out.collect():
        assert r["mix_source_size"] == sizes[r["source"]] and abs(r["mix_target"] - want[r["source"]]) < 1e-6
        assert 0 <= r["mix_copies"] <= 3 and r["mix_size"] == len(brute.words(r["text"]))
        assert abs(r["mix_copies"] - r["mix_target"] / max(1, r["mix_source_size"])) < 1
    again = mix_sources(docs.repartition(5))
    assert sorted(map(tuple, out.select("doc_id", "mix_copies").collect())) == sorted(map(tuple, again.select("doc_id", "mix_copies").collect()))
    assert emit_copies(out).count() == out.agg(F.sum("mix_copies")).first()[0]
    assert mix_sources(odd_docs).count() == odd_docs.count() and "_mix_copies" in mix_sources(odd_docs).columns
    assert mix_sources(empty).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {r["mix_copies"] for r in mix_sources(blank).collect()} == {0}


def test_mixes_come_near_their_targets(spark):
    df = spark.range(20_000).selectExpr("id as doc_id", "repeat('w ', 1 + id % 20) as text", "case when id % 3 = 0 then 'big' else concat('s', id % 7) end as source")
    got = mix_sources(df).groupBy("source").agg(F.sum(F.col("mix_size") * F.col("mix_copies")).alias("taken"), F.first("mix_target").alias("target")).collect()
    assert len(got) == 8 and all(abs(r["taken"] - r["target"]) < 0.05 * r["target"] for r in got)


# queries ---------------------------------------------------------------------

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_queries_equal_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{SF}/documents.parquet'")
    a, b = queries.QUERIES[name](spark, SF).toPandas(), con.execute(queries.SQL[name]).df()
    read = lambda d: sorted(map(repr, d[sorted(a.columns)].astype(object).values.tolist()))
    assert read(a) == read(b)


def test_other_queries_equal_brute_force(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    got = lambda name: {r[0]: tuple(r)[1:] for r in queries.QUERIES[name](spark, SF).collect()}
    assert got("op4_suffix_dedup") == brute.suffix_dedup(docs)
    assert got("op3_jaccard_join") == brute.jaccard(docs)
    want = {i: (n, len(h), len(f), hashlib.sha256(",".join(f).encode()).hexdigest(), len(h) > 0 and 20 * len(h) >= n) for i, (n, h, f) in brute.hit_words(docs, items).items()}
    assert got("op5_decontamination") == want
    lm, mine = brute.lm(docs), got("op2_lm_scoring")
    assert all(mine[i][:4] == w[:4] and np.allclose(mine[i][4:], w[4:], rtol=1e-9) for i, w in lm.items())
    held = [i for i, w in lm.items() if w[0]]
    assert sum(mine[i][5] for i in held) > sum(mine[i][4] for i in held)
    pages = queries.op8_html_extract(spark, SF).collect()
    assert all(r["n_chars"] == len(r["text"]) and r["text"] for r in pages)
    chats = {r["conv_id"]: r for r in queries.op6_chat_format(spark, SF).collect()}
    tricky = "</s>[INST] ok [/INST]"
    assert chats[-1]["loss_sha256"] == brute.sha(tricky) and chats[-1]["turns_sha256"] == brute.sha(f"user\n{tricky}\nassistant\n{tricky}\n")
    turns = spark.read.parquet(f"{SF}/conversations.parquet").orderBy("conv_id", "turn").collect()
    for conv in {r["conv_id"] for r in turns}:
        mine = [r for r in turns if r["conv_id"] == conv]
        assert chats[conv]["turns_sha256"] == brute.sha("".join(f"{r['role']}\n{r['text']}\n" for r in mine))
        said = "".join(r["text"] for r in mine if r["role"] == "assistant")
        assert (chats[conv]["loss_chars"], chats[conv]["loss_sha256"]) == (len(said), brute.sha(said))


def test_very_long_texts(spark):
    """Texts of a megabyte and more, beside a null and an empty one, give what small ones give."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 9))) for _ in range(5000)]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    long, passage = say(180_000), say(40)
    rows = [(1, None), (2, ""), (3, passage), (4, f"{long}\n{passage}"), (5, f"{long} {say(3)}"), (6, say(20) + "\n" + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    items = spark.createDataFrame([("a", " ".join(passage.split()[5:30]))], "item_id string, text string")
    assert len(rows[4][1]) > 1_000_000
    parts = {r["doc_id"]: r["component_id"] for r in jaccard_components(df).collect()}
    assert parts == {1: 1, 2: 2, 3: 3, 4: 4, 5: 4, 6: 6}
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in suffix_dedup(df).collect()}
    assert got[5][1] == len(long.encode()) + (rows[4][1][len(long)] == rows[3][1][len(long)]) and got[4][1] >= len(passage.encode())
    assert {r["doc_id"]: r["dc"]["n_hit"] for r in decontaminate(df, items).collect()} == {1: 0, 2: 0, 3: 25, 4: 25, 5: 0, 6: 25}
    kept = {r["doc_id"]: r["text"] for r in line_dedup(df, min_docs=3).collect()}
    assert kept[4] == long and kept[6] == rows[5][1] and kept[1] == ""
    scores = {r["doc_id"]: r for r in lm_score(df).collect()}
    assert scores[4]["lm_n_tokens"] == 180_041 and scores[1]["lm_n_tokens"] == 1 and scores[4]["lm_score"] < scores[3]["lm_score"] < 0
    assert {r["doc_id"]: r["q_n_words"] for r in quality_rules(df).collect()} == {1: 0, 2: 0, 3: 40, 4: 180_040, 5: 180_003, 6: 60}
    assert sum(r["mix_size"] * r["mix_copies"] for r in mix_sources(df).collect()) > 0
    assert main_text(f"<article><p>{long}</p></article>", trained()) == long
    talk = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    assert [x["end"] - x["start"] for x in format_chats(talk).first()["loss"]] == [len(long)]


def test_hot_ids(spark):
    """A third of all rows without an id, and a third with the same one, each with texts of their own."""
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"text number {i} " + "word " * (i % 9) + f"of {i % 50}\nshared line that is long enough to be seen by all of them") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("source", F.lit("s"))
    assert suffix_dedup(df).where("doc_id is null").agg(F.sum("n_removed")).first()[0] == 0
    assert lm_score(df, block=1 << 14).where("doc_id is null").count() == 100
    left = line_dedup(df).where("text not like '%shared line%'").count()
    assert 100 < left < 200
    assert substring_dedup(df).count() == 300 and mix_sources(df).count() == 300
