"""Benchmark decontamination with an FM-index per training shard."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType, _parse_datatype_string

from termloom.llm.common import ALNUM, chunks, flat, free_name, small_batches, stable, word_hashes, words

#: Words in a window of an item.
WINDOW = 13
#: Bytes of text in a shard; a longer document is a shard of its own.
SHARD = 4 << 20
#: Bytes of benchmark text that one pass holds in every task, compiled to about three times as many; a larger benchmark
#: takes several passes.
BLOCK = 8 << 20
#: Windows that are searched at a time.
SEARCHED = 1 << 16
#: Every so many text positions the index keeps the suffix's position.
SAMPLE = 8


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Suffix array of a sequence whose last symbol is its smallest and unique one, by prefix doubling."""
    n = len(s)
    _, rank = np.unique(s, return_inverse=True)
    rank, k, sa = rank.astype(np.int64), 1, None
    while True:
        after = np.zeros(n, np.int64)
        after[: n - k] = rank[k:] + 1
        key = rank * (n + 1) + after
        sa = np.argsort(key, kind="stable")
        sorted_key = key[sa]
        new = np.zeros(n, np.int64)
        new[1:] = np.cumsum(sorted_key[1:] != sorted_key[:-1])
        rank = np.empty(n, np.int64)
        rank[sa] = new
        k *= 2
        if new[-1] == n - 1 or k >= n:
            return sa


class WaveletTree:
    """Ranks of symbols in a sequence, one bit of the symbols a level (the layout of Claude, Navarro and Ordóñez, 2015)."""

    def __init__(self, s: np.ndarray):
        self.bits = max(1, int(s.max()).bit_length()) if len(s) else 1
        self.zeros, self.levels = [], []
        for b in range(self.bits - 1, -1, -1):
            bit = (s >> b) & 1
            before = np.zeros(len(s) + 1, np.int64)
            np.cumsum(bit == 0, out=before[1:])
            self.levels.append(before)
            self.zeros.append(int(before[-1]))
            s = np.concatenate([s[bit == 0], s[bit == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """How often c[k] occurs before i[k], for all k at once."""
        lo = np.zeros_like(i)
        for level, (before, zeros) in enumerate(zip(self.levels, self.zeros, strict=True)):
            one = (c >> (self.bits - 1 - level)) & 1 == 1
            a, z = before[lo], before[i]
            lo, i = np.where(one, zeros + lo - a, a), np.where(one, zeros + i - z, z)
        return i - lo


class FMIndex:
    """Counts and finds patterns in a sequence of symbols that ends with a unique 0."""

    def __init__(self, s: np.ndarray):
        sa = suffix_array(s)
        self.bwt = s[sa - 1]
        self.tree = WaveletTree(self.bwt)
        self.first = np.zeros(int(s.max()) + 2, np.int64)
        np.cumsum(np.bincount(s, minlength=len(self.first) - 1), out=self.first[1:])
        kept = sa % SAMPLE == 0
        self.sampled = np.flatnonzero(kept)
        self.position = sa[kept]

    def step(self, row: np.ndarray) -> np.ndarray:
        c = self.bwt[row]
        return self.first[c] + self.tree.rank(c, row)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Backward search of all rows of `patterns`, padded at the left; gives each one's range of suffixes."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        for k in range(patterns.shape[1]):
            c = patterns[:, -1 - k]
            on = np.flatnonzero((k < lengths) & (lo < hi))
            c_on = c[on]
            known = c_on < len(self.first) - 1
            hi[on[~known]] = lo[on[~known]]
            on, c_on = on[known], c_on[known]
            lo[on] = self.first[c_on] + self.tree.rank(c_on, lo[on])
            hi[on] = self.first[c_on] + self.tree.rank(c_on, hi[on])
        return lo, np.maximum(lo, hi)

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffixes: walk back to the nearest one whose position is kept."""
        out, steps, at = np.empty(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy()
        left = np.arange(len(rows))
        while len(left):
            k = np.minimum(np.searchsorted(self.sampled, at[left]), len(self.sampled) - 1)
            there = self.sampled[k] == at[left]
            out[left[there]] = self.position[k[there]] + steps[left[there]]
            left = left[~there]
            at[left] = self.step(at[left])
            steps[left] += 1
        return out


@dataclass
class Phrases:
    """The windows of benchmark items as symbols (2 and up; 0 ends a shard, 1 stands between stretches): where each
    distinct one begins in the items' symbols, its length, and its items, some twenty bytes a word in all."""

    vocabulary: np.ndarray
    symbols: np.ndarray
    starts: np.ndarray
    lengths: np.ndarray
    owner_at: np.ndarray
    owners: np.ndarray
    items: list[str]

    def padded(self, i: int, j: int) -> np.ndarray:
        """Windows i to j as rows that end together, zeros in front."""
        width = int(self.lengths[i:j].max(initial=1))
        back = np.arange(width - 1, -1, -1)[None]
        at = (self.starts[i:j] + self.lengths[i:j] - 1)[:, None] - back
        return np.where(back < self.lengths[i:j, None], self.symbols[np.maximum(at, 0)], 0).astype(np.int64)


def compile_phrases(ids: list, texts: list, window: int = WINDOW) -> Phrases:
    b, offs = flat(pa.array(texts, pa.large_string()))
    starts, ends, at = words(b, offs, ALNUM)
    vocabulary, symbol = np.unique(word_hashes(b, starts, ends), return_inverse=True)
    symbol, n = (symbol + 2).astype(np.int32), np.diff(at)
    many = np.where(n > 0, np.maximum(n - window + 1, 1), 0)
    item = np.repeat(np.arange(len(n)), many)
    start = at[item] + np.arange(len(item)) - np.repeat(np.cumsum(many) - many, many)
    every = Phrases(vocabulary, symbol, start, np.minimum(n[item], window), item[:0], item[:0], [str(x) for x in ids])
    if len(start):  # equal windows are one, by their symbols
        rows = np.ascontiguousarray(every.padded(0, len(start)).astype(np.int32))
        _, first, of = np.unique(rows.view(f"V{rows.shape[1] * 4}").ravel(), return_index=True, return_inverse=True)
        pairs = np.unique(np.stack([of, item], 1), axis=0)
        every.starts, every.lengths, every.owners = start[first].astype(np.int32), every.lengths[first].astype(np.int32), pairs[:, 1].astype(np.int32)
        every.owner_at = np.searchsorted(pairs[:, 0], np.arange(len(first) + 1)).astype(np.int32)
    return every


def hits(p: Phrases, symbols: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Occurrences (first word, window) in a shard of words. Only stretches of the items' own words, long enough for
    the shortest window, can hold one; they alone are indexed."""
    none = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if not len(p.lengths) or not len(symbols):
        return none
    known = symbols > 1
    edge = np.zeros(len(symbols) + 1, bool)
    edge[at] = True
    edge[0] = edge[-1] = True
    edge[1:-1] |= known[1:] != known[:-1]
    cuts = np.flatnonzero(edge)
    keep = known[cuts[:-1]] & (np.diff(cuts) >= p.lengths.min())
    begin, length = cuts[:-1][keep], np.diff(cuts)[keep]
    if not len(begin):
        return none
    total = int((length + 1).sum())
    to = np.cumsum(length + 1) - (length + 1)
    word = np.repeat(begin - to, length + 1) + np.arange(total)  # where each symbol of the indexed text comes from
    text = symbols[np.minimum(word, len(symbols) - 1)].copy()
    text[to + length] = 1
    index = FMIndex(np.append(text, 0))
    places, windows = [], []
    for i in range(0, len(p.starts), SEARCHED):
        lengths = p.lengths[i : i + SEARCHED].astype(np.int64)
        lo, hi = index.search(p.padded(i, i + SEARCHED), lengths)
        n = hi - lo
        windows.append(np.repeat(np.arange(i, i + len(n)), n))
        places.append(np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum())))
    return word[index.locate(np.concatenate(places))], np.concatenate(windows)


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def examine(p: Phrases, texts: pa.Array, before: list | None = None) -> list[dict]:
    """For each text its words, hit words, items, and the merged spans; `before` has what earlier passes found."""
    b_all, offs_all = flat(texts)
    out = []
    for i, j in chunks(offs_all, SHARD):
        b, offs = b_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
        starts, ends, at = words(b, offs, ALNUM)
        h = word_hashes(b, starts, ends)
        k = np.minimum(np.searchsorted(p.vocabulary, h), max(0, len(p.vocabulary) - 1))
        symbols = np.where(p.vocabulary[k] == h, k + 2, 1) if len(p.vocabulary) else np.ones(len(h), np.int64)
        word, window = hits(p, symbols, at)
        doc = np.searchsorted(at, word, "right") - 1
        order = np.lexsort((word, doc))
        word, window, doc = word[order], window[order], doc[order]
        cut = np.searchsorted(doc, np.arange(j - i + 1))
        for d in range(j - i):
            old = before[i + d] if before else None
            mine = slice(cut[d], cut[d + 1])
            spans = [(s["start"], s["end"]) for s in old["word_spans"]] if old else []
            found = set(old["items"]) if old else set()
            if cut[d] < cut[d + 1]:
                w, x = word[mine] - at[d], window[mine]
                spans += zip(w.tolist(), (w + p.lengths[x]).tolist(), strict=True)
                found |= {p.items[o] for u in np.unique(x) for o in p.owners[p.owner_at[u] : p.owner_at[u + 1]]}
            spans = _merged(spans)
            n, hit = int(at[d + 1] - at[d]), sum(y - x for x, y in spans)
            chars = []
            if spans:
                code_points = np.zeros(int(offs[d + 1] - offs[d]) + 1, np.int64)
                np.cumsum((b[offs[d] : offs[d + 1]] & 0xC0) != 0x80, out=code_points[1:])
                chars = [(int(code_points[starts[at[d] + x] - offs[d]]), int(code_points[ends[at[d] + y - 1] - offs[d]])) for x, y in spans]
            out.append({
                "n_words": n, "n_hit": hit, "items": sorted(found), "contaminated": hit > 0 and 20 * hit >= n,
                "word_spans": [{"start": x, "end": y} for x, y in spans], "spans": [{"start": x, "end": y} for x, y in chars],
            })
    return out


RESULT = pa.struct([
    ("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())), ("contaminated", pa.bool_()),
    ("word_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
])
RESULT_DDL = "struct<n_words:long,n_hit:long,items:array<string>,contaminated:boolean,word_spans:array<struct<start:long,end:long>>,spans:array<struct<start:long,end:long>>>"


def _pass(text: str, out: str, p: Phrases):
    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            before = batch.column(out).to_pylist() if out in batch.schema.names else None
            for i in range(0, batch.num_rows, 2000):
                part = batch.slice(i, 2000)
                found = pa.array(examine(p, part.column(text), before and before[i : i + 2000]), RESULT)
                names = [c for c in part.schema.names if c != out]
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in names), found], [*names, out])

    return over


def decontaminate(docs: DataFrame, items: DataFrame, text="text", item_id="item_id", item_text="text", window: int = WINDOW, block: int = BLOCK) -> DataFrame:
    """`docs` with a struct `dc`: n_words, n_hit, items (ids whose windows occur, sorted as strings), contaminated (at
    least one hit, and 20 * n_hit >= n_words), and the merged hit spans in words and in code points of the text.

    Each task cuts its rows into shards, builds an FM-index over each one's words (told apart by 64-bit hashes), and
    searches all windows in it. Texts are never shuffled. The windows travel with the plan; their size is counted
    first, and beyond `block` bytes of items the texts are passed over once for each block, and set down in between, so
    that a task holds one block at a time.

    An item of fewer words than a window is one window; an item, or a text, that is null or has no words hits nothing;
    repeated items count once; an item without an id is called None. Rows that repeat, and rows without an id, are judged
    by their text like all others; ties can't be. No rows give no rows; no items hit nothing. A text longer than a shard
    is a shard of its own. Other columns pass through; where one is called `dc`, the struct is `_dc`.
    """
    out = free_name(small_batches(docs), "dc")
    size = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n = max(1, math.ceil(size / block))
    for k in range(n):
        part = items.where(F.pmod(F.xxhash64(item_id, item_text), F.lit(n)) == k) if n > 1 else items
        rows = part.select(F.col(item_id).cast("string"), item_text).collect()
        phrases = compile_phrases([r[0] for r in rows], [r[1] for r in rows], window)
        if k == 0:
            target = StructType([*docs.schema.fields, StructField(out, _parse_datatype_string(RESULT_DDL))])
        docs = docs.mapInArrow(_pass(text, out, phrases), target)
        docs = stable(docs) if k < n - 1 else docs
    return docs


def without_spans(text: str | None, spans) -> str | None:
    """A text without the spans that were found in it."""
    if text is None or not len(spans):
        return text
    kept, at = [], 0
    for s in spans:
        kept.append(text[at : s["start"]])
        at = s["end"]
    return "".join([*kept, text[at:]])


def items_digest(ids) -> str:
    return hashlib.sha256(",".join(ids).encode()).hexdigest()
