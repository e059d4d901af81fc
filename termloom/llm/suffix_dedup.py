"""Removal of repeated byte strings by merging the Burrows-Wheeler transforms of shards."""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import K_INV, chunks, flat, mix, pack, powers, prefix_hash, small_batches, unpack

#: Length of a repeated string, and of the short strings whose least hash in it says where it is looked for.
LENGTH, GRAM = 50, 20
#: Bytes of text in a block and in a piece of it, bytes of text per bucket, and bytes of strings in a shard of a bucket.
BLOCK, PIECE, PER_BUCKET, SHARD = 8 << 20, 1 << 20, 3 << 20, 1 << 19
#: Stretches around one short string beyond which each of their starts goes to a bucket of its own bytes.
HOT = 1 << 14


# ---------------------------------------------------------------- transforms of shards, and their merge


class Shard:
    """Suffixes of a set of strings in the order of their first 64 bytes: for each, in that order, its string, its
    offset, what is left of it, its first eight bytes, the byte before it (the transform; 0 at a string's start), and
    the place of the suffix one byte longer (-1 at a string's start)."""

    def __init__(self, data: np.ndarray, lengths: np.ndarray, first: int):
        n = len(data)
        lengths = lengths.astype(np.int32)
        start = np.cumsum(lengths, dtype=np.int32) - lengths
        string = np.repeat(np.arange(len(lengths), dtype=np.int32), lengths)
        offset = np.arange(n, dtype=np.int32) - start[string]
        left = lengths[string] - offset
        padded = np.concatenate([data, np.zeros(64, np.uint8)])
        key = np.ndarray(n, ">u8", padded, strides=(1,)).astype(np.uint64)  # eight bytes from each place on
        short = np.flatnonzero(left < 8)
        key[short] &= ~((np.uint64(1) << (np.uint64(8) * (8 - left[short]).astype(np.uint64))) - np.uint64(1))
        order = np.argsort(key).astype(np.int32)
        key = key[order]
        new = np.append(True, key[1:] != key[:-1])
        rank = np.empty(n, np.int32)
        rank[order] = np.maximum.accumulate(np.where(new, np.arange(n, dtype=np.int32), 0))
        for k in (8, 16, 32):
            at = np.flatnonzero(~new | ~np.append(new[1:], True))
            if not len(at):
                break
            tied = order[at]
            after = np.where(left[tied] > k, rank[np.minimum(tied + k, n - 1)] + 1, 0)
            code = (rank[tied].astype(np.int64) << 32) | after
            o = np.argsort(code)
            tied, code = tied[o], code[o]
            order[at] = tied
            new[at[1:]] |= code[1:] != code[:-1]
            rank[tied] = np.maximum.accumulate(np.where(new[at], at, 0))
        place = np.empty(n, np.int32)
        place[order] = np.arange(n, dtype=np.int32)
        self.string, self.offset, self.left, self.key = string[order] + np.int32(first), offset[order], left[order], key
        inside = self.offset > 0
        self.bwt = np.where(inside, padded[order - 1], 0)
        # The suffix that starts one byte before a row's own.
        self.longer = np.where(inside, place[order - 1], -1)


def interleave(lists: list[np.ndarray]) -> np.ndarray:
    """The merge of sorted lists laid end to end: their places in order, of equal entries the earlier list's first. Two
    neighbouring lists at a time tell each other where their entries fall, so nothing is sorted."""
    at = np.cumsum([0, *map(len, lists)])
    runs = [(x, np.arange(a, a + len(x), dtype=np.int32)) for x, a in zip(lists, at, strict=False)]
    while len(runs) > 1:
        merged = []
        for (x, i), (y, j) in zip(runs[::2], runs[1::2], strict=False):
            key, rows = np.empty(len(x) + len(y), x.dtype), np.empty(len(x) + len(y), np.int32)
            for k, r, to in ((x, i, np.searchsorted(y, x, "left") + np.arange(len(x))), (y, j, np.searchsorted(x, y, "right") + np.arange(len(y)))):
                key[to], rows[to] = k, r
            merged.append((key, rows))
        runs = merged + runs[len(runs) & ~1 :]
    return runs[0][1] if runs else np.zeros(0, np.int32)


def merge(shards: list[Shard], depth: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """Interleaves the shards' suffixes: their rows in the order of the first `depth` bytes, and for each the number of
    bytes that it shares with the one before (at least `depth` where they share so many).

    The interleave starts where the shards' sorted lists of leading eight bytes fall into each other and is refined a
    byte at a time, as in Holt and McMillan (2014): the order of suffixes after d bytes, read through the transforms, gives the order of the
    suffixes one byte longer after d+1. A group of suffixes with the same d bytes needs work only when the group that
    its members' tails are in was split in the round before, so each round passes over such groups alone; the round in
    which two neighbours part is the length of their common prefix.
    """
    base = np.cumsum([0, *(len(s.key) for s in shards)])
    key = np.concatenate([s.key for s in shards])
    bwt = np.concatenate([s.bwt for s in shards])
    longer = np.concatenate([np.where(s.longer >= 0, s.longer + np.int32(b), -1) for s, b in zip(shards, base, strict=False)])
    n = len(key)
    rows = interleave([s.key for s in shards])
    place = np.empty(n, np.int32)
    place[rows] = np.arange(n, dtype=np.int32)
    key = key[rows]
    differ = key[1:] ^ key[:-1]
    top = np.frexp((differ & ~(differ >> np.uint64(1))).astype(np.float64))[1]  # the place of the highest bit
    shared = np.full(n, depth, np.int16)
    shared[:1] = 0
    shared[1:] = np.where(differ == 0, depth, 8 - (top + 7) // 8)
    # Groups that share seven bytes, and within them those that share eight.
    active = rows
    group = np.cumsum(shared < 7, dtype=np.int32)
    part = np.cumsum(shared < 8, dtype=np.int32)
    many = np.flatnonzero(np.append(part[1:] != part[:-1], False) & np.append(group[1:] == group[:-1], False))
    split = np.zeros(int(group[-1]) + 2 if n else 1, bool)
    split[group[many]] = True
    on = split[group] if n else np.zeros(0, bool)
    active, group, part = active[on], group[on], part[on]
    d = 8
    while len(active) and d < depth:
        inside = longer[active] >= 0
        active, group, part = active[inside], group[inside], part[inside]
        by = np.argsort(bwt[active], kind="stable")
        c, group, part = bwt[active][by], group[by], part[by]
        child = longer[active[by]]
        to = np.sort(place[child])
        place[child] = to
        rows[to] = child
        fresh = np.append(True, (c[1:] != c[:-1]) | (group[1:] != group[:-1]))[: len(c)]
        parted = ~fresh & np.append(True, part[1:] != part[:-1])[: len(c)]
        shared[to[parted]] = np.minimum(shared[to[parted]], d)
        group = np.cumsum(fresh, dtype=np.int32)
        part = np.cumsum(fresh | parted, dtype=np.int32)
        split = np.zeros(int(group[-1]) + 1 if len(group) else 1, bool)
        split[group[parted]] = True
        on = split[group]
        active, group, part = child[on], group[on], part[on]
        d += 1
    return rows, shared


def least_owner(data: np.ndarray, lengths: np.ndarray, owner: np.ndarray, shard: int = SHARD) -> np.ndarray:
    """For each byte of distinct strings laid end to end the least owner of any string that holds the `LENGTH` bytes
    that begin there (the largest integer where fewer are left)."""
    ends = np.cumsum(lengths)
    shards, i = [], 0
    while i < len(lengths):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + shard, "right")))
        a = ends[i - 1] if i else 0
        shards.append(Shard(data[a : ends[j - 1]], lengths[i:j], i))
        i = j
    rows, shared = merge(shards)
    string = np.concatenate([s.string for s in shards])[rows]
    offset = np.concatenate([s.offset for s in shards])[rows]
    whole = np.concatenate([s.left for s in shards])[rows] >= LENGTH
    begins = np.flatnonzero(shared < LENGTH)
    who = np.where(whole, owner[string], np.iinfo(np.int64).max)
    least = np.minimum.reduceat(who, begins)
    out = np.empty(len(data), np.int64)
    out[(ends - lengths)[string] + offset] = np.where(whole, np.repeat(least, np.diff(np.append(begins, len(rows)))), np.iinfo(np.int64).max)
    return out


# ---------------------------------------------------------------- where equal strings can meet


def pieces_of(offs: np.ndarray):
    """Pieces of some texts, or of a part of a longer one: the first text, the bytes' range, where texts begin in it, and
    how far into its text it begins. Parts overlap, so that each start of `LENGTH` bytes is in one."""
    for i, j in chunks(offs, PIECE):
        a, z = int(offs[i]), int(offs[j])
        if j > i + 1 or z - a <= PIECE:
            yield i, a, z, offs[i : j + 1] - a, 0
        else:
            for shift in range(0, z - a - LENGTH + 1, PIECE):
                end = min(z, a + shift + PIECE + LENGTH - 1)
                yield i, a + shift, end, np.array([0, end - a - shift]), shift


def stretches(texts: pa.Array):
    """Cuts each text's possible starts of `LENGTH` bytes into stretches that have the same short string of least hash
    inside. Equal `LENGTH` bytes have the same one, wherever they are. Yields per piece its bytes (0 is kept free), the
    stretches' texts, first starts and ends (the bytes that their starts reach), and the short strings' hashes."""
    b_all, offs_all = flat(texts)
    width = LENGTH - GRAM + 1
    for i, from_, to, offs, shift in pieces_of(offs_all):
        b = b_all[from_:to]
        if len(b) < LENGTH:
            continue
        sums, inverse = prefix_hash(b), powers(K_INV, len(b) + 1)
        h = (sums[GRAM:] - sums[:-GRAM]) * inverse[: len(b) - GRAM + 1]
        low = np.uint64((1 << max(22, int(len(b)).bit_length())) - 1)
        x = (h & ~low) | np.arange(len(h), dtype=np.uint64)
        have = 1
        while have * 2 <= width:
            x = np.minimum(x[:-have], x[have:])
            have *= 2
        if have < width:
            x = np.minimum(x[: len(x) - (width - have)], x[width - have :])
        # Runs of starts with the same least hash; the last starts of a text, which reach beyond it, are none.
        fits = np.ones(len(x), bool)
        beyond = (offs[1:, None] - np.arange(LENGTH - 1, 0, -1)[None]).ravel()
        beyond = beyond[(beyond >= np.repeat(offs[:-1], LENGTH - 1)) & (beyond < len(x))]
        fits[beyond] = False
        other = np.append(True, x[1:] != x[:-1])
        first = np.flatnonzero(fits & (other | np.append(True, ~fits[:-1])))
        last = np.flatnonzero(fits & np.append(other[1:] | ~fits[1:], True))
        if not len(first):
            continue
        doc = np.searchsorted(offs, first, "right") - 1
        end = last + LENGTH
        name = mix((sums[end] - sums[first]) * inverse[first] + (end - first).astype(np.uint64))
        yield b + np.uint8(1), i + doc, first, end, first - offs[doc] + shift, mix(h[(x[first] & low).astype(np.int64)]), name


HIT = np.dtype([("doc", "i8"), ("start", "u4"), ("end", "u4")])
FACT = np.dtype([("doc", "i8"), ("start", "u4"), ("len", "u4"), ("bucket", "u4")])
ASK = "block int, bucket int, keys binary, several binary, counts binary"
TOLD = "block int, bucket int, shared binary, hot binary"
SENT = "block int, bucket int, strings binary, facts binary, done binary"
GONE = "block int, gone binary"


def _pieces(frame: pd.DataFrame):
    return stretches(pa.array(frame["text"].tolist(), pa.large_string()))


def _keys(ids: np.ndarray, pieces, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """A block's distinct keys in the order of (bucket, key), where each bucket's begin, which several documents have, and
    how many different stretches each has (those of several pieces count again; at most 65535)."""
    keys, docs, counts = [], [], []
    for _, doc, *_, key, name in pieces:
        k, inverse = np.unique(key, return_inverse=True)
        lo, hi = np.full(len(k), np.iinfo(np.int64).max), np.full(len(k), np.iinfo(np.int64).min)
        np.minimum.at(lo, inverse, ids[doc])
        np.maximum.at(hi, inverse, ids[doc])
        keys += [k, k]
        docs += [lo, hi]
        one = inverse[np.unique(name, return_index=True)[1]]
        counts += [np.bincount(one, minlength=len(k)), np.zeros(len(k), np.int64)]
    key, doc, count = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((keys, np.uint64), (docs, np.int64), (counts, np.int64)))
    o = np.argsort(key, kind="stable")
    key, doc, count = key[o], doc[o], count[o]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    several = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first) if len(key) else np.zeros(0, bool)
    count = np.minimum(np.add.reduceat(count, first), 65535).astype(np.uint16) if len(key) else np.zeros(0, np.uint16)
    key = key[first]
    bucket = key % np.uint64(buckets)
    o = np.argsort(bucket, kind="stable")
    return key[o], np.searchsorted(bucket[o], np.arange(buckets + 1).astype(np.uint64)), several[o], count[o]


def _ask(buckets: int):
    def over(frame: pd.DataFrame) -> pd.DataFrame:
        key, at, several, count = _keys(frame["doc_id"].to_numpy(np.int64), _pieces(frame), buckets)
        block, rows = int(frame["block"].iloc[0]), []
        for i in np.flatnonzero(np.diff(at)).tolist():
            mine = slice(at[i], at[i + 1])
            rows.append((block, i, pack(key[mine]), np.packbits(several[mine]).tobytes(), count[mine].tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "several", "counts"])

    return over


def _tell(frame: pd.DataFrame) -> pd.DataFrame:
    """Which of the keys that each block sent are in several documents: those of several blocks, and those that one has;
    and which ones have more than `HOT` stretches."""
    keys = [unpack(x) for x in frame["keys"]]
    several = [np.unpackbits(np.frombuffer(x, np.uint8), count=len(k)).astype(bool) for x, k in zip(frame["several"], keys, strict=True)]
    _, inverse = np.unique(np.concatenate(keys), return_inverse=True)
    shared = np.bincount(inverse, weights=1 + np.concatenate(several).astype(np.int64)) > 1
    hot = np.bincount(inverse, weights=np.concatenate([np.frombuffer(x, np.uint16) for x in frame["counts"]])) > HOT
    at = np.cumsum([0, *map(len, keys)])
    told = ([np.packbits(x[inverse[a:b]]).tobytes() for a, b in zip(at[:-1], at[1:], strict=True)] for x in (shared, hot))
    return pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], **dict(zip(("shared", "hot"), told, strict=True))})


def _hits(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> bytes:
    out = np.empty(len(doc), HIT)
    out["doc"], out["start"], out["end"] = doc, start, end
    return out.tobytes()


def _gather(b: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    total = int(length.sum())
    return b[np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(total)]


def equal_bytes(b: np.ndarray, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether the `length` bytes of `b` that begin at x and at y are the same, some megabytes at a time."""
    out, ends, i = np.ones(len(x), bool), np.cumsum(length), 0
    while i < len(x):
        j = max(i + 1, int(np.searchsorted(ends, (ends[i - 1] if i else 0) + PIECE, "right")))
        n = length[i:j]
        part = _gather(b, x[i:j], n) != _gather(b, y[i:j], n)
        out[i:j] = ~np.logical_or.reduceat(part, np.cumsum(n) - n)
        i = j
    return out


def firsts(b: np.ndarray, name: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For strings in the order of their names (hashes) the first one that each equals. Names only say where to look: a
    string that differs from the first of its name is a first one itself."""
    at = np.arange(len(name))
    base = np.maximum.accumulate(np.where(np.append(True, name[1:] != name[:-1])[: len(name)], at, 0)) if len(name) else at
    other = np.flatnonzero(base != at)
    same = length[other] == length[base[other]]
    same[same] = equal_bytes(b, begin[other[same]], begin[base[other[same]]], length[other[same]])
    base[other[~same]] = other[~same]
    return base


def starts_apart(b: np.ndarray, doc: np.ndarray, begin: np.ndarray, end: np.ndarray, start: np.ndarray) -> tuple:
    """Stretches taken apart: the `LENGTH` bytes of each of their starts by themselves, and their hashes."""
    n = end - begin - LENGTH + 1
    of = np.repeat(np.arange(len(n)), n)
    step = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    at, sums = begin[of] + step, prefix_hash(b)
    name = mix((sums[at + LENGTH] - sums[at]) * powers(K_INV, len(b) + 1)[at])
    return doc[of], at, at + LENGTH, start[of] + step, name


def _send(buckets: int):
    def over(frame: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        if not len(frame):
            return pd.DataFrame(columns=["block", "bucket", "strings", "facts", "done"])
        ids, pieces = frame["doc_id"].to_numpy(np.int64), list(_pieces(frame))
        key, at, *_ = _keys(ids, pieces, buckets)
        shared, hot = np.zeros((2, len(key)), bool)
        for i, *told_ in zip(told["bucket"], told["shared"], told["hot"], strict=True):
            for of, x in zip((shared, hot), told_, strict=True):
                of[at[i] : at[i + 1]] = np.unpackbits(np.frombuffer(x, np.uint8), count=at[i + 1] - at[i])
        by = np.argsort(key)
        key, shared, hot = key[by], shared[by], hot[by]
        facts, places, done, data = [], [], [], []
        for b, doc, begin, end, start, k, name in pieces:
            of = np.searchsorted(key, k)
            on = shared[of]
            apart = hot[of[on]]
            stretch = [x[on] for x in (ids[doc], begin, end, start, name, k % np.uint64(buckets))]
            if apart.any():
                split = starts_apart(b, *(x[apart] for x in stretch[:4]))
                split += (buckets + split[-1] % np.uint64(buckets),)  # a number above the buckets' tells them from others
                stretch = [np.concatenate([x[~apart], y.astype(x.dtype)]) for x, y in zip(stretch, split, strict=True)]
            doc, begin, end, start, name, bucket = stretch
            o = np.lexsort((doc, name))
            doc, begin, end, start, name, bucket = (x[o] for x in (doc, begin, end, start, name, bucket))
            later = doc > doc[firsts(b, name, begin, end - begin)]  # a smaller document of this piece has the same stretch
            done.append(_hits(doc[later], start[later], end[later] - begin[later] + start[later]))
            keep = ~later
            row = np.zeros(int(keep.sum()), FACT)
            row["doc"], row["start"], row["len"], row["bucket"] = doc[keep], start[keep], (end - begin)[keep], bucket[keep]
            facts.append(row)
            places.append(begin[keep] + sum(map(len, data)))
            data.append(b)
        block, rows = int(frame["block"].iloc[0]), []
        if facts:
            fact, place, data = map(np.concatenate, (facts, places, data))
            bucket = fact["bucket"].astype(np.int64) % buckets
            o = np.argsort(bucket, kind="stable")
            cut = np.append(np.flatnonzero(np.diff(bucket[o], prepend=-1)), len(o))
            for a, z in zip(cut[:-1], cut[1:], strict=True):
                f = fact[o[a:z]]
                rows.append((block, int(bucket[o[a]]), _gather(data, place[o[a:z]], f["len"].astype(np.int64)).tobytes(), f.tobytes(), b""))
        if any(done):
            rows.append((block, block % buckets, b"", b"", b"".join(done)))
        return pd.DataFrame(rows, columns=["block", "bucket", "strings", "facts", "done"])

    return over


def names(data: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Hashes of strings that lie end to end, some megabytes at a time."""
    out, ends, i = np.empty(len(length), np.uint64), np.cumsum(length), 0
    while i < len(length):
        a = int(ends[i - 1]) if i else 0
        j = max(i + 1, int(np.searchsorted(ends, a + PIECE, "right")))
        n, at = length[i:j], ends[i:j] - length[i:j] - a
        sums = prefix_hash(data[a : ends[j - 1]])
        out[i:j] = mix((sums[at + n] - sums[at]) * powers(K_INV, len(sums))[at] + n.astype(np.uint64))
        i = j
    return out


def _find(buckets: int):
    return lambda frame: _found(frame, buckets)


def _found(frame: pd.DataFrame, buckets: int) -> pd.DataFrame:
    """A bucket's strings, each once with its smallest document; then which of their bytes begin a repeat. Starts that came
    by themselves have been compared by then, and no other string holds what begins there."""
    data = np.concatenate([np.frombuffer(x, np.uint8) for x in frame["strings"]])
    fact = np.concatenate([np.frombuffer(x, FACT) for x in frame["facts"]])
    block = np.repeat(frame["block"].to_numpy(), [len(x) // FACT.itemsize for x in frame["facts"]])
    out = [(int(k), x) for k, x in zip(frame["block"], frame["done"], strict=True) if x]
    if len(fact):
        length = fact["len"].astype(np.int64)
        at, name = np.cumsum(length) - length, names(data, length)
        o = np.lexsort((fact["doc"], name))
        fact, block, at, length, name = fact[o], block[o], at[o], length[o], name[o]
        apart = fact["bucket"] >= buckets
        base = firsts(data, name, at, length)
        later = fact["doc"] > fact["doc"][base]
        # A smaller document has the whole string: every start in it goes.
        doc, begin, end, who = [fact["doc"][later]], [fact["start"][later].astype(np.int64)], [fact["start"][later] + length[later]], [block[later]]
        own = np.flatnonzero((base == np.arange(len(base))) & ~apart)
        if len(own):
            least = least_owner(_gather(data, at[own], length[own]), length[own], fact["doc"][own])
            mine = np.repeat(fact["doc"][own], length[own])
            gone = least < mine
            edge = np.cumsum(length[own]) - length[own]
            starts = gone & np.append(True, ~gone[:-1])
            starts[edge] = gone[edge]
            stops = gone & np.append(~gone[1:], True)
            stops[np.append(edge[1:], len(gone)) - 1] = gone[np.append(edge[1:], len(gone)) - 1]
            a, z = np.flatnonzero(starts), np.flatnonzero(stops)
            s = np.searchsorted(edge, a, "right") - 1
            # Equal strings of the same document share what was found for the first.
            copies = np.flatnonzero(~later & ~apart)
            of = np.searchsorted(own, base[copies])
            n = np.bincount(s, minlength=len(own))
            run0 = np.cumsum(n) - n
            many = n[of]
            take = np.repeat(run0[of] - (np.cumsum(many) - many), many) + np.arange(int(many.sum()))
            row = np.repeat(copies, many)
            doc.append(fact["doc"][row])
            begin.append(fact["start"][row] + a[take] - edge[s[take]])
            end.append(fact["start"][row] + z[take] - edge[s[take]] + LENGTH)
            who.append(block[row])
        doc, begin, end, who = map(np.concatenate, (doc, begin, end, who))
        o = np.argsort(who, kind="stable")
        cut = np.flatnonzero(np.append(True, who[o][1:] != who[o][:-1])) if len(o) else np.zeros(0, np.int64)
        for i, j in zip(cut, np.append(cut, len(o))[1:], strict=True):
            out.append((int(who[o[i]]), _hits(doc[o[i:j]], begin[o[i:j]], end[o[i:j]])))
    return pd.DataFrame(out, columns=["block", "gone"])


def _cut(frame: pd.DataFrame, gone: pd.DataFrame) -> pd.DataFrame:
    hit = np.concatenate([np.frombuffer(x, HIT) for x in gone["gone"]]) if len(gone) else np.zeros(0, HIT)
    hit = hit[np.argsort(hit["doc"], kind="stable")]
    rows = []
    for doc, text in zip(frame["doc_id"], frame["text"], strict=True):
        data = text.encode()
        a, z = np.searchsorted(hit["doc"], [doc, doc + 1]) if not pd.isna(doc) else (0, 0)
        spans = []
        if a < z:
            edge = np.zeros(len(data) + 1, np.int64)
            np.add.at(edge, np.minimum(hit["start"][a:z], len(data)), 1)
            np.add.at(edge, np.minimum(hit["end"][a:z], len(data)), -1)
            covered = np.cumsum(edge)[:-1] > 0
            flips = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
            spans = list(zip(flips[::2].tolist(), flips[1::2].tolist(), strict=True))
            kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
        else:
            kept = data
        rows.append((doc, len(data), len(data) - len(kept), spans, hashlib.sha256(kept).hexdigest()))
    out = pd.DataFrame(rows, columns=["doc_id", "n_bytes", "n_removed", "spans", "kept_sha256"])
    return out.astype({"doc_id": "Int64"})


def suffix_dedup(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, spans (removed runs of UTF-8 bytes) and kept_sha256.

    A byte is removed if a string of 50 bytes that covers it also begins in a document with a smaller id.

    Texts are dealt to blocks by id and text. Each block cuts its texts' starts into stretches by the short string of
    least hash inside their 50 bytes, and asks the buckets of those hashes which ones several documents have; only such
    stretches can hold a repeat and go on, each distinct one once. A bucket lays its strings out as shards, builds each
    shard's transform, merges them by refining their interleave, and takes from the common prefixes the groups of equal
    50 bytes and each group's smallest document. A short string that stands in more than `HOT` different stretches would
    bring them all to one bucket, so each of their starts goes with its 50 bytes to a bucket that these bytes name.
    What begins a repeat goes back to the block, which cuts its texts.
    Hashes only say where to look: stretches are one if their bytes are. Blocks and buckets exchange rows for what they
    hold, never for what they don't, so their number is bounded by the stretches.

    Null text is empty. Ties can't be: only smaller ids take away. Rows without an id lose nothing and take nothing away;
    rows that repeat an id are one document, none of which takes from another; no rows give no rows; texts of any length
    are cut into pieces that overlap by 49 bytes; other columns, whatever their names, aren't read.
    """
    size = docs.agg(F.sum(F.octet_length(text))).first()[0] or 0
    n, buckets = max(1, -(-int(size) // BLOCK)), max(1, -(-int(size) // PER_BUCKET))
    who = F.col(doc_id).cast("long")
    dealt = small_batches(docs).select(who.alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), F.pmod(F.xxhash64(who, text), F.lit(n)).cast("int").alias("block"))
    known = dealt.where("doc_id is not null")
    told = known.groupBy("block").applyInPandas(_ask(buckets), ASK).groupBy("bucket").applyInPandas(_tell, TOLD)
    sent = known.groupBy("block").cogroup(told.groupBy("block")).applyInPandas(_send(buckets), SENT)
    gone = sent.groupBy("bucket").applyInPandas(_find(buckets), GONE)
    kind = "doc_id long, n_bytes long, n_removed long, spans array<struct<start:long,end:long>>, kept_sha256 string"
    out = known.groupBy("block").cogroup(gone.groupBy("block")).applyInPandas(_cut, kind)
    none = dealt.where("doc_id is null").select(
        "doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.lit(0).cast("long").alias("n_removed"),
        F.expr("cast(array() as array<struct<start:long,end:long>>)").alias("spans"), F.sha2("text", 256).alias("kept_sha256"),
    )
    return out.unionByName(none)
