"""Self-join of texts by the Jaccard similarity of their word shingles, with prefix filters under several orders."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import NOT_BLANK, chunks, flat, mix, slices, small_batches, snug, stable, word_hashes, words
from termloom.llm.graph import components

#: Words in a shingle, and the similarity of a link as a fraction.
SHINGLE, SHARE = 5, (75, 100)
#: Slots of the sketch of document frequencies: 2**SLOT_BITS counters, whatever the input's size.
SLOT_BITS, SLICES = 22, 16
#: Seeds of the orders: the first one makes candidates, the others are checked before the sets are.
ORDERS = (0x243F6A8885A308D3, 0x13198A2E03707344, 0xA4093822299F31D0)
CHUNK = 4 << 20
#: Bits of the longest signature.
MOST_BITS = 1 << 14
#: Sets of a star that meet as one side in a task, the pairs that it looks at a time, and the sets of small stars in a task.
SIDE, PAIRS, SMALL = 1024, 1 << 20, 4096
#: Rows of prefixes that a task holds before it sends them: the more, the fewer and larger what each bucket gets from it.
HELD = 1 << 19
#: How many of the closest pairs of a set are compared in the first pass across components, before all that are left.
CLOSEST = (2,)
#: Tokens of the sets that a task compares, and the most ids that a Bloom filter picks; beyond, a join does.
TOKENS, FILTERED = 1 << 20, 1 << 22
ODD = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0x9FB21C651E98DF25, 0xBD8CF76A4B1D3C4B], np.uint64)


def shingle_sets(texts: pa.Array, k: int = SHINGLE) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time the sorted 64-bit hashes of each one's distinct shingles, end to end, and where each
    text's begin. A text of fewer words has one hash of them all."""
    b_all, offs_all = flat(texts)
    for i, j in chunks(offs_all, CHUNK):
        b, offs = b_all[offs_all[i] : offs_all[j]], offs_all[i : j + 1] - offs_all[i]
        starts, ends, at = words(b, offs, NOT_BLANK)
        w = word_hashes(b, starts, ends)
        n = np.diff(at)
        size = np.where(n >= k, n - k + 1, np.minimum(n, 1))
        to = np.cumsum(np.append(0, size))
        text = np.repeat(np.arange(len(n)), size)
        first = at[text] + np.arange(len(text)) - to[text]
        h = np.zeros(len(text), np.uint64)
        for x in range(k):
            inside = first + x < at[text + 1]
            h += np.where(inside, w[np.minimum(first + x, max(0, len(w) - 1))], 0).astype(np.uint64) * ODD[x]
        h = mix(h + np.minimum(n, k)[text].astype(np.uint64))
        for d in np.flatnonzero(size > 1):
            h[to[d] : to[d + 1]].sort()
        new = np.append(True, (h[1:] != h[:-1]) | (text[1:] != text[:-1]))[: len(h)]
        yield h[new], np.searchsorted(text[new], np.arange(len(n) + 1))


def set_digests(s: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit digests for each set, by which together equal sets are one node; 0 for an empty one."""
    hi, lo = np.zeros((2, len(at) - 1), np.uint64)
    full = np.flatnonzero(np.diff(at))
    if len(full):
        n = np.diff(at)[full].astype(np.uint64)
        sums = [np.add.reduceat(mix(s ^ np.uint64(c)), at[full]) for c in (0x452821E638D01377, 0xBE5466CF34E90C6C, 0xC0AC29B7C97C50DD, 0x3F84D5B5B5470917)]
        hi[full], lo[full] = mix(mix(sums[0] ^ n) ^ sums[1]), mix(mix(sums[2]) ^ sums[3] ^ n)
    return hi.view(np.int64), lo.view(np.int64)


def signatures(s: np.ndarray, at: np.ndarray) -> list[bytes]:
    """For each set, per bit, the parity of its tokens that hash there; 128 to `MOST_BITS` bits, two to four per token.
    Two such maps differ in no more bits than their sets do in tokens (Sandes et al., 2020), and halve by folding."""
    n = np.diff(at)
    bits = np.clip(2 ** np.floor(np.log2(np.maximum(4 * n, 1))), 128, MOST_BITS).astype(np.int64)
    begin = np.cumsum(bits) - bits
    place = np.repeat(begin, n) + (mix(s ^ np.uint64(0xC0AC29B7C97C50DD)) & np.repeat(bits - 1, n).astype(np.uint64)).astype(np.int64)
    packed = np.packbits((np.bincount(place, minlength=int(bits.sum())) & 1).astype(np.uint8)).tobytes()
    return [packed[a // 8 : (a + b) // 8] for a, b in zip(begin.tolist(), bits.tolist(), strict=True)]


class Signatures:
    """Signatures of some sets, and how many bits those of pairs differ in at least. For each length that occurs there is a
    table of the signatures of that length and of longer ones, folded to it."""

    def __init__(self, sigs: list[bytes]):
        self.bits = np.array([8 * len(x) for x in sigs], np.int64)
        self.maps, self.place = {}, {}
        held, full = np.zeros(0, np.int64), np.zeros((0, MOST_BITS // 64), np.uint64)
        for b in sorted(set(self.bits.tolist()), reverse=True):
            while full.shape[1] > b // 64:
                full = full[:, : full.shape[1] // 2] ^ full[:, full.shape[1] // 2 :]
            own = np.flatnonzero(self.bits == b)
            held = np.concatenate([held, own])
            full = np.concatenate([full, np.frombuffer(b"".join(sigs[i] for i in own), np.uint64).reshape(len(own), b // 64)])
            where = np.full(len(sigs), -1, np.int32)
            where[held] = np.arange(len(held))
            self.maps[b], self.place[b] = full, where

    def differ(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        common = np.minimum(self.bits[i], self.bits[j])
        for b, maps in self.maps.items():
            on, where = np.flatnonzero(common == b), self.place[b]
            step = max(1, (1 << 27) // b)
            for k in range(0, len(on), step):
                some = on[k : k + step]
                out[some] = np.bitwise_count(maps[where[i[some]]] ^ maps[where[j[some]]]).sum(1)
        return out


def prefix_length(n):
    """Sets of these sizes that are similar enough share a token among so many first ones, under any order of all tokens."""
    return n - (n * SHARE[0] + SHARE[1] - 1) // SHARE[1] + 1


def needed(n, m):
    """The least intersection of similar sets of these sizes."""
    s = SHARE[0] + SHARE[1]
    return (SHARE[0] * (n + m) + s - 1) // s


def order_keys(s: np.ndarray, levels: np.ndarray, seed: int) -> np.ndarray:
    """Tokens' places in one of the global orders: what few documents share first, then by a seeded hash."""
    level = levels[s >> np.uint64(64 - SLOT_BITS)].astype(np.uint64)
    return (level << np.uint64(58)) | (mix(s ^ np.uint64(seed)) >> np.uint64(6))


FACTS = "doc_id long, hi long, lo long, n long, sig binary, slice int, sketch binary"


def _profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each document its set's digest and size; at the end, slice by slice, the task's sketch of how many sets hold
    a token (counts up to 255)."""
    names, count = ["doc_id", "hi", "lo", "n", "sig", "slice", "sketch"], np.zeros(1 << SLOT_BITS, np.uint16)
    for batch in batches:
        his, los, sizes, sigs = [], [], [], []
        for s, at in shingle_sets(batch.column(1)):
            np.add.at(count, s >> np.uint64(64 - SLOT_BITS), np.uint16(1))
            np.minimum(count, 1 << 15, out=count)
            hi, lo = set_digests(s, at)
            his.append(hi)
            los.append(lo)
            sizes.append(np.diff(at))
            sigs += signatures(s, at)
        if sizes:
            n = np.concatenate(sizes)
            digests = [pa.array(np.concatenate(x), mask=n == 0) for x in (his, los)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *digests, pa.array(n), pa.array(sigs, pa.binary()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], names)
    if count.any():
        some = [zlib.compress(x.astype(np.uint8).tobytes(), 1) for x in np.split(np.minimum(count, 255), SLICES)]
        yield pa.RecordBatch.from_arrays([*(pa.nulls(SLICES, pa.int64()) for _ in range(4)), pa.nulls(SLICES, pa.binary()), pa.array(range(SLICES), pa.int32()), pa.array(some, pa.binary())], names)


def _levels(mean: float):
    """Sums a slice of the sketches and puts it on a coarse scale: 0 for what the noise of other tokens explains."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.uint8).astype(np.int64) for x in frame["sketch"])
        extra = np.maximum(1.0, total - mean - 2 * np.sqrt(mean))
        return pd.DataFrame({"slice": frame["slice"].iloc[:1], "levels": [np.minimum(63, np.ceil(np.log2(extra))).astype(np.uint8).tobytes()]})

    return over


ROW = np.dtype([("token", "u4"), ("hi", "i8"), ("n", "u4"), ("rest", "u4")])


def _packed(rows: np.ndarray) -> bytes:
    """Rows in the order of their tokens, column by column; steps and small numbers byte plane by byte plane, as the high
    planes are all but empty, which the shuffle's compression uses."""
    planes = lambda x: np.ascontiguousarray(x).view(np.uint8).reshape(len(x), 4).T.tobytes()
    return planes(np.diff(rows["token"], prepend=np.uint32(0))) + rows["hi"].tobytes() + planes(rows["n"]) + planes(rows["n"] - rows["rest"])


def _unpacked(blob: bytes) -> np.ndarray:
    k = len(blob) // ROW.itemsize
    planes = lambda at: np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * k, at * k).reshape(4, k).T).view(np.uint32).ravel()
    rows = np.empty(k, ROW)
    rows["token"], rows["hi"], rows["n"] = np.cumsum(planes(0), dtype=np.uint32), np.frombuffer(blob, np.int64, k, 4 * k), planes(12)
    rows["rest"] = rows["n"] - planes(16)
    return rows


def _prefixes(levels: np.ndarray, buckets: int):
    """Rows (token, set, its size, how much of it is left from the token on) of the sets' prefixes, packed by bucket, some
    `HELD` of them at a time. A set that a task meets again is passed over.

    A bucket's tokens are told apart by 32 bits, which only makes some stars larger, and no more of them as the input grows,
    as buckets hold some 4 MB of it each. Sets are named by half of their digest."""

    def blobs(tokens: list[np.ndarray], his: list[int], sizes: list[int]) -> Iterator[pa.RecordBatch]:
        if not tokens:
            return
        token, held = np.concatenate(tokens), np.array([len(x) for x in tokens])
        bucket = token % np.uint64(buckets)
        key = (bucket << np.uint64(32)) | (mix(token ^ np.uint64(ORDERS[2])) >> np.uint64(32))
        rows = np.empty(len(token), ROW)
        rows["token"], rows["hi"], rows["n"] = key.astype(np.uint32), np.repeat(np.array(his, np.int64), held), np.repeat(np.array(sizes, np.uint32), held)
        rows["rest"] = rows["n"] - (np.arange(len(token)) - np.repeat(np.cumsum(held) - held, held)).astype(np.uint32)
        order = key.argsort()
        rows, at = rows[order], np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64))
        full = np.flatnonzero(np.diff(at))
        for k in range(0, len(full), 256):
            some = full[k : k + 256]
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array([_packed(rows[at[b] : at[b + 1]]) for b in some], pa.binary())], ["bucket", "rows"])

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, held, some = set(), 0, ([], [], [])
        for batch in batches:
            for s, at in shingle_sets(batch.column(0)):
                key, (hi, lo) = order_keys(s, levels, ORDERS[0]), set_digests(s, at)
                for h, l, a, z in zip(hi.tolist(), lo.tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if a == z or (h, l) in seen:
                        continue
                    seen.add((h, l))
                    p = prefix_length(z - a)
                    for x, y in zip(some, (s[a:z][key[a:z].argsort()[:p]], h, z - a), strict=True):
                        x.append(y)
                    held += p
                    if held >= HELD:
                        yield from blobs(*some)
                        held, some = 0, ([], [], [])
        yield from blobs(*some)

    return over


def _fits(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether sets that meet first at a token can be similar: by their sizes and by what is left of them there."""
    na, nb = a["n"].astype(np.int64), b["n"].astype(np.int64)
    return np.minimum(a["rest"], b["rest"]) >= needed(na, nb)


def _reach(rows: np.ndarray) -> np.ndarray:
    """The largest set that what is left of each row's allows (see `_fits`): two fit if neither is beyond the other's reach."""
    return sum(SHARE) * rows["rest"].astype(np.int64) // SHARE[0] - rows["n"]


def _so_far(group: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The largest x of a row's group up to the row; groups lie end to end."""
    base = group.astype(np.int64) << 34
    return np.maximum.accumulate(base + x) - base


def _new(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before."""
    out = np.ones(len(columns[0]), bool)
    out[1:] = np.any([x[1:] != x[:-1] for x in columns], axis=0)
    return out


def _groups(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows of the tokens that several sets hold, and where each group begins that a token's sets fall into: a set
    that fits none of a token's others isn't there, and sets of different groups don't fit each other."""
    rows = np.concatenate([_unpacked(x) for x in blobs]) if len(blobs) else np.zeros(0, ROW)
    order = rows["token"].argsort()
    new = _new(rows["token"][order])
    rows = rows[order[~(new & np.append(new[1:], True)[: len(new)])]]
    rows = rows[np.lexsort((rows["rest"], rows["hi"], rows["n"], rows["token"]))]
    rows = rows[_new(*(rows[c] for c in ROW.names))]
    # Within a token by size: who is in a row's reach comes first, and one of them must reach as far as the row.
    group, reach, n = np.cumsum(_new(rows["token"])), _reach(rows), rows["n"].astype(np.int64)
    base = group << 34
    best = _so_far(group, reach)
    before = np.where(_new(group), 0, np.append(0, best[:-1])[: len(best)])
    second = _so_far(group, np.minimum(reach, before))
    last = np.searchsorted(base + n, base + reach, "right") - 1
    inside = (last >= 0) & (group[last] == group)
    own = (np.arange(len(rows)) <= last) & (best[last] == reach)
    rows = rows[inside & (np.where(own, second[last], best[last]) >= n)]
    token = _new(rows["token"])
    best = _so_far(np.cumsum(token), _reach(rows))
    group = np.cumsum(token | (np.append(0, best[:-1])[: len(best)] < rows["n"]))
    order = np.lexsort((rows["hi"], group))
    return rows[order], np.append(np.flatnonzero(_new(group)), len(rows))


STARS = "ahi long, bhi long, fits boolean"


def _stars(frame: pd.DataFrame) -> pd.DataFrame:
    """Each group's sets are tied to the first of them: as many pairs as rows."""
    rows, at = _groups(frame["rows"])
    hub = np.repeat(at[:-1], np.diff(at))
    pair = hub != np.arange(len(rows))
    a, b = rows[hub[pair]], rows[pair]
    fits = _fits(a, b)
    o = np.lexsort((~fits, b["hi"], a["hi"]))
    a, b, fits = a[o], b[o], fits[o]
    return pd.DataFrame({"ahi": a["hi"], "bhi": b["hi"], "fits": fits})[_new(a["hi"], b["hi"])]


ACROSS = "a long, b long, loose long, gap double, meet long, w long"


def _across(closest: int | None):
    """Of the stars' sides that meet in a task, the pairs of a set that isn't in its hub's component and any other set of
    the star that is in a different one and, by sizes and signatures, can be similar; with `closest`, of each such set only
    so many pairs, which the signatures bring closest."""

    def over(frame: pd.DataFrame) -> pd.DataFrame:
        frame = pd.concat([frame, frame[frame["both"]].assign(left=True)])
        frame = frame.sort_values(["a", "i", "j", "left", "node"], kind="stable")
        meets = frame[["a", "i", "j"]].to_numpy()
        left, node, root, n = (frame[c].to_numpy() for c in ("left", "node", "root", "n"))
        meet, sigs = int(frame["meet"].iloc[0]), Signatures(frame["sig"].tolist())
        first = np.flatnonzero(np.append(True, (meets[1:] != meets[:-1]).any(1)))
        last = np.append(first[1:], len(frame))
        middle = first + np.add.reduceat((~left).astype(np.int64), first)  # others come first, then the loose ones
        others, loose = middle - first, last - middle
        # One row per loose set: it meets a run of others. Runs are taken so many at a time.
        row = np.repeat(middle - (np.cumsum(loose) - loose), loose) + np.arange(int(loose.sum()))
        run, begin = np.repeat(others, loose), np.repeat(first, loose)
        ends, found, k = np.cumsum(run), [], 0
        while k < len(row):
            z = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + PAIRS, "right")))
            i = np.repeat(row[k:z], run[k:z])
            j = np.repeat(begin[k:z] - (ends[k:z] - run[k:z]), run[k:z]) + np.arange(ends[z - 1] - run[k:z].sum(), ends[z - 1])
            ok = (root[i] != root[j]) & (np.minimum(n[i], n[j]) >= needed(n[i], n[j]))
            i, j = i[ok], j[ok]
            gap = sigs.differ(i, j) / np.maximum(n[i] + n[j] - 2 * needed(n[i], n[j]), 0.5)
            ok = gap <= 1
            i, j, gap = i[ok], j[ok], gap[ok]
            if closest and len(i):
                o = np.lexsort((gap, i))
                i, j, gap = i[o], j[o], gap[o]
                start = np.flatnonzero(np.append(True, i[1:] != i[:-1]))
                best = np.arange(len(i)) - np.repeat(start, np.diff(np.append(start, len(i)))) < closest
                i, j, gap = i[best], j[best], gap[best]
            u, v = node[i], node[j]
            found.append(pd.DataFrame({"a": np.minimum(u, v), "b": np.maximum(u, v), "loose": u, "gap": gap, "meet": meet, "w": n[i] + n[j]}))
            k = z
        if not found:
            return pd.DataFrame({c: np.zeros(0, np.float64 if c == "gap" else np.int64) for c in ("a", "b", "loose", "gap", "meet", "w")})
        return pd.concat(found).drop_duplicates(["a", "b", "loose"] if closest else ["a", "b"])

    return over


def _gap(n: pd.Series, m: pd.Series, a: pd.Series, b: pd.Series) -> pd.Series:
    """By how many tokens, at least, sets differ, as a share of what similar ones may; over 1 where they can't be similar."""
    sigs = Signatures([*a, *b])
    i, n, m = np.arange(len(a)), n.to_numpy(), m.to_numpy()
    return pd.Series(sigs.differ(i, i + len(a)) / np.maximum(n + m - 2 * needed(n, m), 0.5))


def _places(ids: np.ndarray, bits: int) -> np.ndarray:
    x = mix(ids.astype(np.int64).view(np.uint64) ^ np.uint64(0x3F84D5B5B5470917))
    return np.stack([x >> np.uint64(64 - bits), (mix(x) >> np.uint64(64 - bits))])


def _filter_rows(bits: int):
    """A Bloom filter of the ids."""

    def over(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = np.zeros(1 << bits, bool)
        for f in frames:
            seen[_places(f["node"].to_numpy(), bits).ravel()] = True
        yield pd.DataFrame({"bitmap": [zlib.compress(np.packbits(seen).tobytes(), 1)]})

    return over


Filter = tuple[bytes, int]


def _passed(ids: np.ndarray, some: Filter) -> pa.Array:
    """Whether the filter lets ids through."""
    packed, where = np.frombuffer(some[0], np.uint8), _places(ids, some[1])
    return pa.array(((packed[where >> np.uint64(3)] >> (7 - (where & np.uint64(7))).astype(np.uint8)) & 1).all(0).astype(bool))


def _wanted(docs: DataFrame, want: DataFrame, most: int) -> tuple[DataFrame, Filter | None]:
    """The documents whose ids are in `want` (column node), or all of them and a Bloom filter that picks them where they
    lie: 16 bits an id, 8 MB at most. More ids than that can hold are joined."""
    want = snug(want, most)
    count = want.count()
    if count > FILTERED:
        return docs.join(want, F.col("doc_id") == F.col("node"), "left_semi"), None
    bits = max(10, (16 * count).bit_length())
    bitmap = np.zeros(1 << (bits - 3), np.uint8)
    for row in want.coalesce(8).mapInPandas(_filter_rows(bits), "bitmap binary").collect():
        bitmap |= np.frombuffer(zlib.decompress(row[0]), np.uint8)
    return docs, (bitmap.tobytes(), bits)


def _heads(levels: np.ndarray):
    """Of each document's set the prefixes under the further orders (cut to 32 bits, as they only filter)."""

    def of(s: np.ndarray) -> bytes:
        p = prefix_length(len(s)) if len(s) else 0
        return np.concatenate([np.sort(s[order_keys(s, levels, seed).argsort()[:p]].astype(np.uint32)) for seed in ORDERS[1:]]).tobytes()

    return of


def _told(of, some: Filter | None):
    """What `of` makes of the set of each document that the filter, if there is one, lets through; each set once a task."""

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in batches:
            batch = batch if some is None else batch.filter(_passed(batch.column(0).to_numpy(zero_copy_only=False), some))
            ids, k = batch.column(0).to_pylist(), 0
            for s, at in shingle_sets(batch.column(1)):
                rows = []
                for h, a, z in zip(set_digests(s, at)[0].tolist(), at[:-1].tolist(), at[1:].tolist(), strict=True):
                    if (ids[k], h) not in seen:
                        seen.add((ids[k], h))
                        rows.append((ids[k], of(s[a:z])))
                    k += 1
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary()), strict=True)], ["node", "told"])

    return over


def _meets(x: np.ndarray, y: np.ndarray) -> int:
    both = np.concatenate([x, y])
    both.sort()
    return int((both[1:] == both[:-1]).sum())


def _share_heads(x: bytes, y: bytes) -> bool:
    """Whether sets share a prefix token under every further order. Cut to 32 bits a prefix may hold a value twice, which
    lets a pair through in vain at worst."""
    x, y = (np.frombuffer(h, np.uint32).reshape(len(ORDERS) - 1, -1) for h in (x, y))
    return all(_meets(a, b) for a, b in zip(x, y, strict=True))


def _similar(x: bytes, y: bytes) -> bool:
    x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
    common = _meets(x, y)
    return SHARE[1] * common >= SHARE[0] * (len(x) + len(y) - common)


def _compare(test):
    def over(pairs: pd.DataFrame, told: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, list] = {}
        for node, x in zip(told["node"], told["told"], strict=True):
            if x not in (of := sets.setdefault(node, [])):
                of.append(x)
        ok = [any(test(x, y) for x in sets[a] for y in sets[b]) for a, b in zip(pairs["a"], pairs["b"], strict=True)]
        return pairs[["a", "b", "task"]][np.array(ok, bool)]

    return over


def _met(pairs: DataFrame, docs: DataFrame, groups: int, of, test) -> DataFrame:
    """The pairs (a, b, task) that pass a test of what `of` tells of their sets. Pairs of the same task are compared
    together, and each of their sets goes there once; there are `groups` of them at most."""
    most = 2 * pairs.count()
    places = snug(pairs.select("task", F.explode(F.array("a", "b")).alias("node")).distinct(), most)
    docs, some = _wanted(docs, places.select("node").distinct(), most)
    told = docs.mapInArrow(_told(of, some), "node long, told binary")
    sent = places.withColumnRenamed("task", "to").join(told, "node")
    return snug(pairs.groupBy("task").cogroup(sent.groupBy("to")).applyInPandas(_compare(test), "a long, b long, task long").coalesce(groups))


def _verified(pairs: DataFrame, docs: DataFrame, groups: int, levels: np.ndarray) -> DataFrame:
    """Of the pairs (a, b, meet, w) those whose sets share a prefix token under every other order too, and of these the ones
    that are similar: whole sets are fetched only then. The pairs come in `groups` groups at most.

    Pairs with the same `meet` are compared in one task, or in several where their sets' sizes `w` ask for it."""
    pairs = snug(pairs.groupBy("a", "b").agg(F.min("meet").alias("meet"), F.max("w").alias("w")).coalesce(groups))
    parts = pairs.groupBy("meet").agg((F.sum("w") / TOKENS + 1).cast("long").alias("parts"), F.sum("w").alias("all"))
    tasks = 8 * (1 + int(parts.agg(F.sum("all")).first()[0] or 0) // TOKENS)
    part = F.xxhash64("meet", F.pmod(F.xxhash64("a", "b"), F.col("parts")))
    dealt = snug(pairs.join(parts, "meet").select("a", "b", F.pmod(part, F.lit(tasks)).alias("task")), pairs.count())
    heads = _met(dealt, docs, tasks, _heads(levels), _share_heads)
    return _met(heads, docs, tasks, np.ndarray.tobytes, _similar).select("a", "b")


def _pairs_across(tied: DataFrame, roots: DataFrame, nodes: DataFrame, closest: int | None) -> tuple[DataFrame, int]:
    """Pairs within the stars that have not come together. Each set comes with its root, and the loose ones, which aren't
    in the hub's component, are a side of their own too. A large star is cut into blocks of sides, each pair of which is
    for one task, and its loose sets come once more; small stars meet some thousand sets a task. A star of two sets that
    can't be similar has no such pair. Also the number of such tasks."""
    many = tied.count()
    ra, rb = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    rooted = snug(tied.join(ra, "a", "left").join(rb, "b", "left").select("a", "b", F.coalesce("ra", "a").alias("ra"), F.coalesce("rb", "b").alias("rb"), F.expr("fits and gap <= 1").alias("near")), many)
    open_ = rooted.groupBy("a").agg(F.count(F.lit(1)).alias("size"), F.first("ra").alias("ra"), F.max(F.col("ra") != F.col("rb")).alias("open"), F.max("near").alias("near"))
    open_ = open_.where("open and (size > 1 or near)")
    open_ = snug(open_.select("a", "ra", "size", F.ceil((F.col("size") + 1) / SIDE).cast("int").alias("sides")), many)
    size, blocks = open_.agg(F.sum("size"), F.sum(F.when(F.col("sides") > 1, F.col("sides") * F.col("sides")))).first()
    tasks = 1 + int(size or 0) // SMALL
    sets = rooted.select("a", F.col("b").alias("node"), F.col("rb").alias("root")).join(open_, "a")
    sets = sets.unionByName(open_.select("a", F.col("a").alias("node"), F.col("ra").alias("root"), "ra", "size", "sides"))
    sets = sets.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("sides")).cast("int"))
    all_ = F.explode(F.sequence(F.lit(0), F.col("sides") - 1))
    others = sets.select("a", F.col("mine").alias("j"), all_.alias("i"), "node", "root", "sides", F.lit(False).alias("left"), F.expr("sides = 1 and root <> ra").alias("both"))
    loose = sets.where("sides > 1 and root <> ra").select("a", F.col("mine").alias("i"), all_.alias("j"), "node", "root", "sides", F.lit(True).alias("left"), F.lit(False).alias("both"))
    sides = others.unionByName(loose)
    # Numbers of small stars' tasks are below those of the blocks.
    block = F.shiftrightunsigned(F.xxhash64("a", "i", "j"), 1)
    meet = F.when(F.col("sides") == 1, F.pmod(F.xxhash64("a"), F.lit(tasks))).otherwise(F.greatest(block, F.lit(tasks)))
    sides = sides.withColumn("meet", meet).drop("sides").join(nodes.select("node", "n", "sig"), "node")
    return sides.groupBy("meet").applyInPandas(_across(closest), ACROSS), tasks + int(blocks or 0)


def jaccard_components(docs: DataFrame, doc_id="doc_id", text="text") -> DataFrame:
    """One row per document: doc_id, n_shingles, and component_id, the smallest id reachable by links (its own included).

    Two documents link when their sets of distinct shingles of five words are similar by 0.75 or more. Equal sets (by
    digests of 128 bits) are one node of the graph, named by their smallest id. A pair of nodes is a candidate if it shares
    a token among the prefixes under the first order, where sizes and what is left of both sets allow it; prefixes under
    each further order are intersected next, and only what shares a token there too has its whole sets fetched and
    compared. The orders put tokens that many sets hold last (by a sketch of fixed size) and differ in the rest. First
    each token's sets that fit any of its others are tied to one of them, in groups that don't fit each other, so that a
    group of copies gives as many pairs as it has members; such a star holds all pairs that share the token and fit. The closest pairs of each set outside its hub's component are checked then, and
    at last all pairs of a star across components that are left, so that no link between components is missed. Signatures
    rule out sets that differ too much before a pair is ever written down. Tokens are told apart by 64-bit hashes.

    Null and empty texts have no shingles and are linked with nothing; a text of fewer words is one shingle. Ties (equal
    sets) are one node. Rows that repeat an id are one document, which has the links of all its texts; rows without an id
    get a null component and link nothing; no rows give no rows. A text's length bounds only its own set, which one task
    holds. Other columns, whatever their names, aren't read.
    """
    docs = small_batches(docs).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    profile = stable(docs.mapInArrow(_profile, FACTS))
    facts = profile.where("slice is null").select("doc_id", "hi", "lo", "n", "sig")
    # The sketch's levels, 2**SLOT_BITS bytes whatever the input, go to the driver and with the plan.
    sums = facts.agg(F.sum("n")).first()
    mean = (sums[0] or 0) / (1 << SLOT_BITS)
    parts = profile.where("slice is not null").groupBy("slice").applyInPandas(_levels(mean), "slice int, levels binary").collect()
    levels = np.zeros(1 << SLOT_BITS, np.uint8)
    for i, x in parts:
        levels[i * len(x) : (i + 1) * len(x)] = np.frombuffer(x, np.uint8)

    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(1, -(-int(total) // (4 << 20)))
    with_id = docs.where("doc_id is not null")
    packed = with_id.select("text").mapInArrow(_prefixes(levels, buckets), "bucket int, rows binary")
    tied = packed.groupBy("bucket").applyInPandas(_stars, STARS)
    named = facts.where("doc_id is not null and hi is not null").groupBy("hi", "lo")
    nodes = stable(named.agg(F.min("doc_id").alias("node"), F.first("n").alias("n"), F.first("sig").alias("sig")).coalesce(slices(docs)))
    # Of each set the pair that its signature brings closest is compared in the first round.
    side = lambda x: nodes.select(F.col("hi").alias(f"{x}hi"), F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("sig").alias(f"sig{x}"))
    # Stars take sets that agree in half of their digest for one; these are tied to each other here.
    twins = nodes.groupBy("hi").agg(F.count(F.lit(1)).alias("sets")).where("sets > 1").select(F.col("hi").alias("ahi"), F.col("hi").alias("bhi"), F.lit(True).alias("fits"))
    tied = tied.unionByName(twins).groupBy("ahi", "bhi").agg(F.max("fits").alias("fits")).join(side("a"), "ahi").join(side("b"), "bhi")
    gap = F.pandas_udf(_gap, "double")("na", "nb", "siga", "sigb")
    tied = tied.where("a <> b").select("a", "b", "fits", gap.alias("gap"), (F.col("na") + F.col("nb")).alias("w"))
    # An id with many texts is many times in a star otherwise, and would bring all its texts each time.
    tied = snug(tied.groupBy("a", "b").agg(F.max("fits").alias("fits"), F.min("gap").alias("gap"), F.max("w").alias("w")).coalesce(buckets))
    best = tied.where("fits and gap <= 1").groupBy("b").agg(F.min_by(F.struct("a", "w"), F.struct("gap", "a")).alias("best"))
    links = _verified(best.select("best.a", "b", F.col("best.a").alias("meet"), "best.w"), with_id, buckets, levels)
    roots = snug(components(links))
    # Then, some times, the closest pairs of each set outside its hub's component, and at last all pairs across components
    # that are left.
    for closest in (*CLOSEST, None):
        across, groups = _pairs_across(tied, roots, nodes, closest)
        if closest:
            near = F.slice(F.array_sort(F.collect_list(F.struct("gap", "a", "b", "meet", "w"))), 1, closest)
            across = across.groupBy("loose").agg(near.alias("near")).select(F.explode("near").alias("p")).select("p.a", "p.b", "p.meet", "p.w")
        more = _verified(across.select("a", "b", "meet", "w"), with_id, groups, levels)
        if not more.isEmpty():
            roots = snug(components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more)))
    # A node is named by its smallest id, and a component by its smallest node.
    placed = nodes.select("hi", "lo", "node").join(roots, "node", "left").select("hi", "lo", F.coalesce("root", "node").alias("component"))
    placed = facts.select("doc_id", "hi", "lo", "n").join(placed, ["hi", "lo"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id"))
    return placed.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))
