"""Scoring texts with a weighted backoff automaton of n-grams that were counted over the whole corpus."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import NOT_BLANK, flat, mix, pack, small_batches, unpack, word_hashes, words

#: Bytes of text in a block, of which a task holds one at a time.
BLOCK = 8 << 20
#: Tokens that the traversal takes in one go.
STRIDE = 256
#: The hash that stands for a text's end.
END = np.uint64(0x5851F42D4C957F2D)
ODD = np.array([0xD1B54A32D192ED03, 0xABC98388FB8FAC03, 0x8CB92BA72F3D8DD7, 0x9FB21C651E98DF25], np.uint64)


class Block:
    """A block's tokens and, per order, its distinct n-grams: keys, and for each token the n-gram that ends there."""

    def __init__(self, texts: list, trains: np.ndarray, order: int):
        b, offs = flat(pa.array(texts, pa.large_string()))
        starts, ends, at = words(b, offs, NOT_BLANK)
        n = np.diff(at) + 1
        self.at = np.zeros(len(texts) + 1, np.int64)
        np.cumsum(n, out=self.at[1:])
        token = np.full(int(self.at[-1]), END, np.uint64)
        token[np.arange(len(starts)) + np.repeat(np.arange(len(texts)), n - 1)] = word_hashes(b, starts, ends)
        place = (np.arange(len(token)) - np.repeat(self.at[:-1], n)).astype(np.int32)
        trained = np.repeat(trains, n)
        self.n_tokens, self.keys, self.ids, self.counts, self.sample = n, [], [], [], []
        for k in range(1, order + 1):
            whole = np.flatnonzero(place >= k - 1)
            h = token[whole].copy()
            for j in range(1, k):
                h += token[whole - j] * ODD[j - 1]
            h = mix(h + np.uint64(k))
            keys, first, inverse = np.unique(h, return_index=True, return_inverse=True)
            ids = np.full(len(token), -1, np.int32)
            ids[whole] = inverse
            self.keys.append(keys)
            self.ids.append(ids)
            self.sample.append(whole[first].astype(np.int32))
            self.counts.append(np.bincount(inverse[trained[whole]], minlength=len(keys)).astype(np.uint32))
            del whole, h, first, inverse

    def buckets(self, n: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        """The keys of order k+1 in the order of their buckets, and where each bucket's begin."""
        bucket = (self.keys[k] >> np.uint64(40)) % np.uint64(n)
        order = np.argsort(bucket, kind="stable")
        return order, np.searchsorted(bucket[order], np.arange(n + 1).astype(np.uint64))


class Automaton:
    """States are the n-grams that were seen, the empty one being 0. An arc per seen continuation carries its log10
    probability; a failure arc carries the weight of going on with a shorter state.

    P(w|h) = (c(hw) + mu * P(w|h')) / (c(h) + mu), h' being h without its first token (Dirichlet smoothing, MacKay and
    Peto, 1995), and P(w) = (c(w) + 1) / (N + V + 1); what has not been seen after h has mu / (c(h) + mu) * P(w|h').
    """

    def __init__(self, block: Block, totals: list[np.ndarray], n: int, v: int, mu: float):
        order = len(totals)
        end = np.searchsorted(block.keys[0], mix(np.array([END + np.uint64(1)], np.uint64)))[0]
        unigram = (totals[0] + 1.0) / (n + v + 1.0)
        state_of, size, fail, fail_weight = [], 1, [np.zeros(1, np.int64)], [np.zeros(1)]
        p, arcs = [unigram], []
        word = [block.ids[0][s] for s in block.sample]
        for k in range(order):
            c = totals[k].astype(float)
            if k:
                s = block.sample[k]
                prefix, suffix = block.ids[k - 1][s - 1], block.ids[k - 1][s]
                p.append((c + mu * p[k - 1][suffix]) / (totals[k - 1][prefix] + mu))
                seen = np.flatnonzero(c > 0)
                shorter = state_of[k - 1][suffix[seen]]
            if k < order - 1:
                is_state = (c > 0) & (word[k] != end)
                number = np.zeros(len(c), np.int64)
                number[is_state] = size + np.arange(int(is_state.sum()))
                size += int(is_state.sum())
                state_of.append(number)
                fail.append(state_of[k - 1][suffix[is_state]] if k else np.zeros(int(is_state.sum()), np.int64))
                fail_weight.append(np.log10(mu / (c[is_state] + mu)))
            if k:
                to = np.where(word[k][seen] == end, 0, state_of[k][seen] if k < order - 1 else shorter)
                arcs.append((state_of[k - 1][prefix[seen]] * len(unigram) + word[k][seen].astype(np.int64), np.log10(p[k][seen]), to))
        self.root_weight = np.log10(unigram)
        self.root_to = state_of[0] if order > 1 else np.zeros(len(unigram), np.int64)
        self.fail, self.fail_weight = np.concatenate(fail), np.concatenate(fail_weight)
        key, weight, to = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, np.int64),) * 3
        o = np.argsort(key)
        self.key, self.weight, self.to, self.width = key[o], weight[o], to[o], len(unigram)

    def read(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One token for each of many texts: the next states, and the log-probabilities gathered on the way."""
        gained, to, left = np.zeros(len(state)), np.zeros(len(state), np.int64), np.arange(len(state))
        state = state.copy()
        while len(left):
            s, w = state[left], word[left]
            k = np.minimum(np.searchsorted(self.key, s * self.width + w), max(0, len(self.key) - 1))
            found = (s > 0) & (self.key[k] == s * self.width + w) if len(self.key) else np.zeros(len(s), bool)
            hit = left[found]
            gained[hit] += self.weight[k[found]]
            to[hit] = self.to[k[found]]
            root = s == 0
            gained[left[root]] += self.root_weight[w[root]]
            to[left[root]] = self.root_to[w[root]]
            left = left[~found & ~root]
            gained[left] += self.fail_weight[state[left]]
            state[left] = self.fail[state[left]]
        return to, gained

    def scores(self, ids: np.ndarray, at: np.ndarray, order: int) -> np.ndarray:
        """log10 probabilities of texts, read from left to right, many at once. A long text is read in strides; the
        state at a stride's start is the one that the tokens just before it lead to."""
        n = np.diff(at)
        parts = -(-n // STRIDE)
        text = np.repeat(np.arange(len(n)), parts)
        begin = at[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * STRIDE
        length = np.minimum(STRIDE, at[text + 1] - begin)
        state, total = np.zeros(len(text), np.int64), np.zeros(len(text))
        for back in range(order - 1, 0, -1):
            on = np.flatnonzero(begin - back >= at[text])
            state[on], _ = self.read(state[on], ids[begin[on] - back])
        by = np.argsort(-length, kind="stable")
        begin, length, state, text = begin[by], length[by], state[by], text[by]
        for k in range(int(length[0]) if len(length) else 0):
            m = int(np.searchsorted(-length, -k, "left"))
            state[:m], gained = self.read(state[:m], ids[begin[:m] + k])
            total[:m] += gained
        return np.bincount(text, weights=total, minlength=len(n))


COUNTS = "block int, bucket int, keys binary, counts binary, more_keys binary, more_counts binary"
REPLY = "block int, bucket int, totals binary, more_totals binary, n long, v long"


def _count(order: int, n: int, block_name: str):
    def over(frame: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame["text"].tolist(), frame["trains"].to_numpy(), order)
        cut = [block.buckets(n, k) for k in range(order)]
        rows = []
        for i in np.flatnonzero(np.sum([np.diff(a) for _, a in cut], axis=0)).tolist():
            take = [o[a[i] : a[i + 1]] for o, a in cut]
            more_k = np.concatenate([block.keys[k][t] for k, t in enumerate(take)][1:]) if order > 1 else np.zeros(0, np.uint64)
            more_c = np.concatenate([block.counts[k][t] for k, t in enumerate(take)][1:]) if order > 1 else np.zeros(0, np.uint32)
            rows.append((int(frame[block_name].iloc[0]), i, pack(block.keys[0][take[0]]), block.counts[0][take[0]].tobytes(), pack(more_k), more_c.tobytes()))
        return pd.DataFrame(rows, columns=["block", "bucket", "keys", "counts", "more_keys", "more_counts"])

    return over


def _sums(keys: pd.Series, counts: pd.Series) -> tuple[list[bytes], np.ndarray]:
    """What the other blocks counted of each n-gram, told to each block for the n-grams that it asked for."""
    k = np.concatenate([unpack(x) for x in keys])
    c = np.concatenate([np.frombuffer(x, np.uint32) for x in counts])
    _, inverse = np.unique(k, return_inverse=True)
    total = np.bincount(inverse, weights=c).astype(np.uint64)
    size = np.cumsum([0, *(len(x) // 8 for x in keys)])
    return [(total[inverse[a:b]].astype(np.uint32) - c[a:b]).tobytes() for a, b in zip(size[:-1], size[1:], strict=True)], total


def _sum(frame: pd.DataFrame) -> pd.DataFrame:
    """The replies to the blocks that asked, and a row for block -1: how many training tokens the bucket has, and how many
    different ones."""
    told, total = _sums(frame["keys"], frame["counts"])
    more, _ = _sums(frame["more_keys"], frame["more_counts"])
    out = pd.DataFrame({"block": frame["block"], "bucket": frame["bucket"], "totals": told, "more_totals": more, "n": 0, "v": 0})
    size = pd.DataFrame({"block": [-1], "bucket": frame["bucket"].iloc[:1], "totals": [b""], "more_totals": [b""], "n": [int(total.sum())], "v": [int((total > 0).sum())]})
    return pd.concat([out, size])


def _score(order: int, n: int, mu: float, out: tuple, keep: list[str]):
    def over(frame: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        block = Block(frame["text"].tolist(), frame["trains"].to_numpy(), order)
        totals = [c.copy() for c in block.counts]
        cut = [block.buckets(n, k) for k in range(order)]
        for bucket, told, more in zip(replies["bucket"], replies["totals"], replies["more_totals"], strict=True):
            take = [o[a[bucket] : a[bucket + 1]] for o, a in cut]
            totals[0][take[0]] += np.frombuffer(told, np.uint32)
            rest, at = np.frombuffer(more, np.uint32), 0
            for k in range(1, order):
                totals[k][take[k]] += rest[at : at + len(take[k])]
                at += len(take[k])
        big_n, v = map(int, replies["whole"].iloc[0])
        c, at = totals[0][block.ids[0]], block.at
        base = np.log10((c + 1.0) / (big_n + 1.0 * (v + 1)))
        automaton = Automaton(block, totals, big_n, v, mu)
        values = (
            ~frame["trains"].to_numpy(), block.n_tokens, np.add.reduceat((c > 0).astype(np.int64), at[:-1]),
            np.full(len(frame), big_n), np.add.reduceat(base, at[:-1]), automaton.scores(block.ids[0], at, order),
        )
        return frame[keep].assign(**dict(zip(out, values, strict=True)))

    return over


def lm_score(docs: DataFrame, doc_id="doc_id", text="text", order: int = 2, mu: float = 200.0, fold: int = 2, folds: int = 7, block: int = BLOCK) -> DataFrame:
    """doc_id with lm_held_out, lm_n_tokens, lm_n_known, lm_train_tokens, lm_base_score and lm_score.

    A text trains the model unless crc32(id as text) % folds is `fold`. Texts are dealt to blocks, as many as
    their bytes ask for. Each block sends the distinct n-grams of its texts, with its training counts, to buckets by
    hash, one row for each bucket that it has any for; a bucket adds up and answers each block for what it sent; the
    block builds its automaton of them and reads its texts. So no task holds more than a block or a bucket, and counts
    cover all texts. Tokens are told apart by 64-bit hashes.

    Null text is empty and has its end as the only token; a null id counts as the empty string in the draw; rows that
    repeat count as often; equal n-grams are one, so there are no ties to break; no rows give no rows; a text longer than
    a block makes its block longer. Other columns, whatever their names, aren't read. Blocks are dealt by id and text, so
    rows without an id are spread; only rows that repeat both are together.
    """
    size = docs.agg(F.sum(F.octet_length(text)), F.count(F.lit(1))).first()
    n = max(1, -(-int(size[0] or 0) // block))
    name = "block"
    dealt = small_batches(docs).select(
        F.col(doc_id).cast("long").cast("string").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"),
        F.pmod(F.xxhash64(doc_id, text), F.lit(n)).cast("int").alias(name),
    )
    trains = F.pmod(F.crc32(F.coalesce("doc_id", F.lit("")).cast("binary")), F.lit(folds)) != fold
    dealt = dealt.withColumn("trains", trains)
    asked = dealt.groupBy(name).applyInPandas(_count(order, n, name), COUNTS)
    replies = asked.groupBy("bucket").applyInPandas(_sum, REPLY)
    # The whole corpus's two numbers come as a scalar subquery over the same exchange.
    whole = replies.agg(F.array(F.sum("n"), F.sum("v"))).scalar()
    replies = replies.where("block >= 0").drop("n", "v").withColumn("whole", whole)
    out = ("lm_held_out", "lm_n_tokens", "lm_n_known", "lm_train_tokens", "lm_base_score", "lm_score")
    kind = "doc_id string, lm_held_out boolean, lm_n_tokens long, lm_n_known long, lm_train_tokens long, lm_base_score double, lm_score double"
    scored = dealt.groupBy(name).cogroup(replies.groupBy("block")).applyInPandas(_score(order, n, mu, out, ["doc_id"]), kind)
    return scored.withColumn("doc_id", F.col("doc_id").cast("long"))  # as text before, since pandas would turn ids into floats beside a null
