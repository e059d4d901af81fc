"""Shared parts of the training-data operators: expressions, checkpoints, byte-level words."""

from __future__ import annotations

import string

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import termloom
from termloom.operators.folders import shared_folder
from termloom.operators.names import free_name as _free

# Executors may not have this package on their path; its functions travel with the plan.
cloudpickle.register_pickle_by_value(termloom)

#: The white space of the contracts, [\x20\x09-\x0D].
BLANKS = " \t\n\x0b\f\r"
WORD = r"[^\x20\x09-\x0D]+"


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z and nothing else. lower() has a fast path for text that is ASCII throughout."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(
        F.translate(c, string.ascii_uppercase, string.ascii_lowercase)
    )


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stable(df: DataFrame) -> DataFrame:
    """`df` cut off from its lineage in the shared checkpoint folder, so that a lost executor loses nothing."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def snug(df: DataFrame, most: int | None = None, rows: int = 1 << 14) -> DataFrame:
    """`df` cut off from its lineage, in as many partitions as its counted rows ask for, some `rows` each: a small table
    then doesn't cost every later exchange a file a task. `most`: a bound on its rows that is known beforehand."""
    df = stable(df if most is None else df.coalesce(1 + most // rows))
    return df.coalesce(1 + df.count() // rows)


def slices(df: DataFrame, size: int = 4 << 20) -> int:
    """Into how many parts of `size` bytes the planner's estimate divides what `df` reads: a task has that much at least."""
    return min(1 << 24, 1 + int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // size)


#: Rows of whole texts that go to a Python worker at a time.
ARROW_ROWS = 1000


def small_batches(df: DataFrame) -> DataFrame:
    """`df`; its session sends at most ARROW_ROWS rows per Arrow batch from now on, as whole texts can be long."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= ARROW_ROWS:
        conf.set(key, ARROW_ROWS)
    return df


def small_or_not(df: DataFrame, parts: int | None = None, rows: int = 50_000) -> DataFrame:
    """`df`, checkpointed (in so many parts at most), with a broadcast hint only if it has been counted to hold at most
    `rows` rows; callers' rows are of a bounded width."""
    df = stable(df if parts is None else df.coalesce(parts))
    return F.broadcast(df) if df.count() <= rows else df


def free_name(df: DataFrame, name: str) -> str:
    """A column name that `df` doesn't have yet."""
    return _free(df.columns, name)


# ---------------------------------------------------------------- bytes and words in numpy

K = np.uint64(0x9E3779B97F4A7C15)
#: Bytes for which a hash is worked out at once.
STRETCH = 1 << 18
K_INV = np.uint64(pow(int(K), -1, 1 << 64))
_powers: dict[int, np.ndarray] = {}


def powers(k: np.uint64, n: int) -> np.ndarray:
    """k**0 ... k**(n-1) modulo 2**64."""
    got = _powers.get(int(k))
    if got is None or len(got) < n:
        size = max(n, 1 << 16)
        got = np.full(size, k, dtype=np.uint64)
        got[0] = 1
        np.multiply.accumulate(got, out=got)
        if size <= 1 << 24:
            _powers[int(k)] = got
    return got[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """The bijective finaliser of splitmix64 (Steele, Lea and Flood, 2014)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts in a row, and where each begins; the last offset is the end. Null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    o = np.frombuffer(offs, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    b = np.frombuffer(data, np.uint8)[o[0] : o[-1]] if data is not None else np.zeros(0, np.uint8)
    return b, o - o[0]


def lower_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def not_blank() -> np.ndarray:
    t = np.ones(256, bool)
    t[[32, 9, 10, 11, 12, 13]] = False
    return t


def alnum_or_high() -> np.ndarray:
    """Of [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F] once lower-cased: digits, letters, and all beyond ASCII."""
    t = np.zeros(256, bool)
    t[48:58] = t[65:91] = t[97:123] = t[128:] = True
    return t


LOWER, NOT_BLANK, ALNUM = lower_table(), not_blank(), alnum_or_high()


def words(b: np.ndarray, offs: np.ndarray, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the index of each text's first word (with the total at the end)."""
    if not len(b):
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    m = is_word[b]
    first, last = m.copy(), m.copy()
    first[1:] &= ~m[:-1]
    last[:-1] &= ~m[1:]
    full = np.flatnonzero(np.diff(offs))
    first[offs[full]] = m[offs[full]]
    last[offs[full + 1] - 1] = m[offs[full + 1] - 1]
    starts = np.flatnonzero(first)
    return starts, np.flatnonzero(last) + 1, np.searchsorted(starts, offs)


def prefix_hash(b: np.ndarray) -> np.ndarray:
    """Prefix sums of a polynomial in K over the bytes, from which any substring's hash follows."""
    out = np.zeros(len(b) + 1, np.uint64)
    np.cumsum((b.astype(np.uint64) + np.uint64(1)) * powers(K, len(b)), out=out[1:])
    return out


def word_hashes(b: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of lower-cased words, worked out a stretch of the text at a time to save memory."""
    out, i, n = np.empty(len(starts), np.uint64), 0, len(starts)
    while i < n:
        a = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, a + STRETCH, "right")))
        p = prefix_hash(LOWER[b[a : ends[j - 1]]])
        out[i:j] = mix((p[ends[i:j] - a] - p[starts[i:j] - a]) * powers(K_INV, int(ends[j - 1] - a) + 1)[starts[i:j] - a])
        i = j
    return out


def pack(keys: np.ndarray) -> bytes:
    """64-bit keys, best in order, as differences laid out byte plane by byte plane: the high planes are all but empty,
    which the shuffle's compression uses."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return steps.view(np.uint8).reshape(-1, 8).T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def chunks(offs: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of texts of up to `most` bytes each, or of one longer text."""
    out, i, n = [], 0, len(offs) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + most, "right")) - 1)
        out.append((i, j))
        i = j
    return out
