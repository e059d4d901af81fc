"""Line dedup: lines that many documents share go, but for the last document that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import BLANKS, ascii_lower, free_name, slices, small_or_not


def line_keys(text: Column) -> Column:
    """For each line its key: blanks stripped at both ends, A-Z lower-cased."""
    return F.transform(F.split(ascii_lower(text), "\n"), lambda x: F.trim(x, F.lit(BLANKS)))


def line_dedup(docs: DataFrame, doc_id="doc_id", text="text", min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """`docs` with the text that is left in `text`, and ld_n_lines and ld_n_dropped.

    A key of at least `min_chars` code points that at least `min_docs` distinct ids hold loses all its lines except in
    the largest id that holds it. Keys are compared by their MD5 digests. Counting distinct ids deals the pairs of
    digest and id, so that a line of a third of all documents is counted by many tasks; the common keys are set down
    then, and broadcast if they are few, else joined in a way that may split a hot key. Null or empty text is one empty
    line, and what is left of null is empty. Rows without an id don't count as documents and keep their lines; rows
    that repeat an id are one document. Ties can't be: the largest id is one. No rows give no rows. A text of any length
    is one row of a task, whole. Other columns pass through; names of this function's that are taken get underscores.
    """
    who, keys, drop, lines = (free_name(docs, f"ld_{x}") for x in ("id", "keys", "drop", "lines"))
    whole = F.coalesce(F.col(text), F.lit(""))
    long = F.filter(line_keys(whole), lambda x: F.char_length(x) >= min_chars)
    digest = lambda x: F.unhex(F.md5(x))
    held = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias(who), F.explode(F.transform(F.array_distinct(long), digest)).alias(keys))
    common = held.groupBy(keys).agg(F.count_distinct(who).alias("n"), F.max(who).alias("last")).where(F.col("n") >= min_docs)
    lost = held.join(small_or_not(common, slices(docs)), keys).where(F.col(who) != F.col("last")).groupBy(who).agg(F.collect_set(keys).alias(drop))
    df = docs.join(lost, F.col(doc_id) == F.col(who), "left").drop(who)
    df = df.withColumns({lines: F.split(whole, "\n"), keys: F.when(F.col(drop).isNotNull(), line_keys(whole))})
    n_lines, n_dropped = free_name(docs, "ld_n_lines"), free_name(docs, "ld_n_dropped")
    gone = lambda i: (F.char_length(F.get(F.col(keys), i)) >= min_chars) & F.array_contains(F.col(drop), digest(F.get(F.col(keys), i)))
    left = F.when(F.col(drop).isNull(), F.col(lines)).otherwise(F.filter(F.col(lines), lambda x, i: ~gone(i)))
    df = df.withColumn(keys, left)
    df = df.withColumns({
        n_lines: F.size(lines).cast("long"), n_dropped: (F.size(lines) - F.size(keys)).cast("long"),
        text: F.array_join(keys, "\n"),
    })
    return df.drop(lines, keys, drop)
