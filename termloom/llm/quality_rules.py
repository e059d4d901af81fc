"""Quality rules: a table of thresholds compiled into one projection, without user functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from termloom.llm.common import WORD

#: Frequent words of English, German, French and Spanish (fixed values).
STOP_WORDS = (
    "a an and are as at be by for from has he in is it its of on or that the this to was were will with "
    "als auch auf aus bei das dem den der des die ein eine er es für im ist mit nicht sich sie sind und von zu "
    "au aux avec ce dans de des du elle en est et il la le les ne pas pour par que qui sur un une "
    "con del el ella ha las lo los más no para por se su sus una y"
).split()

#: measure, comparison, bound: a document breaks a rule where the comparison doesn't hold. Ratios are of the words, or
#: of the lines that hold a word; stop words count one more than there are, so that short texts may have none.
RULES = (
    ("n_words", ">=", 10),
    ("mean_word_chars", ">=", 1.5),
    ("mean_word_chars", "<=", 20.0),
    ("symbol_ratio", "<=", 0.3),
    ("stop_ratio", ">=", 0.02),
    ("dup_line_ratio", "<=", 0.5),
    ("repeat_ratio", "<=", 0.2),
)


def _with(df: DataFrame, **columns: Column) -> DataFrame:
    return df.withColumns(columns)


def measure(docs: DataFrame, text: str = "text", prefix: str = "q_") -> DataFrame:
    """`docs` with the counts that the rules are made of, named with `prefix`. Null text has no words.

    n_repeat_words: words inside a window of five words that the text holds twice or more. Equal 64-bit hashes only
    say where to look: a text whose windows hash alike is settled by sorting the windows' own words.
    """
    p = prefix
    t = F.coalesce(F.col(text), F.lit(""))
    bare = lambda keep: F.char_length(F.regexp_replace(t, keep, ""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _with(docs, **{
        f"{p}w": F.regexp_extract_all(t, F.lit(WORD), F.lit(0)),
        f"{p}l": lines,
        f"{p}word_chars": bare(r"[\x20\x09-\x0D]+").cast("long"),
        f"{p}n_symbols": bare(r"[^#*$%&|<>]+").cast("long"),
    })
    w, n = F.col(f"{p}w"), F.size(f"{p}w")
    near = F.when(n >= 5, F.transform(F.sequence(F.lit(0), n - 5), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(5)))))
    df = _with(df, **{
        f"{p}n_words": n.cast("long"),
        f"{p}n_lines": F.size(f"{p}l").cast("long"),
        f"{p}n_dup_lines": (F.size(f"{p}l") - F.size(F.array_distinct(f"{p}l"))).cast("long"),
        f"{p}n_stop": F.size(F.filter(w, lambda x: F.lower(x).isin(*STOP_WORDS))).cast("long"),
        f"{p}h": near,
    })
    h = F.col(f"{p}h")
    # Windows in the order of their words, then the starts of those that equal a neighbour, then the words they cover.
    window = lambda i: F.struct(F.array_join(F.slice(w, i + 1, F.lit(5)), " ").alias("s"), i.alias("i"))
    df = _with(df, **{f"{p}s": F.when(
        F.size(F.array_distinct(h)) < F.size(h), F.array_sort(F.transform(F.sequence(F.lit(0), n - 5), window))
    )})
    s = F.col(f"{p}s")
    same = F.transform(s, lambda x, k: F.when(
        ((k > 0) & (F.get(s, k - 1)["s"] == x["s"])) | (F.get(s, k + 1)["s"] == x["s"]), x["i"]
    ))
    df = _with(df, **{f"{p}at": F.array_sort(F.filter(same, lambda x: x.isNotNull()))})
    at = F.col(f"{p}at")
    covered = F.aggregate(
        F.transform(at, lambda x, k: F.least(F.lit(5), F.coalesce(F.get(at, k + 1) - x, F.lit(5))).cast("long")),
        F.lit(0).cast("long"), lambda a, x: a + x,
    )
    return _with(df, **{f"{p}n_repeat_words": F.coalesce(covered, F.lit(0).cast("long"))}).drop(f"{p}w", f"{p}l", f"{p}h", f"{p}s", f"{p}at")


def compile_rules(rules=RULES, prefix: str = "q_") -> Column:
    """The table as one boolean expression: true where every rule holds."""
    p = lambda c: F.col(f"{prefix}{c}").cast("double")
    n, lines = F.greatest(p("n_words"), F.lit(1.0)), F.greatest(p("n_lines"), F.lit(1.0))
    measures = {
        "n_words": p("n_words"), "mean_word_chars": p("word_chars") / n, "symbol_ratio": p("n_symbols") / n,
        "stop_ratio": (p("n_stop") + 1) / n, "dup_line_ratio": p("n_dup_lines") / lines, "repeat_ratio": p("n_repeat_words") / n,
    }
    test = {">=": lambda a, b: a >= b, "<=": lambda a, b: a <= b}
    return reduce(lambda a, b: a & b, (test[op](measures[m], F.lit(float(v))) for m, op, v in rules), F.lit(True))


def quality_rules(docs: DataFrame, text: str = "text", rules=RULES, prefix: str = "q_") -> DataFrame:
    """`docs` with the counts of `measure` and, under `prefix`, base_failed and kept.

    base_failed: fewer than 10 words, or more than 20 of 100 words repeated. kept: not base_failed and all rules hold.
    Null and empty texts fail; repeated rows are judged alike, with or without an id; ties can't be; no rows give no
    rows; a text of any length is measured whole, in its own row; columns of the input stay, and underscores are put
    before the prefix where a name is taken.
    """
    while any(c.lower().startswith(prefix.lower()) for c in docs.columns):
        prefix = f"_{prefix}"
    df = measure(docs, text, prefix)
    n, again = F.col(f"{prefix}n_words"), F.col(f"{prefix}n_repeat_words")
    df = df.withColumn(f"{prefix}base_failed", (n < 10) | (100 * again > 20 * n))
    df = df.withColumn(f"{prefix}kept", ~F.col(f"{prefix}base_failed") & compile_rules(rules, prefix))
    # A filter on the verdict must not be pushed below the measures, where it would spell them out over and over.
    made = [c for c in df.columns if c not in docs.columns]
    return df.select(*docs.columns, F.inline(F.array(F.struct(*made))))
