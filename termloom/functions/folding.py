"""Folding and cutting of text into words, as Arrow functions. All Unicode decisions are made here."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A form's longest reach beyond an anchor word: forms hold at most so many code points.
MAX_FORM = 128
#: Characters of text whose words are held at a time.
STRETCH = 1 << 20
_RUN = re.compile(r"\w+")
_SPACE = re.compile(r"\s")


@cache
def _folded_char(c: str, strip: bool) -> str:
    if strip:
        c = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
    return c.casefold()


def fold(text: str, strip: bool = True) -> str:
    """Case-folded text; with `strip`, decomposed and freed of accents first. Character by character."""
    return text.lower() if text.isascii() else "".join([_folded_char(c, strip) for c in text])


def fold_with_origins(text: str, strip: bool = True) -> tuple[str, list[int] | None]:
    """The folded text, and for each of its characters where it comes from; None if each stays in its place."""
    if text.isascii():
        return text.lower(), None
    parts = [_folded_char(c, strip) for c in text]
    folded = "".join(parts)
    if len(folded) == len(text) and all(len(p) == 1 for p in parts):
        return folded, None
    return folded, [i for i, p in enumerate(parts) for _ in p]


def original_span(origins: list[int] | None, start: int, end: int) -> tuple[int, int]:
    """Where a span of the folded text lies in the text itself."""
    if not 0 <= start < end:
        raise ValueError(f"not a span: {start}, {end}")
    return (start, end) if origins is None else (origins[start], origins[end - 1] + 1)


def strips(locale: str) -> bool:
    """Whether a locale's text is freed of accents: all languages but Arabic."""
    return locale.split("-", 1)[0].casefold() != "ar"


def alone(text: str, start: int, end: int) -> bool:
    """Whether neither neighbour of a span is a word character."""
    return not (start > 0 and _RUN.match(text[start - 1])) and not (end < len(text) and _RUN.match(text[end]))


TOKEN = "struct<t:string,s:int,e:int,os:int,oe:int,word:boolean,before:string,after:string,edges:string,origins:array<int>>"


def tokens_of(text: str, strip: bool, wordless: tuple[str, ...] = (), reach: int = 0) -> list[tuple]:
    """All words of a folded text as rows of TOKEN.

    s, e and os, oe are spans in the folded and in the original text. With `reach`, `before` and `after` are what lies
    around a word's start, as far as a form that has the word as its anchor can go; `edges` has a w for each of their
    characters that belongs to words, and `origins` maps them where folding moved characters. `wordless` forms, which no
    word leads to, are looked for right here, at every place where they stand alone.
    """
    folded, origins = fold_with_origins(text, strip)
    rows = []
    for m in _RUN.finditer(folded):
        s, e = m.span()
        before = after = edges = moved = None
        if reach:
            a, z = max(0, s - reach - 1), s + reach + 1
            before, after, edges = folded[a:s], folded[s:z], "".join("w" if _RUN.match(c) else "-" for c in folded[a:z])
            moved = None if origins is None else origins[a:z]
        rows.append((m[0], s, e, *original_span(origins, s, e), True, before, after, edges, moved))
    for form in wordless:
        at = folded.find(form)
        while at >= 0:
            if alone(folded, at, at + len(form)):
                rows.append((form, at, at + len(form), *original_span(origins, at, at + len(form)), False, "", form, "", None))
            at = folded.find(form, at + 1)
    return rows


_NAMES = [x.split(":")[0] for x in TOKEN.removeprefix("struct<").split(",")]


def tokens(text: Column, strip: Column, wordless: tuple[str, ...] = (), reach: int = 0) -> Column:
    """tokens_of() as a column; null text gives null."""

    def over(texts: pd.Series, stripped: pd.Series) -> pd.Series:
        return pd.Series([
            None if t is None else [dict(zip(_NAMES, row, strict=True)) for row in tokens_of(t, bool(s), wordless, reach)]
            for t, s in zip(texts, stripped, strict=True)
        ])

    return F.pandas_udf(over, f"array<{TOKEN}>")(text, strip)


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """A text in stretches of `size` characters and what is left of a word, cut at white space, which folds to white space."""
    at = 0
    while at + size < len(text) and (m := _SPACE.search(text, at + size)):
        yield text[at : m.start()]
        at = m.start()
    yield text[at:]


def words_of(df: DataFrame, text: Column, strip: bool) -> DataFrame:
    """The words of the folded texts, one row (token) each; null texts have none.

    Words go out stretch by stretch, so a process holds those of a stretch or two beside the batch of texts, however
    many that has.
    """

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, size = [], 0
        for batch in batches:
            for t in batch.column(0):
                for part in stretches(t.as_py() or ""):
                    found += _RUN.findall(fold(part, strip))
                    size += len(part)
                    if size >= STRETCH:
                        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["token"])
                        found, size = [], 0
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.string())], ["token"])

    return df.select(text.alias("text")).mapInArrow(over, "token string")


def folded(text: Column, strip: Column) -> Column:
    """fold() as a column."""

    def over(texts: pd.Series, stripped: pd.Series) -> pd.Series:
        return pd.Series([None if t is None else fold(t, bool(s)) for t, s in zip(texts, stripped, strict=True)])

    return F.pandas_udf(over, "string")(text, strip)
