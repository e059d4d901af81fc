"""The resolver in SQL: functions, and a table function for prompts."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from termloom.functions.canonical import MATCH
from termloom.functions.folding import fold
from termloom.functions.similarity import damerau_levenshtein, jaro_winkler
from termloom.plans.resolver import FIELDS, EntityResolver


def register_functions(spark: SparkSession) -> None:
    """fold_text(text, strip), dl_distance(a, b) and jw_similarity(a, b), over Arrow batches."""
    def each(f, kind):
        def over(a: pd.Series, b: pd.Series) -> pd.Series:
            return pd.Series([None if x is None or y is None else f(x, y) for x, y in zip(a, b, strict=True)], dtype=object)

        return F.pandas_udf(over, kind)

    spark.udf.register("fold_text", each(lambda t, s: fold(t, bool(s)), "string"))
    spark.udf.register("dl_distance", each(damerau_levenshtein, "int"))
    spark.udf.register("jw_similarity", each(jaro_winkler, "double"))


def register_lexicon(spark: SparkSession, resolver: EntityResolver, name: str) -> None:
    """Views `name`_forms and `name`_chains, so that plain SQL can join what a lexicon holds."""
    resolver.forms_table(spark).createOrReplaceTempView(f"{name}_forms")
    rows = [(k, i, tag) for k, chain in resolver.chains.items() for i, tag in enumerate(chain)]
    spark.createDataFrame(rows, "chain string, pos int, locale string").createOrReplaceTempView(f"{name}_chains")


def resolve_view(spark: SparkSession, resolver: EntityResolver, view: str, out: str, prompt="prompt", locale="locale") -> None:
    """The matches of a view's rows as another view: resolution by the distributed plan, from and to SQL."""
    resolver.matches(spark.table(view), prompt, locale).createOrReplaceTempView(out)


def register_table_function(spark: SparkSession, resolver: EntityResolver, name: str = "resolve_prompt") -> None:
    """`SELECT * FROM resolve_prompt(prompt, locale)`: a prompt's matches, by all rules of the resolver, for lateral joins
    too. A null prompt has none; a rejected one fails the query."""

    class ResolvePrompt:
        def eval(self, prompt: str, locale: str):
            if prompt is not None:
                for m in resolver.report_of(prompt, locale)["matches"]:
                    yield tuple(m[c] for c in FIELDS)

    kinds = MATCH.removeprefix("struct<").removesuffix(">").replace(":", " ").replace(",", ", ")
    spark.udtf.register(name, F.udtf(ResolvePrompt, returnType=kinds))
