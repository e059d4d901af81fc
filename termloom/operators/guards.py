"""Guards in front of the resolver."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.canonical import ERROR
from termloom.sources.lexicon import MAX_PROMPT_LENGTH


def is_oversize(prompt: Column) -> Column:
    return F.char_length(prompt) > MAX_PROMPT_LENGTH


def is_blank(prompt: Column) -> Column:
    """Whether only white space is there, by Python's notion of it."""
    return prompt.rlike(r"^[\p{IsWhite_Space}\x1c-\x1f]*$")


def too_long(n: int | str) -> str:
    return f"Field 'prompt' has {n} characters, more than the maximum of {MAX_PROMPT_LENGTH}."


def rejection(prompt: Column, locale: Column) -> Column:
    """Why a row is rejected, or null: a prompt that is too long, a locale that is missing."""

    def fault(message: Column, field: str) -> Column:
        none = F.lit(None).cast("string")
        return F.struct(message.alias("message"), none.alias("canonical_id"), none.alias("locale"), F.lit(field).alias("field")).cast(ERROR)

    before, after = too_long("|").split("|")
    long = F.concat(F.lit(before), F.char_length(prompt).cast("string"), F.lit(after))
    return F.when(is_oversize(prompt), fault(long, "prompt")).when(prompt.isNotNull() & locale.isNull(), fault(F.lit("Field 'locale' is missing."), "locale"))
