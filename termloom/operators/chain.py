"""Fallback chains of locales."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.sources.lexicon import Lexicon, ValidationError


def _distinct(tags) -> list[str]:
    out: dict[str, str] = {}
    for tag in tags:
        if tag is not None:
            out.setdefault(tag.casefold(), tag)
    return list(out.values())


def language(tag: str) -> str:
    return tag.split("-", 1)[0].casefold()


def default_chain(requested: str, declared: dict[str, str], default: str) -> list[str]:
    """The requested locale, its language's declared locales in the order of their folded tags, the default locale; as
    far as they are declared, each once."""
    kin = [declared[k] for k in sorted(declared) if language(k) == language(requested)]
    return _distinct([declared.get(requested.casefold()), *kin, declared.get(default.casefold())])


def explicit_chain(chain, declared: dict[str, str]) -> list[str]:
    """A chain that the caller gives, in the lexicon's spellings; it must name a declared locale."""
    out = _distinct(declared.get(tag.casefold()) for tag in chain)
    if not out:
        raise ValidationError("Field 'fallback_chain' names no locale that the lexicon declares.", field="fallback_chain")
    return out


def chains(lexicon: Lexicon, explicit=None) -> dict[str, list[str]]:
    """All chains that prompts can have, by chain key: as many as the lexicon has locales and languages, plus one.

    A requested locale's key is itself if it is declared, else its language if that is, else the empty string."""
    declared = lexicon.declared()
    if explicit is not None:
        return {"": explicit_chain(explicit, declared)}
    keys = {*declared, *map(language, declared), ""}
    return {k: default_chain(k, declared, lexicon.default_locale) for k in keys}


def chain_key(locale: Column, keys) -> Column:
    """The key of a requested locale's chain."""
    tag = F.lower(locale)
    head = F.substring_index(tag, "-", 1)
    known = sorted(k for k in keys if k)
    if not known:
        return F.lit("")
    return F.when(tag.isin(known), tag).when(head.isin(known), head).otherwise(F.lit(""))
