"""Jargon resolution and training-data operators on Spark: the names that callers use."""

from termloom.functions.reports import EntityMatch, MatchReport, ScoreTier, deserialize_report, serialize_report
from termloom.plans.resolver import EntityResolver
from termloom.sources.lexicon import (
    MAX_PROMPT_LENGTH,
    MAX_SURFACE_FORM_LENGTH,
    Entry,
    Lexicon,
    MalformedDocumentError,
    Metadata,
    MetadataValue,
    SurfaceForms,
    ValidationError,
)

__all__ = [
    "MAX_PROMPT_LENGTH",
    "MAX_SURFACE_FORM_LENGTH",
    "EntityMatch",
    "EntityResolver",
    "Entry",
    "Lexicon",
    "MalformedDocumentError",
    "MatchReport",
    "Metadata",
    "MetadataValue",
    "ScoreTier",
    "SurfaceForms",
    "ValidationError",
    "deserialize_report",
    "serialize_report",
]
