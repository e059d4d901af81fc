"""Reports as Python values, for single prompts outside of tables."""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from enum import Enum

from termloom.functions.canonical import deserialize, serialize
from termloom.sources.lexicon import Metadata


class ScoreTier(str, Enum):
    """How a form is declared, best first."""

    PREFERRED = "preferred"
    ALTERNATE = "alternate"
    CANONICAL = "canonical"


@dataclass(frozen=True)
class EntityMatch:
    """A form found in a prompt. `span` counts code points; `correction` is what was typed, if it isn't the form."""

    canonical_id: str
    entry_id: str
    surface_form: str
    span: tuple[int, int]
    score_tier: ScoreTier
    matched_locale: str
    correction: str | None = None
    metadata: Metadata = field(default_factory=Metadata)


@dataclass(frozen=True)
class MatchReport:
    """A prompt, the locale that answered (or was asked for), and what was found, in the prompt's order."""

    prompt: str
    locale: str
    matches: tuple[EntityMatch, ...] = ()


def from_row(row: dict) -> MatchReport:
    """A report out of its row in a table."""
    return MatchReport(row["prompt"], row["locale"], tuple(
        EntityMatch(
            m["canonical_id"], m["entry_id"], m["surface_form"], (m["span_start"], m["span_end"]), ScoreTier(m["score_tier"]),
            m["matched_locale"], m["correction"], Metadata(json.loads(m["metadata"])),
        ) for m in row["matches"]
    ))


def to_row(report: MatchReport) -> dict:
    """A report as its row in a table."""
    return {"prompt": report.prompt, "locale": report.locale, "error": None, "matches": [
        {
            "canonical_id": m.canonical_id, "entry_id": m.entry_id, "surface_form": m.surface_form, "span_start": m.span[0], "span_end": m.span[1],
            "score_tier": m.score_tier.value, "matched_locale": m.matched_locale, "correction": m.correction, "metadata": m.metadata.json(),
        } for m in report.matches
    ]}


def serialize_report(report: MatchReport) -> str:
    """Canonical JSON; the same report always gives the same text."""
    return serialize(to_row(report))


def deserialize_report(text: str) -> MatchReport:
    return from_row(deserialize(text))
