"""Reports and load outcomes as text for a terminal."""

from __future__ import annotations

import json

from termloom.sources.lexicon import MalformedDocumentError, ValidationError


def marked(prompt: str, matches: list[dict]) -> str:
    """The prompt with brackets around what matched."""
    edges = sorted([(m["span_start"], 1, "[") for m in matches] + [(m["span_end"], 0, "]") for m in matches])
    out, at = [], 0
    for place, _, bracket in edges:
        out += [prompt[at:place], bracket]
        at = place
    return "".join([*out, prompt[at:]])


def filter_text(metadata: str) -> str:
    """A filter as key=value pairs, with values as the lexicon spells them."""

    def said(value) -> str:
        if isinstance(value, list):
            return "|".join(value)
        return value if isinstance(value, str) else json.dumps(value)

    return ", ".join(f"{k}={said(v)}" for k, v in json.loads(metadata).items())


def report_text(report: dict) -> str:
    matches = report["matches"]
    lines = [f'prompt: "{marked(report["prompt"], matches)}"', f"resolved via: {report['locale']}"]
    if not matches:
        return "\n".join([*lines, "no match"])
    lines.append(f"{len(matches)} match{'es' * (len(matches) > 1)}:")
    for i, m in enumerate(matches, 1):
        found = report["prompt"][m["span_start"] : m["span_end"]]
        lines += ["", f'  [{i}] {m["canonical_id"]} ← "{m["surface_form"]}"']
        lines.append(f'      tier: {m["score_tier"]}   locale: {m["matched_locale"]}   text: "{found}"')
        more = {
            "entry": m["entry_id"] if m["entry_id"] != m["canonical_id"] else None,
            "filter": filter_text(m["metadata"]) or None,
            "correction": None if m["correction"] is None else f'"{m["correction"]}"',
        }
        lines += [f"      {k}: {v}" for k, v in more.items() if v is not None]
    return "\n".join(lines)


def valid_text(source: str) -> str:
    return f"{source}: valid lexicon."


def unreadable_text(source: str, error: OSError) -> str:
    return f"termloom: cannot read {source}: {error.strerror or error}"


def malformed_text(error: MalformedDocumentError) -> str:
    return f"termloom: {error.message}"


def faults_text(source: str, errors: list[ValidationError]) -> str:
    """All faults in the order of entry, locale, field and message."""
    ordered = sorted(errors, key=lambda e: (e.canonical_id or "", e.locale or "", e.field or "", e.message))
    head = f"{source}: invalid lexicon, {len(ordered)} error{'s' * (len(ordered) != 1)}."
    return "\n".join([head, *(f"  - {e.message}" for e in ordered)])
