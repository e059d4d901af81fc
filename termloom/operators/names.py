"""Names that a table doesn't have."""

from __future__ import annotations

from collections.abc import Iterable


def free_name(taken: Iterable[str], name: str) -> str:
    """`name`, with as many underscores in front as it takes."""
    taken = {c.lower() for c in taken}
    while name.lower() in taken:
        name = f"_{name}"
    return name
