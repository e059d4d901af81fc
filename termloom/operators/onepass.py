"""A lexicon compiled for one text at a time: words, claims and the choice among them in a single pass over the text."""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from termloom.functions.canonical import MATCH
from termloom.functions.folding import alone, fold_with_origins, original_span, strips
from termloom.functions.similarity import damerau_levenshtein, jaro_winkler

#: The least similarity of a correction (a fixed value), and how many words' answers a process keeps.
FLOOR, REMEMBERED = 0.90, 1 << 17
_RUN = re.compile(r"\w+")


def letters(text: str) -> int:
    """Which letters a text has, as bits. An edit changes two of them at most."""
    out = 0
    for c in text:
        out |= 1 << (ord(c) & 63)
    return out


class _Locale:
    """The forms of one locale, by what leads to them."""

    def __init__(self, forms: list[dict], fuzzy: bool):
        self.strip = bool(forms) and strips(forms[0]["locale"])
        self.by_anchor, self.near, self.pairs = defaultdict(list), defaultdict(list), defaultdict(list)
        self.wordless = [f for f in forms if f["wordless"]]
        self.words: dict[str, tuple] = {}
        self.spelled: dict[str, dict | None] = {}
        for f in forms:
            if not f["wordless"]:
                self.by_anchor[f["anchor"]].append(f)
            if fuzzy and f["budget"] and f["tier"] != "canonical":
                for n in range(f["form_len"] - f["budget"], f["form_len"] + f["budget"] + 1):
                    (self.pairs if f["spaced"] else self.near)[n].append((letters(f["folded"]), 2 * f["budget"], f))

    def nearest(self, text: str, forms: dict) -> dict | None:
        """The form within its edit budget that is most similar, then least distant, then first by tier and names."""
        best, own = None, letters(text)
        for other, most, f in forms.get(len(text), ()):
            if (own ^ other).bit_count() > most:
                continue
            form = f["folded"]
            if (s := jaro_winkler(text, form)) >= FLOOR and (d := damerau_levenshtein(text, form)) <= f["budget"]:
                rank = (-s, d, f["tier_rank"], f["canonical_id"], f["entry_id"], form)
                if best is None or rank < best[0]:
                    best = rank, f
        return best and best[1]

    def of_word(self, word: str) -> tuple:
        """The forms that a word may stand for exactly, and the one that corrects it. Answers are kept, some at a time."""
        if (known := self.words.get(word)) is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            known = self.words[word] = (self.by_anchor.get(word, ()), self.nearest(word, self.near) if self.near else None)
        return known

    def of_pair(self, a: str, b: str) -> dict | None:
        """What corrects two neighbours, as typed or else swapped."""
        if len(a) + 1 + len(b) not in self.pairs:
            return None
        for text in (f"{a} {b}", f"{b} {a}"):
            if text not in self.spelled:
                if len(self.spelled) >= REMEMBERED:
                    self.spelled.clear()
                self.spelled[text] = self.nearest(text, self.pairs)
            if f := self.spelled[text]:
                return f
        return None

    def claims(self, text: str, runs: list[tuple]) -> list[tuple]:
        """(fuzzy, -size, tier, start, entity, entry, end, form) of all that may stand in a folded text."""
        exact, typed = [], []
        for t, s, e in runs:
            spelled, corrected = self.of_word(t)
            for f in spelled:
                a = s - f["anchor_off"]
                if f["plain"]:
                    exact.append((s, e, f))
                elif a >= 0 and text.startswith(f["folded"], a) and alone(text, a, a + f["form_len"]):
                    exact.append((a, a + f["form_len"], f))
            if corrected:
                typed.append((s, e, e, e, corrected))
        for f in self.wordless:
            a = text.find(f["folded"])
            while a >= 0:
                if alone(text, a, a + f["form_len"]):
                    exact.append((a, a + f["form_len"], f))
                a = text.find(f["folded"], a + 1)
        if self.pairs:
            for (t, s, e), (u, us, ue) in zip(runs, runs[1:], strict=False):
                if f := self.of_pair(t, u):
                    typed.append((s, e, us, ue, f))
        covered = bytearray(len(text)) if typed else b""
        for a, z, _ in exact if typed else ():
            covered[a:z] = b"\1" * (z - a)
        # A correction stands aside where an exact form, even one that loses later, touches one of its words.
        free = [(s, ue, f) for s, e, us, ue, f in typed if covered.find(1, s, e) < 0 and covered.find(1, us, ue) < 0]
        return [
            (fuzzy, a - z, f["tier_rank"], a, f["canonical_id"], f["entry_id"], z, f["form_id"])
            for fuzzy, found in ((0, exact), (1, free)) for a, z, f in found
        ]


class Compiled:
    """All locales of a lexicon, and the chains that lead to them."""

    def __init__(self, forms: list[dict], chains: dict[str, list[str]], fuzzy: bool):
        self.forms, self.chains, self.fuzzy = forms, chains, fuzzy
        by_tag = defaultdict(list)
        for f in forms:
            by_tag[f["locale"]].append(f)
        self.locales = {tag: _Locale(own, fuzzy) for tag, own in by_tag.items()}

    def key(self, locale: str) -> str:
        """The key of a requested locale's chain."""
        tag = locale.lower()
        return next((k for k in (tag, tag.split("-", 1)[0]) if k and k in self.chains), "")

    def resolve(self, prompt: str, key: str) -> list[tuple[int, int, int, int]]:
        """(form, start, end, fuzzy) in the original text of what stands, by the first locale in which anything does."""
        folded: dict[bool, tuple] = {}
        for tag in self.chains[key]:
            if (own := self.locales.get(tag)) is None:
                continue
            if own.strip not in folded:
                text, origins = fold_with_origins(prompt, own.strip)
                folded[own.strip] = text, origins, [(m[0], *m.span()) for m in _RUN.finditer(text)]
            text, origins, runs = folded[own.strip]
            if not (claims := own.claims(text, runs)):
                continue
            claims.sort()
            taken, kept = bytearray(len(text)), []
            for fuzzy, _, _, a, _, _, z, form in claims:
                if taken.find(1, a, z) < 0:
                    taken[a:z] = b"\1" * (z - a)
                    kept.append((a, z, form, fuzzy))
            return [(form, *original_span(origins, a, z), fuzzy) for a, z, form, fuzzy in sorted(kept)]
        return []


ANSWER = f"struct<locale:string,matches:array<{MATCH}>>"
_TAKEN = {"canonical_id": "canonical_id", "entry_id": "entry_id", "surface_form": "surface_form", "score_tier": "tier", "matched_locale": "locale", "metadata": "metadata"}


def resolved(compiled: Compiled, prompt: Column, key: Column) -> Column:
    """The locale that answers a prompt and its matches, as one Arrow function on the row; null for a null prompt."""
    forms = compiled.forms

    def over(prompts: pa.Array, keys: pa.Array) -> pa.Array:
        said = {k: pa.array([f[v] for f in forms], pa.string()) for k, v in _TAKEN.items()}
        offsets, ids, starts, ends, corrections, locales = [0], [], [], [], [], []
        for p, k in zip(prompts.to_pylist(), keys.to_pylist(), strict=True):
            found = [] if p is None else compiled.resolve(p, k)
            for form, a, z, fuzzy in found:
                ids.append(form)
                starts.append(a)
                ends.append(z)
                corrections.append(p[a:z] if fuzzy else None)
            locales.append(forms[found[0][0]]["locale"] if found else None)
            offsets.append(len(ids))
        which = pa.array(ids, pa.int32())
        own = {k: v.take(which) for k, v in said.items()} | {"span_start": pa.array(starts, pa.int32()), "span_end": pa.array(ends, pa.int32()), "correction": pa.array(corrections, pa.string())}
        order = [x.split(":")[0] for x in MATCH.removeprefix("struct<").removesuffix(">").split(",")]
        matches = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([own[c] for c in order], order))
        return pa.StructArray.from_arrays([pa.array(locales, pa.string()), matches], ["locale", "matches"], mask=prompts.is_null())

    # Said to be nondeterministic, so that no filter on an answer is pushed below it, where it would be found once more.
    return F.arrow_udf(over, ANSWER).asNondeterministic()(prompt, key)
