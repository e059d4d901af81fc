"""One prompt resolved by straight-line Python, for comparison with the plans."""

import re

from termloom.functions.folding import fold_with_origins, original_span, strips
from termloom.functions.similarity import damerau_levenshtein, jaro_winkler
from termloom.operators.chain import chains, default_chain
from termloom.sources.lexicon import Lexicon


def word(c):
    return bool(re.match(r"\w", c))


def touch(a, b):
    return a[0] < b[1] and b[0] < a[1]


def nearest(text, forms):
    found = []
    for f in forms:
        d, s = damerau_levenshtein(text, f["folded"]), jaro_winkler(text, f["folded"])
        if f["budget"] and d <= f["budget"] and s >= 0.9:
            found.append(((-s, d, f["tier_rank"], f["canonical_id"], f["entry_id"], f["folded"]), f))
    return min(found, key=lambda x: x[0])[1] if found else None


def resolve(document, prompt, locale, fuzzy=True, explicit=None):
    lex = Lexicon.from_dict(document)
    declared = lex.declared()
    chain = chains(lex, explicit)[""] if explicit else default_chain(locale, declared, lex.default_locale)
    if not prompt.strip():
        return locale, []
    for tag in chain:
        forms = [f for f in lex.forms() if f["locale"] == tag]
        text, origins = fold_with_origins(prompt, strips(tag))
        claims = []
        for f in forms:
            for s in range(len(text) - len(f["folded"]) + 1):
                e = s + len(f["folded"])
                if text[s:e] == f["folded"] and not (s and word(text[s - 1])) and not (e < len(text) and word(text[e])):
                    claims.append((0, f, s, e))
        covered = [(s, e) for _, _, s, e in claims]
        free = lambda span: not any(touch(span, c) for c in covered)
        if fuzzy:
            spelled = [f for f in forms if f["tier"] != "canonical"]
            one, more = [f for f in spelled if " " not in f["folded"]], [f for f in spelled if " " in f["folded"]]
            runs = [(m[0], m.start(), m.end()) for m in re.finditer(r"\w+", text)]
            for t, s, e in runs:
                if free((s, e)) and (f := nearest(t, one)):
                    claims.append((1, f, s, e))
            for (t, s, e), (u, us, ue) in zip(runs, runs[1:], strict=False):
                if free((s, e)) and free((us, ue)) and (f := nearest(f"{t} {u}", more) or nearest(f"{u} {t}", more)):
                    claims.append((1, f, s, ue))
        kept = []
        for c in sorted(claims, key=lambda c: (c[0], c[2] - c[3], c[1]["tier_rank"], c[2], c[1]["canonical_id"], c[1]["entry_id"])):
            if not any(touch(c[2:], k[2:]) for k in kept):
                kept.append(c)
        if kept:
            out = []
            for fz, f, s, e in sorted(kept, key=lambda c: c[2:]):
                a, z = original_span(origins, s, e)
                out.append((f["canonical_id"], f["entry_id"], f["surface_form"], a, z, f["tier"], tag, prompt[a:z] if fz else None, f["metadata"]))
            return tag, out
    return locale, []
