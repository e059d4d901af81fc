"""Shared by the tests of the training-data operators."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus(seed=5, n=60):
    """Texts with copies, near copies, shared lines and passages, and the odd ones: null, empty, short, long, blank,
    accented, with control characters."""
    rng = random.Random(seed)
    vocabulary = ["the", "of", "and", "de", "la", "und", *("".join(rng.choices("abcdeéñßAB", k=rng.randint(1, 9))) for _ in range(150))]
    say = lambda k: " ".join(rng.choices(vocabulary, k=k))
    lines, passage = [say(12) for _ in range(3)], say(60)
    texts = []
    for i in range(n):
        kind = i % 6
        if kind == 1 and texts:
            t = rng.choice(texts)
        elif kind == 2 and texts:
            w = (rng.choice(texts) or "x").split(" ")
            for _ in range(rng.randint(1, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            t = " ".join(w)
        else:
            t = "\n".join(say(rng.randint(1, 60)) for _ in range(rng.randint(1, 6)))
        if kind in (3, 4):
            t = f"{t}\n  {rng.choice(lines).upper() if kind == 3 else rng.choice(lines)}\t\n{say(5)}"
        if kind == 5:
            t = f"{say(9)} {passage} {say(9)}"
        texts.append(t)
    odd = [None, "", " \t\n", "one", "two words", "\n\n", "a\x00b\x01 c", "\U0001f600 " * 40, say(4) + "\r\n" + say(30), "x" * 30_000, say(3000), "x y z x y z x y z x y z x y z"]
    return [(i * 3 + 1, t, "en", f"s{i % 4}" if i % 7 else None, None if t is None else len(t)) for i, t in enumerate([*texts, *odd])]
