"""Plain versions of the operators, for small tables."""

import hashlib
import html.parser
import itertools
import math
import re
import zlib
from collections import Counter

LOW = {i: i + 32 for i in range(65, 91)}
BLANKS = " \t\n\x0b\f\r"


def lower(t):
    return (t or "").translate(LOW)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def sha(t):
    return hashlib.sha256(t if isinstance(t, bytes) else t.encode()).hexdigest()


def units(t):
    """(start, end) of lines and of sentences in them."""
    out, a = [], 0
    for k, c in enumerate(t):
        if c == "\n":
            out.append((a, k))
            a = k + 1
        elif c in BLANKS and k > a and t[k - 1] in ".!?":
            out.append((a, k + 1))
            a = k + 1
    return [*out, (a, len(t))]


def substring_dedup(docs, min_words=25, unit_words=3):
    key = lambda x: tuple(words(lower(x)))
    first = {}
    for i, t in sorted((d for d in docs if d[0] is not None), key=lambda d: d[0]):
        for u, (a, z) in enumerate(units(t or "")):
            first.setdefault(key((t or "")[a:z]), (i, u))
    out = {}
    for i, t in docs:
        t, spans, run = t or "", [], []
        for u, (a, z) in [*enumerate(units(t)), (None, (0, 0))]:
            k = key(t[a:z])
            if u is not None and len(k) < unit_words:
                continue
            if u is not None and i is not None and first[k] != (i, u):
                run.append((a, z, k))
            else:
                if sum(len(k) for *_, k in run) >= min_words:
                    spans.append((run[0][0], run[-1][1], *first[run[0][2]]))
                run = []
        kept, at = "", 0
        for a, z, *_ in spans:
            kept, at = kept + t[at:a], z
        out[i] = (spans, kept + t[at:])
    return out


def lm(docs, order=2, mu=200.0):
    toks = {i: [*words(lower(t)), None] for i, t in docs}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in toks}
    c = [Counter() for _ in range(order)]
    for i, x in toks.items():
        if not held[i]:
            for k in range(order):
                c[k].update(zip(*(x[j:] for j in range(k + 1)), strict=False))
    n, v = sum(c[0].values()), len(c[0])

    def p(g):
        if len(g) == 1:
            return (c[0][g] + 1) / (n + v + 1)
        return (c[len(g) - 1][g] + mu * p(g[1:])) / (c[len(g) - 2][g[:-1]] + mu)

    out = {}
    for i, x in toks.items():
        score = sum(math.log10(p(tuple(x[max(0, k - order + 1) : k + 1]))) for k in range(len(x)))
        base = sum(math.log10((c[0][(w,)] + 1) / (n + v + 1)) for w in x)
        out[i] = (held[i], len(x), sum(c[0][(w,)] > 0 for w in x), n, base, score)
    return out


def jaccard(docs):
    sets = {}
    for i, t in docs:
        w = words(lower(t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in sets.items():
        for j, b in sets.items():
            if i < j and a and b and 100 * len(a & b) >= 75 * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: (len(s), find(i)) for i, s in sets.items()}


def suffix_dedup(docs):
    first = {}
    for i, t in sorted(docs):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = {}
    for i, t in docs:
        b = (t or "").encode()
        gone = [False] * len(b)
        for k in range(len(b) - 49):
            if first[b[k : k + 50]] < i:
                gone[k : k + 50] = [True] * 50
        runs = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), runs, sha(bytes(c for c, g in zip(b, gone, strict=True) if not g)))
    return out


def benchmark_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))


def hit_words(docs, items):
    windows = {}
    for item, t in items:
        w = benchmark_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            windows.setdefault(tuple(w[k : k + 13]), set()).add(str(item))
    out = {}
    for i, t in docs:
        w, hit, found = benchmark_words(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    found |= windows[x]
        out[i] = (len(w), hit, sorted(found))
    return out


def line_dedup(docs, min_chars=40, min_docs=5):
    key = lambda x: lower(x.strip(BLANKS))
    held = {}
    for i, t in docs:
        if i is not None:
            for x in (t or "").split("\n"):
                if len(key(x)) >= min_chars:
                    held.setdefault(key(x), set()).add(i)
    last = {k: max(v) for k, v in held.items() if len(v) >= min_docs}
    return {i: "\n".join(x for x in (t or "").split("\n") if i is None or last.get(key(x), i) == i) for i, t in docs}


def repeated_words(w):
    seen = {}
    for k in range(len(w) - 4):
        seen.setdefault(tuple(w[k : k + 5]), []).append(k)
    return len({x for v in seen.values() if len(v) > 1 for k in v for x in range(k, k + 5)})


def targets(sizes, weights=(1, 2, 3), most=3):
    """sizes: source -> words. Fill in rounds: whoever would be above its limit stops there."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    left, open_, out = float(sum(sizes.values())), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if level * weight[s] > most * sizes[s]}
        if not full:
            return out | {s: level * weight[s] for s in open_}
        for s in full:
            out[s] = float(most * sizes[s])
            left -= out[s]
        open_ -= full
    return out


class _Shown(html.parser.HTMLParser):
    """The words that a page shows, and the blocks' borders, as the standard library's parser sees them."""

    def __init__(self, unseen, inline):
        super().__init__()
        self.unseen, self.inline, self.off, self.out = unseen, inline, 0, [""]

    def handle_starttag(self, tag, attrs):
        self.off += tag in self.unseen
        if tag == "br":
            self.out[-1] += " "
        if tag not in self.inline:
            self.out.append("")

    def handle_endtag(self, tag):
        self.off -= tag in self.unseen
        if tag not in self.inline:
            self.out.append("")

    def handle_data(self, data):
        if not self.off:
            self.out[-1] += data


def shown_blocks(page, unseen, inline):
    parser = _Shown(unseen, inline)
    parser.feed(page)
    parser.close()
    return [x for x in (" ".join(b.split()) for b in parser.out) if x]


def likeliest(scores, move):
    """The best of all labellings, tried one by one."""
    def total(y):
        return sum(s[k] for s, k in zip(scores, y, strict=True)) + sum(move[a][b] for a, b in zip(y, y[1:], strict=False))

    return list(max(itertools.product((0, 1), repeat=len(scores)), key=total))
