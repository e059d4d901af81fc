"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the DOM."""

from __future__ import annotations

import random
import re
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StringType, StructField, StructType

from termloom.llm.common import free_name, small_batches

#: Elements of HTML (fixed values): those that never have content, those whose content is no markup, those that are
#: never shown as text, and those inside a line of text. All others begin and end blocks.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = set("script style noscript template title head svg math iframe object canvas textarea select noembed noframes xmp audio video".split())
INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img".split()
)
#: What may stand in a head, which need not be closed: anything else ends it (fixed values).
IN_HEAD = set("head title base link meta style script noscript template".split())
#: What a new element closes of its own kind (fixed values).
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>|<(?=/?[a-zA-Z!?])[^>]*\Z|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"""([^\s"'>/=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_RIGHTS = re.compile(r"©|\(c\)|\bcopyright\b|\ball rights reserved\b", re.I)
_NAME = re.compile(r"[a-z]+")
_WORDS = re.compile(r"\S+")


def leaf_blocks(html: str) -> list[tuple[str, frozenset, int, int]]:
    """The page's blocks in order: text (white space squeezed, character references decoded), the words that describe
    its ancestors (tags, and words of class, id and role), characters inside links, and the depth."""
    out: list = []
    stack: list[tuple[str, frozenset, bool]] = []  # tag, words, whether it isn't shown
    seen: frozenset = frozenset()
    parts: list[str] = []
    link = in_link = hidden = 0

    def flush() -> None:
        nonlocal parts, link
        if parts and (text := " ".join("".join(parts).split())):
            out.append((text, seen, link, len(stack)))
        parts, link = [], 0

    pos, end = 0, len(html)
    while pos < end:
        m = _TOKEN.match(html, pos)
        pos = m.end()
        if m[2] is None:
            if (s := m[0])[0] != "<" or s == "<":
                if stack and stack[-1][0] == "head" and s.strip():  # text ends a head
                    stack.pop()
                    hidden = any(x for *_, x in stack)
                if not hidden:
                    s = unescape(s)
                    parts.append(s)
                    link += len(s.strip()) if in_link else 0
            continue
        tag = m[2].lower()
        if m[1]:
            if tag == "br" or tag == "p" and not any(t == "p" for t, *_ in stack):
                flush()
                continue
            at = next((k for k in range(len(stack) - 1, -1, -1) if stack[k][0] == tag), None)
            if at is None:
                continue
            if tag in INLINE:  # closes no block that is open inside it
                if all(t in INLINE for t, *_ in stack[at:]):
                    del stack[at:]
                else:
                    del stack[at]
            else:
                flush()
                del stack[at:]
        else:
            if tag not in IN_HEAD and any(t == "head" for t, *_ in stack):
                del stack[next(k for k, x in enumerate(stack) if x[0] == "head") :]
            if tag not in INLINE and tag not in RAW:
                flush()
            if m[3].endswith("/") and (tag in ("svg", "math") or any(t in ("svg", "math") for t, *_ in stack)):
                continue  # closed at once, as in XML
            if tag in VOID:
                if tag == "br":
                    parts.append(" ")
                continue
            if tag in CLOSES:
                for k in range(len(stack) - 1, -1, -1):
                    if stack[k][0] in CLOSES[tag]:
                        del stack[k:]
                        break
                    if stack[k][0] not in INLINE and stack[k][0] not in ("li", "p"):
                        break
            words, unseen = {f"<{tag}>"}, tag in UNSEEN
            for a in _ATTRIBUTE.finditer(m[3]) if m[3] else ():
                name, value = a[1].lower(), (a[2] or a[3] or a[4] or "").lower()
                if name in ("class", "id", "role"):
                    words.update(f".{w}" for w in _NAME.findall(value))
                elif name == "hidden" or name == "style" and _NOT_SHOWN.search(value):
                    unseen = True
            stack.append((tag, frozenset(words), unseen))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*>?", re.I).search(html, pos)
                pos = close.end() if close else end
                stack.pop()
        seen = frozenset().union(*(w for _, w, _ in stack))
        in_link = sum(t == "a" for t, *_ in stack)
        hidden = any(x for *_, x in stack)
    flush()
    return out


def features(blocks: list) -> list[list[str]]:
    """For each block the names of what holds of it."""
    rows, n = [], len(blocks)
    for i, (text, ancestors, link, depth) in enumerate(blocks):
        words = len(_WORDS.findall(text))
        stops = sum(text.count(c) for c in ".!?,;:")
        f = ["bias", f"words{min(6, words.bit_length())}", f"link{min(3, 4 * link // max(1, len(text)))}", f"stops{min(3, stops)}", f"depth{min(6, depth)}"]
        f.extend(ancestors)
        if _RIGHTS.search(text):
            f.append("copyright")
        f.append("first" if i == 0 else "last" if i == n - 1 else "inside")
        rows.append(f)
    return rows


class Field:
    """A linear-chain conditional random field over two labels (0: other, 1: main text)."""

    def __init__(self):
        self.index: dict[str, int] = {}
        self.w = np.zeros((0, 2))
        self.move = np.zeros((2, 2))

    def _ids(self, page: list[list[str]]) -> list[np.ndarray]:
        return [np.array([k for k in map(self.index.get, f) if k is not None], int) for f in page]

    def scores(self, page: list[list[str]]) -> np.ndarray:
        return np.array([self.w[i].sum(0) for i in self._ids(page)]).reshape(-1, 2)

    def fit(self, pages: list, labels: list, rounds: int = 8, rate: float = 0.3, decay: float = 1e-3, seed: int = 3) -> Field:
        """Stochastic gradient ascent (Adagrad) of the log-likelihood; forward and backward sums in log space."""
        for page in pages:
            for f in page:
                for name in f:
                    self.index.setdefault(name, len(self.index))
        self.w = np.zeros((len(self.index), 2))
        seen_w, seen_m = np.full(self.w.shape, 1e-6), np.full((2, 2), 1e-6)
        coded, order, rng = [self._ids(p) for p in pages], list(range(len(pages))), random.Random(seed)
        for _ in range(rounds):
            rng.shuffle(order)
            for k in order:
                ids, y = coded[k], labels[k]
                n = len(ids)
                if not n:
                    continue
                s = np.array([self.w[i].sum(0) for i in ids])
                a, b = np.zeros((n, 2)), np.zeros((n, 2))
                a[0] = s[0]
                for t in range(1, n):
                    a[t] = s[t] + np.logaddexp(a[t - 1, 0] + self.move[0], a[t - 1, 1] + self.move[1])
                for t in range(n - 2, -1, -1):
                    x = s[t + 1] + b[t + 1]
                    b[t] = np.logaddexp(self.move[:, 0] + x[0], self.move[:, 1] + x[1])
                z = np.logaddexp(*a[-1])
                grad = -np.exp(a + b - z)
                grad[np.arange(n), y] += 1
                gm = np.zeros((2, 2))
                for t in range(1, n):
                    gm -= np.exp(a[t - 1][:, None] + self.move + (s[t] + b[t])[None] - z)
                    gm[y[t - 1], y[t]] += 1
                flat_ids, g = np.concatenate(ids), np.repeat(grad, [len(i) for i in ids], axis=0)
                u, inv = np.unique(flat_ids, return_inverse=True)
                gw = np.zeros((len(u), 2))
                np.add.at(gw, inv, g)
                gw -= decay * self.w[u]
                seen_w[u] += gw**2
                self.w[u] += rate * gw / np.sqrt(seen_w[u])
                seen_m += gm**2
                self.move += rate * gm / np.sqrt(seen_m)
        return self

    def decode(self, page: list[list[str]]) -> list[int]:
        """The likeliest labels (Viterbi)."""
        if not page:
            return []
        w, index = self.plain
        (m00, m01), (m10, m11) = self.move.tolist()
        back, best = [], None
        for f in page:
            s0 = s1 = 0.0
            for name in f:
                if (k := index.get(name)) is not None:
                    s0 += w[k][0]
                    s1 += w[k][1]
            if best is None:
                best = (s0, s1)
                continue
            b0, b1 = best
            p0, p1 = b0 + m00 < b1 + m10, b0 + m01 < b1 + m11
            back.append((int(p0), int(p1)))
            best = (s0 + (b1 + m10 if p0 else b0 + m00), s1 + (b1 + m11 if p1 else b0 + m01))
        y = [int(best[1] > best[0])]
        for p in reversed(back):
            y.append(p[y[-1]])
        return y[::-1]

    @property
    def plain(self) -> tuple[list, dict]:
        if not hasattr(self, "_plain"):
            self._plain = self.w.tolist(), self.index
        return self._plain


_SYLLABLES = "ba de fi ko lu ma ne pi ro su ta vi za cho the ing on er an re".split()


def labelled_page(rng: random.Random) -> tuple[str, list[int]]:
    """A made-up page and its blocks' labels. What surrounds the article comes in the ways that pages commonly mark it."""
    word = lambda: "".join(rng.choices(_SYLLABLES, k=rng.randint(1, 4)))
    said = lambda a, b: " ".join(word() for _ in range(rng.randint(a, b))).capitalize() + rng.choice([".", ".", "!", "", "?", " &amp; more."])
    html, y = [], []

    def put(open_: str, text: str, close: str, label: int) -> None:
        html.append(open_ + text + close)
        y.append(label)

    def links(open_: str, close: str) -> None:
        html.append(open_ + "<ul>")
        for _ in range(rng.randint(1, 6)):
            put('<li><a href="#">', rng.choice([said(1, 3), word()]), "</a></li>", 0)
        html.append("</ul>" + close)

    def other(kinds: list[str]) -> None:
        kind = rng.choice(kinds)
        if kind in ("nav", "menu"):
            links(*rng.choice([("<nav>", "</nav>"), ('<div class="menu">', "</div>"), ('<div id="nav">', "</div>"), ('<div role="navigation">', "</div>"), ('<nav class="breadcrumb">', "</nav>")]))
        elif kind == "header":
            o, c = rng.choice([("<header>", "</header>"), ('<div class="header">', "</div>"), ('<div id="masthead">', "</div>"), ('<div class="banner">', "</div>")])
            put(o + rng.choice(["<h1>", "<p>", "<div>", "<a>"]), said(1, 8), c, 0)
        elif kind == "ad":
            put(f'<div class="{rng.choice(["ad", "ads", "advert", "advertisement", "sponsored", "promo", "ad-banner"])}">' + rng.choice(["", "<p>"]), said(2, 40), "</div>", 0)
        elif kind == "notice":
            put(f'<div class="{rng.choice(["cookie", "cookie-notice", "notice", "consent", "alert", "popup", "newsletter", "subscribe", "legal", "gdpr", "disclaimer"])}"><p>', said(4, 40), "</p></div>", 0)
        elif kind == "form":
            put("<form>" + rng.choice(["<label>", "<p>", "<div>", "<button>"]), said(1, 15), "<input></form>", 0)
        elif kind == "aside":
            o, c = rng.choice([("<aside>", "</aside>"), ('<div class="sidebar">', "</div>"), ('<div id="sidebar">', "</div>"), ('<div class="related">', "</div>"), ('<section class="widget">', "</section>"), ('<div class="share social">', "</div>")])
            html.append(o)
            for _ in range(rng.randint(1, 3)):
                put(rng.choice(["<p>", "<h3>", "<div>"]), said(2, 40), "", 0)
            html.append(c)
        elif kind == "comments":
            o, c = rng.choice([('<section class="comments">', "</section>"), ('<div id="comments">', "</div>"), ('<div class="comment-list">', "</div>"), ('<section id="responses" class="comments">', "</section>"), ('<div class="discussion">', "</div>"), ('<div class="reactions">', "</div>"), ('<div id="replies">', "</div>"), ('<ol class="thread replies">', "</ol>"), ('<div class="reader-feedback">', "</div>")])
            html.append(o)
            for _ in range(rng.randint(1, 5)):
                put(rng.choice(['<div class="comment"><p>', '<li class="comment">', '<article class="comment"><p>', "<p>"]), said(3, 60), rng.choice(["", "</p>"]), 0)
            html.append(c)
        elif kind == "footer":
            o, c = rng.choice([("<footer>", "</footer>"), ('<div class="footer">', "</div>"), ('<div id="footer">', "</div>"), ('<p class="copyright">', "</p>")])
            put(o, rng.choice(["&copy; ", "", "(c) ", "Copyright "]) + said(2, 30), c, 0)
        elif kind == "rights":
            o, c = rng.choice([("<p>", "</p>"), ("<div>", "</div>"), ("<div><small>", "</small></div>")])
            put(o, rng.choice(["Copyright 20{} ", "&copy; 20{} ", "(c) 20{} ", "20{} All rights reserved "]).format(rng.randint(10, 30)) + said(0, 6), c, 0)

    html.append("<!DOCTYPE html><html><head><title>" + said(2, 6) + "</title><style>p{}</style></head><body>")
    for _ in range(rng.randint(0, 4)):
        other(["nav", "menu", "header", "ad", "notice", "form", "aside"])
    if not rng.random() < 0.08:  # some pages have no article
        o, c = rng.choice([("<article>", "</article>")] * 3 + [("<main>", "</main>"), ("<main><article>", "</article></main>"), ('<div class="content">', "</div>"), ('<div id="article-body" class="post">', "</div>"), ('<div class="entry">', "</div>"), ("", ""), ('<div><section>', "</section></div>")])
        html.append(o)
        if rng.random() < 0.8:
            put(rng.choice(["<h1>", "<h2>", "<h1 class='title'>"]), said(1, 14), rng.choice(["</h1>", "</h2>"]), 1)
        for _ in range(rng.randint(1, 9)):
            if rng.random() < 0.08:
                other(["ad", "notice", "aside", "form"])
            kind = rng.choice(["p"] * 7 + ["li", "q", "h", "td", "pre", "b"])
            o2, c2 = {"p": ("<p>", rng.choice(["</p>", "</p>", ""])), "li": ("<ul><li>", "</li></ul>"), "q": ("<blockquote>", "</blockquote>"), "h": ("<h2>", "</h2>"), "td": ("<table><tr><td>", "</td></tr></table>"), "pre": ("<pre>", "</pre>"), "b": ("<p><b>", "<br>")}[kind]
            text = said(1, rng.choice([4, 12, 60, 120]))
            if o and rng.random() < 0.08:  # a marked article's own words on its rights belong to it
                text = rng.choice(["All rights reserved.", f"Copyright 2012 {text}", f"{text} (c) {said(1, 3)}", f"&copy; {said(1, 3)}", f"{text} All rights reserved."])
            put(o2, text, c2, 1)
        html.append(c)
    for _ in range(rng.randint(0, 4)):
        other(["nav", "ad", "notice", "form", "aside", "comments", "comments", "footer", "footer", "rights"])
    html.append("</body></html>")
    return "".join(html), y


@cache
def trained(pages: int = 500, seed: int = 11) -> Field:
    """The field trained on `pages` labelled pages (a bound on the training sample, not on what is extracted)."""
    rng = random.Random(seed)
    x, y = [], []
    while len(x) < pages:
        html, labels = labelled_page(rng)
        blocks = leaf_blocks(html)
        if len(blocks) == len(labels):
            x.append(features(blocks))
            y.append(np.array(labels, int))
    return Field().fit(x, y)


def main_text(html: str | None, field: Field) -> str:
    blocks = leaf_blocks(html or "")
    return " ".join(b[0] for b, y in zip(blocks, field.decode(features(blocks)), strict=True) if y)


def extract(pages: DataFrame, html: str = "html", training_pages: int = 500) -> DataFrame:
    """`pages` with their main text in `main_text` (underscores are put before a name that is taken); empty where the
    html is null, empty or has no main text. Each page is taken by itself, whole, however long, so rows that repeat agree;
    a tie of two labellings goes to what surrounds the article; no rows give no rows; ids and urls, null or not, pass
    through. No shuffle takes place. The field's weights, some hundred numbers, travel with the plan."""
    field, out = trained(training_pages), free_name(small_batches(pages), "main_text")
    field.plain  # noqa: B018  made once, here

    def over(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 500):
                part = b.slice(i, 500)
                texts = [main_text(h, field) for h in part.column(html).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], [*part.schema.names, out])

    return pages.mapInArrow(over, StructType([*pages.schema.fields, StructField(out, StringType())]))
