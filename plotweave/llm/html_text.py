"""Main text of web pages by a linear-chain conditional random field over leaf blocks.

A page is cut into leaf blocks, the runs of text between block-level tags, each with its ancestors' tags and class and id words, its
own tag, and measures of its text. A field of two labels, main and other, is trained on labelled pages and decodes a page's blocks
together by Viterbi's algorithm. The text is that of the main blocks.

Labelled pages mark main elements with an attribute (GOLD). labelled_pages() makes pages of many layouts with such marks; a
user's own can be given instead.

Each page is parsed once, in one pass over its tags, and nothing is shuffled.

Defined cases: a null or empty page has the empty text; markup that is broken off or badly nested is read as far as it goes; an element that is
never closed ends with its parent; repeated rows have equal texts; an empty table gives an empty one; columns of other names pass through.
"""

from __future__ import annotations

import html as entities
import random
import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plotweave.llm import bytewords
from plotweave.llm.common import annotate

#: The attribute that marks main elements of labelled pages.
GOLD = "data-main"
#: Elements by how they are read.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
SKIPPED = frozenset("head script style title textarea select option button template svg math iframe object canvas audio video noscript datalist".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
#: An element of the key ends an open one of the value.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"},
    "option": {"option"},
}
SCOPES = frozenset("ul ol dl table body html div article section main aside nav header footer".split())

MARKUP = re.compile(r"""<!--.*?(?:-->|\Z)|<([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</([a-zA-Z][^\s>]*+)[^>]*>|<[!?][^>]*(?:>|\Z)|<[a-zA-Z/][^>]*(?:>|\Z)""", re.S)
RAW_END = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I) for tag in RAW}
ATTRIBUTE = re.compile(r"""(class|id|role|data-main|hidden|aria-hidden)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
NAME_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


@dataclass
class Block:
    text: str
    names: frozenset  # of the ancestors: tags, and words of class, id and role
    own: str  # the innermost block-level tag
    linked: float  # share of its characters in links
    gold: bool


def blocks(page: str | None) -> list[Block]:
    """The leaf blocks of a page, in order; blank ones are left out."""
    page = page or ""
    out: list[Block] = []
    # of each open element: tag, names so far, whether it is skipped, whether it is marked
    stack: list[tuple[str, frozenset, bool, bool]] = [("", frozenset(), False, False)]
    pieces: list[str] = []
    linked = links = 0
    at = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and not stack[-1][2]:
            piece = entities.unescape(piece) if "&" in piece else piece
            pieces.append(piece)
            if links:
                linked += len(piece)

    def finish() -> None:
        nonlocal linked
        if pieces:
            joined = " ".join("".join(pieces).split())
            if joined:
                own = next((s[0] for s in reversed(stack) if s[0] not in INLINE), "")
                out.append(Block(joined, stack[-1][1], own, min(1.0, linked / len(joined)), stack[-1][3]))
            pieces.clear()
        linked = 0

    while m := MARKUP.search(page, at):
        if m.start() > at:
            text(page[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br" or tag == "wbr":
                text(" " if tag == "br" else "")
                continue
            if tag in VOID:
                if tag == "hr":
                    finish()
                continue
            if tag not in INLINE:
                finish()
                _imply(stack, tag)
            links += tag == "a"
            names, skipped, gold = stack[-1][1], stack[-1][2] or tag in SKIPPED, stack[-1][3]
            new = {tag} if tag not in INLINE else set()
            if m[2] and not skipped:
                for a in ATTRIBUTE.finditer(m[2]):
                    value = a[2].strip("\"'")
                    if a[1].lower() == GOLD:
                        gold = value == "1"
                    elif a[1].lower() in ("class", "id", "role"):
                        new |= {f".{w}" for w in NAME_WORD.findall(_CAMEL.sub(r"\1 \2", value).lower())}
            stack.append((tag, names | new if new - names else names, skipped, gold))
            if tag in RAW:
                end = RAW_END[tag].search(page, at)
                at = end.start() if end else len(page)
        elif m[3]:
            tag = m[3].lower()
            if tag not in INLINE:
                if tag == "p" or any(s[0] == tag for s in stack):
                    finish()
            k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == tag), 0)
            if k and not (tag in INLINE and any(s[0] not in INLINE for s in stack[k:])):
                links -= sum(s[0] == "a" for s in stack[k:])
                del stack[k:]
    text(page[at:])
    finish()
    return out


def _imply(stack: list, tag: str) -> None:
    """Ends what an opening tag ends without saying so: paragraphs, and items of the same list or table."""
    k = next((i for i in range(len(stack) - 1, 0, -1) if stack[i][0] == "p" or stack[i][0] in SCOPES), 0)
    if k and stack[k][0] == "p":
        del stack[k:]
    if tag in CLOSES:
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in CLOSES[tag]:
                del stack[i:]
                break
            if stack[i][0] in SCOPES:
                break


def traits(found: list[Block]) -> list[list[str]]:
    """The features of each block."""
    out, total = [], len(found)
    for k, b in enumerate(found):
        n, words = len(b.text), b.text.count(" ") + 1
        f = [f"in:{x}" for x in b.names]
        f += [f"own:{b.own}", f"size:{min(n.bit_length(), 11)}", f"words:{min(words.bit_length(), 8)}", f"linked:{int(b.linked * 4)}"]
        f.append("stop" if b.text[-1] in ".!?…\"'”»" else "no stop")
        if b.text[0] in "©&" or "©" in b.text:
            f.append("rights")
        if k == 0 or k == total - 1:
            f.append("first" if k == 0 else "last")
        if words > 12 and b.linked < 0.3:
            f.append("prose")
        out.append(f)
    return out


@dataclass
class Field:
    """Weights of features by label (other, main), of moves between labels, and of the ends."""

    index: dict[str, int]
    weight: np.ndarray
    move: np.ndarray
    ends: np.ndarray  # first, last

    def decode(self, found: list[Block]) -> list[bool]:
        """The likeliest labels of a page's blocks together."""
        if not found:
            return []
        scores = [self.weight[[self.index[x] for x in f if x in self.index]].sum(axis=0) for f in traits(found)]
        (m00, m01), (m10, m11) = self.move.tolist()
        a, b = (scores[0] + self.ends[0]).tolist()
        back = []
        for s in scores[1:]:
            to0, to1 = (a + m00, b + m10), (a + m01, b + m11)
            back.append((to0[1] > to0[0], to1[1] > to1[0]))
            a, b = max(to0) + float(s[0]), max(to1) + float(s[1])
        label = b + self.ends[1, 1] > a + self.ends[1, 0]
        out = [bool(label)]
        for step in reversed(back):
            label = step[1] if label else step[0]
            out.append(bool(label))
        return out[::-1]


def train(pages: list[str], *, rounds: int = 120, rate: float = 0.1, penalty: float = 2e-3) -> Field:
    """A field fitted to labelled pages by Adam on the penalised conditional likelihood, all pages at once."""
    found = [b for b in map(blocks, pages) if b]
    features = [traits(b) for b in found]
    index = {x: i for i, x in enumerate(sorted({x for page in features for f in page for x in f}))}
    lengths = np.array([len(b) for b in found])
    n, steps, rows = len(found), int(lengths.max()), int(lengths.sum())
    at = np.concatenate(([0], np.cumsum(lengths)))
    x = np.zeros((rows, len(index)), dtype=np.float32)
    for i, f in enumerate(f for page in features for f in page):
        x[i, [index[v] for v in f]] = 1
    y = np.array([b.gold for page in found for b in page], dtype=np.int64)
    row = np.minimum(at[:-1, None] + np.arange(steps), rows - 1)
    live = np.arange(steps) < lengths[:, None]
    hot = np.eye(2)[y]
    inner = np.flatnonzero(np.diff(np.repeat(np.arange(n), lengths)) == 0)
    seen_moves = np.zeros((2, 2))
    np.add.at(seen_moves, (y[inner], y[inner + 1]), 1)
    seen_ends = np.stack([hot[at[:-1]].sum(axis=0), hot[at[1:] - 1].sum(axis=0)])
    theta = [np.zeros((len(index), 2)), np.zeros((2, 2)), np.zeros((2, 2))]
    first, second = [np.zeros_like(t) for t in theta], [np.zeros_like(t) for t in theta]
    log_sum = lambda v, axis: v.max(axis=axis) + np.log(np.exp(v - v.max(axis=axis, keepdims=True)).sum(axis=axis))
    last = lengths - 1
    for r in range(1, rounds + 1):
        w, move, ends = theta
        s = (x @ w)[row]  # page, step, label
        a = np.empty((n, steps, 2))
        a[:, 0] = s[:, 0] + ends[0]
        for t in range(1, steps):
            a[:, t] = log_sum(a[:, t - 1, :, None] + move, 1) + s[:, t]
        total = log_sum(a[np.arange(n), last] + ends[1], 1)
        b = np.zeros((n, steps, 2))
        b[np.arange(n), last] = ends[1]
        moved = np.zeros((2, 2))
        for t in range(steps - 2, -1, -1):
            onward = s[:, t + 1] + b[:, t + 1]
            on = live[:, t + 1]
            b[on, t] = log_sum(move + onward[on, None, :], 2)
            moved += np.exp(a[on, t, :, None] + move + onward[on, None, :] - total[on, None, None]).sum(axis=0)
        p = np.exp(a + b - total[:, None, None])
        flat = np.zeros((rows, 2))
        flat[row[live]] = p[live]
        grads = [x.T @ (hot - flat).astype(np.float32), seen_moves - moved, seen_ends - np.stack([p[:, 0].sum(axis=0), p[np.arange(n), last].sum(axis=0)])]
        for k in range(3):
            g = grads[k] / n - penalty * theta[k]
            first[k], second[k] = 0.9 * first[k] + 0.1 * g, 0.99 * second[k] + 0.01 * g**2
            theta[k] = theta[k] + rate * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.99**r)) + 1e-8)
    return Field(index, *theta)


#: Syllables of the labelled pages' words, and names that sites give to their parts.
SYLLABLES = "ka lo mi ten dra vi so per un al re no ti que den sta mor el fa gi".split()
PARTS = {
    "nav": ["nav", "menu", "navbar", "main-menu", "topnav", "breadcrumb", "breadcrumbs", "navigation", "pagination", "pager"],
    "header": ["header", "masthead", "site-header", "top-bar", "branding", "logo"],
    "footer": ["footer", "site-footer", "colophon", "copyright", "legal"],
    "aside": ["sidebar", "aside", "widget", "related", "related-posts", "right-column", "teaser", "trending", "popular"],
    "ad": ["ad", "ads", "advert", "advertisement", "ad-top", "banner", "sponsored", "promo", "ad_box"],
    "notice": ["notice", "cookie", "cookie-notice", "consent", "gdpr", "popup", "modal", "alert", "newsletter", "subscribe", "paywall"],
    "comments": ["comments", "comment", "comment-list", "replies", "respond", "disqus", "discussion", "reader-comments"],
    "share": ["share", "social", "share-buttons", "tags", "byline-share"],
    "main": ["content", "post", "entry", "article", "post-body", "entry-content", "story", "article-body", "main-content", "text"],
}
SMALL = ["Accept all cookies on this site", "Sign up for our newsletter", "Read more", "Share this", "All rights reserved.", "Log in", "Related stories", "Your name", "Leave a reply", "We use cookies to improve your visit."]


def labelled_pages(count: int = 300, seed: int = 7) -> list[str]:
    """Pages of many layouts whose main elements are marked."""
    out = []
    for k in range(count):
        r = random.Random(seed * 100_003 + k)
        word = lambda r=r: "".join(r.choice(SYLLABLES) for _ in range(r.randint(1, 3)))
        line = lambda a, b, r=r, word=word: " ".join(word() for _ in range(r.randint(a, b))).capitalize()
        prose = lambda r=r, line=line: " ".join(line(3, 16) + "." for _ in range(r.choice([1, 1, 2, 3, 5, 8])))
        name = lambda part, r=r: f'{r.choice(["class", "id"])}="{r.choice(PARTS[part])}"'
        links = lambda a, b, r=r, line=line: "".join(f'<li><a href="/x">{line(1, 3)}</a></li>' for _ in range(r.randint(a, b)))
        small = lambda r=r, line=line, prose=prose: r.choice([r.choice(SMALL), line(2, 9), line(3, 12) + ".", prose()])

        def other(part: str, r=r, name=name, links=links, small=small, line=line, prose=prose) -> str:
            tag = {"nav": "nav", "header": "header", "footer": "footer", "aside": "aside"}.get(part)
            if part == "form":
                return f"<form><p>{small()}</p><label>{line(1, 2)}</label><input name=q></form>"
            opened = f"<{tag}" if tag and r.random() < 0.5 else f"<{(tag := r.choice(['div', 'section', 'ul' if part == 'nav' else 'div']))} {name(part)}"
            body = {"nav": lambda: links(2, 8) if tag == "ul" else f"<ul>{links(2, 8)}</ul>", "comments": lambda: "".join(f"<{t}>{prose()}</{t}>" for t in r.choices(["p", "div", "li"], k=r.randint(1, 4)))}.get(
                part, lambda: r.choice([small(), f"<p>{small()}</p>", f"<h3>{line(1, 3)}</h3><ul>{links(1, 4)}</ul>", f"<h2>{line(1, 4)}</h2><p>{small()}</p>", f"&copy; {line(1, 3)} &middot; {prose()}"])
            )()
            return f"{opened}>{body}</{tag}>"

        body = []
        if r.random() < 0.85:
            body.append(r.choice([f"<h1>{line(2, 10)}</h1>", f"<h1>{line(2, 10)}.</h1>", f"<header><h1>{line(2, 10)}</h1></header>" if r.random() < 0.3 else f"<h2>{line(2, 8)}</h2>"]))
        for _ in range(r.choice([1, 2, 3, 4, 6, 9, 14])):
            body.append(r.choice([
                f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}</p>", f"<p>{prose()}", f"<p><b>{line(1, 3)}.<br>", f"<p>{prose()} <a href='/y'>{line(1, 3)}</a> {prose()}</p>", f"<h2>{line(1, 6)}</h2>", f"<p>{line(1, 4)}</p>",
                "<ul>" + "".join(f"<li>{line(1, 12)}" for _ in range(3)) + "</ul>", f"<blockquote><p>{prose()}</p></blockquote>", f"<table><tr><td>{line(1, 3)}<td>{line(1, 3)}</table>", f"<pre>{line(2, 9)}</pre>",
                f"<figure><figcaption>{line(3, 9)}</figcaption></figure>", f"<div>{prose()}</div>",
            ]))
        if r.random() < 0.35:
            body.insert(r.randint(1, len(body)), f'<div {GOLD}="0">{other(r.choice(["ad", "share", "notice", "form", "aside", "nav"]))}</div>')
        if r.random() < 0.2:
            body.append(f'<div {GOLD}="0">{other("comments")}</div>')
        tag, mark = r.choice([("article", ""), ("article", ""), ("article", name("main")), ("main", ""), ("div", name("main")), ("div", name("main")), ("section", name("main")), ("div", ""), ("td", "")])
        main = f'<{tag} {mark} {GOLD}="1">{"".join(body)}</{tag}>'
        if tag == "td":
            main = f"<table><tr>{main}</tr></table>"
        elif r.random() < 0.3:
            outer, its = r.choice([("main", ""), ("div", ""), ("div", ' id="wrapper"')])
            main = f"<{outer}{its}>{main}{other('comments') if r.random() < 0.5 else ''}</{outer}>"
        before = [other(p) for p in ("header", "nav", "notice", "ad", "aside", "form", "share") if r.random() < 0.45]
        after = [other(p) for p in ("share", "comments", "aside", "ad", "nav", "form", "notice", "footer") if r.random() < 0.4]
        if r.random() < 0.1:  # nothing but the text
            before, after = [], []
            main = f'<{(tag := r.choice(["div", "section", "center"]))} {GOLD}="1">{"".join(body)}</{tag}>'
        r.shuffle(before)
        out.append(f"<!DOCTYPE html><html><head><title>{line(2, 6)}</title><style>p{{}}</style></head><body>{''.join(before)}<!-- x -->{main}{''.join(after)}</body></html>")
    return out


def extract(pages: DataFrame, field: Field | None = None, *, html: str = "html") -> tuple[DataFrame, str]:
    """pages with a column of main texts, and its name. field: trained on labelled_pages() unless given."""
    shared = pages.sparkSession.sparkContext.broadcast(train(labelled_pages()) if field is None else field)

    def work(batches):
        field = shared.value
        for part in bytewords.blocks(batches, html, 2_000_000):
            texts = []
            for page in part.column(part.schema.get_field_index(html)).to_pylist():
                found = blocks(page)
                texts.append(" ".join(b.text for b, main in zip(found, field.decode(found), strict=True) if main))
            yield part, pa.array(texts, pa.string())

    return annotate(pages, [html], "main_text", T.StringType(), work)


def digest(pages: DataFrame) -> DataFrame:
    found, name = extract(pages.select("page_id", "url", "html"))
    return found.select("page_id", "url", F.col(name).alias("text"), F.length(name).cast("long").alias("n_chars"))
