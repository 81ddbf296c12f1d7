"""Main text of web pages, by a recurrent labeller of their blocks.

A page becomes the sequence of its leaf blocks: runs of text between the tags that
break lines. A bidirectional LSTM reads the whole sequence (hashed tag paths with
class and id, hashed words, a few measures) and tells for each block whether it
belongs to the article; those that do are the result.

The labeller is fitted on the driver to a bounded number of pages (`PAGES`) that are
made up here, with known labels: their layouts mix the elements and names that sites
use for articles and for what surrounds them.
"""

from __future__ import annotations

import html
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .block_labeller import Block, Path, common_tokens, features, scores, train

#: Made-up pages that the labeller is fitted to.
PAGES = 2000
EPOCHS = 8

# Fixed values of HTML: elements without content, with raw text, and within lines.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea select option svg iframe object canvas head title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i ins kbd label mark q ruby s samp small span strike strong sub sup time tt u var wbr img".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_OPEN = re.compile(r"<(?:(/?)([A-Za-z][^\s/>]*+)|!--|[!?])")
# A quote begins a value only after an equals sign.
_REST = re.compile(r"""((?:[^>"'=]++|=\s*+(?:"[^"]*+"|'[^']*+')?+|["'])*+)>""")
_NAMES = re.compile(r"""(?<![\w-])(?:class|id|role)\s*+=\s*+(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_UNQUOTED_END = re.compile(r"""=\s*+[^\s"'=]*/\Z""")
_WORD = re.compile(r"[A-Za-z]+")


class _Tags:
    """The tags of a page in one forward scan: an end that isn't there is looked for once."""

    def __init__(self, page: str):
        self.page = page
        self.quotes = True  # until a value's quote has no end before the page's
        self.unclosed: set[str] = set()

    def after(self, at: int) -> tuple[int, int, bool, str, str] | None:
        """The next tag from `at` on: (begin, end, closing, name, attributes), a name of "" for comments and the like."""
        page, found = self.page, _OPEN.search(self.page, at)
        if not found:
            return None
        begin, past = found.span()
        if not found[2]:
            close = "-->" if found[0] == "<!--" else ">"
            end = page.find(close, past)
            return begin, len(page) if end < 0 else end + len(close), False, "", ""
        rest = _REST.match(page, past) if self.quotes else None
        if rest:
            return begin, rest.end(), found[1] == "/", found[2].lower(), rest[1]
        self.quotes = False
        end = page.find(">", past)
        if end < 0:  # a tag without end takes what is left, as in browsers
            return begin, len(page), False, "", ""
        return begin, end + 1, found[1] == "/", found[2].lower(), page[past:end]

    def past_raw(self, name: str, at: int) -> int:
        """Where the content of a raw element ends; at its beginning if it isn't closed, but a script takes what is left."""
        over = None if name in self.unclosed else _raw_end(name).search(self.page, at)
        if over:
            return over.end()
        self.unclosed.add(name)
        return len(self.page) if name in ("script", "style") else at


@cache
def _raw_end(name: str) -> re.Pattern:
    return re.compile(rf"</{re.escape(name)}(?![^\s/>])[^>]*+>?", re.I)


def blocks(page: str, root: Path | None = None) -> list[Block]:
    """The leaf blocks of a page, in order. Broken markup never fails, and takes linear time."""
    out: list[Block] = []
    paths = [root or Path()]  # of the open block elements
    stack: list[str] = []  # open elements
    outer: list[int] = []  # places of block elements in the stack
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked = 0

    def end() -> None:
        nonlocal linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                out.append(Block(text, paths[-1], min(linked, len(text))))
            parts.clear()
        linked = 0

    def close(tag: str) -> None:
        same = HEADINGS if tag in HEADINGS else (tag,)
        if not any(opened[t] for t in same):
            return
        while True:
            top = stack.pop()
            opened[top] -= 1
            if top not in INLINE:
                outer.pop()
                paths.pop()
            if top in same:
                return

    tags, at = _Tags(page), 0
    while True:
        tag = tags.after(at)
        upto = tag[0] if tag else len(page)
        if upto > at:
            parts.append(page[at:upto])
            linked += (upto - at) * (opened["a"] > 0)
        if not tag:
            break
        _, at, closing, name, given = tag
        if not name:
            continue
        shut = given.endswith("/") and not _UNQUOTED_END.search(given, max(0, len(given) - 300))
        if name in RAW:
            if not closing and not shut:
                at = tags.past_raw(name, at)
            continue
        if name not in INLINE:
            end()
        elif name == "br":
            parts.append(" ")
        if closing:
            close(name)
            continue
        if name not in INLINE and outer and stack[outer[-1]] == "p":  # a paragraph ends where the next block begins
            close("p")
        if name in VOID or shut:
            continue
        if name not in INLINE:
            words = (w for m in _NAMES.finditer(given) for w in _WORD.findall(m[1] or m[2] or m[3] or "")) if given else ()
            outer.append(len(stack))
            paths.append(paths[-1].child((name, *(f".{w.lower()}" for w in words))))
        stack.append(name)
        opened[name] += 1
    end()
    return out


#: How sites name what surrounds an article, and what holds one.
AROUND = {
    "nav": ["menu", "navbar", "navigation", "breadcrumb", "topnav", "toc", "pagination", "pager", ""],
    "header": ["header", "masthead", "top", "banner", "logo", "branding", ""],
    "footer": ["footer", "copyright", "legal", "bottom", "colophon", "imprint", ""],
    "aside": ["sidebar", "related", "widget", "recommended", "popular", "tags", "teaser", ""],
    "form": ["newsletter", "subscribe", "login", "search", "contact", "signup", ""],
    "div": ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "cookie", "consent", "notice", "popup", "modal", "overlay", "share", "social", "sidebar", "menu", "footer", "header", "comments", "comment", "disqus", "replies", "related", "banner", "newsletter", "alert", "gdpr", "disclaimer"],
    "section": ["comments", "comment", "related", "ads", "newsletter", "discussion", "responses", "promo"],
    "ul": ["menu", "nav", "share", "social", "tags", "breadcrumb", "commentlist"],
}
WITHIN = {"article": ["", "post", "entry", "story", "hentry"], "main": ["", "content", "main"], "div": ["content", "post", "entry", "article", "story", "body", "text", "main", "page", "prose", "markdown"], "section": ["content", "body", "story", "chapter", "", "text"]}
#: Class names that say how an element looks, not what it holds.
LOOKS = "row col grid flex box inner outer wrap wrapper container clearfix left right center wide block item card mt pb px lg sm md shadow rounded relative hidden active fade".split()
THREADS = {"div": ["comments", "comment-list", "discussion", "responses", "replies", "respond"], "section": ["comments", "discussion", "replies"], "ol": ["commentlist", "comments"]}
PHRASES = "accept cookies|subscribe now|sign up|log in|share this|all rights reserved|privacy policy|terms of use|read more|advertisement|sponsored|leave a reply|contact us|home|next|previous|follow us|copyright".split("|")


def made_up(seed: int) -> tuple[str, set[str]]:
    """A page and the texts of its article's blocks."""
    r = random.Random(seed)
    letters = ["".join(r.choice("abcdefghijklmnoprstuvwéäñ") for _ in range(r.randint(1, 4))) for _ in range(60)]
    used: set[str] = set()

    def text(low: int, high: int) -> str:
        while True:
            words = ["".join(r.choice(letters) for _ in range(r.randint(1, 3))) for _ in range(r.randint(low, high))]
            for k in range(r.randint(4, 12), len(words), 11):
                words[k] += r.choice([".", ",", "."])
            said = (" ".join(words)).capitalize() + r.choice([".", ".", "", "!"])
            if said not in used:
                used.add(said)
                return said

    def inside(said: str) -> str:
        words = said.split(" ")
        if len(words) > 3 and r.random() < 0.4:
            k = r.randrange(len(words) - 1)
            words[k] = r.choice(["<b>%s</b>", '<a href="/x">%s</a>', "<em>%s</em>", "%s<br>"]) % words[k]
        return " ".join(words)

    def around() -> str:
        tag = r.choice(list(AROUND))
        name = r.choice(AROUND[tag])
        extra = r.choice(["", "", f" {r.choice(letters)}", f"-{r.choice(letters)}"])
        attr = f' {r.choice(["class", "class", "id"])}="{name}{extra}"' if name else ""
        kind = r.random()
        if kind < 0.4:
            body = "<ul>" * (tag != "ul") + "".join(f'<li><a href="/{k}">{text(1, 3)}</a></li>' for k in range(r.randint(1, 8))) + "</ul>" * (tag != "ul")
        elif kind < 0.7:
            body = r.choice(["", "&copy; "]) + r.choice([text(2, 14), r.choice(PHRASES).capitalize() + " " + text(1, 6)])
            body = r.choice([body, f"<p>{body}</p>", f"<span>{body}</span>"])
        else:
            size = r.randint(2, 4)
            body = f"<h{size}>{text(1, 5)}</h{size}>" * (r.random() < 0.5) + "".join(f"<p>{inside(text(3, 45))}</p>" for _ in range(r.randint(1, 4)))
        return f"<{tag}{attr}>{nested(body) if r.random() < 0.3 else body}</{tag}>"

    def nested(body: str) -> str:
        """Some elements around that say nothing about what they hold."""
        for _ in range(r.choice([1, 2, 4, 12])):
            names = " ".join(r.choice([r.choice(LOOKS), r.choice(letters), f"{r.choice(LOOKS)}-{r.randint(1, 12)}"]) for _ in range(r.choice([0, 1, 1, 3, 10])))
            tag = r.choice(["div", "div", "div", "section", "span"])
            body = f'<{tag} class="{names}">{body}</{tag}>' if names else f"<{tag}>{body}</{tag}>"
        return body

    def thread() -> str:
        """Readers' comments: as long as the article's paragraphs, and told by their surroundings."""
        tag = r.choice(list(THREADS))
        inner, each = ("li", "comment") if tag == "ol" else (r.choice(["div", "div", "article"]), r.choice(["comment", "comment", "reply", "response", "comment-body"]))
        def said() -> str:
            who = r.choice(["span", "div", "cite", "b"])
            by = f"<{who}>{text(1, 2)}</{who}>" * (r.random() < 0.7)
            return by + "".join(r.choice(["<p>%s</p>", "<div>%s</div>"]) % inside(text(2, 60)) for _ in range(r.randint(1, 3)))

        one = lambda: f'<{inner} class="{each}">{nested(said()) if r.random() < 0.2 else said()}</{inner}>'
        return f'<{tag} {r.choice(["class", "id"])}="{r.choice(THREADS[tag])}">' + f"<h3>{text(1, 3)}</h3>" * (tag != "ol" and r.random() < 0.6) + "".join(one() for _ in range(r.randint(1, 8))) + f"</{tag}>"

    own: set[str] = set()

    def keep(said: str) -> str:
        own.add(" ".join(said.split()))
        return inside(said)

    def piece() -> str:
        kind = r.random()
        if kind < 0.72:
            said = keep(text(1, r.choice([4, 90, 90, 90])))
            return r.choice([f"<p>{said}</p>", f"<p>{said}", f"<p><b>{said}</b></p>", f"<div>{said}</div>"] if kind > 0.5 else [f"<p>{said}</p>"])
        if kind < 0.84:
            size = r.randint(2, 3)
            return f"<h{size}>{keep(text(1, 8))}</h{size}>"
        if kind < 0.87:
            return "<table>" + "".join("<tr>" + "".join(f"<{cell}>{keep(text(1, 8))}</{cell}>" for cell in r.choice([["td", "td"], ["th", "td", "td"]])) + "</tr>" for _ in range(r.randint(1, 5))) + "</table>"
        if kind < 0.93:
            return "<ul>" + "".join(f"<li>{keep(text(1, 20))}</li>" for _ in range(r.randint(2, 5))) + "</ul>"
        return f"<blockquote>{keep(text(4, 40))}</blockquote>" if kind < 0.97 else f"<pre>{keep(text(4, 20))}</pre>"

    tag = r.choice(["article", "article", "article", *WITHIN])
    name = r.choice(WITHIN[tag])
    attr = f' class="{name}{r.choice(["", "-" + r.choice(letters), " " + r.choice(letters)])}"' if name else ""
    pieces = [f"<h1>{keep(text(1, 14))}</h1>"] * (r.random() < 0.85) + [piece() for _ in range(r.choice([r.randint(1, 6), r.randint(3, 30)]))]
    for _ in range(r.choice([0, 0, 1, 2])):
        pieces.insert(r.randint(1, len(pieces)), around())
    if r.random() < 0.2:
        pieces.append(thread())
    inner = "".join(pieces)
    if r.random() < 0.25:
        inner = nested(inner)
    article = f"<{tag}{attr}>{inner}</{tag}>"
    if r.random() < 0.3:
        outer, cls = r.choice([("div", "wrapper"), ("div", "container"), ("main", ""), ("section", "page")])
        article = f'<{outer} class="{cls}">{article}{around() * (r.random() < 0.5)}</{outer}>'
    if r.random() < 0.3:
        article = nested(article)
    before, after = ("".join(around() for _ in range(r.randint(0, 4))) for _ in range(2))
    if r.random() < 0.2:
        after = r.choice([thread() + after, after + thread()])
    if r.random() < 0.12:  # laid out as a table
        before, after = (f"<td{r.choice(['', ' width=20%'])}>{x}</td>" if x else "" for x in (before, after))
        whole = f"<table><tr>{before}<td>{article}</td>{after}</tr></table>"
    else:
        whole = before + article + after
    if r.random() < 0.2:
        whole = nested(whole)
    return f"<html><head><title>{text(1, 8)}</title></head><body>{whole}" + "</body></html>" * (r.random() < 0.9), own


#: A name of an element counts if it is in so many of the made-up pages.
SEEN = 5
_fitted: dict = {}


def labeller(pages: int = PAGES, seed: int = 0) -> dict:
    """Weights fitted to made-up pages, and the names known to them; the same each time, and fitted once a process."""
    if (pages, seed) not in _fitted:
        made = [made_up(seed + k) for k in range(pages)]
        root = Path()
        names = common_tokens([blocks(page, root) for page, _ in made], SEEN)
        root = Path(known=names)
        found = [blocks(page, root) for page, _ in made]
        labels = [np.array([b.text in own for b in f], np.float32) for f, (_, own) in zip(found, made, strict=True)]
        _fitted[pages, seed] = train(features(found), labels, epochs=EPOCHS) | {"names": names}
    return _fitted[pages, seed]


def main_text(pages: DataFrame, weights: dict | None = None) -> DataFrame:
    """The article of every row of pages (page_id, url, html): page_id, url, text, n_chars.

    The blocks that the labeller takes for article, in order, joined by line feeds;
    character references are decoded and white space within a block is one space. A
    null html is an empty page, and a page without article blocks has an empty text.
    Rows are independent of each other; null or repeated page_ids and urls are passed
    on. Other columns are ignored. An empty table gives an empty result.
    """
    fitted = weights or labeller()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        root = Path(known=fitted["names"])
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                found = [blocks(p or "", root) for p in some.column(2).to_pylist()]
                likely = scores(features(found), fitted)
                texts = ["\n".join(b.text for b, p in zip(f, s, strict=True) if p >= 0.5) for f, s in zip(found, likely, strict=True)]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(work, "page_id long, url string, text string, n_chars long")
