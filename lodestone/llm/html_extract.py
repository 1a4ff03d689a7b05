"""Main text of web pages by the maximum-scoring subsequence.

A page is a sequence of words and tags. Words score by the weight of their surroundings (the tags and class names
around them, how much of the block is links), tags score negative by their weight; a linear scan finds the contiguous
run of the highest sum. Weights are log odds learned from labelled pages: `label_pages()` is a small fixed set of
marked layouts; pages of a corpus that mark their article themselves can be added with `learn()`. Blocks inside the
region whose surroundings are those of menus, forms, notices, adverts or comments are left out; all else stays whole.
As they are left out, they weigh nothing, words and tags: the run goes on behind them however long they are. Only the
page's menus, headers and footers outside any container that is marked as content count against a run that spans them.

Text rules: character references are decoded, white space in a block becomes one space, blocks are trimmed and joined
by a blank line in page order. Cases: null or empty html gives empty text; malformed markup (unclosed or stray tags,
a page that stops in a tag, quotes in unquoted values) is read leniently; very long pages are read in one linear pass;
of runs that score the same (ties) the first counts; repeated rows give a row each; an empty table gives an empty one;
extra columns of any name are ignored.
"""

from __future__ import annotations

import functools
import html as htmllib
import math
import re
from collections import defaultdict

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: What may stand in a tag: a quote opens a value only right after an equals sign, elsewhere it is a letter like others.
_INSIDE = r"""(?>[^>"'=]+|=\s*"[^"]*(?:"|\Z)|=\s*'[^']*(?:'|\Z)|=\s*[^\s>"'][^\s>]*|[="'])*+"""
_TOKEN = re.compile(rf"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_INSIDE})(?:>|\Z)", re.S)
_NAME = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>][^\s>]*))""", re.I)
_HIDDEN = re.compile(r"""(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
_SPLIT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
#: Elements whose content is never text, those that start a new block, and those without content. Fixed values.
RAW = {"script", "style", "noscript", "template", "svg", "textarea", "iframe", "object", "math", "title", "canvas", "xmp"}
BLOCK = {
    "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details", "dialog", "div", "dl", "dt", "fieldset",
    "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html", "li", "main",
    "menu", "nav", "ol", "p", "pre", "section", "select", "option", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: Elements that a start tag of the same kind ends when they are open. Fixed values.
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
#: Words of class, id and role values that mark what isn't article text. Fixed values.
ASIDE_WORDS = {
    "ad", "ads", "advert", "adverts", "advertisement", "adsense", "banner", "promo", "promotion", "sponsor", "sponsored", "sidebar", "side",
    "nav", "navbar", "navigation", "menu", "breadcrumb", "breadcrumbs", "header", "masthead", "footer", "comment", "comments", "disqus",
    "reply", "replies", "cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "share", "sharing", "social",
    "related", "recommended", "newsletter", "subscribe", "subscription", "signup", "login", "search", "pagination", "pager", "widget",
    "toolbar", "tags", "form", "complementary", "contentinfo", "copyright", "skip", "respond", "paywall", "toc", "dialog",
}
#: Tags around a word that mark the same. Fixed values.
ASIDE_TAGS = {"nav", "header", "footer", "aside", "form", "button", "select", "menu", "dialog", "label", "fieldset", "head"}
MAIN_WORDS = {"content", "article", "story", "entry", "post", "main", "body", "text"}
MAIN_FEATURES = {f".{x}" for x in MAIN_WORDS}
#: Asides that part the page where no container around them is marked as content; all others weigh nothing.
LANDMARKS = {"nav", "header", "footer"}
WEIGHTLESS, PARTING = 1, 2


class Block:
    __slots__ = ("text", "n_words", "features", "linked", "tags_before", "bad", "weightless", "outer")

    def __init__(self, text, features, linked, tags_before, bad, weightless, outer):
        self.text, self.features, self.linked, self.tags_before, self.bad = text, features, linked, tags_before, bad
        self.weightless, self.outer = weightless, outer  # outer: the tags before, without those of weightless asides
        self.n_words = text.count(" ") + 1


def _names(attributes: str) -> set[str]:
    if "=" not in attributes:
        return set()
    found: set[str] = set()
    for m in _NAME.finditer(attributes):
        found.update(w.lower() for w in _SPLIT.findall(m[2] or m[3] or m[4] or ""))
    return found


def blocks(page: str) -> list[Block]:
    """The page's text blocks in order, each with its surroundings and the tags since the block before."""
    out: list[Block] = []
    stack: list[tuple[str, frozenset, int]] = []  # tag, features, kind of aside or 0
    held: list[str] = []
    linked = 0
    in_link = depth = 0
    tags: list[str] = []
    outer: list[str] = []
    at, n = 0, len(page)

    def weightless():
        return next((a for _, _, a in stack if a), 0) == WEIGHTLESS

    def close():
        nonlocal held, linked, tags, outer
        if held:
            text = " ".join(htmllib.unescape("".join(held)).split())
            if text:
                features = frozenset().union(*(f for _, f, _ in stack))
                bad = any(b for _, _, b in stack)
                out.append(Block(text, features, linked, tags, bad, weightless(), outer))
                tags, outer = [], []
            held, linked = [], 0

    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            held.append(page[at:lt])
            if in_link:
                linked += lt - at
        if lt == n:
            break
        m = _TOKEN.match(page, lt)
        if not m:
            held.append("<")
            at = lt + 1
            continue
        at = m.end()
        if not m[2]:
            continue
        tag, ending, attributes = m[2].lower(), bool(m[1]), m[3]
        if tag in RAW and not ending:
            if not attributes.endswith("/"):
                end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
            continue
        if tag in BLOCK:
            close()
            tags.append(tag if not ending else "/" + tag)
            if (ending or tag in VOID) and not weightless():
                outer.append(tags[-1])
        elif tag == "br":
            held.append(" ")
        if tag in VOID:
            continue
        if tag == "a":
            in_link, depth = int(not ending and "href" in attributes.lower()), len(stack)
        if ending:
            for i in range(len(stack) - 1, -1, -1):
                if stack[i][0] == tag:
                    del stack[i:]
                    break
            if len(stack) < depth:  # a link that was never closed ends with the element around it
                in_link = 0
            continue
        over = CLOSES.get(tag)
        if over and stack and stack[-1][0] in over:
            stack.pop()
        if tag in BLOCK:
            names = _names(attributes)
            features = {f"<{tag}>", *(f".{x}" for x in names & (ASIDE_WORDS | MAIN_WORDS))}
            inner = any(t in ("article", "main") for t, _, _ in stack)
            # an article's own header (title) is text; its other asides are not
            aside = (tag in ASIDE_TAGS and not (tag == "header" and inner)) or bool(names & ASIDE_WORDS and not (tag in ("article", "main", "body") or names & MAIN_WORDS)) or bool(_HIDDEN.search(attributes))
            kind = 0
            if aside:
                marked = inner or any(f & MAIN_FEATURES for t, f, _ in stack if t not in ("body", "html"))
                kind = PARTING if tag in LANDMARKS and not marked else WEIGHTLESS
            stack.append((tag, frozenset(features), kind))
            if not weightless():
                outer.append(tag)
    close()
    for mark in ("<article>", "<main>"):  # a page that marks its article says so of every block
        if any(mark in b.features and not b.bad for b in out):
            for b in out:
                b.features |= {"in " + mark if mark in b.features else "out of " + mark}
            break
    return out


class Weights:
    """Log odds of article words by surroundings, and of article interiors by tag."""

    def __init__(self, word: dict[str, float], tag: dict[str, float], base: float):
        self.word, self.tag, self.base = word, tag, base

    def block(self, b: Block) -> float:
        """Score of each word of a block."""
        if b.bad:
            return 0.0 if b.weightless else -4.0
        links = 0.0 if b.features & {"in <article>", "in <main>"} else b.linked / max(1, len(b.text))
        return max(-4.0, min(4.0, self.base + sum(self.word.get(f, 0.0) for f in b.features))) - 3.0 * min(1.0, links)

    def tags(self, b: Block) -> float:
        return sum(self.tag.get(t, -0.5) for t in b.outer)


def learn(pages: list[tuple[str, object]], smooth: float = 4.0) -> Weights:
    """Weights from (html, is_article(block) -> bool) pairs."""
    inside, outside = defaultdict(float), defaultdict(float)
    tag_in, tag_all = defaultdict(float), defaultdict(float)
    n_in = n_out = smooth
    for page, is_article in pages:
        before = False
        for b in blocks(page):
            now = bool(is_article(b))
            side = inside if now else outside
            for f in b.features:
                side[f] += b.n_words
            n_in, n_out = n_in + now * b.n_words, n_out + (not now) * b.n_words
            for t in b.tags_before:
                tag_all[t] += 1
                tag_in[t] += now and before
            before = now
    keys = {*inside, *outside}
    word = {f: math.log((inside[f] + smooth) / (n_in + smooth)) - math.log((outside[f] + smooth) / (n_out + smooth)) for f in keys}
    tag = {t: min(-0.1, math.log((tag_in[t] + 0.5) / (tag_all[t] + 1.0))) for t in tag_all}
    return Weights(word, tag, 0.5)


def label_pages() -> list[tuple[str, object]]:
    """Labelled layouts: article words are marked by the letter q that begins each of them."""
    prose = "qone qtwo qthree qfour qfive qsix qseven qeight qnine qten " * 4
    junk = "other words of the page"
    menu = "<nav><ul>" + "".join(f"<li><a href='/{i}'>item {i}</a></li>" for i in range(6)) + "</ul></nav>"
    foot = "<footer>all rights kept <a href='/about'>about</a></footer>"
    body = f"<h1>qtitle qof qpage</h1><p>{prose}</p><h2>qpart</h2><p>{prose}</p><ul><li>qpoint qone</li><li>qpoint qtwo</li></ul><blockquote><p>qsaid qso</p></blockquote><table><tr><td>qcell</td><td>qcell</td></tr></table><p>{prose}</p>"
    made = []
    for open_, end in (("<article>", "</article>"), ("<main>", "</main>"), ('<div class="content">', "</div>"), ('<div id="post">', "</div>"), ("<section>", "</section>"), ("<div>", "</div>")):
        made.append(f"<html><body>{menu}<div class='ad'>{junk}</div>{open_}{body}{end}<div>{junk}</div><aside>{junk}</aside>{foot}</body></html>")
        made.append(f"<body><header><a href='/'>{junk}</a></header>{open_}{body}{end}<div class='comments'><h3>comments</h3><p>{junk}</p></div><form><p>{junk}</p></form>{foot}</body>")
        made.append(f"<body><div class='sidebar'><p>{junk}</p></div>{menu}{open_}{body}{end}<div class='related'><ul><li><a href='/x'>{junk}</a></li></ul></div>{foot}</body>")
    return [(page, lambda b: b.text.startswith("q")) for page in made]


@functools.lru_cache(maxsize=1)
def default_weights() -> Weights:
    return learn(label_pages())


def best_run(scores: list[float]) -> tuple[int, int]:
    """[start, end) of the contiguous run of the greatest positive sum; the longest of the first best ones."""
    best, where, total, start = 0.0, (0, 0), 0.0, 0
    for i, s in enumerate(scores):
        if total <= 0:
            total, start = 0.0, i
        total += s
        if total > best:
            best, where = total, (start, i + 1)
    return where


def extract(page: str | None, weights: Weights | None = None) -> str:
    weights = weights or default_weights()
    found = blocks(page or "")
    scores = []
    for b in found:
        scores += [weights.tags(b), weights.block(b) * b.n_words]
    start, end = best_run(scores)
    return "\n\n".join(b.text for i, b in enumerate(found) if start <= 2 * i + 1 < end and not b.bad)


def extract_pages(pages: DataFrame, weights: Weights | None = None) -> DataFrame:
    """page_id, url, text, n_chars of each row of pages (page_id, url, html)."""

    @F.pandas_udf("string")
    def main_text(page: pd.Series) -> pd.Series:
        return page.map(lambda x: extract(x, weights), na_action=None)

    out = pages.select("page_id", "url", main_text(F.col("html")).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
