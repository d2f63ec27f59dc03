"""Main text of web pages: flat text blocks, classified by a decision tree over their own and their neighbours' figures."""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfactor.llm.tables import table

#: A comment, another declaration, a tag, a run of text, or a lone "<".
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:=\s*"[^"]*"|=\s*'[^']*'|[^>])*+)>|[^<]+|<""", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")

# Elements by what they mean for the text.
RAW = {x: re.compile(rf"</{x}(?![a-zA-Z0-9:-])", re.I) for x in "script style textarea title noscript template iframe xmp noembed noframes".split()}
SILENT = frozenset("head select option button svg datalist".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr img br "
                   "canvas object audio video map math mrow mi mn mo ms mtext mspace mfrac msqrt mroot msub msup msubsup munder mover munderover mmultiscripts mstyle mpadded mphantom menclose semantics annotation".split())
APART = frozenset("nav aside form menu dialog fieldset".split())
CLOSES_ITSELF = {"p": ("p",), "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "div": ("p",), "ul": ("p",), "ol": ("p",), "table": ("p",), "section": ("p",), "article": ("p",), "aside": ("p",), "nav": ("p",), "footer": ("p",), "header": ("p",), "form": ("p",), "h1": ("p",), "h2": ("p",), "h3": ("p",), "blockquote": ("p",)}
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
# Class names, ids and roles that mark what is not the article, alone or with the words below that name a box.
BESIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner sidebar sidenav rail nav navbar navigation menu "
    "breadcrumb breadcrumbs cookie cookies consent gdpr notice notices notification alert popup modal overlay newsletter subscribe subscription signup "
    "login share sharing social related recommended recommendations widget widgets pagination pager toolbar search comment comments reply replies respond "
    "disqus feedback skip masthead copyright legal disclaimer complementary contentinfo tags taglist outbrain taboola trending popular teaser teasers announcement toast".split()
)
EDGES = frozenset("header footer".split())
BOX_WORDS = frozenset(
    "site page main global top bottom left right inner outer upper lower primary secondary box block list area section item items bar panel unit slot zone wrap wrapper container content holder group link links "
    "form text title button buttons row col column info module body posts articles stories news bottom fixed sticky layer message center form count thread head"
    .split()
)
WHOLE = frozenset("html body main article".split())
COMMENTS = frozenset("comment comments reply replies respond disqus".split())
BOXES = ("container", "wrapper", "wrap", "layout", "page", "content", "body", "inner")
LEGAL = re.compile(r"©|\(c\)|copyright\b|all rights reserved", re.I)
FRAMES = ("layout", "page")
HOLDERS = ("has", "with", "no", "is")


@dataclass
class Block:
    """A run of text between block tags, and where it stood."""

    text: str
    words: int
    linked: int
    inside: bool
    apart: bool
    edge: bool
    heading: bool

    @property
    def density(self) -> float:
        return self.linked / self.words if self.words else 0.0


@dataclass
class _Open:
    name: str
    apart: bool
    edge: bool
    inside: bool
    silent: bool


@dataclass
class _Run:
    parts: list = field(default_factory=list)
    linked: list = field(default_factory=list)


def _hints(name: str, attributes: str) -> tuple[bool, bool]:
    """Does an element stand beside the article, is it a header or footer?"""
    apart, edge, comments = name in APART, name in EDGES, False
    if attributes.strip():
        for m in ATTRIBUTE.finditer(attributes):
            key, value = m[1].lower(), (m[2] or m[3] or m[4] or "").lower()
            if key in ("class", "id", "role"):
                for one in value.split():
                    p = [x for x in re.split(r"[-_]+", one) if x]
                    if not p or p[0] in HOLDERS or p[-1].endswith(BOXES) and (p[0] not in BESIDE or p[-1] in FRAMES):
                        continue
                    if not all(x in BESIDE or x in EDGES or x in BOX_WORDS or x.isdigit() for x in p):
                        continue  # a name with a word of its own, as "related-work"
                    comments |= bool(COMMENTS.intersection(p))
                    apart |= bool(BESIDE.intersection(p))
                    edge |= bool(EDGES.intersection(p))
    if name in WHOLE:
        apart, edge = comments and name == "article", False
    return apart, edge


def blocks(page: str | None) -> list[Block]:
    """The page's flat text blocks in page order; broken markup is read as far as it goes."""
    out: list[Block] = []
    stack: list[_Open] = []
    opened: Counter = Counter()
    run, links, at = _Run(), 0, 0
    page = page or ""
    heading = False

    def close() -> None:
        nonlocal run
        text = " ".join(entities.unescape("".join(run.parts)).split())
        if text:
            linked = len(entities.unescape(" ".join(run.linked)).split())
            top = stack[-1] if stack else _Open("", False, False, False, False)
            out.append(Block(text, len(text.split()), min(linked, len(text.split())), top.inside, top.apart, top.edge, heading))
        run = _Run()

    while m := TOKEN.match(page, at):
        got, at = m.group(), m.end()
        name = (m[2] or "").lower()
        if not name:
            if got[:1] == "<" and len(got) > 1:
                continue  # a comment or declaration
            if not (stack and stack[-1].silent):
                run.parts.append(got)
                if links:
                    run.linked.append(got)
            continue
        if name not in INLINE:
            close()
        if m[1]:
            if name == "a":
                links = max(0, links - 1)
            if name in HEADINGS:
                heading = False
            if opened[name] > 0:
                while True:
                    last = stack.pop().name
                    opened[last] -= 1
                    if last == name:
                        break
            continue
        if name == "br" or name in VOID:
            run.parts.append(" ")
            continue
        if m[3].rstrip().endswith("/") and name in SILENT:
            continue
        if name in RAW:
            # what is inside is no markup: go on at its own closing tag
            end = RAW[name].search(page, at)
            at = end.start() if end else len(page)
            continue
        if name == "a":
            links = 1  # links do not nest
        if name in INLINE and not m[3].strip():
            continue
        if name in HEADINGS:
            heading = True
        if name in CLOSES_ITSELF:
            k = len(stack)
            while k and stack[k - 1].name in INLINE:
                k -= 1
            if k and stack[k - 1].name in CLOSES_ITSELF[name]:
                opened.subtract(o.name for o in stack[k - 1 :])
                del stack[k - 1 :]
        apart, edge = _hints(name, m[3])
        above = stack[-1] if stack else _Open("", False, False, False, False)
        inside = above.inside or name in ("article", "main") and not apart
        # an article's own header belongs to it, a footer never does
        edge = edge and not (inside and name == "header")
        stack.append(_Open(name, above.apart or apart, above.edge or edge, inside, above.silent or name in SILENT))
        opened[name] += 1
    close()
    return out


def figures(found: list[Block]) -> np.ndarray:
    """Per block: words, link density, the neighbours' words and densities, and where it stands."""
    n = len(found)
    x = np.zeros((n + 2, 2))
    for i, b in enumerate(found):
        x[i + 1] = min(b.words, 200), b.density
    some = any(b.inside and not b.apart for b in found)
    place = np.array([[b.apart, b.edge, b.inside, b.heading, some, bool(LEGAL.match(b.text))] for b in found], float).reshape(n, 6)
    return np.concatenate([x[1:-1], x[:-2], x[2:], place], axis=1)


FIGURES = "words density words_before density_before words_after density_after apart edge inside heading article legal".split()

#: The labelled table: small pages in the usual shapes, each block marked "+" (main text) or "-". ``_`` is a page's text.
_LONG = "It was late in the year when the first of the boats came back up the river with what was left of the crew and their goods."
_MORE = "Nobody on the landing knew what to say to them, and so the old harbour master read out the names, one after another, slowly."
_LAST = "By the evening most of the town had gone home again."
_NAV = "<ul><li><a href='/a'>Home</a></li>-<li><a href='/b'>World news</a></li>-<li><a href='/c'>About us</a></li>-</ul>"
LABELLED = [
    f"<nav>{_NAV}</nav><div class='ad'>Buy two, pay for one.</div>-<article><h1>The boats</h1>+<p>{_LONG}</p>+<p>{_MORE}</p>+<p>Silence.</p>+<p>All rights reserved.</p>+</article><footer>All rights reserved 2020.</footer>-",
    f"<header><a href='/'>The Daily</a></header>-<main><h1>A short title</h1>+<p>{_LONG}</p>+<p>Yes.</p>+<p>{_LAST}</p>+<aside>Read also: ten ways to tie a rope to a post and why it matters.</aside>-</main><div class='sidebar'><p>Most read this week by people like you, our readers.</p>-{_NAV}</div>",
    f"<div id='menu'>{_NAV}</div><div id='content'><h1>River news</h1>+<p>{_LONG}</p>+<p>{_MORE}</p>+<p>{_LAST}</p>+</div><div id='comments'><p>Great story, I was there and saw it all with my own eyes that night!</p>-</div><div id='footer'>Contact us for more.</div>-",
    f"<table><tr><td>{_NAV}</td><td><h2>Harbour</h2>+<p>{_LONG}</p>+<p>{_MORE}</p>+<p>Rain.</p>+<p>{_LONG}</p>+</td><td><h3>Most read</h3>-{_NAV}</td></tr></table>",
    f"<div><a href='/1'>Login</a> | <a href='/2'>Help</a></div>-<div><h1>The names</h1>+<p>{_LONG}</p>+<p>{_MORE} <a href='/x'>More here</a></p>+<p>{_LAST}</p>+<h2>The goods</h2>+<p>{_MORE}</p>+</div><div><h4>Legal</h4>-<a href='/p'>Privacy policy</a> <a href='/t'>Terms</a></div>-",
    f"<form><p>Sign up for our letter and never miss a story from the river again.</p>-<label>Mail address</label>-</form><article><p>{_LONG}</p>+<div class='promo'>Advert: boats for sale, cheap.</div>-<p>{_LAST}</p>+<ul><li>First, the names.</li>+<li>Then, the goods.</li>+</ul></article>",
    f"<div class='cookie-notice'>We use cookies to make this site better for all of you who come here.</div>-<article><h1>Why</h1>+<p>So.</p>+</article><section class='comments'><article class='comment'><p>{_MORE}</p>-</article></section>",
    "<nav><a href='/'>Home</a>-</nav><article></article><footer>Imprint.</footer>-",
    f"<div><h1>Old news</h1>+<p>{_LONG}</p>+<p>See <a href='/s'>this</a>.</p>+<ul><li>one</li>+<li>two</li>+</ul></div><div>Copyright 1999 Old news.</div>-",
    f"<div><p>{_LAST}</p>+<p>{_LONG}</p>+<p>Rain.</p>+<p>{_MORE}</p>+</div><div><a href='/t'>Terms</a> <a href='/p'>Privacy</a></div>-",
    f"<div><h1>The year</h1>+<p>{_LONG}</p>+<p>{_LAST}</p>+</div><div><a href='/t'>Terms of use</a></div>-",
    f"<div><h1>Rain</h1>+<p>{_MORE}</p>+<p>It rained.</p>+</div>",
    f"<div><p>{_LONG}</p>+<h2>Goods</h2>+<ul><li>rope</li>+<li>nails</li>+</ul></div>",
    f"<div>Topics</div>-<div>{_NAV}</div><div><p>{_MORE}</p>+<p>{_LONG}</p>+</div><div>Top stories</div>-<div>{_NAV}</div>",
    f"<div><p>{_LONG}</p>+<p>{_LAST}</p>+</div><div>{_NAV}</div><div>Sections</div>-<div>{_NAV}</div>",
]


@dataclass
class Tree:
    """A node: a test on one figure, or the share of main text among its training blocks."""

    share: float
    figure: int = -1
    at: float = 0.0
    low: Tree | None = None
    high: Tree | None = None

    def predict(self, x: np.ndarray) -> np.ndarray:
        if self.figure < 0:
            return np.full(len(x), self.share >= 0.5)
        out, below = np.zeros(len(x), bool), x[:, self.figure] <= self.at
        out[below], out[~below] = self.low.predict(x[below]), self.high.predict(x[~below])
        return out


def grow(x: np.ndarray, y: np.ndarray, depth: int = 6, least: int = 1) -> Tree:
    """Splits where the Gini impurity falls most; at equal falls the earlier place figure, then the earlier figure."""
    tree = Tree(float(y.mean()) if len(y) else 0.0)
    if depth == 0 or len(y) < 2 * least or tree.share in (0.0, 1.0):
        return tree
    gini = lambda v: len(v) * v.mean() * (1 - v.mean()) if len(v) else 0.0
    best = (1e-12, None, 0.0)
    for k in [6, 7, 8, 9, 10, 11, 0, 1, 2, 3, 4, 5]:
        values = np.unique(x[:, k])
        for at in (values[1:] + values[:-1]) / 2:
            below = x[:, k] <= at
            if min(below.sum(), (~below).sum()) < least:
                continue
            fall = gini(y) - gini(y[below]) - gini(y[~below])
            if fall > best[0] + 1e-12:
                best = (fall, k, float(at))
    if best[1] is None:
        return tree
    below = x[:, best[1]] <= best[2]
    tree.figure, tree.at = best[1], best[2]
    tree.low, tree.high = grow(x[below], y[below], depth - 1, least), grow(x[~below], y[~below], depth - 1, least)
    return tree


def labelled() -> tuple[np.ndarray, np.ndarray]:
    """Figures and labels of the table's blocks; a label is the sign that follows a block's closing tag."""
    xs, ys = [], []
    for page in LABELLED:
        signs = re.findall(r"(?<=>)([+-])", page)
        found = blocks(re.sub(r"(?<=>)[+-]", "", page))
        if len(found) != len(signs):
            raise AssertionError(f"{len(signs)} labels for {len(found)} blocks: {[b.text[:20] for b in found]}")
        xs.append(figures(found))
        ys.append(np.array([s == "+" for s in signs], float))
    return np.concatenate(xs), np.concatenate(ys)


@lru_cache(maxsize=1)
def fitted() -> Tree:
    return grow(*labelled())


def main_text(page: str | None, tree: Tree | None = None) -> str:
    """The blocks that the tree takes for main text, one a line."""
    found = blocks(page)
    if not found:
        return ""
    keep = (tree or fitted()).predict(figures(found))
    return "\n".join(b.text for b, k in zip(found, keep) if k)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``(page_id, url, text, n_chars)``, one row per row of ``pages``; null, empty and textless pages have empty text.

    Ids and addresses may be null or repeat; other columns are not read. Each page is read alone, whole, in one pass.
    """
    tree = fitted()

    @F.pandas_udf("string")
    def text(pages: pd.Series) -> pd.Series:
        return pd.Series([main_text(p, tree) for p in pages], dtype=object)

    out = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), text(F.col(html)).alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
