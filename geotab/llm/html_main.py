"""Main text of HTML pages with a tree-structured graphical model.

A page becomes a tree of its block elements; each node is content or not. Node potentials come from the tag, words of
class, id and role, length of own and contained text and share of link text; parent-child potentials tie the
labels along the tree's edges. Messages are summed from the leaves up and from the root down, which gives exact
marginals; the text of nodes with a marginal of at least one half is the main text.

The potentials are trained by gradient steps on the likelihood over labelled pages: a bounded sample of
pages (SAMPLE, by a hash of the id) gives long and short text blocks, which are set into page layouts whose parts are
known to be content or not (article bodies; menus, headers, footers, sidebars, notices, adverts, forms,
related links, reader comments).

Defined cases: null or empty html gives an empty text; markup that ends early is read as far as it goes; scripts,
styles, comments, titles and form controls are never text; one of these without its end tag before the enclosing block ends (or
a button or select within another) goes on to the next block only; a head needs no end tag; a link without one ends with its block or at the next; text outside all blocks is a
block of its own, and a page of nothing but text is content; character references are decoded; <br> is white space;
repeated rows are extracted each; without a page to sample, built-in phrases fill the layouts; further columns are ignored.
"""

from __future__ import annotations

import html as _html
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches

SAMPLE = 200
LAYOUTS = 800
STEPS = 200

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<![^>]*>?|<\?[^>]*>?"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)",
    re.S,
)
_ATTR = re.compile(r"""(?:^|\s)(class|id|role|style|hidden|data-y|aria-hidden)\s*(?:=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.I)

_A = re.compile(r"<(/?)a(?=[\s/>])", re.I)

# Elements of HTML by their role here.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
SKIPPED = set("script style noscript template svg iframe object select textarea button title canvas audio video math datalist".split())
RAW = {"script", "style", "title", "textarea"}  # text up to their own end tag, whatever it holds
BLOCKS = set(
    "html body address article aside blockquote dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul center caption".split()
)
CLOSES_P = BLOCKS - {"html", "body", "li", "td", "th", "tr", "tbody", "thead", "tfoot", "caption"}
SELF_CLOSING = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
SELF_CLOSING |= {"tr": ({"tr", "td", "th"}, {"table", "tbody", "thead", "tfoot"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"})}

TAGS = "div section article main nav header footer aside form ul ol li p h1 h2 h3 h4 table tr td blockquote pre figure figcaption body dl dt dd details dialog".split()
MARKED = ["nav", "header", "footer", "aside", "form", "dialog"]
CUES = [
    r"nav|menu|breadcrumb|crumb|topbar|toolbar|pager|pagination|tabs?\b|toc\b|skip",
    r"foot|copyright|colophon|legal|bottom",
    r"head(er)?\b|masthead|banner|logo|branding|site-title",
    r"side|aside|widget|rail|complementary",
    r"\bads?\b|advert|sponsor|promo|\bad[-_]|[-_]ad\b|commercial|outbrain|taboola|affiliate",
    r"cookie|consent|notice|gdpr|alert|popup|modal|overlay|dialog|warning|message|announcement",
    r"comment|discuss|respon[ds]|repl(y|ies)|disqus|feedback|review",
    r"form|login|signup|sign-?in|register|subscri|newsletter|search|contact",
    r"share|social|follow|tweet|facebook|like",
    r"relat|recommend|more-|popular|trending|recent|next|prev|similar|also",
    r"hidden|display:\s*none|visibility:\s*hidden|sr-only|screen-reader",
    r"meta|byline|author|date|time|tags?\b|categor|posted",
    r"article|content|post|entry|story|main|body|text|prose|page|blog",
]
_CUES = [re.compile(c, re.I) for c in CUES]
_N_CUE = len(TAGS) + 1 + len(CUES)
_LENGTHS = (1, 25, 80, 200)
_INSIDE = (1, 60, 300, 1200)
_LINKS = (0.05, 0.25, 0.5)
WIDTH = _N_CUE + len(_LENGTHS) + 1 + len(_INSIDE) + 1 + 2 * (len(_LINKS) + 1) + 1


def cue_row(tag: str, words: str) -> np.ndarray:
    row = np.zeros(_N_CUE, bool)
    row[TAGS.index(tag) if tag in TAGS else len(TAGS)] = True
    for i, cue in enumerate(_CUES):
        row[len(TAGS) + 1 + i] = bool(words and cue.search(words))
    return row


class _Open(list):
    """Open elements and the block each belongs to, with the number open of each name."""

    def __init__(self):
        super().__init__([("", 0)])
        self.names: dict[str, int] = {}

    def append(self, item: tuple[str, int]) -> None:
        super().append(item)
        self.names[item[0]] = self.names.get(item[0], 0) + 1

    def pop(self) -> tuple[str, int]:
        item = super().pop()
        self.names[item[0]] -= 1
        if not self.names[item[0]]:
            del self.names[item[0]]
        return item

    def cut(self, i: int) -> None:
        while len(self) > i:
            self.pop()


class Page:
    """Block nodes of a page in document order, and its runs of text."""

    __slots__ = ("parent", "depth", "cue", "label", "runs", "own", "link", "bare")

    def __init__(self, source: str, cues: dict, labelled: bool = False):
        self.parent, self.depth, self.cue, self.label = [-1], [0], [self._cue("body", "", cues)], [None]
        self.own, self.link = [0], [0]
        self.runs: list[tuple[int, str]] = []
        stack = _Open()
        text: list[str] = []
        links = at = 0
        skip: list[int] = []  # starts of the open skipped element and of those of its name within it
        unclosed: set[int] = set()
        inner: list[str] = []  # blocks opened within it
        skipped, brief, resume = "", False, -1

        def node(tag: str, words: str, label) -> int:
            parent = stack[-1][1]
            self.parent.append(parent)
            self.depth.append(self.depth[parent] + 1)
            self.cue.append(self._cue(tag, words, cues))
            self.label.append(self.label[parent] if label is None else label)
            self.own.append(0)
            self.link.append(0)
            return len(self.parent) - 1

        linked = 0  # letters of the text at hand that are links

        def flush():
            nonlocal linked
            if text:
                said = " ".join(_html.unescape("".join(text)).split())
                text.clear()
                if said:
                    # text outside all blocks is a block of its own
                    k = stack[-1][1] or node("div", "", None)
                    self.runs.append((k, said))
                    self.own[k] += len(said)
                    self.link[k] += linked
                linked = 0

        while True:
            m = _TAG.search(source, at)
            if not m:
                if skip and resume >= 0:  # no end tag: go back to the first block within
                    unclosed.update(skip)
                    skip, at, links = [], resume, 0
                    continue
                break
            if m.start() > at and not skip:
                piece = source[at : m.start()]
                text.append(piece)
                if links:
                    linked += len(piece)
            at = m.end()
            tag = m[2] or m[5]
            if not tag:
                continue
            tag = tag.lower()
            closing = m[1] or m[4]
            ended = (m[3] or m[6] or "").rstrip().endswith("/")
            if skip:
                if tag in RAW and not closing:
                    if not (ended and skipped in ("svg", "math")):
                        at = self._raw_end(source, at, tag)
                    continue
                if tag == skipped:
                    if closing:
                        skip.pop()
                    elif tag in ("button", "select"):  # ends the one before
                        skip, inner, brief, resume = [m.start()], [], m.start() in unclosed, -1
                    elif not ended:
                        skip.append(m.start())
                    continue
                if tag not in BLOCKS:
                    continue
                if not closing and not brief:
                    resume = m.start() if resume < 0 else resume
                    if tag not in VOID:
                        inner.append(tag)
                    continue
                if closing:
                    if tag in inner:
                        while inner.pop() != tag:
                            pass
                        continue
                    if tag not in ("body", "html") and tag not in stack.names:
                        continue
                    unclosed.update(skip)
                    links = 0
                    if resume >= 0:
                        skip, at = [], resume
                        continue
                skip = []
            if closing:
                if tag == "a":
                    links = 0
                    continue
                if tag not in stack.names:
                    continue
                if tag in BLOCKS:
                    flush()
                    links = 0 if links == 2 else links
                while stack.pop()[0] != tag:
                    pass
                continue
            if tag in SKIPPED:
                if tag in RAW:
                    at = self._raw_end(source, at, tag)
                elif not ended:
                    skip, skipped, inner, brief, resume = [m.start()], tag, [], m.start() in unclosed, -1
                continue
            if tag == "br":
                text.append(" ")
                continue
            if tag in VOID and tag != "hr":
                continue
            if tag == "a":
                # a link without its end tag before the next one ends with the block, or where one begins
                end = _A.search(source, at)
                links = 1 if end and end[1] else 2
                continue
            if tag not in BLOCKS:
                continue
            flush()
            links = 0 if links == 2 else links
            if tag in CLOSES_P:
                self._close(stack, {"p"}, {"td", "th", "li", "table", "blockquote", "div", "section", "article"})
            if tag in SELF_CLOSING:
                self._close(stack, *SELF_CLOSING[tag])
            if tag in ("hr", "html", "body"):
                continue
            attrs = m[3] or m[6] or ""
            words, label = "", None
            if attrs.strip():
                found = [(a.lower(), b or c or d or "") for a, b, c, d in _ATTR.findall(attrs)]
                words = " ".join(b if a in ("class", "id", "role") else f"{a}:{b}" for a, b in found if a != "data-y" and (a != "style" or "none" in b or "hidden" in b))
                if labelled:
                    label = next((int(b) for a, b in found if a == "data-y"), None)
            stack.append((tag, node(tag, words, label)))
        if at < len(source) and not skip:
            text.append(source[at:])
        blocks = len(self.parent)
        flush()
        self.bare = blocks == 1  # nothing but text

    @staticmethod
    def _raw_end(source: str, at: int, tag: str) -> int:
        end = re.compile(rf"</{tag}[^>]*(?:>|\Z)", re.I).search(source, at)
        return end.end() if end else len(source)

    @staticmethod
    def _cue(tag: str, words: str, cues: dict) -> int:
        key = (tag, words)
        n = cues.get(key)
        if n is None:
            n = cues[key] = len(cues)
        return n

    @staticmethod
    def _close(stack, closed, border):
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] in closed:
                stack.cut(i)
                return
            if stack[i][0] in border:
                return


class Forest:
    """Pages joined into arrays: parents, levels from the root, features."""

    def __init__(self, pages: list[Page], cues: dict, rows: list):
        for tag, words in list(cues)[len(rows) :]:
            rows.append(cue_row(tag, words))
        sizes = np.array([len(p.parent) for p in pages], np.int64)
        self.first = np.cumsum(sizes) - sizes
        base = np.repeat(self.first, sizes)
        parent = np.concatenate([p.parent for p in pages]).astype(np.int64)
        self.root = parent < 0
        self.parent = np.where(self.root, np.arange(len(parent)), parent + base)
        depth = np.concatenate([p.depth for p in pages])
        self.levels = np.split(np.argsort(depth, kind="stable"), np.cumsum(np.bincount(depth))[:-1])
        cue = np.array(rows)[np.concatenate([p.cue for p in pages])]
        own = np.concatenate([p.own for p in pages]).astype(float)
        link = np.concatenate([p.link for p in pages]).astype(float)
        inside, linked = own.copy(), link.copy()
        for nodes in self.levels[:0:-1]:
            np.add.at(inside, self.parent[nodes], inside[nodes])
            np.add.at(linked, self.parent[nodes], linked[nodes])
        one = lambda v, cuts: np.eye(len(cuts) + 1, dtype=bool)[np.searchsorted(cuts, v, "right")]
        share = lambda a, b: np.where(b > 0, a / np.maximum(b, 1), 0)
        self.x = np.hstack((cue, one(own, _LENGTHS), one(inside, _INSIDE), one(share(link, own), _LINKS), one(share(linked, inside), _LINKS), np.ones((len(own), 1), bool))).astype(float)
        marked = cue[:, len(TAGS) + 1 :].any(1) | cue[:, [TAGS.index(t) for t in MARKED]].any(1)
        self.kind = marked.astype(int) + 2 * cue[:, TAGS.index("p")].astype(int)

    def marginals(self, node: np.ndarray, edge: np.ndarray):
        """Probability of content of each node, and of each pair (parent's label, own label) along its edge.

        node: weights of the features; edge: log potentials (kind of child, parent's label, own label).
        """
        inner = np.zeros((len(self.parent), 2))
        inner[:, 1] = self.x @ node
        up = np.zeros_like(inner)
        for nodes in self.levels[:0:-1]:
            z = edge[self.kind[nodes]] + inner[nodes, None, :]
            up[nodes] = np.logaddexp(z[..., 0], z[..., 1])
            np.add.at(inner, self.parent[nodes], up[nodes])
        belief = inner.copy()
        pair = np.zeros((len(inner), 2, 2))
        for nodes in self.levels[1:]:
            z = (belief[self.parent[nodes]] - up[nodes])[:, :, None] + edge[self.kind[nodes]]
            belief[nodes] += np.logaddexp(z[:, 0], z[:, 1])
            z = z + inner[nodes, None, :]
            z = np.exp(z - z.max((1, 2), keepdims=True))
            pair[nodes] = z / z.sum((1, 2), keepdims=True)
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -50, 50))), pair


class Model:
    def __init__(self, node: np.ndarray, edge: np.ndarray):
        self.node, self.edge = node, edge
        self._cues: dict = {}
        self._rows: list = []

    def __getstate__(self):
        return self.node, self.edge

    def __setstate__(self, state):
        self.__init__(*state)

    def extract(self, sources: list[str | None]) -> list[str]:
        out: list[str] = []
        if len(self._cues) > 20_000:
            self._cues, self._rows = {}, []
        at = 0
        while at < len(sources):
            to, size = at, 0
            while to < len(sources) and (to == at or size < 1 << 21):
                size += len(sources[to] or "")
                to += 1
            pages = [Page(s or "", self._cues) for s in sources[at:to]]
            forest = Forest(pages, self._cues, self._rows)
            content = forest.marginals(self.node, self.edge)[0] >= 0.5
            for page, first in zip(pages, forest.first):
                out.append("\n\n".join(said for n, said in page.runs if page.bare or content[first + n]))
            at = to
        return out


# ---------------------------------------------------------------- labelled pages

_PARTS = {
    "menu": ('<nav{c}>', "</nav>", ["", ' class="main-nav"', ' id="menu"', ' role="navigation"'], '<div{c}>', ["menu", "navbar", "breadcrumbs", "site-nav", "topbar"]),
    "header": ("<header{c}>", "</header>", ["", ' class="site-header"', ' id="header"', ' role="banner"'], "<div{c}>", ["header", "masthead", "site-header", "branding"]),
    "footer": ("<footer{c}>", "</footer>", ["", ' class="site-footer"', ' id="footer"'], "<div{c}>", ["footer", "site-footer", "copyright", "bottom-bar"]),
    "side": ("<aside{c}>", "</aside>", ["", ' class="sidebar"', ' id="rail"'], "<div{c}>", ["sidebar", "side", "widget", "right-rail"]),
    "ad": ("<aside{c}>", "</aside>", [' class="ad"', ' class="sponsored"'], "<div{c}>", ["ad", "ads", "advert", "advertisement", "sponsor", "promo", "ad-slot", "banner-ad"]),
    "notice": ("<section{c}>", "</section>", [' class="cookie-notice"', ' role="alert"'], "<div{c}>", ["cookie", "cookie-banner", "notice", "consent", "gdpr-popup", "alert", "modal"]),
    "comments": ("<section{c}>", "</section>", [' class="comments"', ' id="comments"'], "<div{c}>", ["comments", "comment-list", "discussion", "responses", "reader-comments"]),
    "form": ("<form{c}>", "</form>", ["", ' class="newsletter"', ' id="search"', ' class="login"'], "<div{c}>", ["newsletter", "signup", "search-form", "contact-form", "subscribe"]),
    "related": ("<section{c}>", "</section>", [' class="related"'], "<div{c}>", ["related", "related-posts", "recommended", "popular", "more-stories", "share", "social-share"]),
}
_HOMES = [
    ("<article{c}>", "</article>", ["", ' class="post"', ' id="article"', ' class="story"', ""]),
    ("<article{c}>", "</article>", ["", ""]),
    ("<main{c}>", "</main>", ["", ' id="content"', ' role="main"']),
    ("<div{c}>", "</div>", [' class="content"', ' id="content"', ' class="post-body"', ' class="entry-content"', ' class="article-text"', ' id="main"', ' class="story-body"', ""]),
    ("<section{c}>", "</section>", [' class="content"', "", ' class="article"']),
]


def layout(rng: np.random.Generator, long: list[str], short: list[str]) -> str:
    """A page made of these texts with data-y marks: 1 on content, 0 on the rest."""
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    brief = lambda: _html.escape(pick(short)[: int(rng.integers(8, 90))])
    full = lambda: _html.escape(pick(long))

    def part(name: str) -> str:
        tag, end, attrs, plain, classes = _PARTS[name]
        if rng.random() < 0.5:
            opening = tag.format(c=f'{pick(attrs)} data-y="0"')
        else:
            kind = "class" if rng.random() < 0.7 else "id"
            opening, end = plain.format(c=f' {kind}="{pick(classes)}" data-y="0"'), "</div>"
        linked = lambda: f'<a href="/x">{brief()}</a>'
        if name in ("menu", "related"):
            n = int(rng.integers(3, 9))
            body = "<ul>" + "".join(f"<li>{linked()}</li>" for _ in range(n)) + "</ul>" if rng.random() < 0.7 else " ".join(linked() for _ in range(n))
        elif name == "comments":
            wrap = pick([("<p>", "</p>"), ('<div class="comment">', "</div>"), ('<li><p>', "</p></li>"), ('<div class="comment"><p>', "</p></div>"), ('<article class="comment"><p>', "</p></article>")])
            body = "<h3>" + brief() + "</h3>" + "".join(wrap[0] + (full() if rng.random() < 0.6 else brief()) + wrap[1] for _ in range(int(rng.integers(1, 5))))
        elif name == "form":
            body = f"<label>{brief()}</label><input><button>{brief()}</button><p>{brief()}</p>"
        elif name == "header":
            body = pick([f"<h1>{brief()}</h1>", f"<p>{brief()}</p>", f"<h2>{brief()}</h2><p>{brief()}</p>", linked()])
        else:
            body = pick([brief(), f"<p>{brief()}</p>", f"<p>{full()}</p>", f"<h3>{brief()}</h3><p>{brief()}</p>", f"<p>{linked()}</p>"])
            if rng.random() < 0.3:
                body += "<ul>" + "".join(f"<li>{linked()}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        return opening + body + end

    def block() -> str:
        r = rng.random()
        if r < 0.62:
            return f"<p>{full()}</p>"
        if r < 0.72:
            return f"<p>{brief()}</p>"
        if r < 0.78:
            return f"<h2>{brief()}</h2>"
        if r < 0.84:
            return "<ul>" + "".join(f"<li>{brief()}</li>" for _ in range(int(rng.integers(2, 6)))) + "</ul>"
        if r < 0.88:
            return f"<blockquote><p>{full()}</p></blockquote>"
        if r < 0.91:
            return f"<p><b>{brief()}<br><p>{full()}</p>"
        if r < 0.95:
            return f'<p>{brief()} <a href="/y">{brief()}</a> {full()}</p>'
        return f"<div><p>{full()}</p><p>{full()}</p></div>" if r < 0.98 else f"<table><tr><td>{brief()}</td><td>{brief()}</td></tr></table>"

    tag, end, attrs = pick(_HOMES)
    title = f"<h1>{brief()}</h1>"
    inside = [block() for _ in range(int(rng.integers(1, 12)))]
    for name in ("ad", "related", "comments", "form", "notice", "side"):
        if rng.random() < 0.13:
            inside.insert(int(rng.integers(1, len(inside) + 1)) if name == "ad" else len(inside), part(name))
    home = tag.format(c=f'{pick(attrs)} data-y="1"') + (title if rng.random() < 0.75 else "") + "".join(inside) + end
    before = [part(n) for n, p in (("notice", 0.25), ("header", 0.5), ("menu", 0.7), ("ad", 0.35), ("form", 0.15)) if rng.random() < p]
    after = [part(n) for n, p in (("side", 0.35), ("related", 0.3), ("comments", 0.35), ("form", 0.2), ("notice", 0.1), ("ad", 0.2), ("footer", 0.75)) if rng.random() < p]
    body = "".join(before) + home + "".join(after)
    for _ in range(int(rng.integers(0, 3))):
        body = f'<div{pick(["", " class=wrapper", " id=page", " class=container"])} data-y="0">{body}</div>'
    return f'<html><body><div data-y="0">{body}</div></body></html>' if rng.random() < 0.3 else f"<html><body>{body}</body></html>"


_LONG = ["The committee met again on Tuesday to discuss the results, and after some hours of debate it agreed on a plan that everyone could accept."]
_SHORT = ["Home", "About us", "Read more", "All rights reserved", "Sign up today"]


def fit(sources: list[str], layouts: int = LAYOUTS, steps: int = STEPS) -> Model:
    """Potentials from labelled layouts filled with the text blocks of these pages."""
    cues: dict = {}
    said = [s for source in sources for _, s in Page(source or "", cues).runs]
    long = sorted({s for s in said if len(s) >= 120}) or _LONG
    short = sorted({s for s in said if len(s) < 90}) or _SHORT
    rng = np.random.default_rng(11)
    cues = {}
    pages = [Page(layout(rng, long, short), cues, labelled=True) for _ in range(layouts)]
    rows: list = []
    forest = Forest(pages, cues, rows)
    y = np.array([bool(v) for p in pages for v in p.label])
    node, edge = np.zeros(WIDTH), np.zeros((4, 2, 2))
    child = ~forest.root
    true = np.zeros((4, 2, 2))
    np.add.at(true, (forest.kind[child], y[forest.parent[child]].astype(int), y[child].astype(int)), 1)
    m = [np.zeros_like(node), np.zeros_like(edge)]
    v = [np.zeros_like(node), np.zeros_like(edge)]
    for step in range(1, steps + 1):
        p, pair = forest.marginals(node, edge)
        have = np.zeros((4, 2, 2))
        np.add.at(have, forest.kind[child], pair[child])
        grad = [(forest.x.T @ (y - p)) / layouts - 2e-3 * node, (true - have) / layouts - 2e-3 * edge]
        for k, (w, g) in enumerate(zip((node, edge), grad)):
            m[k] = 0.9 * m[k] + 0.1 * g
            v[k] = 0.99 * v[k] + 0.01 * g * g
            w += 0.15 * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return Model(node, edge)


def train(pages: DataFrame, sample: int = SAMPLE) -> Model:
    """Potentials from a bounded sample of pages (page_id, html)."""
    rows = pages.where("html is not null and page_id is not null")
    # ids first: a sorted limit brings a row of each kind from every task to the driver
    ids = [r[0] for r in rows.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    chosen = rows.where(F.col("page_id").isin(ids)).select("page_id", "html").dropDuplicates(["page_id"]).toPandas() if ids else None
    return fit([] if chosen is None else list(chosen.sort_values("page_id")["html"]))


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """pages (html, ...) with text and n_chars."""
    bounded_batches(pages)

    @F.arrow_udf("text string, n_chars long")
    def run(source: pa.Array) -> pa.Array:
        texts = model.extract(source.to_pylist())
        return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["text", "n_chars"])

    found = pages.withColumn("_found", run(F.col("html").cast("string")))
    return found.withColumn("text", F.col("_found.text")).withColumn("n_chars", F.col("_found.n_chars")).drop("_found")
