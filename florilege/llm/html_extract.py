"""Main text of web pages by a tree-structured graphical model over the DOM.

Every block element is a node with one of three states: content, boilerplate, or mixed (a wrapper of
both). A child's state depends on its parent's state and its own tag, as do its class and id words on both
states; text length, link share and the number of paragraphs below depend on the node's own state.
Sum-product messages, once up and once down the tree, give each node's marginals; a block's text is
kept where content is the likeliest state of its node. All tables are smoothed counts over labelled
pages; `training_pages` makes them, as the corpus holds none.

Scripts, styles, titles, form controls, templates, frames and drawings never hold text of a page, nor does
a noscript that stands by itself, which is a notice; all other inline elements do, a noscript among the
words of a paragraph too. Each table cell is a block of its own. Within a block, character references are decoded, white space (a <br> too)
becomes one space and ends are trimmed; blocks are joined by an empty line.

Defined cases: null or empty html gives an empty text of 0 characters; unclosed or stray tags are
repaired as browsers do for paragraphs, list items and table cells, in time linear in the page; an
unclosed script, style, title, text area or frame runs to the end of the page, as in browsers, any
other silent element to the end of the block it began in; a tag cut off at the end of the page is no
text; repeated rows are extracted each; null ids and urls stay null; no rows give no rows; other
columns are not read.
"""

from __future__ import annotations

import html as entities
import math
import random
import re
from bisect import bisect_right
from collections import Counter, defaultdict
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from florilege.llm.common import slices

CONTENT, BOILERPLATE, MIXED = range(3)
BLOCK = frozenset("address article aside blockquote body canvas caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul".split())
RAW = frozenset("script style textarea title iframe noframes noembed".split())  # no markup inside
SILENT = frozenset("noscript template svg select button option datalist".split())  # markup, but no text of the page
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"li": {"li"}, "dd": {"dd", "dt"}, "dt": {"dd", "dt"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody"}}
FENCES = {"li": {"ul", "ol", "menu"}, "dd": {"dl"}, "dt": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}, "tbody": {"table"}, "tfoot": {"table"}}
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[a-zA-Z/][^>]*>|<[!?][^>]*>|<[a-zA-Z/!?][^>]*\Z", re.S)
NAMED = re.compile(r"""\b(class|id|role|itemprop)\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+)""", re.I)
HIDDEN = re.compile(r"""\bhidden\b(?!\s*=\s*["']?until)|aria-hidden\s*=\s*["']?true|display\s*:\s*none""", re.I)
NAME_WORD = re.compile(r"[a-z]+|[A-Z]+(?![a-z])|[A-Z][a-z]+")


class Node:
    __slots__ = ("below", "links", "names", "own", "parent", "state", "tag", "text")

    def __init__(self, tag: str, parent: int, names: frozenset[str]) -> None:
        self.tag, self.parent, self.names = tag, parent, names
        self.own = 0  # characters of its own text, links left out of `text` by `links`
        self.text = self.links = self.below = 0  # over its subtree: characters, of them in links, paragraphs
        self.state = None


def _names(attributes: str) -> frozenset[str]:
    found = {w.lower() for _, v in NAMED.findall(attributes) for w in NAME_WORD.findall(v)}
    if HIDDEN.search(attributes):
        found.add("~hidden")
    return frozenset(found)


def parse(page: str) -> tuple[list[Node], list[tuple[int, str]]]:
    """Block nodes in document order, a root first, and (node, text) of each block in page order."""
    nodes, stack, blocks = [Node("html", -1, frozenset())], [0], []
    depths: dict[str, list[int]] = defaultdict(list)  # of the open elements of each tag, the root left out
    buffer: list[str] = []
    linked = in_link = at = 0
    mute = None  # (tag, depth of the stack) of the silent element that is open

    def flush():
        nonlocal linked, in_link
        if buffer:
            text = " ".join(entities.unescape("".join(buffer)).split())
            if text:
                node = nodes[stack[-1]]
                node.own += len(text)
                node.text += len(text)
                node.links += min(linked, len(text))
                blocks.append((stack[-1], text))
            buffer.clear()
        linked = 0

    def text_to(end: int):
        nonlocal linked
        if end > at and mute is None:
            buffer.append(page[at:end])
            linked += (end - at) * bool(in_link)

    def close_from(depth: int):
        """Closes the elements from this depth of the stack on."""
        nonlocal mute
        while len(stack) > depth:
            depths[nodes[stack.pop()].tag].pop()
        if mute and mute[1] > len(stack):
            mute = None

    def lowest_open(tags, above: int) -> int:
        return max((depths[t][-1] for t in tags if depths[t]), default=above)

    pos = 0
    while m := TOKEN.search(page, pos):
        text_to(m.start())
        at = pos = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "a":
                in_link = 0
            elif tag in SILENT:
                if mute and mute[0] == tag:
                    mute = None
            elif tag in BLOCK:
                flush()
                in_link = 0
                if depths[tag]:
                    close_from(depths[tag][-1])
            continue
        if tag in RAW:
            if not m[3].endswith("/"):
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, pos)
                at = pos = end.start() if end else len(page)
            buffer.append(" ")
        elif tag in SILENT and not (tag == "noscript" and nodes[stack[-1]].tag == "p"):
            buffer.append(" ")
            if mute is None and not m[3].endswith("/"):
                mute = tag, len(stack)
        elif tag == "br":
            buffer.append(" ")
        elif tag == "a":
            in_link = 1
        elif tag in BLOCK:
            flush()
            in_link = 0
            if tag in ("html", "body") and (tag == "html" or depths[tag]):
                continue
            if nodes[stack[-1]].tag == "head" and tag == "body":
                close_from(len(stack) - 1)
            if tag in CLOSES:
                fence = lowest_open(FENCES[tag], 0)
                shut = lowest_open(CLOSES[tag], 0)
                first_p = bisect_right(depths["p"], fence)
                if shut > fence:
                    close_from(shut)
                elif first_p < len(depths["p"]):
                    close_from(depths["p"][first_p])
            while nodes[stack[-1]].tag == "p":
                close_from(len(stack) - 1)
            nodes.append(Node(tag, stack[-1], _names(m[3])))
            if tag not in VOID:
                depths[tag].append(len(stack))
                stack.append(len(nodes) - 1)
    text_to(len(page))
    flush()
    for i in range(len(nodes) - 1, 0, -1):
        node, up = nodes[i], nodes[nodes[i].parent]
        node.below += node.tag == "p" and node.own > 0
        up.text += node.text
        up.links += node.links
        up.below += node.below
    return nodes, blocks


def evidence(node: Node) -> list[str]:
    """What a node shows of its state, each as a word."""
    found = [f"own:{sum(node.own >= x for x in (1, 25, 80, 250))}"]
    found.append(f"link:{-1 if not node.text else sum(node.links >= x * node.text for x in (0.1, 0.4, 0.8))}")
    found.append(f"below:{sum(node.below >= x for x in (1, 3, 8))}")
    return found


class Model:
    """Smoothed log tables; `fit` counts them."""

    def __init__(self) -> None:
        self.step: dict[tuple[str, int], list[float]] = {}
        self.any_step: list[list[float]] = []
        self.named: dict[str, list[list[float]]] = {}
        self.shows: dict[str, list[float]] = {}

    def fit(self, pages: list[list[Node]]) -> Model:
        step, any_step, shows, named, total = defaultdict(Counter), [Counter() for _ in range(3)], defaultdict(Counter), defaultdict(Counter), Counter()
        for nodes in pages:
            for node in nodes[1:]:
                up = nodes[node.parent].state
                step[node.tag, up][node.state] += 1
                any_step[up][node.state] += 1
                total[node.state] += 1
                for w in node.names:
                    named[w][up, node.state] += 1
                for e in evidence(node):
                    shows[e][node.state] += 1
        self.any_step = [[math.log((c[s] + 0.5) / (sum(c.values()) + 1.5)) for s in range(3)] for c in any_step]
        for key, c in step.items():
            back = self.any_step[key[1]]
            self.step[key] = [math.log((c[s] + 2 * math.exp(back[s])) / (sum(c.values()) + 2)) for s in range(3)]
        for w, c in named.items():
            self.named[w] = [[math.log((c[up, s] + 0.1) / (any_step[up][s] + 3)) for s in range(3)] for up in range(3)]
        for e, c in shows.items():
            self.shows[e] = [math.log((c[s] + 0.3) / (total[s] + 1)) for s in range(3)]
        return self

    def marginals(self, nodes: list[Node]) -> list[list[float]]:
        """Sum-product: messages from the leaves to the root, then back."""
        n = len(nodes)
        weight = [[0.0, 0.0, 0.0] for _ in range(n)]
        weight[0] = [math.log(0.05), math.log(0.05), math.log(0.9)]
        for i in range(1, n):
            for e in evidence(nodes[i]):
                if own := self.shows.get(e):
                    for s in range(3):
                        weight[i][s] += own[s]
        table = [None] + [[self.step.get((x.tag, up), self.any_step[up]) for up in range(3)] for x in nodes[1:]]
        for i, x in enumerate(nodes):
            for own in (self.named[w] for w in x.names if i and w in self.named):
                table[i] = [[t + o for t, o in zip(row, more, strict=True)] for row, more in zip(table[i], own, strict=True)]
        up_message = [None] * n
        for i in range(n - 1, 0, -1):
            own = []
            for up in range(3):
                terms = [table[i][up][s] + weight[i][s] for s in range(3)]
                top = max(terms)
                own.append(top + math.log(sum(math.exp(t - top) for t in terms)))
            up_message[i] = own
            parent = weight[nodes[i].parent]
            for up in range(3):
                parent[up] += own[up]
        belief = [None] * n
        belief[0] = weight[0]
        for i in range(1, n):
            above = belief[nodes[i].parent]
            # the parent's belief without this child's message
            rest = [above[up] - up_message[i][up] for up in range(3)]
            own = []
            for s in range(3):
                terms = [rest[up] + table[i][up][s] for up in range(3)]
                top = max(terms)
                own.append(top + math.log(sum(math.exp(t - top) for t in terms)) + weight[i][s])
            top = max(own)
            belief[i] = [x - top for x in own]
        out = []
        for b in belief:
            top = max(b)
            e = [math.exp(x - top) for x in b]
            out.append([x / sum(e) for x in e])
        return out

    def extract(self, page: str | None) -> str:
        if not page:
            return ""
        nodes, blocks = parse(page)
        p = self.marginals(nodes)
        return "\n\n".join(text for i, text in blocks if p[i][CONTENT] > p[i][BOILERPLATE] and p[i][CONTENT] + p[i][MIXED] >= 0.5)


# Training pages. Names that page authors give to regions, by what the region holds.
GOOD_NAMES = ("content", "article", "post", "entry", "story", "main", "article-body", "post-content", "entry-content", "article-content", "body-text", "text", "prose", "page-content", "story-body", "articleBody", "blog-post", "main-content")
BAD_REGIONS = {
    "nav": ("menu", "navigation", "navbar", "nav", "breadcrumb", "breadcrumbs", "pagination", "pager", "topbar", "toc", "skip"),
    "header": ("header", "masthead", "site-header", "banner", "logo", "branding", "top"),
    "footer": ("footer", "site-footer", "copyright", "colophon", "bottom", "legal", "page-footer"),
    "aside": ("sidebar", "side", "widget", "related", "related-posts", "recommended", "more", "popular", "trending", "tags", "author-bio", "aside", "rail"),
    "ad": ("ad", "ads", "advert", "advertisement", "sponsor", "sponsored", "promo", "promotion", "banner-ad", "adsense", "ad-slot", "outbrain", "taboola"),
    "notice": ("cookie", "cookies", "consent", "gdpr", "notice", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup", "paywall", "disclaimer", "message"),
    "share": ("share", "social", "sharing", "share-buttons", "follow", "social-links"),
    "comments": ("comments", "comment-list", "comment", "replies", "reply", "respond", "discussion", "disqus", "comment-section"),
    "form": ("search", "search-form", "login", "form", "contact-form", "subscribe-form"),
}
HOLDERS = {"nav": ("nav", "div", "ul"), "header": ("header", "div"), "footer": ("footer", "div"), "aside": ("aside", "div", "section"), "ad": ("div", "aside", "section"), "notice": ("div", "section", "aside"), "share": ("div", "ul"), "comments": ("section", "div", "aside"), "form": ("form", "div")}


def _prose(r: random.Random, least: int, most: int) -> str:
    words = ["".join(r.choice("aeiou") + r.choice("bcdfglmnprst") for _ in range(r.randint(1, 4))) for _ in range(r.randint(least, most))]
    out = []
    while words:
        n = r.randint(4, 18)
        out.append(" ".join(words[:n]).capitalize() + r.choice("....?!"))
        words = words[n:]
    return " ".join(out)


def _name(r: random.Random, names: tuple[str, ...], chance: float) -> str:
    if r.random() > chance:
        return ""
    return f' {r.choice(("class", "class", "id"))}="{r.choice(names)}"'


def _boilerplate(r: random.Random, kind: str) -> str:
    tag = r.choice(HOLDERS[kind])
    telling = tag in ("nav", "header", "footer", "aside", "form")
    start = f'<{tag} data-l="1"{_name(r, BAD_REGIONS[kind], 0.5 if telling else 1.0)}>'
    link = lambda: f'<a href="#">{_prose(r, 1, 4).rstrip(".?!")}</a>'
    if kind in ("nav", "share"):
        items = "".join(f"<li>{link()}</li>" for _ in range(r.randint(3, 9)))
        inner = items if tag == "ul" else f"<ul>{items}</ul>" if r.random() < 0.7 else " ".join(link() for _ in range(6))
    elif kind == "comments":
        one = lambda: r.choice((f"<div>{_prose(r, 1, 3)}<p>{_prose(r, 5, 60)}</p></div>", f'<article class="comment"><p>{_prose(r, 5, 60)}</p></article>', f'<li class="comment"><p>{_prose(r, 4, 50)}</p></li>', f"<p>{_prose(r, 5, 50)}</p>"))
        inner = f"<h3>{_prose(r, 1, 3)}</h3>" + "".join(one() for _ in range(r.randint(1, 7)))
    elif kind == "form":
        inner = f"<p>{_prose(r, 1, 8)}</p><input><label>{_prose(r, 1, 2)}</label><button>{_prose(r, 1, 2)}</button>"
    elif kind == "aside":
        inner = f"<h{r.choice('234')}>{_prose(r, 1, 4)}</h3>" + r.choice(("<ul>" + "".join(f"<li>{link()}</li>" for _ in range(4)) + "</ul>", "".join(f"<p>{link()}</p>" for _ in range(3)), f"<p>{_prose(r, 5, 50)}</p>"))
    elif kind in ("ad", "notice") or tag == "p":
        inner = _prose(r, 3, 45) + (link() if r.random() < 0.4 else "")
        inner = inner if tag == "p" or r.random() < 0.6 else f"<p>{inner}</p>"
    elif kind == "footer":
        inner = r.choice((f"&copy; {_prose(r, 2, 12)}", f"<p>{_prose(r, 2, 12)}</p><ul><li>{link()}</li><li>{link()}</li></ul>", f"<div>{link()} {link()}</div><p>{_prose(r, 3, 25)}</p>"))
    else:
        inner = r.choice((f"<h1>{_prose(r, 1, 4)}</h1><p>{_prose(r, 2, 8)}</p>", f"{link()} {link()}", f"<div>{_prose(r, 1, 5)}</div><nav><ul><li>{link()}</li><li>{link()}</li></ul></nav>"))
    return f"{start}{inner}</{tag}>"


def _article(r: random.Random, leaf: str) -> str:
    out = [f"<h{r.choice('112')}>{_prose(r, 2, 12)}</h1>"] if r.random() < 0.8 else []
    for _ in range(r.choice((1, 2, 4, 8, 15, 30))):
        x = r.random()
        if x < 0.72:
            text = _prose(r, 1, r.choice((4, 15, 60, 150)))
            text = f"<a href='#'>{text}</a>" if r.random() < 0.02 else text
            out.append(f"<{leaf}>{text}</{leaf}>" if r.random() < 0.9 else f"<{leaf}><b>{text}<br>")
        elif x < 0.8:
            out.append(f"<h{r.choice('23')}>{_prose(r, 1, 8)}</h2>")
        elif x < 0.88:
            out.append("<ul>" + "".join(f"<li>{_prose(r, 2, 25)}</li>" for _ in range(r.randint(2, 6))) + "</ul>")
        elif x < 0.93:
            out.append(f"<blockquote>{r.choice(('{}', '<p>{}</p>')).format(_prose(r, 5, 50))}</blockquote>")
        elif x < 0.95:
            out.append("<table>" + "".join(f"<tr><td>{_prose(r, 1, 4)}</td><td>{_prose(r, 1, 6)}</td></tr>" for _ in range(3)) + "</table>")
        elif x < 0.97:
            out.append(f"<figure><img><figcaption>{_prose(r, 3, 20)}</figcaption></figure><pre>{_prose(r, 3, 20)}</pre>")
        else:
            out.append(_boilerplate(r, r.choice(("ad", "share", "notice", "aside", "form"))))
    return "".join(out)


def training_pages(number: int = 600, seed: int = 11) -> list[list[Node]]:
    """Parsed pages with the state of every node."""
    r, pages = random.Random(seed), []
    for _ in range(number):
        leaf = r.choice(("p", "p", "p", "p", "p", "div"))
        holder = r.choice(("article", "article", "main", "div", "div", "div", "section", "td"))
        named = _name(r, GOOD_NAMES, 0.4 if holder in ("article", "main") else 0.9)
        core = f'<{holder} data-l="0"{named}>{_article(r, leaf)}{_boilerplate(r, "comments") if r.random() < 0.1 else ""}</{holder}>'
        if holder == "td":
            core = f'<table data-l="2"><tr data-l="2">{core}<td data-l="1">{_boilerplate(r, "aside")}</td></tr></table>'
        around = lambda kinds: "".join(_boilerplate(r, k) for k in kinds if r.random() < 0.45)
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            tag = r.choice(("div", "div", "main", "section", "form"))
            core = f'<{tag} data-l="2"{_name(r, ("wrapper", "container", "page", "layout", "site", "row", "col", "outer", "inner", "app", "root"), 0.6)}>{around(("nav", "ad", "notice"))}{core}{around(("aside", "share", "comments", "form"))}</{tag}>'
        if r.random() < 0.06:
            page = f'<html data-l="2"><head></head><body data-l="0">{_article(r, leaf)}</body></html>'
        else:
            page = f'<html data-l="2"><head data-l="1"><title>{_prose(r, 2, 8)}</title></head><body data-l="2">{around(("notice", "header", "nav", "form", "ad"))}{core}{around(("comments", "aside", "ad", "share", "footer", "footer", "notice"))}</body></html>'
        pages.append(_labelled(page))
    return pages


def _labelled(page: str) -> list[Node]:
    """Nodes with states: what data-l says, else the parent's."""
    nodes, _ = parse(re.sub(r'data-l="(\d)"', lambda m: f'role="kjxq{"abc"[int(m[1])]}"', page))
    for node in nodes:
        mark = next((w for w in node.names if w.startswith("kjxq")), None)
        node.state = "abc".index(mark[-1]) if mark else nodes[node.parent].state if node.parent >= 0 else MIXED
        node.names = node.names - {mark}
    return nodes


@cache
def trained() -> Model:
    return Model().fit(training_pages())


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html)."""

    def run(batches):
        model = trained()
        for b in slices(batches, "html", 16 << 20):
            texts = [model.extract(h) for h in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())], names=["page_id", "url", "text", "n_chars"])

    own = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long")
