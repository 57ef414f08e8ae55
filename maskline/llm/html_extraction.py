"""Main text of HTML pages by a tree-structured graphical model.

Every block-level or attributed element of a page is a node with a hidden
label, content or not.  A node's features (kind of element, meaning of its
class and id words, share of link text, length of text) give its potential;
parent-child potentials connect the nodes.  Sum-product messages, upward and
then downward, give each node's exact marginal, and the text of nodes that are
more likely content than not is the page's main text.

All potentials are trained by counting over labelled pages.  The tables come
without labels, so PAGES labelled layouts are generated (articles of many
shapes among menus, sidebars, notices, adverts, forms and comments); the
number is the bound of the sample.  Pages are read in one map over Arrow
batches; nothing is shuffled.

Class words are evidence that a trained potential weighs, not verdicts: a
"widget" may hold a menu or, from a page builder, the article; a header inside
the article belongs to it; a class such as has-sidebar, and those of body, say
nothing of their element.  Known misses, with figures in the README: text that
br alone breaks in unmarked divs, and articles in a cell of a layout table
(kinds "breaks" and "columns" of the generator, which training leaves out
because it then misses more of the other kinds).

Defined cases: null or empty html gives an empty text; unclosed or stray tags
are closed as browsers do for paragraphs, items and cells, else at the end; a
script, style, text area or title runs to its end tag or the end of the page,
other elements that show no text of their own only as far as their end tag, if
there is one before the next of the same name; an unfinished tag or reference
stays text; time and memory follow the length of the page; repeated rows give
repeated results; an empty table gives an empty result; other columns are
ignored.
"""

from __future__ import annotations

import html as entities
import random
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame

PAGES = 600
#: The share of them whose article has no element of its own.
BARE = 0.3
#: How often articles have a header or a page builder's holders; "breaks" and "columns" are for tests, see below.
SHAPES = ("usual",) * 8 + ("header", "builder")

# Element names of the HTML standard by kind, and usual class words.
KINDS = {
    "article": "article",
    "main": "main",
    "section": "section",
    "div": "div center noscript",
    "p": "p",
    "heading": "h1 h2 h3 h4 h5 h6 hgroup",
    "list": "ul ol dl",
    "item": "li dt dd",
    "table": "table thead tbody tfoot tr caption",
    "cell": "td th",
    "quote": "blockquote pre figure figcaption address details summary",
    "nav": "nav menu",
    "header": "header",
    "footer": "footer",
    "aside": "aside",
    "form": "form fieldset legend dialog search",
    "page": "html",
    "body": "body",
}
WORDS = {
    "comment": "comment comments commenters reply replies respond discussion disqus",
    "advert": "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner",
    "menu": "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager toc",
    "side": "sidebar side aside related recommended recommendations trending",
    "notice": "notice notices notification cookie cookies consent gdpr alert popup modal overlay warning",
    "form": "form forms newsletter subscribe subscription signup login search",
    "share": "share sharing social follow",
    "footer": "footer copyright legal colophon",
    "header": "header masthead topbar branding",
    "widget": "widget widgets",
    "content": "article content post entry story text body main page",
}
#: A class name with one of these says what the page has, not what its element is.
MODIFIERS = "has with without no not is"
RAW = "script style textarea title"
SKIPPED = "template svg iframe object canvas video audio select datalist button"
INLINE_VOID = "img input wbr area base col embed link meta source track param"

#: The values that each feature can take.
FEATURES = (
    (*KINDS, "inline", "root"),
    (*WORDS, "none", "hidden"),
    ("no text", "no links", "some links", "links"),
    ("none", "short", "middle", "long"),
)

_KIND = {name: kind for kind, names in KINDS.items() for name in names.split()}
_WORD = {word: group for group, words in WORDS.items() for word in words.split()}
_MODIFIERS = set(MODIFIERS.split())
_RAW, _VOID = set(RAW.split()), set(INLINE_VOID.split())
_SKIPPED = {x: re.compile(rf"<(/?){x}(?=[\s/>])[^>]*>?", re.I) for x in (*RAW.split(), *SKIPPED.split())}
_MARKED_KINDS = {"nav", "footer", "aside", "form"}
#: Odds against a node that is known to be content, and the least belief from which the likeliest become known.
TINY, LEAST = 1e-9, 0.02
_EDGES = ("marked", "header", "widget", "content", "plain")
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|</?[a-zA-Z][^>]*>",
    re.S,
)
_COMMENT = re.compile(r"<!--.*", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'/]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
#: An opening tag of these names ends an open element of the listed names, up to the nearest holder.
_ENDS = {
    **{n: ({"p"}, {"table", "td", "th", "button"}) for n, k in _KIND.items() if k not in ("item", "table", "cell", "page", "body")},
    "table": ({"p"}, {"td", "th"}),
    "hr": ({"p"}, {"td", "th"}),
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}),
    "dd": ({"dt", "dd", "p"}, {"dl"}),
    "tr": ({"tr", "td", "th", "p"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
}


class Page:
    """The nodes of a page in document order and its blocks of text."""

    def __init__(self, source: str):
        self.parent, self.kind, self.mark = [-1], ["root"], ["none"]
        self.text_size, self.link_size = [0], [0]
        self.blocks: list[list[tuple[int, str]]] = [[]]
        self._stack: list[tuple[str, int]] = [("", 0)]
        self._open: Counter[str] = Counter()
        links, at, n, last = 0, 0, len(source), source.rfind(">")
        while at < n:
            # Past the last ">" no tag can end.
            found = (_TOKEN if at <= last else _COMMENT).search(source, at)
            self._text(self._stack[-1][1], source[at : found.start() if found else n], links)
            if not found:
                break
            at = found.end()
            if found.re is _COMMENT or not (name := found["name"]):
                continue
            name = name.lower()
            if found["end"]:
                if name == "a":
                    links = max(0, links - 1)
                if name in _KIND:
                    self.blocks.append([])
                if self._open[name]:
                    self._close({name}, set())
                continue
            if name in _SKIPPED:
                at = self._after(name, source, at)
                continue
            if name == "a":
                links = 1  # links do not nest
            elif name in ("br", "hr"):
                self.blocks.append([])
            if name in _ENDS:
                ends, holders = _ENDS[name]
                if any(self._open[x] for x in ends):
                    self._close(ends, holders)
            mark = self._mark(found["rest"]) if found["rest"].strip("/ ") else "none"
            if name in ("html", "body") and mark != "hidden":
                mark = "none"  # their classes tell of the whole page
            if name in _VOID or (name not in _KIND and mark in ("none", "content")) or name in ("br", "hr"):
                continue
            if name in _KIND:
                self.blocks.append([])
            self.parent.append(self._stack[-1][1])
            self.kind.append(_KIND.get(name, "inline"))
            self.mark.append(mark)
            self.text_size.append(0)
            self.link_size.append(0)
            if not found["rest"].endswith("/") or name in _KIND:
                self._stack.append((name, len(self.parent) - 1))
                self._open[name] += 1

    def _close(self, names: set[str], holders: set[str]) -> None:
        """Close the innermost open element of these names and all in it, unless a holder is nearer."""
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] in holders:
                return
            if self._stack[i][0] in names:
                self._open.subtract(x for x, _ in self._stack[i:])
                del self._stack[i:]
                return

    @staticmethod
    def _after(name: str, source: str, at: int) -> int:
        """Where the page goes on after the opening tag of an element whose text isn't shown."""
        for found in _SKIPPED[name].finditer(source, at):
            if found[1]:
                return found.end()
            if name not in _RAW:
                return at
        return len(source) if name in _RAW else at

    def _text(self, node: int, raw: str, links: int) -> None:
        if raw:
            text = entities.unescape(raw)
            size = len(text) - text.count(" ") if len(text) < 400 else len(text)
            if not text.isspace():
                self.text_size[node] += size
                self.link_size[node] += size if links else 0
            self.blocks[-1].append((node, text))

    @staticmethod
    def _mark(rest: str) -> str:
        groups = set()
        for name, *values in _ATTRIBUTE.findall(rest):
            value = "".join(values)
            name = name.lower()
            if name == "hidden" or (name == "aria-hidden" and value == "true"):
                return "hidden"
            if name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
                return "hidden"
            if name in ("class", "id", "role", "aria-label", "itemprop"):
                for parts in (_PART.findall(x) for x in value.split()):
                    words = {x.lower() for x in parts}
                    if not words & _MODIFIERS:
                        groups |= {_WORD[x] for x in words if x in _WORD}
        return next((x for x in WORDS if x in groups), "none")

    def features(self) -> list[tuple[str, ...]]:
        text, link = self.text_size[:], self.link_size[:]
        for i in range(len(text) - 1, 0, -1):
            text[self.parent[i]] += text[i]
            link[self.parent[i]] += link[i]
        out = []
        for i, kind in enumerate(self.kind):
            share = "no text" if not text[i] else "links" if 2 * link[i] > text[i] else "some links" if link[i] else "no links"
            size = "none" if not text[i] else "short" if text[i] < 40 else "middle" if text[i] < 200 else "long"
            out.append((kind, self.mark[i], share, size))
        return out

    def edges(self) -> list[str]:
        """Which table of parent-child potentials holds above each node."""
        return [
            "widget" if m == "widget"
            else "header" if k == "header" and m in ("none", "header", "content")
            else "marked" if k in _MARKED_KINDS or m not in ("none", "content", "widget")
            else "content" if m == "content" or k == "article" else "plain"
            for k, m in zip(self.kind, self.mark)
        ]


class Model:
    """Potentials of features and of parent-child labels (0 other, 1 content)."""

    def __init__(self, pages: list[tuple[Page, list[int]]], prior: float = 0.5):
        unary, count, edge = Counter(), Counter(), Counter()
        for page, labels in pages:
            for i, (f, e, label) in enumerate(zip(page.features(), page.edges(), labels)):
                count[label] += 1
                unary.update((k, v, label) for k, v in enumerate(f))
                if i:
                    edge[e, labels[page.parent[i]], label] += 1
        self.unary = {}
        for k, values in enumerate(FEATURES):
            for v in values:
                self.unary[k, v] = tuple((unary[k, v, x] + prior) / (count[x] + prior * len(values)) for x in (0, 1))
        self.edge = {
            e: tuple(
                tuple((edge[e, p, c] + prior) / (edge[e, p, 0] + edge[e, p, 1] + 2 * prior) for c in (0, 1)) for p in (0, 1)
            )
            for e in _EDGES
        }

    def marginals(self, page: Page, known: set[int] = frozenset()) -> list[float]:
        """Probability that each node is content, given nodes known to be: messages up the tree, then down."""
        n = len(page.parent)
        own = []
        for i, f in enumerate(page.features()):
            a, b = (TINY, 1.0) if i in known else (1.0, 1.0)
            for k, v in enumerate(f):
                x, y = self.unary[k, v]
                a, b = a * x, b * y
            own.append((a / (a + b), b / (a + b)))
        table = [self.edge[e] for e in page.edges()]
        up, message = [list(x) for x in own], [(1.0, 1.0)] * n
        for i in range(n - 1, 0, -1):
            (p00, p01), (p10, p11) = table[i]
            a, b = up[i]
            m0, m1 = p00 * a + p01 * b, p10 * a + p11 * b
            message[i] = (m0, m1)
            node = up[page.parent[i]]
            node[0], node[1] = node[0] * m0, node[1] * m1
            total = node[0] + node[1]
            node[0], node[1] = node[0] / total, node[1] / total
        belief = [(up[0][0], up[0][1])] + [(0.5, 0.5)] * (n - 1)
        for i in range(1, n):
            (p00, p01), (p10, p11) = table[i]
            q, m = belief[page.parent[i]], message[i]
            r0, r1 = q[0] / m[0], q[1] / m[1]
            a, b = up[i][0] * (r0 * p00 + r1 * p10), up[i][1] * (r0 * p01 + r1 * p11)
            belief[i] = (a / (a + b), b / (a + b))
        return [b for _, b in belief]


def labelled_pages(n: int = PAGES, seed: int = 7, bare: float = 0.0, shapes: tuple[str, ...] = SHAPES) -> list[tuple[str, str]]:
    """Generated pages with their main text; in a share ``bare`` nothing but a plain div or the body holds it."""
    draw = random.Random(seed)
    letters = "abcdefghijklmnoprstuvwyz"

    def words(low: int, high: int, mark: str = "") -> str:
        return " ".join(mark + "".join(draw.choices(letters, k=draw.randint(1, 9))) for _ in range(draw.randint(low, high)))

    def links(count: int) -> str:
        return "".join(f'<li><a href="/x">{words(1, 3)}</a></li>' for _ in range(count))

    def boiler(inside: bool = False) -> str:
        kind = draw.randrange(14 if not bare else 15 if inside else 17)
        text = words(1, draw.choice([4, 15, 60]))
        return [
            f"<nav><ul>{links(draw.randint(2, 9))}</ul></nav>",
            f'<div class="{draw.choice(["ad", "advert", "sponsored", "banner"])}">{text}</div>',
            f"<aside><h3>{words(1, 3)}</h3><p>{text}</p></aside>",
            f'<div class="sidebar"><p>{text}</p><ul>{links(3)}</ul></div>',
            f'<div class="{draw.choice(["cookie-notice", "notice", "alert"])}"><p>{text}</p></div>',
            f"<form><p>{words(2, 6)}</p><input></form>",
            f'<section class="comments"><h2>{words(1, 2)}</h2><div class="comment"><p>{words(5, 80)}</p></div><p>{text}</p></section>',
            f'<div id="comments"><ul><li><p>{words(5, 60)}</p></li><li>{text}</li></ul></div>',
            f'<div class="share"><a href="#">{words(1, 2)}</a></div>',
            f'<div class="related"><ul>{links(4)}</ul></div>',
            f'<div class="newsletter"><p>{text}</p></div>',
            f'<ul class="menu">{links(5)}</ul>',
            f'<div class="promo"><p>{text}</p></div>',
            f'<aside class="notice"><p>{text}</p></aside>',
            f'<table class="{draw.choice(["menu", "sidebar", "footer"])}"><tr><td>{draw.choice([text, f"<a href=/t>{words(1, 3)}</a>"])}</td></tr></table>',
            f'<div class="widget widget_{draw.choice(["links", "archive", "meta"])}"><h3>{words(1, 2)}</h3><ul>{links(4)}</ul></div>',
            f'<div class="widget"><p>{words(2, 20)}</p></div>',
        ][kind]

    def block() -> str:
        text = words(1, draw.choice([3, 10, 60, 150]), "¤")
        linked = f'<a href="/y">{words(1, 3, "¤")}</a> ' if draw.random() < 0.15 else ""
        kind = draw.randrange(16)
        if kind == 0:
            return "<ul>" + "".join(f"<li>{words(1, 12, '¤')}</li>" for _ in range(draw.randint(1, 6))) + "</ul>"
        if kind == 1:
            return f"<h2>{words(1, 6, '¤')}</h2>"
        if kind == 2:
            return f"<blockquote><p>{text}</p></blockquote>"
        if kind == 3:
            return f"<table><tr><td>{words(1, 3, '¤')}</td><td>{words(1, 5, '¤')}</td></tr></table>"
        if kind == 4:
            return f"<div>{linked}{text}</div>"
        if kind == 5:
            return f"<pre>{text}</pre>"
        if kind == 6:
            return f"<section><h3>{words(1, 4, '¤')}</h3><p>{text}</p></section>"
        if kind == 7:
            return f"<ul><li><a href='/z'>{words(1, 4, '¤')}</a></li></ul>"
        if kind == 8:
            return f"{linked}{text}<br>"
        return f"<p>{linked}{text}</p>"

    pages = []
    for _ in range(n):
        kind = draw.choice(shapes) if bare else "usual"
        inner = [f"<h1>{words(1, 9, '¤')}</h1>"] * (draw.random() < 0.9)
        if kind == "header" and inner:
            inner = [f'<header class="{draw.choice(["entry-header", "post-header", "article-header", ""])}">{inner[0]}</header>']
        if kind == "breaks":
            inner = inner if draw.random() < 0.5 else []
            for _ in range(draw.randint(1, 4)):
                lines = "<br><br>".join(words(5, 90, "¤") for _ in range(draw.randint(1, 5)))
                inner.append(f"<div>{lines}</div>")
        for _ in range(0 if kind == "breaks" else draw.randint(1, 12)):
            inner.append(block())
            if draw.random() < 0.12:
                inner.append(boiler(inside=True))
        if draw.random() < 0.2:
            inner.append(f"<footer>{words(2, 8)}</footer>")
        holder = draw.choice(["article"] * 6 + ["div class=post-content", "div id=content", "main", "section class=entry"])
        if bare and draw.random() < bare:
            holder = draw.choice(["div", ""])
        if kind == "breaks" and draw.random() < 0.7:
            holder = draw.choice(["div", ""])
        if kind == "builder":
            half = max(1, len(inner) // 2) if draw.random() < 0.5 else len(inner)
            name = draw.choice(["builder-widget-container", "widget widget-text", "page-widget"])
            inner = [f'<div class="{name}">{"".join(x)}</div>' for x in (inner[:half], inner[half:]) if x]
            holder = draw.choice([holder, "div", "main", ""])
        if kind == "columns":
            holder = draw.choice(["div", "td", "td", "td valign=top"])
        body = f"<{holder}>{''.join(inner)}</{holder.split()[0]}>" if holder else "".join(inner)
        if kind == "columns":
            cell = body if holder[:2] == "td" else f"<td>{body}</td>"
            side = "<br>".join(f'<a href="/m">{words(1, 3)}</a>' for _ in range(draw.randint(2, 9)))
            side = f"<td>{draw.choice([side, f'<ul>{links(4)}</ul>', side])}</td>"
            body = f"<table><tr>{draw.choice([side + cell, cell + side])}</tr></table>"
        if draw.random() < 0.3:
            body = draw.choice(["<main>{}{}</main>", "<div class=wrap>{}{}</div>", "<div>{}{}</div>"]).format(body, boiler())
        before, after = ("".join(boiler() for _ in range(draw.randint(0, 4))) for _ in range(2))
        head = f"<header><h2>{words(1, 3)}</h2></header>" * (draw.random() < 0.5)
        foot = f"<footer>{words(2, 14)}</footer>" * (draw.random() < 0.8)
        page = f"{head}{before}{body}{after}{foot}"
        if not bare or draw.random() < 0.9:
            page = f"<html><head><title>{words(2, 5)}</title></head><body>{page}</body></html>"
        pages.append(page)
    return [(p.replace("¤", ""), p) for p in pages]


def _labels(marked: Page) -> list[int]:
    """Content: nodes most of whose text is marked; of body and the document, only the text that no other holder has."""
    n = len(marked.parent)
    good, bad = [0] * n, [0] * n
    for part in marked.blocks:
        for node, text in part:
            hits = text.count("¤")
            good[node] += hits
            bad[node] += len(text.split()) - hits
    for i in range(n - 1, 0, -1):
        up = marked.parent[i]
        if marked.kind[up] not in ("root", "page", "body") or marked.kind[i] in ("p", "heading", "list", "quote", "table"):
            good[up] += good[i]
            bad[up] += bad[i]
    return [int(g > b) for g, b in zip(good, bad)]


@lru_cache(maxsize=1)
def trained(n: int = PAGES) -> Model:
    return Model([(Page(plain), _labels(Page(marked))) for plain, marked in labelled_pages(n, bare=BARE)])


def main_text(source: str | None, model: Model) -> str:
    page = Page(source or "")
    belief = model.marginals(page)
    if max(belief) <= 0.5:
        # The likeliest outside menus, comments and the like become known, if they aren't next to impossible.
        inside = [False]
        for parent, edge in zip(page.parent[1:], page.edges()[1:]):
            inside.append(inside[parent] or edge in ("marked", "header"))
        best = max(x for x, i in zip(belief, inside) if not i)
        if best > LEAST:
            belief = model.marginals(page, {i for i, x in enumerate(belief) if 2 * x >= best and not inside[i]})
    content = [x > 0.5 for x in belief]
    blocks = (" ".join("".join(t for node, t in part if content[node]).split()) for part in page.blocks)
    return " ".join(x for x in blocks if x)


def extract(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html"
) -> DataFrame:
    """(id, url, text, n_chars) for each page."""
    model = trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64())],
                [id_col, url_col, "text", "n_chars"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, html_col).mapInArrow(run, f"`{id_col}` {kind}, `{url_col}` string, text string, n_chars long")
