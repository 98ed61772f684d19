"""HTML extraction by minimum-cut labelling of a page's text blocks.

A tolerant tokenizer cuts the page into blocks of text with their place in the element tree. A linear
classifier turns what is known of a block (elements and names above it, links, length, punctuation)
into log-odds of being content, which are the capacities to the two terminals. Neighbours in page
order and blocks under one parent are tied by smoothness capacities, larger the closer they are in
the tree; none is tied across the bounds of an advert, a notice or another element of that kind. The
minimum cut, found by maximum flow in whole numbers, parts content from boilerplate. The work is linear
in the page up to the flow, however deep its elements are nested.

Nulls: null or empty html gives an empty text; a null key or url is kept. Empty tables give empty
results. Broken markup is read as far as it goes: unclosed elements end with the page. Repeated rows
are read each on its own. Pages of any length are read whole. Only the key, the url and the html are
read, so other columns of any name can't clash and are not returned.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, deque
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructField, StructType

#: A quote opens a value only after an equals sign and if it is closed somewhere; else it is a stray character.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]|=\s*\"[^\"]*\"|=\s*'[^']*'|=)*+)(?:>|\Z)", re.S
)
ATTRIBUTE = re.compile(r"""([^\s=/"']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

# Elements of HTML by their role for the reader.
UNSEEN = {"script", "style", "template", "noscript", "svg", "head", "title", "annotation", "annotation-xml", "iframe", "object", "canvas", "textarea", "select", "audio", "video"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {
    "a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "label", "mark", "q",
    "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var",
    "math", "mi", "mn", "mo", "ms", "mtext", "mspace", "mrow", "mfrac", "msqrt", "mroot", "msub", "msup", "msubsup", "munder", "mover", "munderover",
    "mtable", "mtr", "mtd", "mstyle", "mpadded", "mphantom", "menclose", "merror", "mmultiscripts", "mprescripts", "semantics",
}
ASIDE_TAGS = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "fieldset"}
MAIN_TAGS = {"article", "main"}
CLOSES = {"li": {"li"}, "p": {"p"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}}
ASIDE_NAMES = {
    "ad", "ads", "advert", "adverts", "advertisement", "advertising", "adsense", "sponsor", "sponsored", "promo", "promotion", "banner", "cookie", "cookies",
    "consent", "gdpr", "notice", "notices", "notification", "alert", "popup", "modal", "overlay", "newsletter", "subscribe", "subscription", "signup",
    "sidebar", "sidebars", "widget", "widgets", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "footer", "masthead",
    "comment", "comments", "commentlist", "disqus", "reply", "replies", "respond", "discussion", "share", "sharing", "social", "related", "recommended",
    "recommendations", "pager", "pagination", "login", "search", "copyright", "toolbar", "tagcloud", "hidden", "topbar", "disclaimer",
    "complementary", "contentinfo", "form", "dialog",
}
#: Names of reader comments, and elements that never hold a page's article, however much of its text they hold.
COMMENT_NAMES = {"comment", "comments", "commentlist", "disqus", "reply", "replies", "respond"}
NEVER_WRAP = {"nav", "footer", "aside"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: As the id of a section in an article these are titles of the article's own.
SECTION_IDS = {"discussion", "search", "navigation", "menu", "form", "dialog", "notification", "alert", "advertising", "promotion", "subscription", "copyright", "disclaimer", "login", "social"}
HEAD_NAMES = {"header"}
MAIN_NAMES = {"article", "content", "main", "post", "entry", "story", "maincontent", "articlebody", "body", "text"}
#: Parts that may stand beside those in the name of an article.
MAIN_PARTS = MAIN_NAMES | {"page", "wrapper", "container", "inner", "area", "blog", "single", "column", "primary", "full"}
#: Elements that new list items, cells and the like close, and new elements of other kinds.
BOUNDS = {"ul", "ol", "table", "dl", "article", "section", "div", "aside", "nav", "select"}
P_BOUNDS = {"article", "section", "div", "aside", "nav", "td", "li", "table"}

#: Parts of a name that say something of a page's state or layout, not of what the element is.
STATE_NAMES = {"no", "not", "without", "has", "with", "is", "enabled", "disabled", "on", "off", "open", "closed", "free", "layout"}
#: Log-odds of the classifier, in hundredths (capacities are whole numbers): by kind of element around a
#: block, and by the block itself. W_PLAIN is added where a page marks no article at all.
W_ASIDE, W_NAMED, W_MAIN, W_HEADER, W_LINKS, W_LONG, W_SHORT, W_SENTENCE, W_TEXTUAL, W_BASE, W_PLAIN = -900, -650, 400, -500, -400, 120, -60, 80, 60, -40, 110
#: An element with more than this share of the page's text wraps the page, whatever its name.
WRAPS = 0.6
#: Smoothness of neighbours under one parent, under one grandparent, and farther apart.
TIE_PARENT, TIE_NEAR, TIE_FAR = 120, 50, 10
LONG_CHARS = 80


class _Element:
    """An element with the marks of its own tag and names.

    `near` has the open elements of each kind that a new element may close, up to the next bound.
    `odds`, `inside` and `held` (its characters) are set once the page is read: see `_weigh`.
    """

    __slots__ = ("tag", "parent", "aside", "main", "header", "fixed", "in_main", "near", "depth", "held", "odds", "bar", "head", "inside")

    def __init__(self, tag: str, parent: _Element | None, attributes: str):
        self.tag, self.parent, self.held = tag, parent, 0
        self.depth = parent.depth + 1 if parent else 0
        tokens: list[tuple[str, list[str]]] = []
        hidden = False
        if attributes and tag not in ("html", "body"):
            for name, x, y, z in ATTRIBUTE.findall(attributes):
                value, name = x or y or z, name.lower()
                if name in ("class", "id", "role"):
                    for token in value.split():
                        parts = re.findall(r"[a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower())
                        if parts and not STATE_NAMES.intersection(parts):
                            tokens.append((name, parts))
                elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and re.search(r"display\s*:\s*none", value):
                    hidden = True
        within = parent.in_main if parent else False
        if tag in HEADINGS:  # named after what it says
            tokens = []
        elif within and (tag == "section" or any(parts == ["section"] for _, parts in tokens)):
            tokens = [(name, parts) for name, parts in tokens if name != "id" or not SECTION_IDS.intersection(parts)]
        names = {part for _, parts in tokens for part in parts}
        self.aside = W_ASIDE if hidden or tag in ASIDE_TAGS else W_NAMED if names & ASIDE_NAMES else 0
        # a name marks an article only as a whole: sidebar-content is no content
        self.main = not self.aside and (tag in MAIN_TAGS or any(MAIN_NAMES.intersection(parts) and MAIN_PARTS.issuperset(parts) for _, parts in tokens))
        self.header = tag == "header" or bool(names & HEAD_NAMES)
        self.fixed = tag in NEVER_WRAP or bool(names & COMMENT_NAMES)
        self.in_main = within or self.main
        if tag in BOUNDS or parent is None:
            self.near: dict[str, _Element] = {}
        else:
            self.near = {**parent.near, tag: self} if tag in CLOSES else parent.near


def _weigh(blocks: list[Block]) -> None:
    """Sets what the elements from the root down say of their text.

    An element that holds most of the page's text wraps the page and is no aside, whatever its name;
    comments and the like never wrap it, and their text counts for no other. A header inside an article
    is its head. `inside` is the innermost aside or header around a text, and no tie crosses its bounds.
    """
    seen: set[_Element] = set()
    for b in blocks:
        e: _Element | None = b.element
        while e is not None and e not in seen:
            seen.add(e)
            e = e.parent
    order = sorted(seen, key=lambda e: e.depth)
    fixed = {}
    for e in order:
        fixed[e] = e.fixed or (e.parent is not None and fixed[e.parent])
    for b in blocks:
        b.element.held += 0 if fixed[b.element] else len(b.text)
    for e in reversed(order):
        if e.parent is not None:
            e.parent.held += e.held
    page = order[0].held if order else 0
    for e in order:
        up = e.parent
        bar, head, e.inside = (up.bar, up.head, up.inside) if up else (0, 0, None)
        if not 0 < WRAPS * page < e.held or e.fixed:
            if e.aside:
                bar, e.inside = min(bar, e.aside), e
            if e.header and not e.in_main:
                head, e.inside = W_HEADER, e
        e.bar, e.head = bar, 0 if e.main else head
        e.odds = bar + e.head + W_MAIN * (e.in_main and not bar)


class Block:
    __slots__ = ("text", "element", "linked")

    def __init__(self, text: str, element: _Element, linked: int):
        self.text, self.element, self.linked = text, element, linked

    def odds(self, plain: bool) -> int:
        n = len(self.text)
        share = self.linked / n
        odds = W_BASE + (W_LONG if n >= LONG_CHARS else W_SHORT) + W_PLAIN * plain
        odds += self.element.odds
        odds += int(W_LINKS * share) if share > 0.3 and not self.element.in_main else 0
        odds += W_SENTENCE if self.text[-1] in ".!?…:;\"'”»。！？" else 0
        odds += W_TEXTUAL if self.element.tag in ("p", "h1", "h2", "h3", "h4", "blockquote", "pre", "td", "dd", "figcaption") else 0
        return odds


def blocks_of(page: str) -> list[Block]:
    """The page's blocks of text in order; unseen elements and markup are left out."""
    out: list[Block] = []
    here = _Element("html", None, "")
    text: list[tuple[str, bool]] = []
    in_link = False
    opened: Counter[str] = Counter()
    pos, end = 0, len(page)

    def flush() -> None:
        if text:
            words = " ".join("".join(entities.unescape(t) for t, _ in text).split())
            if words:
                linked = sum(len(entities.unescape(t).strip()) for t, link in text if link)
                out.append(Block(words, here, min(linked, len(words))))
            text.clear()

    def leave(e: _Element) -> None:
        nonlocal here
        while here is not e:
            opened[here.tag] -= 1
            here = here.parent
        opened[here.tag] -= 1
        here = here.parent

    def close(tag: str) -> None:
        if opened[tag]:
            e = here
            while e.tag != tag:
                e = e.parent
            leave(e)

    def before(tag: str) -> None:
        """Closes what the start of this element ends."""
        if tag in CLOSES:
            found = [here.near[t] for t in CLOSES[tag] if t in here.near]
            if found:
                leave(max(found, key=lambda e: e.depth))
        else:
            e = here.near.get("p")
            if e is not None and not any(t in here.near and here.near[t].depth > e.depth for t in P_BOUNDS):
                leave(e)

    while pos < end:
        m = TOKEN.search(page, pos)
        if m is None:
            text.append((page[pos:], in_link))
            break
        if m.start() > pos:
            text.append((page[pos : m.start()], in_link))
        pos = m.end() if m.end() > m.start() else m.start() + 1
        if m[2] is None:
            continue
        tag = m[2].lower()
        if tag in UNSEEN:
            if not m[1] and not m[3].endswith("/"):
                # skipped to its end tag; a head without one ends where the body begins
                stop = re.compile(rf"</{re.escape(tag)}\s*>" + (r"|(?=<body[\s>])" if tag == "head" else ""), re.I).search(page, pos)
                if tag != "head" or stop:
                    pos = stop.end() if stop else end
            continue
        if tag in INLINE:
            if tag == "a":
                in_link = not m[1]
            continue
        if tag == "br" or tag == "wbr":
            text.append((" ", in_link) if tag == "br" else ("", in_link))
            continue
        flush()
        in_link = False
        if m[1]:
            close(tag)
        elif tag not in VOID:
            before(tag)
            if tag not in ("html", "body") and not m[3].endswith("/"):
                here = _Element(tag, here, m[3])
                opened[tag] += 1
    flush()
    return out


def _tie(a: _Element, b: _Element) -> int:
    if a.inside is not b.inside:
        return 0
    if a is b or a.parent is b.parent:
        return TIE_PARENT
    near = a.parent is b or b.parent is a or (a.parent and b.parent and a.parent.parent is b.parent.parent)
    return TIE_NEAR if near else TIE_FAR


class Flow:
    """Maximum flow by blocking flows on level graphs (whole-number capacities)."""

    def __init__(self, nodes: int):
        self.to: list[int] = []
        self.room: list[int] = []
        self.edges: list[list[int]] = [[] for _ in range(nodes)]

    def tie(self, a: int, b: int, forth: int, back: int = 0) -> None:
        self.edges[a].append(len(self.to))
        self.edges[b].append(len(self.to) + 1)
        self.to += [b, a]
        self.room += [forth, back]

    def levels(self, source: int) -> list[int]:
        level = [-1] * len(self.edges)
        level[source], queue = 0, deque([source])
        while queue:
            a = queue.popleft()
            for e in self.edges[a]:
                if self.room[e] and level[self.to[e]] < 0:
                    level[self.to[e]] = level[a] + 1
                    queue.append(self.to[e])
        return level

    def source_side(self, source: int, sink: int) -> list[bool]:
        """Saturates the network; whether each node is still reached from the source."""
        while True:
            level = self.levels(source)
            if level[sink] < 0:
                return [x >= 0 for x in level]
            at = [0] * len(self.edges)
            path: list[int] = []
            a = source
            while True:
                if a == sink:
                    least = min(self.room[e] for e in path)
                    for e in path:
                        self.room[e] -= least
                        self.room[e ^ 1] += least
                    cut = next(i for i, e in enumerate(path) if not self.room[e])
                    a = self.to[path[cut] ^ 1]
                    del path[cut:]
                while at[a] < len(self.edges[a]):
                    e = self.edges[a][at[a]]
                    if self.room[e] and level[self.to[e]] == level[a] + 1:
                        break
                    at[a] += 1
                if at[a] < len(self.edges[a]):
                    path.append(self.edges[a][at[a]])
                    a = self.to[path[-1]]
                elif path:
                    e = path.pop()
                    a = self.to[e ^ 1]
                    at[a] += 1
                else:
                    break


def content(blocks: list[Block]) -> list[Block]:
    """The blocks on the content side of the minimum cut."""
    n = len(blocks)
    flow = Flow(n + 2)
    source, sink = n, n + 1
    last: dict[_Element | None, int] = {}
    _weigh(blocks)
    plain = not any(b.element.in_main for b in blocks)
    for i, b in enumerate(blocks):
        odds = b.odds(plain)
        flow.tie(source, i, odds) if odds > 0 else flow.tie(i, sink, -odds)
        if i:
            tie = _tie(blocks[i - 1].element, b.element)
            flow.tie(i - 1, i, tie, tie)
        before = last.get(b.element.parent)
        if before is not None and before != i - 1 and blocks[before].element.inside is b.element.inside:  # siblings with something else between them
            flow.tie(before, i, TIE_NEAR, TIE_NEAR)
        last[b.element.parent] = i
    side = flow.source_side(source, sink)
    return [b for i, b in enumerate(blocks) if side[i]]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in content(blocks_of(page))) if page else ""


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """key, url, text and n_chars (code points) of every page."""
    schema = StructType([StructField(key, pages.schema[key].dataType), StructField(url, pages.schema[url].dataType), *StructType.fromDDL("text string, n_chars bigint")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                names=[key, url, "text", "n_chars"],
            )

    return pages.select(key, url, html).mapInArrow(run, schema)
