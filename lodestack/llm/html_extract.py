"""Main text of web pages by tree scoring.

A tolerant tree is built in one pass over the tags, and what stands around an
article by its element, role or class name is pruned. Paragraphs earn points
for length and commas and pass them to their ancestors: all to the container
they stand in, half of a container's points to the next, and so on. A
container's points are discounted by its link density. The best container, or
the article element that holds it, is kept with those siblings that score well,
are of its own kind or are running text. From what is kept go lists of links
before the first paragraph, and what follows a heading over reader comments.
Every step is linear in the page, whatever the markup.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame

from . import scratch

_TAG = re.compile(
    r"""<!--.*?(?:--!?>|\Z) | <!\[CDATA\[.*?(?:\]\]>|\Z) | <[!?][^>]*+(?:>|\Z)
    | <(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+')*+)>
    | <(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*+)(?P<attrs2>[^>]*+)(?:>|\Z)""",
    re.S | re.X,
)
_ATTR = re.compile(r"""([a-zA-Z_:][\w:.-]*)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript noembed noframes iframe xmp template".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("body caption html legend optgroup option tbody td tfoot th thead tr".split())
#: An element ends when one of these starts; the search for it stops at the scopes.
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "option": ("option",), "optgroup": ("option", "optgroup"), "tr": ("td", "th", "tr"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("td", "th", "tr", "tbody", "thead", "tfoot"), "tfoot": ("td", "th", "tr", "tbody", "thead"), "thead": ("tr", "tbody")}
SCOPES = {"li": ("ul", "ol", "menu", "dir"), "dt": ("dl",), "dd": ("dl",), "option": ("select", "datalist"), "optgroup": ("select",)}
TABLE_SCOPE = ("table",)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: Elements that hold no article text.
DROPPED = frozenset("aside audio canvas datalist dialog embed fieldset footer form iframe input map menu nav object search select svg video".split())
#: These are text where they stand in a line of text, and controls elsewhere.
INLINE_CONTROLS = frozenset("button math meter output progress".split())
TEXT_BLOCKS = frozenset("blockquote caption dd dt figcaption h1 h2 h3 h4 h5 h6 li p pre td th".split())
DROPPED_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search status toolbar tooltip".split())
#: Words of class and id that mark what stands around an article.
AROUND = frozenset(
    "ad adbox ads adsense adslot advert advertisement advertising adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies crumb crumbs discussion disqus footer form gdpr header login masthead menu menubar modal nav navbar navigation newsletter notice notices notification overlay pager pagination paywall popup promo promoted promotion recommended related replies respond response responses share sharing sidebar signin signup social sponsor sponsored subscribe subscription teaser toolbar widget widgets".split()
)
#: Of these, the ones that a word for the article outweighs.
WEAK = frozenset("banner discussion form header notice social teaser".split())
WITHIN = frozenset("article articlebody content entry main post story".split())
#: Of these, the ones whose elements may hold other articles than the page's own, and so are no wrappers for having one.
OTHERS = frozenset("comment comments commentlist discussion disqus recommended related replies respond teaser".split())
#: A compound is a mark only if its other words are of these: ``left-sidebar`` and ``comment-list`` are, ``social-science``, ``ad-hoc`` and ``layout-with-sidebar`` are not.
PARTS = frozenset(
    "area article articles bar block blocks body bottom box button buttons center column container content copyright desktop entry first fixed floating foot global google group head holder icon icons inline inner item items last left legal link links list logo main message middle mobile module outer page panel post posts primary reader readers right row second secondary section side site slot sticky stories story strip text thread threads title top unit user users visitor visitors wrap wrapper x zone".split()
)
#: Whatever else stands in the name, these mark reader comments or adverts,
CERTAIN = frozenset("adsense adslot ads advert adverts advertisement comment commentlist comments disqus".split())
#: unless it says of an article whether it has any.
STATES = frozenset("allowed closed disabled enabled has hide no off on open show with without".split())
#: A heading over reader comments; what is under it goes if it is no running text.
COMMENTS = re.compile(r"\W*(?:\d+\s+)?(?:(?:user|reader)s?['’]?\s+)?(?:comments?|responses|replies|commentaires?|kommentare?|comentarios?|leave a (?:comment|reply)|join the (?:conversation|discussion))\W*(?:\d+\W*)?", re.I)
#: Words of class and id of a line in an article's header that is not its lead.
BYLINES = frozenset("author authors byline credit date dateline meta posted published share tags time timestamp updated".split())
#: Characters of a paragraph that is running text.
RUNNING = 40
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")


class Node:
    __slots__ = ("attrs", "children", "name", "parent", "score")

    def __init__(self, name: str, attrs: str, parent: Node | None) -> None:
        self.name, self.attrs, self.parent = name, attrs, parent
        self.children: list[Node | str] = []
        self.score = 0.0


def _attributes(raw: str) -> dict[str, str]:
    return {k.lower(): unescape(v.strip("\"'")) for k, v in reversed(_ATTR.findall(raw))}


def parse(html: str) -> Node:
    """The element tree; never fails, whatever the markup."""
    root = Node("#root", "", None)
    at, here, stack = 0, root, [root]
    open_at: dict[str, list[int]] = defaultdict(list)  # where in the stack the open elements of a name are
    size = len(html)
    lower = None

    def pop_to(k: int) -> None:
        for node in reversed(stack[k:]):
            open_at[node.name].pop()
        del stack[k:]

    def last(names: tuple[str, ...]) -> int:
        return max((open_at[n][-1] for n in names if open_at[n]), default=0)

    def close(names: tuple[str, ...], scope: tuple[str, ...]) -> None:
        """Pop the outermost open element of ``names`` within the innermost scope, and all above it."""
        edge = last(scope)
        found = [open_at[n][k] for n in names if (k := bisect_right(open_at[n], edge)) < len(open_at[n])]
        if found:
            pop_to(min(found))

    while at < size:
        found = _TAG.search(html, at)
        if not found:
            here.children.append(html[at:])
            break
        if found.start() > at:
            here.children.append(html[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if not name:
            continue
        name = name.lower()
        if found["end"] or found["end2"]:
            if open_at[name] and (name in BLOCK or open_at[name][-1] > last(("td", "th", "table"))):
                pop_to(open_at[name][-1])
            here = stack[-1]
            continue
        if name in ("html", "body", "head") and open_at[name]:
            continue
        if name in CLOSES_P and open_at["p"]:
            close(("p",), ("td", "th", "table", "button", "caption"))
        if name in ENDS:
            close(ENDS[name], SCOPES.get(name, TABLE_SCOPE))
        here = stack[-1]
        attrs = found["attrs"] if found["name"] else found["attrs2"]
        node = Node(name, attrs or "", here)
        here.children.append(node)
        if name in RAW:
            if lower is None:
                lower = html.lower() if len(html.lower()) == size else re.sub("[A-Z]+", lambda m: m[0].lower(), html)
            end = lower.find(f"</{name}", at)
            stop = size if end < 0 else end
            node.children.append(html[at:stop])
            shut = html.find(">", stop)
            at = size if end < 0 or shut < 0 else shut + 1
        elif name not in VOID and not (attrs or "").endswith("/") or name in BLOCK - VOID:
            open_at[name].append(len(stack))
            stack.append(node)
            here = node
    return root


def _marks(names: list[str]) -> set[str]:
    """The words of class names and ids that mark what stands around an article."""
    split = [[w.lower() for w in _WORDS.findall(n)] for n in names]
    if any(w in CERTAIN for ws in split if STATES.isdisjoint(ws) for w in ws):
        return {w for ws in split if STATES.isdisjoint(ws) for w in ws if w in CERTAIN}
    hits = {w for ws in split if all(w in AROUND or w in PARTS or w.isdigit() for w in ws) for w in ws if w in AROUND}
    return set() if hits <= WEAK and any(w in WITHIN for ws in split for w in ws) else hits


def _around(node: Node, wraps: bool = False) -> bool:
    """Whether an element stands around the article rather than in it.

    One that ``wraps`` the page's article is not pruned for its class or id.
    """
    if node.name in RAW or node.name in DROPPED or node.name == "head":
        return True
    if not node.attrs or node.name in ("html", "body"):
        return False
    attrs = _attributes(node.attrs)
    if "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")):
        return True
    if attrs.get("role", "").lower() in DROPPED_ROLES:
        return True
    hits = _marks(f"{attrs.get('class', '')} {attrs.get('id', '')}".split())
    if node.name in ("article", "main"):
        return bool(hits & {"ad", "advert", "comment", "promo", "promoted", "related", "sponsored", "teaser"})
    return bool(hits) and not (wraps and hits.isdisjoint(OTHERS))


def _class_words(node: Node) -> set[str]:
    attrs = _attributes(node.attrs) if node.attrs else {}
    return {w.lower() for n in (attrs.get("class", ""), attrs.get("id", "")) for w in _WORDS.findall(n)}


def _totals(nodes: list[Node], counts) -> dict[int, int]:
    """By id of each element, the sum of ``counts(element)`` over it and all below it; ``nodes`` are in page order."""
    total = {id(n): int(counts(n)) for n in nodes}
    for n in reversed(nodes):
        if n.parent is not None:
            total[id(n.parent)] += total[id(n)]
    return total


def _wrappers(root: Node) -> set[int]:
    """The ids of the elements that hold a main, or every article of a page without one, and of forms around a page.

    Articles among comments do not count. A form wraps the page if it holds an
    article, a main or five paragraphs.
    """
    nodes = list(_elements(root))
    articles = _totals(nodes, lambda n: n.name in ("article", "main"))
    paragraphs = _totals(nodes, lambda n: n.name == "p")
    out = {id(n) for n in nodes if n.name == "form" and (articles[id(n)] or paragraphs[id(n)] >= 5)}
    if not articles[id(root)]:
        return out
    beside: set[int] = set()
    for n in nodes:
        if n.parent is not None and (id(n.parent) in beside or n.name != "form" and _around(n, True) and articles[id(n)] < articles[id(root)]):
            beside.add(id(n))
    for name in ("main", "article"):
        held = _totals(nodes, lambda n, name=name: n.name == name and id(n) not in beside)
        if held[id(root)]:
            return out | {k for k, n in held.items() if n and (name == "main" or n == held[id(root)])}
    return out


def _prune(root: Node) -> None:
    todo, wrappers, sizes = [(root, False, False)], _wrappers(root), _measure(root)
    while todo:
        node, in_article, in_text = todo.pop()
        in_article |= node.name in ("article", "main")
        in_text |= node.name in TEXT_BLOCKS
        kept: list[Node | str] = []
        for child in node.children:
            if isinstance(child, Node):
                wraps = id(child) in wrappers
                gone = _around(child, wraps) and not (wraps and child.name == "form")
                if gone or child.name in INLINE_CONTROLS and not in_text or child.name == "header" and not in_article:
                    kept.append(" ")
                    continue
                if child.name == "header":
                    child.children = _headings_and_lead(child, sizes)
                todo.append((child, in_article, in_text))
            kept.append(child)
        node.children = kept


def _headings_and_lead(node: Node, sizes: dict[int, tuple[int, int]]) -> list[Node]:
    """Of an article's header, the headings, and paragraphs of running text that are no byline."""
    out, todo = [], [node]
    while todo:
        for child in reversed(todo.pop().children):
            if isinstance(child, Node) and not _around(child):
                total, links = sizes[id(child)]
                if child.name in HEADINGS or child.name == "p" and total >= RUNNING and links < 0.25 * total and BYLINES.isdisjoint(_class_words(child)):
                    out.append(child)
                elif BYLINES.isdisjoint(_class_words(child)):
                    todo.append(child)
    return out[::-1]


def _measure(root: Node) -> dict[int, tuple[int, int]]:
    """Characters of text and of link text of every element."""
    sizes: dict[int, list[int]] = {}
    order = []
    todo = [root]
    while todo:
        node = todo.pop()
        order.append(node)
        todo += [c for c in node.children if isinstance(c, Node)]
    for node in reversed(order):
        own = sum(len(c.strip()) for c in node.children if isinstance(c, str))
        total, links = own, 0
        for c in node.children:
            if isinstance(c, Node):
                t, k = sizes[id(c)]
                total += t
                links += k
        sizes[id(node)] = (total, total if node.name == "a" else links)
    return sizes


def _elements(root: Node):
    todo = [root]
    while todo:
        node = todo.pop()
        yield node
        todo += [c for c in reversed(node.children) if isinstance(c, Node)]


def _own_text(node: Node) -> str:
    """Text of an element outside the blocks within it."""
    out, todo = [], list(reversed(node.children))
    while todo:
        c = todo.pop()
        if isinstance(c, str):
            out.append(c)
        elif c.name not in BLOCK:
            todo += reversed(c.children)
    return "".join(out)


#: Elements that collect the points of what they hold.
CONTAINERS = frozenset("article body div main section".split())
PARAGRAPHS = frozenset("blockquote dd h2 h3 li p pre td".split())


def _points(node: Node, link_share: float) -> float:
    """What an element's own text earns."""
    text = _own_text(node).strip()
    if not text:
        return 0.0
    points = 1 + text.count(",") + text.count("、") + min(len(text) / 100, 3)
    return points * (0.2 if len(text) < 25 else 1) * (1 - link_share)


def _links(sizes: tuple[int, int]) -> float:
    return min(1.0, sizes[1] / sizes[0]) if sizes[0] else 0.0


def _scores(nodes: list[Node], sizes: dict[int, tuple[int, int]]) -> None:
    """Give every element its points, from the leaves up."""
    for n in reversed(nodes):
        if n.name in CONTAINERS:
            n.score += _points(n, _links(sizes[id(n)]))
        if n.parent is not None:
            n.parent.score += n.score / 2
            if n.name in PARAGRAPHS:
                n.parent.score += _points(n, _links(sizes[id(n)]))


def _units(parent: Node) -> list[list[Node | str]]:
    """The children of an element: every block alone, and the lines of text between blocks."""
    out: list[list[Node | str]] = []
    line = False
    for c in parent.children:
        block = isinstance(c, Node) and c.name in BLOCK
        if block or not line:
            out.append([])
        out[-1].append(c)
        line = not block
    return out


def best_container(root: Node) -> list[Node | str]:
    """The kept elements and lines, in page order."""
    sizes, nodes = _measure(root), list(_elements(root))
    _scores(nodes, sizes)

    def worth(n: Node) -> float:
        return n.score * (1 - _links(sizes[id(n)])) * (1.5 if n.name in ("article", "main") else 1)

    scored = [n for n in nodes if n.score > 0 and n.name not in ("#root", "html")]
    if not scored:
        return [next((n for name in ("article", "main", "body") for n in nodes if n.name == name), root)]
    best = top = max(scored, key=worth)
    above = [best]
    while above[-1].parent is not None:
        above.append(above[-1].parent)
    for name in ("article", "main"):
        if any(n.name == name for n in above):
            top = next(n for n in reversed(above) if n.name == name)
            break
    if top.parent is None or top.name in ("body", "main"):
        return [top]

    def kind(n: Node) -> tuple[str, str]:
        return n.name, " ".join(sorted(_attributes(n.attrs).get("class", "").split())) if n.attrs else ""

    def stays(unit: list[Node | str]) -> bool:
        c = unit[0]
        if unit == [top] or isinstance(c, Node) and c.name == "article":
            return True
        if isinstance(c, Node) and c.name in BLOCK and (worth(c) >= 0.2 * worth(best) or _is_heading(c, sizes)):
            return True
        if isinstance(c, Node) and kind(c) == kind(top) and _links(sizes[id(c)]) < 0.25:
            return True
        if isinstance(c, Node) and c.name in BLOCK and c.name not in ("p", "pre", "blockquote", "ul", "ol", "dl", "table", *HEADINGS):
            return False
        own = [sizes[id(x)] if isinstance(x, Node) else (len(x.strip()), 0) for x in unit]
        total, links = (sum(x[k] for x in own) for k in (0, 1))
        return total > 0 and links / total < 0.25

    return [c for unit in _units(top.parent) if stays(unit) for c in unit]


def _tidy(nodes: list[Node | str]) -> list[Node | str]:
    """Without lists of links before the first paragraph of running text, and without what stands under a heading over reader comments."""
    top = Node("#kept", "", None)
    top.children = nodes
    sizes = _measure(top)
    todo: list[Node] = []
    for n in _elements(top):
        total, links = sizes[id(n)]
        if n.name in ("p", "pre", "blockquote") and total >= RUNNING and links < 0.25 * total:
            break
        if n.name in ("ul", "ol") and total and links >= 0.9 * total:
            todo.append(n)
    gone = {id(n) for n in todo}
    for n in list(_elements(top)):
        kept: list[Node | str] = []
        level, skips = 0, False
        blocks_ = [c for c in n.children if isinstance(c, Node) and c.name in BLOCK]
        following = dict(zip(map(id, blocks_), blocks_[1:], strict=False))
        for c in n.children:
            if isinstance(c, Node) and c.name in HEADINGS:
                if not skips or int(c.name[1]) <= level:
                    after = following.get(id(c))
                    skips = after is not None and after.name in ("ul", "ol", "dl", "div", "section", "article") and COMMENTS.fullmatch(unescape(_own_text(c)).strip()) is not None
                    level = int(c.name[1])
            if not skips and not (isinstance(c, Node) and id(c) in gone):
                kept.append(c)
        n.children = kept
    return top.children


def _is_heading(node: Node, sizes: dict[int, tuple[int, int]]) -> bool:
    """Whether all text of an element is a title."""
    total = sizes[id(node)][0]
    return total > 0 and total == sum(sizes[id(n)][0] for n in _elements(node) if n.name in ("h1", "h2"))


def blocks(nodes: list[Node | str]) -> list[str]:
    """Texts of the blocks below ``nodes`` in page order; white space becomes one space, empty blocks go."""
    out: list[str] = []
    now: list[str] = []

    def flush() -> None:
        if now:
            text = " ".join("".join(now).split())
            now.clear()
            if text:
                out.append(text)

    todo: list[Node | str | None] = list(reversed(nodes))
    while todo:
        c = todo.pop()
        if c is None:
            flush()
        elif isinstance(c, str):
            now.append(unescape(c))  # a reference ends with its text node
        elif c.name == "br":
            now.append(" ")
        elif c.name in BLOCK or c.name == "#root":
            flush()
            todo.append(None)
            todo += reversed(c.children)
        else:
            todo += reversed(c.children)
    flush()
    return out


def main_text(html: str | None) -> str:
    """The article of a page, its blocks joined by line feeds; empty if there is none."""
    if not html:
        return ""
    root = parse(html)
    _prune(root)
    return "\n".join(blocks(_tidy(best_container(root))))


def plain_text(html: str | None) -> str:
    """All visible text of a page, block by block, menus and footers too."""
    if not html:
        return ""
    root = parse(html)
    for node in _elements(root):
        node.children = [c for c in node.children if isinstance(c, str) or c.name not in RAW and c.name != "head"]
    return "\n".join(blocks([root]))


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page, from its whole html.

    A null or empty page, or one without text, gives the empty text. Broken
    markup is read as far as it goes. Rows are independent: repeated ones give
    repeated results. Other columns of ``pages`` are not looked at.
    """

    def run(batches):
        for batch in batches:
            texts = [main_text(h) for h in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return scratch.columns(pages, page_id=page_id, url=url, html=html).mapInArrow(run, "page_id long, url string, text string, n_chars long")
