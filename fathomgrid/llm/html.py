"""Main text of web pages by tag-path ratios."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import as_bytes

TAG = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|$)|'[^']*(?:'|$))*)(>|$)", re.S)
MARKS = re.compile(r"\b(?:class|id|role|itemprop|aria-label)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？；：؟،]")
PARTS = re.compile(r"[a-z]+|[0-9]+")

# Names of HTML elements, words of page furniture and of layout.
RAW = frozenset("script style noscript template iframe textarea select svg object audio video annotation annotation-xml".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt rp s samp small span strike strong sub sup time tt u var wbr img br input button canvas".split()) | frozenset(
    "math mi mn mo ms mtext mspace mrow msup msub msubsup mfrac msqrt mroot mover munder munderover mmultiscripts mprescripts mtable mtr mtd mstyle mpadded mphantom menclose merror semantics".split()
)
ASIDE = frozenset("nav footer aside form button fieldset dialog menu head".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion promoted nav navbar navigation menu menus breadcrumb breadcrumbs crumbs "
    "sidebar sidebars aside rail widget widgets footer foot header masthead banner topbar toolbar cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations trending popular pagination pager copyright legal disclaimer skip".split()
)
READERS = frozenset("comment comments commentlist commenter disqus respond replies reply".split())
#: Whole names (not parts of names) of adverts and readers' comments.
APART = frozenset("ad ads advert adverts advertisement comment comments".split())
LAYOUT = frozenset("wrap wrapper container layout page content main body with has no site article post entry story".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LEAVES = HEADINGS | frozenset("p li pre td th dt dd blockquote figcaption".split())
CLOSED_BY = {
    "p": frozenset("address article aside blockquote details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split()),
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "tr": frozenset(["tr", "tbody", "tfoot"]),
    "td": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "th": frozenset(["td", "th", "tr", "tbody", "tfoot"]),
    "option": frozenset(["option", "optgroup"]),
}
SCOPES = ("article", "main", "section")
#: What a block's score is multiplied by for each furniture element above it, and for an ambiguous class.
FAINT, UNSURE = 0.05, 0.3
#: What a path's score is multiplied by at the ends of an article or main element.
NAMED = 1_000


class Page:
    """A page's nodes and blocks of text, in page order.

    Nodes have numbers, larger than their parent's; a tag path is a number too, found from the parent's path and the
    step, so that no work grows with a node's depth.
    """

    def __init__(self):
        self.parent, self.path, self.name, self.element, self.weight, self.sticky, self.main = [-1], [0], [""], [1.0], [1.0], [False], [False]
        self.paths: dict[tuple[int, str], int] = {}
        self.blocks: list[Block] = []

    def add(self, parent: int, name: str, step: str, element: float, weight: float, sticky: bool, main: bool) -> int:
        self.parent.append(parent)
        self.path.append(self.paths.setdefault((self.path[parent], step), len(self.paths) + 1))
        self.name.append(name)
        self.element.append(element)
        self.weight.append(weight)
        self.sticky.append(sticky)
        self.main.append(main)
        return len(self.parent) - 1


class Block:
    """Text between block boundaries: its node, parts of text, characters of links."""

    __slots__ = ("node", "parts", "linked", "text", "score")

    def __init__(self, node: int):
        self.node = node
        self.parts: list[str] = []
        self.linked = 0
        self.text, self.score = "", 0.0


def weighed(name: str, attributes: str, inside: dict[str, int]) -> tuple[float, float, bool]:
    """What an element and its class words weigh (1: nothing against its text), and whether it holds readers' comments.

    inside counts the open elements by name. Elements, roles and hiding are what HTML defines as apart, an article within
    an article too. Class words only guess, so they are weights of scores. Within an article none counts, but for a
    class that is as a whole the name of an advert or of comments; within a main element, and for articles, only those
    of readers' comments do.
    """
    element, words, readers = 1.0, 1.0, False
    article, main = inside.get("article", 0) > 0, inside.get("main", 0) > 0
    if name in ASIDE or name == "header" and not any(inside.get(x) for x in SCOPES) or name == "article" and article:
        element = FAINT
    if attributes and ("=" in attributes or "hidden" in attributes):
        if HIDDEN.search(attributes):
            element = FAINT
        for m in MARKS.finditer(attributes):
            value = (m[1] or m[2] or m[3] or "").lower()
            if m[0][:4].lower() == "role":
                if value in ROLES:
                    element = FAINT
                continue
            if article and APART & set(value.split()):
                words = FAINT
            if article or name in ("body", "html", "main"):
                continue
            found = set(PARTS.findall(value))
            if found & READERS and "no" not in found:
                words, readers = FAINT, True
            if found & FURNITURE and not main and name != "article":
                words = min(words, UNSURE if found & LAYOUT else FAINT)
    return element, words, readers


def parsed(page: str) -> Page:
    """Nodes and blocks of text. Broken pages are read as they come: implied ends, unclosed and stray tags."""
    out = Page()
    stack: list[tuple[str, int]] = []  # name and node of open elements
    inside: dict[str, int] = {}
    unclosed: set[str] = set()  # names without an end tag in the rest of the page
    current: Block | None = None
    links = at = 0

    def text(piece: str) -> None:
        nonlocal current
        if not piece:
            return
        if current is None:
            current = Block(stack[-1][1] if stack else 0)
            out.blocks.append(current)
        piece = html.unescape(piece)
        current.parts.append(piece)
        if links:
            current.linked += len(piece)

    def pop() -> str:
        nonlocal current
        name = stack.pop()[0]
        inside[name] -= 1
        current = None
        return name

    def push(name: str, attributes: str) -> None:
        nonlocal current
        up = stack[-1][1] if stack else 0
        element, words, readers = weighed(name, attributes, inside)
        kind = MARKS.search(attributes) if attributes else None
        step = name if kind is None else f"{name}.{(kind[1] or kind[2] or kind[3] or '').lower()}"
        step += "!" * (element < 1)  # a path of its own
        sticky = out.sticky[up] or readers
        main = not sticky and element == 1 and name in ("article", "main")
        held = out.element[up] if main else out.weight[up]  # class words around an article say nothing of it
        stack.append((name, out.add(up, name, step, out.element[up] * element, held * element * words, sticky, main or out.main[up] and element == 1)))
        inside[name] = inside.get(name, 0) + 1
        current = None

    def skipped(name: str) -> int | None:
        """Where the element's end tag ends, if it has one."""
        if name in unclosed:
            return None
        close = re.compile(f"</{name}(?=[\\s/>])", re.I).search(page, at)
        if close is None:
            unclosed.add(name)
            return None
        return page.find(">", close.start()) + 1 or len(page)

    end = len(page)
    while at < end:
        lt = page.find("<", at)
        if lt < 0:
            text(page[at:])
            break
        m = TAG.match(page, lt)
        if m is None:  # a lone less-than sign
            text(page[at : lt + 1])
            at = lt + 1
            continue
        text(page[at:lt])
        at = m.end()
        if m[2] is None:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        if not m[4]:  # a tag cut off by the end of the page
            break
        closing, name, attributes = bool(m[1]), m[2].lower(), m[3]
        if (name in RAW or name == "title" and not inside.get("body")) and not closing:
            if name in ("title", "script", "style", "textarea") or not attributes.endswith("/"):
                at = skipped(name) or end
        elif name == "br":
            text(" ")
        elif name in VOID:
            if name == "hr":
                current = None
        elif name in INLINE:
            if name == "a":
                links = 0 if closing else 1
            elif name == "button" and not closing:
                at = skipped(name) or at
            elif not closing and attributes and min(weighed(name, attributes, inside)[:2]) < 1:
                push(name, attributes)  # an inline notice: it is a node of its own until it closes
            elif closing and inside.get(name):
                while pop() != name:
                    pass
        elif closing:
            if inside.get(name):
                while pop() != name:
                    pass
            current = None
            links = 0
        else:
            while stack and name in CLOSED_BY.get(stack[-1][0], ()):
                pop()
            links = 0
            current = None
            if not attributes.endswith("/") or name in ("p", "div"):
                push(name, attributes)
    for b in out.blocks:
        b.text = " ".join("".join(b.parts).split())
        b.parts = []
    out.blocks = [b for b in out.blocks if b.text]
    return out


def extract(page: str, smoothing: float = 1.0, share: float = 0.75, threshold: float = 0.5, tail: float = 0.1) -> str:
    """Main text of a page: its content blocks in page order, joined by an empty line.

    Text length and punctuation are summed by tag path and divided by the path's number of blocks; both ratios are
    smoothed over the blocks in page order (Gaussian weights) and fused as a product, damped by the share of links and
    weighed by what elements and class words tell (weighed). Paths that reach threshold times the mean score are content. The
    content node is the lowest one that holds share of their score; what stands in it is the main text, but for blocks
    that are furniture within it, and for those before the first or after the last content whose path by itself doesn't
    reach tail of the threshold (an article or main element multiplies its score by NAMED). A page's time grows with its length only.

    What is left out within an article: elements that HTML sets apart (nav, aside, footer, form, button, menu, dialog,
    hidden ones, an article in an article), what it doesn't show as text (scripts, styles, options of a form, embedded
    objects), paths that are mostly links, and elements whose class is as a whole the name of an advert or of comments
    (`ad`, not `ad-hoc`). No other word of a class and no word of a text excludes anything there; formulas (MathML) are text. Outside articles class words weigh, too, and a notice that stands in the same path as the text stays.
    """
    tree = parsed(page)
    found = tree.blocks
    if not found:
        return ""
    sums: dict[int, list[float]] = {}
    for b in found:
        s = sums.setdefault(tree.path[b.node], [0, 0, 0, 0])
        s[0] += len(b.text)
        s[1] += len(PUNCTUATION.findall(b.text))
        s[2] += 1
        s[3] += min(b.linked, len(b.text))
    linked = {p: s[3] / s[0] for p, s in sums.items()}
    weights = [math.exp(-(d * d) / (2 * smoothing * smoothing)) for d in range(3)]
    raw = [(s[0] / s[2], (s[1] + 0.1) / s[2]) for s in (sums[tree.path[b.node]] for b in found)]
    by_path: dict[int, list[float]] = {}
    for i, b in enumerate(found):
        near = [(weights[abs(j - i)], raw[j]) for j in range(max(0, i - 2), min(len(found), i + 3))]
        total = sum(w for w, _ in near)
        length, marks = (sum(w * r[k] for w, r in near) / total for k in (0, 1))
        p = tree.path[b.node]
        b.score = length * marks * (1 - linked[p]) ** 2 * tree.weight[b.node]
        held = by_path.setdefault(p, [0.0, 0])
        held[0] += b.score
        held[1] += 1
    least = threshold * sum(b.score for b in found) / len(found)
    content = {p for p, (total, n) in by_path.items() if total / n >= least}

    # mass of content below each node, and the lowest node with its share
    mass = [0.0] * len(tree.parent)
    for b in found:
        if tree.path[b.node] in content:
            mass[b.node] += b.score * len(b.text)
    for node in range(len(mass) - 1, 0, -1):
        mass[tree.parent[node]] += mass[node]
    top = 0
    for node in range(1, len(mass)):
        if tree.parent[node] == top and tree.name[node] not in LEAVES and mass[node] >= share * mass[0] > 0:
            top = node
    inside = [node == top for node in range(len(mass))]
    for node in range(top + 1, len(mass)):
        inside[node] = inside[tree.parent[node]]

    # within it: content paths, and other blocks that are no furniture there
    usual = tree.weight[top] or 1.0
    region = [b for b in found if inside[b.node]]
    strong = [tree.path[b.node] in content and not (tree.sticky[b.node] and not tree.sticky[top]) for b in region]
    known = [i for i, x in enumerate(strong) if x]
    if not known:
        return ""
    first, last = known[0], known[-1]
    kept = list(strong)
    for i, b in enumerate(region):
        p = tree.path[b.node]
        if kept[i] or tree.weight[b.node] < 0.5 * usual or linked[p] >= 0.5:
            continue
        s = sums[p]
        own = s[0] * (s[1] + 0.1) / s[2] ** 2 * (1 - linked[p]) ** 2 * tree.weight[b.node]
        kept[i] = first < i < last or own * (NAMED if tree.main[b.node] else 1) >= tail * least
    for i in range(len(region) - 2, -1, -1):  # a heading stays with what follows it
        b = region[i]
        if not kept[i] and kept[i + 1] and tree.name[b.node] in HEADINGS and tree.weight[b.node] >= 0.5 * usual:
            kept[i] = True
    return "\n\n".join(b.text for b, keep in zip(region, kept) if keep)


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html") -> DataFrame:
    """Main text of every page: (page_id, url, text, n_chars). A null page, or one without content, has an empty text.

    One row out for each row in, whatever its id and url are; other columns are dropped.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(t.decode()) for t in as_bytes(batch.column(2))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], ["page_id", "url", "text", "n_chars"])

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col, text_col).mapInArrow(run, f"page_id {kind}, url string, text string, n_chars long")
