"""Main text of web pages: flat text blocks classified by a small decision tree.

A page is cut at block-level tags into flat blocks. Each block has its word count, link density, the same two numbers of
its neighbours, and where it stands (in a menu, header, footer, aside, form or the like; in an article or main element;
under a class, id or role that names a notice, advert, comment list and so on; in a heading). A decision tree trained on
the labelled table below keeps or drops it: where a page has an article, by place; where names are vague or the page has
no article, by words, links and neighbours. Names of what is around the outermost article don't count, vague ones only
of the nearest element that has any. Kept blocks are joined by newlines; white space inside one is a blank.

Nulls and pages without text give an empty text. Unclosed tags, comments and scripts end as browsers end them: only raw
text (``RAW``) and templates run to the page's end, a button or drawing ends with its parent. Nothing is
cut: the whole page is read, however long. Equal pages give equal texts; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .common import tidy

FEATURES = ["words", "links", "words_before", "links_before", "words_after", "links_after", "aside", "main", "named", "heading"]

#: Labelled blocks: the features in order, then 1 for main text. ``main`` is 0.5 where the page has no main element,
#: ``named`` is 0.5 where a name is vague. These are the blocks whose place alone doesn't decide.
LABELLED = """
3 1.0 0 0.0 2 1.0 0 0.5 0 0  0
2 1.0 3 1.0 2 1.0 0 0.5 0 0  0
4 1.0 2 1.0 10 0.0 0 0.5 0 0  0
5 0.9 60 0.0 5 0.9 0 0.5 0 0  0
7 0.0 2 1.0 40 0.0 0 0.5 0 1  1
5 0.0 60 0.0 40 0.0 0 0.5 0 1  1
40 0.0 7 0.0 60 0.0 0 0.5 0 0  1
100 0.1 40 0.0 80 0.0 0 0.5 0 0  1
25 0.2 60 0.0 70 0.0 0 0.5 0 0  1
8 0.0 60 0.0 70 0.0 0 0.5 0 0  1
2 0.0 40 0.0 30 0.0 0 0.5 0 0  1
60 0.0 3 1.0 9 0.0 0 0.5 0 0  1
40 0.0 60 0.0 50 0.0 0 1.0 0.5 0  1
90 0.1 40 0.0 30 0.0 0 1.0 0.5 0  1
12 0.0 60 0.0 50 0.0 0 1.0 0.5 0  1
3 0.0 60 0.0 25 0.0 0 1.0 0.5 1  1
6 0.2 30 0.0 40 0.0 0 1.0 0.5 0  1
3 1.0 60 0.0 3 1.0 0 1.0 0.5 0  0
1 1.0 2 1.0 2 1.0 0 1.0 0.5 0  0
6 0.9 40 0.0 5 0.9 0 1.0 0.5 0  0
9 0.8 80 0.0 0 0.0 0 1.0 0.5 0  0
12 0.0 0 0.0 15 0.0 0 0.5 0.5 0  1
45 0.0 30 0.0 60 0.0 0 0.5 0.5 0  1
80 0.1 5 0.0 40 0.0 0 0.5 0.5 0  1
8 0.0 70 0.0 50 0.0 0 0.5 0.5 0  1
5 0.0 2 1.0 50 0.0 0 0.5 0.5 1  1
3 0.0 0 0.0 2 1.0 0 0.5 0.5 0  0
4 0.0 1 1.0 3 1.0 0 0.5 0.5 0  0
5 0.0 4 1.0 0 0.0 0 0.5 0.5 0  0
6 0.9 50 0.0 5 0.9 0 0.5 0.5 0  0
3 0.0 0 0.0 2 1.0 0 0.5 0 0  0
4 0.0 2 1.0 2 1.0 0 0.5 0 0  0
5 0.0 4 1.0 0 0.0 0 0.5 0 0  0
6 0.0 5 0.9 0 0.0 0 0.5 0 0  0
2 0.0 3 1.0 1 1.0 0 0.5 0 0  0
4 0.0 12 0.0 0 0.0 0 0.5 0 0  1
12 0.0 1 1.0 4 0.0 0 0.5 0 0  1
10 0.0 60 0.0 0 0.0 0 0.5 0 0  1
3 0.0 30 0.0 0 0.0 0 0.5 0 0  1
30 0.0 2 1.0 0 0.0 0 0.5 0 0  1
14 0.0 0 0.0 0 0.0 0 0.5 0 0  1
35 0.3 4 1.0 5 1.0 0 0.5 0 0  1
20 0.9 4 1.0 30 0.9 0 0.5 0 0  0
1 1.0 1 1.0 12 0.0 0 0.5 0 0  0
1 1.0 2 1.0 60 0.0 0 0.5 0 0  0
2 1.0 0 0.0 1 1.0 0 0.5 0 0  0
3 1.0 2 1.0 0 0.0 0 0.5 0 0  0
2 1.0 2 0.0 2 0.0 0 0.5 0 0  0
2 1.0 30 0.0 2 0.0 0 0.5 0 0  0
2 0.0 2 1.0 0 0.0 0 0.5 0 0  0
2 0.0 13 0.0 2 1.0 0 0.5 0 0  1
4 0.0 20 0.9 0 0.0 0 0.5 0 0  0
5 0.0 14 1.0 3 1.0 0 0.5 0 0  0
3 0.0 40 0.8 0 0.0 0 0.5 0 0  0
4 0.0 20 0.0 0 0.0 0 0.5 0 0  1
5 0.0 14 0.0 3 1.0 0 0.5 0 0  1
3 0.0 40 0.0 0 0.0 0 0.5 0 0  1
2 0.0 20 0.0 2 1.0 0 0.5 0 0  1
13 0.0 1 1.0 2 0.0 0 0.5 0 0  1
"""
#: And those of a clear place, whatever their words and neighbours: (aside, main, named) with the label.
PLACES = [((1, 0.0, 0), 0), ((1, 0.5, 0), 0), ((1, 1.0, 0), 0), ((0, 0.0, 0), 0), ((0, 0.0, 1), 0), ((0, 0.5, 1), 0), ((0, 1.0, 1), 0), ((0, 1.0, 0), 1)]
#: How many times each of these counts, by label: an article is seldom cut, and it is what most blocks of most pages are.
WEIGHT = (1, 6)
OWN, AROUND = [(2, 0.0), (3, 1.0), (12, 0.0), (40, 0.1), (150, 0.0)], [(0, 0.0), (2, 1.0), (12, 0.0), (120, 0.0)]


BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody tfoot thead tr ul".split())
SPACES = frozenset("br td th wbr img button label object".split()) - {"wbr"}
#: Elements without main text: what is up to the end tag of the first is no markup, the others are open elements.
RAW = frozenset("script style title noscript textarea iframe noembed noframes xmp".split())
DROPPED = frozenset("template svg canvas audio video select button datalist".split())
#: Start tags that end a drawing, parts of one that hold HTML, and start tags that end a table's cell.
LEAVE_SVG = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var".split())
WITHIN_SVG = frozenset("foreignobject desc title style script".split())
CELLS = frozenset("td th tr tbody thead tfoot caption".split())
ASIDES = frozenset("nav footer aside form menu dialog search head fieldset".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
MAIN = frozenset("article main".split())
CLOSED_BY_NEXT = frozenset("p li dt dd option tr".split())
#: Parts of class names: those that say what an element is for, those that may, and those that add nothing.
NAMES = re.compile(
    r"ads?|advert\w*|adsense|adbox|banner|sponsor\w*|promo\w*|cookies?|consent|gdpr|notification|popup|modal|overlay|paywall|comments?|commentlist|"
    r"respond|replies|disqus|sidebar|widget\w*|related|recommended|trending|share|sharing|social|newsletter|subscribe\w*|signup|login|nav|navbar|"
    r"navigation|menu|menubar|breadcrumbs?|pagination|pager|footer|masthead|toolbar|contentinfo|complementary|skip|sitemap"
)
VAGUE = frozenset("notice notices alert discussion side aside popular follow copyright legal disclaimer toc".split())
PLAIN = frozenset("list box wrapper wrap area section form bar container block item items thread link links button buttons icon icons top bottom left right inner outer".split())
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>|<!--.*?(?:-->|\Z)|<[!?/][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>""", re.S)
ATTRIBUTE = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+))""", re.I)
CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")


@dataclass
class Block:
    text: str
    words: int
    links: float
    aside: int
    main: float
    named: float
    heading: int


def named(attributes: str) -> float | None:
    """1 where a class, id or role names something that is no main text, 0.5 where it may, 0 where not, None without any."""
    found = ATTRIBUTE.findall(attributes)
    if not found:
        return None
    most = 0.0
    for name in " ".join(a or b or c for a, b, c in found).split():
        parts = re.findall("[a-z]+", CAMEL.sub("-", name).lower())
        clear, vague = any(map(NAMES.fullmatch, parts)), any(p in VAGUE for p in parts)
        if clear and all(p in VAGUE or p in PLAIN or NAMES.fullmatch(p) for p in parts):
            return 1.0
        most = max(most, 0.5 * (clear or vague))
    return most


def place_name(open_: list[tuple], relaxed: int) -> float:
    """What the names around a block say: clear ones from the outermost article inwards, a vague one only nearest to it."""
    outermost = next((k for k, x in enumerate(open_) if x[2]), None)
    if relaxed == 2 and outermost is not None:
        return 0.0
    inside = [x[3] for x in open_[0 if outermost is None else outermost + (relaxed > 0) :] if x[3] is not None]
    if 1.0 in inside:
        return 1.0
    return 0.5 if inside and inside[-1] == 0.5 and not next(x for x in reversed(open_) if x[3] is not None)[2] else 0.0


def still_dropped(inner: list[str], closing: bool, name: str, attributes: str, parents: list) -> bool:
    """Whether a tag leaves the dropped element ``inner[0]`` open or is its own end; ``inner`` has the open elements from there on."""
    if "template" in inner and not (name in inner and closing):
        parents = []
    elif name in CELLS and "table" not in inner:
        inner.clear()  # the cell around it ends
        return False
    if closing:
        if name in inner:
            while inner.pop() != name:
                pass
            return True
        if any(x[0] == name for x in parents):
            inner.clear()
        return bool(inner)
    if attributes.endswith("/") or name in VOID and inner[-1] != "svg":
        return True
    if inner[-1] == "svg":
        if name in LEAVE_SVG:
            inner.pop()
            if not inner:
                return False
        elif name in WITHIN_SVG:
            inner.append(name)
    if name in ("button", "select") and name in inner:
        while inner.pop() != name:
            pass
        if name == "select":
            return True
    if name in BLOCKS and name not in VOID or name in DROPPED:
        inner.append(name)
    return True


def text_blocks(page: str, relaxed: int = 0) -> list[Block]:
    """The blocks of a page. ``relaxed``: at 1 a form, what is around the outermost article and the article's own name say
    nothing, at 2 no name within it either."""
    blocks: list[Block] = []
    open_: list[tuple[str, bool, bool, float | None]] = []  # tag, aside, main, named
    parts: list[str] = []
    linked: list[str] = []
    inner: list[str] = []  # open elements from a dropped one on
    links = 0
    heading = False
    has_main = False

    def flush() -> None:
        text = " ".join(html.unescape("".join(parts)).split())
        if text:
            own = len(text.split(" "))
            inside = len(html.unescape(" ".join(linked)).split())
            in_main = any(x[2] for x in open_)
            in_header = any(x[0] == "header" for x in open_)
            outermost = next((k for k, x in enumerate(open_) if x[2]), 0)
            asides = [x for x in open_[outermost:] if x[0] != "form"] if relaxed else open_
            aside = any(x[1] for x in asides) or in_header and not (in_main and heading)
            blocks.append(Block(text, own, min(1.0, inside / own), int(aside), float(in_main), place_name(open_, relaxed), int(heading)))
        parts.clear()
        linked.clear()

    at, end = 0, len(page)
    while at < end:
        tag = TAG.search(page, at)
        piece = page[at : tag.start() if tag else end]
        if piece and not inner:
            parts.append(piece)
            if links:
                linked.append(piece)
        if not tag:
            break
        at = tag.end()
        closing, name, attributes = (tag[1], tag[2], tag[3]) if tag[2] else (tag[4], tag[5], tag[6])
        if not name:
            continue
        name = name.lower()
        raw = name in RAW and not closing and not (inner and inner[-1] == "svg")
        if inner and not raw and still_dropped(inner, bool(closing), name, attributes, open_):
            continue
        if raw or name in DROPPED and not closing:
            if not attributes.endswith("/"):
                if raw:
                    over = re.compile(rf"</{re.escape(name)}\b[^>]*>?", re.I).search(page, at)
                    at = over.end() if over else end
                else:
                    inner.append(name)
            parts.append(" ")
            continue
        if name == "a":
            links = 0 if closing else 1
        elif name in SPACES:
            parts.append(" ")
        elif name in BLOCKS:
            flush()
            if closing:
                heading = heading and name not in HEADINGS
                for k in range(len(open_) - 1, -1, -1):
                    if open_[k][0] == name:
                        del open_[k:]
                        break
            else:
                heading = name in HEADINGS
                while open_ and (open_[-1][0] == "p" or open_[-1][0] == name and name in CLOSED_BY_NEXT):
                    open_.pop()
                if name not in VOID:
                    has_main |= name in MAIN
                    if name == "body":
                        open_.clear()
                    open_.append((name, name in ASIDES, name in MAIN, None if name in ("html", "body") else named(attributes)))
    flush()
    if not has_main:
        for b in blocks:
            b.main = 0.5
    return blocks


def rows_of(blocks: list[Block]) -> list[list[float]]:
    none = Block("", 0, 0.0, 0, 0, 0, 0)
    around = [none, *blocks, none]
    return [
        [b.words, b.links, p.words, p.links, n.words, n.links, b.aside, b.main, b.named, b.heading]
        for p, b, n in zip(around, blocks, around[2:])
    ]


def grow_tree(rows: list[list[float]], labels: list[int], depth: int = 9):
    """A decision tree by Gini impurity: a leaf is 0 or 1, a node (feature, threshold, left, right)."""
    ones = sum(labels)
    if not depth or ones in (0, len(labels)):
        return int(2 * ones > len(labels))

    def impurity(part: list[int]) -> float:
        share = sum(part) / len(part)
        return len(part) * share * (1 - share)

    best = None
    for k in range(len(rows[0])):
        values = sorted({r[k] for r in rows})
        for low, high in zip(values, values[1:]):
            cut = (low + high) / 2
            sides = [[y for r, y in zip(rows, labels) if (r[k] <= cut) == left] for left in (True, False)]
            worth = impurity(sides[0]) + impurity(sides[1])
            if best is None or worth < best[0] - 1e-12:
                best = (worth, k, cut)
    if best is None:
        return int(2 * ones > len(labels))
    _, k, cut = best
    parts = [[(r, y) for r, y in zip(rows, labels) if (r[k] <= cut) == left] for left in (True, False)]
    return (k, cut, *(grow_tree([r for r, _ in p], [y for _, y in p], depth - 1) for p in parts))


@lru_cache(maxsize=1)
def trained_tree():
    table = [[float(x) for x in line.split()] for line in LABELLED.strip().splitlines()]
    table += [[*own, *before, *after, *place, heading, label] for heading in (0, 1) for place, label in PLACES for _ in range(WEIGHT[label]) for own in OWN for before in AROUND for after in AROUND]
    return grow_tree([r[:-1] for r in table], [int(r[-1]) for r in table])


def is_main(tree, row: list[float]) -> bool:
    while isinstance(tree, tuple):
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return bool(tree)


def main_text(page: str | None, tree=None) -> str:
    """The blocks that the tree takes for main text, joined by newlines.

    Where it takes none, the page is read again: a form around everything, an article inside of an aside and names on or
    in the article count less then (``text_blocks``), and at last plain blocks, outside of forms and asides, without a telling name
    and mostly not links, are taken. A page of nothing but menus, notices and the like stays empty.
    """
    if not page:
        return ""
    tree = tree or trained_tree()
    for relaxed in range(3):
        blocks = text_blocks(page, relaxed)
        if kept := [b.text for b, r in zip(blocks, rows_of(blocks)) if is_main(tree, r)]:
            return "\n".join(kept)
    return "\n".join(b.text for b in text_blocks(page) if not b.aside and b.named == 0 and b.links < 0.5)


def extract_main_text(page: Column) -> Column:
    """The main text of a column of pages."""

    @F.arrow_udf("string")
    @tidy
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        tree = trained_tree()
        for pages in batches:
            yield pa.array([main_text(p.as_py(), tree) for p in pages], pa.string())

    return extract(page)
