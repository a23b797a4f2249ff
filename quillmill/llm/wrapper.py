"""Main-text extraction by wrapper induction.

Pages become trees of block elements with texts as leaves. For each layout of a host one page is the reference; every
other page of that layout is aligned with it by simple tree matching. What the pages have at the aligned places tells
what a part of the reference is:

* a text that most pages repeat is template;
* the part that holds most of the varying text outside links is the region of the main text, however it is named: parts
  beside it (menus, adverts, notices) vary too, but hold little text or links;
* a part of the region that is nearly all links is a menu.

Marks of HTML (element names, roles, classes) decide where alignment can't: on hosts with too few pages to learn from, and
between a part and the one inside it that both hold the text.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import attrgetter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements that never hold main text. Fixed values.
ASIDE_TAGS = frozenset("head script style noscript template nav footer aside form button select option textarea input iframe object svg canvas dialog menu".split())
#: Roles that never hold main text. Fixed values.
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar".split())
#: Words of a class or id that mark such parts. Fixed values.
ASIDE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo nav navbar navigation menu breadcrumb breadcrumbs sidebar footer masthead cookie cookies consent notice notices banner popup modal"
    " comment comments disqus share sharing social related recommended newsletter subscribe signup pagination skip".split()
)
#: What may follow such a word in a name, and what says that the name only tells whether there is such a part. Fixed values.
CONTAINERS = frozenset("area bar block box btn button buttons container content form group holder inner item items link links list panel post posts region section slot unit widget widgets wrap wrapper".split())
TELLS = frozenset("no not has have with without is hide hidden".split())
#: Elements inside a line of text; all others are blocks. Fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr br".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template iframe textarea svg canvas object select".split())
#: Elements that hold lines of text; a region holds such elements and is none. Fixed values.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl li dt dd pre blockquote figure figcaption address".split())
#: Elements that tell the layouts of a host apart. Fixed values.
LAYOUT_TAGS = "article main section form table".split()
#: What an open element of the first kind is closed by. Fixed values.
CLOSED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|([^<]+|<)", re.DOTALL)
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)

#: A leaf is template if this share of the voting pages repeat it, and at least so many pages do.
SHARE, VOTES = 0.5, 2
#: A page that repeats more than this share of the reference's unmarked text may be a copy of it.
COPY = 0.5
#: If nearly all pages may be copies, they are a site with short articles only if some texts differ in most of them: a
#: leaf that fewer than VARIES repeat or nearly so. Then a leaf is template if CONSTANT of them repeat it.
VARIES, CONSTANT = 0.2, 0.9
#: A part inside another is the region of the main text if it holds this share of the other's varying text.
MOST = 0.6
#: A part of the region with more than this share of its text in links is a menu.
LINKS = 0.8
#: A marked element with more than this share of a page's text is around the main text, if no article is marked.
AROUND = 0.75
#: Cells of an alignment table that are kept at once; longer lists are aligned half by half.
CELLS = 1 << 21


#: Reference trees that a task keeps parsed.
TREES = 1024


class Node:
    """A block element, or a text (tag "#"). plain, links: characters of text outside and inside links, with all below."""

    __slots__ = ("aside", "full", "kids", "links", "main", "number", "plain", "shape", "size", "soft", "tag", "text")

    def __init__(self, tag: str, text: str = "", aside: bool = False, main: bool = False, soft: bool = False) -> None:
        self.tag, self.text, self.aside, self.main, self.soft = tag, text, aside, main, soft
        self.kids: list[Node] = []
        self.number = self.shape = self.full = self.plain = self.links = 0
        self.size = 1


def parse(source: str) -> Node:
    """The tree of a page, however its tags are nested or left open."""
    root = Node("")
    stack: list[tuple[str, Node]] = [("", root)]  # open elements, inline ones with the block they are in
    line: list[str] = []
    opened: Counter[str] = Counter()
    linked = 0  # characters of the line in links

    def flush() -> None:
        nonlocal linked
        if not line:
            return
        text = "".join(line)
        line.clear()
        if text := " ".join((html.unescape(text) if "&" in text else text).split()):
            leaf = Node("#", text)
            leaf.links = min(linked, len(text))
            leaf.plain = len(text) - leaf.links
            stack[-1][1].kids.append(leaf)
        linked = 0

    def close(at: int) -> None:
        flush()
        for tag, _ in stack[at:]:
            opened[tag] -= 1
        del stack[at:]

    at, end = 0, len(source)
    while at < end:
        m = _TOKEN.match(source, at)
        at = m.end()
        if m[4] is not None:
            if m[4] == "<" and source[at : at + 1].isalpha() and source.find(">", at) < 0:
                break  # a tag that the page's end cuts off
            line.append(m[4])
            if opened["a"] > 0:
                linked += len(m[4])
            continue
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            if opened[tag] <= 0:
                continue
            for i in range(len(stack) - 1, 0, -1):
                if stack[i][0] == tag:
                    if tag in INLINE:
                        opened[tag] -= 1
                        del stack[i]
                    else:
                        close(i)
                    break
                if tag in INLINE and stack[i][0] not in INLINE:
                    break
            continue
        if tag in INLINE:
            if tag == "br":
                line.append(" ")
            elif tag not in VOID:
                opened[tag] += 1
                stack.append((tag, stack[-1][1]))
            continue
        flush()
        ended = 0  # the outermost open element that this one ends
        for i in range(len(stack) - 1, 0, -1):
            if stack[i][0] == "p" or tag in CLOSED_BY.get(stack[i][0], ()):
                ended = i
            elif stack[i][0] not in INLINE:
                break
        if ended:
            close(ended)
        node = Node(tag, "", *_marks(tag, m[3]))
        stack[-1][1].kids.append(node)
        if tag in VOID:
            continue
        if tag in RAW or tag == "title":
            stop = re.compile(rf"</{re.escape(tag)}\s*>", re.IGNORECASE).search(source, at)
            at = stop.end() if stop else (end if tag in RAW else at)
            continue
        opened[tag] += 1
        stack.append((tag, node))
    close(1)
    nodes = list(walk(root))
    for i, node in enumerate(nodes):
        node.number = i
    for node in reversed(nodes):
        kids = node.kids
        if not kids:
            node.shape = hash(node.tag)
            node.full = hash((node.shape, node.text))
            continue
        for k in kids:
            node.size += k.size
            if not k.aside or k.soft:
                node.plain += k.plain
                node.links += k.links
        node.shape = hash((node.tag, *[k.shape for k in kids]))
        node.full = hash((node.shape, *[k.full for k in kids]))
    return root


def _marks(tag: str, attributes: str) -> tuple[bool, bool, bool]:
    """Whether an element is beside the main text, whether it holds it, and whether it is beside it only by a class, id or form."""
    aside, main, soft = tag in ASIDE_TAGS and tag != "form", tag in ("article", "main"), tag == "form"
    if attributes and ("=" in attributes):
        for name, *values in _NAMED.findall(attributes):
            words = "".join(values).lower()
            if name.lower() == "role":
                aside, main = aside or words in ASIDE_ROLES, main or words in ("main", "article")
            elif tag not in ("html", "body", "article", "main"):
                soft = soft or any(map(_beside, words.split()))
    return aside or soft, main, soft and not aside


def _beside(token: str) -> bool:
    """Whether a class or id is one of the words, or ends in one and names of containers, and doesn't only tell whether there is one."""
    parts = [p for p in re.split(r"[^a-z0-9]+", token) if p]
    while len(parts) > 1 and parts[-1] in CONTAINERS:
        parts.pop()
    return bool(parts) and parts[-1] in ASIDE_WORDS and TELLS.isdisjoint(parts)


def walk(node: Node) -> Iterator[Node]:
    todo = [node]
    while todo:
        node = todo.pop()
        yield node
        todo.extend(reversed(node.kids))


class _Match:
    """Sizes of largest matches of subtrees, by their shapes: equal shapes match whole, so copies cost nothing."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], int] = {}

    def size(self, x: Node, y: Node) -> int:
        """Nodes of the subtrees of x and y in a largest match, worked out from below without recursion."""
        todo = [(x, y)]
        while todo:
            a, b = todo[-1]
            if self._at_once(a, b) is not None:
                todo.pop()
                continue
            first, last = _ends(a.kids, b.kids, "shape")
            xs, ys = a.kids[first : len(a.kids) - last], b.kids[first : len(b.kids) - last]
            shapes_x, shapes_y = {n.shape: n for n in xs}, {n.shape: n for n in ys}
            if open_ := [(p, q) for p in shapes_x.values() for q in shapes_y.values() if self._at_once(p, q) is None]:
                todo.extend(open_)
                continue
            ends = sum(n.size for n in a.kids[:first]) + sum(n.size for n in a.kids[len(a.kids) - last :])
            self.known[a.shape, b.shape] = 1 + ends + (int(self.rows(xs, ys)[-1]) if xs and ys else 0)
            todo.pop()
        return self._at_once(x, y)

    def _at_once(self, x: Node, y: Node) -> int | None:
        if x.tag != y.tag:
            return 0
        if x.shape == y.shape:
            return x.size
        if not x.kids or not y.kids:
            return 1
        return self.known.get((x.shape, y.shape))

    def weights(self, xs: list[Node], ys: list[Node]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(table, row of each x, column of each y): the table has the size for each pair of shapes."""
        shapes_x, shapes_y = {n.shape: n for n in xs}, {n.shape: n for n in ys}
        table = np.array([[self.size(p, q) for q in shapes_y.values()] for p in shapes_x.values()], dtype=np.int64)
        of_x, of_y = ({shape: i for i, shape in enumerate(s)} for s in (shapes_x, shapes_y))
        return table, np.array([of_x[n.shape] for n in xs]), np.array([of_y[n.shape] for n in ys])

    def rows(self, xs: list[Node], ys: list[Node]) -> np.ndarray:
        """The last row of the table of largest matches of the first x with the first y."""
        return _table(*self.weights(xs, ys), None)[-1]

    def pairs(self, xs: list[Node], ys: list[Node]) -> Iterator[tuple[Node, Node]]:
        """A largest match of two lists of siblings; of those the one with most subtrees that are equal with their texts."""
        todo = [(xs, ys)]
        while todo:
            xs, ys = todo.pop()
            first, last = _ends(xs, ys, "full")
            if first + last < min(len(xs), len(ys)):
                both = {n.full for n in xs[first : len(xs) - last]}.intersection(n.full for n in ys[first : len(ys) - last])
                if not both or (len(xs) - first - last) * (len(ys) - first - last) > CELLS:
                    first, last = _ends(xs, ys, "shape")
            yield from zip(xs[:first], ys[:first], strict=False)
            yield from zip(xs[len(xs) - last :], ys[len(ys) - last :], strict=True)
            xs, ys = xs[first : len(xs) - last], ys[first : len(ys) - last]
            if not xs or not ys:
                continue
            table, of_x, of_y = self.weights(xs, ys)
            full_x, full_y = (np.array([n.full for n in ns], dtype=np.int64) for ns in (xs, ys))
            if len(xs) > 1 and len(xs) * len(ys) > CELLS:  # the halves of one list go with two parts of the other
                half, scale = len(xs) // 2, 1 + min(len(xs), len(ys))
                upper = _table(table, of_x[:half], of_y, (full_x[:half], full_y), scale)[-1]
                lower = _table(table, of_x[half:][::-1], of_y[::-1], (full_x[half:][::-1], full_y[::-1]), scale)[-1][::-1]
                at = int(np.argmax(upper + lower))
                todo += [(xs[:half], ys[:at]), (xs[half:], ys[at:])]
                continue
            grid = _table(table, of_x, of_y, (full_x, full_y), 1 + min(len(xs), len(ys)), whole=True)
            i, j = len(xs), len(ys)
            while i and j:
                if grid[i, j] == grid[i - 1, j]:
                    i -= 1
                elif grid[i, j] == grid[i, j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    yield xs[i], ys[j]


def _ends(xs: list[Node], ys: list[Node], by: str) -> tuple[int, int]:
    """How many equal nodes two lists begin and end with: some largest match has these pairs."""
    short, of = min(len(xs), len(ys)), attrgetter(by)
    last = 0
    while last < short and of(xs[-1 - last]) == of(ys[-1 - last]):
        last += 1
    first = 0
    while first < short - last and of(xs[first]) == of(ys[first]):
        first += 1
    return first, last


def _table(sizes: np.ndarray, of_x: np.ndarray, of_y: np.ndarray, full: tuple[np.ndarray, np.ndarray] | None, scale: int = 1, whole: bool = False) -> np.ndarray:
    """Rows (all, or the last) of the table of best matches; a node counts ``scale``, equal texts one."""
    row = np.zeros(len(of_y) + 1, dtype=np.int64)
    rows = [row]
    gains = {kind: sizes[kind, of_y] * scale for kind in set(of_x.tolist())}
    texts = set(full[1].tolist()) if full else ()
    for i, kind in enumerate(of_x.tolist()):
        gain = row[:-1] + gains[kind]
        if texts and (own := int(full[0][i])) in texts:
            gain[full[1] == own] += 1
        new = np.zeros_like(row)
        np.maximum(row[1:], gain, out=new[1:])
        np.maximum.accumulate(new, out=new)
        row = new
        if whole:
            rows.append(row)
    return np.array(rows) if whole else row[None]


def align(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Pairs of nodes in a largest order-keeping match of two trees (simple tree matching)."""
    match = _Match()
    pairs: list[tuple[Node, Node]] = []
    todo = [(a, b)] if a.tag == b.tag else []
    while todo:
        x, y = todo.pop()
        pairs.append((x, y))
        if not x.kids or not y.kids:
            continue
        if x.full == y.full:
            todo.extend(zip(x.kids, y.kids, strict=True))
        elif len(x.kids) == len(y.kids) == 1:
            if x.kids[0].tag == y.kids[0].tag:
                todo.append((x.kids[0], y.kids[0]))
        else:
            todo.extend(match.pairs(x.kids, y.kids))
    return pairs


class Vote(NamedTuple):
    """What one page has at the place of a reference's node. same: it repeats the leaf; like: or most of its words; plain, links: characters there."""

    node: int
    same: int
    like: int
    plain: int
    links: int


def vote(page: Node, reference: Node) -> tuple[bool, list[Vote]]:
    """Whether a page may be a copy of the reference, and its votes on leaves and on parts with elements inside."""
    out, repeated = [], 0
    unmarked = {n.number: len(n.text) for n in _kept(reference, set()) if n.tag == "#"}
    for x, y in align(page, reference):
        if y.tag == "#":
            same = x.text == y.text
            out.append(Vote(y.number, int(same), int(same or _like(x.text, y.text)), x.plain, x.links))
            repeated += unmarked.get(y.number, 0) if same else 0
        elif any(k.tag != "#" for k in y.kids):
            out.append(Vote(y.number, 0, 0, x.plain, x.links))
    return repeated > COPY * sum(unmarked.values()), out


def _like(a: str, b: str) -> bool:
    """Whether two texts have most of their words in common."""
    x, y = set(a.split()), set(b.split())
    return 2 * len(x & y) > max(len(x), len(y))


class Count(NamedTuple):
    """The votes on a node: of pages that are no copies, and of those that may be, how many there are and repeat it."""

    apart: int
    apart_same: int
    near: int
    near_same: int
    like: int
    plain: int
    links: int


class Model:
    """What the pages of a host tell about its reference."""

    def __init__(self, reference: Node, counts: dict[int, Count]) -> None:
        self.reference = reference
        self.template: set[int] = set()
        self.menus: set[int] = set()
        self.region: Node | None = None
        nodes = list(walk(reference))
        here = counts.get(0)
        if here is None:
            return
        # what an article repeats (headings of its sections, notes of a column) is the article's own
        inside = {k.number for n in nodes if n.main for k in walk(n)}
        leaves = [n for n in nodes if n.tag == "#" and n.number in counts and n.number not in inside]
        if here.apart >= VOTES:
            self.template = {n.number for n in leaves if (c := counts[n.number]).apart_same >= max(VOTES, SHARE * here.apart)}
        else:
            pages = here.apart + here.near
            most = {n.number: counts[n.number].apart_same + counts[n.number].near_same for n in leaves}
            if pages < VOTES + 1 or all(counts[n.number].like >= VARIES * pages for n in leaves):
                return
            self.template = {n for n, m in most.items() if m >= CONSTANT * pages}
        # varying text of each part: what the pages have there, without what they repeat
        mass = {n.number: counts[n.number].plain for n in nodes if n.number in counts and n.tag != "#"}
        fixed: dict[int, int] = {}
        for n in reversed(nodes):
            c = counts.get(n.number)
            own = (c.apart_same + c.near_same) * n.plain if c and n.number in self.template else 0
            fixed[n.number] = own + sum(fixed[k.number] for k in n.kids if not k.aside or k.soft)
            if n.number in mass:
                mass[n.number] -= fixed[n.number]
        region = reference
        while not region.main:
            inner = [k for k in region.kids if k.number in mass and (not k.aside or k.soft)]
            best = max(inner, key=lambda k: mass[k.number], default=None)
            if best is None or mass[best.number] <= max(0, MOST * mass[region.number]) or best.tag in TEXT_BLOCKS:
                break
            region = best
        self.region = region
        for n in walk(region):
            if n is not region and n.number in mass and (c := counts[n.number]).links > LINKS * (c.plain + c.links):
                self.menus.add(n.number)


def _kept(page: Node, around: set[int]) -> Iterator[Node]:
    todo = [page]
    while todo:
        node = todo.pop()
        if not node.aside or id(node) in around:
            yield node
            todo.extend(node.kids)


def _around(page: Node) -> set[int]:
    """Ids of nodes that a class, id or form marks as beside the main text though they are around it.

    If no article lies outside such nodes, those that hold one are around it; if there is none, those with most of the text.
    """
    nodes = list(walk(page))
    if not any(n.soft for n in nodes) or any(n.main for n in _kept(page, set())):
        return set()
    holds: dict[int, tuple[bool, int]] = {}
    for node in reversed(nodes):
        below = [holds[id(k)] for k in node.kids if not k.aside or k.soft]
        holds[id(node)] = node.main or any(m for m, _ in below), len(node.text) + sum(n for _, n in below)
    main, total = holds[id(page)]
    return {id(n) for n in nodes if n.soft and (holds[id(n)][0] if main else holds[id(n)][1] > AROUND * total)}


def content(page: Node, model: Model | None = None) -> str:
    """The main text: texts of the region that are neither template nor menus nor beside the article, one to a line."""
    gone: set[int] = set()
    region = page
    if model and model.region:
        for x, y in align(page, model.reference):
            if y is model.region:
                region = x
            if y.number in model.menus or y.number in model.template and x.text == y.text:
                gone.add(id(x))
    around = _around(region) | {id(region)}
    kept = list(_kept(region, around))
    # marked articles hold the main text, unless they are small beside the region that was learned
    inside = [n for n in kept if n.main]
    if region is not page and 2 * sum(n.plain for n in inside) < region.plain:
        inside = []
    out: list[str] = []
    todo = [(region, not inside)]
    while todo:
        node, on = todo.pop()
        if id(node) in gone or node.aside and id(node) not in around:
            continue
        on = on or node.main
        if node.tag == "#" and on:
            out.append(node.text)
        todo.extend((k, on) for k in reversed(node.kids))
    return "\n".join(out)


def extract(pages: DataFrame, broadcast_bytes: int = 32 << 20, induce: bool = True) -> DataFrame:
    """page_id, url, text and n_chars of every page.

    Pages are grouped by host and layout (which of LAYOUT_TAGS they use). The reference of a group is a page of its own:
    of those with an end tag of html, else of those with any text, the one of least hash. Every page of the group votes on
    the reference's nodes; pages with equal unmarked text are copies and have one vote. Reference pages are broadcast if
    all of them together have at most ``broadcast_bytes`` (they are measured first); else they are joined by host and
    layout, where Spark splits hot hosts. Votes are summed up before they are shuffled by node.

    A block's text has its character references decoded, white space turned into single spaces and its ends trimmed. A
    br is white space. If too few pages have voted, or a page has no place that is aligned to the region, marks alone
    decide: if elements article or main (or such roles) are there, they hold the main text, and what an element name, a
    class or a role marks as beside it goes. ``induce=False`` lets them decide everywhere.

    Null html is empty and gives an empty text. A null or bad url makes a page of the host "". Pages of any length are
    read whole, however deep or long their lists are; cut-off and wrongly nested pages give what they hold. Repeated rows
    are extracted each, an empty table gives no rows, and other columns are ignored.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").alias("url"), F.coalesce(F.col("html"), F.lit("")).alias("html"))
    host = F.coalesce(F.lower(F.try_parse_url(F.col("url"), F.lit("HOST"))), F.lit(""))
    rows = rows.withColumn("layout", F.concat_ws(" ", host, *[F.when(F.contains("html", F.lit(f"<{t}")), t) for t in LAYOUT_TAGS]))
    chosen = rows.groupBy("layout").agg(
        F.min(F.struct(~F.rtrim("html").endswith("</html>"), F.length("html") == 0, F.xxhash64("page_id", "url").alias("h"), F.xxhash64("html").alias("x"))).alias("c"),
        F.max(F.octet_length("html")).alias("n"),
    )
    total = chosen.agg(F.sum("n")).first()[0] or 0
    small = F.broadcast if total <= broadcast_bytes else lambda df: df
    chosen = chosen.select(F.col("layout").alias("of"), "c.h", "c.x")
    same = (F.col("layout") == F.col("of")) & (F.xxhash64("page_id", "url") == F.col("h")) & (F.xxhash64("html") == F.col("x"))
    references = rows.join(small(chosen), same).groupBy("of").agg(F.min("html").alias("reference"))

    def voted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = lru_cache(TREES)(parse)
        for batch in batches:
            nears, ids, votes, ends = [], [], [], [0]
            for source, reference in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                page = parse(source)
                near, found = vote(page, tree(reference))
                nears.append(near)
                ids.append(xxhash.xxh64_intdigest("\n".join(n.text for n in _kept(page, set()) if n.tag == "#")) >> 1)
                votes += found
                ends.append(len(votes))
            columns = np.array(votes, dtype=np.int32).reshape(-1, len(Vote._fields)).T
            each = pa.StructArray.from_arrays([pa.array(c) for c in columns], list(Vote._fields))
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.int64()), pa.array(nears, pa.bool_()), lists], ["layout", "page", "near", "votes"])

    def cut_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        models: dict[str, Model] = {}
        for batch in batches:
            texts = []
            for layout, source, reference, counts in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if reference and layout not in models:
                    if len(models) >= TREES:
                        models.clear()
                    models[layout] = Model(parse(reference), {c.pop("node"): Count(**c) for c in counts})
                texts.append(content(parse(source), models[layout] if reference else None))
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    wanted = ["page_id", "url", "layout", "html", "reference", "counts"]
    kind = "array<struct<node:int,apart:int,apart_same:int,near:int,near_same:int,like:int,plain:bigint,links:bigint>>"
    if not induce:
        plain = rows.withColumns({"reference": F.lit(None).cast("string"), "counts": F.lit(None).cast(kind)})
        return plain.select(*wanted).mapInArrow(cut_out, "page_id long, url string, text string, n_chars long")
    votes = rows.join(small(references), F.col("layout") == F.col("of")).select("layout", "html", "reference").mapInArrow(voted, "layout string, page long, near boolean, votes array<struct<node:int,same:int,like:int,plain:int,links:int>>")
    once = votes.groupBy("layout", "page").agg(F.min(F.struct("near", "votes")).alias("v")).select("layout", "v.near", F.inline("v.votes"))
    near = F.col("near").cast("int")
    summed = once.groupBy("layout", "node").agg(
        *[F.sum(c).alias(n) for c, n in ((1 - near, "apart"), ((1 - near) * F.col("same"), "apart_same"), (near, "near"), (near * F.col("same"), "near_same"), (F.col("like"), "like"), (F.col("plain"), "plain"), (F.col("links"), "links"))]
    )
    models = summed.groupBy("layout").agg(F.collect_list(F.struct(*[F.col(c).cast("int").alias(c) for c in ("node", "apart", "apart_same", "near", "near_same", "like")], "plain", "links")).alias("counts"))
    models = references.join(models.withColumnRenamed("layout", "m_layout"), F.col("of") == F.col("m_layout")).select("of", "reference", "counts")
    whole = rows.join(small(models), F.col("layout") == F.col("of"), "left")
    return whole.select(*wanted).mapInArrow(cut_out, "page_id long, url string, text string, n_chars long")
