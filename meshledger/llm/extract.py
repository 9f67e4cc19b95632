"""Main text of web pages by wrapper induction.

A page becomes a small tree of block elements with text leaves; menus, forms, scripts and other parts that their
element, their role or their name (adverts, notices, comments, related boxes) tells as furniture are left out, unless they
alone hold the page's article or main element. Any other class name or id made of furniture words alone is a vote: it counts
if most pages of the host have the element, and never against one that holds an article or main element. A leaf has places in the tree (see ``leaf_keys``). A text
that stands at one place of most of a host's pages of different content is template; all else is content. No page
is a reference for the others: the counts behind that verdict are summed in Spark over all pages, so a first page
that is empty or laid out in another way changes nothing, and a host of any size costs a row for each place and text.

Defined results: a null or empty page gives an empty text; a page without host is read without a wrapper; if every
leaf of a page is template, nothing told it apart and its leaves are kept; repeated rows are extracted alike;
malformed, unclosed or cut markup is read as far as it goes; an empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from hashlib import blake2b
from html.parser import HTMLParser
from zlib import crc32

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meshledger.llm.shared import few_rows, stage, table

#: A leaf is template if its text has this share of a host's different pages with its place, of this many at least.
CONSTANT_SHARE, LEAST_PAGES = 0.6, 4
#: Texts of so many words or characters count wherever they stand under one path of tags.
LONG_WORDS, LONG_CHARS = 4, 24
#: Pages in an Arrow batch.
PAGES = 256
#: Wrappers of all hosts up to this many bytes are broadcast; more are joined, each host cut into SALTS.
BROADCAST_BYTES, SALTS = 16 << 20, 16

#: Elements without content of their own, furniture, elements inside a line, elements that end a sibling.
EMPTY = set("area base br col embed hr img input link meta param source track wbr".split())
FURNITURE = set("head script style noscript template iframe svg canvas object nav footer aside form button select "
                "textarea dialog menu audio video map".split())
#: Of these, no text or element inside is ever looked at.
SILENT = set("head script style noscript template iframe svg canvas object select textarea button audio video map".split())
INLINE = set("a abbr b bdi bdo big cite code data del dfn em font i ins kbd label mark q ruby rt s samp small span "
             "strike strong sub sup time tt u var".split())
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
        "th": {"td", "th"}, "option": {"option"}}
KEEPS_PARAGRAPH = INLINE | EMPTY
#: Words of class names and ids, and roles, that name furniture.
NAMES = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar menu "
            "nav navbar navigation breadcrumb breadcrumbs footer header masthead cookie cookies consent notice notices "
            "alert popup modal overlay newsletter subscribe signup login comment comments reply replies disqus respond "
            "share sharing social related recommended recommendations widget toolbar pagination pager search copyright "
            "disclaimer legal hidden".split())
#: Of these, names that tell what is no part of the article on whichever page they stand.
SURE = set("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent "
           "notice notices popup overlay newsletter subscribe sidebar comment comments reply replies disqus respond related "
           "recommended recommendations".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """An element with its child nodes; a leaf (tag None) has a text and the share of it inside links."""

    __slots__ = ("tag", "children", "text", "linked", "shape", "main", "name", "lost", "sure")

    def __init__(self, tag: str | None, text: str = "", linked: int = 0, main: bool = False):
        self.tag, self.text, self.linked, self.main = tag, text, linked, main
        self.children: list[Node] = []
        self.shape = self.name = ""
        self.lost = self.sure = False

    def leaves(self) -> Iterator[Node]:
        todo = [self]
        while todo:
            node = todo.pop()
            if node.tag is None:
                yield node
            todo.extend(reversed(node.children))

    def seal(self) -> None:
        """Give every node its shape, equal for equal trees of tags."""
        order, todo = [], [self]
        while todo:
            node = todo.pop()
            order.append(node)
            todo.extend(node.children)
        for node in reversed(order):
            node.shape = node.tag and f"{node.tag}{hash(tuple(child.shape for child in node.children)):x}" or "#"


class _Reader(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("html")
        self.open: list[tuple[str, Node | None]] = [("html", self.root)]
        self.words: list[str] = []
        self.links = self.linked = self.lost = 0

    def flush(self) -> None:
        text = " ".join("".join(self.words).split())
        if text:
            home = next(node for _, node in reversed(self.open) if node is not None)
            home.children.append(Node(None, text, self.linked))
        self.words, self.linked = [], 0

    def handle_data(self, data: str) -> None:
        if not self.lost:
            self.words.append(data)
            if self.links:
                self.linked += len("".join(data.split()))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in EMPTY:
            if tag in ("br", "wbr"):
                self.words.append(" " if tag == "br" else "")
            elif tag == "hr":
                self.flush()
            return
        if tag in INLINE:
            self.links += tag == "a"
            if _furniture(tag, dict(attrs), False):
                self.lost += 1
                self.open.append((tag, None))
            return
        attributes = dict(attrs)
        if tag == "body" and not self.lost:
            return
        self.flush()
        if tag not in KEEPS_PARAGRAPH:
            self._end({"p"}, {"article", "section", "div", "td", "li", "blockquote"})
        if tag in ENDS:
            self._end(ENDS[tag], {"ul", "ol", "dl", "table"})
        inside = any(name in ("article", "main") for name, _ in self.open)
        if self.lost or tag in SILENT:
            self.lost += 1
            self.open.append((tag, None))
            return
        home = next(node for _, node in reversed(self.open) if node is not None)
        node = Node(tag, main=tag == "main" or attributes.get("role") == "main")
        node.sure = _named_furniture(tag, attributes)
        node.lost = node.sure or _furniture(tag, attributes, inside)
        if tag == "article" or node.main:
            for _, around in self.open:
                if around is not None:
                    around.name = ""
                    around.lost &= around.tag != "form"  # a form may wrap a whole page
        else:
            node.name = _name(tag, attributes)
        home.children.append(node)
        self.open.append((tag, node))

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in EMPTY:
            self.handle_endtag(tag)

    def _close(self, count: int) -> None:
        for _ in range(count):
            _, node = self.open.pop()
            self.lost -= node is None

    def _end(self, tags: set[str], walls: set[str]) -> None:
        """Close the nearest open element of ``tags``, if no wall lies between."""
        for depth, (name, _) in enumerate(reversed(self.open)):
            if name in tags:
                self.flush()
                self._close(depth + 1)
                return
            if name in walls or name == "html":
                return

    def handle_endtag(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a":
                self.links = max(0, self.links - 1)
            if not (self.open[-1][0] == tag and self.open[-1][1] is None):
                return
        elif tag in EMPTY or tag in ("html", "body"):
            return
        for depth, (name, _) in enumerate(reversed(self.open[1:])):
            if name == tag:
                self.flush()
                self._close(depth + 1)
                return
        self.flush()


def _furniture(tag: str, attrs: dict, inside: bool) -> bool:
    if tag in FURNITURE or (tag == "header" and not inside) or "hidden" in attrs:
        return True
    if attrs.get("role") in ROLES or attrs.get("aria-hidden") == "true":
        return True
    if re.search(r"display\s*:\s*none", attrs.get("style") or ""):
        return True
    return False


def _names(attrs: dict) -> Iterator[tuple[str, set[str]]]:
    """The class names and the id that are made of furniture words alone, and their words."""
    for named in f"{attrs.get('class') or ''} {attrs.get('id') or ''}".split():
        parts = {part.lower() for part in _PARTS.findall(named)}
        if parts and parts <= NAMES:
            yield named, parts


def _name(tag: str, attrs: dict) -> str:
    """A name that votes for furniture, if any."""
    if tag in ("html", "body", "main", "article", "h1", "h2"):
        return ""
    return next((named for named, _ in _names(attrs)), "")


def _named_furniture(tag: str, attrs: dict) -> bool:
    """An advert, notice, comment or related box by its name, an article too: comments often are articles."""
    return tag not in ("html", "body", "main", "h1", "h2") and any(words & SURE for _, words in _names(attrs))


def _tops(root: Node, wanted: Callable[[Node], bool], lost: bool) -> list[Node]:
    """Outermost wanted elements with a text, those in furniture only if ``lost``."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if node.lost and not lost:
            continue
        if wanted(node) and _has_text(node):
            found.append(node)
        else:
            todo.extend(reversed(node.children))
    return found


def _has_text(root: Node) -> bool:
    todo = [root]
    while todo:
        node = todo.pop()
        if node.tag is None:
            return True
        todo.extend(child for child in node.children if not child.lost)
    return False


def _kept(root: Node) -> Node:
    """The tree without the furniture in it; the root itself stays."""
    todo = [root]
    while todo:
        node = todo.pop()
        node.children = [child for child in node.children if not child.lost]
        todo.extend(node.children)
    return root


def read_tree(html: str | None) -> Node:
    """The part of a page that may hold its main text: all outermost articles, else all main elements, else all."""
    reader = _Reader()
    reader.feed(html or "")
    reader.close()
    reader.flush()
    root = reader.root
    for lost in (False, True):
        for wanted in (lambda node: node.tag == "article" and not node.sure, lambda node: node.main):
            tops = [_kept(node) for node in _tops(root, wanted, lost)]
            if tops:
                whole = Node(tops[0].tag)
                whole.children = [child for top in tops for child in top.children]
                return whole
    todo = [_kept(root)]
    while todo:  # without any marked area, blocks made of links are furniture
        node = todo.pop()
        node.children = [child for child in node.children
                         if child.tag or child.linked <= 0.5 * len("".join(child.text.split()))]
        todo.extend(node.children)
    return root


def match(one: Node, other: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the largest order-keeping matching of equal tags, and its pairs of leaves.

    Equal shapes at either end of two child lists are matched first; that is never worse, and lists of alike
    blocks then need no table."""
    if one.tag != other.tag:
        return 0, []
    for node in (one, other):
        if not node.shape:
            node.seal()
    left, right = one.children, other.children
    total, head, tail = 1, [], []
    if one.tag is None:
        return 1, [(one, other)]
    i, j, m, n = 0, 0, len(left), len(right)
    while i < m and j < n and left[i].shape == right[j].shape:
        count, pairs = match(left[i], right[j])
        total, i, j = total + count, i + 1, j + 1
        head += pairs
    while i < m and j < n and left[m - 1].shape == right[n - 1].shape:
        count, pairs = match(left[m - 1], right[n - 1])
        total, m, n = total + count, m - 1, n - 1
        tail = pairs + tail
    if i == m or j == n:
        return total, head + tail
    memory: dict[tuple[str, str], int] = {}
    best = [[0] * (n - j + 1) for _ in range(m - i + 1)]
    for a in range(m - 1, i - 1, -1):
        for b in range(n - 1, j - 1, -1):
            key = left[a].shape, right[b].shape
            if key not in memory:
                memory[key] = match(left[a], right[b])[0]
            best[a - i][b - j] = max(best[a - i + 1][b - j], best[a - i][b - j + 1],
                                     best[a - i + 1][b - j + 1] + memory[key])
    a, b, middle = i, j, []
    while a < m and b < n:
        here = best[a - i][b - j]
        if here == best[a - i + 1][b - j]:
            a += 1
        elif here == best[a - i][b - j + 1]:
            b += 1
        else:
            middle += match(left[a], right[b])[1]
            a, b = a + 1, b + 1
    return total + best[0][0], head + middle + tail


_MASK = (1 << 64) - 1


def _mix(place: int, *parts: int) -> int:
    for part in parts:
        place = ((place ^ part) * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) & _MASK
        place ^= place >> 29
    return place


def _hash(text: str) -> int:
    return int.from_bytes(blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def _signed(place: int) -> int:
    return place - (1 << 64) if place >> 63 else place


def leaf_keys(tree: Node) -> tuple[int, list[tuple[Node, list[tuple[int, int]]]]]:
    """The place of the root, and each leaf with the (place, text) pairs that may make it template.

    The place of a long text is its path of tags; that of a short one, which may well be repeated by chance, is the
    path with the number of each element among its like, from the front and from the back. An element that is named
    as furniture is a pair of the root's place and its path and name."""
    root = _mix(1, crc32((tree.tag or "").encode()))
    found, todo = [], [(tree, root, root, root, ())]
    while todo:
        node, path, front, back, names = todo.pop()
        if node.tag is None:
            text = _hash(node.text)
            long = len(node.text) >= LONG_CHARS or node.text.count(" ") + 1 >= LONG_WORDS
            keys = [(_signed(path), text)] if long else [(_signed(_mix(front, 2)), text), (_signed(_mix(back, 3)), text)]
            found.append((node, keys + [(_signed(root), name) for name in names]))
            continue
        like: dict[str | None, int] = {}
        for child in node.children:
            like[child.tag] = like.get(child.tag, 0) + 1
        seen: dict[str | None, int] = {}
        below = []
        for child in node.children:
            at = seen[child.tag] = seen.get(child.tag, 0) + 1
            tag, left = crc32((child.tag or "").encode()), like[child.tag] - at
            inner = _mix(path, tag) if child.tag else path
            named = (*names, _signed(_mix(inner, 4, crc32(child.name.encode())))) if child.name else names
            below.append((child, inner, _mix(front, tag, at), _mix(back, tag, left), named))
        todo.extend(reversed(below))
    return _signed(root), found


def _counted(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(host, place, text, content): each text at each place of a page, and each place without a text; content tells
    different pages apart."""
    for frame in frames:
        rows = []
        for host, html in zip(frame["host"], frame["html"]):
            root, leaves = leaf_keys(read_tree(html))
            if leaves:
                content = _hash("\n".join(leaf.text for leaf, _ in leaves))
                pairs = {pair for _, keys in leaves for pair in keys}
                rows += [(host, place, text, content) for place, text in pairs]
                rows += [(host, place, None, content) for place in {place for place, _ in pairs} | {root}]
        yield pd.DataFrame({"host": [row[0] for row in rows], "place": [row[1] for row in rows],
                            "text": pd.array([row[2] for row in rows], "Int64"), "content": [row[3] for row in rows]})


def _main_text(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    last, fixed = None, frozenset()
    for frame in frames:
        out = []
        for host, html, template in zip(frame["host"], frame["html"], frame["template"]):
            tree = read_tree(html)
            if template is None or not len(template):
                leaves = list(tree.leaves())
            else:
                if host != last:
                    last, fixed = host, frozenset((pair["place"], pair["text"]) for pair in template)
                found = leaf_keys(tree)[1]
                leaves = [leaf for leaf, keys in found if fixed.isdisjoint(keys)] or [leaf for leaf, _ in found]
            out.append("\n".join(leaf.text for leaf in leaves))
        yield pd.DataFrame({"page_id": frame["page_id"], "url": frame["url"], "text": out,
                            "n_chars": [len(text) for text in out]})


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of (page_id, url, html)."""
    host = F.nullif(F.lower(F.regexp_extract("url", r"^[^:/?#]+://(?:[^/?#@]*@)?([^/:?#]+)", 1)), F.lit(""))
    pages = pages.select("page_id", "url", "html", host.alias("host"))
    counted_places = (pages.filter("host IS NOT NULL AND html IS NOT NULL").select("host", "html")
                      .mapInPandas(_counted, "host string, place long, text long, content long")
                      .distinct().groupBy("host", "place", "text").count())
    # Both sides of the join read the counts; few rows are left of them.
    counted = few_rows(lambda: counted_places.filter(F.col("count") >= math.ceil(CONSTANT_SHARE * LEAST_PAGES)), pages.sparkSession, PAGES)
    of_place = (counted.filter(F.col("text").isNull() & (F.col("count") >= LEAST_PAGES))
                .select("host", "place", F.col("count").alias("pages")))
    template = (counted.filter("text IS NOT NULL").join(of_place, ["host", "place"])
                .filter(F.col("count") >= CONSTANT_SHARE * F.col("pages")))
    wrapper = stage(template.groupBy("host").agg(F.collect_list(F.struct("place", "text")).alias("template")))
    entries = wrapper.agg(F.sum(16 * F.size("template") + F.octet_length("host"))).collect()[0][0] or 0
    if entries <= BROADCAST_BYTES:
        joined = pages.join(F.broadcast(wrapper), "host", "left")
    else:
        cut = pages.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)))
        side = wrapper.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        joined = cut.join(side, ["host", "salt"], "left")
    return few_rows(lambda: joined.select("page_id", "url", "host", "html", "template")
                    .mapInPandas(_main_text, "page_id long, url string, text string, n_chars long"), pages.sparkSession, PAGES)


def op7_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))
