"""Main text of web pages by wrapper induction.

Pages of a host are aligned by simple tree matching. Text that stays the same at aligned places is
template; the places where it varies span the part of the page that holds the article. The wrapper
of a host, that part's path and the template's text, is then applied to every page of the host.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clickspark.llm.storage import broadcast_if_small, materialise

# -- fixed values: what HTML's elements are ----------------------------------------------------------
BLOCKS = frozenset("""address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p
    pre search section summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
UNSEEN = frozenset("""audio button canvas datalist form head iframe math menu nav noembed noframes noscript object script
    select style svg template textarea title video xmp aside footer dialog search""".split())
#: Open elements that a start tag ends (the new tag: those it ends, up to the elements that shield them).
ENDS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
        "option": ("option",), "optgroup": ("option", "optgroup")}
SHIELDS = frozenset("ul ol dl table select menu div section article main body td th".split())
HEADINGS = frozenset(("h1", "h2"))
# words in class, id and role that name a page's furniture
FURNITURE = frozenset("""ad ads adv advert adverts advertisement advertising alert banner breadcrumb breadcrumbs comment comments
    complementary consent contentinfo cookie cookies copyright dialog disclaimer disqus footer gdpr login masthead menu modal nav navbar
    navigation newsletter notice notices notification pager pagination popup promo promoted promotion recommended related
    replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe subscription teaser toolbar
    topbar widget""".split())

#: First and last parts of names that tell of a page's state, not of what the element is ("has-sidebar", "comments-open").
STATES = (frozenset("has no with without".split()), frozenset("open closed enabled disabled".split()))

_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?(?=[\s/"']|$)""", re.I)
_NAMES = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_TITLE = re.compile(r"<title(?=[\s>])[^>]*>([^<]*)", re.I)
_DEPTH = 150
CONTAINERS = frozenset("div section article main header footer aside nav form".split())
_LAYOUT_DEPTH = 6
#: Characters from which a text says something about the place it stands at.
LONG = 40
#: Pairs of children whose table of sums is kept whole; larger tables are halved and computed again.
_CELLS = 250_000


# -- pages as trees of blocks ------------------------------------------------------------------------

class Node:
    """A block element; ``children`` are nodes and strings, the texts of its blocks."""

    __slots__ = ("key", "tag", "unseen", "named", "children")

    def __init__(self, tag: str, key: str, unseen: bool, named: bool = False):
        # named: unseen only for its names or as a form
        self.tag, self.key, self.unseen, self.named, self.children = tag, key, unseen, named, []


def _describe(tag: str, attributes: str, in_article: bool) -> tuple[str, bool, bool]:
    """(key for alignment, whether the element and all below it is furniture, whether it is so by its names or as a form)."""
    names: list[str] = []
    telling: list[str] = []
    unseen = tag in UNSEEN and tag != "form" or tag == "header" and not in_article
    if attributes:
        for name, value in _ATTRIBUTE.findall(attributes):
            name, value = name.lower(), value.strip("\"'")
            if name == "hidden" or name == "aria-hidden" and value.lower() == "true":
                unseen = True
            elif name == "style":
                unseen |= bool(re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I))
            elif name in ("class", "id", "role"):
                for token in value.split():
                    parts = [w.lower() for w in _NAMES.findall(token)]
                    names += parts
                    if parts and parts[0] not in STATES[0] and parts[-1] not in STATES[1]:
                        telling += parts
    named = tag == "form"
    if names and tag not in ("html", "body", "article", "main"):
        named |= not FURNITURE.isdisjoint(telling)
    elif tag == "article":
        named |= not {"comment", "comments", "reply", "related", "teaser", "promo"}.isdisjoint(telling)
    return (f"{tag}.{names[0]}" if names else tag), unseen or named, named and not unseen


def parse(page: str | None) -> Node:
    """Tree of the block elements of a page. Inline elements vanish, their text stays in the block;
    character references are decoded, white space is one space. Elements deeper than 150 levels are
    put under their ancestor of that level."""
    text, at, end = page or "", 0, len(page or "")
    root = Node("#", "#", False)
    stack, held = [root], []

    def flush() -> None:
        if held:
            words = entities.unescape("".join(held)).split()
            held.clear()
            if words:
                stack[-1].children.append(" ".join(words))

    while at < end:
        mark = text.find("<", at)
        if mark < 0:
            held.append(text[at:])
            break
        if mark > at:
            held.append(text[at:mark])
        follows = text[mark + 1:mark + 2]
        if follows in ("!", "?"):
            if text.startswith("<!--", mark):
                close = text.find("-->", mark + 2)
                at = end if close < 0 else close + 3
            else:
                close = text.find(">", mark)
                at = end if close < 0 else close + 1
            continue
        tag = _TAG.match(text, mark)
        if not tag:
            if not (follows.isascii() and follows.isalpha() or follows == "/"):
                held.append("<")
                at = mark + 1
                continue
            close = text.find(">", mark)
            at = end if close < 0 else close + 1
            continue
        at = tag.end()
        closing, name, attributes = tag[1], tag[2].lower(), tag[3]
        if closing:
            if name == "p" and all(n.tag != "p" for n in stack) or name == "br":
                flush()
            elif name in BLOCKS or name in UNSEEN:
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag == name:
                        flush()
                        del stack[i:]
                        break
            continue
        if name in RAW:
            shut = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(text, at)
            at = shut.end() if shut else end
            if name == "title":
                flush()
            continue
        if name not in BLOCKS and name not in UNSEEN:
            continue
        flush()
        if name in VOID:
            continue
        if name in BLOCKS and stack[-1].tag == "p":
            stack.pop()
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in ENDS.get(name, ()):
                del stack[i:]
                break
            if stack[i].tag in SHIELDS:
                break
        key, unseen, named = _describe(name, attributes, any(n.tag in ("article", "main") for n in stack))
        node = Node(name, key, unseen, named)
        stack[-1].children.append(node)
        if len(stack) < _DEPTH and (name in BLOCKS or not attributes.rstrip().endswith("/")):
            stack.append(node)
    flush()
    _restore(root)
    return root


def _restore(root: Node) -> None:
    """Names are no reason to leave out what holds most of the page's text, unless a heading, article
    or main element stands before it: that is the article, and what follows are its comments."""
    sizes: dict[int, int] = {}

    def measure(node: Node) -> int:
        sizes[id(node)] = n = sum(len(c) if isinstance(c, str) else measure(c) if c.named or not c.unseen else 0 for c in node.children)
        return n
    total, before = measure(root), False

    def walk(node: Node) -> None:
        nonlocal before
        for child in node.children:
            if isinstance(child, Node):
                if child.named and not before and sizes[id(child)] * 2 > total:
                    child.unseen = False
                if not child.unseen:
                    before |= child.tag in ("article", "main") or child.tag in HEADINGS
                    walk(child)
    walk(root)


def texts(node: Node, path: tuple[str, ...] = ()) -> Iterator[tuple[tuple[str, ...], str]]:
    """(path, text) of the blocks below ``node`` that are not furniture, in page order."""
    path = (*path, node.key)
    for child in node.children:
        if isinstance(child, str):
            yield path, child
        elif not child.unseen:
            yield from texts(child, path)


# -- simple tree matching ----------------------------------------------------------------------------

def _same(a: Node | str, b: Node | str) -> bool:
    if isinstance(a, str) or isinstance(b, str):
        return a == b
    return a.key == b.key and a.unseen == b.unseen and len(a.children) == len(b.children) and all(map(_same, a.children, b.children))


class _Shapes:
    """Numbers of trees that differ in more than their texts, and the largest matchings between them.

    Any two texts match, so what two trees match depends on their shapes alone, and pages have few shapes.
    Shape 0 is a text, shape -1 an element that matches nothing.
    """

    def __init__(self):
        self.numbers: dict[tuple, int] = {}
        self.parts: list[tuple] = [()]
        self.of: dict[int, int] = {}
        self.scores: dict[tuple[int, int], int] = {}

    def number(self, node: Node | str) -> int:
        if isinstance(node, str):
            return 0
        if node.unseen:
            return -1
        if id(node) not in self.of:
            shape = node.key, tuple([self.number(c) for c in node.children])
            if shape not in self.numbers:
                self.numbers[shape] = len(self.parts)
                self.parts.append(shape)
            self.of[id(node)] = self.numbers[shape]
        return self.of[id(node)]

    def score(self, a: int, b: int) -> int:
        """Matched nodes and texts of the largest matching that keeps order and ancestry."""
        if a < 1 or b < 1:
            return int(a == b == 0)
        if (a, b) not in self.scores:
            (key, x), (other, y) = self.parts[a], self.parts[b]
            if key != other:
                found = 0
            elif not any(x) and not any(y):
                found = 1 + min(len(x), len(y))
            else:
                found = 1 + int(self.sums(x, y)[-1])
            self.scores[a, b] = found
        return self.scores[a, b]

    def rows(self, x: tuple[int, ...], y: tuple[int, ...]) -> Iterator[np.ndarray]:
        """Largest sums of the first 0, 1, ... of ``x`` against every head of ``y``."""
        kinds, place = np.unique(np.array(y, dtype=np.int64), return_inverse=True)
        known: dict[int, np.ndarray] = {}
        row = np.zeros(len(y) + 1, dtype=np.int64)
        yield row
        for a in x:
            if a not in known:
                known[a] = np.array([self.score(a, int(b)) for b in kinds], dtype=np.int64)[place]
            best = row.copy()
            np.maximum(row[1:], row[:-1] + known[a], out=best[1:])
            row = np.maximum.accumulate(best)
            yield row

    def sums(self, x: tuple[int, ...], y: tuple[int, ...]) -> np.ndarray:
        row = np.zeros(1)
        for row in self.rows(x, y):
            pass
        return row

    def partners(self, x: tuple[int, ...], y: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places that a largest matching pairs, in rising order."""
        if not x or not y:
            return []
        if len(x) > 1 and len(x) * len(y) > _CELLS:
            # halve x: the cut of y where the best sums of both halves add up to the most
            half = len(x) // 2
            cut = int(np.argmax(self.sums(x[:half], y) + self.sums(x[:half - 1:-1], y[::-1])[::-1]))
            return self.partners(x[:half], y[:cut]) + [(half + i, cut + j) for i, j in self.partners(x[half:], y[cut:])]
        best, found = list(self.rows(x, y)), []
        i, j = len(x), len(y)
        while i and j:
            worth = self.score(x[i - 1], y[j - 1])
            if worth and best[i][j] == best[i - 1][j - 1] + worth:
                i, j = i - 1, j - 1
                found.append((i, j))
            elif best[i][j] == best[i - 1][j]:
                i -= 1
            else:
                j -= 1
        return found[::-1]


def _pairs(a: Node | str, b: Node | str, shapes: _Shapes) -> Iterator[tuple[Node | str, Node | str]]:
    """The matched pairs of two trees whose roots match; a node stands before what is below it, a text's place is
    that of the node before it."""
    yield a, b
    if isinstance(a, str):
        return
    x, y = a.children, b.children
    if all(isinstance(c, str) for c in (*x, *y)):
        yield from zip(x, y, strict=False)
        return
    head = tail = 0
    if len(x) * len(y) > _CELLS:
        # equal children at both ends are partners in a largest matching
        most = min(len(x), len(y))
        head = next((i for i in range(most) if not _same(x[i], y[i])), most)
        tail = next((i for i in range(most - head) if not _same(x[-1 - i], y[-1 - i])), most - head)
    inner = shapes.partners(tuple(shapes.number(c) for c in x[head:len(x) - tail]), tuple(shapes.number(c) for c in y[head:len(y) - tail]))
    ends = len(x) - tail, len(y) - tail
    matched = [*((i, i) for i in range(head)), *((head + i, head + j) for i, j in inner), *((ends[0] + i, ends[1] + i) for i in range(tail))]
    matched = [(x[i], y[j]) for i, j in matched if shapes.score(shapes.number(x[i]), shapes.number(y[j]))]
    # texts first, while the node above them is the one last named
    yield from ((c, d) for c, d in matched if isinstance(c, str))
    for c, d in matched:
        if not isinstance(c, str):
            yield from _pairs(c, d, shapes)


def align(a: Node, b: Node) -> list[tuple[Node | str, Node | str]]:
    """Pairs of nodes and of texts that simple tree matching aligns, however many children they have."""
    shapes = _Shapes()
    return list(_pairs(a, b, shapes)) if shapes.score(shapes.number(a), shapes.number(b)) else []


# -- wrappers ----------------------------------------------------------------------------------------

def mark_of(path: tuple[str, ...], text: str) -> int:
    """A signed 64-bit name for a text at a path."""
    return int.from_bytes(hashlib.blake2b("\x00".join((*path, text)).encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True)


def _common(paths: list[tuple[str, ...]]) -> tuple[str, ...]:
    low, high = min(paths), max(paths)
    n = 0
    while n < min(len(low), len(high)) and low[n] == high[n]:
        n += 1
    return low[:n]


def article_root(varying: list[tuple[str, ...]]) -> tuple[str, ...]:
    """The lowest element that holds the blocks at these paths."""
    common = _common(varying)
    # a block's own element is no container
    return common if len(varying) > 1 and common not in varying else common[:-1]


def identity(page: str | None, blocks: list) -> tuple | None:
    """Title and visible headings of a page, by which versions of one article are known; None without a heading."""
    headings = tuple(t for p, t in blocks if p[-1].split(".")[0] in HEADINGS)
    title = _TITLE.search(page or "")
    return (title[1].strip() if title else "", headings) if headings else None


def _copies(name: tuple | None, long: Counter, rare: Counter, other: tuple | None, other_long: Counter, other_rare: Counter) -> bool:
    """Whether two pages are copies: they share more than half of the long texts that are rare on the
    host, or of all long texts under the same title and headings."""
    shares = lambda a, b: sum((a & b).values()) * 2 > max(1, min(sum(a.values()), sum(b.values())))
    return shares(rare, other_rare) or name is not None and name == other and shares(long, other_long)


def induce(pages: list[str | None], agree: float = 0.6, fewest: int = 2) -> tuple[str | None, list[int]]:
    """(path of the article's element, marks of the template) from sample pages of one host.

    Every page is aligned with the first one. Copies of a page taken before say nothing about the
    template, so they are left out (:func:`_copies`); what stands on most pages of the host is no sign
    of a copy by itself. A text is template if it agrees with its partner in ``agree`` of at least
    ``fewest`` - 1 alignments; the other aligned texts and all texts without a partner vary. The
    article's element is the lowest one that holds all varying texts of 40 characters or more and all
    varying headings, as most pages see it. Fewer than two different pages give no wrapper.
    """
    read = []
    for page in dict.fromkeys(pages):
        tree = parse(page)
        read.append((tree, list(texts(tree)), page))
    stands = Counter(entry for _, blocks, _ in read for entry in set(blocks))
    taken: list[tuple[Node, list]] = []
    seen: list[tuple] = []
    for tree, blocks, page in read:
        name = identity(page, blocks)
        long = Counter(t for _, t in blocks if len(t) >= LONG)
        rare = Counter(t for p, t in blocks if len(t) >= LONG and stands[p, t] < agree * len(read))
        if not any(_copies(name, long, rare, *other) for other in seen):
            taken.append((tree, blocks))
            seen.append((name, long, rare))
    if len(taken) < 2:
        return None, []
    pivot, pivot_blocks = taken[0]
    same: Counter = Counter()
    for tree, _ in taken[1:]:
        at: dict[int, tuple[str, ...]] = {}

        def note(node: Node, path: tuple[str, ...], at: dict = at) -> None:
            at[id(node)] = (*path, node.key)
            for c in node.children:
                if isinstance(c, Node):
                    note(c, at[id(node)])
        note(pivot, ())
        inside: tuple[str, ...] = ()
        agreed = set()
        for a, b in align(pivot, tree):
            if isinstance(a, Node):
                inside = at[id(a)]
            elif a == b:
                agreed.add((inside, a))
        same.update(agreed)
    template = {entry for entry, n in same.items() if len(taken) >= fewest and n >= agree * (len(taken) - 1)}
    roots: Counter = Counter()
    for _, blocks in taken:
        varying = [p for p, t in blocks if (p, t) not in template and (len(t) >= 40 or p[-1].split(".")[0] in HEADINGS)]
        if varying:
            roots[article_root(varying)] += 1
    if not roots:
        return None, sorted(mark_of(*entry) for entry in template)
    most = max(roots.values())
    return "\x00".join(min((r for r, n in roots.items() if n == most), key=len)), sorted(mark_of(*entry) for entry in template)


def _at(node: Node, path: tuple[str, ...], above: tuple[str, ...] = ()) -> Iterator[tuple[Node, tuple[str, ...]]]:
    if node.key == path[0] and not node.unseen:
        if len(path) == 1:
            yield node, above
        for child in node.children:
            if isinstance(child, Node) and len(path) > 1:
                yield from _at(child, path[1:], (*above, node.key))


def _named(node: Node, above: tuple[str, ...] = ()) -> Iterator[tuple[Node, tuple[str, ...]]]:
    """The outermost article and main elements that are not furniture."""
    for child in node.children:
        if isinstance(child, Node) and not child.unseen:
            if child.tag in ("article", "main"):
                yield child, (*above, node.key)
            else:
                yield from _named(child, (*above, node.key))


def main_text(page: str | None, root: str | None = None, template: frozenset[int] = frozenset()) -> str:
    """The article's blocks in page order, joined by one space.

    The article is what stands at the path ``root``; where the page has no such element, or the path
    is the page's body or nothing, it is all outermost article and main elements, or else the whole page.
    Furniture and blocks whose marks are in ``template`` are left out.
    """
    tree = parse(page)
    path = tuple(root.split("\x00")) if root else ()
    found = list(_at(tree, path)) if path and path[-1] not in ("#", "html", "body") else []
    if not found:
        found = list(_named(tree)) or [(tree, ())]
    return " ".join(t for node, above in found for p, t in texts(node, above) if not template or mark_of(p, t) not in template)


# -- on tables ---------------------------------------------------------------------------------------

def host_of(url: str) -> Column:
    """The lower-cased host of a URL; null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), F.lit(""))


def skeleton(tree: Node) -> int:
    """A signed 64-bit name for a page's layout: the paths of its containers, however often each stands."""
    found: set[tuple[str, ...]] = set()

    def walk(node: Node, path: tuple[str, ...]) -> None:
        for child in node.children:
            if isinstance(child, Node) and len(path) < _LAYOUT_DEPTH:
                below = (*path, child.key)
                if child.tag in CONTAINERS:
                    found.add(below)
                walk(child, below)
    walk(tree, (tree.key,))
    name = "\x01".join("\x00".join(path) for path in sorted(found))
    # 0 is the host as a whole
    return int.from_bytes(hashlib.blake2b(name.encode("utf-8", "replace"), digest_size=8).digest(), "big", signed=True) or 1


def describe(page: str | None) -> tuple[int, int | None, list[tuple[int, str | None, bool]]]:
    """(layout, name of title and headings or None, blocks); a block is (mark, path if it is evidence
    for the article's place, whether it is long)."""
    tree = parse(page)
    blocks = list(texts(tree))
    name = identity(page, blocks)
    number = None if name is None else mark_of((name[0],), "\x00".join(name[1]))
    return skeleton(tree), number, [
        (mark_of(p, t), "\x00".join(p) if len(t) >= LONG or p[-1].split(".")[0] in HEADINGS else None, len(t) >= LONG) for p, t in blocks]


def induce_wrappers(pages: DataFrame, per_host: int = 16, url_col: str = "url", html_col: str = "html", agree: float = 0.6) -> DataFrame:
    """(host, skeleton, root, template): a wrapper for every host and every layout of a host with at
    least two different pages; skeleton 0 is the host as a whole.

    Pages that are equal, or have the same title and headings, count as one. Where ``agree`` of a host's
    pages, three at least, share title and headings, these say nothing of the article: such a page counts
    for itself if half of its long texts at least do not stand on ``agree`` of them, and as one with
    those that share its first long text that stands on less than a quarter of them. At most ``per_host`` of
    them, those with the smallest page hashes, are aligned for each layout and host (:func:`induce`).
    What is template is then decided by all pages: an aligned text, or any text of 40 characters or
    more, that stands on ``agree`` of them. The article's element is the one that most of all pages
    see. A layout's template holds its host's as well.
    """
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [describe(page) for page in batch["html"]]
            yield pd.DataFrame({"host": batch["host"], "hash": batch["hash"], "skeleton": [f[0] for f in found], "named": [f[1] is not None for f in found],
                                "page": [h if f[1] is None else f[1] for h, f in zip(batch["hash"], found, strict=True)],
                                "blocks": [[{"mark": m, "path": p, "long": w} for m, p, w in f[2]] for f in found]})

    def propose(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        template = induce(rows.sort_values(["hash", "html"])["html"].tolist(), agree)[1]
        return pd.DataFrame({"host": key[0], "skeleton": key[1], "mark": template})

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            roots = []
            for marks, paths, template in zip(batch["marks"], batch["paths"], batch["template"], strict=True):
                left = set() if template is None else {int(m) for m in template}
                varying = [tuple(p.split("\x00")) for m, p in zip(marks, paths, strict=True) if int(m) not in left]
                roots.append("\x00".join(article_root(varying)) if varying else None)
            yield batch[["host", "skeleton", "page"]].assign(root=roots)

    known = pages.select(host_of(url_col).alias("host"), F.col(html_col).alias("html")).filter("host is not null and html is not null")
    known = known.withColumn("hash", F.xxhash64("html"))
    layouts = F.explode(F.array(F.lit(0).cast("long"), F.col("skeleton")))
    described = materialise(known.mapInPandas(
        read, "host string, hash long, skeleton long, named boolean, page long, blocks array<struct<mark: bigint, path: string, long: boolean>>"), "page-blocks")

    # headings that most pages of a host share
    empty = F.array().cast("array<long>")
    headed = described.groupBy("host", "page", "named").agg(F.count_distinct("hash").alias("n"))
    headed = headed.groupBy("host").agg(F.sum("n").alias("pages"), F.max(F.struct("n", "named", "page")).alias("top"))
    headed = headed.filter("top.named and top.n >= 3").filter(F.col("top.n") >= agree * F.col("pages")).select("host", "top.page", "top.n")
    headed = materialise(headed, "constant-headings")
    long = F.array_distinct(F.filter("blocks", lambda b: b["long"])["mark"])
    shared = described.join(broadcast_if_small(headed, 128), ["host", "page"]).select("host", "page", "n", "hash", F.explode(long).alias("mark")).distinct()
    shared = shared.groupBy("host", "page", "n", "mark").agg(F.count("*").alias("stands")).filter(F.col("stands") * 4 >= F.col("n"))
    shared = shared.groupBy("host", "page").agg(F.collect_list(F.when(F.col("stands") >= agree * F.col("n"), F.col("mark"))).alias("common"),
                                                F.collect_list("mark").alias("frequent"))
    headed = headed.join(shared, ["host", "page"], "left").select(
        "host", "page", F.coalesce("common", empty).alias("common"), F.coalesce("frequent", empty).alias("frequent"))
    headed = materialise(headed, "constant-heading-texts")
    rare, own = F.array_except(long, "common"), F.array_min(F.array_except(long, "frequent"))
    itself = F.col("common").isNotNull() & (F.size(rare) > 0) & (F.size(rare) * 2 >= F.size(long))
    described = described.join(broadcast_if_small(headed, 4096), ["host", "page"], "left").select(
        "host", "hash", "skeleton", F.when(itself, F.coalesce(own, F.array_min(rare))).otherwise(F.col("page")).alias("page"), "blocks")

    # one page for each title, and the sizes of layouts and hosts
    names = described.select("host", layouts.alias("skeleton"), "page", "hash").groupBy("host", "skeleton", "page").agg(F.min("hash").alias("hash"))
    names = materialise(names, "page-names")
    sizes = materialise(names.groupBy("host", "skeleton").agg(F.count("*").alias("n")).filter("n > 1"), "layouts")

    # proposals: aligned texts of some pages
    first = Window.partitionBy("host", "skeleton").orderBy("hash")
    chosen = names.withColumn("place", F.row_number().over(first)).filter(F.col("place") <= per_host)
    chosen = materialise(chosen.join(broadcast_if_small(sizes, 128), ["host", "skeleton"], "left_semi").select("host", "hash", "skeleton"), "sample")
    sample = known.join(broadcast_if_small(chosen, 160), ["host", "hash"]).dropDuplicates(["host", "skeleton", "hash"])
    proposed = sample.groupBy("host", "skeleton").applyInPandas(propose, "host string, skeleton long, mark long")

    # confirmed by all pages
    stands = described.select("host", layouts.alias("skeleton"), "page", F.explode("blocks").alias("b"))
    stands = stands.groupBy("host", "skeleton", "b.mark", "page").agg(F.max("b.long").alias("long"))
    stands = stands.groupBy("host", "skeleton", "mark").agg(F.count("*").alias("pages"), F.max("long").alias("long")).filter("pages > 1")
    confirmed = stands.join(broadcast_if_small(sizes, 128), ["host", "skeleton"]).filter(F.col("pages") - 1 >= agree * (F.col("n") - 1))
    confirmed = confirmed.join(proposed.distinct().withColumn("aligned", F.lit(True)), ["host", "skeleton", "mark"], "left").filter("long or aligned")
    templates = materialise(confirmed.groupBy("host", "skeleton").agg(F.sort_array(F.collect_list("mark")).alias("template")), "templates")
    whole = templates.filter("skeleton = 0").select("host", F.col("template").alias("of_host"))
    fitted = sizes.join(broadcast_if_small(templates, 4096), ["host", "skeleton"], "left").join(broadcast_if_small(whole, 4096), "host", "left")
    fitted = materialise(fitted.select("host", "skeleton", F.array_union(F.coalesce("template", empty), F.coalesce("of_host", empty)).alias("template")), "fitted")

    # the article's place, as most of all pages see it
    evidence = F.filter("blocks", lambda b: b["path"].isNotNull())
    seen = described.select("host", layouts.alias("skeleton"), "page", evidence["mark"].alias("marks"), evidence["path"].alias("paths"))
    seen = seen.join(broadcast_if_small(fitted, 4096), ["host", "skeleton"]).select("host", "skeleton", "page", "marks", "paths", "template")
    seen = seen.mapInPandas(place, "host string, skeleton long, page long, root string").filter("root is not null").distinct()
    votes = seen.groupBy("host", "skeleton", "root").agg(F.count("*").alias("n"))
    best = votes.groupBy("host", "skeleton").agg(F.min_by("root", F.struct(-F.col("n"), F.length("root"), F.col("root"))).alias("root"))
    return materialise(fitted.join(best, ["host", "skeleton"], "left").select("host", "skeleton", "root", "template"), "wrappers")


def extract_text(pages: DataFrame, wrappers: DataFrame | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars) for every row: the main text of the whole page (:func:`main_text`).

    A page is read with the wrapper of its layout on its host, or else the host's. A null html is an
    empty page, an empty page has an empty text. Pages without a host, and those of hosts without a
    wrapper, are read without one. Repeated rows each come back, nulls in id and url stay, an empty
    table gives no rows. Only the three named columns are read.
    """
    if wrappers is None:
        wrappers = induce_wrappers(pages, url_col=url_col, html_col=html_col)

    def lay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(skeleton=[skeleton(parse(page)) for page in batch["html"]])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict = {}
        for batch in batches:
            out = []
            for key, root, template, page in zip(zip(batch["host"], batch["layout"], strict=True), batch["root"], batch["template"], batch["html"], strict=True):
                if key not in known:
                    known[key] = frozenset() if template is None else frozenset(int(x) for x in template)
                out.append(main_text(page, root, known[key]))
            yield pd.DataFrame({"page_id": batch["page_id"], "url": batch["url"], "text": out, "n_chars": [len(t) for t in out]})

    rows = pages.select(F.col(id_col).cast("string").alias("page_id"), F.col(url_col).alias("url"), host_of(url_col).alias("host"), F.col(html_col).alias("html"))
    rows = rows.mapInPandas(lay, "page_id string, url string, host string, html string, skeleton long")
    of_layout = wrappers.filter("skeleton <> 0").select("host", "skeleton", F.struct(F.col("skeleton").alias("layout"), "root", "template").alias("own"))
    of_host = wrappers.filter("skeleton = 0").select("host", F.struct(F.col("skeleton").alias("layout"), "root", "template").alias("general"))
    joined = rows.join(broadcast_if_small(of_layout, 4096), ["host", "skeleton"], "left").join(broadcast_if_small(of_host, 4096), "host", "left")
    joined = joined.withColumn("wrapper", F.coalesce("own", "general")).select(
        "page_id", "url", "host", F.coalesce("wrapper.layout", F.lit(0)).alias("layout"), "wrapper.root", "wrapper.template", "html")
    return joined.mapInPandas(run, "page_id string, url string, text string, n_chars long").withColumn("page_id", F.col("page_id").cast("long"))
