"""Main text of web pages: what marks itself as furniture goes, and so do site templates.

Pages are parsed into elements; every element's subtree gets a hash of its tags, classes and
texts. Spark counts on how many pages of a host each box of a page's content (a subtree of a
block element) occurs. A box on at least MIN_PAGES pages is the site's template and is deleted,
whatever its markup, length or place, in articles too. Running prose is not: headings,
paragraphs and parts of lists and tables stay where they stand directly in the content or a
sibling of theirs does not recur, unless they are mostly links. So that copies of a page do not
make its text a template, pages count once by what they hold besides the box: the longest
texts that make up half of what is outside it. A page with nothing besides is not counted.

Besides, elements that are furniture by tag, role or
class (menus, headers, footers, sidebars, notices, adverts, forms, comments, scripts, styles)
are left out. A form, or a class or id that only has such a word as part of a longer name
(`with-sidebar`), does not make furniture of what holds over half of the page's unlinked text.
The text is that of the page's article, else its main element, else its body; where that shows
less than an article inside a wrapper with a furniture word, it is that article's.

Inside a block white space becomes one space; blocks are joined by a line feed in page order.
Markup may be broken: end tags may lack, be doubled or cross, comments and tags may not end.

Null html is empty and gives an empty text; null addresses form a host of their own; repeated
rows are handled one by one; empty tables give empty results; extra columns are ignored.
Pages are parsed once; what their content holds is staged, packed. Boxes meet their counts by
`attach`, so a box may be on any share of all pages; a page carries only its own boxes.
"""

from __future__ import annotations

import json
import math
import re
import zlib
from collections import Counter
from html import unescape
from itertools import accumulate

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stonewatch.llm.common import attach, frugal, stage
from stonewatch.llm.url_filter import host_of

MIN_PAGES = 10
LINK_SHARE = 0.5

#: Element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure"
    " footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol p pre section summary table tbody tfoot"
    " thead tr ul".split()
)
CLOSES_P = BLOCKS - {"body", "html", "caption", "tbody", "tfoot", "thead", "tr", "legend"}
SIBLINGS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
P_WALLS = frozenset("td th caption table button object".split())
FURNITURE_TAGS = frozenset(
    "script style noscript template svg canvas iframe object embed head title nav footer aside form button select"
    " textarea input dialog menu audio video xmp noembed noframes".split()
)
FURNITURE_ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar".split())
#: Words in class and id that mark furniture.
FURNITURE_WORDS = frozenset(
    "ad ads adv advert adverts advertisement advertising adbox adslot banner sponsor sponsored promo promotion cookie"
    " cookies consent gdpr notice notices alert alerts announcement popup modal overlay newsletter subscribe signup sidebar sidenav nav navbar"
    " navigation menu menus breadcrumb breadcrumbs footer comment comments commentlist respond reply replies disqus"
    " share sharing social related recommended pagination pager widget widgets toolbar topbar masthead".split()
)
#: Elements that are a page's content rather than boxes in it, and those that are lines of running text.
WHOLE_TAGS = frozenset("article main body html".split())
LINE_TAGS = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote pre li dt dd tr caption legend figcaption thead tbody tfoot".split()
)

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?>(?:[^>"']++|"[^"]*+"|'[^']*+')*+))(?:>|\Z)"""
    r"""|<(/?)([a-zA-Z][^\s/>]*)([^>]*)(?:>|\Z)""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]+)))?""")
_PART = re.compile(r"[a-z0-9]+")


class Node:
    __slots__ = ("tag", "attributes", "children", "digest", "chars", "linked")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []
        self.digest, self.chars, self.linked = 0, 0, 0

    def close(self) -> None:
        """Hash and sizes, from those of the children."""
        h = xxhash.xxh3_64(f"{self.tag}\0{self.attributes.get('class', '')}")
        for child in self.children:
            if isinstance(child, str):
                words = " ".join(child.split())
                if words:
                    h.update("\1" + words)
                    self.chars += len(words)
            else:
                h.update(b"\2" + child.digest.to_bytes(8, "little"))
                self.chars += child.chars
                self.linked += child.linked
        if self.tag in RAW:
            self.chars = 0
        if self.tag == "a":
            self.linked = self.chars
        self.digest = h.intdigest()


def _attributes(text: str) -> dict[str, str]:
    if not text or text.isspace():
        return {}
    found = {}
    for m in _ATTRIBUTE.finditer(text):
        found.setdefault(m[1].lower(), unescape(m[2] or m[3] or m[4] or ""))
    return found


def parse(html: str) -> Node:
    """The tree of a page under a node without a tag. No recursion: depth is not limited."""
    root = Node("", {})
    stack, opened = [root], Counter()

    def pop_to(place: int) -> None:
        while len(stack) > place:
            node = stack.pop()
            opened[node.tag] -= 1
            node.close()

    def close_open(tags, walls) -> None:
        for place in range(len(stack) - 1, 0, -1):
            if stack[place].tag in tags:
                pop_to(place)
                return
            if stack[place].tag in walls:
                return

    at, n = 0, len(html)
    while at < n:
        m = _TOKEN.search(html, at)
        if m is None:
            stack[-1].children.append(unescape(html[at:]))
            break
        if m.start() > at:
            stack[-1].children.append(unescape(html[at : m.start()]))
        at = m.end()
        tag = m[2] or m[5]
        if tag is None:
            continue
        tag = tag.lower()
        if m[1] or m[4]:
            if opened[tag] > 0:
                place = len(stack) - 1
                while stack[place].tag != tag:
                    place -= 1
                pop_to(place)
            continue
        if tag in CLOSES_P and opened["p"] > 0:
            close_open({"p"}, P_WALLS)
        if tag in SIBLINGS:
            tags, walls = SIBLINGS[tag]
            if any(opened[t] > 0 for t in tags):
                close_open(tags, walls)
        written = m[3] or m[6] or ""
        node = Node(tag, _attributes(written))
        stack[-1].children.append(node)
        if tag in VOID:
            node.close()
        elif tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]|\Z", re.I).search(html, at)
            node.children.append(html[at : end.start()])
            node.close()
            at = end.start()
            closing = _TOKEN.match(html, at)
            at = closing.end() if closing else end.end()
        else:
            stack.append(node)
            opened[tag] += 1
    pop_to(1)
    root.close()
    return root


def is_apart(node: Node) -> bool:
    """Furniture by tag (forms aside), role or being hidden: no article is looked for inside."""
    a = node.attributes
    if node.tag in FURNITURE_TAGS and node.tag != "form":
        return True
    if not a:
        return False
    if "hidden" in a or a.get("aria-hidden", "").lower() == "true" or a.get("role", "").lower() in FURNITURE_ROLES:
        return True
    return "display:none" in a.get("style", "").replace(" ", "").lower()


def is_furniture(node: Node, in_article: bool, most: float = math.inf) -> bool:
    """`most` is the unlinked text above which a form or a part of a longer name does not count."""
    if is_apart(node) or node.tag == "header" and not in_article:
        return True
    large = node.chars - node.linked > most
    if node.tag == "form" and not large:
        return True
    a = node.attributes
    if not a or node.tag in ("html", "body", "main", "h1"):
        return False
    written = f"{a.get('class', '')} {a.get('id', '')}".lower()
    names = written.split() if large else _PART.findall(written)
    return any(w in FURNITURE_WORDS for w in names) or "header" in names and not in_article


def most_of(roots: list[Node]) -> float:
    """Half of the roots' unlinked text."""
    return sum(n.chars - n.linked for n in roots) / 2


def is_article(node: Node) -> bool:
    return node.tag == "article"


def is_main(node: Node) -> bool:
    return node.tag == "main" or node.attributes.get("role") == "main"


def below(root: Node, wanted, passes, enters) -> list[Node]:
    """The outermost wanted elements that pass, in page order; `enters` says where to look."""
    found, todo = [], [root]
    while todo:
        node = todo.pop()
        if wanted(node) and passes(node):
            found.append(node)
        elif enters(node):
            todo.extend(c for c in reversed(node.children) if isinstance(c, Node))
    return found


def content_roots(root: Node) -> tuple[list[Node], bool]:
    """The outermost articles that are not furniture, else main elements, else the page; but
    the largest article among furniture where those show less text than it has."""
    most = most_of([root])
    chosen, in_article = [root], False
    for wanted in (is_article, is_main):
        found = below(root, wanted, lambda n: not is_furniture(n, True, most), lambda n: not is_furniture(n, False, most))
        if any(n.chars for n in found):
            if wanted is is_article:
                return found, True
            chosen, in_article = found, True
            break
    for wanted in (is_article, is_main):
        hidden = below(root, wanted, lambda n: not is_apart(n), lambda n: not is_apart(n))
        largest = max(hidden, key=lambda n: n.chars - n.linked, default=None)
        if largest and largest.chars - largest.linked > len(text_below(chosen, in_article, frozenset())):
            return [largest], True
    return chosen, in_article


class Outline:
    """Texts of the content in page order, each in a box (-1: in none), and the boxes: digest,
    the box around it, whether it is a line of running text, and what the page holds besides."""

    __slots__ = ("texts", "owners", "digests", "parents", "lines")

    def __init__(self, texts, owners, digests, parents, lines):
        self.texts, self.owners, self.digests, self.parents, self.lines = texts, owners, digests, parents, lines

    def packed(self) -> bytes:
        """All but the digests, which stand in a column of their own."""
        parts = [self.texts, self.owners, self.parents, list(map(int, self.lines))]
        return zlib.compress(json.dumps(parts, ensure_ascii=False, separators=(",", ":")).encode("utf-8", "replace"), 6)

    @staticmethod
    def unpacked(data: bytes) -> Outline:
        texts, owners, parents, lines = json.loads(zlib.decompress(data))
        return Outline(texts, owners, [], parents, lines)

    def besides(self) -> list[int | None]:
        """A hash of the texts outside each box that make up half of what is outside: those of
        the highest classes by length (powers of two). The texts of a box follow one another."""
        n = len(self.texts)
        low, high = [n] * len(self.digests), [0] * len(self.digests)
        for i, owner in enumerate(self.owners):
            if owner >= 0:
                low[owner], high[owner] = min(low[owner], i), max(high[owner], i + 1)
        for i in range(len(self.digests) - 1, -1, -1):
            p = self.parents[i]
            if p >= 0:
                low[p], high[p] = min(low[p], low[i]), max(high[p], high[i])
        hashes, sizes = [xxhash.xxh3_64_intdigest(t) for t in self.texts], [len(t) for t in self.texts]
        sums = []  # by class and above: running sizes and hashes
        for least in sorted({1 << x.bit_length() - 1 for x in sizes}, reverse=True):
            sums.append((
                [0, *accumulate(x if x >= least else 0 for x in sizes)],
                [0, *accumulate(h if x >= least else 0 for h, x in zip(hashes, sizes))],
            ))
        found: list[int | None] = []
        for a, b in zip(low, high):
            outside = lambda running: running[a] + running[n] - running[max(a, b)]  # noqa: E731, B023
            every = outside(sums[-1][0]) if sums else 0
            found.append(next((outside(h) % (1 << 64) for x, h in sums if 2 * outside(x) >= every), 0) if every else None)
        return found

    def text(self, recurring: frozenset | set) -> str:
        """The text without templates, given the numbers of the recurring boxes."""
        if not recurring:
            return "\n".join(self.texts)
        own = {p for i, p in enumerate(self.parents) if i not in recurring} | set(self.owners) | {-1}
        gone: list[bool] = []
        for i, (parent, line) in enumerate(zip(self.parents, self.lines)):
            around = parent >= 0 and gone[parent]
            gone.append(around or i in recurring and not (line and parent in own))
        return "\n".join(t for t, o in zip(self.texts, self.owners) if o < 0 or not gone[o])


def outline(roots: list[Node], in_article: bool) -> Outline:
    """What the content holds, furniture left out."""
    most = most_of(roots)
    made = Outline([], [], [], [], [])
    held: list[str] = []

    def flush(owner: int) -> None:
        text = " ".join("".join(held).split())
        held.clear()
        if text:
            made.texts.append(text)
            made.owners.append(owner)

    for top in roots:
        walk = [(top, iter(top.children), -1)]
        flush(-1)
        while walk:
            node, children, owner = walk[-1]
            child = next(children, None)
            if child is None:
                walk.pop()
                if node.tag in BLOCKS:
                    flush(owner)
            elif isinstance(child, str):
                held.append(child)
            elif is_furniture(child, in_article, most):
                held.append(" ")
            else:
                box = owner
                if child.tag in BLOCKS:
                    flush(owner)
                    if child.chars and child.tag not in WHOLE_TAGS:
                        box = len(made.digests)
                        made.digests.append(child.digest)
                        made.parents.append(owner)
                        made.lines.append(child.tag in LINE_TAGS and child.linked <= LINK_SHARE * child.chars)
                elif child.tag in ("br", "td", "th"):
                    held.append(" ")
                walk.append((child, iter(child.children), box))
        flush(-1)
    return made


def text_below(roots: list[Node], in_article: bool, templates: frozenset | set) -> str:
    made = outline(roots, in_article)
    return made.text({i for i, d in enumerate(made.digests) if d in templates})


def main_text(root: Node, templates: frozenset | set) -> str:
    """Blocks of the content, furniture and template boxes left out."""
    return text_below(*content_roots(root), templates)


def signed(digest: int) -> int:
    return digest - (1 << 64) if digest >> 63 else digest


def outlines(pages: DataFrame) -> DataFrame:
    """Staged (rid, page_id, url, packed, boxes) of pages with rid, page_id, url, host and html;
    boxes are (digest with the host, besides) in the order of the outline."""

    @frugal
    def made(batches):
        for batch in batches:
            packed, boxes = [], []
            for host, html in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                page = outline(*content_roots(parse(html)))
                site = "" if host is None else "=" + host
                digests = (signed(xxhash.xxh3_64_intdigest(f"{site}\0{d}")) for d in page.digests)
                besides = (None if k is None else signed(k) for k in page.besides())
                packed.append(page.packed())
                boxes.append([{"box": d, "besides": k} for d, k in zip(digests, besides)])
            kind = pa.list_(pa.struct([("box", pa.int64()), ("besides", pa.int64())]))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(packed, pa.binary()), pa.array(boxes, kind)],
                ["rid", "page_id", "url", "packed", "boxes"],
            )

    schema = "rid long, page_id long, url string, packed binary, boxes array<struct<box: long, besides: long>>"
    return stage(pages.select("rid", "page_id", "url", "host", "html").mapInArrow(made, schema), "outlines")


def site_templates(boxes: DataFrame, min_pages: int = MIN_PAGES) -> DataFrame:
    """Staged (box, n_rows) of boxes (rid, number, box, besides) on `min_pages` pages that differ besides."""
    apart = boxes.groupBy("box", "besides").agg(F.count("*").alias("n_rows"))
    counts = apart.groupBy("box").agg(F.count("besides").alias("pages"), F.sum("n_rows").alias("n_rows"))
    return stage(counts.filter(F.col("pages") >= min_pages).select("box", "n_rows"), "templates")


def extract(
    pages: DataFrame,
    min_pages: int = MIN_PAGES,
    id_column: str = "page_id",
    url_column: str = "url",
    html_column: str = "html",
) -> DataFrame:
    """One row per page: page_id, url, text, n_chars."""
    url = F.col(f"`{url_column}`")
    rows = pages.select(
        F.monotonically_increasing_id().alias("rid"),
        F.col(f"`{id_column}`").cast("long").alias("page_id"),
        url.cast("string").alias("url"),
        host_of(url).alias("host"),
        F.coalesce(F.col(f"`{html_column}`"), F.lit("")).alias("html"),
    )
    made = outlines(rows)
    boxes = made.select("rid", F.posexplode("boxes").alias("number", "b")).select("rid", "number", "b.box", "b.besides")
    total = made.agg(F.sum(F.size("boxes"))).first()[0] or 0
    met = attach(boxes.drop("besides"), site_templates(boxes, min_pages), ["box"], "n_rows", total)
    lists = met.groupBy("rid").agg(F.collect_list("number").alias("recurring"))
    # the planner sees short lists and would broadcast one for every page: name the join
    known = made.select("rid", "page_id", "url", "packed").join(lists.hint("merge"), "rid", "left")

    @frugal
    def extracted(batches):
        for batch in batches:
            texts = [
                Outline.unpacked(data).text(frozenset(listed or ()))
                for data, listed in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            ]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()),
                 pa.array(list(map(len, texts)), pa.int64())],
                ["page_id", "url", "text", "n_chars"],
            )

    kept = known.select("page_id", "url", "packed", "recurring")
    return kept.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")
