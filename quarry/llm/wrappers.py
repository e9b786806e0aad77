"""Main text of web pages by wrapper induction.

Pages of a host are laid out by one template. Each page becomes a tree of block elements, labelled by tag and by class, id
and role; simple tree matching aligns it with the host's exemplar. A node of the exemplar, a leaf or not, whose own text
stays the same beside most of the host's different contents is template (menus, notices, footers); nodes whose text
varies are content slots. All pages of a host decide, each different content (the main text before template is
taken away) once: copies of an article and rows that repeat are one piece of evidence, however many they are.

Elements that are furniture on any site (scripts, styles, forms, menus, headers and footers of the page, asides, and
elements whose class, id or role says navigation, advert, comment, notice and the like) never hold main text; the
content root is the article or main element, or else the element that keeps most text. A name says so only as a whole:
all its words are furniture or structure (`site-footer`, `related-posts`), so that `has-sidebar`, `no-comments` or
`market-share` say nothing. The html, body and main elements, and what holds main or the largest article, are not
dropped by name (except as comments or recommendations); inside an article a header is part of the text.

Edge cases: null and empty pages give an empty text; broken markup (missing end tags, cut pages) is read as far as it
goes; nesting may be of any depth; a host with fewer than `LEAST_PAGES` different contents has no constant nodes; each row has its text; a null
or odd url makes a host of its own ('' ); an empty table gives an empty table; other columns play no part.
"""

from __future__ import annotations

import functools
import html as entities
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm._arrow import ensure_checkpoint_dir

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[(.*?)(?:\]\]>|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>?|([^<]+|<)", re.S)
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object".split())
INLINE = frozenset("a abbr b bdi bdo big cite code data dfn em font i ins kbd label mark q s samp small span strike strong sub sup time tt u var wbr del".split())
SKIPPED = frozenset("script style noscript template iframe svg object head nav footer aside form button select option textarea input dialog menu title".split())
#: Words in class, id or role that mark furniture.
FURNITURE = frozenset("ad ads advert adverts advertisement advertising banner sponsor sponsored promo promoted promotion nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar aside footer header masthead comment comments commentlist reply replies discussion disqus notice notices alert cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup share sharing social related recommended recommendations widget toolbar pagination pager skip search form login complementary contentinfo".split())
#: Words that may stand beside them in a name.
STRUCTURAL = frozenset("site page main global primary secondary top bottom left right upper lower inner outer sub mini mobile desktop sticky fixed post posts entry entries article articles story stories news block blocks box boxes list lists area section sections wrapper wrap container content row column col grid panel bar buttons button btn icons icon links link items item card cards title heading body text input field group slot unit module component element region js the and user reader readers".split())
#: These are furniture even where they hold articles.
OTHERS_TEXT = frozenset("comment comments commentlist reply replies discussion disqus related recommended recommendations".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
#: Cells of an alignment's table up to which all are held; a larger table is held in blocks of rows, with the same result.
CELLS = 4_000_000
LEAST_PAGES = 3
CONSTANT = 0.5
#: Inside an article or main element more is asked of a constant node, because altered copies of an article repeat its text too.
LEAST_INSIDE = 5
CONSTANT_INSIDE = 0.9
#: Characters of all hosts' exemplars up to which these are broadcast; a wrapper is no larger than its exemplar. Beyond
#: it pages and exemplars meet by a join on the host.
BROADCAST_CHARS = 16_000_000


class Node:
    """An element. Block elements are `numbered`; their `blocks` are the nearest block elements below, through inline ones."""

    __slots__ = ("tag", "names", "marks", "holds", "length", "parts", "children", "parent", "number", "blocks", "own", "inside", "shape", "size", "kept")

    def __init__(self, tag: str, names: frozenset[str], parent: "Node | None", marks: frozenset[str] = frozenset()):
        self.tag, self.names, self.parent, self.marks = tag, names, parent, marks
        self.holds, self.length = False, 0
        self.parts: list = []  # strings and nodes in page order
        self.children: list[Node] = []
        self.number = self.kept = -1


@functools.lru_cache(20_000)
def _names(attributes: str) -> tuple[frozenset[str], frozenset[str]]:
    """The words of class, id and role, and those words of furniture whose name is nothing but furniture and structure."""
    found: set[str] = set()
    marks: set[str] = set()
    for name, value in ATTRIBUTE.findall(attributes):
        if name.lower() in ("class", "id", "role"):
            for token in value.strip("\"'").split():
                found.update(re.split(r"[^a-z0-9]+", token.lower()))
                words = [w.lower() for w in re.split(r"[^a-zA-Z0-9]+|(?<=[a-z])(?=[A-Z])", token) if w and not w.isdigit()]
                if all(w in FURNITURE or w in STRUCTURAL for w in words):
                    marks.update(w for w in words if w in FURNITURE)
    return frozenset([x for x in found if x and not x.isdigit()]), frozenset(marks)  # numbers belong to a page, not to its template


NAMELESS = frozenset(), frozenset()


def parse(page: str) -> Node:
    """The element tree, with the usual leniency: p and li close themselves, lost end tags are ignored."""
    root = node = Node("#root", frozenset(), None)
    made = [root]
    at, size = 0, len(page)
    while at < size:
        m = TOKEN.match(page, at)
        at = m.end()
        cdata, slash, name, attributes, text = m.groups()
        if text is not None:
            node.parts.append(text)
            continue
        if cdata is not None:
            node.parts.append(entities.escape(cdata))
            continue
        if name is None:
            continue
        tag = name.lower()
        if slash:
            up = node
            while up is not None and up.tag != tag:
                up = up.parent
            if up is not None and up.parent is not None:
                node = up.parent
            continue
        if tag in CLOSES_P or tag == "li":
            closes = ("li",) if tag == "li" else ("p",)
            up = node
            while up is not None and up.tag not in closes and (up.tag in INLINE or tag == "li" and up.tag in ("p",)):
                up = up.parent
            if up is not None and up.tag in closes and up.parent is not None:
                node = up.parent
        names, marks = _names(attributes) if attributes else NAMELESS
        new = Node(tag, names, node, marks)
        made.append(new)
        node.parts.append(new)
        node.children.append(new)
        if tag in VOID or attributes.endswith("/") and tag not in ("p", "div", "span", "article"):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(page, at)
            at = end.end() if end else size
            continue
        node = new
    _mark_holders(made)
    return root


def _mark_holders(made: list[Node]) -> None:
    """Set `holds` on whatever holds a main element or the largest article; `made` has parents before children."""
    hidden: set[int] = set()
    for node in made:
        if node.parent is not None and (id(node.parent) in hidden or node.tag in ("nav", "aside", "footer")):
            hidden.add(id(node))
    for node in reversed(made):
        node.length += sum([len(part) for part in node.parts if isinstance(part, str)])
        if node.parent is not None:
            node.parent.length += node.length
    articles = [n for n in made if n.tag == "article" and not n.marks and id(n) not in hidden]
    for node in [n for n in made if n.tag == "main"] + ([max(articles, key=lambda n: n.length)] if articles else []):
        up: Node | None = node
        while up is not None and not up.holds:
            up.holds = True
            up = up.parent


def furniture(node: Node, inside: bool) -> bool:
    """Whether an element is page furniture; `inside`: it lies in the content root, where a header is part of the text."""
    if node.tag in ("html", "body", "main"):
        return False
    if node.tag in SKIPPED and not (node.tag == "form" and node.holds) or node.tag == "header" and not inside:
        return True
    if node.holds:
        return not node.marks.isdisjoint(OTHERS_TEXT)
    return bool(node.marks - {"header"} if inside else node.marks)


def numbered(root: Node) -> list[Node]:
    """The block elements in page order, with what alignment and evidence need of each.

    `own` is the text of a block with its inline elements but without the blocks below, in pieces; `inside` tells whether it
    lies in an article or main element; `shape` is a hash of the labels of its subtree, `size` the blocks in it.
    """
    out: list[Node] = []
    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        node.number, node.blocks, node.own = len(out), [], []
        node.inside = inside or node.tag in ("article", "main")
        out.append(node)
        todo = list(reversed(node.parts))
        while todo:
            part = todo.pop()
            if isinstance(part, str):
                node.own.append(part)
            elif part.tag in INLINE:
                todo.extend(reversed(part.parts))
            elif part.tag not in RAW:
                node.own.append(" ")
                if part.tag not in VOID:
                    node.blocks.append(part)
        stack.extend((c, node.inside) for c in reversed(node.blocks))
    for node in reversed(out):
        node.size = 1 + sum([c.size for c in node.blocks])
        node.shape = hash((_label(node), tuple([c.shape for c in node.blocks])))
    return out


def own_text(node: Node) -> str:
    """Text of a numbered block without the blocks below it, white space as single blanks."""
    return " ".join(entities.unescape("".join(node.own)).split())


def _label(node: Node) -> tuple:
    return node.tag, node.names


def _chosen(x: list[Node], y: list[Node], weigh) -> tuple[int, list[tuple[int, int]]]:
    """The ordered pairs of greatest total weight between two lists of children, by dynamic programming.

    Of a table beyond `CELLS` the first row of each block is kept, and a block is computed again when the way back comes to
    it: memory grows with the longer list times the root of the other, and the pairs are those of the whole table.
    """
    if not x or not y:
        return 0, []
    kinds_y = {c.shape: c for c in y}
    places_y = {shape: k for k, shape in enumerate(kinds_y)}
    at = np.array([places_y[c.shape] for c in y])
    known: dict[int, np.ndarray] = {}

    def weights(c: Node) -> np.ndarray:
        found = known.get(c.shape)
        if found is None:
            found = np.array([weigh(c, d) for d in kinds_y.values()], "int32")
            if (len(known) + 1) * len(kinds_y) <= CELLS:
                known[c.shape] = found
        return found

    def below(row: np.ndarray, c: Node) -> np.ndarray:
        out = np.zeros_like(row)
        out[1:] = np.maximum.accumulate(np.maximum(row[1:], row[:-1] + weights(c)[at]))
        return out

    height = len(x) if len(x) * len(y) <= CELLS else math.isqrt(len(x)) + 1
    row, tops = np.zeros(len(y) + 1, "int32"), []
    for i, c in enumerate(x):
        if i % height == 0:
            tops.append(row)
        row = below(row, c)
    total = int(row[-1])
    steps: list[tuple[int, int]] = []
    j = len(y)
    for first in range((len(tops) - 1) * height, -1, -height):
        table = [tops.pop()]
        for c in x[first : first + height]:
            table.append(below(table[-1], c))
        i = len(table) - 1
        while i and j:
            w = weights(x[first + i - 1])[at[j - 1]]
            if w and table[i][j] == table[i - 1][j - 1] + w:
                i, j = i - 1, j - 1
                steps.append((first + i, j))
            elif table[i - 1][j] == table[i][j]:
                i -= 1
            else:
                j -= 1
    return total, steps[::-1]


def match(a: Node, b: Node) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of numbered trees: the weight of the best match, and the (number in a, number in b) of its nodes.

    Nodes of unequal labels do not match. Matched nodes match their children in order, so that the sum of the children's
    own matches is greatest. Two shortcuts lose nothing: trees of equal shape match node by node, and children of equal
    shape at either end of both lists belong together, because no other partner could weigh more. Weights are kept
    by shape, and an explicit stack takes trees of any depth.
    """
    known: dict[tuple[int, int], tuple] = {}

    def weigh(x: Node, y: Node) -> int:
        if x.shape == y.shape:
            return x.size
        return known[x.shape, y.shape][0] if _label(x) == _label(y) else 0

    if _label(a) != _label(b):
        return 0, []
    stack = [(a, b)]
    while stack:
        x, y = stack[-1]
        if x.shape == y.shape or (x.shape, y.shape) in known:
            stack.pop()
            continue
        p, q = x.blocks, y.blocks
        left, least = 0, min(len(p), len(q))
        while left < least and p[left].shape == q[left].shape:
            left += 1
        right = 0
        while right < least - left and p[-1 - right].shape == q[-1 - right].shape:
            right += 1
        p, q = p[left : len(p) - right], q[left : len(q) - right]
        kinds = {c.shape: c for c in q}.values()
        missing = [(c, d) for c in {c.shape: c for c in p}.values() for d in kinds if c.shape != d.shape and (c.shape, d.shape) not in known and _label(c) == _label(d)]
        if missing:
            stack += missing
            continue
        total, steps = _chosen(p, q, weigh)
        ends = sum([c.size for c in x.blocks[:left]]) + sum([c.size for c in x.blocks[len(x.blocks) - right :]])
        known[x.shape, y.shape] = (1 + ends + total, left, right, steps)
        stack.pop()
    pairs: list[tuple[int, int]] = []
    stack = [(a, b)]
    while stack:
        x, y = stack.pop()
        if x.shape == y.shape:
            pairs += zip(range(x.number, x.number + x.size), range(y.number, y.number + y.size))
            continue
        pairs.append((x.number, y.number))
        _, left, right, steps = known[x.shape, y.shape]
        stack += zip(x.blocks[:left], y.blocks[:left])
        stack += zip(x.blocks[len(x.blocks) - right :], y.blocks[len(y.blocks) - right :])
        stack += [(x.blocks[left + i], y.blocks[left + j]) for i, j in steps]
    return weigh(a, b), pairs


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode()) >> 1


class Aligner:
    """Alignments by the shapes of exemplar and page, which decide them; the latest few are kept."""

    def __init__(self, entries: int = 400, pairs: int = 3_000):
        self.entries, self.pairs = entries, pairs
        self.known: dict[tuple[int, int], list[tuple[int, int]]] = {}

    def __call__(self, exemplar: Node, page: str) -> tuple[list[Node], list[tuple[int, int]]]:
        nodes = numbered(parse(page))
        key = exemplar.shape, nodes[0].shape
        found = self.known.get(key)
        if found is None:
            found = match(exemplar, nodes[0])[1]
            if len(found) <= self.pairs:
                if len(self.known) >= self.entries:
                    self.known.clear()
                self.known[key] = found
        return nodes, found


def main_text(root: Node, constant: set[int] = frozenset()) -> str:
    """Text of the content slots of a numbered tree; `constant`: numbers of the blocks whose own text was found to be template."""
    order: list[Node] = []
    stack = [(root, False, False)]
    while stack:
        node, inside, mute = stack.pop()
        node.kept = 0 if mute else sum([len(part) for part in node.parts if isinstance(part, str)])
        order.append(node)
        for part in node.children:
            if not furniture(part, inside):
                stack.append((part, inside or part.tag in ("article", "main"), mute if part.tag in INLINE else part.number in constant))
    for node in reversed(order):
        if node.parent is not None:
            node.parent.kept += node.kept
    best: Node | None = None
    todo = [root]
    while todo:
        for c in todo.pop().children:
            if c.kept >= 0:
                if (c.tag in ("article", "main") or "article" in c.names) and (best is None or c.kept > best.kept):
                    best = c
                if c.tag != "article":
                    todo.append(c)
    if best is None:
        best = root
    out: list[str] = []
    stack = [(best, best.number in constant)]
    while stack:
        part, mute = stack.pop()
        if isinstance(part, str):
            out.append(part)
            continue
        if part is not best and part.tag not in INLINE:
            stack.append((" ", False))
            out.append(" ")
        for below in reversed(part.parts):
            if isinstance(below, str):
                if not mute:
                    stack.append((below, False))
            elif furniture(below, True):
                stack.append((" ", False))
            else:
                stack.append((below, mute if below.tag in INLINE else below.number in constant))
    return " ".join(entities.unescape("".join(out)).split())


def _exemplars(shared: dict[str, Node], host: str, page: str) -> Node:
    key = f"{host}\0{xxhash.xxh3_64_hexdigest(page)}"
    found = shared.get(key)
    if found is None:
        if len(shared) > 500:
            shared.clear()
        found = shared[key] = parse(page)
        numbered(found)
    return found


def _count_nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each page and exemplar (host, node, hash of the text, inside, hash of the content), different ones in a task; node -1 counts contents."""
    known: dict[str, Node] = {}
    align = Aligner()
    found: set[tuple] = set()

    def flush() -> pa.RecordBatch:
        columns = list(zip(*found))
        found.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.int64()))], ["host", "node", "text", "inside", "content"])

    for batch in batches:
        for host, html, exemplar in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "exemplar"))):
            if not html:
                continue
            nodes, pairs = align(_exemplars(known, host, exemplar), html)
            content = text_hash(main_text(nodes[0]))
            found.add((host, -1, 0, False, content))
            for a, b in pairs:
                text = own_text(nodes[b])
                if text:
                    found.add((host, a, text_hash(text), nodes[b].inside, content))
            if len(found) > 100_000:
                yield flush()
    if found:
        yield flush()


def _extract(id_column: str, url_column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, Node] = {}
        align = Aligner()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                texts = []
                for host, html, exemplar, wrapper in zip(*(part.column(c).to_pylist() for c in ("host", "html", "exemplar", "wrapper"))):
                    if not html:
                        texts.append("")
                        continue
                    template = {(w["node"], w["text"]) for w in wrapper or ()}
                    constant: set[int] = set()
                    slots = {node for node, _ in template}
                    if template:
                        nodes, pairs = align(_exemplars(known, host, exemplar), html)
                        # matched nodes that carry the constant text of their slot
                        constant = {b for a, b in pairs if b and a in slots and (a, text_hash(own_text(nodes[b]))) in template}
                        root = nodes[0]
                    else:
                        root = parse(html)
                        numbered(root)
                    texts.append(main_text(root, constant))
                yield pa.RecordBatch.from_arrays([part.column(id_column), part.column(url_column), pa.array(texts, pa.string())], [id_column, url_column, "text"])

    return run


def extract_main_text(pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html", least_pages: int = LEAST_PAGES, constant: float = CONSTANT) -> DataFrame:
    """id, url, text (one row each row of `pages`). The exemplar of a host is its page of least hash."""
    ensure_checkpoint_dir(pages.sparkSession)
    rows = pages.select(F.col(id_column), F.col(url_column), F.col(html_column).alias("html"), F.coalesce(F.lower(F.regexp_extract(F.col(url_column), r"^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1)), F.lit("")).alias("host"))
    hosts = rows.filter(F.length("html") > 0).groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), F.col("html").alias("exemplar"))).alias("e"), F.count(F.lit(1)).alias("pages")).select("host", "e.exemplar", "pages").checkpoint()
    few = (hosts.agg(F.sum(F.length("exemplar"))).first()[0] or 0) <= BROADCAST_CHARS
    near = F.broadcast if few else (lambda df: df)
    paired = rows.join(near(hosts.filter(F.col("pages") >= least_pages)), "host")
    evidence = paired.select("host", "html", "exemplar").mapInArrow(_count_nodes, "host string, node int, text long, inside boolean, content long").groupBy("host", "node", "text", "content").agg(F.max("inside").alias("inside"))
    counts = evidence.groupBy("host", "node", "text").agg(F.count(F.lit(1)).alias("n"), F.max("inside").alias("inside")).filter(F.col("n") >= F.when(F.col("inside"), LEAST_INSIDE).otherwise(least_pages)).checkpoint()
    contents = counts.filter("node = -1").select("host", F.col("n").alias("contents"))
    wrappers = counts.filter("node >= 0").join(contents, "host").filter(F.col("n") >= F.col("contents") * F.when(F.col("inside"), CONSTANT_INSIDE).otherwise(constant)).groupBy("host").agg(F.collect_list(F.struct("node", "text")).alias("wrapper"))  # at most 1 / constant a node of one page
    joined = rows.join(near(hosts.select("host", "exemplar").join(wrappers, "host")), "host", "left")
    kinds = dict(pages.dtypes)
    return joined.select(id_column, url_column, "html", "host", "exemplar", "wrapper").mapInArrow(_extract(id_column, url_column), f"`{id_column}` {kinds[id_column]}, `{url_column}` {kinds[url_column]}, text string")
