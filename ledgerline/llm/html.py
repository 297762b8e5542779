"""Main text of pages by wrapper induction over the pages of a host.

Every page becomes a tree of its block elements, like siblings in a row folded into one. One page of each host is the
reference; simple tree matching aligns the others with it, and inside a run the siblings' texts are aligned. A node whose text is the same on nearly all aligned pages
belongs to the host's template; varying slots and nodes without a counterpart are content. Of these, elements and class
words take out menus, footers, adverts and the like, where they cannot be the article: not what holds an article or
most of the page's text, and inside an article only what its class says beyond doubt. Counts of equal and other texts
per reference node are summed by Spark, so a host with a third of all pages is no hot key.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left
from collections import Counter, defaultdict, deque

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerline.llm.common import arrow_map, written

#: A node is template if at least so many differing pages align with it and this share of them has its text.
LEAST_PAGES, SAME = 8, 0.9
#: Bytes of reference pages that are sent to all executors; above, they are joined by host.
BROADCAST_BYTES = 8 << 20
#: Reference pages that a worker keeps parsed.
KEPT = 256
#: Elements nested deeper stand beside each other at this depth.
DEEPEST = 100
#: Cells of a table of two rows of siblings; longer rows are aligned by their signs alone.
CELLS = 10_000

# fixed values: HTML element names
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes iframe".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer "
    "form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre section select "
    "summary table tbody td tfoot th thead tr ul".split()
)
#: Elements whose text is never part of the article.
DROPPED = frozenset(
    "aside button canvas dialog embed footer form head iframe input label menu nav noembed noframes noscript object "
    "option script select style svg template textarea title audio video map math".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words in class, id or role that mark what is not the article.
MARKS = frozenset(
    "ad ads advert adverts advertisement advertising adsense alert banner breadcrumb breadcrumbs comment comments "
    "complementary consent contentinfo cookie cookies disqus footer form gdpr header hidden login masthead menu menubar "
    "modal nav navbar navigation newsletter notice notification overlay pagination pager paywall popup promo promoted "
    "promotion recommended related replies reply respond search share sharing sidebar sidebars signup skip social "
    "sponsor sponsored subscribe subscription toolbar topbar warning widget widgets".split()
)
#: Words that say nothing beside one of the marks: a class of both alone is what the mark says.
PLAIN = frozenset(
    "area bar block body bottom box btn button buttons container content global group inner item items left link links list "
    "main module outer page panel posts primary right row secondary section site slot title top unit wrap wrapper".split()
)
#: Elements that hold text of an article whatever their class says.
TEXT = frozenset("p pre blockquote h1 h2 h3 h4 h5 h6 article main".split())
#: Elements that may hold the article although they are no part of one.
AROUND = frozenset("form header label dialog menu aside".split())

ENDS_P = BLOCK - {"body", "html", "dd", "dt", "li", "legend", "option", "optgroup", "tbody", "td", "tfoot", "th", "thead", "tr"}
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tbody": {"tr", "td", "th", "thead", "tbody"}, "tfoot": {"tr", "td", "th", "tbody", "thead"},
}
BARRIERS = frozenset("table ul ol dl select body html article section div main td th li blockquote".split())

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:(?>=\s*(?:"[^"]*"|'[^']*'))|[^>])*+)(?:>|\Z)""",
    re.S,
)
_MARK = re.compile(r"""(?:^|\s)(class|id|role|style|aria-hidden|hidden)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


class Node:
    """A block element: its name, what its attributes mark, children and texts in page order.

    ``marked``: 0 not at all, 1 by a part of a class, id or role, 2 by one that says nothing else.
    """

    __slots__ = ("name", "sign", "dropped", "marked", "parts")

    def __init__(self, name: str, attributes: str = "") -> None:
        self.name, self.dropped, self.marked, self.parts = name, name in DROPPED, 0, []
        self.sign = name
        if attributes:
            for key, value in _MARK.findall(attributes):
                key, value = key.lower(), value.strip("\"'")
                if key in ("class", "id", "role"):
                    self.marked = max([self.marked, *map(_marked, value.split())])
                    if key == "class":
                        self.sign = f"{name}.{value}"
                elif key == "hidden" or key == "aria-hidden" and value == "true":
                    self.dropped = True
                elif key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                    self.dropped = True
            if name in ("html", "body", "main"):
                self.marked = 0


def _marked(token: str) -> int:
    words = {w.lower() for w in _PART.findall(token)}
    return 0 if not words & MARKS else 2 if words <= MARKS | PLAIN and "no" not in words and "with" not in words else 1


def settle(root: Node) -> None:
    """Decide which marked nodes are dropped, and which elements around an article are not.

    Neither what holds the largest article (or main element, without articles) goes, nor what holds half of the page's
    text or more. Outside of articles any mark counts; inside only a whole one, and never on a paragraph or heading.
    """
    order, waiting = [], [(root, None, False)]
    while waiting:
        node, above, inside = waiting.pop()
        order.append((node, above, inside))
        inside = inside or node.name in ("article", "main")
        waiting.extend((p, node, inside) for p in node.parts if isinstance(p, Node))
    size, parent = {id(n): 0 for n, _, _ in order}, {id(n): above for n, above, _ in order}
    for node, above, _ in reversed(order):  # children before parents
        if node.dropped and node.name not in AROUND:
            size[id(node)] = 0
        else:
            size[id(node)] += sum(len(p.strip()) for p in node.parts if isinstance(p, str))
        if above is not None:
            size[id(above)] += size[id(node)]
    for name in ("article", "main"):
        found = [n for n, _, _ in order if n.name == name and not n.dropped]
        if found:
            break
    holds, above = set(), parent[id(max(found, key=lambda n: size[id(n)]))] if found else None
    while above is not None:
        holds.add(id(above))
        above = parent[id(above)]
    half = size[id(root)] / 2
    for node, _, inside in order:
        most = id(node) in holds or size[id(node)] >= half > 0
        if node.dropped:
            node.dropped = not (most and node.name in AROUND and not inside)
        elif node.marked and not most:
            node.dropped = node.marked == 2 and node.name not in TEXT if inside else True


def parse(source: str) -> Node:
    """The tree of a page; broken markup gives some tree, never an error."""
    root = Node("html")
    stack, at, inline = [root], 0, 0  # inline: depth of dropped inline elements

    def text(piece: str) -> None:
        if piece and not inline:
            stack[-1].parts.append(entities.unescape(piece))

    while True:
        found = _TOKEN.search(source, at)
        if not found:
            text(source[at:])
            settle(root)
            return root
        text(source[at : found.start()])
        at = found.end()
        name = found.group(2)
        if not name:
            continue
        name = name.lower()
        if found.group(1):
            if name in BLOCK:
                for depth in range(len(stack) - 1, 0, -1):
                    if stack[depth].name == name:
                        del stack[depth:]
                        break
            elif name in DROPPED and inline:
                inline -= 1
            continue
        if name in RAW:  # up to its own end tag
            end = re.compile(rf"</{name}\b[^>]*>", re.I).search(source, at)
            at = end.end() if end else len(source)
            continue
        if name in VOID:
            if name in BLOCK:
                stack[-1].parts.append(Node(name))
            else:
                text(" ") if name == "br" else None
            continue
        if name not in BLOCK:
            if name in DROPPED and not found.group(3).endswith("/"):
                inline += 1
            elif name not in DROPPED and found.group(3):
                inner = Node(name, found.group(3))
                if inner.dropped or inner.marked == 2:
                    at = _skip(source, at, name)
            continue
        inline = 0
        if name in ("html", "body"):
            continue
        if name in ENDS_P:
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == "p":
                    del stack[depth:]
                    break
                if stack[depth].name in BARRIERS:
                    break
        for closed in (CLOSES.get(name) or ()):
            for depth in range(len(stack) - 1, 0, -1):
                if stack[depth].name == closed:
                    del stack[depth:]
                    break
                if stack[depth].name in BARRIERS - {"li", "td", "th"}:
                    break
        node = Node(name, found.group(3))
        stack[min(len(stack), DEEPEST) - 1].parts.append(node)
        stack.append(node)


def _skip(source: str, at: int, name: str) -> int:
    """The place after the end tag that closes an inline element opened before ``at``."""
    depth = 1
    for found in re.compile(rf"<(/?){re.escape(name)}\b[^>]*>", re.I).finditer(source, at):
        depth += -1 if found.group(1) else 1
        if not depth:
            return found.end()
    return at


def _own(node: Node) -> str:
    return " ".join("".join(p for p in node.parts if isinstance(p, str)).split())


class Folded:
    """A run of like siblings: a hash of each one's own text and the runs of all their children."""

    __slots__ = ("sign", "nodes", "marks", "runs")

    def __init__(self, nodes: list[Node]) -> None:
        self.sign, self.nodes = nodes[0].sign, nodes
        self.marks = [xxhash.xxh3_64_intdigest(_own(n)) for n in nodes]
        self.runs = fold([p for n in nodes for p in n.parts if isinstance(p, Node)])


def fold(children: list[Node]) -> list[Folded]:
    runs: list[list[Node]] = []
    for child in children:
        if runs and runs[-1][0].sign == child.sign:
            runs[-1].append(child)
        else:
            runs.append([child])
    return [Folded(r) for r in runs]


def match(a: Folded, b: Folded) -> tuple[int, list[tuple[Folded, Folded]]]:
    """Simple tree matching: the size of the largest match of two trees that keeps order and ancestors, and the
    pairs of nodes in it."""
    if a.sign != b.sign:
        return 0, []
    # equal heads and tails need no table
    rows, cols, head = len(a.runs), len(b.runs), 0
    while head < min(rows, cols) and a.runs[head].sign == b.runs[head].sign:
        head += 1
    tail = 0
    while tail < min(rows, cols) - head and a.runs[rows - 1 - tail].sign == b.runs[cols - 1 - tail].sign:
        tail += 1
    sure = [(n, n) for n in range(head)] + [(rows - tail + n, cols - tail + n) for n in range(tail)]
    left, right = a.runs[head : rows - tail], b.runs[head : cols - tail]
    if len(left) * len(right) > CELLS:
        names: dict[str, int] = {}
        signs = [[names.setdefault(r.sign, len(names)) for r in runs] for runs in (left, right)]
        sure[head:head] = [(head + i, head + j) for i, j in same_text(*signs)]
        left = []
    parts = [match(a.runs[i], b.runs[j]) for i, j in sure]
    middle, between = _table(left, right) if left and right else (0, [])
    found = [p for _, pairs in parts[:head] for p in pairs] + between + [p for _, pairs in parts[head:] for p in pairs]
    return 1 + middle + sum(n for n, _ in parts), [(a, b), *found]


def _table(left: list[Folded], right: list[Folded]) -> tuple[int, list[tuple[Folded, Folded]]]:
    """The best match of two rows of siblings, whose pairs keep their order."""
    rows, cols = len(left), len(right)
    best = [[(0, None)] * (cols + 1) for _ in range(rows + 1)]
    for i in range(1, rows + 1):
        for j in range(1, cols + 1):
            n, pairs = match(left[i - 1], right[j - 1])
            options = [(best[i - 1][j][0], "up"), (best[i][j - 1][0], "left"), (best[i - 1][j - 1][0] + n, pairs)]
            best[i][j] = max(options, key=lambda o: o[0]) if n else max(options[:2], key=lambda o: o[0])
    pairs, i, j = [], rows, cols
    while i and j:
        step = best[i][j][1]
        if step == "up" or step is None and i > 0 and best[i - 1][j][0] == best[i][j][0]:
            i -= 1
        elif step == "left" or step is None:
            j -= 1
        else:
            pairs[:0] = step
            i, j = i - 1, j - 1
    return best[rows][cols][0], pairs


def same_text(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Places of equal marks in two runs, in order: the longest rising row of pairs, where the n-th occurrence of a
    mark in one run goes with the n-th in the other."""
    if a == b:
        return [(i, i) for i in range(len(a))]
    places: defaultdict[int, deque[int]] = defaultdict(deque)
    for j, mark in enumerate(b):
        places[mark].append(j)
    pairs = [(i, places[mark].popleft()) for i, mark in enumerate(a) if places[mark]]
    ends: list[int] = []  # the least last place of a row of each length
    last: list[int] = []  # the pair that it belongs to
    before: list[int] = []
    for n, (_, j) in enumerate(pairs):
        size = bisect_left(ends, j)
        before.append(last[size - 1] if size else -1)
        ends[size : size + 1], last[size : size + 1] = [j], [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = before[n]
    return out[::-1]


def numbered(tree: Folded) -> dict[int, int]:
    """The number of the first member of every folded node, by its identity, in page order; the others follow it."""
    out: dict[int, int] = {}
    waiting, total = [tree], 0
    while waiting:
        node = waiting.pop()
        out[id(node)] = total
        total += len(node.nodes)
        waiting.extend(reversed(node.runs))
    return out


def _articles(root: Node) -> list[Node]:
    """The nodes that hold the article: article elements, else main elements, else the whole page."""
    for wanted in ("article", "main"):
        found, waiting = [], [root]
        while waiting:
            node = waiting.pop()
            if node.dropped:
                continue
            if node.name == wanted:
                found.append(node)
            else:
                waiting.extend(p for p in reversed(node.parts) if isinstance(p, Node))
        if found:
            return found
    return [root]


def main_text(root: Node, template: set[int]) -> str:
    """The blocks of the article, without dropped elements and the nodes whose identity is in ``template``."""
    blocks: list[str] = []

    def close(run: list[str]) -> None:
        block = " ".join("".join(run).split())
        if block:
            blocks.append(block)
        run.clear()

    def walk(node: Node, headings_only: bool) -> None:
        run: list[str] = []
        for part in node.parts:
            if isinstance(part, str):
                if not headings_only and id(node) not in template:
                    run.append(part)
                continue
            if part.name not in BLOCK:
                continue
            close(run)
            if part.dropped:
                continue
            # of a header inside the article only the headings belong to it
            inner = part.name == "header" or headings_only and part.name not in HEADINGS
            walk(part, inner)
        close(run)

    for article in _articles(root):
        outside = article.name == "html"
        if outside:
            article.parts = [p for p in article.parts if not (isinstance(p, Node) and p.name == "header")]
        walk(article, False)
    return "\n\n".join(blocks)


class _References:
    """Parsed reference pages of this worker."""

    def __init__(self) -> None:
        self.kept: dict[str, tuple[Folded, dict[int, int]]] = {}

    def get(self, source: str) -> tuple[Folded, dict[int, int]]:
        if source not in self.kept:
            if len(self.kept) >= KEPT:
                self.kept.clear()
            tree = Folded([parse(source)])
            self.kept[source] = tree, numbered(tree)
        return self.kept[source]


def _host(url: str):
    return F.coalesce(F.lower(F.regexp_extract(F.col(url), r"://([^/?#]*)", 1)), F.lit(""))


def _joined(rows: DataFrame, table: DataFrame, size: int) -> DataFrame:
    """Rows with what the table has for their host; sent to all executors if it is small."""
    return rows.join(F.broadcast(table) if size <= BROADCAST_BYTES else table, "host", "left")


def extract_text(pages: DataFrame, *, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """``(key, url, text, n_chars)`` per row: the article's blocks, joined by an empty line.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles, comments of readers and hidden
    elements are left out, by their elements and the words in their classes, ids and roles, as are nodes that
    the host's pages have in common, inside an article too. What holds an article, a main element or half of the page's
    text is never left out for its class, nor is a form or header around it; inside an article a class must say
    nothing but such a word, and paragraphs and headings stay. Inside an article's header headings stay. Texts of any
    length are read whole; elements more than ``DEEPEST`` deep stand beside each other. White space within a block is one
    space; character references are decoded. Null and empty pages have an empty text. Pages with a null URL are
    one host. A host with few differing pages has no template. Repeated rows are extracted each, and copies of
    the reference page prove nothing about the template. Other columns are not read.
    """
    kind = dict(pages.dtypes)[key]
    rows = pages.select(
        F.col(key).alias("key"), F.col(url).alias("url"), F.col(source).alias("html"), _host(url).alias("host")
    )
    real = rows.where("html is not null and html <> ''")
    references = written(
        real.groupBy("host").agg(F.min(F.struct(F.xxhash64("html").alias("h"), "html")).alias("r")).select(
            "host", F.col("r.html").alias("reference")
        ),
        "references",
    )
    size = references.agg(F.sum(F.octet_length("reference") + F.octet_length("host"))).first()[0] or 0
    trees = _References()

    def compare(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: Counter = Counter()
        for host, page, other in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference"))):
            if page == other:
                continue
            reference, numbers = trees.get(other)
            for a, b in match(reference, Folded([parse(page)]))[1]:
                same = {i for i, _ in same_text(a.marks, b.marks)}
                for i in range(len(a.nodes)):
                    seen[host, numbers[id(a)] + i, i in same] += 1
        hosts, nodes, same = zip(*seen) if seen else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(hosts, pa.string()), pa.array(nodes, pa.int32()), pa.array(same, pa.bool_()),
             pa.array(seen.values(), pa.int64())],
            names=["host", "node", "same", "n"],
        )

    counted = arrow_map(
        _joined(real.select("host", "html"), references, size), compare, "host string, node int, same boolean, n long"
    ).groupBy("host", "node").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("same"), F.col("n")).otherwise(0)).alias("eq"))
    constant = counted.where(f"n >= {LEAST_PAGES} and eq >= {SAME} * n").groupBy("host").agg(
        F.collect_list("node").alias("constant")
    )
    wrappers = written(references.join(constant, "host", "left"), "wrappers")

    def extract(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for page, other, constant in zip(*(batch.column(c).to_pylist() for c in ("html", "reference", "constant"))):
            if not page:
                texts.append("")
                continue
            root, template = parse(page), set()
            if constant:
                reference, numbers = trees.get(other)
                fixed = set(constant)
                for a, b in match(reference, Folded([root]))[1]:
                    for i, j in same_text(a.marks, b.marks):
                        if numbers[id(a)] + i in fixed:
                            template.add(id(b.nodes[j]))
            texts.append(main_text(root, template))
        return pa.RecordBatch.from_arrays(
            [batch.column("key"), batch.column("url"), pa.array(texts, pa.string()),
             pa.array(list(map(len, texts)), pa.int64())],
            names=["key", "url", "text", "n_chars"],
        )

    full = _joined(rows, wrappers, size)
    out = arrow_map(full, extract, f"key {kind}, url string, text string, n_chars long")
    return out.withColumnRenamed("key", key).withColumnRenamed("url", url)
