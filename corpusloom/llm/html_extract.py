"""Main text of web pages by wrapper induction.

The DOM tree of every page is folded (runs of like siblings become one node) and
aligned by simple tree matching with the merged tree of all pages of the same host.
Over all pages of the host, and over its pages of one layout (the same folded tree),
a node whose text never changes is part of the template; nodes whose text varies
are slots. The content region is the template
node that holds the varying text outside menus, adverts and the like; the text of
its slots is the page's content.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import written

#: Pages that must agree on a node's text, and differ elsewhere, before it counts as template.
SUPPORT = 5
#: Share of the varying text that lets an article or main element be the region.
REGION_SHARE = 0.5
#: Matched nodes that a process remembers between pages of like trees.
REMEMBERED = 1_000_000
#: Share of a page's text that makes an article or main element its principal one.
PRINCIPAL_SHARE = 0.3
#: Share of a page's text, where it has no principal element, above which a wrapper is not judged by its names.
WRAPPER_SHARE = 0.8

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big br cite code data del dfn em font i img ins kbd mark q ruby rb rp rt s samp small span "
    "strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset(("script", "style", "textarea", "title", "noscript", "iframe", "xmp"))
#: Elements that never hold main text.
DROPPED = frozenset(
    "head script style noscript template svg math iframe object canvas audio video form button select option textarea "
    "nav footer aside dialog menu".split()
)
#: Words in class, id and role that mark menus, headers, notices, adverts, forms and comments.
MARKS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent "
    "gdpr notice notices alert popup modal overlay newsletter subscribe subscription nav navbar navigation menu menus "
    "breadcrumb breadcrumbs masthead footer sidebar sidebars aside widget widgets related recommended recommendations "
    "share sharing social comment comments disqus reply replies responses search login signup signin toolbar pagination "
    "pager contentinfo complementary dialog".split()
)
#: Marks of a page's head that may also stand at the head of the article itself.
HEAD_MARKS = frozenset(("header", "topbar", "site"))
#: Marks that themes also give to wrappers of the whole page.
WEAK_MARKS = frozenset("sidebar sidebars widget widgets social header topbar site banner search login overlay modal".split())
#: Words that turn a name of several words into something else: it has no sidebar, is about menus, wraps the rest.
TURNING = frozenset("has no not with without category tag topic wrap wrapper of".split())
#: Blocks of running text: only a name that is a mark by itself counts there.
TEXT_BLOCKS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre dd dt td th figcaption".split())
HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
#: Start tags that end an open element of the second set.
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"},
    "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tr", "td", "th"}, "body": {"head"},
}
PARAGRAPH_ENDS = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 "
    "h6 header hgroup hr main menu nav ol p pre section summary table ul".split()
)
_SCOPES = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}}
# The last form is a tag with a quote that never closes: it ends at the next ``>``.
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S
)
_MARKED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_NAMES = re.compile(r"[^a-z0-9]+")


class Node:
    """``names``: the words of class, id and role without those that hold a digit; ``marks``: those of them that
    mark unwanted parts; ``plain``: the marks that are a name by themselves; ``kept``: not judged by its names."""

    __slots__ = ("tag", "names", "marks", "plain", "kept", "children", "fold")

    def __init__(self, tag: str, values: str = ""):
        self.tag, self.children, self.fold, self.kept = tag, [], None, False
        names, marks, plain = set(), set(), set()
        for value in values.lower().split():
            words = [w for w in _NAMES.split(value) if w]
            names.update(w for w in words if not any(c.isdigit() for c in w))
            found = [w for w in words if w in MARKS or w in HEAD_MARKS]
            if len(words) == 1:
                plain.update(found)
            if found and TURNING.isdisjoint(words):
                marks.update(found)
        self.names, self.marks, self.plain = frozenset(names), frozenset(marks), frozenset(plain)


def settle(root: Node) -> Node:
    """Marks what names do not decide: the way to the principal article or main element, or, in a page
    without one, the wrappers that hold nearly all of its text."""
    order, stack = [], [(root, None)]
    while stack:
        node, above = stack.pop()
        order.append((node, above))
        stack.extend((c, node) for c in node.children if not isinstance(c, str))
    size: dict[int, int] = {}
    for node, above in reversed(order):
        own = 0 if node.tag in RAW else sum(len(c.strip()) for c in node.children if isinstance(c, str))
        size[id(node)] = size.get(id(node), 0) + own
        if above is not None and (node.tag not in DROPPED or node.tag == "form"):
            size[id(above)] = size.get(id(above), 0) + size[id(node)]
    whole = size[id(root)]
    parents = {id(node): above for node, above in order}
    articles = [node for node, _ in order if node.tag in ("article", "main")]
    wanted = [node for node in articles if not node.marks & MARKS] or [node for node in articles if node.marks <= WEAK_MARKS]
    principal = max(wanted, key=lambda node: size[id(node)], default=None)
    if principal is not None and size[id(principal)] >= PRINCIPAL_SHARE * whole:
        at = principal
        while at is not None:
            at.kept = at.tag not in DROPPED or at.tag == "form"
            at = parents[id(at)]
    else:
        for node, _ in order:
            node.kept = (node.tag == "form" or bool(node.marks)) and node.marks <= WEAK_MARKS and size[id(node)] > WRAPPER_SHARE * whole
    return root


def parse(source: str) -> Node:
    """Tolerant DOM tree; the children of a node are nodes and strings."""
    root = Node("html")
    stack, at, end = [root], 0, len(source)
    for token in iter(lambda: _TOKEN.search(source, at), None):
        if token.start() > at:
            stack[-1].children.append(entities.unescape(source[at : token.start()]))
        at = token.end()
        name, closing, attributes = (token[2], token[1], token[3]) if token[2] else (token[5], token[4], token[6])
        if not name:
            continue
        tag = name.lower()
        if closing:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k].tag not in INLINE or stack[k].tag in _SCOPES.get(tag, ()):
                    break
            continue
        if tag in ("html", "body") and (tag == "html" or any(n.tag == "body" for n in stack)):
            continue
        if tag in PARAGRAPH_ENDS:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag not in INLINE:
                    break
        if tag in CLOSES:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in _SCOPES.get(tag, ()):
                    break
                if stack[k].tag in CLOSES[tag]:
                    del stack[k:]
        values = ""
        if attributes and not attributes.isspace():
            values = " ".join(a or b or c for a, b, c in _MARKED.findall(attributes))
        node = Node(tag, values)
        stack[-1].children.append(node)
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(source, at)
            inner, at = (source[at : close.start()], close.end()) if close else (source[at:], end)
            node.children.append(inner)
        elif tag not in VOID:
            stack.append(node)
    if at < end:
        stack[-1].children.append(entities.unescape(source[at:]))
    return settle(root)


def unwanted(node: Node, inside: bool) -> bool:
    """Whether the element is a menu, advert, form or the like; ``inside``: of an article or main element.

    Names are evidence only: they do not speak against the way to the page's
    principal element, nor, in running text, unless a name is a mark by itself.
    """
    if node.kept:
        return False
    if node.tag in ("html", "body"):
        return False
    if node.tag in ("article", "main"):
        return bool(node.marks & MARKS)
    marks = node.plain if inside and node.tag in TEXT_BLOCKS else node.marks
    if node.tag in DROPPED or marks & MARKS:
        return True
    return not inside and (node.tag == "header" or bool(node.marks & HEAD_MARKS))


class Fold:
    """Runs of like siblings as one node, numbered in document order."""

    __slots__ = ("label", "children", "number", "text", "bad", "tag")

    def __init__(self, label: str, tag: str, bad: bool):
        self.label, self.tag, self.bad, self.children, self.text, self.number = label, tag, bad, [], [], 0


def _own(node: Node, text: list[str], below: list[Node]) -> None:
    """The text of a block and the blocks in it, also through inline elements."""
    stack: list = list(reversed(node.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            text.append(child)
        elif child.tag in INLINE and not unwanted(child, True):
            stack.extend(reversed(child.children))
        else:
            below.append(child)


def _like(a: Node, b: Node) -> bool:
    return (a.tag, a.names, a.marks, a.plain, a.kept) == (b.tag, b.names, b.marks, b.plain, b.kept)


def fold(members: list[Node]) -> Fold:
    top = Fold("", "", False)
    stack = [(top, members, False, False)]
    while stack:
        above, members, inside, bad = stack.pop()
        first = members[0]
        inside = inside or first.tag in ("article", "main")
        out = Fold(first.tag + "." + ".".join(sorted(first.names)), first.tag, bad or unwanted(first, inside))
        above.children.append(out)
        below: list[Node] = []
        for node in members:
            node.fold = out
            _own(node, out.text, below)
        if out.bad:
            continue
        runs, k = [], 0
        while k < len(below):
            run = k
            while run < len(below) and _like(below[run], below[k]):
                run += 1
            runs.append((out, below[k:run], inside, out.bad))
            k = run
        stack.extend(reversed(runs))
    return top.children[0]


def listed(tree: Fold) -> list[Fold]:
    out, stack = [], [tree]
    while stack:
        node = stack.pop()
        node.number = len(out)
        out.append(node)
        stack.extend(reversed(node.children))
    return out


def skeleton(tree: Fold) -> str:
    out, stack = [], [tree]
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            out.append(item)
            continue
        out.append(item.label)
        if item.children:
            stack.append(")")
            for k, child in enumerate(reversed(item.children)):
                stack += [" ", child] if k else [child]
            stack.append("(")
    return "".join(out)


def unfolded(text: str) -> Fold:
    """The tree of a skeleton."""
    root = Fold("", "", False)
    stack = [root]
    for part in re.findall(r"[()]|[^() ]+", text):
        if part == "(":
            stack.append(stack[-1].children[-1])
        elif part == ")":
            stack.pop()
        else:
            stack[-1].children.append(Fold(part, part.split(".")[0], False))
    return root.children[0]


def simple_tree_matching(one: Fold, other: Fold) -> dict[int, int]:
    """Largest matching of two ordered trees that keeps parents and order: numbers of one to numbers of other."""
    known: dict[tuple[int, int], tuple[int, list]] = {}

    stack = [(one, other, False)]
    while stack:
        a, b, ready = stack.pop()
        if a.label != b.label or (a.number, b.number) in known:
            continue
        if not ready:
            stack.append((a, b, True))
            stack.extend((c, d, False) for c in a.children for d in b.children if c.label == d.label)
            continue
        m, n = len(a.children), len(b.children)
        best = [[0] * (n + 1) for _ in range(m + 1)]
        for i in range(1, m + 1):
            for j in range(1, n + 1):
                below = known.get((a.children[i - 1].number, b.children[j - 1].number), (0,))[0]
                best[i][j] = max(best[i - 1][j], best[i][j - 1], best[i - 1][j - 1] + below)
        pairs, i, j = [], m, n
        while i and j:
            if best[i][j] == best[i - 1][j]:
                i -= 1
            elif best[i][j] == best[i][j - 1]:
                j -= 1
            else:
                pairs.append((a.children[i - 1], b.children[j - 1]))
                i, j = i - 1, j - 1
        known[a.number, b.number] = (best[m][n] + 1, pairs)
    out, todo = {}, [(one, other)] if one.label == other.label else []
    while todo:
        a, b = todo.pop()
        out[a.number] = b.number
        todo.extend(known[a.number, b.number][1])
    return out


def merge(base: Fold, other: Fold) -> None:
    """Adds to ``base`` the nodes of ``other`` that match none of its own, after the siblings before them."""
    nodes = listed(base)
    own = listed(other)
    found = {number: nodes[k] for number, k in simple_tree_matching(other, base).items()}
    for node in own:
        if node.number not in found:
            continue
        into, at = found[node.number].children, 0
        for child in node.children:
            if child.number in found:
                at = next(k for k, c in enumerate(into) if c is found[child.number]) + 1
            else:
                into.insert(at, child)
                at += 1


_ALIGNED: dict[tuple[bytes, bytes], dict[int, int]] = {}


def aligned(tree: Fold, reference: str) -> dict[int, int]:
    key = tuple(xxhash.xxh3_128_digest(x.encode("utf-8", "surrogatepass")) for x in (skeleton(tree), reference))
    if key not in _ALIGNED:
        other = unfolded(reference)
        listed(other)
        found = simple_tree_matching(tree, other)
        if sum(map(len, _ALIGNED.values())) + len(found) > REMEMBERED:
            _ALIGNED.clear()
        _ALIGNED[key] = found
    return _ALIGNED[key]


def _masses(tree: Fold, mass: dict[int, int]) -> dict[int, int]:
    """Of every node, the varying text in it and below it that is not in unwanted elements."""
    out: dict[int, int] = {}
    for node in reversed(listed(tree)):
        out[node.number] = 0 if node.bad else mass.get(node.number, 0) + sum(out[c.number] for c in node.children)
    return out


def region(tree: Fold, mass: dict[int, int]) -> list[int]:
    """Numbers of the nodes that hold the main text: the articles or main elements with enough of the
    varying text, or else the lowest node that holds all of it."""
    masses = _masses(tree, mass)
    total = masses[tree.number]
    tops, stack = [], [tree]
    while stack:
        node = stack.pop()
        if node.bad:
            continue
        if node.tag in ("article", "main"):
            tops.append(node)
        else:
            stack.extend(reversed(node.children))
    if tops and sum(masses[t.number] for t in tops) >= REGION_SHARE * total:
        return [t.number for t in tops]
    node = tree
    while True:
        full = [c for c in node.children if masses[c.number]]
        if len(full) != 1 or mass.get(node.number, 0) or full[0].tag in ("p", "ul", "ol", "table", "pre", "blockquote"):
            return [node.number]
        node = full[0]


def content(tree: Node, nodes: list[Fold], regions: set[int], template: set[int]) -> str:
    """Blocks of the regions in page order, without unwanted elements and template nodes.

    A heading of an article or main element is content, also if many pages have it.
    """
    blocks: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            blocks.append(text)

    stack: list = [(tree, False, False)]
    while stack:
        item, within, article = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if within:
                line.append(item)
        elif item.tag == "br":
            line.append(" ")
        elif item.tag in INLINE:
            if not unwanted(item, True):
                stack.extend((c, within, article) for c in reversed(item.children))
        else:
            own = item.fold
            if own is None or own.bad:
                continue
            within = within or own.number in regions
            article = within and (article or item.tag in ("article", "main"))
            flush()
            stack.append((None, within, article))
            if own.number in template and not (article and item.tag in HEADINGS):
                stack.extend((c, within, article) for c in reversed(item.children) if not isinstance(c, str) and c.tag not in INLINE)
            else:
                stack.extend((c, within, article) for c in reversed(item.children))
    flush()
    return "\n\n".join(blocks)


def _hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) >> 1


def _texts(nodes: list[Fold]) -> list[str]:
    return [" ".join("".join(n.text).split()) for n in nodes]


def _skeletons(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pairs = zip(*(batch.column(n).to_pylist() for n in ("host", "html")), strict=True)
        found = sorted({(host, skeleton(fold([parse(source)]))) for host, source in pairs if source})
        yield pa.RecordBatch.from_arrays(
            [pa.array([f[k] for f in found], pa.string()) for k in range(2)], ["host", "reference"]
        )


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The merged tree of each host, of rows that come sorted by host and tree."""
    host, tree = None, None

    def row() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([host], pa.string()), pa.array([skeleton(tree)], pa.string())], ["host", "reference"])

    for batch in batches:
        for name, reference in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if tree is not None and name == host:
                merge(tree, unfolded(reference))
                continue
            if tree is not None:
                yield row()
            host, tree = name, unfolded(reference)
    if tree is not None:
        yield row()


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with the hash of the page's folded tree."""
    for batch in batches:
        found = [_hash(skeleton(fold([parse(source or "")]))) for source in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.int64())], [*batch.schema.names, "layout"])


def _observe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the batch's pages show of each node of a layout (or of the host's merged tree: layout -1):
    pages, least and greatest text hash, least and greatest page hash."""
    for batch in batches:
        seen: dict[tuple[str, int, int], list[int]] = {}
        for host, source, reference in zip(*(batch.column(n).to_pylist() for n in ("host", "html", "reference")), strict=True):
            tree = fold([parse(source or "")])
            nodes = listed(tree)
            match, page, layout = aligned(tree, reference), _hash(source or ""), _hash(skeleton(tree))
            for node, text in zip(nodes, _texts(nodes), strict=True):
                if not text or node.bad:
                    continue
                value = _hash(text)
                for key in ((host, -1, match.get(node.number)), (host, layout, node.number)):
                    if key[2] is None:
                        continue
                    row = seen.setdefault(key, [0, value, value, page, page])
                    row[0] += 1
                    row[1], row[2] = min(row[1], value), max(row[2], value)
                    row[3], row[4] = min(row[3], page), max(row[4], page)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in seen], pa.string())] + [pa.array([k[c] for k in seen], pa.int64()) for c in (1, 2)]
            + [pa.array([v[c] for v in seen.values()], pa.int64()) for c in range(5)],
            ["host", "layout", "node", "pages", "low", "high", "first_page", "last_page"],
        )


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = []
        columns = (batch.column(n).to_pylist() for n in ("html", "reference", "constant", "own"))
        for source, reference, constant, own in zip(*columns, strict=True):
            root = parse(source or "")
            tree = fold([root])
            nodes = listed(tree)
            match = aligned(tree, reference) if reference else {}
            fixed = set(constant or ())
            template = {n for n, r in match.items() if r in fixed} | set(own or ())
            mass = {n.number: len(t) for n, t in zip(nodes, _texts(nodes), strict=True) if t and n.number not in template}
            texts.append(content(root, nodes, set(region(tree, mass)), template))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string())], ["page_id", "url", "text"]
        )


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", support: int = SUPPORT) -> DataFrame:
    """One row per input row: page_id, url, text (empty if none), n_chars (code points).

    A host is the lower-cased name in the url (empty for a null url or one
    without a host). The folded trees of its pages are merged, first within
    tasks and then by host; every page is aligned with the merged tree, and what
    the pages show of each of its nodes, and of each node of their own layout,
    is added up before the shuffle, so a host with a third of all pages costs
    one row per batch and node. A node's text is template when at least
    ``support`` pages that differ elsewhere all have it: all pages of the host
    that have the node, or all pages of the layout.

    Class, id and role names that mark menus, adverts, comments and the like are
    evidence against an element, but not on the way to the principal article or
    main element, not in a name that turns them ("has-sidebar", "menu-of-the-day")
    and, in running text, only as a whole name. Words with digits in names are
    left out, so ids of single pages do not make layouts of their own.

    Null and empty html give an empty text. Repeated rows are pages of their
    own. An empty table gives an empty result. Other columns are not read.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col(url), F.lit("")), r"^[^:/?#]*:?//([^/?#]*)", 1))
    rows = pages.select(
        F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).cast("string").alias("html"), host.alias("host")
    )
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    tree = "host string, reference string"
    skeletons = written(rows.select("host", "html").mapInArrow(_skeletons, tree).distinct(), "skeletons")

    def merged(trees: DataFrame) -> DataFrame:
        return trees.sortWithinPartitions("host", "reference").mapInArrow(_merged, tree)

    # First in parts chosen by the tree, so that the result does not depend on the order of the rows.
    references = written(merged(merged(skeletons.repartition("host", "reference")).repartition("host")), "references")
    names = ("layout", "node", "pages", "low", "high", "first_page", "last_page")
    observed = (
        rows.join(references, "host")
        .select("host", "html", "reference")
        .mapInArrow(_observe, "host string, " + ", ".join(f"{n} bigint" for n in names))
        .groupBy("host", "layout", "node")
        .agg(F.sum("pages").alias("pages"), F.min("low").alias("low"), F.max("high").alias("high"),
             F.min("first_page").alias("first_page"), F.max("last_page").alias("last_page"))
    )
    constant = written(
        observed.where((F.col("low") == F.col("high")) & (F.col("pages") >= support) & (F.col("first_page") != F.col("last_page")))
        .groupBy("host", "layout").agg(F.collect_list("node").alias("constant")),  # at most the nodes of one tree
        "constant",
    )
    wrappers = written(references.join(constant.where("layout = -1").drop("layout"), "host", "left"), "wrappers")
    laid_out = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", layout bigint"
    out = (
        rows.mapInArrow(_layouts, laid_out)
        .join(wrappers, "host", "left")
        .join(constant.where("layout <> -1").withColumnRenamed("constant", "own"), ["host", "layout"], "left")
        .select("page_id", "url", "html", "reference", "constant", "own")
        .mapInArrow(_extract, f"page_id {kinds['page_id']}, url {kinds['url']}, text string")
    )
    return out.select(
        F.col("page_id").alias(page_id), F.col("url").alias(url), "text", F.char_length("text").cast("bigint").alias("n_chars")
    )
