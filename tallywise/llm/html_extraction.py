"""Main text of web pages by wrapper induction.

Pages of one host come from one template. All of them are aligned as trees by simple tree
matching, which gives the path of the slot that holds the article. Texts that stand at one path on
nearly all pages of the host, counted over all of them, belong to the template. The wrapper is then
applied to every page of the host; a template node drops only where its text is the template's.
"""

from __future__ import annotations

import hashlib
import html as entities
import json
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.workspace import ship_package, stored
from .buffers import slices
from .shared import PARTS, small

# A text at one path belongs to the template if so many different pages of the host have it, and this share.
TEMPLATE_PAGES, TEMPLATE_SHARE = 3, 0.9
# Wrappers are a few kB; up to so many hosts they are broadcast, else pages meet them by host.
BROADCAST_HOSTS = 10_000

# Element names of HTML by their role in parsing and in pages.
_VOID = set("area base br col embed hr img input link meta param source track wbr".split())
_RAW = set("script style noscript template textarea title iframe svg math object".split())
_BLOCK = set(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol option p pre section summary table tbody td "
    "tfoot th thead title tr ul".split()
)
_ENDS_PARAGRAPH = _BLOCK - set("br body html option td th tr tbody thead tfoot title caption legend".split())
_ENDS_LIKE = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_APART = set("nav footer aside form button select menu dialog head label fieldset".split())
_PROSE = set("article main body html h1 h2 h3 h4 h5 h6 p li ul ol blockquote pre table tbody tr td th dl dt dd figure".split())
_PROSE_ONLY = _PROSE - {"article", "main", "body", "html"}
# At the beginning of a class or id; a later part often tells of a layout (has-sidebar, page-with-menu).
_APART_NAMES = re.compile(
    r"(?:ads?|advert\w*|sponsor\w*|promo\w*|banner|cookies?|consent|notices?|popup|modal|newsletter|subscribe|"
    r"sidebar|nav|navbar|navigation|menu|breadcrumbs?|footer|masthead|comments?|respond|replies|share|sharing|social|"
    r"related|recommended|widget|login|search|toolbar|skip|hidden)(?:$|[_-])",
    re.I,
)
# Whether a node stands apart from any main text: no, by its name or as a form (unless it holds most of the
# main text, as layouts and forms around a whole page do), or in any case.
_IN, _BY_NAME, _APART_ALWAYS = 0, 1, 2
_APART_ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "dialog", "form", "menu"}
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<[a-zA-Z/][^<>]*\Z|[^<]+|<",
    re.S,
)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")


@lru_cache(maxsize=100_000)
def _described(tag: str, attributes: str) -> tuple[str, int]:
    """A node's label (element and first class) and whether it stands apart from any main text."""
    found = {}
    for name, a, b, c, bare in _ATTRIBUTE.findall(attributes):
        found.setdefault((name or bare).lower(), a or b or c)
    classes = found.get("class", "").split()
    label = f"{tag}.{classes[0]}" if classes else tag
    names = [*classes, *found.get("id", "").split()]
    named = tag not in ("html", "body", "article", "main") and any(map(_APART_NAMES.match, names))
    if (
        (tag in _APART and tag not in ("form", "fieldset"))
        or found.get("role", "").lower() in _APART_ROLES
        or "hidden" in found
        or found.get("aria-hidden") == "true"
    ):
        return label, _APART_ALWAYS
    return label, _BY_NAME if named or tag in ("form", "fieldset") else _IN


def _tokens(page: str) -> Iterator[tuple[str, str, str]]:
    """("open", tag, attributes), ("close", tag, "") and ("text", characters, "")."""
    at, low = 0, None
    while at < len(page):
        match = _TOKEN.match(page, at)
        at = match.end()
        tag = match[2]
        if tag is None:
            if page[match.start()] != "<" or match.end() == match.start() + 1:
                yield "text", match[0], ""
            continue
        tag = tag.lower()
        if match[1]:
            yield "close", tag, ""
            continue
        if tag in _RAW:
            # Nothing in these counts as text; their content ends with their own end tag.
            if not match[3].endswith("/"):
                low = page.lower() if low is None else low
                end = low.find(f"</{tag}", at) if len(low) == len(page) else page.find(f"</{tag}", at)
                close = page.find(">", end) if end >= 0 else -1
                at = close + 1 if close >= 0 else len(page)
            continue
        yield "open", tag, match[3]


class _Stack:
    """Open elements, with the end tags that HTML lets pages leave out."""

    def __init__(self):
        self.tags: list[str] = []

    def closing(self, tag: str) -> int:
        """How many elements stay open when ``tag`` begins."""
        tags = self.tags
        if tag in _ENDS_PARAGRAPH:
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] == "p":
                    return i
                if tags[i] in _BLOCK:
                    break
        if tag in _ENDS_LIKE:
            alike, until = _ENDS_LIKE[tag]
            keep = len(tags)
            for i in range(len(tags) - 1, -1, -1):
                if tags[i] in until:
                    break
                if tags[i] in alike:
                    keep = i
            return keep
        return len(tags)

    def ending(self, tag: str) -> int:
        """How many elements stay open after the end tag; a stray end tag ends nothing."""
        for i in range(len(self.tags) - 1, -1, -1):
            if self.tags[i] == tag:
                return i
        return len(self.tags)


class Node:
    """An element of a page tree: label, whether it stands apart, own text and its length, children."""

    __slots__ = ("label", "apart", "texts", "chars", "children")

    def __init__(self, label: str, apart: int = _IN, chars: int = 0):
        self.label, self.apart, self.texts, self.chars, self.children = label, apart, [], chars, []


def tree_of(page: str) -> Node:
    """The page as a tree in which neighbours of one label are one node, as items of a list are."""
    root = Node("")
    nodes, stack = [root], _Stack()
    for kind, value, attributes in _tokens(page):
        if kind == "text":
            if text := " ".join(value.split()):
                nodes[-1].texts.append(text)
                nodes[-1].chars += len(text)
            continue
        keep = stack.closing(value) if kind == "open" else stack.ending(value)
        del stack.tags[keep:], nodes[keep + 1 :]
        if kind == "open" and value not in _VOID:
            label, apart = _described(value, attributes)
            siblings = nodes[-1].children
            if not (siblings and (siblings[-1].label, siblings[-1].apart) == (label, apart)):
                siblings.append(Node(label, apart))
            stack.tags.append(value)
            nodes.append(siblings[-1])
    return root


def align(a: Node, b: Node) -> tuple[int, list[tuple[Node, Node]]]:
    """Simple tree matching: the most nodes that can be paired keeping order and ancestry, and the pairs."""
    if a.label != b.label:
        return 0, []
    # Children without a partner of their label take no part.
    labels = {c.label for c in b.children}
    left_children = [c for c in a.children if c.label in labels]
    labels = {c.label for c in left_children}
    right_children = [c for c in b.children if c.label in labels]
    m, n = len(left_children), len(right_children)
    best = [[(0, None)] * (n + 1) for _ in range(m + 1)]
    for i in range(1, m + 1):
        for j in range(1, n + 1):
            up, left = best[i - 1][j], best[i][j - 1]
            choice = up if up[0] >= left[0] else left
            score, pairs = align(left_children[i - 1], right_children[j - 1])
            if score and best[i - 1][j - 1][0] + score > choice[0]:
                choice = (best[i - 1][j - 1][0] + score, (best[i - 1][j - 1][1], pairs))
            best[i][j] = choice
    total, chain = best[m][n]
    found = [(a, b)]
    while chain:
        chain, pairs = chain
        found += pairs
    return total + 1, found


def _merge(wrapper: Node, page: Node) -> None:
    """Fold a page into the wrapper: paired nodes are compared, others become optional nodes."""
    pairs = align(wrapper, page)[1]
    partner = {id(b): a for a, b in pairs}
    for a, b in pairs:
        a.chars += b.chars
        at = 0
        for child in b.children:
            if id(child) in partner:
                at = a.children.index(partner[id(child)]) + 1
            else:
                a.children.insert(at, child)
                at += 1


def _condensed(node: Node) -> Node:
    """The node with lengths for texts, in which all siblings of one label are one node, wherever they stand.

    What is told of a node is told of its path, so a tree need not grow with the blocks of an article.
    """
    whole = Node(node.label, node.apart, node.chars)
    pending = [(whole, [node])]
    while pending:
        into, alike = pending.pop()
        groups: dict[tuple[str, int], list[Node]] = {}
        for one in alike:
            for child in one.children:
                groups.setdefault((child.label, child.apart), []).append(child)
        for (label, apart), children in groups.items():
            into.children.append(Node(label, apart, sum(c.chars for c in children)))
            pending.append((into.children[-1], children))
    return whole


def _outline(tree: Node) -> tuple[str, list[int]]:
    """A tree as text, one line of depth, apartness and label per node, and the nodes' own lengths."""
    lines, lengths, pending = [], [], [(0, tree)]
    while pending:
        depth, node = pending.pop()
        lines.append(f"{depth} {node.apart} {node.label}")
        lengths.append(node.chars)
        pending += [(depth + 1, child) for child in reversed(node.children)]
    return "\n".join(lines), lengths


def _tree_from(outline: str, lengths: list[int]) -> Node:
    above: list[Node] = []
    for line, chars in zip(outline.split("\n"), lengths):
        depth, apart, label = line.split(" ", 2)
        node = Node(label, int(apart), chars)
        del above[int(depth) :]
        if above:
            above[-1].children.append(node)
        above.append(node)
    return above[0]


def _digest(texts: list[str]) -> str:
    return hashlib.blake2b("\n".join(texts).encode("utf-8", "surrogatepass"), digest_size=12).hexdigest()


def leaves(page: str) -> dict[str, str]:
    """Digests of texts that may be template, by path: of nodes without children that are no prose and in no article."""
    found: dict[str, list[str]] = {}
    inner: set[str] = set()

    def visit(node: Node, path: str) -> None:
        tag = node.label.partition(".")[0]
        if node.apart == _APART_ALWAYS or tag in ("article", "main"):
            return
        if node.children:
            inner.add(path)
        elif node.texts and tag not in _PROSE:
            found.setdefault(path, []).extend(node.texts)
        for child in node.children:
            visit(child, f"{path}/{child.label}")

    visit(tree_of(page), "")
    return {path: _digest(texts) for path, texts in found.items() if path and path not in inner}


def constants(pages: list[str]) -> dict[str, str]:
    """The template of different pages: digests of texts by path, as ``templates`` counts them for hosts."""
    counts = Counter(item for page in pages for item in leaves(page).items())
    enough = max(TEMPLATE_PAGES, TEMPLATE_SHARE * len(pages))
    return dict(item for item, n in counts.items() if n >= enough)


def _layouts(tree: Node) -> set[str]:
    """Paths of nodes that are apart by name yet hold most of the main text: of the articles, or else of all text."""

    def lengths(node: Node, path: str, inside: bool, notes: list) -> tuple[int, int]:
        """Length of text in articles that begin at or below a node, and of all text."""
        if node.apart == _APART_ALWAYS:
            return 0, 0
        marks = not inside and node.label.partition(".")[0] in ("article", "main")
        below = [lengths(c, f"{path}/{c.label}", inside, notes) for c in node.children]
        every = node.chars + sum(b for _, b in below)
        articles = sum(a for a, _ in below)
        if node.apart == _BY_NAME:
            notes.append((path, articles, every))
        return every if marks else articles, every

    notes: list[tuple[str, int, int]] = []
    articles, every = lengths(tree, "", False, notes)
    return {path for path, a, b in notes if (2 * a > articles if articles else 2 * b > every)}


def induce(pages: list[str], template: dict[str, str] | None = None) -> dict:
    """A wrapper of pages: the template (that of these pages if not given) and the path of the article's slot."""
    pages = list(dict.fromkeys(pages))
    if template is None:
        template = constants(pages)
    trees = [_condensed(tree_of(p)) for p in pages]
    for tree in trees[1:]:
        _merge(trees[0], tree)
    return _wrapper_of(trees[0] if trees else None, template)


def _wrapper_of(wrapper: Node | None, template: dict[str, str]) -> dict:
    """The wrapper that a host's merged tree tells."""
    if wrapper is None:
        return {"template": template, "slot": "", "layouts": []}
    slots, layouts = {}, _layouts(wrapper)

    def visit(node: Node, path: str, apart: bool, within: bool) -> int:
        """Length of text below that is not apart; notes candidates for the slot."""
        apart |= node.apart == _APART_ALWAYS or (node.apart == _BY_NAME and path not in layouts)
        tag = node.label.partition(".")[0]
        own, below = 0 if apart else node.chars, 0
        for c in node.children:
            below += visit(c, f"{path}/{c.label}", apart, within or tag in _PROSE_ONLY)
        if not apart:
            # Nodes of one path are one candidate; below prose there is none.
            held, prose = slots.get(path, (0, True))
            within |= tag in _PROSE_ONLY
            slots[path] = (held + own + below, prose and within)
        return own + below

    everything = visit(wrapper, "", False, False)
    marked = {p: v[0] for p, v in slots.items() if v[0] and p.rpartition("/")[2].partition(".")[0] in ("article", "main")}
    if marked:
        return {"template": template, "slot": max(marked, key=lambda p: (marked[p], -len(p))), "layouts": sorted(layouts)}
    # Without an article element: the lowest node, above prose, that holds all of the text;
    # what is template there drops from each page by its own text.
    whole = [p for p, (held, prose) in slots.items() if held == everything and not prose]
    slot = max(whole, key=lambda p: p.count("/")) if everything and whole else ""
    return {"template": template, "slot": slot, "layouts": sorted(layouts)}


def _dropped(page: str, template: dict[str, str]) -> frozenset:
    """The paths of a page whose text is the template's."""
    return frozenset(p for p, digest in leaves(page).items() if template.get(p) == digest) if template else frozenset()


def extract(page: str, wrapper: dict) -> str:
    """The main text: blocks in page order, joined by one space."""
    template, slot = _dropped(page, wrapper["template"]), wrapper["slot"]
    found = _texts(page, template, slot, frozenset(wrapper["layouts"]))
    # A page that lacks the host's slot is taken as a template of its own.
    if not found:
        own = induce([page], wrapper["template"])
        found = _texts(page, template, own["slot"], frozenset(own["layouts"]))
    return " ".join(" ".join(found).split())


def _texts(page: str, template: frozenset, slot: str, layouts: frozenset) -> list[str]:
    pieces: list[str] = []
    stack, paths = _Stack(), [("", not slot, False)]  # path, inside the slot, apart
    text: list[str] = []

    def end_block() -> None:
        if text:
            # Character references are decoded over the whole block.
            pieces.append(entities.unescape("".join(text)))
            text.clear()

    for kind, value, attributes in _tokens(page):
        if kind == "text":
            _, inside, apart = paths[-1]
            if inside and not apart:
                text.append(value)
            continue
        if value in _BLOCK:
            end_block()
        keep = stack.closing(value) if kind == "open" else stack.ending(value)
        del stack.tags[keep:], paths[keep + 1 :]
        if kind == "open" and value not in _VOID:
            label, apart = _described(value, attributes)
            above, inside, aside = paths[-1]
            path = f"{above}/{label}"
            stack.tags.append(value)
            aside |= apart == _APART_ALWAYS or (apart == _BY_NAME and path not in layouts) or path in template
            paths.append((path, inside or path == slot, aside))
    end_block()
    return pieces


@lru_cache(maxsize=4096)
def _loaded(wrapper: str) -> dict:
    return json.loads(wrapper)


def templates(pages: DataFrame, host_column: str = "host", html_column: str = "html") -> DataFrame:
    """Per host with a template, its paths and digests, counted over all pages; copies of a page count once."""
    rows = pages.select(host_column, F.xxhash64(html_column).alias("page"), F.col(html_column).alias("html"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = []
            for host, page, html in zip(*(c.to_pylist() for c in batch.columns)):
                # A row without a path counts the page.
                found += [(host, page, path, digest) for path, digest in [("", ""), *leaves(html).items()]]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*found), (pa.string(), pa.int64(), pa.string(), pa.string()))],
                ["host", "page", "path", "digest"],
            )

    held = rows.mapInArrow(run, "host string, page long, path string, digest string").distinct()
    counts = stored(held.groupBy("host", "path", "digest").agg(F.count(F.lit(1)).alias("n")), "leaves")
    total = counts.filter("path = ''").select("host", F.col("n").alias("pages"))
    often = counts.filter(f"path <> '' AND n >= {TEMPLATE_PAGES}").join(small(stored(total, "totals")), "host")
    often = often.filter(F.col("n") >= F.col("pages") * F.lit(TEMPLATE_SHARE))
    return often.groupBy("host").agg(F.collect_list(F.struct("path", "digest")).alias("template"))


def _page_trees(pages: DataFrame) -> DataFrame:
    """Host, page, outline and lengths of every page (host, page, html) that is not empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [_outline(_condensed(tree_of(html))) for html in batch.column(2).to_pylist()]
            outlines, lengths = [o for o, _ in found], [n for _, n in found]
            columns = [pa.array(outlines, pa.string()), pa.array(lengths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), *columns], ["host", "page", "outline", "lengths"]
            )

    return pages.filter("html <> ''").mapInArrow(run, "host string, page long, outline string, lengths array<long>")


def _merged_trees(trees: DataFrame) -> DataFrame:
    """One tree per host and part of its pages, aligned page by page in the order of their outlines.

    Copies of a page count once. Pages of one outline are added up before they are aligned, and
    a task holds one merged tree, whatever the number of pages.
    """
    dealt = trees.withColumn("part", F.pmod("page", F.lit(PARTS)).cast("int")).repartition("host", "part")
    dealt = dealt.sortWithinPartitions("host", "part", "outline", "page").select("host", "part", "outline", "page", "lengths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            outline, lengths = _outline(merged)
            columns = [[at[0]], [at[1]], [outline], [lengths]]
            kinds = (pa.string(), pa.int32(), pa.string(), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, kinds)], ["host", "part", "outline", "lengths"]
            )

        def add() -> Node:
            tree = _tree_from(alike, total)
            if merged is None:
                return tree
            _merge(merged, tree)
            return merged

        at, merged, alike, total, last = None, None, None, [], None
        for batch in batches:
            for host, part, outline, page, lengths in zip(*(c.to_pylist() for c in batch.columns)):
                if (host, part) == at and outline == alike:
                    if page != last:
                        total = [a + b for a, b in zip(total, lengths)]
                else:
                    if at is not None:
                        merged = add()
                    if (host, part) != at:
                        if at is not None:
                            yield done()
                        at, merged = (host, part), None
                    alike, total = outline, lengths
                last = page
        if at is not None:
            merged = add()
            yield done()

    return dealt.mapInArrow(run, "host string, part int, outline string, lengths array<long>")


def wrappers(pages: DataFrame, url_column: str = "url", html_column: str = "html") -> DataFrame:
    """One wrapper (JSON) per host with a page that is not empty: its template by ``templates``, its slot from all pages."""
    keyed = pages.select(
        host_of(url_column).alias("host"), F.xxhash64(html_column).alias("page"), F.col(html_column).alias("html")
    )
    template = stored(templates(keyed.select("host", "html"), "host", "html"), "templates")
    # At most PARTS trees per host.
    merged = stored(_merged_trees(_page_trees(keyed)), "trees")
    merged = merged.join(template, "host", "left").select("host", "part", "outline", "lengths", "template")

    def run(group: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [row for batch in group for row in zip(*(c.to_pylist() for c in batch.columns))]
        rows.sort(key=lambda row: row[1])
        trees = [_tree_from(row[2], row[3]) for row in rows]
        for tree in trees[1:]:
            _merge(trees[0], tree)
        template = {x["path"]: x["digest"] for x in rows[0][4] or []}
        wrapper = _wrapper_of(trees[0], template)
        yield pa.RecordBatch.from_arrays([pa.array([rows[0][0]]), pa.array([json.dumps(wrapper)])], ["host", "wrapper"])

    return merged.groupBy("host").applyInArrow(run, "host string, wrapper string")


def host_of(url_column: str) -> Column:
    """The host of a URL in lower case; empty where there is none."""
    authority = r"^\s*[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#\s]*)"
    return F.coalesce(F.lower(F.regexp_extract(F.col(f"`{url_column}`").cast("string"), authority, 1)), F.lit(""))


def extract_pages(
    pages: DataFrame, id_column: str = "page_id", url_column: str = "url", html_column: str = "html"
) -> DataFrame:
    """One row per row of ``pages``: id, url, ``text`` (empty if there is none) and ``n_chars``, its code points.

    Whole pages are read, broken and cut ones too. Pages without a host share one wrapper. Null
    and empty pages have an empty text; rows that repeat an id are extracted each on its own.
    """
    ship_package(pages.sparkSession)
    whole = pages.withColumn("__html", F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")))
    found = stored(wrappers(whole, url_column, "__html"), "wrappers")
    rows = pages.select(
        F.col(f"`{id_column}`").alias("id"),
        F.col(f"`{url_column}`").alias("url"),
        F.coalesce(F.col(f"`{html_column}`").cast("string"), F.lit("")).alias("html"),
        host_of(url_column).alias("host"),
    )
    if found.count() <= BROADCAST_HOSTS:
        matched = rows.join(F.broadcast(found), "host", "left")
    else:
        # A hot host's pages are dealt to PARTS tasks; every one has the host's wrapper.
        parts = F.explode(F.sequence(F.lit(0), F.lit(PARTS - 1)))
        part = F.pmod(F.xxhash64("id", "html"), F.lit(PARTS)).cast("int")
        matched = rows.withColumn("part", part).join(found.withColumn("part", parts), ["host", "part"], "left")
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())
            texts = [extract(page, _loaded(w or '{"template": {}, "slot": "", "layouts": []}')) for page, w in found]
            columns = [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [id_column, "url", "text", "n_chars"])

    matched = matched.select("id", F.col("url").cast("string").alias("url"), "html", "wrapper")
    return matched.mapInArrow(run, f"`{id_column}` {kind}, url string, text string, n_chars long")
