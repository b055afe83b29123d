"""Main text of pages by wrapper induction.

Pages of one host share a wrapper. Every page is parsed once, into its blocks of text and its
layout, the tree of its elements. The different layouts of each host are aligned, in parts and
then the parts, by simple tree matching (the largest set of node pairs that keeps order and
parents); aligned nodes become one node of the wrapper. Then each layout is aligned with its
host's wrapper, which gives each of its nodes a slot, and each slot's texts are counted over all
pages of the host: a text that most pages have in the slot is template, one that varies is
content. A page's text is that of its content blocks, without what lies in navigation, header,
footer, sidebar, notice, advert, form or comment nodes, which are told by element, role, and
class or id.

A text is template on evidence only: at least three different pages of the host hold it in its slot,
and most of those with the slot. Nothing inside an article or main element is template, and nothing is
dropped from a page of which it would be more than half, both of its blocks and of its text: that
is how near copies look, and then the text is theirs.

Brothers of one kind in a row (paragraphs, list items) count as one repeated layout node, so a
wrapper has tens of nodes however long the pages are.

A class, id or role names what a node is by its whole name, and outside the article by its first or
last part too (`site-footer`, but not `no-sidebar`, nor an article's `side-effects`); header words count outside the article only. Such a node, and a form, is
part of the article after all if it holds more than half of the page's text and no article or
main element lies outside it; one named for comments, only if it holds the page's first heading too.

Rows: null html is empty and gives no text. A null url is a host of its own, ''. Copies of a page
count once when texts are counted. Elements may be nested as deep as they come. Columns of the
input other than html are kept; text and n_chars replace columns of these names.
"""

from __future__ import annotations

import hashlib
import re
import sys
from collections import Counter
from collections.abc import Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from hearthline.llm.memory import released
from hearthline.storage import written

SALTS = 64  # parts of a host's layouts that are merged apart, and of its pages in a shuffled join
CONSTANT_SHARE = 0.6  # of a host's pages with a slot, the share with one text that makes it template
CONSTANT_PAGES = 3  # different pages that must hold it
MOST_TEMPLATE = 0.5  # of a page's blocks or text that may be template
WRAPPER_BYTES = 32 << 20  # of all wrappers together to be broadcast; beyond that they are joined
DEEPEST = 1_000_000  # calls that alignment may nest, each of them on the heap

#: Fixed element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr param".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes".split())
DROPPED = frozenset("script style noscript template head title nav footer aside button select option textarea input iframe svg math canvas object embed audio video dialog menu label legend".split())
BLOCK = frozenset("html body main article section div p h1 h2 h3 h4 h5 h6 ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption header hgroup address center details summary hr form fieldset nav footer aside".split())
CLOSES_P = BLOCK - {"html", "body"}
ITEMS = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}}
#: Fixed class and id words of what is not the article.
ASIDE_WORDS = frozenset("nav navbar navigation menu menubar footer foot sidebar side aside ad ads adv advert adverts advertisement advertising banner promo sponsor sponsored cookie cookies consent notice notices notification alert popup modal overlay subscribe subscription newsletter signup login share sharing social breadcrumb breadcrumbs pagination pager related recommended widget toolbar topbar skip search copyright legal disclaimer tags toc".split())
HEADER_WORDS = frozenset("header masthead".split())
COMMENT_WORDS = frozenset("comment comments reply replies respond discussion disqus".split())
NEGATIONS = frozenset("no not non without has with".split())
ASIDE_ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog alertdialog menu menubar toolbar".split())
MAIN = frozenset("article main".split())

_markup = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*+>)|<[!?][^>]*+>", re.DOTALL
)
_attribute = re.compile(r"([^\s\"'<>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_name = re.compile(r"[^\s]+")
_letters = re.compile(r"[a-z]+")
_wanted = frozenset("class id role hidden aria-hidden style".split())


class Page:
    """A parsed page: its elements by number in page order (0 is the root), and its events: an
    element opens (its number), closes (the number's complement), or has text (a string)."""

    def __init__(self, html: str | None):
        self.tags, self.parents, self.kinds = ["#root"], [-1], ["#root."]
        self.names: list[list[str]] = [[]]
        self.roles, self.hidden = [""], [False]
        self.events: list[int | str] = []
        self._parse(html or "")

    def _parse(self, html: str) -> None:
        at, open_, count, events = 0, [0], Counter(), self.events

        def close_to(k: int) -> None:
            while len(open_) > k:
                events.append(~open_[-1])
                count[self.tags[open_.pop()]] -= 1

        def close(tag: str, within) -> None:
            if count[tag]:
                for k in range(len(open_) - 1, 0, -1):
                    name = self.tags[open_[k]]
                    if name == tag:
                        return close_to(k)
                    if name in within:
                        return None

        while (m := _markup.search(html, at)) is not None:
            if m.start() > at:
                text = html[at : m.start()]
                events.append(unescape(text) if "&" in text else text)
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                close(tag, ())
                continue
            if tag == "br":
                events.append(" ")
                continue
            if tag in CLOSES_P:
                close("p", CLOSES_P - {"p", "center"})
            if tag in ITEMS:
                close(tag, ITEMS[tag])
            self._element(tag, m[3], open_[-1])
            k = len(self.tags) - 1
            events.append(k)
            if tag in VOID:
                events.append(~k)
                continue
            open_.append(k)
            count[tag] += 1
            if tag in RAW:  # no markup within
                end = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.IGNORECASE).search(html, at)
                stop = end.start() if end else len(html)
                if tag not in DROPPED and stop > at:
                    events.append(html[at:stop])
                at = stop
        if at < len(html):
            events.append(unescape(html[at:]))
        close_to(1)

    def _element(self, tag: str, attrs: str, parent: int) -> None:
        found = {}
        if len(attrs) > 1:
            for m in _attribute.finditer(attrs):
                name = m[1].lower()
                if name in _wanted and name not in found:
                    found[name] = unescape(m[2] or m[3] or m[4] or "").lower()
        names = _name.findall(f"{found.get('class', '')} {found.get('id', '')}") if found else []
        self.tags.append(tag)
        self.parents.append(parent)
        self.names.append(names)
        self.kinds.append(f"{tag}.{'.'.join(sorted({x for name in names for x in _letters.findall(name)}))}" if names else f"{tag}.")
        self.roles.append(found.get("role", ""))
        self.hidden.append("hidden" in found or found.get("aria-hidden") == "true" or "display:none" in found.get("style", "").replace(" ", ""))

    def marks(self) -> tuple[list[bool], list[bool]]:
        """Of each element: whether it is no part of the article, and whether it lies in an
        article or main element."""
        n = len(self.tags)
        size, mains, head = [0] * n, [0] * n, [False] * n
        never = [False] * n
        for k in range(1, n):
            never[k] = never[self.parents[k]] or self.tags[k] in DROPPED or self.hidden[k]
        at = 0
        for e in self.events:
            if isinstance(e, int):
                at = e if e >= 0 else self.parents[~e]
            elif not never[at]:
                size[at] += len(e) - e.count(" ")
        first_head = next((k for k in range(1, n) if self.tags[k] == "h1"), 0)
        if first_head:
            head[first_head] = True
        for k in range(n - 1, 0, -1):  # children come after their parents
            mains[k] += self.tags[k] in MAIN or self.roles[k] == "main"
            up = self.parents[k]
            size[up] += size[k]
            mains[up] += mains[k]
            head[up] |= head[k]
        off, inside = [False] * n, [False] * n
        for k in range(1, n):
            up = self.parents[k]
            inside[k] = inside[up] or self.tags[k] in MAIN
            off[k] = off[up] or never[k] or self._aside(k, inside[up], 2 * size[k] > size[0] and mains[k] == mains[0], head[k])
        return off, inside

    def _aside(self, k: int, in_article: bool, most: bool, heading: bool) -> bool:
        tag = self.tags[k]
        if tag == "header":  # a page's header, not an article's
            return not in_article
        words = {w for name in self.names[k] for w in ([name] if in_article else _named(name))}
        if words & COMMENT_WORDS and tag not in ("html", "body", "main"):
            return not (most and heading)
        if tag in ("html", "body", "main", "article"):
            return False
        named = self.roles[k] in ASIDE_ROLES or words & ASIDE_WORDS or words & HEADER_WORDS and not in_article
        return not most and (tag in ("form", "fieldset") or bool(named))

    def blocks(self, place: list[int]) -> list[tuple[int, str, bool]]:
        """(layout node, text, in article) of each block of the article, in page order. place: the
        layout node of each element."""
        off, inside = self.marks()
        out: list[tuple[int, str, bool]] = []
        parts: list[str] = []
        first, at = -1, 0

        def flush() -> None:
            nonlocal first
            if first >= 0:
                text = " ".join("".join(parts).split())
                if text and not off[first]:
                    out.append((place[first], text, inside[first]))
            parts.clear()
            first = -1

        for e in self.events:
            if isinstance(e, str):
                parts.append(e)
                if first < 0 and not e.isspace():
                    first = at
                continue
            k = e if e >= 0 else ~e
            up = self.parents[k]
            if self.tags[k] in BLOCK or off[k] != off[up]:
                flush()
            at = k if e >= 0 else up
        flush()
        return out


def _named(name: str) -> Iterator[str]:
    """The words by which a class or id may name a node."""
    parts = re.split(r"[-_:]+", name)
    if not NEGATIONS & set(parts):
        yield name
        yield parts[0]
        yield parts[-1]


class Node:
    """A layout node. Once merged into another, `to` is that."""

    __slots__ = ("kind", "kids", "to", "number")

    def __init__(self, kind: str):
        self.kind = kind
        self.kids: list[Node] = []
        self.to: Node | None = None
        self.number = 0

    def end(self) -> "Node":
        at = self
        while at.to is not None:
            at = at.to
        if self.to is not None:
            self.to = at
        return at


def align(a: Node, b: Node, known: dict) -> tuple[int, list[tuple[int, int]]]:
    """Simple tree matching of two nodes of one kind: the number of matched pairs below and
    including them, and which children are matched, by a table over the two child lists."""
    key = (id(a), id(b))
    if key in known:
        return known[key]
    m, n = len(a.kids), len(b.kids)
    if not m or not n:
        known[key] = 1, []
        return known[key]
    kinds = [x.kind for x in a.kids]
    if kinds == [x.kind for x in b.kids] and len(set(kinds)) == m:
        total = 1
        for k in range(m):
            total += align(a.kids[k], b.kids[k], known)[0]
        known[key] = total, [(k, k) for k in range(m)]
        return known[key]
    worth = [[0] * n for _ in range(m)]
    for i in range(m):
        for j in range(n):
            if kinds[i] == b.kids[j].kind:
                worth[i][j] = align(a.kids[i], b.kids[j], known)[0]
    table = [[0] * (n + 1) for _ in range(m + 1)]
    for i in range(m - 1, -1, -1):
        for j in range(n - 1, -1, -1):
            best = table[i + 1][j] if table[i + 1][j] >= table[i][j + 1] else table[i][j + 1]
            both = table[i + 1][j + 1] + worth[i][j]
            table[i][j] = both if both > best else best
    pairs, i, j = [], 0, 0
    while i < m and j < n:
        if worth[i][j] and table[i][j] == table[i + 1][j + 1] + worth[i][j]:
            pairs.append((i, j))
            i, j = i + 1, j + 1
        elif table[i][j] == table[i + 1][j]:
            i += 1
        else:
            j += 1
    known[key] = 1 + table[0][0], pairs
    return known[key]


def merge(a: Node, b: Node, known: dict | None = None) -> None:
    """Makes a the tree that holds both: aligned nodes once, the others in order."""
    known = {} if known is None else known
    b.to = a
    if not a.kids or not b.kids:
        a.kids = a.kids or b.kids
        return
    left, right, out, i, j = a.kids, b.kids, [], 0, 0
    pairs = align(a, b, known)[1]
    for x, y in [*pairs, (len(left), len(right))]:
        out += left[i:x]
        out += right[j:y]
        if x < len(left):
            out.append(left[x])
        i, j = x + 1, y + 1
    a.kids = out
    for x, y in pairs:
        merge(left[x], right[y], known)


def layout(page: Page) -> tuple[str, list[int]]:
    """The layout of a page as text, and the layout node of each element."""
    nodes = [Node(kind) for kind in page.kinds]
    for k in range(1, len(nodes)):
        nodes[page.parents[k]].kids.append(nodes[k])
    for node in reversed(nodes):  # children before their parents
        runs: list[Node] = []
        for kid in node.kids:
            if runs and runs[-1].kind == kid.kind:
                merge(runs[-1], kid)
            else:
                runs.append(kid)
        node.kids = runs
    text = written_out(nodes[0])
    return text, [x.end().number for x in nodes]


def written_out(root: Node) -> str:
    """A line for each node in order: its depth and kind. Numbers the nodes."""
    lines, stack = [], [(root, 0)]
    while stack:
        node, depth = stack.pop()
        node.number = len(lines)
        lines.append(f"{depth} {node.kind}")
        stack += [(kid, depth + 1) for kid in reversed(node.kids)]
    return "\n".join(lines)


def read_in(text: str) -> list[Node]:
    """The nodes of a tree that was written out, in order."""
    nodes, path = [], []
    for line in text.split("\n"):
        depth, kind = line.split(" ", 1)
        node = Node(kind)
        node.number = len(nodes)
        nodes.append(node)
        del path[int(depth) :]
        if path:
            path[-1].kids.append(node)
        path.append(node)
    return nodes


def slots(wrapper: str, own: str) -> list[int]:
    """The slot of each node of a layout: its place in the wrapper, or below 0 a hash of its
    kinds where the wrapper lacks it."""
    tree, nodes, known = read_in(wrapper), read_in(own), {}
    out = [0] * len(nodes)
    stack = [(tree[0], nodes[0])]
    while stack:
        a, b = stack.pop()
        out[b.number] = a.number if a is not None else out[b.number]
        matched = {j: i for i, j in align(a, b, known)[1]} if a is not None else {}
        for j, kid in enumerate(b.kids):
            if j in matched:
                stack.append((a.kids[matched[j]], kid))
            else:
                digest = hashlib.blake2b(f"{out[b.number]} {kid.kind}".encode("utf-8", "replace"), digest_size=8).digest()
                out[kid.number] = -1 - (int.from_bytes(digest, "little") >> 1)
                stack.append((None, kid))
    return out


BLOCK_TYPE = T.StructType([T.StructField("node", T.IntegerType()), T.StructField("text", T.StringType()), T.StructField("article", T.BooleanType())])


@released
def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rest of each row, with host, layout and blocks."""
    sys.setrecursionlimit(DEEPEST)
    kind = pa.list_(pa.struct([("node", pa.int32()), ("text", pa.string()), ("article", pa.bool_())]))
    for batch in batches:
        layouts, blocks = [], []
        for html in batch.column("html"):
            page = Page(html.as_py())
            text, place = layout(page)
            layouts.append(text)
            blocks.append([{"node": a, "text": b, "article": c} for a, b, c in page.blocks(place)])
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("host"), pa.array(layouts, pa.string()), pa.array(blocks, kind)], names=["row", "host", "layout", "blocks"])


def _merge_runs(by: list[str]):
    """Merges the trees of rows in a row that agree in the columns `by`."""

    @released
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sys.setrecursionlimit(DEEPEST)
        key, tree, salt = None, None, 0
        for batch in batches:
            out = []
            for own, at, text in zip(batch[by].itertuples(index=False, name=None), batch["salt"], batch["tree"], strict=True):
                if own == key:
                    merge(tree, read_in(text)[0])
                    continue
                if key is not None:
                    out.append((key[0], salt, written_out(tree)))
                key, tree, salt = own, read_in(text)[0], at
            yield pd.DataFrame(out, columns=["host", "salt", "tree"]).astype({"salt": "int32"})
        if key is not None:
            yield pd.DataFrame([(key[0], salt, written_out(tree))], columns=["host", "salt", "tree"]).astype({"salt": "int32"})

    return run


@released
def _slots(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    sys.setrecursionlimit(DEEPEST)
    for batch in batches:
        yield pd.DataFrame({"host": batch["host"], "layout": batch["layout"], "slots": [slots(w, own) for w, own in zip(batch["tree"], batch["layout"], strict=True)]})


HOST = r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"


def parsed(pages: DataFrame) -> DataFrame:
    """row (the columns but html), host, layout, blocks."""
    host = F.lower(F.regexp_extract(F.coalesce("url", F.lit("")), HOST, 1))
    rest = F.struct(*(F.col(f"`{c}`") for c in pages.columns if c != "html"))
    rows = pages.select(rest.alias("row"), host.alias("host"), F.coalesce("html", F.lit("")).alias("html"))
    schema = T.StructType([rows.schema["row"], T.StructField("host", T.StringType()), T.StructField("layout", T.StringType()), T.StructField("blocks", T.ArrayType(BLOCK_TYPE))])
    return written(rows.mapInArrow(_parse, schema), "parsed")


def induce(own: DataFrame) -> DataFrame:
    """host, tree: the wrappers of all hosts, from `parsed` pages."""
    layouts = own.select("host", F.col("layout").alias("tree")).distinct().withColumn("salt", F.expr(f"int(pmod(xxhash64(tree), {SALTS}))"))
    partly = layouts.repartition("host", "salt").sortWithinPartitions("host", "salt", "tree").mapInPandas(_merge_runs(["host", "salt"]), "host string, salt int, tree string")
    trees = partly.repartition("host").sortWithinPartitions("host", "salt").mapInPandas(_merge_runs(["host"]), "host string, salt int, tree string")
    return written(trees.select("host", "tree"), "trees")


def _small(table: DataFrame, *columns: str) -> bool:
    size = sum((F.octet_length(c) if c == "tree" else F.size(c) * 8 for c in columns), F.lit(64))
    return (table.agg(F.sum(size)).first()[0] or 0) <= WRAPPER_BYTES


def placed(own: DataFrame, trees: DataFrame) -> DataFrame:
    """host, key, slots: the slots of each different layout; key: a hash of the layout."""
    layouts = own.select("host", "layout").distinct()
    joined = layouts.join(F.broadcast(trees) if _small(trees, "tree") else trees, "host")
    found = joined.mapInPandas(_slots, "host string, layout string, slots array<long>")
    return written(found.select("host", F.xxhash64("layout").alias("key"), "slots"), "slots")


def _key(slots_: Column, block: Column) -> Column:
    return F.xxhash64(F.get(slots_, block["node"]), block["text"])


def _with_slots(own: DataFrame, places: DataFrame, *more: str) -> DataFrame:
    """Pages with their layout's slots. Where places are too many to be broadcast, the pages of a
    layout are spread over SALTS parts, each with its copy of the slots."""
    keyed = own.withColumn("key", F.xxhash64("layout")).drop("layout")
    if _small(places, "slots", *more):
        return keyed.join(F.broadcast(places), ["host", "key"])
    spread = keyed.withColumn("part", F.expr(f"pmod(xxhash64(blocks), {SALTS})"))
    return spread.join(places.withColumn("part", F.explode(F.expr(f"sequence(0L, {SALTS - 1}L)"))), ["host", "key", "part"]).drop("part")


def constant(own: DataFrame, places: DataFrame) -> DataFrame:
    """host, template: hashes of (slot, text) that are template. A slot has one such text at most."""
    pages = _with_slots(own, places).select("host", "slots", "blocks", F.xxhash64(F.transform("blocks", lambda b: b["text"])).alias("body"))
    texts = F.array_distinct(F.transform("blocks", lambda b: F.struct(F.get("slots", b["node"]).alias("slot"), _key(F.col("slots"), b).alias("text"))))
    alone = F.array_distinct(F.transform("blocks", lambda b: F.struct(F.get("slots", b["node"]).alias("slot"), F.lit(None).cast("long").alias("text"))))
    rows = pages.select("host", "body", F.explode(F.concat(texts, alone)).alias("s")).select("host", "s.*", "body")
    seen = rows.groupBy("host", "slot", "text", "body").agg(F.lit(1).alias("one"))  # copies of a page count once
    counts = written(seen.groupBy("host", "slot", "text").agg(F.count("*").alias("n")).where(f"n >= {CONSTANT_PAGES}"), "counts")
    pages_with = counts.where("text is null").select("host", "slot", F.col("n").alias("pages"))
    found = counts.where("text is not null").join(pages_with, ["host", "slot"]).where(F.col("n") >= CONSTANT_SHARE * F.col("pages"))
    return found.groupBy("host").agg(F.array_sort(F.collect_set("text")).alias("template"))


def extract(pages: DataFrame) -> DataFrame:
    """pages without html, with text and n_chars."""
    own = parsed(pages.drop("text", "n_chars"))
    places = placed(own, induce(own))
    none = F.expr("cast(array() as array<long>)")
    places = written(places.join(constant(own, places), "host", "left").withColumn("template", F.coalesce("template", none)), "wrappers")
    found = _with_slots(own, places, "template")
    kept = F.filter("blocks", lambda b: b["article"] | ~F.array_contains("template", _key(F.col("slots"), b)))
    size = lambda blocks: F.aggregate(blocks, F.lit(0), lambda acc, b: acc + F.length(b["text"]))
    article = F.filter("kept", lambda b: b["article"])
    tried = found.select("row", "blocks", kept.alias("kept"))
    enough = (size(F.col("kept")) >= (1 - MOST_TEMPLATE) * size(F.col("blocks"))) | (F.size("kept") >= (1 - MOST_TEMPLATE) * F.size("blocks"))
    own_text = F.when(enough, F.col("kept")).otherwise(F.col("blocks"))
    out = tried.select("row", own_text.alias("kept")).select("row", F.transform(F.when(F.exists("kept", lambda b: b["article"]), article).otherwise(F.col("kept")), lambda b: b["text"]).alias("lines"))
    return out.select("row.*", F.array_join("lines", "\n").alias("text")).withColumn("n_chars", F.length("text").cast("long"))


def main_text(html: str | None) -> str:
    """The text of one page by itself, with no wrapper."""
    page = Page(html)
    found = page.blocks([0] * len(page.tags))
    inside = [text for _, text, article in found if article]
    return "\n".join(inside or [text for _, text, _ in found])
