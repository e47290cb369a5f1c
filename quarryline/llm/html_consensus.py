"""Main text of web pages by consensus paths of their host.

First every page scores its containers: characters of running text, less
those inside links, weighed by what tag and class names tell.  A container is
named by its generalised path: tags and class names from the root, digits
masked, without ids and positions.  All containers of a page with a positive
score vote; Spark sums the votes of all pages of a host for each path, and the
best path of the host is applied to its pages again; a page without such a
container uses its own best one.  Within tasks and in votes a path is a hash
chained from the root, so its size doesn't grow with the depth of a page.

The text is what the chosen container holds without menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, as
blocks joined by line breaks; white space inside a block becomes one space.
Tags and roles of that kind always count as noise.  Class names and ids count
for what groups others, never for words in a line, headings and paragraphs,
and they only weigh: a container that is named like noise, or a form, is read
all the same where it holds far more running text than all that is outside
such containers, and no article or main container is there (``readmitted``).
An article in several containers side by side is read from what holds them.

Edge cases: null or empty html gives an empty text; html cut off in a tag or
a character reference is read as far as it goes; pages may be nested to any
depth, and very long ones are read whole; a null url, or one without ``://``,
belongs to the empty host; equal votes go to the path nearer to the root, then
to the smaller hash.  Every row gives one row, repeated rows included, and an
empty table none.  Columns named host_path or text are replaced, all others
stay.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import STRING, attach, cut_lineage, record, row_of

#: A vote is a whole number of these shares of the page's best score, so that sums don't depend on their order.
VOTE_UNITS = 1_000_000
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = set("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split())
CONTAINERS = set("article body div form main section td".split())
#: Never part of the main text.
DROPPED = set("aside button canvas dialog footer head iframe input menu nav noscript object script select style svg template textarea title".split())
#: What groups others can be noise by its name; words in a line, headings and paragraphs can't.
BY_NAME = set("address center details dir div dl fieldset figure form li ol section table tbody td tfoot th thead tr ul".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NOISE = re.compile(
    r"(?:^|[-_ ])(?:ads?|advert\w*|adsense|banner|breadcrumbs?|comments?|comment\w*list|consent|cookies?|disqus|footer|gdpr|header|masthead|menu\w*|modal|nav|navbar|navigation|newsletter|notice|overlay|pagination|popup|promo\w*|related|replies|respond|share|sharing|sidebar|side|signup|skip|social|sponsor\w*|subscribe|toolbar|widget\w*)(?:$|[-_ ])",
    re.I,
)
GOOD = re.compile(r"(?:^|[-_ ])(?:article\w*|body|content|entry|main|page|post|story|text)(?:$|[-_ ])", re.I)
COMMENTS = re.compile(r"(?:^|[-_ ])(?:comments?|comment\w*list|disqus|replies|respond)(?:$|[-_ ])", re.I)
#: What a character in a container named like noise counts, with a name of main text beside it or without.
NAMED_WEIGHT, NOISE_WEIGHT = 0.4, 0.1
#: What text in containers inside counts, and the share of it that a second one has where the article is in several: then it counts whole.
INSIDE, SECOND = 0.7, 0.2
SPACE = re.compile(r"\s+")
#: An opening tag of the left closes an open paragraph or item of its own kind.
CLOSES_P = BLOCKS - {"body", "html", "option"}
SAME_KIND = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
SCOPE = {"ul", "ol", "table", "dl", "select", "article", "section", "div", "body", "main"}
#: Elements that an open paragraph, an inline tag or nothing can't be closed across.
AROUND_P = SCOPE | {"li", "td", "th", "blockquote", "figure", "aside", "nav", "header", "footer", "form"}
AROUND_INLINE = BLOCKS - {"p"}
NOTHING: set[str] = set()
#: Pages of a batch that are Python strings at once; the rest stays in Arrow's buffers.
SLICE = 64


class Node:
    """An element.  ``weight`` is what its running text counts: 1, 0 for noise, a share for names like noise."""

    __slots__ = ("tag", "names", "children", "parent", "depth", "weight", "noise", "path", "own", "inner", "most", "second")

    def __init__(self, tag: str, names: str, parent: Node | None, weight: float):
        self.tag, self.names, self.parent, self.weight = tag, names, parent, weight
        self.depth = parent.depth + 1 if parent else 0
        self.noise = weight < 1
        self.children: list[Node | str] = []
        self.path = self.own = self.inner = self.most = self.second = 0

    def branch(self, mass: int) -> None:
        """The two largest masses of containers inside."""
        if mass > self.second:
            self.most, self.second = max(self.most, mass), min(self.most, mass)


def name_weight(names: str) -> float:
    """1 for names that don't look like noise; the whole is looked at, then its parts."""
    if not NOISE.search(names):
        return 1.0
    if any(GOOD.search(x) and not NOISE.search(x) for x in names.split()):
        return NAMED_WEIGHT
    return 0.0 if COMMENTS.search(names) else NOISE_WEIGHT


class Tree(HTMLParser):
    """A forgiving tree of one page.

    Open elements are counted by tag, so that an end tag of none is passed over without a search.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", "", None, 1.0)
        self.open: dict[str, int] = {}

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in CLOSES_P:
            self.close("p", AROUND_P)
        for kind in SAME_KIND.get(tag, ()):
            self.close(kind, SCOPE - {tag})
        own = dict(attrs)
        names = " ".join(filter(None, (own.get("class"), own.get("id"))))
        wide = tag in ("html", "body", "main", "article")
        certain = tag in DROPPED or (tag == "header" and not self.open.get("article")) or (own.get("role") or "").lower() in ROLES or "hidden" in own or own.get("aria-hidden") == "true"
        weight = 0.0 if certain else 1.0 if wide or not names or tag not in BY_NAME else name_weight(names)
        if tag == "form":
            weight = min(weight, NOISE_WEIGHT)  # some sites put the whole page into one
        node = Node(tag, own.get("class") or "", self.at, weight)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node
            self.open[tag] = self.open.get(tag, 0) + 1

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def close(self, tag: str, stop: set[str]) -> None:
        if not self.open.get(tag):
            return
        node = self.at
        while node.tag != tag:
            if node.tag in stop:
                return
            node = node.parent
        while True:
            left, self.at = self.at, self.at.parent
            self.open[left.tag] -= 1
            if left is node:
                return

    def handle_endtag(self, tag: str) -> None:
        # Inline tags don't close the block they are in; blocks close what is open inside them.
        self.close(tag, NOTHING if tag in BLOCKS or tag in DROPPED else AROUND_INLINE)

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def step_of(node: Node) -> str:
    names = sorted({re.sub(r"\d+", "0", c) for c in node.names.split()})
    return ".".join([node.tag, *names])


def path_of(node: Node) -> str:
    """The generalised path in full."""
    steps = []
    while node.parent is not None:
        steps.append(step_of(node))
        node = node.parent
    return "".join(f">{x}" for x in reversed(steps))


def walked(root: Node) -> Iterator[Node]:
    """Elements that aren't noise, from the outside in, in page order."""
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack += [c for c in reversed(node.children) if not isinstance(c, str) and not c.noise]


def readmitted(root: Node) -> None:
    """Take back the mark of noise from containers that hold the page's running text.

    Such a container counts by its weight against all running text outside
    containers named like noise.  Without a name of main text of its own it
    is taken back only where no article, main or so named container has text.
    """
    named, stack, clean, main = [], [(root, False)], 0, False
    while stack:
        node, inside = stack.pop()
        inside = inside or node.tag in ("article", "main") or bool(node.names and node.tag in CONTAINERS and GOOD.search(node.names))
        for child in node.children:
            if isinstance(child, str):
                n = len(child.strip()) if node.tag != "a" else 0
                clean += n
                main = main or (inside and n > 0)
            elif not child.noise:
                stack.append((child, inside))
            elif child.weight > 0 and child.tag in CONTAINERS:
                named.append(child)
    for node in named:
        if main and node.weight < NAMED_WEIGHT:
            continue
        mass = sum(len(c.strip()) for x in walked(node) if x.tag != "a" for c in x.children if isinstance(c, str))
        node.noise = mass * node.weight <= clean


def parsed(html: str | None) -> Node:
    tree = Tree()
    tree.feed(html or "")
    rest = tree.rawdata
    if rest and not rest.startswith("<"):  # text after the last whole token
        tree.handle_data(unescape(rest))
    readmitted(tree.root)
    return tree.root


def scored(root: Node) -> tuple[list[tuple[float, int, int, Node]], dict[int, list[Node]]]:
    """Containers as (score, depth, path, node), best first, and all containers by path.

    A node's ``own`` counts the characters of its own blocks, ``inner`` those
    of containers inside it, which count less unless several of them hold the
    text; link texts count against it.
    """
    order = list(walked(root))
    linked = {id(root)} if root.tag == "a" else set()
    for node in order:
        node.own = node.inner = node.most = node.second = 0
        in_link = id(node) in linked
        for child in node.children:
            if isinstance(child, str):
                node.own += -len(child) if in_link else len(child.strip())
            elif not child.noise:
                child.path = xxhash.xxh64_intdigest(f"{node.path}>{step_of(child)}") >> 1
                if in_link or child.tag == "a":
                    linked.add(id(child))
    for node in reversed(order[1:]):  # the inside first
        if node.tag in CONTAINERS:
            node.parent.inner += node.own + node.inner
            node.parent.branch(node.own + node.inner)
        else:
            node.parent.branch(node.most)
            node.parent.branch(node.second)
            node.parent.own += node.own
            node.parent.inner += node.inner
    found, by_path = [], {}
    for node in order:
        if node.tag in CONTAINERS:
            weight = {"article": 2.0, "main": 1.6}.get(node.tag, 1.0) * (1.3 if GOOD.search(node.names) else 1.0)
            several = node.second >= max(1, SECOND * (node.own + node.inner))
            weight *= 0.8 if node.tag == "body" and not several else 1.0
            score = round((node.own + (1.0 if several else INSIDE) * node.inner) * weight, 3)
            by_path.setdefault(node.path, []).append(node)
            if score > 0:
                found.append((score, node.depth, node.path, node))
    return sorted(found, key=lambda x: (-x[0], x[1], x[2])), by_path


def blocks_of(node: Node) -> list[str]:
    """Texts of the blocks inside the node, in page order."""
    out: list[str] = []
    held: list[str] = []

    def flush() -> None:
        text = SPACE.sub(" ", "".join(held)).strip()
        held.clear()
        if text:
            out.append(text)

    stack: list[Node | str | None] = list(reversed(node.children))  # None ends a block
    while stack:
        part = stack.pop()
        if part is None:
            flush()
        elif isinstance(part, str):
            held.append(part)
        elif part.noise:
            held.append(" ")
        else:
            if part.tag in BLOCKS:
                flush()
                stack.append(None)
            elif part.tag == "br":
                held.append(" ")
            stack += reversed(part.children)
    flush()
    return out


def extract(html: str | None, path: int | None = None) -> tuple[str, str | None]:
    """The text, and the path of the container if it is the host's."""
    root = parsed(html)
    best, by_path = scored(root)
    if not best:
        return "\n".join(blocks_of(root)), None
    # Containers of one path have one depth, so none holds another.
    texts = [b for n in by_path.get(path, []) for b in blocks_of(n)] if path is not None else []
    if texts:
        return "\n".join(texts), path_of(by_path[path][0])
    return "\n".join(blocks_of(best[0][3])), None


def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(host, path, depth, score) of all containers, summed over a batch's pages."""
    for rows in batches:
        sums: dict[tuple[str, int, int], int] = {}
        for a in range(0, rows.num_rows, SLICE):
            part = rows.slice(a, SLICE)
            for host, html in zip(part.column("host").to_pylist(), part.column("html").to_pylist(), strict=True):
                best = scored(parsed(html))[0]
                # A vote is a share of the page's best score, so that long pages don't outvote many.
                for (path, depth), score in {(p, d): s for s, d, p, _ in reversed(best)}.items():
                    sums[host, path, depth] = sums.get((host, path, depth), 0) + round(VOTE_UNITS * score / best[0][0])
        columns = [*zip(*sums, strict=True)] or [[], [], []]
        kinds = (pa.string(), pa.int64(), pa.int32(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip([*columns, list(sums.values())], kinds, strict=True)], ["host", "path", "depth", "score"])


@F.arrow_udf(record(text=STRING, host_path=STRING))
def text_of(pages: pa.Array, paths: pa.Array) -> pa.Array:
    texts, names = [], []
    for a in range(0, len(pages), SLICE):
        for html, path in zip(pages.slice(a, SLICE).to_pylist(), paths.slice(a, SLICE).to_pylist(), strict=True):
            text, name = extract(html, path)
            texts.append(text)
            names.append(name)
    return pa.StructArray.from_arrays([pa.array(texts, pa.string()), pa.array(names, pa.string())], ["text", "host_path"])


def host_of(url: Column) -> Column:
    return F.coalesce(F.lower(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)), F.lit(""))


def winning_paths(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """(host, path, votes): the path with the most votes of each host."""
    votes = pages.select(host_of(F.col(url)).alias("host"), F.col(html).alias("html")).mapInArrow(vote, "host string, path long, depth int, score long")
    sums = votes.groupBy("host", "path", "depth").agg(F.sum("score").alias("votes"))
    best = sums.groupBy("host").agg(F.min(F.struct((-F.col("votes")).alias("less"), "depth", "path")).alias("best"))
    return best.select("host", F.col("best.path").alias("path"), (-F.col("best.less")).alias("votes"))


def main_text(pages: DataFrame, html: str = "html", url: str = "url") -> DataFrame:
    """``pages`` with host_path, the host's path where the page has text there (else null), and text."""
    winners = cut_lineage(winning_paths(pages, html, url)).select("host", "path")
    rows = pages.select(row_of(pages, ["host_path", "text"]).alias("row"), F.col(html).alias("html"), host_of(F.col(url)).alias("host"))
    found = attach(rows, winners, ["host"]).select("row", text_of(F.col("html"), F.col("path")).alias("found"))
    return found.select("row.*", "found.host_path", "found.text")
