"""A prefix trie of conversations, built by a mergesort that carries common prefixes.

A conversation is its sequence of turns, each named by a digest of its role
and text; conversations of one sequence are one entry.  Entries are dealt by
ranges of sequences.  Each task sorts what it holds into runs: within a run
an entry carries the length of the prefix that it shares with the one before
(LCP), and only its turns behind that prefix travel.  A range's runs meet in
one task and are merged by a loser tree: two heads whose LCPs with the last
winner differ are in order by these alone, and otherwise are compared from
there on, so that no shared turn is compared twice.  The merged stream is
read once with a stack of open nodes, the path of the latest entry: a node is
finished as soon as an entry comes that doesn't share its path.

Ranges are cut by short prefixes of sampled sequences.  Only the proper
prefixes of a cut can have members in several ranges; such open nodes come as
parts, one for each range, which are added up afterwards.  So a first turn
that a third of all conversations share is cut like any other.

The ids that end in a node are hashed in their numeric order, which is one
stream for each node: they pass through one task sorted, and nothing is held.

Edge cases: a null role or text is empty.  Turns with equal numbers go by
role, then by text digest; repeated rows are turns of their own.  Rows with a
null conv_id name no conversation and are left out.  A text of any length is
hashed whole.  An empty table has no nodes.  Columns other than the four
named are ignored, so none can clash.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import LONG, STRING, WORD, attach, cut_lineage, hash_share, record, written

#: Conversations c to c+19 (by c - c % 20) take their first turns from one of them.
SHARED_BY = 20
#: At most so many of them, by the checksum of the id.
MOST_SHARED = 4
#: Distinct sequences that one range is meant to have; a task holds its range.
RANGE_ROWS = 5_000
#: Entries of a run.
RUN_ROWS = 5_000
#: Sequences sampled for cuts, at most, and for each range, and turns of a cut; they only shape ranges.
#: Beyond SAMPLED / PER_RANGE * RANGE_ROWS (50 million) distinct sequences, ranges become larger in place of more.
SAMPLED, PER_RANGE, CUT_TURNS = 100_000, 10, 64
#: Hex digits of a turn's digest.
DIGITS = 32

Path = tuple[str, ...]
NO_MEMBERS = hashlib.sha256(b"").hexdigest()


# --- sequences ---------------------------------------------------------------------


def turn_rows(rows: DataFrame) -> DataFrame:
    """(conv_id, place, digest, words) from (conv_id, turn, role, text): places count from 0."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    # The role's length tells ("a", "bc") from ("ab", "c").
    digest = F.left(F.sha2(F.concat_ws("\n", F.length(role).cast("string"), role, text), 256), F.lit(DIGITS))
    words = F.regexp_count(text, F.lit(WORD)).cast("long")
    own = rows.where(F.col("conv_id").isNotNull()).select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), words.alias("words"))
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    return own.select("conv_id", (F.row_number().over(order) - 1).alias("place"), "digest", "words")


def shared_turns(conv_id: Column) -> Column:
    return F.crc32(conv_id.cast("string").cast("binary")) % MOST_SHARED


def sequences(rows: DataFrame) -> DataFrame:
    """(conv_id, path, words) of every conversation: the first turns of its group's first one, then its own after as many."""
    turns = turn_rows(rows)
    in_order = F.sort_array(F.collect_list(F.struct("place", "digest", "words")))
    own = cut_lineage(turns.groupBy("conv_id").agg(in_order.alias("own")))
    source = own.where(F.col("conv_id") % SHARED_BY == 0)
    first = source.select(F.col("conv_id").alias("source"), F.slice("own", 1, MOST_SHARED - 1).alias("first"))
    joined = own.withColumn("source", F.col("conv_id") - F.col("conv_id") % SHARED_BY).join(first, "source", "left")
    h = shared_turns(F.col("conv_id")).cast("int")
    empty = F.slice("own", 1, 0)
    behind = F.slice("own", h + 1, F.greatest(F.size("own") - h, F.lit(0)))
    rebuilt = F.concat(F.coalesce(F.slice("first", F.lit(1), h), empty), behind)
    return joined.select("conv_id", rebuilt.alias("r")).select("conv_id", F.col("r.digest").alias("path"), F.col("r.words").alias("words"))


def ends_hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (name, conv_id) sorted by both: (name, ends), the digest of a name's ids."""
    name, digest = None, None
    for batch in batches:
        names, ends = [], []
        for new, conv in zip(batch.column("name").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if new == name:
                digest.update(b",%d" % conv)
                continue
            if name is not None:
                names.append(name)
                ends.append(digest.hexdigest())
            name, digest = new, hashlib.sha256(b"%d" % conv)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(ends, pa.string())], ["name", "ends"])
    if name is not None:
        yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([digest.hexdigest()])], ["name", "ends"])


def entries(rows: DataFrame) -> DataFrame:
    """Distinct sequences (path, words, n, conv_id, ends): members in number, the least of them, and their digest."""
    named = written(sequences(rows).withColumn("name", F.sha2(F.concat(F.size("path").cast("string"), F.lit(":"), F.array_join("path", "")), 256)), "sequences")
    distinct = named.groupBy("name").agg(F.first("path").alias("path"), F.first("words").alias("words"), F.count("*").alias("n"), F.min("conv_id").alias("conv_id"))
    streams = named.select("name", "conv_id").repartition("name").sortWithinPartitions("name", "conv_id")
    ends = streams.mapInArrow(ends_hash, record(name=STRING, ends=STRING))
    return written(distinct.join(ends, "name").drop("name"), "entries")


# --- sorted runs -------------------------------------------------------------------


def lcp(a: Sequence, b: Sequence, start: int = 0) -> int:
    n = min(len(a), len(b))
    while start < n and a[start] == b[start]:
        start += 1
    return start


ENTRY = dict(words=T.ArrayType(LONG), n=LONG, conv_id=LONG, ends=STRING)
RUN = record(part=LONG, run=STRING, place=LONG, lcp=LONG, behind=T.ArrayType(STRING), **ENTRY)


def sorted_runs(cuts) -> Callable:
    """Runs of RUN_ROWS entries, by range: each with its LCP with the one before and its turns behind that."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, number, held = TaskContext.get().partitionId(), 0, []

        def told():
            held.sort(key=lambda e: e["path"])
            part, before, place, out = None, (), 0, []
            for e in held:
                path = e.pop("path")
                if part is None or (part < len(cuts.value) and path >= cuts.value[part]):
                    part, before, place = bisect_right(cuts.value, path), (), 0
                shared = lcp(before, path)
                out.append(e | {"part": part, "run": f"{task}-{number}", "place": place, "lcp": shared, "behind": path[shared:]})
                before, place = path, place + 1
            return pa.RecordBatch.from_pylist(out, pa.schema([(f.name, kind) for f, kind in zip(RUN.fields, RUN_KINDS, strict=True)]))

        for batch in batches:
            held += [e | {"path": tuple(e["path"])} for e in batch.to_pylist()]
            if len(held) >= RUN_ROWS:
                yield told()
                held, number = [], number + 1
        if held:
            yield told()

    return run


RUN_KINDS = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.int64(), pa.int64(), pa.string()]


class Head:
    """The entry at the head of a run, with its LCP with the last winner."""

    def __init__(self, rows: Iterator[dict]):
        self.rows, self.path, self.lcp, self.entry = rows, (), 0, None
        self.step()

    def step(self) -> None:
        """The next entry.  Its LCP in the run is that with the last winner, which was this run's head."""
        self.entry = next(self.rows, None)
        if self.entry is not None:
            self.lcp = self.entry["lcp"]
            self.path = (*self.path[: self.lcp], *self.entry["behind"])


def first_of(a: Head, b: Head) -> tuple[Head, Head]:
    """(winner, loser), the loser with its LCP with the winner.

    Both heads are not before the last winner, so the one that shares more
    with it comes first; only of equal ones the turns behind are compared.
    """
    if a.entry is None or b.entry is None:
        return (b, a) if a.entry is None else (a, b)
    if a.lcp != b.lcp:
        return (a, b) if a.lcp > b.lcp else (b, a)
    shared = lcp(a.path, b.path, a.lcp)
    winner, loser = (a, b) if a.path[shared : shared + 1] <= b.path[shared : shared + 1] else (b, a)
    loser.lcp = shared
    return winner, loser


def merged(runs: list[Iterator[dict]]) -> Iterator[tuple[int, Path, dict]]:
    """(LCP with the one before, path, entry) of all runs in order, by a loser tree."""
    heads = [Head(r) for r in runs]
    size = 1 << max(0, len(heads) - 1).bit_length()
    heads += [Head(iter(())) for _ in range(size - len(heads))]
    for h in heads:
        h.lcp = 0  # nothing has won yet
    losers: list[Head] = [None] * size

    def play(node: int) -> Head:
        if node >= size:
            return heads[node - size]
        winner, losers[node] = first_of(play(2 * node), play(2 * node + 1))
        return winner

    at = {id(h): i + size for i, h in enumerate(heads)}
    winner = play(1)
    while winner.entry is not None:
        yield winner.lcp, winner.path, winner.entry
        node = at[id(winner)] // 2
        winner.step()
        while node:
            winner, losers[node] = first_of(losers[node], winner)
            node //= 2


# --- nodes -------------------------------------------------------------------------

NODE = dict(depth=LONG, conv_id=LONG, parent_conv_id=LONG, n_convs=LONG, n_children=LONG, n_leaves=LONG, saved_tokens=LONG, ends_sha256=STRING)
#: ``path`` and ``words`` only of open nodes, ``above`` the path of an open parent.
PARTS = record(**NODE, path=STRING, above=STRING, words=LONG)
PART_KINDS = [pa.int64()] * 7 + [pa.string()] * 3 + [pa.int64()]


class Node:
    __slots__ = ("above", "children", "conv", "depth", "ends", "leaves", "n", "path", "saved", "words")

    def __init__(self, depth: int, words: int, path: str | None, above: Node | None):
        self.depth, self.words, self.path, self.above = depth, words, path, above
        self.n = self.children = self.leaves = self.saved = 0
        self.conv, self.ends = None, None


def nodes(cuts: list[Path], part: int, stream: Iterator[tuple[int, Path, dict]]) -> Iterator[Node]:
    """Finished nodes of a range, children first.  Subtree sums of open nodes count what lies below them closed."""
    edges = cuts[max(0, part - 1) : part + 1]  # cuts at the range's two ends

    def opened(path: Path, words: Sequence[int], depth: int, above: Node | None) -> Node:
        spans = depth == 0 or (above.path is not None and any(len(c) > depth and c[:depth] == path[:depth] for c in edges))
        return Node(depth, words[depth - 1] if depth else 0, "".join(path[:depth]) if spans else None, above)

    def close(node: Node) -> Node:
        above = node.above
        if node.path is None:
            node.leaves += node.children == 0
            node.saved += (node.n - 1) * node.words
            above.children += 1
            above.leaves += node.leaves
            above.saved += node.saved
        if above is not None:
            above.n += node.n
            above.conv = node.conv if above.conv is None else min(above.conv, node.conv)
        return node

    stack: list[Node] = []
    for shared, path, entry in stream:
        while len(stack) > shared + 1:
            yield close(stack.pop())
        while len(stack) <= len(path):
            stack.append(opened(path, entry["words"], len(stack), stack[-1] if stack else None))
        last = stack[-1]
        last.n += entry["n"]
        last.conv = entry["conv_id"] if last.conv is None else min(last.conv, entry["conv_id"])
        last.ends = entry["ends"]
    while stack:
        yield close(stack.pop())


def merge_range(cuts) -> Callable:
    """From a range's runs: its nodes, closed ones whole and open ones in part."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        part = key[0].as_py()
        runs: dict[str, list[dict]] = {}
        for batch in table.sort_by([("run", "ascending"), ("place", "ascending")]).to_batches():
            for row in batch.to_pylist():
                runs.setdefault(row["run"], []).append(row)
        done = list(nodes(cuts.value, part, merged([iter(r) for r in runs.values()])))
        rows = [  # a parent's least member is known only now
            (x.depth, x.conv, x.above.conv if x.above is not None and x.above.path is None else None, x.n, x.children, x.leaves, x.saved, x.ends, x.path, x.above.path if x.above is not None else None, x.words if x.path is not None else None)
            for x in done
        ]
        columns = list(zip(*rows, strict=True)) or [()] * len(PART_KINDS)
        return pa.table([pa.array(c, k) for c, k in zip(columns, PART_KINDS, strict=True)], PARTS.names)

    return run


def cut_points(paths: DataFrame, n: int, ranges: int) -> list[Path]:
    """At most ``ranges`` - 1 sorted prefixes between which the ``n`` sequences are about as many.

    A cut is the shortest prefix of a sampled sequence that comes behind the
    sample before it, so that few nodes are prefixes of cuts.
    """
    if ranges < 2:
        return []
    share = hash_share(["path"], 13, PER_RANGE * ranges / n)
    taken = paths.where(share).select(F.slice("path", 1, CUT_TURNS).alias("path"))
    sampled = sorted(tuple(r[0]) for r in taken.limit(2 * SAMPLED).collect())
    places = sorted({len(sampled) * i // ranges for i in range(1, ranges)} - {0}) if sampled else []
    return sorted({sampled[i][: lcp(sampled[i - 1], sampled[i]) + 1] for i in places if sampled[i - 1] != sampled[i]})


def whole(parts: DataFrame) -> DataFrame:
    """Open nodes added up: of each one's parts, then over the open nodes below it."""
    names = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    added = parts.where(F.col("path").isNotNull()).groupBy("path").agg(
        F.first("depth").alias("depth"), F.min("conv_id").alias("conv_id"), *(F.sum(c).alias(c) for c in names), F.max("ends_sha256").alias("ends_sha256"), F.first("above").alias("above"), F.first("words").alias("words")
    )
    added = cut_lineage(added.withColumn("saved_tokens", F.col("saved_tokens") + (F.col("n_convs") - 1) * F.col("words")))
    below = added.groupBy(F.col("above").alias("over")).agg(F.count("*").alias("open_children"))
    # A node's prefixes are its ancestors; an open node without children is a leaf.
    over = F.transform(F.sequence(F.lit(0), F.col("depth").cast("int")), lambda d: F.left("path", d * DIGITS))
    leaf = F.when(F.col("n_children") == 0, 1).otherwise(0)
    counted = added.join(below, F.col("path") == F.col("over"), "left").withColumn("n_children", F.col("n_children") + F.coalesce("open_children", F.lit(0))).drop("over", "open_children")
    lifted = counted.select(F.explode(over).alias("over"), (F.col("n_leaves") + leaf).alias("leaves"), F.col("saved_tokens").alias("saved"))
    sums = lifted.groupBy("over").agg(F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"))
    done = counted.join(sums, F.col("path") == F.col("over")).withColumns({"n_leaves": F.col("leaves"), "saved_tokens": F.col("saved")})
    parents = added.select(F.col("path").alias("over_path"), F.col("conv_id").alias("over_conv"))
    done = done.drop("over", "leaves", "saved", "parent_conv_id").join(parents, F.col("above") == F.col("over_path"), "left")
    return done.select("path", *(F.col("over_conv" if c == "parent_conv_id" else c).alias(c) for c in NODE))


def trie(rows: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """The nodes of the trie of conversations (conv_id, turn, role, text)."""
    spark = rows.sparkSession
    distinct = entries(rows)
    n = distinct.count()
    ranges = min(-(-n // range_rows), SAMPLED // PER_RANGE)
    cuts = spark.sparkContext.broadcast(cut_points(distinct, n, ranges))  # bounded by SAMPLED and CUT_TURNS
    runs = distinct.mapInArrow(sorted_runs(cuts), RUN)
    parts = written(runs.groupBy("part").applyInArrow(merge_range(cuts), PARTS), "nodes")
    open_nodes = cut_lineage(whole(parts))
    named = open_nodes.select(F.col("path").alias("above"), F.col("conv_id").alias("over"))
    closed = attach(parts.where(F.col("path").isNull()), named, ["above"])
    closed = closed.withColumn("parent_conv_id", F.coalesce("parent_conv_id", "over"))
    both = closed.select(*NODE).unionByName(open_nodes.select(*NODE))
    return both.withColumn("ends_sha256", F.coalesce("ends_sha256", F.lit(NO_MEMBERS)))
