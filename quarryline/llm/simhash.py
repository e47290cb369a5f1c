"""SimHash near-duplicates, linked through BK-trees.

Every text gets a 64-bit SimHash of its lower-cased word shingles.  Equal
fingerprints are one node; nodes within ``RADIUS`` bits are linked and the
connected components are the groups.

Links are found with Burkhard-Keller trees: a child hangs on the edge whose
integer is its Hamming distance to the parent, and a search follows only the
edges within the radius of the distance at hand.  One tree over all nodes
would be searched almost whole, so the nodes are sharded first: of three bit
blocks, two fingerprints within two bits agree on one at least.  A shard is
the set of nodes with the same value in one block.  A shard over
``SHARD_ROWS`` is split the same way by three sub-blocks of its remaining
bits, up to ``LEVELS`` times; then at most 13 bits are free and a shard holds
at most 8192 nodes whatever the data.  Shard trees have no size bound as a
whole, so they are not broadcast from the driver: each reaches its searchers
through one shuffle by shard.  A shard returns a spanning forest of its
links, not all pairs; components are then joined by star contraction over
checkpointed tables.

Edge cases: a null or wordless text has fingerprint zero, linked like any
other.  Rows that repeat an id stay separate rows; a null id joins a group
but never names it unless the group has no other id (then component_id is
null).  An empty table gives an empty result.  Texts are read whole, whatever
their length.  Of a group's rows the one of least id stays, ties going by the
hashes of the whole row.  ``keep_one`` returns the columns of its input, of
whatever names; ``near_duplicates`` carries no other columns over.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.llm import shingles
from quarryline.llm.common import LONG, cut_lineage, hashable_columns, row_of, unpacked
from quarryline.llm.components import components

RADIUS = 2
SHINGLE = 3
SEED = 42
SHARD_ROWS = 512
LEVELS = 4
#: Rows of whole shards that are searched together, and tree visits made at once.
FOREST_ROWS = 50_000
VISITS = 1_000_000
#: Bytes of names that may be broadcast, and of one name as a broadcast holds it.
MOST_BROADCAST, NAME_BYTES = 64 << 20, 40

BYTE_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def majority(hashes: np.ndarray) -> int:
    """The bits that over half the hashes have."""
    columns = hashes.view(np.uint8).reshape(-1, 8)
    ones = np.concatenate([np.bincount(columns[:, k], minlength=256) @ BYTE_BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def simhash(text: str | None, size: int = SHINGLE, seed: int = SEED) -> int:
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= size:
        hashes = np.array([xxhash.xxh64_intdigest(joined, seed)], np.uint64)
    else:
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
        starts = np.concatenate(([0], ends[:-1]))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], seed) for a, b in zip(starts[: 1 - size].tolist(), (ends[size - 1 :] - 1).tolist(), strict=True)], np.uint64)
    return majority(hashes)


@F.pandas_udf(LONG)
def fingerprint(texts: pd.Series) -> pd.Series:
    """The SimHash as a signed long with the same bits."""
    return pd.Series(np.array([simhash(t) for t in texts], np.uint64).view(np.int64))


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


# --- shards -----------------------------------------------------------------


def split_blocks(bits: list[int]) -> list[list[int]]:
    third = -(-len(bits) // 3)
    return [bits[:third], bits[third : 2 * third], bits[2 * third :]]


def masked(bits: Column, where: list[int]) -> Column:
    mask = sum(1 << b for b in where)
    return bits.bitwiseAND(F.lit(mask - (1 << 64) if mask >= 1 << 63 else mask))


def shards(nodes: DataFrame) -> DataFrame:
    """Rows (shard, node) of every shard of two nodes or more.

    ``nodes`` has distinct longs ``node``.  Each level spreads only the nodes of
    shards that are still over SHARD_ROWS; fixed bits are those of the path.
    """
    paths: dict[str, tuple[list[int], list[int]]] = {"": ([], list(range(64)))}
    level, done = nodes.select("node", F.lit("").alias("path")), None
    for depth in range(LEVELS):
        below: dict[str, tuple[list[int], list[int]]] = {}
        for path, (fixed, free) in paths.items():
            for k, block in enumerate(split_blocks(free)):
                below[f"{path}{k}"] = (fixed + block, [b for b in free if b not in block])
        value = F.lit(None).cast("long")
        for path, (fixed, _) in below.items():
            value = F.when(F.col("path") == path, masked(F.col("node"), fixed)).otherwise(value)
        spread = level.withColumn("path", F.explode(F.array(*(F.concat("path", F.lit(str(k))) for k in range(3)))))
        spread = spread.select("node", "path", F.struct("path", value.alias("value")).alias("shard"))
        sizes = spread.groupBy("shard").agg(F.count("*").alias("n")).where("n > 1")
        spread = cut_lineage(spread.join(sizes, "shard"))
        last = depth == LEVELS - 1
        small = spread if last else spread.where(F.col("n") <= SHARD_ROWS)
        small = small.select("shard", "node")
        done = small if done is None else done.unionByName(small)
        level, paths = spread.where(F.col("n") > SHARD_ROWS).select("node", "path"), below
        if last or level.isEmpty():
            return done
    return done


# --- BK-trees ---------------------------------------------------------------


def distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b).astype(np.int64)


class Forest:
    """A BK-tree for each shard; ``shard`` is sorted and its nodes are distinct."""

    def __init__(self, shard: np.ndarray, node: np.ndarray):
        n = len(node)
        self.node = node
        new = np.concatenate(([True], shard[1:] != shard[:-1]))
        self.root = np.flatnonzero(new)[np.cumsum(new) - 1]
        parent, edge = np.full(n, -1), np.zeros(n, np.int64)
        below = np.flatnonzero(self.root != np.arange(n))
        at = self.root[below]
        while len(below):  # every pass sinks all nodes by one level
            d = distance(node[below], node[at])
            slot = at * 65 + d
            order = np.argsort(slot, kind="stable")
            below, at, d, slot = below[order], at[order], d[order], slot[order]
            first = np.concatenate(([True], slot[1:] != slot[:-1]))
            child = below[first]
            parent[child], edge[child] = at[first], d[first]
            at = child[np.cumsum(first) - 1][~first]
            below = below[~first]
        hung = np.flatnonzero(parent >= 0)
        self.children = hung[np.lexsort((edge[hung], parent[hung]))]
        self.edge = edge[self.children]
        self.begin = np.searchsorted(parent[self.children], np.arange(n + 1))

    def search(self, queries: np.ndarray, radius: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (query, found) of indexes within the radius, level by level."""
        at = self.root[queries]
        while len(queries):
            d = distance(self.node[queries], self.node[at])
            near = d <= radius
            yield queries[near], at[near]
            begin, count = self.begin[at], self.begin[at + 1] - self.begin[at]
            total = int(count.sum())
            which = np.repeat(np.arange(len(at)), count)
            slot = np.arange(total) - np.repeat(np.cumsum(count) - count, count) + begin[which]
            follow = np.abs(self.edge[slot] - d[which]) <= radius
            queries, at = queries[which[follow]], self.children[slot[follow]]


def roots(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Labels after joining the sets of a[i] and b[i], and the i that joined two; a label is the set's least index."""
    index, joined = np.arange(len(a)), []
    while True:
        x, y = label[a[index]], label[b[index]]
        differ = x != y
        if not differ.any():
            return label, np.concatenate([index[:0], *joined])
        index, high, low = index[differ], np.maximum(x, y)[differ], np.minimum(x, y)[differ]
        np.minimum.at(label, high, low)
        hooks = np.flatnonzero(label[high] == low)
        joined.append(index[hooks[np.unique(high[hooks], return_index=True)[1]]])  # a set is joined to a lesser one once
        while (label[label] != label).any():
            label = label[label]


def spanning_forest(shard: np.ndarray, node: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of nodes within the radius, as (later, earlier): as few as join each set of the shard."""
    forest, label = Forest(shard, node), np.arange(len(node))
    size = np.bincount(forest.root, minlength=len(node))[forest.root]
    done, later, earlier = 0, [node[:0]], [node[:0]]
    while done < len(node):  # as many queries as may visit VISITS nodes
        upto = max(done + 1, int(np.searchsorted(np.cumsum(size[done:]), VISITS)) + done)
        for a, b in forest.search(np.arange(done, upto), radius):
            label, joined = roots(label, a, b)
            later.append(node[np.maximum(a, b)[joined]])
            earlier.append(node[np.minimum(a, b)[joined]])
        done = upto
    return np.concatenate(later), np.concatenate(earlier)


def link_shards(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by shard, as (path, value, node); yields the links of each shard."""

    def links(rows: list[np.ndarray]) -> pa.RecordBatch:
        path, value, node = rows
        new = np.concatenate(([True], (path[1:] != path[:-1]) | (value[1:] != value[:-1])))
        a, b = spanning_forest(np.cumsum(new), node.view(np.uint64), RADIUS)
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    held: list[list[np.ndarray]] = []
    count = 0
    for batch in batches:
        held.append([batch.column(k).to_numpy(zero_copy_only=False) for k in range(3)])
        count += batch.num_rows
        if count < FOREST_ROWS:
            continue
        path, value, node = (np.concatenate(x) for x in zip(*held, strict=True))
        last = np.flatnonzero((path != path[-1]) | (value != value[-1]))
        cut = int(last[-1]) + 1 if len(last) else 0  # the last shard may go on
        if cut:
            yield links([path[:cut], value[:cut], node[:cut]])
        held = [[path[cut:], value[cut:], node[cut:]]]
        count = len(node) - cut
    if held and sum(len(x[2]) for x in held):
        yield links([np.concatenate(x) for x in zip(*held, strict=True)])


def near_links(nodes: DataFrame) -> DataFrame:
    """Links (a, b) of nodes within RADIUS bits, which join all such nodes into sets."""
    sharded = shards(nodes).select(F.concat(F.lit("1"), "shard.path").cast("int").alias("path"), F.col("shard.value").alias("value"), "node")
    dealt = sharded.repartition("path", "value").sortWithinPartitions("path", "value", "node")
    return dealt.mapInArrow(link_shards, "a long, b long").distinct()


# --- groups ------------------------------------------------------------------


def near_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, fingerprint, component_id), one row for each row of ``docs``."""
    marked = cut_lineage(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("node")))
    firsts = cut_lineage(marked.groupBy("node").agg(F.min("doc_id").alias("first")))
    member = cut_lineage(components(near_links(firsts.select("node"))))
    named = firsts.join(member, "node", "left").withColumn("component", F.coalesce("component", "node"))
    names = named.join(member.select("component").distinct(), "component", "left_semi").groupBy("component").agg(F.min("first").alias("least"))
    named = named.join(names, "component", "left").select("node", F.coalesce("least", "first").alias("component_id"))
    return marked.join(named, "node").select("doc_id", as_hex(F.col("node")).alias("fingerprint"), "component_id")


def candidates(nodes: DataFrame) -> DataFrame:
    """From distinct (node, print): pairs (a, b) of nodes whose fingerprints are equal or within RADIUS bits.

    The pairs join all such nodes into sets, and are as few as each shard needs for that.
    """
    firsts = cut_lineage(nodes.groupBy("print").agg(F.min("node").alias("first")))
    same = nodes.join(firsts, "print").where("node <> first").select(F.col("first").alias("x"), F.col("node").alias("y"))
    end = lambda link, name: firsts.select(F.col("print").alias(link), F.col("first").alias(name))
    near = near_links(firsts.select(F.col("print").alias("node"))).join(end("a", "x"), "a").join(end("b", "y"), "b").select("x", "y")
    return same.unionByName(near).select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """``docs`` with one row of each near-copy group: the one of least id (null last).

    Groups are the connected components of the texts whose sets of five-word
    shingles have a similarity of 0.8 or more.  Links are searched first by the
    SimHash of a text's set, through BK-trees, and confirmed on whole sets; an
    exact join (``shingles``) adds those between texts that are then still
    apart, as similar texts may differ in more than RADIUS bits.  Rows are named by two hashes over all their columns.  Names
    and nodes settle which rows stay.  The names of rows that go are broadcast
    if they have at most ``MOST_BROADCAST`` bytes; beyond, texts are shuffled to
    be joined with the names that stay.  Of exactly repeated rows, which share
    a name, one stays.
    """
    columns = hashable_columns(docs)
    named = docs.select(row_of(docs).alias("row"), F.xxhash64(*columns).alias("__a"), F.hash(*columns).alias("__b"))
    own = lambda name: F.col("row").getField(name)
    key = F.struct(own(doc_id).isNull().alias("no"), own(doc_id).alias("id"), "__a", "__b")
    texts = named.select("__a", "__b", key.alias("key"), own(text).alias("text"))
    firsts, links, keys = shingles.similar(texts, majority, candidates)
    member = cut_lineage(components(links))
    grouped = firsts.join(member, "node", "left").groupBy(F.coalesce("component", "node").alias("component")).agg(F.min("first").alias("first"))
    chosen = grouped.select("first.__a", "first.__b", F.lit(True).alias("chosen"))
    counts = keys.groupBy("key.__a", "key.__b").agg(F.count("*").alias("n"))
    odd = cut_lineage(counts.join(chosen, ["__a", "__b"], "left").where("chosen IS NULL OR n > 1"))
    one_each = lambda rows: rows.withColumn("nth", F.row_number().over(W.partitionBy("__a", "__b").orderBy("__a"))).where("nth = 1").select("row")
    if odd.count() * NAME_BYTES > MOST_BROADCAST:
        return one_each(named.join(chosen.drop("chosen"), ["__a", "__b"], "left_semi")).select(*unpacked(docs, "row", docs.columns))
    # Few names go or stand for several rows: texts need no shuffle but for rows that are repeated.
    out = named.join(F.broadcast(odd.select("__a", "__b")), ["__a", "__b"], "left_anti").select("row")
    again = odd.where("chosen AND n > 1").select("__a", "__b")
    if not again.isEmpty():
        out = out.unionByName(one_each(named.join(F.broadcast(again), ["__a", "__b"], "left_semi")))
    return out.select(*unpacked(docs, "row", docs.columns))
