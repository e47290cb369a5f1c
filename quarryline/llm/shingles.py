"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 or more.

A first search is given by the caller: from fingerprints of the sets, pairs
that may be similar (``simhash``).  Those that whole sets confirm are links,
and texts in one component by them are offered to each other no more.

The search for the rest is exact: a prefix-filtered join.  All shingles have one global
order.  Two sets of similarity 0.8 share at least ``alpha(n)`` shingles for
either size n, so they share ``l`` or more among the first
n - alpha(n) + l of each; ``l`` grows with n, so that one common passage makes
no candidates.  The order is by hash, with the shingles that many texts have
in their first ones put last by a count over part of the texts; any order gives the same links.

A shingle's texts are its posting.  Short postings give all their pairs,
counted by pair.  A long posting is that of many near copies: each text
carries a parity bitmap of its set, whose distance is never above the sets'
symmetric difference, and a first round links texts to a few leaders only.
After those links are confirmed and joined to components, a second round
offers each text its nearest one of another component, by bitmap, and a last
round takes every remaining pair of different components that the bitmaps
allow.  So every
pair of similarity 0.8 is confirmed or already in one component, and a group
of near copies gives few rows.  Candidates are confirmed on the whole sets.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import LONG, cut_lineage, record, small_enough
from quarryline.llm.components import components

WORDS = 5
#: An odd constant of well spread bits (2^64 over the golden ratio).
FACTOR = np.uint64(0x9E3779B97F4A7C15)
SEED = 42
#: Of a posting over this, pairs aren't listed; a shingle that is a first one about so often is put last.
LONG_POSTING = 64
#: One text of so many is counted to find the shingles that are put last.
COUNTED = 4
#: Shingles that are put last, at most: their list goes to every task.
MOST_LAST = 1_000_000
#: Texts of a long posting that the others are linked to in the first round.
LEADERS = 32
BITMAP = 2048
#: Texts whose sets a worker holds at a time.
TEXTS = 256
#: Rows of whole postings that are searched together.
POSTING_ROWS = 50_000
#: Candidates up to this number are broadcast to the texts.
FEW = 200_000

LONGS = T.ArrayType(LONG)
END_OF_WORD = re.compile(rb"[ \t\n\x0b\x0c\r]")


#: Fixed random numbers that stand for the bytes of a word.
BYTES = np.random.default_rng(SEED).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
#: Bytes of a text whose words are hashed together; a longer word is hashed whole.
SEGMENT = 1 << 16


@lru_cache(1)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """FACTOR^i and FACTOR^-i modulo 2^64."""
    tables = []
    for factor in (int(FACTOR), pow(int(FACTOR), -1, 1 << 64)):
        table = np.full(n, np.uint64(factor))
        table[0] = 1
        tables.append(np.multiply.accumulate(table))
    return tables[0], tables[1]


def word_hashes(raw: bytes) -> np.ndarray:
    """A polynomial of every word's bytes, from one running sum over the text."""
    parts, at = [], 0
    while at < len(raw):
        part = raw[at : at + SEGMENT]
        if at + SEGMENT < len(raw):  # end it behind a word
            cut = max(part.rfind(c) for c in (b" ", b"\t", b"\n", b"\x0b", b"\x0c", b"\r"))
            if cut < 0:
                word = END_OF_WORD.search(raw, at + SEGMENT)
                cut = (word.start() if word else len(raw)) - at
                part = raw[at : at + cut]
            part = part[: cut + 1]
        at += len(part)
        codes = np.frombuffer(part, np.uint8)
        inside = np.zeros(len(codes) + 2, bool)
        inside[1:-1] = ~WHITE[codes]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        up, down = powers(SEGMENT + 1) if len(codes) <= SEGMENT else powers.__wrapped__(len(codes) + 1)
        sums = np.zeros(len(codes) + 1, np.uint64)
        np.cumsum(BYTES[codes] * up[: len(codes)], out=sums[1:])
        parts.append((sums[edges[1::2]] - sums[edges[::2]]) * down[edges[::2]])
    return np.concatenate(parts) if parts else np.zeros(0, np.uint64)


def shingle_set(text: str | None) -> np.ndarray:
    """Sorted distinct hashes of the lower-cased shingles; a shorter text is one shingle, a wordless one none.

    A shingle's hash is a mixed polynomial of its words'.
    """
    h = word_hashes((text or "").encode().lower())
    if not len(h):
        return h
    size = min(WORDS, len(h))
    n = len(h) - size + 1
    h ^= h >> np.uint64(32)  # else a shingle's words would make one polynomial of bytes
    h *= BYTES[0]
    out = h[:n].copy()
    for k in range(1, size):
        out *= FACTOR
        out += h[k : k + n]
    out ^= out >> np.uint64(31)
    out *= FACTOR
    out ^= out >> np.uint64(29)
    out.sort()
    return out[np.concatenate(([True], out[1:] != out[:-1]))]


def node_of(grams: np.ndarray) -> int:
    """One name for all texts with the same set."""
    return int(np.uint64(xxhash.xxh64_intdigest(grams.tobytes(), SEED)).view(np.int64))


def alpha(n):
    return -(-4 * n // 5)


def shared(n):
    """Shingles that two similar sets share among their first ones; n is the smaller size."""
    return 1 + n // 50


def firsts_of(n: int) -> int:
    return n - alpha(n) + shared(n)


def ordered(grams: np.ndarray, last: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """The set in the global order; ``last`` is sorted, ``rank`` is its order."""
    if not len(last):
        return grams
    at = np.minimum(np.searchsorted(last, grams), len(last) - 1)
    common = last[at] == grams
    return np.concatenate((grams[~common], grams[common][np.argsort(rank[at[common]])]))


def bitmap(grams: np.ndarray) -> bytes:
    """Parity of the number of shingles at each bit."""
    counts = np.bincount((grams >> np.uint64(17)).astype(np.int64) % BITMAP, minlength=BITMAP)
    return np.packbits((counts & 1).astype(np.uint8)).tobytes()


def marks(fingerprint: Callable[[np.ndarray], int]) -> Callable:
    """A text's node, its set's fingerprint, and for one node of COUNTED half as many shingles again as its first ones by hash."""

    @F.pandas_udf(record(node=LONG, print=LONG, counted=LONGS))
    def run(texts: pd.Series) -> pd.DataFrame:
        nodes, prints, counted = [], [], []
        for text in texts:
            grams = shingle_set(text)
            nodes.append(node_of(grams))
            prints.append(fingerprint(grams))
            most = 0 if nodes[-1] % COUNTED else firsts_of(len(grams)) * 3 // 2 + 8
            counted.append(grams[:most].view(np.int64).copy())
        return pd.DataFrame({"node": nodes, "print": np.array(prints, np.uint64).view(np.int64), "counted": counted})

    return run


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A batch in parts, so that a worker holds the sets of few texts."""
    for batch in batches:
        for at in range(0, batch.num_rows, TEXTS):
            yield batch.slice(at, TEXTS)


def lists(parts: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts).view(np.int64)))


def signatures(last: np.ndarray, rank: np.ndarray) -> Callable:
    """From (text): a text's node, the size, bitmap and first ones of its set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches):
            sets = [shingle_set(t) for t in part.column(0).to_pylist()]
            firsts = [ordered(x, last, rank)[: firsts_of(len(x))] for x in sets]
            columns = [pa.array([node_of(x) for x in sets], pa.int64()), pa.array([len(x) for x in sets], pa.int64()), pa.array([bitmap(x) for x in sets], pa.binary()), lists(firsts)]
            yield pa.RecordBatch.from_arrays(columns, ["node", "n", "bits", "grams"])

    return run


def whole_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (node, text): (node, grams)."""
    for part in slices(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), lists([shingle_set(t) for t in part.column(1).to_pylist()])], ["node", "grams"])


# --- postings ------------------------------------------------------------------


def whole_postings(batches: Iterator[pa.RecordBatch]) -> Iterator[list[pa.Array]]:
    """Columns of rows sorted by their first one, in blocks that end with a posting."""
    held, count = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        count += batch.num_rows
        if count < POSTING_ROWS:
            continue
        rows = pa.Table.from_batches(held).combine_chunks()
        gram = rows.column(0).to_numpy()
        cut = int(np.searchsorted(gram, gram[-1]))  # the last posting may go on
        if cut:
            yield rows.slice(0, cut).columns
        held, count = rows.slice(cut).to_batches(), rows.num_rows - cut
    if held:
        yield pa.Table.from_batches(held).columns


def starts_of(gram: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))


def alike(n: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Sizes at which a similarity of 0.8 can be."""
    return 5 * np.minimum(n, m) >= 4 * np.maximum(n, m)


def meet(long_posting: int) -> Callable:
    """From (gram, node, n): the pairs (a, b, need) of short postings, and the rows (a, gram) of long ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_postings(batches):
            gram, node, n = (c.to_numpy() for c in columns)
            new = np.concatenate(([True], (gram[1:] != gram[:-1]) | (node[1:] != node[:-1])))  # copies share a node
            gram, node, n = gram[new], node[new], n[new]
            start = starts_of(gram)
            size = np.diff(np.append(start, len(gram)))
            size_at = np.repeat(size, size)
            short = np.flatnonzero((size_at > 1) & (size_at <= long_posting))
            place = np.arange(len(gram)) - np.repeat(start, size)
            for d in range(1, long_posting):
                short = short[place[short] + d < size_at[short]]
                if not len(short):
                    break
                one, two = short, short + d
                ok = alike(n[one], n[two])
                one, two = one[ok], two[ok]
                need = shared(np.minimum(n[one], n[two]))
                yield pa.RecordBatch.from_arrays([pa.array(node[one]), pa.array(node[two]), pa.array(need), pa.nulls(len(one), pa.int64())], ["a", "b", "need", "gram"])
            many = size_at > long_posting
            none = pa.nulls(int(many.sum()), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(node[many]), none, none, pa.array(gram[many])], ["a", "b", "need", "gram"])

    return run


def allowed(bits: np.ndarray, n: np.ndarray, one: int, others: np.ndarray) -> np.ndarray:
    """Which of the others may be similar to one, by size and bitmap."""
    others = others[alike(n[others], n[one])]
    apart = np.bitwise_count(bits[others] ^ bits[one]).sum(axis=1, dtype=np.int64)
    return others[9 * apart <= n[others] + n[one]]


def by_leaders(most: int) -> Callable:
    def run(n, bits, component) -> Iterator[tuple[int, np.ndarray]]:
        left = np.arange(len(n))
        for _ in range(most):
            if len(left) < 2:
                return
            near = allowed(bits, n, left[0], left[1:])
            yield int(left[0]), near
            left = np.setdiff1d(left[1:], near, assume_unique=True)

    return run


def nearest(n, bits, component) -> Iterator[tuple[int, np.ndarray]]:
    """For each text outside the largest component, the allowed one of another component whose bitmap is nearest."""
    names, at, counts = np.unique(component, return_inverse=True, return_counts=True)
    rest = np.arange(len(n))
    for one in np.flatnonzero(at != np.argmax(counts)):
        others = allowed(bits, n, one, rest[at != at[one]])
        if len(others):
            apart = np.bitwise_count(bits[others] ^ bits[one]).sum(axis=1, dtype=np.int64)
            yield int(one), others[np.argmin(apart)][None]


def across(n, bits, component) -> Iterator[tuple[int, np.ndarray]]:
    """All allowed pairs of different components; those of the largest meet the others from their side."""
    names, at, counts = np.unique(component, return_inverse=True, return_counts=True)
    largest = np.argmax(counts)
    rest = np.arange(len(n))
    for one in np.flatnonzero(at != largest):
        yield int(one), allowed(bits, n, one, rest[(at != at[one]) & ((rest > one) | (at == largest))])


def search(way: Callable) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for columns in whole_postings(batches):
            gram, node, n, component = (c.to_numpy() for c in (*columns[:3], columns[4]))
            packed = columns[3].combine_chunks() if isinstance(columns[3], pa.ChunkedArray) else columns[3]
            bits = np.frombuffer(b"".join(packed.to_pylist()), np.uint64).reshape(len(gram), BITMAP // 64)
            start = starts_of(gram)
            for a, b in zip(start, np.append(start[1:], len(gram))):
                for one, others in way(n[a:b], bits[a:b], component[a:b]):
                    if len(others):
                        x, y = np.full(len(others), node[a + one]), node[a + others]
                        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], ["a", "b"])

    return run


def searched(rows: DataFrame, way: Callable) -> DataFrame:
    """Candidates (a, b) of long postings."""
    dealt = rows.select("gram", "node", "n", "bits", "component").repartition("gram").sortWithinPartitions("gram", "node")
    return dealt.mapInArrow(search(way), "a long, b long").distinct()


# --- links ---------------------------------------------------------------------


def confirmed(pairs: DataFrame, firsts: DataFrame, texts: DataFrame, repeated: DataFrame | None) -> DataFrame:
    """The pairs whose whole sets have a similarity of 0.8 or more.

    ``repeated`` has the names (__a, __b) that stand for several rows of one
    text.  Only their sets are shuffled once more, to leave one of each.
    """
    asked = cut_lineage(pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(firsts, "node").select("node", "first.__a", "first.__b"))

    def sets_of(names: DataFrame) -> DataFrame:
        side = F.broadcast(names) if small_enough(names, FEW) else names
        return texts.join(side, ["__a", "__b"]).select("node", "text").mapInArrow(whole_sets, "node long, grams array<long>")

    if repeated is None:
        sets = sets_of(asked)
    else:
        sets = sets_of(asked.join(repeated, ["__a", "__b"], "left_anti")).unionByName(sets_of(asked.join(repeated, ["__a", "__b"], "left_semi")).dropDuplicates(["node"]))
    met = pairs.join(sets.select(F.col("node").alias("a"), F.col("grams").alias("x")), "a").join(sets.select(F.col("node").alias("b"), F.col("grams").alias("y")), "b")
    both = F.size(F.array_intersect("x", "y"))
    return cut_lineage(met.where(9 * both >= 4 * (F.size("x") + F.size("y"))).select("a", "b"))


def apart(pairs: DataFrame, links: DataFrame) -> DataFrame:
    """The pairs (a, b) whose nodes the links don't join."""
    if links.isEmpty():
        return pairs
    member = cut_lineage(components(links))
    for end in ("a", "b"):
        pairs = pairs.join(member.select(F.col("node").alias(end), F.col("component").alias(f"of_{end}")), end, "left")
    return pairs.where("coalesce(of_a, a) <> coalesce(of_b, b)").select("a", "b")


def similar(texts: DataFrame, fingerprint: Callable[[np.ndarray], int], candidates: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """From (__a, __b, key, text): (node, first), the least key of every distinct set, links (a, b) of nodes, and all keys.

    ``fingerprint`` is that of a set's hashes; ``candidates`` makes pairs
    (a, b) that are tried first from rows (node, print).  The links join exactly the sets of similarity 0.8 or more into components.
    """
    marked = cut_lineage(texts.select("key", marks(fingerprint)(F.col("text")).alias("m")).select("key", "m.node", "m.print", "m.counted"))
    firsts = cut_lineage(marked.groupBy("node").agg(F.min("key").alias("first"), F.min("print").alias("print")))
    repeated = cut_lineage(marked.groupBy("key.__a", "key.__b").agg(F.count("*").alias("n")).where("n > 1").select("__a", "__b"))
    repeated = None if repeated.isEmpty() else repeated
    links = confirmed(cut_lineage(candidates(firsts.select("node", "print")).distinct()), firsts, texts, repeated)
    counts = marked.select(F.explode("counted").alias("gram")).groupBy("gram").agg(F.count("*").alias("n")).where(COUNTED * F.col("n") > LONG_POSTING)
    common = counts.orderBy(F.desc("n"), "gram").limit(MOST_LAST).toPandas()
    last, n = common["gram"].to_numpy(np.int64).view(np.uint64), common["n"].to_numpy(np.int64)
    by_hash = np.argsort(last)
    last, rank = last[by_hash], np.argsort(np.lexsort((last[by_hash], n[by_hash])))
    signed = cut_lineage(texts.select("text").mapInArrow(signatures(last, rank), "node long, n long, bits binary, grams array<long>"))
    postings = signed.select(F.explode("grams").alias("gram"), "node", "n").repartition("gram").sortWithinPartitions("gram", "node")
    met = cut_lineage(postings.mapInArrow(meet(LONG_POSTING), "a long, b long, need long, gram long"))
    pairs = met.where("b IS NOT NULL").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "need")
    pairs = pairs.groupBy("a", "b").agg(F.count("*").alias("n"), F.first("need").alias("need")).where("n >= need").select("a", "b")
    long = cut_lineage(met.where("b IS NULL").select("gram", F.col("a").alias("node")).join(signed.select("node", "n", "bits").dropDuplicates(["node"]), "node"))
    led = searched(long.withColumn("component", F.col("node")), by_leaders(LEADERS))
    left = cut_lineage(apart(pairs.unionByName(led).distinct(), links))
    links = links.unionByName(confirmed(left, firsts, texts, repeated))
    keys = marked.select("key")
    if long.isEmpty():
        return firsts, links, keys
    for way in (nearest, across):  # the first joins most of what is still apart, by few candidates; the second leaves none
        joined = long.join(components(links), "node", "left").withColumn("component", F.coalesce("component", "node"))
        found = cut_lineage(searched(joined, way))
        if found.isEmpty():
            break
        links = links.unionByName(confirmed(found, firsts, texts, repeated))
    return firsts, links, keys
