"""Ranked lexical search: three phases over postings partitioned by term.

The index is one table of postings (term, impact, row), dealt by ranges of
(term, impact) and sorted by falling impact, so that a term's list is
contiguous, its head comes first, and a list that a third of all documents
are in spans many files.  An impact is what the term adds to a document's
score for each time that an item asks for it.

1. The heads, the k best postings of every list, give each item partial sums;
   the k-th of them is a lower bound of the k-th best score.
2. Every list of an item is read down to one uniform threshold, that bound
   over the number of lists: a document below it in all of them can't reach
   the bound.  What is read is dealt by document and summed; a list in which
   a document wasn't met bounds what it may still add.  Documents whose sum
   and bounds don't reach the k-th best sum so far are left out.
3. The others are looked up in the lists that weren't read down to them, and
   ranked by their exact scores.

Scores are 64-bit integers, so nothing depends on the order of a sum.

Items are handled in blocks of ``BLOCK_TERMS`` (item, term) rows; a block's
terms and thresholds go to every task, and that size bounds them.

Edge cases: a null or empty text has no terms, isn't counted and is never a
result; a null or empty item gets no rows.  Repeated document rows are
documents of their own, and so are repeated items.  Equal scores go by
ascending id, null ids last, then by row.  Texts of any length are read whole.
No documents or no items give no rows.  Columns other than those named are
ignored, so none can clash.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.llm.common import LONG, STRING, cut_lineage, record, small_enough, written

TOP = 20
#: (item, term) rows of a block of items; a single item may have more.
BLOCK_TERMS = 200_000
#: Sums of (document, item) that a worker has in hand.
PAIRS = 1_000_000
#: Candidates up to this number are broadcast to the lists.
FEW = 500_000

#: A-Z becomes a-z and every other ASCII character but a-z and 0-9 becomes a space; other bytes stay.
FOLDED = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

INTEGER = T.IntegerType()


def terms_of(raw: bytes | None) -> list[bytes]:
    return (raw or b"").translate(FOLDED).split()


def asked_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From (item, text): a row for each of an item's terms, with its count."""
    for batch in batches:
        counts = [Counter(terms_of(x)) for x in batch.column("text").to_pylist()]
        at = np.repeat(np.arange(len(counts)), [len(c) for c in counts])
        item = batch.column("item").take(pa.array(at))
        terms = pa.array([t.decode() for c in counts for t in c], pa.string())
        yield pa.RecordBatch.from_arrays([item, terms, pa.array([n for c in counts for n in c.values()], pa.int64())], ["item", "term", "times"])


def occurrences(codes) -> Callable:
    """From (row, doc_id, text): a text's length under code -1, and its count of each term in ``codes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = codes.value.get
        for batch in batches:
            sizes, found = [], []
            for raw in batch.column("text").to_pylist():
                words = terms_of(raw)
                counts = Counter(map(known, words))
                counts.pop(None, None)
                sizes.append(len(words))
                found.append({-1: len(words)} | counts)
            each = [len(c) for c in found]
            at = pa.array(np.repeat(np.arange(len(found)), each))
            code = np.fromiter(chain.from_iterable(found), np.int32, sum(each))
            times = np.fromiter(chain.from_iterable(c.values() for c in found), np.int64, sum(each))
            own = [batch.column("row").take(at), batch.column("doc_id").take(at)]
            yield pa.RecordBatch.from_arrays([*own, pa.array(np.repeat(np.array(sizes, np.int64), each)), pa.array(code), pa.array(times)], ["row", "doc_id", "size", "code", "times"])

    return run


class Lists:
    """The lists of each term that the items read: item, times asked, threshold, and the most that an unread posting adds."""

    def __init__(self, rows: list, heads: dict[int, int], bound: dict[int, int]):
        """``rows``: (item number, code, times) by code; ``heads``: the best impact of a code; ``bound``: of an item's k-th score."""
        rows = [r for r in rows if r[1] in heads]
        lists = Counter(r[0] for r in rows)
        self.item = np.array([r[0] for r in rows], np.int64)
        self.times = np.array([r[2] for r in rows], np.int64)
        # An impact is read if impact * times * lists >= bound.
        self.least = np.array([-(-bound.get(q, 0) // (lists[q] * n)) for q, _, n in rows], np.int64)
        best = np.array([heads[c] for _, c, _ in rows], np.int64)
        self.unread = np.maximum(0, np.minimum(best, self.least - 1)) * self.times
        codes = np.array([r[1] for r in rows], np.int64)
        size = 1 + max(heads, default=-1)
        self.starts, self.ends = np.searchsorted(codes, np.arange(size)), np.searchsorted(codes, np.arange(size), "right")
        self.items = 1 + int(self.item.max(initial=-1))
        self.all_unread = np.zeros(self.items, np.int64)
        np.add.at(self.all_unread, self.item, self.unread)
        self.bound = np.zeros(self.items, np.int64)
        for q, b in bound.items():
            if q < self.items:
                self.bound[q] = b
        #: Of each code: what is read at all, and what some item leaves unread.
        spans = [(c, self.least[a:b]) for c, (a, b) in enumerate(zip(self.starts, self.ends, strict=True)) if a < b]
        self.read = [(c, int(x.min()), int(x.max())) for c, x in spans]
        self.code = codes

    def unread_rows(self) -> list[tuple[int, int, int, int]]:
        return list(zip(self.item.tolist(), self.code.tolist(), self.times.tolist(), self.least.tolist(), strict=True))


class Best:
    """The k greatest sums of each item so far; the least of k is a lower bound of its k-th score."""

    def __init__(self, bound: np.ndarray, k: int):
        self.bound, self.k = bound.copy(), k
        self.item, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, item: np.ndarray, sums: np.ndarray) -> None:
        over = sums > self.bound[item]
        item, sums = np.concatenate((self.item, item[over])), np.concatenate((self.sums, sums[over]))
        order = np.lexsort((-sums, item))
        item, sums = item[order], sums[order]
        place = np.arange(len(item)) - np.searchsorted(item, item)
        full = place == self.k - 1
        self.bound[item[full]] = np.maximum(self.bound[item[full]], sums[full])
        self.item, self.sums = item[place < self.k], sums[place < self.k]


def partial_sums(shared, k: int) -> Callable:
    """From (row, code, impact) sorted by row: (item, row, sum) of documents that may still be among the k best."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lists: Lists = shared.value
        best = Best(lists.bound, k)
        rest = [np.zeros(0, np.int64)] * 3

        def summed(row, code, impact):
            each = lists.ends[code] - lists.starts[code]
            total = np.cumsum(each)
            first = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
            at = 0
            while at < len(row):  # whole documents, about PAIRS sums at a time
                far = int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right"))
                i = int(np.searchsorted(first, far, "right"))
                end = len(row) if far >= len(row) else int(first[i - 1])
                if end <= at:
                    end = int(first[i]) if i < len(first) else len(row)
                yield one(row[at:end], code[at:end], impact[at:end], each[at:end])
                at = end

        def one(row, code, impact, each):
            source = np.repeat(np.arange(len(row)), each)
            place = np.arange(len(source)) - np.repeat(np.cumsum(each) - each, each) + lists.starts[code][source]
            read = impact[source] >= lists.least[place]
            source, place = source[read], place[read]
            document = np.cumsum(np.concatenate(([0], row[1:] != row[:-1])))[source]
            key = document * lists.items + lists.item[place]
            order = np.argsort(key, kind="stable")
            source, place, key = source[order], place[order], key[order]
            starts = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
            if not len(starts):
                return [np.zeros(0, np.int64)] * 3
            sums = np.add.reduceat(impact[source] * lists.times[place], starts)
            item = lists.item[place[starts]]
            most = sums + lists.all_unread[item] - np.add.reduceat(lists.unread[place], starts)
            best.add(item, sums)
            may = most >= best.bound[item]
            return [item[may], row[source[starts]][may], sums[may]]

        def told(item, row, sums):
            return pa.RecordBatch.from_arrays([pa.array(item.astype(np.int32)), pa.array(row), pa.array(sums)], ["number", "row", "sum"])

        for batch in batches:
            row, code, impact = (np.concatenate((x, batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64))) for x, c in zip(rest, ("row", "code", "impact"), strict=True))
            cut = int(np.searchsorted(row, row[-1])) if len(row) else 0
            rest = [row[cut:], code[cut:], impact[cut:]]
            if cut:
                yield from (told(*x) for x in summed(row[:cut], code[:cut], impact[:cut]))
        if len(rest[0]):
            yield from (told(*x) for x in summed(*rest))

    return run


def kth(rows: DataFrame, value: Column, k: int, **more: Column) -> DataFrame:
    """Of each item, by its number: the k-th greatest value, where there are k."""
    best = rows.withColumn("place", F.row_number().over(Window.partitionBy("number").orderBy(value.desc()))).where(F.col("place") <= k)
    return best.groupBy("number").agg(F.count("*").alias("n"), F.min(value).alias("bound")).where(F.col("n") == k).select("number", "bound")


def postings(docs: DataFrame, codes: dict[bytes, int]) -> tuple[DataFrame, DataFrame, dict[int, int]] | None:
    """The term-partitioned lists (code, impact, row), the names (row, doc_id) of the documents, and each list's best impact."""
    spark = docs.sparkSession
    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id"), F.col("text").cast("binary").alias("text"))
    kinds = record(row=LONG, doc_id=docs.schema["doc_id"].dataType, size=LONG, code=INTEGER, times=LONG)
    seen = written(rows.mapInArrow(occurrences(spark.sparkContext.broadcast(codes)), kinds), "occurrences")
    names = seen.where("code = -1")
    n, words = names.where("size > 0").agg(F.count("*"), F.sum("size")).first()
    if not n:
        return None
    frequency = seen.where("code >= 0").groupBy("code").agg(F.count("*").alias("df"))  # one row for each term of the block
    weight = F.floor(F.lit(1000.0) * F.log((F.lit(2.0 * n) + 2) / (F.col("df") * 2 + 1))).cast("long")
    length = F.expr(f"75L + ((25L * size * {n}L) div {words}L)")
    weighted = seen.where("code >= 0").join(F.broadcast(frequency.select("code", weight.alias("weight"))), "code").withColumn("length", length)
    impact = F.expr("weight * ((1000000000L * times) div (1000L * times + 12L * length))")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), seen.rdd.getNumPartitions())
    order = [F.col("code"), F.col("impact").desc(), F.col("row")]
    dealt = weighted.select("code", impact.alias("impact"), "row").repartitionByRange(parts, *order).sortWithinPartitions(*order)
    lists = written(dealt, "postings")
    best = {r[0]: r[1] for r in lists.groupBy("code").agg(F.max("impact")).collect()}  # a number for each term of the block
    return lists, names.select("row", "doc_id"), best


def search_block(docs: DataFrame, asked: list, k: int) -> DataFrame | None:
    """(number, rank, doc_id, score) for one block of items; ``asked``: (item number, term, times)."""
    spark = docs.sparkSession
    codes = {t.encode(): i for i, t in enumerate(sorted({r[1] for r in asked}))}
    if not codes or not (found := postings(docs, codes)):
        return None
    lists, names, best = found
    rows = sorted(((q, codes[t.encode()], n) for q, t, n in asked), key=lambda r: r[1])
    wanted = F.broadcast(spark.createDataFrame(rows, "number int, code int, times long"))
    # 1. Heads.
    order = Window.partitionBy("code").orderBy(F.col("impact").desc(), "row")
    heads = lists.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k)
    sums = heads.join(wanted, "code").groupBy("number", "row").agg(F.sum(F.col("impact") * F.col("times")).alias("sum"))
    bound = {r[0]: r[1] for r in kth(sums, F.col("sum"), k).collect()}  # a number for each item of the block
    # 2. All lists down to the threshold, summed by document.
    plan = Lists(rows, best, bound)
    limits = F.broadcast(spark.createDataFrame(plan.read, "code int, least long, most long"))
    read = lists.join(limits, "code").where(F.col("impact") >= F.col("least")).select("row", "code", "impact")
    dealt = read.repartition("row").sortWithinPartitions("row")
    near = cut_lineage(dealt.mapInArrow(partial_sums(spark.sparkContext.broadcast(plan), k), record(number=INTEGER, row=LONG, sum=LONG)))
    # 3. Exact scores of what may be among the k best.
    known = {r[0]: r[1] for r in kth(near, F.col("sum"), k).collect()}
    final = [(q, int(max(plan.bound[q], known.get(q, 0))), int(plan.all_unread[q])) for q in range(plan.items)]
    ends = F.broadcast(spark.createDataFrame(final, "number int, bound long, open long"))
    near = near.join(ends, "number").where(F.col("sum") + F.col("open") >= F.col("bound")).select("number", "row", "sum")
    places = near.select("row").distinct()
    places = F.broadcast(places) if small_enough(places, FEW) else places
    unread = F.broadcast(spark.createDataFrame(plan.unread_rows(), "number int, code int, times long, below long"))
    low = lists.join(limits, "code").where(F.col("impact") < F.col("most")).join(places, "row", "left_semi").join(unread, "code").where(F.col("impact") < F.col("below"))
    late = low.select("number", "row", (F.col("impact") * F.col("times")).alias("sum")).join(near.select("number", "row"), ["number", "row"], "left_semi")
    exact = near.unionByName(late).groupBy("number", "row").agg(F.sum("sum").alias("score")).where("score > 0")
    named = exact.join(names, "row")
    rank = F.row_number().over(Window.partitionBy("number").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last(), "row"))
    return named.withColumn("rank", rank).where(F.col("rank") <= k).select("number", "rank", "doc_id", "score")


def search(docs: DataFrame, items: DataFrame, k: int = TOP, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """The k best documents (doc_id, text) for every item (item_id, text): item_id, rank, doc_id, score."""
    spark = docs.sparkSession
    own = cut_lineage(items.select(F.monotonically_increasing_id().alias("item"), "item_id", F.col("text").cast("binary").alias("text")))
    asked = cut_lineage(own.select("item", "text").mapInArrow(asked_terms, record(item=LONG, term=STRING, times=LONG)))
    blocks = -(-asked.count() // block_terms)
    kinds = T.StructType([items.schema["item_id"], T.StructField("rank", INTEGER), docs.schema["doc_id"], T.StructField("score", LONG)])
    found = []
    for b in range(blocks):
        rows = asked.where(F.pmod(F.xxhash64("item"), F.lit(blocks)) == b).collect()
        number = {x: i for i, x in enumerate(sorted({r[0] for r in rows}))}
        if (best := search_block(docs, [(number[r[0]], r[1], r[2]) for r in rows], k)) is not None:
            numbers = F.broadcast(spark.createDataFrame(list(number.items()), "item long, number int"))
            found.append(best.join(numbers, "number").join(own.select("item", "item_id"), "item").select("item_id", "rank", "doc_id", "score"))
    return reduce(DataFrame.unionByName, found) if found else spark.createDataFrame([], kinds)
