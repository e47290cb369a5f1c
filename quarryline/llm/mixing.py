"""Mixing sources to target weights by a hypergeometric splitting tree.

Source targets come from water filling: a share of all words is dealt out by
weight, a source stops at ``most`` times its size, and what is left goes to
the others by weight.  A source's documents, in a seeded pseudo-random order,
make a stream of words that may be read up to ``most`` times; the mix takes
the first ``target`` words of it.  That stretch is cut into blocks of
``block_words``.  A binary tree over the output shards splits the exact block
quotas of all sources: each inner node draws its left child's share from a
multivariate hypergeometric distribution.  A shard then owns consecutive,
disjoint blocks of each permuted stream, and its rows are shuffled by a
seeded hash.

Positions in a stream come from two-level sums (buckets of about a thousand
documents, then documents), so a source that holds a third of all rows is
never gathered in one task.  Equal rows are counted and numbered, and the
number goes into their order, so that many copies of one row spread over the
stream like other rows.  Per source only single rows of sums are brought
together: targets and the tree's top see one row for each source.

Edge cases: a null text has size 0 and is never taken; null sources are one
source, ordered last; rows that repeat an id are documents of their own;
a source without words has target 0; an empty table gives an empty mix.
Texts are read whole, whatever their length.  Equal hashes are ordered by id,
size and copy.  ``mix`` has the columns it names; ``mixed_documents`` returns
those of its input, of whatever names, and cuts texts only at a target.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.llm.common import STRING, WORD, attach, cut_lineage, hashable_columns, row_of

#: Weights of the sources in code point order, repeating.
WEIGHTS = (3.0, 1.0, 2.0)
SHARE, MOST = 1.5, 2
BLOCK_WORDS = 65_536
#: Blocks in one output shard, about.
SHARD_BLOCKS = 64
BUCKET_DOCS = 1000
#: Equal documents that are numbered in one go.
COPIES = 100_000
#: Subtrees that are split on their own.
TOP_NODES = 256
SEED = 20240229


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights: tuple[float, ...] = WEIGHTS) -> DataFrame:
    """(source, source_size, target) from (source, source_size), one row per source.

    A source at its limit drops out of the sharing; one sum over the sources
    per round until no other one reaches its limit.
    """
    place = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = sizes.withColumn("place", place).withColumn("weight", weight).withColumn("limit", F.col("source_size") * most).withColumn("full", F.lit(False))
    rows = cut_lineage(rows)
    total = (rows.agg(F.sum("source_size")).first()[0] or 0) * share
    level, before = 0.0, -1
    while True:
        is_full = F.col("limit") <= F.col("weight") * level if level else F.lit(False)
        sums = rows.agg(F.sum(F.when(is_full, F.col("limit")).otherwise(0)).alias("used"), F.sum(F.when(is_full, 0.0).otherwise(F.col("weight"))).alias("w"), F.count_if(is_full).alias("n")).first()
        if not sums["w"] or sums["n"] == before:
            break
        level, before = (total - float(sums["used"])) / sums["w"], sums["n"]
    return rows.select("source", "source_size", F.least(F.col("limit").cast("double"), F.col("weight") * F.lit(level)).alias("target"))


# --- splitting tree -------------------------------------------------------------


def node_rng(seed: int, first: int, last: int) -> np.random.Generator:
    return np.random.default_rng([seed, first, last])


def split(quota: np.ndarray, first: int, last: int, leaf: int, seed: int) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first shard, past the last, quotas) of the nodes over at most ``leaf`` shards.

    ``quota`` holds a node's blocks by source; the left child has its part of
    the node's shards of all blocks, drawn without replacement.
    """
    stack = [(first, last, quota)]
    while stack:
        a, b, q = stack.pop()
        if b - a <= leaf:
            yield a, b, q
            continue
        middle, total = (a + b) // 2, int(q.sum())
        left = node_rng(seed, a, b).multivariate_hypergeometric(q, total * (middle - a) // (b - a), method="marginals")
        stack += [(middle, b, q - left), (a, middle, left)]


def splitter(leaf: int, seed: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("source_rank")
        a, b = int(rows["first"].iloc[0]), int(rows["last"].iloc[0])
        out = [pd.DataFrame({"first": x, "last": y, "source_rank": rows["source_rank"].to_numpy(), "quota": q}) for x, y, q in split(rows["quota"].to_numpy(np.int64), a, b, leaf, seed)]
        return pd.concat(out)

    return run


def block_table(goals: DataFrame, block_words: int = BLOCK_WORDS, shard_blocks: int = SHARD_BLOCKS, seed: int = SEED) -> DataFrame:
    """(source_rank, block, shard): the shard that owns each block of each source's stream."""
    quotas = cut_lineage(goals.select("source_rank", F.ceil(F.col("goal") / block_words).cast("long").alias("quota")).where("quota > 0"))
    total = quotas.agg(F.sum("quota")).first()[0] or 0
    count = max(1, -(-total // shard_blocks))
    schema = "first long, last long, source_rank int, quota long"
    top = quotas.select(F.lit(0).cast("long").alias("first"), F.lit(count).cast("long").alias("last"), "source_rank", "quota")
    nodes = top.groupBy("first", "last").applyInPandas(splitter(max(1, -(-count // TOP_NODES)), seed), schema)
    shards = nodes if count <= TOP_NODES else nodes.groupBy("first", "last").applyInPandas(splitter(1, seed), schema)
    earlier = F.coalesce(F.sum("quota").over(W.partitionBy("source_rank").orderBy("first").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    spans = shards.where("quota > 0").withColumn("begin", earlier)
    return spans.select("source_rank", F.explode(F.sequence(F.col("begin"), F.col("begin") + F.col("quota") - 1)).alias("block"), F.col("first").alias("shard"))


# --- streams ---------------------------------------------------------------------


def told_apart(rows: DataFrame, chunk: int = COPIES) -> DataFrame:
    """``rows`` with ``copy``, which numbers equal ones; they are counted first and never meet as rows."""
    names = rows.columns
    counts = rows.groupBy(*names).agg(F.count("*").alias("copies"))
    # A row with very many copies is dealt out in chunks before it is made that many again.
    parts = counts.withColumn("first", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1, F.lit(chunk).cast("long"))))
    parts = parts.repartition(F.col("first"), *(F.col(c) for c in names[:2])) if counts.where(F.col("copies") > chunk).limit(1).count() else parts
    copies = F.sequence(F.col("first"), F.least(F.col("first") + chunk, F.col("copies")) - 1)
    return parts.select(*names, F.explode(copies).alias("copy"))


def mix(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", extra: list[Column] | None = None, seed: int = SEED) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, taken, copy, shards and words (by reading).

    ``shards[e]`` and ``words[e]`` tell which shard reads the document in the
    stream's reading ``e``, and how many of its words.  ``extra`` columns, such
    as row names, ride along.  Documents that are equal in all of these differ
    in ``copy``, and so in their place in the stream.
    """
    extra = extra or []
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), F.xxhash64(text).alias("text_hash"), *extra)
    names = [c for c in rows.columns if c not in ("doc_id", "source", "size", "text_hash")]
    rows = told_apart(cut_lineage(rows)).withColumn("order", F.xxhash64(F.lit(seed), "doc_id", "text_hash", "copy")).drop("text_hash")
    rows = cut_lineage(rows)
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("source_docs"))
    goals = targets(sums.select("source", "source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last()))
    goals = attach(goals, sums.select("source", "source_docs"), ["source"]).withColumn("source_rank", rank).withColumn("goal", F.round("target").cast("long"))
    goals = cut_lineage(goals)
    blocks = cut_lineage(block_table(goals, seed=seed))
    rows = attach(rows, goals, ["source"])
    # unsigned order of the hash: its bucket, then the rest
    bucket = F.floor(F.pmod(F.shiftrightunsigned("order", 24), F.lit(1 << 40)) * (F.ceil(F.col("source_docs") / BUCKET_DOCS) / F.lit(float(1 << 40)))).cast("long")
    rows = rows.withColumn("bucket", bucket)
    totals = rows.groupBy("source_rank", "bucket").agg(F.sum("size").alias("bucket_size"))
    offset = F.coalesce(F.sum("bucket_size").over(W.partitionBy("source_rank").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = totals.withColumn("bucket_begin", offset).select("source_rank", "bucket", "bucket_begin")
    within = W.partitionBy("source_rank", "bucket").orderBy("order", "doc_id", "size", "copy").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.withColumn("begin_in_bucket", F.coalesce(F.sum("size").over(within), F.lit(0))).join(offsets, ["source_rank", "bucket"])
    rows = rows.withColumn("begin", F.col("bucket_begin") + F.col("begin_in_bucket"))
    for e in range(MOST):
        start = F.col("begin") + F.col("source_size") * e
        words = F.greatest(F.lit(0), F.least(F.col("size"), F.col("goal") - start))
        owner = blocks.select("source_rank", F.col("block").alias(f"block{e}"), F.col("shard").alias(f"shard{e}"))
        # Rows without words here match no block; their own bucket spreads them over the join.
        rows = rows.withColumn(f"words{e}", words).withColumn(f"block{e}", F.when(words > 0, F.floor(start / BLOCK_WORDS)).otherwise(-1 - F.col("bucket")))
        rows = rows.join(owner, ["source_rank", f"block{e}"], "left").withColumn(f"words{e}", F.when(F.col(f"shard{e}").isNull(), F.lit(0)).otherwise(F.col(f"words{e}")))
    taken = sum((F.col(f"words{e}") for e in range(MOST)), F.lit(0)).cast("long")
    readings = {"shards": F.array(*(F.col(f"shard{e}") for e in range(MOST))), "words": F.array(*(F.col(f"words{e}") for e in range(MOST)))}
    return rows.select("doc_id", "size", "source", "source_size", "target", taken.alias("taken"), "copy", *(v.alias(k) for k, v in readings.items()), *names)


@F.pandas_udf(STRING)
def cut_to_words(texts: pd.Series, words: pd.Series) -> pd.Series:
    """The text up to the end of its n-th word, with the white space between as it is."""
    word = re.compile(WORD)

    def cut(text: str, n: int) -> str:
        for i, m in enumerate(word.finditer(text), 1):
            if i == n:
                return text[: m.end()]
        return text

    return pd.Series([None if t is None else cut(t, int(n)) for t, n in zip(texts, words, strict=True)])


def mixed_documents(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", source: str = "source", seed: int = SEED) -> DataFrame:
    """The mix itself: the columns of ``docs``, a row for each reading of a document, shard by shard in shuffled order.

    A document that the target cuts off ends after its last taken word.
    """
    columns = hashable_columns(docs)
    names = [F.xxhash64(*columns).alias("a"), F.hash(*columns).alias("b")]
    plan = mix(docs, text, doc_id, source, extra=names, seed=seed)
    reads = F.filter(F.arrays_zip("shards", "words"), lambda r: r["words"] > 0)
    plan = plan.select("a", "b", "copy", "size", F.explode(reads).alias("read"))
    # Rows that are equal in all columns share a name; one of them stands for all, once for each reading of each copy.
    rows = docs.select(row_of(docs).alias("row"), *names).withColumn("nth", F.row_number().over(W.partitionBy("a", "b").orderBy("a"))).where("nth = 1")
    rows = rows.drop("nth").join(plan, ["a", "b"])
    whole = F.col("row").getField(text)
    cut = cut_to_words(F.when(F.col("read.words") < F.col("size"), whole), F.col("read.words"))
    rows = rows.withColumn("cut", F.coalesce(cut, whole))
    order = F.xxhash64(F.lit(seed + 1), "a", "copy", "read.words")
    rows = rows.repartition(F.col("read.shards")).sortWithinPartitions("read.shards", order)
    return rows.select(*(F.col("cut").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in docs.columns))
