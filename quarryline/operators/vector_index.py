"""Vector search by an inverted file: lists around centroids, of which a query reads a few.

Centroids are fitted on a sample of at most ``SAMPLE_ROWS`` vectors, which the
driver holds.  Every row is assigned to its nearest centroid's list, and lists
are the partitions of a table, so that lists nobody asks for aren't read.  A
query reads the lists of its nearest centroids.  How many is settled on the
sample too: as many as hold a share ``aim`` of the sampled vectors' own
nearest ones.  A query that may see few rows goes on: it skips lists without
rows for it, and reads until it has as many rows as one that sees all.
``search.vector_search`` is the exact search beside it, and ``recall``
compares the two.

Edge cases: rows and queries whose vector is null, of another length or of
length zero are in no list and find nothing.  An empty table has no lists.
Ties go by document and chunk, as in exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.functions import vectors as V
from quarryline.operators.nearest import nearest
from quarryline.operators.search import clearance_rank, comparable, few, levelled, parts_of, top, visible_to_queries
from quarryline.session import settle

SAMPLE_ROWS = 20_000
#: Rounds of fitting, and the share of nearest neighbours that probed lists should hold.
ROUNDS, AIM = 15, 0.97
#: Sampled vectors that settle how many lists are read.
TRIED = 500


def unit(x: np.ndarray) -> np.ndarray:
    norm = np.linalg.norm(x, axis=1, keepdims=True)
    return np.divide(x, norm, out=np.zeros_like(x), where=norm > 0)


@dataclass
class Centroids:
    """Unit vectors, one for each list, and how many lists a query reads that may see all rows."""

    matrix: np.ndarray
    probes: int

    def nearest(self, vectors: np.ndarray) -> np.ndarray:
        """Of each vector, all lists, the nearest first."""
        return np.argsort(-(unit(vectors) @ self.matrix.T), axis=1, kind="stable")


def fit(rows: DataFrame, size: int, lists: int | None = None, k: int = 10, aim: float = AIM, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> Centroids:
    """Spherical k-means of a sample: the ``sample_rows`` rows of least hash.  ``lists``: about the root of the number of rows."""
    usable = rows.where(F.size("vector") == size).select("vector")
    n = usable.count()
    taken = usable.orderBy(F.xxhash64(F.lit(seed), "vector")).limit(sample_rows).collect() if n else []
    sample = unit(np.array([r[0] for r in taken], np.float64).reshape(-1, size))
    sample = sample[np.abs(sample).sum(axis=1) > 0]
    lists = min(len(sample), lists or max(1, round(n**0.5)))
    if not lists:
        return Centroids(np.zeros((0, size)), 0)
    rng = np.random.default_rng(seed)
    matrix = sample[rng.choice(len(sample), lists, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ matrix.T, axis=1)
        sums = np.zeros_like(matrix)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=lists) == 0
        matrix = np.where(empty[:, None], matrix, unit(sums))
    found = Centroids(matrix, lists)
    tried = sample[rng.choice(len(sample), min(TRIED, len(sample)), replace=False)]
    best = np.argsort(-(tried @ sample.T), axis=1, kind="stable")[:, :k]
    place = np.argsort(found.nearest(tried), axis=1)  # of each list, for each tried vector
    needed = np.take_along_axis(place, np.argmax(sample @ matrix.T, axis=1)[best], axis=1)
    found.probes = int(np.quantile(needed, aim, method="higher")) + 1
    return found


def assigned(rows: DataFrame, centroids: Centroids, size: int) -> DataFrame:
    """``rows`` that have a vector, with their ``list``."""
    shared = rows.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("int")
    def nearest(vectors: pd.Series) -> pd.Series:
        x = unit(np.array(vectors.to_list(), np.float64).reshape(-1, size))
        return pd.Series(np.argmax(x @ shared.value.matrix.T, axis=1).astype(np.int32))

    usable = rows.where((F.size("vector") == size) & F.exists("vector", lambda x: x != 0))
    return usable.withColumn("list", nearest("vector"))


def build(rows: DataFrame, path: str, centroids: Centroids, size: int, files_per_list: int = 4) -> DataFrame:
    """The lists as partitions of a table at ``path``; a row's hash spreads a long list over some files."""
    spread = F.pmod(F.xxhash64("document_id", "chunk_id"), F.lit(files_per_list))
    assigned(rows, centroids, size).repartition("list", spread).write.partitionBy("list").parquet(path)
    return rows.sparkSession.read.schema(T.StructType([*rows.schema.fields, T.StructField("list", T.IntegerType())])).parquet(path)


def visible_lists(index: DataFrame, queries: DataFrame) -> DataFrame:
    """(q_tenant, q_clearance, lists, rows): of each kind of asker, the lists with rows that it may see, and how many."""
    counts = index.groupBy("list", "tenant_id", clearance_rank(F.col("classification_clearance")).alias("level")).agg(F.count("*").alias("n"))
    every = counts.groupBy("list", F.lit("").alias("tenant_id"), "level").agg(F.sum("n").alias("n"))
    askers = queries.select(F.coalesce("q_tenant", F.lit("")).alias("tenant_id"), F.coalesce("q_clearance", F.lit("public")).alias("clearance")).distinct()
    joined = askers.join(counts.where("tenant_id <> ''").unionByName(every), "tenant_id").where(F.col("level") <= clearance_rank(F.col("clearance")))
    sums = joined.groupBy("tenant_id", "clearance", "list").agg(F.sum("n").alias("n"))
    held = sums.groupBy("tenant_id", "clearance").agg(F.collect_list(F.struct("list", "n")).alias("held"))  # at most all lists
    return held.select(F.col("tenant_id").alias("own_tenant"), F.col("clearance").alias("own_clearance"), F.col("held.list").alias("lists"), F.col("held.n").alias("rows"))


def probed_lists(index: DataFrame, queries: DataFrame, centroids: Centroids, size: int, probes: int | None = None) -> DataFrame:
    """Queries with the ``lists`` that they read: the nearest with rows for them, until these are as many as in ``probes`` lists."""
    wanted = (probes or centroids.probes) * index.count() / max(1, len(centroids.matrix))
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    @F.pandas_udf("array<int>")
    def nearest_lists(vectors: pd.Series, lists: pd.Series, rows: pd.Series) -> pd.Series:
        out = []
        for order, own, n in zip(shared.value.nearest(np.array(vectors.to_list(), np.float64).reshape(-1, size)), lists, rows, strict=True):
            held = np.zeros(len(order))
            held[np.asarray(own, np.int64)] = n
            order = order[held[order] > 0]
            before = np.cumsum(held[order]) - held[order]
            out.append(order[before < wanted].astype(np.int32))
        return pd.Series(out, dtype="object")

    usable = queries.where((F.size("q_vector") == size) & F.exists("q_vector", lambda x: x != 0))
    same = (F.coalesce("q_tenant", F.lit("")) == F.col("own_tenant")) & (F.coalesce("q_clearance", F.lit("public")) == F.col("own_clearance"))
    joined = usable.join(visible_lists(index, usable), same).withColumnsRenamed({"lists": "own_lists", "rows": "own_rows"})
    return joined.withColumn("lists", nearest_lists("q_vector", "own_lists", "own_rows")).drop("own_tenant", "own_clearance", "own_lists", "own_rows")


def probed(index: DataFrame, queries: DataFrame, centroids: Centroids, size: int, probes: int | None = None) -> DataFrame:
    """Queries with each ``list`` that they read."""
    return probed_lists(index, queries, centroids, size, probes).withColumn("list", F.explode("lists")).drop("lists")


def pairs(index: DataFrame, asked: DataFrame) -> DataFrame:
    """Rows of the lists that a query reads and may see."""
    return index.join(few(asked), "list").where(visible_to_queries(index))


def pair_count(index: DataFrame, asked: DataFrame) -> DataFrame:
    """How many rows queries may see (``n``), in the lists that they read if ``asked`` has them: from numbers of rows, without the pairs."""
    by = ["list"] if "list" in asked.columns else []
    rows = index.groupBy(*by, "tenant_id", "classification_clearance").agg(F.count("*").alias("rows"))
    queries = asked.groupBy(*by, "q_tenant", "q_clearance").agg(F.count("*").alias("queries"))
    joined = rows.join(queries, by) if by else rows.join(few(queries))
    seen = joined.where(visible_to_queries(rows))
    return seen.agg(F.coalesce(F.sum(F.col("rows") * F.col("queries")), F.lit(0)).alias("n"))


def search(index: DataFrame, queries: DataFrame, centroids: Centroids, size: int, k: int = 10, probes: int | None = None) -> DataFrame:
    """Like ``search.vector_search`` by cosine, over the probed lists only."""
    if not len(centroids.matrix):
        return top(index.join(queries, F.lit(False)).withColumn("score", F.lit(0.0)), k).withColumn("engine", F.lit("vector"))
    key = ["document_id", "chunk_id"]
    asked = settle(probed_lists(index, queries, centroids, size, probes))
    read = asked.select(F.explode("lists").alias("list")).distinct()
    rows = index.join(F.broadcast(read), "list", "left_semi")  # at most all lists
    scored = nearest(comparable(rows, "list"), parts_of(levelled(asked, "lists")), k, "cosine", ["query_id"])
    best = top(scored, k).select("query_id", *key, "score", "rank")
    return index.dropDuplicates(key).join(best, key).withColumn("engine", F.lit("vector"))


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """Of each query: how many of the exact results were found."""
    key = ["query_id", "document_id", "chunk_id"]
    hits = exact.select(*key).join(found.select(*key).withColumn("hit", F.lit(1)), key, "left")
    return hits.groupBy("query_id").agg(F.count("*").alias("wanted"), F.count("hit").alias("found"))
