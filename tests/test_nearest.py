"""Block-wise nearest rows against a plain loop: order, ties, odd numbers, and how many rows leave a task."""

import math
import os
import random

import pytest
from pyspark.sql import functions as F

from quarryline import catalog
from quarryline.operators import search
from quarryline.operators.nearest import nearest

ROWS = "document_id string, chunk_id string, content string, tenant_id string, classification_clearance string, vector array<double>"
ASKED = "query_id int, q_vector array<double>, q_clearance string, q_tenant string"
SIZE = 6
SF_DIR = "/root/testdata/sf0.001"


def total(xs):
    out = 0.0
    for x in xs:
        out += x
    return out


def score(metric, a, b):
    if metric == "euclidean":
        return 1 / (1 + math.sqrt(total((x - y) * (x - y) for x, y in zip(a, b, strict=True))))
    dot = total(x * y for x, y in zip(a, b, strict=True))
    return dot if metric == "dot" else dot / (math.sqrt(total(x * x for x in a)) * math.sqrt(total(x * x for x in b)))


def tables(n=900, asked=40):
    rng = random.Random(2)
    vector = lambda: [rng.uniform(-1, 1) for _ in range(SIZE)]
    common = vector()
    rows = [(f"d{rng.randrange(300)}x{i}", "c", "text", f"t{i % 3}", search.CLEARANCES[i % 5], common if i % 4 == 0 else vector()) for i in range(n)]
    queries = [(i, common if i % 7 == 0 else vector(), search.CLEARANCES[i % 5], f"t{i % 2}" if i % 3 == 0 else "") for i in range(asked)]
    return rows, queries


def wanted(rows, queries, metric, k):
    out = []
    for q, v, level, tenant in queries:
        seen = [r for r in rows if search.CLEARANCES.index(r[4]) <= search.CLEARANCES.index(level) and tenant in ("", r[3])]
        best = sorted((-s, r[0]) for r in seen if (s := score(metric, r[5], v)) > 0)[:k]
        out += [(q, place, d, max(0.0, min(1.0, -s))) for place, (s, d) in enumerate(best)]
    return sorted(out)


def agrees(spark, metric):
    rows, queries = tables()
    found = search.vector_search(spark.createDataFrame(rows, ROWS).repartition(3), spark.createDataFrame(queries, ASKED), 5, SIZE, metric)
    assert sorted((r["query_id"], r["rank"], r["document_id"], r["score"]) for r in found.collect()) == wanted(rows, queries, metric, 5)


def test_cosines_to_the_last_digit(spark):
    agrees(spark, "cosine")


def test_few_rows_leave_a_task(spark):
    """The pairs aren't sorted: of 20 queries with 6,000 rows each task gives few more than the wanted ones."""
    rows = spark.range(6000).select(
        F.format_string("%05d", "id").alias("document_id"), F.lit("c").alias("chunk_id"), F.lit("public").alias("classification_clearance"), F.lit("t").alias("tenant_id"),
        F.array(*(F.sin(F.col("id") * (i + 1.3)) for i in range(SIZE))).alias("vector"),
    ).repartition(2)
    queries = spark.range(20).select(F.col("id").alias("query_id"), F.array(*(F.cos(F.col("id") * (i + 0.7)) for i in range(SIZE))).alias("q_vector"), F.lit("public").alias("q_clearance"), F.lit("").alias("q_tenant"))
    assert nearest(search.comparable(rows), [search.levelled(queries)], 10, "cosine", ["query_id"]).count() == 2 * 20 * 10


def test_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [("nan", [nan, 1.0]), ("inf", [inf, 1.0]), ("huge", [1e200, 1e200]), ("tiny", [1e-200, 1e-200]), ("null", [None, 1.0]), ("zero", [0.0, 0.0]), ("one", [1.0, 1.0]), ("long", [1.0, 1.0, 1.0]), ("none", None)]
    corpus = spark.createDataFrame([(d, "c", "x", "t", "public", v) for d, v in rows] + [("unknown", "c", "x", "t", "odd", [1.0, 1.0])], ROWS)
    asked = spark.createDataFrame([(1, [1.0, 1.0], "public", ""), (2, [1.0, 1.0], "odd", ""), (3, None, "public", "")], ASKED)
    got = [(r["query_id"], r["document_id"], round(r["score"], 6)) for r in search.vector_search(corpus, asked, 10, 2).orderBy("query_id", "rank").collect()]
    # what Spark's arithmetic gives: no number counts as the greatest, and a length that overflows makes 0
    assert got == [(1, "inf", 1.0), (1, "nan", 1.0), (1, "one", 1.0)]
    got = [(r["document_id"], round(r["score"], 6)) for r in search.vector_search(corpus, asked, 10, 2, "dot").orderBy("rank").collect()]
    assert got == [("nan", 1.0), ("inf", 1.0), ("huge", 1.0), ("one", 1.0), ("tiny", 0.0)]


def test_distances_to_the_last_digit(spark):
    agrees(spark, "euclidean")


def test_close_rows_of_equal_score_go_by_document(spark):
    """Distances that differ by less than the block's product can tell."""
    rows = [(f"d{i}", "c", "x", "t", "public", [1.0 + i * 1e-13, 1.0]) for i in range(40)] + [("a", "c", "x", "t", "public", [1.0, 1.0])]
    asked = spark.createDataFrame([(1, [1.0, 1.0], "public", "")], ASKED)
    found = search.vector_search(spark.createDataFrame(rows, ROWS), asked, 4, 2, "euclidean").orderBy("rank").collect()
    want = sorted((-score("euclidean", r[5], [1.0, 1.0]), r[0]) for r in rows)[:4]
    assert [(-r["score"], r["document_id"]) for r in found] == want


@pytest.mark.parametrize("name", ["eval_metrics", "eval_report"])
def test_evaluation_pairs_no_vectors(spark, name):
    if not os.path.isdir(SF_DIR):
        pytest.skip("no test tables")
    assert "q_vector" not in catalog.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().toString()
