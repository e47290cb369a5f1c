"""The inverted file: all rows are in a list, all lists give the exact result, few give most of it."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarryline.operators import search, vector_index

SIZE = 16
CORPUS = "document_id string, chunk_id string, tenant_id string, classification_clearance string, vector array<float>"


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    centers = rng.normal(size=(30, SIZE)) * 3
    rows = []
    for i in range(1500):
        x = centers[i % 30] + rng.normal(size=SIZE)
        rows.append((str(i), "c", f"t{i % 2}", search.CLEARANCES[i % 5], [float(v) for v in x]))
    rows += [("null", "c", "t0", "public", None), ("short", "c", "t0", "public", [1.0]), ("zero", "c", "t0", "public", [0.0] * SIZE)]
    rows += [(f"copy{i}", "c", "t0", "public", rows[3][4]) for i in range(400)]  # a long list
    return spark.createDataFrame(rows, CORPUS).repartition(4)


@pytest.fixture(scope="module")
def asked(corpus):
    q = corpus.where("length(document_id) = 3 AND document_id LIKE '%7'").select(F.col("document_id").alias("query_id"), F.col("vector").alias("q_vector"))
    return q.withColumn("q_clearance", F.when(F.col("query_id") < "5", "restricted").otherwise("internal")).withColumn("q_tenant", F.when(F.col("query_id") < "3", "t1").otherwise(""))


@pytest.fixture(scope="module")
def built(corpus, tmp_path_factory):
    centroids = vector_index.fit(corpus, SIZE)
    path = str(tmp_path_factory.mktemp("index") / "lists")
    return vector_index.build(corpus, path, centroids, SIZE), centroids, path


def told(df):
    return sorted((r["query_id"], r["rank"], r["document_id"], round(r["score"], 9)) for r in df.collect())


def test_every_vector_is_in_one_list(corpus, built):
    index, centroids, _ = built
    assert index.count() == index.select("document_id").distinct().count() == 1900
    assert len(centroids.matrix) == round(1901**0.5)  # the root of the rows of the right length


def test_all_lists_give_the_exact_result(corpus, asked, built):
    index, centroids, _ = built
    every = vector_index.search(index, asked, centroids, SIZE, 10, probes=len(centroids.matrix))
    assert told(every) == told(search.vector_search(corpus, asked, 10, SIZE)) != []


def test_few_lists_give_most_of_it(corpus, asked, built):
    index, centroids, _ = built
    assert centroids.probes < len(centroids.matrix) / 4
    found = vector_index.search(index, asked, centroids, SIZE)
    sums = vector_index.recall(found, search.vector_search(corpus, asked, 10, SIZE)).agg(F.sum("found"), F.sum("wanted")).first()
    assert sums[0] >= 0.9 * sums[1]
    rows = vector_index.pairs(index, vector_index.probed(index, asked, centroids, SIZE)).count()
    assert rows < index.join(search.few(asked), search.visible_to_queries(index)).count()


def test_who_sees_everything_reads_few_lists(corpus, asked, built):
    index, centroids, _ = built
    free = asked.withColumn("q_clearance", F.lit("restricted")).withColumn("q_tenant", F.lit(""))
    found = vector_index.search(index, free, centroids, SIZE)
    sums = vector_index.recall(found, search.vector_search(corpus, free, 10, SIZE)).agg(F.sum("found"), F.sum("wanted")).first()
    assert sums[0] >= 0.9 * sums[1]
    rows = vector_index.pairs(index, vector_index.probed(index, free, centroids, SIZE)).count()
    assert rows < index.count() * asked.count() / 3


def test_visible_lists(built, asked):
    index, _, _ = built
    told = {(r["own_tenant"], r["own_clearance"]): dict(zip(r["lists"], r["rows"], strict=True)) for r in vector_index.visible_lists(index, asked).collect()}
    for r in asked.select("q_tenant", "q_clearance").distinct().collect():
        seen = search.visible(index, search.allowed_clearances(r["q_clearance"]), r["q_tenant"])
        assert told[r["q_tenant"], r["q_clearance"]] == {x["list"]: x["count"] for x in seen.groupBy("list").count().collect()}


def test_lists_that_nobody_asks_for_are_not_read(asked, built, spark):
    index, centroids, path = built
    one = asked.where("query_id = '107'")
    plan = vector_index.search(index, one, centroids, SIZE)._jdf.queryExecution().toString()
    assert "dynamicpruning" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert len(glob.glob(f"{path}/list=*")) > 20


def test_empty_and_unusable(spark, corpus, asked, built, tmp_path):
    index, centroids, _ = built
    bad = spark.createDataFrame([("a", None, "public", ""), ("b", [1.0], "public", ""), ("c", [0.0] * SIZE, "public", "")], "query_id string, q_vector array<float>, q_clearance string, q_tenant string")
    assert vector_index.search(index, bad, centroids, SIZE).count() == 0
    nothing = vector_index.fit(corpus.limit(0), SIZE)
    assert nothing.probes == 0
    empty = vector_index.build(corpus.limit(0), str(tmp_path / "empty"), nothing, SIZE)
    assert vector_index.search(empty, asked, nothing, SIZE).count() == 0


def test_fitting_agrees_over_partitions(corpus):
    a, b = vector_index.fit(corpus, SIZE, sample_rows=300), vector_index.fit(corpus.repartition(7), SIZE, sample_rows=300)
    assert a.probes == b.probes and np.array_equal(a.matrix, b.matrix)


def test_pairs_are_counted_from_numbers_of_rows(asked, built):
    index, centroids, _ = built
    lists = vector_index.probed(index, asked, centroids, SIZE)
    assert vector_index.pair_count(index, lists).first()["n"] == vector_index.pairs(index, lists).count()
    assert vector_index.pair_count(index, asked).first()["n"] == index.join(search.few(asked), search.visible_to_queries(index)).count()
    assert vector_index.pair_count(index, asked.limit(0)).first()["n"] == 0


def test_lists_meet_queries_by_blocks(asked, built):
    index, centroids, _ = built
    assert "q_norm" not in vector_index.search(index, asked, centroids, SIZE)._jdf.queryExecution().toString()
