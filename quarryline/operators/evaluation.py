"""Retrieval metrics, load reports and validation of published data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def gain(place: Column) -> Column:
    """Of a hit at a place from 1."""
    return 1.0 / F.log2(place + 1.0)


def query_metrics(judgments: DataFrame, results: DataFrame, k: int = 10) -> DataFrame:
    """precision, recall, reciprocal rank and NDCG at ``k`` of every judged query.

    ``judgments`` has (query_id, item_id), ``results`` (query_id, item_id, rank
    from 1).  Precision divides by ``k`` even if there are fewer results; the
    reciprocal rank looks at all of them; queries without results score 0.
    """
    relevant = judgments.select("query_id", "item_id").distinct()
    sizes = relevant.groupBy("query_id").agg(F.count("*").alias("relevant"))
    hits = results.join(relevant, ["query_id", "item_id"], "left_semi")
    inside = F.col("rank") <= k
    found = hits.groupBy("query_id").agg(F.count_if(inside).alias("hits"), F.min("rank").alias("first"), F.sum(F.when(inside, gain(F.col("rank"))).otherwise(0.0)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least("relevant", F.lit(k)).cast("int")), F.lit(0.0), lambda acc, i: acc + gain(i))
    rows = sizes.join(found, "query_id", "left")
    return rows.select(
        "query_id", (F.coalesce("hits", F.lit(0)) / F.lit(float(k))).alias("precision"), (F.coalesce("hits", F.lit(0)) / F.col("relevant")).alias("recall"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("reciprocal_rank"), F.coalesce(F.col("dcg") / ideal, F.lit(0.0)).alias("ndcg"),
    )


def report(metrics: DataFrame, floor: float = 0.5) -> DataFrame:
    """One row of means, and whether all of them reach the floor."""
    mean = lambda c: F.bround(F.avg(c), 6)
    names = {"precision": "mean_precision", "recall": "mean_recall", "reciprocal_rank": "mrr", "ndcg": "mean_ndcg"}
    out = metrics.agg(F.count("*").alias("queries"), *(mean(c).alias(n) for c, n in names.items()))
    passed = F.lit(True)
    for n in names.values():
        passed = passed & (F.coalesce(F.col(n), F.lit(0.0)) >= floor)
    return out.withColumn("passed", passed)


def nearest_rank(column: str, percent: float) -> Column:
    """The nearest-rank percentile."""
    return F.expr(f"percentile_disc({percent / 100.0}) WITHIN GROUP (ORDER BY {column})")


def load_report(runs: DataFrame, wall_seconds: float, *by: str) -> DataFrame:
    """Success rate, throughput and latencies of runs (duration_seconds, status)."""
    ok = F.count_if(F.col("status") == "completed")
    out = runs.groupBy(*by).agg(
        F.count("*").alias("total"), ok.alias("succeeded"), F.count_if(F.col("status") == "dead_letter").alias("dead_lettered"),
        (F.count("*") / F.lit(wall_seconds)).alias("throughput"), (ok / F.count("*")).alias("success_rate"),
        nearest_rank("duration_seconds", 50).alias("p50_seconds"), nearest_rank("duration_seconds", 95).alias("p95_seconds"),
    )
    return out.withColumn("meets_targets", (F.col("success_rate") >= 0.99) & (F.col("p95_seconds") <= 5.0))


def finding(rows: DataFrame, check: str, subject: str, severity: str = "error") -> DataFrame:
    return rows.select(F.lit(check).alias("check"), F.lit(severity).alias("severity"), F.col(subject).cast("string").alias("subject"))


def coverage_gaps(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """Expected keys that are missing."""
    return expected.select(*keys).distinct().join(actual.select(*keys).distinct(), keys, "left_anti")


def validate_chunks(manifests: DataFrame, chunks: DataFrame) -> DataFrame:
    """Findings where declared counts, token sums and ids of chunks don't hold."""
    counted = chunks.groupBy("document_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    repeated = chunks.groupBy("document_id", "chunk_id").agg(F.count("*").alias("writes")).where("writes > 1")
    joined = manifests.join(counted, "document_id", "left").fillna(0, ["n", "tokens"])
    out = finding(joined.where("chunk_count <> n"), "chunk_count_mismatch", "document_id")
    out = out.unionByName(finding(joined.where("total_tokens <> tokens"), "token_total_mismatch", "document_id"))
    return out.unionByName(finding(repeated, "duplicate_chunk_id", "document_id"))


def validate_vectors(chunks: DataFrame, vectors: DataFrame, dimension: int) -> DataFrame:
    """Findings for chunks without a vector, vectors without a chunk and vectors of another dimension."""
    key = ["document_id", "chunk_id"]
    label = lambda df: df.withColumn("subject", F.concat_ws("/", *key))
    out = finding(label(coverage_gaps(chunks, vectors, key)), "missing_vector", "subject")
    out = out.unionByName(finding(label(coverage_gaps(vectors, chunks, key)), "orphan_vector", "subject", "warning"))
    return out.unionByName(finding(label(vectors.where(F.size("vector") != dimension)), "dimension_mismatch", "subject"))


def validate_lineage(assets: DataFrame, edges: DataFrame) -> DataFrame:
    """Findings for edges whose ends are no assets, and for derived assets without a parent."""
    ids = assets.select("asset_id")
    lost = edges.join(ids, "asset_id", "left_anti")
    above = edges.join(ids.withColumnRenamed("asset_id", "parent_asset_id"), "parent_asset_id", "left_anti")
    rootless = assets.where("asset_type <> 'markdown'").join(edges.select("asset_id").distinct(), "asset_id", "left_anti")
    return finding(lost, "unknown_asset", "asset_id").unionByName(finding(above, "unknown_parent", "asset_id")).unionByName(finding(rootless, "missing_lineage", "asset_id"))


def verdict(findings: DataFrame) -> DataFrame:
    """One row: passed unless there is an error."""
    counts = findings.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.withColumn("passed", F.col("errors") == 0)


def readiness(facts: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row per rule over a one-row table of facts."""
    checks = F.array(*(F.struct(F.lit(n).alias("rule"), F.coalesce(c, F.lit(False)).alias("passed")) for n, c in rules.items()))
    return facts.select(F.explode(checks).alias("c")).select("c.*")


def release_decision(risks: DataFrame) -> DataFrame:
    """GO unless a blocking risk is open."""
    open_risk = F.coalesce(F.bool_or(F.col("blocking") & ~F.col("resolved")), F.lit(False))
    return risks.agg(F.count("*").alias("risks"), F.when(open_risk, "NO_GO").otherwise("GO").alias("decision"))
