"""Versioned assets, vector collections and event logs as Parquet tables.

Tables are folders that Spark reads and writes; nothing here opens a path
itself, so any store that Spark reaches will do.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.changes import latest


class AssetStore:
    """Immutable contents by (key, version)."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    SCHEMA = "key string, version int, content binary, content_hash string, size_bytes long"

    def table(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)

    def exists(self) -> bool:
        hadoop = self.spark._jvm.org.apache.hadoop.fs.Path(self.path)
        return hadoop.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(hadoop)

    def put(self, assets: DataFrame) -> None:
        """Append (key, version, content); a version that is there already is refused."""
        rows = assets.select("key", "version", "content", F.sha2("content", 256).alias("content_hash"), F.length("content").cast("long").alias("size_bytes"))
        if self.exists() and not rows.join(self.table().select("key", "version"), ["key", "version"], "left_semi").isEmpty():
            raise ValueError("an asset version can't be written twice")
        rows.write.mode("append").parquet(self.path)

    def put_next(self, assets: DataFrame) -> None:
        """Append (key, content) as the next version of each key."""
        if not self.exists():
            return self.put(assets.withColumn("version", F.lit(1)))
        last = self.table().groupBy("key").agg(F.max("version").alias("__last"))
        self.put(assets.join(last, "key", "left").withColumn("version", F.coalesce("__last", F.lit(0)) + 1).drop("__last"))

    def put_changed(self, assets: DataFrame) -> None:
        """``put_next`` for contents that differ from the key's latest version."""
        fresh = assets
        if self.exists():
            fresh = changed(assets, self.latest(), "key")
        self.put_next(fresh)

    def latest(self) -> DataFrame:
        return latest(self.table(), ["key"], F.col("version"))

    def versions(self, key: str) -> DataFrame:
        return self.table().where(F.col("key") == key).select("version", "content_hash", "size_bytes").orderBy("version")


def changed(incoming: DataFrame, current: DataFrame, key: str) -> DataFrame:
    """Incoming rows whose content isn't that of the key's current row."""
    known = current.select(key, F.col("content_hash").alias("__hash"))
    hashed = incoming.withColumn("__new", F.sha2("content", 256))
    same = (hashed[key] == known[key]) & (hashed["__new"] == known["__hash"])
    return hashed.join(known, same, "left_anti").drop("__new")


def upsert_vectors(stored: DataFrame, points: DataFrame, dimension: int, metric: str = "cosine") -> DataFrame:
    """A collection after an upsert by vector_id: the last of repeated points wins, by its position.

    Points of another dimension or metric than the collection's fail.
    """
    newest = latest(points, ["vector_id"], F.col("position"))
    conflict = F.raise_error(F.lit("vector doesn't fit the collection's dimension or metric"))
    fits = (F.size("vector") == dimension) & (F.col("distance_metric") == metric)
    checked = newest.withColumn("vector", F.when(fits, F.col("vector")).otherwise(conflict))
    kept = stored.join(newest.select("vector_id"), "vector_id", "left_anti")
    return kept.unionByName(checked.select(*stored.columns))


def delete_vectors(stored: DataFrame, ids: DataFrame) -> DataFrame:
    return stored.join(ids.select("vector_id").distinct(), "vector_id", "left_anti")


def collection_schema(points: DataFrame) -> DataFrame:
    """One row per collection: dimension, metric, model and version of its newest points, and how many there are."""
    return points.groupBy("collection").agg(
        F.count("*").alias("points"), F.max(F.size("vector")).alias("dimension"), F.min(F.size("vector")).alias("least_dimension"),
        F.max("distance_metric").alias("distance_metric"), F.max("embedding_model").alias("embedding_model"), F.max("embedding_version").alias("embedding_version"),
    )


def embedding_profile(schemas: DataFrame, model: str = "local-hash", dimension: int = 64, metric: str = "cosine") -> DataFrame:
    """What a query must be embedded with: from the collection where it is known, from settings otherwise."""
    inherited = F.col("embedding_model").isNotNull() & F.col("distance_metric").isNotNull()
    return schemas.select(
        "collection", F.coalesce("dimension", F.lit(dimension)).alias("dimension"), F.coalesce("distance_metric", F.lit(metric)).alias("distance_metric"),
        F.coalesce("embedding_model", F.lit(model)).alias("embedding_model"), F.when(inherited, "inherited").otherwise("hybrid").alias("source"),
    )


def vectors_per_document(points: DataFrame) -> DataFrame:
    return points.groupBy("document_id").agg(F.count("*").alias("vectors"))


def append_events(events: DataFrame, path: str) -> None:
    """Events (stage, event_type, tenant_id, subject, ts, detail) at the end of a log of JSON lines."""
    events.write.mode("append").json(path)


def read_events(spark: SparkSession, path: str, schema: str, tenant_id: str = "") -> DataFrame:
    rows = spark.read.schema(schema).json(path)
    return rows.where(F.col("tenant_id") == tenant_id) if tenant_id else rows


def conversation_list(messages: DataFrame, conv: str = "conv_id") -> DataFrame:
    """Conversations, the last touched first, titled by their first user message."""
    first = F.min_by(F.when(F.col("role") == "user", F.col("content")), F.when(F.col("role") == "user", F.col("turn")))
    title = F.left(F.regexp_replace(F.trim(F.coalesce(first, F.lit("New conversation"))), r"\s+", " "), F.lit(60))
    return messages.groupBy(conv).agg(F.max("turn").alias("last_turn"), F.count("*").alias("messages"), title.alias("title")).orderBy(F.desc("last_turn"), conv)


def conversation_title(text: Column) -> Column:
    return F.left(F.regexp_replace(F.trim(text), r"\s+", " "), F.lit(60))
