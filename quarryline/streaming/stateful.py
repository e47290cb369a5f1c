"""Streams: files as they arrive, sessions, memory expiry and job leases.

The reference semantics have no streams; these forms are extensions whose
results equal the batch operators' once the watermark has passed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryline.operators.jobs import claim
from quarryline.sources.files import FilePolicy, extension, included


def arriving_files(spark: SparkSession, root: str, policy: FilePolicy = FilePolicy(), per_trigger: int = 1000) -> DataFrame:
    """New files below ``root`` that pass the policy, as a stream."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(root)
    named = files.select(F.col("path").alias("source_path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified_at"), "content")
    # Hidden folders above the root don't count, so only the name is judged.
    return named.withColumn("extension", extension(F.col("source_path"))).where(included(FilePolicy(False, policy.ignore_temp, policy.extensions, policy.max_bytes)))


def sessions(events: DataFrame, key: str, ts: str = "ts", ttl_seconds: int = 3600, late: str = "10 minutes") -> DataFrame:
    """Sessions of a stream.

    Session windows join events exactly one gap apart, while a session ends at
    its TTL; the gap is one microsecond short of it.
    """
    gap = f"{ttl_seconds - 1} seconds 999999 microseconds"
    marked = events.withWatermark(ts, late)
    out = marked.groupBy(key, F.session_window(ts, gap)).agg(F.count("*").alias("events"), F.min(ts).alias("started_at"), F.max(ts).alias("last_seen"))
    return out.drop("session_window")


def tumbling_counts(events: DataFrame, width: str, *by: str, ts: str = "ts", late: str = "10 minutes") -> DataFrame:
    """Counts and sums per window and key; events later than ``late`` are left out."""
    window = events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return window.select(F.col("window.start").alias("window_start"), *by, "n", "total")


def distinct_arrivals(events: DataFrame, key: list[str], ts: str = "ts", late: str = "1 hour") -> DataFrame:
    """The first event of each key within the watermark."""
    return events.withWatermark(ts, late).dropDuplicatesWithinWatermark(key)


def lease_jobs(ticks: DataFrame, load: Callable[[], DataFrame], store: Callable[[DataFrame], None], worker: str, batch: int, checkpoint: str):
    """At every micro-batch of ``ticks`` (one row with ``now``) claims jobs; a single writer, so claims can't collide."""

    def step(rows: DataFrame, _: int) -> None:
        now = rows.agg(F.max("now")).first()[0]
        if now is not None:
            store(claim(load(), worker, F.lit(now), batch))

    return ticks.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
