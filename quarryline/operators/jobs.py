"""Ingestion jobs: queueing, leases, retries, progress and status boards.

Time is a column or a literal, never the clock, so results can be repeated.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.operators.changes import file_name
from quarryline.session import settle

#: Stages in order with the asset that each makes and its mark.
STAGES = [("markdown", "T"), ("intelligence", "I"), ("chunks", "C"), ("embedding", "E"), ("vector", "P")]
ACTIVE = ["queued", "running"]
#: States from which a job may be requeued, and errors that tell of a lost payload.
RECOVERABLE = ["dead_letter", "failed"]
LOST_PAYLOAD = ["payload unavailable", "missing_markdown", "missing_chunks"]
ERROR_CHARS = 4000
#: Order of the status board.
BOARD = ["dead_letter", "running", "waiting", "queued", "complete", "deleted"]


def seconds(n: Column | float) -> Column:
    return F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), n if isinstance(n, Column) else F.lit(float(n)))


def enqueue(jobs: DataFrame, incoming: DataFrame) -> DataFrame:
    """Jobs to add: one for each key that no queued or running job has."""
    key = ["tenant_id", "document_id", "kind", "content_hash"]
    fresh = incoming.groupBy(*key).agg(F.min_by(F.struct(*[c for c in incoming.columns if c not in key]), "job_id").alias("__job")).select(*key, "__job.*")
    return fresh.join(jobs.where(F.col("status").isin(*ACTIVE)).select(*key), key, "left_anti").withColumn("status", F.lit("queued"))


def claimable(jobs: DataFrame, now: Column, visibility_seconds: float = 3600.0) -> DataFrame:
    """Jobs that are due and queued, or running under a lock that has grown stale."""
    stale = (F.col("status") == "running") & (F.col("locked_at") < now - seconds(visibility_seconds))
    return jobs.where((F.col("available_at") <= now) & ((F.col("status") == "queued") | stale))


def claim(jobs: DataFrame, worker: str, now: Column, batch: int = 1, visibility_seconds: float = 3600.0) -> DataFrame:
    """The next ``batch`` jobs as the worker holds them; a bounded sort."""
    order = [F.desc("priority"), F.asc("available_at"), F.asc("created_at"), F.asc("job_id")]
    taken = claimable(jobs, now, visibility_seconds).orderBy(*order).limit(batch)
    return taken.withColumns({"status": F.lit("running"), "locked_by": F.lit(worker), "locked_at": now, "attempts": F.col("attempts") + 1})


def backoff_seconds(attempts: Column, base: float = 30.0, factor: float = 2.0, most: float = 900.0) -> Column:
    return F.least(F.lit(base) * F.pow(F.lit(factor), F.greatest(attempts - 1, F.lit(0))), F.lit(most))


def failed(jobs: DataFrame, now: Column, error: str = "error") -> DataFrame:
    """Failed jobs requeued with a delay, or dead-lettered when their attempts are used up."""
    dead = F.col("attempts") >= F.col("max_attempts")
    later = now + seconds(backoff_seconds(F.col("attempts")).cast("decimal(18,6)"))
    return jobs.withColumns({
        "status": F.when(dead, "dead_letter").otherwise("queued"), "available_at": F.when(dead, F.col("available_at")).otherwise(later),
        "last_error": F.left(F.coalesce(F.col(error), F.lit("")), F.lit(ERROR_CHARS)), "locked_by": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp"),
    })


def succeeded(jobs: DataFrame) -> DataFrame:
    return _unlocked(jobs, "succeeded")


def released(jobs: DataFrame, now: Column) -> DataFrame:
    """Given back unworked: the attempt doesn't count."""
    return _unlocked(jobs, "queued").withColumn("attempts", F.greatest(F.col("attempts") - 1, F.lit(0))).withColumn("available_at", now)


def cancelled(jobs: DataFrame) -> DataFrame:
    return _unlocked(jobs.where(F.col("status").isin(*ACTIVE)), "cancelled")


def requeued(jobs: DataFrame, now: Column) -> DataFrame:
    """Dead, cancelled and failed jobs from the start, newest first when listed."""
    back = jobs.where(F.col("status").isin("dead_letter", "cancelled"))
    return _unlocked(back, "queued").withColumns({"attempts": F.lit(0), "available_at": now, "last_error": F.lit(None).cast("string")})


def to_requeue(jobs: DataFrame, tenant_id: str, job_id: int | str | None = None, document_id: str | None = None) -> DataFrame:
    """A tenant's jobs that a requeue is for: one job, those of one document, or all dead and failed ones."""
    own = jobs.where(F.col("tenant_id") == tenant_id)
    if job_id is not None:
        return own.where(F.col("job_id") == job_id)
    if document_id is not None:
        return own.where(F.col("document_id") == document_id)
    return own.where(F.col("status").isin(*RECOVERABLE))


def lost_payloads(jobs: DataFrame, sources: DataFrame, tenant_id: str) -> DataFrame:
    """A tenant's dead ingest jobs whose error names a lost payload, and whether their source is staged.

    ``sources`` has tenant_id and document_id.  Jobs with a source can start
    again once their document's assets are gone (``changes.cascade_delete``).
    """
    lost = F.lit(False)
    for sign in LOST_PAYLOAD:
        lost = lost | F.coalesce(F.contains("last_error", F.lit(sign)), F.lit(False))
    dead = jobs.where((F.col("tenant_id") == tenant_id) & (F.col("kind") == "ingest") & (F.col("status") == "dead_letter") & lost)
    staged = sources.where(F.col("tenant_id") == tenant_id).select("document_id").distinct().withColumn("recoverable", F.lit(True))
    return dead.join(staged, "document_id", "left").withColumn("recoverable", F.coalesce("recoverable", F.lit(False)))


def heartbeat(jobs: DataFrame, worker: str, now: Column) -> DataFrame:
    held = (F.col("status") == "running") & (F.col("locked_by") == worker)
    return jobs.withColumn("locked_at", F.when(held, now).otherwise(F.col("locked_at")))


def _unlocked(jobs: DataFrame, status: str) -> DataFrame:
    return jobs.withColumns({"status": F.lit(status), "locked_by": F.lit(None).cast("string"), "locked_at": F.lit(None).cast("timestamp")})


def stage_marks(stages: Column) -> Column:
    """A mark for every stage that is done, a dot for others."""
    return F.concat(*(F.when(F.array_contains(stages, name), mark).otherwise(".") for name, mark in STAGES))


def completed_prefix(stages: Column) -> Column:
    """Stages done before the first gap."""
    names = [n for n, _ in STAGES]
    flags = F.array(*(F.array_contains(stages, n) for n in names))
    gap = F.array_position(flags, F.lit(False))
    return F.slice(F.array(*map(F.lit, names)), F.lit(1), F.when(gap == 0, len(names)).otherwise(gap - 1).cast("int"))


def reconcile(assets: DataFrame) -> DataFrame:
    """Per document the stages that a rerun may skip, and its workflow status."""
    rows = assets.groupBy("document_id").agg(completed_prefix(F.collect_set("asset_type")).alias("completed_stages"))
    n = F.size("completed_stages")
    return rows.withColumn("status", F.when(n == len(STAGES), "completed").when(n > 0, "running").otherwise("pending"))


def latest_jobs(jobs: DataFrame) -> DataFrame:
    """The newest job of each document, by an aggregate."""
    row = F.struct("status", "attempts", "priority", "available_at", "created_at", "last_error")
    return jobs.groupBy("document_id").agg(F.max_by(row, F.struct("created_at", "job_id")).alias("job"))


def status_board(documents: DataFrame, assets: DataFrame, jobs: DataFrame, now: Column, newest: int | None = 500) -> DataFrame:
    """The newest documents, or all if None, with stages done, derived status, place in the queue and seconds until due."""
    rows = board_rows(documents, assets, jobs, now, newest)
    waiting = [F.desc("__priority"), F.asc_nulls_last("__available"), "__created", "document_id"]
    rows = numbered(rows, "line_no", F.coalesce(~F.col("__queued"), F.lit(True)), *waiting).withColumn("line_no", F.when(F.col("__queued"), F.col("line_no")))
    place = F.array_position(F.array(*map(F.lit, BOARD)), F.col("board_status"))
    return numbered(rows.drop("__queued", "__priority", "__available", "__created"), "position", place, F.desc("recent"), "document_id")


def numbered(rows: DataFrame, name: str, *order: Column | str) -> DataFrame:
    """Rows with their number in an order from 1: places in sorted ranges, plus the sizes of the ranges before."""
    ranges = settle(rows.orderBy(*order).withColumn("__at", F.monotonically_increasing_id()))
    ranges = ranges.withColumn("__range", F.shiftright("__at", 33))
    sizes = ranges.groupBy("__range").agg(F.count("*").alias("__n"))
    before = F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select("__range", before.alias("__before"))
    number = F.col("__at") - F.shiftleft("__range", 33) + F.col("__before") + 1
    return ranges.join(F.broadcast(offsets), "__range").withColumn(name, number).drop("__at", "__range", "__before")


def board_rows(documents: DataFrame, assets: DataFrame, jobs: DataFrame, now: Column, newest: int | None = None) -> DataFrame:
    """The board without its numbers, which need an order, and with the columns that the queue is ordered by."""
    docs = documents.orderBy(F.desc("updated_at"), "document_id").limit(newest) if newest is not None else documents
    made = assets.groupBy("document_id").agg(F.collect_set("asset_type").alias("stages"), F.max("created_at").alias("last_asset"))
    rows = docs.join(made, "document_id", "left").join(latest_jobs(jobs), "document_id", "left")
    rows = rows.withColumn("stages", F.coalesce("stages", F.array().cast("array<string>")))
    done, job = F.size("stages"), F.col("job.status")
    status = (
        F.when(F.col("status") == "deleted", "deleted")
        .when(done == len(STAGES), "complete")
        .when(job == "dead_letter", "dead_letter")
        .when(job == "running", "running")
        .when((done > 0) & job.isNull(), "running")
        .when(done > 0, "waiting")
        .otherwise("queued")
    )
    queued = job == "queued"
    due = F.greatest(F.lit(0), F.floor((F.unix_micros(F.col("job.available_at")) - F.unix_micros(now)) / 1_000_000))
    return rows.select(
        "document_id", file_name(F.col("source_path")).alias("name"), status.alias("board_status"), done.alias("stages_done"), stage_marks(F.col("stages")).alias("marks"),
        job.alias("job_status"), F.coalesce("job.attempts", F.lit(0)).alias("job_attempts"),
        F.when(queued, due).alias("defer_seconds"), F.coalesce("last_asset", "updated_at").alias("recent"),
        queued.alias("__queued"), F.col("job.priority").alias("__priority"), F.col("job.available_at").alias("__available"), F.col("job.created_at").alias("__created"),
    )


def board_counts(board: DataFrame) -> DataFrame:
    return board.groupBy("board_status").agg(F.count("*").alias("n"))


def stage_progress(updates: DataFrame) -> DataFrame:
    """Latest progress per document and stage; complete when all is processed."""
    last = updates.groupBy("document_id", "stage").agg(F.max_by(F.struct("processed", "total"), F.struct("ts", "processed")).alias("p"))
    rows = last.select("document_id", "stage", "p.processed", "p.total")
    return rows.withColumn("status", F.when(F.col("processed") >= F.col("total"), "completed").otherwise("running"))


def breaker_states(calls: DataFrame, key: str, threshold: int = 5, reset_seconds: float = 30.0) -> DataFrame:
    """Calls (ts, ok) with the failures in a row up to each, whether the breaker opens there, and the state that each met.

    A breaker is open after ``threshold`` failures in a row; from
    ``reset_seconds`` after the last of them on it is half open.
    """
    ordered = W.partitionBy(key).orderBy("ts", "event_id")
    calls = calls.withColumn("__run", F.sum(F.when(F.col("ok"), 1).otherwise(0)).over(ordered))
    streak = F.sum(F.when(F.col("ok"), 0).otherwise(1)).over(W.partitionBy(key, "__run").orderBy("ts", "event_id"))
    calls = calls.withColumn("failures_in_row", streak).withColumn("opens", F.col("failures_in_row") == threshold)
    tripped = F.coalesce(F.lag("failures_in_row").over(ordered) >= threshold, F.lit(False))
    rested = F.unix_micros("ts") - F.unix_micros(F.lag("ts").over(ordered)) >= F.lit(round(reset_seconds * 1e6))
    return calls.withColumn("met", F.when(~tripped, "closed").when(rested, "half_open").otherwise("open")).drop("__run")
