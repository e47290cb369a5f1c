"""Typed event logs: JSON lines checked against the types and fields of their log, with what fails kept as rejects.

A raw event is (log, event_id, body, received).  Its body is parsed once, as a
variant, so that one bad field is one reject and no failed job.  The checks
are expressions, so the same function serves batches and streams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The event types of each log.
EVENT_TYPES = {
    "sync": "RepositorySynchronized RepositoryReconciled DocumentDiscovered DocumentModified DocumentRenamed DocumentMoved DocumentDeleted SynchronizationFailed",
    "orchestration": "WorkflowStarted StageStarted StageSkipped StageRetried StageCompleted StageFailed WorkflowCompleted WorkflowDeadLettered",
    "transformation": "TransformationStarted MarkdownGenerated TransformationValidated AssetStored TransformationSkipped TransformationFailed",
    "intelligence": "IntelligenceStarted ReportGenerated AssetStored IntelligenceSkipped IntelligenceFailed",
    "chunking": "ChunkingStarted ChunksGenerated ChunksValidated AssetStored ChunkingSkipped ChunkingFailed",
    "embedding": "EmbeddingStarted ModelSelected EmbeddingsGenerated EmbeddingsValidated EmbeddingTruncated AssetStored EmbeddingSkipped EmbeddingFailed",
    "publishing": "PublishStarted CollectionReady VectorsPublished VectorsVerified AssetStored PublishSkipped PublishFailed",
    "conversation": "conversation_created interaction_started context_ready agent_invoked agent_completed tool_started tool_completed response_generated memory_updated clarification_requested conversation_completed conversation_archived conversation_paused conversation_resumed",
    "platform": "workflow_triggered workflow_planned workflow_paused workflow_resumed workflow_completed workflow_replanned workflow_milestone_reached approval_requested approval_received knowledge_retrieved knowledge_retrieval_failed context_degraded",
}
#: What an event of a log is about, besides its tenant.
SUBJECTS = {
    "sync": "repository_id", "orchestration": "document_id", "transformation": "document_id", "intelligence": "document_id", "chunking": "document_id", "embedding": "document_id",
    "publishing": "document_id", "conversation": "conversation_id", "platform": None,
}
#: Logs whose events must name the request that caused them.
CORRELATED = {"orchestration"}


def _field(name: str, kind: str) -> Column:
    return F.try_variant_get("__body", f"$.{name}", kind)


def checked(raw: DataFrame) -> DataFrame:
    """``raw`` with event_id, event_type, tenant_id, subject, at, version, detail, and ``reason``, null for good events.

    Reasons, the first that holds: bad_json, unknown_log, missing_type,
    unknown_type, missing_tenant, missing_subject, missing_correlation,
    bad_timestamp, bad_version.  An event without an id is named by its log
    and body.  The body stays, so that rejects can be read again.
    """
    rows = raw.withColumn("__body", F.try_parse_json("body"))
    stamp, version = _field("timestamp", "string"), _field("version", "string")
    subject = F.coalesce(*(F.when(F.col("log") == log, _field(name, "string")) for log, name in SUBJECTS.items() if name))
    rows = rows.select(
        "log", F.coalesce("event_id", F.sha2(F.concat_ws("\n", "log", "body"), 256)).alias("event_id"), "body", "received", _field("event_type", "string").alias("event_type"),
        _field("tenant_id", "string").alias("tenant_id"), subject.alias("subject"), stamp.try_cast("timestamp").alias("at"), version.try_cast("int").alias("version"),
        F.coalesce(_field("detail", "string"), F.to_json(_field("detail", "variant"))).alias("detail"), F.col("__body").isNull().alias("__bad"), (stamp.isNotNull() & stamp.try_cast("timestamp").isNull()).alias("__stamp"),
        (version.isNotNull() & version.try_cast("int").isNull()).alias("__version"), _field("correlation_id", "string").isNull().alias("__alone"),
    )
    is_known = F.exists(F.array(*(F.lit(log) for log in EVENT_TYPES)), lambda x: x == F.col("log"))
    needs = F.exists(F.array(*(F.lit(log) for log, name in SUBJECTS.items() if name)), lambda x: x == F.col("log"))
    typed = F.exists(F.array(*(F.lit(f"{log} {t}") for log, names in EVENT_TYPES.items() for t in names.split())), lambda x: x == F.concat_ws(" ", "log", "event_type"))
    reason = (
        F.when(F.col("__bad"), "bad_json").when(~F.coalesce(is_known, F.lit(False)), "unknown_log").when(F.col("event_type").isNull(), "missing_type").when(~typed, "unknown_type")
        .when(F.coalesce("tenant_id", F.lit("")) == "", "missing_tenant").when(needs & (F.coalesce("subject", F.lit("")) == ""), "missing_subject")
        .when(F.col("log").isin(*CORRELATED) & F.col("__alone"), "missing_correlation").when(F.col("__stamp"), "bad_timestamp").when(F.col("__version"), "bad_version")
    )
    return rows.withColumn("reason", reason).select("log", "event_id", "event_type", "tenant_id", "subject", "at", "version", "detail", "received", "body", "reason")


def once(events: DataFrame) -> DataFrame:
    """One row of each event id of a log: the one received first.  (``streaming.stateful.distinct_arrivals`` is the same within a watermark.)"""
    rest = [c for c in events.columns if c not in ("log", "event_id")]
    first = events.groupBy("log", "event_id").agg(F.min_by(F.struct(*rest), F.struct("received", "body")).alias("e"))
    return first.select("log", "event_id", "e.*").select(*events.columns)
