"""Ingestion from documents to published vectors, with failures on the side."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.functions.text import is_blank, normalize_text, sha256
from quarryline.operators import chunking, markdown, profile, publishing
from quarryline.operators.changes import source_group
from quarryline.session import settle


@dataclass(frozen=True)
class IngestPolicy:
    chunks: chunking.ChunkPolicy = chunking.ChunkPolicy(oversize="split")
    dimension: int = 64
    model: str = "local-hash"
    collection: str = "documents"
    version: int = 1


@dataclass
class Ingested:
    """Tables of a run; ``dead_letters`` has document_id, stage and errors."""

    profiles: DataFrame
    chunks: DataFrame
    points: DataFrame
    dead_letters: DataFrame


def transform(docs: DataFrame) -> DataFrame:
    """Normalised Markdown with front matter for documents (document_id, repository_id, source_path, text)."""
    body = docs.withColumn("body", normalize_text(F.coalesce("text", F.lit(""))))
    values = {
        "document_id": F.col("document_id"), "repository_id": F.col("repository_id"), "version": F.lit(1), "source_type": F.lit("txt"),
        "source_hash": F.concat(F.lit("sha256:"), sha256(F.coalesce("text", F.lit("")))), "language": F.coalesce("language", F.lit("en")),
    }
    errors = markdown.document_errors(values, F.col("body"))
    return body.withColumn("errors", errors).withColumn("markdown", markdown.render_document(markdown.render_front_matter(values), F.col("body")))


def ingest(docs: DataFrame, policy: IngestPolicy = IngestPolicy()) -> Ingested:
    """Transform, profile, chunk, embed and publish; a document that fails a stage doesn't reach the next.

    Every stage's table is settled, as the next one and the dead letters read it.
    """
    made = settle(transform(docs))
    dead = made.where(F.size("errors") > 0).select("document_id", F.lit("transform").alias("stage"), "errors")
    good = made.where(F.size("errors") == 0).drop("language")
    profiles = settle(profile.profiled(settle(markdown.with_structure(good, "markdown"))).drop("body", "errors"))
    drafts = settle(chunking.draft_rows(profiles.select("document_id", "blocks", "sections"), policy.chunks))
    valid, failed = chunking.split_failures(drafts)
    dead = dead.unionByName(failed.select("document_id", F.lit("chunk").alias("stage"), "errors"))
    chunks = chunking.chunks(valid)
    records = settle(publishing.embed(chunks, policy.dimension, policy.model))
    dead = dead.unionByName(records.where(F.size("vector_errors") > 0).select("document_id", F.lit("embed").alias("stage"), F.col("vector_errors").alias("errors")))
    about = docs.select("document_id", "tenant_id", "classification_clearance", "source_path", source_group(F.col("source_path")).alias("source_group"))
    points = publishing.build_points(records.where(F.size("vector_errors") == 0), chunks, about, F.lit(policy.collection), policy.version)
    points = points.withColumn("missing", publishing.missing_fields())
    dead = dead.unionByName(points.where(F.size("missing") > 0).select("document_id", F.lit("publish").alias("stage"), F.col("missing").alias("errors")))
    return Ingested(profiles, chunks, points.where(F.size("missing") == 0).drop("missing"), dead)


def searchable(points: DataFrame) -> DataFrame:
    """Published points as a corpus for ``plans.retrieval``."""
    return points.where(~is_blank(F.col("content"))).select(
        "document_id", "chunk_id", "content", "source_path", "section_title", "tenant_id", "classification_clearance", "vector",
        F.create_map(F.lit("source_group"), F.col("source_group")).alias("metadata"),
    )
