"""Embedding records and their publication as vector collections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.functions.text import is_blank, word_count, words
from quarryline.functions.vectors import hash_embedding, vector_errors

#: Metadata that a vector must have.
MANDATORY_TEXT = ["document_id", "chunk_id", "tenant_id", "classification_clearance", "distance_metric", "collection", "embedding_model"]
MANDATORY_NUMBER = ["embedding_version", "dimension"]
SERVABLE = ["approved", "active"]


def fit_to_context(chunks: DataFrame, max_tokens: int, strict: bool = False) -> DataFrame:
    """``chunks`` with the text to embed, cut to ``max_tokens`` words, and whether it was cut; ``strict`` fails instead."""
    parts = words(F.col("content"))
    long = F.size(parts) > max_tokens
    cut = F.array_join(F.slice(parts, 1, max_tokens), " ")
    short = F.raise_error(F.concat(F.lit("chunk exceeds the model's input: "), F.col("chunk_id"))) if strict else cut
    return chunks.withColumn("input", F.when(long, short).otherwise(F.col("content"))).withColumn("truncated", long)


def cost(tokens: Column, per_thousand: float) -> Column:
    return F.bround(tokens / 1000.0 * per_thousand, 6)


def embed(chunks: DataFrame, dimension: int = 64, model: str = "local-hash", per_thousand: float = 0.0, max_tokens: int = 8192, key: str = "document_id") -> DataFrame:
    """Embedding records in chunk order with their validation errors."""
    fitted = fit_to_context(chunks, max_tokens)
    n = F.row_number().over(W.partitionBy(key).orderBy("sequence"))
    tokens = word_count(F.col("input"))
    rows = fitted.withColumns({
        "embedding_id": F.concat(F.lit("EMB-"), F.lpad(n.cast("string"), 6, "0")), "vector": hash_embedding(F.col("input"), dimension),
        "embedding_model": F.lit(model), "dimension": F.lit(dimension), "embedded_tokens": tokens, "cost_estimate": cost(tokens, per_thousand),
    })
    return rows.withColumn("vector_errors", vector_errors(F.col("vector"), dimension))


def batch_number(order: Column, size: int, *within: str) -> Column:
    """Consecutive groups of ``size`` rows from 0, within a key."""
    return F.floor((F.row_number().over(W.partitionBy(*within).orderBy(order)) - 1) / size).cast("int")


def select_model(models: DataFrame, name: str) -> DataFrame:
    """The model of that name, if it may be used."""
    return models.where((F.col("name") == name) & F.col("status").isin(*SERVABLE))


def slug(name: Column) -> Column:
    bare = F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"[^a-zA-Z0-9]+", "_"), r"^_+|_+$", "")
    return F.when(bare == "", "model").otherwise(bare)


def collection_name(base: str, provider: Column | None = None, model: Column | None = None, dimension: Column | None = None) -> Column:
    """A fixed name, or one per model."""
    if model is None:
        return F.lit(base)
    return F.concat(F.concat_ws("__", F.lit(base), provider, slug(model)), F.lit("__d"), dimension.cast("string"))


def vector_id(collection: Column, document: Column, chunk: Column, version: Column) -> Column:
    return F.concat_ws("::", collection, document, chunk, F.concat(F.lit("e"), version.cast("string")))


def build_points(records: DataFrame, facts: DataFrame, documents: DataFrame, collection: Column, version: int = 1, metric: str = "cosine") -> DataFrame:
    """Points from embedding records; facts of a chunk that is missing are null or empty."""
    about = facts.select("document_id", "chunk_id", "section_title", "breadcrumb", "content")
    named = records.drop("content", "section_title", "breadcrumb").join(about, ["document_id", "chunk_id"], "left").join(documents, "document_id", "left")
    out = named.withColumns({
        "collection": collection, "embedding_version": F.lit(version), "distance_metric": F.lit(metric),
        "content": F.coalesce("content", F.lit("")), "section_title": F.coalesce("section_title", F.lit("")), "breadcrumb": F.coalesce("breadcrumb", F.lit("")),
    })
    return out.withColumn("vector_id", vector_id(F.col("collection"), F.col("document_id"), F.col("chunk_id"), F.col("embedding_version")))


def missing_fields() -> Column:
    """Names of mandatory metadata that a point lacks."""
    blank = [F.when(is_blank(F.col(c).cast("string")), c) for c in MANDATORY_TEXT]
    low = [F.when(F.coalesce(F.col(c), F.lit(0)) <= 0, c) for c in MANDATORY_NUMBER]
    return F.array_compact(F.array(*blank, *low))


def verify(expected: DataFrame, stored: DataFrame, collection: str, metadata: list[str]) -> DataFrame:
    """Every expected point with the first reason why the stored one isn't it; null if it is."""
    got = stored.select("vector_id", F.size("vector").alias("s_size"), F.col("collection").alias("s_collection"), F.struct(*metadata).alias("s_metadata"), F.lit(True).alias("s_here"))
    joined = expected.withColumn("e_metadata", F.struct(*metadata)).join(got, "vector_id", "left")
    reason = (
        F.when(F.col("s_here").isNull(), "missing_vector")
        .when(F.col("s_size") != F.size("vector"), "dimension_mismatch")
        .when(~F.col("s_collection").eqNullSafe(F.lit(collection)), "collection_mismatch")
        .when(~F.col("s_metadata").eqNullSafe(F.col("e_metadata")), "metadata_mismatch")
    )
    return joined.withColumn("reason", reason).drop("s_size", "s_collection", "s_metadata", "s_here", "e_metadata")


def manifest(verified: DataFrame) -> DataFrame:
    """What was published, from verified points."""
    state = F.when(F.col("reason").isNull(), "published").otherwise("failed")
    return verified.select("vector_id", "document_id", "chunk_id", "collection", "embedding_version", state.alias("state"), "reason")
