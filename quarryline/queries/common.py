"""Tables of the queries and the same in SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarryline.session import spread

Query = Callable[[SparkSession, str], DataFrame]


class Registry:
    """Queries by name with their SQL where there is one."""

    def __init__(self) -> None:
        self.queries: dict[str, Query] = {}
        self.oracles: dict[str, str] = {}

    def add(self, sql: str | None = None) -> Callable[[Query], Query]:
        def keep(f: Query) -> Query:
            self.queries[f.__name__] = lambda spark, sf_dir: plain(f(spark, sf_dir))
            if sql:
                self.oracles[f.__name__] = sql
            return f

        return keep


def plain(df: DataFrame) -> DataFrame:
    """Integers as longs, so that types don't hang on how a count was made."""
    wide = {f.name: F.col(f"`{f.name}`").cast("long") for f in df.schema.fields if isinstance(f.dataType, (T.ByteType, T.ShortType, T.IntegerType))}
    return df.withColumns(wide) if wide else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table; texts, over which expressions are costly, are dealt to all cores where a file has few splits."""
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows) if name == "documents" else rows


def lit_ts(text: str):
    return F.lit(text).cast("timestamp")


LEVELS = ["public", "internal", "confidential", "restricted"]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the governance columns that are derived from their id."""
    docs = table(spark, sf_dir, "documents")
    source = F.coalesce("source", F.lit("none"))
    return docs.select(
        "doc_id", F.col("doc_id").cast("string").alias("document_id"), F.lit("CHK-000001").alias("chunk_id"), F.col("text").alias("content"),
        F.concat(source, F.lit("/"), F.col("doc_id").cast("string"), F.lit(".md")).alias("source_path"), source.alias("source"),
        F.concat(F.lit("tenant-"), (F.col("doc_id") % 3).cast("string")).alias("tenant_id"),
        F.get(F.array(*map(F.lit, LEVELS)), (F.col("doc_id") % 4).cast("int")).alias("classification_clearance"),
        F.col("lang").alias("language"), F.create_map(F.lit("source_group"), source).alias("metadata"), F.lit(None).cast("string").alias("section_title"),
    )


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their embedding, where they have one."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), F.col("embedding").alias("vector"))
    return documents(spark, sf_dir).join(vectors, "doc_id", "left")


DIMENSION = 64

DOCS_SQL = """
docs AS (
  SELECT doc_id, CAST(doc_id AS VARCHAR) AS document_id, 'CHK-000001' AS chunk_id, text AS content,
         coalesce(source, 'none') || '/' || doc_id || '.md' AS source_path, coalesce(source, 'none') AS source,
         'tenant-' || (doc_id % 3) AS tenant_id, (doc_id % 4) AS level, lang AS language
  FROM documents
)"""
CORPUS_SQL = DOCS_SQL + """,
corpus AS (SELECT docs.*, embedding::DOUBLE[] AS vector FROM docs LEFT JOIN embeddings ON doc_id = vec_id)"""

#: Words as Spark's ``functions.text.words`` sees them.
SQL_WORD = r"[^\t-\r \x{85}\p{Z}]+"


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    return rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("content"))
