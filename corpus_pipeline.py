"""A training corpus from ``documents``: classifier, rules, near-dedup, mixing, packing.

Each stage takes (spark, docs, sf_dir) and works on every row its predecessor
kept.  All but the last return the columns of ``documents``, further columns
of whatever names and types included: they travel in one struct, and a stage's
own columns stand beside it.  Every stage takes null ids, texts, languages and
sources, repeated rows and empty tables, as its operator's module says.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarryline.llm import mixing, quality_llr, simhash
from quarryline.llm.common import cut_lineage, row_of, table, unpacked
from quarryline.llm.queries import packed, quality_verdicts
from quarryline.session import bound_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def with_rows(docs: DataFrame, *names: str) -> DataFrame:
    """The whole row in one struct, and these columns of it beside it."""
    return docs.select(row_of(docs).alias("row"), *names)


def kept_rows(judged: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs`` of the rows that a verdict keeps."""
    return judged.where("kept").select(*unpacked(judged, "row", docs.columns))


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the classifier keeps."""
    rows = with_rows(docs, "doc_id", "text", "source", "lang")
    return kept_rows(quality_verdicts(rows, table(spark, sf_dir, "labels"), ["row"]), docs)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that pass the rules and the likelihood ratio."""
    ratios = quality_llr.log_ratios(docs, table(spark, sf_dir, "labels"))
    return kept_rows(quality_llr.judge(with_rows(docs, "text"), ratios), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group."""
    return simhash.keep_one(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows repeated, dropped or cut so that every source comes to its target of words."""
    return mixing.mixed_documents(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their place in sequences."""
    return packed(docs)


def bounded(stage: Stage) -> Stage:
    """The stage in a session whose Arrow batches are bounded."""

    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        bound_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


STAGES = [
    ("quality classifier", bounded(quality_classifier)),
    ("quality rules", bounded(quality_rules)),
    ("near-dedup", bounded(near_dedup)),
    ("mixing", bounded(mix_sources)),
    ("packing", bounded(pack)),
]

#: Fingerprints, hashed n-grams and tokens have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def stored(df: DataFrame) -> tuple[DataFrame, str | None]:
    """``df`` as Parquet in the folder that the cluster shares, read again, and its path; a checkpoint where no folder is set."""
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        return cut_lineage(df), None
    path = f"{folder}/corpus-pipeline-{uuid.uuid4()}"
    df.write.parquet(path)
    return spark.read.parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Delete a stage's table that nothing reads any more, in whatever store it is."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; its table stays in the shared folder, those of the other stages are deleted."""
    docs, before = table(spark, sf_dir, "documents"), None
    for _, stage in STAGES:
        docs, path = stored(stage(spark, docs, sf_dir))
        if before:
            removed(spark, before)
        before = path
    return docs
