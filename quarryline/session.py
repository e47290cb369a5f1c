"""Session defaults."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


#: Bytes of rows that travel to a Python worker at once.
BATCH_BYTES = 4 << 20
BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches of a session that sets no bound itself to ``BATCH_BYTES``.

    Spark's own bound of 64 MB leaves 10,000 rows together; such a batch of
    texts is held several times over, in the executor's buffers and in a worker.
    Applications call this, operators don't: it holds for the whole session.
    """
    spark.conf.set(BATCH_SETTING, spark.conf.get(BATCH_SETTING, str(BATCH_BYTES)))


def build_session(name: str = "quarryline", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, adaptive plans and Arrow transfer; ``conf`` overrides with ``_`` for ``.``."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        BATCH_SETTING: str(BATCH_BYTES),
    } | {k.replace("_", "."): v for k, v in conf.items()}
    builder = SparkSession.builder.appName(name).config(map=settings)
    return (builder.master(master) if master else builder).getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which all executors share.

    A temporary folder is set only where a session on one machine names none,
    as in tests; on a cluster every executor would write to its own disk, so
    there the setting must be given.
    """
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarryline-")
        context.setCheckpointDir(folder)
    return folder


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own below the shared one."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4()}"


def settle(df: DataFrame) -> DataFrame:
    """``df`` computed once, as a stage's table in the shared folder.

    It ends lineage, so a lost executor costs no earlier stage, and it ends the
    optimizer's view: filters on derived columns aren't pushed into copies of
    the expressions they came from.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """A table with fewer splits than there are cores, dealt to all of them; others stay as they are.

    Select columns first: what is dealt is shuffled.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
