"""Small helpers shared by the operators of this subpackage."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A word is a maximal run of characters that are not ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
GAP = r"[\x20\x09-\x0D]+"

LONG, DOUBLE, STRING = T.LongType(), T.DoubleType(), T.StringType()


def record(**kinds: T.DataType) -> T.StructType:
    """A struct type of these fields.

    Workers import the modules where no session is active, so the result types
    of module-level Arrow functions are objects and not strings to be parsed.
    """
    return T.StructType([T.StructField(name, kind) for name, kind in kinds.items()])


def nullable(kind: T.DataType) -> T.DataType:
    """``kind`` with nulls allowed everywhere, as Arrow functions return it."""
    if isinstance(kind, T.StructType):
        return T.StructType([T.StructField(f.name, nullable(f.dataType), True, f.metadata) for f in kind.fields])
    if isinstance(kind, T.ArrayType):
        return T.ArrayType(nullable(kind.elementType), True)
    if isinstance(kind, T.MapType):
        return T.MapType(nullable(kind.keyType), nullable(kind.valueType), True)
    return kind


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def cut_lineage(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the folder that the cluster shares.

    The folder is the session's ``spark.checkpoint.dir``.  Only a session on
    one machine, as in tests, gets a temporary one where it names none: on a
    cluster every executor would write to its own disk.
    """
    spark = df.sparkSession
    context = spark.sparkContext
    if not spark.conf.get("spark.checkpoint.dir", None) and context.getCheckpointDir() is None:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        context.setCheckpointDir(tempfile.mkdtemp(prefix="quarryline-"))
    return df.checkpoint()


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, or a temporary one where a session on one machine names none."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not folder:
        if not re.match(r"local($|\[)", context.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="quarryline-")
        context.setCheckpointDir(folder)
    return folder


def written(df: DataFrame, name: str, codec: str = "snappy") -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read again: columnar and compressed, where a checkpoint holds rows."""
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4()}"
    df.write.option("compression", codec).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def column(name: str) -> Column:
    """A column by its whole name, which may hold dots and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")


def row_of(df: DataFrame, but: Iterable[str] = ()) -> Column:
    """All columns of ``df`` in one struct, so that no name of theirs meets a name used on the way."""
    return F.struct(*(column(c).alias(c) for c in df.columns if c not in but))


def unpacked(df: DataFrame, row: str, names: Iterable[str]) -> list[Column]:
    """The fields of a struct column under their own names."""
    return [F.col(row).getField(c).alias(c) for c in names]


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    return isinstance(kind, T.MapType) or (isinstance(kind, T.ArrayType) and has_map(kind.elementType))


def hashable(value: Column, kind: T.DataType) -> Column:
    """A value that Spark can hash: maps become their sorted entries, at any depth."""
    if not has_map(kind):
        return value
    if isinstance(kind, T.MapType):
        entries = F.transform(F.map_entries(value), lambda e: F.struct(hashable(e["key"], kind.keyType).alias("k"), hashable(e["value"], kind.valueType).alias("v")))
        return F.array_sort(entries)
    if isinstance(kind, T.ArrayType):
        return F.transform(value, lambda x: hashable(x, kind.elementType))
    return F.when(value.isNotNull(), F.struct(*(hashable(value.getField(f.name), f.dataType).alias(f"f{i}") for i, f in enumerate(kind.fields))))


def hashable_columns(df: DataFrame) -> list[Column]:
    return [hashable(column(f.name), f.dataType) for f in df.schema.fields]


def byte_size(field: T.StructField) -> Column:
    """About the bytes of a value, as a broadcast holds it."""
    c = column(field.name)
    if isinstance(field.dataType, T.StringType | T.BinaryType):
        return F.coalesce(F.octet_length(c), F.lit(0)) + 16
    if isinstance(field.dataType, T.ArrayType):
        return F.greatest(F.size(c), F.lit(0)) * 8 + 24
    return F.lit(16)


def small_enough(df: DataFrame, most_rows: int, most_bytes: int = 32 << 20) -> bool:
    """Whether ``df`` has at most so many rows and bytes, reading no more rows than that."""
    size = sum((byte_size(f) for f in df.schema.fields), F.lit(0)).cast("long")
    seen = df.limit(most_rows + 1).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("b")).first()
    return seen["n"] <= most_rows and seen["b"] <= most_bytes


def attach(big: DataFrame, small: DataFrame, on: list[str], most_rows: int = 100_000) -> DataFrame:
    """Left join of ``small``, one row per key, to ``big``; keys may be null.

    Up to ``most_rows`` rows and 32 MB are broadcast; beyond that both sides
    are shuffled and a hot key of ``big`` is split by the adaptive skew join,
    as it occurs once in ``small``.
    """
    side = F.broadcast(small) if small_enough(small, most_rows) else small
    renamed = side.select(*(F.col(c).alias(f"__{c}") if c in on else F.col(c) for c in side.columns))
    match = None
    for c in on:
        equal = big[c].eqNullSafe(renamed[f"__{c}"])
        match = equal if match is None else match & equal
    return big.join(renamed, match, "left").drop(*(f"__{c}" for c in on))


def hash_share(cols: Iterable[Column | str], salt: int, share: Column | float) -> Column:
    """True for a pseudo-random ``share`` of the keys, the same in every run."""
    h = F.xxhash64(F.lit(salt), *cols)
    return F.pmod(h, F.lit(1 << 30)) < F.lit(float(1 << 30)) * share
