"""A purge of subjects from many tables, with proof; and documents whose payload was lost, made ready to run again.

What goes is named once, as sets of keys; a table says by which of its
columns it refers to which set.  Removing is an exact anti join.  Where keys
are too many to broadcast, a broadcast bitmap of their hashes, of fixed size,
first passes by all rows whose hash no key has, so that only the few others
are shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarryline.operators import changes, jobs
from quarryline.operators.search import few
from quarryline.session import settle

#: Places of the bitmap, at most so many numbers in a broadcast.
PLACES = 1 << 20
#: Keys up to this number are broadcast themselves.
MOST_KEYS = 100_000


@dataclass
class Table:
    """Rows and their references: the name of a key set and the columns that hold its keys, in the set's order."""

    rows: DataFrame
    refers: list[tuple[str, list[str]]] = field(default_factory=list)


def place(columns: list[str]) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(PLACES))


def named(keys: DataFrame, columns: list[str]) -> DataFrame:
    """Distinct whole keys under a table's own column names; a key with a null names nothing."""
    return keys.dropna().toDF(*columns).distinct()


def without(rows: DataFrame, keys: DataFrame, columns: list[str], most: int = MOST_KEYS) -> DataFrame:
    """Rows that no key names."""
    doomed = named(keys, columns)
    if doomed.limit(most + 1).count() <= most:
        return rows.join(few(doomed, most), columns, "left_anti").select(*rows.columns)
    places = F.broadcast(doomed.select(place(columns).alias("__place")).distinct())
    placed = rows.withColumn("__place", place(columns))
    maybe = placed.join(places, "__place", "left_semi").join(doomed, columns, "left_anti")
    return placed.join(places, "__place", "left_anti").unionByName(maybe).select(*rows.columns)


def purge(tables: dict[str, Table], keys: dict[str, DataFrame], most: int = MOST_KEYS) -> tuple[dict[str, DataFrame], DataFrame]:
    """The tables without what the key sets name, settled, and the proof: a row for each table.

    ``before``, ``after`` and ``removed`` are counted apart, ``left`` counts
    rows that a key still names by a join of its own; proved says that they
    agree and nothing is left.
    """
    out, proof = {}, []
    for name, table in tables.items():
        rows = table.rows
        for key, columns in table.refers:
            rows = without(rows, keys[key], columns, most)
        out[name] = settle(rows)
        hit = reduce(lambda a, b: a | b, (F.col(f"__hit{i}").isNotNull() for i in range(len(table.refers))), F.lit(False))

        def marked(df: DataFrame, refers=table.refers) -> DataFrame:
            for i, (key, columns) in enumerate(refers):
                df = df.join(named(keys[key], columns).withColumn(f"__hit{i}", F.lit(True)), columns, "left")
            return df

        before = marked(table.rows).agg(F.count("*").alias("before"), F.count_if(hit).alias("removed"))
        after = marked(out[name]).agg(F.count("*").alias("after"), F.count_if(hit).alias("left"))
        proof.append(before.crossJoin(after).select(F.lit(name).alias("table_name"), "before", "removed", "after", "left"))  # one row each
    whole = reduce(DataFrame.unionByName, proof)
    return out, whole.withColumn("proved", (F.col("left") == 0) & (F.col("before") - F.col("removed") == F.col("after")))


def recover(tables: dict[str, DataFrame], tenant_id: str, now: Column) -> dict[str, DataFrame]:
    """Tables after documents whose payload was lost are cleared and queued again.

    They are a tenant's dead ingestion jobs with a sign of a lost payload,
    whose document still has a staged source.  Their assets go, lineage by
    either end, states and workflows; sources stay, and the jobs start anew.
    Documents without a source stay as they are.
    """
    found = settle(jobs.lost_payloads(tables["jobs"], tables["sources"], tenant_id).where("recoverable").select("job_id", "document_id"))
    cleared = changes.cascade_delete({k: tables[k] for k in ("assets", "lineage", "states", "workflows")}, found)
    again = found.select("job_id").distinct().withColumn("__again", F.lit(True))
    marked = tables["jobs"].join(few(again), "job_id", "left")
    fresh = {"status": F.lit("queued"), "attempts": F.lit(0), "available_at": now, "locked_by": F.lit(None), "locked_at": F.lit(None), "last_error": F.lit(None)}
    columns = [F.when(F.col("__again"), fresh[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name) if f.name in fresh else F.col(f.name) for f in tables["jobs"].schema.fields]
    return tables | cleared | {"jobs": marked.select(*columns)}
