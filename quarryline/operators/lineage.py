"""Closures over lineage: every asset's ancestors, broken and cyclic lineage, and clearances carried down to derived assets.

Edges say (asset_id, parent_asset_id).  Closures are found by doubling: from
all ways of up to n steps those of up to 2n, so a chain of a thousand takes
ten rounds, each a join on equal keys and a table of the pairs that are new.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.operators.evaluation import finding
from quarryline.operators.search import CLEARANCES, MOST_BROADCAST_KEYS, clearance_rank, few
from quarryline.session import new_folder


def closure(edges: DataFrame) -> DataFrame:
    """(asset_id, ancestor_id, steps): each ancestor once, by the fewest steps; an asset in a cycle is its own ancestor.

    Edges with a null end are left out; repeated edges count once.  A shortest
    way of more than n and up to 2n steps goes through the asset that it
    reaches after n, so only pairs that are just n steps apart meet the others,
    and not every asset in between.  Hot parents are rows of many assets, but
    Spark splits a middle that is hot on one side.
    """
    ends = edges.where("asset_id IS NOT NULL AND parent_asset_id IS NOT NULL")
    first = ends.select("asset_id", F.col("parent_asset_id").alias("ancestor_id")).distinct().withColumn("steps", F.lit(1).cast("long"))
    ways = kept(first)
    n, last = 1, ways
    while not last.where(F.col("steps") == n).isEmpty():
        onward = ways.select(F.col("asset_id").alias("ancestor_id"), F.col("ancestor_id").alias("next"), F.col("steps").alias("more"))
        longer = last.where(F.col("steps") == n).join(onward, "ancestor_id").select("asset_id", F.col("next").alias("ancestor_id"), (F.col("steps") + F.col("more")).alias("steps"))
        shortest = longer.groupBy("asset_id", "ancestor_id").agg(F.min("steps").alias("steps"))
        last = kept(shortest.join(ways.select("asset_id", "ancestor_id"), ["asset_id", "ancestor_id"], "left_anti"))
        ways, n = ways.unionByName(last), 2 * n
    return ways


def kept(df: DataFrame) -> DataFrame:
    """``df`` as a table of columns in the shared folder: pairs are many, and packed they take a small part of a settled table's room."""
    path = new_folder(df.sparkSession, "ways")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def findings(assets: DataFrame, edges: DataFrame, ways: DataFrame | None = None) -> DataFrame:
    """Broken lineage: (check, severity, subject).

    ``missing_parent``: an asset with an ancestor that is no asset, however
    far up.  ``cyclic_lineage``: an asset that is its own ancestor.
    ``below_cycle``: an asset outside of a cycle with ancestors in one
    (warning).  ``unrooted``: a derived asset without an ancestor of a root type.
    """
    ways = closure(edges) if ways is None else ways
    # Every ancestor is the parent of an edge, so few assets are looked for among all pairs.
    among = lambda some: ways.join(few(some.select(F.col("asset_id").alias("ancestor_id")).distinct(), MOST_BROADCAST_KEYS), "ancestor_id", "left_semi").select("asset_id").distinct()
    parents = edges.where("asset_id IS NOT NULL AND parent_asset_id IS NOT NULL").select(F.col("parent_asset_id").alias("asset_id")).distinct()
    lost = among(kept(parents.join(assets.where("asset_type IS NOT NULL"), "asset_id", "left_anti")))
    cyclic = kept(ways.where("asset_id = ancestor_id").select("asset_id"))
    below = among(cyclic).join(cyclic, "asset_id", "left_anti")
    rooted = among(assets.where("asset_type = 'source'"))
    unrooted = assets.where("asset_type <> 'source'").join(rooted, "asset_id", "left_anti")
    out = finding(lost, "missing_parent", "asset_id").unionByName(finding(cyclic, "cyclic_lineage", "asset_id"))
    return out.unionByName(finding(below, "below_cycle", "asset_id", "warning")).unionByName(finding(unrooted, "unrooted", "asset_id"))


def least_clearances(assets: DataFrame, ways: DataFrame) -> DataFrame:
    """``assets`` (asset_id, classification_clearance) with ``least_clearance``: the most restrictive of their own and all ancestors'.

    An unknown level counts as the most restrictive one, as nothing may be
    read by mistake; so does an ancestor that is no asset.
    """
    most = len(CLEARANCES) - 1
    level = assets.select("asset_id", F.coalesce(clearance_rank(F.col("classification_clearance")), F.lit(most)).alias("level"))
    above = ways.join(level.withColumnRenamed("asset_id", "ancestor_id"), "ancestor_id", "left")
    highest = above.groupBy("asset_id").agg(F.max(F.coalesce("level", F.lit(most))).alias("above"))
    rows = assets.join(level, "asset_id").join(highest, "asset_id", "left")
    least = F.greatest("level", F.coalesce("above", F.lit(0)))
    return rows.withColumn("least_clearance", F.get(F.array(*map(F.lit, CLEARANCES)), least.cast("int"))).drop("level", "above")


def downgrades(assets: DataFrame, ways: DataFrame) -> DataFrame:
    """Assets that may be read more widely than something that they come from: (check, severity, subject)."""
    rows = least_clearances(assets, ways)
    own = F.coalesce(clearance_rank(F.col("classification_clearance")), F.lit(len(CLEARANCES) - 1))
    return finding(rows.where(own < clearance_rank(F.col("least_clearance"))), "clearance_downgrade", "asset_id")
