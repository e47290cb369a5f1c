"""Connected components of a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarryline.llm.common import cut_lineage


#: Links that one task reads.
TASK_LINKS = 100_000


def gathered(links: DataFrame, n: int) -> DataFrame:
    """``n`` links in no more partitions than they need, as each leaves files behind in every shuffle."""
    return links.coalesce(n // TASK_LINKS + 1)


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every linked node, by large-star and small-star passes.

    Each pass is two joins on a table of links that never grows beyond one link
    for each node and its neighbours; it ends when the links no longer change.
    """
    edges, before = cut_lineage(links.where("a <> b")), None
    n = edges.count()
    while True:
        edges = gathered(edges, n)
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        lowest = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(lowest, "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = cut_lineage(gathered(small.unionByName(lowest.select("a", F.col("m").alias("b"))).distinct(), n))
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before or now[0] == 0:
            break
        before, n = now, now[0]
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
