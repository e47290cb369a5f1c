"""How many requests of a tenant ran at once: a sweep over begins and ends.

Begins count +1 and ends -1.  A tenant's time is cut into stretches: each is
summed on its own, starting from the sum of the stretches before it, so a
tenant with a third of all requests is spread over many tasks; only one row
for each stretch with an event meets its tenant's others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarryline.session import settle

STRETCH_SECONDS = 3600


def changes(requests: DataFrame, tenant: str = "tenant_id") -> DataFrame:
    """(tenant, at, delta): net change of what runs at each moment, in microseconds.

    A request runs from ``begun`` until before ``ended``; one without an end
    goes on.  Requests without a tenant or begin, or that end before they
    begin, are left out, and those of no length change nothing.
    """
    held = requests.where(F.col(tenant).isNotNull() & F.col("begun").isNotNull() & (F.col("ended").isNull() | (F.col("ended") >= F.col("begun"))))
    begins = held.select(F.col(tenant).alias("tenant"), F.unix_micros(F.col("begun").cast("timestamp")).alias("at"), F.lit(1).alias("delta"))
    ends = held.where("ended IS NOT NULL").select(F.col(tenant).alias("tenant"), F.unix_micros(F.col("ended").cast("timestamp")).alias("at"), F.lit(-1).alias("delta"))
    return begins.unionByName(ends).groupBy("tenant", "at").agg(F.sum("delta").alias("delta")).where("delta <> 0")


def running(requests: DataFrame, tenant: str = "tenant_id", stretch_seconds: int = STRETCH_SECONDS) -> DataFrame:
    """(tenant, at, until, active): what runs from each change until the next one of its tenant; the last has no ``until``."""
    moments = settle(changes(requests, tenant).withColumn("stretch", F.floor(F.col("at") / (stretch_seconds * 1_000_000)).cast("long")))
    own = W.partitionBy("tenant").orderBy("stretch")
    stretches = moments.groupBy("tenant", "stretch").agg(F.sum("delta").alias("net"), F.min("at").alias("first"))
    before = F.coalesce(F.sum("net").over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = stretches.select("tenant", "stretch", before.alias("before"), F.lead("first").over(own).alias("next_first"))
    within = W.partitionBy("tenant", "stretch").orderBy("at")
    rows = moments.join(offsets, ["tenant", "stretch"])
    active = F.col("before") + F.sum("delta").over(within)
    until = F.coalesce(F.lead("at").over(within), F.col("next_first"))
    return rows.select("tenant", "at", until.alias("until"), active.cast("long").alias("active"))


def pressure(requests: DataFrame, limit: int, tenant: str = "tenant_id", stretch_seconds: int = STRETCH_SECONDS) -> DataFrame:
    """(tenant, peak, peak_at, over_micros, over_spells): the most that ran at once and when first, and the time above ``limit`` (0: no limit)."""
    rows = running(requests, tenant, stretch_seconds)
    over = (F.col("active") > limit) & F.lit(limit > 0)
    length = F.when(over, F.coalesce(F.col("until") - F.col("at"), F.lit(0)))
    return rows.groupBy("tenant").agg(
        F.max("active").alias("peak"), (-F.max_by(-F.col("at"), F.struct("active", -F.col("at")))).alias("peak_at"),
        F.coalesce(F.sum(length), F.lit(0)).alias("over_micros"), F.count_if(over).alias("over_spells"),
    )
