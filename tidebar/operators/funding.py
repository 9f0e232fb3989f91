"""Hybrid funding history: settlements, and between them estimates from closed premium samples that look at no later one."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SERIES

HOUR = 3_600_000


def hybrid_funding(settlements: DataFrame, premium: DataFrame, bars: DataFrame, interest_8h: float = 0.0001, clamp: float = 0.0005) -> DataFrame:
    """One point per closed bar: the settlement at its open if there is one, else the estimate from the mean of the premium
    since the last settlement, up to the bar's open, with the interest of the cycle's length. That length (1, 2, 4 or 8
    hours) is the distance of the two last settlements before, and 8 hours until there are two. A series stops at its first bar without either; that bar
    and all after it are excluded."""
    s = settlements.select(*SERIES, F.col("funding_time_ms").alias("at"), "funding_rate")
    w = Window.partitionBy(*SERIES).orderBy("at")
    length = (F.col("at") - F.lag("at").over(w)) / HOUR
    s = s.withColumn("cycle_hours", F.when(length <= 1.5, 1).when(length <= 3, 2).when(length <= 6, 4).when(length.isNotNull(), 8))
    both = s.select(*SERIES, "at", F.lit(0).alias("kind"), "funding_rate", "cycle_hours", F.lit(None).cast("double").alias("premium"))
    both = both.unionByName(premium.select(*SERIES, (F.col("close_time_ms") + 1).alias("at"), F.lit(1).alias("kind"), F.col("premium_close").alias("premium")), allowMissingColumns=True)
    both = both.unionByName(bars.where("is_closed").select(*SERIES, F.col("open_time").alias("at"), F.lit(2).alias("kind")), allowMissingColumns=True)
    order = Window.partitionBy(*SERIES).orderBy("at", "kind")
    both = both.withColumns({"cycle": F.sum(F.when(F.col("kind") == 0, 1).otherwise(0)).over(order), "hours": F.last("cycle_hours", True).over(order.rowsBetween(Window.unboundedPreceding, 0))})
    in_cycle = Window.partitionBy(*SERIES, "cycle").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0)
    mean = F.avg("premium").over(in_cycle)
    settled = F.max(F.when(F.col("kind") == 0, F.struct("at", "funding_rate"))).over(in_cycle)
    interest = F.lit(interest_8h) * F.coalesce("hours", F.lit(8)) / 8
    estimate = mean + F.greatest(F.lit(-clamp), F.least(F.lit(clamp), interest - mean))
    exact = F.col("settled.at") == F.col("at")
    rows = both.withColumns({"settled": settled, "estimate": estimate}).where("kind = 2")
    rows = rows.withColumn("rate", F.when(exact, F.col("settled.funding_rate")).otherwise(F.col("estimate"))).withColumn("provenance", F.when(exact, "exchange_settlement").when(F.col("rate").isNotNull(), "derived_history"))
    broken = F.max(F.when(F.col("rate").isNull(), 1).otherwise(0)).over(Window.partitionBy(*SERIES).orderBy("at").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("excluded", broken == 1).select(*SERIES, F.col("at").alias("open_time"), F.when(~F.col("excluded"), F.col("rate")).alias("funding_rate"), F.when(~F.col("excluded"), F.col("provenance")).alias("provenance"), "excluded")
