"""Order flow: minute rollups, id gaps, CVD, profiles and tape statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import scalars
from ..schemas import SERIES

MINUTE = 60_000


def id_gaps(trades: DataFrame, id_col: str = "agg_trade_id") -> DataFrame:
    """Missing id ranges of each series: first and last missing id, their number, and the times on either side."""
    order = Window.partitionBy(*SERIES).orderBy("id")
    rows = trades.select(*SERIES, F.col(id_col).alias("id"), "trade_time_ms").withColumns({"left_id": F.lag("id").over(order), "left_time_ms": F.lag("trade_time_ms").over(order)})
    rows = rows.where(F.col("id") > F.col("left_id") + 1)
    return rows.select(*SERIES, (F.col("left_id") + 1).alias("first_missing"), (F.col("id") - 1).alias("last_missing"), (F.col("id") - F.col("left_id") - 1).alias("missing"), "left_time_ms", F.col("trade_time_ms").alias("right_time_ms"))


def mark_incomplete(buckets: DataFrame, gaps: DataFrame, width_ms: int = MINUTE, start: str = "open_time") -> DataFrame:
    """Adds is_complete: false for buckets that a gap touches. Gaps become their buckets, so the join is on equal keys."""
    lo = iv.bucket_floor(F.col("left_time_ms"), iv.Interval(width_ms // 1000, "s"))
    hi = iv.bucket_floor(F.col("right_time_ms"), iv.Interval(width_ms // 1000, "s"))
    touched = gaps.select(*SERIES, F.explode(F.sequence(lo, hi, F.lit(width_ms))).alias(start)).distinct().withColumn("touched", F.lit(True))
    return buckets.join(touched, [*SERIES, start], "left").withColumn("is_complete", F.col("touched").isNull()).drop("touched")


def trade_flow_1m(trades: DataFrame, places: int = 12) -> DataFrame:
    """Per minute: buy and sell volume in base and quote, deltas, counts, largest notional, ids, and whether no id is
    missing. A series' first minute counts as incomplete, since its start was not seen."""
    rows = scalars.enrich_trades(trades.dropDuplicates([*SERIES, "agg_trade_id"]))
    side = lambda s, c: F.round(F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0)), places)
    flow = rows.groupBy(*SERIES, iv.bucket_floor(F.col("trade_time_ms"), "1m").alias("open_time")).agg(
        side("buy", "quantity").alias("buy_base"), side("sell", "quantity").alias("sell_base"), side("buy", "quote_quantity").alias("buy_quote"), side("sell", "quote_quantity").alias("sell_quote"),
        F.count("*").alias("agg_count"), F.sum("raw_count").alias("raw_count"), F.max("quote_quantity").alias("max_notional"), F.min("agg_trade_id").alias("first_id"), F.max("agg_trade_id").alias("last_id"),
    )
    flow = flow.withColumns({"delta_base": F.round(F.col("buy_base") - F.col("sell_base"), places), "delta_quote": F.round(F.col("buy_quote") - F.col("sell_quote"), places)})
    flow = mark_incomplete(flow, id_gaps(rows))
    first = F.min("open_time").over(Window.partitionBy(*SERIES))
    return flow.withColumn("is_complete", F.col("is_complete") & (F.col("open_time") > first))


def liquidation_1m(events: DataFrame) -> DataFrame:
    """Per minute and side: exact notional, quantity and count of liquidations, repeats removed. Silent minutes have no row."""
    rows = scalars.enrich_liquidations(events).dropDuplicates(["fingerprint"]).where("side is not null")
    quantity = F.coalesce(F.when(F.col("filled_quantity") > 0, F.col("filled_quantity")), F.col("original_quantity")).cast("decimal(28,8)")
    by = lambda s, c: F.coalesce(F.sum(F.when(F.col("side") == s, c)), F.lit(0).cast("decimal(38,8)"))
    return rows.groupBy(*SERIES, iv.bucket_floor(F.col("trade_time_ms"), "1m").alias("open_time")).agg(
        by("long", F.col("notional").cast("decimal(28,8)")).alias("long_notional"), by("short", F.col("notional").cast("decimal(28,8)")).alias("short_notional"),
        by("long", quantity).alias("long_quantity"), by("short", quantity).alias("short_quantity"),
        F.count_if(F.col("side") == "long").alias("long_count"), F.count_if(F.col("side") == "short").alias("short_count"), F.max("trade_time_ms").alias("last_time_ms"),
    )


def tape_stats(trades: DataFrame) -> DataFrame:
    rows = scalars.enrich_trades(trades)
    side = lambda s, c: F.round(F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0.0)), 8)
    continuous = F.max("agg_trade_id") - F.min("agg_trade_id") + 1 == F.count_distinct("agg_trade_id")
    return rows.groupBy(*SERIES).agg(
        side("buy", "quote_quantity").alias("buy_quote"), side("sell", "quote_quantity").alias("sell_quote"), side("buy", "quantity").alias("buy_base"), side("sell", "quantity").alias("sell_base"),
        F.count("*").alias("n"), F.max("quote_quantity").alias("max_notional"), continuous.alias("continuous"),
    )


def nice_steps() -> list[float]:
    """1, 2, 5 times powers of ten."""
    return [m * 10.0**e for e in range(-12, 13) for m in (1, 2, 5)]


def volume_profile(trades: DataFrame, max_rows: int) -> DataFrame:
    """Buy and sell volume by price step: the least nice step by which a series has at most max_rows rows.

    One pass counts the rows of the few steps that the price span allows, a second sums. The steps are sent to the trades: a
    join by SERIES would bring all trades of a series to one task."""
    span = trades.groupBy(*SERIES).agg((F.max("price") - F.min("price")).alias("span"), F.max("price").alias("top"))
    steps = F.array(*map(F.lit, nice_steps()))
    least = F.greatest(F.col("span") / max_rows, F.col("top") * 1e-9)
    # a step beyond the highest price holds all in one row, so that a step fits every series
    some = F.concat(F.slice(F.filter(steps, lambda s: s >= least / 2), 1, 4), F.slice(F.filter(steps, lambda s: s > 2 * F.col("top")), 1, 1))
    tried = F.broadcast(span.select(*SERIES, F.explode(F.array_distinct(some)).alias("step")))
    counted = trades.select(*SERIES, "price").distinct().join(tried, SERIES).groupBy(*SERIES, "step").agg(F.count_distinct(F.floor(F.col("price") / F.col("step") + 1e-9)).alias("rows"))
    chosen = F.broadcast(counted.where(F.col("rows") <= max_rows).groupBy(*SERIES).agg(F.min("step").alias("step")))
    rows = scalars.enrich_trades(trades).join(chosen, SERIES).withColumn("level", F.floor(F.col("price") / F.col("step") + 1e-9))
    side = lambda s: F.round(F.sum(F.when(F.col("side") == s, F.col("quantity")).otherwise(0.0)), 8)
    return rows.groupBy(*SERIES, "step", "level").agg(side("buy").alias("buy_base"), side("sell").alias("sell_base"), F.count("*").alias("n")).withColumn("price", F.round(F.col("level") * F.col("step"), 8))


def _islands(rows: DataFrame, breaks, order: str = "open_time") -> DataFrame:
    w = Window.partitionBy(*SERIES).orderBy(order)
    return rows.withColumn("island", F.sum(F.when(breaks(w), 1).otherwise(0)).over(w))


def cvd(bars: DataFrame, interval: str) -> DataFrame:
    """Running sum of bar deltas over the latest stretch of bars that follow each other and all have flow, from 0."""
    rows = scalars.enrich_order_flow(bars)
    ok = F.col("volume_delta_base").isNotNull()
    step = lambda w: (~ok) | (~F.coalesce(F.lag(ok).over(w), F.lit(False))) | ~F.coalesce(iv.is_successor(F.lag("open_time").over(w), F.col("open_time"), interval), F.lit(False))
    w = Window.partitionBy(*SERIES)
    rows = _islands(rows, step).withColumn("last_island", F.max("island").over(w)).withColumn("missing", F.count_if(~ok).over(w))
    rows = rows.withColumn("discontinuities", F.max("island").over(w) - 1)
    rows = rows.where((F.col("island") == F.col("last_island")) & ok)
    return rows.select(*SERIES, "open_time", F.col("volume_delta_base").alias("delta"), F.col("taker_buy_base").alias("buy"), (-F.col("taker_sell_base")).alias("sell"), F.round(F.sum("volume_delta_base").over(w.orderBy("open_time")), 8).alias("cvd"), "missing", "discontinuities")


def cvd_from_flow(flow: DataFrame) -> DataFrame:
    """Running delta of minute rollups, anew after each incomplete or missing minute; incomplete minutes have none."""
    ok = F.col("is_complete")
    step = lambda w: ~ok | ~F.coalesce(F.lag(ok).over(w), F.lit(False)) | (F.col("open_time") != F.coalesce(F.lag("open_time").over(w) + MINUTE, F.lit(-1)))
    rows = _islands(flow, step)
    return rows.withColumn("cvd", F.when(ok, F.round(F.sum("delta_base").over(Window.partitionBy(*SERIES, "island").orderBy("open_time")), 8)))


def audit_trades(trades: DataFrame, start_ms: int, end_ms: int) -> DataFrame:
    """Per series and UTC day in [start, end): rows, first and last id and time, missing ids, repeats, and the verdict
    exact: something is there, and nothing is missing or repeated."""
    day = F.col("trade_time_ms") - F.pmod("trade_time_ms", F.lit(iv.UNIT_MS["d"]))
    rows = trades.where(F.col("trade_time_ms").between(start_ms, end_ms - 1)).withColumn("day_ms", day)
    before = F.lag("agg_trade_id").over(Window.partitionBy(*SERIES).orderBy("agg_trade_id", "trade_time_ms"))
    rows = rows.withColumns({"gap": F.greatest(F.col("agg_trade_id") - before - 1, F.lit(0)), "again": F.col("agg_trade_id") == before})
    found = rows.groupBy(*SERIES, "day_ms").agg(F.count("*").alias("rows"), F.min("agg_trade_id").alias("first_id"), F.max("agg_trade_id").alias("last_id"), F.min("trade_time_ms").alias("first_time_ms"), F.max("trade_time_ms").alias("last_time_ms"), F.coalesce(F.sum("gap"), F.lit(0)).alias("missing_ids"), F.count_if("again").alias("repeats"))
    days = trades.select(*SERIES).distinct().withColumn("day_ms", F.explode(F.sequence(F.lit(start_ms - start_ms % iv.UNIT_MS["d"]), F.lit(end_ms - 1), F.lit(iv.UNIT_MS["d"]))))
    out = days.join(found, [*SERIES, "day_ms"], "left").fillna(0, ["rows", "missing_ids", "repeats"])
    return out.withColumn("exact", (F.col("rows") > 0) & (F.col("missing_ids") == 0) & (F.col("repeats") == 0))


def performance(trades: DataFrame, keys: list[str], profit: str = "profit") -> DataFrame:
    """Wins, losses, win rate, mean win and loss, and profit factor (null without losses) of closed trades, exact."""
    p = F.col(profit).cast("decimal(28,8)")
    won, lost = F.sum(F.when(p > 0, p)), F.sum(F.when(p < 0, -p))
    rows = trades.groupBy(*keys).agg(F.count("*").alias("closed"), F.count_if(p > 0).alias("wins"), F.count_if(p < 0).alias("losses"), won.alias("gained"), lost.alias("lost"))
    share = lambda a, b: F.when(F.col(b) > 0, F.round(F.col(a).cast("double") / F.col(b).cast("double"), 8))
    return rows.withColumns({"win_rate": share("wins", "closed"), "average_win": share("gained", "wins"), "average_loss": share("lost", "losses"), "profit_factor": share("gained", "lost")})


def max_drawdown(equity: DataFrame, keys: list[str], time: str, value: str) -> DataFrame:
    """The greatest fall from a running peak."""
    peak = F.max(value).over(Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, 0))
    return equity.withColumn("fall", peak - F.col(value)).groupBy(*keys).agg(F.round(F.max("fall"), 8).alias("max_drawdown"))
