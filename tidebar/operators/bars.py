"""Bars from trades, and coarser bars from bars. All by partial aggregation on (series, bucket)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..schemas import SERIES

FLOW = ["quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]


def bars_from_trades(trades: DataFrame, interval: str, bucket: Callable[[Column], Column] | None = None, extra_aggs: list[Column] | None = None, places: int = 8) -> DataFrame:
    """OHLCV bars: open and close by (time, id). bucket maps a time to its bar's start; extra_aggs are added aggregates."""
    i = iv.parse_interval(interval)
    start = bucket(F.col("trade_time_ms")) if bucket else iv.bucket_floor(F.col("trade_time_ms"), i)
    order = F.struct("trade_time_ms", "agg_trade_id")
    quote, buy = F.col("price") * F.col("quantity"), ~F.col("is_buyer_maker")
    raw = F.coalesce(F.col("last_trade_id") - F.col("first_trade_id") + 1, F.lit(1))
    total = lambda c: F.round(F.sum(c), places)
    bars = trades.groupBy(*SERIES, start.alias("open_time")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        total("quantity").alias("volume"), total(quote).alias("quote_volume"), F.sum(raw).alias("trades"),
        total(F.when(buy, F.col("quantity")).otherwise(0.0)).alias("taker_buy_base"), total(F.when(buy, quote).otherwise(0.0)).alias("taker_buy_quote"), *(extra_aggs or []),
    )
    close = iv.bucket_close(F.col("open_time"), i)
    return bars.withColumns({"interval": F.lit(i.name), "close_time": close, "is_closed": F.lit(True)})


def fill_silent_bars(bars: DataFrame, interval: str, start: int | None = None) -> DataFrame:
    """Adds a flat bar at the last close, without volume, for each silent bucket between a series' bars. A start before
    the first bar is an error, since there is no close to carry."""
    i = iv.parse_interval(interval)
    if start is not None and bars.groupBy(*SERIES).agg(F.min("open_time").alias("t")).where(F.col("t") > start).limit(1).count():
        raise ValueError("no trade precedes the first bucket of a series")
    after = F.lead("open_time").over(Window.partitionBy(*SERIES).orderBy("open_time"))
    rows = bars.withColumn("after", after)
    following = iv.bucket_next(F.col("open_time"), i)
    silent = iv.buckets_between(rows.where(F.col("after") > following).select(*SERIES, F.col("close").alias("carried"), following.alias("from"), (F.col("after") - 1).alias("to")), i, "from", "to")
    price = {c: F.col("carried") for c in ("open", "high", "low", "close")}
    zero = {c: F.lit(0).cast(dict(bars.dtypes)[c]) for c in ("volume", *FLOW) if c in bars.columns}
    rest = {"close_time": iv.bucket_close(F.col("open_time"), i), "interval": F.lit(i.name), "is_closed": F.lit(True)}
    made = silent.withColumns(price | zero | {k: v for k, v in rest.items() if k in bars.columns}).withColumn("filled", F.lit(True))
    out = bars.withColumn("filled", F.lit(False)).unionByName(made.drop("carried", "from", "to"), allowMissingColumns=True)
    return out.select(*bars.columns, "filled")


def _additive(name: str, places: int = 8) -> Column:
    """The sum, or null if any part is unknown."""
    s = F.sum(name)
    return F.when(F.count(name) == F.count(F.lit(1)), s if name == "trades" else F.round(s, places)).alias(name)


def resample_bars(bars: DataFrame, source: str, target: str, now_ms: int) -> DataFrame:
    """Coarser bars, strict: a bar comes out only if each of its parts is there once, closed, with its exact close, and
    the bar itself has ended by now."""
    if not iv.interval_tiles(source, target):
        raise ValueError(f"{source} does not fill {target}")
    s, t = iv.parse_interval(source), iv.parse_interval(target)
    start, at = iv.bucket_floor(F.col("open_time"), t), F.col("open_time")
    exact = F.col("is_closed") & (F.col("close_time") == iv.bucket_close(at, s)) & (iv.bucket_floor(at, s) == at)
    rows = bars.groupBy(*SERIES, start.alias("bucket")).agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"),
        F.round(F.sum("volume"), 8).alias("volume"), *map(_additive, FLOW), F.count(F.lit(1)).alias("parts"), F.count_distinct(at).alias("distinct_parts"), F.bool_and(F.coalesce(exact, F.lit(False))).alias("exact"),
    )
    after = iv.bucket_next(F.col("bucket"), t)
    expected = (iv.month_number(after) - iv.month_number(F.col("bucket"))) / s.count if s.months else (after - F.col("bucket")) / s.ms
    rows = rows.where((F.col("parts") == expected) & (F.col("distinct_parts") == F.col("parts")) & F.col("exact") & (after <= now_ms))
    rows = rows.withColumns({"close_time": after - 1, "interval": F.lit(t.name), "is_closed": F.lit(True)})
    return rows.withColumnRenamed("bucket", "open_time").drop("parts", "distinct_parts", "exact")


def resample_bars_months(bars: DataFrame, source: str, target: str, now_ms: int) -> DataFrame:
    """Coarser bars, lenient: partial buckets stay, as forming. Flow sums cover a bucket only while its parts follow each
    other from its start without a hole; otherwise they are null."""
    s, t = iv.parse_interval(source), iv.parse_interval(target)
    start, at = iv.bucket_floor(F.col("open_time"), t), F.col("open_time")
    order = Window.partitionBy(*SERIES, "bucket").orderBy("open_time")
    rows = bars.withColumn("bucket", start)
    before = F.lag("open_time").over(order)
    follows = F.when(before.isNull(), at == F.col("bucket")).otherwise(iv.is_successor(before, at, s))
    rows = rows.withColumn("follows", F.coalesce(follows, F.lit(False)))
    out = rows.groupBy(*SERIES, "bucket").agg(
        F.min_by("open", at).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", at).alias("close"), F.round(F.sum("volume"), 8).alias("volume"), *map(_additive, FLOW),
        F.bool_and("follows").alias("whole"), F.max("open_time").alias("last_part"), F.bool_and("is_closed").alias("parts_closed"),
    )
    after = iv.bucket_next(F.col("bucket"), t)
    full = F.col("whole") & F.col("parts_closed") & (iv.bucket_next(F.col("last_part"), s) == after) & (after <= now_ms)
    out = out.withColumns({c: F.when(F.col("whole"), F.col(c)) for c in FLOW})
    return out.select(*SERIES, F.col("bucket").alias("open_time"), (after - 1).alias("close_time"), F.lit(t.name).alias("interval"), "open", "high", "low", "close", "volume", *FLOW, full.alias("is_closed"))


def merge_components(snapshots: DataFrame, target: str) -> DataFrame:
    """Bars of target from snapshots of their parts (sequence, tick_count): the latest snapshot of each part counts, and
    coverage tells how much of the bar its parts span. See integrity.accept_snapshots for the rule that rejects regress."""
    t = iv.parse_interval(target)
    fields = ["close_time", "open", "high", "low", "close", "volume", "tick_count", "is_closed"]
    latest = snapshots.groupBy(*SERIES, "open_time").agg(F.max_by(F.struct(*fields), "sequence").alias("x")).select(*SERIES, "open_time", "x.*")
    out = latest.groupBy(*SERIES, iv.bucket_floor(F.col("open_time"), t).alias("bucket")).agg(
        F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"),
        F.round(F.sum("volume"), 8).alias("volume"), F.sum("tick_count").alias("tick_count"), F.sum(F.col("close_time") - F.col("open_time") + 1).alias("covered_ms"), F.bool_and("is_closed").alias("parts_closed"),
    )
    after = iv.bucket_next(F.col("bucket"), t)
    whole = F.col("covered_ms") == after - F.col("bucket")
    return out.withColumns({"coverage": F.col("covered_ms") / (after - F.col("bucket")), "is_closed": whole & F.col("parts_closed")}).withColumnRenamed("bucket", "open_time").drop("parts_closed")
