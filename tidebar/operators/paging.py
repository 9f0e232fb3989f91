"""Reads of stored series: ranges with their continuity, pages, newest rows, retention."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..schemas import SERIES


def latest(df: DataFrame, n: int, time: str = "open_time") -> DataFrame:
    """The newest n rows of each series."""
    nth = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc(time)))
    return df.withColumn("nth", nth).where(F.col("nth") <= n).drop("nth")


def _key(df: DataFrame, key: dict[str, str]) -> DataFrame:
    for c, v in key.items():
        df = df.where(F.col(c) == v)
    return df


def holes(bars: DataFrame, interval: str, start_ms: int, end_ms: int, keys: list[str] = SERIES) -> DataFrame:
    """keys, start, end, bars: the stretches of buckets that start in [start_ms, end_ms] and that a series with a bar there
    lacks. Found between neighbours, within stretches of time and then across them, so nothing is made for the buckets
    themselves, and a long series is many tasks. Bars that start beside a bucket's start count as none."""
    i, at = iv.parse_interval(interval), F.col("open_time")
    floor = iv.bucket_floor(F.lit(start_ms), i)
    first = F.when(floor < start_ms, iv.bucket_next(floor, i)).otherwise(floor)
    beyond = iv.bucket_next(iv.bucket_floor(F.lit(end_ms), i), i)
    width = (i.count * 30 * iv.UNIT_MS["d"] if i.months else i.ms) * 4096
    here = bars.where(at.between(start_ms, end_ms) & (iv.bucket_floor(at, i) == at)).select(*keys, "open_time", F.floor(at / width).alias("stretch")).distinct()
    ends = here.groupBy(*keys, "stretch").agg(F.min("open_time").alias("least"))
    w = Window.partitionBy(*keys).orderBy("stretch")
    ends = ends.select(*keys, "stretch", F.coalesce(F.lead("least").over(w), beyond).alias("following"), F.when(F.lag("least").over(w).isNull(), F.col("least")).alias("leading"))
    inner = here.join(ends, [*keys, "stretch"])
    upto = F.coalesce(F.lead("open_time").over(Window.partitionBy(*keys, "stretch").orderBy("open_time")), F.col("following"))
    inner = inner.select(*keys, iv.bucket_next(at, i).alias("start"), upto.alias("upto"))
    before = ends.where("leading is not null").select(*keys, first.alias("start"), F.col("leading").alias("upto"))
    out = inner.unionByName(before).where("start < upto")
    return out.select(*keys, "start", iv.bucket_previous(F.col("upto"), i).alias("end"), iv.buckets_in(F.col("start"), F.col("upto"), i).alias("bars"))


def query_range(bars: DataFrame, key: dict[str, str], interval: str, start_ms: int, end_ms: int) -> tuple[DataFrame, DataFrame]:
    """The bars of [start, end], and one row on their continuity: expected and actual bars, missing ranges, whether they
    are contiguous, and whether anything can be shown."""
    rows = _key(bars, key).where(F.col("open_time").between(start_ms, end_ms))
    i = iv.parse_interval(interval)
    floor = iv.bucket_floor(F.lit(start_ms), i)
    first = F.when(floor < start_ms, iv.bucket_next(floor, i)).otherwise(floor)
    last = iv.bucket_floor(F.lit(end_ms), i)
    expected = F.greatest(iv.buckets_in(first, iv.bucket_next(last, i), i), F.lit(0))
    gone = holes(rows, interval, start_ms, end_ms, [])
    gone = gone.agg(F.sort_array(F.collect_list(F.struct("start", "end", "bars"))).alias("missing_ranges"), F.coalesce(F.sum("bars"), F.lit(0)).alias("missing"))
    placed = F.count_if(iv.bucket_floor(F.col("open_time"), i) == F.col("open_time")).alias("placed")
    counts = rows.agg(F.count_distinct("open_time").alias("actual_bars"), placed).crossJoin(gone).withColumn("expected_bars", expected)
    bare = F.col("placed") == 0  # no neighbour to find a hole by: all is missing
    whole = F.when(F.col("expected_bars") > 0, F.array(F.struct(first.alias("start"), last.alias("end"), F.col("expected_bars").alias("bars")))).otherwise(F.col("missing_ranges"))
    counts = counts.withColumns({"missing_ranges": F.when(bare, whole).otherwise(F.col("missing_ranges")), "missing": F.when(bare, F.col("expected_bars")).otherwise(F.col("missing"))})
    return rows, counts.select("expected_bars", "actual_bars", "missing_ranges", "missing", (F.col("missing") == 0).alias("verified_contiguous"), (F.col("actual_bars") > 0).alias("renderable"))


def query_history(bars: DataFrame, key: dict[str, str], interval: str, days: float, now_ms: int) -> DataFrame:
    """The bars of the last days, up to the last closed one."""
    last = iv.last_closed_open(F.lit(now_ms), interval)
    return _key(bars, key).where((F.col("open_time") >= F.lit(now_ms - int(days * iv.UNIT_MS["d"]))) & (F.col("open_time") <= last))


def query_before(bars: DataFrame, key: dict[str, str], cursor_ms: int, n: int) -> DataFrame:
    """The n bars before the cursor, with has_more: whether there are others before these."""
    rows = _key(bars, key).where(F.col("open_time") < cursor_ms).orderBy(F.desc("open_time")).limit(n + 1)
    nth = F.row_number().over(Window.orderBy(F.desc("open_time")))
    rows = rows.withColumn("nth", nth)
    more = rows.agg((F.count("*") > n).alias("has_more"))
    return rows.where(F.col("nth") <= n).drop("nth").crossJoin(F.broadcast(more))


def query_events(events: DataFrame, snapshot_offset: int, start_ms: int, end_ms: int, limit: int, after: tuple[int, int, int] | None = None) -> DataFrame:
    """A page of the events below the snapshot's offset in [start, end], in order of time, partition and offset; after is
    the last row of the page before."""
    rows = events.where((F.col("kafka_offset") < snapshot_offset) & F.col("event_time_ms").between(start_ms, end_ms))
    place = ["event_time_ms", "kafka_partition", "kafka_offset"]
    if after:
        rows = rows.where(F.struct(*place) > F.struct(*[F.lit(x).cast(t) for x, t in zip(after, ("bigint", "int", "bigint"))]))
    return rows.orderBy(*place).limit(limit)


def query_event_page(events: DataFrame, snapshot_offset: int, start_ms: int, end_ms: int, limit: int, cursor: str | None = None, partition_key: str | None = None, most: int = 100_000) -> tuple[DataFrame, str | None]:
    """query_events of one page, and the cursor of the next, which is None after the last. A cursor is the place of the page's
    last row, bound to the snapshot, the range and the key (null: all events) that it was made for, and works for no other; the
    size of a page may change. Only that row reaches the driver."""
    if not 0 < limit <= most:
        raise ValueError(f"a page has 1 to {most} rows")
    if end_ms < start_ms:
        raise ValueError("the range ends before it starts")
    bound = {"snapshot": snapshot_offset, "start": start_ms, "end": end_ms, "key": partition_key}
    after = None
    if cursor is not None:
        try:
            held = json.loads(cursor)
            after = tuple(int(x) for x in held.pop("after"))
        except (ValueError, KeyError, TypeError, AttributeError) as e:
            raise ValueError("this is no cursor") from e
        if held != bound or len(after) != 3:
            raise ValueError("the cursor belongs to another snapshot, range or key")
    rows = events if partition_key is None else events.where(F.col("partition_key") == partition_key)
    place = ["event_time_ms", "kafka_partition", "kafka_offset"]
    page = query_events(rows, snapshot_offset, start_ms, end_ms, limit, after)
    end = query_events(rows, snapshot_offset, start_ms, end_ms, limit + 1, after).agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.struct(*place)), asc=False).alias("x"))
    n, last = end.select("n", F.get("x", F.lit(1)).alias("last")).first()
    return page, json.dumps(bound | {"after": list(last)}) if n > limit else None


def apply_retention(bars: DataFrame, limits: DataFrame) -> DataFrame:
    """The newest bars of each series and interval, as many as limits (tier, keep) allows; 1s bars are not touched."""
    unit = F.right("interval", F.lit(1))
    tier = F.when(F.col("interval") == "1s", "1s").when(unit.isin("s", "m"), "minute").when(unit == "h", "hour").otherwise("day")
    nth = F.row_number().over(Window.partitionBy(*SERIES, "interval").orderBy(F.desc("open_time")))
    rows = bars.withColumns({"tier": tier, "nth": nth}).join(limits, "tier", "left")
    return rows.where((F.col("tier") == "1s") | F.col("keep").isNull() | (F.col("nth") <= F.col("keep"))).drop("tier", "nth", "keep")


def query_metric(df: DataFrame, key: dict[str, str], time: str, start_ms: int, end_ms: int, limit: int, newest_first: bool = False) -> DataFrame:
    rows = _key(df, key).where(F.col(time).between(start_ms, end_ms))
    return rows.orderBy(F.desc(time) if newest_first else F.asc(time)).limit(limit)


def plan_gap_repairs(gaps: DataFrame, most: int, budget: int) -> DataFrame:
    """Gaps to repair: the newest first, at most `most`, and bars within the budget; the last may be cut to what is left."""
    w = Window.partitionBy(*SERIES).orderBy(F.desc("end"))
    rows = gaps.withColumns({"nth": F.row_number().over(w), "upto": F.sum("bars").over(w)})
    rows = rows.withColumn("repair_bars", F.least(F.col("bars"), F.lit(budget) - (F.col("upto") - F.col("bars"))))
    return rows.where((F.col("nth") <= most) & (F.col("repair_bars") > 0)).drop("upto")


def recent_alerts(alerts: DataFrame, n: int) -> DataFrame:
    return alerts.orderBy(F.desc("triggered_at_ms"), F.desc("rule_id")).limit(n)


def scan_movers(bars: DataFrame, lookback: int, least_move: float) -> DataFrame:
    """Percent change over the last `lookback` bars of each series, those of at least least_move, largest first."""
    rows = latest(bars, lookback).groupBy(*SERIES).agg(F.min_by("close", "open_time").alias("first_close"), F.max_by("close", "open_time").alias("last_close"))
    move = F.round((F.col("last_close") - F.col("first_close")) / F.col("first_close") * 100, 8)
    return rows.withColumn("move_pct", move).where(F.abs("move_pct") >= least_move).orderBy(F.desc(F.abs("move_pct")))


def series_bounds(df: DataFrame, keys: list[str], time: str = "open_time", complete: str = "is_closed") -> DataFrame:
    return df.groupBy(*keys).agg(F.min(time).alias("first_ms"), F.max(time).alias("last_ms"), F.count("*").alias("n"), F.bool_and(complete).alias("all_complete"))


def event_range(events: DataFrame) -> DataFrame:
    """Offsets, times and, only where every row has them, sequences of each topic and partition."""
    all_ = F.count("sequence_start") == F.count("*")
    rows = events.groupBy("kafka_topic", "kafka_partition").agg(F.count("*").alias("n"), F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset"), F.min("event_time_ms").alias("first_time_ms"), F.max("event_time_ms").alias("last_time_ms"), F.when(all_, F.min("sequence_start")).alias("sequence_first"), F.when(F.count("sequence_end") == F.count("*"), F.max("sequence_end")).alias("sequence_last"))
    return rows


def list_series(bars: DataFrame) -> DataFrame:
    return bars.groupBy(*SERIES, "interval").agg(F.count("*").alias("n"), F.min("open_time").alias("earliest"), F.max("open_time").alias("latest"))
