"""Inclusive ranges of time or ids: segments, unions, differences, and what follows from them."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..schemas import SERIES


def segments(bars: DataFrame, interval: str) -> DataFrame:
    """Stretches of bars that follow each other: first and last open time, and rows."""
    w = Window.partitionBy(*SERIES).orderBy("open_time")
    new = ~F.coalesce(iv.is_successor(F.lag("open_time").over(w), F.col("open_time"), interval), F.lit(False))
    rows = bars.withColumn("segment", F.sum(F.when(new, 1).otherwise(0)).over(w))
    return rows.groupBy(*SERIES, "segment").agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"), F.count("*").alias("rows"))


def eligible_windows(bars: DataFrame, interval: str, warm_up: int, forward: int) -> DataFrame:
    """Per segment the starts that leave warm_up bars before and forward bars from them: first, last, number, and the
    number in all segments of the series up to this one."""
    i = iv.parse_interval(interval)
    rows = segments(bars, interval)
    rows = rows.withColumns({"first": F.col("start") + F.lit(warm_up * i.ms), "last": F.col("end") - F.lit((forward - 1) * i.ms)})
    rows = rows.where(F.col("first") <= F.col("last")).withColumn("windows", ((F.col("last") - F.col("first")) / i.ms).cast("bigint") + 1)
    return rows.withColumn("upto", F.sum("windows").over(Window.partitionBy(*SERIES).orderBy("start")))


def seeded_index(seed: str, total: int) -> int:
    """A uniform number below total: hashes of the seed, those beyond the last whole multiple rejected."""
    if total < 1:
        raise ValueError("nothing to draw from")
    limit, n = (1 << 256) // total * total, 0
    while (x := int.from_bytes(hashlib.sha256(f"{seed}:{n}".encode()).digest(), "big")) >= limit:
        n += 1
    return x % total


def sampled_window(windows: DataFrame, interval: str, index: int) -> DataFrame:
    """The window with this number, counted over the segments of its series."""
    hit = windows.where((F.col("upto") > index) & (F.col("upto") - F.col("windows") <= index))
    return hit.withColumn("open_time", F.col("first") + (index - (F.col("upto") - F.col("windows"))) * F.lit(iv.parse_interval(interval).ms))


def coalesce_ranges(ranges: DataFrame, keys: list[str], start: str = "start", end: str = "end") -> DataFrame:
    """Overlapping and adjacent ranges of a key become one."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = ranges.where(F.col(start) <= F.col(end)).withColumn("island_reach", reach)
    rows = rows.withColumn("island", F.sum(F.when(F.col(start) <= F.col("island_reach") + 1, 0).otherwise(1)).over(w))
    return rows.groupBy(*keys, "island").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("island")


def subtract_ranges(requested: DataFrame, covered: DataFrame, keys: list[str]) -> DataFrame:
    """What of the requested ranges no covered range holds. Both are coalesced; then one pass per key over their edges in
    order counts how many requests and covers are open, and the stretches with a request and no cover remain."""
    edges = None
    for ranges, asks, holds in ((coalesce_ranges(requested, keys), 1, 0), (coalesce_ranges(covered, keys), 0, 1)):
        for at, sign in ((F.col("start"), 1), (F.col("end") + 1, -1)):
            own = ranges.select(*keys, at.alias("start"), F.lit(sign * asks).alias("asks"), F.lit(sign * holds).alias("holds"))
            edges = own if edges is None else edges.unionByName(own)
    edges = edges.groupBy(*keys, "start").agg(F.sum("asks").alias("asks"), F.sum("holds").alias("holds"))
    w = Window.partitionBy(*keys).orderBy("start")
    rows = edges.withColumns({"asked": F.sum("asks").over(w), "held": F.sum("holds").over(w), "end": F.lead("start").over(w) - 1})
    return rows.where("asked > 0 and held = 0").select(*keys, "start", "end")


def clip_ranges(ranges: DataFrame, low: int | None = None, now: int | None = None) -> DataFrame:
    """Ranges cut to [low, now]; what is outside goes."""
    start = F.greatest("start", F.lit(low).cast("bigint")) if low is not None else F.col("start")
    end = F.least("end", F.lit(now).cast("bigint")) if now is not None else F.col("end")
    return ranges.withColumns({"start": start, "end": end}).where("start <= end")


def dirty_refresh(dirty: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """What to compute anew after a correction: from the dirty start to the end of the wanted range, as recursion carries
    on; the whole range where a dirty one ends before it, nothing where all start after it. Of a key's dirty ranges only
    the least start counts, so ranges are not paired."""
    d = dirty.groupBy(*keys).agg(F.min("start").alias("ds"))
    rows = wanted.groupBy(*keys, "end").agg(F.min("start").alias("start")).join(d, keys).where("ds <= end")
    return rows.select(*keys, F.greatest("ds", "start").alias("start"), "end")
