"""Trading calendars, expected bars, gaps and what to fetch for them."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..schemas import SERIES
from . import ranges


@dataclass(frozen=True)
class SessionCalendar:
    """Weekly windows (weekday 0 = Monday, start and end minute of the local day; an end at or before the start is on the
    next day), holidays (local dates, no session) and overrides (local date -> windows in place of the usual)."""

    zone: str
    windows: tuple[tuple[int, int, int], ...]
    holidays: tuple[str, ...] = ()
    overrides: dict[str, tuple[tuple[int, int], ...]] = field(default_factory=dict)


def expected_opens(ranges_: DataFrame, interval: str, halts: DataFrame | None = None) -> DataFrame:
    """Open times of a calendar that never closes; halts (SERIES, start, end) take out the opens that they hold."""
    rows = iv.buckets_between(ranges_, interval)
    if halts is None:
        return rows
    held = iv.buckets_between(halts.select(*SERIES, "start", "end"), interval).select(*SERIES, "open_time")
    return rows.join(held, [*SERIES, "open_time"], "left_anti")


def range_summary(ranges_: DataFrame, interval: str) -> DataFrame:
    """First and last open in each range, their number, and the opens on either side."""
    rows = iv.buckets_between(ranges_, interval).groupBy(*ranges_.columns).agg(F.min("open_time").alias("first_open"), F.max("open_time").alias("last_open"), F.count("*").alias("opens"))
    return rows.withColumns({"next_open": iv.bucket_next(F.col("last_open"), interval), "previous_open": iv.bucket_previous(F.col("first_open"), interval)})


def excused_gaps(gaps: DataFrame, halts: DataFrame) -> DataFrame:
    """Adds excused: whether the gap is exactly a verified halt, by start, end and number of bars."""
    h = halts.select(*SERIES, "start", "end", "bars").withColumn("excused", F.lit(True))
    return gaps.join(h, [*SERIES, "start", "end", "bars"], "left").fillna({"excused": False})


def session_segments(spark: SparkSession, calendar: SessionCalendar, start_ms: int, end_ms: int) -> DataFrame:
    """UTC stretches in which the calendar is open, merged and cut to [start, end]. Local edges become UTC one by one, so a
    session across a change of clocks has its true length."""
    days = spark.range(1).select(F.explode(F.sequence(F.to_date(F.timestamp_millis(F.lit(start_ms - 2 * iv.UNIT_MS["d"]))), F.to_date(F.timestamp_millis(F.lit(end_ms + 2 * iv.UNIT_MS["d"]))))).alias("day"))
    usual = spark.createDataFrame(list(calendar.windows), "weekday int, a int, b int")
    special = spark.createDataFrame([(d, a, b) for d, ws in calendar.overrides.items() for a, b in ws], "date string, a int, b int")
    closed = [*calendar.holidays, *calendar.overrides]
    plain = days.where(~F.col("day").cast("string").isin(closed)) if closed else days
    rows = plain.withColumn("weekday", F.weekday("day")).join(usual, "weekday").select("day", "a", "b")
    rows = rows.unionByName(days.join(special, F.col("day").cast("string") == F.col("date")).select("day", "a", "b"))
    edge = lambda day, minute: F.unix_millis(F.to_utc_timestamp(F.timestamp_seconds(F.unix_date(day) * 86_400 + minute * 60), calendar.zone))
    end = F.when(F.col("b") <= F.col("a"), F.col("b") + 1440).otherwise(F.col("b"))
    rows = rows.select(F.lit(1).alias("all"), edge(F.col("day"), F.col("a")).alias("start"), (edge(F.col("day"), end) - 1).alias("end"))
    return ranges.clip_ranges(ranges.coalesce_ranges(rows, ["all"]), start_ms, end_ms).drop("all")


def session_opens(segments: DataFrame, interval: str) -> DataFrame:
    """Bars of a session: from its start, each interval; the last ends with the session."""
    i = iv.parse_interval(interval)
    rows = segments.withColumn("open_time", F.explode(F.sequence("start", "end", F.lit(i.ms))))
    return rows.withColumn("close_time", F.least(F.col("open_time") + i.ms - 1, F.col("end")))


def session_bucket_end(bars: DataFrame, segments: DataFrame, interval: str, parts: int = 16) -> DataFrame:
    """close_time of bars: their own end, cut at the end of the session that holds their open; weeks and months keep the
    UTC grid. Sessions are matched by one ordered pass within each day, which a session's rows reach by its days, so no
    series and no week meets in one task."""
    i = iv.parse_interval(interval)
    if i.unit in "wM":
        return bars.withColumn("close_time", iv.bucket_close(iv.bucket_floor(F.col("open_time"), i), i))
    both = bars.withColumns({"at": F.col("open_time"), "session_end": F.lit(None).cast("bigint"), "kind": F.lit(1)}).unionByName(segments.select(F.col("start").alias("at"), F.col("end").alias("session_end"), F.lit(0).alias("kind")), allowMissingColumns=True)
    day = lambda t: t - F.pmod(t, F.lit(iv.UNIT_MS["d"]))
    held_days = F.sequence(day(F.col("at")), day(F.col("session_end")), F.lit(iv.UNIT_MS["d"]))
    both = both.withColumn("day", F.explode(F.when(F.col("kind") == 0, held_days).otherwise(F.array(day(F.col("at"))))))
    # the bars of a day are spread over parts, and each part has the day's few sessions
    part = F.when(F.col("kind") == 1, F.array(F.pmod(F.xxhash64(*bars.columns), F.lit(parts)).cast("int"))).otherwise(F.sequence(F.lit(0), F.lit(parts - 1)))
    both = both.withColumn("part", F.explode(part))
    held = F.last("session_end", True).over(Window.partitionBy("day", "part").orderBy("at", "kind").rowsBetween(Window.unboundedPreceding, 0))
    rows = both.withColumn("session_end", held).where("kind = 1")
    inside = F.col("session_end") >= F.col("open_time")
    return rows.withColumn("close_time", F.when(inside, F.least(F.col("open_time") + i.ms - 1, F.col("session_end"))).otherwise(F.col("open_time") + i.ms - 1)).drop("at", "session_end", "kind", "day", "part")


def coarse_opens(segments: DataFrame, interval: str) -> DataFrame:
    """The first session open in each week or month."""
    return segments.groupBy(iv.bucket_floor(F.col("start"), interval).alias("bucket")).agg(F.min("start").alias("open_time"))


def _day(time: Column) -> Column:
    return time - F.pmod(time, F.lit(iv.UNIT_MS["d"]))


def numbered_opens(opens: DataFrame) -> DataFrame:
    """A calendar's opens with their place in it, from 0: neighbours differ by one, however long the calendar is closed between
    them. The opens of each day are numbered apart, and one task sums the counts of days."""
    nth = F.row_number().over(Window.partitionBy("day").orderBy("open_time")) - 1
    rows = opens.select("open_time").distinct().withColumn("day", _day(F.col("open_time"))).withColumn("nth", nth)
    before = F.sum("n").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, -1))
    days = rows.groupBy("day").agg(F.count("*").alias("n")).select("day", F.coalesce(before, F.lit(0)).alias("before"))
    return rows.join(days, "day").select("open_time", (F.col("before") + F.col("nth")).alias("place"))


def detect_gaps(bars: DataFrame, requests: DataFrame, interval: str, now_ms: int, tolerance: int = 0, opens: DataFrame | None = None, most_holes: int | None = None) -> DataFrame:
    """Gaps of each request (SERIES, start, end) up to the last closed bar: HEAD, INTERIOR or TAIL, with their bars; a
    series without bars is one TAIL. Gaps of at most `tolerance` bars are let go; of a series' INTERIOR gaps the first
    most_holes are given, or all.

    opens (open_time, close_time): the opens of a calendar, such as session_opens gives; what it is closed for is no gap,
    and a gap goes on across it. Without them the calendar never closes. Bars beside the calendar's opens don't count."""
    i = iv.parse_interval(interval)
    if opens is None:
        cut = requests.withColumn("end", F.least("end", iv.last_closed_open(F.lit(now_ms), i))).where("start <= end")
        number = F.floor(iv.month_number(F.col("open_time")) / i.count) if i.months else F.floor((F.col("open_time") - i.origin) / i.ms)
        want = iv.buckets_between(cut, i).select(*SERIES, "open_time", number.alias("place"))
    else:
        placed = numbered_opens(opens.where(F.col("close_time") < now_ms)).withColumn("day", _day(F.col("open_time")))
        days = requests.where("start <= end").withColumn("day", F.explode(F.sequence(_day(F.col("start")), _day(F.col("end")), F.lit(iv.UNIT_MS["d"]))))
        want = days.join(placed, "day").where(F.col("open_time").between(F.col("start"), F.col("end"))).select(*SERIES, "open_time", "place")
    have = bars.select(*SERIES, "open_time").distinct().withColumn("there", F.lit(True))
    rows = want.distinct().join(have, [*SERIES, "open_time"], "left")
    span = rows.where("there").groupBy(*SERIES).agg(F.min("open_time").alias("first_bar"), F.max("open_time").alias("last_bar"))
    # only what is missing is put in order
    island = F.col("place") - F.row_number().over(Window.partitionBy(*SERIES).orderBy("place"))
    gaps = rows.where("there is null").withColumn("island", island).groupBy(*SERIES, "island").agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"), F.count("*").alias("bars"))
    kind = F.when(F.col("end") < F.col("first_bar"), "HEAD").when(F.col("start") < F.col("last_bar"), "INTERIOR").otherwise("TAIL")
    gaps = gaps.where(F.col("bars") > tolerance).join(span, SERIES, "left").withColumn("kind", kind)
    if most_holes is not None:
        nth = F.row_number().over(Window.partitionBy(*SERIES, "kind").orderBy("start"))
        gaps = gaps.withColumn("nth", nth).where((F.col("kind") != "INTERIOR") | (F.col("nth") <= most_holes))
    return gaps.select(*SERIES, "start", "end", "bars", "kind")


def plan_history(requests: DataFrame, availability: DataFrame, interval: str, now_ms: int) -> tuple[DataFrame, DataFrame]:
    """Requests cut by what there is (available_from, retained_from, available_to, any null) and by the forming bar; and
    what was cut off, with its reason."""
    rows = requests.join(availability, SERIES, "left")
    last = iv.bucket_floor(F.lit(now_ms), interval) - 1
    lows = [("before_listing", F.col("available_from")), ("not_retained", F.col("retained_from"))]
    highs = [("after_delisting", F.col("available_to")), ("still_forming", last)]
    start, end = F.col("start"), F.col("end")
    cuts = []
    for reason, low in lows:
        cuts.append(F.when(low > start, F.struct(F.lit(reason).alias("reason"), start.alias("start"), F.least(end, low - 1).alias("end"))))
        start = F.greatest(start, low)
    for reason, high in highs:
        cuts.append(F.when(high < end, F.struct(F.lit(reason).alias("reason"), F.greatest(F.col("start"), high + 1).alias("start"), end.alias("end"))))
        end = F.least(end, high)
    kept = rows.select(*SERIES, start.alias("start"), end.alias("end")).where("start <= end")
    gone = rows.select(*SERIES, F.explode(F.array_compact(F.array(*cuts))).alias("x")).select(*SERIES, "x.*").where("start <= end")
    return kept, gone


TASKS = "exchange string, market_type string, symbol string, start bigint, end bigint"


def fetch_tasks(gaps: DataFrame, interval: str, page: int) -> DataFrame:
    """Ranges of at most `page` bars that fill the gaps; neighbours are merged while they still fit one page. The cut at a
    full page depends on the one before, so a series is one ordered pass over its gaps."""
    i = iv.parse_interval(interval)
    width = i.ms * page
    parts = gaps.select(*SERIES, F.explode(F.sequence("start", "end", F.lit(width))).alias("s"), F.col("end").alias("e"))
    parts = parts.select(*SERIES, F.col("s").alias("start"), F.least(F.col("s") + width - i.ms, F.col("e")).alias("end"))

    def merge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list | None = None
        for frame in frames:
            out = []
            for row in frame.itertuples(index=False):
                r = list(row)
                if held and held[:3] == r[:3] and max(held[4], r[4]) - held[3] + i.ms <= width:
                    held[4] = max(held[4], r[4])
                else:
                    if held:
                        out.append(held)
                    held = r
            yield pd.DataFrame(out, columns=[c.split()[0] for c in TASKS.split(", ")])
        if held:
            yield pd.DataFrame([held], columns=[c.split()[0] for c in TASKS.split(", ")])

    return parts.repartition(*SERIES).sortWithinPartitions(*SERIES, "start").mapInPandas(merge, TASKS)


def decompose(interval: str, natives: list[str], greedy: bool = False) -> list[tuple[str, int]]:
    """How to make an interval of native ones: the single native one that fills it with the fewest bars; greedy: as many
    as fit of each, the largest first. Months take days. ValueError if none does."""
    target = iv.parse_interval(interval)
    fits = [n for n in natives if iv.interval_tiles(n, interval)]
    if target.months:
        months = [n for n in fits if iv.parse_interval(n).months]
        if months:
            best = max(months, key=lambda n: iv.parse_interval(n).count)
            return [(best, target.count // iv.parse_interval(best).count)]
        if "1d" in fits:
            return [("1d", target.count * 31)]
        raise ValueError(f"no native interval fills {interval}")
    if greedy:
        left, out = target.ms, []
        for n in sorted((n for n in natives if not iv.parse_interval(n).months), key=lambda n: -iv.parse_interval(n).ms):
            count = left // iv.parse_interval(n).ms
            if count:
                out.append((n, count))
                left -= count * iv.parse_interval(n).ms
        if left:
            raise ValueError(f"native intervals do not add up to {interval}")
        return out
    if not fits:
        raise ValueError(f"no native interval fills {interval}")
    best = max(fits, key=lambda n: iv.parse_interval(n).ms)
    return [(best, math.ceil(target.ms / iv.parse_interval(best).ms))]


CALENDARS: dict[str, SessionCalendar] = {}


def register_calendar(name: str, calendar: SessionCalendar) -> None:
    if name in CALENDARS:
        raise ValueError(f"there is a calendar {name!r}")
    CALENDARS[name] = calendar
