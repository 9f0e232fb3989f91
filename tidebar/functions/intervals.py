"""Intervals and time buckets. An interval is a number and a unit of s m h d w M; weeks start on Monday, months are
calendar months counted from 1970-01, and everything else is a fixed width from the epoch."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Milliseconds of each fixed unit, and the Monday that weeks count from (1970-01-05).
UNIT_MS = {"s": 1000, "m": 60_000, "h": 3_600_000, "d": 86_400_000, "w": 604_800_000}
MONDAY_MS = 345_600_000
MOST_MONTHS = 12_000
LARGEST_MS = 2**53


@dataclass(frozen=True)
class Interval:
    count: int
    unit: str

    @property
    def months(self) -> bool:
        return self.unit == "M"

    @property
    def ms(self) -> int:
        """Width of a fixed interval."""
        if self.months:
            raise ValueError("a month has no fixed width")
        return self.count * UNIT_MS[self.unit]

    @property
    def origin(self) -> int:
        return MONDAY_MS if self.unit == "w" else 0

    @property
    def name(self) -> str:
        """The largest unit that gives a whole number; days stay days and weeks stay weeks."""
        if self.unit in "Mwd":
            return f"{self.count}{self.unit}"
        seconds = self.ms // 1000
        for unit in "dhm":
            if seconds % (UNIT_MS[unit] // 1000) == 0:
                return f"{seconds * 1000 // UNIT_MS[unit]}{unit}"
        return f"{seconds}s"


def parse_interval(text: str) -> Interval:
    """ValueError for anything but a positive whole number and a unit, or for an overflow."""
    found = re.fullmatch(r"\s*([0-9]{1,15})([smhdwM])\s*", text or "")
    if not found or not int(found[1]):
        raise ValueError(f"not an interval: {text!r}")
    interval = Interval(int(found[1]), found[2])
    if interval.months and interval.count > MOST_MONTHS or not interval.months and interval.ms > LARGEST_MS:
        raise ValueError(f"an interval too long: {text!r}")
    return interval


def _of(interval: str | Interval) -> Interval:
    return interval if isinstance(interval, Interval) else parse_interval(interval)


def canonical_interval(text: Column) -> Column:
    """The column form of parse_interval(...).name; null for what is not an interval."""
    t = F.trim(text)
    valid = t.rlike("^[0-9]{1,15}[smhdwM]$")
    unit, count = F.right(t, F.lit(1)), F.when(valid, F.regexp_extract(t, "^([0-9]+)", 1).cast("bigint"))
    seconds = count * F.when(unit == "s", 1).when(unit == "m", 60).when(unit == "h", 3600)
    short = F.when(seconds % 86_400 == 0, F.concat((seconds / 86_400).cast("bigint"), F.lit("d"))).when(seconds % 3600 == 0, F.concat((seconds / 3600).cast("bigint"), F.lit("h"))).when(seconds % 60 == 0, F.concat((seconds / 60).cast("bigint"), F.lit("m"))).otherwise(F.concat(seconds, F.lit("s")))
    width = count.cast("double") * F.when(unit == "M", 1.0).when(unit == "w", 6.048e8).when(unit == "d", 8.64e7).otherwise(1000.0 * seconds / count)
    fits = F.when(unit == "M", count <= MOST_MONTHS).otherwise(width <= LARGEST_MS)
    return F.when(valid & (count > 0) & fits, F.when(unit.isin("d", "w", "M"), F.concat(count, unit)).otherwise(short))


def intervals_equivalent(a: str, b: str) -> bool:
    """60m is 1h, but 7d is not 1w and 30d is not 1M: their buckets start elsewhere."""
    x, y = _of(a), _of(b)
    if x.months or y.months:
        return x == y
    return x.ms == y.ms and x.origin % x.ms == y.origin % y.ms


def interval_tiles(source: str, target: str) -> bool:
    """Whether buckets of source fill each bucket of target exactly."""
    x, y = _of(source), _of(target)
    if y.months:
        return y.count % x.count == 0 if x.months else x.ms <= UNIT_MS["d"] and UNIT_MS["d"] % x.ms == 0 and x.unit != "w"
    if x.months or y.ms % x.ms:
        return False
    return (y.origin - x.origin) % x.ms == 0


def month_number(ts: Column) -> Column:
    """Whole months since 1970-01."""
    day = F.timestamp_millis(ts)
    return (F.year(day) - 1970) * 12 + F.month(day) - 1


def month_start(number: Column) -> Column:
    year = F.floor(number / 12).cast("int")
    return F.unix_millis(F.make_timestamp(1970 + year, (number - year * 12 + 1).cast("int"), F.lit(1), F.lit(0), F.lit(0), F.lit(0)))


def bucket_floor(ts: Column, interval: str | Interval, origin: int | None = None) -> Column:
    """Start of the bucket that holds ts (ms); origin overrides where fixed buckets count from."""
    i = _of(interval)
    if i.months:
        n = month_number(ts)
        return month_start(n - F.pmod(n, F.lit(i.count)))
    start = i.origin if origin is None else origin
    return ts - F.pmod(ts - F.lit(start), F.lit(i.ms))


def _shift(start: Column, interval: str | Interval, by: int) -> Column:
    i = _of(interval)
    return month_start(month_number(start) + by * i.count) if i.months else start + F.lit(by * i.ms)


def bucket_next(start: Column, interval: str | Interval) -> Column:
    return _shift(start, interval, 1)


def bucket_previous(start: Column, interval: str | Interval) -> Column:
    return _shift(start, interval, -1)


def bucket_close(start: Column, interval: str | Interval) -> Column:
    """The last millisecond of the bucket."""
    return bucket_next(start, interval) - 1


def bucket_end(start: Column, interval: Column) -> Column:
    """bucket_close where each row names its own interval; null where it names none."""
    count, unit = F.regexp_extract(interval, "^([0-9]+)[smhdwM]$", 1).try_cast("bigint"), F.right(interval, F.lit(1))
    width = F.create_map(*[F.lit(x) for pair in UNIT_MS.items() for x in pair])[unit]
    return F.when(unit == "M", month_start(month_number(start) + count)).otherwise(start + count * width) - 1


def buckets_in(start: Column, end: Column, interval: str | Interval) -> Column:
    """How many buckets lie between two starts of buckets, the second left out."""
    i = _of(interval)
    return F.floor((month_number(end) - month_number(start)) / i.count) if i.months else F.floor((end - start) / i.ms)


def is_successor(previous: Column, start: Column, interval: str | Interval) -> Column:
    return start == bucket_next(previous, interval)


def add_months_ms(ts: Column, months: int | Column) -> Column:
    """The same time of day months later; a day that the month lacks becomes its last."""
    day = F.timestamp_millis(ts)
    midnight = F.unix_millis(F.add_months(day, months).cast("timestamp"))
    return midnight + F.pmod(ts, F.lit(UNIT_MS["d"]))


def last_closed_open(now: Column, interval: str | Interval) -> Column:
    """Start of the last bucket that has ended by now."""
    return bucket_previous(bucket_floor(now, interval), interval)


def latest_eligible_open(now: Column, end: Column, interval: str | Interval) -> Column:
    """The last closed bucket that starts no later than the requested end."""
    return F.least(last_closed_open(now, interval), bucket_floor(end, interval))


def buckets_between(ranges: DataFrame, interval: str | Interval, start: str = "start", end: str = "end") -> DataFrame:
    """One row per bucket that starts in [start, end]: adds open_time."""
    i = _of(interval)
    first = bucket_floor(F.col(start), i)
    first = F.when(first < F.col(start), bucket_next(first, i)).otherwise(first)
    if not i.months:
        spread = F.sequence(first, F.col(end), F.lit(i.ms))
    else:
        last = month_number(F.col(end))
        spread = F.transform(F.sequence(month_number(first), last, F.lit(i.count)), month_start)
    return ranges.where(first <= F.col(end)).withColumn("open_time", F.explode(spread))
