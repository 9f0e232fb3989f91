"""Keyed state: trade flow with gaps, continuity markers, alert limits. Each is a plain step function on one key's state,
used by a stream's keyed state and, over a bounded table, by the batch twin."""

from __future__ import annotations

import json
from bisect import bisect_right
from collections import deque
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import SERIES
from .state import read_map, write_map

MINUTE = 60_000


class TradeFlow:
    """High-water id, open gaps and minute sums of one series. An older trade counts only if its id lies in an open gap and
    its time within the gap; it splits the gap. With more than most_gaps the oldest is given up and its minutes stay
    incomplete. With more than most_minutes the oldest leaves for good, with the gaps and the given-up stretches that end
    by it; so the state is bounded, however long or broken the stream is."""

    def __init__(self, most_gaps: int = 256, most_minutes: int = 1440):
        self.high, self.high_time = None, None
        self.gaps: list[list[int]] = []  # first and last id, time before and after
        self.minutes: dict[int, tuple[float, float, int]] = {}
        self.lost: list[list[int]] = []  # stretches of minutes, first and last
        self.left: list[tuple] = []  # minutes that have left the state since rows() was last asked
        self.first: int | None = None
        self.floor: int | None = None  # the last minute that has left
        self.most_gaps, self.most_minutes = most_gaps, most_minutes

    def bootstrap(self, trades: list[tuple[int, int, float, bool]]) -> None:
        """The head of the first minute (id, time, quantity, sell), read from elsewhere: that minute then counts as seen from its
        start. What the stream does not join on to is a gap like any other."""
        for t in sorted(trades):
            self.take(*t)
        self.first = None

    def add(self, id_: int, time: int, price: float, quantity: float, sell: bool) -> bool:
        return self.take(id_, time, quantity, sell) is not None

    def take(self, id_: int, time: int, quantity: float, sell: bool) -> set[int] | None:
        """The minutes whose sums or completeness the trade changed; None for one that is passed over. Gaps are in order of
        id, so the one that holds an id is found by bisection."""
        touched = {time // MINUTE}
        if self.floor is not None and time // MINUTE <= self.floor:
            return None
        if self.high is None:
            self.first = time // MINUTE if self.first is None else self.first
        elif id_ > self.high + 1:
            self.gaps.append([self.high + 1, id_ - 1, self.high_time, time])
            touched |= self._between(self.high_time, time)
            if len(self.gaps) > self.most_gaps:
                self._give_up()
        elif id_ <= self.high:
            n = bisect_right(self.gaps, id_, key=lambda g: g[0]) - 1
            if n < 0 or id_ > self.gaps[n][1] or not self.gaps[n][2] <= time <= self.gaps[n][3]:
                return None
            lo, hi, a, b = self.gaps[n]
            self.gaps[n : n + 1] = [[lo, id_ - 1, a, time]] * (lo < id_) + [[id_ + 1, hi, time, b]] * (id_ < hi)
            touched |= self._between(a, b)
            if len(self.gaps) > self.most_gaps:
                self._give_up()
        if self.high is None or id_ > self.high:
            self.high, self.high_time = id_, time
        buy, sold, n = self.minutes.get(time // MINUTE, (0.0, 0.0, 0))
        self.minutes[time // MINUTE] = (buy, sold + quantity, n + 1) if sell else (buy + quantity, sold, n + 1)
        while len(self.minutes) > self.most_minutes:
            oldest = min(self.minutes)
            self.left += self._rows([(oldest, self.minutes.pop(oldest))])
            self.floor = oldest if self.floor is None else max(self.floor, oldest)
            self.gaps = [g for g in self.gaps if g[3] // MINUTE > self.floor]
            self.lost = [x for x in self.lost if x[1] > self.floor]
        return touched

    def _give_up(self) -> None:
        _, _, a, b = self.gaps.pop(0)
        lo, hi = a // MINUTE, b // MINUTE
        if self.lost and lo <= self.lost[-1][1] + 1 and hi >= self.lost[-1][0]:
            self.lost[-1] = [min(lo, self.lost[-1][0]), max(hi, self.lost[-1][1])]
        else:
            self.lost.append([lo, hi])

    def _between(self, a: int, b: int) -> set[int]:
        lo, hi = a // MINUTE, b // MINUTE
        return {m for m in range(lo, hi + 1) if m in self.minutes} if hi - lo < len(self.minutes) else {m for m in self.minutes if lo <= m <= hi}

    def incomplete(self, minute: int) -> bool:
        return minute == self.first or any(a <= minute <= b for a, b in self.lost) or any(g[2] // MINUTE <= minute <= g[3] // MINUTE for g in self.gaps)

    def _rows(self, minutes: list[tuple]) -> list[tuple]:
        return [(m * MINUTE, round(v[0], 12), round(v[1], 12), v[2], not self.incomplete(m)) for m, v in minutes]

    def rows(self, only: set[int]) -> list[tuple]:
        """These minutes, and those that left the state since the last call, as they stood then."""
        left, self.left = self.left, []
        return left + self._rows([(m, v) for m, v in sorted(self.minutes.items()) if m in only])


FLOW = "exchange string, market_type string, symbol string, open_time bigint, buy_base double, sell_base double, agg_count bigint, is_complete boolean"
_NAMES = [c.split()[0] for c in FLOW.split(", ")]


def _flow_batch(flow: TradeFlow, frames: Iterator[pd.DataFrame]) -> set[int]:
    touched: set[int] = set()
    for f in frames:
        f = f.sort_values("arrival" if "arrival" in f else "agg_trade_id")
        for row in zip(*(f[c].tolist() for c in ("agg_trade_id", "trade_time_ms", "quantity", "is_buyer_maker"))):
            touched |= flow.take(*row) or set()
    return touched


class FlowProcessor(StatefulProcessor):
    """TradeFlow between batches: minutes, gaps and given-up stretches are maps, of which a batch writes what it changed."""

    def __init__(self, most_gaps: int, most_minutes: int):
        self.bounds = most_gaps, most_minutes

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "high bigint, high_time bigint, first bigint, floor bigint")
        self.minutes = handle.getMapState("minutes", "minute bigint", "buy double, sell double, n bigint")
        self.gaps = handle.getMapState("gaps", "first bigint", "last bigint, since bigint, upto bigint")
        self.lost = handle.getMapState("lost", "first bigint", "last bigint")

    def _load(self) -> TradeFlow:
        flow = TradeFlow(*self.bounds)
        if self.head.exists():
            flow.high, flow.high_time, flow.first, flow.floor = self.head.get()
        self.held = read_map(self.minutes), read_map(self.gaps), read_map(self.lost)
        flow.minutes = dict(self.held[0])
        flow.gaps = [[k, *v] for k, v in sorted(self.held[1].items())]
        flow.lost = [[k, v] for k, v in sorted(self.held[2].items())]
        return flow

    def _save(self, flow: TradeFlow) -> None:
        self.head.update((flow.high, flow.high_time, flow.first, flow.floor))
        write_map(self.minutes, self.held[0], flow.minutes)
        write_map(self.gaps, self.held[1], {g[0]: tuple(g[1:]) for g in flow.gaps})
        write_map(self.lost, self.held[2], {a: b for a, b in flow.lost})

    def handleInitialState(self, key: tuple, initialState: pd.DataFrame, timerValues) -> None:
        flow = self._load()
        flow.bootstrap(list(zip(*(initialState[c].tolist() for c in ("agg_trade_id", "trade_time_ms", "quantity", "is_buyer_maker")))))
        self._save(flow)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        flow = self._load()
        touched = _flow_batch(flow, iter([pd.concat(list(rows))]))
        self._save(flow)
        yield pd.DataFrame([(*key, *r) for r in flow.rows(touched)], columns=_NAMES)


def stream_trade_flow(trades: DataFrame, prefix: DataFrame | None = None, most_gaps: int = 256, most_minutes: int = 1440) -> DataFrame:
    """Minutes whose sums or completeness a batch changed, in update mode; those that leave the state come a last time.

    prefix: a static table of trades that stand before the stream's first, from its minute's start: the initial state.
    Without it a series' first minute is incomplete. The state store must be RocksDB (see session.py)."""
    columns = [*SERIES, "agg_trade_id", "trade_time_ms", "quantity", "is_buyer_maker"]
    begin = None if prefix is None else prefix.select(*columns).groupBy(*SERIES)
    rows = trades.select(*columns, *(["arrival"] if "arrival" in trades.columns else []))
    return rows.groupBy(*SERIES).transformWithStateInPandas(FlowProcessor(most_gaps, most_minutes), FLOW, "update", "None", initialState=begin)


def trade_flow_in_order(trades: DataFrame) -> DataFrame:
    """The batch twin: each series' trades in order of arrival, as partitions sorted by it."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, flow = None, None
        for f in frames:
            for key, part in f.groupby(SERIES, sort=False):
                if key != held:
                    if flow:
                        yield pd.DataFrame([(*held, *r) for r in flow.rows(set(flow.minutes))], columns=_NAMES)
                    held, flow = key, TradeFlow(most_minutes=10**9)
                _flow_batch(flow, iter([part]))
        if flow:
            yield pd.DataFrame([(*held, *r) for r in flow.rows(set(flow.minutes))], columns=_NAMES)

    return trades.repartition(*SERIES).sortWithinPartitions(*SERIES, "arrival").mapInPandas(run, FLOW)


MARKS = "exchange string, market_type string, symbol string, kind string, first_missing bigint, last_missing bigint, at_sequence bigint"


def stream_continuity(events: DataFrame, step: int = 1, remembered: int = 512) -> DataFrame:
    """Gap and repeat markers of a stream by sequence (ids: step 1; bars: the interval). Corrections pass by. A batch's events
    count in the order of `arrival`, however many frames a task gets them in."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        high, seen = state.get if state.exists else (None, "[]")
        recent, out = deque(json.loads(seen), remembered), []
        among = set(recent)
        # a frame is a slice of what the shuffle brought, so the whole batch is put in order; it keeps two numbers a row
        events = pd.concat([f.loc[~f["correction"].astype(bool), ["arrival", "sequence"]] for f in frames])
        for s in events.sort_values("arrival", kind="stable")["sequence"].tolist():
            if s in among:
                out.append((*key, "repeat", None, None, s))
                continue
            if high is not None and s > high + step:
                out.append((*key, "gap", high + step, s - step, s))
            high = s if high is None else max(high, s)
            if len(recent) == remembered:
                among.discard(recent[0])
            recent.append(s)
            among.add(s)
        state.update((high, json.dumps(list(recent))))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in MARKS.split(", ")]).astype({"first_missing": "Int64", "last_missing": "Int64", "at_sequence": "Int64"})

    return events.groupBy(*SERIES).applyInPandasWithState(run, MARKS, "high bigint, seen string", "update", GroupStateTimeout.NoTimeout)


def _opens_passed(marks: DataFrame, opens: DataFrame) -> DataFrame:
    """Marks whose sequences are places in a calendar, with the opens at these places and how many were passed."""
    at = lambda c, name: opens.select(F.col("place").alias(c), F.col("open_time").alias(name))
    marks = marks.withColumn("expected_bars", F.col("last_missing") - F.col("first_missing") + 1)
    for c, name in (("first_missing", "first_open"), ("last_missing", "last_open"), ("at_sequence", "at_open")):
        marks = marks.join(at(c, name), c).drop(c)
    return marks.select(*SERIES, "first_open", "last_open", "at_open", "expected_bars")


def stream_bar_continuity(bars: DataFrame, opens: DataFrame, remembered: int = 512) -> DataFrame:
    """Gaps in a stream of bars (SERIES, open_time, arrival, correction) by a calendar: opens (open_time, place), a static
    table from calendars.numbered_opens, whose places count as sequences. So time for which the calendar is closed is no
    gap. A bar that comes again marks nothing, nor do corrections and bars beside the calendar's opens."""
    placed = bars.select(*SERIES, "open_time", "arrival", "correction").join(opens, "open_time").withColumnRenamed("place", "sequence")
    return _opens_passed(stream_continuity(placed, 1, remembered).where("kind = 'gap'"), opens)


def bar_continuity_in_order(bars: DataFrame, opens: DataFrame) -> DataFrame:
    """The batch twin of stream_bar_continuity."""
    return _opens_passed(continuity_in_order(bars.join(opens, "open_time").withColumnRenamed("place", "sequence")), opens)


def fires(times: list[int], cooldown_ms: int, most: int | None, expires_at: int | None, state: tuple[int | None, int] = (None, 0)) -> tuple[list[int], tuple[int | None, int]]:
    """Which of the times a rule fires at: not before its cooldown has passed, not more than most times, not once expired."""
    last, n = state
    out = []
    for t in sorted(times):
        if (expires_at is not None and t >= expires_at) or (most is not None and n >= most) or (last is not None and t - last < cooldown_ms):
            continue
        last, n = t, n + 1
        out.append(t)
    return out, (last, n)


ALERTS = "rule_id string, exchange string, market_type string, symbol string, triggered_at_ms bigint"


def _limits(part: pd.DataFrame) -> tuple[int, int | None, int | None]:
    first = part.iloc[0]
    whole = lambda v: None if pd.isna(v) else int(v)
    return whole(first["cooldownMs"]) or 0, whole(first["maxTriggers"]), whole(first["expiresAt"])


def stream_alerts(hits: DataFrame) -> DataFrame:
    """Hits of rules (rule_id, SERIES, close_time, cooldownMs, maxTriggers, expiresAt) cut to what fires."""
    from pyspark.sql.streaming.state import GroupStateTimeout

    def run(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        now = (state.get[0], state.get[1]) if state.exists else (None, 0)
        part = pd.concat(list(frames))
        out, now = fires(part["close_time"].tolist(), *_limits(part), now)
        state.update(now)
        yield pd.DataFrame([(*key, t) for t in out], columns=[c.split()[0] for c in ALERTS.split(", ")])

    return hits.groupBy("rule_id", *SERIES).applyInPandasWithState(run, ALERTS, "last bigint, n bigint", "append", GroupStateTimeout.NoTimeout)


def alerts_in_order(hits: DataFrame) -> DataFrame:
    """The batch twin of stream_alerts."""

    def run(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        out, _ = fires(part["close_time"].tolist(), *_limits(part))
        return pd.DataFrame([(*key, t) for t in out], columns=[c.split()[0] for c in ALERTS.split(", ")])

    return hits.select("rule_id", *SERIES, "close_time", "cooldownMs", "maxTriggers", "expiresAt").groupBy("rule_id", *SERIES).applyInPandas(run, ALERTS)


def continuity_in_order(events: DataFrame, step: int = 1) -> DataFrame:
    """The batch twin of stream_continuity for gaps: sequences in order of arrival."""
    from pyspark.sql import Window

    w = Window.partitionBy(*SERIES).orderBy("arrival")
    high = F.max("sequence").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.where(~F.col("correction")).withColumn("high", high).where(F.col("sequence") > F.col("high") + step)
    return rows.select(*SERIES, F.lit("gap").alias("kind"), (F.col("high") + step).alias("first_missing"), (F.col("sequence") - step).alias("last_missing"), F.col("sequence").alias("at_sequence"))
