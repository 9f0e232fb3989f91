"""Charts whose axis is not time. Each is an ordered state machine over closes in ticks, one series at a time; closes
that are null or equal the one before are dropped first, as they change no state. A series' state can be saved and
carried on: the *_steps functions take and give it as plain data, and carry_on() as a table of series and states."""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import to_ticks
from ..schemas import SERIES
from . import indicators

MOST_BRICKS = 10_000
STEPS = "exchange string, market_type string, symbol string, axis_order bigint, source_time bigint, source_ordinal bigint, source_from bigint, direction string, open double, high double, low double, close double, style string"
Emit = tuple[int, int, int, str, int, int, int, int, str | None]


def identity(bars: DataFrame) -> DataFrame:
    return bars.select(*SERIES, F.col("open_time").alias("source_time"), "open", "high", "low", "close")


def renko_steps(closes: Iterator[tuple[int, int]], box: int, state: dict | None = None, ended: bool = True) -> tuple[list[Emit], dict]:
    """A brick for each box that the close goes on; a turn needs two boxes and its first brick starts one box back."""
    s = dict(state or {"last": None, "up": None, "order": 0, "since": None})
    out: list[Emit] = []
    for time, close in closes:
        if s["last"] is None:
            s["last"], s["since"] = close // box * box, time
        n = 0

        def brick(a: int, b: int) -> None:
            nonlocal n
            if n >= MOST_BRICKS:
                raise ValueError("one bar makes too many bricks")
            out.append((s["order"], time, n, "up" if b > a else "down", a, max(a, b), min(a, b), b, s["since"]))
            s.update(last=b, up=b > a, order=s["order"] + 1, since=time)
            n += 1

        for sign in (1, -1):
            against = s["up"] is not None and s["up"] != (sign > 0)
            if sign * (close - s["last"]) >= (2 if against else 1) * box:
                if against:
                    brick(s["last"] + sign * box, s["last"] + 2 * sign * box)
                while sign * (close - s["last"]) >= box:
                    brick(s["last"], s["last"] + sign * box)
                break
    return out, s


def line_break_steps(closes: Iterator[tuple[int, int]], lines: int, state: dict | None = None, ended: bool = True) -> tuple[list[Emit], dict]:
    """A line where the close leaves the range of the last lines; it opens at the last line's end on that side."""
    s = dict(state or {"anchor": None, "since": None, "lines": [], "order": 0})
    s["lines"] = list(s["lines"])
    out: list[Emit] = []
    for time, close in closes:
        if s["anchor"] is None:
            s["anchor"], s["since"] = close, time
            continue
        if s["lines"]:
            top, bottom = max(x[1] for x in s["lines"]), min(x[0] for x in s["lines"])
            if bottom <= close <= top:
                continue
            start = s["lines"][-1][1] if close > top else s["lines"][-1][0]
            since = s["lines"][-1][2]
        elif close == s["anchor"]:
            continue
        else:
            start, since = s["anchor"], s["since"]
        out.append((s["order"], time, 0, "up" if close > start else "down", start, max(start, close), min(start, close), close, since))
        s["lines"] = [*s["lines"], (min(start, close), max(start, close), time)][-lines:]
        s["order"] += 1
    return out, s


def kagi_steps(closes: Iterator[tuple[int, int]], reversal: int, state: dict | None = None, ended: bool = True) -> tuple[list[tuple], dict]:
    """Legs that go on with the trend and turn by the reversal. A leg turns yang above the last shoulder, yin below the
    last waist. The last leg may still grow; it is given only where the closes have ended."""
    s = dict(state or {"anchor": None, "since": None, "up": None, "start": 0, "end": 0, "to": None, "from": None, "style": "yin", "first_style": "yin", "shoulder": None, "waist": None, "order": -1})
    legs: list[tuple] = []

    def tail() -> None:
        first, style = s["first_style"], s["first_style"]
        if s["up"] and first == "yin" and s["shoulder"] is not None and s["end"] > s["shoulder"]:
            style = "yang"
        if not s["up"] and first == "yang" and s["waist"] is not None and s["end"] < s["waist"]:
            style = "yin"
        s["style"] = style

    def leg() -> tuple:
        styles = s["first_style"] if s["first_style"] == s["style"] else f"{s['first_style']}>{s['style']}@{s['shoulder'] if s['up'] else s['waist']}"
        return (s["order"], s["to"], 0, "up" if s["up"] else "down", s["start"], max(s["start"], s["end"]), min(s["start"], s["end"]), s["end"], s["from"], styles)

    for time, close in closes:
        if s["anchor"] is None:
            s.update(anchor=close, since=time)
            continue
        if s["up"] is None:
            if abs(close - s["anchor"]) < reversal:
                continue
            s.update(up=close > s["anchor"], start=s["anchor"], end=close, to=time, order=0)
            s["from"] = s["since"]
            s["first_style"] = s["style"]
            tail()
            continue
        gone = (close - s["end"]) * (1 if s["up"] else -1)
        if gone > 0:
            s.update(end=close, to=time)
            tail()
        elif -gone >= reversal:
            legs.append(leg())
            turn = s["end"]
            s["shoulder" if s["up"] else "waist"] = turn
            s["from"] = s["to"]
            s.update(up=not s["up"], start=turn, end=close, to=time, order=s["order"] + 1, first_style=s["style"])
            tail()
    if s["up"] is not None and ended:
        legs.append(leg())
    return legs, s


def point_figure_steps(closes: Iterator[tuple[int, int]], box: int, reversal: int, state: dict | None = None, ended: bool = True) -> tuple[list[Emit], dict]:
    """Columns of X (up) and O (down) boxes; a new column starts one box off the last. The last column may still grow; it is
    given only where the closes have ended."""
    s = dict(state or {"anchor": None, "since": None, "up": None, "low": 0, "high": 0, "from": None, "to": None, "order": -1})
    out: list[Emit] = []
    column = lambda: (s["order"], s["to"], 0, "x" if s["up"] else "o", s["low"] if s["up"] else s["high"], s["high"], s["low"], s["high"] if s["up"] else s["low"], s["from"])
    for time, close in closes:
        if s["anchor"] is None:
            s.update(anchor=close // box * box, since=time)
            continue
        edge = s["anchor"] if s["up"] is None else s["high"] if s["up"] else s["low"]
        for sign in (1, -1):
            boxes = sign * (close - edge) // box
            same = s["up"] is not None and s["up"] == (sign > 0)
            if boxes < (1 if same or s["up"] is None else reversal):
                continue
            far = edge + sign * boxes * box
            if same:
                s.update({"high" if sign > 0 else "low": far, "to": time})
            else:
                if s["up"] is not None:
                    out.append(column())
                near = edge + sign * box
                s.update({"from": s["since"] if s["up"] is None else s["to"]})
                s.update(up=sign > 0, low=min(near, far), high=max(near, far), to=time, order=s["order"] + 1)
            break
    if s["up"] is not None and ended:
        out.append(column())
    return out, s


_COLUMNS = [c.split()[0] for c in STEPS.split(", ")]
CHARTS: dict[str, Callable] = {"renko": renko_steps, "line_break": line_break_steps, "kagi": kagi_steps, "point_figure": point_figure_steps}


def _project(bars: DataFrame, sizes: DataFrame, steps: Callable, states: DataFrame | None = None, every_ms: int | None = None) -> DataFrame:
    """STEPS, growing and state: the steps of every series, and at its end a row that has its state alone (a JSON text). sizes:
    SERIES, tick and size (in ticks); states: SERIES and state, where a series carries on; every_ms: also a row with the state
    after the last bar of each stretch of time, whose end is its source_time. growing: the series' last leg or column, which
    later bars may still change.

    Series are sorted in the shuffle and read as a stream of batches, so a task holds one batch and one state however long
    a series is."""
    rows = bars.where(F.col("close").isNotNull() & ~F.isnan("close")).join(sizes, SERIES)
    rows = rows.select(*SERIES, "open_time", to_ticks(F.col("close"), F.col("tick")).alias("ticks"), "tick", "size")
    before = F.lag("ticks").over(Window.partitionBy(*SERIES).orderBy("open_time"))
    rows = rows.withColumn("before", before).where(F.col("before").isNull() | (F.col("before") != F.col("ticks"))).drop("before")
    rows = rows.join(states.select(*SERIES, "state"), SERIES, "left") if states is not None else rows.withColumn("state", F.lit(None).cast("string"))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, state, tick, size, stretch = None, None, 1.0, 1, None

        def table(made: list, states: list[tuple[int | None, str]], growing: bool = False) -> pd.DataFrame:
            price = lambda t: round(t * tick, 12)
            out = [(*held, o, t, n, since, d, *map(price, (a, hi, lo, c)), *(style or (None,)), growing, None) for o, t, n, d, a, hi, lo, c, since, *style in made]
            out += [(*held, None, time, *[None] * (len(_COLUMNS) - 5), None, text) for time, text in states]
            return pd.DataFrame(out, columns=[*_COLUMNS, "growing", "state"]).astype({c: "Int64" for c in ("axis_order", "source_time", "source_ordinal", "source_from")} | {"growing": "boolean"})

        def end() -> pd.DataFrame:
            made, last = steps(iter(()), size, state, True)
            return table(made, [(stretch, json.dumps(state))] * (stretch is not None) + [(None, json.dumps(last))], True)

        for frame in frames:
            for key, part in frame.groupby(SERIES, sort=False):
                if key != held:
                    if held:
                        yield end()
                    held, tick, size = key, float(part["tick"].iloc[0]), int(part["size"].iloc[0])
                    saved = part["state"].iloc[0]
                    state, stretch = json.loads(saved) if isinstance(saved, str) else None, None
                if every_ms is None:
                    made, state = steps(zip(part["open_time"].tolist(), part["ticks"].tolist()), size, state, False)
                    yield table(made, [])
                    continue
                made, logged = [], []
                for upto, piece in part.groupby(part["open_time"] // every_ms * every_ms + every_ms):
                    if stretch not in (None, upto):
                        logged.append((stretch, json.dumps(state)))
                    more, state = steps(zip(piece["open_time"].tolist(), piece["ticks"].tolist()), size, state, False)
                    made, stretch = made + more, int(upto)
                yield table(made, logged)
        if held:
            yield end()

    return rows.repartition(*SERIES).sortWithinPartitions(*SERIES, "open_time").mapInPandas(run, f"{STEPS}, growing boolean, state string")


def carry_on(chart: str, bars: DataFrame, sizes: DataFrame, states: DataFrame | None = None, **options) -> tuple[DataFrame, DataFrame]:
    """(steps, states) of a chart in CHARTS over bars that follow those of the given states; without states, from the start.
    A leg or column that was still growing comes again, grown. options: reversal of point_figure."""
    steps = lambda closes, size, state, ended: CHARTS[chart](closes, size, *options.values(), state=state, ended=ended)
    both = _project(bars, sizes, steps, states)
    return both.where("state is null").drop("growing", "state"), both.where("state is not null").select(*SERIES, "state")


def with_checkpoints(chart: str, bars: DataFrame, sizes: DataFrame, every_ms: int, **options) -> tuple[DataFrame, DataFrame]:
    """(steps, log) of a chart in CHARTS from the start. Steps have growing: whether later bars may still change the step. log
    (SERIES, through, state): the state after the bars before `through`, the end of each stretch of every_ms that has bars
    which change a close. Both are to be written once, as every use of them goes through the bars."""
    return _logged(chart, bars, sizes, None, every_ms, options)


def _logged(chart: str, bars: DataFrame, sizes: DataFrame, states: DataFrame | None, every_ms: int, options: dict) -> tuple[DataFrame, DataFrame]:
    steps = lambda closes, size, state, ended: CHARTS[chart](closes, size, *options.values(), state=state, ended=ended)
    both = _project(bars, sizes, steps, states, every_ms)
    return both.where("state is null").drop("state"), both.where("state is not null and source_time is not null").select(*SERIES, F.col("source_time").alias("through"), "state")


def after_corrections(chart: str, bars: DataFrame, sizes: DataFrame, steps: DataFrame, log: DataFrame, corrected: DataFrame, every_ms: int, **options) -> tuple[DataFrame, DataFrame]:
    """(steps, log) anew, from those of with_checkpoints and the bars as they are after some of them, given as corrected (SERIES,
    open_time), were amended, added or deleted. A series goes on from its last state before its first correction, so only its
    bars from there are read; one without such a state is made anew, and one without a correction is left as it is. The
    sizes must be those of the steps. As with_checkpoints, for one write; never over the tables that are read."""
    first = corrected.groupBy(*SERIES).agg(F.min("open_time").alias("first"))
    held = log.join(first, SERIES).where("through <= first").groupBy(*SERIES).agg(F.max("through").alias("begin"), F.max_by("state", "through").alias("state"))
    from_ = first.select(*SERIES).join(held, SERIES, "left").select(*SERIES, F.coalesce("begin", F.lit(-(2**62))).alias("begin"), "state")
    least = from_.agg(F.min("begin")).first()[0]
    # one number, so that the scan skips what is before every series' beginning
    tail = bars.where(F.col("open_time") >= F.lit(least)) if least is not None else bars.limit(0)
    tail = tail.join(from_.select(*SERIES, "begin"), SERIES).where("open_time >= begin").drop("begin")
    new_steps, new_log = _logged(chart, tail, sizes, from_.where("state is not null"), every_ms, options)
    order = F.coalesce(F.get_json_object("state", "$.order").cast("bigint"), F.lit(0))
    cut = from_.select(*SERIES, "begin", order.alias("order"))
    # a series all of whose bars after the state are gone still has the leg that the state grows
    bare = from_.where("state is not null").join(tail.select(*SERIES).distinct(), SERIES, "left_anti")
    last = _ends(chart, bare.join(sizes, SERIES), options)
    kept = steps.join(cut, SERIES, "left").where("order is null or axis_order < order").drop("begin", "order")
    kept_log = log.join(cut, SERIES, "left").where("begin is null or through <= begin").drop("begin", "order")
    return kept.unionByName(new_steps).unionByName(last), kept_log.unionByName(new_log)


def _ends(chart: str, states: DataFrame, options: dict) -> DataFrame:
    """The growing legs of states (SERIES, state, tick, size) that no bar follows."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out = []
            for r in frame.itertuples():
                made, _ = CHARTS[chart](iter(()), int(r.size), *options.values(), state=json.loads(r.state), ended=True)
                out += [(r.exchange, r.market_type, r.symbol, o, t, n, since, d, *(round(x * r.tick, 12) for x in (a, hi, lo, c)), *(style or (None,)), True) for o, t, n, d, a, hi, lo, c, since, *style in made]
            yield pd.DataFrame(out, columns=[*_COLUMNS, "growing"])

    return states.select(*SERIES, "state", "tick", "size").mapInPandas(run, f"{STEPS}, growing boolean")


def renko(bars: DataFrame, sizes: DataFrame) -> DataFrame:
    return carry_on("renko", bars, sizes)[0]


def line_break(bars: DataFrame, ticks: DataFrame, lines: int = 3) -> DataFrame:
    return carry_on("line_break", bars, ticks.withColumn("size", F.lit(lines)))[0]


def kagi(bars: DataFrame, sizes: DataFrame) -> DataFrame:
    return carry_on("kagi", bars, sizes)[0]


def point_figure(bars: DataFrame, sizes: DataFrame, reversal: int = 3) -> DataFrame:
    return carry_on("point_figure", bars, sizes, reversal=reversal)[0]


def box_size(bars: DataFrame, tick: float, length: int = 14) -> DataFrame:
    """SERIES, tick, size: the series' last ATR in ticks, from the mean of the first min(length, rows) true ranges;
    0.5 % of the last close where it is none; at least one tick."""
    counts = bars.groupBy(*SERIES).agg(F.count("*").alias("rows"), F.max_by("close", "open_time").alias("last_close"))
    rows = indicators._indexed(indicators.true_range(bars)).join(counts, SERIES)
    n = F.least(F.lit(length), F.col("rows"))
    seed = rows.where(F.col("index") < n).groupBy(*SERIES).agg(F.avg("tr").alias("seed"), F.max("index").alias("first"))
    decay = 1 - 1 / length
    rows = rows.join(seed, SERIES).where(F.col("index") >= F.col("first"))
    age = F.col("rows") - 1 - F.col("index")
    part = F.when(F.col("index") > F.col("first"), F.pow(F.lit(decay), age.cast("double")) * F.col("tr") / length).otherwise(F.pow(F.lit(decay), age.cast("double")) * F.col("seed"))
    out = rows.groupBy(*SERIES).agg(F.sum(part).alias("atr"), F.first("last_close").alias("last_close"))
    value = F.when(F.col("atr") > 0, F.col("atr")).otherwise(F.col("last_close") * 0.005)
    return out.select(*SERIES, F.lit(tick).alias("tick"), F.greatest(F.lit(1), to_ticks(value, tick)).alias("size"))


def fixed_size(bars: DataFrame, tick: float, price: float) -> DataFrame:
    return bars.select(*SERIES).distinct().select(*SERIES, F.lit(tick).alias("tick"), F.lit(max(1, math.floor(price / tick + 0.5))).cast("bigint").alias("size"))
