"""Indicators over bars. Warm-up rows are there with a null value. Recursive ones are linear recurrences
y(t) = r y(t-1) + b(t) and run as chunk scans, so that a long series is not one serial loop."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import price_source
from ..schemas import SERIES

CHUNK = 256
TIME = "open_time"


def _w(*more: str) -> Window:
    return Window.partitionBy(*SERIES, *more).orderBy(TIME)


def _rows(n: int):
    return _w().rowsBetween(-(n - 1), 0)


def _full(n: int, value: Column) -> Column:
    return F.when(F.count(F.lit(1)).over(_rows(n)) == n, value)


def ma(bars: DataFrame, n: int, source: str = "close", name: str = "ma") -> DataFrame:
    return bars.withColumn(name, _full(n, F.avg(price_source(source)).over(_rows(n))))


def boll(bars: DataFrame, n: int = 20, k: float = 2.0, source: str = "close") -> DataFrame:
    """Mean and k population deviations on either side; the variance is E[x^2] - E[x]^2, at least 0."""
    x = price_source(source)
    mid = F.avg(x).over(_rows(n))
    width = k * F.sqrt(F.greatest(F.avg(x * x).over(_rows(n)) - mid * mid, F.lit(0.0)))
    return bars.withColumns({"boll_mid": _full(n, mid), "boll_up": _full(n, mid + width), "boll_low": _full(n, mid - width)})


@dataclass(frozen=True)
class Part:
    """A recurrence y(t) = decay * y(t-1) + step(t) that has its seed at row `start` of a series; null before."""

    name: str
    start: int
    decay: float
    step: Column


def _pow(decay: float, n: Column) -> Column:
    return F.pow(F.lit(float(decay)), n.cast("double"))


def scans(rows: DataFrame, index: str, parts: list[Part], seeds: DataFrame, driven: tuple[str, int, float] | None = None) -> DataFrame:
    """Adds a column for each part, and one for driven (name, start, decay): the mean with that decay of the first part
    less the second. seeds: SERIES and a column for each name; a null seed leaves its column null.

    All of them are one linear recurrence, so there is one pass: chunks of rows are reduced to one summary each, the few
    summaries of a stretch of time are folded, then those of a series' stretches, and every chunk finishes with its incoming
    values, all chunks in parallel. Rows come from _indexed, and a chunk lies in one of its stretches, so they stay where the
    numbering put them. They are read for the summaries and for the result, so they are kept until release()."""
    place, w = F.col("place"), _w("stretch", "chunk").rowsBetween(Window.unboundedPreceding, 0)

    def live(start: int) -> Column:
        return F.col(index) > start

    def passed(start: int) -> Column:
        return F.greatest(F.col(index) - F.greatest(F.lit(start), F.col(index) - place - 1), F.lit(0))

    def since(value: Column, start: int, decay: float) -> Column:
        """The recurrence within the chunk as if 0 came in."""
        value = F.when(live(start), value).otherwise(0.0)
        return value if decay == 0 else F.sum(value * _pow(decay, -place)).over(w) * _pow(decay, place)

    nth = F.col(index) - F.col("stretch_begin")
    rows = rows.withColumns({"chunk": F.floor(nth / CHUNK), "place": nth % CHUNK})
    rows = rows.withColumns({f"zero_{i}": since(p.step, p.start, p.decay) for i, p in enumerate(parts)} | {"last": F.max("place").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))})
    rows = _keep(rows)

    last = place == F.col("last")
    names = [p.name for p in parts]
    sums = {f"n{i}": F.max(passed(p.start)) for i, p in enumerate(parts)} | {f"b{i}": F.max(F.when(last, F.col(f"zero_{i}"))) for i in range(len(parts))}
    if driven:
        name, start, decay = driven
        names.append(name)
        late = F.when(live(start), (1 - decay) * _pow(decay, F.col("last") - place)).otherwise(0.0)
        sums |= {"nd": F.max(passed(start)), "bd": F.sum(late * (F.col("zero_0") - F.col("zero_1"))), "c0": F.sum(late * _pow(parts[0].decay, passed(parts[0].start))), "c1": F.sum(late * _pow(parts[1].decay, passed(parts[1].start)))}

    def after(s: Column, c: Column) -> Column:
        """The values s after a stretch of rows c."""
        out = [(_pow(p.decay, c[f"n{i}"]) * s[p.name] + c[f"b{i}"]).alias(p.name) for i, p in enumerate(parts)]
        if driven:
            out.append((_pow(decay, c["nd"]) * s[name] + c["c0"] * s[names[0]] - c["c1"] * s[names[1]] + c["bd"]).alias(name))
        return F.struct(*out)

    def both(s: Column, c: Column) -> Column:
        """One stretch of rows in place of s and c, which follows it."""
        out = [(s[f"n{i}"] + c[f"n{i}"]).alias(f"n{i}") for i in range(len(parts))]
        out += [(_pow(p.decay, c[f"n{i}"]) * s[f"b{i}"] + c[f"b{i}"]).alias(f"b{i}") for i, p in enumerate(parts)]
        if driven:
            out += [(s["nd"] + c["nd"]).alias("nd"), (_pow(decay, c["nd"]) * s["bd"] + c["c0"] * s["b0"] - c["c1"] * s["b1"] + c["bd"]).alias("bd")]
            out += [(_pow(decay, c["nd"]) * s[f"c{i}"] + c[f"c{i}"] * _pow(parts[i].decay, s[f"n{i}"])).alias(f"c{i}") for i in (0, 1)]
        return F.struct(*out)

    def fold(first: list[Column]) -> Column:
        """Every member of the array `chunks` with the values that come into it."""
        begin = F.struct(*[c.cast("double").alias(n) for c, n in zip(first, names)])
        kept = F.struct(F.lit(0).cast("bigint").alias("chunk"), begin.alias("values"))
        return F.aggregate("chunks", F.struct(begin.alias("y"), F.slice(F.array(kept), 1, 0).alias("all")), lambda s, c: F.struct(after(s["y"], c["x"]).alias("y"), F.concat(s["all"], F.array(F.struct(c["chunk"].alias("chunk"), s["y"].alias("values")))).alias("all")), lambda s: s["all"])

    empty = F.struct(*[F.lit(0 if k[0] == "n" else 0.0).cast("bigint" if k[0] == "n" else "double").alias(k) for k in sums])
    summary = rows.groupBy(*SERIES, "stretch", "chunk").agg(*[v.alias(k) for k, v in sums.items()])
    order = lambda x: F.struct(*[x[k].cast("bigint" if k[0] == "n" else "double").alias(k) for k in sums])
    grouped = summary.groupBy(*SERIES, "stretch").agg(F.sort_array(F.collect_list(F.struct("chunk", order({k: F.col(k) for k in sums}).alias("x")))).alias("chunks"))
    tops = grouped.withColumn("x", F.aggregate("chunks", empty, lambda s, c: order(both(s, c["x"]))))
    tops = tops.groupBy(*SERIES).agg(F.sort_array(F.collect_list(F.struct(F.col("stretch").alias("chunk"), "x"))).alias("chunks")).join(seeds, SERIES)
    tops = tops.select(*SERIES, F.explode(fold([F.col(n) for n in names])).alias("e")).select(*SERIES, F.col("e.chunk").alias("stretch"), F.col("e.values").alias("before"))
    incoming = grouped.join(tops, [*SERIES, "stretch"]).select(*SERIES, "stretch", fold([F.col(f"before.{n}") for n in names]).alias("incoming"))
    # joined by stretch, as the rows lie; a stretch's chunks are numbered from 0 without a gap
    rows = rows.join(incoming, [*SERIES, "stretch"], "left").withColumn("incoming", F.get("incoming", F.col("chunk").cast("int"))["values"])
    here = {p.name: F.when(F.col(index) >= p.start, _pow(p.decay, passed(p.start)) * F.col(f"incoming.{p.name}") + F.col(f"zero_{i}")) for i, p in enumerate(parts)}
    rows = rows.withColumns(here)
    if driven:
        value = _pow(decay, passed(start)) * F.col(f"incoming.{name}") + since((1 - decay) * (F.col(names[0]) - F.col(names[1])), start, decay)
        rows = rows.withColumn(name, F.when(F.col(index) >= start, value))
    return rows.drop("stretch", "stretch_begin", "chunk", "place", "last", "incoming", *[f"zero_{i}" for i in range(len(parts))])


def _indexed(bars: DataFrame, index: str = "index", stretch_ms: int = 30 * 86_400_000, before: Column | None = None) -> DataFrame:
    """Numbers each series' rows from 0: within a stretch of time by a window, after the rows of the stretches before, which
    one narrow row per stretch counts. So a long series is numbered by many tasks. Also adds stretch and stretch_begin, the
    number of its first row; and, where before is given, a column before: its value in the row before, which a stretch's first
    row gets from the stretch before it."""
    rows = bars.withColumn("stretch", F.floor(F.col(TIME) / stretch_ms))
    w = Window.partitionBy(*SERIES).orderBy("stretch")
    counts = rows.groupBy(*SERIES, "stretch").agg(F.count("*").alias("n"), *([F.max_by(before, TIME).alias("tail")] if before is not None else []))
    begin = F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    carried = [F.lag("tail").over(w).alias("carried")] if before is not None else []
    rows = rows.join(counts.select(*SERIES, "stretch", begin.alias("stretch_begin"), *carried), [*SERIES, "stretch"])
    nth = F.row_number().over(_w("stretch"))
    added = {index: (nth - 1 + F.col("stretch_begin")).cast("bigint")}
    if before is not None:
        added["before"] = F.when(nth == 1, F.col("carried")).otherwise(F.lag(before).over(_w("stretch")))
    return rows.withColumns(added).drop("carried")


_KEPT: list[DataFrame] = []


def release() -> None:
    """Unpersists the rows that scans have kept; call it once their results are written."""
    while _KEPT:
        _KEPT.pop().unpersist()


def _keep(rows: DataFrame) -> DataFrame:
    """A scan reads its rows for the seeds, the summaries and the result. Spark drops or spills what does not fit, and
    recomputes what is lost."""
    rows = rows.persist()
    _KEPT.append(rows)
    return rows


def _mean_of_first(index: str, first: int, n: int, value: Column, name: str) -> Column:
    """The mean of the n values from row `first`; null where a series has fewer."""
    inside = F.col(index).between(first, first + n - 1)
    return F.when(F.count_if(inside) == n, F.avg(F.when(inside, value))).alias(name)


def _wilder(rows: DataFrame, index: str, first: int, n: int, decay: float, values: dict[str, Column]) -> DataFrame:
    """Each value's mean with the given decay, from the plain mean of the n values from row `first`, at the last of them."""
    head = rows.where(F.col(index) < first + n)
    seeds = head.groupBy(*SERIES).agg(*[_mean_of_first(index, first, n, v, k) for k, v in values.items()])
    return scans(rows, index, [Part(k, first + n - 1, decay, (1 - decay) * v) for k, v in values.items()], seeds)


def ema(bars: DataFrame, n: int, source: str = "close", name: str = "ema") -> DataFrame:
    """Exponential mean with weight 2 / (n + 1), from the simple mean of the first n rows."""
    return _wilder(_indexed(bars), "index", 0, n, 1 - 2 / (n + 1), {name: price_source(source)}).drop("index")


def macd(bars: DataFrame, fast: int = 12, slow: int = 26, signal: int = 9, source: str = "close") -> DataFrame:
    """dif, dea (its exponential mean, from the mean of its own first rows) and hist, twice their difference."""
    rows, x = _indexed(bars), price_source(source)
    both = [Part(k, n - 1, 1 - 2 / (n + 1), 2 / (n + 1) * x) for k, n in (("fast", fast), ("slow", slow))]
    begin = max(fast, slow) - 1
    # dea's seed needs the first rows alone, whose number is given
    head = rows.where(F.col("index") < begin + signal).groupBy(*SERIES).agg(
        _mean_of_first("index", 0, fast, x, "fast"), _mean_of_first("index", 0, slow, x, "slow"), F.sort_array(F.collect_list(F.struct("index", x.cast("double").alias("x")))).alias("rows"))
    seeds = ("fast", fast), ("slow", slow)

    def on(s: Column, r: Column) -> Column:
        now = {k: F.when(r["index"] < n, F.col(k)).otherwise((1 - 2 / (n + 1)) * s[k] + 2 / (n + 1) * F.coalesce(r["x"], F.lit(0.0))) for k, n in seeds}
        return F.struct(*[v.alias(k) for k, v in now.items()], (s["dea"] + F.when(r["index"] >= begin, now["fast"] - now["slow"]).otherwise(0.0)).alias("dea"))

    total = F.aggregate("rows", F.struct("fast", "slow", F.lit(0.0).alias("dea")), on, lambda s: s["dea"])
    head = head.select(*SERIES, "fast", "slow", F.when(F.size("rows") == begin + signal, total / signal).alias("dea"))
    rows = scans(rows, "index", both, head, ("dea", begin + signal - 1, 1 - 2 / (signal + 1)))
    rows = rows.withColumn("dif", F.col("fast") - F.col("slow"))
    hist = 2 * (F.col("dif") - F.col("dea"))
    return rows.withColumns({"hist": hist, "hist_up": hist >= 0}).drop("index", "fast", "slow")


def rsi(bars: DataFrame, n: int = 14, source: str = "close") -> DataFrame:
    """Wilder's: means of the first n changes at row n + 1; 100 where the mean loss is 0."""
    x = price_source(source)
    rows = _indexed(bars, before=x).withColumn("change", x - F.col("before"))
    rows = _wilder(rows, "index", 1, n, 1 - 1 / n, {"gain": F.greatest(F.col("change"), F.lit(0.0)), "loss": F.greatest(-F.col("change"), F.lit(0.0))})
    value = F.when(F.col("loss") == 0, 100.0).otherwise(100 - 100 / (1 + F.col("gain") / F.col("loss")))
    return rows.withColumn("rsi", F.when(F.col("gain").isNotNull(), value)).drop("index", "before", "change", "gain", "loss")


def true_range(bars: DataFrame, name: str = "tr", before: Column | None = None) -> DataFrame:
    """before: the close of the bar before, where the rows have it."""
    before = F.lag("close").over(_w()) if before is None else before
    return bars.withColumn(name, F.when(before.isNull(), F.col("high") - F.col("low")).otherwise(F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))))


def atr(bars: DataFrame, n: int = 14) -> DataFrame:
    """Wilder's mean of the true range, from the mean of its first n values."""
    rows = true_range(_indexed(bars, before=F.col("close")), before=F.col("before"))
    return _wilder(rows, "index", 0, n, 1 - 1 / n, {"atr": F.col("tr")}).drop("index", "before", "tr")


def vol(bars: DataFrame) -> DataFrame:
    return bars.withColumns({"vol": F.col("volume"), "vol_up": F.col("close") >= F.col("open")})


def preview(bars: DataFrame, indicator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The indicator as if the forming bar closed now; rows of forming bars are provisional."""
    return indicator(bars).withColumn("provisional", ~F.col("is_closed"))


REGISTRY: dict[str, Callable[..., DataFrame]] = {"ma": ma, "boll": boll, "ema": ema, "macd": macd, "rsi": rsi, "atr": atr, "vol": vol}
#: Rows that an indicator reads before its first value.
WARM_UP: dict[str, Callable[..., int]] = {"ma": lambda n=20, **_: n - 1, "boll": lambda n=20, **_: n - 1, "ema": lambda n=20, **_: n - 1, "macd": lambda fast=12, slow=26, signal=9, **_: max(fast, slow) + signal - 2, "rsi": lambda n=14, **_: n, "atr": lambda n=14, **_: n - 1, "vol": lambda **_: 0}


def ordered(specs: list[dict]) -> list[dict]:
    """The specs (id, name, params, after: id of the one it reads) in an order in which each follows what it reads; a cycle is an error."""
    left, done, out = {s["id"]: s for s in specs}, set(), []
    while left:
        ready = [k for k, s in left.items() if not s.get("after") or s["after"] in done]
        if not ready:
            raise ValueError("indicators read each other in a cycle, or one that is not there")
        for k in ready:
            out.append(left.pop(k))
            done.add(k)
    return out


def chain(bars: DataFrame, specs: list[dict]) -> DataFrame:
    """Indicators of indicators: one that reads another's output (field) gets it as its close, null as 0.0. Each spec's
    output is named id_field."""
    out, base = bars, bars.columns
    for spec in ordered(specs):
        read = F.coalesce(F.col(f"{spec['after']}_{spec['field']}"), F.lit(0.0)) if spec.get("after") else F.col("close")
        rows = REGISTRY[spec["name"]](out.withColumn("kept_close", F.col("close")).withColumn("close", read), **spec.get("params", {}))
        made = [c for c in rows.columns if c not in out.columns and c != "kept_close"]
        out = rows.withColumn("close", F.col("kept_close")).select(*out.columns, *[F.col(c).alias(f"{spec['id']}_{c}") for c in made])
    return out.select(*base, *[c for c in out.columns if c not in base])


def compute_range(bars: DataFrame, jobs: list[tuple[str, dict]], start_ms: int, end_ms: int, interval_ms: int) -> DataFrame:
    """Several indicators over [start, end] from one read, which begins earlier by the longest warm-up where an
    indicator has a finite one, and at the series' start where it is recursive."""
    recursive = {"ema", "macd", "rsi", "atr"}
    rows = bars.where(F.col(TIME) <= end_ms)
    if not any(name in recursive for name, _ in jobs):
        rows = rows.where(F.col(TIME) >= start_ms - max(WARM_UP[name](**p) for name, p in jobs) * interval_ms)
    for name, params in jobs:
        rows = REGISTRY[name](rows, **params)
    return rows.where(F.col(TIME) >= start_ms)


def sma_query(bars: DataFrame, n: int, start_ms: int, end_ms: int, interval_ms: int) -> DataFrame:
    return compute_range(bars, [("ma", {"n": n})], start_ms, end_ms, interval_ms)


def recompute(existing: DataFrame, bars: DataFrame, dirty: DataFrame, indicator: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """existing with the series that dirty (SERIES, start, end) touches computed anew from bars; others stay as they are."""
    keys = dirty.select(*SERIES).distinct()
    fresh = indicator(bars.join(keys, SERIES, "left_semi"))
    return existing.join(keys, SERIES, "left_anti").unionByName(fresh.select(*existing.columns))


def crosses(bars: DataFrame, left: str, right: str) -> DataFrame:
    """crosses_above and crosses_below: at or beyond before, strictly beyond now."""
    a, b = F.lag(left).over(_w()), F.lag(right).over(_w())
    return bars.withColumns({"crosses_above": F.coalesce((a <= b) & (F.col(left) > F.col(right)), F.lit(False)), "crosses_below": F.coalesce((a >= b) & (F.col(left) < F.col(right)), F.lit(False))})


def pct_change(bars: DataFrame, column: str = "close") -> DataFrame:
    before = F.lag(column).over(_w())
    return bars.withColumn("pct_change", F.when(before != 0, (F.col(column) - before) / F.abs(before) * 100))


def heikin_ashi(bars: DataFrame) -> DataFrame:
    """close: mean of the four prices; open: mean of the bar before's Heikin-Ashi open and close; rows with a null price
    come out null and are passed over. The open is a linear recurrence, so it is a chunk scan too."""
    good = F.col("open").isNotNull() & F.col("high").isNotNull() & F.col("low").isNotNull() & F.col("close").isNotNull()
    rows = _indexed(bars.where(good), before=price_source("ohlc4")).withColumn("ha_close", price_source("ohlc4"))
    seed = rows.where("index = 0").select(*SERIES, ((F.col("open") + F.col("close")) / 2).alias("ha_open"))
    rows = scans(rows, "index", [Part("ha_open", 0, 0.5, F.col("before") * 0.5)], seed)
    rows = rows.select(*SERIES, TIME, "ha_open", F.greatest("high", "ha_open", "ha_close").alias("ha_high"), F.least("low", "ha_open", "ha_close").alias("ha_low"), "ha_close")
    return bars.join(rows, [*SERIES, TIME], "left")
