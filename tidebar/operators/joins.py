"""Joins of bars with metrics, trades, reference bars, catalogues and rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..schemas import SERIES

#: Width of the stretches in which as-of joins sort: long enough that few rows look beyond their own.
STRETCH = 86_400_000
OHLCV = ["open", "high", "low", "close", "volume"]


def _asof(left: DataFrame, right: DataFrame, keys: list[str], left_time: str, right_time: str, value: str, forward: bool, right_first: bool, stretch_ms: int = STRETCH) -> DataFrame:
    """left with `value`: of the nearest right row at or after (forward) or before it. right_first tells whether a right row
    comes before a left row of the same time.

    The union of both is cut into stretches of time. In a stretch one sort and one running frame find the nearest row;
    what lies in an earlier stretch (forward: a later one) is carried by one narrow row per stretch that has right rows.
    So a long series is many tasks, no frame looks past the current row, and there are no range joins."""
    a = left.withColumns({"as_of": F.col(left_time), "as_side": F.lit(1)})
    b = right.select(*keys, F.col(right_time).alias("as_of"), F.col(value).alias("as_value"), F.lit(0 if right_first else 2).alias("as_side"))
    both = a.unionByName(b, allowMissingColumns=True).withColumn("as_stretch", F.floor(F.col("as_of") / stretch_ms))
    near = [F.desc("as_of"), F.desc("as_side")] if forward else [F.asc("as_of"), F.asc("as_side")]
    running = Window.partitionBy(*keys, "as_stretch").orderBy(*near).rowsBetween(Window.unboundedPreceding, 0)
    rows = both.withColumn("as_value", F.last("as_value", True).over(running)).where("as_side = 1")
    edge = F.min_by if forward else F.max_by
    ends = b.where("as_value is not null").groupBy(*keys, F.floor(F.col("as_of") / stretch_ms).alias("as_stretch")).agg(edge("as_value", "as_of").alias("as_end"))
    wanted = a.select(*keys, F.floor(F.col("as_of") / stretch_ms).alias("as_stretch")).distinct()
    order = Window.partitionBy(*keys).orderBy(F.desc("as_stretch") if forward else F.asc("as_stretch")).rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.join(wanted, [*keys, "as_stretch"], "full_outer").withColumn("as_carried", F.last("as_end", True).over(order)).select(*keys, "as_stretch", "as_carried")
    rows = rows.join(carried, [*keys, "as_stretch"], "left").withColumn("as_value", F.coalesce("as_value", "as_carried"))
    return rows.withColumnRenamed("as_value", value).drop("as_of", "as_side", "as_stretch", "as_carried")


def asof_metric(metric: DataFrame, bars: DataFrame, final_wins: bool = False, time: str = "event_time_ms", value: str = "value") -> DataFrame:
    """Each sample goes to the first bar that opens at or after it, so no bar shows what came later; of several the latest
    counts (or, with final_wins, the latest final one). Bars without a sample have a null value."""
    holders = bars.select(*SERIES, F.col("open_time").alias("bar_time"), "open_time")
    samples = _asof(metric, holders, SERIES, time, "open_time", "bar_time", True, False).where("bar_time is not null")
    order = [F.col("is_final").cast("int"), F.col(time)] if final_wins else [F.col(time)]
    extra = [F.col(c) for c in ("received_at_ms",) if c in metric.columns]
    best = samples.groupBy(*SERIES, F.col("bar_time").alias("open_time")).agg(F.max_by(F.struct(value, F.col(time).alias("sample_time")), F.struct(*order, *extra, value)).alias("x"), F.count("*").alias("samples"))
    best = best.select(*SERIES, "open_time", F.col(f"x.{value}").alias(value), "x.sample_time", "samples")
    return bars.join(best, [*SERIES, "open_time"], "left")


#: Order of funding provenances.
PROVENANCE = {"exchange_settlement": 3, "derived_history": 2, "exchange_realtime": 1}


def asof_funding(funding: DataFrame, bars: DataFrame) -> DataFrame:
    """Funding rates (provenance, sample_time, funding_rate) on bars, in percent: a settlement over a derived rate over a
    live one, then the latest."""
    rank = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in PROVENANCE.items() for x in kv]), F.col("provenance")), F.lit(0))
    holders = bars.select(*SERIES, F.col("open_time").alias("bar_time"), "open_time")
    samples = _asof(funding.withColumn("rank", rank), holders, SERIES, "sample_time", "open_time", "bar_time", True, False).where("bar_time is not null")
    best = samples.groupBy(*SERIES, F.col("bar_time").alias("open_time")).agg(F.max_by(F.struct("funding_rate", "provenance"), F.struct("rank", "sample_time", "funding_rate")).alias("x"), F.bool_or(F.col("provenance") == "exchange_settlement").alias("has_settlement"))
    best = best.select(*SERIES, "open_time", (F.col("x.funding_rate") * 100).alias("funding_pct"), F.col("x.provenance").alias("funding_provenance"), "has_settlement")
    return bars.join(best, [*SERIES, "open_time"], "left")


def liquidations_to_bars(rollups: DataFrame, bars: DataFrame, interval: str, live: DataFrame | None = None) -> DataFrame:
    """Minute rollups (and live events) summed on the bars that hold them; all_rows_final only where there are rows, all
    are final, and none is live."""
    rows = rollups.select(*SERIES, F.col("open_time").alias("t"), "long_notional", "short_notional", "is_final", F.lit(0).alias("live"))
    if live is not None:
        by = lambda s: F.when(F.col("side") == s, F.col("notional")).otherwise(0)
        rows = rows.unionByName(live.select(*SERIES, F.col("trade_time_ms").alias("t"), by("long").alias("long_notional"), by("short").alias("short_notional"), F.lit(False).alias("is_final"), F.lit(1).alias("live")))
    sums = rows.groupBy(*SERIES, iv.bucket_floor(F.col("t"), interval).alias("open_time")).agg(F.sum("long_notional").alias("long_notional"), F.sum("short_notional").alias("short_notional"), (F.bool_and("is_final") & (F.sum("live") == 0)).alias("all_rows_final"))
    return bars.join(sums, [*SERIES, "open_time"], "left").fillna({"all_rows_final": False})


def trades_to_bars_asof(trades: DataFrame, bars: DataFrame, interval: str) -> DataFrame:
    """bar_time of each trade: its own bar if there, else the last bar at most 1.5 intervals before; others go."""
    width = iv.parse_interval(interval).ms
    holders = bars.select(*SERIES, F.col("open_time").alias("bar_time"), "open_time")
    rows = _asof(trades, holders, SERIES, "trade_time_ms", "open_time", "bar_time", False, True)
    return rows.where((F.col("bar_time") == iv.bucket_floor(F.col("trade_time_ms"), interval)) | (F.col("trade_time_ms") - F.col("bar_time") <= 1.5 * width))


def missing_bars(bars: DataFrame, expected: DataFrame) -> DataFrame:
    """expected: SERIES, open_time. Those without a bar."""
    return expected.join(bars.select(*SERIES, "open_time"), [*SERIES, "open_time"], "left_anti")


def compare_bars(a: DataFrame, b: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Per series: rows on one side only, rows on both, and for each field how many differ and by how much at most."""
    x = a.select(*SERIES, "open_time", *[F.col(c).alias(f"a_{c}") for c in OHLCV], F.lit(1).alias("in_a"))
    y = b.select(*SERIES, "open_time", *[F.col(c).alias(f"b_{c}") for c in OHLCV], F.lit(1).alias("in_b"))
    both = x.join(y, [*SERIES, "open_time"], "full_outer")
    shared = F.col("in_a").isNotNull() & F.col("in_b").isNotNull()
    gap = lambda c: F.abs(F.col(f"a_{c}") - F.col(f"b_{c}"))
    per = [x for c in OHLCV for x in (F.count_if(shared & (gap(c) > tolerance)).alias(f"{c}_differs"), F.round(F.max(gap(c)), 8).alias(f"{c}_max_diff"))]
    return both.groupBy(*SERIES).agg(F.count_if(F.col("in_b").isNull()).alias("only_left"), F.count_if(F.col("in_a").isNull()).alias("only_right"), F.count_if(shared).alias("both"), *per)


def bar_parity(actual: DataFrame, reference: DataFrame, with_trades: bool = True) -> DataFrame:
    """Fields that differ beyond max(1e-8, |x| 1e-12), trade counts exactly; and bars on one side alone: one row each."""
    fields = [*OHLCV, "quote_volume", "taker_buy_base", "taker_buy_quote"]
    x = actual.select(*SERIES, "open_time", *[F.col(c).cast("double").alias(f"a_{c}") for c in [*fields, "trades"]], F.lit(1).alias("in_a"))
    y = reference.select(*SERIES, "open_time", *[F.col(c).cast("double").alias(f"b_{c}") for c in [*fields, "trades"]], F.lit(1).alias("in_b"))
    both = x.join(y, [*SERIES, "open_time"], "full_outer")

    def off(c: str):
        a, b = F.col(f"a_{c}"), F.col(f"b_{c}")
        near = a == b if c == "trades" else F.abs(a - b) <= F.greatest(F.lit(1e-8), F.abs(b) * 1e-12)
        return F.when(~F.coalesce(near, a.isNull() & b.isNull()), F.struct(F.lit(c).alias("field"), a.alias("actual"), b.alias("expected")))

    whole = lambda name: F.struct(F.lit(name).alias("field"), F.lit(None).cast("double").alias("actual"), F.lit(None).cast("double").alias("expected"))
    found = F.when(F.col("in_b").isNull(), F.array(whole("only_actual"))).when(F.col("in_a").isNull(), F.array(whole("only_expected"))).otherwise(F.array_compact(F.array(*map(off, [*fields, *(["trades"] if with_trades else [])]))))
    return both.select(*SERIES, "open_time", F.explode(found).alias("x")).select(*SERIES, "open_time", "x.*")


def plan_repair(local: DataFrame, official: DataFrame) -> DataFrame:
    """What to do with each local bar: relabel where the official bar is equal, replace where it differs, unresolved where
    it is missing, not valid (is_valid) or there twice."""
    key = [*SERIES, "open_time"]
    one = official.groupBy(*key).agg(F.count("*").alias("n"), F.first(F.struct(*OHLCV, "is_valid")).alias("o"))
    rows = local.join(one, key, "left")
    same = reduce(lambda p, q: p & q, [F.col(c).eqNullSafe(F.col(f"o.{c}")) for c in OHLCV])
    usable = (F.col("n") == 1) & F.col("o.is_valid")
    return rows.withColumn("action", F.when(~F.coalesce(usable, F.lit(False)), "unresolved").when(same, "relabel").otherwise("replace")).drop("n", "o")


def fanout(series: DataFrame, axis: DataFrame, mode: str = "all") -> DataFrame:
    """A series by time on derived rows (source_time, axis_order): all rows of a time, or its last. Of values of the same
    time the last (by arrival) counts."""
    one = series.groupBy(*SERIES, F.col("time").alias("source_time")).agg(F.max_by("value", "arrival").alias("value"))
    rows = axis
    if mode == "last":
        last = F.row_number().over(Window.partitionBy(*SERIES, "source_time").orderBy(F.desc("axis_order")))
        rows = axis.withColumn("nth", last).where("nth = 1").drop("nth")
    return rows.join(one, [*SERIES, "source_time"])


def daily_open(prices: DataFrame, daily: DataFrame, minutes: DataFrame) -> DataFrame:
    """daily_open of each price: the day bar's open, else the day's first minute's, else the snapshot's own (own_open)."""
    day = lambda c: c - F.pmod(c, F.lit(iv.UNIT_MS["d"]))
    rows = prices.withColumn("day", day(F.col("event_time_ms")))
    d = daily.select(*SERIES, F.col("open_time").alias("day"), F.col("open").alias("day_open"))
    m = minutes.groupBy(*SERIES, day(F.col("open_time")).alias("day")).agg(F.min_by("open", "open_time").alias("minute_open"))
    return rows.join(d, [*SERIES, "day"], "left").join(m, [*SERIES, "day"], "left").withColumn("daily_open", F.coalesce("day_open", "minute_open", "own_open")).drop("day", "day_open", "minute_open")


def alert_candidates(rules: DataFrame, bars: DataFrame, event: str) -> DataFrame:
    """Enabled rules on the bars of their target. A null exchange, market type or interval of a target matches any; a rule
    without a symbol is passed over. The rules are the small side; Spark broadcasts them where their measured size allows."""
    r = rules.where(F.col("enabled") & (F.col("triggerOn") == event)).select(F.col("id").alias("rule_id"), F.col("name").alias("rule_name"), "target", "expression", "cooldownMs", "expiresAt", "maxTriggers")
    parts = {"exchange": "exchange", "marketType": "market_type", "symbol": "symbol", "interval": "interval"}
    same = [F.col(f"target.{t}").isNull() | (F.lower(f"target.{t}") == F.lower(c)) if t != "interval" else F.col("target.interval").isNull() | (F.col("target.interval") == F.col(c)) for t, c in parts.items() if t != "symbol"]
    return bars.join(r, (F.upper("target.symbol") == F.col("symbol")) & reduce(lambda a, b: a & b, same)).drop("target")


def tables_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows that only the left or only the right has, counted with repeats, and whether there are none."""
    b = b.select(*a.columns)
    only = lambda p, q, name: p.exceptAll(q).agg(F.count("*").alias(name))
    return only(a, b, "only_left").crossJoin(only(b, a, "only_right")).withColumn("equal", F.expr("only_left = 0 and only_right = 0"))


def in_watchlist(symbols: DataFrame, watchlist: DataFrame) -> DataFrame:
    return symbols.join(watchlist.select(*SERIES), SERIES, "left_semi")


def missing_keys(requested: DataFrame, latest: DataFrame, keys: list[str]) -> DataFrame:
    return requested.join(latest.select(*keys), keys, "left_anti")


def resolve_routes(requests: DataFrame, capabilities: DataFrame) -> DataFrame:
    """For each requested interval of an exchange: a native interval that is equivalent, else the largest native one that
    fills it exactly, else an error. Intervals are few; the table of how they relate is made here once for each pair."""
    wants = [r[0] for r in requests.select("interval").distinct().collect()]
    have = [r[0] for r in capabilities.select("native").distinct().collect()]

    def relation(want: str, native: str) -> tuple | None:
        try:
            w, n = iv.parse_interval(want), iv.parse_interval(native)
        except ValueError:
            return None
        size = n.count * 30 * iv.UNIT_MS["d"] if n.months else n.ms
        if iv.intervals_equivalent(want, native):
            return want, native, "native", 2**62
        return (want, native, "derived", size) if iv.interval_tiles(native, want) else None

    pairs = [r for w in wants for n in have if (r := relation(w, n))]
    related = requests.sparkSession.createDataFrame(pairs, "interval string, native string, route string, size bigint")
    rows = requests.join(related, "interval", "left").join(capabilities.withColumn("has", F.lit(True)), ["exchange", "native"], "left")
    best = rows.groupBy("exchange", "interval").agg(F.max_by(F.when(F.col("has"), F.struct("route", "native")), F.when(F.col("has"), F.col("size"))).alias("x"))
    return best.select("exchange", "interval", F.coalesce("x.route", F.lit("error")).alias("route"), F.col("x.native").alias("base"))


def merge_catalog(previous: DataFrame, current: DataFrame, now_ms: int) -> DataFrame:
    """Current symbols are active; those that have vanished stay, inactive since they were first missed."""
    p = previous.select(*SERIES, "first_seen", "last_seen", "inactive_since", F.lit(True).alias("was"))
    c = current.select(*SERIES, F.lit(True).alias("now"))
    rows = p.join(c, SERIES, "full_outer")
    here = F.col("now").isNotNull()
    return rows.select(*SERIES, here.alias("active"), F.coalesce("first_seen", F.lit(now_ms)).alias("first_seen"), F.when(here, F.lit(now_ms)).otherwise(F.col("last_seen")).alias("last_seen"), F.when(~here, F.coalesce("inactive_since", F.lit(now_ms))).alias("inactive_since"))


def compare_feeds(a: DataFrame, b: DataFrame, least_shared: int = 1) -> DataFrame:
    """Two feeds (SERIES, channel, sequence, payload_hash) inside the sequences that both span: shared, matching,
    mismatching and one-sided rows, and a verdict with its reason."""
    key = [*SERIES, "channel"]
    span = lambda d, s: d.groupBy(*key).agg(F.min("sequence").alias(f"lo_{s}"), F.max("sequence").alias(f"hi_{s}"))
    bounds = span(a, "a").join(span(b, "b"), key, "full_outer").withColumns({"lo": F.greatest("lo_a", "lo_b"), "hi": F.least("hi_a", "hi_b")})
    bounds = bounds.withColumn("overlap", F.col("lo_a").isNotNull() & F.col("lo_b").isNotNull() & (F.col("lo") <= F.col("hi")))
    inside = lambda d, s: d.select(*key, "sequence", F.col("payload_hash").alias(f"hash_{s}")).dropDuplicates([*key, "sequence"]).join(bounds.where("overlap").select(*key, "lo", "hi"), key).where("sequence between lo and hi").drop("lo", "hi")
    both = inside(a, "a").join(inside(b, "b"), [*key, "sequence"], "full_outer")
    shared = F.col("hash_a").isNotNull() & F.col("hash_b").isNotNull()
    sums = both.groupBy(*key).agg(F.count_if(shared).alias("shared"), F.count_if(shared & (F.col("hash_a") == F.col("hash_b"))).alias("matching"), F.count_if(shared & (F.col("hash_a") != F.col("hash_b"))).alias("mismatching"), F.count_if(F.col("hash_b").isNull()).alias("only_left"), F.count_if(F.col("hash_a").isNull()).alias("only_right"))
    out = bounds.select(*key, "overlap").join(sums, key, "left").fillna(0)
    bad = (F.col("mismatching") > 0) | (F.col("only_left") > 0) | (F.col("only_right") > 0)
    thin = ~F.col("overlap") | (F.col("shared") < least_shared)
    return out.withColumns({"verdict": F.when(thin, "INCONCLUSIVE").when(bad, "FAIL").otherwise("PASS"), "reason": F.when(~F.col("overlap"), "no_overlap").when(thin, "few_shared").when(F.col("mismatching") > 0, "mismatch").when(bad, "one_sided")}).drop("overlap")
