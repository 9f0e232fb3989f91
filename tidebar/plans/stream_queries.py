"""Queries that run streams over the given tables, or what their batches do, each with a SQL twin of what they come to."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from ..operators import book, calendars
from ..operators.bars import bars_from_trades
from ..schemas import EVENTS, SERIES
from ..session import work_dir
from ..streaming import alerting, books, keyed
from ..streaming import bars as sb
from .bar_queries import ORACLES as BAR_ORACLES
from .chart_queries import ORACLES as CHART_ORACLES
from .chart_queries import numbered_deltas
from .market_queries import ENVELOPES, LIQ, envelopes_of, liquidations_of, new_york_opens
from .market_queries import ORACLES as MARKET_ORACLES
from .tables import DAY, HOUR, HOURLY, TRADES, bar_table, bars_sql, ms, read, trades, trades_of

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def arriving(rows: DataFrame, order: Column, path: str, parts: int = 3) -> Iterator[DataFrame]:
    """A stream of the rows, once for each of so many stretches of `order`, as their files arrive: whoever runs each to its end
    on one checkpoint takes the table in as many batches and carries its state from one run to the next."""
    low, high = rows.agg(F.min(order), F.max(order)).first()
    width = (high - low) / parts if low is not None else 0
    stretch = F.least(F.floor((order - low) / width), F.lit(parts - 1)) if width else F.lit(0)
    for n in range(parts):
        rows.where(stretch == n).write.mode("append").parquet(path)
        yield rows.sparkSession.readStream.schema(rows.schema).parquet(path)


@contextmanager
def keyed_state(spark: SparkSession) -> Iterator[None]:
    """Settings for the streams started within: the state store that keyed state needs, and no more parts of the state, each
    with a worker of its own in every batch, than there are cores."""
    wanted = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": str(min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))))}
    before = {name: spark.conf.get(name, None) for name in wanted}
    for name, value in wanted.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)


def replayed(rows: DataFrame, order: Column, make: Callable[[DataFrame], DataFrame], mode: str, each=lambda batch: batch, parts: int = 3) -> DataFrame:
    """What the stream that make builds writes as the rows arrive in parts, with the number of the batch. each: done to every batch."""
    spark = rows.sparkSession
    path = work_dir(spark)
    shapes = []

    def put(batch: DataFrame, n: int) -> None:
        out = each(batch)
        shapes[:] = [out.schema.add("batch", LongType())]
        out.write.mode("overwrite").parquet(f"{path}/out/batch={n}")

    with keyed_state(spark):
        for stream in arriving(rows, order, f"{path}/in", parts):
            make(stream).writeStream.outputMode(mode).option("checkpointLocation", f"{path}/checkpoint").foreachBatch(put).trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(shapes[0]).parquet(f"{path}/out")


def written(spark: SparkSession, sf: str, make: Callable[[DataFrame], DataFrame], mode: str, each=lambda batch: batch) -> DataFrame:
    """replayed, for trades from the given events."""
    return replayed(read(spark, sf, "events"), ms("ts"), lambda events: make(trades_of(events)), mode, each)


def latest(rows: DataFrame, keys: list[str]) -> DataFrame:
    """The last state of each key that an updating stream wrote."""
    rest = [c for c in rows.columns if c not in [*keys, "batch"]]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("x")).select(*keys, "x.*")


OUT = "symbol, open_time, open, high, low, close, volume, taker_buy_base"


@query("str1_final_bars", f"WITH {HOURLY} SELECT {OUT} FROM bars WHERE open_time + {HOUR} <= (SELECT max(trade_time_ms) FROM trades) - 60000")
def str1_final_bars(spark, sf):
    """Bars that the watermark has closed."""
    return written(spark, sf, lambda t: sb.stream_bars(t, "1h"), "append").select(*OUT.split(", "))


@query("str3_finality", f"WITH {HOURLY}, l AS (SELECT *, max(open_time) OVER (PARTITION BY symbol) AS newest FROM bars) SELECT symbol, open_time, close, open_time < newest AS by_next, open_time + {HOUR} + 5000 <= {{now}} AS by_timeout, TRUE AS by_end, open_time // {HOUR} % 2 = 0 AS by_flag, open_time // {HOUR} % 3 = 0 AS by_coverage FROM l".replace("{now}", "(SELECT max(open_time) FROM bars)"))
def str3_finality(spark, sf):
    """Forming bars of an updating stream, and each rule that makes them final."""
    rows = latest(written(spark, sf, lambda t: sb.stream_bars(t, "1h"), "update"), [*SERIES, "open_time"])
    hour = (F.col("open_time") / HOUR).cast("bigint")
    rows = rows.withColumns({"source_closed": (hour % 2 == 0).cast("string"), "closed_parts": F.when(hour % 3 == 0, 4).otherwise(3)})
    now = rows.agg(F.max("open_time")).first()[0]
    for mode in ("next", "timeout", "end", "flag", "coverage"):
        rows = sb.with_finality(rows, mode, "1h", now, 4).withColumnRenamed("is_closed", f"by_{mode}")
    return rows.select("symbol", "open_time", "close", *[f"by_{m}" for m in ("next", "timeout", "end", "flag", "coverage")])


WEEK = 604_800_000


@query("str2_weeks", f"WITH {TRADES}, {bars_sql(f'345600000 + (trade_time_ms - 345600000) // {WEEK} * {WEEK}')} SELECT symbol, open_time, open, close, volume FROM bars")
def str2_weeks(spark, sf):
    return latest(written(spark, sf, lambda t: sb.stream_bars(t, "1w"), "update"), [*SERIES, "open_time"]).select("symbol", "open_time", "open", "close", "volume")


@query("str2_months", BAR_ORACLES["agg4_resample_month"])
def str2_months(spark, sf):
    """Daily bars of a stream, rolled up by month."""
    daily = latest(written(spark, sf, lambda t: sb.stream_bars(t, "1d"), "update"), [*SERIES, "open_time"])
    daily = daily.withColumns({"is_closed": F.lit(True), "taker_buy_quote": F.lit(None).cast("double")})
    return sb.roll_months(daily, 4_000_000_000_000).select("symbol", "open_time", "open", "close", "volume", "trades", "is_closed")


@query("str4_stream_flow", f"WITH {TRADES} SELECT symbol, trade_time_ms // 60000 * 60000 AS open_time, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END), 8) AS buy_base, round(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 8) AS sell_base, count(*) AS agg_count FROM trades GROUP BY ALL")
def str4_stream_flow(spark, sf):
    rows = latest(written(spark, sf, keyed.stream_trade_flow, "update"), [*SERIES, "open_time"])
    return rows.select("symbol", "open_time", F.round("buy_base", 8).alias("buy_base"), F.round("sell_base", 8).alias("sell_base"), "agg_count")


@query("str4_late_trades", f"""WITH {TRADES}, n AS (SELECT symbol, agg_trade_id, trade_time_ms, quantity, is_buyer_maker, row_number() OVER (PARTITION BY symbol ORDER BY trade_time_ms, agg_trade_id) AS id FROM trades)
    SELECT symbol, trade_time_ms // 60000 * 60000 AS open_time, round(sum(quantity), 8) AS base, count(*) AS agg_count, min(trade_time_ms) // 60000 > first(first_minute) AS is_complete FROM (SELECT *, min(trade_time_ms) FILTER (id % 5 <> 2) OVER (PARTITION BY symbol) // 60000 AS first_minute FROM n) GROUP BY ALL""")
def str4_late_trades(spark, sf):
    """One trade in five comes two places late, and fills the gap that it left."""
    w = Window.partitionBy(*SERIES).orderBy("trade_time_ms", "agg_trade_id")
    rows = trades_of(read(spark, sf, "events")).withColumn("id", F.row_number().over(w))
    rows = rows.withColumns({"agg_trade_id": F.col("id").cast("bigint"), "arrival": F.col("id") * 2 + F.when(F.col("id") % 5 == 2, 5).otherwise(0)})
    out = keyed.trade_flow_in_order(rows)
    return out.select("symbol", "open_time", F.round(F.col("buy_base") + F.col("sell_base"), 8).alias("base"), "agg_count", "is_complete")


@query("str6_bootstrap", f"""WITH {TRADES}, n AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY trade_time_ms, agg_trade_id) AS id, count(*) OVER (PARTITION BY symbol) AS total FROM trades), c AS (SELECT symbol, max(trade_time_ms) FILTER (id <= total // 4) AS cut FROM n GROUP BY symbol), s AS (SELECT symbol, trade_time_ms // 60000 AS m, quantity, id % 40 = 0 AS lost, trade_time_ms > cut AS live, trade_time_ms, cut FROM n JOIN c USING (symbol)),
    e AS (SELECT symbol, m, lag(CASE WHEN NOT lost THEN m END IGNORE NULLS) OVER w AS before, lead(CASE WHEN NOT lost THEN m END IGNORE NULLS) OVER w AS after, lost FROM (SELECT symbol, m, lost, trade_time_ms FROM s WHERE live OR m >= cut // 60000) WINDOW w AS (PARTITION BY symbol ORDER BY trade_time_ms)), h AS (SELECT symbol, before, after FROM e WHERE lost)
    SELECT symbol, m * 60000 AS open_time, round(sum(quantity), 8) AS base, count(*) AS agg_count, NOT EXISTS (SELECT 1 FROM h WHERE h.symbol = v.symbol AND v.m BETWEEN h.before AND h.after) AS is_complete FROM (SELECT * FROM s WHERE NOT lost AND (live OR m >= cut // 60000)) v GROUP BY symbol, m HAVING max(live::int) = 1""")
def str6_bootstrap(spark, sf):
    """A stream that begins in the middle of a minute, whose head comes from a static table; one trade in forty is lost. The first
    minute is complete unless a trade of it is lost."""
    w = Window.partitionBy(*SERIES).orderBy("trade_time_ms", "agg_trade_id")
    rows = trades_of(read(spark, sf, "events")).withColumns({"id": F.row_number().over(w).cast("bigint"), "total": F.count("*").over(Window.partitionBy(*SERIES))})
    cut = rows.groupBy(*SERIES).agg(F.max(F.when(F.col("id") <= F.floor(F.col("total") / 4), F.col("trade_time_ms"))).alias("cut"))
    rows = rows.join(cut, SERIES).where("id % 40 <> 0").withColumn("agg_trade_id", F.col("id"))
    head = rows.where((F.col("trade_time_ms") <= F.col("cut")) & (F.floor(F.col("trade_time_ms") / 60_000) >= F.floor(F.col("cut") / 60_000)))
    live = rows.where(F.col("trade_time_ms") > F.col("cut")).select(*SERIES, "agg_trade_id", "trade_time_ms", "quantity", "is_buyer_maker")
    out = latest(replayed(live, F.col("trade_time_ms"), lambda t: keyed.stream_trade_flow(t, head, most_minutes=100_000), "update"), [*SERIES, "open_time"])
    return out.select("symbol", "open_time", F.round(F.col("buy_base") + F.col("sell_base"), 8).alias("base"), "agg_count", "is_complete")


@query("str7_liquidation_minutes", f"WITH {LIQ} SELECT symbol, open_time, CAST(long_n AS DOUBLE) AS long_notional, CAST(short_n AS DOUBLE) AS short_notional, n FROM liq JOIN (SELECT symbol, trade_time_ms // 60000 * 60000 AS open_time, count(*) AS n FROM trades GROUP BY ALL) USING (symbol, open_time)")
def str7_liquidation_minutes(spark, sf):
    twice = lambda events: events.union(events)
    rows = latest(written(spark, sf, lambda t: sb.stream_liquidations(twice(liquidations_of(t))), "update"), [*SERIES, "open_time"])
    return rows.select("symbol", "open_time", F.col("long_notional").cast("double").alias("long_notional"), F.col("short_notional").cast("double").alias("short_notional"), "n")


@query("str8_stream_continuity", f"WITH {TRADES}, x AS (SELECT *, lag(agg_trade_id) OVER (PARTITION BY symbol ORDER BY agg_trade_id) AS h FROM trades WHERE agg_trade_id % 11 <> 0) SELECT symbol, 'gap' AS kind, h + 1 AS first_missing, agg_trade_id - 1 AS last_missing, agg_trade_id AS at_sequence FROM x WHERE agg_trade_id > h + 1")
def str8_stream_continuity(spark, sf):
    """Trades arrive in the order of their ids; those whose id is divisible by 11 come as corrections, which mark nothing."""
    marked = lambda t: t.withColumns({"sequence": F.col("agg_trade_id"), "arrival": F.col("agg_trade_id"), "correction": F.col("agg_trade_id") % 11 == 0})
    out = replayed(read(spark, sf, "events"), F.col("event_id"), lambda events: keyed.stream_continuity(marked(trades_of(events))), "update")
    return out.select("symbol", "kind", "first_missing", "last_missing", "at_sequence")


@query("str8_stream_bar_continuity", MARKET_ORACLES["str8_bar_continuity"])
def str8_stream_bar_continuity(spark, sf):
    """Half-hourly bars as they arrive, each a second time after a correction, against New York's sessions."""
    rows = bars_from_trades(trades(spark, sf), "30m")
    opens = calendars.numbered_opens(new_york_opens(spark, rows))
    again = rows.select(*SERIES, "open_time", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("nth"))
    arrived = again.select(*SERIES, "open_time", (F.col("open_time") + F.col("nth")).alias("arrival"), (F.col("nth") == 1).alias("correction"))
    out = replayed(arrived, F.col("arrival"), lambda b: keyed.stream_bar_continuity(b, opens), "update")
    return out.select("symbol", "first_open", "last_open", "at_open", "expected_bars")


@query("str9_latest_states", f"WITH {TRADES} SELECT symbol, max(agg_trade_id) AS sequence, arg_max(price, agg_trade_id) AS value FROM trades GROUP BY symbol")
def str9_latest_states(spark, sf):
    path = work_dir(spark)
    for events in arriving(read(spark, sf, "events"), ms("ts"), f"{path}/in"):
        states = trades_of(events).select(*SERIES, F.lit("trade").alias("channel"), F.col("agg_trade_id").alias("sequence"), F.col("trade_time_ms").alias("event_time_ms"), F.col("trade_time_ms").alias("received_at_ms"), F.col("price").alias("value"))
        sb.start_merge(states, f"{path}/out", f"{path}/checkpoint", sb.merge_latest, sb.LATEST, "append").awaitTermination()
    return sb.read_merged(spark, f"{path}/out", sb.LATEST).select("symbol", "sequence", "value")


@query("str10_amendments", f"WITH {HOURLY}, x AS (SELECT *, open_time // {HOUR} % 4 AS k FROM bars) SELECT symbol, open_time, CASE WHEN k = 1 THEN close + 1 WHEN k = 2 THEN close + 2 ELSE close END AS close, k = 1 AS amended FROM x")
def str10_amendments(spark, sf):
    """Stored bars of which some are closed: live input for a closed one is passed over, a verified correction amends it,
    and live input completes an open one."""
    rows = bar_table(spark, sf).withColumn("k", (F.col("open_time") / HOUR).cast("bigint") % 4)
    stored = rows.withColumns({"is_closed": F.col("k") != 2, "amended": F.lit(False), "source": F.when(F.col("k") == 2, "live").otherwise("data_manager_closed")}).drop("k")
    batch = rows.withColumns({"close": F.col("close") + F.col("k"), "source": F.when(F.col("k") == 1, "backfill").otherwise("live")}).where("k > 0").drop("k")
    return sb.merge_amendments(stored, batch).select("symbol", "open_time", "close", "amended")


@query("str11_price_only", f"WITH {TRADES} SELECT symbol, trade_time_ms // {HOUR} * {HOUR} AS open_time, max(price) AS high, min(price) AS low, last(price ORDER BY trade_time_ms, agg_trade_id) AS close, round(sum(CASE WHEN agg_trade_id % 3 = 0 THEN 0 ELSE quantity END), 8) AS volume FROM trades GROUP BY ALL")
def str11_price_only(spark, sf):
    rows = written(spark, sf, lambda t: sb.stream_bars(t, "1h", price_only=F.col("agg_trade_id") % 3 == 0), "update")
    return latest(rows, [*SERIES, "open_time"]).select("symbol", "open_time", "high", "low", "close", "volume")


@query("str13_stream_alerts", f"""WITH RECURSIVE {TRADES}, h AS (SELECT symbol, trade_time_ms AS t FROM trades WHERE price > 90), f AS (SELECT symbol, min(t) AS t, 1 AS n FROM h GROUP BY symbol UNION ALL
    SELECT f.symbol, (SELECT min(h.t) FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR}), n + 1 FROM f WHERE n < 20 AND EXISTS (SELECT 1 FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR})) SELECT symbol, t AS triggered_at_ms FROM f""")
def str13_stream_alerts(spark, sf):
    rule = {"left": "price", "comparator": ">", "right": 90}
    hits = lambda t: sb.alert_hits(t, "r", rule).withColumns({"close_time": F.col("trade_time_ms"), "cooldownMs": F.lit(6 * HOUR), "maxTriggers": F.lit(20), "expiresAt": F.lit(None).cast("bigint")})
    return written(spark, sf, lambda t: keyed.stream_alerts(hits(t)), "append").select("symbol", "triggered_at_ms")


@query("str12_stream_book", CHART_ORACLES["str12_rebuild_book"].replace("FALSE AS needs_resync FROM p", "FALSE AS needs_resync, 'live' AS state FROM p"))
def str12_stream_book(spark, sf):
    """Deltas wait for their snapshot, one is lost on the way, and a second snapshot, of the book up to beyond the loss, arrives
    after the deltas that follow it: the book comes to what all deltas give. As many wait as the table has between the two."""
    snapshot, deltas = numbered_deltas(spark, sf)
    last = F.broadcast(deltas.groupBy(*SERIES).agg(F.max("final_update_id").alias("n")))
    lost, seen, late = F.floor(F.col("n") / 3), F.floor(F.col("n") / 2), F.floor(F.col("n") * 3 / 4)
    rows = deltas.join(last, SERIES)
    again = f"{work_dir(spark)}/again"  # read with each part that arrives
    book.rebuild_book(snapshot, rows.where(F.col("final_update_id") <= seen)).join(last, SERIES).write.parquet(again)
    none = F.lit(None).cast("bigint")
    shot = lambda rows, arrival: rows.select(*SERIES, F.lit("snapshot").alias("kind"), none.alias("first_update_id"), F.col("last_update_id").alias("final_update_id"), none.alias("previous_final_update_id"), "bids", "asks", arrival.cast("bigint").alias("arrival"), (arrival / F.col("n")).alias("share"))
    sent = rows.where(F.col("final_update_id") != lost).select(*SERIES, F.lit("delta").alias("kind"), "first_update_id", "final_update_id", "previous_final_update_id", "bids", "asks", (F.col("final_update_id") * 2).alias("arrival"), (F.col("final_update_id") * 2 / F.col("n")).alias("share"))
    events = sent.unionByName(shot(snapshot.join(last, SERIES), F.lit(21))).unionByName(shot(spark.read.parquet(again), late * 2 + 1))
    out = latest(replayed(events, F.col("share"), lambda e: books.stream_book(e.drop("share"), most_waiting=None), "update"), SERIES)
    notional = F.aggregate("bids", F.lit(0.0), lambda s, x: s + x["price"] * x["quantity"])
    return out.select("symbol", "last_update_id", F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"), F.round(notional, 4).alias("bid_notional"), "needs_resync", "state")


@query("str13_stream_crosses", f"""WITH RECURSIVE {HOURLY}, x AS (SELECT symbol, open_time + {HOUR} AS t, close, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS before FROM bars), h AS (SELECT symbol, t FROM x WHERE before <= 50 AND close > 50), f AS (SELECT symbol, min(t) AS t, 1 AS n FROM h GROUP BY symbol UNION ALL
    SELECT f.symbol, (SELECT min(h.t) FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR}), n + 1 FROM f WHERE n < 30 AND EXISTS (SELECT 1 FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR})) SELECT 'above' AS rule_id, symbol, t AS triggered_at_ms FROM f
    UNION ALL SELECT 'fell', symbol, t FROM x WHERE (close - before) / abs(before) * 100 < -80 AND symbol = 'CLICK'""")
def str13_stream_crosses(spark, sf):
    """Closed hourly bars, none with the values before: crosses and falls are found from the state."""
    bars = bar_table(spark, sf).select(*SERIES, F.lit("1h").alias("interval"), F.lit("BAR_CLOSED").alias("event_type"), (F.col("open_time") + HOUR).alias("timestamp_ms"), F.col("open_time").alias("arrival"), "close")
    rules = [
        {"id": "above", "expression": {"left": "close", "comparator": "crossesAbove", "right": 50}, "cooldownMs": 6 * HOUR, "maxTriggers": 30},
        {"id": "fell", "expression": {"left": "close", "comparator": "percentChangeBelow", "right": -80}, "target": {"symbol": "CLICK"}},
    ]
    return replayed(bars, F.col("arrival"), lambda b: alerting.stream_rule_alerts(b, rules), "append").select("rule_id", "symbol", "triggered_at_ms")


@query("str14_filtered_events", "SELECT event_id FROM events WHERE event_type IN ('click', 'view') AND event_id % 4 = 1")
def str14_filtered_events(spark, sf):
    events = lambda rows: rows.select("event_id", F.col("event_type").alias("type"), F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), (F.col("event_id") % 4).cast("string").alias("symbol"))
    keys = spark.createDataFrame([("sim", "spot", "1"), ("sim", "spot", "9")], "exchange string, market_type string, symbol string")
    return replayed(read(spark, sf, "events"), ms("ts"), lambda rows: sb.filter_events(events(rows), ["click", "view"], keys), "append").select("event_id")


@query("str15_prices", f"WITH {TRADES}, d AS (SELECT symbol, trade_time_ms - trade_time_ms % {DAY} AS day, first(price ORDER BY trade_time_ms, agg_trade_id) AS o FROM trades GROUP BY ALL) SELECT agg_trade_id, o AS daily_open, round(price - o, 8) AS change FROM trades JOIN d ON trades.symbol = d.symbol AND trade_time_ms - trade_time_ms % {DAY} = d.day WHERE o > 0")
def str15_prices(spark, sf):
    """Prices of each batch with their day's open; every second day has no daily bar and takes its first minute's."""
    days = bar_table(spark, sf, "1d").where((F.col("open_time") / DAY).cast("bigint") % 2 == 0)
    minutes = bar_table(spark, sf, "1m")
    ticks = lambda t: t.select(*SERIES, "agg_trade_id", "price", F.col("trade_time_ms").alias("event_time_ms"), F.lit(None).cast("double").alias("own_open"))
    rows = written(spark, sf, ticks, "append", lambda batch: sb.stream_prices(batch, days, minutes).select("agg_trade_id", "daily_open", "change"))
    return rows.where("daily_open > 0").select("agg_trade_id", "daily_open", "change")


@query("src7_event_sink", f"WITH {ENVELOPES}, r AS (SELECT *, first(h) OVER w AS h0, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY kafka_topic, event_id ORDER BY kafka_partition, kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT 'fact' AS kind, kafka_topic, event_id, kafka_offset FROM r WHERE n = 1 UNION ALL SELECT 'conflict', kafka_topic, event_id, kafka_offset FROM r WHERE h <> h0")
def src7_event_sink(spark, sf):
    path = work_dir(spark)
    with keyed_state(spark):
        for events in arriving(read(spark, sf, "events"), ms("ts"), f"{path}/in"):
            sb.start_sink(envelopes_of(events), f"{path}/out", f"{path}/checkpoint", EVENTS, buckets=64).awaitTermination()
    facts, conflicts = (sb.read_sink(spark, f"{path}/out", t, EVENTS).withColumn("kind", F.lit(k)) for t, k in (("facts", "fact"), ("conflicts", "conflict")))
    return facts.select("kind", "kafka_topic", "event_id", "kafka_offset").unionByName(conflicts.select("kind", "kafka_topic", "event_id", "kafka_offset"))
