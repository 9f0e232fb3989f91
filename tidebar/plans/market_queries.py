"""Queries on joins, merges, ranges, calendars, books, projections, alerts and sources, each with its SQL twin where SQL has one."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import alerts

from ..functions import scalars
from ..operators import bars, book, calendars, flow, indicators, integrity, joins, paging, projections, ranges, text_match
from ..schemas import SERIES
from ..sources import files, raw
from ..streaming import keyed
from .tables import DAY, HOUR, HOURLY, TRADES, bar_table, bars_sql, ms, read, trades

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


def orders_metric(spark, sf, symbols):
    """Samples of the orders' prices as a metric of one series of `symbols` each, by priority, at made-up times in its range."""
    rows = read(spark, sf, "orders").select(F.col("o_orderkey"), F.col("o_totalprice").alias("value"), F.col("o_custkey"))
    span = symbols.groupBy(*SERIES).agg(F.min("open_time").alias("lo"), F.max("open_time").alias("hi")).withColumn("nth", F.row_number().over(Window.orderBy("symbol")) - 1)
    rows = rows.withColumn("nth", F.col("o_custkey") % 5).join(span, "nth")
    return rows.select(*SERIES, (F.col("lo") + F.pmod(F.col("o_orderkey") * 7_919_000, F.col("hi") - F.col("lo"))).alias("event_time_ms"), "value", "o_orderkey")


METRIC = f"""{HOURLY}, span0 AS (SELECT exchange, market_type, symbol, min(open_time) AS lo, max(open_time) AS hi FROM bars GROUP BY ALL), span AS (SELECT *, row_number() OVER (ORDER BY symbol) - 1 AS nth FROM span0),
    metric AS (SELECT exchange, market_type, symbol, lo + (o_orderkey * 7919000) % (hi - lo) AS event_time_ms, o_totalprice AS value, o_orderkey FROM orders JOIN span ON o_custkey % 5 = nth)"""


@query("jon1_asof_metric", f"""WITH {METRIC}, a AS (SELECT m.symbol, m.value, m.event_time_ms, b.open_time FROM metric m ASOF JOIN bars b ON m.symbol = b.symbol AND m.event_time_ms <= b.open_time),
    g AS (SELECT symbol, open_time, last(value ORDER BY event_time_ms, value) AS value, count(*) AS samples FROM a GROUP BY ALL) SELECT b.symbol, b.open_time, g.value, g.samples FROM bars b LEFT JOIN g USING (symbol, open_time)""")  # fmt: skip
def jon1_asof_metric(spark, sf):
    rows = bar_table(spark, sf)
    return joins.asof_metric(orders_metric(spark, sf, rows), rows).select("symbol", "open_time", "value", "samples")


@query("jon2_asof_funding", f"""WITH {METRIC}, f AS (SELECT *, CASE o_orderkey % 3 WHEN 0 THEN 3 WHEN 1 THEN 2 ELSE 1 END AS rank FROM metric), a AS (SELECT m.*, b.open_time FROM f m ASOF JOIN bars b ON m.symbol = b.symbol AND m.event_time_ms <= b.open_time),
    g AS (SELECT symbol, open_time, last(value ORDER BY rank, event_time_ms, value) * 100 AS funding_pct, bool_or(rank = 3) AS has_settlement FROM a GROUP BY ALL) SELECT b.symbol, b.open_time, g.funding_pct, g.has_settlement FROM bars b LEFT JOIN g USING (symbol, open_time)""")  # fmt: skip
def jon2_asof_funding(spark, sf):
    rows = bar_table(spark, sf)
    kind = F.when(F.col("o_orderkey") % 3 == 0, "exchange_settlement").when(F.col("o_orderkey") % 3 == 1, "derived_history").otherwise("exchange_realtime")
    samples = orders_metric(spark, sf, rows).withColumns({"funding_rate": F.col("value"), "provenance": kind, "sample_time": F.col("event_time_ms")})
    return joins.asof_funding(samples, rows).select("symbol", "open_time", "funding_pct", "has_settlement")


LIQ = f"{TRADES}, liq AS (SELECT symbol, trade_time_ms - trade_time_ms % 60000 AS open_time, sum(CASE WHEN is_buyer_maker THEN CAST(price AS DECIMAL(20,8)) * CAST(quantity AS DECIMAL(10,2)) ELSE 0 END) AS long_n, sum(CASE WHEN NOT is_buyer_maker THEN CAST(price AS DECIMAL(20,8)) * CAST(quantity AS DECIMAL(10,2)) ELSE 0 END) AS short_n, count(*) FILTER (is_buyer_maker) AS long_count FROM trades GROUP BY ALL)"


def liquidations(spark, sf):
    return liquidations_of(trades(spark, sf))


def liquidations_of(t):
    text = lambda v: F.lit(v)
    return t.select(*SERIES, F.when(F.col("is_buyer_maker"), "SELL").otherwise("BUY").alias("order_side"), text("LIMIT").alias("order_type"), text("IOC").alias("time_in_force"), F.col("quantity").alias("original_quantity"), F.col("price").alias("order_price"), F.col("price").alias("average_price"), F.col("quantity").alias("last_filled_quantity"), F.col("quantity").alias("filled_quantity"), text("FILLED").alias("order_status"), "trade_time_ms", F.col("agg_trade_id").alias("event_time_ms"), F.col("symbol").alias("pair_symbol"), text("PERP").alias("symbol_type"))


@query("agg7_liquidation_1m", f"WITH {LIQ} SELECT symbol, open_time, CAST(long_n AS DOUBLE) AS long_notional, CAST(short_n AS DOUBLE) AS short_notional, long_count FROM liq")
def agg7_liquidation_1m(spark, sf):
    rows = liquidations(spark, sf)
    return flow.liquidation_1m(rows.union(rows)).select("symbol", "open_time", F.col("long_notional").cast("double").alias("long_notional"), F.col("short_notional").cast("double").alias("short_notional"), "long_count")


@query("jon3_liquidations_to_bars", f"""WITH {LIQ}, h AS (SELECT symbol, open_time - open_time % {4 * HOUR} AS open_time, sum(long_n) AS l, sum(short_n) AS s FROM liq GROUP BY ALL) SELECT symbol, open_time, CAST(l AS DOUBLE) AS long_notional, CAST(s AS DOUBLE) AS short_notional, TRUE AS all_rows_final FROM h""")
def jon3_liquidations_to_bars(spark, sf):
    rollups = flow.liquidation_1m(liquidations(spark, sf)).withColumn("is_final", F.lit(True))
    out = joins.liquidations_to_bars(rollups, bar_table(spark, sf, "4h"), "4h")
    return out.select("symbol", "open_time", F.col("long_notional").cast("double").alias("long_notional"), F.col("short_notional").cast("double").alias("short_notional"), "all_rows_final")


@query("jon4_trades_to_bars", f"""WITH {HOURLY}, k AS (SELECT * FROM bars WHERE (open_time // {HOUR}) % 5 <> 0) SELECT t.agg_trade_id, b.open_time AS bar_time FROM trades t ASOF JOIN k b ON t.symbol = b.symbol AND t.trade_time_ms >= b.open_time WHERE t.trade_time_ms - b.open_time <= {int(1.5 * HOUR)}""")
def jon4_trades_to_bars(spark, sf):
    kept = bar_table(spark, sf).where((F.col("open_time") / HOUR).cast("bigint") % 5 != 0)
    return joins.trades_to_bars_asof(trades(spark, sf), kept, "1h").select("agg_trade_id", "bar_time")


SPAN = "r AS (SELECT symbol, min(open_time) AS a, max(open_time) AS z FROM bars GROUP BY symbol)"


def _spans(rows):
    return rows.groupBy(*SERIES).agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"))


@query("jon6_cal1_missing_bars", f"WITH {HOURLY}, {SPAN}, e AS (SELECT symbol, unnest(range(a, z + 1, {HOUR})) AS open_time FROM r) SELECT * FROM e ANTI JOIN bars USING (symbol, open_time)")
def jon6_cal1_missing_bars(spark, sf):
    rows = bar_table(spark, sf)
    return joins.missing_bars(rows, calendars.expected_opens(_spans(rows), "1h").select(*SERIES, "open_time")).select("symbol", "open_time")


def shifted(rows):
    """Bars with a deterministic difference in some, and without some."""
    return rows.where((F.col("open_time") / HOUR).cast("bigint") % 11 != 0).withColumn("close", F.when((F.col("open_time") / HOUR).cast("bigint") % 7 == 0, F.col("close") + 0.5).otherwise(F.col("close")))


SHIFTED = f"b AS (SELECT * REPLACE (CASE WHEN (open_time // {HOUR}) % 7 = 0 THEN close + 0.5 ELSE close END AS close) FROM bars WHERE (open_time // {HOUR}) % 11 <> 0)"


@query("jon7_compare_bars", f"WITH {HOURLY}, {SHIFTED} SELECT bars.symbol, count(*) FILTER (b.symbol IS NULL) AS only_left, count(b.symbol) AS both_sides, count(*) FILTER (abs(bars.close - b.close) > 0) AS close_differs, round(max(abs(bars.close - b.close)), 8) AS close_max_diff, count(*) FILTER (abs(bars.open - b.open) > 0) AS open_differs FROM bars LEFT JOIN b USING (symbol, open_time) GROUP BY bars.symbol")
def jon7_compare_bars(spark, sf):
    rows = bar_table(spark, sf)
    return joins.compare_bars(rows, shifted(rows)).select("symbol", "only_left", F.col("both").alias("both_sides"), "close_differs", "close_max_diff", "open_differs")


@query("jon8_bar_parity", f"WITH {HOURLY}, {SHIFTED} SELECT bars.symbol, bars.open_time, CASE WHEN b.symbol IS NULL THEN 'only_actual' ELSE 'close' END AS field FROM bars LEFT JOIN b USING (symbol, open_time) WHERE b.symbol IS NULL OR abs(bars.close - b.close) > 1e-8")
def jon8_bar_parity(spark, sf):
    rows = bar_table(spark, sf)
    return joins.bar_parity(rows, shifted(rows)).select("symbol", "open_time", "field")


@query("jon9_plan_repair", f"WITH {HOURLY}, {SHIFTED} SELECT bars.symbol, bars.open_time, CASE WHEN b.symbol IS NULL THEN 'unresolved' WHEN bars.close = b.close THEN 'relabel' ELSE 'replace' END AS action FROM bars LEFT JOIN b USING (symbol, open_time)")
def jon9_plan_repair(spark, sf):
    rows = bar_table(spark, sf)
    return joins.plan_repair(rows, shifted(rows).withColumn("is_valid", F.lit(True))).select("symbol", "open_time", "action")


@query("jon11_daily_open", f"WITH {TRADES}, d AS (SELECT symbol, trade_time_ms - trade_time_ms % {DAY} AS day, first(price ORDER BY trade_time_ms, agg_trade_id) AS o FROM trades GROUP BY ALL) SELECT agg_trade_id, CASE WHEN (d.day // {DAY}) % 2 = 0 THEN o ELSE o END AS daily_open, round((price - o) / o * 100 + 1e-9, 4) AS change_pct FROM trades JOIN d ON trades.symbol = d.symbol AND trade_time_ms - trade_time_ms % {DAY} = d.day WHERE o > 0")
def jon11_daily_open(spark, sf):
    t = trades(spark, sf)
    days = bar_table(spark, sf, "1d").where((F.col("open_time") / DAY).cast("bigint") % 2 == 0)
    prices = t.select(*SERIES, "agg_trade_id", "price", F.col("trade_time_ms").alias("event_time_ms"), F.lit(None).cast("double").alias("own_open"))
    out = joins.daily_open(prices, days, bar_table(spark, sf, "1m")).where("daily_open > 0")
    return out.select("agg_trade_id", "daily_open", F.round((F.col("price") - F.col("daily_open")) / F.col("daily_open") * 100 + 1e-9, 4).alias("change_pct"))


@query("jon13_tables_equal", f"WITH {HOURLY}, {SHIFTED} SELECT (SELECT count(*) FROM (SELECT symbol, open_time, close FROM bars EXCEPT ALL SELECT symbol, open_time, close FROM b)) AS only_left, (SELECT count(*) FROM (SELECT symbol, open_time, close FROM b EXCEPT ALL SELECT symbol, open_time, close FROM bars)) AS only_right, FALSE AS equal")
def jon13_tables_equal(spark, sf):
    rows = bar_table(spark, sf)
    return joins.tables_equal(rows.select("symbol", "open_time", "close"), shifted(rows).select("symbol", "open_time", "close"))


@query("jon14_jon15_watchlist", "SELECT c_custkey, c_mktsegment IN ('BUILDING', 'MACHINERY') AS watched FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR c_acctbal < 0")
def jon14_jon15_watchlist(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", "c_acctbal", F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.col("c_mktsegment").alias("symbol"))
    names = rows.select(*SERIES).distinct().where(F.col("symbol").isin("BUILDING", "MACHINERY"))
    watched = joins.in_watchlist(rows, names).withColumn("watched", F.lit(True))
    rest = joins.missing_keys(rows, names, SERIES).where("c_acctbal < 0").withColumn("watched", F.lit(False))
    return watched.unionByName(rest.select(*watched.columns)).select("c_custkey", "watched")


@query("jon18_merge_catalog", "SELECT upper(p_name) || p_partkey AS symbol, p_size >= 10 AS active, CASE WHEN p_size < 40 THEN 1 ELSE 9 END AS first_seen, CASE WHEN p_size < 10 THEN 9 END AS inactive_since FROM part")
def jon18_merge_catalog(spark, sf):
    rows = read(spark, sf, "part").select(F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.concat(F.upper("p_name"), F.col("p_partkey")).alias("symbol"), "p_size")
    before = rows.where("p_size < 40").withColumns({"first_seen": F.lit(1), "last_seen": F.lit(1), "inactive_since": F.lit(None).cast("int")})
    return joins.merge_catalog(before, rows.where("p_size >= 10"), 9).select("symbol", "active", "first_seen", "inactive_since")


@query("jon19_compare_feeds", f"WITH {TRADES} SELECT symbol, count(*) FILTER (x AND y) AS shared, count(*) FILTER (x AND y AND agg_trade_id % 50 <> 0) AS matching, count(*) FILTER (x AND NOT y) AS only_left, 'FAIL' AS verdict FROM (SELECT *, TRUE AS x, agg_trade_id % 13 <> 0 AS y, min(agg_trade_id) FILTER (agg_trade_id % 13 <> 0) OVER (PARTITION BY symbol) AS lo, max(agg_trade_id) FILTER (agg_trade_id % 13 <> 0) OVER (PARTITION BY symbol) AS hi FROM trades) WHERE agg_trade_id BETWEEN lo AND hi GROUP BY symbol")
def jon19_compare_feeds(spark, sf):
    a = trades(spark, sf).withColumns({"channel": F.lit("trade"), "sequence": F.col("agg_trade_id"), "payload_hash": F.col("price").cast("string")})
    b = a.where("agg_trade_id % 13 <> 0").withColumn("payload_hash", F.when(F.col("agg_trade_id") % 50 == 0, "other").otherwise(F.col("payload_hash")))
    return joins.compare_feeds(a, b).select("symbol", "shared", "matching", "only_left", "verdict")


WANTS = {0: "60m", 1: "2w", 2: "3M", 3: "45s", 4: "4h", 5: "7d", 6: "90m"}
NATIVES = {0: "1m", 1: "1h", 2: "1d", 3: "1w", 4: "30m"}


@query("sca3_jon16_routes", """WITH wants AS (SELECT DISTINCT n_regionkey AS region, c_custkey % 7 AS k FROM customer JOIN nation ON c_nationkey = n_nationkey), have AS (SELECT n_regionkey AS region, bool_or(n_nationkey % 5 = 0) AS m, bool_or(n_nationkey % 5 = 1) AS h, bool_or(n_nationkey % 5 = 2) AS d, bool_or(n_nationkey % 5 = 3) AS w, bool_or(n_nationkey % 5 = 4) AS t FROM nation GROUP BY ALL),
    x AS (SELECT CAST(region AS VARCHAR) AS exchange, k, CASE k WHEN 0 THEN '60m' WHEN 1 THEN '2w' WHEN 2 THEN '3M' WHEN 3 THEN '45s' WHEN 4 THEN '4h' WHEN 5 THEN '7d' ELSE '90m' END AS interval, CASE WHEN t THEN '30m' WHEN m THEN '1m' END AS short, CASE WHEN h THEN '1h' WHEN t THEN '30m' WHEN m THEN '1m' END AS hour, CASE WHEN d THEN '1d' WHEN h THEN '1h' WHEN t THEN '30m' WHEN m THEN '1m' END AS day, w, h FROM wants JOIN have USING (region)),
    y AS (SELECT exchange, interval, CASE k WHEN 0 THEN hour WHEN 1 THEN CASE WHEN w THEN '1w' ELSE day END WHEN 2 THEN day WHEN 4 THEN hour WHEN 5 THEN day WHEN 6 THEN short END AS base FROM x)
    SELECT exchange, interval, CASE WHEN base IS NULL THEN 'error' WHEN interval = '60m' AND base = '1h' THEN 'native' ELSE 'derived' END AS route, base FROM y""")
def sca3_jon16_routes(spark, sf):
    """Intervals that the customers of each region want, by the native ones of its nations."""
    named = lambda table, key: F.element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)
    nations = read(spark, sf, "nation").select("n_nationkey", F.col("n_regionkey").cast("string").alias("exchange"))
    wants = read(spark, sf, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("exchange", named(WANTS, (F.col("c_custkey") % 7).cast("int")).alias("interval")).distinct()
    have = nations.select("exchange", named(NATIVES, (F.col("n_nationkey") % 5).cast("int")).alias("native")).distinct()
    return joins.resolve_routes(wants, have)


@query("set5_coalesce_ranges", f"""WITH t AS (SELECT o_custkey % 1000 AS symbol, (epoch_us(o_orderdate) // 1000) // {DAY} AS a, (epoch_us(o_orderdate) // 1000) // {DAY} + o_orderkey % 40 AS z FROM orders), w AS (SELECT *, max(z) OVER (PARTITION BY symbol ORDER BY a, z ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM t),
    i AS (SELECT *, sum(CASE WHEN a <= r + 1 THEN 0 ELSE 1 END) OVER (PARTITION BY symbol ORDER BY a, z) AS g FROM w) SELECT symbol, min(a) AS start, max(z) AS "end" FROM i GROUP BY symbol, g""")  # fmt: skip
def set5_coalesce_ranges(spark, sf):
    return ranges.coalesce_ranges(_order_ranges(spark, sf), ["symbol"])


def _order_ranges(spark, sf):
    day = F.floor(ms("o_orderdate") / DAY)
    return read(spark, sf, "orders").select((F.col("o_custkey") % 1000).alias("symbol"), day.alias("start"), (day + F.col("o_orderkey") % 40).alias("end"))


@query("set6_subtract_ranges", f"""WITH t AS (SELECT o_custkey % 1000 AS symbol, (epoch_us(o_orderdate) // 1000) // {DAY} AS a, (epoch_us(o_orderdate) // 1000) // {DAY} + o_orderkey % 40 AS z FROM orders), r AS (SELECT symbol, min(a) - 5 AS lo, max(z) + 5 AS hi FROM t GROUP BY symbol),
    d AS (SELECT symbol, unnest(range(lo, hi + 1)) AS day FROM r), u AS (SELECT d.* FROM d WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.symbol = d.symbol AND day BETWEEN a AND z)),
    i AS (SELECT *, day - row_number() OVER (PARTITION BY symbol ORDER BY day) AS g FROM u) SELECT symbol, min(day) AS start, max(day) AS "end" FROM i GROUP BY symbol, g""")  # fmt: skip
def set6_subtract_ranges(spark, sf):
    have = _order_ranges(spark, sf)
    want = have.groupBy("symbol").agg((F.min("start") - 5).alias("start"), (F.max("end") + 5).alias("end"))
    return ranges.subtract_ranges(want, have, ["symbol"])


@query("set7_set8_clip_refresh", f"WITH {HOURLY}, {SPAN} SELECT symbol, greatest(a, a + 5 * {DAY}) AS start, z - {DAY} AS \"end\" FROM r WHERE a + 5 * {DAY} <= z - {DAY}")
def set7_set8_clip_refresh(spark, sf):
    spans = _spans(bar_table(spark, sf)).withColumn("end", F.col("end") - DAY)
    dirty = spans.select(*SERIES, (F.col("start") + 5 * DAY).alias("start"), (F.col("start") + 6 * DAY).alias("end"))
    return ranges.clip_ranges(ranges.dirty_refresh(dirty, spans, SERIES), low=0).select("symbol", "start", "end")


@query("set4_src10_upsert_bars", f"WITH {HOURLY}, {SHIFTED} SELECT bars.symbol, bars.open_time, CASE WHEN b.symbol IS NOT NULL AND (bars.open_time // {HOUR}) % 2 = 0 THEN b.close ELSE bars.close END AS close FROM bars LEFT JOIN b USING (symbol, open_time)")
def set4_src10_upsert_bars(spark, sf):
    stored = bar_table(spark, sf)
    source = F.when((F.col("open_time") / HOUR).cast("bigint") % 2 == 0, "backfill_rest_verified").otherwise("data_manager_closed")
    return integrity.upsert_bars(stored, shifted(stored).withColumn("source", source)).select("symbol", "open_time", "close")


@query("src8_upsert_rollups", f"WITH {HOURLY} SELECT symbol, open_time, CASE WHEN (open_time // {HOUR}) % 3 = 2 THEN close + 1 ELSE close END AS close FROM bars")
def src8_upsert_rollups(spark, sf):
    rows = bar_table(spark, sf).select(*SERIES, "open_time", "close").withColumn("m", (F.col("open_time") / HOUR).cast("bigint") % 3)
    stored = rows.withColumns({"is_final": F.col("m") == 0, "received_at_ms": F.lit(10), "revision": F.lit(1)}).drop("m")
    incoming = rows.withColumns({"close": F.col("close") + 1, "is_final": F.col("m") == 1, "received_at_ms": F.when(F.col("m") == 2, 11).otherwise(F.when(F.col("m") == 1, 9).otherwise(12)), "revision": F.lit(1)}).drop("m")
    return integrity.upsert_rollups(stored, incoming.select(*stored.columns), [*SERIES, "open_time"]).select("symbol", "open_time", "close")


@query("src11_delete_range", f"WITH {HOURLY}, lo AS (SELECT min(open_time) AS a FROM bars) SELECT symbol, open_time FROM bars, lo WHERE NOT (symbol = 'CLICK' AND open_time BETWEEN a AND a + {5 * DAY})")
def src11_delete_range(spark, sf):
    rows = bar_table(spark, sf)
    a = rows.agg(F.min("open_time")).first()[0]
    return integrity.delete_range(rows, {"symbol": "CLICK"}, a, a + 5 * DAY).select("symbol", "open_time")


ENVELOPES = "ev AS (SELECT event_type AS kafka_topic, event_id % 3 AS kafka_partition, event_id AS kafka_offset, CAST(event_id // 2 AS VARCHAR) AS event_id, (epoch_us(ts) // 1000) AS event_time_ms, sha256(CASE WHEN event_id % 10 = 0 THEN 'x' ELSE 'y' END) AS h FROM events)"


def envelopes(spark, sf):
    return envelopes_of(read(spark, sf, "events"))


def envelopes_of(e):
    return e.select(F.col("event_type").alias("kafka_topic"), (F.col("event_id") % 3).cast("int").alias("kafka_partition"), F.col("event_id").alias("kafka_offset"), F.expr("event_id div 2").cast("string").alias("event_id"), F.col("event_type").alias("partition_key"), ms("ts").alias("event_time_ms"), F.col("event_id").alias("sequence_start"), F.when(F.col("event_id") != 7, F.col("event_id")).alias("sequence_end"), F.sha2(F.when(F.col("event_id") % 10 == 0, "x").otherwise("y"), 256).alias("envelope_sha256"), F.col("props").alias("envelope_json"))


@query("ded2_canonical_events", f"WITH {ENVELOPES}, r AS (SELECT *, first(h) OVER w AS h0, row_number() OVER w AS n FROM ev WINDOW w AS (PARTITION BY kafka_topic, event_id ORDER BY kafka_partition, kafka_offset ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)) SELECT kafka_topic, event_id, min(kafka_offset) FILTER (n = 1) AS kafka_offset, count(*) FILTER (h = h0) - 1 AS duplicates, count(*) FILTER (h <> h0) AS conflicts FROM r GROUP BY ALL")
def ded2_canonical_events(spark, sf):
    return integrity.canonical_events(envelopes(spark, sf)).select("kafka_topic", "event_id", "kafka_offset", "duplicates", "conflicts")


@query("ded3_contiguity", f"WITH {ENVELOPES}, l AS (SELECT *, lag(kafka_offset) OVER (PARTITION BY kafka_topic ORDER BY kafka_offset) AS p FROM ev) SELECT kafka_topic, kafka_offset AS sequence, p AS sequence_before, 'gap' AS kind FROM l WHERE kafka_offset <> p + 1")
def ded3_contiguity(spark, sf):
    return integrity.contiguity_breaks(envelopes(spark, sf), ["kafka_topic"], "kafka_offset")


@query("ded6_reconcile", f"WITH {ENVELOPES} SELECT kafka_topic AS stream, max(kafka_offset) AS source, max(kafka_offset) - 1 AS query, 'lagging' AS code, CAST(1 AS BIGINT) AS lag FROM ev GROUP BY kafka_topic")
def ded6_reconcile(spark, sf):
    top = envelopes(spark, sf).groupBy(F.col("kafka_topic").alias("stream")).agg(F.max("kafka_offset").alias("offset"))
    rows = [top.withColumns({"stage": F.lit(s), "offset": F.col("offset") - (1 if s == "query" else 0)}) for s in integrity.STAGES]
    return integrity.reconcile(rows[0].union(rows[1].select(*rows[0].columns)).union(rows[2].select(*rows[0].columns)).union(rows[3].select(*rows[0].columns))).select("stream", "source", "query", "code", "lag")


@query("agg13_event_range", f"WITH {ENVELOPES} SELECT kafka_topic, kafka_partition, count(*) AS n, min(kafka_offset) AS first_offset, max(kafka_offset) AS last_offset, min(kafka_offset) AS sequence_first, CASE WHEN bool_and(kafka_offset <> 7) THEN max(kafka_offset) END AS sequence_last FROM ev GROUP BY ALL")
def agg13_event_range(spark, sf):
    return paging.event_range(envelopes(spark, sf)).drop("first_time_ms", "last_time_ms")


@query("src5_src6_archive", f"WITH {ENVELOPES} SELECT kafka_topic, kafka_partition, kafka_offset // 1000 AS segment, count(*) AS n, min(kafka_offset) AS first_offset, max(kafka_offset) AS last_offset, sha256(string_agg(h, ',' ORDER BY kafka_offset)) AS rows_sha256 FROM ev GROUP BY ALL")
def src5_src6_archive(spark, sf):
    _, manifest = files.archive_manifest(envelopes(spark, sf), 1000)
    return manifest.select("kafka_topic", "kafka_partition", "segment", "n", "first_offset", "last_offset", "rows_sha256")


@query("top5_event_page", f"WITH {ENVELOPES}, b AS (SELECT min(event_time_ms) AS lo, max(kafka_offset) // 2 AS cut FROM ev) SELECT kafka_topic, kafka_partition, kafka_offset, event_time_ms FROM ev, b WHERE kafka_offset < cut AND event_time_ms BETWEEN lo AND lo + {10 * DAY} ORDER BY event_time_ms, kafka_partition, kafka_offset LIMIT 100")
def top5_event_page(spark, sf):
    rows = envelopes(spark, sf)
    lo, cut = rows.agg(F.min("event_time_ms"), F.expr("max(kafka_offset) div 2")).first()
    return paging.query_events(rows, cut, lo, lo + 10 * DAY, 100).select("kafka_topic", "kafka_partition", "kafka_offset", "event_time_ms")


@query("top5_event_pages", f"WITH {ENVELOPES}, b AS (SELECT min(event_time_ms) AS lo, max(kafka_offset) // 2 AS cut FROM ev), n AS (SELECT *, row_number() OVER (ORDER BY event_time_ms, kafka_partition, kafka_offset) AS nth FROM ev, b WHERE kafka_offset < cut AND event_time_ms BETWEEN lo AND lo + {10 * DAY}) SELECT (nth - 1) // 100 AS page, kafka_topic, kafka_partition, kafka_offset, event_time_ms FROM n WHERE nth <= 300")
def top5_event_pages(spark, sf):
    """Three pages, each from the cursor of the one before."""
    rows = envelopes(spark, sf)
    lo, cut = rows.agg(F.min("event_time_ms"), F.expr("max(kafka_offset) div 2")).first()
    pages, cursor = [], None
    for n in range(3):
        page, cursor = paging.query_event_page(rows, cut, lo, lo + 10 * DAY, 100, cursor)
        pages.append(page.select(F.lit(n).cast("bigint").alias("page"), "kafka_topic", "kafka_partition", "kafka_offset", "event_time_ms"))
        if cursor is None:
            break
    return reduce(DataFrame.unionByName, pages)


@query("agg19_feed_health", f"""WITH {TRADES}, f AS (SELECT symbol, agg_trade_id AS s, trade_time_ms, trade_time_ms + (agg_trade_id * 37) % 1000 AS r FROM trades), o AS (SELECT *, max(s) OVER (PARTITION BY symbol ORDER BY r, s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM f)
    SELECT symbol, count(*) AS received, count(*) FILTER (s < best) AS out_of_order, quantile_disc(r - trade_time_ms, 0.5) AS latency_p50, quantile_disc(r - trade_time_ms, 0.99) AS latency_p99, max(r - trade_time_ms) AS latency_max FROM o GROUP BY symbol""")  # fmt: skip
def agg19_feed_health(spark, sf):
    rows = trades(spark, sf).withColumns({"sequence": F.col("agg_trade_id"), "event_time_ms": F.col("trade_time_ms"), "received_at_ms": F.col("trade_time_ms") + (F.col("agg_trade_id") * 37) % 1000, "arrival": F.col("agg_trade_id")})
    return integrity.feed_health(rows, ["symbol"]).select("symbol", "received", "out_of_order", "latency_p50", "latency_p99", "latency_max")


@query("agg20_activity", f"""WITH e AS (SELECT user_id, (epoch_us(ts) // 1000) AS t FROM events), n AS (SELECT max(t) AS now FROM e), h AS (SELECT user_id, t - t % {HOUR} AS hour, count(*) AS n FROM e, n WHERE t BETWEEN now - {7 * DAY} AND now GROUP BY ALL)
    SELECT user_id, round(sum(n / (1 + (now - hour) / CAST({HOUR} AS DOUBLE) / 24)), 8) AS score, CAST(sum(h.n) AS BIGINT) AS n_7d FROM h, n GROUP BY user_id""")  # fmt: skip
def agg20_activity(spark, sf):
    rows = read(spark, sf, "events").select("user_id", ms("ts").alias("time_ms"), F.lit(1.0).alias("weight"))
    now = rows.agg(F.max("time_ms")).first()[0]
    return integrity.activity_score(rows, now, ["user_id"]).select("user_id", "score", "n_7d")


@query("cal6_detect_gaps", f"""WITH {HOURLY}, {SPAN}, e AS (SELECT symbol, unnest(range(a - 5 * {HOUR}, z + 3 * {HOUR} + 1, {HOUR})) AS open_time FROM r), j AS (SELECT e.*, b.symbol IS NOT NULL AS there FROM e LEFT JOIN bars b USING (symbol, open_time)),
    i AS (SELECT *, count(*) FILTER (there) OVER (PARTITION BY symbol ORDER BY open_time) AS g, count(*) FILTER (there) OVER (PARTITION BY symbol) AS total FROM j) SELECT symbol, min(open_time) AS start, max(open_time) AS "end", count(*) AS bars, CASE WHEN g = 0 THEN 'HEAD' WHEN g = total THEN 'TAIL' ELSE 'INTERIOR' END AS kind FROM i WHERE NOT there GROUP BY symbol, g, total""")  # fmt: skip
def cal6_detect_gaps(spark, sf):
    rows = bar_table(spark, sf)
    want = _spans(rows).select(*SERIES, (F.col("start") - 5 * HOUR).alias("start"), (F.col("end") + 3 * HOUR).alias("end"))
    return calendars.detect_gaps(rows, want, "1h", 4_000_000_000_000).select("symbol", "start", "end", "bars", "kind")


HALF = HOUR // 2
#: Half-hours in which New York is open: 09:30 to 16:00 from Monday to Friday, numbered.
NEW_YORK = calendars.SessionCalendar("America/New_York", tuple((d, 570, 960) for d in range(5)))
HALF_HOURLY = f"""{TRADES}, {bars_sql(f'trade_time_ms - trade_time_ms % {HALF}')}, days AS (SELECT unnest(generate_series((SELECT make_timestamp((min(open_time) // {DAY} - 7) * {DAY * 1000}) FROM bars), (SELECT make_timestamp(max(open_time) * 1000 + {7 * DAY * 1000}) FROM bars), INTERVAL 1 DAY)) AS day),
    opens AS (SELECT *, row_number() OVER (ORDER BY open_time) AS place FROM (SELECT epoch_ms(timezone('America/New_York', day + to_minutes(CAST(570 + 30 * k AS BIGINT)))) AS open_time FROM days, (SELECT unnest(range(13)) AS k) WHERE isodow(day) <= 5))"""  # fmt: skip


def new_york_opens(spark, rows):
    """The calendar's half-hours from a week before the first bar to a week after the last."""
    lo, hi = rows.agg(F.min("open_time"), F.max("open_time")).first()
    return calendars.session_opens(calendars.session_segments(spark, NEW_YORK, lo - 7 * DAY, hi + 7 * DAY), "30m")


@query("cal6_session_gaps", f"""WITH {HALF_HOURLY}, {SPAN}, e AS (SELECT symbol, open_time, place FROM r, opens WHERE open_time BETWEEN a - 4 * {DAY} AND z + 3 * {DAY}), j AS (SELECT e.*, b.symbol IS NOT NULL AS there FROM e LEFT JOIN bars b USING (symbol, open_time)),
    i AS (SELECT *, count(*) FILTER (there) OVER (PARTITION BY symbol ORDER BY open_time) AS g, count(*) FILTER (there) OVER (PARTITION BY symbol) AS total FROM j), k AS (SELECT symbol, min(open_time) AS start, max(open_time) AS "end", count(*) AS bars, CASE WHEN g = total THEN 'TAIL' WHEN g = 0 THEN 'HEAD' ELSE 'INTERIOR' END AS kind FROM i WHERE NOT there GROUP BY symbol, g, total)
    SELECT * FROM k WHERE bars > 1""")  # fmt: skip
def cal6_session_gaps(spark, sf):
    """Gaps of at least two half-hours in which the exchange was open; nights and weekends are none, and don't end one."""
    rows = bars.bars_from_trades(trades(spark, sf), "30m")
    want = _spans(rows).select(*SERIES, (F.col("start") - 4 * DAY).alias("start"), (F.col("end") + 3 * DAY).alias("end"))
    found = calendars.detect_gaps(rows, want, "30m", 4_000_000_000_000, 1, new_york_opens(spark, rows))
    return found.select("symbol", "start", "end", "bars", "kind")


@query("str8_bar_continuity", f"WITH {HALF_HOURLY}, p AS (SELECT symbol, open_time, place, lag(place) OVER (PARTITION BY symbol ORDER BY open_time) AS h FROM bars JOIN opens USING (open_time)) SELECT symbol, f.open_time AS first_open, l.open_time AS last_open, p.open_time AS at_open, CAST(p.place - h - 1 AS BIGINT) AS expected_bars FROM p JOIN opens f ON f.place = h + 1 JOIN opens l ON l.place = p.place - 1 WHERE p.place > h + 1")
def str8_bar_continuity(spark, sf):
    rows = bars.bars_from_trades(trades(spark, sf), "30m")
    opens = calendars.numbered_opens(new_york_opens(spark, rows))
    arrived = rows.withColumns({"arrival": F.col("open_time"), "correction": F.lit(False)})
    return keyed.bar_continuity_in_order(arrived, opens).select("symbol", "first_open", "last_open", "at_open", "expected_bars")


@query("cal2_session_opens", f"""WITH d AS (SELECT DISTINCT date_trunc('day', o_orderdate) AS day FROM orders), s AS (SELECT day, timezone('America/New_York', day + INTERVAL 570 MINUTE) AS a, timezone('America/New_York', day + INTERVAL 960 MINUTE) AS z FROM d WHERE isodow(day) <= 5)
    SELECT count(*) AS sessions, CAST(sum(epoch_ms(z) - epoch_ms(a)) AS BIGINT) AS open_ms, min(epoch_ms(a)) AS first_open FROM s""")  # fmt: skip
def cal2_session_opens(spark, sf):
    orders = read(spark, sf, "orders").select(F.date_trunc("day", F.col("o_orderdate").cast("timestamp")).alias("day"))
    lo, hi = orders.agg(F.min(F.unix_millis("day")), F.max(F.unix_millis("day"))).first()
    calendar = calendars.SessionCalendar("America/New_York", tuple((d, 570, 960) for d in range(5)))
    segments = calendars.session_segments(spark, calendar, lo, hi + 2 * DAY)
    days = orders.distinct().withColumn("date", F.to_date("day"))
    held = segments.withColumn("date", F.to_date(F.from_utc_timestamp(F.timestamp_millis("start"), "America/New_York"))).join(days, "date")
    return held.agg(F.count("*").alias("sessions"), F.sum(F.col("end") - F.col("start") + 1).alias("open_ms"), F.min("start").alias("first_open"))


#: About so many lines of orders are put together by one task, whatever the session's number of shuffle partitions is.
TASK_LINES = 250_000


def books(spark, sf):
    """A book of each order: bids and asks around its price from its lines."""
    items = read(spark, sf, "lineitem")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-items.count() // TASK_LINES))
    lines = items.select("l_orderkey", "l_linenumber", "l_quantity").repartition(parts, "l_orderkey").groupBy("l_orderkey").agg(F.sort_array(F.collect_set(F.struct(F.col("l_linenumber").alias("n"), F.col("l_quantity").alias("q")))).alias("x"))
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderpriority", F.round("o_totalprice", 0).alias("mid")).repartition(parts, "o_orderkey").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    side = lambda sign: F.transform("x", lambda l: F.struct((F.col("mid") + sign * l["n"] * 7).alias("price"), l["q"].alias("quantity")))
    return rows.select(F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.col("o_orderpriority").alias("symbol"), F.col("o_orderkey").alias("last_update_id"), side(-1).alias("bids"), side(1).alias("asks"))


BOOK = "bk AS (SELECT DISTINCT o_orderkey AS last_update_id, round(o_totalprice, 0) AS mid, l_linenumber AS n, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("sca20_sca21_book_metrics", f"WITH {BOOK}, u AS (SELECT * FROM bk WHERE last_update_id IN (SELECT last_update_id FROM bk GROUP BY last_update_id HAVING count(*) = count(DISTINCT n))) SELECT last_update_id, max(mid - n * 7) AS best_bid, min(mid + n * 7) AS best_ask, round(sum(q), 6) AS bids_quantity, round(sum((mid - n * 7) * q), 4) AS bids_notional FROM u GROUP BY last_update_id HAVING min(mid - n * 7) > 0")
def sca20_sca21_book_metrics(spark, sf):
    rows = scalars.book_metrics(scalars.canonical_book(books(spark, sf), 50))
    return rows.select("last_update_id", "best_bid", "best_ask", F.round("bids_quantity", 6).alias("bids_quantity"), F.round("bids_notional", 4).alias("bids_notional"))


@query("agg9_group_book", f"WITH {BOOK} SELECT last_update_id, floor((mid - n * 7) / 10) * 10 AS level_price, 'bids' AS side, sum(q) AS quantity FROM bk GROUP BY ALL UNION ALL SELECT last_update_id, ceil((mid + n * 7) / 10) * 10, 'asks', sum(q) FROM bk GROUP BY ALL")
def agg9_group_book(spark, sf):
    rows = books(spark, sf)
    catalog = rows.select(*SERIES).distinct().withColumn("tick", F.lit(1.0))
    return book.group_book(rows, catalog, 10).select("last_update_id", F.col("level_price").cast("double").alias("level_price"), "side", F.col("quantity").cast("double").alias("quantity"))


@query("win3_book_depth", f"WITH {BOOK} SELECT last_update_id, n AS line, q AS quantity, round(sum(q) OVER (PARTITION BY last_update_id), 6) AS side_total FROM bk")
def win3_book_depth(spark, sf):
    rows = book.book_depth(books(spark, sf)).where("side = 'bids'")
    mid = read(spark, sf, "orders").select(F.col("o_orderkey").alias("last_update_id"), F.round("o_totalprice", 0).alias("mid"))
    return rows.join(mid, "last_update_id").select("last_update_id", F.round((F.col("mid") - F.col("price")) / 7).cast("int").alias("line"), "quantity", F.round("side_total", 6).alias("side_total"))


@query("prj6_identity", f"WITH {HOURLY} SELECT symbol, open_time AS source_time, open, high, low, close FROM bars")
def prj6_identity(spark, sf):
    return projections.identity(bar_table(spark, sf)).drop("exchange", "market_type")


RULE = {"type": "AND", "conditions": [{"left": "close", "comparator": "crossesAbove", "right": {"type": "field", "value": "ma"}}, {"type": "NOT", "child": {"left": "volume", "comparator": "outside", "right": {"min": 100, "max": 5}}}]}


@query("sca31_sca32_alerts", f"""WITH {HOURLY}, m AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), l AS (SELECT *, lag(close) OVER (PARTITION BY symbol ORDER BY open_time) AS c0, lag(ma) OVER (PARTITION BY symbol ORDER BY open_time) AS m0 FROM m)
    SELECT symbol, open_time FROM l WHERE coalesce(c0 <= m0 AND close > ma, FALSE) AND coalesce(volume BETWEEN 5 AND 100, TRUE)""")  # fmt: skip
def sca31_sca32_alerts(spark, sf):
    rows = indicators.ma(bar_table(spark, sf), 5)
    w = Window.partitionBy(*SERIES).orderBy("open_time")
    rows = rows.withColumns({alerts.previous(c): F.lag(c).over(w) for c in alerts.fields(RULE)})
    return rows.where(alerts.compile_alert(RULE, set(rows.columns))).select("symbol", "open_time")


@query("sca34_message", f"WITH {HOURLY} SELECT symbol, open_time, symbol || ' at ' || CAST(open_time AS VARCHAR) AS message FROM bars")
def sca34_message(spark, sf):
    return scalars.render_message(bar_table(spark, sf), "{{symbol}} at {{open_time}}", ["symbol", "open_time"]).select("symbol", "open_time", "message")


@query("sca14_sca15_capabilities", f"WITH {HOURLY} SELECT symbol, open_time, quote_volume, CAST(NULL AS BIGINT) AS trades FROM bars")
def sca14_sca15_capabilities(spark, sf):
    caps = spark.createDataFrame([("sim", "spot", ["quote_volume"])], "exchange string, market_type string, fields array<string>")
    return scalars.mask_capabilities(bar_table(spark, sf), caps).select("symbol", "open_time", "quote_volume", "trades")


@query("sca35_match_patterns", "SELECT doc_id, count(*) AS matches FROM (SELECT doc_id, unnest(regexp_extract_all(text, 'token|@mail')) AS m FROM documents) GROUP BY doc_id")
def sca35_match_patterns(spark, sf):
    return text_match.match_patterns(read(spark, sf, "documents"), ["token", "@mail"]).groupBy("doc_id").agg(F.count("*").alias("matches"))


@query("sca35_benchmark_patterns", """WITH RECURSIVE w AS (SELECT string_split(text, ' ') AS w FROM benchmark), p AS (SELECT p, row_number() OVER (ORDER BY p) - 1 AS i FROM (SELECT DISTINCT unnest(list_transform(range(1, len(w) - n + 2), lambda j: array_to_string(w[j:j + n - 1], ' '))) AS p FROM w, (VALUES (3), (5)) k(n))),
    d AS (SELECT doc_id, text, i, p, string_split(text, p) AS parts FROM documents JOIN p ON contains(text, p)),
    h AS (SELECT doc_id, i, unnest(list_transform(range(1, len(parts)), lambda j: CAST(list_sum(list_transform(parts[1:j], lambda x: octet_length(encode(x)))) AS BIGINT) + (j - 1) * octet_length(encode(p)))) AS a, octet_length(encode(p)) AS n FROM d),
    k AS (SELECT unnest(['standard', 'leftmost-first', 'leftmost-longest']) AS kind), o AS (SELECT kind, doc_id, i, a, n, row_number() OVER (PARTITION BY kind, doc_id ORDER BY CASE WHEN kind = 'standard' THEN a + n ELSE a END, CASE kind WHEN 'standard' THEN a WHEN 'leftmost-first' THEN i ELSE -n END, i) AS r FROM h, k),
    g AS (SELECT kind, doc_id, i, a, n, r FROM o WHERE r = 1 UNION ALL SELECT o.kind, o.doc_id, o.i, o.a, o.n, o.r FROM (SELECT g.kind, g.doc_id, min(o.r) AS r FROM g JOIN o ON o.kind = g.kind AND o.doc_id = g.doc_id AND o.r > g.r AND o.a >= g.a + g.n GROUP BY ALL) x JOIN o USING (kind, doc_id, r)),
    m AS (SELECT kind, doc_id, i, a, n FROM g UNION ALL SELECT 'overlapping', doc_id, i, a, n FROM h)
    SELECT kind, doc_id, count(*) AS matches, CAST(sum(n) AS BIGINT) AS bytes, CAST(sum((a + 1) * (i + 1)) AS BIGINT) AS places FROM m GROUP BY kind, doc_id""")
def sca35_benchmark_patterns(spark, sf):
    """All runs of three and of five words of the benchmark's items, in every document, in all kinds of match."""
    words = F.split("text", " ")
    runs = lambda n: F.transform(F.sequence(F.lit(1), F.size(words) - (n - 1)), lambda i: F.array_join(F.slice(words, i, n), " "))
    items = read(spark, sf, "benchmark").select("text")
    some = items.where(F.size(words) >= 3).select(F.explode(runs(3)).alias("p")).union(items.where(F.size(words) >= 5).select(F.explode(runs(5)).alias("p")))
    patterns = sorted(r.p for r in some.distinct().collect())
    docs, out = read(spark, sf, "documents"), []
    for kind in ("standard", "leftmost-first", "leftmost-longest", "overlapping"):
        found = text_match.match_patterns(docs, patterns, "standard" if kind == "overlapping" else kind, overlapping=kind == "overlapping")
        out.append(found.groupBy("doc_id").agg(F.count("*").alias("matches"), F.sum(F.col("end") - F.col("start")).alias("bytes"), F.sum((F.col("start") + 1) * (F.col("pattern") + 1)).alias("places")).withColumn("kind", F.lit(kind)))
    return reduce(DataFrame.unionByName, out)


@query("top6_retention", f"WITH {HOURLY}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM bars) SELECT symbol, open_time FROM l WHERE n <= 100")
def top6_retention(spark, sf):
    limits = spark.createDataFrame([("hour", 100), ("minute", 10)], "tier string, keep int")
    return paging.apply_retention(bar_table(spark, sf), limits).select("symbol", "open_time")


@query("top8_gap_repairs", f"""WITH {HOURLY}, g AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) + {HOUR} AS start, open_time - {HOUR} AS "end" FROM bars), h AS (SELECT *, ("end" - start) // {HOUR} + 1 AS bars FROM g WHERE start <= "end"),
    u AS (SELECT *, row_number() OVER w AS nth, sum(bars) OVER w AS upto FROM h WINDOW w AS (PARTITION BY symbol ORDER BY "end" DESC)) SELECT symbol, start, "end", CAST(least(bars, 6 - (upto - bars)) AS BIGINT) AS repair_bars FROM u WHERE nth <= 4 AND 6 - (upto - bars) > 0""")  # fmt: skip
def top8_gap_repairs(spark, sf):
    rows = bar_table(spark, sf)
    gaps = calendars.detect_gaps(rows, _spans(rows), "1h", 4_000_000_000_000)
    return paging.plan_gap_repairs(gaps, 4, 6).select("symbol", "start", "end", "repair_bars")


@query("top2_range_verdict", f"WITH {HOURLY}, b AS (SELECT min(open_time) AS lo FROM bars), x AS (SELECT count(*) AS n FROM bars, b WHERE symbol = 'CLICK' AND open_time BETWEEN lo AND lo + {10 * DAY}) SELECT 241 AS expected_bars, n AS actual_bars, CAST(241 - n AS BIGINT) AS missing, n = 241 AS verified_contiguous, n > 0 AS renderable FROM x")
def top2_range_verdict(spark, sf):
    rows = bar_table(spark, sf)
    lo = rows.agg(F.min("open_time")).first()[0]
    _, verdict = paging.query_range(rows, {"symbol": "CLICK"}, "1h", lo, lo + 10 * DAY)
    return verdict.drop("missing_ranges")


@query("top2_missing_ranges", f"""WITH {HOURLY}, b AS (SELECT min(open_time) AS lo, max(open_time) AS hi FROM bars), w AS (SELECT unnest(range(lo, hi + 1, {HOUR})) AS t FROM b),
    g AS (SELECT t, t // {HOUR} - row_number() OVER (ORDER BY t) AS i FROM w WHERE t NOT IN (SELECT open_time FROM bars WHERE symbol = 'CLICK')) SELECT min(t) AS start, max(t) AS "end", count(*) AS bars FROM g GROUP BY i""")  # fmt: skip
def top2_missing_ranges(spark, sf):
    rows = bar_table(spark, sf)
    lo, hi = rows.agg(F.min("open_time"), F.max("open_time")).first()
    _, verdict = paging.query_range(rows, {"symbol": "CLICK"}, "1h", lo, hi)
    return verdict.select(F.explode("missing_ranges").alias("r")).select("r.start", "r.end", "r.bars")


@query("top2_holes", f"""WITH {HOURLY}, b AS (SELECT min(open_time) AS lo, max(open_time) AS hi FROM bars), w AS (SELECT DISTINCT symbol, unnest(range(lo, hi + 1, {HOUR})) AS t FROM bars, b),
    g AS (SELECT symbol, t, t // {HOUR} - row_number() OVER (PARTITION BY symbol ORDER BY t) AS i FROM w WHERE NOT EXISTS (SELECT 1 FROM bars WHERE bars.symbol = w.symbol AND open_time = t)) SELECT symbol, min(t) AS start, max(t) AS "end", count(*) AS bars FROM g GROUP BY symbol, i""")  # fmt: skip
def top2_holes(spark, sf):
    rows = bar_table(spark, sf)
    lo, hi = rows.agg(F.min("open_time"), F.max("open_time")).first()
    return paging.holes(rows, "1h", lo, hi).select("symbol", "start", "end", "bars")


@query("top4_before_page", f"WITH {HOURLY}, b AS (SELECT max(open_time) AS hi FROM bars) SELECT symbol, open_time, TRUE AS has_more FROM bars, b WHERE symbol = 'CLICK' AND open_time < hi - {DAY} ORDER BY open_time DESC LIMIT 30")
def top4_before_page(spark, sf):
    rows = bar_table(spark, sf)
    hi = rows.agg(F.max("open_time")).first()[0]
    return paging.query_before(rows, {"symbol": "CLICK"}, hi - DAY, 30).select("symbol", "open_time", "has_more")


@query("src3_normalize_raw", "SELECT event_id AS agg_trade_id, upper(event_type) AS symbol, value AS price, CAST(json_extract_string(props, '$.k') AS BIGINT) % 2 = 1 AS is_buyer_maker FROM events")
def src3_normalize_raw(spark, sf):
    k = F.get_json_object("props", "$.k").cast("bigint")
    body = F.to_json(F.struct(F.upper("event_type").alias("s"), F.col("event_id").alias("a"), F.col("value").cast("string").alias("p"), F.lit("1").alias("q"), (k % 2 == 1).alias("m")))
    rows = read(spark, sf, "events").select(F.lit("aggTrade").alias("kind"), F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), body.alias("payload"))
    return raw.normalize_raw_events(rows, "aggTrade")[0].select("agg_trade_id", "symbol", "price", "is_buyer_maker")


@query("jon10_fanout", f"WITH {HOURLY} SELECT symbol, open_time AS source_time, axis_order, close AS value FROM bars, (VALUES (0), (1)) t(axis_order)")
def jon10_fanout(spark, sf):
    rows = bar_table(spark, sf)
    series = rows.select(*SERIES, F.col("open_time").alias("time"), F.col("close").alias("value"), F.lit(1).alias("arrival"))
    axis = rows.select(*SERIES, F.col("open_time").alias("source_time"), F.explode(F.array(F.lit(0), F.lit(1))).alias("axis_order"))
    return joins.fanout(series, axis).select("symbol", "source_time", "axis_order", "value")
