"""Queries on metrics, merges, history plans and event records, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import scalars
from ..operators import bars, calendars, indicators, integrity, joins, paging
from ..schemas import SERIES
from ..sources import raw
from ..streaming import keyed
from .tables import DAY, HOUR, HOURLY, TRADES, bar_table, ms, read, trades

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


@query("sca25_sca29_scalars", """SELECT o_orderkey, CASE WHEN o_totalprice > 0 THEN round((o_totalprice - 100000) / 100000 * 10000, 6) END AS basis_bps, ((epoch_us(o_orderdate) // 1000) + 29999 + 30000) // 60000 * 60000 AS cycle,
    CASE WHEN w >= 86400000 THEN '1d' WHEN w >= 43200000 THEN '12h' WHEN w >= 21600000 THEN '6h' WHEN w >= 14400000 THEN '4h' WHEN w >= 7200000 THEN '2h' WHEN w >= 3600000 THEN '1h' WHEN w >= 1800000 THEN '30m' WHEN w >= 900000 THEN '15m' ELSE '5m' END AS period, o_orderstatus = 'F' AS closed
    FROM (SELECT *, o_custkey % 50 * 3600000 AS w FROM orders)""")  # fmt: skip
def sca25_sca29_scalars(spark, sf):
    rows = read(spark, sf, "orders").select("o_orderkey", "o_orderstatus", F.col("o_totalprice").alias("mark_price"), F.lit(100000.0).alias("index_price"), ms("o_orderdate").alias("t"), (F.col("o_custkey") % 50 * 3_600_000).alias("w"))
    rows = scalars.basis(rows)
    flag = F.when(F.col("o_orderstatus") == "F", " Closed ").otherwise("forming")
    return rows.select("o_orderkey", F.round("basis_bps", 6).alias("basis_bps"), scalars.funding_cycle(F.col("t") + 29_999).alias("cycle"), scalars.oi_period(F.col("w")).alias("period"), scalars.is_closed_col(flag).alias("closed"))


@query("sca1_sca16_identity", "SELECT c_custkey, upper(c_mktsegment) AS symbol, CASE c_nationkey % 4 WHEN 0 THEN 70 WHEN 1 THEN 100 WHEN 2 THEN 10 ELSE 0 END AS rank, c_nationkey % 4 < 2 AS final FROM customer WHERE c_custkey % 9 <> 0")
def sca1_sca16_identity(spark, sf):
    rows = read(spark, sf, "customer").select("c_custkey", "c_nationkey", F.lit(" SIM ").alias("exchange"), F.lit("Spot").alias("market_type"), F.when(F.col("c_custkey") % 9 == 0, "  ").otherwise(F.lower("c_mktsegment")).alias("symbol"))
    source = F.when(F.col("c_nationkey") % 4 == 0, "Backfill").when(F.col("c_nationkey") % 4 == 1, "repair_derived_verified").when(F.col("c_nationkey") % 4 == 2, "data_manager_closed").otherwise("other")
    return scalars.normalize_identity(rows).select("c_custkey", "symbol", scalars.source_rank(source).alias("rank"), scalars.source_final(source).alias("final"))


@query("sca28_funding_semantics", "SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'exchange_settlement' WHEN 1 THEN 'derived_history' ELSE 'exchange_realtime' END AS provenance, CASE o_orderkey % 4 WHEN 0 THEN 'final' WHEN 1 THEN 'estimated' WHEN 2 THEN 'stale' ELSE 'live' END AS quality, CASE o_orderkey % 4 WHEN 0 THEN 1 WHEN 1 THEN 2 ELSE 3 END AS sample_time FROM orders")
def sca28_funding_semantics(spark, sf):
    k = F.col("o_orderkey") % 4
    rows = read(spark, sf, "orders").select("o_orderkey", F.when(k == 1, "derived").alias("sample_kind"), (k == 0).alias("is_final"), (k == 2).alias("stale"), F.lit(False).alias("carried"), F.lit(1).alias("funding_time_ms"), F.lit(2).alias("event_time_ms"), F.lit(None).cast("int").alias("observed_at_ms"), F.lit(3).alias("received_at_ms"), F.lit(4).alias("target_funding_time_ms"), F.lit(5).alias("next_funding_time_ms"), F.lit(6).alias("funding_cycle_ms"))
    return scalars.funding_semantics(rows).select("o_orderkey", "provenance", "quality", "sample_time")


@query("jon12_alert_candidates", f"WITH {HOURLY} SELECT symbol, open_time, r AS rule_id FROM bars, (VALUES ('one', 'CLICK'), ('two', 'ERROR')) t(r, s) WHERE symbol = s")
def jon12_alert_candidates(spark, sf):
    rows = [("one", "n", True, ("sim", "spot", "click", "1h"), "bar_close", "{}", 0, None, None), ("two", "n", True, (None, None, "ERROR", None), "bar_close", "{}", 0, None, None), ("three", "n", False, (None, None, "ERROR", None), "bar_close", "{}", 0, None, None)]
    rules = spark.createDataFrame(rows, "id string, name string, enabled boolean, target struct<exchange:string,marketType:string,symbol:string,interval:string>, triggerOn string, expression string, cooldownMs bigint, expiresAt bigint, maxTriggers int")
    return joins.alert_candidates(rules, bar_table(spark, sf), "bar_close").select("symbol", "open_time", "rule_id")


@query("str13_alert_limits", f"""WITH RECURSIVE {HOURLY}, h AS (SELECT symbol, open_time + {HOUR} - 1 AS t FROM bars WHERE close > 50), f AS (SELECT symbol, min(t) AS t, 1 AS n FROM h GROUP BY symbol UNION ALL
    SELECT f.symbol, (SELECT min(h.t) FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR}), n + 1 FROM f WHERE n < 20 AND EXISTS (SELECT 1 FROM h WHERE h.symbol = f.symbol AND h.t >= f.t + {6 * HOUR})) SELECT symbol, t AS triggered_at_ms FROM f""")  # fmt: skip
def str13_alert_limits(spark, sf):
    rows = bar_table(spark, sf).where("close > 50").withColumns({"rule_id": F.lit("r"), "cooldownMs": F.lit(6 * HOUR), "maxTriggers": F.lit(20), "expiresAt": F.lit(None).cast("bigint")})
    return keyed.alerts_in_order(rows).select("symbol", "triggered_at_ms")


@query("top9_recent_alerts", f"WITH {HOURLY} SELECT symbol, open_time AS triggered_at_ms FROM bars ORDER BY open_time DESC, symbol DESC LIMIT 25")
def top9_recent_alerts(spark, sf):
    rows = bar_table(spark, sf).select("symbol", F.col("open_time").alias("triggered_at_ms"), F.col("symbol").alias("rule_id"))
    return paging.recent_alerts(rows, 25).select("symbol", "triggered_at_ms")


@query("top3_top7_history", f"WITH {HOURLY}, b AS (SELECT max(open_time) AS hi FROM bars) SELECT symbol, open_time FROM bars, b WHERE symbol = 'CLICK' AND open_time >= hi - CAST({2.5 * DAY} AS BIGINT) AND open_time <= hi - {HOUR} ORDER BY open_time LIMIT 40")
def top3_top7_history(spark, sf):
    rows = bar_table(spark, sf)
    hi = rows.agg(F.max("open_time")).first()[0]
    history = paging.query_history(rows, {"symbol": "CLICK"}, "1h", 2.5, hi)
    return paging.query_metric(history, {"exchange": "sim"}, "open_time", 0, hi, 40).select("symbol", "open_time")


def samples(spark, sf):
    rows = read(spark, sf, "orders")
    return rows.select(F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.col("o_orderpriority").alias("symbol"), (F.col("o_orderkey") % 500).alias("sample_time"), (F.col("o_custkey") % 3).alias("provenance_rank"), F.lit(1).alias("revision"), F.col("o_orderkey").alias("received_at_ms"), "o_orderkey")


@query("set1_merge_metric", "WITH r AS (SELECT o_orderpriority AS symbol, o_orderkey % 500 AS sample_time, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, o_orderkey % 500 ORDER BY o_custkey % 3 DESC, o_orderkey DESC) AS n FROM orders), t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY sample_time DESC) AS k FROM r WHERE n = 1) SELECT symbol, sample_time, o_orderkey FROM t WHERE k <= 100")
def set1_merge_metric(spark, sf):
    rows = samples(spark, sf)
    return integrity.merge_metric(rows.where("o_orderkey % 2 = 0"), rows.where("o_orderkey % 2 = 1"), 100).select("symbol", "sample_time", "o_orderkey")


@query("set2_src9_funding_merge", "SELECT symbol, cycle, o_orderkey FROM (SELECT o_orderpriority AS symbol, ((epoch_us(o_orderdate) // 1000) + 30000) // 60000 * 60000 AS cycle, o_orderkey, row_number() OVER (PARTITION BY o_orderpriority, (epoch_us(o_orderdate) // 1000) ORDER BY o_orderkey % 2 DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def set2_src9_funding_merge(spark, sf):
    rows = read(spark, sf, "orders").select(F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.col("o_orderpriority").alias("symbol"), ms("o_orderdate").alias("funding_time_ms"), (F.col("o_orderkey") % 2 == 1).alias("is_final"), F.col("o_orderkey").alias("received_at_ms"), "o_orderkey")
    return integrity.upsert_metric(rows.where("o_orderkey % 3 = 0"), rows.where("o_orderkey % 3 <> 0"), "funding").select("symbol", F.col("funding_cycle_ms").alias("cycle"), "o_orderkey")


@query("set3_merge_rollups", f"WITH {HOURLY} SELECT symbol, open_time, CASE WHEN (open_time // {HOUR}) % 2 = 0 THEN close ELSE close + 1 END AS close FROM bars")
def set3_merge_rollups(spark, sf):
    rows = bar_table(spark, sf).select(*SERIES, "open_time", "close", ((F.col("open_time") / HOUR).cast("bigint") % 2 == 0).alias("is_final"), F.lit(1).alias("updated_at_ms"), F.lit(1).alias("revision"))
    later = rows.withColumns({"close": F.col("close") + 1, "is_final": F.lit(False), "updated_at_ms": F.lit(2)})
    return integrity.merge_rollups(rows, later)[0].select("symbol", "open_time", "close")


@query("ded1_ded5_repeats", f"WITH {TRADES}, x AS (SELECT *, agg_trade_id - agg_trade_id % 2 * 3 AS id FROM trades), m AS (SELECT *, max(id) OVER (PARTITION BY symbol ORDER BY agg_trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM x) SELECT agg_trade_id, CASE WHEN seen IS NULL OR id > seen THEN 'accepted' WHEN id = seen THEN 'duplicate' ELSE 'stale' END AS verdict FROM m")
def ded1_ded5_repeats(spark, sf):
    rows = trades(spark, sf).withColumn("fingerprint", F.col("agg_trade_id").cast("string"))
    rows = integrity.dedupe_fingerprint(rows.union(rows)).withColumns({"last_update_id": F.col("agg_trade_id") - F.col("agg_trade_id") % 2 * 3, "arrival": F.col("agg_trade_id")})
    return integrity.accept_books(rows).select("agg_trade_id", "verdict")


@query("cal4_coarse_opens", f"WITH {HOURLY} SELECT 345600000 + CAST(floor((open_time - 345600000) / 604800000.0) AS BIGINT) * 604800000 AS bucket, min(open_time) AS open_time FROM bars GROUP BY ALL")
def cal4_coarse_opens(spark, sf):
    return calendars.coarse_opens(bar_table(spark, sf).select(F.col("open_time").alias("start")), "1w")


@query("cal5_excused_gaps", f"WITH {HOURLY}, g AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) + {HOUR} AS start, open_time - {HOUR} AS \"end\" FROM bars) SELECT symbol, start, \"end\", \"end\" = start AS excused FROM g WHERE start <= \"end\"")
def cal5_excused_gaps(spark, sf):
    rows = bar_table(spark, sf)
    spans = rows.groupBy(*SERIES).agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"))
    gaps = calendars.detect_gaps(rows, spans, "1h", 4_000_000_000_000)
    halts = gaps.withColumn("end", F.when(F.col("bars") == 1, F.col("end")).otherwise(F.col("end") - HOUR))
    return calendars.excused_gaps(gaps, halts).select("symbol", "start", "end", "excused")


@query("cal7_plan_history", f"WITH {HOURLY}, r AS (SELECT symbol, min(open_time) AS a, max(open_time) AS z FROM bars GROUP BY symbol) SELECT symbol, 'before_listing' AS reason, a - {DAY} AS start, a - 1 AS \"end\" FROM r UNION ALL SELECT symbol, 'after_delisting', z + 1, z + {DAY} FROM r")
def cal7_plan_history(spark, sf):
    spans = bar_table(spark, sf).groupBy(*SERIES).agg(F.min("open_time").alias("available_from"), F.max("open_time").alias("available_to")).withColumn("retained_from", F.lit(None).cast("bigint"))
    want = spans.select(*SERIES, (F.col("available_from") - DAY).alias("start"), (F.col("available_to") + DAY).alias("end"))
    return calendars.plan_history(want, spans, "1h", 4_000_000_000_000)[1].select("symbol", "reason", "start", "end")


@query("cal3_session_bucket_end", f"WITH {HOURLY} SELECT symbol, open_time, least(open_time + {4 * HOUR} - 1, open_time - open_time % {DAY} + {22 * HOUR} - 1) AS close_time FROM bars WHERE open_time % {DAY} < {22 * HOUR}")
def cal3_session_bucket_end(spark, sf):
    rows = bar_table(spark, sf).where(F.col("open_time") % DAY < 22 * HOUR).select("symbol", "open_time")
    day = (F.col("open_time") / DAY).cast("bigint") * DAY
    segments = rows.select(day.alias("start"), (day + 22 * HOUR - 1).alias("end")).distinct()
    return calendars.session_bucket_end(rows, segments, "4h").select("symbol", "open_time", "close_time")


@query("cal1_range_summary", f"WITH {HOURLY}, r AS (SELECT symbol, min(open_time) AS a, max(open_time) AS z FROM bars GROUP BY symbol) SELECT symbol, a AS first_open, z AS last_open, (z - a) // {HOUR} + 1 AS opens, z + {HOUR} AS next_open, a - {HOUR} AS previous_open FROM r")
def cal1_range_summary(spark, sf):
    spans = bar_table(spark, sf).groupBy("symbol").agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"))
    return calendars.range_summary(spans, "1h").select("symbol", "first_open", "last_open", "opens", "next_open", "previous_open")


@query("ind9_ind11_recompute", f"WITH {HOURLY}, m AS (SELECT symbol, open_time, CASE WHEN count(*) OVER w = 5 THEN round(avg(close) OVER w, 8) END AS ma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)) SELECT symbol, open_time, CASE WHEN symbol = 'CLICK' THEN ma END AS ma, FALSE AS provisional FROM m")
def ind9_ind11_recompute(spark, sf):
    rows = bar_table(spark, sf)
    mean = lambda b: indicators.preview(b, lambda x: indicators.ma(x, 5)).select(*SERIES, "open_time", F.round("ma", 8).alias("ma"), "provisional")
    old = mean(rows).withColumn("ma", F.lit(None).cast("double"))
    dirty = spark.createDataFrame([("sim", "spot", "CLICK")], "exchange string, market_type string, symbol string")
    return indicators.recompute(old, rows, dirty, mean).select("symbol", "open_time", "ma", "provisional")


@query("src4_decode_records", "SELECT event_id AS kafka_offset, CASE WHEN event_id % 5 = 0 THEN 'key' WHEN event_id % 7 = 0 THEN 'version_header' END AS reason FROM events")
def src4_decode_records(spark, sf):
    e = read(spark, sf, "events")
    body = F.to_json(F.struct(F.col("event_id").cast("string").alias("event_id"), F.lit("1").alias("version"), F.col("event_type").alias("stream_key"), ms("ts").alias("event_time_ms")))
    records = e.select(F.lit("t").alias("topic"), F.lit(0).alias("partition"), F.col("event_id").alias("offset"), F.when(F.col("event_id") % 5 == 0, "other").otherwise(F.col("event_type")).cast("binary").alias("key"), body.cast("binary").alias("value"), F.create_map(F.lit("event_id"), F.col("event_id").cast("string"), F.lit("version"), F.when(F.col("event_id") % 7 == 0, "2").otherwise("1")).alias("headers"))
    good, bad = raw.decode_event_records(records)
    return good.select("kafka_offset", F.lit(None).cast("string").alias("reason")).unionByName(bad.select(F.col("offset").alias("kafka_offset"), "reason"))


@query("str8_continuity", f"WITH {TRADES}, x AS (SELECT *, max(agg_trade_id) OVER (PARTITION BY symbol ORDER BY trade_time_ms, agg_trade_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS h FROM trades) SELECT symbol, h + 1 AS first_missing, agg_trade_id - 1 AS last_missing FROM x WHERE agg_trade_id > h + 1")
def str8_continuity(spark, sf):
    w = Window.partitionBy(*SERIES).orderBy("trade_time_ms", "agg_trade_id")
    rows = trades(spark, sf).withColumns({"sequence": F.col("agg_trade_id"), "arrival": F.row_number().over(w), "correction": F.lit(False)})
    return keyed.continuity_in_order(rows).select("symbol", "first_missing", "last_missing")


@query("str4_flow_in_order", f"WITH {TRADES} SELECT symbol, trade_time_ms // 60000 * 60000 AS open_time, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END), 8) AS buy_base, count(*) AS agg_count FROM trades GROUP BY ALL")
def str4_flow_in_order(spark, sf):
    return keyed.trade_flow_in_order(trades(spark, sf).withColumn("arrival", F.col("agg_trade_id"))).select("symbol", "open_time", F.round("buy_base", 8).alias("buy_base"), "agg_count")


@query("sca9_eligible_opens", f"SELECT event_id, t - t % {HOUR} - {HOUR} AS closed_open, least(t - t % {HOUR} - {HOUR}, 1704672000000) AS eligible FROM (SELECT event_id, (epoch_us(ts) // 1000) AS t FROM events)")
def sca9_eligible_opens(spark, sf):
    rows = read(spark, sf, "events").select("event_id", ms("ts").alias("t"))
    return rows.select("event_id", iv.last_closed_open(F.col("t"), "1h").alias("closed_open"), iv.latest_eligible_open(F.col("t"), F.lit(1704672000000), "1h").alias("eligible"))


@query("udf2_udf3_own_bars", f"WITH {TRADES} SELECT symbol, trade_time_ms // 5000000 * 5000000 AS open_time, max(price) AS high, count(*) AS n FROM trades GROUP BY ALL")
def udf2_udf3_own_bars(spark, sf):
    own = bars.bars_from_trades(trades(spark, sf), "1h", bucket=lambda t: F.floor(t / 5_000_000) * 5_000_000, extra_aggs=[F.count("*").alias("n")])
    return own.select("symbol", "open_time", "high", "n")
