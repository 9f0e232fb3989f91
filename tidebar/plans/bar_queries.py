"""Queries on trades and bars, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import scalars
from ..operators import bars, flow, indicators, paging, ranges
from .tables import DAILY, DAY, HOUR, HOURLY, LINE_TRADES, OUT, OUT_COLUMNS, TRADES, S, bar_table, bars_sql, line_trades, ms, read, trades

W = f"PARTITION BY {S} ORDER BY open_time"
QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


FLOW_SQL = """flow AS (SELECT *, CASE WHEN taker_buy_base <= volume + greatest(1e-10, volume * 1e-10) AND NOT (volume > 0 AND quote_volume = 0) THEN least(taker_buy_base, volume) END AS buy FROM bars)"""


@query("flagship", f"""WITH {HOURLY}, {FLOW_SQL}
    SELECT symbol, open_time, close, volume, round(volume - buy, 8) AS taker_sell_base, round(2 * buy - volume, 8) AS volume_delta_base, CASE WHEN volume > 0 THEN round(buy / volume, 8) END AS taker_buy_ratio_base,
    CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 8) END AS ma20 FROM flow WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def flagship(spark, sf):
    rows = indicators.ma(scalars.enrich_order_flow(bar_table(spark, sf)), 20, name="ma20")
    return rows.select("symbol", "open_time", "close", "volume", "taker_sell_base", "volume_delta_base", "taker_buy_ratio_base", F.round("ma20", 8).alias("ma20"))


@query("agg1_bars_1h", f"WITH {HOURLY} SELECT {OUT} FROM bars")
def agg1_bars_1h(spark, sf):
    return bar_table(spark, sf).select(*OUT_COLUMNS)


@query("agg1_bars_1w_lines", f"""WITH {LINE_TRADES}, {bars_sql("345600000 + CAST(floor((trade_time_ms - 345600000) / 604800000.0) AS BIGINT) * 604800000")}
    SELECT symbol, open_time, open, high, low, close, volume, trades, taker_buy_base FROM bars""")  # fmt: skip
def agg1_bars_1w_lines(spark, sf):
    return bars.bars_from_trades(line_trades(spark, sf), "1w").select("symbol", "open_time", "open", "high", "low", "close", "volume", "trades", "taker_buy_base")


MONTH = "epoch_ms(make_timestamp(CAST(1970 + m // 12 AS BIGINT), CAST(m % 12 + 1 AS BIGINT), 1, 0, 0, 0.0))"


@query("agg1_bars_5mo_lines", f"""WITH {LINE_TRADES.replace("FROM lineitem)", ", ((year(l_shipdate) - 1970) * 12 + month(l_shipdate) - 1) // 5 * 5 AS m FROM lineitem)")}
    SELECT symbol, {MONTH} AS open_time, first(price ORDER BY trade_time_ms, agg_trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY trade_time_ms, agg_trade_id) AS close, round(sum(quantity), 8) AS volume FROM trades GROUP BY symbol, m""")  # fmt: skip
def agg1_bars_5mo_lines(spark, sf):
    return bars.bars_from_trades(line_trades(spark, sf), "5M").select("symbol", "open_time", "open", "high", "low", "close", "volume")


@query("agg2_fill_silent", f"""WITH {HOURLY}, r AS (SELECT symbol, min(open_time) AS a, max(open_time) AS b FROM bars GROUP BY symbol),
    g AS (SELECT symbol, unnest(range(a, b + 1, {HOUR})) AS open_time FROM r)
    SELECT g.symbol, g.open_time, coalesce(bars.open, last_value(bars.close IGNORE NULLS) OVER w) AS open, last_value(bars.close IGNORE NULLS) OVER w AS close, coalesce(bars.volume, 0.0) AS volume, bars.open IS NULL AS filled
    FROM g LEFT JOIN bars USING (symbol, open_time) WINDOW w AS (PARTITION BY g.symbol ORDER BY g.open_time)""")  # fmt: skip
def agg2_fill_silent(spark, sf):
    return bars.fill_silent_bars(bar_table(spark, sf), "1h").select("symbol", "open_time", "open", "close", "volume", "filled")


LATE = 4_000_000_000_000


@query("agg3_resample_4h", f"""WITH {HOURLY} SELECT symbol, open_time - open_time % {4 * HOUR} AS bucket, first(open ORDER BY open_time) AS open, max(high) AS high, min(low) AS low, last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume, CAST(sum(trades) AS BIGINT) AS trades
    FROM bars GROUP BY ALL HAVING count(*) = 4""")  # fmt: skip
def agg3_resample_4h(spark, sf):
    return bars.resample_bars(bar_table(spark, sf), "1h", "4h", LATE).select("symbol", F.col("open_time").alias("bucket"), "open", "high", "low", "close", "volume", "trades")


@query("agg4_resample_month", f"""WITH {DAILY}, x AS (SELECT *, date_trunc('month', epoch_ms(open_time)) AS m FROM bars),
    y AS (SELECT *, CASE WHEN lag(open_time) OVER w IS NULL THEN epoch_ms(m) = open_time ELSE lag(open_time) OVER w = open_time - {DAY} END AS follows FROM x WINDOW w AS (PARTITION BY {S}, m ORDER BY open_time))
    SELECT symbol, epoch_ms(m) AS open_time, first(open ORDER BY open_time) AS open, last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume, CASE WHEN bool_and(follows) THEN CAST(sum(trades) AS BIGINT) END AS trades,
    bool_and(follows) AND max(open_time) + {DAY} = epoch_ms(m + INTERVAL 1 MONTH) AS is_closed FROM y GROUP BY symbol, m""")  # fmt: skip
def agg4_resample_month(spark, sf):
    return bars.resample_bars_months(bar_table(spark, sf, "1d"), "1d", "1M", LATE).select("symbol", "open_time", "open", "close", "volume", "trades", "is_closed")


@query("agg5_merge_components", f"""WITH {HOURLY} SELECT symbol, open_time - open_time % {DAY} AS open_time, first(open ORDER BY open_time) AS open, last(close ORDER BY open_time) AS close, round(sum(volume), 8) AS volume, CAST(sum(trades) AS BIGINT) AS tick_count, count(*) / 24.0 AS coverage
    FROM bars GROUP BY symbol, open_time - open_time % {DAY}""")  # fmt: skip
def agg5_merge_components(spark, sf):
    rows = bar_table(spark, sf).withColumn("tick_count", F.col("trades"))
    half = rows.withColumns({"sequence": F.lit(1), "volume": F.col("volume") / 2, "tick_count": F.lit(1).cast("bigint"), "close": F.col("open")})
    both = half.unionByName(rows.withColumn("sequence", F.lit(2)))
    return bars.merge_components(both, "1d").select("symbol", "open_time", "open", "close", "volume", "tick_count", "coverage")


RAW_SQL = f"{TRADES}, r AS (SELECT *, price * quantity AS quote, NOT is_buyer_maker AS buy FROM trades)"
GAPS_SQL = f"g0 AS (SELECT {S}, agg_trade_id AS id, trade_time_ms, lag(agg_trade_id) OVER w AS left_id, lag(trade_time_ms) OVER w AS left_time_ms FROM trades WINDOW w AS (PARTITION BY {S} ORDER BY agg_trade_id)), gaps AS (SELECT * FROM g0 WHERE id > left_id + 1)"


@query("win9_id_gaps", f"WITH {TRADES}, {GAPS_SQL} SELECT symbol, left_id + 1 AS first_missing, id - 1 AS last_missing, id - left_id - 1 AS missing, left_time_ms, trade_time_ms AS right_time_ms FROM gaps")
def win9_id_gaps(spark, sf):
    return flow.id_gaps(trades(spark, sf)).drop("exchange", "market_type")


def dense(spark, sf):
    """Trades with ids without holes, but for every 97th."""
    from pyspark.sql import Window

    n = F.row_number().over(Window.partitionBy("symbol").orderBy("agg_trade_id"))
    return trades(spark, sf).withColumn("agg_trade_id", n.cast("bigint")).where("agg_trade_id % 97 <> 0")


DENSE = TRADES.replace("trades AS (", "t0 AS (", 1) + ", trades AS (SELECT * EXCLUDE (n) REPLACE (n AS agg_trade_id) FROM (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY agg_trade_id) AS n FROM t0) WHERE n % 97 <> 0)"


@query("agg6_trade_flow_1m", f"""WITH {DENSE}, {GAPS_SQL}, t AS (SELECT DISTINCT symbol, unnest(range(left_time_ms - left_time_ms % 60000, trade_time_ms - trade_time_ms % 60000 + 1, 60000)) AS open_time FROM gaps),
    f AS (SELECT symbol, trade_time_ms - trade_time_ms % 60000 AS open_time, round(sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END), 12) AS buy_base, round(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 12) AS sell_base, count(*) AS agg_count, CAST(sum(last_trade_id - first_trade_id + 1) AS BIGINT) AS raw_count, max(price * quantity) AS max_notional FROM trades GROUP BY ALL)
    SELECT f.*, round(buy_base - sell_base, 12) AS delta_base, t.symbol IS NULL AND f.open_time > min(f.open_time) OVER (PARTITION BY f.symbol) AS is_complete FROM f LEFT JOIN t ON f.symbol = t.symbol AND f.open_time = t.open_time""")  # fmt: skip
def agg6_trade_flow_1m(spark, sf):
    return flow.trade_flow_1m(dense(spark, sf)).select("symbol", "open_time", "buy_base", "sell_base", "agg_count", "raw_count", "max_notional", "delta_base", "is_complete")


@query("win2_cvd_from_flow", f"""WITH {DENSE}, {GAPS_SQL}, t AS (SELECT DISTINCT symbol, unnest(range(left_time_ms - left_time_ms % 60000, trade_time_ms - trade_time_ms % 60000 + 1, 60000)) AS open_time FROM gaps),
    f AS (SELECT symbol, trade_time_ms - trade_time_ms % 60000 AS open_time, sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE -quantity END) AS d FROM trades GROUP BY ALL),
    c AS (SELECT f.*, t.symbol IS NULL AND f.open_time > min(f.open_time) OVER (PARTITION BY f.symbol) AS ok FROM f LEFT JOIN t ON f.symbol = t.symbol AND f.open_time = t.open_time),
    i AS (SELECT *, CASE WHEN ok AND coalesce(lag(ok) OVER w, FALSE) AND open_time = lag(open_time) OVER w + 60000 THEN 0 ELSE 1 END AS b FROM c WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    j AS (SELECT *, sum(b) OVER (PARTITION BY symbol ORDER BY open_time) AS island FROM i)
    SELECT symbol, open_time, CASE WHEN ok THEN round(sum(d) OVER (PARTITION BY symbol, island ORDER BY open_time), 8) END AS cvd FROM j""")  # fmt: skip
def win2_cvd_from_flow(spark, sf):
    return flow.cvd_from_flow(flow.trade_flow_1m(dense(spark, sf))).select("symbol", "open_time", "cvd")


@query("agg11_tape_stats", f"WITH {RAW_SQL} SELECT symbol, round(sum(CASE WHEN buy THEN quote ELSE 0 END), 8) AS buy_quote, round(sum(CASE WHEN NOT buy THEN quote ELSE 0 END), 8) AS sell_quote, count(*) AS n, max(quote) AS max_notional, max(agg_trade_id) - min(agg_trade_id) + 1 = count(DISTINCT agg_trade_id) AS continuous FROM r GROUP BY symbol")
def agg11_tape_stats(spark, sf):
    return flow.tape_stats(trades(spark, sf)).select("symbol", "buy_quote", "sell_quote", "n", "max_notional", "continuous")


@query("agg14_audit_trades", f"""WITH {TRADES}, b AS (SELECT min(trade_time_ms) AS a, max(trade_time_ms) + 1 AS z FROM trades), x AS (SELECT *, trade_time_ms - trade_time_ms % {DAY} AS day_ms, lag(agg_trade_id) OVER (PARTITION BY symbol ORDER BY agg_trade_id, trade_time_ms) AS p FROM trades),
    f AS (SELECT symbol, day_ms, count(*) AS rows, min(agg_trade_id) AS first_id, max(agg_trade_id) AS last_id, CAST(coalesce(sum(greatest(agg_trade_id - p - 1, 0)), 0) AS BIGINT) AS missing_ids, count(*) FILTER (agg_trade_id = p) AS repeats FROM x GROUP BY ALL),
    d AS (SELECT DISTINCT symbol, unnest(range((SELECT a - a % {DAY} FROM b), (SELECT z FROM b), {DAY})) AS day_ms FROM trades)
    SELECT d.symbol, d.day_ms, coalesce(rows, 0) AS rows, first_id, last_id, coalesce(missing_ids, 0) AS missing_ids, coalesce(repeats, 0) AS repeats, coalesce(rows > 0 AND missing_ids = 0 AND repeats = 0, FALSE) AS exact FROM d LEFT JOIN f USING (symbol, day_ms)""")  # fmt: skip
def agg14_audit_trades(spark, sf):
    rows = trades(spark, sf)
    lo, hi = rows.agg(F.min("trade_time_ms"), F.max("trade_time_ms")).first()
    return flow.audit_trades(rows, lo, hi + 1).select("symbol", "day_ms", "rows", "first_id", "last_id", "missing_ids", "repeats", "exact")


@query("agg12_bounds", f"WITH {HOURLY} SELECT symbol, min(open_time) AS first_ms, max(open_time) AS last_ms, count(*) AS n, TRUE AS all_complete FROM bars GROUP BY symbol")
def agg12_bounds(spark, sf):
    return paging.series_bounds(bar_table(spark, sf), ["symbol"])


@query("agg15_scan_movers", f"WITH {HOURLY}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM bars), m AS (SELECT symbol, first(close ORDER BY open_time) AS first_close, last(close ORDER BY open_time) AS last_close FROM l WHERE n <= 24 GROUP BY symbol) SELECT *, round((last_close - first_close) / first_close * 100, 8) AS move_pct FROM m WHERE abs(round((last_close - first_close) / first_close * 100, 8)) >= 1")
def agg15_scan_movers(spark, sf):
    return paging.scan_movers(bar_table(spark, sf), 24, 1.0).select("symbol", "first_close", "last_close", "move_pct")


@query("agg16_performance", "SELECT o_orderpriority AS symbol, count(*) AS closed, count(*) FILTER (p > 0) AS wins, count(*) FILTER (p < 0) AS losses, round(count(*) FILTER (p > 0) / count(*), 8) AS win_rate, round(CAST(sum(p) FILTER (p > 0) AS DOUBLE) / CAST(-sum(p) FILTER (p < 0) AS DOUBLE), 8) AS profit_factor FROM (SELECT *, CAST(o_totalprice - 150000 AS DECIMAL(28,8)) AS p FROM orders) GROUP BY ALL")
def agg16_performance(spark, sf):
    rows = read(spark, sf, "orders").select(F.col("o_orderpriority").alias("symbol"), (F.col("o_totalprice") - 150000).alias("profit"))
    return flow.performance(rows, ["symbol"]).select("symbol", "closed", "wins", "losses", "win_rate", "profit_factor")


@query("win11_max_drawdown", f"WITH {HOURLY}, p AS (SELECT symbol, max(close) OVER (PARTITION BY symbol ORDER BY open_time) - close AS fall FROM bars) SELECT symbol, round(max(fall), 8) AS max_drawdown FROM p GROUP BY symbol")
def win11_max_drawdown(spark, sf):
    return flow.max_drawdown(bar_table(spark, sf), ["symbol"], "open_time", "close")


@query("agg18_list_series", f"WITH {HOURLY} SELECT symbol, '1h' AS interval, count(*) AS n, min(open_time) AS earliest, max(open_time) AS latest FROM bars GROUP BY symbol")
def agg18_list_series(spark, sf):
    return paging.list_series(bar_table(spark, sf)).drop("exchange", "market_type")


@query("win1_cvd", f"""WITH {HOURLY}, f AS (SELECT *, round(2 * taker_buy_base - volume, 8) AS d, CASE WHEN lag(open_time) OVER w = open_time - {HOUR} THEN 0 ELSE 1 END AS b FROM bars WINDOW w AS ({W})), i AS (SELECT *, sum(b) OVER ({W}) AS island FROM f),
    l AS (SELECT *, max(island) OVER (PARTITION BY symbol) AS last_island FROM i) SELECT symbol, open_time, d AS delta, round(sum(d) OVER ({W}), 8) AS cvd, CAST(last_island - 1 AS BIGINT) AS discontinuities FROM l WHERE island = last_island""")  # fmt: skip
def win1_cvd(spark, sf):
    return flow.cvd(bar_table(spark, sf), "1h").select("symbol", "open_time", "delta", "cvd", "discontinuities")


@query("win7_segments", f"WITH {HOURLY}, f AS (SELECT *, CASE WHEN lag(open_time) OVER w = open_time - {HOUR} THEN 0 ELSE 1 END AS b FROM bars WINDOW w AS ({W})), i AS (SELECT *, sum(b) OVER ({W}) AS segment FROM f) SELECT symbol, CAST(segment AS BIGINT) AS segment, min(open_time) AS start, max(open_time) AS \"end\", count(*) AS rows FROM i GROUP BY symbol, segment")
def win7_segments(spark, sf):
    return ranges.segments(bar_table(spark, sf), "1h").drop("exchange", "market_type")


@query("win8_eligible_windows", f"""WITH {HOURLY}, f AS (SELECT *, CASE WHEN lag(open_time) OVER w = open_time - {HOUR} THEN 0 ELSE 1 END AS b FROM bars WINDOW w AS ({W})), i AS (SELECT *, sum(b) OVER ({W}) AS segment FROM f), s AS (SELECT symbol, min(open_time) AS a, max(open_time) AS z FROM i GROUP BY symbol, segment),
    e AS (SELECT symbol, a AS start, a + 2 * {HOUR} AS first, z - {HOUR} AS last FROM s WHERE a + 2 * {HOUR} <= z - {HOUR}) SELECT *, (last - first) // {HOUR} + 1 AS windows, CAST(sum((last - first) // {HOUR} + 1) OVER (PARTITION BY symbol ORDER BY start) AS BIGINT) AS upto FROM e""")  # fmt: skip
def win8_eligible_windows(spark, sf):
    return ranges.eligible_windows(bar_table(spark, sf), "1h", 2, 2).select("symbol", "start", "first", "last", "windows", "upto")


@query("win4_win5_crosses", f"""WITH {HOURLY}, m AS (SELECT *, avg(close) OVER ({W} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS a, row_number() OVER ({W}) AS n FROM bars), x AS (SELECT *, CASE WHEN n >= 5 THEN a END AS ma FROM m), y AS (SELECT *, lag(close) OVER ({W}) AS c0, lag(ma) OVER ({W}) AS m0 FROM x)
    SELECT symbol, open_time, coalesce(c0 <= m0 AND close > ma, FALSE) AS crosses_above, coalesce(c0 >= m0 AND close < ma, FALSE) AS crosses_below, CASE WHEN c0 <> 0 THEN round((close - c0) / abs(c0) * 100, 8) END AS pct_change FROM y""")  # fmt: skip
def win4_win5_crosses(spark, sf):
    rows = indicators.pct_change(indicators.crosses(indicators.ma(bar_table(spark, sf), 5), "close", "ma"))
    return rows.select("symbol", "open_time", "crosses_above", "crosses_below", F.round("pct_change", 8).alias("pct_change"))


@query("ind2_boll", f"""WITH {HOURLY} SELECT symbol, open_time, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w, 6) END AS mid, CASE WHEN count(*) OVER w = 20 THEN round(avg(close) OVER w + 2 * sqrt(greatest(avg(close * close) OVER w - avg(close) OVER w * avg(close) OVER w, 0)), 6) END AS up
    FROM bars WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def ind2_boll(spark, sf):
    return indicators.boll(bar_table(spark, sf)).select("symbol", "open_time", F.round("boll_mid", 6).alias("mid"), F.round("boll_up", 6).alias("up"))


NUMBERED = f"{HOURLY}, n AS (SELECT *, row_number() OVER ({W}) AS i FROM bars)"


def recursion(values: str, name: str, n: int, alpha: float, first: int = 1, extra: str = "") -> str:
    """A recursive CTE: seeded by the mean of n values from row `first`, then alpha x + (1 - alpha) y."""
    return f"""{name}_s AS (SELECT symbol, avg({values}) AS y FROM {extra or 'n'} WHERE i BETWEEN {first} AND {first + n - 1} GROUP BY symbol HAVING count({values}) = {n}),
    {name} AS (SELECT symbol, CAST({first + n - 1} AS BIGINT) AS i, y FROM {name}_s UNION ALL SELECT n.symbol, n.i, {alpha!r} * n.{values} + {1 - alpha!r} * {name}.y FROM {name} JOIN {extra or 'n'} AS n ON n.symbol = {name}.symbol AND n.i = {name}.i + 1)"""


@query("ind3_ema", f"WITH RECURSIVE {NUMBERED}, {recursion('close', 'e', 12, 2 / 13)} SELECT n.symbol, n.open_time, round(e.y, 6) AS ema FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i")
def ind3_ema(spark, sf):
    return indicators.ema(bar_table(spark, sf), 12).select("symbol", "open_time", F.round("ema", 6).alias("ema"))


@query("ind4_macd", f"""WITH RECURSIVE {NUMBERED}, {recursion('close', 'f', 12, 2 / 13)}, {recursion('close', 's', 26, 2 / 27)}, d AS (SELECT f.symbol, f.i, f.y - s.y AS dif FROM f JOIN s ON f.symbol = s.symbol AND f.i = s.i), {recursion('dif', 'g', 9, 0.2, 26, 'd')}
    SELECT n.symbol, n.open_time, round(d.dif, 6) AS dif, round(g.y, 6) AS dea, round(2 * (d.dif - g.y), 6) AS hist FROM n LEFT JOIN d ON n.symbol = d.symbol AND n.i = d.i LEFT JOIN g ON n.symbol = g.symbol AND n.i = g.i""")  # fmt: skip
def ind4_macd(spark, sf):
    return indicators.macd(bar_table(spark, sf)).select("symbol", "open_time", *[F.round(c, 6).alias(c) for c in ("dif", "dea", "hist")])


CHANGES = f"{NUMBERED}, c AS (SELECT symbol, i, greatest(close - lag(close) OVER (PARTITION BY symbol ORDER BY i), 0) AS up, greatest(lag(close) OVER (PARTITION BY symbol ORDER BY i) - close, 0) AS down FROM n)"


@query("ind5_rsi", f"""WITH RECURSIVE {CHANGES}, {recursion('up', 'u', 14, 1 / 14, 2, 'c')}, {recursion('down', 'd', 14, 1 / 14, 2, 'c')}
    SELECT n.symbol, n.open_time, round(CASE WHEN d.y = 0 THEN 100 ELSE 100 - 100 / (1 + u.y / d.y) END, 6) AS rsi FROM n LEFT JOIN u ON n.symbol = u.symbol AND n.i = u.i LEFT JOIN d ON n.symbol = d.symbol AND n.i = d.i""")  # fmt: skip
def ind5_rsi(spark, sf):
    return indicators.rsi(bar_table(spark, sf)).select("symbol", "open_time", F.round("rsi", 6).alias("rsi"))


TR = f"{NUMBERED}, t AS (SELECT symbol, i, open_time, CASE WHEN i = 1 THEN high - low ELSE greatest(high - low, abs(high - lag(close) OVER w), abs(low - lag(close) OVER w)) END AS tr FROM n WINDOW w AS (PARTITION BY symbol ORDER BY i))"


@query("ind6_atr", f"WITH RECURSIVE {TR}, {recursion('tr', 'a', 14, 1 / 14, 1, 't')} SELECT t.symbol, t.open_time, round(a.y, 6) AS atr FROM t LEFT JOIN a ON t.symbol = a.symbol AND t.i = a.i")
def ind6_atr(spark, sf):
    return indicators.atr(bar_table(spark, sf)).select("symbol", "open_time", F.round("atr", 6).alias("atr"))


@query("ind7_ind8_vol_tr", f"WITH {TR} SELECT t.symbol, t.open_time, round(t.tr, 8) AS tr, n.volume AS vol, n.close >= n.open AS vol_up FROM t JOIN n ON t.symbol = n.symbol AND t.i = n.i")
def ind7_ind8_vol_tr(spark, sf):
    return indicators.vol(indicators.true_range(bar_table(spark, sf))).select("symbol", "open_time", F.round("tr", 8).alias("tr"), "vol", "vol_up")


@query("ind10_chain", f"""WITH RECURSIVE {NUMBERED}, {recursion('close', 'e', 12, 2 / 13)}, z AS (SELECT n.symbol, n.open_time, coalesce(e.y, 0.0) AS v FROM n LEFT JOIN e ON n.symbol = e.symbol AND n.i = e.i)
    SELECT symbol, open_time, CASE WHEN count(*) OVER w = 5 THEN round(avg(v) OVER w, 6) END AS ma_of_ema FROM z WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""")  # fmt: skip
def ind10_chain(spark, sf):
    rows = indicators.chain(bar_table(spark, sf), [{"id": "m", "name": "ma", "params": {"n": 5}, "after": "e", "field": "ema"}, {"id": "e", "name": "ema", "params": {"n": 12}}])
    return rows.select("symbol", "open_time", F.round("m_ma", 6).alias("ma_of_ema"))


@query("ind12_ind13_range", f"""WITH {HOURLY}, b AS (SELECT min(open_time) + 10 * {DAY} AS a, min(open_time) + 20 * {DAY} AS z FROM bars), x AS (SELECT symbol, open_time, avg(close) OVER w AS a, count(*) OVER w AS n FROM bars WHERE open_time <= (SELECT z FROM b) AND open_time >= (SELECT a - 19 * {HOUR} FROM b) WINDOW w AS ({W} ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
    SELECT symbol, open_time, CASE WHEN n = 20 THEN round(a, 8) END AS ma FROM x WHERE open_time >= (SELECT a FROM b)""")  # fmt: skip
def ind12_ind13_range(spark, sf):
    rows = bar_table(spark, sf)
    lo = rows.agg(F.min("open_time")).first()[0]
    return indicators.sma_query(rows, 20, lo + 10 * DAY, lo + 20 * DAY, HOUR).select("symbol", "open_time", F.round("ma", 8).alias("ma"))


@query("prj1_heikin_ashi", f"""WITH RECURSIVE {NUMBERED}, h AS (SELECT symbol, CAST(1 AS BIGINT) AS i, (open + close) / 2 AS ho, (open + high + low + close) / 4 AS hc FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.i, (h.ho + h.hc) / 2, (n.open + n.high + n.low + n.close) / 4 FROM h JOIN n ON n.symbol = h.symbol AND n.i = h.i + 1)
    SELECT n.symbol, n.open_time, round(ho + 1e-9, 6) AS ha_open, round(greatest(high, ho, hc) + 1e-9, 6) AS ha_high, round(least(low, ho, hc) + 1e-9, 6) AS ha_low, round(hc + 1e-9, 6) AS ha_close FROM n JOIN h ON n.symbol = h.symbol AND n.i = h.i""")  # fmt: skip
def prj1_heikin_ashi(spark, sf):
    rows = indicators.heikin_ashi(bar_table(spark, sf))
    return rows.select("symbol", "open_time", *[F.round(F.col(f"ha_{c}") + 1e-9, 6).alias(f"ha_{c}") for c in ("open", "high", "low", "close")])


@query("top1_latest", f"WITH {HOURLY}, l AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY open_time DESC) AS n FROM bars) SELECT symbol, open_time, close FROM l WHERE n <= 50")
def top1_latest(spark, sf):
    return paging.latest(bar_table(spark, sf), 50).select("symbol", "open_time", "close")


@query("sca_buckets", "SELECT event_id, t - t % 420000 AS b7m, 345600000 + CAST(floor((t - 345600000) / 1209600000.0) AS BIGINT) * 1209600000 AS b2w, epoch_ms(make_timestamp(CAST(1970 + m // 12 AS BIGINT), CAST(m % 12 + 1 AS BIGINT), 1, 0, 0, 0.0)) AS b7mo FROM (SELECT event_id, (epoch_us(ts) // 1000) AS t, ((year(ts) - 1970) * 12 + month(ts) - 1) // 7 * 7 AS m FROM events)")
def sca_buckets(spark, sf):
    rows = read(spark, sf, "events").select("event_id", ms("ts").alias("t"))
    return rows.select("event_id", iv.bucket_floor(F.col("t"), "7m").alias("b7m"), iv.bucket_floor(F.col("t"), "2w").alias("b2w"), iv.bucket_floor(F.col("t"), "7M").alias("b7mo"))


@query("sca7_sca10_months", "SELECT o_orderkey, epoch_ms(date_trunc('month', o_orderdate) + INTERVAL 1 MONTH) AS next_month, epoch_ms(date_trunc('month', o_orderdate)) AS this_month, epoch_ms(o_orderdate + INTERVAL 1 MONTH) AS plus_one FROM orders")
def sca7_sca10_months(spark, sf):
    t = F.col("t")
    rows = read(spark, sf, "orders").select("o_orderkey", ms("o_orderdate").alias("t"))
    start = iv.bucket_floor(t, "1M")
    return rows.select("o_orderkey", iv.bucket_next(start, "1M").alias("next_month"), start.alias("this_month"), iv.add_months_ms(t, 1).alias("plus_one"))


@query("sca13_tape", f"WITH {RAW_SQL} SELECT agg_trade_id, quote AS quote_quantity, CASE WHEN buy THEN 'buy' ELSE 'sell' END AS side, last_trade_id - first_trade_id + 1 AS raw_count, CASE WHEN buy THEN quantity ELSE -quantity END AS cvd_delta FROM r")
def sca13_tape(spark, sf):
    return scalars.tape(trades(spark, sf)).select("agg_trade_id", "quote_quantity", "side", "raw_count", "cvd_delta")


@query("sca12_price_sources", f"WITH {HOURLY} SELECT symbol, open_time, round((high + low) / 2, 8) AS hl2, round((high + low + close) / 3, 8) AS hlc3, round((open + high + low + close) / 4, 8) AS ohlc4, round((high + low + 2 * close) / 4, 8) AS hlcc4 FROM bars")
def sca12_price_sources(spark, sf):
    return bar_table(spark, sf).select("symbol", "open_time", *[F.round(scalars.price_source(c), 8).alias(c) for c in ("hl2", "hlc3", "ohlc4", "hlcc4")])


@query("sca17_validate_bars", f"WITH {HOURLY} SELECT symbol, open_time, concat_ws(',', CASE WHEN open_time % {2 * HOUR} <> 0 THEN 'alignment' END, CASE WHEN NOT (open > 0 AND high > 0 AND low > 0 AND close > 0) THEN 'price' END) AS reasons FROM bars")
def sca17_validate_bars(spark, sf):
    rows = bar_table(spark, sf).withColumn("close_time", F.col("open_time") + 2 * HOUR - 1)
    return scalars.validate_bars(rows, 2 * HOUR, LATE).select("symbol", "open_time", F.array_join("reasons", ",").alias("reasons"))


@query("sca18_validate_trades", f"WITH {TRADES} SELECT count(*) AS n, count(*) FILTER (price > 0 AND quantity > 0) AS good FROM trades")
def sca18_validate_trades(spark, sf):
    return scalars.validate_trades(trades(spark, sf)).agg(F.count("*").alias("n"), F.count_if(F.size("reasons") == 0).alias("good"))


@query("sca22_sca23_ticks", "WITH t AS (SELECT l_returnflag AS symbol, max(length(regexp_extract(regexp_replace(printf('%.8f', round(l_extendedprice, 8)), '0+$', ''), '\\.([0-9]*)$', 1))) AS places FROM lineitem GROUP BY ALL) SELECT symbol, CAST(places AS INTEGER) AS places, round(pow(10, -places), 8) AS tick FROM t")
def sca22_sca23_ticks(spark, sf):
    return scalars.infer_tick(read(spark, sf, "lineitem").withColumn("symbol", F.col("l_returnflag")), ["symbol"], "l_extendedprice")


@query("sca30_search_symbols", "SELECT p_partkey, upper(p_name) AS symbol FROM part WHERE contains(upper(p_name), 'RED') OR contains(upper(p_brand), 'RED') OR contains(upper(p_type), 'RED')")
def sca30_search_symbols(spark, sf):
    rows = read(spark, sf, "part").select("p_partkey", F.upper("p_name").alias("symbol"), F.col("p_brand").alias("base_asset"), F.col("p_type").alias("quote_asset"))
    return scalars.search_symbols(rows, "red").select("p_partkey", "symbol")


@query("sca36_marker_size", f"WITH {RAW_SQL} SELECT agg_trade_id, round(greatest(1.0, least(3.2, 1 + log10(greatest(1.0, quote / 100)) * 0.9)), 8) AS size FROM r")
def sca36_marker_size(spark, sf):
    rows = scalars.enrich_trades(trades(spark, sf))
    return rows.select("agg_trade_id", F.round(scalars.marker_size(F.col("quote_quantity"), 100.0), 8).alias("size"))
