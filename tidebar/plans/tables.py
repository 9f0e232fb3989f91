"""The library's tables, derived from the given ones, and the same derivations in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bars

HOUR, DAY = 3_600_000, 86_400_000


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table. Bucket arithmetic counts in UTC, so the session is set to it."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ms(column: str):
    """Epoch milliseconds of a timestamp with or without a zone."""
    return F.unix_millis(F.col(column).cast("timestamp"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trades_of(read(spark, sf_dir, "events"))


def trades_of(events: DataFrame) -> DataFrame:
    """Trades from events: the symbol is the event's type, the price its value, the quantity and side follow its number k."""
    k = F.get_json_object("props", "$.k").cast("bigint")
    rows = events.select("event_id", "ts", "event_type", "value", k.alias("k"))
    return rows.select(
        F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.upper("event_type").alias("symbol"), F.col("event_id").alias("agg_trade_id"), F.col("value").alias("price"),
        (1 + F.col("k") % 10).cast("double").alias("quantity"), ms("ts").alias("trade_time_ms"), (F.col("k") % 2 == 1).alias("is_buyer_maker"), (F.col("event_id") * 10).alias("first_trade_id"), (F.col("event_id") * 10 + F.col("k") % 3).alias("last_trade_id"),
    )


TRADES = """trades AS (SELECT 'sim' AS exchange, 'spot' AS market_type, upper(event_type) AS symbol, event_id AS agg_trade_id, value AS price,
    CAST(1 + k % 10 AS DOUBLE) AS quantity, (epoch_us(ts) // 1000) AS trade_time_ms, k % 2 = 1 AS is_buyer_maker, event_id * 10 AS first_trade_id, event_id * 10 + k % 3 AS last_trade_id
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events))"""


def line_trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A larger table of trades, from order lines; days are its finest time."""
    rows = read(spark, sf_dir, "lineitem")
    return rows.select(
        F.lit("sim").alias("exchange"), F.lit("spot").alias("market_type"), F.concat("l_returnflag", "l_linestatus").alias("symbol"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("agg_trade_id"),
        (F.col("l_extendedprice") / F.col("l_quantity")).alias("price"), F.col("l_quantity").alias("quantity"), ms("l_shipdate").alias("trade_time_ms"), (F.col("l_linenumber") % 2 == 0).alias("is_buyer_maker"),
        F.lit(None).cast("bigint").alias("first_trade_id"), F.lit(None).cast("bigint").alias("last_trade_id"),
    )


LINE_TRADES = """trades AS (SELECT 'sim' AS exchange, 'spot' AS market_type, l_returnflag || l_linestatus AS symbol, l_orderkey * 10 + l_linenumber AS agg_trade_id,
    l_extendedprice / l_quantity AS price, l_quantity AS quantity, (epoch_us(l_shipdate) // 1000) AS trade_time_ms, l_linenumber % 2 = 0 AS is_buyer_maker,
    CAST(NULL AS BIGINT) AS first_trade_id, CAST(NULL AS BIGINT) AS last_trade_id FROM lineitem)"""


def bar_table(spark: SparkSession, sf_dir: str, interval: str = "1h") -> DataFrame:
    return bars.bars_from_trades(trades(spark, sf_dir), interval).withColumn("source", F.lit("backfill"))


def bars_sql(start: str, name: str = "bars", close: str = "open_time") -> str:
    """Bars of `trades`; start: the bar's start as SQL over trade_time_ms."""
    return f"""{name} AS (SELECT exchange, market_type, symbol, {start} AS open_time,
    first(price ORDER BY trade_time_ms, agg_trade_id) AS open, max(price) AS high, min(price) AS low, last(price ORDER BY trade_time_ms, agg_trade_id) AS close,
    round(sum(quantity), 8) AS volume, round(sum(price * quantity), 8) AS quote_volume, CAST(sum(coalesce(last_trade_id - first_trade_id + 1, 1)) AS BIGINT) AS trades,
    round(sum(CASE WHEN NOT is_buyer_maker THEN quantity ELSE 0 END), 8) AS taker_buy_base, round(sum(CASE WHEN NOT is_buyer_maker THEN price * quantity ELSE 0 END), 8) AS taker_buy_quote
    FROM trades GROUP BY ALL)"""


HOURLY = f"{TRADES}, {bars_sql(f'trade_time_ms - trade_time_ms % {HOUR}')}"
DAILY = f"{TRADES}, {bars_sql(f'trade_time_ms - trade_time_ms % {DAY}')}"
S = "exchange, market_type, symbol"
#: Mid-January 2024 and such: instants of the events' own month are read from the data.
OUT = "symbol, open_time, open, high, low, close, volume, quote_volume, trades, taker_buy_base, taker_buy_quote"
OUT_COLUMNS = OUT.split(", ")
