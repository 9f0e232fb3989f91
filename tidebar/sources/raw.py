"""Raw exchange messages (kind, exchange, market_type, payload JSON) to canonical rows, and event-bus records to events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import intervals as iv

#: Per kind the object within the payload that holds the fields, and each canonical column's key and type.
#: Keys differ by case alone, so payloads are read as maps.
TICKER = {"symbol": "s string", "close": "c double", "open": "o double", "high": "h double", "low": "l double", "volume": "v double", "quote_volume": "q double", "event_time_ms": "E bigint"}
KINDS: dict[str, tuple[str | None, dict[str, str]]] = {
    "kline": ("k", {"symbol": "s string", "interval": "i string", "open_time": "t bigint", "close_time": "T bigint", "open": "o double", "high": "h double", "low": "l double", "close": "c double", "volume": "v double", "quote_volume": "q double", "trades": "n bigint", "taker_buy_base": "V double", "taker_buy_quote": "Q double", "is_closed": "x boolean"}),
    "aggTrade": (None, {"symbol": "s string", "agg_trade_id": "a bigint", "price": "p double", "quantity": "q double", "first_trade_id": "f bigint", "last_trade_id": "l bigint", "trade_time_ms": "T bigint", "event_time_ms": "E bigint", "is_buyer_maker": "m boolean"}),
    "trade": (None, {"symbol": "s string", "agg_trade_id": "t bigint", "price": "p double", "quantity": "q double", "trade_time_ms": "T bigint", "is_buyer_maker": "m boolean", "event_time_ms": "E bigint"}),
    "ticker": (None, TICKER),
    "miniTicker": (None, TICKER),
    "depth": (None, {"symbol": "s string", "first_update_id": "U bigint", "final_update_id": "u bigint", "previous_final_update_id": "pu bigint", "bids": "b levels", "asks": "a levels", "event_time_ms": "E bigint"}),
    "liquidation": ("o", {"symbol": "s string", "order_side": "S string", "order_type": "o string", "time_in_force": "f string", "original_quantity": "q double", "order_price": "p double", "average_price": "ap double", "order_status": "X string", "last_filled_quantity": "l double", "filled_quantity": "z double", "trade_time_ms": "T bigint"}),
    "markPrice": (None, {"symbol": "s string", "mark_price": "p double", "index_price": "i double", "funding_rate": "r double", "next_funding_time_ms": "T bigint", "event_time_ms": "E bigint"}),
}
REST_KLINE = ["open_time bigint", "open double", "high double", "low double", "close double", "volume double", "close_time bigint", "quote_volume double", "trades bigint", "taker_buy_base double", "taker_buy_quote double"]


#: Fixed values of exchanges that send {arg: {channel, instId}, data: [rows]}. A candle is an array: open_time, open, high, low,
#: close, volume (contracts on derivatives), volume in the base, volume in the quote (or what is before it), quote volume, and 1
#: once closed; its channel ends in the bar's name, where hours, days and weeks are upper-case and an ending utc says which day.
CANDLE = {"open_time": "0 bigint", "open": "1 double", "high": "2 double", "low": "3 double", "close": "4 double", "quote_volume": "7 double"}
CHANNEL_TICKER = {"symbol": "instId string", "close": "last double", "open": "open24h double", "high": "high24h double", "low": "low24h double", "volume": "vol24h double", "quote_volume": "volCcy24h double", "event_time_ms": "ts bigint"}
DERIVATIVES = ("futures", "swap", "perpetual")


def normalize_channel_events(raw: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Bars, tickers and unreadable messages (exchange, market_type, payload) of exchanges that wrap rows in channels. All rows of
    a message are read; one that can't be read is given as its message, once. On derivatives a bar's volume is that in the
    base, not that in contracts. Bars carry no number of trades and no taker side (null)."""
    message = ["exchange", "market_type", "payload"]
    rows = raw.select(*message, F.from_json("payload", "arg struct<channel: string, instId: string>, data array<string>").alias("m"))
    channel = F.coalesce(F.col("m.arg.channel"), F.lit(""))
    name = F.regexp_extract(channel, "^candle([0-9]+[smHDWM])(utc)?$", 1)
    rows = rows.select(*message, channel.alias("channel"), name.alias("name"), F.col("m.arg.instId").alias("symbol"), F.col("m.data").alias("data"))
    # parsed within the explode, below which no later filter is pushed: each row is parsed once
    parsed = lambda shape: F.explode_outer(F.transform("data", lambda r: F.struct(F.from_json(r, shape).alias("of"))))
    candles = rows.where("name <> ''").withColumn("interval", F.concat(F.regexp_extract("name", "^[0-9]+", 0), F.translate(F.right("name", F.lit(1)), "HDW", "hdw")))
    candles = candles.select(*message, "symbol", "interval", parsed("array<string>").alias("x")).withColumn("a", F.col("x.of"))
    at = lambda n: F.get("a", F.lit(n))
    read = {c: at(int(spec.split()[0])).try_cast(spec.split()[1]) for c, spec in CANDLE.items()}
    volume = F.when(F.lower("market_type").isin(*DERIVATIVES), at(6)).otherwise(at(5)).try_cast("double")
    bars = candles.withColumns(read | {"volume": volume, "is_closed": at(8) == "1"})
    whole = F.lit(True)
    for c in ("symbol", *CANDLE, "volume", "is_closed"):
        whole = whole & F.col(c).isNotNull()
    nothing = {"trades": F.lit(None).cast("bigint"), "taker_buy_base": F.lit(None).cast("double"), "taker_buy_quote": F.lit(None).cast("double")}
    good = bars.where(whole).withColumns({"close_time": iv.bucket_end(F.col("open_time"), F.col("interval"))} | nothing)
    good = good.select("exchange", "market_type", "symbol", "interval", "open_time", "close_time", "open", "high", "low", "close", "volume", "quote_volume", "trades", "taker_buy_base", "taker_buy_quote", "is_closed")
    ticks = rows.where("channel = 'tickers'").select(*message, parsed("map<string,string>").alias("x"))
    ticks = ticks.select(*message, *[F.col("x.of")[spec.split()[0]].try_cast(spec.split()[1]).alias(c) for c, spec in CHANNEL_TICKER.items()])
    missing = F.col("symbol").isNull() | F.col("close").isNull()
    change = F.when(F.col("open") > 0, (F.col("close") - F.col("open")) / F.col("open") * 100).otherwise(F.lit(0.0))
    bad = bars.where(~whole).select(*message).unionByName(ticks.where(missing).select(*message)).unionByName(rows.where("name = '' and channel <> 'tickers'").select(*message))
    return good, ticks.where(~missing).drop("payload").withColumn("change_pct", change), bad.distinct()


def normalize_raw_events(raw: DataFrame, kind: str, adapters: dict[str, Callable[[DataFrame], DataFrame]] | None = None) -> tuple[DataFrame, DataFrame]:
    """Canonical rows of one kind, and the messages that can't be read (no JSON, or without a symbol). adapters: own kinds,
    DataFrame to DataFrame."""
    rows = raw.where(F.col("kind") == kind)
    if adapters and kind in adapters:
        return adapters[kind](rows), rows.limit(0)
    if kind == "restKline":
        parts = F.from_json("payload", "array<string>")
        good = rows.withColumn("a", parts).where(F.size("a") >= len(REST_KLINE))
        return good.select("exchange", "market_type", "symbol", *[F.get("a", F.lit(i)).cast(c.split()[1]).alias(c.split()[0]) for i, c in enumerate(REST_KLINE)]), rows.withColumn("a", parts).where(F.coalesce(F.size("a"), F.lit(0)) < len(REST_KLINE)).drop("a")
    inner, columns = KINDS[kind]
    rows = rows.drop("symbol").withColumn("p", F.from_json("payload", "map<string,string>"))
    if inner:
        rows = rows.withColumn("event_time", F.col("p")["E"]).withColumn("p", F.from_json(F.col("p")[inner], "map<string,string>"))

    def field(spec: str) -> Column:
        key, kind_ = spec.split()
        text = F.col("p")[key]
        if kind_ == "levels":
            return F.transform(F.from_json(text, "array<array<string>>"), lambda x: F.struct(x[0].try_cast("double").alias("price"), x[1].try_cast("double").alias("quantity")))
        return text.try_cast(kind_)

    made = rows.select("exchange", "market_type", "payload", *[field(spec).alias(c) for c, spec in columns.items()], *([F.col("event_time").try_cast("bigint").alias("event_time_ms")] if inner else []))
    bad = F.col("symbol").isNull()
    return made.where(~bad).drop("payload"), made.where(bad).select("exchange", "market_type", "payload")


def decode_event_records(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Event-bus records (topic, partition, offset, key, value, headers map) to events, and those whose key, JSON, headers
    or id do not agree, with the reason."""
    envelope = F.from_json(F.col("value").cast("string"), "event_id string, version string, stream_key string, event_time_ms bigint, sequence_start bigint, sequence_end bigint")
    rows = records.withColumn("e", envelope)

    def off(name: str, ok: Column) -> Column:
        return F.when(~F.coalesce(ok, F.lit(False)), F.lit(name))

    reason = F.coalesce(
        off("json", F.col("e.event_id").isNotNull()), off("key", F.col("key").cast("string") == F.col("e.stream_key")),
        off("id_header", F.try_element_at("headers", F.lit("event_id")) == F.col("e.event_id")), off("version_header", F.try_element_at("headers", F.lit("version")) == F.col("e.version")),
    )
    rows = rows.withColumn("reason", reason)
    good = rows.where("reason is null").select(
        F.col("topic").alias("kafka_topic"), F.col("partition").alias("kafka_partition"), F.col("offset").alias("kafka_offset"), "e.event_id", F.col("e.stream_key").alias("partition_key"), "e.event_time_ms",
        "e.sequence_start", "e.sequence_end", F.sha2(F.col("value").cast("binary"), 256).alias("envelope_sha256"), F.col("value").cast("string").alias("envelope_json"),
    )
    return good, rows.where("reason is not null").select("topic", "partition", "offset", "reason")
