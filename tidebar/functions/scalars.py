"""Scalar rules on trades, bars, books and metrics. Null means unknown, and what follows from it stays null."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rank of each bar source; higher replaces lower.
SOURCE_RANK = {
    "data_manager_closed": 10,
    "data_manager_exchange_closed": 50,
    "data_manager_composite_closed": 60,
    "backfill_aggregated": 60,
    "backfill": 70,
    "backfill_archive_verified": 70,
    "backfill_archive_confirmed": 70,
    "data_manager_amended": 80,
    "backfill_rest_verified": 90,
    "repair_binance_rest_verified": 100,
    "repair_derived_verified": 100,
    "settings_manual_repair": 10,
}
#: Sources that are known but whose rows do not prove a close.
AMBIGUOUS_SOURCES = ("data_manager_closed", "settings_manual_repair")
#: Open-interest periods in ms.
OI_PERIODS = {"5m": 300_000, "15m": 900_000, "30m": 1_800_000, "1h": 3_600_000, "2h": 7_200_000, "4h": 14_400_000, "6h": 21_600_000, "12h": 43_200_000, "1d": 86_400_000}


def normalize_identity(df: DataFrame) -> DataFrame:
    """Trimmed; exchange and market_type in lower case, symbol in upper; rows with a blank part go."""
    out = df.withColumns({"exchange": F.lower(F.trim("exchange")), "market_type": F.lower(F.trim("market_type")), "symbol": F.upper(F.trim("symbol"))})
    return out.where("exchange <> '' and market_type <> '' and symbol <> ''")


def is_closed_col(flag: Column) -> Column:
    """Booleans and their usual spellings; null for anything else."""
    t = F.lower(F.trim(flag.cast("string")))
    return F.when(t.isin("true", "1", "yes", "y", "closed", "final"), True).when(t.isin("false", "0", "no", "n", "open", "forming"), False)


def price_source(name: str) -> Column:
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    made = {"hl2": (h + low) / 2, "hlc3": (h + low + c) / 3, "ohlc4": (o + h + low + c) / 4, "hlcc4": (h + low + 2 * c) / 4}
    if name not in made and name not in ("open", "high", "low", "close", "volume"):
        raise ValueError(f"no price source {name!r}")
    return made.get(name, F.col(name))


def enrich_trades(df: DataFrame) -> DataFrame:
    raw = F.when(F.col("first_trade_id").isNotNull() & F.col("last_trade_id").isNotNull(), F.col("last_trade_id") - F.col("first_trade_id") + 1)
    return df.withColumns({"quote_quantity": F.col("price") * F.col("quantity"), "side": F.when(F.col("is_buyer_maker"), "sell").otherwise("buy"), "raw_count": F.coalesce(raw, F.lit(1))})


def _buy_part(total: str, part: str) -> Column:
    """The buy part of a volume, at most the volume; null where it exceeds it beyond rounding or either is unusable."""
    t, p = F.col(total), F.col(part)
    usable = (t >= 0) & (p >= 0) & (t < float("inf")) & (p <= t + F.greatest(F.lit(1e-10), t * 1e-10))
    return F.when(usable, F.least(p, t))


def enrich_order_flow(bars: DataFrame) -> DataFrame:
    """Sell volume, delta, buy ratio (null for no volume) and CVD contribution of a bar, to 8 places. A positive volume
    with no quote turnover leaves all flow fields null."""
    known = F.coalesce(~((F.col("volume") > 0) & (F.col("quote_volume") == 0)), F.lit(True))
    rows = bars.withColumns({
        "taker_buy_base": F.when(known, F.round(_buy_part("volume", "taker_buy_base"), 8)),
        "taker_buy_quote": F.when(known, F.round(_buy_part("quote_volume", "taker_buy_quote"), 8)),
        "trades": F.when(known, F.col("trades")),
        "quote_volume": F.when(known & (F.col("quote_volume") >= 0), F.round("quote_volume", 8)),
    })
    buy, total = F.col("taker_buy_base"), F.col("volume")
    delta = F.round(2 * buy - total, 8)
    return rows.withColumns({"taker_sell_base": F.round(total - buy, 8), "volume_delta_base": delta, "taker_buy_ratio_base": F.when(total > 0, F.round(buy / total, 8)), "cvd_contribution_base": delta})


def mask_capabilities(bars: DataFrame, capabilities: DataFrame) -> DataFrame:
    """capabilities: exchange, market_type, fields (array). Flow fields that a market does not declare become null."""
    fields = ["quote_volume", "trades", "taker_buy_base", "taker_buy_quote"]
    rows = bars.join(capabilities.select("exchange", "market_type", F.col("fields").alias("declared")), ["exchange", "market_type"], "left")
    return rows.withColumns({c: F.when(F.array_contains("declared", c), F.col(c)) for c in fields}).drop("declared")


def source_rank(source: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in SOURCE_RANK.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.trim(source))), F.lit(0))


def source_final(source: Column) -> Column:
    """Whether the source's rows prove that the bar has closed."""
    return (source_rank(source) > 0) & ~F.lower(F.trim(source)).isin(*AMBIGUOUS_SOURCES)


def _reasons(tests: dict[str, Column]) -> Column:
    """Names of the tests that do not hold; a null test fails."""
    return F.array_compact(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in tests.items()]))


def validate_bars(bars: DataFrame, interval_ms: int, now_ms: int, zero_prices: bool = False) -> DataFrame:
    """Adds reasons: the rules that a bar of a fixed interval breaks, in order. zero_prices: a price may be 0, not only above."""
    o, h, low, c = (F.col(x) for x in ("open", "high", "low", "close"))
    part = lambda p, t: F.col(p).isNull() | F.col(t).isNull() | (F.col(p) <= F.col(t) + F.greatest(F.lit(1e-10), F.col(t) * 1e-10))
    tests = {
        "alignment": F.pmod("open_time", F.lit(interval_ms)) == 0,
        "close_time": F.col("close_time") == F.col("open_time") + interval_ms - 1,
        "not_closed": F.col("close_time") < now_ms,
        "price": (o >= 0) & (h >= 0) & (low >= 0) & (c >= 0) if zero_prices else (o > 0) & (h > 0) & (low > 0) & (c > 0),
        "bounds": (h >= F.greatest(o, c, low)) & (low <= F.least(o, c, h)),
        "volume": (F.col("volume") >= 0) & F.coalesce(F.col("quote_volume") >= 0, F.lit(True)),
        "taker": part("taker_buy_base", "volume") & part("taker_buy_quote", "quote_volume"),
    }
    return bars.withColumn("reasons", _reasons(tests))


def validate_trades(trades: DataFrame, zero_prices: bool = False) -> DataFrame:
    """Adds reasons: the rules that a trade breaks, in order. zero_prices: a price may be 0, not only above."""
    number = lambda c: (F.col(c) > 0) & ~F.isnan(c) & (F.col(c) < float("inf"))
    ids = F.col("first_trade_id").isNull() | F.col("last_trade_id").isNull() | ((F.col("first_trade_id") >= 0) & (F.col("first_trade_id") <= F.col("last_trade_id")))
    tests = {"id": F.col("agg_trade_id") >= 0, "time": F.col("trade_time_ms") >= 0, "price": number("price") | (F.col("price") == 0) if zero_prices else number("price"), "quantity": number("quantity"), "raw_ids": ids}
    return trades.withColumn("reasons", _reasons(tests))


FINGERPRINT = ["exchange", "market_type", "symbol", "order_side", "order_type", "time_in_force", "original_quantity", "order_price", "average_price", "last_filled_quantity", "filled_quantity", "order_status", "trade_time_ms", "event_time_ms", "pair_symbol", "symbol_type"]


def enrich_liquidations(df: DataFrame) -> DataFrame:
    """A SELL order closes a long. Notional is exact; the fingerprint covers the exchange's fields, not the time received."""
    price = F.coalesce(F.when(F.col("average_price") > 0, F.col("average_price")), F.col("order_price")).cast("decimal(38,10)")
    quantity = F.coalesce(F.when(F.col("filled_quantity") > 0, F.col("filled_quantity")), F.col("original_quantity")).cast("decimal(28,10)")
    return df.withColumns({
        "side": F.when(F.upper("order_side") == "SELL", "long").when(F.upper("order_side") == "BUY", "short"),
        "notional": (price.cast("decimal(18,8)") * quantity.cast("decimal(18,8)")).cast("decimal(38,10)"),
        "fingerprint": F.sha2(F.to_json(F.array(*[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in FINGERPRINT])), 256),
    })


def _side(side: str, of) -> Column:
    return F.aggregate(side, F.lit(0.0), lambda s, x: s + of(x))


def book_metrics(books: DataFrame) -> DataFrame:
    """bids best first and asks best first: spread, mid, depth and imbalance of each snapshot."""
    bid, ask = F.get("bids", F.lit(0))["price"], F.get("asks", F.lit(0))["price"]
    out = books.withColumns({"best_bid": bid, "best_ask": ask}).withColumn("spread", F.col("best_ask") - F.col("best_bid"))
    out = out.withColumns({"mid": F.col("best_bid") + F.col("spread") / 2, **{f"{s}_{n}": _side(s, f) for s in ("bids", "asks") for n, f in (("quantity", lambda x: x["quantity"]), ("notional", lambda x: x["price"] * x["quantity"]))}})
    larger = F.greatest("bids_quantity", "asks_quantity")
    return out.withColumns({"spread_bps": F.when(F.col("mid") > 0, F.col("spread") / F.col("mid") * 10_000), "imbalance": F.when(larger > 0, (F.col("bids_quantity") - F.col("asks_quantity")) / larger)})


def canonical_book(books: DataFrame, depth: int) -> DataFrame:
    """Sorted levels; snapshots that are empty, too deep, repeat a price, or are crossed or locked go."""
    by = lambda sign: lambda a, b: F.when(sign * (a["price"] - b["price"]) < 0, -1).when(sign * (a["price"] - b["price"]) > 0, 1).otherwise(0)
    out = books.withColumns({"bids": F.array_sort("bids", by(-1)), "asks": F.array_sort("asks", by(1))})
    prices = lambda s: F.transform(s, lambda x: x["price"])
    for s in ("bids", "asks"):
        out = out.where(F.size(s).between(1, depth) & (F.size(F.array_distinct(prices(s))) == F.size(s)) & F.forall(s, lambda x: (x["price"] > 0) & (x["quantity"] > 0)))
    return out.where(F.get("bids", F.lit(0))["price"] < F.get("asks", F.lit(0))["price"])


def infer_tick(df: DataFrame, keys: list[str], price: str = "price") -> DataFrame:
    """The smallest step that the decimal places seen (at most 8) allow, for each key."""
    text = F.regexp_replace(F.format_number(F.round(price, 8), 8), "0+$", "")
    places = F.length(F.regexp_extract(text, r"\.([0-9]*)$", 1))
    return df.groupBy(*keys).agg(F.max(places).alias("places")).withColumn("tick", F.round(F.pow(F.lit(10.0), -F.col("places")), 8))


def to_ticks(price: Column, tick: Column | float) -> Column:
    return F.round(price / tick).cast("bigint")


def from_ticks(ticks: Column, tick: Column | float) -> Column:
    return F.round(ticks * tick, 12)


def daily_change(df: DataFrame) -> DataFrame:
    """Change since daily_open (8 places) and its percentage (4 places); null without a positive open."""
    ok = F.col("daily_open") > 0
    return df.withColumns({"change": F.when(ok, F.round(F.col("price") - F.col("daily_open"), 8)), "change_pct": F.when(ok, F.round((F.col("price") - F.col("daily_open")) / F.col("daily_open") * 100, 4))})


def basis(df: DataFrame) -> DataFrame:
    ok = F.col("index_price") > 0
    rate = (F.col("mark_price") - F.col("index_price")) / F.col("index_price")
    return df.withColumns({"basis": F.when(ok, F.col("mark_price") - F.col("index_price")), "basis_rate": F.when(ok, rate), "basis_bps": F.when(ok, rate * 10_000)})


def funding_cycle(ts: Column) -> Column:
    """Time rounded to the nearest minute."""
    return F.floor((ts + 30_000) / 60_000) * 60_000


def funding_semantics(df: DataFrame) -> DataFrame:
    """Provenance, quality, sample time and target time of funding samples with sample_kind, is_final, stale, carried."""
    kind = F.when((F.col("sample_kind") == "settlement") | F.col("is_final"), "exchange_settlement").when(F.col("sample_kind").isin("estimate", "derived"), "derived_history").otherwise("exchange_realtime")
    out = df.withColumn("provenance", kind)
    at = F.col("provenance")
    return out.withColumns({
        "quality": F.when(at == "exchange_settlement", "final").when(at == "derived_history", "estimated").when(F.col("stale"), "stale").when(F.col("carried"), "carried").otherwise("live"),
        "sample_time": F.when(at == "exchange_settlement", F.coalesce("funding_time_ms", "event_time_ms")).when(at == "derived_history", F.col("event_time_ms")).otherwise(F.coalesce("observed_at_ms", "received_at_ms")),
        "target_time": F.coalesce("target_funding_time_ms", "next_funding_time_ms", "funding_cycle_ms", "funding_time_ms"),
    })


def oi_period(interval_ms: Column) -> Column:
    """The largest supported period that is no longer than the chart's interval; the least where none is."""
    out = F.lit(next(iter(OI_PERIODS)))
    for name, ms in OI_PERIODS.items():
        out = F.when(interval_ms >= ms, name).otherwise(out)
    return out


def search_symbols(catalog: DataFrame, text: str = "", market_type: str | None = None, exchange: str | None = None, quote: str | None = None) -> DataFrame:
    out = catalog
    for column, value in (("market_type", market_type), ("exchange", exchange), ("quote_asset", quote)):
        if value:
            out = out.where(F.upper(column) == value.strip().upper())
    needle = text.strip().upper()
    return out.where(F.upper("symbol").contains(needle) | F.upper("base_asset").contains(needle) | F.upper("quote_asset").contains(needle)) if needle else out


def render_message(df: DataFrame, template: str, fields: list[str]) -> DataFrame:
    """Adds message: {{field}} replaced by the field, nulls by nothing."""
    text = F.lit(template)
    for name in fields:
        text = F.replace(text, F.lit("{{" + name + "}}"), F.coalesce(F.col(name).cast("string"), F.lit("")))
    return df.withColumn("message", text)


def marker_size(notional: Column, threshold: float) -> Column:
    ratio = notional / threshold if threshold > 0 else F.lit(1.0)
    return F.greatest(F.lit(1.0), F.least(F.lit(3.2), 1 + F.log10(F.greatest(F.lit(1.0), ratio)) * 0.9))


def tape(trades: DataFrame) -> DataFrame:
    rows = enrich_trades(trades)
    return rows.withColumn("cvd_delta", F.when(F.col("side") == "buy", F.col("quantity")).otherwise(-F.col("quantity")))
