"""Reading exchange files and archives, and writing event archives. Rows that break a rule go to a second table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import intervals as iv
from ..functions import scalars
from ..schemas import SERIES

KLINE_CSV = "open_time bigint, open double, high double, low double, close double, volume double, close_time bigint, quote_volume double, trades bigint, taker_buy_base double, taker_buy_quote double, ignored string"
TRADE_CSV = "agg_trade_id string, price string, quantity string, first_trade_id string, last_trade_id string, trade_time_ms string, is_buyer_maker string"


def check_klines(rows: DataFrame, interval: str, now_ms: int = 2**62, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good bars with the segment that a gap starts anew, and bad ones with their reasons. zero_prices: a price of 0 is good."""
    i = iv.parse_interval(interval)
    w = Window.partitionBy(*SERIES).orderBy("open_time")
    rows = scalars.validate_bars(rows, i.ms, now_ms, zero_prices).withColumn("before", F.lag("open_time").over(w))
    again = F.when(F.col("before") == F.col("open_time"), F.array(F.lit("not_increasing"))).otherwise(F.array().cast("array<string>"))
    rows = rows.withColumn("reasons", F.concat("reasons", again))
    good = rows.where(F.size("reasons") == 0).drop("reasons", "before")
    new = ~F.coalesce(iv.is_successor(F.lag("open_time").over(w), F.col("open_time"), interval), F.lit(False))
    return good.withColumn("segment", F.sum(F.when(new, 1).otherwise(0)).over(w)), rows.where(F.size("reasons") > 0).drop("before")


def _symbol_of(identity: tuple[str, str, str | None]) -> tuple[str, dict]:
    """What a schema adds for a symbol that stands in the folders' names (symbol=...), and the columns of the rest."""
    return (", symbol string" if identity[2] is None else ""), {c: F.lit(v) for c, v in zip(SERIES, identity) if v is not None}


def read_kline_csv(spark: SparkSession, path: str, identity: tuple[str, str, str | None], interval: str, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars of an official archive (header optional), checked. A symbol of None: those of the folders symbol=... below path.
    zero_prices: see check_klines."""
    more, columns = _symbol_of(identity)
    raw = spark.read.schema(KLINE_CSV + more).option("mode", "PERMISSIVE").csv(path).where("open_time is not null").drop("ignored")
    rows = raw.withColumns(columns | {"interval": F.lit(iv.parse_interval(interval).name), "source": F.lit("backfill_archive_verified"), "is_closed": F.lit(True)})
    return check_klines(rows, interval, zero_prices=zero_prices)


#: The second layout's columns, which its header names; confirm is 1 for closed bars.
NAMED_CSV = "instrument_name string, open double, high double, low double, close double, vol double, vol_ccy double, vol_quote double, open_time bigint, confirm string"


def read_named_kline_csv(spark: SparkSession, path: str, identity: tuple[str, str, str | None], interval: str = "1m", zone_ms: tuple[int, int] | None = None, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """Bars of an archive whose rows name their instrument, checked: those of another instrument than identity's (None: each
    row's own), unconfirmed ones, those outside the archive's time [zone_ms] and those off the interval's grid are bad. On
    derivatives the volume is that in the base. Without trades and taker sides (null). Raises an error where a file's header is
    another. zero_prices: see check_klines."""
    names = [c.split()[0] for c in NAMED_CSV.split(", ")]
    raw = spark.read.schema(NAMED_CSV).option("header", True).option("enforceSchema", False).csv(path)
    symbol = F.upper(F.trim("instrument_name"))
    volume = F.col("vol_ccy" if identity[1].lower() in ("futures", "swap", "perpetual") else "vol")
    i = iv.parse_interval(interval)
    rows = raw.withColumns({
        "exchange": F.lit(identity[0]), "market_type": F.lit(identity[1]), "symbol": symbol, "volume": volume, "quote_volume": F.col("vol_quote"), "close_time": iv.bucket_close(F.col("open_time"), i),
        "trades": F.lit(None).cast("bigint"), "taker_buy_base": F.lit(None).cast("double"), "taker_buy_quote": F.lit(None).cast("double"), "interval": F.lit(i.name), "source": F.lit("backfill_archive_confirmed"), "is_closed": F.trim("confirm") == "1",
    })
    tests = {
        "instrument": F.lit(True) if identity[2] is None else F.col("symbol") == identity[2].upper(),
        "unconfirmed": F.col("is_closed"),
        "period": F.lit(True) if zone_ms is None else F.col("open_time").between(*zone_ms),
        "grid": iv.bucket_floor(F.col("open_time"), i) == F.col("open_time"),
    }
    rows = rows.drop(*[c for c in names if c not in ("open", "high", "low", "close", "open_time")]).withColumn("layout", scalars._reasons(tests))
    good, bad = check_klines(rows.where(F.size("layout") == 0).drop("layout"), interval, zero_prices=zero_prices)
    return good, bad.unionByName(rows.where(F.size("layout") > 0).withColumnRenamed("layout", "reasons"), allowMissingColumns=True)


def write_bars(bars: DataFrame, path: str) -> None:
    bars.write.mode("append").partitionBy("exchange", "market_type", "interval").parquet(path)


def check_trades(rows: DataFrame, day_ms: int | None = None, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """Good trades and bad ones with reasons: invalid fields, ids that leave out or repeat one, raw ids that overlap, time
    going back, and a time outside the day. zero_prices: a price of 0 is good."""
    w = Window.partitionBy(*SERIES).orderBy("agg_trade_id", "trade_time_ms")
    rows = scalars.validate_trades(rows, zero_prices)
    lag = lambda c: F.lag(c).over(w)
    tests = {
        "id_gap": lag("agg_trade_id").isNull() | (F.col("agg_trade_id") == lag("agg_trade_id") + 1),
        "raw_overlap": lag("last_trade_id").isNull() | F.col("first_trade_id").isNull() | (F.col("first_trade_id") > lag("last_trade_id")),
        "time_order": lag("trade_time_ms").isNull() | (F.col("trade_time_ms") >= lag("trade_time_ms")),
        "day": F.lit(True) if day_ms is None else F.col("trade_time_ms").between(day_ms, day_ms + iv.UNIT_MS["d"] - 1),
    }
    rows = rows.withColumn("reasons", F.concat("reasons", scalars._reasons(tests)))
    good = rows.where(F.size("reasons") == 0).drop("reasons").withColumn("quote_quantity", F.col("price") * F.col("quantity"))
    return good, rows.where(F.size("reasons") > 0)


def read_agg_trade_csv(spark: SparkSession, path: str, identity: tuple[str, str, str | None], day_ms: int | None = None, zero_prices: bool = False) -> tuple[DataFrame, DataFrame]:
    """Trades of an official archive (header optional), checked. A symbol of None: those of the folders symbol=... below path.
    zero_prices: see check_trades."""
    more, columns = _symbol_of(identity)
    raw = spark.read.schema(TRADE_CSV + more).csv(path)
    raw = raw.where(~F.lower("agg_trade_id").rlike("[a-z]"))  # a header
    number = lambda c, t: F.expr(f"try_cast({c} as {t})").alias(c)
    rows = raw.select(*[number(c, "bigint") for c in ("agg_trade_id", "first_trade_id", "last_trade_id", "trade_time_ms")], number("price", "double"), number("quantity", "double"), (F.lower("is_buyer_maker") == "true").alias("is_buyer_maker"), *(["symbol"] if more else []))
    return check_trades(rows.withColumns(columns), day_ms, zero_prices)


ARCHIVE_KEY = ["kafka_topic", "kafka_partition"]


def archive_manifest(events: DataFrame, segment_rows: int) -> tuple[DataFrame, DataFrame]:
    """Events with their segment (by offset, segment_rows each), and one manifest row per segment: counts, bounds, and a
    hash over the rows' hashes in order."""
    rows = events.withColumn("segment", F.floor(F.col("kafka_offset") / segment_rows))
    all_ = F.count("sequence_start") == F.count("*")
    ordered = F.transform(F.sort_array(F.collect_list(F.struct("kafka_offset", "envelope_sha256"))), lambda x: x["envelope_sha256"])
    manifest = rows.groupBy(*ARCHIVE_KEY, "segment").agg(
        F.count("*").alias("n"), F.min("kafka_offset").alias("first_offset"), F.max("kafka_offset").alias("last_offset"), F.min("event_time_ms").alias("first_time_ms"), F.max("event_time_ms").alias("last_time_ms"),
        F.when(all_, F.min("sequence_start")).alias("sequence_first"), F.when(F.count("sequence_end") == F.count("*"), F.max("sequence_end")).alias("sequence_last"), F.sha2(F.array_join(ordered, ","), 256).alias("rows_sha256"),
    )
    return rows, manifest


def write_event_archive(events: DataFrame, path: str, segment_rows: int = 100_000) -> None:
    rows, manifest = archive_manifest(events, segment_rows)
    rows.repartition(*ARCHIVE_KEY, "segment").sortWithinPartitions(*ARCHIVE_KEY, "segment", "kafka_offset").write.mode("append").partitionBy("kafka_topic").parquet(f"{path}/events")
    manifest.write.mode("append").parquet(f"{path}/manifest")


def read_event_archive(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/events"), spark.read.parquet(f"{path}/manifest")


def validate_event_archive(events: DataFrame, manifest: DataFrame, segment_rows: int = 100_000) -> DataFrame:
    """Segments whose rows are not what the manifest says, with the reasons."""
    _, now = archive_manifest(events.drop("segment"), segment_rows)
    key = [*ARCHIVE_KEY, "segment"]
    fields = [c for c in now.columns if c not in key]
    both = now.select(*key, F.struct(*fields).alias("is")).join(manifest.select(*key, F.struct(*fields).alias("says")), key, "full_outer")
    wrong = [F.when(~F.col(f"is.{c}").eqNullSafe(F.col(f"says.{c}")), F.lit(c)) for c in fields]
    hole = F.when(F.col("is.last_offset") - F.col("is.first_offset") + 1 != F.col("is.n"), F.lit("offsets_not_contiguous"))
    reasons = F.when(F.col("is").isNull(), F.array(F.lit("rows_missing"))).when(F.col("says").isNull(), F.array(F.lit("manifest_missing"))).otherwise(F.array_compact(F.array(*wrong, hole)))
    return both.select(*key, reasons.alias("reasons")).where(F.size("reasons") > 0)
