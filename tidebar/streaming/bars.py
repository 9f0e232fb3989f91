"""Streams of bars, latest states, prices, alerts and sinks. Stateless parts and windows are Spark's own; what needs an
order per key is keyed state (see keyed.py)."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from itertools import groupby
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import alerts, scalars
from ..functions import intervals as iv
from ..operators import bars, integrity, joins
from ..schemas import SERIES, TRADES


def read_trades(spark: SparkSession, path: str, files_per_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(TRADES).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def stream_bars(trades: DataFrame, interval: str, lateness: str = "1 minute", price_only: Column | None = None) -> DataFrame:
    """Tumbling bars on event time: written in `update` mode they are forming bars, in `append` mode final ones. Weeks start
    on Monday; months come from daily bars by roll_months. Trades for which price_only holds move high, low and close
    but add to nothing."""
    i = iv.parse_interval(interval)
    if i.months:
        raise ValueError("a month has no fixed width: stream days and roll them up")
    rows = scalars.enrich_trades(trades).withColumn("at", F.timestamp_millis("trade_time_ms")).withWatermark("at", lateness)
    width = f"{i.ms // 1000} seconds"
    start = F.window("at", width, width, f"{i.origin // 1000 % (i.ms // 1000)} seconds")
    adds = F.lit(True) if price_only is None else ~price_only
    order = F.struct("trade_time_ms", "agg_trade_id")
    add = lambda c: F.round(F.sum(F.when(adds, c).otherwise(0.0)), 8)
    buy = F.col("side") == "buy"
    out = rows.groupBy(*SERIES, start.alias("w")).agg(
        F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"),
        add(F.col("quantity")).alias("volume"), add(F.col("quote_quantity")).alias("quote_volume"), F.sum(F.when(adds, F.col("raw_count")).otherwise(0)).alias("trades"), add(F.when(buy, F.col("quantity")).otherwise(0.0)).alias("taker_buy_base"),
    )
    return out.withColumn("open_time", F.unix_millis("w.start")).withColumn("close_time", F.unix_millis("w.end") - 1).drop("w")


def stream_liquidations(events: DataFrame, lateness: str = "1 minute") -> DataFrame:
    """Minute sums of liquidations, repeats within the watermark removed; late events update a minute in `update` mode."""
    rows = scalars.enrich_liquidations(events).withColumn("at", F.timestamp_millis("trade_time_ms")).withWatermark("at", lateness)
    rows = rows.dropDuplicatesWithinWatermark(["fingerprint"])
    by = lambda s: F.sum(F.when(F.col("side") == s, F.col("notional").cast("decimal(28,8)")).otherwise(0))
    out = rows.groupBy(*SERIES, F.window("at", "60 seconds").alias("w")).agg(by("long").alias("long_notional"), by("short").alias("short_notional"), F.count("*").alias("n"))
    return out.withColumn("open_time", F.unix_millis("w.start")).drop("w")


def filter_events(events: DataFrame, types: list[str] | None = None, keys: DataFrame | None = None) -> DataFrame:
    """Events of these types and series; keys is a static table."""
    out = events.where(F.col("type").isin(types)) if types else events
    return out.join(keys.select(*SERIES).distinct(), SERIES, "left_semi") if keys is not None else out


def merge_into(path: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str) -> Callable[[DataFrame, int], None]:
    """A foreachBatch function that merges each batch into the table at path. The table is written anew as the next version
    and its number noted last, so that a batch that runs again after a failure finds the version before it; versions
    older than that one are deleted. Each batch rewrites the table, so this is for states of bounded size (latest values,
    open bars), not for histories."""

    def run(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        versions = spark.createDataFrame([], "version bigint") if batch_id == 0 else spark.read.schema("version bigint").json(f"{path}/versions").where(F.col("version") < batch_id)
        last = versions.agg(F.max("version")).first()[0]
        stored = spark.createDataFrame([], schema) if last is None else spark.read.schema(schema).parquet(f"{path}/data-{last}")
        merge(stored, batch).write.mode("overwrite").parquet(f"{path}/data-{batch_id}")
        spark.createDataFrame([(batch_id,)], "version bigint").write.mode("append").json(f"{path}/versions")
        for (old,) in versions.where(F.col("version") < F.lit(last)).collect() if last is not None else []:
            gone = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/data-{old}")
            gone.getFileSystem(spark._jsc.hadoopConfiguration()).delete(gone, True)

    return run


def read_merged(spark: SparkSession, path: str, schema: str) -> DataFrame:
    last = spark.read.schema("version bigint").json(f"{path}/versions").agg(F.max("version")).first()[0]
    return spark.read.schema(schema).parquet(f"{path}/data-{last}")


def start_merge(stream: DataFrame, path: str, checkpoint: str, merge: Callable[[DataFrame, DataFrame], DataFrame], schema: str, mode: str = "update") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).foreachBatch(merge_into(path, merge, schema)).trigger(availableNow=True).start()


def merge_latest(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """The latest state of each (series, channel): by sequence, then event and receive time; revision counts replacements."""
    key = [*SERIES, "channel"]
    order = F.struct(F.coalesce("sequence", F.lit(-1)), "event_time_ms", "received_at_ms")
    rest = ["sequence", "event_time_ms", "received_at_ms", "value"]
    new = batch.groupBy(*key).agg(F.max_by(F.struct(*rest), order).alias("n"), F.max(order).alias("no"))
    old = stored.select(*key, F.struct(*rest).alias("o"), F.struct(F.coalesce("sequence", F.lit(-1)), "event_time_ms", "received_at_ms").alias("oo"), "revision")
    rows = old.join(new, key, "full_outer")
    takes = F.col("oo").isNull() | F.coalesce(F.col("no") > F.col("oo"), F.lit(False))
    return rows.select(*key, F.when(takes, F.col("n")).otherwise(F.col("o")).alias("x"), (F.coalesce("revision", F.lit(0)) + takes.cast("bigint")).alias("revision")).select(*key, "x.*", "revision")


LATEST = "exchange string, market_type string, symbol string, channel string, sequence bigint, event_time_ms bigint, received_at_ms bigint, value double, revision bigint"


def merge_amendments(stored: DataFrame, batch: DataFrame) -> DataFrame:
    """Closed bars change only by a source of the same or a higher rank; live input for a closed bar is passed over. Rows
    say whether they were amended."""
    live = F.coalesce(F.col("source") == "live", F.lit(False))
    usable = batch.join(stored.where("is_closed").select(*SERIES, "interval", "open_time", F.lit(True).alias("shut")), [*SERIES, "interval", "open_time"], "left").where(F.col("shut").isNull() | ~live)
    marked = usable.withColumn("amended", F.coalesce("shut", F.lit(False))).select(*stored.columns)
    return integrity.upsert_bars(stored, marked)


class FirstEnvelopes(StatefulProcessor):
    """The content first seen under each event id. Ids are dealt to buckets, so that a call serves many, and a bucket's ids to
    slots, each of which is one value of the bucket's map: so a batch reads and writes the slots of its own ids, each once,
    and a call to the state serves all ids of a slot. Where ids expire, a timer in event time clears a bucket once in keep_ms."""

    def __init__(self, columns: list[str], keep_ms: int | None):
        self.columns, self.keep_ms = columns, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.first = handle.getMapState("first", "slot bigint", "entries string")

    def _entries(self, slot: int) -> dict[str, dict[str, list]]:
        """topic: id: hash of the content, time seen."""
        held = self.first.getValue((slot,)) if self.first.containsKey((slot,)) else None
        return json.loads(held[0]) if held else {}

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["slot", "kafka_partition", "kafka_offset"], kind="stable")
        floor = timerValues.getCurrentWatermarkInMs() - self.keep_ms if self.keep_ms is not None else None
        kinds, firsts = [], []
        name = lambda v: "" if v is None else f"={v}"
        for slot, part in groupby(zip(*(events[c].tolist() for c in ("slot", "kafka_topic", "event_id", "envelope_sha256", "seen"))), itemgetter(0)):
            entries, known, changed = self._entries(slot), set(), False
            for _, topic, event, sha, seen in part:
                topic, event = name(topic), name(event)
                ids = entries.setdefault(topic, {})
                held = ids.get(event)
                # what this batch has seen counts as it stands, however late it is
                new = held is None or (floor is not None and held[1] <= floor and (topic, event) not in known)
                known.add((topic, event))
                if new:
                    held, changed = ids.setdefault(event, [sha, seen]), True
                    held[:] = sha, seen
                kinds.append("fact" if new else "repeat" if sha == held[0] else "conflict")
                firsts.append(held[0])
            if changed:
                self.first.updateValue((slot,), (json.dumps(entries, separators=(",", ":")),))
        if self.keep_ms is not None and not list(self.handle.listTimers()):
            self.handle.registerTimer(max(int(events["seen"].max()), timerValues.getCurrentWatermarkInMs()) + self.keep_ms + 1)
        out = events[self.columns].assign(kind=kinds, first_sha256=firsts)
        yield out[out["kind"] != "repeat"]

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now, left = timerValues.getCurrentWatermarkInMs(), False
        for (slot,) in list(self.first.keys()):
            entries = self._entries(slot)
            kept = {topic: alive for topic, ids in entries.items() if (alive := {k: x for k, x in ids.items() if x[1] + self.keep_ms > now})}
            if not kept:
                self.first.removeKey((slot,))
            elif kept != entries:
                self.first.updateValue((slot,), (json.dumps(kept, separators=(",", ":")),))
            left = left or bool(kept)
        if left:
            self.handle.registerTimer(now + self.keep_ms)
        return iter(())


#: Slots of a bucket: few enough that a large batch makes few calls, and so many that a small one reads little beside its ids.
SLOTS = 256


def stream_first_envelopes(stream: DataFrame, schema: str, buckets: int = 4096, keep_ms: int | None = None, lateness: str = "1 minute") -> DataFrame:
    """The events of a stream that are the first under their (topic, id), as facts, and those whose content differs from it, as
    conflicts (kind, first_sha256). What is known of an id is keyed state: a batch reads the slots of its own ids only;
    keep_ms: an id is forgotten once the watermark of event_time_ms is so far beyond it. The state store must be RocksDB
    (see session.py)."""
    columns = [c.split()[0] for c in schema.split(", ")]
    seen = F.col("event_time_ms") if keep_ms is not None else F.lit(0).cast("bigint")
    place = F.pmod(F.xxhash64("kafka_topic", "event_id"), F.lit(buckets * SLOTS))
    rows = stream.select(*columns, seen.alias("seen"), (place % buckets).alias("bucket"), F.floor(place / buckets).alias("slot"))
    if keep_ms is not None:
        rows = rows.withColumn("at", F.timestamp_millis("seen")).withWatermark("at", lateness)
    return rows.groupBy("bucket").transformWithStateInPandas(FirstEnvelopes(columns, keep_ms), f"{schema}, kind string, first_sha256 string", "append", "None" if keep_ms is None else "EventTime")


def start_sink(stream: DataFrame, path: str, checkpoint: str, schema: str, buckets: int = 4096, keep_ms: int | None = None) -> StreamingQuery:
    """Appends a stream's facts and conflicts to the table at path. Each batch has its own folder, written whole: one that runs
    again after a failure starts from the state before it and writes the same rows again."""

    def put(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").partitionBy("kind").parquet(f"{path}/batch={batch_id}")

    return stream_first_envelopes(stream, schema, buckets, keep_ms).writeStream.outputMode("append").option("checkpointLocation", checkpoint).foreachBatch(put).trigger(availableNow=True).start()


def read_sink(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """table: facts, or conflicts, which also have first_sha256."""
    rows = spark.read.schema(f"{schema}, first_sha256 string, batch bigint, kind string").parquet(path).where(F.col("kind") == table[:-1]).drop("batch", "kind")
    return rows if table == "conflicts" else rows.drop("first_sha256")


def roll_months(daily: DataFrame, now_ms: int) -> DataFrame:
    """Monthly bars, forming ones too, from a batch or table of streamed daily bars."""
    return bars.resample_bars_months(daily, "1d", "1M", now_ms)


def with_finality(rows: DataFrame, mode: str, interval: str, now_ms: int | None = None, parts: int | None = None, timeout_ms: int = 5000) -> DataFrame:
    """is_closed by: flag (the source's own), coverage (all parts are there, closed), next (a later bucket was seen), timeout
    (now is timeout_ms past the end), end (the input has ended)."""
    from pyspark.sql import Window

    end = iv.bucket_next(F.col("open_time"), interval)
    rules = {
        "flag": scalars.is_closed_col(F.col("source_closed")) if "source_closed" in rows.columns else F.lit(False),
        "coverage": (F.col("closed_parts") == F.lit(parts)) if "closed_parts" in rows.columns else F.lit(False),
        "next": F.col("open_time") < F.max("open_time").over(Window.partitionBy(*SERIES)) if mode == "next" else F.lit(False),
        "timeout": F.lit(now_ms) >= end + timeout_ms,
        "end": F.lit(True),
    }
    return rows.withColumn("is_closed", F.coalesce(rules[mode], F.lit(False)))


def stream_prices(ticks: DataFrame, daily: DataFrame, minutes: DataFrame) -> DataFrame:
    """A batch of price snapshots with their day's open and change; daily and minutes are tables of bars."""
    return scalars.daily_change(joins.daily_open(ticks, daily, minutes))


def alert_hits(rows: DataFrame, rule_id: str, expression: dict) -> DataFrame:
    """Bars (with their previous values) on which a rule holds."""
    return rows.where(alerts.compile_alert(expression, set(rows.columns))).withColumn("rule_id", F.lit(rule_id))
