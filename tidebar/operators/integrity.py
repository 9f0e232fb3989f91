"""Which of several rows for one key holds: upserts, merges, repeats, contiguity, reconciliation and feed health."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars
from ..schemas import SERIES


def _best(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The row of each key with the greatest order. An aggregate, so rows of a key combine before the shuffle."""
    rest = [c for c in rows.columns if c not in keys]
    picked = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("best_row"))
    return picked.select(*keys, *[F.col(f"best_row.{c}").alias(c) for c in rest]).select(*rows.columns)


def _both(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    return existing.withColumn("arrival", F.lit(0)).unionByName(incoming.withColumn("arrival", F.lit(1)))


def upsert_rollups(existing: DataFrame, incoming: DataFrame, keys: list[str]) -> DataFrame:
    """An incoming row replaces iff it is final where the stored one is, and was received later, or then with a revision
    no lower. So a final row received earlier does not displace a later provisional one."""
    fresh = _best(incoming, keys, [F.col("is_final").cast("int"), F.col("received_at_ms"), F.col("revision")])
    fields = [c for c in existing.columns if c not in keys]
    e = existing.select(*keys, F.struct(*fields).alias("e"))
    i = fresh.select(*keys, F.struct(*fields).alias("i"))
    rows = e.join(i, keys, "full_outer")
    newer = (F.col("i.received_at_ms") > F.col("e.received_at_ms")) | ((F.col("i.received_at_ms") == F.col("e.received_at_ms")) & (F.col("i.revision") >= F.col("e.revision")))
    takes = F.col("e").isNull() | ((F.col("i.is_final").cast("int") >= F.col("e.is_final").cast("int")) & newer)
    return rows.select(*keys, F.when(F.coalesce(takes, F.lit(False)), F.col("i")).otherwise(F.col("e")).alias("x")).select(*keys, *[F.col(f"x.{c}").alias(c) for c in fields]).select(*existing.columns)


#: Key columns of each kind of metric.
METRIC_KEYS = {"funding": ["funding_cycle_ms"], "premium": ["interval", "open_time_ms"], "open_interest": ["period", "event_time_ms"]}


def upsert_metric(existing: DataFrame, incoming: DataFrame, kind: str) -> DataFrame:
    """Final wins, then the later received, then the incoming. Funding is keyed by its time rounded to the minute."""
    rows = _both(existing, incoming)
    if kind == "funding":
        rows = rows.withColumn("funding_cycle_ms", scalars.funding_cycle(F.col("funding_time_ms")))
    final = F.col("is_final").cast("int") if "is_final" in rows.columns else F.lit(0)
    return _best(rows, [*SERIES, *METRIC_KEYS[kind]], [final, F.col("received_at_ms"), F.col("arrival")]).drop("arrival")


def upsert_bars(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """A bar is replaced by one of the same or a higher rank of source, never by a lower."""
    rows = _both(existing, incoming).withColumn("rank", scalars.source_rank(F.col("source")))
    return _best(rows, [*SERIES, "interval", "open_time"], [F.col("rank"), F.col("arrival")]).drop("arrival", "rank")


def delete_range(bars: DataFrame, key: dict[str, str], start_ms: int, end_ms: int) -> DataFrame:
    """bars without those of the key in [start, end]."""
    hit = F.col("open_time").between(start_ms, end_ms)
    for c, v in key.items():
        hit = hit & (F.col(c) == v)
    return bars.where(~F.coalesce(hit, F.lit(False)))


def merge_metric(a: DataFrame, b: DataFrame, newest: int | None = None) -> DataFrame:
    """Samples of both; of one time the better provenance_rank, then revision, then received_at; at most the newest n."""
    rows = _best(_both(a, b), [*SERIES, "sample_time"], [F.col("provenance_rank"), F.col("revision"), F.col("received_at_ms"), F.col("arrival")]).drop("arrival")
    if newest is None:
        return rows
    nth = F.row_number().over(Window.partitionBy(*SERIES).orderBy(F.desc("sample_time")))
    return rows.withColumn("nth", nth).where(F.col("nth") <= newest).drop("nth")


def merge_settlements(a: DataFrame, b: DataFrame) -> DataFrame:
    """Settlements by cycle; the second source holds."""
    rows = _both(a, b).withColumn("cycle", scalars.funding_cycle(F.col("funding_time_ms")))
    return _best(rows, [*SERIES, "cycle"], [F.col("arrival"), F.col("funding_time_ms")]).drop("arrival")


def merge_rollups(a: DataFrame, b: DataFrame, live: DataFrame | None = None) -> tuple[DataFrame, DataFrame | None]:
    """Rollups of both: final, then updated_at, then revision. And the live events that no rollup covers."""
    rows = _best(_both(a, b), [*SERIES, "open_time"], [F.col("is_final").cast("int"), F.col("updated_at_ms"), F.col("revision"), F.col("arrival")]).drop("arrival")
    if live is None:
        return rows, None
    minute = F.col("trade_time_ms") - F.pmod("trade_time_ms", F.lit(60_000))
    return rows, live.withColumn("open_time", minute).join(rows.select(*SERIES, "open_time"), [*SERIES, "open_time"], "left_anti").drop("open_time")


def merge_bars(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """Stored and rebuilt bars by rank of source; of equal ranks the stored one."""
    rows = _both(rebuilt, stored).withColumn("rank", scalars.source_rank(F.col("source")))
    return _best(rows, [*SERIES, "open_time"], [F.col("rank"), F.col("arrival")]).drop("arrival", "rank")


def dedupe_fingerprint(events: DataFrame, column: str = "fingerprint") -> DataFrame:
    return events.dropDuplicates([column])


def canonical_events(events: DataFrame) -> DataFrame:
    """The first envelope of each (stream, event id) by offset, with how often it came again and how often another
    content came under its id (conflicts)."""
    key, place = ["kafka_topic", "event_id"], F.struct("kafka_partition", "kafka_offset")
    rest = [c for c in events.columns if c not in key]
    by_hash = events.groupBy(*key, "envelope_sha256").agg(F.count("*").alias("n"), F.min(place).alias("at"), F.min_by(F.struct(*[c for c in rest if c != "envelope_sha256"]), place).alias("x"))
    rows = by_hash.groupBy(*key).agg(F.min_by(F.struct("envelope_sha256", "x", "n"), "at").alias("first"), F.sum("n").alias("all"))
    return rows.select(*key, F.col("first.envelope_sha256").alias("envelope_sha256"), "first.x.*", (F.col("first.n") - 1).alias("duplicates"), (F.col("all") - F.col("first.n")).alias("conflicts"))


def event_conflicts(events: DataFrame) -> DataFrame:
    """Events whose content differs from the first envelope under their id."""
    first = canonical_events(events).select("kafka_topic", "event_id", F.col("envelope_sha256").alias("first_sha256"))
    return events.join(first, ["kafka_topic", "event_id"]).where("envelope_sha256 <> first_sha256")


def contiguity_breaks(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """Places where a sequence repeats, goes back or leaves out numbers."""
    out = rows.select(*keys, F.col(sequence).alias("sequence"))
    out = out.withColumn("sequence_before", F.lag("sequence").over(Window.partitionBy(*keys).orderBy("sequence")))
    return out.where(F.col("sequence") != F.col("sequence_before") + 1).withColumn("kind", F.when(F.col("sequence") == F.col("sequence_before"), "repeat").otherwise("gap"))


def require_contiguous(rows: DataFrame, keys: list[str], sequence: str) -> DataFrame:
    """rows, if nothing breaks their sequence; ValueError otherwise."""
    if not contiguity_breaks(rows, keys, sequence).isEmpty():
        raise ValueError(f"{sequence} is not contiguous")
    return rows


SNAPSHOT = "exchange string, market_type string, symbol string, open_time bigint, sequence bigint, high double, low double, volume double, is_closed boolean, authoritative boolean"


def accept_snapshots(snapshots: DataFrame) -> DataFrame:
    """Snapshots of a bar in order of sequence, those kept that do not regress: the high falling, the low rising, the
    volume falling, or a closed bar opening, unless authoritative and newer. A repeated sequence needs progress."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[tuple, object] = {}
        for frame in frames:
            keep = []
            for r in frame.itertuples():
                key = (r.exchange, r.market_type, r.symbol, r.open_time)
                old = held.get(key)
                ok = old is None or _accepts(old, r)
                if ok:
                    held = {key: r}
                keep.append(ok)
            yield frame[keep]

    rows = snapshots.select(*[c.split()[0] for c in SNAPSHOT.split(", ")])
    parts = rows.repartition(*SERIES, "open_time").sortWithinPartitions(*SERIES, "open_time", "sequence", F.desc("authoritative"), "volume")
    return parts.mapInPandas(run, SNAPSHOT)


def _accepts(old, new) -> bool:
    regress = new.high < old.high or new.low > old.low or new.volume < old.volume or (old.is_closed and not new.is_closed)
    progress = new.high > old.high or new.low < old.low or new.volume > old.volume or (new.is_closed and not old.is_closed)
    if new.sequence > old.sequence:
        return not regress or bool(new.authoritative)
    return not regress and progress


def accept_books(books: DataFrame) -> DataFrame:
    """Adds verdict to book updates in order of arrival: accepted if the id is beyond all before, duplicate if it equals
    the largest, else stale."""
    seen = F.max("last_update_id").over(Window.partitionBy(*SERIES).orderBy("arrival").rowsBetween(Window.unboundedPreceding, -1))
    rows = books.withColumn("seen", seen)
    return rows.withColumn("verdict", F.when(F.col("seen").isNull() | (F.col("last_update_id") > F.col("seen")), "accepted").when(F.col("last_update_id") == F.col("seen"), "duplicate").otherwise("stale")).drop("seen")


STAGES = ["source", "writer", "archive", "query"]


def reconcile(cursors: DataFrame) -> DataFrame:
    """cursors: stream, stage, offset. Whether the stages agree: caught_up, lagging (a later stage behind an earlier),
    mismatch (a later stage ahead), or missing."""
    rows = cursors.groupBy("stream").pivot("stage", STAGES).agg(F.max("offset"))
    pairs = list(zip(STAGES, STAGES[1:]))
    some = lambda test: F.greatest(*[F.coalesce(test(F.col(a), F.col(b)), F.lit(False)) for a, b in pairs])
    missing = F.greatest(*[F.col(s).isNull() for s in STAGES])
    return rows.withColumns({"code": F.when(missing, "missing").when(some(lambda a, b: b > a), "mismatch").when(some(lambda a, b: b < a), "lagging").otherwise("caught_up"), "lag": F.col("source") - F.col("query")})


def feed_health(events: DataFrame, keys: list[str]) -> DataFrame:
    """Per feed: received, malformed, repeats, out of order, missing units of sequence, and receive latency (least, p50,
    p95, p99, greatest; the ceil(n p)-th smallest)."""
    arrived = Window.partitionBy(*keys).orderBy("received_at_ms", "arrival")
    best = F.max("sequence").over(arrived.rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumns({"best": best, "latency": F.col("received_at_ms") - F.col("event_time_ms"), "bad": F.col("sequence").isNull() | F.col("event_time_ms").isNull()})
    again = F.row_number().over(Window.partitionBy(*keys, "sequence").orderBy("received_at_ms", "arrival")) > 1
    rows = rows.withColumn("again", again & ~F.col("bad"))
    gap = F.when(F.col("sequence") > F.col("best") + 1, F.col("sequence") - F.col("best") - 1).otherwise(0)
    pick = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY latency)")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("received"), F.count_if("bad").alias("malformed"), F.count_if("again").alias("repeats"), F.count_if((F.col("sequence") < F.col("best")) & ~F.col("again")).alias("out_of_order"), F.sum(gap).alias("missing_units"),
        F.min("latency").alias("latency_min"), pick(0.5).alias("latency_p50"), pick(0.95).alias("latency_p95"), pick(0.99).alias("latency_p99"), F.max("latency").alias("latency_max"),
    )


def activity_score(access: DataFrame, now_ms: int, keys: list[str]) -> DataFrame:
    """Hourly sums of weight in the last 7 days, faded by 1 + age in days; counts over an hour, a day and a week."""
    hour = F.col("time_ms") - F.pmod("time_ms", F.lit(3_600_000))
    rows = access.where(F.col("time_ms").between(now_ms - 7 * 86_400_000, now_ms)).groupBy(*keys, hour.alias("hour")).agg(F.sum("weight").alias("weight"), F.count("*").alias("n"), F.max("time_ms").alias("last"))
    age = (F.lit(now_ms) - F.col("hour")) / 3_600_000
    since = lambda h: F.sum(F.when(age <= h, F.col("n")).otherwise(0))
    return rows.groupBy(*keys).agg(F.round(F.sum(F.col("weight") / (1 + age / 24)), 8).alias("score"), since(1).alias("n_1h"), since(24).alias("n_24h"), F.sum("n").alias("n_7d"), F.max("last").alias("last_seen"))
