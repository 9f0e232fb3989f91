"""Tables on which queries once differed from their SQL twins: prices of zero, ids that don't follow time, much that waits."""

import datetime as dt
import glob
import os

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from conftest import SF
from pyspark.sql import functions as F
from test_queries import plain
from test_streams import batches, collect, rocks  # noqa: F401

from tidebar import catalog
from tidebar.operators import book, flow
from tidebar.plans import chart_queries, market_queries, tables
from tidebar.streaming import bars as sb
from tidebar.streaming import books

EVENT = "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string"


@pytest.fixture
def zero_prices(spark, tmp_path):
    """Events every 20 minutes, of which some have the value 0; the 40th and 80th of a type are among them."""
    start = dt.datetime(2024, 1, 1)
    rows = [(i, start + dt.timedelta(minutes=20 * i), i, "click", 0.0 if i % 13 == 0 else float(i % 7 + 1), f'{{"k": {i % 20}}}') for i in range(400)]
    assert rows[39][4] == 0
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def same_as_sql(spark, name, sf):
    duck = duckdb.connect()
    duck.execute("SET TimeZone = 'UTC'")
    for f in glob.glob(f"{sf}/*.parquet"):
        duck.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f + '/*.parquet' if os.path.isdir(f) else f}'")
    got, want = plain(catalog.QUERIES[name](spark, sf).toPandas()), plain(duck.execute(catalog.ORACLES[name]).df())
    assert len(want) and got.astype(str).equals(want[list(got.columns)].astype(got.dtypes.to_dict()).astype(str))


def test_bars_with_a_price_of_zero_come_back_from_files(spark, zero_prices):
    same_as_sql(spark, "src1_kline_files", zero_prices)


def test_named_bars_with_a_price_of_zero_come_back_from_files(spark, zero_prices):
    same_as_sql(spark, "src1_named_files", zero_prices)


def test_trades_with_a_price_of_zero_come_back_from_files(spark, zero_prices):
    same_as_sql(spark, "src2_trade_files", zero_prices)


def test_more_deltas_wait_than_the_default_bound(spark, tmp_path, rocks):
    """12000 deltas in three batches wait for a snapshot that has the first 500 of them."""
    delta = lambda i: ("x", "spot", "A", "delta", i, i, i - 1, [(100.0 - i % 50, float(i % 7))], [(101.0 + i % 50, 1.0 + i)], i)
    parts = [[delta(i) for i in range(n, n + 4000)] for n in (1, 4001, 8001)]
    shot = ("x", "spot", "A", "snapshot", None, 500, None, [(50.0, 9.0)], [(200.0, 9.0)], 20_000)
    stream = lambda name: batches(spark, tmp_path, [*parts, [shot]], books.EVENTS, name)
    got = {r[0]: r for r in collect(books.stream_book(stream("a"), most_waiting=None), tmp_path, "ca", "update")}
    assert [got[n][7] for n in range(4)] == ["syncing"] * 3 + ["live"] and got[3][4] == 12_000
    last = {i % 50: i for i in range(501, 12_001)}
    bids, asks = {100.0 - k: i % 7 for k, i in last.items() if i % 7} | {50.0: 9.0}, {101.0 + k: 1 + i for k, i in last.items()} | {200.0: 9.0}
    assert [(x.price, x.quantity) for x in got[3][5]] == sorted(bids.items(), reverse=True) and [(x.price, x.quantity) for x in got[3][6]] == sorted(asks.items())
    bounded = {r[0]: r for r in collect(books.stream_book(stream("b")), tmp_path, "cb", "update")}
    assert (bounded[2][7], bounded[2][10]) == ("resync", "overflow")


def test_continuity_of_batches_in_many_frames_and_of_ids_that_do_not_follow_time(spark, tmp_path):
    """12000 events of a type whose ids run against time, dealt to files so that a task gets them in no order."""
    n = 12_000
    rows = spark.range(n).repartition(6).select("id", F.when(F.col("id") % 5 == 0, "view").otherwise("click").alias("event_type"))
    at = F.timestamp_micros(F.lit(1_704_067_200_000_000) + (n - F.col("id")) * 1_000_000).cast("timestamp_ntz")
    rows.select(F.col("id").alias("event_id"), at.alias("ts"), F.lit(1).cast("bigint").alias("user_id"), "event_type", F.lit(1.0).alias("value"), F.lit('{"k": 1}').alias("props")).write.parquet(str(tmp_path / "events.parquet"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "500")
    try:
        same_as_sql(spark, "str8_stream_continuity", str(tmp_path))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


@pytest.fixture
def no_small_tables(spark):
    """Sizes decide nothing here, and plans stand as they are made."""
    wanted = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def sorted_joins(df):
    return df._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin")


def test_books_are_grouped_without_bringing_a_series_together(spark, no_small_tables):
    rows = market_queries.books(spark, SF)
    catalog_ = rows.select("exchange", "market_type", "symbol").distinct().withColumn("tick", F.lit(1.0))
    # of the books and of the catalog, each joins orders and lines once
    assert sorted_joins(book.group_book(rows, catalog_, 10)) == 2


def test_book_windows_lie_where_their_groups_are(spark, no_small_tables):
    plan = chart_queries.QUERIES["agg10_book_window"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    # both sides are of one pass over the books, beside that for the catalog
    assert plan.count("collect_set") == 2 and plan.count("SortMergeJoin") == 2


def test_volume_profile_does_not_bring_a_series_together(spark, no_small_tables):
    assert sorted_joins(flow.volume_profile(tables.line_trades(spark, SF), 40)) == 0


def test_deltas_of_a_series_are_checked_by_many_tasks(spark, no_small_tables):
    """Breaks, repeats and ends of stretches, against a walk over the deltas in order."""
    import random

    r, rows, want = random.Random(7), [], set()
    for s in "ABCDEF":
        last, broken, n = 10, False, 10
        for i in range(300):
            n += r.choice([1, 1, 2, 9])
            previous = last if s < "C" or r.random() > 0.004 else last - 1
            broken = broken or previous != last
            last = n
            rows.append(("x", "spot", s, n, n, previous))
            want.add((s, n, broken))
    shot = spark.createDataFrame([("x", "spot", s, 10) for s in "ABCDEF"], "exchange string, market_type string, symbol string, last_update_id bigint")
    deltas = spark.createDataFrame(rows, "exchange string, market_type string, symbol string, first_update_id bigint, final_update_id bigint, previous_final_update_id bigint")
    got = book.valid_deltas(shot, deltas, True, most=20).select("symbol", "final_update_id", "broken", F.spark_partition_id().alias("task")).collect()
    assert {(x.symbol, x.final_update_id, x.broken) for x in got} == want and len(got) == len(want) and any(x[2] for x in want)
    assert len({x.task for x in got if x.symbol == "A"}) > 1


def test_a_batch_of_the_sink_calls_its_state_by_slots():
    """5000 ids of one bucket, twice, the second time with one in ten changed."""

    class Counted(dict):
        calls = 0

        def containsKey(self, k):
            Counted.calls += 1
            return k in self

        def getValue(self, k):
            Counted.calls += 1
            return self[k]

        def updateValue(self, k, v):
            Counted.calls += 1
            self[k] = v

    sink = sb.FirstEnvelopes(["event_id", "kafka_offset"], None)
    sink.first = Counted()
    rows = pd.DataFrame({"kafka_topic": "t", "kafka_partition": 0, "kafka_offset": range(5000), "event_id": [f"e{i}" for i in range(5000)], "envelope_sha256": "x", "seen": 0, "slot": [i * 7 % sb.SLOTS for i in range(5000)]})
    (first,) = sink.handleInputRows((0,), iter([rows[:3000], rows[3000:]]), None)
    assert len(first) == 5000 and set(first["kind"]) == {"fact"} and Counted.calls == 2 * sb.SLOTS
    again = rows.assign(envelope_sha256=["y" if i % 10 == 0 else "x" for i in range(5000)])
    (second,) = sink.handleInputRows((0,), iter([again]), None)
    assert sorted(second["kafka_offset"]) == list(range(0, 5000, 10)) and set(second["kind"]) == {"conflict"} and set(second["first_sha256"]) == {"x"}
    assert Counted.calls == 4 * sb.SLOTS


def test_books_take_as_many_tasks_as_their_lines_need(spark, monkeypatch):
    monkeypatch.setattr(market_queries, "TASK_LINES", 500)
    lines = tables.read(spark, SF, "lineitem").count()
    assert int(spark.conf.get("spark.sql.shuffle.partitions")) < lines / 500 <= market_queries.books(spark, SF).rdd.getNumPartitions()


def run_of(events):
    """(first, final, previous, levels, arrival) each, a snapshot without first, as one packed run."""
    n = lambda x: books.NONE if x is None else x
    heads = [(first is None, n(first), final, n(previous), arrival, sum(x[0] == "bids" for x in levels), len(levels)) for first, final, previous, levels, arrival in events]
    return books.Run.unpack(books.Run(np.array(heads, np.int64).T, np.array([x[1:] for e in events for x in e[3]]).reshape(-1, 2).T).pack())


@pytest.mark.parametrize("futures", [True, False])
def test_runs_of_deltas_come_to_what_each_delta_alone_does(futures):
    """Repeats, gaps, snapshots, deletions, moving and crossed books, in batches of any size."""
    import random

    seen = set()
    for seed in range(60):
        r = random.Random(seed)
        last, mid, events = 10, 100, [(None, 10, None, [("bids", 99.0, 1.0), ("asks", 101.0, 1.0)], 0)]
        often, fewer, moves, crossed = r.choice([0.002, 0.05]), r.choice([0, 0.1]), r.choice([0, 0.1]), r.choice([0, 0.01])
        for i in range(600):
            levels = [(s, float(mid + sign * r.randint(r.random() >= crossed, 8)), float(r.choice([0, 1, 2, 3]))) for s, sign in (("bids", -1), ("asks", 1)) for _ in range(r.randint(0, 3))]
            mid += r.random() < moves
            if r.random() < often:
                events.append((None, last - r.choice([0, 1, 9]), None, [("bids", mid - 1.0, 1.0), ("asks", mid + 1.0, 1.0)], i))
            elif r.random() < fewer:
                events.append((last, last, last - r.choice([1, 2]), levels, i))
            else:
                gap = r.random() < often / 4
                events.append((last + 1 + gap, last + 2, last + gap, levels, i))
                last += 2
        most = r.choice([None, 40])
        alone, together, at = books.Book(futures, most), books.Book(futures, most), 0
        while at < len(events):
            n = r.choice([1, 20, 500])
            for first, final, previous, levels, _ in events[at : at + n]:
                alone.snapshot(final, levels) if first is None else alone.delta(books.Delta(first, final, previous, levels))
            together.events(run_of(events[at : at + n]))
            at += n
            of = lambda b: (b.state, b.last, b.levels, b.best, b.breaks, b.reason, b.n_waiting, b.end())
            assert of(alone) == of(together), (seed, at)
            assert b"".join(x.heads[1:4].T.tobytes() for x in map(books.Run.unpack, books._pieces(alone.waiting))) == b"".join(x.heads[1:4].T.tobytes() for x in map(books.Run.unpack, books._pieces(together.waiting)))
            seen |= {alone.state, alone.reason}
    assert seen >= {"live", "resync", "gap", "crossed", "conflict", "overflow"}


def test_a_batch_of_deltas_in_order_is_taken_in_a_few_steps(monkeypatch):
    """30000 deltas, packed from batches in no order; two in three wait, as the book then has a gap, for a second snapshot."""
    steps = []
    monkeypatch.setattr(books, "PIECE", 1 << 12)
    for name in ("delta", "_apply"):
        monkeypatch.setattr(books.Book, name, lambda self, *x, f=getattr(books.Book, name): (steps.append(1), f(self, *x))[1])
    level = lambda p, q: [{"price": p, "quantity": q}]
    rows = [("snapshot", None, 1, None, level(99.0, 1.0), level(101.0, 1.0), 0)] + [("delta", i, i, i - 1, level(99.0 - i % 50, 1.0 + i), level(101.0 + i % 50, 2.0 + i), i) for i in range(2, 30_001) if i != 10_000]
    schema = pa.schema([*((c, pa.string()) for c in ("exchange", "market_type", "symbol")), *((c, pa.int64()) for c in books.HEAD), ("prices", pa.list_(pa.float64())), ("quantities", pa.list_(pa.float64()))])
    at = np.random.default_rng(1).permutation(len(rows))
    frames = []
    for part in np.array_split(at, 7):
        xs = [rows[i] for i in part]
        columns = [["x"] * len(xs), ["spot"] * len(xs), ["A"] * len(xs), [int(x[0] == "snapshot") for x in xs], *([x[k] for x in xs] for k in (1, 2, 3, 6)), [1] * len(xs), [2] * len(xs), *([[lv[c] for side in x[4:6] for lv in side] for x in xs] for c in ("price", "quantity"))]
        frames += [b.to_pandas() for b in books._packed([pa.record_batch(columns, schema=schema)])]

    class Map(dict):
        exists = lambda self: bool(self)
        iterator = dict.items
        updateValue, getValue, removeKey = dict.__setitem__, dict.get, dict.__delitem__

    class Place:
        value = None
        exists = lambda self: self.value is not None
        get = lambda self: self.value

        def update(self, value):
            self.value = value

    processor = books.BookProcessor(True, 1000, None)
    processor.place, processor.levels, processor.waiting = Place(), Map(), Map()
    (first,) = processor.handleInputRows(("x", "spot", "A"), iter(frames), None)
    assert first["state"][0] == "resync" and first["reason"][0] == "gap" and processor.place.get()[2] == 20_000 and len(processor.waiting) > 1
    shot = run_of([(None, 20_000, None, [("bids", 98.0, 1.0), ("asks", 102.0, 1.0)], 40_000)]).pack()
    (second,) = processor.handleInputRows(("x", "spot", "A"), iter([pd.DataFrame({"events": [shot]})]), None)
    assert second["state"][0] == "live" and second["last_update_id"][0] == 30_000 and not processor.waiting and len(steps) < 100
    want = {99.0 - i % 50: 1.0 + i for i in range(20_001, 30_001)}
    assert {x["price"]: x["quantity"] for x in second["bids"][0]} == want


def test_deltas_are_numbered_once(spark):
    """Snapshot and deltas are read as they were written, not put in order again by whatever reads them."""
    for rows in chart_queries.numbered_deltas(spark, SF):
        assert "Window" not in rows._jdf.queryExecution().executedPlan().toString()


def test_levels_are_exploded_and_reduced_in_compiled_code(spark):
    rows = spark.createDataFrame([("x", "spot", "A", 1, [(9.0, 1.0), (8.0, 2.0)], None), ("x", "spot", "A", 2, [], [(10.0, 3.0), None])], "exchange string, market_type string, symbol string, last_update_id bigint, bids array<struct<price:double,quantity:double>>, asks array<struct<price:double,quantity:double>>")
    got = book.levels(rows)
    assert sorted(map(tuple, got.drop("exchange", "market_type", "symbol").collect()), key=str) == [(1, "bids", 0, 9.0, 1.0), (1, "bids", 1, 8.0, 2.0), (2, "asks", 0, 10.0, 3.0), (2, "asks", 1, None, None)]
    assert "lambda" not in got._jdf.queryExecution().executedPlan().toString()
    # of one update's two quantities for a price the one further on holds, and of two updates' the later one's
    shot = rows.where("last_update_id = 0").union(spark.createDataFrame([("x", "spot", "A", 0, [(9.0, 1.0)], [(10.0, 1.0)])], rows.schema))
    deltas = spark.createDataFrame([("x", "spot", "A", 1, 1, 0, [(9.0, 7.0), (8.0, 1.0), (9.0, 2.0)], []), ("x", "spot", "A", 2, 2, 1, [(8.0, 5.0)], [])], "exchange string, market_type string, symbol string, first_update_id bigint, final_update_id bigint, previous_final_update_id bigint, bids array<struct<price:double,quantity:double>>, asks array<struct<price:double,quantity:double>>")
    rebuilt = book.rebuild_book(shot, deltas)
    assert [(x.price, x.quantity) for x in rebuilt.first().bids] == [(9.0, 2.0), (8.0, 5.0)]
    assert "SortAggregate" not in rebuilt._jdf.queryExecution().executedPlan().toString()
