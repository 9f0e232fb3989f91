"""Streams over files give what their batch twins give."""

import pytest
from conftest import SF
from pyspark.sql import functions as F

from tidebar.operators import bars
from tidebar.plans import tables
from tidebar.streaming import bars as sb
from tidebar.streaming import alerting, books, keyed


def source(spark, tmp_path):
    rows = tables.trades(spark, SF)
    rows.orderBy("trade_time_ms").coalesce(1).write.option("maxRecordsPerFile", 300).parquet(str(tmp_path / "in"))
    return rows


def collect(stream, tmp_path, name, mode):
    got = []
    q = stream.writeStream.outputMode(mode).option("checkpointLocation", str(tmp_path / name)).foreachBatch(lambda b, i: got.extend((i, *r) for r in b.collect())).trigger(availableNow=True).start()
    q.awaitTermination()
    return got


def test_bars(spark, tmp_path):
    rows = source(spark, tmp_path)
    got = collect(sb.stream_bars(sb.read_trades(spark, str(tmp_path / "in"), 10), "1h").select("symbol", "open_time", "open", "close", "volume"), tmp_path, "c", "update")
    last = {r[1:3]: r[3:] for r in sorted(got)}
    want = {(r.symbol, r.open_time): (r.open, r.close, r.volume) for r in bars.bars_from_trades(rows, "1h").collect()}
    assert last == want


def test_merged_latest(spark, tmp_path):
    rows = spark.createDataFrame([("x", "spot", "A", "c", 1, 1, 1, 1.0), ("x", "spot", "A", "c", 3, 1, 1, 3.0), ("x", "spot", "A", "c", 2, 1, 1, 2.0)], "exchange string, market_type string, symbol string, channel string, sequence bigint, event_time_ms bigint, received_at_ms bigint, value double")
    rows.coalesce(1).write.option("maxRecordsPerFile", 1).parquet(str(tmp_path / "s"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "s"))
    sb.start_merge(stream, str(tmp_path / "out"), str(tmp_path / "c2"), sb.merge_latest, sb.LATEST).awaitTermination()
    assert sb.read_merged(spark, str(tmp_path / "out"), sb.LATEST).first().value == 3.0


def test_trade_flow_state(spark, tmp_path, rocks):
    rows = source(spark, tmp_path)
    stream = sb.read_trades(spark, str(tmp_path / "in"), 10)
    got = collect(keyed.stream_trade_flow(stream), tmp_path, "c3", "update")
    last = {r[3:5]: r[5:8] for r in sorted(got)}
    want = rows.groupBy("symbol", (F.floor(F.col("trade_time_ms") / 60_000) * 60_000).alias("t")).agg(F.count("*").alias("n")).collect()
    assert {k: v[2] for k, v in last.items()} == {(r.symbol, r.t): r.n for r in want}
    twin = keyed.trade_flow_in_order(rows.withColumn("arrival", F.col("agg_trade_id"))).collect()
    assert {(r.symbol, r.open_time): r.agg_count for r in twin} == {(r.symbol, r.t): r.n for r in want}


EVENT = "kafka_topic string, kafka_partition int, kafka_offset bigint, event_id string, envelope_sha256 string"


def batches(spark, tmp_path, rows, schema, name):
    """A stream with each list of rows as a batch of its own."""
    for i, part in enumerate(rows):
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(tmp_path / name / f"{i}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / name))


def test_sink_with_conflicts_over_batches(spark, tmp_path, rocks):
    rows = [[("t", 0, 1, "a", "x"), ("t", 0, 2, "b", "x")], [("t", 0, 3, "a", "y"), ("t", 0, 4, "b", "x"), ("t", 0, 5, "c", "x")], [("t", 0, 6, "c", "z"), ("t", 0, 7, "c", "x")]]
    sb.start_sink(batches(spark, tmp_path, rows, EVENT, "e"), str(tmp_path / "s"), str(tmp_path / "c"), EVENT).awaitTermination()
    facts = {(r.event_id, r.kafka_offset) for r in sb.read_sink(spark, str(tmp_path / "s"), "facts", EVENT).collect()}
    conflicts = {(r.event_id, r.kafka_offset, r.first_sha256) for r in sb.read_sink(spark, str(tmp_path / "s"), "conflicts", EVENT).collect()}
    assert facts == {("a", 1), ("b", 2), ("c", 5)} and conflicts == {("a", 3, "x"), ("c", 6, "x")}
    # a batch that runs again after a failure starts from the state before it and changes nothing
    (tmp_path / "c" / "commits" / "2").unlink()
    (tmp_path / "c" / "commits" / ".2.crc").unlink(missing_ok=True)
    stream = spark.readStream.schema(EVENT).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(str(tmp_path / "e"))
    sb.start_sink(stream, str(tmp_path / "s"), str(tmp_path / "c"), EVENT).awaitTermination()
    assert {(r.event_id, r.kafka_offset) for r in sb.read_sink(spark, str(tmp_path / "s"), "facts", EVENT).collect()} == facts


def test_old_versions_of_a_merged_table_go(spark, tmp_path):
    schema = "exchange string, market_type string, symbol string, channel string, sequence bigint, event_time_ms bigint, received_at_ms bigint, value double"
    rows = [[("x", "spot", "A", "c", i, 1, 1, float(i))] for i in (1, 4, 3, 5)]
    stream = batches(spark, tmp_path, rows, schema, "m")
    sb.start_merge(stream, str(tmp_path / "out"), str(tmp_path / "c4"), sb.merge_latest, sb.LATEST).awaitTermination()
    got = sb.read_merged(spark, str(tmp_path / "out"), sb.LATEST).first()
    assert (got.sequence, got.value, got.revision) == (5, 5.0, 3)
    assert sorted(p.name for p in (tmp_path / "out").iterdir() if p.name.startswith("data")) == ["data-2", "data-3"]


def test_late_liquidation_updates_its_minute(spark, tmp_path):
    schema = "exchange string, market_type string, symbol string, order_side string, order_type string, time_in_force string, original_quantity double, order_price double, average_price double, last_filled_quantity double, filled_quantity double, order_status string, trade_time_ms bigint, event_time_ms bigint, pair_symbol string, symbol_type string"
    event = lambda t, q, side="SELL": ("x", "spot", "A", side, "LIMIT", "IOC", q, 10.0, 10.0, q, q, "FILLED", t, t, "A", "PERP")
    rows = [[event(1000, 1.0), event(1000, 1.0)], [event(70_000, 2.0, "BUY")], [event(2000, 3.0)]]
    got = collect(sb.stream_liquidations(batches(spark, tmp_path, rows, schema, "l"), "5 minutes").select("open_time", "long_notional", "short_notional", "n"), tmp_path, "c5", "update")
    minutes = [(r[1], float(r[2]), float(r[3]), r[4]) for r in sorted(got)]
    assert minutes == [(0, 10.0, 0.0, 1), (60_000, 0.0, 20.0, 1), (0, 40.0, 0.0, 2)]


def test_alerts_and_continuity_over_batches(spark, tmp_path):
    hit = lambda t: ("r", "x", "spot", "A", t, 1000, 3, 9000)
    schema = "rule_id string, exchange string, market_type string, symbol string, close_time bigint, cooldownMs bigint, maxTriggers bigint, expiresAt bigint"
    stream = batches(spark, tmp_path, [[hit(0), hit(500)], [hit(900), hit(1000)], [hit(5000), hit(8000), hit(9500)]], schema, "a")
    assert sorted(r[-1] for r in collect(keyed.stream_alerts(stream), tmp_path, "c6", "append")) == [0, 1000, 5000]
    mark = lambda s, n, again=False: ("x", "spot", "A", s, n, again)
    schema = "exchange string, market_type string, symbol string, sequence bigint, arrival bigint, correction boolean"
    stream = batches(spark, tmp_path, [[mark(1, 1), mark(2, 2)], [mark(5, 3), mark(2, 4), mark(3, 5, True)], [mark(6, 6), mark(9, 7)]], schema, "g")
    got = [tuple(r[4:]) for r in sorted(collect(keyed.stream_continuity(stream), tmp_path, "c7", "update"), key=lambda r: r[0])]
    assert sorted(got, key=str) == sorted([("gap", 3, 4, 5), ("repeat", None, None, 2), ("gap", 7, 8, 9)], key=str)


ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture
def rocks(spark):
    key = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(key)
    spark.conf.set(key, ROCKS)
    yield
    spark.conf.set(key, before)


def delta(first, final, previous, bids=(), asks=(), arrival=None, symbol="A"):
    as_levels = lambda xs: [{"price": float(p), "quantity": float(q)} for p, q in xs]
    return ("x", "perp", symbol, "delta", first, final, previous, as_levels(bids), as_levels(asks), final if arrival is None else arrival)


def snapshot(last, arrival, bids=((99, 1), (100, 1)), asks=((101, 3), (102, 4)), symbol="A"):
    return (*delta(None, last, None, bids, asks, arrival, symbol)[:3], "snapshot", *delta(None, last, None, bids, asks, arrival, symbol)[4:])


def test_book_over_batches(spark, tmp_path, rocks):
    rows = [
        # waits, one of the two older than the snapshot to come; B's first delta can't bridge
        [delta(98, 99, 97), delta(99, 101, 99, [(100, 2)], [(102, 0)]), snapshot(100, 1, symbol="B"), delta(105, 105, 104, arrival=2, symbol="B")],
        [snapshot(100, 500), delta(102, 103, 101, [(98, 5)], [(103, 6)], 501)],
        # a repeat, an older one, then a gap; B's snapshot arrives and what waited bridges
        [delta(102, 103, 101, [(98, 5)], [(103, 6)], 502), delta(90, 95, 89, arrival=503), delta(107, 108, 106, [(97, 1)], [], 504), snapshot(104, 505, symbol="B")],
        [delta(109, 110, 108, [(97, 0), (96, 2)], [(104, 1)], 506), delta(106, 106, 105, [(100, 0)], [(101, 9)], 507, "B")],
        [snapshot(108, 600, [(97, 1)], [(103, 1)]), delta(111, 111, 110, [(95, 1)], [], 601)],
        [delta(112, 112, 111, [(104, 1)], [], 602), delta(107, 107, 106, [(100, 4)], [(101, 8)], 603, "B"), delta(107, 107, 106, [(100, 5)], [(101, 8)], 604, "B")],
    ]
    stream = batches(spark, tmp_path, rows, books.EVENTS, "b")
    got = {(r[0], r[3]): r for r in collect(books.stream_book(stream), tmp_path, "cb", "update")}
    plain = lambda n, s: (got[n, s][7], got[n, s][4], [(x.price, x.quantity) for x in got[n, s][5]], [(x.price, x.quantity) for x in got[n, s][6]], got[n, s][9], got[n, s][10])
    assert plain(0, "A") == ("syncing", None, [], [], 0, None)
    assert plain(1, "A") == ("live", 103, [(100, 2), (99, 1), (98, 5)], [(101, 3), (103, 6)], 0, None)
    assert plain(2, "A") == ("resync", None, [], [], 1, "gap")
    assert plain(3, "A")[0] == "resync"
    assert plain(4, "A") == ("live", 111, [(96, 2), (95, 1)], [(103, 1), (104, 1)], 0, None)
    assert plain(5, "A") == ("resync", None, [], [], 1, "crossed")
    assert plain(0, "B") == ("resync", None, [], [], 1, "gap")
    assert plain(2, "B")[:2] == ("live", 105)
    assert plain(3, "B") == ("live", 106, [(99, 1)], [(101, 9), (102, 4)], 0, None)
    assert plain(5, "B") == ("resync", None, [], [], 1, "conflict")


def test_spot_book_and_bounds(spark, tmp_path, rocks):
    rows = [[delta(98, 100, None), delta(100, 102, None, [(100, 7)])], [snapshot(100, 200), delta(101, 103, None, [(100, 2)], arrival=201)], [delta(105, 105, None)]]
    got = [(r[7], r[4], [x.quantity for x in r[5]]) for r in sorted(collect(books.stream_book(batches(spark, tmp_path, rows, books.EVENTS, "b"), futures=False), tmp_path, "cb", "update"))]
    assert got == [("syncing", None, []), ("live", 103, [2, 1]), ("resync", None, [])]
    book = books.Book(True, 2)
    for i in range(4):
        book.delta(books.Delta(i, i, i - 1, []))
    assert (book.reason, book.breaks, [d.final for d in book.waiting]) == ("overflow", 1, [2, 3])
    book.snapshot(2, [("bids", 1.0, 1.0)])
    assert (book.state, book.reason) == ("resync", "empty")


BAR_EVENT = "exchange string, market_type string, symbol string, interval string, event_type string, timestamp_ms bigint, arrival bigint, close double, volume double"


def test_rules_with_values_before_over_batches(spark, tmp_path, rocks):
    import random

    r = random.Random(4)
    rows, at = [], {"A": 0, "B": 0}
    for i in range(160):
        s = r.choice("AAB")
        at[s] += 1
        kind = r.choice(["BAR_CREATED", "BAR_UPDATED", "BAR_UPDATED", "BAR_CLOSED", "BAR_AMENDED"])
        rows.append(("x", "spot", s, "1m", kind, i * 1000, i, None if r.random() < 0.05 else float(r.randint(90, 110)), float(r.randint(1, 9))))
    cross = {"left": "close", "comparator": "crossesAbove", "right": 100}
    rules = [
        {"id": "close", "expression": cross, "cooldownMs": 9000},
        {"id": "update", "expression": cross, "triggerOn": "bar_update", "maxTriggers": 5},
        {"id": "any", "expression": {"type": "AND", "conditions": [{"left": "close", "comparator": "percentChangeBelow", "right": -3}, {"left": "volume", "comparator": ">", "right": 2}]}, "triggerOn": "realtime", "target": {"symbol": "A"}, "expiresAt": 90_000},
        {"id": "off", "enabled": False, "expression": cross},
    ]
    listens = {"close": ["BAR_CLOSED"], "update": ["BAR_UPDATED", "BAR_CLOSED", "BAR_AMENDED"], "any": ["BAR_CREATED", "BAR_UPDATED", "BAR_CLOSED", "BAR_AMENDED"]}
    want, before, last, n = [], {}, {}, {}
    for _, _, s, _, kind, t, _, close, volume in rows:
        for rule in rules[:3]:
            key = (rule["id"], s)
            if kind not in listens[rule["id"]]:
                continue
            p, before[key] = before.get(key), close
            if rule["id"] == "any":
                holds = s == "A" and t < 90_000 and None not in (p, close) and (close - p) / abs(p) * 100 < -3 and volume > 2
            else:
                holds = None not in (p, close) and p <= 100 < close
            if holds and t - last.get(key, -(10**9)) >= rule.get("cooldownMs", 0) and n.get(key, 0) < rule.get("maxTriggers", 10**9):
                last[key], n[key] = t, n.get(key, 0) + 1
                want.append((*key, t))
    stream = batches(spark, tmp_path, [rows[:70], rows[70:90], rows[90:]], BAR_EVENT, "r")
    got = [(x[1], x[4], x[6]) for x in collect(alerting.stream_rule_alerts(stream, rules), tmp_path, "cr", "append")]
    assert sorted(got) == sorted(want) and {x[0] for x in want} == {"close", "update", "any"}


TRADE = "exchange string, market_type string, symbol string, agg_trade_id bigint, trade_time_ms bigint, quantity double, is_buyer_maker boolean, arrival bigint"


def test_sink_forgets_what_expires(spark, tmp_path, rocks):
    schema = EVENT + ", event_time_ms bigint"
    rows = [[("t", 0, 1, "a", "x", 1000)], [("t", 0, 2, "a", "y", 50_000), ("t", 0, 3, "b", "x", 200_000)], [("t", 0, 4, "a", "z", 210_000), ("t", 0, 5, "b", "y", 220_000)]]
    sb.start_sink(batches(spark, tmp_path, rows, schema, "e"), str(tmp_path / "s"), str(tmp_path / "c"), schema, keep_ms=100_000).awaitTermination()
    read = lambda t: {(r.event_id, r.envelope_sha256) for r in sb.read_sink(spark, str(tmp_path / "s"), t, schema).collect()}
    assert read("facts") == {("a", "x"), ("b", "x"), ("a", "z")} and read("conflicts") == {("a", "y"), ("b", "y")}


def test_trade_flow_overflow_expiry_and_prefix(spark, tmp_path, rocks):
    at = lambda i, t, n: ("x", "spot", "A", i, t, 1.0, i % 2 == 0, n)
    m = 60_000
    prefix = spark.createDataFrame([at(8, 10, 0), at(9, 20, 0)], TRADE)
    rows = [
        [at(10, 30, 1), at(11, m, 2), at(13, m + 5, 3), at(15, 2 * m, 4)],  # gaps at 12 and 14
        [at(17, 3 * m, 5), at(12, m + 1, 6)],  # a third gap at 16: the oldest, 12, is given up, so 12 comes too late
        [at(14, m + 9, 7), at(18, 4 * m, 8), at(19, 5 * m, 9)],  # 14 fills its gap; minutes 0, 1, ... leave
        [at(16, 2 * m + 1, 10), at(20, 6 * m, 11)],  # 16's minute has left
    ]
    got = sorted(collect(keyed.stream_trade_flow(batches(spark, tmp_path, rows, TRADE, "f"), prefix, most_gaps=2, most_minutes=3), tmp_path, "cf", "update"))
    last = {r[4] // m: (r[5] + r[6], r[7], r[8]) for r in got}
    assert last[0] == (3.0, 3, True)
    assert last[1] == (3.0, 3, False)  # given up
    assert last[2][2] is False and last[3][2] is False  # 16 stays open until their minutes leave
    assert last[4] == last[5] == last[6] == (1.0, 1, True)
    flow = keyed.TradeFlow(2, 3)
    for i in range(0, 4000, 2):
        flow.take(i, i * m, 1.0, False)
    assert len(flow.gaps) <= 2 and len(flow.minutes) == 3 and len(flow.lost) <= 3
