"""Golden cases of single rules."""

import pytest
from pyspark.sql import functions as F

from tidebar import registry
from tidebar.functions import alerts, scalars
from tidebar.functions import intervals as iv
from tidebar.operators import bars, calendars, flow, indicators, integrity, joins, paging, projections, ranges, text_match
from tidebar.sources import files, raw
from tidebar.streaming import keyed

KEY = ("x", "spot", "A")
BAR = "exchange string, market_type string, symbol string, open_time bigint, close_time bigint, open double, high double, low double, close double, volume double, quote_volume double, trades bigint, taker_buy_base double, taker_buy_quote double, source string, is_closed boolean"
MIN = 60_000


def bar(t, o=10.0, h=11.0, low=9.0, c=10.5, v=10.0, q=1000.0, n=2, b=6.0, bq=600.0, source="backfill", width=MIN):
    return (*KEY, t, t + width - 1, o, h, low, c, v, q, n, b, bq, source, True)


def closes(spark, values):
    return spark.createDataFrame([bar(i * MIN, c, c, c, c) for i, c in enumerate(map(float, values))], BAR)


def test_intervals():
    assert iv.parse_interval("60m").name == "1h" and iv.parse_interval("7d").name == "7d"
    assert iv.intervals_equivalent("60m", "1h") and not iv.intervals_equivalent("7d", "1w") and not iv.intervals_equivalent("30d", "1M")
    assert iv.interval_tiles("1d", "1M") and iv.interval_tiles("1h", "1w") and not iv.interval_tiles("2d", "1w") and iv.interval_tiles("1M", "3M")
    for bad in ("0m", "5x", "", "13000M", "999999999999999d"):
        with pytest.raises(ValueError):
            iv.parse_interval(bad)


def test_interval_columns(spark):
    rows = spark.createDataFrame([("60m",), ("90s",), ("0m",), ("7d",), (None,), ("12001M",)], "s string").select(iv.canonical_interval(F.col("s")).alias("c")).collect()
    assert [r.c for r in rows] == ["1h", "90s", None, "7d", None, None]
    t = spark.createDataFrame([(-1,), (345_600_000,)], "t bigint")
    assert [tuple(r) for r in t.select(iv.bucket_floor(F.col("t"), "1m"), iv.bucket_floor(F.col("t"), "1w"), iv.bucket_floor(F.col("t"), "5M")).collect()] == [(-60_000, -259_200_000, iv_month(-5)), (345_600_000, 345_600_000, 0)]


def iv_month(n):
    import datetime as d

    return int(d.datetime(1970 + n // 12, n % 12 + 1, 1, tzinfo=d.timezone.utc).timestamp() * 1000)


def test_order_flow(spark):
    rows = scalars.enrich_order_flow(spark.createDataFrame([bar(0), bar(MIN, b=12.0), bar(2 * MIN, q=0.0)], BAR)).orderBy("open_time").collect()
    assert (rows[0].taker_sell_base, rows[0].volume_delta_base, rows[0].taker_buy_ratio_base) == (4.0, 2.0, 0.6)
    assert rows[1].taker_sell_base is None and rows[2].taker_buy_base is None and rows[2].quote_volume is None


def test_resample(spark):
    src = spark.createDataFrame([bar(0, v=10.0, q=1000.0, n=2, b=6.0, bq=650.0), bar(MIN, v=20.0, q=2000.0, n=3, b=9.0, bq=900.0), bar(2 * MIN)], BAR)
    rows = bars.resample_bars(src, "1m", "2m", 10 * MIN).collect()
    assert [(r.open_time, r.volume, r.quote_volume, r.trades, r.taker_buy_base, r.taker_buy_quote) for r in rows] == [(0, 30.0, 3000.0, 5, 15.0, 1550.0)]
    assert bars.resample_bars(src, "1m", "2m", MIN).count() == 0
    with pytest.raises(ValueError):
        bars.resample_bars(src, "2d", "1w", 0)


def test_rank_is_monotone(spark):
    a = spark.createDataFrame([("1m", *bar(0, c=1.0, source="backfill"))], "interval string, " + BAR)
    b = spark.createDataFrame([("1m", *bar(0, c=2.0, source="data_manager_closed"))], "interval string, " + BAR)
    c = spark.createDataFrame([("1m", *bar(0, c=3.0, source="backfill_archive_verified"))], "interval string, " + BAR)
    assert integrity.upsert_bars(a, b).first().close == 1.0
    assert integrity.upsert_bars(a, c).first().close == 3.0
    assert integrity.merge_bars(a, c).first().close == 1.0


def test_gap_kinds_of_months(spark):
    months = [iv_month((2024 - 1970) * 12 + m - 1) for m in (3, 6)]
    rows = spark.createDataFrame([bar(t) for t in months], BAR)
    want = spark.createDataFrame([(*KEY, iv_month(54 * 12), iv_month(54 * 12 + 6))], "exchange string, market_type string, symbol string, start bigint, end bigint")
    got = calendars.detect_gaps(rows, want, "1M", 4_000_000_000_000).orderBy("start").collect()
    assert [(r.kind, r.bars) for r in got] == [("HEAD", 2), ("INTERIOR", 2), ("TAIL", 1)]
    assert [r.kind for r in calendars.detect_gaps(rows.limit(0), want, "1M", 4_000_000_000_000).collect()] == ["TAIL"]


def test_session_calendar_over_a_change_of_clocks(spark):
    c = calendars.SessionCalendar("America/New_York", ((4, 570, 960), (0, 570, 960)), holidays=("2024-03-15",))
    seg = calendars.session_segments(spark, c, 1_709_856_000_000, 1_710_547_200_000).orderBy("start").collect()
    assert [(r.start, r.end - r.start + 1) for r in seg] == [(1_709_908_200_000, 23_400_000), (1_710_163_800_000, 23_400_000)]


def test_indicators_against_loops(spark):
    x = [float(v) for v in (5, 7, 6, 9, 12, 11, 8, 7, 7, 10, 14, 13, 12, 15, 16, 14, 13, 17)] * 40
    rows = closes(spark, x)
    n, y, want = 5, None, []
    for i, v in enumerate(x):
        y = sum(x[:n]) / n if i == n - 1 else None if i < n else y + (v - y) * 2 / (n + 1)
        want.append(y)
    got = [r.ema for r in indicators.ema(rows, n).orderBy("open_time").collect()]
    assert got[:4] == [None] * 4 and all(abs(a - b) < 1e-9 for a, b in zip(got[4:], want[4:]))
    flat = indicators.rsi(closes(spark, range(1, 30)), 14).orderBy("open_time").collect()
    assert flat[13].rsi is None and flat[14].rsi == 100.0
    short = indicators.ema(closes(spark, [1, 2]), 5).collect()
    assert [r.ema for r in short] == [None, None]
    with pytest.raises(ValueError):
        indicators.ordered([{"id": "a", "after": "b"}, {"id": "b", "after": "a"}])


def test_projections():
    rows = lambda v: list(enumerate(v))
    bricks, _ = projections.renko_steps(rows([100, 131, 111, 109]), 10)
    assert [(b[3], b[4], b[7]) for b in bricks] == [("up", 100, 110), ("up", 110, 120), ("up", 120, 130), ("down", 120, 110)]
    lines, _ = projections.line_break_steps(rows([10, 12, 14, 13, 9]), 3)
    assert [(b[3], b[4], b[7]) for b in lines] == [("up", 10, 12), ("up", 12, 14), ("down", 12, 9)]
    legs, _ = projections.kagi_steps(rows([10, 14, 13, 11, 16]), 3)
    assert [(b[3], b[4], b[7], b[9]) for b in legs] == [("up", 10, 14, "yin"), ("down", 14, 11, "yin"), ("up", 11, 16, "yin>yang@14")]
    columns, _ = projections.point_figure_steps(rows([10, 15, 12, 13]), 1, 3)
    assert [(b[3], b[6], b[5]) for b in columns] == [("x", 11, 15), ("o", 12, 14)]
    whole, _ = projections.renko_steps(rows([100, 131, 111, 109, 150]), 10)
    first, state = projections.renko_steps(rows([100, 131, 111]), 10)
    rest, _ = projections.renko_steps([(3, 109), (4, 150)], 10, state)
    assert first + rest == whole


def test_ranges(spark):
    r = lambda rows: spark.createDataFrame(rows, "k string, start bigint, end bigint")
    got = ranges.subtract_ranges(r([("a", 0, 100), ("b", 5, 6)]), r([("a", 10, 20), ("a", 21, 30), ("a", 90, 200)]), ["k"]).orderBy("k", "start").collect()
    assert [tuple(x) for x in got] == [("a", 0, 9), ("a", 31, 89), ("b", 5, 6)]
    assert ranges.seeded_index("s", 7) == ranges.seeded_index("s", 7) < 7


def test_alert_rules(spark):
    df = spark.createDataFrame([(5.0, None), (1.0, 3.0)], "a double, previous_a double")
    run = lambda e: [r[0] for r in df.select(alerts.compile_alert(e, set(df.columns))).collect()]
    assert run({"type": "AND", "conditions": []}) == [True, True] and run({"type": "OR", "conditions": []}) == [False, False] and run({"type": "NOT"}) == [True, True]
    assert run({"left": "a", "comparator": "between", "right": {"min": 6, "max": 4}}) == [True, False]
    assert run({"left": "missing", "comparator": ">", "right": 1}) == [False, False]
    assert run({"left": "a", "comparator": "changePercentBelow", "right": -50}) == [False, True]
    assert run({"type": "NOT", "child": {"left": "missing", "comparator": ">", "right": 1}}) == [True, True]


def test_late_trades_only_fill_gaps():
    f = keyed.TradeFlow()
    assert f.add(100, 1000, 1.0, 2.0, False) and f.add(103, 5000, 1.0, 1.0, True)
    assert not f.add(99, 900, 1.0, 1.0, False) and not f.add(101, 9000, 1.0, 1.0, False)
    assert f.add(102, 4000, 1.0, 1.0, False) and f.gaps == [[101, 101, 1000, 4000]]
    assert f.add(101, 2000, 1.0, 1.0, False) and f.gaps == []
    assert f.rows({0}) == [(0, 4.0, 1.0, 4, False)]


def test_alert_limits():
    assert keyed.fires([0, 10, 25, 60, 90], 20, 3, 90)[0] == [0, 25, 60]


def test_text_match():
    t = b"append app"
    assert text_match.find_all(t, [b"app", b"append"]) == [(0, 0, 3), (0, 7, 10)]
    assert text_match.find_all(t, [b"app", b"append"], "leftmost-longest") == [(1, 0, 6), (0, 7, 10)]
    assert len(text_match.find_all(t, [b"p", b"pp"], overlapping=True)) == 6
    assert text_match.find_all(t, [b"app"], most=1) == [(0, 0, 3)]


def test_csv_and_raw(spark, tmp_path):
    (tmp_path / "k.csv").write_text("open_time,open,high,low,close,volume,close_time,q,n,b,bq,i\n0,1,2,1,2,5,59999,9,3,2,4,0\n120000,1,2,1,2,5,179999,9,3,2,4,0\n180001,1,2,1,2,5,239999,9,3,2,4,0\n")
    good, bad = files.read_kline_csv(spark, str(tmp_path / "k.csv"), KEY, "1m")
    assert [r.segment for r in good.orderBy("open_time").collect()] == [1, 2] and "alignment" in bad.first().reasons
    (tmp_path / "t.csv").write_text("id,p,q,f,l,t,m\n1,10,2,1,1,1000,true\n2,11,1,2,3,2000,false\n4,11,1,3,5,3000,false\n")
    good, bad = files.read_agg_trade_csv(spark, str(tmp_path / "t.csv"), KEY)
    assert [r.quote_quantity for r in good.orderBy("agg_trade_id").collect()] == [20.0, 11.0] and bad.first().reasons == ["id_gap", "raw_overlap"]
    msgs = spark.createDataFrame([("depth", "x", "spot", '{"s":"A","U":1,"u":2,"b":[["9","1"]],"a":[]}'), ("depth", "x", "spot", "nothing")], "kind string, exchange string, market_type string, payload string")
    good, bad = raw.normalize_raw_events(msgs, "depth")
    assert good.first().bids[0].price == 9.0 and bad.count() == 1


def test_archive_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("t", 0, i, str(i), "k", i, i, i, str(i), "{}") for i in range(10)], "kafka_topic string, kafka_partition int, kafka_offset bigint, event_id string, partition_key string, event_time_ms bigint, sequence_start bigint, sequence_end bigint, envelope_sha256 string, envelope_json string")
    files.write_event_archive(rows, str(tmp_path / "a"), 4)
    events, manifest = files.read_event_archive(spark, str(tmp_path / "a"))
    assert files.validate_event_archive(events, manifest, 4).count() == 0
    assert [r.reasons for r in files.validate_event_archive(events.where("kafka_offset <> 5"), manifest, 4).collect()] == [["n", "rows_sha256", "offsets_not_contiguous"]]


def test_registry(spark):
    registry.register_indicator(registry.IndicatorSpec("twice", "1", ("close",), ("twice",), {"k": 2}), lambda b, k: b.withColumn("twice", F.col("close") * k))
    assert registry.compute(closes(spark, [3]), "twice").first().twice == 6.0
    with pytest.raises(ValueError):
        registry.compute(closes(spark, [3]), "twice", other=1)


def test_asof_has_no_look_ahead(spark):
    b = spark.createDataFrame([bar(0), bar(3 * MIN), bar(6 * MIN)], BAR)
    m = spark.createDataFrame([(*KEY, 5 * MIN, 1.0), (*KEY, 3 * MIN, 2.0)], "exchange string, market_type string, symbol string, event_time_ms bigint, value double")
    assert [r.value for r in joins.asof_metric(m, b).orderBy("open_time").collect()] == [None, 2.0, 1.0]


def test_trade_flow_golden(spark):
    t = spark.createDataFrame([(*KEY, 1, 100.0, 2.0, 61_000, False, 1, 2), (*KEY, 2, 110.0, 1.0, 62_000, True, 3, 4)], "exchange string, market_type string, symbol string, agg_trade_id bigint, price double, quantity double, trade_time_ms bigint, is_buyer_maker boolean, first_trade_id bigint, last_trade_id bigint")
    r = flow.trade_flow_1m(t).first()
    assert (r.buy_base, r.sell_base, r.buy_quote, r.sell_quote, r.delta_base, r.delta_quote, r.raw_count, r.max_notional) == (2.0, 1.0, 200.0, 110.0, 1.0, 90.0, 4, 200.0)


def test_decompose():
    assert calendars.decompose("4h", ["1m", "1h", "2h"]) == [("2h", 2)] and calendars.decompose("1M", ["1h", "1d"]) == [("1d", 31)] and calendars.decompose("6M", ["1M", "3M"]) == [("3M", 2)]
    assert calendars.decompose("90m", ["1h", "30m", "1m"], greedy=True) == [("1h", 1), ("30m", 1)] and calendars.decompose("90m", ["1h", "30m"]) == [("30m", 3)]
    for wanted, natives in (("90s", ["1m"]), ("1M", ["1h"]), ("1h", [])):
        with pytest.raises(ValueError):
            calendars.decompose(wanted, natives)
    with pytest.raises(ValueError):
        calendars.decompose("90s", ["1m"], greedy=True)


def test_registries(spark):
    rows = closes(spark, [1, 2, 3])
    spec = registry.IndicatorSpec("doubled", "1", ("close",), ("twice",), {"times": 2}, 3)
    registry.register_indicator(spec, lambda b, times: b.withColumn("twice", times * F.col("close")))
    assert [r.twice for r in registry.compute(rows, "doubled").orderBy("open_time").collect()] == [2, 4, 6] and indicators.WARM_UP["doubled"]() == 3
    for call in (lambda: registry.register_indicator(spec, lambda b: b), lambda: registry.compute(rows, "doubled", other=1), lambda: registry.compute(rows.drop("close"), "doubled")):
        with pytest.raises(ValueError):
            call()
    registry.register_calendar("test_days", calendars.SessionCalendar("UTC", ((0, 60, 120),)))
    with pytest.raises(ValueError):
        registry.register_calendar("test_days", calendars.SessionCalendar("UTC", ()))
    assert [r.is_closed for r in registry.apply_finality(rows, lambda: F.when(F.col("close") > 1, F.col("close") > 2)).orderBy("open_time").collect()] == [False, False, True]


def test_require_contiguous(spark):
    good = spark.createDataFrame([("a", 1), ("a", 2), ("b", 7)], "k string, s bigint")
    assert integrity.require_contiguous(good, ["k"], "s").count() == 3
    for more in (2, 5):
        with pytest.raises(ValueError):
            integrity.require_contiguous(good.union(spark.createDataFrame([("a", more)], good.schema)), ["k"], "s")


def test_states_carry_on(spark):
    values = [10, 11, 13, 12, 9, 9.5, 14, 15, 11, 10, 16, 8, 8.4, 12]
    rows, sizes = closes(spark, values), projections.fixed_size(closes(spark, values), 0.1, 1.0)
    for chart in projections.CHARTS:
        own = sizes.withColumn("size", F.lit(3)) if chart == "line_break" else sizes
        options = {"reversal": 2} if chart == "point_figure" else {}
        whole = {r.axis_order: tuple(r) for r in projections.carry_on(chart, rows, own, **options)[0].collect()}
        early, states = projections.carry_on(chart, rows.where(F.col("open_time") < 6 * MIN), own, **options)
        late, _ = projections.carry_on(chart, rows.where(F.col("open_time") >= 6 * MIN), own, states, **options)
        parts = {r.axis_order: tuple(r) for r in early.collect()}
        assert whole and parts | {r.axis_order: tuple(r) for r in late.collect()} == whole, chart


def test_late_minutes_leave_the_state_with_their_sums():
    flow = keyed.TradeFlow(most_minutes=2)
    for i in range(5):
        flow.add(i + 1, i * MIN, 1.0, 2.0, False)
    assert [(r[0] // MIN, r[1]) for r in flow.rows({3, 4})] == [(i, 2.0) for i in range(5)]
    assert [r[0] // MIN for r in flow.rows({0, 4})] == [4]


def test_long_series_of_few_chunks(spark):
    values = [float(i % 17) for i in range(700)]
    got = [r.ema for r in indicators.ema(closes(spark, values), 5).orderBy("open_time").collect()]
    y = sum(values[:5]) / 5
    want = [None] * 4 + [y]
    for v in values[5:]:
        y = y + (v - y) / 3
        want.append(y)
    assert got[:4] == want[:4] and all(abs(a - b) < 1e-9 for a, b in zip(got[4:], want[4:]))


@pytest.mark.parametrize("fold", [False, True])
@pytest.mark.parametrize("deep", [2, 5, 24])
def test_automaton_is_brute_force(fold, deep):
    import random

    r = random.Random(deep)
    say = lambda n: "".join(r.choice("aAbcé ") for _ in range(n)).encode()
    patterns = list(dict.fromkeys([say(r.randint(1, 12)) for _ in range(400)] + [b"ab", b"abab", b"b" * 30, b"", b"abcabc" * 9]))
    texts = [say(n) for n in (0, 1, 7, 300, 5000, 2048, 2049)] + [b"b" * 5000, b"abcabc" * 900, b"\xff\x00" + say(40)]
    low = (lambda b: b.lower()) if fold else (lambda b: b)
    got = text_match.Automaton(patterns, fold, deep).search(texts)
    for text, hits in zip(texts, got):
        for kind in ("standard", "leftmost-first", "leftmost-longest"):
            for overlapping in (False, True):
                want = text_match.find_all(low(text), [low(p) for p in patterns], kind, overlapping)
                assert text_match._chosen(list(hits), kind, overlapping, None) == want
    # a table that would not fit reads fewer bytes of each pattern, and finds the same
    small = text_match.Automaton(patterns, fold, 24, 20_000)
    assert small.deep < 24 and list(map(sorted, small.search(texts))) == list(map(sorted, got))


def test_match_patterns_table(spark):
    patterns = [f"w{i} " for i in range(40)] + ["w1", "w1 w2 w3"]
    docs = spark.createDataFrame([(1, "W1 w2 w3 w39 w1"), (2, None), (3, ""), (None, "w7 é w8 ")], "doc_id bigint, text string")
    for kind in ("standard", "leftmost-first", "leftmost-longest"):
        got = {tuple(r) for r in text_match.match_patterns(docs, patterns, kind, fold_case=True).collect()}
        want = {(d, *m) for d, t in ((1, "w1 w2 w3 w39 w1"), (None, "w7 é w8 ")) for m in text_match.find_all(t.encode(), [p.encode() for p in patterns], kind)}
        assert got == want
    assert text_match.match_patterns(docs, patterns, "standard", most=1).count() == 2


def mean_from(values, first, n, decay):
    """The recurrence close by close: the mean of n values from `first`, then decay * y + (1 - decay) * value."""
    out, y = [], None
    for i, v in enumerate(values):
        if i == first + n - 1:
            y = sum(values[first : i + 1]) / n
        elif i >= first + n:
            y = decay * y + (1 - decay) * v
        out.append(y if i >= first + n - 1 else None)
    return out


@pytest.mark.parametrize("fast,slow,signal", [(12, 26, 9), (3, 300, 1), (1, 5, 7), (26, 12, 40)])
def test_scans_equal_the_recurrence_over_chunks_stretches_and_short_series(spark, fast, slow, signal):
    day = 86_400_000
    wave = lambda n, k: [50 + (i * k % 17) + (i % 5) * 0.3 for i in range(n)]
    # A: minutes, several chunks in a stretch; B: days over many stretches; C: one bar in a stretch; D: too short
    series = {"A": (MIN, wave(900, 7)), "B": (day, wave(400, 5)), "C": (31 * day, wave(60, 3)), "D": (MIN, wave(8, 3))}
    rows = [(*KEY[:2], s, i * step, 0, c, c, c, c, *bar(0)[9:]) for s, (step, values) in series.items() for i, c in enumerate(values)]
    table = spark.createDataFrame(rows, BAR).repartition(5)
    got = {s: [] for s in series}
    for r in indicators.rsi(indicators.macd(table, fast, slow, signal), 14).orderBy("open_time").collect():
        got[r.symbol].append((r.dif, r.dea, r.rsi))
    indicators.release()
    for s, (_, x) in series.items():
        f, g = mean_from(x, 0, fast, 1 - 2 / (fast + 1)), mean_from(x, 0, slow, 1 - 2 / (slow + 1))
        dif = [a - b if a is not None and b is not None else None for a, b in zip(f, g)]
        begin = max(fast, slow) - 1
        dea = [None] * min(begin, len(x)) + mean_from(dif[begin:], 0, signal, 1 - 2 / (signal + 1))
        change = [0.0] + [b - a for a, b in zip(x, x[1:])]
        up, down = (mean_from([max(sign * c, 0.0) for c in change], 1, 14, 13 / 14) for sign in (1, -1))
        rsi = [None if u is None else 100.0 if d == 0 else 100 - 100 / (1 + u / d) for u, d in zip(up, down)]
        assert len(got[s]) == len(x)
        for row, want in zip(got[s], zip(dif, dea, rsi)):
            for a, b in zip(row, want):
                assert a is b is None or a == pytest.approx(b, rel=1e-9, abs=1e-9)


def test_holes_equal_a_walk_over_all_buckets(spark):
    for interval, step, count in (("1m", MIN, 9000), ("1M", None, 40)):
        starts = [i * step for i in range(count)] if step else [month_ms(i) for i in range(count)]
        gone = {i for i in range(count) if i % 7 in (2, 3) or i in (0, 1, count - 1) or 4000 < i < 8200}
        table = spark.createDataFrame([bar(t) for i, t in enumerate(starts) if i not in gone] + [bar(starts[20] + 5)], BAR)
        want, run = [], []
        for i in range(count + 1):
            if i in gone:
                run.append(starts[i])
            elif run:
                want.append((run[0], run[-1], len(run)))
                run = []
        key = dict(zip(("exchange", "market_type", "symbol"), KEY))
        _, verdict = paging.query_range(table, key, interval, starts[0], starts[-1])
        got = verdict.first()
        assert [tuple(r) for r in got.missing_ranges] == want and got.missing == len(gone) and got.expected_bars == count
        assert sorted(tuple(r)[3:] for r in paging.holes(table, interval, starts[0], starts[-1]).collect()) == want
        empty = paging.query_range(table.limit(0), key, interval, starts[0], starts[-1])[1].first()
        assert [tuple(r) for r in empty.missing_ranges] == [(starts[0], starts[-1], count)] and not empty.verified_contiguous and not empty.renderable


def month_ms(i):
    import datetime as dt

    return int(dt.datetime(1970 + i // 12, i % 12 + 1, 1, tzinfo=dt.timezone.utc).timestamp() * 1000)


def test_release_leaves_no_table_cached(spark):
    indicators.release()
    before = spark.sparkContext._jsc.getPersistentRDDs().size()
    got = indicators.macd(closes(spark, [float(i % 9) for i in range(80)]))
    assert got.count() == 80 and spark.sparkContext._jsc.getPersistentRDDs().size() > before
    indicators.release()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == before


def test_gaps_by_calendar(spark):
    """A market open from Monday to Friday, 10:00 to 12:00 in UTC; 1970-01-05 is a Monday."""
    day, hour = 86_400_000, 3_600_000
    at = lambda d, h: (4 + d) * day + h * hour  # noqa: E731  d: days after that Monday
    opens = calendars.session_opens(calendars.session_segments(spark, calendars.SessionCalendar("UTC", tuple((d, 600, 720) for d in range(5))), at(-7, 0), at(14, 0)), "1h")
    want = spark.createDataFrame([(*KEY, at(0, 0), at(9, 0)), ("x", "spot", "B", at(0, 0), at(1, 0))], "exchange string, market_type string, symbol string, start bigint, end bigint")
    there = [at(0, 11), at(1, 10), at(1, 11), at(2, 10), at(3, 10), at(3, 11), at(4, 10), at(7, 11)]
    rows = spark.createDataFrame([bar(t, width=hour) for t in [*there, at(5, 10)]], BAR)  # the last is on a Saturday
    find = lambda now=at(30, 0), tolerance=0, **more: [(r.symbol, r.start, r.end, r.bars, r.kind) for r in calendars.detect_gaps(rows, want, "1h", now, tolerance, opens, **more).orderBy("symbol", "start").collect()]
    a = [("A", at(0, 10), at(0, 10), 1, "HEAD"), ("A", at(2, 11), at(2, 11), 1, "INTERIOR"), ("A", at(4, 11), at(7, 10), 2, "INTERIOR"), ("A", at(8, 10), at(8, 11), 2, "TAIL")]
    b = [("B", at(0, 10), at(0, 11), 2, "TAIL")]
    assert find() == a + b
    assert find(tolerance=1) == a[2:] + b
    assert find(most_holes=1) == [a[0], a[1], a[3], *b]
    assert find(now=at(8, 11)) == [*a[:3], ("A", at(8, 10), at(8, 10), 1, "TAIL"), *b]
    assert calendars.detect_gaps(rows.limit(0), want.limit(0), "1h", at(30, 0), 0, opens).count() == 0
    numbered = calendars.numbered_opens(opens)
    places = [tuple(r) for r in numbered.orderBy("open_time").collect()]
    assert [n for _, n in places] == list(range(30)) and [t for t, _ in places] == sorted(t for t, _ in places)
    marks = keyed.bar_continuity_in_order(rows.withColumns({"arrival": F.col("open_time"), "correction": F.lit(False)}), numbered)
    assert sorted((r.first_open, r.last_open, r.at_open, r.expected_bars) for r in marks.collect()) == [(at(2, 11), at(2, 11), at(3, 10), 1), (at(4, 11), at(7, 10), at(7, 11), 2)]


def test_event_pages(spark):
    """Pages by cursor come to the whole, ties included; a cursor works for its own snapshot, range and key alone."""
    rows = spark.createDataFrame([("t", n % 2, n, n // 4 * 10, f"k{n % 3}") for n in range(23)], "kafka_topic string, kafka_partition int, kafka_offset bigint, event_time_ms bigint, partition_key string")
    whole = sorted((t, p, o) for _, p, o, t, _ in rows.collect() if o < 20 and 0 <= t <= 40)
    got, cursor, sizes = [], None, []
    for limit in (3, 8, 5, 9):
        page, cursor = paging.query_event_page(rows, 20, 0, 40, limit, cursor)
        part = [(r.event_time_ms, r.kafka_partition, r.kafka_offset) for r in page.collect()]
        got, sizes = got + part, [*sizes, len(part)]
    assert got == whole and sizes == [3, 8, 5, 4] and cursor is None
    page, cursor = paging.query_event_page(rows, 20, 0, 40, 7, partition_key="k1")
    assert cursor is None and page.count() == 7
    _, cursor = paging.query_event_page(rows, 20, 0, 40, 3)
    for wrong in ((19, 0, 40, 3, cursor), (20, 0, 41, 3, cursor), (20, 0, 40, 3, cursor, "k1"), (20, 0, 40, 3, "x"), (20, 0, 40, 3, "[]"), (20, 0, 40, 0), (20, 5, 4, 1)):
        with pytest.raises(ValueError):
            paging.query_event_page(rows, *wrong)
    page, cursor = paging.query_event_page(rows.limit(0), 20, 0, 40, 3)
    assert page.count() == 0 and cursor is None


def test_channel_messages(spark):
    import json

    row = ["60000", "1", "3", "0.5", "2", "100", "7", "8", "20", "1"]
    candle = ["2678400000", *row[1:7], "20", "1"]
    put = lambda channel, data, market="spot": ("x", market, json.dumps({"arg": {"channel": channel, "instId": "A"}, "data": data}))
    sent = [
        put("candle1M", [candle]), put("candle1Dutc", [candle, candle[:8] + ["0"]], "SWAP"), put("candle4H", [candle[:8], candle]), put("candle9X", [candle]), put("candle1m", [["x", *candle[1:]]]), put("candle1m", []),
        put("tickers", [{"instId": "A", "last": "11", "open24h": "10", "ts": "5"}, {"instId": "B", "last": "3"}]), put("tickers", [{"last": "1"}]), put("books", [{}]), ("x", "spot", "{"), ("x", "spot", None), ("x", "spot", "{}"),
    ]
    bars_, ticks, bad = raw.normalize_channel_events(spark.createDataFrame(sent, "exchange string, market_type string, payload string"))
    day = 86_400_000
    got = sorted((r.interval, r.open_time, r.close_time, r.volume, r.quote_volume, r.is_closed) for r in bars_.collect())
    assert got == [("1M", 31 * day, 59 * day - 1, 100.0, 20.0, True), ("1d", 31 * day, 32 * day - 1, 7.0, 20.0, False), ("1d", 31 * day, 32 * day - 1, 7.0, 20.0, True), ("4h", 31 * day, 31 * day + 4 * 3_600_000 - 1, 100.0, 20.0, True)]
    assert sorted((r.symbol, r.close, r.change_pct, r.event_time_ms) for r in ticks.collect()) == [("A", 11.0, 10.0, 5), ("B", 3.0, 0.0, None)]
    wrong = [sent[2], sent[3], sent[4], sent[5], sent[7], sent[8], *sent[9:]]
    assert sorted((r.payload or "") for r in bad.collect()) == sorted((p or "") for _, _, p in wrong)


def test_named_archive(spark, tmp_path):
    head = "instrument_name,open,high,low,close,vol,vol_ccy,vol_quote,open_time,confirm"
    lines = ["a,1,2,1,2,100,5,9,0,1", "a,1,2,1,2,100,5,9,60000,1", "a,1,2,1,2,100,5,9,60000,1", "A,1,2,1,2,100,5,9,180000,1", "a,1,2,1,2,100,5,9,240000,0", "b,1,2,1,2,100,5,9,0,1", "a,1,2,1,2,100,5,9,300001,1", "a,1,2,3,2,100,5,9,360000,1", "a,1,2,1,2,100,5,9,900000,1"]
    path = tmp_path / "k.csv"
    path.write_text("\n".join([head, *lines]))
    good, bad = files.read_named_kline_csv(spark, str(path), ("x", "swap", "A"), "1m", (0, 600_000))
    assert sorted((r.open_time, r.volume, r.segment) for r in good.collect()) == [(0, 5.0, 1), (60_000, 5.0, 1), (180_000, 5.0, 2)]
    assert sorted((r.symbol, r.open_time, r.reasons[0]) for r in bad.collect()) == [("A", 60_000, "not_increasing"), ("A", 240_000, "unconfirmed"), ("A", 300_001, "grid"), ("A", 360_000, "bounds"), ("A", 900_000, "period"), ("B", 0, "instrument")]
    assert {r.volume for r in files.read_named_kline_csv(spark, str(path), ("x", "spot", None))[0].collect()} == {100.0}
    path.write_text("\n".join(["other" + head, *lines]))
    with pytest.raises(Exception, match="(?i)header"):
        files.read_named_kline_csv(spark, str(path), ("x", "spot", None))[0].collect()


def test_corrected_bars_are_read_from_the_state_before(spark):
    """A corrects the bar at a state's edge, B loses all bars from one on, C stays; what is before the states is not given."""
    values = [10, 11, 13, 12, 9, 9.5, 14, 15, 11, 10, 16, 8, 8.4, 12]
    rows = closes(spark, values).unionByName(closes(spark, values[::-1]).withColumn("symbol", F.lit("B"))).unionByName(closes(spark, values).withColumn("symbol", F.lit("C")))
    sizes = projections.fixed_size(rows, 0.1, 1.0).persist()
    ordered = lambda df: sorted(tuple(r) for r in df.collect())
    key = "exchange string, market_type string, symbol string, open_time bigint"

    def hold(chart, at, options):
        own = sizes.withColumn("size", F.lit(3)) if chart == "line_break" else sizes
        first = rows.where(f"symbol <> 'B' or open_time < {6 * MIN}")
        now = first.withColumn("close", F.when((F.col("symbol") == "A") & (F.col("open_time") == at * MIN), 30.0).otherwise(F.col("close")))
        steps, log = (df.persist() for df in projections.with_checkpoints(chart, rows, own, 3 * MIN, **options))
        want, want_log = projections.with_checkpoints(chart, now, own, 3 * MIN, **options)
        seen = now.where(f"symbol = 'A' and open_time >= {at // 3 * 3 * MIN}")
        corrected = spark.createDataFrame([(*KEY, at * MIN), (*KEY, (at + 1) * MIN), ("x", "spot", "B", 6 * MIN)], key)
        got, got_log = projections.after_corrections(chart, seen, own, steps, log, corrected, 3 * MIN, **options)
        assert steps.where("growing").count() == (3 if chart in ("kagi", "point_figure") else 0), chart
        assert sorted(r.through // MIN for r in log.where("symbol = 'A'").collect()) == [3, 6, 9, 12, 15], chart
        assert ordered(got) == ordered(want), chart
        assert ordered(got_log.drop("state")) == ordered(want_log.drop("state")), chart

    for chart in projections.CHARTS:
        hold(chart, 9, {"reversal": 2} if chart == "point_figure" else {})
    hold("kagi", 0, {})
