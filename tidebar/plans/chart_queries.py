"""Queries on charts whose axis is not time, and on other ordered work, with recursive SQL twins that go close by close."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import alerts
from ..operators import book, calendars, flow, funding, indicators, integrity, projections
from ..schemas import SERIES
from ..session import work_dir
from .market_queries import RULE, books
from .tables import DAY, HOUR, HOURLY, LINE_TRADES, bar_table, line_trades

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
TICK = 0.01


def query(name: str, sql: str | None = None):
    def put(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return put


SIZES = f"""{HOURLY}, x0 AS (SELECT *, row_number() OVER w - 1 AS ix, lag(close) OVER w AS pc, count(*) OVER (PARTITION BY symbol) AS n FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time)),
    x1 AS (SELECT *, CASE WHEN pc IS NULL THEN high - low ELSE greatest(high - low, abs(high - pc), abs(low - pc)) END AS tr FROM x0),
    x2 AS (SELECT symbol, avg(tr) AS seed, max(ix) AS head FROM x1 WHERE ix < least(14, n) GROUP BY symbol),
    x3 AS (SELECT symbol, sum(pow(1 - 1 / CAST(14 AS DOUBLE), n - 1 - ix) * CASE WHEN ix > head THEN tr / 14 ELSE seed END) AS atr, last(close ORDER BY open_time) AS lc FROM x1 JOIN x2 USING (symbol) WHERE ix >= head GROUP BY symbol),
    sizes AS (SELECT symbol, greatest(1, CAST(round(CASE WHEN atr > 0 THEN atr ELSE lc * 0.005 END / CAST({TICK} AS DOUBLE)) AS BIGINT)) AS size FROM x3)"""
CLOSES = f"{SIZES}, c AS (SELECT symbol, row_number() OVER (PARTITION BY symbol ORDER BY open_time) AS i, open_time AS t, CAST(round(close / CAST({TICK} AS DOUBLE)) AS BIGINT) AS c, size FROM bars JOIN sizes USING (symbol))"
NEXT = "JOIN c ON c.symbol = r.symbol AND c.i = r.i + 1"
PRICES = "round(a * CAST(0.01 AS DOUBLE), 12) AS open, round(greatest(a, b) * CAST(0.01 AS DOUBLE), 12) AS high, round(least(a, b) * CAST(0.01 AS DOUBLE), 12) AS low, round(b * CAST(0.01 AS DOUBLE), 12) AS close"


def sized(spark, sf):
    rows = bar_table(spark, sf)
    return rows, projections.box_size(rows, TICK)


def steps_of(table):
    return table.drop("exchange", "market_type")


@query("agg17_box_size", f"WITH {SIZES} SELECT symbol, CAST({TICK} AS DOUBLE) AS tick, size FROM sizes")
def agg17_box_size(spark, sf):
    return sized(spark, sf)[1].select("symbol", "tick", "size")


RENKO = f"""WITH RECURSIVE {CLOSES}, r AS (SELECT symbol, i, t, c // size * size AS mark, CAST(NULL AS BOOLEAN) AS up, CAST(0 AS BIGINT) AS ord, t AS since, CAST(0 AS BIGINT) AS k, 0 AS sg, 0 AS ag, c // size * size AS mark0, CAST(0 AS BIGINT) AS ord0, t AS since0, size FROM c WHERE i = 1 UNION ALL
    SELECT symbol, i, t, mark + sg * (k + ag) * size, CASE WHEN k > 0 THEN sg > 0 ELSE up END, ord + k, CASE WHEN k > 0 THEN t ELSE since END, k, sg, ag, mark, ord, since, size FROM (
    SELECT *, CASE WHEN sg = 0 THEN 0 ELSE sg * (c - mark) // size - ag END AS k FROM (SELECT *, CASE WHEN sg <> 0 AND up IS NOT NULL AND up <> (sg > 0) THEN 1 ELSE 0 END AS ag FROM (
    SELECT r.symbol, c.i, c.t, c.c, c.size, r.mark, r.up, r.ord, r.since, CASE WHEN c.c - mark >= c.size * (CASE WHEN up IS FALSE THEN 2 ELSE 1 END) THEN 1 WHEN mark - c.c >= c.size * (CASE WHEN up IS TRUE THEN 2 ELSE 1 END) THEN -1 ELSE 0 END AS sg FROM r {NEXT})))),
    b AS (SELECT *, unnest(range(k)) AS j FROM r WHERE k > 0), e AS (SELECT *, mark0 + sg * (j + ag) * size AS a, mark0 + sg * (j + ag + 1) * size AS b FROM b)
    SELECT symbol, ord0 + j AS axis_order, t AS source_time, j AS source_ordinal, CASE WHEN j = 0 THEN since0 ELSE t END AS source_from, CASE WHEN sg > 0 THEN 'up' ELSE 'down' END AS direction, {PRICES}, CAST(NULL AS VARCHAR) AS style FROM e"""


@query("prj2_renko", RENKO)
def prj2_renko(spark, sf):
    return steps_of(projections.renko(*sized(spark, sf)))


@query("prj3_line_break", f"""WITH RECURSIVE {CLOSES}, r AS (SELECT symbol, i, t, c AS anchor, t AS since, CAST(NULL AS BIGINT) AS l1, CAST(NULL AS BIGINT) AS h1, CAST(NULL AS BIGINT) AS l2, CAST(NULL AS BIGINT) AS h2, CAST(NULL AS BIGINT) AS l3, CAST(NULL AS BIGINT) AS h3, CAST(0 AS BIGINT) AS ord, FALSE AS made, c AS a, c AS b, t AS before FROM c WHERE i = 1 UNION ALL
    SELECT symbol, i, t, anchor, CASE WHEN made THEN t ELSE since END, CASE WHEN made THEN least(a, c) ELSE l1 END, CASE WHEN made THEN greatest(a, c) ELSE h1 END, CASE WHEN made THEN l1 ELSE l2 END, CASE WHEN made THEN h1 ELSE h2 END, CASE WHEN made THEN l2 ELSE l3 END, CASE WHEN made THEN h2 ELSE h3 END, ord + CAST(made AS BIGINT), made, a, c, since FROM (
    SELECT r.symbol, c.i, c.t, c.c, r.anchor, r.since, l1, h1, l2, h2, l3, h3, ord, CASE WHEN l1 IS NULL THEN c.c <> anchor ELSE c.c > greatest(h1, h2, h3) OR c.c < least(l1, l2, l3) END AS made, CASE WHEN l1 IS NULL THEN anchor WHEN c.c > greatest(h1, h2, h3) THEN h1 ELSE l1 END AS a FROM r {NEXT}))
    SELECT symbol, ord - 1 AS axis_order, t AS source_time, CAST(0 AS BIGINT) AS source_ordinal, before AS source_from, CASE WHEN b > a THEN 'up' ELSE 'down' END AS direction, {PRICES}, CAST(NULL AS VARCHAR) AS style FROM r WHERE made""")  # fmt: skip
def prj3_line_break(spark, sf):
    rows, sizes = sized(spark, sf)
    return steps_of(projections.line_break(rows, sizes.select(*SERIES, "tick")))


TAIL = "CASE WHEN up AND head = 'yin' AND shoulder IS NOT NULL AND b > shoulder THEN 'yang' WHEN NOT up AND head = 'yang' AND waist IS NOT NULL AND b < waist THEN 'yin' ELSE head END"


@query("prj4_kagi", f"""WITH RECURSIVE {CLOSES}, r AS (SELECT symbol, i, c AS anchor, t AS since, CAST(NULL AS BOOLEAN) AS up, c AS a, c AS b, t AS till, t AS start_, 'yin' AS head, 'yin' AS style, CAST(NULL AS BIGINT) AS shoulder, CAST(NULL AS BIGINT) AS waist, CAST(-1 AS BIGINT) AS ord FROM c WHERE i = 1 UNION ALL
    SELECT symbol, i, anchor, since, up, a, b, till, start_, head, CASE WHEN kind = 'none' THEN style ELSE {TAIL} END, shoulder, waist, ord FROM (
    SELECT symbol, i, anchor, since, kind, style, CASE kind WHEN 'first' THEN c > anchor WHEN 'turn' THEN NOT up ELSE up END AS up, CASE kind WHEN 'first' THEN anchor WHEN 'turn' THEN b ELSE a END AS a, CASE WHEN kind = 'none' THEN b ELSE c END AS b, CASE WHEN kind = 'none' THEN till ELSE t END AS till,
    CASE kind WHEN 'first' THEN since WHEN 'turn' THEN till ELSE start_ END AS start_, CASE WHEN kind IN ('first', 'turn') THEN style ELSE head END AS head, CASE WHEN kind = 'turn' AND up THEN b ELSE shoulder END AS shoulder, CASE WHEN kind = 'turn' AND NOT up THEN b ELSE waist END AS waist, ord + CASE WHEN kind IN ('first', 'turn') THEN 1 ELSE 0 END AS ord FROM (
    SELECT r.symbol, c.i, c.t, c.c, anchor, since, up, a, b, till, start_, head, style, shoulder, waist, ord, CASE WHEN up IS NULL THEN CASE WHEN abs(c.c - anchor) >= c.size THEN 'first' ELSE 'none' END WHEN (c.c - b) * (CASE WHEN up THEN 1 ELSE -1 END) > 0 THEN 'on' WHEN (b - c.c) * (CASE WHEN up THEN 1 ELSE -1 END) >= c.size THEN 'turn' ELSE 'none' END AS kind FROM r {NEXT}))),
    e AS (SELECT *, row_number() OVER (PARTITION BY symbol, ord ORDER BY i DESC) AS n FROM r WHERE up IS NOT NULL)
    SELECT symbol, ord AS axis_order, till AS source_time, CAST(0 AS BIGINT) AS source_ordinal, start_ AS source_from, CASE WHEN up THEN 'up' ELSE 'down' END AS direction, {PRICES}, CASE WHEN head = style THEN head ELSE head || '>' || style || '@' || CAST(CASE WHEN up THEN shoulder ELSE waist END AS VARCHAR) END AS style FROM e WHERE n = 1""")  # fmt: skip
def prj4_kagi(spark, sf):
    return steps_of(projections.kagi(*sized(spark, sf)))


@query("prj5_point_figure", f"""WITH RECURSIVE {CLOSES}, r AS (SELECT symbol, i, c // size * size AS edge, t AS since, CAST(NULL AS BOOLEAN) AS up, CAST(0 AS BIGINT) AS low, CAST(0 AS BIGINT) AS high, t AS till, t AS start_, CAST(-1 AS BIGINT) AS ord FROM c WHERE i = 1 UNION ALL
    SELECT symbol, i, CASE WHEN sg = 0 THEN edge ELSE edge + sg * boxes * size END, since, CASE WHEN sg = 0 THEN up ELSE sg > 0 END, CASE WHEN sg = 0 OR (same AND sg > 0) THEN low WHEN sg < 0 THEN edge - boxes * size ELSE edge + size END, CASE WHEN sg = 0 OR (same AND sg < 0) THEN high WHEN sg > 0 THEN edge + boxes * size ELSE edge - size END,
    CASE WHEN sg = 0 THEN till ELSE t END, CASE WHEN sg = 0 OR same THEN start_ WHEN up IS NULL THEN since ELSE till END, ord + CASE WHEN sg = 0 OR same THEN 0 ELSE 1 END FROM (SELECT *, abs(c - edge) // size AS boxes, up IS NOT NULL AND up = (sg > 0) AS same FROM (
    SELECT r.symbol, c.i, c.t, c.c, c.size, r.edge, r.since, up, low, high, till, start_, ord, CASE WHEN c.c - edge >= c.size * (CASE WHEN up IS FALSE THEN 3 ELSE 1 END) THEN 1 WHEN edge - c.c >= c.size * (CASE WHEN up IS TRUE THEN 3 ELSE 1 END) THEN -1 ELSE 0 END AS sg FROM r {NEXT}))),
    e AS (SELECT *, CASE WHEN up THEN low ELSE high END AS a, CASE WHEN up THEN high ELSE low END AS b, row_number() OVER (PARTITION BY symbol, ord ORDER BY i DESC) AS n FROM r WHERE up IS NOT NULL)
    SELECT symbol, ord AS axis_order, till AS source_time, CAST(0 AS BIGINT) AS source_ordinal, start_ AS source_from, CASE WHEN up THEN 'x' ELSE 'o' END AS direction, {PRICES}, CAST(NULL AS VARCHAR) AS style FROM e WHERE n = 1""")  # fmt: skip
def prj5_point_figure(spark, sf):
    return steps_of(projections.point_figure(*sized(spark, sf)))


@query("prj7_renko_carried_on", RENKO)
def prj7_renko_carried_on(spark, sf):
    """The bars in two parts, the second from the states that the first left."""
    rows, sizes = sized(spark, sf)
    middle = rows.groupBy(*SERIES).agg(F.floor((F.min("open_time") + F.max("open_time")) / 2).alias("middle"))
    rows = rows.join(middle, SERIES)
    early, states = projections.carry_on("renko", rows.where("open_time < middle"), sizes)
    late, _ = projections.carry_on("renko", rows.where("open_time >= middle"), sizes, states)
    return steps_of(early.unionByName(late))


@query("prj7_corrected_bars", RENKO)
def prj7_corrected_bars(spark, sf):
    """A chart of bars of which one in a hundred, late in each series, has a wrong close, with a state a day; then the closes are
    corrected, and each series goes on from the state before its first correction."""
    rows, sizes = sized(spark, sf)
    path = work_dir(spark)
    middle = rows.groupBy(*SERIES).agg(F.floor((F.min("open_time") + F.max("open_time")) / 2).alias("middle"))
    wrong = (F.col("open_time") > F.col("middle")) & ((F.col("open_time") / HOUR).cast("bigint") % 100 == 0)
    marked = rows.join(middle, SERIES).withColumn("wrong", wrong).drop("middle")
    before = marked.withColumn("close", F.when(F.col("wrong"), F.col("close") * 2).otherwise(F.col("close")))
    for part, name in zip(projections.with_checkpoints("renko", before, sizes, DAY), ("steps", "log")):
        part.write.parquet(f"{path}/{name}")
    steps, log = (spark.read.parquet(f"{path}/{name}") for name in ("steps", "log"))
    return steps_of(projections.after_corrections("renko", rows, sizes, steps, log, marked.where("wrong"), DAY)[0].drop("growing"))


NICE = ", ".join(repr(s) for s in flow.nice_steps())


@query("agg8_volume_profile", f"""WITH {LINE_TRADES}, span AS (SELECT symbol, max(price) - min(price) AS span, max(price) AS top FROM trades GROUP BY symbol), steps AS (SELECT CAST(unnest([{NICE}]) AS DOUBLE) AS step),
    fits AS (SELECT symbol, step, row_number() OVER (PARTITION BY symbol ORDER BY step) AS n, step > 2 * top AS above FROM span, steps WHERE step >= greatest(span / 40, top * 1e-9) / 2), tried AS (SELECT symbol, step FROM fits WHERE n <= 4 UNION SELECT symbol, min(step) FROM fits WHERE above GROUP BY symbol),
    counted AS (SELECT symbol, step, count(DISTINCT floor(price / step + 1e-9)) AS rows FROM trades JOIN tried USING (symbol) GROUP BY ALL), chosen AS (SELECT symbol, min(step) AS step FROM counted WHERE rows <= 40 GROUP BY symbol)
    SELECT symbol, step, CAST(floor(price / step + 1e-9) AS BIGINT) AS level, round(sum(CASE WHEN is_buyer_maker THEN 0 ELSE quantity END), 8) AS buy_base, round(sum(CASE WHEN is_buyer_maker THEN quantity ELSE 0 END), 8) AS sell_base, count(*) AS n, round(floor(price / step + 1e-9) * step, 8) AS price_level FROM trades JOIN chosen USING (symbol) GROUP BY symbol, step, floor(price / step + 1e-9)""")  # fmt: skip
def agg8_volume_profile(spark, sf):
    return flow.volume_profile(line_trades(spark, sf), 40).drop("exchange", "market_type").withColumnRenamed("price", "price_level")


LEVELS = "lv AS (SELECT DISTINCT o_orderkey AS last_update_id, o_orderpriority AS symbol, round(o_totalprice, 0) AS mid, l_linenumber AS n, l_quantity AS q FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"


@query("agg10_book_window", f"""WITH {LEVELS}, s AS (SELECT *, least(1000.0, pow(10.0, greatest(0.0, ceil(log10(mid * 1e-5) - 1e-9)))) AS step FROM lv), g AS (SELECT last_update_id, 'bids' AS side, step, floor((mid - n * 7) / step) * step AS level_price, q FROM s UNION ALL SELECT last_update_id, 'asks', step, ceil((mid + n * 7) / step) * step, q FROM s),
    l AS (SELECT last_update_id, side, step, level_price, sum(q) AS quantity, count(*) AS levels FROM g GROUP BY ALL), w AS (SELECT *, CASE WHEN side = 'bids' THEN max(level_price) OVER o ELSE min(level_price) OVER o END AS best, CASE WHEN side = 'bids' THEN min(level_price) OVER o ELSE max(level_price) OVER o END AS outermost FROM l WINDOW o AS (PARTITION BY last_update_id, side))
    SELECT last_update_id, side, CAST(step AS DOUBLE) AS step, level_price, CAST(quantity AS DOUBLE) AS quantity, levels FROM w WHERE abs(level_price - best) / step < 20 AND (best = outermost OR level_price <> outermost)""")  # fmt: skip
def agg10_book_window(spark, sf):
    rows = books(spark, sf)
    catalog = rows.select(*SERIES).distinct().withColumn("tick", F.lit(1.0))
    out = book.book_window(book.group_book(rows, catalog, "auto"), 20)
    return out.select("last_update_id", "side", *[F.col(c).cast("double").alias(c) for c in ("step", "level_price", "quantity")], "levels")


def numbered_deltas(spark, sf):
    """(snapshot, deltas): each series' first book, and the others as updates of it, numbered without gaps."""
    path = work_dir(spark)
    books(spark, sf).write.parquet(f"{path}/books")  # read several times, mostly for ids alone
    rows = book.in_stretches(spark.read.parquet(f"{path}/books"), "last_update_id")
    counts = rows.groupBy(*SERIES, "stretch").agg(F.count("*").alias("n"))
    begin = F.coalesce(F.sum("n").over(Window.partitionBy(*SERIES).orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = F.broadcast(counts.select(*SERIES, "stretch", begin.alias("begin")))
    heads = F.broadcast(rows.groupBy(*SERIES).agg(F.min_by(F.get("bids", F.lit(0))["price"], "last_update_id").alias("price0")))
    nth = F.row_number().over(Window.partitionBy(*SERIES, "stretch").orderBy("last_update_id"))
    numbered = rows.join(counts, [*SERIES, "stretch"]).join(heads, SERIES).withColumn("id", F.col("begin") + nth)
    shift = lambda s, sign: F.transform(s, lambda x: F.struct((F.col("price0") + sign * (F.pmod(x["price"], F.lit(500.0)) + 1)).alias("price"), x["quantity"].alias("quantity")))
    # numbered once, for all that read snapshot or deltas
    numbered.select(*SERIES, "id", shift("bids", -1).alias("bids"), shift("asks", 1).alias("asks")).write.parquet(f"{path}/numbered")
    numbered = spark.read.parquet(f"{path}/numbered")
    snapshot = numbered.where("id = 1").select(*SERIES, F.lit(1).cast("bigint").alias("last_update_id"), "bids", "asks")
    deltas = numbered.where("id > 1").select(*SERIES, F.col("id").cast("bigint").alias("first_update_id"), F.col("id").cast("bigint").alias("final_update_id"), (F.col("id") - 1).cast("bigint").alias("previous_final_update_id"), "bids", "asks")
    return snapshot, deltas


@query("str12_rebuild_book", f"""WITH {LEVELS}, o AS (SELECT symbol, last_update_id, row_number() OVER (PARTITION BY symbol ORDER BY last_update_id) AS id, min(mid - n * 7) FILTER (n = n0) AS head FROM (SELECT *, min(n) OVER (PARTITION BY last_update_id) AS n0 FROM lv) GROUP BY symbol, last_update_id),
    p AS (SELECT symbol, head AS price0 FROM o WHERE id = 1), x AS (SELECT lv.symbol, id, n, q, price0 - ((mid - 7 * n) % 500 + 1) AS bid, price0 + ((mid + 7 * n) % 500 + 1) AS ask FROM lv JOIN o USING (symbol, last_update_id) JOIN p USING (symbol)),
    b AS (SELECT symbol, bid, arg_max(q, (id, n, q)) AS q FROM x GROUP BY ALL), a AS (SELECT symbol, ask, arg_max(q, (id, n, q)) AS q FROM x GROUP BY ALL)
    SELECT symbol, (SELECT max(id) FROM o WHERE o.symbol = p.symbol) AS last_update_id, (SELECT CAST(count(*) AS INTEGER) FROM b WHERE b.symbol = p.symbol AND q > 0) AS bid_levels, (SELECT CAST(count(*) AS INTEGER) FROM a WHERE a.symbol = p.symbol AND q > 0) AS ask_levels, (SELECT round(sum(bid * q), 4) FROM b WHERE b.symbol = p.symbol) AS bid_notional, FALSE AS needs_resync FROM p""")  # fmt: skip
def str12_rebuild_book(spark, sf):
    snapshot, deltas = numbered_deltas(spark, sf)
    out = book.rebuild_book(snapshot, deltas)
    notional = F.aggregate("bids", F.lit(0.0), lambda s, x: s + x["price"] * x["quantity"])
    return out.select("symbol", "last_update_id", F.size("bids").alias("bid_levels"), F.size("asks").alias("ask_levels"), F.round(notional, 4).alias("bid_notional"), "needs_resync")


@query("cal8_fetch_tasks", f"""WITH RECURSIVE {HOURLY}, s AS (SELECT symbol, lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time) + {HOUR} AS s, open_time - {HOUR} AS e FROM bars), g AS (SELECT * FROM s WHERE s <= e), p0 AS (SELECT symbol, unnest(range(s, e + 1, {24 * HOUR})) AS s, e FROM g),
    p AS (SELECT symbol, s, least(s + {23 * HOUR}, e) AS e, row_number() OVER (PARTITION BY symbol ORDER BY s) AS i FROM p0), r AS (SELECT symbol, i, s, e, 1 AS n FROM p WHERE i = 1 UNION ALL
    SELECT p.symbol, p.i, CASE WHEN greatest(r.e, p.e) - r.s + {HOUR} <= {24 * HOUR} THEN r.s ELSE p.s END, CASE WHEN greatest(r.e, p.e) - r.s + {HOUR} <= {24 * HOUR} THEN greatest(r.e, p.e) ELSE p.e END, CASE WHEN greatest(r.e, p.e) - r.s + {HOUR} <= {24 * HOUR} THEN n ELSE n + 1 END FROM r JOIN p ON p.symbol = r.symbol AND p.i = r.i + 1)
    SELECT symbol, arg_max(s, i) AS start, arg_max(e, i) AS "end" FROM r GROUP BY symbol, n""")  # fmt: skip
def cal8_fetch_tasks(spark, sf):
    rows = bar_table(spark, sf)
    want = rows.groupBy(*SERIES).agg(F.min("open_time").alias("start"), F.max("open_time").alias("end"))
    return calendars.fetch_tasks(calendars.detect_gaps(rows, want, "1h", 4_000_000_000_000), "1h", 24).select("symbol", "start", "end")


@query("ded4_accept_snapshots", f"""WITH {HOURLY}, n AS (SELECT bars.*, s FROM bars, (VALUES (1), (2), (3), (4), (5)) t(s)) SELECT symbol, open_time, CAST(s AS BIGINT) AS sequence, high + CASE WHEN s = 4 THEN 1 ELSE 0 END AS high, low, volume, FALSE AS is_closed, s = 5 AS authoritative FROM n WHERE s <> 2""")
def ded4_accept_snapshots(spark, sf):
    """Of five snapshots of a bar the second loses volume and is refused; the fourth raises the high, and the fifth takes
    that back with authority."""
    s = F.col("sequence")
    rows = bar_table(spark, sf).select(*SERIES, "open_time", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(5).cast("bigint"))).alias("sequence"), "high", "low", "volume", F.lit(False).alias("is_closed"))
    rows = rows.withColumns({"volume": F.when(s == 2, F.col("volume") / 2).otherwise(F.col("volume")), "high": F.when(s == 4, F.col("high") + 1).otherwise(F.col("high")), "authoritative": s == 5})
    return integrity.accept_snapshots(rows).drop("exchange", "market_type")


@query("win12_hybrid_funding", f"""WITH {HOURLY}, s0 AS (SELECT symbol, open_time AS tm, close / 1e6 AS rate, (open_time - lag(open_time) OVER (PARTITION BY symbol ORDER BY open_time)) / CAST({HOUR} AS DOUBLE) AS len FROM bars WHERE (open_time // {HOUR}) % 8 = 0),
    b AS (SELECT symbol, tm, 0 AS kind, rate, CASE WHEN len <= 1.5 THEN 1 WHEN len <= 3 THEN 2 WHEN len <= 6 THEN 4 WHEN len IS NOT NULL THEN 8 END AS ch, CAST(NULL AS DOUBLE) AS p FROM s0 UNION ALL SELECT symbol, open_time + {HOUR}, 1, NULL, NULL, (close - open) / 1e5 FROM bars UNION ALL SELECT symbol, open_time, 2, NULL, NULL, NULL FROM bars),
    c AS (SELECT *, count(*) FILTER (kind = 0) OVER w AS cycle, last_value(ch IGNORE NULLS) OVER w AS hours FROM b WINDOW w AS (PARTITION BY symbol ORDER BY tm, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    d AS (SELECT *, avg(p) OVER w AS mean, max(tm) FILTER (kind = 0) OVER w AS sat, max(rate) FILTER (kind = 0) OVER w AS srate FROM c WINDOW w AS (PARTITION BY symbol, cycle ORDER BY tm, kind ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
    e AS (SELECT *, CASE WHEN sat = tm THEN srate ELSE mean + greatest(-0.0005, least(0.0005, 0.0001 * coalesce(hours, 8) / 8 - mean)) END AS r FROM d WHERE kind = 2),
    f AS (SELECT *, bool_or(r IS NULL) OVER (PARTITION BY symbol ORDER BY tm ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS excluded FROM e)
    SELECT symbol, tm AS open_time, CASE WHEN NOT excluded THEN round(r, 12) END AS funding_rate, CASE WHEN NOT excluded THEN CASE WHEN sat = tm THEN 'exchange_settlement' ELSE 'derived_history' END END AS provenance, excluded FROM f""")  # fmt: skip
def win12_hybrid_funding(spark, sf):
    rows = bar_table(spark, sf)
    settled = rows.where((F.col("open_time") / HOUR).cast("bigint") % 8 == 0).select(*SERIES, F.col("open_time").alias("funding_time_ms"), (F.col("close") / 1e6).alias("funding_rate"))
    premium = rows.select(*SERIES, F.col("close_time").alias("close_time_ms"), ((F.col("close") - F.col("open")) / 1e5).alias("premium_close"))
    return funding.hybrid_funding(settled, premium, rows).drop("exchange", "market_type").withColumn("funding_rate", F.round("funding_rate", 12))


@query("sca33_alert_trace", f"""WITH {HOURLY}, m AS (SELECT *, CASE WHEN count(*) OVER w = 5 THEN avg(close) OVER w END AS ma FROM bars WINDOW w AS (PARTITION BY symbol ORDER BY open_time ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)), l AS (SELECT *, lag(close) OVER o AS c0, lag(ma) OVER o AS m0, lag(volume) OVER o AS v0 FROM m WINDOW o AS (PARTITION BY symbol ORDER BY open_time)),
    k AS (SELECT *, coalesce(c0 <= m0 AND close > ma, FALSE) AS a, coalesce(volume NOT BETWEEN 5 AND 100, FALSE) AS o FROM l)
    SELECT symbol, open_time, '0' AS path, 'AND' AS node, a AND NOT o AS outcome, CAST(NULL AS DOUBLE) AS "left", CAST(NULL AS DOUBLE) AS "right", CAST(NULL AS DOUBLE) AS left_before FROM k UNION ALL SELECT symbol, open_time, '0.0', 'crossesAbove', a, close, round(ma, 8), c0 FROM k
    UNION ALL SELECT symbol, open_time, '0.1', 'NOT', NOT o, NULL, NULL, NULL FROM k UNION ALL SELECT symbol, open_time, '0.1.0', 'outside', o, volume, NULL, v0 FROM k""")  # fmt: skip
def sca33_alert_trace(spark, sf):
    rows = indicators.ma(bar_table(spark, sf), 5)
    w = Window.partitionBy(*SERIES).orderBy("open_time")
    rows = rows.withColumns({alerts.previous(c): F.lag(c).over(w) for c in alerts.fields(RULE)})
    out = rows.select("symbol", "open_time", F.explode(F.array(*alerts.alert_trace(RULE, set(rows.columns)))).alias("x")).select("symbol", "open_time", "x.*")
    return out.withColumn("right", F.round("right", 8))
