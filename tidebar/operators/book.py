"""Order books: grouping by price, windows, depth, and rebuilding from deltas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import SERIES

MOST_TICKS = 1000


def levels(books: DataFrame) -> DataFrame:
    """One row per level: side, rank from the best, price, quantity. Both sides in one pass, so that rows stay where they are."""
    keys = [c for c in books.columns if c not in ("bids", "asks")]
    # a generator is compiled, a function over an array is not
    sides = F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("levels")) for s in ("bids", "asks")])
    rows = books.select(*keys, F.explode(sides).alias("s")).select(*keys, F.col("s.side").alias("side"), F.posexplode("s.levels").alias("rank", "x"))
    return rows.select(*keys, "side", "rank", *[F.col("x")[c].cast("double").alias(c) for c in ("price", "quantity")])


def auto_step(mid: Column, tick: Column) -> Column:
    """The least tick times a power of ten that is at least a hundred-thousandth of mid; at most 1000 ticks."""
    want = mid * 1e-5 / tick
    return F.least(F.lit(float(MOST_TICKS)), F.pow(F.lit(10.0), F.greatest(F.lit(0.0), F.ceil(F.log10(want) - 1e-9).cast("double"))))


def group_book(books: DataFrame, catalog: DataFrame, grouping: str | int = "auto") -> DataFrame:
    """Levels summed by price step: bids fall to the step below, asks rise to the one above. catalog: SERIES, tick, a row for
    each instrument. grouping: auto, raw, or a number of ticks. Exact in decimals."""
    # sent to the books: a join by SERIES would bring all books of a series to one task
    rows = books.join(F.broadcast(catalog.select(*SERIES, "tick")), SERIES)
    best = lambda s: F.get(s, F.lit(0))["price"]
    mid = (best("bids") + best("asks")) / 2
    ticks = F.lit(1.0) if grouping == "raw" else auto_step(mid, F.col("tick")) if grouping == "auto" else F.lit(float(grouping))
    rows = levels(rows.withColumn("step", (F.col("tick") * ticks).cast("decimal(18,8)")))
    n = F.col("price").cast("decimal(18,8)") / F.col("step")
    price = (F.when(F.col("side") == "bids", F.floor(n)).otherwise(F.ceil(n)) * F.col("step")).cast("decimal(28,8)")
    return rows.groupBy(*SERIES, "last_update_id", "side", "step", price.alias("level_price")).agg(F.sum(F.col("quantity").cast("decimal(28,8)")).alias("quantity"), F.count("*").alias("levels"))


def book_window(grouped: DataFrame, limit: int) -> DataFrame:
    """The grouped levels within `limit` steps of the best of their side, without the outermost, which may be cut."""
    w = Window.partitionBy(*SERIES, "last_update_id", "side")
    sign = F.when(F.col("side") == "bids", -1).otherwise(1)
    rows = grouped.withColumns({"best": F.when(F.col("side") == "bids", F.max("level_price").over(w)).otherwise(F.min("level_price").over(w)), "outer": F.when(F.col("side") == "bids", F.min("level_price").over(w)).otherwise(F.max("level_price").over(w))})
    distance = (F.col("level_price") - F.col("best")) * sign / F.col("step")
    only = F.col("best") == F.col("outer")
    return rows.where((distance < limit) & (only | (F.col("level_price") != F.col("outer")))).drop("best", "outer")


def book_depth(books: DataFrame) -> DataFrame:
    """Running quantity from the best price outwards, and each side's total."""
    w = Window.partitionBy(*SERIES, "last_update_id", "side")
    return levels(books).withColumns({"depth": F.round(F.sum("quantity").over(w.orderBy("rank")), 8), "side_total": F.round(F.sum("quantity").over(w), 8)})


def in_stretches(rows: DataFrame, at: str, most: int = 50_000) -> DataFrame:
    """Adds stretch: a series' rows cut by `at` into stretches of equal width, with about so many rows where `at` is even. So
    what needs a series in order is done within stretches and then across them, by many tasks."""
    ends = F.broadcast(rows.groupBy(*SERIES).agg(F.min(at).alias("_lo"), F.max(at).alias("_hi"), F.count("*").alias("_n")))
    width = F.greatest(F.lit(1.0), F.ceil((F.col("_hi") - F.col("_lo") + 1).cast("double") * most / F.col("_n")))
    return rows.join(ends, SERIES).withColumn("stretch", F.floor((F.col(at) - F.col("_lo")) / width)).drop("_lo", "_hi", "_n")


def valid_deltas(snapshot: DataFrame, deltas: DataFrame, futures: bool, most: int = 50_000) -> DataFrame:
    """The deltas that carry a snapshot on: those already in it go; the first must reach its id, and each must follow the
    last (futures: its previous id is the last one's final id; spot: its first id is at most one beyond). From the first
    break on a series has none, and broken says so. Neighbours are found within stretches of ids (most: see in_stretches); a
    stretch's first delta gets its neighbour, and the breaks before it, from one narrow row a stretch."""
    s = F.broadcast(snapshot.select(*SERIES, F.col("last_update_id").alias("base")))
    rows = in_stretches(deltas.join(s, SERIES).where(F.col("final_update_id") > F.col("base")), "final_update_id", most)
    across = Window.partitionBy(*SERIES).orderBy("stretch")
    tails = rows.groupBy(*SERIES, "stretch").agg(F.max("final_update_id").alias("tail"))
    tails = F.broadcast(tails.select(*SERIES, "stretch", F.lag("tail").over(across).alias("carried")))
    w = Window.partitionBy(*SERIES, "stretch").orderBy("final_update_id")
    before = F.coalesce(F.lag("final_update_id").over(w), "carried")
    first_ok = F.col("first_update_id") <= F.col("base") + 1
    if futures:
        first_ok = first_ok | F.coalesce(F.col("previous_final_update_id") == F.col("base"), F.lit(False))
    follows = (F.col("previous_final_update_id") == before) if futures else (F.col("first_update_id") <= before + 1)
    rows = rows.join(tails, [*SERIES, "stretch"]).withColumn("bad", F.when(before.isNull(), ~first_ok).otherwise(~F.coalesce(follows, F.lit(False))))
    first_bad = F.broadcast(rows.where("bad").groupBy(*SERIES).agg(F.min("stretch").alias("first_bad")))
    so_far = F.max(F.col("bad").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)) == 1
    rows = rows.withColumn("so_far", so_far).join(first_bad, SERIES, "left")
    return rows.withColumn("broken", F.col("so_far") | F.coalesce(F.col("stretch") > F.col("first_bad"), F.lit(False))).drop("bad", "so_far", "first_bad", "carried", "stretch")


def rebuild_book(snapshot: DataFrame, deltas: DataFrame, futures: bool = True, depth: int = 1000) -> DataFrame:
    """The book after all deltas: the last quantity of each price counts, zero deletes it. A broken or crossed book is
    empty and needs a new snapshot (needs_resync). Only ids are put in order; levels stay where they are read until each
    task has its last of each price."""
    ids = valid_deltas(snapshot, deltas.drop("bids", "asks"), futures)
    state = ids.groupBy(*SERIES).agg(F.max("broken").alias("broken"), F.max("final_update_id").alias("last_id"))
    whole = F.broadcast(state.where(~F.col("broken")).join(snapshot.select(*SERIES, F.col("last_update_id").alias("base")), SERIES).select(*SERIES, "base"))
    change = lambda d, at: levels(d.withColumn("last_update_id", at).select(*SERIES, "last_update_id", "bids", "asks"))
    all_ = change(snapshot, F.col("last_update_id")).unionByName(change(deltas.join(whole, SERIES).where(F.col("final_update_id") > F.col("base")), F.col("final_update_id")))
    # of two quantities for a price in one update, the one further on holds; a number, unlike a struct, is compared in a hash table
    place = F.col("last_update_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(10,0)") + F.col("rank").cast("decimal(10,0)")
    last = all_.groupBy(*SERIES, "side", "price").agg(F.max_by("quantity", place).alias("quantity")).where("quantity > 0")
    sign = F.when(F.col("side") == "bids", -1).otherwise(1)
    nth = F.row_number().over(Window.partitionBy(*SERIES, "side").orderBy(sign * F.col("price")))
    last = last.withColumn("rank", nth).where(F.col("rank") <= depth)
    side = lambda s: F.transform(F.sort_array(F.collect_list(F.when(F.col("side") == s, F.struct("rank", "price", "quantity")))), lambda x: F.struct(x["price"].alias("price"), x["quantity"].alias("quantity")))
    books = last.groupBy(*SERIES).agg(side("bids").alias("bids"), side("asks").alias("asks"))
    out = snapshot.select(*SERIES, "last_update_id").join(state, SERIES, "left").join(books, SERIES, "left")
    crossed = F.get("bids", F.lit(0))["price"] >= F.get("asks", F.lit(0))["price"]
    bad = F.coalesce(F.col("broken"), F.lit(False)) | F.coalesce(crossed, F.lit(False))
    empty = lambda c: F.when(bad, F.slice(c, 1, 0)).otherwise(F.col(c))
    return out.select(*SERIES, F.coalesce("last_id", "last_update_id").alias("last_update_id"), empty("bids").alias("bids"), empty("asks").alias("asks"), bad.alias("needs_resync"))
