"""Near-duplicate embeddings by spherical-cap filters.

A filter is a direction; a vector passes the filters whose direction it exceeds a threshold with. The directions are
a structured product code: the dimensions are cut into blocks, each block has its own random unit codewords, and a
direction is one codeword per block. A vector's score with a direction is the sum of its blocks' scores, so all
directions beyond the threshold are found by decoding the list block by block, without trying each. Vectors that
share a label and a filter are candidates; each candidate pair is then verified exactly in double precision.

Vectors that are equal once divided by their largest component are one class first, so copies never become pairs. Then
classes near each other become balls: around a pivot, those within half the angle of the threshold, which all link with
each other by the triangle inequality. Balls are joined on filters in place of their members. Whether two balls link as
a whole, or not at all, follows from their pivots' angle and their radii; only what lies between is taken apart, first
into members and pivots, then into single pairs. So a group of near copies is counted, not written out as its pairs.

Defined cases: vectors that are null, empty, zero, or hold null or non-finite components, and rows whose label is
null, link with nothing; vectors of different lengths never link; repeated rows are linked copies; an empty table
gives no rows; other columns are ignored."""

from __future__ import annotations

import math
from collections.abc import Iterator
from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common


def codewords(dim: int, blocks: int, words: int, seed: int) -> list[np.ndarray]:
    """Per block its codewords (words x size), of length sqrt(size / dim), so that whole directions have length 1."""
    rng = np.random.default_rng(seed)
    out = []
    for part in np.array_split(np.arange(dim), blocks):
        c = rng.standard_normal((words, len(part)))
        out.append(c / np.linalg.norm(c, axis=1, keepdims=True) * np.sqrt(len(part) / dim))
    return out


def _largest(x: np.ndarray, k: int) -> np.ndarray:
    """The k largest of each row, the largest first."""
    k = min(k, x.shape[1])
    return -np.sort(-np.partition(x, x.shape[1] - k, 1)[:, x.shape[1] - k :], 1)


def list_decode(x: np.ndarray, codes: list[np.ndarray], threshold: float, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, filter number, score) for every direction that a unit row of x exceeds threshold with. A row that passes fewer
    than `least` takes its `least` best directions, so that no vector is without filters."""
    words = len(codes[0])
    cuts = np.cumsum([0] + [c.shape[1] for c in codes])
    scores = [x[:, a:b] @ c.T for a, b, c in zip(cuts, cuts[1:], codes)]
    best = np.zeros(len(x))
    for s in scores[1:]:
        best += s.max(1)
    rows, number, total = np.arange(len(x)), np.zeros(len(x), np.int64), np.zeros(len(x))
    floor = np.full(len(x), threshold)
    top = _largest(scores[0], least)
    for s in scores[1:]:
        top = _largest((top[:, :, None] + _largest(s, least)[:, None, :]).reshape(len(x), -1), least)
    floor = np.minimum(floor, top[:, -1])
    for i, s in enumerate(scores):
        rest = best[rows] if i < len(scores) - 1 else 0
        value = total[:, None] + s[rows]
        keep, word = np.nonzero(value + np.asarray(rest).reshape(-1, 1) >= floor[rows][:, None] - 1e-12)
        number = number[keep] * words + word
        total, rows = value[keep, word], rows[keep]
        if i + 1 < len(scores):
            best = best - scores[i + 1].max(1)
    return rows, number, total


def lone_pairs(dim: int, cosine: float, n: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """n pairs of random unit vectors (n x dim each) at just this cosine."""
    rng = np.random.default_rng(seed)
    x, y = rng.standard_normal((2, n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y /= np.linalg.norm(y, axis=1, keepdims=True)
    return x, cosine * x + math.sqrt(max(0.0, 1 - cosine * cosine)) * y


def found_pairs(x: np.ndarray, y: np.ndarray, codes: list[np.ndarray], threshold: float, least: int) -> float:
    """The share of pairs (a row of x, the same row of y) that share a filter."""
    found, filters = 0, len(codes[0]) ** len(codes)
    for i in range(0, len(x), 64):
        (a, m, _), (b, n, _) = (list_decode(v[i : i + 64], codes, threshold, least) for v in (x, y))
        found += len(np.unique(np.intersect1d(a * filters + m, b * filters + n) // filters))
    return found / len(x)


def cap(dim: int, codes: list[np.ndarray], cosine: float, recall: float, passed_filters: float, least: int, pairs: int = 2000) -> float:
    """The highest threshold tried that passed_filters random directions or more exceed on average, and at which so many
    of the sampled pairs at this cosine share a filter."""
    filters, threshold = len(codes[0]) ** len(codes), 0.0
    x, y = lone_pairs(dim, cosine, pairs, 1) if dim > 1 and -1 < cosine < 1 else (None, None)
    while passed_filters < filters / 2:
        threshold = NormalDist().inv_cdf(1 - passed_filters / filters) / math.sqrt(dim)
        if x is None or found_pairs(x, y, codes, threshold, least) >= recall:
            return threshold
        passed_filters *= 1.25
    return 0.0


def near_vectors(table: DataFrame, cosine: float = 0.93, blocks: int = 2, words: int | None = None, passed_filters: int = 40, least: int = 12, seed: int = 17, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", recall: float = 0.995) -> DataFrame:
    """vec_id, n_links, component_id, kept of every vector.

    words: codewords per block; by default it grows with the root of the largest label, so that a filter holds few
    vectors at any size. The cap's threshold is the one that passed_filters random directions exceed on average, or a
    lower one: for each length of vectors it is lowered until the recall of single pairs at the given cosine, measured on
    random pairs with the codewords in use, is at least `recall`. Where no cap reaches that, as in few dimensions, it
    is a half-space, which two vectors of a link share with nearly half of all directions. README has figures."""
    spark = table.sparkSession
    rows = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).cast("long").alias("label"))
    good = F.col("label").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("v", lambda x: x != 0)
    size = F.array_max(F.transform("v", F.abs))
    rows = rows.withColumn("v", F.when(good, F.transform("v", lambda x: x / size + F.lit(0.0))))
    rows = common.keep(rows.withColumn("cls", F.when(good, F.xxhash64("label", "v"))), "vectors")
    usable = rows.where("cls is not null")
    dot = lambda p, q: F.aggregate(F.zip_with(p, q, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
    classes = usable.groupBy("cls").agg(F.min("label").alias("label"), F.first("v").alias("v"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    classes = common.keep(classes.withColumn("norm", F.sqrt(dot(F.col("v"), F.col("v")))), "classes")

    if words is None:
        largest = classes.groupBy("label").count().agg(F.coalesce(F.max("count"), F.lit(1))).first()[0]
        words = max(32, 1 << math.ceil(math.log2(3 * math.sqrt(largest))))
    dims = [r[0] for r in classes.select(F.size("v")).distinct().collect()]
    caps = {d: cap(d, codewords(d, min(blocks, d), words, seed), cosine, recall, passed_filters, least) for d in dims}

    def passed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, list[np.ndarray]] = {}
        for batch in batches:
            vectors = batch.column(2).to_pylist()
            for dim in sorted({len(v) for v in vectors}):
                mine = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.array([vectors[i] for i in mine], float)
                x /= np.abs(x).max(1, keepdims=True)
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                parts = min(blocks, dim)
                if dim not in made:
                    made[dim] = codewords(dim, parts, words, seed)
                step = max(1, (1 << 18) // words)
                for i in range(0, len(x), step):
                    at, number, score = list_decode(x[i : i + step], made[dim], caps[dim], least)
                    first = np.zeros(len(at), bool)
                    order = np.lexsort((number, -score, at))
                    first[order[np.diff(at[order], prepend=-1) > 0]] = True
                    take = pa.array(np.array(mine)[i + at], pa.int64())
                    yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array(number * 8192 + dim, pa.int64()), pa.array(first)], ["cls", "label", "filter", "first"])

    passes = common.keep(classes.select("cls", "label", "v").mapInArrow(passed, "cls long, label long, filter long, first boolean"), "filters")
    points = classes.select("cls", "v", "norm")
    angle = lambda rows, a, b: _angle(rows, points, a, b, dot)

    # balls: of the classes whose best filter is the same, those within half the angle of one of them
    theta, margin = math.acos(cosine), 1e-7
    bests = passes.where("first").select("cls", "label", "filter")
    pivots = common.keep(bests.groupBy("label", "filter").agg(F.min_by("cls", F.xxhash64("cls")).alias("ball"), F.count("*").alias("c")).where("c > 1").drop("c"), "pivots")
    near = angle(bests.join(pivots, ["label", "filter"]).where("cls <> ball").select("cls", "ball"), "cls", "ball").where(F.col("angle") <= theta / 2 - margin)
    near = common.keep(near.select("cls", "ball", "angle"), "near")
    member = classes.select("cls", "copies", "least").join(near, "cls", "left")
    member = common.keep(member.select("cls", "copies", "least", F.coalesce("ball", "cls").alias("ball"), F.coalesce("angle", F.lit(0.0)).alias("angle")), "members")
    balls = common.keep(member.groupBy("ball").agg(F.sum("copies").alias("weight"), F.max("angle").alias("radius"), F.count("*").alias("size"), F.min("least").alias("least")), "balls")

    held = common.keep(passes.join(member.select("cls", "ball"), "cls").select("label", "filter", "ball").distinct(), "held")
    pairs = held.withColumnRenamed("ball", "a").join(held.withColumnRenamed("ball", "b"), ["label", "filter"]).where("a < b").select("a", "b").distinct()
    side = lambda s: balls.select(F.col("ball").alias(s), F.col("radius").alias(f"radius_{s}"), F.col("size").alias(f"size_{s}"), F.col("weight").alias(f"weight_{s}"))
    met = angle(pairs, "a", "b").join(side("a"), "a").join(side("b"), "b")
    reach = F.col("radius_a") + F.col("radius_b")
    single = (F.col("size_a") == 1) & (F.col("size_b") == 1)
    kind = F.when(single, F.when(F.col("cosine") >= cosine, "all")).when(F.col("angle") + reach <= theta - margin, "all").when(F.col("angle") - reach <= theta + margin, "some")
    met = common.keep(met.withColumn("kind", kind).where("kind is not null").select("a", "b", "kind", "radius_a", "radius_b", "weight_a", "weight_b", "size_a", "size_b"), "met")

    # both as a whole; then the members of the larger ball against the other one's pivot; then what is left in single pairs
    whole = met.where("kind = 'all'")
    swap = F.col("size_a") >= F.col("size_b")
    some = met.where("kind = 'some'").select(F.when(swap, F.col("a")).otherwise(F.col("b")).alias("ball"), F.when(swap, F.col("b")).otherwise(F.col("a")).alias("other"), F.when(swap, F.col("radius_b")).otherwise(F.col("radius_a")).alias("radius"), F.when(swap, F.col("weight_b")).otherwise(F.col("weight_a")).alias("weight"))
    each = angle(some.join(member.select("ball", "cls", "copies"), "ball"), "cls", "other")
    alone = F.col("radius") == 0.0
    fate = F.when(alone, F.when(F.col("cosine") >= cosine, "all")).when(F.col("angle") + F.col("radius") <= theta - margin, "all").when(F.col("angle") - F.col("radius") <= theta + margin, "some")
    each = common.keep(each.withColumn("fate", fate).where("fate is not null").select("ball", "other", "cls", "copies", "weight", "fate"), "each")
    one = each.where("fate = 'some'").select("ball", "other", "cls", "copies").join(member.select(F.col("ball").alias("other"), F.col("cls").alias("to"), F.col("copies").alias("to_copies")), "other")
    one = common.keep(angle(one, "cls", "to").where(F.col("cosine") >= cosine).select("ball", "other", "cls", "copies", "to", "to_copies"), "one")

    sides = each.where("fate = 'all'")
    by_ball = whole.select(F.col("a").alias("ball"), F.col("weight_b").alias("n")).union(whole.select("b", "weight_a")).union(sides.select("other", "copies")).groupBy("ball").agg(F.sum("n").alias("by_ball"))
    by_class = sides.select("cls", F.col("weight").alias("n")).union(one.select("cls", "to_copies")).union(one.select("to", "copies")).groupBy("cls").agg(F.sum("n").alias("by_class"))
    links = whole.select("a", "b").union(sides.select("ball", "other")).union(one.select("ball", "other")).distinct()
    roots = common.connected_components(links).withColumnRenamed("node", "ball")
    named = common.keep(balls.join(roots, "ball", "left").join(by_ball, "ball", "left").select("ball", "least", F.coalesce("root", "ball").alias("root"), (F.col("weight") - 1 + F.coalesce("by_ball", F.lit(0))).alias("n")), "named")
    component = named.groupBy("root").agg(F.min("least").alias("component_id"))
    known = member.select("cls", "ball").join(named.join(component, "root").select("ball", "n", "component_id"), "ball").join(by_class, "cls", "left")
    known = known.select("cls", "component_id", (F.col("n") + F.coalesce("by_class", F.lit(0))).alias("n_links"))
    out = rows.select("vec_id", "cls").join(known, "cls", "left")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id")).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def _angle(rows: DataFrame, points: DataFrame, a: str, b: str, dot) -> DataFrame:
    """rows with the cosine, and the angle, of the vectors of the classes in columns a and b."""
    side = lambda c, s: points.select(F.col("cls").alias(c), F.col("v").alias(f"v_{s}"), F.col("norm").alias(f"norm_{s}"))
    both = rows.join(side(a, "a"), a).join(side(b, "b"), b)
    both = both.withColumn("cosine", dot(F.col("v_a"), F.col("v_b")) / (F.col("norm_a") * F.col("norm_b"))).drop("v_a", "v_b", "norm_a", "norm_b")
    return both.withColumn("angle", F.acos(F.least(F.lit(1.0), F.greatest(F.lit(-1.0), "cosine"))))
