"""Centroid clustering (k-means on integer vectors) in JVM expressions.

Components become integers, floor(scale * x), so that every distance, sum and quotient is exact and no result depends on the
order of rows or partitions. A vector's squared distance to a centroid is an aggregate over zip_with; the centroids are
literal arrays in the plan, and array_min of structs of (distance, number) chooses the nearest, the smaller number on
ties. A round is one pass: partial column sums per cluster in generated code, of which at most k rows reach the
driver; the quotients are taken there in exact integers and become the next round's literals.

Defined cases: vectors that are null, have another number of components, or hold null or non-finite ones are left out, as
are those with a component of 2^27 or more once scaled, whose squares would not fit a long; rows with a null id are
assigned but start no centroid; ties between equal hashes (repeated ids) go by the vectors; repeated rows count each; with
fewer than k vectors there are fewer centroids; an empty table gives no rows; a cluster's sum that does not fit a long
is null; other columns are ignored."""

from __future__ import annotations

import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

LARGEST = 1 << 27


def integer_vectors(table: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id and v, the scaled integers, of every vector that is kept."""
    v = F.col(vector_col).cast("array<double>")
    good = (F.size(v) == dims) & F.forall(v, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) * scale < LARGEST), F.lit(False)))
    return table.where(F.coalesce(good, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), F.transform(v, lambda x: F.floor(x * scale)).alias("v"))


def nearest(v: Column, centroids: list[list[int]]) -> Column:
    """(distance, cluster) of the nearest centroid."""
    given = F.from_json(F.lit(json.dumps(centroids)), "array<array<bigint>>")
    distance = lambda c: F.aggregate(F.zip_with(v, c, lambda x, y: (x - y) * (x - y)), F.lit(0).cast("long"), lambda s, x: s + x)
    return F.array_min(F.transform(given, lambda c, i: F.struct(distance(c).alias("distance"), i.alias("cluster"))))


def first_centroids(vectors: DataFrame, k: int = 40, seed: int = 2) -> list[list[int]]:
    """The vectors whose ids hash lowest with the seed, in order of their hashes."""
    h = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    return [list(r[0]) for r in vectors.where("vec_id is not null").orderBy(h, "v").limit(k).select("v").collect()]


def next_centroids(vectors: DataFrame, centroids: list[list[int]]) -> list[list[int]]:
    """One round: assign every vector, then replace each centroid that has vectors by the floor of their mean."""
    chosen = vectors.select(nearest(F.col("v"), centroids)["cluster"].alias("cluster"), "v")
    sums = [F.sum(F.get("v", F.lit(i))).alias(f"s{i}") for i in range(len(centroids[0]))]
    new = list(centroids)
    for r in chosen.groupBy("cluster").agg(F.count("*"), *sums).collect():
        new[r[0]] = [s // r[1] for s in r[2:]]
    return new


def clusters(table: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, seed: int = 2) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 of every vector that is kept."""
    vectors = common.keep(integer_vectors(table, dims, scale), "vectors")
    centroids = first_centroids(vectors, k, seed)
    if not centroids:
        return vectors.where("false").selectExpr("vec_id", "0 cluster", "0L distance", "0L cluster_inertia", "0L inertia", "'' centroid_sha256")
    for _ in range(rounds):
        centroids = next_centroids(vectors, centroids)
    best = common.keep(vectors.select("vec_id", nearest(F.col("v"), centroids).alias("x")).select("vec_id", "x.cluster", "x.distance"), "assigned")
    common.release(vectors)
    # at most k rows, one per cluster
    sums = {r[0]: int(r[1]) for r in best.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)"))).collect()}
    fits = lambda n: F.lit(n if n < 1 << 63 else None).cast("long")
    each = F.array(*[fits(sums.get(i, 0)) for i in range(len(centroids))])
    digests = F.array(*[F.lit(hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for c in centroids])
    of = lambda values: F.get(values, F.col("cluster"))
    return best.select("vec_id", "cluster", "distance", of(each).alias("cluster_inertia"), fits(sum(sums.values())).alias("inertia"), of(digests).alias("centroid_sha256"))
