"""The filter audit, the hash tree and integer clustering against plain computations, and their edge cases."""

import hashlib
import itertools
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("tidebar.llm.queries")

from tidebar.llm import centroids, filter_audit, sharding  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
R = random.Random(11)


def texts():
    words = ["".join(R.choice("abcdefgh") for _ in range(3)) for _ in range(400)]
    rows = []
    for i in range(60):
        w = R.choices(words if R.random() < 0.6 else words[:9], k=R.choice([5, 99, 100, 101, 160]))
        t = R.choice([" ", "\t", "\x0b \x0c", "\xa0"]).join(w)
        t = t.upper() if R.random() < 0.2 else t
        rows.append((i, t + R.choice(["", "", " # x", " $"]), R.choice(["en", "de", "", None]), "s", 0))
    rows += [(100 + i, rows[i % 7][1], "en", "s", 0) for i in range(20)]
    rows += [(3, rows[3][1], "en", "s", 0), (3, rows[3][1], "en", "s", 0), (None, rows[5][1], "en", None, None), (201, None, "fr", None, None), (202, "", "fr", None, None), (203, " \n", "fr", None, None), (204, "ÀÉ " * 4000, "fr", None, None), (205, "q " * 200_000, None, None, None)]
    return rows


ROWS = texts()
LABELS = [(i, R.choice([0, 1, None]), R.choice([0, 1])) for i in range(0, 210, 2)] + [(None, 1, 1)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, DOCS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def fails(row, first):
    t = row[1] or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    copy = row[0] is not None and row[0] > first[t]
    return {"A": len(w) < 100, "B": 100 * len(set(w)) < 80 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), "D": bool(re.search("[#$%&*|]", t)), "E": copy}


def test_audit(docs, labels):
    first = {}
    for r in ROWS:
        if r[0] is not None:
            first[r[1] or ""] = min(first.get(r[1] or "", r[0]), r[0])
    good, toxic = ({d for d, *v in LABELS if d is not None and v[k] == 1} for k in (0, 1))
    want, shapley = {}, Counter()
    found = [(r, r[2] or "", fails(r, first)) for r in ROWS]
    for part in {p for _, p, _ in found}:
        mine = [(r, f) for r, p, f in found if p == part]
        for order in itertools.permutations("ABCDE"):
            left = mine
            for step, x in enumerate(order, 1):
                gone = [r for r, f in left if f[x]]
                failing = sum(f[x] for _, f in mine)
                shapley[part, x] += len(gone)
                left = [(r, f) for r, f in left if not f[x]]
                want[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), sum(f[x] and sum(f.values()) == 1 for _, f in mine), sum(r[0] in good for r in gone), sum(r[0] in toxic for r in gone)]
    wide = docs.withColumns({c: F.lit(1) for c in ("part", "mask", "n", "h", "quality", "toxic", "first", "own")})
    for table in (docs, wide):
        got = {(r.part, r.filter_order, r.step): r for r in filter_audit.audit(table, labels).collect()}
        assert {k: list(r[3:9]) for k, r in got.items()} == want
        assert all(r.shapley == shapley[r.part, r.filter_order[r.step - 1]] for r in got.values())


def test_audit_of_nothing(spark, docs, labels):
    assert filter_audit.audit(spark.createDataFrame([], DOCS), labels).count() == 0
    report = filter_audit.audit(docs, labels.where("false")).agg(F.sum("good_lost"), F.sum("toxic_lost")).first()
    assert tuple(report) == (0, 0)


def test_gray_walk_is_every_subset():
    rng = np.random.default_rng(3)
    for k in (1, 3, 6):
        masks, weights = rng.permutation(1 << k)[: (1 << k) - 1], rng.integers(0, 50, ((1 << k) - 1, 2))
        states = filter_audit.walk(masks, weights, k)
        for s in range(1 << k):
            assert (states[s] == weights[(masks & s) == 0].sum(0)).all()


def draw(key, name, weight):
    return -math.log((int(hashlib.md5(f"{key}:{name}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight


def plain_shard(key, leaves):
    region = min(dict.fromkeys(x.region for x in leaves), key=lambda r: draw(key, r, sum(x.weight for x in leaves if x.region == r)))
    inside = [x for x in leaves if x.region == region]
    rack = min(dict.fromkeys(x.rack for x in inside), key=lambda k: draw(key, f"{region}/{k}", sum(x.weight for x in inside if x.rack == k)))
    return min((x for x in inside if x.rack == rack), key=lambda x: draw(key, f"{region}/{rack}/{x.shard}", x.weight)).shard


def test_sharded(spark, docs):
    wide = docs.withColumns({c: F.lit(1) for c in ("shard", "size", "tie", "at", "stretch", "slot", "n")})
    for table in (docs, wide):
        got = sharding.sharded(table).collect()
        key = lambda r: "none" if r.doc_id is None else r.doc_id
        assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == Counter((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
        assert all(r.shard == plain_shard(key(r), sharding.grown(16)) and r.grown_shard == plain_shard(key(r), sharding.grown(17)) for r in got)
        held = defaultdict(list)
        for r in got:
            held[r.shard].append(r)
        for rows in held.values():
            rows.sort(key=lambda r: r.slot)
            assert [r.slot for r in rows] == list(range(len(rows)))
            order = [(r.doc_id is not None, r.doc_id or 0, r.size, r.text_crc32) for r in rows]
            assert order == sorted(order)
        assert all(r.grown_shard in (r.shard, 16) for r in got)
    assert sharding.sharded(spark.createDataFrame([], DOCS)).count() == 0


def test_tree_confines_movement(spark):
    leaves = [sharding.Leaf(f"r{i // 8}", f"k{i // 4}", i, 1 + i % 3) for i in range(16)]
    heavier = [x._replace(weight=x.weight * 3) if x.shard == 5 else x for x in leaves]
    rows = spark.range(40_000).select(F.col("id").cast("string").alias("k")).select(sharding.shard_of(F.col("k"), leaves).alias("a"), sharding.shard_of(F.col("k"), heavier).alias("b"), *[sharding.shard_of(F.col("k"), sharding.grown(n)).alias(f"n{n}") for n in (16, 17, 18, 19)]).collect()
    share = Counter(r.a for r in rows)
    assert all(abs(share[x.shard] / 40_000 - x.weight / sum(y.weight for y in leaves)) < 0.01 for x in leaves)
    # what moves goes into the region, rack and shard that grew: never between two that did not
    moved = [(r.a, r.b) for r in rows if r.a != r.b]
    assert moved and all(b // 8 == 0 for a, b in moved)
    assert all(b // 4 == 1 for a, b in moved if a // 8 == 0) and all(b == 5 for a, b in moved if a // 4 == 1)
    for n in (16, 17, 18):
        assert {r[f"n{n + 1}"] for r in rows if r[f"n{n}"] != r[f"n{n + 1}"]} == {n}
    with pytest.raises(ValueError):
        sharding.shard_of(F.lit("x"), [sharding.Leaf("r", "k", 0), sharding.Leaf("r", "k", 0)])


def plain_clusters(rows, k, rounds, dims):
    kept = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) and abs(256 * x) < 2**27 for x in v)]
    h = lambda i: hashlib.sha256(f"2:{i}".encode()).hexdigest()
    c = [v for i, v in sorted(((i, v) for i, v in kept if i is not None), key=lambda x: (h(x[0]), x[1]))[:k]]
    near = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, y)), j) for j, y in enumerate(c))
    for _ in range(rounds):
        held = defaultdict(list)
        for _, v in kept:
            held[near(v)[1]].append(v)
        for j, vs in held.items():
            c[j] = [sum(x) // len(vs) for x in zip(*vs)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, j, d in out:
        each[j] += d
    return [(i, j, d, each[j], sum(each.values()), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for i, j, d in out]


@pytest.mark.parametrize(("k", "rounds"), [(7, 5), (40, 2), (400, 1)])
def test_clusters(spark, k, rounds):
    rng = np.random.default_rng(k)
    middle = rng.normal(size=(6, 5))
    rows = [(i, [float(np.float32(x)) for x in middle[i % 6] + rng.normal(size=5) / 9]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(30)] + [(7, rows[7][1]), (7, rows[8][1]), (None, rows[9][1]), (300, None), (301, []), (302, rows[0][1][:4]), (303, [0.0, None, 0.0, 0.0, 0.0]), (304, [float("nan")] * 5), (305, [float("inf")] + [0.0] * 4), (306, [1e30] * 5), (307, [0.0] * 5), (308, [-0.00001] * 5)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    want = sorted(plain_clusters(rows, k, rounds, 5), key=str)
    for t in (table, table.withColumns({c: F.lit(1) for c in ("v", "x", "cluster", "distance", "label")})):
        got = [tuple(r) for r in centroids.clusters(t, k, rounds, 5).collect()]
        assert sorted(got, key=str) == want
    none = centroids.clusters(table.where("false"))
    assert none.count() == 0 and none.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
