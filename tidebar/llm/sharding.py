"""Sharding by a hierarchical weighted hash tree. DataFrame functions only.

A row descends from the root: to a region, a rack in it, a shard in that. At each level every child draws -ln(u) / weight, u
from the md5 of the row's key and the child's name, and the least draw wins, so a child gets rows in proportion to its
weight. A draw depends on the key and that child alone: where a weight changes, rows move only into (or out of) the
subtrees whose weights change, and never between two others. A region or rack weighs what its shards weigh.

`grown` trees add each further shard as a region of its own, so that nothing but the new leaf gains weight and one
more shard takes rows only into itself; fold such shards into racks when a rebalancing is wanted. The tree is one
literal in the plan, bounded by the number of shards.

Slots number the rows of a shard without gaps, by id. Rows are cut to ranges of (shard, id) that a copy-heavy id cannot
overfill; a range's start is a sum over one narrow row per shard and range, so no shard is sorted in one task.

Defined cases: null text has no bytes (size 1, checksum 0); a null id is a key of its own and comes first in its shard;
rows repeated with an id go to the same shard, to slots of their own; an empty table gives no rows; a shard that gets no
row has no slots; other columns are ignored."""

from __future__ import annotations

import json
from collections import defaultdict
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common


class Leaf(NamedTuple):
    region: str
    rack: str
    shard: int
    weight: float = 1.0


def grown(shards: int, base: int = 16, racks: int = 2, per_rack: int = 4) -> list[Leaf]:
    """Shards 0 to shards - 1 of equal weight: the first `base` in racks of per_rack and regions of so many racks, each further one
    a region of its own."""
    inner = [Leaf(f"region{i // (per_rack * racks)}", f"rack{i // per_rack}", i) for i in range(min(shards, base))]
    return inner + [Leaf(f"added{i}", f"added{i}", i) for i in range(base, shards)]


def _literal(leaves: list[Leaf]) -> Column:
    """The tree as one constant: regions with racks with shards, heavy with the sum of what they hold."""
    if len({x.shard for x in leaves}) < len(leaves) or any(not 0 < x.weight < float("inf") for x in leaves):
        raise ValueError("shards must differ and have positive, finite weights")
    held: dict[str, dict[str, list[Leaf]]] = defaultdict(lambda: defaultdict(list))
    for x in leaves:
        held[x.region][x.rack].append(x)
    weigh = lambda xs: sum(x.weight for x in xs)
    tree = [
        {"name": r, "weight": weigh(x for k in racks.values() for x in k), "below": [{"name": f"{r}/{k}", "weight": weigh(xs), "below": [{"name": f"{r}/{k}/{x.shard}", "weight": x.weight, "below": x.shard} for x in xs]} for k, xs in racks.items()]}
        for r, racks in held.items()
    ]
    node = "array<struct<name: string, weight: double, below: {}>>"
    return F.from_json(F.lit(json.dumps(tree)), node.format(node.format(node.format("int"))))


def _draw(key: Column, name: Column, weight: Column) -> Column:
    bits = F.conv(F.substring(F.md5(F.concat(key, F.lit(":"), name).cast("binary")), 1, 13), 16, 10).cast("double")
    return -F.log((bits + 0.5) / float(1 << 52)) / weight


def shard_of(key: Column, leaves: list[Leaf]) -> Column:
    """The shard of a string key: the least draw at each of the three levels."""
    below = _literal(leaves)
    for _ in range(3):
        below = F.array_min(F.transform(below, lambda c, i: F.struct(_draw(key, c["name"], c["weight"]).alias("draw"), i.alias("i"), c["below"].alias("below"))))["below"]
    return below


def with_slots(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """rows with `slot`: their gapless place from 0 within their group, ordered by the given columns."""
    spark = rows.sparkSession
    cut = rows.withColumn("tie", F.monotonically_increasing_id()).repartitionByRange(common.shuffle_partitions(spark), group, *order, "tie")
    placed = common.keep(cut.sortWithinPartitions(group, *order, "tie").withColumn("at", F.monotonically_increasing_id()).withColumn("stretch", F.shiftright("at", 33)), "placed")
    stretches = placed.groupBy(group, "stretch").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy(group).orderBy("stretch")) - F.col("n")
    starts = stretches.select(group, "stretch", (before - F.col("first")).alias("shift"))
    return placed.join(starts, [group, "stretch"]).withColumn("slot", F.col("at") + F.col("shift")).drop("tie", "at", "stretch", "shift")


def sharded(docs: DataFrame, leaves: list[Leaf] | None = None, more: list[Leaf] | None = None) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot of every document, and grown_shard: its shard in the tree `more`."""
    leaves, more = leaves or grown(16), more or grown(17)
    key = F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.lit("key").alias("law"), shard_of(key, leaves).alias("shard"), shard_of(key, more).alias("grown_shard"))
    return with_slots(common.keep(rows, "shards"), "shard", ["doc_id", "size", "text_crc32"]).select("doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard")
