"""Document fingerprints: SimHash in DataFrame operations.

Every pair of neighbouring words is a term; its 64-bit hash votes on each bit with the term's weight, the times it
occurs. Votes are summed by plain aggregation, two bits' counters to a long, so a text's terms meet first where it
was read. A bit is set where the votes for it are more than half. near_fingerprints finds all fingerprints within a
Hamming radius by permuted block tables: the bits are cut into blocks, and one table for each choice of the blocks
that must agree joins equal keys; the distance is then checked.

Defined cases: null text is empty; a text without words has fingerprint 0; one word alone is its own term; null ids sort
first as one id; for repeated ids the next document's text is the least of that id's prefixes, and rows keep their
own texts; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

HALF = 0x0000000100000001
NO_ID = -(1 << 63)


def _terms(text: Column) -> Column:
    """Hashes of neighbouring words. The one-element array binds the words, so that they are split once."""
    split = F.array(F.filter(F.split(text, r"[ \t\n\x0B\f\r]+"), lambda w: w != ""))

    def hashes(words: Column) -> Column:
        n = F.size(words)
        pairs = F.zip_with(F.slice(words, F.lit(1), n - 1), F.slice(words, F.lit(2), n - 1), lambda a, b: F.xxhash64(a, b))
        return F.when(n > 1, pairs).otherwise(F.transform(words, lambda w: F.xxhash64(w)))

    return F.flatten(F.transform(split, hashes))


def simhash(rows: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """keys and fingerprint (long) of every row of rows; rows with equal keys must have equal texts."""
    hashed = rows.select(*keys, F.explode_outer(_terms(F.col(text))).alias("h"))
    counters = [F.sum(F.shiftrightunsigned("h", i).bitwiseAND(HALF)).alias(f"c{i}") for i in range(32)]
    votes = hashed.groupBy(*keys).agg(F.count("h").alias("n"), *counters)
    bit = lambda count, at: F.when(2 * F.coalesce(count, F.lit(0)) > F.col("n"), F.lit(1 << at if at < 63 else -(1 << 63))).otherwise(F.lit(0))
    whole = F.lit(0).cast("long")
    for i in range(32):
        c = F.col(f"c{i}")
        whole = whole.bitwiseOR(bit(c.bitwiseAND(0xFFFFFFFF), i)).bitwiseOR(bit(F.shiftrightunsigned(c, 32), i + 32))
    return votes.select(*keys, whole.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def _tables(radius: int, blocks: int) -> list[int]:
    """The bits of each table's key. Two fingerprints within the radius differ in at most `radius` blocks, so they agree on
    all the others, which are some table's key."""
    edges = [64 * i // blocks for i in range(blocks + 1)]
    parts = [((1 << (hi - lo)) - 1) << lo for lo, hi in zip(edges, edges[1:])]
    masks = [sum(choice) for choice in combinations(parts, blocks - radius)]
    return [m - (1 << 64) if m >> 63 else m for m in masks]


def _keyed(rows: DataFrame, column: str, name: str, radius: int, blocks: int) -> DataFrame:
    """table, key, name: each distinct fingerprint once in every table."""
    one = rows.select(F.col(column).alias(name)).where(F.col(name).isNotNull()).distinct()
    return one.select(name, F.posexplode(F.array(*[F.col(name).bitwiseAND(F.lit(m)) for m in _tables(radius, blocks)])).alias("table", "key"))


def search(queries: DataFrame, fingerprints: DataFrame, radius: int = 3, blocks: int = 6, column: str = "fingerprint") -> DataFrame:
    """query, found, distance: for each distinct fingerprint of queries, all of fingerprints within the radius."""
    pairs = _keyed(queries, column, "query", radius, blocks).join(_keyed(fingerprints, column, "found", radius, blocks), ["table", "key"])
    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("found")))
    return pairs.where(distance <= radius).select("query", "found", distance.alias("distance")).distinct()


def near_fingerprints(fingerprints: DataFrame, radius: int = 3, blocks: int = 6, column: str = "fingerprint") -> DataFrame:
    """a, b (a < b), distance: all pairs of different fingerprints within the radius."""
    x = F.col("a").bitwiseXOR(F.col("b"))
    pairs = _keyed(fingerprints, column, "a", radius, blocks).join(_keyed(fingerprints, column, "b", radius, blocks), ["table", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(x) <= radius))
    return pairs.select("a", "b", F.bit_count(x).alias("distance")).distinct()


def next_keys(keys: DataFrame, key: str = "key", per_bucket: int = 5000, pieces: int = 64) -> DataFrame:
    """key, next: the next larger key, and the least after the largest. Distinct keys in buckets of their own order
    (pieces at approximate quantiles, cut evenly), each with its own window; buckets are tied by one narrow row each."""
    keys = common.keep(keys.select(F.col(key).alias("key")).distinct(), "keys")
    n, lo, hi, marks = keys.agg(F.count("*"), F.min("key"), F.max("key"), F.percentile_approx("key", [i / pieces for i in range(1, pieces)], 10_000)).first()
    if not n:
        return keys.withColumn("next", F.col("key"))
    bounds = sorted({lo, *marks})
    spans = [b - a for a, b in zip(bounds, [*bounds[1:], hi + 1])]
    bounds_, spans_ = F.array(*map(F.lit, bounds)), F.array(*[F.lit(float(max(1, s))) for s in spans])
    piece = F.size(F.filter(bounds_, lambda b: b <= F.col("key"))) - 1
    fine = max(1, n // (per_bucket * len(bounds)))
    inner = F.floor((F.col("key").cast("double") - F.get(bounds_, F.col("piece")).cast("double")) * fine / F.get(spans_, F.col("piece")))
    rows = keys.withColumn("piece", piece).withColumn("bucket", F.col("piece") * (fine + 2) + inner)
    within = Window.partitionBy("bucket").orderBy("key")
    ties = rows.groupBy("bucket").agg(F.min("key").alias("first"))
    ties = ties.select("bucket", F.coalesce(F.lead("first").over(Window.orderBy("bucket")), F.lit(lo)).alias("beyond"))
    return rows.withColumn("next", F.lead("key").over(within)).join(ties, "bucket").select("key", F.coalesce("next", "beyond").alias("next"))


def fingerprints(docs: DataFrame, radius: int = 3, every: int = 50) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every document, and
    n_near: for documents whose id is divisible by `every`, how many other documents' fingerprints lie within the radius;
    null for the others.

    Texts are shuffled once, by id; both joins use that exchange."""
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("key"), F.coalesce("text", F.lit("")).alias("text"))
    size = F.char_length("text").cast("long")
    order = common.keep(next_keys(rows), "order")
    takes = rows.groupBy("key").agg(F.max(F.floor(size / 4)).alias("most")).join(order, "key").select(F.col("key").alias("before"), F.col("next").alias("key"), "most")
    prefix = rows.join(takes, "key").select(F.col("before").alias("key"), F.substring("text", F.lit(1), F.col("most").cast("int")).alias("prefix"))
    prefix = prefix.groupBy("key").agg(F.min("prefix").alias("prefix"))
    both = rows.join(prefix, "key").withColumn("n_chars", size).withColumn("quarter", F.floor(size / 4).cast("int"))
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - F.col("quarter")), F.substring("prefix", F.lit(1), F.col("quarter")))
    both = both.withColumn("edited", edited)
    named = both.select("key", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("t")), F.struct(F.lit(1).alias("kind"), F.col("edited").alias("t")))).alias("x"), F.xxhash64("text", "edited").alias("own"))
    marks = simhash(named.select("key", "n_chars", "edited_sha256", "own", "x.kind", F.col("x.t").alias("text")), ["key", "n_chars", "edited_sha256", "own", "kind"])
    marks = marks.groupBy("key", "n_chars", "edited_sha256", "own").agg(F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("fp"), F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("efp"))
    marks = common.keep(marks, "marks")
    least = marks.groupBy("key").agg(F.min("fp").alias("next_fp"))
    out = rows_with_copies(rows, marks).join(order, "key").join(least.withColumnRenamed("key", "next"), "next")
    asks = (F.col("key") != NO_ID) & (F.pmod("key", F.lit(every)) == 0)
    copies = common.keep(rows_with_copies(rows, marks).groupBy(F.col("fp").alias("found")).count(), "copies")
    near = search(marks.where(asks).select(F.col("fp").alias("fingerprint")), copies.select(F.col("found").alias("fingerprint")), radius)
    near = near.join(copies, "found").groupBy(F.col("query").alias("fp")).agg((F.sum("count") - 1).alias("n_near"))
    out = out.join(near, "fp", "left").withColumn("n_near", F.when(asks, F.col("n_near")))
    hexed = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(F.when(F.col("key") != NO_ID, F.col("key")).alias("doc_id"), "n_chars", "edited_sha256", hexed("fp").alias("fingerprint"), hexed("efp").alias("edited_fingerprint"), likeness(F.col("fp"), F.col("efp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"), "n_near")


def rows_with_copies(rows: DataFrame, marks: DataFrame) -> DataFrame:
    """marks, once for every row of rows: a row repeated with its id and text comes as often as it stands in rows.

    Only the ids that repeat are counted; they need the narrow columns alone."""
    times = rows.groupBy("key", F.char_length("text").cast("long").alias("n_chars"), F.xxhash64("text").alias("t")).count().where("count > 1").groupBy("key", "n_chars").agg(F.max("count").alias("times"))
    return marks.join(times, ["key", "n_chars"], "left").withColumn("copy", F.explode(F.sequence(F.lit(1), F.coalesce(F.col("times").cast("int"), F.lit(1))))).drop("times", "copy", "own")
