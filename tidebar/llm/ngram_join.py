"""N-gram Jaccard join by vertical partitioning, and the classes of near copies it links.

A document is the set of its distinct word shingles. The n-grams have one global order (document frequency, then
hash). The work is cut along that order, never by pairs:

1. Every whole text becomes hashed shingles; equal sets are one class from here on.
2. The n-grams are dealt into fragments, packed, and each fragment finds which of its n-grams two classes share.
   An n-gram that no other class holds can add to no overlap, so only the shared ones go back to their class.
   N-grams met in very many texts are spread over fragments by text, as their frequency needs no exact count.
3. Two sets that reach the threshold share an n-gram among the first n - ceil(t n) + 1 of each in the global
   order. In each such bucket every class is first paired with one pivot drawn for that bucket, and links join
   classes to components. Only where a bucket still holds several components are its remaining pairs formed
   across components. So no link between different components is lost, and a group of copies never becomes all
   of its pairs. A pair is dropped in the join where it can't reach the threshold by its sizes, or by 512 parity bits
   of each set: common n-grams cancel in their difference, so its bits are at most the n-grams that differ.
4. The global order is cut into fragments, each a range of it (edges by frequency, so that rare n-grams stand apart from
   common ones). A pair's overlap is counted fragment by fragment on the two cut sets and summed per pair; that sum is
   exact.

near_classes gives the components alone, and for that skips links within a component already found. linked_classes gives
every link between different sets.

Defined cases: a text with fewer words than a shingle is one shingle, its whole sequence; a null, empty or blank
text has none, and links with nothing; repeated rows are equal sets; rows with a null id take part, and a class's
id is the least id that is not null; other columns are ignored. Hashes have 64 bits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, workers

LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
MANY = 65535  # stands for the frequency of an n-gram met in very many texts
EDGES = (3, 5, 17)  # least frequency of every fragment of the global order but the first
BITS = [f"bits{i}" for i in range(8)]
SIDE = ["cls", "n", "alone", *BITS]
#: Pairs whose classes are broadcast, of 16 bytes each.
MOST_SENT = 50_000
_U = np.uint64


class WordHashes(dict):
    """Word -> 64-bit hash; starts anew at half of workers.LIMIT, as a word is soon hashed again."""

    size = 0

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if self.size > workers.LIMIT // 2:
            self.clear()
            self.size = 0
        self.size += workers.ENTRY + len(word)
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def _words() -> WordHashes:
    return workers.hold("ngram_join", "words", WordHashes)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(33))) * _U(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> _U(33))) * _U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> _U(33))


def shingles(text: str | None, width: int = 5) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's shingles; empty without words."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return np.zeros(0, _U)
    h = np.fromiter(map(_words().__getitem__, words), _U, len(words))
    size = min(width, len(words))
    total = np.full(len(words) - size + 1, size, _U)
    for i in range(size):
        total = total * _U(0x9E3779B97F4A7C15) + h[i : len(words) - size + 1 + i]
    return np.unique(_mix(total))


def class_of(sh: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(sh.tobytes(), digest_size=8).digest(), "little", signed=True)


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))


def _sets(docs: DataFrame, width: int) -> DataFrame:
    """doc_id, n (set size), cls (class of equal sets, null for an empty set)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            sets = [shingles(t, width) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([class_of(s) if len(s) else None for s in sets], pa.int64())], ["doc_id", "n", "cls"])

    return docs.mapInArrow(run, "doc_id long, n long, cls long")


def _frequent(docs: DataFrame, width: int, rows: int, sample: int, least: int) -> np.ndarray:
    """N-grams that at least `least` classes of a sample of about `sample` texts hold. They only steer where n-grams
    are counted; results do not depend on them. The list is bounded by the sample's n-grams over `least`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            for t in batch.column(1).to_pylist():
                if len(s := shingles(t, width)):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(s), class_of(s), np.int64)), pa.array(s.view(np.int64))], ["cls", "h"])

    part = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(max(1, rows // sample))) == 0) if rows > sample else docs
    found = part.mapInArrow(run, "cls long, h long").distinct().groupBy("h").count().where(F.col("count") >= least).select("h").collect()
    return np.sort(np.array([r.h for r in found], np.int64).view(_U))


def _fragments(docs: DataFrame, width: int, fragments: int, frequent: np.ndarray) -> DataFrame:
    """frag, data: packed (class, n-gram) entries, one value per batch and fragment."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in common.slices(batches, 1):
            by_class = {}
            for t in batch.column(1).to_pylist():
                if len(s := shingles(t, width)):
                    by_class.setdefault(class_of(s), s)
            if not by_class:
                continue
            ids = np.fromiter(by_class, np.int64, len(by_class))
            h = np.concatenate(list(by_class.values()))
            own = np.repeat(np.arange(len(ids), dtype=np.uint32), [len(s) for s in by_class.values()])
            frag = (h % _U(fragments)).astype(np.int64)
            if len(frequent):
                often = frequent[np.minimum(np.searchsorted(frequent, h), len(frequent) - 1)] == h
                frag[often] = fragments + (ids[own[often]] & 0x7FFFFFFF) % fragments
            order = np.argsort(frag, kind="stable")
            frag, h, own = frag[order], h[order], own[order]
            cut = np.flatnonzero(np.diff(frag)) + 1
            first, upto = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
            data = []
            for a, b in zip(first, upto):
                used, local = np.unique(own[a:b], return_inverse=True)
                data.append(len(used).to_bytes(4, "little") + ids[used].tobytes() + h[a:b].tobytes() + local.astype(np.uint16 if len(used) < 65536 else np.uint32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(frag[first], pa.int64()), pa.array(data, pa.binary())], ["frag", "data"])

    return docs.mapInArrow(run, "frag long, data binary")


def _unpack(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    k = int.from_bytes(data[:4], "little")
    ids = np.frombuffer(data, np.int64, k, 4)
    wide = 2 if k < 65536 else 4
    n = (len(data) - 4 - 8 * k) // (8 + wide)
    h = np.frombuffer(data, _U, n, 4 + 8 * k)
    return ids[np.frombuffer(data, f"<u{wide}", n, 4 + 8 * k + 8 * n)], h


def _shared(packed: DataFrame, fragments: int, buckets: int) -> DataFrame:
    """From each fragment: its n-grams that two classes hold, packed by bucket of classes: bucket, data."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        got = [_unpack(x.as_py()) for x in table.column("data")]
        cls, h = np.concatenate([g[0] for g in got]), np.concatenate([g[1] for g in got])
        del got, table
        if key[0].as_py() < fragments:
            order = np.argsort(h)
            cls, h = cls[order], h[order]
            same = h[1:] == h[:-1]
            some = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            cls, h = cls[some], h[some]
            order = np.lexsort((cls, h))
            cls, h = cls[order], h[order]
            new = np.ones(len(h), bool)
            new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
            cls, h = cls[new], h[new]
            _, at, df = np.unique(h, return_inverse=True, return_counts=True)
            df = df[at]
            cls, h, df = cls[df > 1], h[df > 1], np.minimum(df[df > 1], MANY)
        else:
            df = np.full(len(h), MANY)
        bucket = cls % buckets
        order = np.argsort(bucket, kind="stable")
        bucket, cls, h, df = bucket[order], cls[order], h[order], df[order].astype(np.uint16)
        cut = np.flatnonzero(np.diff(bucket)) + 1
        first, upto = np.concatenate([[0], cut]), np.concatenate([cut, [len(h)]])
        rows = [(int(bucket[a]), cls[a:b].tobytes() + h[a:b].tobytes() + df[a:b].tobytes()) for a, b in zip(first, upto) if b > a]
        return pa.table({"bucket": pa.array([r[0] for r in rows], pa.int64()), "data": pa.array([r[1] for r in rows], pa.binary())})

    return packed.groupBy("frag").applyInArrow(run, "bucket long, data binary")


def _candidates(shared: DataFrame, classes: DataFrame, percent: int, buckets: int) -> DataFrame:
    """cls, n, k, grams, cuts, alone, bits: the classes that can reach the threshold, their shared n-grams in the global
    order, how many of these lie in the class's prefix, where each fragment of the order ends in grams, how many n-grams
    no other class has, and the parity bits of grams."""
    kinds = pa.schema([("cls", pa.int64()), ("n", pa.int64()), ("k", pa.int32()), ("grams", pa.list_(pa.int64())), ("cuts", pa.list_(pa.int32())), ("alone", pa.int64()), *((b, pa.int64()) for b in BITS)])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        cls, h, df = [], [], []
        for x in left.column("data"):
            data = x.as_py()
            m = len(data) // 18
            cls.append(np.frombuffer(data, np.int64, m))
            h.append(np.frombuffer(data, np.int64, m, 8 * m))
            df.append(np.frombuffer(data, np.uint16, m, 16 * m))
        if not cls or not right.num_rows:
            return kinds.empty_table()
        cls, h, df = np.concatenate(cls), np.concatenate(h), np.concatenate(df)
        order = np.lexsort((h, df, cls))
        cls, h, df = cls[order], h[order], df[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (cls[1:] != cls[:-1])
        cls, h, df = cls[new], h[new], df[new]
        first = np.flatnonzero(np.concatenate([[True], cls[1:] != cls[:-1]]))
        upto = np.concatenate([first[1:], [len(cls)]])
        size = dict(zip(right.column("cls").to_pylist(), right.column("n").to_pylist()))
        rows = []
        for a, b in zip(first.tolist(), upto.tolist()):
            n = size[int(cls[a])]
            k = n + (percent * n) // -100 + 1 - (n - (b - a))
            if k > 0:
                parity = np.packbits((np.bincount(h[a:b] & 511, minlength=512) & 1).astype(np.uint8)).view(np.int64)
                rows.append({"cls": int(cls[a]), "n": n, "k": k, "grams": h[a:b], "cuts": [*np.searchsorted(df[a:b], EDGES).tolist(), b - a], "alone": n - (b - a)} | dict(zip(BITS, parity.tolist())))
        return pa.Table.from_pylist(rows, kinds)

    classes = classes.select("cls", "n", F.pmod("cls", F.lit(buckets)).alias("bucket"))
    return shared.groupBy("bucket").cogroup(classes.groupBy("bucket")).applyInArrow(run, ", ".join(["cls long, n long, k int, grams array<long>, cuts array<int>, alone long", *(f"{b} long" for b in BITS)]))


def _overlaps(pairs: DataFrame, grams: DataFrame) -> DataFrame:
    """a, b, shared: partial overlaps counted in each fragment of the n-gram order, summed per pair."""
    begin = lambda f: F.when(f > 0, F.get("cuts", f - 1)).otherwise(0)
    cut = F.transform(F.sequence(F.lit(0), F.lit(len(EDGES))), lambda f: F.struct(f.alias("f"), F.slice("grams", begin(f) + 1, F.get("cuts", f) - begin(f)).alias("part")))
    parts = grams.select("cls", F.explode(cut).alias("x")).select("cls", "x.f", "x.part").where(F.size("part") > 0)
    both = pairs.join(parts.select(F.col("cls").alias("a"), "f", F.col("part").alias("pa")), "a").join(parts.select(F.col("cls").alias("b"), "f", F.col("part").alias("pb")), ["b", "f"])
    return both.select("a", "b", "na", "nb", F.size(F.array_intersect("pa", "pb")).alias("o")).groupBy("a", "b", "na", "nb").agg(F.sum("o").alias("shared"))


def _may_link(percent: int):
    """Whether sides x and y of a pair (structs of SIDE) can reach the threshold."""
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    differ = sum((F.bit_count(x(b).bitwiseXOR(y(b))) for b in BITS), x("alone") + y("alone"))
    sizes = 100 * F.least(x("n"), y("n")) >= percent * F.greatest(x("n"), y("n"))
    return (x("cls") != y("cls")) & sizes & ((100 + percent) * differ <= (100 - percent) * (x("n") + y("n")))


def _paired(rows: DataFrame) -> DataFrame:
    """Distinct (a, b, na, nb) with a < b from sides x and y."""
    first = lambda c, o: F.when(F.col("x.cls") < F.col("y.cls"), F.col(f"{c}")).otherwise(F.col(f"{o}"))
    return rows.select(first("x.cls", "y.cls").alias("a"), first("y.cls", "x.cls").alias("b"), first("x.n", "y.n").alias("na"), first("y.n", "x.n").alias("nb")).distinct()


def _links(pairs: DataFrame, grams: DataFrame, percent: int) -> DataFrame:
    got = _overlaps(pairs, grams)
    return got.where((100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb"))).select("a", "b")


def _of_pairs(grams: DataFrame, pairs: DataFrame) -> DataFrame:
    """The rows of grams that pairs need. Where pairs are few, their classes are sent to grams, which then need not move."""
    if pairs.count() > MOST_SENT:
        return grams
    ids = pairs.select(F.col("a").alias("cls")).union(pairs.select(F.col("b").alias("cls"))).distinct()
    return grams.join(F.broadcast(ids), "cls", "left_semi")


def _prepared(docs: DataFrame, width: int, percent: int, fragment_grams: int, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(sets, classes, grams): the documents' sets, the classes of equal sets, and the classes that can have links."""
    docs = _texts(docs, id_col, text_col)
    sets = common.keep(_sets(docs, width), "sets")
    classes = sets.where("cls is not null").groupBy("cls").agg(F.max("n").alias("n"), F.min("doc_id").alias("least"))
    rows, total = sets.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    fragments = max(1, -(-total // fragment_grams))
    frequent = _frequent(docs, width, rows, sample=4000, least=8)
    packed = _fragments(docs, width, fragments, frequent)
    grams = common.keep(_candidates(_shared(packed, fragments, fragments), classes, percent, fragments), "grams")
    return sets, classes, grams


def linked_classes(docs: DataFrame, width: int = 5, percent: int = 75, fragment_grams: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(links, members): every linked pair of different sets as classes a and b, with what they share; and doc_id, cls of
    every document, null where the set is empty. Documents of one class are linked as well."""
    sets, _, grams = _prepared(docs, width, percent, fragment_grams, id_col, text_col)
    post = grams.select(F.explode(F.slice("grams", F.lit(1), F.col("k"))).alias("h"), F.struct(*SIDE).alias("x"))
    rows = post.join(post.select("h", F.col("x").alias("y")), "h").where((F.col("x.cls") < F.col("y.cls")) & _may_link(percent))
    got = _overlaps(common.keep(_paired(rows), "pairs"), grams).where((100 + percent) * F.col("shared") >= percent * (F.col("na") + F.col("nb")))
    return got.select("a", "b", "shared"), sets.select("doc_id", "cls")


def near_classes(docs: DataFrame, width: int = 5, percent: int = 75, fragment_grams: int = 1_500_000, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document; percent is the Jaccard threshold.

    fragment_grams bounds the n-grams that one task of a fragment holds."""
    spark = docs.sparkSession
    sets, classes, grams = _prepared(docs, width, percent, fragment_grams, id_col, text_col)
    common.forget_shuffles(spark)
    links, used = _all_links(spark, grams, percent)
    roots = common.connected_components(links)
    named = classes.join(roots.withColumnRenamed("node", "cls"), "cls", "left").select("cls", "least", F.coalesce("root", "cls").alias("root"))
    named = common.keep(named, "named")
    common.release(grams, *used)
    least = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = named.join(least, "root").select("cls", "component_id")
    out = sets.join(by_class, "cls", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _all_links(spark: SparkSession, grams: DataFrame, percent: int, pivots: int = 2) -> tuple[DataFrame, list[DataFrame]]:
    """Links between classes that give the same components as all links do (a, b), and the tables kept for them. What is
    joined by n-gram is written first, so that the rows of a common one can be split by Spark's adaptive skew join. Postings
    travel without parity bits: a pivot gives at most a pair per posting, so the bits are joined to the distinct pairs."""
    used = []
    post = grams.select(F.explode(F.slice("grams", F.lit(1), F.col("k"))).alias("h"), F.col("cls").alias("own"), "n")
    sides = grams.select("cls", F.struct(*SIDE).alias("x"))
    found = spark.createDataFrame([], "a long, b long")
    done = spark.createDataFrame([], "a long, b long")
    for turn in range(pivots + 1):
        if turn:
            roots = common.connected_components(found)
            now = post.join(roots.withColumnRenamed("node", "own"), "own", "left").withColumn("root", F.coalesce("root", "own"))
            mixed = now.groupBy("h").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("h")
            mixed = common.keep(mixed, "mixed")
            used.append(mixed)
            open_ = common.keep(now.join(mixed, "h"), "open")
            used.append(open_)
        else:
            open_ = post.withColumn("root", F.col("own"))
        if turn < pivots:
            pivot = open_.groupBy("h").agg(F.count("*").alias("c"), F.min_by(F.struct(F.col("own").alias("y"), F.col("n").alias("ny"), F.col("root").alias("other")), F.xxhash64("own", "h", F.lit(turn))).alias("p")).where("c > 1").select("h", "p.*")
            pivot = common.keep(pivot, "pivot")
            used.append(pivot)
            near = (F.col("root") != F.col("other")) & (F.col("own") != F.col("y")) & (100 * F.least("n", "ny") >= percent * F.greatest("n", "ny"))
            pairs = open_.join(pivot, "h").where(near).select(F.least("own", "y").alias("a"), F.greatest("own", "y").alias("b")).distinct()
            x, y = (sides.select(F.col("cls").alias(c), F.col("x").alias(name)) for c, name in (("a", "x"), ("b", "y")))
            rows = pairs.join(x, "a").join(y, "b").where(_may_link(percent))
            pairs = rows.select("a", "b", F.col("x.n").alias("na"), F.col("y.n").alias("nb"))
        else:
            side = open_.join(sides.withColumnRenamed("cls", "own"), "own").select("h", "x", "root")
            other = side.select("h", F.col("x").alias("y"), F.col("root").alias("other"))
            pairs = _paired(side.join(other, "h").where((F.col("root") < F.col("other")) & _may_link(percent)))
        pairs = common.keep(pairs.join(done, ["a", "b"], "left_anti"), "pairs")
        done = done.union(pairs.select("a", "b"))
        links = common.keep(_links(pairs, _of_pairs(grams, pairs), percent), "links")
        used += [pairs, links]
        found = found.union(links)
    return found, used
