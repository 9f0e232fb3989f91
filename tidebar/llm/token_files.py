"""Token-ID output: ids of all documents, in ascending id order, as range-coded segments in the shared folder.

A file holds the documents of one range of ids; it is a table of segments, each a binary value with its own
document index and its own checksummed blocks (range_coder), so that any task can read any segment alone.

Defined cases: a null or empty text has the end id alone; a null doc_id sorts first and stays null; repeated rows
stay; an empty table gives no segments; other columns are ignored; a text with more ids than a segment may hold is one
segment of its own."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, range_coder, tokens

INDEX = struct.Struct("<4sQ")
SEGMENTS = "file int, segment int, n_docs long, n_tokens long, data binary"
#: Segments whose starts are broadcast, of some 20 bytes each.
MOST_SENT = 500_000
DIGEST = "file int, segment int, doc_id long, place long, n_tokens long, ids_crc32 long"


def pack_segment(doc_ids: list[int | None], parts: list[np.ndarray], block: int) -> bytes:
    """Index (ids, null marks, lengths), then the coded ids of all its documents."""
    null = np.array([x is None for x in doc_ids], np.uint8)
    ids = np.array([0 if x is None else x for x in doc_ids], "<i8")
    n = np.array([len(x) for x in parts], "<u8")
    return INDEX.pack(b"TBDX", len(ids)) + ids.tobytes() + null.tobytes() + n.tobytes() + range_coder.compress(np.concatenate(parts), block)


def open_segment(data: bytes) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, place in the segment, ids) of each document, in order."""
    magic, n = INDEX.unpack_from(data)
    if magic != b"TBDX":
        raise ValueError("not a segment with a document index")
    ids = np.frombuffer(data, "<i8", n, INDEX.size)
    null = np.frombuffer(data, np.uint8, n, INDEX.size + 8 * n)
    length = np.frombuffer(data, "<u8", n, INDEX.size + 9 * n).astype(np.int64)
    flat = range_coder.decompress(data[INDEX.size + 17 * n :])
    start = np.cumsum(length) - length
    for i in range(n):
        yield None if null[i] else int(ids[i]), int(start[i]), flat[start[i] : start[i] + length[i]]


def write_tokens(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, segment_ids: int = 6_000_000, block: int = 8192, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes every whole text, adds end_id, and writes the segments under path in ascending id order.

    segment_ids bounds a task's memory: a segment closes before the document that would take it beyond so many ids, so one
    with more ids than that is a segment of its own."""
    spark = docs.sparkSession

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, file = tokens.encoder(tokenizer), TaskContext.get().partitionId()
        end = np.array([end_id], np.uint32)
        names: list[int | None] = []
        parts: list[np.ndarray] = []
        held, segment = 0, 0

        def flush() -> pa.RecordBatch:
            data = pack_segment(names, parts, block)
            return pa.RecordBatch.from_pydict({"file": pa.array([file], pa.int32()), "segment": pa.array([segment], pa.int32()), "n_docs": pa.array([len(names)], pa.int64()), "n_tokens": pa.array([held], pa.int64()), "data": pa.array([data], pa.binary())})

        for batch in common.slices(batches, 1, rows=tokens.ROWS):
            got = coder.encode(batch.column(1))
            for name, ids in zip(batch.column(0).to_pylist(), got):
                if names and held + len(ids) + 1 > segment_ids:
                    yield flush()
                    names, parts, held, segment = [], [], 0, segment + 1
                names.append(name)
                parts.append(np.concatenate([ids, end]))
                held += len(ids) + 1
        if names:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    rows = rows.repartitionByRange(common.shuffle_partitions(spark), "doc_id").sortWithinPartitions("doc_id")
    rows.mapInArrow(encode, SEGMENTS).write.parquet(path)


def _starts(segments: DataFrame) -> DataFrame:
    """(file, segment, start): ids before each segment. Two prefix sums, over files and within a file, on one narrow row per segment."""
    by_file = segments.groupBy("file").agg(F.sum("n_tokens").alias("n"))
    by_file = by_file.select("file", (F.sum("n").over(Window.orderBy("file")) - F.col("n")).alias("before"))
    within = F.sum("n_tokens").over(Window.partitionBy("file").orderBy("segment")) - F.col("n_tokens")
    return segments.select("file", "segment", within.alias("within")).join(by_file, "file").select("file", "segment", (F.col("before") + F.col("within")).alias("start"))


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and ids of every document in the files."""
    return _read(spark, path, "file int, segment int, doc_id long, place long, n_tokens long, ids array<int>", lambda ids: {"ids": ids.astype(np.int32)})


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, computed from the ids read back."""
    return _read(spark, path, DIGEST, lambda ids: {"ids_crc32": zlib.crc32(ids.astype("<u4").tobytes())})


def _read(spark: SparkSession, path: str, schema: str, value) -> DataFrame:
    kinds = {"int": pa.int32(), "long": pa.int64(), "array<int>": pa.list_(pa.int32())}
    fields = pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in schema.split(", ")])

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, segment, data in zip(*(c.to_pylist() for c in batch.columns)):
                rows, held = [], 0
                for doc_id, place, ids in open_segment(data):
                    rows.append({"file": file, "segment": segment, "doc_id": doc_id, "place": place, "n_tokens": len(ids)} | value(ids))
                    held += len(ids)
                    if held > 2_000_000:
                        yield pa.RecordBatch.from_pylist(rows, fields)
                        rows, held = [], 0
                yield pa.RecordBatch.from_pylist(rows, fields)

    segments = spark.read.schema(SEGMENTS).parquet(path)
    rows = segments.select("file", "segment", "data").mapInArrow(decode, schema)
    # one narrow row per segment: sent to all tasks unless the files hold very many segments, so that rows stay where they are
    starts = _starts(segments.select("file", "segment", "n_tokens"))
    few = segments.select("file").count() <= MOST_SENT
    rows = rows.join(F.broadcast(starts) if few else starts, ["file", "segment"])
    return rows.withColumn("start", F.col("start") + F.col("place")).drop("file", "segment", "place")


def token_output(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes the documents' ids and returns what the files hold: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = common.new_path(spark, "tokens")
    write_tokens(docs, path, tokenizer or tokens.tokenizer_path())
    return read_digests(spark, path).select("doc_id", "start", "n_tokens", "ids_crc32")
