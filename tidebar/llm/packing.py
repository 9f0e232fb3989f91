"""Best-fit packing of documents into sequences of bounded length.

Texts are encoded where they are read, and only a narrow row per piece travels. Pieces are dealt into groups of
bounded size; in a group they come online, in the order of their documents, and each goes to the open bin with the least
free space that holds it. The open bins are a bitset keyed by free space with a stack of bins per bit; their number is
fixed, and when it is reached the fullest closes, so that what a task holds does not depend on how many pieces come.

Defined cases: a null or empty text is its end id alone; repeated rows and null ids are packed like any others; an
empty table gives no pieces; other columns are ignored. Only a text longer than a sequence is cut: full pieces,
with the shorter one first."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, tokens

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of each piece of a document of n ids."""
    first = n % capacity or min(n, capacity)
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


class OpenBins:
    """At most `limit` open bins, found by free space. place() gives the bin and the offset for a piece."""

    def __init__(self, capacity: int, limit: int):
        self.capacity, self.limit = capacity, limit
        self.bits, self.open, self.made = 0, 0, 0
        self.by_free: list[list[int]] = [[] for _ in range(capacity + 1)]

    def _take(self, free: int) -> int:
        stack = self.by_free[free]
        bin_ = stack.pop()
        if not stack:
            self.bits &= ~(1 << free)
        self.open -= 1
        return bin_

    def place(self, length: int) -> tuple[int, int]:
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_ = self._take(free)
        else:
            if self.open >= self.limit:
                self._take((self.bits & -self.bits).bit_length() - 1)
            bin_, free = self.made, self.capacity
            self.made += 1
        left = free - length
        if left:
            self.by_free[left].append(bin_)
            self.bits |= 1 << left
            self.open += 1
        return bin_, self.capacity - free


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece of every whole text."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = tokens.encoder(tokenizer), np.array([end_id], np.uint32)
        for batch in common.slices(batches, 1, rows=tokens.ROWS):
            rows = []
            for doc_id, ids in zip(batch.column(0).to_pylist(), coder.encode(batch.column(1))):
                ids = np.concatenate([ids, end]).astype("<u4")
                rows += [(doc_id, k, s, n, zlib.crc32(ids[s : s + n].tobytes())) for k, (s, n) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(encode, PIECES)


def best_fit(items: DataFrame, capacity: int, open_bins: int = 64, group_rows: int = 100_000) -> DataFrame:
    """Adds sequence_id and offset to items with a `length` (1 to capacity).

    Groups of about group_rows items bound a task; each leaves at most open_bins bins unfilled."""
    items = common.keep(items, "pieces")
    groups = max(1, -(-items.count() // group_rows))

    def pack(key: tuple, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["doc_id", "piece"], kind="stable")
        bins = OpenBins(capacity, open_bins)
        placed = np.array([bins.place(n) for n in frame["length"].tolist()], np.int64).reshape(-1, 2)
        return frame.drop(columns="group").assign(sequence_id=(int(key[0]) << 32) + placed[:, 0], offset=placed[:, 1])

    dealt = items.withColumn("group", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))
    return dealt.groupBy("group").applyInPandas(pack, f"{PIECES}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset of every piece of every document."""
    return best_fit(pieces(docs, tokenizer or tokens.tokenizer_path(), capacity), capacity)
