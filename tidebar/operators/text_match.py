"""Many patterns searched in many texts, with byte places. The patterns are a given list; the texts are a table.

A few patterns, leftmost-first, are one alternation in Spark's own functions. Otherwise an automaton of the patterns' first
bytes reads every text once: failure links are folded into a table of transitions, built on the driver, whose size is
checked and which is broadcast. Texts are cut to stretches that overlap by a pattern's first bytes, and all stretches
of a batch step through the table side by side in numpy; what a pattern holds beyond its first bytes is compared at its hits."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

MATCHES = "doc_id bigint, pattern int, start bigint, end bigint"


def find_all(text: bytes, patterns: list[bytes], kind: str = "leftmost-first", overlapping: bool = False, most: int | None = None) -> list[tuple[int, int, int]]:
    """(pattern, start, end) in order. standard: by end, the first to end wins; leftmost-first: by start, then the order of
    the patterns; leftmost-longest: by start, then the longest. Without overlapping, each match begins where the last ended."""
    hits = []
    for n, p in enumerate(patterns):
        at = text.find(p) if p else -1
        while at >= 0:
            hits.append((n, at, at + len(p)))
            at = text.find(p, at + 1)
    return _chosen(hits, kind, overlapping, most)


def _chosen(hits: list[tuple[int, int, int]], kind: str, overlapping: bool, most: int | None) -> list[tuple[int, int, int]]:
    order = {"standard": lambda h: (h[2], h[1], h[0]), "leftmost-first": lambda h: (h[1], h[0]), "leftmost-longest": lambda h: (h[1], -h[2], h[0])}[kind]
    hits.sort(key=order)
    if not overlapping:
        kept, end = [], 0
        for h in hits:
            if h[1] >= end:
                kept.append(h)
                end = h[2]
        hits = kept
    return hits[:most] if most is not None else hits


def _leftmost_first(docs: DataFrame, patterns: list[str], fold_case: bool, most: int | None) -> DataFrame:
    """One scan of each text by all patterns at once, in Spark's own functions. An alternation takes the first pattern in the
    list that begins at the leftmost place; the texts between matches give the places."""
    fold = lambda c: F.translate(c, ascii_uppercase, ascii_lowercase) if fold_case else c
    own = [p.translate(str.maketrans(ascii_uppercase, ascii_lowercase)) if fold_case else p for p in patterns]
    either = "|".join(re.escape(p) for p in own if p)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), fold(F.coalesce("text", F.lit(""))).alias("text"))
    if not either:
        return rows.limit(0).select("doc_id", F.lit(0).alias("pattern"), F.lit(0).cast("bigint").alias("start"), F.lit(0).cast("bigint").alias("end"))
    rows = rows.select("doc_id", F.regexp_extract_all("text", F.lit(either), F.lit(0)).alias("found"), F.split("text", either, -1).alias("between")).where(F.size("found") > 0)
    parts = F.zip_with("found", F.slice("between", F.lit(1), F.size("found")), lambda m, gap: F.struct(m.alias("m"), F.octet_length(gap).cast("bigint").alias("gap"), F.octet_length(m).cast("bigint").alias("n")))
    rows = rows.select("doc_id", F.monotonically_increasing_id().alias("row"), F.posexplode(parts).alias("nth", "p"))
    end = F.sum(F.col("p.gap") + F.col("p.n")).over(Window.partitionBy("row").orderBy("nth"))
    rows = rows.withColumn("end", end).where(F.lit(True) if most is None else F.col("nth") < most)
    return rows.select("doc_id", (F.array_position(F.array(*map(F.lit, own)), F.col("p.m")) - 1).cast("int").alias("pattern"), (F.col("end") - F.col("p.n")).alias("start"), "end")


class Automaton:
    """Aho-Corasick over the first `deep` bytes of each pattern, as arrays: next state by state and class of byte, the pattern
    starts that end at a state, and the next shorter such state. deep shrinks until the table fits most_bytes."""

    STRETCH = 2048

    def __init__(self, patterns: list[bytes], fold_case: bool = False, deep: int = 24, most_bytes: int = 64_000_000):
        self.fold = np.arange(256, dtype=np.uint8)
        if fold_case:
            self.fold[65:91] += 32
        self.patterns = [bytes(self.fold[np.frombuffer(p, np.uint8)]) for p in patterns]
        used = np.unique(np.frombuffer(b"".join(self.patterns), np.uint8))
        self.classes = np.zeros(256, np.int32)
        self.classes[used] = np.arange(1, len(used) + 1)
        self.classes, width = self.classes[self.fold], len(used) + 1
        while deep > 2 and len({p[:k] for p in self.patterns for k in range(1, deep + 1)}) * width * 4 > most_bytes:
            deep -= 2
        self.deep = min(deep, max(map(len, self.patterns), default=1))
        # the trie, level by level; a state is a distinct start of a pattern
        states, levels = {b"": 0}, [[b""]]
        for k in range(1, self.deep + 1):
            levels.append(sorted({p[:k] for p in self.patterns if len(p) >= k}))
            for s in levels[-1]:
                states[s] = len(states)
        self.next, fail = np.zeros((len(states), width), np.int32), np.zeros(len(states), np.int32)
        for k, level in enumerate(levels[1:], 1):
            at, before = np.array([states[s] for s in level], np.int32), np.array([states[s[:-1]] for s in level], np.int32)
            code = self.classes[np.array([s[-1] for s in level], np.uint8)]
            # a start's failure is where its own failure goes on the same byte
            fail[at] = self.next[fail[before], code] if k > 1 else 0
            self.next[before, code] = at
            self.next[at] = self.next[fail[at]]
        self.width = width
        held = defaultdict(list)
        for n, p in enumerate(self.patterns):
            if p:
                held[states[p[: self.deep]]].append(n)
        self.count = np.zeros(len(states), np.int32)
        self.count[list(held)] = [len(v) for v in held.values()]
        self.first = np.zeros(len(states), np.int64)
        self.members = np.array([n for s in sorted(held) for n in held[s]], np.int64)
        self.first[sorted(held)] = np.cumsum([0] + [len(held[s]) for s in sorted(held)])[:-1]
        self.depth = np.zeros(len(states), np.int32)
        for k, level in enumerate(levels):
            self.depth[[states[s] for s in level]] = k
        # the nearest failure that ends a start; failures are shorter, so levels in order see them done
        self.link = np.zeros(len(states), np.int32)
        for level in levels[1:]:
            at = np.array([states[s] for s in level], np.int32)
            self.link[at] = np.where(self.count[fail[at]] > 0, fail[at], self.link[fail[at]])
        self.lengths = np.array([len(p) for p in self.patterns], np.int64)

    def _stepped(self, codes: np.ndarray, ends: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place of the last byte, state) wherever a start of a pattern ends."""
        parts = np.maximum(1, -(-(ends - starts) // self.STRETCH))
        text = np.repeat(np.arange(len(parts)), parts)
        own = starts[text] + (np.arange(len(text)) - np.repeat(np.cumsum(parts) - parts, parts)) * self.STRETCH
        stop = np.minimum(own + self.STRETCH, ends[text])
        begin = np.maximum(own - self.deep + 1, starts[text])
        order = np.argsort(begin - stop, kind="stable")
        own, stop, begin = own[order], stop[order], begin[order]
        sizes, state = stop - begin, np.zeros(len(own), np.int64)
        flat, ending = self.next.ravel(), (self.count > 0) | (self.link > 0)
        places, states = [], []
        for step in range(int(sizes[0]) if len(sizes) else 0):
            k = int(np.searchsorted(-sizes, -step, "left"))  # stretches longer than step
            at = begin[:k] + step
            state[:k] = flat[state[:k] * self.width + codes[at]]
            hit = np.nonzero(ending[state[:k]])[0]
            if len(hit):
                hit = hit[at[hit] >= own[hit]]
                places.append(at[hit])
                states.append(state[hit])
        return (np.concatenate(places), np.concatenate(states)) if places else (np.zeros(0, np.int64), np.zeros(0, np.int64))

    def search(self, texts: list[bytes]) -> list[list[tuple[int, int, int]]]:
        """Per text all occurrences (pattern, start, end) of all patterns, overlapping ones too."""
        joined = self.fold[np.frombuffer(b"".join(texts), np.uint8)]
        ends = np.cumsum([len(t) for t in texts])
        starts = ends - [len(t) for t in texts]
        place, state = self._stepped(self.classes[joined], ends, starts)
        found: list[list[tuple[int, int, int]]] = [[] for _ in texts]
        whole = joined.tobytes()
        while len(place):
            n = self.count[state]
            nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pattern = self.members[np.repeat(self.first[state], n) + nth]
            start = np.repeat(place + 1 - self.depth[state], n)
            end = start + self.lengths[pattern]
            text = np.searchsorted(ends, start, "right")
            inside = end <= ends[text]
            long = self.lengths[pattern] > self.deep
            for i in np.nonzero(inside)[0]:
                p, a, b, t = int(pattern[i]), int(start[i]), int(end[i]), int(text[i])
                if not long[i] or whole[a:b] == self.patterns[p]:
                    found[t].append((p, a - int(starts[t]), b - int(starts[t])))
            state = self.link[state]
            more = state > 0
            place, state = place[more], state[more]
        return found


#: With more patterns than this an alternation, which tries them in turn, gives way to the automaton.
FEW = 16


def match_patterns(docs: DataFrame, patterns: list[str], kind: str = "leftmost-first", fold_case: bool = False, overlapping: bool = False, most: int | None = None) -> DataFrame:
    """doc_id, pattern (its place in the list), start and end byte of each match; fold_case folds ASCII letters; most: so many
    matches of a text."""
    if kind == "leftmost-first" and not overlapping and len(patterns) <= FEW:
        return _leftmost_first(docs, patterns, fold_case, most)
    spark = docs.sparkSession
    automaton = spark.sparkContext.broadcast(Automaton([p.encode() for p in patterns], fold_case))

    def matched(names: list, texts: list[bytes]) -> pa.RecordBatch:
        rows = [(doc_id, *m) for doc_id, hits in zip(names, automaton.value.search(texts)) for m in _chosen(hits, kind, overlapping, most)]
        columns = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int64(), pa.int64()))], ["doc_id", "pattern", "start", "end"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts, held = [], [], 0
        for batch in batches:
            for doc_id, text in zip(*(c for c in batch.columns)):
                names.append(doc_id.as_py())
                texts.append((text.as_py() or "").encode())
                held += len(texts[-1])
                if held > 4_000_000:
                    yield matched(names, texts)
                    names, texts, held = [], [], 0
        if names:
            yield matched(names, texts)

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, MATCHES)
