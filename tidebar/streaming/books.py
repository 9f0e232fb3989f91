"""Order books from a stream of snapshots and deltas, one keyed state per series.

The state is a map of levels, the deltas that wait for a snapshot, and where the book stands: `syncing` (no snapshot
yet), `bridging` (a snapshot, no delta after it), `live`, or `resync` (broken: empty until a new snapshot). A batch reads a
series' levels once and writes those that it changed; what waits is added in packed pieces, read one by one only when a
snapshot replays it. Events are packed into columns before they come to their series' task, and deltas that follow each
other are taken together. The state store must be RocksDB (see session.py)."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from itertools import chain, groupby
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..schemas import LEVEL, SERIES
from .state import read_map, write_map

EVENTS = f"exchange string, market_type string, symbol string, kind string, first_update_id bigint, final_update_id bigint, previous_final_update_id bigint, bids array<{LEVEL}>, asks array<{LEVEL}>, arrival bigint"
BOOK = f"exchange string, market_type string, symbol string, last_update_id bigint, bids array<{LEVEL}>, asks array<{LEVEL}>, state string, needs_resync boolean, breaks int, reason string"
PACKED = "exchange string, market_type string, symbol string, events binary"
#: What a run has of each event, as bigint; shot: 1 for a snapshot.
HEAD = ["shot", "first_update_id", "final_update_id", "previous_final_update_id", "arrival", "n_bids", "n_levels"]
#: A null id, and the arrival of an event that has none: behind all others.
NONE, LATEST = np.iinfo(np.int64).min, np.iinfo(np.int64).max
#: Events that are put in order at a time, levels of a piece of what waits, and deltas that are taken one by one.
STEP, PIECE, FEW = 50_000, 1 << 16, 8


class Delta(NamedTuple):
    first: int
    final: int
    previous: int | None
    levels: list[tuple[str, float, float]]


class Run:
    """Events in order, as columns: heads has a row for each of HEAD, levels the prices and the quantities of all events one
    behind the other, each event's bids before its asks."""

    def __init__(self, heads: np.ndarray, levels: np.ndarray):
        self.heads, self.levels = heads, levels
        self.shot, self.first, self.final, self.previous, self.arrival, self.n_bids, self.n_levels = heads
        self.start = np.concatenate(([0], np.cumsum(self.n_levels)))

    def __len__(self) -> int:
        return self.heads.shape[1]

    def pack(self) -> bytes:
        return b"".join((np.array([len(self), self.levels.shape[1]]).tobytes(), self.heads.tobytes(), self.levels.tobytes()))

    @staticmethod
    def unpack(packed: bytes) -> Run:
        n, m = np.frombuffer(packed, np.int64, 2)
        at = 16 + 8 * len(HEAD) * n
        return Run(np.frombuffer(packed, np.int64, len(HEAD) * n, 16).reshape(len(HEAD), n), np.frombuffer(packed, np.float64, 2 * m, at).reshape(2, m))

    @staticmethod
    def of(deltas: list[Delta]) -> Run:
        heads = [(0, d.first, d.final, NONE if d.previous is None else d.previous, 0, sum(x[0] == "bids" for x in d.levels), len(d.levels)) for d in deltas]
        levels = [x[1:] for d in deltas for side in ("bids", "asks") for x in d.levels if x[0] == side]
        return Run(np.array(heads, np.int64).T.reshape(len(HEAD), -1), np.array(levels, np.float64).reshape(-1, 2).T)

    @staticmethod
    def joined(runs: list[Run]) -> Run:
        return runs[0] if len(runs) == 1 else Run(*(np.concatenate([getattr(r, c) for r in runs], axis=1) for c in ("heads", "levels")))

    def cut(self, a: int, b: int) -> Run:
        return Run(self.heads[:, a:b], self.levels[:, self.start[a] : self.start[b]])

    def take(self, at: np.ndarray) -> Run:
        n = self.n_levels[at]
        levels = np.repeat(self.start[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
        return Run(self.heads[:, at], self.levels[:, levels])

    def changes(self, i: int) -> list[tuple[str, float, float]]:
        n, xs = self.n_bids[i], self.levels[:, self.start[i] : self.start[i + 1]].T.tolist()
        return [("bids" if k < n else "asks", p, q) for k, (p, q) in enumerate(xs)]

    def delta(self, i: int) -> Delta:
        first, final, previous = self.heads[1:4, i].tolist()
        return Delta(first, final, None if previous == NONE else previous, self.changes(i))

    def side(self, side: str, a: int, b: int) -> tuple[np.ndarray, np.ndarray]:
        """Prices and quantities of one side of the events from a to b."""
        lo, hi = self.start[a], self.start[b]
        n = self.n_levels[a:b]
        bids = np.arange(hi - lo) < np.repeat(self.start[a:b] - lo + self.n_bids[a:b], n)
        return tuple(self.levels[:, lo:hi][:, bids if side == "bids" else ~bids])

    def loose(self, futures: bool) -> list[int]:
        """Places of the deltas, but the first, that don't follow the one before them; then the end."""
        before = self.final[:-1]
        follows = self.previous[1:] == before if futures else self.first[1:] <= before + 1
        return [*(np.flatnonzero(~(follows & (self.final[1:] > before))) + 1).tolist(), len(self)]


class Book:
    """One series' book, as the state holds it between batches. Of the deltas that wait, `waiting` has those of this batch,
    n_waiting of them, alone or in runs; before them stand `stored` (their number and last id), which `replay` reads."""

    def __init__(self, futures: bool, most_waiting: int | None, state: str = "syncing", last: int | None = None, levels: dict | None = None, stored: tuple[int, int | None] = (0, None), replay: Callable[[], Iterable[Run]] = tuple):
        self.futures, self.most_waiting = futures, most_waiting
        self.state, self.last, self.levels, self.waiting, self.n_waiting = state, last, levels or {}, [], 0
        self.stored, self.replay = stored, replay
        self.breaks, self.reason = 0, None
        self.best = {side: self._best(side) for side in ("bids", "asks")}

    def _best(self, side: str) -> float | None:
        return (max if side == "bids" else min)((p for s, p in self.levels if s == side), default=None)

    def _follows(self, last: int, d: Delta) -> bool:
        return d.previous == last if self.futures else d.first <= last + 1

    def _break(self, reason: str, waiting: list[Delta]) -> None:
        self.state, self.last, self.reason, self.breaks = "resync", None, reason, self.breaks + 1
        self.levels, self.waiting, self.n_waiting, self.stored = {}, waiting, len(waiting), (0, None)
        self.best = {"bids": None, "asks": None}

    def _apply(self, d: Delta) -> None:
        gone = set()
        for side, price, quantity in d.levels:
            best = self.best[side]
            if quantity > 0:
                self.levels[side, price] = quantity
                if best is None or (price > best if side == "bids" else price < best):
                    self.best[side] = price
            elif self.levels.pop((side, price), None) is not None and price == best:
                gone.add(side)
        for side in gone:
            self.best[side] = self._best(side)
        self.state, self.last = "live", d.final
        self._check()

    def _apply_run(self, run: Run, a: int, b: int) -> int:
        """Deltas a to b of a run, each following the one before it. Returns where it ended: at b, or behind one that broke the
        book. All are taken at once where the book can't be crossed or one-sided between them, else by halves."""
        if b - a <= FEW:
            for i in range(a, b):
                self._apply(run.delta(i))
                if self.state != "live":
                    return i + 1
            return b
        if self._apply_whole(run, a, b):
            return b
        end = self._apply_run(run, a, (a + b) // 2)
        return end if self.state != "live" else self._apply_run(run, end, b)

    def _apply_whole(self, run: Run, a: int, b: int) -> bool:
        """Takes deltas a to b at once, if even the best prices that either side has between them lie apart, and each side
        keeps a level throughout."""
        sides = {side: run.side(side, a, b) for side in ("bids", "asks")}
        bid = max(self.best["bids"], np.max(sides["bids"][0], where=sides["bids"][1] > 0, initial=-np.inf))
        ask = min(self.best["asks"], np.min(sides["asks"][0], where=sides["asks"][1] > 0, initial=np.inf))
        if not bid < ask:
            return False
        for side, (price, quantity) in sides.items():
            gone = set(price[~(quantity > 0)].tolist())
            if self.best[side] in gone and all(p in gone for s, p in self.levels if s == side):
                return False
        for side, (price, quantity) in sides.items():
            prices, at = np.unique(price[::-1], return_index=True)  # the last quantity of each price holds
            for p, q in zip(prices.tolist(), quantity[::-1][at].tolist()):
                if q > 0:
                    self.levels[side, p] = q
                else:
                    self.levels.pop((side, p), None)
            best, put = self.best[side], prices[quantity[::-1][at] > 0]
            if (side, best) not in self.levels:
                self.best[side] = self._best(side)
            elif len(put):
                self.best[side] = max(best, float(put[-1])) if side == "bids" else min(best, float(put[0]))
        self.last = int(run.final[b - 1])
        return True

    def _check(self) -> None:
        bid, ask = self.best["bids"], self.best["asks"]
        if bid is None or ask is None:
            self._break("empty", [])
        elif bid >= ask:
            self._break("crossed", [])

    def snapshot(self, last: int, levels: list[tuple[str, float, float]]) -> None:
        """Installs a snapshot where one is awaited, and replays what waited; a book that is live passes it over."""
        if self.state in ("live", "bridging"):
            return
        waiting = chain(self.replay() if self.stored[0] else (), self.waiting)
        self.waiting, self.n_waiting, self.stored = [], 0, (0, None)
        self.levels = {(s, p): q for s, p, q in levels if q > 0}
        self.best = {side: self._best(side) for side in ("bids", "asks")}
        self.state, self.last = "bridging", last
        self._check()
        for d in waiting:
            self.deltas(d) if isinstance(d, Run) else self.delta(d)

    def end(self) -> int | None:
        """The id of the last delta that waits."""
        return self.stored[1] if not self.waiting else int(self.waiting[-1].final[-1]) if isinstance(self.waiting[-1], Run) else self.waiting[-1].final

    def _wait(self, deltas: Delta | Run, n: int = 1) -> None:
        self.waiting.append(deltas)
        self.n_waiting += n

    def delta(self, d: Delta) -> None:
        if self.state in ("syncing", "resync"):
            end = self.end()
            if end is not None and d.final <= end:
                return
            if end is not None and not self._follows(end, d):
                self._break("gap", [d])
            elif self.most_waiting is not None and self.stored[0] + self.n_waiting >= self.most_waiting:
                self._break("overflow", [d])
            else:
                self._wait(d)
        elif self.state == "bridging":
            if d.final > self.last:
                if d.first <= self.last + 1 or (self.futures and d.previous == self.last):
                    self._apply(d)
                else:
                    self._break("gap", [d])
        elif d.final == self.last:
            if any(self.levels.get((s, p), 0.0) != q for s, p, q in dict(((s, p), (s, p, q)) for s, p, q in d.levels).values()):
                self._break("conflict", [])
        elif d.final > self.last:
            if self._follows(self.last, d):
                self._apply(d)
            else:
                self._break("gap", [d])

    def deltas(self, run: Run) -> None:
        """As delta for each of a run. Each stretch's first is taken alone, those that follow it together."""
        final, loose, i, k = run.final.tolist(), run.loose(self.futures), 0, 0
        while i < len(final):
            waits = self.state in ("syncing", "resync")
            # up to here ids are passed over; a live book looks at repeats of its last one
            passed = self.end() if waits else self.last if self.state == "bridging" else self.last - 1
            while passed is not None and i < len(final) and final[i] <= passed:
                i += 1
            if i == len(final):
                return
            self.delta(run.delta(i))
            i += 1
            while loose[k] < i:
                k += 1
            if self.state == "live" and self.last == final[i - 1]:
                i = self._apply_run(run, i, loose[k])
            elif self.state in ("syncing", "resync") and self.end() == final[i - 1]:
                room = len(final) if self.most_waiting is None else self.most_waiting - self.stored[0] - self.n_waiting
                n = min(loose[k] - i, room)
                if n > 0:
                    self._wait(run.cut(i, i + n), n)
                    i += n

    def events(self, run: Run) -> None:
        at = 0
        for i in [*np.flatnonzero(run.shot).tolist(), len(run)]:
            if i > at:
                self.deltas(run.cut(at, i))
            if i < len(run) and self.state not in ("live", "bridging"):
                self.snapshot(int(run.final[i]), run.changes(i))
            at = i + 1

    def side(self, side: str, depth: int) -> list[dict]:
        found = sorted(((p, q) for (s, p), q in self.levels.items() if s == side), reverse=side == "bids")[:depth]
        return [{"price": p, "quantity": q} for p, q in found]


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each series of a batch, with its events by arrival as a packed run."""
    for batch in batches:
        if not batch.num_rows:
            continue
        column = lambda c: batch.column(batch.schema.get_field_index(c))
        ids = [pc.fill_null(column(c), LATEST if c == "arrival" else NONE).to_numpy(zero_copy_only=False) for c in HEAD]
        levels = [column(c).flatten() for c in ("prices", "quantities")]
        run = Run(np.stack(ids).astype(np.int64, copy=False), np.stack([x.to_numpy(zero_copy_only=False) for x in levels]))
        if (run.final == NONE).any() or ((run.first == NONE) & (run.shot == 0)).any():
            raise ValueError("an event of a book has no id")
        if any(x.null_count for x in levels):
            raise ValueError("a level of a book has no price or no quantity")
        series = np.zeros(batch.num_rows, np.int64)
        for c in SERIES:
            keys = column(c).dictionary_encode()
            series = series * (len(keys.dictionary) + 1) + pc.fill_null(keys.indices, -1).to_numpy(zero_copy_only=False) + 1
        order = np.lexsort((run.arrival, series))
        run, cuts = run.take(order), [0, *(np.flatnonzero(np.diff(series[order])) + 1).tolist(), len(run)]
        first = pa.array(order[cuts[:-1]])
        packed = pa.array([run.cut(a, b).pack() for a, b in zip(cuts, cuts[1:])], pa.binary())
        yield pa.RecordBatch.from_arrays([*(column(c).take(first) for c in SERIES), packed], [*SERIES, "events"])


def _in_order(runs: list[Run]) -> Iterator[Run]:
    """A batch's events by arrival, STEP of them at a time. Each run is in order, so only its part of a step is read."""
    starts = np.unique(np.sort(np.concatenate([r.arrival for r in runs]))[::STEP])
    at = [0] * len(runs)
    for end in [*starts[1:].tolist(), None]:
        parts = []
        for k, run in enumerate(runs):
            to = len(run) if end is None else int(np.searchsorted(run.arrival, end))
            if to > at[k]:
                parts.append(run.cut(at[k], to))
            at[k] = to
        step = Run.joined(parts)
        yield step if len(parts) == 1 else step.take(np.argsort(step.arrival, kind="stable"))


def _pieces(waiting: list[Delta | Run]) -> Iterator[bytes]:
    """What waits, packed in pieces of about PIECE levels."""
    held, size = [], 0
    for many, xs in groupby(waiting, lambda x: isinstance(x, Run)):
        for run in xs if many else [Run.of(list(xs))]:
            for a in range(0, len(run), PIECE // 16):
                held.append(run.cut(a, min(a + PIECE // 16, len(run))))
                size += held[-1].levels.shape[1] + len(held[-1])
                if size >= PIECE:
                    yield Run.joined(held).pack()
                    held, size = [], 0
    if held:
        yield Run.joined(held).pack()


class BookProcessor(StatefulProcessor):
    def __init__(self, futures: bool, depth: int, most_waiting: int | None):
        self.futures, self.depth, self.most_waiting = futures, depth, most_waiting

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.place = handle.getValueState("place", "state string, last bigint, stored bigint, end bigint, pieces int")
        self.levels = handle.getMapState("levels", "side string, price double", "quantity double")
        self.waiting = handle.getMapState("waiting", "piece int", "events binary")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = read_map(self.levels)
        state, last, *stored, pieces = self.place.get() if self.place.exists() else ("syncing", None, 0, None, 0)
        replay = lambda: (Run.unpack(bytes(self.waiting.getValue((i,))[0])) for i in range(pieces))
        book = Book(self.futures, self.most_waiting, state, last, dict(held), tuple(stored), replay)
        for run in _in_order([Run.unpack(x) for f in rows for x in f["events"]]):
            book.events(run)
        write_map(self.levels, held, book.levels)
        if stored[0] and not book.stored[0]:
            self.waiting.clear()
            pieces = 0
        for piece in _pieces(book.waiting):
            self.waiting.updateValue((pieces,), (piece,))
            pieces += 1
        self.place.update((book.state, book.last, book.stored[0] + book.n_waiting, book.end(), pieces))
        out = pd.DataFrame({"last_update_id": pd.array([book.last], "Int64"), "bids": [book.side("bids", self.depth)], "asks": [book.side("asks", self.depth)], "state": [book.state], "needs_resync": [book.state == "resync"], "breaks": [book.breaks], "reason": [book.reason]})
        for i, c in enumerate(SERIES):
            out.insert(i, c, key[i])
        yield out


def stream_book(events: DataFrame, futures: bool = True, depth: int = 1000, most_waiting: int | None = 10_000) -> DataFrame:
    """Each series' book after each batch, in update mode. events: EVENTS, in the order of `arrival`; kind is snapshot (its
    id in final_update_id) or delta. Deltas before a snapshot wait; those already in it go. Futures: a delta's previous id
    is the last final id; spot: its first id is at most one beyond. A gap, a crossed or one-sided book, another content
    under the last id, or more than most_waiting waiting deltas (None: any number) empty the book (state resync, with the
    reason and the number of breaks in the batch); the deltas from a gap on wait for the next snapshot. Repeats and older
    deltas are passed over."""
    none = F.array().cast("array<double>")
    side = lambda s, field: F.coalesce(F.col(s)[field].cast("array<double>"), none)
    both = lambda field: F.concat(side("bids", field), side("asks", field))
    ids = [F.col(c).cast("bigint").alias(c) for c in HEAD[1:5]]
    shot = F.coalesce(F.col("kind") == "snapshot", F.lit(False)).cast("bigint")
    n = [F.size(x).cast("bigint") for x in (side("bids", "price"), both("price"))]
    rows = events.select(*SERIES, shot.alias("shot"), *ids, n[0].alias("n_bids"), n[1].alias("n_levels"), both("price").alias("prices"), both("quantity").alias("quantities"))
    return rows.mapInArrow(_packed, PACKED).groupBy(*SERIES).transformWithStateInPandas(BookProcessor(futures, depth, most_waiting), BOOK, "update", "None")
