"""Adaptive context-mixing range coder for token ids.

A stream of ids is a segment: a head with two tables, and blocks that are coded each on its own from a fresh state.
Three orders predict the next id. Order 0 is the head's table of the segment's ids and their frequencies; order 1 the
head's table of what follows each id; order 2 the id that last followed the two ids before it in this block. They are mixed by
the block's own record of what came true: how often order 2's guess has been right of late in its slot, whether it is what order
1 holds likeliest, and how sure order 1 is make a state, and what ids came to in that state before, in this block, sets the
shares of the range that order 2's guess, order 1 and order 0 get. An id takes its interval in the highest order that
predicts it.

A block runs in LANES lanes, each a stretch of its ids with a range of its own, which learn together: at a step each
lane codes one id, then the block's slots take what came; its shares follow after steps 1, 2, 4, 8, 16 and each 16 more. Blocks do
not depend on each other, so numpy codes all lanes of a group of blocks side by side. All numbers are whole and below 2**53, and
held as doubles where they are divided. The range is kept from 2**32 to 2**48, with output words of 16 bits.

Segment: magic, version, block length, ids, blocks, bytes of the head, its crc32 (little-endian); the head; then per block its
ids, payload bytes and the crc32 of its ids; then the payloads: the words in each lane, then the lanes' words."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np

MAGIC, VERSION = b"TBTK", 3
HEAD = struct.Struct("<4sHIQIII")
LANES, GROUP = 16, 256  # lanes of a block, a power of two, and blocks that are coded side by side
SLOTS = 4096  # a power of two
LEAST = 3  # a pair of ids met less often is left to order 0
STATES, LEVELS = 40, 4  # a slot's level is 0 while empty, then 1 to LEVELS
SHARES = 1024
FIRST = np.array([1, 2, 1])  # what a state starts with: ids by order 2, 1 and 0
FLOOR, WORD, MOST = float(1 << 32), float(1 << 16), float(1 << 22)
NEXT = np.minimum(1 + np.arange(8), LEVELS)  # a slot's level after it was right; it is 1 after it was wrong


def _power(x: np.ndarray | int) -> np.ndarray:
    """The exponent of the least power of two that is not below x."""
    return np.ceil(np.log2(np.maximum(1, x))).astype(np.int64)


def _scaled(counts: np.ndarray, sizes: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Each row's counts as frequencies of at least 1 that add up to its power of two; what is left over goes to its likeliest."""
    sizes, bits = sizes[sizes > 0], bits[sizes > 0]
    first = np.cumsum(sizes) - sizes
    whole = np.add.reduceat(counts, first)
    freq = 1 + counts * np.repeat((1 << bits) - sizes, sizes) // np.repeat(whole, sizes)
    freq[_likeliest(counts, sizes)] += (1 << bits) - np.add.reduceat(freq, first)
    return freq


def _likeliest(counts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The place of each row's first greatest count; no row is empty."""
    first = np.cumsum(sizes) - sizes
    at = np.flatnonzero(counts == np.repeat(np.maximum.reduceat(counts, first), sizes))
    return at[np.searchsorted(at, first)]


def _sorted(keys: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The keys, all below most, in ascending order, and their places; equal keys stay in order."""
    bits = len(keys).bit_length()
    if most.bit_length() + bits > 63:
        order = np.argsort(keys, kind="stable")
        return keys[order], order
    both = keys << bits
    both |= np.arange(len(keys))
    both.sort()
    return both >> bits, both & ((1 << bits) - 1)


class Tables:
    """Orders 0 and 1 of a segment, on the ids' ranks. A row of order 1 is what follows one id. Each row's frequencies add up
    to a power of two, and row `d` is order 0."""

    def __init__(self, values: np.ndarray, freq0: np.ndarray, sizes: np.ndarray, to: np.ndarray, freq1: np.ndarray):
        self.values, self.freq0, self.sizes, self.to, self.freq1 = values, freq0, sizes, to, freq1
        self.d = d = len(values)
        self.row_sizes = np.append(sizes, d)
        self.bits = self._bits(self.row_sizes)
        self.freq = np.concatenate([freq1, freq0])
        self.rank = np.concatenate([to, np.arange(d)])
        ends = np.cumsum(self.row_sizes)
        upto = np.concatenate([[0], np.cumsum(self.freq)])
        self.start = upto[:-1] - np.repeat(upto[ends - self.row_sizes], self.row_sizes)
        # what a state takes from order 1: its likeliest id, and how sure it is
        self.likeliest = np.zeros(d + 2, np.int64)
        filled = np.flatnonzero(sizes)
        if len(filled):
            top = _likeliest(freq1, sizes[filled])
            sure = 1 + np.minimum(2, 4 * freq1[top] >> self.bits[filled])
            self.likeliest[filled] = to[top] << 2 | sure

    @staticmethod
    def _bits(sizes: np.ndarray) -> np.ndarray:
        """Bits of each row's sum: four to eight times its size and at least 64, or for order 0 2**16, and no less than twice its size."""
        bits = np.maximum(6, _power(sizes) + 2)
        bits[-1] = max(16, _power(sizes[-1]) + 1)
        return bits

    @classmethod
    def of(cls, ranks: np.ndarray, before: np.ndarray, values: np.ndarray) -> tuple[Tables, np.ndarray]:
        """The tables of a segment, and each id's place in order 1 (-1 where it is not there)."""
        d = len(values)
        keys = before.astype(np.int64)
        keys *= d
        keys += ranks
        pairs, order = _sorted(keys, d * d)
        del keys
        first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]]))
        times = np.diff(first, append=len(pairs))
        kept = times >= LEAST
        at = np.empty(len(ranks), np.int32)
        at[order] = np.repeat(np.where(kept, np.cumsum(kept) - 1, -1).astype(np.int32), times)
        pairs, times = pairs[first[kept]], times[kept]
        sizes = np.bincount(pairs // d, minlength=d)
        bits = cls._bits(np.append(sizes, d))
        freq0 = _scaled(np.bincount(ranks, minlength=d), np.array([d]), bits[-1:])
        freq1 = _scaled(times, sizes, bits[:-1]) if len(times) else times
        return cls(values, freq0, sizes, pairs % d, freq1), at

    def pack(self) -> bytes:
        """Differences of ids and of followers, and the frequencies, each as bytes by weight."""
        step = np.diff(self.to, prepend=0)
        first = (np.cumsum(self.sizes) - self.sizes)[self.sizes > 0]
        step[first] = self.to[first]
        columns = (np.diff(self.values, prepend=0), self.freq0, self.sizes, step, self.freq1)
        planes = b"".join(np.ascontiguousarray(c.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes() for c in columns)
        return struct.pack("<II", len(self.values), len(self.to)) + zlib.compress(planes, 6)

    @classmethod
    def unpack(cls, data: bytes) -> Tables:
        d, n = struct.unpack_from("<II", data)
        planes = np.frombuffer(zlib.decompress(data[8:]), np.uint8)
        columns, at = [], 0
        for size in (d, d, d, n, n):
            columns.append(np.ascontiguousarray(planes[at : at + 4 * size].reshape(4, size).T).view("<u4").ravel().astype(np.int64))
            at += 4 * size
        values, freq0, sizes, step, freq1 = columns
        upto = np.cumsum(step)
        first = np.cumsum(sizes) - sizes
        begin = np.where(sizes > 0, (upto - step)[np.minimum(first, max(0, n - 1))], 0) if n else np.zeros(d, np.int64)
        return cls(np.cumsum(values), freq0, sizes, upto - np.repeat(begin, sizes), freq1)


def _steps(n: int) -> int:
    return -(-n // LANES)


class Lookup:
    """The tables as they are asked for: each entry's interval, and, to read, each row's scale and first value and the
    entry at each value. A last row and entry are the whole of order 2's guess."""

    def __init__(self, tables: Tables, read: bool):
        scale = np.exp2(-tables.bits.astype(float))
        self.start = np.append(tables.start, 0).astype(float)
        self.freq = np.append(tables.freq, 1).astype(float)
        if not read:
            self.scale_of = np.append(np.repeat(scale, tables.row_sizes), 1.0)
            return
        self.scale = np.append(scale, 1.0)
        whole = np.where(tables.row_sizes > 0, 1 << tables.bits, 0)
        self.base = np.append(np.cumsum(whole) - whole, whole.sum())
        self.entry = np.repeat(np.arange(len(self.freq)), self.freq.astype(np.int64))
        self.rank = np.append(tables.rank, tables.d)


class Record:
    """What the blocks of a group have seen so far: order 2's slots, and what ids came to in each state."""

    def __init__(self, tables: Tables, blocks: int):
        lanes = blocks * LANES
        of_block = np.arange(lanes) // LANES
        self.likeliest = tables.likeliest
        self.slots = np.full(blocks * SLOTS, tables.d << 3, np.int32)
        self.slot_base, self.state_base = of_block * SLOTS, of_block * STATES
        self.one, self.two = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
        self.counts = np.tile(FIRST, blocks * STATES)
        self.seen, self.since, self.step = np.zeros((16, lanes), np.int64), 0, 0

    def _learn(self) -> None:
        """The ends of order 2's and order 1's shares in each state, from what came. None of the three shares is 0."""
        self.counts += np.bincount(self.seen[: self.since, : len(self.one)].ravel(), minlength=len(self.counts))
        counts = self.counts.reshape(-1, 3)
        whole = counts.sum(axis=1)
        end2 = 1 + counts[:, 0] * (SHARES - 3) // whole
        self.end2, self.end1 = end2.astype(float), (end2 + 1 + counts[:, 1] * (SHARES - 3) // whole).astype(float)
        self.since = 0

    def predict(self, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Order 2's guess, and the ends of its and order 1's shares, in the first n lanes."""
        if self.step in (0, 1, 2, 4, 8) or self.step % 16 == 0:
            self._learn()
        self.one, self.two = self.one[:n], self.two[:n]
        self.slot = self.one * 40503
        self.slot += self.two * 60493
        self.slot >>= 4
        self.slot &= SLOTS - 1
        self.slot += self.slot_base[:n]
        read, top = self.slots.take(self.slot, mode="clip").astype(np.int64), self.likeliest.take(self.one, mode="clip")
        self.level, guess = read & 7, read >> 3
        self.state = self.level << 3
        self.state += self.state_base[:n]
        self.state += top & 3
        top >>= 2
        np.add(self.state, 4, out=self.state, where=guess == top)
        return guess, self.end2.take(self.state, mode="clip"), self.end1.take(self.state, mode="clip")

    def update(self, ranks: np.ndarray, hit: np.ndarray, known: np.ndarray) -> None:
        """hit: order 2 was right; known: it or order 1 was. Where lanes share a slot, the last one's id stays."""
        self.level *= hit
        self.slots[self.slot] = ranks << 3 | NEXT.take(self.level, mode="clip")
        self.state *= 3
        self.state += 2
        self.state -= known
        self.state -= hit
        self.seen[self.since, : len(ranks)] = self.state
        self.since += 1
        self.step += 1
        self.two, self.one = self.one, ranks


def _interval(part: np.ndarray, lo: np.ndarray, up: np.ndarray, hit: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin and size of each lane's share, for order 2's end lo and order 1's end up."""
    begin, end = np.where(known, lo, up), np.where(known, up, part * SHARES)
    np.copyto(end, lo, where=hit)
    np.copyto(begin, 0.0, where=hit)
    end -= begin
    return begin, end


def _groups(n: int, block: int) -> Iterator[tuple[int, int, int]]:
    """(first block, blocks, steps of the last of them) of each group."""
    blocks = -(-n // block)
    for first in range(0, blocks, GROUP):
        size = min(GROUP, blocks - first)
        yield first, size, _steps(min(block, n - block * (first + size - 1)))


def _laid_out(ids: np.ndarray, block: int) -> np.ndarray:
    """The ids with each block filled up to a whole number of steps by the least rank."""
    n, steps = len(ids), _steps(block)
    full = n // block
    rows = np.zeros((full, steps * LANES), np.int32)
    rows[:, :block] = ids[: full * block].reshape(full, block)
    rest = np.zeros(_steps(n - full * block) * LANES, np.int32)
    rest[: n - full * block] = ids[full * block :]
    return np.concatenate([rows.ravel(), rest])


def _by_step(x: np.ndarray, blocks: int, steps: int, last: int) -> np.ndarray:
    """steps x lanes: what each lane of a group has at each step. The last block's lanes may be shorter."""
    grid = np.zeros((steps, blocks * LANES), x.dtype)
    full = blocks if last == steps else blocks - 1
    grid[:, : full * LANES] = x[: full * LANES * steps].reshape(-1, steps).T
    if full < blocks:
        grid[:last, full * LANES :] = x[full * LANES * steps :].reshape(LANES, last).T
    return grid


def _encode_group(tables: Tables, lookup: Lookup, ranks: np.ndarray, entry: np.ndarray, last: int) -> list[bytes]:
    """The payload of each block, from steps x lanes of ranks and their entries in the tables."""
    steps, lanes = ranks.shape
    blocks, most = lanes // LANES, 3 * steps + 2
    record = Record(tables, blocks)
    low, rng = np.zeros(lanes), np.full(lanes, float(1 << 48))
    out, pos = np.zeros(lanes * most, np.uint32), np.arange(lanes) * most
    for t in range(steps if blocks > 1 else last):
        n = lanes if t < last else lanes - LANES
        lo, ra, x, e = low[:n], rng[:n], ranks[t, :n].astype(np.int64), entry[t, :n].astype(np.int64)
        guess, end2, end1 = record.predict(n)
        hit = guess == x
        known = e < len(tables.to)
        known |= hit
        part = np.floor(ra * (1 / SHARES))
        begin, size = _interval(part, part * end2, part * end1, hit, known)
        lo += begin
        np.copyto(e, len(tables.freq), where=hit)
        size *= lookup.scale_of.take(e, mode="clip")
        np.floor(size, out=size)
        lo += size * lookup.start.take(e, mode="clip")
        np.multiply(size, lookup.freq.take(e, mode="clip"), out=ra)
        w = np.flatnonzero(ra < FLOOR)
        while len(w):
            lw = lo[w]
            word = np.floor(lw * (1 / FLOOR))
            p = pos[w]
            out[p] = word
            pos[w] = p + 1
            lo[w] = (lw - word * FLOOR) * WORD
            rw = ra[w] * WORD
            ra[w] = rw
            w = w[rw < FLOOR]
        record.update(x, hit, known)
    out[pos] = np.ceil(low * (1 / FLOOR))
    size = pos + 1 - np.arange(lanes) * most
    ends = np.cumsum(size)
    words = out[np.repeat(np.arange(lanes) * most - ends + size, size) + np.arange(ends[-1])]
    carry = np.flatnonzero(words >> 16)
    while len(carry):
        words[carry] &= 0xFFFF
        words[carry - 1] += 1
        carry = (carry - 1)[words[carry - 1] > 0xFFFF]
    words = words.astype("<u2")
    sizes = size.astype(_size_type(steps)).reshape(blocks, LANES)
    ends = np.concatenate([[0], ends[LANES - 1 :: LANES]])
    return [sizes[i].tobytes() + words[ends[i] : ends[i + 1]].tobytes() for i in range(blocks)]


def _size_type(steps: int) -> str:
    return "<u2" if 3 * steps + 2 < 1 << 16 else "<u4"


def compress(ids: np.ndarray, block: int = 8192) -> bytes:
    """A segment that holds ids (whole numbers below 2**20: no vocabulary is larger); ValueError otherwise."""
    ids = np.ascontiguousarray(ids, np.uint32)
    n = len(ids)
    if not n:
        return HEAD.pack(MAGIC, VERSION, block, 0, 0, 0, 0)
    if int(ids.max()) >= 1 << 20:
        raise ValueError("an id is out of range")
    seen = np.bincount(ids)
    values = np.flatnonzero(seen)
    ranks = _laid_out((np.cumsum(seen > 0) - 1).astype(np.int32)[ids], block)
    steps = _steps(block)
    before = np.zeros_like(ranks)
    before[1:] = ranks[:-1]
    full = n // block * steps * LANES
    before[:full:steps] = 0  # a lane begins as if after the least id
    if full < len(ranks):
        before[full :: _steps(n % block)] = 0
    tables, at = Tables.of(ranks, before, values)
    del before
    entry = np.where(at < 0, ranks + np.int32(len(tables.to)), at)
    del at
    lookup = Lookup(tables, read=False)
    payloads: list[bytes] = []
    for first, blocks, last in _groups(n, block):
        own = slice(first * steps * LANES, ((first + blocks - 1) * steps + last) * LANES)
        payloads += _encode_group(tables, lookup, _by_step(ranks[own], blocks, steps, last), _by_step(entry[own], blocks, steps, last), last)
    table = []
    for i, payload in enumerate(payloads):
        own_ids = ids[i * block : (i + 1) * block]
        table.append((len(own_ids), len(payload), zlib.crc32(own_ids)))
    head = tables.pack()
    return HEAD.pack(MAGIC, VERSION, block, n, len(payloads), len(head), zlib.crc32(head)) + head + np.array(table, "<u4").tobytes() + b"".join(payloads)


def _decode_group(tables: Tables, lookup: Lookup, words: np.ndarray, pos: np.ndarray, steps: int, last: int) -> np.ndarray:
    """steps x lanes of ranks, from the words and where each lane's begin."""
    lanes, d = len(pos), tables.d
    blocks = lanes // LANES
    record = Record(tables, blocks)
    code, rng = np.zeros(lanes), np.full(lanes, float(1 << 48))
    for k in range(3):
        code = code * WORD + words.take(pos + k)
    pos = pos + 3
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps if blocks > 1 else last):
        n = lanes if t < last else lanes - LANES
        co, ra = code[:n], rng[:n]
        guess, end2, end1 = record.predict(n)
        part = np.floor(ra * (1 / SHARES))
        lo, up = part * end2, part * end1
        hit, known = co < lo, co < up
        row = np.where(known, record.one, d)
        np.copyto(row, d + 1, where=hit)
        begin, size = _interval(part, lo, up, hit, known)
        co -= begin
        size *= lookup.scale.take(row, mode="clip")
        np.floor(size, out=size)
        value = np.minimum(co / size, MOST).astype(np.int64)
        value += lookup.base.take(row, mode="clip")
        e = lookup.entry.take(value, mode="clip")
        co -= size * lookup.start.take(e, mode="clip")
        np.multiply(size, lookup.freq.take(e, mode="clip"), out=ra)
        x = lookup.rank.take(e, mode="clip")
        np.copyto(x, guess, where=hit)
        w = np.flatnonzero(ra < FLOOR)
        while len(w):
            p = pos[w]
            co[w] = co[w] * WORD + words.take(p, mode="clip")
            pos[w] = p + 1
            rw = ra[w] * WORD
            ra[w] = rw
            w = w[rw < FLOOR]
        grid[t, :n] = x
        record.update(x, hit, known)
    return grid


def decompress(data: bytes) -> np.ndarray:
    """The ids of a segment; raises ValueError where a block's checksum does not hold."""
    magic, version, block, n, blocks, head, check = HEAD.unpack_from(data)
    if (magic, version) != (MAGIC, VERSION):
        raise ValueError("not a segment of token ids")
    if not n:
        return np.zeros(0, np.uint32)
    at = HEAD.size + head
    table = np.frombuffer(data, "<u4", 3 * blocks, at).reshape(blocks, 3).astype(np.int64)
    at += 12 * blocks
    if at + int(table[:, 1].sum()) != len(data) or int(table[:, 0].sum()) != n:
        raise ValueError("a segment of token ids is cut off")
    if zlib.crc32(data[HEAD.size : HEAD.size + head]) != check:
        raise ValueError("the head of a segment is damaged")
    tables = Tables.unpack(data[HEAD.size : HEAD.size + head])
    lookup = Lookup(tables, read=True)
    values = np.concatenate([tables.values, [0, 0]]).astype(np.uint32)
    steps = _steps(block)
    kind = np.dtype(_size_type(steps))
    ids = np.empty(n, np.uint32)
    for first, size, last in _groups(n, block):
        ends = at + np.cumsum(table[first : first + size, 1])
        sizes = np.stack([np.frombuffer(data, kind, LANES, end - own) for end, own in zip(ends, table[first : first + size, 1])]).astype(np.int64)
        if (2 * sizes.sum(axis=1) + LANES * kind.itemsize != table[first : first + size, 1]).any():
            raise ValueError("the lanes of a block do not fill it: damaged, or fails its checksum")
        # each lane's words with three of nothing behind them, as a lane's last bits are left out
        sizes = sizes.ravel()
        begins = np.cumsum(sizes + 3) - sizes - 3
        words = np.zeros(int(begins[-1] + sizes[-1] + 3), np.uint16)
        flat = np.concatenate([np.frombuffer(data, "<u2", (own - LANES * kind.itemsize) // 2, end - own + LANES * kind.itemsize) for end, own in zip(ends, table[first : first + size, 1])])
        words[np.repeat(begins - np.cumsum(sizes) + sizes, sizes) + np.arange(len(flat))] = flat
        at = int(ends[-1])
        with np.errstate(all="ignore"):  # what is damaged may run out of bounds before its checksum fails
            grid = _decode_group(tables, lookup, words, begins, steps, last)
        for i in range(size):
            own_ids = ids[(first + i) * block : (first + i + 1) * block]
            own_steps = last if i == size - 1 else steps
            ranks = grid[:own_steps, i * LANES : (i + 1) * LANES].T.ravel()[: len(own_ids)]
            own_ids[:] = values.take(ranks, mode="clip")
            if zlib.crc32(own_ids) != table[first + i, 2]:
                raise ValueError(f"block {first + i} of a segment fails its checksum")
    return ids
