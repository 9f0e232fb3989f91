"""SentencePiece encoding by sampling segmentations without replacement, and decoding.

A text's lattice has every way to write it in pieces; a segmentation's weight is exp(temperature * sum of its
pieces' scores). Pieces never run on from a word into the next space, so the lattice is the chain of its words'
lattices, and each distinct word's lattice, with the mass of all completions from each node, is built once.

Gumbel top-k without replacement runs as a best-first search over the lattice: every branch not yet taken has a
perturbed bound, the greatest perturbed log-weight of any segmentation in it, drawn by Gumbel truncation from its
exact mass. The branch with the greatest bound gives the next segmentation. The k results are distinct and drawn as
k samples without replacement; the next bound is the threshold that gives each its inclusion score. All draws are
hashes of the row's key, the sample and the place, so results depend on nothing else. numpy walks all words of a
batch side by side.

Defined cases: a null or empty text has one segmentation without pieces; a text with fewer than k segmentations gives
all it has; rows with equal keys and texts get equal results; a null key counts as 0; characters that no piece has
are their bytes' pieces; other columns are ignored."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, workers

SPACE = "▁"
_UNITS = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
_U = np.uint64
_STEP = 0x9E3779B97F4A7C55  # factor of the substring hashes, odd
DRAW = 8  # options that one number drawn decides
SAMPLES = "doc_id long, sample int, n_pieces long, log_weight double, log_inclusion double, ids_crc32 long, round_trip boolean"


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def units(text: str) -> list[str]:
    """The words of a text with their leading spaces, in the model's spelling."""
    if not text:
        return []
    if "  " in text or text[0] == " " or text[-1] == " " or SPACE in text:
        return _UNITS.findall(SPACE + text.replace(" ", SPACE))
    return [SPACE + part for part in text.split(" ")]


class Lattices:
    """Lattices of words as arrays: node -> its options, longest first (share of mass, its running sum, piece, next
    node). A node is a place in a word; node 0 is the end. All words not met before are built together: pieces are
    found by the hashes of all substrings, and masses from the words' ends, numpy walking all words side by side."""

    def __init__(self, path: str, temperature: float, limit: int = 3 * workers.LIMIT):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.spelled = [b"" if model.is_control(i) else bytes([int(model.id_to_piece(i)[3:5], 16)]) if model.is_byte(i) else model.id_to_piece(i).replace(SPACE, " ").encode() for i in range(n)]
        self.spelled_n = np.fromiter(map(len, self.spelled), np.int64, n)
        self.spelled_at, self.spelled_flat = np.cumsum(self.spelled_n) - self.spelled_n, np.frombuffer(b"".join(self.spelled), np.uint8)
        self.pieces = {model.id_to_piece(i): (i, temperature * model.get_score(i)) for i in range(n) if not (model.is_control(i) or model.is_byte(i) or model.is_unknown(i))}
        self.bytes = {self.spelled[i][0]: i for i in range(n) if model.is_byte(i)}
        self.byte_cost = temperature * min(model.get_score(i) for i in range(n) if not model.is_control(i))
        self.longest = max(map(len, self.pieces))
        self.limit, self.real = limit, n
        by_hash = sorted((self._hash_of(piece), *hit) for piece, hit in self.pieces.items())
        self.hashes, self.ids, self.scores = (np.array(c, t) for c, t in zip(zip(*by_hash), (_U, np.int32, np.float64)))
        self.perhaps = np.zeros(1 << 18, bool)
        self.perhaps[self.hashes >> _U(46)] = True
        self.first = np.zeros(1 << 16, np.int32)
        self.share, self.upto, self.weight = (np.zeros(1 << 16) for _ in range(3))
        self.piece, self.next = np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.clear()

    @staticmethod
    def _hash_of(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h + ord(c) + 1) * _STEP % (1 << 64)
        return h

    def clear(self) -> None:
        self.known = Known()
        self.nodes, self.options = 1, 0  # the arrays stay, and are written anew
        self.spelt: dict[str, int] = {}  # character without a piece -> its number beyond the model's pieces
        self.by_bytes: list[list[int]] = []

    def _spell(self, char: int) -> int:
        c = chr(char)
        if c not in self.spelt:
            self.spelt[c] = self.real + len(self.by_bytes)
            self.by_bytes.append([self.bytes[b] for b in c.encode("utf-8", "surrogatepass")])
        return self.spelt[c]

    def _options(self, chars: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, ...]:
        """(place, length, piece, score) of every piece in the words, by place, the longest first; a character that begins no piece
        is its bytes. left: characters from each place to its word's end."""
        h, plus, got = np.zeros(len(chars), _U), chars + _U(1), []
        for n in range(1, self.longest + 1):
            h = h[: len(chars) - n + 1]
            h += plus[n - 1 :]
            h *= _U(_STEP)
            at = np.flatnonzero(left[: len(h)] >= n)
            if not len(at):
                break
            own = h[at]
            hit = self.perhaps[own >> _U(46)]
            at, own = at[hit], own[hit]
            row = np.minimum(np.searchsorted(self.hashes, own), len(self.hashes) - 1)
            hit = self.hashes[row] == own
            row = row[hit]
            got.append((at[hit], n, self.ids[row], self.scores[row]))
        bare = np.ones(len(chars), bool)
        for g in got:
            bare[g[0]] = False
        if bare.any():
            places = np.flatnonzero(bare)
            chars_, which = np.unique(chars[places], return_inverse=True)
            pieces = np.array([self._spell(int(c)) for c in chars_], np.int32)
            sizes = np.array([len(self.by_bytes[p - self.real]) for p in pieces])
            got.append((places, 1, pieces[which], self.byte_cost * sizes[which]))
        # each option goes to its place's next free row, the longest first
        counts = np.zeros(len(chars), np.int32)
        for g in got:
            counts[g[0]] += 1
        free = np.cumsum(counts) - counts
        out = tuple(np.zeros(int(counts.sum()), t) for t in (np.int64, np.int32, np.int32, np.float64))
        for g in reversed(got):
            row = free[g[0]]
            for column, x in zip(out, g):
                column[row] = x
            free[g[0]] += 1
        return out


    def _build(self, words: list[str]) -> None:
        """Appends the words' nodes, one for each character in turn, and their options."""
        chars = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(_U)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(chars))
        place, length, piece, score = self._options(chars, left)
        end = len(chars)
        to = np.where(length == left[place], end, place + length)
        mass, value = np.zeros(end + 1), np.zeros(len(place))
        left_ = left[place].astype(np.uint16 if sizes.max() < 65536 else np.int64)  # short numbers are sorted in linear time
        by_left = np.argsort(left_, kind="stable")
        cuts = np.concatenate([[0], np.cumsum(np.bincount(left_)[1:])])
        for a, b in zip(cuts[:-1], cuts[1:]):
            own = by_left[a:b]
            node, v = place[own], score[own] + mass[to[own]]
            begin = np.flatnonzero(np.concatenate([[True], node[1:] != node[:-1]]))
            times = np.diff(np.append(begin, b - a))
            top = np.repeat(np.maximum.reduceat(v, begin), times)
            total = top[begin] + np.log(np.add.reduceat(np.exp(v - top), begin))
            mass[node[begin]] = total
            value[own] = v - np.repeat(total, times)
        value = np.minimum(value, 0.0)
        counts = np.bincount(place, minlength=end)
        first = np.cumsum(counts) - counts
        share, upto = np.exp(value), np.zeros(len(place))
        nth, rows, total = 0, np.arange(end), np.zeros(end)
        while len(rows):
            at = first[rows] + nth
            total = total + share[at]
            upto[at] = total
            nth += 1
            more = counts[rows] > nth
            upto[at[~more]] = 2.0
            rows, total = rows[more], total[more]
        value[counts[place] == 1], share[counts[place] == 1] = 0.0, 1.0
        n, m = self.nodes, self.options
        while n + end + 1 > len(self.first):
            self.first = np.resize(self.first, 2 * len(self.first))
        while m + len(place) > len(self.share):
            for name in ("share", "upto", "weight", "piece", "next"):
                setattr(self, name, np.resize(getattr(self, name), 2 * len(self.share) if name == "share" else len(self.share)))
        self.first[n : n + end] = m + first
        self.first[n + end] = m + len(place)
        for name, x in (("share", share), ("upto", upto), ("weight", value), ("piece", piece), ("next", np.where(to == end, 0, n + to))):
            getattr(self, name)[m : m + len(place)] = x
        self.nodes, self.options = n + end, m + len(place)

    def entries(self, words: list[str]) -> np.ndarray:
        """The entry node of each word."""
        if 32 * self.options + 4 * self.nodes + workers.ENTRY * len(self.known) > self.limit:
            self.clear()
        self.known.nodes = self.nodes
        try:  # each distinct word is looked up once
            coded = pa.array(words, pa.string()).dictionary_encode()
            distinct, which = coded.dictionary.to_numpy(zero_copy_only=False), coded.indices.to_numpy()
        except UnicodeEncodeError:  # half of a surrogate pair, which Arrow does not take
            distinct, which = words, np.arange(len(words))
        got = np.fromiter(map(self.known.__getitem__, distinct), np.int64, len(distinct))[which]
        if self.known.fresh:
            self._build(self.known.fresh)
            self.known.fresh = []
        return got

    def siblings(self, option: int) -> range:
        """All options of the node that has this one."""
        node = int(np.searchsorted(self.first[: self.nodes + 1], np.int32(option), "right")) - 1
        return range(self.first[node], self.first[node + 1])

    def ids_of(self, options: np.ndarray) -> np.ndarray:
        """The pieces of these options in turn."""
        ids = self.piece[options]
        if self.by_bytes and len(ids) and ids.max() >= self.real:
            odd = np.flatnonzero(ids >= self.real)
            parts = [self.by_bytes[i - self.real] for i in ids[odd].tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(p) for p in parts]
            at = np.repeat(ids >= self.real, times)
            ids = np.repeat(ids, times)
            ids[at] = np.concatenate(parts)
        return ids


class Known(dict):
    """Word -> its entry node; a word seen first is noted in fresh and gets the next free nodes."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.nodes = 1

    def __missing__(self, word: str) -> int:
        self.fresh.append(word)
        self[word] = at = self.nodes
        self.nodes += len(word)
        return at


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> _U(27))) * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def uniform(key: np.ndarray, purpose: int, place: np.ndarray) -> np.ndarray:
    """Numbers in (0, 1) that key (hashed already), purpose and place alone decide; key and place are unsigned."""
    h = key + place * _U(0x9E3779B97F4A7C15) + _U((purpose + 1) * 0xD1342543DE82EF95 % (1 << 64))
    return ((_mix(h) >> _U(11)).astype(np.float64) + 0.5) * 2.0**-53


def walk(lat: Lattices, nodes: np.ndarray, key: np.ndarray, sample: int, place: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """From each node to its word's end by the mass: (options of all walks in a row, options per walk). A number drawn for a
    walk decides DRAW options in turn, each by the part that the one before it left over."""
    row, at, step, taken = np.arange(len(nodes)), nodes, 0, []
    per_walk = np.zeros(len(nodes), np.int64)
    live = at > 0
    u = np.zeros(len(nodes))
    while True:
        if not live.all():
            row, at, u = row[live], at[live], u[live]
        if not len(row):
            break
        if step % DRAW == 0:
            u = uniform(key[row], (sample << 32) + step, place[row])
        option = lat.first[at].astype(np.int64)
        on = np.flatnonzero(u >= lat.upto[option])
        while len(on):
            option[on] += 1
            on = on[u[on] >= lat.upto[option[on]]]
        share = lat.share[option]
        below = np.where(lat.upto[option] > 1.5, 1.0, lat.upto[option]) - share
        u = np.clip((u - below) / share, 0.0, 1.0 - 2.0**-53)
        taken.append((row, option))
        per_walk[row] += 1
        at = lat.next[option].astype(np.int64)
        live, step = at > 0, step + 1
    begin = np.cumsum(per_walk) - per_walk
    out = np.zeros(int(per_walk.sum()), np.int64)
    for n, (row, option) in enumerate(taken):
        out[begin[row] + n] = option
    return out, per_walk


def _bound(mass: np.ndarray, limit: float, u: np.ndarray) -> np.ndarray:
    """Gumbel variables of these log-masses, given that they are below limit."""
    with np.errstate(all="ignore"):
        return np.where(np.isneginf(mass), -np.inf, mass - np.log(np.exp(np.minimum(mass - limit, 700.0)) - np.log(u)))


class Found:
    """A segmentation: its options, the word each is in, and the bounds of the branches that leave it. `places` are its
    decisions with another option, from the one after `since`: earlier branches belong to its parent."""

    def __init__(self, lat: Lattices, path: np.ndarray, word: np.ndarray, value: float, key: np.ndarray, sample: int, since: int):
        self.path, self.word, self.value = path, word, value
        weight = lat.weight[path]
        upto = np.cumsum(weight)
        self.log_weight = float(upto[-1]) if len(path) else 0.0
        self.places = since + 1 + np.flatnonzero(weight[since + 1 :] < 0.0)
        own = weight[self.places]
        self.before = upto[self.places] - own
        with np.errstate(divide="ignore"):
            mass = self.before + np.log(-np.expm1(own))
        self.bound = _bound(mass, value, uniform(key, (1 << 60) + sample, self.places.astype(_U)))
        self.gone: dict[int, list[int]] = {}

    def top(self) -> float:
        return float(self.bound.max()) if len(self.bound) else -np.inf


def sample_texts(lat: Lattices, keys: list[int], texts: list[str | None], k: int) -> list[list[tuple[np.ndarray, float, float]]]:
    """Per text up to k distinct segmentations: (pieces, log-weight, log of the inclusion probability), best bound first."""
    split = [units(t or "") for t in texts]
    counts = np.array([len(s) for s in split], np.int64)
    entry = lat.entries([w for s in split for w in s])
    begin = np.concatenate([[0], np.cumsum(counts)])
    key = _mix(np.array(keys, np.int64).view(_U) + _U(_STEP))
    row_key = np.repeat(key, counts)
    place = (np.arange(len(entry)) - np.repeat(begin[:-1], counts)).astype(_U)
    options, per_word = walk(lat, entry, row_key, 0, place)
    ends = np.concatenate([[0], np.cumsum(per_word)])
    words = np.repeat(place.astype(np.int64), per_word)
    top = -np.log(-np.log(uniform(key, 1 << 61, np.zeros(len(key), _U))))
    found = []
    for i in range(len(texts)):
        a, b = ends[begin[i]], ends[begin[i + 1]]
        found.append([Found(lat, options[a:b], words[a:b], float(top[i]), key[i], 0, -1)])
    for sample in range(1, k):
        jobs = []
        for i, paths in enumerate(found):
            if len(paths) != sample:
                continue
            parent = max(paths, key=Found.top)
            value = parent.top()
            if np.isneginf(value):
                continue
            n = int(parent.bound.argmax())
            d = int(parent.places[n])
            taken = parent.gone.setdefault(d, [int(parent.path[d])])
            free = [o for o in lat.siblings(taken[0]) if o not in taken]
            where = np.array([d], _U)
            upto = np.cumsum(lat.share[free])
            u = float(uniform(key[i], (2 << 60) + sample, where)[0])
            option = free[min(int(np.searchsorted(upto, u * upto[-1], "right")), len(free) - 1)]
            taken.append(option)
            free.remove(option)
            with np.errstate(divide="ignore"):
                mass = parent.before[n] + np.log(lat.share[free].sum()) if free else -np.inf
            parent.bound[n] = _bound(np.array([mass]), value, uniform(key[i], (3 << 60) + sample, where))[0]
            jobs.append((i, parent, d, option, value))
        if not jobs:
            break
        starts, job_key, job_place, sizes = [], [], [], []
        for i, parent, d, option, _ in jobs:
            w = int(parent.word[d])
            later = entry[begin[i] + w + 1 : begin[i + 1]]
            starts += [lat.next[option : option + 1], later]
            sizes.append(1 + len(later))
            job_place.append(np.arange(w, w + sizes[-1]))
            job_key.append(np.full(sizes[-1], key[i]))
        options, per_word = walk(lat, np.concatenate(starts).astype(np.int64), np.concatenate(job_key), sample, np.concatenate(job_place).astype(_U))
        ends, at = np.concatenate([[0], np.cumsum(per_word)]), 0
        for (i, parent, d, option, value), size, places in zip(jobs, sizes, job_place):
            a, b = ends[at], ends[at + size]
            path = np.concatenate([parent.path[:d], [option], options[a:b]])
            word = np.concatenate([parent.word[: d + 1], np.repeat(places, per_word[at : at + size])])
            found[i].append(Found(lat, path, word, value, key[i], sample, d))
            at += size
    out = []
    for paths in found:
        rest = max(f.top() for f in paths)
        rows = []
        for f in paths:
            x = f.log_weight - rest
            log_in = 0.0 if np.isneginf(rest) or x > 30 else x if x < -30 else float(np.log(-np.expm1(-np.exp(x))))
            rows.append((lat.ids_of(f.path), f.log_weight, log_in))
        out.append(rows)
    return out


def decode_pieces(lat: Lattices, ids: np.ndarray) -> bytes:
    """The text's bytes: the pieces in turn, without the first space, which encoding adds."""
    n = lat.spelled_n[ids]
    upto = np.cumsum(n)
    data = lat.spelled_flat[np.repeat(lat.spelled_at[ids] - upto + n, n) + np.arange(upto[-1])].tobytes() if len(ids) else b""
    return data[1:] if data[:1] == b" " else data


def lattices(path: str, temperature: float) -> Lattices:
    return workers.hold("segmentation", (path, temperature), lambda: Lattices(path, temperature))


def sampled_segmentations(docs: DataFrame, k: int = 2, temperature: float = 0.001, model: str | None = None, with_ids: bool = False) -> DataFrame:
    """k rows per document: sample, n_pieces, log_weight, log_inclusion, ids_crc32 and whether decoding gives the text
    back; with_ids adds the ids."""
    path = model or model_path()
    kinds = [("doc_id", pa.int64()), ("sample", pa.int32()), ("n_pieces", pa.int64()), ("log_weight", pa.float64()), ("log_inclusion", pa.float64()), ("ids_crc32", pa.int64()), ("round_trip", pa.bool_()), *([("ids", pa.list_(pa.int32()))] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path, temperature)
        for batch in common.slices(batches, 1):
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = []
            for doc_id, text, got in zip(ids, texts, sample_texts(lat, [x or 0 for x in ids], texts, k)):
                whole = (text or "").encode("utf-8", "surrogatepass")
                for s, (pieces, weight, inclusion) in enumerate(got):
                    rows.append((doc_id, s, len(pieces), weight, inclusion, zlib.crc32(pieces.astype("<u4").tobytes()), decode_pieces(lat, pieces) == whole, *([pieces] if with_ids else [])))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(zip(*rows), kinds)], [name for name, _ in kinds])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return rows.mapInArrow(run, SAMPLES + (", ids array<int>" if with_ids else ""))


def decode(table: DataFrame, ids_col: str = "ids", model: str | None = None) -> DataFrame:
    """table with `text`, decoded from its ids; null ids give null."""
    path = model or model_path()
    names = table.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(path, 0.001)
        for batch in batches:
            texts = [None if x is None else decode_pieces(lat, np.array(x, np.int64)).decode("utf-8", "replace") for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*names, "text"])

    return table.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields), "text string"]))
