"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once.

The byte-level tokenizer always ends a word before a single space that stands between two characters that are
not white space, and takes a single newline there as a word of its own. So a text may be cut there: its ids are
the ids of its parts in turn. It also ends a run of letters before the signs that follow it, and signs up to a part's
end are one word, so a part of letters and signs is two keys. Arrow finds the distinct parts of a batch, and so only
these are looked up, and only keys not met before are encoded."""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from . import workers

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
_CUT = re.compile(r"(?<=\S) (?=\S)")
_WHITE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"  # str.isspace
_ODD = f"^{_WHITE}|{_WHITE}$|{_WHITE}{_WHITE}"
_SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
_LETTERS = "[A-Za-zÀ-ÖØ-öø-ɏ]+"  # all of them letters to every version of Unicode
_AFTER = f"^{_LETTERS}(?P<signs>.*)$"
#: Keys encoded in one call, as each call has a cost.
JOINT = 500
#: Rows of a batch to encode: the more, the more of its parts repeat.
ROWS = 1280


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Keys(dict):
    """Key -> its row in the table of ids; a key seen first is noted for encoding. Row 0 is the empty key's."""

    def __init__(self):
        super().__init__({"": 0})
        self.fresh: list[str] = []

    def __missing__(self, key: str) -> int:
        self[key] = row = len(self)
        self.fresh.append(key)
        return row


def _gather(flat: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """flat[at : at + n] of each place, in a row."""
    upto = np.cumsum(n)
    return flat[np.repeat(at - upto + n, n) + np.arange(upto[-1])] if len(n) else flat[:0]


class Encoder:
    """limit: bytes of the table of keys, by its own count, before it starts anew."""

    def __init__(self, path: str, limit: int = workers.LIMIT):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.limit = limit
        self.newline = self.tokenizer.encode("\n", add_special_tokens=False).ids[0]
        # for runs of letters, each of which is one word already: the same model, on bytes in its own spelling
        before = self.tokenizer.pre_tokenizer
        self.letters = Tokenizer(self.tokenizer.model)
        self.letters.pre_tokenizer = pre_tokenizers.CharDelimiterSplit("\n")
        self.by_letters = isinstance(before, pre_tokenizers.ByteLevel) and before.use_regex and not before.add_prefix_space and self.tokenizer.normalizer is None
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.bytes = np.zeros(max(vocab.values()) + 1, np.int64)
        self.bytes[list(vocab.values())] = list(map(len, vocab))
        own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b]
        self.spelling = np.zeros(256, "<u4")
        self.spelling[own] = own
        self.spelling[[b for b in range(256) if b not in set(own)]] = np.arange(256, 512 - len(own))
        self.spelling[ord("\n")] = ord("\n")
        self._clear()

    def _clear(self) -> None:
        self.keys = Keys()
        self.rows, self.used, self.chars = 1, 0, 0
        self.at, self.n = np.zeros(1024, np.int64), np.zeros(1024, np.int64)
        self.flat = np.zeros(4096, np.uint32)

    def _encode_letters(self, keys: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the keys in a row, ids per key). The bytes that the ids stand for show where each key ends."""
        joint = ["\n".join(keys[i : i + JOINT]).encode() for i in range(0, len(keys), JOINT)]
        texts = [self.spelling[np.frombuffer(x, np.uint8)].tobytes().decode("utf-32-le") for x in joint]
        ids = np.concatenate([np.array(e.ids, np.uint32) for e in self.letters.encode_batch_fast(texts, add_special_tokens=False)])
        ends = np.cumsum(pc.binary_length(pa.array(keys, pa.string())).to_numpy(), dtype=np.int64)
        upto = np.cumsum(self.bytes[ids])
        last = np.searchsorted(upto, ends)
        if upto[-1] != ends[-1] or (upto[last] != ends).any():
            raise ValueError("an id runs on from one key into the next")
        return ids, np.diff(last + 1, prepend=0)

    def _encode_others(self, keys: list[str]) -> list[np.ndarray]:
        """Keys without inner white space go many to a text, a newline between them; the newline's id shows where they end."""
        plain = [len(x.split()) == 1 and not x[-1].isspace() and (x[0] == " " or not x[0].isspace()) and not x[1:2].isspace() for x in keys]
        joint = [x for x, ok in zip(keys, plain) if ok]
        texts = ["\n".join(joint[i : i + JOINT]) for i in range(0, len(joint), JOINT)]
        pieces: list[np.ndarray] = []
        for i, e in enumerate(self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            part = np.split(ids, np.flatnonzero(ids == self.newline))
            if len(part) != len(joint[JOINT * i : JOINT * i + JOINT]):
                raise ValueError("a newline's id came from inside a key")
            pieces += [part[0], *(p[1:] for p in part[1:])]
        kept = iter(pieces)
        odd = iter(self.tokenizer.encode_batch_fast([x for x, ok in zip(keys, plain) if not ok], add_special_tokens=False))
        return [next(kept) if ok else np.array(next(odd).ids, np.uint32) for ok in plain]

    def _append(self, rows: np.ndarray, ids: np.ndarray, n: np.ndarray) -> None:
        while self.used + len(ids) > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.n[rows] = n
        self.at[rows] = self.used + np.cumsum(n) - n
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _add(self) -> None:
        """Encodes the keys noted and appends them to the table."""
        fresh, self.keys.fresh = self.keys.fresh, []
        rows = self.rows + np.arange(len(fresh))
        self.rows += len(fresh)
        while self.rows > len(self.n):
            self.at, self.n = np.resize(self.at, 2 * len(self.at)), np.resize(self.n, 2 * len(self.n))
        letters = pc.match_substring_regex(pa.array(fresh, pa.string()), f"^ ?{_LETTERS}$").to_numpy(zero_copy_only=False) & self.by_letters
        if letters.any():
            self._append(rows[letters], *self._encode_letters([x for x, ok in zip(fresh, letters.tolist()) if ok]))
        if not letters.all():
            got = self._encode_others([x for x, ok in zip(fresh, letters.tolist()) if not ok])
            self._append(rows[~letters], np.concatenate(got), np.fromiter(map(len, got), np.int64, len(got)))
        self.chars += sum(map(len, fresh))

    def _parts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
        """Parts of all texts without the spaces before them, whether each has one, texts in the order of their parts, and
        where the parts of each of these end."""
        odd = pc.match_substring_regex(texts, _ODD).to_numpy(zero_copy_only=False)
        plain, cut = np.flatnonzero(~odd), np.flatnonzero(odd)
        split = pc.split_pattern(pc.replace_substring(texts.take(pa.array(plain)), "\n", " \n "), " ")
        parts, starts = split.flatten(), split.offsets.to_numpy().astype(np.int64)
        starts, ends = starts[:-1] - starts[0], starts[1:] - starts[0]
        line = pc.equal(parts, "\n").to_numpy(zero_copy_only=False)
        lead = ~line
        lead[1:] &= ~line[:-1]
        lead[starts] = False
        if len(cut):
            more = [_CUT.split(x) for x in texts.take(pa.array(cut)).to_pylist()]
            n = np.fromiter(map(len, more), np.int64, len(more))
            after = np.ones(int(n.sum()), bool)
            after[np.cumsum(n) - n] = False
            parts = pa.concat_arrays([parts, pa.array([x for m in more for x in m], parts.type)])
            lead, ends = np.concatenate([lead, after]), np.concatenate([ends, len(line) + np.cumsum(n)])
        return parts, lead, np.concatenate([plain, cut]), ends

    def _ids_of(self, parts: pa.Array, lead: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct parts, all in a row; where each begins, and how many it has."""
        bare = pc.utf8_rtrim(parts, _SIGNS)
        ok = pc.match_substring_regex(bare, f"^{_LETTERS}$")
        bare = pc.if_else(ok, bare, parts)
        space = pc.if_else(pa.array(lead), pa.scalar(" ", parts.type), pa.scalar("", parts.type))
        keys = pc.binary_join_element_wise(space, bare, pa.scalar("", parts.type)).to_numpy(zero_copy_only=False)
        rows = np.zeros((len(parts), 2), np.int64)
        rows[:, 0] = np.fromiter(map(self.keys.__getitem__, keys), np.int64, len(keys))
        signed = np.flatnonzero(pc.less(pc.binary_length(bare), pc.binary_length(parts)).to_numpy(zero_copy_only=False))
        if len(signed):
            signs = pc.struct_field(pc.extract_regex(parts.take(pa.array(signed)), _AFTER), "signs").dictionary_encode()
            own = np.array([self.keys[x] for x in signs.dictionary.to_pylist()], np.int64)
            rows[signed, 1] = own[signs.indices.to_numpy()]
        if self.keys.fresh:
            self._add()
        n = self.n[rows]
        total = n.sum(axis=1)
        return _gather(self.flat, self.at[rows].ravel(), n.ravel()), np.cumsum(total) - total, total

    def encode(self, texts: list[str | None] | pa.Array) -> list[np.ndarray]:
        """One uint32 array per text; a null text has no ids."""
        if not len(texts):
            return []
        if self.rows * (workers.ENTRY + 16) + self.chars + 4 * self.used > self.limit:
            self._clear()
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        parts, lead, order, ends = self._parts(pc.fill_null(texts.cast(pa.large_string()), ""))
        coded = parts.dictionary_encode()
        pair = 2 * coded.indices.to_numpy().astype(np.int64) + lead
        there = np.bincount(pair, minlength=2 * len(coded.dictionary)) > 0
        distinct = np.flatnonzero(there)
        flat, at, n = self._ids_of(coded.dictionary.take(pa.array(distinct >> 1)), distinct % 2 == 1)
        which = (np.cumsum(there) - 1)[pair]
        upto = np.concatenate([[0], np.cumsum(n[which])])
        got = np.split(_gather(flat, at[which], n[which]), upto[ends[:-1]])
        out = [got[0]] * len(got)
        for i, ids in zip(order.tolist(), got):
            out[i] = ids
        return out


def encoder(path: str) -> Encoder:
    """One encoder per Python worker and file, kept from task to task."""
    return workers.hold("tokens", path, lambda: Encoder(path))
