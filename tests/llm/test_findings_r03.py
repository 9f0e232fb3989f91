"""Findings of round 3 on the text operators."""

import random

import numpy as np
import pyarrow as pa

from tidebar.llm import common, ngram_join, range_coder, segmentation, tokens


def test_encoder_takes_letters_and_signs_apart():
    """A word with other signs behind it is not encoded anew; ids stay the tokenizer's on any mixture of signs."""
    coder = tokens.Encoder(tokens.tokenizer_path())
    draw = random.Random(3)
    signs = [*"ab é\n\n  \t,.'_!9½ªµ×ÖΩЖ中 ́ǅſɐ—😀\x1c\r", "'s", "<|endoftext|>", " the", " foo's", "don't,"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 30))) for _ in range(3000)] + [None, "", "\n", " ", "a,\nb."]
    got = coder.encode(pa.array(texts, pa.string()))
    assert [g.tolist() for g in got] == [coder.tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
    coder._clear()
    coder.encode(["whonen whonen, whonen. whonen! whonen", "thé whonen."])
    assert set(coder.keys) == {"", "whonen", " whonen", "thé", ",", ".", "!"}


def test_postings_travel_without_bits(spark, monkeypatch):
    """What is joined by n-gram holds ids and sizes alone; components are those of all links."""
    kept = []
    keep = common.keep
    monkeypatch.setattr(common, "keep", lambda df, name: kept.append((name, df.dtypes)) or keep(df, name))
    draw = random.Random(4)
    rows = []
    for family in range(6):
        words = [f"w{draw.randrange(900)}" for _ in range(60)]
        for i in range(6):
            words[draw.randrange(60)] = f"f{family}x{i}"
            rows.append((10 * family + i, " ".join(words)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in ngram_join.near_classes(docs).collect()}
    by_h = [kinds for name, kinds in kept if name in ("pivot", "open")]
    assert by_h and all(kind == "bigint" for kinds in by_h for _, kind in kinds)
    sets = {i: {tuple(w[k : k + 5]) for k in range(len(w) - 4)} for i, w in ((i, t.split()) for i, t in rows)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_distinct_words_are_looked_up_once():
    """Repeated words cost one look-up; a table that starts anew gives the same, as do words that Arrow does not take."""
    lat = segmentation.Lattices(segmentation.model_path(), 0.001, limit=1)
    asked = []

    class Counted(segmentation.Known):
        def __getitem__(self, word):
            asked.append(word)
            return super().__getitem__(word)

    lat.known = Counted()
    lat.limit = 1 << 30
    got = lat.entries(["▁one", "▁two", "▁one"] * 50)
    assert asked == ["▁one", "▁two"] and got.tolist() == [got[0], got[1], got[0]] * 50
    texts = ["one two  three é", "half \ud800 a pair", None, "", "日本語 one"]
    first = segmentation.sample_texts(lat, [1, 2, 3, 4, 5], texts, 2)
    lat.limit = 1
    again = segmentation.sample_texts(lat, [1, 2, 3, 4, 5], texts, 2)
    assert [[p.tolist() for p, _, _ in rows] for rows in first] == [[p.tolist() for p, _, _ in rows] for rows in again]
    for text, rows in zip(texts, first):
        assert all(segmentation.decode_pieces(lat, p) == (text or "").encode("utf-8", "surrogatepass") for p, _, _ in rows)


def test_lanes_of_a_block_are_coded_side_by_side(monkeypatch):
    """A block takes a sixteenth of its ids in steps, however many blocks there are; before, it took a step for each id."""
    steps = []
    predict = range_coder.Record.predict
    monkeypatch.setattr(range_coder.Record, "predict", lambda self, n: steps.append(n) or predict(self, n))
    ids = np.random.default_rng(5).integers(0, 700, 3 * 8192 + 100).astype(np.uint32)
    data = range_coder.compress(ids)
    assert len(steps) == 512 and sum(steps) == 3 * 8192 + 112
    steps.clear()
    assert (range_coder.decompress(data) == ids).all() and len(steps) == 512


def plain_ids(data):
    """The ids of a segment, decoded id by id in whole numbers as the module's docstring says."""
    rc = range_coder
    _, _, block, n, blocks, head, _ = rc.HEAD.unpack_from(data)
    tables = rc.Tables.unpack(data[rc.HEAD.size : rc.HEAD.size + head])
    rows, at = [], 0
    for size, bits in zip(tables.row_sizes.tolist(), tables.bits.tolist()):
        rows.append((bits, list(zip(tables.rank[at : at + size].tolist(), tables.freq[at : at + size].tolist()))))
        assert not size or sum(f for _, f in rows[-1][1]) == 1 << bits
        at += size
    at, got = rc.HEAD.size + head + 12 * blocks, []
    for b in range(blocks):
        count, size, _ = np.frombuffer(data, "<u4", 3, rc.HEAD.size + head + 12 * b).tolist()
        words = np.frombuffer(data, "<u2", size // 2, at).tolist()
        at += size
        lanes = []
        for own in words[: rc.LANES]:
            begin = rc.LANES + sum(len(x["words"]) for x in lanes)
            lanes.append({"words": words[begin : begin + own], "range": 1 << 48, "ids": [0, 0]})
        for x in lanes:
            x["words"] += [0] * 3
            x["code"] = x["words"][0] << 32 | x["words"][1] << 16 | x["words"][2]
            x["at"] = 3
        slots, counts, new = {}, {}, []
        for t in range(-(-count // rc.LANES)):
            if t in (1, 2, 4, 8) or t % 16 == 0:
                for state, what in new:
                    counts.setdefault(state, [1, 2, 1])[what] += 1
                new, shares = [], {k: list(v) for k, v in counts.items()}
            after = {}
            for x in lanes:
                two, one = x["ids"][-2:]
                slot = (one * 40503 + two * 60493 >> 4) % 4096
                guess, level = slots.get(slot, (None, 0))
                bits, row = rows[one]
                top, sure = (max(row, key=lambda e: e[1]), 1) if row else ((0, 0), 0)
                state = (level, guess == top[0], sure and 1 + min(2, 4 * top[1] >> bits))
                seen = shares.get(state, [1, 2, 1])
                end2 = 1 + seen[0] * 1021 // sum(seen)
                end1 = end2 + 1 + seen[1] * 1021 // sum(seen)
                part = x["range"] >> 10
                what = 0 if x["code"] < part * end2 else 1 if x["code"] < part * end1 else 2
                begin, end = ((0, end2), (end2, end1), (end1, 1024))[what]
                x["code"] -= part * begin
                x["range"] = part * (end - begin)
                if what:
                    bits, row = rows[one if what == 1 else tables.d]
                    part, below = x["range"] >> bits, 0
                    for guess, freq in row:
                        if x["code"] < part * (below + freq):
                            break
                        below += freq
                    x["code"] -= part * below
                    x["range"] = part * freq
                while x["range"] < 1 << 32:
                    x["range"] <<= 16
                    x["code"] = x["code"] << 16 | (x["words"][x["at"]] if x["at"] < len(x["words"]) else 0)
                    x["at"] += 1
                x["ids"].append(guess)
                after[slot] = (guess, 1 if what else min(level + 1, 4))
                new.append((state, what))
            slots |= after
        got += [int(tables.values[i]) for x in lanes for i in x["ids"][2:]][:count]
    assert at == len(data)
    return got


def test_coder_is_the_plain_one():
    """Rare and frequent ids, long repeats, ids that order 1 foresees, a short last block, blocks that are no whole number of steps."""
    draw = random.Random(6)
    ids = [0] * 300 + [draw.choice([7, 7, 7, 9, 1 << 19]) for _ in range(500)] + [*range(2000, 2040)] * 30 + [int(3000 * draw.random() ** 4) for _ in range(3000)]
    for block in (1000, 2048, 8192):
        data = range_coder.compress(np.array(ids, np.uint32), block)
        assert range_coder.decompress(data).tolist() == ids == plain_ids(data)


def test_damage_to_a_segment_is_found():
    """Each byte of a segment counts: the head has a checksum of its own, and what a damaged block decodes to stays in bounds."""
    draw = random.Random(7)
    ids = np.array([int(300 * draw.random() ** 3) for _ in range(5000)], np.uint32)
    data = range_coder.compress(ids, 1024)
    for at in [*range(4), *range(range_coder.HEAD.size - 4, range_coder.HEAD.size + 60), *draw.sample(range(range_coder.HEAD.size, len(data)), 150)]:
        damaged = bytearray(data)
        damaged[at] ^= 1 << draw.randrange(8)
        try:
            assert (range_coder.decompress(bytes(damaged)) == ids).all()  # a bit that no id hangs on, behind a lane's last
        except ValueError:
            pass
