"""Candidates and features of secrets, and scores of toxicity, against plain computations."""

import math
import random
import re
import time
import zlib

import numpy as np
import pytest
import zstandard

pytest.importorskip("tidebar.llm.queries")

from tidebar.llm import secrets, toxicity  # noqa: E402

DOCS = "doc_id long, text string"
JWT = "eyJhbGciOiJIUzI1NiJ9.eyJzdWIiOiIxMjM0In0.abcd_efgh-1234"


def test_candidates_are_whole(spark):
    texts = ["pwd=abc", 'password: "correct horse battery"', "secret => 'two words' rest", f"Authorization: Bearer {JWT}", 'api_key="open', "token = x", "nothing here", f"see {JWT}, then", "k" * 16 + "==", "TOKEN:\t\"a'b c\""]
    got = {}
    for r in secrets.candidates(spark.createDataFrame(list(enumerate(texts)), DOCS)).collect():
        assert texts[r.doc_id][r.start : r.end] == r.value
        got.setdefault(r.doc_id, []).append(r.value)
    assert got == {0: ["abc"], 1: ["correct horse battery"], 2: ["two words"], 3: [JWT], 4: ["open"], 5: ["x"], 7: [JWT], 8: ["k" * 16 + "=="], 9: ["a'b c"]}


def plain_features(value, before, after, likely, words):
    low, n = value.lower(), len(value)
    share = lambda p: sum(bool(re.match(p, c)) for c in value) / n
    kind = lambda c: "a" if "a" <= c <= "z" else "b" if "A" <= c <= "Z" else "c" if "0" <= c <= "9" else "d" if c in "+/_=-" else c
    least = min(likely.values(), default=-20.0) - 1
    letter = lambda c: "a" <= c <= "z"
    pairs = sum(likely.get(a + b, least) if letter(a) and letter(b) else least for a, b in zip(low, low[1:]))
    covered = lambda t: sum(len(w) for w in re.findall("[a-z]+", t.lower()) if w in words)
    beside = re.sub(r"\S+$", "", before) + " " + re.sub(r"^\S+", "", after)
    named = re.compile("(?i)" + secrets.NAMES)
    near = {zlib.crc32(w.encode()) % secrets.NEAR for w in re.findall("[a-z]+", beside.lower()) if not named.search(w)}
    path = bool(re.search(r"[/.@]$", before) or re.search(r"^[/.@][a-z]", after) or "/" in value)
    return {
        "f_length": n, "f_digits": share("[0-9]"), "f_upper": share("[A-Z]"), "f_hex": share("[0-9a-fA-F]"), "f_signs": share("[^A-Za-z0-9]"), "f_distinct": len(set(low)) / n,
        "f_changes": sum(kind(a) != kind(b) for a, b in zip(value, value[1:])) / n, "f_pairs": pairs / n, "f_known": covered(value) / n, "f_path": path, "f_near_known": covered(beside) / (len(beside) + 1),
        **{f"f_near_{i}": i in near for i in range(secrets.NEAR)},
    }


def test_features_are_the_plain_ones(spark):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdeorst") for _ in range(r.randint(2, 9)))
    texts = [" ".join(word() for _ in range(30)) for _ in range(20)]
    key = lambda: "".join(r.choice("abcXYZ019+/_-") for _ in range(r.randint(16, 40)))
    texts += [f"{word()} {word()} {r.choice(['token=', 'path/', 'x ', 'secret: ', ''])}{key()}{r.choice(['', '.com', ' '])} {word()} the token" for _ in range(40)] + ["pwd=a", "auth: " + "word" * 9]
    docs = spark.createDataFrame(list(enumerate(texts)), DOCS)
    likely, words = secrets.corpus_statistics(docs)
    counts = {}
    for w in re.findall("[a-z]+", " \n".join(texts).lower()):
        for a, b in zip(w, w[1:]):
            counts[a + b] = counts.get(a + b, 0) + 1
    assert likely == pytest.approx({p: math.log2(n / sum(counts.values())) for p, n in counts.items()})
    found = secrets.with_features(secrets.candidates(docs), likely, words).collect()
    assert len(found) >= 42
    for row in found:
        want = plain_features(row.value, row.before, row.after, likely, set(words))
        assert {f: row[f] for f in want} == pytest.approx({k: float(v) for k, v in want.items()}), row.value


def test_features_of_a_long_value_take_linear_time(spark):
    r = random.Random(3)
    docs = spark.createDataFrame([(1, "key " + "".join(r.choice("abcdefXYZ0189+/") for _ in range(1_000_000)) + " end"), (2, "x" * 1_000_000)], DOCS)
    began = time.time()
    likely, words = secrets.corpus_statistics(docs)
    rows = secrets.with_features(secrets.candidates(docs), likely, words).select("f_length", "f_changes", "f_pairs").collect()
    assert sorted(r.f_length for r in rows) == [1_000_000.0, 1_000_000.0] and time.time() - began < 40


def test_one_long_labelled_text_takes_no_place(spark):
    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    rows = [(i, " ".join(word() for _ in range(60)) + (" qqzzxx qqzzyy" * 3 if i % 2 else "")) for i in range(80)]
    rows += [(1002, " ".join(word() for _ in range(180_000))), (1003, "qqzzxx " * 170_000)]
    labels = spark.createDataFrame([(i, i % 2) for i, _ in rows], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.train(docs, labels, sample_bytes=1_000_000)
    assert model is not None
    # only long texts: each class has its first sample_bytes characters
    assert toxicity.train(docs.where("doc_id > 1000"), labels, sample_bytes=100_000) is not None
    how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
    packers = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(model[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for k in ("ordinary", "toxic")]
    for row in toxicity.score(docs.where("doc_id < 20"), model, ["doc_id", "text"]).collect():
        saved = []
        for w in re.findall(r"\w+", row.text.lower()):
            data = b"\n" * 16 + f" {w} ".encode() + b"\n" * 16
            saved.append(len(packers[0].compress(data)) - len(packers[1].compress(data)))
        x = [1.0, math.log(len(saved))]
        for k in (1, 2, 3, 4):
            over = sum(d >= k for d in saved)
            x += [math.log(1 + over), math.log(1 + 100 * over / len(saved))]
        x += [min(max(*saved, 0), 8), sum(saved) / len(saved)]
        assert row.score == pytest.approx(1 / (1 + math.exp(-float(np.dot(x, model["weights"])))))
        assert (row.score >= 0.3) == bool(row.doc_id % 2)
