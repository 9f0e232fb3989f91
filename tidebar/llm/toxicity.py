"""Toxicity by compression distance.

zstandard trains two dictionaries, one on windows of toxic texts and one on windows of ordinary texts. The toxic samples
are the windows that hold what sets toxic texts apart (stems by likelihood ratio), and the ordinary ones those that don't,
since most windows of a toxic text are ordinary and would make both dictionaries alike. Each
window of a text (a word between neutral margins, as zstandard matches nothing in a window's last bytes) is
compressed with both; the difference of the two lengths says which text it is nearer to. A document's share and
number of windows beyond each length difference, and its largest difference, give a score by a logistic curve
that is calibrated on the training labels and on the share of each class among all of them.

Training reads a bounded sample of labelled rows (per_class of each label and sample_bytes of their texts, in the order of
a hash of their id); scoring reads every window of every whole text. Windows repeat, so their lengths are looked up.

Defined cases: a null, empty or wordless text counts as one empty window; with no labels of either kind every
score is 0; rows with a null id are scored like others; repeated rows get equal scores; other columns are ignored."""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common, workers

WORD = re.compile(r"\w+")
MARGIN = b"\n" * 16
STEPS = (1, 2, 3, 4)
STEM, LONGEST = 5, 12  # characters of a stem with the space before it


def windows(text: str | None) -> list[str]:
    return WORD.findall(text.lower()) if text else []


def _stems(word: str) -> list[str]:
    word = f" {word} "
    return [word[:k] for k in range(min(STEM, len(word)), min(len(word), LONGEST) + 1)]


def _counted(texts: list[str]) -> tuple[Counter, int]:
    """Occurrences of each stem, at most 3 of a word in a text, so that one repeated line doesn't count for many."""
    words: Counter = Counter()
    for text in texts:
        words.update({w: min(n, 3) for w, n in Counter(windows(text)).items()})
    stems: Counter = Counter()
    for w, n in words.items():
        for s in _stems(w):
            stems[s] += n
    return stems, max(1, sum(words.values()))


def contrast(toxic: list[str], ordinary: list[str], evidence: float = 36.0, texts: int = 4, most: int = 300) -> list[str]:
    """Stems that toxic text holds beyond chance (likelihood ratio over `evidence`), strongest first, none the start of another."""
    (a, na), (b, nb) = _counted(toxic), _counted(ordinary)
    strong = {}
    for s, n in a.items():
        m = b[s]
        expected = (n + m) * na / (na + nb)
        if n >= texts and n / na > 3 * m / nb:
            ratio = 2 * (n * math.log(n / expected) + (m * math.log(m / (n + m - expected)) if m else 0))
            if ratio > evidence:
                strong[s] = ratio
    held: Counter = Counter()
    for text in toxic:
        held.update({s for w in set(windows(text)) for s in _stems(w)} & strong.keys())
    chosen: list[str] = []
    for s in sorted((s for s in strong if held[s] >= texts), key=lambda s: (-strong[s], s)):
        if len(chosen) < most and not any(s.startswith(c) or c.startswith(s) for c in chosen):
            chosen.append(s)
    return chosen


def train_dictionaries(toxic: list[str], ordinary: list[str], size: int = 8192, together: int = 32) -> tuple[bytes, bytes]:
    """(toxic, ordinary) dictionaries, each trained on its windows, so many to a sample."""
    chosen = set(contrast(toxic, ordinary))

    def trained(texts: list[str], marked: bool) -> bytes:
        all_ = [f" {w} ".encode("utf-8", "replace") for t in texts for w in windows(t) if any(s in chosen for s in _stems(w)) == marked]
        samples = [b"".join(all_[i : i + together]) for i in range(0, len(all_), together)]
        try:
            made = zstandard.train_dictionary(size, samples).as_bytes()
        except zstandard.ZstdError:  # too few samples: they are the dictionary
            made = b"".join(dict.fromkeys(all_))
        return made[-size:].ljust(64, b"\x00")

    return trained(toxic, True), trained(ordinary, False)


class Distances(dict):
    """Window -> bytes that the toxic dictionary saves over the ordinary one; starts anew at `limit` bytes."""

    def __init__(self, toxic: bytes, ordinary: bytes, limit: int = workers.LIMIT // 2):
        super().__init__()
        how = zstandard.ZstdCompressionParameters.from_level(3, min_match=4, write_content_size=0, write_checksum=0, write_dict_id=0)
        self.toxic, self.ordinary = (zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=how) for d in (toxic, ordinary))
        self.limit, self.size = limit, 0

    def __missing__(self, word: str) -> int:
        if self.size > self.limit:
            self.clear()
            self.size = 0
        self.size += workers.ENTRY + len(word)
        data = MARGIN + f" {word} ".encode("utf-8", "replace") + MARGIN
        self[word] = d = len(self.ordinary.compress(data)) - len(self.toxic.compress(data))
        return d


def features(text: str | None, distances: Distances) -> list[float]:
    words = windows(text) or [""]
    d = np.fromiter(map(distances.__getitem__, words), np.int64, len(words))
    out = [1.0, math.log(len(d))]
    for step in STEPS:
        n = int((d >= step).sum())
        out += [math.log1p(n), math.log1p(100 * n / len(d))]
    return [*out, float(min(max(d.max(), 0), 8)), float(d.mean())]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, rounds: int = 50) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (p - y) + ridge * w)
        w = w - step
        if np.abs(step).max() < 1e-9:
            break
    return w


def train(docs: DataFrame, labels: DataFrame, per_class: int = 2000, sample_bytes: int = 16_000_000) -> dict | None:
    """The two dictionaries and the curve, from at most per_class texts of each label, and of these the first sample_bytes: texts
    longer than a sixteenth of that come after all others, so that no long one takes the place of many, and the last one
    counts with its first sample_bytes characters. docs: doc_id, text; labels: doc_id, toxic (0 or 1). None if a class is missing."""
    picked = [r for value in (0, 1) for r in labels.where(F.col("toxic") == value).select("doc_id", "toxic").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not picked:
        return None
    chosen = docs.sparkSession.createDataFrame([(r.doc_id, r.toxic) for r in picked], "doc_id long, toxic int")
    rows = docs.join(F.broadcast(chosen), "doc_id").select("doc_id", "text", "toxic").distinct()
    size = F.octet_length(F.coalesce("text", F.lit("")))
    before = F.sum(size).over(Window.partitionBy("toxic").orderBy(size > sample_bytes // 16, F.xxhash64("doc_id"), "doc_id", "text")) - size
    rows = rows.withColumn("before", before).where(F.col("before") < sample_bytes).select("doc_id", F.substring("text", 1, sample_bytes).alias("text"), "toxic").collect()
    rows = sorted((r.doc_id, r.text or "", r.toxic) for r in rows)
    toxic, ordinary = list(dict.fromkeys(r[1] for r in rows if r[2] == 1)), list(dict.fromkeys(r[1] for r in rows if r[2] == 0))
    if not toxic or not ordinary:
        return None
    t, o = train_dictionaries(toxic, ordinary)
    distances = Distances(t, o)
    x = np.array([features(text, distances) for text in toxic + ordinary])
    w = fit_logistic(x, np.array([1.0] * len(toxic) + [0.0] * len(ordinary)))
    # the sample holds the classes in other shares than all labelled rows do: the constant term is set to theirs
    share = {r.toxic: r["count"] for r in labels.groupBy("toxic").count().collect()}
    w[0] += math.log(share[1] / share[0]) - math.log(len(toxic) / len(ordinary))
    return {"toxic": t, "ordinary": o, "weights": w}


def score(docs: DataFrame, model: dict | None, keep: list[str] | None = None) -> DataFrame:
    """docs: doc_id, text and the columns in keep. Returns these (doc_id alone by default) and score (0 to 1)."""
    keep = keep or ["doc_id"]
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("score"))
    toxic, ordinary, weights = model["toxic"], model["ordinary"], model["weights"]
    rows = docs.select(*[F.col(c) for c in keep], F.col("text").alias("text_scored"))
    names = [*keep, "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        distances = workers.hold("toxicity", (toxic, ordinary), lambda: Distances(toxic, ordinary))
        for batch in common.slices(batches, len(keep)):
            x = np.array([features(t, distances) for t in batch.column(len(keep)).to_pylist()]).reshape(-1, len(weights))
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(p)], names)

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, ", ".join([*(f"`{c}` {kinds[c]}" for c in keep), "score double"]))


def held_out(column: str = "doc_id"):
    return F.coalesce(F.pmod(F.crc32(F.col(column).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; learns from labelled rows that are not held out."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    model = train(docs, labels.where(~held_out()))
    return score(docs, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
