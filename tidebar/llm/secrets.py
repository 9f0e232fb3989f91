"""Secret scans: candidate strings from every whole text, and a random forest that removes false positives.

All of it is DataFrame operations and Spark's own forest. Candidates are values assigned to a credential's name, at any
length and whole where they are quoted, dotted bearer tokens, and runs of 16 characters or more that a key may have. Features of a candidate: its length and the shares of its
kinds of characters, changes between kinds, how likely its letter pairs are in the corpus's words (character
transitions), how much of it common words cover (dictionary coverage), whether it stands in a path or address, and
the words and signs beside it (how many are common, and which they are, in hash buckets). The forest learns from labelled findings (value_sha256, label), of which at most
max_labelled rows are used.

Where no findings are given, candidates assigned to a credential's name and those in an issuer's format count as secrets
and the others as none, in documents whose id's checksum leaves 0, 1 or 2 of 4; so the rest is held out. The forest then
sees nothing of that rule: neither names, nor signs of assignment, nor quotes are among its features, nor which words stand
beside (those about credentials would stand in for the names), only the value itself and how common the words beside it are. So it can find secrets that the rule does not know.

Defined cases: null text has no candidates; with labels of one class alone each score is that class; rows with null
ids are scanned and not used for learning; equal values in equal surroundings get equal scores; repeated rows give
repeated findings; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

import zlib

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common, pii

# Names that stand beside credentials, and formats of issuers.
NAMES = r"(?:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key|auth|credential|private[_-]?key)"
ISSUED = r"^(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abp]-[A-Za-z0-9-]{10,}|AIza[A-Za-z0-9_-]{35}|eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_.-]+)$"
ASSIGN = NAMES + r"[\"']?\s{0,3}(?:=>|=|:)\s{0,3}[\"']?"
OPENS = NAMES + r"[\"']?\s{0,3}(?:=>|=|:)\s{0,3}"
#: A quoted value after an assignment, whole; another value after one (the first look back is a cheap one that few places
#: pass); a token of dotted parts; or a long run.
CANDIDATE = (
    r"(?<=\")(?i:(?<=" + OPENS + r"\"))[^\"\r\n]++(?=\")|(?<=')(?i:(?<=" + OPENS + r"'))[^'\r\n]++(?=')"
    r"|(?<=[=:>\"']|[=:>]\s)(?i:(?<=" + ASSIGN + r"))[^\s\"'<>]++|eyJ[A-Za-z0-9_-]{4,}+(?:\.[A-Za-z0-9_-]{4,}+){1,4}+|[A-Za-z0-9+/_-]{16,}+={0,2}"
)
NAMED = r"(?i)" + NAMES
ASSIGNED = r"(?i)" + ASSIGN + "$"
NEAR = 16  # hash buckets of the words beside a candidate
VALUE_FEATURES = ["f_length", "f_digits", "f_upper", "f_hex", "f_signs", "f_distinct", "f_changes", "f_pairs", "f_known", "f_path", "f_near_known"]
NEAR_FEATURES = [f"f_near_{i}" for i in range(NEAR)]
RULE_FEATURES = ["f_named", "f_assigned", "f_quoted"]
#: Shorter values are scored, but no examples where no findings are given: what follows a name may be any short word.
WEAK_LENGTH = 4
BUCKETS = 4096  # of the table of common words


def candidates(docs: DataFrame, reach: int = 48) -> DataFrame:
    """doc_id, start, end, value, before, after for every candidate in every whole text."""
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    rows = rows.withColumn("found", pii._located(F.col("text"), CANDIDATE)).where(F.size("found") > 0)
    rows = rows.select("doc_id", "text", F.explode("found").alias("m"))
    start = F.col("m.start").cast("int")
    before = F.substring("text", F.greatest(start - reach, F.lit(0)) + 1, F.least(start, F.lit(reach)))
    return rows.select("doc_id", "m.start", "m.end", "m.value", before.alias("before"), F.substring("text", F.col("m.end").cast("int") + 1, F.lit(reach)).alias("after"))


def _letters(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(r"[a-z]+"), F.lit(0))


def _neighbours(items: Column, join) -> Column:
    """join of each item and the next; one pass, whatever the length."""
    n = F.greatest(F.size(items) - 1, F.lit(0))
    return F.zip_with(F.slice(items, F.lit(1), n), F.slice(items, F.lit(2), n), join)


def corpus_statistics(docs: DataFrame, words: int = 1000) -> tuple[dict[str, float], list[str]]:
    """Log-likelihood of each letter pair, and the commonest longer words but the names of credentials. Counted over all documents; what the driver
    reads is bounded by the alphabet's pairs and by `words`."""
    counted = docs.select(F.explode(_letters(F.col("text"))).alias("w")).groupBy("w").count()
    counted = common.keep(counted, "words")
    pairs = counted.where(F.length("w") > 1).select("count", F.explode(_neighbours(F.split("w", ""), lambda a, b: F.concat(a, b))).alias("pair")).groupBy("pair").agg(F.sum("count").alias("n"))
    total = pairs.agg(F.sum("n")).first()[0] or 1
    likely = {r.pair: float(r.l) for r in pairs.select("pair", F.log2(F.col("n") / F.lit(float(total))).alias("l")).collect()}
    common_words = counted.where((F.length("w") >= 4) & ~F.col("w").rlike(NAMED)).orderBy(F.desc("count"), "w").limit(words).select("w").collect()
    return likely, [r.w for r in common_words]


def with_features(found: DataFrame, likely: dict[str, float], words: list[str]) -> DataFrame:
    value, n = F.col("value"), F.length("value").cast("double")
    share = lambda pattern: F.length(F.regexp_replace("value", pattern, "")) / n
    kinds = F.translate(F.regexp_replace(F.regexp_replace(F.regexp_replace("value", "[a-z]", "a"), "[A-Z]", "b"), "[0-9]", "c"), "+/_=-", "ddddd")
    least = min(likely.values(), default=-20.0) - 1
    # both tables are literal arrays read by place: a pair's number, and a word's checksum
    pair_table = F.array(*[F.lit(likely.get(chr(97 + i) + chr(97 + j), least)) for i in range(26) for j in range(26)])
    held: list[list[str]] = [[] for _ in range(BUCKETS)]
    for w in words:
        held[zlib.crc32(w.encode()) % BUCKETS].append(w)
    word_table = F.split(F.lit(";".join(",".join(h) for h in held)), ";")
    known = lambda w: F.find_in_set(w, F.get(F.col("word_table"), F.pmod(F.crc32(w.cast("binary")), F.lit(BUCKETS)).cast("int"))) > 0
    codes = F.transform(F.split(F.lower("value"), ""), lambda c: F.ascii(c) - 97)
    in_order = lambda x: x.between(0, 25)
    pairs = _neighbours(F.col("codes"), lambda a, b: F.when(in_order(a) & in_order(b), F.get("pair_table", a * 26 + b)).otherwise(F.lit(least)))
    in_words = lambda text: F.aggregate(F.filter(_letters(text), known), F.lit(0), lambda s, w: s + F.length(w))
    beside = F.concat_ws(" ", F.regexp_replace("before", r"\S+$", ""), F.regexp_replace("after", r"^\S+", ""))
    rows = found.select("*", pair_table.alias("pair_table"), word_table.alias("word_table"), F.split(kinds, "").alias("kinds"), codes.alias("codes"), beside.alias("beside"))
    # which words stand beside, but names of credentials, each as one of NEAR buckets
    near = F.transform(F.filter(_letters(F.col("beside")), lambda w: ~w.rlike(NAMED)), lambda w: F.pmod(F.crc32(w.cast("binary")), F.lit(NEAR)).cast("int"))
    rows = rows.withColumn("near", near)
    changes = F.size(F.filter(_neighbours(F.col("kinds"), lambda a, b: a != b), lambda x: x))
    return rows.select(
        "doc_id", "start", "end", "value", "before", "after",
        n.alias("f_length"), share("[^0-9]").alias("f_digits"), share("[^A-Z]").alias("f_upper"), share("[^0-9a-fA-F]").alias("f_hex"), share("[A-Za-z0-9]").alias("f_signs"),
        (F.size(F.array_distinct("codes")) / n).alias("f_distinct"), (changes / n).alias("f_changes"),
        (F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x) / n).alias("f_pairs"),
        (in_words(value) / n).alias("f_known"),
        (F.col("before").rlike(r"[/.@]$") | F.col("after").rlike(r"^[/.@][a-z]") | value.contains("/")).cast("double").alias("f_path"),
        (in_words(F.col("beside")) / (F.length("beside") + 1)).alias("f_near_known"),
        *[F.array_contains("near", i).cast("double").alias(f"f_near_{i}") for i in range(NEAR)],
        F.col("before").rlike(NAMED).cast("double").alias("f_named"), F.col("before").rlike(r"[=:>]\s*[\"']?$").cast("double").alias("f_assigned"), F.col("after").rlike("^[\"']").cast("double").alias("f_quoted"),
    )


def scan(docs: DataFrame, findings: DataFrame | None = None, max_labelled: int = 20_000, trees: int = 40, depth: int = 6) -> DataFrame:
    """doc_id, start, end, value_sha256, held_out, score (0 to 1), is_secret of every candidate."""
    found = with_features(candidates(docs), *corpus_statistics(docs))
    if findings is None:
        found = found.drop(*NEAR_FEATURES)
    found = found.withColumn("value_sha256", F.sha2(F.col("value").cast("binary"), 256))
    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 3, F.lit(True))
    weak = F.when((F.length("value") >= WEAK_LENGTH) | F.col("value").rlike(ISSUED), F.col("before").rlike(ASSIGNED) | F.col("value").rlike(ISSUED))
    found = common.keep(found.withColumn("held_out", held).withColumn("weak", weak.cast("double")), "candidates")
    features = VALUE_FEATURES + (RULE_FEATURES + NEAR_FEATURES if findings is not None else [])
    if findings is not None:
        labelled = found.join(findings.select("value_sha256", F.col("label").cast("double").alias("y")).dropDuplicates(["value_sha256"]), "value_sha256")
    else:
        labelled = found.where(~F.col("held_out")).withColumn("y", F.col("weak"))
    # half of the sample for each class, in the order of a hash
    sample = [labelled.where(F.col("y") == y).orderBy(F.xxhash64("value_sha256", "doc_id", "start"), "doc_id", "start").limit(max_labelled // 2) for y in (0.0, 1.0)]
    sample = common.keep(sample[0].unionByName(sample[1]).select(*features, "y"), "labelled")
    classes = [r.y for r in sample.select("y").distinct().collect()]
    if len(classes) == 2:
        vector = VectorAssembler(inputCols=features, outputCol="features")
        forest = RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, seed=11).fit(vector.transform(sample))
        scored = forest.transform(vector.transform(found)).withColumn("score", vector_to_array("probability")[1])
    else:
        scored = found.withColumn("score", F.lit(classes[0] if classes else 0.0))
    return scored.select("doc_id", "start", "end", "value_sha256", "held_out", "score", (F.col("score") >= 0.5).alias("is_secret"))
