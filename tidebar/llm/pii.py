"""Personal data, found by patterns and by what terms reveal of it, in DataFrame operations alone.

Base spans are matches of four kinds of pattern, checked. The method then sanitises by information: over the whole
corpus it counts where a protected value v stands, a term t stands, and t stands near v. The term discloses v where
its mutual information with v comes close to all the information that v carries,

    log2(n(t, v) N / (n(t) n(v))) >= disclosure * log2(N / n(v)),

and it was seen near v in several different contexts. Terms that disclose a value are spans of kind `term` wherever
they stand; redact() removes spans or generalises them.

What is counted are contexts and documents. Contexts with the same words in the same order are one, so copies of a
passage are no evidence; a copy with another word within reach is another context. n(v) is the number of contexts of v,
n(t, v) of those that hold t, and n(t) of all contexts that hold t and the documents that hold t in none of their
contexts; N is the number of all contexts and documents.

Only words near a protected value can disclose it, so only those are candidates; the counts themselves run over all
documents. Where no term is near a value in enough contexts, the later passes have nothing to do.

Defined cases: null text is empty; a text without matches has no spans; repeated rows are returned as often
as they stand, and counted so but for their contexts; null ids are kept; an empty table gives no rows; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common

# The possessive forms match what the plain ones do, as nothing that follows a repeated part could be part of it; they need
# no deep stack. An email or an ip can begin only where its first run of characters does, or where the match before it
# ended: from any later place the same run would lead to the same end. So each run is tried once, and time is linear.
KINDS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
ORDER = [*KINDS, "term"]
WORD = r"[\p{L}\p{N}]+"
BLOCK = 256  # matches of a text whose places are summed together
MASKS = {"email": "[EMAIL]", "ip": "[IP]", "card": "[CARD]", "phone": "[PHONE]"}


def _located(text: Column, pattern: str) -> Column:
    """start, end (code points), value of each match: the gaps between matches give the places. They are summed in blocks of
    matches and then over blocks, as each step of a sum copies the array so far."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    parts = F.zip_with(found, F.split(text, pattern, -1), lambda value, gap: F.struct(value.alias("value"), F.char_length(gap).alias("gap")))
    empty = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    zero = F.struct(F.lit(0).cast("bigint").alias("at"), empty.alias("out"))

    def add(acc: Column, part: Column) -> Column:
        start = acc["at"] + part["gap"]
        end = start + F.char_length(part["value"])
        return F.struct(end.alias("at"), F.concat(acc["out"], F.array(F.struct(start.alias("start"), end.alias("end"), part["value"].alias("value")))).alias("out"))

    def join(acc: Column, block: Column) -> Column:
        moved = F.transform(block["out"], lambda m: F.struct((m["start"] + acc["at"]).alias("start"), (m["end"] + acc["at"]).alias("end"), m["value"].alias("value")))
        return F.struct((acc["at"] + block["at"]).alias("at"), F.concat(acc["out"], moved).alias("out"))

    matched = F.array(F.filter(parts, lambda p: p["value"].isNotNull()))  # one element, so that all blocks share it
    blocks = F.transform(matched, lambda m: F.transform(F.sequence(F.lit(0), F.floor((F.size(m) - 1) / BLOCK).cast("int")), lambda b: F.aggregate(F.slice(m, b * BLOCK + 1, F.lit(BLOCK)), zero, add)))
    return F.when(text.rlike(pattern), F.aggregate(F.flatten(blocks), zero, join, lambda acc: acc["out"])).otherwise(empty)


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Every second digit from the right is doubled, and the digits' sum is a multiple of ten."""
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 1, doubled(d.cast("int"))).otherwise(d.cast("int")))
    return F.aggregate(each, F.lit(0), lambda s, d: s + F.coalesce(d, F.lit(0))) % 10 == 0


def _valid(kind: str, value: Column) -> Column:
    if kind == "ip":
        parts = F.transform(F.split(value, r"\."), lambda p: F.regexp_replace(p, "^0+(?=[0-9])", ""))
        return F.forall(parts, lambda p: (F.length(p) <= 3) & (p.cast("int") <= 255))
    if kind == "card":
        return F.length(_digits(value)).between(14, 19) & _luhn(_digits(value))
    if kind == "phone":
        return F.length(_digits(value)).between(10, 15)
    return F.lit(True)


def base_spans(text: Column) -> Column:
    """start, kind (its place in ORDER), end, value of the base spans, by start, then kind."""

    def of(k: int, kind: str) -> Column:
        good = F.filter(_located(text, KINDS[kind]), lambda m: _valid(kind, m["value"]))
        return F.transform(good, lambda m: F.struct(m["start"].alias("start"), F.lit(k).alias("kind"), m["end"].alias("end"), m["value"].alias("value")))

    all_ = [of(k, kind) for k, kind in enumerate(KINDS)]
    return F.array_sort(F.concat(*all_))


def joined(spans: Column) -> Column:
    names = F.array(*map(F.lit, ORDER))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _entity(s: Column) -> Column:
    """One number for a protected value however it is written."""
    return F.xxhash64(s["kind"], F.when(s["kind"] >= 2, _digits(s["value"])).otherwise(F.lower(s["value"])))


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def _terms(text: Column) -> Column:
    return F.filter(_words(text), lambda w: F.char_length(w) >= 3)


def _contexts(text: Column, spans: Column, reach: int) -> Column:
    """entity, ctx (a hash of all words around), terms for each base span; words cut by the reach are left out."""

    def one(s: Column) -> Column:
        lead = F.regexp_replace(F.substring(text, F.greatest(s["start"] - reach, F.lit(0)).cast("int") + 1, F.least(s["start"], F.lit(reach)).cast("int")), rf"^{WORD}", "")
        tail = F.regexp_replace(F.substring(text, s["end"].cast("int") + 1, F.lit(reach)), rf"{WORD}$", "")
        return F.struct(_entity(s).alias("entity"), F.xxhash64(_words(lead), F.lit("|"), _words(tail)).alias("ctx"), F.array_distinct(F.concat(_terms(lead), _terms(tail))).alias("terms"))

    return F.transform(spans, one)


def disclosing_terms(found: DataFrame, docs: DataFrame, disclosure: float = 0.8, contexts: int = 3) -> DataFrame | None:
    """term: those that disclose a protected value; None where no term stands near a value in enough contexts."""
    each = found.where(F.size("spans") > 0).select(F.explode("contexts").alias("x")).select("x.entity", "x.ctx", "x.terms")
    near = each.select("entity", "ctx", F.explode("terms").alias("term"))
    joint = near.distinct().groupBy("entity", "term").agg(F.count("*").alias("n_tv")).where(F.col("n_tv") >= contexts)
    joint = common.keep(joint, "joint")
    if joint.isEmpty():
        return None
    total = found.count() + each.select("ctx").distinct().count()
    n_v = each.select("entity", "ctx").distinct().groupBy("entity").agg(F.count("*").alias("n_v"))
    # counted before the join, so that no row of a word in a document is joined; documents with the term in a context go
    # out again
    inside = near.select("term", "ctx").distinct().groupBy("term").agg(F.count("*").alias("n"))
    words = docs.select(F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    again = found.where(F.size("spans") > 0).select(F.explode("near_terms").alias("term")).groupBy("term").agg((-F.count("*")).alias("n"))
    n_t = inside.union(words).union(again).groupBy("term").agg(F.sum("n").alias("n_t"))
    all_ = joint.join(n_v, "entity").join(n_t, "term")
    mutual = F.log2(F.col("n_tv") * F.lit(float(total)) / (F.col("n_t") * F.col("n_v")))
    return common.keep(all_.where(mutual >= disclosure * F.log2(F.lit(float(total)) / F.col("n_v"))).select("term").distinct(), "terms")


def find_spans(docs: DataFrame, reach: int = 60, disclosure: float = 0.8, contexts: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """row (a hash of id and text), doc_id, spans (base), terms (added spans) of every document; spans are arrays of
    start, kind, end, value."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    found = docs.withColumn("spans", base_spans(F.col("text")))
    found = found.withColumn("contexts", F.when(F.size("spans") > 0, _contexts(F.col("text"), F.col("spans"), reach)))
    near_terms = F.when(F.size("spans") > 0, F.array_intersect(_terms(F.col("text")), F.flatten(F.transform("contexts", lambda x: x["terms"]))))
    found = common.keep(found.select("row", "doc_id", "spans", "contexts", near_terms.alias("near_terms")), "spans")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint,value:string>>")
    terms = disclosing_terms(found, docs, disclosure, contexts)
    if terms is None or terms.isEmpty():
        return found.select("row", "doc_id", "spans", none.alias("terms"))
    held = docs.select("row", F.explode(F.array_distinct(_terms(F.col("text")))).alias("term")).join(terms, "term").groupBy("row").agg(F.collect_set("term").alias("held"))
    held = common.keep(held, "held")
    placed = docs.select("row", "text").join(held, "row").dropDuplicates(["row"])
    # words in order with the lengths of what stands before them: a running sum gives their places
    words = F.regexp_extract_all("text", F.lit(WORD), F.lit(0))
    parts = F.arrays_zip(words.alias("value"), F.transform(F.split("text", WORD, -1), lambda g: F.char_length(g)).alias("gap"))
    placed = placed.select("row", "held", F.posexplode(parts).alias("n", "p")).where("p.value is not null").select("row", "held", "n", "p.value", F.col("p.gap").cast("bigint").alias("gap"))
    end = F.sum(F.col("gap") + F.char_length("value")).over(Window.partitionBy("row").orderBy("n"))
    placed = placed.withColumn("end", end).where(F.array_contains("held", F.lower("value")))
    span = F.struct((F.col("end") - F.char_length("value")).alias("start"), F.lit(ORDER.index("term")).alias("kind"), F.col("end").cast("bigint").alias("end"), "value")
    placed = placed.groupBy("row").agg(F.sort_array(F.collect_list(span)).alias("own"))
    out = found.join(placed, "row", "left")
    outside = F.filter("own", lambda t: ~F.exists("spans", lambda s: (t["start"] < s["end"]) & (s["start"] < t["end"])))
    return out.select("row", "doc_id", "spans", F.coalesce(outside, none).alias("terms"))


def personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, the number of base spans of each kind, base_sha256 and all spans of every document."""
    found = find_spans(docs)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    counts = [count(k).alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(joined(F.col("spans")).cast("binary"), 256).alias("base_sha256"), joined(F.array_sort(F.concat("spans", "terms"))).alias("spans"))


def generalised(value: Column) -> Column:
    """What a disclosing term becomes: its kind alone."""
    return F.when(value.rlike("^[0-9]+$"), F.lit("[NUMBER]")).when(value.rlike(r"^\p{Lu}"), F.lit("[NAME]")).otherwise(F.lit("[TERM]"))


def redact(docs: DataFrame, generalise: bool = True) -> DataFrame:
    """docs with their text sanitised and n_chars set anew; texts without spans stay as they are. Overlapping spans
    become the mask of the one that starts first."""
    found = find_spans(docs).where((F.size("spans") > 0) | (F.size("terms") > 0)).select("row", F.array_sort(F.concat("spans", "terms")).alias("spans_found")).dropDuplicates(["row"])
    found = common.keep(found, "redact")
    text = F.coalesce("text", F.lit(""))
    rows = docs.withColumn("row_found", F.xxhash64(F.col("doc_id").cast("long"), text))
    found = found.withColumnRenamed("row", "row_found")
    # a text without these signs has no base span: only the rows with terms alone are looked up for it, so that most texts
    # stay where they are
    signs = text.contains("@") | text.rlike(r"\+[0-9]|[0-9](?:[\x20.-]?[0-9]){3}")
    terms_only = common.keep(found.where(F.forall("spans_found", lambda s: s["kind"] == ORDER.index("term"))), "terms_only")
    rows = rows.where(signs).join(found, "row_found", "left").unionByName(rows.where(~signs).join(terms_only, "row_found", "left"))
    masks = F.array(*[F.lit(MASKS[k]) for k in KINDS])

    def step(acc: Column, s: Column) -> Column:
        mask = F.when(s["kind"] < len(MASKS), F.get(masks, s["kind"])).otherwise(generalised(s["value"]) if generalise else F.lit(""))
        more = F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, (s["start"] - acc["at"]).cast("int")), mask)
        fresh = s["start"] >= acc["at"]
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(fresh, more).otherwise(acc["out"]).alias("out"))

    zero = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))
    clean = F.aggregate("spans_found", zero, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"].cast("int") + 1, F.lit(2**31 - 1))))
    rows = rows.withColumn("text", F.when(F.col("spans_found").isNotNull(), clean).otherwise(F.col("text")))
    if "n_chars" in docs.columns:
        rows = rows.withColumn("n_chars", F.when(F.col("spans_found").isNotNull(), F.char_length("text").cast("long")).otherwise(F.col("n_chars")))
    return rows.select(*docs.columns)
