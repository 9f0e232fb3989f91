"""WARC archives: writing page records with revisits, and reading archives by verified chains of record boundaries.

Writing: Spark's text writer puts out one record per row; a record's last byte is the writer's newline. Payloads
that occur more than once and are long enough are stored once, and the other rows point to that record.

Reading: files are read in splits, cut at every occurrence of the version line. Each cut is a candidate record; its
header gives the offset where its successor must start. A magic inside a payload is a candidate too, so only
candidates that a chain of successors from the file's start reaches are records. Consecutive candidates that link
to each other form runs (one window over narrow rows of a file); between runs pointers are doubled until nothing
new is reached. Payloads cut by an inner magic are put together again from their parts alone.

Defined cases: null html is an empty payload; a null page_id or url leaves its header out and reads back as null; in
a group with equal payloads rows without an id revisit the row with the largest id, and all are responses where no
row has one; repeated rows with the largest id are all responses; line breaks in a url are percent-encoded; an empty
table gives an empty archive; other columns are ignored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

MAGIC = "WARC/1.1\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def with_revisits(pages: DataFrame, least_bytes: int = 1000) -> DataFrame:
    """Adds payload, payload_bytes, payload_digest, record_type, refers_to to page_id, url, html.

    Only the payloads that repeat are gathered, as narrow rows; Spark broadcasts that table if its measured size allows."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce("html", F.lit("")).alias("payload"))
    rows = rows.withColumn("payload_bytes", F.octet_length("payload").cast("long")).withColumn("payload_digest", F.sha1(F.col("payload").cast("binary")))
    again = rows.where(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1 and holder is not null").select("payload_digest", "holder")
    again = common.keep(again, "repeated")
    rows = rows.join(again, "payload_digest", "left")
    revisit = F.col("holder").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("holder"))
    return rows.select("page_id", "url", "payload", "payload_bytes", "payload_digest", F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("holder")).alias("refers_to"))


def write_warc(records: DataFrame, path: str, date: str = "2000-01-01T00:00:00Z") -> None:
    """Writes the rows of with_revisits as WARC files under path."""
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    body = F.when(F.col("record_type") == "response", F.col("payload")).otherwise(F.lit(""))
    head = F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), "payload_digest", F.lit(">")))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "payload_digest")),
        line("WARC-Refers-To", urn(F.col("refers_to"))),
        line("WARC-Profile", F.when(F.col("record_type") == "revisit", F.lit(PROFILE))),
        line("X-Page-Id", F.col("page_id").cast("string")),
        line("X-Payload-Length", F.col("payload_bytes").cast("string")),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.octet_length(body).cast("string")),
        F.lit("\r\n"),
    )
    records.select(F.concat(head, body, F.lit("\r\n\r")).alias("value")).write.text(path)


def _cuts(spark: SparkSession, path: str) -> DataFrame:
    """file, block, row, value: the text between version lines, in order of (block, row) in its file."""
    text = spark.read.schema("value string").option("lineSep", MAGIC).text(path)
    return text.select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"), "value")


def _field(name: str):
    return F.regexp_extract("head", rf"(?im)^{name}:[ \t]*([^\r\n]*)", 1)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: file, offset, end, head, own_digest (sha1 of the payload in the file), parts."""
    raw = _cuts(spark, path)
    head_bytes = F.octet_length("head") + 4
    length = F.when(F.col("head").rlike(r"(?im)^content-length:[ \t]*[0-9]{1,15}[ \t]*(\r|$)") & F.col("value").contains("\r\n\r\n"), _field("content-length").cast("long"))
    cuts = raw.withColumn("size", F.octet_length("value").cast("long")).withColumn("head", F.substring_index("value", "\r\n\r\n", 1))
    cuts = cuts.withColumn("length", length).withColumn("need", head_bytes + F.col("length") + 4)
    whole = F.col("need") <= F.col("size")
    payload = F.substring(F.col("value").cast("binary"), head_bytes + 1, F.col("length").cast("int"))
    cuts = cuts.select("file", "block", "row", "size", F.when(F.col("length").isNotNull(), F.col("head")).alias("head"), "need", F.when(whole, F.sha1(payload)).alias("own_digest"))

    magic = len(MAGIC)
    order = Window.partitionBy("file").orderBy("block", "row")
    before = F.coalesce(F.sum(F.col("size") + magic).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cuts = cuts.withColumn("offset", before - magic).where("offset >= 0")
    end = F.col("offset") + magic + F.col("size")
    cuts = cuts.withColumn("next", F.col("offset") + magic + F.col("need")).withColumn("after", end)
    joined = F.coalesce(F.lag(F.col("next") == F.col("after")).over(order), F.lit(False))
    cuts = common.keep(cuts.withColumn("run", F.sum(F.when(joined, 0).otherwise(1)).over(order)), "cuts")
    reached = _reachable(spark, cuts)
    return cuts.join(reached, ["file", "run"]).where((F.col("offset") >= F.col("entry")) & F.col("next").isNotNull()).select("file", "block", "row", "offset", F.col("next").alias("end"), "head", "own_digest", F.when(F.col("next") > F.col("after"), True).otherwise(False).alias("parts"))


def _reachable(spark: SparkSession, cuts: DataFrame, rounds: int = 64) -> DataFrame:
    """file, run, entry: the runs that the chain from the file's start enters, and where. Pointer jumping over runs."""
    reached = cuts.where("offset = 0").select("file", "run", F.col("offset").alias("entry"))
    if cuts.where("run > 1").isEmpty():
        return reached
    leave = cuts.groupBy("file", "run").agg(F.max_by("next", "offset").alias("exit"))
    jump = leave.join(cuts.select("file", F.col("offset").alias("exit"), F.col("run").alias("to")), ["file", "exit"]).select("file", "run", "to", F.col("exit").alias("at"))
    jump, reached = common.keep(jump, "jump"), common.keep(reached, "reached")
    known = reached.count()
    for _ in range(rounds):
        new = reached.select("file", "run").join(jump, ["file", "run"]).select("file", F.col("to").alias("run"), F.col("at").alias("entry"))
        reached = common.keep(reached.union(new).distinct(), "reached")
        if (now := reached.count()) == known:
            return reached
        known = now
        far = jump.select("file", F.col("run").alias("to"), F.col("to").alias("far"), F.col("at").alias("far_at"))
        jump = common.keep(jump.join(far, ["file", "to"]).select("file", "run", F.col("far").alias("to"), F.col("far_at").alias("at")), "jump")
    raise RuntimeError("a chain of records did not end")


def _put_together(spark: SparkSession, path: str, index: DataFrame) -> DataFrame:
    """file, offset, payload of the records whose payload holds a version line: from their parts alone."""
    split = index.where("parts").select("file", "offset", "end", "head")
    cuts = _cuts(spark, path)
    order = Window.partitionBy("file").orderBy("block", "row")
    narrow = cuts.select("file", "block", "row", F.octet_length("value").cast("long").alias("size"))
    narrow = narrow.withColumn("at", F.coalesce(F.sum(F.col("size") + len(MAGIC)).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)) - len(MAGIC))
    # a part belongs to the last split record that starts at or before it, if it ends after it
    marks = narrow.join(split.select("file", F.col("offset").alias("at"), "offset", "end", "head"), ["file", "at"], "left")
    held = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.select("file", "block", "row", "at", *(F.last(c, True).over(held).alias(c) for c in ("offset", "end", "head"))).where("offset is not null and at < end")
    parts = cuts.join(marks, ["file", "block", "row"]).groupBy("file", "offset").agg(F.first("head").alias("head"), F.first("end").alias("end"), F.sort_array(F.collect_list(F.struct("at", "value"))).alias("parts"))
    text = F.array_join(F.transform("parts", lambda p: p.value), MAGIC).cast("binary")
    start = F.octet_length("head") + 4
    return parts.select("file", "offset", F.substring(text, start + 1, (F.col("end") - F.col("offset") - len(MAGIC) - start - 4).cast("int")).alias("payload"))


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, head, payload (binary) of every record."""
    index = common.keep(read_index(spark, path), "index")
    start = F.octet_length("head") + 4
    whole = index.where("not parts").join(_cuts(spark, path), ["file", "block", "row"])
    whole = whole.select("file", "offset", "head", F.substring(F.col("value").cast("binary"), start + 1, (F.col("end") - F.col("offset") - len(MAGIC) - start - 4).cast("int")).alias("payload"))
    return whole.unionByName(index.where("parts").select("file", "offset", "head").join(_put_together(spark, path, index), ["file", "offset"]))


def read_digests(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every record; a stored payload that does not
    match its digest is an error."""
    index = common.keep(read_index(spark, path), "index")
    rows = index.select("file", "offset", "end", "head", "own_digest")
    if not index.where("parts").isEmpty():
        again = _put_together(spark, path, index).select("file", "offset", F.sha1("payload").alias("part_digest"))
        rows = rows.join(again, ["file", "offset"], "left").withColumn("own_digest", F.coalesce("own_digest", "part_digest"))
    kind = F.lower(_field("warc-type"))
    digest = F.regexp_replace(_field("warc-payload-digest"), "^sha1:", "")
    own = F.when((kind == "response") & ~F.col("own_digest").eqNullSafe(digest), F.raise_error(F.concat(F.lit("payload digest differs in "), "file", F.lit(" at "), F.col("offset").cast("string")))).otherwise(digest)
    number = lambda name, pattern=r"([0-9-]+)": F.regexp_extract(_field(name), pattern, 1)
    whole = lambda c: F.when(c != "", c.cast("long"))
    return rows.select(whole(number("x-page-id")).alias("page_id"), whole(number("x-payload-length")).alias("payload_bytes"), own.alias("payload_digest"), kind.alias("record_type"), whole(number("warc-refers-to", r"^<urn:page:([0-9-]+)>")).alias("refers_to"))


def archive(pages: DataFrame) -> DataFrame:
    """Writes the pages as archives in the shared folder and returns what reading them back finds."""
    spark = pages.sparkSession
    path = common.new_path(spark, "warc")
    write_warc(with_revisits(pages), path)
    return read_digests(spark, path)
