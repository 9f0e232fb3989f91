"""The corpus pipeline: toxic documents go, one of each group of near copies stays, personal data is removed, and what
is left is packed into sequences. Each stage works on all that the stage before it kept.

Defined cases: an empty table passes through every stage; null texts are empty, and so are never toxic nor near copies;
rows with a null id are treated like others; rows with the same id and different texts are different documents, and rows
repeated with id and text count as one, which the second stage leaves once; ties between near copies go to the least id,
null ids last; columns of `documents` are kept by all stages but the last, and others are ignored. SQL cannot express the trained classifier, so there is no twin of
the whole run; tests hold it against a brute-force version."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidebar.llm import common, ngram_join, packing, pii, toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: The score from which a document is rejected. Higher than the classifier's own threshold, so that clean documents stay.
REJECT = 0.5


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the toxicity operator scores REJECT or more."""
    docs = docs.select(*COLUMNS)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    model = toxicity.train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.where(~toxicity.held_out()))
    return toxicity.score(docs, model, keep=COLUMNS).where(F.col("score") < REJECT).select(*COLUMNS)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the least id of each group of near copies, and all that are in none."""
    docs = docs.select(*COLUMNS)
    key = F.xxhash64(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")))
    keyed = docs.select(key.alias("row_key"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    found = ngram_join.near_classes(keyed, id_col="row_key").select(F.col("doc_id").alias("row_key"), "component_id").distinct()
    named = common.keep(found.join(keyed.select("row_key", "doc_id"), "row_key").groupBy("row_key", "component_id").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("times")), "named")
    first = named.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "row_key"))["row_key"].alias("stays"))
    gone = common.keep(named.join(first, "component_id").where("row_key <> stays").select("row_key"), "gone")
    again = common.keep(named.where("times > 1").select("row_key"), "again")
    rows = docs.withColumn("row_key", key).join(gone, "row_key", "left_anti")
    if not again.isEmpty():
        rows = rows.join(again, "row_key", "left_anti").unionByName(rows.join(again, "row_key", "left_semi").dropDuplicates(["row_key"]))
    return rows.select(*COLUMNS)


def without_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data, and terms that disclose it, in every text."""
    return pii.redact(docs.select(*COLUMNS))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of every piece of every document in the sequences."""
    return packing.pack_documents(docs.select(*COLUMNS))


STAGES = [("toxicity", without_toxic), ("ngram_join", one_of_each_group), ("personal_data", without_personal_data), ("packing", packed)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written as Parquet to the shared folder and read again."""
    docs = common.documents(spark, sf_dir)
    for name, stage in STAGES:
        docs = common.keep(stage(spark, docs, sf_dir), name)
    return docs
