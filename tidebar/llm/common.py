"""Shared helpers: the folder all executors see, materialised tables, connected components."""

from __future__ import annotations

import gc
import re
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir. Where that is unset, one of our own, but only in local mode, as no other
    executor would see it."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        app = spark.sparkContext.applicationId
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="tidebar-")
        path = _OWN[app]
    return path.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def keep(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    kept = spark.read.schema(df.schema).parquet(path)
    kept.kept_at = path
    return kept


def release(*tables: DataFrame) -> None:
    """Deletes the files of kept tables that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(table.kept_at)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def forget_shuffles(spark: SparkSession) -> None:
    """Spark deletes the files of a shuffle once the driver's collector has found that nothing refers to it. Asking for that
    after a large shuffle whose result is kept frees its disk for what comes next."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slices(batches: Iterator[pa.RecordBatch], text: int, rows: int = 512, size: int = 8_000_000) -> Iterator[pa.RecordBatch]:
    """The batches cut to at most so many rows and, by the column numbered text, so many bytes of text; one row at least.
    So what a task holds beside a batch does not depend on the session's batch size, nor on how long texts are."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False)
        upto, at = np.cumsum(lengths), 0
        while at < batch.num_rows:
            before = upto[at - 1] if at else 0
            end = max(at + 1, min(at + rows, int(np.searchsorted(upto, before + size, "right"))))
            yield batch.slice(at, end - at)
            at = end


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def connected_components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected links: alternating large-star and small-star steps.

    Each step is one groupBy with partial aggregation and one join with a row per node. The rows of a node with very many
    neighbours, as the root of a large component is, are split by Spark's adaptive skew join. The table is rewritten to
    the shared folder after each round, and the one before it deleted. root is the least node of the component."""
    edges = links.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v").dropDuplicates()
    edges = keep(edges, "edges")
    before = None
    for _ in range(rounds):
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        # large star: each larger neighbour of u goes to u's least neighbour
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").dropDuplicates()
        # small star: u and its smaller neighbours go to the least of them
        large = keep(large, "large")
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        small = small.select(F.col("v").alias("u"), F.col("m").alias("v")).union(small.select("u", F.col("m").alias("v")))
        old, edges = edges, keep(small.where("u <> v").dropDuplicates(), "small")
        release(old, large)
        # stable once each u has one v and the number and sum no longer change
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(now) == before:
            break
        before = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root"))).dropDuplicates()
