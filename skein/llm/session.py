"""Shared folder, fixed-size filters and links into classes."""

from __future__ import annotations

import ctypes
import re
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a temporary folder in local mode, else an error."""
    context = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="skein-")
    if not context.getCheckpointDir():
        context.setCheckpointDir(folder)
    return folder.rstrip("/")


def checkpoint(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and cut from its lineage."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


#: Bounds of an Arrow batch of whole texts. Spark's own, 10,000 rows and 64 MB, let a batch of long texts outgrow a worker.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 1500, "spark.sql.execution.arrow.maxBytesPerBatch": 16 << 20}


def documents(df: DataFrame, batch: dict[str, int] = BATCH) -> DataFrame:
    """df, its session's Arrow batches held to `batch`, for stages that take whole texts to Python workers. Spark reads these settings when a
    plan runs, so the session keeps them; smaller ones stay as they are."""
    spark = df.sparkSession
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in batch.items():
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return df


def release() -> None:
    """Give back to the system what this process has free: the C library and Arrow keep the memory of the arrays that were dropped."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):  # glibc only
        trim(0)


def released(run):
    """run, a function for mapInArrow, whose worker gives back to the system what it has free at a partition's end, as Spark
    keeps idle workers."""

    def rows(batches):
        try:
            yield from run(batches)
        finally:
            release()

    return rows


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/skein-{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> tuple[DataFrame, str]:
    """df, written as Parquet to the shared folder, and where: for remove() when nothing reads it any more."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path), path


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder of new_path that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slot(column: Column, bits: int) -> Column:
    return F.expr("int(0)") if not bits else F.shiftrightunsigned(F.xxhash64(column), 64 - bits).cast("int")


def may_contain(df: DataFrame, key: str, members: DataFrame, bits: int = 20) -> tuple[DataFrame, DataFrame]:
    """Rows of df whose key may be among members' (all that are, and a few more), and the other rows.

    The filter is a set of at most 2**bits hash slots, so what is broadcast has a fixed bound. Null keys may be members.
    """
    slots = members.select(slot(F.col(key), bits).alias("__slot")).distinct()
    tagged = df.withColumn("__slot", slot(F.col(key), bits))
    return (tagged.join(F.broadcast(slots), "__slot", "left_semi").drop("__slot"), tagged.join(F.broadcast(slots), "__slot", "left_anti").drop("__slot"))


def bitmap(df: DataFrame, place: Column, bits: int) -> bytes:
    """A bit for each value of place, below 2**bits: a filter of fixed size. The driver gets 2**bits / 8 bytes at most."""
    place = place + 1  # the functions count from 1
    parts = df.groupBy(F.bitmap_bucket_number(place).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("part")).collect()
    out = bytearray(1 << (bits - 3))
    for part in parts:
        at = (part["bucket"] - 1) * len(part["part"])
        out[at : at + len(part["part"])] = part["part"]
    return bytes(out[: 1 << (bits - 3)])


def classes(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): the smallest node reachable from it.

    Alternating large-star and small-star steps over the table of links; each step is a map-side combined
    aggregation and a join, so a node with very many links never has them gathered in one place. It ends when a step changes nothing.
    """
    edges = checkpoint(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct())
    while True:
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        # large star: each larger neighbour to the least neighbour
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: each smaller neighbour, and the node, to the least one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.explode(F.array("u", "v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        after = checkpoint(small)
        if not after.exceptAll(edges).take(1) and after.count() == edges.count():
            break
        edges = after
    roots = edges.groupBy("u").agg(F.min("v").alias("root")).withColumnRenamed("u", "node")
    return roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
