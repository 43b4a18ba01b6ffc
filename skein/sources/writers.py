"""Writers. Keyed writes are idempotent: what is there already is left out, so a repeated run adds nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import catalogue


def exists(spark: SparkSession, path: str) -> bool:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop)


def append_csv(df: DataFrame, path: str) -> None:
    """Each part file has its header; readers with `header` see one table."""
    df.write.mode("append").option("header", True).csv(path)


def overwrite_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def append_json(df: DataFrame, path: str) -> None:
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("append").text(path)


def append_new(df: DataFrame, path: str, key: str, force: bool = False) -> None:
    """Zstandard Parquet: rows whose key the table lacks; with force, rows replace those of their keys."""
    spark = df.sparkSession
    if not exists(spark, path):
        df.write.option("compression", "zstd").parquet(path)
    elif force:
        upsert(df, path, key)
    else:
        catalogue.pending(df, spark.read.parquet(path), key).write.mode("append").option("compression", "zstd").parquet(path)


def upsert(df: DataFrame, path: str, key: str) -> None:
    """The table at path with df's rows in place of those of their keys. One writer at a time.

    The new table is written whole beside the old one, which steps aside before the new one takes its place. A run that breaks off leaves one of
    them whole, and the next upsert, or recover(), puts it back.
    """
    spark = df.sparkSession
    recover(spark, path)
    if not exists(spark, path):
        df.write.parquet(path)
        return
    new, old = f"{path}.next", f"{path}.before"
    catalogue.upserted(spark.read.parquet(path), df, key).write.mode("overwrite").parquet(new)
    move(spark, path, old)
    move(spark, new, path)
    remove(spark, old)
    spark.catalog.refreshByPath(path)


def recover(spark: SparkSession, path: str) -> None:
    """End an upsert that broke off. The old table steps aside only when the new one is whole."""
    old = f"{path}.before"
    if exists(spark, old):
        if not exists(spark, path):
            move(spark, f"{path}.next", path)
        remove(spark, old)


def move(spark: SparkSession, source: str, target: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path
    if not hadoop(source).getFileSystem(spark._jsc.hadoopConfiguration()).rename(hadoop(source), hadoop(target)):
        raise OSError(f"{source} can't be renamed to {target}")


def remove(spark: SparkSession, path: str) -> None:
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def clear(spark: SparkSession, path: str) -> None:
    """All rows go; the schema stays."""
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.write.mode("overwrite").parquet(path)


def log_metrics(spark: SparkSession, path: str, config: dict, **metrics: float) -> None:
    """One row of settings and metrics, appended."""
    spark.createDataFrame([config | metrics]).write.mode("append").parquet(path)


def packed(df: DataFrame, vector: str) -> DataFrame:
    """Vectors as arrays of float, which Parquet's own encodings and zstandard compress."""
    return df.withColumn(vector, F.transform(vector, lambda x: x.cast("float")))
