"""Bibliography and curation: joins, lookups, membership, dedup and upserts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def star_join(fact: DataFrame, *dimensions: tuple[DataFrame, str, str]) -> DataFrame:
    """fact inner-joined with (dimension, fact's column, dimension's column), in turn. Small dimensions are broadcast by their measured size."""
    for dimension, left, right in dimensions:
        fact = fact.join(dimension, fact[left] == dimension[right])
    return fact


def merged_records(df: DataFrame, *tables: tuple[str, list[str]]) -> DataFrame:
    """One wide record from (prefix, columns) groups named `prefix_column`; of equal column names the last table's wins."""
    last: dict[str, str] = {}
    for prefix, columns in tables:
        for column in columns:
            last[column] = f"{prefix}_{column}"
    return df.select(*[F.col(source).alias(name) for name, source in last.items()])


def lookup(df: DataFrame, table: DataFrame, key: str, value: str, default: str = "") -> DataFrame:
    """df with table's value of its key, or default. table has one row per key."""
    return df.join(table.select(key, value), key, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def pending(df: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """df's rows whose key isn't among done's."""
    return df.join(done.select(key), key, "left_anti")


def known(df: DataFrame, values: DataFrame, key: str) -> DataFrame:
    return df.join(values.select(key), key, "left_semi")


def keep_first(df: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in order; rows with a null key go. The least row is found by an aggregation, with map-side combining."""
    others = [c for c in df.columns if c not in (*order, key)]
    least = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(F.struct(*order, *others)).alias("row"))
    return least.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """old and new together; where both have a key, new's row."""
    a, b = old.select(key, F.struct(*old.columns).alias("old")), new.select(key, F.struct(*old.columns).alias("new"))
    return a.join(b, key, "full_outer").select(F.coalesce("new", "old").alias("row")).select("row.*")


def latest(df: DataFrame, key: str, *version: str) -> DataFrame:
    """The row of each key with the highest version."""
    rest = [c for c in df.columns if c not in (key, *version)]
    top = df.groupBy(key).agg(F.max(F.struct(*version, *rest)).alias("row"))
    return top.select(*[F.col(key) if c == key else F.col(f"row.{c}").alias(c) for c in df.columns])


def numbered(df: DataFrame, group: str, key: str, name: str) -> DataFrame:
    """df's rows numbered from 0 by (group, key): a window inside each group, on top of the sizes of the groups before it."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy(group).rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select(group, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy(group).orderBy(key)) - 1
    return df.withColumn("__i", inside).join(sizes, group).withColumn(name, (F.col("__base") + F.col("__i")).cast("long")).drop("__i", "__base")


def has_error(text: Column, marker: str) -> Column:
    return F.contains(text, F.lit(marker))


def without(df: DataFrame, *columns: str) -> DataFrame:
    return df.drop(*columns)


def spread(df: DataFrame) -> DataFrame:
    """df over as many partitions as there are cores, for work in Python that costs far more than a shuffle; a table of more partitions stays."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


#: Bounds of an Arrow batch of texts or tokens, of which a worker holds several forms at once. Spark's own, 10,000 rows and 64 MB, let it outgrow its memory.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 2000, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20}


def batched(df: DataFrame) -> DataFrame:
    """df, its session's Arrow batches held to BATCH. Spark reads these settings when a plan runs, so the session keeps them; smaller ones stay."""
    spark = df.sparkSession
    number = spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes
    for key, most in BATCH.items():
        if not 0 < number(spark.conf.get(key)) <= most:
            spark.conf.set(key, str(most))
    return df
