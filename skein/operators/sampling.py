"""Deterministic sampling: hash order in place of random generators."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42


def hash_order(key: str | Column, seed: int = SEED) -> Column:
    """A portable pseudo-random order: the md5 of seed and key."""
    key = F.col(key) if isinstance(key, str) else key
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def length_limited(df: DataFrame, length: str, most: int = 1000) -> DataFrame:
    """Rows strictly under the limit."""
    return df.where(F.col(length) < most)


def limited(df: DataFrame, key: str, n: int = 0) -> DataFrame:
    """The n rows of least key, all of them for 0."""
    return df.orderBy(key).limit(n) if n else df


def batches(df: DataFrame, key: str, size: int, seed: int = SEED) -> DataFrame:
    """df with `batch` and `slot` from 0: rows without replacement in hash order, `size` a batch, the last one as it comes.

    Places come from sums over 4096 ranges of the hash and windows inside them, so no task holds all rows.
    """
    rows = df.withColumn("__h", hash_order(key, seed)).withColumn("__r", F.substring("__h", 1, 3))
    before = Window.orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("__r").agg(F.count(F.lit(1)).alias("n")).select("__r", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__base"))
    inside = F.row_number().over(Window.partitionBy("__r").orderBy("__h", key)) - 1
    rows = rows.withColumn("__i", inside).join(bases, "__r").withColumn("__i", F.col("__i") + F.col("__base"))
    return rows.withColumn("batch", F.floor(F.col("__i") / size).cast("long")).withColumn("slot", (F.col("__i") % size).cast("long")).drop("__h", "__r", "__i", "__base")


def upsampled(df: DataFrame, key: str, label: str, wanted: str, seed: int = SEED) -> DataFrame:
    """df, and copies of rows of label `wanted`, drawn with replacement, up to the count of the most common label. `copy` is 0 for df's own rows.

    The n-th copy is of the donor whose number is a hash of n, modulo the donors.
    """
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.max(F.when(F.col(label) == wanted, F.col("n"))).alias("own"))
    donors = batches(df.where(F.col(label) == wanted), key, 1 << 62, seed).withColumnRenamed("slot", "__slot").drop("batch")
    draws = counts.where("own is not null and most > own").select(F.explode(F.sequence(F.lit(1).cast("long"), F.col("most") - F.col("own"))).alias("copy"), "own")
    draws = draws.withColumn("__slot", F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), F.col("copy").cast("string"))), 1, 8), 16, 10).cast("long") % F.col("own")).drop("own")
    return df.withColumn("copy", F.lit(0).cast("long")).unionByName(draws.join(donors, "__slot").drop("__slot").select(*df.columns, "copy"))


def grid(spark, **choices) -> DataFrame:
    """All combinations of the choices, a row each."""
    return spark.createDataFrame(list(itertools.product(*choices.values())), list(choices))


def sampled_grid(df: DataFrame, n: int, seed: int = SEED) -> DataFrame:
    """n rows without replacement, in hash order of the whole row; fails if there are fewer."""
    if df.count() < n:
        raise ValueError(f"fewer than {n} rows")
    key = F.concat_ws("|", *[F.col(c).cast("string") for c in df.columns])
    return df.withColumn("__h", hash_order(key, seed)).orderBy("__h", *df.columns).limit(n).drop("__h")


def most_common(df: DataFrame, group: str, value: str, position: str) -> DataFrame:
    """(group, value) that occurs most often; the one seen first wins ties."""
    counts = df.groupBy(group, value).agg(F.count(F.lit(1)).alias("n"), F.min(position).alias("first"))
    return counts.groupBy(group).agg(F.max_by(value, F.struct("n", -F.col("first"))).alias(value))
