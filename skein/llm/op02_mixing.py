"""Mixing sources to target weights, in DataFrame operations only.

Every document gets a hash-random key. Within a source, documents stand in order of key; hash ranges of the key
(buckets) are summed first, so the prefix sum of word counts is a bucket's base plus a sum within the bucket, and no
source, however large, is ever in one task. Each source is cut at its exact budget; whole epochs repeat before the cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import session

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (3, 1, 2)
SHARE = 1.5
EPOCHS = 2
#: Hex digits of the key that name its bucket; 4096 buckets a source.
BUCKET_DIGITS = 3


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """sizes (source, source_size) with source_no long from 0, weight and target.

    Sources by code point, null last, weigh `weights` in turn and share `share` of all words; a source's target stops at
    `epochs` times its size and the excess goes to the others by weight. In order of size to weight, a source is held to
    its limit if its share of what the ones before have left is above it. One row per source.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    rows = sizes.withColumn("source_no", (F.row_number().over(order) - 1).cast("long"))
    rows = rows.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("source_no") % len(weights) + 1).cast("int")).cast("long"))
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filled = Window.orderBy(F.col("source_size") / F.col("weight"), "source_no").rowsBetween(Window.unboundedPreceding, -1)
    limit = F.col("source_size") * epochs
    rows = rows.withColumn("money", F.lit(share) * F.sum("source_size").over(everything)).withColumn("all_weight", F.sum("weight").over(everything))
    rows = rows.withColumn("left", F.col("money") - F.coalesce(F.sum(limit).over(filled), F.lit(0))).withColumn("left_weight", F.col("all_weight") - F.coalesce(F.sum("weight").over(filled), F.lit(0)))
    rows = rows.withColumn("held", F.col("left") * F.col("weight") > limit * F.col("left_weight"))
    rows = rows.withColumn("open_money", F.col("money") - F.coalesce(F.sum(F.when(F.col("held"), limit)).over(everything), F.lit(0)))
    rows = rows.withColumn("open_weight", F.col("all_weight") - F.coalesce(F.sum(F.when(F.col("held"), F.col("weight"))).over(everything), F.lit(0)))
    target = F.when(F.col("held"), limit.cast("double")).otherwise(F.col("open_money") * F.col("weight") / F.col("open_weight"))
    return rows.select("source", "source_no", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """doc_id, source, size, source_size, target, taken, and how it was taken: key, whole (epochs), part (words of the last, cut epoch).

    docs needs doc_id, text and source; other columns are ignored. Null text: size 0. Null source: a source of its own.
    Null doc_id: a document like any other. Rows with one doc_id stand in order of size, so equal rows are interchangeable
    and reruns agree. A source of size 0 has target 0. An empty table gives no rows.
    """
    rows = docs.select("doc_id", "source", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    rows = session.checkpoint(rows.withColumn("key", F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15)))
    sources = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, epochs).withColumnRenamed("source", "__source")
    budget = F.floor("target").cast("long")
    sources = sources.withColumn("whole", F.coalesce(F.try_divide(budget, F.col("source_size")), F.lit(0)).cast("long"))
    sources = session.checkpoint(sources.withColumn("rest", budget - F.col("whole") * F.col("source_size")))
    rows = rows.join(sources, F.col("source").eqNullSafe(F.col("__source"))).withColumn("bucket", F.substring("key", 1, BUCKET_DIGITS))
    before = Window.partitionBy("source_no").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    bases = rows.groupBy("source_no", "bucket").agg(F.sum("size").alias("words")).select("source_no", "bucket", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("source_no", "bucket").orderBy("key", F.col("doc_id").asc_nulls_first(), "size").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0))).join(bases, ["source_no", "bucket"])
    part = F.greatest(F.lit(0), F.least(F.col("size"), F.col("rest") - F.col("base") - F.col("inner")))
    return rows.select("doc_id", "source", "size", "source_size", "target", (F.col("whole") * F.col("size") + part).alias("taken"), "key", "whole", part.alias("part"))


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The documents of the mix: each of docs' rows as many times as it is taken, the last one of a source whole.

    Keeps docs' columns. What is taken is a condition on a row's key and its source's cut, so texts aren't shuffled:
    the sources' cuts, a row per source, are joined to docs. A document without words goes with the documents around it.
    """
    rows = mix(docs, **options)
    place = F.struct("key", F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), "size")
    cuts = rows.groupBy(F.col("source").alias("__source")).agg(F.max("whole").alias("__whole"), F.max(F.when(F.col("part") > 0, place)).alias("__cut"))
    cuts = session.checkpoint(cuts)
    own = F.struct(F.substring(F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 1, 15).alias("key"), F.coalesce("doc_id", F.lit(-(1 << 63))).alias("id"), F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long").alias("size"))
    joined = docs.join(cuts, F.col("source").eqNullSafe(F.col("__source")))
    times = F.col("__whole") + F.coalesce((own <= F.col("__cut")).cast("long"), F.lit(0))
    return joined.withColumn("__n", times).where("__n > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__n")))).select(*docs.columns)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "size", "source_size", "target", "taken")


OP2_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS key
  FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS no
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE no % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, 1.5::DOUBLE * CAST(sum(source_size) OVER () AS DOUBLE) AS money FROM s
), l AS (
  SELECT *, sum(weight) OVER () AS all_weight,
         money - CAST(coalesce(sum(2 * source_size) OVER f, 0) AS DOUBLE) AS rest,
         sum(weight) OVER () - coalesce(sum(weight) OVER f, 0) AS rest_weight
  FROM w WINDOW f AS (ORDER BY CAST(source_size AS DOUBLE) / weight, no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), h AS (
  SELECT *, rest * CAST(weight AS DOUBLE) > CAST(2 * source_size AS DOUBLE) * CAST(rest_weight AS DOUBLE) AS held FROM l
), t AS (
  SELECT source, source_size, CASE WHEN held THEN CAST(2 * source_size AS DOUBLE)
    ELSE (money - CAST(coalesce(sum(CASE WHEN held THEN 2 * source_size END) OVER (), 0) AS DOUBLE)) * CAST(weight AS DOUBLE)
         / CAST(all_weight - coalesce(sum(CASE WHEN held THEN weight END) OVER (), 0) AS DOUBLE) END AS target
  FROM h
), r AS (
  SELECT doc_id, size, source_size, target, CAST(floor(target) AS BIGINT) AS budget,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id NULLS FIRST, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       CAST(CASE WHEN source_size = 0 THEN 0 ELSE (budget // source_size) * size
         + greatest(0, least(size, budget % source_size - before)) END AS BIGINT) AS taken
FROM r
"""
