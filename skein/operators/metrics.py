"""Multilabel metrics over a long table (doc_id, label_ix, score or probability, y), aggregated where the rows are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def decisions(df: DataFrame, threshold: float = 0.5, k: int = 0) -> DataFrame:
    """df (doc_id, label_ix, p, y) with `predicted`: p at the threshold or above, or among the document's k highest (ties by label)."""
    chosen = F.col("p") >= threshold
    if k:
        place = F.row_number().over(Window.partitionBy("doc_id").orderBy(F.col("p").desc(), "label_ix"))
        chosen = chosen | (place <= k)
    return df.withColumn("predicted", chosen.cast("int"))


def _counts() -> list[Column]:
    return [F.sum(F.col("predicted") * F.col("y")).alias("tp"), F.sum(F.col("predicted") * (1 - F.col("y"))).alias("fp"), F.sum((1 - F.col("predicted")) * F.col("y")).alias("fn")]


def _scores(df: DataFrame) -> DataFrame:
    ratio = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    tp, fp, fn = F.col("tp"), F.col("fp"), F.col("fn")
    return df.withColumn("precision", ratio(tp, tp + fp)).withColumn("recall", ratio(tp, tp + fn)).withColumn("f1", ratio(2 * tp, 2 * tp + fp + fn))


def micro(df: DataFrame) -> DataFrame:
    """One row: precision, recall and f1 over all decisions; 0 where undefined."""
    return _scores(df.agg(*_counts())).select("precision", "recall", "f1")


def per_label(df: DataFrame) -> DataFrame:
    return _scores(df.groupBy("label_ix").agg(*_counts())).select("label_ix", "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"), (F.col("tp") + F.col("fp")).alias("n_predicted"))


def macro_f1(df: DataFrame, support: int = 10) -> DataFrame:
    """One row, macro_f1 over labels with enough positives; null where there are none."""
    return per_label(df).where(F.col("support") >= support).agg(F.avg("f1").alias("macro_f1"))


def report(df: DataFrame) -> DataFrame:
    """(label, precision, recall, f1, support) of each label, and of the averages `micro avg`, `macro avg` and `weighted avg`."""
    rows = per_label(df)
    each = rows.select(F.col("label_ix").cast("string").alias("label"), "precision", "recall", "f1", "support")
    support = F.sum("support").alias("support")
    mean = rows.agg(F.lit("macro avg").alias("label"), *[F.avg(c).alias(c) for c in ("precision", "recall", "f1")], support)
    weighed = rows.agg(F.lit("weighted avg").alias("label"), *[F.coalesce(F.try_divide(F.sum(F.col(c) * F.col("support")), F.sum("support")), F.lit(0.0)).alias(c) for c in ("precision", "recall", "f1")], support)
    all_rows = _scores(df.agg(*_counts())).select(F.lit("micro avg").alias("label"), "precision", "recall", "f1", (F.col("tp") + F.col("fn")).alias("support"))
    return each.unionByName(mean).unionByName(weighed).unionByName(all_rows)


def coverage(df: DataFrame) -> DataFrame:
    """One row: positives, predictions, labels with any prediction."""
    return df.agg(F.sum("y").alias("n_true"), F.sum("predicted").alias("n_predicted"), F.countDistinct(F.when(F.col("predicted") == 1, F.col("label_ix"))).alias("n_labels_predicted"))


def label_ranking_precision(df: DataFrame, score: str = "p") -> DataFrame:
    """One row, lrap: the mean over documents of the mean, over true labels, of the share of true ones among labels ranked as high. Ties share
    the lowest place; documents with no or only true labels score 1."""
    above = Window.partitionBy("doc_id").orderBy(F.col(score).desc()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
    rows = df.withColumn("__rank", F.count(F.lit(1)).over(above)).withColumn("__hits", F.sum("y").over(above))
    docs = rows.groupBy("doc_id").agg(F.avg(F.when(F.col("y") == 1, F.col("__hits") / F.col("__rank"))).alias("a"), F.sum("y").alias("true"), F.count(F.lit(1)).alias("all"))
    return docs.agg(F.avg(F.when((F.col("true") == 0) | (F.col("true") == F.col("all")), F.lit(1.0)).otherwise(F.col("a"))).alias("lrap"))


def micro_average_precision(df: DataFrame, score: str = "p") -> DataFrame:
    """One row, average_precision: recall gained at each distinct score, from the highest, times the precision there.

    Rows are first summed by distinct score, in ranges of the score; only the ranges' totals are summed in one place.
    """
    sums = df.groupBy(score).agg(F.sum("y").alias("__tp"), F.count(F.lit(1)).alias("__n")).withColumn("__range", F.floor(F.col(score) * 1024))
    before = Window.orderBy(F.col("__range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    bases = sums.groupBy("__range").agg(F.sum("__tp").alias("t"), F.sum("__n").alias("n"))
    bases = bases.select("__range", F.coalesce(F.sum("t").over(before), F.lit(0)).alias("__bt"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("__bn"), F.sum("t").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("__all"))
    inside = Window.partitionBy("__range").orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = sums.withColumn("__it", F.sum("__tp").over(inside)).withColumn("__in", F.sum("__n").over(inside)).join(bases, "__range")
    precision = (F.col("__bt") + F.col("__it")) / (F.col("__bn") + F.col("__in"))
    return rows.agg(F.sum(F.try_divide(F.col("__tp"), F.col("__all")) * precision).alias("average_precision"))
