"""Reports over hyperparameter logs: summaries, regression, early stopping."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def five_numbers(df: DataFrame, value: str, *columns: str) -> DataFrame:
    """(parameter, setting, n, low, q1, middle, q3, high): the value's quantiles for each setting of each column."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("parameter"), F.col(c).cast("string").alias("setting")) for c in columns])).alias("p")
    q = F.percentile(value, F.array(*map(F.lit, (0.0, 0.25, 0.5, 0.75, 1.0)))).alias("q")
    out = df.select(value, pairs).groupBy("p.parameter", "p.setting").agg(F.count(value).alias("n"), q)
    return out.select("parameter", "setting", "n", *[F.col("q")[i].alias(name) for i, name in enumerate(("low", "q1", "middle", "q3", "high"))])


def at_most(df: DataFrame, value: str, most: float = 0.15) -> DataFrame:
    """Rows up to the threshold; nulls go."""
    return df.where(F.col(value) <= most)


def regression(df: DataFrame, formula: str):
    """Fitted linear model of an R formula with interactions; its summary has r2. Coefficients of a rank-deficient design aren't unique."""
    from pyspark.ml.feature import RFormula
    from pyspark.ml.regression import LinearRegression

    return LinearRegression(solver="normal").fit(RFormula(formula=formula).fit(df).transform(df))


def simple_regression(df: DataFrame, y: str, x: str) -> DataFrame:
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"), F.regr_r2(y, x).alias("r2"))


def early_stopping(losses: DataFrame, run: str, epoch: str, loss: str, patience: int, ramp: int = 0) -> DataFrame:
    """losses with best (so far), counter and stop: epochs since the last one at or below the best; stop above patience.

    Each epoch of the ramp starts its count anew, so a miss there counts one at most. One run's epochs are one window.
    """
    by = Window.partitionBy(run).orderBy(epoch)
    so_far = by.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = losses.withColumn("best", F.min(loss).over(so_far))
    better = F.col(loss) <= F.coalesce(F.min(loss).over(by.rowsBetween(Window.unboundedPreceding, -1)), F.col(loss))
    rows = rows.withColumn("__n", F.row_number().over(by)).withColumn("__reset", F.when(better, F.col("__n")).when(F.col(epoch) <= ramp, F.col("__n") - 1))
    last = F.coalesce(F.max("__reset").over(so_far), F.lit(0))
    return rows.withColumn("counter", (F.col("__n") - last).cast("int")).withColumn("stop", F.col("counter") > patience).drop("__n", "__reset")


def loss_means(log: DataFrame, epoch: str = "epoch", objective: str = "objective", loss: str = "loss") -> DataFrame:
    """Mean loss of each objective and epoch, and their sum per epoch as objective `total`."""
    means = log.groupBy(epoch, objective).agg(F.avg(loss).alias("mean_loss"))
    total = means.groupBy(epoch).agg(F.sum("mean_loss").alias("mean_loss")).select(epoch, F.lit("total").alias(objective), "mean_loss")
    return means.unionByName(total)
