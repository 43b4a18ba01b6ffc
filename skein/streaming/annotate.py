"""Incremental annotation: each run takes the documents that came since the last one, and a replay adds nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import catalogue
from skein.sources import writers


def pending(documents: DataFrame, annotations: DataFrame, annotator: str, key: str = "doc_id") -> DataFrame:
    """Documents that the annotator hasn't annotated."""
    return catalogue.pending(documents, annotations.where(F.col("annotator") == annotator), key)


def run(spark: SparkSession, source: str, columns: str, annotate: Callable[[DataFrame], DataFrame], target: str, checkpoint: str, key: str = "doc_id", files_per_batch: int = 1000) -> int:
    """Annotate what is new in the Parquet folder `source` into the table `target`; returns the number of batches.

    The stream's checkpoint remembers the files that were read. A batch that is run again, after a failure between its write and its commit,
    finds its keys in the table and writes nothing twice. Of repeated keys in a batch the greatest row counts, by its other columns in order.
    """
    stream = spark.readStream.schema(columns).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    batches = []

    def write(batch: DataFrame, number: int) -> None:
        batches.append(number)
        writers.append_new(annotate(catalogue.latest(batch, key)), target, key)

    query = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return len(batches)


def windowed_counts(stream: DataFrame, time: str, group: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by window and group of a stream or table; rows later than `late` behind the newest are dropped from streams."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width), group).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), group, "n")
