"""Entity labels: universe, index, frequencies, weights, relation filter."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import scores
from skein.operators import catalogue

#: Counts up to this one are replaced by the highest count before weighing.
RARE = 100


def universe(df: DataFrame, **classes: str) -> DataFrame:
    """Distinct (class, entity) over list columns; an entity is its class's first three letters before its id. classes: class=column."""
    parts = [df.select(F.explode(column).alias("__e")).select(F.lit(name).alias("class"), F.concat(F.lit(name[:3]), F.col("__e").cast("string")).alias("entity")) for name, column in classes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out.distinct()


def indexed(entities: DataFrame) -> DataFrame:
    """(class, entity) with entity_ix and class_ix from 0, by class and entity."""
    classes = entities.select("class").distinct().withColumn("class_ix", (F.row_number().over(Window.orderBy("class")) - 1).cast("long"))
    return catalogue.numbered(entities, "class", "entity", "entity_ix").join(classes, "class")


def frequencies(mentions: DataFrame, label: str, doc: str, documents: int | DataFrame) -> DataFrame:
    """(label, frequency): the share of documents with a label, kept within 1e-5 and 1 - 1e-5."""
    n = F.lit(documents) if isinstance(documents, int) else None
    counts = mentions.select(doc, label).distinct().groupBy(label).agg(F.count(F.lit(1)).alias("__n"))
    if n is None:
        counts = counts.crossJoin(F.broadcast(documents.agg(F.count(F.lit(1)).alias("__all"))))  # one row
        n = F.col("__all")
    return counts.select(label, scores.clamped(F.col("__n") / n).alias("frequency"))


def class_weights(tags: DataFrame, tag: str, rare: int = RARE) -> DataFrame:
    """(tag, weight): inverse-log frequencies, scaled to [0, 1], softmaxed, plus 1.

    The total is of the true counts; counts up to `rare` then count as the highest. One row per tag, so the windows over all are small.
    """
    everything = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    counts = tags.groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
    counts = counts.withColumn("total", F.sum("n").over(everything)).withColumn("k", F.count(F.lit(1)).over(everything))
    used = F.when(F.col("n") > rare, F.col("n")).otherwise(F.max("n").over(everything))
    w = counts.withColumn("w", (1 / F.log(used.cast("double"))) * (F.col("total") / F.col("k")))
    low, high = F.min("w").over(everything), F.max("w").over(everything)
    scaled = w.withColumn("s", F.when(high > low, (F.col("w") - low) / (high - low)).otherwise(F.lit(0.0)))
    return scaled.select(tag, (F.exp("s") / F.sum(F.exp("s")).over(everything) + 1).alias("weight"))


def known_relations(relations: DataFrame, entities: DataFrame) -> DataFrame:
    """relations (doc_id, subject, object, label) whose arguments are both in entities (entity)."""
    subjects = entities.select(F.col("entity").alias("subject"))
    objects = entities.select(F.col("entity").alias("object"))
    return relations.join(subjects, "subject", "left_semi").join(objects, "object", "left_semi").select(*relations.columns)


def bias(frequency: DataFrame, label: str, unknown_prior: float | None = None) -> DataFrame:
    """(label, bias): the logit of the clamped frequency, and with a prior a null label's for the unknown slot."""
    out = frequency.select(label, scores.logit(scores.clamped(F.col("frequency"))).alias("bias"))
    if unknown_prior is None:
        return out
    prior = frequency.sparkSession.range(1).select(F.lit(None).cast(frequency.schema[label].dataType).alias(label), scores.logit(F.lit(unknown_prior)).alias("bias"))
    return out.unionByName(prior)


def entity_counts(tags: DataFrame, tag: str) -> DataFrame:
    """Counts of tags that begin with B."""
    return tags.where(F.startswith(tag, F.lit("B"))).groupBy(tag).agg(F.count(F.lit(1)).alias("n"))
