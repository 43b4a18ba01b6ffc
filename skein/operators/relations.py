"""Entity pairs within documents, their gold labels, pooled representations and scores."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def log_sum_exp(df: DataFrame, keys: list[str], value: str, mean: bool = False) -> DataFrame:
    """keys with the stable log-sum-exp of value, or with `mean` log-mean-exp. The maximum and the sum are two aggregations on one partitioning."""
    top = df.groupBy(*keys).agg(F.max(value).alias("__top"), F.count(value).alias("__n"))
    joined = df.join(top, keys)
    out = joined.groupBy(*keys).agg(F.max("__top").alias("__top"), F.max("__n").alias("__n"), F.sum(F.exp(F.col(value) - F.col("__top"))).alias("__sum"))
    pooled = F.col("__top") + F.log("__sum")
    return out.select(*keys, (pooled - F.log("__n") if mean else pooled).alias(value))


def pooled(df: DataFrame, keys: list[str], value: str, how: str) -> DataFrame:
    """keys with value pooled by max, mean, logsumexp or logmeanexp."""
    if how in ("logsumexp", "logmeanexp"):
        return log_sum_exp(df, keys, value, mean=how == "logmeanexp")
    if how not in ("max", "mean"):
        raise ValueError(f"no such pooling: {how}")
    return df.groupBy(*keys).agg((F.max(value) if how == "max" else F.avg(value)).alias(value))


def by_component(df: DataFrame, vector: str) -> DataFrame:
    """A row for each component: `component` and `value` in place of the vector."""
    return df.select("*", F.posexplode(vector).alias("component", "value")).drop(vector).withColumn("value", F.col("value").cast("double"))


def vectors(df: DataFrame, keys: list[str], value: str = "value") -> DataFrame:
    """Components gathered again, in order."""
    ordered = F.array_sort(F.collect_list(F.struct("component", value)))
    return df.groupBy(*keys).agg(F.transform(ordered, lambda c: c[value]).alias("vector"))


def attention_pooled(df: DataFrame, keys: list[str], logit: str, vector: str) -> DataFrame:
    """keys with the mean of vector weighed by the softmax of logit over each group's rows."""
    top = df.groupBy(*keys).agg(F.max(logit).alias("__top"))
    weighed = df.join(top, keys).withColumn("__w", F.exp(F.col(logit) - F.col("__top")))
    long = weighed.select(*keys, "__w", F.posexplode(vector).alias("component", "__x"))
    return long.groupBy(*keys, "component").agg((F.sum(F.col("__w") * F.col("__x").cast("double")) / F.sum("__w")).alias("value"))


def entity_pairs(mentions: DataFrame, doc: str, entity: str) -> DataFrame:
    """(doc, i, j), i < j: unordered pairs of a document's distinct entities. The join is on the document, a few entities each."""
    rows = mentions.select(doc, entity).where(F.col(entity).isNotNull()).distinct()
    a, b = rows.select(doc, F.col(entity).alias("i")), rows.select(doc, F.col(entity).alias("j"))
    return a.join(b, doc).where("i < j")


def gold_targets(pairs: DataFrame, gold: DataFrame, keys: list[str], label: str, position: str, none: Column) -> DataFrame:
    """pairs with `target`: the first gold label that isn't none, else the first, else none."""
    first = F.min_by(F.when(F.col(label) != none, F.col(label)), F.when(F.col(label) != none, F.col(position)))
    best = gold.groupBy(*keys).agg(F.coalesce(first, F.min_by(label, position)).alias("target"))
    return pairs.join(best, keys, "left").withColumn("target", F.coalesce("target", none))


def last_gold_targets(pairs: DataFrame, gold: DataFrame, keys: list[str], label: str, position: str, none: Column) -> DataFrame:
    """pairs with `target`: the last gold label, else none; gold of no pair is left out, as in evaluation on found pairs."""
    best = gold.groupBy(*keys).agg(F.max_by(label, position).alias("target"))
    return pairs.join(best, keys, "left").withColumn("target", F.coalesce("target", none))


def first_relations(df: DataFrame, doc: str, relations: str) -> DataFrame:
    """(doc, subject, object, label) of the first map in an array<map<struct<subject, object>, array<double>>>; the label is the first maximum."""
    pair = df.select(doc, F.explode(F.get(F.col(relations), F.lit(0))).alias("pair", "scores"))
    return pair.select(doc, "pair.subject", "pair.object", (F.array_position("scores", F.array_max("scores")) - 1).cast("int").alias("label"))


def with_missing_golds(scored: DataFrame, gold: DataFrame, keys: list[str], none: Column) -> DataFrame:
    """scored (keys, target, predicted) and, for documents of gold without any scored pair, their golds predicted as none."""
    doc = keys[0]
    missing = gold.join(scored.select(doc).distinct(), doc, "left_anti").select(*keys, F.col("label").alias("target"), none.alias("predicted"))
    return scored.select(*keys, "target", "predicted").unionByName(missing)


def gelu(x: np.ndarray) -> np.ndarray:
    from math import erf

    return 0.5 * x * (1 + np.vectorize(erf, otypes=[float])(x / np.sqrt(2)))


def biaffine(x: Column, y: Column, weights: dict[str, np.ndarray]) -> Column:
    """Scores of pairs of vectors: both through one GELU layer (hidden_w, hidden_b; with hidden_w_y, hidden_b_y y has its own), then
    x R y (bilinear, relations x hidden x hidden) + (linear_w [x; y] + linear_b) + bias."""

    @F.pandas_udf("array<double>")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype=object)
        h = gelu(np.stack(a) @ weights["hidden_w"].T + weights["hidden_b"])
        k = gelu(np.stack(b) @ weights.get("hidden_w_y", weights["hidden_w"]).T + weights.get("hidden_b_y", weights["hidden_b"]))
        out = np.einsum("bi,rij,bj->br", h, weights["bilinear"], k) + np.concatenate([h, k], 1) @ weights["linear_w"].T + weights["linear_b"] + weights["bias"]
        return pd.Series(list(out))

    return run(x, y)


def entity_vectors(mentions: DataFrame, doc: str, entity: str, vector: str) -> DataFrame:
    """(doc, entity, vector): the log-sum-exp of an entity's mention vectors, component by component."""
    keys = [doc, entity]
    return vectors(pooled(by_component(mentions.select(*keys, vector), vector), [*keys, "component"], "value", "logsumexp"), keys)


def pair_candidates(mentions: DataFrame, doc: str, entity: str, vector: str) -> DataFrame:
    """(doc, i, j, x, y): the pairs of a document's entities, i < j, with their pooled vectors. Null entities don't count."""
    own = entity_vectors(mentions.where(F.col(entity).isNotNull()), doc, entity, vector)
    first = own.select(doc, F.col(entity).alias("i"), F.col("vector").alias("x"))
    return first.join(own.select(doc, F.col(entity).alias("j"), F.col("vector").alias("y")), doc).where("i < j")


def pair_logits(mentions: DataFrame, doc: str, entity: str, vector: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """(doc, i, j, logits) of all pairs of a document's entities."""
    return pair_candidates(mentions, doc, entity, vector).select(doc, "i", "j", biaffine(F.col("x"), F.col("y"), weights).alias("logits"))


def gold_logits(gold: DataFrame, tokens: DataFrame, doc: str, entity: str, logit: str, vector: str, weights: dict[str, np.ndarray]) -> DataFrame:
    """gold (doc, subject, object and others) with `logits`, from vectors that attention over a document's tokens pools for each argument.

    tokens (doc, entity, logit, vector) has a row for each token and entity that it may be of. Only arguments that gold names are pooled; a relation
    with an argument that the document's tokens don't have goes.
    """
    needed = gold.select(doc, F.explode(F.array("subject", "object")).alias(entity)).distinct()
    soft = vectors(attention_pooled(tokens.join(needed, [doc, entity], "left_semi"), [doc, entity], logit, vector), [doc, entity])
    x = soft.select(doc, F.col(entity).alias("subject"), F.col("vector").alias("__x"))
    y = soft.select(doc, F.col(entity).alias("object"), F.col("vector").alias("__y"))
    return gold.join(x, [doc, "subject"]).join(y, [doc, "object"]).select(*gold.columns, biaffine(F.col("__x"), F.col("__y"), weights).alias("logits"))


def consistency_penalty(entity_scores: DataFrame, class_scores: DataFrame, entities: DataFrame, weight: float = 1.0) -> DataFrame:
    """One row, penalty: the mean over (doc, entity) of sigmoid(entity) * (1 - sigmoid(its class)); 0 for a weight of 0 or less.

    entity_scores (doc_id, entity_ix, logit), class_scores (doc_id, class_ix, logit), entities (entity_ix, class_ix). Unknown entities and
    classes outside `entities` don't count.
    """
    from skein.functions import scores

    if weight <= 0:
        return entity_scores.agg(F.lit(0.0).alias("penalty"))
    rows = entity_scores.join(entities, "entity_ix").join(class_scores.withColumnRenamed("logit", "class_logit"), ["doc_id", "class_ix"])
    return rows.agg(F.avg(scores.sigmoid(F.col("logit")) * (1 - scores.sigmoid(F.col("class_logit")))).alias("penalty"))
