"""From documents to labelled datasets, and from segment scores back to annotated documents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein import schema
from skein.functions import scores, text
from skein.operators import catalogue, labels, metrics, tokens


def encoded(docs: DataFrame, pieces: Column, key: str = "doc_id", max_length: int = 512, stride: int = 20) -> DataFrame:
    """(key, segment, tokens, attention_mask): a row for each overlapping window of a document's pieces, specials at both ends."""
    cut = docs.select(key, F.posexplode(tokens.segments(pieces, max_length, stride)).alias("segment", "window"))
    whole = F.concat(F.array(F.lit("[CLS]")), "window", F.array(F.lit("[SEP]")))
    return cut.select(key, "segment", whole.alias("tokens"), tokens.attention_mask(F.col("window"), max_length).alias("attention_mask"))


def multi_get(store: DataFrame, wanted: DataFrame, key: str = "doc_id", batch: str = "batch", place: str = "slot") -> DataFrame:
    """store's rows of wanted (key, batch, place) with `batch_doc`: the document's number, from 0, among those found in its batch. Missing ones go."""
    found = wanted.join(store.select(key).distinct(), key, "left_semi")
    numbered = found.withColumn("batch_doc", (F.row_number().over(Window.partitionBy(batch).orderBy(place)) - 1).cast("int"))
    return store.join(numbered.select(key, batch, "batch_doc"), key)


def looked_up(wanted: DataFrame, cache: DataFrame, compute: Callable[[DataFrame], DataFrame], key: str = "doc_id", room: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows, fresh): the cache's rows for wanted's keys, with compute(wanted's rows that it lacks); and the computed rows to put into it.

    `room` is how many rows the cache takes in all, those of least key first: None for no bound, 0 where it isn't filled, as outside of training.
    """
    hits = cache.join(wanted.select(key).distinct(), key, "left_semi")
    missing = compute(catalogue.pending(wanted, cache, key)).select(*cache.columns)
    fresh = missing if room is None else missing.orderBy(key).limit(max(0, room - cache.count()) if room else 0)
    return hits.unionByName(missing), fresh


def ids_to_tokens(rows: DataFrame, vocabulary: DataFrame, ids: str = "input_ids", key: tuple[str, ...] = ("doc_id", "segment")) -> DataFrame:
    """key with `tokens`: the strings of an array of ids, by vocabulary (id, token); unknown ids are null."""
    long = rows.select(*key, F.posexplode(ids).alias("__p", "id")).join(vocabulary, "id", "left")
    ordered = F.array_sort(F.collect_list(F.struct("__p", "token")))
    return long.groupBy(*key).agg(F.transform(ordered, lambda x: x["token"]).alias("tokens"))


def assembled(docs: DataFrame, mentions: DataFrame, relations: DataFrame, index: DataFrame) -> DataFrame:
    """docs (doc_id, text) with entity_ix and class_ix (sorted distinct positions of their multi-hot vectors) and relations whose arguments are known.

    mentions (doc_id, entity), relations (doc_id, subject, object, label), index (entity, class, entity_ix, class_ix) of the training
    split. Unknown entities don't count; a document without any has empty lists.
    """
    own = mentions.join(index, "entity").groupBy("doc_id").agg(F.sort_array(F.collect_set("entity_ix")).alias("entity_ix"), F.sort_array(F.collect_set("class_ix")).alias("class_ix"))
    known = labels.known_relations(relations, index).groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("subject", "object", "label"))).alias("relations"))
    rows = docs.join(own, "doc_id", "left").join(known, "doc_id", "left")
    none = lambda c, kind: F.coalesce(c, F.array().cast(kind)).alias(c)
    kind = dict(known.dtypes)["relations"]
    return rows.select(*docs.columns, none("entity_ix", "array<bigint>"), none("class_ix", "array<bigint>"), none("relations", kind))


def decoded(logits: DataFrame, classes: list[str], stride: int = 50) -> DataFrame:
    """(doc_id, tokens): words with tags and probabilities from rows (doc_id, segment, position, string, start, end, logits).

    Each piece gets its best class; windows are merged without their overlap, then pieces into words.
    """
    offset = F.struct("start", "end").cast(schema.OFFSET)
    token = F.struct("string", offset.alias("offset"), scores.tag(F.col("logits"), classes).alias("prediction"), F.lit(None).cast("string").alias("gold_label"), F.array_max(scores.softmax(F.col("logits"))).alias("prob"))
    rows = logits.select("doc_id", "segment", "position", token.cast(schema.TOKEN).alias("token"))
    windows = rows.groupBy("doc_id", "segment").agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "token"))), lambda x: x["token"]).alias("w"))
    docs = windows.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("segment", "w"))), lambda x: x["w"]).alias("w"))
    return docs.select("doc_id", text.merged_off_tokens(tokens.merged_predictions(F.col("w"), stride)).alias("tokens"))


def evaluated(df: DataFrame, threshold: float = 0.5, k: int = 0, support: int = 10) -> DataFrame:
    """(metric, value) of a long table (doc_id, label_ix, p, y): micro and macro F1, ranking and average precision, counts."""
    rows = metrics.decisions(df, threshold, k)
    micro, counted = metrics.micro(rows), metrics.coverage(rows)
    parts = [
        micro.select(F.lit("micro_f1").alias("metric"), F.col("f1").alias("value")),
        metrics.macro_f1(rows, support).select(F.lit("macro_f1"), "macro_f1"),
        metrics.label_ranking_precision(df).select(F.lit("lrap"), "lrap"),
        metrics.micro_average_precision(df).select(F.lit("micro_ap"), "average_precision"),
        *[counted.select(F.lit(c), F.col(c).cast("double")) for c in ("n_true", "n_predicted", "n_labels_predicted")],
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out
