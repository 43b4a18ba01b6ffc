"""Dataset assembly and evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.operators import dataset, sampling, tokens
from skein.plans import modelling
from skein.plans.registry import ORACLE_SQL, query, table

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"


@query(f"""
WITH n AS (SELECT doc_id, {_TOKENS} AS t FROM documents), s AS (SELECT doc_id, t, CAST(ceil(greatest(0, len(t) - 126) / 110) AS INTEGER) AS last FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS segment, CAST(2 + len(t[i * 110 + 1 : i * 110 + 126]) AS INTEGER) AS n_tokens, CAST(2 + len(t[i * 110 + 1 : i * 110 + 126]) AS INTEGER) AS n_attended,
  md5('[CLS] ' || coalesce(array_to_string(t[i * 110 + 1 : i * 110 + 126], ' ') || ' ', '') || '[SEP]') AS hash
FROM s, unnest(range(0, last + 1)) AS r(i) WHERE len(t) > 0
""")
def encoded_segments(spark, d):
    docs = table(spark, d, "documents").where(F.size(tokens.token_strings(F.col("text"))) > 0)
    rows = dataset.encoded(docs, tokens.token_strings(F.col("text")), max_length=128, stride=16)
    attended = F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x)
    return rows.select("doc_id", "segment", F.size("tokens").alias("n_tokens"), attended.alias("n_attended"), F.md5(F.array_join("tokens", " ")).alias("hash"))


@query("""
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i FROM documents),
f AS (SELECT doc_id, i // 16 AS batch, row_number() OVER (PARTITION BY i // 16 ORDER BY i) - 1 AS batch_doc FROM h WHERE doc_id IN (SELECT doc_id FROM labels))
SELECT doc_id, CAST(batch AS BIGINT) AS batch, CAST(batch_doc AS INTEGER) AS batch_doc, quality FROM labels JOIN f USING (doc_id)
""")
def segment_multi_get(spark, d):
    wanted = sampling.batches(table(spark, d, "documents").select("doc_id"), "doc_id", 16)
    return dataset.multi_get(table(spark, d, "labels"), wanted).select("doc_id", "batch", "batch_doc", "quality")


@query("""
WITH u AS (SELECT DISTINCT p_type FROM part WHERE p_size <= 25), x AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ix FROM u),
m AS (SELECT l_orderkey, list_sort(list(DISTINCT ix)) AS own FROM lineitem JOIN part ON l_partkey = p_partkey JOIN x USING (p_type) GROUP BY 1)
SELECT o_orderkey AS doc_id, coalesce(array_to_string(own, ','), '') AS entities, CAST(CASE WHEN own IS NULL THEN 0 ELSE 1 END AS INTEGER) AS n_classes FROM orders LEFT JOIN m ON o_orderkey = l_orderkey
""")
def dataset_assembly(spark, d):
    from skein.operators import labels

    part = table(spark, d, "part")
    index = labels.indexed(part.where("p_size <= 25").select(F.lit("type").alias("class"), F.col("p_type").alias("entity")).distinct())
    mentions = table(spark, d, "lineitem").join(part, F.expr("l_partkey = p_partkey")).select(F.col("l_orderkey").alias("doc_id"), F.col("p_type").alias("entity"))
    edges = mentions.select("doc_id", F.col("entity").alias("subject"), F.col("entity").alias("object"), F.lit(1).alias("label")).distinct()
    rows = dataset.assembled(table(spark, d, "orders").select(F.col("o_orderkey").alias("doc_id")), mentions, edges, index)
    return rows.select("doc_id", F.array_join(F.transform("entity_ix", lambda x: x.cast("string")), ",").alias("entities"), F.size("class_ix").alias("n_classes"))


@query(f"""
WITH d AS ({modelling._DECIDED}), c AS (SELECT label_ix, sum(predicted * y) AS tp, sum(predicted * (1 - y)) AS fp, sum((1 - predicted) * y) AS fn FROM d GROUP BY 1)
SELECT 'micro_f1' AS metric, round(2 * sum(tp) / (2 * sum(tp) + sum(fp) + sum(fn)), 6) AS value FROM c
UNION ALL SELECT 'macro_f1', round(avg(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0)) FILTER (tp + fn >= 10), 6) FROM c
UNION ALL SELECT 'lrap', lrap FROM ({ORACLE_SQL['lrap']}) UNION ALL SELECT 'micro_ap', average_precision FROM ({ORACLE_SQL['micro_ap']})
UNION ALL SELECT 'n_true', CAST(sum(y) AS DOUBLE) FROM d UNION ALL SELECT 'n_predicted', CAST(sum(predicted) AS DOUBLE) FROM d
UNION ALL SELECT 'n_labels_predicted', CAST(count(DISTINCT CASE WHEN predicted = 1 THEN label_ix END) AS DOUBLE) FROM d
""")
def evaluation(spark, d):
    return dataset.evaluated(modelling._prob(spark, d), 0.9, 2).select("metric", F.round("value", 6).alias("value"))


@query("""
WITH w AS (SELECT l_orderkey, list(n_name ORDER BY l_linenumber, l_suppkey % 25) AS names FROM lineitem LEFT JOIN nation ON n_nationkey = l_suppkey % 25 GROUP BY 1)
SELECT l_orderkey AS doc_id, array_to_string(names, ' ') AS names FROM w
""")
def vocabulary_lookup(spark, d):
    ids = table(spark, d, "lineitem").select("l_orderkey", F.struct("l_linenumber", (F.col("l_suppkey") % 25).cast("int").alias("id")).alias("x"))
    rows = ids.groupBy(F.col("l_orderkey").alias("doc_id")).agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["id"]).alias("input_ids"))
    words = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.col("n_name").alias("token"))
    return dataset.ids_to_tokens(rows, words, key=("doc_id",)).select("doc_id", F.array_join("tokens", " ").alias("names"))


@query("""
SELECT vec_id, 'kept' AS origin, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings WHERE label < 5
UNION ALL SELECT vec_id, 'new', round(2 * CAST(embedding[1] AS DOUBLE), 6) FROM embeddings WHERE label >= 5 OR label IS NULL
""")
def embedding_lookup(spark, d):
    """Vectors of the lower labels are in the cache; the others are computed."""
    rows = table(spark, d, "embeddings")
    first = F.col("embedding")[0].cast("double")
    cache = rows.where("label < 5").select("vec_id", F.lit("kept").alias("origin"), F.round(first, 6).alias("first"))
    return dataset.looked_up(rows, cache, lambda missing: missing.select("vec_id", F.lit("new").alias("origin"), F.round(2 * first, 6).alias("first")), "vec_id")[0]
