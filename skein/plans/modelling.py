"""Scores, pooling, losses and metrics; embeddings stand for logits, their label for the gold class."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scores
from skein.operators import metrics, relations
from skein.plans.registry import query, table

_LOGITS = "SELECT vec_id, label, list_transform(embedding[1:10], lambda x: CAST(x AS DOUBLE) * 10) AS z FROM embeddings"
_LONG = f"SELECT vec_id AS doc_id, label, i - 1 AS label_ix, z[i] AS logit, CASE WHEN i - 1 = label OR (i + vec_id) % 7 = 0 THEN 1 ELSE 0 END AS y FROM ({_LOGITS}), unnest(range(1, 11)) AS r(i)"
_PROB = f"SELECT doc_id, label_ix, y, round(1 / (1 + exp(-logit)), 6) AS p FROM ({_LONG})"


def _logits(spark, d):
    return table(spark, d, "embeddings").select("vec_id", "label", F.transform(F.slice("embedding", 1, 10), lambda x: x.cast("double") * 10).alias("z"))


def _long(spark, d):
    rows = _logits(spark, d).select(F.col("vec_id").alias("doc_id"), "label", F.posexplode("z").alias("label_ix", "logit"))
    gold = (F.col("label_ix") == F.col("label")) | ((F.col("label_ix") + 1 + F.col("doc_id")) % 7 == 0)
    return rows.withColumn("label_ix", F.col("label_ix").cast("long")).withColumn("y", gold.cast("int"))


def _prob(spark, d):
    return _long(spark, d).select("doc_id", "label_ix", "y", F.round(scores.sigmoid(F.col("logit")), 6).alias("p"))


@query(f"""
WITH e AS (SELECT vec_id, z, list_transform(z, lambda x: exp(x - list_max(z))) AS e FROM ({_LOGITS})),
p AS (SELECT vec_id, z, list_transform(e, lambda x: x / list_sum(e)) AS p FROM e)
SELECT vec_id, CAST(list_position(z, list_max(z)) - 1 AS INTEGER) AS best, round(list_max(p), 6) AS top,
  round(-list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-9)))), 6) AS entropy,
  list_position(z, list_max(z)) <> 10 AND -list_sum(list_transform(p, lambda x: x * ln(greatest(x, 1e-9)))) <= 0.8 AS hard FROM p
""")
def softmax_entropy_argmax(spark, d):
    z = F.col("z")
    return _logits(spark, d).select("vec_id", scores.argmax(z).alias("best"), F.round(F.array_max(scores.softmax(z)), 6).alias("top"), F.round(scores.entropy(z), 6).alias("entropy"), scores.hard_entity(z).alias("hard"))


@query(f"SELECT vec_id, chr(CAST(96 + list_position(z, list_max(z)) AS INTEGER)) AS tag FROM ({_LOGITS})")
def logits_to_tags(spark, d):
    return _logits(spark, d).select("vec_id", scores.tag(F.col("z"), list("abcdefghij")).alias("tag"))


_COMPONENTS = "SELECT label, i - 1 AS component, CAST(embedding[i] AS DOUBLE) AS value FROM embeddings, unnest(range(1, 65)) AS r(i)"


@query(f"""
SELECT label, CAST(component AS INTEGER) AS component, round(max(value) + ln(sum(exp(value - top))), 5) AS pooled, round(max(value) + ln(sum(exp(value - top))) - ln(count(*)), 5) AS mean_pooled
FROM (SELECT *, max(value) OVER (PARTITION BY label, component) AS top FROM ({_COMPONENTS})) GROUP BY 1, 2
""")
def lse_pool_by_label(spark, d):
    long = relations.by_component(table(spark, d, "embeddings").select("label", "embedding"), "embedding")
    keys = ["label", "component"]
    both = relations.pooled(long, keys, "value", "logsumexp").join(relations.pooled(long, keys, "value", "logmeanexp").withColumnRenamed("value", "m"), keys)
    return both.select("label", "component", F.round("value", 5).alias("pooled"), F.round("m", 5).alias("mean_pooled"))


@query(f"SELECT label, CAST(component AS INTEGER) AS component, round(max(value), 6) AS high, round(avg(value), 6) AS middle FROM ({_COMPONENTS}) GROUP BY 1, 2")
def max_mean_pool(spark, d):
    long = relations.by_component(table(spark, d, "embeddings").select("label", "embedding"), "embedding")
    keys = ["label", "component"]
    both = relations.pooled(long, keys, "value", "max").join(relations.pooled(long, keys, "value", "mean").withColumnRenamed("value", "m"), keys)
    return both.select("label", "component", F.round("value", 6).alias("high"), F.round("m", 6).alias("middle"))


@query("""
WITH w AS (SELECT label, embedding, exp(CAST(embedding[1] AS DOUBLE) - max(CAST(embedding[1] AS DOUBLE)) OVER (PARTITION BY label)) AS w FROM embeddings)
SELECT label, CAST(i - 1 AS INTEGER) AS component, round(sum(w * CAST(embedding[i] AS DOUBLE)) / sum(w), 5) AS value FROM w, unnest(range(1, 65)) AS r(i) GROUP BY 1, 2
""")
def attention_pool(spark, d):
    rows = table(spark, d, "embeddings").select("label", "embedding", F.col("embedding")[0].cast("double").alias("logit"))
    pooled = relations.attention_pooled(rows, ["label"], "logit", "embedding")
    return pooled.select("label", "component", F.round("value", 5).alias("value"))


@query(f"""
SELECT round(avg((1 - y) * (greatest(logit, 0) + ln(1 + exp(-abs(logit)))) + 3.0 * y * (greatest(-logit, 0) + ln(1 + exp(-abs(logit))))), 5) AS loss FROM ({_LONG})
""")
def bce_loss(spark, d):
    return _long(spark, d).agg(F.round(F.avg(scores.weighted_bce(F.col("logit"), F.col("y"), 3.0)), 5).alias("loss"))


@query(f"""
WITH e AS (SELECT doc_id, label_ix, 1 / (1 + exp(-logit)) AS p FROM ({_LONG})), c AS (SELECT doc_id, label_ix AS class_ix, p FROM e WHERE label_ix < 3)
SELECT round(avg(e.p * (1 - c.p)), 6) AS penalty FROM e JOIN c ON e.doc_id = c.doc_id AND e.label_ix % 3 = c.class_ix
""")
def consistency_penalty(spark, d):
    long = _long(spark, d).select("doc_id", "label_ix", "logit")
    entities = long.select(F.col("label_ix").alias("entity_ix"), (F.col("label_ix") % 3).alias("class_ix")).distinct()
    classes = long.where("label_ix < 3").withColumnRenamed("label_ix", "class_ix")
    return relations.consistency_penalty(long.withColumnRenamed("label_ix", "entity_ix"), classes, entities).select(F.round("penalty", 6).alias("penalty"))


@query(f"""
WITH n AS (SELECT z, label, list_max(z) + ln(list_sum(list_transform(z, lambda x: exp(x - list_max(z))))) AS n FROM ({_LOGITS}))
SELECT round(avg(0.9 * (n - z[label + 1]) + 0.1 * (n - list_sum(z) / 10)), 5) AS loss FROM n
""")
def smoothed_cross_entropy(spark, d):
    loss = scores.smoothed_cross_entropy(F.col("z"), F.col("label"), 0.1)
    return _logits(spark, d).agg(F.round(F.avg(loss), 5).alias("loss"))


_DECIDED = f"SELECT *, CASE WHEN p >= 0.9 OR row_number() OVER (PARTITION BY doc_id ORDER BY p DESC, label_ix) <= 2 THEN 1 ELSE 0 END AS predicted FROM ({_PROB})"


def _decided(spark, d):
    return metrics.decisions(_prob(spark, d), 0.9, 2)


@query(f"SELECT doc_id, label_ix, y, p, predicted FROM ({_DECIDED})")
def threshold_or_topk(spark, d):
    return _decided(spark, d).select("doc_id", "label_ix", "y", "p", "predicted")


@query(f"SELECT doc_id, label_ix, CAST(CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS INTEGER) AS decided FROM ({_PROB})")
def rounded_decisions(spark, d):
    return _long(spark, d).select("doc_id", "label_ix", scores.rounded(F.col("logit")).alias("decided"))


_BY_LABEL = f"""
WITH c AS (SELECT label_ix, sum(predicted * y) AS tp, sum(predicted * (1 - y)) AS fp, sum((1 - predicted) * y) AS fn FROM ({_DECIDED}) GROUP BY 1),
a AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn FROM c),
l AS (SELECT label_ix, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1, tp + fn AS support FROM c)
"""


@query(f"{_BY_LABEL} SELECT round(2 * tp / (2 * tp + fp + fn), 6) AS micro_f1, round((SELECT avg(f1) FROM l WHERE support >= 10), 6) AS macro_f1 FROM a")
def micro_macro_f1(spark, d):
    rows = _decided(spark, d)
    both = metrics.micro(rows).crossJoin(metrics.macro_f1(rows))  # one row each
    return both.select(F.round("f1", 6).alias("micro_f1"), F.round("macro_f1", 6).alias("macro_f1"))


@query(f"""{_BY_LABEL}
SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, CAST(support AS BIGINT) AS support FROM (
  SELECT CAST(label_ix AS VARCHAR) AS label, precision, recall, f1, support FROM l
  UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1), sum(support) FROM l
  UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), sum(f1 * support) / sum(support), sum(support) FROM l
  UNION ALL SELECT 'micro avg', tp / (tp + fp), tp / (tp + fn), 2 * tp / (2 * tp + fp + fn), tp + fn FROM a)
""")
def label_report(spark, d):
    rows = metrics.report(_decided(spark, d))
    return rows.select("label", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support")


@query(f"SELECT CAST(sum(y) AS BIGINT) AS n_true, CAST(sum(predicted) AS BIGINT) AS n_predicted, count(DISTINCT CASE WHEN predicted = 1 THEN label_ix END) AS n_labels_predicted FROM ({_DECIDED})")
def prediction_coverage(spark, d):
    return metrics.coverage(_decided(spark, d))


@query(f"""
WITH r AS (SELECT doc_id, y, count(*) OVER w AS rank, sum(y) OVER w AS hits FROM ({_PROB}) WINDOW w AS (PARTITION BY doc_id ORDER BY p DESC RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
s AS (SELECT avg(hits / rank) FILTER (y = 1) AS a, sum(y) AS t, count(*) AS n FROM r GROUP BY doc_id)
SELECT round(avg(CASE WHEN t = 0 OR t = n THEN 1 ELSE a END), 6) AS lrap FROM s
""")
def lrap(spark, d):
    return metrics.label_ranking_precision(_prob(spark, d)).select(F.round("lrap", 6).alias("lrap"))


@query(f"""
WITH s AS (SELECT p, sum(y) AS t, count(*) AS n FROM ({_PROB}) GROUP BY p),
r AS (SELECT t, sum(t) OVER w AS tp, sum(n) OVER w AS n FROM s WINDOW w AS (ORDER BY p DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
SELECT round(sum(t / (SELECT sum(t) FROM s) * tp / n), 6) AS average_precision FROM r
""")
def micro_ap(spark, d):
    return metrics.micro_average_precision(_prob(spark, d)).select(F.round("average_precision", 6).alias("average_precision"))


@query("SELECT CAST(e AS BIGINT) AS epoch, round(0.1 + 0.9 * least(1.0, e / 8.0), 6) AS weight FROM (SELECT DISTINCT event_id AS e FROM events)")
def loss_ramp(spark, d):
    epochs = table(spark, d, "events").select(F.col("event_id").alias("epoch")).distinct()
    return epochs.select("epoch", F.round(scores.ramp(F.col("epoch"), 8), 6).alias("weight"))


@query("""
WITH m AS (SELECT vec_id // 20 AS doc, label, CAST(embedding[i] AS DOUBLE) AS v, i FROM embeddings, unnest(range(1, 65)) AS r(i)),
p AS (SELECT doc, label, i, max(v) + ln(sum(exp(v - top))) AS v FROM (SELECT *, max(v) OVER (PARTITION BY doc, label, i) AS top FROM m) GROUP BY 1, 2, 3)
SELECT a.doc AS doc_id, a.label AS i, b.label AS j, round(sum(a.v * b.v), 5) AS product FROM p a JOIN p b ON a.doc = b.doc AND a.i = b.i AND a.label < b.label GROUP BY 1, 2, 3
""")
def entity_pair_vectors(spark, d):
    """Pairs of the labels in each run of 20 vectors, by the product of their pooled vectors."""
    rows = _mentions(spark, d)
    pairs = relations.pair_candidates(rows, "doc_id", "label", "embedding")
    product = F.aggregate(F.zip_with("x", "y", lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)
    return pairs.select("doc_id", "i", "j", F.round(product, 5).alias("product"))


def _mentions(spark, d):
    return table(spark, d, "embeddings").select(F.floor(F.col("vec_id") / 20).alias("doc_id"), "label", "embedding")


def _weights(size: int = 64, hidden: int = 32):
    import numpy as np

    rng = np.random.default_rng(7)
    return {"hidden_w": rng.normal(size=(hidden, size)) / 8, "hidden_b": rng.normal(size=hidden), "bilinear": rng.normal(size=(3, hidden, hidden)) / 32, "linear_w": rng.normal(size=(3, 2 * hidden)) / 8, "linear_b": rng.normal(size=3), "bias": rng.normal(size=3)}


@query()
def pair_logits(spark, d):
    """Relation scores of the pairs of entity_pair_vectors, with the gold label of the pair that its labels name; see the tests for the formula."""
    rows = _mentions(spark, d)
    scored = relations.pair_logits(rows, "doc_id", "label", "embedding", _weights())
    gold = rows.select("doc_id", F.col("label").alias("i"), (F.col("label") + 1).alias("j")).distinct().withColumns({"gold": F.col("i") % 2, "position": F.col("i")})
    out = relations.gold_targets(scored, gold, ["doc_id", "i", "j"], "gold", "position", F.lit(2))
    return out.select("doc_id", "i", "j", "target", *[F.round(F.col("logits")[r], 6).alias(f"r{r}") for r in range(3)])


@query()
def gold_pair_logits(spark, d):
    """Relation scores of gold pairs of labels, from vectors pooled by attention over each run's vectors."""
    rows = _mentions(spark, d).withColumn("logit", F.col("embedding")[0].cast("double"))
    gold = rows.select("doc_id", F.col("label").alias("subject"), ((F.col("label") + 1) % 10).alias("object")).distinct()
    out = relations.gold_logits(gold, rows, "doc_id", "label", "logit", "embedding", _weights())
    return out.select("doc_id", "subject", "object", *[F.round(F.col("logits")[r], 6).alias(f"r{r}") for r in range(3)])


@query()
def pair_scores(spark, d):
    """Biaffine scores of vectors with the next of their label, with fixed weights; see the tests for the formula."""
    weights = _weights()
    rows = table(spark, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("x"))
    pairs = rows.join(rows.select((F.col("vec_id") - 1).alias("vec_id"), F.col("x").alias("y")), "vec_id")
    scored = pairs.select("vec_id", relations.biaffine(F.col("x"), F.col("y"), weights).alias("s"))
    return scored.select("vec_id", *[F.round(F.col("s")[i], 6).alias(f"r{i}") for i in range(3)])
