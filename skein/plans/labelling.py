"""Entity labels and relations; order -> parts stands for document -> entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import scores, text
from skein.operators import catalogue, labels, relations
from skein.plans.registry import query, table

_PARTS = "SELECT DISTINCT l_orderkey, p_type FROM lineitem JOIN part ON l_partkey = p_partkey"


def _mentions(spark, d):
    part = table(spark, d, "part").select("p_partkey", "p_type", "p_brand")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey").join(part, F.col("l_partkey") == F.col("p_partkey"))


_INDEX = """
WITH u AS (SELECT DISTINCT 'brands' AS class, 'bra' || p_brand AS entity FROM part UNION SELECT DISTINCT 'types', 'typ' || p_type FROM part)
SELECT class, entity, row_number() OVER (ORDER BY class, entity) - 1 AS entity_ix, CAST(CASE class WHEN 'brands' THEN 0 ELSE 1 END AS BIGINT) AS class_ix FROM u
"""


def _index(spark, d):
    lists = table(spark, d, "part").select(F.array("p_brand").alias("b"), F.array("p_type").alias("t"))
    return labels.indexed(labels.universe(lists, brands="b", types="t"))


@query(_INDEX)
def entity_universe_index(spark, d):
    return _index(spark, d).select("class", "entity", "entity_ix", "class_ix")


@query("""
WITH x AS (SELECT p_type, row_number() OVER (ORDER BY p_type) - 1 AS ix FROM (SELECT DISTINCT p_type FROM part)),
m AS (SELECT l_orderkey, list(DISTINCT CAST(ix AS INTEGER)) AS own FROM lineitem JOIN part ON l_partkey = p_partkey JOIN x USING (p_type) GROUP BY 1), s AS (SELECT count(*) AS n FROM x)
SELECT l_orderkey, array_to_string(list_transform(range(0, n), lambda i: CASE WHEN list_contains(own, i) THEN '1' ELSE '0' END), '') AS hot, CAST(len(own) AS INTEGER) AS n_hot FROM m, s
""")
def multi_hot_by_order(spark, d):
    types = table(spark, d, "part").select("p_type").distinct().withColumn("class", F.lit("type"))
    index = catalogue.numbered(types, "class", "p_type", "ix").select("p_type", F.col("ix").cast("int").alias("ix"))
    size = index.agg(F.count(F.lit(1)).cast("int").alias("size"))
    own = _mentions(spark, d).join(index, "p_type").groupBy("l_orderkey").agg(F.collect_set("ix").alias("own")).crossJoin(F.broadcast(size))
    hot = own.withColumn("hot", text.multi_hot(F.col("own"), F.col("size")))
    return hot.select("l_orderkey", F.array_join(F.transform("hot", lambda x: x.cast("string")), "").alias("hot"), F.size(text.hot_positions(F.col("hot"))).alias("n_hot"))


@query("""
SELECT l_orderkey, CAST(CASE WHEN count_if(p_brand LIKE '%1') > 0 THEN 1 ELSE 0 END AS FLOAT) AS first, CAST(CASE WHEN count_if(p_brand LIKE '%2') > 0 THEN 1 ELSE 0 END AS FLOAT) AS second
FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1
""")
def class_presence(spark, d):
    own = lambda end: F.collect_list(F.when(F.col("p_brand").endswith(end), F.col("l_partkey")))
    rows = _mentions(spark, d).groupBy("l_orderkey").agg(own("1").alias("a"), own("2").alias("b"))
    present = rows.withColumn("p", text.presence(F.col("a"), F.col("b")))
    return present.select("l_orderkey", F.col("p")[0].alias("first"), F.col("p")[1].alias("second"))


_FREQUENCY = f"SELECT p_type, least(1 - 1e-5, greatest(1e-5, count(*) / (SELECT count(*) FROM orders))) AS f FROM ({_PARTS}) GROUP BY 1"


def _frequency(spark, d):
    return labels.frequencies(_mentions(spark, d), "p_type", "l_orderkey", table(spark, d, "orders"))


@query(f"SELECT p_type, round(f, 6) AS frequency FROM ({_FREQUENCY})")
def label_frequency_clamped(spark, d):
    return _frequency(spark, d).select("p_type", F.round("frequency", 6).alias("frequency"))


@query(f"SELECT p_type, round(least(50.0, (1 - f) / f), 5) AS weight FROM ({_FREQUENCY})")
def positive_weight(spark, d):
    return _frequency(spark, d).select("p_type", F.round(scores.positive_weight(F.col("frequency"), 50.0), 5).alias("weight"))


@query(f"SELECT p_type, round(ln(f / (1 - f)), 5) AS bias FROM ({_FREQUENCY}) UNION ALL SELECT NULL, round(ln(0.1 / 0.9), 5)")
def bias_logit(spark, d):
    return labels.bias(_frequency(spark, d), "p_type", 0.1).select("p_type", F.round("bias", 5).alias("bias"))


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1),
w AS (SELECT event_type, 1 / ln(CASE WHEN n > 100 THEN n ELSE (SELECT max(n) FROM c) END) * ((SELECT sum(n) FROM c) / (SELECT count(*) FROM c)) AS w FROM c),
s AS (SELECT event_type, (w - (SELECT min(w) FROM w)) / ((SELECT max(w) FROM w) - (SELECT min(w) FROM w)) AS s FROM w)
SELECT event_type, round(exp(s) / (SELECT sum(exp(s)) FROM s) + 1, 5) AS weight FROM s
""")
def class_weights(spark, d):
    return labels.class_weights(table(spark, d, "events"), "event_type").select("event_type", F.round("weight", 5).alias("weight"))


@query("SELECT event_type, count(*) AS n FROM events WHERE starts_with(upper(event_type), 'C') OR starts_with(upper(event_type), 'P') GROUP BY 1")
def entity_counter(spark, d):
    tags = table(spark, d, "events").withColumn("tag", F.when(F.upper("event_type").rlike("^[CP]"), F.concat(F.lit("B-"), "event_type")).otherwise(F.lit("O")))
    return labels.entity_counts(tags, "tag").select(F.expr("substr(tag, 3)").alias("event_type"), "n")


_KNOWN = "SELECT p_partkey FROM part WHERE p_size <= 25"
_EDGES = """SELECT a.l_orderkey, a.l_partkey AS subject, b.l_partkey AS object, a.l_linenumber % 3 AS label, a.l_linenumber AS position
FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1"""


def _edges(spark, d):
    a = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("subject"), "l_linenumber")
    b = table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("object"), (F.col("l_linenumber") - 1).alias("l_linenumber"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).select("l_orderkey", "subject", "object", (F.col("l_linenumber") % 3).alias("label"), F.col("l_linenumber").alias("position"))


@query(f"SELECT l_orderkey, subject, object, label FROM ({_EDGES}) WHERE subject IN ({_KNOWN}) AND object IN ({_KNOWN})")
def relation_filter_known(spark, d):
    known = table(spark, d, "part").where("p_size <= 25").select(F.col("p_partkey").alias("entity"))
    return labels.known_relations(_edges(spark, d), known).select("l_orderkey", "subject", "object", "label")


_PAIRS = """SELECT a.l_orderkey, a.l_partkey AS i, b.l_partkey AS j FROM (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) a
JOIN (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem) b ON a.l_orderkey = b.l_orderkey AND a.l_partkey < b.l_partkey"""


@query(_PAIRS)
def entity_pairs(spark, d):
    return relations.entity_pairs(table(spark, d, "lineitem"), "l_orderkey", "l_partkey")


def _aligned(spark, d, how):
    gold = _edges(spark, d).withColumnsRenamed({"subject": "i", "object": "j"})
    return how(entity_pairs(spark, d), gold, ["l_orderkey", "i", "j"], "label", "position", F.lit(2)).select("l_orderkey", "i", "j", "target")


@query(f"""
WITH g AS (SELECT l_orderkey, subject, object, coalesce(arg_min(label, position) FILTER (label <> 2), arg_min(label, position)) AS t FROM ({_EDGES}) GROUP BY 1, 2, 3)
SELECT p.l_orderkey, i, j, coalesce(t, 2) AS target FROM ({_PAIRS}) p LEFT JOIN g ON p.l_orderkey = g.l_orderkey AND i = subject AND j = object
""")
def pair_gold_alignment(spark, d):
    return _aligned(spark, d, relations.gold_targets)


@query(f"""
WITH g AS (SELECT l_orderkey, subject, object, arg_max(label, position) AS t FROM ({_EDGES}) GROUP BY 1, 2, 3)
SELECT p.l_orderkey, i, j, coalesce(t, 2) AS target FROM ({_PAIRS}) p LEFT JOIN g ON p.l_orderkey = g.l_orderkey AND i = subject AND j = object
""")
def pair_gold_alignment_last(spark, d):
    return _aligned(spark, d, relations.last_gold_targets)


@query(f"""
WITH s AS (SELECT l_orderkey, i, j FROM ({_PAIRS}) JOIN orders ON o_orderkey = l_orderkey AND o_orderstatus <> 'O'), g AS (SELECT DISTINCT l_orderkey, subject AS i, object AS j FROM ({_EDGES}))
SELECT l_orderkey, i, j, 0 AS target, 1 AS predicted FROM s UNION ALL
SELECT l_orderkey, i, j, 1, 2 FROM g WHERE l_orderkey NOT IN (SELECT l_orderkey FROM s)
""")
def missing_golds(spark, d):
    """Pairs of open orders have no scores, their golds stand as predicted none."""
    closed = table(spark, d, "orders").where("o_orderstatus <> 'O'").select(F.col("o_orderkey").alias("l_orderkey"))
    scored = entity_pairs(spark, d).join(closed, "l_orderkey", "left_semi").withColumns({"target": F.lit(0), "predicted": F.lit(1)})
    gold = _edges(spark, d).select("l_orderkey", F.col("subject").alias("i"), F.col("object").alias("j")).distinct().withColumn("label", F.lit(1))
    return relations.with_missing_golds(scored, gold, ["l_orderkey", "i", "j"], F.lit(2))


@query("SELECT doc_id, quality + 1 AS subject, toxic + 10 AS object, CAST(CASE WHEN quality >= toxic THEN 0 ELSE 1 END AS INTEGER) AS label FROM labels")
def first_relation_labels(spark, d):
    pair = F.struct((F.col("quality") + 1).alias("subject"), (F.col("toxic") + 10).alias("object"))
    rows = table(spark, d, "labels").withColumn("relations", F.array(F.create_map(pair, F.array(F.col("quality").cast("double"), F.col("toxic").cast("double"))), F.create_map(pair, F.array(F.lit(9.0), F.lit(1.0)))))
    return relations.first_relations(rows, "doc_id", "relations")
