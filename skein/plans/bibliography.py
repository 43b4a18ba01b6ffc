"""Curation, lookups, membership, upserts, sampling and reports."""

from __future__ import annotations

from pyspark.sql import functions as F

from skein.functions import text
from skein.operators import catalogue, dictionary, report, sampling
from skein.plans.registry import query, ratio_sql, table


@query("""
SELECT doc_id, coalesce(text, '') || chr(10) || coalesce(nullif(lang, 'en'), '') AS body
FROM documents WHERE length(coalesce(text, '') || coalesce(nullif(lang, 'en'), '')) > 0
""")
def corpus_concat_nonempty(spark, d):
    docs = table(spark, d, "documents")
    lang = F.nullif(F.col("lang"), F.lit("en"))
    return docs.where(F.length(text.joined_text(F.col("text"), lang, sep="")) > 0).select("doc_id", text.joined_text(F.col("text"), lang).alias("body"))


@query("""
SELECT l_orderkey, l_linenumber, p_name AS name, p_type, s_name, o_orderpriority, c_name
FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
WHERE nullif(l_returnflag, 'N') IS NULL
""")
def target_star_join(spark, d):
    fact = table(spark, d, "lineitem").withColumn("strain", F.nullif("l_returnflag", F.lit("N"))).where("strain is null")
    joined = catalogue.star_join(
        fact.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"),
        (table(spark, d, "part").select("p_partkey", "p_name", "p_type"), "l_partkey", "p_partkey"),
        (table(spark, d, "supplier").select("s_suppkey", "s_name"), "l_suppkey", "s_suppkey"),
        (table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderpriority"), "l_orderkey", "o_orderkey"),
        (table(spark, d, "customer").select("c_custkey", "c_name"), "o_custkey", "c_custkey"),
    )
    # the supplier's `name` loses to the part's, which comes later
    renamed = joined.withColumnsRenamed({"l_orderkey": "f_l_orderkey", "l_linenumber": "f_l_linenumber"}).withColumns({"s_name_": F.col("s_name")})
    named = renamed.select("f_l_orderkey", "f_l_linenumber", F.col("s_name_").alias("s_s_name"), F.col("s_name_").alias("s_name"), F.col("p_name"), F.col("p_type").alias("p_p_type"), F.col("o_orderpriority").alias("o_o_orderpriority"), F.col("c_name").alias("c_c_name"))
    return catalogue.merged_records(named, ("f", ["l_orderkey", "l_linenumber"]), ("s", ["s_name", "name"]), ("p", ["name", "p_type"]), ("o", ["o_orderpriority"]), ("c", ["c_name"]))


@query("""
SELECT o_orderkey, coalesce(replace(replace(c_name, '#', 'PMC'), 'PMC', ''), '') AS found
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey
""")
def id_lookup_default(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), F.replace("c_name", F.lit("#"), F.lit("PMC")).alias("found"))
    rows = catalogue.lookup(table(spark, d, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey", "found")
    return rows.select("o_orderkey", text.without_prefix(F.col("found")).alias("found"))


@query("SELECT count(*) AS n, CAST(count_if(c_name <> '') AS BIGINT) AS n_found FROM (SELECT coalesce(c_name, '') AS c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_mktsegment = 'BUILDING') ON o_custkey = c_custkey)")
def articles_with_id(spark, d):
    known = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("o_custkey"), "c_name")
    rows = catalogue.lookup(table(spark, d, "orders").select("o_custkey"), known, "o_custkey", "c_name")
    return rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("c_name") != "").alias("n_found"))


@query("SELECT doc_id FROM documents WHERE NOT EXISTS (SELECT 1 FROM labels WHERE labels.doc_id = documents.doc_id)")
def pending_documents(spark, d):
    return catalogue.pending(table(spark, d, "documents").select("doc_id"), table(spark, d, "labels"), "doc_id")


@query("SELECT s_suppkey, s_name FROM supplier WHERE s_nationkey IN (SELECT n_nationkey FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')")
def known_membership(spark, d):
    nations = table(spark, d, "nation").join(table(spark, d, "region").where("r_name = 'EUROPE'"), F.col("n_regionkey") == F.col("r_regionkey"))
    return catalogue.known(table(spark, d, "supplier"), nations.withColumnRenamed("n_nationkey", "s_nationkey"), "s_nationkey").select("s_suppkey", "s_name")


@query("SELECT min(doc_id) AS doc_id, text FROM documents WHERE text IS NOT NULL GROUP BY text")
def dedup_keep_first(spark, d):
    return catalogue.keep_first(table(spark, d, "documents").select("doc_id", "text"), "text", "doc_id")


@query("SELECT doc_id, CAST(count(*) AS BIGINT) AS n_parts, CAST(sum(length(trim(part, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)))) AS BIGINT) AS n_chars FROM (SELECT doc_id, unnest(string_split(text, ',')) AS part FROM documents) GROUP BY doc_id")
def split_trim_explode(spark, d):
    parts = table(spark, d, "documents").select("doc_id", F.explode(text.split_trimmed(F.col("text"))).alias("part"))
    return parts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_parts"), F.sum(F.length("part")).alias("n_chars"))


@query("""
SELECT user_id, event_id, value FROM (
  SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def cache_upsert(spark, d):
    events = table(spark, d, "events").select("user_id", "ts", "event_id", "value")
    old = catalogue.latest(events.where("event_type = 'click'"), "user_id", "ts", "event_id")
    new = catalogue.latest(events, "user_id", "ts", "event_id")
    return catalogue.upserted(old, new, "user_id").select("user_id", "event_id", "value")


@query("SELECT p_partkey, p_name FROM part WHERE p_type LIKE '%ECO%' OR p_type LIKE '%TAN%'")
def marker_predicate(spark, d):
    parts = table(spark, d, "part")
    return parts.where(catalogue.has_error(F.col("p_type"), "ECO") | catalogue.has_error(F.col("p_type"), "TAN")).select("p_partkey", "p_name")




@query(f"""
WITH n AS (SELECT DISTINCT p_name AS t FROM part)
SELECT p_partkey, p_name FROM part WHERE p_name IN (SELECT a.t FROM n a, (SELECT t || 'x' AS u FROM n) b WHERE {ratio_sql('a.t', 'u')} > 90)
""")
def fuzzy_membership(spark, d):
    """Parts whose name scores above 90 against any of the names with a letter added."""
    parts = table(spark, d, "part")
    names = parts.select("p_name").distinct()
    return dictionary.fuzzy_members(parts.select("p_partkey", "p_name"), "p_name", names.select(F.concat("p_name", F.lit("x")).alias("term"))).select("p_partkey", "p_name")


@query("""
WITH n AS (SELECT DISTINCT p_name AS t FROM part), q AS (SELECT t FROM n UNION SELECT t || 'x' FROM n UNION SELECT substr(t, 2) FROM n)
SELECT q.t AS query, n.t AS term, round(200.0 * least(length(q.t), length(n.t)) / (length(q.t) + length(n.t)), 6) AS score
FROM q JOIN n ON (q.t = n.t OR q.t = n.t || 'x' OR q.t = substr(n.t, 2))
WHERE q.t <> '' AND 200.0 * least(length(q.t), length(n.t)) / (length(q.t) + length(n.t)) >= 93
""")
def fuzzy_pairs(spark, d):
    """Of fuzzy_pairs_all, each query and its own name: the pairs that an equi join in SQL can give."""
    own = (F.col("query") == F.col("term")) | (F.col("query") == F.concat("term", F.lit("x"))) | (F.col("query") == F.expr("substr(term, 2)"))
    return fuzzy_pairs_all(spark, d).where(own)


_NEAR = f"""WITH n AS (SELECT DISTINCT p_name AS t FROM part), q AS (SELECT t FROM n UNION SELECT t || 'x' FROM n UNION SELECT substr(t, 2) FROM n)
SELECT q.t AS query, n.t AS term, round({ratio_sql('q.t', 'n.t')}, 6) AS score FROM q JOIN n ON abs(length(q.t) - length(n.t)) <= 2 WHERE q.t <> ''"""


@query(f"SELECT * FROM ({_NEAR}) WHERE score >= 93")
def fuzzy_pairs_all(spark, d):
    """Part names, and variants with a letter more or less, against part names: every pair that reaches the cutoff, different names too."""
    names = table(spark, d, "part").select(F.col("p_name").alias("term")).distinct()
    asked = names.select(F.explode(F.array("term", F.concat("term", F.lit("x")), F.expr("substr(term, 2)"))).alias("query")).distinct()
    terms = dictionary.vocabulary(names.withColumn("label", F.lit("part")))
    return dictionary.fuzzy_join(asked, "query", terms).select("query", "term", F.round("score", 6).alias("score"))


@query(f"""
SELECT query, term, score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, term) AS r FROM ({_NEAR}) WHERE score >= 93) WHERE r = 1
""")
def fuzzy_best_match(spark, d):
    """The nearest name of each variant."""
    return dictionary.best_match(fuzzy_pairs_all(spark, d).withColumn("label", F.lit("part"))).select("query", "term", "score")


@query("SELECT o_orderkey, o_totalprice / 1000000 AS val_loss FROM orders WHERE o_totalprice / 1000000 <= 0.15")
def report_filter(spark, d):
    runs = table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000000).alias("val_loss"))
    return report.at_most(runs, "val_loss")


@query("SELECT doc_id, lang FROM documents ORDER BY doc_id LIMIT 150")
def document_limit(spark, d):
    return sampling.limited(table(spark, d, "documents").select("doc_id", "lang"), "doc_id", 150)


@query("""
SELECT parameter, setting, count(v) AS n, round(min(v), 6) AS low, round(quantile_cont(v, 0.25), 6) AS q1, round(quantile_cont(v, 0.5), 6) AS middle,
  round(quantile_cont(v, 0.75), 6) AS q3, round(max(v), 6) AS high
FROM (SELECT 'o_orderpriority' AS parameter, o_orderpriority AS setting, o_totalprice AS v FROM orders
      UNION ALL SELECT 'o_orderstatus', o_orderstatus, o_totalprice FROM orders) GROUP BY 1, 2
""")
def five_number_summary(spark, d):
    rows = report.five_numbers(table(spark, d, "orders"), "o_totalprice", "o_orderpriority", "o_orderstatus")
    return rows.select("parameter", "setting", "n", *[F.round(c, 6).alias(c) for c in ("low", "q1", "middle", "q3", "high")])


@query("""
SELECT round(regr_slope(l_extendedprice, l_quantity), 4) AS slope, round(regr_intercept(l_extendedprice, l_quantity), 3) AS intercept, round(regr_r2(l_extendedprice, l_quantity), 6) AS r2 FROM lineitem
""")
def ols_r2(spark, d):
    rows = report.simple_regression(table(spark, d, "lineitem"), "l_extendedprice", "l_quantity")
    return rows.select(F.round("slope", 4).alias("slope"), F.round("intercept", 3).alias("intercept"), F.round("r2", 6).alias("r2"))


_LOSS = "SELECT event_type AS run, CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, round(avg(value), 6) AS loss FROM events GROUP BY 1, 2"


def _losses(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")).cast("long")
    return table(spark, d, "events").groupBy(F.col("event_type").alias("run"), day.alias("epoch")).agg(F.round(F.avg("value"), 6).alias("loss"))


@query(f"""
WITH l AS ({_LOSS}), m AS (
  SELECT *, row_number() OVER w AS n, min(loss) OVER (PARTITION BY run ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM l WINDOW w AS (PARTITION BY run ORDER BY epoch)),
r AS (SELECT *, max(CASE WHEN loss <= coalesce(before, loss) THEN n END) OVER (PARTITION BY run ORDER BY epoch) AS last FROM m)
SELECT run, epoch, least(loss, coalesce(before, loss)) AS best, CAST(n - last AS INTEGER) AS counter, n - last > 2 AS stop FROM r
""")
def early_stop_trace(spark, d):
    return report.early_stopping(_losses(spark, d), "run", "epoch", "loss", 2).select("run", "epoch", "best", "counter", "stop")


@query("""
WITH m AS (SELECT CAST(date_diff('day', DATE '2000-01-01', CAST(ts AS DATE)) AS BIGINT) AS epoch, event_type AS run, avg(value) AS loss FROM events GROUP BY 1, 2)
SELECT epoch, run, round(loss, 5) AS mean_loss FROM m UNION ALL SELECT epoch, 'total', round(sum(loss), 5) FROM m GROUP BY epoch
""")
def epoch_loss_means(spark, d):
    day = F.datediff(F.col("ts").cast("date"), F.lit("2000-01-01").cast("date")).cast("long")
    rows = report.loss_means(table(spark, d, "events").select(day.alias("epoch"), F.col("event_type").alias("run"), "value"), "epoch", "run", "value")
    return rows.select("epoch", "run", F.round("mean_loss", 5).alias("mean_loss"))


@query("""
WITH h AS (SELECT doc_id, row_number() OVER (ORDER BY md5('42:' || doc_id), doc_id) - 1 AS i FROM documents WHERE n_chars < 5000)
SELECT doc_id, CAST(i // 32 AS BIGINT) AS batch, CAST(i % 32 AS BIGINT) AS slot FROM h
""")
def length_limited_batches(spark, d):
    docs = sampling.length_limited(table(spark, d, "documents"), "n_chars", 5000).select("doc_id")
    return sampling.batches(docs, "doc_id", 32)


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1), w AS (SELECT event_type AS t, n AS own, (SELECT max(n) FROM c) AS most FROM c ORDER BY n, event_type LIMIT 1),
donor AS (SELECT event_id, event_type, row_number() OVER (ORDER BY md5('42:' || event_id), event_id) - 1 AS slot FROM events, w WHERE event_type = t),
draw AS (SELECT copy, CAST('0x' || substr(md5('42:' || copy), 1, 8) AS BIGINT) % own AS slot FROM w, unnest(range(1, most - own + 1)) AS r(copy))
SELECT event_id, event_type, CAST(0 AS BIGINT) AS copy FROM events UNION ALL SELECT event_id, event_type, copy FROM draw JOIN donor USING (slot)
""")
def upsample_majority(spark, d):
    events = table(spark, d, "events").select("event_id", "event_type")
    rare = events.groupBy("event_type").count().orderBy("count", "event_type").first()
    return sampling.upsampled(events, "event_id", "event_type", rare["event_type"] if rare else "")


_GRID = {"optimizer": ["adam", "nadam", "adamW"], "lr": ["0.01", "0.001", "0.002"], "dropout": ["0", "0.1"], "batch_size": ["8", "16", "32"]}


@query(f"""
WITH g AS (SELECT * FROM {', '.join(f"(VALUES {', '.join(f"('{v}')" for v in values)}) AS t{i}({name})" for i, (name, values) in enumerate(_GRID.items()))})
SELECT optimizer, lr, dropout, batch_size FROM g ORDER BY md5('42:' || optimizer || '|' || lr || '|' || dropout || '|' || batch_size) LIMIT 25
""")
def config_grid_sample(spark, d):
    return sampling.sampled_grid(sampling.grid(spark, **_GRID), 25)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS first FROM events GROUP BY 1, 2)
SELECT user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, first) AS r FROM c) WHERE r = 1
""")
def most_common_type(spark, d):
    return sampling.most_common(table(spark, d, "events"), "user_id", "event_type", "event_id")


@query("SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def windowed_event_counts(spark, d):
    from skein.streaming import annotate

    rows = annotate.windowed_counts(table(spark, d, "events"), "ts", "event_type")
    return rows.select(F.col("start"), "event_type", "n")


@query("SELECT doc_id, 'rule' AS annotator, '<annotation>' || coalesce(lang, '') || length(text) || '</annotation>' AS annotation FROM documents")
def annotate_incremental(spark, d):
    """The documents as a stream of files, annotated twice; the second run adds nothing."""
    import uuid

    from skein.operators import markup
    from skein.streaming import annotate

    base = f"{_shared(spark)}/skein-stream-{uuid.uuid4().hex}"
    docs = table(spark, d, "documents").select("doc_id", "text", "lang")
    docs.write.parquet(f"{base}/in/a")

    def work(batch):
        return batch.select("doc_id", F.lit("rule").alias("annotator"), markup.annotation(F.col("lang"), F.length("text").cast("string")).alias("annotation"))

    for part in ("one", "two"):
        annotate.run(spark, f"{base}/in/a", "doc_id bigint, text string, lang string", work, f"{base}/out", f"{base}/checkpoint-{part}")
    return spark.read.parquet(f"{base}/out")


def _shared(spark):
    import re
    import tempfile

    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return (folder or tempfile.mkdtemp(prefix="skein-")).rstrip("/")
