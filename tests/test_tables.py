"""Readers, writers, streams and the operators that have no SQL."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein.operators import catalogue, dictionary, labels, metrics, relations, report, sampling
from skein.sources import readers, writers
from skein.streaming import annotate


def test_documents_by_suffix(spark, tmp_path):
    (tmp_path / "a.csv").write_text(',doc_id,abstract,fulltext\n0,1,"x, y",z\n1,2,,w\n')
    (tmp_path / "b.json").write_text('{"doc_id": 3, "abstract": "q", "body": "r"}\n')
    a, b = readers.read_documents(spark, str(tmp_path / "a.csv")), readers.read_documents(spark, str(tmp_path / "b.json"))
    assert sorted(map(tuple, a.unionByName(b).collect())) == [(1, "x, y", "z"), (2, None, "w"), (3, "q", "r")]
    with pytest.raises(ValueError, match="unknown"):
        readers.read_documents(spark, "c.txt")


def test_lines_keys_and_config(spark, tmp_path):
    (tmp_path / "l").write_text("b \n a\nb\n\n")
    (tmp_path / "k.json").write_text('{"data": {"first": 1, "second": 2, "third": 3}}')
    assert sorted(r["term"] for r in readers.read_lines(spark, str(tmp_path / "l")).collect()) == ["a", "b"]
    assert [r["key"] for r in readers.read_keys(spark, str(tmp_path / "k.json")).collect()] == ["second", "third"]
    assert readers.read_config('lr = 0.1\nlayers = [1, 2]') == {"lr": 0.1, "layers": [1, 2]}


def test_scraped_references(spark):
    cells = lambda row, *texts: "".join(f'<div id="tab30r{row}sr0c{i}"><span>{t}</span></div>' for i, t in enumerate(texts))
    html = "<table>" + cells(0, "1", "", "", "", "", "", "", "Escherichia coli, Bacillus", "77") + cells(1, "2", "", "", "", "", "", "", "Homo", "-") + "</table>"
    got = readers.references(spark.createDataFrame([("1.1", html)], "enzyme string, html string"), "enzyme", "html", "tab30r").orderBy("reference", "organism").collect()
    assert list(map(tuple, got)) == [("1.1", "1", "Bacillus", "77"), ("1.1", "1", "Escherichia coli", "77"), ("1.1", "2", "Homo", "-")]


def test_summaries(spark):
    good = '<r><DocSum><Id>5</Id><Item Name="T">x</Item><Item Name="L"><Item Name="a">y</Item></Item><Item Name="E"></Item></DocSum></r>'
    frame = spark.createDataFrame([(good,), ("<r><ERROR>no</ERROR></r>",)], "x string")
    rows = readers.summaries(frame, "x").collect()
    assert len(rows) == 1 and rows[0]["id"] == "5"
    assert rows[0]["fields"]["T"] == "x" and rows[0]["fields"]["E"] == "" and '"a":"y"' in rows[0]["fields"]["L"]


def test_keyed_writes(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda *r: spark.createDataFrame(list(r), "doc_id long, v string")
    writers.append_new(rows((1, "a")), path, "doc_id")
    writers.append_new(rows((1, "b"), (2, "c")), path, "doc_id")
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "a"), (2, "c")]
    writers.append_new(rows((1, "z")), path, "doc_id", force=True)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == [(1, "z"), (2, "c")]
    writers.clear(spark, path)
    assert spark.read.parquet(path).count() == 0
    writers.append_json(rows((1, None)), str(tmp_path / "j"))
    assert spark.read.text(str(tmp_path / "j")).first()["value"] == '{"doc_id":1,"v":null}'
    writers.append_csv(rows((1, "q")), str(tmp_path / "c"))
    writers.append_csv(rows((2, "r")), str(tmp_path / "c"))
    assert readers.read_csv(spark, str(tmp_path / "c")).count() == 2
    writers.log_metrics(spark, str(tmp_path / "m"), {"lr": 0.1}, loss=0.5)
    assert spark.read.parquet(str(tmp_path / "m")).first().asDict() == {"lr": 0.1, "loss": 0.5}


def test_stream_replay_adds_nothing(spark, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    work = lambda df: df.select("doc_id", F.lit("me").alias("annotator"))
    spark.range(5).withColumnRenamed("id", "doc_id").write.parquet(f"{source}/a")
    run = lambda checkpoint: annotate.run(spark, f"{source}/*", "doc_id bigint", work, target, str(tmp_path / checkpoint))
    assert run("c") >= 1
    spark.range(3, 8).withColumnRenamed("id", "doc_id").write.parquet(f"{source}/b")
    run("c")
    run("other")
    assert sorted(r["doc_id"] for r in spark.read.parquet(target).collect()) == list(range(8))
    docs = spark.range(10).withColumnRenamed("id", "doc_id")
    assert annotate.pending(docs, spark.read.parquet(target), "me").count() == 2
    assert annotate.pending(docs, spark.read.parquet(target), "you").count() == 10


def test_fuzzy_members_equal_brute_force(spark):
    from skein.functions import fuzzy

    words = ["escherichia coli", "escherichia colii", "bacillus", "bacilus subtilis", "", "homo sapiens", "e coli"]
    terms = ["escherichia coli", "bacillus subtilis", "homo sapien"]
    frame = spark.createDataFrame([(w,) for w in words] + [(None,)], "name string")
    got = {r["name"] for r in dictionary.fuzzy_members(frame, "name", spark.createDataFrame([(t,) for t in terms], "term string")).collect()}
    assert got == {w for w in words if max(fuzzy.ratio(w, t) for t in terms) > 90}


def test_fuzzy_membership_asks_all_names(spark):
    from skein.functions import fuzzy
    from skein.plans import catalogue as plans

    folder = "/root/testdata/sf0.001"
    parts = [tuple(r) for r in spark.read.parquet(f"{folder}/part.parquet").select("p_partkey", "p_name").collect()]
    names = {n for _, n in parts if n is not None}
    members = {n for n in names if any(fuzzy.ratio(n, t + "x") > 90 for t in names)}
    got = plans.QUERIES["fuzzy_membership"](spark, folder).collect()
    assert len(members) > 20 and sorted(map(tuple, got)) == sorted(p for p in parts if p[1] in members)


def test_fuzzy_pairs_of_different_names(spark):
    from skein.functions import fuzzy
    from skein.plans import catalogue as plans

    folder = "/root/testdata/sf0.001"
    names = {r["p_name"] for r in spark.read.parquet(f"{folder}/part.parquet").select("p_name").collect()}
    asked = {q for n in names for q in (n, n + "x", n[1:]) if q}
    want = {(q, t): fuzzy.ratio(q, t) for q in asked for t in names if abs(len(q) - len(t)) <= 2 and fuzzy.ratio(q, t) >= 93}
    got = {(r["query"], r["term"]): r["score"] for r in plans.QUERIES["fuzzy_pairs_all"](spark, folder).collect()}
    assert got == {k: pytest.approx(v, abs=1e-6) for k, v in want.items()}
    assert ("cold anvil", "old anvil") in got


def test_pair_count_and_orientation(spark):
    rows = [(1, e) for e in "abcd"] + [(2, "a"), (3, None)]
    pairs = relations.entity_pairs(spark.createDataFrame(rows, "doc_id long, e string"), "doc_id", "e")
    assert pairs.count() == 6 and pairs.where("i >= j").count() == 0


def test_biaffine(spark):
    rng = np.random.default_rng(0)
    w = {"hidden_w": rng.normal(size=(4, 3)), "hidden_b": rng.normal(size=4), "bilinear": rng.normal(size=(2, 4, 4)), "linear_w": rng.normal(size=(2, 8)), "linear_b": rng.normal(size=2), "bias": rng.normal(size=2)}
    x, y = [0.1, -0.2, 0.3], [1.0, 0.5, -1.0]
    frame = spark.createDataFrame([(x, y)], "x array<double>, y array<double>")
    got = frame.select(relations.biaffine(F.col("x"), F.col("y"), w).alias("s")).first()["s"]
    a, b = (relations.gelu(w["hidden_w"] @ np.array(v) + w["hidden_b"]) for v in (x, y))
    assert got == pytest.approx([a @ w["bilinear"][r] @ b + w["linear_w"][r] @ np.concatenate([a, b]) + w["linear_b"][r] + w["bias"][r] for r in range(2)])


def test_metrics_edges(spark):
    rows = [(1, 0, 0.9, 1), (1, 1, 0.9, 0), (2, 0, 0.1, 0), (2, 1, 0.2, 0)]
    frame = metrics.decisions(spark.createDataFrame(rows, "doc_id long, label_ix long, p double, y int"))
    assert metrics.micro(frame).first().asDict() == {"precision": 0.5, "recall": 1.0, "f1": pytest.approx(2 / 3)}
    assert metrics.macro_f1(frame).first()["macro_f1"] is None
    assert metrics.label_ranking_precision(frame).first()["lrap"] == pytest.approx((0.5 + 1) / 2)
    assert metrics.micro_average_precision(frame).first()["average_precision"] == pytest.approx(0.5)


def test_regression_and_loss(spark):
    frame = spark.createDataFrame([(float(i), float(i % 3), 2.0 * i + (i % 3)) for i in range(12)], "a double, b double, y double")
    assert report.regression(frame, "y ~ a * b").summary.r2 == pytest.approx(1.0)
    log = spark.createDataFrame([("r", e, l) for e, l in enumerate([3.0, 2.0, 2.0, 2.5, 2.6, 2.7])], "run string, epoch int, loss double")
    rows = report.early_stopping(log, "run", "epoch", "loss", 2).orderBy("epoch").collect()
    assert [r["counter"] for r in rows] == [0, 0, 0, 1, 2, 3] and [r["stop"] for r in rows][-2:] == [False, True]
    rows = report.early_stopping(log, "run", "epoch", "loss", 2, ramp=4).orderBy("epoch").collect()
    assert [r["counter"] for r in rows] == [0, 0, 0, 1, 1, 2]


def test_sampling(spark):
    docs = spark.range(100).withColumnRenamed("id", "doc_id")
    first, again = (sorted(map(tuple, sampling.batches(docs, "doc_id", 7).collect())) for _ in range(2))
    assert first == again and len({b for _, b, _ in first}) == 15 and max(s for *_, s in first) == 6
    split = readers.read_split(docs.limit(3).withColumn("split", F.lit("train")), spark.range(200, 300).withColumnRenamed("id", "doc_id"), {"train": 9, "val": 4})
    assert {(r["split"], r["noise"]): r["count"] for r in split.groupBy("split", "noise").count().collect()} == {("train", False): 3, ("train", True): 9, ("val", True): 4}
    with pytest.raises(ValueError, match="fewer"):
        sampling.sampled_grid(sampling.grid(spark, a=[1, 2]), 3)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "doc_id long, e string")
    assert relations.entity_pairs(empty, "doc_id", "e").count() == 0
    assert labels.frequencies(empty, "e", "doc_id", 5).count() == 0
    assert catalogue.keep_first(empty, "e", "doc_id").count() == 0
    assert sampling.batches(empty, "doc_id", 4).count() == 0
    assert labels.indexed(empty.select(F.col("e").alias("class"), F.col("e").alias("entity"))).count() == 0


def test_every_entity_class_in_every_split(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet").join(spark.read.parquet("/root/testdata/sf0.01/part.parquet"), F.expr("l_partkey = p_partkey"))
    counts = rows.withColumn("split", F.col("l_orderkey") % 3).groupBy("split", "p_type").count()
    assert counts.count() == 3 * rows.select("p_type").distinct().count()


def test_entry(spark):
    import __spark_entry__

    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
    assert __spark_entry__.entry(spark).columns == ["lang", "label", "n", "n_docs"]


def test_decoded_predictions(spark):
    from skein.operators import dataset

    pieces = ["[CLS]", "lepid", "##optera", "is", "[SEP]"]
    rows = [(1, 0, i, p, 2 * i, 2 * i + 2, [0.0, 3.0] if "p" in p and "#" not in p else [3.0, 0.0]) for i, p in enumerate(pieces)]
    frame = spark.createDataFrame(rows, "doc_id long, segment int, position int, string string, start int, end int, logits array<double>")
    got = dataset.decoded(frame, ["O", "B-X"]).first()["tokens"]
    assert [(t["string"], t["prediction"], t["offset"]["start"], t["offset"]["end"]) for t in got] == [("lepidoptera", "B-X", 2, 6), ("is", "O", 6, 8)]
    assert got[0]["prob"] == pytest.approx(1 / (1 + np.exp(-3)))
