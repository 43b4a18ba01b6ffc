"""Small parts that no query covers, against plain Python."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from skein import schema
from skein.functions import fuzzy, scores, text
from skein.operators import catalogue, dataset, relations, report, sampling
from skein.sources import readers, writers
from skein.streaming import annotate


def pairs(spark, *rows):
    return spark.createDataFrame(list(rows), "doc_id long, v string")


def test_database(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    pairs(spark, (1, "a"), (2, None)).write.format("jdbc").options(url=url, dbtable="T", user="u", password="p").save()
    got = readers.read_database(spark, url, "T", "u", "p").where("doc_id > 1")
    assert list(map(tuple, got.collect())) == [(2, None)]


def test_articles(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<set><article><id>7</id><p>one</p><p>two</p></article><article><id>8</id></article></set>")
    got = readers.read_articles(spark, str(tmp_path / "a.xml"), "article", "id bigint, p array<string>").orderBy("id").collect()
    assert [(r["id"], r["p"]) for r in got] == [(7, ["one", "two"]), (8, None)]


def test_overwritten_csv_and_packed_vectors(spark, tmp_path):
    for rows in ([(1, "a"), (2, "b")], [(3, "c")]):
        writers.overwrite_csv(pairs(spark, *rows), str(tmp_path / "c"))
    assert [r["v"] for r in readers.read_csv(spark, str(tmp_path / "c")).collect()] == ["c"]
    frame = spark.createDataFrame([(1, [0.1, 2.0]), (2, None)], "id int, x array<double>")
    packed = writers.packed(frame, "x")
    assert dict(packed.dtypes)["x"] == "array<float>"
    assert [None if r["x"] is None else np.float32(r["x"]).tolist() for r in packed.orderBy("id").collect()] == [np.float32([0.1, 2.0]).tolist(), None]


def test_upsert_survives_a_break(spark, tmp_path):
    path = str(tmp_path / "t")
    rows = lambda: sorted(map(tuple, spark.read.parquet(path).collect()))
    writers.upsert(pairs(spark, (1, "a"), (2, "b")), path, "doc_id")
    writers.upsert(pairs(spark, (2, "c"), (3, "d")), path, "doc_id")
    assert rows() == [(1, "a"), (2, "c"), (3, "d")]
    pairs(spark, (9, "z")).write.parquet(f"{path}.next")  # broke off while the new table was written
    writers.upsert(pairs(spark, (3, "e")), path, "doc_id")
    assert rows() == [(1, "a"), (2, "c"), (3, "e")]
    pairs(spark, (5, "q")).write.parquet(f"{path}.next")  # broke off between the two moves
    writers.move(spark, path, f"{path}.before")
    writers.recover(spark, path)
    assert rows() == [(5, "q")] and not writers.exists(spark, f"{path}.before")
    pairs(spark, (6, "r")).write.parquet(f"{path}.before")  # broke off before the old table went
    writers.upsert(pairs(spark, (5, "s")), path, "doc_id")
    assert rows() == [(5, "s")] and not writers.exists(spark, f"{path}.before")


def test_repeated_keys_of_a_stream(spark, tmp_path):
    pairs(spark, (1, "a"), (1, "c"), (1, "b"), (2, None)).repartition(4).write.parquet(str(tmp_path / "in"))
    annotate.run(spark, str(tmp_path / "in"), "doc_id bigint, v string", lambda batch: batch, str(tmp_path / "out"), str(tmp_path / "check"))
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).collect()), key=str) == [(1, "c"), (2, None)]


def test_limits_and_filters(spark):
    frame = pairs(spark, (3, "c"), (1, "a"), (2, None))
    assert [r["doc_id"] for r in sampling.limited(frame, "doc_id", 2).collect()] == [1, 2]
    assert sampling.limited(frame, "doc_id").count() == 3
    losses = spark.createDataFrame([(0.15,), (0.16,), (None,)], "val_loss double")
    assert report.at_most(losses, "val_loss").count() == 1
    assert catalogue.without(frame, "v", "absent").columns == ["doc_id"]
    cut = spark.createDataFrame([(92.9,), (93.0,)], "s double").select(fuzzy.cut(F.col("s"), 93.0).alias("s")).collect()
    assert [r["s"] for r in cut] == [0.0, 93.0]
    masked = spark.range(4).select(scores.masked(F.lit(2.0), F.col("id"), F.lit(2)).alias("m")).collect()
    assert [r["m"] for r in masked] == [2.0, 2.0, -1e9, -1e9]


def test_token_columns(spark):
    token = lambda s: (s, (0, 1), "O", None, None)
    frame = spark.createDataFrame([([token("[CLS]"), token("a"), token("[PAD]")], [(0, 1)])], f"t array<{schema.TOKEN}>, o array<{schema.OFFSET}>")
    row = frame.select(F.transform(text.without_specials(F.col("t")), lambda t: t["string"]).alias("t"), text.padded_offsets(F.col("o"), 3).alias("o"), text.padded_offsets(F.col("o"), 0).alias("p")).first()
    assert row["t"] == ["a"] and [tuple(x) for x in row["o"]] == [(0, 1), (0, 0), (0, 0)] and len(row["p"]) == 1
    marked = spark.createDataFrame([("a<b", "B-OOS", 3), ("c", "I-Site", 4)], "x string, p string, i int").select(text.entity_markup(F.col("x"), F.col("p"), F.col("i"), "ex").alias("m"))
    assert [r["m"] for r in marked.collect()] == ['<span class="entity" resource="#T3" typeof="OOS">a&lt;b</span>', '<span class="entity" resource="#T4" typeof="ex:Site">c</span>']


def plain_biaffine(x, y, w):
    h, k = (relations.gelu(w["hidden_w"] @ v + w["hidden_b"]) for v in (x, y))
    return np.array([h @ r @ k for r in w["bilinear"]]) + w["linear_w"] @ np.concatenate([h, k]) + w["linear_b"] + w["bias"]


@pytest.fixture(scope="module")
def weights():
    rng = np.random.default_rng(1)
    return {"hidden_w": rng.normal(size=(4, 3)), "hidden_b": rng.normal(size=4), "bilinear": rng.normal(size=(2, 4, 4)), "linear_w": rng.normal(size=(2, 8)), "linear_b": rng.normal(size=2), "bias": rng.normal(size=2)}


def test_pair_logits(spark, weights):
    rng = np.random.default_rng(2)
    mentions = [(d, int(e), rng.normal(size=3).tolist()) for d, e in ((1, 5), (1, 5), (1, 7), (1, 9), (2, 5), (3, 1), (3, 2))] + [(1, None, [1.0, 1.0, 1.0])]
    frame = spark.createDataFrame(mentions, "doc_id long, entity int, vector array<double>")
    pooled = {}
    for d, e, v in mentions:
        if e is not None:
            pooled.setdefault((d, e), []).append(v)
    pooled = {k: np.log(np.exp(v).sum(0)) for k, v in pooled.items()}
    want = {(d, i, j): plain_biaffine(pooled[d, i], pooled[d, j], weights) for d, i in pooled for e, j in pooled if d == e and i < j}
    got = {(r["doc_id"], r["i"], r["j"]): r["logits"] for r in relations.pair_logits(frame, "doc_id", "entity", "vector", weights).collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)


def test_gold_logits(spark, weights):
    rng = np.random.default_rng(3)
    tokens = [(d, e, float(rng.normal()), rng.normal(size=3).tolist()) for d in (1, 2) for e in (5, 7) for _ in range(4)]
    gold = [(1, 5, 7, 0), (1, 7, 5, 1), (2, 5, 8, 0), (4, 5, 7, 1)]
    frame = spark.createDataFrame(tokens, "doc_id long, entity int, logit double, vector array<double>")
    got = {tuple(r)[:4]: r["logits"] for r in relations.gold_logits(spark.createDataFrame(gold, "doc_id long, subject int, object int, label int"), frame, "doc_id", "entity", "logit", "vector", weights).collect()}

    def soft(d, e):
        own = [(z, np.array(v)) for a, b, z, v in tokens if (a, b) == (d, e)]
        w = np.exp([z for z, _ in own])
        return sum(x * v for x, (_, v) in zip(w / w.sum(), own))

    assert set(got) == {(1, 5, 7, 0), (1, 7, 5, 1)}
    assert all(got[k] == pytest.approx(plain_biaffine(soft(k[0], k[1]), soft(k[0], k[2]), weights)) for k in got)


@pytest.mark.parametrize(("room", "fresh"), [(None, [2, 3]), (2, [2]), (1, []), (0, [])])
def test_lookup_and_fill(spark, room, fresh):
    cache, wanted = pairs(spark, (1, "old"), (9, "other")).where("doc_id = 1"), pairs(spark, (1, None), (3, None), (2, None))
    rows, new = dataset.looked_up(wanted, cache, lambda missing: missing.select("doc_id", F.lit("new").alias("v")), room=room)
    assert sorted(map(tuple, rows.collect())) == [(1, "old"), (2, "new"), (3, "new")]
    assert sorted(r["doc_id"] for r in new.collect()) == fresh
