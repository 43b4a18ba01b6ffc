"""Facts about tokens, segments, the dictionary tagger and markup."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from skein import schema
from skein.functions import flat, fuzzy, text
from skein.operators import dictionary, markup, tokens


def token(string, start, end, prediction="O"):
    return {"string": string, "offset": {"start": start, "end": end}, "prediction": prediction, "gold_label": None, "prob": None}


SENTENCE = [
    token("Growth", 60, 66), token("in", 67, 69), token("bri", 70, 73), token("##n", 73, 74), token("##y", 74, 75), token("mud", 76, 79), token("halts", 80, 85), token("slow", 86, 90),
    token("heat", 91, 95), token("loss", 96, 100), token(";", 100, 101), token("[SEP]", 0, 0),
]


def one(spark, column, **values):
    kinds = {"tokens": f"array<{schema.TOKEN}>", "windows": "array<array<int>>", "offsets": f"array<{schema.OFFSET}>"}
    frame = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {kinds.get(k, 'array<string>' if isinstance(v, list) else 'string')}" for k, v in values.items()))
    return frame.select(column.alias("x")).first()["x"]


def test_merge_off_tokens(spark):
    merged = one(spark, text.merged_off_tokens(F.col("tokens")), tokens=SENTENCE)
    assert [t["string"] for t in merged] == ["Growth", "in", "briny", "mud", "halts", "slow", "heat", "loss", ";"]
    assert (merged[2]["offset"]["start"], merged[2]["offset"]["end"]) == (70, 75)
    assert one(spark, text.merged_off_tokens(F.col("tokens")), tokens=[]) == []


def test_long_arrays_merge_in_one_pass(spark):
    rows = [token(("##" if i % 4 else "") + "abc", 3 * i, 3 * i + 3, "B-X") for i in range(20_000)]
    frame = spark.createDataFrame([(rows,), (None,)], f"t array<{schema.TOKEN}>").select(text.merged_off_tokens(F.col("t")).alias("m"))
    assert frame._jdf.queryExecution().analyzed().toString().count("[SEP]") <= 1  # the pieces without specials are not made anew for each word
    merged, none = (r["m"] for r in frame.collect())
    assert none is None and [(t["string"], t["offset"]["start"]) for t in merged] == [("abc" * 4, 12 * i) for i in range(5_000)]


def test_detokenised(spark):
    merged = text.merged_off_tokens(F.col("tokens"))
    assert one(spark, text.detokenised(merged), tokens=SENTENCE) == "Growth in briny mud halts slow heat loss;"
    assert one(spark, text.detokenised(F.col("tokens")), tokens=[]) == ""


def test_merged_pieces(spark):
    pieces = "[CLS] salt marsh mol ##lus ##cs ! [SEP] [PAD]".split()
    tags = ["#", "O", "O", "B-Shell", "B-Shell", "I-Shell", "O", "#", "#"]
    rows = spark.createDataFrame([(1, i, p, i, i + 1, t) for i, (p, t) in enumerate(zip(pieces, tags))], "doc_id long, pos long, piece string, start int, end int, prediction string")
    got = [(r["string"], r["prediction"]) for r in tokens.merged_pieces(rows).orderBy("word").collect()]
    assert got == [("salt", "O"), ("marsh", "O"), ("molluscs", "B-Shell"), ("!", "O")]


def test_one_window_stays_as_it_is(spark):
    assert one(spark, tokens.merged_predictions(F.col("windows"), 50), windows=[[9, 1, 2, 8]]) == [9, 1, 2, 8]
    assert one(spark, tokens.merged_predictions(F.col("windows"), 2), windows=[[9, 1, 2, 3, 8], [9, 2, 3, 4, 8]]) == [1, 2, 3, 4]


@pytest.mark.parametrize("stride", [0, 1, 4, 5])
@pytest.mark.parametrize("n", [0, 1, 14, 15, 16, 40, 97])
def test_segments_merge_back(spark, n, stride):
    whole = F.slice(F.sequence(F.lit(0), F.lit(n)), 1, n)
    cut = tokens.segments(whole, 16, stride)
    row = spark.range(1).select(cut.alias("w"), whole.alias("t"), tokens.merged_by_half_stride(cut, stride).alias("a"), tokens.merged_by_suffix(cut, stride).alias("b")).first()
    assert row["a"] == row["t"] == row["b"]
    assert all(len(w) <= 14 for w in row["w"])


def test_dictionary_tagger(spark):
    terms = spark.createDataFrame([("event", "slow heat losss"), ("place", "briny mud"), ("event", "tidal bore")], "label string, term string")
    merged = text.merged_off_tokens(F.col("tokens"))
    frame = spark.createDataFrame([(1, SENTENCE), (2, SENTENCE), (3, []), (4, None)], f"id int, tokens array<{schema.TOKEN}>").select("id", merged.alias("tokens"))
    got = {r["id"]: r["tokens"] for r in dictionary.tagged(frame, "tokens", terms).collect()}
    want = [("Growth", "O", 60, 66), ("in", "O", 67, 69), ("briny mud", "place", 70, 79), ("halts", "O", 80, 85), ("slow heat loss", "event", 86, 100), (";", "O", 100, 101)]
    assert [(t["string"], t["prediction"], t["offset"]["start"], t["offset"]["end"]) for t in got[1]] == want
    assert got[1] == got[2] and got[3] == [] and not got[4]
    assert dictionary.tagged(frame, "tokens", terms.limit(0)).count() == 4


def retagged(sample, terms, prefix):
    """The tagger, token by token."""
    out, i = [], 0
    while i < len(sample):
        best = (0.0, None, 0)
        run, end = "", sample[i]["offset"]["start"]
        scores = []
        for n, t in enumerate(sample[i : i + prefix], 1):
            if t["prediction"] != "O":
                break
            run += " " * (t["offset"]["start"] - end) + t["string"]
            end = t["offset"]["end"]
            for label, term in terms:
                if abs(len(term) - len(run)) <= 2 and (score := fuzzy.ratio(run, term)) >= 93:
                    scores.append((-score, label, n))
        if scores:
            _, label, n = min(scores)
            best = (1, label, n)
        n = best[2]
        if not n:
            out.append((sample[i]["string"], sample[i]["prediction"]))
            i += 1
            continue
        string = sample[i]["string"]
        for a, b in zip(sample[i : i + n], sample[i + 1 : i + n]):
            string += " " * (b["offset"]["start"] - a["offset"]["end"]) + b["string"].lstrip("#")
        out.append((string, best[1]))
        i += n
    return out


@pytest.mark.parametrize("small", [0, 10**6])
def test_tagger_equals_a_plain_loop(spark, monkeypatch, small):
    monkeypatch.setattr(dictionary, "SMALL", small)
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("ab") for _ in range(rng.randint(1, 5)))
    docs = []
    for _ in range(25):
        at, doc = rng.randint(0, 3), []
        for _ in range(rng.randint(0, 25)):
            w = rng.choice(["", "", "", "#"]) + word()
            doc.append(token(w, at, at + len(w), rng.choice(["O"] * 6 + ["B-X"])))
            at += len(w) + rng.choice([0, 1, 1, 1, 2])
        docs.append(doc)
    terms = sorted({(rng.choice("xy"), " ".join(word() for _ in range(rng.randint(1, 5)))) for _ in range(60)})
    frame = spark.createDataFrame(list(enumerate(docs)), f"id int, tokens array<{schema.TOKEN}>")
    got = {r["id"]: r["tokens"] for r in dictionary.tagged(frame, "tokens", spark.createDataFrame(terms, "label string, term string"), prefix=6).collect()}
    for i, doc in enumerate(docs):
        assert [(t["string"], t["prediction"]) for t in got[i]] == retagged(doc, terms, 6)


def test_tagged_markup_makes_no_rows_of_prefixes(spark, monkeypatch):
    def refused(*_):
        raise AssertionError("a row for each prefix")

    monkeypatch.setattr(dictionary, "prefixes", refused)
    terms = spark.createDataFrame([("place", "briny mud"), ("event", "slow heat loss")], "label string, term string")
    frame = spark.createDataFrame([(1, SENTENCE[:2] + [token("briny", 70, 75)] + SENTENCE[5:-1]), (2, []), (3, None)], f"id int, tokens array<{schema.TOKEN}>")
    got = {r["id"]: r["m"] for r in dictionary.tagged(frame, "tokens", terms).select("id", markup.markup(F.col("tokens")).alias("m")).collect()}
    assert re.findall(r'resource="#T(\d)" typeof="ex:(\w+)">([^<]*)<', got[1]) == [("1", "place", "briny mud"), ("2", "event", "slow heat loss")]
    assert got[2] == markup.serialised([]) and got[3] is None


def test_tagger_holds_workers_to_small_batches(spark):
    """Each form of a batch's tokens takes memory in a worker."""
    for key in ("maxRecordsPerBatch", "maxBytesPerBatch"):
        spark.conf.unset(f"spark.sql.execution.arrow.{key}")

    @F.arrow_udf("int")
    def rows(column: pa.Array) -> pa.Array:
        return pa.repeat(pa.scalar(len(column), pa.int32()), len(column))

    frame = spark.range(0, 9000, 1, 1).select(F.array().cast(f"array<{schema.TOKEN}>").alias("tokens"))
    tagged = dictionary.tagged(frame, "tokens", spark.createDataFrame([("place", "briny mud")], "label string, term string"))
    assert tagged.select(rows("tokens").alias("n")).agg(F.max("n")).first()[0] <= 2000


@pytest.mark.parametrize("cutoff", [93.0, 80.0])
def test_filters_pass_near_texts_and_few_others(spark, cutoff):
    rng = random.Random(5)
    words = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(3))
    terms = sorted({words() for _ in range(80)})
    texts = {words() for _ in range(150)}
    for term in terms:
        w = list(term)
        for _ in range(rng.randint(0, 3)):
            at = rng.randrange(len(w) + 1)
            w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", " "])
        texts.add("".join(w))
    frame = spark.createDataFrame([([token(t, 0, len(t))],) for t in sorted(texts)], f"tokens array<{schema.TOKEN}>")
    vocabulary = spark.createDataFrame([("x", t) for t in terms], "label string, term string")
    got = {r["text"] for r in dictionary.candidates(frame, "tokens", vocabulary, min(map(len, terms)), max(map(len, terms)) + 2, cutoff).collect()}
    near = {t for t in texts if any(abs(len(t) - len(x)) <= 2 and fuzzy.ratio(t, x) >= cutoff for x in terms)}
    assert near <= got and (cutoff < 93 or len(got) - len(near) < len(texts) / 5)


def test_best_tells_texts_of_one_hash_apart(monkeypatch):
    monkeypatch.setattr(flat, "rolls", lambda sums, start, size: np.full(len(start), 7, np.uint64))
    best = dictionary._Best(pa.table({"text": ["ab", "c"], "score": [-100.0, -95.0], "label": ["x", "y"]}))
    found, at = best.near(np.array([7, 8, 7, 7], np.uint64))
    assert found.tolist() == [0, 2, 3]
    assert best.get(["ab", "c", "d"], at) == [(-100.0, "x"), (-95.0, "y"), None]


def test_token_spans_equal_the_pattern():
    import pyarrow as pa
    import regex

    rng = random.Random(3)
    signs = "ab_1\u00e9\u0301 \t\n\u0085\u00a0\u2028.\u4e2d\U0001f600\U00020000-"
    texts = [None, ""] + ["".join(rng.choice(signs) for _ in range(rng.randrange(9))) for _ in range(500)]
    pattern = regex.compile(text.TOKEN_PATTERN.replace(r"\s", r"\x09-\x0D\x20"), regex.V0)
    want = [[{"string": m.group(), "offset": {"start": m.start(), "end": m.end()}} for m in pattern.finditer(t or "")] for t in texts]
    assert tokens._spans(pa.array(texts, pa.string())).to_pylist() == want
    assert tokens._spans(pa.array(texts, pa.string()).slice(7)).to_pylist() == want[7:]


def test_every_near_pair_is_scored(spark):
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abc") for _ in range(rng.randint(1, 34))) for _ in range(150)})
    texts = set(terms)
    for term in terms:
        for _ in range(4):
            w = list(term)
            for _ in range(rng.randint(1, 3)):
                at = rng.randrange(len(w) + 1)
                w[at : at + rng.randint(0, 1)] = rng.choice(["", "a", "b", "x"])
            texts.add("".join(w))
    texts.discard("")
    want = {(q, t) for q in texts for t in terms if abs(len(q) - len(t)) <= 2 and fuzzy.ratio(q, t) >= 93}
    got = dictionary.scored(spark.createDataFrame([(t,) for t in sorted(texts)], "text string"), spark.createDataFrame([("x", t) for t in terms], "label string, term string")).collect()
    assert {(r["text"], r["term"]) for r in got} == want
    assert all(r["score"] == pytest.approx(fuzzy.ratio(r["text"], r["term"])) for r in got)


@given(st.text("abcd", max_size=12), st.text("abcd", max_size=12))
@settings(max_examples=200, deadline=None)
def test_lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[j]))
        row = new
    assert fuzzy.lcs(a, b) == row[-1]


def test_native_ratio(spark):
    rows = [("kitten", "sitting"), ("a", ""), (None, "b"), ("production", "product ion"), ("é", "é")]
    frame = spark.createDataFrame(rows, "a string, b string")
    for row in frame.select("a", "b", fuzzy.ratio_native(F.col("a"), F.col("b")).alias("n"), fuzzy.ratio_column("a", "b").alias("p")).collect():
        assert row["n"] == pytest.approx(row["p"]) == pytest.approx(fuzzy.ratio(row["a"], row["b"]))


def test_markup_shares_ids():
    source = [token("reef", 3, 7, "B-Site"), token("A9", 8, 10, "I-Site"), token("near", 11, 15), token("reef", 16, 20, "B-Site"), token("A9", 21, 23, "I-Site"), token("&", 24, 25), token("bay", 26, 29, "B-Site")]
    spans = re.findall(r'resource="#T(\d)" typeof="ex:Site">([^<]*)<', markup.serialised(source))
    assert spans == [("1", "reef A9"), ("1", "reef A9"), ("3", "bay")]
    assert markup.parsed(markup.serialised(source))[0] == "   reef A9 near reef A9 & bay"


def test_markup_abbreviates_bacteria():
    source = [token("Vibrio fischeri", 0, 15, "B-Bacteria"), token("or", 16, 18), token("V. fischeri", 19, 30, "B-Bacteria"), token("<", 31, 32), token("Vibrio fischeri", 33, 48, "B-Fish")]
    out = markup.serialised(source)
    assert re.findall(r"#T(\d)", out) == ["1", "1", "3"] and "&lt;" in out


def test_mentions_go_on_over_a_gap():
    for plain, want in ((3, ["1", "1"]), (4, ["1", "2"])):
        source = [token("dune", 0, 4, "B-Site")] + [token("x", 5 + 2 * i, 6 + 2 * i) for i in range(plain)] + [token("crest", 20, 25, "I-Site")]
        assert re.findall(r"#T(\d)", markup.serialised(source)) == want


def test_strip_and_reinsert(spark):
    for html in ("<p>a <b>b</b><br/>c &amp; d</p>", "<p>open <i>never closed", "<script>x < 1</script>y<!-- z -->", ""):
        plain = markup.parsed(html)[0]
        annotated = markup.serialised([token(plain, 0, len(plain))] if plain else [])
        assert markup.parsed(markup.reinserted(annotated, html))[0] == plain
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select(markup.stripped("html").alias("t")).collect()
    assert all("<script" not in p["t"] for p in pages)


def test_small_columns(spark):
    frame = spark.createDataFrame([("a", None), (None, None), ("a", "b"), ("", "b")], "a string, b string")
    got = frame.select(text.safe_concat(F.col("a"), F.col("b")).alias("s"), text.joined_nonempty(F.col("a"), F.col("b"), "-").alias("j"), text.joined_text(F.col("a"), F.col("b")).alias("t")).collect()
    assert [r["s"] for r in got] == ["a", None, "ab", "b"]
    assert [r["j"] for r in got] == ["a", "", "a-b", "b"]
    assert [r["t"] for r in got] == ["a\n", "\n", "a\nb", "\nb"]
    assert one(spark, text.abbreviated(F.col("name")), name="Éscherichia coli") == "É. coli"
    assert one(spark, F.array_join(text.split_trimmed(F.col("name")), "|"), name=" a, b\n,c ") == "a|b|c"
    cased = one(spark, text.cased_tokens(F.lit("ABcd e"), F.col("offsets"), F.array(*map(F.lit, ["[CLS]", "ab", "##cd", "e"]))), offsets=[{"start": a, "end": b} for a, b in ((0, 0), (0, 2), (2, 4), (5, 6))])
    assert cased == ["[CLS]", "AB", "##cd", "e"]


def test_vocabulary_pieces(spark):
    frame = spark.createDataFrame([("mollusc in x",), (None,)], "t string")
    got = [r["p"] for r in frame.select(tokens.vocabulary_pieces(F.col("t"), ["moll", "##usc", "in", "i"]).alias("p")).collect()]
    assert got == [["moll", "##usc", "in", "[UNK]"], []]
