"""Tokens, segments, dictionary tags and markup."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein import schema
from skein.functions import flat, text
from skein.operators import catalogue, dictionary, markup, tokens
from skein.plans.registry import query, ratio_sql, table

_TOKENS = r"regexp_extract_all(coalesce(text, ''), '[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]')"
_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
_N = f"CAST(len({_TOKENS}) AS INTEGER)"


def typed(spans, prediction: str = "O"):
    """Spans as tokens that have one prediction."""

    @F.arrow_udf(f"array<{schema.TOKEN}>")
    def tokens(column: pa.Array) -> pa.Array:
        bounds, values, null = flat.lists(column)
        n = len(values)
        labels = pa.repeat(pa.scalar(prediction, pa.string()), n)
        token = pa.StructArray.from_arrays([values.field("string"), values.field("offset"), labels, pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], ["string", "offset", "prediction", "gold_label", "prob"])
        return flat.list_array(bounds, token, null)

    return tokens(spans)


@query(f"SELECT doc_id, {_N} AS n_tokens, CAST(coalesce(list_sum(list_transform({_TOKENS}, lambda x: length(x))), 0) AS BIGINT) AS n_chars FROM documents")
def token_spans_count(spark, d):
    docs = catalogue.spread(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", tokens.token_spans(F.col("text")).alias("t"))
    chars = F.aggregate(F.transform("t", lambda t: (t["offset"]["end"] - t["offset"]["start"]).cast("long")), F.lit(0).cast("long"), lambda a, x: a + x)
    return docs.select("doc_id", F.size("t").alias("n_tokens"), chars.alias("n_chars"))


@query(f"SELECT doc_id, {_N} AS n_tokens FROM documents")
def token_count_native(spark, d):
    return table(spark, d, "documents").select("doc_id", F.size(tokens.token_strings(F.col("text"))).alias("n_tokens"))


@query(r"SELECT conv_id, turn, ltrim(rtrim(regexp_replace(text, '\s', ' ', 'g'))) AS body FROM conversations")
def detokenise_roundtrip(spark, d):
    """Detokenised tokens give the text again, its white space as spaces."""
    rows = table(spark, d, "conversations").select("conv_id", "turn", tokens.token_spans(F.col("text")).alias("t"))
    return rows.select("conv_id", "turn", text.detokenised(F.col("t")).alias("body"))


def _pieces(spark, d) -> DataFrame:
    """Words of conversations cut at four characters, later pieces marked ##, with a last [SEP]."""
    rows = catalogue.spread(table(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), tokens.token_spans(F.col("text")).alias("t"))
    words = rows.select("doc_id", F.posexplode("t").alias("w", "t"))
    cut = F.sequence(F.lit(0), ((F.length("t.string") - 1) / 4).cast("int"))
    pieces = words.select("doc_id", "w", "t", F.explode(cut).alias("k"))
    begin = F.col("t.offset.start") + 4 * F.col("k")
    string = F.expr("substr(t.string, 4 * k + 1, 4)")
    pieces = pieces.select("doc_id", (F.col("w") * 1000 + F.col("k")).cast("long").alias("pos"), F.when(F.col("k") > 0, F.concat(F.lit("##"), string)).otherwise(string).alias("piece"), begin.alias("start"), (begin + F.length(string)).alias("end"), F.when(F.col("k") > 0, "I-X").otherwise("B-X").alias("prediction"))
    ends = rows.select("doc_id", F.lit(10**12).alias("pos"), F.lit("[SEP]").alias("piece"), F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("#").alias("prediction"))
    return pieces.unionByName(ends)


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, {_TOKENS} AS w FROM conversations)
SELECT doc_id, CAST(i AS BIGINT) AS word, w[i] AS string, 'B-X' AS prediction FROM t, unnest(range(1, len(w) + 1)) AS r(i)
""")
def subword_merge(spark, d):
    return tokens.merged_pieces(_pieces(spark, d)).select("doc_id", "word", "string", "prediction")


def _cut(column: pa.Array) -> pa.Array:
    """Spans cut at four characters as in _pieces, with a last [SEP] in each row."""
    bounds, values, null = flat.lists(column)
    words, offset = values.field("string").to_pylist(), values.field("offset")
    start, end = (offset.field(k).to_numpy(zero_copy_only=False) for k in ("start", "end"))
    strings, tags, of = [], [], []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        for w in range(a, b):
            cut = range(0, len(words[w]), 4)
            strings += [("##" if k else "") + words[w][k : k + 4] for k in cut]
            tags += ["I-X" if k else "B-X" for k in cut]
            of += [(w, k) for k in cut]
        strings.append("[SEP]")
        tags.append("#")
        of.append((-1, 0))
    w, k = np.array(of, np.int64).reshape(-1, 2).T
    start, end = np.append(start, 0), np.append(end, 0)  # those of [SEP] last
    offset = pa.StructArray.from_arrays([pa.array(start[w] + k, pa.int32()), pa.array(np.minimum(start[w] + k + 4, end[w]), pa.int32())], ["start", "end"])
    n = len(strings)
    token = pa.StructArray.from_arrays([pa.array(strings, pa.string()), offset, pa.array(tags, pa.string()), pa.nulls(n, pa.string()), pa.nulls(n, pa.float64())], ["string", "offset", "prediction", "gold_label", "prob"])
    return flat.list_array(np.concatenate([[0], np.flatnonzero(w < 0) + 1]), token, null)


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, {_TOKENS} AS w FROM conversations) SELECT doc_id, coalesce(array_to_string(w, ' '), '') AS words FROM t
""")
def subword_merge_structs(spark, d):
    """The pieces of a document in one array, as _pieces cuts them, merged into its words."""
    rows = catalogue.spread(table(spark, d, "conversations")).select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), tokens.token_spans(F.col("text")).alias("t"))

    docs = rows.select("doc_id", F.arrow_udf(_cut, f"array<{schema.TOKEN}>")("t").alias("t"))
    return docs.select("doc_id", F.array_join(F.transform(text.merged_off_tokens(F.col("t")), lambda x: x["string"]), " ").alias("words"))


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS doc_id, {_TOKENS} AS w FROM conversations)
SELECT doc_id, '#' || coalesce(array_to_string(list_transform(w, lambda x: repeat(CASE WHEN length(x) % 2 = 0 THEN 'E' ELSE 'O' END, ((length(x) + 3) // 4)::INTEGER)), ''), '') || '#' AS labels FROM t
""")
def label_align(spark, d):
    """Each piece of four characters with its word's label, between two specials."""
    rows = table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("doc_id"), tokens.token_strings(F.col("text")).alias("w"))
    labels = F.transform("w", lambda x: F.when(F.length(x) % 2 == 0, "E").otherwise("O"))
    ids = F.flatten(F.transform("w", lambda x, i: F.array_repeat(i, F.floor((F.length(x) + 3) / 4).cast("int"))))
    none = F.array(F.lit(None).cast("int"))
    return rows.select("doc_id", F.array_join(text.aligned_labels(F.concat(none, ids, none), labels), "").alias("labels"))


@query(f"""
WITH n AS (SELECT doc_id, {_N} AS n FROM documents), s AS (SELECT doc_id, n, CAST(ceil(greatest(0, n - 510) / 490) AS INTEGER) AS last FROM n)
SELECT doc_id, CAST(i AS INTEGER) AS segment, CAST(i * 490 AS INTEGER) AS start, CAST(least(n, i * 490 + 510) AS INTEGER) AS stop FROM s, unnest(range(0, last + 1)) AS r(i)
""")
def segment_windows(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.size(tokens.token_strings(F.col("text"))).alias("n"))
    cut = rows.select("doc_id", "n", F.posexplode(tokens.segment_starts(F.col("n"))).alias("segment", "start"))
    return cut.select("doc_id", "segment", "start", F.least(F.col("n"), F.col("start") + 510).alias("stop"))


def _merged(spark, d, how):
    rows = table(spark, d, "documents").select("doc_id", tokens.token_strings(F.col("text")).alias("t"))
    back = rows.select("doc_id", how(tokens.segments(F.col("t"))).alias("t"))
    return back.select("doc_id", F.size("t").alias("n_tokens"), F.md5(F.array_join("t", " ")).alias("hash"))


_WHOLE = f"SELECT doc_id, {_N} AS n_tokens, md5(coalesce(array_to_string({_TOKENS}, ' '), '')) AS hash FROM documents"


@query(_WHOLE)
def segment_merge_half_stride(spark, d):
    return _merged(spark, d, tokens.merged_by_half_stride)


@query(_WHOLE)
def segment_merge_suffix(spark, d):
    return _merged(spark, d, lambda w: tokens.merged_by_suffix(w, 20))


def _terms(spark, d):
    """2-grams of words of benchmark items, 8 characters or more."""
    words = table(spark, d, "benchmark").select(tokens.token_strings(F.col("text")).alias("w"))
    pairs = words.select(F.explode(F.transform(F.slice("w", F.lit(1), F.greatest(F.lit(0), F.size("w") - 1)), lambda x, i: F.concat_ws(" ", x, F.get(F.col("w"), i + 1)))).alias("term"))
    return pairs.where(F.length("term") >= 8).distinct().withColumn("label", F.when(F.length("term") % 2 == 0, "even").otherwise("odd"))


def _tagged(spark, d):
    docs = catalogue.spread(table(spark, d, "documents").select("doc_id", "lang", "text"))
    docs = docs.select("doc_id", "lang", typed(tokens.token_spans(F.col("text"))).alias("tokens"))
    return dictionary.tagged(docs, "tokens", _terms(spark, d))


@query(rf"""WITH RECURSIVE b AS (SELECT regexp_extract_all(coalesce(text, ''), '{_PATTERN}') AS w FROM benchmark),
terms AS (SELECT DISTINCT w[i] || ' ' || w[i + 1] AS term FROM b, unnest(range(1, len(w))) AS r(i) WHERE length(w[i] || ' ' || w[i + 1]) >= 8),
d AS (SELECT doc_id, lang, regexp_extract_all(coalesce(text, ''), '{_PATTERN}') AS w, list_transform(regexp_split_to_array(coalesce(text, ''), '{_PATTERN}'), lambda g: repeat(' ', length(g))) AS g FROM documents),
p1 AS (SELECT doc_id, i, w[i] AS t1, {', '.join(f'g[i + {k}] || w[i + {k}] AS t{k + 1}' for k in range(1, 10))} FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
longest AS (SELECT max(length(term)) + 2 AS most FROM terms),
p AS (SELECT doc_id, i, n, text FROM (SELECT doc_id, i, unnest([{', '.join(' || '.join(f't{j}' for j in range(1, k + 1)) for k in range(1, 11))}]) AS text, unnest(range(1, 11)) AS n FROM p1) WHERE length(text) <= (SELECT most FROM longest)),
u AS (SELECT DISTINCT text, length(text) AS n, CAST(floor(0.07 * (2 * length(text) + 2) + 1e-9) AS INTEGER) + 1 AS parts FROM p),
cut AS (SELECT text, n, substr(text, CAST(k * n // parts AS INTEGER) + 1, CAST((k + 1) * n // parts - k * n // parts AS INTEGER)) AS piece FROM u, unnest(range(0, parts)) AS r(k)),
parts AS (SELECT DISTINCT term, substr(term, a, z) AS piece FROM terms, unnest(range(1, length(term) + 1)) AS r(a), unnest(range(3, length(term) - a + 2)) AS s(z)),
near AS (SELECT DISTINCT text, term FROM cut JOIN parts USING (piece) WHERE abs(n - length(term)) <= 2 AND levenshtein(text, term) <= 4 * floor(0.07 * (n + length(term)) + 1e-9)),
best AS (SELECT text, CASE WHEN length(term) % 2 = 0 THEN 'even' ELSE 'odd' END AS label, max(score) AS score FROM
  (SELECT text, term, {ratio_sql('text', 'term')} AS score FROM near) WHERE score >= 93 GROUP BY ALL),
hits AS (SELECT doc_id, i, min({{'s': -score, 'label': label, 'n': n}}) AS h FROM p JOIN best USING (text) GROUP BY ALL),
steps AS (SELECT a.doc_id, a.i, a.h.label AS label, b.i AS after FROM hits a ASOF LEFT JOIN hits b ON a.doc_id = b.doc_id AND a.i + a.h.n <= b.i),
kept AS (SELECT doc_id, min(i) AS i FROM hits GROUP BY doc_id UNION ALL SELECT s.doc_id, s.after FROM kept k JOIN steps s ON k.doc_id = s.doc_id AND k.i = s.i WHERE s.after IS NOT NULL)
SELECT lang, label, count(*) AS n, count(DISTINCT doc_id) AS n_docs FROM kept JOIN steps USING (doc_id, i) JOIN documents USING (doc_id) GROUP BY ALL
""")
def dictionary_tags(spark, d):
    """Dictionary hits by language and label."""
    hits = _tagged(spark, d).select("doc_id", "lang", F.explode(F.filter("tokens", lambda t: t["prediction"] != "O")).alias("t"))
    return hits.groupBy("lang", F.col("t.prediction").alias("label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("n_docs"))


@query()
def span_markup(spark, d):
    """Documents with their dictionary hits as markup, equal mentions under one id."""
    return _tagged(spark, d).select("doc_id", markup.markup(F.col("tokens")).alias("markup"))


@query()
def strip_pages(spark, d):
    return table(spark, d, "pages").select("page_id", markup.stripped("html").alias("text"))


@query("SELECT page_id, true AS same FROM pages")
def reinsert_tags(spark, d):
    """Pages' own tags put back into their annotated text: stripping that gives the page's text."""
    pages = table(spark, d, "pages").select("page_id", "html", markup.stripped("html").alias("plain"))
    spans = pages.withColumn("tokens", typed(tokens.token_spans(F.col("plain"))))
    again = spans.select("page_id", "plain", markup.put_back(F.concat(F.lit("<div>"), F.replace(F.replace(F.replace("plain", F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit("</div>")), "html").alias("html"))
    return again.select("page_id", (markup.stripped("html") == F.col("plain")).alias("same"))


@query("SELECT c_custkey, regexp_replace(c_name || ' coli', '(\\w)\\w+\\.? (\\w+)', '\\1. \\2', 'g') AS short FROM customer")
def abbreviate_names(spark, d):
    return table(spark, d, "customer").select("c_custkey", text.abbreviated(F.concat("c_name", F.lit(" coli"))).alias("short"))


@query("""
SELECT conv_id, turn, CASE WHEN role = 'user' AND text <> '' THEN role || ': ' || text WHEN role = 'user' THEN role ELSE coalesce(text, '') END AS line FROM conversations
""")
def separator_concat(spark, d):
    rows = table(spark, d, "conversations")
    role = F.when(F.col("role") == "user", F.col("role"))
    return rows.select("conv_id", "turn", text.joined_nonempty(role, F.col("text"), ": ").alias("line"))
