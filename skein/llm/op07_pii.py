"""Personal data, in DataFrame functions only: patterns propose spans, checksums confirm them, context words adjust the score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Patterns for Java's engine. They find what the plain patterns in the contract find, leftmost and non-overlapping. Runs are
# possessive and start at a run's first character (or where the last match ended), which keeps the search linear and off the stack.
_LOCAL = r"[A-Za-z0-9._%+-]"
EMAIL = rf"(?:(?<!{_LOCAL})|\G){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"
IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
CARD = r"[0-9](?:[\x20-]?[0-9])++"
PHONE = r"\+[0-9][\x20().0-9-]+[0-9]"
# Added kinds.
CARD_ALONE = r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4}[\x20-][0-9]{4})(?![0-9])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
SSN = r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"
KEY = r"(?<![A-Za-z0-9])A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{12,}+"
KINDS = ("email", "ip", "card", "phone", "iban", "ssn", "key", "secret")
#: Words that raise a span's score when they stand in the CONTEXT characters before it.
CONTEXT_WORDS = {"card": "card|credit|visa|payment|karte|tarjeta|carte", "iban": "iban|account|bank|konto|cuenta|compte", "ssn": "ssn|social|security|tax", "key": "key|aws|access", "secret": "password|passwd|pwd|secret|token|api.?key"}
CONTEXT = 40
#: What a pattern is worth alone, with its checksum, and how much context adds; a span of an added kind needs THRESHOLD.
SCORES = {"card": (0.2, 0.4, 0.2), "iban": (0.2, 0.5, 0.2), "ssn": (0.3, 0.1, 0.3), "key": (0.4, 0.3, 0.2), "secret": (0.2, 0.1, 0.3)}
THRESHOLD = 0.6
#: Matches of a text whose places are summed together; their sums are added up in a second pass.
RUN = 128


def found(text: Column, pattern: str, gate: Column) -> Column:
    """Matches of pattern as array<struct<start int, end int, hit string>>, in code points; none where gate is false.

    The texts between matches and the matches, in turn, give the places.
    """
    spans_type = "array<struct<start:int,end:int,hit:string>>"
    none = F.array().cast(spans_type)
    hits = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(state: Column, x: Column) -> Column:
        begin = state["at"] + F.length(x["gap"])
        end = begin + F.length(x["hit"])
        return F.struct(end.alias("at"), F.concat(state["spans"], F.array(F.struct(begin.alias("start"), end.alias("end"), x["hit"].alias("hit")))).alias("spans"))

    def moved(state: Column, run: Column) -> Column:
        own = F.transform(run["spans"], lambda s: F.struct((s["start"] + state["at"]).alias("start"), (s["end"] + state["at"]).alias("end"), s["hit"].alias("hit")))
        return F.struct((state["at"] + run["at"]).alias("at"), F.concat(state["runs"], F.array(own)).alias("runs"))

    def placed(pairs: Column) -> Column:
        """Places within each run of RUN matches, then those of the runs: no array grows by one match at a time beyond a run."""
        first = F.struct(F.lit(0).alias("at"), none.alias("spans"))
        runs = F.transform(F.sequence(F.lit(1), F.size(pairs), F.lit(RUN)), lambda i: F.aggregate(F.slice(pairs, i, F.lit(RUN)), first, step))
        return F.aggregate(runs, F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{spans_type}>").alias("runs")), moved, lambda s: F.flatten(s["runs"]))

    pairs = F.zip_with(F.slice(gaps, F.lit(1), F.size(hits)), hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
    # within transform the pairs are a value; named outside, each run would search the text again
    return F.when(gate & (F.size(hits) > 0), F.transform(F.array(pairs), placed)[0]).otherwise(none)


def _digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def valid_ip(hit: Column) -> Column:
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(hit, r"\."), lambda p: (F.length(part(p)) <= 3) & (F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255))


def valid_card(hit: Column) -> Column:
    return F.length(_digits(hit)).between(12, 19) & F.call_function("luhn_check", _digits(hit))


def valid_phone(hit: Column) -> Column:
    return F.length(_digits(hit)).between(9, 15)


def valid_iban(hit: Column) -> Column:
    """Modulo 97 of the rearranged characters, letters as 10 to 35, is 1."""
    plain = F.replace(hit, F.lit(" "), F.lit(""))
    turned = F.split(F.concat(F.substring(plain, 5, 64), F.substring(plain, 1, 4)), "")
    value = lambda c: F.when(c.between("0", "9"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    rest = F.aggregate(F.filter(turned, lambda c: c != ""), F.lit(0), lambda r, c: ((r * F.when(c.between("0", "9"), 10).otherwise(100) + value(c)) % 97).cast("int"))
    return F.length(plain).between(15, 34) & (rest == 1)


def valid_ssn(hit: Column) -> Column:
    area = F.substring(hit, 1, 3)
    return ~area.isin("000", "666") & (area < "900") & (F.substring(hit, 5, 2) != "00") & (F.substring(hit, 8, 4) != "0000")


def valid_key(hit: Column) -> Column:
    return F.regexp_count(hit, F.lit("[0-9]")) >= 1


def valid_secret(hit: Column) -> Column:
    """Letters and digits in turn, not a word with a number nor a few signs over and over."""
    return (F.regexp_count(hit, F.lit("[0-9]")) >= 3) & hit.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(hit, ""))) >= 7)


def scored(text: Column, kind: str, spans: Column, valid) -> Column:
    """Spans of an added kind whose score reaches THRESHOLD."""
    plain, checked, near = SCORES[kind]

    def score(s: Column) -> Column:
        before = F.lower(F.substring(text, F.greatest(F.lit(1), s["start"] + 1 - CONTEXT), F.least(F.lit(CONTEXT), s["start"])))
        return F.lit(plain) + F.when(valid(s["hit"]), F.lit(checked)).otherwise(F.lit(-1.0)) + F.when(before.rlike(CONTEXT_WORDS[kind]), F.lit(near)).otherwise(F.lit(0.0))

    return F.filter(spans, lambda s: score(s) >= THRESHOLD - 1e-9)


def _tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(KINDS.index(kind)).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def joined(spans: Column) -> Column:
    return F.concat_ws(",", F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))


def detect(docs: DataFrame) -> DataFrame:
    """docs with `base` and `spans`: array<struct<start, order, end, kind>>, and n_email, n_ip, n_card, n_phone of the base spans.

    base: email, ip, card and phone as the contract says; a match that fails its check is dropped, without another try inside
    it. spans: base, and those the method adds: cards standing alone inside a longer run of digits, iban with modulo 97, ssn
    near its context words, access keys by their form, and secrets: mixed runs of letters and digits after a word such as password.
    Places are code points, end exclusive. Null text: empty, no spans. Other columns stay, but one that has the name
    of an added column gives way to it. No shuffle; every row by itself.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    digits = text.rlike("[0-9]")
    docs = docs.withColumn("__email", found(text, EMAIL, F.contains(text, F.lit("@"))))
    docs = docs.withColumn("__ip", F.filter(found(text, IP, digits & F.contains(text, F.lit("."))), lambda s: valid_ip(s["hit"])))
    docs = docs.withColumn("__card", F.filter(found(text, CARD, digits), lambda s: valid_card(s["hit"])))
    docs = docs.withColumn("__phone", F.filter(found(text, PHONE, F.contains(text, F.lit("+"))), lambda s: valid_phone(s["hit"])))
    alone = F.filter(scored(text, "card", found(text, CARD_ALONE, text.rlike("[0-9]{4}")), valid_card), lambda s: ~F.exists(F.col("__card"), lambda b: (b["start"] == s["start"]) & (b["end"] == s["end"])))
    iban = scored(text, "iban", found(text, IBAN, text.rlike("[A-Z]{2}[0-9]{2}")), valid_iban)
    ssn = scored(text, "ssn", found(text, SSN, text.rlike("[0-9]-[0-9]{2}-[0-9]")), valid_ssn)
    key = scored(text, "key", found(text, KEY, text.rlike("A[KS]IA[A-Z0-9]")), valid_key)
    secret = scored(text, "secret", found(text, SECRET, text.rlike(f"(?i){CONTEXT_WORDS['secret']}")), valid_secret)
    docs = docs.withColumn("base", F.concat(*[_tagged(k, F.col(f"__{k}")) for k in KINDS[:4]]))
    docs = docs.withColumn("spans", F.concat("base", _tagged("card", alone), _tagged("iban", iban), _tagged("ssn", ssn), _tagged("key", key), _tagged("secret", secret)))
    for kind in KINDS[:4]:
        docs = docs.withColumn(f"n_{kind}", F.size(f"__{kind}").cast("long"))
    return docs.drop(*[f"__{k}" for k in KINDS[:4]])


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = detect(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return docs.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), F.size("spans").cast("long").alias("n_spans"))


def _sql_spans(kind: str, pattern: str, valid: str) -> str:
    """DuckDB list of (start, order, end, kind) of the valid matches; string functions there count code points too."""
    return f"""list_filter(list_transform(range(1, len(regexp_extract_all(t, '{pattern}')) + 1), lambda i:
      {{'s': CAST(list_sum(list_transform(regexp_split_to_array(t, '{pattern}')[1:i], lambda g: length(g)))
            + coalesce(list_sum(list_transform(regexp_extract_all(t, '{pattern}')[1:i - 1], lambda m: length(m))), 0) AS BIGINT),
        'm': regexp_extract_all(t, '{pattern}')[i]}}), lambda x: {valid.replace("@", "x.m")})"""


_D = "regexp_replace(@, '[^0-9]', '', 'g')"
_LUHN = f"""(list_sum(list_transform(range(1, length({_D}) + 1), lambda j:
      CASE WHEN (length({_D}) - j) % 2 = 0 THEN CAST(substr({_D}, j, 1) AS INTEGER)
           ELSE (2 * CAST(substr({_D}, j, 1) AS INTEGER)) // 10 + (2 * CAST(substr({_D}, j, 1) AS INTEGER)) % 10 END)) % 10 = 0)"""
_SQL = {
    "email": (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", "true"),
    "ip": (r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)", "len(list_filter(string_split(@, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255)) = 0"),
    "card": (r"[0-9](?:[\x20-]?[0-9])+", f"length({_D}) BETWEEN 12 AND 19 AND {_LUHN}"),
    "phone": (r"\+[0-9][\x20().0-9-]+[0-9]", f"length({_D}) BETWEEN 9 AND 15"),
}
#: The base columns; what the method adds in `spans` is tested apart.
BASE_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
f AS (SELECT doc_id, {', '.join(f"{_sql_spans(k, p, v)} AS {k}" for k, (p, v) in _SQL.items())} FROM d),
u AS (SELECT doc_id, len(email) AS n_email, len(ip) AS n_ip, len(card) AS n_card, len(phone) AS n_phone,
  list_sort(list_concat(list_concat({', '.join(f"list_transform({k}, lambda x: {{'s': x.s, 'k': {i}, 'e': x.s + length(x.m), 'n': '{k}'}})" for i, k in list(enumerate(_SQL))[:2])}),
            list_concat({', '.join(f"list_transform({k}, lambda x: {{'s': x.s, 'k': {i}, 'e': x.s + length(x.m), 'n': '{k}'}})" for i, k in list(enumerate(_SQL))[2:])}))) AS spans FROM f)
SELECT doc_id, CAST(n_email AS BIGINT) AS n_email, CAST(n_ip AS BIGINT) AS n_ip, CAST(n_card AS BIGINT) AS n_card, CAST(n_phone AS BIGINT) AS n_phone,
  sha256(coalesce(array_to_string(list_transform(spans, lambda x: x.n || ':' || x.s || ':' || x.e), ','), '')) AS base_sha256 FROM u
"""
