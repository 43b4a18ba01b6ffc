"""Quality rules: counts that reject a document outright, then a hashed n-gram logistic regression with calibrated probabilities.

The model is linear in the frequencies of hashed word 1- and 2-grams and character 3- and 5-grams (of code points). It is fitted on the driver
from at most SAMPLE labelled documents, chosen by hash of doc_id; that bound is a parameter, and the only one here. Every document is scored,
in Arrow batches, from its whole text. Weights are rounded to integers, so that a document's score doesn't depend on the batch.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels, session

U = np.uint64
#: Labelled documents that the model is fitted on, at most; a fifth of them only calibrate it.
SAMPLE = 1500
#: Buckets of each kind of n-gram.
BUCKET_BITS = 16
WORD_GRAMS, CHARACTER_GRAMS = (1, 2), (3, 5)
KINDS = len(WORD_GRAMS) + len(CHARACTER_GRAMS)
UNIT = 1 << 20
#: Each step of the fit takes one of PARTS parts of the training rows, in turn.
PARTS = 5
#: Rows of which the fit holds the scaled frequencies at once.
CHUNK = 32
#: Bytes of text that are judged at once.
SLICE = 1 << 18
#: Documents are kept from this calibrated probability of quality on.
KEEP = 0.5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
REPEAT_WORDS = 5
_symbol = np.zeros(256, bool)
_symbol[list(b"#*$%&|<>")] = True


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def counts(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Per row: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    n = len(at) - 1
    start, end, row = kernels.words(data, at)
    solid = ~kernels.SPACE[data]
    out = {"n_words": np.bincount(row, minlength=n), "word_chars": _sums(solid & ((data & 0xC0) != 0x80), at), "n_symbols": _sums(_symbol[data], at)}
    hashes = kernels.prefix(data)
    # lines: between line feeds and the rows' own ends
    feeds = np.flatnonzero(data == 0x0A)
    full = at[:-1] < at[1:]
    first = np.concatenate([at[:-1][full], feeds + 1])
    last = np.concatenate([feeds, at[1:][full]])
    first.sort()
    last.sort()
    # a feed that ends a row leaves an empty line there, which begins where the next row does
    words = np.concatenate([[0], np.cumsum(solid, dtype=np.int64)])
    some = words[np.maximum(last, first)] > words[first]
    first, last = first[some], last[some]
    owner = np.searchsorted(at, first, "right") - 1
    key = kernels.mix(kernels.span(hashes, first, last) ^ kernels.mix(owner.astype(U) + U(1)))
    distinct = np.unique(key, return_index=True)[1]
    out["n_dup_lines"] = np.bincount(owner, minlength=n) - np.bincount(owner[distinct], minlength=n)
    grams, where = kernels.grams(kernels.word_hashes(data, start, end), row, REPEAT_WORDS)
    covered = np.zeros(len(row), bool)
    if len(grams):
        _, number, times = np.unique(kernels.mix(grams ^ kernels.mix(row[where].astype(U) + U(1))), return_inverse=True, return_counts=True)
        again = where[times[number] > 1]
        for step in range(REPEAT_WORDS):
            covered[again + step] = True
    out["n_repeat_words"] = np.bincount(row[covered], minlength=n)
    return {k: v.astype(np.int64) for k, v in out.items()}


def features(data: np.ndarray, at: np.ndarray):
    """For each kind of n-gram: the bucket of each n-gram, and the rows' offsets into them."""
    start, end, row = kernels.words(data, at)
    tokens, rows = kernels.word_hashes(data, start, end), np.arange(len(at))
    shift = U(64 - BUCKET_BITS)
    for n in WORD_GRAMS:
        grams, first = kernels.grams(tokens, row, n)
        yield (grams >> shift).astype(np.int64), np.searchsorted(row[first], rows)
    # a character starts at each byte that does not continue one
    places = np.append(np.flatnonzero((data & 0xC0) != 0x80), len(data))
    owner = np.searchsorted(at, places[:-1], "right") - 1
    hashes = kernels.prefix(data)
    for n in CHARACTER_GRAMS:
        first = np.flatnonzero(owner[: max(0, len(owner) - n + 1)] == owner[n - 1 :])
        grams = kernels.span(hashes, places[first], places[first + n])
        yield (grams >> shift).astype(np.int64), np.searchsorted(owner[first], rows)


@dataclass
class Model:
    weights: np.ndarray  # int64, kinds x buckets, in units of 1 / UNIT
    bias: float
    scale: float  # of the logit, and its shift: Platt's calibration
    shift: float

    def probability(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        logit = np.full(len(at) - 1, self.bias)
        for kind, (bucket, bounds) in enumerate(features(data, at)):
            total = np.diff(np.concatenate([[0], np.cumsum(self.weights[kind][bucket])])[bounds])
            logit += total / UNIT / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * logit + self.shift, -50, 50)))


def _packed(values: np.ndarray, rising: bool = False) -> bytes:
    """Values of 4 bytes as byte planes, zstandard; rising ones by their differences. What comes to the driver passes its JVM several times."""
    import zstandard

    values = np.diff(values, prepend=values.dtype.type(0)) if rising else values
    return zstandard.ZstdCompressor(level=1).compress(values.view(np.uint8).reshape(-1, 4).T.tobytes())


def _unpacked(data: bytes, kind: str, rising: bool = False) -> np.ndarray:
    import zstandard

    values = np.ascontiguousarray(np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8).reshape(4, -1).T).reshape(-1).view(kind)
    return np.cumsum(values, dtype=kind) if rising else values


def _rows(batches):
    """(id, quality, cols, values): a labelled document's n-gram frequencies."""
    for batch in batches:
        for first, end, data, at in kernels.slices(batch.column("text"), 1 << 16):
            parts = [[] for _ in range(end - first)]
            for kind, (bucket, bounds) in enumerate(features(data, at)):
                for i, (a, b) in enumerate(zip(bounds[:-1], bounds[1:])):
                    col, n = np.unique(bucket[a:b], return_counts=True)
                    parts[i].append((col + (kind << BUCKET_BITS), n / max(1, b - a)))
            cols = [_packed(np.concatenate([c for c, _ in p]).astype("<i4"), True) for p in parts]
            values = [_packed(np.concatenate([v for _, v in p]).astype("<f4")) for p in parts]
            yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), batch.column("quality").slice(first, end - first), pa.array(cols, pa.binary()), pa.array(values, pa.binary())], ["id", "quality", "cols", "values"])


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, steps: int = 150, rate: float = 2.0, penalty: float = 1e-2) -> Model | None:
    """A model from docs (doc_id, text) and labels (doc_id, quality 0 or 1); null where the labels name fewer than two classes.

    Rows with a null in doc_id or quality, or another quality than 0 and 1, don't count. At most `sample` labelled rows and as many documents,
    those of least hash, come to the driver, as sparse frequencies.
    """
    chosen = labels.where("doc_id is not null and quality in (0, 1)").select("doc_id", F.col("quality").cast("int").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id", "quality").limit(sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(F.xxhash64("doc_id", "text", "quality").alias("id"), "quality", "text")
    got = rows.orderBy("id").limit(sample).mapInArrow(session.released(_rows), "id long, quality int, cols binary, values binary").collect()
    got.sort(key=lambda r: r["id"])
    y = np.array([r["quality"] for r in got], float)
    if len(set(y)) < 2:
        return None
    cols = [_unpacked(r["cols"], "<i4", True) for r in got]
    values = [_unpacked(r["values"], "<f4") for r in got]
    held = np.arange(len(y)) % 5 == 4 if min(y.sum(), len(y) - y.sum()) >= 20 else np.zeros(len(y), bool)
    size = KINDS << BUCKET_BITS
    train = np.flatnonzero(~held)
    del got
    # frequencies are small: columns are scaled to about unit size, and adaptive steps do the rest
    spread = np.zeros(size)
    for i in train:
        spread[cols[i]] += values[i].astype(float) ** 2
    spread = np.sqrt(spread / len(train)) + 1e-4
    # the two classes weigh the same: a rare one is not given up for the common one
    balance = np.where(y == 1, 0.5 / max(y[train].mean(), 1e-9), 0.5 / max(1 - y[train].mean(), 1e-9))
    w, b = np.zeros(size), 0.0
    first, second = np.zeros(size + 1), np.zeros(size + 1)
    for step in range(1, steps + 1):
        part = train[step % PARTS :: PARTS] if len(train) > 20 * PARTS else train
        grad = np.append(penalty * w / np.sqrt(size), 0.0)
        for some in np.array_split(part, -(-len(part) // CHUNK)):
            col, owner = np.concatenate([cols[i] for i in some]), np.repeat(np.arange(len(some)), [len(cols[i]) for i in some])
            value = np.concatenate([values[i] for i in some]) / spread[col] / np.sqrt(size)
            p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, value * w[col], len(some)) + b, -50, 50)))
            g = (p - y[some]) * balance[some] / len(part)
            grad += np.append(np.bincount(col, value * g[owner], size), g.sum())
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        move = rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-12) * 0.05
        w, b = w - move[:-1], b - move[-1]
    weights = np.round(w / spread / np.sqrt(size) * UNIT).astype(np.int64)
    logits = lambda rows: np.array([(weights[cols[i]] / UNIT * values[i]).sum() + b for i in rows])
    rows = np.flatnonzero(held) if held.any() else train
    scale, shift = platt(logits(rows), y[rows])
    del cols, values
    session.release()
    return Model(weights.reshape(KINDS, -1), b, scale, shift)


def platt(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Scale and shift that turn logits into probabilities, by Newton's method with Platt's smoothed targets."""
    target = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (len(y) - y.sum() + 2))
    x = np.stack([logit / max(np.abs(logit).max(), 1e-9), np.ones_like(logit)], 1)
    beta = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * beta)
        beta += np.clip(step, -5, 5)
    return float(beta[0] / max(np.abs(logit).max(), 1e-9)), float(beta[1])


ADDED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "probability", "kept")


def judge(docs: DataFrame, model: Model | None, keep: float = KEEP, prefix: str = "") -> DataFrame:
    """docs with the columns ADDED, their names preceded by `prefix`.

    docs needs text; other columns stay, but one that has the name of an added column gives way to it. Null text: no words, so the base rules fail. Without a model (no usable labels) the
    base rules decide alone and probability is null. Every row by itself; no shuffle.
    """
    if model is not None:
        model = docs.sparkSession.sparkContext.broadcast(model)
    added = [prefix + name for name in ADDED]
    docs = session.documents(docs).drop(*added)
    names = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    types += "".join(f", `{name}` {kind}" for name, kind in zip(added, ["long"] * 5 + ["boolean", "double", "boolean"]))

    def run(batches):
        for batch in batches:
            for first, end, data, at in kernels.slices(batch.column("text"), SLICE):
                got = counts(data, at)
                failed = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
                p = model.value.probability(data, at) if model is not None else np.full(end - first, np.nan)
                kept = ~failed & (np.isnan(p) | (p >= keep))
                part = batch.slice(first, end - first)
                columns = [part.column(n) for n in names] + [pa.array(got[k]) for k in ADDED[:5]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(failed), pa.array(p, from_pandas=True), pa.array(kept)], [*names, *added])

    return docs.mapInArrow(session.released(run), types)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    judged = judge(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "probability")
