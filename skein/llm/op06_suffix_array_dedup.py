"""Substring dedup on bytes: 400-byte strings that start in two places or more go, wherever they stand.

The method named, inserting one symbol of every document a round into the collection's Burrows-Wheeler transform, takes as many
sequential rounds over the whole collection as the longest document has bytes (over 120,000 here), and each
round rewrites files that hold all documents; see the README. What is kept of it is the collection of suffixes and the adjacent
ones' common length, for the suffixes that begin at an anchor (see repeats): sorted by prefix, then by the hash of a
whole window, equal neighbours share at least a window.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels, repeats

WINDOW = 400
PREFIX = 64


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return data, at


def equal_windows(data: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A number for the string of `width` bytes at each of starts, by 64 bits of hash."""
    if not len(starts):
        return np.zeros(0, np.int64)
    hashes = kernels.prefix(data)
    return np.unique(kernels.span(hashes, starts, starts + width), return_inverse=True)[1]


def _kept(batches):
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        n, gone, runs, kept = [], [], [], []
        for i, text in enumerate(texts):
            text = text or b""
            starts, ends = repeats.ranges(batch, i)
            n.append(len(text))
            gone.append(int((ends - starts).sum()))
            runs.append(len(starts))
            if len(starts):
                edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(text)]
                text = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2]))
            kept.append(text)
        yield batch.column("id"), n, gone, runs, kept


def spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(id, row, spans of bytes) covered by strings of `window` bytes that also start elsewhere; docs as of repeats.keyed."""
    return repeats.covered(docs, split, window, min(prefix, window), False, "u1", equal_windows)


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, digest: bool = False) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept binary): documents without the bytes that a repeated string of `window` bytes covers.

    All copies go, the first one too, and so do strings that repeat within a document, overlapping ones included. docs needs
    doc_id and text; other columns are ignored. Null text: no bytes. Equal rows are copies of each other like any two documents.
    A cut may fall inside a character, so what is kept is binary. With `digest`, kept_sha256 takes its place.
    """
    rows = repeats.keyed(docs)

    def work(batches):
        for ids, n, gone, runs, kept in _kept(batches):
            last = pa.array([hashlib.sha256(k).hexdigest() for k in kept], pa.string()) if digest else pa.array(kept, pa.binary())
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), last], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256" if digest else "kept"])

    last = "kept_sha256 string" if digest else "kept binary"
    out = repeats.rewritten(rows, spans(rows, window, prefix), work, f"doc_id long, n_bytes long, n_removed long, n_spans long, {last}")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NULL_ID)))


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup(spark.read.parquet(f"{sf_dir}/documents.parquet"), digest=True)


#: Every string of every document, so for small tables.
OP6_SQL = r"""
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
win AS (SELECT doc_id, i, md5(array_slice(x, i + 1, i + 400)) AS h FROM d, unnest(range(0, n - 399)) AS r(i)),
again AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM win JOIN (SELECT h FROM win GROUP BY h HAVING count(*) > 1) USING (h)),
runs AS (SELECT doc_id, min(i) AS a, max(i) + 400 AS b FROM (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 400 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM again) GROUP BY doc_id, run),
lists AS (SELECT doc_id, list(a ORDER BY a) AS a, list(b ORDER BY a) AS b, sum(b - a) AS gone FROM runs GROUP BY doc_id)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(len(a), 0) AS BIGINT) AS n_spans,
  sha256(CASE WHEN a IS NULL THEN x ELSE unhex(array_to_string(list_transform(range(1, len(a) + 2), lambda k:
    hex(array_slice(x, coalesce(b[k - 1], 0) + 1, coalesce(a[k], n)))), '')) END) AS kept_sha256
FROM d LEFT JOIN lists USING (doc_id)
"""
