"""Substring dedup on words: prefix-partitioned suffix trees, repeats read off each subtree's deep nodes.

Suffixes are dealt into groups by prefixes of variable length (see repeats): 16 words at an anchor, or, where a prefix has more
windows than a task may hold, the whole window. Prefixes found in one document only are dropped by a count over all documents. A
group's subtree is its sorted suffixes: ranks of runs of 1, 2, 4, ... words sort them word by word, and neighbours with as many words
in common as a window has hang below one internal node of at least that depth. All suffixes below such a node but those of its smallest
doc_id are repeats.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels, repeats

U = np.uint64
WINDOW = 50
PREFIX = 16


def split(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of a slice's words, and its rows' offsets into them."""
    start, end, row = kernels.words(data, at)
    return kernels.word_hashes(data, start, end), np.searchsorted(row, np.arange(len(at)))


def deep_nodes(tokens: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """For the suffix at each of starts, the number, in order of the words, of the node that the path of its first `width` words ends in or above."""
    if not len(starts):
        return np.zeros(0, np.int64)
    ranked = lambda x: np.unique(x, return_inverse=True)[1].astype(U)
    paired = lambda a, b: ranked(a * (b.max() + U(1)) + b)  # noqa: E731  ranks are below the number of tokens, so pairs fit in 64 bits
    rank, length = ranked(tokens), 1
    while 2 * length <= width:
        rank, length = paired(rank[:-length], rank[length:]), 2 * length
    return paired(rank[starts], rank[starts + width - length]).astype(np.int64)


def _kept(batches):
    """(id, row, n_words, n_removed, kept) for rows with spans of words."""
    for batch in batches:
        texts = batch.column("text").cast(pa.large_binary()).to_pylist()
        n, gone, kept = [], [], []
        for i, text in enumerate(texts):
            words = (text or b"").split()  # at ASCII white space
            starts, ends = repeats.ranges(batch, i)
            n.append(len(words))
            gone.append(int((ends - starts).sum()))
            if len(starts):
                edges = [0, *np.stack([starts, ends], 1).reshape(-1).tolist(), len(words)]
                words = [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]
            kept.append(b" ".join(words))
        yield batch.column("id"), batch.column("row"), n, gone, kept


def spans(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(id, row, spans of words) that a window shared with a smaller doc_id covers; docs as of repeats.keyed."""
    return repeats.covered(docs, split, window, min(prefix, window), True, "u8", deep_nodes)


def dedup(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """(doc_id, n_words, n_removed, text): documents without the words that stand in a window whose words also start in a smaller doc_id.

    docs needs doc_id and text; other columns are ignored. Words are runs of bytes other than ASCII white space; kept ones are
    joined by one space. Null text: no words. A null doc_id counts as smaller than any other. Rows that share a doc_id
    don't take from each other. Texts under a window keep all words.
    """
    rows = repeats.keyed(docs)

    def work(batches):
        for ids, _, n, gone, kept in _kept(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())], ["doc_id", "n_words", "n_removed", "text"])

    out = repeats.rewritten(rows, spans(rows, window, prefix), work, "doc_id long, n_words long, n_removed long, text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NULL_ID)))


def digests(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX) -> DataFrame:
    """As dedup, with the sha256 of the kept text in its place."""
    rows = repeats.keyed(docs)

    def work(batches):
        for ids, _, n, gone, kept in _kept(batches):
            digest = [hashlib.sha256(k).hexdigest() for k in kept]
            yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(gone, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_words", "n_removed", "kept_sha256"])

    out = repeats.rewritten(rows, spans(rows, window, prefix), work, "doc_id long, n_words long, n_removed long, kept_sha256 string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(repeats.NULL_ID)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: Every window of every document, so for small tables.
OP4_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS h FROM d, unnest(range(1, len(w) - 48)) AS r(i)),
again AS (SELECT doc_id, i FROM win JOIN (SELECT h, min(doc_id) AS least FROM win GROUP BY h) USING (h) WHERE doc_id > least),
gone AS (SELECT DISTINCT doc_id, i + k AS i FROM again, unnest(range(0, 50)) AS r(k)),
words AS (SELECT doc_id, i, w[i] AS word FROM d, unnest(range(1, len(w) + 1)) AS r(i)),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY i) AS text FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(g.n, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM d LEFT JOIN (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id) g USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
