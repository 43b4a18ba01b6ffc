"""Packing along a space-filling curve.

A document's hashed token vector (signed token hashes, averaged) is projected to DIMS numbers, and its place on a Hilbert curve
through that space is its key. Documents are range-dealt and sorted by key, and each partition cuts its stream of ids into
sequences of SEQUENCE tokens; what is left at its end fills sequences whose lengths are powers of two, which need no
padding. So neighbours on the curve share sequences and there is no padding at all.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels, session, tokenizing

SEQUENCE = 4096
DIMS = 3
BITS = 16
#: One document in SAMPLE is used, by hash, to place the range bounds; any bounds give a right packing.
SAMPLE = 32
_NULL_ID = -(1 << 63)


def hilbert(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Index on the Hilbert curve of integer points (n, dims) below 2**bits, after Skilling's transpose form."""
    x = points.astype(np.int64).T.copy()
    dims = len(x)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(dims):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(high, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap if i else 0
        q >>= 1
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    carry = np.zeros_like(x[0])
    q = 1 << (bits - 1)
    while q > 1:
        carry = np.where((x[-1] & q) != 0, carry ^ (q - 1), carry)
        q >>= 1
    x ^= carry
    out = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(dims):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def keys(ids: np.ndarray, bounds: np.ndarray, dims: int = DIMS, bits: int = BITS) -> np.ndarray:
    """Curve keys of documents, from their ids and offsets; a document without ids gets the origin's."""
    n = np.diff(bounds)
    points = np.zeros((len(n), dims), np.int64)
    for d in range(dims):
        table = kernels.mix(np.arange(1 << 16, dtype=np.uint64) * np.uint64(dims) + np.uint64(d + 1))
        value = ((table >> np.uint64(40)).astype(np.float64) / (1 << 23) - 1.0)[ids & 0xFFFF]
        sums = np.concatenate([[0.0], np.cumsum(value)])
        mean = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(n, 1)
        points[:, d] = np.clip((np.tanh(4 * mean) + 1) / 2 * (1 << bits), 0, (1 << bits) - 1).astype(np.int64)
    return hilbert(points, bits)


def _encoded(tokenizer: str, end_id: int, cuts: np.ndarray | None, slices: int, cache: int):
    def run(batches):
        for batch in batches:
            texts, doc_ids = batch.column("text"), batch.column("doc_id")
            for first, end, ids, bounds in tokenizing.encode(tokenizer, texts, end_id, slices, cache):
                # the id that ends every document says nothing of it
                key = keys(ids, np.stack([bounds[:-1], bounds[1:] - 1], 1).reshape(-1))[::2] if len(bounds) > 1 else np.zeros(0, np.int64)
                # copies share a key; a hash of doc_id below it spreads them over partitions
                tie = kernels.mix(doc_ids.slice(first, end - first).fill_null(0).to_numpy().view(np.uint64)) >> np.uint64(49)
                key = (key << 15) | tie.astype(np.int64)
                if cuts is None:
                    yield pa.RecordBatch.from_arrays([pa.array(key)], ["key"])
                    continue
                values = pa.LargeBinaryArray.from_buffers(pa.large_binary(), end - first, [None, pa.py_buffer(np.ascontiguousarray(bounds * 4)), pa.py_buffer(ids.astype("<u4"))])
                if len(ids) * 4 < 1 << 30:
                    values = values.cast(pa.binary())
                place = np.searchsorted(cuts, key, "right").astype(np.int32)
                yield pa.RecordBatch.from_arrays([doc_ids.slice(first, end - first), pa.array(key), pa.array(place), _packed(values)], ["doc_id", "key", "place", "ids"])

    return run


def _packed(values: pa.Array) -> pa.Array:
    """Ids of each document as byte planes of 16 bits, zstandard; 32 bits where an id needs them."""
    import zstandard

    pack, out = zstandard.ZstdCompressor(level=1), []
    for value in values:
        ids = np.frombuffer(value.as_buffer(), "<u4")
        wide = len(ids) and ids.max() >= 1 << 16
        octets = ids.astype("<u4" if wide else "<u2").view(np.uint8).reshape(len(ids), -1)
        out.append((b"\x04" if wide else b"\x02") + pack.compress(octets.T.tobytes()))
    return pa.array(out, pa.binary())


def unpacked(data: bytes) -> np.ndarray:
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(data[1:])
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(data[0], -1).T).reshape(-1).view(f"<u{data[0]}").astype("<u4")


def cut_stream(position: int, n: int, size: int = SEQUENCE):
    """(start, length, sequence, offset) of the pieces of n tokens that begin at a position of a stream cut at every `size`."""
    start = 0
    while start < n:
        length = min(n - start, size - (position + start) % size)
        yield start, length, (position + start) // size, (position + start) % size
        start += length


def tail(total: int, size: int = SEQUENCE) -> list[int]:
    """Lengths of the last sequences of a stream of `total` tokens: powers of two that make up what isn't a whole sequence."""
    rest = total % size
    return [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def pack(docs: DataFrame, tokenizer: str, end_id: int = 2, size: int = SEQUENCE, ids: bool = False, slices: int = tokenizing.SLICE, cache: int = tokenizing.CACHE) -> DataFrame:
    """A row for each piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length; with ids its ids.

    docs needs doc_id and text; other columns are ignored. Null text: an empty document, which still has end_id. Null doc_id and
    repeated rows are documents like any other; ties on the curve go by a hash of doc_id, then doc_id, then the ids. An empty table gives no rows.
    sequence_id is the partition's number times 2**40 plus the place in it. Memory: an Arrow batch, a slice of texts, the
    tokenizer's cache, and the pieces of the sequence in hand. The bounds of the partitions come from one document in SAMPLE, chosen by hash.
    """
    spark = docs.sparkSession
    shards = session.partitions(spark)
    docs = session.documents(docs).select("doc_id", "text")
    some = docs.where(F.abs(F.xxhash64("doc_id", "text") % SAMPLE) == 0)
    bounds = some.mapInArrow(session.released(_encoded(tokenizer, end_id, None, slices, cache)), "key long").agg(F.percentile_approx("key", [i / shards for i in range(1, shards)], 10_000).alias("b")).first()["b"] if shards > 1 else None
    cuts = np.unique(np.array(bounds or [], np.int64))
    rows = docs.mapInArrow(session.released(_encoded(tokenizer, end_id, cuts, slices, cache)), "doc_id long, key long, place int, ids binary")
    rows = rows.repartitionById(len(cuts) + 1, F.col("place")).sortWithinPartitions("key", "doc_id", "ids")

    def run(batches):
        context = TaskContext.get()
        base = (context.partitionId() if context else 0) << 40
        position, held = 0, []  # held: pieces of the sequence in hand, not yet whole

        def rows_of(pieces):
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "sequence_length", "ids"]
            kinds = [pa.int64()] * 8 + [pa.binary()]
            columns = list(zip(*pieces)) or [()] * 9
            last = 9 if ids else 8
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in list(zip(columns, kinds))[:last]], names[:last])

        def piece(doc, start, part, n, sequence, offset, length):
            data = part.tobytes()
            return (doc, start, len(part), zlib.crc32(data), n, base + sequence, offset, length, data)

        for batch in batches:
            out = []
            for doc, data in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                tokens = unpacked(data.as_py())
                for start, length, sequence, offset in cut_stream(position, len(tokens), size):
                    held.append((doc, start, tokens[start : start + length], len(tokens), sequence, offset))
                    if offset + length == size:
                        out += [piece(*h, size) for h in held]
                        held = []
                position += len(tokens)
                if len(out) >= 1024:
                    yield rows_of(out)
                    out = []
            if out:
                yield rows_of(out)
        if held:
            lengths, out = tail(position, size), []
            sequence, place = position // size, 0  # place: filled of the sequence in hand
            for doc, start, part, n, _, _ in held:
                while len(part):
                    take = min(len(part), lengths[0] - place)
                    out.append(piece(doc, start, part[:take], n, sequence, place, lengths[0]))
                    start, part, place = start + take, part[take:], place + take
                    if place == lengths[0]:
                        lengths.pop(0)
                        sequence, place = sequence + 1, 0
            yield rows_of(out)

    return rows.mapInArrow(session.released(run), "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_length long" + ", ids binary" * ids)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"))
