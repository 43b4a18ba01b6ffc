"""Token ids in a bit-plane shuffled binary format.

Format: a Parquet dataset (so that any store Spark can write will do, and a lost executor's files are written
again by Spark's commit protocol) with one row for each block of BLOCK ids of a shard; shards hold consecutive
ranges of doc_id. A block's ids are little-endian unsigned 32-bit integers, transposed into planes, either 4 byte
planes or 32 bit planes, and each plane is a zstandard frame. The row is also the block's entry in the chunk index:

    shard int, block int      place in the order of all ids
    first long                ids of the shard before this block
    n_ids int                 ids in the block
    planes array<binary>      zstandard frames
    doc_id array<long>        documents with ids in the block, in order
    doc_start array<long>     each one's first id, counted from the start of the shard
    at array<int>             where its ids begin in this block

The index columns can be read without the planes.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm import session, tokenizing

BLOCK = 1 << 16
SCHEMA = "shard int, block int, first long, n_ids int, planes array<binary>, doc_id array<long>, doc_start array<long>, at array<int>"


def to_planes(ids: np.ndarray, bits: bool = False, level: int = 3) -> list[bytes]:
    """Byte planes of 32-bit ids, lowest first, or bit planes; each compressed."""
    octets = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    rows = np.packbits(np.unpackbits(octets, axis=1, bitorder="little").T, axis=1) if bits else np.ascontiguousarray(octets.T)
    return [zstandard.ZstdCompressor(level=level).compress(row.tobytes()) for row in rows]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    rows = np.stack([np.frombuffer(zstandard.ZstdDecompressor().decompress(p, max_output_size=max(1, n)), np.uint8) for p in planes])
    octets = np.packbits(np.unpackbits(rows, axis=1, count=n).T, axis=1, bitorder="little") if len(planes) == 32 else np.ascontiguousarray(rows.T)
    return octets.reshape(-1).view("<u4").astype(np.uint32)


def crc_join(a: int, b: int, n: int) -> int:
    """crc32 of x + y from crc32(x), crc32(y) and y's length in bytes."""

    def times(matrix, vector):
        out, i = 0, 0
        while vector:
            if vector & 1:
                out ^= matrix[i]
            vector >>= 1
            i += 1
        return out

    power = [0xEDB88320] + [1 << i for i in range(31)]  # one zero bit
    for _ in range(3):
        power = [times(power, row) for row in power]
    while n:
        if n & 1:
            a = times(power, a)
        n >>= 1
        power = [times(power, row) for row in power]
    return a ^ b


def by_doc_id(docs: DataFrame, shards: int) -> DataFrame:
    """docs dealt to shards of consecutive doc_id, each sorted; the bounds come from all ids, read without the texts. Null ids come first."""
    bounds = docs.select(F.percentile_approx("doc_id", [i / shards for i in range(1, shards)], 10_000).alias("b")).first()["b"] if shards > 1 else None
    bounds = sorted(set(bounds or []))
    place = F.lit(0)
    if bounds:
        cuts = F.array(*[F.lit(b) for b in bounds])
        place = F.coalesce(F.size(F.filter(cuts, lambda b: b < F.col("doc_id"))), F.lit(0))
    return docs.withColumn("__shard", place.cast("int")).repartitionById(len(bounds) + 1, F.col("__shard")).sortWithinPartitions("doc_id", "text")


def write(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, bits: bool = False, block: int = BLOCK) -> None:
    """Encode docs (doc_id, text; other columns are ignored) and write their ids, end_id after each document, in ascending doc_id order.

    Null texts are empty documents, which still have end_id. Null doc_ids come first; rows with one doc_id stand in order of text.
    Memory: a slice of texts and one block.
    """
    spark = docs.sparkSession
    rows = by_doc_id(session.documents(docs).select("doc_id", "text"), max(session.partitions(spark), 1))

    def blocks(batches):
        context = TaskContext.get()
        shard = context.partitionId() if context else 0
        pending, starts, names, number, first, total = [], [], [], 0, 0, 0

        def rows_of(size):
            nonlocal pending, starts, names, number, first
            ids = np.concatenate(pending)
            for begin in range(0, len(ids) - size + 1 if size == block else len(ids), size):
                part = ids[begin : begin + size]
                here = [i for i, s in enumerate(starts) if s < first + len(part)]
                yield {"shard": shard, "block": number, "first": first, "n_ids": len(part), "planes": to_planes(part, bits), "doc_id": [names[i] for i in here], "doc_start": [starts[i] for i in here], "at": [max(0, starts[i] - first) for i in here]}
                first, number = first + len(part), number + 1
                # a document that goes on into the next block is named there again
                left = len(here) if first == ends_at(len(here)) else len(here) - 1
                starts, names = starts[left:], names[left:]
            pending = [ids[(len(ids) // size) * size :]] if size == block else []

        def ends_at(i):
            return starts[i] if i < len(starts) else total

        kind = pa.schema([("shard", pa.int32()), ("block", pa.int32()), ("first", pa.int64()), ("n_ids", pa.int32()), ("planes", pa.list_(pa.binary())), ("doc_id", pa.list_(pa.int64())), ("doc_start", pa.list_(pa.int64())), ("at", pa.list_(pa.int32()))])
        for batch in batches:
            doc_ids = batch.column("doc_id").to_pylist()
            for row, end, ids, bounds in tokenizing.encode(tokenizer, batch.column("text"), end_id):
                names += doc_ids[row:end]
                starts += (total + bounds[:-1]).tolist()
                pending.append(ids)
                total += len(ids)
                if total - first >= block:
                    yield pa.RecordBatch.from_pylist(list(rows_of(block)), kind)
        if total > first:
            yield pa.RecordBatch.from_pylist(list(rows_of(total - first)), kind)

    rows.mapInArrow(blocks, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """From the files: (shard, doc_id, doc_start, piece long, n int, crc long), a row for each document and block."""

    def read(batches):
        for batch in batches:
            for row in batch.to_pylist():
                data = from_planes(row["planes"], row["n_ids"]).astype("<u4").tobytes()
                ends = [*row["at"][1:], row["n_ids"]]
                parts = [data[4 * a : 4 * b] for a, b in zip(row["at"], ends)]
                n = len(parts)
                yield pa.RecordBatch.from_pydict({"shard": pa.array([row["shard"]] * n, pa.int32()), "doc_id": pa.array(row["doc_id"], pa.int64()), "doc_start": pa.array(row["doc_start"], pa.int64()), "piece": pa.array([row["block"]] * n, pa.int64()), "n": pa.array([len(p) // 4 for p in parts], pa.int64()), "crc": pa.array([zlib.crc32(p) for p in parts], pa.int64())})

    return spark.read.schema(SCHEMA).parquet(path).select("shard", "block", "n_ids", "planes", "doc_id", "doc_start", "at").mapInArrow(read, "shard int, doc_id long, doc_start long, piece long, n long, crc long")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """From the files, per document: doc_id, start, n_tokens, ids_crc32 of its ids as little-endian unsigned 32-bit integers.

    Rows of one document in several blocks are joined by their checksums, never by their ids. The start adds
    the sizes of the shards before, a table with one row per shard.
    """

    @F.udf("long")
    def joined(parts):
        crc = parts[0]["crc"]
        for part in parts[1:]:
            crc = crc_join(crc, part["crc"], 4 * part["n"])
        return crc

    shards = spark.read.schema(SCHEMA).parquet(path).groupBy("shard").agg(F.sum("n_ids").alias("size"))
    shards = shards.select("shard", (F.sum("size").over(Window.orderBy("shard")) - F.col("size")).alias("base"))
    docs = pieces(spark, path).groupBy("shard", "doc_id", "doc_start").agg(F.sum("n").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("piece", "n", "crc"))).alias("parts"))
    docs = docs.withColumn("crc", F.when(F.size("parts") == 1, F.col("parts")[0]["crc"]))
    whole = docs.where("crc is not null").select("shard", "doc_id", "doc_start", "n_tokens", F.col("crc").alias("ids_crc32"))
    split = docs.where("crc is null").select("shard", "doc_id", "doc_start", "n_tokens", joined("parts").alias("ids_crc32"))
    return whole.unionByName(split).join(F.broadcast(shards), "shard").select("doc_id", (F.col("base") + F.col("doc_start")).alias("start"), "n_tokens", "ids_crc32")


def op1_token_planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = session.new_path(spark, "tokens")
    write(spark.read.parquet(f"{sf_dir}/documents.parquet"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return digests(spark, path)
