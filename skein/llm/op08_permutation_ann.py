"""Approximate nearest neighbours by a permutation index.

Every vector is represented by the order of PIVOTS pivots from nearest to farthest, and posted in the inverted files of its POSTED
nearest pivots. A query reads the files of its VISITED nearest pivots, ranks what it finds there by the footrule distance
between the two orders, and the best SHARE of each file is reranked by the exact cosine. Each file is cut into blocks of about
BLOCK entries by hash of the id, so that no task holds more than a block; queries pass over a block one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skein.llm import session

PIVOTS = 128
POSTED = 4
VISITED = 28
SHARE = 0.25
LEAST = 64
BLOCK = 50_000
NEAREST = 5


def usable(rows: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, vec array<double>) of the rows that take part: id and vector not null, no null or non-finite component, not all zero."""
    vec = F.col(vector).cast(T.ArrayType(T.DoubleType()))
    fine = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("vec", lambda x: x != 0)
    return rows.select(F.col(key).cast("long").alias("id"), vec.alias("vec")).where(F.col("id").isNotNull() & F.col("vec").isNotNull()).where(fine)


def choose_pivots(rows: DataFrame, pivots: int) -> np.ndarray:
    """Unit vectors of up to `pivots` different rows, those of least hash among 4 * pivots: the bounded sample that the index is fitted on."""
    got = rows.orderBy(F.xxhash64("id"), "id").limit(4 * pivots).collect()
    out, seen = [], set()
    for row in got:
        unit = np.array(row["vec"]) / np.linalg.norm(row["vec"])
        if unit.tobytes() not in seen and len(out) < pivots and (not out or len(unit) == len(out[0])):
            seen.add(unit.tobytes())
            out.append(unit)
    return np.array(out)


def _kind(pivots: int) -> type:
    """Of a place among so many pivots."""
    return np.uint8 if pivots <= 1 << 8 else np.uint16 if pivots <= 1 << 16 else np.uint32


def _posted(pivots: np.ndarray, posted: int, visited: int, blocks: int, every: int):
    """Index entries (kind 0) of all vectors, and queries (kind 1), by pivot and block."""

    def run(batches):
        for batch in batches:
            ids, lists = batch.column("id").to_numpy(), batch.column("vec")
            offsets = lists.offsets.to_numpy()
            same = np.flatnonzero(np.diff(offsets) == pivots.shape[1])  # vectors of another length than the pivots' take no part
            if not len(same):
                continue
            values = lists.values.to_numpy()
            vectors = np.stack([values[offsets[i] : offsets[i + 1]] for i in same])
            ids = ids[same]
            order = np.argsort(-(vectors / np.linalg.norm(vectors, axis=1, keepdims=True)) @ pivots.T, axis=1, kind="stable").astype(np.int32)
            places = np.empty(order.shape, _kind(len(pivots)))
            np.put_along_axis(places, order, np.broadcast_to(np.arange(len(pivots), dtype=places.dtype), order.shape), 1)
            block = ((ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % blocks

            def rows(which, pivot, block, kind):
                return pa.RecordBatch.from_arrays([pa.array(pivot.astype(np.int32)), pa.array(block.astype(np.int32)), pa.array(np.full(len(which), kind, np.int32)), pa.array(ids[which]), pa.array([places[i].tobytes() for i in which], pa.binary()), pa.array([vectors[i].tobytes() for i in which], pa.binary())], ["pivot", "block", "kind", "id", "places", "vec"])

            if posted:
                which = np.repeat(np.arange(len(ids)), posted)
                yield rows(which, order[:, :posted].reshape(-1), block[which], 0)
            asks = np.flatnonzero(ids % every == 0) if every else np.zeros(0, np.int64)
            for b in range(blocks):
                which = np.repeat(asks, visited)
                if len(which):
                    yield rows(which, order[asks, :visited].reshape(-1), np.full(len(which), b), 1)

    return run


def _searched(kind: type, share: float, least: int, nearest: int):
    """Over rows sorted by (pivot, block, kind, id): each query's nearest of the block, after the footrule and the exact cosine."""

    def run(batches):
        at, entries, ready = None, [], None
        for batch in batches:
            out = []
            for pivot, block, asks, name, places, vec in zip(*[batch.column(c).to_pylist() for c in ("pivot", "block", "kind", "id", "places", "vec")]):
                if (pivot, block) != at:
                    at, entries, ready = (pivot, block), [], None
                if not asks:
                    entries.append((name, places, vec))
                    continue
                if ready is None:
                    if not entries:
                        continue
                    vectors = np.frombuffer(b"".join(e[2] for e in entries)).reshape(len(entries), -1)
                    ready = (np.array([e[0] for e in entries], np.int64), np.frombuffer(b"".join(e[1] for e in entries), kind).reshape(len(entries), -1), vectors, np.sqrt((vectors * vectors).sum(1)))
                    entries = [None]
                ids, all_places, vectors, norms = ready
                own, query = np.frombuffer(places, kind), np.frombuffer(vec)
                footrule = (np.maximum(all_places, own) - np.minimum(all_places, own)).sum(1, dtype=np.uint64)
                best = np.argsort(footrule, kind="stable")[: max(least, int(share * len(ids)))]
                best = best[ids[best] != name]
                if not len(best):
                    continue
                score = (vectors[best] * query).sum(1) / (norms[best] * np.sqrt((query * query).sum()))
                if len(score) > nearest:
                    edge = np.partition(score, len(score) - nearest)[len(score) - nearest]
                    best, score = best[score >= edge], score[score >= edge]
                for i in np.lexsort((ids[best], -score))[:nearest].tolist():
                    out.append((name, int(ids[best[i]]), float(score[i])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.float64()))], ["query_id", "vec_id", "score"])

    return run


def search(rows: DataFrame, key: str = "vec_id", vector: str = "embedding", every: int = 50, nearest: int = NEAREST, pivots: int = PIVOTS, posted: int = POSTED, visited: int = VISITED, share: float = SHARE) -> DataFrame:
    """query_id, rank from 1, vec_id, score: for rows whose id is divisible by `every`, the nearest other rows found, by cosine.

    Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than the pivots.
    Ties go to the smaller vec_id. Rows that share an id are each other's own row, and the nearest two
    of their vectors give their score. Extra columns are ignored; an empty table
    gives no rows. All rows are indexed; a query that finds fewer than `nearest` reads all files instead.
    """
    spark = rows.sparkSession
    rows = session.checkpoint(usable(rows, key, vector))
    total = rows.count()
    fitted = choose_pivots(rows, max(1, min(pivots, total // 4)))
    found_schema = "query_id long, vec_id long, score double"
    if not len(fitted):
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    posted, visited = min(posted, len(fitted)), min(visited, len(fitted))
    blocks = max(1, -(-total * posted // (len(fitted) * BLOCK)))

    def found(asked: DataFrame | None, visited: int) -> DataFrame:
        schema = "pivot int, block int, kind int, id long, places binary, vec binary"
        if asked is None:
            index = rows.mapInArrow(_posted(fitted, posted, visited, blocks, every), schema)
        else:
            index = rows.mapInArrow(_posted(fitted, posted, 0, blocks, 0), schema).unionByName(asked.mapInArrow(_posted(fitted, 0, visited, blocks, 1), schema))
        index = index.repartition(session.partitions(spark), "pivot", "block").sortWithinPartitions("pivot", "block", "kind", "id")
        return index.mapInArrow(_searched(_kind(len(fitted)), share, LEAST, nearest), found_schema).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))

    first = session.checkpoint(found(None, visited))
    if visited < len(fitted):
        enough = first.groupBy("query_id").count().where(F.col("count") >= min(nearest, total - 1)).select(F.col("query_id").alias("id"))
        short = rows.where(F.col("id") % every == 0).join(enough, "id", "left_anti")
        if short.take(1):
            first = first.unionByName(found(short, len(fitted))).groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op8_permutation_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
