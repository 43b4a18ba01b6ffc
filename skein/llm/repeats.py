"""Windows of a fixed number of tokens that occur more than once in a corpus.

Only some suffixes are kept: those that begin where a run of `prefix` tokens has the least hash of all such runs in
some window (its anchor). A window's anchor depends on the window's tokens alone, so equal windows have equal anchors at
the same distance, and nothing is lost. Suffixes are dealt out by their prefix, the anchor's hash, and a prefix that only
one place has is dropped before anything else is kept of it. The stretch of text that an anchor's windows cover is its block.
Blocks that are equal as a whole are one leaf, all of whose windows repeat; of each leaf one block stands for all.

What remains are prefixes with several leaves. Their windows are counted. A prefix whose windows fit in a task's memory is a
group: one task gets its blocks' tokens, numbers their windows' nodes (see covered), and reads the repeats off the nodes that several
windows share. A prefix with more windows has it lengthened to the whole window: each such group is a single node, which an
aggregation with map-side sums counts, wherever its windows are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.llm import kernels, session

U = np.uint64
#: Windows handled at once; longer texts are walked in overlapping parts.
PART = 1 << 18
#: Size of the fixed filter of repeated prefixes, in bits: 8 MB, whatever the corpus.
FILTER_BITS = 26
#: Windows of a prefix that one task may hold; also no more than a task's share of all, but LEAST of them are never too many.
MOST, LEAST = 1 << 19, 1 << 12
#: Tokens of whole groups that are handled at once.
HELD = 1 << 19
NULL_ID = -(1 << 63)
_BASE = 0xD1342543DE82EF95


def keyed(docs: DataFrame) -> DataFrame:
    """id (null doc_id as the smallest), row (the text's hash, for rows that share a doc_id) and text."""
    return session.documents(docs).select(F.coalesce("doc_id", F.lit(NULL_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")


def offsets(sizes: np.ndarray) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes)])


def _range_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    return kernels.mix((hashes[width:] - hashes[:-width]) * kernels.powers(_BASE, len(hashes))[1][: len(hashes) - width])


def suffixes(tokens: np.ndarray, bounds: np.ndarray, width: int, prefix: int) -> Iterator[tuple]:
    """For parts of a slice: (prefix hash, row, first window's start, windows, block hash) for each kept suffix, and functions that give
    the hashes of their windows and their tokens. bounds: the rows' offsets into tokens."""
    if len(tokens) < width:
        return
    rows = np.repeat(np.arange(len(bounds) - 1, dtype=np.int32), np.diff(bounds))
    for begin in range(0, len(tokens) - width + 1, PART):
        part = tokens[begin : begin + PART + width - 1]
        where = rows[begin : begin + len(part)]
        starts = np.flatnonzero(where[: len(part) - width + 1] == where[width - 1 :])
        if not len(starts):
            continue
        hashes = kernels.prefix(part, _BASE)
        runs = _range_hashes(hashes, prefix)
        bits = U(int(len(part)).bit_length())
        packed = ((runs >> bits) << bits) | np.arange(len(runs), dtype=U)
        place = (kernels.window_min(packed, width - prefix + 1)[starts] & ((U(1) << bits) - U(1))).astype(np.int64)
        new = np.ones(len(starts), bool)
        new[1:] = (place[1:] != place[:-1]) | (starts[1:] != starts[:-1] + 1)
        first = np.flatnonzero(new)
        count = np.diff(np.append(first, len(starts)))
        at = starts[first]

        def windows(which: np.ndarray, hashes=hashes, at=at, count=count) -> pa.Array:
            s = kernels.ragged(at[which], count[which])
            return pa.ListArray.from_arrays(offsets(count[which]).astype(np.int32), kernels.span(hashes, s, s + width, _BASE).view(np.int64))

        def contents(which: np.ndarray, part=part, at=at, count=count) -> pa.Array:
            n = count[which] + width - 1
            data = part[kernels.ragged(at[which], n)]
            return pa.Array.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(offsets(n * part.itemsize)), pa.py_buffer(data)])

        row = where[at].astype(np.int64)
        block = kernels.span(hashes, at, at + count - 1 + width, _BASE)
        yield runs[place[first]], row, begin + at - bounds[row], count, block, windows, contents


def _prefixes(split: Callable, width: int, prefix: int):
    def run(batches):
        for batch in batches:
            ids = batch.column("id").to_numpy()
            for first, end, data, at in kernels.slices(batch.column("text")):
                tokens, bounds = split(data, at)
                for h, row, *_ in suffixes(tokens, bounds, width, prefix):
                    yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(ids[first:end][row])], ["h", "id"])

    return run


def _blocks(split: Callable, width: int, prefix: int, repeated: Broadcast):
    def run(batches):
        bits = np.frombuffer(repeated.value, np.uint8)
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for first, end, data, at in kernels.slices(batch.column("text")):
                tokens, bounds = split(data, at)
                for h, row, start, count, block, *_ in suffixes(tokens, bounds, width, prefix):
                    keep = np.flatnonzero(kernels.has(bits, h))
                    if not len(keep):
                        continue
                    # a text that repeats itself has one row for all places of a block
                    h, row, start, count, block = h[keep], row[keep], start[keep], count[keep], block[keep]
                    by = np.lexsort((start, block, h, row))
                    h, row, start, count, block = h[by], row[by], start[by], count[by], block[by]
                    new = np.ones(len(h), bool)
                    new[1:] = (h[1:] != h[:-1]) | (block[1:] != block[:-1]) | (row[1:] != row[:-1])
                    at = np.flatnonzero(new)
                    own, text = ids[first:end][row[at]], keys[first:end][row[at]]
                    size = np.diff(np.append(at, len(h)))
                    later = np.ones(len(h), bool)
                    later[at] = False
                    more = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size - 1)]).astype(np.int32), mask=np.append(size == 1, False)), pa.array(start[later]))
                    columns = [pa.array(x) for x in (h[at].view(np.int64), own, text, count[at].astype(np.int32), block[at].view(np.int64), start[at], _place(own, text, start[at]).view(np.int64))]
                    yield pa.RecordBatch.from_arrays([*columns, more], ["h", "id", "row", "count", "block", "start", "place", "more"])

    return run


def _place(ids: np.ndarray, rows: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return kernels.mix(ids.view(U) ^ kernels.mix(rows.view(U) ^ kernels.mix(starts.view(U))))


def _standing(split: Callable, width: int, prefix: int, wanted: Broadcast):
    """The blocks that stand for their leaves, and some that share a slot of the filter with one: (h, id, block, tokens)."""
    return _kept(split, width, prefix, wanted, lambda which, _, contents: {"tokens": contents(which).cast(pa.binary())})


def _single(split: Callable, width: int, prefix: int, wanted: Broadcast, several: Broadcast | None):
    """The windows of such blocks by their hashes, (h, id, block, at, windows): all, or those that share a slot with one of several."""

    def of(which, windows, _):
        lists = windows(which)
        n, values = np.diff(lists.offsets.to_numpy()), lists.values.to_numpy()
        at = kernels.ragged(np.zeros(len(n), np.int64), n).astype(np.int32)
        if several is not None:
            keep = kernels.has(np.frombuffer(several.value, np.uint8), values.view(U))
            n = np.diff(offsets(keep)[offsets(n)])
            at, values = at[keep], values[keep]
        bounds = offsets(n).astype(np.int32)
        return {"at": pa.ListArray.from_arrays(bounds, at), "windows": pa.ListArray.from_arrays(bounds, values)}

    return _kept(split, width, prefix, wanted, of)


def _kept(split: Callable, width: int, prefix: int, wanted: Broadcast, of: Callable):
    def run(batches):
        bits = np.frombuffer(wanted.value, np.uint8)
        for batch in batches:
            ids, keys = batch.column("id").to_numpy(), batch.column("row").to_numpy()
            for first, end, data, at in kernels.slices(batch.column("text")):
                tokens, bounds = split(data, at)
                for h, row, start, _, block, windows, contents in suffixes(tokens, bounds, width, prefix):
                    own = ids[first:end][row]
                    keep = np.flatnonzero(kernels.has(bits, _place(own, keys[first:end][row], start)))
                    if len(keep):
                        columns = {"h": pa.array(h[keep].view(np.int64)), "id": pa.array(own[keep]), "block": pa.array(block[keep].view(np.int64)), **of(keep, windows, contents)}
                        yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _ranges(h, blocks, ids, starts, width):
    """Runs of window starts, in order within a block, as ranges of tokens."""
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (blocks[1:] != blocks[:-1]) | (ids[1:] != ids[:-1]) | (starts[1:] != starts[:-1] + 1)
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(h)) - 1
    return pa.RecordBatch.from_arrays([pa.array(h[first]), pa.array(blocks[first]), pa.array(ids[first]), pa.array(starts[first]), pa.array(starts[last] + width)], ["h", "block", "id", "from", "to"])


def _groups(width: int, kind: str, nodes: Callable, earlier: bool):
    """Over blocks sorted by (h, id, block): (h, block, id, from, to), ranges of a block's tokens that repeated windows cover.

    Memory: HELD tokens, or one prefix's blocks where they are more, which MOST bounds.
    """

    def found(table):
        h, ids, blocks = (table.column(c).to_numpy() for c in ("h", "id", "block"))
        data, at = kernels.column(table.column("tokens"))
        tokens = data[at[0] : at[-1]].view(kind)
        at = (at - at[0]) // tokens.itemsize
        n = np.diff(at) - width + 1
        number = nodes(tokens, kernels.ragged(at[:-1], n), width)
        wide, inner = np.repeat(np.arange(len(h)), n), kernels.ragged(np.zeros(len(h), np.int64), n)
        if earlier:
            least = np.full(int(number.max(initial=-1)) + 1, np.iinfo(np.int64).max)
            np.minimum.at(least, number, ids[wide])
            hit = ids[wide] > least[number]
        else:
            hit = np.bincount(number)[number] > 1
        if hit.any():
            yield _ranges(h[wide[hit]], blocks[wide[hit]], ids[wide[hit]], inner[hit], width)

    def run(batches):
        held, size = [], 0
        for batch in batches:
            held.append(batch)
            size += batch.column("tokens").nbytes
            if size < HELD * np.dtype(kind).itemsize:
                continue
            table = pa.Table.from_batches(held).combine_chunks()
            h = table.column("h").to_numpy()
            ended = int(np.searchsorted(h, h[-1]))  # rows of groups that end here
            yield from found(table[:ended])
            held = table[ended:].combine_chunks().to_batches()
            size = sum(b.column("tokens").nbytes for b in held)
        if size:
            yield from found(pa.Table.from_batches(held))

    return run


def _joined(width: int):
    """Rows (h, block, id, at array) to ranges of tokens."""

    def run(batches):
        for batch in batches:
            lists = batch.column("at")
            n = np.diff(lists.offsets.to_numpy())
            values = np.concatenate([np.sort(x) for x in np.split(lists.flatten().to_numpy(), np.cumsum(n)[:-1])]).astype(np.int64) if len(n) else np.zeros(0, np.int64)
            yield _ranges(*(np.repeat(batch.column(c).to_numpy(), n) for c in ("h", "block", "id")), values, width)

    return run


def covered(docs: DataFrame, split: Callable, width: int, prefix: int, earlier: bool, kind: str, nodes: Callable) -> DataFrame:
    """(id, row, spans array<struct<start,end>>): ranges of tokens in docs (id, row, text) covered by windows that also start in a row of
    smaller id (earlier), or anywhere else. Ranges may touch and overlap.

    `split` gives a slice's tokens, of numpy type `kind`, and its rows' offsets into them. `nodes` numbers windows: from a group's
    tokens, the windows' starts and width, a number from 0 for each, equal where the windows are. Blocks, and the windows of
    prefixes that are too many for a task, count as equal if 64 bits of their hashes agree, and 64 of their prefixes'.
    """
    spark = docs.sparkSession
    places = docs.select("id", "text").mapInArrow(_prefixes(split, width, prefix), "h long, id long").groupBy("h")
    shared = places.agg(F.min("id").alias("a"), F.max("id").alias("b")).where("a < b") if earlier else places.agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = spark.sparkContext.broadcast(session.bitmap(shared, F.shiftrightunsigned("h", 64 - FILTER_BITS), FILTER_BITS))
    found = docs.mapInArrow(_blocks(split, width, prefix, repeated), "h long, id long, row long, count int, block long, start long, place long, more array<long>")
    blocks, blocks_path = session.stored(found, "blocks")
    # leaves: a row for each different block, whatever the number of its copies
    leaves = blocks.groupBy("h", "block")
    if earlier:
        leaves = leaves.agg(F.max("count").alias("count"), F.min(F.struct("id", "place")).alias("first"), F.max("id").alias("most"))
        leaves = leaves.select("h", "block", "count", "first.place", F.col("first.id").alias("least"), (F.col("first.id") < F.col("most")).alias("copied"))
    else:
        leaves = leaves.agg(F.max("count").alias("count"), F.min("place").alias("place"), F.sum(1 + F.coalesce(F.array_size("more"), F.lit(0))).alias("n"))
        leaves = leaves.select("h", "block", "count", "place", (F.col("n") > 1).alias("copied"))
    leaves, first_path = session.stored(leaves, "leaves")
    # the windows of each prefix that has several leaves
    sizes = session.checkpoint(leaves.groupBy("h").agg(F.sum("count").alias("windows"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    leaves, leaves_path = session.stored(leaves.join(sizes, "h", "left"), "leaves")
    session.remove(spark, first_path)
    total = leaves.where("windows is not null").agg(F.sum("count").alias("n")).first()["n"] or 0
    most = min(MOST, max(LEAST, total // session.partitions(spark)))
    place = F.shiftrightunsigned("place", 64 - FILTER_BITS)
    wanted = spark.sparkContext.broadcast(session.bitmap(leaves.where(F.col("windows") <= most), place, FILTER_BITS))
    ranges = "h long, block long, id long, from long, to long"
    groups = docs.mapInArrow(_standing(split, width, prefix, wanted), "h long, id long, block long, tokens binary")
    groups = groups.repartition(session.partitions(spark), "h").sortWithinPartitions("h", "id", "block")
    inner = groups.mapInArrow(_groups(width, kind, nodes, earlier), ranges)
    large = leaves.where(F.col("windows") > most)
    if large.take(1):
        wanted = spark.sparkContext.broadcast(session.bitmap(large, place, FILTER_BITS))
        columns = "h long, id long, block long, at array<int>, windows array<long>"
        single = docs.mapInArrow(_single(split, width, prefix, wanted, None), columns)
        several = single.select("h", "id", F.explode("windows").alias("window")).groupBy("h", "window").agg(F.min("id").alias("low"), F.count(F.lit(1)).alias("n"))
        several = session.checkpoint(several.where("n > 1").drop("n"))
        chosen = spark.sparkContext.broadcast(session.bitmap(several, F.shiftrightunsigned("window", 64 - FILTER_BITS), FILTER_BITS))
        single = docs.mapInArrow(_single(split, width, prefix, wanted, chosen), columns)
        single = single.select("h", "block", "id", F.inline(F.arrays_zip("at", F.col("windows").alias("window")))).join(several, ["h", "window"])
        single = (single.where("id > low") if earlier else single).groupBy("h", "block", "id").agg(F.collect_list("at").alias("at"))
        inner = inner.unionByName(single.mapInArrow(_joined(width), ranges))
    # a later copy that passed the filter by its slot alone repeats its own leaf: with earlier, only what the first copy's id repeats counts
    leaf = ["h", "block", "least"] if earlier else ["h", "block"]
    inner = inner.withColumnRenamed("id", "least").groupBy(*leaf).agg(F.collect_set(F.struct("from", "to")).alias("inner"))
    # a table of its own, so that the copies of a frequent block can be dealt over several tasks in the join
    leaves = session.checkpoint(leaves.drop("place", "windows", "count").join(inner, leaf, "left").where(F.col("copied") | F.col("inner").isNotNull()))
    hit = blocks.drop("place").join(leaves, ["h", "block"])
    whole = F.col("id") > F.col("least") if earlier else F.col("copied")
    every = F.array(F.struct(F.lit(0).cast("long").alias("from"), (F.col("count") - 1 + width).cast("long").alias("to")))
    hit = hit.select("id", "row", "start", "more", F.when(whole, every).otherwise(F.col("inner")).alias("inner")).where("inner is not null")
    starts = F.concat(F.array("start"), F.coalesce("more", F.array().cast("array<bigint>")))
    ranges = hit.select("id", "row", F.explode(starts).alias("s"), "inner").select("id", "row", "s", F.explode("inner").alias("r"))
    ranges = ranges.select("id", "row", (F.col("s") + F.col("r.from")).alias("start"), (F.col("s") + F.col("r.to")).alias("end"))
    spans = session.checkpoint(ranges.groupBy("id", "row").agg(F.collect_list(F.struct("start", "end")).alias("spans")))
    for path in (blocks_path, leaves_path):
        session.remove(spark, path)
    return spans


def ranges(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of row i's spans."""
    spans = batch.column("spans")[i]
    if not spans.is_valid:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    values = spans.values
    return kernels.runs(values.field("start").to_numpy(zero_copy_only=False), values.field("end").to_numpy(zero_copy_only=False))


def rewritten(docs: DataFrame, spans: DataFrame, work: Callable, schema: str) -> DataFrame:
    """`work` over docs (id, row, text) with their spans, null where they have none; only rows that may have some are shuffled."""
    near, far = session.may_contain(docs, "id", spans)
    near = near.join(spans, ["id", "row"], "left")
    far = far.withColumn("spans", F.lit(None).cast("array<struct<start:bigint,end:bigint>>"))
    return far.select(*near.columns).mapInArrow(work, schema).unionByName(near.mapInArrow(work, schema))
