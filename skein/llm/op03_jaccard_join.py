"""N-gram Jaccard join by set-relation skipping.

1. Documents with the same set of shingles are one set, and only sets are joined.
2. Block-skip index: each set is cut into blocks by the place of its shingles in a common order (that of a hash). Two sets that are
   similar enough differ in fewer shingles than there are blocks, so at least one block is equal in both. The index has
   a list for each block's place and content; lists that hold a different block at that place are skipped without a look at their
   entries, and what a list holds are sets that agree on a whole block, not on one shingle.
3. Answers from a similar set's answers: each list has a pivot, its smallest set. Sets are compared with their pivots only, which gives
   the shingles in which each differs from its pivot. From those differences, mostly short, the distances among the
   pivot's sets follow exactly: those near enough to the pivot are linked through it, those whose distances to the pivot are
   too far apart can't be linked, and the others are counted on the differences alone.
   A pivot with more than PART sets has them dealt over several tasks, each of which gets the pivot, and each set not linked with the
   pivot passes by every one of those tasks.
4. The links, about one per set and pivot, are joined into classes.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import kernels, session

U = np.uint64
_NULL_ID = -(1 << 63)
#: Sets of one pivot in a task, about; more are dealt over several.
PART = 1000
#: Size of the fixed filter of block keys that several sets have, in bits: 8 MB, whatever the corpus.
FILTER_BITS = 26


def shingle_sets(data: np.ndarray, at: np.ndarray, k: int) -> list[np.ndarray]:
    """Each row's distinct shingles, as sorted 64-bit hashes: k words, or all words of a row with fewer. A-Z count as a-z."""
    data = kernels.LOWER[data]
    start, end, row = kernels.words(data, at)
    tokens = kernels.word_hashes(data, start, end)
    rows = np.arange(len(at))
    words = np.searchsorted(row, rows)
    grams, first = kernels.grams(tokens, row, k)
    bounds = np.searchsorted(row[first], rows)
    out = [np.unique(grams[a:b]) for a, b in zip(bounds[:-1], bounds[1:])]
    for i in np.flatnonzero((np.diff(words) > 0) & (np.diff(words) < k)):
        out[i] = kernels.grams(tokens[words[i] : words[i + 1]], row[words[i] : words[i + 1]], int(words[i + 1] - words[i]))[0]
    return out


@functools.cache
def bands(percent: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest set size of each band, and blocks of each band's scheme, for sizes below 2**bits and the band after. A set's partners are in
    its band or the ones beside it."""
    last, low = [], 1
    while low < 2 << bits:
        last.append(low * 100 // percent)
        low = last[-1] + 1
    last = np.array([*last, low * 100 // percent], np.int64)
    return last, distance(2 * last, percent) + 1


def distance(sizes, percent: int):
    """Most shingles in which two linked sets can differ, from the sum of their sizes."""
    return sizes * (100 - percent) // (100 + percent)


def block_keys(sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(key, number of the set) of each block of each set, in its band's scheme and in the next band's.

    A block that is empty in both of two sets agrees too, though it says nothing. A set with so many empty blocks that a
    partner might agree on those alone has keys for them as well; both sets of such a pair then have.
    """
    size = np.array([len(s) for s in sets], np.int64)
    last, blocks = bands(percent, int(size.max(initial=1)).bit_length())
    band = np.searchsorted(last, size)
    tokens = np.concatenate(sets) if sets else np.zeros(0, U)
    place, value = kernels.mix(tokens ^ U(0x5851F42D4C957F2D)), kernels.mix(tokens + U(0x14057B7EF767814F))
    owner = np.repeat(np.arange(len(sets)), size)
    keys, owners = [], []
    for step in (0, 1):
        scheme = band + step
        reach = np.minimum(last[scheme], size * 100 // percent)
        some = (size > 0) & ((reach > last[band]) if step else True)
        m = np.where(some, blocks[scheme], 0)
        base = np.cumsum(m) - m
        total = int(m.sum())
        if not total:
            continue
        mine = some[owner]
        at = base[owner[mine]] + (place[mine] % m[owner[mine]].astype(U)).astype(np.int64)
        content = np.zeros(total, U)
        np.add.at(content, at, value[mine])
        filled = np.bincount(at, minlength=total) > 0
        who = np.repeat(np.arange(len(sets)), m)
        full = np.add.reduceat(filled, base[some], dtype=np.int64)
        short = np.zeros(len(sets), bool)
        short[some] = full < distance(size + reach, percent)[some] + 1
        keep = np.flatnonzero(filled | short[who])
        number = (np.arange(total) - base[who])[keep].astype(U)
        keys.append(kernels.mix(content[keep] + kernels.mix(number * U(1 << 20) + scheme[who[keep]].astype(U) + U(1))))
        owners.append(who[keep])
    if not keys:
        return np.zeros(0, U), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def set_names(sets: list[np.ndarray]) -> np.ndarray:
    """A 64-bit name for each set: the sum of its shingles' hashes, mixed with its size."""
    return np.array([int(kernels.mix(np.array([kernels.mix(s ^ U(0xA0761D6478BD642F)).sum(dtype=U) + U(len(s))], U))[0]) for s in sets], U).view(np.int64)


def _sets(k: int):
    def run(batches):
        for batch in batches:
            for first, end, data, at in kernels.slices(batch.column("text")):
                sets = shingle_sets(data, at, k)
                yield pa.RecordBatch.from_arrays([batch.column("id").slice(first, end - first), batch.column("row").slice(first, end - first), pa.array([len(s) for s in sets], pa.int64()), pa.array(set_names(sets))], ["id", "row", "n", "set"])

    return run


def _index(k: int, percent: int, listed: Broadcast | None):
    """(key, set) of each block of each set; of those in the filter of keys, where there is one."""

    def run(batches):
        bits = np.frombuffer(listed.value, np.uint8) if listed else None
        seen: set[int] = set()  # of this task; copies in other tasks meet in the lists
        for batch in batches:
            for _, _, data, at in kernels.slices(batch.column("text")):
                sets = shingle_sets(data, at, k)
                names = set_names(sets)
                new = [i for i, name in enumerate(names.tolist()) if len(sets[i]) and name not in seen and not seen.add(name)]
                keys, owner = block_keys([sets[i] for i in new], percent)
                if bits is not None:
                    keep = kernels.has(bits, keys)
                    keys, owner = keys[keep], owner[keep]
                if len(keys):
                    yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(names[new][owner])], ["key", "set"])

    return run


def _members(k: int):
    """A row for each pivot of a set, with its shingles, in one of the pivot's parts; the pivot itself in all."""

    def run(batches):
        for batch in batches:
            for first, end, data, at in kernels.slices(batch.column("text")):
                sets = shingle_sets(data, at, k)
                names = batch.column("set").slice(first, end - first).to_pylist()
                pivots = batch.column("pivots").slice(first, end - first).to_pylist()
                for name, tokens, own in zip(names, sets, pivots):
                    rows = [(p["pivot"], part, p["parts"]) for p in own for part in (range(p["parts"]) if p["pivot"] == name else [name % p["parts"]])]
                    for begin in range(0, len(rows), 4096):
                        some = rows[begin : begin + 4096]
                        columns = [*zip(*some), [name] * len(some), [tokens.tobytes()] * len(some)]
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.binary()))], ["pivot", "part", "parts", "set", "tokens"])

    return run


def similar(inner, outer, percent: int):
    return 100 * inner >= percent * outer


def _compared(percent: int):
    """Over (pivot, part, parts, set, tokens), the pivot's own row first. A pivot with one part is settled here: kind -1, links of pivot (a set)
    and set. Of others, kind 0: each set's size, the shingles in which it differs from the pivot, and whether the two are linked.
    Memory: one pivot's set, and the differences of a part's sets where it is the only one.
    """

    def settled(pivot, held):
        names, sizes, apart, near = zip(*held)
        links = [(pivot, name) for name, linked in zip(names, near) if linked]
        if not all(near):
            own = Part(pivot, names, sizes, apart, near, percent)
            for name, size, away, linked in held:
                if not linked:
                    links += own.links(name, size, away)
        return [(-1, a, 0, 1, b, 0, None, True) for a, b in links]

    def run(batches):
        at, base, held = None, None, []
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.bool_())

        def rows(out):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], ["kind", "pivot", "part", "parts", "set", "n", "away", "near"])

        for batch in batches:
            out = []
            for pivot, part, parts, name, tokens in zip(*(batch.column(c).to_pylist() for c in ("pivot", "part", "parts", "set")), batch.column("tokens")):
                tokens = np.frombuffer(tokens.as_buffer(), U)
                if (pivot, part) != at:
                    if held:
                        out += settled(at[0], held)
                    at, base, held = (pivot, part), tokens, []
                if name == pivot:
                    continue
                away = np.setxor1d(base, tokens, assume_unique=True)
                both = len(base) + len(tokens)
                near = bool(similar((both - len(away)) // 2, (both + len(away)) // 2, percent))
                if parts == 1:
                    held.append((name, len(tokens), away, near))
                else:
                    out.append((0, pivot, part, parts, name, len(tokens), away.tobytes(), near))
            if out:
                yield rows(out)
        if held and (out := settled(at[0], held)):
            yield rows(out)

    return run


class Part:
    """A pivot's sets in one task, by their differences from it; links with sets that pass by."""

    def __init__(self, pivot: int, names: list[int], sizes: list[int], apart: list[np.ndarray], near: list[bool], percent: int):
        self.percent, self.names = percent, [pivot, *names]
        self.root = np.array([0, *(0 if x else i + 1 for i, x in enumerate(near))])
        self.sizes, self.away = np.array([0, *sizes], np.int64), np.array([0, *map(len, apart)], np.int64)
        owner = np.repeat(np.arange(len(self.names)), self.away)
        tokens = np.concatenate(apart) if apart else np.zeros(0, U)
        by = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[by], owner[by]

    def find(self, i: int) -> int:
        while self.root[i] != i:
            self.root[i] = self.root[self.root[i]]
            i = self.root[i]
        return i

    def links(self, name: int, size: int, apart: np.ndarray) -> list[tuple[int, int]]:
        """Links that join a set to the classes here that it is linked with, and those to each other."""
        most = distance(self.sizes + size, self.percent)
        # the triangle inequality on distances to the pivot, then sizes, before anything is counted
        other = (np.abs(self.away - len(apart)) <= most) & (np.abs(self.sizes - size) <= most)
        other[0] = False
        if not other.any():
            return []
        low, high = np.searchsorted(self.tokens, apart, "left"), np.searchsorted(self.tokens, apart, "right")
        n = high - low
        at = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        differ = self.away + len(apart) - 2 * np.bincount(self.owner[at], minlength=len(self.names))
        other &= similar((self.sizes + size - differ) // 2, (self.sizes + size + differ) // 2, self.percent)
        out, mine = [], None
        for j in np.flatnonzero(other).tolist():
            r = self.find(j)
            if mine is None:
                mine = r
                out.append((self.names[r], name))
            elif r != mine:
                self.root[max(r, mine)] = min(r, mine)
                out.append((self.names[r], self.names[mine]))
                mine = min(r, mine)
        return [(a, b) for a, b in out if a != b]


def _rest_links(percent: int):
    """Over (pivot, part, kind, set, n, away, near): kind 0 are the part's own sets, kind 1 the pivot's sets that aren't linked with it. Memory: the
    part's own differences."""

    def run(batches):
        at, own, ready = None, ([], [], [], []), None
        for batch in batches:
            out = []
            for pivot, part, kind, name, n, near, away in zip(*(batch.column(c).to_pylist() for c in ("pivot", "part", "kind", "set", "n", "near")), batch.column("away")):
                if (pivot, part) != at:
                    at, own, ready = (pivot, part), ([], [], [], []), None
                away = np.frombuffer(away.as_buffer(), U)
                if kind == 0:
                    for column, value in zip(own, (name, n, away, near)):
                        column.append(value)
                    continue
                ready = ready or Part(pivot, *own, percent)
                out += ready.links(name, n, away)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["a", "b"])

    return run


def join(docs: DataFrame, k: int = 5, percent: int = 80, part: int = PART) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: the size of its set, and the smallest doc_id that links lead to.

    docs needs doc_id and text; other columns are ignored. Two documents link when 100 * intersection >= percent * union of their
    sets of k-word shingles. No words, null or empty text: an empty set, linked with nothing; its component is itself.
    Rows with equal sets are linked, rows that share a doc_id are rows of their own. A component's doc_id is null only
    if all in it are. Shingles and sets are known by 64-bit hashes.
    """
    spark = docs.sparkSession
    rows = session.documents(docs).select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("row"), "text")
    members = session.checkpoint(rows.mapInArrow(session.released(_sets(k)), "id long, row long, n long, set long"))
    # first the keys that several sets have, then their sets: a frequent key's list is never gathered to find its pivot
    keys = rows.select("text").mapInArrow(session.released(_index(k, percent, None)), "key long, set long").groupBy("key").count().where("count > 1")
    listed = spark.sparkContext.broadcast(session.bitmap(keys, F.shiftrightunsigned("key", 64 - FILTER_BITS), FILTER_BITS))
    index = session.checkpoint(rows.select("text").mapInArrow(session.released(_index(k, percent, listed)), "key long, set long"))
    lists = session.checkpoint(index.groupBy("key").agg(F.min("set").alias("pivot"), F.max("set").alias("last")).where("pivot < last").drop("last"))
    pairs = session.checkpoint(index.join(lists, "key").where("pivot <> set").select("pivot", "set").distinct())
    # a pivot and its number of parts; the pivot goes to all of them
    parts = session.checkpoint(pairs.groupBy("pivot").agg(F.ceil(F.count(F.lit(1)) / part).cast("int").alias("parts")))
    asked = pairs.join(parts, "pivot").unionByName(parts.select("pivot", F.col("pivot").alias("set"), "parts"))
    wanted = asked.groupBy("set").agg(F.collect_set(F.struct("pivot", "parts")).alias("pivots"))
    chosen = members.where("n > 0").groupBy("set").agg(F.min(F.struct("id", "row")).alias("of")).select("set", "of.id", "of.row")
    wanted = session.checkpoint(wanted.join(chosen, "set"))
    near, _ = session.may_contain(rows, "id", wanted)
    compared = near.join(wanted, ["id", "row"]).select("set", "pivots", "text").mapInArrow(session.released(_members(k)), "pivot long, part int, parts int, set long, tokens binary")
    compared = compared.repartition(session.partitions(spark), "pivot", "part").sortWithinPartitions("pivot", "part", F.col("set") != F.col("pivot"), "set")
    path = session.new_path(spark, "compared")
    compared.mapInArrow(session.released(_compared(percent)), "kind int, pivot long, part int, parts int, set long, n long, away binary, near boolean").write.parquet(path)
    compared = spark.read.parquet(path)
    rest = compared.where("not near")
    own = compared.where("kind = 0").join(rest.select("pivot").distinct(), "pivot", "left_semi")
    passing = rest.withColumn("kind", F.lit(1)).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    order = ["pivot", "part", "kind", "set", "n", "away", "near"]
    meet = own.select(*order).unionByName(passing.select(*order)).repartition(session.partitions(spark), "pivot", "part").sortWithinPartitions("pivot", "part", "kind", "set")
    links = compared.where("near").select(F.col("pivot").alias("a"), F.col("set").alias("b")).unionByName(meet.mapInArrow(session.released(_rest_links(percent)), "a long, b long"))
    roots = session.classes(links).select(F.col("node").alias("set"), "root")
    session.remove(spark, path)
    placed = members.join(roots, "set", "left").withColumn("class", F.coalesce("root", "set"))
    # a table of its own, so that the rows of a large class can be dealt over several tasks in the join
    least = session.checkpoint(placed.where("n > 0").groupBy("class").agg(F.min(F.nullif("id", F.lit(_NULL_ID))).alias("least")))
    doc_id = F.nullif("id", F.lit(_NULL_ID))
    full = placed.where("n > 0").join(least, "class").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return full.unionByName(members.where("n = 0").select(doc_id.alias("doc_id"), F.col("n").alias("n_shingles"), doc_id.alias("component_id")))


def op3_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(spark.read.parquet(f"{sf_dir}/documents.parquet"), k=3, percent=90)


#: All pairs that share a shingle, so for small tables.
OP3_SQL = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 2], ' ')) AS h FROM d, unnest(range(1, greatest(2, len(w) - 1))) AS r(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS inner_size FROM s a JOIN s b ON a.h = b.h AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * inner_size >= 90 * (x.n + y.n - inner_size)),
edges AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM edges UNION SELECT doc_id, e.b FROM reach JOIN edges e ON e.a = other)
SELECT doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(c.least, doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(other) AS least FROM reach GROUP BY doc_id) c USING (doc_id)
"""
