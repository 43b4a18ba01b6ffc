"""Line dedup against levelled sorted runs of line hashes.

The index is a list of runs. A run is a Parquet table of (key hash, owner), bucketed and sorted by hash, so that joining
a batch with a run moves the batch only; each bucket of the run is read in place and put in order for the merge, as Spark
does not take the order of a bucket's files for granted. A batch's keys are anti-joined with every run; what
is left, with the batch's smallest doc_id as owner, becomes a new run of level 0. When a level has FANOUT runs they are
merged into one run of the next level. Runs never share a key, so there are about log(batches) runs and each key is
rewritten as many times.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import session

FANOUT = 3
BATCHES = 4
MIN_LENGTH = 10
#: ASCII white space, stripped at both ends of a line.
WHITE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_NULL_ID = -(1 << 63)


def lines(docs: DataFrame, min_length: int = MIN_LENGTH) -> DataFrame:
    """(id, row, at, h1, h2) of each line with a key of min_length code points or more; 128 bits of hash stand for the key."""
    rows = docs.select(F.coalesce("doc_id", F.lit(_NULL_ID)).alias("id"), F.xxhash64("text").alias("row"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    key = F.translate(F.btrim("line", F.lit(WHITE)), UPPER, LOWER)
    return rows.select("id", "row", "at", key.alias("key")).where(F.length("key") >= min_length).select("id", "row", "at", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


class LineIndex:
    """Runs in the shared folder. `levels` lists the table names of each level."""

    def __init__(self, spark: SparkSession, fanout: int = FANOUT):
        self.spark, self.fanout, self.levels = spark, fanout, [[]]
        self.buckets = session.partitions(spark)
        self.name = f"skein_lines_{uuid.uuid4().hex}"
        self.count = 0

    def runs(self) -> list[DataFrame]:
        return [self.spark.table(name) for level in self.levels for name in level]

    def _write(self, rows: DataFrame) -> str:
        name = f"{self.name}_{self.count}"
        self.count += 1
        rows = rows.select("h1", "h2", "owner").repartition(self.buckets, "h1", "h2")
        rows.write.bucketBy(self.buckets, "h1", "h2").sortBy("h1", "h2").option("path", f"{session.shared_dir(self.spark)}/{name}").saveAsTable(name)
        return name

    def add(self, batch: DataFrame) -> None:
        """batch (id, h1, h2): its keys that no run has become a run, owned by their smallest id."""
        new = batch.groupBy("h1", "h2").agg(F.min("id").alias("owner"))
        for run in self.runs():
            new = new.join(run.select("h1", "h2"), ["h1", "h2"], "left_anti")
        self.levels[0].append(self._write(new))
        level = 0
        while len(self.levels[level]) >= self.fanout:
            old = self.levels[level]
            merged = self._write(self.spark.table(old[0]) if len(old) == 1 else _union([self.spark.table(n) for n in old]))
            self.levels[level] = []
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(merged)
            self._drop(old)
            level += 1

    def _drop(self, names: list[str]) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE {name}")
            session.remove(self.spark, f"{session.shared_dir(self.spark)}/{name}")

    def close(self) -> None:
        """Drop all runs."""
        self._drop([name for level in self.levels for name in level])
        self.levels = [[]]

    def owners(self) -> DataFrame:
        return _union(self.runs())


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def dropped(docs: DataFrame, batches: int = BATCHES, min_length: int = MIN_LENGTH, fanout: int = FANOUT) -> DataFrame:
    """(id, row, drop array<int>): the lines that documents lose, by place. row is the text's hash, for rows that share a doc_id.

    Documents go through the index in batches of ascending doc_id; the batches' bounds come from all ids. A key belongs to the
    document that brought it first, and every other document loses it.
    """
    spark = docs.sparkSession
    found = session.checkpoint(lines(docs, min_length))
    bounds = docs.select(F.percentile_approx(F.coalesce("doc_id", F.lit(_NULL_ID)), [i / batches for i in range(1, batches)], 1000).alias("b")).first()["b"] or []
    index = LineIndex(spark, fanout)
    low = None
    for high in [*sorted(set(bounds)), None]:
        batch = found
        if low is not None:
            batch = batch.where(F.col("id") > low)
        if high is not None:
            batch = batch.where(F.col("id") <= high)
        index.add(batch)
        low = high
    lost = found.join(index.owners(), ["h1", "h2"]).where("id > owner")
    lost = session.checkpoint(lost.groupBy("id", "row").agg(F.collect_set("at").alias("drop")))
    index.close()
    return lost


def apply(docs: DataFrame, lost: DataFrame) -> tuple[DataFrame, DataFrame]:
    """docs' rows that lose lines, cut, with `__lines` they had and `__dropped`; and docs' other rows as they are. Only the former (and a few more) move."""
    keyed = session.documents(docs).withColumn("__id", F.coalesce("doc_id", F.lit(_NULL_ID))).withColumn("__text", F.xxhash64("text"))
    lost = lost.withColumnRenamed("id", "__id").withColumnRenamed("row", "__text").withColumnRenamed("drop", "__drop")
    near, far = session.may_contain(keyed, "__id", lost)
    near = near.join(lost, ["__id", "__text"], "left").drop("__id", "__text")
    hit, miss = near.where("__drop is not null"), near.where("__drop is null").drop("__drop")
    names = docs.columns
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def cut(batches):
        for batch in batches:
            kept, sizes, gone = [], [], []
            for text, drop in zip(batch.column("text").to_pylist(), batch.column("__drop").to_pylist()):
                parts, drop = (text or "").split("\n"), set(drop)
                sizes.append(len(parts))
                gone.append(len(drop))
                kept.append("\n".join(p for i, p in enumerate(parts) if i not in drop))
            columns = [pa.array(kept, pa.string()) if n == "text" else batch.column(n) for n in names]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(sizes, pa.int64()), pa.array(gone, pa.int64())], [*names, "__lines", "__dropped"])

    return hit.select(*docs.columns, "__drop").mapInArrow(cut, f"{types}, __lines long, __dropped long"), far.drop("__id", "__text").unionByName(miss)


def dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without the lines whose key an earlier document has.

    docs needs doc_id and text; other columns stay. A key is a line stripped of ASCII white space at both ends, A-Z lower-cased;
    keys under min_length code points never go. Null texts stay null, empty ones empty. A null doc_id counts as smaller than
    any other; rows that share a doc_id are one document, whose own lines it keeps. A document may lose all lines: its text
    is then empty. Long texts are split whole, a row for each line; memory is one text.
    """
    hit, rest = apply(docs, dropped(docs, **options))
    return rest.unionByName(hit.drop("__lines", "__dropped"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    hit, rest = apply(docs, dropped(docs))
    text = F.coalesce(F.col("text"), F.lit(""))
    count = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    kept = F.sha2(text, 256)
    hit = hit.select("doc_id", F.col("__lines").alias("n_lines"), F.col("__dropped").alias("n_dropped"), kept.alias("kept_sha256"))
    return rest.select("doc_id", count.cast("long").alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"), kept.alias("kept_sha256")).unionByName(hit)


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents),
l AS (SELECT doc_id, generate_subscripts(parts, 1) AS place, unnest(parts) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                          'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
o AS (SELECT key, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.*, o.owner IS NOT NULL AND k.doc_id > o.owner AS gone FROM k LEFT JOIN o ON k.key = o.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
