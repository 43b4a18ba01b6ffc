"""Corpus pipeline over `documents`: quality rules, line dedup, n-gram Jaccard join, mixing, packing.

Each stage takes (spark, docs, sf_dir), with docs what its predecessor kept, and returns a DataFrame that is written as Parquet
and read again for the next. All but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm import op02_mixing, op03_jaccard_join, op05_quality, op09_line_dedup, op10_packing, session


#: The same executors run all stages and keep what each made them take, so batches are smaller than where an operator runs alone, in Arrow and
#: in what a scan of Parquet decodes at once.
BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": 500, "spark.sql.execution.arrow.maxBytesPerBatch": 2 << 20, "spark.sql.parquet.columnarReaderBatchSize": 512}


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base rules and the model keep. The model is fitted on the labelled rows among docs."""
    docs = session.documents(docs, BATCH)
    model = op05_quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return op05_quality.judge(docs, model, prefix="__").where("__kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs without lines that an earlier document has; n_chars follows the text. A document left without a word goes: nothing of it is new."""
    out = op09_line_dedup.dedup(session.documents(docs, BATCH)).withColumn("n_chars", F.length("text").cast("long"))
    return out.where(F.col("text").rlike(op02_mixing.WORD)).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of 5-word shingles at a similarity of 0.8: that of the smallest doc_id. Rows that share it stay with it."""
    joined = op03_jaccard_join.join(session.documents(docs, BATCH), k=5, percent=80)
    gone = session.checkpoint(joined.where("doc_id <> component_id").select("doc_id").distinct())
    near, far = session.may_contain(docs, "doc_id", gone)
    return far.unionByName(near.join(gone, "doc_id", "left_anti").select(*docs.columns))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """docs at their sources' target weights: a row for each epoch in which a document is taken."""
    return op02_mixing.mixed(session.documents(docs, BATCH))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of docs in sequences of 4096 tokens, with their ids. Workers that ran the stages before have less memory left: smaller slices and cache."""
    import public_tokenizers

    return op10_packing.pack(session.documents(docs, BATCH), public_tokenizers.path("word_bpe_49k.json"), ids=True, slices=1 << 20, cache=150_000)


STAGES = [("quality rules", quality_rules), ("line dedup", line_dedup), ("n-gram Jaccard join", near_duplicates), ("mixing", mixing), ("packing", packing)]

#: The model of the first stage and the tokenizer of the last can't be said in SQL; tests hold run() against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (_, stage) in enumerate(STAGES):
        path = session.new_path(spark, f"stage{number}")
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            session.remove(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
