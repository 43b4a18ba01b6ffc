"""Readers with explicit schemas. All paths go to Spark, so any store that Spark reads will do."""

from __future__ import annotations

import tomllib
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from skein import schema
from skein.functions import text as texts


def read_csv(spark: SparkSession, path: str, columns: str | None = None, index_column: bool = False) -> DataFrame:
    """CSV with a header. Without `columns` all are strings. index_column: the first, unnamed column goes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("escape", '"')
    df = reader.schema(columns).csv(path) if columns and not index_column else reader.csv(path)
    if index_column:
        df = df.drop(df.columns[0])
        if columns:
            kinds = spark.createDataFrame([], columns).schema
            df = df.select(*[F.col(f.name).try_cast(f.dataType).alias(f.name) for f in kinds])
    return df


def read_json_lines(spark: SparkSession, path: str, columns: str, **renamed: str) -> DataFrame:
    """NDJSON; renamed: new=old."""
    df = spark.read.schema(columns).json(path)
    for new, old in renamed.items():
        df = df.withColumnRenamed(old, new)
    return df


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, abstract, fulltext) by the path's suffix: CSV with an index column, or JSON lines whose full text is `body`."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return read_csv(spark, path, schema.DOCUMENT, index_column=True)
    if kind in ("json", "jsonl", "ndjson"):
        return read_json_lines(spark, path, "doc_id bigint, abstract string, body string", fulltext="body")
    if kind == "parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of file: {path}")


def document_text(abstract: Column, fulltext: Column) -> Column:
    return texts.joined_text(abstract, fulltext)


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """(term): distinct stripped lines."""
    return spark.read.text(path).select(F.trim("value").alias("term")).where("term <> ''").distinct()


def read_keys(spark: SparkSession, path: str, field: str = "data", skip: int = 1) -> DataFrame:
    """(key): the keys of a JSON object's map in order, without the first `skip`."""
    whole = spark.read.text(path, wholetext=True)
    data = F.json_object_keys(F.get_json_object("value", f"$.{field}"))
    return whole.select(F.explode(F.slice(data, F.lit(skip + 1), F.greatest(F.lit(0), F.size(data) - skip))).alias("key"))


def read_database(spark: SparkSession, url: str, table: str, user: str, password: str, **options: str) -> DataFrame:
    return spark.read.format("jdbc").options(url=url, dbtable=table, user=user, password=password, **options).load()


def read_articles(spark: SparkSession, path: str, row_tag: str, columns: str) -> DataFrame:
    """Elements `row_tag` of XML files."""
    return spark.read.format("xml").option("rowTag", row_tag).schema(columns).load(path)


def read_config(text: str) -> dict:
    return tomllib.loads(text)


def read_split(df: DataFrame, noise: DataFrame, counts: dict[str, int], seed: int = 42) -> DataFrame:
    """df (with `split`) and, for each split, `counts[split]` noise documents in hash order, none in two splits; `noise` is true for those."""
    from skein.operators import sampling

    total = sum(counts.values())
    rows = noise.withColumn("__h", sampling.hash_order("doc_id", seed)).orderBy("__h", "doc_id").limit(total)
    rows = sampling.batches(rows.drop("__h"), "doc_id", max(1, total), seed)
    split, low = F.lit(None).cast("string"), 0
    for name, n in counts.items():
        split = F.when((F.col("slot") >= low) & (F.col("slot") < low + n), F.lit(name)).otherwise(split)
        low += n
    rows = rows.withColumn("split", split).drop("batch", "slot")
    return df.withColumn("noise", F.lit(False)).unionByName(rows.withColumn("noise", F.lit(True)), allowMissingColumns=True)


class _Table(HTMLParser):
    def __init__(self, row_prefix: str):
        super().__init__(convert_charrefs=True)
        self.prefix, self.rows, self.row, self.cell, self.depth = row_prefix, {}, None, None, 0

    def handle_starttag(self, tag, attrs):
        name = dict(attrs).get("id") or ""
        if self.prefix in name and "c" in name.rsplit("r", 1)[-1] and name.rsplit("c", 1)[-1].isdigit():
            self.row, self.cell = name.rsplit("c", 1)[0], int(name.rsplit("c", 1)[-1])
            self.rows.setdefault(self.row, {})[self.cell] = ""
            self.depth = 0
        if self.cell is not None:
            self.depth += 1

    def handle_endtag(self, tag):
        if self.cell is not None:
            self.depth -= 1
            if self.depth <= 0:
                self.cell = None

    def handle_data(self, data):
        if self.cell is not None:
            self.rows[self.row][self.cell] += data


def table_rows(html: Column, row_prefix: str) -> Column:
    """array<array<string>>: the rows of tables whose cells have ids `<row_prefix><row>...c<column>`, missing cells empty."""

    def cells(page):
        parser = _Table(row_prefix)
        parser.feed(page or "")
        return [[row.get(i, "").strip() for i in range(max(row) + 1)] for row in parser.rows.values()]

    @F.arrow_udf(ArrayType(ArrayType(StringType())))
    def rows(pages: pa.Array) -> pa.Array:
        return pa.array([cells(page) for page in pages.to_pylist()], pa.list_(pa.list_(pa.string())))

    return rows(html)


def references(pages: DataFrame, key: str, html: str, row_prefix: str, fields=(0, 7, 8)) -> DataFrame:
    """(key, reference, organism, pubmed_id): a row for each organism of a comma list in a scraped table."""
    rows = pages.select(key, F.explode(table_rows(F.col(html), row_prefix)).alias("cells"))
    cell = lambda i: F.coalesce(F.get(F.col("cells"), F.lit(i)), F.lit(""))
    return rows.select(key, cell(fields[0]).alias("reference"), F.explode(texts.split_trimmed(cell(fields[1]))).alias("organism"), cell(fields[2]).alias("pubmed_id"))


def summaries(df: DataFrame, column: str) -> DataFrame:
    """(id, fields map<string, string>) from XML results of one or many records; error results give no rows."""
    item = StructType([StructField("_Name", StringType()), StructField("_VALUE", StringType())])
    nested = StructType([StructField("_Name", StringType()), StructField("_VALUE", StringType()), StructField("Item", ArrayType(item))])
    record = StructType([StructField("Id", StringType()), StructField("Item", ArrayType(nested))])
    result = StructType([StructField("DocSum", ArrayType(record)), StructField("ERROR", StringType())])
    rows = df.select(F.explode(F.from_xml(F.col(column), result)["DocSum"]).alias("r"))
    named = lambda i: F.struct(i["_Name"].alias("name"), i["_VALUE"].alias("text"), F.transform(i["Item"], lambda j: F.struct(j["_Name"].alias("name"), j["_VALUE"].alias("text"))).alias("items"))
    return rows.select(F.col("r.Id").alias("id"), texts.flat_fields(F.transform("r.Item", named)).alias("fields"))
