"""Every query of the library against its SQL, on the smallest tables."""

import glob
import os

import duckdb
import pytest

from skein.plans import catalogue

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for path in glob.glob(f"{FOLDER}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


@pytest.mark.parametrize("name", sorted(catalogue.QUERIES))
def test_query(spark, duck, tmp_path, name):
    out = str(tmp_path / "out")
    catalogue.QUERIES[name](spark, FOLDER).write.parquet(out)
    if name not in catalogue.ORACLE_SQL:
        assert spark.read.parquet(out).columns
        return
    duck.execute(f"CREATE OR REPLACE TABLE want AS {catalogue.ORACLE_SQL[name]}")
    names = [c[0] for c in duck.execute("DESCRIBE want").fetchall()]
    duck.execute(f"CREATE OR REPLACE TABLE got AS SELECT {', '.join(names)} FROM '{out}/*.parquet'")
    assert sorted(names) == sorted(spark.read.parquet(out).columns)
    for a, b in (("got", "want"), ("want", "got")):
        assert duck.execute(f"SELECT * FROM {a} EXCEPT ALL SELECT * FROM {b} LIMIT 3").fetchall() == []
