"""Every registered query against its SQL on the small tables."""

import duckdb
import pandas as pd
import pytest

from __spark_entry__ import entry
from docpipe.plans.catalog import QUERIES
from docpipe.plans.oracle import ORACLE

SF = "/root/testdata/sf0.001"
NO_SQL = {"pretoken_windows", "kmeans_cells"}
TABLES = ["events", "documents", "embeddings", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def normal(frame):
    frame = frame[sorted(frame.columns)]
    rows = [tuple(None if v is pd.NA or v != v else v for v in r) for r in frame.astype(object).values.tolist()]
    return list(frame.columns), sorted(rows, key=repr)


def test_registries_agree():
    assert set(QUERIES) - set(ORACLE) == NO_SQL
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, db, name):
    got = QUERIES[name](spark, SF).toPandas()
    assert len(got) > 0
    if name not in NO_SQL:
        assert normal(got) == normal(db.execute(ORACLE[name]).df())


def test_entry(spark):
    assert entry(spark).count() == 200
