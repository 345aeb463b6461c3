import os

from pyspark.sql import types as T

from docpipe.streaming.cell_table import CellTable

SCHEMA = T.StructType([T.StructField("key", T.LongType()), T.StructField("url", T.StringType()),
                       T.StructField("version", T.LongType()), T.StructField("x", T.DoubleType()), T.StructField("cell", T.IntegerType())])


def rows_of(table, spark):
    return sorted(tuple(r) for r in table.read(spark).select("key", "url", "version", "x", "cell").collect())


def files_of(path, cell):
    folder = os.path.join(path, f"cell={cell}")
    return sorted(f for f in os.listdir(folder) if f.endswith(".parquet")) if os.path.isdir(folder) else []


def test_touched_cells_only_and_moves(spark, tmp_path):
    path = str(tmp_path / "t")
    table = CellTable(path, SCHEMA, key="key")
    first = [(1, "a", 1, 0.1, 0), (2, "a", 1, 0.2, 0), (3, "b", 1, 0.3, 1), (4, "c", 1, 0.4, 2)]
    table.apply(spark.createDataFrame(first, SCHEMA), 0)
    assert rows_of(table, spark) == sorted(first)
    untouched = files_of(path, 2)
    # page a moves wholly to cell 1 with one chunk fewer; cell 0 is left empty
    second = [(1, "a", 2, 1.1, 1)]
    table.apply(spark.createDataFrame(second, SCHEMA), 1)
    want = sorted([(1, "a", 2, 1.1, 1), (3, "b", 1, 0.3, 1), (4, "c", 1, 0.4, 2)])
    assert rows_of(table, spark) == want
    assert files_of(path, 2) == untouched
    # a retry of the same batch, and an older version arriving late, change nothing
    table.apply(spark.createDataFrame(second, SCHEMA), 1)
    table.apply(spark.createDataFrame([(2, "a", 1, 0.2, 0)], SCHEMA), 2)
    assert rows_of(table, spark) == want


def test_repeated_keys_and_empty_batch(spark, tmp_path):
    table = CellTable(str(tmp_path / "t"), SCHEMA, key="key")
    table.apply(spark.createDataFrame([], SCHEMA), 0)
    assert table.read(spark).count() == 0
    table.apply(spark.createDataFrame([(1, "a", 1, 0.1, 0), (1, "a", 1, 0.1, 0), (1, "a", 3, 0.5, 1)], SCHEMA), 1)
    assert rows_of(table, spark) == [(1, "a", 3, 0.5, 1)]
