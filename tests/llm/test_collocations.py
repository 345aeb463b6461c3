import duckdb
import pytest

from docpipe.llm import collocations
from docpipe.llm.queries import ORACLE


def oracle(rows, top):
    db = duckdb.connect()
    db.execute("CREATE TABLE documents (text VARCHAR, lang VARCHAR)")
    db.executemany("INSERT INTO documents VALUES (?, ?)", rows)
    sql = ORACLE["op13_collocations"].replace("rank <= 2000", f"rank <= {top}")
    return sorted(map(tuple, db.execute(f"SELECT lang, rank, phrase, a, l, r, n, score FROM ({sql})").fetchall()))


@pytest.fixture(scope="module")
def texts(make_prose):
    rows = []
    for k in range(60):
        rows.append((make_prose(k, 120) + ". New York City, new york! " + "big red dog; " * (k % 4), "en" if k % 3 else None))
    rows += [("Hot Hot Hot sun\tsun sun.\nHot hot hot", "de")] * 12 + [(None, "en"), ("", "de"), ("a", None)]
    return rows


@pytest.mark.parametrize("rate", [1.0, 0.05, 0.0])
def test_equals_sql_whatever_the_sample(spark, texts, rate):
    docs = spark.createDataFrame(texts, "text string, lang string").withColumn("phrase", __import__("pyspark.sql.functions").sql.functions.lit("x"))
    got = collocations.collocations(docs, top=50, rate=rate).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
    assert sorted(map(tuple, got.collect())) == oracle(texts, 50)


def test_sample_failures_trigger_passes(spark, texts):
    docs = spark.createDataFrame(texts, "text string, lang string")
    pieces = collocations.word_pieces(docs)
    *_, none = collocations.frequent_phrases(pieces, rate=0.0)
    *_, full = collocations.frequent_phrases(pieces, rate=1.0)
    assert none > 1 and full == 1  # rate 0: every frequent bigram is a failure


def test_empty(spark):
    docs = spark.createDataFrame([], "text string, lang string")
    assert collocations.collocations(docs).count() == 0
