from docpipe.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.languages(docs).where("held_out").join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert sum(r.lang == r.lang_pred for r in got) / len(got) > 0.95
    assert all(0 <= r.score <= 1 for r in got)


def test_odd_texts(odd_documents, no_documents):
    models = language_id.dictionaries(odd_documents)
    assert set(models) == {"en", "de"}
    got = language_id.identify(odd_documents, models).collect()
    assert len(got) == odd_documents.count()
    assert {r.doc_id: (r.lang_pred, r.score) for r in got if r.doc_id in (4, 5, 6, 11)} == dict.fromkeys((4, 5, 6, 11), ("und", 0.0))
    assert {r.lang_pred for r in got if r.doc_id in (7, 8)} == {"en"}
    assert language_id.languages(odd_documents).count() == len(got)
    assert language_id.languages(no_documents).count() == 0


def test_no_labels_give_und_and_ties_go_to_the_first(spark, odd_documents):
    from pyspark.sql import functions as F

    none = odd_documents.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in language_id.languages(none).collect()} == {"und"}
    same = {"b": b"the same words", "a": b"the same words"}
    got = language_id.identify(spark.createDataFrame([(1, "the same words")], "doc_id int, text string"), same).first()
    assert (got.lang_pred, got.confident) == ("a", False)


def test_copies_and_texts_without_letters_take_no_place(spark):
    """One text holds a third of a language and comes first by its hash; every different text is in the dictionary all the same."""
    from pyspark.sql import functions as F

    words = [("en", f"word{chr(97 + i % 26)}{chr(97 + i // 26)} stays") for i in range(40)]
    docs = spark.createDataFrame(words, "lang string, text string")
    hot = docs.orderBy(F.xxhash64("text")).first().text
    odd = [("en", t) for t in ("", " \n", "12 34", "?!")] * 30
    docs = docs.union(spark.createDataFrame([("en", hot)] * 20 + odd, docs.schema)).repartition(3)
    letters = {language_id.letters(text) for _, text in words}
    whole = language_id.dictionaries(docs, docs=40)["en"].decode()
    assert all(x in whole for x in letters) and len(whole) == sum(map(len, letters)) + 39
    part = language_id.dictionaries(docs, docs=10)["en"].decode()
    assert sum(x in part for x in letters) == 10
    # Long texts that differ outside the piece taken count once, pieces without a letter not at all.
    long = [("en", f"{a}{'x' * 50}{a}") for a in "abc"] + [("en", f"head {'1' * 50} tail"), ("en", "yy")]
    got = language_id.dictionaries(spark.createDataFrame(long, docs.schema), docs=2, chars=10)
    assert got["en"].decode() == f"{'x' * 10} yy"
