from collections import Counter

from test_mixing import plain_targets
from test_secrets import plain as plain_spans
from test_shingle_join import plain as plain_classes
from tokenizers import Tokenizer

import corpus_pipeline
from docpipe.llm import bpe, mixing, quality
from docpipe.llm.common import connected_components

SF = "/root/testdata/sf0.001"


def redacted(text):
    out, at = "", 0
    for kind, start, end in plain_spans(text):
        if start >= at:
            out += text[at:start] + f"[{kind}]"
        at = max(at, end)
    return out + text[at:]


def test_stages_equal_plain_versions(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality", "near duplicates", "secret scan", "mixing sources", "bpe encoding"]

    good = stages["quality"](spark, docs, SF)
    wanted = {r.doc_id for r in quality.graded(docs, labels).collect() if r.predicted == 1}
    assert {r.doc_id for r in good.collect()} == wanted and good.columns == docs.columns

    single = stages["near duplicates"](spark, good, SF).collect()
    parts = plain_classes([(r.doc_id, r.text) for r in good.collect()])
    assert sorted(r.doc_id for r in single) == sorted({c for _, c in parts.values()})

    single = spark.createDataFrame(single, docs.schema)
    clean = stages["secret scan"](spark, single, SF).collect()
    assert len(clean) == single.count() and all(r.n_chars == len(r.text) for r in clean)
    assert all(r.text == redacted(rows[r.doc_id].text) for r in clean)

    clean = spark.createDataFrame(clean, docs.schema)
    mixed = Counter(r.doc_id for r in stages["mixing sources"](spark, clean, SF).collect())
    want = {r.doc_id: r.taken // r["size"] for r in mixing.mixture(clean, labels).collect() if r.taken}
    assert mixed == want
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in clean.collect():
        n = len(r.text.encode().split())
        sizes[r.source] += n
        taken[r.source] += n * mixed[r.doc_id]
        largest[r.source] = max(largest[r.source], n)
    assert all(abs(taken[s] - t) <= largest[s] / 2 + 1 for s, t in plain_targets(sizes).items())

    coded = stages["bpe encoding"](spark, clean, SF).collect()
    library = Tokenizer.from_file(bpe.default_path())
    texts = {r.doc_id: r.text for r in clean.collect()}
    for r in coded:
        assert r.ids == library.encode(texts[r.doc_id], add_special_tokens=False).ids and len(r.ids) == r.n_tokens


def test_run(spark):
    rows = corpus_pipeline.run(spark, SF).collect()
    assert rows and max(Counter(r.doc_id for r in rows).values()) <= 3


def test_odd_rows(spark, odd_documents, no_documents):
    for docs in (odd_documents, no_documents):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SF)
            assert out.count() >= (1 if docs is odd_documents else 0), name
    kept = [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, odd_documents, SF).collect()]
    assert sorted(k for k in kept if k is not None) == [1, 4, 5, 6, 7, 9, 11] and kept.count(None) == 2


def test_components_of_a_chain_and_a_star(spark):
    chain = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 40)] + [(500, 500), (None, 3), (7, None)]
    got = {r.id: r.component for r in connected_components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert got == {**{i: 100 for i in range(100, 161)}, **dict.fromkeys(range(40), 0)}
    assert connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0
