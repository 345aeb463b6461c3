from docpipe.sources.bucketed_state import BucketedSeen


def test_lookup_reads_the_base_in_place_and_folds_bound_the_log(spark, tmp_path):
    seen = BucketedSeen(str(tmp_path / "seen"), buckets=4, fold_every=3)
    for batch in range(7):
        rows = [(f"u{k}", f"h{batch}-{k}") for k in range(batch * 5, batch * 5 + 10)]
        seen.write(spark.createDataFrame(rows, "url string, content_hash string"), batch)
    state = {r.url: r.content_hash for r in seen.read(spark).collect()}
    want = {}
    for batch in range(7):
        want.update({f"u{k}": f"h{batch}-{k}" for k in range(batch * 5, batch * 5 + 10)})
    assert state == want
    assert seen.base.committed(spark) == [2, 5]
    assert seen.log.committed(spark, after=5) == [6]
    urls = spark.createDataFrame([("u1",), ("u33",), ("nope",)], "url string")
    looked = seen.read(spark, urls=urls)
    assert {r.url: r.content_hash for r in looked.collect()} == {"u1": want["u1"], "u33": want["u33"]}
    plan = looked._jdf.queryExecution().executedPlan().treeString()
    lines = plan.splitlines()
    at = next(k for k, line in enumerate(lines) if "FileScan" in line and seen.prefix in line)
    assert "Bucketed: true" in lines[at]
    join = max(k for k in range(at) if "Join" in lines[k])
    assert not any("Exchange" in line for line in lines[join:at])


def test_a_fold_again_changes_nothing(spark, tmp_path):
    seen = BucketedSeen(str(tmp_path / "seen"), buckets=2, fold_every=1)
    seen.write(spark.createDataFrame([("a", "1")], "url string, content_hash string"), 0)
    seen.fold(spark, 0)
    assert [tuple(r) for r in seen.read(spark).collect()] == [("a", "1")]
