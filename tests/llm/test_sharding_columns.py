from veinlode.llm.sharding import ShardStore


def test_arrivals_with_other_columns_and_old_versions(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path / "store"), fan_in=2)
    store.append(spark.createDataFrame([(1, "a")], "doc_id long, text string"), "one")
    before = store.append(spark.createDataFrame([(2, "b", "x")], "doc_id long, text string, more string"), "two")
    assert store.compact() > before
    for version in (before, None):
        got = store.read(version).select("doc_id", "text", "more").collect()
        assert sorted(map(tuple, got)) == [(1, "a", None), (2, "b", "x")]
