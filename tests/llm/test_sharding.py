import pytest

from veinlode.llm import sharding
from veinlode.llm.common import folder, shared_dir


@pytest.fixture
def store(spark, tmp_path):
    return sharding.ShardStore(spark, str(tmp_path / "store"), fan_in=3, target_bytes=4000, smallest_tier=20_000)


def _rows(spark, lo, hi):
    return spark.createDataFrame([(i if i % 7 else None, f"text {i}" if i % 5 else None, "r") for i in range(lo, hi)], "doc_id long, text string, run string")


def test_tiers_merge_and_keep_every_row(spark, store):
    for k in range(7):
        store.append(_rows(spark, k * 50, k * 50 + 50).unionAll(_rows(spark, 0, 1)), f"a{k}")
        before = store.manifest()
        assert before[0] == len(store.versions())
        store.compact()
    _, runs = store.manifest()
    assert len(runs) < 5 and sorted(a for r in runs for a in r.arrivals) == [f"a{k}" for k in range(7)]
    want = sorted(map(str, _rows(spark, 0, 350).collect() + _rows(spark, 0, 1).collect() * 7))
    assert sorted(map(str, store.read().select("doc_id", "text", "run").collect())) == want
    tiers = [r.tier for r in runs]
    assert all(tiers.count(t) < 3 for t in tiers)


def test_commit_is_exclusive(spark, store):
    assert store.commit(1, []) == 1
    with pytest.raises(sharding.ConflictError):
        store.commit(1, [sharding.Run("x", 1, 1, 0, ("a",))])
    assert store.manifest() == (1, [])
    fs, p = folder(spark, f"{store.root}/manifest")
    assert [s.getPath().getName() for s in fs.listStatus(p) if "draft" in s.getPath().getName() and not s.getPath().getName().endswith(".crc")] == []


def test_uncommitted_folder_is_not_read(spark, store):
    store.append(_rows(spark, 0, 10), "a")
    _rows(spark, 10, 20).write.parquet(f"{store.root}/runs/lost")
    assert store.read().count() == 10


def test_query(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    assert sorted(r.doc_id for r in got) == sorted(r.doc_id for r in docs.collect())
    assert len({r.run for r in got}) < sharding.ARRIVALS
    docs.where("false").write.parquet(str(tmp_path / "documents.parquet"))
    assert sharding.op10_sharding(spark, str(tmp_path)).collect() == []
    assert shared_dir(spark)
