"""Columns of the input whose names are those of the operators' own, very long texts, and empty tables."""

import corpus_pipeline
from veinlode.llm import langid, mixing, pieces, sharding

LONG = "one two three four five six seven eight nine ten " * 40_000


def _docs(spark, *names, text="the one and the other one here"):
    return spark.createDataFrame([(1, text, "en", "s", *range(len(names)))], ["doc_id", "text", "lang", "source", *names])


def test_mixing(spark):
    docs = _docs(spark, "size", "copies", "mix_size", "hash", "n", "a.b", "mix_copy")
    out = mixing.mix(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "size", "copies", "mix_size", "hash", "n", "a.b", "mix_copy"]
    assert all((r.size, r.copies, r.mix_size, r.hash, r.n, r["a.b"]) == (0, 1, 2, 3, 4, 5) for r in out.collect())
    (row,) = mixing.mixing_plan(_docs(spark, text=LONG)).collect()
    assert row.size == 400_000


def test_mixing_draws_rows_one_by_one(spark):
    rows = [(7, "w w w w w", "a")] * 400 + [(7, f"w w w w w{i}", "a") for i in range(400)] + [(None, "x x x x x", "b")] * 400
    plan = mixing.mixing_plan(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    for source in "ab":
        own = [r for r in plan if r.source == source]
        assert abs(sum(r.copies * r.size for r in own) - own[0].target) < 0.1 * own[0].target
    again = mixing.mixing_plan(spark.createDataFrame(rows[::-1], "doc_id long, text string, source string").repartition(3)).collect()
    assert sorted(map(str, plan)) == sorted(map(str, again))


def test_many_sources(spark):
    rows = [(i, "w " * (i % 13), f"host{i % 997}" if i % 997 else None) for i in range(5000)]
    sizes = spark.createDataFrame(rows, "doc_id long, text string, source string").groupBy("source").agg(mixing.F.sum(mixing.words(mixing.F.col("text"))).alias("source_size"))
    got = {r.source: r for r in mixing.targets(sizes).collect()}
    from tests.llm.test_mixing import _waterfill

    want = _waterfill({s: r.source_size for s, r in got.items()})
    assert all(abs(r.target - want[s]) < 1e-6 * max(1, want[s]) for s, r in got.items())


def test_pieces(spark):
    docs = _docs(spark, "piece_ids", "decoded", "a.b")
    encoded = pieces.encode(docs)
    assert encoded.columns == ["doc_id", "text", "lang", "source", "decoded", "a.b", "piece_ids"]
    (row,) = pieces.decode(encoded).collect()
    assert row.decoded == row.text and row.asDict().keys() == {"doc_id", "text", "lang", "source", "a.b", "piece_ids", "decoded"}


def test_pieces_in_a_long_chunk():
    codec = pieces.Codec(pieces.load(), 0.0)
    chunk = "ab" * 40
    assert codec.decode(codec.segment(chunk)) == chunk


def test_sharding(spark, tmp_path):
    store = sharding.ShardStore(spark, str(tmp_path / "store"), fan_in=2)
    rows = _docs(spark, "_metadata", "_shard_run", "arrival", "_shard_arrival")
    for name in "ab":
        store.append(rows, name)
    store.compact()
    got = store.read().collect()
    assert len(got) == 2 and all((r["_metadata"], r["arrival"], r["_shard_arrival"], r["_shard_run"]) == (0, 2, 3, "a+b") for r in got)
    store.append(_docs(spark, text=LONG), "c")
    assert max(len(r.text) for r in store.read().collect()) == len(LONG)


def test_query_of_sharding_keeps_every_row(spark):
    docs = {r.doc_id: len((r.text or "").encode()) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    got = sharding.op10_sharding(spark, "/root/testdata/sf0.001").collect()
    assert {r.doc_id: r.n_bytes or 0 for r in got} == docs and len(got) == len(docs)
    assert {r.version for r in got} == {got[0].version}


def test_language_id(spark):
    model = langid.train(_docs(spark).union(_docs(spark, text="der eine und der andere").withColumn("lang", mixing.F.lit("de"))))
    out = langid.identify(_docs(spark, "lid_score", "a.b"), model)
    assert out.columns == ["doc_id", "text", "lang", "source", "a.b", "lid_pred", "lid_score", "lid_ambiguous"] and out.first().lid_score > 0


def test_pipeline_stages(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(40)
    docs = docs.withColumns({"a.b": mixing.F.lit(1), "lid_pred": mixing.F.lit("x"), "raw": mixing.F.lit(2), "mix_copy": mixing.F.lit(3)})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, "")
        assert docs.columns[-4:] == ["a.b", "lid_pred", "raw", "mix_copy"]
    row = docs.first()
    assert (row["a.b"], row.lid_pred, row.raw, row.mix_copy) == (1, "x", 2, 3)
    assert corpus_pipeline.STAGES[-1][1](spark, docs, "").first().lossless


def test_empty_pipeline(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").where("false")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    nulls = spark.createDataFrame([(None, None, None, None, None)] * 2 + [(1, "", "en", "s", 0)], "doc_id long, text string, lang string, source string, n_chars long")
    nulls.write.parquet(str(tmp_path / "n" / "documents.parquet"))
    assert all(r.lossless for r in corpus_pipeline.run(spark, str(tmp_path / "n")).collect())
