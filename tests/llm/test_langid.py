import zlib

import numpy as np

from veinlode.llm import langid

SF = "/root/testdata/sf0.01"


def test_codewords():
    for n in (2, 3, 4, 5, 6, 9, 30):
        code = langid.codewords(n)
        dist = [(a != b).sum() for i, a in enumerate(code) for b in code[:i]]
        assert min(dist) >= (1 if n == 2 else code.shape[1] // 4)
        assert all(len(set(col)) == 2 for col in code.T)


def test_counts_of_grams():
    x = langid.ngram_counts(b"Ab, 12 c")
    assert x.sum() == 4 + 3 + 2 and langid.ngram_counts(b"").sum() == 0  # "ab c" with runs of blanks as one
    assert (langid.ngram_counts(b"ab  c") == langid.ngram_counts(b"AB;c")).all()


def test_held_out_accuracy(spark):
    rows = langid.op8_langid(spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    right = np.mean([r.lang_pred == docs[r.doc_id].lang for r in held])
    assert right > 0.97 and all(0 <= r.score <= 1 for r in rows)


def test_edge_cases(spark):
    schema = "doc_id long, text string, lang string, lid string"
    rows = [(1, None, "x", "a"), (2, "", None, "b"), (None, "12 .,", "x", None), (3, "aaa bbb", "x", None), (3, "aaa bbb", "x", None), (4, "zzz yyy " * 30000, "y", None)]
    docs = spark.createDataFrame(rows, schema)
    model = langid.train(docs)
    assert model.langs == ["x", "y"]
    got = {(r.doc_id, r.text): r.lid_pred for r in langid.identify(docs, model).collect()}
    assert got[(1, None)] == got[(2, "")] == got[(None, "12 .,")] == "und"
    assert got[(3, "aaa bbb")] == "x" and got[(4, "zzz yyy " * 30000)] == "y"
    none = langid.train(docs.where("false"))
    assert {r.lid_pred for r in langid.identify(docs, none).collect()} == {"und"}
    one = langid.train(docs.where("lang = 'x'"))
    assert {r.lid_score for r in langid.identify(docs, one).where("lid_pred = 'x'").collect()} == {1.0}
    assert langid.identify(docs.where("false"), model).count() == 0
