from types import SimpleNamespace

from veinlode.llm import gru, lm_scoring


def test_copies_are_dealt_to_several_trainers(spark, monkeypatch, tmp_path):
    """A third and more of all rows are copies of one text; no task may train on all of them."""
    monkeypatch.setattr(lm_scoring, "TRAINER_TOKENS", 2000)
    monkeypatch.setattr(lm_scoring, "STREAM", 500)
    log, own = str(tmp_path), gru.train

    def noted(p, ids, end):
        import uuid

        with open(f"{log}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(len(ids)))
        return own(p, ids, end)

    # workers get this by value
    monkeypatch.setattr(lm_scoring, "gru", SimpleNamespace(train=noted, start=gru.start, pack=gru.pack, unpack=gru.unpack))
    copy = " ".join(f"c{i}" for i in range(50))
    rows = [(i, copy) for i in range(400)] + [(1000 + i, " ".join(f"w{i * j % 97}" for j in range(50))) for i in range(400)] + [(5000, "long " * 8000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    texts = docs.select("doc_id", "text")
    counts = lm_scoring.count_words(texts)
    vocab = lm_scoring.vocabulary(counts, len(rows))
    coded = lm_scoring.encoded(texts.withColumn("tk", lm_scoring._text_key()).select("doc_id", "tk", "text"), vocab)
    first = lm_scoring.train(coded, vocab)
    sizes = [int(f.read_text()) for f in tmp_path.iterdir()]
    assert sum(sizes) == 800 * 51 + 8001 and max(sizes) < 5500
    assert (first == lm_scoring.train(coded.repartition(3), vocab)).all()
