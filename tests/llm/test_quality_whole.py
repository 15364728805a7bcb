import pytest

from tests.llm import test_quality
from veinlode.llm import quality


def test_all_labels_are_learned_from(spark, tmp_path, monkeypatch):
    """Counts and threshold of all labelled documents, however small a sample would be."""
    monkeypatch.setattr(quality.sample, "__defaults__", (0,))
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)] + [(5, 1, 0), (201, 0, 0)]
    test_quality._check(spark, tmp_path, labels)


@pytest.mark.parametrize("percent", [1, 50, 100])
def test_ranks(spark, monkeypatch, percent):
    monkeypatch.setattr(quality, "RANGE", 50)
    values = [(k * 7919 % 1009 - 500, k % 3 == 0) for k in range(700)] + [(None, True)] * 5
    frame = spark.createDataFrame(values, "s long, own boolean")
    own = sorted(s for s, o in values if o and s is not None)
    assert quality._at(frame, "own", percent) == own[-(-percent * len(own) // 100) - 1]
    assert quality._at(frame.where("not own"), "own", percent) is None


def test_texts_are_scored_once_and_dealt_by_id_at_any_size(spark, monkeypatch):
    """Few labels are no other plan than many, and the threshold needs no text."""
    docs = spark.createDataFrame([(i, f"w{i % 7} x{i % 3} " * 20) for i in range(40)] + [(None, "w1 x1")], "doc_id long, text string")
    labels = spark.createDataFrame([(i,) for i in range(0, 40, 3)], "doc_id long")
    plan = quality._marked(docs, labels, "own")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "BroadcastHashJoin" not in plan
    values = quality.weights(docs, labels)
    scores = quality.measured(docs, values).select("doc_id", "qr_score")
    good = sorted(r.qr_score for r in scores.collect() if r.doc_id is not None and r.doc_id % 3 == 0)
    low, middle = good[-(-len(good) // 100) - 1], good[-(-len(good) // 2) - 1]
    assert quality.threshold(scores, labels, labels.where("false")) == 2 * low - middle
