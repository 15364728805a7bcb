import random

from tests.llm.test_ngram_join import _edited
from veinlode.llm import ngram_join


def test_links_are_counted_whole(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "CHUNK", 20)  # several blocks a class
    rng = random.Random(6)
    hot = [f"h{i}" for i in range(120)]
    texts = [" ".join(_edited(hot, rng, 0.008)) for _ in range(90)] + [" ".join(hot)] * 5
    chain = [f"c{i}" for i in range(200)]
    texts += [" ".join(chain[i * 6 :] + [f"d{j}" for j in range(i * 6)]) for i in range(12)]
    texts += ["one two", "one two", "", None]
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.n_links for r in ngram_join.near_duplicates(docs).collect()}
    sets = {t: set(ngram_join.shingles(ngram_join.tokens(t)).tolist()) for t in texts}
    want = {i: sum(u != t and bool(s) and len(s & sets[t]) >= 0.8 * len(s | sets[t]) for u, s in sets.items()) for i, t in rows}
    assert got == want and max(want.values()) > 20 and want[0] > 1
