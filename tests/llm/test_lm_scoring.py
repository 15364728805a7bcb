import math
import zlib
from collections import Counter

import numpy as np
import pytest

from veinlode.llm import gru, lm_scoring

SF = "/root/testdata/sf0.01"


def test_gradients():
    rng = np.random.default_rng(0)
    p = {k: v.astype(float) for k, v in gru.start(np.ones(12), 4, embed=5, hidden=6).items()}
    x, y, h = rng.integers(0, 12, (5, 3)), rng.integers(0, 12, (5, 3)), rng.standard_normal((6, 3)) * 0.1
    grads = gru.window(p, x, y, h, 0)[2]
    for k in p:
        for _ in range(4):
            i = (int(rng.choice(x.ravel())), int(rng.integers(0, 5))) if k == "emb" else tuple(rng.integers(0, s) for s in p[k].shape)
            old = p[k][i]
            p[k][i] = old + 1e-4
            up = gru.window(p, x, y, h, 0)[0]
            p[k][i] = old - 1e-4
            down = gru.window(p, x, y, h, 0)[0]
            p[k][i] = old
            assert grads[k][i] == pytest.approx((up - down) / 2e-4, rel=1e-3, abs=1e-7)


def test_scores_are_probabilities_and_carry_state():
    p = gru.start(np.arange(12)[::-1].copy(), 4, embed=5, hidden=6)
    texts = [np.array([a, b]) for a in range(1, 12) for b in range(12)]  # id 0 is the end
    assert np.exp(gru.score(p, texts, 0)).sum() + np.exp(gru.score(p, [np.array([0])], 0))[0] == pytest.approx(1, rel=1e-4)
    rng = np.random.default_rng(3)
    many = [np.append(rng.integers(1, 12, n), 0) for n in (0, 1, 5, 63, 64, 65, 200, 500)]
    one = gru.score(p, many, 0, lanes=3, steps=7)
    assert one == pytest.approx(gru.score(p, many, 0), rel=1e-5)
    for text, got in zip(many, one):
        h, total = np.zeros((6, 1), np.float32), 0.0
        for x, y in zip(np.append(0, text[:-1]), text):
            loss, h, _ = gru.window(p, np.array([[x]]), np.array([[y]]), h, 0)
            total -= loss
        assert got == pytest.approx(total, rel=1e-4)


def test_learns_an_order():
    ids = np.tile([1, 5, 9, 2, 7, 0], 20000)
    start = gru.start(np.bincount(ids, minlength=12), 4, embed=5, hidden=8)
    end = gru.train(start, ids, 0, lanes=16)
    text = [ids[:60]]
    assert gru.score(end, text, 0)[0] > -0.25 * 60 and gru.score(start, text, 0)[0] < -1.5 * 60


def test_query_against_brute_force(spark):
    got = {r.doc_id: r for r in lm_scoring.op2_lm_scoring(spark, SF).collect()}
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    words = {d.doc_id: lm_scoring.tokens(d.text) for d in docs}
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in words}
    c = Counter(w for i, ws in words.items() if not held[i] for w in ws)
    n_train = sum(not h for h in held.values())
    n, v = sum(c.values()) + n_train, len(c) + 1
    assert len(got) == len(docs)
    gain = []
    for i, ws in words.items():
        r = got[i]
        counts = [c[w] for w in ws] + [n_train]
        base = sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in counts)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(counts), sum(x > 0 for x in counts), n)
        assert r.base_score == pytest.approx(base, rel=1e-9)
        assert r.score < 0
        if held[i]:
            gain.append((r.score - r.base_score) / r.n_tokens)
    assert np.mean(gain) > 0.1  # log10 per token on texts that were not learned from


def test_edge_cases(spark, monkeypatch):
    monkeypatch.setattr(lm_scoring, "KEPT", 3)
    rows = [(1, None), (2, ""), (3, "b a B"), (3, "b a B"), (None, "unseen é" * 3), (9, "word " * 30000)]
    docs = spark.createDataFrame([(*r, 5) for r in rows], "doc_id long, text string, known int")
    is_training = lm_scoring.F.col("doc_id").isNotNull() & (lm_scoring.F.col("doc_id") < 9)
    got = {r.doc_id: r for r in lm_scoring.lm_scores(docs, lm_scoring.F.coalesce(is_training, lm_scoring.F.lit(False))).collect()}
    assert (got[3].n_tokens, got[3].n_known, got[3].train_tokens) == (4, 4, 10)
    assert got[1].score == pytest.approx(got[2].score, rel=1e-5) and got[9].n_known == 1 and got[9].n_tokens == 30001
    assert got[9].base_score == pytest.approx(30000 * math.log10(0.5 / 12) + math.log10(4.5 / 12))
    nothing = lm_scoring.lm_scores(docs, lm_scoring.F.lit(False)).collect()
    assert len(nothing) == 6 and all(r.train_tokens == 0 and r.n_known == 0 for r in nothing)
    assert lm_scoring.lm_scores(docs.where("false"), lm_scoring.F.lit(True)).count() == 0
