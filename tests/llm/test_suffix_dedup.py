import hashlib
import random
from contextlib import ExitStack

import numpy as np
import pytest

from veinlode.llm import suffix_dedup as sd


def _brute(texts):
    seen = {}
    raws = [(t or "").encode() for t in texts]
    for raw in raws:
        for s in range(len(raw) - sd.LENGTH + 1):
            w = raw[s : s + sd.LENGTH]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for raw in raws:
        gone = np.zeros(len(raw) + 1, bool)
        for s in range(len(raw) - sd.LENGTH + 1):
            if seen[raw[s : s + sd.LENGTH]] > 1:
                gone[s : s + sd.LENGTH] = True
        spans = int((np.diff(np.concatenate(([0], gone.view(np.int8)))) == 1).sum())
        left = bytes(b for b, g in zip(raw, gone) if not g)
        out.append((len(raw), int(gone.sum()), spans, hashlib.sha256(left).hexdigest()))
    return out


def _texts(seed):
    rng = random.Random(seed)
    word = lambda n: " ".join("".join(rng.choice("etaoinshrdlüß") for _ in range(rng.randrange(1, 9))) for _ in range(n))
    passages = [word(rng.randrange(60, 300)) for _ in range(8)]
    texts = []
    for i in range(60):
        parts = [word(rng.randrange(0, 120))]
        for p in rng.sample(passages, rng.randrange(0, 3)):
            cut = rng.randrange(0, 60)
            parts += [p[cut : len(p) - rng.randrange(1, 60)], word(rng.randrange(0, 40))]
        texts.append(" ".join(parts))
    base = word(500)
    texts += [base] * 5 + [base[:k] + "#" + base[k + 1 :] for k in range(10, 2000, 170)] + ["ab" * 600, "x" * 399, "x" * 400, "y" * 401, "é" * 450, "", None]
    line = word(14)
    texts += [word(90) + line + word(90) for _ in range(30)]
    passage = word(90)[:450]
    texts += [word(90) + passage + word(90) for _ in range(30)]
    return texts


@pytest.mark.parametrize("many", [1000, 3])
def test_matches_brute_force(spark, monkeypatch, many):
    monkeypatch.setattr(sd, "MANY", many)
    texts = _texts(many)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, start int").repartition(3)
    out = sd.remove_repeats(docs)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in out.collect()}
    want = dict(enumerate(_brute(texts)))
    assert got == want and sum(w[1] for w in want.values()) > 10_000


def test_pieces_cover_all_windows():
    raw = random.Random(1).randbytes(5000) + b"z" * 900 + b"periodic text of some length " * 40
    at = 0
    for start, count, lead, _ in sd.pieces(raw):
        assert start == at and 0 <= lead - (count - 1) and lead <= sd.SPAN
        at += count
    assert at == len(raw) - sd.LENGTH + 1


def test_nulls_and_repeats(spark):
    t = "".join(random.Random(2).choices("abcdef", k=700))
    docs = spark.createDataFrame([(None, t), (1, t[:500]), (1, t[:500]), (2, None), (3, "")], "doc_id long, text string")
    got = sorted(((r.doc_id, r.n_removed) for r in sd.remove_repeats(docs).collect()), key=str)
    assert got == sorted([(None, 500), (1, 500), (1, 500), (2, 0), (3, 0)], key=str)
    assert sd.remove_repeats(docs.where("false")).count() == 0


def test_a_large_hot_group(spark, monkeypatch):
    """Near copies of one passage: all pieces have common keys, and many parts one middle."""
    monkeypatch.setattr(sd, "MANY", 50)
    rng = random.Random(4)
    base = "".join(rng.choices("abcdefgh ", k=1200))
    texts = []
    for _ in range(400):
        t = list(base)
        for k in rng.sample(range(1200), 2):
            t[k] = rng.choice("XYZ")
        texts.append("".join(t))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in sd.remove_repeats(docs).collect()}
    assert got == dict(enumerate(_brute(texts)))


def test_transform():
    """The transform's segments against plain sorting."""
    rng = random.Random(9)
    data = [bytes(rng.choices(b"ab", k=rng.randrange(402, 420))) for _ in range(20)]
    left = np.array([rng.randrange(5) for _ in data])
    groups = np.array([i % 2 for i in range(20)])
    with ExitStack() as folder:
        made = sd.Collection(groups, left, data, folder)
        for x in range(made.columns - 1, -1, -1):
            order, prefix = made.insert(x)
            there = [i for i in range(20) if left[i] <= x < left[i] + len(data[i])]
            suffix = {i: data[i][x - left[i] :] for i in there}
            assert [(groups[i], suffix[i]) for i in order] == sorted((groups[i], suffix[i]) for i in there)
            made.transform.seek(made.at)
            before = made.transform.read(made.kept)
            assert all(b == data[i][x - left[i] - 1] for b, i in zip(before, order) if x > left[i])
            for k in range(1, len(order)):
                a, b = suffix[order[k - 1]], suffix[order[k]]
                n = next((j for j in range(min(len(a), len(b))) if a[j] != b[j]), min(len(a), len(b)))
                assert prefix[k] == (min(n, 400) if groups[order[k]] == groups[order[k - 1]] else 0)
