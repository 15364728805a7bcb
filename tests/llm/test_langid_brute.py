"""op8 against plain Python: counts, bit classifiers, weighted decoding."""

import math
import zlib
from collections import Counter

from veinlode.llm import langid

SF = "/root/testdata/sf0.001"
_M = 0xFFFFFFFF


def _grams(text):
    out, last = [], None
    for b in text.encode():
        c = (b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 else 32) if b < 128 else b
        if c != 32 or last != 32:
            out.append(c)
        last = c
    bins = Counter()
    for n in (1, 2, 3):
        for i in range(len(out) - n + 1):
            v = n << 24
            for k in range(n):
                v += out[i + k] << 8 * (n - 1 - k)
            v = (v & _M) * 2654435761 & _M
            v ^= v >> 15
            bins[(v * 2246822519 & _M) >> 19] += 1
    return bins


def _margins(grams, weights):
    n = max(sum(grams.values()), 1)
    return [sum(c * w[b] for b, c in grams.items()) / n * min(n, langid.EVIDENCE) for w in weights]


def test_query_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    learned = [d for d in docs if d.text is not None and d.lang is not None and zlib.crc32(str(d.doc_id).encode()) % 4 != 2 and langid.has_letter(d.text)]
    langs = sorted({d.lang for d in learned})
    grams = {d.doc_id: _grams(d.text) for d in docs if langid.has_letter(d.text)}
    counts = {lang: Counter() for lang in langs}
    for d in learned:
        counts[d.lang].update(grams[d.doc_id])
    code = langid.codewords(len(langs)).tolist()
    total = {lang: sum(counts[lang].values()) + 0.5 * langid.BINS for lang in langs}
    weights = []
    for b in range(len(code[0])):
        sides = [[lang for lang, row in zip(langs, code) if row[b] == s] for s in (1, -1)]
        weights.append([math.log(*[sum((counts[x][g] + 0.5) / total[x] for x in sides[0]) / len(sides[0]) / (sum((counts[x][g] + 0.5) / total[x] for x in sides[1]) / len(sides[1]))]) for g in range(langid.BINS)])
    margins = {i: _margins(g, weights) for i, g in grams.items()}
    right = [sum((margins[d.doc_id][b] > 0) == (code[langs.index(d.lang)][b] > 0) for d in learned) for b in range(len(weights))]
    trust = [max(2 * (r + 1) / (len(learned) + 2) - 1, 0.01) for r in right]
    got = {r.doc_id: r for r in langid.op8_langid(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        r = got[d.doc_id]
        assert r.held_out == (zlib.crc32(str(d.doc_id).encode()) % 4 == 2)
        if d.doc_id not in grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        loss = [sum(math.log1p(math.exp(-m * s)) * t if -m * s < 700 else -m * s * t for m, s, t in zip(margins[d.doc_id], row, trust)) / sum(trust) for row in code]
        best = min(range(len(langs)), key=loss.__getitem__)
        score = 1 / sum(math.exp(max(loss[best] - x, -700) * len(trust) / 2) for x in loss)
        assert r.lang_pred == langs[best] and math.isclose(r.score, score, rel_tol=1e-3, abs_tol=1e-4)


def test_short_texts_and_ties(spark):
    rows = [(i, t, lang) for i, (t, lang) in enumerate([("the cat and the dog", "en"), ("der hund und die katze", "de")] * 20)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    asked = spark.createDataFrame([(1, "the", "x"), (2, "und", "x"), (3, "qq", "x"), (4, "a" * 3_000_000, "x")], "doc_id long, text string, lid_pred string")
    got = {r.doc_id: r for r in langid.identify(asked, model).collect()}
    assert got[1].lid_pred == "en" and got[2].lid_pred == "de" and got[3].lid_pred in ("en", "de") and got[4].lid_pred in ("en", "de")
    assert set(got[1].asDict()) == {"doc_id", "text", "lid_pred", "lid_score", "lid_ambiguous"}
