import hashlib
import re

import numpy as np

from veinlode.llm import fim

UNITS = re.compile("[\x20\x09-\x0d]*[^\x20\x09-\x0d]+|[\x20\x09-\x0d]+")
TEXTS = [None, "", " ", "one", " one  two\tthree \n", "a" * 9000, "é ö 漢字 \U0001f600 end", "has <S> in it", "<P>", "x <M", "S> y <", "\x1c\x85 no space here\xa0too", "w " * 5000, " \n\t", "a\x00b c", "ends with <"]


def _want(doc_id, text):
    text = text or ""
    units = UNITS.findall(text)
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    pre, mid, suf = ("".join(units[i:j]) for i, j in ((0, a), (a, b), (b, n)))
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 50:
        return n, "plain", None, None, text
    if h4 % 100 < 80:
        return n, "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return n, "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


def test_against_a_plain_rule(spark):
    rows = [(i * len(TEXTS) + k, t) for i in range(12) for k, t in enumerate(TEXTS)] + [(None, "no id here at all"), (5, "twice"), (5, "twice")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"n": fim.F.lit(1), "a.b": fim.F.lit(2), "form": fim.F.lit("f"), "Whole": fim.F.lit(3)})
    made = fim.rearrange(docs)
    assert made.columns == ["doc_id", "text", "n", "a.b", "form", "Whole", *fim.COLUMNS]
    got = made.withColumn("back", fim.restored(fim.F.col("fim_text"), fim.F.col("fim_form"))).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == _want(r.doc_id, r.text), r
        assert r.back == (r.text or "") and (r.n, r["a.b"], r.form, r.Whole) == (1, 2, "f", 3)
    assert {r.fim_form for r in got} == {"plain", "spm", "psm"}


def test_long_text_over_slices(spark):
    text = ("wörd " * 50 + "x" * 9001 + "\n\n") * 300  # about 2.8 million bytes, blocks without a border among them
    assert len(text.encode()) > 2 * fim.SLICE
    blocks = fim.Blocks(text.encode())
    units = UNITS.findall(text)
    assert blocks.units == len(units) and blocks.chars == len(text)
    for k in (0, 1, 50, 51, 52, 7777, len(units) - 1, len(units)):
        assert blocks.border(k) == sum(map(len, units[:k]))
    got = fim.rearrange(spark.createDataFrame([(i, text) for i in range(8)], "doc_id long, text string")).collect()
    assert all((r.fim_n, r.fim_form, r.fim_prefix_chars, r.fim_middle_chars, r.fim_text) == _want(r.doc_id, r.text) for r in got)


def test_fenwick():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 7, 8, 9, 100):
        counts = rng.integers(0, 4, (n, 2))
        tree = fim.Fenwick(counts)
        for _ in range(20):
            b = int(rng.integers(n))
            tree.add(b, np.array([1, 5]))
            counts[b] += [1, 5]
        sums = np.concatenate([[[0, 0]], counts.cumsum(axis=0)])
        assert all((tree.before(b) == sums[b]).all() for b in range(n + 1))
        for k in range(1, int(sums[-1, 0]) + 1):
            block, before = tree.descend(k)
            assert sums[block, 0] < k <= sums[block + 1, 0] and (before == sums[block]).all()


def test_empty(spark):
    assert fim.rearrange(spark.createDataFrame([], "doc_id long, text string")).collect() == []
