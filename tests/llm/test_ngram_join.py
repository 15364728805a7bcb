import random

import numpy as np

from veinlode.llm import links, ngram_join


def _classes(texts, threshold=0.8):
    """Brute force: ids of texts to the smallest id of their group."""
    sets = {i: set(ngram_join.shingles(ngram_join.tokens(t)).tolist()) for i, t in texts}
    ids = sorted(sets)
    root = {i: i for i in ids}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[:k]:
            x, y = sets[a], sets[b]
            if x and y and len(x & y) >= threshold * len(x | y):
                p, q = sorted((top(a), top(b)))
                root[q] = p
    return {i: top(i) for i in ids}


def _edited(words, rng, share):
    return [rng.choice("abcdefgh") * 3 if rng.random() < share else w for w in words]


def test_matches_brute_force(spark):
    rng = random.Random(5)
    texts = []
    for g in range(25):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.randrange(40, 300))]
        texts += [" ".join(_edited(base, rng, 0.01)) for _ in range(rng.randrange(1, 9))]
    chain = [f"c{i}" for i in range(200)]  # neighbours are similar, ends are not
    texts += [" ".join(chain[i * 6 :] + [f"d{j}" for j in range(i * 6)]) for i in range(12)]
    hot = [f"h{i}" for i in range(120)]
    texts += [" ".join(_edited(hot, rng, 0.012)) for _ in range(150)] + [" ".join(hot)] * 40
    texts += ["one two", "one two", "One  TWO\n", "", None, " \t", "x"]
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    docs = spark.createDataFrame([(i, t, "k", 1) for i, t in rows], "doc_id long, text string, item string, raw int")
    got = ngram_join.near_duplicates(docs).collect()
    want = _classes(rows)
    assert {r.doc_id: r.class_id for r in got} == want and len(got) == len(rows)
    assert all((r.n_links > 0) <= (sum(v == r.class_id for v in want.values()) > 1) for r in got)
    kept = ngram_join.keep_first(docs)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, c in want.items() if i == c) and kept.columns == docs.columns


def test_nulls_and_repeats(spark):
    t = " ".join(f"a{i}" for i in range(50))
    docs = spark.createDataFrame([(None, t), (None, t), (4, t + " z"), (4, t + " z"), (3, None), (3, None), (None, None)], "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.near_duplicates(docs).select("doc_id", "class_id", "n_links", "first").collect()), key=str)
    assert got == sorted([(None, 4, 1, False)] * 2 + [(4, 4, 1, True)] * 2 + [(3, 3, 0, True)] * 2 + [(None, None, 0, True)], key=str)
    assert ngram_join.keep_first(docs).count() == 3
    assert ngram_join.near_duplicates(docs.where("false")).count() == 0


def test_buckets_of_many_different_texts(spark):
    """A template's texts share buckets, several hundred each, and no prefix; the near ones among them are found."""
    rng = random.Random(4)
    head = [f"t{i}" for i in range(150)]
    texts = [" ".join(head + [f"x{rng.randrange(10**6)}" for _ in range(50)]) for _ in range(3000)]
    near = [t + " end" for t in texts[::100]]
    rows = list(enumerate(texts + near))
    rng.shuffle(rows)
    got = {r.doc_id: r.class_id for r in ngram_join.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i if i < 3000 else (i - 3000) * 100 for i, _ in rows}


def test_stars(spark):
    rng = np.random.default_rng(3)
    keys, ids = rng.integers(0, 300, 2000), rng.integers(0, 1 << 62, 60)[rng.integers(0, 60, 2000)]
    rows = spark.createDataFrame([([int(k)], int(i)) for k, i in zip(keys, ids)], "keys array<long>, id long").repartition(5)
    edges = links.meet(rows.mapInArrow(links.starred_lists, "key long, a long, b long")).collect()
    linked = {}
    for e in edges:
        linked.setdefault(e.key, []).append((e.a, e.b))
    for key in range(300):
        want = set(ids[keys == key].tolist())
        up = {i: i for i in want}

        def top(i):
            return i if up[i] == i else top(up[i])

        for a, b in linked.get(key, []):
            assert {a, b} <= want
            up[top(a)] = top(b)
        assert len({top(i) for i in want}) <= 1
    assert len({e.a for e in edges}) > 10


def test_components(spark):
    rng = random.Random(8)
    chain = list(range(1000, 1300))
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [(2000, k) for k in range(2001, 2200)] + [(rng.randrange(300), rng.randrange(300)) for _ in range(200)]
    pairs = [(min(p), max(p)) for p in pairs if p[0] != p[1]]
    root = {}

    def top(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        lo, hi = sorted((top(a), top(b)))
        root[hi] = lo
    links_ = spark.createDataFrame(pairs, "a long, b long").repartition(7)
    got = {r.item: r.root for r in links.components(links_).collect()}
    assert got == {x: top(x) for x in root if top(x) != x}
    half = links.components(links_.where("a % 2 = 0"))
    assert {r.item: r.root for r in links.components(links_.where("a % 2 = 1"), half).collect()} == got


def test_clashing_columns(spark):
    t = " ".join(f"a{i}" for i in range(50))
    names = ["doc_id", "text", "its_id", "its_raw", "raw", "a.b", "item", "_text"]
    kept = ngram_join.keep_first(spark.createDataFrame([(1, t, *range(6)), (2, t + " z", *range(6))], names))
    assert kept.columns == names and [tuple(r) for r in kept.collect()] == [(1, t, *range(6))]


def test_query(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    got = {r.doc_id: r.class_id for r in ngram_join.op1_ngram_join(spark, "/root/testdata/sf0.001").collect()}
    assert got == _classes([(r.doc_id, r.text) for r in docs])
