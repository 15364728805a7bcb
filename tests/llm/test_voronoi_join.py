from collections import Counter

import duckdb
import numpy as np
import pytest

from veinlode.llm import voronoi_join as vj


def _brute(rows, every, k):
    good = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v):
            good.append((i, [int(np.floor(64 * x)) for x in v]))
    out = Counter()
    for n, (q, e) in enumerate(good):
        if q % every == 0:
            scores = sorted((-sum(a * b for a, b in zip(e, f)), i) for m, (i, f) in enumerate(good) if m != n)
            out.update((q, r, i, -s) for r, (s, i) in enumerate(scores[:k], 1))
    return out


@pytest.mark.parametrize("case", ["spread", "clustered", "large", "wide"])
def test_matches_brute_force(spark, monkeypatch, case):
    monkeypatch.setattr(vj, "ROWS", 150)
    monkeypatch.setattr(vj, "QUERIES", 7)
    rng = np.random.default_rng(4)
    if case == "clustered":
        centres = rng.standard_normal((8, 6)) * 10
        v = centres[rng.integers(0, 8, 400)] + rng.standard_normal((400, 6)) * 0.05
    else:
        v = rng.standard_normal((400, 12)) * {"spread": 1, "large": 1e6, "wide": 1.2e7}[case]
        v[:, 3:] *= case != "wide"  # beyond 32 bits, the scores within 64
    v[50:150] = v[50]  # a frequent vector
    rows = [(i, [float(np.float32(x)) for x in r]) for i, r in enumerate(v)]
    rows += [(1000, None), (1010, [None] * 6), (1020, [float("nan")] * 6), (None, [1.0] * 6), (1030, [float("inf")] * 6), (-20, rows[3][1]), (40, rows[40][1]), (40, rows[41][1]), (40, rows[41][1]), (41, rows[7][1])]
    docs = spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, score int")
    got = Counter(tuple(r) for r in vj.knn_join(docs, vj.F.pmod("vec_id", vj.F.lit(10)) == 0, 5).collect())
    assert got == _brute(rows, 10, 5)


def test_few_and_none(spark):
    docs = spark.createDataFrame([(0, [1.0, 2.0]), (20, [1.0]), (3, [])], "vec_id long, embedding array<float>")
    got = sorted(map(tuple, vj.knn_join(docs, vj.F.pmod("vec_id", vj.F.lit(20)) == 0).collect()))
    assert got == [(0, 1, 20, 4096), (0, 2, 3, 0), (20, 1, 0, 4096), (20, 2, 3, 0)]
    assert vj.knn_join(docs.where("false"), vj.F.lit(True)).count() == 0
    assert vj.knn_join(docs, vj.F.lit(False)).count() == 0


def test_large_components_and_repeated_ids_agree_with_the_sql(spark, tmp_path):
    rows = [(20, [1e9, 2.0]), (20, [-3.5, 1e9]), (3, [2.0, 1.0]), (3, [1.0, 0.1]), (4, [0.0, -1.0]), (4, [0.0, -1.0])]
    docs = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    docs.write.parquet(str(tmp_path / "embeddings.parquet"))
    want = duckdb.sql(vj.ORACLE.replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'")).fetchall()
    got = Counter(map(tuple, vj.op3_voronoi_join(spark, str(tmp_path)).collect()))
    assert got == Counter(want) and (20, 1, 3, 4096 * (2 * 10**9 + 2)) in got
    top = np.array([2.0**40])
    assert vj.products(top[None], np.array([[2.0**40], [2.0**10]])).tolist() == [[2**63 - 1, 2**50]]


def test_few_queries_share_blocks(spark):
    """Candidates are sent once to a block of queries, however many groups it holds."""
    rng = np.random.default_rng(1)
    docs = spark.createDataFrame([(i, [float(x) for x in rng.standard_normal(8)]) for i in range(300)], "vec_id long, embedding array<float>")
    plan = vj.knn_join(docs, vj.F.pmod("vec_id", vj.F.lit(20)) == 0)
    assert plan.count() == 15 * vj.K
