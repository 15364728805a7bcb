import math

from veinlode.llm import mixing


def _docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, size string")


def _waterfill(sizes):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: (3, 1, 2)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), 1.5 * sum(sizes.values())
    while free:
        level = left / sum(w[s] for s in free)
        over = {s for s in free if w[s] * level > 2 * sizes[s]}
        if not over:
            return target | {s: w[s] * level for s in free}
        target |= {s: 2.0 * sizes[s] for s in over}
        left -= sum(2 * sizes[s] for s in over)
        free -= over
    return target


def test_targets_and_copies(spark):
    rows = [(i, "w " * (i % 7 + 1), "ab"[i % 2] if i % 11 else None, "clash") for i in range(400)]
    rows += [(1000 + i, "x y", "rare", None) for i in range(3)] + [(None, None, "a", None), (7, "\x0b\x1c", "z", None), (7, "", "z", None)]
    got = mixing.mixing_plan(_docs(spark, rows)).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r in got:
        sizes[r.source] = sizes.get(r.source, 0) + r.size
    want = _waterfill(sizes)
    for r in got:
        assert r.source_size == sizes[r.source] and math.isclose(r.target, want[r.source], rel_tol=1e-12, abs_tol=1e-9)
        assert 0 <= r.copies <= 2
    assert sizes["z"] == 1  # U+001C is no white space here
    for s in ("a", "b"):
        taken = sum(r.copies * r.size for r in got if r.source == s)
        assert abs(taken - want[s]) < 0.25 * want[s]
    mixed = mixing.mix(_docs(spark, rows))
    assert mixed.columns == ["doc_id", "text", "source", "size", "mix_copy"]
    assert mixed.count() == sum(r.copies for r in got)
    assert sorted(map(str, mixed.collect())) == sorted(map(str, mixing.mix(_docs(spark, rows[::-1]).repartition(3)).collect()))


def test_empty(spark):
    assert mixing.mixing_plan(_docs(spark, [])).collect() == []
    assert [r.target for r in mixing.mixing_plan(_docs(spark, [(1, None, "a", None)])).collect()] == [0.0]


def test_one_row_repeated_in_many_partitions(spark):
    rows = spark.range(6000).selectExpr("cast(7 as long) as doc_id", "'w w w' as text", "'a' as source", "'x' as size").repartition(9)
    other = spark.range(500).selectExpr("id as doc_id", "'w w' as text", "'b' as source", "'x' as size")
    made = mixing.numbered(rows.withColumn("d", mixing.F.md5("text")), "d", "k")
    assert sorted(r.k for r in made.collect()) == list(range(1, 6001)) and made.columns == ["doc_id", "text", "source", "size", "d", "k"]
    plan = mixing.mixing_plan(rows.union(other)).collect()
    taken = {s: sum(r.copies * r.size for r in plan if r.source == s) for s in "ab"}
    assert len(plan) == 6500 and all(abs(taken[s] - next(r.target for r in plan if r.source == s)) < 0.05 * taken[s] for s in "ab")
