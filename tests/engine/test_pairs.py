"""Pairs of facts: dealt in pieces, with several intervals, and without a shuffle of pairs."""

import random

from pyspark.sql import functions as F

from veinlode.operators import conflicts


def test_pairs_in_time(spark, monkeypatch):
    monkeypatch.setattr(conflicts.paired, "__defaults__", (5,))
    rng = random.Random(5)
    facts = [(i, rng.choice("hhhab"), rng.randrange(3)) for i in range(90)] + [(900, None, 1), (901, None, 2)]
    spells = []
    for i, _, _ in facts:
        for _ in range(rng.choice([0, 1, 1, 2, 3])):
            s = rng.randrange(40)
            spells.append((i, None if rng.random() < 0.1 else s, None if rng.random() < 0.1 else s + rng.randrange(-2, 9)))
    own = {}
    for i, s, e in spells:
        own.setdefault(i, []).append((-99 if s is None else s, 999 if e is None else e))
    every = [(s, i, v, j, w) for x, (i, s, v) in enumerate(facts) for j, t, w in facts[x + 1 :] if s and s == t and v != w]
    f, iv = spark.createDataFrame(facts, "fact_id int, slot string, value int"), spark.createDataFrame(spells, "fact_id int, start int, end int")
    assert sorted(tuple(r) for r in conflicts.fact_conflicts(f).collect()) == sorted(every)
    want = [p for p in every if not (p[1] in own and p[3] in own and not any(a <= d and c <= b for a, b in own[p[1]] for c, d in own[p[3]]))]
    got = conflicts.fact_conflicts_in_time(f, iv)
    assert sorted(tuple(r) for r in got.select("slot", "left_id", "left_value", "right_id", "right_value").collect()) == sorted(want)
    assert conflicts.without_disjoint(conflicts.fact_conflicts(f), iv).count() == len(want)


def test_hot_slot_is_split(spark):
    """The pairs of one slot come from several tasks (from one before)."""
    facts = spark.range(9000).selectExpr("id as fact_id", "concat('s', id div 9000) as slot", "id % 2 as value")
    pairs = conflicts.fact_conflicts(facts).groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()
    assert sum(r.n for r in pairs) == 4500 * 4500 and len(pairs) > 1
