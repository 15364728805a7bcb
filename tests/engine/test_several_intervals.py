"""Facts with several intervals against a plain count."""

import random

import pytest

from veinlode.operators import sweeps


@pytest.mark.parametrize("chunk", [7, 1 << 19])
def test_several_intervals(spark, chunk):
    """Open, nested and turned round ones, in slots that are dealt in pieces and in slots that share one."""
    rng = random.Random(3)
    facts = [(i, rng.choice("hhhhab"), rng.randrange(3)) for i in range(160)]
    spells = []
    for i, _, _ in facts:
        for _ in range(rng.choice([0, 1, 1, 1, 2, 4])):
            s = rng.randrange(40)
            spells.append((i, None if rng.random() < 0.1 else s, None if rng.random() < 0.1 else s + rng.randrange(-4, 9)))
    own = {}
    for i, s, e in spells:
        own.setdefault(i, []).append((-99 if s is None else s, 999 if e is None else e))
    want = {}
    for x, (i, slot, v) in enumerate(facts):
        for j, other, w in facts[x + 1 :]:
            if slot == other and v != w and not (i in own and j in own and not any(a <= d and c <= b for a, b in own[i] for c, d in own[j])):
                want[slot] = want.get(slot, 0) + 1
    got = sweeps.conflicts_in_time(spark.createDataFrame(facts, "fact_id int, slot string, value int"), spark.createDataFrame(spells, "fact_id int, start int, end int"), chunk)
    assert {r.slot: r.n_pairs for r in got.collect()} == want


def test_no_pairs_with_single_ones(spark):
    """2000 facts with two intervals and 40,000 with one in a slot: 80 million pairs, which are counted, not listed."""
    facts = spark.range(42_000).selectExpr("id as fact_id", "'s' as slot", "id % 2 as value")
    spells = spark.range(42_000).selectExpr("id as fact_id", "id as start", "id as end").union(spark.range(2_000).selectExpr("id as fact_id", "50000 + id as start", "50000 + id as end"))
    df = sweeps.conflicts_in_time(facts, spells)
    (r,) = df.collect()
    assert (r.n_facts, r.n_values, r.n_pairs) == (42_000, 2, 0)
