"""Counting by sweeps over sorted bounds: pairs that don't meet are counted, not listed.

Two closed intervals miss each other when one ends before the other starts. Sorted by point, every start adds the
number of ends before it, so the pairs of a group cost a sort and a running sum. Running sums go over range partitions:
sums inside a partition, and for the few groups that span several the total of the partitions before. A hot group is so
spread over as many tasks as it has partitions.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinlode.functions.intervals import overlap
from veinlode.operators.tables import settled, stored

#: Rows of a side that one task has at a time.
CHUNK = 1 << 19


def running(rows: DataFrame, key: str, order: list[str], weight: str, out: str) -> DataFrame:
    """``rows`` with ``out``: the sum of ``weight`` over the rows of the same key that come before in ``order``."""
    by = [F.col(c) for c in (key, *order)]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    parts = settled(rows.repartitionByRange(n, *by).withColumn("_part", F.spark_partition_id()))
    sums = parts.groupBy(F.col(key).alias("_key"), F.col("_part").alias("_p")).agg(F.sum(weight).alias("_sum"))
    before = F.sum("_sum").over(Window.partitionBy("_key").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1))  # a row per partition of the key
    offsets = sums.select("_key", "_p", F.coalesce(before, F.lit(0)).alias("_before"))
    inside = F.sum(weight).over(Window.partitionBy("_part", key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    found = parts.withColumn("_inside", F.coalesce(inside, F.lit(0))).join(offsets, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_p")))
    return found.withColumn(out, F.col("_inside") + F.col("_before")).drop("_part", "_p", "_key", "_inside", "_before")


def disjoint_pairs(spells: DataFrame, key: str) -> DataFrame:
    """spells(key, start, end, n: how many alike) to (key, disjoint): pairs of spells of the key that don't meet."""
    starts = spells.where("start is not null").select(key, F.col("start").alias("at"), F.lit(0).alias("is_end"), "n", F.lit(0).cast("long").alias("ends"))
    ends = spells.where("end is not null").select(key, F.col("end").alias("at"), F.lit(1).alias("is_end"), "n", F.col("n").alias("ends"))
    points = starts.unionByName(ends).groupBy(key, "at", "is_end").agg(F.sum("n").alias("n"), F.sum("ends").alias("ends"))
    # at one point starts come first: an interval that ends there meets one that starts there
    swept = running(points, key, ["at", "is_end"], "ends", "ended")
    return swept.where("is_end = 0").groupBy(key).agg(F.sum(F.col("n") * F.col("ended")).alias("disjoint"))


def _quadrants(g: np.ndarray, x: np.ndarray, y: np.ndarray, qg: np.ndarray, qx: np.ndarray, qy: np.ndarray) -> np.ndarray:
    """For each query the number of points of its group with x <= qx and y >= qy; all are codes from 0.

    Points are put in order by group and x. What comes before a place in that order is one block of each size 2^k whose
    bit the place has, and in a block sorted by y a search counts."""
    order = np.lexsort((x, g))
    y, wide, high = y[order], max(x.max(initial=0), qx.max(initial=0)) + 1, max(y.max(initial=0), qy.max(initial=0)) + 1
    keys = g[order] * wide + x[order]
    upto = np.concatenate([np.searchsorted(keys, qg * wide + qx, "right"), np.searchsorted(keys, qg * wide, "left")])
    least, found, places = np.concatenate([qy, qy]), np.zeros(len(upto), np.int64), np.arange(len(y))
    for k in range(len(y).bit_length()):
        at = np.flatnonzero((upto >> k) & 1)
        if len(at):
            block = np.sort((places >> k) * high + y)
            b = (upto[at] >> k) - 1
            found[at] += np.searchsorted(block, (b + 1) * high, "left") - np.searchsorted(block, b * high + least[at], "left")
    return found[: len(qg)] - found[len(qg) :]


def _codes(a: pd.Series, b: pd.Series, a_low: bool) -> tuple[np.ndarray, np.ndarray]:
    """Values of both in one order from 0; nulls of ``a`` come first if ``a_low``, else last, and those of ``b`` at the
    other end."""
    known = np.unique(np.concatenate([a[a.notna()].to_numpy(), b[b.notna()].to_numpy()]))

    def coded(v, null):
        out = np.full(len(v), null, np.int64)
        there = v.notna().to_numpy()
        out[there] = np.searchsorted(known, v[there].to_numpy()) + 1
        return out

    ends = (0, len(known) + 1)
    return coded(a, ends[not a_low]), coded(b, ends[a_low])


def met_singles(singles: DataFrame, corners: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """singles(slot, value, start, end) and corners(slot, value, start, end, w) to (slot, met): the sum of w over pairs of
    both with different values where the single starts not after the corner's end and ends not before its start.

    Slots of more than ``chunk`` rows are dealt in pieces, so that each piece of one side meets each of the other and a
    task has no more than a piece of both; the others share pieces."""
    def plain(c, t):
        return F.unix_date(c) if t == "date" else F.unix_micros(c) if t == "timestamp" else F.col(c)

    def shaped(df, *more):
        types = dict(df.dtypes)
        return df.where("slot is not null and value is not null").select("slot", F.to_json(F.struct("slot")).alias("s"), F.to_json(F.struct("value")).alias("v"), plain("start", types["start"]).alias("start"), plain("end", types["end"]).alias("end"), *more)

    points, queries = shaped(singles), shaped(corners, "w")
    n = points.select(F.lit(1).alias("p"), "slot", "s").unionByName(queries.select(F.lit(0).alias("p"), "slot", "s")).groupBy("s").agg(F.sum("p").alias("n"), F.sum(1 - F.col("p")).alias("m"))
    n = settled(n.where(F.col("m") > 0))  # slots without corners have nothing to count
    pieces = lambda c: F.ceil(F.col(c) / chunk).cast("int")
    total = n.agg(F.coalesce(F.sum(F.col("n") + F.col("m")), F.lit(0))).first()[0]
    shared = 1 + 4 * total // chunk
    large = n.where((F.col("n") > chunk // 4) | (F.col("m") > chunk // 4)).select("s", F.greatest(pieces("n"), F.lit(1)).alias("kp"), pieces("m").alias("kq"))  # 8 total / chunk rows at most

    def dealt(df, own, other):
        df = df.join(F.broadcast(large), "s", "left")
        mine = F.pmod(F.xxhash64("s", "v", "start", "end"), F.coalesce(own, F.lit(1))).cast("int")
        hers = F.explode(F.sequence(F.lit(0), F.coalesce(other, F.lit(1)) - 1))
        cell = F.when(own.isNull(), F.pmod(F.xxhash64("s"), F.lit(shared))).otherwise(F.xxhash64("s"))
        return df.withColumn("mine", mine).withColumn("hers", hers).withColumn("cell", cell).drop("kp", "kq")

    kp, kq = F.col("kp"), F.col("kq")
    left = dealt(points.drop("slot").join(n.select("s"), "s", "left_semi"), kp, kq).withColumnsRenamed({"mine": "i", "hers": "j"})
    right = dealt(queries.drop("slot"), kq, kp).withColumnsRenamed({"mine": "j", "hers": "i"})

    def count(p: pd.DataFrame, q: pd.DataFrame) -> pd.DataFrame:
        x, qx = _codes(p["start"], q["end"], True)
        y, qy = _codes(p["end"], q["start"], False)
        slots, names = pd.factorize(pd.concat([p["s"], q["s"]]))
        values = pd.factorize(pd.concat([p["v"], q["v"]]))[0]
        both = pd.factorize(slots * (values.max(initial=0) + 1) + values)[0]
        k = len(p)
        met = _quadrants(slots[:k], x, y, slots[k:], qx, qy) - _quadrants(both[:k], x, y, both[k:], qx, qy)
        out = np.zeros(len(names), np.int64)
        np.add.at(out, slots[k:], met * q["w"].to_numpy())
        return pd.DataFrame({"s": names, "met": out})

    keys = ["cell", "i", "j"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(count, "s string, met long")
    slots = queries.select("s", "slot").distinct()
    return found.groupBy("s").agg(F.sum("met").alias("met")).join(slots, "s").select("slot", "met")


def corners_of(spells: DataFrame) -> DataFrame:
    """spells(fact_id, start, end), without repeated ones, to (fact_id, start, end, w): a spell meets some of a fact's
    spells or none as the sum of w over the rows that it meets is 1 or 0.

    Spells inside others are left out. Those that remain have starts and ends in one order, so the ones that something
    meets follow each other: one more than there are neighbours that both meet it."""
    order = Window.partitionBy("fact_id").orderBy(F.col("start").asc_nulls_first(), F.col("end").desc_nulls_first())
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    new = F.coalesce(~F.max(F.col("end").isNull()).over(before) & (F.col("end").isNull() | (F.col("end") > F.max("end").over(before))), F.lit(True))
    kept = spells.withColumn("new", new).where("new").withColumn("following", F.lead("start").over(order))
    both = F.array(F.struct(F.col("start"), F.lit(1).alias("w")), F.struct(F.col("following").alias("start"), F.lit(-1).alias("w")))
    rows = kept.select("fact_id", "end", F.explode(both).alias("r")).select("fact_id", "r.start", "end", "r.w")
    return rows.where("w = 1 or start is not null")


def conflicts_in_time(facts: DataFrame, intervals: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """facts(fact_id, slot, value) and intervals(fact_id, start, end) to (slot, n_facts, n_values, n_pairs): pairs of
    facts of a slot with different values, without those that both have intervals none of which meet.

    Facts with one interval are counted by sweeps, in n log n for a slot of n facts, and so is what facts with several
    meet of them (``met_singles``). Facts with several different ones are compared one by one among themselves, as a
    pair may meet more than once; start after end counts as it stands, and a fact with such an interval (it may lie
    on both sides of another) counts among those.
    """
    spells = intervals.select("fact_id", "start", "end").distinct()
    each = spells.groupBy("fact_id").agg(F.count(F.lit(1)).alias("k"), F.any_value("start").alias("start"), F.any_value("end").alias("end"), F.collect_list(F.struct("start", "end")).alias("own"))
    several = (F.col("k") > 1) | F.coalesce(F.col("start") > F.col("end"), F.lit(False))
    each = each.withColumn("several", several).withColumn("own", F.when(F.col("several"), F.col("own")))
    dated = stored(facts.select("fact_id", "slot", "value").join(each, "fact_id", "left"))
    classes = dated.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("several")).alias("ones"), F.count_if("several").alias("more"))
    square = lambda c: F.sum(F.col(c) * F.col(c))
    across = F.sum("ones") * F.sum("more") - F.sum(F.when(F.col("value").isNotNull(), F.col("ones") * F.col("more")).otherwise(F.lit(0)))
    totals = classes.groupBy("slot").agg(F.sum("n").alias("n_facts"), F.count(F.lit(1)).alias("n_values"), square("n").alias("same"), across.alias("across"))
    ids = dated.where("not several").select("slot", "value", "start", "end", F.lit(1).cast("long").alias("n"))
    whole, own = F.to_json(F.struct("slot")), F.to_json(F.struct("slot", "value"))
    both = ids.select("slot", whole.alias("group"), F.lit(1).alias("sign"), "start", "end", "n").unionByName(ids.select("slot", own.alias("group"), F.lit(-1).alias("sign"), "start", "end", "n"))
    named = both.groupBy("group").agg(F.any_value("slot").alias("slot"), F.any_value("sign").alias("sign"))
    apart = disjoint_pairs(both, "group").join(named, "group").groupBy("slot").agg(F.sum(F.col("sign") * F.col("disjoint")).alias("apart"))
    many = dated.where("several")
    corners = corners_of(many.select("fact_id", F.explode("own").alias("s")).select("fact_id", "s.*")).join(many.select("fact_id", "slot", "value"), "fact_id")
    met = met_singles(ids, corners, chunk)
    left, right = (many.select("slot", F.col("fact_id").alias(x), F.col("value").alias(f"v{x}"), F.col("own").alias(f"own_{x}")) for x in "ab")
    meets = F.exists("own_a", lambda p: F.exists("own_b", lambda q: overlap(p["start"], p["end"], q["start"], q["end"])))
    missed = left.join(right, "slot").where("a < b and va <> vb").where(~meets).groupBy("slot").agg(F.count(F.lit(1)).alias("missed"))
    out = totals.where("n_values > 1").join(apart, "slot", "left").join(missed, "slot", "left").join(met, "slot", "left")
    n = (F.col("n_facts") * F.col("n_facts") - F.col("same")) / 2 - F.coalesce("apart", F.lit(0)) - F.coalesce("missed", F.lit(0)) - (F.col("across") - F.coalesce("met", F.lit(0)))
    return out.select("slot", "n_facts", "n_values", n.cast("long").alias("n_pairs"))
