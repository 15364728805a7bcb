"""Conflicting facts and interval algebra."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.intervals import overlap

#: Rows of a slot that meet each other at a time.
PIECE = 4096


def slot_conflicts(facts: DataFrame) -> DataFrame:
    """facts(fact_id, slot, value): slots with different values, with every value's support.

    The slot's distinct values come first, so work follows the number of different values, not of facts; the pairs
    of facts are the product of two values' supports and are counted, not listed.
    """
    values = facts.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    return values.groupBy("slot").agg(F.count(F.lit(1)).alias("n_values"), F.sum("n").alias("n_facts"), F.sum(F.col("n") * F.col("n")).alias("same")).where("n_values > 1").select("slot", "n_values", "n_facts", ((F.col("n_facts") * F.col("n_facts") - F.col("same")) / 2).cast("long").alias("n_pairs"))


def fact_conflicts(facts: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """Pairs of facts of one slot with different values, smaller id first; with ``slots`` only of those.

    A slot has a pair for every two facts that disagree, so ``slot_conflicts`` and ``value_conflicts`` are for all of
    a table, and pairs for the slots that someone looks at.
    """
    facts = facts if slots is None else facts.join(slots.select("slot"), "slot", "left_semi")
    left, right = _sides(facts.select("slot", "fact_id", "value"))
    return paired(left, right).where("left_id < right_id and left_value <> right_value").select("slot", "left_id", "left_value", "right_id", "right_value")


def _sides(facts: DataFrame, *more: str) -> list[DataFrame]:
    """facts(slot, fact_id, value) as left and right ones."""
    return [facts.select("slot", F.col("fact_id").alias(f"{x}_id"), F.col("value").alias(f"{x}_value"), *[F.col(c).alias(f"{x}_{c}") for c in more]) for x in ("left", "right")]


def paired(left: DataFrame, right: DataFrame, piece: int = PIECE) -> DataFrame:
    """All pairs of rows of both sides with the same slot, except those of which one id is null.

    Each side of a slot is dealt in pieces of about ``piece`` rows and each piece of one side meets each of the other
    by itself, so the pairs of a hot slot go over all tasks and none holds more than a piece of it."""
    n = int(left.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pieces = lambda df, out: df.groupBy("slot").agg(F.ceil(F.count(F.lit(1)) / piece).cast("int").alias(out))
    sizes = pieces(left, "_li").join(pieces(right, "_ri"), "slot")

    def dealt(df, key, own, other, mine, hers):
        df = df.where(F.col(key).isNotNull()).join(sizes, "slot")
        cut = df.withColumn(mine, F.pmod(F.xxhash64(key), F.col(own)).cast("int")).withColumn(hers, F.explode(F.sequence(F.lit(0), F.col(other) - 1)))
        return cut.drop("_li", "_ri").repartition(n, "slot", "_i", "_j")

    l, r = dealt(left, "left_id", "_li", "_ri", "_i", "_j"), dealt(right, "right_id", "_ri", "_li", "_j", "_i")
    return l.join(r.hint("merge"), ["slot", "_i", "_j"]).drop("_i", "_j")


def fact_conflicts_in_time(facts: DataFrame, intervals: DataFrame) -> DataFrame:
    """``fact_conflicts`` without the pairs where both facts have intervals and none of one meets any of the other.

    Facts carry their intervals into the pairs, so no pair is shuffled. Those with several different ones are paired
    by themselves, as only they need more than a comparison."""
    spells = intervals.select("fact_id", "start", "end").distinct()
    own = spells.groupBy("fact_id").agg(F.count(F.lit(1)).alias("k"), F.any_value("start").alias("start"), F.any_value("end").alias("end"), F.collect_list(F.struct("start", "end")).alias("own"))
    f = facts.select("slot", "fact_id", "value").join(own, "fact_id", "left").withColumn("k", F.coalesce("k", F.lit(0)))
    differ = "left_value <> right_value"
    left, right = _sides(f.where("k < 2"), "k", "start", "end")
    meets = overlap(F.col("left_start"), F.col("left_end"), F.col("right_start"), F.col("right_end"))
    plain = paired(left, right).where(f"left_id < right_id and {differ}").where((F.col("left_k") == 0) | (F.col("right_k") == 0) | meets)
    left, right = _sides(f.where("k > 1"), "k", "own")[0], _sides(f, "k", "own")[1]
    meets = F.exists("left_own", lambda a: F.exists("right_own", lambda b: overlap(a["start"], a["end"], b["start"], b["end"])))
    more = paired(left, right).where(f"{differ} and (right_k < 2 or left_id < right_id)").where((F.col("right_k") == 0) | meets)
    names, turned = ("left_id", "left_value", "right_id", "right_value"), ("right_id", "right_value", "left_id", "left_value")
    swap = F.col("left_id") > F.col("right_id")
    more = more.select("slot", *[F.when(swap, F.col(t)).otherwise(F.col(c)).alias(c) for c, t in zip(names, turned)])
    return plain.select("slot", *names).unionByName(more)


def value_conflicts(facts: DataFrame) -> DataFrame:
    """Classes (slot, value, n) of the slots with different values: facts of two classes of a slot are in conflict."""
    classes = facts.groupBy("slot", "value").agg(F.count(F.lit(1)).alias("n"))
    several = classes.groupBy("slot").agg(F.count(F.lit(1)).alias("n_values")).where("n_values > 1")
    return classes.join(several, "slot")


def without_disjoint(pairs: DataFrame, intervals: DataFrame) -> DataFrame:
    """Drops pairs where both facts have intervals and none of one meets any of the other."""
    l = intervals.select(F.col("fact_id").alias("left_id"), F.col("start").alias("ls"), F.col("end").alias("le"))
    r = intervals.select(F.col("fact_id").alias("right_id"), F.col("start").alias("rs"), F.col("end").alias("re"))
    dated = pairs.join(l, "left_id").join(r, "right_id")
    met = dated.groupBy("left_id", "right_id").agg(F.bool_or(overlap(F.col("ls"), F.col("le"), F.col("rs"), F.col("re"))).alias("meets"))
    return pairs.join(met.where("not meets"), ["left_id", "right_id"], "left_anti")


def intersection(intervals: DataFrame, key: str) -> DataFrame:
    """Common part of all intervals of a key; keys without one drop out. Nulls are open bounds."""
    both = intervals.groupBy(key).agg(F.max("start").alias("start"), F.min("end").alias("end"), F.count(F.lit(1)).alias("n"))
    return both.where("start is null or end is null or start <= end")


def union_of(intervals: DataFrame, key: str) -> DataFrame:
    """Different intervals of a key; gaps are not filled."""
    return intervals.select(key, "start", "end").distinct()
