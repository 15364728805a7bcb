"""Consolidation of dated signals."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def consolidate(signals: DataFrame) -> DataFrame:
    """signals(subject, role, value, reliability, sha, family) to buckets by value with an assessment.

    Independent sources are different (sha, family) pairs of medium or high reliability. More than one bucket per
    subject and role makes all of them conflicting.
    """
    sure = F.col("reliability").isin("medium", "high")
    buckets = signals.groupBy("subject", "role", "value").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.when(sure, F.struct("sha", "family"))).alias("independent"))
    roles = buckets.groupBy("subject", "role").agg(F.count(F.lit(1)).alias("n_buckets"))
    out = buckets.join(roles, ["subject", "role"])
    assessment = F.when(F.col("n_buckets") > 1, "conflicting").when(F.col("independent") > 1, "concordant").when(F.col("independent") == 1, "single_or_correlated").otherwise("low_quality")
    return out.select("subject", "role", "value", "n", "independent", assessment.alias("assessment"))


def proposals(buckets: DataFrame) -> DataFrame:
    """Interval proposals, one for every bucket, conflicting ones too (with low confidence).

    One record of valid_from and one of valid_to of a subject become one interval, judged by its start; otherwise such
    a bound stays open on the other side. Other roles are points.
    """
    records = lambda role: F.coalesce(F.sum(F.when(F.col("role") == role, F.col("n"))), F.lit(0))
    ends = buckets.groupBy("subject").agg(records("valid_from").alias("n_from"), records("valid_to").alias("n_to"), F.max(F.when(F.col("role") == "valid_to", F.col("value"))).alias("its_end"))
    df = buckets.join(ends, buckets["subject"].eqNullSafe(ends["subject"])).drop(ends["subject"])
    paired = (F.col("n_from") == 1) & (F.col("n_to") == 1)
    df = df.where(~(paired & (F.col("role") == "valid_to")))
    start = F.when(F.col("role") != "valid_to", F.col("value"))
    end = F.when(F.col("role") != "valid_from", F.col("value")).when(paired, F.col("its_end"))
    semantics = F.when(end.isNull(), "open_end").when(start.isNull(), "open_start").otherwise("inclusive")
    confidence = F.when((F.col("independent") > 1) & (F.col("assessment") != "conflicting"), "medium").otherwise("low")
    return df.select("subject", start.alias("start"), end.alias("end"), semantics.alias("semantics"), confidence.alias("confidence"))


def propagate(intervals: DataFrame, links: DataFrame, policy: str) -> DataFrame:
    """Intervals of sources to targets over links(source, target).

    ``explicit_copy`` needs exactly one interval over all sources, ``intersection`` takes the common parts of the
    sources' intervals (each source may have several), ``aggregation`` keeps all different ones. A target one of whose sources has no interval gets
    none.
    """
    found = links.join(intervals.select(F.col("subject").alias("source"), "start", "end"), "source", "left")
    lacking = links.join(intervals.select(F.col("subject").alias("source")).distinct(), "source", "left_anti").select("target").distinct()
    found = found.join(lacking, "target", "left_anti")
    if policy == "aggregation":
        return found.select("target", "start", "end").distinct()
    if policy == "explicit_copy":
        one = found.groupBy("target").agg(F.count_distinct(F.struct("start", "end")).alias("n"), F.first(F.struct("start", "end")).alias("i"))
        return one.where("n = 1").select("target", "i.start", "i.end")
    if policy == "intersection":
        return folded(found.select("target", "source", "start", "end"))
    raise ValueError(f"unknown policy {policy}")


def folded(spells: DataFrame) -> DataFrame:
    """(target, source, start, end) to the parts (target, start, end) that a spell of every source has in common.

    Sources are paired and pairs are paired again, so there are as many rounds as the logarithm of the most sources of
    one target; a round brings together the spells of two sources of a target, and only common parts go on. Null
    bounds are open.
    """
    numbers = spells.select("target", "source").distinct().withColumn("k", F.row_number().over(Window.partitionBy("target").orderBy(F.col("source").asc_nulls_last())) - 1)
    most = numbers.agg(F.max("k")).first()[0] or 0
    named = numbers.toDF("t", "s", "k")
    rows = spells.join(named, F.col("target").eqNullSafe(F.col("t")) & F.col("source").eqNullSafe(F.col("s"))).select("target", "k", "start", "end").distinct()
    sizes = numbers.groupBy("target").agg((F.max("k") + 1).alias("n"))
    rows = rows.join(sizes, "target")
    common = "flatten(transform(one, x -> transform(two, y -> struct(greatest(x.start, y.start) AS start, least(x.end, y.end) AS end))))"
    while most > 0:
        side = lambda rest: F.collect_list(F.when(F.col("k") % 2 == rest, F.struct("start", "end")))
        met = rows.groupBy("target", F.floor(F.col("k") / 2).cast("int").alias("at"), "n").agg(side(0).alias("one"), side(1).alias("two"))
        parts = F.explode(F.when(F.col("at") * 2 + 1 == F.col("n"), F.col("one")).otherwise(F.expr(common)))  # the last one of an odd number goes on alone
        rows = met.select("target", F.col("at").alias("k"), F.ceil(F.col("n") / 2).cast("int").alias("n"), parts.alias("s")).select("target", "k", "n", "s.start", "s.end")
        rows = rows.where("start is null or end is null or start <= end").distinct()
        most //= 2
    return rows.select("target", "start", "end").distinct()
