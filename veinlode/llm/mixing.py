"""Mixing sources to target weights.

Sizes are summed per source, every source gets a target in words, and a document is emitted ``floor(rate)`` times
plus once more when a hash of its id, its text and its occurrence falls under the fraction of the rate (rate = target
/ size of its source). Rows that repeat an id are so drawn one by one; of rows that repeat id and text some have a
copy more than others.

Ranks and levels of the sources come from a range partitioning and a few aggregates, so there may be any number of
sources; a text of any length is counted whole.

Defined cases: a null text has size 0; a null source is a source of its own, last in order; a null id hashes like
the text ``null``; an empty table gives no rows; a source of size 0 has target 0 and none of its documents is taken;
sources whose size is exactly at the level keep it, so equal ratios of size and weight are treated alike. Columns of
``docs`` other than the three named are passed on by ``mix`` whatever their names, but a column named mix_copy is
replaced by the operator's; ``mixing_plan`` ignores them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinlode.llm.common import WORD, free_names, stash, table

WEIGHTS = (3, 1, 2)
#: The mix as a share of all words, as a fraction of integers so that targets need no rounding before the last step.
SHARE = (3, 2)
CAP = 2
SEED = "mix-1"


def words(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def weighed(sizes: DataFrame, weights=WEIGHTS) -> DataFrame:
    """``sizes`` with ``w``: weights repeat along the sources in the order of their code points, null last."""
    spark = sizes.sparkSession
    order = F.col("source").asc_nulls_last()
    parts = sizes.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), order).sortWithinPartitions(order)
    parts = stash(parts.withColumn("at", F.monotonically_increasing_id()), "mix-sources")
    part = F.shiftright("at", 33)
    counts = parts.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).orderBy("part").collect()  # one row per partition
    before, n = {}, 0
    for r in counts:
        before[r.part], n = n, n + r.n
    offset = F.create_map(*[F.lit(x) for kv in before.items() for x in kv])[part] if before else F.lit(0)
    place = (offset + F.col("at").bitwiseAND((1 << 33) - 1)) % len(weights) + 1
    return parts.select("source", "source_size", F.element_at(F.array(*[F.lit(x) for x in weights]), place.cast("int")).cast("long").alias("w"))


def targets(sizes: DataFrame, weights=WEIGHTS, share=SHARE, cap=CAP) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    A source whose share is above ``cap`` times its size stops there and the excess is shared anew, until none is
    above. Every turn is one aggregate, and the sources that stop in a turn are those that pass the level of the last.
    """
    ranked = weighed(sizes, weights)
    num, den = share
    whole = lambda x: F.lit(x).cast("decimal(38,0)")
    total, weight = ranked.agg(F.sum(F.col("source_size").cast("decimal(38,0)")), F.sum("w")).first()
    total, weight = int(total or 0), int(weight or 0)
    left, w_left, n = num * total, weight, -1
    while True:
        stops = F.col("source_size").cast("decimal(20,0)") * whole(den * cap * w_left) < F.col("w").cast("decimal(20,0)") * whole(left)
        r = ranked.where(stops).agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("source_size").cast("decimal(38,0)")).alias("size"), F.sum("w").alias("w")).first()
        if r.n == n or w_left == 0:
            break
        left, w_left, n = num * total - den * cap * int(r.size or 0), weight - int(r.w or 0), r.n
    capped = (cap * F.col("source_size")).cast("double")
    free = F.col("w") * F.lit(float(left)) / F.lit(float(den * w_left)) if w_left else capped
    return ranked.select("source", "source_size", F.when(stops, capped).otherwise(free).alias("target"))


def chance(doc_id: Column, digest: Column, occurrence: Column, seed: str = SEED) -> Column:
    """A number in [0, 1) from the first 52 bits of an md5 of seed, id, md5 of the text and occurrence."""
    own = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null")), F.lit(":"), F.coalesce(digest, F.lit("null")), F.lit(":"), occurrence.cast("string"))
    return F.conv(F.substring(F.md5(own.cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(2**52))


def numbered(rows: DataFrame, digest: str, into: str) -> DataFrame:
    """``rows`` with ``into``, which numbers those of one doc_id and digest from 1. A partition numbers its own, from
    where the partitions before it end, so that very many copies of one row need not meet in a task."""
    names = free_names(rows, "part", "place", "c", "its_id", "its_digest", "its_part", "before")
    part, place, c, its_id, its_digest, its_part, before = names
    held = stash(rows.withColumn(part, F.spark_partition_id()), "mix-again")
    counts = held.groupBy("doc_id", digest, part).agg(F.count(F.lit(1)).alias(c))
    earlier = Window.partitionBy("doc_id", digest).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # a row per partition
    starts = counts.select(F.col("doc_id").alias(its_id), F.col(digest).alias(its_digest), F.col(part).alias(its_part), F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(before))
    own = held.withColumn(place, F.row_number().over(Window.partitionBy(part, "doc_id", digest).orderBy(F.lit(1))))
    same = own["doc_id"].eqNullSafe(starts[its_id]) & own[digest].eqNullSafe(starts[its_digest]) & (own[part] == starts[its_part])
    return own.join(starts, same).withColumn(into, (F.col(place) + F.col(before)).cast("int")).drop(part, place, its_id, its_digest, its_part, before)


def _planned(docs: DataFrame, seed: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with size, source_size, target and copies, under the returned names."""
    names = free_names(docs, "size", "its_source", "source_size", "target", "digest", "occurrence", "copies", "n", "its_id", "its_digest")
    size, its_source, source_size, target, hash_, occurrence, copies, n, its_id, its_hash = names
    sized = docs.withColumns({size: words(F.col("text")), hash_: F.md5(F.col("text").cast("binary"))})  # the text itself isn't needed any more to plan
    sums = sized.groupBy("source").agg(F.sum(size).alias("source_size"))
    goal = stash(targets(sums), "mix-targets").toDF(its_source, source_size, target)
    # only rows that repeat id and text need a number; their table's size is known, so Spark broadcasts it only under its threshold
    twice = stash(sized.groupBy("doc_id", hash_).agg(F.count(F.lit(1)).alias(n)).where(F.col(n) > 1), "mix-repeated").toDF(its_id, its_hash, n)
    if twice.isEmpty():
        sized = sized.withColumn(occurrence, F.lit(1))
    else:
        both = sized.join(twice, sized["doc_id"].eqNullSafe(twice[its_id]) & (sized[hash_].eqNullSafe(twice[its_hash])), "left").drop(its_id, its_hash)
        again = numbered(both.where(F.col(n).isNotNull()), hash_, occurrence)
        sized = both.where(F.col(n).isNull()).withColumn(occurrence, F.lit(1)).unionByName(again)
    out = sized.join(goal, F.col("source").eqNullSafe(F.col(its_source)))
    rate = F.when(F.col(source_size) > 0, F.col(target) / F.col(source_size)).otherwise(0.0)
    extra = (chance(F.col("doc_id"), F.col(hash_), F.col(occurrence), seed) < rate - F.floor(rate)).cast("long")
    return out.withColumn(copies, F.floor(rate) + extra), {"size": size, "source_size": source_size, "target": target, "copies": copies}


def mixing_plan(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """doc_id, size, source, source_size, target and copies of every document."""
    plan, at = _planned(docs.select("doc_id", "text", "source"), seed)
    return plan.select("doc_id", F.col(at["size"]).alias("size"), "source", *[F.col(at[c]).alias(c) for c in ("source_size", "target", "copies")])


def mix(docs: DataFrame, seed: str = SEED) -> DataFrame:
    """The mixed corpus: every document as often as the plan takes it, with ``mix_copy`` numbered from 1."""
    docs = docs.drop("mix_copy")
    plan, at = _planned(docs, seed)
    copies = F.col(at["copies"])
    return plan.where(copies > 0).select(*[F.col(f"`{c}`") for c in docs.columns], F.explode(F.sequence(F.lit(1).cast("long"), copies)).alias("mix_copy"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing_plan(table(spark, sf_dir, "documents"))
    return plan.select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = r"""
WITH d AS (
  SELECT doc_id, source, text, row_number() OVER (PARTITION BY doc_id, text) AS occ, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source
), n AS (
  SELECT *, [3, 1, 2][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INTEGER]::BIGINT AS w FROM s
), l AS (
  SELECT *, row_number() OVER o AS pos,
    3 * sum(source_size) OVER () - 4 * coalesce(sum(source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lft,
    sum(w) OVER () - coalesce(sum(w) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS wl
  FROM n WINDOW o AS (ORDER BY source_size::DOUBLE / w, source ASC NULLS LAST)
), f AS (
  SELECT pos, lft, wl FROM l WHERE source_size * 4 * wl >= w * lft ORDER BY pos LIMIT 1
), t AS (
  SELECT l.source, l.source_size,
    CASE WHEN f.pos IS NULL OR l.pos < f.pos THEN (2 * l.source_size)::DOUBLE
         ELSE (l.w * f.lft)::DOUBLE / (2 * f.wl)::DOUBLE END AS target
  FROM l LEFT JOIN f ON true
), r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
    CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0::DOUBLE END AS rate,
    ('0x' || substr(md5('mix-1:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || coalesce(md5(d.text), 'null') || ':' || d.occ), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE AS u
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  (size * (floor(rate)::BIGINT + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r
"""
