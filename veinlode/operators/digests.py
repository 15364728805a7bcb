"""One hash of a set, of nested sets, and of a snapshot, without a list of all members anywhere.

Members are put in order in buckets of equal first digits and hashed in blocks of ``BLOCK``; the block hashes are members
of the next level, until a set has one. The order of rows has no part in the result, repeated members count once.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veinlode.functions.identity import digest
from veinlode.operators.snapshots import best_confidence
from veinlode.operators.tables import settled

BLOCK = 1024
#: First digits of a hash that make a bucket: of a set of 10^9 members 250,000 share one, 8 MB.
DIGITS = 3


def set_digests(members: DataFrame, key: str, text: str, block: int = BLOCK) -> DataFrame:
    """members(key, text) to (key, digest, n): one hash for the set of each key.

    Hashes are evenly spread, so their first ``DIGITS`` digits cut a set into buckets that are in order among each
    other. Each is sorted by itself and knows from the sizes of those before where its blocks start; blocks inside a
    bucket are hashed there, and only what is left at its ends is sent on to meet the rest of its block."""
    hashed = members.select(F.col(key), digest(F.col(text)).alias("h")).withColumn("bucket", F.substring("h", 1, DIGITS))
    # all that the join below asks for, so that both its sides read one shuffle
    hashed = hashed.where(F.col(key).isNotNull() & F.col("h").isNotNull() & F.col("bucket").isNotNull())
    buckets = hashed.groupBy(key, "bucket").agg(F.array_sort(F.collect_set(F.unhex("h"))).alias("hs"))
    sizes = buckets.select(key, "bucket", F.size("hs").cast("long").alias("c"))
    of = Window.partitionBy(key)  # a row per bucket
    before = F.sum("c").over(of.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select(key, "bucket", F.coalesce(before, F.lit(0)).alias("at"), F.sum("c").over(of).alias("n"))
    placed = buckets.join(places.hint("shuffle_hash"), [key, "bucket"])
    hexed = lambda hs: F.array_join(F.transform(hs, lambda h: F.lower(F.hex(h))), "")

    def piece(b):
        start = F.greatest(b * block, F.col("at"))
        hs = F.slice("hs", (start - F.col("at") + 1).cast("int"), (F.least((b + 1) * block, F.col("at") + F.size("hs")) - start).cast("int"))
        whole = F.size(hs) == block
        return F.struct(b.alias("b"), start.alias("start"), F.when(whole, digest(hexed(hs))).alias("h"), F.when(~whole, hs).alias("part"))

    span = F.sequence(F.floor(F.col("at") / block), F.floor((F.col("at") + F.size("hs") - 1) / block))
    pieces = placed.select(key, "n", F.explode(F.transform(span, piece)).alias("p")).select(key, "n", "p.*")
    parts = F.transform(F.array_sort(F.collect_list(F.struct("start", "part"))), lambda x: x["part"])  # a block at most
    level = pieces.groupBy(key, "b").agg(F.max("n").alias("n"), F.max("h").alias("whole"), parts.alias("parts"))
    level = settled(level.select(key, F.col("b").alias("rank"), F.coalesce("whole", digest(hexed(F.flatten("parts")))).alias("h"), "n", F.ceil(F.col("n") / block).cast("long").alias("m")))
    while (level.agg(F.max("m")).first()[0] or 1) > 1:  # m: the set's members on this level
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("rank", "h"))), lambda x: x["h"])  # a block at most
        level = level.groupBy(key, F.floor(F.col("rank") / block).cast("long").alias("b")).agg(ordered.alias("hs"), F.max("n").alias("n"), F.max("m").alias("m"))
        h = F.when(F.col("m") > 1, digest(F.array_join("hs", ""))).otherwise(F.col("hs")[0])  # a set that is one hash already stays it
        level = settled(level.select(key, F.col("b").alias("rank"), h.alias("h"), "n", F.ceil(F.col("m") / block).cast("long").alias("m")))
    return level.select(key, F.col("h").alias("digest"), "n")


def refined_types(facts: DataFrame, supports: DataFrame, direct: dict[str, str]) -> DataFrame:
    """facts(fact_id, fact_type) and supports(fact_id, fact_type, rule): a technical fact takes the one type that its
    supports imply, by their own type or by their rule; with none or several it stays technical."""
    by_rule = F.coalesce(*[F.when(F.col("rule") == r, t) for r, t in direct.items()])
    own = F.when(F.col("fact_type") != "technical", F.col("fact_type"))
    implied = supports.select("fact_id", F.explode(F.array_compact(F.array(own, by_rule))).alias("implied")).distinct()
    one = implied.groupBy("fact_id").agg(F.count(F.lit(1)).alias("n"), F.min("implied").alias("implied")).where("n = 1").drop("n")
    out = facts.join(one, "fact_id", "left")
    return out.select(*[c for c in facts.columns if c != "fact_type"], F.when(F.col("fact_type") == "technical", F.coalesce("implied", "fact_type")).otherwise(F.col("fact_type")).alias("fact_type"))


def snapshot_sections(objects: DataFrame, supports: DataFrame, effective: DataFrame, profile: int) -> DataFrame:
    """objects(object_id, kind, payload, subject) and supports(object_id, candidate_id, confidence) as members
    (section, id, text) of a snapshot.

    Profile 1 takes every object and support, profile 2 the ``effective`` ones(object_id, candidate_id) and the
    intervals, each attached to its fact or relation as the hash of its set. An object's confidence is the best one of
    its supports."""
    # one shuffle for what is asked of supports
    if profile == 2:
        asked = supports.select("object_id", "candidate_id", "confidence", F.lit(False).alias("effective"))
        asked = asked.unionByName(effective.select("object_id", "candidate_id", F.lit(None).cast("string").alias("confidence"), F.lit(True).alias("effective"))).repartition("object_id")
        found = asked.withColumn("found", F.bool_or("effective").over(Window.partitionBy("object_id", "candidate_id")))
        supports = found.where("found and not effective and object_id is not null and candidate_id is not null").drop("found", "effective")
    else:
        objects = objects.where("kind <> 'interval'")
        supports = supports.repartition("object_id")
    best = supports.groupBy("object_id").agg(best_confidence("confidence").alias("confidence"))
    traced = supports.join(objects.select("object_id"), "object_id", "left_semi").select(F.lit("supports").alias("section"), F.concat_ws("|", "object_id", "candidate_id").alias("id"), F.concat_ws("|", "object_id", "candidate_id", "confidence").alias("text"))
    objects = objects.join(best, "object_id", "inner" if profile == 2 else "left")
    spells = objects.where("kind = 'interval'").select(F.col("subject").alias("object_id"), F.concat_ws("|", "object_id", "payload").alias("text"))
    attached = set_digests(spells, "object_id", "text").select("object_id", F.col("digest").alias("intervals"))
    df = objects.join(attached, "object_id", "left")
    text = F.concat_ws("|", "object_id", "payload", F.coalesce("confidence", F.lit("low")), F.coalesce("intervals", F.lit("")))
    return df.select(F.concat("kind", F.lit("s")).alias("section"), F.col("object_id").alias("id"), text.alias("text")).unionByName(traced)


def snapshot(members: DataFrame) -> DataFrame:
    """(section, id, text) to (section, digest, n), and a last row of all: the content hash over the names, counts and
    hashes of the sections, of which it is none itself."""
    sections = settled(set_digests(members, "section", "text"))
    line = F.concat_ws(":", "section", F.col("n").cast("string"), "digest")
    whole = sections.agg(digest(F.array_join(F.array_sort(F.collect_list(line)), "\n")).alias("digest"), F.sum("n").alias("n"))  # a row per section
    return sections.select("section", "digest", "n").unionByName(whole.select(F.lit("content").alias("section"), "digest", F.coalesce("n", F.lit(0)).alias("n")))


def fingerprint(**sets: DataFrame) -> DataFrame:
    """Hashes of named one-column sets of texts and, as ``state``, of all of them together."""
    rows = [df.select(F.lit(name).alias("section"), F.col(df.columns[0]).cast("string").alias("id"), F.col(df.columns[0]).cast("string").alias("text")) for name, df in sets.items()]
    found = snapshot(reduce(DataFrame.unionByName, rows))
    return found.withColumn("section", F.when(F.col("section") == "content", "state").otherwise(F.col("section")))
