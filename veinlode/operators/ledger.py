"""The append-only ledger: current state as views over event tables.

Tables (all DataFrames): sources(source_id, path, status), revisions(revision_id, source_id, seq),
parses(parse_id, revision_id, seq, status), parse_evidence(parse_id, evidence_id), candidates(candidate_id,
parent_id, root_id, revision_id, evidence_id, record_type, origin), reviews(candidate_id, seq, outcome),
active(candidate_id), supports(object_id, candidate_id). Nothing is updated in place; heads, leaves and
effectiveness are derived.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Ledger = dict[str, DataFrame]


def heads(events: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Latest event per key: partial aggregation, no window."""
    return events.groupBy(key).agg(F.max_by(F.struct(*values), F.col(order)).alias("_h")).select(key, *[F.col(f"_h.{v}").alias(v) for v in values])


def latest_parses(parses: DataFrame) -> DataFrame:
    """Latest successful or partial parse of every revision."""
    good = parses.where(F.col("status").isin("success", "partial"))
    return heads(good, "revision_id", "seq", "parse_id")


def current_revisions(revisions: DataFrame) -> DataFrame:
    return heads(revisions, "source_id", "seq", "revision_id")


def candidate_states(t: Ledger) -> DataFrame:
    """Every candidate with its review state and the five flags that decide whether it counts."""
    state = heads(t["reviews"], "candidate_id", "seq", "outcome")
    parents = t["candidates"].select(F.col("parent_id").alias("candidate_id")).where("candidate_id is not null").distinct().withColumn("has_child", F.lit(True))
    current = current_revisions(t["revisions"]).select("revision_id", F.lit(True).alias("is_current"))
    parsed = t["parse_evidence"].join(latest_parses(t["parses"]), "parse_id").select("revision_id", "evidence_id", F.lit(True).alias("in_parse")).distinct()
    active = t["active"].select(F.col("candidate_id").alias("root_id"), F.lit(True).alias("is_active")).distinct()
    origins = t["candidates"].select(F.col("candidate_id").alias("root_id"), F.col("origin").alias("root_origin"))
    c = t["candidates"].join(state, "candidate_id", "left").join(parents, "candidate_id", "left")
    c = c.join(t["revisions"].select("revision_id", "source_id"), "revision_id").join(t["sources"].select("source_id", F.col("status").alias("source_status")), "source_id")
    c = c.join(current, "revision_id", "left").join(parsed, ["revision_id", "evidence_id"], "left")
    c = c.join(active, "root_id", "left").join(origins, "root_id", "left")
    no = F.lit(False)
    return c.select(
        "candidate_id",
        "root_id",
        "record_type",
        F.coalesce("outcome", F.lit("pending")).alias("state"),
        F.col("has_child").isNull().alias("leaf"),
        "source_status",
        F.coalesce("is_current", no).alias("current_revision"),
        ((F.col("record_type") == "temporal_interval") | F.coalesce("in_parse", no)).alias("current_parse"),
        ((F.coalesce("root_origin", F.lit("")) != "deterministic") | F.coalesce("is_active", no)).alias("current_derivation"),
    )


EFFECTIVE = "leaf and source_status = 'active' and current_revision and current_parse and current_derivation"


def effective_supports(t: Ledger) -> DataFrame:
    states = candidate_states(t).where(f"state = 'confirmed' and {EFFECTIVE}")
    return t["supports"].join(states.select("candidate_id", "record_type"), "candidate_id").select("object_id", "candidate_id", "record_type")


def effective_objects(t: Ledger) -> DataFrame:
    """Objects with at least one effective support and their number."""
    return effective_supports(t).groupBy("object_id").agg(F.count(F.lit(1)).alias("n_supports"))


def confirmed_unmerged(t: Ledger) -> DataFrame:
    confirmed = candidate_states(t).where("state = 'confirmed' and leaf")
    return confirmed.join(t["supports"], "candidate_id", "left_anti").select("candidate_id", "record_type")


def consolidation(t: Ledger) -> DataFrame:
    """Per record type, current leaves with and without an object."""
    merged = t["supports"].select("candidate_id", F.lit(1).alias("m")).distinct()
    c = candidate_states(t).where("leaf").join(merged, "candidate_id", "left")
    return c.groupBy("record_type").agg(F.count("m").alias("consolidated"), F.count_if(F.col("m").isNull()).alias("not_consolidated"))


def merge(eligible: DataFrame) -> DataFrame:
    """(semantic_key, candidate_id): one object per key, named by its first candidate, with all its supports."""
    return eligible.groupBy("semantic_key").agg(F.min("candidate_id").alias("first_candidate"), F.count(F.lit(1)).alias("supports_added"))


def append_new(new: DataFrame, existing: DataFrame, *keys: str) -> DataFrame:
    """Rows to append: one per key, only keys that are not there."""
    return new.dropDuplicates(list(keys)).join(existing.select(*keys), list(keys), "left_anti")
