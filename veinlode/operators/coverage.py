"""Components of evidence, what should be derived from them, and what of that is there.

Rules are a table, so a registered kind is a row, not code: rules(kind, subtype, component, capability, reason). A
capability is ``supported`` (candidates are due), ``evidence_only`` or ``unsupported``; evidence without a rule has one
component, ``unclassified``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.identity import uid

#: The counters of a coverage report.
COUNTERS = (
    "expected_components", "supported_components", "due_applicable_components", "derived_components", "due_missing_components",
    "blocked_unresolved_components", "blocked_inconsistent_components", "blocked_ambiguous_components", "evidence_only_components",
    "unsupported_components", "unclassified_components", "unclassified_evidence_count", "active_evidence_count",
)


def inventory(evidence: DataFrame, rules: DataFrame, resolutions: DataFrame) -> DataFrame:
    """evidence(evidence_id, kind, subtype) to one row per component, with whether it is applicable.

    resolutions(evidence_id, component, status) holds what names were looked up for; a supported component whose
    status is another than resolved is blocked by it, one without a look-up needs none.
    """
    found = evidence.join(rules, ["kind", "subtype"], "left").join(resolutions, ["evidence_id", "component"], "left")
    known = F.col("capability").isNotNull()
    status = F.coalesce("status", F.lit("not_required"))
    blocked = (F.col("capability") == "supported") & ~status.isin("resolved", "not_required")
    applicability = F.when(blocked, "blocked_by_resolution").when(F.col("capability") == "supported", "applicable").otherwise("not_required")
    return found.select(
        "evidence_id",
        "kind",
        "subtype",
        F.coalesce("component", F.lit("unclassified")).alias("component"),
        F.coalesce("capability", F.lit("unclassified")).alias("capability"),
        F.when(known, applicability).otherwise("not_required").alias("applicability"),
        status.alias("resolution"),
        F.when(known, F.col("reason")).otherwise("unregistered_type_or_subtype").alias("reason"),
    )


def planned(components: DataFrame, payloads: DataFrame) -> DataFrame:
    """Candidates that are due: applicable components with payloads(evidence_id, component, payload); the id is a digest
    of all that makes the candidate."""
    due = components.where("applicability = 'applicable'").join(payloads, ["evidence_id", "component"])
    name = F.concat_ws("/", F.col("evidence_id").cast("string"), "component", "payload")
    return due.select("evidence_id", "component", uid("DER", name).alias("candidate_id"), "payload")


def outcomes(components: DataFrame, expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Every component with its outcome. It is derived when every candidate that is due is in actual(candidate_id,
    payload) with the very payload; one of several doesn't do."""
    there = actual.select("candidate_id", F.col("payload").alias("its"))
    met = expected.join(there, "candidate_id", "left").groupBy("evidence_id", "component")
    met = met.agg(F.bool_and(F.coalesce(F.col("payload") == F.col("its"), F.lit(False))).alias("whole"))
    outcome = (
        F.when(F.col("applicability") == "applicable", F.when(F.col("whole"), "materialized_deterministically").otherwise("due_missing"))
        .when(F.col("applicability") == "blocked_by_resolution", F.col("resolution"))
        .when(F.col("capability") == "evidence_only", "evidence_only_by_design")
        .when(F.col("capability") == "unsupported", "unsupported_with_reason")
        .otherwise("unclassified")
    )
    return components.join(met, ["evidence_id", "component"], "left").withColumn("outcome", outcome).drop("whole")


def by_evidence(found: DataFrame) -> DataFrame:
    """Outcome of each evidence: its components' if they agree, else partial."""
    per = found.groupBy("evidence_id").agg(F.count(F.lit(1)).alias("n_components"), F.min("outcome").alias("lo"), F.max("outcome").alias("hi"))
    return per.select("evidence_id", "n_components", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("partial").alias("outcome"))


def counters(found: DataFrame) -> DataFrame:
    """(counter, n) for all ``COUNTERS``, zero where nothing is counted, in one pass."""
    is_ = lambda column, value: F.count_if(F.col(column) == value)
    unknown = F.col("capability") == "unclassified"
    sums = {
        "expected_components": F.count(F.lit(1)),
        "due_applicable_components": is_("applicability", "applicable"),
        "derived_components": is_("outcome", "materialized_deterministically"),
        "due_missing_components": is_("outcome", "due_missing"),
        "unclassified_evidence_count": F.count_distinct(F.when(unknown, F.col("evidence_id"))),
        "active_evidence_count": F.count_distinct("evidence_id"),
    }
    sums |= {f"{c}_components": is_("capability", c) for c in ("supported", "evidence_only", "unsupported", "unclassified")}
    blocked = F.col("applicability") == "blocked_by_resolution"
    sums |= {f"blocked_{s}_components": F.count_if(blocked & (F.col("resolution") == s)) for s in ("unresolved", "inconsistent", "ambiguous")}
    one = found.agg(*[sums[c].alias(c) for c in COUNTERS])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("counter"), F.col(c).alias("n")) for c in COUNTERS])).alias("c")).select("c.*")


def complete(counted: DataFrame) -> DataFrame:
    """Whether nothing is unclassified or missing, and whether nothing is blocked either."""
    bad = F.col("counter").isin("unclassified_components", "due_missing_components")
    return counted.agg((F.sum(F.when(bad, F.col("n")).otherwise(0)) == 0).alias("complete"), (F.sum(F.when(bad | F.col("counter").startswith("blocked_"), F.col("n")).otherwise(0)) == 0).alias("fully_derived"))
