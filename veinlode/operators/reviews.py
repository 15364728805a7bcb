"""Checks of candidate batches and review requests, as error rows; a gate raises when there are any."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.identity import is_placeholder

#: The record types with the fields each must have, and the outcomes of a review.
REQUIRED = {
    "candidate_fact": ("fact_type", "entity_name", "property_name", "property_value"),
    "candidate_relation": ("source_entity", "relation_type", "target_entity"),
    "candidate_mapping": ("domain_entity", "technical_object", "mapping_type"),
    "candidate_conflict": ("conflict_type", "subject", "left_value", "right_value"),
    "candidate_question": ("question_type", "subject", "question_text"),
    "temporal_interval": ("target_subject_type", "target_subject_id", "original_precision", "timezone_status", "bounds_semantics", "temporal_evidence_ids"),
}
OUTCOMES = ("confirmed", "rejected", "pending")


class GateError(ValueError):
    def __init__(self, reason: str, rows: int):
        super().__init__(f"{reason} ({rows} rows)")
        self.reason = reason


def candidate_errors(batch: DataFrame, evidence: DataFrame) -> DataFrame:
    """batch(candidate_id, record_type, assertion_type, confidence, evidence_id, source_revision_id, evidence_text,
    attributes map) against evidence(evidence_id, revision_id, text) with every reason against each candidate: missing
    fields and enumerations (one code), placeholders in the fields of its type, evidence and its quotation."""
    get = lambda k: F.try_element_at("attributes", F.lit(k))
    own = F.coalesce(*[F.when(F.col("record_type") == kind, F.array(*[get(n) for n in names])) for kind, names in REQUIRED.items()])
    lacking = F.coalesce(F.exists(own, lambda v: F.coalesce(F.trim(v), F.lit("")) == ""), F.lit(True))
    enumerated = F.col("assertion_type").isin("explicit", "observed", "inferred", "ambiguous") & F.col("confidence").isin("low", "medium", "high")
    e = evidence.select("evidence_id", F.col("text").alias("_text"), F.col("revision_id").alias("_revision"))
    counts = batch.groupBy("candidate_id").agg(F.count(F.lit(1)).alias("_n"))
    rows = batch.join(e, "evidence_id", "left").join(counts, "candidate_id")
    quoted = F.coalesce(F.contains("_text", "evidence_text"), F.lit(False))
    bare = F.col("evidence_id").isNull() | ~F.coalesce(F.col("evidence_text").rlike(r"\S"), F.lit(False))
    reasons = F.array_compact(
        F.array(
            F.when(lacking | ~F.coalesce(enumerated, F.lit(False)), "candidate_schema"),
            F.when(F.exists(own, lambda v: F.coalesce(is_placeholder(v), F.lit(False))), "placeholder"),
            F.when(bare, "evidence_required").when(~F.coalesce(F.col("_revision") == F.col("source_revision_id"), F.lit(False)), "evidence_revision_mismatch").when(~quoted, "evidence_quote_mismatch"),
            F.when(F.col("_n") > 1, "duplicate_candidate_id"),
        )
    )
    return rows.select("candidate_id", F.explode(reasons).alias("reason"))


def request_hash(requests: DataFrame) -> DataFrame:
    """Requests with ``hash``, over all that makes a request another one."""
    text = F.to_json(F.struct("actor_id", "actor_type", "candidate_id", "outcome", "reason"), {"ignoreNullFields": "false"})
    return requests.withColumn("hash", F.sha2(text, 256))


def review_errors(requests: DataFrame, states: DataFrame, done: DataFrame, policies: DataFrame | None = None) -> DataFrame:
    """requests(key, candidate_id, outcome, expected_head, actor_id, actor_type, reason) against states(candidate_id,
    head, leaf, state, rule, current_derivation, order_error) and done(actor_type, actor_id, key, request_hash): the
    first reason in order, ``replay`` for a request that was made before, ``no_op`` for one that changes nothing.

    Keys are an actor's own. A policy may review what policies(actor_id, rule) give it, as long as the derivation is
    current; other actors than people and policies may not. A confirmed interval must not end before it starts.
    """
    spark = requests.sparkSession
    allowed = spark.createDataFrame([], "actor_id string, rule string") if policies is None else policies
    allowed = allowed.select("actor_id", "rule").distinct().withColumn("allowed", F.lit(True))
    r = request_hash(requests).join(states, "candidate_id", "left")
    r = r.join(done.select("actor_type", "actor_id", "key", F.col("request_hash").alias("before")), ["actor_type", "actor_id", "key"], "left")
    r = r.join(allowed, ["actor_id", "rule"], "left")
    may = F.col("allowed").isNotNull() & F.col("current_derivation")
    reason = (
        F.when(~F.col("outcome").isin(*OUTCOMES), "review_outcome")
        .when(F.coalesce(F.trim("actor_id"), F.lit("")) == "", "actor_required")
        .when(F.col("leaf").isNull(), "unknown_candidate")
        .when(F.col("before") == F.col("hash"), "replay")
        .when(F.col("before").isNotNull(), "idempotency_payload_conflict")
        .when(~F.col("expected_head").eqNullSafe(F.col("head")), "review_head_conflict")
        .when(~F.col("leaf"), "not_leaf")
        .when((F.col("actor_type") == "policy") & ~F.coalesce(may, F.lit(False)), "policy_not_allowed")
        .when(~F.coalesce(F.col("actor_type").isin("policy", "human"), F.lit(False)), "actor_type")
        .when((F.col("outcome") == "confirmed") & F.col("order_error").isNotNull(), F.col("order_error"))
        .when((F.col("state") == F.col("outcome")) & F.col("head").isNotNull(), "no_op")
    )
    return r.select("key", "candidate_id", reason.alias("reason"))


def auto_review(states: DataFrame, policies: DataFrame) -> DataFrame:
    """Pending current leaves whose rule is on the allow-list of an enabled policy."""
    allowed = policies.where("enabled").select("rule").distinct()
    return states.where("state = 'pending' and leaf and current_derivation").join(allowed, "rule", "left_semi")


def require_none(errors: DataFrame) -> None:
    """Raise the most frequent reason if there is any error row."""
    worst = errors.groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").first()
    if worst is not None:
        raise GateError(worst.reason, worst.n)
