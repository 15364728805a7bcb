"""Merging confirmed candidates into objects by the canonical form of what they say.

Five record types become objects; their key is the hash of kind and semantic content (names folded, attributes in
canonical form), so candidates that say the same are supports of one object whatever their spelling, their key order
or the order of rows. Everything is a projection, two aggregates and two anti joins on hashes.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical_id, field, json_object, parsed, quoted, text_at
from veinlode.functions.identity import digest, name_key
from veinlode.operators.ledger import EFFECTIVE
from veinlode.operators.reviews import require_none
from veinlode.operators.tables import settled

#: Record type to kind of object and prefix of its id, and the fields of an interval.
KINDS = {
    "candidate_fact": ("fact", "FACT"),
    "candidate_relation": ("relation", "REL"),
    "candidate_mapping": ("mapping", "MAP"),
    "candidate_question": ("question", "QUESTION"),
    "temporal_interval": ("interval", "INT"),
}
INTERVAL_FIELDS = ("target_subject_type", "target_subject_id", "normalized_start", "normalized_end", "original_precision", "timezone_status", "timezone_value", "bounds_semantics")
ELIGIBLE = f"state = 'confirmed' and {EFFECTIVE}"
MAX_INTERVALS = 1000


@dataclass
class Merged:
    objects: DataFrame  #: new ones: object_id, kind, semantic_key, payload, subject
    supports: DataFrame  #: new ones: object_id, candidate_id
    skipped: DataFrame  #: candidate_id, reason
    refusals: DataFrame  #: reason: one row per violation that forbids the whole merge


def _said(v: Column) -> dict[str, tuple[Column, Column]]:
    """Per record type: what its identity is made of, and what the object keeps, as canonical texts."""
    own = lambda k: field(v, f"$.{k}")
    name = lambda k: F.col(f"_name_{k}")
    attributes = F.coalesce(own("attributes"), F.lit("{}"))
    held = lambda *ks: {k: own(k) for k in (*ks, "assertion_type", "confidence")}
    basis = F.coalesce(own("question_basis"), F.lit('"derived_gap"'))
    status = F.coalesce(own("question_status"), F.lit('"open"'))
    asked = quoted(F.regexp_replace(text_at(v, "$.question_text"), r"^\s+|\s+$", ""))
    interval = json_object(**{k: own(k) for k in INTERVAL_FIELDS})
    return {
        "candidate_fact": (
            json_object(entity_name=name("entity_name"), property_name=name("property_name"), property_value=own("property_value"), fact_type=own("fact_type"), attributes=attributes),
            json_object(**held("entity_name", "property_name", "property_value", "fact_type"), attributes=attributes),
        ),
        "candidate_relation": (
            json_object(**{k: name(k) for k in ("source_entity", "relation_type", "target_entity")}, attributes=attributes),
            json_object(**held("source_entity", "relation_type", "target_entity"), attributes=attributes),
        ),
        "candidate_mapping": (json_object(**{k: name(k) for k in ("domain_entity", "technical_object", "mapping_type")}), json_object(**held("domain_entity", "technical_object", "mapping_type"))),
        "candidate_question": (
            json_object(question_type=name("question_type"), subject=name("subject"), question_text=asked, question_basis=basis, question_status=status),
            json_object(**held("question_type", "subject", "question_text"), question_basis=basis, question_status=status),
        ),
        "temporal_interval": (interval, interval),
    }


_NAMES = ("entity_name", "property_name", "source_entity", "relation_type", "target_entity", "domain_entity", "technical_object", "mapping_type", "question_type", "subject")


def keyed(candidates: DataFrame) -> DataFrame:
    """candidates(payload as JSON text, ...) with kind, semantic_key, object_id, object_payload and subject; null for
    record types that don't become objects."""
    v = F.col("_v")
    df = candidates.withColumn("_v", parsed(F.col("payload")))
    df = df.withColumns({"_type": text_at(v, "$.record_type"), **{f"_name_{k}": quoted(name_key(text_at(v, f"$.{k}"))) for k in _NAMES}})
    said = _said(v)
    pick = lambda values: F.coalesce(*[F.when(F.col("_type") == t, x) for t, x in values.items()])
    df = df.withColumns({
        "kind": pick({t: F.lit(k) for t, (k, _) in KINDS.items()}), "_prefix": pick({t: F.lit(p) for t, (_, p) in KINDS.items()}),
        "_semantic": pick({t: s for t, (s, _) in said.items()}), "object_payload": pick({t: p for t, (_, p) in said.items()}),
        "subject": F.when(F.col("_type") == "temporal_interval", text_at(v, "$.target_subject_id")),
    })
    df = df.withColumns({"semantic_key": digest(F.concat(F.lit('["'), F.col("kind"), F.lit('",'), F.col("_semantic"), F.lit("]"))), "object_id": canonical_id(F.col("_prefix"), F.col("_semantic"))})
    return df.select(*[F.col(f"`{c}`") for c in candidates.columns], "kind", "semantic_key", "object_id", "object_payload", "subject")


def merge_candidates(states: DataFrame, objects: DataFrame, supports: DataFrame, strict: bool = False, max_intervals: int = MAX_INTERVALS) -> Merged:
    """states(candidate_id, payload, state and the flags of the ledger) against objects(semantic_key, kind, subject)
    and supports(object_id, candidate_id) that exist.

    The candidate with the smallest id gives a new object its payload. With ``strict`` one candidate that isn't
    eligible forbids all; so does an interval beyond the budget of its subject (see ``refusals``)."""
    good = F.expr(ELIGIBLE)
    told = settled(keyed(states.where(good)).select("candidate_id", "kind", "semantic_key", "object_id", "object_payload", "subject"))
    kept = told.where("kind is not null")
    new = kept.groupBy("semantic_key").agg(F.min_by(F.struct("object_id", "kind", "object_payload", "subject"), "candidate_id").alias("o"))
    new = new.join(objects.select("semantic_key"), "semantic_key", "left_anti")
    new = new.select("o.object_id", "o.kind", "semantic_key", F.col("o.object_payload").alias("payload"), "o.subject")
    links = kept.select("object_id", "candidate_id").join(supports.select("object_id", "candidate_id"), ["object_id", "candidate_id"], "left_anti")
    out = states.where(~F.coalesce(good, F.lit(False))).select("candidate_id", F.when(F.col("leaf"), F.col("state")).otherwise("superseded").alias("reason"))
    skipped = out.unionByName(told.where("kind is null").select("candidate_id", F.lit("retained_non_materialized_type").alias("reason")))
    counted = objects.where("kind = 'interval'").select("subject", F.lit(0).alias("n")).unionByName(new.where("kind = 'interval'").select("subject", F.lit(1).alias("n")))
    over = counted.groupBy("subject").agg(F.count(F.lit(1)).alias("all"), F.sum("n").alias("new")).where((F.col("all") > max_intervals) & (F.col("new") > 0))
    refusals = over.select(F.lit("interval_budget").alias("reason"))
    if strict:
        refusals = refusals.unionByName(out.select(F.lit("strict_review").alias("reason")))
    return Merged(new, links, skipped, refusals)


def checked(merged: Merged) -> Merged:
    """The merge, or an error and nothing of it."""
    require_none(merged.refusals)
    return merged
