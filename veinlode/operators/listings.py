"""Listings over the ledger: evidence, candidates, supports of objects with where they come from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.operators.ledger import Ledger, candidate_states, current_revisions, effective_supports, latest_parses


def evidence(t: Ledger, revision: str | None = None, historical: bool = False) -> DataFrame:
    """Evidence of latest parses with revision, source and parse; of current revisions of active sources only, unless
    ``historical`` or one revision is asked for."""
    rows = t["parse_evidence"].join(latest_parses(t["parses"]), "parse_id").join(t["revisions"].select("revision_id", "source_id", "seq"), "revision_id")
    rows = rows.join(t["sources"], "source_id")
    current = current_revisions(t["revisions"]).select("revision_id", F.lit(True).alias("current"))
    rows = rows.join(current, "revision_id", "left").withColumn("current", F.coalesce("current", F.lit(False)) & (F.col("status") == "active"))
    rows = rows.where(F.col("revision_id") == revision) if revision is not None else rows if historical else rows.where("current")
    return rows.select("evidence_id", "revision_id", "parse_id", "source_id", "path", "seq", "current")


def candidates(t: Ledger, state: str | None = None, batch: DataFrame | None = None) -> DataFrame:
    """Candidates with states, source path and whether they count; of one state, or of the members of a batch."""
    rows = candidate_states(t)
    rows = rows if state is None else rows.where(F.col("state") == state)
    rows = rows if batch is None else rows.join(batch.select("candidate_id").distinct(), "candidate_id", "left_semi")
    where = t["candidates"].select("candidate_id", "revision_id", "evidence_id", "origin").join(t["revisions"].select("revision_id", "source_id"), "revision_id")
    return rows.join(where.join(t["sources"].select("source_id", "path"), "source_id"), "candidate_id").select("candidate_id", "record_type", "origin", "state", "leaf", "current_revision", "path", "evidence_id")


def object_supports(t: Ledger) -> DataFrame:
    """Effective supports of each object in the order of their candidates, numbered from 1, with source path and
    evidence, so that an object can be traced to its sources."""
    where = t["candidates"].select("candidate_id", "revision_id", "evidence_id").join(t["revisions"].select("revision_id", "source_id"), "revision_id")
    rows = effective_supports(t).join(where.join(t["sources"].select("source_id", "path"), "source_id"), "candidate_id")
    # an object's supports are numbered as one list; supports of an object are reviewed one by one, so it stays short
    each = rows.groupBy("object_id").agg(F.array_sort(F.collect_list(F.struct("candidate_id", "record_type", "path", "evidence_id"))).alias("s"))
    return each.select("object_id", F.posexplode("s").alias("pos", "s")).select("object_id", (F.col("pos") + 1).alias("place"), "s.candidate_id", "s.record_type", "s.path", "s.evidence_id")
