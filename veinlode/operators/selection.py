"""Selection of evidence for a hand-off: reasons, coverage, ranks and a budget that skips."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinlode.operators.tables import settled

#: The types of fragment that technical extraction may hand over, and review states from strong to weak.
TECHNICAL = (
    "ddl_table", "ddl_column", "ddl_constraint", "sql_function", "sql_procedure", "sql_trigger", "sql_statement", "sql_unparsed", "sql_package", "sql_package_body",
    "sql_type", "sql_type_body", "sql_java_source", "java_class", "java_method", "xml_form", "xml_field", "xml_button", "xml_button_operation", "excel_region",
)
COVERED = ("confirmed", "pending", "rejected")


def exclusion_reasons(evidence: DataFrame) -> DataFrame:
    """evidence(id, active, current, coverage, chars) with all reasons that exclude it, joined by commas."""
    why = F.array_compact(
        F.array(
            F.when(~F.col("active"), "source_inactive"),
            F.when(~F.col("current"), "not_current"),
            F.when(F.col("coverage") == "confirmed", "already_covered"),
            F.when(F.col("chars") == 0, "empty_text"),
        )
    )
    return evidence.select("id", F.array_join(why, ",").alias("reasons"))


def coverage_states(candidates: DataFrame) -> DataFrame:
    """candidates(evidence_id, state, leaf): the strongest state of the leaves of each evidence."""
    own = candidates.where("leaf and evidence_id is not null").groupBy("evidence_id").agg(*[F.bool_or(F.col("state") == s).alias(s) for s in COVERED])
    strongest = F.coalesce(*[F.when(F.col(s), s) for s in COVERED])
    return own.select("evidence_id", F.coalesce(strongest, F.lit("no_candidate")).alias("coverage"))


def priority(route: str) -> Column:
    """Rank of a kind: chunks first when a domain is interpreted, then regions of sheets, then the rest."""
    chunk = F.col("kind") == "chunk" if route == "domain_interpretation" else F.lit(False)
    return F.when(chunk, 0).when(F.col("type") == "excel_region", 1).otherwise(2).cast("long")


def selection_plan(evidence: DataFrame, candidates: DataFrame, outcomes: DataFrame, route: str, max_evidence: int, max_chars: int) -> DataFrame:
    """evidence(plan, evidence_id, path, kind, type, chars, locator, active, current), candidates(evidence_id, state,
    leaf) and outcomes(evidence_id, outcome) to evidence_id with coverage, outcome and reason_codes.

    All reasons against a row are given; the rows without any are taken in the order of priority, path and id, as far
    as the budget of their plan goes (a later, smaller row may still fit)."""
    df = evidence.join(coverage_states(candidates), "evidence_id", "left").join(outcomes.select("evidence_id", F.col("outcome").alias("derived")), "evidence_id", "left")
    df = df.withColumn("coverage", F.coalesce("coverage", F.lit("no_candidate")))
    why = [F.when(~F.col("active"), "revision_not_current_or_inactive").when(~F.col("current"), "parser_output_superseded")]
    if route == "technical_extraction":
        why += [
            F.when(F.col("kind") != "fragment", "kind_not_allowed"),
            F.when(~F.col("type").isin(*TECHNICAL), "fragment_type_not_allowed"),
            F.when(F.col("derived") == "materialized_deterministically", "deterministic_components_complete"),
            F.when(F.col("coverage") == "rejected", "governed_rejection"),
            F.when(F.coalesce(F.length("locator"), F.lit(0)) == 0, "locator_missing"),
        ]
    df = settled(df.withColumns({"codes": F.array_compact(F.array(*why)), "priority": priority(route)}))
    ranked = df.where("size(codes) = 0").select("plan", F.struct("priority", "path").alias("rank"), F.col("evidence_id").alias("id"), "chars")
    taken = greedy(ranked, max_evidence, max_chars).select(F.col("id").alias("evidence_id"), "place")
    out = df.join(taken, "evidence_id", "left")
    free, included = F.size("codes") == 0, F.col("place").isNotNull()
    codes = F.when(free & included, F.array(F.lit("included_by_policy"))).when(free, F.array(F.lit("budget_exceeded"))).otherwise(F.col("codes"))
    return out.select("plan", "evidence_id", "coverage", F.when(included, "included").otherwise("excluded").alias("outcome"), codes.alias("reason_codes"), "place")


def greedy(ranked: DataFrame, max_items: int, max_chars: int) -> DataFrame:
    """ranked(plan, rank, id, chars): in the order of rank and id, take what still fits; a later smaller row may.

    Rows are cut into ranges of that order. A plan goes on with the next range that holds a row small enough for what is
    left of its budget (the least size of every range is known), so ranges that can't add anything are never read again,
    and a round is one pass in order over at most one range of each plan, which carries budget and count along. No plan
    and no range is gathered, and there are at most as many rounds as ranges.
    """
    spark = ranked.sparkSession
    kinds = {c: ranked.schema[c].dataType.simpleString() for c in ("plan", "id")}
    key = F.to_json(F.struct("plan")).alias("key")  # a null plan is a plan
    rows = ranked.where(F.col("chars") <= max_chars).select(key, "plan", "rank", "id", F.col("chars").cast("long").alias("chars"))
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = settled(rows.repartitionByRange(n, "key", "rank", "id").withColumn("part", F.spark_partition_id()))
    least = settled(rows.groupBy("key", "part").agg(F.min("chars").alias("least")))
    state = least.select("key").distinct().select("key", F.lit(max_chars).cast("long").alias("left"), F.lit(0).cast("long").alias("count"), F.lit(-1).alias("last"))
    taken = rows.select("plan", "id", F.lit(0).cast("long").alias("place")).where("false")

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, left, count = None, 0, 0
        for batch in batches:
            out = []
            for r in batch.itertuples(index=False):
                if r.key != at:
                    at, left, count = r.key, r.left, r.before
                if count < max_items and r.chars <= left:
                    left, count = left - r.chars, count + 1
                    out.append((r.key, r.plan, r.id, count, r.chars))
            yield pd.DataFrame(out, columns=["key", "plan", "id", "place", "chars"])

    while True:
        coming = least.join(state.where(F.col("count") < max_items), "key").where("part > last and least <= left").groupBy("key", "left", "count").agg(F.min("part").alias("part"))
        coming = settled(coming)
        if coming.isEmpty():
            return taken
        now = rows.join(coming.withColumnRenamed("count", "before"), ["key", "part"]).where("chars <= left")
        now = now.repartition("key").sortWithinPartitions("key", "rank", "id").select("key", "plan", "id", "chars", "left", "before")
        got = settled(now.mapInPandas(walk, f"key string, plan {kinds['plan']}, id {kinds['id']}, place long, chars long"))
        spent = got.groupBy("key").agg(F.sum("chars").alias("spent"), F.count(F.lit(1)).alias("more"))
        moved = coming.join(spent, "key", "left").select("key", (F.col("left") - F.coalesce("spent", F.lit(0))).alias("left"), (F.col("count") + F.coalesce("more", F.lit(0))).alias("count"), F.col("part").alias("last"))
        state, taken = settled(moved), taken.unionByName(got.select("plan", "id", "place"))
