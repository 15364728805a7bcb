"""Snapshots, their differences, and graph checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ORDINAL = {"low": 0, "medium": 1, "high": 2}


def best_confidence(column: str):
    """Highest of low < medium < high."""
    rank = F.max(F.when(F.col(column) == "low", 0).when(F.col(column) == "medium", 1).when(F.col(column) == "high", 2))
    return F.when(rank == 0, "low").when(rank == 1, "medium").when(rank == 2, "high")


def entities(facts: DataFrame, relations: DataFrame) -> DataFrame:
    """Entities of facts(entity, property, confidence) and of both ends of relations(source, target)."""
    own = facts.groupBy("entity").agg(F.count_distinct("property").alias("n_properties"), best_confidence("confidence").alias("confidence"))
    ends = relations.select(F.col("source").alias("entity")).union(relations.select("target")).groupBy("entity").agg(F.count(F.lit(1)).alias("n_relations"))
    both = own.join(ends, "entity", "full_outer")
    return both.select("entity", F.coalesce("n_properties", F.lit(0)).cast("long").alias("n_properties"), "confidence", F.coalesce("n_relations", F.lit(0)).cast("long").alias("n_relations"))


def diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """(key, payload) on both sides to added, removed and changed keys."""
    b, a = before.select("key", F.col("payload").alias("before")), after.select("key", F.col("payload").alias("after"))
    change = F.when(F.col("before").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("before") != F.col("after"), "changed")
    return b.join(a, "key", "full_outer").withColumn("change", change).where("change is not null").select("key", "change", "before", "after")


def dangling(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with an end that is no node, and which end."""
    known = nodes.select("node").distinct()
    lost_source = edges.join(known.withColumnRenamed("node", "source"), "source", "left_anti").select("edge", F.lit("source").alias("missing"))
    lost_target = edges.join(known.withColumnRenamed("node", "target"), "target", "left_anti").select("edge", F.lit("target").alias("missing"))
    return lost_source.union(lost_target)


def spells_inside(edge_spells: DataFrame, node_spells: DataFrame) -> DataFrame:
    """edge_spells(edge, node, start, end): for each edge whether all its spells lie in some spell of its node. An open
    bound of a node holds everything on its side, and so does a node without spells; an open bound of an edge lies
    only in an open one."""
    n = node_spells.select("node", F.col("start").alias("ns"), F.col("end").alias("ne"), F.lit(True).alias("there"))
    within = lambda outer, test: outer.isNull() | F.coalesce(test, F.lit(False))
    inside = F.col("there").isNull() | (within(F.col("ns"), F.col("ns") <= F.col("start")) & within(F.col("ne"), F.col("end") <= F.col("ne")))
    spell = edge_spells.join(n, "node", "left").groupBy("edge", "start", "end").agg(F.bool_or(inside).alias("inside"))
    return spell.groupBy("edge").agg(F.bool_and("inside").alias("contained"))
