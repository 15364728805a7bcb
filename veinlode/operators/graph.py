"""Graph of entities, sources and facts, as node and edge tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def build(facts: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """facts(fact_id, entity, source, start, end), relations(source, type, target) to nodes and edges.

    Entities come from facts and both ends of relations. A fact mentions its entity and derives from its source. An
    entity has spells only if every fact of it is dated, so that an undated fact does not shorten its life.
    """
    key = lambda kind, c: F.concat(F.lit(f"{kind}:"), F.col(c).cast("string"))
    dated = F.col("start").isNotNull() | F.col("end").isNotNull()
    own = facts.groupBy("entity").agg(F.bool_and(dated).alias("all_dated"), F.min("start").alias("start"), F.max("end").alias("end"))
    ends = relations.select(F.col("source").alias("entity")).union(relations.select("target")).distinct()
    entities = own.join(ends, "entity", "full_outer").select(key("entity", "entity").alias("node"), F.lit("entity").alias("kind"), F.when(F.col("all_dated"), F.col("start")).alias("start"), F.when(F.col("all_dated"), F.col("end")).alias("end"))
    sources = facts.select(key("source", "source").alias("node"), F.lit("source").alias("kind")).distinct()
    fact_nodes = facts.select(key("fact", "fact_id").alias("node"), F.lit("fact").alias("kind"), "start", "end")
    nodes = entities.unionByName(fact_nodes).unionByName(sources, allowMissingColumns=True)
    edges = relations.select(key("entity", "source").alias("source"), F.col("type").alias("kind"), key("entity", "target").alias("target"))
    edges = edges.union(facts.select(key("fact", "fact_id"), F.lit("mentions"), key("entity", "entity")))
    edges = edges.union(facts.select(key("fact", "fact_id"), F.lit("derives_from"), key("source", "source")))
    return nodes, edges.distinct()


def gexf_lines(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and edge elements of a GEXF file as lines, written in parallel with ``write.text``."""
    esc = lambda c: F.replace(F.replace(F.replace(F.col(c), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit('"'), F.lit("&quot;"))
    n = nodes.select(F.format_string('<node id="%s" label="%s"/>', esc("node"), esc("kind")).alias("value"))
    e = edges.select(F.format_string('<edge source="%s" target="%s" label="%s"/>', esc("source"), esc("target"), esc("kind")).alias("value"))
    return n, e
