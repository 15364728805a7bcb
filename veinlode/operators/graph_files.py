"""Graph files: profiles of time, spells inside spells, conflict nodes, and one document written in parallel.

Dates and moments can't stand in one file. ``strict`` refuses a graph that has both, ``omit`` leaves the intervals of
the other profile out, ``separate`` makes a file set for each. An edge whose spells leave those of its ends is refused
or left out in the same way. Files are written by many tasks: a header, parts in order, and an end, which give the
document when they are joined in the order of their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical_id, quoted
from veinlode.operators.reviews import GateError
from veinlode.operators.snapshots import spells_inside
from veinlode.operators.tables import settled

MODES = ("strict", "omit", "separate")
#: Fixed values of GEXF 1.3: the name space, and the attributes that nodes and edges declare.
HEADER = '<?xml version="1.0" encoding="UTF-8"?>\n<gexf xmlns="http://gexf.net/1.3" version="1.3"><graph defaultedgetype="directed" mode="%s"%s>'
ATTRIBUTES = {"node": ("kind", "object_id", "property_name", "property_value", "provenance"), "edge": ("relation_type", "provenance")}


def profile(start: Column, end: Column) -> Column:
    """dateTime or date, by the start or else the end of an interval."""
    return F.when(F.contains(F.coalesce(start, end), F.lit("T")), "dateTime").otherwise("date")


def profiles(intervals: DataFrame, mode: str) -> list[str]:
    """Profiles to make files for: of intervals(id, start, end) that have both, only ``separate`` makes two."""
    if mode not in MODES:
        raise GateError("graph_mode", 1)
    found = sorted(r[0] for r in intervals.select(profile(F.col("start"), F.col("end")).alias("p")).distinct().collect())  # two at most
    if len(found) > 1 and mode == "strict":
        raise GateError("mixed_timeformat", len(found))
    return found if len(found) > 1 and mode == "separate" else found[:1] or ["date"]


def filtered(intervals: DataFrame, of: str) -> tuple[DataFrame, DataFrame]:
    """intervals(id, start, end) of one profile, alike ones once, and (id, reason) of those left out."""
    own = profile(F.col("start"), F.col("end")) == of
    return intervals.where(own).select("id", "start", "end").distinct(), intervals.where(~own).select("id", F.lit("interval_omitted_in_profile").alias("reason"))


def conflict_elements(conflicts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """conflicts(conflict_id, label, left, right) to nodes (node, kind, label) and edges (edge, source, target, kind)."""
    nodes = conflicts.select(F.col("conflict_id").alias("node"), F.lit("conflict").alias("kind"), "label")
    ends = conflicts.select("conflict_id", F.explode(F.array("left", "right")).alias("target"))
    edge = canonical_id(F.lit("CONFLICT_EDGE"), F.concat(F.lit("["), quoted(F.col("conflict_id")), F.lit(","), quoted(F.col("target")), F.lit("]")))
    return nodes, ends.select(edge.alias("edge"), F.col("conflict_id").alias("source"), "target", F.lit("conflicts_with").alias("kind"))


def placed_edges(edges: DataFrame, edge_spells: DataFrame, node_spells: DataFrame, mode: str) -> tuple[DataFrame, DataFrame]:
    """edges(edge, source, target, ...), edge_spells(id, start, end) and node_spells(id, start, end) to the edges whose
    spells lie inside those of both ends, and (edge, reason) of the others; ``strict`` refuses these."""
    each = edge_spells.select(F.col("id").alias("edge"), "start", "end")
    ends = edges.select("edge", F.explode(F.array("source", "target")).alias("node")).distinct()
    both = each.join(ends, "edge").withColumn("end_of", F.to_json(F.array("edge", "node")))  # each end is asked by itself
    inside = spells_inside(both.select(F.col("end_of").alias("edge"), "node", "start", "end"), node_spells.select(F.col("id").alias("node"), "start", "end"))
    lost = inside.where("not contained").select(F.col("edge").alias("end_of"))
    out = settled(both.join(lost, "end_of", "left_semi").select("edge").distinct())
    n = out.count()
    if n and mode == "strict":
        raise GateError("edge_outside_node_spells", n)
    return edges.join(out, "edge", "left_anti"), out.select("edge", F.lit("edge_omitted_outside_node_spells").alias("reason"))


def _escaped(text: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def _attribute(name: str, value: Column) -> Column:
    return F.when(value.isNotNull(), F.concat(F.lit(f" {name}=\""), _escaped(value), F.lit('"'))).otherwise("")


def _spells(own: DataFrame) -> DataFrame:
    """(id, spells): the spells element of each, in the order of starts; an element's spells are its own few."""
    one = F.concat(F.lit("<spell"), _attribute("start", F.col("start")), _attribute("end", F.col("end")), F.lit("/>"))
    ordered = F.array_sort(F.collect_list(F.struct(F.coalesce("start", F.lit("")).alias("s"), F.coalesce("end", F.lit("")).alias("e"), one.alias("x"))))
    return own.groupBy("id").agg(F.concat(F.lit("<spells>"), F.array_join(F.transform(ordered, lambda x: x["x"]), ""), F.lit("</spells>")).alias("spells"))


def elements(rows: DataFrame, tag: str, ident: str, attributes: dict[str, Column], values: dict[str, Column], spells: DataFrame | None) -> DataFrame:
    """(id, value): the XML element of every row, with its attribute values and spells."""
    shown = [F.when(v.isNotNull(), F.concat(F.lit(f'<attvalue for="{k}" value="'), _escaped(v), F.lit('"/>'))) for k, v in values.items()]
    df = rows.withColumn("_id", F.col(ident))
    df = df.join(_spells(spells).select(F.col("id").alias("_id"), F.col("spells").alias("_spells")), "_id", "left") if spells is not None else df.withColumn("_spells", F.lit(None).cast("string"))
    head = F.concat(F.lit(f'<{tag} id="'), _escaped(F.col("_id")), F.lit('"'), *[_attribute(k, v) for k, v in attributes.items()], F.lit(">"))
    return df.select(F.col("_id").alias("id"), F.concat(head, F.lit("<attvalues>"), F.array_join(F.array_compact(F.array(*shown)), ""), F.lit("</attvalues>"), F.coalesce("_spells", F.lit("")), F.lit(f"</{tag}>")).alias("value"))


def write(path: str, nodes: DataFrame, edges: DataFrame, dynamic: bool, of: str = "date") -> None:
    """``elements`` of nodes and edges as a document under ``path``: the parts of 1-nodes and 3-edges are in the order of
    ids, and the files joined by name are the document."""
    spark = nodes.sparkSession
    declared = "".join(f'<attributes class="{k}" mode="static">' + "".join(f'<attribute id="{n}" title="{n}" type="string"/>' for n in names) + "</attributes>" for k, names in ATTRIBUTES.items())
    fixed = {"0-head": HEADER % (("dynamic", f' timeformat="{of}"') if dynamic else ("static", "")) + declared + "<nodes>", "2-middle": "</nodes><edges>", "4-end": "</edges></graph></gexf>"}
    for name, text in fixed.items():
        spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/{name}")
    for name, df in (("1-nodes", nodes), ("3-edges", edges)):
        df.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "id").sortWithinPartitions("id").select("value").write.mode("overwrite").text(f"{path}/{name}")
