"""Resolution of names against declarations by equi-joins on exploded suffixes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.identity import segments, suffixes


def resolve(references: DataFrame, declared: DataFrame) -> DataFrame:
    """references(ref_id, name), declared(decl_id, name, signature) to status, target and alternatives.

    Names match when one is a suffix of the declaration's segments. Declarations that agree in name and signature
    support each other; different ones are ambiguous. The result does not depend on the order of rows.
    """
    d = declared.select("decl_id", "signature", segments(F.col("name")).alias("parts"))
    d = d.select(F.array_join("parts", ".").alias("target"), "signature", F.explode(suffixes(F.col("parts"))).alias("key"))
    per_key = d.groupBy("key").agg(F.count_distinct(F.struct("target", "signature")).alias("n"), F.min("target").alias("target"), F.count_distinct("target").alias("n_targets"))
    refs = references.select("ref_id", F.array_join(segments(F.col("name")), ".").alias("key"))
    found = refs.join(per_key, "key", "left")
    status = F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous")
    return found.select("ref_id", status.alias("status"), F.when(F.col("n") == 1, F.col("target")).alias("target"), F.coalesce("n_targets", F.lit(0)).cast("long").alias("alternatives"))


BODY = "::BODY."


def resolve_units(references: DataFrame, declared: DataFrame) -> DataFrame:
    """``resolve`` with the reason of each status; a reference that no declaration answers is looked for among the
    members that only a package's body declares, whose names hold ``BODY``. Specification and body stay apart."""
    first = resolve(references, declared)
    lost = references.join(first.where("status = 'unresolved'").select("ref_id"), "ref_id", "left_semi")
    bodies = declared.where(F.contains("name", F.lit(BODY))).withColumn("name", F.replace("name", F.lit(BODY), F.lit(".")))
    again = resolve(lost, bodies).select("ref_id", *[F.col(c).alias(f"b_{c}") for c in ("status", "target", "alternatives")])
    out = first.join(again, "ref_id", "left")
    fallback = F.coalesce(F.col("b_status") != "unresolved", F.lit(False))
    pick = lambda c: F.when(fallback, F.col(f"b_{c}")).otherwise(F.col(c)).alias(c)
    status = F.when(fallback, F.col("b_status")).otherwise(F.col("status"))
    reason = F.when(status == "unresolved", "target_absent").when(status == "ambiguous", "multiple_targets").when(fallback, "package_body_declaration").otherwise("unique_declaration")
    return out.select("ref_id", pick("status"), pick("target"), pick("alternatives"), reason.alias("reason"))


def foreign_keys(links: DataFrame, parents: DataFrame) -> DataFrame:
    """links(link_id, key), parents(key): resolved with exactly one parent, ambiguous with more, else unresolved."""
    n = parents.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    out = links.join(n, "key", "left")
    return out.select("link_id", F.when(F.col("n").isNull(), "unresolved").when(F.col("n") == 1, "resolved").otherwise("ambiguous").alias("status"))
