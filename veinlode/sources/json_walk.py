"""JSON documents: every value with its pointer, dates of linked data, records per line, all as DataFrames.

The walk explodes one level of VARIANT values a round; documents deeper than the bound fail instead of being cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.functions.canonical import parsed
from veinlode.operators.tables import settled

MAX_DEPTH = 64

#: Keys of linked data that hold dates, and the roles of two of them.
DATE_KEYS = ("dateCreated", "dateModified", "datePublished", "validFrom", "validThrough")
ROLES = {"validFrom": "valid_from", "validThrough": "valid_to"}


class TooDeep(ValueError):
    """A document is nested deeper than the bound."""


def documents(files: DataFrame) -> DataFrame:
    """files(path, text) to path, outcome and the document in canonical form: a file is one document or an error."""
    value = parsed(F.col("text"))
    return files.select("path", F.when(value.isNotNull(), "structured_document").otherwise("invalid_json").alias("outcome"), F.to_json(value).alias("value"))


def records(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """lines(path, line, text) to the records (path, line, value) of the files that are valid throughout, and to
    (path, outcome, records, first_invalid) of every file; one invalid line fails its file. Blank lines are passed over."""
    each = lines.where(F.col("text").rlike(r"\S")).withColumn("value", parsed(F.col("text")))
    bad = F.min(F.when(F.col("value").isNull(), F.col("line")))
    files = each.groupBy("path").agg(F.count(F.lit(1)).alias("n"), bad.alias("first_invalid"))
    good = each.join(files.where("first_invalid is null").select("path"), "path", "left_semi")
    told = files.select("path", F.when(F.col("first_invalid").isNull(), "success").otherwise("error").alias("outcome"), F.when(F.col("first_invalid").isNull(), F.col("n")).otherwise(0).alias("records"), "first_invalid")
    return good.select("path", "line", F.to_json("value").alias("value")), told


def walk(docs: DataFrame, max_depth: int = MAX_DEPTH) -> DataFrame:
    """docs(id, text as JSON) to (id, pointer, key, kind, value): all members of objects and arrays, their values in
    canonical form. Text that isn't JSON gives no rows."""
    level = docs.select("id", F.lit("").alias("pointer"), parsed(F.col("text")).alias("v")).where("v is not null")
    out = None
    for depth in range(max_depth + 1):
        inside = level.select("id", "pointer", "v").lateralJoin(docs.sparkSession.tvf.variant_explode(F.col("v").outer()))
        step = F.coalesce(F.col("key"), F.col("pos").cast("string"))
        level = settled(inside.select("id", F.concat("pointer", F.lit("/"), step).alias("pointer"), "key", F.col("value").alias("v")))
        if level.isEmpty():
            break
        if depth == max_depth:
            raise TooDeep(f"a document is nested deeper than {max_depth} levels")
        found = level.select("id", "pointer", "key", F.lower(F.regexp_extract(F.schema_of_variant("v"), r"^\w+", 0)).alias("kind"), F.coalesce(F.to_json("v"), F.lit("null")).alias("value"))
        out = found if out is None else out.unionByName(found)
    if out is None:
        return level.select("id", "pointer", "key", F.lit("").alias("kind"), F.lit("").alias("value"))
    return out


def date_signals(nodes: DataFrame) -> DataFrame:
    """Dates of linked data among ``walk``'s rows: (id, location, raw_value, source_format, role, reliability)."""
    role = F.coalesce(*[F.when(F.col("key") == k, r) for k, r in ROLES.items()], F.concat(F.lit("document_"), "key"))
    dated = nodes.where(F.col("key").isin(*DATE_KEYS) & (F.col("kind") == "string"))
    text = F.try_variant_get(F.parse_json("value"), "$", "string")
    return dated.select("id", F.concat(F.lit("jsonld:"), "pointer").alias("location"), text.alias("raw_value"), F.lit("json_ld").alias("source_format"), role.alias("role"), F.lit("medium").alias("reliability"))
