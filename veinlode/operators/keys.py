"""Columns and foreign keys resolved against declared structure.

Every look-up is an equi-join of distinct names on exploded suffixes; a column is looked up after its table, and a
foreign key takes the worst of the statuses of its parts. The result doesn't depend on the order of rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinlode.functions.identity import segments, suffixes
from veinlode.operators.tables import settled

#: Statuses from good to bad, as far as parts of a reference have them.
_RANK = {"resolved": 0, "unresolved": 1, "ambiguous": 2}


def _key(name: Column) -> Column:
    """Segments as one text; no segment can hold the separator."""
    return F.array_join(segments(name), "\x1f")


def _suffix_keys(name: Column) -> Column:
    return F.transform(suffixes(F.transform(segments(name), lambda s: F.replace(s, F.lit("."), F.lit("\x1e")))), lambda s: F.replace(F.replace(s, F.lit("."), F.lit("\x1f")), F.lit("\x1e"), F.lit(".")))


def _looked_up(names: DataFrame, declared: DataFrame) -> DataFrame:
    """names(name) against declared(name, signature): status, reason, canonical and key of each name."""
    d = declared.select(F.col("name").alias("target"), _key(F.col("name")).alias("whole"), "signature", F.explode(_suffix_keys(F.col("name"))).alias("key"))
    per_key = d.groupBy("key").agg(F.count_distinct("whole", "signature").alias("n"), F.min("target").alias("target"))
    found = names.select("name", _key(F.col("name")).alias("key")).join(per_key, "key", "left")
    n = F.col("n")
    status = F.when(n.isNull(), "unresolved").when(n == 1, "resolved").otherwise("ambiguous")
    reason = F.when(n.isNull(), "target_absent").when(n == 1, "unique_declaration").otherwise("multiple_targets")
    return found.select("name", status.alias("status"), reason.alias("reason"), F.when(n == 1, F.col("target")).alias("canonical"))


def tables_with_columns(tables: DataFrame, columns: DataFrame) -> DataFrame:
    """tables(name, revision_id, data) with a signature that takes in the columns that its revision declares for it.

    Columns are folded by an order-free sum of hashes, so a table's columns never meet in one row."""
    own = columns.groupBy(F.col("table").alias("name"), "revision_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("name", "data").cast("decimal(38,0)")).alias("h"))
    return tables.join(own, ["name", "revision_id"], "left").select("name", F.concat_ws("|", "data", F.coalesce("n", F.lit(0)).cast("string"), F.col("h").cast("string")).alias("signature"))


def resolve_tables(names: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """names(name) to status, reason and canonical name."""
    return _looked_up(names.select("name").distinct(), tables_with_columns(tables, columns))


def resolve_columns(names: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """names(name as table.column) to status, reason, canonical; a column counts only if its tables are resolved.

    A name without declaration says whether its table is known (``column_absent_from_schema``), ambiguous or absent."""
    names = names.select("name").distinct()
    first = _looked_up(names, columns.select("name", F.col("data").alias("signature")))
    parents = names.select("name", _key(F.col("name")).alias("key"))
    declared = columns.select("table", F.explode(_suffix_keys(F.col("name"))).alias("key")).distinct()
    own = parents.join(declared, "key").select("name", F.col("table").alias("parent"))
    parts = F.regexp_extract_all(F.col("name"), F.lit(r'("[^"]*"|`[^`]*`|\[[^\]]*\]|[^.]+)'), F.lit(1))
    lost = first.where("status = 'unresolved'").select("name", F.when(F.size(parts) > 1, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ".")).alias("parent"))
    above = own.unionByName(lost)
    known = resolve_tables(above.select(F.col("parent").alias("name")).where("name is not null"), tables, columns)
    per = above.join(known.select(F.col("name").alias("parent"), F.col("status").alias("p")), "parent").groupBy("name").agg(F.max_by("p", _rank(F.col("p"))).alias("p"))
    out = first.join(per, "name", "left")
    lacking, p = F.col("status") == "unresolved", F.col("p")
    blocked = (~lacking & (p != "resolved")) | (lacking & (p == "ambiguous"))
    blocked = F.coalesce(blocked, F.lit(False))
    status = F.when(blocked, "ambiguous").otherwise(F.col("status"))
    reason = F.when(blocked, "column_parent_ambiguous").when(lacking & (p == "resolved"), "column_absent_from_schema").otherwise(F.col("reason"))
    return out.select("name", status.alias("status"), reason.alias("reason"), F.when(status == "resolved", F.col("canonical")).alias("canonical"))


def _rank(status: Column) -> Column:
    return F.coalesce(*[F.when(status == s, k) for s, k in _RANK.items()])


def inferred_keys(keys: DataFrame) -> DataFrame:
    """keys(table, columns) to the one column list of tables whose primary keys all say the same."""
    per = keys.groupBy(_key(F.col("table")).alias("key")).agg(F.count_distinct("columns").alias("n"), F.min("columns").alias("inferred"))
    return per.where("n = 1").select("key", "inferred")


def resolve_foreign_keys(links: DataFrame, tables: DataFrame, columns: DataFrame, keys: DataFrame) -> DataFrame:
    """links(link_id, table, columns, target_table, target_columns) to status, reason, source, canonical target and
    target columns. Without target columns those of the target's primary key are taken, if it has just one."""
    ends = links.select(F.explode(F.array("table", "target_table")).alias("name"))
    ends = settled(resolve_tables(ends, tables, columns))
    side = lambda p: ends.select(F.col("name").alias(p), F.col("status").alias(f"{p}_status"), F.col("canonical").alias(f"{p}_name"))
    df = links.join(side("table"), "table").join(side("target_table"), "target_table")
    df = df.withColumn("key", _key(F.col("target_table_name"))).join(inferred_keys(keys), "key", "left")
    given = F.size("target_columns") > 0
    df = df.withColumn("to", F.when(given, F.col("target_columns")).otherwise(F.coalesce("inferred", F.array().cast("array<string>"))))
    df = settled(df)
    dotted = lambda cols, table, known: F.transform(cols, lambda c: F.concat(F.coalesce(known, table), F.lit("."), c))
    needed = F.concat(dotted(F.col("columns"), F.col("table"), F.col("table_name")), dotted(F.col("to"), F.col("target_table"), F.col("target_table_name")))
    each = df.select("link_id", F.explode(needed).alias("name"))
    found = resolve_columns(each, tables, columns).select("name", _rank(F.col("status")).alias("r"))
    worst = each.join(found, "name").groupBy("link_id").agg(F.max("r").alias("r"))
    df = df.join(worst, "link_id", "left")
    r = F.greatest(_rank(F.col("table_status")), _rank(F.col("target_table_status")), F.coalesce("r", F.lit(0)))
    arity = (given & (F.size("columns") != F.size("to"))) | (F.size("columns") == 0)
    status = F.when(arity, "inconsistent").when(r == 2, "ambiguous").when((r == 1) | (F.size("to") == 0), "unresolved").otherwise("resolved")
    reason = (
        F.when(arity, "foreign_key_arity")
        .when(r == 2, "foreign_key_ambiguous_endpoint")
        .when(F.size("to") == 0, "foreign_key_target_key_unknown")
        .when(r == 1, "foreign_key_missing_endpoint")
        .otherwise("foreign_key_endpoints_verified")
    )
    return df.select("link_id", status.alias("status"), reason.alias("reason"), F.col("table_name").alias("source"), F.when(status == "resolved", F.col("target_table_name")).alias("canonical"), F.col("to").alias("target_columns"))
