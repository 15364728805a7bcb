"""Which interpretation of a revision is in force, and parsing in two passes.

A parse is kept under the version of everything it depends on: options and, for files that need it, the schema that other
files declare. The schema's hash is a sum over its tables, so that a file's own tables are taken out of it by
subtraction instead of hashing the rest of the schema once a file. Nothing is updated: an older interpretation comes
back into force as one more row of the log, with its evidence copied, and every point of the log can be looked up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical, canonical_id
from veinlode.functions.identity import digest
from veinlode.operators.tables import settled
from veinlode.sources import sql_text

#: Fixed value: words that make a file's parse depend on the schema, in any letter case.
NEEDS_SCHEMA = r"(?i)\b(?:PROCEDURE|FUNCTION|TRIGGER|VIEW|SELECT|UPDATE|INSERT|DELETE|MERGE|BEGIN|DECLARE)\b"
GOOD = ("success", "partial")
#: Rows of the schema up to which it is broadcast to the second pass.
SMALL_SCHEMA = 100_000


def needs_schema(text: Column) -> Column:
    return text.rlike(NEEDS_SCHEMA)


def parse_order(files: DataFrame) -> DataFrame:
    """files(path, text) in the order of a listing: those that create a table first, then by path. Results don't
    depend on it, see ``two_pass``."""
    later = ~F.coalesce(F.col("text").rlike(r"(?i)CREATE\s+TABLE"), F.lit(False))
    return files.select("path", later.alias("later")).orderBy("later", "path")


def table_hashes(columns: DataFrame) -> DataFrame:
    """columns(table, column) to (table, h1, h2): sums over the table's distinct columns, whatever their order."""
    own = columns.select("table", "column").distinct()
    part = lambda seed: F.sum(F.xxhash64(F.lit(seed), "table", "column").cast("decimal(38,0)"))
    return own.groupBy("table").agg(part(1).alias("h1"), part(2).alias("h2"))


def parser_versions(revisions: DataFrame, columns: DataFrame, options: Column) -> DataFrame:
    """revisions(revision_id, text) and columns(revision_id, table, column) with options as JSON text: the version
    that each revision's parse has now.

    Tables that a revision declares itself are no part of its version, and files without need of a schema keep theirs
    when the schema changes."""
    hashes = settled(table_hashes(columns))
    total = hashes.agg(F.coalesce(F.sum("h1"), F.lit(0)).alias("t1"), F.coalesce(F.sum("h2"), F.lit(0)).alias("t2"))  # one row
    local = columns.select("revision_id", "table").distinct().join(hashes, "table").groupBy("revision_id").agg(F.sum("h1").alias("l1"), F.sum("h2").alias("l2"))
    t1, t2 = total.first()
    df = revisions.select("revision_id", needs_schema(F.col("text")).alias("needs")).join(local, "revision_id", "left")
    rest = F.concat_ws(":", *[(F.lit(t) - F.coalesce(c, F.lit(0))).cast("decimal(38,0)").cast("string") for t, c in ((t1, "l1"), (t2, "l2"))])
    schema = F.when(F.col("needs"), rest).otherwise("none")
    return df.select("revision_id", F.concat(F.lit("deterministic-parser/4:"), digest(F.concat_ws("|", canonical(options), schema))).alias("parser_version"))


def in_force(parses: DataFrame, at: Column | None = None) -> DataFrame:
    """parses(parse_id, revision_id, seq, status): the good parse of each revision that is in force, now or as of the
    point ``at`` of the log."""
    good = parses.where(F.col("status").isin(*GOOD))
    good = good if at is None else good.where(F.col("seq") <= at)
    return good.groupBy("revision_id").agg(F.max_by("parse_id", "seq").alias("parse_id"))


def validity(parses: DataFrame) -> DataFrame:
    """(revision_id, parse_id, since, until): when each good parse was in force, ``until`` excluded and null at the
    end. A revision's parses are put in order by themselves."""
    following = F.lead("seq").over(Window.partitionBy("revision_id").orderBy("seq"))
    return parses.where(F.col("status").isin(*GOOD)).select("revision_id", "parse_id", F.col("seq").alias("since"), following.alias("until"))


def decisions(versions: DataFrame, parses: DataFrame, retry: bool = False) -> DataFrame:
    """What each revision needs under its version: ``parse``, ``reuse`` of the parse in force, or ``reactivate`` an
    older one (``cached`` is that one)."""
    good = parses.where(F.col("status").isin(*GOOD))
    cached = good.groupBy("revision_id", "parser_version").agg(F.max_by("parse_id", "seq").alias("cached"))
    now = in_force(parses).withColumnRenamed("parse_id", "current")
    df = versions.join(cached, ["revision_id", "parser_version"], "left").join(now, "revision_id", "left")
    action = F.when(F.col("cached").isNull() | F.lit(retry), "parse").when(F.col("cached") == F.col("current"), "reuse").otherwise("reactivate")
    return df.select("revision_id", "parser_version", action.alias("action"), F.when(action != "parse", F.col("cached")).alias("cached"))


def activations(decided: DataFrame, parses: DataFrame, evidence: DataFrame, seq: int) -> tuple[DataFrame, DataFrame]:
    """Rows to append to parses and to parse_evidence(parse_id, evidence_id) for the revisions to reactivate; ``seq``
    is the point of the log."""
    old = parses.select(F.col("parse_id").alias("cached"), "status")
    name = F.to_json(F.array("revision_id", "parser_version", F.lit(str(seq))))
    again = decided.where("action = 'reactivate'").join(old, "cached").withColumn("parse_id", canonical_id(F.lit("PARSE"), name))
    rows = again.select("parse_id", "revision_id", F.lit(seq).cast("long").alias("seq"), "status", "parser_version", F.col("cached").alias("cached_from"))
    copied = again.select("parse_id", "cached").join(evidence.withColumnRenamed("parse_id", "cached"), "cached").select("parse_id", "evidence_id")
    return rows, copied


def declared(files: DataFrame) -> DataFrame:
    """First pass: files(path, text) to the columns (path, table, column) that their CREATE TABLE statements declare."""
    found = sql_text.statements(files).withColumn("kind", sql_text.kind(F.col("bare"))).where("kind = 'create_table'")
    return found.select("path", sql_text.written(F.col("bare")).alias("table"), F.explode(sql_text.table_columns(F.col("bare"))).alias("c")).select("path", "table", F.col("c.name").alias("column")).distinct()


def two_pass(files: DataFrame, small: int = SMALL_SCHEMA) -> DataFrame:
    """Every table that a statement reads, against the declarations of all files: (path, ordinal, table, scope, columns).

    The schema of all files is built first, so the result is the same for every order of files. It is broadcast only
    when it has at most ``small`` tables, and joined otherwise. ``scope`` is local (declared by the file itself),
    external, or undeclared."""
    columns = settled(declared(files))
    tables = settled(columns.groupBy("table").agg(F.count_distinct("column").alias("columns")))
    schema = F.broadcast(tables) if tables.count() <= small else tables
    local = columns.select("path", "table").distinct().withColumn("local", F.lit(True))
    reads = sql_text.statements(files).select("path", "ordinal", F.explode(sql_text.read_tables(F.col("bare"))).alias("table"))
    found = reads.join(schema, "table", "left").join(local, ["path", "table"], "left")
    scope = F.when(F.col("local"), "local").when(F.col("columns").isNotNull(), "external").otherwise("undeclared")
    return found.select("path", "ordinal", "table", scope.alias("scope"), F.coalesce("columns", F.lit(0)).alias("columns"))
