"""The driver's tables staged as ledger inputs, deterministically, in both engines.

``ledger`` and friends build DataFrames; ``SQL`` has the same staging as common table expressions for the oracle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """Sources and revisions from documents, reviews from labels; every third document has a correction chain."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    labels = read(spark, sf_dir, "labels")
    i = F.col("doc_id")
    text = lambda p, *more: F.concat(F.lit(p), i.cast("string"), *more)
    sources = docs.select(text("S").alias("source_id"), F.concat("source", F.lit("/"), i.cast("string")).alias("path"), F.when(i % 13 == 0, "missing").otherwise("active").alias("status"))
    first = docs.select(text("R", F.lit("-1")).alias("revision_id"), text("S").alias("source_id"), F.lit(1).cast("long").alias("seq"), "doc_id")
    second = docs.where(i % 5 == 0).select(text("R", F.lit("-2")).alias("revision_id"), text("S").alias("source_id"), F.lit(2).cast("long").alias("seq"), "doc_id")
    revisions = first.union(second)
    r = F.col("revision_id")
    p1 = revisions.select(F.concat(r, F.lit("-p1")).alias("parse_id"), "revision_id", F.lit(1).cast("long").alias("seq"), F.lit("success").alias("status"), "doc_id")
    p2 = revisions.where(i % 7 == 0).select(F.concat(r, F.lit("-p2")).alias("parse_id"), "revision_id", F.lit(2).cast("long").alias("seq"), F.when(i % 2 == 0, "error").otherwise("partial").alias("status"), "doc_id")
    parses = p1.union(p2)
    parse_evidence = parses.where((F.col("seq") == 1) | (i % 3 == 0)).select("parse_id", F.concat(F.lit("E-"), "revision_id").alias("evidence_id"))
    kind = F.when(i % 11 == 0, "temporal_interval").when(i % 4 == 0, "candidate_fact").when(i % 4 == 1, "candidate_relation").when(i % 4 == 2, "candidate_mapping").otherwise("candidate_question")
    origin = F.when(i % 3 == 0, "deterministic").otherwise("ai")
    roots = revisions.select(F.concat(F.lit("C-"), r).alias("candidate_id"), F.lit(None).cast("string").alias("parent_id"), F.concat(F.lit("C-"), r).alias("root_id"), "revision_id", F.concat(F.lit("E-"), r).alias("evidence_id"), kind.alias("record_type"), origin.alias("origin"), "doc_id")
    fixes = roots.where(i % 6 == 0).select(F.concat("candidate_id", F.lit("-x")).alias("candidate_id"), F.col("candidate_id").alias("parent_id"), "root_id", "revision_id", "evidence_id", "record_type", F.lit("human_correction").alias("origin"), "doc_id")
    candidates = roots.union(fixes)
    judged = roots.join(labels, "doc_id")
    reviews = judged.select("candidate_id", F.lit(1).cast("long").alias("seq"), F.when(F.col("quality") == 1, "confirmed").otherwise("rejected").alias("outcome"))
    reviews = reviews.union(judged.where("toxic = 1").select("candidate_id", F.lit(2).cast("long").alias("seq"), F.lit("rejected").alias("outcome")))
    reviews = reviews.union(fixes.select("candidate_id", F.lit(1).cast("long").alias("seq"), F.lit("confirmed").alias("outcome")))
    supports = candidates.where(i % 17 != 0).select(F.concat(F.lit("O"), (i % 200).cast("string")).alias("object_id"), "candidate_id")
    active = roots.where(i % 9 != 0).select("candidate_id")
    return {"sources": sources, "revisions": revisions, "parses": parses, "parse_evidence": parse_evidence, "candidates": candidates, "reviews": reviews, "supports": supports, "active": active}


SQL = """
sources AS (SELECT 'S' || doc_id AS source_id, source || '/' || doc_id AS path, CASE WHEN doc_id % 13 = 0 THEN 'missing' ELSE 'active' END AS status FROM documents),
revisions AS (
  SELECT 'R' || doc_id || '-1' AS revision_id, 'S' || doc_id AS source_id, 1 AS seq, doc_id FROM documents
  UNION ALL SELECT 'R' || doc_id || '-2', 'S' || doc_id, 2, doc_id FROM documents WHERE doc_id % 5 = 0),
parses AS (
  SELECT revision_id || '-p1' AS parse_id, revision_id, 1 AS seq, 'success' AS status, doc_id FROM revisions
  UNION ALL SELECT revision_id || '-p2', revision_id, 2, CASE WHEN doc_id % 2 = 0 THEN 'error' ELSE 'partial' END, doc_id FROM revisions WHERE doc_id % 7 = 0),
parse_evidence AS (SELECT parse_id, 'E-' || revision_id AS evidence_id FROM parses WHERE seq = 1 OR doc_id % 3 = 0),
roots AS (
  SELECT 'C-' || revision_id AS candidate_id, NULL::VARCHAR AS parent_id, 'C-' || revision_id AS root_id, revision_id, 'E-' || revision_id AS evidence_id,
    CASE WHEN doc_id % 11 = 0 THEN 'temporal_interval' WHEN doc_id % 4 = 0 THEN 'candidate_fact' WHEN doc_id % 4 = 1 THEN 'candidate_relation'
         WHEN doc_id % 4 = 2 THEN 'candidate_mapping' ELSE 'candidate_question' END AS record_type,
    CASE WHEN doc_id % 3 = 0 THEN 'deterministic' ELSE 'ai' END AS origin, doc_id
  FROM revisions),
candidates AS (
  SELECT * FROM roots
  UNION ALL SELECT candidate_id || '-x', candidate_id, root_id, revision_id, evidence_id, record_type, 'human_correction', doc_id FROM roots WHERE doc_id % 6 = 0),
reviews AS (
  SELECT candidate_id, 1 AS seq, CASE WHEN quality = 1 THEN 'confirmed' ELSE 'rejected' END AS outcome FROM roots JOIN labels USING (doc_id)
  UNION ALL SELECT candidate_id, 2, 'rejected' FROM roots JOIN labels USING (doc_id) WHERE toxic = 1
  UNION ALL SELECT candidate_id, 1, 'confirmed' FROM candidates WHERE parent_id IS NOT NULL),
supports AS (SELECT 'O' || (doc_id % 200) AS object_id, candidate_id FROM candidates WHERE doc_id % 17 <> 0),
active AS (SELECT candidate_id FROM roots WHERE doc_id % 9 <> 0),
latest AS (SELECT revision_id, arg_max(parse_id, seq) AS parse_id FROM parses WHERE status IN ('success', 'partial') GROUP BY revision_id),
cur AS (SELECT source_id, arg_max(revision_id, seq) AS revision_id FROM revisions GROUP BY source_id),
head AS (SELECT candidate_id, arg_max(outcome, seq) AS outcome FROM reviews GROUP BY candidate_id),
states AS (
  SELECT c.candidate_id, c.root_id, c.record_type, coalesce(h.outcome, 'pending') AS state,
    NOT EXISTS (SELECT 1 FROM candidates k WHERE k.parent_id = c.candidate_id) AS leaf,
    s.status AS source_status,
    EXISTS (SELECT 1 FROM cur WHERE cur.revision_id = c.revision_id) AS current_revision,
    c.record_type = 'temporal_interval' OR EXISTS (SELECT 1 FROM latest l JOIN parse_evidence e ON e.parse_id = l.parse_id WHERE l.revision_id = c.revision_id AND e.evidence_id = c.evidence_id) AS current_parse,
    NOT EXISTS (SELECT 1 FROM roots r WHERE r.candidate_id = c.root_id AND r.origin = 'deterministic') OR EXISTS (SELECT 1 FROM active a WHERE a.candidate_id = c.root_id) AS current_derivation
  FROM candidates c LEFT JOIN head h USING (candidate_id) JOIN revisions r USING (revision_id) JOIN sources s USING (source_id)),
eff AS (
  SELECT u.object_id, u.candidate_id, t.record_type FROM supports u JOIN states t USING (candidate_id)
  WHERE state = 'confirmed' AND leaf AND source_status = 'active' AND current_revision AND current_parse AND current_derivation)
"""


def part_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Facts: the brand of a part, slot by its name."""
    return read(spark, sf_dir, "part").select(F.col("p_partkey").alias("fact_id"), F.col("p_name").alias("slot"), F.col("p_brand").alias("value"))


def part_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First to last shipping day of two thirds of the parts."""
    l = read(spark, sf_dir, "lineitem").where("l_partkey % 3 <> 0")
    return l.groupBy(F.col("l_partkey").alias("fact_id")).agg(F.to_date(F.min("l_shipdate")).alias("start"), F.to_date(F.min("l_shipdate") + F.expr("interval 200 days")).alias("end"))


def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    line = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit(" "), F.when(F.col("event_id") % 5 == 0, "ERROR").otherwise("INFO"), F.lit(" app."), F.col("event_type"), F.lit(" Event user="), F.col("user_id").cast("string"), F.lit(" kind="), F.col("event_type"), F.lit(" user="), (F.col("user_id") + 1).cast("string"))
    return e.select("event_id", F.when(F.col("event_id") % 101 == 0, "no log line").otherwise(line).alias("line"), "props")


LOG_SQL = """lines AS (SELECT event_id, props, CASE WHEN event_id % 101 = 0 THEN 'no log line' ELSE
  strftime(ts, '%Y-%m-%dT%H:%M:%S') || ' ' || CASE WHEN event_id % 5 = 0 THEN 'ERROR' ELSE 'INFO' END || ' app.' || event_type || ' Event user=' || user_id || ' kind=' || event_type || ' user=' || (user_id + 1) END AS line FROM events)"""
