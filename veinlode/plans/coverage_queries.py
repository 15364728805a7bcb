"""Queries of coverage and of listings, with DuckDB SQL beside each."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinlode.functions import intervals
from veinlode.operators import conflicts, coverage, listings, resolve
from veinlode.plans.queries import query
from veinlode.plans.staging import SQL, part_facts, read
from veinlode.plans.staging import ledger as staged

RULES = [
    ("ddl_table", "default", "declaration", "supported", "syntactic_extraction"),
    ("ddl_column", "default", "definition", "supported", "syntactic_extraction"),
    ("ddl_constraint", "primary", "declaration", "supported", "syntactic_extraction"),
    ("ddl_constraint", "foreign", "declaration", "supported", "syntactic_extraction"),
    ("ddl_constraint", "foreign", "target", "supported", "name_resolution"),
    ("document_text", "default", "retained", "evidence_only", "free_text"),
    ("sql_unparsed", "default", "unparsed", "unsupported", "syntax_not_analyzed"),
]
_VALUES = ", ".join(str(r) for r in RULES)
COVERAGE = f"""rules(kind, subtype, component, capability, reason) AS (VALUES {_VALUES}),
 ev AS (SELECT doc_id AS evidence_id, ['ddl_table', 'ddl_column', 'ddl_constraint', 'document_text', 'sql_unparsed', 'mystery'][doc_id % 6 + 1] AS kind,
  CASE WHEN doc_id % 6 = 2 THEN ['primary', 'foreign', 'odd'][(doc_id // 6) % 3 + 1] ELSE 'default' END AS subtype, lang, n_chars FROM documents),
 res AS (SELECT evidence_id, 'target' AS component, ['resolved', 'unresolved', 'ambiguous', 'inconsistent'][evidence_id % 4 + 1] AS status FROM ev),
 inv AS (SELECT ev.evidence_id, kind, subtype, coalesce(r.component, 'unclassified') AS component, coalesce(capability, 'unclassified') AS capability,
  CASE WHEN capability = 'supported' AND coalesce(status, 'not_required') NOT IN ('resolved', 'not_required') THEN 'blocked_by_resolution' WHEN capability = 'supported' THEN 'applicable' ELSE 'not_required' END AS applicability,
  coalesce(status, 'not_required') AS resolution, coalesce(reason, 'unregistered_type_or_subtype') AS reason, lang, n_chars
  FROM ev LEFT JOIN rules r USING (kind, subtype) LEFT JOIN res ON res.evidence_id = ev.evidence_id AND res.component = r.component),
 due AS (SELECT evidence_id, component, lang || ':' || n_chars AS payload, 'DER_' || substr(sha256(evidence_id || '/' || component || '/' || lang || ':' || n_chars), 1, 24) AS candidate_id FROM inv WHERE applicability = 'applicable'),
 act AS (SELECT candidate_id, CASE WHEN evidence_id % 7 = 0 THEN 'other' ELSE payload END AS payload FROM due WHERE NOT (component = 'declaration' AND evidence_id % 10 = 2)),
 fnd AS (SELECT inv.evidence_id, kind, subtype, inv.component, capability, applicability, resolution, CASE WHEN applicability = 'applicable' THEN CASE WHEN coalesce(act.payload = due.payload, false) THEN 'materialized_deterministically' ELSE 'due_missing' END
   WHEN applicability = 'blocked_by_resolution' THEN resolution WHEN capability = 'evidence_only' THEN 'evidence_only_by_design' WHEN capability = 'unsupported' THEN 'unsupported_with_reason' ELSE 'unclassified' END AS outcome
  FROM inv LEFT JOIN due ON due.evidence_id = inv.evidence_id AND due.component = inv.component LEFT JOIN act USING (candidate_id)),
 cnt AS (SELECT unnest([
   {{'counter': 'expected_components', 'n': count(*)}}, {{'counter': 'supported_components', 'n': count(*) FILTER (capability = 'supported')}}, {{'counter': 'due_applicable_components', 'n': count(*) FILTER (applicability = 'applicable')}},
   {{'counter': 'derived_components', 'n': count(*) FILTER (outcome = 'materialized_deterministically')}}, {{'counter': 'due_missing_components', 'n': count(*) FILTER (outcome = 'due_missing')}},
   {{'counter': 'blocked_unresolved_components', 'n': count(*) FILTER (outcome = 'unresolved')}}, {{'counter': 'blocked_inconsistent_components', 'n': count(*) FILTER (outcome = 'inconsistent')}},
   {{'counter': 'blocked_ambiguous_components', 'n': count(*) FILTER (outcome = 'ambiguous')}}, {{'counter': 'evidence_only_components', 'n': count(*) FILTER (capability = 'evidence_only')}},
   {{'counter': 'unsupported_components', 'n': count(*) FILTER (capability = 'unsupported')}}, {{'counter': 'unclassified_components', 'n': count(*) FILTER (capability = 'unclassified')}},
   {{'counter': 'unclassified_evidence_count', 'n': count(DISTINCT evidence_id) FILTER (capability = 'unclassified')}}, {{'counter': 'active_evidence_count', 'n': count(DISTINCT evidence_id)}}], recursive := true) FROM fnd)"""


def _coverage(spark, d):
    docs, i = read(spark, d, "documents").select("doc_id", "lang", "n_chars"), F.col("doc_id")
    pick = lambda names, k: F.element_at(F.array(*[F.lit(n) for n in names]), (k + 1).cast("int"))
    kinds = pick(("ddl_table", "ddl_column", "ddl_constraint", "document_text", "sql_unparsed", "mystery"), i % 6)
    subtype = F.when(i % 6 == 2, pick(("primary", "foreign", "odd"), F.floor(i / 6) % 3)).otherwise("default")
    evidence = docs.select(i.alias("evidence_id"), kinds.alias("kind"), subtype.alias("subtype"))
    resolutions = docs.select(i.alias("evidence_id"), F.lit("target").alias("component"), pick(("resolved", "unresolved", "ambiguous", "inconsistent"), i % 4).alias("status"))
    rules = spark.createDataFrame(RULES, "kind string, subtype string, component string, capability string, reason string")
    components = coverage.inventory(evidence, rules, resolutions)
    payload = docs.select(i.alias("evidence_id"), F.concat_ws(":", "lang", F.col("n_chars").cast("string")).alias("payload"))
    expected = coverage.planned(components, components.select("evidence_id", "component").join(payload, "evidence_id"))
    e = F.col("evidence_id")
    actual = expected.where(~((F.col("component") == "declaration") & (e % 10 == 2))).select("candidate_id", F.when(e % 7 == 0, "other").otherwise(F.col("payload")).alias("payload"))
    return components, expected, coverage.outcomes(components, expected, actual)


@query("g1_inventory", f"WITH {COVERAGE} SELECT evidence_id, kind, subtype, component, capability, applicability, resolution, reason FROM inv")
def inventory(spark, d):
    return _coverage(spark, d)[0]


@query("g2_planned", f"WITH {COVERAGE} SELECT evidence_id, component, candidate_id, payload FROM due")
def planned(spark, d):
    return _coverage(spark, d)[1]


@query("j17_outcomes", f"WITH {COVERAGE} SELECT evidence_id, component, outcome FROM fnd")
def outcomes(spark, d):
    return _coverage(spark, d)[2].select("evidence_id", "component", "outcome")


@query("a8_evidence_outcomes", f"WITH {COVERAGE} SELECT evidence_id, count(*)::BIGINT AS n_components, CASE WHEN count(DISTINCT outcome) = 1 THEN min(outcome) ELSE 'partial' END AS outcome FROM fnd GROUP BY evidence_id")
def evidence_outcomes(spark, d):
    return coverage.by_evidence(_coverage(spark, d)[2])


@query("g3_coverage", f"WITH {COVERAGE} SELECT counter, n::BIGINT AS n FROM cnt")
def coverage_counters(spark, d):
    return coverage.counters(_coverage(spark, d)[2])


@query("a10_complete", f"WITH {COVERAGE} SELECT (sum(CASE WHEN counter IN ('unclassified_components', 'due_missing_components') THEN n ELSE 0 END) = 0) AS complete, (sum(CASE WHEN counter IN ('unclassified_components', 'due_missing_components') OR starts_with(counter, 'blocked_') THEN n ELSE 0 END) = 0) AS fully_derived FROM cnt")
def is_complete(spark, d):
    return coverage.complete(coverage.counters(_coverage(spark, d)[2]))


@query("a9_kinds", f"WITH {COVERAGE} SELECT kind, subtype, count(*)::BIGINT AS n FROM ev GROUP BY ALL")
def kinds(spark, d):
    return _coverage(spark, d)[0].groupBy("kind", "subtype").agg(F.count_distinct("evidence_id").alias("n"))


@query("j9_evidence_listing", f"WITH {SQL} SELECT e.evidence_id, r.revision_id, e.parse_id, s.source_id, s.path, r.seq::BIGINT AS seq, true AS current FROM parse_evidence e JOIN latest l USING (parse_id) JOIN revisions r ON r.revision_id = l.revision_id JOIN sources s USING (source_id) JOIN cur ON cur.revision_id = r.revision_id WHERE s.status = 'active'")
def evidence_listing(spark, d):
    return listings.evidence(staged(spark, d))


@query("f2_candidate_listing", f"WITH {SQL} SELECT t.candidate_id, t.record_type, c.origin, t.state, t.leaf, t.current_revision, s.path, c.evidence_id FROM states t JOIN candidates c USING (candidate_id) JOIN revisions r USING (revision_id) JOIN sources s USING (source_id) WHERE t.state = 'confirmed'")
def candidate_listing(spark, d):
    return listings.candidates(staged(spark, d), "confirmed")


@query("j12_batch_members", f"WITH {SQL} SELECT t.candidate_id, t.state, s.path FROM states t JOIN candidates c USING (candidate_id) JOIN revisions r USING (revision_id) JOIN sources s USING (source_id) WHERE EXISTS (SELECT 1 FROM supports u WHERE u.candidate_id = t.candidate_id)")
def batch_members(spark, d):
    t = staged(spark, d)
    return listings.candidates(t, batch=t["supports"]).select("candidate_id", "state", "path")


@query("j11_object_supports", f"WITH {SQL} SELECT e.object_id, row_number() OVER (PARTITION BY e.object_id ORDER BY e.candidate_id)::INTEGER AS place, e.candidate_id, e.record_type, s.path, c.evidence_id FROM eff e JOIN candidates c USING (candidate_id) JOIN revisions r USING (revision_id) JOIN sources s USING (source_id)")
def object_supports(spark, d):
    return listings.object_supports(staged(spark, d))


@query("a6_parse_outcomes", f"WITH {SQL} SELECT status, count(*)::BIGINT AS n FROM parses GROUP BY status")
def parse_outcomes(spark, d):
    return staged(spark, d)["parses"].groupBy("status").agg(F.count(F.lit(1)).alias("n"))


@query("j22_value_classes", "WITH c AS (SELECT p_name AS slot, p_brand AS value, count(*)::BIGINT AS n FROM part GROUP BY ALL) SELECT slot, value, n, v::BIGINT AS n_values FROM (SELECT *, count(*) OVER (PARTITION BY slot) AS v FROM c) WHERE v > 1")
def value_classes(spark, d):
    return conflicts.value_conflicts(part_facts(spark, d))


@query("e18_normalized", "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate - INTERVAL 150 MINUTE, '%Y-%m-%dT%H:%M:%S') || '.250000Z' END AS moment FROM orders")
def normalized(spark, d):
    t = F.col("o_orderdate")
    raw = F.when(F.col("o_orderkey") % 3 == 0, F.date_format(t, "yyyy-MM-dd")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'.25+02:30'"))
    return read(spark, d, "orders").select("o_orderkey", intervals.normalized(raw).alias("moment"))


UNITS = """decl AS (SELECT upper(n_name) || '.' || upper(c_mktsegment) || CASE WHEN c_custkey % 4 = 0 THEN '::BODY' ELSE '' END || '.K' || (c_custkey % 300) AS target, c_custkey % 2 AS signature FROM customer JOIN nation ON c_nationkey = n_nationkey),
 suf AS (SELECT target, signature, array_to_string(list_slice(string_split(target, '.'), i, 3), '.') AS key FROM decl, (SELECT unnest([1, 2, 3]) AS i)),
 bod AS (SELECT replace(target, '::BODY.', '.') AS target, signature FROM decl WHERE contains(target, '::BODY.')),
 bsuf AS (SELECT target, signature, array_to_string(list_slice(string_split(target, '.'), i, 3), '.') AS key FROM bod, (SELECT unnest([1, 2, 3]) AS i)),
 k AS (SELECT key, count(DISTINCT (target, signature)) AS n, count(DISTINCT target) AS t, min(target) AS target FROM suf GROUP BY key),
 b AS (SELECT key, count(DISTINCT (target, signature)) AS n, count(DISTINCT target) AS t, min(target) AS target FROM bsuf GROUP BY key),
 refs AS (SELECT o_orderkey AS ref_id, upper(n_name) || '.' || upper(c_mktsegment) || '.K' || (o_orderkey % 400) AS key FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"""


@query("j19_body_fallback", f"""WITH {UNITS} SELECT ref_id, CASE WHEN coalesce(k.n, b.n) IS NULL THEN 'unresolved' WHEN coalesce(k.n, b.n) = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN k.n = 1 THEN k.target WHEN k.n IS NULL AND b.n = 1 THEN b.target END AS target,
 coalesce(k.t, b.t, 0)::BIGINT AS alternatives, CASE WHEN coalesce(k.n, b.n) IS NULL THEN 'target_absent' WHEN coalesce(k.n, b.n) > 1 THEN 'multiple_targets' WHEN k.n IS NULL THEN 'package_body_declaration' ELSE 'unique_declaration' END AS reason
 FROM refs LEFT JOIN k USING (key) LEFT JOIN b USING (key)""")
def body_fallback(spark, d):
    c, o = read(spark, d, "customer").join(read(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")), read(spark, d, "orders")
    quoted = F.concat(F.lit('"'), F.upper("n_name"), F.lit('"'))
    number = lambda k, n: F.concat(F.lit("k"), (F.col(k) % n).cast("string"))
    declared = c.select(F.col("c_custkey").alias("decl_id"), F.concat(quoted, F.lit("."), F.upper("c_mktsegment"), F.when(F.col("c_custkey") % 4 == 0, resolve.BODY).otherwise("."), number("c_custkey", 300)).alias("name"), (F.col("c_custkey") % 2).alias("signature"))
    refs = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(F.col("o_orderkey").alias("ref_id"), F.concat_ws(".", quoted, F.lower("c_mktsegment"), number("o_orderkey", 400)).alias("name"))
    return resolve.resolve_units(refs, declared)
