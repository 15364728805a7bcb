"""Queries for SQL text, candidate and review checks, proposals, propagation and the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinlode.operators import consolidation, graph, ledger, reviews
from veinlode.plans.queries import query
from veinlode.plans.staging import SQL, read
from veinlode.plans.staging import ledger as staged
from veinlode.sources import sql_text


def _sql_files(spark, d):
    """Two statements per order; the first has a form by key, with semicolons in a literal or a comment."""
    k, s = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    m = F.col("o_orderkey") % 4
    first = (
        F.when(m == 0, F.concat(F.lit("INSERT INTO app.orders (k, s) VALUES ("), k, F.lit(", '"), s, F.lit(";x')")))
        .when(m == 1, F.concat(F.lit("UPDATE app.orders SET status = '"), s, F.lit("''s' WHERE k = "), k))
        .when(m == 2, F.concat(F.lit("update App.Orders set total = "), k, F.lit(" + 1")))
        .otherwise(F.concat(F.lit("DELETE FROM app.orders WHERE k = "), k, F.lit(" -- ; done\n")))
    )
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("path"), F.concat(first, F.lit(";\nSELECT * FROM app.orders o JOIN app.customer c ON 1 = 1")).alias("text"))


@query("d8_statements", """SELECT o_orderkey AS path, n.ordinal, CASE WHEN n.ordinal = 1 THEN 'select' WHEN o_orderkey % 4 = 0 THEN 'insert' WHEN o_orderkey % 4 = 3 THEN 'delete' ELSE 'update' END AS kind,
  CASE WHEN n.ordinal = 0 THEN 'APP.ORDERS' END AS written, CASE WHEN n.ordinal = 1 THEN 'APP.CUSTOMER,APP.ORDERS' ELSE '' END AS reads FROM orders, (SELECT unnest([0, 1]) AS ordinal) n""")
def statements(spark, d):
    s = sql_text.statements(_sql_files(spark, d))
    b = F.col("bare")
    return s.select("path", "ordinal", sql_text.kind(b).alias("kind"), sql_text.written(b).alias("written"), F.array_join(sql_text.read_tables(b), ",").alias("reads"))


@query("d12_assignments", """SELECT o_orderkey AS path, CASE WHEN o_orderkey % 4 = 1 THEN 'STATUS' ELSE 'TOTAL' END AS "column", CASE WHEN o_orderkey % 4 = 1 THEN 'string' ELSE 'expression' END AS type,
  CASE WHEN o_orderkey % 4 = 1 THEN o_orderstatus || '''s' ELSE o_orderkey || ' + 1' END AS value, CASE WHEN o_orderkey % 4 = 1 THEN 'k = ' || o_orderkey END AS row_selection FROM orders WHERE o_orderkey % 4 IN (1, 2)""")
def assignments(spark, d):
    s = sql_text.statements(_sql_files(spark, d)).where(F.lower(F.substring("bare", 1, 6)) == "update")
    return s.select("path", sql_text.assignment(F.col("statement")).alias("a")).select("path", "a.column", "a.type", "a.value", "a.row_selection")


@query("d10_table_columns", """SELECT c_custkey AS path, c.name, c.type, c.not_null FROM customer, (SELECT unnest([
  {'name': 'ID', 'type': 'NUMBER(12,2)', 'not_null': true}, {'name': 'NAME', 'type': 'VARCHAR(25)', 'not_null': true}, {'name': 'NOTE', 'type': 'CLOB', 'not_null': false}]) AS c)""")
def table_columns(spark, d):
    text = F.concat(F.lit("CREATE TABLE app.t"), F.col("c_custkey").cast("string"), F.lit(" (id NUMBER(12, 2) PRIMARY KEY, name varchar(25) DEFAULT 'a, b;' NOT NULL, note clob,\n constraint c_id CHECK (id > 0), UNIQUE (name));"))
    s = sql_text.statements(read(spark, d, "customer").select(F.col("c_custkey").alias("path"), text.alias("text")))
    return s.select("path", F.explode(sql_text.table_columns(F.col("bare"))).alias("c")).select("path", "c.name", "c.type", "c.not_null")


@query("g8_candidate_errors", """WITH b AS (SELECT CASE WHEN doc_id % 50 = 7 THEN doc_id - 1 ELSE doc_id END AS candidate_id, doc_id, doc_id % 9 = 0 OR doc_id % 7 = 0 AS schema, doc_id % 11 = 0 AND doc_id % 9 <> 0 AS holder, doc_id % 17 = 0 AS bare, doc_id % 13 = 0 OR doc_id % 19 = 0 AS other, doc_id % 5 = 0 AS misquoted,
   length(regexp_replace(substr(text, 1, 20), '\\s', '', 'g')) = 0 AND doc_id % 5 <> 0 AS blank FROM documents),
 n AS (SELECT candidate_id, count(*) AS n FROM b GROUP BY 1)
 SELECT candidate_id, unnest(list_filter([CASE WHEN schema THEN 'candidate_schema' END, CASE WHEN holder THEN 'placeholder' END,
   CASE WHEN bare OR blank THEN 'evidence_required' WHEN other THEN 'evidence_revision_mismatch' WHEN misquoted THEN 'evidence_quote_mismatch' END, CASE WHEN n > 1 THEN 'duplicate_candidate_id' END], lambda x: x IS NOT NULL)) AS reason FROM b JOIN n USING (candidate_id)""")
def candidate_errors(spark, d):
    docs = read(spark, d, "documents").select("doc_id", "text", "lang", "source")
    i = F.col("doc_id")
    attributes = F.create_map(F.lit("fact_type"), F.lit("t"), F.lit("entity_name"), F.when(i % 9 == 0, " ").when(i % 11 == 0, "${x}").otherwise(F.col("lang")), F.lit("property_name"), F.lit("p"), F.lit("property_value"), F.col("source"), F.lit("note"), F.when(i % 4 == 0, "TODO").otherwise("n"))
    quote = F.when(i % 5 == 0, F.concat(F.col("text"), F.lit("\x01"))).otherwise(F.substring("text", 1, 20))
    batch = docs.select(
        F.when(i % 50 == 7, i - 1).otherwise(i).alias("candidate_id"), F.lit("candidate_fact").alias("record_type"), F.when(i % 7 == 0, "guessed").otherwise("explicit").alias("assertion_type"), F.lit("high").alias("confidence"),
        F.when(i % 17 != 0, i).alias("evidence_id"), F.format_string("r%d", i).alias("source_revision_id"), quote.alias("evidence_text"), attributes.alias("attributes"),
    )
    evidence = docs.select(F.when(i % 13 != 0, i).otherwise(-i - 1).alias("evidence_id"), F.when(i % 19 != 0, F.format_string("r%d", i)).otherwise("r").alias("revision_id"), "text")
    return reviews.candidate_errors(batch, evidence)


@query("g9_review_checks", """WITH r AS (SELECT event_id AS key, user_id AS u, CASE WHEN event_id % 10 = 3 THEN 'needs_review' WHEN event_id % 10 = 8 THEN 'pending' ELSE 'confirmed' END AS outcome,
  CASE WHEN event_id % 7 = 2 THEN 'policy' WHEN event_id % 11 = 4 THEN 'robot' ELSE 'human' END AS actor, CASE WHEN event_id % 13 = 5 THEN ' ' ELSE 'rev' || event_id % 3 END AS actor_id,
  CASE WHEN event_id % 2 = 0 THEN 'h0' ELSE 'h' || user_id % 2 END AS head FROM events)
 SELECT key, outcome, CASE WHEN outcome = 'needs_review' THEN 'review_outcome' WHEN actor_id = ' ' THEN 'actor_required' WHEN u % 5 = 4 THEN 'unknown_candidate' WHEN key % 10 = 5 THEN 'replay' WHEN key % 10 = 6 THEN 'idempotency_payload_conflict'
  WHEN head <> 'h' || u % 2 THEN 'review_head_conflict' WHEN u % 3 = 0 THEN 'not_leaf' WHEN actor = 'policy' AND NOT (actor_id = 'rev1' AND u % 4 = 1 AND u % 9 <> 1) THEN 'policy_not_allowed' WHEN actor = 'robot' THEN 'actor_type'
  WHEN outcome = 'confirmed' AND u % 17 = 2 THEN 'temporal_order' WHEN u % 8 = 1 AND outcome = 'pending' OR u % 8 = 2 AND outcome = 'confirmed' THEN 'no_op' END AS reason FROM r""")
def review_checks(spark, d):
    e, i, u = read(spark, d, "events").select("event_id", "user_id"), F.col("event_id"), F.col("user_id")
    requests = e.select(
        i.alias("key"), u.alias("candidate_id"), F.when(i % 10 == 3, "needs_review").when(i % 10 == 8, "pending").otherwise("confirmed").alias("outcome"),
        F.when(i % 2 == 0, "h0").otherwise(F.concat(F.lit("h"), (u % 2).cast("string"))).alias("expected_head"),
        F.when(i % 13 == 5, " ").otherwise(F.concat(F.lit("rev"), (i % 3).cast("string"))).alias("actor_id"),
        F.when(i % 7 == 2, "policy").when(i % 11 == 4, "robot").otherwise("human").alias("actor_type"), F.lit("seen").alias("reason"),
    )
    states = e.select("user_id").distinct().where(u % 5 != 4).select(
        u.alias("candidate_id"), F.concat(F.lit("h"), (u % 2).cast("string")).alias("head"), (u % 3 != 0).alias("leaf"),
        F.when(u % 8 == 1, "pending").when(u % 8 == 2, "confirmed").otherwise("rejected").alias("state"), F.concat(F.lit("rule"), (u % 4).cast("string")).alias("rule"),
        (u % 9 != 1).alias("current_derivation"), F.when(u % 17 == 2, "temporal_order").alias("order_error"),
    )
    done = reviews.request_hash(requests.where("key % 10 in (5, 6)")).select("key", "actor_id", "actor_type", F.when(F.col("key") % 10 == 5, F.col("hash")).otherwise("other").alias("request_hash"))
    policies = spark.createDataFrame([("rev1", "rule1")], "actor_id string, rule string")
    return reviews.review_errors(requests, states, done, policies).join(requests.select("key", "outcome"), "key").select("key", "outcome", "reason")


@query("g10_auto_review", f"WITH {SQL} SELECT candidate_id FROM states WHERE state = 'pending' AND leaf AND current_derivation AND record_type IN ('candidate_fact', 'candidate_relation')")
def auto_review(spark, d):
    policies = spark.createDataFrame([("candidate_fact", True), ("candidate_relation", True), ("candidate_mapping", False)], "rule string, enabled boolean")
    states = ledger.candidate_states(staged(spark, d)).withColumn("rule", F.col("record_type"))
    return reviews.auto_review(states, policies).select("candidate_id")


@query("t3_proposals", """WITH b AS (SELECT o_custkey AS subject, CASE o_orderkey % 3 WHEN 0 THEN 'valid_from' WHEN 1 THEN 'valid_to' ELSE 'effective_date' END AS role, o_orderdate::DATE AS value, count(*) AS n, count(DISTINCT o_orderpriority) AS independent FROM orders GROUP BY ALL),
 u AS (SELECT *, count(*) OVER (PARTITION BY subject, role) > 1 AS conflict, coalesce(sum(n) FILTER (role = 'valid_from') OVER (PARTITION BY subject), 0) = 1 AND coalesce(sum(n) FILTER (role = 'valid_to') OVER (PARTITION BY subject), 0) = 1 AS paired,
  max(value) FILTER (role = 'valid_to') OVER (PARTITION BY subject) AS its_end FROM b)
 SELECT subject, CASE WHEN role <> 'valid_to' THEN value END AS start, CASE WHEN role <> 'valid_from' THEN value WHEN paired THEN its_end END AS "end",
  CASE WHEN role = 'valid_from' AND NOT paired THEN 'open_end' WHEN role = 'valid_to' THEN 'open_start' ELSE 'inclusive' END AS semantics, CASE WHEN independent > 1 AND NOT conflict THEN 'medium' ELSE 'low' END AS confidence
 FROM u WHERE NOT (paired AND role = 'valid_to')""")
def proposals(spark, d):
    m = F.col("o_orderkey") % 3
    o = read(spark, d, "orders").select(F.col("o_custkey").alias("subject"), F.when(m == 0, "valid_from").when(m == 1, "valid_to").otherwise("effective_date").alias("role"), F.to_date("o_orderdate").alias("value"), F.lit("high").alias("reliability"), F.col("o_orderpriority").alias("sha"), F.lit("f").alias("family"))
    return consolidation.proposals(consolidation.consolidate(o))


def _links(spark, d, start=None):
    """Spells of orders from the third week on (the first ones have none, so their parts get none), to parts."""
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    links = l.select(F.col("l_orderkey").alias("source"), F.col("l_partkey").alias("target")).distinct()
    start = F.to_date("o_orderdate") if start is None else start
    return o.where("o_orderdate >= date'1995-01-15'").select(F.col("o_orderkey").alias("subject"), start.alias("start"), F.date_add(start, 2200).alias("end")), links


def _links_sql(start: str) -> str:
    return f"""k AS (SELECT DISTINCT l_orderkey AS source, l_partkey AS target FROM lineitem),
 s AS (SELECT o_orderkey AS source, {start} AS start, ({start} + INTERVAL 2200 DAY)::DATE AS "end" FROM orders WHERE o_orderdate >= DATE '1995-01-15'),
 f AS (SELECT k.source, k.target, s.start, s."end" FROM k LEFT JOIN s USING (source) WHERE target NOT IN (SELECT target FROM k WHERE source NOT IN (SELECT source FROM s)))"""


LINKS = _links_sql("o_orderdate::DATE")
ERAS = _links_sql("(CASE WHEN o_orderdate < DATE '2001-01-01' THEN DATE '1995-01-01' ELSE DATE '2001-01-01' END)")


@query("t5_propagate_intersection", f"""WITH {LINKS}, n AS (SELECT target, count(DISTINCT source)::BIGINT AS n FROM f GROUP BY 1),
 c AS (SELECT DISTINCT a.target, a.start, b."end" FROM f a JOIN f b ON a.target = b.target AND a.start <= b."end")
 SELECT c.target, c.start, c."end" FROM c JOIN n ON n.target = c.target JOIN f ON f.target = c.target AND f.start <= c.start AND c."end" <= f."end" GROUP BY c.target, c.start, c."end", n.n HAVING count(DISTINCT f.source) = n.n""")
def propagate_intersection(spark, d):
    return consolidation.propagate(*_links(spark, d), "intersection")


@query("t5_propagate_aggregation", f'WITH {LINKS} SELECT DISTINCT target, start, "end" FROM f')
def propagate_aggregation(spark, d):
    return consolidation.propagate(*_links(spark, d), "aggregation")


@query("t5_propagate_copy", f'WITH {ERAS} SELECT target, min(start) AS start, min("end") AS "end" FROM f GROUP BY target HAVING count(DISTINCT (start, "end")) = 1')
def propagate_copy(spark, d):
    start = F.when(F.col("o_orderdate") < F.lit("2001-01-01").cast("date"), F.lit("1995-01-01")).otherwise(F.lit("2001-01-01")).cast("date")
    return consolidation.propagate(*_links(spark, d, start), "explicit_copy")


GRAPH = """f AS (SELECT o_orderkey AS fact_id, o_custkey AS entity, o_orderpriority AS source, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS s, CASE WHEN o_orderkey % 3 <> 0 THEN o_orderdate::DATE END AS e FROM orders),
 r AS (SELECT c_custkey AS source, 'in' AS type, 'n' || c_nationkey AS target FROM customer)"""


def _graph(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    day = F.when(F.col("o_orderkey") % 3 != 0, F.to_date("o_orderdate"))
    facts = o.select(F.col("o_orderkey").alias("fact_id"), F.col("o_custkey").cast("string").alias("entity"), F.col("o_orderpriority").alias("source"), day.alias("start"), day.alias("end"))
    relations = c.select(F.col("c_custkey").cast("string").alias("source"), F.lit("in").alias("type"), F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("target"))
    return graph.build(facts, relations)


@query("x4_graph_nodes", f"""WITH {GRAPH}, own AS (SELECT entity::VARCHAR AS entity, bool_and(s IS NOT NULL) AS dated, min(s) AS s, max(e) AS e FROM f GROUP BY 1),
 ends AS (SELECT source::VARCHAR AS entity FROM r UNION SELECT target FROM r)
 SELECT 'entity:' || entity AS node, 'entity' AS kind, CASE WHEN dated THEN s END AS start, CASE WHEN dated THEN e END AS "end" FROM own FULL JOIN ends USING (entity)
 UNION ALL SELECT 'fact:' || fact_id, 'fact', s, e FROM f UNION ALL SELECT DISTINCT 'source:' || source, 'source', NULL, NULL FROM f""")
def graph_nodes(spark, d):
    return _graph(spark, d)[0]


@query("x4_graph_edges", f"""WITH {GRAPH} SELECT DISTINCT 'entity:' || source AS source, type AS kind, 'entity:' || target AS target FROM r
 UNION ALL SELECT 'fact:' || fact_id, 'mentions', 'entity:' || entity FROM f UNION ALL SELECT 'fact:' || fact_id, 'derives_from', 'source:' || source FROM f""")
def graph_edges(spark, d):
    return _graph(spark, d)[1]
