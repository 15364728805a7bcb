"""Queries of merging by content, structural keys, reviews in order and conflicts in time."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinlode.functions import canonical as canon
from veinlode.functions.identity import digest
from veinlode.operators import keys, ledger, merging, review_log, sweeps
from veinlode.operators.tables import settled
from veinlode.plans.queries import query
from veinlode.plans.staging import SQL, read
from veinlode.plans.staging import ledger as staged

# --- canonical form -------------------------------------------------------------------------------------------------


@query("e1_canonical", """SELECT doc_id, CASE WHEN doc_id % 9 <> 0 THEN t END AS canonical, CASE WHEN doc_id % 9 <> 0 THEN sha256(t) END AS sha FROM (
  SELECT doc_id, '{"a":{"x":true,"y":[3,{"b":' || coalesce('"' || lang || '"', 'null') || ',"c":null}]},"z":' || n_chars || ',"é":"' || source || '\\n"}' AS t FROM documents)""")
def canonical_form(spark, d):
    docs, i = read(spark, d, "documents"), F.col("doc_id")
    lang = F.coalesce(F.concat(F.lit('"'), "lang", F.lit('"')), F.lit("null"))
    inner = F.when(i % 2 == 0, F.concat(F.lit('{"c" : null, "b":'), lang, F.lit("}"))).otherwise(F.concat(F.lit('{"b":'), lang, F.lit(',"c":null }')))
    a = F.when(i % 3 == 0, F.concat(F.lit('{ "y":[3,'), inner, F.lit('], "x":true}'))).otherwise(F.concat(F.lit('{"x":true,\n"y":[ 3,'), inner, F.lit("]}")))
    text = F.concat(F.lit('{"z":'), F.col("n_chars").cast("string"), F.lit(', "\\u00e9":"'), "source", F.lit('\\n", "a":'), a, F.when(i % 9 == 0, "").otherwise("}"))
    made = docs.select("doc_id", canon.canonical(text).alias("canonical"))
    return made.withColumn("sha", digest(F.col("canonical")))


# --- merging --------------------------------------------------------------------------------------------------------

MERGED = f"""{SQL}, said AS (
  SELECT c.candidate_id, c.doc_id, d.source AS s, d.lang, d.n_chars, CASE WHEN c.doc_id % 19 = 0 THEN 'candidate_conflict' ELSE c.record_type END AS t,
    CASE c.doc_id % 3 WHEN 0 THEN 'Area ' || d.source WHEN 1 THEN '  AREA   ' || upper(d.source) || ' ' ELSE 'area ' || d.source END AS e, '"area ' || d.source || '"' AS ek,
    CASE WHEN c.doc_id % 5 = 0 THEN '{{}}' ELSE '{{"context":{{"a":[2,1],"b":1}},"k":"é"}}' END AS att, CASE c.doc_id % 3 WHEN 0 THEN '"low"' WHEN 1 THEN '"medium"' ELSE '"high"' END AS conf
  FROM candidates c JOIN documents d USING (doc_id)),
content AS (
  SELECT *, CASE t WHEN 'candidate_fact' THEN '{{"attributes":' || att || ',"entity_name":' || ek || ',"fact_type":"observed_value","property_name":"rate","property_value":' || n_chars % 3 || '}}'
    WHEN 'candidate_relation' THEN '{{"attributes":' || att || ',"relation_type":"feeds","source_entity":' || ek || ',"target_entity":"lang\\"' || lang || '\\""}}'
    WHEN 'candidate_mapping' THEN '{{"domain_entity":' || ek || ',"mapping_type":"stores","technical_object":"strasse ' || s || '"}}'
    WHEN 'candidate_question' THEN '{{"question_basis":"' || CASE WHEN doc_id % 2 = 0 THEN 'derived_gap' ELSE 'stated' END || '","question_status":"open","question_text":"why?","question_type":"gap","subject":' || ek || '}}'
    WHEN 'temporal_interval' THEN '{{"bounds_semantics":"inclusive","normalized_end":' || CASE WHEN doc_id % 2 = 0 THEN 'null' ELSE '"2020-12-31"' END || ',"normalized_start":"2020-01-01","original_precision":"day","target_subject_id":"F' || doc_id % 40 || '","target_subject_type":"fact","timezone_status":"unknown"}}' END AS semantic,
  CASE t WHEN 'candidate_fact' THEN '{{"assertion_type":"explicit","attributes":' || att || ',"confidence":' || conf || ',"entity_name":"' || e || '","fact_type":"observed_value","property_name":"Rate","property_value":' || n_chars % 3 || '}}'
    WHEN 'candidate_relation' THEN '{{"assertion_type":"explicit","attributes":' || att || ',"confidence":' || conf || ',"relation_type":"Feeds","source_entity":"' || e || '","target_entity":"Lang \\"' || lang || '\\""}}'
    WHEN 'candidate_mapping' THEN '{{"assertion_type":"explicit","confidence":' || conf || ',"domain_entity":"' || e || '","mapping_type":"stores","technical_object":"' || CASE WHEN doc_id % 4 = 2 AND doc_id % 8 = 2 THEN 'Straße ' ELSE 'STRASSE ' END || s || '"}}'
    WHEN 'candidate_question' THEN '{{"assertion_type":"explicit","confidence":' || conf || ',"question_basis":"' || CASE WHEN doc_id % 2 = 0 THEN 'derived_gap' ELSE 'stated' END || '","question_status":"open","question_text":"' || CASE WHEN doc_id % 8 = 3 THEN '  why?' ELSE 'why? ' END || '","question_type":"Gap","subject":"' || e || '"}}' END AS kept,
  CASE t WHEN 'candidate_fact' THEN 'fact' WHEN 'candidate_relation' THEN 'relation' WHEN 'candidate_mapping' THEN 'mapping' WHEN 'candidate_question' THEN 'question' WHEN 'temporal_interval' THEN 'interval' END AS kind,
  CASE t WHEN 'candidate_fact' THEN 'FACT_' WHEN 'candidate_relation' THEN 'REL_' WHEN 'candidate_mapping' THEN 'MAP_' WHEN 'candidate_question' THEN 'QUESTION_' WHEN 'temporal_interval' THEN 'INT_' END AS prefix
  FROM said),
judged AS (SELECT c.*, t.state, t.leaf, t.state = 'confirmed' AND t.leaf AND source_status = 'active' AND current_revision AND current_parse AND current_derivation AS ok,
    sha256('["' || kind || '",' || semantic || ']') AS semantic_key, prefix || substr(sha256(semantic), 1, 24) AS object_id FROM content c JOIN states t USING (candidate_id))"""


def _states_with_payload(spark, d):
    """Candidates of the ledger with a payload each, in many spellings of the same content."""
    t = staged(spark, d)
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("i"), "source", "lang", "n_chars")
    c = t["candidates"].select("candidate_id", F.col("record_type").alias("t"), "doc_id").join(docs, F.col("doc_id") == F.col("i"))
    i = F.col("doc_id")
    entity = F.when(i % 3 == 0, F.concat(F.lit("Area "), "source")).when(i % 3 == 1, F.concat(F.lit("  AREA   "), F.upper("source"), F.lit(" "))).otherwise(F.concat(F.lit("area "), "source"))
    kind = F.when(i % 19 == 0, "candidate_conflict").otherwise(F.col("t"))
    attributes = F.when(i % 5 == 0, "").when(i % 2 == 0, '"attributes":{"context":{"b":1,"a":[2,1]},"k":"é"},').otherwise('"attributes": {"k":"\\u00e9", "context":{"a":[2,1],"b":1}},')
    said = {
        "candidate_fact": ('"property_value":%s,"property_name":"Rate","fact_type":"observed_value",%s"entity_name":"%s"', (F.col("n_chars") % 3).cast("string"), attributes, entity),
        "candidate_relation": ('"target_entity":"Lang \\\\"%s\\\\"","relation_type":"Feeds",%s"source_entity":"%s"', F.col("lang"), attributes, entity),
        "candidate_mapping": ('"technical_object":"%s%s","mapping_type":"stores","domain_entity":"%s"', F.when(i % 8 == 2, "Straße ").otherwise("STRASSE "), F.col("source"), entity),
        "candidate_question": ('"subject":"%s","question_text":"%s"%s,"question_type":"Gap"', entity, F.when(i % 8 == 3, "  why?").otherwise("why? "), F.when(i % 2 == 1, ',"question_basis":"stated","question_status":"open"').otherwise("")),
        "temporal_interval": ('"target_subject_id":"F%s","note":"%s","normalized_end":%s,"normalized_start":"2020-01-01","target_subject_type":"fact","original_precision":"day","timezone_status":"unknown","bounds_semantics":"inclusive"', (i % 40).cast("string"), F.col("source"), F.when(i % 2 == 0, "null").otherwise('"2020-12-31"')),
    }
    own = F.lit('"subject":"x"')
    for name, (form, *args) in said.items():
        own = F.when(kind == name, F.format_string(form.replace("\\\\", "\\"), *args)).otherwise(own)
    confidence = F.when(i % 3 == 0, "low").when(i % 3 == 1, "medium").otherwise("high")
    payload = F.concat(F.lit('{"record_type":"'), kind, F.lit('", "assertion_type":"explicit","confidence":"'), confidence, F.lit('",'), own, F.lit("}"))
    return settled(ledger.candidate_states(t).join(c.select("candidate_id", "doc_id", payload.alias("payload")), "candidate_id"))


def _two_merges(spark, d):
    """A merge of a seventh of the candidates, then one of all."""
    states = _states_with_payload(spark, d)
    none = spark.createDataFrame([], "object_id string, kind string, semantic_key string, payload string, subject string")
    first = merging.merge_candidates(states.where("doc_id % 7 = 0"), none, spark.createDataFrame([], "object_id string, candidate_id string"))
    return merging.merge_candidates(states, first.objects, first.supports)


@query("g12_merge", f"""WITH {MERGED}, o AS (
  SELECT semantic_key, any_value(object_id) AS object_id, any_value(kind) AS kind, arg_min(coalesce(kept, semantic), candidate_id) AS payload, bool_or(doc_id % 7 = 0) AS existed FROM judged WHERE ok AND kind IS NOT NULL GROUP BY semantic_key)
 SELECT object_id, kind, semantic_key, payload FROM o WHERE NOT existed""")
def merge(spark, d):
    return _two_merges(spark, d).objects.drop("subject")


@query("g12_supports", f"WITH {MERGED} SELECT object_id, candidate_id FROM judged WHERE ok AND kind IS NOT NULL AND doc_id % 7 <> 0")
def merge_supports(spark, d):
    return _two_merges(spark, d).supports


@query("g12_skipped", f"WITH {MERGED} SELECT candidate_id, CASE WHEN ok THEN 'retained_non_materialized_type' WHEN leaf THEN state ELSE 'superseded' END AS reason FROM judged WHERE NOT ok OR kind IS NULL")
def merge_skipped(spark, d):
    return _two_merges(spark, d).skipped


@query("e21_evidence_paths", "SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN 'E' WHEN 1 THEN 'F' WHEN 2 THEN 'K' END || CASE WHEN doc_id % 4 < 3 THEN doc_id ELSE NULL END AS evidence_id FROM documents")
def evidence_paths(spark, d):
    i = F.col("doc_id")
    one = lambda k, p: F.format_string(f'"{k}":"{p}%d"', i)
    body = F.when(i % 4 == 0, F.concat(one("chunk_id", "K"), F.lit(","), one("evidence_id", "E"))).when(i % 4 == 1, F.concat(F.lit('"evidence_id":null,'), one("fragment_id", "F"))).when(i % 4 == 2, one("chunk_id", "K")).otherwise('"note":"x"')
    v = canon.parsed(F.concat(F.lit("{"), body, F.lit("}")))
    return read(spark, d, "documents").select("doc_id", canon.text_at(v, "$.evidence_id", "$.fragment_id", "$.chunk_id").alias("evidence_id"))


# --- columns and foreign keys ---------------------------------------------------------------------------------------


def _declared(spark, d):
    """A table for each customer: some declared under two names, some twice with other columns, keys of four sorts."""
    c, k = read(spark, d, "customer").select("c_custkey", "c_nationkey"), F.col("c_custkey")
    name = F.format_string("N%d.T%d", "c_nationkey", "c_custkey")
    first = c.select(name.alias("name"), F.lit("r1").alias("revision_id"), F.lit("table").alias("data"), "c_custkey")
    old = c.where(k % 10 == 0).select(F.format_string("OLD.T%d", k).alias("name"), F.lit("r1").alias("revision_id"), F.lit("table").alias("data"), "c_custkey")
    again = c.where(k % 7 == 0).select(name.alias("name"), F.lit("r2").alias("revision_id"), F.lit("table").alias("data"), "c_custkey")
    both = first.unionByName(again)
    column = lambda df, col, kind: df.select(F.concat("name", F.lit(f".{col}")).alias("name"), F.col("name").alias("table"), "revision_id", F.lit(kind).alias("data"))
    parts = [column(both, "ID", "int"), column(both, "CODE", "text"), column(both.where(k % 3 == 0), "EXTRA", "int"), column(again.where(k % 14 != 0), "NEW", "int"), column(old, "ID", "int"), column(old, "CODE", "text")]
    columns = parts[0]
    for p in parts[1:]:
        columns = columns.unionByName(p)
    lists = F.when(k % 4 == 0, F.array(F.array(F.lit("ID")))).when(k % 4 == 1, F.array(F.array(F.lit("ID"), F.lit("CODE")))).when(k % 4 == 2, F.array(F.array(F.lit("ID")), F.array(F.lit("CODE")))).otherwise(F.array().cast("array<array<string>>"))
    keyed = c.select(name.alias("table"), F.explode(lists).alias("columns"))
    return both.unionByName(old).drop("c_custkey"), columns, keyed


@query("j20_columns", """WITH r AS (
  SELECT o_orderkey AS ref_id, o_custkey AS k, c_nationkey AS n, o_orderkey % 3 AS form, CASE o_orderkey % 4 WHEN 0 THEN 'ID' WHEN 1 THEN 'EXTRA' WHEN 2 THEN 'NOPE' ELSE 'NEW' END AS col FROM orders JOIN customer ON c_custkey = o_custkey
), f AS (
  SELECT *, k % 7 = 0 AND k % 14 <> 0 AS twice, k % 10 = 0 AS old, col = 'ID' OR col = 'EXTRA' AND k % 3 = 0 OR col = 'NEW' AND k % 7 = 0 AND k % 14 <> 0 AS has FROM r
)
SELECT ref_id,
  CASE WHEN form = 2 THEN 'unresolved' WHEN has AND twice OR NOT has AND (twice OR old AND form = 0) OR has AND old AND form = 0 AND col = 'ID' THEN 'ambiguous' WHEN has THEN 'resolved' ELSE 'unresolved' END AS status,
  CASE WHEN form = 2 THEN 'target_absent' WHEN has AND twice OR NOT has AND (twice OR old AND form = 0) THEN 'column_parent_ambiguous' WHEN has AND old AND form = 0 AND col = 'ID' THEN 'multiple_targets'
    WHEN has THEN 'unique_declaration' ELSE 'column_absent_from_schema' END AS reason,
  CASE WHEN form <> 2 AND has AND NOT twice AND NOT (old AND form = 0 AND col = 'ID') THEN 'N' || n || '.T' || k || '.' || col END AS canonical
FROM f""")
def columns(spark, d):
    o = read(spark, d, "orders").join(read(spark, d, "customer"), F.col("c_custkey") == F.col("o_custkey"))
    i = F.col("o_orderkey")
    table = F.when(i % 3 == 0, F.format_string("T%d", "o_custkey")).when(i % 3 == 1, F.format_string('"N%d".t%d', "c_nationkey", "o_custkey")).otherwise(F.format_string("X%d", "o_custkey"))
    col = F.when(i % 4 == 0, "ID").when(i % 4 == 1, "extra").when(i % 4 == 2, "nope").otherwise("New")
    refs = o.select(i.alias("ref_id"), F.concat(table, F.lit("."), col).alias("name"))
    tables, cols, _ = _declared(spark, d)
    return refs.join(keys.resolve_columns(refs, tables, cols), "name").drop("name")


@query("g6_foreign_keys", """WITH r AS (
  SELECT o_orderkey AS link_id, o_custkey AS k, o_orderkey % (2 * o_custkey + 2) AS t, o_orderkey % 5 AS c, o_orderkey % 3 AS g FROM orders
), f AS (
  SELECT r.*, s.c_custkey IS NOT NULL AS s_there, k % 10 = 0 OR k % 7 = 0 AND k % 14 <> 0 AS s_amb, 'N' || s.c_nationkey || '.T' || k AS s_name,
    u.c_custkey IS NOT NULL AS t_there, t % 10 = 0 OR t % 7 = 0 AND t % 14 <> 0 AS t_amb, 'N' || u.c_nationkey || '.T' || t AS t_name
  FROM r LEFT JOIN customer s ON s.c_custkey = k LEFT JOIN customer u ON u.c_custkey = t
), e AS (
  SELECT *, CASE c WHEN 0 THEN ['ID'] WHEN 1 THEN ['ID', 'CODE'] WHEN 2 THEN ['NOPE'] WHEN 3 THEN []::VARCHAR[] ELSE ['EXTRA'] END AS cols,
    CASE WHEN g = 1 THEN ['ID'] WHEN g = 2 THEN ['CODE', 'ID'] WHEN t_there AND NOT t_amb AND t % 4 = 0 THEN ['ID'] WHEN t_there AND NOT t_amb AND t % 4 = 1 THEN ['ID', 'CODE'] ELSE []::VARCHAR[] END AS tc
  FROM f
), w AS (
  SELECT *, g > 0 AND len(cols) <> len(tc) OR len(cols) = 0 AS arity, s_there AND s_amb OR t_there AND t_amb AS amb,
    NOT s_there OR NOT t_there OR c = 2 OR c = 4 AND k % 3 <> 0 AS lacking
  FROM e
), z AS (
  SELECT *, CASE WHEN arity THEN 'inconsistent' WHEN amb THEN 'ambiguous' WHEN lacking OR len(tc) = 0 THEN 'unresolved' ELSE 'resolved' END AS status FROM w
)
SELECT link_id, status, CASE WHEN arity THEN 'foreign_key_arity' WHEN amb THEN 'foreign_key_ambiguous_endpoint' WHEN len(tc) = 0 THEN 'foreign_key_target_key_unknown' WHEN lacking THEN 'foreign_key_missing_endpoint' ELSE 'foreign_key_endpoints_verified' END AS reason,
  CASE WHEN s_there AND NOT s_amb THEN s_name END AS source, CASE WHEN status = 'resolved' THEN t_name END AS canonical, array_to_string(tc, ',') AS target_columns
FROM z""")
def foreign_keys(spark, d):
    i, k = F.col("o_orderkey"), F.col("o_custkey")
    words = lambda *w: F.array(*map(F.lit, w)).cast("array<string>")
    links = read(spark, d, "orders").select(
        i.alias("link_id"), F.format_string("T%d", k).alias("table"), F.format_string("t%d", i % (2 * k + 2)).alias("target_table"),
        F.when(i % 5 == 0, words("ID")).when(i % 5 == 1, words("ID", "CODE")).when(i % 5 == 2, words("NOPE")).when(i % 5 == 3, words()).otherwise(words("EXTRA")).alias("columns"),
        F.when(i % 3 == 1, words("ID")).when(i % 3 == 2, words("CODE", "ID")).otherwise(words()).alias("target_columns"),
    )
    return keys.resolve_foreign_keys(links, *_declared(spark, d)).withColumn("target_columns", F.array_join("target_columns", ","))


# --- reviews in order -----------------------------------------------------------------------------------------------

REVIEWED = r"""r AS (
  SELECT event_id AS seq, user_id AS u, 'C' || user_id AS cand, event_id % 29 = 5 AS fix, CASE event_id % 10 WHEN 3 THEN 'needs_review' WHEN 8 THEN 'pending' WHEN 1 THEN 'rejected' WHEN 2 THEN 'rejected' ELSE 'confirmed' END AS outcome,
    CASE WHEN event_id % 13 = 5 THEN ' ' ELSE 'rev' || event_id % 3 END AS actor, CASE WHEN event_id % 7 = 2 THEN 'policy' WHEN event_id % 11 = 4 THEN 'robot' ELSE 'human' END AS kind,
    CASE WHEN event_id % 4 = 0 THEN 'k' || user_id || '-' || event_id % 3 END AS ikey, CASE WHEN event_id % 6 = 1 THEN 'h0' END AS expected, event_id % 6 < 2 AS chk FROM events
), q AS (
  SELECT *, sha256('{"actor_id":"' || actor || '","actor_type":"' || kind || '","candidate_id":"' || cand || '","outcome":"' || outcome || '","reason":"seen"}') AS h, row_number() OVER (PARTITION BY u ORDER BY seq) AS n,
    CASE WHEN u % 6 = 0 AND ikey = 'k' || u || '-1' AND actor = 'rev1' AND kind = 'human' THEN sha256('{"actor_id":"rev1","actor_type":"human","candidate_id":"' || cand || '","outcome":"confirmed","reason":"seen"}') END AS done,
    kind || '/' || actor || '/' || ikey AS own FROM r
), b AS (
  SELECT *, 'CAND_' || substr(sha256('["BATCH_' || substr(sha256('["correction","' || cand || '",{"a":' || seq || ',"b":1}]'), 1, 24) || '","x' || seq || '"]'), 1, 24) AS child FROM q
), walk AS (
  SELECT u, 0::BIGINT AS n, CASE WHEN u % 2 = 0 THEN 'h0' END AS head, CASE u % 8 WHEN 1 THEN 'rejected' WHEN 2 THEN 'confirmed' ELSE 'pending' END AS state, u % 11 <> 3 AS leaf, MAP {'': ''} AS keys,
    0::BIGINT AS seq, '' AS answer, '' AS decision, '' AS previous, '' AS outcome, '' AS ukey, '' AS child FROM (SELECT DISTINCT user_id AS u FROM events)
  UNION ALL
  SELECT u, n, CASE WHEN answer = 'recorded' THEN made ELSE head END, CASE WHEN answer <> 'recorded' THEN state WHEN fix THEN 'superseded' ELSE outcome END, leaf AND NOT (fix AND answer = 'recorded'),
    CASE WHEN answer = 'recorded' AND NOT fix AND ikey IS NOT NULL THEN map_concat(keys, MAP {own: h}) ELSE keys END,
    seq, answer, CASE answer WHEN 'recorded' THEN made WHEN 'no_op' THEN head END, CASE WHEN answer = 'recorded' THEN head END, CASE WHEN fix AND answer = 'recorded' THEN 'superseded' ELSE outcome END,
    CASE WHEN answer = 'recorded' THEN CASE WHEN fix THEN made ELSE coalesce(ikey, auto) END WHEN answer IN ('replay', 'idempotency_payload_conflict') THEN ikey END, CASE WHEN fix AND answer = 'recorded' THEN child END
  FROM (SELECT *, CASE WHEN fix THEN 'DEC_' || substr(sha256('["' || cand || '","' || child || '"]'), 1, 24)
      ELSE 'DEC_' || substr(sha256('["' || cand || '","' || h || '",' || coalesce('"' || head || '"', 'null') || ',"' || coalesce(ikey, auto) || '"]'), 1, 24) END AS made,
    CASE WHEN fix THEN CASE WHEN u % 5 = 4 OR NOT leaf THEN 'not_leaf' WHEN expected <> coalesce(head, '') THEN 'review_head_conflict' ELSE 'recorded' END
      WHEN outcome = 'needs_review' THEN 'review_outcome' WHEN actor = ' ' THEN 'actor_required' WHEN u % 5 = 4 THEN 'unknown_candidate'
      WHEN used = h THEN 'replay' WHEN used IS NOT NULL THEN 'idempotency_payload_conflict' WHEN chk AND expected IS DISTINCT FROM head THEN 'review_head_conflict' WHEN NOT leaf THEN 'not_leaf'
      WHEN kind = 'policy' AND NOT (actor = 'rev1' AND u % 4 = 1 AND u % 9 <> 1) THEN 'policy_not_allowed' WHEN kind = 'robot' THEN 'actor_type' WHEN outcome = 'confirmed' AND u % 17 = 2 THEN 'temporal_order'
      WHEN state = outcome AND head IS NOT NULL THEN 'no_op' ELSE 'recorded' END AS answer
    FROM (SELECT w.u, b.n, w.head, w.state, w.leaf, w.keys, b.seq, b.cand, b.fix, b.outcome, b.actor, b.kind, b.ikey, b.expected, b.chk, b.h, b.own, b.child,
      'KEY_' || substr(sha256('["' || b.h || '",' || coalesce('"' || w.head || '"', 'null') || ']'), 1, 24) AS auto, coalesce(b.done, w.keys[b.own]) AS used
      FROM walk w JOIN b ON b.u = w.u AND b.n = w.n + 1))
)"""


def _reviews(spark, d):
    e = read(spark, d, "events").select("event_id", "user_id")
    i, u = F.col("event_id"), F.col("user_id")
    requests = e.select(
        F.format_string("C%d", u).alias("candidate_id"), i.alias("seq"), F.when(i % 29 == 5, "correct").otherwise("review").alias("kind"),
        F.when(i % 10 == 3, "needs_review").when(i % 10 == 8, "pending").when((i % 10).isin(1, 2), "rejected").otherwise("confirmed").alias("outcome"),
        F.when(i % 13 == 5, " ").otherwise(F.format_string("rev%d", i % 3)).alias("actor_id"), F.when(i % 7 == 2, "policy").when(i % 11 == 4, "robot").otherwise("human").alias("actor_type"), F.lit("seen").alias("reason"),
        F.when(i % 6 == 1, "h0").alias("expected_head"), (i % 6 < 2).alias("check_head"), F.when(i % 4 == 0, F.format_string("k%d-%d", u, i % 3)).alias("key"),
        F.format_string('{"b":1, "a":%d}', i).alias("payload"), F.format_string("x%d", i).alias("child_name"),
    )
    users = e.select("user_id").distinct()
    states = users.where(u % 5 != 4).select(
        F.format_string("C%d", u).alias("candidate_id"), F.when(u % 2 == 0, "h0").alias("head"), F.when(u % 8 == 1, "rejected").when(u % 8 == 2, "confirmed").otherwise("pending").alias("state"), (u % 11 != 3).alias("leaf"),
        F.format_string("rule%d", u % 4).alias("rule"), (u % 9 != 1).alias("current_derivation"), F.when(u % 17 == 2, "temporal_order").alias("order_error"),
    )
    before = users.where(u % 6 == 0).select(F.format_string("C%d", u).alias("candidate_id"), F.lit("confirmed").alias("outcome"), F.lit("rev1").alias("actor_id"), F.lit("human").alias("actor_type"), F.lit("seen").alias("reason"), F.format_string("k%d-1", u).alias("key"))
    done = review_log.request_hash(before).select("actor_type", "actor_id", "key", F.col("hash").alias("request_hash"))
    policies = spark.createDataFrame([("rev1", "rule1")], "actor_id string, rule string")
    return review_log.review_in_order(requests, states, done, policies), states, requests


@query("g9_reviews_in_order", f"WITH RECURSIVE {REVIEWED} SELECT seq, 'C' || u AS candidate_id, answer, decision, previous, outcome, ukey AS key, child FROM walk WHERE n > 0")
def reviews_in_order(spark, d):
    answers, _, _ = _reviews(spark, d)
    return answers.select("seq", "candidate_id", "answer", F.col("decision_id").alias("decision"), "previous", "outcome", "key", F.col("child_id").alias("child"))


@query("g11_heads", f"""WITH RECURSIVE {REVIEWED}, l AS (SELECT * FROM walk WHERE u % 5 <> 4 QUALIFY row_number() OVER (PARTITION BY u ORDER BY n DESC) = 1)
 SELECT 'C' || u AS candidate_id, state, leaf FROM l UNION ALL SELECT child, 'confirmed', true FROM walk WHERE n > 0 AND child IS NOT NULL""")
def review_heads(spark, d):
    answers, states, _ = _reviews(spark, d)
    return review_log.heads(answers, states).drop("head")


@query("g13_reconciliations", f"""WITH RECURSIVE {REVIEWED} SELECT 'REC_' || substr(sha256('["C' || u || '","' || decision || '"]'), 1, 24) AS reconciliation_id FROM walk WHERE answer = 'recorded' AND u % 3 = 0 AND seq % 2 = 0""")
def reconciliations(spark, d):
    answers, states, _ = _reviews(spark, d)
    supports = states.where("cast(substring(candidate_id, 2) as long) % 3 = 0")
    found = review_log.opened(answers, supports)
    return review_log.reconcile(found, found.where("seq % 2 = 1"))


# --- conflicts in time ----------------------------------------------------------------------------------------------


@query("g15_conflicts_in_time", """WITH f AS (
  SELECT o_orderkey AS id, o_orderpriority AS slot, o_orderkey % 7 AS v, CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate::DATE END AS s1, CASE WHEN o_orderkey % 5 <> 0 THEN coalesce(CASE WHEN o_orderkey % 37 <> 0 THEN (o_orderdate::DATE + (o_orderkey % 400)::INTEGER) END, DATE '9999-01-01') END AS e1,
    CASE WHEN o_orderkey % 5 <> 0 AND o_orderkey % 1009 = 3 THEN o_orderdate::DATE + 1000 END AS s2 FROM orders
), n AS (SELECT slot, count(*)::BIGINT AS n_facts, count(DISTINCT v)::BIGINT AS n_values FROM f GROUP BY slot HAVING count(DISTINCT v) > 1),
p AS (SELECT a.slot, count(*)::BIGINT AS n_pairs FROM f a JOIN f b ON a.slot = b.slot AND a.id < b.id AND a.v <> b.v
  WHERE a.s1 IS NULL OR b.s1 IS NULL OR (a.s1 <= b.e1 AND b.s1 <= a.e1) OR (a.s2 <= b.e1 AND b.s1 <= a.s2 + 30) OR (a.s1 <= b.s2 + 30 AND b.s2 <= a.e1) OR (a.s2 <= b.s2 + 30 AND b.s2 <= a.s2 + 30) GROUP BY a.slot)
SELECT slot, n_facts, n_values, coalesce(n_pairs, 0) AS n_pairs FROM n LEFT JOIN p USING (slot)""")
def conflicts_in_time(spark, d):
    o, i, day = read(spark, d, "orders"), F.col("o_orderkey"), F.to_date("o_orderdate")
    facts = o.select(i.alias("fact_id"), F.col("o_orderpriority").alias("slot"), (i % 7).alias("value"))
    dated = o.where(i % 5 != 0)
    first = dated.select(i.alias("fact_id"), day.alias("start"), F.when(i % 37 != 0, F.date_add(day, (i % 400).cast("int"))).alias("end"))
    second = dated.where(i % 1009 == 3).select(i.alias("fact_id"), F.date_add(day, 1000).alias("start"), F.date_add(day, 1030).alias("end"))
    return sweeps.conflicts_in_time(facts, first.unionByName(second))
