"""Queries over the staged tables, one per operator of the survey, with DuckDB SQL beside each."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.functions import identity, intervals
from veinlode.functions.canonical import parsed
from veinlode.operators import conflicts, consolidation, ledger, resolve, selection, snapshots
from veinlode.plans.staging import LOG_SQL, SQL, log_lines, part_facts, part_intervals, read
from veinlode.plans.staging import ledger as staged
from veinlode.sources import chunks, lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return add


@query("j1_candidate_states", f"WITH {SQL} SELECT * FROM states")
def candidate_states(spark, d):
    return ledger.candidate_states(staged(spark, d))


@query("j6_effective_supports", f"WITH {SQL} SELECT * FROM eff")
def effective_supports(spark, d):
    return ledger.effective_supports(staged(spark, d))


@query("j7_effective_objects", f"WITH {SQL} SELECT object_id, count(*)::BIGINT AS n_supports FROM eff GROUP BY object_id")
def effective_objects(spark, d):
    return ledger.effective_objects(staged(spark, d))


@query("j13_confirmed_unmerged", f"WITH {SQL} SELECT candidate_id, record_type FROM states t WHERE state = 'confirmed' AND leaf AND NOT EXISTS (SELECT 1 FROM supports u WHERE u.candidate_id = t.candidate_id)")
def confirmed_unmerged(spark, d):
    return ledger.confirmed_unmerged(staged(spark, d))


@query("a2_state_counts", f"WITH {SQL} SELECT state, count(*)::BIGINT AS n FROM states WHERE leaf AND current_revision GROUP BY state")
def state_counts(spark, d):
    return ledger.candidate_states(staged(spark, d)).where("leaf and current_revision").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query("a3_state_by_type", f"WITH {SQL} SELECT record_type, state, count(*)::BIGINT AS n FROM states GROUP BY ALL")
def state_by_type(spark, d):
    return ledger.candidate_states(staged(spark, d)).groupBy("record_type", "state").agg(F.count(F.lit(1)).alias("n"))


@query("a4_consolidation_by_type", f"""WITH {SQL} SELECT record_type,
  sum(CASE WHEN EXISTS (SELECT 1 FROM supports u WHERE u.candidate_id = t.candidate_id) THEN 1 ELSE 0 END)::BIGINT AS consolidated,
  sum(CASE WHEN EXISTS (SELECT 1 FROM supports u WHERE u.candidate_id = t.candidate_id) THEN 0 ELSE 1 END)::BIGINT AS not_consolidated
  FROM states t WHERE leaf GROUP BY record_type""")
def consolidation_by_type(spark, d):
    return ledger.consolidation(staged(spark, d))


@query("o1_latest_parse", f"WITH {SQL} SELECT revision_id, parse_id FROM latest")
def latest_parse(spark, d):
    return ledger.latest_parses(staged(spark, d)["parses"])


@query("k3_review_heads", "SELECT conv_id, arg_max(role, turn) AS role, arg_max(length(text), turn)::BIGINT AS n_chars FROM conversations GROUP BY conv_id")
def review_heads(spark, d):
    c = read(spark, d, "conversations").withColumn("n_chars", F.length("text").cast("long"))
    return ledger.heads(c, "conv_id", "turn", "role", "n_chars")


@query("a1_status_counts", " UNION ALL ".join(f"SELECT '{t}' AS name, count(*)::BIGINT AS n FROM {t}" for t in ("documents", "labels", "conversations", "events", "pages", "benchmark")))
def status_counts(spark, d):
    out = None
    for t in ("documents", "labels", "conversations", "events", "pages", "benchmark"):
        one = read(spark, d, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("name"), "n")
        out = one if out is None else out.union(one)
    return out


@query("k2_append_new", "SELECT DISTINCT sha256(text) AS sha FROM documents a WHERE doc_id % 4 = 0 AND NOT EXISTS (SELECT 1 FROM documents b WHERE b.doc_id % 4 <> 0 AND b.text = a.text)")
def append_new(spark, d):
    docs = read(spark, d, "documents").select("doc_id", identity.digest(F.col("text")).alias("sha"))
    return ledger.append_new(docs.where("doc_id % 4 = 0").select("sha"), docs.where("doc_id % 4 <> 0").select("sha"), "sha")


@query("s1_missing_sources", "SELECT source || '/' || doc_id AS path FROM documents WHERE doc_id % 10 <> 3 AND doc_id % 8 = 0")
def missing_sources(spark, d):
    docs = read(spark, d, "documents").select("doc_id", F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("path"))
    known, seen = docs.where("doc_id % 10 <> 3").select("path"), docs.where("doc_id % 8 <> 0").select("path")
    return known.join(seen, "path", "left_anti")


FACTS = "facts AS (SELECT p_partkey AS fact_id, p_name AS slot, p_brand AS value FROM part)"
PAIRS = f"{FACTS}, pairs AS (SELECT l.slot, l.fact_id AS left_id, l.value AS left_value, r.fact_id AS right_id, r.value AS right_value FROM facts l JOIN facts r ON l.slot = r.slot AND l.fact_id < r.fact_id AND l.value <> r.value)"
SPANS = "spans AS (SELECT l_partkey AS fact_id, min(l_shipdate)::DATE AS s, (min(l_shipdate) + INTERVAL 200 DAY)::DATE AS e FROM lineitem WHERE l_partkey % 3 <> 0 GROUP BY 1)"


@query("g15_conflicts", f"WITH {PAIRS} SELECT p.slot, n_values::BIGINT AS n_values, n_facts::BIGINT AS n_facts, count(*)::BIGINT AS n_pairs FROM pairs p JOIN (SELECT slot, count(DISTINCT value) AS n_values, count(*) AS n_facts FROM facts GROUP BY slot) USING (slot) GROUP BY ALL")
def slot_conflicts(spark, d):
    return conflicts.slot_conflicts(part_facts(spark, d))


@query("j22_fact_conflicts", f"WITH {PAIRS} SELECT * FROM pairs")
def fact_conflicts(spark, d):
    return conflicts.fact_conflicts(part_facts(spark, d))


@query("j23_conflicts_in_time", f"""WITH {PAIRS}, {SPANS} SELECT * FROM pairs p WHERE NOT EXISTS (
  SELECT 1 FROM spans a JOIN spans b ON a.fact_id = p.left_id AND b.fact_id = p.right_id WHERE a.e < b.s OR b.e < a.s)""")
def conflicts_in_time(spark, d):
    return conflicts.fact_conflicts_in_time(part_facts(spark, d), part_intervals(spark, d))


LINES = "iv AS (SELECT l_orderkey, o_orderdate::DATE AS s, CASE WHEN l_linenumber % 4 = 0 THEN NULL ELSE l_shipdate::DATE END AS e FROM lineitem JOIN orders ON l_orderkey = o_orderkey)"


def _order_intervals(spark, d):
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", F.to_date("o_orderdate").alias("start"), F.when(F.col("l_linenumber") % 4 != 0, F.to_date("l_shipdate")).alias("end"))


@query("j24_interval_intersection", f"WITH {LINES} SELECT l_orderkey, max(s) AS start, min(e) AS \"end\", count(*)::BIGINT AS n FROM iv GROUP BY 1 HAVING max(s) IS NULL OR min(e) IS NULL OR max(s) <= min(e)")
def interval_intersection(spark, d):
    return conflicts.intersection(_order_intervals(spark, d), "l_orderkey")


@query("u2_interval_union", f"WITH {LINES} SELECT DISTINCT l_orderkey, s AS start, e AS \"end\" FROM iv")
def interval_union(spark, d):
    return conflicts.union_of(_order_intervals(spark, d), "l_orderkey")


@query("f12_interval_validation", "SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN o_orderdate > l_shipdate THEN 'temporal_order' ELSE 'ok' END AS outcome FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def interval_validation(spark, d):
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    return l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", "l_partkey", F.coalesce(intervals.order_error(F.col("o_orderdate"), F.col("l_shipdate")), F.lit("ok")).alias("outcome"))


@query("e15_temporal_point", """WITH r AS (SELECT o_orderkey, o_orderkey % 6 AS k, CASE o_orderkey % 6 WHEN 0 THEN strftime(o_orderdate, '%Y') WHEN 1 THEN strftime(o_orderdate, '%Y-%m') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d')
   WHEN 3 THEN strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || 'Z' WHEN 4 THEN strftime(o_orderdate, '%Y') || '-02-30' ELSE 'about ' || strftime(o_orderdate, '%Y') END AS raw, o_orderdate AS t FROM orders)
 SELECT o_orderkey, raw, CASE k WHEN 0 THEN raw || '-01-01' WHEN 1 THEN raw || '-01' WHEN 2 THEN raw WHEN 3 THEN raw END AS start,
  CASE k WHEN 0 THEN raw || '-12-31' WHEN 1 THEN last_day(t)::DATE::VARCHAR WHEN 2 THEN raw WHEN 3 THEN raw END AS "end",
  CASE k WHEN 0 THEN 'year' WHEN 1 THEN 'month' WHEN 2 THEN 'day' WHEN 3 THEN 'second' END AS precision FROM r""")
def temporal_point(spark, d):
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    raw = F.when(k == 0, F.date_format(t, "yyyy")).when(k == 1, F.date_format(t, "yyyy-MM")).when(k == 2, F.date_format(t, "yyyy-MM-dd")).when(k == 3, F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'")).when(k == 4, F.concat(F.date_format(t, "yyyy"), F.lit("-02-30"))).otherwise(F.concat(F.lit("about "), F.date_format(t, "yyyy")))
    o = intervals.with_point(read(spark, d, "orders").select("o_orderkey", raw.alias("raw")), "raw", "p")
    return o.select("o_orderkey", "raw", "p.start", "p.end", "p.precision")


SIGNALS = "sig AS (SELECT lang AS subject, source AS role, n_chars % 3 AS value, CASE doc_id % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS reliability, sha256(text) AS sha, source AS family FROM documents)"


@query("t4_temporal_consolidation", f"""WITH {SIGNALS}, b AS (SELECT subject, role, value, count(*)::BIGINT AS n, count(DISTINCT CASE WHEN reliability <> 'low' THEN sha || family END)::BIGINT AS independent FROM sig GROUP BY ALL)
 SELECT *, CASE WHEN count(*) OVER (PARTITION BY subject, role) > 1 THEN 'conflicting' WHEN independent > 1 THEN 'concordant' WHEN independent = 1 THEN 'single_or_correlated' ELSE 'low_quality' END AS assessment FROM b""")
def temporal_consolidation(spark, d):
    docs = read(spark, d, "documents")
    k = F.col("doc_id") % 3
    return consolidation.consolidate(docs.select(F.col("lang").alias("subject"), F.col("source").alias("role"), (F.col("n_chars") % 3).alias("value"), F.when(k == 0, "low").when(k == 1, "medium").otherwise("high").alias("reliability"), identity.digest(F.col("text")).alias("sha"), F.col("source").alias("family")))


EVIDENCE = """ev AS (SELECT d.doc_id AS id, d.doc_id % 13 <> 0 AS active, d.doc_id % 7 <> 0 AS current, CASE WHEN l.quality = 1 THEN 'confirmed' WHEN l.quality = 0 THEN 'rejected' ELSE 'none' END AS coverage, length(d.text) AS chars, d.source
 FROM documents d LEFT JOIN labels l USING (doc_id))"""


def _evidence(spark, d):
    docs, labels = read(spark, d, "documents"), read(spark, d, "labels").select("doc_id", "quality")
    cover = F.when(F.col("quality") == 1, "confirmed").when(F.col("quality") == 0, "rejected").otherwise("none")
    return docs.join(labels, "doc_id", "left").select(F.col("doc_id").alias("id"), (F.col("doc_id") % 13 != 0).alias("active"), (F.col("doc_id") % 7 != 0).alias("current"), cover.alias("coverage"), F.length("text").cast("long").alias("chars"), "source")


@query("f10_selection_reasons", f"WITH {EVIDENCE} SELECT id, concat_ws(',', CASE WHEN NOT active THEN 'source_inactive' END, CASE WHEN NOT current THEN 'not_current' END, CASE WHEN coverage = 'confirmed' THEN 'already_covered' END, CASE WHEN chars = 0 THEN 'empty_text' END) AS reasons FROM ev")
def selection_reasons(spark, d):
    return selection.exclusion_reasons(_evidence(spark, d))


@query("o5_greedy_selection", f"""WITH RECURSIVE {EVIDENCE}, ranked AS (SELECT source AS plan, id, chars, row_number() OVER (PARTITION BY source ORDER BY id % 5, id) AS rk FROM ev WHERE chars <= 20000),
 walk AS (SELECT plan, 0::BIGINT AS rk, 0::BIGINT AS used, []::BIGINT[] AS ids FROM (SELECT DISTINCT plan FROM ranked)
  UNION ALL SELECT w.plan, r.rk, CASE WHEN len(w.ids) < 12 AND w.used + r.chars <= 20000 THEN w.used + r.chars ELSE w.used END, CASE WHEN len(w.ids) < 12 AND w.used + r.chars <= 20000 THEN list_append(w.ids, r.id) ELSE w.ids END
  FROM walk w JOIN ranked r ON r.plan = w.plan AND r.rk = w.rk + 1),
 last AS (SELECT plan, arg_max(ids, rk) AS ids FROM walk GROUP BY plan)
 SELECT plan, unnest(ids) AS id, unnest(range(1, len(ids) + 1))::BIGINT AS place FROM last""")
def greedy_selection(spark, d):
    return selection.greedy(_evidence(spark, d).select(F.col("source").alias("plan"), (F.col("id") % 5).alias("rank"), "id", "chars"), 12, 20000)


@query("a7_coverage_rollup", f"WITH {EVIDENCE} SELECT source, count(*)::BIGINT AS expected, count(*) FILTER (coverage = 'confirmed')::BIGINT AS materialized, count(*) FILTER (coverage = 'rejected')::BIGINT AS blocked, count(*) FILTER (coverage = 'none')::BIGINT AS due_missing, bool_and(coverage <> 'none') AS complete FROM ev GROUP BY source")
def coverage_rollup(spark, d):
    e, is_ = _evidence(spark, d), lambda x: F.count_if(F.col("coverage") == x)
    return e.groupBy("source").agg(F.count(F.lit(1)).alias("expected"), is_("confirmed").alias("materialized"), is_("rejected").alias("blocked"), is_("none").alias("due_missing"), F.bool_and(F.col("coverage") != "none").alias("complete"))


@query("j31_quote_containment", """SELECT d.doc_id, b.item_id, contains(CASE WHEN d.doc_id % 3 = 0 THEN d.text || ' ' || b.text || '.' ELSE d.text END, CASE WHEN d.doc_id % 6 = 3 THEN b.text || '!' ELSE b.text END) AS quoted
 FROM documents d JOIN (SELECT *, max(item_id) OVER () AS top FROM benchmark) b ON b.item_id = d.doc_id % (b.top + 1)""")
def quote_containment(spark, d):
    """Whole items; a third of the texts hold theirs, and half of these are asked for one character more."""
    b = read(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    top = b.agg(F.max("item_id").alias("top"))
    docs = read(spark, d, "documents").select("doc_id", "text").join(F.broadcast(top))  # one row
    both = docs.withColumn("item_id", F.col("doc_id") % (F.col("top") + 1)).join(b, "item_id")
    text = F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit(" "), "quote", F.lit("."))).otherwise(F.col("text"))
    return both.select("doc_id", "item_id", F.contains(text, F.when(F.col("doc_id") % 6 == 3, F.concat("quote", F.lit("!"))).otherwise(F.col("quote"))).alias("quoted"))


NAMES = """decl AS (SELECT c_custkey AS decl_id, upper(r_name) || '.' || upper(n_name) || '.' || upper(c_mktsegment) || '.K' || (c_custkey % 50) AS target, c_custkey % 2 AS signature
 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
suf AS (SELECT target, signature, array_to_string(list_slice(string_split(target, '.'), i, 4), '.') AS key FROM decl, (SELECT unnest([1, 2, 3, 4]) AS i)),
refs AS (SELECT s_suppkey AS ref_id, upper(n_name) || '.' || CASE WHEN s_suppkey % 3 = 0 THEN 'BUILDING' ELSE 'MACHINERY' END || '.K' || (s_suppkey % 60) AS key FROM supplier JOIN nation ON s_nationkey = n_nationkey),
k AS (SELECT key, count(DISTINCT (target, signature)) AS n, count(DISTINCT target) AS t, min(target) AS target FROM suf GROUP BY key)"""


@query("j18_resolver_suffix", f"WITH {NAMES} SELECT ref_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status, CASE WHEN n = 1 THEN target END AS target, coalesce(t, 0)::BIGINT AS alternatives FROM refs LEFT JOIN k USING (key)")
def resolver_suffix(spark, d):
    c, s, n, r = (read(spark, d, t) for t in ("customer", "supplier", "nation", "region"))
    places = n.join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    quoted = F.concat(F.lit('"'), F.upper("n_name"), F.lit('"'))
    declared = c.join(places, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("decl_id"), F.concat_ws(".", F.lower("r_name"), quoted, F.lower("c_mktsegment"), F.concat(F.lit("k"), (F.col("c_custkey") % 50).cast("string"))).alias("name"), (F.col("c_custkey") % 2).alias("signature"))
    refs = s.join(n, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("ref_id"), F.concat_ws(".", quoted, F.when(F.col("s_suppkey") % 3 == 0, "building").otherwise("Machinery"), F.concat(F.lit("k"), (F.col("s_suppkey") % 60).cast("string"))).alias("name"))
    return resolve.resolve(refs, declared)


@query("j21_foreign_keys", """WITH p AS (SELECT l_orderkey || '/' || l_linenumber AS key, count(*) AS n FROM lineitem WHERE l_orderkey % 10 <> 0 GROUP BY 1)
 SELECT event_id AS link_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN n = 1 THEN 'resolved' ELSE 'ambiguous' END AS status FROM events LEFT JOIN p ON p.key = user_id || '/' || (event_id % 7 + 1)""")
def foreign_keys(spark, d):
    pair = lambda a, b: F.concat(a.cast("string"), F.lit("/"), b.cast("string"))
    parents = read(spark, d, "lineitem").where("l_orderkey % 10 <> 0").select(pair(F.col("l_orderkey"), F.col("l_linenumber")).alias("key"))
    links = read(spark, d, "events").select(F.col("event_id").alias("link_id"), pair(F.col("user_id"), F.col("event_id") % 7 + 1).alias("key"))
    return resolve.foreign_keys(links, parents)


@query("s8_log_parse", f"""WITH {LOG_SQL}, g AS (SELECT event_id, CASE WHEN regexp_matches(line, '^(\\S+)\\s+([A-Z]+)\\s+(\\S+)\\s+(.*)$') THEN line END AS line FROM lines)
 SELECT event_id, regexp_extract(line, '^(\\S+)', 1) AS time, regexp_extract(line, '^\\S+\\s+([A-Z]+)', 1) AS level, regexp_extract(line, '^\\S+\\s+[A-Z]+\\s+(\\S+)', 1) AS component,
  lower(regexp_extract(line, '^\\S+\\s+[A-Z]+\\s+\\S+\\s+(\\S+)', 1)) AS event_kind FROM g""")
def log_parse(spark, d):
    return log_lines(spark, d).select("event_id", lines.log_fields(F.col("line")).alias("f")).select("event_id", "f.time", "f.level", "f.component", "f.event_kind")


@query("e26_log_pairs", f"WITH {LOG_SQL} SELECT event_id, CASE WHEN event_id % 101 <> 0 THEN list_last(regexp_extract_all(line, 'user=(\\d+)', 1)) END AS user, nullif(regexp_extract(line, 'kind=(\\S+)', 1), '') AS kind FROM lines")
def log_pairs(spark, d):
    m = log_lines(spark, d).select("event_id", lines.pairs(F.col("line")).alias("m"))
    return m.select("event_id", F.col("m")["user"].alias("user"), F.col("m")["kind"].alias("kind"))


@query("s6_json_records", """WITH e AS (SELECT event_id, CASE event_id % 7 WHEN 3 THEN props || '}' WHEN 4 THEN substr(props, 2) WHEN 5 THEN props || ' 7' WHEN 6 THEN ' [' || props || ',null] ' ELSE props END AS t FROM events)
 SELECT event_id, json_valid(t) AS valid, length(t)::BIGINT AS n FROM e""")
def json_records(spark, d):
    k, props = F.col("event_id") % 7, F.col("props")
    text = F.when(k == 3, F.concat(props, F.lit("}"))).when(k == 4, F.substring(props, F.lit(2), F.length(props))).when(k == 5, F.concat(props, F.lit(" 7"))).when(k == 6, F.concat(F.lit(" ["), props, F.lit(",null] "))).otherwise(props)
    e = read(spark, d, "events").select("event_id", text.alias("t"))
    return e.select("event_id", parsed(F.col("t")).isNotNull().alias("valid"), F.length("t").cast("long").alias("n"))


@query("w7_line_occurrences", "SELECT doc_id, row_number() OVER (PARTITION BY doc_id) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS t FROM documents)")
def line_occurrences(spark, d):
    files = read(spark, d, "documents").select(F.col("doc_id").alias("path"), "text")
    return lines.split_lines(files).select(F.col("path").alias("doc_id"), F.col("line").cast("long").alias("line"))


@query("d1_chunks", "SELECT doc_id, sha256(text) AS sha, true AS within FROM documents WHERE length(text) > 0")
def chunk_texts(spark, d):
    docs = read(spark, d, "documents").select(F.col("doc_id").alias("id"), "text")
    made = chunks.chunks(docs)
    whole = made.groupBy("id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ordinal", "text"))), lambda c: c["text"]), "").alias("text"), F.bool_and(F.length("text") <= chunks.SIZE).alias("within"))
    return whole.select(F.col("id").alias("doc_id"), identity.digest(F.col("text")).alias("sha"), "within")


@query("s13_html_signals", r"""SELECT page_id, coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '') AS title, coalesce(regexp_extract(html, '(?i)<html[^>]*\slang="([^"]*)"', 1), '') AS lang, len(regexp_extract_all(html, '(?i)<meta\s'))::BIGINT AS n_meta FROM pages""")
def html_signals(spark, d):
    return read(spark, d, "pages").select("page_id", *lines.html_signals(F.col("html")))


@query("f7_placeholders", r"""WITH t AS (SELECT doc_id, CASE doc_id % 11 WHEN 0 THEN text || ' ${' || lang || '}' WHEN 1 THEN '{{' || source || '}} ' || text WHEN 2 THEN 'x replace_ME_' || doc_id || ' y' WHEN 3 THEN 'todo' WHEN 4 THEN 'todo ' || text WHEN 5 THEN '<<' || lang || '>>' || text WHEN 6 THEN '${}' || text ELSE text END AS t FROM documents)
 SELECT doc_id, regexp_matches(t, '\$\{[^}]+\}|\{\{[^}]+\}\}|\bREPLACE_[A-Z0-9_]+\b|^(TBD|TODO|PLACEHOLDER)$|<<[^>]+>>', 'i') AS placeholder FROM t""")
def placeholders(spark, d):
    k, text = F.col("doc_id") % 11, F.col("text")
    made = (
        F.when(k == 0, F.concat(text, F.lit(" ${"), "lang", F.lit("}"))).when(k == 1, F.concat(F.lit("{{"), "source", F.lit("}} "), text)).when(k == 2, F.format_string("x replace_ME_%d y", "doc_id")).when(k == 3, "todo")
        .when(k == 4, F.concat(F.lit("todo "), text)).when(k == 5, F.concat(F.lit("<<"), "lang", F.lit(">>"), text)).when(k == 6, F.concat(F.lit("${}"), text)).otherwise(text)
    )
    return read(spark, d, "documents").select("doc_id", identity.is_placeholder(made).alias("placeholder"))


@query("e2_ids", "SELECT doc_id, 'SRC_' || substr(sha256(source || '/' || doc_id), 1, 24) AS source_id, sha256(text) AS sha FROM documents")
def ids(spark, d):
    return read(spark, d, "documents").select("doc_id", identity.uid("SRC", F.concat("source", F.lit("/"), F.col("doc_id").cast("string"))).alias("source_id"), identity.digest(F.col("text")).alias("sha"))


@query("e3_name_keys", r"SELECT p_partkey, lower(trim(regexp_replace(p_name, '\s+', ' ', 'g'))) AS key FROM part")
def name_keys(spark, d):
    return read(spark, d, "part").select("p_partkey", identity.name_key(F.col("p_name")).alias("key"))


@query("e8_locations", r"SELECT doc_id, length(substr(text, 1, n_chars // 2)) - length(replace(substr(text, 1, n_chars // 2), chr(10), '')) + 1 AS line FROM documents")
def locations(spark, d):
    return read(spark, d, "documents").select("doc_id", identity.lines_before(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).cast("long").alias("line"))


@query("f17_text_search", "SELECT doc_id, contains(lower(text), 'tion the') AS hit FROM documents")
def text_search(spark, d):
    return read(spark, d, "documents").select("doc_id", F.contains(F.lower("text"), F.lit("tion the")).alias("hit"))


@query("o11_log_tail", "SELECT doc_id, right(text, 1000) AS tail FROM documents")
def log_tail(spark, d):
    return read(spark, d, "documents").select("doc_id", F.right("text", F.lit(1000)).alias("tail"))


FACT_SQL = "SELECT p_name AS entity, p_type AS property, CASE p_size % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence FROM part"


@query("a14_snapshot_entities", f"""WITH f AS ({FACT_SQL}), o AS (SELECT entity, count(DISTINCT property)::BIGINT AS n_properties, ['low', 'medium', 'high'][max(CASE confidence WHEN 'low' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END)] AS confidence FROM f GROUP BY 1),
 r AS (SELECT entity, count(*)::BIGINT AS n_relations FROM (SELECT p_name AS entity FROM part WHERE p_partkey % 4 = 0 UNION ALL SELECT p_brand FROM part WHERE p_partkey % 4 = 0) GROUP BY 1)
 SELECT entity, coalesce(n_properties, 0) AS n_properties, confidence, coalesce(n_relations, 0) AS n_relations FROM o FULL JOIN r USING (entity)""")
def snapshot_entities(spark, d):
    p = read(spark, d, "part")
    k = F.col("p_size") % 3
    facts = p.select(F.col("p_name").alias("entity"), F.col("p_type").alias("property"), F.when(k == 0, "low").when(k == 1, "medium").otherwise("high").alias("confidence"))
    return snapshots.entities(facts, p.where("p_partkey % 4 = 0").select(F.col("p_name").alias("source"), F.col("p_brand").alias("target")))


@query("x2_snapshot_diff", """WITH b AS (SELECT c_custkey AS key, c_mktsegment AS before FROM customer WHERE c_custkey % 10 <> 0), a AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 9 = 0 THEN 'MOVED' ELSE c_mktsegment END AS after FROM customer WHERE c_custkey % 7 <> 0)
 SELECT key, CASE WHEN before IS NULL THEN 'added' WHEN after IS NULL THEN 'removed' ELSE 'changed' END AS change, before, after FROM b FULL JOIN a USING (key) WHERE before IS DISTINCT FROM after""")
def snapshot_diff(spark, d):
    c = read(spark, d, "customer").select(F.col("c_custkey").alias("key"), F.col("c_mktsegment").alias("payload"))
    after = c.where("key % 7 <> 0").withColumn("payload", F.when(F.col("key") % 9 == 0, "MOVED").otherwise(F.col("payload")))
    return snapshots.diff(c.where("key % 10 <> 0"), after)


@query("j28_dangling_edges", "SELECT o_orderkey AS edge, 'target' AS missing FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_custkey % 10 <> 0)")
def dangling_edges(spark, d):
    o, c = read(spark, d, "orders"), read(spark, d, "customer")
    nodes = c.where("c_custkey % 10 <> 0").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string")).alias("node")).union(o.select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string"))))
    return snapshots.dangling(o.select(F.col("o_orderkey").alias("edge"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("source"), F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("target")), nodes)


@query("j29_spell_containment", """WITH n AS (SELECT o_custkey AS node, min(o_orderdate) AS s, max(o_orderdate) AS e FROM orders GROUP BY 1),
 i AS (SELECT o_orderkey AS edge, o_orderdate, l_shipdate, bool_or(n.node IS NULL OR (n.s IS NULL OR coalesce(n.s <= o_orderdate, false)) AND (n.e IS NULL OR coalesce(l_shipdate <= n.e, false))) AS inside FROM lineitem JOIN orders ON l_orderkey = o_orderkey LEFT JOIN n ON n.node = o_custkey GROUP BY ALL)
 SELECT edge, bool_and(inside) AS contained FROM i GROUP BY edge""")
def spell_containment(spark, d):
    l, o = read(spark, d, "lineitem"), read(spark, d, "orders")
    nodes = o.groupBy(F.col("o_custkey").alias("node")).agg(F.min("o_orderdate").alias("start"), F.max("o_orderdate").alias("end"))
    edges = l.join(o, F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_orderkey").alias("edge"), F.col("o_custkey").alias("node"), F.col("o_orderdate").alias("start"), F.col("l_shipdate").alias("end"))
    return snapshots.spells_inside(edges, nodes)


@query("f5_schema_projection", "SELECT p_name AS tab, array_to_string(list_sort(list(DISTINCT p_brand)), ',') AS cols FROM part GROUP BY 1")
def schema_projection(spark, d):
    return read(spark, d, "part").groupBy(F.col("p_name").alias("tab")).agg(F.array_join(F.array_sort(F.collect_set("p_brand")), ",").alias("cols"))
