"""Queries of JSON documents, log files and the selection of evidence."""

from __future__ import annotations

import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from veinlode.functions import intervals
from veinlode.operators import selection
from veinlode.operators.tables import shared_dir
from veinlode.plans.queries import query
from veinlode.plans.staging import read
from veinlode.sources import json_walk, logs

# --- JSON documents -------------------------------------------------------------------------------------------------

_LINKED = """linked AS (SELECT doc_id AS id, doc_id % 6 AS k, lang, n_chars, '20' || lpad((doc_id % 30)::VARCHAR, 2, '0') || '-01-02' AS day FROM documents)"""


def _linked(spark, d):
    """A JSON document for each row: nested to different depths, dates at all of them, some not JSON at all."""
    i = F.col("doc_id")
    day = F.concat(F.lit("20"), F.lpad((i % 30).cast("string"), 2, "0"), F.lit("-01-02"))
    forms = (
        '{"dateCreated":"%s","n":%d}',
        '{"parts":[{"validFrom":"%s"},{"n":[%d,{"validThrough":"2031"}]}]}',
        '{"dateModified":{"datePublished":"%s"},"x":[[%d],[]],"y":{}}',
        '["%s",%d,null,true]',
        '{"dateCreated":"%s","n":%d',
        '"%s %d"',
    )
    made = [F.when(i % 6 == k, F.format_string(f, day, F.col("n_chars"))) for k, f in enumerate(forms)]
    return read(spark, d, "documents").select(i.alias("id"), F.coalesce(*made).alias("text"))


@query("e25_json_walk", f"""WITH {_LINKED}
 SELECT id, unnest(CASE k WHEN 0 THEN ['/dateCreated', '/n'] WHEN 1 THEN ['/parts', '/parts/0', '/parts/0/validFrom', '/parts/1', '/parts/1/n', '/parts/1/n/0', '/parts/1/n/1', '/parts/1/n/1/validThrough']
    WHEN 2 THEN ['/dateModified', '/dateModified/datePublished', '/x', '/x/0', '/x/0/0', '/x/1', '/y'] WHEN 3 THEN ['/0', '/1', '/2', '/3'] ELSE []::VARCHAR[] END) AS pointer,
  unnest(CASE k WHEN 0 THEN ['"' || day || '"', n_chars::VARCHAR]
    WHEN 1 THEN ['[{{"validFrom":"' || day || '"}},{{"n":[' || n_chars || ',{{"validThrough":"2031"}}]}}]', '{{"validFrom":"' || day || '"}}', '"' || day || '"', '{{"n":[' || n_chars || ',{{"validThrough":"2031"}}]}}', '[' || n_chars || ',{{"validThrough":"2031"}}]', n_chars::VARCHAR, '{{"validThrough":"2031"}}', '"2031"']
    WHEN 2 THEN ['{{"datePublished":"' || day || '"}}', '"' || day || '"', '[[' || n_chars || '],[]]', '[' || n_chars || ']', n_chars::VARCHAR, '[]', '{{}}'] WHEN 3 THEN ['"' || day || '"', n_chars::VARCHAR, 'null', 'true'] ELSE []::VARCHAR[] END) AS value
 FROM linked""")
def json_nodes(spark, d):
    return json_walk.walk(_linked(spark, d)).select("id", "pointer", "value")


@query("e25_json_dates", f"""WITH {_LINKED}
 SELECT id, 'jsonld:/dateCreated' AS location, day AS raw_value, 'document_dateCreated' AS role FROM linked WHERE k = 0
 UNION ALL SELECT id, 'jsonld:/parts/0/validFrom', day, 'valid_from' FROM linked WHERE k = 1 UNION ALL SELECT id, 'jsonld:/parts/1/n/1/validThrough', '2031', 'valid_to' FROM linked WHERE k = 1
 UNION ALL SELECT id, 'jsonld:/dateModified/datePublished', day, 'document_datePublished' FROM linked WHERE k = 2""")
def json_dates(spark, d):
    return json_walk.date_signals(json_walk.walk(_linked(spark, d))).select("id", "location", "raw_value", "role")


@query("s7_json_documents", f"""WITH {_LINKED} SELECT id AS path, CASE WHEN k = 4 THEN 'invalid_json' ELSE 'structured_document' END AS outcome,
  CASE k WHEN 0 THEN '{{"dateCreated":"' || day || '","n":' || n_chars || '}}' WHEN 1 THEN '{{"parts":[{{"validFrom":"' || day || '"}},{{"n":[' || n_chars || ',{{"validThrough":"2031"}}]}}]}}'
   WHEN 2 THEN '{{"dateModified":{{"datePublished":"' || day || '"}},"x":[[' || n_chars || '],[]],"y":{{}}}}' WHEN 3 THEN '["' || day || '",' || n_chars || ',null,true]' WHEN 5 THEN '"' || day || ' ' || n_chars || '"' END AS value FROM linked""")
def json_documents(spark, d):
    return json_walk.documents(_linked(spark, d).select(F.col("id").alias("path"), "text"))


@query("s6_json_files", """WITH l AS (SELECT user_id AS path, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS line, event_id FROM events), v AS (SELECT * FROM l WHERE event_id % 5 <> 4)
 SELECT path, CASE WHEN min(CASE WHEN event_id % 211 = 3 THEN line END) IS NULL THEN 'success' ELSE 'error' END AS outcome, CASE WHEN min(CASE WHEN event_id % 211 = 3 THEN line END) IS NULL THEN count(*) ELSE 0 END::BIGINT AS records,
  min(CASE WHEN event_id % 211 = 3 THEN line END)::BIGINT AS first_invalid FROM v GROUP BY path""")
def json_files(spark, d):
    i = F.col("event_id")
    text = F.when(i % 5 == 4, "  ").when(i % 211 == 3, F.concat("props", F.lit("}"))).otherwise(F.col("props"))
    numbered = read(spark, d, "events").select(F.col("user_id").alias("path"), F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("line"), text.alias("text"))
    return json_walk.records(numbered)[1]


# --- logs -----------------------------------------------------------------------------------------------------------

_LOGS = r"""made AS (SELECT event_id, event_type AS file, event_id % 9 AS k, user_id AS u, strftime(ts, '%Y-%m-%d') AS day, strftime(ts, '%H:%M:%S') AS tm FROM events),
 raw AS (SELECT event_id, file, k, u, day, tm, CASE WHEN k < 4 THEN day || CASE WHEN k = 1 THEN ' ' ELSE 'T' END || tm || CASE k WHEN 2 THEN '.250Z' WHEN 3 THEN ',5+02:00' ELSE '' END || ' ' || CASE WHEN k = 1 THEN 'warn' ELSE 'ERROR' END || ' app.é Login-try user=' || u || ' x.y-z=1 user=b' || CASE WHEN k = 3 THEN chr(13) ELSE '' END
   WHEN k = 4 THEN '{"time":"' || day || '","level":"info","logger":"web","msg":"Hit page ' || u || '"}' WHEN k = 5 THEN ' {"timestamp":"","time":"t","message":""}' WHEN k = 6 THEN '[1,2]' WHEN k = 7 THEN '' ELSE 'word LEVEL comp no time here' END AS line FROM made),
 num AS (SELECT *, row_number() OVER w AS line_no, coalesce(sum(length(line) + 1) OVER (PARTITION BY file ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM raw WINDOW w AS (PARTITION BY file ORDER BY event_id))"""


@query("s8_log_events", f"""WITH {_LOGS}
 SELECT file, line_no::BIGINT AS line, start::BIGINT AS start, (start + length(rtrim(line, chr(13))))::BIGINT AS stop, CASE WHEN k < 6 THEN 'log_event' ELSE 'log_unparsed' END AS type,
  CASE WHEN k < 4 THEN day || CASE WHEN k = 1 THEN ' ' ELSE 'T' END || tm || CASE k WHEN 2 THEN '.250Z' WHEN 3 THEN ',5+02:00' ELSE '' END WHEN k = 4 THEN day WHEN k = 5 THEN 't' END AS timestamp,
  CASE WHEN k = 1 THEN 'warn' WHEN k < 4 THEN 'ERROR' WHEN k = 4 THEN 'info' END AS level, CASE WHEN k < 4 THEN 'app.é' WHEN k = 4 THEN 'web' WHEN k = 5 THEN 'log' END AS component,
  CASE WHEN k < 4 THEN 'login-try' WHEN k = 4 THEN 'hit' WHEN k = 5 THEN '' END AS event_kind,
  CASE WHEN k < 4 THEN '{{"user":"b","x.y-z":"1"}}' WHEN k = 4 THEN '{{"level":"info","logger":"web","msg":"Hit page ' || u || '","time":"' || day || '"}}' WHEN k = 5 THEN '{{"message":"","time":"t","timestamp":""}}' END AS attributes
 FROM num WHERE k <> 7""")
def log_events(spark, d):
    e, i, u = read(spark, d, "events"), F.col("event_id"), F.col("user_id").cast("string")
    k = i % 9
    day, time = F.date_format("ts", "yyyy-MM-dd"), F.date_format("ts", "HH:mm:ss")
    plain = F.concat(
        day, F.when(k == 1, " ").otherwise("T"), time, F.when(k == 2, ".250Z").when(k == 3, ",5+02:00").otherwise(""), F.when(k == 1, " warn").otherwise(" ERROR"),
        F.lit(" app.é Login-try user="), u, F.lit(" x.y-z=1 user=b"), F.when(k == 3, "\r").otherwise(""),
    )
    json = F.concat(F.lit('{"time":"'), day, F.lit('","level":"info","logger":"web","msg":"Hit page '), u, F.lit('"}'))
    line = F.when(k < 4, plain).when(k == 4, json).when(k == 5, ' {"timestamp":"","time":"t","message":""}').when(k == 6, "[1,2]").when(k == 7, "").otherwise("word LEVEL comp no time here")
    path = f"{shared_dir(spark)}/logs-{uuid.uuid4().hex}"
    e.select("event_type", "event_id", line.alias("value")).repartition("event_type").sortWithinPartitions("event_type", "event_id").select("event_type", "value").write.partitionBy("event_type").option("lineSep", "\n").text(path)
    found = logs.events(logs.numbered(spark, path))
    return found.select(F.regexp_extract("path", "event_type=([^/]+)/", 1).alias("file"), "line", "start", "stop", "type", "timestamp", "level", "component", "event_kind", "attributes")


# --- selection ------------------------------------------------------------------------------------------------------

_PLAN = """ev AS (SELECT doc_id AS id, lang AS plan, source || '/' || doc_id % 4 AS path, CASE WHEN doc_id % 12 = 5 THEN 'chunk' ELSE 'fragment' END AS kind, ['ddl_table', 'excel_region', 'java_class', 'xml_text'][doc_id % 4 + 1] AS type, n_chars AS chars,
  CASE WHEN doc_id % 29 = 4 THEN '' ELSE 'L' END AS locator, doc_id % 13 <> 0 AS active, doc_id % 7 <> 0 AS current, doc_id % 23 = 6 AS derived FROM documents),
 cand AS (SELECT doc_id AS id, CASE WHEN quality = 1 THEN 'pending' ELSE 'rejected' END AS state, doc_id % 5 <> 0 AS leaf FROM labels UNION ALL SELECT doc_id, CASE WHEN toxic = 1 THEN 'confirmed' ELSE 'rejected' END, true FROM labels WHERE doc_id % 2 = 0),
 cov AS (SELECT id, CASE WHEN bool_or(state = 'confirmed') THEN 'confirmed' WHEN bool_or(state = 'pending') THEN 'pending' ELSE 'rejected' END AS coverage FROM cand WHERE leaf GROUP BY id)"""


def _selection(spark, d):
    i = F.col("doc_id")
    evidence = read(spark, d, "documents").select(
        i.alias("evidence_id"), F.col("lang").alias("plan"), F.concat("source", F.lit("/"), (i % 4).cast("string")).alias("path"), F.when(i % 12 == 5, "chunk").otherwise("fragment").alias("kind"),
        F.element_at(F.array(*map(F.lit, ("ddl_table", "excel_region", "java_class", "xml_text"))), (i % 4 + 1).cast("int")).alias("type"), F.col("n_chars").alias("chars"),
        F.when(i % 29 == 4, "").otherwise("L").alias("locator"), (i % 13 != 0).alias("active"), (i % 7 != 0).alias("current"),
    )
    labels = read(spark, d, "labels")
    first = labels.select(i.alias("evidence_id"), F.when(F.col("quality") == 1, "pending").otherwise("rejected").alias("state"), (i % 5 != 0).alias("leaf"))
    second = labels.where(i % 2 == 0).select(i.alias("evidence_id"), F.when(F.col("toxic") == 1, "confirmed").otherwise("rejected").alias("state"), F.lit(True).alias("leaf"))
    outcomes = evidence.select("evidence_id", F.when(F.col("evidence_id") % 23 == 6, "materialized_deterministically").otherwise("due_missing").alias("outcome"))
    return evidence, first.unionByName(second), outcomes


@query("j14_coverage_states", f"WITH {_PLAN} SELECT id AS evidence_id, coverage FROM cov")
def coverage_states(spark, d):
    return selection.coverage_states(_selection(spark, d)[1])


@query("o4_selection_rank", f"""WITH {_PLAN} SELECT id AS evidence_id, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN kind = 'chunk' THEN 0 WHEN type = 'excel_region' THEN 1 ELSE 2 END, path, id)::BIGINT AS place FROM ev WHERE active AND current""")
def selection_rank(spark, d):
    evidence, candidates, outcomes = _selection(spark, d)
    plan = selection.selection_plan(evidence, candidates, outcomes, "domain_interpretation", 10**9, 10**15)
    return plan.where("outcome = 'included'").select("evidence_id", "place")


@query("i1_selection_plan", f"""WITH RECURSIVE {_PLAN}, why AS (
  SELECT e.*, coalesce(coverage, 'no_candidate') AS coverage, list_filter([CASE WHEN NOT active THEN 'revision_not_current_or_inactive' WHEN NOT current THEN 'parser_output_superseded' END, CASE WHEN kind <> 'fragment' THEN 'kind_not_allowed' END,
    CASE WHEN type = 'xml_text' THEN 'fragment_type_not_allowed' END, CASE WHEN derived THEN 'deterministic_components_complete' END, CASE WHEN coverage = 'rejected' THEN 'governed_rejection' END, CASE WHEN locator = '' THEN 'locator_missing' END], lambda x: x IS NOT NULL) AS codes
  FROM ev e LEFT JOIN cov USING (id)),
 ranked AS (SELECT plan, id, chars, row_number() OVER (PARTITION BY plan ORDER BY CASE WHEN type = 'excel_region' THEN 1 ELSE 2 END, path, id) AS rk FROM why WHERE len(codes) = 0),
 walk AS (SELECT plan, 0::BIGINT AS rk, 0::BIGINT AS used, 0::BIGINT AS n, false AS took, 0::BIGINT AS id FROM (SELECT DISTINCT plan FROM ranked)
  UNION ALL SELECT plan, rk, CASE WHEN ok THEN used + chars ELSE used END, n + ok::BIGINT, ok, id FROM (SELECT w.plan, r.rk, w.used, w.n, r.chars, r.id, w.n < 60 AND w.used + r.chars <= 90000 AS ok FROM walk w JOIN ranked r ON r.plan = w.plan AND r.rk = w.rk + 1))
SELECT y.plan, y.id AS evidence_id, coverage, CASE WHEN took THEN 'included' ELSE 'excluded' END AS outcome, CASE WHEN took THEN 'included_by_policy' WHEN len(codes) = 0 THEN 'budget_exceeded' ELSE array_to_string(codes, ',') END AS reason_codes, CASE WHEN took THEN n END AS place
FROM why y LEFT JOIN (SELECT * FROM walk WHERE rk > 0) w ON w.id = y.id""")
def selection_plan(spark, d):
    return selection.selection_plan(*_selection(spark, d), "technical_extraction", 60, 90_000).withColumn("reason_codes", F.array_join("reason_codes", ","))


# --- local times ----------------------------------------------------------------------------------------------------


@query("e15_zoned_times", """WITH t AS (SELECT event_id, make_timestamp(CASE WHEN event_id % 2 = 0 THEN 1711846800 ELSE 1729990800 END::BIGINT * 1000000 - 14400000000 + (event_id % 60) * 600000000) AS l FROM events),
 e AS (SELECT event_id, strftime(l, '%Y-%m-%dT%H:%M:%S') AS raw, l >= TIMESTAMP '2024-03-31 02:00:00' AND l < TIMESTAMP '2024-03-31 03:00:00' OR l >= TIMESTAMP '2024-10-27 02:00:00' AND l < TIMESTAMP '2024-10-27 03:00:00' AS bad,
   l >= TIMESTAMP '2024-03-31 03:00:00' AND l < TIMESTAMP '2024-10-27 02:00:00' AS summer FROM t)
 SELECT event_id, raw, CASE WHEN NOT bad THEN raw || CASE WHEN summer THEN '+02:00' ELSE '+01:00' END END AS start, CASE WHEN bad THEN 'unknown' ELSE 'resolved' END AS timezone_status, CASE WHEN bad THEN 'ambiguous_local_time' END AS error FROM e""")
def zoned_times(spark, d):
    i = F.col("event_id")
    local = F.when(i % 2 == 0, 1711846800).otherwise(1729990800).cast("long") * 1_000_000 - 14_400_000_000 + (i % 60) * 600_000_000
    raw = F.date_format(F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'") + F.make_dt_interval(secs=(local / 1_000_000).cast("decimal(18,6)")), "yyyy-MM-dd'T'HH:mm:ss")
    found = intervals.with_point(read(spark, d, "events").select("event_id", raw.alias("raw")), "raw", "p", F.lit("Europe/Rome"))
    return found.select("event_id", "raw", "p.start", "p.timezone_status", "p.error")
