"""Queries over staged files: delimited tables, mails, forms; fingerprints and staleness."""

from __future__ import annotations

from pyspark.sql import functions as F

from veinlode.plans.queries import query
from veinlode.plans.staging import read
from veinlode.sources import documents


@query("s5_table_cells", """WITH r AS (SELECT c_custkey::VARCHAR AS path, unnest([
  {'ordinal': 1, 'a': 2, 'z': 3, 'name': 'key', 'value': c_custkey::VARCHAR}, {'ordinal': 1, 'a': 2, 'z': 3, 'name': 'text', 'value': c_mktsegment || ';' || chr(10) || 'x'},
  {'ordinal': 2, 'a': 4, 'z': 4, 'name': 'key', 'value': '0'}, {'ordinal': 2, 'a': 4, 'z': 4, 'name': 'text', 'value': c_name}]) AS c FROM customer)
 SELECT path, c.ordinal, c.a AS line_start, c.z AS line_end, c.name, c.value FROM r""")
def table_cells(spark, d):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("key;text\n"), k, F.lit(';"'), F.col("c_mktsegment"), F.lit(';\nx"\n0;'), F.col("c_name"), F.lit("\n"))
    made = documents.tables(read(spark, d, "customer").select(k.alias("path"), text.alias("text")))
    return made.where("kind = 'cell'").select("path", "ordinal", "line_start", "line_end", "name", "value")


@query("s10_mails", """SELECT conv_id || '/' || turn AS path, 'header' AS kind, 'from' AS name, role || '@example.org' AS value FROM conversations
 UNION ALL SELECT conv_id || '/' || turn, 'header', 'subject', 'turn ' || turn FROM conversations
 UNION ALL SELECT conv_id || '/' || turn, 'body', 'text/plain', length(text)::VARCHAR FROM conversations""")
def mails(spark, d):
    c = read(spark, d, "conversations")
    path = F.concat(F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    text = F.concat(F.lit("From: "), "role", F.lit("@example.org\nSubject: turn "), F.col("turn").cast("string"), F.lit("\nContent-Type: text/plain; charset=utf-8\nContent-Transfer-Encoding: base64\n\n"), F.base64(F.col("text").cast("binary")), F.lit("\n"))
    made = documents.mails(c.select(path.alias("path"), text.alias("text")))
    return made.select("path", "kind", "name", F.when(F.col("kind") == "body", F.length("value").cast("string")).otherwise(F.col("value")).alias("value"))


@query("s9_form_fields", """SELECT p_partkey::VARCHAR AS path, 'F' || p_partkey || '.B.' || i.n AS name, 'PARTS.' || i.c AS value, i.m AS detail
 FROM part, (SELECT unnest([{'n': 'SIZE', 'c': 'P_SIZE', 'm': 'write'}, {'n': 'BRAND', 'c': 'P_BRAND', 'm': NULL}]) AS i) WHERE p_partkey % 10 <> 0
 UNION ALL SELECT p_partkey::VARCHAR, 'unsafe_xml', NULL, NULL FROM part WHERE p_partkey % 10 = 0""")
def form_fields(spark, d):
    k = F.col("p_partkey").cast("string")
    text = F.concat(F.when(F.col("p_partkey") % 10 == 0, "<!DOCTYPE x>").otherwise(""), F.lit('<f:form xmlns:f="urn:f" name="F'), k, F.lit('"><block name="B" table="PARTS"><item name="SIZE" column="P_SIZE" mode="write"/><item name="BRAND" column="P_BRAND" mode="maybe"/><button name="GO" operation="P.RUN"/></block></f:form>'))
    made = documents.forms(read(spark, d, "part").select(k.alias("path"), text.alias("text")))
    return made.where("kind in ('field', 'error')").select("path", "name", "value", "detail")


@query("t2_html_dates", r"""SELECT page_id, len(regexp_extract_all(html, '\d{4}-\d{2}-\d{2}'))::BIGINT AS n_dates, nullif(regexp_extract(html, '\d{4}-\d{2}-\d{2}'), '') AS first_date FROM pages""")
def html_dates(spark, d):
    day = F.lit(r"\d{4}-\d{2}-\d{2}")
    first = F.regexp_extract("html", r"\d{4}-\d{2}-\d{2}", 0)
    return read(spark, d, "pages").select("page_id", F.regexp_count("html", day).cast("long").alias("n_dates"), F.when(first != "", first).alias("first_date"))


@query("j32_stale_items", "SELECT doc_id FROM documents WHERE doc_id % 3 = 0 AND doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def stale_items(spark, d):
    package, current = read(spark, d, "documents").where("doc_id % 3 = 0").select("doc_id"), read(spark, d, "labels").where("quality = 1").select("doc_id")
    return package.join(current, "doc_id", "left_anti")


@query("a21_fingerprint", """WITH h AS (SELECT source, ('0x' || substr(sha256(doc_id || ':' || sha256(text)), 1, 12))::BIGINT AS h FROM documents)
 SELECT source, count(*)::BIGINT AS n, sum(h)::DECIMAL(38, 0)::VARCHAR AS total, bit_xor(h)::BIGINT AS parity FROM h GROUP BY source""")
def fingerprint(spark, d):
    """Order-free state of a set: count, sum and parity of its members' hashes, so that no list is collected."""
    member = F.sha2(F.concat(F.col("doc_id").cast("string"), F.lit(":"), F.sha2("text", 256)), 256)
    h = F.conv(F.substring(member, 1, 12), 16, 10).cast("long")
    rows = read(spark, d, "documents").select("source", h.alias("h"))
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("h").cast("decimal(28,0)")).cast("string").alias("total"), F.bit_xor("h").alias("parity"))
