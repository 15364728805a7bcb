import pytest
from pyspark.sql import functions as F

from veinlode.operators import graph, reviews
from veinlode.sources import files, sql_text
from veinlode.streaming import events


def test_scan_and_ingest(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "x.sql").write_text("select 1")
    (tmp_path / "b.log").write_bytes("línea".encode("utf-16"))
    (tmp_path / "skip.tmp").write_text("no")
    (tmp_path / "c.bin").write_bytes(b"\xff\x00")
    found = files.scan(spark, str(tmp_path), ["*.tmp"])
    got = {r.path: r.format for r in found.collect()}
    assert got == {"a/x.sql": "sql", "b.log": "log", "c.bin": "unsupported_format"}
    known = found.where("path = 'a/x.sql'").select("path", "sha256")
    assert {r.path for r in files.ingest(found, known).collect()} == {"b.log", "c.bin"}
    assert {r.path for r in files.missing(spark.createDataFrame([("gone.txt",), ("b.log",)], "path string"), found).collect()} == {"gone.txt"}
    assert {(r.path, r.reason) for r in files.rejected(found).collect()} == {("c.bin", "unsupported_format")}
    texts = {r.path: r.text for r in files.decoded(found.where("format <> 'unsupported_format'")).collect()}
    assert texts == {"a/x.sql": "select 1", "b.log": "línea"}


def test_unsafe_paths(spark):
    rows = [("a/b", False), ("/a", True), ("a/../b", True), ("a//b", True), ("c:x", True), ("", True), (".", True), ("a.b/c..d", False)]
    df = spark.createDataFrame(rows, "p string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", files.unsafe(F.col("p"))).collect())


def test_masked_text_keeps_offsets():
    t = "a 'x;''y' -- c;\n/* ; */ b"
    m = sql_text.mask_text(t)
    assert len(m) == len(t) and m.split() == ["a", "b"] and m.index("\n") == t.index("\n")


def test_statements_and_shapes(spark):
    text = "create or replace view v.w as select * from a join \"B c\" on 1=1;; merge into t using s on (1=1);\n??"
    rows = sql_text.statements(spark.createDataFrame([("f", text), ("e", "")], "path string, text string"))
    b = F.col("bare")
    got = [(r.k, r.w, r.r) for r in rows.select("ordinal", sql_text.kind(b).alias("k"), sql_text.written(b).alias("w"), sql_text.read_tables(b).alias("r")).orderBy("ordinal").collect()]
    assert got == [("create_view", "V.W", ['"B C"', "A"]), ("merge", "T", ["S"]), ("unparsed", None, [])]


def test_gates(spark):
    evidence = spark.createDataFrame([("e", "v", "the quoted text")], "evidence_id string, revision_id string, text string")
    good = {"fact_type": "a", "entity_name": "b", "property_name": "c", "property_value": "d"}
    schema = "candidate_id string, record_type string, assertion_type string, confidence string, evidence_id string, source_revision_id string, evidence_text string, attributes map<string,string>"
    row = lambda i, **k: (i, "candidate_fact", "explicit", "high", k.get("e", "e"), k.get("r", "v"), k.get("q", "quoted"), good | k.get("a", {}))
    reviews.require_none(reviews.candidate_errors(spark.createDataFrame([row("1"), row("2")], schema), evidence))
    for bad, reason in ((row("1", q="other"), "evidence_quote_mismatch"), (row("1", e="x"), "evidence_revision_mismatch"), (row("1", r="w"), "evidence_revision_mismatch"), (row("1", e=None), "evidence_required"), (row("1", q=" \n"), "evidence_required"), (row("1", a={"fact_type": "<<x>>"}), "placeholder"), (row("1", a={"property_value": "TBD"}), "placeholder"), (row("1", a={"entity_name": ""}), "candidate_schema")):
        with pytest.raises(reviews.GateError) as e:
            reviews.require_none(reviews.candidate_errors(spark.createDataFrame([bad, row("2")], schema), evidence))
        assert e.value.reason == reason
    reviews.require_none(reviews.candidate_errors(spark.createDataFrame([row("1", a={"note": "TODO"})], schema), evidence))


def test_undated_fact_keeps_an_entity_open(spark):
    facts = spark.createDataFrame([(1, "a", "s", 1, 2), (2, "a", "s", None, None), (3, "b", "s", 3, 4)], "fact_id long, entity string, source string, start int, end int")
    nodes, edges = graph.build(facts, spark.createDataFrame([("a", "to", "c")], "source string, type string, target string"))
    spells = {r.node: (r.start, r.end) for r in nodes.where("kind = 'entity'").collect()}
    assert spells == {"entity:a": (None, None), "entity:b": (3, 4), "entity:c": (None, None)} and edges.count() == 7
    n, e = graph.gexf_lines(nodes, edges)
    assert n.count() == 7 and e.where("value like '%mentions%'").count() == 3


def test_stream_counts_every_event_once(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.unionAll(src.limit(50)).withColumn("ts", F.col("ts").cast("timestamp")).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = events.deduplicated(events.read_events(spark, str(tmp_path / "in")), "10000 days")
    q = stream.writeStream.format("memory").queryName("deduplicated").option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("deduplicated").count() == src.count()


def test_masked_literals_of_all_kinds():
    cases = [("", "$x$ ; $x$", ";b"), ("", "q'[it's; ]'", ";c"), ("a ", "'never ; ends", ""), ("", "$$ ; never", ""), ("", "'a''b;'", ";d"), ("x", "/* ; */", "y"), ("x /* ;", "", "")]
    assert [sql_text.mask_text(a + hidden + b) for a, hidden, b in cases] == [a + " " * len(hidden) + b for a, hidden, b in cases]


def test_statements_of_a_long_script(spark):
    script = "insert into t values ('a;b');\n" * 30_000
    files_ = spark.createDataFrame([("p", script), ("q", None), ("r", ""), ("s", " ; ;x")], "path string, text string")
    got = sql_text.statements(files_)
    assert got.where("path = 'p'").count() == 30_001 and [tuple(r) for r in got.where("path = 's'").collect()] == [("s", 2, "x", "x")]
