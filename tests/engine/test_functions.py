import random

from pyspark.sql import functions as F

from veinlode.functions import identity, intervals
from veinlode.operators import conflicts, consolidation, ledger, resolve, selection, snapshots
from veinlode.sources import chunks, lines


def test_name_key(spark):
    names = ["  A  b\tC ", "Straße", 'x "Keep  ME" y', "éA", None, ""]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r[0] for r in df.select(identity.name_key(F.col("n"))).collect()]
    assert got == ["a b c", "strasse", 'x"Keep  ME"y', "éa", None, ""]


def test_segments(spark):
    df = spark.createDataFrame([('a."B.c".[D e].`f`',), ("x",)], "n string")
    assert [r[0] for r in df.select(identity.segments(F.col("n"))).collect()] == [["A", "B.c", "D e", "f"], ["X"]]
    assert df.select(identity.suffixes(identity.segments(F.col("n")))).collect()[0][0] == ["A.B.c.D e.f", "B.c.D e.f", "D e.f", "f"]


def test_points(spark):
    def dated(start, end, precision, semantics):
        return (start, end, precision, "unknown", None, semantics, "date", None)

    def moment(text, precision, zone):
        return (text, text, precision, "explicit" if zone else "unknown", zone, "inclusive", "dateTime", None)

    want = {
        "2024": dated("2024-01-01", "2024-12-31", "year", "coverage_envelope"),
        "2024-02": dated("2024-02-01", "2024-02-29", "month", "coverage_envelope"),
        " 2023-02 ": dated("2023-02-01", "2023-02-28", "month", "coverage_envelope"),
        "2024-03-01": dated("2024-03-01", "2024-03-01", "day", "inclusive"),
        "2024-03-01T10:00:00+02:00": moment("2024-03-01T10:00:00+02:00", "second", "+02:00"),
        "2024-03-01 10:00": moment("2024-03-01T10:00:00", "minute", None),
        "2024-03-01T10:00:00.5Z": moment("2024-03-01T10:00:00.500Z", "millisecond", "UTC"),
        "2024-03-01T10:00:00.123456+00:00": moment("2024-03-01T10:00:00.123456Z", "microsecond", "UTC"),
        "2024-03-01T10:00:00.1234567Z": (None, None, None, "unknown", None, "inclusive", None, "temporal_precision"),
        "2024-02-30": None, "2024-13": None, "x": None, "2024-03-01T25:00:00Z": None, "2024-02-30T10:00:00Z": None,
    }
    before = spark.conf.get("spark.sql.session.timeZone")
    for zone in ("UTC", "Europe/Rome"):
        spark.conf.set("spark.sql.session.timeZone", zone)
        got = intervals.with_point(spark.createDataFrame([(r,) for r in want], "r string"), "r", "p").collect()
        assert {r.r: None if r.p is None else tuple(r.p) for r in got} == want
        moments = ["2024-03-01T10:00:00+02:00", "2024-03-01T10:00:00.5Z", "2024-03-01T00:30:00-05:30", "2024-03-01", "2024-03-01T10:00:00", None]
        got = spark.createDataFrame([(r,) for r in moments], "r string").select(intervals.normalized(F.col("r")).alias("n")).collect()
        assert [r.n for r in got] == ["2024-03-01T08:00:00.000000Z", "2024-03-01T10:00:00.500000Z", "2024-03-01T06:00:00.000000Z", "2024-03-01", "2024-03-01T10:00:00", None]
    spark.conf.set("spark.sql.session.timeZone", before)


def test_comparable(spark):
    rows = [("2024-01-01", "2024", False), ("2024-01-01", "2025-01-01", True), ("2024-01-01", "2024-01-01T10:00:00Z", False), (None, "2024-01-01", True), ("2024-01-01T10:00:00", "2024-01-01T10:00:00Z", False), ("2024-01-01T10:00:00+02:00", "2024-01-01T10:00:00Z", True)]
    df = spark.createDataFrame(rows[1:], "a string, b string, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", intervals.comparable(F.col("a"), F.col("b"))).collect())


def test_intersection_is_folded_over_sources(spark):
    spells = spark.createDataFrame([("a", 1, 2), ("a", 5, 6), ("b", 1, 6), ("c", None, 5), ("d", 9, None)], "subject string, start int, end int")
    links = spark.createDataFrame([("a", "x"), ("b", "x"), ("a", "y"), ("b", "y"), ("c", "y"), ("a", "z"), ("d", "z"), ("c", "u"), ("c", "v"), ("none", "v")], "source string, target string")
    got = sorted(tuple(r) for r in consolidation.propagate(spells, links, "intersection").select("target", "start", "end").collect() if r.target != "u")
    assert got == [("x", 1, 2), ("x", 5, 6), ("y", 1, 2), ("y", 5, 5)]
    assert [tuple(r) for r in consolidation.propagate(spells, links.where("target = 'u'"), "intersection").collect()] == [("u", None, 5)]


def test_open_spells_hold_everything(spark):
    edges = spark.createDataFrame([(1, "n", 1, 2), (2, "open", 1, 2), (3, "none", 1, 2), (4, "n", None, 2), (5, "left", None, 2), (6, "left", 1, 9)], "edge int, node string, start int, end int")
    nodes = spark.createDataFrame([("n", 0, 3), ("open", None, None), ("left", None, 5)], "node string, start int, end int")
    got = {r.edge: r.contained for r in snapshots.spells_inside(edges, nodes).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: True, 6: False}


def test_placeholders(spark):
    rows = [("${x}", True), ("${}", False), ("a {{b}} c", True), ("replace_me", True), ("todo", True), ("to do: todo list", False), ("Placeholder", True), ("<<x>>", True), ("plain", False)]
    df = spark.createDataFrame(rows, "t string, want boolean").withColumn("got", identity.is_placeholder(F.col("t")))
    assert [r.t for r in df.where("got <> want").collect()] == []


def test_overlap_has_open_bounds(spark):
    rows = [(1, 2, 3, 4, False), (1, 3, 3, 4, True), (None, 2, 3, None, False), (None, None, 3, 4, True), (5, None, 3, 4, False)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int, want boolean")
    assert all(r.got == r.want for r in df.withColumn("got", intervals.overlap(F.col("a"), F.col("b"), F.col("c"), F.col("d"))).collect())


def test_chunks_give_the_text_back():
    rng = random.Random(3)
    for _ in range(200):
        text = "".join(rng.choice(["# Head\n", "word ", "\n", "\n\n", "```\n", "## Sub\r\n", "é" * 30, "  \n"]) for _ in range(rng.randrange(0, 60)))
        for strategy in ("headings", "paragraph"):
            made = chunks.cut(text, 80, 10, strategy)
            assert "".join(text[a:b] for a, b, _ in made) == text and all(0 < b - a <= 80 for a, b, _ in made)
    made = chunks.cut("# A\ntext\n\n## B\nmore\n```\n# no head\n```\n# C\n", 1000, 10)
    assert [p for _, _, p in made] == [["A"], ["A", "B"], ["C"]]
    text = "# A ##\r\nx\u2028## B\ny\n~~~\n# hidden\n```\n~~~~\n#### D\n## E\n#no\n"
    made = chunks.cut(text, 1000, 1)
    assert [p for _, _, p in made] == [["A ##"], ["A ##", "B"], ["A ##", "B", "D"], ["A ##", "E"]] and text[made[1][0] :].startswith("## B")


def test_pairs_keep_the_last(spark):
    df = spark.createDataFrame([("a=1 b=2 a=3",), ("none",)], "m string").select(lines.pairs(F.col("m")).alias("p"))
    assert [r.p for r in df.collect()] == [{"b": "2", "a": "3"}, {}]


def test_greedy_skips(spark):
    rows = [("p", i, i, c) for i, c in enumerate([50, 60, 30, 25, 20, 500])]
    got = selection.greedy(spark.createDataFrame(rows, "plan string, rank long, id long, chars long"), 3, 100)
    assert [(r.id, r.place) for r in got.orderBy("place").collect()] == [(0, 1), (2, 2), (4, 3)]


def test_resolver_ignores_order_and_support(spark):
    rows = [(1, "s.t.a", "x"), (2, "S.T.A", "x"), (3, "s.u.b", "x"), (4, "r.u.b", "y")]
    refs = spark.createDataFrame([(1, "t.a"), (2, "u.b"), (3, "s.u.b"), (4, "zz")], "ref_id long, name string")
    for order in (rows, rows[::-1]):
        got = {r.ref_id: (r.status, r.target) for r in resolve.resolve(refs, spark.createDataFrame(order, "decl_id long, name string, signature string")).collect()}
        assert got == {1: ("resolved", "S.T.A"), 2: ("ambiguous", None), 3: ("resolved", "S.U.B"), 4: ("unresolved", None)}


def test_revoked_support_leaves_the_other(spark):
    t = {
        "sources": spark.createDataFrame([("s", "p", "active")], "source_id string, path string, status string"),
        "revisions": spark.createDataFrame([("r", "s", 1)], "revision_id string, source_id string, seq long"),
        "parses": spark.createDataFrame([("p1", "r", 1, "success"), ("p2", "r", 2, "error")], "parse_id string, revision_id string, seq long, status string"),
        "parse_evidence": spark.createDataFrame([("p1", "e")], "parse_id string, evidence_id string"),
        "candidates": spark.createDataFrame([(c, None, c, "r", "e", "candidate_fact", "ai") for c in ("a", "b")], "candidate_id string, parent_id string, root_id string, revision_id string, evidence_id string, record_type string, origin string"),
        "supports": spark.createDataFrame([("o", "a"), ("o", "b")], "object_id string, candidate_id string"),
        "active": spark.createDataFrame([], "candidate_id string"),
    }
    review = lambda rows: spark.createDataFrame(rows, "candidate_id string, seq long, outcome string")
    both = [("a", 1, "confirmed"), ("b", 1, "confirmed")]
    assert ledger.effective_objects(t | {"reviews": review(both)}).first().n_supports == 2
    assert ledger.effective_objects(t | {"reviews": review([*both, ("a", 2, "rejected")])}).first().n_supports == 1
    assert ledger.effective_objects(t | {"reviews": review([*both, ("a", 2, "rejected"), ("b", 2, "rejected")])}).count() == 0
    gone = t["sources"].withColumn("status", F.lit("missing"))
    assert ledger.effective_objects(t | {"reviews": review(both), "sources": gone}).count() == 0


def test_disjoint_facts_do_not_conflict(spark):
    facts = spark.createDataFrame([(1, "s", "x"), (2, "s", "y"), (3, "s", "z")], "fact_id long, slot string, value string")
    spans = spark.createDataFrame([(1, 1, 2), (2, 5, 6), (2, 9, None)], "fact_id long, start int, end int")
    got = conflicts.without_disjoint(conflicts.fact_conflicts(facts), spans)
    assert sorted((r.left_id, r.right_id) for r in got.collect()) == [(1, 3), (2, 3)]


def test_diff(spark):
    b = spark.createDataFrame([(1, "a"), (2, "b")], "key long, payload string")
    a = spark.createDataFrame([(2, "c"), (3, "d")], "key long, payload string")
    assert sorted((r.key, r.change) for r in snapshots.diff(b, a).collect()) == [(1, "removed"), (2, "changed"), (3, "added")]
    assert snapshots.diff(b, b).count() == 0


def test_zones(spark):
    """Every hour and some minutes around the changes of a few zones, against the standard library."""
    from datetime import datetime, timedelta, timezone
    from zoneinfo import ZoneInfo

    rows = []
    for zone, around in (("Europe/Rome", ("2024-03-31", "2024-10-27", "1944-09-17")), ("America/New_York", ("2021-11-07",)), ("Australia/Lord_Howe", ("2023-04-02", "2023-10-01")), ("Pacific/Apia", ("2011-12-30",)), ("UTC", ("2024-03-31",)), ("Asia/Kolkata", ("2024-01-01",))):
        for day in around:
            t = datetime.fromisoformat(day) - timedelta(hours=8)
            while t < datetime.fromisoformat(day) + timedelta(hours=32):
                rows.append((zone, t.isoformat()))
                t += timedelta(minutes=10)
    rows += [("Europe/Rome", "2024-10-27T02:30:00Z"), ("Europe/Rome", "2024-10-27"), (None, "2024-10-27T02:30"), ("Europe/Rome", "2024-07-01 10:00:00.5")]
    for session in ("UTC", "America/New_York"):
        spark.conf.set("spark.sql.session.timeZone", session)
        try:
            got = {(r.z, r.r): r.p for r in intervals.with_point(spark.createDataFrame(rows, "z string, r string"), "r", "p", F.col("z")).collect()}
        finally:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
        for zone, raw in rows[:-4]:
            local = datetime.fromisoformat(raw)
            a, b = (local.replace(tzinfo=ZoneInfo(zone), fold=f) for f in (0, 1))
            p = got[zone, raw]
            if a.utcoffset() != b.utcoffset():
                assert p.error == "ambiguous_local_time" and p.start is None, (zone, raw)
            else:
                assert (p.start, p.timezone_status, p.timezone_value, p.error) == (a.isoformat().replace("+00:00", "Z"), "resolved", zone, None), (zone, raw, p)
                assert datetime.fromisoformat(p.start).astimezone(timezone.utc) == a.astimezone(timezone.utc)
        assert (got["Europe/Rome", "2024-10-27T02:30:00Z"].timezone_status, got["Europe/Rome", "2024-10-27"].precision, got[None, "2024-10-27T02:30"].timezone_status) == ("explicit", "day", "unknown")
        assert got["Europe/Rome", "2024-07-01 10:00:00.5"].start == "2024-07-01T10:00:00.500+02:00"


def test_text_overlap(spark):
    rows = [
        ("2020-01-01", "2020-02-01", "2020-02-02", None, False), ("2020-01-01", "2020-02-01", "2020-02-01T10:00:00Z", None, True), ("2020-01-01T00:00:00Z", "2020-01-01T10:00:00+02:00", "2020-01-01T08:00:01Z", None, False),
        ("2020-01-01T00:00:00Z", "2020-01-01T10:00:00+02:00", "2020-01-01T08:00:00Z", None, True), ("2020-01-01T00:00:00", "2020-01-01T10:00:00.500", "2020-01-01T10:00:00.500000", None, True), ("2020-01-01T00:00:00", "2020-01-01T10:00:00", "2020-01-01T10:00:00.001", None, False),
        (None, "2020", None, None, True), ("2020-03-01", None, None, "2020-02-01", False), ("2020-01-01T00:00:00", "2020-01-01T10:00:00", "2020-02-01T08:00:00Z", None, True),
    ]
    got = spark.createDataFrame(rows, "a string, b string, c string, d string, want boolean").withColumn("got", intervals.text_overlap(*map(F.col, "abcd"))).collect()
    assert all(r.got == r.want for r in got), [r for r in got if r.got != r.want]
