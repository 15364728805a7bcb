import json
import random

import pytest
from pyspark.sql import functions as F

from veinlode.functions import canonical, identity
from veinlode.operators import keys, merging, review_log, reviews, selection, sweeps
from veinlode.sources import json_walk, logs

FLAGS = ", state string, leaf boolean, source_status string, current_revision boolean, current_parse boolean, current_derivation boolean"


def _canonical(value):
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def test_canonical(spark):
    values = [{"b": [1, {"d": None, "c": "é\n\"q\""}], "a": {}}, [], [[{"z": 1, "y": 2}]], "x", True, {"": {"b": 1, "a": 2}}, -3, "漢 "]
    rows = [(i, json.dumps(v)) for i, v in enumerate(values)] + [(99, "{"), (100, None)]
    got = {r.i: r.c for r in spark.createDataFrame(rows, "i int, t string").select("i", canonical.canonical(F.col("t")).alias("c")).collect()}
    assert got == {i: _canonical(v) for i, v in enumerate(values)} | {99: None, 100: None}
    texts = ["a\"b\\c/", "", None, "\t"]
    assert [r.q for r in spark.createDataFrame([(t,) for t in texts], "t string").select(canonical.quoted(F.col("t")).alias("q")).collect()] == [_canonical(t) for t in texts]


def test_name_keys(spark):
    names = {'Foo  "Bar"  Baz': 'foo"Bar"baz', " A\x1fB ": "a b", 'x "a""b" Y': 'x"a""b"y', "Straße": "strasse", 'odd " Quote': 'odd " quote', "": ""}
    got = spark.createDataFrame([(n,) for n in names], "n string").select("n", identity.name_key(F.col("n")).alias("k")).collect()
    assert {r.n: r.k for r in got} == names


def _candidates(spark, *payloads, state="confirmed"):
    rows = [(f"c{i}", json.dumps(p), s if isinstance((s := state), str) else s[i], True, "active", True, True, True) for i, p in enumerate(payloads)]
    return spark.createDataFrame(rows, "candidate_id string, payload string" + FLAGS)


def _nothing(spark):
    return spark.createDataFrame([], "object_id string, kind string, semantic_key string, payload string, subject string"), spark.createDataFrame([], "object_id string, candidate_id string")


def test_merge(spark):
    fact = {"record_type": "candidate_fact", "entity_name": "Area  X", "property_name": "Rate", "property_value": [1, {"b": 2, "a": 1}], "fact_type": "t", "assertion_type": "explicit", "confidence": "low", "attributes": {"k": {"z": 1, "a": None}}}
    same = {**dict(reversed(fact.items())), "entity_name": " area x", "property_value": [1, {"a": 1, "b": 2}], "attributes": {"k": {"a": None, "z": 1}}, "confidence": "high"}
    other = {**fact, "property_value": [{"b": 2, "a": 1}, 1]}
    kept = {"record_type": "candidate_conflict"}
    states = _candidates(spark, fact, same, other, kept, fact, state=["confirmed", "confirmed", "confirmed", "confirmed", "rejected"])
    merged = merging.merge_candidates(states, *_nothing(spark))
    objects = merged.objects.collect()
    assert len(objects) == 2 and {o.kind for o in objects} == {"fact"}
    semantic = {"entity_name": "area x", "property_name": "rate", "property_value": fact["property_value"], "fact_type": "t", "attributes": fact["attributes"]}
    import hashlib

    sha = lambda v: hashlib.sha256(_canonical(v).encode()).hexdigest()
    (o,) = [o for o in objects if o.semantic_key == sha(["fact", semantic])]
    assert o.object_id == "FACT_" + sha(semantic)[:24] and json.loads(o.payload) == {k: v for k, v in fact.items() if k != "record_type"} and o.payload == _canonical(json.loads(o.payload))
    assert sorted((s.object_id == o.object_id, s.candidate_id) for s in merged.supports.collect()) == [(False, "c2"), (True, "c0"), (True, "c1")]
    assert {(s.candidate_id, s.reason) for s in merged.skipped.collect()} == {("c3", "retained_non_materialized_type"), ("c4", "rejected")}
    again = merging.merge_candidates(states, merged.objects, merged.supports)
    assert again.objects.count() == again.supports.count() == 0
    merging.checked(merged)
    with pytest.raises(reviews.GateError, match="strict_review"):
        merging.checked(merging.merge_candidates(states, *_nothing(spark), strict=True))


def test_interval_budget(spark):
    spell = lambda k, s="s": {"record_type": "temporal_interval", "target_subject_type": "fact", "target_subject_id": s, "normalized_start": f"20{k:02}-01-01", "normalized_end": None, "original_precision": "day", "timezone_status": "unknown", "bounds_semantics": "open_end"}
    first = merging.merge_candidates(_candidates(spark, spell(1), spell(2), spell(2), spell(9, "t")), *_nothing(spark), max_intervals=2)
    merging.checked(first)
    merging.checked(merging.merge_candidates(_candidates(spark, spell(1)), first.objects, first.supports, max_intervals=2))
    with pytest.raises(reviews.GateError, match="interval_budget"):
        merging.checked(merging.merge_candidates(_candidates(spark, spell(3)), first.objects, first.supports, max_intervals=2))


def _keys(spark):
    tables = spark.createDataFrame([("A.T", "r", "t"), ("B.U", "r", "t"), ("C.U", "r", "t"), ("V", "r1", "t"), ("V", "r2", "t"), ("W", "r1", "t"), ("W", "r2", "t"), ('Q."x.y"', "r", "t")], "name string, revision_id string, data string")
    names = [("A.T", "r", "ID"), ("A.T", "r", "K"), ("B.U", "r", "ID"), ("C.U", "r", "ID"), ("V", "r1", "ID"), ("V", "r2", "ID"), ("V", "r2", "MORE"), ("W", "r1", "ID"), ("W", "r2", "ID"), ('Q."x.y"', "r", "ID")]
    columns = spark.createDataFrame([(f"{t}.{c}", t, r, "int") for t, r, c in names], "name string, table string, revision_id string, data string")
    primary = spark.createDataFrame([("A.T", ["ID", "K"]), ("A.T", ["ID", "K"]), ("W", ["ID"]), ("W", ["K"])], "table string, columns array<string>")
    return tables, columns, primary


def test_columns(spark):
    tables, columns, _ = _keys(spark)
    want = {
        "t.id": ("resolved", "unique_declaration", "A.T.ID"), "A.T.K": ("resolved", "unique_declaration", "A.T.K"), "T.none": ("unresolved", "column_absent_from_schema", None), "NO.ID": ("unresolved", "target_absent", None),
        "U.ID": ("ambiguous", "multiple_targets", None), "U.none": ("ambiguous", "column_parent_ambiguous", None), "V.MORE": ("ambiguous", "column_parent_ambiguous", None), "W.ID": ("resolved", "unique_declaration", "W.ID"),
        '"x.y".id': ("resolved", "unique_declaration", 'Q."x.y".ID'), "y.ID": ("unresolved", "target_absent", None), "MISSING": ("unresolved", "target_absent", None),
    }
    got = keys.resolve_columns(spark.createDataFrame([(n,) for n in want] * 2, "name string"), tables, columns).collect()
    assert {r.name: (r.status, r.reason, r.canonical) for r in got} == want


def test_foreign_keys(spark):
    links = [
        (1, "T", ["ID"], "A.T", ["K"], "resolved", "foreign_key_endpoints_verified"), (2, "T", ["ID", "K"], "t", [], "resolved", "foreign_key_endpoints_verified"), (3, "T", ["ID"], "W", [], "unresolved", "foreign_key_target_key_unknown"),
        (4, "T", ["ID"], "T", ["ID", "K"], "inconsistent", "foreign_key_arity"), (5, "T", [], "T", [], "inconsistent", "foreign_key_arity"), (6, "T", ["ID"], "U", ["ID"], "ambiguous", "foreign_key_ambiguous_endpoint"),
        (7, "T", ["X"], "W", ["ID"], "unresolved", "foreign_key_missing_endpoint"), (8, "NO", ["ID"], "W", ["ID"], "unresolved", "foreign_key_missing_endpoint"), (9, "V", ["ID"], "NO", ["ID"], "ambiguous", "foreign_key_ambiguous_endpoint"),
        (10, "T", ["ID"], "NO", [], "unresolved", "foreign_key_target_key_unknown"),
    ]
    frame = spark.createDataFrame([x[:5] for x in links], "link_id int, table string, columns array<string>, target_table string, target_columns array<string>")
    for rows in (frame, frame.orderBy(F.desc("link_id")).repartition(3)):
        got = {r.link_id: (r.status, r.reason) for r in keys.resolve_foreign_keys(rows, *_keys(spark)).collect()}
        assert got == {x[0]: x[5:] for x in links}


REQUEST = "candidate_id string, seq long, kind string, outcome string, actor_id string, actor_type string, reason string, expected_head string, check_head boolean, key string, payload string, child_name string"
STATE = "candidate_id string, head string, state string, leaf boolean, rule string, current_derivation boolean, order_error string"


def _requests(n, seed, candidates, shared):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        c = rng.choice(candidates)
        key = rng.choice([None, None, f"k{rng.randrange(6)}" if shared else f"{c}-k{rng.randrange(3)}"])
        rows.append((c, i, "correct" if rng.random() < 0.02 else "review", rng.choice(["confirmed", "rejected", "pending", "odd"]), rng.choice(["a", "a", "b", " "]), rng.choice(["human", "human", "policy", "robot"]), "r", rng.choice([None, "h0"]), rng.random() < 0.2, key, '{"b":1,"a":2}', f"x{i}"))
    return rows


def _one_by_one(requests, states, done):
    """The same rules over one global list of decisions."""
    known, kept, answers = {s[0]: list(s) for s in states}, dict(done), {}
    for r in requests:
        c, seq, kind, outcome, actor, actor_type, reason, expected, check, key, payload, name = r
        s = known.get(c)
        request = _canonical({"actor_id": actor, "actor_type": actor_type, "candidate_id": c, "outcome": outcome, "reason": reason})
        h = review_log._sha(request)
        if kind == "correct":
            if s is None or not s[3]:
                answers[seq] = ("not_leaf", None)
            elif expected is not None and expected != s[1]:
                answers[seq] = ("review_head_conflict", None)
            else:
                child = review_log.uid("CAND", "BATCH_" + review_log._sha(_canonical(["correction", c, json.loads(payload)]))[:24], name)
                s[1], s[2], s[3] = review_log.uid("DEC", c, child), "superseded", False
                answers[seq] = ("recorded", s[1])
            continue
        used = kept.get((actor_type, actor, key)) if key else None
        what = (
            "review_outcome" if outcome == "odd" else "actor_required" if not actor.strip() else "unknown_candidate" if s is None else "replay" if used == h else "idempotency_payload_conflict" if used
            else "review_head_conflict" if check and expected != s[1] else "not_leaf" if not s[3] else "policy_not_allowed" if actor_type == "policy" and not (actor == "a" and s[4] == "rule" and s[5]) else "actor_type" if actor_type == "robot"
            else s[6] if outcome == "confirmed" and s[6] else "no_op" if s[2] == outcome and s[1] is not None else "recorded"
        )
        if what == "recorded":
            own = key or review_log.uid("KEY", h, s[1])
            s[1], s[2] = review_log.uid("DEC", c, h, s[1], own), outcome
            kept[(actor_type, actor, own)] = h
        answers[seq] = (what, s[1] if what in ("recorded", "no_op") else None)
    return answers, {c: (s[1], s[2], s[3]) for c, s in known.items()}


@pytest.mark.parametrize("shared", [False, True])
def test_reviews_in_order(spark, shared):
    states = [(f"c{i}", "h0" if i % 2 else None, "pending" if i % 3 else "confirmed", i != 5, "rule" if i % 2 else "other", i % 4 != 1, "temporal_order" if i == 7 else None) for i in range(8)]
    requests = _requests(400, 3 + shared, [f"c{i}" for i in range(9)] + ["c0"] * 9, shared)
    done = [("human", "a", "k0" if shared else "c0-k0", "other")]
    frames = (spark.createDataFrame(requests, REQUEST).repartition(5), spark.createDataFrame(states, STATE), spark.createDataFrame(done, "actor_type string, actor_id string, key string, request_hash string"), spark.createDataFrame([("a", "rule")], "actor_id string, rule string"))
    answers = review_log.review_in_order(*frames).cache()
    want, heads = _one_by_one(requests, states, {d[:3]: d[3] for d in done})
    assert {r.seq: (r.answer, r.decision_id) for r in answers.collect()} == want
    assert {"recorded", "no_op", "replay", "idempotency_payload_conflict", "not_leaf", "review_head_conflict", "policy_not_allowed"} <= {w for w, _ in want.values()}
    after = {r.candidate_id: (r.head, r.state, r.leaf) for r in review_log.heads(answers, frames[1]).collect()}
    assert {c: s for c, s in after.items() if not c.startswith("CAND_")} == heads
    events = review_log.events(answers, frames[0]).collect()
    assert len(events) == len({e.decision_id for e in events}) == sum(w == "recorded" for w, _ in want.values()) + sum(c.startswith("CAND_") for c in after)
    opened = review_log.opened(answers, spark.createDataFrame([("c0",), ("c0",)], "candidate_id string"))
    assert opened.count() == sum(want[r[1]][0] == "recorded" for r in requests if r[0] == "c0")
    assert review_log.reconcile(opened, opened).count() == 0 and review_log.reconcile(opened, opened.limit(0)).count() == opened.count()


def test_stream_and_batch_agree(spark, tmp_path):
    states = spark.createDataFrame([(f"c{i}", None, "pending", True, "rule", True, None) for i in range(6)], STATE)
    rows = _requests(150, 11, [f"c{i}" for i in range(7)], False)
    done = spark.createDataFrame([], "actor_type string, actor_id string, key string, request_hash string")
    policies = spark.createDataFrame([("a", "rule")], "actor_id string, rule string")
    for k in range(3):
        spark.createDataFrame(rows[50 * k : 50 * k + 50], REQUEST).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(REQUEST).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = review_log.review_stream(stream, states, done, policies)
    out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(200)
    got = {r.seq: (r.answer, r.decision_id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    batch = {r.seq: (r.answer, r.decision_id) for r in review_log.review_in_order(spark.createDataFrame(rows, REQUEST), states, done, policies).collect()}
    assert got == batch and len(got) == 150


def test_conflicts_in_time(spark):
    rng = random.Random(8)
    facts = [(i, rng.choice(["hot"] * 8 + ["b", "c"]), rng.randrange(4)) for i in range(300)] + [(900, None, 1), (901, None, 2)]
    spells = []
    for i, _, _ in facts:
        for _ in range(rng.choice([0, 1, 1, 1, 1, 2, 3])):
            s = rng.randrange(60)
            spells.append((i, None if rng.random() < 0.1 else s, None if rng.random() < 0.1 else s + rng.randrange(12)))
    own = {}
    for i, s, e in spells:
        own.setdefault(i, []).append((-1 if s is None else s, 999 if e is None else e))
    want = {}
    for x, (i, slot, v) in enumerate(facts):
        for j, other, w in facts[x + 1 :]:
            if slot is not None and slot == other and v != w and not (i in own and j in own and not any(a <= d and c <= b for a, b in own[i] for c, d in own[j])):
                want[slot] = want.get(slot, 0) + 1
    got = sweeps.conflicts_in_time(spark.createDataFrame(facts, "fact_id int, slot string, value int"), spark.createDataFrame(spells, "fact_id int, start int, end int"))
    assert {r.slot: r.n_pairs for r in got.collect() if r.slot is not None} == want


def test_hot_slot_without_pairs(spark):
    facts = spark.range(10_000).selectExpr("id as fact_id", "'s' as slot", "id % 2 as value")
    spells = spark.range(10_000).selectExpr("id as fact_id", "id as start", "id as end")
    (r,) = sweeps.conflicts_in_time(facts, spells).collect()
    assert (r.n_facts, r.n_values, r.n_pairs) == (10_000, 2, 0)  # no two of them ever meet


def test_greedy_with_ties(spark):
    rows = [("p", 1, i, 10) for i in (3, 1, 2)] + [("p", 2, 9, 10)] + [(None, 1, 1, 5), ("big", 1, 1, 1000)]
    frame = spark.createDataFrame(rows, "plan string, rank int, id int, chars int")
    got = {(r.plan, r.place): r.id for r in selection.greedy(frame, 10, 100).collect()}
    assert got == {("p", 1): 1, ("p", 2): 2, ("p", 3): 3, ("p", 4): 9, (None, 1): 1}
    rng = random.Random(2)
    rows = [(f"p{i % 3}" if i % 2 else "hot", rng.randrange(5), i, rng.randrange(1, 60)) for i in range(400)]
    want = set()
    for plan in {r[0] for r in rows}:
        left, n = 500, 0
        for r in sorted((x for x in rows if x[0] == plan), key=lambda x: x[1:3]):
            if n < 40 and r[3] <= left:
                left, n = left - r[3], n + 1
                want.add((plan, r[2], n))
    got = selection.greedy(spark.createDataFrame(rows, "plan string, rank int, id int, chars int"), 40, 500).collect()
    assert {(r.plan, r.id, r.place) for r in got} == want


def test_json_walk_fails_instead_of_cutting(spark):
    deep = lambda n: "[" * n + "]" * n
    docs = spark.createDataFrame([(1, deep(5)), (2, None), (3, "{")], "id int, text string")
    assert json_walk.walk(docs, 5).count() == 4
    with pytest.raises(json_walk.TooDeep):
        json_walk.walk(docs, 3)
    assert json_walk.walk(docs.where("id > 1")).count() == 0


def test_json_lines_fail_with_their_file(spark):
    rows = [("a", 1, '{"b":1,"a":2}'), ("a", 2, " "), ("a", 3, "7"), ("b", 1, "{}"), ("b", 2, "{"), ("b", 3, "oops")]
    good, files = json_walk.records(spark.createDataFrame(rows, "path string, line int, text string"))
    assert {(r.path, r.line, r.value) for r in good.collect()} == {("a", 1, '{"a":2,"b":1}'), ("a", 3, "7")}
    assert {(r.path, r.outcome, r.records, r.first_invalid) for r in files.collect()} == {("a", "success", 2, None), ("b", "error", 0, 2)}


def test_log_offsets_over_splits(spark, tmp_path):
    rng = random.Random(4)
    lines = [rng.choice(["", "é" * rng.randrange(40), "2020-01-02 03:04:05 info web Hit page=1", '{"time":"t"}', "x\r"]) for _ in range(3000)]
    (tmp_path / "a.log").write_bytes("\n".join(lines).encode())
    (tmp_path / "b.log").write_bytes(b"one line without an end")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        got = logs.numbered(spark, str(tmp_path)).collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    own = sorted((r for r in got if r.path.endswith("a.log")), key=lambda r: r.line)
    text, at = "\n".join(lines), 0
    assert len(own) == len(lines) - (lines[-1] == "")
    for r, line in zip(own, lines):
        assert (r.text, r.start) == (line.rstrip("\r"), at) and text[r.start : r.stop] == r.text
        at += len(line) + 1
    assert [(r.line, r.start, r.stop) for r in got if r.path.endswith("b.log")] == [(1, 0, 23)]


def test_set_digests(spark):
    """Against a plain rule, whatever the order of rows and the sizes of other sets."""
    import hashlib

    from veinlode.operators import digests

    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    rows = [(k, f"{k}-{i}") for k, n in (("a", 1), ("b", 7), ("c", 8), ("d", 9), ("e", 100)) for i in range(n)]
    want = {}
    for k in "abcde":
        level = sorted(sha(t) for x, t in rows if x == k)
        while True:
            level = [sha("".join(level[i : i + 8])) for i in range(0, len(level), 8)]
            if len(level) == 1:
                break
        want[k] = (level[0], sum(x == k for x, _ in rows))
    random.Random(1).shuffle(rows)
    for these, own in ((rows + rows[:50] + [("a", None)], want), ([r for r in rows if r[0] == "b"], {"b": want["b"]})):
        got = digests.set_digests(spark.createDataFrame(these, "k string, t string").repartition(3), "k", "t", 8).collect()
        assert {r.k: (r.digest, r.n) for r in got} == own
    assert digests.set_digests(spark.createDataFrame([], "k string, t string"), "k", "t").collect() == []


def test_parse_versions(spark):
    from veinlode.operators import parse_cache

    files = [("r1", "CREATE TABLE a"), ("r2", "select * from a"), ("r3", "plain text"), ("r4", "create view v")]
    columns = [("r1", "A", "X"), ("r1", "A", "Y"), ("r4", "V", "Z")]
    version = lambda cs, o='{"b":1,"a":2}': {r.revision_id: r.parser_version for r in parse_cache.parser_versions(spark.createDataFrame(files, "revision_id string, text string"), spark.createDataFrame(cs, "revision_id string, table string, column string"), F.lit(o)).collect()}
    first = version(columns)
    assert version(columns[::-1] * 2, '{"a":2, "b":1}') == first
    more = version([*columns, ("r4", "V", "W")])  # its own table leaves r4 alone, and files without need of a schema
    assert more["r2"] != first["r2"] and (more["r3"], more["r4"], more["r1"]) == (first["r3"], first["r4"], first["r1"])
    assert all(v != first[k] for k, v in version(columns, '{"a":3,"b":1}').items())


def test_two_passes_for_every_order(spark):
    from veinlode.operators import parse_cache

    files = [("b.sql", "select * from t1 join t2 on 1=1; select 1 from gone"), ("a.sql", "create table t1 (id number, x clob)"), ("c.sql", "create table t2 (id number); delete from t2; select * from t2, t1")]
    want = {("b.sql", "T1", "external", 2), ("b.sql", "T2", "external", 1), ("b.sql", "GONE", "undeclared", 0), ("c.sql", "T2", "local", 1)}
    for rows in (files, files[::-1]):
        for small in (0, 100):
            got = parse_cache.two_pass(spark.createDataFrame(rows, "path string, text string"), small).collect()
            assert {(r.path, r.table, r.scope, r.columns) for r in got} == want
    assert [r.path for r in parse_cache.parse_order(spark.createDataFrame(files, "path string, text string")).collect()] == ["a.sql", "c.sql", "b.sql"]


def test_reactivation(spark):
    """An older version comes back as a new row with its evidence; a second run changes nothing."""
    from veinlode.operators import parse_cache

    parses = spark.createDataFrame([("p1", "r", 1, "success", "v1"), ("p2", "r", 2, "success", "v2"), ("p3", "r", 3, "error", "v1")], "parse_id string, revision_id string, seq long, status string, parser_version string")
    evidence = spark.createDataFrame([("p1", "e1"), ("p1", "e2"), ("p2", "e3")], "parse_id string, evidence_id string")
    v1 = spark.createDataFrame([("r", "v1")], "revision_id string, parser_version string")
    rows, copied = parse_cache.activations(parse_cache.decisions(v1, parses), parses, evidence, 4)
    (new,) = rows.collect()
    assert new.cached_from == "p1" and {r.evidence_id for r in copied.collect()} == {"e1", "e2"}
    log = parses.unionByName(rows.drop("cached_from"))
    assert parse_cache.in_force(log).first().parse_id == new.parse_id and parse_cache.in_force(log, F.lit(3)).first().parse_id == "p2"
    assert parse_cache.decisions(v1, log).first().action == "reuse" and parse_cache.decisions(v1, log, retry=True).first().action == "parse"
    assert {(r.parse_id, r.since, r.until) for r in parse_cache.validity(log).collect()} == {("p1", 1, 2), ("p2", 2, 4), (new.parse_id, 4, None)}


def test_import_is_all_or_nothing(spark, tmp_path):
    from veinlode.operators import imports

    evidence = spark.createDataFrame([("e1", "r", "quoted words"), ("e2", "r", "other words")], "evidence_id string, revision_id string, text string")
    ids = evidence.select("evidence_id")
    derived = spark.createDataFrame([("e2", "T.A", "assigned_value")], "evidence_id string, entity_name string, property_name string")
    fact = lambda i, **k: json.dumps({"candidate_id": i, "record_type": "candidate_fact", "assertion_type": "explicit", "confidence": "low", "source_revision_id": "r", "evidence_text": "quoted", "evidence_id": "e1", "fact_type": "technical", "entity_name": "T.A", "property_name": "assigned_value", "property_value": "1"} | k)
    lines = lambda *t: spark.createDataFrame(list(enumerate(t, 1)), "line long, text string")
    store = imports.Batches(spark, str(tmp_path / "store"))
    assert store.read() is None
    check = lambda *t, **k: imports.import_errors(lines(*t), k.get("package", ids), k.get("current", ids), evidence, derived, statements=True)
    bad = {
        "invalid_jsonl": (fact("a"), "{"), "evidence_not_in_package": (fact("a"),), "stale_package": (fact("a"),), "ai_temporal_forbidden": (fact("a", record_type="temporal_interval"),), "duplicate_candidate_id": (fact("a"), fact("a", entity_name="T.B")),
        "deterministic_component_already_present": (fact("a", evidence_id="e2", evidence_text="other"),), "evidence_quote_mismatch": (fact("a", evidence_text="no"),),
    }
    for reason, texts in bad.items():
        k = {"package": ids.where("evidence_id = 'e2'")} if reason == "evidence_not_in_package" else {"current": ids.where("evidence_id = 'e2'")} if reason == "stale_package" else {}
        rows, errors = check(*texts, **k)
        assert reason in {r.reason for r in errors.collect()}, reason
        with pytest.raises(reviews.GateError):
            imports.import_batch(store, "p1", rows, errors)
    contract = (fact("a", property_value="a = 1", property_name="assignment_expression"), fact("b", entity_name="NoDot"), fact("c", property_value="'x'"), fact("d", property_name="other"), fact("e", entity_name="t.z"), fact("f", entity_name="T.Z", property_name="assignment_expression"), fact("g", entity_name="T.OK"))
    assert {r.line for r in check(*contract)[1].collect() if r.reason == "ai_contract"} == {1, 2, 3, 4, 5, 6}
    assert store.read() is None and store.names() == []
    rows, errors = check(fact("a"), " ", fact("b", entity_name="T.B"))
    assert imports.import_batch(store, "p1", rows, errors) and not imports.import_batch(store, "p1", rows, errors)
    assert imports.import_batch(store, "p2", *check(fact("a")))
    got = store.read().collect()
    assert sorted((r.batch, r.candidate_id, r.line) for r in got) == [("p1", "a", 1), ("p1", "b", 3), ("p2", "a", 1)] and len({r.imported_id for r in got}) == 3


def test_graph_files(spark, tmp_path):
    import glob
    from xml.etree import ElementTree

    from veinlode.operators import graph_files

    spells = spark.createDataFrame([("a", "2020-01-01", "2020-12-31"), ("a", "2020-01-01", "2020-12-31"), ("b", None, "2020-06-30"), ("c", "2020-01-01T00:00:00Z", None), ("e1", "2020-02-01", "2020-03-01"), ("e2", "2020-05-01", "2020-07-01")], "id string, start string, end string")
    with pytest.raises(reviews.GateError, match="mixed_timeformat"):
        graph_files.profiles(spells, "strict")
    assert graph_files.profiles(spells, "omit") == ["date"] and graph_files.profiles(spells, "separate") == ["date", "dateTime"] and graph_files.profiles(spells.where("id = 'c'"), "strict") == ["dateTime"]
    own, left = graph_files.filtered(spells, "date")
    assert own.count() == 4 and [r.id for r in left.collect()] == ["c"]
    edges = spark.createDataFrame([("e1", "a", "b", "x<y"), ("e2", "a", "b", "z"), ("e3", "a", "c", "z")], "edge string, source string, target string, kind string")
    times = own.where("id in ('e1', 'e2')")
    with pytest.raises(reviews.GateError, match="edge_outside_node_spells"):
        graph_files.placed_edges(edges, times, own, "strict")
    kept, lost = graph_files.placed_edges(edges, times, own, "omit")
    assert {r.edge for r in kept.collect()} == {"e1", "e3"} and [r.edge for r in lost.collect()] == ["e2"]
    conflicts = spark.createDataFrame([("c1", "a.b", "a", "b")], "conflict_id string, label string, left string, right string")
    extra_nodes, extra_edges = graph_files.conflict_elements(conflicts)
    nodes = spark.createDataFrame([(i, "entity", f'label "{i}" & <more>') for i in "abc"], "node string, kind string, label string").unionByName(extra_nodes)
    graph_files.write(
        str(tmp_path / "g"), graph_files.elements(nodes, "node", "node", {"label": F.col("label")}, {"kind": F.col("kind")}, own),
        graph_files.elements(kept.unionByName(extra_edges), "edge", "edge", {c: F.col(c) for c in ("source", "target")} | {"label": F.col("kind")}, {"relation_type": F.col("kind")}, times), True,
    )
    text = "".join(open(f, encoding="utf-8").read() for f in sorted(glob.glob(str(tmp_path / "g/*/part-*"))))
    root = ElementTree.fromstring(text.encode())
    ns = "{http://gexf.net/1.3}"
    assert [n.get("id") for n in root.iter(f"{ns}node")] == ["a", "b", "c", "c1"] and len(list(root.iter(f"{ns}edge"))) == 4
    assert [(s.get("start"), s.get("end")) for s in root.find(f".//{ns}node[@id='a']").iter(f"{ns}spell")] == [("2020-01-01", "2020-12-31")]
    assert root.find(f".//{ns}node[@id='a']").get("label") == 'label "a" & <more>' and root.find(f"{ns}graph").get("timeformat") == "date"
