import hashlib
import zlib

from veinlode.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(r, more=0):
    fields = [r["doc_id"], r["source"], r["lang"], None if r["n_chars"] is None else r["n_chars"] + more, r["text"]]
    return _h(*["-" if f is None else f"{len(str(f).encode())}:{f}" for f in fields])


def _tree(hashes):
    """Root and, for each hash, its steps as (before, after)."""
    steps, at, level = [[] for _ in hashes], list(range(len(hashes))), hashes
    while len(level) > 1:
        for k, p in enumerate(at):
            pair = level[p // 2 * 2 : p // 2 * 2 + 2]
            steps[k].append((pair[0] if p % 2 else "", pair[1] if len(pair) == 2 and not p % 2 else ""))
        level = [_h(*level[p : p + 2]) for p in range(0, len(level), 2)]
        at = [p // 2 for p in at]
    return (level[0] if level else None), steps


def _want(rows):
    trees = {}
    for r in rows:
        trees.setdefault(r["lang"], []).append(r)
    langs = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        trees[x].sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, _leaf(r)))
    made = [_tree([_leaf(r) for r in trees[x]]) for x in langs]
    root, tops = _tree([s for s, _ in made])
    out = []
    for x, (subroot, steps), top in zip(langs, made, tops):
        for r, own in zip(trees[x], steps):
            tampered = r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 7 == 0
            back = _leaf(r, int(tampered))
            for before, after in own + top:
                back = _h(before, back, after)
            out.append((r["doc_id"], _leaf(r), subroot, root, _h(*[b + a for b, a in own + top]), back, back == root))
    return out


def _got(spark, rows, path):
    docs = spark.createDataFrame([tuple(r.get(c) for c in ("doc_id", "text", "lang", "source", "n_chars")) for r in rows], SCHEMA)
    docs.withColumns({"node": merkle.F.lit(1), "rank": merkle.F.lit(2), "a.b": merkle.F.lit(3)}).write.parquet(f"{path}/documents.parquet")
    out = merkle.op11_merkle(spark, str(path)).collect()
    return [tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in out]


def _docs(n, lang, first=0):
    return [{"doc_id": i, "text": f"text {i} é", "lang": lang, "source": None if i % 5 == 0 else "s", "n_chars": None if i % 11 == 0 else i} for i in range(first, first + n)]


def test_against_a_plain_tree(spark, tmp_path):
    rows = _docs(131, "en") + _docs(64, "", 500) + _docs(1, "z", 900) + _docs(2, None, 1000) + _docs(3, "é", 2000)
    rows += [{"doc_id": None, "text": None, "lang": "en", "source": "s", "n_chars": 3}] * 3 + [{"doc_id": 7, "text": "other", "lang": "en", "source": "s", "n_chars": 2**63 - 1}] * 2
    rows += [{"doc_id": 8, "text": "long " * 300_000, "lang": "en", "source": "s", "n_chars": 1}]
    got = _got(spark, rows, tmp_path)
    assert sorted(map(repr, got)) == sorted(map(repr, _want(rows)))
    assert {v for *_, v in got} == {True, False}


def test_one_key_holds_copies_of_one_row(spark, tmp_path):
    rows = [{"doc_id": 3, "text": "copy", "lang": "en", "source": "s", "n_chars": 4}] * 700 + _docs(20, "en", 10)
    assert sorted(map(repr, _got(spark, rows, tmp_path))) == sorted(map(repr, _want(rows)))


def test_few_rows(spark, tmp_path):
    for n in (1, 2):
        rows = _docs(n, "en", 1)
        assert sorted(map(repr, _got(spark, rows, tmp_path / str(n)))) == sorted(map(repr, _want(rows)))
    assert _got(spark, [], tmp_path / "none") == []


def test_runs_of_three(spark):
    leaves = spark.createDataFrame([(k, f"{i:02}", i, _h(str(i))) for k in ("a", "b") for i in range(11)], "key string, place string, item long, leaf string")
    got = merkle.manifest(leaves, "key", ["place"], run=3, digits=1)
    assert got.count() == 22
    rows = got.withColumn("back", merkle.folded(merkle.F.col("leaf"), merkle.F.col("steps"))).collect()
    level = [_h(str(i)) for i in range(11)]
    while len(level) > 1:
        level = [_h(*level[p : p + 3]) for p in range(0, len(level), 3)]
    assert {(r.subroot, r.root, r.back) for r in rows} == {(level[0], _h(level[0], level[0]), _h(level[0], level[0]))}
