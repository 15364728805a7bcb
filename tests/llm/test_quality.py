import math
import random
import re
import zlib

from veinlode.llm import quality

WORDS = re.compile("[^\x20\x09-\x0d]+")
GOOD, BAD = "the small house stands near a river and some trees grow there", "zap!! buy$$$ now### win*** cash||| click%%% here&&&"


def _facts(text):
    text = text or ""
    w = WORDS.findall(text)
    windows = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    covered = {j for i, x in enumerate(windows) if windows.count(x) > 1 for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def _grams(text):
    w = WORDS.findall(text or "")
    return [zlib.crc32(x.encode()) % quality.BUCKETS for x in [*w, *[f"{a} {b}" for a, b in zip(w, w[1:])]]]


def _verdicts(docs, good, bad):
    raw, target = {}, {}
    for i, t in docs:
        for g in _grams(t):
            raw[g] = raw.get(g, 0) + 1
            target[g] = target.get(g, 0) + (i in good)
    nr, nt = sum(raw.values()), sum(target.values())
    value = {g: round((math.log((target[g] + 1) / (nt + quality.BUCKETS)) - math.log((raw[g] + 1) / (nr + quality.BUCKETS))) * quality.SCALE) for g in raw} if nt else dict.fromkeys(raw, 0)
    scores = [(i, sum(map(value.get, g)) // len(g) if (g := _grams(t)) else None) for i, t in docs]
    at = lambda own, p: (s := sorted(x for i, x in scores if i in own and x is not None)) and s[max(0, math.ceil(p * len(s)) - 1)]
    if not any(i in good and x is not None for i, x in scores):
        return [True] * len(docs)
    low, middle, worst = at(good, 0.01), at(good, 0.5), at(bad, 0.5)
    least = (low + worst) // 2 if worst != [] and worst < low else 2 * low - middle
    return [x is not None and x >= least for _, x in scores]


def _docs():
    pick = random.Random(5).choices
    out = [(i, " ".join(pick(GOOD.split(), k=25 + i % 9))) for i in range(60)]
    out += [(100 + i, " ".join(pick(BAD.split(), k=25 + i % 9))) for i in range(40)]
    phrase = "one two three four five six seven eight nine ten eleven twelve"
    out += [(200, None), (201, ""), (202, " \t\x0b\x0c\r\n"), (203, f"{phrase}\n{phrase}\n\n{phrase}\n"), (204, "same " * 400), (205, "a\n a\na\n\n \n \nb\x1c\na|<>"), (206, phrase + " x " + phrase[:39]), (None, GOOD * 3), (207, "漢字 é " * 12)]
    return out + [(5, GOOD + " " + BAD)] * 2


def _check(spark, tmp_path, labels):
    docs = _docs()
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    frame.withColumns({"kept": quality.F.lit("x"), "words_": quality.F.lit(1), "a.b": quality.F.lit(1)}).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = quality.op13_quality(spark, str(tmp_path)).collect()
    verdicts = _verdicts(docs, {i for i, q, t in labels if q == 1 and t == 0 and i is not None}, {i for i, q, _ in labels if q == 0 and i is not None})
    want = [(i, *(f := _facts(t)), not f[-1] and v) for (i, t), v in zip(docs, verdicts)]
    assert sorted(map(repr, want)) == sorted(repr((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.kept)) for r in got)
    return got


def test_against_a_plain_count(spark, tmp_path):
    labels = [(i, 1, 0) for i in range(0, 60, 2)] + [(100 + i, 0, 0) for i in range(0, 40, 2)] + [(None, 1, 0), (None, 0, 1), (1, 1, 1), (0, 1, 0), (999, 1, 0), (7, None, None)]
    got = {r.doc_id: r for r in _check(spark, tmp_path, labels)}
    passed = [r for r in got.values() if not r.base_failed]
    assert all(r.kept for r in passed if r.doc_id is not None and r.doc_id < 60 and r.doc_id != 5) and not any(r.kept for r in passed if r.doc_id and 100 <= r.doc_id < 140)


def test_no_labels(spark, tmp_path):
    assert all(r.kept != r.base_failed for r in _check(spark, tmp_path, []))


def test_good_labels_alone(spark, tmp_path):
    _check(spark, tmp_path, [(i, 1, 0) for i in range(60)])


def test_long_text_empty_table_and_columns(spark):
    long = "one two three four five six seven eight nine ten " * 40_000
    docs = spark.createDataFrame([(1, long, 7)], "doc_id long, text string, keys_ int")
    (r,) = quality.judged(docs, [0] * quality.BUCKETS, None).collect()
    assert (r.n_words, r.n_repeat_words, r.base_failed, r.kept, r["keys_"]) == (400_000, 400_000, True, False, 7)
    assert quality.judged(docs.where("false"), [0] * quality.BUCKETS, 0).collect() == []


def test_sample_is_bounded(spark):
    ids = spark.range(20_000).selectExpr("id as doc_id").union(spark.range(20_000).selectExpr("id as doc_id"))
    n = quality.sample(ids, 1000).count()
    assert 850 < n < 1150
