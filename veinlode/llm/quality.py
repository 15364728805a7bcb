r"""Quality rules: base rules, then a log-likelihood ratio of hashed n-grams, in DataFrame functions alone.

Words and pairs of adjacent words are hashed into ``BUCKETS`` buckets. Two multinomials are counted over them: one of
all documents, one of all trusted documents (a table of ids). A document's score is the mean of the logarithms of their
ratio over its n-grams; it is kept when the score is not below a threshold that lies between the scores of all labelled
documents (``threshold``). Logarithms are rounded to multiples of 2^-20, so scores are sums and quotients of integers
and come out alike in whatever order they are made.

One pass counts and one scores all documents: counts leave a task as one row per bucket at most, and everything of a
document is computed inside its row. Only the counting pass brings texts and labels together: both are dealt by id and
merged, however few the labels are, since their number grows with the documents. The threshold joins the labels with
ids and scores, without a text. Ranks among scores are found by counts of ranges of scores first and then of the scores
of one range, so no task sees them all.

The SQL beside it learns from a sample by hash of about 20,000 ids of each label (``sample``): it has the same results
up to 20,000 ids of a label, and beyond those it is a sample of what is computed here.

Base rules: fewer than ``MIN_WORDS`` words, or more than 30 % of the words inside 8-word windows that the text holds
twice or more. Windows are told apart by 128 bits of hash.

Defined cases: a null or empty text has no words and fails the base rules; a document of one word has one n-gram;
documents that repeat an id or a text are judged each by itself, alike; without trusted documents (or with no
documents at all) all weights are 0 and the base rules alone decide; a score equal to the threshold (a tie) is kept;
null ids are never trusted; texts of any length are taken whole, with memory in proportion to the longest text of a
task; further columns, whatever their names, are passed on by ``judged`` except those it adds (``COLUMNS``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import WORD, forget, free_names, stash, table

MIN_WORDS = 20
WINDOW = 8
#: Sizes of the halves that windows are put together from.
_HALVES = (1, 2, 4)
#: Share of repeated words above which a text fails, in percent.
MAX_REPEATED = 30
BUCKETS = 10_000
#: Expected number of ids in a ``sample``; the operator takes all.
TRUSTED = 20_000
SCALE = 1 << 20
#: Scores counted together when a rank is looked for. Scores are within 44 * SCALE, so there are a few thousand ranges.
RANGE = 1 << 13
SYMBOLS = r"[#*$%&|<>]"
COLUMNS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "qr_score", "kept")


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(WORD), F.lit(0))


def dup_lines(text: Column) -> Column:
    """Lines with a word that are equal to an earlier line."""
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return (F.size(lines) - F.size(F.array_distinct(lines))).cast("long")


def _neighbours(items: Column, same) -> Column:
    """Of sorted ``items``, those for which ``same`` holds with the one before or after."""
    n = F.size(items)
    to_next = F.zip_with(items, F.slice(items, 2, F.greatest(n, F.lit(1))), lambda a, b: F.coalesce(same(a, b), F.lit(False)))
    from_last = F.concat(F.array(F.lit(False)), F.slice(to_next, 1, F.greatest(n - 1, F.lit(0))))
    marked = F.zip_with(items, F.zip_with(to_next, from_last, lambda a, b: a | b), lambda x, m: F.when(m, x))
    return F.filter(marked, lambda x: x.isNotNull())


def with_repeats(df: DataFrame, word: str, out: str) -> DataFrame:
    """``df`` with ``out``: words of the array column ``word`` inside windows that occur twice or more.

    Windows whose first hash, made of those of its halves, occurs once are dropped by sorting hashes; the rest is told
    apart by a second hash of its words. Their
    sorted places cover as many words as the gaps between them, eight at most each.
    """
    keys, pairs, places = free_names(df, "keys_", "pairs_", "places_")
    w = F.col(word)
    df = df.withColumn(keys, F.transform(w, lambda x: F.xxhash64(x)))
    for size in _HALVES:  # hashes of 2, 4 and 8 words; the last ones of a text, which run over its end, go afterwards
        df = df.withColumn(keys, F.zip_with(F.col(keys), F.slice(keys, size + 1, F.greatest(F.size(keys), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    df = df.withColumn(keys, F.slice(keys, 1, F.greatest(F.size(keys) - (WINDOW - 1), F.lit(0))))
    numbered = F.transform(F.col(keys), lambda k, i: F.struct(k.alias("k"), i.alias("i")))
    repeated = F.size(F.array_distinct(F.col(keys))) < F.size(F.col(keys))
    df = df.withColumn(pairs, F.when(repeated, F.array_sort(numbered)))
    second = lambda i: F.xxhash64(F.lit(WINDOW), F.slice(w, i + 1, WINDOW))
    candidates = F.transform(_neighbours(F.col(pairs), lambda a, b: a["k"] == b["k"]), lambda x: F.struct(x["k"].alias("k"), second(x["i"]).alias("l"), x["i"].alias("i")))
    df = df.withColumn(pairs, F.array_sort(candidates))
    same = _neighbours(F.col(pairs), lambda a, b: (a["k"] == b["k"]) & (a["l"] == b["l"]))
    df = df.withColumn(places, F.array_sort(F.transform(same, lambda x: x["i"])))
    gaps = F.zip_with(F.col(places), F.slice(F.col(places), 2, F.greatest(F.size(places), F.lit(1))), lambda a, b: F.least(F.coalesce(b - a, F.lit(WINDOW)), F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda s, g: s + g)
    return df.withColumn(out, F.coalesce(covered, F.lit(0).cast("long"))).drop(keys, pairs, places)


def grams(w: Column) -> Column:
    """Buckets of the words and of the pairs of adjacent words."""
    crc = lambda x: F.crc32(x.cast("binary")) % BUCKETS
    n = F.size(w)
    pairs = F.zip_with(F.slice(w, 1, F.greatest(n - 1, F.lit(0))), F.slice(w, 2, F.greatest(n - 1, F.lit(0))), lambda a, b: crc(F.concat(a, F.lit(" "), b)))
    return F.concat(F.transform(w, crc), pairs)


def labelled(labels: DataFrame) -> DataFrame:
    """The distinct non-null ids of ``labels``."""
    return labels.select("doc_id").where(F.col("doc_id").isNotNull()).distinct()


def sample(labels: DataFrame, size: int = TRUSTED) -> DataFrame:
    """About ``size`` of the distinct non-null ids of ``labels`` (all, if fewer), by a hash of the id."""
    ids = labelled(labels)
    n = ids.count()
    place = F.conv(F.substring(F.md5(F.col("doc_id").cast("string").cast("binary")), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))
    return ids.where(place < F.lit(size / max(n, 1)))


def _marked(docs: DataFrame, ids: DataFrame, own: str) -> DataFrame:
    """``docs`` with the column ``own``, true for the ids of a table. Null ids, which are in none, stay out of the join,
    so that they are no large group there."""
    (key,) = free_names(docs, f"{own}_id")
    marks = ids.select(F.col("doc_id").alias(key), F.lit(True).alias(own))
    found = docs.where("doc_id is not null").join(marks.hint("merge"), F.col("doc_id") == F.col(key), "left").drop(key).withColumn(own, F.coalesce(F.col(own), F.lit(False)))
    return found.unionByName(docs.where("doc_id is null").withColumn(own, F.lit(False)))


def weights(docs: DataFrame, trusted: DataFrame) -> list[int]:
    """Logarithm of trusted share over raw share of each bucket, in units of 1 / SCALE, each count plus one."""
    split = _marked(docs.select("doc_id", "text"), trusted, "is_trusted").select("is_trusted", words(F.col("text")).alias("w"))
    flat = split.select("is_trusted", F.explode(grams(F.col("w"))).alias("bucket"))
    counts = stash(flat.groupBy("bucket").agg(F.count(F.lit(1)).alias("raw"), F.count_if("is_trusted").alias("target")), "quality-counts")
    sums = counts.agg(F.sum("raw"), F.sum("target")).first()
    raw, target = int(sums[0] or 0), int(sums[1] or 0)
    if not target:
        return [0] * BUCKETS
    share = lambda c, n: (c + F.lit(1)).cast("double") / F.lit(float(n + BUCKETS))
    value = lambda t, r: F.round((F.log(share(t, target)) - F.log(share(r, raw))) * SCALE).cast("long")
    absent = value(F.lit(0), F.lit(0))
    rows = counts.select("bucket", value(F.col("target"), F.col("raw")).alias("w"), absent.alias("absent")).collect()  # BUCKETS rows at most
    found = {r.bucket: r.w for r in rows}
    return [found.get(b, rows[0].absent) for b in range(BUCKETS)]


def score(w: Column, values: list[int]) -> Column:
    """Mean weight of the n-grams of a text, rounded down; null without words."""
    table_ = F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>")
    g = grams(w)
    total = F.aggregate(g, F.lit(0).cast("long"), lambda s, b: s + F.get(table_, b.cast("int")))
    n = F.greatest(2 * F.size(w) - 1, F.lit(1)).cast("long")
    return F.when(F.size(w) > 0, F.floor(total / n))


def _at(scored: DataFrame, own: str, percent: int) -> int | None:
    """The least score that at least ``percent`` in a hundred of the scores where ``own`` holds are not above."""
    rows = scored.where(F.col(own) & F.col("s").isNotNull())
    part = F.floor(F.col("s") / RANGE).alias("part")
    parts = sorted(rows.groupBy(part).count().collect())  # a few thousand rows at most
    left = -(-percent * sum(n for _, n in parts) // 100)
    for k, n in parts:
        if left <= n:
            break
        left -= n
    else:
        return None
    for s, n in sorted(rows.where(part == k).groupBy("s").count().collect()):  # RANGE rows at most
        if left <= n:
            return int(s)
        left -= n


def threshold(scores: DataFrame, good: DataFrame, bad: DataFrame) -> int | None:
    """A score between those of the labelled documents: half way from the median of the bad to the lowest hundredth of
    the good; without bad ones as far below the lowest hundredth of the good as that is below their median. ``scores`` is
    (doc_id, qr_score)."""
    marks = good.select("doc_id", F.lit(True).alias("g"), F.lit(False).alias("b")).unionByName(bad.select("doc_id", F.lit(False).alias("g"), F.lit(True).alias("b")))
    marks = stash(marks.groupBy("doc_id").agg(F.max("g").alias("is_good"), F.max("b").alias("is_bad")), "quality-marks")
    scored = scores.join(marks.hint("merge"), "doc_id").select("is_good", "is_bad", F.col("qr_score").alias("s"))
    scored = stash(scored, "quality-scores")
    low, middle, worst = _at(scored, "is_good", 1), _at(scored, "is_good", 50), _at(scored, "is_bad", 50)
    for df in (marks, scored):
        forget(scores.sparkSession, df)
    if low is None:
        return None
    return (low + worst) // 2 if worst is not None and worst < low else 2 * low - middle


def measured(docs: DataFrame, values: list[int]) -> DataFrame:
    """``docs`` with the columns of COLUMNS but the verdict."""
    docs = docs.drop(*COLUMNS)
    text, word, repeats, own = free_names(docs, "whole_", "words_", "repeats_", "own_score_")
    df = docs.withColumn(text, F.coalesce(F.col("text"), F.lit("")))
    df = with_repeats(df.withColumn(word, words(F.col(text))), word, repeats).withColumn(own, score(F.col(word), values))
    t, n = F.col(text), F.size(F.col(word)).cast("long")
    failed = (n < MIN_WORDS) | (100 * F.col(repeats) > MAX_REPEATED * n)
    return df.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.alias("n_words"),
        F.length(F.array_join(word, "")).cast("long").alias("word_chars"),
        F.regexp_count(t, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        dup_lines(t).alias("n_dup_lines"),
        F.col(repeats).alias("n_repeat_words"),
        failed.alias("base_failed"),
        F.col(own).alias("qr_score"),
    )


def decided(rows: DataFrame, least: int | None) -> DataFrame:
    """What ``measured`` gives, with the verdict."""
    verdict = F.lit(True) if least is None else F.col("qr_score") >= F.lit(least)
    return rows.withColumn("kept", ~F.col("base_failed") & F.coalesce(verdict, F.lit(False)))


def judged(docs: DataFrame, values: list[int], least: int | None) -> DataFrame:
    """``docs`` with the columns of COLUMNS."""
    return decided(measured(docs, values), least)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trusted are documents labelled of good quality and not toxic."""
    docs, labels = table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "labels")
    good = stash(labelled(labels.where("quality = 1 AND toxic = 0")), "quality-good")
    bad = stash(labelled(labels.where("quality = 0")), "quality-bad")
    rows = stash(measured(docs, weights(docs, good)).drop("text"), "quality-measured")
    least = threshold(rows.select("doc_id", "qr_score"), good, bad)
    for df in (good, bad):
        forget(spark, df)
    return decided(rows, least)


ORACLE = r"""
WITH crc AS (
  SELECT list(c ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i] || range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS c FROM (SELECT unnest(range(256))::BIGINT AS i))
), d AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), g AS MATERIALIZED (
  SELECT rid, unnest(w) AS gram FROM d
  UNION ALL
  SELECT rid, unnest(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) FROM d
), h AS MATERIALIZED (
  SELECT gram, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, strlen(gram) + 1), lambda i: ('0x' || substr(hx, 2 * i - 1, 2))::BIGINT), lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 AS bucket
  FROM (SELECT DISTINCT gram, hex(encode(gram)) AS hx FROM g), crc
), ids AS (
  SELECT DISTINCT doc_id, kind FROM (SELECT doc_id, CASE WHEN quality = 0 THEN 'bad' WHEN quality = 1 AND toxic = 0 THEN 'good' END AS kind FROM labels) WHERE doc_id IS NOT NULL AND kind IS NOT NULL
), smp AS MATERIALIZED (
  SELECT doc_id, kind FROM (SELECT *, count(*) OVER (PARTITION BY kind) AS n FROM ids)
  WHERE ('0x' || substr(md5(doc_id::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0::DOUBLE < 20000.0::DOUBLE / n
), counts AS (
  SELECT bucket, count(*) AS raw, count(*) FILTER (WHERE d.doc_id IN (SELECT doc_id FROM smp WHERE kind = 'good')) AS target FROM g JOIN h USING (gram) JOIN d USING (rid) GROUP BY bucket
), tot AS (
  SELECT sum(raw)::DOUBLE AS r, sum(target)::DOUBLE AS t FROM counts
), wt AS (
  SELECT bucket, CASE WHEN t = 0 THEN 0 ELSE round((ln((target + 1)::DOUBLE / (t + 10000)) - ln((raw + 1)::DOUBLE / (r + 10000))) * 1048576)::BIGINT END AS v FROM counts, tot
), sc AS MATERIALIZED (
  SELECT rid, floor(sum(v)::DOUBLE / count(*))::BIGINT AS s FROM g JOIN h USING (gram) JOIN wt USING (bucket) GROUP BY rid
), lab AS (
  SELECT s, d.doc_id IN (SELECT doc_id FROM smp WHERE kind = 'good') AS good, d.doc_id IN (SELECT doc_id FROM smp WHERE kind = 'bad') AS bad FROM d JOIN sc USING (rid)
), q AS (
  SELECT quantile_disc(s, 0.01) FILTER (WHERE good) AS low, quantile_disc(s, 0.5) FILTER (WHERE good) AS mid, quantile_disc(s, 0.5) FILTER (WHERE bad) AS worst FROM lab
), th AS (
  SELECT CASE WHEN low IS NULL THEN NULL WHEN worst < low THEN floor((low + worst) / 2.0)::BIGINT ELSE 2 * low - mid END AS least FROM q
), win AS (
  SELECT rid, i, count(*) OVER (PARTITION BY rid, v) AS n FROM (SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS v FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM d))
), rep AS (
  SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM win WHERE n > 1) GROUP BY rid
), f AS (
  SELECT rid, doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars, len(regexp_extract_all(txt, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    list_filter(string_split(txt, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN rep USING (rid)
), b AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM f
)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines, n_repeat_words, base_failed,
  s AS qr_score, NOT base_failed AND coalesce(least IS NULL OR s >= least, false) AS kept
FROM b LEFT JOIN sc USING (rid), th
"""
