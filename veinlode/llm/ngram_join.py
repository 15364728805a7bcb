"""N-gram Jaccard join by MinHash banding.

Texts are lower-cased (A-Z) and cut into words; their sets of five-word shingles (64-bit hashes; a text of fewer
words is one shingle) get ``BANDS * ROWS`` minima. Texts that share all minima of a band meet in a bucket of the
shuffle on band hashes, and pairs are verified on the full shingle sets. With 24 bands of 6 rows a pair of
similarity 0.8 meets with probability 1 - (1 - 0.8^6)^24 = 0.9993, one of 0.5 with 0.31.

Texts with the same words are one item from the start, so copies are never paired. ``links.settle`` connects items
without listing the pairs of a bucket. Where items of different classes are left in one bucket, an exact step
follows: ``rest`` joins these items on their prefixes. Two sets of the similarity share one of the rarest
|s| - t |s| + 1 shingles of each, and enough is left behind the first shared one, so nothing is lost, and sets that
share common shingles only (a template) don't meet.
The links of each item are counted afterwards, over all pairs of different texts in its class: classes are dealt into
chunks of about ``CHUNK`` items, and every two chunks are one block that intersects its sets and gives counts per
item, not pairs. Items are 128-bit hashes, of which pairs hold the first 64 bits.

Defined cases: null and empty texts, or texts without a word, have no shingle and no link: each is a class of its
own. A class is named by its smallest doc_id (nulls last). Repeated rows get the same result each; a null id can
belong to a class but never names one unless all its ids are null. Texts of any length are taken whole; equal
distances can't matter, since a class is what links connect. An empty table gives no rows. Columns other than doc_id
and text are ignored, and ``keep_first`` passes them on whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinlode.llm.common import forget, free_names, stash, table
from veinlode.llm.links import components, meet, settle, starred_lists

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 24, 6
_RNG = np.random.default_rng(20)
_MULT = _RNG.integers(0, 1 << 64, 16, dtype=np.uint64) | np.uint64(1)
_A = (_RNG.integers(0, 1 << 32, BANDS * ROWS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)[:, None]
_BLOCK = 2048
#: Items of a class that are counted against each other at a time, and shingles of a block's matrix.
CHUNK, _WIDE = 1000, 4096


def tokens(text: str | None) -> list[bytes]:
    """Words of a text; bytes.split cuts at U+0020 and U+0009 to U+000D, lower() folds A-Z only."""
    return text.encode().lower().split() if text else []


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ x >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ x >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return x ^ x >> np.uint64(31)


def shingles(words: list[bytes], width: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of all runs of ``width`` words."""
    if not words:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(width, len(w))
    total = np.zeros(len(w) - n + 1, np.uint64)
    for i in range(n):
        total += w[i : len(w) - n + 1 + i] * _MULT[i]
    return np.unique(_mix(total + np.uint64(n)))


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key per band of a non-empty shingle set."""
    lo, hi = s.astype(np.uint32), (s >> np.uint64(32)).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(s), _BLOCK):
        np.minimum(low, (lo[None, k : k + _BLOCK] * _A + hi[None, k : k + _BLOCK]).min(axis=1), out=low)
    rows = low.reshape(BANDS, ROWS).astype(np.uint64)
    return _mix((rows * _MULT[:ROWS]).sum(axis=1, dtype=np.uint64) + np.arange(BANDS, dtype=np.uint64) * _MULT[15])


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 1000):
            part = batch.slice(k, 1000)
            items, keys = [], []
            for text in part.column("text").to_pylist():
                words = tokens(text)
                items.append(xxhash.xxh3_128_digest(b" ".join(words)) if words else None)
                keys.append(band_keys(shingles(words)).view(np.int64) if words else None)
            ids = pa.array([None if i is None else int.from_bytes(i[:8], "little", signed=True) for i in items], pa.int64())
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("raw"), pa.array(items, pa.binary()), ids, pa.array(keys, pa.list_(pa.int64()))], names=["doc_id", "raw", "item", "id", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 500):
            part = batch.slice(k, 500)
            made = [shingles(tokens(t)).view(np.int64) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([part.column("id"), pa.array(made, pa.list_(pa.int64()))], names=["id", "grams"])


def similar(one: list[np.ndarray], two: list[np.ndarray], threshold: float) -> np.ndarray:
    """Which sets of ``one`` and ``two`` have at least the similarity ``threshold``."""
    n = len(one)
    sizes = np.array([len(s) for s in one + two])
    of = np.repeat(np.arange(len(sizes)), sizes)
    grams, place, times = np.unique(np.concatenate(one + two), return_inverse=True, return_counts=True)
    both = times[place] > 1  # what one set alone has is in no intersection
    of, place = of[both], (np.cumsum(times > 1) - 1)[place[both]]
    order = np.argsort(place, kind="stable")
    of, place = of[order], place[order]
    common = np.zeros((n, len(two)), np.float32)
    for k in range(0, int(place[-1]) + 1 if len(place) else 0, _WIDE):
        at = slice(*np.searchsorted(place, (k, k + _WIDE)))
        has = np.zeros((len(sizes), _WIDE), np.float32)
        has[of[at], place[at] - k] = 1
        common += has[:n] @ has[n:].T
    return common >= threshold * (sizes[:n, None] + sizes[None, n:] - common.astype(np.float64))


def _counted(batches: Iterator[pa.RecordBatch], threshold: float) -> Iterator[pa.RecordBatch]:
    """(item, n) of blocks that come one after the other: links of each item with the block's other chunk."""

    def done() -> pa.RecordBatch:
        sides = [{i: s for i, (c, s) in held.items() if c == chunk} for chunk in (key[1], key[2])]
        if key[1] == key[2]:
            sets = list(sides[0].values())
            found = similar(sets, sets, threshold)
            n, names = found.sum(axis=1) - found.diagonal(), list(sides[0])
        elif all(sides):
            found = similar(*[list(side.values()) for side in sides], threshold)
            n, names = np.concatenate([found.sum(axis=1), found.sum(axis=0)]), [*sides[0], *sides[1]]
        else:
            n, names = np.empty(0), []
        return pa.RecordBatch.from_arrays([pa.array(names, pa.int64()), pa.array(n.astype(np.int64))], names=["item", "n"])

    key, held = None, {}  # by item: repeated rows have their sets more than once
    for batch in batches:
        sets, ends = batch.column("grams").values.to_numpy(zero_copy_only=False), batch.column("grams").offsets.to_numpy()
        rows = zip(*[batch.column(c).to_pylist() for c in ("root", "low", "high", "chunk", "item")])
        for r, (root, low, high, chunk, item) in enumerate(rows):
            if key != (root, low, high):
                if held:
                    yield done()
                key, held = (root, low, high), {}
            if item not in held:
                held[item] = chunk, sets[ends[r] : ends[r + 1]].copy()
    if held:
        yield done()


def degrees(roots: DataFrame, grams: DataFrame, threshold: float) -> DataFrame:
    """(item, n_links) of all items of the classes ``roots``: links to different texts of the class."""
    top = roots.select(F.col("root").alias("item"), "root").distinct()
    members = roots.select("item", "root").unionByName(top)
    sizes = members.groupBy("root").agg(F.ceil(F.count(F.lit(1)) / CHUNK).cast("int").alias("chunks"))
    dealt = members.join(sizes, "root").withColumn("chunk", F.pmod(F.xxhash64("item"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    dealt = dealt.select("item", "root", "chunk", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"))
    blocks = dealt.join(grams.withColumnRenamed("id", "item"), "item").repartition("root", "low", "high").sortWithinPartitions("root", "low", "high")
    counted = blocks.mapInArrow(lambda batches: _counted(batches, threshold), "item long, n long")
    return counted.groupBy("item").agg(F.sum("n").alias("n_links"))


def rest(stars: DataFrame, roots: DataFrame | None, grams: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b) of different classes that are candidates by prefix, among the items of buckets with more than one
    class."""
    rows = stars.select("key", F.explode(F.array("a", "b")).alias("item")).distinct()
    rows = rows.withColumn("root", F.col("item")) if roots is None else rows.join(roots, "item", "left").withColumn("root", F.coalesce("root", "item"))
    rows = stash(rows, "rooted")
    mixed = rows.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("key")
    of = rows.join(mixed, "key").select(F.col("item").alias("id"), "root").distinct()
    each = stash(grams.join(of, "id").select("id", "root", F.size("grams").alias("size"), F.explode("grams").alias("gram")), "each")
    times = stash(each.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), (F.min("root") < F.max("root")).alias("shared")), "times")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("n", "gram"))
    prefix = each.join(times, "gram").withColumn("rank", rank).where(F.col("rank") <= F.col("size") - F.ceil(threshold * F.col("size") - 1e-9) + 1)
    prefix = stash(prefix.where("shared").select("gram", "id", "root", "size", "rank"), "prefix")
    one, two = prefix.toDF("gram", "a", "ra", "sa", "ia"), prefix.toDF("gram", "b", "rb", "sb", "ib")
    # what two sets have in common from their first common shingle on is at most what is left of the shorter rest
    rest_ = F.least(F.col("sa") - F.col("ia"), F.col("sb") - F.col("ib")) + 1
    fits = (rest_ * (1 + threshold) >= threshold * (F.col("sa") + F.col("sb")) - 1e-6) & (F.least("sa", "sb") >= threshold * F.greatest("sa", "sb") - 1e-9)
    both = one.join(two, "gram").where((F.col("a") < F.col("b")) & (F.col("ra") != F.col("rb")) & fits)
    return both.select("a", "b").distinct()


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, a hash of the text as it is, and the text: rows that agree in the first two are repeated rows."""
    return docs.select("doc_id", F.xxhash64("text").alias("raw"), "text")


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, raw, class_id, n_links, first): one row per row of ``docs``.

    ``n_links`` counts the different texts of the class that are similar to this one; ``first`` marks the rows that hold the class's first (doc_id, raw).
    """
    rows = keyed(docs)
    kind = rows.schema["doc_id"].dataType.simpleString()
    signed = stash(rows.mapInArrow(_signed, f"doc_id {kind}, raw long, item binary, id long, bands array<long>"), "signed")
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "raw")
    items = signed.where("item is not null").groupBy("item").agg(F.min(place).alias("place"), F.first("id").alias("id"), F.first("bands").alias("bands"))
    items = stash(items, "items")
    stars = stash(meet(items.select(F.col("bands").alias("keys"), "id").mapInArrow(starred_lists, "key long, a long, b long")), "stars")

    wanted = stars.select(F.explode(F.array("a", "b")).alias("id")).distinct().join(items.select("id", "place.doc_id", "place.raw"), "id")
    found = rows.alias("r").join(wanted.alias("w"), F.col("r.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("r.raw") == F.col("w.raw")))
    grams = stash(found.select("id", "text").mapInArrow(_sets, "id long, grams array<long>").dropDuplicates(["id"]), "grams")  # repeated rows

    def verify(pairs: DataFrame) -> DataFrame:
        both = pairs.join(grams.toDF("a", "ga"), "a").join(grams.toDF("b", "gb"), "b")
        common = F.size(F.array_intersect("ga", "gb"))
        return both.where(common >= threshold * (F.size("ga") + F.size("gb") - common)).select("a", "b")

    roots = settle(stars, verify)
    more = stash(verify(rest(stars, roots, grams, threshold)), "links")
    if not more.isEmpty():
        roots = components(more, roots)
    if roots is None:
        named = items.select("item", "place").withColumn("n_links", F.lit(0).cast("long"))
    else:
        degree = degrees(roots, grams, threshold).withColumnRenamed("item", "id")
        rooted = items.select("item", "id", "place").join(roots.withColumnRenamed("item", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
        lowest = stash(rooted.groupBy("root").agg(F.min("place").alias("place")), "lowest")
        named = rooted.drop("place").join(lowest, "root").join(degree, "id", "left").select("item", "place", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))
    named = stash(named, "named")
    for df in (stars, grams, items):
        forget(rows.sparkSession, df)
    out = signed.select("doc_id", "raw", "item").join(named, "item", "left")
    own = F.col("item").isNull()
    return out.select(
        "doc_id",
        "raw",
        F.when(own, F.col("doc_id")).otherwise(F.col("place.doc_id")).alias("class_id"),
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        (own | (F.col("doc_id").eqNullSafe(F.col("place.doc_id")) & (F.col("raw") == F.col("place.raw")))).alias("first"),
    )


def keep_first(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with one row of each class: its first by doc_id."""
    its_id, its_raw, raw = free_names(docs, "its_id", "its_raw", "raw")
    found = near_duplicates(docs.select("doc_id", "text"), threshold).where("first").select(F.col("doc_id").alias(its_id), F.col("raw").alias(its_raw)).distinct()
    rows = docs.withColumn(raw, F.xxhash64("text"))
    kept = rows.join(found, rows["doc_id"].eqNullSafe(found[its_id]) & (rows[raw] == found[its_raw]), "left_semi")
    # repeated rows agree in id and text and are one document; texts without a word are no one's copies
    return kept.dropDuplicates(["doc_id", raw]).drop(raw)


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")
