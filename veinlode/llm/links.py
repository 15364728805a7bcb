"""Connected groups from blocks of candidates, without listing the pairs of a block.

``starred`` joins the ids of a block to one of them where the rows are made, ``meet`` does the same for what tasks have
left, and ``settle`` verifies these edges and connects what is linked. No block is gathered, and every step has about
as many rows as the blocks. ``undecided`` then deals the blocks that still hold several groups, so that all their pairs
can be compared.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veinlode.llm.common import forget, stash

#: Items of a block, and the sum of their sizes, that are compared with each other at a time.
CHUNK, SIZE = 1000, 1 << 23


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over the (item, root) rows of one partition: every item but the smallest of its local group."""
    up: dict = {}
    kinds = None
    for batch in batches:
        kinds = batch.schema
        for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            for z in (x, y):
                up.setdefault(z, z)
            while up[x] != x:
                up[x] = x = up[up[x]]
            while up[y] != y:
                up[y] = y = up[up[y]]
            if x != y:
                up[max(x, y)] = min(x, y)
    if kinds is not None:
        items = [x for x in up if up[x] != x]
        tops = []
        for x in items:
            while up[x] != x:
                x = up[x]
            tops.append(x)
        yield pa.RecordBatch.from_arrays([pa.array(items, kinds.field(0).type), pa.array(tops, kinds.field(1).type)], names=["item", "root"])


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(a, b) to (item, root): the smallest item that links lead to, for all items but the roots themselves.

    ``known`` is such a result for links found before. Rows are contracted by union-find in each partition, dealt by
    item, and followed to the root's own root; a task sees the rows of its partition only. It ends when every item
    has one root and no root is an item.
    """
    spark = links.sparkSession
    rows = links.select(F.greatest("a", "b").alias("item"), F.least("a", "b").alias("root"))
    rows = rows if known is None else rows.unionByName(known.select("item", "root"))
    schema = rows.schema
    rows = stash(rows.mapInArrow(_joined, schema), "roots")
    while True:
        ends = rows.select(F.col("item").alias("k"), F.col("root").alias("r"), F.lit(0).alias("is_root")).unionByName(rows.select(F.col("root").alias("k"), F.lit(None).cast(schema["root"].dataType).alias("r"), F.lit(1).alias("is_root")))
        per = ends.groupBy("k").agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.max("is_root").alias("is_root"))
        if per.where("lo is not null and (lo < hi or is_root = 1)").isEmpty():
            return rows.distinct()
        dealt = rows.repartition("item").mapInArrow(_joined, schema)  # the same rows whenever it is computed
        far = dealt.groupBy(F.col("item").alias("root")).agg(F.min("root").alias("far"))
        jumped = stash(dealt.join(far, "root", "left").select("item", F.coalesce("far", "root").alias("root")), "roots")
        forget(spark, rows)
        rows = jumped


_STAR = "key long, a long, b long"


def _salt(keys: np.ndarray) -> np.ndarray:
    """Puts the ids of each block in another order, so that an id is not the centre of all its blocks."""
    x = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (x ^ x >> np.uint64(29)).view(np.int64)


def starred(keys: np.ndarray, ids: np.ndarray) -> pa.RecordBatch:
    """Blocks (key, id) as stars: for each block a row (key, salted centre, null), and (key, centre, id) for its other
    ids."""
    salted = ids ^ _salt(keys)
    order = np.lexsort((salted, keys))
    keys, ids, salted = keys[order], ids[order], salted[order]
    new = np.concatenate(([True], keys[1:] != keys[:-1]))[: len(keys)]
    keep = new | np.concatenate(([True], ids[1:] != ids[:-1]))[: len(keys)]
    first = np.flatnonzero(new)[np.cumsum(new) - 1]
    a = np.where(new, salted, ids[first])
    return pa.RecordBatch.from_arrays([pa.array(keys[keep]), pa.array(a[keep]), pa.array(ids[keep], mask=new[keep])], names=["key", "a", "b"])


def starred_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``starred`` of rows (keys, id)."""
    for batch in batches:
        lists = batch.column("keys")
        sizes = np.diff(lists.offsets.to_numpy())
        yield starred(lists.flatten().to_numpy(), np.repeat(batch.column("id").to_numpy(), sizes))


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edges pass; of the centres of a block, which come one after the other, the first becomes the others' centre."""
    last, centre = None, 0
    for batch in batches:
        edge = batch.column("b").is_valid().to_numpy(zero_copy_only=False)
        keys, ids = batch.column("key").to_numpy()[~edge], batch.column("a").to_numpy()[~edge]
        if len(keys):
            ids = ids ^ _salt(keys)
            new = np.concatenate(([last is None or keys[0] != last], keys[1:] != keys[:-1]))
            at = np.concatenate(([-1], np.flatnonzero(new)))[np.cumsum(new)]
            first = np.where(at < 0, centre, ids[at])
            last, centre = keys[-1], first[-1]
            more = ids != first
            yield pa.RecordBatch.from_arrays([pa.array(keys[more]), pa.array(first[more]), pa.array(ids[more])], names=["key", "a", "b"])
        if edge.any():
            yield batch.filter(pa.array(edge))


def meet(keyed: DataFrame) -> DataFrame:
    """The edges (key, a, b) of the stars that tasks made with ``starred``, their centres joined to one of them.

    A block sends one row per task to where it meets; edges are dealt by their item as well, so a block that holds
    much of the table is no large group anywhere.
    """
    parts = max(int(keyed.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * keyed.rdd.getNumPartitions())
    return keyed.repartition(parts, "key", "b").sortWithinPartitions("key", "a").mapInArrow(_met, _STAR)


def settle(stars: DataFrame, verify: Callable[[DataFrame], DataFrame]) -> DataFrame | None:
    """(item, root) of the items that links connect, from the edges (key, a, b) of blocks; None without a link.

    ``verify`` takes pairs (a, b), a < b, and returns those that are links. An item is compared with the centres of all
    its blocks, and it is the centre of some of them itself, so items that share several blocks are connected although
    a block of many different items costs no more than its rows. What may remain apart in a block of several groups is
    the caller's to compare.
    """
    pairs = stars.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct()
    new = stash(verify(pairs).select("a", "b"), "links")
    roots = None if new.isEmpty() else components(new)
    forget(stars.sparkSession, new)
    return roots


def undecided(stars: DataFrame, roots: DataFrame | None, sizes: DataFrame) -> DataFrame:
    """(key, low, high, chunk, id, root, meets) of the items of blocks that hold several groups, so that each two items
    of a block come together.

    ``sizes`` is (id, n). A block's items are dealt into chunks of about ``CHUNK`` items and ``SIZE`` of n; each two
    chunks are a place (key, low, high), and every place has the rows of two chunks only. ``meets`` are the keys of all
    such blocks of an item: two items need to be compared at the smallest key they share. Blocks of two items are left
    out, since their edge has been verified.
    """
    rows = stars.select("key", F.explode(F.array("a", "b")).alias("id")).distinct()
    rows = rows.withColumn("root", F.col("id")) if roots is None else rows.join(roots.withColumnRenamed("item", "id"), "id", "left").withColumn("root", F.coalesce("root", "id"))
    rows = stash(rows.join(sizes.groupBy("id").agg(F.first("n").alias("n")), "id"), "rooted")
    blocks = rows.groupBy("key").agg(F.count(F.lit(1)).alias("items"), F.sum("n").alias("n"), F.min("root").alias("lo"), F.max("root").alias("hi"))
    chunks = F.ceil(F.greatest(F.col("items") / CHUNK, F.col("n") / SIZE)).cast("int")
    mixed = blocks.where("lo < hi and items > 2").select("key", F.greatest(chunks, F.lit(1)).alias("chunks"))
    of = stash(rows.join(mixed, "key").select("key", "id", "root", "chunks"), "undecided")
    forget(stars.sparkSession, rows)
    dealt = of.withColumn("chunk", F.pmod(F.xxhash64("id"), F.col("chunks")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    meets = of.groupBy("id").agg(F.collect_list("key").alias("meets"))
    return dealt.select("key", F.least("chunk", "other").alias("low"), F.greatest("chunk", "other").alias("high"), "chunk", "id", "root").join(meets, "id")
