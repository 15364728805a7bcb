"""Removal of long repeated byte strings by column-wise collection suffix order.

A text's 400-byte windows are grouped by the smallest hash among their 32-byte strings (leftmost at ties). Windows
in a row with the same smallest string form a piece of at most 768 bytes, and every window lies in exactly one
piece. Equal windows have equal smallest strings at equal places, so they are in pieces with the same key, and once
pieces are aligned at that string, in the same column. Keys that occur once are dropped by a count; equal pieces are
one piece with a count.

Pieces of a key with different ones are cut further by columns: the windows that start in ``WIDTHS[0]`` neighbouring
columns share the bytes in the middle, so equal ones are in parts with equal middles. Equal parts are one part with a
count. Where many different parts have one middle (near copies of a common passage), they are cut once more by
``WIDTHS[1]`` columns, so a frequent passage is many small groups.

The parts of a Spark partition then form a collection whose suffix order is built column by column from the right.
``Collection`` holds its Burrows-Wheeler transform: each round inserts one symbol per part that has one in the column
into the transform, moves the order on by counting the symbols of the round before, and updates the common prefixes
of neighbours. Transform, order and prefixes are files that a round reads and writes front to back; since only
suffixes of one column can hold equal windows, a round's segment of the transform is closed once the next column is
inserted, and a round costs as much as its column. A window is repeated when its suffix has a common prefix of 400
with a neighbour.

Defined cases: null texts count as empty; texts under 400 bytes lose nothing; a text that occurs twice is wholly
covered; overlapping occurrences count; rows that repeat id and text are documents of their own; an empty table
gives no rows; texts of any length are taken whole; other columns are ignored. Equality of pieces and texts is by
128-bit hash.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator
from contextlib import ExitStack

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import forget, stash, table

LENGTH, GRAM = 400, 32
SPAN = LENGTH - GRAM  # largest distance of a window's start from its smallest string
#: Columns of a part, and different parts with one middle beyond which they are cut by the next width.
WIDTHS, MANY = (96, 8), 20_000
#: Bytes per partition of the construction.
PART_BYTES = 8 << 20
_PLACE = np.uint64((1 << 24) - 1)
_BLOCK = 1 << 23


def _gram_hashes(b: np.ndarray) -> np.ndarray:
    h, factor, size = b.astype(np.uint64) + np.uint64(1), np.uint64(0x9E3779B97F4A7C15), 1
    with np.errstate(over="ignore"):
        while size < GRAM:
            h = h[:-size] * factor + h[size:]
            factor = factor * factor
            size *= 2
    h = (h ^ h >> np.uint64(31)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(29)


def pieces(raw: bytes) -> list[tuple[int, int, int, int]]:
    """(start of the first window, windows, distance of the smallest string, its hash) of all pieces of a text."""
    out = []
    for base in range(0, max(0, len(raw) - LENGTH + 1), _BLOCK):
        b = np.frombuffer(raw[base : base + _BLOCK + LENGTH - 1], np.uint8)
        h = _gram_hashes(b)
        low = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        size = 1
        while size * 2 <= SPAN + 1:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        rest = SPAN + 1 - size
        low = np.minimum(low[: len(low) - rest], low[rest:]) if rest else low
        at = (low & _PLACE).astype(np.int64)
        first = np.concatenate(([0], np.flatnonzero(at[1:] != at[:-1]) + 1))
        count = np.diff(np.append(first, len(at)))
        place = at[first]
        out += zip((first + base).tolist(), count.tolist(), (place - first).tolist(), h[place].view(np.int64).tolist())
    return out


class Collection:
    """Suffixes of the strings ``data`` that start in one column, in order, while columns are added on the left.

    ``groups``: only suffixes of one group are compared; ``left``: each string's first column. ``insert`` does a round.
    The transform file gets, for every suffix of a column in order, the symbol before it.
    """

    def __init__(self, groups: np.ndarray, left: np.ndarray, data: list[bytes], folder: ExitStack):
        self.groups, self.left, self.right = groups, left, left + np.array([len(d) for d in data], np.int64)
        self.columns, self.kept, self.at = int(self.right.max(initial=0)), 0, 0
        self.symbols, self.transform, self.order, self.prefix = (folder.enter_context(tempfile.TemporaryFile()) for _ in range(4))
        self.begins = np.argsort(self.right, kind="stable")[::-1]
        self.ends, self.used = self.right[self.begins], 0
        width = 1 << 12
        self.spans = [(k, min(len(data), k + width)) for k in range(0, len(data), width)]
        for lo, hi in self.spans:  # a block of strings, column by column
            block = np.zeros((hi - lo, self.columns), np.uint8)
            for i in range(lo, hi):
                block[i - lo, left[i] : self.right[i]] = np.frombuffer(data[i], np.uint8)
            self.symbols.write(np.ascontiguousarray(block.T).tobytes())

    def column(self, x: int) -> np.ndarray:
        parts = []
        for lo, hi in self.spans:
            self.symbols.seek(lo * self.columns + x * (hi - lo))
            parts.append(np.frombuffer(self.symbols.read(hi - lo), np.uint8))
        return np.concatenate(parts)

    def insert(self, x: int) -> tuple[np.ndarray, np.ndarray]:
        """From the suffixes at column x + 1 to those at x: strings in the order of their suffixes, and the common
        prefix of each with the one before, up to ``LENGTH``."""
        for f in (self.order, self.prefix):
            f.seek(0)
        self.transform.seek(self.at)
        order = np.frombuffer(self.order.read(4 * self.kept), np.int32)
        prefix = np.frombuffer(self.prefix.read(2 * self.kept), np.int16)
        before = np.frombuffer(self.transform.read(self.kept), np.uint8)
        if self.kept and (gone := self.left[order] > x).any():
            stay = np.flatnonzero(~gone)
            if len(stay):  # a pair that becomes neighbours has the least prefix between
                cut = np.empty(2 * len(stay), np.int64)
                cut[0], cut[2::2], cut[1::2] = 0, stay[:-1] + 1, stay + 1
                prefix = np.minimum.reduceat(np.append(prefix, np.int16(0)), cut)[::2]
            else:
                prefix = prefix[:0]
            order, before = order[stay], before[stay]
        more = self.used
        while more < len(self.ends) and self.ends[more] == x + 1:
            more += 1
        if more > self.used:  # strings whose last symbol is in this column come first in their group
            fresh = self.begins[self.used : more].astype(np.int32)
            self.used = more
            both = np.concatenate((fresh, order))
            sort = np.argsort(self.groups[both], kind="stable")
            order, prefix = both[sort], np.concatenate((np.zeros(len(fresh), np.int16), prefix))[sort]
            before = np.concatenate((self.column(x)[fresh], before))[sort]
        # a suffix goes behind those of its group with smaller first symbols, in the order of what follows
        key = self.groups[order] * 256 + before
        sort = np.argsort(key, kind="stable")
        key = key[sort]
        same = np.flatnonzero(key[1:] == key[:-1]) + 1
        new = np.zeros(len(order), np.int16)
        if len(same):
            cut = np.empty(2 * len(same), np.int64)
            cut[::2], cut[1::2] = sort[same - 1] + 1, sort[same] + 1
            new[same] = np.minimum(np.minimum.reduceat(np.append(prefix, np.int16(0)), cut)[::2] + 1, LENGTH)
        order = order[sort]
        self.at += self.kept
        self.kept = len(order)
        for f, made in ((self.order, order), (self.prefix, new)):
            f.seek(0)
            f.write(made.tobytes())
        self.transform.seek(self.at)
        self.transform.write((self.column(x - 1)[order] if x else np.zeros(len(order), np.uint8)).tobytes())
        return order, new


def repeated_windows(groups: np.ndarray, left: np.ndarray, data: list[bytes]) -> list[np.ndarray]:
    """For each string, which of its windows occur in another string of its group at the same column. No two strings
    of a group are equal."""
    found = [np.zeros(len(d) - LENGTH + 1, bool) for d in data]
    with ExitStack() as folder:
        made = Collection(groups, left, data, folder)
        for x in range(made.columns - 1, -1, -1):
            order, prefix = made.insert(x)
            full = prefix == LENGTH
            if full.any():
                hit = full.copy()
                hit[:-1] |= full[1:]
                for i in order[hit].tolist():
                    found[i][x - left[i]] = True
    return found


def _runs(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2])]


_HIT = "array<struct<lo:int,hi:int>>"
_HIT_PA = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))


def _hits(runs: list[list[tuple[int, int]]]) -> pa.Array:
    return pa.array([[{"lo": a, "hi": b} for a, b in r] for r in runs], _HIT_PA)


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            of, start, count, lead, key, same = [], [], [], [], [], []
            for i, text in enumerate(part.column("text").to_pylist()):
                raw = text.encode()
                for a, c, o, m in pieces(raw):
                    of.append(i)
                    start.append(a)
                    count.append(c)
                    lead.append(o)
                    key.append(m)
                    same.append(xxhash.xxh3_128_digest(m.to_bytes(8, "little", signed=True) + raw[a : a + c + LENGTH - 1], seed=o))
            rows = pa.array(of, pa.int32())
            yield pa.RecordBatch.from_arrays([part.column("tk").take(rows), pa.array(start, pa.int32()), pa.array(count, pa.int32()), pa.array(lead, pa.int32()), pa.array(key, pa.int64()), pa.array(same, pa.binary())], names=["tk", "start", "count", "lead", "key", "same"])


_PART = "key binary, same binary, lead int, data binary"


def _rows(columns: list[tuple[str, list, pa.DataType]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(v, kind) for _, v, kind in columns], names=[n for n, _, _ in columns])


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted pieces of each text."""
    for batch in batches:
        for k in range(0, batch.num_rows, 200):
            part = batch.slice(k, 200)
            want, data = [], []
            for text, pieces_ in zip(part.column("text").to_pylist(), part.column("want").to_pylist()):
                raw = text.encode()
                for w in pieces_:
                    want.append(w)
                    data.append(raw[w["start"] : w["start"] + w["count"] + LENGTH - 1])
            yield _rows([("key", [w["key"].to_bytes(8, "little", signed=True) for w in want], pa.binary()), ("same", [w["same"] for w in want], pa.binary()), ("lead", [w["lead"] for w in want], pa.int32()), ("data", data, pa.binary())])


def _part(lead: int, size: int, number: int, width: int) -> tuple[int, int]:
    """First window and window after the last one of a part of a piece of ``size`` bytes; ``number`` counts ``width``
    columns from the left."""
    left = SPAN - lead
    return max(number * width - left, 0), min((number + 1) * width - left, size - LENGTH + 1)


def _parted(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """For every part of every piece a hash of key, columns and middle, and one of all its bytes."""
    for batch in batches:
        keys, same, numbers, middles, wholes = [], [], [], [], []
        for key, own, lead, raw in zip(*[batch.column(c).to_pylist() for c in ("key", "same", "lead", "data")]):
            left = SPAN - lead
            for n in range(left // width, (left + len(raw) - LENGTH) // width + 1):
                lo, hi = _part(lead, len(raw), n, width)
                keys.append(key)
                same.append(own)
                numbers.append(n)
                # all windows of these columns hold the middle, whether the piece has them or not
                middles.append(xxhash.xxh3_128_digest(key + raw[max((n + 1) * width - 1 - left, 0) : n * width + LENGTH - left], seed=n))
                wholes.append(xxhash.xxh3_128_digest(middles[-1] + raw[lo : hi + LENGTH - 1], seed=left + lo))
        yield _rows([("key", keys, pa.binary()), ("same", same, pa.binary()), ("number", numbers, pa.int32()), ("middle", middles, pa.binary()), ("whole", wholes, pa.binary())])


def _chosen(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Bytes of the wanted parts of each piece, as pieces whose key is the middle."""
    for batch in batches:
        keys, same, leads, data = [], [], [], []
        for lead, raw, want in zip(*[batch.column(c).to_pylist() for c in ("lead", "data", "want")]):
            for w in want:
                lo, hi = _part(lead, len(raw), w["number"], width)
                keys.append(w["middle"])
                same.append(w["whole"])
                leads.append(lead - lo)
                data.append(raw[lo : hi + LENGTH - 1])
        yield _rows([("key", keys, pa.binary()), ("same", same, pa.binary()), ("lead", leads, pa.int32()), ("data", data, pa.binary())])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The construction over all pieces of a partition; a partition holds whole keys of bounded size."""
    whole = pa.Table.from_batches(batches) if (batches := list(batches)) else None
    if whole is None or not whole.num_rows:
        return
    keys = {k: i for i, k in enumerate(dict.fromkeys(whole.column("key").to_pylist()))}
    groups = np.array([keys[k] for k in whole.column("key").to_pylist()], np.int64)
    found = repeated_windows(groups, SPAN - whole.column("lead").to_numpy().astype(np.int64), whole.column("data").to_pylist())
    runs = [_runs(f) for f in found]
    some = [i for i, r in enumerate(runs) if r]
    yield pa.RecordBatch.from_arrays([whole.column("same").take(pa.array(some, pa.int32())).combine_chunks(), _hits([runs[i] for i in some])], names=["same", "hits"])


def _placed(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Hits of a piece's parts as hits of the piece."""
    for batch in batches:
        runs = []
        for lead, count, parts in zip(*[batch.column(c).to_pylist() for c in ("lead", "count", "parts")]):
            flags = np.zeros(count, bool)
            for part in parts:
                lo, hi = _part(lead, count + LENGTH - 1, part["number"], width)
                for h in part["hits"]:
                    flags[lo + h["lo"] : min(lo + h["hi"], hi)] = True
            runs.append(_runs(flags))
        yield pa.RecordBatch.from_arrays([batch.column("same"), _hits(runs)], names=["same", "hits"])


def _order(data: DataFrame) -> DataFrame:
    """(same, hits) of pieces (key, same, lead, data): the construction, by key."""
    size = data.agg(F.sum(F.octet_length("data"))).first()[0] or 0
    parts = max(int(data.sparkSession.conf.get("spark.sql.shuffle.partitions")), size // PART_BYTES + 1)
    return data.repartition(parts, "key").mapInArrow(_ordered, f"same binary, hits {_HIT}")


def _level(data: DataFrame, widths: tuple[int, ...]) -> DataFrame:
    """(same, hits) of the windows that pieces (key, same, lead, data) of one key share, cut by columns first."""
    width, *more = widths
    parts = stash(data.mapInArrow(lambda b: _parted(b, width), "key binary, same binary, number int, middle binary, whole binary"), "parts")
    kinds = parts.groupBy("middle", "whole").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("same", "number")).alias("at"))
    kinds = stash(kinds, "kinds")
    several = stash(kinds.groupBy("middle").agg(F.count(F.lit(1)).alias("d")).where("d > 1"), "several")
    want = kinds.join(several, "middle").select(F.col("at.same").alias("same"), F.struct("middle", "whole", "at.number").alias("w"), (F.col("d") > (MANY if more else 1 << 62)).alias("hot"))
    want = want.groupBy("same").agg(F.collect_list(F.struct("w.*", "hot")).alias("want"))
    pieces_ = data.join(want, "same")
    pick = lambda hot: pieces_.select("lead", "data", F.expr(f"filter(want, w -> w.hot = {hot})").alias("want")).mapInArrow(lambda b: _chosen(b, width), _PART)
    hits = _order(stash(pick("false"), "data"))
    if more and not several.where(F.col("d") > MANY).isEmpty():
        hits = hits.unionByName(_level(stash(pick("true"), "data"), tuple(more)))
    # what is in several pieces as a whole needs no order; a part has no more windows than the width
    hits = hits.unionByName(kinds.where("n > 1").select(F.col("whole").alias("same"), F.array(F.struct(F.lit(0).alias("lo"), F.lit(width).alias("hi"))).alias("hits")))
    hits = stash(hits.withColumnRenamed("same", "whole"), "hits")
    found = parts.join(hits, "whole").groupBy("same").agg(F.collect_list(F.struct("number", "hits")).alias("parts"))
    return data.select("same", "lead", (F.octet_length("data") - F.lit(LENGTH - 1)).alias("count")).join(found, "same").mapInArrow(lambda b: _placed(b, width), f"same binary, hits {_HIT}")


def _text_keys(docs: DataFrame) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    return docs.select("doc_id", F.unhex(F.md5(text.cast("binary"))).alias("tk"), text.alias("text"))


def repeated_spans(rows: DataFrame) -> DataFrame:
    """(tk, spans): for every text key with any, the byte ranges that repeated strings cover, not merged."""
    long = rows.where(F.octet_length("text") >= LENGTH)
    all_pieces = stash(long.select("tk", "text").mapInArrow(_found, "tk binary, start int, count int, lead int, key long, same binary"), "pieces")
    # counts are tables of their own, so that Spark can split a frequent key where they are joined
    again = stash(all_pieces.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key"), "again")
    shared = stash(all_pieces.join(again, "key"), "shared")
    forget(rows.sparkSession, all_pieces)
    kinds = stash(shared.groupBy("key", "same").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("tk", "start", "count", "lead")).alias("at")), "kinds")
    mixed = stash(kinds.groupBy("key").agg(F.count(F.lit(1)).alias("d")).where("d > 1").select("key"), "mixed")
    # what is in several places as a whole needs no order
    whole = kinds.where("n > 1").select("same", F.array(F.struct(F.lit(0).alias("lo"), F.col("at.count").alias("hi"))).alias("hits"))

    places = kinds.join(mixed, "key").groupBy("at.tk").agg(F.collect_list(F.struct("key", "same", "at.start", "at.count", "at.lead")).alias("want"))
    reps = long.groupBy("tk").agg(F.min(F.struct("doc_id")).alias("rep"))
    texts = long.select("tk", F.struct("doc_id").alias("rep"), "text").join(places.join(reps, "tk"), ["tk", "rep"])
    data = texts.select("text", "want").mapInArrow(_cut, _PART)
    data = stash(data.dropDuplicates(["same"]), "data")  # a repeated row gives its pieces twice
    found = stash(whole.unionByName(_level(data, WIDTHS)), "hits")
    spans = shared.join(found, "same").select("tk", "start", F.explode("hits").alias("h"))
    return spans.groupBy("tk").agg(F.collect_set(F.struct((F.col("start") + F.col("h.lo")).alias("lo"), (F.col("start") + F.col("h.hi") + F.lit(LENGTH - 1)).alias("hi"))).alias("spans"))


def merged(spans: list[dict]) -> list[tuple[int, int]]:
    """Sorted maximal ranges."""
    out: list[list[int]] = []
    for lo, hi in sorted((s["lo"], s["hi"]) for s in spans):
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, b) for a, b in out]


def kept(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    out, at = [], 0
    for lo, hi in spans:
        out.append(raw[at:lo])
        at = hi
    return b"".join([*out, raw[at:]])


def remove_repeats(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, spans, kept): merged removed ranges and the remaining bytes of each document."""
    rows = _text_keys(docs)
    spans = repeated_spans(rows)
    both = rows.join(spans, "tk", "left").select("doc_id", "text", "spans")
    kind = docs.schema["doc_id"].dataType.simpleString()

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                texts = [t.encode() for t in part.column("text").to_pylist()]
                cuts = [merged(s or []) for s in part.column("spans").to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t) for t in texts], pa.int64()), pa.array([sum(b - a for a, b in c) for c in cuts], pa.int64()), _hits(cuts), pa.array([kept(t, c) for t, c in zip(texts, cuts)], pa.binary())],
                    names=["doc_id", "n_bytes", "n_removed", "spans", "kept"],
                )

    return both.mapInArrow(strip, f"doc_id {kind}, n_bytes long, n_removed long, spans {_HIT}, kept binary")


def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))
