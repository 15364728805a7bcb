"""SentencePiece (merge type) encoding with seeded merge-dropout, and decoding.

The model's pieces are read with the sentencepiece library; the segmentation is done here: the characters of a chunk
are merged by an agenda ordered by piece score and position, and each candidate taken from the agenda is skipped
when a keyed hash of seed, variant, chunk, position and piece falls under ``dropout``. Without dropout the result is
the library's own. No piece holds a blank after another character, so a text is cut before every run of blanks (and
around line ends when no longer piece holds one), each chunk is segmented by itself, and repeated chunks are kept.
Every occurrence of a chunk has a variant of its own, of 2^32, drawn by a hash of seed, text and place. It takes the
stored plain segmentation only if none of the merges that lead there is skipped; the same text always gets the same
ids for a seed.

Characters that are no piece become byte pieces, and so does the blank mark U+2581 when it stands in a text, so
decoding gives every text back exactly. Control pieces are never matched by text.

Defined cases: a null text gives null ids; an empty text gives no ids; equal texts get equal ids; an empty table
gives no rows; other columns are passed on.
"""

from __future__ import annotations

import hashlib
import heapq
import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import table, trimmed, undotted

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
DROPOUT = 0.1
SEED = 17
#: The first variants, for comparisons; an occurrence has any of 2^32.
VARIANTS = 2
#: Entries of a worker's store of segmented chunks; chunks of LONG characters or more are not kept.
KEPT = 200_000
#: Chunks of texts that are encoded together.
TOGETHER = 200_000
LONG = 40
_MARK = "▁"
_M64 = (1 << 64) - 1


def load(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, kind) by id; kind 1 normal, 2 unknown, 3 control, 4 user-defined, 6 byte."""
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    spec = proto.normalizer_spec
    if spec.name != "identity" or not spec.add_dummy_prefix or spec.remove_extra_whitespaces or proto.trainer_spec.model_type != 2:
        raise ValueError("a merge-type model is needed that keeps texts as they are and puts a blank before them")
    return [(p.piece, p.score, p.type) for p in proto.pieces]


_M32, _VARIANT = 0xFFFFFFFF, 0x85EBCA77


def table_of(vocab: list[tuple[str, float, int]]) -> list[bytes]:
    """Bytes of every id: all that decoding needs."""
    return [b"" if kind in (2, 3) else bytes([int(p[3:5], 16)]) if kind == 6 else p.replace(_MARK, " ").encode() for p, _, kind in vocab]


def decoded(table: list[bytes], ids) -> str:
    raw = b"".join(map(table.__getitem__, ids))
    return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", "replace")


class Codec:
    def __init__(self, vocab: list[tuple[str, float, int]], dropout: float = DROPOUT, seed: int = SEED):
        self.byte = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(vocab) if kind == 6}
        if len(self.byte) != 256:
            raise ValueError("a model with pieces for all bytes is needed")
        order = sorted((-s, i) for i, (_, s, kind) in enumerate(vocab) if kind in (1, 4))
        self.of = [i for _, i in order]  # id by rank
        self.rank = {vocab[i][0]: r for r, i in enumerate(self.of)}
        self.salt = np.random.default_rng(seed).integers(0, 2**32, len(order)).tolist()
        self.table = table_of(vocab)
        self.limit, self.seed = int(dropout * 2**32), seed
        inner = any(len(p) > 1 and "\n" in p for p in self.rank) or any(_MARK in p.lstrip(_MARK) for p in self.rank)
        if any(_MARK in p.lstrip(_MARK) for p in self.rank):
            raise ValueError("a piece holds a blank after another character; chunks can't be told apart")
        self.chunks = re.compile(r" +[^ ▁]*|▁|[^ ▁]+" if inner else r" +[^ \n▁]*|[\n▁]|[^ \n▁]+")
        n = len(self.of)
        pairs = {}
        for piece, r in self.rank.items():
            for cut in range(1, len(piece)):
                a, b = self.rank.get(piece[:cut]), self.rank.get(piece[cut:])
                if a is not None and b is not None:
                    pairs[a * (n + 1) + b] = r
        self.none = n  # a character that is no piece
        self.pair_keys = np.array(sorted(pairs), np.int64)
        self.pair_ranks = np.array([pairs[k] for k in sorted(pairs)], np.int64)
        self.chars = np.full(0x110000, n, np.int32)
        for piece, r in self.rank.items():
            if len(piece) == 1:
                self.chars[ord(piece)] = r
        self.chars[32] = self.chars[ord(_MARK)]
        self.ids = np.array([*self.of, -1], np.int64)
        self.salts = np.array([*self.salt, 0], np.uint64)
        self._forget()

    def _forget(self) -> None:
        """An empty store. A known chunk has a row; of every row there are the hash of the chunk, its length, its plain
        ids, and the pieces and places of the merges that lead there, each one after the other in one array."""
        mark = np.array([self.byte[b] for b in _MARK.encode()], np.int32)
        self.row: dict[str, int] = {_MARK: 0}
        self.hashes, self.lengths = np.array([self._key(_MARK, 0)], np.uint64), np.ones(1, np.int64)
        self.flat, self.sizes = mark, np.array([len(mark)])
        self.merged, self.places, self.merges = np.empty(0, np.int32), np.empty(0, np.int32), np.zeros(1, np.int64)

    def _key(self, chunk: str, variant: int) -> int:
        return zlib.crc32(chunk.encode(), self.seed * 0x9E3779B1 & _M32) + variant * _VARIANT & _M32

    def _skipped(self, piece: np.ndarray, key: np.ndarray, i: np.ndarray) -> np.ndarray:
        h = ((self.salts[piece] ^ key) + i.astype(np.uint64) * np.uint64(0x9E3779B1)) * np.uint64(0x85EBCA6B) & np.uint64(0xFFFFFFFF)
        return h < np.uint64(self.limit)

    def segment(self, chunk: str, variant: int = 0, plain: bool = False) -> tuple[int, ...]:
        """Ids of one chunk by agenda merging. Agenda entries are integers: rank, place (40 bits), length (16, as
        no piece is longer) from the top."""
        return self._segment(chunk, self._key(chunk, variant), 0 if plain else self.limit)

    def _segment(self, chunk: str, key: int, limit: int) -> tuple[int, ...]:
        if chunk == _MARK:
            return tuple(self.byte[b] for b in chunk.encode())
        part = list(chunk.replace(" ", _MARK))
        n, get, salt = len(part), self.rank.get, self.salt
        agenda = []
        left = part[0]
        for i in range(n - 1):
            right = part[i + 1]
            found = get(left + right)
            if found is not None:
                agenda.append(found << 56 | i << 16 | 2)
            left = right
        if agenda:
            heapq.heapify(agenda)
            nxt, prv, size = list(range(1, n + 1)), list(range(-1, n - 1)), [1] * n
            pop, push = heapq.heappop, heapq.heappush
            while agenda:
                top = pop(agenda)
                i, length = top >> 16 & 0xFFFFFFFFFF, top & 0xFFFF
                j = nxt[i] if size[i] else n
                if j >= n or size[i] + size[j] != length:
                    continue  # one side was merged meanwhile
                if limit and ((salt[top >> 56] ^ key) + i * 0x9E3779B1) * 0x85EBCA6B & 0xFFFFFFFF < limit:
                    continue  # dropped: this candidate is gone, others over the same characters may come
                part[i] = merged = part[i] + part[j]
                size[i], size[j] = length, 0
                nxt[i] = k = nxt[j]
                if k < n:
                    prv[k] = i
                    found = get(merged + part[k])
                    if found is not None:
                        push(agenda, found << 56 | i << 16 | length + size[k])
                k = prv[i]
                if k >= 0:
                    found = get(part[k] + merged)
                    if found is not None:
                        push(agenda, found << 56 | k << 16 | size[k] + length)
            part = [p for p, keep in zip(part, size) if keep]
        ids, of = [], self.of
        for p in part:
            found = get(p)
            if found is not None:
                ids.append(of[found])
            else:
                ids.extend(self.byte[b] for b in p.encode())
        return tuple(ids)

    def _rank_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of the piece that two neighbours make, or none + 1."""
        key = a * (self.none + 1) + b
        at = np.minimum(np.searchsorted(self.pair_keys, key), len(self.pair_keys) - 1)
        return np.where(self.pair_keys[at] == key, self.pair_ranks[at], self.none + 1)

    def segment_many(self, chunks: list[str], variants: list[int]) -> list[tuple[int, ...]]:
        """``segment`` of many chunks side by side."""
        flat, sizes = self._side_by_side(chunks, np.array([self._key(c, v) for c, v in zip(chunks, variants)], np.uint64))
        return [tuple(x.tolist()) for x in np.split(flat, np.cumsum(sizes)[:-1])]

    def _side_by_side(self, chunks: list[str], key: np.ndarray, merges: list | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of many chunks, one after the other, and how many each has: in each step every chunk takes the first of
        its agenda.

        A chunk's agenda is a row of ranks, one per place, of the piece that starts there; taking the leftmost of
        the smallest is what the agenda of ``segment`` does. With ``merges`` nothing is skipped, and (rows, pieces,
        places) of every step are added there.
        """
        limit = 0 if merges is not None else self.limit
        size = np.array([len(c) for c in chunks])
        wide, rows = int(size.max()), len(chunks)
        row = np.repeat(np.arange(rows), size)
        col = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
        part = np.full((rows, wide + 1), self.none, np.int64)
        part[row, col] = self.chars[np.frombuffer("".join(chunks).encode("utf-32-le"), np.uint32)]
        alive = np.zeros((rows, wide + 1), bool)
        alive[row, col] = True
        agenda = np.full((rows, wide + 1), self.none + 1, np.int64)
        inner = np.flatnonzero(row[1:] == row[:-1])
        agenda[row[inner], col[inner]] = self._rank_of(part[row[inner], col[inner]], part[row[inner + 1], col[inner + 1]])
        nxt = np.tile(np.arange(1, wide + 2), (rows, 1))
        prv = np.tile(np.arange(-1, wide), (rows, 1))
        nxt[np.arange(rows), size - 1] = wide  # the last column is no character
        live = np.arange(rows)
        while len(live):
            rows_ranks = agenda[live]
            i = rows_ranks.argmin(axis=1)
            piece = rows_ranks[np.arange(len(live)), i]
            some = piece <= self.none
            live, i, piece = live[some], i[some], piece[some]
            agenda[live, i] = self.none + 1
            r = live
            if merges is not None:
                merges.append((r, piece, i))
            if limit:
                take = ~self._skipped(piece, key[r], i)
                r, i, piece = r[take], i[take], piece[take]
            j = nxt[r, i]
            part[r, i] = piece
            alive[r, j] = False
            agenda[r, j] = self.none + 1
            k = nxt[r, j]
            nxt[r, i] = k
            prv[r, k] = i
            agenda[r, i] = self._rank_of(piece, part[r, k])  # the last column is none
            before = prv[r, i]
            has = before >= 0
            agenda[r[has], before[has]] = self._rank_of(part[r[has], before[has]], piece[has])
        flat, sizes = self.ids[part[alive]].astype(np.int32), alive.sum(axis=1)
        odd = np.flatnonzero((alive & (part == self.none)).any(axis=1)).tolist()
        if odd:  # characters that are no piece
            parts = np.split(flat, np.cumsum(sizes)[:-1])
            for r in odd:
                parts[r] = np.array(self._segment(chunks[r], int(key[r]), limit), np.int32)
                sizes[r] = len(parts[r])
            flat = np.concatenate(parts)
        return flat, sizes

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0].tolist()

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts, about ``TOGETHER`` chunks at a time."""
        out, cut, n = [], [], 0
        for t in texts:
            cut.append((t, self.chunks.findall(" " + t) if t else []))
            n += len(cut[-1][1])
            if n >= TOGETHER:
                out += self._encode(cut)
                cut, n = [], 0
        return out + self._encode(cut)

    def _learn(self, chunks: list[str]) -> None:
        """Store the plain segmentations of chunks, made side by side."""
        chunks = [chunks[k] for k in np.argsort([len(c) for c in chunks], kind="stable").tolist()]
        flat, sizes, merged, places, counts = [self.flat], [self.sizes], [self.merged], [self.places], [self.merges]
        for k in range(0, len(chunks), 4096):
            block, merges = chunks[k : k + 4096], []
            ids, n = self._side_by_side(block, np.zeros(len(block), np.uint64), merges)
            row, piece, at = (np.concatenate(x) for x in zip(*merges)) if merges else (np.empty(0, np.int64),) * 3
            order = np.argsort(row, kind="stable")
            for held, more in ((flat, ids), (sizes, n), (merged, piece[order].astype(np.int32)), (places, at[order].astype(np.int32)), (counts, np.bincount(row, minlength=len(block)))):
                held.append(more)
        self.row.update(zip(chunks, range(len(self.row), len(self.row) + len(chunks))))
        self.flat, self.sizes, self.merged, self.places, self.merges = map(np.concatenate, (flat, sizes, merged, places, counts))
        self.hashes = np.concatenate((self.hashes, np.array([self._key(c, 0) for c in chunks], np.uint64)))
        self.lengths = np.concatenate((self.lengths, np.array([len(c) for c in chunks], np.int64)))

    def _encode(self, cut: list[tuple[str, list[str]]]) -> list[np.ndarray]:
        texts = [c for _, chunks in cut for c in chunks]
        if not texts:
            return [np.empty(0, np.int32) for _ in cut]
        if len(self.row) > KEPT:
            self._forget()
        row = np.array([self.row.get(c, -1) for c in texts])
        lacking = np.flatnonzero(row < 0).tolist()
        counts = Counter([texts[k] for k in lacking])
        if new := [c for c, n in counts.items() if n > 1 and len(c) < LONG]:
            self._learn(new)
            row[lacking] = [self.row.get(texts[k], -1) for k in lacking]
        rest = np.flatnonzero(row < 0).tolist()  # what is there once isn't worth a place in the store
        long, once = [k for k in rest if len(texts[k]) >= LONG], [k for k in rest if len(texts[k]) < LONG]
        row[rest] = 0
        variants = np.concatenate([self._pick(t, len(chunks)) for t, chunks in cut])
        start, size = (np.cumsum(self.sizes) - self.sizes)[row], self.sizes[row]
        pool, end = [self.flat], len(self.flat)
        hashes, lengths = self.hashes[row], self.lengths[row]
        hashes[once], lengths[once] = [self._key(texts[k], 0) for k in once], [len(texts[k]) for k in once]
        key, again = hashes + variants * np.uint64(_VARIANT) & np.uint64(_M32), np.array(once, np.int64)
        if self.limit:
            own = self.merges[row]
            at = np.repeat((np.cumsum(self.merges) - self.merges)[row] - (np.cumsum(own) - own), own) + np.arange(own.sum())
            of = np.repeat(np.arange(len(row)), own)
            again = np.concatenate((again, np.unique(of[self._skipped(self.merged[at], key[of], self.places[at])])))
        again = again[np.argsort(lengths[again], kind="stable")]
        for k in range(0, len(again), 4096):
            block = again[k : k + 4096]
            ids, n = self._side_by_side([texts[j] for j in block.tolist()], key[block])
            start[block], size[block] = end + np.cumsum(n) - n, n
            pool.append(ids)
            end += len(ids)
        for k in long:
            pool.append(np.array(self.segment(texts[k], int(variants[k])), np.int32))
            start[k], size[k] = end, len(pool[-1])
            end += len(pool[-1])
        ends = np.cumsum(size)
        ids = np.concatenate(pool)[np.repeat(start - (ends - size), size) + np.arange(ends[-1])]
        bounds = np.concatenate(([0], ends))[np.cumsum([len(chunks) for _, chunks in cut])]
        return np.split(ids, bounds[:-1])

    def _pick(self, text: str, n: int) -> np.ndarray:
        """Variants of a text's chunks, by hash of seed, text and place."""
        x = np.arange(n, dtype=np.uint64) + np.uint64(zlib.crc32(text.encode(), self.seed & 0xFFFFFFFF) << 20)
        x *= np.uint64(0x9E3779B97F4A7C15)
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        return x >> np.uint64(32)

    def decode(self, ids) -> str:
        return decoded(self.table, ids)


_codecs: dict[tuple, Codec] = {}


def codec(vocab: list, digest: bytes, *parameters) -> Codec:
    """One codec for a worker, a vocabulary (told by its digest) and parameters, so that its tables outlive a task."""
    key = (digest, *parameters)
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(vocab, *parameters)
    return _codecs[key]


def _shipped(spark: SparkSession, path: str):
    """The vocabulary and its digest, broadcast: as large as the model file, whatever the corpus."""
    vocab = load(path)
    return spark.sparkContext.broadcast((vocab, hashlib.sha256(repr(vocab).encode()).digest()))


def _put(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, values], names=[*batch.schema.names, name])


def encode(docs: DataFrame, path: str = MODEL, dropout: float = DROPOUT, seed: int = SEED, column: str = "text", into: str = "piece_ids") -> DataFrame:
    """All columns of ``docs`` plus the ids of ``column``, in place of a column ``into`` that is there."""
    docs = docs.drop(into)
    names, docs = docs.columns, undotted(docs)
    vocab = _shipped(docs.sparkSession, path)
    schema = docs.select("*", F.lit(None).cast("array<int>").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(*vocab.value, dropout, seed)
        for batch in batches:
            for k in range(0, batch.num_rows, 250):
                part = batch.slice(k, 250)
                texts = part.column(column).to_pylist()
                ids = [None if t is None else i for t, i in zip(texts, own.encode_all([t or "" for t in texts]))]
                yield _put(part, into, pa.array(ids, pa.list_(pa.int32())))
        own._forget()  # the next task may be another step's

    return docs.mapInArrow(trimmed(run), schema).toDF(*names, into)


def decode(encoded: DataFrame, path: str = MODEL, column: str = "piece_ids", into: str = "decoded") -> DataFrame:
    """All columns of ``encoded`` plus the text of the ids in ``column``, in place of a column ``into`` that is there."""
    encoded = encoded.drop(into)
    names, encoded = encoded.columns, undotted(encoded)
    vocab = _shipped(encoded.sparkSession, path)
    schema = encoded.select("*", F.lit(None).cast("string").alias(into)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = table_of(vocab.value[0])
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                ids = part.column(column)
                values, ends, valid = ids.values.to_numpy(zero_copy_only=False), ids.offsets.to_numpy(), ids.is_valid().to_pylist()
                texts = [decoded(table, values[ends[i] : ends[i + 1]].tolist()) if valid[i] else None for i in range(len(ids))]
                yield _put(part, into, pa.array(texts, pa.string()))

    return encoded.mapInArrow(trimmed(run), schema).toDF(*names, into)


def op5_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    slim = ids.select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("text_sha256"), "piece_ids")
    back = decode(slim)
    return back.select(
        "doc_id",
        F.greatest(F.coalesce(F.size("piece_ids"), F.lit(0)), F.lit(0)).cast("long").alias("n_ids"),
        F.xxhash64("piece_ids").alias("ids_hash"),
        "text_sha256",
        (F.sha2(F.coalesce("decoded", F.lit("")), 256) == F.col("text_sha256")).alias("lossless"),
    )
