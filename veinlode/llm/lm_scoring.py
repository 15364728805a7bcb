"""LM scoring: a gated recurrent language model and a unigram base over the corpus.

Tokens are the lower-cased (A-Z) words of a text and one end. All training texts are learned from:

1. Spark counts words (partial sums per task, one shuffle by word). The most frequent words and the end are model
   words; all others fall into buckets by their last three bytes, which are model words too. Rank by count gives ids.
2. Training texts become id streams, dealt to ``turns`` of ``trainers`` by a hash. In each turn every trainer runs
   truncated backpropagation over its part, starting from the common parameters, and the parameters are averaged by
   tokens, a block of parameters per group. Trainers hold about ``TRAINER_TOKENS`` each, so their number grows with
   the corpus; the parameters' size is fixed.
3. All texts are scored whole, state carried from window to window. A bucket's word has the bucket's probability
   times (c + 0.5) / (N_b + 0.5 (V_b + 1)), with the bucket's training tokens N_b and different words V_b, so scores
   are log10 probabilities of the texts themselves, comparable with the base.

Counts of rare words reach texts by a join on the word; only the most frequent, at most ``KEPT``, go to all tasks. Equal texts
send their rare words once each and the sums are by text. One look-up of a text's words gives its ids, the base's
sums and the rare words; training and scoring read those.

Defined cases: a null text counts as empty and has one token, the end; a null id hashes like the empty text and so
is for training; equal texts get equal scores up to single-precision rounding; without training texts every count is 0; an empty table gives no
rows; other columns are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm import gru
from veinlode.llm.common import remainder, stash, table

CLASSES, WIDTH, EMBED, HIDDEN = 32, 32, 16, 24
BUCKETS = 255
KEPT = 200_000
TRAINER_TOKENS = 4_000_000
TURNS = 2
#: Ids of a stream that are dealt together; longer texts are cut.
STREAM = 65_536
#: Words a task counts before it passes counts on, and ids it scores at a time.
COUNTED, SCORED = 300_000, 6_000_000
BLOCK = 4096


def tokens(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


def split(texts: pa.Array) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """The ``tokens`` of many texts: how many each has, the different ones, and the place among these of every token."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts, "")))
    words, n = lists.flatten(), np.diff(lists.offsets.to_numpy())
    full = pc.not_equal(words, "")  # there is an empty one before a text's first blank and behind its last one
    if not pc.all(full).as_py():
        n = np.bincount(np.repeat(np.arange(len(n)), n)[full.to_numpy(zero_copy_only=False)], minlength=len(n))
        words = words.filter(full)
    coded = words.dictionary_encode()
    return n, coded.dictionary.cast(pa.binary()), coded.indices.to_numpy()


def bucket(word: bytes) -> int:
    return zlib.crc32(word[-3:]) % BUCKETS


def _text_key():
    return F.unhex(F.md5(F.coalesce(F.col("text"), F.lit("")).cast("binary")))


def count_words(texts: DataFrame) -> DataFrame:
    """(word, bucket, c) of a column ``text``."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out() -> pa.RecordBatch:
            words = list(seen)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()), pa.array(map(bucket, words), pa.int32()), pa.array(seen.values(), pa.int64())], names=["word", "bucket", "c"])

        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column("text").to_pylist():
                seen.update(tokens(text))
                if len(seen) > COUNTED:
                    yield out()
                    seen.clear()
        yield out()

    return texts.select("text").mapInArrow(count, "word binary, bucket int, c long").groupBy("word", "bucket").agg(F.sum("c").alias("c"))


class Vocabulary:
    """Ids by rank, the base's constants and the counts of the most frequent words. Its size has a fixed bound."""

    def __init__(self, top: list[tuple[bytes, int]], n_texts: int, sums: dict[int, tuple[int, int]]):
        """``top``: most frequent words and counts; ``sums``: tokens and different words of each bucket, model words
        included."""
        own = top[: CLASSES * WIDTH - BUCKETS - 1]
        left = {b: [*sums.get(b, (0, 0))] for b in range(BUCKETS)}
        for word, c in own:
            left[bucket(word)][0] -= c
            left[bucket(word)][1] -= 1
        units = [(n_texts, "end"), *((c, w) for w, c in own), *((n, b) for b, (n, _) in left.items())]
        units += [(0, f"spare{i}") for i in range(CLASSES * WIDTH - len(units))]
        units.sort(key=lambda u: (-u[0], str(u[1])))
        self.share = np.array([u[0] for u in units], float)
        place = {u[1]: i for i, u in enumerate(units)}
        self.end = place["end"]
        self.id = {w: place[w] for w, _ in own}
        self.of_bucket = [place[b] for b in range(BUCKETS)]
        self.bucket_log = [math.log10(n + 0.5 * (v + 1)) for n, v in (left[b] for b in range(BUCKETS))]
        self.n = n_texts + sum(n for n, _ in sums.values())
        self.v = (n_texts > 0) + sum(v for _, v in sums.values())
        self.base_log = math.log10(self.n + 0.5 * (self.v + 1))
        self.end_count = n_texts

        # per kept word: place, model id, log10 of its count for the base, and for the rest of its bucket
        self.kept = {w: i for i, (w, _) in enumerate(top)}
        buckets = [bucket(w) for w, _ in top]
        self.kept_id = np.array([self.id.get(w, self.of_bucket[b]) for (w, _), b in zip(top, buckets)] + [0], np.int16)
        logs = [math.log10(c + 0.5) for _, c in top]
        self.kept_log = np.array([*logs, 0.0])
        self.kept_rest = np.array([0.0 if w in self.id else x - self.bucket_log[b] for (w, _), b, x in zip(top, buckets, logs)] + [0.0])

    def look_up(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each word its model id, whether it is kept, its log10 of a count for the base (0: not kept), and what it
        adds to the model's score of its bucket, the count of a word that is not kept left out."""
        get = self.kept.get
        place = np.fromiter([get(w, -1) for w in words], np.int64, len(words))
        ids, rest = self.kept_id[place], self.kept_rest[place]
        rare = np.flatnonzero(place < 0)
        buckets = [bucket(words[i]) for i in rare.tolist()]
        if buckets:
            ids[rare] = np.array(self.of_bucket)[buckets]
            rest[rare] = -np.array(self.bucket_log)[buckets]
        return ids, place >= 0, self.kept_log[place], rest


def vocabulary(counts: DataFrame, n_texts: int) -> Vocabulary:
    # the kept words are those above a count that at most KEPT words reach; a histogram of a few hundred steps tells it
    step = F.floor(F.log2("c") * 16).cast("int")
    left, low = KEPT, None
    for r in counts.groupBy(step.alias("step")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("step")).collect():
        left -= r.n
        if left < 0:
            break
        low = r.step
    top = counts.where(F.lit(False) if low is None else step >= low).select("word", "c").toPandas().sort_values(["c", "word"], ascending=[False, True])
    sums = counts.groupBy("bucket").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("v")).collect()
    return Vocabulary([(bytes(w), int(c)) for w, c in zip(top["word"], top["c"])], n_texts, {r.bucket: (r.n, r.v) for r in sums})


def encoded(docs: DataFrame, vocab: Vocabulary) -> DataFrame:
    """``docs`` (..., tk, text) without text and with what one look-up gives: ids as 16-bit numbers, n_tokens, known,
    base and rest (sums over the kept words and buckets), rare (the other words, null where a task has seen the text)."""
    spark = docs.sparkSession
    shipped = spark.sparkContext.broadcast(vocab)
    added = "ids binary, n_tokens long, known long, base double, rest double, rare array<struct<word:binary,n:int>>"
    schema = docs.drop("text").schema
    for field in spark.createDataFrame([], added).schema:
        schema = schema.add(field)
    rare_type = pa.list_(pa.struct([("word", pa.binary()), ("n", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc, seen = shipped.value, set()
        end_log = math.log10(voc.end_count + 0.5)
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                part = batch.slice(k, 500)
                rows = part.num_rows
                n, words, at = split(part.column("text"))
                ids, kept, log, rest = voc.look_up(words.to_pylist())
                text = np.repeat(np.arange(rows), n)
                sums = [np.bincount(text, x[at], minlength=rows).astype(float) for x in (kept, log, rest)]  # of no words: integers
                ends = np.cumsum(n + 1)
                stream = np.full(int(ends[-1]), voc.end, np.int16)  # each text's words, and the end behind them
                stream[np.arange(len(at)) + text] = ids[at]
                offsets = 2 * np.concatenate(([0], ends))
                streams = pa.Array.from_buffers(pa.large_binary(), rows, [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(stream)]).cast(pa.binary())

                new = np.zeros(rows, bool)
                for i, key in enumerate(part.column("tk").to_pylist()):
                    new[i] = key not in seen
                    if len(seen) < COUNTED:
                        seen.add(key)
                wanted = np.flatnonzero(~kept[at] & new[text])
                pairs, times = np.unique(text[wanted] * len(words) + at[wanted], return_counts=True)
                which, word = np.divmod(pairs, max(1, len(words)))
                rare = pa.StructArray.from_arrays([words.take(pa.array(word)), pa.array(times, pa.int32())], fields=list(rare_type.value_type))
                cuts = np.searchsorted(which, np.arange(rows + 1)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(cuts), rare, type=rare_type, mask=pa.array(~new))

                base = sums[1] + end_log - (n + 1) * voc.base_log
                known = sums[0].astype(np.int64) + (voc.end_count > 0)
                columns = [streams, pa.array(n + 1, pa.int64()), pa.array(known, pa.int64()), pa.array(base), pa.array(sums[2]), lists]
                yield pa.RecordBatch.from_arrays([*part.drop_columns(["text"]).columns, *columns], names=schema.names)

    return docs.mapInArrow(run, schema)


def train(coded: DataFrame, vocab: Vocabulary, seed: int = 1) -> np.ndarray:
    """Parameters from all rows of ``coded`` (doc_id, ids)."""
    spark = coded.sparkSession
    first = gru.start(vocab.share, WIDTH, EMBED, HIDDEN, seed)
    if not vocab.n:
        return gru.pack(first)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, deal = [], []
            for doc, stream in zip(batch.column("doc_id").to_pylist(), batch.column("ids").to_pylist()):
                for at in range(0, len(stream), 2 * STREAM):  # copies of a text and parts of a long one go to different trainers
                    ids.append(stream[at : at + 2 * STREAM])
                    deal.append(zlib.crc32(f"{doc} {at}".encode(), zlib.crc32(ids[-1], seed)))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array([d % TURNS for d in deal], pa.int32()), pa.array([d // TURNS for d in deal], pa.int64())], names=["ids", "turn", "deal"])

    streams = coded.select("doc_id", "ids").mapInArrow(cut, "ids binary, turn int, deal long")
    trainers = max(1, -(-vocab.n // TURNS // TRAINER_TOKENS) * TURNS)
    flat = gru.pack(first)
    for turn in range(TURNS):
        now = spark.sparkContext.broadcast(flat)
        end = vocab.end

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            net, held, n, total, who = gru.unpack(now.value, CLASSES, WIDTH, EMBED, HIDDEN), [], 0, 0, None
            for batch in batches:
                for d, r in zip(batch.column("deal").to_pylist(), batch.column("ids").to_pylist()):
                    who = d if who is None else who
                    held.append(r)
                    n += len(r) // 2
                    if n >= 2 * TRAINER_TOKENS:  # no more than that is held, whatever the deal
                        net, total = gru.train(net, np.frombuffer(b"".join(held), np.int16), end), total + n
                        held, n = [], 0
            if who is None:
                return
            if held:
                net, total = gru.train(net, np.frombuffer(b"".join(held), np.int16), end), total + n
            made = gru.pack(net)
            parts = [(made[k : k + BLOCK].astype(np.float64) * total).tobytes() for k in range(0, len(made), BLOCK)]
            yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array([total] * len(parts), pa.int64()), pa.array([who] * len(parts), pa.int64()), pa.array(parts, pa.binary())], names=["block", "n", "who", "values"])

        def summed(part: pd.DataFrame) -> pd.DataFrame:
            """Weighted sums of the parameters of some trainers, one after the other."""
            part = part.sort_values(["who", "n"])
            total = np.zeros(len(part["values"].iloc[0]) // 8)
            for v in part["values"]:
                total += np.frombuffer(v, np.float64)
            return pd.DataFrame({"block": part["block"].iloc[:1], "n": [int(part["n"].sum())], "who": part["who"].iloc[:1], "values": [total.tobytes()]})

        dealt = streams.where(F.col("turn") == turn).repartition(trainers, F.xxhash64("deal", F.length("ids"))).sortWithinPartitions("deal", "ids")  # the order of arrival is not fixed
        learned = dealt.select("ids", "deal").mapInArrow(learn, "block int, n long, who long, values binary")
        # sums of about as many trainers as there are sums then, so that no task gathers all
        groups = max(1, math.isqrt(trainers))
        some = learned.groupBy("block", F.pmod("who", F.lit(groups))).applyInPandas(summed, "block int, n long, who long, values binary")
        blocks = some.groupBy("block").applyInPandas(summed, "block int, n long, who long, values binary").collect()
        if blocks:
            flat = np.concatenate([np.frombuffer(b["values"], np.float64) / b["n"] for b in sorted(blocks, key=lambda b: b["block"])]).astype(np.float32)
        now.unpersist()
    return flat


def rare_sums(coded: DataFrame, counts: DataFrame) -> DataFrame:
    """(tk, logs, rare_known): of the tokens of each text outside the kept words, the sum of log10(c + 0.5) and how many
    have c > 0."""
    found = coded.select("tk", F.explode("rare").alias("r")).select("tk", "r.word", "r.n")
    once = found.groupBy("word", "tk").agg(F.max("n").alias("n"))
    both = once.join(counts.select("word", "c"), "word", "left")
    c = F.coalesce("c", F.lit(0))
    return both.groupBy("tk").agg(F.sum(F.col("n") * F.log10(c + 0.5)).alias("logs"), F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("rare_known"))


def score(coded: DataFrame, params: np.ndarray, end: int) -> DataFrame:
    """``coded`` without ids and with model: ln p of its ids as log10, plus rest."""
    shipped = coded.sparkSession.sparkContext.broadcast(params)
    rows = coded.drop("rare")
    schema = rows.drop("ids").select("*", F.lit(0.0).alias("model")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = gru.unpack(shipped.value, CLASSES, WIDTH, EMBED, HIDDEN)

        def done() -> pa.RecordBatch:
            lm = gru.score(net, held, end) / math.log(10)
            rows = pa.Table.from_batches(fixed).combine_chunks().to_batches()[0]
            return pa.RecordBatch.from_arrays([*rows.columns, pa.array(lm + rows.column("rest").to_numpy())], names=schema.names)

        fixed, held, waiting = [], [], 0
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                fixed.append(part.drop_columns(["ids"]))
                held += [np.frombuffer(x, np.int16) for x in part.column("ids").to_pylist()]
                waiting += sum(map(len, held[-part.num_rows :]))
                if waiting > SCORED:
                    yield done()
                    fixed, held, waiting = [], [], 0
        if fixed:
            yield done()

    return rows.mapInArrow(run, schema)


def lm_scores(docs: DataFrame, is_training) -> DataFrame:
    """Scores of every row of ``docs`` (doc_id, text), learned from the rows where ``is_training`` holds."""
    rows = docs.select("doc_id", (~is_training).alias("held_out"), _text_key().alias("tk"), "text")
    texts = rows.where(~F.col("held_out"))
    counts = stash(count_words(texts), "words")
    vocab = vocabulary(counts, texts.count())
    coded = stash(encoded(rows, vocab), "coded")
    params = train(coded.where(~F.col("held_out")), vocab)
    rare = rare_sums(coded, counts)
    scored = score(coded, params, vocab.end).join(rare, "tk", "left")
    logs = F.coalesce("logs", F.lit(0.0))
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("known") + F.coalesce("rare_known", F.lit(0))).cast("long").alias("n_known"),
        F.lit(vocab.n).cast("long").alias("train_tokens"),
        (F.col("base") + logs).alias("base_score"),
        (F.col("model") + logs).alias("score"),
    )


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_scores(docs, remainder(F.col("doc_id"), 5) != 1)
