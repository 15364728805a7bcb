"""Language identification with error-correcting output codes.

Every language gets a codeword of bits. For each bit a binary naive Bayes classifier over hashed byte n-grams (one
to three bytes of the lower-cased text, digits and punctuation read as blanks) tells whether the text's language has
that bit set; its weights come from n-gram counts summed over all labelled training texts. Decoding adds up, per
language, the logistic losses of its bits, each weighted by how much better than chance the bit's classifier was on
the training texts, and takes the language with the least loss. When the runner-up is within ``margin`` the result
is flagged as ambiguous.

Defined cases: a null text, or one without a letter, gives ``und`` with score 0; so does every text when nothing is
labelled; with one learned language that language is predicted with score 1; a null id hashes like the empty text;
equal texts get equal predictions; equal losses go to the language that comes first in code points; texts of any
length are counted whole; an empty table gives no rows. Only text and lang of training rows are learned
from, other columns are ignored. Only n-gram counts per language (languages x bins) reach the driver.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import remainder, table, undotted

BINS = 1 << 13
#: n-gram counts of a text are scaled as if it had at most so many n-grams, for the losses.
EVIDENCE = 40.0
MARGIN = 0.02
#: Share of the training texts that may lie beyond ``reach``.
FAR = 0.001
_LETTER = re.compile(r"[^\W\d_]")
_MAP = np.arange(256, dtype=np.uint8)
_MAP[:128] = [c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 else 32 for c in range(128)]


def ngram_counts(text: bytes, bins: int = BINS) -> np.ndarray:
    """Counts of hashed 1-, 2- and 3-byte grams of the whole text."""
    b = _MAP[np.frombuffer(text, np.uint8)].astype(np.uint32)
    b = b[np.concatenate(([True], (b[1:] != 32) | (b[:-1] != 32)))] if len(b) else b
    shift = np.uint32(32 - int(bins).bit_length() + 1)
    parts = [b + np.uint32(1 << 24)]
    if len(b) > 1:
        two = b[:-1] << np.uint32(8) | b[1:]
        parts.append(two + np.uint32(2 << 24))
        if len(b) > 2:
            parts.append((two[:-1] << np.uint32(8) | b[2:]) + np.uint32(3 << 24))
    grams = np.concatenate(parts) * np.uint32(2654435761)
    grams ^= grams >> np.uint32(15)
    return np.bincount((grams * np.uint32(2246822519)) >> shift, minlength=bins)


def has_letter(text: str | None) -> bool:
    return text is not None and _LETTER.search(text) is not None


def codewords(n: int) -> np.ndarray:
    """n rows of +1/-1: all different splits for up to 6 languages, else 63 columns of a seeded search for distance."""
    if n <= 1:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cols = [(1, *c) for c in itertools.product((1, -1), repeat=n - 1) if -1 in c]
        return np.array(cols, np.int8).T
    best, most = None, -1
    for seed in range(20):
        rng = np.random.default_rng(seed)
        code = np.stack([rng.permutation(np.resize([1, -1], n)) for _ in range(63)], axis=1).astype(np.int8)
        dist = (63 - code.astype(int) @ code.T.astype(int)) // 2
        low = dist[~np.eye(n, dtype=bool)].min()
        if low > most:
            best, most = code, low
    return best


class Model:
    """Learned languages, codewords, weights of bins per bit, and the weight of each bit."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs, self.code = langs, codewords(len(langs))
        bits = self.code.shape[1]
        self.weights = np.zeros((counts.shape[1] if len(langs) else BINS, bits), np.float32)
        if len(langs) > 1:
            share = (counts + 0.5) / (counts + 0.5).sum(axis=1, keepdims=True)
            for b in range(bits):
                on = self.code[:, b] > 0
                self.weights[:, b] = np.log(share[on].mean(axis=0) / share[~on].mean(axis=0))
        self.trust = np.ones(bits)

    def margins(self, x: np.ndarray) -> np.ndarray:
        """Rows of n-gram counts to log-odds per bit."""
        n = np.maximum(x.sum(axis=1, keepdims=True), 1)
        return (x.astype(np.float32) @ self.weights) / n * np.minimum(n, EVIDENCE)

    def losses(self, margins: np.ndarray) -> np.ndarray:
        """Distances to the codewords."""
        loss = np.stack([(np.logaddexp(0, -margins * row) * self.trust).sum(axis=1) for row in self.code.astype(float)], axis=1)
        return loss / max(self.trust.sum(), 1e-9)

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the nearest codeword, score and whether the runner-up is too near."""
        loss = self.losses(margins)
        best = loss.argmin(axis=1)
        if loss.shape[1] == 1:
            return best, np.ones(len(best)), np.zeros(len(best), bool)
        low = np.sort(loss, axis=1)
        rest = np.exp(np.maximum(low[:, :1] - low, -700) * self.code.shape[1] / 2).sum(axis=1)
        return best, 1 / rest, low[:, 1] - low[:, 0] < MARGIN


def _texts(batch: pa.RecordBatch) -> list:
    return batch.column("text").to_pylist()


def _rows(texts: list, known: list | None = None, size: int = 256) -> Iterator[tuple[list[int], np.ndarray]]:
    """Positions of texts with letters and their count rows, a bounded block at a time."""
    good = [i for i, t in enumerate(texts) if has_letter(t)]
    for k in range(0, len(good), size):
        part = good[k : k + size]
        yield part, np.stack([ngram_counts(texts[i].encode()) for i in part])


def train(labelled: DataFrame) -> Model:
    """Model from columns text and lang; rows with a null in either are not used."""
    labelled = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for part, x in _rows(_texts(batch)):
                of = np.array([langs[i] for i in part], object)
                for lang in set(of):
                    sums[lang] = sums.get(lang, 0) + x[of == lang].sum(axis=0)
        for lang, c in sums.items():
            used = np.flatnonzero(c)
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(used), pa.string()), "bin": pa.array(used, pa.int32()), "n": pa.array(c[used], pa.int64())})

    summed = labelled.mapInArrow(count, "lang string, bin int, n long").groupBy("lang", "bin").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(summed["lang"]))
    counts = np.zeros((len(langs), BINS))
    counts[np.searchsorted(np.array(langs, object), summed["lang"].to_numpy(object)) if len(summed) else [], summed["bin"].to_numpy(int)] = summed["n"].to_numpy(float)
    model = Model(langs, counts)
    if len(langs) < 2:
        return model

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        right, seen = np.zeros(model.code.shape[1], np.int64), 0
        place = {lang: i for i, lang in enumerate(model.langs)}
        for batch in batches:
            at = batch.column("lang").to_pylist()
            for part, x in _rows(_texts(batch)):
                right += ((model.margins(x) > 0) == (model.code[[place[at[i]] for i in part]] > 0)).sum(axis=0)
                seen += len(part)
        yield pa.RecordBatch.from_pydict({"bit": pa.array(range(len(right)), pa.int32()), "good": pa.array(right, pa.int64()), "seen": pa.array([seen] * len(right), pa.int64())})

    found = labelled.mapInArrow(judge, "bit int, good long, seen long").groupBy("bit").agg(F.sum("good").alias("good"), F.sum("seen").alias("seen")).collect()
    for r in found:
        model.trust[r.bit] = max(2 * (r.good + 1) / (r.seen + 2) - 1, 0.01)
    return model


def reach(labelled: DataFrame, model: Model) -> float:
    """The distance to the nearest codeword that no more than ``FAR`` of the training texts exceed, but at least ln 2:
    a text beyond speaks against every codeword, not for none."""

    def far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(0, np.int64)
        for batch in batches:
            for _, x in _rows(_texts(batch)):
                step = np.ceil(model.losses(model.margins(x)).min(axis=1) * 64).astype(np.int64)
                more = np.bincount(step, minlength=len(n))
                more[: len(n)] += n
                n = more
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(n)), pa.int64()), pa.array(n, pa.int64())], names=["step", "n"])

    used = labelled.select("text", "lang").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    found = used.mapInArrow(far, "step long, n long").groupBy("step").agg(F.sum("n").alias("n")).where("n > 0").orderBy(F.desc("step")).collect()
    left, most = FAR * sum(r.n for r in found), 0.0
    for r in found:
        left -= r.n
        if left < 0:
            most = r.step / 64
            break
    return max(most, float(np.log(2))) + 1e-9


def identify(docs: DataFrame, model: Model, within: float | None = None) -> DataFrame:
    """All columns of ``docs`` plus lid_pred, lid_score and lid_ambiguous, predicted from ``text`` alone. Texts whose
    nearest codeword is not ``within`` a distance are ``und``; columns of ``docs`` with these names are replaced."""
    docs = docs.drop("lid_pred", "lid_score", "lid_ambiguous")
    names, docs = docs.columns, undotted(docs)
    schema = docs.select("*", F.lit("").alias("lid_pred"), F.lit(0.0).alias("lid_score"), F.lit(False).alias("lid_ambiguous")).schema

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            pred, score, unsure = np.full(n, "und", object), np.zeros(n), np.zeros(n, bool)
            if model.langs:
                names = np.array(model.langs, object)
                for part, x in _rows(_texts(batch)):
                    margins = model.margins(x)
                    best, score[part], unsure[part] = model.decode(margins)
                    pred[part] = names[best]
                    if within is not None:
                        away = np.array(part)[model.losses(margins).min(axis=1) > within]
                        pred[away], score[away], unsure[away] = "und", 0.0, False
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score), pa.array(unsure)], names=schema.names)

    return docs.mapInArrow(predict, schema).toDF(*names, "lid_pred", "lid_score", "lid_ambiguous")


def op8_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", (remainder(F.col("doc_id"), 4) == 2).alias("held_out"))
    model = train(docs.where(~F.col("held_out")))
    out = identify(docs.select("doc_id", "held_out", "text"), model)
    return out.select("doc_id", "held_out", F.col("lid_pred").alias("lang_pred"), F.col("lid_score").alias("score"), F.col("lid_ambiguous").alias("ambiguous"))
