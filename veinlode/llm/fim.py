"""Fill-in-the-middle rearrangement of documents.

A text is cut at two unit borders into prefix, middle and suffix, where a unit is a word with the white space before it
(white space at the end of the text is a unit of its own). Over blocks of ``BLOCK`` bytes of the text a Fenwick tree
holds the number of unit ends and of code points; a binary-lifting descent finds the block of a cut, and only that block
is looked at again for the border itself. The parts are then taken and joined by Spark's own string functions, so
Python returns three numbers a text.

Defined cases: a null text counts as empty, an empty one is ``plain``, as is every text that has a sentinel already; a
null id hashes like an empty one; rows that repeat an id get the same draws, and equal rows equal results; two cuts at
the same place (a tie) leave an empty middle. Texts of any length are taken whole: counts are made over slices of
``SLICE`` bytes. Columns of ``docs`` named fim_n, fim_form, fim_prefix_chars, fim_middle_chars or fim_text are replaced,
all others passed on whatever their names. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from veinlode.llm.common import free_names, table

SEED = 42
#: Percent of texts that are rearranged, and of those the percent with the suffix first.
RATE, SPM_RATE = 50, 80
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
BLOCK = 4096
SLICE = 256 * BLOCK
COLUMNS = ("fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_text")


class Fenwick:
    """Prefix sums over blocks, for several counts at a time; the first one is searched."""

    def __init__(self, counts: np.ndarray):
        self.size = len(counts)
        self.tree = np.zeros((self.size + 1, counts.shape[1]), np.int64)
        self.tree[1:] = counts
        step = 1
        while 2 * step <= self.size:
            ends = np.arange(2 * step, self.size + 1, 2 * step)
            self.tree[ends] += self.tree[ends - step]
            step *= 2

    def add(self, block: int, change: np.ndarray) -> None:
        """Change the counts of one block."""
        block += 1
        while block <= self.size:
            self.tree[block] += change
            block += block & -block

    def before(self, block: int) -> np.ndarray:
        """Sums over the blocks before ``block``."""
        out = np.zeros(self.tree.shape[1], np.int64)
        while block:
            out += self.tree[block]
            block &= block - 1
        return out

    def descend(self, k: int) -> tuple[int, np.ndarray]:
        """The block in which the ``k``-th item (from 1) of the first count lies, and the sums before it."""
        at, sums = 0, np.zeros(self.tree.shape[1], np.int64)
        step = 1 << (self.size.bit_length() - 1) if self.size else 0
        while step:
            if at + step <= self.size and sums[0] + self.tree[at + step, 0] < k:
                at += step
                sums = sums + self.tree[at]
            step >>= 1
        return at, sums


def _marks(data: np.ndarray, start: int, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Of bytes start to end: where a word ends, and where a code point starts."""
    part = data[start : end + 1]  # one byte more tells whether a word goes on
    space = (part == 0x20) | ((part >= 0x09) & (part <= 0x0D))
    follows = space[1:] if len(part) > end - start else np.append(space[1:], True)
    here = part[: end - start]
    return ~space[: end - start] & follows, (here & 0xC0) != 0x80


class Blocks:
    """Unit and code-point counts of one text."""

    def __init__(self, text: bytes):
        self.data = np.frombuffer(text, np.uint8)
        counts = []
        for start in range(0, len(self.data), SLICE):
            end = min(start + SLICE, len(self.data))
            starts = np.arange(0, end - start, BLOCK)
            counts.append(np.stack([np.add.reduceat(m, starts, dtype=np.int64) for m in _marks(self.data, start, end)], axis=1))
        counts = np.concatenate(counts) if counts else np.zeros((0, 2), np.int64)
        self.tree = Fenwick(counts)
        self.words, self.chars = (int(x) for x in counts.sum(axis=0))
        last = self.data[-1] if len(self.data) else 0
        self.units = self.words + int(last == 0x20 or 0x09 <= last <= 0x0D)

    def border(self, units: int) -> int:
        """Code points in the first ``units`` units."""
        if units == 0:
            return 0
        if units > self.words:
            return self.chars
        block, before = self.tree.descend(units)
        start = block * BLOCK
        ends, leads = _marks(self.data, start, min(start + BLOCK, len(self.data)))
        at = np.flatnonzero(ends)[units - before[0] - 1]
        return int(before[1] + np.count_nonzero(leads[: at + 1]))


def _cuts(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
    for texts, first, second in batches:
        out = np.zeros((len(texts), 3), np.int64)
        for i, (text, h1, h2) in enumerate(zip(texts, first, second)):
            blocks = Blocks(text)
            out[i] = blocks.units, *sorted((blocks.border(h1 % (blocks.units + 1)), blocks.border(h2 % (blocks.units + 1))))
        yield pd.DataFrame(out, columns=["n", "a", "b"])


def rearrange(docs: DataFrame, seed: int = SEED, rate: int = RATE, spm_rate: int = SPM_RATE) -> DataFrame:
    """``docs`` with fim_n (units), fim_form, fim_prefix_chars, fim_middle_chars and fim_text."""
    docs = docs.drop(*COLUMNS)
    whole, digest, cut, form = free_names(docs, "whole", "digest", "cut", "form")
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256)
    draw = lambda k: F.conv(F.substring(F.col(digest), 8 * k + 1, 8), 16, 10).cast("long")
    out = docs.withColumns({whole: F.coalesce(F.col("text"), F.lit("")), digest: hashed})
    out = out.withColumn(cut, F.pandas_udf(_cuts, "n long, a long, b long")(F.col(whole).cast("binary"), draw(0), draw(1)))
    text, n, a, b = F.col(whole), F.col(cut)["n"], F.col(cut)["a"], F.col(cut)["b"]
    plain = (F.length(text) == 0) | text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE) | (draw(2) % 100 >= rate)
    out = out.withColumn(form, F.when(plain, "plain").when(draw(3) % 100 < spm_rate, "spm").otherwise("psm"))
    part = lambda start, end: text.substr((start + 1).cast("int"), (end - start).cast("int"))
    zero = F.lit(0).cast("long")
    prefix, middle, suffix = part(zero, a), part(a, b), part(b, F.length(text).cast("long"))
    made = (
        F.when(F.col(form) == "plain", text)
        .when(F.col(form) == "psm", F.concat(F.lit(PREFIX), prefix, F.lit(SUFFIX), suffix, F.lit(MIDDLE), middle))
        .otherwise(F.concat(F.lit(SUFFIX), suffix, F.lit(PREFIX), prefix, F.lit(MIDDLE), middle))
    )
    cuts = F.col(form) != "plain"
    return out.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        n.alias("fim_n"), F.col(form).alias("fim_form"), F.when(cuts, a).alias("fim_prefix_chars"), F.when(cuts, b - a).alias("fim_middle_chars"), made.alias("fim_text"),
    )


def restored(output: Column, form: Column) -> Column:
    """The text that was rearranged: parts never hold a sentinel, so the first of each is the border."""

    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        one = F.locate(second, output, len(first) + 1)
        two = F.locate(MIDDLE, output, len(first) + 1)
        between = lambda start, end: output.substr(start, end - start)
        return between(F.lit(len(first) + 1), one), between(one + len(second), two), between(two + len(MIDDLE), F.length(output) + 1)

    prefix, suffix, middle = parts(PREFIX, SUFFIX)
    suffix_first, prefix_second, middle_last = parts(SUFFIX, PREFIX)
    return F.when(form == "psm", F.concat(prefix, middle, suffix)).when(form == "spm", F.concat(prefix_second, middle_last, suffix_first)).otherwise(output)


def op12_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = rearrange(table(spark, sf_dir, "documents").select("doc_id", "text"))
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return out.select(
        "doc_id", F.col("fim_n").alias("n"), F.col("fim_form").alias("form"), F.col("fim_prefix_chars").alias("prefix_chars"), F.col("fim_middle_chars").alias("middle_chars"),
        digest(F.col("fim_text")).alias("output_sha256"), digest(restored(F.col("fim_text"), F.col("fim_form"))).alias("restored_sha256"),
    )


ORACLE = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u,
    sha256('42:' || coalesce(doc_id::VARCHAR, '')) AS h
  FROM documents
), r AS (
  SELECT *, len(u) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM d
), c AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 50 THEN 'plain'
         WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM r
), p AS (
  SELECT *, coalesce(array_to_string(u[1:a], ''), '') AS pre, coalesce(array_to_string(u[a + 1:b], ''), '') AS mid, coalesce(array_to_string(u[b + 1:n], ''), '') AS suf FROM c
)
SELECT doc_id, n, form,
  CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
