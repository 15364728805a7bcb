"""Windows of words are hashed from their halves: words are read once each, and what repeats stays the same."""

from __future__ import annotations

import random
from collections import Counter

from pyspark.sql import functions as F

from veinlode.llm import quality


def repeated(words: list[str]) -> int:
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    n = Counter(windows)
    return len({i + k for i, x in enumerate(windows) if n[x] > 1 for k in range(8)})


def test_repeats_are_those_of_whole_windows(spark, monkeypatch):
    rng = random.Random(3)
    texts = [[], ["a"], ["a"] * 7, ["a"] * 8, ["a"] * 9, ["a"] * 16, [*"abcdefgh"] * 2, [*"abcdefg"] * 2, [*"abcdefghx", *"abcdefgh"], [*"abcdefghx", *"hgfedcba"]]
    texts += [[*"abcdx", *"abcdy", *"efghabcd", "z", *"efghabcd"], ["a", "bc", *"defghi", "ab", "c", *"defghi"], ["漢", "é", *"abcdef"] * 3]
    for _ in range(60):
        words = [rng.choice("ab") for _ in range(rng.randrange(60))]
        texts.append(words + [f"{k}" for k in range(rng.randrange(9))] + words[: rng.randrange(30)])
    asked, before = [], F.slice
    monkeypatch.setattr(quality.F, "slice", lambda x, start, length: asked.append(length) or before(x, start, length))
    df = spark.createDataFrame([(i, w) for i, w in enumerate(texts)], "i int, w array<string>")
    got = quality.with_repeats(df, "w", "n").select("i", "n").collect()
    assert {r.i: r.n for r in got} == {i: repeated(w) for i, w in enumerate(texts)}
    assert [x for x in asked if isinstance(x, int)] == [quality.WINDOW]  # words of whole windows are taken for the second hash alone
