"""Exact partition of texts into chunks at headings and paragraph ends.

A text is cut into sections first, one per heading outside fenced code and one before the first heading; a section is
then packed into chunks of whole paragraphs. A section's heading path is its parent's path and its own title, the
parent being the nearest heading before it of a smaller level.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

SIZE, MINIMUM = 5000, 1
#: What is a heading, a fence of code, and the end of a paragraph.
_HEADING = re.compile(r"^(#{1,6})[ \t]+(.+?)[ \t]*\r?\n?$")
_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})")
_BLANK = re.compile(r"\n[ \t]*\n+")


def _fenced(lines: list[str]) -> set[int]:
    """Numbers of the lines in fenced code, its marks included; a fence that is never closed goes to the end."""
    inside: set[int] = set()
    begin, mark = 0, ""
    for i, line in enumerate(lines):
        m = _FENCE.match(line)
        if m and not mark:
            begin, mark = i, m[1]
        elif m and m[1].startswith(mark):  # the same sign, at least as often
            inside.update(range(begin, i + 1))
            mark = ""
    if mark:
        inside.update(range(begin, len(lines)))
    return inside


def sections(text: str, headings: bool = True) -> list[tuple[int, int, list[str]]]:
    """(start, end, heading path) of the sections of a text."""
    lines = text.splitlines(keepends=True)
    hidden = _fenced(lines) if headings else set()
    begins = [0, *accumulate(map(len, lines))]
    found = [(begins[i], len(m[1]), m[2].strip()) for i, line in enumerate(lines) if headings and i not in hidden and (m := _HEADING.match(line))]
    paths: list[list[str]] = []
    newest = [-1] * 7  # place of the last heading of each level
    for k, (_, level, title) in enumerate(found):
        parent = max(newest[:level])
        paths.append([*(paths[parent] if parent >= 0 else []), title])
        newest[level] = k
    starts = [h[0] for h in found]
    head = [(0, starts[0] if starts else len(text), [])] if not starts or starts[0] else []
    return head + list(zip(starts, [*starts[1:], len(text)], paths))


def cut(text: str, size: int = SIZE, minimum: int = MINIMUM, strategy: str = "headings") -> list[tuple[int, int, list[str]]]:
    """(start, end, heading path) of chunks of at most ``size`` characters that give the text back when joined. A chunk
    ends with the last paragraph that fits if it gets ``minimum`` characters so, else it is filled up."""
    ends = [m.end() for m in _BLANK.finditer(text)]
    out = []
    for at, stop, path in sections(text, strategy == "headings"):
        while at < stop:
            reach = min(at + size, stop)
            if reach < stop:
                k = bisect_right(ends, reach)
                if k and ends[k - 1] >= at + minimum:
                    reach = ends[k - 1]
            out.append((at, reach, path))
            at = reach
    return out


def chunks(texts: DataFrame, size: int = SIZE, minimum: int = MINIMUM, strategy: str = "headings") -> DataFrame:
    """(id, text) to one row per chunk: id, ordinal, char_start, char_end, heading_path, text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, n, start, end, path, body = [], [], [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                for k, (a, b, p) in enumerate(cut(text or "", size, minimum, strategy)):
                    of.append(i)
                    n.append(k)
                    start.append(a)
                    end.append(b)
                    path.append(p)
                    body.append(text[a:b])
            yield pa.RecordBatch.from_arrays([batch.column("id").take(pa.array(of, pa.int32())), pa.array(n, pa.int32()), pa.array(start, pa.int32()), pa.array(end, pa.int32()), pa.array(path, pa.list_(pa.string())), pa.array(body, pa.string())], names=["id", "ordinal", "char_start", "char_end", "heading_path", "text"])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "text").mapInArrow(run, f"id {kind}, ordinal int, char_start int, char_end int, heading_path array<string>, text string")
