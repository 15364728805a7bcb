"""Delimited tables, mails and form definitions: rows of evidence per file, errors as rows.

Every reader maps (path, text) to rows with a declared schema; a file that fails gives one row with its reason.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import re
from collections.abc import Callable, Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame

ROWS = "path string, kind string, ordinal int, line_start int, line_end int, name string, value string, detail string"
_NAMES = [c.split(" ")[0] for c in ROWS.split(", ")]
_TYPES = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string()]


def reader(parse: Callable[[str], Iterator[tuple]]) -> Callable[[DataFrame], DataFrame]:
    """Turns a parser of one text into one of DataFrames (path, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for path, text in zip(batch.column("path").to_pylist(), batch.column("text").to_pylist()):
                try:
                    made = [(path, *row) for row in parse(text or "")]
                except (ValueError, csv.Error, ElementTree.ParseError) as e:
                    made = [(path, "error", 0, None, None, str(e).split(":")[0][:80], None, None)]
                out += made
            cols = list(zip(*out)) if out else [[] for _ in _NAMES]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, _TYPES)], names=_NAMES)

    return lambda files: files.select("path", "text").mapInArrow(run, ROWS)


def sniff(text: str) -> str:
    """The delimiter of , ; tab | that cuts the first lines most evenly."""
    try:
        return csv.Sniffer().sniff(text[:8192], delimiters=",;\t|").delimiter
    except csv.Error:
        return ","


def _table(text: str) -> Iterator[tuple]:
    lines = csv.reader(io.StringIO(text, newline=""), delimiter=sniff(text))
    header, at, ordinal = None, 1, 0
    for row in lines:
        end = lines.line_num
        if header is None:
            header = row
            yield "schema", 0, at, end, ",".join(row), None, None
        else:
            ordinal += 1
            for i, value in enumerate(row):
                yield "cell", ordinal, at, end, header[i] if i < len(header) else f"_{i}", value, None
        at = end + 1


class _Text(HTMLParser):
    def __init__(self):
        super().__init__()
        self.parts: list[str] = []
        self.hidden = 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(data)


def html_text(html: str) -> str:
    parser = _Text()
    parser.feed(html)
    return re.sub(r"\s+", " ", " ".join(parser.parts)).strip()


def _mail(text: str) -> Iterator[tuple]:
    message = email.message_from_string(text, policy=email.policy.default)
    for i, name in enumerate(("From", "To", "Cc", "Subject", "Date")):
        if message[name] is not None:
            yield "header", i, None, None, name.lower(), str(message[name]), None
    for i, part in enumerate(p for p in message.walk() if p.get_content_maintype() == "text" and not p.is_attachment()):
        body = part.get_content()
        yield "body", i, None, None, part.get_content_type(), html_text(body) if part.get_content_subtype() == "html" else body, None


def _forms(text: str) -> Iterator[tuple]:
    """Forms, blocks and items by local name; an item maps to the column of its block's table. Reading or writing is
    reported only for an explicit mode."""
    if re.search(r"<!\s*(DOCTYPE|ENTITY)", text, re.I):
        raise ValueError("unsafe_xml: document type or entity")
    local = lambda e: e.tag.rsplit("}", 1)[-1].lower()
    root = ElementTree.fromstring(text)
    n = 0
    for form in ([root] if local(root) == "form" else [e for e in root.iter() if local(e) == "form"]):
        yield "form", n, None, None, form.get("name", ""), None, None
        for block in (e for e in form.iter() if local(e) == "block"):
            owner = f"{form.get('name', '')}.{block.get('name', '')}"
            n += 1
            yield "block", n, None, None, owner, block.get("table"), None
            for item in (e for e in block.iter() if local(e) in ("item", "button")):
                n += 1
                name = f"{owner}.{item.get('name', '')}"
                if local(item) == "button":
                    yield "button", n, None, None, name, item.get("operation"), None
                    continue
                column = f"{block.get('table')}.{item.get('column')}" if block.get("table") and item.get("column") else None
                yield "field", n, None, None, name, column, item.get("mode") if item.get("mode") in ("read", "write") else None


tables, mails, forms = reader(_table), reader(_mail), reader(_forms)
