"""Facts of SQL files as column expressions: statements, kinds, tables, slots. Nothing is executed or planned.

Only shapes that regular expressions tell safely are reported; statements of other shapes keep kind ``unparsed`` with
their text. Literals and comments are blanked before names are looked for, at equal length.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_HIDDEN = re.compile(
    r"--[^\n]*|/\*[\s\S]*?\*/"
    r"|q'\[[\s\S]*?(?:\]'|\Z)|q'\([\s\S]*?(?:\)'|\Z)|q'\{[\s\S]*?(?:\}'|\Z)|q'<[\s\S]*?(?:>'|\Z)"
    r"|\$(\w*)\$[\s\S]*?(?:\$\1\$|\Z)|'[^']*(?:''[^']*)*(?:'|\Z)",
    re.I,
)
NAME = r'((?:"[^"]+"|\w+)(?:\.(?:"[^"]+"|\w+))*)'
KINDS = ("create table", "create view", "create index", "alter table", "drop", "insert", "update", "delete", "merge", "select", "call", "grant", "revoke")


def mask_text(text: str) -> str:
    """Comments and literals, also those that never end, as blanks; offsets and line ends stay."""
    return _HIDDEN.sub(lambda m: re.sub(r"[^\n]", " ", m[0]), text)


def statements(files: DataFrame) -> DataFrame:
    """(path, text) to (path, ordinal, statement, bare): cut at semicolons outside literals and comments. ``bare`` is
    the statement masked; the work is linear in the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of, number, whole, bare = [], [], [], []
            for i, text in enumerate(batch.column("text").to_pylist()):
                at = 0
                for n, part in enumerate(mask_text(text).split(";") if text else []):
                    if part.strip(" "):
                        of.append(i)
                        number.append(n)
                        whole.append(text[at : at + len(part)].strip(" "))
                        bare.append(part.strip(" "))
                    at += len(part) + 1
            yield pa.RecordBatch.from_arrays([batch.column("path").take(pa.array(of, pa.int32())), pa.array(number, pa.int32()), pa.array(whole, pa.string()), pa.array(bare, pa.string())], names=["path", "ordinal", "statement", "bare"])

    return files.select("path", "text").mapInArrow(run, f"path {files.schema['path'].dataType.simpleString()}, ordinal int, statement string, bare string")


def kind(bare: Column) -> Column:
    out = F.lit("unparsed")
    for k in reversed(KINDS):
        out = F.when(bare.rlike(r"(?is)^\s*" + k.replace("create ", r"create\s+(?:or\s+replace\s+)?(?:unique\s+)?").replace("alter ", r"alter\s+") + r"\b"), k.replace(" ", "_")).otherwise(out)
    return out


def written(bare: Column) -> Column:
    """Table that an insert, update, delete, merge or create writes to, upper case, or null."""
    found = F.regexp_extract(bare, r"(?is)^\s*(?:insert\s+into|update|delete\s+from|merge\s+into|create\s+(?:or\s+replace\s+)?(?:table|view))\s+" + NAME, 1)
    return F.when(found != "", F.upper(found))


def read_tables(bare: Column) -> Column:
    """Tables after from, join or using, sorted; not the one that is deleted from."""
    body = F.regexp_replace(bare, r"(?i)^\s*delete\s+from", "delete")
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(body, F.lit(r"(?i)\b(?:from|join|using)\s+" + NAME), F.lit(1)), F.upper)))


def assignment(statement: Column) -> Column:
    """Column, value and where text of an update of one column; the value is a typed literal or an expression."""
    part = lambda i: F.regexp_extract(statement, r"(?is)^\s*update\s+\S+\s+set\s+(\w+)\s*=\s*((?:'(?:[^']|'')*'|[^',;])+?)(?:\s+where\s+(.*))?$", i)
    value = part(2)
    type_ = F.when(value.rlike(r"(?s)^'(?:[^']|'')*'$"), "string").when(value.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)$"), "number").when(F.lower(value) == "null", "null").when(F.lower(value).isin("true", "false"), "boolean").otherwise("expression")
    plain = F.when(type_ == "string", F.replace(F.substring(value, F.lit(2), F.length(value) - 2), F.lit("''"), F.lit("'"))).otherwise(value)
    return F.when(part(1) != "", F.struct(F.upper(part(1)).alias("column"), type_.alias("type"), plain.alias("value"), F.when(part(3) != "", part(3)).alias("row_selection")))


def table_columns(bare: Column) -> Column:
    """(name, type, not_null) of the columns of a CREATE TABLE without nested expressions."""
    body = F.regexp_extract(bare, r"(?is)^\s*create\s+table\s+\S+\s*\((.*)\)\s*$", 1)
    item = r"(?i)(?:^|,)\s*(?!constraint\b|primary\b|foreign\b|unique\b|check\b)(\w+)\s+(\w+(?:\s*\([\d\s,]+\))?)((?:[^,(]|\([^)]*\))*)"
    all_ = lambda i: F.regexp_extract_all(body, F.lit(item), F.lit(i))
    return F.transform(F.arrays_zip(all_(1).alias("n"), all_(2).alias("t"), all_(3).alias("r")), lambda c: F.struct(F.upper(c["n"]).alias("name"), F.upper(F.regexp_replace(c["t"], r"\s+", "")).alias("type"), c["r"].rlike(r"(?i)\bnot\s+null\b|\bprimary\s+key\b").alias("not_null")))
