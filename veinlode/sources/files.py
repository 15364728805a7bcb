"""Files as sources: scan, ingest of new contents, decoding, dispatch by suffix."""

from __future__ import annotations

import fnmatch

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Parser by suffix; anything else is unsupported_format.
FORMATS = {
    "log": "log", "jsonl": "json_lines", "ndjson": "json_lines", "json": "json", "csv": "table", "tsv": "table", "sql": "sql", "ddl": "sql", "pks": "sql", "pkb": "sql",
    "xml": "forms", "eml": "mail", "mhtml": "mail", "html": "html", "htm": "html", "txt": "text", "md": "text", "rst": "text", "ini": "text", "cfg": "text", "properties": "text",
}
MAX_FILE_BYTES = 67_108_864


def glob_filter(path: Column, patterns: list[str]) -> Column:
    """Whether the path or its last part matches one of the patterns."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    hit = F.lit(False)
    for p in patterns:
        regex = "^" + fnmatch.translate(p).replace("(?s:", "(?s)(?:", 1).removesuffix("\\Z").removesuffix("\\z") + "$"
        hit = hit | path.rlike(regex) | name.rlike(regex)
    return hit


def unsafe(path: Column) -> Column:
    """Absolute, empty parts, dots, colon or NUL."""
    return path.startswith("/") | path.rlike(r"(^|/)(\.{1,2})?(/|$)") | path.rlike("[:\x00]") | (path == "")


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None) -> DataFrame:
    """(path, size, sha256, format, content) of all files below ``root``; content is read by the executors. Files over
    ``MAX_FILE_BYTES`` have their size only: their contents are never loaded."""
    read = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
    small = read.load(root).where(F.col("length") <= MAX_FILE_BYTES)
    large = read.load(root).select("path", "length").where(F.col("length") > MAX_FILE_BYTES)  # no content column: not opened
    raw = small.select("path", "length", "content").unionByName(large, allowMissingColumns=True)
    relative = F.regexp_replace("path", r"^.*?" + f"\\Q{root.rstrip('/')}/\\E", "")
    out = raw.select(relative.alias("path"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256"), "content")
    if exclude:
        out = out.where(~glob_filter(F.col("path"), exclude))
    suffix = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    kinds = F.create_map(*[x for k, v in FORMATS.items() for x in (F.lit(k), F.lit(v))])
    return out.withColumn("format", F.coalesce(F.try_element_at(kinds, suffix), F.lit("unsupported_format")))


def ingest(found: DataFrame, revisions: DataFrame) -> DataFrame:
    """Revisions to append: contents that their path did not have before; oversized files are left to ``rejected``."""
    new = found.where((F.col("size") <= MAX_FILE_BYTES) & ~unsafe(F.col("path"))).select("path", "sha256", "size", "format", "content")
    return new.dropDuplicates(["path", "sha256"]).join(revisions.select("path", "sha256"), ["path", "sha256"], "left_anti")


def rejected(found: DataFrame) -> DataFrame:
    reason = F.when(unsafe(F.col("path")), "unsafe_path").when(F.col("size") > MAX_FILE_BYTES, "file_budget").when(F.col("format") == "unsupported_format", "unsupported_format")
    return found.select("path", reason.alias("reason")).where("reason is not null")


def missing(known: DataFrame, found: DataFrame) -> DataFrame:
    """Known paths that the scan has not seen."""
    return known.select("path").join(found.select("path"), "path", "left_anti")


def decode_bytes(raw: bytes) -> str | None:
    """By byte-order mark, else UTF-8, else a detected single encoding; null rather than lost bytes."""
    for mark, name in ((b"\xef\xbb\xbf", "utf-8-sig"), (b"\xff\xfe", "utf-16"), (b"\xfe\xff", "utf-16")):
        if raw.startswith(mark):
            try:
                return raw.decode(name)
            except UnicodeDecodeError:
                return None
    try:
        return raw.decode("utf-8")
    except UnicodeDecodeError:
        try:
            from charset_normalizer import from_bytes
        except ImportError:
            return None
        best = from_bytes(raw).best()
        return None if best is None else str(best)


def _texts(contents: pd.Series) -> pd.Series:
    return contents.map(lambda c: None if c is None else decode_bytes(c))


def decoded(files: DataFrame) -> DataFrame:
    """``files`` with content as ``text``. What is valid UTF-8 without a mark stays in the JVM; one pass for both."""
    plain = F.is_valid_utf8(F.col("content").cast("string")) & ~F.hex(F.substring("content", 1, 3)).rlike("^(EFBBBF|FFFE|FEFF)")
    decode = F.pandas_udf(_texts, "string")
    return files.withColumn("text", F.when(plain, F.col("content").cast("string")).otherwise(decode(F.when(~plain, F.col("content")))))
