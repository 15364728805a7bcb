"""Line-oriented sources as column expressions: logs, JSON lines, delimited rows, HTML signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veinlode.sources.logs import LINE, pairs  # noqa: F401  (pairs belongs to lines too)


def log_fields(line: Column) -> Column:
    """Time, level, component and message, or null for other lines."""
    part = lambda i: F.regexp_extract(line, LINE, i)
    message = part(4)
    return F.when(line.rlike(LINE), F.struct(part(1).alias("time"), part(2).alias("level"), part(3).alias("component"), message.alias("message"), F.lower(F.regexp_extract(message, r"^(\S+)", 1)).alias("event_kind")))


def json_record(line: Column, *names: str) -> list[Column]:
    return [F.get_json_object(line, f"$.{n}").alias(n) for n in names]


def split_lines(files: DataFrame) -> DataFrame:
    """(path, text) to (path, line, text) with 1-based numbers; identical lines stay apart."""
    return files.select("path", F.posexplode(F.split("text", "\n", -1)).alias("line", "text")).withColumn("line", F.col("line") + 1)


def html_signals(html: Column) -> list[Column]:
    """Title, language attribute and number of meta elements."""
    return [
        F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title"),
        F.regexp_extract(html, r"(?i)<html[^>]*\slang=\"([^\"]*)\"", 1).alias("lang"),
        F.regexp_count(html, F.lit(r"(?i)<meta\s")).cast("long").alias("n_meta"),
    ]
