"""Log files of any size as event rows with line numbers and character offsets.

Files are read by splits, so a large one is the work of many tasks. Lines and characters before a split are sums over
the splits before it, those inside it running sums over its lines; nothing but a split's lines is ever put in order.
Lines end at a line feed (a carriage return before it isn't part of the text, but counts for the offset).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from veinlode.functions.canonical import canonical, parsed
from veinlode.operators.tables import settled

#: Fixed formats: a log line with time, level, component and message, and pairs of key and value in it.
LINE = r"(?U)^(\d{4}-\d\d-\d\d[ T]\d\d:\d\d:\d\d(?:[.,]\d+)?(?:Z|[+-]\d\d:?\d\d)?)\s+(\w+)\s+(\S+)\s+(.*)$"
PAIR = r"(?U)([\w.-]+)=(\S+)"


def numbered(spark: SparkSession, path: str) -> DataFrame:
    """Lines of the files under ``path``: (path, line from 1, start and stop in characters, text)."""
    read = spark.read.option("lineSep", "\n").text(path).select("value", F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("block"))
    rows = settled(read.withColumn("at", F.monotonically_increasing_id()))
    size = (F.length("value") + 1).cast("long")
    splits = rows.groupBy(F.col("path").alias("p"), F.col("block").alias("b")).agg(F.count(F.lit(1)).alias("n"), F.sum(size).alias("chars"))
    before = Window.partitionBy("p").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)  # a row per split of the file
    starts = splits.select("p", "b", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("lines_before"), F.coalesce(F.sum("chars").over(before), F.lit(0)).alias("chars_before"))
    inside = Window.partitionBy("path", "block").orderBy("at")
    own = rows.select("path", "block", "value", F.row_number().over(inside).alias("k"), (F.sum(size).over(inside) - size).alias("c"))
    both = own.join(starts, (F.col("path") == F.col("p")) & (F.col("block") == F.col("b")))
    text, start = F.regexp_replace("value", r"\r+$", ""), F.col("chars_before") + F.col("c")
    return both.select("path", (F.col("lines_before") + F.col("k")).alias("line"), start.alias("start"), (start + F.length(text)).alias("stop"), text.alias("text"))


def pairs(text: Column) -> Column:
    """key=value pairs as a map; of repeated keys the last wins."""
    keys, values = F.regexp_extract_all(text, F.lit(PAIR), F.lit(1)), F.regexp_extract_all(text, F.lit(PAIR), F.lit(2))
    entries = F.arrays_zip(keys.alias("k"), values.alias("v"))
    last = F.filter(entries, lambda e, i: ~F.array_contains(F.slice(keys, i + 2, F.greatest(F.size(keys), F.lit(1))), e["k"]))
    return F.map_from_entries(last)


def events(lines: DataFrame) -> DataFrame:
    """``numbered`` lines to rows of type log_event or log_unparsed; empty lines are passed over.

    A line of the usual form or a JSON object is an event; of an object, missing parts come from the names that other
    loggers use. Identical lines stay apart by their line number."""
    df = lines.where(F.col("text") != "").withColumn("obj", F.when(F.ltrim("text").startswith("{"), parsed(F.col("text"))))
    part = lambda i: F.regexp_extract("text", LINE, i)
    said = lambda *names: F.coalesce(*[F.nullif(F.try_variant_get("obj", f"$.{n}", "string"), F.lit("")) for n in names])
    plain = F.col("text").rlike(LINE)
    json = F.col("obj").isNotNull() & F.schema_of_variant("obj").startswith("OBJECT")
    message = F.when(plain, part(4)).when(json, F.coalesce(said("message", "msg"), F.lit("")))
    parts = {
        "type": F.when(plain | json, "log_event").otherwise("log_unparsed"),
        "timestamp": F.when(plain, part(1)).when(json, said("timestamp", "time")),
        "level": F.when(plain, part(2)).when(json, said("level")),
        "component": F.when(plain, part(3)).when(json, F.coalesce(said("component", "logger"), F.lit("log"))),
        "message": message,
        "event_kind": F.lower(F.split_part(message, F.lit(" "), F.lit(1))),
        "attributes": F.when(plain, canonical(F.to_json(pairs(F.col("text"))))).when(json, F.to_json("obj")),
    }
    return df.select("path", "line", "start", "stop", "text", *[v.alias(k) for k, v in parts.items()])
