"""Closed intervals with open (null) bounds, and points of time with their precision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """Null bounds are open; what can't be compared overlaps."""
    return F.coalesce(~(end_a < start_b), F.lit(True)) & F.coalesce(~(end_b < start_a), F.lit(True))


def order_error(start: Column, end: Column) -> Column:
    return F.when(start > end, F.lit("temporal_order"))


_MOMENT = r"^(\d{4}-\d{2}-\d{2})[T ]([01]\d|2[0-3]):([0-5]\d)(?::([0-5]\d)(?:\.(\d+))?)?(Z|[+-](?:[01]\d|2[0-3]):[0-5]\d)?$"
_DAY = 86_400_000_000


def with_point(df: DataFrame, raw: str, into: str = "point", zone: Column | None = None) -> DataFrame:
    """``df`` with ``into``: year, month, day or moment in the text column ``raw`` to start, end and precision, with what
    is known of its zone; null for anything else.

    Days that the calendar lacks give null. A moment keeps its offset and the digits of its fraction, as milliseconds
    or microseconds; beyond microseconds it is refused with ``error`` instead of cut. A moment without an offset takes
    the one that ``zone`` has then; a local time that the zone has twice or never is refused. Text in, text out: the
    session's zone has no part in it. The parts of a text are matched once, in a projection of their own.
    """
    trimmed, parts, local, first, second = (f"_point_{k}" for k in ("raw", "parts", "local", "first", "second"))
    df = df.withColumn(trimmed, F.trim(F.col(raw)))
    # date, hour, minute, second, fraction and offset of a moment; a text that isn't one stays in one piece
    df = df.withColumn(parts, F.split(F.regexp_replace(trimmed, _MOMENT, "$1\x1f$2\x1f$3\x1f$4\x1f$5\x1f$6"), "\x1f", -1))
    text, is_moment, part = F.col(trimmed), F.size(parts) == 6, lambda i: F.get(F.col(parts), F.lit(i))
    date = F.when(is_moment, F.try_to_date(part(0), "yyyy-MM-dd"))
    micros = F.unix_date(date).cast("long") * _DAY + (part(1).cast("long") * 3600 + part(2).cast("long") * 60 + F.coalesce(F.nullif(part(3), F.lit("")).cast("long"), F.lit(0))) * 1_000_000
    asks = is_moment & (part(5) == "") & (F.lit(zone is not None) if zone is None else zone.isNotNull())
    df = df.withColumn(local, F.when(asks, micros))
    if zone is None:
        df = df.withColumns({first: F.lit(None).cast("long"), second: F.lit(None).cast("long")})
    else:  # the instant that the local time is, and the one it is with the offset of a day later; as numbers
        there = lambda utc: F.unix_micros(F.from_utc_timestamp(F.timestamp_micros(utc), zone))
        df = df.withColumn(first, F.unix_micros(F.to_utc_timestamp(F.timestamp_micros(F.col(local)), zone)))
        later = F.col(first) + _DAY
        df = df.withColumn(second, F.col(local) - (there(later) - later))
        exists, twice = there(F.col(first)) == F.col(local), (F.col(second) != F.col(first)) & (there(F.col(second)) == F.col(local))
        df = df.withColumn(second, ~exists | twice)
    day = F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(text, "yyyy-MM-dd"))
    month = F.when(text.rlike(r"^\d{4}-\d{2}$"), F.try_to_date(F.concat(text, F.lit("-01")), "yyyy-MM-dd"))
    year = F.when(text.rlike(r"^\d{4}$"), F.try_to_date(F.concat(text, F.lit("-01-01")), "yyyy-MM-dd"))
    digits, real = F.length(part(4)), date.isNotNull()
    bad_zone = F.coalesce(F.col(second), F.lit(False)) if zone is not None else F.lit(False)
    shift = ((F.col(local) - F.col(first)) / 1_000_000).cast("long")
    its = F.concat(F.when(shift < 0, "-").otherwise("+"), F.lpad(F.floor(F.abs(shift) / 3600).cast("string"), 2, "0"), F.lit(":"), F.lpad((F.floor(F.abs(shift) / 60) % 60).cast("string"), 2, "0"))
    resolved = F.col(local).isNotNull() & ~bad_zone
    offset = F.when(resolved, its).otherwise(part(5))
    offset = F.when(offset.isin("+00:00", "-00:00"), "Z").otherwise(offset)
    fraction = F.when(digits > 0, F.concat(F.lit("."), F.rpad(part(4), F.when(digits <= 3, 3).otherwise(6), "0"))).otherwise("")
    moment = F.when(real & (digits <= 6) & ~bad_zone, F.concat(part(0), F.lit("T"), part(1), F.lit(":"), part(2), F.lit(":"), F.when(part(3) == "", "00").otherwise(part(3)), fraction, offset))
    fine = F.when(digits > 3, "microsecond").when(digits > 0, "millisecond").when(part(3) != "", "second").otherwise("minute")
    precision = F.when(day.isNotNull(), "day").when(month.isNotNull(), "month").when(year.isNotNull(), "year").when(moment.isNotNull(), fine)
    start = F.coalesce(day, month, year).cast("string")
    end = F.coalesce(day, F.last_day(month), F.last_day(F.add_months(year, 11))).cast("string")
    explicit = moment.isNotNull() & (part(5) != "")
    known = moment.isNotNull() & (offset != "")
    error = F.when(real & bad_zone, "ambiguous_local_time").when(real & (digits > 6), "temporal_precision")
    found = F.struct(
        F.coalesce(start, moment).alias("start"),
        F.coalesce(end, moment).alias("end"),
        precision.alias("precision"),
        F.when(explicit, "explicit").when(known, "resolved").otherwise("unknown").alias("timezone_status"),
        F.when(known & ~explicit, F.lit(None).cast("string") if zone is None else zone).when(known, F.when(offset == "Z", "UTC").otherwise(offset)).alias("timezone_value"),
        F.when(precision.isin("year", "month"), "coverage_envelope").otherwise("inclusive").alias("bounds_semantics"),
        F.when(precision.isin("year", "month", "day"), "date").when(precision.isNotNull(), "dateTime").alias("timeformat"),
        error.alias("error"),
    )
    return df.withColumn(into, F.when(precision.isNotNull() | error.isNotNull(), found)).drop(trimmed, parts, local, first, second)


def normalized(value: Column) -> Column:
    """A date as it is, a moment with an offset as microseconds in UTC, any other moment as it is: texts to bucket by."""
    offset = F.regexp_extract(value, _MOMENT, 6)
    shift = F.when(offset == "Z", F.lit(0)).otherwise(F.concat(F.substring(offset, 1, 1), F.lit("1")).cast("int") * (F.substring(offset, 2, 2).cast("int") * 60 + F.substring(offset, 5, 2).cast("int")))
    local = F.to_timestamp_ntz(F.regexp_replace(F.regexp_replace(value, r"(Z|[+-]\d{2}:\d{2})$", ""), " ", "T"))
    utc = local - F.make_dt_interval(mins=shift)
    return F.when(value.rlike(_MOMENT) & (offset != ""), F.date_format(utc, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")).otherwise(value)


def comparable(a: Column, b: Column) -> Column:
    """Whether two bounds may be compared: both dates, or both moments with an offset, or both without; open bounds
    always."""
    kind = lambda v: F.when(~v.contains("T"), "date").when(v.rlike(r"(Z|[+-]\d{2}:\d{2})$"), "zoned").otherwise("local")
    return a.isNull() | b.isNull() | (kind(a) == kind(b))


def text_overlap(start_a: Column, end_a: Column, start_b: Column, end_b: Column) -> Column:
    """``overlap`` of bounds as texts of dates and moments: what can't be compared overlaps, and the check of the first
    pair of bounds comes first."""

    def key(v: Column) -> Column:
        local = F.when(v.contains("T") & ~v.rlike(r"(Z|[+-]\d{2}:\d{2})$"), F.rpad(F.when(v.contains("."), v).otherwise(F.concat(v, F.lit("."))), 26, "0"))
        return F.coalesce(local, normalized(v))

    def ends_first(end: Column, start: Column) -> Column:
        return F.coalesce(key(end) < key(start), F.lit(False))

    return F.when(~comparable(end_a, start_b), True).when(ends_first(end_a, start_b), False).when(~comparable(end_b, start_a), True).otherwise(~ends_first(end_b, start_a))
