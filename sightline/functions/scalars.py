"""Scalar rules of the reports as column expressions: all stay inside generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def half_up(x: Column) -> Column:
    """The nearest integer; halves go up, also below zero."""
    return F.floor(x + 0.5).cast("long")


def bounded_percent(used: Column, limit: Column) -> Column:
    """0 to 100; 0 where there is no limit, null where the use is unknown."""
    return F.when(limit <= 0, F.lit(0).cast("long")).when(used.isNotNull(), F.greatest(F.lit(0), F.least(F.lit(100), half_up(100 * used / F.nullif(limit, F.lit(0))))).cast("long"))


def guarded_ratio(part: Column, total: Column, default: float | None = 0.0) -> Column:
    return F.coalesce(F.try_divide(part.cast("double"), total.cast("double")), F.lit(default).cast("double"))


def date_key(text: Column) -> Column:
    """YYYY-MM-DD as it stands, any other timestamp as its UTC day, junk as null."""
    return F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}$"), text).otherwise(F.date_format(F.try_to_timestamp(text), "yyyy-MM-dd"))


def blank_to_null(text: Column) -> Column:
    return F.nullif(F.trim(text), F.lit(""))


def nice_axis_max(x: Column) -> Column:
    """The next of 1, 2, 5 or 10 times a power of ten; 10 for nothing."""
    scale = F.pow(F.lit(10.0), F.floor(F.log10(x)))
    m = x / scale
    return F.when(x <= 0, F.lit(10.0)).otherwise(F.when(m <= 1, 1).when(m <= 2, 2).when(m <= 5, 5).otherwise(10) * scale)


def latency_text(ms: Column) -> Column:
    return F.when(ms < 1000, F.concat(half_up(ms).cast("string"), F.lit(" ms"))).otherwise(F.format_string("%.2f s", ms / 1000))


def target_tone(current: Column, target: Column, at_most: Column) -> Column:
    good = F.when(at_most, current <= target).otherwise(current >= target)
    return F.when(target.isNull(), "neutral").when(good, "good").otherwise("bad")


def delta_text(delta: Column, ratio: Column) -> Column:
    signed = F.when(F.coalesce(ratio, delta.cast("double")) > 0, F.lit("+")).otherwise(F.lit(""))
    return F.concat(signed, F.coalesce(F.format_string("%.1f%%", 100 * ratio), delta.cast("string")))


def valid_request_id(text: Column) -> Column:
    return F.coalesce(text.rlike("^req_[0-9a-f]{24}$"), F.lit(False))


def valid_query(text: Column) -> Column:
    return F.coalesce((F.trim(text) != "") & (F.length(text) <= 400), F.lit(False))


def capitalised(text: Column) -> Column:
    """The first letter in upper case, the rest as it stands."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.substring(text, 2, 2**31 - 1))


def compact_number(x: Column) -> Column:
    """Millions with M and thousands with K, to one decimal; smaller numbers are rounded."""
    return F.when(x >= 1e6, F.format_string("%.1fM", F.floor(x / 1e5 + 0.5) / 10)).when(x >= 1e3, F.format_string("%.1fK", F.floor(x / 100 + 0.5) / 10)).otherwise(half_up(x).cast("string"))


def relative_time(at: Column, now: Column) -> Column:
    """How long ago, in minutes, hours or days; month and day from a week on."""
    age = F.timestamp_diff("SECOND", at, now)
    steps = [(3600, 60, "m ago"), (86400, 3600, "h ago"), (604800, 86400, "d ago")]
    text = F.when(age < 60, F.lit("Just now"))
    for end, unit, word in steps:
        text = text.when(age < end, F.concat(F.floor(age / unit).cast("string"), F.lit(word)))
    return text.otherwise(F.date_format(at, "MMM d"))
