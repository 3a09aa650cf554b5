"""Dates as publications write them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Year, then as far as given month, day, time, seconds, fraction and offset. A fixed format.
PATTERN = r"^(\d{4})(?:-(\d{2})(?:-(\d{2})(?:T(\d{2}):(\d{2})(?::(\d{2})(?:\.(\d+))?)?(Z|[+-]\d{2}:\d{2})?)?)?)?$"


def publication_date(c: Column) -> Column:
    """UTC time of a date; null if malformed, not in the calendar or over 64 characters.

    What isn't given is the first possible; a time without offset is UTC;
    fractions are cut to milliseconds; offsets go up to 14:00.
    """
    s = F.trim(c)
    part = lambda i: F.regexp_extract(s, PATTERN, i)
    number = lambda i, default: F.coalesce(F.nullif(part(i), F.lit("")).try_cast("int"), F.lit(default))
    offset = part(8)
    shift = F.when(offset.isin("", "Z"), 0).otherwise(F.substring(offset, 2, 2).try_cast("int") * 60 + F.substring(offset, 5, 2).try_cast("int"))
    sign = F.when(F.substring(offset, 1, 1) == "-", 1).otherwise(-1)
    second = number(6, 0) + F.rpad(F.coalesce(F.nullif(part(7), F.lit("")), F.lit("0")), 3, "0").try_cast("int") / 1000
    local = F.try_make_timestamp(number(1, 0), number(2, 1), number(3, 1), number(4, 0), number(5, 0), second.cast("decimal(16,6)"))
    ok = s.rlike(PATTERN) & (F.length(s) <= 64) & (number(4, 0) <= 23) & (number(5, 0) <= 59) & (number(6, 0) <= 59)
    ok &= (shift <= 14 * 60) & (F.coalesce(F.substring(offset, 5, 2).try_cast("int"), F.lit(0)) <= 59)
    return F.when(ok, F.timestamp_millis(F.unix_millis(local) + sign * shift * 60_000))
