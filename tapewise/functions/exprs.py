"""Column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_MS = 3_600_000
DAY_MS = 24 * HOUR_MS
WEEK_MS = 7 * DAY_MS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(num: Column, den: Column) -> Column:
    """num / den, null instead of an error or infinity when den is zero."""
    return F.try_divide(num, den)


def finite(c: Column | str) -> Column:
    """True for values that are neither null, NaN nor infinite."""
    c = col(c).cast("double")
    return F.coalesce(~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))), F.lit(False))


def round_even(x: Column, digits: Column) -> Column:
    """Half-even rounding with a per-row number of digits (null digits: unchanged)."""
    scale = F.pow(F.lit(10.0), digits)
    return F.when(digits.isNull(), x).otherwise(F.rint(x * scale) / scale)


def week_floor_ms(ms: Column) -> Column:
    """Monday 00:00 UTC at or before an epoch-ms instant (1970-01-01 was a Thursday)."""
    shift = 3 * DAY_MS
    return F.floor((ms + shift) / WEEK_MS).cast("long") * WEEK_MS - shift


def sunday_ceil_ms(ms: Column) -> Column:
    """Sunday 00:00 UTC of the instant's date when that is a Sunday, else the next one."""
    days = F.floor(ms / DAY_MS).cast("long")
    # day 3 since the epoch was the first Sunday
    return (days + F.pmod(F.lit(3) - days, F.lit(7))).cast("long") * DAY_MS


def day_ms(ms: Column) -> Column:
    """00:00 UTC of the instant's date, as epoch ms."""
    return F.floor(ms / DAY_MS).cast("long") * DAY_MS


def int_div(a: Column, b: Column | int) -> Column:
    """Floor division of integers."""
    return F.floor(a / b).cast("long")


def hash_order(*parts: Column) -> Column:
    """A seeded pseudo-random order: the md5 text of the parts, reproducible in any engine."""
    return F.md5(F.concat_ws("|", *[p.cast("string") for p in parts]))


def hash_uniform(*parts: Column) -> Column:
    """A reproducible uniform number in [0, 1): the first 13 hex digits of the md5."""
    return F.conv(F.substring(hash_order(*parts), 1, 13), 16, 10).cast("double") / float(16 ** 13)
