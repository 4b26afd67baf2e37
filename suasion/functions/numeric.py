"""Scalar numeric expressions (MTH01-08) and the float-compare convention."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def r6(x) -> Column:
    """Round to 6 places and add 0.0 (folds -0.0) — the compare convention."""
    return F.round(_c(x).cast("double"), 6) + F.lit(0.0)


def floor_fraction(n, tenths: int) -> Column:
    """MTH01: ``int(tenths/10 * n)`` as exact integer arithmetic."""
    return F.floor((_c(n) * F.lit(tenths)) / F.lit(10)).cast("bigint")


def abs_diff(a, b) -> Column:
    """MTH02."""
    return F.abs(_c(a) - _c(b))


def round_half_even(x, places: int = 8) -> Column:
    """MTH03: numpy ``round`` is half-to-even."""
    return F.bround(_c(x), places)


def zero_fill(x) -> Column:
    """MTH04: null and NaN become 0."""
    c = _c(x).cast("double")
    return F.coalesce(F.nanvl(c, F.lit(0.0)), F.lit(0.0))


def epoch_seconds_utc(ts) -> Column:
    """Epoch seconds of a timestamp_ntz read as UTC, independent of the session zone."""
    return F.expr("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {})".format(
        ts if isinstance(ts, str) else ts._jc.toString()))


def utc_cutoff(year: int, month: int, day: int) -> int:
    """MTH07: epoch seconds of midnight UTC (the reference used the machine zone)."""
    import calendar
    return calendar.timegm((year, month, day, 0, 0, 0))


def float_text_double(x) -> Column:
    """MTH08: float32 -> shortest text -> double, as a CSV round trip does."""
    return _c(x).cast("float").cast("string").cast("double")
