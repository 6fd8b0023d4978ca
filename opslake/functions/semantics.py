"""SQL-dialect semantics the source scripts rely on, as Spark Column builders.

All helpers return Columns (JVM-side, code-generated); none uses a Python UDF.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

__all__ = ["col_", "datediff", "safe_div", "safe_div0", "ci_eq", "ci_like", "cents",
           "round_div", "idiv", "fixed_text", "ts_lit"]

_UNITS = {"year": "YEAR", "quarter": "QUARTER", "month": "MONTH", "week": "WEEK",
          "day": "DAY", "hour": "HOUR", "minute": "MINUTE", "second": "SECOND",
          "millisecond": "MILLISECOND"}


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ts_lit(text: str) -> Column:
    """A naive (NTZ) timestamp literal, comparable with the driver tables."""
    return F.lit(text).cast("timestamp_ntz")


def datediff(unit: str, start, end) -> Column:
    """Boundaries crossed between ``start`` and ``end`` (T-SQL ``DATEDIFF``).

    ``timestampdiff`` counts whole elapsed units; truncating both sides to the
    unit first turns it into a boundary count (Jan-31 -> Feb-01 is 1 month).
    """
    u = _UNITS[unit.lower()]
    if u == "WEEK":
        # weeks start on Sunday in the default T-SQL setting
        s = F.date_trunc("day", F.date_sub(col_(start), F.dayofweek(col_(start)) - 1))
        e = F.date_trunc("day", F.date_sub(col_(end), F.dayofweek(col_(end)) - 1))
        return F.timestamp_diff("WEEK", s, e)
    trunc = {"MILLISECOND": "millisecond"}.get(u, u.lower())
    return F.timestamp_diff(u, F.date_trunc(trunc, col_(start)), F.date_trunc(trunc, col_(end)))


def safe_div(num, den) -> Column:
    """``num / NULLIF(den, 0)``: NULL instead of an ANSI divide-by-zero error."""
    return F.try_divide(col_(num), col_(den))


def safe_div0(num, den) -> Column:
    """``COALESCE(num / NULLIF(den, 0), 0)``."""
    return F.coalesce(safe_div(num, den), F.lit(0.0))


def idiv(num, den) -> Column:
    """Integer division truncating toward zero (T-SQL ``int / int``); NULL when ``den`` is 0."""
    d = col_(den)
    return F.when(d != 0, F.call_function("div", col_(num).cast("bigint"), d.cast("bigint")))


def ci_eq(a, b) -> Column:
    """Case-insensitive equality (default collation of the source servers)."""
    return F.lower(col_(a)) == F.lower(col_(b) if not isinstance(b, str) else F.lit(b))


def ci_like(a, pattern: str) -> Column:
    return F.lower(col_(a)).like(pattern.lower())


def cents(x) -> Column:
    """Money/float amount as integer hundredths, so sums are exact and order-free."""
    return F.round(col_(x) * 100).cast("bigint")


def round_div(num, den, scale: int = 0) -> Column:
    """``round(num / den, scale)`` half-up, done in integer arithmetic.

    Returns a double equal to ``k / 10**scale`` for the exact integer ``k``;
    for non-negative ``num`` and positive ``den``.
    """
    m = 10 ** scale
    n = col_(num).cast("bigint") * m
    d = col_(den).cast("bigint")
    k = F.call_function("div", n * 2 + d, d * 2)
    return k.cast("double") / F.lit(float(m))


def fixed_text(num, den, scale: int) -> Column:
    """``num/den`` rounded half-up to ``scale`` places, as text with exactly ``scale`` digits."""
    m = 10 ** scale
    n = col_(num).cast("bigint") * m
    d = col_(den).cast("bigint")
    k = F.call_function("div", n * 2 + d, d * 2)
    ip = F.call_function("div", k, F.lit(m)).cast("string")
    if scale == 0:
        return ip
    fp = F.lpad((k % m).cast("string"), scale, "0")
    return F.concat(ip, F.lit("."), fp)
