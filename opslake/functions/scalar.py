"""Scalar helpers for the string, date and number idioms of the source scripts.

All are compositions of Catalyst built-ins.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from opslake.functions.semantics import col_, fixed_text

__all__ = ["dirname", "parsename", "clean_text", "prefix_before", "trunc_hour",
           "duration_text", "wait_text", "thousands", "try_int", "human_bytes",
           "kill_command", "lock_command"]

KB, MB, GB = 1024, 1024 ** 2, 1024 ** 3


def dirname(path) -> Column:
    """Directory part up to and including the last ``/`` or ``\\``; whole text if none."""
    p = col_(path)
    d = F.regexp_extract(p, r"^(.*[\\/])", 1)
    return F.when(d == "", p).otherwise(d)


def parsename(name, part: int) -> Column:
    """``PARSENAME(name, part)``: 1 = object, 2 = schema, 3 = database, 4 = server."""
    parts = F.split(col_(name), r"\.")
    return F.when(F.size(parts) >= part, F.element_at(parts, -part))


def clean_text(text) -> Column:
    """Replace tab, newline and carriage return by spaces (nested ``REPLACE``)."""
    return F.translate(col_(text), "\t\n\r", "   ")


def prefix_before(text, sep: str = ":") -> Column:
    """Text before the first ``sep``; the whole text when there is none."""
    t = col_(text)
    pos = F.instr(t, sep)
    return F.when(pos > 0, F.substring(t, F.lit(1), pos - 1)).otherwise(t)


def trunc_hour(ts) -> Column:
    """``DATEADD(HOUR, DATEDIFF(HOUR, 0, x), 0)``."""
    return F.date_trunc("hour", col_(ts))


def _p(x, n):
    return F.lpad(x.cast("string"), n, "0")


def duration_text(ms) -> Column:
    """Milliseconds as ``dd hh:mm:ss.mss``."""
    m = col_(ms).cast("bigint")
    d = F.call_function("div", m, F.lit(86_400_000))
    h = F.call_function("div", m, F.lit(3_600_000)) % 24
    mi = F.call_function("div", m, F.lit(60_000)) % 60
    s = F.call_function("div", m, F.lit(1000)) % 60
    return F.concat(_p(d, 2), F.lit(" "), _p(h, 2), F.lit(":"), _p(mi, 2), F.lit(":"),
                    _p(s, 2), F.lit("."), _p(m % 1000, 3))


def wait_text(ms) -> Column:
    """Milliseconds as ``dd hh:mm:ss:ms`` (wait totals)."""
    m = col_(ms).cast("bigint")
    d = F.call_function("div", m, F.lit(86_400_000))
    h = F.call_function("div", m, F.lit(3_600_000)) % 24
    mi = F.call_function("div", m, F.lit(60_000)) % 60
    s = F.call_function("div", m, F.lit(1000)) % 60
    return F.concat(_p(d, 2), F.lit(" "), _p(h, 2), F.lit(":"), _p(mi, 2), F.lit(":"),
                    _p(s, 2), F.lit(":"), _p(m % 1000, 3))


def thousands(n) -> Column:
    """Integer with comma thousands separators (``1,234,567``)."""
    return F.format_number(col_(n).cast("bigint"), 0)


def try_int(text) -> Column:
    """``TRY_CAST(x AS bigint)``: NULL for text that is not an integer."""
    return col_(text).try_cast("bigint")


def human_bytes(b, gb_scale: int = 1, sep: str = "") -> Column:
    """Bytes as ``x.yGB`` / ``x.yyMB`` / ``x.yyKB`` (half-up)."""
    x = col_(b).cast("bigint")
    return (F.when(x >= GB, F.concat(fixed_text(x, F.lit(GB), gb_scale), F.lit(sep + "GB")))
            .when(x >= MB, F.concat(fixed_text(x, F.lit(MB), 2), F.lit(sep + "MB")))
            .otherwise(F.concat(fixed_text(x, F.lit(KB), 2), F.lit(sep + "KB"))))


def kill_command(pid) -> Column:
    """``KILL <id>;`` text; nothing is executed."""
    return F.concat(F.lit("KILL "), col_(pid).cast("string"), F.lit(";"))


def lock_command(user, host, lock: bool = True) -> Column:
    """``ALTER USER 'u'@'h' ACCOUNT LOCK;`` text; nothing is executed."""
    word = "LOCK" if lock else "UNLOCK"
    return F.concat(F.lit("ALTER USER '"), col_(user), F.lit("'@'"), col_(host),
                    F.lit(f"' ACCOUNT {word};"))
