"""Predicates of the monitoring scripts: long-running statements, collectors,
string search, attribute include/exclude, threshold sets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opslake.functions.semantics import col_

# Service accounts never reported or killed.
SERVICE_USERS = ("rdsadmin", "rdsrepladmin", "system user", "event_scheduler")
NO_KILL_MARKER = "IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT"


def long_running(df: DataFrame, min_seconds: int = 420, command: str = "Query",
                 state: str | None = "executing", deny_users=SERVICE_USERS,
                 marker: str | None = NO_KILL_MARKER) -> DataFrame:
    """Statements running longer than ``min_seconds`` (strict), NULL-aware marker test."""
    p = (F.lower(F.col("command")) == command.lower()) & (F.col("time") > min_seconds)
    if state is not None:
        p = p & (F.lower(F.col("state")) == state.lower())
    if deny_users:
        p = p & ~F.lower(F.col("user")).isin([u.lower() for u in deny_users])
    if marker:
        p = p & (F.col("info").isNull() | ~F.col("info").contains(marker))
    return df.filter(p)


def collector(df: DataFrame, max_seconds: int = 60, deny_users=("rdsadmin", "root")) -> DataFrame:
    """Statements captured by the 1-second collector: text present, younger than ``max_seconds``."""
    return (df.filter(F.col("info").isNotNull() & (F.col("time") < max_seconds)
                      & ~F.lower(F.col("user")).isin([u.lower() for u in deny_users]))
            .select("user", F.col("info").alias("query"), "time", "host", F.col("db").alias("DB")))


def search_regex(df: DataFrame, column: str, alternatives: list[str]) -> DataFrame:
    """``col REGEXP 'a|b|c'`` (unanchored search)."""
    return df.filter(F.col(column).rlike("|".join(alternatives)))


def search_like(df: DataFrame, column: str, needles: list[str]) -> DataFrame:
    """``col LIKE '%a%' OR col LIKE '%b%' ...``"""
    return df.filter(reduce(lambda a, b: a | b, [F.col(column).contains(n) for n in needles]))


def search_substring(df: DataFrame, column: str, start: int, values: list[str]) -> DataFrame:
    """``SUBSTRING(col, start) IN (...)``"""
    return df.filter(F.expr(f"substring({column}, {start})").isin(values))


def search_replace(df: DataFrame, column: str, remove: str, values: list[str]) -> DataFrame:
    """``REPLACE(col, remove, '') IN (...)``"""
    return df.filter(F.replace(F.col(column), F.lit(remove), F.lit("")).isin(values))


def filter_by(df: DataFrame, column: str, pattern: str, negate: bool = False) -> DataFrame:
    """Include (or exclude with ``negate``) rows whose attribute matches a ``%``/``_`` pattern.

    Matching is case-insensitive like the servers' default collation; NULL
    attributes are excluded by an include filter and kept by an exclude filter.
    """
    m = F.lower(F.col(column)).like(pattern.lower())
    return df.filter(~F.coalesce(m, F.lit(False)) if negate else F.coalesce(m, F.lit(False)))


def optional_predicates(**eq) -> Column:
    """``(col = @p OR @p IS NULL)`` for each keyword: only set parameters become predicates."""
    preds = [F.col(k) == v for k, v in eq.items() if v is not None]
    return reduce(lambda a, b: a & b, preds, F.lit(True))


def any_of(df: DataFrame, thresholds: dict[str, float], gate: Column | None = None) -> DataFrame:
    """Rows over any threshold; all rows when the ``gate`` (a boolean scalar) is true."""
    p = reduce(lambda a, b: a | b, [F.col(c) > v for c, v in thresholds.items()])
    if gate is not None:
        p = p | gate
    return df.filter(p)


def blocking_gate(df: DataFrame, wait_col: str, blocked_col: str, min_wait_ms: int) -> Column:
    """Scalar subquery: some blocked request has waited at least ``min_wait_ms``."""
    return (df.filter(F.col(blocked_col).isNotNull() & (F.col(wait_col) >= min_wait_ms))
            .select((F.count(F.lit(1)) > 0).alias("g")).scalar())


def kill_commands(df: DataFrame, id_col: str = "id") -> DataFrame:
    """``KILL <id>;`` text per selected statement (text only; nothing is executed)."""
    return df.select(F.concat(F.lit("KILL "), col_(id_col).cast("string"), F.lit(";")).alias("kill_command"))
