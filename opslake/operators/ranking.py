"""Rankings and top-N: by configurable sort keys, greedy multi-metric, points, best row per key.

Global top-N uses ``orderBy().limit(n)`` (each partition keeps n rows, one
small merge) and ranks only those n rows; rankings by several metrics explode
them once and keep n rows a metric and task before the shuffle, so any number
of metrics costs one scan; per-key "best row" uses ``max_by``
(a partial aggregate, so a hot key is combined map-side) instead of a
``row_number`` window over the whole group.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.semantics import datediff, safe_div


def _minutes_alive():
    return F.greatest(datediff("minute", F.col("creation_time"), F.col("last_execution_time")), F.lit(1))


def _per_minute_cached(as_of: str | None) -> Column:
    """Executions per minute in the cache: up to ``as_of``, else up to the last execution; 0 for a single execution."""
    ages = [datediff("minute", F.col("creation_time"), F.col("last_execution_time"))]
    if as_of is not None:
        ages.insert(0, datediff("minute", F.col("creation_time"), F.lit(as_of).cast("timestamp_ntz")))
    age = F.coalesce(*[F.when((a > 0) & (F.col("execution_count") > 1), a) for a in ages])
    return F.coalesce(F.col("execution_count") / age, F.lit(0.0))


def sort_keys(as_of: str | None = None) -> dict[str, Column]:
    """The 21 sort keys of the plan-cache ranking (name -> Column over query statistics)."""
    n = F.col("execution_count")
    cached = F.timestamp_diff("SECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("creation_time"))
    keys = {name: F.col(c) for name, c in (
        ("cpu", "total_worker_time"), ("reads", "total_logical_reads"), ("writes", "total_logical_writes"),
        ("duration", "total_elapsed_time"), ("spills", "total_spills"), ("rows", "total_rows"), ("memory grant", "max_grant_kb"))}
    keys |= {f"avg {name}": safe_div(c, n) for name, c in keys.items()}
    return keys | {
        "executions": n,
        "avg executions": _per_minute_cached(as_of),
        "xpm": safe_div(n, _minutes_alive()),
        "unused grant": F.col("max_grant_kb") - F.col("max_used_grant_kb"),
        "compiles": cached,
        "recent compilations": cached,
        # queries of several plans come first by their cpu time
        "duplicate": F.when(F.col("plan_count") > 1, F.col("total_worker_time")),
    }


def top_by_metrics(df: DataFrame, metrics: dict[str, Column], n: int, key: list[str], keep: list[str] = (),
                   dtype: str = "double", positive: bool = False, name: str = "metric", value: str = "metric_value") -> DataFrame:
    """Top ``n`` rows for every metric in one pass: (metric, key..., keep..., value, rk).

    Descending, null last, ties by key; ``positive`` leaves out values of 0
    and less.  The group limit on the exploded rows keeps n a metric in every
    task before the shuffle, so a metric's window sees n rows a task at most.
    """
    each = F.array(*[F.struct(F.lit(m).alias("m"), c.cast(dtype).alias("v")) for m, c in metrics.items()])
    long = df.select(*key, *keep, F.explode(each).alias("__m")).select(
        F.col("__m.m").alias(name), *key, *keep, F.col("__m.v").alias(value))
    if positive:
        long = long.where(F.col(value) > 0)
    w = Window.partitionBy(name).orderBy(F.col(value).desc_nulls_last(), *key)
    return long.withColumn("rk", F.row_number().over(w)).where(F.col("rk") <= n).withColumn("rk", F.col("rk").cast("bigint"))


def rank_rows(top: DataFrame, order: list, rank_col: str = "rk") -> DataFrame:
    """Number an already small (top-N) frame in ``order``."""
    w = Window.partitionBy(F.lit(1)).orderBy(*order)
    return top.withColumn(rank_col, F.row_number().over(w).cast("bigint"))


def top_n(df: DataFrame, measure: Column, key: str, n: int, rank_col: str = "rk") -> DataFrame:
    order = [measure.desc_nulls_last(), F.col(key)]
    return rank_rows(df.orderBy(*order).limit(n), order, rank_col)


def rank_by(df: DataFrame, sort: str, n: int, key: str = "query_hash", as_of: str | None = None) -> DataFrame:
    """Top ``n`` rows by one of ``sort_keys()`` (descending; ties by key)."""
    m = sort_keys(as_of)[sort.lower()]
    return top_n(df.withColumn("sort_value", m.cast("double")), F.col("sort_value"), key, n)


def greedy_top_n(df: DataFrame, metrics: dict[str, Column], n: int, key: str = "query_hash") -> DataFrame:
    """Top ``n`` per metric in order; a key taken by an earlier metric is skipped by later ones.

    Earlier metrics take at most n (k - 1) keys, so the first n k of each of
    the k metrics decide; the rule runs on those n k^2 rows only.
    """
    order = list(metrics)
    cand = top_by_metrics(df, metrics, n * len(order), [key])
    schema = cand.schema

    def pick(rows):
        taken, out = set(), []
        for m in order:
            own = rows[rows["metric"] == m].sort_values("rk")
            own = own[~own[key].isin(taken)].head(n)
            taken.update(own[key])
            out.append(own.assign(rk=range(1, len(own) + 1)))
        return pd.concat(out)[rows.columns]

    return cand.withColumn("__all", F.lit(1)).groupBy("__all").applyInPandas(lambda rows: pick(rows.drop(columns="__all")), schema).select("metric", key, "metric_value", "rk")


def points(df: DataFrame, metrics: dict[str, Column], n: int = 10, key: str = "query_hash") -> DataFrame:
    """+1 point for each metric in whose top ``n`` a key sits; keys with points only."""
    return top_by_metrics(df, metrics, n, [key]).groupBy(key).agg(
        F.count(F.lit(1)).alias("points"), F.array_join(F.array_sort(F.collect_list("metric")), ",").alias("metrics"))


def dual_rank(df: DataFrame, metrics: dict[str, Column], n: int, date: str, key: list[str]) -> DataFrame:
    """Rows among the overall top ``n`` of a metric with a value above 0: (metric, date, key..., value, overall_rank, date_rank).

    What precedes one of them within its date is among the n itself, so the
    rank within the date needs no other rows.
    """
    top = top_by_metrics(df, metrics, n, [*key, date], positive=True, dtype="bigint").withColumnRenamed("rk", "overall_rank")
    w = Window.partitionBy("metric", date).orderBy("overall_rank")
    return top.withColumn("date_rank", F.row_number().over(w).cast("bigint"))


def best_per_key(df: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """The row with the largest ``order`` tuple per key (``ROW_NUMBER() = 1``), via ``max_by``."""
    cols = [c for c in df.columns if c not in key]
    best = F.max_by(F.struct(*cols), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*key).agg(best.alias("__b")).select(*key, *[F.col(f"__b.{c}").alias(c) for c in cols])


def group_stats_join(df: DataFrame, key: list[str], aggs: list[Column]) -> DataFrame:
    """``agg(...) OVER (PARTITION BY key)`` as an aggregate joined back (partial aggregation
    before the shuffle; AQE splits a hot key's side of the join)."""
    return df.join(df.groupBy(*key).agg(*aggs), key)
