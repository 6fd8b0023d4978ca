"""Aggregation kernels: size roll-ups, shares, conditional sums, pivots, string aggregation.

Every kernel is a ``groupBy().agg()`` (partial aggregation before the shuffle);
grand totals are one-row aggregates used as scalar subqueries, never a
``sum() over ()`` window that would pull all rows into one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scalar import human_bytes
from opslake.functions.semantics import col_, round_div

PAGE_KB = 8


def total(df: DataFrame, c) -> Column:
    """Grand total of ``c`` as a scalar subquery (one partial-aggregate job)."""
    return df.select(F.sum(col_(c)).alias("t")).scalar()


def share_pct(part, whole, scale: int = 2) -> Column:
    """``round(100 * part / whole, scale)`` in exact integer arithmetic."""
    return F.when(col_(whole) != 0, round_div(col_(part) * 100, col_(whole), scale))


def table_sizes(cat: DataFrame) -> DataFrame:
    """Per-table size text (GB 1 dp / MB 2 dp / KB 2 dp) and bytes per row."""
    per_row = lambda c: F.when(F.col("table_rows") > 0, F.call_function(
        "div", F.col(c) * 2 + F.col("table_rows"), F.col("table_rows") * 2))
    tot = F.col("data_length") + F.col("index_length") + F.col("data_free")
    return cat.select("table_schema", "table_name", "table_rows",
                      human_bytes("data_length").alias("data_text"), per_row("data_length").alias("data_per_row"),
                      human_bytes("index_length").alias("idx_text"), per_row("index_length").alias("idx_per_row"),
                      human_bytes(tot).alias("total_size"),
                      human_bytes("data_free", gb_scale=2).alias("data_free_text"))


def schema_sizes(cat: DataFrame) -> DataFrame:
    g = cat.groupBy("table_schema").agg(
        F.sum(F.col("data_length") + F.col("index_length") + F.col("data_free")).alias("__t"),
        F.sum("data_length").alias("data_length"), F.sum("index_length").alias("index_length"),
        F.sum("data_free").alias("data_free"))
    return g.select("table_schema", human_bytes("__t", sep=" ").alias("total_size"),
                    "data_length", "index_length", "data_free")


def pages_mb(pages) -> Column:
    """8 KB pages to MB, half-up to 2 places."""
    return round_div(col_(pages) * PAGE_KB, F.lit(1024), 2)


def conditional_sums(df: DataFrame, by: list[str], cat_col: str, cats: dict[str, str], value: str) -> DataFrame:
    """``SUM(CASE WHEN cat = k THEN value END)`` per category, plus the total, in one pass."""
    aggs = [F.sum(F.when(F.col(cat_col) == k, F.col(value)).otherwise(0)).alias(name) for name, k in cats.items()]
    aggs.append(F.sum(value).alias("total"))
    return df.groupBy(*by).agg(*aggs)


def top_n_text(df: DataFrame, key: list[str], label: str, measure: str, n: int = 3,
               sep: str = ", ") -> DataFrame:
    """The ``n`` largest labels per key as one text, largest first (ties by label)."""
    w = Window.partitionBy(*key).orderBy(F.col(measure).desc(), F.col(label))
    top = df.withColumn("__r", F.row_number().over(w)).filter(F.col("__r") <= n)
    return (top.groupBy(*key)
            .agg(F.array_sort(F.collect_list(F.struct("__r", label))).alias("__a"))
            .select(*key, F.array_join(F.transform("__a", lambda s: s.getField(label)), sep).alias("top_" + label)))


def distinct_text(df: DataFrame, key: list[str], value: str, sep: str = ", ") -> DataFrame:
    """Distinct values per key, sorted, joined (``STUFF(... FOR XML PATH)``)."""
    return df.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_set(value)), sep).alias(value + "_list"))


def majority_and_others(df: DataFrame, key: list[str], actor: str, exclude: list[str] = (),
                        min_count: int = 2, counts: str | None = None) -> DataFrame:
    """Actors other than the most common one per key (tie: smallest name), with their count.

    ``counts`` names the count column of an input that has one row per key and actor already.
    """
    cnt = df.groupBy(*key, actor).agg(F.count(F.lit(1)).alias("n")) if counts is None else df.select(*key, actor, F.col(counts).alias("n"))
    w = Window.partitionBy(*key).orderBy(F.col("n").desc(), F.col(actor))
    ranked = cnt.withColumn("__r", F.row_number().over(w))
    majority = ranked.filter("__r = 1").select(*key, F.col(actor).alias("majority_" + actor))
    others = ranked.filter((F.col("__r") > 1) & (F.col("n") >= min_count)).drop("__r")
    if exclude:
        others = others.filter(~F.col(actor).isin(list(exclude)))
    return others.join(majority, key)


def months_ago_pivot(df: DataFrame, key: str, ts: str, as_of: str, value: str, months: int = 12) -> DataFrame:
    """Monthly trend with one column per month back (``m0`` = this month ... ``m12``)."""
    end = F.lit(as_of).cast("timestamp_ntz")
    ago = F.timestamp_diff("MONTH", F.date_trunc("month", F.col(ts)), F.date_trunc("month", end))
    base = df.withColumn("__ago", ago).filter((F.col("__ago") >= 0) & (F.col("__ago") <= months))
    p = base.groupBy(key).pivot("__ago", list(range(months + 1))).agg(F.sum(value))
    return p.select(key, *[F.coalesce(F.col(str(i)), F.lit(0)).cast("bigint").alias(f"m{i}")
                          for i in range(months + 1)])
