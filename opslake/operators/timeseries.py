"""Ordered look-backs (previous row, last value before, as-of join) that survive a hot key.

A window partitioned only by the group key (``lag`` or ``last(ignorenulls)``
per database) puts a group holding a third of all rows into one task.  Here
the work is partitioned by (group, bucket), a bucket being a range of the
ordering column; each bucket contributes one summary row, and a window over
that small summary table carries the last value across bucket boundaries.  The
result equals the plain window's.

The ranges' borders come from a quantile sketch of every group, so a bucket
holds about ``ROWS`` rows wherever a group's rows lie: half of them on one day
make that day many buckets, and a small group is one.  Rows of one value of the
ordering column share a bucket.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: rows of a bucket, and borders that a group's sketch may give: groups of more than ROWS * BORDERS rows get larger buckets
ROWS, BORDERS = 100_000, 1024


def _number(df: DataFrame, col: str) -> Column:
    """A number in the order of the column."""
    kind = df.schema[col].dataType.typeName()
    if kind == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(col))
    if kind == "timestamp":
        return F.unix_micros(col)
    if kind == "date":
        return F.unix_date(col).cast("bigint")
    if kind == "string":
        # the first code units, as one number
        return F.conv(F.rpad(F.hex(F.substring(F.col(col).cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")
    return F.col(col)


def _joined(df: DataFrame, side: DataFrame, keys: list[str], how: str) -> DataFrame:
    """Join on keys where null equals null, as the groups of a window."""
    names = {k: f"__k_{k}" for k in keys}
    other = side.withColumnsRenamed(names)
    on = reduce(lambda x, y: x & y, [df[k].eqNullSafe(other[n]) for k, n in names.items()])
    return df.join(other, on, how).drop(*names.values())


def bounded_buckets(df: DataFrame, by: list[str], col: str, out: str = "__b", rows: int | None = None, borders: int = BORDERS) -> DataFrame:
    """Add ``out``: a bucket number that does not fall as ``col`` rises within a group of ``by``.

    One aggregation sketches the quantiles of every group; a group of up to
    ``rows`` rows is one bucket, a larger one gets as many as its count asks for.
    """
    rows = rows or ROWS
    d = df.withColumn("__v", _number(df, col))
    grid = [i / borders for i in range(1, borders)]
    stats = d.groupBy(*by).agg(F.count(F.lit(1)).alias("__n"), F.percentile_approx("__v", grid, 4 * borders).alias("__q"))
    step = F.greatest(F.lit(1), F.floor(F.lit(borders * rows) / F.col("__n")))
    used = F.when(F.col("__n") > rows, F.filter("__q", lambda x, i: (i + 1) % step == 0)).otherwise(F.array().cast(_array(d)))
    stats = stats.select(*by, used.alias("__q"))
    # borders in a row of about 32 first, then the 32 between two of those
    width = 32
    d = _joined(d, stats, by, "left") if by else d.withColumn("__q", stats.select("__q").scalar())
    coarse = F.filter("__q", lambda x, i: (i + 1) % width == 0)
    skip = F.size(F.filter(coarse, lambda x: x < F.col("__v"))) * width
    fine = F.size(F.filter(F.slice(F.col("__q"), skip + 1, width), lambda x: x < F.col("__v")))
    return d.withColumn(out, F.coalesce(skip + fine, F.lit(-1))).drop("__v", "__q")


def _array(d: DataFrame) -> str:
    return f"array<{d.schema['__v'].dataType.simpleString()}>"


def _bucketed(df: DataFrame, by: list[str], order: list[str], bucket: Column | None) -> DataFrame:
    return bounded_buckets(df, by, order[0]) if bucket is None else df.withColumn("__b", bucket)


def fill_last(df: DataFrame, by: list[str], order: list[str], value: Column | str, bucket: Column | None,
              out: str, strict: bool = False) -> DataFrame:
    """Add ``out`` = last non-null ``value`` at or before (``strict``: before) each row.

    ``order`` columns give a total order inside a group; ``bucket``, if given, must be
    non-decreasing in that order.
    """
    v = F.col(value) if isinstance(value, str) else value
    d = _bucketed(df, by, order, bucket).withColumn("__v", v)
    hi = -1 if strict else 0
    w_in = (Window.partitionBy(*by, "__b").orderBy(*order)
            .rowsBetween(Window.unboundedPreceding, hi))
    # one row per (group, bucket): the bucket's last non-null value (max_by ignores null orderings)
    key = F.when(F.col("__v").isNotNull(), F.struct(*[F.col(c) for c in order]))
    per_bucket = d.groupBy(*by, "__b").agg(F.max_by("__v", key).alias("__bl"))
    # every bucket takes the value of the latest earlier bucket that has one (small table)
    w_b = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carry = per_bucket.select(*by, "__b", F.last("__bl", ignorenulls=True).over(w_b).alias("__carry2"))
    d = d.withColumn("__local", F.last("__v", ignorenulls=True).over(w_in))
    res = _joined(d, carry, [*by, "__b"], "left")
    return res.withColumn(out, F.coalesce("__local", "__carry2")).drop("__b", "__v", "__local", "__carry2")


def prev_row(df: DataFrame, by: list[str], order: list[str], cols: list[str], bucket: Column | None = None,
             prefix: str = "prev_") -> DataFrame:
    """``lag`` of ``cols`` within each group (the previous row by ``order``), skew-safe."""
    s = F.struct(*[F.col(c).alias(c) for c in cols])
    out = fill_last(df, by, order, s, bucket, "__prev", strict=True)
    return out.select("*", *[F.col("__prev").getField(c).alias(prefix + c) for c in cols]).drop("__prev")


def asof_join(left: DataFrame, right: DataFrame, by: list[str], left_ts: str, right_ts: str,
              right_cols: list[str], tie: str | None = None,
              inclusive: bool = True) -> DataFrame:
    """For each left row, the latest right row of the same group with ``right_ts <= left_ts``.

    ``tie`` orders right rows with equal time (larger wins).  With
    ``inclusive=False`` the right time must be strictly earlier.  No
    row pairs are formed: both sides are unioned into one ordered stream.
    """
    tie_c = F.col(tie) if tie else F.lit(0)
    r = right.select(*by, F.col(right_ts).alias("__t"),
                     F.lit(0 if inclusive else 1).alias("__side"), tie_c.cast("bigint").alias("__tie"),
                     F.struct(*[F.col(c).alias(c) for c in right_cols]).alias("__r"))
    lcols = left.columns
    l_ = left.select(*[F.col(c) for c in lcols], F.col(left_ts).alias("__t"),
                     F.lit(0 if not inclusive else 1).alias("__side"), F.lit(None).cast("bigint").alias("__tie"),
                     F.lit(None).cast(r.schema["__r"].dataType).alias("__r"))
    u = l_.unionByName(r, allowMissingColumns=True).withColumn("__isleft", F.col("__tie").isNull())
    filled = fill_last(u, by, ["__t", "__side", "__tie"], "__r", None, "__m")
    return (filled.filter("__isleft")
            .select(*[F.col(c) for c in lcols], *[F.col("__m").getField(c).alias(c) for c in right_cols]))


def row_number(df: DataFrame, by: list[str], order: list[str], bucket: Column | None = None, out: str = "rn") -> DataFrame:
    """``row_number() over (partition by by order by order)`` without one task per group.

    Rows are numbered inside (group, bucket) and offset by the row counts of
    the group's earlier buckets (a prefix sum over the small per-bucket count
    table).  ``bucket``, if given, must be non-decreasing in ``order``.
    """
    d = _bucketed(df, by, order, bucket)
    d = d.withColumn("__lr", F.row_number().over(Window.partitionBy(*by, "__b").orderBy(*order)))
    cnt = d.groupBy(*by, "__b").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(*by, "__b", "__off")
    return (_joined(d, off, [*by, "__b"], "inner").withColumn(out, (F.col("__lr") + F.col("__off")).cast("bigint"))
            .drop("__b", "__lr", "__off"))


def dense_rank(df: DataFrame, by: list[str], value: str, bucket: Column | None = None, out: str = "drk") -> DataFrame:
    """``dense_rank() over (partition by by order by value)`` without one task per group.

    ``bucket``, if given, must be a non-decreasing function of ``value`` (equal values
    share a bucket); the offset is the number of distinct values in earlier buckets.
    """
    d = _bucketed(df, by, [value], bucket)
    d = d.withColumn("__lr", F.dense_rank().over(Window.partitionBy(*by, "__b").orderBy(value)))
    cnt = d.groupBy(*by, "__b").agg(F.countDistinct(value).alias("__n"))
    w = Window.partitionBy(*by).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    off = cnt.withColumn("__off", F.coalesce(F.sum("__n").over(w), F.lit(0))).select(*by, "__b", "__off")
    return (_joined(d, off, [*by, "__b"], "inner").withColumn(out, (F.col("__lr") + F.col("__off")).cast("bigint"))
            .drop("__b", "__lr", "__off"))


def ntile(df: DataFrame, by: list[str], order: list[str], bucket: Column | None, n: int, out: str = "tile") -> DataFrame:
    """``ntile(n)``: the first ``N mod n`` tiles get one row more, as the SQL function."""
    r = row_number(df, by, order, bucket, "__k")
    r = _joined(r, df.groupBy(*by).agg(F.count(F.lit(1)).alias("__N")), by, "inner")
    q = F.call_function("div", F.col("__N"), F.lit(n))
    rem = F.col("__N") % n
    big = rem * (q + 1)
    k = F.col("__k")
    tile = F.when(k <= big, F.call_function("div", k - 1, q + 1) + 1).otherwise(
        rem + F.call_function("div", k - big - 1, F.greatest(q, F.lit(1))) + 1)
    return r.withColumn(out, tile.cast("int")).drop("__k", "__N")
