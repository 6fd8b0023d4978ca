"""Deltas between cumulative snapshots (waits, files, counters) and their reports.

Snapshots are rows (server, check_date, metric keys..., cumulative counters).
The kernel first pairs every snapshot date with the server's previous one
(a window over the small distinct (server, date) table), then equi-joins
each metric row with the same metric at the previous date.  A metric absent
from the immediately preceding snapshot therefore yields no row, and the
join key includes the date, so a hot server or metric does not land in one
task as a ``lag`` window per metric would.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.semantics import datediff, round_div

def snapshot_pairs(df: DataFrame, server: str = "server_name", date: str = "check_date") -> DataFrame:
    """(server, check_date, prev_check_date) for every snapshot after a server's first."""
    w = Window.partitionBy(server).orderBy(date)
    d = df.select(server, date).distinct()
    return (d.withColumn("prev_check_date", F.lag(date).over(w))
            .filter(F.col("prev_check_date").isNotNull()))


def snapshot_delta(df: DataFrame, keys: list[str], counters: list[str], monotonic: list[str] = (),
                   server: str = "server_name", date: str = "check_date", carry: list[str] = (),
                   min_gap_minutes: int | None = 1, max_gap_minutes: int | None = 60,
                   pairs: DataFrame | None = None) -> DataFrame:
    """Counter deltas between consecutive snapshots of a server.

    ``keys`` identify a metric; ``counters`` become ``<c>_delta``; rows whose
    ``monotonic`` counters fell (restart) are dropped; the gap between the
    two snapshots must lie in [min, max] minutes (boundary count, as the
    source's ``DATEDIFF``).  ``carry`` columns are taken from the current row.
    ``pairs`` (from ``snapshot_pairs`` of the whole table) may be passed
    when ``df`` holds only some metrics of each snapshot.
    """
    if pairs is None:
        pairs = snapshot_pairs(df, server, date)
    cur = df.join(pairs, [server, date])
    prev = df.select(server, *keys, F.col(date).alias("prev_check_date"),
                     *[F.col(c).alias(f"__p_{c}") for c in counters])
    j = cur.join(prev, [server, *keys, "prev_check_date"])
    gap = datediff("minute", F.col("prev_check_date"), F.col(date))
    cond = F.lit(True)
    if min_gap_minutes is not None:
        cond = cond & (gap >= min_gap_minutes)
    if max_gap_minutes is not None:
        cond = cond & (gap <= max_gap_minutes)
    for c in monotonic:
        cond = cond & (F.col(c) >= F.col(f"__p_{c}"))
    return j.filter(cond).select(
        server, date, *keys, *carry, "prev_check_date",
        datediff("second", F.col("prev_check_date"), F.col(date)).alias("elapsed_seconds"),
        *[(F.col(c) - F.col(f"__p_{c}")).alias(f"{c}_delta") for c in counters])


def with_category(df: DataFrame, cats: DataFrame, key: str = "wait_type") -> DataFrame:
    """Category lookup (``cats``: key, wait_category, ignorable) with default ``Other`` / not ignorable."""
    return (df.join(cats, key, "left")
            .withColumn("wait_category", F.coalesce("wait_category", F.lit("Other")))
            .withColumn("ignorable", F.coalesce("ignorable", F.lit(False))))


def never_acceptable(deltas: DataFrame, listed: DataFrame, over_ms: int = 1000, key: str = "wait_type") -> DataFrame:
    """Growth of more than ``over_ms`` of a wait on the list (``listed``: key), by server: snapshots and the largest growth."""
    hit = deltas.filter(F.col("wait_time_ms_delta") > over_ms).join(listed.select(key).distinct(), key, "left_semi")
    return hit.groupBy("server_name", key).agg(F.count(F.lit(1)).alias("snapshots"), F.max("wait_time_ms_delta").alias("max_delta_ms"))


def wait_deltas(waits: DataFrame, cats: DataFrame) -> DataFrame:
    """Wait deltas with minutes, minutes per minute and category (restart and gap guards)."""
    d = snapshot_delta(waits, ["wait_type"], ["wait_time_ms", "signal_wait_time_ms", "waiting_tasks_count"],
                       monotonic=["wait_time_ms"])
    d = with_category(d, cats)
    return d.select(
        "server_name", "check_date", "wait_type", "wait_category", "ignorable", "elapsed_seconds",
        "wait_time_ms_delta",
        (F.col("wait_time_ms_delta") / F.lit(60000.0)).alias("wait_time_minutes_delta"),
        F.try_divide(F.col("wait_time_ms_delta") / F.lit(1000.0), F.col("elapsed_seconds"))
         .alias("wait_time_minutes_per_minute"),
        "signal_wait_time_ms_delta", "waiting_tasks_count_delta")


def file_deltas(files: DataFrame) -> DataFrame:
    """File I/O deltas: growth, stalls, integer average stall per I/O, megabytes."""
    d = snapshot_delta(files, ["file_name"],
                       ["size_on_disk_mb", "io_stall_read_ms", "num_of_reads", "bytes_read",
                        "io_stall_write_ms", "num_of_writes", "bytes_written"],
                       monotonic=["num_of_reads", "num_of_writes"], carry=["type_desc", "physical_name"])
    avg = lambda s, n: F.when(F.col(n) == 0, F.lit(0).cast("bigint")).otherwise(
        F.call_function("div", F.col(s), F.col(n)))
    return d.select(
        "server_name", "check_date", "file_name", "type_desc", "physical_name", "elapsed_seconds",
        F.col("size_on_disk_mb_delta").alias("size_on_disk_mb_growth"),
        F.col("io_stall_read_ms_delta").alias("io_stall_read_ms"),
        avg("io_stall_read_ms_delta", "num_of_reads_delta").alias("io_stall_read_ms_average"),
        F.col("num_of_reads_delta").alias("num_of_reads"),
        (F.col("bytes_read_delta") / F.lit(1024.0) / F.lit(1024.0)).alias("megabytes_read"),
        F.col("io_stall_write_ms_delta").alias("io_stall_write_ms"),
        avg("io_stall_write_ms_delta", "num_of_writes_delta").alias("io_stall_write_ms_average"),
        F.col("num_of_writes_delta").alias("num_of_writes"),
        (F.col("bytes_written_delta") / F.lit(1024.0) / F.lit(1024.0)).alias("megabytes_written"))


def counter_deltas(counters: DataFrame, pairs: DataFrame | None = None) -> DataFrame:
    """Counter deltas and per-second rate (no restart guard, as the source)."""
    d = snapshot_delta(counters, ["object_name", "counter_name", "instance_name"], ["cntr_value"],
                       carry=["cntr_type"], pairs=pairs)
    return d.withColumn("cntr_value_per_second",
                        F.try_divide(F.col("cntr_value_delta").cast("double"), F.col("elapsed_seconds")))


def counter_actuals(counters: DataFrame, raw: int, rate: int, fraction: int, base: int, average: int,
                    base_of: dict[str, str]) -> DataFrame:
    """Counter values by type: raw value, per-second rate, fraction of a base, average per base.

    ``base_of`` maps a fraction/average counter name to its base counter name; a
    row whose base is absent has no value.  The bases of an object instance's
    snapshot are laid beside its rows (one window over the counters of that
    instance), and rates and averages share one delta.
    """
    keys = ["object_name", "counter_name", "instance_name"]
    own = Window.partitionBy("server_name", "check_date", "object_name", "instance_name")
    here = F.collect_list(F.when(F.col("cntr_type") == base, F.struct("counter_name", "cntr_value"))).over(own)
    name = F.create_map(*[F.lit(x) for pair in base_of.items() for x in pair])[F.col("counter_name")]
    c = counters.withColumn("__bases", here).withColumn("__base", name)
    c = c.withColumn("base_value", F.get(F.filter("__bases", lambda x: x["counter_name"] == F.col("__base")), 0)["cntr_value"]).drop("__bases", "__base")
    kind, based = F.col("cntr_type"), F.col("base_value").isNotNull()
    value = (F.when(kind == raw, F.col("cntr_value").cast("double"))
             .when(F.col("base_value") != 0, F.col("cntr_value") * F.lit(100.0) / F.col("base_value")))
    now = c.filter((kind == raw) | ((kind == fraction) & based)).select("server_name", "check_date", *keys, "cntr_type", value.alias("value"))
    d = snapshot_delta(c.filter((kind == rate) | ((kind == average) & based)), keys, ["cntr_value", "base_value"], carry=["cntr_type"],
                       pairs=snapshot_pairs(counters))
    change = F.col("cntr_value_delta")
    value = (F.when(kind == rate, F.try_divide(change.cast("double"), F.col("elapsed_seconds")))
             .when(F.col("base_value_delta") != 0, change / F.col("base_value_delta").cast("double")))
    return now.unionByName(d.select("server_name", "check_date", *keys, "cntr_type", value.alias("value")))


def latest_pair(deltas: DataFrame, server: str = "server_name", date: str = "check_date") -> DataFrame:
    """Deltas of each server's most recent snapshot pair (the two-pass comparison)."""
    last = deltas.groupBy(server).agg(F.max(date).alias(date))
    return deltas.join(last, [server, date], "left_semi")


def top_n_per(df: DataFrame, part: list[str], order: list, n: int, rank_col: str = "rk") -> DataFrame:
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w).cast("bigint")).filter(F.col(rank_col) <= n)


def signal_pct(signal, total) -> F.Column:
    return F.when(F.col(total) > 0, round_div(F.col(signal) * 100, F.col(total), 1))
