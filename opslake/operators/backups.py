"""Backup-history analysis: gaps, worst-case recovery point and time, recovery chains.

The history is collected from many servers, so a database is (server, guid,
name): the same name may live on several servers, and a database dropped and
created again under its old name has a new guid.  Its backups form one stream
ordered by LSN / time.  "Latest full before this log", "previous backup" and
"next full" are look-backs over that stream (``timeseries.fill_last``),
partitioned by (database, range of time or LSN with a bounded number of rows) so
a database holding most of the history does not become one task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.semantics import datediff, ts_lit
from opslake.operators.timeseries import bounded_buckets, fill_last, prev_row
from opslake.sources.sinks import materialize

FULL, DIFF, LOG = "D", "I", "L"
KEY = ["server_name", "database_guid", "database_name"]


def _mb(c="backup_size"):
    return F.call_function("div", F.col(c), F.lit(1048576))


def _seconds():
    return datediff("second", F.col("backup_start_date"), F.col("backup_finish_date"))


def gaps(b: DataFrame) -> DataFrame:
    """Minutes between consecutive backups (by finish time, then id) of each database."""
    p = prev_row(b.select(*KEY, "backup_set_id", "backup_finish_date"), KEY,
                 ["backup_finish_date", "backup_set_id"], ["backup_set_id", "backup_finish_date"])
    return (p.filter(F.col("prev_backup_set_id").isNotNull())
            .withColumn("gap_minutes", datediff("minute", F.col("prev_backup_finish_date"),
                                                F.col("backup_finish_date"))))


def rpo_worst(b: DataFrame) -> DataFrame:
    """Largest gap per database with both end ids (ties: the later backup)."""
    g = gaps(b)
    best = F.max_by(F.struct("gap_minutes", "prev_backup_set_id", "backup_set_id"),
                    F.struct("gap_minutes", "backup_set_id"))
    return (g.groupBy(*KEY).agg(best.alias("w"))
            .select(*KEY, F.col("w.gap_minutes").alias("rpo_worst_minutes"),
                    F.col("w.prev_backup_set_id").alias("gap_start_id"),
                    F.col("w.backup_set_id").alias("gap_end_id")))


def with_base_full(b: DataFrame, bucket=None) -> DataFrame:
    """Add ``base_full_id``: the latest full backup with a smaller LSN in the same database."""
    v = F.when(F.col("type") == FULL, F.col("backup_set_id"))
    return fill_last(b, KEY, ["first_lsn", "backup_set_id"], v, bucket, "base_full_id", strict=True)


def next_full(b: DataFrame) -> DataFrame:
    """For every full backup, the next full of the database (none for the last)."""
    f = b.filter(F.col("type") == FULL).select(*KEY, "backup_set_id", "backup_start_date", "first_lsn")
    p = prev_row(f, KEY, ["first_lsn", "backup_set_id"], ["backup_set_id"])
    nxt = p.filter(F.col("prev_backup_set_id").isNotNull()).select(
        *KEY, F.col("prev_backup_set_id").alias("backup_set_id"), F.col("backup_set_id").alias("next_full_id"),
        F.col("backup_start_date").alias("next_full_start"))
    return f.join(nxt, [*KEY, "backup_set_id"], "left").select(
        *KEY, F.col("backup_set_id").alias("full_id"), "next_full_id", "next_full_start")


def recovery_points(b: DataFrame) -> DataFrame:
    """Per database: last log backup, its base full, and fulls no log is based on."""
    bb = with_base_full(b)
    logs = bb.filter(F.col("type") == LOG)
    last = logs.groupBy(*KEY).agg(
        F.max_by(F.struct("backup_set_id", "backup_finish_date", "base_full_id"),
                 F.struct("backup_finish_date", "backup_set_id")).alias("l"))
    attached = logs.filter(F.col("base_full_id").isNotNull()).select(
        *KEY, F.col("base_full_id").alias("backup_set_id")).distinct()
    unattached = (b.filter(F.col("type") == FULL).select(*KEY, "backup_set_id")
                  .join(attached, [*KEY, "backup_set_id"], "left_anti")
                  .groupBy(*KEY).agg(F.count(F.lit(1)).alias("unattached_fulls")))
    return (last.select(*KEY, F.col("l.backup_set_id").alias("last_log_id"),
                        F.col("l.backup_finish_date").alias("last_log_finish"),
                        F.col("l.base_full_id").alias("base_full_id"))
            .join(unattached, KEY, "left")
            .withColumn("unattached_fulls", F.coalesce("unattached_fulls", F.lit(0))))


def chains(b: DataFrame) -> DataFrame:
    """One row per full backup: its log horizon, latest differential and restore totals.

    The stream is first cut into segments, each headed by a full or differential
    with the logs that follow it, and summed per segment; a chain is then the
    segments from one full to the next, and the logs to apply are those of its
    last segment.  Logs are never joined back to their chain.
    """
    kind, lsn = F.col("type"), F.col("first_lsn")
    rows = b.select(*KEY, "backup_set_id", "type", "first_lsn", _mb().alias("mb"), _seconds().alias("secs"))
    # both look-backs use the same ranges; written once, as each reads its rows twice
    rows = materialize(bounded_buckets(rows, KEY, "first_lsn", "range"), "chain-rows")
    head = F.when(kind.isin(FULL, DIFF), F.struct("backup_set_id", "type", "first_lsn", "range"))
    cut = fill_last(rows, KEY, ["first_lsn", "backup_set_id"], head, F.col("range"), "head").drop("range").filter(F.col("head").isNotNull())
    own = F.col("backup_set_id") == F.col("head.backup_set_id")
    after = (kind == LOG) & ((F.col("head.type") == FULL) | (lsn > F.col("head.first_lsn")))
    segments = cut.groupBy(*KEY, "head").agg(
        F.max(F.when(own, F.col("mb"))).alias("mb"), F.max(F.when(own, F.col("secs"))).alias("secs"),
        F.count(F.when(kind == LOG, 1)).alias("logs"), F.count(F.when(after, 1)).alias("after"),
        F.sum(F.when(after, F.col("mb"))).alias("after_mb"), F.sum(F.when(after, F.col("secs"))).alias("after_secs"),
        F.max(F.when(after, F.col("mb"))).alias("after_worst")).select("*", "head.*").drop("head")
    # a full heads its own chain and ends the chain of the full before it
    place = lambda full_id, ends: F.struct(F.col(full_id).alias("full_id"), F.lit(ends).alias("ends"))
    placed = (with_base_full(segments, F.col("range"))
              .select("*", F.inline(F.when(kind == FULL, F.array(place("backup_set_id", False), place("base_full_id", True)))
                                    .otherwise(F.array(place("base_full_id", False)))))
              .filter(F.col("full_id").isNotNull()))
    ends, order = F.col("ends"), F.struct("first_lsn", "backup_set_id")
    inside = F.when(~ends, order)
    c = placed.groupBy(*KEY, "full_id").agg(
        F.max(F.when(ends, F.col("backup_set_id"))).alias("next_full_id"),
        F.sum(F.when(~ends, F.col("logs"))).alias("log_count"),
        F.max(F.when(~ends & (kind == FULL), F.col("mb"))).alias("full_mb"),
        F.max(F.when(~ends & (kind == FULL), F.col("secs"))).alias("full_seconds"),
        F.max_by(F.struct("backup_set_id", "mb", "secs"), F.when(kind == DIFF, order)).alias("d"),
        F.max_by(F.struct("after", "after_mb", "after_secs", "after_worst"), inside).alias("l"))
    z = lambda c_: F.coalesce(F.col(c_), F.lit(0))
    return c.select(*KEY, "full_id", "next_full_id", z("log_count").alias("log_count"),
                    F.col("d.backup_set_id").alias("latest_diff_id"), "full_mb", "full_seconds",
                    z("d.mb").alias("diff_mb"), z("d.secs").alias("diff_seconds"),
                    z("l.after").alias("logs_to_apply"), z("l.after_mb").alias("logs_mb"),
                    z("l.after_secs").alias("logs_seconds"), z("l.after_worst").alias("worst_log_mb"),
                    (F.col("full_mb") + z("d.mb") + z("l.after_mb")).alias("total_mb"),
                    (F.col("full_seconds") + z("d.secs") + z("l.after_secs")).alias("total_seconds"))


def rto_worst(b: DataFrame, speed_mbps: float = 100.0) -> DataFrame:
    """Worst-case restore minutes per database: largest chain size / speed.

    The source divides speed by size when a speed override is given; we use
    size / speed / 60 throughout.
    """
    c = chains(b)
    w = c.groupBy(*KEY).agg(F.max_by(F.struct("full_id", "total_mb"), F.struct("total_mb", "full_id")).alias("w"))
    return w.select(*KEY, F.col("w.full_id").alias("full_id"), F.col("w.total_mb").alias("total_mb"),
                    (F.col("w.total_mb") / F.lit(float(speed_mbps)) / F.lit(60.0)).alias("rto_worst_minutes"))


def size_averages(b: DataFrame) -> DataFrame:
    m = b.withColumn("mb", _mb())
    avg = lambda t: F.avg(F.when(F.col("type") == t, F.col("mb")))
    return m.groupBy(*KEY).agg(avg(FULL).alias("avg_full_mb"), avg(DIFF).alias("avg_diff_mb"),
                               avg(LOG).alias("avg_log_mb"))


def big_diff_log(b: DataFrame, min_full_mb: int = 10240, diff_pct: int = 40, log_pct: int = 20) -> DataFrame:
    a = size_averages(b)
    big = F.col("avg_full_mb") > min_full_mb
    return a.select("*", F.coalesce(big & (F.col("avg_diff_mb") * 100 >= F.col("avg_full_mb") * diff_pct),
                                    F.lit(False)).alias("big_diff"),
                    F.coalesce(big & (F.col("avg_log_mb") * 100 >= F.col("avg_full_mb") * log_pct),
                               F.lit(False)).alias("big_log"))


def rpo_overdue(b: DataFrame, as_of: str, rpo_minutes: int, n: int) -> DataFrame:
    """Databases whose last backup started more than ``rpo_minutes`` before ``as_of``; oldest first."""
    last = b.groupBy(*KEY).agg(F.max("backup_start_date").alias("last_start"))
    due = last.filter(F.col("last_start") < F.timestamp_add("MINUTE", F.lit(-rpo_minutes), ts_lit(as_of)))
    return due.orderBy("last_start", *KEY).limit(n)


def stalled(b: DataFrame, rpo_seconds: int) -> DataFrame:
    return (b.withColumn("duration_seconds", _seconds()).filter(F.col("duration_seconds") > rpo_seconds)
            .select(*KEY, "backup_set_id", "backup_start_date", "duration_seconds"))


def restore_files(b: DataFrame, stop_at: str) -> DataFrame:
    """Log backups to restore up to ``stop_at``: the logs on the last full before it,
    finished by then, plus the first log finishing after it."""
    stop = ts_lit(stop_at)
    bb = with_base_full(b)
    base = (b.filter((F.col("type") == FULL) & (F.col("backup_finish_date") <= stop))
            .groupBy(*KEY).agg(F.max_by("backup_set_id", F.struct("first_lsn", "backup_set_id"))
                               .alias("base_full_id")))
    logs = bb.filter(F.col("type") == LOG).join(base, [*KEY, "base_full_id"])
    before = logs.filter(F.col("backup_finish_date") <= stop)
    first_after = (logs.filter(F.col("backup_finish_date") > stop).groupBy(*KEY, "base_full_id")
                   .agg(F.min_by("backup_set_id", F.struct("backup_finish_date", "backup_set_id")).alias("backup_set_id")))
    keep = before.select(*KEY, "backup_set_id").unionByName(first_after.select(*KEY, "backup_set_id"))
    return bb.join(keep, [*KEY, "backup_set_id"], "left_semi").select(
        *KEY, "backup_set_id", "base_full_id", "backup_finish_date")
