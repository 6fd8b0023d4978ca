"""Queries for snapshot (time-series) analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions.semantics import ts_lit
from opslake.operators import aggregate as A
from opslake.operators import ranking as R
from opslake.operators import snapshots as T
from opslake.plans.oracle_fixtures import ctes, sql_round_div
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

D = "CAST({} AS DOUBLE)"
CORES = 8
CATS_SQL = "wl AS wc"


def sql_pairs(src: str) -> str:
    return f"""(SELECT * FROM (SELECT server_name, check_date,
        lag(check_date) OVER (PARTITION BY server_name ORDER BY check_date) AS prev_check_date
        FROM (SELECT DISTINCT server_name, check_date FROM {src})) WHERE prev_check_date IS NOT NULL)"""


def sql_delta(src: str, keys: list[str], counters: list[str], monotonic=(), carry=(), pairs_src=None,
              gap=(1, 60)) -> str:
    on = " AND ".join(f"b.{k} = a.{k}" for k in ["server_name", *keys])
    cond = [f"date_diff('minute', p.prev_check_date, a.check_date) BETWEEN {gap[0]} AND {gap[1]}"]
    cond += [f"a.{c} >= b.{c}" for c in monotonic]
    cols = ", ".join([f"a.{k}" for k in ["server_name", "check_date", *keys, *carry]])
    deltas = ", ".join(f"a.{c} - b.{c} AS {c}_delta" for c in counters)
    return f"""SELECT {cols}, p.prev_check_date,
        date_diff('second', p.prev_check_date, a.check_date) AS elapsed_seconds, {deltas}
      FROM {src} a JOIN {sql_pairs(pairs_src or src)} p ON p.server_name = a.server_name AND p.check_date = a.check_date
      JOIN {src} b ON {on} AND b.check_date = p.prev_check_date
      WHERE {' AND '.join(cond)}"""


_WD = f"""WITH {ctes('x1w', 'wl')},
dd AS ({sql_delta('x1w', ['wait_type'], ['wait_time_ms', 'signal_wait_time_ms', 'waiting_tasks_count'],
                  monotonic=['wait_time_ms'])}),
wd AS (SELECT dd.server_name, dd.check_date, dd.wait_type, coalesce(wc.wait_category, 'Other') AS wait_category,
              coalesce(wc.ignorable, false) AS ignorable, elapsed_seconds, wait_time_ms_delta,
              wait_time_ms_delta / {D.format(60000)} AS wait_time_minutes_delta,
              CASE WHEN elapsed_seconds <> 0 THEN wait_time_ms_delta / {D.format(1000)} / elapsed_seconds END
                AS wait_time_minutes_per_minute,
              signal_wait_time_ms_delta, waiting_tasks_count_delta
       FROM dd LEFT JOIN {CATS_SQL} ON wc.wait_type = dd.wait_type)"""


def _cats(spark, d):
    return fx.wait_lookup(spark, d).select("wait_type", "wait_category", "ignorable")


def _wd(spark, d):
    return T.wait_deltas(fx.wait_snapshots(spark, d), _cats(spark, d))


@query("snapshot_pairs", f"WITH {ctes('x1w')} SELECT * FROM {sql_pairs('x1w')}")
def snapshot_pairs(spark, d):
    return T.snapshot_pairs(fx.wait_snapshots(spark, d))


@query("wait_deltas", _WD + " SELECT * FROM wd")
def wait_deltas(spark, d):
    return _wd(spark, d)


@query("wait_category_lookup", f"""WITH {ctes('x1w', 'wl')}
SELECT x1w.*, coalesce(wc.wait_category, 'Other') AS wait_category, coalesce(wc.ignorable, false) AS ignorable
FROM x1w LEFT JOIN {CATS_SQL} ON wc.wait_type = x1w.wait_type""")
def wait_category(spark, d):
    return T.with_category(fx.wait_snapshots(spark, d), _cats(spark, d))


_FD = f"""WITH {ctes('x1f')},
dd AS ({sql_delta('x1f', ['file_name'], ['size_on_disk_mb', 'io_stall_read_ms', 'num_of_reads', 'bytes_read',
                                          'io_stall_write_ms', 'num_of_writes', 'bytes_written'],
                  monotonic=['num_of_reads', 'num_of_writes'], carry=['type_desc', 'physical_name'])}),
fd AS (SELECT server_name, check_date, file_name, type_desc, physical_name, elapsed_seconds,
              size_on_disk_mb_delta AS size_on_disk_mb_growth, io_stall_read_ms_delta AS io_stall_read_ms,
              CASE WHEN num_of_reads_delta = 0 THEN 0 ELSE io_stall_read_ms_delta // num_of_reads_delta END
                AS io_stall_read_ms_average,
              num_of_reads_delta AS num_of_reads, bytes_read_delta / {D.format(1024)} / {D.format(1024)} AS megabytes_read,
              io_stall_write_ms_delta AS io_stall_write_ms,
              CASE WHEN num_of_writes_delta = 0 THEN 0 ELSE io_stall_write_ms_delta // num_of_writes_delta END
                AS io_stall_write_ms_average,
              num_of_writes_delta AS num_of_writes,
              bytes_written_delta / {D.format(1024)} / {D.format(1024)} AS megabytes_written FROM dd)"""


def _fd(spark, d):
    return T.file_deltas(fx.file_snapshots(spark, d))


@query("file_deltas", _FD + " SELECT * FROM fd")
def file_deltas(spark, d):
    return _fd(spark, d)


@query("counter_deltas", f"""WITH {ctes('x1c')},
dd AS ({sql_delta('x1c', ['object_name', 'counter_name', 'instance_name'], ['cntr_value'], carry=['cntr_type'])})
SELECT *, CASE WHEN elapsed_seconds <> 0 THEN CAST(cntr_value_delta AS DOUBLE) / elapsed_seconds END
  AS cntr_value_per_second FROM dd""")
def counter_deltas(spark, d):
    return T.counter_deltas(fx.counter_snapshots(spark, d))


_BASES = {"click": "view", "error": "view"}


@query("counter_actuals", f"""WITH {ctes('x1c')},
rate AS (SELECT * FROM x1c WHERE cntr_type = {fx.CNTR_RATE}),
rd AS ({sql_delta('rate', ['object_name', 'counter_name', 'instance_name'], ['cntr_value'], carry=['cntr_type'],
                  pairs_src='x1c')}),
bases AS (SELECT server_name, check_date, object_name, instance_name, counter_name AS base_name,
                 cntr_value AS base_value FROM x1c WHERE cntr_type = {fx.CNTR_BASE}),
bmap AS (SELECT * FROM (VALUES ('click', 'view'), ('error', 'view')) AS t(counter_name, base_name)),
av AS (SELECT a.*, b.base_name, b.base_value FROM x1c a JOIN bmap m ON m.counter_name = a.counter_name
       JOIN bases b ON b.server_name = a.server_name AND b.check_date = a.check_date AND b.object_name = a.object_name
        AND b.instance_name = a.instance_name AND b.base_name = m.base_name WHERE a.cntr_type = {fx.CNTR_AVG}),
ad AS ({sql_delta('av', ['object_name', 'counter_name', 'instance_name'], ['cntr_value', 'base_value'],
                  carry=['cntr_type'], pairs_src='x1c')})
SELECT server_name, check_date, object_name, counter_name, instance_name, cntr_type, CAST(cntr_value AS DOUBLE) AS value
FROM x1c WHERE cntr_type = {fx.CNTR_RAW}
UNION ALL
SELECT server_name, check_date, object_name, counter_name, instance_name, cntr_type,
       CASE WHEN elapsed_seconds <> 0 THEN CAST(cntr_value_delta AS DOUBLE) / elapsed_seconds END FROM rd
UNION ALL
SELECT a.server_name, a.check_date, a.object_name, a.counter_name, a.instance_name, a.cntr_type,
       CASE WHEN b.base_value <> 0 THEN a.cntr_value * {D.format(100)} / b.base_value END
FROM x1c a JOIN bmap m ON m.counter_name = a.counter_name
JOIN bases b ON b.server_name = a.server_name AND b.check_date = a.check_date AND b.object_name = a.object_name
 AND b.instance_name = a.instance_name AND b.base_name = m.base_name WHERE a.cntr_type = {fx.CNTR_FRACTION}
UNION ALL
SELECT server_name, check_date, object_name, counter_name, instance_name, cntr_type,
       CASE WHEN base_value_delta <> 0 THEN cntr_value_delta / CAST(base_value_delta AS DOUBLE) END FROM ad""")
def counter_actuals(spark, d):
    return T.counter_actuals(fx.counter_snapshots(spark, d), fx.CNTR_RAW, fx.CNTR_RATE, fx.CNTR_FRACTION,
                             fx.CNTR_BASE, fx.CNTR_AVG, _BASES)


_LAST = """last AS (SELECT server_name, MAX(check_date) AS check_date FROM wd GROUP BY server_name),
lp AS (SELECT wd.* FROM wd JOIN last USING (server_name, check_date))"""


@query("two_pass_topn", _WD + ", " + _LAST + """,
g AS (SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY wait_time_ms_delta DESC, wait_type) AS rk
      FROM lp WHERE wait_time_ms_delta > 0.5 * elapsed_seconds * 1000)
SELECT server_name, check_date, wait_type, wait_time_ms_delta, elapsed_seconds, rk FROM g WHERE rk <= 10""")
def two_pass(spark, d):
    lp = T.latest_pair(_wd(spark, d))
    sig = lp.filter(F.col("wait_time_ms_delta") * 2 > F.col("elapsed_seconds") * 1000)
    return T.top_n_per(sig, ["server_name"], [F.col("wait_time_ms_delta").desc(), "wait_type"], 10).select(
        "server_name", "check_date", "wait_type", "wait_time_ms_delta", "elapsed_seconds", "rk")


@query("poison_events", _WD + """
SELECT server_name, wd.wait_type, COUNT(*) AS snapshots, MAX(wait_time_ms_delta) AS max_delta_ms
FROM wd JOIN wl ON wl.wait_type = wd.wait_type WHERE wl.never_acceptable AND wait_time_ms_delta > 1000 GROUP BY ALL""")
def poison(spark, d):
    return T.never_acceptable(_wd(spark, d), fx.wait_lookup(spark, d).where("never_acceptable"))


@query("slow_files", _FD + """,
s AS (SELECT *, row_number() OVER (PARTITION BY type_desc ORDER BY io_stall_read_ms_average DESC, server_name,
                                   check_date, file_name) AS rk
      FROM fd WHERE io_stall_read_ms_average >= 5000)
SELECT server_name, check_date, file_name, type_desc, io_stall_read_ms_average, num_of_reads, rk FROM s WHERE rk <= 10""")
def slow_files(spark, d):
    f = _fd(spark, d).filter(F.col("io_stall_read_ms_average") >= 5000)
    return T.top_n_per(f, ["type_desc"], [F.col("io_stall_read_ms_average").desc(), "server_name", "check_date",
                                         "file_name"], 10).select(
        "server_name", "check_date", "file_name", "type_desc", "io_stall_read_ms_average", "num_of_reads", "rk")


@query("wait_summary", _WD + f"""
SELECT server_name, check_date, wait_type, wait_category,
       wait_time_ms_delta / {D.format(1000)} AS wait_seconds,
       wait_time_ms_delta / {D.format(3600000)} AS wait_hours,
       wait_time_ms_delta / {D.format(1000)} / {CORES} AS wait_seconds_per_core,
       CASE WHEN wait_time_ms_delta > 0 THEN {sql_round_div('signal_wait_time_ms_delta * 100', 'wait_time_ms_delta', 1)} END
         AS signal_pct,
       CASE WHEN waiting_tasks_count_delta > 0 THEN wait_time_ms_delta // waiting_tasks_count_delta END AS avg_ms_per_wait
FROM wd WHERE NOT ignorable""")
def wait_summary(spark, d):
    w = _wd(spark, d).filter(~F.col("ignorable"))
    return w.select(
        "server_name", "check_date", "wait_type", "wait_category",
        (F.col("wait_time_ms_delta") / F.lit(1000.0)).alias("wait_seconds"),
        (F.col("wait_time_ms_delta") / F.lit(3600000.0)).alias("wait_hours"),
        (F.col("wait_time_ms_delta") / F.lit(1000.0) / F.lit(CORES)).alias("wait_seconds_per_core"),
        T.signal_pct("signal_wait_time_ms_delta", "wait_time_ms_delta").alias("signal_pct"),
        F.when(F.col("waiting_tasks_count_delta") > 0, F.call_function(
            "div", F.col("wait_time_ms_delta"), F.col("waiting_tasks_count_delta"))).alias("avg_ms_per_wait"))


@query("stall_leaderboard", _FD + """,
r AS (SELECT 'read' AS kind, server_name, check_date, file_name, io_stall_read_ms AS stall_ms, megabytes_read AS mb,
             row_number() OVER (ORDER BY io_stall_read_ms DESC, server_name, check_date, file_name) AS rk
      FROM fd WHERE megabytes_read > 0),
w AS (SELECT 'write' AS kind, server_name, check_date, file_name, io_stall_write_ms AS stall_ms, megabytes_written AS mb,
             row_number() OVER (ORDER BY io_stall_write_ms DESC, server_name, check_date, file_name) AS rk
      FROM fd WHERE megabytes_written > 0)
SELECT * FROM r WHERE rk <= 20 UNION ALL SELECT * FROM w WHERE rk <= 20""")
def stall_leaderboard(spark, d):
    f = _fd(spark, d)
    out = None
    for kind, stall, mb in (("read", "io_stall_read_ms", "megabytes_read"),
                            ("write", "io_stall_write_ms", "megabytes_written")):
        # global top 20: TakeOrderedAndProject keeps 20 rows per partition, then ranks 20 rows
        top = (f.filter(F.col(mb) > 0)
               .select(F.lit(kind).alias("kind"), "server_name", "check_date", "file_name",
                       F.col(stall).alias("stall_ms"), F.col(mb).alias("mb"))
               .orderBy(F.col("stall_ms").desc(), "server_name", "check_date", "file_name").limit(20))
        top = T.top_n_per(top.withColumn("__one", F.lit(1)), ["__one"],
                          [F.col("stall_ms").desc(), "server_name", "check_date", "file_name"], 20).drop("__one")
        out = top if out is None else out.unionByName(top)
    return out


@query("wait_per_core", _WD + f"""
SELECT server_name, check_date, CAST(SUM(wait_time_ms_delta) AS BIGINT) AS wait_ms,
       MAX(elapsed_seconds) AS elapsed_seconds,
       SUM(wait_time_ms_delta) / {D.format(1000)} / {CORES} / MAX(elapsed_seconds) AS wait_seconds_per_core_per_second
FROM wd WHERE NOT ignorable GROUP BY ALL""")
def wait_per_core(spark, d):
    w = _wd(spark, d).filter(~F.col("ignorable"))
    g = w.groupBy("server_name", "check_date").agg(F.sum("wait_time_ms_delta").alias("wait_ms"),
                                                   F.max("elapsed_seconds").alias("elapsed_seconds"))
    return g.withColumn("wait_seconds_per_core_per_second",
                        F.col("wait_ms") / F.lit(1000.0) / F.lit(CORES) / F.col("elapsed_seconds"))


CUT = "1998-01-01 00:00:00"


@query("query_delta_pct", f"""
WITH p1 AS (SELECT l_partkey AS query_hash, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cpu, COUNT(*) AS execs
            FROM lineitem WHERE l_shipdate < TIMESTAMP '{CUT}' GROUP BY 1),
p2 AS (SELECT l_partkey AS query_hash, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS cpu, COUNT(*) AS execs
       FROM lineitem GROUP BY 1),
dd AS (SELECT p2.query_hash, p2.cpu - coalesce(p1.cpu, 0) AS cpu_delta, p2.execs - coalesce(p1.execs, 0) AS execs_delta
       FROM p2 LEFT JOIN p1 USING (query_hash))
SELECT *, cpu_delta * {D.format(100)} / (SELECT SUM(cpu_delta) FROM dd) AS pct_cpu FROM dd WHERE cpu_delta > 0""")
def query_delta(spark, d):
    li = table(spark, d, "lineitem")
    agg = lambda df: df.groupBy(F.col("l_partkey").alias("query_hash")).agg(
        F.sum(F.col("l_quantity").cast("bigint")).alias("cpu"), F.count(F.lit(1)).alias("execs"))
    p1 = agg(li.filter(F.col("l_shipdate") < ts_lit(CUT))).select(
        "query_hash", F.col("cpu").alias("cpu1"), F.col("execs").alias("execs1"))
    dd = agg(li).join(p1, "query_hash", "left").select(
        "query_hash", (F.col("cpu") - F.coalesce("cpu1", F.lit(0))).alias("cpu_delta"),
        (F.col("execs") - F.coalesce("execs1", F.lit(0))).alias("execs_delta"))
    tot = A.total(dd, "cpu_delta")
    return dd.filter(F.col("cpu_delta") > 0).withColumn("pct_cpu", F.col("cpu_delta") * F.lit(100.0) / tot)


@query("window_report", f"""WITH {ctes('xfi')}
SELECT server_name, priority, findings_group, finding, COUNT(*) AS n, MIN(check_date) AS first_seen,
       MAX(check_date) AS last_seen
FROM xfi WHERE check_date >= TIMESTAMP '2024-01-10 00:00:00' AND check_date < TIMESTAMP '2024-01-20 00:00:00'
  AND priority BETWEEN 10 AND 30 AND server_name IN ('srv1', 'srv3')
GROUP BY ALL""")
def window_report(spark, d):
    f = fx.findings_log(spark, d).filter(
        (F.col("check_date") >= ts_lit("2024-01-10 00:00:00")) & (F.col("check_date") < ts_lit("2024-01-20 00:00:00"))
        & F.col("priority").between(10, 30) & F.col("server_name").isin("srv1", "srv3"))
    return f.groupBy("server_name", "priority", "findings_group", "finding").agg(
        F.count(F.lit(1)).alias("n"), F.min("check_date").alias("first_seen"), F.max("check_date").alias("last_seen"))


@query("topn_per_snapshot", _WD + """,
r AS (SELECT *, row_number() OVER (PARTITION BY server_name, check_date ORDER BY wait_time_ms_delta DESC, wait_type) AS rk
      FROM wd)
SELECT server_name, check_date, wait_type, wait_time_ms_delta,
       CASE WHEN waiting_tasks_count_delta > 0 THEN wait_time_ms_delta / CAST(waiting_tasks_count_delta AS DOUBLE) END
         AS avg_ms_per_event, rk
FROM r WHERE rk <= 3""")
def topn_per_snapshot(spark, d):
    t = T.top_n_per(_wd(spark, d), ["server_name", "check_date"], [F.col("wait_time_ms_delta").desc(), "wait_type"], 3)
    return t.select("server_name", "check_date", "wait_type", "wait_time_ms_delta",
                    F.when(F.col("waiting_tasks_count_delta") > 0, F.col("wait_time_ms_delta")
                           / F.col("waiting_tasks_count_delta").cast("double")).alias("avg_ms_per_event"), "rk")


METRICS = {"cpu": "total_worker_time", "reads": "total_logical_reads", "writes": "total_logical_writes",
           "duration": "total_elapsed_time", "executions": "execution_count", "memory_grant": "max_grant_kb",
           "spills": "total_spills"}


@query("multi_metric_topn", f"WITH {ctes('x7')} " + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{m}' AS metric, query_hash, {c} AS metric_value,
        row_number() OVER (ORDER BY {c} DESC, query_hash) AS rk FROM x7) WHERE rk <= 10"""
    for m, c in METRICS.items()))
def multi_metric(spark, d):
    return R.top_by_metrics(fx.query_stats(spark, d), {m: F.col(c) for m, c in METRICS.items()}, 10, ["query_hash"], dtype="bigint")


@query("dual_rank", f"WITH {ctes('x7h')} " + " UNION ALL ".join(
    f"""SELECT '{m}' AS metric, check_date, query_hash, {c} AS metric_value, date_rank, overall_rank FROM (
        SELECT *, row_number() OVER (PARTITION BY check_date ORDER BY {c} DESC, query_hash) AS date_rank,
               row_number() OVER (ORDER BY {c} DESC, query_hash, check_date) AS overall_rank FROM x7h WHERE {c} > 0)
        WHERE overall_rank <= 20""" for m, c in METRICS.items()))
def dual_rank(spark, d):
    """Overall and within-snapshot rank of the logged queries, for each of the seven metrics."""
    return R.dual_rank(fx.query_history(spark, d), {m: F.col(c) for m, c in METRICS.items()}, 20, "check_date", ["query_hash"]).select(
        "metric", "check_date", "query_hash", "metric_value", "date_rank", "overall_rank")
