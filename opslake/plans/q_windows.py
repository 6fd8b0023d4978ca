"""Queries for windows, sorts and top-k and the interval join J12."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opslake.functions.semantics import cents
from opslake.operators import ranking as R
from opslake.operators import timeseries as TS
from opslake.operators.backups import KEY as BACKUP_KEY
from opslake.plans.oracle_fixtures import ctes, sql_round_div
from opslake.plans.q_aggregates import A
from opslake.plans.q_snapshots import _WD, _wd
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

GREEDY = {"cpu": "total_worker_time", "reads": "total_logical_reads", "duration": "total_elapsed_time",
          "executions": "execution_count", "writes": "total_logical_writes"}


def _greedy_sql(n=10):
    parts, taken = [], []
    for i, (m, c) in enumerate(GREEDY.items()):
        excl = " AND ".join(f"query_hash NOT IN (SELECT query_hash FROM g{j})" for j in range(i)) or "TRUE"
        parts.append(f"""g{i} AS (SELECT '{m}' AS metric, query_hash, CAST({c} AS DOUBLE) AS metric_value,
            row_number() OVER (ORDER BY {c} DESC, query_hash) AS rk FROM x7 WHERE {excl}
            QUALIFY rk <= {n})""")
    return f"WITH {ctes('x7')}, " + ", ".join(parts) + " " + " UNION ALL ".join(
        f"SELECT * FROM g{i}" for i in range(len(GREEDY)))


@query("greedy_topn", _greedy_sql())
def greedy(spark, d):
    return R.greedy_top_n(fx.query_stats(spark, d), {m: F.col(c) for m, c in GREEDY.items()}, 10)


@query("rank_by_total", f"""WITH {ctes('x7')}
SELECT *, CAST(total_logical_reads AS DOUBLE) AS sort_value,
       row_number() OVER (ORDER BY total_logical_reads DESC, query_hash) AS rk FROM x7 QUALIFY rk <= 20""")
def rank_total(spark, d):
    return R.rank_by(fx.query_stats(spark, d), "reads", 20)


@query("rank_by_avg", f"""WITH {ctes('x7')}
SELECT *, total_worker_time / execution_count AS sort_value,
       row_number() OVER (ORDER BY total_worker_time / execution_count DESC, query_hash) AS rk FROM x7 QUALIFY rk <= 20""")
def rank_avg(spark, d):
    return R.rank_by(fx.query_stats(spark, d), "avg cpu", 20)


@query("rank_by_xpm", f"""WITH {ctes('x7')}
SELECT *, execution_count / greatest(date_diff('minute', creation_time, last_execution_time), 1) AS sort_value,
       row_number() OVER (ORDER BY execution_count / greatest(date_diff('minute', creation_time, last_execution_time), 1)
                          DESC, query_hash) AS rk FROM x7 QUALIFY rk <= 20""")
def rank_xpm(spark, d):
    return R.rank_by(fx.query_stats(spark, d), "xpm", 20)


_ALIVE = "greatest(date_diff('minute', creation_time, last_execution_time), 1)"
_CACHED = f"""CASE WHEN execution_count > 1 THEN CASE
    WHEN date_diff('minute', creation_time, TIMESTAMP '{fx.AS_OF_EVENTS}') > 0
      THEN execution_count / date_diff('minute', creation_time, TIMESTAMP '{fx.AS_OF_EVENTS}')
    WHEN date_diff('minute', creation_time, last_execution_time) > 0
      THEN execution_count / date_diff('minute', creation_time, last_execution_time) ELSE 0 END ELSE 0 END"""
_SORTS = {"cpu": "total_worker_time", "reads": "total_logical_reads", "writes": "total_logical_writes",
          "duration": "total_elapsed_time", "spills": "total_spills", "rows": "total_rows", "memory grant": "max_grant_kb",
          "avg cpu": "total_worker_time / execution_count", "avg reads": "total_logical_reads / execution_count",
          "avg writes": "total_logical_writes / execution_count", "avg duration": "total_elapsed_time / execution_count",
          "avg spills": "total_spills / execution_count", "avg rows": "total_rows / execution_count",
          "avg memory grant": "max_grant_kb / execution_count", "executions": "execution_count", "avg executions": _CACHED,
          "xpm": f"execution_count / {_ALIVE}", "unused grant": "max_grant_kb - max_used_grant_kb",
          "compiles": "epoch(creation_time)", "recent compilations": "epoch(creation_time)",
          "duplicate": "CASE WHEN plan_count > 1 THEN total_worker_time END"}


@query("rank_by_all", f"WITH {ctes('x7')} " + " UNION ALL ".join(
    f"""SELECT * FROM (SELECT '{m}' AS sort_name, query_hash, CAST({c} AS DOUBLE) AS sort_value,
        row_number() OVER (ORDER BY CAST({c} AS DOUBLE) DESC NULLS LAST, query_hash) AS rk FROM x7) WHERE rk <= 10"""
    for m, c in _SORTS.items()))
def rank_all(spark, d):
    """Every sort name's top ten in one pass."""
    return R.top_by_metrics(fx.query_stats(spark, d), R.sort_keys(fx.AS_OF_EVENTS), 10, ["query_hash"], name="sort_name", value="sort_value")


PTS = {"cpu": "total_worker_time", "reads": "total_logical_reads", "writes": "total_logical_writes",
       "duration": "total_elapsed_time"}


@query("points_topn", f"WITH {ctes('x7')}, t AS (" + " UNION ALL ".join(
    f"(SELECT query_hash, '{m}' AS metric FROM x7 ORDER BY {c} DESC, query_hash LIMIT 10)" for m, c in PTS.items()) +
    ") SELECT query_hash, COUNT(*) AS points, string_agg(metric, ',' ORDER BY metric) AS metrics FROM t GROUP BY 1")
def points(spark, d):
    return R.points(fx.query_stats(spark, d), {m: F.col(c) for m, c in PTS.items()})


@query("dedupe_best", f"""WITH {ctes('xpc')}
SELECT * EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY query_hash
                                 ORDER BY total_worker_time DESC, plan_handle DESC) AS rk FROM xpc) WHERE rk = 1""")
def dedupe_best(spark, d):
    pc = fx.plan_cache(spark, d)
    return R.best_per_key(pc, ["query_hash"], ["total_worker_time", "plan_handle"]).select(*pc.columns)


@query("latest_per_session", f"""WITH {ctes('x4')}
SELECT x4.* FROM x4 JOIN (SELECT "user", host, MAX(id) AS id FROM x4 GROUP BY ALL) m USING ("user", host, id)""")
def latest_per_session(spark, d):
    pl = fx.processlist(spark, d)
    return R.best_per_key(pl, ["user", "host"], ["id"]).select(*pl.columns)


@query("wait_share_top", f"""WITH {ctes('x1w')},
l AS (SELECT server_name, wait_type, arg_max(wait_time_ms, check_date) AS wait_ms,
             arg_max(signal_wait_time_ms, check_date) AS signal_ms, arg_max(waiting_tasks_count, check_date) AS tasks
      FROM x1w GROUP BY ALL)
SELECT server_name, wait_type, wait_ms, wait_ms * CAST(100 AS DOUBLE) / (SELECT SUM(wait_ms) FROM l) AS pct,
       {sql_round_div('signal_ms * 100', 'wait_ms', 2)} AS signal_pct,
       CASE WHEN tasks > 0 THEN wait_ms / CAST(tasks AS DOUBLE) END AS avg_ms_per_wait
FROM l ORDER BY wait_ms DESC, server_name, wait_type LIMIT 9""")
def wait_share(spark, d):
    w = fx.wait_snapshots(spark, d)
    last = w.groupBy("server_name", "wait_type").agg(
        F.max_by(F.struct("wait_time_ms", "signal_wait_time_ms", "waiting_tasks_count"), "check_date").alias("x"))
    l_ = last.select("server_name", "wait_type", F.col("x.wait_time_ms").alias("wait_ms"),
                     F.col("x.signal_wait_time_ms").alias("signal_ms"), F.col("x.waiting_tasks_count").alias("tasks"))
    tot = A.total(l_, "wait_ms")
    out = l_.select("server_name", "wait_type", "wait_ms", (F.col("wait_ms") * F.lit(100.0) / tot).alias("pct"),
                    A.share_pct("signal_ms", "wait_ms").alias("signal_pct"),
                    F.when(F.col("tasks") > 0, F.col("wait_ms") / F.col("tasks").cast("double")).alias("avg_ms_per_wait"))
    return out.orderBy(F.col("wait_ms").desc(), "server_name", "wait_type").limit(9)


@query("ntile_middle_avg", _WD + """
SELECT server_name, AVG(wait_time_ms_delta) AS middle_avg_ms, COUNT(*) AS middle_rows FROM (
  SELECT *, ntile(3) OVER (PARTITION BY server_name ORDER BY wait_time_ms_delta, check_date, wait_type) AS tile FROM wd)
WHERE tile = 2 GROUP BY server_name""")
def ntile_mid(spark, d):
    wd = _wd(spark, d)
    # ntile per server without a per-server task
    t = TS.ntile(wd, ["server_name"], ["wait_time_ms_delta", "check_date", "wait_type"], None, 3).filter("tile = 2")
    return t.groupBy("server_name").agg(F.avg("wait_time_ms_delta").alias("middle_avg_ms"),
                                        F.count(F.lit(1)).alias("middle_rows"))


@query("full_frame_totals", """
SELECT l_orderkey, l_linenumber, l_linestatus, l_partkey, l_quantity,
       COUNT(*) OVER w AS total_rows, CAST(SUM(CASE WHEN l_quantity > 25 THEN 1 ELSE 0 END) OVER w AS BIGINT) AS workers
FROM lineitem WINDOW w AS (PARTITION BY l_orderkey, l_linestatus ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)""")
def full_frame(spark, d):
    li = table(spark, d, "lineitem")
    w = (Window.partitionBy("l_orderkey", "l_linestatus")
         .rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return li.select("l_orderkey", "l_linenumber", "l_linestatus", "l_partkey", "l_quantity",
                     F.count(F.lit(1)).over(w).alias("total_rows"),
                     F.sum(F.when(F.col("l_quantity") > 25, 1).otherwise(0)).over(w).cast("bigint").alias("workers"))


@query("first_last_over", f"""WITH {ctes('x4')}
SELECT id, info, MIN(sample_time) OVER (PARTITION BY info) AS first_seen, MAX(sample_time) OVER (PARTITION BY info) AS last_seen
FROM x4 WHERE info IS NOT NULL""")
def first_last(spark, d):
    pl = fx.processlist(spark, d).filter(F.col("info").isNotNull()).select("id", "info", "sample_time")
    return R.group_stats_join(pl, ["info"], [F.min("sample_time").alias("first_seen"),
                                             F.max("sample_time").alias("last_seen")]).drop("sample_time")


@query("islands", f"""WITH {ctes('x5')},
n AS (SELECT database_name, table_name, index_id, index_type,
             row_number() OVER (PARTITION BY database_name, table_name ORDER BY index_id)
             - row_number() OVER (PARTITION BY database_name, table_name, index_type ORDER BY index_id) AS grp FROM x5)
SELECT database_name, table_name, index_type, MIN(index_id) AS first_id, MAX(index_id) AS last_id, COUNT(*) AS members
FROM n GROUP BY database_name, table_name, index_type, grp""")
def islands(spark, d):
    x5 = fx.index_inventory(spark, d)
    n = TS.row_number(x5.select("database_name", "table_name", "index_type", "index_id"), ["database_name", "table_name"], ["index_id"], out="rn")
    n = TS.row_number(n, ["database_name", "table_name", "index_type"], ["index_id"], out="rt").withColumn("grp", F.col("rn") - F.col("rt"))
    return n.groupBy("database_name", "table_name", "index_type", "grp").agg(
        F.min("index_id").alias("first_id"), F.max("index_id").alias("last_id"),
        F.count(F.lit(1)).alias("members")).drop("grp")


@query("plan_cost_sum", """
WITH dd AS (SELECT DISTINCT l_partkey, l_suppkey, CAST(round(l_extendedprice * 100) AS BIGINT) AS cost FROM lineitem)
SELECT *, CAST(SUM(cost) OVER (PARTITION BY l_partkey) AS BIGINT) AS plan_total_cost FROM dd""")
def plan_cost(spark, d):
    dd = table(spark, d, "lineitem").select("l_partkey", "l_suppkey", cents("l_extendedprice").alias("cost")).distinct()
    return R.group_stats_join(dd, ["l_partkey"], [F.sum("cost").alias("plan_total_cost")])


@query("topk_global", """
SELECT doc_id, source, lang, n_chars FROM documents ORDER BY n_chars DESC, doc_id LIMIT 10""")
def topk(spark, d):
    return (table(spark, d, "documents").select("doc_id", "source", "lang", "n_chars")
            .orderBy(F.col("n_chars").desc(), "doc_id").limit(10))


@query("restore_file_rank", f"""WITH {ctes('x3')},
f AS (SELECT server_name, database_guid, database_name, database_name || '_' || type || '_' || strftime(backup_start_date, '%Y%m%d%H%M%S') || '_'
             || p || '.bak' AS file_name
      FROM x3, LATERAL (SELECT unnest(range(1, 2 + backup_set_id % 3)) AS p))
SELECT server_name, database_guid, database_name, file_name,
       dense_rank() OVER (PARTITION BY server_name, database_guid, database_name ORDER BY regexp_extract(file_name, '_(\\d{{14}})_', 1)) AS file_rank
FROM f""")
def restore_rank(spark, d):
    b = fx.backups(spark, d)
    f = b.select(*BACKUP_KEY, "type", "backup_start_date",
                 F.explode(F.sequence(F.lit(1).cast("bigint"), 1 + F.col("backup_set_id") % 3)).alias("p"))
    f = f.select(*BACKUP_KEY, F.concat_ws("_", "database_name", "type",
                                              F.date_format("backup_start_date", "yyyyMMddHHmmss"),
                                              F.concat(F.col("p").cast("string"), F.lit(".bak"))).alias("file_name"))
    stamp = F.regexp_extract("file_name", r"_(\d{14})_", 1)
    f = f.withColumn("__stamp", stamp)
    f = f.withColumn("__stamp", F.col("__stamp").cast("bigint"))
    return TS.dense_rank(f, BACKUP_KEY, "__stamp", out="file_rank").drop("__stamp")


@query("report_group_breaks", f"""WITH {ctes('xfi')},
a AS (SELECT priority, findings_group, finding, COUNT(*) AS n FROM xfi GROUP BY ALL),
r AS (SELECT *, row_number() OVER (ORDER BY priority, findings_group, finding) AS rownum FROM a)
SELECT *, coalesce(lag(priority) OVER (ORDER BY rownum) <> priority, true) AS new_priority,
       coalesce(lag(findings_group) OVER (ORDER BY rownum) <> findings_group
                OR lag(priority) OVER (ORDER BY rownum) <> priority, true) AS new_group,
       coalesce(lead(findings_group) OVER (ORDER BY rownum) <> findings_group
                OR lead(priority) OVER (ORDER BY rownum) <> priority, true) AS last_in_group
FROM r""")
def report_breaks(spark, d):
    a = fx.findings_log(spark, d).groupBy("priority", "findings_group", "finding").agg(F.count(F.lit(1)).alias("n"))
    r = TS.row_number(a, [], ["priority", "findings_group", "finding"], out="rownum")
    # in this order a break is the first or last row of its priority or group: two small aggregates, no look at neighbours
    groups = a.groupBy("priority", "findings_group").agg(F.min("finding").alias("first"), F.max("finding").alias("last"))
    tops = groups.groupBy("priority").agg(F.min("findings_group").alias("top"))
    r = r.join(groups, ["priority", "findings_group"]).join(tops, "priority")
    first = F.col("finding") == F.col("first")
    return r.select("priority", "findings_group", "finding", "n", "rownum", (first & (F.col("findings_group") == F.col("top"))).alias("new_priority"),
                    first.alias("new_group"), (F.col("finding") == F.col("last")).alias("last_in_group"))


@query("worst_interval_topn", """
WITH rs AS (SELECT l_partkey AS query_hash, date_trunc('month', l_shipdate) AS interval_start,
                   MAX(l_shipdate) AS last_execution_time, CAST(SUM(CAST(l_quantity AS BIGINT)) AS BIGINT) AS duration
            FROM lineitem GROUP BY 1, 2),
worst AS (SELECT interval_start, interval_start + INTERVAL 1 MONTH AS interval_end FROM rs GROUP BY 1
          ORDER BY SUM(duration) DESC, interval_start LIMIT 1)
SELECT query_hash, last_execution_time, duration,
       row_number() OVER (ORDER BY duration DESC, query_hash) AS rk
FROM rs WHERE last_execution_time >= (SELECT interval_start FROM worst)
          AND last_execution_time < (SELECT interval_end FROM worst)
QUALIFY rk <= 10""")
def worst_interval(spark, d):
    """Runtime stats per (plan, month); the plans run inside the month with the most total duration."""
    li = table(spark, d, "lineitem")
    rs = li.groupBy(F.col("l_partkey").alias("query_hash"), F.date_trunc("month", "l_shipdate").alias("interval_start")) \
           .agg(F.max("l_shipdate").alias("last_execution_time"),
                F.sum(F.col("l_quantity").cast("bigint")).alias("duration"))
    worst = (rs.groupBy("interval_start").agg(F.sum("duration").alias("total"))
             .orderBy(F.col("total").desc(), "interval_start").limit(1))
    start = worst.select("interval_start").scalar()
    end = worst.select(F.add_months("interval_start", 1).cast("timestamp_ntz")).scalar()
    inside = rs.filter((F.col("last_execution_time") >= start) & (F.col("last_execution_time") < end))
    return R.top_n(inside.select("query_hash", "last_execution_time", "duration"), F.col("duration"), "query_hash", 10)
