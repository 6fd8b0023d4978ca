"""Queries for aggregations and the aggregate-shaped joins J13, J15, J16."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from opslake.functions.scalar import dirname
from opslake.functions.semantics import cents, ts_lit
from opslake.operators import aggregate as A
from opslake.operators import joins as J
from opslake.operators.backups import KEY as BACKUP_KEY
from opslake.plans.oracle_fixtures import ctes, sql_human, sql_round_div
from opslake.plans.q_joins import STATES_SQL
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table


def _per_row(c):
    return f"CASE WHEN table_rows > 0 THEN ({c} * 2 + table_rows) // (table_rows * 2) END"


@query("human_bytes", f"""WITH {ctes('cat')}
SELECT table_schema, table_name, table_rows,
       {sql_human('data_length')} AS data_text, {_per_row('data_length')} AS data_per_row,
       {sql_human('index_length')} AS idx_text, {_per_row('index_length')} AS idx_per_row,
       {sql_human('(data_length + index_length + data_free)')} AS total_size,
       {sql_human('data_free', 2)} AS data_free_text
FROM cat""")
def human_bytes(spark, d):
    return A.table_sizes(fx.catalog_tables(spark, d))


@query("schema_size", f"""WITH {ctes('cat')},
g AS (SELECT table_schema, CAST(SUM(data_length + index_length + data_free) AS BIGINT) AS t,
             CAST(SUM(data_length) AS BIGINT) AS data_length, CAST(SUM(index_length) AS BIGINT) AS index_length,
             CAST(SUM(data_free) AS BIGINT) AS data_free FROM cat GROUP BY table_schema)
SELECT table_schema, {sql_human('t', 1, ' ')} AS total_size, data_length, index_length, data_free FROM g""")
def schema_size(spark, d):
    return A.schema_sizes(fx.catalog_tables(spark, d))


def _mb(x):
    return sql_round_div(f"({x}) * 8", "1024", 2)


@query("table_pages_mb", f"""WITH {ctes('x5')}
SELECT database_name, table_name,
       CAST(SUM(CASE WHEN index_type IN ('HEAP', 'CLUSTERED') THEN row_count ELSE 0 END) AS BIGINT) AS row_count,
       {_mb('SUM(total_pages)')} AS total_mb, {_mb('SUM(used_pages)')} AS used_mb,
       {_mb('SUM(total_pages) - SUM(used_pages)')} AS unused_mb
FROM x5 GROUP BY database_name, table_name""")
def table_pages(spark, d):
    x5 = fx.index_inventory(spark, d)
    g = x5.groupBy("database_name", "table_name").agg(
        F.sum(F.when(F.col("index_type").isin("HEAP", "CLUSTERED"), F.col("row_count")).otherwise(0)).alias("row_count"),
        F.sum("total_pages").alias("tp"), F.sum("used_pages").alias("up"))
    return g.select("database_name", "table_name", "row_count", A.pages_mb("tp").alias("total_mb"),
                    A.pages_mb("up").alias("used_mb"), A.pages_mb(F.col("tp") - F.col("up")).alias("unused_mb"))


@query("index_pages_mb", f"""WITH {ctes('x5')}
SELECT database_name, table_name, index_id, index_name, {_mb('total_pages')} AS total_mb, {_mb('used_pages')} AS used_mb
FROM x5 ORDER BY total_pages DESC, index_id LIMIT 100""")
def index_pages(spark, d):
    x5 = fx.index_inventory(spark, d)
    top = x5.orderBy(F.col("total_pages").desc(), "index_id").limit(100)
    return top.select("database_name", "table_name", "index_id", "index_name",
                      A.pages_mb("total_pages").alias("total_mb"), A.pages_mb("used_pages").alias("used_mb"))


@query("db_file_sizes", f"""WITH {ctes('dbf')}
SELECT database_name, {_mb("SUM(CASE WHEN type_desc = 'ROWS' THEN size_pages ELSE 0 END)")} AS data_mb,
       {_mb("SUM(CASE WHEN type_desc = 'LOG' THEN size_pages ELSE 0 END)")} AS log_mb,
       {_mb('SUM(size_pages)')} AS total_mb
FROM dbf GROUP BY database_name""")
def db_file_sizes(spark, d):
    g = A.conditional_sums(fx.database_files(spark, d), ["database_name"], "type_desc",
                           {"data": "ROWS", "log": "LOG"}, "size_pages")
    return g.select("database_name", A.pages_mb("data").alias("data_mb"), A.pages_mb("log").alias("log_mb"),
                    A.pages_mb("total").alias("total_mb"))


@query("db_file_total", f"""WITH {ctes('dbf')}
SELECT {_mb("SUM(CASE WHEN type_desc = 'ROWS' THEN size_pages ELSE 0 END)")} AS data_mb,
       {_mb("SUM(CASE WHEN type_desc = 'LOG' THEN size_pages ELSE 0 END)")} AS log_mb,
       {_mb('SUM(size_pages)')} AS total_mb, COUNT(DISTINCT database_name) AS databases FROM dbf""")
def db_file_total(spark, d):
    f = fx.database_files(spark, d)
    g = f.agg(F.sum(F.when(F.col("type_desc") == "ROWS", F.col("size_pages")).otherwise(0)).alias("data"),
              F.sum(F.when(F.col("type_desc") == "LOG", F.col("size_pages")).otherwise(0)).alias("log"),
              F.sum("size_pages").alias("total"), F.countDistinct("database_name").alias("databases"))
    return g.select(A.pages_mb("data").alias("data_mb"), A.pages_mb("log").alias("log_mb"),
                    A.pages_mb("total").alias("total_mb"), "databases")


@query("thread_usage_pct", f"""WITH {ctes('x4')}
SELECT "user", COUNT(*) AS threads, {sql_round_div('COUNT(*) * 100', '(SELECT COUNT(*) FROM x4)', 2)} AS pct
FROM x4 GROUP BY "user\"""")
def thread_usage(spark, d):
    pl = fx.processlist(spark, d)
    n = pl.select(F.count(F.lit(1))).scalar()
    return pl.groupBy("user").agg(F.count(F.lit(1)).alias("threads")) \
             .withColumn("pct", A.share_pct("threads", n))


def _lag_status(spark, d):
    pl = (fx.processlist(spark, d).filter((F.col("user") == "system user") | (F.col("command") == "Binlog Dump"))
          .select("id", "user", "command", "state", "time", "db"))
    j = J.prefix_join(pl, "state", J.known_states(spark).withColumnRenamed("state", "known_state"), "known_state")
    sysu = F.col("user") == "system user"
    io = F.coalesce(sysu & (F.col("state_type") == "replication_io_thread"), F.lit(False))
    sq = F.coalesce(sysu & (F.col("state_type") == "replication_sql_thread"), F.lit(False))
    applier = sq | (sysu & ~io)
    return j.groupBy("db").agg(
        F.sum(F.when(io, F.col("time"))).alias("slave_connected_time"),
        (F.coalesce(F.sum(io.cast("int")), F.lit(0)) > 0).alias("slave_io_running"),
        (F.coalesce(F.sum(applier.cast("int")), F.lit(0)) > 0).alias("slave_sql_running"),
        F.coalesce(F.sum(sysu.cast("int")) == 2, F.lit(False)).alias("slave_running"),
        F.sum(F.when(applier, F.col("time"))).alias("seconds_behind_master"))


_LAG_SQL = f"""WITH {ctes('x4')},
j AS (SELECT p.*, ks.state_type, p."user" = 'system user' AS sysu FROM x4 p
      LEFT JOIN {STATES_SQL} ON ks.state LIKE p.state || '%'
      WHERE p."user" = 'system user' OR p.command = 'Binlog Dump'),
f AS (SELECT *, coalesce(sysu AND state_type = 'replication_io_thread', false) AS io,
             coalesce(sysu AND state_type = 'replication_sql_thread', false) AS sq FROM j),
s AS (SELECT db, CAST(SUM(CASE WHEN io THEN "time" END) AS BIGINT) AS slave_connected_time,
             coalesce(SUM(CAST(io AS INTEGER)), 0) > 0 AS slave_io_running,
             coalesce(SUM(CAST(sq OR (sysu AND NOT io) AS INTEGER)), 0) > 0 AS slave_sql_running,
             coalesce(SUM(CAST(sysu AS INTEGER)) = 2, false) AS slave_running,
             CAST(SUM(CASE WHEN sq OR (sysu AND NOT io) THEN "time" END) AS BIGINT) AS seconds_behind_master
      FROM f GROUP BY db)"""


@query("replica_lag_status", _LAG_SQL + " SELECT * FROM s")
def replica_lag_status(spark, d):
    return _lag_status(spark, d)


@query("replica_lag_alert", _LAG_SQL + """
SELECT db, coalesce(seconds_behind_master, 0) AS lag_seconds FROM s WHERE coalesce(seconds_behind_master, 0) > 90""")
def replica_lag_alert(spark, d):
    s = _lag_status(spark, d).select("db", F.coalesce("seconds_behind_master", F.lit(0)).alias("lag_seconds"))
    return s.filter(F.col("lag_seconds") > 90)


@query("finding_counts", f"""WITH {ctes('xfi')}
SELECT priority, findings_group, finding, COUNT(*) AS n, MIN(check_date) AS first_seen, MAX(check_date) AS last_seen
FROM xfi GROUP BY ALL""")
def finding_counts(spark, d):
    return fx.findings_log(spark, d).groupBy("priority", "findings_group", "finding").agg(
        F.count(F.lit(1)).alias("n"), F.min("check_date").alias("first_seen"), F.max("check_date").alias("last_seen"))


def _bk_measures(df):
    dur = F.timestamp_diff("MILLISECOND", F.col("backup_start_date"), F.col("backup_finish_date"))
    return df.select(*BACKUP_KEY, "type",
                     F.call_function("div", F.col("backup_size"), F.lit(1048576)).alias("mb"),
                     F.when(dur > 0, F.call_function("div", F.call_function(
                         "div", F.col("backup_size"), F.lit(1024)) * 1000, dur)).alias("kbps"))


BK = "server_name, database_guid, database_name"      # a database of one server
_BK = f"""WITH {ctes('x3')},
m AS (SELECT {BK}, type, backup_size // 1048576 AS mb,
             CASE WHEN date_diff('millisecond', backup_start_date, backup_finish_date) > 0
                  THEN (backup_size // 1024) * 1000 // date_diff('millisecond', backup_start_date, backup_finish_date)
             END AS kbps FROM x3)"""
_TYPES = {"full": "D", "diff": "I", "log": "L"}


@query("backup_throughput", _BK + f" SELECT {BK}, " + ", ".join(
    f"avg(CASE WHEN type = '{t}' THEN {m} END) AS {n}_avg_{m}, "
    f"max(CASE WHEN type = '{t}' THEN {m} END) AS {n}_max_{m}, "
    f"min(CASE WHEN type = '{t}' THEN {m} END) AS {n}_min_{m}"
    for n, t in _TYPES.items() for m in ("mb", "kbps")) + f" FROM m GROUP BY {BK}")
def backup_throughput(spark, d):
    m = _bk_measures(fx.backups(spark, d))
    aggs = []
    for n, t in _TYPES.items():
        for c in ("mb", "kbps"):
            v = F.when(F.col("type") == t, F.col(c))
            aggs += [F.avg(v).alias(f"{n}_avg_{c}"), F.max(v).alias(f"{n}_max_{c}"), F.min(v).alias(f"{n}_min_{c}")]
    return m.groupBy(*BACKUP_KEY).agg(*aggs)


@query("backup_avg_by_type", _BK + f" SELECT {BK}, " + ", ".join(
    f"avg(CASE WHEN type = '{t}' THEN mb END) AS avg_{n}_mb" for n, t in _TYPES.items()) +
    f" FROM m GROUP BY {BK}")
def backup_avg_by_type(spark, d):
    m = _bk_measures(fx.backups(spark, d))
    return m.groupBy(*BACKUP_KEY).agg(
        *[F.avg(F.when(F.col("type") == t, F.col("mb"))).alias(f"avg_{n}_mb") for n, t in _TYPES.items()])


@query("duplicate_keys", f"""WITH {ctes('x5')}
SELECT database_name, schema_name, table_name, key_columns, COUNT(*) AS dup_count,
       string_agg(CAST(index_id AS VARCHAR), ', ' ORDER BY index_id) AS index_ids
FROM x5 WHERE NOT is_primary_key AND NOT is_disabled AND index_type IN ('CLUSTERED', 'NONCLUSTERED')
  AND total_pages * 8 >= 250 * 1024
GROUP BY database_name, schema_name, table_name, key_columns HAVING COUNT(*) > 1""")
def duplicate_keys(spark, d):
    x5 = fx.index_inventory(spark, d).filter(
        ~F.col("is_primary_key") & ~F.col("is_disabled") & F.col("index_type").isin("CLUSTERED", "NONCLUSTERED")
        & (F.col("total_pages") * 8 >= 250 * 1024))
    keys = ["database_name", "schema_name", "table_name", "key_columns"]
    # counted first: only the ids of duplicates are put into lists
    dup = x5.groupBy(*keys).agg(F.count(F.lit(1)).alias("dup_count")).filter(F.col("dup_count") > 1)
    g = x5.join(dup, keys).groupBy(*keys, "dup_count").agg(F.array_sort(F.collect_list("index_id")).alias("ids"))
    return g.select(
        *keys, "dup_count",
        F.array_join(F.transform("ids", lambda x: x.cast("string")), ", ").alias("index_ids"))


@query("distinct_change_count", f"""WITH {ctes('x3')}
SELECT {BK}, COUNT(DISTINCT compatibility_level) AS levels,
       COUNT(DISTINCT CASE WHEN recovery_model <> 'BULK-LOGGED' THEN recovery_model END) AS models
FROM x3 GROUP BY {BK} HAVING COUNT(DISTINCT compatibility_level) > 2""")
def distinct_change(spark, d):
    b = fx.backups(spark, d)
    g = b.groupBy(*BACKUP_KEY).agg(
        F.countDistinct("compatibility_level").alias("levels"),
        F.countDistinct(F.when(F.col("recovery_model") != "BULK-LOGGED", F.col("recovery_model"))).alias("models"))
    return g.filter(F.col("levels") > 2)


@query("out_of_band_actors", f"""WITH {ctes('x3')},
c AS (SELECT {BK}, user_name, COUNT(*) AS n FROM x3 GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY {BK} ORDER BY n DESC, user_name) AS rk FROM c)
SELECT {BK}, o.user_name, o.n, m.user_name AS majority_user_name
FROM r o JOIN (SELECT {BK}, user_name FROM r WHERE rk = 1) m USING ({BK})
WHERE o.rk > 1 AND o.n >= 2 AND o.user_name NOT IN ('svc_agent')""")
def out_of_band(spark, d):
    return A.majority_and_others(fx.backups(spark, d), BACKUP_KEY, "user_name", exclude=["svc_agent"])


@query("monthly_pivot", """
WITH m AS (SELECT o_orderpriority,
                  date_diff('month', date_trunc('month', o_orderdate), date_trunc('month', TIMESTAMP '2001-08-02')) AS ago,
                  CAST(round(o_totalprice * 100) AS BIGINT) AS v FROM orders)
SELECT o_orderpriority, """ + ", ".join(
    f"CAST(SUM(CASE WHEN ago = {i} THEN v ELSE 0 END) AS BIGINT) AS m{i}" for i in range(13)) +
    " FROM m WHERE ago BETWEEN 0 AND 12 GROUP BY o_orderpriority")
def monthly_pivot(spark, d):
    o = table(spark, d, "orders").withColumn("v", cents("o_totalprice"))
    return A.months_ago_pivot(o, "o_orderpriority", "o_orderdate", fx.AS_OF_AUDIT, "v")


_AS = fx.AS_OF_EVENTS


@query("age_share", f"""WITH {ctes('xpc')},
a AS (SELECT COUNT(*) AS total_plans,
             COUNT(*) FILTER (WHERE creation_time >= TIMESTAMP '{_AS}' - INTERVAL 24 HOUR) AS plans_24h,
             COUNT(*) FILTER (WHERE creation_time >= TIMESTAMP '{_AS}' - INTERVAL 4 HOUR) AS plans_4h,
             COUNT(*) FILTER (WHERE creation_time >= TIMESTAMP '{_AS}' - INTERVAL 1 HOUR) AS plans_1h FROM xpc)
SELECT *, {sql_round_div('plans_24h * 100', 'total_plans', 2)} AS pct_24h,
       {sql_round_div('plans_4h * 100', 'total_plans', 2)} AS pct_4h,
       {sql_round_div('plans_1h * 100', 'total_plans', 2)} AS pct_1h FROM a""")
def age_share(spark, d):
    pc = fx.plan_cache(spark, d)
    end = ts_lit(_AS)
    within = lambda h: F.count(F.when(F.col("creation_time") >= F.timestamp_add("HOUR", F.lit(-h), end), 1))  # noqa
    a = pc.agg(F.count(F.lit(1)).alias("total_plans"), within(24).alias("plans_24h"),
               within(4).alias("plans_4h"), within(1).alias("plans_1h"))
    return a.select("*", *[A.share_pct(f"plans_{h}", "total_plans").alias(f"pct_{h}") for h in ("24h", "4h", "1h")])


@query("single_use_share", f"""WITH {ctes('xpc')},
h AS (SELECT query_hash, COUNT(*) AS plans, SUM(CASE WHEN execution_count = 1 THEN 1 ELSE 0 END) AS single
      FROM xpc GROUP BY query_hash),
a AS (SELECT CAST(SUM(plans) AS BIGINT) AS total_plans, CAST(SUM(single) AS BIGINT) AS single_use_plans,
             CAST(SUM(CASE WHEN plans > 1 THEN plans ELSE 0 END) AS BIGINT) AS duplicate_plans,
             COUNT(*) AS query_hashes FROM h)
SELECT *, {sql_round_div('single_use_plans * 100', 'total_plans', 2)} AS single_use_pct,
       {sql_round_div('duplicate_plans * 100', 'total_plans', 2)} AS duplicate_pct FROM a""")
def single_use(spark, d):
    h = fx.plan_cache(spark, d).groupBy("query_hash").agg(
        F.count(F.lit(1)).alias("plans"), F.sum(F.when(F.col("execution_count") == 1, 1).otherwise(0)).alias("single"))
    a = h.agg(F.sum("plans").alias("total_plans"), F.sum("single").alias("single_use_plans"),
              F.sum(F.when(F.col("plans") > 1, F.col("plans")).otherwise(0)).alias("duplicate_plans"),
              F.count(F.lit(1)).alias("query_hashes"))
    return a.select("*", A.share_pct("single_use_plans", "total_plans").alias("single_use_pct"),
                    A.share_pct("duplicate_plans", "total_plans").alias("duplicate_pct"))


@query("daily_intervals", """
WITH i AS (SELECT date_trunc('hour', ts) AS interval_start, event_type AS plan, COUNT(*) AS executions,
                  SUM(CAST(round(value * 100) AS BIGINT)) AS total_duration FROM events GROUP BY 1, 2)
SELECT date_trunc('day', interval_start) AS day, plan, MIN(interval_start) AS first_interval,
       MAX(interval_start) + INTERVAL 1 HOUR AS last_interval_end, CAST(SUM(executions) AS BIGINT) AS executions,
       SUM(total_duration) / SUM(executions) AS avg_duration
FROM i GROUP BY 1, 2""")
def daily_intervals(spark, d):
    ev = table(spark, d, "events")
    i = ev.groupBy(F.date_trunc("hour", "ts").alias("interval_start"), F.col("event_type").alias("plan")).agg(
        F.count(F.lit(1)).alias("executions"), F.sum(cents("value")).alias("total_duration"))
    return i.groupBy(F.date_trunc("day", "interval_start").alias("day"), "plan").agg(
        F.min("interval_start").alias("first_interval"),
        F.timestamp_add("HOUR", F.lit(1), F.max("interval_start")).alias("last_interval_end"),
        F.sum("executions").alias("executions"),
        (F.sum("total_duration") / F.sum("executions")).alias("avg_duration"))


@query("string_agg_patterns", f"""WITH {ctes('x5')}
SELECT database_name, table_name, string_agg(DISTINCT first_key_column, ', ' ORDER BY first_key_column)
       AS first_key_column_list FROM x5 GROUP BY ALL""")
def string_agg(spark, d):
    return A.distinct_text(fx.index_inventory(spark, d), ["database_name", "table_name"], "first_key_column")


@query("top3_concat", f"""WITH {ctes('x1w')},
m AS (SELECT server_name, wait_type, MAX(wait_time_ms) AS wait_ms FROM x1w GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY server_name ORDER BY wait_ms DESC, wait_type) AS rk FROM m)
SELECT server_name, string_agg(wait_type, ', ' ORDER BY rk) AS top_wait_type FROM r WHERE rk <= 3 GROUP BY ALL""")
def top3(spark, d):
    m = fx.wait_snapshots(spark, d).groupBy("server_name", "wait_type").agg(F.max("wait_time_ms").alias("wait_ms"))
    return A.top_n_text(m, ["server_name"], "wait_type", "wait_ms", 3)


@query("path_rollup_breach", f"""WITH {ctes('x1f')},
f AS (SELECT physical_name, MAX(num_of_reads) AS reads, MAX(io_stall_read_ms) AS stall FROM x1f GROUP BY ALL),
g AS (SELECT regexp_extract(physical_name, '^(.*[\\\\/])', 1) AS directory, COUNT(*) AS files,
             CAST(SUM(reads) AS BIGINT) AS reads, CAST(SUM(stall) AS BIGINT) AS stall FROM f GROUP BY 1)
SELECT *, stall // reads AS avg_stall_ms, stall // reads >= 5000 AS latency_breach FROM g""")
def path_rollup(spark, d):
    f = fx.file_snapshots(spark, d).groupBy("physical_name").agg(
        F.max("num_of_reads").alias("reads"), F.max("io_stall_read_ms").alias("stall"))
    g = f.groupBy(dirname("physical_name").alias("directory")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("reads").alias("reads"), F.sum("stall").alias("stall"))
    avg = F.call_function("div", F.col("stall"), F.col("reads"))
    return g.select("*", avg.alias("avg_stall_ms"), (avg >= 5000).alias("latency_breach"))


@query("unused_share", f"""WITH {ctes('x5')},
g AS (SELECT database_name, table_name, COUNT(*) AS nonclustered,
             SUM(CASE WHEN user_seeks + user_scans + user_lookups = 0 THEN 1 ELSE 0 END) AS unused
      FROM x5 WHERE index_type = 'NONCLUSTERED' GROUP BY ALL)
SELECT database_name, table_name, nonclustered, CAST(unused AS BIGINT) AS unused,
       {sql_round_div('unused * 100', 'nonclustered', 2)} AS unused_pct
FROM g WHERE unused * 100 >= 5 * nonclustered""")
def unused_share(spark, d):
    x5 = fx.index_inventory(spark, d).filter(F.col("index_type") == "NONCLUSTERED")
    unused = (F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")) == 0
    g = x5.groupBy("database_name", "table_name").agg(
        F.count(F.lit(1)).alias("nonclustered"), F.sum(F.when(unused, 1).otherwise(0)).alias("unused"))
    return (g.filter(F.col("unused") * 100 >= 5 * F.col("nonclustered"))
            .withColumn("unused_pct", A.share_pct("unused", "nonclustered")))


@query("row_count_gate", """
WITH c AS (SELECT 'orders' AS table_name, COUNT(*) AS row_count FROM orders
           UNION ALL SELECT 'customer', COUNT(*) FROM customer)
SELECT *, (SELECT MIN(row_count) FROM c) > 0 AS proceed FROM c""")
def row_count_gate(spark, d):
    c = (table(spark, d, "orders").agg(F.count(F.lit(1)).alias("row_count")).withColumn("table_name", F.lit("orders"))
         .unionByName(table(spark, d, "customer").agg(F.count(F.lit(1)).alias("row_count"))
                      .withColumn("table_name", F.lit("customer"))))
    return c.select("table_name", "row_count", (c.select(F.min("row_count")).scalar() > 0).alias("proceed"))


@query("lateral_topn", """
WITH r AS (SELECT date_trunc('month', o_orderdate) AS month, o_orderkey, CAST(round(o_totalprice * 100) AS BIGINT) AS price,
                  row_number() OVER (PARTITION BY date_trunc('month', o_orderdate)
                                     ORDER BY CAST(round(o_totalprice * 100) AS BIGINT) DESC, o_orderkey) AS rk
           FROM orders)
SELECT * FROM r WHERE rk <= 5""")
def lateral_topn(spark, d):
    o = table(spark, d, "orders").select(F.date_trunc("month", "o_orderdate").alias("month"), "o_orderkey",
                                          cents("o_totalprice").alias("price"))
    w = Window.partitionBy("month").orderBy(F.col("price").desc(), "o_orderkey")
    return o.withColumn("rk", F.row_number().over(w).cast("bigint")).filter("rk <= 5")


@query("percent_of_total", f"""WITH {ctes('x7')}
SELECT query_hash, total_worker_time,
       total_worker_time * CAST(100 AS DOUBLE) / (SELECT SUM(total_worker_time) FROM x7) AS pct_cpu,
       total_logical_reads * CAST(100 AS DOUBLE) / (SELECT SUM(total_logical_reads) FROM x7) AS pct_reads
FROM x7""")
def percent_of_total(spark, d):
    x7 = fx.query_stats(spark, d)
    return x7.select("query_hash", "total_worker_time",
                     (F.col("total_worker_time") * F.lit(100.0) / A.total(x7, "total_worker_time")).alias("pct_cpu"),
                     (F.col("total_logical_reads") * F.lit(100.0) / A.total(x7, "total_logical_reads")).alias("pct_reads"))
