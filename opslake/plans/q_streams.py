"""Streaming queries.

Each runs a Structured Streaming job over the file source with
``availableNow`` into a Parquet table and returns that table.  Append mode
emits a window only after the watermark (max event time - delay) passes its
end, so the oracles keep exactly those windows.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.plans.oracle_fixtures import ctes
from opslake.plans.q_snapshots import sql_delta
from opslake.plans.registry import query
from opslake.session import scratch_path
from opslake.sources import fixtures as fx
from opslake.sources.tables import table
from opslake.streaming import snapshot_deltas as SD
from opslake.streaming import streams as ST

DELAY = "1 hour"
_BOUND = "(SELECT MAX(ts) FROM events) - INTERVAL 1 HOUR"


@query("stream_collector", f"""WITH {ctes('x4')}
SELECT "user", info AS query, "time", host, db AS "DB" FROM x4
WHERE info IS NOT NULL AND "time" < 60 AND lower("user") NOT IN ('rdsadmin', 'root')""")
def stream_collector(spark, d):
    s = fx.processlist_from(ST.table_stream(spark, d, "events"))
    return ST.run_available_now(ST.collector(s), "collector")


@query("stream_tumbling_counts", f"""WITH {ctes('xfi')}
SELECT * FROM (SELECT date_trunc('day', check_date) AS window_start,
                      date_trunc('day', check_date) + INTERVAL 1 DAY AS window_end,
                      priority, findings_group, finding, COUNT(*) AS n FROM xfi GROUP BY ALL)
WHERE window_end <= {_BOUND}""")
def stream_tumbling(spark, d):
    s = fx.findings_from(ST.table_stream(spark, d, "events"))
    return ST.run_available_now(ST.tumbling_counts(s, "check_date", ["priority", "findings_group", "finding"],
                                                   "1 day", DELAY), "tumbling")


@query("stream_sliding_breach", f"""
WITH e AS (SELECT 'srv' || (user_id % 5) AS server_name, ts, value > 250 AS breach,
                  date_trunc('minute', ts) - to_minutes(CAST(minute(ts) % 5 AS BIGINT)) AS b FROM events),
w AS (SELECT server_name, breach, b - to_minutes(CAST(k * 5 AS BIGINT)) AS window_start FROM e, range(3) t(k))
SELECT * FROM (SELECT window_start, window_start + INTERVAL 15 MINUTE AS window_end, server_name, COUNT(*) AS n,
                      CAST(SUM(CAST(breach AS INTEGER)) AS BIGINT) AS breaches,
                      SUM(CAST(breach AS INTEGER)) / COUNT(*) AS breach_rate FROM w GROUP BY ALL)
WHERE window_end <= {_BOUND}""")
def stream_sliding(spark, d):
    s = ST.table_stream(spark, d, "events").withColumn(
        "server_name", F.concat(F.lit("srv"), (F.col("user_id") % 5).cast("string")))
    return ST.run_available_now(ST.sliding_rate(s, "ts", ["server_name"], F.col("value") > 250,
                                                "15 minutes", "5 minutes", DELAY), "sliding")


@query("stream_session_latest", f"""
WITH o AS (SELECT user_id, ts, event_id,
                  CASE WHEN lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) IS NULL
                         OR ts >= lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 30 MINUTE
                       THEN 1 ELSE 0 END AS new_session FROM events),
s AS (SELECT *, SUM(new_session) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sid FROM o),
g AS (SELECT user_id, MIN(ts) AS session_start, MAX(ts) + INTERVAL 30 MINUTE AS session_end, COUNT(*) AS sightings,
             arg_max(event_id, ts) AS last_event_id FROM s GROUP BY user_id, sid)
SELECT session_start, session_end, user_id, sightings, last_event_id FROM g WHERE session_end <= {_BOUND}""")
def stream_session(spark, d):
    s = ST.table_stream(spark, d, "events")
    return ST.run_available_now(ST.session_latest(s, "ts", "user_id", "event_id", "30 minutes", DELAY), "session")


_SD = f"""WITH {ctes('x1w')},
dd AS ({sql_delta('x1w', ['wait_type'], ['wait_time_ms', 'waiting_tasks_count'], monotonic=['wait_time_ms'])})
SELECT server_name, check_date, wait_type, prev_check_date, elapsed_seconds, wait_time_ms_delta, waiting_tasks_count_delta FROM dd
WHERE check_date <= (SELECT MAX(check_date) FROM x1w) - INTERVAL 2 HOUR"""


@query("stream_deltas", _SD)
def stream_deltas(spark, d):
    """The snapshots arrive shuffled over the files; one is compared once the watermark has passed it."""
    path = scratch_path(spark, "wait-snapshots")
    fx.wait_snapshots(spark, d).repartition(4, F.xxhash64("check_date", "wait_type")).write.mode("overwrite").parquet(path)
    s = ST.file_stream(spark, f"{path}/*.parquet", spark.read.parquet(path).schema)
    return SD.run(s, "2 hours")[0]


@query("stream_cdc_apply", f"""
WITH {ctes('x10')},
ch AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'D' ELSE 'U' END AS op, action_date AS changed_at,
              customer_id, 'F' AS action
       FROM x10 WHERE path_name = '1-URGENT'),
base AS (SELECT id, customer_id, action FROM x10)
SELECT b.* FROM base b WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.id = b.id)
UNION ALL SELECT id, customer_id, action FROM ch WHERE op <> 'D'""")
def stream_cdc(spark, d):
    a = fx.audit_trail(spark, d)
    base = a.select("id", "customer_id", "action")
    changes = (a.filter(F.col("path_name") == "1-URGENT")
               .select("id", F.when(F.col("id") % 5 == 0, "D").otherwise("U").alias("op"),
                       F.col("action_date").alias("changed_at"), "customer_id", F.lit("F").alias("action")))
    path = scratch_path(spark, "changes")
    changes.write.mode("overwrite").parquet(path)
    s = ST.file_stream(spark, f"{path}/*.parquet", spark.read.parquet(path).schema)
    return ST.cdc_foreach_batch(s, base, ["id"], "changed_at", "audit")


@query("late_rows", """
SELECT * FROM (SELECT *, MAX(ts) OVER (ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
                         - INTERVAL 1 HOUR AS watermark_bound FROM events)
WHERE ts < watermark_bound""")
def late(spark, d):
    return ST.late_rows(table(spark, d, "events"), "event_id", "ts", 3600)


@query("stream_dedupe", """SELECT DISTINCT user_id, event_type, date_trunc('minute', ts) AS minute FROM events""")
def stream_dedupe(spark, d):
    s = ST.table_stream(spark, d, "events").withColumn("minute", F.date_trunc("minute", "ts"))
    out = ST.dedupe(s, "ts", ["user_id", "event_type", "minute"], "10 minutes")
    return ST.run_available_now(out.select("user_id", "event_type", "minute"), "dedupe")
