"""Queries for sessions and blocking."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import sessions as S
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx


@query("block_leaders", f"""WITH RECURSIVE {ctes('x2s')},
tree(server_name, leader, session_id, depth) AS (
  SELECT server_name, session_id, session_id, 0 FROM x2s WHERE blocking_session_id IS NULL
  UNION ALL
  SELECT t.server_name, t.leader, c.session_id, t.depth + 1 FROM tree t
  JOIN x2s c ON c.server_name = t.server_name AND c.blocking_session_id = t.session_id)
SELECT server_name, leader AS leader_session_id, COUNT(*) - 1 AS blocked_count, CAST(MAX(depth) AS BIGINT) AS max_depth
FROM tree GROUP BY server_name, leader HAVING COUNT(*) > 1""")
def block_leaders(spark, d):
    return S.block_leaders(fx.server_sessions(spark, d), by=("server_name",))


@query("session_deltas", f"""WITH {ctes('x2s', 'x2b')}
SELECT b.server_name, b.session_id, b.request_id, b.login_time, b.cpu_time - a.cpu_time AS cpu_time_delta,
       b.reads - a.reads AS reads_delta, b.writes - a.writes AS writes_delta,
       b.tempdb_pages - a.tempdb_pages AS tempdb_pages_delta
FROM x2b b JOIN x2s a USING (server_name, session_id, request_id, login_time)""")
def session_deltas(spark, d):
    return S.session_deltas(fx.server_sessions(spark, d), fx.sessions_pass2(spark, d))


_REQ = """SELECT server_name, session_id, CASE WHEN session_id % 11 = 0 THEN -2 WHEN session_id % 13 = 0 THEN -4
                  ELSE coalesce(blocking_session_id, 0) END AS blocking_session_id FROM x2s"""
_WT = """SELECT server_name, session_id, CASE WHEN session_id % 3 = 0 THEN session_id - 1 ELSE session_id END AS wait_blocking_session_id
         FROM x2s WHERE status <> 'running'"""


@query("blocking_resolve", f"""WITH {ctes('x2s')}, r AS ({_REQ}), w AS ({_WT})
SELECT r.server_name, r.session_id, r.blocking_session_id, w.wait_blocking_session_id,
       CASE WHEN r.blocking_session_id > 0 THEN r.blocking_session_id
            WHEN w.wait_blocking_session_id IS NOT NULL AND w.wait_blocking_session_id <> r.session_id
              THEN w.wait_blocking_session_id
            WHEN r.blocking_session_id = -2 THEN -2
            WHEN r.blocking_session_id IN (-3, -4) THEN r.blocking_session_id END AS resolved_blocker
FROM r LEFT JOIN w USING (server_name, session_id)""")
def blocking_resolve(spark, d):
    s = fx.server_sessions(spark, d)
    k = F.col("session_id")
    req = s.select("server_name", "session_id", F.when(k % 11 == 0, F.lit(-2)).when(k % 13 == 0, F.lit(-4))
                   .otherwise(F.coalesce("blocking_session_id", F.lit(0))).alias("blocking_session_id"))
    wt = s.filter(F.col("status") != "running").select(
        "server_name", "session_id", F.when(k % 3 == 0, k - 1).otherwise(k).alias("wait_blocking_session_id"))
    return S.resolve_blocking(req, wt)


@query("except_uncollected_blockers", f"""WITH {ctes('x2s', 'x2b')}
SELECT server_name, blocking_session_id AS session_id FROM x2s WHERE blocking_session_id IS NOT NULL
EXCEPT SELECT server_name, session_id FROM x2b""")
def except_blockers(spark, d):
    b = fx.server_sessions(spark, d).filter(F.col("blocking_session_id").isNotNull()).select(
        "server_name", F.col("blocking_session_id").alias("session_id"))
    return S.uncollected_blockers(b, fx.sessions_pass2(spark, d))
