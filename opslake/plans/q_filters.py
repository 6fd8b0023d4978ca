"""Queries for projections and predicates."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions import scalar as S
from opslake.operators import filters as FL
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

PL_COLS = ["id", "user", "host", "db", "command", "time", "state", "info"]
_DENY = "('rdsadmin', 'rdsrepladmin', 'system user', 'event_scheduler')"


@query("long_running_filter", f"""WITH {ctes('x4')}
SELECT id, "user", host, db, command, "time", state, info FROM x4
WHERE lower(command) = 'query' AND "time" > 420 AND lower(state) = 'executing'
  AND lower("user") NOT IN {_DENY}
  AND (info IS NULL OR info NOT LIKE '%IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT%')""")
def long_running(spark, d):
    return FL.long_running(fx.processlist(spark, d), 420).select(*PL_COLS)


@query("long_running_replica", f"""WITH {ctes('x4')}
SELECT id, "user", host, db, command, "time", state, info FROM x4
WHERE lower(command) = 'query' AND "time" > 1200 AND lower(state) = 'executing'
  AND lower("user") NOT IN {_DENY}
  AND (info IS NULL OR info NOT LIKE '%IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT%')""")
def long_running_replica(spark, d):
    return FL.long_running(fx.processlist(spark, d), 1200).select(*PL_COLS)


@query("query_collector_filter", f"""WITH {ctes('x4')}
SELECT "user", info AS query, "time", host, db AS "DB" FROM x4
WHERE info IS NOT NULL AND "time" < 60 AND lower("user") NOT IN ('rdsadmin', 'root')""")
def collector(spark, d):
    return FL.collector(fx.processlist(spark, d))


NEEDLES = ["000000017", "000000123", "000001234"]
IDS = ["000000017", "000000385", "000001129", "000000206", "000000439", "000001124", "000001155"]


@query("string_search_regex", "SELECT * FROM customer WHERE regexp_matches(c_name, '000000017|000000123|000001234')")
def ss_regex(spark, d):
    return FL.search_regex(table(spark, d, "customer"), "c_name", NEEDLES)


@query("string_search_like", """SELECT * FROM customer
WHERE c_name LIKE '%000000017%' OR c_name LIKE '%000000123%' OR c_name LIKE '%000001234%'""")
def ss_like(spark, d):
    return FL.search_like(table(spark, d, "customer"), "c_name", NEEDLES)


_IN = ", ".join(f"'{i}'" for i in IDS)


@query("string_search_substr", f"SELECT * FROM customer WHERE substring(c_name, 10) IN ({_IN})")
def ss_substr(spark, d):
    return FL.search_substring(table(spark, d, "customer"), "c_name", 10, IDS)


@query("string_search_replace", f"SELECT * FROM customer WHERE replace(c_name, 'Customer#', '') IN ({_IN})")
def ss_replace(spark, d):
    return FL.search_replace(table(spark, d, "customer"), "c_name", "Customer#", IDS)


@query("attr_filter", f"""WITH {ctes('x2')}
SELECT * FROM x2 WHERE lower(host_name) LIKE 'host1%'
  AND NOT coalesce(lower(program_name) LIKE '%build%', false)""")
def attr_filter(spark, d):
    s = FL.filter_by(fx.sessions(spark, d), "host_name", "HOST1%")
    return FL.filter_by(s, "program_name", "%BUILD%", negate=True)


_ANY = "cpu_time > 2900 OR reads > 900000 OR writes > 260"


@query("threshold_any_of", f"""WITH {ctes('x2')}
SELECT * FROM x2 WHERE {_ANY}
   OR (SELECT COUNT(*) > 0 FROM x2 WHERE blocking_session_id IS NOT NULL AND wait_time_ms >= 100000000)""")
def threshold_any(spark, d):
    s = fx.sessions(spark, d)
    gate = FL.blocking_gate(s, "wait_time_ms", "blocking_session_id", 100_000_000)
    return FL.any_of(s, {"cpu_time": 2900, "reads": 900000, "writes": 260}, gate)


@query("threshold_all_when_blocked", f"""WITH {ctes('x2')}
SELECT * FROM x2 WHERE {_ANY}
   OR (SELECT COUNT(*) > 0 FROM x2 WHERE blocking_session_id IS NOT NULL AND wait_time_ms >= 900000)""")
def threshold_all(spark, d):
    s = fx.sessions(spark, d)
    gate = FL.blocking_gate(s, "wait_time_ms", "blocking_session_id", 900_000)
    return FL.any_of(s, {"cpu_time": 2900, "reads": 900000, "writes": 260}, gate)


@query("command_text", f"""WITH {ctes('x4')}
SELECT 'KILL ' || id || ';' AS kill_command FROM x4 WHERE lower(command) = 'query' AND "time" > 60""")
def command_text(spark, d):
    pl = fx.processlist(spark, d)
    return FL.kill_commands(pl.filter((F.lower("command") == "query") & (F.col("time") > 60)))


@query("lock_account_text", f"""WITH {ctes('x4')}
SELECT DISTINCT 'ALTER USER ''' || "user" || '''@''' || '%' || ''' ACCOUNT LOCK;' AS lock_command
FROM x4 WHERE lower(command) = 'sleep' AND "time" > 300 AND lower("user") NOT IN {_DENY}""")
def lock_text(spark, d):
    pl = FL.long_running(fx.processlist(spark, d), 300, command="Sleep", state=None, marker=None)
    return pl.select(S.lock_command(F.col("user"), F.lit("%")).alias("lock_command")).distinct()


@query("statement_history_top", f"""WITH {ctes('x4')}
SELECT id AS event_id, "user" AS thread_user, info AS sql_text,
       "time" * 1000000000000 AS timer_wait, ("time" * 1000000000000) / 1e12 AS execution_time_seconds
FROM x4 WHERE info LIKE '%"k": 1%' AND info NOT LIKE '%IGNORE_KILL%'
ORDER BY id DESC LIMIT 10""")
def statement_top(spark, d):
    pl = fx.processlist(spark, d)
    tw = F.col("time") * F.lit(1_000_000_000_000)
    return (pl.filter(F.col("info").like('%"k": 1%') & ~F.col("info").like("%IGNORE_KILL%"))
            .select(F.col("id").alias("event_id"), F.col("user").alias("thread_user"),
                    F.col("info").alias("sql_text"), tw.alias("timer_wait"),
                    (tw / F.lit(1e12)).alias("execution_time_seconds"))
            .orderBy(F.col("event_id").desc()).limit(10))
