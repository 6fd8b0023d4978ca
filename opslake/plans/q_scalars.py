"""One query per scalar-function family, each over a whole derived table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions import scalar as S
from opslake.functions.semantics import datediff, safe_div, safe_div0, ts_lit
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

AS_OF = fx.AS_OF_EVENTS


@query("scalar_dirname", f"""WITH {ctes('x1f')}
SELECT DISTINCT physical_name,
       CASE WHEN regexp_extract(physical_name, '^(.*[\\\\/])', 1) = '' THEN physical_name
            ELSE regexp_extract(physical_name, '^(.*[\\\\/])', 1) END AS directory FROM x1f""")
def dirname(spark, d):
    f = fx.file_snapshots(spark, d).select("physical_name").distinct()
    return f.withColumn("directory", S.dirname("physical_name"))


@query("scalar_parsename", f"""WITH {ctes('x6')}
SELECT DISTINCT objectname, CASE WHEN len(string_split(objectname, '.')) >= 1 THEN string_split(objectname, '.')[-1] END AS part1,
       CASE WHEN len(string_split(objectname, '.')) >= 2 THEN string_split(objectname, '.')[-2] END AS part2,
       CASE WHEN len(string_split(objectname, '.')) >= 3 THEN string_split(objectname, '.')[-3] END AS part3,
       CASE WHEN len(string_split(objectname, '.')) >= 4 THEN string_split(objectname, '.')[-4] END AS part4 FROM x6""")
def parsename(spark, d):
    o = fx.deadlock_lines(spark, d).select(F.concat(F.lit("db"), (F.col("l_partkey") % 5).cast("string"),
                                                    F.lit(".dbo.t"), (F.col("l_partkey") % 10).cast("string"))
                                           .alias("objectname")).distinct()
    return o.select("objectname", *[S.parsename("objectname", i).alias(f"part{i}") for i in range(1, 5)])


@query("scalar_clean", "SELECT doc_id, translate(text, chr(9) || chr(10) || chr(13), '   ') AS clean_text FROM documents")
def clean(spark, d):
    return table(spark, d, "documents").select("doc_id", S.clean_text("text").alias("clean_text"))


@query("scalar_prefix", f"""WITH {ctes('x4')}
SELECT id, host, CASE WHEN strpos(host, ':') > 0 THEN substr(host, 1, strpos(host, ':') - 1) ELSE host END AS host_name
FROM x4""")
def prefix(spark, d):
    return fx.processlist(spark, d).select("id", "host", S.prefix_before("host", ":").alias("host_name"))


@query("scalar_trunc_hour", "SELECT event_id, ts, date_trunc('hour', ts) AS hour_start FROM events")
def trunc_hour(spark, d):
    return table(spark, d, "events").select("event_id", "ts", S.trunc_hour("ts").alias("hour_start"))


_UNITS = ["year", "month", "day", "hour", "minute", "second"]


@query("scalar_datediff", f"""WITH {ctes('x3')}
SELECT backup_set_id, """ + ", ".join(
    f"date_diff('{u}', backup_start_date, backup_finish_date) AS d_{u}" for u in ("minute", "second")) + ", " +
    ", ".join(f"date_diff('{u}', backup_start_date, TIMESTAMP '{AS_OF}') AS to_asof_{u}" for u in _UNITS) +
    " FROM x3")
def datediffs(spark, d):
    b = fx.backups(spark, d)
    s, f = F.col("backup_start_date"), F.col("backup_finish_date")
    return b.select("backup_set_id", *[datediff(u, s, f).alias(f"d_{u}") for u in ("minute", "second")],
                    *[datediff(u, s, ts_lit(AS_OF)).alias(f"to_asof_{u}") for u in _UNITS])


def _lp(x, n):
    return f"lpad(CAST({x} AS VARCHAR), {n}, '0')"


@query("scalar_duration", f"""WITH {ctes('x2')}
SELECT session_id, wait_time_ms, {_lp('wait_time_ms // 86400000', 2)} || ' ' || {_lp('(wait_time_ms // 3600000) % 24', 2)}
       || ':' || {_lp('(wait_time_ms // 60000) % 60', 2)} || ':' || {_lp('(wait_time_ms // 1000) % 60', 2)} || '.'
       || {_lp('wait_time_ms % 1000', 3)} AS duration FROM x2""")
def duration(spark, d):
    return fx.sessions(spark, d).select("session_id", "wait_time_ms", S.duration_text("wait_time_ms").alias("duration"))


@query("scalar_thousands", f"""WITH {ctes('x7')}
SELECT query_hash, total_logical_reads, format('{{:,}}', total_logical_reads) AS reads_text FROM x7""")
def thousands(spark, d):
    return fx.query_stats(spark, d).select("query_hash", "total_logical_reads",
                                           S.thousands("total_logical_reads").alias("reads_text"))


@query("scalar_safe_div", f"""WITH {ctes('x7')}
SELECT query_hash, CASE WHEN total_spills <> 0 THEN total_worker_time / total_spills END AS cpu_per_spill,
       coalesce(CASE WHEN total_spills <> 0 THEN total_logical_writes / total_spills END, 0.0) AS writes_per_spill FROM x7""")
def safe_division(spark, d):
    x7 = fx.query_stats(spark, d)
    return x7.select("query_hash", safe_div("total_worker_time", "total_spills").alias("cpu_per_spill"),
                     safe_div0("total_logical_writes", "total_spills").alias("writes_per_spill"))


@query("scalar_try_cast", """
SELECT event_id, TRY_CAST(regexp_extract(props, '(\\d+)', 1) AS BIGINT) AS k_value,
       TRY_CAST(substr(props, 7) AS BIGINT) AS raw_tail FROM events""")
def try_cast(spark, d):
    ev = table(spark, d, "events")
    return ev.select("event_id", S.try_int(F.regexp_extract("props", r"(\d+)", 1)).alias("k_value"),
                     S.try_int(F.expr("substring(props, 7)")).alias("raw_tail"))


@query("report_markdown", f"""WITH {ctes('xfi')},
a AS (SELECT priority, findings_group, finding, COUNT(*) AS n FROM xfi GROUP BY ALL)
SELECT priority, '## Priority ' || priority || chr(10) || string_agg('- ' || findings_group || ': ' || finding || ' (' || n || ')',
       chr(10) ORDER BY findings_group, finding) AS markdown FROM a GROUP BY priority""")
def report_markdown(spark, d):
    a = fx.findings_log(spark, d).groupBy("priority", "findings_group", "finding").agg(F.count(F.lit(1)).alias("n"))
    line = F.concat(F.lit("- "), F.col("findings_group"), F.lit(": "), F.col("finding"), F.lit(" ("),
                    F.col("n").cast("string"), F.lit(")"))
    g = a.groupBy("priority").agg(F.array_sort(F.collect_list(F.struct("findings_group", "finding", line.alias("l"))))
                                  .alias("ls"))
    return g.select("priority", F.concat(F.lit("## Priority "), F.col("priority").cast("string"), F.lit("\n"),
                                         F.array_join(F.transform("ls", lambda s: s["l"]), "\n")).alias("markdown"))
