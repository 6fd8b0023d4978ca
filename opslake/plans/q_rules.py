"""Queries for the findings engine and rule packs."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions.semantics import datediff, round_div, ts_lit
from opslake.operators import rules as RE
from opslake.operators.rulepacks.backup_rules import BACKUP_RULES
from opslake.operators.rulepacks.index_rules import INDEX_RULES
from opslake.plans.oracle_fixtures import ctes, sql_round_div
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

AS_OF = fx.AS_OF_EVENTS
TS = f"TIMESTAMP '{AS_OF}'"
READS = "(user_seeks + user_scans + user_lookups)"
NEW = f"(create_date >= {TS} - INTERVAL 7 DAY AND modify_date >= {TS} - INTERVAL 2 DAY)"
FWD = "(forwarded_fetch_count / uptime_days > 1000)"
OBJ = "schema_name || '.' || table_name || '.' || index_name"
TAB = "schema_name || '.' || table_name"
ACTIVE_HEAP = f"index_type = 'HEAP' AND ({READS} > 0 OR user_updates > 0) AND NOT {FWD}"
SHAPE = """(SELECT database_name, schema_name, table_name, COUNT(*) AS n, SUM(CASE WHEN NOT is_nullable THEN 1 ELSE 0 END) AS not_null,
       SUM(CASE WHEN data_type NOT IN ('nvarchar', 'varchar', 'char', 'nchar') THEN 1 ELSE 0 END) AS non_string,
       SUM(max_length) AS width FROM x5c GROUP BY ALL)"""

# oracle SQL per (check_id, finding): columns scope, object_name, details, details_num
INDEX_SQL = {
    1: f"""SELECT database_name, {TAB}, key_columns, COUNT(*) FROM x5 WHERE NOT is_primary_key AND NOT is_disabled
          AND index_type IN ('CLUSTERED', 'NONCLUSTERED') AND total_pages * 8 >= 250 * 1024
          GROUP BY database_name, schema_name, table_name, key_columns HAVING COUNT(*) > 1""",
    2: f"""SELECT database_name, {OBJ}, key_columns, NULL FROM x5 a WHERE EXISTS (SELECT 1 FROM x5 b
          WHERE b.database_name = a.database_name AND b.schema_name = a.schema_name AND b.table_name = a.table_name
          AND b.first_key_column = a.first_key_column AND b.key_columns <> a.key_columns)""",
    11: f"""SELECT database_name, {OBJ}, 'row + page lock wait ms', row_lock_wait_ms + page_lock_wait_ms FROM x5
           WHERE row_lock_wait_ms + page_lock_wait_ms > 300000""",
    20: f"""SELECT database_name, {TAB}, 'nonclustered indexes', COUNT(*) FROM x5 WHERE index_type = 'NONCLUSTERED'
           GROUP BY 1, 2 HAVING COUNT(*) >= 10""",
    21: f"""SELECT database_name, {TAB}, 'percent of nonclustered indexes unused',
           SUM(CASE WHEN {READS} = 0 THEN 1 ELSE 0 END) * CAST(100 AS DOUBLE) / COUNT(*) FROM x5
           WHERE index_type = 'NONCLUSTERED' AND NOT {NEW} GROUP BY 1, 2
           HAVING SUM(CASE WHEN {READS} = 0 THEN 1 ELSE 0 END) * 100 >= COUNT(*) * 5""",
    22: f"""SELECT database_name, {OBJ}, 'writes', user_updates FROM x5 WHERE index_type = 'NONCLUSTERED'
           AND NOT is_unique AND {READS} = 0 AND user_updates >= 10000""",
    23: f"""SELECT database_name, {OBJ}, 'key + included columns', key_column_count + include_column_count FROM x5
           WHERE key_column_count + include_column_count >= 7""",
    29: f"""SELECT database_name, {OBJ}, 'writes', user_updates FROM x5 WHERE index_type = 'NONCLUSTERED'
           AND NOT is_unique AND {READS} = 0 AND NOT {NEW} AND user_updates < 10000""",
    43: f"""SELECT database_name, {OBJ}, 'forwarded fetches per day', forwarded_fetch_count / uptime_days FROM x5
           WHERE index_type = 'HEAP' AND {FWD}""",
    44: f"SELECT database_name, {OBJ}, 'rows', row_count FROM x5 WHERE {ACTIVE_HEAP} AND row_count >= 100000",
    45: f"""SELECT database_name, {OBJ}, 'rows', row_count FROM x5 WHERE {ACTIVE_HEAP}
           AND row_count >= 10000 AND row_count < 100000""",
    46: f"SELECT database_name, {OBJ}, 'rows', row_count FROM x5 WHERE {ACTIVE_HEAP} AND row_count >= 0 AND row_count < 10000",
    47: f"""SELECT database_name, {OBJ}, 'nonclustered primary key on a heap', NULL FROM x5 a
           WHERE is_primary_key AND index_type = 'NONCLUSTERED' AND EXISTS (SELECT 1 FROM x5 h
           WHERE h.index_type = 'HEAP' AND h.database_name = a.database_name AND h.schema_name = a.schema_name AND h.table_name = a.table_name)""",
    48: f"""SELECT database_name, {OBJ}, 'writes per read', user_updates / {READS} FROM x5
           WHERE index_type = 'NONCLUSTERED' AND {READS} > 0 AND {READS} < 10000 AND user_updates >= 10000
           AND {READS} * 10 < user_updates""",
    49: f"""SELECT database_name, {OBJ}, 'deletes', leaf_delete_count FROM x5 WHERE index_type = 'HEAP'
           AND leaf_delete_count > 0 AND forwarded_fetch_count < uptime_days * 1000""",
    66: f"""SELECT database_name, {OBJ}, strftime(create_date, '%Y-%m-%d'), NULL FROM x5
           WHERE create_date >= {TS} - INTERVAL 7 DAY""",
    67: f"""SELECT database_name, {OBJ}, strftime(modify_date, '%Y-%m-%d'), NULL FROM x5
           WHERE modify_date > {TS} - INTERVAL 2 DAY AND create_date < {TS} - INTERVAL 7 DAY""",
    90: f"""SELECT database_name, {OBJ}, 'modifications', modification_counter FROM x5
           WHERE stats_updated <= {TS} - INTERVAL 30 DAY AND modification_counter * 10 >= row_count
           AND row_count >= 10000""",
    91: f"""SELECT database_name, {OBJ}, 'percent sampled', rows_sampled * CAST(100 AS DOUBLE) / row_count FROM x5
           WHERE (row_count BETWEEN 10000 AND 1000000 AND rows_sampled * 100 < row_count * 10)
              OR (row_count > 1000000 AND rows_sampled * 100 < row_count)""",
    25: f"SELECT database_name, {TAB}, 'columns', n FROM {SHAPE} WHERE not_null < 2 AND n > 3",
    26: f"SELECT database_name, {TAB}, 'summed column length', width FROM {SHAPE} WHERE n >= 35 OR width >= 2000",
    27: f"SELECT database_name, {TAB}, 'columns', n FROM {SHAPE} WHERE non_string <= 1 AND n > 3",
}

RECENT = f"backup_start_date >= {TS} - INTERVAL 30 DAY"
BK = "server_name, database_guid, database_name"
DB = "server_name || '.' || database_name || '.' || database_guid"
BIG = f"""(SELECT {BK}, avg(CASE WHEN type = 'D' THEN backup_size // 1048576 END) AS f,
          avg(CASE WHEN type = 'I' THEN backup_size // 1048576 END) AS i,
          avg(CASE WHEN type = 'L' THEN backup_size // 1048576 END) AS l FROM x3 GROUP BY {BK})"""


def _flag_sql(c):
    return f"SELECT database_name, {DB}, '{c}', COUNT(*) FROM x3 WHERE {c} GROUP BY {BK}"


BACKUP_SQL = {
    "Backups by a non-majority user": f"""SELECT database_name, {DB} || '.' || o.user_name, 'most backups by ' || m.user_name, o.n
        FROM (SELECT *, row_number() OVER (PARTITION BY {BK} ORDER BY n DESC, user_name) AS rk
              FROM (SELECT {BK}, user_name, COUNT(*) AS n FROM x3 GROUP BY ALL)) o
        JOIN (SELECT {BK}, user_name FROM (SELECT *, row_number() OVER (PARTITION BY {BK}
              ORDER BY n DESC, user_name) AS rk FROM (SELECT {BK}, user_name, COUNT(*) AS n FROM x3 GROUP BY ALL))
              WHERE rk = 1) m USING ({BK})
        WHERE o.rk > 1 AND o.n >= 2 AND o.user_name NOT IN ('svc_agent')""",
    "Compatibility level changed more than twice": f"""SELECT database_name, {DB}, 'compatibility levels',
        COUNT(DISTINCT compatibility_level) FROM x3 GROUP BY {BK} HAVING COUNT(DISTINCT compatibility_level) > 2""",
    "Password-protected backups": _flag_sql("is_password_protected"),
    "Snapshot backups": _flag_sql("is_snapshot"),
    "Read-only database backups": _flag_sql("is_readonly"),
    "Single-user database backups": _flag_sql("is_single_user"),
    "Backups without checksums": f"""SELECT database_name, {DB}, 'backups without checksum in 30 days', COUNT(*)
        FROM x3 WHERE {RECENT} AND NOT has_backup_checksums GROUP BY {BK}""",
    "Damaged backups": _flag_sql("is_damaged"),
    "Encrypted backups": f"""SELECT database_name, {DB}, encryptor_type, COUNT(*) FROM x3
        WHERE encryptor_type IS NOT NULL GROUP BY {BK}, encryptor_type""",
    "Bulk-logged data in backups": _flag_sql("has_bulk_logged_data"),
    "Recovery model switched often": f"""SELECT database_name, {DB}, 'recovery models', COUNT(DISTINCT recovery_model)
        FROM x3 WHERE recovery_model <> 'BULK-LOGGED' GROUP BY {BK} HAVING COUNT(DISTINCT recovery_model) > 4""",
    "Uncompressed full backups": f"""SELECT database_name, {DB}, 'uncompressed full backups in 30 days', COUNT(*)
        FROM x3 WHERE {RECENT} AND type = 'D' AND backup_size = compressed_backup_size GROUP BY {BK}""",
    "Large differential backups": f"""SELECT database_name, {DB}, 'average differential vs full MB', i FROM {BIG}
        WHERE f > 10240 AND i * 100 >= f * 40""",
    "Large log backups": f"""SELECT database_name, {DB}, 'average log vs full MB', l FROM {BIG}
        WHERE f > 10240 AND l * 100 >= f * 20""",
}


def _pack_sql(rules, sql_of, max_priority=None):
    parts = []
    for r in (c for pack in rules for c in pack.checks):
        if max_priority is not None and r.priority > max_priority:
            continue
        body = sql_of(r)
        parts.append(f"""SELECT CAST({r.check_id} AS INTEGER) AS check_id, CAST({r.priority} AS INTEGER) AS priority,
            '{r.findings_group}' AS findings_group, '{r.finding}' AS finding, CAST(t.c1 AS VARCHAR) AS scope,
            CAST(t.c2 AS VARCHAR) AS object_name, CAST(t.c3 AS VARCHAR) AS details, CAST(t.c4 AS DOUBLE) AS details_num,
            {TS} AS check_date FROM ({body}) AS t(c1, c2, c3, c4)""")
    return " UNION ALL ".join(parts)


def _idx_inputs(spark, d):
    return {"indexes": fx.index_inventory(spark, d), "columns": fx.column_inventory(spark, d)}


def _index_query(ids):
    rules = [p for p in (pack.only(lambda c: c.check_id in ids) for pack in INDEX_RULES) if p.checks]
    sql = f"WITH {ctes('x5', 'x5c')} " + _pack_sql(rules, lambda r: INDEX_SQL[r.check_id])

    def fn(spark, d):
        return RE.run_rules(_idx_inputs(spark, d), rules, AS_OF)
    return sql, fn


for _name, _ids in {"index_usage_rules": (20, 22, 29, 48, 21), "heap_bands": (43, 44, 45, 46, 47, 49),
                    "stats_rules": (90, 91), "recent_objects": (66, 67), "schema_shape_rules": (23, 25, 26, 27),
                    "index_lock_rules": (1, 2, 11)}.items():
    _sql, _fn = _index_query(set(_ids))
    query(_name, _sql)(_fn)


@query("backup_rules", f"WITH {ctes('x3')} " + _pack_sql(BACKUP_RULES, lambda r: BACKUP_SQL[r.finding]))
def backup_rules(spark, d):
    return RE.run_rules({"backups": fx.backups(spark, d)}, BACKUP_RULES, AS_OF)


CEILING = 150
_SKIP = """SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'db' || (n_nationkey % 4) END AS scope,
                  CASE WHEN n_nationkey % 12 = 1 THEN NULL ELSE CAST(n_nationkey % 13 + 1 AS INTEGER) END AS check_id
           FROM nation"""


@query("findings_engine", f"""WITH {ctes('x3', 'x5', 'x5c')},
f AS ({_pack_sql(INDEX_RULES, lambda r: INDEX_SQL[r.check_id], CEILING)} UNION ALL
      {_pack_sql(BACKUP_RULES, lambda r: BACKUP_SQL[r.finding], CEILING)}),
s AS ({_SKIP})
SELECT * FROM f WHERE NOT EXISTS (SELECT 1 FROM s WHERE (s.scope IS NULL OR s.scope = f.scope)
                                  AND (s.check_id IS NULL OR s.check_id = f.check_id))""")
def findings_engine(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    skip = n.select(F.when(k % 5 == 0, F.lit(None).cast("string")).otherwise(
        F.concat(F.lit("db"), (k % 4).cast("string"))).alias("scope"),
        F.when(k % 12 == 1, F.lit(None)).otherwise(k % 13 + 1).cast("int").alias("check_id"))
    inputs = dict(_idx_inputs(spark, d), backups=fx.backups(spark, d))
    # one engine run over all packs: each input is read once for its groups and once for its rows
    return RE.run_rules(inputs, INDEX_RULES + BACKUP_RULES, AS_OF, skip, CEILING)


@query("unindexed_fk", f"""WITH {ctes('x5')},
fk AS (SELECT 'fk_' || p_partkey AS constraint_name, 'db' || (p_size % 3) AS database_name, p_brand AS table_name,
              CASE WHEN p_partkey % 2 = 0 THEN p_type ELSE 'c' || p_size END AS column_name FROM part)
SELECT * FROM fk WHERE NOT EXISTS (SELECT 1 FROM x5 WHERE x5.database_name = fk.database_name
      AND x5.table_name = fk.table_name AND x5.first_key_column = fk.column_name)""")
def unindexed_fk(spark, d):
    p = table(spark, d, "part")
    fk = p.select(F.concat(F.lit("fk_"), F.col("p_partkey").cast("string")).alias("constraint_name"),
                  F.concat(F.lit("db"), (F.col("p_size") % 3).cast("string")).alias("database_name"),
                  F.col("p_brand").alias("table_name"),
                  F.when(F.col("p_partkey") % 2 == 0, F.col("p_type"))
                   .otherwise(F.concat(F.lit("c"), F.col("p_size").cast("string"))).alias("column_name"))
    lead = fx.index_inventory(spark, d).select("database_name", "table_name",
                                               F.col("first_key_column").alias("column_name"))
    return fk.join(lead, ["database_name", "table_name", "column_name"], "left_anti")


@query("missing_index_value", """
WITH m AS (SELECT p_partkey AS index_handle, p_brand || '.' || p_type AS object_name,
                  CAST((p_partkey % 13) * 100 + (p_partkey % 7) * 20 AS BIGINT) AS uses,
                  CAST(round(p_retailprice * 100) AS BIGINT) * (p_size * 20) AS unit, least(1 + p_partkey % 40, 1 + p_partkey % 9 * 5) AS days FROM part),
v AS (SELECT index_handle, object_name, uses * unit / CAST(1000 AS DOUBLE) AS magic_benefit, days FROM m)
SELECT *, magic_benefit / days AS benefit_per_day, row_number() OVER (ORDER BY magic_benefit DESC, index_handle) AS rk
FROM v WHERE magic_benefit / days >= 100000 QUALIFY rk <= 20""")
def missing_index(spark, d):
    """Requests worth at least 100,000 a day, by (seeks + scans) x cost x impact; days: of the table or of uptime, if shorter."""
    from opslake.operators.ranking import top_n
    m = fx.missing_index_requests(spark, d)
    uses = (F.col("user_seeks") + F.col("user_scans")).cast("bigint")
    v = m.select("index_handle", "object_name",
                 (uses * F.col("avg_total_user_cost_hundredths") * F.col("avg_user_impact_tenths") / F.lit(1000.0)).alias("magic_benefit"),
                 F.least("create_days", "uptime_days").alias("days"))
    v = v.withColumn("benefit_per_day", F.col("magic_benefit") / F.col("days")).filter(F.col("benefit_per_day") >= 100000)
    return top_n(v, F.col("magic_benefit"), "index_handle", 20)


@query("identity_headroom", """
WITH b AS (SELECT p_brand AS table_name, CAST(regexp_extract(p_brand, '#(\\d+)', 1) AS INTEGER) AS brand_no,
                  COUNT(*) AS n, SUM(p_size) AS sz, SUM(p_partkey) AS pk FROM part GROUP BY p_brand),
t AS (SELECT table_name, CASE brand_no % 3 WHEN 0 THEN 'tinyint' WHEN 1 THEN 'smallint' ELSE 'int' END AS data_type,
             CAST(CASE brand_no % 3 WHEN 0 THEN 255 WHEN 1 THEN 32767 ELSE 2147483647 END AS BIGINT) AS max_value,
             CASE WHEN brand_no % 5 = 0 THEN -1 ELSE 1 END AS increment,
             CAST(CASE brand_no % 3 WHEN 0 THEN n WHEN 1 THEN sz * 10 ELSE pk * 10000 END AS BIGINT) AS used FROM b)
SELECT table_name, data_type, increment, used * increment AS last_value,
       """ + sql_round_div("greatest(max_value - used, 0) * 100", "max_value", 2) + """ AS headroom_pct,
       greatest(max_value - used, 0) * 100 <= max_value * 30 AS low_headroom FROM t""")
def identity_headroom(spark, d):
    p = table(spark, d, "part")
    b = p.groupBy(F.col("p_brand").alias("table_name")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("p_size").alias("sz"), F.sum("p_partkey").alias("pk"))
    no = F.regexp_extract("table_name", r"#(\d+)", 1).cast("int")
    typ = F.when(no % 3 == 0, "tinyint").when(no % 3 == 1, "smallint").otherwise("int")
    mx = F.when(no % 3 == 0, 255).when(no % 3 == 1, 32767).otherwise(2147483647).cast("bigint")
    used = F.when(no % 3 == 0, F.col("n")).when(no % 3 == 1, F.col("sz") * 10).otherwise(F.col("pk") * 10000).cast("bigint")
    t = b.select("table_name", typ.alias("data_type"), mx.alias("max_value"),
                 F.when(no % 5 == 0, -1).otherwise(1).alias("increment"), used.alias("used"))
    left = F.greatest(F.col("max_value") - F.col("used"), F.lit(0))
    return t.select("table_name", "data_type", "increment", (F.col("used") * F.col("increment")).alias("last_value"),
                    round_div(left * 100, F.col("max_value"), 2).alias("headroom_pct"),
                    (left * 100 <= F.col("max_value") * 30).alias("low_headroom"))


@query("query_flags", f"""WITH {ctes('x7')}
SELECT query_hash,
       execution_count / greatest(date_diff('minute', creation_time, last_execution_time), 1) > 1000 AS frequent,
       (max_worker_time * 10 * execution_count > total_worker_time * 13
        OR min_worker_time * 10 * execution_count < total_worker_time * 7)
         AND total_logical_reads > 100000 * execution_count AS parameter_sensitive,
       total_elapsed_time > 300000000 * execution_count AS long_running,
       max_grant_kb > 0 AND max_used_grant_kb * 100 <= max_grant_kb * 10 AS unused_grant,
       total_elapsed_time * 10 > total_worker_time * 11 AS low_cpu_long_duration,
       query_cost <= 10 AND total_worker_time > 25000 * execution_count AS low_cost_high_cpu
FROM x7""")
def query_flags(spark, d, overrides: dict | None = None):
    cfg = {"frequent_per_minute": 1000, "sensitive_pct": 30, "sensitive_reads": 100000,
           "long_running_us": 300_000_000, "unused_grant_pct": 10, "low_cost": 10, "high_cpu_us": 25_000}
    cfg.update(overrides or {})
    x7 = fx.query_stats(spark, d)
    e, w = F.col("execution_count"), F.col("total_worker_time")
    alive = F.greatest(datediff("minute", F.col("creation_time"), F.col("last_execution_time")), F.lit(1))
    pct = cfg["sensitive_pct"]
    return x7.select(
        "query_hash", (e / alive > cfg["frequent_per_minute"]).alias("frequent"),
        (((F.col("max_worker_time") * 100 * e > w * (100 + pct)) | (F.col("min_worker_time") * 100 * e < w * (100 - pct)))
         & (F.col("total_logical_reads") > e * cfg["sensitive_reads"])).alias("parameter_sensitive"),
        (F.col("total_elapsed_time") > e * cfg["long_running_us"]).alias("long_running"),
        ((F.col("max_grant_kb") > 0) & (F.col("max_used_grant_kb") * 100 <= F.col("max_grant_kb") * cfg["unused_grant_pct"]))
        .alias("unused_grant"),
        (F.col("total_elapsed_time") * 10 > w * 11).alias("low_cpu_long_duration"),
        ((F.col("query_cost") <= cfg["low_cost"]) & (w > e * cfg["high_cpu_us"])).alias("low_cost_high_cpu"))


@query("plan_stability_flags", f"""WITH {ctes('x7')}
SELECT query_hash, plan_count > 1 AS many_plans, plan_count * 3 > 2 * execution_count AS many_compiles,
       avg_compile_ms > 5000 AS slow_compile FROM x7
WHERE plan_count > 1 OR plan_count * 3 > 2 * execution_count OR avg_compile_ms > 5000""")
def plan_stability(spark, d):
    x7 = fx.query_stats(spark, d)
    f = x7.select("query_hash", (F.col("plan_count") > 1).alias("many_plans"),
                  (F.col("plan_count") * 3 > F.col("execution_count") * 2).alias("many_compiles"),
                  (F.col("avg_compile_ms") > 5000).alias("slow_compile"))
    return f.filter(F.col("many_plans") | F.col("many_compiles") | F.col("slow_compile"))


# Support end dates per major version (mainstream, extended).
SUPPORT = [
    (10, "SQL Server 2008", "2014-07-08", "2019-07-09"), (11, "SQL Server 2012", "2017-07-11", "2022-07-12"),
    (12, "SQL Server 2014", "2019-07-09", "2024-07-09"), (13, "SQL Server 2016", "2021-07-13", "2026-07-14"),
    (14, "SQL Server 2017", "2022-10-11", "2027-10-12"), (15, "SQL Server 2019", "2025-01-07", "2030-01-08"),
    (16, "SQL Server 2022", "2028-01-11", "2033-01-11"),
]
_SUP_SQL = "(VALUES " + ", ".join(f"({m}, '{n}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for m, n, a, b in SUPPORT) + \
    ") AS v(major_version, version_name, mainstream_end, extended_end)"


@query("support_end", f"""
WITH s AS (SELECT 's' || s_suppkey AS server_name, CAST(10 + s_suppkey % 7 AS INTEGER) AS major_version,
                  CAST((s_suppkey * 37) % 5000 AS INTEGER) AS minor_version FROM supplier)
SELECT s.*, v.version_name, v.mainstream_end, v.extended_end,
       date_diff('day', {TS}, v.extended_end) AS days_left,
       CASE WHEN v.mainstream_end > {TS} THEN 'mainstream' WHEN v.extended_end > {TS} THEN 'extended'
            ELSE 'unsupported' END AS support_status
FROM s LEFT JOIN {_SUP_SQL} USING (major_version)""")
def support_end(spark, d):
    s = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("server_name"),
        (10 + F.col("s_suppkey") % 7).cast("int").alias("major_version"),
        ((F.col("s_suppkey") * 37) % 5000).cast("int").alias("minor_version"))
    v = spark.createDataFrame(SUPPORT, "major_version int, version_name string, ms string, ex string").select(
        "major_version", "version_name", F.col("ms").cast("timestamp_ntz").alias("mainstream_end"),
        F.col("ex").cast("timestamp_ntz").alias("extended_end"))
    now = ts_lit(AS_OF)
    j = s.join(F.broadcast(v), "major_version", "left")
    return j.select("server_name", "major_version", "minor_version", "version_name", "mainstream_end", "extended_end",
                    datediff("day", now, F.col("extended_end")).alias("days_left"),
                    F.when(F.col("mainstream_end") > now, "mainstream").when(F.col("extended_end") > now, "extended")
                    .otherwise("unsupported").alias("support_status"))
