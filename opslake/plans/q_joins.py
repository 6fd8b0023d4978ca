"""Queries for joins."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import joins as J
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

STATES_SQL = "(VALUES " + ", ".join(
    "('{}', '{}')".format(s.replace("'", "''"), t) for s, t in J.REPLICATION_STATES) + ") AS ks(state, state_type)"


@query("missing_pk_anti", f"""WITH {ctes('x5')}
SELECT DISTINCT t.database_name, t.table_name FROM x5 t
LEFT JOIN (SELECT * FROM x5 WHERE is_primary_key) pk
  ON pk.database_name = t.database_name AND pk.table_name = t.table_name
WHERE pk.index_id IS NULL""")
def missing_pk(spark, d):
    x5 = fx.index_inventory(spark, d)
    tables = x5.select("database_name", "table_name").distinct()
    pk = x5.filter("is_primary_key").select("database_name", "table_name")
    return tables.join(pk, ["database_name", "table_name"], "left_anti")


def _skip(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(
        F.when(k % 5 == 0, F.lit(None).cast("string"))
         .otherwise(F.concat(F.lit("db"), (k % 4).cast("string"))).alias("database_name"),
        F.when(k % 12 == 1, F.lit(None).cast("bigint")).otherwise(k % 13 + 1).alias("check_id"))


@query("skip_list_anti", f"""WITH {ctes('x5')},
f AS (SELECT database_name, index_id % 5 + 1 AS check_id, index_name AS finding FROM x5),
s AS (SELECT CASE WHEN n_nationkey % 5 = 0 THEN NULL ELSE 'db' || (n_nationkey % 4) END AS database_name,
             CASE WHEN n_nationkey % 12 = 1 THEN NULL ELSE n_nationkey % 13 + 1 END AS check_id FROM nation)
SELECT * FROM f WHERE NOT EXISTS (
  SELECT 1 FROM s WHERE (s.database_name IS NULL OR s.database_name = f.database_name)
                    AND (s.check_id IS NULL OR s.check_id = f.check_id))""")
def skip_list(spark, d):
    f = fx.index_inventory(spark, d).select(
        "database_name", (F.col("index_id") % 5 + 1).alias("check_id"), F.col("index_name").alias("finding"))
    return J.anti_skip_list(f, _skip(spark, d), ["database_name", "check_id"])


@query("borderline_duplicates", f"""WITH {ctes('x5')}
SELECT database_name, table_name, index_id, key_columns FROM x5 a
WHERE EXISTS (SELECT 1 FROM x5 b WHERE b.database_name = a.database_name AND b.table_name = a.table_name
              AND b.first_key_column = a.first_key_column AND b.key_columns <> a.key_columns)""")
def borderline(spark, d):
    x5 = fx.index_inventory(spark, d)
    return (J.has_other_value(x5, ["database_name", "table_name", "first_key_column"], "key_columns")
            .select("database_name", "table_name", "index_id", "key_columns"))


@query("state_pattern_join", f"""WITH {ctes('x4')}
SELECT p.id, p."user", p.command, p.state, ks.state AS known_state, ks.state_type
FROM x4 p LEFT JOIN {STATES_SQL} ON ks.state LIKE p.state || '%'
WHERE p."user" = 'system user' OR p.command = 'Binlog Dump'""")
def state_pattern(spark, d):
    pl = (fx.processlist(spark, d).filter((F.col("user") == "system user") | (F.col("command") == "Binlog Dump"))
          .select("id", "user", "command", "state"))
    ks = J.known_states(spark).withColumnRenamed("state", "known_state")
    return J.prefix_join(pl, "state", ks, "known_state")


@query("state_pattern_dedupe", f"""WITH {ctes('x4')}
SELECT p.id, p."user", p.command, p.state, ks.state AS known_state, ks.state_type
FROM x4 p LEFT JOIN {STATES_SQL} ON ks.state LIKE p.state || '%'
WHERE p."user" = 'system user' OR p.command = 'Binlog Dump'
QUALIFY row_number() OVER (PARTITION BY p.id ORDER BY length(ks.state), ks.state) = 1""")
def state_pattern_dedupe(spark, d):
    """One known state a process, however many its state is a prefix of."""
    pl = (fx.processlist(spark, d).filter((F.col("user") == "system user") | (F.col("command") == "Binlog Dump"))
          .select("id", "user", "command", "state"))
    ks = J.known_states(spark).withColumnRenamed("state", "known_state")
    return J.prefix_join(pl, "state", ks, "known_state", dedupe=True)


@query("permission_resolve", """
WITH p AS (SELECT s_suppkey AS permission_id, s_nationkey AS grantee_principal_id,
                  CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 1 ELSE 3 END AS class,
                  CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN s_suppkey * 7 ELSE s_suppkey % 5 END AS major_id,
                  CASE s_suppkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'INSERT' WHEN 2 THEN 'EXECUTE'
                       ELSE 'UPDATE' END AS permission_name,
                  CASE WHEN s_suppkey % 10 = 9 THEN 'DENY' ELSE 'GRANT' END AS state_desc FROM supplier)
SELECT p.permission_id, n.n_name AS grantee, p.permission_name, p.state_desc,
       CASE p.class WHEN 0 THEN 'DATABASE' WHEN 1 THEN 'OBJECT_OR_COLUMN' ELSE 'SCHEMA' END AS class_desc,
       CASE p.class WHEN 0 THEN 'DATABASE' WHEN 1 THEN o.p_name ELSE sc.r_name END AS securable_name
FROM p LEFT JOIN nation n ON n.n_nationkey = p.grantee_principal_id
LEFT JOIN part o ON p.class = 1 AND o.p_partkey = p.major_id
LEFT JOIN region sc ON p.class = 3 AND sc.r_regionkey = p.major_id""")
def permission_resolve(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    cls = F.when(k % 3 == 0, 0).when(k % 3 == 1, 1).otherwise(3)
    p = s.select(k.alias("permission_id"), F.col("s_nationkey").alias("grantee_principal_id"), cls.alias("class"),
                 F.when(k % 3 == 0, 0).when(k % 3 == 1, k * 7).otherwise(k % 5).alias("major_id"),
                 F.when(k % 4 == 0, "SELECT").when(k % 4 == 1, "INSERT").when(k % 4 == 2, "EXECUTE")
                  .otherwise("UPDATE").alias("permission_name"),
                 F.when(k % 10 == 9, "DENY").otherwise("GRANT").alias("state_desc"))
    n = table(spark, d, "nation").select("n_nationkey", "n_name")
    o = table(spark, d, "part").select("p_partkey", "p_name")
    r = table(spark, d, "region").select("r_regionkey", "r_name")
    j = (p.join(n, p.grantee_principal_id == n.n_nationkey, "left")
          .join(o, (p["class"] == 1) & (p.major_id == o.p_partkey), "left")
          .join(r, (p["class"] == 3) & (p.major_id == r.r_regionkey), "left"))
    return j.select(
        "permission_id", F.col("n_name").alias("grantee"), "permission_name", "state_desc",
        F.when(F.col("class") == 0, "DATABASE").when(F.col("class") == 1, "OBJECT_OR_COLUMN")
         .otherwise("SCHEMA").alias("class_desc"),
        F.when(F.col("class") == 0, "DATABASE").when(F.col("class") == 1, F.col("p_name"))
         .otherwise(F.col("r_name")).alias("securable_name"))


@query("lock_wait_join", f"""WITH {ctes('x2')},
trx AS (SELECT session_id * 10 AS trx_id, session_id, start_time AS trx_started FROM x2
        WHERE status IN ('running', 'suspended'))
SELECT w.session_id AS waiting_id, w.login_name AS waiting_login, w.wait_time_ms AS waiting_wait_ms,
       b.session_id AS blocking_id, b.login_name AS blocking_login, b.status AS blocking_status,
       wt.trx_id AS waiting_trx_id, bt.trx_id AS blocking_trx_id, bt.trx_started AS blocking_trx_started
FROM x2 w JOIN x2 b ON b.session_id = w.blocking_session_id
LEFT JOIN trx wt ON wt.session_id = w.session_id LEFT JOIN trx bt ON bt.session_id = b.session_id""")
def lock_wait(spark, d):
    s = fx.sessions(spark, d)
    trx = (s.filter(F.col("status").isin("running", "suspended"))
           .select((F.col("session_id") * 10).alias("trx_id"), "session_id", F.col("start_time").alias("trx_started")))
    w = s.select(F.col("session_id").alias("waiting_id"), F.col("login_name").alias("waiting_login"),
                 F.col("wait_time_ms").alias("waiting_wait_ms"), "blocking_session_id")
    b = s.select(F.col("session_id").alias("blocking_id"), F.col("login_name").alias("blocking_login"),
                 F.col("status").alias("blocking_status"))
    wt = trx.select(F.col("session_id").alias("waiting_id"), F.col("trx_id").alias("waiting_trx_id"))
    bt = trx.select(F.col("session_id").alias("blocking_id"), F.col("trx_id").alias("blocking_trx_id"),
                    F.col("trx_started").alias("blocking_trx_started"))
    return (w.join(b, w.blocking_session_id == b.blocking_id).drop("blocking_session_id")
            .join(wt, "waiting_id", "left").join(bt, "blocking_id", "left"))


@query("replication_status", """
WITH cfg AS (SELECT 'ch' || r_regionkey AS channel_name, 'primary-' || lower(r_name) AS host, 3306 AS port FROM region),
cs AS (SELECT 'ch' || n_regionkey AS channel_name, CASE WHEN COUNT(*) > 4 THEN 'ON' ELSE 'OFF' END AS io_state,
              COUNT(*) AS received_count FROM nation GROUP BY n_regionkey),
ac AS (SELECT 'ch' || r_regionkey AS channel_name, r_regionkey * 10 AS desired_delay FROM region),
aps AS (SELECT 'ch' || r_regionkey AS channel_name, 'ON' AS sql_state FROM region WHERE r_regionkey <> 2),
co AS (SELECT 'ch' || (s_nationkey % 5) AS channel_name, MAX(s_suppkey) AS last_processed FROM supplier GROUP BY 1),
wk AS (SELECT 'ch' || (c_nationkey % 5) AS channel_name, COUNT(*) AS workers, MAX(c_custkey) AS last_applied
       FROM customer GROUP BY 1)
SELECT * FROM cfg JOIN cs USING (channel_name) JOIN ac USING (channel_name)
LEFT JOIN aps USING (channel_name) LEFT JOIN co USING (channel_name) LEFT JOIN wk USING (channel_name)""")
def replication_status(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    s, c = table(spark, d, "supplier"), table(spark, d, "customer")
    ch = lambda col: F.concat(F.lit("ch"), col.cast("string")).alias("channel_name")
    cfg = r.select(ch(F.col("r_regionkey")), F.concat(F.lit("primary-"), F.lower("r_name")).alias("host"),
                   F.lit(3306).alias("port"))
    cs = (n.groupBy(ch(F.col("n_regionkey"))).agg(F.count(F.lit(1)).alias("received_count"))
          .select("channel_name", F.when(F.col("received_count") > 4, "ON").otherwise("OFF").alias("io_state"),
                  "received_count"))
    ac = r.select(ch(F.col("r_regionkey")), (F.col("r_regionkey") * 10).alias("desired_delay"))
    aps = r.filter(F.col("r_regionkey") != 2).select(ch(F.col("r_regionkey")), F.lit("ON").alias("sql_state"))
    co = s.groupBy(ch(F.col("s_nationkey") % 5)).agg(F.max("s_suppkey").alias("last_processed"))
    wk = c.groupBy(ch(F.col("c_nationkey") % 5)).agg(F.count(F.lit(1)).alias("workers"),
                                                    F.max("c_custkey").alias("last_applied"))
    return (cfg.join(cs, "channel_name").join(ac, "channel_name").join(aps, "channel_name", "left")
            .join(co, "channel_name", "left").join(wk, "channel_name", "left"))


@query("fk_dependencies", """
WITH fk AS (SELECT 'fk_' || p_partkey AS constraint_name, p_brand AS table_name, 'c' || p_size AS column_name,
                   'Brand#' || (p_partkey % 7 + 1) AS referenced_table FROM part)
SELECT constraint_name, table_name, referenced_table AS other_table, column_name, 'references' AS direction FROM fk
UNION ALL
SELECT constraint_name, referenced_table AS table_name, table_name AS other_table, column_name,
       'referenced by' AS direction FROM fk""")
def fk_deps(spark, d):
    p = table(spark, d, "part")
    fk = p.select(F.concat(F.lit("fk_"), F.col("p_partkey").cast("string")).alias("constraint_name"),
                  F.col("p_brand").alias("table_name"),
                  F.concat(F.lit("c"), F.col("p_size").cast("string")).alias("column_name"),
                  F.concat(F.lit("Brand#"), (F.col("p_partkey") % 7 + 1).cast("string")).alias("referenced_table"))
    out = fk.select("constraint_name", "table_name", F.col("referenced_table").alias("other_table"),
                    "column_name", F.lit("references").alias("direction"))
    back = fk.select("constraint_name", F.col("referenced_table").alias("table_name"),
                     F.col("table_name").alias("other_table"), "column_name",
                     F.lit("referenced by").alias("direction"))
    return out.unionByName(back)
