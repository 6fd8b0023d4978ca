"""Queries for sources, sinks and tenant extraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.operators import extract as X
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.session import scratch_path
from opslake.sources import fixtures as fx
from opslake.sources import sinks
from opslake.sources.lake import BucketedTable, Lake, archive_and_clear, purge_days, timed_copy, write_by_day
from opslake.sources.tables import table

AS_OF = fx.AS_OF_EVENTS
TENANTS = [3, 7, 19]          # a tenant list is the feature of F1 / J4

CHAIN = {
    "nation": X.TenantSpec("nation", "n_nationkey"),
    "customer": X.TenantSpec("customer", "n_nationkey", [X.Hop("nation", "c_nationkey", "n_nationkey")]),
    "orders": X.TenantSpec("orders", "n_nationkey", [X.Hop("customer", "o_custkey", "c_custkey"),
                                                     X.Hop("nation", "c_nationkey", "n_nationkey")]),
    "lineitem": X.TenantSpec("lineitem", "n_nationkey", [X.Hop("orders", "l_orderkey", "o_orderkey"),
                                                         X.Hop("customer", "o_custkey", "c_custkey"),
                                                         X.Hop("nation", "c_nationkey", "n_nationkey")]),
}


def _tables(spark, d, names=("nation", "customer", "orders", "lineitem")):
    return {n: table(spark, d, n) for n in names}


def hop3(spark, d):
    t = _tables(spark, d)
    out = X.extract(t, CHAIN["lineitem"])
    return sinks.with_load_stamp(X.plan_select(out), AS_OF)


HOP3_SQL = f"""
SELECT l.*, n.n_nationkey AS tenant_id, TIMESTAMP '{AS_OF}' AS load_date
FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey"""

query("tenant_hop3", HOP3_SQL)(hop3)


@query("tenant_hop2", f"""
SELECT o.*, n.n_nationkey AS tenant_id FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey
JOIN nation n ON c.c_nationkey = n.n_nationkey""")
def hop2(spark, d):
    return X.extract(_tables(spark, d), CHAIN["orders"])


@query("tenant_hop1", """
SELECT c.*, n.n_nationkey AS tenant_id FROM customer c JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE n.n_nationkey IN (3, 7, 19)""")
def hop1(spark, d):
    return X.extract(_tables(spark, d), CHAIN["customer"], tenants=TENANTS)


@query("tenant_filter", """
SELECT o.*, o.o_custkey AS tenant_id FROM orders o WHERE o.o_custkey IN (3, 7, 19)""")
def tenant_filter(spark, d):
    spec = X.TenantSpec("orders", "o_custkey")
    return X.extract({"orders": table(spark, d, "orders")}, spec, tenants=TENANTS)


@query("tenant_override", """
SELECT l.*, n.n_nationkey AS tenant_id FROM lineitem l JOIN supplier s ON l.l_suppkey = s.s_suppkey
JOIN nation n ON s.s_nationkey = n.n_nationkey WHERE n.n_nationkey = 7
UNION ALL
SELECT l.*, n.n_nationkey AS tenant_id FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey
JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey
WHERE n.n_nationkey IN (3, 19)""")
def tenant_override(spark, d):
    """Tenant 7 reaches lineitem through the supplier instead of the order chain."""
    t = _tables(spark, d, ("nation", "customer", "orders", "lineitem", "supplier"))
    overrides = {7: {"lineitem": X.TenantSpec("lineitem", "n_nationkey", [
        X.Hop("supplier", "l_suppkey", "s_suppkey"), X.Hop("nation", "s_nationkey", "n_nationkey")])}}
    # tenants sharing a spec are extracted in one job each
    groups: dict = {}
    for k in TENANTS:
        spec = X.merge_specs(CHAIN, overrides, k)["lineitem"]
        groups.setdefault(id(spec), (spec, []))[1].append(k)
    parts = [X.extract(t, spec, tenants=ks) for spec, ks in groups.values()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("semi_join_id_list", """
SELECT * FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT')""")
def semi_ids(spark, d):
    ids = table(spark, d, "orders").filter(F.col("o_orderpriority") == "1-URGENT")
    return X.semi_join_ids(table(spark, d, "lineitem"), ids, "l_orderkey", "o_orderkey")


@query("schema_select_list", "SELECT * FROM orders")
def schema_select(spark, d):
    return X.plan_select(table(spark, d, "orders"))


@query("create_like_empty", "SELECT * FROM customer WHERE 1 = 0")
def create_like(spark, d):
    return sinks.create_like(table(spark, d, "customer"), scratch_path(spark, "like"))


@query("json_roundtrip", "SELECT * FROM orders")
def json_roundtrip(spark, d):
    return sinks.write_json(X.plan_select(table(spark, d, "orders")), scratch_path(spark, "json"))


@query("parquet_load_date", f"""
SELECT c.*, TIMESTAMP '{AS_OF}' AS load_date, c.c_nationkey AS tenant_id FROM customer c""")
def parquet_load_date(spark, d):
    c = table(spark, d, "customer").withColumn("tenant_id", F.col("c_nationkey"))
    return sinks.load_table(c, scratch_path(spark, "lake"), AS_OF, partition_by=["tenant_id"])


@query("domain_copy", "SELECT * FROM nation")
def domain_copy(spark, d):
    path = scratch_path(spark, "domain")
    sinks.replace_target(table(spark, d, "nation"), path)
    return spark.read.parquet(path)


@query("full_refresh_copy", f"""
SELECT *, TIMESTAMP '{AS_OF}' AS copied_at FROM supplier""")
def full_refresh(spark, d):
    path = scratch_path(spark, "refresh")
    src = table(spark, d, "supplier")
    sinks.replace_target(src.limit(0), path)        # truncate
    sinks.replace_target(sinks.with_load_stamp(src, AS_OF, "copied_at"), path)
    return spark.read.parquet(path)


_CONTRACTS = f"""SELECT o_custkey AS cod_cliente, COUNT(*) AS qtd, CAST(max(o_orderpriority) AS VARCHAR) AS contract,
         TIMESTAMP '{AS_OF}' AS date_insert
  FROM orders GROUP BY o_custkey"""


def _archived(spark, d):
    """Two monthly runs of archive-and-clear over the contract and the account table; the second finds them empty."""
    contracts = (table(spark, d, "orders").groupBy(F.col("o_custkey").alias("cod_cliente"))
                 .agg(F.count(F.lit(1)).alias("qtd"), F.max("o_orderpriority").alias("contract")))
    accounts = table(spark, d, "customer").select(F.col("c_custkey").alias("cod_cliente"), F.col("c_mktsegment").alias("segment"))
    lake = Lake(spark, scratch_path(spark, "archive-lake"))
    base = lake.current()
    lake.commit(base, {"contracts": [lake.write(base, "contracts", contracts)], "accounts": [lake.write(base, "accounts", accounts)]})
    schemas = {"contracts": contracts.schema, "accounts": accounts.schema}
    histories = {"contracts_hist": ("contracts", lambda df: sinks.with_load_stamp(df, AS_OF, "date_insert")),
                 "accounts_hist": ("accounts", lambda df: sinks.with_load_stamp(df, AS_OF, "date_insert"))}
    for _ in range(2):
        archive_and_clear(lake, schemas, histories)
    stamp = {"contracts": "contracts_hist", "accounts": "accounts_hist"}
    schemas |= {h: sinks.with_load_stamp(spark.createDataFrame([], schemas[t]), AS_OF, "date_insert").schema for t, h in stamp.items()}
    return lake, schemas


@query("gated_history_append", f"""
SELECT * FROM ({_CONTRACTS})
WHERE (SELECT COUNT(*) FROM orders) > 0 AND (SELECT COUNT(*) FROM customer) > 0""")
def gated_history(spark, d):
    """History of the contracts: appended once, though the job ran twice."""
    lake, schemas = _archived(spark, d)
    return lake.read(lake.current(), "contracts_hist", schemas["contracts_hist"])


@query("archive_and_clear", f"""
SELECT 'contracts' AS table_name, 0 AS row_count UNION ALL SELECT 'accounts', 0
UNION ALL SELECT 'contracts_hist', COUNT(*) FROM ({_CONTRACTS}) UNION ALL SELECT 'accounts_hist', COUNT(*) FROM customer""")
def archive_and_clear_state(spark, d):
    """Rows of the four tables afterwards: the sources are cleared by the commit that shows the append."""
    lake, schemas = _archived(spark, d)
    now = lake.current()
    parts = [lake.read(now, t, schema).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
             for t, schema in schemas.items()]
    return reduce(DataFrame.unionByName, parts)


@query("long_text_split", f"""
SELECT doc_id, CASE WHEN length(text) > 30000 THEN substr(text, 1, 30000) ELSE text END AS text,
       lang, source, n_chars, coalesce(length(text) > 30000, false) AS text_truncated
FROM documents""")
def long_text(spark, d):
    return _long_text(spark, d)[0]


def _long_text(spark, d):
    """Cells over 30,000 characters: main output cut at the limit, full text in the side output."""
    return sinks.long_text_split(table(spark, d, "documents"), "text", 30000)


@query("long_text_side", "SELECT * FROM documents WHERE length(text) > 30000")
def long_text_side(spark, d):
    return _long_text(spark, d)[1]


@query("window_copy_6m", f"""
WITH {ctes('x10')}
SELECT * FROM x10
WHERE action_date >= TIMESTAMP '2001-02-02 00:00:00' AND action_date < TIMESTAMP '2001-08-02 00:00:00'""")
def window_copy(spark, d):
    return X.window_rows(fx.audit_trail(spark, d), "action_date", fx.AS_OF_AUDIT, 6)


@query("timed_load", f"""
WITH {ctes('x10')}
SELECT 'audit' AS load_name, COUNT(*) AS row_count, MIN(action_date) AS first_row, MAX(action_date) AS last_row, true AS timed FROM x10
WHERE action_date >= TIMESTAMP '2001-02-02 00:00:00' AND action_date < TIMESTAMP '2001-08-02 00:00:00'""")
def timed_load(spark, d):
    """The log of the six-month copy; counts and times are observed by the copy's own job."""
    rows = X.window_rows(fx.audit_trail(spark, d), "action_date", fx.AS_OF_AUDIT, 6)
    base = scratch_path(spark, "timed")
    log = timed_copy(rows, f"{base}/copy", f"{base}/log", "audit", "action_date")
    return log.select("load_name", "row_count", "first_row", "last_row",
                      (F.col("end_time") >= F.col("start_time")).alias("timed"))


def _purged(spark, d, as_of, days, per_server=None):
    snaps = fx.wait_snapshots(spark, d)
    path = scratch_path(spark, "retention")
    write_by_day(snaps, path, "server_name", "check_date")
    purge_days(spark, path, "server_name", "check_date", as_of, days, per_server)
    return spark.read.schema(snaps.withColumn("day", F.to_date("check_date")).schema).parquet(path).select(*snaps.columns)


@query("retention_purge", f"""
WITH {ctes('x1w')}
SELECT * FROM x1w WHERE check_date >= TIMESTAMP '2024-01-24 00:00:00'""")
def retention(spark, d):
    """Old days lose their folders; what is left is read back."""
    return _purged(spark, d, AS_OF, 7)


@query("retention_per_server", f"""
WITH {ctes('x1w')},
own AS (SELECT DISTINCT 'srv' || user_id % 5 AS server_name, 4 + 3 * (user_id % 5) AS keep FROM events WHERE user_id % 5 < 3)
SELECT x1w.* FROM x1w LEFT JOIN own USING (server_name)
WHERE check_date >= TIMESTAMP '2024-01-30 13:30:00' - to_days(CAST(coalesce(keep, 7) AS INTEGER))""")
def retention_per_server(spark, d):
    """A horizon per server, inside a day: that day's folder is rewritten, newer ones are not touched."""
    k = F.col("user_id") % 5
    own = (table(spark, d, "events").where(k < 3).select(F.concat(F.lit("srv"), k.cast("string")).alias("server_name"),
                                                         (4 + 3 * k).alias("retention_days")).distinct())
    return _purged(spark, d, "2024-01-30 13:30:00", 7, own)


@query("snapshot_append", f"""
WITH {ctes('x4')}
SELECT *, TIMESTAMP '{AS_OF}' AS logged_at FROM x4 WHERE command <> 'Sleep'""")
def snapshot_append(spark, d):
    path = scratch_path(spark, "activity")
    snap = sinks.with_load_stamp(fx.processlist(spark, d).filter(F.col("command") != "Sleep"), AS_OF, "logged_at")
    return sinks.append(snap, path)


@query("cdc_apply", f"""
WITH {ctes('x10')},
ch AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'D' ELSE 'U' END AS op, action_date AS changed_at,
              customer_id, 'F' AS action
       FROM x10 WHERE path_name = '1-URGENT'),
base AS (SELECT id, customer_id, action FROM x10)
SELECT b.* FROM base b WHERE NOT EXISTS (SELECT 1 FROM ch WHERE ch.id = b.id)
UNION ALL SELECT id, customer_id, action FROM ch WHERE op <> 'D'""")
def cdc_apply(spark, d):
    a = fx.audit_trail(spark, d)
    base = a.select("id", "customer_id", "action")
    changes = (a.filter(F.col("path_name") == "1-URGENT")
               .select("id", F.when(F.col("id") % 5 == 0, "D").otherwise("U").alias("op"),
                       F.col("action_date").alias("changed_at"), "customer_id", F.lit("F").alias("action")))
    lake = BucketedTable(Lake(spark, scratch_path(spark, "cdc-lake")), "audit", ["id"], "changed_at", buckets=16)
    lake.create(base, changes)
    schema = lake.schema(base, changes)
    # newer changes first: the older ones of the second batch must not win
    newer = F.col("changed_at") >= F.lit("1998-01-01").cast("timestamp_ntz")
    older = changes.where(F.col("id") % 3 == 0).select("id", F.lit("U").alias("op"), F.date_sub("changed_at", 1).cast("timestamp_ntz").alias("changed_at"),
                                                       "customer_id", F.lit("X").alias("action"))
    lake.apply(changes.where(newer), schema, 0)
    lake.apply(changes.where(~newer).unionByName(older), schema, 1)
    return lake.rows(schema)


@query("tenant_lake_load", HOP3_SQL)
def tenant_lake_load(spark, d):
    """The flagship extraction written to the lake: one write job, all tenants, partitioned by tenant."""
    out = hop3(spark, d)
    path = scratch_path(spark, "lake-lineitem")
    # shuffled on (tenant, hash salt): a hot tenant is written by several tasks, few files per tenant
    sinks.write_partitioned(out, path, "tenant_id", salt_buckets=8)
    return spark.read.parquet(path).select(*out.columns)


@query("report_export", f"""WITH {ctes('x4')}
SELECT 'long_running' AS report_name, 'long_running_20240131' AS file_name, COUNT(*) AS row_count FROM x4
WHERE lower(command) = 'query' AND "time" > 420 AND lower(state) = 'executing'
  AND lower("user") NOT IN ('rdsadmin', 'rdsrepladmin', 'system user', 'event_scheduler')
  AND (info IS NULL OR info NOT LIKE '%IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT%')
UNION ALL
SELECT 'documents', 'documents_20240131', COUNT(*) FROM documents""")
def report_export(spark, d):
    """Two result sets exported to dated CSV files (text cells kept whole)."""
    from opslake.operators.filters import long_running
    reports = {"long_running": long_running(fx.processlist(spark, d), 420),
               "documents": table(spark, d, "documents").select("doc_id", "lang", "source", "n_chars")}
    return sinks.export_reports(reports, scratch_path(spark, "reports"), AS_OF)
