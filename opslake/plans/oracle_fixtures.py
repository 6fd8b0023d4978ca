"""The fixtures X1-X10 as DuckDB SQL, for the independent oracle queries.

``ctes("x1", "x3")`` returns the ``name AS (...)`` list for a WITH clause.
Dependencies are added automatically.
"""

from __future__ import annotations

CENTS = "CAST(round({x} * 100) AS BIGINT)"


def c(x: str) -> str:
    return CENTS.format(x=x)


FIX = {}
DEPS = {"x1w": ["x1"], "x1f": ["x1"], "x1c": ["x1"], "x2s": ["x2"], "x2b": ["x2s", "x2"], "x6": ["x6l"]}

FIX["x1"] = f"""
  SELECT 'srv' || server_id AS server_name, check_date, metric,
         CAST(SUM(dv) OVER w AS BIGINT) AS wait_time_ms,
         CAST(SUM(ds) OVER w AS BIGINT) AS signal_wait_time_ms,
         CAST(SUM(dn) OVER w AS BIGINT) AS waiting_tasks_count,
         CAST(SUM(dw) OVER w AS BIGINT) AS num_of_writes
  FROM (SELECT user_id % 5 AS server_id, event_type AS metric, date_trunc('hour', ts) AS check_date,
               SUM(v) AS dv, COUNT(*) AS dn, SUM(v // 4) AS ds,
               SUM(CASE WHEN v % 2 = 0 THEN 1 ELSE 0 END) AS dw
        FROM (SELECT *, {c('value')} AS v FROM events) e
        GROUP BY 1, 2, 3) cell
  WINDOW w AS (PARTITION BY server_id, metric,
               CASE WHEN server_id = 0 THEN day(check_date) // 5 ELSE -1 END
               ORDER BY check_date ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"""

FIX["x1w"] = """
  SELECT server_name, check_date, metric AS wait_type, wait_time_ms * 256 AS wait_time_ms,
         signal_wait_time_ms * 256 AS signal_wait_time_ms, waiting_tasks_count, num_of_writes FROM x1"""

FIX["wl"] = """
  SELECT event_type AS wait_type, 'Category ' || length(event_type) % 3 AS wait_category, length(event_type) = 4 AS ignorable,
         event_type LIKE '%r%' AS never_acceptable FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'signup')"""

FIX["x1f"] = """
  SELECT server_name, check_date, metric AS file_name,
         CASE WHEN metric IN ('error', 'view') THEN 'LOG' ELSE 'ROWS' END AS type_desc,
         '/data/' || server_name || '/' || metric ||
           CASE WHEN metric IN ('error', 'view') THEN '.ldf' ELSE '.mdf' END AS physical_name,
         waiting_tasks_count AS num_of_reads, wait_time_ms AS io_stall_read_ms,
         wait_time_ms * 8192 AS bytes_read, num_of_writes, signal_wait_time_ms AS io_stall_write_ms,
         signal_wait_time_ms * 4096 AS bytes_written, waiting_tasks_count AS size_on_disk_mb
  FROM x1"""

FIX["x1c"] = """
  SELECT server_name, check_date, 'SQLServer:Stats' AS object_name, metric AS counter_name,
         '' AS instance_name, wait_time_ms AS cntr_value,
         CASE metric WHEN 'signup' THEN 65792 WHEN 'purchase' THEN 272696576
              WHEN 'click' THEN 537003264 WHEN 'view' THEN 1073939712 ELSE 1073874176 END AS cntr_type
  FROM x1"""

FIX["x2"] = f"""
  SELECT c_custkey AS session_id, 0 AS request_id,
         CASE WHEN c_custkey > 1 AND c_custkey % 7 <> 0 THEN c_custkey // 2 END AS blocking_session_id,
         'login' || (c_custkey % 13) AS login_name, 'host' || c_nationkey AS host_name,
         c_mktsegment AS program_name, 'db' || (c_custkey % 10) AS database_name,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) AS login_time,
         TIMESTAMP '2024-01-01 00:00:00' + to_seconds(c_custkey) + to_minutes(c_nationkey) AS start_time,
         abs({c('c_acctbal')}) AS wait_time_ms, (c_custkey % 1000) * 3 AS cpu_time,
         abs({c('c_acctbal')}) AS reads, CAST(c_nationkey AS BIGINT) * 11 AS writes,
         c_custkey % 17 AS tempdb_pages,
         CASE WHEN c_custkey > 1 AND c_custkey % 7 <> 0 THEN 'suspended'
              WHEN c_custkey % 3 = 0 THEN 'sleeping' ELSE 'running' END AS status
  FROM customer"""

FIX["x2s"] = """
  SELECT *, 'srv0' AS server_name FROM x2 UNION ALL BY NAME
  SELECT * REPLACE (CASE WHEN session_id > 2 AND session_id % 5 <> 0 THEN session_id // 3 END AS blocking_session_id,
                    cpu_time + 1 AS cpu_time, writes + 2 AS writes), 'srv1' AS server_name FROM x2"""

FIX["x2b"] = """
  SELECT * REPLACE (cpu_time + (session_id % 23) * 5 AS cpu_time,
                    reads + CASE WHEN server_name = 'srv0' THEN session_id % 100 ELSE session_id % 50 END AS reads,
                    writes + session_id % 9 AS writes, tempdb_pages + 1 AS tempdb_pages)
  FROM x2s WHERE CASE WHEN server_name = 'srv0' THEN session_id % 4 <> 0 ELSE session_id % 6 <> 0 END"""

FIX["x3"] = f"""
  SELECT 'srv' || (user_id % 3) AS server_name, 'guid' || ((user_id // 60) % 2) AS database_guid,
         'db' || (user_id % 10) AS database_name, event_id AS backup_set_id,
         CASE event_type WHEN 'signup' THEN 'D' WHEN 'purchase' THEN 'I' ELSE 'L' END AS type,
         ts AS backup_start_date, ts + to_milliseconds({c('value')} * 10) AS backup_finish_date,
         event_id * 1000 AS first_lsn, event_id * 1000 + 1000 AS last_lsn,
         {c('value')} * 1048576 AS backup_size,
         CASE WHEN event_id % 4 = 0 THEN {c('value')} * 1048576 ELSE ({c('value')} * 1048576) // 2 END
           AS compressed_backup_size,
         CASE WHEN user_id % 3 = 0 THEN 'svc_agent' ELSE 'u' || (user_id % 4) END AS user_name,
         event_id % 6 <> 0 AS has_backup_checksums, event_id % 97 = 0 AS is_password_protected,
         event_id % 89 = 0 AS is_snapshot, event_id % 83 = 0 AS is_readonly,
         event_id % 79 = 0 AS is_single_user, event_id % 73 = 0 AS is_damaged,
         event_id % 71 = 0 AS has_bulk_logged_data,
         CASE WHEN event_id % 67 = 0 THEN 'CERTIFICATE' END AS encryptor_type,
         CASE WHEN event_id % 11 = 0 THEN 'SIMPLE' WHEN event_id % 13 = 0 THEN 'BULK-LOGGED'
              ELSE 'FULL' END AS recovery_model,
         CASE WHEN event_id % 29 = 0 THEN 110 WHEN event_id % 31 = 0 THEN 120 ELSE 150 END
           AS compatibility_level
  FROM events"""

FIX["x4"] = f"""
  SELECT event_id AS id,
         CASE WHEN user_id % 11 = 0 THEN 'system user' WHEN user_id % 13 = 0 THEN 'rdsadmin'
              WHEN user_id % 17 = 0 THEN 'event_scheduler' ELSE 'u' || user_id END AS "user",
         'h' || (user_id % 7) || ':' || (3306 + event_id % 100) AS host, 'db' || (user_id % 10) AS db,
         CASE WHEN user_id % 11 = 0 THEN 'Connect' WHEN event_type = 'view' THEN 'Sleep'
              WHEN event_type = 'signup' THEN 'Binlog Dump' ELSE 'Query' END AS command,
         {c('value')} // 10 AS "time",
         CASE WHEN user_id % 11 = 0 THEN
                CASE event_id % 5 WHEN 0 THEN 'Waiting for master' WHEN 1 THEN 'Reading event from the relay log'
                     WHEN 2 THEN '' WHEN 3 THEN 'Queueing master event to the relay log'
                     ELSE 'Slave has read all relay log' END
              WHEN event_type = 'click' THEN 'Sending data'
              WHEN event_type = 'purchase' THEN 'Waiting for table metadata lock'
              WHEN event_type = 'error' THEN 'executing' WHEN event_type = 'view' THEN '' ELSE 'starting' END AS state,
         CASE WHEN event_id % 11 = 0 THEN NULL
              WHEN event_id % 13 = 0 THEN props || ' /* IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT */'
              ELSE props END AS info, ts AS sample_time
  FROM events"""

FIX["x5"] = f"""
  SELECT 'db' || (p_size % 3) AS database_name, CASE WHEN p_partkey % 6 = 0 THEN 'audit' ELSE 'dbo' END AS schema_name, p_brand AS table_name,
         p_partkey AS index_id, 'ix_' || p_partkey AS index_name,
         p_type || ',' || p_size AS key_columns, p_type AS first_key_column,
         CASE WHEN p_partkey % 3 = 0 THEN p_name END AS include_columns,
         CASE WHEN p_partkey % 50 = 0 THEN 'HEAP' WHEN p_partkey % 10 = 0 THEN 'CLUSTERED'
              ELSE 'NONCLUSTERED' END AS index_type,
         p_partkey % 40 = 0 AS is_primary_key, p_partkey % 5 = 0 AS is_unique,
         p_partkey % 97 = 0 AS is_disabled,
         CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE (p_partkey % 7) * 100 END AS user_seeks,
         CASE WHEN p_partkey % 4 = 0 THEN 0 ELSE (p_partkey % 5) * 10 END AS user_scans,
         CAST(0 AS BIGINT) AS user_lookups, (p_partkey % 11) * 1500 AS user_updates,
         {c('p_retailprice')} AS total_pages, ({c('p_retailprice')} * 3) // 4 AS used_pages,
         p_partkey * 37 + p_size AS row_count,
         TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 40 AS INTEGER)) AS create_date,
         TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 40 AS INTEGER))
           + to_days(CAST(p_partkey % 3 AS INTEGER)) AS modify_date,
         p_size % 6 + 1 AS key_column_count, p_partkey % 4 AS include_column_count,
         (p_partkey % 13) * 40000 AS row_lock_wait_ms, (p_partkey % 17) * 20000 AS page_lock_wait_ms,
         (p_partkey % 23) * 100 AS forwarded_fetch_count, p_partkey % 19 AS leaf_delete_count,
         TIMESTAMP '2024-01-31 00:00:00' - to_days(CAST(p_partkey % 40 AS INTEGER))
           - to_days(CAST(p_partkey % 60 AS INTEGER)) AS stats_updated,
         p_partkey * 5 AS modification_counter,
         ((p_partkey * 37 + p_size) * (p_partkey % 100)) // 100 AS rows_sampled,
         1 + p_partkey % 9 AS uptime_days
  FROM part"""

FIX["x5c"] = """
  SELECT 'db' || (p_size % 3) AS database_name, CASE WHEN p_partkey % 6 = 0 THEN 'audit' ELSE 'dbo' END AS schema_name, p_brand AS table_name,
         p_name || '_' || p_partkey AS column_name,
         CASE WHEN p_type IN ('ECONOMY', 'STANDARD') THEN 'nvarchar' ELSE 'int' END AS data_type,
         p_size % 2 = 0 AS is_nullable, p_size * 10 AS max_length
  FROM part"""

FIX["x6l"] = """
  SELECT l.*, o.o_orderdate,
         row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey,
             l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS rn,
         count(*) OVER (PARTITION BY l_orderkey) AS n_lines
  FROM lineitem l JOIN orders o ON l.l_orderkey = o.o_orderkey"""

FIX["x6"] = f"""
  SELECT l_orderkey AS event_id, o_orderdate AS event_date,
         'p' || l_orderkey || '_' || rn AS process_id, l_suppkey AS spid,
         'db' || (l_partkey % 5) AS currentdbname,
         CASE l_returnflag WHEN 'R' THEN 'serializable (4)' WHEN 'A' THEN 'repeatable read (3)'
              ELSE 'read committed (2)' END AS isolationlevel,
         CASE WHEN l_quantity > 45 THEN 'background' WHEN l_linestatus = 'O' THEN 'suspended'
              ELSE 'sleeping' END AS status,
         l_partkey % 5 + 5 AS currentdb, CAST(l_linenumber % 4 - 2 AS BIGINT) AS priority, {c('l_extendedprice')} % 9973 AS logused,
         'KEY: ' || (l_partkey % 5 + 5) || ':' || (l_partkey * 1000 + l_suppkey) AS waitresource,
         o_orderdate AS lasttranstarted, l_shipdate AS lastbatchstarted,
         l_shipdate + to_hours(CAST(l_linenumber AS BIGINT)) AS lastbatchcompleted,
         CASE WHEN l_orderkey % 7 = 0 THEN 'lock_deadlock' WHEN l_orderkey % 3 = 0 THEN 'database_xml_deadlock_report'
              WHEN l_orderkey % 5 = 0 THEN 'xml_deadlock_report_filtered' ELSE 'xml_deadlock_report' END AS event_name,
         CASE WHEN l_partkey % 17 = 0 THEN 'SQLAgent - TSQL JobStep (Job 0x' || lpad(CAST(l_partkey % 40 AS VARCHAR), 32, '0')
              || ' : Step ' || l_linenumber || ')' ELSE 'app' || (l_partkey % 3) END AS clientapp, 'host' || (l_suppkey % 4) AS hostname,
         'login' || (l_suppkey % 6) AS loginname, {c('l_quantity')} AS waittime,
         CASE WHEN l_discount < 0.03 THEN 'S' WHEN l_discount < 0.06 THEN 'U' ELSE 'X' END AS lockmode,
         l_linenumber % 3 AS trancount,
         CASE WHEN l_tax = 0 THEN 'implicit_transaction' ELSE 'user_transaction' END AS transactionname,
         {c('l_extendedprice')} % 65536 AS clientoption1, (l_partkey % 128) * 8388608 AS clientoption2,
         CASE WHEN l_partkey % 3 = 0 THEN 'adhoc' ELSE 'db.dbo.proc' || (l_partkey % 20) END AS procname,
         '0x' || l_partkey AS sqlhandle,
         rn = n_lines AS is_victim, rn, n_lines,
         ['keylock', 'pagelock', 'objectlock', 'ridlock', 'rowgrouplock', 'exchangeEvent'][l_partkey % 6 + 1]
           AS lock_kind,
         l_partkey % 5 + 5 AS dbid,
         'db' || (l_partkey % 5) || '.dbo.t' || (l_partkey % 10) AS objectname,
         'ix' || (l_partkey % 4) AS indexname,
         l_partkey * 1000 + l_suppkey AS associated_object_id
  FROM x6l"""

FIX["x7"] = f"""
  SELECT l_partkey AS query_hash, COUNT(*) AS execution_count,
         CAST(SUM(CAST(l_quantity AS BIGINT)) * 1000 AS BIGINT) AS total_worker_time,
         MIN(CAST(l_quantity AS BIGINT)) * 1000 AS min_worker_time,
         MAX(CAST(l_quantity AS BIGINT)) * 1000 AS max_worker_time,
         CAST(SUM({c('l_extendedprice')}) AS BIGINT) AS total_logical_reads,
         CAST(SUM({c('l_tax')}) AS BIGINT) AS total_logical_writes,
         CAST(SUM(CAST(l_quantity AS BIGINT) * 1000 + l_linenumber * 500) AS BIGINT) AS total_elapsed_time,
         CAST(SUM(l_linenumber) AS BIGINT) AS total_rows,
         MAX(l_linenumber) * 1024 AS max_grant_kb, MIN(l_linenumber) * 1024 AS max_used_grant_kb,
         CAST(SUM(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS total_spills,
         MIN(l_shipdate) AS creation_time, MAX(l_shipdate) AS last_execution_time,
         MAX(l_linenumber) * 3 AS query_cost, COUNT(DISTINCT l_suppkey) AS plan_count, MAX(l_linenumber) * 800 AS avg_compile_ms,
         MIN({c('l_extendedprice')}) AS min_price, MAX({c('l_extendedprice')}) AS max_price
  FROM lineitem GROUP BY l_partkey"""

FIX["x7h"] = f"""
  SELECT l_partkey AS query_hash, CAST(date_trunc('month', l_shipdate) AS TIMESTAMP) AS check_date, COUNT(*) AS execution_count,
         CAST(SUM(CAST(l_quantity AS BIGINT)) * 1000 AS BIGINT) AS total_worker_time,
         CAST(SUM({c('l_extendedprice')}) AS BIGINT) AS total_logical_reads,
         CAST(SUM({c('l_tax')}) AS BIGINT) AS total_logical_writes,
         CAST(SUM(CAST(l_quantity AS BIGINT) * 1000 + l_linenumber * 500) AS BIGINT) AS total_elapsed_time,
         CAST(MAX(l_linenumber) * 1024 AS BIGINT) AS max_grant_kb,
         CAST(SUM(CASE WHEN l_discount >= 0.09 THEN 1 ELSE 0 END) AS BIGINT) AS total_spills
  FROM lineitem GROUP BY ALL"""

FIX["x9g"] = """
  SELECT 'r' || r_regionkey AS "user", '%' AS host, r_regionkey % 2 = 0 AS select_priv,
         r_regionkey % 3 = 0 AS insert_priv, r_regionkey = 4 AS update_priv, r_regionkey = 3 AS delete_priv
  FROM region"""

FIX["x9d"] = """
  SELECT 'n' || n_nationkey AS "user", '%' AS host, 'db' || n_regionkey AS db,
         n_nationkey % 2 = 0 AS select_priv, n_nationkey % 3 = 0 AS insert_priv,
         n_nationkey % 5 = 0 AS update_priv, n_nationkey % 7 = 0 AS delete_priv
  FROM nation"""

FIX["x9t"] = """
  SELECT 's' || (s_suppkey % 20) AS "user", '%' AS host, 'db' || (s_nationkey % 5) AS db,
         't' || (s_suppkey % 10) AS table_name,
         CASE s_suppkey % 4 WHEN 0 THEN 'Select' WHEN 1 THEN 'Select,Insert'
              WHEN 2 THEN 'Update,Delete' ELSE 'Insert' END AS table_priv
  FROM supplier"""

FIX["x10"] = f"""
  SELECT o_orderkey AS id, o_custkey % 100 AS user_account_id, o_custkey AS customer_id,
         'order' AS entity_name, o_orderpriority AS path_name, o_orderkey AS entity_id,
         o_orderstatus AS action, CAST(NULL AS VARCHAR) AS old_value,
         CAST({c('o_totalprice')} AS VARCHAR) AS new_value, o_orderdate AS action_date
  FROM orders"""

FIX["cat"] = """
  SELECT source AS table_schema, lang AS table_name, COUNT(*) AS table_rows,
         CAST(SUM(n_chars) * 1024 AS BIGINT) AS data_length, CAST(SUM(n_chars) * 8 AS BIGINT) AS index_length,
         COUNT(*) * 16384 AS data_free
  FROM documents GROUP BY source, lang"""

FIX["dbf"] = """
  SELECT source AS database_name, doc_id AS file_id,
         CASE WHEN lang = 'en' THEN 'ROWS' ELSE 'LOG' END AS type_desc, n_chars AS size_pages
  FROM documents"""


def ctes(*names: str) -> str:
    order: list[str] = []

    def add(n):
        for dep in DEPS.get(n, []):
            add(dep)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return ",\n".join(f"{n} AS ({FIX[n]})" for n in order)


# plan cache (for age / single-use shares): one plan per (user, event type, day)
FIX["xpc"] = f"""
  SELECT user_id * 100 + day(ts) AS plan_handle, event_type || '_' || (user_id % 10) AS query_hash,
         MIN(ts) AS creation_time, MAX(ts) AS last_execution_time, COUNT(*) AS execution_count,
         CAST(SUM({c('value')}) AS BIGINT) AS total_worker_time
  FROM events GROUP BY user_id, event_type, day(ts)"""

# findings log (for roll-ups): one finding per event
FIX["xfi"] = """
  SELECT event_id AS id, (user_id % 4 + 1) * 10 AS priority, event_type AS findings_group,
         'finding ' || (user_id % 3) AS finding, 'srv' || (user_id % 5) AS server_name, ts AS check_date,
         'details ' || event_id AS details
  FROM events"""


def sql_round_div(num: str, den: str, scale: int = 0) -> str:
    """DuckDB twin of ``semantics.round_div`` (integer half-up, as double)."""
    m = 10 ** scale
    return f"(CAST((({num}) * {m} * 2 + ({den})) // (({den}) * 2) AS DOUBLE) / {m}.0)"


def sql_fixed(num: str, den: str, scale: int) -> str:
    """DuckDB twin of ``semantics.fixed_text``."""
    m = 10 ** scale
    k = f"((({num}) * {m} * 2 + ({den})) // (({den}) * 2))"
    if scale == 0:
        return f"CAST({k} AS VARCHAR)"
    return f"(CAST({k} // {m} AS VARCHAR) || '.' || lpad(CAST({k} % {m} AS VARCHAR), {scale}, '0'))"


def sql_human(x: str, gb_scale: int = 1, sep: str = "") -> str:
    kb, mb, gb = 1024, 1024 ** 2, 1024 ** 3
    return (f"CASE WHEN {x} >= {gb} THEN {sql_fixed(x, str(gb), gb_scale)} || '{sep}GB' "
            f"WHEN {x} >= {mb} THEN {sql_fixed(x, str(mb), 2)} || '{sep}MB' "
            f"ELSE {sql_fixed(x, str(kb), 2)} || '{sep}KB' END")
