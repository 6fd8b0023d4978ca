"""Queries for deadlock graphs.

The Spark side shreds the XML documents of X6; the oracle computes the same
facts straight from the relational lineitem rows the documents were built from.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions.scalar import wait_text
from opslake.operators import deadlocks as X
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx

_OW = f"""WITH {ctes('x6')},
ow AS (SELECT * EXCLUDE (rn) FROM (
         SELECT event_id, event_date, lock_kind, dbid, objectname, indexname, lag(lockmode) OVER e AS mode,
                associated_object_id, lag(process_id) OVER e AS owner_id, lag(lockmode) OVER e AS owner_mode,
                process_id AS waiter_id, lockmode AS waiter_mode, rn
         FROM x6 WINDOW e AS (PARTITION BY event_id ORDER BY rn)) WHERE rn > 1)"""


def _parsed(spark, d, sections=X.ALL_SECTIONS, fields=None):
    return X.parse(fx.deadlock_xml(spark, d), sections=sections, fields=fields)


_SIDES = ("owner-list", "waiter-list")


@query("xml_event_filter", f"""WITH {ctes('x6')}
SELECT event_id, event_date, COUNT(*) AS processes FROM x6
WHERE event_date >= TIMESTAMP '1997-01-01 00:00:00' AND event_date < TIMESTAMP '1998-01-01 00:00:00'
  AND event_name <> 'lock_deadlock'
GROUP BY event_id, event_date HAVING bool_or(currentdbname = 'db3')""")
def event_filter(spark, d):
    return X.event_filter(_parsed(spark, d, ("processes",)), "1997-01-01 00:00:00", "1998-01-01 00:00:00", "db3")


_PCOLS = ("event_id, event_date, process_id, spid, currentdb, currentdbname, priority, logused, waitresource, "
          "lasttranstarted, lastbatchstarted, lastbatchcompleted, isolationlevel, status, clientapp, hostname, "
          "loginname, waittime, CAST(trancount AS BIGINT) AS trancount, transactionname, clientoption1, "
          "clientoption2, lockmode, is_victim")


@query("xml_processes", f"WITH {ctes('x6')} SELECT {_PCOLS} FROM x6")
def xml_processes(spark, d):
    return X.processes(_parsed(spark, d, ("victims", "processes"))).drop("frames")


@query("xml_frames", f"WITH {ctes('x6')} SELECT DISTINCT event_id, event_date, process_id, procname, sqlhandle FROM x6")
def xml_frames(spark, d):
    return X.frames(_parsed(spark, d, ("processes",), ("_id", "executionStack")))


@query("xml_owner_waiter", _OW + " SELECT * FROM ow")
def xml_owner_waiter(spark, d):
    return X.owner_waiter(_parsed(spark, d, ("resources",)))


_WHO = "concat_ws(' / ', loginname, clientapp, hostname)"
_JOB = "regexp_extract(clientapp, 'Job 0x([0-9]+) : Step ([0-9]+)', {})"
_OWN_DB = "split_part(objectname, '.', 1)"


@query("deadlock_findings", _OW + f""",
sel AS (SELECT DISTINCT event_date, {_OWN_DB} AS db FROM ow
        WHERE owner_mode IN ('S', 'IS') OR waiter_mode IN ('S', 'IS') OR mode IN ('S', 'IS')),
fr AS (SELECT DISTINCT currentdbname, process_id, procname FROM x6 WHERE procname <> 'adhoc')
SELECT 1 AS check_id, 'Total Database Deadlocks' AS finding_group, currentdbname AS database_name, '-' AS object_name,
       COUNT(DISTINCT event_date) AS events FROM x6 GROUP BY ALL
UNION ALL SELECT 2, 'Total Deadlocks Involving Selects', db, '-', COUNT(*) FROM sel GROUP BY ALL
UNION ALL SELECT 3, 'Total Object Deadlocks', {_OWN_DB}, objectname, COUNT(DISTINCT event_date) FROM ow GROUP BY ALL
UNION ALL SELECT 3, 'Total Index Deadlocks', {_OWN_DB}, indexname, COUNT(DISTINCT event_date) FROM ow WHERE lock_kind <> 'ridlock' GROUP BY ALL
UNION ALL SELECT 3, 'Total Heap Deadlocks', {_OWN_DB}, indexname, COUNT(DISTINCT event_date) FROM ow WHERE lock_kind = 'ridlock' GROUP BY ALL
UNION ALL SELECT 4, 'Serializable Deadlocking', currentdbname, '-', COUNT(DISTINCT event_date) FROM x6
          WHERE isolationlevel LIKE 'serializable%' GROUP BY ALL
UNION ALL SELECT 5, 'Repeatable Read Deadlocking', currentdbname, '-', COUNT(DISTINCT event_date) FROM x6
          WHERE isolationlevel LIKE 'repeatable%' GROUP BY ALL
UNION ALL SELECT 6, 'Login, App, and Host deadlocks', currentdbname, {_WHO}, COUNT(DISTINCT event_date) FROM x6 GROUP BY ALL
UNION ALL SELECT 9, 'Stored Procedure Deadlocks', currentdbname, procname, COUNT(DISTINCT process_id) FROM fr GROUP BY ALL
UNION ALL SELECT 13, 'Agent Job Deadlocks', currentdbname, 'Job: ' || {_JOB.format(1)} || ' Step: ' || {_JOB.format(2)},
          COUNT(DISTINCT event_date) FROM x6 WHERE clientapp LIKE 'SQLAgent%' GROUP BY ALL
UNION ALL SELECT 14, 'Total parallel deadlocks', '-', '-', COUNT(DISTINCT event_date) FROM ow WHERE lock_kind = 'exchangeEvent' HAVING COUNT(*) > 0
UNION ALL SELECT 15, 'Total deadlocks involving sleeping sessions', '-', '-', COUNT(DISTINCT event_date) FROM x6
          WHERE status = 'sleeping' HAVING COUNT(*) > 0
UNION ALL SELECT 15, 'Total deadlocks involving background processes', '-', '-', COUNT(DISTINCT event_date) FROM x6
          WHERE status = 'background' HAVING COUNT(*) > 0
UNION ALL SELECT 16, 'Total implicit transaction deadlocks', '-', '-', COUNT(DISTINCT event_date) FROM x6
          WHERE transactionname = 'implicit_transaction' HAVING COUNT(*) > 0""")
def deadlock_findings(spark, d):
    return X.findings(_parsed(spark, d, ("processes", "resources"), (
        "_id", "_currentdbname", "_isolationlevel", "_loginname", "_clientapp", "_hostname", "_status", "_transactionname",
        "executionStack", "_objectname", "_indexname", "_mode", *_SIDES)))


@query("lock_types_text", _OW + """
SELECT objectname, string_agg(DISTINCT lock_kind, ', ' ORDER BY lock_kind) AS lock_kinds FROM ow GROUP BY objectname""")
def lock_types(spark, d):
    ow = X.owner_waiter(_parsed(spark, d, ("resources",), ("_objectname", *_SIDES)), ["objectname", "lock_kind"])
    return ow.groupBy("objectname").agg(F.array_join(F.array_sort(F.collect_set("lock_kind")), ", ").alias("lock_kinds"))


def _bits_sql(c, table):
    return "substring(" + " || ".join(f"CASE WHEN {c} & {b} = {b} THEN ', {n}' ELSE '' END" for b, n in table) + ", 3, 500)"


@query("bitmask_names", f"""WITH {ctes('x6')}
SELECT event_id, process_id, clientoption1, clientoption2,
       {_bits_sql('clientoption1', X.CLIENT_OPTIONS_1)} AS client_option_1,
       {_bits_sql('clientoption2', X.CLIENT_OPTIONS_2)} AS client_option_2 FROM x6""")
def bitmask(spark, d):
    p = X.processes(_parsed(spark, d, ("processes",), ("_id", "_clientoption1", "_clientoption2")),
                    ["process_id", "clientoption1", "clientoption2"])
    return p.select("event_id", "process_id", "clientoption1", "clientoption2",
                    X.bit_names(F.col("clientoption1"), X.CLIENT_OPTIONS_1).alias("client_option_1"),
                    X.bit_names(F.col("clientoption2"), X.CLIENT_OPTIONS_2).alias("client_option_2"))


@query("deadlock_report", _OW + """
SELECT dense_rank() OVER (ORDER BY p.event_date) AS event_number, p.event_id, p.event_date, p.process_id, p.is_victim,
       p.loginname, p.currentdbname, w.objectname AS waiting_on, w.waiter_mode, o.objectname AS owning,
       o.owner_mode
FROM x6 p LEFT JOIN ow w ON w.event_id = p.event_id AND w.waiter_id = p.process_id
LEFT JOIN ow o ON o.event_id = p.event_id AND o.owner_id = p.process_id""")
def deadlock_report(spark, d):
    p, ow = X.process_locks(_parsed(spark, d, fields=("_id", "_loginname", "_currentdbname", "_objectname", *_SIDES)),
                            ["process_id", "is_victim", "loginname", "currentdbname"],
                            ["owner_id", "owner_mode", "waiter_id", "waiter_mode", "objectname"])
    p = X.with_event_number(p)
    w = ow.select("event_id", F.col("waiter_id").alias("process_id"), F.col("objectname").alias("waiting_on"),
                  "waiter_mode")
    o = ow.select("event_id", F.col("owner_id").alias("process_id"), F.col("objectname").alias("owning"),
                  "owner_mode")
    return (p.join(w, ["event_id", "process_id"], "left")
            .join(o, ["event_id", "process_id"], "left")
            .select("event_number", "event_id", "event_date", "process_id", "is_victim", "loginname",
                    "currentdbname", "waiting_on", "waiter_mode", "owning", "owner_mode"))


@query("event_numbering", f"""WITH {ctes('x6')}
SELECT dense_rank() OVER (ORDER BY event_date) AS event_number, event_id, event_date, process_id, spid,
       row_number() OVER (PARTITION BY event_id ORDER BY process_id) - 1 AS query_number,
       row_number() OVER (PARTITION BY spid ORDER BY event_date, event_id, process_id) AS id_number FROM x6""")
def event_numbering(spark, d):
    return X.event_numbers(X.processes(_parsed(spark, d, ("processes",), ("_id", "_spid")), ["process_id", "spid"]))


_DIMS = {"loginname": "loginname", "clientapp": "clientapp", "hostname": "hostname", "isolationlevel": "isolationlevel",
         "login/app/host": _WHO, "agent job": f"CASE WHEN clientapp LIKE 'SQLAgent%' THEN {_JOB.format(1)} END"}
_LOCK_DIMS = {"object": "objectname", "index": "CASE WHEN lock_kind <> 'ridlock' THEN indexname END",
              "heap": "CASE WHEN lock_kind = 'ridlock' THEN indexname END"}


@query("event_counts_by_dim", _OW + ", l AS (" + " UNION ALL ".join(
    [f"SELECT '{n}' AS dimension, currentdbname AS database_name, {e} AS value, event_id FROM x6" for n, e in _DIMS.items()]
    + [f"SELECT '{n}', {_OWN_DB}, {e}, event_id FROM ow" for n, e in _LOCK_DIMS.items()]) + """)
SELECT dimension, database_name, value, COUNT(DISTINCT event_id) AS events FROM l WHERE value IS NOT NULL GROUP BY ALL
UNION ALL SELECT dimension, database_name, NULL, COUNT(DISTINCT event_id) FROM l WHERE value IS NOT NULL GROUP BY ALL""")
def event_counts(spark, d):
    return X.dimension_counts(_parsed(spark, d, ("processes", "resources"), (
        "_currentdbname", "_loginname", "_clientapp", "_hostname", "_isolationlevel", "_objectname", "_indexname")))


_WT = "lpad(CAST({x} AS VARCHAR), {n}, '0')"


@query("wait_by_object", _OW + f""",
o AS (SELECT split_part(ow.objectname, '.', 1) AS database_name, ow.objectname, CAST(SUM(p.waittime) AS BIGINT) AS wait_ms FROM ow
      JOIN x6 p ON p.event_id = ow.event_id AND p.process_id = ow.waiter_id GROUP BY ALL),
t AS (SELECT * FROM o UNION ALL SELECT database_name, NULL, CAST(SUM(wait_ms) AS BIGINT) FROM o GROUP BY ALL)
SELECT database_name, objectname, wait_ms,
       {_WT.format(x='wait_ms // 86400000', n=2)} || ' ' || {_WT.format(x='(wait_ms // 3600000) % 24', n=2)} || ':' ||
       {_WT.format(x='(wait_ms // 60000) % 60', n=2)} || ':' || {_WT.format(x='(wait_ms // 1000) % 60', n=2)} || ':' ||
       {_WT.format(x='wait_ms % 1000', n=3)} AS wait_text FROM t""")
def wait_by_object(spark, d):
    return X.waits(_parsed(spark, d, ("processes", "resources"), ("_id", "_waittime", "_objectname", *_SIDES))).withColumn("wait_text", wait_text("wait_ms"))


@query("or_join_split", _OW + """
SELECT DISTINCT p.event_id, p.process_id, ow.lock_kind, ow.objectname FROM x6 p
JOIN ow ON ow.event_id = p.event_id AND (ow.owner_id = p.process_id OR ow.waiter_id = p.process_id)""")
def or_join(spark, d):
    p, ow = X.process_locks(_parsed(spark, d, ("processes", "resources"), ("_id", "_objectname", *_SIDES)), ["process_id"], ["owner_id", "waiter_id", "lock_kind", "objectname"])
    # OR of two equi conditions = union of two equi joins, then distinct
    a = p.join(ow.withColumnRenamed("owner_id", "process_id"), ["event_id", "process_id"])
    b = p.join(ow.withColumnRenamed("waiter_id", "process_id"), ["event_id", "process_id"])
    cols = ["event_id", "process_id", "lock_kind", "objectname"]
    return a.select(*cols).unionByName(b.select(*cols)).distinct()


# Plan-node rules: each rule is data (name, XPath, kind, threshold); one generic job evaluates them all.
NODE_RULES = [
    ("parallel_exchange", "boolean(//resource-list/exchangeEvent)", "boolean", None),
    ("serializable_process", "boolean(//process[starts-with(@isolationlevel, 'serializable')])", "boolean", None),
    ("long_total_wait", "sum(//process/@waittime)", "double", 10000.0),
    ("many_processes", "count(//process)", "double", 6.0),
]


@query("xml_node_rules", f"""WITH {ctes('x6')},
e AS (SELECT event_id, bool_or(lock_kind = 'exchangeEvent' AND rn > 1) AS ex, bool_or(isolationlevel LIKE 'serializable%') AS se,
             CAST(SUM(waittime) AS DOUBLE) AS tw, CAST(COUNT(*) AS DOUBLE) AS np FROM x6 GROUP BY event_id)
SELECT event_id, 'parallel_exchange' AS rule_name, 1.0::DOUBLE AS value FROM e WHERE ex
UNION ALL SELECT event_id, 'serializable_process', 1.0::DOUBLE FROM e WHERE se
UNION ALL SELECT event_id, 'long_total_wait', tw FROM e WHERE tw > 10000
UNION ALL SELECT event_id, 'many_processes', np FROM e WHERE np > 6""")
def xml_node_rules(spark, d):
    x = fx.deadlock_xml(spark, d)
    # one expression for all rules, so a document is loaded once: its values as text, a space after each
    paths = [f"concat(number({path}), ' ')" for _, path, _, _ in NODE_RULES]
    x = x.select("event_id", F.split(F.xpath_string("deadlock_graph", F.lit(f"concat({', '.join(paths)}, '')")), " ").alias("v"))
    vals = [F.struct(F.lit(name).alias("rule_name"), F.col("v")[i].cast("double").alias("value")) for i, (name, _, _, _) in enumerate(NODE_RULES)]
    r = x.select("event_id", F.explode(F.array(*vals)).alias("r")).select("event_id", "r.rule_name", "r.value")
    cond = None
    for name, _, kind, thr in NODE_RULES:
        c = (F.col("rule_name") == name) & ((F.col("value") > 0) if kind == "boolean" else (F.col("value") > thr))
        cond = c if cond is None else cond | c
    return r.filter(cond)
