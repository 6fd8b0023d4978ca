"""Operational tables derived from the driver tables (FIXTURES.md, X1-X10).

The source scripts read telemetry and catalog tables of live servers; here
those tables are derived from the given Parquet tables with DataFrame
expressions, so every query's work grows with the input.  Money and float
amounts become integer hundredths (``cents``) before any sum.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from opslake.functions.semantics import cents, ts_lit
from opslake.sources.tables import table

# Fixed values of the fixtures (reference dates for "now").
AS_OF_EVENTS = "2024-01-31 00:00:00"
AS_OF_AUDIT = "2001-08-02 00:00:00"


def _s(prefix: str, c) -> F.Column:
    return F.concat(F.lit(prefix), c.cast("string"))


def _add(unit: str, n, ts) -> F.Column:
    return F.timestamp_add(unit, n, ts)


# X1 ---------------------------------------------------------------------------
def snapshots(spark: SparkSession, d: str) -> DataFrame:
    """Cumulative counters per (server, metric, hourly check_date).

    Server 0 restarts its counters every 5 days, so the first snapshot after a
    restart has falling counters (restart guard); hours without events for a
    server are missing snapshots (gap guard).
    """
    ev = table(spark, d, "events")
    v = cents("value")
    cell = (ev.select((F.col("user_id") % 5).alias("server_id"),
                      F.col("event_type").alias("metric"),
                      F.date_trunc("hour", "ts").alias("check_date"), v.alias("v"))
            .groupBy("server_id", "metric", "check_date")
            .agg(F.sum("v").alias("dv"), F.count(F.lit(1)).alias("dn"),
                 F.sum(F.call_function("div", F.col("v"), F.lit(4))).alias("ds"),
                 F.sum(F.when(F.col("v") % 2 == 0, 1).otherwise(0)).alias("dw")))
    # server 0 restarts its counters every 5 days (a restart needs consecutive snapshots to be seen)
    epoch = F.when(F.col("server_id") == 0, F.call_function("div", F.dayofmonth("check_date"), F.lit(5))).otherwise(-1)
    w = (Window.partitionBy("server_id", "metric", epoch).orderBy("check_date")
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return cell.select(
        _s("srv", F.col("server_id")).alias("server_name"), "check_date", "metric",
        F.sum("dv").over(w).alias("wait_time_ms"),
        F.sum("ds").over(w).alias("signal_wait_time_ms"),
        F.sum("dn").over(w).alias("waiting_tasks_count"),
        F.sum("dw").over(w).alias("num_of_writes"))


def wait_snapshots(spark, d):
    """Wait snapshots; wait times are scaled x256 so an hour's waits are of the order of the hour."""
    return (snapshots(spark, d).withColumnRenamed("metric", "wait_type")
            .withColumn("wait_time_ms", F.col("wait_time_ms") * 256)
            .withColumn("signal_wait_time_ms", F.col("signal_wait_time_ms") * 256))


def wait_lookup(spark, d):
    """Lookup of wait types: category, ignorable, never acceptable; one type is not listed."""
    t = F.col("event_type")
    return (table(spark, d, "events").select("event_type").distinct().where(t != "signup").select(
        t.alias("wait_type"), F.concat(F.lit("Category "), (F.length(t) % 3).cast("string")).alias("wait_category"),
        (F.length(t) == 4).alias("ignorable"), F.contains(t, F.lit("r")).alias("never_acceptable")))


def file_snapshots(spark, d):
    s = snapshots(spark, d)
    log = F.col("metric").isin("error", "view")
    return s.select(
        "server_name", "check_date", F.col("metric").alias("file_name"),
        F.when(log, "LOG").otherwise("ROWS").alias("type_desc"),
        F.concat(F.lit("/data/"), F.col("server_name"), F.lit("/"), F.col("metric"),
                 F.when(log, ".ldf").otherwise(".mdf")).alias("physical_name"),
        F.col("waiting_tasks_count").alias("num_of_reads"),
        F.col("wait_time_ms").alias("io_stall_read_ms"),
        (F.col("wait_time_ms") * 8192).alias("bytes_read"),
        F.col("num_of_writes"),
        F.col("signal_wait_time_ms").alias("io_stall_write_ms"),
        (F.col("signal_wait_time_ms") * 4096).alias("bytes_written"),
        F.col("waiting_tasks_count").alias("size_on_disk_mb"))


# Counter types (fixed values of the performance-counter catalog).
CNTR_RAW = 65792            # current value
CNTR_RATE = 272696576       # per-second rate, cumulative
CNTR_FRACTION = 537003264   # numerator of a ratio
CNTR_BASE = 1073939712      # denominator of a ratio
CNTR_AVG = 1073874176       # average numerator (paired with a base)


def counter_snapshots(spark, d):
    s = snapshots(spark, d)
    typ = (F.when(F.col("metric") == "signup", CNTR_RAW)
           .when(F.col("metric") == "purchase", CNTR_RATE)
           .when(F.col("metric") == "click", CNTR_FRACTION)
           .when(F.col("metric") == "view", CNTR_BASE)
           .otherwise(CNTR_AVG))
    return s.select("server_name", "check_date",
                    F.lit("SQLServer:Stats").alias("object_name"),
                    F.col("metric").alias("counter_name"),
                    F.lit("").alias("instance_name"),
                    F.col("wait_time_ms").alias("cntr_value"),
                    typ.alias("cntr_type"))


# X2 ---------------------------------------------------------------------------
def sessions(spark: SparkSession, d: str) -> DataFrame:
    """One session per customer; session k is blocked by k div 2 unless k % 7 = 0."""
    c = table(spark, d, "customer")
    k = F.col("c_custkey")
    login = _add("SECOND", k, ts_lit("2024-01-01 00:00:00"))
    return c.select(
        k.alias("session_id"), F.lit(0).alias("request_id"),
        F.when((k > 1) & (k % 7 != 0), F.call_function("div", k, F.lit(2))).alias("blocking_session_id"),
        _s("login", k % 13).alias("login_name"),
        _s("host", F.col("c_nationkey")).alias("host_name"),
        F.col("c_mktsegment").alias("program_name"),
        _s("db", k % 10).alias("database_name"),
        login.alias("login_time"),
        _add("MINUTE", F.col("c_nationkey"), login).alias("start_time"),
        F.abs(cents("c_acctbal")).alias("wait_time_ms"),
        ((k % 1000) * 3).alias("cpu_time"),
        F.abs(cents("c_acctbal")).alias("reads"),
        (F.col("c_nationkey").cast("bigint") * 11).alias("writes"),
        (k % 17).alias("tempdb_pages"),
        F.when((k > 1) & (k % 7 != 0), "suspended").when(k % 3 == 0, "sleeping")
         .otherwise("running").alias("status"))


def server_sessions(spark: SparkSession, d: str) -> DataFrame:
    """Sessions of two servers under the same ids; on the second, k is blocked by k div 3 unless k % 5 = 0."""
    s, k = sessions(spark, d), F.col("session_id")
    other = s.withColumns({"blocking_session_id": F.when((k > 2) & (k % 5 != 0), F.call_function("div", k, F.lit(3))),
                           "cpu_time": F.col("cpu_time") + 1, "writes": F.col("writes") + 2})
    return s.withColumn("server_name", F.lit("srv0")).unionByName(other.withColumn("server_name", F.lit("srv1")))


def sessions_pass2(spark: SparkSession, d: str) -> DataFrame:
    """Second sample of the sessions of both servers: one in four has ended (one in six on the second), the rest did more work."""
    s = server_sessions(spark, d)
    k, first = F.col("session_id"), F.col("server_name") == "srv0"
    return (s.filter(F.when(first, k % 4 != 0).otherwise(k % 6 != 0))
            .withColumn("cpu_time", F.col("cpu_time") + (k % 23) * 5)
            .withColumn("reads", F.col("reads") + F.when(first, k % 100).otherwise(k % 50))
            .withColumn("writes", F.col("writes") + k % 9)
            .withColumn("tempdb_pages", F.col("tempdb_pages") + 1))


# X3 ---------------------------------------------------------------------------
def backups(spark: SparkSession, d: str) -> DataFrame:
    """Backup history: one backup per event; type by event type; LSN from event_id.

    Every database name is on three servers, and on each of them under two guids.
    """
    ev = table(spark, d, "events")
    e = F.col("event_id")
    v = cents("value")
    size = v * 1048576
    return ev.select(
        _s("srv", F.col("user_id") % 3).alias("server_name"),
        _s("guid", F.call_function("div", F.col("user_id"), F.lit(60)) % 2).alias("database_guid"),
        _s("db", F.col("user_id") % 10).alias("database_name"),
        e.alias("backup_set_id"),
        F.when(F.col("event_type") == "signup", "D").when(F.col("event_type") == "purchase", "I")
         .otherwise("L").alias("type"),
        F.col("ts").alias("backup_start_date"),
        _add("MILLISECOND", v * 10, F.col("ts")).alias("backup_finish_date"),
        (e * 1000).alias("first_lsn"), (e * 1000 + 1000).alias("last_lsn"),
        size.alias("backup_size"),
        F.when(e % 4 == 0, size).otherwise(F.call_function("div", size, F.lit(2))).alias("compressed_backup_size"),
        F.when(F.col("user_id") % 3 == 0, "svc_agent").otherwise(_s("u", F.col("user_id") % 4)).alias("user_name"),
        (e % 6 != 0).alias("has_backup_checksums"),
        (e % 97 == 0).alias("is_password_protected"),
        (e % 89 == 0).alias("is_snapshot"),
        (e % 83 == 0).alias("is_readonly"),
        (e % 79 == 0).alias("is_single_user"),
        (e % 73 == 0).alias("is_damaged"),
        (e % 71 == 0).alias("has_bulk_logged_data"),
        F.when(e % 67 == 0, "CERTIFICATE").alias("encryptor_type"),
        F.when(e % 11 == 0, "SIMPLE").when(e % 13 == 0, "BULK-LOGGED").otherwise("FULL").alias("recovery_model"),
        F.when(e % 29 == 0, 110).when(e % 31 == 0, 120).otherwise(150).alias("compatibility_level"))


# X4 ---------------------------------------------------------------------------
def processlist(spark: SparkSession, d: str) -> DataFrame:
    """Process-list samples: one row per event.

    Users with ``user_id % 11 = 0`` are replication threads (``system user``)
    whose state is a prefix of a known replication state ('' matches all).
    """
    return processlist_from(table(spark, d, "events"))


def processlist_from(ev: DataFrame) -> DataFrame:
    """Process-list columns from an events DataFrame (batch or streaming)."""
    u, e, t = F.col("user_id"), F.col("event_id"), F.col("event_type")
    sysu = (u % 11 == 0)
    repl_state = (F.when(e % 5 == 0, "Waiting for master").when(e % 5 == 1, "Reading event from the relay log")
                  .when(e % 5 == 2, "").when(e % 5 == 3, "Queueing master event to the relay log")
                  .otherwise("Slave has read all relay log"))
    return ev.select(
        e.alias("id"),
        F.when(sysu, "system user").when(u % 13 == 0, "rdsadmin").when(u % 17 == 0, "event_scheduler")
         .otherwise(_s("u", u)).alias("user"),
        F.concat(F.lit("h"), (u % 7).cast("string"), F.lit(":"), (3306 + e % 100).cast("string")).alias("host"),
        _s("db", u % 10).alias("db"),
        F.when(sysu, "Connect").when(t == "view", "Sleep").when(t == "signup", "Binlog Dump")
         .otherwise("Query").alias("command"),
        F.call_function("div", cents("value"), F.lit(10)).alias("time"),
        F.when(sysu, repl_state).when(t == "click", "Sending data")
         .when(t == "purchase", "Waiting for table metadata lock")
         .when(t == "error", "executing").when(t == "view", "").otherwise("starting").alias("state"),
        F.when(e % 11 == 0, F.lit(None).cast("string"))
         .when(e % 13 == 0, F.concat(F.col("props"), F.lit(" /* IGNORE_KILL_QUERY_ON_DATABASE_TIMEOUT */")))
         .otherwise(F.col("props")).alias("info"),
        F.col("ts").alias("sample_time"))


# X5 ---------------------------------------------------------------------------
def index_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Index catalog: one index per part, table = brand, keys = type and size."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    zero = (k % 4 == 0)
    created = _add("DAY", -(k % 40), ts_lit(AS_OF_EVENTS))
    return p.select(
        _s("db", F.col("p_size") % 3).alias("database_name"), F.when(k % 6 == 0, "audit").otherwise("dbo").alias("schema_name"),
        F.col("p_brand").alias("table_name"), k.alias("index_id"), _s("ix_", k).alias("index_name"),
        F.concat(F.col("p_type"), F.lit(","), F.col("p_size").cast("string")).alias("key_columns"),
        F.col("p_type").alias("first_key_column"),
        F.when(k % 3 == 0, F.col("p_name")).alias("include_columns"),
        F.when(k % 50 == 0, "HEAP").when(k % 10 == 0, "CLUSTERED").otherwise("NONCLUSTERED").alias("index_type"),
        (k % 40 == 0).alias("is_primary_key"), (k % 5 == 0).alias("is_unique"),
        (k % 97 == 0).alias("is_disabled"),
        F.when(zero, 0).otherwise((k % 7) * 100).alias("user_seeks"),
        F.when(zero, 0).otherwise((k % 5) * 10).alias("user_scans"),
        F.lit(0).cast("bigint").alias("user_lookups"),
        ((k % 11) * 1500).alias("user_updates"),
        cents("p_retailprice").alias("total_pages"),
        F.call_function("div", cents("p_retailprice") * 3, F.lit(4)).alias("used_pages"),
        (k * 37 + F.col("p_size")).alias("row_count"),
        created.alias("create_date"),
        _add("DAY", k % 3, created).alias("modify_date"),
        (F.col("p_size") % 6 + 1).alias("key_column_count"),
        (k % 4).alias("include_column_count"),
        ((k % 13) * 40000).alias("row_lock_wait_ms"), ((k % 17) * 20000).alias("page_lock_wait_ms"),
        ((k % 23) * 100).alias("forwarded_fetch_count"), (k % 19).alias("leaf_delete_count"),
        _add("DAY", -(k % 60), created).alias("stats_updated"),
        (k * 5).alias("modification_counter"),
        F.call_function("div", (k * 37 + F.col("p_size")) * (k % 100), F.lit(100)).alias("rows_sampled"),
        (F.lit(1) + k % 9).alias("uptime_days"))


def column_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Column catalog: one column per part row of a brand (table)."""
    p = table(spark, d, "part")
    k = F.col("p_partkey")
    return p.select(
        _s("db", F.col("p_size") % 3).alias("database_name"), F.when(k % 6 == 0, "audit").otherwise("dbo").alias("schema_name"),
        F.col("p_brand").alias("table_name"),
        F.concat(F.col("p_name"), F.lit("_"), k.cast("string")).alias("column_name"),
        F.when(F.col("p_type").isin("ECONOMY", "STANDARD"), "nvarchar").otherwise("int").alias("data_type"),
        (F.col("p_size") % 2 == 0).alias("is_nullable"),
        (F.col("p_size") * 10).alias("max_length"))


# X6 ---------------------------------------------------------------------------
def deadlock_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lineitems numbered within their order (the processes of one deadlock)."""
    li = table(spark, d, "lineitem")
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .withColumn("rn", F.row_number().over(_line_order()))
            .withColumn("n_lines", F.count(F.lit(1)).over(Window.partitionBy("l_orderkey"))))


_LINE = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice",
         "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"]


def _line_order():
    """Total order of an order's lines (ties in l_linenumber exist in the data)."""
    return Window.partitionBy("l_orderkey").orderBy(*_LINE[1:])


def _attr(name: str, c) -> F.Column:
    return F.concat(F.lit(f' {name}="'), c.cast("string"), F.lit('"'))


def _grouped_lines(x: DataFrame, by: list[str], more: list[str], out: str) -> DataFrame:
    """An order's lines as one array in line order.

    The lines' own columns are grouped, not the text made of them, which is
    many times larger: a document is written once its order is together.
    """
    cols = ["rn", *_LINE, *more]
    return x.groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*cols))).alias(out))


def deadlock_xml(spark: SparkSession, d: str) -> DataFrame:
    """One deadlock-graph XML document per order.

    processes = the order's lines; line n waits on a resource owned by line n-1;
    the victim is the last line.
    """
    x = deadlock_lines(spark, d)
    mode = F.when(F.col("l_discount") < 0.03, "S").when(F.col("l_discount") < 0.06, "U").otherwise("X")
    x = x.withColumn("mode", mode).withColumn("prev_mode", F.lag("mode").over(_line_order()))    # same ordering as rn: no second sort

    def pid(s):
        return F.concat(F.lit("p"), s["l_orderkey"].cast("string"), F.lit("_"), s["rn"].cast("string"))

    def process(s):
        iso = (F.when(s["l_returnflag"] == "R", "serializable (4)")
               .when(s["l_returnflag"] == "A", "repeatable read (3)").otherwise("read committed (2)"))
        status = (F.when(s["l_quantity"] > 45, "background")
                  .when(s["l_linestatus"] == "O", "suspended").otherwise("sleeping"))
        tran = F.when(s["l_tax"] == 0, "implicit_transaction").otherwise("user_transaction")
        proc = F.when(s["l_partkey"] % 3 == 0, "adhoc").otherwise(
            F.concat(F.lit("db.dbo.proc"), (s["l_partkey"] % 20).cast("string")))
        return F.concat(
            F.lit("<process"), _attr("id", pid(s)), _attr("spid", s["l_suppkey"]),
            _attr("currentdb", s["l_partkey"] % 5 + 5),
            _attr("currentdbname", F.concat(F.lit("db"), (s["l_partkey"] % 5).cast("string"))),
            _attr("priority", s["l_linenumber"] % 4 - 2), _attr("logused", cents(s["l_extendedprice"]) % 9973),
            _attr("waitresource", F.concat(F.lit("KEY: "), (s["l_partkey"] % 5 + 5).cast("string"), F.lit(":"),
                                           (s["l_partkey"] * 1000 + s["l_suppkey"]).cast("string"))),
            _attr("lasttranstarted", F.col("o_orderdate")), _attr("lastbatchstarted", s["l_shipdate"]),
            _attr("lastbatchcompleted", F.timestamp_add("HOUR", s["l_linenumber"], s["l_shipdate"])),
            _attr("isolationlevel", iso), _attr("status", status),
            _attr("clientapp", F.when(s["l_partkey"] % 17 == 0, F.concat(
                F.lit("SQLAgent - TSQL JobStep (Job 0x"), F.lpad((s["l_partkey"] % 40).cast("string"), 32, "0"),
                F.lit(" : Step "), s["l_linenumber"].cast("string"), F.lit(")")))
                .otherwise(F.concat(F.lit("app"), (s["l_partkey"] % 3).cast("string")))),
            _attr("hostname", F.concat(F.lit("host"), (s["l_suppkey"] % 4).cast("string"))),
            _attr("loginname", F.concat(F.lit("login"), (s["l_suppkey"] % 6).cast("string"))),
            _attr("waittime", cents(s["l_quantity"])), _attr("lockMode", s["mode"]),
            _attr("trancount", s["l_linenumber"] % 3), _attr("transactionname", tran),
            _attr("clientoption1", cents(s["l_extendedprice"]) % 65536),
            _attr("clientoption2", (s["l_partkey"] % 128) * 8388608),
            F.lit("><executionStack><frame"), _attr("procname", proc),
            _attr("sqlhandle", F.concat(F.lit("0x"), s["l_partkey"].cast("string"))),
            F.lit("/></executionStack></process>"))

    def resource(s):
        kinds = F.array(*[F.lit(k) for k in ("keylock", "pagelock", "objectlock", "ridlock",
                                               "rowgrouplock", "exchangeEvent")])
        kind = F.element_at(kinds, (s["l_partkey"] % 6 + 1).cast("int"))
        prev_pid = F.concat(F.lit("p"), s["l_orderkey"].cast("string"), F.lit("_"), (s["rn"] - 1).cast("string"))
        return F.when(s["rn"] > 1, F.concat(
            F.lit("<"), kind,
            _attr("dbid", s["l_partkey"] % 5 + 5),
            _attr("objectname", F.concat(F.lit("db"), (s["l_partkey"] % 5).cast("string"),
                                         F.lit(".dbo.t"), (s["l_partkey"] % 10).cast("string"))),
            _attr("indexname", F.concat(F.lit("ix"), (s["l_partkey"] % 4).cast("string"))),
            _attr("mode", s["prev_mode"]),
            _attr("associatedObjectId", s["l_partkey"] * 1000 + s["l_suppkey"]),
            F.lit("><owner-list><owner"), _attr("id", prev_pid), _attr("mode", s["prev_mode"]),
            F.lit("/></owner-list><waiter-list><waiter"), _attr("id", pid(s)), _attr("mode", s["mode"]),
            F.lit(' requestType="wait"/></waiter-list></'), kind, F.lit(">")))

    g = _grouped_lines(x, ["l_orderkey", "o_orderdate"], ["mode", "prev_mode"], "items")
    victim = pid(F.element_at("items", -1))
    doc = F.concat(
        F.lit("<deadlock><victim-list><victimProcess"), _attr("id", victim),
        F.lit("/></victim-list><process-list>"),
        F.array_join(F.transform("items", process), ""),
        F.lit("</process-list><resource-list>"),
        F.array_join(F.transform("items", resource), ""),
        F.lit("</resource-list></deadlock>"))
    name = (F.when(F.col("l_orderkey") % 7 == 0, "lock_deadlock").when(F.col("l_orderkey") % 3 == 0, "database_xml_deadlock_report")
            .when(F.col("l_orderkey") % 5 == 0, "xml_deadlock_report_filtered").otherwise("xml_deadlock_report"))
    return g.select(F.col("l_orderkey").alias("event_id"), name.alias("event_name"),
                    F.col("o_orderdate").alias("event_date"), doc.alias("deadlock_graph"))


def plan_documents(spark: SparkSession, d: str) -> DataFrame:
    """One execution plan per order: line n is an operator below line n - 1, some with a lookup as a second child."""
    x = deadlock_lines(spark, d)
    line = {c: F.col(c) for c in _LINE}

    def io(s):
        return s["l_quantity"].cast("int")

    def cpu(s):
        return cents(s["l_tax"]).cast("int")

    leaf = F.col("l_partkey") % 4 == 0
    below = (Window.partitionBy("l_orderkey").orderBy(F.col("rn").desc()).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = x.withColumn("subtree", F.sum(io(line) + cpu(line) + F.when(leaf, F.col("l_linenumber")).otherwise(0)).over(below))

    def pick(s, *names):
        # a line without part takes the last name
        return F.element_at(F.array(*[F.lit(n) for n in names]), F.coalesce((s["l_partkey"] % 6 + 1).cast("int"), F.lit(-1)))

    def inner(s):
        return pick(s, "Sort", "NestedLoops", "RemoteQuery", "Spool", "Hash", "Spool")

    def opening(s):
        leaf = s["l_partkey"] % 4 == 0
        lookup = F.when(leaf, F.concat(
            F.lit("<RelOp"), _attr("NodeId", 1000 + s["rn"]), F.lit(' PhysicalOp="Clustered Index Seek" LogicalOp="Key Lookup" EstimateIO="0"'),
            _attr("EstimateCPU", s["l_linenumber"]), F.lit(' EstimateRows="1000000"'), _attr("EstimatedTotalSubtreeCost", s["l_linenumber"]),
            F.lit('><IndexScan Lookup="1"><Object'), _attr("Table", F.when(s["l_suppkey"] % 5 == 0, "[@tv]").otherwise("[t]")),
            F.lit("/></IndexScan></RelOp>"))).otherwise("")
        return F.concat(
            F.lit("<RelOp"), _attr("NodeId", s["rn"]), _attr("PhysicalOp", pick(s, "Sort", "Nested Loops", "Remote Query", "Index Spool", "Hash Match", "Table Spool")),
            _attr("LogicalOp", pick(s, "Sort", "Inner Join", "Remote Query", "Eager Spool", "Aggregate", "Lazy Spool")),
            _attr("EstimateIO", io(s)), _attr("EstimateCPU", cpu(s)), _attr("EstimateRows", s["l_partkey"] % 9),
            _attr("EstimateRewinds", s["l_suppkey"] * 7), _attr("EstimateRebinds", s["l_partkey"] % 50),
            _attr("EstimatedTotalSubtreeCost", s["subtree"]), F.lit(">"),
            F.when(s["l_discount"] == 0.05, '<Warnings NoJoinPredicate="1"/>').otherwise(""), F.lit("<"), inner(s), F.lit(">"),
            F.when(s["l_suppkey"] % 7 == 0, '<DefinedValue><UserDefinedFunction FunctionName="[f]"/></DefinedValue>').otherwise(""), lookup)

    def closing(s):
        return F.concat(F.lit("</"), inner(s), F.lit("></RelOp>"))

    g = _grouped_lines(x, ["l_orderkey"], ["subtree"], "ops").withColumnRenamed("l_orderkey", "plan_id")
    p = F.col("plan_id")
    reason = F.when(p % 10 == 0, "TimeOut").when(p % 10 == 1, "MemoryLimitExceeded").otherwise("")
    doc = F.concat(
        F.lit('<ShowPlanXML xmlns="urn:plan"><BatchSequence><Batch><Statements><StmtSimple'), _attr("StatementOptmEarlyAbortReason", reason),
        _attr("StatementType", F.when(p % 9 == 0, "CREATE INDEX").otherwise("SELECT")), F.lit("><QueryPlan>"),
        F.when(p % 4 == 0, F.concat(F.lit("<MissingIndexes><MissingIndexGroup"), _attr("Impact", p % 100), F.lit("/></MissingIndexes>"))).otherwise(""),
        F.when(p % 6 == 0, F.concat(F.lit("<Warnings><PlanAffectingConvert"), _attr("Expression", F.when(
            p % 12 == 0, "CONVERT_IMPLICIT(int,[a]&lt;5 &amp; 1)").otherwise("CONVERT(int,[a])")), F.lit("/></Warnings>"))).otherwise(""),
        F.array_join(F.transform("ops", opening), ""), F.array_join(F.transform(F.reverse("ops"), closing), ""),
        F.lit("</QueryPlan></StmtSimple></Statements></Batch></BatchSequence></ShowPlanXML>"))
    return g.select("plan_id", doc.alias("query_plan"))


def version_list(spark: SparkSession, d: str) -> DataFrame:
    """Listed builds: (major_version, minor_version, branch, release_date); a build may be released again."""
    p = table(spark, d, "part")
    return p.select((10 + F.col("p_size") % 7).cast("int").alias("major_version"), ((F.col("p_partkey") * 29) % 4000).cast("int").alias("minor_version"),
                    F.concat_ws(" ", "p_type", "p_brand").alias("branch"),
                    F.timestamp_add("DAY", F.col("p_partkey").cast("int"), ts_lit("2008-01-01 00:00:00")).alias("release_date"))


# X7 ---------------------------------------------------------------------------
def query_stats(spark: SparkSession, d: str) -> DataFrame:
    """Plan-cache statistics: one cached query per part."""
    li = table(spark, d, "lineitem")
    q = F.col("l_quantity").cast("bigint")
    return (li.groupBy(F.col("l_partkey").alias("query_hash"))
            .agg(F.count(F.lit(1)).alias("execution_count"),
                 (F.sum(q) * 1000).alias("total_worker_time"),
                 (F.min(q) * 1000).alias("min_worker_time"),
                 (F.max(q) * 1000).alias("max_worker_time"),
                 F.sum(cents("l_extendedprice")).alias("total_logical_reads"),
                 F.sum(cents("l_tax")).alias("total_logical_writes"),
                 F.sum(q * 1000 + F.col("l_linenumber") * 500).alias("total_elapsed_time"),
                 F.sum("l_linenumber").alias("total_rows"),
                 (F.max("l_linenumber") * 1024).alias("max_grant_kb"),
                 (F.min("l_linenumber") * 1024).alias("max_used_grant_kb"),
                 F.sum(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).alias("total_spills"),
                 F.min("l_shipdate").alias("creation_time"),
                 F.max("l_shipdate").alias("last_execution_time"),
                 (F.max("l_linenumber") * 3).alias("query_cost"),
                 F.countDistinct("l_suppkey").alias("plan_count"),
                 (F.max("l_linenumber") * 800).alias("avg_compile_ms"),
                 F.min(cents("l_extendedprice")).alias("min_price"),
                 F.max(cents("l_extendedprice")).alias("max_price")))


def missing_index_requests(spark: SparkSession, d: str) -> DataFrame:
    """Missing-index requests: one per part; costs in hundredths, impact in tenths of a percent."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("index_handle"), F.concat_ws(".", "p_brand", "p_type").alias("object_name"), ((k % 13) * 100).alias("user_seeks"),
        ((k % 7) * 20).alias("user_scans"), cents("p_retailprice").alias("avg_total_user_cost_hundredths"),
        (F.col("p_size") * 20).cast("bigint").alias("avg_user_impact_tenths"), (1 + k % 40).alias("create_days"), (1 + k % 9 * 5).alias("uptime_days"))


def query_history(spark: SparkSession, d: str) -> DataFrame:
    """Logged query statistics: one row per query and monthly snapshot."""
    q = F.col("l_quantity").cast("bigint")
    return (table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("query_hash"), F.date_trunc("month", "l_shipdate").cast("timestamp_ntz").alias("check_date"))
            .agg(F.count(F.lit(1)).alias("execution_count"), (F.sum(q) * 1000).alias("total_worker_time"),
                 F.sum(cents("l_extendedprice")).alias("total_logical_reads"), F.sum(cents("l_tax")).alias("total_logical_writes"),
                 F.sum(q * 1000 + F.col("l_linenumber") * 500).alias("total_elapsed_time"),
                 (F.max("l_linenumber") * 1024).alias("max_grant_kb"),
                 F.sum(F.when(F.col("l_discount") >= 0.09, 1).otherwise(0)).alias("total_spills")))


# X9 ---------------------------------------------------------------------------
def global_grants(spark, d):
    r = table(spark, d, "region")
    k = F.col("r_regionkey")
    return r.select(_s("r", k).alias("user"), F.lit("%").alias("host"),
                    (k % 2 == 0).alias("select_priv"), (k % 3 == 0).alias("insert_priv"),
                    (k == 4).alias("update_priv"), (k == 3).alias("delete_priv"))


def db_grants(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(_s("n", k).alias("user"), F.lit("%").alias("host"),
                    _s("db", F.col("n_regionkey")).alias("db"),
                    (k % 2 == 0).alias("select_priv"), (k % 3 == 0).alias("insert_priv"),
                    (k % 5 == 0).alias("update_priv"), (k % 7 == 0).alias("delete_priv"))


def table_grants(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    priv = (F.when(k % 4 == 0, "Select").when(k % 4 == 1, "Select,Insert")
            .when(k % 4 == 2, "Update,Delete").otherwise("Insert"))
    return s.select(_s("s", k % 20).alias("user"), F.lit("%").alias("host"),
                    _s("db", F.col("s_nationkey") % 5).alias("db"),
                    _s("t", k % 10).alias("table_name"), priv.alias("table_priv"))


# X10 --------------------------------------------------------------------------
def audit_trail(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_custkey") % 100).alias("user_account_id"),
        F.col("o_custkey").alias("customer_id"), F.lit("order").alias("entity_name"),
        F.col("o_orderpriority").alias("path_name"), F.col("o_orderkey").alias("entity_id"),
        F.col("o_orderstatus").alias("action"), F.lit(None).cast("string").alias("old_value"),
        cents("o_totalprice").cast("string").alias("new_value"),
        F.col("o_orderdate").alias("action_date"))


# catalog ----------------------------------------------------------------------
def catalog_tables(spark: SparkSession, d: str) -> DataFrame:
    """``information_schema.tables`` sizes: schema = document source, table = language."""
    doc = table(spark, d, "documents")
    n = F.col("n_chars")
    return (doc.groupBy(F.col("source").alias("table_schema"), F.col("lang").alias("table_name"))
            .agg(F.count(F.lit(1)).alias("table_rows"), (F.sum(n) * 1024).alias("data_length"),
                 (F.sum(n) * 8).alias("index_length"), (F.count(F.lit(1)) * 16384).alias("data_free")))


def database_files(spark: SparkSession, d: str) -> DataFrame:
    """Database files: one per document; database = source, type by language."""
    doc = table(spark, d, "documents")
    return doc.select(F.col("source").alias("database_name"), F.col("doc_id").alias("file_id"),
                      F.when(F.col("lang") == "en", "ROWS").otherwise("LOG").alias("type_desc"),
                      F.col("n_chars").alias("size_pages"))


# plan cache -------------------------------------------------------------------
def plan_cache(spark: SparkSession, d: str) -> DataFrame:
    """Cached plans: one per (user, event type, day); same query hash across days and users."""
    ev = table(spark, d, "events")
    return (ev.groupBy("user_id", "event_type", F.dayofmonth("ts").alias("dom"))
            .agg(F.min("ts").alias("creation_time"), F.max("ts").alias("last_execution_time"),
                 F.count(F.lit(1)).alias("execution_count"), F.sum(cents("value")).alias("total_worker_time"))
            .select((F.col("user_id") * 100 + F.col("dom")).alias("plan_handle"),
                    F.concat(F.col("event_type"), F.lit("_"), (F.col("user_id") % 10).cast("string")).alias("query_hash"),
                    "creation_time", "last_execution_time", "execution_count", "total_worker_time"))


def findings_log(spark: SparkSession, d: str) -> DataFrame:
    """Findings written by the snapshot collector: one per event."""
    return findings_from(table(spark, d, "events"))


def findings_from(ev: DataFrame) -> DataFrame:
    u = F.col("user_id")
    return ev.select(F.col("event_id").alias("id"), ((u % 4 + 1) * 10).alias("priority"),
                     F.col("event_type").alias("findings_group"), _s("finding ", u % 3).alias("finding"),
                     _s("srv", u % 5).alias("server_name"), F.col("ts").alias("check_date"),
                     _s("details ", F.col("event_id")).alias("details"))
