"""Deadlock-graph XML shredding and deadlock analysis.

Each document is parsed once with ``from_xml`` against a fixed schema; the
process list, execution stacks and the six lock-resource kinds are then
plain ``explode``s of the parsed struct (no repeated XML passes).  Every
deadlock graph is small (its participants), so the explodes stay per-row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from opslake.functions.scalar import parsename
from opslake.operators.timeseries import row_number
from opslake.sources.sinks import materialize

LOCK_KINDS = ["keylock", "pagelock", "objectlock", "ridlock", "rowgrouplock", "exchangeEvent"]

# Client option bits (first and second option word) and their names.
CLIENT_OPTIONS_1 = [
    (1, "DISABLE_DEF_CNST_CHECK"), (2, "IMPLICIT_TRANSACTIONS"), (4, "CURSOR_CLOSE_ON_COMMIT"),
    (8, "ANSI_WARNINGS"), (16, "ANSI_PADDING"), (32, "ANSI_NULLS"), (64, "ARITHABORT"), (128, "ARITHIGNORE"),
    (256, "QUOTED_IDENTIFIER"), (512, "NOCOUNT"), (1024, "ANSI_NULL_DFLT_ON"), (2048, "ANSI_NULL_DFLT_OFF"),
    (4096, "CONCAT_NULL_YIELDS_NULL"), (8192, "NUMERIC_ROUNDABORT"), (16384, "XACT_ABORT"),
]
CLIENT_OPTIONS_2 = [
    (1024, "DB CHAINING"), (2048, "NUMERIC ROUNDABORT"), (4096, "ARITHABORT"), (8192, "ANSI PADDING"),
    (16384, "ANSI NULL DEFAULT"), (65536, "CONCAT NULL YIELDS NULL"), (131072, "RECURSIVE TRIGGERS"),
    (1048576, "DEFAULT TO LOCAL CURSOR"), (8388608, "QUOTED IDENTIFIER"), (16777216, "AUTO CREATE STATISTICS"),
    (33554432, "CURSOR CLOSE ON COMMIT"), (67108864, "ANSI NULLS"), (268435456, "ANSI WARNINGS"),
    (536870912, "FULL TEXT ENABLED"), (1073741824, "AUTO UPDATE STATISTICS"), (1469283328, "ALL SETTABLE OPTIONS"),
]

_RESOURCE = ["_dbid: bigint", "_objectname: string", "_indexname: string", "_mode: string", "_associatedObjectId: bigint",
             "`owner-list`: struct<owner: array<struct<_id: string, _mode: string>>>",
             "`waiter-list`: struct<waiter: array<struct<_id: string, _mode: string, _requestType: string>>>"]
_PROCESS = ["_id: string", "_spid: bigint", "_currentdb: bigint", "_currentdbname: string", "_priority: bigint", "_logused: bigint",
            "_waitresource: string", "_lasttranstarted: string", "_lastbatchstarted: string", "_lastbatchcompleted: string",
            "_isolationlevel: string", "_status: string", "_clientapp: string", "_hostname: string", "_loginname: string",
            "_waittime: bigint", "_lockMode: string", "_trancount: bigint", "_transactionname: string",
            "_clientoption1: bigint", "_clientoption2: bigint",
            "executionStack: struct<frame: array<struct<_procname: string, _sqlhandle: string>>>"]
ALL_SECTIONS = ("victims", "processes", "resources")


def _struct(fields: list[str], keep) -> str:
    return "struct<" + ", ".join(f for f in fields if keep is None or f.split(":")[0].strip("`") in keep) + ">"


def schema_for(sections=ALL_SECTIONS, fields=None) -> str:
    """``from_xml`` schema with only the named sections and, if given, only these ``fields`` of processes and
    resources (fewer to convert and to carry)."""
    process, resource = _struct(_PROCESS, fields), _struct(_RESOURCE, fields)
    parts = {"victims": "`victim-list`: struct<victimProcess: array<struct<_id: string>>>",
             "processes": f"`process-list`: struct<process: array<{process}>>",
             "resources": "`resource-list`: struct<" + ", ".join(f"{k}: array<{resource}>" for k in LOCK_KINDS) + ">"}
    return "struct<" + ", ".join(parts[s] for s in sections) + ">"


SCHEMA = schema_for()


def parse(df: DataFrame, xml_col: str = "deadlock_graph", sections=ALL_SECTIONS, fields=None) -> DataFrame:
    """Parse each deadlock graph once, keeping only the ``sections`` (and ``fields``) a query reads.

    Keeps ``event_id``, ``event_name``, ``event_date`` and the parsed struct ``d``.
    """
    return df.select("event_id", "event_name", "event_date",
                     F.from_xml(F.col(xml_col), schema_for(sections, fields)).alias("d"))


# Event names that carry a deadlock graph.
GRAPH_EVENTS = ("xml_deadlock_report", "database_xml_deadlock_report", "xml_deadlock_report_filtered")


def event_filter(parsed: DataFrame, start: str, end: str, database: str | None = None, names=GRAPH_EVENTS) -> DataFrame:
    """Events of the given names in ``[start, end)``, optionally only those with a process in ``database``."""
    p = F.col("event_name").isin(*names) & (F.col("event_date") >= F.lit(start).cast("timestamp_ntz")) & (F.col("event_date") < F.lit(end).cast("timestamp_ntz"))
    if database is not None:
        p = p & F.exists(F.col("d.`process-list`.process"), lambda x: x["_currentdbname"] == database)
    return parsed.filter(p).select("event_id", "event_date",
                                   F.size("d.`process-list`.process").cast("bigint").alias("processes"))


def processes(parsed: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """One row per process, with the victim flag; ``cols`` (besides event_id and event_date) if only some are wanted."""
    names = ["spid", "currentdb", "currentdbname", "priority", "logused", "waitresource", "isolationlevel", "status", "clientapp",
             "hostname", "loginname", "waittime", "trancount", "transactionname", "clientoption1", "clientoption2"]
    found = {"process_id": F.col("p._id")} | {n: F.col(f"p._{n}") for n in names}
    found |= {n: F.col(f"p._{n}").cast("timestamp_ntz") for n in ("lasttranstarted", "lastbatchstarted", "lastbatchcompleted")}
    found |= {"lockmode": F.col("p._lockMode"), "is_victim": F.array_contains("victims", F.col("p._id")),
              "frames": F.col("p.executionStack.frame")}
    cols = list(found) if cols is None else cols
    victims = [F.transform(F.col("d.`victim-list`.victimProcess"), lambda v: v["_id"]).alias("victims")] if "is_victim" in cols else []
    x = parsed.select("event_id", "event_date", *victims, F.explode("d.`process-list`.process").alias("p"))
    return x.select("event_id", "event_date", *[found[c].alias(c) for c in cols])


def frames(parsed: DataFrame) -> DataFrame:
    """Distinct (event, process, procedure, handle) of the execution stacks."""
    p = processes(parsed, ["process_id", "frames"])
    return (p.select("event_id", "event_date", "process_id", F.explode("frames").alias("f"))
            .select("event_id", "event_date", "process_id", F.col("f._procname").alias("procname"),
                    F.col("f._sqlhandle").alias("sqlhandle")).distinct())


def _tagged_resources() -> Column:
    """All lock resources of a parsed document as one array of (kind, resource)."""
    def tag(kind):      # one-argument lambda: transform() reads a second argument as the index
        return lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("r"))

    return F.flatten(F.array_compact(F.array(*[F.transform(F.col(f"d.`resource-list`.{k}"), tag(k)) for k in LOCK_KINDS])))


def owner_waiter(parsed: DataFrame, cols: list[str] | None = None) -> DataFrame:
    """Lock resources of all six kinds with their owner and waiter (one row per owner-waiter pair
    of a resource; a resource lists only the few processes of its deadlock); ``cols`` as for ``processes``.

    The six per-kind arrays are merged into one tagged array, so each parsed
    document is exploded once (no union of six passes over the input).
    """
    names = {"dbid": "_dbid", "objectname": "_objectname", "indexname": "_indexname", "mode": "_mode", "associated_object_id": "_associatedObjectId"}
    found = {"lock_kind": F.col("t.kind")} | {n: F.col(f"t.r.{f}") for n, f in names.items()}
    sides = {"owner_id": "o._id", "owner_mode": "o._mode", "waiter_id": "w._id", "waiter_mode": "w._mode"}
    cols = [*found, *sides] if cols is None else cols
    r = parsed.select("event_id", "event_date", F.explode(_tagged_resources()).alias("t"))
    return (r.select("event_id", "event_date", *[found[c].alias(c) for c in cols if c in found],
                     F.col("t.r.`waiter-list`.waiter").alias("waiters"), F.explode_outer("t.r.`owner-list`.owner").alias("o"))
            .select("*", F.explode_outer("waiters").alias("w"))
            .select("event_id", "event_date", *[F.col(sides.get(c, c)).alias(c) for c in cols]))


def process_locks(parsed: DataFrame, process_cols: list[str], lock_cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Processes and owner-waiter pairs of documents that are parsed once: what ``parsed`` holds is written and read twice,
    so it should be parsed with the ``fields`` of these columns only."""
    parsed = materialize(parsed.drop("event_name"), "deadlocks")
    return processes(parsed, process_cols), owner_waiter(parsed, lock_cols)


def bit_names(c: Column, table: list[tuple[int, str]]) -> Column:
    """Names of the bits set in ``c`` (mask tests), comma separated, in table order."""
    parts = F.array(*[F.when((c.bitwiseAND(F.lit(b)) == F.lit(b)), F.lit(n)) for b, n in table])
    return F.array_join(F.filter(parts, lambda x: x.isNotNull()), ", ")


# Findings and dimension counts: one scan, every document parsed once.  Findings are exploded to processes and
# resources first, so their facts are plain column expressions; dimension counts gather the documents of an event,
# so each event gives a value once and is counted without a distinct over all events.
HEAP_KINDS = ("ridlock",)
#: an agent job's step in the client application's name
AGENT_STEP = r"^SQLAgent - \w+ JobStep \(Job 0x([0-9A-Fa-f]+) : Step (\d+)\)$"


def _processes_of(parsed: DataFrame) -> Column:
    kind = parsed.schema["d"].dataType["process-list"].dataType["process"].dataType
    return F.coalesce(F.col("d.`process-list`.process"), F.array().cast(kind))


def _parts(parsed: DataFrame, key: Column) -> DataFrame:
    """One row (__k, p, t) for every process (``p``) and every tagged resource (``t``) of a document, the other is null."""
    procs, locks = _processes_of(parsed), _tagged_resources()
    one = parsed.select(procs.alias("p"), locks.alias("t")).schema
    p, t = (F.lit(None).cast(one[c].dataType.elementType) for c in ("p", "t"))
    parts = F.concat(F.transform(procs, lambda x: F.struct(x.alias("p"), t.alias("t"))),
                     F.transform(locks, lambda x: F.struct(p.alias("p"), x.alias("t"))))
    return parsed.select(key.alias("__k"), F.explode(parts).alias("x")).select("__k", "x.p", "x.t")


def _modes(r: Column) -> Column:
    """Lock, owner and waiter modes of a resource."""
    none = F.array().cast("array<string>")
    return F.concat(F.array(r["_mode"]), *[F.coalesce(F.transform(r[side][item], lambda x: x["_mode"]), none)
                                           for side, item in (("owner-list", "owner"), ("waiter-list", "waiter"))])


def findings(parsed: DataFrame) -> DataFrame:
    """Deadlock findings: (check_id, finding_group, database_name, object_name, events).

    Counts distinct event dates; check 9 counts distinct processes.  A group
    without events has no row.
    """
    dash, p, t = F.lit("-"), F.col("p"), F.col("t")
    checks = []

    def fact(check, group, db, obj, when, own=None):
        """The rows of one check: its place in ``checks`` stands for its names until the rows are counted."""
        checks.append(F.struct(F.lit(check).alias("check_id"), F.lit(group).alias("finding_group")))
        return F.when(when, F.struct(F.lit(len(checks)).alias("check"), db.alias("database_name"), obj.alias("object_name"),
                                     (F.lit(None).cast("string") if own is None else own).alias("own")))

    db = p["_currentdbname"]
    agent = p["_clientapp"].rlike(AGENT_STEP)
    who = F.concat_ws(" / ", *[F.coalesce(p[f"_{c}"], F.lit("UNKNOWN")) for c in ("loginname", "clientapp", "hostname")])
    r, at = t["r"], F.split_part(t["r"]["_objectname"], F.lit("."), F.lit(1))
    heap = t["kind"].isin(*HEAP_KINDS)
    facts = [
        fact(1, "Total Database Deadlocks", db, dash, p.isNotNull()),
        fact(4, "Serializable Deadlocking", db, dash, p["_isolationlevel"].startswith("serializable")),
        fact(5, "Repeatable Read Deadlocking", db, dash, p["_isolationlevel"].startswith("repeatable")),
        fact(6, "Login, App, and Host deadlocks", db, who, p.isNotNull()),
        fact(13, "Agent Job Deadlocks", db, F.concat(
            F.lit("Job: "), F.regexp_extract(p["_clientapp"], AGENT_STEP, 1), F.lit(" Step: "),
            F.regexp_extract(p["_clientapp"], AGENT_STEP, 2)), agent),
        fact(15, "Total deadlocks involving sleeping sessions", dash, dash, p["_status"] == "sleeping"),
        fact(15, "Total deadlocks involving background processes", dash, dash, p["_status"] == "background"),
        fact(16, "Total implicit transaction deadlocks", dash, dash, p["_transactionname"] == "implicit_transaction"),
        fact(2, "Total Deadlocks Involving Selects", at, dash, F.exists(_modes(r), lambda m: m.isin("S", "IS"))),
        fact(3, "Total Object Deadlocks", at, F.coalesce(r["_objectname"], F.lit("UNKNOWN")), t.isNotNull()),
        fact(3, "Total Index Deadlocks", at, r["_indexname"], ~heap & r["_indexname"].isNotNull()),
        fact(3, "Total Heap Deadlocks", at, r["_indexname"], heap),
        fact(14, "Total parallel deadlocks", dash, dash, t["kind"] == "exchangeEvent"),
    ]
    of_process = 8
    # a process has as many stored procedures as its stack has frames
    frames_ = F.coalesce(p["executionStack"]["frame"], F.array().cast("array<struct<_procname: string, _sqlhandle: string>>"))
    procs = F.transform(F.filter(frames_, lambda f: f["_procname"] != "adhoc"),
                        lambda f: fact(9, "Stored Procedure Deadlocks", db, f["_procname"], F.lit(True), p["_id"]))

    each = (_parts(parsed, F.col("event_date").cast("string"))
            .select("__k", F.explode(F.when(p.isNotNull(), F.concat(F.array_compact(F.array(*facts[:of_process])), procs))
                                     .otherwise(F.array_compact(F.array(*facts[of_process:])))).alias("f")))
    keys = ["check", "database_name", "object_name"]
    counts = (each.groupBy(*[F.col(f"f.{k}").alias(k) for k in keys])
              .agg(F.countDistinct(F.coalesce(F.col("f.own"), F.col("__k"))).alias("events")))
    name = F.element_at(F.array(*checks), F.col("check"))
    return counts.select(name["check_id"].alias("check_id"), name["finding_group"].alias("finding_group"),
                         "database_name", "object_name", "events")


def dimension_counts(parsed: DataFrame) -> DataFrame:
    """Distinct events by dimension: (dimension, database_name, value, events), with a total per database.

    The documents of an event are gathered first, with the few fields that are
    counted.  An event then has every (dimension, database, value) and every
    (dimension, database) once, and a row counts its event: no distinct over all events.
    """
    fields = ["currentdbname", "loginname", "clientapp", "hostname", "isolationlevel"]
    docs = parsed.select(
        "event_id",
        F.transform(_processes_of(parsed), lambda p: F.struct(*[p[f"_{c}"].alias(c) for c in fields])).alias("p"),
        F.transform(_tagged_resources(), lambda t: F.struct(t["kind"].alias("kind"), t["r"]["_objectname"].alias("objectname"),
                                                            t["r"]["_indexname"].alias("indexname"))).alias("r"))
    events = docs.groupBy("event_id").agg(*[F.array_distinct(F.flatten(F.collect_list(c))).alias(c) for c in ("p", "r")])

    def object_db(r):
        return F.split_part(r["objectname"], F.lit("."), F.lit(1))

    def who(p):
        return F.concat_ws(" / ", *[F.coalesce(p[c], F.lit("UNKNOWN")) for c in ("loginname", "clientapp", "hostname")])

    def agent(p):
        return F.when(p["clientapp"].rlike(AGENT_STEP), F.regexp_extract(p["clientapp"], AGENT_STEP, 1))

    def own_db(p):
        return p["currentdbname"]

    def values(name, side, db, value):
        """An event's distinct (dimension, database, value), then the same without value as its totals."""
        found = F.array_distinct(F.filter(F.transform(F.col(side), lambda x: F.struct(db(x).alias("db"), value(x).alias("v"))),
                                          lambda y: y["v"].isNotNull()))
        return [F.transform(found, lambda y: F.struct(F.lit(name).alias("dimension"), y["db"].alias("database_name"), y["v"].alias("value"))),
                F.transform(F.array_distinct(F.transform(found, lambda y: y["db"])),
                            lambda y: F.struct(F.lit(name).alias("dimension"), y.alias("database_name"), F.lit(None).cast("string").alias("value")))]

    dims = [(c, "p", own_db, lambda p, c=c: p[c]) for c in fields[1:]] + [
        ("login/app/host", "p", own_db, who), ("agent job", "p", own_db, agent),
        ("object", "r", object_db, lambda r: r["objectname"]),
        ("index", "r", object_db, lambda r: F.when(~r["kind"].isin(*HEAP_KINDS), r["indexname"])),
        ("heap", "r", object_db, lambda r: F.when(r["kind"].isin(*HEAP_KINDS), r["indexname"]))]
    each = events.select("event_id", F.explode(F.concat(*[a for x in dims for a in values(*x)])).alias("f"))
    return each.groupBy("f.dimension", "f.database_name", "f.value").agg(F.count("event_id").alias("events"))


def waits(parsed: DataFrame) -> DataFrame:
    """Total wait by object and by database: (database_name, objectname, wait_ms); a null object is the database's total.

    The waiter's wait time is looked up within its document, so no join is needed.
    """
    procs = _processes_of(parsed)
    pairs = _tagged_resources()
    each = (parsed.select(F.map_from_entries(F.transform(procs, lambda p: F.struct(p["_id"], p["_waittime"]))).alias("wait"),
                          F.explode(pairs).alias("t"))
            .select("wait", F.col("t.r._objectname").alias("objectname"),
                    F.greatest(F.size(F.coalesce(F.col("t.r.`owner-list`.owner"), F.array())), F.lit(1)).alias("owners"),
                    F.explode("t.r.`waiter-list`.waiter").alias("w"))
            .select("objectname", F.split_part("objectname", F.lit("."), F.lit(1)).alias("database_name"),
                    (F.try_element_at("wait", F.col("w._id")) * F.col("owners")).alias("ms")))
    db, o = F.col("database_name"), F.col("objectname")
    return each.groupingSets([[db, o], [db]], db, o).agg(F.sum("ms").alias("wait_ms"))


def with_event_number(procs: DataFrame) -> DataFrame:
    """Add ``event_number``: dense rank of the event time, computed on the distinct times."""
    dates = procs.select("event_date").distinct()
    ranked = row_number(dates, [], ["event_date"], out="event_number")
    return procs.join(ranked, "event_date")


def event_numbers(procs: DataFrame) -> DataFrame:
    """Event number (dense rank of the event time), zero-based query number within an event,
    and a running number per session id.

    The dense rank is computed on the distinct event times (one row per time)
    instead of a window over every process row.
    """
    # read several times below: written once, so that the documents are parsed once
    p = with_event_number(materialize(procs.select("event_id", "event_date", "process_id", "spid"), "processes"))
    wq = Window.partitionBy("event_id").orderBy("process_id")       # a deadlock has few processes
    p = p.withColumn("query_number", (F.row_number().over(wq) - 1).cast("bigint"))
    # one session id can appear in a large share of all deadlocks
    p = row_number(p, ["spid"], ["event_date", "event_id", "process_id"], out="id_number")
    return p.select("event_number", "event_id", "event_date", "process_id", "spid", "query_number", "id_number")


def object_database(objectname: str = "objectname") -> Column:
    return parsename(F.col(objectname), 3)
