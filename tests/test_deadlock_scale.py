"""Deadlock and plan documents at scale: narrow rows are grouped, a document is parsed once, an event is counted once."""

import pytest
from opslake.operators import deadlocks as X
from opslake.operators import plan_xml as P
from opslake.plans import registry
from opslake.sources import fixtures as fx

from conftest import SF_SMALL

registry.load_all()


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("made", [fx.deadlock_xml, fx.plan_documents])
def test_documents_are_written_after_grouping(spark, made):
    """The rows that are grouped hold the line's columns, not the text made of them."""
    grouped = [x for x in _plan(made(spark, SF_SMALL)).splitlines() if "collect_list" in x]
    assert len(grouped) == 1 and "l_suppkey" in grouped[0], grouped


def test_processes_are_numbered_from_rows_written_once(spark):
    assert "from_xml" not in _plan(registry.QUERIES["event_numbering"](spark, SF_SMALL))


def test_documents_are_written_with_the_wanted_fields_only(spark):
    for name in ("or_join_split", "deadlock_report"):
        assert "waitresource" not in _plan(registry.QUERIES[name](spark, SF_SMALL)), name
    assert "_waitresource" not in _plan(registry.QUERIES["lock_types_text"](spark, SF_SMALL))
    assert "_waitresource" not in _plan(registry.QUERIES["deadlock_findings"](spark, SF_SMALL))


def test_rules_load_a_document_once(spark):
    plan = registry.QUERIES["xml_node_rules"](spark, SF_SMALL)._jdf.queryExecution().analyzed().toString()
    assert plan.count("xpath_") == 1 and plan.count("count(//process)") == 1


_DOC = ('<deadlock><victim-list><victimProcess id="a"/></victim-list><process-list>'
        '<process id="a" currentdbname="d" loginname="l1" clientapp="x" waittime="5"/><process id="b" currentdbname="d" loginname="{}"/>'
        '</process-list><resource-list><keylock objectname="d.o.t" indexname="i" mode="S"><owner-list><owner id="a" mode="S"/></owner-list>'
        '<waiter-list><waiter id="b" mode="X"/></waiter-list></keylock></resource-list></deadlock>')


def _parsed(spark, rows, **kw):
    df = spark.createDataFrame(rows, "event_id long, event_name string, d string, deadlock_graph string")
    return X.parse(df.selectExpr("event_id", "event_name", "to_timestamp_ntz(d) event_date", "deadlock_graph"), **kw)


def test_an_event_of_two_documents_counts_once(spark):
    """Also events without id, without graph and with a broken one."""
    day = "2024-01-01 00:00:00"
    rows = [(1, "x", day, _DOC.format("l1")), (1, "x", "2024-01-02 00:00:00", _DOC.format("l2")), (2, "x", day, _DOC.format("l1")),
            (3, "x", day, None), (4, "x", day, "<deadlock"), (None, "x", day, _DOC.format("l9"))]
    counted = X.dimension_counts(_parsed(spark, rows, sections=("processes", "resources")))
    assert "distinct" not in _plan(counted).replace("array_distinct", "")
    got = {(r["dimension"], r["database_name"], r["value"]): r["events"] for r in counted.collect()}
    assert got["loginname", "d", "l1"] == 2 and got["loginname", "d", "l2"] == 1 and got["loginname", "d", None] == 2
    assert got["loginname", "d", "l9"] == 0 and got["object", "d", "d.o.t"] == 2 and got["index", "d", None] == 2
    assert not [k for k in got if k[0] in ("heap", "isolationlevel")]
    found = {(r["finding_group"], r["object_name"]): r["events"] for r in X.findings(_parsed(spark, rows)).collect()}
    assert found["Total Database Deadlocks", "-"] == 2 and found["Total Object Deadlocks", "d.o.t"] == 2
    assert found["Total Deadlocks Involving Selects", "-"] == 2 and ("Total Heap Deadlocks", "i") not in found


def test_narrow_parse_gives_the_same_rows(spark):
    rows = [(1, "x", "2024-01-01 00:00:00", _DOC.format("l1"))]
    cols = ["owner_id", "waiter_id", "lock_kind"]
    full, few = _parsed(spark, rows), _parsed(spark, rows, fields=("_id", "owner-list", "waiter-list"))
    assert X.owner_waiter(few, cols).collect() == X.owner_waiter(full).select("event_id", "event_date", *cols).collect()
    p = ["process_id", "is_victim"]
    assert X.processes(few, p).collect() == X.processes(full).select("event_id", "event_date", *p).collect()


def test_a_rule_reads_its_own_node_without_a_join(spark):
    """A plan without id keeps its values; a broken plan between two others leaves no elements."""
    docs = [(None, '<x a="5"/>'), (1, '<x a="7"><y/></x>'), (2, '<x a="9"><y b="1"></x>'), (3, '<x><y c="2"/></x>')]
    n = P.nodes(spark.createDataFrame(docs, "plan_id long, query_plan string").coalesce(1))
    got = {(r["plan_id"], r["element"]): dict(r["attrs"]) for r in n.where("element is not null").collect()}
    assert got == {(None, "x"): {"a": "5"}, (1, "x"): {"a": "7"}, (1, "y"): {}, (3, "x"): {}, (3, "y"): {"c": "2"}}
    rules = spark.createDataFrame([("own", "x", None, None, "present", None, "a", "self", "max", 1.0),
                                   ("above", "y", None, None, "present", None, "a", "parent", "max", 0.0)], P.RULE_SCHEMA)
    assert {tuple(r) for r in P.evaluate(n, rules).collect()} == {(None, "own", 1, 5.0), (1, "own", 1, 7.0), (1, "above", 1, 7.0), (3, "above", 1, 0.0)}
