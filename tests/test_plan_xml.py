"""Plan documents of any depth: flattening, sums, rules as data, broken documents; the build lookup."""

from conftest import SF_SMALL
from opslake.operators import plan_xml as P
from opslake.operators.versions import build_lookup
from opslake.plans import q_planxml as Q
from pyspark.sql import functions as F

DOC = ('<p:Show xmlns:p="urn:x"><p:RelOp NodeId="0" EstimateIO="1" EstimateCPU="2" PhysicalOp="A"><p:In>'
       '<p:RelOp NodeId="1" EstimateIO="4" PhysicalOp="B &amp; C"><p:IndexScan Lookup="1"/></p:RelOp>'
       '<p:RelOp NodeId="2" EstimateCPU="8" PhysicalOp="D"><!-- <RelOp NodeId="9"/> --><![CDATA[<RelOp/>]]>'
       '<p:RelOp NodeId="3" EstimateCPU="x" PhysicalOp="E"/></p:RelOp></p:In></p:RelOp></p:Show>')


def test_flattening(spark):
    deep = "<a>" * 300 + "</a>" * 300
    df = spark.createDataFrame([(1, DOC), (2, None), (3, "<a><b></a>"), (4, ""), (5, deep), (None, "<x/>")], "plan_id long, query_plan string")
    n = P.nodes(df).cache()
    got = {(r["plan_id"], r["node"]): r for r in n.collect()}
    assert got[1, 1]["path"] == "Show/RelOp" and got[1, 3]["attrs"]["PhysicalOp"] == "B & C"
    assert got[1, 4]["element"] == "IndexScan" and got[1, 4]["ancestors"] == [0, 1, 2, 3, 4] and got[1, 4]["parent"] == 3
    assert (3, None) in got and "mismatched" in got[3, None]["error"] and "no element" in got[4, None]["error"]
    assert not [k for k in got if k[0] == 2] and got[5, 299]["depth"] == 299 and (None, 0) in got
    ops = {r["node_id"]: r for r in P.operators(n.where("plan_id = 1")).collect()}
    assert {k: (r["parent_id"], r["op_depth"], r["own_cost"], r["subtree_cost"]) for k, r in ops.items()} == {
        0: (None, 0, 3.0, 15.0), 1: (0, 1, 4.0, 4.0), 2: (0, 1, 8.0, 8.0), 3: (2, 2, 0.0, 0.0)}


def test_rules_are_data(spark):
    n = P.nodes(spark.createDataFrame([(1, DOC)], "plan_id long, query_plan string"))
    rules = spark.createDataFrame([
        ("lookup", "IndexScan", "RelOp/IndexScan", "Lookup", "equals", "1", "EstimateIO,EstimateCPU", "parent", "max", 1.0),
        ("lookup_too_dear", "IndexScan", None, "Lookup", "equals", "1", "EstimateIO", "parent", "max", 5.0),
        ("all", "RelOp", None, None, "present", None, "EstimateIO,EstimateCPU", "self", "sum", 0.0),
        ("amp", "RelOp", "In/RelOp", "PhysicalOp", "contains", "& C", None, "self", "count", 1.0),
        ("begins", "RelOp", None, "PhysicalOp", "begins", "B", None, "self", "count", 2.0),
        ("nowhere", "RelOp", "Show/In", None, "present", None, None, "self", "count", 0.0)], P.RULE_SCHEMA)
    assert sorted(tuple(r) for r in P.evaluate(n, rules).collect()) == [(1, "all", 4, 15.0), (1, "amp", 1, 1.0), (1, "lookup", 1, 4.0)]


def _exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_operators_are_dealt_once(spark):
    """One shuffle by plan and nothing written; operators far apart in the tree, without ids, and plans without id."""
    tree = ('<S><RelOp NodeId="7" EstimateIO="1"><A><B><RelOp EstimateCPU="2"><C><RelOp NodeId="9" EstimateIO="4"/></C></RelOp></B></A>'
            '<RelOp NodeId="8" EstimateIO="8"/></RelOp><RelOp NodeId="3" EstimateIO="16"/></S>')
    df = spark.createDataFrame([(1, tree), (None, tree), (2, "<S/>"), (3, "<S>"), (4, tree)], "plan_id long, query_plan string")
    ops = P.operators(P.nodes(df))
    assert _exchanges(ops) == 1
    want = [(7, None, 0, 1.0, 15.0), (None, 7, 1, 2.0, 6.0), (9, None, 2, 4.0, 4.0), (8, 7, 1, 8.0, 8.0), (3, None, 0, 16.0, 16.0)]
    got = [(r["plan_id"], r["node_id"], r["parent_id"], r["op_depth"], r["own_cost"], r["subtree_cost"]) for r in ops.collect()]
    assert sorted(map(repr, got)) == sorted(repr((p, *x)) for p in (1, 4) for x in want)
    written = Q.plan_operators(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
    assert "plan-nodes" not in written


def test_rules_on_the_node_above_need_no_join(spark):
    """Only the final aggregate is shuffled; sums over the node above, broken and missing plans among the batch."""
    tree = '<S Cost="1"><A Cost="2" More="0.5"><X/><X/><Y><X Cost="9"/></Y></A><X/><Z><X/></Z></S>'
    df = spark.createDataFrame([(1, tree), (5, "<S><X/>"), (6, None), (None, tree), (2, "<X/>"), (3, tree.replace("2", "z"))],
                               "plan_id long, query_plan string").coalesce(2)
    rules = spark.createDataFrame([
        ("above", "X", None, None, "present", None, "Cost,More", "parent", "sum", 0.0), ("own", "X", None, None, "present", None, "Cost", "self", "max", 1.0),
        ("named", "X", "A/X", None, "present", None, "Cost", "parent", "max", None)], P.RULE_SCHEMA)
    got = P.evaluate(P.nodes(df), rules)
    assert _exchanges(got) == 1
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, [
        (1, "above", 5, 6.0), (1, "own", 5, 9.0), (1, "named", 2, 2.0), (2, "above", 1, 0.0), (3, "above", 5, 2.0), (3, "own", 5, 9.0), (3, "named", 2, 0.0),
        (None, "above", 5, 0.0), (None, "own", 5, 9.0), (None, "named", 2, 0.0)]))


def test_build_lookup(spark):
    v = spark.createDataFrame([(16, 1000, "RTM", "2022-11-15"), (16, 4003, "CU1", "2023-02-16"), (16, 4003, "CU1 again", "2023-02-20"), (15, 7, "x", "2019-01-01")],
                              "major_version int, minor_version int, branch string, d string").withColumn("release_date", F.col("d").cast("timestamp_ntz"))
    s = spark.createDataFrame([("a", 16, 4003), ("b", 16, 4002), ("c", 16, 999), ("d", 14, 5000), ("e", 16, 9999), ("f", 15, 7)],
                              "server_name string, major_version int, minor_version int")
    got = {r["server_name"]: (r["branch"], r["listed_minor"], r["exact_build"]) for r in build_lookup(s, v, "2024-01-31 00:00:00").collect()}
    assert got == {"a": ("CU1 again", 4003, True), "b": ("RTM", 1000, False), "c": (None, None, None), "d": (None, None, None),
                   "e": ("CU1 again", 4003, False), "f": ("x", 7, True)}
