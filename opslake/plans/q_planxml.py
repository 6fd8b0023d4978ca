"""Queries for stored execution plans and the build lookup (R14).

The oracles compute from the lineitem rows that the plan documents are built of.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import plan_xml as P
from opslake.operators import versions as V
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table

# one row per operator: the line's own and, for some, a lookup below it
_OPS = f"""WITH {ctes('x6l')},
l AS (SELECT l_orderkey AS plan_id, rn, l_partkey, l_suppkey, l_discount, CAST(l_quantity AS INTEGER) AS io,
             CAST(round(l_tax * 100) AS INTEGER) AS cpu, l_partkey % 4 = 0 AS leaf, l_linenumber AS leaf_cost FROM x6l),
s AS (SELECT *, SUM(io + cpu + CASE WHEN leaf THEN leaf_cost ELSE 0 END)
                OVER (PARTITION BY plan_id ORDER BY rn DESC) AS subtree FROM l)"""
_PHYS = "['Sort', 'Nested Loops', 'Remote Query', 'Index Spool', 'Hash Match', 'Table Spool'][l_partkey % 6 + 1]"


def _nodes(spark, d, above=False):
    """The flattened plans; every operator reads them once, so nothing is written."""
    return P.nodes(fx.plan_documents(spark, d), above=above)


@query("plan_operators", _OPS + f"""
SELECT plan_id, CAST(rn AS INTEGER) AS node_id, CASE WHEN rn > 1 THEN CAST(rn - 1 AS INTEGER) END AS parent_id, CAST(rn - 1 AS INTEGER) AS op_depth,
       {_PHYS} AS physical_op, CAST(io + cpu AS DOUBLE) AS own_cost, CAST(subtree AS DOUBLE) AS subtree_cost FROM s
UNION ALL SELECT plan_id, CAST(1000 + rn AS INTEGER), CAST(rn AS INTEGER), CAST(rn AS INTEGER), 'Clustered Index Seek',
                 CAST(leaf_cost AS DOUBLE), CAST(leaf_cost AS DOUBLE) FROM s WHERE leaf""")
def plan_operators(spark, d):
    return P.operators(_nodes(spark, d))


def _rule(name, value, where, having="TRUE"):
    return f"SELECT plan_id, '{name}' AS rule_name, COUNT(*) AS hits, CAST({value} AS DOUBLE) AS value FROM s WHERE {where} GROUP BY plan_id HAVING {having}"


_ONE = "rn = 1 AND "
_RULES = [
    _rule("compile_timeout", "COUNT(*)", _ONE + "plan_id % 10 = 0"), _rule("compile_memory_limit", "COUNT(*)", _ONE + "plan_id % 10 = 1"),
    _rule("index_dml", "COUNT(*)", _ONE + "plan_id % 9 = 0"), _rule("plan_warnings", "COUNT(*)", _ONE + "plan_id % 6 = 0"),
    _rule("implicit_conversion", "COUNT(*)", _ONE + "plan_id % 12 = 0"), _rule("no_join_predicate", "COUNT(*)", "l_discount = 0.05"),
    _rule("table_variable", "COUNT(*)", "leaf AND l_suppkey % 5 = 0"), _rule("scalar_functions", "COUNT(*)", "l_suppkey % 7 = 0"),
    _rule("key_lookup_cost", "MAX(leaf_cost)", "leaf"), _rule("remote_query_cost", "MAX(subtree)", "l_partkey % 6 = 2"),
    _rule("sort_cost", "MAX(io + cpu)", "l_partkey % 6 = 0", "MAX(io + cpu) >= 30"),
    _rule("eager_index_spool", "MAX(subtree)", "l_partkey % 6 = 3"), _rule("table_spool", "SUM(subtree)", "l_partkey % 6 = 5"),
    _rule("missing_index", "MAX(plan_id % 100)", _ONE + "plan_id % 4 = 0", "MAX(plan_id % 100) >= 20"),
]


@query("plan_node_rules", _OPS + " " + " UNION ALL ".join(_RULES))
def plan_node_rules(spark, d):
    return P.evaluate(_nodes(spark, d, above=True), spark.createDataFrame(P.PLAN_RULES, P.RULE_SCHEMA))


@query("plan_busy_loops", _OPS + """
SELECT plan_id, CAST(rn AS INTEGER) AS node_id, CAST(l_suppkey * 7 + l_partkey % 50 + 1 AS DOUBLE) AS executions,
       CAST(l_partkey % 9 AS DOUBLE) AS estimated_rows
FROM s WHERE (l_suppkey * 7 + l_partkey % 50 + 1) / CAST(100 AS DOUBLE) > l_partkey % 9""")
def plan_busy_loops(spark, d):
    return P.busy_loops(_nodes(spark, d))


_VERSIONS = """v0 AS (SELECT CAST(10 + p_size % 7 AS INTEGER) AS major_version, CAST((p_partkey * 29) % 4000 AS INTEGER) AS minor_version,
             p_type || ' ' || p_brand AS branch, TIMESTAMP '2008-01-01 00:00:00' + to_days(CAST(p_partkey AS INTEGER)) AS release_date FROM part),
v AS (SELECT major_version, minor_version, arg_max(branch, release_date) AS branch, MAX(release_date) AS release_date
      FROM v0 GROUP BY ALL)"""


@query("build_lookup", f"""
WITH {_VERSIONS},
s AS (SELECT 's' || s_suppkey AS server_name, CAST(9 + s_suppkey % 8 AS INTEGER) AS major_version,
             CAST((s_suppkey * 37) % 5000 AS INTEGER) AS minor_version FROM supplier)
SELECT s.*, v.minor_version AS listed_minor, v.branch, v.release_date,
       date_diff('day', v.release_date, TIMESTAMP '{fx.AS_OF_EVENTS}') AS days_since_release,
       v.minor_version = s.minor_version AS exact_build
FROM s LEFT JOIN v ON v.major_version = s.major_version AND v.minor_version =
     (SELECT MAX(w.minor_version) FROM v w WHERE w.major_version = s.major_version AND w.minor_version <= s.minor_version)""")
def build_lookup(spark, d):
    s = table(spark, d, "supplier").select(
        F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("server_name"),
        (9 + F.col("s_suppkey") % 8).cast("int").alias("major_version"), ((F.col("s_suppkey") * 37) % 5000).cast("int").alias("minor_version"))
    return V.build_lookup(s, fx.version_list(spark, d), fx.AS_OF_EVENTS)
