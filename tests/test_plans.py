"""Plan guards for scale: no Cartesian products; nested loops only where a bounded pattern table is the build side."""

import re

from opslake.plans import registry

from conftest import SF_SMALL

registry.load_all()

# Nested loops allowed only where the build side is small configuration data:
# the LIKE-with-wildcard branch joins against the fixed replication-state table.
NESTED_LOOP_OK = {"state_pattern_join", "state_pattern_dedupe", "replica_lag_status", "replica_lag_alert"}


def test_no_cartesian_products(spark):
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")     # plan as if every input were large
    try:
        bad = {}
        for name, fn in sorted(registry.QUERIES.items()):
            if name.startswith("stream_"):
                continue
            plan = fn(spark, SF_SMALL)._jdf.queryExecution().executedPlan().toString()
            found = set(re.findall(r"CartesianProduct|BroadcastNestedLoopJoin", plan))
            if "CartesianProduct" in found or ("BroadcastNestedLoopJoin" in found and name not in NESTED_LOOP_OK):
                bad[name] = sorted(found)
        assert not bad, bad
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)


def test_scans_of_chain_totals(spark):
    """Two look-backs of two scans each, however many columns a chain has."""
    for name in ("chain_totals", "rto_worst"):
        plan = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") <= 4, (name, plan.count("Relation ["))


def test_one_pass_queries(spark):
    """Checks, dimensions and metrics share one scan of their input (two tables make a deadlock document)."""
    for name, scans in (("deadlock_findings", 2), ("event_counts_by_dim", 2), ("wait_by_object", 2), ("multi_metric_topn", 1),
                        ("points_topn", 1), ("rank_by_all", 1), ("greedy_topn", 1), ("dual_rank", 1)):
        plan = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("Relation [") == scans, (name, plan.count("Relation ["))
