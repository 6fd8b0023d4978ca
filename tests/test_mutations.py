"""Adversarial mutations: removing an operator's guard must break the oracle comparison."""

import duckdb
import pytest
from pyspark.sql import functions as F

from opslake.operators import extract as X
from opslake.operators import joins as J
from opslake.operators import purge as P
from opslake.operators import snapshots as T
from opslake.plans import registry
from opslake.sources import fixtures as fx
from opslake.sources.tables import TABLES, table

from conftest import SF_SMALL

registry.load_all()


SF_MID = "/root/testdata/sf0.01"   # the restart needs hourly snapshots without gaps around it


def _con(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return c


@pytest.fixture(scope="module")
def con():
    return _con(SF_SMALL)


@pytest.fixture(scope="module")
def con_mid():
    return _con(SF_MID)


def _n(con, name):
    return con.execute(f"SELECT COUNT(*) FROM ({registry.ORACLES[name]})").fetchone()[0]


def test_without_restart_guard_counts_differ(spark, con_mid):
    waits = fx.wait_snapshots(spark, SF_MID)
    good = T.snapshot_delta(waits, ["wait_type"], ["wait_time_ms"], monotonic=["wait_time_ms"]).count()
    bad = T.snapshot_delta(waits, ["wait_type"], ["wait_time_ms"], monotonic=[]).count()
    assert good == _n(con_mid, "wait_deltas") and bad != good


def test_without_gap_guard_counts_differ(spark, con_mid):
    waits = fx.wait_snapshots(spark, SF_MID)
    bad = T.snapshot_delta(waits, ["wait_type"], ["wait_time_ms"], monotonic=["wait_time_ms"],
                           max_gap_minutes=None).count()
    assert bad != _n(con_mid, "wait_deltas")


def test_per_metric_lag_is_not_the_snapshot_rule(spark):
    """A plain lag per metric pairs a metric with an older snapshot when it was missing.

    With hourly snapshots the 60-minute gap guard hides the difference, so
    both forms are compared without it.
    """
    from pyspark.sql import Window
    w = fx.wait_snapshots(spark, SF_MID)
    lw = Window.partitionBy("server_name", "wait_type").orderBy("check_date")
    lagged = w.withColumn("p", F.lag("check_date").over(lw)).filter(F.col("p").isNotNull())
    rule = T.snapshot_delta(w, ["wait_type"], ["wait_time_ms"], min_gap_minutes=None, max_gap_minutes=None)
    assert lagged.count() > rule.count()


def test_strict_purge_gate(spark):
    audit = fx.audit_trail(spark, SF_SMALL)
    total = P.eligible_count(audit, fx.AS_OF_AUDIT).first()["total"]
    assert P.gate(P.eligible_count(audit, fx.AS_OF_AUDIT), total).first()["proceed"] is False
    assert P.gate(P.eligible_count(audit, fx.AS_OF_AUDIT), total - 1).first()["proceed"] is True


def test_skip_list_wildcards_matter(spark, con):
    f = fx.index_inventory(spark, SF_SMALL).select(
        "database_name", (F.col("index_id") % 5 + 1).alias("check_id"), F.col("index_name").alias("finding"))
    n = table(spark, SF_SMALL, "nation")
    k = F.col("n_nationkey")
    skip = n.select(F.when(k % 5 == 0, F.lit(None).cast("string"))
                    .otherwise(F.concat(F.lit("db"), (k % 4).cast("string"))).alias("database_name"),
                    F.when(k % 12 == 1, F.lit(None).cast("bigint")).otherwise(k % 13 + 1).alias("check_id"))
    good = J.anti_skip_list(f, skip, ["database_name", "check_id"]).count()
    plain = f.join(skip, ["database_name", "check_id"], "left_anti").count()   # NULL treated as a value
    assert good == _n(con, "skip_list_anti") and plain != good


def test_inner_vs_semi_extraction(spark):
    """A non-unique parent key duplicates child rows in inner mode only."""
    t = {"nation": table(spark, SF_SMALL, "nation"),
         "customer": table(spark, SF_SMALL, "customer").unionByName(table(spark, SF_SMALL, "customer").limit(5))}
    spec = X.TenantSpec("customer", "n_nationkey", [X.Hop("nation", "c_nationkey", "n_nationkey")])
    orders = table(spark, SF_SMALL, "orders")
    t["orders"] = orders
    spec2 = X.TenantSpec("orders", "n_nationkey", [X.Hop("customer", "o_custkey", "c_custkey"),
                                                   X.Hop("nation", "c_nationkey", "n_nationkey")])
    inner = X.extract(t, spec2).count()
    semi = X.extract(t, spec2, mode="semi").count()
    assert semi == orders.count() and inner > semi
    assert X.extract(t, spec).count() == t["customer"].count()
