"""Hand-checked cases for purge, sessions, rankings, joins and rules."""

import datetime as dt

from pyspark.sql import functions as F

from opslake.operators import joins as J
from opslake.operators import purge as P
from opslake.operators import ranking as R
from opslake.operators import sessions as S


def test_id_threshold_exact(spark):
    ids = spark.createDataFrame([(i,) for i in [5, 1, 9, 100000, 7, 3, 2_000_000, 8, 4]], "id bigint")
    order = sorted([5, 1, 9, 100000, 7, 3, 2_000_000, 8, 4])
    for n in range(1, 10):
        assert P.id_threshold(ids, "id", n, buckets=4) == order[n - 1]


def test_purge_cycle_conserves_rows(spark, tmp_path):
    rows = [(i, dt.datetime(2000, 1, 1) + dt.timedelta(days=i % 700)) for i in range(500)]
    src = spark.createDataFrame(rows, "id bigint, action_date timestamp_ntz")
    log = P.purge_cycle(src, "2001-08-02 00:00:00", str(tmp_path), limit=60, max_runs=15).collect()
    assert log and all(r.archived_rows == 60 for r in log)
    assert log[-1].source_rows_after + sum(r.archived_rows for r in log) == 500
    # batches take the oldest ids first and never overlap
    assert all(a.max_id < b.min_id for a, b in zip(log, log[1:]))


def test_sessions_of_two_servers_are_kept_apart(spark):
    rows = [("a", 51, None), ("a", 52, 51), ("a", 53, 52), ("b", 51, 52), ("b", 52, None), ("b", 60, None), ("b", 60, 51)]
    s = spark.createDataFrame(rows, "server_name string, session_id long, blocking_session_id long")
    got = {(r.server_name, r.leader_session_id): (r.blocked_count, r.max_depth) for r in S.block_leaders(s, by=("server_name",)).collect()}
    assert got == {("a", 51): (2, 2), ("b", 52): (2, 2)}  # a session with a blocked request is blocked


def test_block_leaders_with_cycle(spark):
    # 1 <- 2 <- 3, 1 <- 4; 5 <-> 6 cycle; 7 blocked by 6 (under the cycle); 8 alone
    rows = [(1, None), (2, 1), (3, 2), (4, 1), (5, 6), (6, 5), (7, 6), (8, None)]
    s = spark.createDataFrame(rows, "session_id bigint, blocking_session_id bigint")
    got = {r.leader_session_id: (r.blocked_count, r.max_depth) for r in S.block_leaders(s).collect()}
    assert got == {1: (3, 2)}


def test_greedy_topn_no_repeated_key(spark):
    df = spark.createDataFrame([(i, i % 7, (i * 13) % 11) for i in range(40)], "query_hash int, a int, b int")
    out = R.greedy_top_n(df, {"a": F.col("a"), "b": F.col("b")}, 5).collect()
    keys = [r.query_hash for r in out]
    assert len(keys) == len(set(keys)) == 10


def test_best_per_key(spark):
    df = spark.createDataFrame([("x", 1, 5), ("x", 2, 9), ("x", 3, 9), ("y", 4, 1)], "k string, id int, v int")
    got = {r.k: r.id for r in R.best_per_key(df, ["k"], ["v", "id"]).collect()}
    assert got == {"x": 3, "y": 4}


def test_prefix_join_semantics(spark):
    left = spark.createDataFrame([(1, "Wait"), (2, ""), (3, None), (4, "Nope"), (5, "W_it")], "id int, state string")
    pats = spark.createDataFrame([("Waiting a", "t1"), ("Waiting b", "t2"), ("Other", "t3")], "p string, kind string")
    got = sorted((r.id, r.p) for r in J.prefix_join(left, "state", pats, "p").collect())
    assert got == [(1, "Waiting a"), (1, "Waiting b"), (2, "Other"), (2, "Waiting a"), (2, "Waiting b"),
                   (3, None), (4, None), (5, "Waiting a"), (5, "Waiting b")]


def test_anti_skip_list_null_wildcards(spark):
    f = spark.createDataFrame([("db1", 1), ("db1", 2), ("db2", 1), ("db3", 3)], "database_name string, check_id int")
    skip = spark.createDataFrame([("db1", 1), (None, 3)], "database_name string, check_id int")
    got = sorted(tuple(r) for r in J.anti_skip_list(f, skip, ["database_name", "check_id"]).collect())
    assert got == [("db1", 2), ("db2", 1)]
    everything = spark.createDataFrame([(None, None)], "database_name string, check_id int")
    assert J.anti_skip_list(f, everything, ["database_name", "check_id"]).count() == 0


def test_id_thresholds_many_targets_wide_keys(spark):
    import random
    rnd = random.Random(3)
    ids = sorted(set(rnd.randrange(0, 2 ** 62) for _ in range(5000)) | {7, 8, 9})
    df = spark.createDataFrame([(i,) for i in ids], "id bigint")
    targets = [1, 2, 3, 100, 2500, 4999, len(ids), len(ids) + 10]
    got = P.id_thresholds(df, "id", targets, buckets=64)
    assert got == {t: ids[min(t, len(ids)) - 1] for t in targets}


def test_retention_per_server(spark):
    from opslake.operators.extract import retention_keep
    rows = [("a", dt.datetime(2024, 1, d)) for d in range(1, 31)] + [("b", dt.datetime(2024, 1, d)) for d in range(1, 31)]
    df = spark.createDataFrame(rows, "server_name string, check_date timestamp_ntz")
    per = spark.createDataFrame([("a", 3)], "server_name string, retention_days int")
    got = {r.server_name: r.n for r in retention_keep(df, "check_date", "2024-01-31 00:00:00", 7, "server_name", per)
           .groupBy("server_name").count().withColumnRenamed("count", "n").collect()}
    assert got == {"a": 3, "b": 7}


def test_merge_changes_ignores_late_changes_of_later_batches(spark):
    from opslake.operators.extract import change_state, current_rows, merge_changes
    cols = "id int, op string, seq int, v string"
    first = spark.createDataFrame([(1, "U", 5, "new"), (2, "D", 5, None), (3, "U", 1, "a")], cols)
    late = spark.createDataFrame([(1, "U", 3, "old"), (2, "U", 4, "back"), (3, "U", 2, "b"), (4, "I", 1, "w"), (5, "D", 9, None)], cols)
    state = change_state(spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (6, "k")], "id int, v string"), first, "seq")
    for batch in (first, late, late):
        state = merge_changes(state, batch, ["id"], "seq")
    got = sorted(tuple(r) for r in current_rows(state, "seq").collect())
    assert got == [(1, "new"), (3, "b"), (4, "w"), (6, "k")]


def test_chains_keep_servers_and_guids_apart(spark):
    """One name on two servers, and twice on one of them: no backup is counted to another database's full."""
    import datetime as dt

    from opslake.operators import backups as B
    rows = []
    for s, g in (("a", "g1"), ("a", "g2"), ("b", "g1")):
        for i, t in enumerate("LDLILLDL"):
            at = dt.datetime(2024, 1, 1, i)
            rows.append((s, g, "db", i, t, i * 10, at, at + dt.timedelta(seconds=60), (i + 1) << 20))
    b = spark.createDataFrame(rows, "server_name string, database_guid string, database_name string, backup_set_id long, type string, "
                                    "first_lsn long, backup_start_date timestamp_ntz, backup_finish_date timestamp_ntz, backup_size long")
    got = [r.asDict() for r in B.chains(b).orderBy("server_name", "database_guid", "full_id").collect()]
    assert len(got) == 6
    for one, two in zip(got[::2], got[1::2], strict=True):
        assert (one["full_id"], one["next_full_id"], one["log_count"], one["latest_diff_id"], one["logs_to_apply"]) == (1, 6, 3, 3, 2)
        assert (one["total_mb"], one["total_seconds"], one["worst_log_mb"]) == (2 + 4 + 5 + 6, 240, 6)
        assert (two["full_id"], two["next_full_id"], two["log_count"], two["latest_diff_id"], two["total_mb"]) == (6, None, 1, None, 15)
    assert [r["rpo_worst_minutes"] for r in B.rpo_worst(b).collect()] == [60, 60, 60]


def test_purge_two_cycles_keep_both_archives(spark, tmp_path):
    src = spark.range(1000).select(F.col("id"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz").alias("action_date"))
    first = P.purge_cycle(src, "2001-08-02 00:00:00", str(tmp_path), limit=60, max_runs=5)
    second = P.purge_cycle(spark.read.parquet(f"{tmp_path}/source/v=000001"), "2001-08-02 00:00:00", str(tmp_path), limit=60, max_runs=5)
    assert first.count() == second.count() == 5
    archive = spark.read.parquet(f"{tmp_path}/archive")
    left = spark.read.parquet(f"{tmp_path}/source/v=000002")
    assert archive.count() == archive.select("id").distinct().count() == 600 and left.count() == 400
    assert left.agg(F.min("id")).first()[0] == 600
    assert archive.groupBy("cycle").count().count() == 2


def test_id_thresholds_on_wide_keys(spark):
    keys = sorted(x for k in range(-8, 9) for x in (k * 2**50 - 1, k * 2**50)) + [2**62 - 1, 2**62, 2**63 - 1]
    keys = sorted(set(keys) | {-2**63})
    df = spark.createDataFrame([(k,) for k in keys], "id long")
    want = {n: keys[n - 1] for n in range(1, len(keys) + 1)}
    assert P.id_thresholds(df, "id", list(want), buckets=16) == want


def test_no_query_leaves_a_cache(spark):
    from opslake.plans import registry
    registry.load_all()
    spark.catalog.clearCache()
    for name in ("greedy_topn", "deadlock_findings"):
        registry.QUERIES[name](spark, "/root/testdata/sf0.001").count()
    assert spark.sparkContext._jsc.getPersistentRDDs().size() == 0
