"""Hand-checked cases: findings engine (skip list, ceiling), bit names, ACL explode, grant inheritance."""

from pyspark.sql import functions as F

from opslake.operators import deadlocks as X
from opslake.operators import grants as G
from opslake.operators import rules as RE


def _rule(check_id, priority, rows):
    def build(inputs, as_of):
        return inputs["t"].sparkSession.createDataFrame(
            rows, "scope string, object_name string, details string, details_num double")
    return RE.Rule(check_id, priority, "g", f"f{check_id}", build)


def test_engine_skip_and_ceiling(spark):
    t = spark.range(1)
    rules = [_rule(1, 10, [("db1", "a", "x", 1.0), ("db2", "b", "y", 2.0)]),
             _rule(2, 50, [("db1", "c", "z", None)]),
             _rule(3, 250, [("db1", "d", "w", 3.0)])]
    skip = spark.createDataFrame([("db2", 1), (None, 2)], "scope string, check_id int")
    out = RE.run_rules({"t": t}, rules, "2024-01-31 00:00:00", skip, max_priority=200)
    assert [(f.name, f.dataType) for f in out.schema] == [(f.name, f.dataType) for f in RE.FINDING]
    assert sorted((r.check_id, r.scope) for r in out.collect()) == [(1, "db1")]


def test_client_option_names(spark):
    r = spark.range(1).select(X.bit_names(F.lit(2 | 32 | 4096), X.CLIENT_OPTIONS_1).alias("a"),
                              X.bit_names(F.lit(0), X.CLIENT_OPTIONS_1).alias("b")).first()
    assert r.a == "IMPLICIT_TRANSACTIONS, ANSI_NULLS, CONCAT_NULL_YIELDS_NULL" and r.b == ""


def test_acl_explode(spark):
    df = spark.createDataFrame([("t1", "{alice=arw/owner,bob=r/owner}")], "relation string, relacl string")
    got = sorted((r.grantee, r.grantor, r.privilege_type) for r in G.acl_explode(df).collect())
    assert got == [("alice", "owner", "INSERT"), ("alice", "owner", "SELECT"), ("alice", "owner", "UPDATE"),
                   ("bob", "owner", "SELECT")]


def test_grant_inheritance(spark):
    specs = spark.createDataFrame([("p", None, "a,b", "w1"), ("c", "p", None, None), ("d", "p", "x", "w2")],
                                  "service string, parent string, read_tables string, write_tables string")
    got = sorted((r.service, r.table_name, r.privileges.split(",")[0]) for r in G.expand_grant_specs(specs).collect())
    assert ("c", "a", "SELECT") in got and ("c", "w1", "SELECT") in got        # parent's lists, parent writes readable
    assert [g for g in got if g[0] == "d"] == [("d", "w1", "SELECT"), ("d", "w2", "SELECT"), ("d", "x", "SELECT")]


def test_a_pack_reads_its_input_twice(spark, tmp_path):
    from opslake.operators.rulepacks.index_rules import index_pack
    from opslake.sources import fixtures as fx
    path = str(tmp_path / "indexes")
    fx.index_inventory(spark, "/root/testdata/sf0.001").write.parquet(path)
    # the group pass has run by the time the plan is there; what is left reads the rows once
    plan = RE.run_rules({"indexes": spark.read.parquet(path)}, [index_pack()], "2024-01-31 00:00:00")._jdf.queryExecution().executedPlan().toString()
    assert sum("FileScan" in line and str(tmp_path) in line for line in plan.splitlines()) == 1


def test_schemas_are_kept_apart(spark):
    """Two tables of one name in two schemas: neither duplicates nor a heap of the other count."""
    from opslake.operators.rulepacks.index_rules import index_pack
    from opslake.sources import fixtures as fx
    one = fx.index_inventory(spark, "/root/testdata/sf0.001").limit(1).withColumns({
        "index_type": F.lit("NONCLUSTERED"), "is_primary_key": F.lit(True), "is_disabled": F.lit(False), "total_pages": F.lit(1 << 40),
        "key_columns": F.lit("a,b"), "first_key_column": F.lit("a")})
    rows = (one.withColumn("schema_name", F.lit("s1")).union(one.withColumn("schema_name", F.lit("s2")).withColumn("index_type", F.lit("HEAP")))
            .union(one.withColumn("schema_name", F.lit("s2")).withColumn("is_primary_key", F.lit(False)))
            .union(one.withColumn("schema_name", F.lit("s1")).withColumn("is_primary_key", F.lit(False)).withColumn("key_columns", F.lit("a,c"))))
    got = RE.run_rules({"indexes": rows}, [index_pack()], "2024-01-31 00:00:00").where("check_id in (1, 2, 47)").collect()
    assert {(r["check_id"], r["object_name"].split(".")[0]) for r in got} == {(2, "s1")}


def test_effective_permissions_through_nested_and_cyclic_roles(spark):
    members = spark.createDataFrame([("r1", "u"), ("r2", "r1"), ("r3", "r2"), ("r4", "r3"), ("r3", "r4"), ("r9", "r9"), ("r9", "v")], "role string, member string")
    assert sorted(tuple(r) for r in G.role_closure(members.where("member like 'r%'")).collect()) == [
        ("r1", "r2"), ("r1", "r3"), ("r1", "r4"), ("r2", "r3"), ("r2", "r4"), ("r3", "r4"), ("r4", "r3")]
    own = spark.createDataFrame([("r3", "table", "t", "SELECT"), ("r3", "table", "t", "SELECT"), ("u", "table", "x", "SELECT"), ("r9", "table", "y", "SELECT")],
                                "grantee string, object_kind string, object_name string, privilege string")
    got = G.effective_permissions(own, members, lambda c: F.startswith(c, F.lit("r")))
    assert sorted((r["grantee"], r["object_name"], r["via"]) for r in got.where("via is not null").collect()) == [
        ("r1", "t", "r3"), ("r2", "t", "r3"), ("r4", "t", "r3"), ("u", "t", "r3"), ("v", "y", "r9")]
    assert got.where("via is null").count() == 3
