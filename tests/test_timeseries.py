"""Skew-safe look-backs equal the plain window results, including a hot key."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from opslake.operators import timeseries as TS
from opslake.operators.timeseries import asof_join, fill_last, prev_row


def _data(spark, n=3000, seed=7):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        g = "hot" if rnd.random() < 0.4 else f"g{rnd.randint(0, 20)}"
        v = i if rnd.random() < 0.15 else None
        rows.append((g, rnd.randint(0, 5000), i, v))
    return spark.createDataFrame(rows, "g string, t bigint, id bigint, v bigint")


def test_fill_last_matches_window(spark):
    df = _data(spark)
    for strict in (False, True):
        hi = -1 if strict else 0
        w = Window.partitionBy("g").orderBy("t", "id").rowsBetween(Window.unboundedPreceding, hi)
        want = df.withColumn("x", F.last("v", ignorenulls=True).over(w))
        got = fill_last(df, ["g"], ["t", "id"], "v", F.floor(F.col("t") / 250), "x", strict=strict)
        a = sorted(tuple(r) for r in want.select("g", "t", "id", "x").collect())
        b = sorted(tuple(r) for r in got.select("g", "t", "id", "x").collect())
        assert a == b


def test_prev_row_matches_lag(spark):
    df = _data(spark)
    w = Window.partitionBy("g").orderBy("t", "id")
    want = df.withColumn("prev_id", F.lag("id").over(w))
    got = prev_row(df, ["g"], ["t", "id"], ["id"], F.floor(F.col("t") / 100))
    assert sorted(want.select("id", "prev_id").collect()) == sorted(got.select("id", "prev_id").collect())


def test_asof_join_inclusive_and_ties(spark):
    left = spark.createDataFrame([("a", 10, 1), ("a", 20, 2), ("a", 5, 3), ("b", 10, 4)], "k string, lt bigint, lid int")
    right = spark.createDataFrame([("a", 10, 100), ("a", 10, 101), ("a", 15, 102), ("b", 11, 103)],
                                  "k string, rt bigint, rid int")
    base = F.lit("2024-01-01 00:00:00").cast("timestamp_ntz")
    lj = left.withColumn("lt", F.timestamp_add("SECOND", F.col("lt"), base))
    rj = right.withColumn("rt", F.timestamp_add("SECOND", F.col("rt"), base))
    got = {r.lid: r.rid for r in asof_join(lj, rj, ["k"], "lt", "rt", ["rid"], tie="rid").collect()}
    assert got == {1: 101, 2: 102, 3: None, 4: None}
    strict = {r.lid: r.rid for r in asof_join(lj, rj, ["k"], "lt", "rt", ["rid"], tie="rid", inclusive=False).collect()}
    assert strict == {1: None, 2: 102, 3: None, 4: None}


def test_skew_safe_numbering_matches_windows(spark):
    from opslake.operators.timeseries import dense_rank, ntile, row_number
    df = _data(spark).withColumn("t2", F.col("t") % 900)
    w = Window.partitionBy("g").orderBy("t", "id")
    want = df.select("id", F.row_number().over(w).alias("rn"), F.ntile(3).over(w).alias("tile"),
                     F.dense_rank().over(Window.partitionBy("g").orderBy("t2")).alias("drk"))
    got = row_number(df, ["g"], ["t", "id"], F.floor(F.col("t") / 300), "rn")
    got = ntile(got, ["g"], ["t", "id"], F.floor(F.col("t") / 300), 3, "tile")
    got = dense_rank(got, ["g"], "t2", F.floor(F.col("t2") / 100), "drk")
    a = sorted(tuple(r) for r in want.collect())
    b = sorted(tuple(r) for r in got.select("id", "rn", "tile", "drk").collect())
    assert a == b


def _one_day(spark):
    """One group with 60 % of all rows, half of them within one day; a null group; ties."""
    rnd = random.Random(5)
    rows = []
    for i in range(20_000):
        g = "hot" if rnd.random() < 0.6 else rnd.choice(["a", "b", None])
        t = 86_400 * 40 + rnd.randrange(86_400) if rnd.random() < 0.5 else rnd.randrange(86_400 * 100)
        rows.append((g, t, i, i if rnd.random() < 0.2 else None))
    return spark.createDataFrame(rows, "g string, t bigint, id bigint, v bigint").withColumn(
        "ts", F.timestamp_add("SECOND", F.col("t").cast("int"), F.lit("2024-01-01").cast("timestamp_ntz")))


def test_sketched_buckets_are_bounded(spark):
    df = _one_day(spark)
    for by, col in ((["g"], "ts"), ([], "t"), (["g"], "id")):
        b = TS.bounded_buckets(df, by, col, "b", rows=500)
        assert b.groupBy(*by, "b").count().agg(F.max("count")).first()[0] <= 1000
        w = Window.partitionBy(*by).orderBy(col)  # never falls within a group
        assert b.withColumn("p", F.lag("b").over(w)).where("p > b").count() == 0
    assert TS.bounded_buckets(df, ["g"], "ts", "b").select("b").distinct().count() == 1  # small groups are one bucket


def test_sketched_look_backs_equal_windows(spark, monkeypatch):
    monkeypatch.setattr(TS, "ROWS", 500)
    df = _one_day(spark).cache()
    w = Window.partitionBy("g").orderBy("ts", "id")
    cols = ["id", "x"]
    rows = lambda d: sorted(((r[0], r[1]) for r in d.select(*cols).collect()), key=lambda r: r[0])
    assert rows(fill_last(df, ["g"], ["ts", "id"], "v", None, "x")) == rows(df.withColumn("x", F.last("v", ignorenulls=True).over(w)))
    assert rows(prev_row(df, ["g"], ["ts", "id"], ["id"]).withColumnRenamed("prev_id", "x")) == rows(df.withColumn("x", F.lag("id").over(w)))
    assert rows(TS.row_number(df, ["g"], ["ts", "id"], out="x")) == rows(df.withColumn("x", F.row_number().over(w)))
    assert rows(TS.row_number(df, [], ["ts", "id"], out="x")) == rows(df.withColumn("x", F.row_number().over(Window.orderBy("ts", "id"))))
    wd = Window.partitionBy("g").orderBy("ts")
    assert rows(TS.dense_rank(df, ["g"], "ts", out="x")) == rows(df.withColumn("x", F.dense_rank().over(wd)))
    assert rows(TS.ntile(df, ["g"], ["ts", "id"], None, 7, "x")) == rows(df.withColumn("x", F.ntile(7).over(w)))
