"""Dialect semantics: boundary DATEDIFF, safe division, exact rounding, size text."""

from pyspark.sql import functions as F

from opslake.functions import scalar as S
from opslake.functions import semantics as M


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def ts(x):
    return F.lit(x).cast("timestamp_ntz")


def test_datediff_counts_boundaries(spark):
    r = one(spark,
            M.datediff("month", ts("2024-01-31 00:00:00"), ts("2024-02-01 00:00:00")).alias("m"),
            M.datediff("minute", ts("2024-01-01 10:00:59"), ts("2024-01-01 10:01:00")).alias("mi"),
            M.datediff("year", ts("2023-12-31 23:59:59"), ts("2024-01-01 00:00:00")).alias("y"),
            M.datediff("second", ts("2024-01-01 00:00:00.900"), ts("2024-01-01 00:00:01.100")).alias("s"),
            M.datediff("minute", ts("2024-01-01 10:01:00"), ts("2024-01-01 10:00:59")).alias("neg"))
    assert (r.m, r.mi, r.y, r.s, r.neg) == (1, 1, 1, 1, -1)


def test_safe_division(spark):
    r = one(spark, M.safe_div(F.lit(5), F.lit(0)).alias("a"), M.safe_div0(F.lit(5), F.lit(0)).alias("b"),
            M.idiv(F.lit(7), F.lit(2)).alias("c"), M.idiv(F.lit(-7), F.lit(2)).alias("d"),
            M.idiv(F.lit(7), F.lit(0)).alias("e"))
    assert r.a is None and r.b == 0.0 and r.c == 3 and r.d == -3 and r.e is None


def test_round_div_half_up(spark):
    r = one(spark, M.round_div(F.lit(5), F.lit(2), 0).alias("a"), M.round_div(F.lit(1), F.lit(8), 2).alias("b"),
            M.fixed_text(F.lit(1), F.lit(8), 2).alias("c"), M.fixed_text(F.lit(3), F.lit(1), 2).alias("d"))
    assert r.a == 3.0 and r.b == 0.13 and r.c == "0.13" and r.d == "3.00"


def test_human_bytes(spark):
    r = one(spark, S.human_bytes(F.lit(1536)).alias("k"), S.human_bytes(F.lit(5 * 1024 ** 2)).alias("m"),
            S.human_bytes(F.lit(int(2.25 * 1024 ** 3))).alias("g"))
    assert (r.k, r.m, r.g) == ("1.50KB", "5.00MB", "2.3GB")


def test_scalars(spark):
    r = one(spark, S.dirname(F.lit("C:\\data\\x.mdf")).alias("d"), S.dirname(F.lit("x.mdf")).alias("d2"),
            S.parsename(F.lit("srv.db.dbo.t"), 3).alias("p3"), S.parsename(F.lit("dbo.t"), 3).alias("p_none"),
            S.prefix_before(F.lit("a:b:c")).alias("pre"), S.prefix_before(F.lit("abc")).alias("pre2"),
            S.duration_text(F.lit(90061001)).alias("dur"), S.thousands(F.lit(1234567)).alias("th"),
            S.try_int(F.lit("12x")).alias("bad"), S.clean_text(F.lit("a\tb\nc")).alias("cl"))
    assert r.d == "C:\\data\\" and r.d2 == "x.mdf" and r.p3 == "db" and r.p_none is None
    assert r.pre == "a" and r.pre2 == "abc" and r.dur == "01 01:01:01.001" and r.th == "1,234,567"
    assert r.bad is None and r.cl == "a b c"


def test_ci_like_and_eq(spark):
    r = one(spark, M.ci_eq(F.lit("Sleep"), "sleep").alias("e"), M.ci_like(F.lit("Sleep"), "SLE%").alias("l"))
    assert r.e and r.l
