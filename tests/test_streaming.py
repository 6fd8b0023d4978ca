"""Streaming forms equal their batch forms (windows restricted to those the watermark closed)."""

from pyspark.sql import functions as F

from opslake.sources import fixtures as fx
from opslake.streaming import streams as ST

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_stream_collector_equals_batch(spark):
    s = fx.processlist_from(ST.table_stream(spark, SF_SMALL, "events"))
    got = ST.run_available_now(ST.collector(s), "t-collector")
    from opslake.operators.filters import collector
    assert _rows(got) == _rows(collector(fx.processlist(spark, SF_SMALL)))


def test_tumbling_windows_close_with_watermark(spark):
    s = fx.findings_from(ST.table_stream(spark, SF_SMALL, "events"))
    got = ST.run_available_now(ST.tumbling_counts(s, "check_date", ["priority"], "1 day", "1 hour"), "t-tumble")
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    bound = ev.agg(F.max("ts")).first()[0]
    assert got.agg(F.max("window_end")).first()[0] <= bound
    batch = (fx.findings_log(spark, SF_SMALL).groupBy(F.date_trunc("day", "check_date").alias("window_start"), "priority")
             .count())
    closed = batch.filter(F.timestamp_add("DAY", F.lit(1), F.col("window_start")) <= F.timestamp_add("HOUR", F.lit(-1), F.lit(bound)))
    assert got.count() == closed.count()


def test_cdc_foreach_batch_is_idempotent_result(spark):
    a = fx.audit_trail(spark, SF_SMALL)
    base = a.select("id", "customer_id", "action")
    ch = a.filter(F.col("id") % 3 == 0).select("id", F.lit("U").alias("op"), F.col("action_date").alias("changed_at"),
                                             "customer_id", F.lit("Z").alias("action"))
    path = ST.scratch_path(spark, "t-changes")
    ch.write.parquet(path)
    s = ST.file_stream(spark, f"{path}/*.parquet", spark.read.parquet(path).schema)
    got = ST.cdc_foreach_batch(s, base, ["id"], "changed_at", "t")
    assert got.count() == base.count()
    assert got.filter("action = 'Z'").count() == ch.count()


def test_stream_resumes_from_its_path(spark, tmp_path):
    schema = "k long, v long"
    spark.createDataFrame([(1, 1), (2, 2)], schema).write.parquet(str(tmp_path / "in/a.parquet"))
    stream = lambda: ST.file_stream(spark, f"{tmp_path}/in/*.parquet", spark.read.parquet(str(tmp_path / "in/a.parquet")).schema)
    assert ST.run_available_now(stream(), "t-resume", path=str(tmp_path / "out")).count() == 2
    spark.createDataFrame([(3, 3)], schema).write.parquet(str(tmp_path / "in/b.parquet"))
    assert _rows(ST.run_available_now(stream(), "t-resume", path=str(tmp_path / "out"))) == [(1, 1), (2, 2), (3, 3)]
