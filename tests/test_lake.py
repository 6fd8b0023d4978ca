"""Commits over several tables, archive-and-clear, change apply by bucket, retention by partition, timed copies, snapshot streams."""

import os

import pytest
from pyspark.sql import functions as F

from opslake.operators import snapshots as T
from opslake.sources.lake import BucketedTable, Lake, archive_and_clear, purge_days, timed_copy, write_by_day
from opslake.streaming import snapshot_deltas as SD
from opslake.streaming import streams as ST

from conftest import SF_SMALL


def _rows(df):
    return sorted(tuple(r) for r in df.collect())


def _files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


class Stopped(Exception):
    pass


def test_archive_and_clear_repeats_safely(spark, tmp_path, monkeypatch):
    schema = "id int, v string"
    df = spark.createDataFrame([(1, "a"), (2, "b")], schema)
    lake = Lake(spark, str(tmp_path))
    lake.commit(lake.current(), {"a": [lake.write(lake.current(), "a", df)], "b": [lake.write(lake.current(), "b", df)]})
    job = ({"a": schema, "b": schema}, {"a_hist": ("a", lambda x: x), "b_hist": ("b", lambda x: x.where("id > 1"))})

    def stop(*_):
        raise Stopped
    with monkeypatch.context() as m:  # stopped after the append is written and before the commit
        m.setattr(Lake, "commit", stop)
        with pytest.raises(Stopped):
            archive_and_clear(lake, *job)
    assert lake.read(lake.current(), "a", schema).count() == 2 and lake.read(lake.current(), "a_hist", schema).count() == 0
    version = archive_and_clear(lake, *job)
    assert archive_and_clear(lake, *job) == version  # the sources are empty now: nothing happens
    now = lake.current()
    assert [lake.read(now, t, schema).count() for t in ("a", "b", "a_hist", "b_hist")] == [0, 0, 2, 1]
    lake.commit(now, {"a": [lake.write(now, "a", df)]})
    assert archive_and_clear(lake, *job) == version + 1  # one empty source: nothing is appended or cleared
    now = lake.current()
    assert [lake.read(now, t, schema).count() for t in ("a", "b", "a_hist", "b_hist")] == [2, 0, 2, 1]


def test_a_commit_is_not_written_twice(spark, tmp_path):
    lake = Lake(spark, str(tmp_path))
    base = lake.current()
    lake.commit(base, {"t": []})
    with pytest.raises(RuntimeError):
        lake.commit(base, {"t": ["x"]})


CHANGES = "id int, op string, seq int, v string"


def test_change_apply_rewrites_only_touched_buckets(spark, tmp_path):
    base = spark.range(4000).select(F.col("id").cast("int").alias("id"), F.lit("x").alias("v"))
    first = spark.createDataFrame([(1, "U", 5, "new"), (2, "D", 5, None), (5000, "I", 1, "w")], CHANGES)
    lake = Lake(spark, str(tmp_path))
    t = BucketedTable(lake, "t", ["id"], "seq", buckets=32, files=2)
    t.create(base, first)
    schema = t.schema(base, first)
    before = lake.current().tables
    touched = t.apply(first, schema, 0)
    after = lake.current().tables
    assert 1 <= len(touched) <= 3
    assert {k for k in after if after[k] != before.get(k)} == {f"t/bucket={b}" for b in touched}  # the rest keeps its files
    assert t.apply(first, schema, 0) == []  # the same batch again
    late = spark.createDataFrame([(1, "U", 3, "old"), (2, "U", 4, "back"), (3, "U", 1, "b")], CHANGES)
    t.apply(late, schema, 1)
    want = [(i, {1: "new", 3: "b"}.get(i, "x")) for i in range(4000) if i != 2] + [(5000, "w")]
    assert _rows(t.rows(schema)) == sorted(want)
    assert t.apply(late.limit(0), schema, 2) == []


def test_change_stream_resumes(spark, tmp_path):
    base = spark.createDataFrame([(i, "x") for i in range(50)], "id int, v string")
    src = str(tmp_path / "in")
    spark.createDataFrame([(1, "U", 9, "new")], CHANGES).write.parquet(f"{src}/a.parquet")
    run = lambda: ST.cdc_foreach_batch(ST.file_stream(spark, f"{src}/*.parquet", spark.read.parquet(f"{src}/a.parquet").schema),
                                       base, ["id"], "seq", "t", path=str(tmp_path / "out"), buckets=8)
    assert dict(_rows(run()))[1] == "new"
    spark.createDataFrame([(1, "U", 3, "old"), (2, "D", 1, None)], CHANGES).write.parquet(f"{src}/b.parquet")
    got = dict(_rows(run()))
    assert got[1] == "new" and 2 not in got and len(got) == 49


def test_retention_keeps_untouched_folders(spark, tmp_path):
    rows = [(s, f"2024-01-{d:02d} {h:02d}:00:00", d * 100 + h) for s in ("a", "b c/d", "e") for d in range(1, 21) for h in (0, 6, 18)]
    df = spark.createDataFrame(rows, "server string, t string, v int").select("server", F.col("t").cast("timestamp_ntz").alias("ts"), "v")
    path = str(tmp_path / "t")
    write_by_day(df, path, "server", "ts")
    files = _files(path)
    own = spark.createDataFrame([("a", 2), ("e", 400)], "server string, retention_days int")
    done = purge_days(spark, path, "server", "ts", "2024-01-20 12:00:00", 9, own)
    horizon = {"a": "2024-01-18 12", "b c/d": "2024-01-11 12", "e": "2022-12-16 12"}
    want = sorted((s, v) for s, t, v in rows if t >= horizon[s])
    schema = df.withColumn("day", F.to_date("ts")).schema
    assert _rows(spark.read.schema(schema).parquet(path).select("server", "v")) == want
    left = _files(path)
    kept = {f for f in files if "server=e" in f or int(f.split("day=2024-01-")[1][:2]) > (18 if "server=a" in f else 11)}
    assert all(left.get(f) == files[f] for f in kept)  # not rewritten
    assert {(r["server"], str(r["day"])) for r in done.where("action = 'rewritten'").collect()} == {("a", "2024-01-18"), ("b c/d", "2024-01-11")}
    assert done.where("action = 'dropped'").count() == 17 + 10
    assert purge_days(spark, path, "server", "ts", "2024-01-20 12:00:00", 9, own).where("action = 'dropped'").count() == 0  # again


def test_timed_copy_logs_one_row_a_run(spark, tmp_path):
    df = spark.createDataFrame([(i, f"2024-01-0{i} 00:00:00") for i in range(1, 6)], "i int, t string").select(
        "i", F.col("t").cast("timestamp_ntz").alias("t"))
    for n in (5, 2):
        log = timed_copy(df.where(F.col("i") <= n), str(tmp_path / "copy"), str(tmp_path / "log"), "x", "t")
    assert sorted((r["row_count"], r["last_row"].day) for r in log.collect()) == [(2, 2), (5, 5)]
    assert log.where("end_time < start_time or duration_us < 0").count() == 0
    timed_copy(df.limit(0), str(tmp_path / "copy"), str(tmp_path / "log"), "none", "t")
    assert log.sparkSession.read.parquet(str(tmp_path / "log")).where("load_name = 'none' and row_count = 0 and first_row is null").count() == 1


def _quarter_hours(spark):
    """15-minute snapshots: cumulative counters that fall once, metrics that are missing now and then."""
    ev = spark.read.parquet(f"{SF_SMALL}/events.parquet")
    base = ev.select(F.concat(F.lit("srv"), (F.col("user_id") % 3).cast("string")).alias("server_name"),
                     F.col("event_type").alias("wait_type"), (F.col("event_id") % 200).alias("k"))
    return base.groupBy("server_name", "wait_type", "k").agg(F.count("*").alias("n")).select(
        "server_name", F.timestamp_add("MINUTE", F.col("k") * 15, F.lit("2024-01-01").cast("timestamp_ntz")).alias("check_date"), "wait_type",
        ((F.col("k") % 120) * 1000 + F.col("n")).alias("wait_time_ms"), (F.col("k") * 3).alias("waiting_tasks_count"))


def test_snapshot_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "in")
    snaps = _quarter_hours(spark)
    # arrival: any order within the first and within the second half of the time
    half = F.lit("2024-01-02 01:00:00").cast("timestamp_ntz")
    for name, part in (("a", snaps.where(F.col("check_date") < half)), ("b", snaps.where(F.col("check_date") >= half))):
        part.repartition(3, F.rand(1)).write.parquet(f"{src}/{name}.parquet")
    schema = snaps.schema
    out = str(tmp_path / "out")
    first, late = SD.run(ST.file_stream(spark, f"{src}/a.parquet", schema), "30 minutes", out)
    n = first.count()
    assert n > 0 and late.count() == 0
    # a restart with the second half: the open snapshots come from the checkpoint
    deltas, late = SD.run(ST.file_stream(spark, f"{src}/*.parquet", schema), "30 minutes", out)
    want = T.snapshot_delta(snaps, ["wait_type"], ["wait_time_ms", "waiting_tasks_count"], ["wait_time_ms"])
    last = snaps.agg(F.max("check_date")).first()[0]
    want = want.where(F.col("check_date") <= F.timestamp_add("MINUTE", F.lit(-30), F.lit(last))).select(*deltas.columns)
    assert _rows(deltas) == _rows(want) and deltas.count() > n and late.count() == 0
    assert want.where("elapsed_seconds > 900").count() > 0  # gaps in the calendar take part


def test_late_rows_go_to_the_side(spark, tmp_path):
    src = str(tmp_path / "in")
    snaps = _quarter_hours(spark)
    out = str(tmp_path / "out")
    snaps.write.parquet(f"{src}/a.parquet")
    deltas, _ = SD.run(ST.file_stream(spark, f"{src}/*.parquet", snaps.schema), "0 seconds", out)
    before = _rows(deltas)
    again = snaps.where("wait_type = 'click'")
    again.write.parquet(f"{src}/b.parquet")
    deltas, late = SD.run(ST.file_stream(spark, f"{src}/*.parquet", snaps.schema), "0 seconds", out)
    assert _rows(deltas) == before and _rows(late.select(*snaps.columns)) == _rows(again)
