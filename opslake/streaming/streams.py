"""Structured Streaming forms of the polling jobs: file sources with ``availableNow``,
watermarked windows and idempotent change apply (stateful deltas: ``snapshot_deltas``).

Event time must be ``TimestampType`` for watermarks; the naive source times
are cast with the session time zone (UTC), and cast back to naive timestamps
on output so batch and stream results compare directly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.session import scratch_path


def file_stream(spark: SparkSession, path_glob: str, schema, max_files: int | None = None) -> DataFrame:
    r = spark.readStream.schema(schema)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    return r.parquet(path_glob)


def table_stream(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Stream a driver table (``{sf_dir}/{name}.parquet``) as a file source."""
    schema = spark.read.parquet(f"{sf_dir}/{name}.parquet").schema
    return file_stream(spark, f"{sf_dir.rstrip('/')}/{name}*.parquet", schema)


_EPOCH = "1970-01-01 00:00:00"


def ntz_to_instant(c) -> F.Column:
    """Naive wall-clock time -> instant, reading the wall clock as UTC (independent of the session zone)."""
    epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", epoch, F.col(c) if isinstance(c, str) else c))


def instant_to_ntz(c) -> F.Column:
    """Instant -> naive UTC wall-clock time (inverse of ``ntz_to_instant``)."""
    epoch = F.lit(_EPOCH).cast("timestamp_ntz")
    return F.timestamp_add("MICROSECOND", F.unix_micros(F.col(c) if isinstance(c, str) else c), epoch)


def event_time(df: DataFrame, col: str, out: str = "event_time") -> DataFrame:
    """Watermarks need an instant (``TimestampType``); naive times are read as UTC."""
    return df.withColumn(out, ntz_to_instant(col))


def _finish(q) -> None:
    """Wait for the query without a limit; it is stopped and its error raised if it failed."""
    try:
        q.awaitTermination()
    finally:
        q.stop()
    if q.exception() is not None:
        raise q.exception()


def run_available_now(df: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a streaming query over everything available into a Parquet table; return the table.

    Output and checkpoint live in ``path`` (a new folder under the shared
    checkpoint folder if not given); a run with the same path resumes from its
    committed offsets.  Waits until everything available is processed.
    """
    spark = df.sparkSession
    base = path or scratch_path(spark, f"stream-{name}")
    q = (df.writeStream.format("parquet").outputMode(mode).option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start(f"{base}/out"))
    _finish(q)
    return spark.read.schema(df.schema).parquet(f"{base}/out")


def collector(stream: DataFrame, max_seconds: int = 60, deny=("rdsadmin", "root")) -> DataFrame:
    from opslake.operators.filters import collector as batch_collector
    return batch_collector(stream, max_seconds, deny)


def tumbling_counts(stream: DataFrame, ts: str, keys: list[str], size: str, delay: str) -> DataFrame:
    """Counts per tumbling window; a window is emitted once the watermark passes its end."""
    s = event_time(stream, ts).withWatermark("event_time", delay)
    g = s.groupBy(F.window("event_time", size).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n"))
    return g.select(instant_to_ntz("w.start").alias("window_start"),
                    instant_to_ntz("w.end").alias("window_end"), *keys, "n")


def sliding_rate(stream: DataFrame, ts: str, keys: list[str], flag, size: str, slide: str, delay: str) -> DataFrame:
    """Share of flagged rows per sliding window."""
    s = event_time(stream, ts).withWatermark("event_time", delay).withColumn("__f", flag.cast("int"))
    g = s.groupBy(F.window("event_time", size, slide).alias("w"), *keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("__f").alias("breaches"))
    return g.select(instant_to_ntz("w.start").alias("window_start"),
                    instant_to_ntz("w.end").alias("window_end"), *keys, "n",
                    F.col("breaches").cast("bigint").alias("breaches"),
                    (F.col("breaches") / F.col("n")).alias("breach_rate"))


def session_latest(stream: DataFrame, ts: str, key: str, id_col: str, gap: str, delay: str) -> DataFrame:
    """Collapse repeated sightings of one key into sessions; keep the latest sighting."""
    s = event_time(stream, ts).withWatermark("event_time", delay)
    g = s.groupBy(F.session_window("event_time", gap).alias("w"), key).agg(
        F.count(F.lit(1)).alias("sightings"), F.max_by(id_col, "event_time").alias("last_" + id_col))
    return g.select(instant_to_ntz("w.start").alias("session_start"),
                    instant_to_ntz("w.end").alias("session_end"), key, "sightings", "last_" + id_col)


def dedupe(stream: DataFrame, ts: str, keys: list[str], delay: str) -> DataFrame:
    """Drop re-sent rows (same keys) within the watermark delay."""
    s = event_time(stream, ts).withWatermark("event_time", delay)
    return s.dropDuplicatesWithinWatermark(keys)


# change apply -----------------------------------------------------------------
def cdc_foreach_batch(changes: DataFrame, base: DataFrame, keys: list[str], order_col: str, name: str,
                      path: str | None = None, buckets: int = 64) -> DataFrame:
    """Apply a change stream batch by batch to a bucketed lake table that starts as ``base``.

    A batch rewrites only the buckets its changes touch and commits them
    together with its number, so a batch that is run again after a failure is
    skipped if it is in.  The table keeps every key's last change: one that
    arrives in a later batch than a newer one is ignored.
    """
    from opslake.sources.lake import BucketedTable, Lake
    spark = changes.sparkSession
    root = path or scratch_path(spark, f"cdc-{name}")
    table = BucketedTable(Lake(spark, f"{root}/lake"), name, keys, order_col, buckets=buckets)
    table.create(base, changes)
    schema = table.schema(base, changes)

    def apply(batch: DataFrame, batch_id: int):
        table.apply(batch, schema, batch_id)

    q = (changes.writeStream.foreachBatch(apply).option("checkpointLocation", f"{root}/_checkpoint")
         .trigger(availableNow=True).start())
    _finish(q)
    return table.rows(schema)


# late rows --------------------------------------------------------------------
def late_rows(df: DataFrame, arrival: str, ts: str, delay_seconds: int) -> DataFrame:
    """Rows whose event time is older than (latest event time seen before them - delay).

    The "seen before" maximum is a running maximum in arrival order, computed
    per arrival range of a bounded number of rows and carried across ranges
    through a one-row-per-range table, so no single task sorts the whole input.
    """
    from pyspark.sql import Window

    from opslake.operators.timeseries import bounded_buckets
    d = bounded_buckets(df, [], arrival)
    w_in = Window.partitionBy("__b").orderBy(arrival).rowsBetween(Window.unboundedPreceding, -1)
    per = d.groupBy("__b").agg(F.max(ts).alias("__bm"))
    w_b = Window.orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as borders
    carry = per.withColumn("__carry", F.max("__bm").over(w_b)).select("__b", "__carry")
    d = d.withColumn("__local", F.max(ts).over(w_in))
    seen = F.greatest(F.col("__local"), F.col("__carry"))
    bound = F.timestamp_add("SECOND", F.lit(-delay_seconds), seen)
    return (d.join(carry, "__b", "left").withColumn("watermark_bound", bound)
            .filter(F.col(ts) < F.col("watermark_bound")).drop("__b", "__local", "__carry"))
