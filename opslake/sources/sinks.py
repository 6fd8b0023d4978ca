"""Lakehouse sinks: JSON and Parquet tables, versioned rewrites, append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opslake.functions.semantics import ts_lit


def create_like(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Empty target with the source schema (``CREATE TABLE AS ... WHERE 1 = 0``)."""
    df.limit(0).write.mode("overwrite").format(fmt).save(path)
    return df.sparkSession.read.schema(df.schema).format(fmt).load(path)


def replace_target(df: DataFrame, path: str, fmt: str = "parquet",
                   partition_by: list[str] | None = None) -> None:
    """Drop and recreate: the folder is overwritten by one write job."""
    w = df.write.mode("overwrite").format(fmt)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.save(path)


def write_json(df: DataFrame, path: str) -> DataFrame:
    """JSON lakehouse table; read back with the source schema (no inference)."""
    replace_target(df, path, "json")
    return df.sparkSession.read.schema(df.schema).json(path)


def load_table(df: DataFrame, path: str, as_of: str, partition_by: list[str] | None = None) -> DataFrame:
    """Parquet table stamped with ``load_date`` (the load's as-of time)."""
    out = df.withColumn("load_date", ts_lit(as_of))
    replace_target(out, path, "parquet", partition_by)
    return df.sparkSession.read.parquet(path)


def append(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Append to a log table; the first append creates it from the result schema."""
    df.write.mode("append").format(fmt).save(path)
    return df.sparkSession.read.format(fmt).load(path)


def write_version(spark: SparkSession, df: DataFrame, base: str, version: int) -> str:
    """Write a new immutable version folder ``base/v=<n>`` and return its path.

    Readers switch to the new version only after the write job has finished,
    so a lost executor or a failed job never leaves a half-written table.
    """
    path = f"{base.rstrip('/')}/v={version:06d}"
    df.write.mode("overwrite").parquet(path)
    return path


def last_version(spark: SparkSession, base: str) -> int:
    """Highest version folder of ``base`` whose write has finished (``_SUCCESS``); 0 without one."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(base)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(path)]
    done = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()
            and fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{base}/{n}/_SUCCESS"))]
    return max(done, default=0)


def materialize(df: DataFrame, name: str = "stage") -> DataFrame:
    """Cut lineage by writing to the shared checkpoint folder and reading back."""
    from opslake.session import scratch_path
    path = scratch_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def long_text_split(df: DataFrame, text_col: str, limit: int = 30000):
    """Split rows whose text exceeds ``limit`` characters into a side output.

    Returns ``(main, side)``: main keeps every row with the text cut at the
    limit and a flag; side holds the full text of the long ones (spreadsheet
    cells hold at most 32,767 characters).
    """
    long_ = F.length(text_col) > limit
    main = (df.withColumn("text_truncated", F.coalesce(long_, F.lit(False)))
            .withColumn(text_col, F.when(long_, F.substring(text_col, 1, limit)).otherwise(F.col(text_col))))
    side = df.filter(long_)
    return main, side


def with_load_stamp(df: DataFrame, as_of: str, col: str = "load_date") -> DataFrame:
    return df.withColumn(col, F.lit(as_of).cast("timestamp_ntz"))


def write_jdbc(df: DataFrame, url: str, table: str, mode: str = "overwrite", batchsize: int = 1000,
               truncate: bool = True, num_partitions: int | None = None, **options) -> None:
    """Full-refresh copy into a relational table: truncate (keep the table), then batched inserts.

    Each task inserts its rows in ``batchsize`` statements per round trip;
    ``num_partitions`` caps the concurrent connections to the target.
    """
    w = df.coalesce(num_partitions) if num_partitions else df
    wr = (w.write.format("jdbc").option("url", url).option("dbtable", table)
          .option("batchsize", batchsize).option("truncate", str(truncate).lower()))
    for k, v in options.items():
        wr = wr.option(k, v)
    wr.mode(mode).save()


def export_reports(reports: dict[str, DataFrame], base: str, as_of: str, fmt: str = "csv") -> DataFrame:
    """Write each result set to ``{base}/{name}_{yyyymmdd}`` (one write job each, header row for CSV).

    Returns one row per report: name, path and the row count read back from the written files.
    """
    stamp = as_of[:10].replace("-", "")
    rows = []
    spark = None
    for name, df in reports.items():
        spark = df.sparkSession
        path = f"{base.rstrip('/')}/{name}_{stamp}"
        w = df.write.mode("overwrite").format(fmt)
        if fmt == "csv":
            w = w.option("header", "true")
        w.save(path)
        r = spark.read.format(fmt)
        if fmt == "csv":
            r = r.option("header", "true")
        rows.append((name, f"{name}_{stamp}", r.load(path).count()))
    return spark.createDataFrame(rows, "report_name string, file_name string, row_count bigint")


def write_partitioned(df: DataFrame, path: str, part_col: str, salt_buckets: int = 16,
                      salt_cols: list[str] | None = None, fmt: str = "parquet") -> None:
    """Write partitioned by ``part_col`` with about ``salt_buckets`` files per partition value.

    Rows are shuffled on (part_col, salt) where the salt is a hash of
    ``salt_cols`` (all columns by default) modulo ``salt_buckets``: a hot
    partition value is written by ``salt_buckets`` tasks, and the file count
    stays near values x buckets instead of tasks x values.  The salt is a
    hash, not a random number, so a retried task reproduces the same rows.
    """
    cols = salt_cols or df.columns
    salt = F.pmod(F.xxhash64(*[F.col(c) for c in cols]), F.lit(salt_buckets))
    (df.repartition(F.col(part_col), salt).write.mode("overwrite").format(fmt)
     .partitionBy(part_col).save(path))
