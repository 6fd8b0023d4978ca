"""Readers for the input tables (Parquet, optionally JDBC)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan ``{sf_dir}/{name}.parquet``; Catalyst prunes columns and pushes filters."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def read_source(spark: SparkSession, spec: dict) -> DataFrame:
    """Read a relational source from a spec.

    ``{"format": "parquet", "path": ...}`` or ``{"format": "jdbc", "url": ...,
    "dbtable": ..., "partitionColumn": ..., "lowerBound": ..., "upperBound": ...,
    "numPartitions": ...}``.  JDBC reads are split on ``partitionColumn`` so
    a large source table is read by many tasks in parallel.
    """
    fmt = spec.get("format", "parquet")
    opts = {k: v for k, v in spec.items() if k not in ("format", "path", "schema")}
    r = spark.read.format(fmt)
    if spec.get("schema") is not None:
        r = r.schema(spec["schema"])
    for k, v in opts.items():
        r = r.option(k, v)
    return r.load(spec["path"]) if "path" in spec else r.load()
