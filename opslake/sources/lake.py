"""Lake tables whose parts are switched together by a commit.

A lake is a folder of data folders and of numbered manifests
``_commits/00000007.json``.  A manifest names, for every table, the data folders
that make it up.  A job writes new data folders first and commits last, so all
its changes, over any number of tables, become visible by one rename; a job
that stops before that leaves only folders that no manifest names, and its
repetition writes the same ones again.  One writer at a time is assumed.

Built on it: archive-and-clear of two source tables, and a hash-bucketed table
whose change apply rewrites only the buckets that the changes touch.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


@dataclass
class Manifest:
    version: int = 0
    tables: dict[str, list[str]] = field(default_factory=dict)
    notes: dict[str, int] = field(default_factory=dict)


class Lake:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def current(self) -> Manifest:
        """The last committed manifest (an empty one before the first commit)."""
        folder = self._path(f"{self.root}/_commits")
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)] if self._fs.exists(folder) else []
        last = max((n for n in names if n.endswith(".json") and not n.startswith((".", "_"))), default=None)
        if last is None:
            return Manifest()
        text = "\n".join(r[0] for r in self.spark.read.text(f"{self.root}/_commits/{last}", wholetext=True).collect())
        return Manifest(**json.loads(text))

    def commit(self, base: Manifest, tables: dict[str, list[str]], notes: dict[str, int] | None = None) -> Manifest:
        """Switch ``tables`` to the given folders in one step; the others stay as ``base`` names them."""
        new = Manifest(base.version + 1, base.tables | tables, base.notes | (notes or {}))
        final = self._path(f"{self.root}/_commits/{new.version:08d}.json")
        if self._fs.exists(final):
            raise RuntimeError(f"version {new.version} of {self.root} is already committed by another writer")
        part = self._path(f"{self.root}/_commits/_{new.version:08d}.tmp")
        out = self._fs.create(part, True)
        out.write(bytearray(json.dumps(new.__dict__).encode()))
        out.close()
        if not self._fs.rename(part, final):
            raise RuntimeError(f"commit {new.version} of {self.root} failed")
        return new

    def folder(self, base: Manifest, table: str) -> str:
        """Data folder for what the commit after ``base`` adds to ``table``; the same for a repeated attempt."""
        return f"data/{table}/v{base.version + 1:08d}"

    def write(self, base: Manifest, table: str, df: DataFrame) -> str:
        name = self.folder(base, table)
        df.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return name

    def read(self, manifest: Manifest, table: str, schema: StructType | str) -> DataFrame:
        paths = [f"{self.root}/{p}" for p in manifest.tables.get(table, [])]
        reader = self.spark.read.schema(schema)
        return reader.parquet(*paths) if paths else self.spark.createDataFrame([], schema)


def archive_and_clear(lake: Lake, sources: dict[str, StructType], histories: dict[str, tuple[str, object]]) -> int:
    """Append to the histories and clear the sources, if every source has rows; all in one commit.

    ``histories`` maps a history table to (source table, function of its
    DataFrame).  Returns the version that is current afterwards: a second run
    finds empty sources and changes nothing, and a run stopped before its commit
    is repeated without a double append.
    """
    base = lake.current()
    rows = {name: lake.read(base, name, schema) for name, schema in sources.items()}
    if any(df.isEmpty() for df in rows.values()):
        return base.version
    tables = {name: base.tables.get(name, []) + [lake.write(base, name, build(rows[source]))]
              for name, (source, build) in histories.items()}
    return lake.commit(base, tables | {name: [] for name in sources}).version


# change apply by bucket ---------------------------------------------------------
class BucketedTable:
    """A table with a key, hash-bucketed, that remembers each key's last change (see ``extract.merge_changes``).

    A batch of changes reads and rewrites only the buckets it touches: each
    bucket is one folder of the lake, the others keep their files.  ``buckets``
    bounds what a change of few keys costs to 1 / buckets of the table; within a
    bucket, rows are written by several tasks of a hash of the key.
    """

    def __init__(self, lake: Lake, name: str, keys: list[str], order_col: str, op_col: str = "op", buckets: int = 64, files: int = 4):
        self.lake, self.name, self.keys, self.order, self.op = lake, name, keys, order_col, op_col
        self.buckets, self.files = buckets, files

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _table(self, bucket: int) -> str:
        return f"{self.name}/bucket={bucket}"

    def _write(self, base: Manifest, state: DataFrame, touched: list[int] | None, notes: dict[str, int]) -> list[int]:
        """Write the state's rows as one folder a bucket and commit; returns the buckets written."""
        part = f"data/{self.name}/v{base.version + 1:08d}"
        spread = F.pmod(F.xxhash64(*[F.col(k) for k in self.keys], F.lit("file")), F.lit(self.files))
        (state.withColumn("__b", self._bucket()).repartition(F.col("__b"), spread).write.mode("overwrite")
         .partitionBy("__b").parquet(f"{self.lake.root}/{part}"))
        fs, path = self.lake._fs, self.lake._path
        there = {int(f.getPath().getName()[4:]) for f in fs.listStatus(path(f"{self.lake.root}/{part}")) if f.getPath().getName().startswith("__b=")}
        touched = sorted(there) if touched is None else touched
        tables = {self._table(b): [f"{part}/__b={b}"] if b in there else [] for b in touched}
        self.lake.commit(base, tables, notes)
        return touched

    def create(self, base_rows: DataFrame, changes: DataFrame) -> None:
        """First load; nothing if the table is there already."""
        from opslake.operators.extract import change_state
        base = self.lake.current()
        if f"{self.name}.batch" not in base.notes:
            self._write(base, change_state(base_rows, changes, self.order, self.op), None, {f"{self.name}.batch": -1})

    def schema(self, base_rows: DataFrame, changes: DataFrame) -> StructType:
        from opslake.operators.extract import change_state
        return change_state(base_rows, changes, self.order, self.op).schema

    def _state(self, manifest: Manifest, schema, which: list[int]) -> DataFrame:
        paths = [f"{self.lake.root}/{p}" for b in which for p in manifest.tables.get(self._table(b), [])]
        if not paths:
            return self.lake.spark.createDataFrame([], schema)
        return self.lake.spark.read.schema(schema).parquet(*paths)

    def apply(self, changes: DataFrame, schema: StructType, batch: int) -> list[int]:
        """Apply one batch; the buckets it rewrote (none if a batch of this number or a later one is in already)."""
        from opslake.operators.extract import merge_changes
        manifest = self.lake.current()
        if manifest.notes[f"{self.name}.batch"] >= batch:
            return []
        touched = sorted(r[0] for r in changes.select(self._bucket().alias("b")).distinct().collect())  # at most ``buckets``
        if not touched:
            return []
        merged = merge_changes(self._state(manifest, schema, touched), changes, self.keys, self.order, self.op)
        return self._write(manifest, merged, touched, {f"{self.name}.batch": batch})

    def rows(self, schema: StructType) -> DataFrame:
        """The current table: deleted keys and the bookkeeping columns left out."""
        from opslake.operators.extract import current_rows
        manifest = self.lake.current()
        return current_rows(self._state(manifest, schema, list(range(self.buckets))), self.order, self.op)


# retention by partition ----------------------------------------------------------
def write_by_day(df: DataFrame, path: str, server: str, ts: str) -> None:
    """Write snapshots partitioned by (server, day), as ``purge_days`` expects; a hot server is written by a task a day."""
    (df.withColumn("day", F.to_date(ts)).repartition(server, "day").write.mode("overwrite").partitionBy(server, "day").parquet(path))


def purge_days(spark: SparkSession, path: str, server: str, ts: str, as_of: str, days: int,
               per_server_days: DataFrame | None = None) -> DataFrame:
    """Delete rows older than each server's horizon from a table written by ``write_by_day``.

    Whole days before the horizon lose their folder, the one day that holds
    the horizon is rewritten by dynamic partition overwrite (or removed if
    nothing of it is left), and every other folder keeps its files.  Returns
    (server, day, action) of the folders changed.  A repetition after a stop
    finds less to do and ends in the same state.
    """
    from opslake.sources.sinks import materialize
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = []
    for s in fs.globStatus(jvm.org.apache.hadoop.fs.Path(f"{path}/{server}=*/day=*")) or []:
        p = s.getPath()
        found.append((jvm.java.net.URLDecoder.decode(p.getParent().getName()[len(server) + 1:], "UTF-8"), p.getName()[4:], p.toString()))
    folders = spark.createDataFrame(found, f"{server} string, day string, folder string").withColumn("day", F.to_date("day"))
    end = F.lit(as_of).cast("timestamp_ntz")
    if per_server_days is None:
        folders = folders.withColumn("keep", F.lit(days))
    else:
        own = per_server_days.select(F.col(server).cast("string").alias(server), F.col("retention_days").cast("int").alias("keep"))
        folders = folders.join(own, server, "left").withColumn("keep", F.coalesce("keep", F.lit(days)))
    folders = folders.withColumn("horizon", F.timestamp_add("DAY", -F.col("keep"), end))
    due = folders.withColumn("action", F.when(F.col("day") < F.to_date("horizon"), "dropped").when(
        (F.col("day") == F.to_date("horizon")) & (F.date_trunc("day", F.col("horizon")) < F.col("horizon")), "rewritten")).where("action is not null")
    todo = due.collect()  # folder names, as many as the file index holds anyway
    border = [r for r in todo if r["action"] == "rewritten"]
    if border:
        # only the border days' folders are read
        whole = spark.read.option("basePath", path).parquet(*[r["folder"] for r in border])
        limits = due.where("action = 'rewritten'").select(server, "day", "horizon")
        kept = materialize(whole.withColumn(server, F.col(server).cast("string")).join(limits, [server, "day"])
                           .where(F.col(ts) >= F.col("horizon")).drop("horizon"), "retention-border")
        left = {(r[0], r[1]) for r in kept.select(server, "day").distinct().collect()}
        (kept.repartition(server, "day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy(server, "day").parquet(path))
        todo = [r for r in todo if r["action"] == "dropped" or (r[server], r["day"]) not in left]
    for r in todo:
        fs.delete(jvm.org.apache.hadoop.fs.Path(r["folder"]), True)
    return spark.createDataFrame([(r[server], r["day"], "dropped") for r in todo] + [
        (r[server], r["day"], "rewritten") for r in border if (r[server], r["day"]) in left] if border else
        [(r[server], r["day"], "dropped") for r in todo], f"{server} string, day date, action string")


# timed loads ---------------------------------------------------------------------
def timed_copy(df: DataFrame, path: str, log_path: str, name: str, ts: str | None = None) -> DataFrame:
    """Copy ``df`` to ``path`` and append one row about it to the log; returns the log.

    Row count and the covered times are observed while the copy's own job runs,
    so the source is scanned once.  start_time and end_time are the driver's
    clock around the job.
    """
    import datetime as dt

    from pyspark.sql import Observation
    spark = df.sparkSession
    seen = Observation(f"{name}-copy")
    stats = [F.count(F.lit(1)).alias("row_count")]
    for c, f in (("first_row", F.min), ("last_row", F.max)):
        stats.append((f(ts) if ts else F.lit(None)).cast("timestamp_ntz").cast("string").alias(c))
    start = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    df.observe(seen, *stats).write.mode("overwrite").parquet(path)
    end = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
    got = seen.get
    row = spark.createDataFrame([(name, start, end, got["row_count"], got["first_row"], got["last_row"])],
                                "load_name string, start_time timestamp_ntz, end_time timestamp_ntz, row_count long, f string, l string")
    row = row.select("load_name", "start_time", "end_time", F.timestamp_diff("MICROSECOND", "start_time", "end_time").alias("duration_us"),
                     "row_count", F.col("f").cast("timestamp_ntz").alias("first_row"), F.col("l").cast("timestamp_ntz").alias("last_row"))
    row.write.mode("append").parquet(log_path)
    return spark.read.schema(row.schema).parquet(log_path)
