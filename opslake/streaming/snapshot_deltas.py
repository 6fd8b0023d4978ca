"""Wait deltas of a stream of snapshots (the streaming form of ``snapshots.snapshot_delta``).

A snapshot is all rows of one (server, check_date).  It is complete once the
watermark has passed its date; only then is it compared with the server's
snapshot before it, so rows of a snapshot may arrive in any order and in any
micro-batch.  A metric that the preceding snapshot lacks gives no row, as in
the batch form.

Per server the state holds the open snapshots (one Arrow value a date, so a
micro-batch costs one state access a date and none a row) and the last
complete one; an event-time timer a date closes it.  State lives in RocksDB
and is checkpointed with the stream, so a restarted query goes on from it.
Rows for a date that is already closed go to a side output.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from opslake.session import scratch_path
from opslake.streaming.streams import _finish, event_time, instant_to_ntz

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DELTAS, LATE = "delta", "late"
_OUT = ("kind string, server_name string, check_date long, wait_type string, prev_check_date long, "
        "elapsed_seconds long, wait_time_ms_delta long, waiting_tasks_count_delta long")
_METRICS = pa.schema([("wait_type", pa.string()), ("wait_time_ms", pa.int64()), ("waiting_tasks_count", pa.int64())])
_MINUTE = 60_000_000


def _dump(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _METRICS) as w:
        w.write_table(pa.Table.from_pandas(rows, _METRICS, preserve_index=False))
    return sink.getvalue().to_pybytes()


def _load(value: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(value).read_pandas()


class SnapshotDeltas(StatefulProcessor):
    """Keyed by server: dates in microseconds, timers in milliseconds of event time."""

    def __init__(self, min_gap: int, max_gap: int):
        self.min_gap, self.max_gap = min_gap, max_gap

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getMapState("open", "check_date long", "rows binary")
        self.last = handle.getValueState("last", "check_date long, rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        closed = self.last.get()[0] if self.last.exists() else None
        mark = timerValues.getCurrentWatermarkInMs() * 1000
        got = pd.concat(list(rows), ignore_index=True)
        late = got["check_us"] <= max(mark, closed if closed is not None else mark)
        if late.any():
            yield self._side(got[late])
        for date, part in got[~late].groupby("check_us"):
            date = int(date)
            part = part[list(_METRICS.names)]
            if self.open.containsKey((date,)):
                part = pd.concat([_load(self.open.getValue((date,))[0]), part], ignore_index=True)
            else:
                # a timer fires once the watermark reaches it; the date itself may still get rows until then
                self.handle.registerTimer(-(-date // 1000))
            self.open.updateValue((date,), (_dump(part),))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        bound = expiredTimerInfo.getExpiryTimeInMs() * 1000
        for date in sorted(d for (d,) in self.open.keys() if d <= bound):
            rows = _load(self.open.getValue((date,))[0])
            self.open.removeKey((date,))
            if self.last.exists():
                before, prev = self.last.get()
                yield from self._deltas(key[0], date, rows, before, _load(prev))
            self.last.update((date, _dump(rows)))

    def _deltas(self, server, date, rows, before, prev):
        gap = date // _MINUTE - before // _MINUTE
        if not self.min_gap <= gap <= self.max_gap:
            return
        both = rows.merge(prev, on="wait_type", suffixes=("", "_p"))
        both = both[both["wait_time_ms"] >= both["wait_time_ms_p"]]
        if len(both):
            yield pd.DataFrame({
                "kind": DELTAS, "server_name": server, "check_date": date, "wait_type": both["wait_type"], "prev_check_date": before,
                "elapsed_seconds": date // 1_000_000 - before // 1_000_000,
                "wait_time_ms_delta": both["wait_time_ms"] - both["wait_time_ms_p"],
                "waiting_tasks_count_delta": both["waiting_tasks_count"] - both["waiting_tasks_count_p"]})

    def _side(self, rows):
        return pd.DataFrame({
            "kind": LATE, "server_name": rows["server_name"], "check_date": rows["check_us"], "wait_type": rows["wait_type"],
            "prev_check_date": pd.array([None] * len(rows), "Int64"), "elapsed_seconds": pd.array([None] * len(rows), "Int64"),
            "wait_time_ms_delta": rows["wait_time_ms"], "waiting_tasks_count_delta": rows["waiting_tasks_count"]})

    def close(self) -> None:
        pass


def snapshot_deltas(stream: DataFrame, delay: str, min_gap: int = 1, max_gap: int = 60) -> DataFrame:
    """Rows of kind ``delta`` and ``late`` (a late row carries its counters) of a snapshot stream.

    ``delay`` is how long after newer dates a snapshot's rows may still come.
    Rows without server, date or metric are left out.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    s = stream.where(F.col("server_name").isNotNull() & F.col("check_date").isNotNull() & F.col("wait_type").isNotNull())
    # the date goes on as a number: late rows must reach the processor, which sends them to the side output
    s = event_time(s, "check_date").withWatermark("event_time", delay).select(
        "server_name", "wait_type", "wait_time_ms", "waiting_tasks_count", F.unix_micros("event_time").alias("check_us"))
    out = s.groupBy("server_name").transformWithStateInPandas(SnapshotDeltas(min_gap, max_gap), _OUT, "Append", "EventTime")
    for c in ("check_date", "prev_check_date"):
        out = out.withColumn(c, instant_to_ntz(F.timestamp_micros(c)))
    return out


def run(stream: DataFrame, delay: str, path: str | None = None, min_gap: int = 1, max_gap: int = 60) -> tuple[DataFrame, DataFrame]:
    """Process everything available; (deltas, late rows) of all runs on ``path`` so far.

    A run with the same path resumes from its checkpoint: offsets, watermark,
    open snapshots and timers.
    """
    spark: SparkSession = stream.sparkSession
    base = path or scratch_path(spark, "snapshot-deltas")
    out = snapshot_deltas(stream, delay, min_gap, max_gap)
    q = (out.writeStream.format("parquet").partitionBy("kind").outputMode("append").option("checkpointLocation", f"{base}/_checkpoint")
         .trigger(availableNow=True).start(f"{base}/out"))
    _finish(q)
    got = spark.read.schema(out.schema).parquet(f"{base}/out")
    cols = [c for c in out.columns if c != "kind"]
    late = got.where(F.col("kind") == LATE).select("server_name", "check_date", "wait_type", F.col("wait_time_ms_delta").alias("wait_time_ms"),
                                                   F.col("waiting_tasks_count_delta").alias("waiting_tasks_count"))
    return got.where(F.col("kind") == DELTAS).select(*cols), late
