"""Purge-and-archive of an audit table in bounded batches.

Each batch takes the oldest ``limit`` eligible rows by id, appends them to the
archive stamped with ``move_date``, then removes exactly the ids of the latest
archive batch from the source.  Re-running is safe: the anti join removes ids
already archived, and a new source version is only switched to after its
write job has finished.
"""

from __future__ import annotations


from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.functions.semantics import ts_lit
from opslake.sources import sinks

LIMIT = 50_000      # rows per batch (fixed value of the source job)
MAX_RUNS = 15       # batches per cycle before the counter resets


def eligible(df: DataFrame, as_of: str, ts_col: str = "action_date", years: int = 1) -> DataFrame:
    """Rows older than ``years`` before the as-of date."""
    cutoff = F.add_months(F.to_date(ts_lit(as_of)), -12 * years)
    return df.filter(F.col(ts_col) < cutoff)


def eligible_count(df: DataFrame, as_of: str, ts_col: str = "action_date") -> DataFrame:
    """One row: ``total`` rows eligible for the purge."""
    return eligible(df, as_of, ts_col).agg(F.count(F.lit(1)).alias("total"))


def gate(count_df: DataFrame, limit: int = LIMIT) -> DataFrame:
    """Continue only when the eligible count is strictly above the batch size."""
    return count_df.select("total", F.lit(limit).cast("bigint").alias("batch_limit"),
                           (F.col("total") > limit).alias("proceed"))


def id_thresholds(df: DataFrame, key: str, targets: list[int], buckets: int = 4096) -> dict[int, int | None]:
    """For each n in ``targets``: the largest key among the n smallest keys of ``df`` (keys unique), exactly.

    No global sort: each pass counts rows per bucket of the key for all
    pending ranges at once (at most ``buckets`` rows per range reach the
    driver) and narrows every target to the bucket holding it; a range of
    at most ``buckets`` keys is counted key by key.  A 64-bit key space needs
    at most a handful of passes.  Targets beyond the row count get the maximum key.
    """
    st = df.agg(F.min(key).alias("lo"), F.max(key).alias("hi"), F.count(F.lit(1)).alias("n")).first()
    if st is None or st["lo"] is None:
        return {t: None for t in targets}
    out: dict[int, int | None] = {t: int(st["hi"]) for t in targets if t >= st["n"]}
    # pending: (lo, hi, [(target, residual rank within the range)])
    pending = [(int(st["lo"]), int(st["hi"]), [(t, t) for t in targets if t < st["n"]])]
    while pending:
        widths = [max(1, -(-(hi - lo + 1) // buckets)) for lo, hi, _ in pending]
        rid = None
        bid = None
        for i, ((lo, hi, _), w) in enumerate(zip(pending, widths)):
            inr = (F.col(key) >= lo) & (F.col(key) <= hi)
            rid = F.when(inr, F.lit(i)) if rid is None else rid.when(inr, F.lit(i))
            # integer division (a double would put wide keys into a neighbouring bucket); decimals if a difference overflows
            k = f"cast(`{key}` as decimal(38,0))" if hi - lo >= 1 << 63 else f"cast(`{key}` as bigint)"
            b = F.expr(f"cast(({k} - ({lo})) div ({w}) as bigint)")
            bid = F.when(inr, b) if bid is None else bid.when(inr, b)
        hist = (df.select(rid.alias("r"), bid.alias("b")).filter(F.col("r").isNotNull())
                .groupBy("r", "b").count().collect())
        per: dict[int, list] = {}
        for row in hist:
            per.setdefault(row["r"], []).append((row["b"], row["count"]))
        nxt: dict[tuple, list] = {}
        for i, ((lo, hi, tg), w) in enumerate(zip(pending, widths)):
            cells = sorted(per.get(i, []))
            for t, need in tg:
                run = 0
                for b, c in cells:
                    if run + c >= need:
                        blo, bhi = lo + b * w, min(hi, lo + (b + 1) * w - 1)
                        if w == 1:
                            out[t] = blo
                        else:
                            nxt.setdefault((blo, bhi), []).append((t, need - run))
                        break
                    run += c
        pending = [(lo, hi, tg) for (lo, hi), tg in nxt.items()]
    return out


def id_threshold(df: DataFrame, key: str, n: int, buckets: int = 4096) -> int | None:
    """Largest key among the ``n`` smallest keys of ``df`` (keys unique), exactly."""
    return id_thresholds(df, key, [n], buckets)[n]


def oldest_batch(df: DataFrame, as_of: str, limit: int = LIMIT, key: str = "id",
                 ts_col: str = "action_date", move_date: str | None = None) -> DataFrame:
    """The oldest ``limit`` eligible rows by ``key``, stamped with ``move_date``."""
    el = eligible(df, as_of, ts_col)
    t = id_threshold(el.select(key), key, limit)
    batch = el.filter(F.col(key) <= t) if t is not None else el.limit(0)
    return batch.withColumn("move_date", ts_lit(move_date or as_of))


def latest_batch_ids(archive: DataFrame, key: str = "id") -> DataFrame:
    """Ids of the most recent archive batch (``move_date = max(move_date)``).

    The maximum is a scalar subquery (a one-row aggregate), so no window
    pulls the archive into one partition and no join is needed.
    """
    last = archive.select(F.max("move_date")).scalar()
    return archive.filter(F.col("move_date") == last).select(key)


def remove_ids(source: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    """``DELETE ... WHERE id IN (staged ids)`` as a left anti join."""
    return source.join(ids.select(F.col(key).alias("__id")), F.col(key) == F.col("__id"), "left_anti")


def plan_runs(eligible_total: int, limit: int = LIMIT, max_runs: int = MAX_RUNS) -> int:
    """Batches the bounded loop executes: batch r runs while the eligible rows left exceed ``limit``."""
    r = 0
    while r < max_runs and eligible_total - r * limit > limit:
        r += 1
    return r


def purge_cycle(source: DataFrame, as_of: str, base_path: str, limit: int = LIMIT,
                max_runs: int = MAX_RUNS, key: str = "id", ts_col: str = "action_date") -> DataFrame:
    """One purge cycle of up to ``max_runs`` batches; returns one log row per batch.

    The loop's outcome is fixed by counts known up front (each batch removes
    ``limit`` eligible rows), so the cycle runs as a few whole-table passes
    instead of one rewrite per batch:

    1. count the rows and the eligible rows (one scan each);
    2. find every batch's exact id threshold in one histogram search;
    3. write all batches to the archive in one job, partitioned by ``move_date``;
    4. write the new source version once: source minus the archived ids
       (an anti join on the id).

    A cycle writes the next free source version and its own archive folder
    (``archive/cycle=<version>``), so earlier archives and versions stay as they are
    and ``{base}/archive`` reads as one table.  A failed job leaves no
    ``_SUCCESS`` and its number is used again.  The invariant rows_in = kept +
    archived is checked on the written tables.
    """
    spark = source.sparkSession
    base = base_path.rstrip("/")
    rows_in = source.count()
    el = eligible(source, as_of, ts_col)
    total = el.count()
    runs = plan_runs(total, limit, max_runs)
    schema = ("run_no int, eligible_before bigint, archived_rows bigint, source_rows_after bigint, "
              "min_id bigint, max_id bigint")
    if runs == 0:
        return spark.createDataFrame([], schema)
    ths = id_thresholds(el.select(key), key, [r * limit for r in range(1, runs + 1)])
    # batch number of each archived row: the first threshold at or above its id
    batch_no = None
    for r in range(runs, 0, -1):
        c = F.col(key) <= F.lit(ths[r * limit])
        batch_no = F.when(c, F.lit(r)) if batch_no is None else F.when(c, F.lit(r)).otherwise(batch_no)
    stamp = F.concat(F.lit(as_of[:10] + " 00:00:"), F.lpad(batch_no.cast("string"), 2, "0")).cast("timestamp_ntz")
    version = sinks.last_version(spark, f"{base}/source") + 1
    archive_path = f"{base}/archive/cycle={version:06d}"
    (el.filter(F.col(key) <= F.lit(ths[runs * limit]))
     .withColumn("move_date", stamp)
     .write.mode("overwrite").partitionBy("move_date").parquet(archive_path))
    archive = spark.read.parquet(archive_path)
    ids = archive.select(F.col(key).alias("__id"))
    new_path = sinks.write_version(spark, source.join(ids, F.col(key) == F.col("__id"), "left_anti"),
                                   f"{base}/source", version)
    kept = spark.read.parquet(new_path).count()
    stats = {r["move_date"]: r for r in archive.groupBy("move_date").agg(
        F.count(F.lit(1)).alias("n"), F.min(key).alias("lo"), F.max(key).alias("hi")).collect()}
    archived = sum(r["n"] for r in stats.values())
    if kept + archived != rows_in:
        raise AssertionError(f"purge lost rows: {rows_in} != {kept} + {archived}")
    logs = []
    for i, md in enumerate(sorted(stats), start=1):
        r = stats[md]
        logs.append((i, total - (i - 1) * limit, r["n"], rows_in - i * limit, r["lo"], r["hi"]))
    return spark.createDataFrame(logs, schema)
