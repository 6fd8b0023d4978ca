"""Consistent-hash ring with virtual nodes and bounded loads, in DataFrame operations only.

Every shard owns ``virtual_nodes`` points on a ring of ``RING`` positions; a row's
position is a hash of its doc_id and belongs to the next virtual node clockwise (its
arc).  The capacities are exact: with n rows and s shards every shard takes
floor(n / s) rows and n mod s of them one more, so the counts are at most one apart.
Rows that a full shard cannot take go on clockwise to the next virtual nodes.

Only the row count of every arc (shards x virtual nodes numbers) comes to the
driver, which settles how many rows of an arc go to which shard; a row's rank
inside its arc then decides.  Ranks are computed per (ring position, salt) with
prefix sums, so neither a hot arc nor a hot key is one task.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from opslake.sources.sinks import materialize

RING = 1 << 16
SALTS = 16


def _ring(spark, shards: int, virtual_nodes: int) -> DataFrame:
    """(pos, arc, shard): virtual nodes in clockwise order; shards x virtual_nodes rows at most (equal positions: lowest shard)."""
    node = spark.range(shards * virtual_nodes).select(
        (F.col("id") % shards).cast("int").alias("shard"),
        F.pmod(F.xxhash64(F.lit("node"), F.col("id") % shards, F.floor(F.col("id") / shards)), F.lit(RING)).cast("int").alias("pos"))
    node = node.groupBy("pos").agg(F.min("shard").alias("shard"))
    return node.select("pos", "shard", (F.row_number().over(Window.orderBy("pos")) - 1).alias("arc"))


def settle(arcs: list[tuple[int, int, int]], shards: int) -> list[tuple[int, int, int, int, int]]:
    """Segments (arc, first rank, end rank, shard, first slot) from (arc, owner, rows).

    Round r offers what is left of every arc to the virtual node r steps
    clockwise; a shard takes what still fits, in arc order.  At most one segment per
    arc and one more per shard that fills up.
    """
    n = sum(x for _, _, x in arcs)
    room = [n // shards + (i < n % shards) for i in range(shards)]
    size = list(room)
    left = {a: [0, x] for a, _, x in arcs if x}
    owner = [o for _, o, _ in arcs]
    out, step = [], 0
    while left:
        for a in sorted(left):
            s = owner[(a + step) % len(owner)]
            take = min(room[s], left[a][1] - left[a][0])
            if take:
                out.append((a, left[a][0], left[a][0] + take, s, size[s] - room[s]))
                room[s] -= take
                left[a][0] += take
            if left[a][0] == left[a][1]:
                del left[a]
        step += 1
        if step > len(owner):  # shards without a virtual node of their own take the rest
            for a in sorted(left):
                for s in range(shards):
                    take = min(room[s], left[a][1] - left[a][0])
                    if take:
                        out.append((a, left[a][0], left[a][0] + take, s, size[s] - room[s]))
                        room[s] -= take
                        left[a][0] += take
            break
    return out


def shard(docs: DataFrame, shards: int = 40, virtual_nodes: int = 64) -> DataFrame:
    """doc_id, size, text_crc32, home_shard (ring owner), shard, slot (gapless from 0 per shard), of every row.

    size: UTF-8 bytes of the text plus 16; a null text counts as empty (crc32 0).
    Rows with a null doc_id share one ring position; repeated rows are placed one
    by one (ties by checksum and size).  Extra columns are ignored; an empty
    table gives an empty result.
    """
    spark = docs.sparkSession
    ring = materialize(_ring(spark, shards, virtual_nodes), "ring")
    owner = spark.range(RING).select(F.col("id").cast("int").alias("pos"))
    last = Window.orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    # RING rows whatever the data: the first virtual node at or after each position, else the first of the ring
    owner = owner.join(ring, "pos", "left").select("pos", F.coalesce(F.min("arc").over(last), F.lit(0)).alias("arc"))
    owner = materialize(owner, "ring-owner")
    text = F.coalesce("text", F.lit(""))
    base = docs.select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"),
                       F.crc32(text.cast("binary")).alias("text_crc32"),
                       F.pmod(F.xxhash64("doc_id"), F.lit(RING)).cast("int").alias("pos"),
                       F.pmod(F.spark_partition_id(), F.lit(SALTS)).alias("salt"))
    base = materialize(base.join(F.broadcast(owner), "pos"), "shard-rows")  # written: salts stay what they are
    cells = base.groupBy("arc", "pos", "salt").agg(F.count("*").alias("n"))
    before = Window.partitionBy("arc").orderBy("pos", "salt").rowsBetween(Window.unboundedPreceding, -1)
    cells = materialize(cells.withColumn("before", F.coalesce(F.sum("n").over(before), F.lit(0))), "shard-cells")
    rows = {r["arc"]: r["n"] for r in cells.groupBy("arc").agg(F.sum("n").alias("n")).collect()}
    arcs = [(r["arc"], r["shard"], rows.get(r["arc"], 0)) for r in ring.orderBy("arc").collect()]
    kind = "array<struct<arc:int,lo:long,hi:long,shard:int,first_slot:long>>"
    found = [dict(zip(("arc", "lo", "hi", "shard", "first_slot"), x, strict=True)) for x in settle(arcs, shards)]
    seg = spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(found)), kind)))
    home = ring.select("arc", F.col("shard").alias("home_shard"))
    in_cell = Window.partitionBy("pos", "salt").orderBy("doc_id", "text_crc32", "size")
    ranked = base.withColumn("r", F.row_number().over(in_cell) - 1)
    # at most RING x SALTS short rows, of which most are empty on small inputs
    ranked = ranked.join(cells.select("pos", "salt", "before"), ["pos", "salt"]).withColumn("rank", F.col("before") + F.col("r"))
    placed = ranked.join(F.broadcast(seg), "arc").where("rank >= lo and rank < hi").join(F.broadcast(home), "arc")
    return placed.select("doc_id", "size", "text_crc32", "home_shard", "shard", (F.col("first_slot") + F.col("rank") - F.col("lo")).alias("slot"))
