"""Sessions and blocking: block leaders (transitive closure), session deltas, blocking ids."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _cut(df: DataFrame) -> DataFrame:
    """Materialise a round of an iterative job in the shared checkpoint folder."""
    return df.checkpoint(eager=True)


def root_of(edges: DataFrame, node: str = "session_id", parent: str = "blocking_session_id",
            max_rounds: int | None = None, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., node, root, depth) for every node whose parent chain ends at a root (parent NULL).

    A node is (``by``, ``node``): session 51 of two servers is two nodes.  Of several
    rows of a node (requests of one session) the largest parent counts.  Pointer
    jumping: each round replaces a pointer by its pointer's pointer (one equi
    join), so chains of depth d converge in about log2(d) rounds.  Nodes in a
    cycle, or below one, never reach a root and are left out.
    """
    by = list(by)
    e = edges.groupBy(*by, F.col(node).alias("id")).agg(F.max(parent).alias("ptr"))
    n = e.count()
    rounds = max_rounds or (int(math.ceil(math.log2(max(n, 2)))) + 2)
    cur = _cut(e.select(*by, "id", "ptr", F.when(F.col("ptr").isNotNull(), F.lit(1)).otherwise(F.lit(0))
                        .cast("bigint").alias("dist")))
    for _ in range(rounds):
        nxt = cur.select(*by, F.col("id").alias("ptr"), F.col("ptr").alias("pptr"), F.col("dist").alias("pdist"))
        j = cur.join(nxt, [*by, "ptr"], "left")
        jump = F.col("pptr").isNotNull()
        step = j.select(*by, "id", F.when(jump, F.col("pptr")).otherwise(F.col("ptr")).alias("ptr"),
                        F.when(jump, F.col("dist") + F.col("pdist")).otherwise(F.col("dist")).alias("dist"),
                        jump.alias("moved"))
        step = _cut(step)
        moved = step.filter("moved").limit(1).count()
        cur = step.drop("moved")
        if moved == 0:
            break
    roots = e.filter(F.col("ptr").isNull()).select(*by, F.col("id").alias("ptr"))
    # a node whose pointer is a root, or which is a root itself
    reached = cur.join(roots, [*by, "ptr"]).select(*by, "id", F.col("ptr").alias("root"), "dist")
    own = roots.select(*by, F.col("ptr").alias("id"), F.col("ptr").alias("root"), F.lit(0).cast("bigint").alias("dist"))
    return reached.unionByName(own).select(*by, F.col("id").alias(node), "root", F.col("dist").alias("depth"))


def block_leaders(sessions: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Sessions blocking others while not blocked themselves, with the count of sessions
    they block directly or transitively and the depth of their blocking tree."""
    r = root_of(sessions, by=by)
    return (r.groupBy(*by, F.col("root").alias("leader_session_id"))
            .agg((F.count(F.lit(1)) - 1).alias("blocked_count"), F.max("depth").alias("max_depth"))
            .filter(F.col("blocked_count") > 0))


def session_deltas(pass1: DataFrame, pass2: DataFrame, keys=("server_name", "session_id", "request_id", "login_time"),
                   counters=("cpu_time", "reads", "writes", "tempdb_pages")) -> DataFrame:
    """Work done by each session between two samples (sessions present in both)."""
    keys = list(keys)
    a = pass1.select(*keys, *[F.col(c).alias(f"__a_{c}") for c in counters])
    return pass2.join(a, keys).select(*keys, *[(F.col(c) - F.col(f"__a_{c}")).alias(f"{c}_delta") for c in counters])


def resolve_blocking(requests: DataFrame, waits: DataFrame, by: tuple[str, ...] = ("server_name",)) -> DataFrame:
    """Blocking session id from the request view, falling back to the waiting-task view of the same server.

    Negative request ids mean: -2 orphaned distributed transaction, -3 deferred
    recovery, -4 latch owner not determinable.
    """
    j = requests.join(waits, [*by, "session_id"], "left")
    b, wb = F.col("blocking_session_id"), F.col("wait_blocking_session_id")
    res = (F.when(b > 0, b)
           .when(wb.isNotNull() & (wb != F.col("session_id")), wb)
           .when(b == -2, F.lit(-2))
           .when(b.isin(-3, -4), b)
           .otherwise(F.lit(None)))
    return j.select(*by, "session_id", "blocking_session_id", "wait_blocking_session_id", res.alias("resolved_blocker"))


def uncollected_blockers(blockers: DataFrame, collected: DataFrame, cols: tuple[str, ...] = ("server_name", "session_id")) -> DataFrame:
    """Blocking sessions not yet collected (``EXCEPT``, distinct)."""
    return blockers.select(*cols).subtract(collected.select(*cols))
