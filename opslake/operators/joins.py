"""Join patterns of the catalog and monitoring scripts, in shuffle-friendly forms.

Non-equi conditions of the source SQL are rewritten into equi joins where the
semantics allow (prefix match -> join on exploded prefixes, NULL-wildcard
skip lists -> one anti join per wildcard shape), so no nested-loop join runs
over a large side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# MySQL replication thread states and their thread type.
REPLICATION_STATES = [
    ("Waiting for the next event in relay log", "replication_sql_thread"),
    ("Reading event from the relay log", "replication_sql_thread"),
    ("Making temp file", "replication_sql_thread"),
    ("Slave has read all relay log; waiting for the slave I/O thread to update it", "replication_sql_thread"),
    ("Waiting until MASTER_DELAY seconds after master executed event", "replication_sql_thread"),
    ("Has read all relay log; waiting for the slave I/O thread to update it", "replication_sql_thread"),
    ("Waiting for an event from Coordinator", "replication_io_thread"),
    ("Waiting for master update", "replication_io_thread"),
    ("Connecting to master ", "replication_io_thread"),
    ("Checking master version", "replication_io_thread"),
    ("Registering slave on master", "replication_io_thread"),
    ("Requesting binlog dump", "replication_io_thread"),
    ("Waiting to reconnect after a failed binlog dump request", "replication_io_thread"),
    ("Reconnecting after a failed binlog dump request", "replication_io_thread"),
    ("Waiting for master to send event", "replication_io_thread"),
    ("Queueing master event to the relay log", "replication_io_thread"),
    ("Waiting to reconnect after a failed master event read", "replication_io_thread"),
    ("Reconnecting after a failed master event read", "replication_io_thread"),
    ("Waiting for the slave SQL thread to free enough relay log space", "replication_io_thread"),
]

def known_states(spark) -> DataFrame:
    return spark.createDataFrame(REPLICATION_STATES, "state string, state_type string")


def prefix_join(left: DataFrame, left_col: str, patterns: DataFrame, pattern_col: str,
                how: str = "left", dedupe: bool = False) -> DataFrame:
    """``JOIN patterns ON pattern LIKE CONCAT(left_col, '%')`` without a nested loop.

    With ``dedupe`` a left row meets one of the patterns that it matches, the shortest
    (then the first by name); an empty value, which matches all, does not fan out.

    Every pattern is exploded into all its prefixes ('' included, which
    matches every pattern as the LIKE does); the join is then an equi join on
    the prefix.  Left values holding LIKE wildcards (``%``, ``_``) are matched
    by the LIKE itself against the small pattern table.
    """
    pref = (patterns
            .withColumn("__i", F.explode(F.sequence(F.lit(0), F.length(pattern_col))))
            .withColumn("__prefix", F.expr(f"substring({pattern_col}, 1, __i)"))
            .drop("__i"))
    if dedupe:
        cols = patterns.columns
        best = F.min(F.struct(F.length(pattern_col).alias("__n"), F.col(pattern_col).alias("__p"), F.struct(*cols).alias("__r")))
        pref = pref.groupBy("__prefix").agg(best.alias("__b")).select("__prefix", *[F.col(f"__b.__r.{c}").alias(c) for c in cols])
    wild = F.col(left_col).contains("%") | F.col(left_col).contains("_")
    plain = left.filter(F.col(left_col).isNull() | ~wild)
    out = plain.join(pref, plain[left_col] == pref["__prefix"], how).drop("__prefix")
    special = left.filter(wild)
    if dedupe:  # one pattern for each distinct value with wildcards
        values = special.select(F.col(left_col).alias("__v")).distinct()
        hit = values.join(patterns, F.call_function("like", F.col(pattern_col), F.concat("__v", F.lit("%"))), "left")
        best = F.min(F.struct(F.length(pattern_col).alias("__n"), F.col(pattern_col).alias("__p"), F.struct(*patterns.columns).alias("__r")))
        hit = hit.groupBy("__v").agg(best.alias("__b")).select("__v", *[F.col(f"__b.__r.{c}").alias(c) for c in patterns.columns])
        lk = special.join(hit, F.col(left_col) == F.col("__v"), how).drop("__v")
    else:
        lk = special.join(patterns,
                          F.call_function("like", patterns[pattern_col], F.concat(special[left_col], F.lit("%"))), how)
    return out.unionByName(lk)


def anti_skip_list(df: DataFrame, skip: DataFrame, keys: list[str]) -> DataFrame:
    """``NOT EXISTS (skip row where every key is NULL or equal)``.

    A skip row with NULL in a key matches any value of that key.  The skip
    list is split by which keys are set; each shape is one equi anti join on
    its set keys (a shape with no keys set removes everything).
    """
    from itertools import product
    out = df
    for mask in product([True, False], repeat=len(keys)):
        set_keys = [k for k, m in zip(keys, mask) if m]
        cond = None
        for k, m in zip(keys, mask):
            c = F.col(k).isNotNull() if m else F.col(k).isNull()
            cond = c if cond is None else cond & c
        part = skip.filter(cond).select(*set_keys)
        if not set_keys:
            # an all-NULL row skips every row: a scalar flag, not a join
            out = out.filter(~part.select((F.count(F.lit(1)) > 0).alias("f")).scalar())
        else:
            out = out.join(part.distinct(), set_keys, "left_anti")
    return out.select(*df.columns)


def has_other_value(df: DataFrame, group: list[str], value: str) -> DataFrame:
    """Rows whose group holds at least two distinct ``value`` s (``EXISTS`` with ``<>``).

    Computed as a grouped distinct count joined back (semi join), never as
    the pairwise self join, so a hot group costs one aggregate row.
    """
    multi = (df.groupBy(*group).agg(F.countDistinct(value).alias("__n"))
             .filter(F.col("__n") > 1).drop("__n"))
    return df.join(multi, group, "left_semi")
