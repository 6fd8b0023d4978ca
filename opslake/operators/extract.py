"""Tenant extraction into the lakehouse (one- to three-hop joins) and copies.

A table belongs to a tenant either directly (it has the tenant column) or
through a chain of parent tables.  ``extract`` builds the join chain from the
tenant end: the tenant filter is applied to the smallest table first and the
key set flows down to the child, so the big child is joined last and only
against the keys that survived (AQE broadcasts the key side when it is small,
and the runtime bloom filter prunes the child scan).
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class Hop:
    """Join ``child.child_key = parent.parent_key``."""
    parent: str
    child_key: str
    parent_key: str


@dataclass
class TenantSpec:
    """How a table reaches its tenant: ``hops`` from the table up to the tenant column."""
    table: str
    tenant_col: str
    hops: list[Hop] = field(default_factory=list)


def plan_select(df: DataFrame, widen_ms: bool = True) -> DataFrame:
    """Schema-driven select list.

    Timestamp columns are written at millisecond precision (the source has
    second precision, the lake keeps milliseconds); other columns pass as
    they are.  A table without columns is an error.
    """
    if not df.columns:
        raise ValueError("source table has no columns")
    cols = []
    for f in df.schema.fields:
        if widen_ms and isinstance(f.dataType, (T.TimestampType, T.TimestampNTZType)):
            cols.append(F.date_trunc("millisecond", F.col(f.name)).cast(f.dataType).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def extract(tables: dict[str, DataFrame], spec: TenantSpec, tenants=None,
            mode: str = "inner", tenant_alias: str = "tenant_id") -> DataFrame:
    """Rows of ``spec.table`` for the given tenants (all tenants when None).

    ``mode="inner"`` keeps the source semantics (a non-unique parent key
    duplicates child rows); ``mode="semi"`` returns each child row once.
    The result carries the tenant key as ``tenant_alias`` for a partitioned write.
    """
    child = tables[spec.table]
    if not spec.hops:
        out = child.withColumn(tenant_alias, F.col(spec.tenant_col))
        return out if tenants is None else out.filter(F.col(spec.tenant_col).isin(list(tenants)))

    # walk up: the last hop's parent carries the tenant column
    top = spec.hops[-1]
    keys = tables[top.parent].select(F.col(top.parent_key).alias("__k"),
                                     F.col(spec.tenant_col).alias(tenant_alias))
    if tenants is not None:
        keys = keys.filter(F.col(tenant_alias).isin(list(tenants)))
    # then down the chain: map each parent key set to the next child's key set
    for i in range(len(spec.hops) - 1, 0, -1):
        hop, below = spec.hops[i], spec.hops[i - 1]
        parent = tables[below.parent]
        keys = (parent.select(F.col(hop.child_key).alias("__c"), F.col(below.parent_key).alias("__n"))
                .join(keys, F.col("__c") == F.col("__k"), "inner")
                .select(F.col("__n").alias("__k"), tenant_alias))
    first = spec.hops[0]
    if mode == "semi":
        keys = keys.dropDuplicates(["__k"])
    joined = child.join(keys, child[first.child_key] == keys["__k"], "inner")
    return joined.select(*[child[c] for c in child.columns], keys[tenant_alias])


def merge_specs(default: dict[str, TenantSpec], overrides: dict[str, dict[str, TenantSpec]],
                tenant) -> dict[str, TenantSpec]:
    """Per-tenant join overrides win over the default spec of the same table."""
    out = dict(default)
    out.update(overrides.get(tenant, {}))
    return out


def semi_join_ids(child: DataFrame, ids: DataFrame, key: str, id_key: str | None = None) -> DataFrame:
    """``WHERE key IN (ids)`` as a left-semi join; the id list never reaches the driver."""
    id_key = id_key or key
    return child.join(ids.select(F.col(id_key).alias("__id")), F.col(key) == F.col("__id"), "left_semi")


def window_rows(df: DataFrame, ts_col: str, as_of: str, months: int = 6) -> DataFrame:
    """Rows in the half-open window of whole days ``[date(as_of) - months, date(as_of))``."""
    end = F.lit(as_of[:10]).cast("timestamp_ntz")
    start = F.add_months(end, -months).cast("timestamp_ntz")
    return df.filter((F.col(ts_col) >= start) & (F.col(ts_col) < end))


def retention_keep(df: DataFrame, ts_col: str, as_of: str, days: int, by: str | None = None,
                   per_server_days: DataFrame | None = None) -> DataFrame:
    """Rows to keep after a retention purge (``ts >= as_of - days``).

    With ``per_server_days`` (columns ``by``, ``retention_days``) every server
    has its own horizon; that table is one row per server; Spark
    broadcasts it if its size allows.
    """
    end = F.lit(as_of).cast("timestamp_ntz")
    if per_server_days is None:
        return df.filter(F.col(ts_col) >= F.timestamp_add("DAY", F.lit(-days), end))
    d = per_server_days.select(by, "retention_days")
    return (df.join(d, by, "left")
            .filter(F.col(ts_col) >= F.timestamp_add(
                "DAY", -F.coalesce(F.col("retention_days"), F.lit(days)), end))
            .drop("retention_days"))


def change_state(base: DataFrame, changes: DataFrame, order_col: str, op_col: str = "op") -> DataFrame:
    """``base`` with the columns that ``merge_changes`` keeps: no change applied yet."""
    order = F.lit(None).cast(changes.schema[order_col].dataType)
    return base.withColumns({order_col: order, op_col: F.lit("I")})


def merge_changes(state: DataFrame, changes: DataFrame, keys: list[str], order_col: str,
                  op_col: str = "op") -> DataFrame:
    """Apply one batch of changes to a state that remembers the last change of every key.

    A change that is older than (or as old as) the one its key has already seen,
    in this batch or an earlier one, is ignored; a deleted key stays as a row with
    ``op`` ``D``, so a late upsert does not bring it back.
    """
    latest = (changes.groupBy(*keys)
              .agg(F.max_by(F.struct(*[c for c in changes.columns if c not in keys]), F.col(order_col)).alias("__c"))
              .select(*keys, "__c.*").select(*state.columns))
    seen = state.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col(order_col).alias("__seen"))
    stale = F.col("__seen") >= F.col(order_col)
    for k in keys:
        stale = stale & (F.col(f"__{k}") == F.col(k))
    newer = latest.join(seen, stale, "left_anti")
    return state.join(newer.select(*keys), keys, "left_anti").unionByName(newer)


def current_rows(state: DataFrame, order_col: str, op_col: str = "op") -> DataFrame:
    """The table that a change state stands for."""
    return state.filter(F.col(op_col) != "D").drop(order_col, op_col)
