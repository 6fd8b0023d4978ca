"""Findings engine: checks are data, compiled to few passes over each input.

A ``Pack`` holds the checks of one input table.  A check tests either a row or a
group: the groups' measures are declared per grain (a tuple of columns), and
all grains of a pack are computed by one aggregation with grouping sets.  The
checks of one grain, and those of the rows, each become one array of finding
structs that is exploded, so a pack of any number of checks reads its input
twice: once for the groups, once for the rows.  Row checks that look at their
group (``lookups``) get its measures by an equi join.

``run_rules`` puts the packs together with free-form ``Rule``s, drops rows matched
by the skip list (NULL = any value, as equi anti joins) and keeps priorities
up to a ceiling.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from opslake.functions.semantics import ts_lit
from opslake.operators.joins import anti_skip_list
from opslake.sources.sinks import materialize

FINDING = T.StructType([
    T.StructField("check_id", T.IntegerType()), T.StructField("priority", T.IntegerType()),
    T.StructField("findings_group", T.StringType()), T.StructField("finding", T.StringType()),
    T.StructField("scope", T.StringType()), T.StructField("object_name", T.StringType()),
    T.StructField("details", T.StringType()), T.StructField("details_num", T.DoubleType()),
    T.StructField("check_date", T.TimestampNTZType()),
])
_ROW = T.StructType(FINDING.fields[:-1])


@dataclass(frozen=True)
class Rule:
    """A free-form rule with its own DataFrame; one scan each, so for what a pack cannot say."""
    check_id: int
    priority: int
    findings_group: str
    finding: str
    build: Callable[[dict, str], DataFrame]   # (inputs, as_of) -> scope, object_name, details, details_num


@dataclass(frozen=True)
class Check:
    """A finding for every row (``grain`` None) or group for which ``when`` holds.

    ``when``, ``object_name``, ``details`` and ``num`` give columns for an as-of time.
    """
    check_id: int
    priority: int
    findings_group: str
    finding: str
    grain: tuple[str, ...] | None
    when: Callable[[str], Column]
    object_name: Callable[[], Column]
    details: Callable[[], Column]
    num: Callable[[], Column]
    #: grains whose measures a row check reads
    lookups: tuple[tuple[str, ...], ...] = ()


@dataclass(frozen=True)
class GroupRule:
    """A rule over the groups of one grain (a small table): ``build(groups, as_of)`` gives scope, object_name, details, details_num."""
    check_id: int
    priority: int
    findings_group: str
    finding: str
    grain: tuple[str, ...]
    build: Callable[[DataFrame, str], DataFrame]


@dataclass(frozen=True)
class Pack:
    input: str
    scope: str
    checks: list
    #: grain -> measure name -> aggregate for an as-of time
    measures: dict[tuple[str, ...], dict[str, Callable[[str], Column]]] = field(default_factory=dict)
    def lookups(self) -> list[tuple[str, ...]]:
        return list(dict.fromkeys(g for c in self.checks if isinstance(c, Check) for g in c.lookups))

    def only(self, keep: Callable[[object], bool]) -> Pack:
        """The pack with the checks for which ``keep`` holds and the grains that they need."""
        checks = [c for c in self.checks if keep(c)]
        pack = replace(self, checks=checks)
        used = {c.grain for c in checks} | set(pack.lookups())
        return replace(pack, measures={g: m for g, m in self.measures.items() if g in used})


def to_finding(rule, df: DataFrame, as_of: str) -> DataFrame:
    return df.select(
        F.lit(rule.check_id).cast("int").alias("check_id"), F.lit(rule.priority).cast("int").alias("priority"),
        F.lit(rule.findings_group).alias("findings_group"), F.lit(rule.finding).alias("finding"),
        F.col("scope").cast("string"), F.col("object_name").cast("string"), F.col("details").cast("string"),
        F.col("details_num").cast("double"), ts_lit(as_of).alias("check_date"))


def _findings(df: DataFrame, checks: list[Check], scope: str, as_of: str) -> DataFrame:
    """All checks on the rows of ``df`` in one pass."""
    def one(c):
        values = (F.lit(c.check_id), F.lit(c.priority), F.lit(c.findings_group), F.lit(c.finding), F.col(scope), c.object_name(),
                  c.details(), c.num())
        found = F.struct(*[v.cast(f.dataType).alias(f.name) for v, f in zip(values, _ROW.fields, strict=True)])
        return F.when(c.when(as_of), found)

    each = df.select(F.explode(F.array_compact(F.array(*[one(c) for c in checks]))).alias("f"))
    return each.select("f.*", ts_lit(as_of).alias("check_date"))


def _groups(df: DataFrame, pack: Pack, as_of: str) -> dict[tuple[str, ...], DataFrame]:
    """The measures of every grain, by one aggregation over the input; written once, as several checks read them."""
    grains = list(pack.measures)
    if not grains:
        return {}
    names = {g: {n: f"m{i}_{n}" for n in m} for i, (g, m) in enumerate(pack.measures.items())}
    aggs = [f(as_of).alias(names[g][n]) for g, m in pack.measures.items() for n, f in m.items()]
    if len(grains) == 1:
        return {grains[0]: df.groupBy(*grains[0]).agg(*aggs).withColumnsRenamed({v: k for k, v in names[grains[0]].items()})}
    cols = list(dict.fromkeys(c for g in grains for c in g))
    wide = df.groupingSets([[F.col(c) for c in g] for g in grains], *[F.col(c) for c in cols]).agg(F.grouping_id().alias("__g"), *aggs)
    wide = materialize(wide, f"rules-{pack.input}-groups")
    out = {}
    for g in grains:
        bits = sum(1 << (len(cols) - 1 - i) for i, c in enumerate(cols) if c not in g)
        out[g] = wide.where(F.col("__g") == bits).select(*g, *[F.col(v).alias(n) for n, v in names[g].items()])
    return out


def run_pack(df: DataFrame, pack: Pack, as_of: str) -> list[DataFrame]:
    groups = _groups(df, pack, as_of)
    parts = []
    rows = [c for c in pack.checks if c.grain is None]
    if rows:
        for g in pack.lookups():
            own = groups[g].withColumnsRenamed({c: f"__{c}" for c in g})
            on = reduce(lambda x, y: x & y, [df[c].eqNullSafe(own[f"__{c}"]) for c in g])
            df = df.join(own, on, "left").drop(*[f"__{c}" for c in g])
        parts.append(_findings(df, rows, pack.scope, as_of))
    for g, d in groups.items():
        checks = [c for c in pack.checks if isinstance(c, Check) and c.grain == g]
        if checks:
            parts.append(_findings(d, checks, pack.scope, as_of))
        parts += [to_finding(c, c.build(d, as_of), as_of) for c in pack.checks if isinstance(c, GroupRule) and c.grain == g]
    return parts


def run_rules(inputs: dict, rules: list, as_of: str, skip: DataFrame | None = None, max_priority: int | None = None) -> DataFrame:
    """Evaluate packs and rules; ``skip`` has columns ``scope`` and ``check_id`` (NULL = any).

    The findings are written once before the skip list is applied: as the
    checks' ids are constants, Catalyst would else push the anti joins into
    every part, without a key.
    """
    parts = []
    for r in rules:
        if isinstance(r, Pack):
            r = r.only(lambda c: max_priority is None or c.priority <= max_priority)
            parts += run_pack(inputs[r.input], r, as_of)
        elif max_priority is None or r.priority <= max_priority:
            parts.append(to_finding(r, r.build(inputs, as_of), as_of))
    if not parts:
        spark = next(iter(inputs.values())).sparkSession
        return spark.createDataFrame([], FINDING)
    # the column order is fixed, so a positional union is exact (and cheaper to analyse)
    out = reduce(DataFrame.union, parts)
    if skip is not None:
        out = anti_skip_list(materialize(out, "findings"), skip.select(F.col("scope").cast("string"), F.col("check_id").cast("int")),
                             ["scope", "check_id"])
    return out


def ordered(findings: DataFrame) -> DataFrame:
    """Report order: priority, group, finding, scope, details."""
    return findings.orderBy("priority", "findings_group", "finding", "scope", "details")
