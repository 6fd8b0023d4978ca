"""Execution plans stored as XML: nodes as rows, costs bottom-up, rules as a table.

A plan is a tree of nested operators of any depth, which no fixed schema
holds.  Each document is parsed once, in its Arrow batch, into one row per
element: (plan, node in document order, parent, depth, path, attributes, the
chain of its ancestors and the attributes of the node above).  Everything after
that reads those rows once: operators are dealt by plan in one shuffle and their
chains exploded behind it, and a rule is a row of a table that names an element,
a test of one attribute and a measure, so all rules are evaluated by one join on
the element's name and one aggregate.
"""

from __future__ import annotations

from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

_NODE = pa.schema([("plan_id", pa.int64()), ("node", pa.int32()), ("parent", pa.int32()), ("depth", pa.int32()),
                   ("element", pa.string()), ("path", pa.string()), ("ancestors", pa.list_(pa.int32())),
                   ("attrs", pa.map_(pa.string(), pa.string())), ("error", pa.string()), ("above", pa.map_(pa.string(), pa.string()))])
NODE_SCHEMA = ("plan_id long, node int, parent int, depth int, element string, path string, ancestors array<int>, "
               "attrs map<string,string>, error string")

#: columns of a rule table: see ``evaluate``
RULE_SCHEMA = "rule_name string, element string, path_end string, attr string, test string, wanted string, measure string, of string, agg string, at_least double"


class _Columns:
    """Elements of the plans of a batch, column by column; lists and maps as flat values with their ends."""

    def __init__(self):
        self.plan, self.node, self.parent, self.depth, self.element, self.path = ([] for _ in range(6))
        self.ancestors, self.keys, self.values, self.up = [], [], [], []
        self.ancestor_ends, self.attr_ends = [0], [0]

    def read(self, plan: int, text: str) -> None:
        """Append the elements of one plan in document order; a broken plan leaves nothing behind and raises."""
        first, chain, paths = len(self.node), [], [""]
        ancestors, keys, values = self.ancestors, self.keys, self.values

        def start(name, attrs):
            name = name.rsplit(":", 1)[-1]
            node = len(self.node) - first
            self.plan.append(plan)
            self.node.append(node)
            self.parent.append(chain[-1] if chain else None)
            self.up.append(first + chain[-1] if chain else None)
            self.depth.append(len(chain))
            self.element.append(name)
            path = paths[-1] + name
            self.path.append(path)
            chain.append(node)
            paths.append(path + "/")
            ancestors.extend(chain)
            self.ancestor_ends.append(len(ancestors))
            keys.extend(attrs[::2])
            values.extend(attrs[1::2])
            self.attr_ends.append(len(keys))

        def end(_):
            chain.pop()
            paths.pop()

        p = expat.ParserCreate()
        p.ordered_attributes = True
        p.StartElementHandler, p.EndElementHandler = start, end
        try:
            p.Parse(text, True)
        except expat.ExpatError:
            for c in (self.plan, self.node, self.parent, self.depth, self.element, self.path, self.up):
                del c[first:]
            for ends in (self.ancestor_ends, self.attr_ends):
                del ends[first + 1:]
            del ancestors[self.ancestor_ends[-1]:], keys[self.attr_ends[-1]:], values[self.attr_ends[-1]:]
            raise

    def batch(self, columns: list[str]) -> pa.RecordBatch:
        plain = [pa.array(c, f.type) for c, f in zip((self.plan, self.node, self.parent, self.depth, self.element, self.path), _NODE)]
        chains = pa.ListArray.from_arrays(pa.array(self.ancestor_ends, pa.int32()), pa.array(self.ancestors, pa.int32()))
        attrs = pa.MapArray.from_arrays(pa.array(self.attr_ends, pa.int32()), pa.array(self.keys, pa.string()), pa.array(self.values, pa.string()))
        attrs = attrs.cast(_NODE.field("attrs").type)
        cols = [*plain, chains.cast(_NODE.field("ancestors").type), attrs, pa.nulls(len(self.node), pa.string())]
        if "above" in columns:
            cols.append(attrs.take(pa.array(self.up, pa.int32())))
        return pa.RecordBatch.from_arrays(cols, schema=pa.schema([_NODE.field(c) for c in columns]))


def nodes(plans: DataFrame, id_col: str = "plan_id", xml_col: str = "query_plan", above: bool = True) -> DataFrame:
    """One row per element of every plan.

    The column ``above``, which ``evaluate`` needs, has the attributes of the element above; it is left out if not ``above``.

    A null plan has no rows; one that is no well-formed XML has one row without
    element that holds the parser's message.
    """
    columns = [c for c in _NODE.names if above or c != "above"]

    def run(batches):
        for b in batches:
            found, broken, size = _Columns(), [], 0
            for plan, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text = text.as_py()
                if text is None:
                    continue
                try:
                    found.read(plan, text)
                except expat.ExpatError as e:
                    broken.append((plan, None, None, None, None, None, None, None, str(e), None))
                size += len(text)
                if size > 1 << 20:
                    yield found.batch(columns)
                    found, size = _Columns(), 0
            if found.node:
                yield found.batch(columns)
            if broken:
                yield _batch(broken).select(columns)

    return plans.select(F.col(id_col).cast("long").alias("plan_id"), F.col(xml_col).cast("string")).mapInArrow(
        run, NODE_SCHEMA + (", above map<string,string>" if above else ""))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _NODE, strict=True)], schema=_NODE)


def _number(name: str):
    return F.try_element_at("attrs", F.lit(name)).try_cast("double")


def operators(found: DataFrame) -> DataFrame:
    """Plan operators with their own and their subtree's cost, and the operator above each.

    (plan_id, node_id, parent_id, op_depth, physical_op, own_cost, subtree_cost):
    an operator's own cost is its I/O plus CPU estimate, its subtree's the sum
    over all operators below it.
    """
    own = F.coalesce(_number("EstimateIO"), F.lit(0.0)) + F.coalesce(_number("EstimateCPU"), F.lit(0.0))
    # the operators among the ancestors, itself last: a path names every ancestor
    chain = F.transform(F.array(F.split("path", "/")), lambda names: F.filter("ancestors", lambda _, i: F.get(names, i) == "RelOp"))[0]
    # dealt once by plan; chains are exploded behind that, and both windows keep this partitioning
    ops = (found.where((F.col("element") == "RelOp") & F.col("plan_id").isNotNull())
           .select("plan_id", "node", chain.alias("chain"), own.alias("own_cost"), _id().alias("node_id"),
                   F.try_element_at("attrs", F.lit("PhysicalOp")).alias("physical_op")).repartition("plan_id"))
    itself = F.col("at") == F.col("node")
    at = ops.select("plan_id", "node", "own_cost", "node_id", "physical_op", (F.size("chain") - 1).alias("op_depth"),
                    F.get("chain", F.size("chain") - 2).alias("parent"), F.explode("chain").alias("at"))
    w = Window.partitionBy("plan_id", "at")
    at = (at.withColumn("subtree_cost", F.sum("own_cost").over(w)).withColumn("at_id", F.max(F.when(itself, F.col("node_id"))).over(w))
          .where(itself | (F.col("at") == F.col("parent"))))
    parent = F.max(F.when(~itself, F.col("at_id"))).over(Window.partitionBy("plan_id", "node"))
    return (at.withColumn("parent_id", parent).where(itself)
            .select("plan_id", "node_id", "parent_id", "op_depth", "physical_op", "own_cost", "subtree_cost"))


def _id():
    return F.try_element_at("attrs", F.lit("NodeId")).try_cast("int")


def evaluate(found: DataFrame, rules: DataFrame) -> DataFrame:
    """Rules that hold for a plan: (plan_id, rule_name, hits, value).

    A rule looks at nodes named ``element`` whose path ends in ``path_end`` (if
    given) and whose attribute ``attr`` passes ``test`` (``present``, ``equals``,
    ``contains``, ``begins`` with ``wanted``).  Its value is the ``agg`` (``max``, ``sum``
    or ``count``) of the attributes named in ``measure`` (comma separated, added
    up) of the node itself or, with ``of`` = ``parent``, of the node above; the rule
    holds if that is at least ``at_least``.
    """
    r = F.broadcast(rules.withColumnRenamed("element", "wanted_element"))
    hit = found.join(r, found["element"] == r["wanted_element"])
    a = F.coalesce(F.try_element_at("attrs", F.col("attr")), F.lit(""))
    passes = (F.when(F.col("test") == "equals", a == F.col("wanted")).when(F.col("test") == "contains", F.contains(a, F.col("wanted")))
              .when(F.col("test") == "begins", F.startswith(a, F.col("wanted"))).otherwise(True))
    hit = hit.where(passes & (F.col("path_end").isNull() | F.endswith("path", F.col("path_end"))))
    # the attributes of a measure that the node or the one above has, added up; null if it has none. A plan without id has no node above
    source = F.when(F.col("of") == "parent", F.when(F.col("plan_id").isNotNull(), F.col("above"))).otherwise(F.col("attrs"))
    parts = F.filter(F.transform(F.split(F.coalesce("measure", F.lit("")), ","), lambda name: F.try_element_at(source, name).try_cast("double")),
                     lambda x: x.isNotNull())
    value = F.coalesce(F.when(F.size(parts) > 0, F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)), F.lit(0.0))
    g = hit.withColumn("v", value).groupBy("plan_id", "rule_name", "agg", "at_least").agg(
        F.count(F.lit(1)).alias("hits"), F.max("v").alias("m"), F.sum("v").alias("s"))
    out = g.withColumn("value", F.when(F.col("agg") == "max", F.col("m")).when(F.col("agg") == "sum", F.col("s"))
                       .otherwise(F.col("hits").cast("double")))
    return out.where(F.col("value") >= F.coalesce("at_least", F.lit(0.0))).select("plan_id", "rule_name", "hits", "value")


# The plan checks (element, path, attribute, test, value) of the rule table.
PLAN_RULES = [
    ("compile_timeout", "StmtSimple", None, "StatementOptmEarlyAbortReason", "equals", "TimeOut", None, "self", "count", 1.0),
    ("compile_memory_limit", "StmtSimple", None, "StatementOptmEarlyAbortReason", "equals", "MemoryLimitExceeded", None, "self", "count", 1.0),
    ("index_dml", "StmtSimple", None, "StatementType", "equals", "CREATE INDEX", None, "self", "count", 1.0),
    ("plan_warnings", "Warnings", "QueryPlan/Warnings", None, "present", None, None, "self", "count", 1.0),
    ("implicit_conversion", "PlanAffectingConvert", "Warnings/PlanAffectingConvert", "Expression", "contains", "CONVERT_IMPLICIT", None, "self", "count", 1.0),
    ("no_join_predicate", "Warnings", "RelOp/Warnings", "NoJoinPredicate", "equals", "1", None, "self", "count", 1.0),
    ("table_variable", "Object", None, "Table", "begins", "[@", None, "self", "count", 1.0),
    ("scalar_functions", "UserDefinedFunction", None, None, "present", None, None, "self", "count", 1.0),
    ("key_lookup_cost", "IndexScan", "RelOp/IndexScan", "Lookup", "equals", "1", "EstimatedTotalSubtreeCost", "parent", "max", 0.0),
    ("remote_query_cost", "RelOp", None, "PhysicalOp", "contains", "Remote", "EstimatedTotalSubtreeCost", "self", "max", 0.0),
    ("sort_cost", "RelOp", None, "PhysicalOp", "equals", "Sort", "EstimateIO,EstimateCPU", "self", "max", 30.0),
    ("eager_index_spool", "RelOp", None, "LogicalOp", "contains", "Eager Spool", "EstimatedTotalSubtreeCost", "self", "max", 0.0),
    ("table_spool", "RelOp", None, "PhysicalOp", "equals", "Table Spool", "EstimatedTotalSubtreeCost", "self", "sum", 0.0),
    ("missing_index", "MissingIndexGroup", "MissingIndexes/MissingIndexGroup", None, "present", None, "Impact", "self", "max", 20.0),
]


def busy_loops(found: DataFrame) -> DataFrame:
    """Operators run far more often than they give rows: (rewinds + rebinds + 1) / 100 > rows."""
    runs = F.coalesce(_number("EstimateRewinds"), F.lit(0.0)) + F.coalesce(_number("EstimateRebinds"), F.lit(0.0)) + 1
    return (found.where((F.col("element") == "RelOp") & (runs / 100 > _number("EstimateRows")))
            .select("plan_id", _id().alias("node_id"), runs.alias("executions"), _number("EstimateRows").alias("estimated_rows")))
