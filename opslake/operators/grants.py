"""Privilege analysis over grant catalogs (global, database and table levels; ACLs; roles)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opslake.sources.sinks import materialize

PRIVS = ["select", "insert", "update", "delete"]

# PostgreSQL ACL privilege letters.
ACL_LETTERS = [("a", "INSERT"), ("r", "SELECT"), ("w", "UPDATE"), ("d", "DELETE"), ("D", "TRUNCATE"),
               ("x", "REFERENCES"), ("t", "TRIGGER"), ("X", "EXECUTE"), ("U", "USAGE"), ("C", "CREATE"),
               ("c", "CONNECT"), ("T", "TEMPORARY")]


def table_access(global_g: DataFrame, db_g: DataFrame, table_g: DataFrame, db: str, table: str,
                 privilege: str = "select") -> DataFrame:
    """Users allowed ``privilege`` on ``db.table`` at any level (``UNION``: distinct)."""
    p = privilege.lower()
    g = global_g.filter(F.col(f"{p}_priv")).select("user", "host", F.lit("global").alias("level"))
    d = db_g.filter(F.col(f"{p}_priv") & (F.col("db") == db)).select("user", "host", F.lit("database").alias("level"))
    t = (table_g.filter((F.col("db") == db) & (F.col("table_name") == table)
                        & F.array_contains(F.split(F.lower("table_priv"), ","), p))
         .select("user", "host", F.lit("table").alias("level")))
    return g.union(d).union(t).distinct()


def _flags_to_rows(df: DataFrame, kind: str, obj) -> DataFrame:
    arr = F.array(*[F.when(F.col(f"{p}_priv"), F.lit(p.upper())) for p in PRIVS])
    return (df.select(F.col("user").alias("grantee"), F.lit(kind).alias("object_kind"), obj.alias("object_name"),
                      F.explode(F.filter(arr, lambda x: x.isNotNull())).alias("privilege")))


def principal_permissions(global_g, db_g, table_g, column_g, objects: dict[str, tuple[DataFrame, str]] | None = None) -> DataFrame:
    """Every permission of every principal across object kinds (``UNION ALL`` with a kind literal).

    ``objects`` adds further kinds (schema, function, sequence, role): kind ->
    (rows of grantee and object_name, the privilege that such a row stands for).
    """
    s = _flags_to_rows(global_g, "server", F.lit("*"))
    d = _flags_to_rows(db_g, "database", F.col("db"))
    t = table_g.select(F.col("user").alias("grantee"), F.lit("table").alias("object_kind"),
                       F.concat(F.col("db"), F.lit("."), F.col("table_name")).alias("object_name"),
                       F.explode(F.split(F.upper("table_priv"), ",")).alias("privilege"))
    c = column_g.select(F.col("grantee"), F.lit("column").alias("object_kind"), F.col("object_name"),
                        F.col("privilege"))
    out = s.unionByName(d).unionByName(t).unionByName(c)
    for kind, (rows, privilege) in (objects or {}).items():
        out = out.unionByName(rows.select("grantee", F.lit(kind).alias("object_kind"), "object_name", F.lit(privilege).alias("privilege")))
    return out


def role_closure(edges: DataFrame, max_rounds: int = 32) -> DataFrame:
    """(member, role) for every role that a member role belongs to, directly or through others.

    Pairs are joined with themselves until none is new, so the reach doubles
    each round and a chain of n roles takes log2(n) rounds; distinct pairs end a
    cycle, whose roles belong to each other (and, as pairs, not to
    themselves).  Each round is written before the next one reads it.
    """
    pairs = materialize(edges.select("member", "role").where("member <> role").distinct(), "roles")
    count = pairs.count()
    for _ in range(max_rounds):
        step = pairs.alias("a").join(pairs.alias("b"), F.col("a.role") == F.col("b.member")).select("a.member", "b.role")
        wider = materialize(pairs.unionByName(step.where("member <> role")).distinct(), "roles")
        now = wider.count()
        if now == count:
            return wider
        pairs, count = wider, now
    raise ValueError(f"role chains longer than 2^{max_rounds}")


def effective_permissions(permissions: DataFrame, members: DataFrame, is_role) -> DataFrame:
    """What every principal may do, itself or through its roles: permissions plus ``via`` (null: its own).

    ``members`` holds (role, member) of users and of roles in roles; ``is_role``
    tells a role's name.  Only the roles' own graph is closed; users meet it
    once, so their number does not enter the rounds.
    """
    nested = role_closure(members.where(is_role(F.col("member"))))
    direct = members.select("member", "role").distinct()
    reach = direct.unionByName(direct.join(nested.select(F.col("member").alias("role"), F.col("role").alias("upper")), "role")
                                 .select("member", F.col("upper").alias("role")))
    reach = reach.where("member <> role").distinct()
    own = permissions.distinct().withColumn("via", F.lit(None).cast("string"))
    through = (permissions.distinct().withColumnRenamed("grantee", "role").join(reach, "role")
               .select(F.col("member").alias("grantee"), "object_kind", "object_name", "privilege", F.col("role").alias("via")))
    return own.unionByName(through)


def permission_listing(grants: DataFrame, principals: DataFrame, objects: DataFrame) -> DataFrame:
    """Grants with the principal's kind and, where the grant names an object, the object's name and kind."""
    return (grants.join(principals, "principal_id").join(objects, "object_id", "left")
            .select("user_name", "user_kind", "permission", "state", "object_name", "object_kind"))


def acl_explode(df: DataFrame, acl_col: str = "relacl", key: str = "relation") -> DataFrame:
    """``aclexplode``: one row per (grantee, grantor, privilege) of an ACL text ``{g=rw/o,...}``."""
    spark = df.sparkSession
    letters = spark.createDataFrame(ACL_LETTERS, "letter string, privilege_type string")
    items = df.select(key, F.explode(F.split(F.regexp_replace(acl_col, r"[{}]", ""), ",")).alias("item"))
    parsed = items.select(key, F.regexp_extract("item", r"^([^=]*)=", 1).alias("grantee"),
                          F.regexp_extract("item", r"=([^/]*)/", 1).alias("privs"),
                          F.regexp_extract("item", r"/(.*)$", 1).alias("grantor"))
    ex = parsed.select(key, "grantee", "grantor", F.explode(F.split("privs", "")).alias("letter")).filter("letter <> ''")
    return ex.join(F.broadcast(letters), "letter").drop("letter")


def expand_grant_specs(specs: DataFrame) -> DataFrame:
    """Service grant specs with inheritance, exploded to (service, table, privileges).

    A service without its own read list takes its parent's; the parent's
    write tables are added to the read list; write lists are own or parent's.
    """
    p = specs.select(F.col("service").alias("parent"), F.col("read_tables").alias("p_read"),
                     F.col("write_tables").alias("p_write"))
    j = specs.join(p, "parent", "left")
    split = lambda c: F.coalesce(F.split(c, ","), F.array().cast("array<string>"))
    reads = F.array_union(split(F.coalesce("read_tables", "p_read")), split("p_write"))
    writes = split(F.coalesce("write_tables", "p_write"))
    r = j.select("service", F.explode(reads).alias("table_name"), F.lit("SELECT").alias("privileges"))
    w = j.select("service", F.explode(writes).alias("table_name"),
                 F.lit("SELECT, INSERT, UPDATE, DELETE").alias("privileges"))
    return r.unionByName(w)
