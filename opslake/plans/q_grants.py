"""Queries for privileges on the grant fixtures (X9)."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import grants as G
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx
from opslake.sources.tables import table


@query("table_access_union", f"""WITH {ctes('x9g', 'x9d', 'x9t')}
SELECT "user", host, 'global' AS level FROM x9g WHERE select_priv
UNION SELECT "user", host, 'database' FROM x9d WHERE select_priv AND db = 'db2'
UNION SELECT "user", host, 'table' FROM x9t WHERE db = 'db2' AND table_name = 't3'
      AND list_contains(string_split(lower(table_priv), ','), 'select')""")
def table_access(spark, d):
    return G.table_access(fx.global_grants(spark, d), fx.db_grants(spark, d), fx.table_grants(spark, d),
                          "db2", "t3", "select")


def _column_grants(spark, d):
    p = table(spark, d, "part")
    return p.select(F.concat(F.lit("s"), (F.col("p_partkey") % 20).cast("string")).alias("grantee"),
                    F.concat(F.lit("db"), (F.col("p_size") % 5).cast("string"), F.lit(".t"),
                             (F.col("p_partkey") % 10).cast("string"), F.lit("."), F.col("p_name")).alias("object_name"),
                    F.lit("SELECT").alias("privilege"))


_UNP = " UNION ALL ".join(
    f"SELECT \"user\" AS grantee, '{{kind}}' AS object_kind, {{obj}} AS object_name, '{p.upper()}' AS privilege "
    f"FROM {{src}} WHERE {p}_priv" for p in G.PRIVS)


# further object kinds: schemas, functions, sequences and roles
_ROLE = "'role_' || lower(r_name)"
_OBJ_SQL = f"""
sch AS (SELECT 'n' || n_nationkey AS grantee, 'db' || n_regionkey || '.s' || (n_nationkey % 3) AS object_name FROM nation),
fun AS (SELECT 's' || (s_suppkey % 20) AS grantee, 'db' || (s_nationkey % 5) || '.f' || s_suppkey AS object_name FROM supplier),
seq AS (SELECT 's' || (p_partkey % 20) AS grantee, 'db' || (p_size % 5) || '.seq' || p_partkey AS object_name FROM part),
rol AS (SELECT {_ROLE} AS role, 'n' || n_nationkey AS member FROM region JOIN nation ON n_regionkey = r_regionkey
        UNION ALL SELECT 'role_' || lower(u.r_name), 'role_' || lower(m.r_name) FROM region m JOIN region u
                  ON u.r_regionkey = m.r_regionkey + 1 OR (m.r_regionkey = 4 AND u.r_regionkey = 3))"""


def _objects(spark, d):
    n, s, p = (table(spark, d, t) for t in ("nation", "supplier", "part"))
    name = lambda *c: F.concat(*[F.lit(x) if isinstance(x, str) else x.cast("string") for x in c])
    schemas = n.select(name("n", F.col("n_nationkey")).alias("grantee"), name("db", F.col("n_regionkey"), ".s", F.col("n_nationkey") % 3).alias("object_name"))
    functions = s.select(name("s", F.col("s_suppkey") % 20).alias("grantee"), name("db", F.col("s_nationkey") % 5, ".f", F.col("s_suppkey")).alias("object_name"))
    sequences = p.select(name("s", F.col("p_partkey") % 20).alias("grantee"), name("db", F.col("p_size") % 5, ".seq", F.col("p_partkey")).alias("object_name"))
    roles = _members(spark, d).select(F.col("member").alias("grantee"), F.col("role").alias("object_name"))
    return {"schema": (schemas, "USAGE"), "function": (functions, "EXECUTE"), "sequence": (sequences, "USAGE"), "role": (roles, "MEMBER")}


def _members(spark, d):
    """Users in the role of their region, and roles in roles: a chain of four whose last two are in each other."""
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    role = F.concat(F.lit("role_"), F.lower("r_name"))
    users = r.join(n, n.n_regionkey == r.r_regionkey).select(role.alias("role"), F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("member"))
    low = r.select(role.alias("member"), F.explode(F.when(F.col("r_regionkey") == 4, F.array(F.lit(3), F.lit(5))).otherwise(
        F.array(F.col("r_regionkey") + 1))).alias("up"))
    nested = low.join(r.select(role.alias("role"), F.col("r_regionkey").alias("up")), "up").select("role", "member")
    return users.unionByName(nested)


_ALL_SQL = f"""{_UNP.format(kind='server', obj="'*'", src='x9g')}
UNION ALL {_UNP.format(kind='database', obj='db', src='x9d')}
UNION ALL SELECT "user", 'table', db || '.' || table_name, unnest(string_split(upper(table_priv), ',')) FROM x9t
UNION ALL SELECT 's' || (p_partkey % 20), 'column', 'db' || (p_size % 5) || '.t' || (p_partkey % 10) || '.' || p_name,
                 'SELECT' FROM part
UNION ALL SELECT grantee, 'schema', object_name, 'USAGE' FROM sch UNION ALL SELECT grantee, 'function', object_name, 'EXECUTE' FROM fun
UNION ALL SELECT grantee, 'sequence', object_name, 'USAGE' FROM seq UNION ALL SELECT member, 'role', role, 'MEMBER' FROM rol"""


def _permissions(spark, d):
    return G.principal_permissions(fx.global_grants(spark, d), fx.db_grants(spark, d), fx.table_grants(spark, d),
                                   _column_grants(spark, d), _objects(spark, d))


@query("principal_permissions", f"WITH {ctes('x9g', 'x9d', 'x9t')}, {_OBJ_SQL} {_ALL_SQL}")
def principal_permissions(spark, d):
    return _permissions(spark, d)


@query("effective_permissions", f"""WITH RECURSIVE {ctes('x9g', 'x9d', 'x9t')}, {_OBJ_SQL},
grants AS ({_ALL_SQL} UNION ALL SELECT 'role_' || lower(r_name), 'table', 'db' || r_regionkey || '.t' || c_custkey % 10, 'SELECT'
           FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
reach AS (SELECT member, role FROM rol UNION SELECT reach.member, rol.role FROM reach JOIN rol ON rol.member = reach.role)
SELECT DISTINCT grantee, object_kind, object_name, privilege, CAST(NULL AS VARCHAR) AS via FROM grants
UNION ALL SELECT DISTINCT reach.member, object_kind, object_name, privilege, reach.role FROM grants JOIN reach ON reach.role = grants.grantee
          WHERE reach.member <> reach.role""")
def effective_permissions(spark, d):
    """Own permissions and those through nested roles, two of which are members of each other."""
    c, n, r = (table(spark, d, t) for t in ("customer", "nation", "region"))
    to_roles = (c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("role_"), F.lower("r_name")).alias("grantee"), F.lit("table").alias("object_kind"),
        F.concat(F.lit("db"), F.col("r_regionkey").cast("string"), F.lit(".t"), (F.col("c_custkey") % 10).cast("string")).alias("object_name"),
        F.lit("SELECT").alias("privilege")))
    return G.effective_permissions(_permissions(spark, d).unionByName(to_roles), _members(spark, d), lambda c: F.startswith(c, F.lit("role_")))


@query("permission_listing", """
WITH g AS (SELECT s_suppkey AS grant_no, s_nationkey AS principal_id, CASE s_suppkey % 4 WHEN 0 THEN 'SELECT' WHEN 1 THEN 'EXECUTE' WHEN 2 THEN 'ALTER'
                  ELSE 'CONTROL' END AS permission, CASE WHEN s_suppkey % 9 = 0 THEN 'DENY' ELSE 'GRANT' END AS state, s_suppkey % 40 AS object_id FROM supplier)
SELECT 'n' || n_nationkey AS user_name, CASE WHEN n_nationkey % 2 = 0 THEN 'SQL_USER' ELSE 'WINDOWS_USER' END AS user_kind, permission, state,
       'o' || o.object_id AS object_name, o.object_kind
FROM g JOIN nation ON n_nationkey = principal_id
LEFT JOIN (SELECT c_custkey AS object_id, CASE WHEN c_custkey % 3 = 0 THEN 'VIEW' ELSE 'USER_TABLE' END AS object_kind FROM customer
           WHERE c_custkey % 5 <> 0) o ON o.object_id = g.object_id""")
def permission_listing(spark, d):
    """All grants of the database; those on the database itself have no object."""
    k = F.col("s_suppkey")
    grants = table(spark, d, "supplier").select(
        F.col("s_nationkey").alias("principal_id"), F.when(k % 4 == 0, "SELECT").when(k % 4 == 1, "EXECUTE").when(k % 4 == 2, "ALTER").otherwise("CONTROL").alias("permission"),
        F.when(k % 9 == 0, "DENY").otherwise("GRANT").alias("state"), (k % 40).alias("object_id"))
    n, c = F.col("n_nationkey"), F.col("c_custkey")
    principals = table(spark, d, "nation").select(n.alias("principal_id"), F.concat(F.lit("n"), n.cast("string")).alias("user_name"),
                                                  F.when(n % 2 == 0, "SQL_USER").otherwise("WINDOWS_USER").alias("user_kind"))
    objects = table(spark, d, "customer").where(c % 5 != 0).select(c.alias("object_id"), F.concat(F.lit("o"), c.cast("string")).alias("object_name"),
                                                                  F.when(c % 3 == 0, "VIEW").otherwise("USER_TABLE").alias("object_kind"))
    return G.permission_listing(grants, principals, objects)


def _acls(spark, d):
    s = table(spark, d, "supplier")
    k = F.col("s_suppkey")
    letters = F.when(k % 4 == 0, "arwd").when(k % 4 == 1, "r").when(k % 4 == 2, "rw").otherwise("arwdDxt")
    return s.select(F.concat(F.lit("rel"), k.cast("string")).alias("relation"),
                    F.concat(F.lit("{s"), (k % 20).cast("string"), F.lit("="), letters, F.lit("/postgres,n"),
                             F.col("s_nationkey").cast("string"), F.lit("=r/postgres}")).alias("relacl"))


_LET = "(VALUES " + ", ".join(f"('{a}', '{b}')" for a, b in G.ACL_LETTERS) + ") AS lt(letter, privilege_type)"


@query("acl_explode", f"""
WITH a AS (SELECT 'rel' || s_suppkey AS relation,
                  '{{s' || (s_suppkey % 20) || '=' || CASE s_suppkey % 4 WHEN 0 THEN 'arwd' WHEN 1 THEN 'r'
                       WHEN 2 THEN 'rw' ELSE 'arwdDxt' END || '/postgres,n' || s_nationkey || '=r/postgres}}' AS relacl
           FROM supplier),
i AS (SELECT relation, unnest(string_split(regexp_replace(relacl, '[{{}}]', '', 'g'), ',')) AS item FROM a),
p AS (SELECT relation, regexp_extract(item, '^([^=]*)=', 1) AS grantee, regexp_extract(item, '=([^/]*)/', 1) AS privs,
             regexp_extract(item, '/(.*)$', 1) AS grantor FROM i),
e AS (SELECT relation, grantee, grantor, unnest(string_split(privs, '')) AS letter FROM p)
SELECT relation, grantee, grantor, lt.privilege_type FROM e JOIN {_LET} USING (letter) WHERE letter <> ''""")
def acl_explode(spark, d):
    return G.acl_explode(_acls(spark, d))


@query("role_members", """
SELECT 'role_' || lower(r.r_name) AS role_name, 'n' || n.n_nationkey AS member_name, n.n_name AS member_label
FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey""")
def role_members(spark, d):
    r, n = table(spark, d, "region"), table(spark, d, "nation")
    return r.join(n, n.n_regionkey == r.r_regionkey).select(
        F.concat(F.lit("role_"), F.lower("r_name")).alias("role_name"),
        F.concat(F.lit("n"), F.col("n_nationkey").cast("string")).alias("member_name"),
        F.col("n_name").alias("member_label"))


@query("login_user_map", """
SELECT 'login_' || n.n_name AS login_name, n.n_nationkey AS sid, 'u' || s.s_suppkey AS user_name
FROM nation n JOIN supplier s ON s.s_nationkey = n.n_nationkey""")
def login_users(spark, d):
    n, s = table(spark, d, "nation"), table(spark, d, "supplier")
    return n.join(s, s.s_nationkey == n.n_nationkey).select(
        F.concat(F.lit("login_"), F.col("n_name")).alias("login_name"), F.col("n_nationkey").alias("sid"),
        F.concat(F.lit("u"), F.col("s_suppkey").cast("string")).alias("user_name"))


def _specs(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    return n.select(F.concat(F.lit("svc_"), k.cast("string")).alias("service"),
                    F.when(k % 5 != 0, F.concat(F.lit("svc_"), (k - k % 5).cast("string"))).alias("parent"),
                    F.when(k % 3 != 0, F.concat(F.lit("t"), k.cast("string"), F.lit(",t"), (k + 1).cast("string")))
                     .alias("read_tables"),
                    F.when(k % 2 == 0, F.concat(F.lit("w"), k.cast("string"))).alias("write_tables"))


@query("grant_expand", """
WITH s AS (SELECT 'svc_' || n_nationkey AS service,
                  CASE WHEN n_nationkey % 5 <> 0 THEN 'svc_' || (n_nationkey - n_nationkey % 5) END AS parent,
                  CASE WHEN n_nationkey % 3 <> 0 THEN 't' || n_nationkey || ',t' || (n_nationkey + 1) END AS read_tables,
                  CASE WHEN n_nationkey % 2 = 0 THEN 'w' || n_nationkey END AS write_tables FROM nation),
j AS (SELECT s.service, coalesce(s.read_tables, p.read_tables) AS r, p.write_tables AS pw,
             coalesce(s.write_tables, p.write_tables) AS w FROM s LEFT JOIN s p ON p.service = s.parent),
rd AS (SELECT DISTINCT service, unnest(string_split(r, ',')) AS table_name FROM j WHERE r IS NOT NULL
       UNION SELECT service, unnest(string_split(pw, ',')) FROM j WHERE pw IS NOT NULL)
SELECT service, table_name, 'SELECT' AS privileges FROM rd
UNION ALL SELECT service, unnest(string_split(w, ',')), 'SELECT, INSERT, UPDATE, DELETE' FROM j WHERE w IS NOT NULL""")
def grant_expand(spark, d):
    return G.expand_grant_specs(_specs(spark, d))


@query("role_attributes", """
SELECT 'n' || n_nationkey AS rolname, n_nationkey % 7 = 0 AS rolsuper, n_nationkey % 2 = 0 AS rolcanlogin,
       coalesce(strftime(CASE WHEN n_nationkey % 3 = 0 THEN NULL
                              ELSE TIMESTAMP '2025-01-01 00:00:00' + to_days(n_nationkey) END, '%Y-%m-%d'), 'never')
         AS valid_until FROM nation""")
def role_attributes(spark, d):
    n = table(spark, d, "nation")
    k = F.col("n_nationkey")
    until = F.when(k % 3 != 0, F.timestamp_add("DAY", k, F.lit("2025-01-01 00:00:00").cast("timestamp_ntz")))
    return n.select(F.concat(F.lit("n"), k.cast("string")).alias("rolname"), (k % 7 == 0).alias("rolsuper"),
                    (k % 2 == 0).alias("rolcanlogin"),
                    F.coalesce(F.date_format(until, "yyyy-MM-dd"), F.lit("never")).alias("valid_until"))
