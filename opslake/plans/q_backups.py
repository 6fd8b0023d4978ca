"""Queries for backup / recovery analysis."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.operators import backups as B
from opslake.operators.timeseries import asof_join
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.sources import fixtures as fx

AS_OF = fx.AS_OF_EVENTS
STOP_AT = "2024-01-20 12:00:00"
D = "CAST({} AS DOUBLE)"
K = "server_name, database_guid, database_name"      # a database of one server

_BASE = f"""WITH {ctes('x3')},
bb AS (SELECT *, last_value(CASE WHEN type = 'D' THEN backup_set_id END IGNORE NULLS) OVER (
                   PARTITION BY {K} ORDER BY first_lsn, backup_set_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS base_full_id,
              backup_size // 1048576 AS mb, date_diff('second', backup_start_date, backup_finish_date) AS secs
       FROM x3)"""

_GAPS = f"""WITH {ctes('x3')},
g AS (SELECT {K}, backup_set_id, backup_finish_date,
             lag(backup_set_id) OVER w AS prev_backup_set_id, lag(backup_finish_date) OVER w AS prev_backup_finish_date
      FROM x3 WINDOW w AS (PARTITION BY {K} ORDER BY backup_finish_date, backup_set_id)),
gg AS (SELECT *, date_diff('minute', prev_backup_finish_date, backup_finish_date) AS gap_minutes
       FROM g WHERE prev_backup_set_id IS NOT NULL)"""


@query("backup_gaps", _GAPS + " SELECT * FROM gg")
def backup_gaps(spark, d):
    return B.gaps(fx.backups(spark, d))


@query("rpo_worst", _GAPS + f""",
r AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY gap_minutes DESC, backup_set_id DESC) AS rk FROM gg)
SELECT {K}, gap_minutes AS rpo_worst_minutes, prev_backup_set_id AS gap_start_id, backup_set_id AS gap_end_id
FROM r WHERE rk = 1""")
def rpo_worst(spark, d):
    return B.rpo_worst(fx.backups(spark, d))


@query("worst_gap", _GAPS + """
SELECT g.server_name, g.database_guid, g.database_name, g.backup_set_id, g.gap_minutes FROM gg g
WHERE NOT EXISTS (SELECT 1 FROM gg h WHERE (h.server_name, h.database_guid, h.database_name) = (g.server_name, g.database_guid, g.database_name)
                  AND (h.gap_minutes > g.gap_minutes OR (h.gap_minutes = g.gap_minutes AND h.backup_set_id > g.backup_set_id)))""")
def worst_gap(spark, d):
    w = B.rpo_worst(fx.backups(spark, d))
    return w.select(*B.KEY, F.col("gap_end_id").alias("backup_set_id"),
                    F.col("rpo_worst_minutes").alias("gap_minutes"))


@query("asof_previous", f"""WITH {ctes('x3')},
u AS (SELECT {K}, backup_set_id, backup_start_date AS t, 1 AS side, type FROM x3 WHERE type = 'L'
      UNION ALL SELECT {K}, backup_set_id, backup_finish_date, 0, type FROM x3 WHERE type = 'D'),
f AS (SELECT *, last_value(CASE WHEN type = 'D' THEN struct_pack(id := backup_set_id, fin := t) END IGNORE NULLS)
                  OVER (PARTITION BY {K} ORDER BY t, side, CASE WHEN type = 'D' THEN backup_set_id END NULLS FIRST
                        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS m FROM u)
SELECT f.server_name, f.database_guid, f.database_name, f.backup_set_id AS log_id, f.t AS log_start, m.id AS full_id, m.fin AS full_finish
FROM f WHERE type = 'L' AND m IS NOT NULL""")
def asof_previous(spark, d):
    b = fx.backups(spark, d)
    logs = b.filter(F.col("type") == B.LOG).select(*B.KEY, F.col("backup_set_id").alias("log_id"),
                                                    F.col("backup_start_date").alias("log_start"))
    fulls = b.filter(F.col("type") == B.FULL).select(*B.KEY, F.col("backup_set_id").alias("full_id"),
                                                      F.col("backup_finish_date").alias("full_finish"))
    j = asof_join(logs, fulls, B.KEY, "log_start", "full_finish", ["full_id", "full_finish"],
                  tie="full_id")
    return j.filter(F.col("full_id").isNotNull())


@query("lsn_range_join", _BASE + f"""
SELECT {K}, backup_set_id AS log_id, first_lsn, base_full_id FROM bb WHERE type = 'L' AND base_full_id IS NOT NULL""")
def lsn_range(spark, d):
    bb = B.with_base_full(fx.backups(spark, d))
    return bb.filter((F.col("type") == B.LOG) & F.col("base_full_id").isNotNull()).select(
        *B.KEY, F.col("backup_set_id").alias("log_id"), "first_lsn", "base_full_id")


_NEXT = f"""nf AS (SELECT {K}, backup_set_id AS full_id,
             lead(backup_set_id) OVER w AS next_full_id, lead(backup_start_date) OVER w AS next_full_start
      FROM x3 WHERE type = 'D' WINDOW w AS (PARTITION BY {K} ORDER BY first_lsn, backup_set_id))"""


@query("next_full_chain", f"WITH {ctes('x3')}, {_NEXT} SELECT * FROM nf")
def next_full(spark, d):
    return B.next_full(fx.backups(spark, d))


@query("recovery_points", _BASE + f""",
lg AS (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY backup_finish_date DESC, backup_set_id DESC) AS rk
       FROM bb WHERE type = 'L'),
att AS (SELECT DISTINCT {K}, base_full_id AS backup_set_id FROM bb WHERE type = 'L' AND base_full_id IS NOT NULL),
un AS (SELECT {K}, COUNT(*) AS unattached_fulls FROM bb f WHERE type = 'D'
       AND NOT EXISTS (SELECT 1 FROM att a WHERE (a.server_name, a.database_guid, a.database_name) = (f.server_name, f.database_guid, f.database_name) AND a.backup_set_id = f.backup_set_id)
       GROUP BY {K})
SELECT lg.server_name, lg.database_guid, lg.database_name, lg.backup_set_id AS last_log_id, lg.backup_finish_date AS last_log_finish, lg.base_full_id,
       coalesce(un.unattached_fulls, 0) AS unattached_fulls
FROM lg LEFT JOIN un USING ({K}) WHERE rk = 1""")
def recovery_points(spark, d):
    return B.recovery_points(fx.backups(spark, d))


_CHAINS = _BASE + ", " + _NEXT + f""",
fu AS (SELECT {K}, backup_set_id AS full_id, mb AS full_mb, secs AS full_seconds FROM bb WHERE type = 'D'),
ld AS (SELECT * FROM (SELECT {K}, base_full_id AS full_id, backup_set_id AS latest_diff_id, first_lsn AS diff_lsn,
                             mb AS diff_mb, secs AS diff_seconds,
                             row_number() OVER (PARTITION BY {K}, base_full_id ORDER BY first_lsn DESC) AS rk
                      FROM bb WHERE type = 'I' AND base_full_id IS NOT NULL) WHERE rk = 1),
lo AS (SELECT {K}, base_full_id AS full_id, first_lsn, mb, secs FROM bb WHERE type = 'L' AND base_full_id IS NOT NULL),
la AS (SELECT lo.server_name, lo.database_guid, lo.database_name, lo.full_id, COUNT(*) AS logs_to_apply, CAST(SUM(mb) AS BIGINT) AS logs_mb,
              CAST(SUM(secs) AS BIGINT) AS logs_seconds, MAX(mb) AS worst_log_mb
       FROM lo LEFT JOIN ld USING ({K}, full_id) WHERE ld.diff_lsn IS NULL OR lo.first_lsn > ld.diff_lsn
       GROUP BY ALL),
al AS (SELECT {K}, full_id, COUNT(*) AS log_count FROM lo GROUP BY ALL),
ch AS (SELECT fu.server_name, fu.database_guid, fu.database_name, fu.full_id, nf.next_full_id, coalesce(al.log_count, 0) AS log_count, ld.latest_diff_id,
              fu.full_mb, fu.full_seconds, coalesce(ld.diff_mb, 0) AS diff_mb, coalesce(ld.diff_seconds, 0) AS diff_seconds,
              coalesce(la.logs_to_apply, 0) AS logs_to_apply, coalesce(la.logs_mb, 0) AS logs_mb,
              coalesce(la.logs_seconds, 0) AS logs_seconds, coalesce(la.worst_log_mb, 0) AS worst_log_mb,
              fu.full_mb + coalesce(ld.diff_mb, 0) + coalesce(la.logs_mb, 0) AS total_mb,
              fu.full_seconds + coalesce(ld.diff_seconds, 0) + coalesce(la.logs_seconds, 0) AS total_seconds
       FROM fu LEFT JOIN nf USING ({K}, full_id) LEFT JOIN al USING ({K}, full_id)
       LEFT JOIN ld USING ({K}, full_id) LEFT JOIN la USING ({K}, full_id))"""


@query("recovery_chain", _CHAINS + f" SELECT {K}, full_id, next_full_id, log_count, latest_diff_id FROM ch")
def recovery_chain(spark, d):
    return B.chains(fx.backups(spark, d)).select(*B.KEY, "full_id", "next_full_id", "log_count",
                                                 "latest_diff_id")


@query("chain_totals", _CHAINS + " SELECT * FROM ch")
def chain_totals(spark, d):
    return B.chains(fx.backups(spark, d))


@query("rto_worst", _CHAINS + f"""
SELECT {K}, full_id, total_mb, total_mb / {D.format(100)} / {D.format(60)} AS rto_worst_minutes
FROM (SELECT *, row_number() OVER (PARTITION BY {K} ORDER BY total_mb DESC, full_id DESC) AS rk FROM ch)
WHERE rk = 1""")
def rto_worst(spark, d):
    return B.rto_worst(fx.backups(spark, d), 100.0)


@query("big_diff_log", f"""WITH {ctes('x3')},
a AS (SELECT {K}, avg(CASE WHEN type = 'D' THEN backup_size // 1048576 END) AS avg_full_mb,
             avg(CASE WHEN type = 'I' THEN backup_size // 1048576 END) AS avg_diff_mb,
             avg(CASE WHEN type = 'L' THEN backup_size // 1048576 END) AS avg_log_mb FROM x3 GROUP BY {K})
SELECT *, coalesce(avg_full_mb > 10240 AND avg_diff_mb * 100 >= avg_full_mb * 40, false) AS big_diff,
       coalesce(avg_full_mb > 10240 AND avg_log_mb * 100 >= avg_full_mb * 20, false) AS big_log FROM a""")
def big_diff_log(spark, d):
    return B.big_diff_log(fx.backups(spark, d))


@query("rpo_overdue", f"""WITH {ctes('x3')}
SELECT {K}, MAX(backup_start_date) AS last_start FROM x3 GROUP BY {K}
HAVING MAX(backup_start_date) < TIMESTAMP '{AS_OF}' - INTERVAL 150 MINUTE
ORDER BY last_start, {K} LIMIT 5""")
def rpo_overdue(spark, d):
    return B.rpo_overdue(fx.backups(spark, d), AS_OF, 150, 5)


@query("stalled_workers", f"""WITH {ctes('x3')}
SELECT {K}, backup_set_id, backup_start_date,
       date_diff('second', backup_start_date, backup_finish_date) AS duration_seconds
FROM x3 WHERE date_diff('second', backup_start_date, backup_finish_date) > 400""")
def stalled(spark, d):
    return B.stalled(fx.backups(spark, d), 400)


@query("restore_files_stop_at", _BASE + f""",
base AS (SELECT {K}, arg_max(backup_set_id, first_lsn) AS base_full_id FROM x3
         WHERE type = 'D' AND backup_finish_date <= TIMESTAMP '{STOP_AT}' GROUP BY {K}),
lg AS (SELECT bb.* FROM bb JOIN base USING ({K}, base_full_id) WHERE type = 'L'),
fa AS (SELECT {K}, arg_min(backup_set_id, (backup_finish_date, backup_set_id)) AS backup_set_id
       FROM lg WHERE backup_finish_date > TIMESTAMP '{STOP_AT}' GROUP BY {K})
SELECT {K}, backup_set_id, base_full_id, backup_finish_date FROM lg
WHERE backup_finish_date <= TIMESTAMP '{STOP_AT}' OR backup_set_id IN (SELECT backup_set_id FROM fa)""")
def restore_files(spark, d):
    return B.restore_files(fx.backups(spark, d), STOP_AT)
