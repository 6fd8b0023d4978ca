"""Queries for the purge / archive pipeline on the audit trail (X10)."""

from __future__ import annotations

from opslake.operators import purge as P
from opslake.plans.oracle_fixtures import ctes
from opslake.plans.registry import query
from opslake.session import scratch_path
from opslake.sources import fixtures as fx

AS_OF = fx.AS_OF_AUDIT
BATCH = 1000     # batch size used by the test queries (the production default is 50,000)

_EL = f"""WITH {ctes('x10')},
el AS (SELECT *, row_number() OVER (ORDER BY id) AS rn FROM x10
       WHERE action_date < CAST(TIMESTAMP '{AS_OF}' AS DATE) - INTERVAL 12 MONTH)"""


@query("purge_eligible_count", f"{_EL} SELECT COUNT(*) AS total FROM el")
def eligible_count(spark, d):
    return P.eligible_count(fx.audit_trail(spark, d), AS_OF)


@query("purge_gate", f"{_EL} SELECT COUNT(*) AS total, CAST({BATCH} AS BIGINT) AS batch_limit, "
                     f"COUNT(*) > {BATCH} AS proceed FROM el")
def gate(spark, d):
    return P.gate(P.eligible_count(fx.audit_trail(spark, d), AS_OF), BATCH)


@query("purge_batch", f"""{_EL}
SELECT * EXCLUDE (rn), TIMESTAMP '{AS_OF}' AS move_date FROM el WHERE rn <= {BATCH}""")
def batch(spark, d):
    return P.oldest_batch(fx.audit_trail(spark, d), AS_OF, BATCH)


@query("purge_latest_batch_ids", f"{_EL} SELECT id FROM el WHERE rn > {BATCH} AND rn <= {2 * BATCH}")
def latest_ids(spark, d):
    src = fx.audit_trail(spark, d)
    b1 = P.oldest_batch(src, AS_OF, BATCH, move_date="2001-08-02 00:00:01")
    rest = P.remove_ids(src, b1)
    b2 = P.oldest_batch(rest, AS_OF, BATCH, move_date="2001-08-02 00:00:02")
    return P.latest_batch_ids(b1.unionByName(b2))


@query("purge_remaining", f"""{_EL}
SELECT x10.* FROM x10 WHERE id NOT IN (SELECT id FROM el WHERE rn <= {BATCH})""")
def remaining(spark, d):
    src = fx.audit_trail(spark, d)
    return P.remove_ids(src, P.oldest_batch(src, AS_OF, BATCH))


@query("purge_multi_batch", f"""{_EL},
tot AS (SELECT (SELECT COUNT(*) FROM el) AS e, (SELECT COUNT(*) FROM x10) AS n),
runs AS (SELECT CAST(r AS INTEGER) AS run_no FROM range(1, {P.MAX_RUNS + 1}) t(r))
SELECT run_no, e - (run_no - 1) * {BATCH} AS eligible_before, CAST({BATCH} AS BIGINT) AS archived_rows,
       n - run_no * {BATCH} AS source_rows_after,
       (SELECT id FROM el WHERE rn = (run_no - 1) * {BATCH} + 1) AS min_id,
       (SELECT id FROM el WHERE rn = run_no * {BATCH}) AS max_id
FROM runs, tot WHERE e - (run_no - 1) * {BATCH} > {BATCH}""")
def multi_batch(spark, d):
    return P.purge_cycle(fx.audit_trail(spark, d), AS_OF, scratch_path(spark, "purge"), BATCH)
