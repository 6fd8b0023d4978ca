"""Backup-history checks (per database) over a backup history table."""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions.semantics import ts_lit
from opslake.operators.aggregate import majority_and_others
from opslake.operators.backups import DIFF, FULL, KEY, LOG, _mb
from opslake.operators.rules import Check, GroupRule, Pack

DB = tuple(KEY)
BY_ENCRYPTOR = (*KEY, "encryptor_type")
BY_USER = (*KEY, "user_name")
FLAGS = {"is_password_protected": (3, 100, "Password-protected backups"), "is_snapshot": (4, 100, "Snapshot backups"),
         "is_readonly": (5, 100, "Read-only database backups"), "is_single_user": (6, 100, "Single-user database backups"),
         "is_damaged": (8, 10, "Damaged backups"), "has_bulk_logged_data": (10, 100, "Bulk-logged data in backups")}


def _name():
    return F.concat_ws(".", "server_name", "database_name", "database_guid")


def _count(cond):
    return lambda a: F.count(F.when(cond(a), 1))


def _recent(as_of, days=30):
    return F.col("backup_start_date") >= F.timestamp_add("DAY", F.lit(-days), ts_lit(as_of))


def _check(check_id, priority, finding, when, details, num, grain=DB):
    return Check(check_id, priority, "Backups", finding, grain, when, _name, details if callable(details) else (lambda: F.lit(details)),
                 lambda: F.col(num))


def _avg(kind):
    return lambda a: F.avg(F.when(F.col("type") == kind, _mb()))


def other_users(groups, as_of):
    o = majority_and_others(groups, KEY, "user_name", exclude=["svc_agent"], counts="n")
    return o.select(F.col("database_name").alias("scope"), F.concat_ws(".", _name(), "user_name").alias("object_name"),
                    F.concat(F.lit("most backups by "), F.col("majority_user_name")).alias("details"),
                    F.col("n").alias("details_num"))


def _big(col, pct):
    return lambda a: (F.col("avg_full_mb") > 10240) & (F.col(col) * 100 >= F.col("avg_full_mb") * pct)


# Check ids of the source's backup checks; priorities and wording are ours.
BACKUP_PACK = Pack("backups", "database_name", [
    GroupRule(1, 50, "Backups", "Backups by a non-majority user", BY_USER, other_users),
    _check(2, 50, "Compatibility level changed more than twice", lambda a: F.col("levels") > 2, "compatibility levels", "levels"),
    *[_check(i, p, text, lambda a, c=c: F.col(f"n_{c}") > 0, c, f"n_{c}") for c, (i, p, text) in FLAGS.items()],
    _check(7, 50, "Backups without checksums", lambda a: F.col("no_checksum") > 0, "backups without checksum in 30 days", "no_checksum"),
    _check(9, 100, "Encrypted backups", lambda a: F.col("encryptor_type").isNotNull(), lambda: F.col("encryptor_type"), "n", BY_ENCRYPTOR),
    _check(11, 100, "Recovery model switched often", lambda a: F.col("models") > 4, "recovery models", "models"),
    _check(12, 100, "Uncompressed full backups", lambda a: F.col("uncompressed") > 0, "uncompressed full backups in 30 days", "uncompressed"),
    _check(13, 100, "Large differential backups", _big("avg_diff_mb", 40), "average differential vs full MB", "avg_diff_mb"),
    _check(13, 100, "Large log backups", _big("avg_log_mb", 20), "average log vs full MB", "avg_log_mb"),
], {
    # levels and models are few: their sets stay small and need no distinct pass of their own
    DB: {"levels": lambda a: F.size(F.collect_set("compatibility_level")),
         "models": lambda a: F.size(F.collect_set(F.when(F.col("recovery_model") != "BULK-LOGGED", F.col("recovery_model")))),
         **{f"n_{c}": _count(lambda a, c=c: F.col(c)) for c in FLAGS},
         "no_checksum": _count(lambda a: _recent(a) & ~F.col("has_backup_checksums")),
         "uncompressed": _count(lambda a: _recent(a) & (F.col("type") == FULL) & (F.col("backup_size") == F.col("compressed_backup_size"))),
         "avg_full_mb": _avg(FULL), "avg_diff_mb": _avg(DIFF), "avg_log_mb": _avg(LOG)},
    BY_ENCRYPTOR: {"n": lambda a: F.count(F.lit(1))},
    BY_USER: {"n": lambda a: F.count(F.lit(1))},
})

BACKUP_RULES = [BACKUP_PACK]
