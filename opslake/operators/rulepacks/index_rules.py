"""Index, heap, statistics, recency and schema-shape checks over an index catalog.

Inputs: ``indexes`` (one row per index, see ``fixtures.index_inventory``),
``columns`` (one row per column).  A table is (database, schema, name).
Thresholds follow the source checks.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from opslake.functions.semantics import ts_lit
from opslake.operators.rules import Check, Pack

NC, CL, HEAP = "NONCLUSTERED", "CLUSTERED", "HEAP"
TABLE = ("database_name", "schema_name", "table_name")
SAME_KEYS = (*TABLE, "key_columns")
SAME_FIRST = (*TABLE, "first_key_column")


def _c(name):
    return lambda: F.col(name)


def _t(text):
    return lambda: F.lit(text)


def _none():
    return F.lit(None)


def _reads():
    return F.col("user_seeks") + F.col("user_scans") + F.col("user_lookups")


def _index():
    return F.concat_ws(".", "schema_name", "table_name", "index_name")


def _table():
    return F.concat_ws(".", "schema_name", "table_name")


def _ago(as_of, days):
    return F.timestamp_add("DAY", F.lit(-days), ts_lit(as_of))


def _is_new(as_of):
    return (F.col("create_date") >= _ago(as_of, 7)) & (F.col("modify_date") >= _ago(as_of, 2))


def _kind(*kinds):
    return F.col("index_type").isin(*kinds)


def _unread_nc():
    return _kind(NC) & ~F.col("is_unique") & (_reads() == 0)


def _forwarded():
    return F.col("forwarded_fetch_count") / F.col("uptime_days") > 1000


def _band(lo, hi=None):
    def when(as_of):
        c = _kind(HEAP) & ((_reads() > 0) | (F.col("user_updates") > 0)) & ~_forwarded() & (F.col("row_count") >= lo)
        return c if hi is None else c & (F.col("row_count") < hi)
    return when


def _waits():
    return F.col("row_lock_wait_ms") + F.col("page_lock_wait_ms")


def _width():
    return F.col("key_column_count") + F.col("include_column_count")


def _low_sample(as_of):
    r, s = F.col("row_count"), F.col("rows_sampled")
    return (r.between(10000, 1000000) & (s * 100 < r * 10)) | ((r > 1000000) & (s * 100 < r))


def _write_heavy(as_of):
    r, w = _reads(), F.col("user_updates")
    return _kind(NC) & (r > 0) & (r < 10000) & (w >= 10000) & (r * 10 < w)


def _outdated(as_of):
    return ((F.col("stats_updated") <= _ago(as_of, 30)) & (F.col("modification_counter") * 10 >= F.col("row_count"))
            & (F.col("row_count") >= 10000))


def _row(check_id, priority, group, finding, when, details, num, lookups=()):
    return Check(check_id, priority, group, finding, None, when, _index, details, num, lookups)


def _big_duplicate(as_of, min_mb=250):
    return ~F.col("is_primary_key") & ~F.col("is_disabled") & _kind(CL, NC) & (F.col("total_pages") * 8 >= min_mb * 1024)


def index_pack(legacy: bool = False) -> Pack:
    """``legacy`` keeps the source's slip of counting only new indexes as unused."""
    def aged(as_of):
        return _is_new(as_of) if legacy else ~_is_new(as_of)

    # Check ids and thresholds of the source checks; groups are our wording.
    checks = [
        Check(1, 20, "Duplicate indexes", "Duplicate keys", SAME_KEYS, lambda a: F.col("duplicates") > 1, _table, _c("key_columns"), _c("duplicates")),
        _row(2, 30, "Duplicate indexes", "Borderline duplicate keys", lambda a: F.col("least_keys") != F.col("most_keys"), _c("key_columns"), _none, (SAME_FIRST,)),
        _row(11, 20, "Locking", "Total lock wait time over 5 minutes", lambda a: _waits() > 300000, _t("row + page lock wait ms"), _waits),
        Check(20, 100, "Unused indexes", "Ten or more nonclustered indexes on a table", TABLE, lambda a: F.col("nonclustered") >= 10, _table,
              _t("nonclustered indexes"), _c("nonclustered")),
        Check(21, 150, "Unused indexes", "Five percent or more nonclustered indexes unused", TABLE,
              lambda a: F.col("aged_unread") * 100 >= F.nullif(F.col("aged"), F.lit(0)) * 5, _table,
              _t("percent of nonclustered indexes unused"), lambda: F.try_divide(F.col("aged_unread") * 100.0, F.col("aged"))),
        _row(22, 100, "Unused indexes", "Unused nonclustered index with many writes",
             lambda a: _unread_nc() & (F.col("user_updates") >= 10000), _t("writes"), _c("user_updates")),
        _row(23, 150, "Schema shape", "Wide index", lambda a: _width() >= 7, _t("key + included columns"), _width),
        _row(29, 150, "Unused indexes", "Unused nonclustered index with few writes",
             lambda a: _unread_nc() & aged(a) & (F.col("user_updates") < 10000), _t("writes"), _c("user_updates")),
        _row(43, 100, "Heaps", "Heap with forwarded fetches", lambda a: _kind(HEAP) & _forwarded(), _t("forwarded fetches per day"),
             lambda: F.col("forwarded_fetch_count") / F.col("uptime_days")),
        _row(44, 100, "Heaps", "Large active heap", _band(100000), _t("rows"), _c("row_count")),
        _row(45, 100, "Heaps", "Medium active heap", _band(10000, 100000), _t("rows"), _c("row_count")),
        _row(46, 100, "Heaps", "Small active heap", _band(0, 10000), _t("rows"), _c("row_count")),
        _row(47, 100, "Heaps", "Heap with a nonclustered primary key", lambda a: F.col("is_primary_key") & _kind(NC) & (F.col("heaps") > 0),
             _t("nonclustered primary key on a heap"), _none, (TABLE,)),
        _row(48, 150, "Unused indexes", "Nonclustered index with many more writes than reads", _write_heavy, _t("writes per read"),
             lambda: F.try_divide(F.col("user_updates"), _reads())),
        _row(49, 200, "Heaps", "Heap with deletes", lambda a: _kind(HEAP) & (F.col("leaf_delete_count") > 0)
             & (F.col("forwarded_fetch_count") < F.col("uptime_days") * 1000), _t("deletes"), _c("leaf_delete_count")),
        _row(66, 200, "Recent changes", "Recently created", lambda a: F.col("create_date") >= _ago(a, 7),
             lambda: F.date_format("create_date", "yyyy-MM-dd"), _none),
        _row(67, 200, "Recent changes", "Recently modified",
             lambda a: (F.col("modify_date") > _ago(a, 2)) & (F.col("create_date") < _ago(a, 7)), lambda: F.date_format("modify_date", "yyyy-MM-dd"), _none),
        _row(90, 90, "Statistics", "Statistics not updated recently", _outdated, _t("modifications"), _c("modification_counter")),
        _row(91, 90, "Statistics", "Low sampling rate", _low_sample, _t("percent sampled"),
             lambda: F.try_divide(F.col("rows_sampled") * 100.0, F.col("row_count"))),
    ]
    measures = {
        SAME_KEYS: {"duplicates": lambda a: F.count(F.when(_big_duplicate(a), 1))},
        TABLE: {"nonclustered": lambda a: F.count(F.when(_kind(NC), 1)),
                "aged": lambda a: F.count(F.when(_kind(NC) & aged(a), 1)),
                "aged_unread": lambda a: F.count(F.when(_kind(NC) & aged(a) & (_reads() == 0), 1)),
                "heaps": lambda a: F.count(F.when(_kind(HEAP), 1))},
        # two different key lists with one first column: the smallest is not the largest
        SAME_FIRST: {"least_keys": lambda a: F.min("key_columns"), "most_keys": lambda a: F.max("key_columns")},
    }
    return Pack("indexes", "database_name", checks, measures)


def _not_string():
    return ~F.col("data_type").isin("nvarchar", "varchar", "char", "nchar")


COLUMN_PACK = Pack("columns", "database_name", [
    Check(25, 200, "Schema shape", "Mostly nullable columns", TABLE, lambda a: (F.col("not_null") < 2) & (F.col("n") > 3), _table, _t("columns"), _c("n")),
    Check(26, 200, "Schema shape", "Wide table", TABLE, lambda a: (F.col("n") >= 35) | (F.col("width") >= 2000), _table,
          _t("summed column length"), _c("width")),
    Check(27, 200, "Schema shape", "Mostly string columns", TABLE, lambda a: (F.col("non_string") <= 1) & (F.col("n") > 3), _table, _t("columns"), _c("n")),
], {TABLE: {"n": lambda a: F.count(F.lit(1)), "not_null": lambda a: F.count(F.when(~F.col("is_nullable"), 1)),
            "non_string": lambda a: F.count(F.when(_not_string(), 1)), "width": lambda a: F.sum("max_length")}})

INDEX_RULES = [index_pack(), COLUMN_PACK]
