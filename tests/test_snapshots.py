"""Snapshot delta kernel: previous-snapshot rule, restart guard, gap guard."""

import datetime as dt

from opslake.operators import snapshots as T


def _cats(spark):
    return spark.createDataFrame([("click", "CPU", False), ("view", "Network IO", True)], "wait_type string, wait_category string, ignorable boolean")


def _rows(spark, rows):
    return spark.createDataFrame(rows, "server_name string, check_date timestamp_ntz, wait_type string, "
                                       "wait_time_ms bigint, signal_wait_time_ms bigint, waiting_tasks_count bigint")


def t(h, m=0):
    return dt.datetime(2024, 1, 1, h, m)


def test_deltas_guards(spark):
    rows = [
        ("s", t(0), "A", 100, 10, 1), ("s", t(0), "B", 50, 5, 1),
        ("s", t(1), "A", 160, 12, 3),                                # B missing at 01:00
        ("s", t(2), "A", 40, 1, 4), ("s", t(2), "B", 80, 6, 2),      # A restarted; B's prev snapshot lacks B
        ("s", t(3, 1), "A", 90, 2, 5),                               # 61-minute gap: dropped
        ("s", t(3, 1), "B", 90, 7, 3),
        ("s", t(3, 1), "C", 1, 0, 1),
        ("s", t(3, 1, ), "D", 1, 0, 1),
        ("s", t(3, 31), "A", 95, 2, 6), ("s", t(3, 31), "C", 4, 1, 2),
    ]
    d = T.wait_deltas(_rows(spark, rows), _cats(spark)).collect()
    got = sorted((r.check_date.hour, r.check_date.minute, r.wait_type, r.wait_time_ms_delta) for r in d)
    assert got == [(1, 0, "A", 60), (3, 31, "A", 5), (3, 31, "C", 3)]


def test_deltas_sum_to_last_minus_first(spark):
    rows = [("s", t(h), "A", 100 * h * h, h, h) for h in range(6)]
    d = T.wait_deltas(_rows(spark, rows), _cats(spark))
    assert d.agg({"wait_time_ms_delta": "sum"}).first()[0] == 2500
    assert d.first().wait_category == "Other"


def test_category_lookup_default(spark):
    rows = [("s", t(0), "click", 1, 0, 1), ("s", t(1), "click", 5, 0, 2), ("s", t(0), "zzz", 1, 0, 1),
            ("s", t(1), "zzz", 2, 0, 2)]
    d = {r.wait_type: (r.wait_category, r.ignorable)
         for r in T.wait_deltas(_rows(spark, rows), _cats(spark)).collect()}
    assert d == {"click": ("CPU", False), "zzz": ("Other", False)}
