from __future__ import annotations

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tidewright.llm import url_filter as u

CAPTURES = [
    (1, "http://www.a.example.com/x/y?q", "2024-01-10 00:00:00"), (2, "https://b.example.com:80/", "2024-02-01 00:00:00"), (3, "https://user@b.example.com/x", "2024-03-01 12:00:00"), (4, None, "2024-03-01 00:00:00"),
    (5, "not a url", "2024-03-01 00:00:00"), (6, "http://b.example.com/x", None), (7, "http://B.EXAMPLE.com./x#f", "2025-07-01 00:00:00"), (8, "http://localhost/x", "2024-05-01 00:00:00"), (8, "http://localhost/x", "2024-05-01 00:00:00"),
]
ENTRIES = [
    ("example.com", "2024-01-01 00:00:00", "add", "deny"), ("b.example.com", "2024-02-01 00:00:00", "add", "allow"), ("b.example.com", "2024-03-01 12:00:00", "remove", "allow"), ("b.example.com/x", "2025-01-01 00:00:00", "add", "allow"),
    ("a.example.com", "2024-01-11 00:00:00", "add", "allow"), ("localhost", "2024-05-01 00:00:00", "add", "deny"), ("localhost", "2024-05-01 00:00:00", "remove", "deny"), (None, "2024-05-01 00:00:00", "add", "deny"), ("x", None, "add", "deny"),
]


@pytest.fixture(scope="module")
def tables(spark):
    stamp = lambda df, c: df.withColumn(c, F.col(c).cast("timestamp_ntz"))
    return stamp(spark.createDataFrame([(*r, "clash") for r in CAPTURES], "page_id bigint, url string, fetched_at string, key string"), "fetched_at"), stamp(spark.createDataFrame(ENTRIES, "key string, at string, action string, kind string"), "at")


def test_as_of(tables):
    got = {r.page_id: (r.deciding_key, r.deciding_kind, r.blocked) for r in u.evaluate(*tables).collect()}
    assert got[1] == ("example.com", "deny", True)
    assert got[2] == ("b.example.com", "allow", False)
    assert got[3] == ("example.com", "deny", True)  # removed at that very moment
    assert got[7] == ("b.example.com/x", "allow", False)
    assert got[4] == got[5] == got[6] == (None, None, False)
    assert got[8] == ("localhost", "deny", True) or got[8] == (None, None, False)
    assert u.evaluate(*tables).count() == 8


def test_against_brute_force(tables):
    captures, entries = tables
    keyed = {(r.page_id, r.url, r.fetched_at): r.k or [] for r in captures.select("*", u.keys(F.col("url")).alias("k")).collect()}
    history = {}
    for e in entries.dropna().collect():
        history.setdefault((e.key, e.kind), {}).setdefault(e.at, []).append(e.action)
    want = {}
    for c, ks in keyed.items():
        active = []
        for (key, kind), dates in history.items():
            past = [d for d in dates if c[2] is not None and d <= c[2]]
            if key in ks and past and "add" in dates[max(past)]:
                active.append((len(key), kind == "allow", key, kind))
        want[c] = (len(active), max(active, default=(0, 0, None, None))[2])
    for salts in (1, 5):
        got = {(r.page_id, r.url, r.fetched_at): (r.n_active, r.deciding_key) for r in u.evaluate(captures, entries, salts=salts).collect()}
        assert got == want


def test_intervals_do_not_overlap_and_empty_lists(tables):
    captures, entries = tables
    rows = u.intervals(entries).collect()
    assert all(r.valid_from < r.valid_to for r in rows) and all(isinstance(r.valid_from, datetime) for r in rows)
    assert u.evaluate(captures, entries.where("false")).where("blocked").count() == 0
    assert u.evaluate(captures.where("false"), entries).count() == 0


def test_a_capture_of_a_far_time_costs_one_month(spark):
    """Open intervals meet a capture of the year 9999 and one of now, and are not cut by the months between."""
    import datetime as dt

    at = dt.datetime
    captures = spark.createDataFrame([(1, "http://a.com/x", at(2024, 1, 5)), (2, "http://a.com/x", at(9998, 12, 5)), (3, "http://a.com/x", at(2023, 1, 1)), (4, "http://a.com/x", None)], "page_id long, url string, fetched_at timestamp_ntz")
    entries = spark.createDataFrame([("a.com", at(2024, 1, 2), "add", "deny")], "key string, at timestamp_ntz, action string, kind string")
    df = u.evaluate(captures, entries)
    assert {r.page_id: r.blocked for r in df.collect()} == {1: True, 2: True, 3: False, 4: False}
    assert u.evaluate(captures.where("page_id = 4"), entries).where("not blocked").count() == 1
