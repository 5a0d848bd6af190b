"""Queries against their SQL on small tables with values at the borders of their rules."""

from __future__ import annotations

import datetime as dt

import duckdb
import pytest

from tests.test_queries import plain
from visitlens.catalog import ORACLE_SQL, QUERIES

START = dt.datetime(2024, 1, 1, 6)


def same_as_sql(spark, folder, name, events):
    """``events``: (source, hours since the start, type, value, k), numbered as they come."""
    rows = [(i, START + dt.timedelta(hours=h), source, kind, float(value), '{"k": %d}' % k) for i, (source, h, kind, value, k) in enumerate(events)]
    spark.createDataFrame(rows, "event_id long, ts timestamp, user_id long, event_type string, value double, props string").coalesce(1).write.parquet(f"{folder}/events.parquet")
    df = QUERIES[name](spark, str(folder))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * REPLACE (ts::TIMESTAMP AS ts) FROM '{folder}/events.parquet/*.parquet'")
    found = con.sql(ORACLE_SQL[name])
    order = lambda names: [names.index(c) for c in sorted(names)]
    want = plain(found.fetchall(), order(found.columns))
    assert plain([tuple(r) for r in df.collect()], order(df.columns)) == want
    return want


WEIGHTLESS = [(1, 0, "view", 0, 1), (1, 1, "click", 0, 2), (2, 0, "view", 450, 3), (2, 1, "click", 0, 4), (2, 30, "click", 0, 4)]


def test_votes_without_weight(spark, tmp_path):
    assert any("null" in r for r in same_as_sql(spark, tmp_path, "a4_weighted_vote", WEIGHTLESS))


def test_report_of_votes_without_weight(spark, tmp_path):
    same_as_sql(spark, tmp_path, "a5_vote_report", WEIGHTLESS)


@pytest.fixture
def dealt(spark):
    """Rows of a source's days stay in the partitions they are dealt to."""
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, "false")
    yield
    spark.conf.unset(key)


def over_midnight(parts):
    """Visits of four detections, two on each side of midnight; the border is met by the sum in the order of time, not by that of two days' sums."""
    return [(source, 15 + 3 * h - (h > 1), "view", 300 + h, k) for source, ks in enumerate(parts) for h, k in enumerate(ks)]


def test_motion_at_a_border(spark, tmp_path, dealt):
    ks = [(79, 96, 41, 14), (14, 75, 49, 92), (94, 74, 52, 10), (36, 34, 85, 15), (27, 73, 93, 37), (49, 45, 61, 15)]
    assert len(same_as_sql(spark, tmp_path, "a20_visit_motion", over_midnight(ks))) == 6


def test_behaviour_at_a_border(spark, tmp_path, dealt):
    ks = [(31, 86, 64, 15), (95, 15, 15, 71), (47, 85, 36, 28), (62, 68, 45, 21), (69, 43, 68, 16), (96, 38, 34, 28)]
    same_as_sql(spark, tmp_path, "a22_behaviour_share", over_midnight(ks))


def test_notes_are_rounded_to_even(spark, tmp_path):
    want = same_as_sql(spark, tmp_path, "l18_quality_side_table", [(1, h, "click", v, h) for h, v in enumerate((0.5, 1.5, 2.5, 3.5, 4.49, 4.51, 100.5))])
    assert [r[1] for r in want] == [f"{v}.000000" for v in (0, 2, 2, 4, 4, 5, 100)]


def test_species_without_a_common_hour(spark, tmp_path):
    kinds = {"view": (3, 4), "click": (4, 5), "error": (20,)}
    want = same_as_sql(spark, tmp_path, "u7_guild_hours", [(1, h, kind, 1, 1) for kind, hours in kinds.items() for h in hours])
    assert ("click", "error", "0.000000") in want and len(want) == 3
