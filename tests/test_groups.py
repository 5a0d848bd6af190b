"""Rules that walk groups in order: many small groups and large ones in little time, and the same as plain versions."""

from __future__ import annotations

import time
from itertools import groupby

import numpy as np

from tests.test_places import plain_walk
from visitlens.catalog import QUERIES
from visitlens.operators import geometry, identity, places


def timed(f):
    began = time.perf_counter()
    return f(), time.perf_counter() - began


def plain_tracks(points, base, rate, gap_s, min_hits):
    """(track, id) of one clip, given as (t, id, x, y)."""
    tracks = []
    for t, now in groupby(sorted(points), key=lambda p: p[0]):
        now = list(now)
        pairs = [(np.hypot(k[-1][2] - p[2], k[-1][3] - p[3]), i, j) for i, k in enumerate(tracks) if t - k[-1][0] <= gap_s for j, p in enumerate(now)]
        pairs = sorted(x for x in pairs if x[0] <= base + rate * (t - tracks[x[1]][-1][0]))
        home = {}
        for _, i, j in pairs:
            if i not in home.values() and j not in home:
                home[j] = i
        for j, p in enumerate(now):
            tracks[home[j]].append(p) if j in home else tracks.append([p])
    long = [k for k in tracks if len(k) >= min_hits]
    return {(n, p[1]) for n, k in enumerate(long) for p in k}


def test_many_clips(spark):
    draw = np.random.default_rng(4)
    rows = [(c, i, float(draw.integers(0, 4)), float(draw.uniform()), float(draw.uniform())) for c in range(50) for i in range(12)]
    some = spark.createDataFrame(rows, "clip long, id long, t double, cx double, cy double")
    found = {}
    for r in geometry.associate(some, base=0.2, rate=0.1, gap_s=2, min_hits=2).collect():
        found.setdefault(r.clip, set()).add((r.track, r.id))
    for c in range(50):
        assert found.get(c, set()) == plain_tracks([(t, i, x, y) for k, i, t, x, y in rows if k == c], 0.2, 0.1, 2, 2)
    many = spark.range(60_000).selectExpr("id div 3 AS clip", "id", "double(id % 3) AS t", "0.5D AS cx", "0.5D AS cy")
    n, took = timed(lambda: geometry.associate(many, min_hits=2).count())
    assert n == 60_000 and took < 12  # a call for each of 20,000 clips takes more than twice as long


def scattered(n, seed=1):
    """Boxes of many sizes and shapes, few of which are alike."""
    draw = np.random.default_rng(seed)
    at, side = draw.uniform(0, 3000, (n, 2)), np.exp(draw.uniform(-1, 5, (n, 2)))
    return np.hstack([at, at + side])


def test_a_box_meets_few_places():
    for limit in (0.05, 0.3, 0.6, 0.75, 0.97):
        boxes = np.repeat(scattered(60, 7), 6, 0) * np.random.default_rng(9).uniform(0.97, 1.03, (360, 1))
        boxes[5] = np.nan
        boxes[9, 2] = boxes[9, 0]
        assert places.walked(boxes, limit)[0].tolist() == plain_walk(boxes.tolist(), limit)[0]
    found, took = timed(lambda: places.walked(scattered(12_000), 0.75)[0])
    assert len(set(found.tolist())) > 10_000 and took < 3


def test_static_clusters_of_many_places(spark, tmp_path):
    # Six thousand places of four boxes at one source; all boxes against all places take over ten times as long.
    side = "l_orderkey long, l_linenumber int, l_quantity double, l_extendedprice double, l_discount double, l_tax double, l_partkey long, l_returnflag string"
    place = "id % 6000"
    rows = spark.range(24_000).selectExpr("40 * id AS l_orderkey", "1 AS l_linenumber", f"double(20 * ({place} % 80)) AS l_quantity", f"double(6 * ({place} div 80)) AS l_extendedprice", "-0.036D AS l_discount", "0D AS l_tax", "id AS l_partkey", "'A' AS l_returnflag")
    rows.select([c.split()[0] for c in side.split(", ")]).write.parquet(f"{tmp_path}/lineitem.parquet")
    found, took = timed(lambda: QUERIES["g7_static_clusters"](spark, str(tmp_path)).collect())
    assert len(found) == 6000 and {r.n for r in found} == {4} and took < 8


def test_drifting_places():
    for limit, best in ((0.3, False), (0.6, True), (0.75, False)):
        boxes = np.repeat(scattered(40, 3), 9, 0) * np.random.default_rng(2).uniform(0.97, 1.03, (360, 1))
        found, where = places.walked(boxes, limit, 0.3, best=best)
        want, at = plain_walk(boxes.tolist(), limit, 0.3, best)
        assert found.tolist() == want and np.allclose(where, at)
    found, took = timed(lambda: places.walked(np.tile(scattered(9000), (2, 1)), 0.75, 0.3)[0])
    assert found[:9000].tolist() == found[9000:].tolist() and took < 3


def test_many_days(spark, tmp_path):
    events = spark.range(60_000).selectExpr("id AS event_id", "timestamp_seconds(1704067200 + 86400 * (id div 3 % 20) + 1800 * (id % 3)) AS ts", "id div 60 AS user_id", "'view' AS event_type", "double(id % 3) AS value", "'{\"k\": 1}' AS props")
    events.write.parquet(f"{tmp_path}/events.parquet")
    found, took = timed(lambda: {r.id for r in QUERIES["w13_spaced_frames"](spark, str(tmp_path)).collect()})
    assert found == {i for i in range(60_000) if i % 3 != 1} and took < 12  # a call for each of 20,000 days takes more than twice as long


def test_many_visits(spark):
    # Two boxes that stay where they are for three frames, in each of 8,000 visits; a call for each takes about a minute.
    rows = spark.range(48_000).selectExpr("id div 6 AS visit", "id", "double(id div 2 % 3) AS at_s", "double(500 * (id % 2)) AS x1", "0D AS y1", "double(500 * (id % 2) + 50) AS x2", "50D AS y2")
    found, took = timed(lambda: geometry.still_tracklets(rows).groupBy("track", "apart").count().collect())
    assert {(r.track, tuple(r.apart), r["count"]) for r in found} == {(0, (1,), 24_000), (1, (0,), 24_000)} and took < 15


def test_unblending_many_visits(spark):
    vector = "CASE WHEN id % 2 = 0 THEN array(1F, 0F) ELSE array(0F, 1F) END"
    rows = spark.range(18_000).selectExpr("id div 6 AS visit", "1L AS source", "id", "double(id div 2 % 3) AS at_s", "double(500 * (id % 2)) AS x1", "0D AS y1", "double(500 * (id % 2) + 50) AS x2", "50D AS y2", "0.5D AS quality", "string(null) AS label", f"{vector} AS embedding")
    made = spark.createDataFrame([(1, "stan", [1.0, 0.0]), (1, "olive", [0.0, 1.0])], "source long, name string, embedding array<double>")
    logged = spark.range(3000).selectExpr("id AS visit", "array('olive', 'stan') AS names")
    found, took = timed(lambda: identity.unblend_stills(rows, made, logged).groupBy("cluster", "name", "n_crops", "cohesion").count().collect())
    assert {tuple(r) for r in found} == {(0, "stan", 3, 1.0, 3000), (1, "olive", 3, 1.0, 3000)} and took < 25


def test_places_are_held_not_boxes(spark):
    # A source's boxes pass a task one by one: the walk is fed before the last one is there.
    rows = spark.range(30_000).selectExpr("1L AS source", "id", "id AS at", "double(100 * (id % 3)) AS x1", "0D AS y1", "double(100 * (id % 3) + 60) AS x2", "50D AS y2")
    made = geometry.place_clusters(rows, limit=0.6, drift=0.1, best=True)
    assert "FlatMapGroups" not in made._jdf.queryExecution().executedPlan().toString()
    assert {(r.cluster, r["count"]) for r in made.groupBy("cluster").count().collect()} == {(0, 10_000), (1, 10_000), (2, 10_000)}
