"""Cases by hand: boundaries, ties, missing values and order-dependent operators."""

from __future__ import annotations

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.operators import digest, evaluation, geometry, identity, intervals, ledger, profiles, sessions

DAY = dt.datetime(2024, 5, 1)


def at(minutes: float) -> dt.datetime:
    return DAY + dt.timedelta(minutes=minutes)


@pytest.fixture
def detections(spark):
    def make(rows):
        return spark.createDataFrame([(i, at(m), s, c, sp) for i, (m, s, c, sp) in enumerate(rows)], "id long, ts timestamp_ntz, source string, confidence double, species string")

    return make


def test_gap_splits_only_beyond(detections):
    rows = detections([(0, "a", 0.5, "x"), (5, "a", 0.9, "x"), (10.02, "a", 0.9, "y"), (2, "b", None, "x")])
    found = {(r.source, r.started_at): (r.n, r.max_confidence, r.rep_id) for r in sessions.visits(rows, 300).collect()}
    assert found == {("a", at(0)): (2, 0.9, 1), ("a", at(10.02)): (1, 0.9, 2), ("b", at(2)): (1, None, 3)}
    assert sessions.visits(rows, 300, closed=True).count() == 4


def test_visit_across_midnight_and_idle_days(detections):
    rows = detections([(1436, "a", 0.1, "x"), (1439, "a", 0.1, "x"), (1442, "a", 0.1, "x"), (1440 * 4, "a", 0.1, "x"), (1440 * 4 + 1, "a", 0.1, "x")])
    assert sorted((r.started_at, r.n) for r in sessions.visits(rows, 300).collect()) == [(at(1436), 3), (at(1440 * 4), 2)]


def test_empty_input(spark):
    none = spark.createDataFrame([], "id long, ts timestamp_ntz, source string, confidence double, species string")
    assert sessions.visits(none, 300).count() == 0
    assert profiles.typical_window(profiles.hour_counts(none, "species"), "species", 0.8).count() == 0
    assert evaluation.roc_auc(spark.createDataFrame([], "score double, label int")).collect()[0].auc in (None, 0.5)


def test_vote_gate_falls_back(detections):
    rows = sessions.stamp_visits(detections([(0, "a", 0.3, "fox"), (1, "a", 0.3, "fox"), (2, "a", 0.9, "hare"), (60, "a", 0.2, "owl"), (61, "a", 0.3, "")]), 300)
    found = {r.started_at: (r.species, r.gated) for r in sessions.species_vote(rows).collect()}
    assert found == {at(0): ("hare", True), at(60): ("owl", False)}
    plain = {r.started_at: r.species for r in sessions.winners(sessions.votes(rows)).collect()}
    assert plain[at(0)] == "fox"


def test_vote_tie_goes_to_first_seen(detections):
    rows = sessions.stamp_visits(detections([(0, "a", 0.3, "owl"), (1, "a", 0.3, "fox")]), 300)
    assert [r.species for r in sessions.winners(sessions.votes(rows)).collect()] == ["owl"]


def test_window_wraps_midnight(spark):
    counts = spark.createDataFrame([("a", 23, 5), ("a", 0, 4), ("a", 12, 1), ("b", 7, 3)], "key string, hour long, n long")
    found = {r.key: (r.start_hour, r.end_hour) for r in profiles.typical_window(counts, "key", 0.8).collect()}
    assert found == {"a": (23, 0), "b": (7, 7)}


def test_overlap_is_closed_and_finds_each_pair_once(spark):
    a = spark.createDataFrame([("s", at(0), at(1500)), ("s", at(2000), None)], "source string, a0 timestamp_ntz, a1 timestamp_ntz")
    b = spark.createDataFrame([("s", at(1500), at(1600), 1), ("s", at(10), at(1400), 2), ("s", at(2000), at(2000), 3), ("t", at(0), at(9), 4)], "source string, b0 timestamp_ntz, b1 timestamp_ntz, id long")
    assert sorted(r.id for r in intervals.overlap_join(a, b).collect()) == [1, 2, 3]


def test_islands_touch(spark):
    spans = spark.createDataFrame([("s", at(0), at(10), 1), ("s", at(10), at(2000), 2), ("s", at(1990), at(1995), 3), ("s", at(2001), at(2002), 4)], "source string, a0 timestamp_ntz, a1 timestamp_ntz, id long")
    found = {r.id: r.island for r in intervals.islands(spans).collect()}
    assert found == {1: at(0), 2: at(0), 3: at(0), 4: at(2001)}


def test_dark_seconds_unknown_before_the_ledger(spark):
    events = spark.createDataFrame([("s", at(10), "down"), ("s", at(20), "up")], "source string, at timestamp_ntz, event string")
    windows = spark.createDataFrame([("s", at(0), at(5)), ("s", at(0), at(15)), ("s", at(15), at(60))], "source string, a0 timestamp_ntz, a1 timestamp_ntz")
    assert {(r.a0, r.a1): r.dark_s for r in intervals.dark_seconds(events, windows).collect()} == {(at(0), at(5)): None, (at(0), at(15)): 300.0, (at(15), at(60)): 300.0}


def test_histogram_edges(spark):
    rows = spark.createDataFrame([(c,) for c in (0.0, 0.3, 0.6, 0.7, 0.95, 1.0)], "c double")
    assert [r.b for r in rows.select(evaluation.bin_of("c").alias("b")).collect()] == [0, 2, 5, 6, 9, 9]


def test_upper_median_and_single_class(spark):
    rows = spark.createDataFrame([(1, x) for x in (4, 1, 3, 2)], "g int, x int")
    assert rows.groupBy("g").agg(columns.upper_median("x").alias("m")).first().m == 3
    assert evaluation.roc_auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "score double, label int")).first().auc == 0.5


def test_auc_with_ties_matches_pairs(spark):
    rng = np.random.default_rng(3)
    score, label = rng.integers(0, 6, 60) / 5, rng.integers(0, 2, 60)
    pos, neg = score[label == 1], score[label == 0]
    want = np.mean([(p > n) + 0.5 * (p == n) for p in pos for n in neg])
    rows = spark.createDataFrame([(float(s), int(x)) for s, x in zip(score, label, strict=True)], "score double, label int")
    assert evaluation.roc_auc(rows).first().auc == pytest.approx(want)


def test_wall_clock_and_bad_text(spark):
    rows = spark.createDataFrame([("2024-03-31T19:25:00-07:00",), ("nonsense",), (None,)], "t string")
    assert [r.w for r in rows.select(columns.wall_clock("t").alias("w")).collect()] == [dt.datetime(2024, 3, 31, 19, 25), None, None]
    assert [r.d for r in rows.select(columns.as_date("t").alias("d")).collect()] == [dt.date(2024, 3, 31), None, None]


def box_rows(spark, boxes):
    return spark.createDataFrame([(1, i, *map(float, b), s) for i, (b, s) in enumerate(boxes)], "frame long, seq long, x1 double, y1 double, x2 double, y2 double, score double")


def test_boxes(spark):
    rows = box_rows(spark, [((0, 0, 10, 10), 0.5), ((1, 0, 11, 10), 0.9), ((20, 0, 30, 10), 0.4), ((0, 0, 30, 10), 0.3)])
    assert sorted(r.seq for r in geometry.separated(rows).collect()) == [0, 2, 3]
    assert sorted(r.seq for r in geometry.suppress(rows).collect()) == [1, 2, 3]
    assert sorted(r.seq for r in geometry.distinct_boxes(rows).collect()) == [1, 2]


def test_distinct_boxes_by_rule(spark):
    """Flat boxes go, an umbrella that was turned away is no child, ties go by coordinates whatever the order of rows."""
    cases = {
        1: [(0.9, 0, 0, 10, 10), (0.8, 20, 0, 30, 10), (0.7, 0, 0, 30, 10), (0.6, 5, 5, 5, 9)],  # the third is an umbrella
        2: [(0.9, 0, 0, 30, 10), (0.8, 0, 0, 10, 10), (0.7, 20, 0, 30, 10)],  # met before its children
        3: [(0.5, 1, 0, 11, 10), (0.5, 0, 0, 10, 10)],  # duplicates of one score
        4: [(0.9, 0, 0, 40, 40), (0.8, 0, 0, 10, 10), (0.7, 20, 0, 30, 10)],  # a large one that only holds small ones
    }
    want = {1: {(0, 0, 10, 10), (20, 0, 30, 10)}, 2: {(0, 0, 10, 10), (20, 0, 30, 10)}, 3: {(0, 0, 10, 10)}, 4: {(0, 0, 40, 40), (0, 0, 10, 10), (20, 0, 30, 10)}}
    for turn in (1, -1):
        rows = [(f, i, *map(float, b)) for f, boxes in cases.items() for i, b in enumerate(boxes[::turn])]
        df = spark.createDataFrame(rows, "frame long, seq long, score double, x1 double, y1 double, x2 double, y2 double")
        found = geometry.distinct_boxes(df).join(df, ["frame", "seq"]).collect()
        assert {f: {(r.x1, r.y1, r.x2, r.y2) for r in found if r.frame == f} for f in cases} == want


def test_place_clusters_keep_their_anchor(spark):
    rows = spark.createDataFrame([(1, i, i, x, 0.0, x + 20, 20.0) for i, x in enumerate([0.0, 2.0, 4.0, 6.0])], "source long, id long, at long, x1 double, y1 double, x2 double, y2 double")
    assert [r.cluster for r in geometry.place_clusters(rows, cell=1e6).orderBy("id").collect()] == [0, 0, 1, 1]
    assert [r.cluster for r in geometry.place_clusters(rows, cell=1e6, drift=1.0).orderBy("id").collect()] == [0, 0, 0, 0]


def test_tracks_cross(spark):
    rows = [(1, 2 * k + j, float(k), 0.05 * k if j else 1 - 0.05 * k, 0.2 * j) for k in range(6) for j in (0, 1)]
    found = geometry.associate(spark.createDataFrame(rows, "clip long, id long, t double, cx double, cy double")).collect()
    by = {}
    for r in found:
        by.setdefault(r.track, set()).add(r.id % 2)
    assert sorted(by.values(), key=str) == [{0}, {1}] and len(found) == 12


def test_gait_frequency(spark):
    """The bob of the longest walking run counts; a track that stands, and a short one, have no stride."""
    t = np.arange(0, 6, 1 / 15)
    rows = [(1, float(x), 0.1 * float(x), 0.5 + 0.01 * float(np.sin(2 * np.pi * 1.5 * x))) for x in t]
    rows += [(1, 6.0 + float(x), 0.6, 0.5) for x in t]  # then it stands
    rows += [(2, float(x), 0.3, 0.5) for x in t] + [(3, 0.0, 0.0, 0.0)]
    found = {r.track: r for r in geometry.gait(spark.createDataFrame(rows, "track long, t double, cx double, cy double")).collect()}
    assert found[1].stride_hz == pytest.approx(1.5) and found[1].walk_s == pytest.approx(6, abs=0.2)
    assert found[2].stride_hz is None and found[2].walk_s == 0 and found[3].stride_hz is None


def plain_gait(t, cx, cy):
    """The rule step by step: (stride, strength), or (None, None)."""
    dt = [b - a for a, b in zip(t, t[1:], strict=False)]
    usual = float(np.median([d for d in dt if d > 0]))
    best, a = (0, 0), None
    for i in range(len(dt) + 1):
        on = i < len(dt) and math.hypot(cx[i + 1] - cx[i], cy[i + 1] - cy[i]) / max(dt[i], 1e-9) > 0.04 and dt[i] <= 3 * usual
        if on and a is None:
            a = i
        if not on and a is not None:
            best, a = max(best, (a, i), key=lambda r: t[r[1]] - t[r[0]]), None
    s, e = best
    if t[e] - t[s] < 2.5:
        return None, None
    n, w = max(round((t[e] - t[s]) / usual) + 1, 8), max(3, round(1.2 / usual) | 1)
    y = np.interp(np.linspace(t[s], t[e], n), t[s : e + 1], cy[s : e + 1])
    h = w // 2
    x = np.array([y[i] - sum(y[i - h : i + h + 1]) / w for i in range(h, n - h)])
    if len(x) < 12:
        return None, None
    x = x - x.mean()
    r = {k: sum(x[i] * x[i + k] for i in range(len(x) - k)) / sum(x * x) for k in range(max(1, round(1 / 3.2 / usual)), min(len(x) - 2, round(1 / 0.8 / usual)) + 1)}
    top = max(r.values())
    return (None, None) if top < 0.3 else (1 / (usual * next(k for k in r if r[k] >= 0.95 * top)), top)


def test_gait_is_the_plain_rule(spark):
    rng, rows, want = np.random.default_rng(5), [], {}
    for track in range(30):
        t = np.cumsum(rng.choice([0.1, 0.1, 0.1, 0.12, 0.5 if track % 3 else 0.1], 120))
        cx = np.cumsum(np.where(rng.random(120) < 0.97, 0.02, 0.0))
        cy = 0.5 + 0.01 * np.sin(2 * np.pi * rng.uniform(0.9, 3) * t) + rng.normal(0, 0.002, 120)
        rows += [(track, *map(float, p)) for p in zip(t, cx, cy, strict=True)]
        want[track] = plain_gait(t, cx, cy)
    for r in geometry.gait(spark.createDataFrame(rows, "track long, t double, cx double, cy double")).collect():
        a, b = want[r.track]
        assert (r.stride_hz is None and a is None) or (r.stride_hz == pytest.approx(a) and r.strength == pytest.approx(b))
    assert sum(a is not None for a, _ in want.values()) >= 10


def test_linkage_cannot_link():
    x = np.array([[1.0, 0], [0.99, 0.14], [0, 1.0]])
    x = x / np.linalg.norm(x, axis=1)[:, None]
    assert geometry.cluster_cosine(x, 0.3) == [0, 0, 1]
    assert geometry.cluster_cosine(x, 0.3, np.array([[True, True, False], [True, True, False], [False, False, True]])) == [0, 1, 2]


def test_replay_is_causal(spark):
    e, f = [1.0, 0.0], [0.0, 1.0]
    rows = [(1, 1, 0.0, "a", True, e), (1, 2, 10.0, "a", False, e), (1, 3, 20.0, "b", False, f), (1, 4, 30.0, "b", True, f), (1, 5, 40.0, "b", False, f)]
    units = spark.createDataFrame(rows, "source long, key long, at_s double, truth string, by_human boolean, embedding array<double>")
    found = {r.key: (r.named, r.depth, r.wrong) for r in evaluation.forward_replay(units, threshold=0.5, margin=0.1).collect()}
    assert found == {1: ("a", 0.0, False), 2: ("a", 1.0, False), 3: (None, None, False), 4: ("b", 0.0, False), 5: ("b", 1.0, False)}


def test_import_plan(spark):
    batch = spark.createDataFrame([(1, "a", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "y"), (5, "d", None)], "k long, owner string, content string")
    known = spark.createDataFrame([("y",)], "t string").select(F.sha2("t", 256).alias("sha"), F.lit("z").alias("owner"))
    found = {r.k: r.state for r in ledger.plan_import(batch, known, content=F.col("content"), order="k").collect()}
    assert found == {1: "NEW", 2: "DUPLICATE", 3: "CONFLICT", 4: "CONFLICT", 5: "UNREADABLE"}


def test_elimination(spark):
    sides = spark.createDataFrame([(1, 0, "a", ["a", "b"]), (1, 1, None, ["a", "b"]), (2, 0, None, ["a", "b"]), (2, 1, None, ["a", "b"])], "visit long, side long, recognised string, names array<string>")
    assert {(r.visit, r.side): r.name for r in identity.eliminate(sides).collect()} == {(1, 0): "a", (1, 1): "b", (2, 0): None, (2, 1): None}


REEL = "period long, id long, ts timestamp_ntz, species string, individuals array<string>, burst long, score double, n long, seconds double"


def test_reel_respects_budget(spark):
    rows = [(1, i, at(i), f"s{i % 3}", [], i // 4, float(i), 1, 6.0) for i in range(40)]
    found = digest.select_reel(spark.createDataFrame(rows, REEL)).collect()
    assert len(found) == 13 and {r.id for r in found} >= {37, 38, 39}  # the last one starts within the budget


def test_reel_names_and_beats(spark):
    """A weak moment of a named individual gets in; a long burst gives a second and a third beat, apart from the first."""
    long = [(1, i, at(m), "fox", None, 0, s, 5, 6.0) for i, (m, s) in enumerate([(0, 9.0), (1, 8.0), (10, 7.0), (30, 1.0)])]
    short = [(1, 10, at(150), "owl", ["Mo"], 1, 3.0, 1, 6.0), (1, 11, at(151), "owl", ["Bo"], 1, 2.0, 1, 6.0), (1, 12, at(333), "owl", None, 2, 2.5, 1, 6.0)]
    rows = spark.createDataFrame(long + short, REEL)
    order = lambda **k: [r.id for r in digest.select_reel(rows, **k).orderBy("place").collect()]
    assert order(most=3) == [0, 10, 11]  # the owl is rarer, then the fox, then Bo
    assert order(most=4) == [0, 10, 11, 12]
    assert order(most=5) == [0, 2, 10, 11, 12]  # ten minutes after the first beat, not one
    assert order(most=6) == [0, 2, 3, 10, 11, 12]
    assert order(budget_s=7) == [0, 10]


def test_folds_cover_every_probe_once():
    table = evaluation.fold_table(11, 4, 2, 3)
    for r in (0, 1):
        assert sorted(i for q, _, i in table if q == r) == list(range(11))
        assert sorted(sum(f == k for q, f, _ in table if q == r) for k in range(4)) == [2, 3, 3, 3]
    assert [i for q, f, i in table if q == 0 and f == 0] == np.random.RandomState(3).permutation(11)[:3].tolist()


def test_held_out_selects_on_the_other_folds(spark):
    probes = spark.createDataFrame([(i, 0.5 + 0.1 * (i % 4), 0.1, "a", "a" if i != 5 else "b") for i in range(8)], "position long, similarity double, lead double, answer string, truth string")
    folds = spark.createDataFrame([(0, i % 2, i) for i in range(8)], "repeat long, fold long, position long")
    found = {r.fold: (r.assigned, r.wrong) for r in evaluation.held_out(probes, folds, [0.5, 0.65, 0.75], [0.0]).collect()}
    # Fold 1 trains the strictest point without error, 0.75, which none of fold 0 meets; fold 0 trains 0.5.
    assert found == {0: (0, 0), 1: (4, 1)}


def test_still_tracklets_never_join_one_frame(spark):
    rows = [(1, 10 * k + j, float(k), 100.0 * j, 0.0, 100.0 * j + 20, 20.0) for k in range(4) for j in (0, 1)]
    found = geometry.still_tracklets(spark.createDataFrame(rows, "visit long, id long, at_s double, x1 double, y1 double, x2 double, y2 double")).collect()
    by = {}
    for r in found:
        by.setdefault(r.track, set()).add(r.id % 10)
    assert sorted(by.values(), key=str) == [{0}, {1}]


def test_frozen_scene(spark):
    rows = [(1, [1.0, 2.0, 3.0]), (1, [2.0, 4.0, 6.0]), (2, [1.0, 2.0, 3.0]), (2, [3.0, 2.0, 1.0]), (3, [1.0, 0.0, 0.0])]
    found = {r.group: r.dissimilarity for r in geometry.frozen(spark.createDataFrame(rows, "group long, thumb array<double>")).collect()}
    assert found[1] == pytest.approx(0) and found[2] == pytest.approx(2) and found[3] is None


def test_places_on_the_border_of_two_cells(spark):
    """With the default cell, a box that wobbles over a border stays one place."""
    rows = spark.createDataFrame([(1, i, i, 44.0 + i % 2, 44.0, 83.0 + i % 2, 84.0) for i in range(6)], "source long, id long, at long, x1 double, y1 double, x2 double, y2 double")
    for drift in (0.0, 0.3):
        got = geometry.place_clusters(rows, drift=drift).select("source", "cell_x", "cell_y", "cluster").distinct().collect()
        assert len(got) == 1


def test_still_tracklets_by_rule(spark):
    """Doubles share a box, nearness links within a diagonal, a long gap does not, and tracks of one frame are apart."""
    boxes = [
        (1, 0.0, (0, 0, 10, 10)), (2, 0.0, (0, 0, 10, 16)), (3, 0.0, (100, 0, 110, 10)),  # 1 and 2 are one, as large as both
        (4, 5.0, (0, 12, 10, 28)),  # overlaps the box around both only
        (5, 5.0, (112, 0, 122, 10)),  # no overlap, but near
        (6, 10.0, (140, 0, 150, 10)),  # too far from 5
        (7, 40.0, (112, 0, 122, 10)),  # too late
    ]
    rows = spark.createDataFrame([(9, i, t, *map(float, b)) for i, t, b in boxes], "visit long, id long, at_s double, x1 double, y1 double, x2 double, y2 double")
    found = {r.id: (r.track, r.apart) for r in geometry.still_tracklets(rows).collect()}
    assert found == {1: (0, [1]), 2: (0, [1]), 4: (0, [1]), 3: (1, [0]), 5: (1, [0]), 6: (2, []), 7: (3, [])}


def test_frozen_scenes_need_number_and_span(spark):
    a, b, c = np.eye(4)[:3].tolist()
    rows = [(1, i, 60.0 * i, a) for i in range(6)] + [(1, 10 + i, 60.0 * i + 1, b) for i in range(4)] + [(1, 20 + i, 300.0 + i, c) for i in range(6)] + [(1, 30, 500.0, [2.0] * 4)]
    found = geometry.frozen_scenes(spark.createDataFrame(rows, "visit long, id long, at_s double, thumb array<double>")).collect()
    assert [(r.ids, r.n, r.span_s) for r in found] == [([0, 1, 2, 3, 4, 5], 6, 300.0)] and found[0].dissimilarity == pytest.approx(0) and found[0].confidence == 1


def test_logged_names_are_dealt_once(spark):
    e = {"a": [1.0, 0.0, 0.0], "b": [0.0, 1.0, 0.0], "c": [0.0, 0.0, 1.0]}
    groups = [(1, 0, 9, "a", e["b"]), (1, 1, 8, None, [0.1, 0.9, 0.0]), (1, 2, 7, None, [0.5, 0.5, 0.1]), (1, 3, 1, None, e["c"]), (2, 0, 5, None, e["a"]), (3, 0, 5, "a", e["a"]), (3, 1, 4, None, e["c"])]
    groups = spark.createDataFrame(groups, "visit long, cluster long, n long, label string, embedding array<double>")
    logged = spark.createDataFrame([(1, ["a", "b", "c"]), (2, ["a"]), (3, ["a", "b"])], "visit long, names array<string>")
    made = spark.createDataFrame([("a", e["a"]), ("b", e["b"]), ("d", e["c"])], "name string, embedding array<double>")
    found = {(r.visit, r.cluster): (r.name, r.choices) for r in identity.resolve_logged(groups, logged, made, threshold=0.6).collect()}
    assert found == {(1, 0): ("a", ["a"]), (1, 1): ("b", ["b"]), (1, 2): ("c", ["c"]), (1, 3): (None, []), (3, 0): ("a", ["a"]), (3, 1): ("b", ["b"])}


def test_previous_over_days(spark):
    rows = spark.createDataFrame([(1, i, at(i * 667), i % 3) for i in range(8)] + [(2, 9, at(0), 5)], "source long, id long, ts timestamp_ntz, x int")
    assert [r.before for r in sessions.with_previous(rows, "x").orderBy("source", "id").collect()] == [None, 0, 1, 2, 0, 1, 2, 0, None]
