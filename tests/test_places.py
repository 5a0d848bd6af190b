"""Import sweeps and a night's furniture against plain versions."""

from __future__ import annotations

from collections import defaultdict
from statistics import median

import numpy as np

from visitlens.operators import places
from visitlens.operators.geometry import box_iou


def plain_walk(boxes, limit, drift=0.0, best=False):
    at, found = [], []
    for b in boxes:
        fits = [(-box_iou(tuple(a), tuple(b)), k) for k, a in enumerate(at) if box_iou(tuple(a), tuple(b)) >= limit]
        k = (min(fits)[1] if best else fits[0][1]) if fits else None
        if k is None:
            k = len(at)
            at.append(list(b))
        else:
            at[k] = [(1 - drift) * x + drift * y for x, y in zip(at[k], b, strict=True)]
        found.append(k)
    return found, at


def some_boxes(n, seed):
    draw = np.random.default_rng(seed)
    middles = draw.integers(0, 400, (8, 2))
    at = middles[draw.integers(0, 8, n)] + draw.integers(-6, 7, (n, 2))
    return [(float(x), float(y), float(x + 60), float(y + 50)) for x, y in at]


def test_walked():
    for seed in range(5):
        boxes = some_boxes(120, seed)
        for limit, drift, best in ((0.75, 0.0, False), (0.6, 0.3, False), (0.6, 0.1, True)):
            found, where = places.walked(np.array(boxes), limit, drift, best=best)
            want, at = plain_walk(boxes, limit, drift, best)
            assert found.tolist() == want and np.allclose(where, at)
    assert places.walked(np.zeros((0, 4)), 0.5)[0].tolist() == []


def test_rigidity():
    ramp = list(np.linspace(0, 1, 16))
    assert places.rigidity([ramp] * 5) < 1e-9
    assert places.rigidity([[2 * x + 3 for x in ramp]] + [ramp] * 4) < 1e-9
    assert places.rigidity([ramp, ramp, ramp, ramp[::-1]]) > 1.5
    assert places.rigidity([ramp, None, ramp, ramp]) is None
    # Spread over the life of the place, so a change between its ends shows.
    assert places.rigidity([ramp] * 12 + [ramp[::-1]] * 12) > 1.5


def test_sweep(spark):
    draw = np.random.default_rng(2)
    rows = []
    for source in range(3):
        for i, b in enumerate(some_boxes(150, source)):
            thumb = None if i % 10 == 0 else (np.arange(9.0) if source == 1 else draw.standard_normal(9)).tolist()
            rows.append((source, i, None if i == 77 else float(i * (90 if source == 0 else 10)), *b, thumb, "x"))
    schema = "source int, id long, at_s double, x1 double, y1 double, x2 double, y2 double, thumb array<double>, n string"
    marks = [(0, 40), (1, 20)]
    dropped, rest = places.sweep(spark.createDataFrame(rows, schema), spark.createDataFrame(marks, "source int, mark long"), min_n=6, min_span_s=3600.0)
    want = {}
    for source, mark in marks:
        own = sorted((r for r in rows if r[0] == source and r[1] > mark and r[2] is not None), key=lambda r: (r[2], r[1]))
        found, _ = plain_walk([r[3:7] for r in own], 0.75)
        clusters = defaultdict(list)
        for k, r in zip(found, own, strict=True):
            clusters[k].append(r)
        for members in clusters.values():
            span = members[-1][2] - members[0][2]
            if len(members) < 6:
                continue
            reason = "span" if span >= 3600 else None
            if reason is None:
                worst = places.rigidity([m[7] for m in members])
                reason = "rigid" if worst is not None and worst < 0.15 else None
            if reason:
                want |= {(source, m[1]): (reason, list(members[0][3:7]), len(members), span) for m in members}
    got = {(r.source, r.id): (r.reason, r.anchor, r.n, r.span_s) for r in dropped.collect()}
    assert got == want and {v[0] for v in want.values()} == {"span", "rigid"}
    assert {(r.source, r.id) for r in rest.collect()} == {(r[0], r[1]) for r in rows} - set(want)
    assert rest.columns == ["source", "id", "at_s", "x1", "y1", "x2", "y2", "thumb", "n"]


def test_furniture(spark):
    draw = np.random.default_rng(4)
    boxes, frames = [], []
    for night in range(2):
        for at in range(60):
            frames.append((night, at // 10, at))
            for seq, b in enumerate(some_boxes(int(draw.integers(0, 4)), night * 100 + at % 7)):
                boxes.append((night, at, seq, *b, None if seq == 2 else float(draw.choice([1.0, 1.1, 5.0], p=[0.5, 0.2, 0.3]))))
    b = spark.createDataFrame(boxes, "night int, at long, seq long, x1 double, y1 double, x2 double, y2 double, motion double")
    f = spark.createDataFrame(frames, "night int, clip long, at long")
    things = places.furniture(b, f, min_frames=5, min_share=0.05)
    found = {(r.night, r.place): r for r in things.collect()}
    want, clean = {}, {}
    for night in range(2):
        own = sorted((r for r in boxes if r[0] == night), key=lambda r: (r[1], r[2]))
        place, at = plain_walk([r[3:7] for r in own], 0.6, 0.3)
        for k in set(place):
            motion = [r[7] for r, p in zip(own, place, strict=True) if p == k]
            seen = [m for m in motion if m is not None]
            if len(motion) >= max(5, 3) and seen and median(seen) <= 1.35:
                want[night, k] = (at[k], len(motion))
        for _, _, moment in [x for x in frames if x[0] == night]:
            here = [r[3:7] for r in own if r[1] == moment]
            clean[night, moment] = (len(here), sum(all(box_iou(h, tuple(at)) < 0.6 for (n, _), (at, _) in want.items() if n == night) for h in here))
    assert set(found) == set(want) and want
    assert all(np.allclose([found[k][c] for c in places.SIDES], want[k][0]) and found[k].n == want[k][1] for k in want)
    got = {(r.night, r.at): (r.n, r.clean) for r in places.clean_counts(b, f, things).collect()}
    assert got == clean and any(a != b for a, b in clean.values())


def test_sweep_moves_few_pictures(spark, monkeypatch):
    seen, plain = [], places.walk_groups

    def noted(rows, keys, *rest):
        seen.append((keys, "thumb" in rows.columns, rows.count()))
        return plain(rows, keys, *rest)

    monkeypatch.setattr(places, "walk_groups", noted)
    rows = spark.range(500).selectExpr("1L AS source", "id", "double(id) AS at_s", "0D AS x1", "0D AS y1", "60D AS x2", "50D AS y2", "array(0D, 1D, double(id % 2)) AS thumb")
    dropped, rest = places.sweep(rows, spark.createDataFrame([(1, -1)], "source long, mark long"), rigid=5.0)
    assert dropped.where("reason = 'rigid' and n = 500").count() == 500 and rest.count() == 0
    # All boxes are walked without their pictures; of a place of 500, twelve are compared.
    assert seen == [(["source"], False, 500), (["source", "place"], True, 12)]
