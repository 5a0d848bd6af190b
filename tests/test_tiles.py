"""All pairs by tiles: what a task hands on, and clusters of components of any size."""

from __future__ import annotations

import numpy as np
import pytest

from visitlens.operators import blocks, evaluation, geometry
from visitlens.operators.graph import components


def unit_rows(n, d, seed, spread=0.3, middles=4):
    draw = np.random.default_rng(seed)
    x = draw.standard_normal((middles, d))[draw.integers(0, middles, n)] + spread * draw.standard_normal((n, d))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def table(spark, x, keys=1):
    return spark.createDataFrame([(i % keys, i, v.tolist()) for i, v in enumerate(x)], "key int, id long, embedding array<double>")


@pytest.mark.parametrize("cut", [0.05, 0.2, 0.45, 0.9])
def test_cluster_chain(cut):
    for seed in range(4):
        x = unit_rows(150, 6, seed, 0.5)
        assert geometry.cluster_chain(x, cut) == geometry.cluster_cosine(x, cut)
    assert geometry.cluster_chain(np.repeat(x[:3], 40, 0), 0.01) == [0] * 40 + [1] * 40 + [2] * 40


def test_components_larger_than_a_matrix(spark):
    # One component of 21,000 ids, which raised an error; its sides are found whole.
    draw = np.random.default_rng(1)
    angle = np.repeat([0.0, 0.9], 10_500) + draw.uniform(0, 0.3, 21_000)
    rows = table(spark, np.stack([np.cos(angle), np.sin(angle)], 1))
    found = {}
    for r in geometry.cluster_alike(rows, cut=0.2).collect():
        found.setdefault(r.cluster, set()).add(r.id)
    assert len(found) == 2 and {i for i in found[0]} == set(range(10_500))


def test_links_are_few(spark):
    x = unit_rows(400, 5, 3, 0.1)
    rows = table(spark, x, 2)
    made = blocks.links(rows, 0.9, size=16)
    parts = {r.id: r.component for r in components(made).collect()}
    s = (x @ x.T > 0.9) & (np.arange(400)[:, None] % 2 == np.arange(400) % 2) & ~np.eye(400, dtype=bool)
    label = np.arange(400)
    for _ in range(400):
        label = np.minimum(label, np.where(s, label[None], 400).min(1))
    assert parts == {i: int(label[i]) for i in range(400) if s[i].any()}
    # All pairs were handed on before; now a tile's ids less one, at most, for each pair of tiles.
    assert made.count() < 12 * 400 < s.sum() // 2


def test_scores_leave_a_task_once(spark):
    x = unit_rows(300, 5, 5)
    rows = [(i, i % 3, 19_000 + i // 30, v.tolist()) for i, v in enumerate(x)]
    units = spark.createDataFrame(rows, "probe long, truth int, day int, v array<double>")
    found = evaluation.name_scores(units, embargoes=(3,), size=16)
    got = {(r.probe, r.rule, r.name): r.similarity for r in found.collect()}
    want = {}
    for i, t, d, _ in rows:
        for j, n, e, _ in rows:
            for rule, good in (("free", i != j), ("blocked", i != j and (t, d) != (n, e)), ("3", i != j and (t, d) != (n, e) and abs(d - e) > 3)):
                if good:
                    want[i, rule, n] = max(want.get((i, rule, n), -2.0), float(x[i] @ x[j]))
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert "Aggregate" not in found._jdf.queryExecution().executedPlan().toString().split("MapInPandas")[0]


def test_nearest(spark):
    x = unit_rows(240, 5, 8)
    x[200:] = x[160:200]  # equal templates under greater tags
    at = lambda rows: spark.createDataFrame(rows, "key string, id long, tag long, embedding array<double>")
    key = lambda i: None if i % 9 == 0 else "ab"[i % 2]
    probes, templates = [(key(i), i, -1, x[i].tolist()) for i in range(120)], [(key(i), i - 100, i % 4 if i < 200 else i % 4 + 4, x[i].tolist()) for i in range(100, 240)]
    want, best = {}, {}
    for k, i, _, v in probes:
        for l, j, tag, w in templates:
            if k is not None and k == l:
                s = float(np.dot(v, w))
                best[k, i] = min(best.get((k, i), (9, 9)), (round(-s, 9), tag))
                if i != j:
                    want[k, i, tag] = max(want.get((k, i, tag), -2.0), s)
    got = {(r.key, r.id, r.tag): r.similarity for r in blocks.nearest(at(probes), at(templates), every_tag=True, others=True, size=16).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-9 for k in want)
    assert {(r.key, r.id): (round(-r.similarity, 9), r.tag) for r in blocks.nearest(at(probes), at(templates), size=512).collect()} == best
    plan = blocks.nearest(at(probes), at(templates))._jdf.queryExecution().executedPlan().toString()
    assert "zip_with" not in plan and "Cartesian" not in plan
