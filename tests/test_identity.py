"""Clusters, refit and un-blending against plain versions."""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pytest

from visitlens.operators import blocks, geometry, graph, identity


def unit_clouds(n, width, middles, spread, seed):
    draw = np.random.default_rng(seed)
    m = draw.standard_normal((middles, width))
    x = m[draw.integers(0, middles, n)] + spread * draw.standard_normal((n, width))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def plain_linkage(x, cut, forbidden=()):
    """Join the closest pair of clusters again and again."""
    parts = [[i] for i in range(len(x))]
    d = 1 - x @ x.T
    while True:
        best = None
        for a in range(len(parts)):
            for b in range(a + 1, len(parts)):
                if any((i, j) in forbidden or (j, i) in forbidden for i in parts[a] for j in parts[b]):
                    continue
                mean = np.mean([d[i, j] for i in parts[a] for j in parts[b]])
                if mean < cut and (best is None or mean < best[0] - 1e-12):
                    best = (mean, a, b)
        if best is None:
            return {frozenset(p) for p in parts}
        parts[best[1]] += parts.pop(best[2])


def as_sets(labels):
    out = defaultdict(set)
    for i, k in enumerate(labels):
        out[k].add(i)
    return {frozenset(s) for s in out.values()}


@pytest.mark.parametrize("seed", range(6))
def test_cluster_cosine(seed):
    x = unit_clouds(30, 5, 4, 0.4, seed)
    forbidden = {(i, i + 1) for i in range(0, 30, 3)}
    mask = np.zeros((30, 30), bool)
    for i, j in forbidden:
        mask[i, j] = mask[j, i] = True
    for cut in (0.2, 0.45, 0.9):
        assert as_sets(geometry.cluster_cosine(x, cut)) == plain_linkage(x, cut)
        assert as_sets(geometry.cluster_cosine(x, cut, mask)) == plain_linkage(x, cut, forbidden)
    assert geometry.cluster_cosine(np.ones((1, 3)), 0.5) == [0]


def test_similar_pairs(spark):
    x = unit_clouds(300, 4, 8, 0.1, 1)
    rows = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(300)] + [(0, 900, None), (None, 901, [1.0, 0.0, 0.0, 0.0])], "key int, id long, embedding array<double>")
    found = {(r.a, r.b) for r in blocks.similar_pairs(rows, 0.9, size=16).collect()}
    s = x @ x.T
    assert found == {(i, j) for i in range(300) for j in range(i + 1, 300) if i % 2 == j % 2 and s[i, j] > 0.9}


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7), (200, 201), (201, 202), (202, 200)]
    found = {r.id: r.component for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 95: 90, 100: 90, 200: 200, 201: 200, 202: 200}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def test_cluster_alike(spark):
    """The same clusters as linkage of the whole key."""
    x = unit_clouds(120, 5, 7, 0.3, 3)
    rows = spark.createDataFrame([(i % 2, i, x[i].tolist()) for i in range(120)], "key int, id long, embedding array<double>")
    found = defaultdict(set)
    for r in geometry.cluster_alike(rows, cut=0.45).collect():
        found[r.key, r.cluster].add(r.id)
    want = set()
    for key in range(2):
        own = np.arange(key, 120, 2)
        want |= {(key, frozenset(own[i] for i in part)) for part in as_sets(geometry.cluster_cosine(x[own], 0.45))}
    assert {(k, frozenset(v)) for (k, _), v in found.items()} == want
    assert all(c == min(v) for (_, c), v in found.items())
    with pytest.raises(ValueError, match="component"):
        geometry.cluster_alike(rows, cut=1.9, most=10)


def test_refit(spark):
    x = unit_clouds(60, 5, 5, 0.2, 4)
    protos = spark.createDataFrame([(i % 2, i, i % 13 == 0, x[i].tolist()) for i in range(60)], "source int, visit long, multi boolean, embedding array<double>")
    made = spark.createDataFrame([(i % 2, i, f"n{i % 3}", x[i].tolist()) for i in range(4)], "source int, visit long, name string, embedding array<double>")
    handled = spark.createDataFrame([(i % 2, i) for i in range(10)], "source int, visit long")
    fits, novel = identity.refit(protos, made, handled, novelty=0.6, distance=0.45)
    want, left = {}, defaultdict(list)
    for i in range(10, 60):
        if i % 13 == 0:
            continue
        s, _, via = max((float(x[i] @ x[j]), -(j % 3), j) for j in range(4) if j % 2 == i % 2)
        if s >= 0.6:
            want[i] = (f"n{via % 3}", via)
        else:
            left[i % 2].append(i)
    assert {r.visit: (r.name, r.via) for r in fits.collect()} == want
    groups = {(r.source, tuple(r.visits)): r for r in novel.collect()}
    plain = {(k, tuple(sorted(own[i] for i in part))) for k, own in left.items() for part in as_sets(geometry.cluster_cosine(x[own], 0.45))}
    assert set(groups) == plain and any(len(v) > 1 for _, v in plain)
    for (_, visits), r in groups.items():
        s = x[list(visits)] @ x[list(visits)].T
        n = len(visits)
        assert r.n == n and abs(r.cohesion - (1 if n == 1 else (s.sum() - n) / (n * (n - 1)))) < 0.006


def visit_rows(seed):
    """Two or three animals that walk through a visit, now and then boxed twice, some crops without a vector."""
    draw = np.random.default_rng(seed)
    looks = unit_clouds(3, 6, 3, 1.0, seed)
    rows, number = [], seed * 1000
    for frame in range(12):
        for animal in range(2 + seed % 2):
            if draw.random() < 0.2:
                continue
            x, y = 300 * animal + 6 * frame, 40 * animal
            v = looks[animal] + 0.15 * draw.standard_normal(6)
            for _ in range(2 if draw.random() < 0.15 else 1):
                number += 1
                seen = draw.random() > (0.2 if animal < 2 else 1.0)
                rows.append((seed, seed % 2, number, frame * (5.0 if frame < 8 else 11.0), float(x), float(y), x + 50.0, y + 50.0, float(round(draw.random(), 3)), f"n{animal}" if draw.random() < 0.1 else None, (v / np.linalg.norm(v)).tolist() if seen else None))
    return rows


def plain_unblend(rows, tracks, apart, templates, distance, threshold):
    """Groups of one visit from its tracklets, step by step."""
    by_id = {r[2]: r for r in rows}
    protos = {}
    for t, ids in tracks.items():
        best = sorted((i for i in ids if by_id[i][10] is not None), key=lambda i: (-by_id[i][8], i))[:40]
        if best:
            v = np.mean([by_id[i][10] for i in best], axis=0)
            protos[t] = v / np.linalg.norm(v)
    order = sorted(protos)
    where = {t: k for k, t in enumerate(order)}
    forbidden = {(where[a], where[b]) for a in order for b in apart[a] if b in where}
    groups = [[order[i] for i in sorted(p)] for p in plain_linkage(np.array([protos[t] for t in order]), distance, forbidden)] if order else []
    groups = sorted(groups, key=min) + [[t] for t in sorted(tracks) if t not in protos]
    out = []
    for g in groups:
        ids = [i for t in g for i in sorted(tracks[t])]
        vectors = [protos[t] for t in g if t in protos]
        middle = np.mean(vectors, axis=0) / np.linalg.norm(np.mean(vectors, axis=0)) if vectors else None
        s = np.array(vectors) @ np.array(vectors).T if vectors else None
        n = len(vectors)
        names = {by_id[i][9] for i in ids if by_id[i][9]}
        out.append({"ids": sorted(ids), "n": len(g), "cohesion": (s.sum() - n) / (n * (n - 1)) if n > 1 else 1.0, "label": names.pop() if len(names) == 1 else None, "middle": middle})
    out.sort(key=lambda g: -len(g["ids"]))
    claims = []
    for k, g in enumerate(out):
        g["ranked"] = [] if g["middle"] is None else [(n, s) for n, s in sorted(((n, max(float(g["middle"] @ v) for m, v in templates if m == n)) for n in {n for n, _ in templates}), key=lambda x: -x[1]) if s >= threshold][:5]
        claims += [(s, k, n) for n, s in g["ranked"]]
    taken = {}
    for _, k, n in sorted(claims, reverse=True):
        if k not in taken and n not in taken.values():
            taken[k] = n
    for k, g in enumerate(out):
        g["suggestions"] = [(n, round(s, 3)) for n, s in g["ranked"] if taken.get(k) == n or n not in taken.values()][:3]
    return out


def test_unblend_stills(spark):
    rows = [r for seed in range(1, 7) for r in visit_rows(seed)]
    crops = spark.createDataFrame(rows, "visit long, source int, id long, at_s double, x1 double, y1 double, x2 double, y2 double, quality double, label string, embedding array<double>")
    looks = unit_clouds(6, 6, 6, 1.0, 77)
    templates = [(s, f"n{k}", (unit_clouds(3, 6, 3, 1.0, 1 + s)[k % 3] if k < 2 else looks[k]).tolist()) for s in range(2) for k in range(4)]
    made = spark.createDataFrame(templates, "source int, name string, embedding array<double>")
    logged = spark.createDataFrame([(1, ["n0", "n1"]), (2, ["n1", "n0", "n3"]), (3, ["n2"])], "visit long, names array<string>")
    found = defaultdict(list)
    for r in identity.unblend_stills(crops, made, logged, distance=0.45, threshold=0.3).orderBy("visit", "cluster").collect():
        found[r.visit].append(r)
    tracks = defaultdict(lambda: defaultdict(list))
    apart = defaultdict(dict)
    for r in geometry.still_tracklets(crops).collect():
        tracks[r.visit][r.track].append(r.id)
        apart[r.visit][r.track] = r.apart
    parted = 0
    for visit in range(1, 7):
        want = plain_unblend([r for r in rows if r[0] == visit], tracks[visit], apart[visit], [(n, np.array(v)) for s, n, v in templates if s == visit % 2], 0.45, 0.3)
        got = found[visit]
        assert [r.ids for r in got] == [g["ids"] for g in want]
        assert [(r.n, r.n_crops, r.label) for r in got] == [(g["n"], len(g["ids"]), g["label"]) for g in want]
        assert all(abs(r.cohesion - g["cohesion"]) < 0.0051 for r, g in zip(got, want, strict=True))
        assert [[(s.name, s.similarity) for s in r.suggestions or []] for r in got] == [g["suggestions"] for g in want]
        parted += len(got)
        assert all(len(r.reps) == min(8, r.n_crops) for r in got)
        names = [r.name for r in got if r.name]
        assert len(names) == len(set(names)) and (visit in (1, 2) or not names)
    assert parted > 12


def test_unblend_edges(spark):
    schema = "visit long, source int, id long, at_s double, x1 double, y1 double, x2 double, y2 double, quality double, label string, embedding array<double>"
    made = spark.createDataFrame([], "source int, name string, embedding array<double>")
    logged = spark.createDataFrame([(1, ["a", "b"])], "visit long, names array<string>")
    two = [(1, 0, 1, 0.0, 0.0, 0.0, 9.0, 9.0, None, "a", None), (1, 0, 2, 0.0, 500.0, 0.0, 509.0, 9.0, None, None, None), (2, 0, 3, 0.0, 0.0, 0.0, 9.0, 9.0, 0.5, None, [1.0, 0.0])]
    found = identity.unblend_stills(spark.createDataFrame(two, schema), made, logged).orderBy("cluster").collect()
    assert [(r.visit, r.ids, r.n, r.label, r.name, r.suggestions) for r in found] == [(1, [1], 1, "a", "a", None), (1, [2], 1, None, "b", None)]
    assert identity.unblend_stills(spark.createDataFrame([], schema), made, logged).collect() == []
    assert found[0].cohesion == 1.0
