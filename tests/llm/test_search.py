"""Lexical search, hard negatives and top-k against plain versions, with all edge cases."""

from __future__ import annotations

import math
import os
import re
from collections import Counter
from pathlib import Path

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from visitlens.llm import covertree, hardneg, lexical, queries, vectors

from .brute import low

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


@pytest.mark.parametrize("name", ["op11_lexical_search", "op12_hard_negatives", "op13_top_k"])
def test_sql(spark, name):
    con = duckdb.connect()
    for p in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = con.execute(f"SELECT * FROM ({queries.ORACLE_SQL[name]})")
    columns = [c[0] for c in want.description]
    found = queries.QUERIES[name](spark, SF).select(columns)
    assert sorted(map(tuple, found.collect())) == sorted(want.fetchall())
    assert [t for _, t in found.dtypes if t not in ("bigint", "int")] == []


def ranked(docs, items, k):
    """Plain scores: docs are (doc_id, text) and items (item_id, text)."""
    counted = [(i, Counter(TERM.findall(low(t or "")))) for i, t in docs]
    n_docs, length, df = sum(bool(c) for _, c in counted), sum(sum(c.values()) for _, c in counted), Counter(w for _, c in counted for w in c)
    wanted = {}
    for i, t in items:
        wanted.setdefault(i, set()).update(TERM.findall(low(t or "")))
    out = set()
    for item, words in wanted.items():
        scores = []
        for i, c in counted:
            m = 10 + (90 * sum(c.values()) * n_docs) // max(1, length)
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words if w in c)
            scores.append((-s, (i is None, i), i))
        out |= {(item, r + 1, i, -s) for r, (s, _, i) in enumerate(sorted(x for x in scores if x[0] < 0)[:k])}
    return out


def test_lexical_random(spark):
    """Small chunks, blocks and seeds, so that bounds decide; copies make ties."""
    draw = np.random.default_rng(3)
    word = lambda: f"w{int(draw.zipf(1.3)) % 300}"
    docs = [(i, " ".join(word() for _ in range(draw.integers(0, 40)))) for i in range(400)]
    docs += [(1000 + i, docs[i % 7][1]) for i in range(60)]
    items = [(i, " ".join(word() for _ in range(draw.integers(1, 12)))) for i in range(30)]
    d, q = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    for more in ({"chunk_rows": 16, "seeds": 2, "centres": 3}, {"items_at_once": 15, "sample_rows": 5}):
        found = [tuple(r) for r in lexical.rank_documents(d.repartition(5), q, **more).collect()]
        assert len(found) == len(set(found))
        assert set(found) == ranked(docs, items, 10)


def test_lexical_skips():
    """A block is skipped by its bound, and one whose documents only tie with a larger id is too."""
    own, terms = np.arange(4).repeat(2), np.array([7, 8, 7, 8, 7, 9, 7, 9])
    chunk = lexical.Chunk(np.array([10, 11, 12, 13]), own, terms, np.array([9, 50, 9, 50, 5, 50, 5, 50]), block=2)
    top = lexical.Top(1, 0)
    assert lexical.search_chunk(chunk, np.arange(4), np.array([7]), np.array([7]), top) == 2
    assert top.rows == [(-9, 10, 0)]
    assert top.behind(9, 11) and not top.behind(9, 9) and top.behind(0, -1)


def test_lexical_blocks_bound_their_documents():
    draw = np.random.default_rng(5)
    m = draw.integers(0, 5, (200, 30)) * (draw.random((200, 30)) < 0.3)
    own, terms = np.nonzero(m)
    chunk = lexical.Chunk(np.arange(200), own, terms, m[own, terms], block=8)
    for column in range(len(chunk.columns)):
        blocks = chunk.blocks(column)
        assert sorted(np.concatenate([b[0] for b in blocks]).tolist()) == np.flatnonzero(chunk.impacts[:, column]).tolist()
        assert all((chunk.impacts[docs] <= summary).all() and len(docs) <= 16 for docs, summary, _ in blocks)


def test_lexical_edges(spark):
    docs = [(1, "alpha beta"), (1, "alpha"), (None, "alpha beta"), (2, None), (3, ""), (4, "ALPHA, Beta!"), (5, "é-ß 7"), (6, "x " * 50_000 + "alpha"), (1, "alpha beta"), (7, "...")]
    items = [(1, "alpha"), (1, "beta"), (None, "ß alpha"), (3, ""), (4, None), (5, "nowhere"), (1, "alpha")]
    d = spark.createDataFrame([(*r, "s", 1, "c", 5) for r in docs], "doc_id long, text string, score string, rank int, item_id string, n int")
    q = spark.createDataFrame([(*r, 1, "t") for r in items], "item_id long, text string, doc_id int, terms string")
    found = [tuple(r) for r in lexical.rank_documents(d, q).collect()]
    assert sorted(found, key=str) == sorted(ranked_rows(docs, items), key=str)
    for dd, qq in ((d.limit(0), q), (d, q.limit(0)), (d.where("text is null"), q)):
        assert lexical.rank_documents(dd, qq).collect() == []
        assert lexical.rank_documents(dd, qq).columns == ["item_id", "rank", "doc_id", "score"]


def ranked_rows(docs, items):
    """As ``ranked``, for ids that repeat."""
    numbered = ranked([((d is None, d or 0, k), t) for k, (d, t) in enumerate(docs)], items, 10)
    return [(i, r, None if key[0] else key[1], s) for i, r, key, s in numbered]


def integers(rows):
    return [(i, label, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, label, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]


def product(a, b):
    n = min(len(a), len(b))
    return int(a[:n] @ b[:n])


def plain_top(rows, k, asks):
    rows, out = integers(rows), set()
    greatest = {}
    for i, _, v in rows:
        if asks(i):
            greatest[i] = max(greatest.get(i, []), v.tolist())
    for q, v in greatest.items():
        scores = sorted({(-product(np.array(v), x), i) for i, _, x in rows if i != q})
        out |= {(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])}
    return out


def plain_negatives(rows, asks, positives=5, negatives=3):
    rows = integers([r for r in rows if r[1] is not None])
    greatest, out = {}, set()
    for i, label, v in rows:
        if asks(i):
            greatest[i] = max(greatest.get(i, (-1, [])), (label, v.tolist()))
    for a, (label, v) in greatest.items():
        scores = lambda same: sorted({(-product(np.array(v), x), i) for i, other, x in rows if i != a and (other == label) == same})  # noqa: E731, B023
        for ps, p in scores(True)[:positives]:
            fits = [(s, i) for s, i in scores_of_others(rows, v, label) if 50 * -ps <= 100 * -s <= 95 * -ps]
            out |= {(a, p, r + 1, i, -ps, -s) for r, (s, i) in enumerate(fits[:negatives])}
    return out


def scores_of_others(rows, v, label):
    return sorted({(-product(np.array(v), x), i) for i, other, x in rows if other != label})


def table(spark, rows):
    return spark.createDataFrame([(i, label, None if v is None else [None if x is None else float(x) for x in v], "x", 1, 2.0) for i, label, v in rows], "vec_id long, label int, embedding array<double>, score string, cell int, vec double")


def clouds(n, width, seed, spread=0.05):
    draw = np.random.default_rng(seed)
    middles = draw.standard_normal((6, width))
    return [(i, int(draw.integers(0, 3)), (middles[i % 6] + spread * draw.standard_normal(width)).tolist()) for i in range(n)]


def test_top_k_random(spark):
    for width, more in ((2, {"rows_per_cell": 40, "group_rows": 5}), (8, {"rows_per_cell": 60, "group_rows": 8, "sample_rows": 50})):
        rows = clouds(300, width, width)
        found = covertree.top_k(table(spark, rows), k=5, queries=F.col("vec_id") % 10 == 0, **more).collect()
        assert {tuple(r) for r in found} == plain_top(rows, 5, lambda i: i % 10 == 0)
        assert len(found) == len(set(found))


def test_negatives_random(spark):
    for width, more in ((2, {"rows_per_cell": 40, "group_rows": 5}), (8, {"rows_per_cell": 60, "group_rows": 8, "sample_rows": 50})):
        rows = clouds(300, width, width, spread=0.3)
        found = hardneg.hard_negatives(table(spark, rows), anchors=F.col("vec_id") % 10 == 0, **more).collect()
        want = plain_negatives(rows, lambda i: i % 10 == 0)
        assert {tuple(r) for r in found} == want and want
        assert len(found) == len(set(found))


EDGES = [
    (0, 1, [0.5, 0.5]), (0, 1, [0.5, 0.5]), (0, 2, [0.1, 0.9]), (1, 1, [0.5, 0.5]), (1, 1, [0.5, 0.5]), (2, 1, [0.5]), (3, 2, []), (4, None, [1.0, 1.0]), (5, 2, None), (6, 2, [None, 1.0]),
    (7, 2, [math.nan, 1.0]), (8, 2, [math.inf, 1.0]), (None, 1, [0.3, 0.3]), (9, 2, [0.4, 0.4]), (10, 1, [-0.5, -0.5]), (11, 2, [0.3, 0.3]), (12, 2, [0.4, 0.4]), (13, 3, [0.0, 0.0]), (20, 3, [0.0, 0.0]),
]


def test_vector_edges(spark):
    t = table(spark, EDGES)
    asks = F.col("vec_id") % 10 == 0
    for more in ({"rows_per_cell": 6, "group_rows": 1},):
        assert {tuple(r) for r in covertree.top_k(t, k=5, queries=asks, **more).collect()} == plain_top(EDGES, 5, lambda i: i % 10 == 0)
        assert {tuple(r) for r in hardneg.hard_negatives(t, anchors=asks, **more).collect()} == plain_negatives(EDGES, lambda i: i % 10 == 0)
    for empty in (t.where("vec_id = 5"), t.where("vec_id = 3"), t.where("vec_id = 20")):
        assert covertree.top_k(empty, k=5, queries=asks).collect() == []
        assert hardneg.hard_negatives(empty, anchors=asks).collect() == []
    huge = table(spark, [(0, 1, [1e15, 1.0]), (1, 1, [1e15, 2.0])])
    with pytest.raises(Exception, match="64 bits"):
        covertree.top_k(huge, k=1, queries=asks).collect()


def test_copies(spark):
    """A third of the rows are one vector: ties go by id over many blocks."""
    rows = clouds(200, 4, 9) + [(1000 + i, 1, [1.0, 2.0, 0.0, 0.5]) for i in range(120)]
    t = table(spark, rows)
    found = covertree.top_k(t, k=5, queries=F.col("vec_id") % 10 == 0, rows_per_cell=40, group_rows=8).collect()
    assert {tuple(r) for r in found} == plain_top(rows, 5, lambda i: i % 10 == 0)
    found = hardneg.hard_negatives(t, anchors=F.col("vec_id") % 10 == 0, rows_per_cell=40, group_rows=8).collect()
    assert {tuple(r) for r in found} == plain_negatives(rows, lambda i: i % 10 == 0)


def test_cover_tree_invariants():
    points = np.floor(256 * np.random.default_rng(1).standard_normal((500, 2))).astype(np.int64)
    order, nodes = covertree.cover_tree(points, leaf=4)
    assert sorted(order.tolist()) == list(range(500)) and len(nodes) > 20
    p = points[order].astype(float)
    for n in nodes:
        own = np.sqrt(((p[n["start"] : n["end"]] - p[n["centre"]]) ** 2).sum(1))
        assert n["start"] <= n["centre"] < n["end"] and abs(own.max() - n["radius"]) < 1e-6
        children = nodes[n["first"] : n["last"]]
        assert not len(children) or (children["radius"] <= n["radius"] / 2 + 1e-6).all()
        centres = p[children["centre"]]
        apart = vectors.distances(centres, centres) + 1e9 * np.eye(len(centres))
        assert not len(children) or apart.min() > n["radius"] / 2 - 1e-3


def test_trees_prune():
    """On clouds both searches score a small part of all pairs, and find what all pairs give."""
    rows = clouds(2000, 3, 4)
    x = np.array([v for *_, v in integers(rows)])
    ids, q = np.arange(2000), x[::50]
    order, nodes = covertree.cover_tree(x)
    q_order, q_nodes = covertree.cover_tree(q, leaf=4)
    best = covertree.Best(ids[::50][q_order], np.full(len(q), vectors.NEVER), 5)
    scored = covertree.dual_search(best, q[q_order], q_nodes, x[order], nodes, ids[order], step=64)
    all_pairs = q[q_order] @ x.T
    all_pairs[np.arange(len(q)), ids[::50][q_order]] = vectors.NEVER
    assert (np.sort(all_pairs, 1)[:, -5:][:, ::-1] == best.scores).all()
    assert scored < 0.5 * all_pairs.size
    order, *tree = hardneg.build_tree(x, leaf=16)
    floor = np.full(len(q), 300_00.0)
    found = set()
    scored = hardneg.window_search(q, x[order], tuple(tree), lambda own: (floor[own], floor[own] + 5000), lambda own, s, at: found.update((int(a), int(i)) for a, i in zip(*np.nonzero((s >= 30000) & (s <= 35000)), strict=True) for a, i in [(own[a], order[at][i])]))
    want = {(int(a), int(i)) for a, i in zip(*np.nonzero((q @ x.T >= 30000) & (q @ x.T <= 35000)), strict=True)}
    assert found == want and scored < 0.5 * all_pairs.size


@pytest.mark.parametrize("values", [[[1, -2]], [[40_000, 0]], [[1 << 40, -5]], [[]]])
def test_pack(values):
    m = np.array(values, np.int64)
    assert vectors.unpack(vectors.pack(m)).tolist() == m.tolist()
