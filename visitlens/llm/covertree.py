"""Exact top-k by inner product with a dual-tree search over cover trees.

Queries and data are indexed together: one cover tree of a bounded sample deals both to cells, whose members are cut into
blocks of data and groups of queries, each with a cover tree of its own (a node's children cover it at half its radius).
A pair of nodes is dropped if no query below the one can have a product with a row below the other that reaches the worst
k-th score of those queries: with centres c, d, covering radii r, s and distance t, products are at most
c.d + r|d| + s|c| + rs and at most (max |q|^2 + max |x|^2 - max(0, t - r - s)^2) / 2. Bounds of a cell come from all its rows.
A first search of one block of each group's own cell gives the k-th scores with which the pairs of cells are pruned.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .shared import batches, discard, write_table

NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("centre", "<i4"), ("first", "<i4"), ("last", "<i4"), ("radius", "<f8"), ("norm", "<f8")])


def cover_tree(points: np.ndarray, *, leaf: int = 32, base: float = 2.0) -> tuple[np.ndarray, np.ndarray]:
    """(order, nodes) of a cover tree; node i holds the rows order[start:end], the children of a node are first to last.

    Children are centred on rows of their parent, its own centre first, further ones in order of their distance; they cover
    it at its radius over ``base`` and are further apart than that. A node that only more than an eighth of its rows would
    cover stays a leaf.
    """
    p, order = points.astype(np.float64), np.arange(len(points))
    norms = np.sqrt((p * p).sum(1))
    nodes = [[0, len(p), 0, 0, 0, 0.0, 0.0]]
    i = 0
    while i < len(nodes):
        start, end, centre = nodes[i][:3]
        at = order[start:end].copy()
        own = p[at]
        near = np.sqrt(((own - p[centre]) ** 2).sum(1)) if len(at) else np.zeros(0)
        radius = near.max(initial=0.0)
        nodes[i][5:] = [radius, norms[at].max(initial=0.0)]
        if end - start > leaf and radius > 0:
            centres, owner, reach = [centre], np.zeros(len(at), np.int64), radius / base
            while near.max() > reach and len(centres) <= (end - start) // 8:
                far = at[near.argmax()]
                d = np.sqrt(((own - p[far]) ** 2).sum(1))
                closer = d < near
                owner[closer], near = len(centres), np.minimum(near, d)
                centres.append(far)
            if near.max() <= reach:
                by = np.argsort(owner, kind="stable")
                order[start:end] = at[by]
                cuts = start + np.searchsorted(owner[by], np.arange(len(centres) + 1))
                nodes[i][3:5] = [len(nodes), len(nodes) + len(centres)]
                nodes += [[int(a), int(b), int(c), 0, 0, 0.0, 0.0] for a, b, c in zip(cuts[:-1], cuts[1:], centres, strict=True)]
        i += 1
    where = np.empty(len(p), np.int64)
    where[order] = np.arange(len(p))
    found = np.array([tuple(n) for n in nodes], NODE)
    if len(p):
        found["centre"] = where[found["centre"]]
    return order, found


def cells(points: np.ndarray, most: int) -> np.ndarray:
    """Centres of at most ``most`` nodes that cover the tree of a sample: the widest is opened as long as there is room."""
    if not len(points):
        return np.zeros((1, points.shape[1]), np.int64)
    order, nodes = cover_tree(points)
    front = [0]
    while True:
        wide = [n for n in front if nodes["last"][n] > nodes["first"][n] and len(front) + nodes["last"][n] - nodes["first"][n] - 1 <= most]
        if not wide:
            break
        n = max(wide, key=lambda n: nodes["radius"][n])
        front.remove(n)
        front += range(nodes["first"][n], nodes["last"][n])
    if len(front) < min(most, len(points)) and len(front) < 2:
        return points[np.linspace(0, len(points) - 1, min(most, len(points))).astype(int)]
    return points[order[nodes["centre"][front]]]


class Best:
    """The best k (score, id) of each query so far, and the score that another one must reach."""

    def __init__(self, ids: np.ndarray, floor: np.ndarray, k: int):
        self.ids, self.floor, self.k = ids, floor, k
        self.scores = np.full((len(ids), k), V.NEVER)
        self.found = np.full((len(ids), k), np.iinfo(np.int64).max)

    def worst(self, rows: np.ndarray) -> np.ndarray:
        return np.maximum(self.scores[rows, -1], self.floor[rows])

    def offer(self, rows: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        """``scores`` of the queries ``rows`` with rows of the given ids; a query's own id doesn't count."""
        scores = np.where(self.ids[rows][:, None] == ids[None, :], V.NEVER, scores)
        need = self.worst(rows)
        r, c = np.nonzero((scores >= need[:, None]) & (scores > V.NEVER))
        if not len(r):
            return
        touched = np.unique(r)
        all_r = np.concatenate([r, np.repeat(touched, self.k)])
        all_s = np.concatenate([scores[r, c], self.scores[rows[touched]].ravel()])
        all_i = np.concatenate([ids[c], self.found[rows[touched]].ravel()])
        by = np.lexsort([all_i, ~all_s, all_r])
        all_r, all_s, all_i = all_r[by], all_s[by], all_i[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (np.diff(all_r) != 0) | (np.diff(all_s) != 0) | (np.diff(all_i) != 0)
        fresh |= all_s == V.NEVER
        all_r, all_s, all_i = all_r[fresh], all_s[fresh], all_i[fresh]
        rank = np.arange(len(all_r)) - np.searchsorted(all_r, all_r)
        keep = rank < self.k
        at = rows[all_r[keep]], rank[keep]
        self.scores[at], self.found[at] = all_s[keep], all_i[keep]


def most_product(c: np.ndarray, r: float, q_norm: float, centres: np.ndarray, lengths: np.ndarray, s: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """What a product of a point within ``r`` of ``c`` (of length ``q_norm`` at most) with one below each node can be at most."""
    size, dot = np.sqrt(c @ c), centres @ c
    apart = np.sqrt(np.maximum(size**2 + lengths**2 - 2 * dot, 0))
    metric = (q_norm**2 + norms**2 - np.maximum(0, apart - r - s) ** 2) / 2
    return np.minimum(dot + r * lengths + s * size + r * s, metric) + 1 + 1e-9 * (size + r) * (lengths + s)  # room for rounding


def dual_search(best: Best, queries: np.ndarray, q_nodes: np.ndarray, data: np.ndarray, nodes: np.ndarray, ids: np.ndarray, *, step: int = 1024) -> int:
    """Offer to ``best`` all rows that may still enter; both sides are in the order of their trees. Returns the pairs scored."""
    queries, data = V.same_width(queries, data)
    q, x = queries.astype(np.float64), data.astype(np.float64)
    centre, length = x[nodes["centre"]], np.sqrt((x[nodes["centre"]] ** 2).sum(1))
    scored = 0

    def bounds(n: int, at: np.ndarray) -> np.ndarray:
        own = q_nodes[n]
        return most_product(q[own["centre"]], own["radius"], own["norm"], centre[at], length[at], nodes["radius"][at], nodes["norm"][at])

    def scan(n: int, at: np.ndarray) -> None:
        nonlocal scored
        rows = np.arange(q_nodes["start"][n], q_nodes["end"][n])
        most = bounds(n, at)
        by = np.argsort(-most, kind="stable")
        at, most, i = at[by], most[by], 0
        while i < len(at) and most[i] >= best.worst(rows).min():
            taken, size = [], 0
            while i < len(at) and (not taken or size + nodes["end"][at[i]] - nodes["start"][at[i]] <= step):
                taken.append(np.arange(nodes["start"][at[i]], nodes["end"][at[i]]))
                size, i = size + len(taken[-1]), i + 1
            some = np.concatenate(taken)
            best.offer(rows, V.products(queries[rows], data[some]), ids[some])
            scored += len(rows) * len(some)

    def visit(n: int, at: np.ndarray) -> None:
        while True:
            rows = np.arange(q_nodes["start"][n], q_nodes["end"][n])
            at = at[bounds(n, at) >= best.worst(rows).min()]
            if not len(at):
                return
            inner = at[nodes["last"][at] > nodes["first"][at]]
            children = range(q_nodes["first"][n], q_nodes["last"][n])
            if not len(inner) and not len(children):
                return scan(n, at)
            at = np.concatenate([at[nodes["last"][at] <= nodes["first"][at]], *(np.arange(nodes["first"][i], nodes["last"][i]) for i in inner)])
            if len(children):
                for child in children:
                    visit(child, at)
                return None

    if len(q) and len(x):
        visit(0, np.zeros(1, np.int64))
    return scored


def top_k(
    df: DataFrame, *, k: int, queries: Column, id_col: str = "vec_id", vector_col: str = "embedding", rows_per_cell: int = 2048, most_cells: int = 1024, sample_rows: int = 4096, group_rows: int = 512
) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the ``k`` other rows with the highest products of 256-fold, floored components.

    ``queries`` is a condition on ``df``. Equal scores go by the smaller id; a query with fewer other rows has all of them.
    Rows with a null id or vector, or with a null or non-finite component, take no part; shorter vectors end with zeros, an
    empty one is zero. Rows that repeat id and vector count once; an id with several vectors is found by each of them, and
    asks with the greatest. Other columns are not read. Scores beyond 64 bits raise an error. The tree over cells is fitted
    on ``sample_rows`` rows that a hash of the id draws, all rows are indexed; the driver and each task hold
    at most ``most_cells`` centres.
    """
    spark = df.sparkSession
    data = V.integer_vectors(df, id_col, vector_col).withColumn("label", F.lit(None).cast("long"))
    asked = V.integer_vectors(df.where(queries), id_col, vector_col).groupBy("id").agg(F.max("vec").alias("vec")).withColumn("label", F.lit(None).cast("long"))
    with batches(spark, rows=4096, size="16m"):
        n = data.count()
        centres = cells(V.sample(data, sample_rows, n), max(1, min(most_cells, n // rows_per_cell)))
        tables = [V.dealt(data, centres, "cover-data"), V.dealt(asked, centres, "cover-queries")]

        def index(ids: np.ndarray, labels: np.ndarray, m: np.ndarray, cell: int) -> dict[str, object]:
            order, nodes = cover_tree(m)
            far = V.distances(m, centres[cell][None]).max(initial=0.0)
            return {"ids": ids[order].astype("<i8").tobytes(), "vecs": V.pack(m[order]), "tree": nodes.tobytes(), "radius": float(far), "norm": float(nodes["norm"][0]), "n": len(ids)}

        schema = "ids binary, vecs binary, tree binary, radius double, norm double, n int"
        held = V.blocks(tables[0], n, rows_per_cell, index, schema, "cover-blocks")
        groups = V.blocks(tables[1], tables[1].count(), group_rows, index, schema, "cover-groups")
        groups = groups.select(F.col("block").alias("group"), F.col("cell").alias("q_cell"), *(F.col(c).alias(f"q_{c}") for c in ("ids", "vecs", "tree", "radius", "norm", "n")))
        home = groups.join(held.groupBy(F.col("cell").alias("q_cell")).agg(F.min("block").alias("block")), "q_cell").select("group", "block")
        free = groups.withColumn("floor", F.lit(b""))
        first = V.searched(home, free, held, _search(k), FOUND, "cover-first")
        floor = _floors(groups, first, k)
        spans = held.groupBy("cell").agg(F.max("radius").alias("radius"), F.max("norm").alias("norm"))
        wanted = write_table(floor.mapInArrow(_cells_left(centres, spans), "group long, cell int"), "cover-wanted")
        units = wanted.join(held.select("cell", "block"), "cell").select("group", "block").join(home, ["group", "block"], "left_anti")
        units = write_table(units, "cover-units")
        rest = V.searched(units, floor, held, _search(k), FOUND, "cover-rest")
        ranked = first.unionByName(rest).distinct()
        by = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        result = write_table(ranked.withColumn("rank", by).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score"), "cover-result")
    discard(*tables, held, groups, first, floor, wanted, units, rest)
    return result


FOUND = "query_id long, vec_id long, score long"


def _search(k: int):
    """Search each row's group in its block."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids = np.frombuffer(row["q_ids"], "<i8")
                floor = np.frombuffer(row["floor"], "<i8") if row["floor"] else np.full(len(q_ids), V.NEVER)
                best = Best(q_ids, floor, k)
                dual_search(best, V.unpack(row["q_vecs"]), np.frombuffer(row["q_tree"], NODE), V.unpack(row["vecs"]), np.frombuffer(row["tree"], NODE), np.frombuffer(row["ids"], "<i8"))
                r, c = np.nonzero(best.scores > V.NEVER)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(best.found[r, c]), pa.array(best.scores[r, c])], ["query_id", "vec_id", "score"])

    return search


def _floors(groups: DataFrame, first: DataFrame, k: int) -> DataFrame:
    """``groups`` with the k-th score that each query has from the first search (none: the least integer), in the order of its queries."""
    kth = first.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).where(F.size("s") >= k).select("query_id", F.element_at("s", k).alias("kth"))

    def ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, data in zip(b.column("group").to_pylist(), b.column("q_ids").to_pylist(), strict=True):
                own = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["group", "at", "query_id"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("at")
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "floor": [pdf["kth"].to_numpy(np.int64).astype("<i8").tobytes()]})

    listed = groups.select("group", "q_ids").mapInArrow(ids, "group long, at int, query_id long")
    listed = listed.join(kth, "query_id", "left").withColumn("kth", F.coalesce("kth", F.lit(V.NEVER)))
    floor = listed.groupBy("group").applyInPandas(joined, "group long, floor binary")
    return write_table(groups.join(floor, "group"), "cover-floors")


def _cells_left(centres: np.ndarray, spans: DataFrame):
    """The cells that each group may have to search: their nodes' bounds against the group's worst k-th score."""
    known = {r["cell"]: (r["radius"], r["norm"]) for r in spans.collect()}
    cell = np.array(sorted(known), np.int64)
    radii, norms = np.array([known[c] for c in cell], float).reshape(-1, 2).T
    middle = centres[cell].astype(np.float64)
    length = np.sqrt((middle**2).sum(1))

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                most = most_product(centres[row["q_cell"]].astype(np.float64), row["q_radius"], row["q_norm"], middle, length, radii, norms)
                keep = cell[most >= np.frombuffer(row["floor"], "<i8").min()]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), row["group"])), pa.array(keep, pa.int32())], ["group", "cell"])

    return left
