"""Hard negatives by exact window search in a multiway hyperplane tree.

At each node of the tree a few split points part the rows by which of them is nearest, and every split point stores the
range of its distances to each sibling's rows. A window of scores is an annulus of distances around an anchor, by the
range of lengths below a node; a sibling is dropped if, for any split point, the range of distances that the triangle
inequality leaves between the anchor and its rows misses the annulus. Leaves are scanned exactly. The root's split points
are fitted on a bounded sample and deal all rows to cells; each block of a cell goes on with a tree of its own, kept with it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import vectors as V
from .shared import batches, discard, write_table

#: Children are first to last; ``at`` is the first of the node's split points and of its square of ranges.
NODE = np.dtype([("start", "<i4"), ("end", "<i4"), ("first", "<i4"), ("last", "<i4"), ("points", "<i4"), ("ranges", "<i4"), ("least", "<f8"), ("most", "<f8")])


def split_points(p: np.ndarray, most: int) -> np.ndarray:
    """Positions of at most ``most`` rows far from each other; fewer if the rest are equal to one of them."""
    chosen = [int(((p - p.mean(0)) ** 2).sum(1).argmax())]
    near = ((p - p[chosen[0]]) ** 2).sum(1)
    while len(chosen) < most and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, ((p - p[chosen[-1]]) ** 2).sum(1))
    return np.array(chosen)


def build_tree(points: np.ndarray, *, degree: int = 8, leaf: int = 64) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(order, nodes, split points by position in the order, ranges): node i holds the rows order[start:end].

    ranges[n.ranges + i * m + j] is the (least, most) distance of the node's split point i to the rows of its child j, of m.
    """
    p, order = points.astype(np.float64), np.arange(len(points))
    squares = (p * p).sum(1)
    nodes, splits, ranges, i = [[0, len(p), 0, 0, 0, 0, 0.0, 0.0]], [], [], 0
    while i < len(nodes):
        start, end = nodes[i][:2]
        at = order[start:end].copy()
        nodes[i][6:] = [squares[at].min(initial=np.inf), squares[at].max(initial=0)]
        if end - start > leaf:
            chosen = split_points(p[at], degree)
            if len(chosen) > 1:
                d = V.distances(p[at], p[at[chosen]])
                owner = d.argmin(1)
                by = np.argsort(owner, kind="stable")
                order[start:end], d, owner = at[by], d[by], owner[by]
                cuts = np.searchsorted(owner, np.arange(len(chosen) + 1))
                nodes[i][2:6] = [len(nodes), len(nodes) + len(chosen), len(splits), len(ranges)]
                splits += at[chosen].tolist()
                parts = [d[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
                ranges += [(c[:, k].min(initial=np.inf), c[:, k].max(initial=-np.inf)) for k in range(len(chosen)) for c in parts]
                nodes += [[int(start + a), int(start + b), 0, 0, 0, 0, 0.0, 0.0] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        i += 1
    where = np.empty(len(p), np.int64)
    where[order] = np.arange(len(p))
    return order, np.array([tuple(n) for n in nodes], NODE), where[np.array(splits, np.int64)].astype("<i4"), np.array(ranges, "<f8").reshape(-1, 2)


def missed(d: np.ndarray, low: np.ndarray, high: np.ndarray, square: np.ndarray, least: np.ndarray, most: np.ndarray, floor: np.ndarray, top: np.ndarray) -> np.ndarray:
    """Which of the children (columns) the window of each anchor (rows) surely misses.

    ``d``: distances of the anchors to the split points; ``low`` and ``high`` (split point, child): ranges of distances;
    ``least`` and ``most``: squares of lengths in each child; ``floor`` and ``top``: the scores of each window.
    """
    room = 1e-6 * (1 + d.max(initial=0))
    outer = np.sqrt(np.maximum(square[:, None] + most[None, :] - 2 * floor[:, None], 0)) + room
    inner = np.sqrt(np.maximum(square[:, None] + least[None, :] - 2 * top[:, None], 0)) - room
    nearest = np.maximum(d[:, :, None] - high[None], low[None] - d[:, :, None]).max(1)
    furthest = (d[:, :, None] + high[None]).min(1)
    return (nearest > outer) | (furthest < inner) | (square[:, None] + most[None, :] < 2 * floor[:, None])


def window_search(anchors: np.ndarray, data: np.ndarray, tree: tuple, windows: Callable, offer: Callable) -> int:
    """Call ``offer(anchors, scores, rows)`` for all leaves that the windows may meet; ``windows(anchors)`` says (floor, top)
    and may rise while rows come in. ``data`` is in the order of the tree. Returns the pairs scored."""
    nodes, splits, ranges = tree
    anchors, data = V.same_width(anchors, data)
    a, p = anchors.astype(np.float64), data.astype(np.float64)
    square, scored = (a * a).sum(1), 0
    todo = [(0, np.arange(len(a)))]
    while todo:
        n, own = todo.pop()
        node = nodes[n]
        m = node["last"] - node["first"]
        if not len(own) or node["start"] == node["end"]:
            continue
        if not m:
            offer(own, V.products(anchors[own], data[node["start"] : node["end"]]), slice(node["start"], node["end"]))
            scored += len(own) * (node["end"] - node["start"])
            continue
        at = splits[node["points"] : node["points"] + m]
        square_of = ranges[node["ranges"] : node["ranges"] + m * m].reshape(m, m, 2)
        d = V.distances(a[own], p[at])
        below = nodes[node["first"] : node["last"]]
        floor, top = windows(own)
        gone = missed(d, square_of[:, :, 0], square_of[:, :, 1], square[own], below["least"], below["most"], floor, top)
        # The child whose split point is nearest to the anchors comes first, so that floors rise early.
        for j in np.argsort(-d.mean(0), kind="stable"):
            todo.append((int(node["first"] + j), own[~gone[:, j]]))
    return scored


class Lists:
    """The best k distinct (score, id) of each slot."""

    def __init__(self, slots: int, k: int):
        self.k, self.scores, self.ids = k, np.full((slots, k), V.NEVER), np.full((slots, k), np.iinfo(np.int64).max)

    def add(self, slots: np.ndarray, scores: np.ndarray, ids: np.ndarray) -> None:
        if not len(slots):
            return
        touched = np.unique(slots)
        r = np.concatenate([slots, np.repeat(touched, self.k)])
        s = np.concatenate([scores, self.scores[touched].ravel()])
        i = np.concatenate([ids, self.ids[touched].ravel()])
        by = np.lexsort([i, ~s, r])
        r, s, i = r[by], s[by], i[by]
        fresh = np.ones(len(by), bool)
        fresh[1:] = (np.diff(r) != 0) | (np.diff(s) != 0) | (np.diff(i) != 0)
        fresh |= s == V.NEVER
        r, s, i = r[fresh], s[fresh], i[fresh]
        rank = np.arange(len(r)) - np.searchsorted(r, r)
        kept = rank < self.k
        self.scores[r[kept], rank[kept]], self.ids[r[kept], rank[kept]] = s[kept], i[kept]


def hard_negatives(
    df: DataFrame,
    *,
    anchors: Column,
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    rows_per_cell: int = 2048,
    most_cells: int = 256,
    sample_rows: int = 4096,
    group_rows: int = 256,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Scores are products of 256-fold, floored components, the higher first, equal ones by the smaller id. An anchor (a row of
    ``df`` for which ``anchors`` holds) has its first ``positives`` other rows of its label as positives; for each of them
    the first ``negatives`` rows of other labels with low * positive <= 100 * negative <= high * positive are returned. An anchor without positives, and a
    positive without negatives, has no row. Rows with a null id, label or vector, or with a null or non-finite component, take
    no part; shorter vectors end with zeros. Rows that repeat id, label and vector count once; an id on several different
    rows can be found by each of them, and asks with the greatest (label, vector). Scores beyond 64 bits raise an error.
    The root's split points are fitted on ``sample_rows`` rows, all rows are indexed; the driver and each task hold at most
    ``most_cells`` split points and the square of their ranges.
    """
    spark = df.sparkSession
    labelled = df.withColumn("__label", (F.col("label") if label is None else label).cast("long")).where("__label is not null")
    named = lambda d: V.integer_vectors(d, id_col, vector_col, F.col("__label").alias("label"))
    data = named(labelled)
    asked = named(labelled.where(anchors)).groupBy("id").agg(F.max(F.struct("label", "vec")).alias("x")).select("id", "x.label", "x.vec")
    with batches(spark, rows=4096, size="16m"):
        n = data.count()
        drawn = V.sample(data, sample_rows, n)
        centres = drawn[split_points(drawn.astype(float), max(1, min(most_cells, n // rows_per_cell)))] if len(drawn) else np.zeros((1, 0), np.int64)
        tables = [V.dealt(data, centres, "negative-data"), V.dealt(asked, centres, "negative-anchors")]

        def index(ids: np.ndarray, labels: np.ndarray, m: np.ndarray, cell: int) -> dict[str, object]:
            order, nodes, splits, ranges = build_tree(m)
            d = V.distances(m, centres)
            return {
                "ids": ids[order].astype("<i8").tobytes(), "labels": labels[order].astype("<i8").tobytes(), "vecs": V.pack(m[order]), "nodes": nodes.tobytes(), "splits": splits.tobytes(),
                "ranges": ranges.tobytes(), "low": d.min(0).tolist(), "high": d.max(0).tolist(), "least": float(nodes["least"][0]), "most": float(nodes["most"][0]),
            }

        def gather(ids: np.ndarray, labels: np.ndarray, m: np.ndarray, cell: int) -> dict[str, object]:
            return {"q_ids": ids.astype("<i8").tobytes(), "q_labels": labels.astype("<i8").tobytes(), "q_vecs": V.pack(m)}

        schema = "ids binary, labels binary, vecs binary, nodes binary, splits binary, ranges binary, low array<double>, high array<double>, least double, most double"
        held = V.blocks(tables[0], n, rows_per_cell, index, schema, "negative-blocks")
        groups = V.blocks(tables[1], tables[1].count(), group_rows, gather, "q_ids binary, q_labels binary, q_vecs binary", "negative-groups")
        groups = groups.withColumnRenamed("block", "group").withColumnRenamed("cell", "q_cell")
        root = _root(held, centres)
        home = groups.join(held.groupBy(F.col("cell").alias("q_cell")).agg(F.min("block").alias("block")), "q_cell").select("group", "block")
        data_blocks = held.drop("cell", "low", "high", "least", "most")

        same = _same_label(positives)
        first = V.searched(home, groups.withColumn("slots", F.lit(None).cast("binary")), data_blocks, same, FOUND, "negative-first")
        floors = _slots(groups, first, positives)
        units = _units(floors, held, root, high=None, low=None).join(home, ["group", "block"], "left_anti")
        units = write_table(units, "negative-units")
        rest = V.searched(units, floors, data_blocks, same, FOUND, "negative-rest")
        chosen = write_table(_ranked(first.unionByName(rest).distinct(), ["anchor_id"], positives), "negative-positives")
        wanted = _slots(groups, chosen, positives)
        pairs = write_table(_units(wanted, held, root, high=high, low=low), "negative-pairs")
        near = V.searched(pairs, wanted, data_blocks, _other_label(positives, negatives, low, high), NEAR, "negative-near")
        best = _ranked(near.distinct(), ["anchor_id", "positive_id", "positive_score"], negatives)
        result = best.select("anchor_id", "positive_id", "rank", F.col("found_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        result = write_table(result, "negative-result")
    discard(*tables, held, groups, first, floors, units, rest, chosen, wanted, pairs, near)
    return result


FOUND = "anchor_id long, found_id long, score long"
NEAR = "anchor_id long, positive_id long, positive_score long, found_id long, score long"


def _ranked(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "found_id"))).where(F.col("rank") <= k)


def _root(held: DataFrame, centres: np.ndarray) -> dict[str, np.ndarray]:
    """The root's node: for its split points the ranges to the rows of each cell, over all blocks; at most cells^2 numbers."""
    m = len(centres)
    low, high, least, most = np.full((m, m), np.inf), np.full((m, m), -np.inf), np.full(m, np.inf), np.full(m, -np.inf)
    by_split = held.select("cell", F.posexplode(F.arrays_zip("low", "high")).alias("split", "range"))
    for r in by_split.groupBy("cell", "split").agg(F.min("range.low").alias("low"), F.max("range.high").alias("high")).collect():
        low[r["split"], r["cell"]], high[r["split"], r["cell"]] = r["low"], r["high"]
    for r in held.groupBy("cell").agg(F.min("least").alias("least"), F.max("most").alias("most")).collect():
        least[r["cell"]], most[r["cell"]] = r["least"], r["most"]
    return {"centres": centres, "low": low, "high": high, "least": least, "most": most}


def _slots(groups: DataFrame, found: DataFrame, k: int) -> DataFrame:
    """``groups`` with ``slots``: the first k (score, id) found for each anchor, in the order of the group's anchors."""
    best = _ranked(found.drop("rank"), ["anchor_id"], k).groupBy("anchor_id").agg(F.collect_list(F.struct("rank", "score", "found_id")).alias("best"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for group, data in zip(b.column("group").to_pylist(), b.column("q_ids").to_pylist(), strict=True):
                own = np.frombuffer(data, "<i8")
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), group)), pa.array(np.arange(len(own), dtype=np.int32)), pa.array(own)], ["group", "at", "anchor_id"])

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        lists = np.empty((len(pdf), k, 2), "<i8")
        lists[:, :, 0], lists[:, :, 1] = V.NEVER, np.iinfo(np.int64).max
        for at, best in zip(pdf["at"], pdf["best"], strict=True):
            for x in [] if best is None else best:
                lists[at, x["rank"] - 1] = x["score"], x["found_id"]
        return pd.DataFrame({"group": pdf["group"].iloc[:1], "slots": [lists.tobytes()]})

    listed = groups.select("group", "q_ids").mapInArrow(anchors, "group long, at int, anchor_id long").join(best, "anchor_id", "left")
    return write_table(groups.join(listed.groupBy("group").applyInPandas(joined, "group long, slots binary"), "group"), "negative-slots")


def _windows(positive: np.ndarray, low: int, high: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and greatest score in the window of each positive score; those of none, or below zero, are empty."""
    some = positive >= 0
    p = np.where(some, positive, 0)
    return np.where(some, -(-low * p // 100), 1), np.where(some, high * p // 100, 0)


def _units(groups: DataFrame, held: DataFrame, root: dict[str, np.ndarray], *, low: int | None, high: int | None) -> DataFrame:
    """(group, block) of the cells that the ranges at the root leave for a group's windows."""

    def left(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                vectors = V.unpack(row["q_vecs"])
                slots = np.frombuffer(row["slots"], "<i8").reshape(len(vectors), -1, 2)[:, :, 0]
                if low is None:
                    floor, top, some = slots[:, -1].astype(float), np.full(len(slots), np.inf), np.ones(len(slots), bool)
                    floor[slots[:, -1] == V.NEVER] = -np.inf
                else:
                    lows, highs = _windows(slots, low, high)
                    some = (lows <= highs).any(1)
                    floor, top = np.where(lows <= highs, lows, np.inf).min(1), np.where(lows <= highs, highs, -np.inf).max(1)
                vectors, floor, top = vectors[some], floor[some], top[some]
                keep = np.zeros(0, np.int64)
                if len(vectors):
                    square = (vectors.astype(float) ** 2).sum(1)
                    gone = missed(V.distances(vectors, root["centres"]), root["low"], root["high"], square, root["least"], root["most"], floor, top)
                    keep = np.flatnonzero(~gone.all(0) & (root["most"] >= 0))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(keep), row["group"])), pa.array(keep, pa.int32())], ["group", "cell"])

    return groups.mapInArrow(left, "group long, cell int").join(held.select("cell", "block"), "cell").select("group", "block")


def _opened(row: dict) -> tuple:
    """A pair's anchors (ids, labels, vectors), its block (ids, labels, vectors) and the block's tree."""
    numbers = lambda c: np.frombuffer(row[c], "<i8")
    tree = np.frombuffer(row["nodes"], NODE), np.frombuffer(row["splits"], "<i4"), np.frombuffer(row["ranges"], "<f8").reshape(-1, 2)
    return numbers("q_ids"), numbers("q_labels"), V.unpack(row["q_vecs"]), numbers("ids"), numbers("labels"), V.unpack(row["vecs"]), tree


def _same_label(k: int):
    """The best k rows of each anchor's label in a block that reach the anchor's k-th so far."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids, q_labels, q, ids, labels, x, tree = _opened(row)
                known = np.full(len(q), V.NEVER) if row["slots"] is None else np.frombuffer(row["slots"], "<i8").reshape(len(q), k, 2)[:, -1, 0]
                best = Lists(len(q), k)

                def windows(own: np.ndarray, best=best, known=known) -> tuple[np.ndarray, np.ndarray]:
                    floor = np.maximum(best.scores[own, -1], known[own])
                    return np.where(floor == V.NEVER, -np.inf, floor), np.full(len(own), np.inf)

                def offer(own: np.ndarray, scores: np.ndarray, at: slice, best=best, known=known, q_ids=q_ids, q_labels=q_labels, ids=ids, labels=labels) -> None:
                    fits = (q_labels[own][:, None] == labels[at][None]) & (q_ids[own][:, None] != ids[at][None])
                    r, c = np.nonzero(fits & (scores >= np.maximum(best.scores[own, -1], known[own])[:, None]))
                    best.add(own[r], scores[r, c], ids[at][c])

                window_search(q, x, tree, windows, offer)
                r, c = np.nonzero(best.scores > V.NEVER)
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[r]), pa.array(best.ids[r, c]), pa.array(best.scores[r, c])], ["anchor_id", "found_id", "score"])

    return search


def _other_label(k: int, most: int, low: int, high: int):
    """For each positive of each anchor the best rows of other labels of a block inside its window."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for row in b.to_pylist():
                q_ids, q_labels, q, ids, labels, x, tree = _opened(row)
                slots = np.frombuffer(row["slots"], "<i8").reshape(len(q), k, 2)
                lows, highs = _windows(slots[:, :, 0], low, high)
                best = Lists(len(q) * k, most)

                def floors(own: np.ndarray, best=best, lows=lows) -> np.ndarray:
                    return np.maximum(lows[own], best.scores[:, -1].reshape(-1, k)[own])

                def windows(own: np.ndarray, floors=floors, highs=highs) -> tuple[np.ndarray, np.ndarray]:
                    floor, top = floors(own), highs[own]
                    return np.where(floor <= top, floor, np.inf).min(1), np.where(floor <= top, top, -np.inf).max(1)

                def offer(own: np.ndarray, scores: np.ndarray, at: slice, floors=floors, best=best, highs=highs, q_labels=q_labels, ids=ids, labels=labels) -> None:
                    other = q_labels[own][:, None] != labels[at][None]
                    floor = floors(own)
                    for j in range(k):
                        r, c = np.nonzero(other & (scores >= floor[:, j, None]) & (scores <= highs[own][:, j, None]))
                        best.add(own[r] * k + j, scores[r, c], ids[at][c])

                window_search(q, x, tree, windows, offer)
                r, c = np.nonzero(best.scores > V.NEVER)
                a, j = r // k, r % k
                found = [q_ids[a], slots[a, j, 1], slots[a, j, 0], best.ids[r, c], best.scores[r, c]]
                yield pa.RecordBatch.from_arrays([pa.array(f.astype(np.int64)) for f in found], ["anchor_id", "positive_id", "positive_score", "found_id", "score"])

    return search
