"""Evaluation: confusion, calibration, ranking quality, thresholds, leave-one-out and operating points."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.operators.blocks import Gather, over_pairs, packed

#: Bin edges as a linear spacing makes them; three of them lie just above the decimal they stand for.
EDGES = [i * 0.1 for i in range(11)]


def confusion(rows: DataFrame) -> DataFrame:
    return rows.groupBy("y_true", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def precision_recall(rows: DataFrame) -> DataFrame:
    """Support, precision, recall and F1 by label; 0 where undefined."""
    both = confusion(rows)
    hit = both.where("y_true = y_pred").select(F.col("y_true").alias("label"), F.col("n").alias("tp"))
    true = both.groupBy(F.col("y_true").alias("label")).agg(F.sum("n").alias("support"))
    pred = both.groupBy(F.col("y_pred").alias("label")).agg(F.sum("n").alias("predicted"))
    joined = true.join(pred, "label", "full").join(hit, "label", "left").fillna(0)
    share = lambda a, b: F.when(b > 0, a / b).otherwise(0.0)
    p, r = share(F.col("tp"), F.col("predicted")), share(F.col("tp"), F.col("support"))
    return joined.select("label", "support", p.alias("precision"), r.alias("recall"), share(2 * p * r, p + r).alias("f1"))


def bin_of(x: Column | str, edges: list[float] = EDGES) -> Column:
    """The bin that holds ``x``; the last one is closed."""
    x = F.col(x) if isinstance(x, str) else x
    return F.least(F.size(F.filter(F.array(*map(F.lit, edges)), lambda e: e <= x)) - 1, F.lit(len(edges) - 2)).cast("long")


def reliability(rows: DataFrame) -> DataFrame:
    return rows.groupBy(bin_of("confidence").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("confidence"), F.avg("correct").alias("accuracy"))


def calibration_error(rows: DataFrame) -> DataFrame:
    bins = reliability(rows)
    return bins.agg((F.sum(F.col("n") * F.abs(F.col("confidence") - F.col("accuracy"))) / F.sum("n")).alias("ece"))


def curve(rows: DataFrame) -> DataFrame:
    """Counts above each distinct score, highest first. Scores are counted before they are ordered, and ordered by range."""
    counts = rows.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") != 1).alias("neg"))
    return running(counts, "score", ["pos", "neg"], descending=True)


def running(counts: DataFrame, by: str, sums: list[str], *, descending: bool = False, bins: int = 1024) -> DataFrame:
    """Running sums over distinct values of a number without one task for all: sums within bins, carried over from bin to bin."""
    edge = counts.agg(F.min(by).alias("lo"), F.max(by).alias("hi"))
    width = F.greatest((F.col("hi") - F.col("lo")) / bins, F.lit(1e-300))
    binned = counts.crossJoin(F.broadcast(edge)).withColumn("__bin", F.least(F.floor((F.col(by) - F.col("lo")) / width), F.lit(bins - 1))).drop("lo", "hi")
    order = (lambda c: F.desc(c)) if descending else (lambda c: F.asc(c))
    totals = binned.groupBy("__bin").agg(*(F.sum(s).alias(f"__{s}") for s in sums))
    earlier = Window.orderBy(order("__bin")).rowsBetween(Window.unboundedPreceding, -1)  # ``bins`` rows at most
    totals = totals.select("__bin", *(F.coalesce(F.sum(f"__{s}").over(earlier), F.lit(0)).alias(f"__{s}") for s in sums))
    inside = Window.partitionBy("__bin").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return binned.join(totals, "__bin").select(*counts.columns, *((F.sum(s).over(inside) + F.col(f"__{s}")).alias(f"cum_{s}") for s in sums))


def roc_auc(rows: DataFrame) -> DataFrame:
    """Mann-Whitney with average ranks for ties; 0.5 where a class is empty."""
    c = curve(rows)
    below = F.col("cum_neg") - F.col("neg")  # negatives with a higher score
    total = c.agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"), F.sum(F.col("pos") * (below + F.col("neg") / 2.0)).alias("lost"))
    return total.select(F.when((F.col("p") == 0) | (F.col("n") == 0), 0.5).otherwise(1 - F.col("lost") / (F.col("p") * F.col("n"))).alias("auc"))


def best_threshold(rows: DataFrame) -> DataFrame:
    """The threshold of the largest Youden index; the lowest of equal ones."""
    total = rows.agg(F.count_if(F.col("label") == 1).alias("p"), F.count_if(F.col("label") != 1).alias("n"))
    j = F.col("cum_pos") / F.greatest("p", F.lit(1)) - F.col("cum_neg") / F.greatest("n", F.lit(1))
    rated = curve(rows).crossJoin(F.broadcast(total)).select("score", F.round(j, 12).alias("youden"))
    best = rated.agg(F.min(F.struct((-F.col("youden")).alias("less"), "score")).alias("x"))
    return best.select(F.col("x.score").alias("threshold"), (-F.col("x.less")).alias("youden"))


def majority(rows: DataFrame, label: str = "label") -> DataFrame:
    """The most common label (the greatest of equal ones), its share, and the share of an even guess."""
    n = rows.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    out = n.agg(F.max(F.struct("n", label)).alias("x"), F.sum("n").alias("total"), F.count(F.lit(1)).alias("labels"))
    return out.select(F.col(f"x.{label}").alias("answer"), (F.col("x.n") / F.col("total")).alias("share"), (1 / F.col("labels")).alias("even"))


def leave_one_out(pairs: DataFrame) -> DataFrame:
    """Top name of each probe over ``pairs`` (probe, truth, night, name, name_night, similarity).

    Pairs of a probe with itself are left out by the caller; a template of the same name and night doesn't count.
    """
    fair = pairs.where(~((F.col("truth") == F.col("name")) & (F.col("night") == F.col("name_night"))))
    return answers(fair.groupBy("probe", "truth", "name").agg(F.max("similarity").alias("similarity")))


def answers(best: DataFrame) -> DataFrame:
    """Top name of each probe, its similarity and its lead over the next, from (probe, truth, name, similarity)."""
    top = best.groupBy("probe", "truth").agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), "name"))), 1, 2).alias("t"))
    second = F.when(F.size("t") > 1, -F.col("t")[1]["less"]).otherwise(0.0)
    return top.select("probe", "truth", F.col("t")[0]["name"].alias("answer"), (-F.col("t")[0]["less"]).alias("similarity"), (-F.col("t")[0]["less"] - second).alias("lead"))


#: Every other template; those but of the same name and night; with a number, also those at least so many days away.
FREE, BLOCKED = "free", "blocked"


def name_scores(units: DataFrame, *, embargoes: tuple[int, ...] = (), size: int = 256) -> DataFrame:
    """(probe, truth, rule, name, similarity): the best template of each name for each probe, under all rules at once.

    ``units``: probe, truth (a number below 2^31), day (since 1970), v: each is a probe and a template of its name. Rules are
    ``FREE``, ``BLOCKED`` and each of ``embargoes`` as text (blocked, and more than so many days apart). Products are made in
    blocks; a task goes with a tile of probes through all templates, and only the best of each name leaves it.
    """
    rows = units.select(F.lit(0).alias("key"), F.col("probe").alias("id"), (F.shiftleft(F.col("truth").cast("long"), 32) + F.col("day")).alias("tag"), F.col("v").alias("embedding"))

    rules = (FREE, BLOCKED, *map(str, embargoes))

    def best(probes: dict, templates: dict, s: np.ndarray) -> tuple[np.ndarray, list[np.ndarray]]:
        by = np.argsort(templates["tags"], kind="stable")
        name, day, s = templates["tags"][by] >> 32, templates["tags"][by] & 0xFFFFFFFF, s[:, by]
        starts = np.flatnonzero(np.r_[True, np.diff(name) != 0])
        truth, own = probes["tags"] >> 32, probes["tags"] & 0xFFFFFFFF
        other = probes["ids"][:, None] != templates["ids"][by][None]
        apart = np.abs(own[:, None] - day[None])
        fair = other & ~((truth[:, None] == name[None]) & (apart == 0))
        masks = (other, fair, *(fair & (apart > d) for d in embargoes))
        return name[starts], [np.maximum.reduceat(np.where(m, s, -np.inf), starts, axis=1) for m in masks]

    class Best(Gather):
        """The best of each name for the probes of a tile, over all templates."""

        def __init__(self):
            self.held: dict[int, tuple[dict, dict[int, np.ndarray]]] = {}

        def add(self, x: dict, y: dict, found: tuple) -> Iterator[pd.DataFrame]:
            own = self.held.setdefault(x["block"], (x, {}))[1]
            for j, name in enumerate(found[0].tolist()):
                new = np.stack([top[:, j] for top in found[1]])
                own[name] = np.maximum(own[name], new) if name in own else new
            return iter(())

        def close(self) -> Iterator[pd.DataFrame]:
            for x, own in self.held.values():
                truth = x["tags"] >> 32
                for name, top in own.items():
                    r, i = np.nonzero(top > -np.inf)
                    yield pd.DataFrame({"probe": x["ids"][i], "truth": truth[i], "rule": np.array(rules, object)[r], "name": name, "similarity": top[r, i]})

    return over_pairs(packed(rows, size=size), best, "probe long, truth long, rule string, name long, similarity double", gather=Best, directed=True)


def right_ones(scores: DataFrame) -> DataFrame:
    """(rule, probes, right_ones): how many probes have an answer under each rule, and the right one."""
    top = scores.groupBy("rule", "probe", "truth").agg(F.min_by("name", F.struct((-F.col("similarity")).alias("less"), "name")).alias("answer"))
    return top.groupBy("rule").agg(F.count(F.lit(1)).alias("probes"), F.count_if(F.col("answer") == F.col("truth")).alias("right_ones"))


def sweep(probes: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """Assigned and wrong probes at each threshold and margin.

    A probe is assigned wherever both bounds lie at or below it, so probes are counted by the last threshold and the
    last margin that they meet (a table of the grid's size at most) and the counts are added up over the grid.
    """
    at = lambda x, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col(x))) - 1
    cells = probes.select(at("similarity", thresholds).alias("t"), at("lead", margins).alias("m"), (F.col("answer") != F.col("truth")).alias("wrong"))
    cells = cells.where("t >= 0 and m >= 0").groupBy("t", "m").agg(F.count(F.lit(1)).alias("assigned"), F.count_if("wrong").alias("wrong"))
    spread = cells.select(F.explode(F.sequence(F.lit(0), "t")).alias("t"), "m", "assigned", "wrong").groupBy("t", "m").agg(F.sum("assigned").alias("assigned"), F.sum("wrong").alias("wrong"))
    spread = spread.select("t", F.explode(F.sequence(F.lit(0), "m")).alias("m"), "assigned", "wrong").groupBy("t", "m").agg(F.sum("assigned").alias("assigned"), F.sum("wrong").alias("wrong"))
    value = lambda i, grid: F.element_at(F.array(*map(F.lit, grid)), F.col(i) + 1)
    return spread.select(value("t", thresholds).alias("threshold"), value("m", margins).alias("margin"), "assigned", "wrong")


def select_point(swept: DataFrame) -> DataFrame:
    """Of the points without error the one that assigns most, then the strictest."""
    best = swept.where("wrong = 0").agg(F.min(F.struct((-F.col("assigned")).alias("less"), (-F.col("threshold")).alias("t"), (-F.col("margin")).alias("m"))).alias("x"))
    return best.where("x is not null").select((-F.col("x.t")).alias("threshold"), (-F.col("x.m")).alias("margin"), (-F.col("x.less")).alias("assigned"))


def forward_replay(units: DataFrame, *, threshold: float, margin: float, horizon_days: float | None = None) -> DataFrame:
    """Replays visits in time order, by source: each is named from the visits before it, by person or machine.

    ``units``: source, key, at_s, truth, by_human, embedding. A visit named by a person is a template from then on; one
    named by the machine too, a step deeper than the template it came from. Whether a visit gets a name depends on all
    earlier decisions of its source, so a source is walked by one task, batch by batch; its templates are one running
    mean vector for each name, so memory grows with its names only. Rows without a source or a time are left out.
    """

    def replay(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        source, sums = None, {}
        for pdf in rows:
            out = []
            for r in pdf.itertuples():
                if r.source != source:
                    source, sums = r.source, {}
                v = np.asarray(r.embedding, float)
                live = [(float(s[0] @ v / np.linalg.norm(s[0])), n, s[1]) for n, s in sorted(sums.items()) if horizon_days is None or r.at_s - s[2] <= horizon_days * 86400]
                live.sort(key=lambda x: (-x[0], x[1]))
                lead = live[0][0] - (live[1][0] if len(live) > 1 else 0.0) if live else 0.0
                named = r.truth if r.by_human else live[0][1] if live and live[0][0] >= threshold and lead >= margin else None
                depth = 0 if r.by_human else live[0][2] + 1 if named else None
                if named is not None:
                    held = sums.get(named)
                    sums[named] = [v if held is None else held[0] + v, depth if held is None else min(held[1], depth), r.at_s]
                out.append((r.source, r.key, named, depth, named is not None and named != r.truth))
            yield pd.DataFrame(out, columns=["source", "key", "named", "depth", "wrong"])

    wanted = units.where("source is not null and at_s is not null").select("source", "key", "at_s", "truth", "by_human", "embedding")
    ordered = wanted.repartition("source").sortWithinPartitions("source", "at_s", "key")
    return ordered.mapInPandas(replay, "source long, key long, named string, depth double, wrong boolean")


def fold_table(n: int, k: int, repeats: int, seed: int) -> list[tuple[int, int, int]]:
    """(repeat, fold, position) of seeded permutations of ``n`` positions, cut in ``k`` nearly equal parts.

    ``n`` is the number of labelled probes, which people make, so the table is small; join it to numbered probes.
    """
    draw = np.random.RandomState(seed)
    return [(r, f, int(i)) for r in range(repeats) for f, part in enumerate(np.array_split(draw.permutation(n), k)) for i in part]


def held_out(probes: DataFrame, folds: DataFrame, thresholds: list[float], margins: list[float]) -> DataFrame:
    """Assigned and wrong probes of each (repeat, fold) at the point that the other folds select.

    ``probes`` has a position that ``folds`` (repeat, fold, position) deals. Counts on the other folds are those of the
    repeat less those of the fold.
    """
    dealt = probes.join(folds, "position")
    at = lambda x, grid: F.size(F.filter(F.array(*map(F.lit, grid)), lambda g: g <= F.col(x))) - 1
    wrong = F.col("answer") != F.col("truth")
    cells = dealt.select("repeat", "fold", at("similarity", thresholds).alias("t"), at("lead", margins).alias("m"), wrong.alias("wrong")).where("t >= 0 and m >= 0")
    cells = cells.groupBy("repeat", "fold", "t", "m").agg(F.count(F.lit(1)).alias("assigned"), F.count_if("wrong").alias("wrong"))
    for c in ("t", "m"):
        rest = [x for x in ("t", "m") if x != c]
        cells = cells.select("repeat", "fold", F.explode(F.sequence(F.lit(0), c)).alias(c), *rest, "assigned", "wrong").groupBy("repeat", "fold", "t", "m").agg(F.sum("assigned").alias("assigned"), F.sum("wrong").alias("wrong"))
    whole = cells.groupBy("repeat", "t", "m").agg(F.sum("assigned").alias("all_assigned"), F.sum("wrong").alias("all_wrong"))
    every = folds.select("repeat", "fold").distinct().join(whole, "repeat")
    rated = every.join(cells, ["repeat", "fold", "t", "m"], "left").fillna(0, ["assigned", "wrong"])
    train = rated.withColumn("train", F.col("all_assigned") - F.col("assigned")).where("all_wrong - wrong = 0 and all_assigned - assigned > 0")
    order = F.struct((-F.col("train")).alias("less"), (-F.col("t")).alias("u"), (-F.col("m")).alias("v"))
    best = train.groupBy("repeat", "fold").agg(F.min_by(F.struct("assigned", "wrong"), order).alias("x"))
    return folds.select("repeat", "fold").distinct().join(best, ["repeat", "fold"], "left").select(
        "repeat", "fold", F.coalesce("x.assigned", F.lit(0)).alias("assigned"), F.coalesce("x.wrong", F.lit(0)).alias("wrong")
    )
