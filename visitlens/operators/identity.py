"""Who is it: suggestions, automatic names, elimination and the appearance of visits against confirmed templates."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.columns import is_group_label
from visitlens.operators.blocks import nearest
from visitlens.operators.geometry import cluster_alike, cluster_cosine, linkage, linked
from visitlens.operators.groups import walk_groups
from visitlens.operators.order import numbered
from visitlens.operators.profiles import top_per_group
from visitlens.operators.vectors import best_two, centroids, dot, mean_pairwise, prototypes, rank_against
from visitlens.sources.scratch import kept

NOVELTY = 0.31


def visit_prototypes(crops: DataFrame, *, min_crops: int = 3, gate: float = 0.5, top_k: int = 40) -> DataFrame:
    """(source, visit, crops, embedding) of visits with at least ``min_crops`` crops of enough quality."""
    good = crops.where(F.coalesce("quality", F.lit(0.0)) >= gate)
    n = good.groupBy("source", "visit").agg(F.count(F.lit(1)).alias("crops")).where(F.col("crops") >= min_crops)
    return prototypes(good.join(n.select("source", "visit"), ["source", "visit"], "left_semi"), ["source", "visit"], top_k=top_k).join(n, ["source", "visit"])


def templates(protos: DataFrame, labels: DataFrame, multi: DataFrame) -> DataFrame:
    """Prototypes of visits that a person named, with one animal only and no group's name. ``labels``: source, visit, name."""
    named = labels.where(~is_group_label("name"))
    return protos.join(named, ["source", "visit"]).join(multi.select("source", "visit"), ["source", "visit"], "left_anti").select("source", "visit", "name", "embedding")


def suggestions(protos: DataFrame, template_rows: DataFrame, *, k: int = 3, novelty: float = NOVELTY) -> DataFrame:
    """The ``k`` likeliest names of each visit, by its nearest template of each name at the same source, and whether all are far."""
    names = numbered(template_rows.select("name").distinct(), "name", name="tag")
    own = template_rows.join(names, "name").select(F.col("source").alias("key"), F.col("visit").alias("id"), "tag", "embedding")
    found = nearest(protos.select(F.col("source").alias("key"), F.col("visit").alias("id"), "embedding"), own, every_tag=True, others=True)
    per_name = found.join(names, "tag").select(F.col("key").alias("source"), F.col("id").cast(protos.schema["visit"].dataType).alias("probe"), "name", "similarity")
    keyed = per_name.withColumn("key", F.struct("source", "probe"))
    top = top_per_group(keyed, "key", k, F.desc("similarity"), F.col("name"))
    return top.select("source", F.col("probe").alias("visit"), "rank", "name", "similarity", (F.col("similarity") < novelty).alias("novel"))


def auto_assign(protos: DataFrame, template_rows: DataFrame, labels: DataFrame, *, threshold: float, margin: float, min_templates: int, departed: DataFrame | None = None) -> DataFrame:
    """The name each visit gets, or the first reason in a fixed order why it gets none."""
    probes = protos.select("source", F.col("visit"), "embedding", F.struct("source", "visit").alias("probe"))
    ranked = rank_against(probes, template_rows.select("source", "name", "embedding", F.col("visit").alias("other")), ["source"]).where("other <> visit")
    best = best_two(ranked)
    many = template_rows.groupBy(F.col("name").alias("best")).agg(F.count(F.lit(1)).alias("templates"))
    rows = protos.select(F.struct("source", "visit").alias("probe")).join(best, "probe", "left").join(many, "best", "left")
    rows = rows.join(labels.select(F.struct("source", "visit").alias("probe"), F.lit(True).alias("labelled")).distinct(), "probe", "left")
    gone = F.lit(False)
    if departed is not None:
        rows = rows.join(departed.select(F.lower("name").alias("__gone")).distinct(), F.lower(F.col("best").cast("string")) == F.col("__gone"), "left")
        gone = F.col("__gone").isNotNull()
    reason = (
        F.when(F.coalesce("labelled", F.lit(False)), "labelled").when(F.col("best").isNull(), "no templates").when(F.col("templates") < min_templates, "few templates")
        .when(F.col("similarity") < threshold, "unlike").when(F.col("lead") < margin, "close second").when(gone, "departed")
    )
    return rows.select("probe.source", "probe.visit", F.when(reason.isNull(), F.col("best")).alias("name"), reason.alias("reason"), "similarity", "lead")


def eliminate(sides: DataFrame) -> DataFrame:
    """(visit, side, name): where a visit's people named two animals and one side is recognised, the other side is the other name.

    ``sides``: visit, side, recognised, names (array of the visit's two names).
    """
    known = sides.where("recognised is not null").groupBy("visit").agg(F.collect_set("recognised").alias("taken"))
    rows = sides.join(known, "visit", "left")
    left = F.array_except("names", F.coalesce("taken", F.array().cast("array<string>")))
    only = F.when(F.size(left) == 1, left[0])
    return rows.select("visit", "side", F.coalesce("recognised", only).alias("name"))


def resolve_logged(groups: DataFrame, logged: DataFrame, template_rows: DataFrame, *, threshold: float = NOVELTY) -> DataFrame:
    """(visit, cluster, label, name, choices): the names that a visit's log gives, dealt to its groups, each name once.

    ``groups``: visit, cluster, n, label, embedding; ``logged``: visit, names; ``template_rows``: name, embedding, and visit
    where each visit has templates of its own. Only as many groups as names take part, the largest ones. A label claims its name; then looks decide, best first, where they
    reach ``threshold`` with the group's best logged name; one name and one group that are left go together. ``choices``
    are the names that no other group has. Visits with under two names give no rows.
    """
    logs = logged.where(F.size(F.array_distinct("names")) >= 2).select("visit", F.array_distinct("names").alias("names"))
    asked = groups.select("visit", "cluster", "embedding").join(logs, "visit").select("visit", "cluster", F.col("embedding").alias("v"), F.explode("names").alias("name"))
    on = ["visit", "name"] if "visit" in template_rows.columns else ["name"]
    likeness = asked.join(template_rows.select(*on, F.col("embedding").alias("w")), on).groupBy("visit", "cluster", "name").agg(F.max(dot("v", "w")).alias("s"))
    best = likeness.groupBy("visit", "cluster").agg(F.min(F.struct((-F.col("s")).alias("less"), "name")).alias("best"))
    rows = groups.select("visit", "cluster", "n", "label").join(logs, "visit").join(best, ["visit", "cluster"], "left")
    rows = rows.select("visit", "cluster", "n", "label", "names", (-F.col("best.less")).alias("similarity"), F.col("best.name").alias("looks"))

    def each(key: tuple, found: Iterator[tuple]) -> Iterator[tuple]:
        found = list(found)
        names = found[0][3]
        part = found[: len(names)]
        owner: dict[str, int] = {}
        for i, (_, _, label, *_) in enumerate(part):
            if label in names:
                owner.setdefault(label, i)
        sure = [(-s, i, looks) for i, (_, _, _, _, s, looks) in enumerate(part) if s is not None and s >= threshold and i not in owner.values()]
        for _, i, name in sorted(sure, key=lambda x: x[0]):
            owner.setdefault(name, i)
        left = [n for n in names if n not in owner]
        free = [i for i in range(len(part)) if i not in owner.values()]
        if len(left) == len(free) == 1:
            owner[left[0]] = free[0]
        dealt = {i: n for n, i in owner.items()}
        for i, (_, cluster, label, *_) in enumerate(found):
            yield key[0], cluster, label, dealt.get(i), [n for n in names if owner.get(n, i) == i]

    ordered = rows.select("visit", "n", "cluster", "label", "names", "similarity", "looks")
    return walk_groups(ordered, ["visit"], [F.desc("n"), "cluster"], each, "visit long, cluster long, label string, name string, choices array<string>")


def co_present_visits(pairs: DataFrame, *, limit: float = 0.45, min_frames: int = 3) -> DataFrame:
    """Visits with at least ``min_frames`` frames of two boxes apart. ``pairs``: visit, frame, iou."""
    frames = pairs.where(F.col("iou") < limit).select("visit", "frame").distinct()
    return frames.groupBy("visit").agg(F.count(F.lit(1)).alias("frames")).where(F.col("frames") >= min_frames)


def visit_groups(protos: DataFrame, *, distance: float = 0.45) -> DataFrame:
    """(key, visits, n, cohesion, multi): visits of one key that look alike, by average linkage of all of them.

    ``protos``: key, visit, multi, embedding. ``visits`` and ``multi`` (shows several animals) are in the order of the visits;
    cohesion is the mean cosine of all pairs to two digits, 1 for a lone visit. A key may have any number of visits.
    """
    rows = kept(protos.select("key", F.col("visit").alias("id"), "multi", "embedding"), "visit-groups")
    parts = kept(cluster_alike(rows, cut=distance).join(rows.drop("key"), "id"), "visit-parts")
    cohesion = mean_pairwise(parts, ["key", "cluster"]).select("key", "cluster", F.when(F.col("n") > 1, F.round("cohesion", 2)).otherwise(1.0).alias("cohesion"))
    members = F.array_sort(F.collect_list(F.struct("id", "multi")))
    made = parts.groupBy("key", "cluster").agg(members.alias("m")).join(cohesion, ["key", "cluster"])
    return made.select("key", F.col("m.id").alias("visits"), F.size("m").cast("long").alias("n"), "cohesion", F.col("m.multi").alias("multi"))


def refit(protos: DataFrame, template_rows: DataFrame, handled: DataFrame, *, novelty: float = NOVELTY, distance: float = 0.45) -> tuple[DataFrame, DataFrame]:
    """What visits that nobody named and that show one animal are: (fits, novel groups).

    ``protos``: source, visit, multi, embedding; ``handled``: source, visit of those that a person or the engine named. fits:
    source, visit, name, similarity, via, where the nearest template of the visit's own source reaches ``novelty``; the others are grouped
    within their source by ``visit_groups``.
    """
    open_ones = kept(protos.where(~F.coalesce("multi", F.lit(False))).join(handled.select("source", "visit"), ["source", "visit"], "left_anti"), "refit")
    given = numbered(template_rows.select("name", "visit", "source", "embedding"), "name", "visit", "source", name="tag")
    best = nearest(open_ones.select(F.col("source").alias("key"), F.col("visit").alias("id"), "embedding"), given.select(F.col("source").alias("key"), F.col("visit").alias("id"), "tag", "embedding"))
    best = best.where(F.col("similarity") >= novelty).join(given.select("tag", "name", F.col("visit").alias("via")), "tag")
    fits = kept(best.select(F.col("key").alias("source"), F.col("id").cast(protos.schema["visit"].dataType).alias("visit"), "name", "similarity", "via"), "fits")
    novel = open_ones.join(fits, ["source", "visit"], "left_anti").withColumnRenamed("source", "key")
    return fits, visit_groups(novel, distance=distance).withColumnRenamed("key", "source")


def unblend_stills(crops: DataFrame, template_rows: DataFrame, logged: DataFrame, *, distance: float = 0.45, threshold: float = NOVELTY, link_gap_s: float = 20.0, top_k: int = 40) -> DataFrame:
    """The animals of each visit, parted by its crops; a row a group, the one with most crops first.

    ``crops``: visit, source, id, at_s, x1, y1, x2, y2, quality, label, embedding (null where a crop has no vector);
    ``template_rows``: source, name, embedding; ``logged``: visit, names. Crops become tracklets, whose prototypes are
    joined by average linkage, but never two that were seen in one frame; a tracklet without any vector stays alone.
    Returns visit, cluster, ids, n (tracklets), n_crops, cohesion (to two digits; 1 for less than two vectors), reps (the eight clearest crops),
    label (the one name its crops carry, if it is one), suggestions (up to three names with their similarity from templates of the same source, a name
    that a closer group takes left out), name and choices (from the visit's log, see ``resolve_logged``; null without one).
    Visits of one tracklet have no rows. Work on a visit is bounded by its own crops.
    """

    def part(key: tuple, rows: Iterator[tuple]) -> Iterator[tuple]:
        """The groups of one visit; its crops come by time."""
        crops = list(rows)
        sources = sorted({r[1] for r in crops if r[1] is not None})
        timed = [r for r in crops if r[2] is not None]
        placed, apart = linked((r[2:7] for r in timed), link_gap_s=link_gap_s, same=0.45, touch=0.05, reach=1.0)
        if len(apart) < 2:
            return
        members: list[list[tuple]] = [[] for _ in apart]
        for k, i in placed:
            members[k].append(timed[i])
        clear = lambda r: (-(r[7] or 0.0), r[0])
        looks, voting = [], []
        for k, own in enumerate(members):
            seen = sorted((r for r in own if r[9] is not None), key=clear)[:top_k]
            if seen:
                voting.append(k)
                looks.append(unit_rows(np.array([r[9] for r in seen], float).mean(0)))
        found = {k: len(apart) + k for k in range(len(apart))}
        if voting:
            forbidden = np.array([[j in apart[i] for j in voting] for i in voting], bool)
            found |= dict(zip(voting, cluster_cosine(np.array(looks), distance, forbidden), strict=True))
        groups: dict[int, list[int]] = {}
        for k, g in found.items():
            groups.setdefault(g, []).append(k)
        look = dict(zip(voting, looks, strict=True))
        # Most crops first; then those with a look, in the order of their first tracklets.
        for cluster, (_, _, tracks) in enumerate(sorted((-sum(len(members[k]) for k in ks), g, ks) for g, ks in groups.items())):
            own = [(*clear(r)[:1], k, r[0], r[8]) for k in tracks for r in members[k]]
            labels = {r[3] for r in own if r[3] is not None and r[3] != ""}
            voices = np.array([look[k] for k in tracks if k in look])
            n, total = len(voices), voices.sum(0) if len(voices) else None
            cohesion = (float(total @ total) - n) / (n * (n - 1)) if n > 1 else None
            yield (key[0], cluster, sources, sorted(r[2] for r in own), len(tracks), len(own), cohesion, [r[2] for r in sorted(own, key=lambda r: r[:3])[:8]], labels.pop() if len(labels) == 1 else None, unit_rows(voices.mean(0)).tolist() if n else None)

    kind = crops.schema["source"].dataType.simpleString()
    at_s = F.when(~F.isnan(F.col("at_s").cast("double")), F.col("at_s").cast("double")).alias("at_s")
    given = crops.select(
        F.col("visit").cast("long").alias("visit"), F.col("id").cast("long").alias("id"), "source", at_s, *(F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2", "quality")), "label", "embedding"
    )
    schema = f"visit long, cluster long, sources array<{kind}>, ids array<long>, n long, n_crops long, cohesion double, reps array<long>, label string, embedding array<double>"
    groups = walk_groups(given, ["visit"], ["at_s", "id"], part, schema)
    groups = kept(groups.withColumn("cohesion", F.coalesce(F.round("cohesion", 2), F.lit(1.0))), "unblend-groups")
    key = ["visit", "cluster"]
    seen = groups.where("embedding is not null").select(*key, F.explode("sources").alias("source"), "embedding")
    found = groups.drop("embedding", "sources").join(exclusive_names(seen, template_rows, threshold=threshold), key, "left")
    of_visits = groups.select("visit", F.explode("sources").alias("source")).distinct()
    own_templates = logged.select("visit").join(of_visits, "visit").join(template_rows, "source").select("visit", "name", "embedding")
    named = resolve_logged(groups.select("visit", "cluster", F.col("n_crops").alias("n"), "label", "embedding"), logged, own_templates, threshold=threshold)
    return found.join(named.select("visit", "cluster", "name", "choices"), key, "left")


def unit_rows(v: np.ndarray) -> np.ndarray:
    """A vector at length 1; zeros stay."""
    size = np.sqrt(v @ v)
    return v / size if size > 0 else np.zeros_like(v)


def exclusive_names(groups: DataFrame, template_rows: DataFrame, *, threshold: float, most: int = 5, shown: int = 3) -> DataFrame:
    """(visit, cluster, suggestions): the names each group resembles; within a visit the closest claim takes a name, and a group one name.

    ``groups``: visit, cluster, source, embedding. A group keeps the name it took and those that nobody took.
    """
    pairs = groups.select("visit", "cluster", "source", F.col("embedding").alias("v")).join(template_rows.select("source", "name", F.col("embedding").alias("w")), "source")
    per_name = pairs.groupBy("visit", "cluster", "name").agg(F.max(dot("v", "w")).alias("similarity")).where(F.col("similarity") >= threshold)
    near = top_per_group(per_name.withColumn("group", F.struct("visit", "cluster")), "group", most, F.desc("similarity"), F.col("name")).select("visit", "cluster", "name", "similarity")

    def claim(key: tuple, pairs: Iterator[tuple]) -> Iterator[tuple]:
        pairs = list(pairs)
        owner: dict[str, int] = {}
        taken: set[int] = set()
        for _, cluster, name in pairs:
            if name not in owner and cluster not in taken:
                owner[name] = cluster
                taken.add(cluster)
        held: dict[int, list[dict]] = {}
        for similarity, cluster, name in pairs:
            if owner.get(name, cluster) == cluster:
                held.setdefault(cluster, []).append({"name": name, "similarity": round(similarity, 3)})
        return ((key[0], cluster, names[:shown]) for cluster, names in sorted(held.items()))

    ordered = near.select("visit", "similarity", "cluster", "name")
    return walk_groups(ordered, ["visit"], [F.desc("similarity"), "cluster", "name"], claim, "visit long, cluster long, suggestions array<struct<name string, similarity double>>")


def pose_groups(crops: DataFrame, *, distance: float = 0.35, most: int = 400, least: int = 3) -> DataFrame:
    """(name, pose, n, cohesion, reps, first, last): alike crops among the ``most`` clearest of each name, the largest group first.

    ``crops``: name, id, quality, at, embedding (unit vectors); ``reps`` are the eight clearest, ``first`` and ``last`` the times.
    Groups of fewer than ``least`` crops are left out. A task keeps its own best of each name before they are moved.
    """
    clear = top_per_group(crops.where("embedding is not null"), "name", most, F.desc(F.coalesce("quality", F.lit(0.0))), F.col("id"))
    kind, at_kind = (crops.schema[c].dataType.simpleString() for c in ("name", "at"))

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("rank").reset_index(drop=True)
        x = np.stack(pdf["embedding"].to_numpy()).astype(float)
        found = pd.Series(cluster_cosine(x, distance))
        out = []
        for k, own in found.groupby(found):
            n, s = len(own), x[own.index] @ x[own.index].T
            if n >= least:
                rows = pdf.loc[own.index]
                out.append((-n, k, round(float(s.sum() - n) / (n * (n - 1)), 2), rows["id"].head(8).tolist(), rows["at"].min(), rows["at"].max()))
        out.sort(key=lambda g: g[:2])
        return pd.DataFrame([(pdf["name"].iloc[0], i, -g[0], *g[2:]) for i, g in enumerate(out)], columns=["name", "pose", "n", "cohesion", "reps", "first", "last"])

    return clear.select("name", "id", "rank", "at", "embedding").groupBy("name").applyInPandas(each, f"name {kind}, pose long, n long, cohesion double, reps array<long>, first {at_kind}, last {at_kind}")


def template_pool(visits: DataFrame, template_rows: DataFrame) -> DataFrame:
    """(source, visit, pool, names): how many templates a visit may be ranked against, and of how many names: those of its own source only."""
    pools = template_rows.groupBy("source").agg(F.count(F.lit(1)).alias("pool"), F.count_distinct("name").alias("names"))
    return visits.join(pools, "source", "left").select("source", "visit", F.coalesce("pool", F.lit(0)).cast("long").alias("pool"), F.coalesce("names", F.lit(0)).cast("long").alias("names"))


def fold_centroids(tracklets: DataFrame, source: object = None) -> DataFrame:
    """(name, tracklets, embedding): the unit mean of each name's tracklets (source, name, embedding), of one source where one is given."""
    rows = tracklets if source is None else tracklets.where(F.col("source") == F.lit(source))
    return centroids(rows, ["name"]).join(rows.groupBy("name").agg(F.count(F.lit(1)).alias("tracklets")), "name").select("name", "tracklets", "embedding")


def unblend_clips(tracklets: DataFrame, *, distance: float = 0.45) -> DataFrame:
    """(visit, cluster, n): the tracklets of each visit's clips (visit, id, embedding: unit vectors) by looks, the largest group first.

    Visits of one tracklet have no rows. Groups of equal size go by their first tracklet.
    """
    several = tracklets.groupBy("visit").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("visit")
    parts = linkage(tracklets.join(several, "visit", "left_semi"), ["visit"], cut=distance)
    sizes = parts.groupBy("visit", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    ranked = sizes.groupBy("visit").agg(F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "first", "n"))).alias("g"))
    return ranked.select("visit", F.posexplode("g").alias("cluster", "x")).select("visit", F.col("cluster").cast("long").alias("cluster"), "x.n")
