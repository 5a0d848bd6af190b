"""Queries of scalar scores, label texts, folds and operating points."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions import columns
from visitlens.functions.columns import micros
from visitlens.operators import blocks, evaluation, geometry, identity, intervals, order, sessions, vectors
from visitlens.operators.groups import walk_groups
from visitlens.operators.profiles import top_per_group
from visitlens.plans.evaluation import GRADED, LOO, MARGINS, PAIRS, THRESHOLDS, UNITS, graded, left_out, units
from visitlens.plans.intervals import visit_clips
from visitlens.plans.profiles import named_visits
from visitlens.plans.registry import CLIPS, DET, STAMPED, VISITS, register
from visitlens.plans.vectors import DIMS
from visitlens.sources.fixtures import Tables


@register("SELECT id, upper(substr(species, 1, 1)) || substr(species, 2) || ' ' || upper(substr(individual, 1, 1)) || substr(individual, 2) AS title FROM detections", *DET)
def f3_capitalised(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.capitalised(F.concat_ws(" ", "species", "individual")).alias("title"))


@register("SELECT conv_id, turn, CAST(CASE WHEN turn % 2 = 0 THEN 2 ELSE 0 END AS BIGINT) AS names FROM conversations")
def f6_json_names(t: Tables) -> DataFrame:
    text = F.when(F.col("turn") % 2 == 0, F.lit('["a", "b"]')).otherwise(F.lit("not json"))
    return t.read("conversations").select("conv_id", "turn", F.size(columns.json_names(text)).cast("long").alias("names"))


@register("SELECT id, CAST(ts AS DATE) AS day, month(ts) AS month, hour(ts) AS hour FROM detections", *DET, dates=("day",))
def f8_date_parts(t: Tables) -> DataFrame:
    return t.detections.select("id", F.to_date("ts").alias("day"), F.month("ts").cast("long").alias("month"), F.hour("ts").cast("long").alias("hour"))


@register("SELECT source, started_at, (epoch_us(ended_at) - epoch_us(started_at)) / 1e6 AS dwell_s, n > 1 AND ended_at > started_at AS spans FROM visits", *VISITS)
def f12_dwell(t: Tables) -> DataFrame:
    dwell = F.coalesce(columns.seconds_between("started_at", "ended_at"), F.lit(0.0))
    return t.visits.select("source", "started_at", dwell.alias("dwell_s"), ((F.col("n") > 1) & (F.col("ended_at") > F.col("started_at"))).alias("spans"))


@register("SELECT id, coalesce(round((CASE WHEN k = 0 THEN 0 WHEN k / 100 <= 0.35 THEN sqrt(k / 100 / 0.35) ELSE power(0.35 / (k / 100), 0.75) END) * (0.7 + 0.3 * confidence) * CASE WHEN species = 'view' THEN 1.2 ELSE 1 END, 9), 0) AS score FROM detections", *DET)
def f19_portrait_score(t: Tables) -> DataFrame:
    score = columns.size_term(F.col("k") / 100) * (0.7 + 0.3 * F.col("confidence")) * F.when(F.col("species") == "view", 1.2).otherwise(1.0)
    return t.detections.select("id", F.round(score, 9).alias("score"))


@register("SELECT id, CASE WHEN value / 100 >= 2 AND k < 50 THEN 'fed here' WHEN k >= 50 AND confidence >= 0.5 THEN 'passed through' ELSE 'lingered' END AS tag, CASE WHEN k / 50.0 > 1.15 THEN 'approaching' WHEN k / 50.0 < 0.85 THEN 'retreating' ELSE 'steady' END AS approach FROM detections", *DET)
def f21_tags(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.behaviour_tag(F.col("value") / 100, F.col("k") / 100, "confidence").alias("tag"), columns.approach_label(F.col("k") / 50.0).alias("approach"))


FIT = """WITH v AS (SELECT v.source, v.started_at, s.species, hour(v.started_at) AS hour, (epoch_us(v.ended_at) - epoch_us(v.started_at)) / 1e6 AS dwell FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at),
    p AS (SELECT species, count(*) AS visits, list_sort(list(dwell))[count(*) // 2 + 1] AS mid, min(hour) AS a, max(hour) AS b FROM v GROUP BY species)"""


@register(
    FIT + """ SELECT v.source, v.started_at, CASE WHEN p.visits < 3 THEN 'thin' WHEN hour BETWEEN a AND b AND (dwell < 5 OR (mid > 0 AND dwell / mid BETWEEN 0.15 AND 8)) THEN 'fits' ELSE 'odd' END AS verdict FROM v JOIN p ON v.species = p.species""",
    *VISITS, "votes", "visit_species",
)
def f23_species_fit(t: Tables) -> DataFrame:
    v = named_visits(t).withColumn("hour", F.hour("started_at")).withColumn("dwell", (micros("ended_at") - micros("started_at")) / 1e6)
    p = v.groupBy("species").agg(F.count(F.lit(1)).alias("visits"), columns.upper_median("dwell").alias("mid"), F.min("hour").alias("a"), F.max("hour").alias("b"))
    like = (F.col("dwell") < 5) | ((F.col("mid") > 0) & (F.col("dwell") / F.col("mid")).between(0.15, 8))
    verdict = F.when(F.col("visits") < 3, "thin").when(columns.in_window("hour", "a", "b") & like, "fits").otherwise("odd")
    return v.join(p, "species").select("source", "started_at", verdict.alias("verdict"))


@register("SELECT id, CASE WHEN k % 4 = 0 THEN 'none' WHEN value / 20 >= 14 THEN 'lapsed' WHEN value / 20 >= 7 THEN 'fading' ELSE 'fresh' END AS state FROM detections", *DET)
def f25_lapse(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.lapse_state(F.col("value") / 20, F.col("k") % 4).alias("state"))


@register(
    """WITH b AS (SELECT source, ts, CASE WHEN k >= 50 THEN 1 ELSE 0 END AS up, lag(CASE WHEN k >= 50 THEN 1 ELSE 0 END) OVER (PARTITION BY source ORDER BY ts, id) AS before FROM detections)
    SELECT source, round(avg(up), 6) AS share, count(*) FILTER (up <> before) AS switches FROM b GROUP BY source""",
    *DET,
)
def f27_postures(t: Tables) -> DataFrame:
    """Share of upright boxes and changes of posture, in time order."""
    up = (F.col("k") >= 50).cast("int")
    rows = sessions.with_previous(t.detections.select("source", "ts", "id", up.alias("up")), "up")
    return rows.groupBy("source").agg(F.round(F.avg("up"), 6).alias("share"), F.count_if(F.col("up") != F.col("before")).alias("switches"))


@register(
    f"""WITH e AS ({DIMS}), m AS (SELECT name, dim, avg(x) AS x FROM e GROUP BY name, dim), d AS (SELECT e.vec_id, m.name, sum(e.x * m.x) AS s FROM e JOIN m ON e.dim = m.dim GROUP BY e.vec_id, m.name),
    x AS (SELECT vec_id, name, exp(10 * s) AS w FROM d) SELECT vec_id, round(max(w) / sum(w), 6) AS p FROM x GROUP BY vec_id""",
    "crops",
)
def f37_softmax_gate(t: Tables) -> DataFrame:
    """The softmax share of the likeliest of all mean vectors."""
    probes = t.crops.select(F.col("vec_id").alias("probe"), "embedding")
    s = vectors.rank_against(probes, vectors.mean_vectors(t.crops, ["name"])).withColumn("w", F.exp(10 * F.col("similarity")))
    return s.groupBy(F.col("probe").alias("vec_id")).agg(F.round(F.max("w") / F.sum("w"), 6).alias("p"))


@register("SELECT clip_id, len(range(0, detections, greatest(1, detections // 3))) AS samples FROM clips", *CLIPS)
def f40_scan_stride(t: Tables) -> DataFrame:
    """Sampled frames of a clip: a stride that keeps about three."""
    n = F.col("detections")
    return t.clips.select("clip_id", F.size(F.sequence(F.lit(0), n - 1, F.greatest(F.lit(1), F.floor(n / 3)))).cast("long").alias("samples"))


@register("WITH n AS (SELECT source, species, count(*) AS n FROM detections GROUP BY ALL) SELECT source, array_to_string(list_slice(list(species ORDER BY n DESC, species), 1, 3), ', ') AS line FROM n GROUP BY source", *DET)
def f41_species_line(t: Tables) -> DataFrame:
    n = t.detections.groupBy("source", "species").agg(F.count(F.lit(1)).alias("n"))
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), "species")))
    return n.groupBy("source").agg(F.array_join(F.slice(F.transform(order, lambda x: x["species"]), 1, 3), ", ").alias("line"))


@register("SELECT DISTINCT individual FROM detections WHERE species = 'purchase' AND individual NOT LIKE '% + %'", *DET)
def f43_live_cast(t: Tables) -> DataFrame:
    return t.detections.where("species = 'purchase'").where(~columns.is_group_label("individual")).select("individual").distinct()


@register(
    """WITH t AS (SELECT source, started_at, min(ts) AS a, max(ts) AS b, count(DISTINCT k) AS kinds FROM stamped WHERE k >= 20 GROUP BY source, started_at)
    SELECT c.clip_id, CASE WHEN c.detections >= 2 THEN 'several' WHEN count(t.source) = 0 THEN 'no visit' WHEN max(t.kinds) > 1 THEN 'mixed' ELSE 'linked' END AS outcome
    FROM clips c LEFT JOIN t ON c.source = t.source AND c.start_at <= t.b AND c.end_at >= t.a GROUP BY c.clip_id, c.detections""",
    *STAMPED, "clip_flagged", "clip_stamped", "clips",
)
def j29_link_tracks(t: Tables) -> DataFrame:
    """What becomes of each clip's track: the first reason that keeps it from a name, or linked."""
    named = t.stamped.where("k >= 20").groupBy("source", "started_at").agg(F.min("ts").alias("b0"), F.max("ts").alias("b1"), F.count_distinct("k").alias("kinds"))
    c = t.clips.select("source", "clip_id", F.col("start_at").alias("a0"), F.col("end_at").alias("a1"))
    kinds = intervals.overlap_join(c, named).groupBy("clip_id").agg(F.max("kinds").alias("kinds"))
    outcome = F.when(F.col("detections") >= 2, "several").when(F.col("kinds").isNull(), "no visit").when(F.col("kinds") > 1, "mixed").otherwise("linked")
    return t.clips.join(kinds, "clip_id", "left").select("clip_id", outcome.alias("outcome"))


@register(
    """WITH p AS (SELECT v.source, v.started_at, c.clip_id FROM visits v JOIN clips c ON v.source = c.source AND c.start_at <= v.ended_at AND c.end_at >= v.started_at)
    SELECT clip_id, min(started_at) AS started_at FROM p GROUP BY clip_id""",
    *VISITS, "clip_flagged", "clip_stamped", "clips",
)
def a46_clip_owner(t: Tables) -> DataFrame:
    return visit_clips(t).groupBy("clip_id").agg(F.min("a0").alias("started_at"))


@register("SELECT visit, round(median(quality), 6) AS trait, count(*) AS n FROM crops GROUP BY visit HAVING count(*) >= 3", "crops")
def m8_visit_traits(t: Tables) -> DataFrame:
    """The interpolated median of a trait, where three crops or more have it."""
    return t.crops.groupBy("visit").agg(F.round(F.expr("percentile(quality, 0.5)"), 6).alias("trait"), F.count(F.lit(1)).alias("n")).where("n >= 3")


# Evaluation


@register(UNITS + " SELECT probe, truth, night, round(v[1], 6) AS first FROM units", "crops", dates=("night",))
def e25_units(t: Tables) -> DataFrame:
    return units(t).select("probe", "truth", "night", F.round(F.col("v")[0], 6).alias("first"))


@register(PAIRS + " SELECT probe, count(*) AS templates, round(max(s), 6) AS best FROM pairs GROUP BY probe", "crops")
def e29_similarity(t: Tables) -> DataFrame:
    """How many templates each probe has, and the likeness of the nearest; counted and compared block by block."""
    import numpy as np
    import pandas as pd

    def each(x: dict, y: dict, s: np.ndarray) -> pd.DataFrame:
        sides = [(x["ids"], y["ids"], s)] + ([] if x["block"] == y["block"] else [(y["ids"], x["ids"], s.T)])
        apart = [(a, a[:, None] != b[None], p) for a, b, p in sides]
        return pd.concat(pd.DataFrame({"probe": a, "n": m.sum(1), "s": np.where(m, p, -2.0).max(1)}) for a, m, p in apart)

    rows = units(t).select(F.lit(0).alias("key"), F.col("probe").alias("id"), F.col("v").alias("embedding"))
    found = blocks.over_pairs(blocks.packed(rows), each, "probe long, n long, s double").where("n > 0")
    return found.groupBy("probe").agg(F.sum("n").alias("templates"), F.round(F.max("s"), 6).alias("best"))


@register(
    f"""WITH e AS ({DIMS}), s AS (SELECT name, dim, sum(x) AS s, count(*) AS n FROM e GROUP BY name, dim),
    r AS (SELECT e.vec_id, e.name AS truth, s.name, sum(e.x * (CASE WHEN e.name = s.name THEN s.s - e.x ELSE s.s END)) / nullif(sqrt(sum(power(CASE WHEN e.name = s.name THEN s.s - e.x ELSE s.s END, 2))), 0) AS sim
      FROM e JOIN s ON e.dim = s.dim GROUP BY ALL) SELECT vec_id, arg_min(name, (-sim, name)) = truth AS hit FROM r WHERE sim IS NOT NULL GROUP BY vec_id, truth""",
    "crops",
)
def e18_centroid_leave_one_out(t: Tables) -> DataFrame:
    """Sums of names without the probe, by subtracting it, so centroids are made once."""
    rows = t.crops.select("vec_id", F.col("name").alias("truth"), F.posexplode("embedding").alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    sums = rows.groupBy(F.col("truth").alias("name"), "dim").agg(F.sum("x").alias("s"))
    packed = sums.groupBy("name").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "s"))), lambda v: v["s"]).alias("s"))
    probes = t.crops.select("vec_id", F.col("name").alias("truth"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))
    rest = F.when(F.col("truth") == F.col("name"), F.zip_with("s", "v", lambda a, b: a - b)).otherwise(F.col("s"))
    both = probes.crossJoin(F.broadcast(packed)).withColumn("r", rest)  # a row per named individual
    sim = vectors.dot("v", "r") / F.nullif(F.sqrt(vectors.dot("r", "r")), F.lit(0.0))
    ranked = both.select("vec_id", "truth", "name", sim.alias("sim")).where("sim is not null")
    best = ranked.groupBy("vec_id", "truth").agg(F.min_by("name", F.struct((-F.col("sim")).alias("less"), "name")).alias("best"))
    return best.select("vec_id", (F.col("best") == F.col("truth")).alias("hit"))


FOLDS = 5


def fold_sweep(loo: DataFrame) -> DataFrame:
    """Counts of each grid point on each fold's own probes, and on the rest by subtraction from the whole."""
    parts = None
    for k in range(FOLDS):
        one = evaluation.sweep(loo.where(F.col("probe") % FOLDS == k), THRESHOLDS, MARGINS).withColumn("fold", F.lit(k))
        parts = one if parts is None else parts.unionByName(one)
    return parts


GRID_FOLDS = LOO.format(embargo="") + f""", t(threshold) AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])), g(margin) AS (SELECT unnest([{', '.join(map(str, MARGINS))}])),
    c AS (SELECT CAST(probe % {FOLDS} AS INTEGER) AS fold, CAST(threshold AS DOUBLE) AS threshold, CAST(margin AS DOUBLE) AS margin, count(*) AS assigned, count(*) FILTER (answer <> truth) AS wrong
      FROM loo JOIN t ON similarity >= CAST(threshold AS DOUBLE) JOIN g ON lead >= CAST(margin AS DOUBLE) GROUP BY ALL)"""


@register(GRID_FOLDS + " SELECT fold, threshold, margin, assigned, wrong FROM c", "crops")
def e12_fold_sweeps(t: Tables) -> DataFrame:
    return fold_sweep(left_out(t))


@register(
    LOO.format(embargo="") + f""", f AS (SELECT CAST(probe % {FOLDS} AS BIGINT) AS fold, avg(CASE WHEN similarity >= 0.3 AND lead >= 0.02 THEN 1.0 ELSE 0.0 END) AS coverage FROM loo GROUP BY ALL)
    SELECT round(min(coverage), 6) AS low, round(avg(coverage), 6) AS mean, round(max(coverage), 6) AS high FROM f""",
    "crops",
)
def e13_point_spread(t: Tables) -> DataFrame:
    hit = ((F.col("similarity") >= 0.3) & (F.col("lead") >= 0.02)).cast("double")
    f = left_out(t).groupBy((F.col("probe") % FOLDS).alias("fold")).agg(F.avg(hit).alias("coverage"))
    return f.agg(F.round(F.min("coverage"), 6).alias("low"), F.round(F.avg("coverage"), 6).alias("mean"), F.round(F.max("coverage"), 6).alias("high"))


@register(
    f"""WITH e AS ({DIMS}), m AS (SELECT name, dim, avg(x) AS x FROM e WHERE visit % 10 <> 0 GROUP BY name, dim) SELECT name, round(sqrt(sum(x * x)), 6) AS norm FROM m GROUP BY name""",
    "crops",
)
def e24_excluding_centroids(t: Tables) -> DataFrame:
    m = vectors.mean_vectors(t.crops.where("visit % 10 <> 0"), ["name"])
    return m.select("name", F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm"))


@register("WITH " + GRADED + " SELECT y_true, cut.c AS cut, count(*) FILTER (confidence >= cut.c) AS kept, count(*) FILTER (confidence >= cut.c AND correct = 0) AS wrong FROM graded CROSS JOIN (SELECT unnest([0.2, 0.5, 0.8]) AS c) cut GROUP BY y_true, cut.c".replace("cut.c AS cut", "CAST(cut.c AS DOUBLE) AS cut"), *DET)
def e28_threshold_sweep(t: Tables) -> DataFrame:
    cuts = graded(t).select("*", F.explode(F.array(F.lit(0.2), F.lit(0.5), F.lit(0.8))).alias("cut"))
    kept = F.col("confidence") >= F.col("cut")
    return cuts.groupBy("y_true", "cut").agg(F.count_if(kept).alias("kept"), F.count_if(kept & (F.col("correct") == 0)).alias("wrong"))


@register("SELECT event_id, coalesce(try_cast(json_extract_string(props, '$.missing') AS BIGINT), try_cast(json_extract_string(props, '$.k') AS BIGINT)) AS headline FROM events")
def e27_headline(t: Tables) -> DataFrame:
    """The first of several paths that holds a number."""
    first = F.coalesce(*(F.expr(f"try_cast(get_json_object(props, '$.{p}') as bigint)") for p in ("missing", "k")))
    return t.read("events").select("event_id", first.alias("headline"))


@register()
def g14_pose_groups(t: Tables) -> DataFrame:
    """The poses of each name: groups of alike crops among its clearest, the largest first."""
    found = identity.pose_groups(t.crops.select("name", F.col("vec_id").alias("id"), "quality", F.col("night").cast("string").alias("at"), vectors.unit("embedding").alias("embedding")))
    return found.withColumn("reps", F.array_join(F.transform("reps", lambda i: i.cast("string")), ","))


@register()
def g21_clusters_by_size(t: Tables) -> DataFrame:
    """Placeholder names by falling size of clusters of three crops or more, over the whole store."""
    rows = t.crops.select(F.lit(0).alias("key"), F.col("vec_id").alias("id"), vectors.unit("embedding").alias("embedding"))
    made = geometry.cluster_alike(rows, cut=0.45).groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.array_join(F.transform(F.array_sort(F.collect_list("id")), lambda i: i.cast("string")), ",").alias("ids")).where("n >= 3")
    place = order.numbered(made, F.desc("n"), F.col("cluster"))
    return place.select("cluster", "n", "ids", F.concat(F.lit("_c"), F.lpad((F.col("position") + 1).cast("string"), 2, "0")).alias("name"))


@register()
def w13_spaced_frames(t: Tables) -> DataFrame:
    """The best frames of each source and day at least an hour apart, three at most; best first. A task walks its days one after the other."""

    def each(key: tuple, frames: Iterator[tuple]) -> Iterator[tuple]:
        kept: list[float] = []
        for number, at_s in frames:
            if len(kept) < 3 and all(abs(at_s - k) >= 3600 for k in kept):
                kept.append(at_s)
                yield (*key, number)

    rows = t.detections.select("source", F.to_date("ts").cast("string").alias("day"), "id", "confidence", (micros("ts") / 1e6).alias("at_s"))
    rows = rows.withColumn("at_s", F.coalesce("at_s", F.lit(float("nan"))))
    best = walk_groups(rows, ["source", "day"], [F.desc_nulls_last("confidence"), "id"], lambda key, frames: each(key, (r[::2] for r in frames)), "source long, day string, id long")
    return best


@register("WITH b AS (SELECT source, id, confidence, least(4, CAST(floor(5 * (epoch_us(ts) - 1704067200000000) / (30 * 86400e6)) AS BIGINT)) AS bucket FROM detections WHERE k >= 20) SELECT source, bucket, arg_min(id, (-confidence, id)) AS id FROM b GROUP BY source, bucket", *DET)
def w14_review_candidates(t: Tables) -> DataFrame:
    """The best of each fifth of the month."""
    bucket = F.least(F.lit(4), F.floor(5 * (micros("ts") - 1704067200000000) / (30 * 86400e6)))
    return t.detections.where("k >= 20").groupBy("source", bucket.alias("bucket")).agg(F.min_by("id", F.struct((-F.col("confidence")).alias("w"), "id")).alias("id"))


@register("SELECT id FROM (SELECT id, k FROM detections ORDER BY k < 50, id LIMIT 80)", *DET)
def w2_priority_order(t: Tables) -> DataFrame:
    return t.detections.orderBy(F.col("k") < 50, "id").limit(80).select("id")


@register()
def w18_random_sample(t: Tables) -> DataFrame:
    """A seeded sample of 50 rows, the same however the table is dealt; the sampling is the feature."""
    return t.detections.select("id").orderBy(F.xxhash64(F.lit(7), "id"), "id").limit(50)


@register("SELECT v.source, v.started_at, sum(greatest(0, epoch_us(least(v.ended_at, c.end_at)) - epoch_us(greatest(v.started_at, c.start_at)))) / 1e6 AS filmed_s FROM visits v JOIN clips c ON v.source = c.source AND c.start_at <= v.ended_at AND c.end_at >= v.started_at GROUP BY v.source, v.started_at", *VISITS, "clip_flagged", "clip_stamped", "clips")
def f10_filmed_seconds(t: Tables) -> DataFrame:
    return visit_clips(t).groupBy("source", F.col("a0").alias("started_at")).agg(F.sum("overlap_s").alias("filmed_s"))


@register("SELECT source, started_at, arg_min(individual, (-n, f)) AS individual FROM (SELECT source, started_at, individual, count(*) AS n, min((ts, id)) AS f FROM stamped WHERE k >= 80 GROUP BY ALL) GROUP BY source, started_at", *STAMPED)
def a40_confirmed_labels(t: Tables) -> DataFrame:
    return sessions.winners(sessions.votes(t.stamped.where("k >= 80"), value="individual"), "individual").drop("margin")


@register(
    """SELECT individual, count(DISTINCT (source, started_at)) AS visits, count(DISTINCT CAST(ts AS DATE)) AS days, round(count(*) / count(DISTINCT (source, started_at)), 6) AS crops_per_visit FROM stamped GROUP BY individual""", *STAMPED
)
def a42_individual_behaviour(t: Tables) -> DataFrame:
    visits = F.count_distinct(F.struct("source", "started_at"))
    return t.stamped.groupBy("individual").agg(visits.alias("visits"), F.count_distinct(F.to_date("ts")).alias("days"), F.round(F.count(F.lit(1)) / visits, 6).alias("crops_per_visit"))


@register("SELECT d.individual, d.days, coalesce(n.templates, 0) AS templates, CASE WHEN coalesce(n.templates, 0) = 0 THEN 'none' ELSE 'some' END AS state FROM (SELECT individual, count(DISTINCT CAST(ts AS DATE)) AS days FROM detections GROUP BY individual) d LEFT JOIN (SELECT individual, count(*) AS templates FROM detections WHERE species = 'purchase' AND k >= 50 GROUP BY individual) n ON d.individual = n.individual", *DET)
def a43_roll_call_lapse(t: Tables) -> DataFrame:
    """Names without a template have the state none."""
    days = t.detections.groupBy("individual").agg(F.count_distinct(F.to_date("ts")).alias("days"))
    n = t.detections.where("species = 'purchase' and k >= 50").groupBy("individual").agg(F.count(F.lit(1)).alias("templates"))
    count = F.coalesce("templates", F.lit(0))
    return days.join(n, "individual", "left").select("individual", "days", count.alias("templates"), F.when(count == 0, "none").otherwise("some").alias("state"))


@register()
def e23_held_out_points(t: Tables) -> DataFrame:
    """Points chosen on four folds of five and scored on the fifth, for three seeded repeats.

    The probes are the labelled visits, numbered by their key; their number alone comes to the driver.
    """
    numbered = order.numbered(left_out(t), "probe")
    n = units(t).count()
    folds = t.spark.createDataFrame(evaluation.fold_table(n, 5, 3, 7), "repeat long, fold long, position long")
    return evaluation.held_out(numbered, folds, THRESHOLDS, MARGINS)


@register("SELECT c.vec_id, c.name, d.source AS seen_at, v.n FROM crops c JOIN stamped d ON c.vec_id = d.id JOIN visits v ON v.source = d.source AND v.started_at = d.started_at", *VISITS, "crops")
def s11_track_vectors(t: Tables) -> DataFrame:
    """Vectors with their detection and its visit."""
    d = t.stamped.select(F.col("id").alias("vec_id"), F.col("source").alias("seen_at"), "started_at")
    v = t.visits.select(F.col("source").alias("seen_at"), "started_at", "n")
    return t.crops.select("vec_id", "name").join(d, "vec_id").join(v, ["seen_at", "started_at"]).select("vec_id", "name", "seen_at", "n")
