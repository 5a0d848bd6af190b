"""Queries over boxes and tracks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.functions.columns import micros
from visitlens.operators import evaluation, geometry, motion, places
from visitlens.plans.evaluation import EDGE_LIST
from visitlens.plans.registry import DET, register
from visitlens.sources.fixtures import Tables

BOXES = ("boxes",)
INTER = "greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1))"
AREA = "({0}.x2 - {0}.x1) * ({0}.y2 - {0}.y1)"
PAIRED = f"""WITH i AS (SELECT a.frame, a.seq AS a, b.seq AS b, {INTER} AS both_, {AREA.format("a")} AS s, {AREA.format("b")} AS t FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.seq < b.seq),
    p AS (SELECT frame, a, b, CASE WHEN s + t - both_ > 0 THEN both_ / (s + t - both_) ELSE 0 END AS iou FROM i)"""


@register(PAIRED + " SELECT frame, a, b, round(iou, 6) AS iou FROM p", *BOXES)
def f13_pair_iou(t: Tables) -> DataFrame:
    return geometry.pair_ious(t.boxes).withColumn("iou", F.round("iou", 6))


@register(PAIRED + f", h AS (SELECT least(len(list_filter({EDGE_LIST}, lambda e: e <= iou)) - 1, 9) AS bin FROM p) SELECT bin, count(*) AS n FROM h GROUP BY bin", *BOXES)
def e21_iou_histogram(t: Tables) -> DataFrame:
    return geometry.pair_ious(t.boxes).groupBy(evaluation.bin_of("iou").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@register(PAIRED + " SELECT frame, count(*) AS pairs FROM p WHERE iou < 0.45 GROUP BY frame", *BOXES)
def j20_co_present(t: Tables) -> DataFrame:
    return geometry.pair_ious(t.boxes).where("iou < 0.45").groupBy("frame").agg(F.count(F.lit(1)).alias("pairs"))


@register("SELECT frame, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, count(*) AS n FROM boxes GROUP BY frame", *BOXES)
def f15_union_box(t: Tables) -> DataFrame:
    return t.boxes.groupBy("frame").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.count(F.lit(1)).alias("n"))


@register(
    f"""SELECT a.frame, a.seq AS inner_seq, b.seq AS outer_seq, round({INTER} / ({AREA.format("a")}), 6) AS part FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.seq <> b.seq
    WHERE {INTER} >= 0.8 * {AREA.format("a")}""",
    *BOXES,
)
def f14_containment(t: Tables) -> DataFrame:
    c = ["x1", "y1", "x2", "y2"]
    a = t.boxes.select("frame", F.col("seq").alias("inner_seq"), *(F.col(x).alias(f"a_{x}") for x in c))
    b = t.boxes.select("frame", F.col("seq").alias("outer_seq"), *(F.col(x).alias(f"b_{x}") for x in c))
    p = a.join(b, "frame").where("inner_seq <> outer_seq").withColumn("part", columns.containment("a_", "b_")).where(columns.intersection("a_", "b_") >= 0.8 * columns.area("a_"))
    return p.select("frame", "inner_seq", "outer_seq", F.round("part", 6).alias("part"))


DIAGONAL = "(sqrt(power(a.x2 - a.x1, 2) + power(a.y2 - a.y1, 2)) + sqrt(power(b.x2 - b.x1, 2) + power(b.y2 - b.y1, 2))) / 2"


@register(
    f"""SELECT a.frame, a.seq AS a, b.seq AS b, round(sqrt(power((a.x1 + a.x2 - b.x1 - b.x2) / 2, 2) + power((a.y1 + a.y2 - b.y1 - b.y2) / 2, 2)) / ({DIAGONAL}), 6) AS distance
    FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.seq < b.seq""",
    *BOXES,
)
def f16_centre_distance(t: Tables) -> DataFrame:
    c = ["x1", "y1", "x2", "y2"]
    a = t.boxes.select("frame", F.col("seq").alias("a"), *(F.col(x).alias(f"a_{x}") for x in c))
    b = t.boxes.select("frame", F.col("seq").alias("b"), *(F.col(x).alias(f"b_{x}") for x in c))
    return a.join(b, "frame").where("a < b").select("frame", "a", "b", F.round(columns.centre_distance("a_", "b_"), 6).alias("distance"))


@register("SELECT frame, seq, round(x1 * 320 / 1000, 6) AS x1, round(y1 * 180 / 1000, 6) AS y1, round(x2 * 320 / 1000, 6) AS x2, round(y2 * 180 / 1000, 6) AS y2 FROM boxes", *BOXES)
def f17_scale_box(t: Tables) -> DataFrame:
    return t.boxes.select("frame", "seq", *(F.round(F.col(c) * f / 1000, 6).alias(c) for c, f in (("x1", 320), ("y1", 180), ("x2", 320), ("y2", 180))))


SHOT = "score * (0.6 + least((x2 - x1) * (y2 - y1) / 1e6, 0.4)) * (0.7 + 0.3 * (1 - abs((x1 + x2) / 2 - 250) / 500))"


@register(f"SELECT frame, seq, round({SHOT}, 9) AS shot FROM boxes", *BOXES)
def f18_shot_score(t: Tables) -> DataFrame:
    size, centre = columns.area() / 1e6, 1 - F.abs((F.col("x1") + F.col("x2")) / 2 - 250) / 500
    return t.boxes.select("frame", "seq", F.round(columns.shot_score("score", F.lit(0.0), size, centre), 9).alias("shot"))


@register("SELECT frame, round(max(score + sqrt((x2 - x1) * (y2 - y1) / 1e6)), 6) AS best FROM boxes GROUP BY frame", *BOXES)
def f28_frame_score(t: Tables) -> DataFrame:
    return t.boxes.groupBy("frame").agg(F.round(F.max(F.col("score") + F.sqrt(columns.area() / 1e6)), 6).alias("best"))


@register("SELECT b.frame, b.seq FROM boxes b WHERE NOT EXISTS (SELECT 1 FROM (SELECT * FROM boxes WHERE seq = 1) a WHERE a.frame = b.frame AND b.seq <> 1 AND " + INTER + f" >= 0.45 * ({AREA.format('a')} + {AREA.format('b')} - " + INTER + ")) ", *BOXES)
def p16_ignore_zones(t: Tables) -> DataFrame:
    """Boxes that overlap their frame's zone (its first box) by 0.45 or more are dropped, the zone's own box is not."""
    c = ["x1", "y1", "x2", "y2"]
    zones = t.boxes.where("seq = 1").select(F.col("frame").alias("zone_frame"), *(F.col(x).alias(f"z_{x}") for x in c))
    others = t.boxes.select("frame", "seq", *(F.col(x).alias(f"b_{x}") for x in c))
    hit = (F.col("frame") == F.col("zone_frame")) & (F.col("seq") != 1) & (columns.iou("z_", "b_") >= 0.45)
    return others.join(zones, hit, "left_anti").select("frame", "seq")


@register()
def g1_max_separated(t: Tables) -> DataFrame:
    return geometry.separated(t.boxes)


@register()
def g2_suppress(t: Tables) -> DataFrame:
    return geometry.suppress(t.boxes)


@register()
def g3_distinct_boxes(t: Tables) -> DataFrame:
    return geometry.distinct_boxes(t.boxes)


@register()
def a34_crowd_peak(t: Tables) -> DataFrame:
    """The frames with most mutually separate boxes of one species, or of all; ten of them."""
    every = geometry.separated(t.boxes).groupBy("frame").agg(F.count(F.lit(1)).alias("n"))
    return every.orderBy(F.desc("n"), "frame").limit(10)


@register()
def a36_box_inflation(t: Tables) -> DataFrame:
    raw = t.boxes.groupBy("frame").agg(F.count(F.lit(1)).alias("raw"))
    real = geometry.distinct_boxes(t.boxes).groupBy("frame").agg(F.count(F.lit(1)).alias("real"))
    return raw.join(real, "frame").groupBy("raw", "real").agg(F.count(F.lit(1)).alias("frames"))


def placed(t: Tables) -> DataFrame:
    return t.boxes.select((F.col("frame") % 40).alias("source"), (F.col("frame") * 10 + F.col("seq")).alias("id"), F.col("frame").alias("at"), "x1", "y1", "x2", "y2")


@register()
def g6_place_clusters(t: Tables) -> DataFrame:
    return geometry.place_clusters(placed(t))


@register()
def g7_static_clusters(t: Tables) -> DataFrame:
    """Clusters of many boxes over a long time: both are required."""
    found = geometry.place_clusters(placed(t)).withColumn("at", F.floor(F.col("id") / 10))
    held = found.groupBy("source", "cell_x", "cell_y", "cluster").agg(F.count(F.lit(1)).alias("n"), (F.max("at") - F.min("at")).alias("span"))
    return held.where("n >= 3 and span >= 60")


@register()
def g8_drifting_clusters(t: Tables) -> DataFrame:
    return geometry.place_clusters(placed(t), drift=0.3)


@register()
def g10_suppressed_clusters(t: Tables) -> DataFrame:
    found = geometry.place_clusters(placed(t), limit=0.6, drift=0.1, best=True)
    return found.groupBy("source", "cell_x", "cell_y", "cluster").agg(F.count(F.lit(1)).alias("n"))


#: Trajectories: a source's detections of a day, the value and the number as coordinates.
POINTS = """points AS (SELECT source * 100 + day(ts) AS track, id, epoch_us(ts) / 1e6 - 1704067200 AS t, value / 500 AS cx, k / 100 AS cy, 0.05 + (id % 7) / 100 AS w, 0.05 + (id % 5) / 100 AS h FROM detections)"""


def points(t: Tables) -> DataFrame:
    return t.detections.select(
        (F.col("source") * 100 + F.day("ts")).alias("track"), "id", (micros("ts") / 1e6 - 1704067200).alias("t"), (F.col("value") / 500).alias("cx"), (F.col("k") / 100).alias("cy"),
        (0.05 + (F.col("id") % 7) / 100).alias("w"), (0.05 + (F.col("id") % 5) / 100).alias("h"),
    )


@register(
    "WITH " + POINTS + """, s AS (SELECT *, t - lag(t) OVER w_ AS dt, sqrt(power(cx - lag(cx) OVER w_, 2) + power(cy - lag(cy) OVER w_, 2)) AS step FROM points WINDOW w_ AS (PARTITION BY track ORDER BY t)),
    v AS (SELECT *, CASE WHEN dt > 0 THEN step / dt END AS speed FROM s),
    a AS (SELECT track, count(*) AS samples, max(t) - min(t) AS duration, coalesce(sum(step), 0) AS path, sqrt(power(arg_max(cx, t) - arg_min(cx, t), 2) + power(arg_max(cy, t) - arg_min(cy, t), 2)) AS net,
      avg(speed) FILTER (speed >= 0.00002) AS avg_speed, max(speed) AS peak_speed, coalesce(sum(dt) FILTER (speed >= 0.00002), 0) AS moved FROM v GROUP BY track)
    SELECT track, samples, round(duration, 3) AS duration, round(path, 6) AS path, round(net, 6) AS net, round(CASE WHEN path > 0 THEN net / path ELSE 0 END, 6) AS straightness, round(avg_speed, 6) AS avg_speed,
    round(peak_speed, 6) AS peak_speed, round(CASE WHEN duration > 0 THEN moved / duration ELSE 0 END, 6) AS moving_frac FROM a""",
    *DET,
)
def m1_track_features(t: Tables) -> DataFrame:
    f = motion.track_features(points(t), moving=0.00002)
    return f.select("track", "samples", F.round("duration", 3).alias("duration"), *(F.round(c, 6).alias(c) for c in ("path", "net", "straightness", "avg_speed", "peak_speed", "moving_frac")))


@register(
    "WITH " + POINTS + """, r AS (SELECT track, w * h AS area, count(*) OVER (PARTITION BY track) AS n, row_number() OVER (PARTITION BY track ORDER BY t) AS up, row_number() OVER (PARTITION BY track ORDER BY t DESC) AS down FROM points)
    SELECT track, round(avg(area) FILTER (down <= least(3, n // 2)) / avg(area) FILTER (up <= least(3, n // 2)), 6) AS trend FROM r GROUP BY track""",
    *DET,
)
def m1_area_trend(t: Tables) -> DataFrame:
    return motion.area_trend(points(t)).withColumn("trend", F.round("trend", 6))


@register()
def g4_associate(t: Tables) -> DataFrame:
    p = points(t).select(F.col("track").alias("clip"), "id", "t", "cx", "cy")
    return geometry.associate(p, gap_s=6 * 3600, base=0.2, rate=0.0001, min_hits=2)


@register()
def m2_gait(t: Tables) -> DataFrame:
    """Whole sources as tracks, whose day is a second; steps of a few hours then lie in the band of strides."""
    p = points(t).select(F.floor(F.col("track") / 100).alias("track"), (F.col("t") / 86400).alias("t"), "cx", "cy")
    return geometry.gait(p).select("track", *(F.round(c, 4).alias(c) for c in ("stride_hz", "strength", "walk_s")))


@register()
def g12_linkage(t: Tables) -> DataFrame:
    rows = t.crops.select("night", F.col("vec_id").alias("id"), "embedding").withColumn("night", F.col("night").cast("string"))
    return geometry.linkage(rows, ["night"], cut=0.9)


@register()
def g13_constrained_linkage(t: Tables) -> DataFrame:
    rows = t.crops.select(F.col("night").cast("string").alias("night"), F.col("vec_id").alias("id"), "embedding", F.col("visit"))
    return geometry.linkage(rows, ["night"], cut=0.95, apart="visit")


def night_frames(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Boxes of nights of 400 frames in clips of 20, with a measure of motion; and all their frames."""
    night, clip = F.floor(F.col("frame") / 400).alias("night"), F.floor(F.col("frame") / 20).alias("clip")
    number = F.col("seq") * 100 + F.round(F.col("score") * 100).cast("long")
    boxes = t.boxes.select(night, F.col("frame").alias("at"), number.alias("seq"), F.round(F.col("x1") / 40).alias("c"), F.round(F.col("y1") / 40).alias("r"), (F.col("score") * 3).alias("motion"))
    still = boxes.select("night", "at", "seq", (F.col("c") * 40).alias("x1"), (F.col("r") * 40).alias("y1"), (F.col("c") * 40 + 60).alias("x2"), (F.col("r") * 40 + 60).alias("y2"), "motion")
    return still, t.boxes.select(night, clip, F.col("frame").alias("at")).distinct()


@register()
def m15_night_furniture(t: Tables) -> DataFrame:
    """Things that show up over the clips of a night without motion."""
    return places.furniture(*night_frames(t)).select("night", "place", "n", *(F.round(c, 6).alias(c) for c in places.SIDES), F.round("motion", 6).alias("motion"))


@register()
def a49_clean_counts(t: Tables) -> DataFrame:
    """Boxes of each sampled frame with and without the night's furniture."""
    boxes, frames = night_frames(t)
    return places.clean_counts(boxes, frames, places.furniture(boxes, frames))
