"""Tracks: features of a trajectory, all by windows and aggregates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import upper_median

#: Speed (frame widths a second) above which a step counts as moving.
MOVING = 0.04


def track_features(points: DataFrame, moving: float = MOVING) -> DataFrame:
    """Per track (track, t, cx, cy, w, h): duration, path, net displacement, straightness, speeds and the share of time moving."""
    w = Window.partitionBy("track").orderBy("t")
    step = F.hypot(F.col("cx") - F.lag("cx").over(w), F.col("cy") - F.lag("cy").over(w))
    rows = points.withColumn("dt", F.col("t") - F.lag("t").over(w)).withColumn("step", step)
    rows = rows.withColumn("speed", F.when(F.col("dt") > 0, F.col("step") / F.col("dt")))
    first, last = (f(F.struct("cx", "cy"), "t") for f in (F.min_by, F.max_by))
    on = F.col("speed") >= moving
    out = rows.groupBy("track").agg(
        F.count(F.lit(1)).alias("samples"), (F.max("t") - F.min("t")).alias("duration"), F.coalesce(F.sum("step"), F.lit(0.0)).alias("path"),
        first.alias("a"), last.alias("b"), F.avg(F.when(on, F.col("speed"))).alias("avg_speed"), F.max("speed").alias("peak_speed"), F.sum(F.when(on, F.col("dt")).otherwise(0.0)).alias("moved"),
    )
    net = F.hypot(F.col("b.cx") - F.col("a.cx"), F.col("b.cy") - F.col("a.cy"))
    return out.select(
        "track", "samples", "duration", "path", net.alias("net"), F.when(F.col("path") > 0, net / F.col("path")).otherwise(0.0).alias("straightness"), "avg_speed", "peak_speed",
        F.when(F.col("duration") > 0, F.col("moved") / F.col("duration")).otherwise(0.0).alias("moving_frac"),
    )


def area_trend(points: DataFrame) -> DataFrame:
    """Mean area at the end over that at the start, of three samples (half of the track if it is shorter)."""
    n = F.count(F.lit(1)).over(Window.partitionBy("track"))
    up, down = (F.row_number().over(Window.partitionBy("track").orderBy(o)) for o in (F.asc("t"), F.desc("t")))
    k = F.least(F.lit(3), F.floor(F.col("n") / 2))
    rows = points.withColumn("n", n).withColumn("up", up).withColumn("down", down).withColumn("area", F.col("w") * F.col("h"))
    ends = rows.groupBy("track").agg(F.avg(F.when(F.col("up") <= k, F.col("area"))).alias("a"), F.avg(F.when(F.col("down") <= k, F.col("area"))).alias("b"))
    return ends.select("track", F.when(F.col("a") > 0, F.col("b") / F.col("a")).alias("trend"))


def report(tracks: DataFrame) -> DataFrame:
    """Motion by who it was: tracks, upper-middle speed, straightness, share of time moving and stride (0 where none has one), and how many have a stride.

    ``tracks``: who (null: nobody confirmed), avg_speed, straightness, moving_frac, stride_hz.
    """
    middle = lambda c: F.coalesce(upper_median(c), F.lit(0.0)).alias(c)
    named = tracks.withColumn("who", F.coalesce("who", F.lit("(unconfirmed)")))
    return named.groupBy("who").agg(F.count(F.lit(1)).alias("tracks"), *(middle(c) for c in ("avg_speed", "straightness", "moving_frac", "stride_hz")), F.count("stride_hz").alias("gaits"))


def pair_clips(tracks: DataFrame, *, sustained: int = 12) -> DataFrame:
    """(clip_id, tracks, raw): clips in which two tracks or more are long enough to be animals of their own; dropouts cut one
    animal's track into stubs, which don't count. ``tracks``: clip_id, n_hits."""
    n = tracks.groupBy("clip_id").agg(F.count_if(F.col("n_hits") >= sustained).alias("tracks"), F.count(F.lit(1)).alias("raw"))
    return n.where("tracks >= 2")
