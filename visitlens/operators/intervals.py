"""Joins of closed time intervals, and islands of overlapping ones.

Two intervals that overlap share a time bucket, so a join is an equality on (source, bucket) with a residual test. The
bucket keeps a busy source from meeting itself whole; a pair that shares several buckets is found only in the one where
the later of the two begins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import micros, overlap_seconds

BUCKET_S = 6 * 3600


def _buckets(start: Column, end: Column, bucket_s: int) -> Column:
    width = bucket_s * 1_000_000
    return F.explode(F.sequence(F.floor(micros(start) / width), F.floor(micros(F.greatest(start, end)) / width)))


def overlap_join(left: DataFrame, right: DataFrame, *, key: str = "source", bucket_s: int = BUCKET_S) -> DataFrame:
    """Pairs of ``left`` (key, a0, a1) and ``right`` (key, b0, b1) that overlap or touch. A null end is its start."""
    a = left.withColumn("a1", F.coalesce("a1", "a0")).withColumn("__b", _buckets(F.col("a0"), F.col("a1"), bucket_s))
    b = right.withColumn("b1", F.coalesce("b1", "b0")).withColumn("__b", _buckets(F.col("b0"), F.col("b1"), bucket_s))
    met = F.floor(micros(F.greatest("a0", "b0")) / (bucket_s * 1_000_000)) == F.col("__b")
    return a.join(b, [key, "__b"]).where((F.col("a0") <= F.col("b1")) & (F.col("a1") >= F.col("b0")) & met).drop("__b")


def with_overlap(pairs: DataFrame) -> DataFrame:
    return pairs.withColumn("overlap_s", overlap_seconds("a0", "a1", "b0", "b1"))


def best_per(pairs: DataFrame, keys: list[str], order: list[Column], keep: list[str]) -> DataFrame:
    """The first row of each group in ``order``, by aggregation rather than by sorting whole groups."""
    ranked = F.struct(*(o.alias(f"o{i}") for i, o in enumerate(order)))
    return pairs.groupBy(*keys).agg(F.min_by(F.struct(*keep), ranked).alias("x")).select(*keys, "x.*")


def first_after(events: DataFrame, others: DataFrame, *, key: str = "source", horizon_s: float) -> DataFrame:
    """For each event (key, id, at) the first of ``others`` (key, at, what) strictly later, within the horizon.

    Buckets as wide as the horizon make it an equality join with the event's bucket and the next one.
    """
    width = int(horizon_s * 1_000_000)
    at = F.floor(micros("at") / width)
    left = events.withColumn("__b", F.explode(F.array(at, at + 1)))
    right = others.select(key, F.col("at").alias("later"), "what", F.floor(micros("at") / width).alias("__b"))
    pairs = left.join(right, [key, "__b"]).where((F.col("later") > F.col("at")) & (micros("later") - micros("at") <= width))
    return pairs.groupBy(key, "id", "at").agg(F.min(F.struct("later", "what")).alias("x")).select(key, "id", "at", "x.later", "x.what")


def islands(spans: DataFrame, *, key: str = "source") -> DataFrame:
    """Spans (key, a0, a1, id) with the start of the island of transitively overlapping spans they belong to.

    Spans are first packed by day of their start, so the running maximum over a source is taken over a row per day and
    not over a row per span; within a day a window of (source, day) does the rest.
    """
    rows = spans.withColumn("a1", F.coalesce("a1", "a0")).withColumn("__day", F.to_date("a0"))
    days = rows.groupBy(key, "__day").agg(F.max("a1").alias("last"))
    earlier = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("reach", F.max("last").over(earlier)).select(key, "__day", "reach")
    inside = Window.partitionBy(key, "__day").orderBy("a0", "a1", "id")
    reach = F.greatest(F.max("a1").over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.col("reach"))
    flagged = rows.join(days, [key, "__day"]).withColumn("fresh", F.coalesce(F.col("a0") > reach, F.lit(True)))
    start = F.when(F.col("fresh"), F.col("a0"))
    opened = flagged.groupBy(key, "__day").agg(F.max(start).alias("last"))
    opened = opened.withColumn("open", F.max("last").over(earlier)).select(key, "__day", "open")
    running = F.max(start).over(inside.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return flagged.drop("reach").join(opened, [key, "__day"]).withColumn("island", F.coalesce(running, "open")).drop("__day", "fresh", "open")


def dark_seconds(events: DataFrame, windows: DataFrame, *, key: str = "source") -> DataFrame:
    """Seconds of each window (key, a0, a1) that its source was down; null where the ledger begins after the window.

    ``events`` are (key, at, event) with event up or down; a state lasts until the next event.
    """
    nxt = F.lead("at").over(Window.partitionBy(key).orderBy("at", "event"))
    spans = events.select(key, F.col("at").alias("b0"), F.coalesce(nxt, F.lit("9999-12-31").cast("timestamp_ntz")).alias("b1"), "event")
    first = events.groupBy(key).agg(F.min("at").alias("first"))
    ends = windows.groupBy(key).agg(F.max("a1").alias("most"))
    downs = spans.where("event = 'down'").join(ends, key).withColumn("b1", F.least("b1", "most")).where("b0 < b1").drop("most", "event")
    down = with_overlap(overlap_join(windows, downs)).groupBy(key, "a0", "a1").agg(F.sum("overlap_s").alias("dark"))
    known = windows.join(first, key, "left").join(down, [key, "a0", "a1"], "left")
    return known.select(key, "a0", "a1", F.when(F.col("first") <= F.col("a1"), F.coalesce("dark", F.lit(0.0))).alias("dark_s"))
