"""Visits: runs of a source's detections without a longer gap.

A source may hold a third of all rows, so its rows are not ordered in one task. They are split by day: each day's
gaps are found on their own, then one row per source and day carries the end of the last earlier day over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import micros, upper_median

DAY_US = 86_400_000_000


def _carried(part: DataFrame, key: str, day: str) -> DataFrame:
    """Each (key, day) with the last time of the key's earlier days."""
    over = Window.partitionBy(key).orderBy(day)
    return part.withColumn("before", F.lag("last").over(over))


def flag_gaps(rows: DataFrame, gap_s: float, *, key: str = "source", ts: str = "ts", order: str = "id", closed: bool = False) -> DataFrame:
    """``rows`` with ``fresh``: no earlier row of the key within the gap. A gap equal to ``gap_s`` splits only if ``closed``.

    Rows without a key or a time are left out.
    """
    rows = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).withColumn("__us", micros(ts))
    rows = rows.withColumn("__day", F.floor(F.col("__us") / DAY_US))
    days = _carried(rows.groupBy(key, "__day").agg(F.max("__us").alias("last")), key, "__day").select(key, "__day", "before")
    inside = Window.partitionBy(key, "__day").orderBy(ts, order)
    joined = rows.join(days, [key, "__day"])
    gap = F.col("__us") - F.coalesce(F.lag("__us").over(inside), "before")
    longer = gap >= gap_s * 1e6 if closed else gap > gap_s * 1e6
    return joined.withColumn("fresh", F.coalesce(longer, F.lit(True))).drop("before")


def with_previous(rows: DataFrame, value: str, *, key: str = "source", ts: str = "ts", order: str = "id") -> DataFrame:
    """``rows`` with ``before``: ``value`` in the key's row before. Days are ordered apart; a row a day carries its last value over.

    Rows without a key are a key of their own; rows without a time come first, as one more day.
    """
    rows = rows.withColumn("__day", F.floor(micros(ts) / DAY_US))
    last = rows.groupBy(key, "__day").agg(F.max_by(value, F.struct(ts, order)).alias("last"))
    days = _carried(last, key, "__day").select(key, "__day", F.col("before").alias("__carried"))
    inside = Window.partitionBy(key, "__day").orderBy(ts, order)
    before = F.when(F.row_number().over(inside) == 1, F.col("__carried")).otherwise(F.lag(value).over(inside))
    days = days.select(F.col(key).alias("__k"), F.col("__day").alias("__d"), "__carried")
    joined = rows.join(days, F.col(key).eqNullSafe(F.col("__k")) & F.col("__day").eqNullSafe(F.col("__d")))
    return joined.withColumn("before", before).drop("__day", "__carried", "__k", "__d")


def stamp_visits(rows: DataFrame, gap_s: float, *, key: str = "source", ts: str = "ts", order: str = "id", closed: bool = False) -> DataFrame:
    """``rows`` with ``started_at``, which with the key is a visit's lasting identity."""
    flagged = flag_gaps(rows, gap_s, key=key, ts=ts, order=order, closed=closed)
    start = F.when(F.col("fresh"), F.col(ts))
    days = flagged.groupBy(key, "__day").agg(F.max(start).alias("last"))
    over = Window.partitionBy(key).orderBy("__day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.withColumn("open", F.max("last").over(over)).select(key, "__day", "open")
    inside = Window.partitionBy(key, "__day").orderBy(ts, order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return (
        flagged.join(days, [key, "__day"])
        .withColumn("started_at", F.coalesce(F.max(start).over(inside), "open"))
        .drop("__us", "__day", "fresh", "open")
    )


def visits(rows: DataFrame, gap_s: float, *, closed: bool = False, extra: list[Column] | None = None) -> DataFrame:
    """One row per visit: source, started_at, ended_at, n, max_confidence, rep_id (the first of the highest confidence)."""
    best = F.struct((-F.coalesce("confidence", F.lit(0.0))).alias("worse"), "ts", "id")
    return (
        stamp_visits(rows, gap_s, closed=closed)
        .groupBy("source", "started_at")
        .agg(
            F.max("ts").alias("ended_at"),
            F.count(F.lit(1)).alias("n"),
            F.max("confidence").alias("max_confidence"),
            F.min_by("id", best).alias("rep_id"),
            *(extra or []),
        )
    )


def votes(stamped: DataFrame, *, value: str = "species", gate: float | None = None, weighted: bool = False) -> DataFrame:
    """Votes for each value in each visit: n, weight, and when it was first seen."""
    weight = F.coalesce("confidence", F.lit(1.0)) if weighted else F.lit(1.0)
    rows = stamped.where(F.col(value).isNotNull() & (F.col(value) != ""))
    if gate is not None:
        rows = rows.where(F.col("confidence") >= gate)
    return rows.groupBy("source", "started_at", value).agg(
        F.count(F.lit(1)).alias("n"), F.sum(weight).alias("weight"), F.min(F.struct("ts", "id")).alias("first")
    )


def winners(voted: DataFrame, value: str = "species") -> DataFrame:
    """The value with the most weight in each visit, ties to the first seen; its margin over the second, as a share (NaN where no vote has weight)."""
    order = F.struct((-F.col("weight")).alias("less"), "first")
    ranked = voted.groupBy("source", "started_at").agg(
        F.min_by(value, order).alias(value), F.array_sort(F.collect_list("weight")).alias("w"), F.sum("weight").alias("total")
    )
    second = F.when(F.size("w") > 1, F.element_at("w", -2)).otherwise(0.0)
    margin = F.when(F.col("total") != 0, (F.element_at("w", -1) - second) / F.col("total")).otherwise(float("nan"))
    return ranked.select("source", "started_at", value, margin.alias("margin"))


def species_vote(stamped: DataFrame, *, gate: float = 0.8, weighted: bool = True) -> DataFrame:
    """Gated, weighted votes; a visit where nothing clears the gate is decided without it."""
    strict = winners(votes(stamped, gate=gate, weighted=weighted))
    loose = winners(votes(stamped, weighted=weighted))
    s, g = strict.alias("s"), loose.alias("g")
    return g.join(s, ["source", "started_at"], "left").select(
        "source", "started_at", F.coalesce("s.species", "g.species").alias("species"), F.coalesce("s.margin", "g.margin").alias("margin"), F.col("s.species").isNotNull().alias("gated")
    )


def dwell_stats(visit_rows: DataFrame) -> DataFrame:
    """Visits, detections, upper-middle and longest dwell, and visits of one moment, by species."""
    dwell = (micros("ended_at") - micros("started_at")) / 1e6
    return (
        visit_rows.withColumn("dwell", dwell)
        .groupBy("species")
        .agg(
            F.count(F.lit(1)).alias("visits"),
            F.sum("n").alias("detections"),
            upper_median("dwell").alias("dwell_median"),
            F.max("dwell").alias("dwell_max"),
            F.count_if(F.col("dwell") == 0).alias("flybys"),
        )
    )


def bursts(rows: DataFrame, gap_s: float, most: int) -> DataFrame:
    """(source, started_at, part, n): bursts of frames, cut anew after every ``most`` frames."""
    stamped = stamp_visits(rows, gap_s)
    order = Window.partitionBy("source", "started_at").orderBy("ts", "id")
    part = F.floor((F.row_number().over(order) - 1) / most)
    return stamped.withColumn("part", part).groupBy("source", "started_at", "part").agg(F.count(F.lit(1)).alias("n"))
