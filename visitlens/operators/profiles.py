"""Profiles of species, sources and individuals: counts, clocks, windows, gaps and interactions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import micros, upper_median


def hour_counts(rows: DataFrame, key: str, ts: str = "ts") -> DataFrame:
    return rows.groupBy(key, F.hour(ts).cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


def typical_window(counts: DataFrame, key: str, coverage: float) -> DataFrame:
    """The narrowest run of hours, round midnight too, that holds ``coverage`` of all; the earliest start of equal ones.

    ``counts`` has (key, hour, n). Each hour adds to every run that holds it, so a key costs 24 * 24 rows at most and
    they are summed before they are shuffled.
    """
    total = counts.groupBy(key).agg(F.sum("n").alias("total"))
    runs = counts.select(key, "hour", "n", F.explode(F.sequence(F.lit(1), F.lit(24))).alias("width"))
    runs = runs.select(key, "n", "width", F.explode(F.transform(F.sequence(F.lit(0), F.col("width") - 1), lambda i: F.pmod(F.col("hour") - i, F.lit(24)))).alias("start"))
    sums = runs.groupBy(key, "width", "start").agg(F.sum("n").alias("held")).join(total, key)
    best = sums.where(F.col("held") >= coverage * F.col("total")).groupBy(key).agg(F.min(F.struct("width", "start")).alias("x"))
    return best.select(key, F.col("x.start").cast("long").alias("start_hour"), F.pmod(F.col("x.start") + F.col("x.width") - 1, F.lit(24)).cast("long").alias("end_hour"))


def day_gaps(rows: DataFrame, key: str) -> DataFrame:
    """Distinct days, upper-middle gap between them in days, first and last day, by key."""
    days = rows.select(key, F.to_date("ts").alias("day")).distinct()
    gap = F.datediff("day", F.lag("day").over(Window.partitionBy(key).orderBy("day")))
    return (
        days.withColumn("gap", gap)
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("days"), upper_median("gap").cast("long").alias("gap_median"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))
    )


def roll_call(rows: DataFrame, key: str, now: Column) -> DataFrame:
    """Who is overdue: absent for longer than twice the usual gap, and than two days. Regulars were there on three days."""
    gaps = day_gaps(rows, key).withColumn("days_since", F.datediff(now, "last_day").cast("long"))
    gap = F.coalesce("gap_median", F.lit(0))
    return gaps.select(
        key, "days", "gap_median", "days_since", (F.col("days") >= 3).alias("regular"), ((F.col("days") >= 3) & (F.col("days_since") > F.greatest(F.lit(2), 2 * gap))).alias("overdue")
    )


def tally_map(rows: DataFrame, key: str, value: str) -> DataFrame:
    """Each key's counts of values as text, most first, then by value."""
    n = rows.groupBy(key, value).agg(F.count(F.lit(1)).alias("n"))
    items = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("less"), F.col(value).alias("v"), F.col("n").alias("n"))))
    return n.groupBy(key).agg(F.array_join(F.transform(items, lambda x: F.concat_ws("=", x["v"], x["n"].cast("string"))), ",").alias("tally"))


def top_per_group(rows: DataFrame, key: str, k: int, *order: Column) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy(*order)).cast("long")).where(F.col("rank") <= k)


def co_occurrence(members: DataFrame, value: str = "species") -> DataFrame:
    """Visits that two values share, for unordered pairs. The values of one visit are few, so pairs stay in the row."""
    sets = members.groupBy("source", "started_at").agg(F.array_sort(F.collect_set(value)).alias("v"))
    pairs = F.flatten(F.transform("v", lambda a: F.transform(F.filter("v", lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))
    return sets.select(F.explode(pairs).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("visits"))


def accumulation(rows: DataFrame, value: str = "species") -> DataFrame:
    """Distinct values seen up to each day on which a new one appears."""
    first = rows.groupBy(value).agg(F.min(F.to_date("ts")).alias("day")).groupBy("day").agg(F.count(F.lit(1)).alias("fresh"))
    total = F.sum("fresh").over(Window.orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return first.select("day", "fresh", total.alias("total"))


def interval_stats(visits: DataFrame, key: str, cap_h: float = 24) -> DataFrame:
    """Upper-middle hours between a key's visits at one source; longer gaps than the cap are left out."""
    w = Window.partitionBy("source", key).orderBy("started_at")
    gap = (micros("started_at") - F.lag(micros("ended_at")).over(w)) / 3.6e9
    return visits.withColumn("gap_h", gap).where(F.col("gap_h") <= cap_h).groupBy(key).agg(F.count(F.lit(1)).alias("gaps"), upper_median("gap_h").alias("gap_h"))


def profile(visits: DataFrame, key: str) -> DataFrame:
    """Behaviour of each ``key`` over its visits (started_at, ended_at, n): visits, days, per_day (to a digit), first, last, peak (the hour of most
    arrivals, the earliest of equals), start_hour and end_hour (the usual window), dwell_median (upper-middle), dwell_max, crops_per_visit (to a digit)."""
    x = visits.where(F.col(key).isNotNull()).withColumn("dwell", (micros("ended_at") - micros("started_at")) / 1e6)
    hours = hour_counts(x, key, "started_at")
    peak = hours.groupBy(key).agg(F.min_by("hour", F.struct((-F.col("n")).alias("less"), "hour")).alias("peak"))
    n, days = F.count(F.lit(1)), F.count_distinct(F.to_date("started_at"))
    main = x.groupBy(key).agg(
        n.alias("visits"), days.alias("days"), F.bround(n / days, 1).alias("per_day"), F.min("started_at").alias("first"), F.max("started_at").alias("last"),
        upper_median("dwell").alias("dwell_median"), F.max("dwell").alias("dwell_max"), F.bround(F.sum("n") / n, 1).alias("crops_per_visit"),
    )
    return main.join(peak, key, "left").join(typical_window(hours, key, 0.8), key, "left")


def sun_anchor(visits: DataFrame, key: str, *, dawn_h: int = 6, dusk_h: int = 18, least: int = 5) -> tuple[DataFrame, DataFrame]:
    """Arrivals by the sun: (key, anchor, n, minutes) and, for weeks of ``least`` arrivals, (key, week, n, minutes).

    Keys that mostly come in the dark are anchored to dusk, an arrival before dawn to the evening before; the others to dawn.
    Minutes are rounded, medians upper-middle. The sun is fixed to two hours of the wall clock.
    """
    x = visits.where(F.col(key).isNotNull()).select(key, F.col("started_at").alias("at"))
    hour = F.hour("at")
    dark = (hour < dawn_h) | (hour >= dusk_h)
    kind = x.groupBy(key).agg((2 * F.count_if(dark) > F.count(F.lit(1))).alias("nocturnal"))
    shift = F.when(~F.col("nocturnal"), dawn_h).when(hour < dawn_h, dusk_h - 24).otherwise(dusk_h)
    minutes = F.bround((micros("at") - micros(F.date_trunc("day", "at").cast("timestamp_ntz")) - shift * 3_600_000_000) / 6e7)
    x = x.join(kind, key).withColumn("minutes", minutes).withColumn("week", F.concat(F.extract(F.lit("YEAROFWEEK"), "at").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("at").cast("string"), 2, "0")))
    whole = x.groupBy(key, F.when(F.col("nocturnal"), "dusk").otherwise("dawn").alias("anchor")).agg(F.count(F.lit(1)).alias("n"), upper_median("minutes").alias("minutes"))
    weeks = x.groupBy(key, "week").agg(F.count(F.lit(1)).alias("n"), upper_median("minutes").alias("minutes")).where(F.col("n") >= least)
    return whole, weeks


def overview(visits: DataFrame, members: DataFrame, *, recent: int = 40, pairs: int = 12, denied: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame, DataFrame]:
    """What the behaviour page shows: (profiles of all species with their anchor, the pairs that share most visits, the newest visits with how well each fits its species).

    ``visits``: source, started_at, ended_at, n, species, rep_id; ``members``: source, started_at, species. ``denied`` species are no animals.
    A visit fits if it came in its species' usual window and stayed from 0.15 to 8 times as long as is usual, or less than five seconds;
    species of fewer than three visits are thin.
    """
    real = visits.where(~F.lower(F.coalesce("species", F.lit(""))).isin(list(denied)))
    each = profile(real, "species").join(sun_anchor(real, "species")[0].select("species", "anchor", "minutes"), "species", "left")
    often = co_occurrence(members).orderBy(F.desc("visits"), "a", "b").limit(pairs)
    newest = visits.orderBy(F.desc("started_at"), "source").limit(recent).where(~F.lower(F.coalesce("species", F.lit(""))).isin(list(denied)))
    p = each.select("species", F.col("visits").alias("held"), "start_hour", "end_hour", "dwell_median")
    dwell, hour = (micros("ended_at") - micros("started_at")) / 1e6, F.hour("started_at")
    inside = F.when(F.col("start_hour") <= F.col("end_hour"), hour.between(F.col("start_hour"), F.col("end_hour"))).otherwise((hour >= F.col("start_hour")) | (hour <= F.col("end_hour")))
    usual = (dwell < 5) | (dwell / F.coalesce(F.nullif(F.col("dwell_median"), F.lit(0.0)), F.lit(1.0))).between(0.15, 8)
    verdict = F.when(F.coalesce("held", F.lit(0)) < 3, "thin").when(inside & usual, "fits").otherwise("odd")
    flags = newest.join(p, "species", "left").select("source", "started_at", "species", F.floor(dwell).alias("dwell_s"), "rep_id", verdict.alias("verdict"))
    return each, often, flags
