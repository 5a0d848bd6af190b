"""The period digest: half-days by a fixed sun, and what was new, missing or remarkable in one of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import micros

#: Dawn and the length of a period, in hours: days run from 6 to 18 o'clock, nights from 18 to 6.
DAWN_H, PERIOD_H = 6, 12
HOUR_US = 3_600_000_000


def period_of(ts: Column | str) -> Column:
    """The number of the half-open period that holds a time; even ones are days."""
    return F.floor((micros(ts) / HOUR_US - DAWN_H) / PERIOD_H)


def period_start(period: Column | str) -> Column:
    p = F.col(period) if isinstance(period, str) else period
    return F.timestamp_add("HOUR", (p * PERIOD_H + DAWN_H).cast("int"), F.lit("1970-01-01").cast("timestamp_ntz")).cast("timestamp_ntz")


def with_period(rows: DataFrame, ts: str = "ts") -> DataFrame:
    """``rows`` with ``period`` and ``now``, the newest period that has data (one broadcast row)."""
    numbered = rows.withColumn("period", period_of(ts))
    return numbered.crossJoin(F.broadcast(numbered.agg(F.max("period").alias("now"))))


def streaks(rows: DataFrame, label: str) -> DataFrame:
    """Consecutive periods of the current kind, the current one first, that hold each label."""
    held = rows.where("(now - period) % 2 = 0").select(label, ((F.col("now") - F.col("period")) / 2).cast("long").alias("back")).distinct()
    place = F.row_number().over(Window.partitionBy(label).orderBy("back")) - 1
    return held.withColumn("place", place).where("back = place").groupBy(label).agg(F.count(F.lit(1)).alias("streak"))


def novelty(rows: DataFrame, label: str) -> DataFrame:
    """Days before the current period's start that each of its labels was last seen; null if never."""
    start = period_start("now")
    before = F.max(F.when(F.col("period") < F.col("now"), F.col("ts")))
    out = rows.groupBy(label, "now").agg(before.alias("previous"), F.count_if(F.col("period") == F.col("now")).alias("crops"))
    return out.where("crops > 0").select(label, "crops", F.round((micros(start) - micros("previous")) / 8.64e10, 3).alias("days"))


def quiet_regulars(rows: DataFrame, label: str, *, priors: int = 12, share: float = 0.4) -> DataFrame:
    """Labels of at least ``share`` of the prior periods of the current kind that are absent now."""
    back = (F.col("now") - F.col("period")) / 2
    held = rows.where(f"(now - period) % 2 = 0 and period >= now - {2 * priors}").select(label, back.cast("long").alias("back")).distinct()
    out = held.groupBy(label).agg(F.count_if(F.col("back") > 0).alias("present"), F.min("back").alias("since"))
    return out.where((F.col("since") > 0) & (F.col("present") >= share * priors))


def surprises(rows: DataFrame, label: str, *, rare: float = 0.15) -> DataFrame:
    """Labels of the current period of whose sightings less than ``rare`` fall in its hours."""
    current = F.col("period") == F.col("now")
    kind = (F.col("now") - F.col("period")) % 2 == 0
    out = rows.groupBy(label).agg(F.count_if(current).alias("crops"), F.avg(kind.cast("double")).alias("share"))
    return out.where("crops > 0").select(label, "crops", F.round("share", 6).alias("share"), (F.col("share") < rare).alias("surprising"))


def sliding_best(points: DataFrame, width: int) -> DataFrame:
    """Per clip (clip, t, weight; t a whole number) the window of ``width`` from a point on with the most weight; the earliest of equals."""
    ahead = F.sum("weight").over(Window.partitionBy("clip").orderBy("t").rangeBetween(0, width))
    return points.withColumn("held", F.round(ahead, 9)).groupBy("clip").agg(F.min_by(F.struct("t", "held"), F.struct((-F.col("held")).alias("less"), "t")).alias("x")).select("clip", F.col("x.t").alias("t"), F.col("x.held").alias("held"))


def reel_bursts(clips: DataFrame, gap_s: float = 480) -> DataFrame:
    """(period, burst, ...): neighbours in time within a period, of one species and without a longer gap, are one burst."""
    w = Window.partitionBy("period").orderBy("ts", "id")
    fresh = F.coalesce((F.lag("species").over(w) != F.col("species")) | (micros("ts") - F.lag(micros("ts")).over(w) > gap_s * 1e6), F.lit(True))
    flagged = clips.withColumn("fresh", fresh.cast("int"))
    return flagged.withColumn("burst", F.sum("fresh").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).drop("fresh")


def reel_offers(candidates: DataFrame, *, long_s: float) -> DataFrame:
    """(period, place, members): what a reel is offered, in order; of ``members`` (at_s, seconds, id; best first) one may be taken.

    The best moment of each species, of those with the fewest detections first; of each named individual; of each burst, the
    best first; then each burst of several moments, long ones first, then those with most moments; then long ones of three or more once more.
    """
    moment = F.struct((-F.col("score")).alias("worse"), "ts", "id", (micros("ts") / 1e6).alias("at_s"), "seconds")
    rows = candidates.select("period", "species", "burst", "individuals", "n", moment.alias("m"))
    zero = F.lit(0.0)

    def offers(tier: int, grouped: DataFrame, *order: Column, members: Column | None = None) -> DataFrame:
        keys = [c.cast("double").alias(f"o{i}") for i, c in enumerate((*order, zero, zero)[:2])]
        return grouped.select("period", F.lit(tier).alias("tier"), *keys, F.col("best"), F.coalesce(F.col("name").cast("string"), F.lit("")).alias("name"), (members if members is not None else F.array("best")).alias("members"))

    species = rows.groupBy("period", F.col("species").alias("name")).agg(F.min("m").alias("best"), F.sum("n").alias("seen"))
    named = rows.select("period", F.explode("individuals").alias("name"), "m").groupBy("period", "name").agg(F.min("m").alias("best"))
    bursts = rows.groupBy("period", "burst").agg(F.min("m").alias("best"), F.array_sort(F.collect_list("m")).alias("all")).withColumn("name", F.lit(""))
    lasting = F.abs(F.col("best.at_s") - F.element_at("all", -1)["at_s"]) >= long_s
    again = [(~lasting).cast("int"), -F.size("all")]
    made = [
        offers(1, species, F.col("seen")), offers(2, named), offers(3, bursts),
        offers(4, bursts.where(F.size("all") >= 2), *again, members=F.col("all")), offers(5, bursts.where((F.size("all") >= 3) & lasting), *again, members=F.col("all")),
    ]
    union = made[0]
    for m in made[1:]:
        union = union.unionByName(m)
    # Species and names go by name within their number; bursts by their best moment.
    text = F.when(F.col("tier") <= 2, F.col("name")).otherwise("")
    place = F.row_number().over(Window.partitionBy("period").orderBy("tier", "o0", "o1", text, "best"))
    return union.select("period", place.alias("place"), F.transform("members", lambda m: F.struct(m["at_s"], m["seconds"], m["id"])).alias("members"))


def select_reel(candidates: DataFrame, *, most: int = 14, budget_s: float = 75.0, apart_s: float = 180.0, long_s: float = 1500.0) -> DataFrame:
    """(period, place, id): the moments of a reel in order of time, taken while fewer than ``most`` and ``budget_s`` are used.

    ``candidates``: period, id, ts, species, individuals, burst, score, n (detections), seconds. Offers are gone through in the order
    of ``reel_offers``; of an offer the best moment that is not taken yet, and ``apart_s`` from all that are taken of it if there is such a one.
    A burst is long if its best and its weakest moment lie ``long_s`` apart. A period holds a few hundred clips.
    """
    import pandas as pd

    def each(pdf: pd.DataFrame) -> pd.DataFrame:
        taken: dict[int, tuple[float, float]] = {}
        for members in pdf.sort_values("place")["members"]:
            if len(taken) >= most or sum(seconds for _, seconds in taken.values()) >= budget_s:
                break
            free = [m for m in members if m["id"] not in taken]
            near = [taken[m["id"]][0] for m in members if m["id"] in taken]
            pick = next((m for m in free if all(abs(m["at_s"] - t) >= apart_s for t in near)), free[0] if free else None)
            if pick is not None:
                taken[pick["id"]] = (pick["at_s"], pick["seconds"])
        ids = sorted(taken, key=lambda i: (taken[i][0], i))
        return pd.DataFrame({"period": pdf["period"].iloc[0], "place": range(1, len(ids) + 1), "id": ids})

    return reel_offers(candidates, long_s=long_s).groupBy("period").applyInPandas(each, "period long, place long, id long")
