"""Queries of the period digest and the reel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import micros, upper_median
from visitlens.operators import digest
from visitlens.plans.intervals import a25_dark_seconds, j10_clip_at
from visitlens.plans.profiles import named_visits
from visitlens.plans.registry import CLIPS, DET, STAMPED, VISITS, register
from visitlens.sources.fixtures import Tables

PER = """per AS (SELECT d.*, CAST(floor((epoch_us(ts) / 3.6e9 - 6) / 12) AS BIGINT) AS period, max(CAST(floor((epoch_us(ts) / 3.6e9 - 6) / 12) AS BIGINT)) OVER () AS now FROM detections d)"""
START = "TIMESTAMP '1970-01-01 00:00:00' + to_hours(CAST({0} * 12 + 6 AS INTEGER))"


def per(t: Tables) -> DataFrame:
    return digest.with_period(t.detections)


@register(f"WITH {PER} SELECT period, {START.format('period')} AS starts, CASE WHEN period % 2 = 0 THEN 'day' ELSE 'night' END AS kind, count(*) AS n FROM per WHERE period < now GROUP BY period", *DET)
def d2_completed_periods(t: Tables) -> DataFrame:
    done = per(t).where("period < now").groupBy("period").agg(F.count(F.lit(1)).alias("n"))
    return done.select("period", digest.period_start("period").alias("starts"), F.when(F.col("period") % 2 == 0, "day").otherwise("night").alias("kind"), "n")


@register(f"WITH {PER} SELECT DISTINCT period FROM per WHERE period < now AND (now - period) % 2 = 0 ORDER BY period DESC LIMIT 12", *DET)
def d3_prior_periods(t: Tables) -> DataFrame:
    return per(t).where("period < now and (now - period) % 2 = 0").select("period").distinct().orderBy(F.desc("period")).limit(12)


@register(f"WITH {PER} SELECT max(period) AS period FROM per", *DET)
def d5_back_off(t: Tables) -> DataFrame:
    return per(t).agg(F.max("period").alias("period"))


@register(f"WITH {PER} SELECT id, species FROM per WHERE period = now", *DET)
def d6_in_period(t: Tables) -> DataFrame:
    return per(t).where("period = now").select("id", "species")


@register("SELECT CAST(floor((epoch_us(started_at) / 3.6e9 - 6) / 12) AS BIGINT) AS period, species, count(*) AS visits FROM (SELECT DISTINCT source, started_at, species FROM stamped) GROUP BY ALL", *STAMPED)
def d7_visits_by_label(t: Tables) -> DataFrame:
    rows = t.stamped.select("source", "started_at", "species").distinct()
    return rows.groupBy(digest.period_of("started_at").alias("period"), "species").agg(F.count(F.lit(1)).alias("visits"))


@register(
    """SELECT s.source, s.started_at, string_agg(DISTINCT s.species, ',' ORDER BY s.species) AS labels, count(*) AS crops FROM stamped s
    WHERE CAST(floor((epoch_us(s.started_at) / 3.6e9 - 6) / 12) AS BIGINT) = (SELECT max(CAST(floor((epoch_us(started_at) / 3.6e9 - 6) / 12) AS BIGINT)) FROM stamped) GROUP BY s.source, s.started_at""",
    *STAMPED,
)
def d8_visit_log(t: Tables) -> DataFrame:
    rows = digest.with_period(t.stamped, "started_at").where("period = now")
    return rows.groupBy("source", "started_at").agg(F.array_join(F.array_sort(F.collect_set("species")), ",").alias("labels"), F.count(F.lit(1)).alias("crops"))


@register("SELECT source, started_at, individual, count(*) AS crops FROM stamped GROUP BY ALL HAVING count(*) >= 2", *STAMPED)
def d9_named_of(t: Tables) -> DataFrame:
    return t.stamped.groupBy("source", "started_at", "individual").agg(F.count(F.lit(1)).alias("crops")).where("crops >= 2")


@register(
    """WITH h AS (SELECT species, hour(ts) AS hour, count(*) AS n FROM detections GROUP BY ALL)
    SELECT s.species, string_agg(CAST(coalesce(h.n, 0) AS VARCHAR), ',' ORDER BY r.r) AS hours FROM (SELECT DISTINCT species FROM h) s CROSS JOIN range(0, 24) r(r) LEFT JOIN h ON h.species = s.species AND h.hour = r.r GROUP BY s.species""",
    *DET,
)
def d10_hour_histogram(t: Tables) -> DataFrame:
    hours = [F.count_if(F.hour("ts") == h).cast("string") for h in range(24)]
    return t.detections.groupBy("species").agg(F.concat_ws(",", *hours).alias("hours"))


@register(
    f"""WITH {PER}, h AS (SELECT DISTINCT individual, (now - period) // 2 AS back FROM per WHERE (now - period) % 2 = 0), p AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY back) - 1 AS place FROM h)
    SELECT individual, count(*) AS streak FROM p WHERE back = place GROUP BY individual""",
    *DET,
)
def d11_streaks(t: Tables) -> DataFrame:
    return digest.streaks(per(t), "individual")


@register(f"WITH {PER} SELECT species, count(*) AS crops, min(ts) AS first, max(ts) AS last, arg_min(id, (-confidence, ts, id)) AS rep_id FROM per WHERE period = now GROUP BY species", *DET)
def d12_species_roll(t: Tables) -> DataFrame:
    best = F.struct((-F.col("confidence")).alias("worse"), "ts", "id")
    return per(t).where("period = now").groupBy("species").agg(F.count(F.lit(1)).alias("crops"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.min_by("id", best).alias("rep_id"))


@register(
    f"""WITH {PER} SELECT individual, count(*) FILTER (period = now) AS crops, round((epoch_us({START.format('any_value(now)')}) - epoch_us(max(ts) FILTER (period < now))) / 8.64e10, 3) AS days
    FROM per GROUP BY individual HAVING count(*) FILTER (period = now) > 0""",
    *DET,
)
def d13_novelty(t: Tables) -> DataFrame:
    return digest.novelty(per(t), "individual")


@register(
    f"""WITH {PER}, s AS (SELECT individual, count(*) FILTER (period = now) AS crops, avg(CASE WHEN (now - period) % 2 = 0 THEN 1.0 ELSE 0.0 END) AS share FROM per GROUP BY individual)
    SELECT individual, crops, round(share, 6) AS share, share < 0.15 AS surprising FROM s WHERE crops > 0""",
    *DET,
)
def d14_surprises(t: Tables) -> DataFrame:
    return digest.surprises(per(t), "individual")


@register(
    f"""WITH {PER}, n AS (SELECT individual, count(*) FILTER (period = now) AS crops, round((epoch_us({START.format('any_value(now)')}) - epoch_us(max(ts) FILTER (period < now))) / 8.64e10, 3) AS days, count(*) AS total
    FROM per GROUP BY individual HAVING count(*) FILTER (period = now) > 0) SELECT individual, crops, days FROM n WHERE days IS NULL OR days >= 3 ORDER BY total, individual LIMIT 6""",
    *DET,
)
def d15_novel_headline(t: Tables) -> DataFrame:
    rows = per(t)
    total = rows.groupBy("individual").agg(F.count(F.lit(1)).alias("total"))
    found = digest.novelty(rows, "individual").where("days is null or days >= 3").join(total, "individual")
    return found.orderBy("total", "individual").limit(6).select("individual", "crops", "days")


@register(
    f"""WITH {PER}, h AS (SELECT DISTINCT individual, (now - period) // 2 AS back FROM per WHERE (now - period) % 2 = 0 AND period >= now - 24)
    SELECT individual, count(*) FILTER (back > 0) AS present, min(back) AS since FROM h GROUP BY individual HAVING min(back) > 0 AND count(*) FILTER (back > 0) >= 0.4 * 12""",
    *DET,
)
def d16_quiet_regulars(t: Tables) -> DataFrame:
    return digest.quiet_regulars(per(t), "individual")


@register(
    f"""WITH {PER}, c AS (SELECT * FROM per WHERE period = now), h AS (SELECT hour(ts) AS hour, count(*) AS n FROM c GROUP BY hour(ts))
    SELECT arg_min(id, (-confidence, id)) AS plate, arg_min(id, (ts, id)) AS first_id, arg_max(id, (ts, id)) AS last_id, (SELECT arg_min(hour, (-n, hour)) FROM h) AS busiest FROM c""",
    *DET,
)
def d17_plate(t: Tables) -> DataFrame:
    c = per(t).where("period = now")
    h = c.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n")).agg(F.min_by("hour", F.struct((-F.col("n")).alias("less"), "hour")).alias("busiest"))
    out = c.agg(F.min_by("id", F.struct((-F.col("confidence")).alias("w"), "id")).alias("plate"), F.min_by("id", F.struct("ts", "id")).alias("first_id"), F.max_by("id", F.struct("ts", "id")).alias("last_id"))
    return out.crossJoin(h)


@register(
    """WITH m AS (SELECT d.id, arg_min(c.clip_id, (-c.detections, c.start_at)) AS clip_id, any_value(d.confidence) AS confidence FROM detections d JOIN clips c ON d.source = c.source AND d.ts BETWEEN c.start_at AND c.end_at GROUP BY d.id),
    b AS (SELECT clip_id, max(confidence) AS score, arg_min(id, (-confidence, id)) AS id FROM m GROUP BY clip_id),
    k AS (SELECT list_sort(list(score))[count(*) // 2 + 1] AS mid FROM b), s AS (SELECT clip_id, id, score FROM b, k WHERE score >= 0.45 * mid ORDER BY score DESC, id LIMIT 24) SELECT clip_id, id, score FROM s""",
    *CLIPS,
)
def d18_reel_shortlist(t: Tables) -> DataFrame:
    m = j10_clip_at(t).join(t.detections.select("id", "confidence"), "id")
    best = m.groupBy("clip_id").agg(F.max("confidence").alias("score"), F.min_by("id", F.struct((-F.col("confidence")).alias("w"), "id")).alias("id"))
    rank = best.agg(upper_median("score").alias("mid"))
    return best.crossJoin(F.broadcast(rank)).where("score >= 0.45 * mid").orderBy(F.desc("score"), "id").limit(24).select("clip_id", "id", "score")


@register(f"WITH {PER} SELECT max(period) FILTER (period < now) AS before, min(period) AS oldest, max(now) AS newest FROM per", *DET)
def d21_anchors(t: Tables) -> DataFrame:
    return per(t).agg(F.max(F.when(F.col("period") < F.col("now"), F.col("period"))).alias("before"), F.min("period").alias("oldest"), F.max("now").alias("newest"))


@register("SELECT date_diff('day', CAST(min(ts) AS DATE), CAST(max(ts) AS DATE)) + 1 AS issue FROM detections", *DET)
def d22_issue_number(t: Tables) -> DataFrame:
    return t.detections.agg((F.datediff(F.to_date(F.max("ts")), F.to_date(F.min("ts"))) + 1).cast("long").alias("issue"))


@register(f"WITH {PER} SELECT individual, count(*) AS n FROM per WHERE period = now GROUP BY individual ORDER BY n DESC, individual", *DET)
def d23_present_names(t: Tables) -> DataFrame:
    return per(t).where("period = now").groupBy("individual").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "individual")


@register(
    """WITH p AS (SELECT source AS clip, epoch_us(ts) AS t, confidence AS weight FROM detections), s AS (SELECT clip, t, round(sum(weight) OVER (PARTITION BY clip ORDER BY t RANGE BETWEEN CURRENT ROW AND 43200000000 FOLLOWING), 9) AS held FROM p)
    SELECT clip, arg_min(t, (-held, t)) AS t, max(held) AS held FROM s GROUP BY clip""",
    *DET,
)
def w8_sliding_window(t: Tables) -> DataFrame:
    return digest.sliding_best(t.detections.select(F.col("source").alias("clip"), micros("ts").alias("t"), F.col("confidence").alias("weight")), 43_200_000_000)


BURSTS = f"""WITH {PER}, f AS (SELECT *, CASE WHEN lag(species) OVER w IS NULL OR lag(species) OVER w <> species OR ts - lag(ts) OVER w > INTERVAL 480 SECOND THEN 1 ELSE 0 END AS fresh FROM per WINDOW w AS (PARTITION BY period ORDER BY ts, id))"""


@register(BURSTS + " SELECT period, id, CAST(sum(fresh) OVER (PARTITION BY period ORDER BY ts, id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS burst FROM f", *DET)
def w9_reel_bursts(t: Tables) -> DataFrame:
    return digest.reel_bursts(per(t)).select("period", "id", "burst")


@register()
def w10_reel_selection(t: Tables) -> DataFrame:
    """Moments of two to six seconds, some of them named, scored by confidence, movement and name, then chosen greedily."""
    rows = digest.reel_bursts(per(t))
    score = F.col("confidence") * (0.7 + 0.8 * F.col("k") / 100) * F.when(F.col("k") >= 50, 1.2).otherwise(1.0)
    named = F.when(F.col("k") >= 90, F.array("individual"))
    return digest.select_reel(rows.select("period", "id", "ts", "species", "burst", named.alias("individuals"), score.alias("score"), F.lit(1).alias("n"), (2.0 + F.col("k") % 5).alias("seconds")))


@register()
def w11_reel_plan(t: Tables) -> DataFrame:
    """The chosen moments of each period with where they begin in the reel."""
    chosen = w10_reel_selection(t).join(per(t).select("id", (2.0 + F.col("k") % 5).alias("seconds")), "id")
    before = Window.partitionBy("period").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)  # 14 moments at most
    return chosen.select("period", "place", "id", F.coalesce(F.sum("seconds").over(before), F.lit(0.0)).alias("begins_s"))


@register("SELECT CAST(floor((epoch_us(v.started_at) / 3.6e9 - 6) / 12) AS BIGINT) AS period, s.species, count(*) AS visits, CAST(sum(v.n) AS BIGINT) AS crops FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at GROUP BY ALL", *VISITS, "votes", "visit_species")
def d1_period_species(t: Tables) -> DataFrame:
    return named_visits(t).groupBy(digest.period_of("started_at").alias("period"), "species").agg(F.count(F.lit(1)).alias("visits"), F.sum("n").alias("crops"))


@register()
def d19_coverage(t: Tables) -> DataFrame:
    dark = a25_dark_seconds(t)
    return dark.groupBy(digest.period_of("started_at").alias("period")).agg(F.sum("dark_s").alias("dark_s"), F.count("dark_s").alias("known"))


@register(f"WITH {PER} SELECT max(period) FILTER (period < now AND period % 2 = 0) AS day_period, max(period) FILTER (period < now AND period % 2 <> 0) AS night_period FROM per", *DET)
def d4_resolution(t: Tables) -> DataFrame:
    """The newest completed day and night."""
    done = lambda odd: F.max(F.when((F.col("period") < F.col("now")) & ((F.col("period") % 2 != 0) == odd), F.col("period")))
    return per(t).agg(done(False).alias("day_period"), done(True).alias("night_period"))
