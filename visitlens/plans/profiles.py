"""Queries of profiles, clocks, shares and interactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import behaviour_tag, hour_label, in_window, iso_week, mean_in_order, micros, night_key, upper_median
from visitlens.operators import profiles, sessions
from visitlens.plans.registry import DET, STAMPED, VISITS, register
from visitlens.sources.fixtures import Tables

VS = (*VISITS, "votes", "visit_species")


def named_visits(t: Tables) -> DataFrame:
    return t.visits.join(sessions.winners(sessions.votes(t.stamped)).drop("margin"), ["source", "started_at"])


@register("SELECT source, count(*) AS n, avg(confidence) AS avg_confidence, min(ts) AS first, max(ts) AS last FROM detections GROUP BY source", *DET)
def a7_by_source(t: Tables) -> DataFrame:
    return t.detections.groupBy("source").agg(F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.min("ts").alias("first"), F.max("ts").alias("last"))


@register(
    """WITH n AS (SELECT CAST(ts AS DATE) AS day, species, count(*) AS n FROM detections GROUP BY ALL)
    SELECT day, string_agg(species || '=' || n, ',' ORDER BY n DESC, species) AS tally FROM n GROUP BY day""",
    *DET, dates=("day",))
def a7_by_day_classes(t: Tables) -> DataFrame:
    return profiles.tally_map(t.detections.withColumn("day", F.to_date("ts")), "day", "species")


@register("SELECT hour(ts) AS hour, count(*) AS n FROM detections GROUP BY hour(ts)", *DET)
def a7_by_hour(t: Tables) -> DataFrame:
    return t.detections.groupBy(F.hour("ts").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT CAST(started_at AS DATE) AS day, count(*) AS visits, CAST(sum(n) AS BIGINT) AS crops FROM visits GROUP BY CAST(started_at AS DATE)", *VISITS, dates=("day",))
def a7_visits_by_day(t: Tables) -> DataFrame:
    return t.visits.groupBy(F.to_date("started_at").alias("day")).agg(F.count(F.lit(1)).alias("visits"), F.sum("n").alias("crops"))


@register("SELECT source, started_at, n FROM visits ORDER BY started_at DESC, source LIMIT 20", *VISITS)
def a7_recent_visits(t: Tables) -> DataFrame:
    return t.visits.select("source", "started_at", "n").orderBy(F.desc("started_at"), "source").limit(20)


@register(
    """SELECT species, count(*) AS n, avg(confidence) AS avg_confidence, count(*) FILTER (k >= 80) AS verified, count(*) FILTER (k < 5) AS rejected,
    arg_min(id, (k < 80, -confidence, id)) AS sample_id FROM detections WHERE species NOT IN ('error') GROUP BY species""",
    *DET,
)
def a8_species_overview(t: Tables) -> DataFrame:
    best = F.struct((F.col("k") < 80).alias("unsure"), (-F.col("confidence")).alias("worse"), "id")
    return t.detections.where(~F.lower("species").isin("error")).groupBy("species").agg(
        F.count(F.lit(1)).alias("n"), F.avg("confidence").alias("avg_confidence"), F.count_if(F.col("k") >= 80).alias("verified"), F.count_if(F.col("k") < 5).alias("rejected"), F.min_by("id", best).alias("sample_id")
    )


@register("SELECT DISTINCT species FROM detections WHERE lower(species) NOT IN ('error', 'signup')", *DET)
def p5_denylist(t: Tables) -> DataFrame:
    return t.detections.where(~F.lower("species").isin("error", "signup")).select("species").distinct()


@register(
    """WITH r AS (SELECT *, row_number() OVER (PARTITION BY individual ORDER BY confidence DESC, id) AS rk FROM detections),
    s AS (SELECT individual, species, count(*) AS n, min((ts, id)) AS f FROM detections GROUP BY ALL)
    SELECT r.individual, count(*) AS n, min(ts) AS first, max(ts) AS last, string_agg(CAST(id AS VARCHAR), ',' ORDER BY rk) FILTER (rk <= 6) AS top,
    any_value(d.species) AS species FROM r JOIN (SELECT individual, arg_min(species, (-n, f)) AS species FROM s GROUP BY individual) d ON r.individual = d.individual GROUP BY r.individual""",
    *DET,
)
def a9_individuals_overview(t: Tables) -> DataFrame:
    d = t.detections
    head = d.groupBy("individual").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    top = profiles.top_per_group(d, "individual", 6, F.desc("confidence"), F.col("id"))
    top = top.groupBy("individual").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "id"))), lambda x: x["id"].cast("string")), ",").alias("top"))
    mode = d.groupBy("individual", "species").agg(F.count(F.lit(1)).alias("c"), F.min(F.struct("ts", "id")).alias("f"))
    mode = mode.groupBy("individual").agg(F.min_by("species", F.struct((-F.col("c")).alias("less"), "f")).alias("species"))
    return head.join(top, "individual").join(mode, "individual")


ARRIVALS = """WITH h AS (SELECT s.species, hour(v.started_at) AS hour, count(*) AS n FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at GROUP BY ALL),
    t AS (SELECT species, CAST(sum(n) AS BIGINT) AS total FROM h GROUP BY species)"""


@register(
    ARRIVALS + """, r AS (SELECT h.species, h.hour, h.n, row_number() OVER (PARTITION BY h.species ORDER BY h.n DESC, h.hour) AS peak FROM h JOIN t ON h.species = t.species
    WHERE t.total >= 8 AND h.n >= greatest(2, floor(t.total * 0.045 + 0.999))) SELECT species, hour, n, peak FROM r WHERE peak <= 3""",
    *VS,
)
def a10_arrival_peaks(t: Tables) -> DataFrame:
    h = named_visits(t).groupBy("species", F.hour("started_at").cast("long").alias("hour")).agg(F.count(F.lit(1)).alias("n"))
    total = h.groupBy("species").agg(F.sum("n").alias("total")).where("total >= 8")
    high = h.join(total, "species").where(F.col("n") >= F.greatest(F.lit(2), F.floor(F.col("total") * 0.045 + 0.999)))
    return profiles.top_per_group(high, "species", 3, F.desc("n"), F.col("hour")).select("species", "hour", "n", F.col("rank").alias("peak"))


@register("SELECT species, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM detections GROUP BY ALL", *DET)
def a11_weeks(t: Tables) -> DataFrame:
    return t.detections.groupBy("species", iso_week("ts").alias("week")).agg(F.count(F.lit(1)).alias("n"))


@register(
    """WITH n AS (SELECT species, strftime(ts, '%G-W%V') AS week, count(*) AS n FROM detections GROUP BY ALL)
    SELECT s.species, w.week, coalesce(n.n, 0) AS n FROM (SELECT DISTINCT species FROM n) s CROSS JOIN (SELECT DISTINCT week FROM n) w LEFT JOIN n ON n.species = s.species AND n.week = w.week""",
    *DET,
)
def a11_weeks_filled(t: Tables) -> DataFrame:
    """Zero counts too: the weeks, which the calendar bounds, are carried as one array beside each species."""
    n = a11_weeks(t)
    weeks = n.agg(F.array_sort(F.collect_set("week")).alias("weeks"))
    each = n.groupBy("species").agg(F.map_from_entries(F.collect_list(F.struct("week", "n"))).alias("by"))
    return each.join(F.broadcast(weeks)).select("species", "by", F.explode("weeks").alias("week")).select("species", "week", F.coalesce(F.col("by")[F.col("week")], F.lit(0)).cast("long").alias("n"))


@register(
    """WITH f AS (SELECT k, min(CAST(ts AS DATE)) AS day FROM detections GROUP BY k), g AS (SELECT day, count(*) AS fresh FROM f GROUP BY day)
    SELECT day, fresh, CAST(sum(fresh) OVER (ORDER BY day) AS BIGINT) AS total FROM g""",
    *DET, dates=("day",))
def w7_accumulation(t: Tables) -> DataFrame:
    return profiles.accumulation(t.detections, "k")


ROLL = """WITH d AS (SELECT DISTINCT individual, CAST(ts AS DATE) AS day FROM detections),
    g AS (SELECT *, date_diff('day', lag(day) OVER (PARTITION BY individual ORDER BY day), day) AS gap FROM d),
    a AS (SELECT individual, count(*) AS days, list_sort(list(gap) FILTER (gap IS NOT NULL))[count(gap) // 2 + 1] AS gap_median,
      date_diff('day', max(day), DATE '2024-02-05') AS days_since FROM g GROUP BY individual)"""


@register(ROLL + " SELECT individual, days, gap_median, days_since, days >= 3 AS regular, days >= 3 AND days_since > greatest(2, 2 * coalesce(gap_median, 0)) AS overdue FROM a", *DET)
def a12_roll_call(t: Tables) -> DataFrame:
    return profiles.roll_call(t.detections, "individual", F.lit("2024-02-05").cast("date"))


@register("WITH d AS (SELECT DISTINCT individual, CAST(ts AS DATE) AS day FROM detections) SELECT individual, day, date_diff('day', lag(day) OVER (PARTITION BY individual ORDER BY day), day) AS gap FROM d", *DET, dates=("day",))
def w6_day_gaps(t: Tables) -> DataFrame:
    days = t.detections.select("individual", F.to_date("ts").alias("day")).distinct()
    return days.withColumn("gap", F.datediff("day", F.lag("day").over(Window.partitionBy("individual").orderBy("day"))).cast("long"))


@register(
    """WITH x AS (SELECT v.*, s.species, (epoch_us(v.ended_at) - epoch_us(v.started_at)) / 1e6 AS dwell FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at),
    h AS (SELECT species, hour(started_at) AS hour, count(*) AS n FROM x GROUP BY ALL)
    SELECT x.species, count(*) AS visits, count(DISTINCT CAST(started_at AS DATE)) AS days, round(count(*) / count(DISTINCT CAST(started_at AS DATE)), 6) AS per_day,
    min(started_at) AS first, max(ended_at) AS last, any_value(p.peak) AS peak, list_sort(list(dwell))[count(*) // 2 + 1] AS dwell_median, max(dwell) AS dwell_max,
    round(sum(n) / count(*), 6) AS crops_per_visit FROM x JOIN (SELECT species, arg_min(hour, (-n, hour)) AS peak FROM h GROUP BY species) p ON x.species = p.species GROUP BY x.species""",
    *VS,
)
def a13_species_profile(t: Tables) -> DataFrame:
    x = named_visits(t).withColumn("dwell", (micros("ended_at") - micros("started_at")) / 1e6)
    peak = profiles.hour_counts(x, "species", "started_at").groupBy("species").agg(F.min_by("hour", F.struct((-F.col("n")).alias("less"), "hour")).alias("peak"))
    days = F.count_distinct(F.to_date("started_at"))
    return x.groupBy("species").agg(
        F.count(F.lit(1)).alias("visits"), days.alias("days"), F.round(F.count(F.lit(1)) / days, 6).alias("per_day"), F.min("started_at").alias("first"), F.max("ended_at").alias("last"),
        upper_median("dwell").alias("dwell_median"), F.max("dwell").alias("dwell_max"), F.round(F.sum("n") / F.count(F.lit(1)), 6).alias("crops_per_visit"),
    ).join(peak, "species")


def window_sql(rows: str, coverage: float) -> str:
    return f"""WITH h AS ({rows}), t AS (SELECT key, sum(n) AS total FROM h GROUP BY key),
    r AS (SELECT t.key, w.w AS width, s.s AS start, any_value(t.total) AS total, coalesce(sum(h.n), 0) AS held FROM t CROSS JOIN range(1, 25) w(w) CROSS JOIN range(0, 24) s(s)
      LEFT JOIN h ON h.key = t.key AND (h.hour - s.s + 24) % 24 < w.w GROUP BY t.key, w.w, s.s),
    b AS (SELECT key, min((width, start)) AS x FROM r WHERE held >= {coverage} * total GROUP BY key)
    SELECT key AS species, x[2] AS start_hour, (x[2] + x[1] - 1) % 24 AS end_hour FROM b"""


@register(
    window_sql("SELECT s.species AS key, hour(v.started_at) AS hour, count(*) AS n FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at GROUP BY ALL", 0.8), *VS
)
def a14_typical_window(t: Tables) -> DataFrame:
    return profiles.typical_window(profiles.hour_counts(named_visits(t), "species", "started_at"), "species", 0.8)


@register(window_sql("SELECT species AS key, hour(ts) AS hour, count(*) AS n FROM detections GROUP BY ALL", 0.7), *DET)
def a15_typical_window_crops(t: Tables) -> DataFrame:
    return profiles.typical_window(profiles.hour_counts(t.detections, "species"), "species", 0.7)


SUN = """WITH x AS (SELECT s.species, v.started_at AS moment FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at),
    n AS (SELECT species, 2 * count(*) FILTER (hour(moment) < 6 OR hour(moment) >= 18) > count(*) AS nocturnal FROM x GROUP BY species),
    m AS (SELECT x.species, n.nocturnal, CASE WHEN n.nocturnal THEN (epoch_us(moment) - epoch_us(date_trunc('day', moment) + CASE WHEN hour(moment) < 6 THEN INTERVAL (-6) HOUR ELSE INTERVAL 18 HOUR END)) / 6e7
      ELSE (epoch_us(moment) - epoch_us(date_trunc('day', moment) + INTERVAL 6 HOUR)) / 6e7 END AS minutes FROM x JOIN n ON x.species = n.species)"""


@register(SUN + " SELECT species, nocturnal, count(*) AS n, list_sort(list(minutes))[count(*) // 2 + 1] AS minutes FROM m GROUP BY species, nocturnal", *VS)
def a16_sun_anchor(t: Tables) -> DataFrame:
    """Minutes after dusk of nocturnal species, else after dawn; the fixed sun of 6 and 18 o'clock."""
    x = named_visits(t).select("species", F.col("started_at").alias("moment"))
    dark = (F.hour("moment") < 6) | (F.hour("moment") >= 18)
    kind = x.groupBy("species").agg((2 * F.count_if(dark) > F.count(F.lit(1))).alias("nocturnal"))
    shift = F.when(~F.col("nocturnal"), 6).when(F.hour("moment") < 6, -6).otherwise(18)
    minutes = (micros("moment") - micros(F.date_trunc("day", "moment").cast("timestamp_ntz")) - shift * 3_600_000_000) / 6e7
    x = x.join(kind, "species").withColumn("minutes", minutes)
    return x.groupBy("species", "nocturnal").agg(F.count(F.lit(1)).alias("n"), upper_median("minutes").alias("minutes"))


@register(
    """WITH n AS (SELECT v.source, s.species, v.started_at, v.ended_at FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at),
    p AS (SELECT a.species AS a, b.species AS b, a.source, a.started_at, min(b.started_at) AS nxt, any_value(a.ended_at) AS ended_at FROM n a JOIN n b ON a.source = b.source AND a.species <> b.species
      AND b.started_at > a.ended_at AND b.started_at <= a.ended_at + INTERVAL 24 HOUR GROUP BY ALL)
    SELECT a, b, count(*) AS events, list_sort(list(epoch_us(nxt) - epoch_us(ended_at)))[count(*) // 2 + 1] / 1e6 AS lag_s FROM p GROUP BY a, b HAVING count(*) >= 8""",
    *VS,
)
def a17_interactions(t: Tables) -> DataFrame:
    """The next visit of another species after each visit, within a day: events and upper-middle lag by pair of species."""
    n = named_visits(t)
    width = 24 * 3_600_000_000
    day = F.floor(micros("ended_at") / width)
    a = n.select("source", F.col("species").alias("a"), F.col("started_at").alias("a_at"), micros("ended_at").alias("a_end"), F.explode(F.array(day, day + 1)).alias("bucket"))
    b = n.select("source", F.col("species").alias("b"), micros("started_at").alias("b_at"), F.floor(micros("started_at") / width).alias("bucket"))
    after = a.join(b, ["source", "bucket"]).where((F.col("a") != F.col("b")) & (F.col("b_at") > F.col("a_end")) & (F.col("b_at") - F.col("a_end") <= width))
    lag = after.groupBy("a", "b", "source", "a_at", "a_end").agg(F.min("b_at").alias("nxt")).withColumn("lag", F.col("nxt") - F.col("a_end"))
    return lag.groupBy("a", "b").agg(F.count(F.lit(1)).alias("events"), (upper_median("lag") / 1e6).alias("lag_s")).where("events >= 8")


@register(
    """SELECT CAST(started_at - INTERVAL 12 HOUR AS DATE) AS night, count(*) AS visits FROM visits WHERE hour(started_at) < 6 OR hour(started_at) >= 18 GROUP BY ALL ORDER BY night DESC LIMIT 90""", *VISITS, dates=("night",))
def a18_nocturnal_nights(t: Tables) -> DataFrame:
    dark = (F.hour("started_at") < 6) | (F.hour("started_at") >= 18)
    return t.visits.where(dark).groupBy(night_key("started_at").alias("night")).agg(F.count(F.lit(1)).alias("visits")).orderBy(F.desc("night")).limit(90)


@register("WITH s AS (SELECT DISTINCT source, started_at, species FROM stamped) SELECT x.species AS a, y.species AS b, count(*) AS visits FROM s x JOIN s y ON x.source = y.source AND x.started_at = y.started_at AND x.species < y.species GROUP BY ALL", *STAMPED)
def j21_co_occurrence(t: Tables) -> DataFrame:
    return profiles.co_occurrence(t.stamped)


MOTION = "least(1.0, (k + 1) / 100.0)"


@register(
    f"""SELECT source, started_at, avg({MOTION}) AS moving_frac, max(value) AS peak, CASE WHEN avg(nullif(k, 0) / 50.0) > 1.15 THEN 'approaching' WHEN avg(nullif(k, 0) / 50.0) < 0.85 THEN 'retreating'
    WHEN avg(nullif(k, 0)) IS NOT NULL THEN 'steady' END AS approach FROM stamped GROUP BY source, started_at""",
    *STAMPED,
)
def a20_visit_motion(t: Tables) -> DataFrame:
    from visitlens.functions.columns import approach_label

    moving = F.least(F.lit(1.0), (F.col("k") + 1) / 100.0)
    trend = mean_in_order(F.nullif("k", F.lit(0)) / 50.0, "ts", "id")
    rows = t.stamped.groupBy("source", "started_at").agg(mean_in_order(moving, "ts", "id").alias("moving_frac"), F.max("value").alias("peak"), trend.alias("trend"))
    return rows.select("source", "started_at", "moving_frac", "peak", approach_label("trend").alias("approach"))


@register(
    """SELECT individual, count(*) AS tracks, avg(value) AS mean_speed, list_sort(list(value))[count(*) // 2 + 1] AS median_speed, count(*) FILTER (nullif(k, 0) / 50.0 > 1.15) AS approaching,
    count(*) FILTER (nullif(k, 0) / 50.0 < 0.85) AS retreating, count(*) FILTER (nullif(k, 0) / 50.0 BETWEEN 0.85 AND 1.15) AS steady FROM detections GROUP BY individual""",
    *DET,
)
def a21_individual_motion(t: Tables) -> DataFrame:
    trend = F.nullif("k", F.lit(0)) / 50.0
    return t.detections.groupBy("individual").agg(
        F.count(F.lit(1)).alias("tracks"), F.avg("value").alias("mean_speed"), upper_median("value").alias("median_speed"),
        F.count_if(trend > 1.15).alias("approaching"), F.count_if(trend < 0.85).alias("retreating"), F.count_if(trend.between(0.85, 1.15)).alias("steady"),
    )


TAGS = f"""WITH g AS (SELECT source, started_at, species, (epoch_us(max(ts)) - epoch_us(min(ts))) / 6e7 AS minutes, avg({MOTION}) AS f, avg(value) / 500 AS s FROM stamped GROUP BY ALL),
    t AS (SELECT species, CASE WHEN minutes >= 2 AND f < 0.5 THEN 'fed here' WHEN f >= 0.5 AND s >= 0.5 THEN 'passed through' ELSE 'lingered' END AS tag FROM g)"""


@register(TAGS + " SELECT species, tag, count(*) AS visits, count(*) / sum(count(*)) OVER (PARTITION BY species) AS share FROM t GROUP BY species, tag", *STAMPED)
def a22_behaviour_share(t: Tables) -> DataFrame:
    moving = F.least(F.lit(1.0), (F.col("k") + 1) / 100.0)
    g = t.stamped.groupBy("source", "started_at", "species").agg(((micros(F.max("ts")) - micros(F.min("ts"))) / 6e7).alias("minutes"), mean_in_order(moving, "ts", "id").alias("f"), (mean_in_order("value", "ts", "id") / 500).alias("s"))
    tags = g.select("species", behaviour_tag("minutes", "f", "s").alias("tag")).groupBy("species", "tag").agg(F.count(F.lit(1)).alias("visits"))
    return tags.withColumn("share", F.col("visits") / F.sum("visits").over(Window.partitionBy("species")))


@register(
    """WITH v AS (SELECT source, started_at, individual, count(*) AS n, min((ts, id)) AS f FROM stamped WHERE k >= 50 GROUP BY ALL)
    SELECT source, started_at, arg_min(individual, (-n, f)) AS individual FROM v GROUP BY source, started_at""",
    *STAMPED,
)
def a23_visit_labels(t: Tables) -> DataFrame:
    return sessions.winners(sessions.votes(t.stamped.where("k >= 50"), value="individual"), "individual").drop("margin")


@register("SELECT DISTINCT source, started_at FROM stamped WHERE k < 3", *STAMPED)
def a24_rejected_visits(t: Tables) -> DataFrame:
    return t.stamped.where("k < 3").select("source", "started_at").distinct()


@register(
    "SELECT source, count(*) AS n, count(DISTINCT species) AS kinds, string_agg(DISTINCT species, ',' ORDER BY species) AS names, min(ts) AS first, max(ts) AS last, count(*) FILTER (k < 50) AS low FROM detections GROUP BY source", *DET
)
def a29_reference_summary(t: Tables) -> DataFrame:
    return t.detections.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("species").alias("kinds"), F.array_join(F.array_sort(F.collect_set("species")), ",").alias("names"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("k") < 50).alias("low")
    )


@register("SELECT count(*) AS pool, count(*) FILTER (n >= 2) AS enough, count(*) FILTER (n >= 2 AND max_confidence >= 0.5) AS confident, count(DISTINCT source) FILTER (n >= 2 AND max_confidence >= 0.5) AS sources FROM visits", *VISITS)
def a30_funnel(t: Tables) -> DataFrame:
    enough = F.col("n") >= 2
    sure = enough & (F.col("max_confidence") >= 0.5)
    return t.visits.agg(F.count(F.lit(1)).alias("pool"), F.count_if(enough).alias("enough"), F.count_if(sure).alias("confident"), F.count_distinct(F.when(sure, F.col("source"))).alias("sources"))


@register(
    """SELECT individual, count(*) AS templates, max(ts) AS newest, round((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(max(ts))) / 86400e6, 1) AS age_days,
    CASE WHEN round((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(max(ts))) / 86400e6, 1) >= 14 THEN 'lapsed'
    WHEN round((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(max(ts))) / 86400e6, 1) >= 7 THEN 'fading' ELSE 'fresh' END AS state FROM detections WHERE species = 'purchase' GROUP BY individual""",
    *DET,
)
def a32_template_freshness(t: Tables) -> DataFrame:
    from visitlens.functions.columns import days_since, lapse_state

    rows = t.detections.where("species = 'purchase'").groupBy("individual").agg(F.count(F.lit(1)).alias("templates"), F.max("ts").alias("newest"))
    rows = rows.withColumn("age_days", days_since("newest", F.lit("2024-02-05").cast("timestamp_ntz")))
    return rows.withColumn("state", lapse_state("age_days", "templates"))


@register("SELECT CAST(ts AS DATE) AS day, count(*) AS n FROM detections WHERE species = 'error' GROUP BY ALL", *DET, dates=("day",))
def a33_per_day_suppressed(t: Tables) -> DataFrame:
    return t.detections.where("species = 'error'").groupBy(F.to_date("ts").alias("day")).agg(F.count(F.lit(1)).alias("n"))


@register("SELECT count(DISTINCT CAST(ts AS DATE)) AS days, count(DISTINCT species) AS species, count(DISTINCT individual) AS individuals FROM detections", *DET)
def a35_meta_counts(t: Tables) -> DataFrame:
    return t.detections.agg(F.count_distinct(F.to_date("ts")).alias("days"), F.count_distinct("species").alias("species"), F.count_distinct("individual").alias("individuals"))


@register("SELECT date_trunc('hour', ts) AS hour, count(*) AS calls, count(*) FILTER (species = 'error') AS empty FROM detections GROUP BY ALL", *DET)
def a39_census(t: Tables) -> DataFrame:
    return t.detections.groupBy(F.window(F.col("ts"), "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("calls"), F.count_if(F.col("species") == "error").alias("empty")).select(
        F.col("w.start").cast("timestamp_ntz").alias("hour"), "calls", "empty"
    )


@register(
    """WITH g AS (SELECT s.species, (epoch_us(v.started_at) - epoch_us(lag(v.ended_at) OVER (PARTITION BY v.source, s.species ORDER BY v.started_at))) / 3.6e9 AS gap
    FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at)
    SELECT species, count(*) AS gaps, list_sort(list(gap))[count(*) // 2 + 1] AS gap_h FROM g WHERE gap <= 24 GROUP BY species""",
    *VS,
)
def w5_inter_arrival(t: Tables) -> DataFrame:
    return profiles.interval_stats(named_visits(t), "species")


@register(
    """WITH h AS (SELECT species, hour(ts) AS hour, count(*) AS n FROM detections GROUP BY ALL), t AS (SELECT species, sum(n) AS total FROM h GROUP BY species),
    a AS (SELECT h.species, list(hour) AS hours FROM h JOIN t ON h.species = t.species WHERE n >= 0.042 * total GROUP BY h.species)
    SELECT x.species AS a, y.species AS b, len(list_intersect(x.hours, y.hours)) AS shared FROM a x JOIN a y ON x.species < y.species""",
    *DET,
)
def u7_guild_hours(t: Tables) -> DataFrame:
    """Active hours that two species share; a species has 24 hours at most, so its hours are one short array."""
    h = profiles.hour_counts(t.detections, "species")
    total = h.groupBy("species").agg(F.sum("n").alias("total"))
    busy = h.join(total, "species").where("n >= 0.042 * total").groupBy("species").agg(F.collect_list("hour").alias("hours"))
    pairs = busy.select(F.col("species").alias("a"), F.col("hours").alias("x")).join(busy.select(F.col("species").alias("b"), F.col("hours").alias("y")), F.col("a") < F.col("b"))
    return pairs.select("a", "b", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


@register(
    window_sql("SELECT species AS key, hour(ts) AS hour, count(*) AS n FROM detections GROUP BY ALL", 0.7).replace("SELECT key AS species, x[2]", ", w AS (SELECT key AS species, x[2]", 1).rstrip()
    + """) SELECT d.id, CASE WHEN start_hour <= end_hour THEN hour(d.ts) BETWEEN start_hour AND end_hour ELSE hour(d.ts) >= start_hour OR hour(d.ts) <= end_hour END AS usual FROM detections d JOIN w ON d.species = w.species""",
    *DET,
)
def p15_in_window(t: Tables) -> DataFrame:
    w = profiles.typical_window(profiles.hour_counts(t.detections, "species"), "species", 0.7)
    return t.detections.join(w, "species").select("id", in_window(F.hour("ts"), "start_hour", "end_hour").alias("usual"))


@register("SELECT id, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || CASE WHEN hour(ts) < 12 THEN 'am' ELSE 'pm' END AS label FROM detections", *DET)
def f2_hour_label(t: Tables) -> DataFrame:
    return t.detections.select("id", hour_label(F.hour("ts")).alias("label"))


