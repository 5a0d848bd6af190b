"""Queries over overlapping and neighbouring times."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.columns import micros
from visitlens.operators import intervals, sessions
from visitlens.plans.registry import CLIPS, DET, VISITS, register
from visitlens.sources.fixtures import Tables

#: Both visits and clips: the clips' table expressions after the visits'.
BOTH = (*VISITS, "clip_flagged", "clip_stamped", "clips")
OVER = "v.source = c.source AND c.start_at <= v.ended_at AND c.end_at >= v.started_at"
SECONDS = "greatest(0, epoch_us(least(v.ended_at, c.end_at)) - epoch_us(greatest(v.started_at, c.start_at))) / 1e6"


def visit_clips(t: Tables) -> DataFrame:
    v = t.visits.select("source", F.col("started_at").alias("a0"), F.col("ended_at").alias("a1"))
    c = t.clips.select("source", F.col("start_at").alias("b0"), F.col("end_at").alias("b1"), "clip_id", "detections")
    return intervals.with_overlap(intervals.overlap_join(v, c))


@register(f"SELECT v.source, v.started_at, c.clip_id, {SECONDS} AS overlap_s FROM visits v JOIN clips c ON {OVER}", *BOTH)
def j9_overlaps(t: Tables) -> DataFrame:
    return visit_clips(t).select("source", F.col("a0").alias("started_at"), "clip_id", "overlap_s")


@register(
    """SELECT d.id, arg_min(c.clip_id, (-c.detections, c.start_at)) AS clip_id FROM detections d JOIN clips c
    ON d.source = c.source AND d.ts BETWEEN c.start_at AND c.end_at GROUP BY d.id""",
    *CLIPS,
)
def j10_clip_at(t: Tables) -> DataFrame:
    points = t.detections.select("source", "id", F.col("ts").alias("a0"), F.col("ts").alias("a1"))
    c = t.clips.select("source", F.col("start_at").alias("b0"), F.col("end_at").alias("b1"), "clip_id", "detections")
    return intervals.best_per(intervals.overlap_join(points, c), ["id"], [-F.col("detections"), F.col("b0")], ["clip_id"])


@register(
    f"""SELECT c.clip_id, arg_min(v.started_at, (-({SECONDS}), v.started_at)) AS started_at, max({SECONDS}) AS overlap_s
    FROM visits v JOIN clips c ON {OVER} WHERE {SECONDS} > 0 GROUP BY c.clip_id""",
    *BOTH,
)
def j11_most_overlap(t: Tables) -> DataFrame:
    pairs = visit_clips(t).where("overlap_s > 0").withColumn("started_at", F.col("a0"))
    return intervals.best_per(pairs, ["clip_id"], [-F.col("overlap_s"), F.col("a0")], ["started_at", "overlap_s"])


@register(
    f"""WITH f AS (SELECT c.clip_id, v.source, min(v.started_at) AS started_at FROM visits v JOIN clips c ON {OVER} WHERE c.detections >= 2 GROUP BY c.clip_id, v.source)
    SELECT source, started_at, count(*) AS clips FROM f GROUP BY source, started_at""",
    *BOTH,
)
def j12_first_overlap_counts(t: Tables) -> DataFrame:
    first = visit_clips(t).where("detections >= 2").groupBy("clip_id", "source").agg(F.min("a0").alias("started_at"))
    return first.groupBy("source", "started_at").agg(F.count(F.lit(1)).alias("clips"))


@register(f"SELECT DISTINCT v.source, v.started_at FROM visits v WHERE EXISTS (SELECT 1 FROM clips c WHERE {OVER} AND c.detections >= 2)", *BOTH)
def j13_multi_flag(t: Tables) -> DataFrame:
    return visit_clips(t).where("detections >= 2").select("source", F.col("a0").alias("started_at")).distinct()


#: Sightings: purchases and sign-ups, with a name and a span of an hour.
SIGHTINGS = """sightings AS (SELECT id, source, ts AS a0, ts + INTERVAL 1 HOUR AS a1, CASE WHEN k % 5 = 0 THEN 'K' || (k % 7) || ' + k1' ELSE 'K' || (k % 7) END AS name
    FROM detections WHERE species IN ('purchase', 'signup'))"""


def sightings(t: Tables) -> DataFrame:
    base = F.concat(F.lit("K"), (F.col("k") % 7).cast("string"))
    return t.detections.where("species in ('purchase', 'signup')").select(
        "id", "source", F.col("ts").alias("a0"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("a1"), F.when(F.col("k") % 5 == 0, F.concat(base, F.lit(" + k1"))).otherwise(base).alias("name")
    )


@register(
    "WITH " + SIGHTINGS + """, p AS (SELECT v.source, v.started_at, lower(s.name) AS key, max(s.a0) AS newest FROM visits v JOIN sightings s
    ON v.source = s.source AND s.a0 <= v.ended_at AND s.a1 >= v.started_at GROUP BY ALL)
    SELECT source, started_at, string_agg(key, '|' ORDER BY newest DESC, key) AS names FROM p GROUP BY source, started_at""",
    *VISITS,
)
def j14_sighting_names(t: Tables) -> DataFrame:
    s = sightings(t).select("source", F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.lower("name").alias("key"))
    v = t.visits.select("source", F.col("started_at").alias("a0"), F.col("ended_at").alias("a1"))
    newest = intervals.overlap_join(v, s).groupBy("source", F.col("a0").alias("started_at"), "key").agg(F.max("b0").alias("newest"))
    names = F.array_sort(F.collect_list(F.struct((-micros("newest")).alias("age"), "key")))
    return newest.groupBy("source", "started_at").agg(F.array_join(F.transform(names, lambda x: x["key"]), "|").alias("names"))


@register(
    """SELECT c.clip_id, count(d.id) AS n, max(d.confidence) AS best FROM clips c LEFT JOIN detections d
    ON c.source = d.source AND d.ts BETWEEN c.start_at - INTERVAL 30 MINUTE AND c.end_at + INTERVAL 30 MINUTE GROUP BY c.clip_id""",
    *CLIPS,
)
def j15_padded_pairs(t: Tables) -> DataFrame:
    pad = F.expr("INTERVAL 30 MINUTES")
    c = t.clips.select("source", "clip_id", (F.col("start_at") - pad).alias("a0"), (F.col("end_at") + pad).alias("a1"))
    d = t.detections.select("source", "id", "confidence", F.col("ts").alias("b0"), F.col("ts").alias("b1"))
    found = intervals.overlap_join(c, d).groupBy("clip_id").agg(F.count("id").alias("n"), F.max("confidence").alias("best"))
    return t.clips.select("clip_id").join(found, "clip_id", "left").select("clip_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "best")


@register(
    """SELECT a.source, a.started_at, count(*) AS others, min(abs(epoch_us(b.started_at) - epoch_us(a.started_at))) / 1e6 AS nearest_s
    FROM visits a JOIN visits b ON a.source <> b.source AND a.source % 10 = b.source % 10
    AND b.started_at BETWEEN a.started_at - INTERVAL 600 SECOND AND a.started_at + INTERVAL 600 SECOND GROUP BY a.source, a.started_at""",
    *VISITS,
)
def j16_cross_camera(t: Tables) -> DataFrame:
    """Visits of neighbouring cameras (one site holds the sources alike modulo 10) within ten minutes."""
    pad = F.expr("INTERVAL 600 SECONDS")
    site = F.col("source") % 10
    a = t.visits.select(site.alias("site"), F.col("source").alias("source_a"), F.col("started_at").alias("at_a"), (F.col("started_at") - pad).alias("a0"), (F.col("started_at") + pad).alias("a1"))
    b = t.visits.select(site.alias("site"), F.col("source").alias("source_b"), F.col("started_at").alias("b0"), F.col("started_at").alias("b1"))
    pairs = intervals.overlap_join(a, b, key="site", bucket_s=3600).where("source_a <> source_b")
    apart = F.abs(micros("b0") - micros("at_a")) / 1e6
    return pairs.groupBy(F.col("source_a").alias("source"), F.col("at_a").alias("started_at")).agg(F.count(F.lit(1)).alias("others"), F.min(apart).alias("nearest_s"))


@register(
    """WITH n AS (SELECT source, started_at, n, lag(n) OVER w AS before_n, started_at - lag(ended_at) OVER w <= INTERVAL 8 HOUR AS near FROM visits
    WINDOW w AS (PARTITION BY source ORDER BY started_at)) SELECT source, started_at, CASE WHEN near THEN before_n END AS neighbour_n FROM n""",
    *VISITS,
)
def j17_nearest_neighbour(t: Tables) -> DataFrame:
    rows = t.visits.select("source", "started_at", F.struct("n", micros("ended_at").alias("us")).alias("seen"))
    found = sessions.with_previous(rows, "seen", ts="started_at", order="started_at")
    near = micros("started_at") - F.col("before.us") <= 8 * 3600 * 1_000_000
    return found.select("source", "started_at", F.when(near, F.col("before.n")).alias("neighbour_n"))


@register(
    """SELECT a.source, a.id, min(b.ts) AS later, arg_min(b.species, (b.ts, b.species)) AS what FROM detections a JOIN detections b
    ON a.source = b.source AND b.ts > a.ts AND b.ts <= a.ts + INTERVAL 12 HOUR AND b.species <> 'view' WHERE a.species = 'view' GROUP BY a.source, a.id""",
    *DET,
)
def j18_first_after(t: Tables) -> DataFrame:
    a = t.detections.where("species = 'view'").select("source", "id", F.col("ts").alias("at"))
    b = t.detections.where("species <> 'view'").select("source", F.col("ts").alias("at"), F.col("species").alias("what"))
    return intervals.first_after(a, b, horizon_s=12 * 3600).select("source", "id", "later", "what")


@register(f"SELECT v.source, v.started_at, c.clip_id FROM visits v JOIN clips c ON {OVER} AND v.started_at BETWEEN c.start_at AND c.end_at", *BOTH)
def j19_encounters(t: Tables) -> DataFrame:
    return visit_clips(t).where("a0 between b0 and b1").select("source", F.col("a0").alias("started_at"), "clip_id")


@register(
    """WITH e AS (SELECT source, ts AS moment, CASE WHEN species = 'error' THEN 'down' ELSE 'up' END AS event FROM detections WHERE species IN ('error', 'signup')),
    s AS (SELECT *, lead(moment) OVER (PARTITION BY source ORDER BY moment, event) AS nxt FROM e),
    f AS (SELECT source, min(moment) AS first FROM e GROUP BY source),
    d AS (SELECT v.source, v.started_at, sum(greatest(0, epoch_us(least(v.ended_at, coalesce(s.nxt, v.ended_at))) - epoch_us(greatest(v.started_at, s.moment)))) / 1e6 AS dark
      FROM visits v JOIN s ON v.source = s.source AND s.event = 'down' AND s.moment <= v.ended_at AND coalesce(s.nxt, v.ended_at) >= v.started_at GROUP BY v.source, v.started_at)
    SELECT v.source, v.started_at, round(CASE WHEN f.first <= v.ended_at THEN coalesce(d.dark, 0) END, 6) AS dark_s
    FROM visits v LEFT JOIN f ON v.source = f.source LEFT JOIN d ON v.source = d.source AND v.started_at = d.started_at""",
    *VISITS,
)
def a25_dark_seconds(t: Tables) -> DataFrame:
    events = t.detections.where("species in ('error', 'signup')").select(
        "source", F.col("ts").alias("at"), F.when(F.col("species") == "error", "down").otherwise("up").alias("event")
    )
    windows = t.visits.select("source", F.col("started_at").alias("a0"), F.col("ended_at").alias("a1"))
    return intervals.dark_seconds(events, windows).select("source", F.col("a0").alias("started_at"), F.round("dark_s", 6).alias("dark_s"))


ISLANDS = SIGHTINGS + """, r AS (SELECT *, max(a1) OVER (PARTITION BY source ORDER BY a0, a1, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM sightings),
    g AS (SELECT *, max(CASE WHEN reach IS NULL OR a0 > reach THEN a0 END) OVER (PARTITION BY source ORDER BY a0, a1, id ROWS UNBOUNDED PRECEDING) AS island FROM r)"""


@register("WITH " + ISLANDS + " SELECT source, island, count(*) AS sightings, max(a1) AS ended_at, count(DISTINCT lower(name)) AS names FROM g GROUP BY source, island HAVING count(DISTINCT lower(name)) >= 2", *DET)
def a26_conflicts(t: Tables) -> DataFrame:
    found = intervals.islands(sightings(t)).groupBy("source", "island").agg(
        F.count(F.lit(1)).alias("sightings"), F.max("a1").alias("ended_at"), F.count_distinct(F.lower("name")).alias("names")
    )
    return found.where("names >= 2")


@register("WITH " + ISLANDS + " SELECT source, island AS span_start, max(a1) AS span_end FROM g GROUP BY source, island HAVING count(DISTINCT lower(name)) >= 2", *DET)
def a27_conflict_spans(t: Tables) -> DataFrame:
    return a26_conflicts(t).select("source", F.col("island").alias("span_start"), F.col("ended_at").alias("span_end"))


@register("WITH " + SIGHTINGS + " SELECT id, source, a0, a1 FROM sightings WHERE name LIKE '% + %'", *DET)
def a28_multi_name_spans(t: Tables) -> DataFrame:
    return sightings(t).where(F.contains("name", F.lit(" + "))).select("id", "source", "a0", "a1")


@register(
    "WITH " + SIGHTINGS + """ SELECT v.source, v.started_at FROM visits v WHERE EXISTS (SELECT 1 FROM sightings s WHERE s.name LIKE '% + %'
    AND v.source = s.source AND s.a0 <= v.ended_at AND s.a1 >= v.started_at)""",
    *VISITS,
)
def a45_sighting_multi(t: Tables) -> DataFrame:
    spans = a28_multi_name_spans(t).select("source", F.col("a0").alias("b0"), F.col("a1").alias("b1"))
    v = t.visits.select("source", F.col("started_at").alias("a0"), F.col("ended_at").alias("a1"))
    return intervals.overlap_join(v, spans).select("source", F.col("a0").alias("started_at")).distinct()


@register(
    """WITH c AS (SELECT source, start_at, end_at, detections >= 2 AS multi FROM clips)
    SELECT source, started_at FROM visits v WHERE EXISTS (SELECT 1 FROM c WHERE multi AND c.source = v.source AND c.start_at <= v.ended_at AND c.end_at >= v.started_at)
    UNION SELECT source, started_at FROM visits WHERE n >= 4""",
    *BOTH,
)
def u4_multi_union(t: Tables) -> DataFrame:
    return j13_multi_flag(t).union(t.visits.where("n >= 4").select("source", "started_at")).distinct()


@register("SELECT c.clip_id FROM clips c WHERE NOT EXISTS (SELECT 1 FROM detections d WHERE d.species = 'purchase' AND d.source = c.source AND d.ts BETWEEN c.start_at AND c.end_at)", *CLIPS)
def s9_clips_needing_tracks(t: Tables) -> DataFrame:
    done = t.detections.where("species = 'purchase'").select("source", F.col("ts").alias("b0"), F.col("ts").alias("b1"))
    c = t.clips.select("source", "clip_id", F.col("start_at").alias("a0"), F.col("end_at").alias("a1"))
    return c.join(intervals.overlap_join(c, done).select("clip_id").distinct(), "clip_id", "left_anti").select("clip_id")


