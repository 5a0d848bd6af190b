"""Queries of decisions, labels of whole visits, motion reports and the behaviour page."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.operators import decisions, exports, intervals, ledger, motion, places, profiles
from visitlens.plans.profiles import named_visits, window_sql
from visitlens.plans.registry import DET, STAMPED, VISITS, register
from visitlens.sources import stores
from visitlens.sources.fixtures import Tables
from visitlens.sources.scratch import new_folder

VS = (*VISITS, "votes", "visit_species")
SECONDS = "epoch_us(ts) / 1e6"


@register(
    f"""WITH b AS (SELECT id, source, k % 3 AS epoch, {SECONDS} AS at_s, CASE WHEN k % 5 = 0 THEN 'ir' ELSE species END AS illumination, confidence AS corr, 1 - k / 200.0 AS cover, value / 100 AS s1, k / 100.0 AS s2, k AS events, k % 7 AS days FROM detections),
    r AS (SELECT source, max(id) AS ref_id, max({SECONDS}) - 86400 * 10 AS ref_at_s FROM detections WHERE species = 'signup' GROUP BY source),
    j AS (SELECT b.*, r.ref_id, r.ref_at_s, r.ref_id % 3 AS ref_epoch, round(b.at_s - r.ref_at_s, 1) AS age FROM b LEFT JOIN r USING (source)),
    w AS (SELECT *, CASE WHEN ref_id IS NULL THEN 'no_reference' WHEN ref_epoch <> epoch THEN 'view_epoch_changed' WHEN NOT coalesce(round(corr, 3) >= 0.1, FALSE) THEN 'camera_moved' WHEN NOT (age <= 864000 AND age >= 0) THEN 'reference_stale'
      WHEN NOT (round(cover, 4) >= 0.6) THEN 'reference_has_no_pixels_here' WHEN illumination NOT IN ('view', 'click', 'purchase') THEN 'no_thresholds_for_illumination' WHEN NOT coalesce(s1 < 3 AND (illumination <> 'click' OR s2 < 0.6), FALSE) THEN 'pixels_differ_from_empty'
      WHEN NOT (events >= 10 AND days >= 2) THEN 'not_recurrent_enough' ELSE 'matches_empty_reference_at_a_recurring_spot' END AS reason FROM j)
    SELECT id, reason, CASE WHEN reason IN ('pixels_differ_from_empty', 'not_recurrent_enough') THEN 'keep' WHEN reason = 'matches_empty_reference_at_a_recurring_spot' THEN 'suppress' ELSE 'abstain' END AS decision FROM w""",
    *DET,
)
def m6_veto(t: Tables) -> DataFrame:
    """Each detection judged against its source's last reference, by all reasons in their order."""
    d = t.detections.withColumn("at_s", F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col("ts")) / 1e6)
    boxes = d.select(
        "id", "source", (F.col("k") % 3).alias("epoch"), "at_s", F.when(F.col("k") % 5 == 0, "ir").otherwise(F.col("species")).alias("illumination"), F.col("confidence").alias("corr"), (1 - F.col("k") / 200.0).alias("cover"),
        F.create_map(F.lit("blur"), F.col("value") / 100, F.lit("edge"), F.col("k") / 100.0).alias("scores"), F.col("k").alias("events"), (F.col("k") % 7).alias("days"),
    )
    refs = d.where("species = 'signup'").groupBy("source").agg(F.max("id").alias("ref_id"), (F.max("at_s") - 864000.0).alias("ref_at_s")).withColumn("ref_epoch", F.col("ref_id") % 3)
    limits = t.spark.createDataFrame([("view", {"blur": 3.0}), ("purchase", {"blur": 3.0}), ("click", {"blur": 3.0, "edge": 0.6}), ("ir", {})], "illumination string, limits map<string, double>")
    found = decisions.veto(boxes, refs, limits, corr_min=0.1, max_age_s=864000.0, cover_min=0.6, min_events=10, min_days=2)
    return found.select("id", "decision", "reason")


@register(
    """WITH p AS (SELECT l_suppkey AS place, count(*) AS n, median(1 + l_discount * 5) AS motion FROM lineitem GROUP BY l_suppkey), s AS (SELECT count(DISTINCT l_orderkey) AS sampled FROM lineitem)
    SELECT place, n, n >= 8 AND n >= 0.001 * sampled AND motion <= 1.24 AS furniture FROM p, s"""
)
def m5_furniture(t: Tables) -> DataFrame:
    """Places by how often they were seen and how little moved there."""
    rows = t.read("lineitem").select(F.col("l_suppkey").alias("place"), (1 + F.col("l_discount") * 5).alias("motion"), F.col("l_orderkey").alias("frame"))
    seen = rows.groupBy("place").agg(F.count(F.lit(1)).alias("n"), F.expr("percentile(motion, 0.5)").alias("motion"))
    sampled = F.broadcast(rows.agg(F.count_distinct("frame").alias("sampled")))  # one row
    return seen.crossJoin(sampled).select("place", "n", places.is_furniture("n", "sampled", "motion", motion_max=1.24, min_share=0.001).alias("furniture"))


TRACKS = """tracks AS (SELECT source AS clip_id, species AS track, max(CASE WHEN k >= 90 THEN individual END) AS who, count(*) AS n_hits, avg(value) / 100 AS avg_speed, avg(confidence) AS straightness, avg(k) / 100 AS moving_frac,
    CASE WHEN count(*) % 2 = 0 THEN max(value) / 50 END AS stride_hz FROM detections GROUP BY source, species)"""


def tracks(t: Tables) -> DataFrame:
    """A track for each species at a source, with its measures."""
    return t.detections.groupBy(F.col("source").alias("clip_id"), F.col("species").alias("track")).agg(
        F.max(F.when(F.col("k") >= 90, F.col("individual"))).alias("who"), F.count(F.lit(1)).alias("n_hits"), (F.avg("value") / 100).alias("avg_speed"), F.avg("confidence").alias("straightness"), (F.avg("k") / 100).alias("moving_frac"),
        F.when(F.count(F.lit(1)) % 2 == 0, F.max("value") / 50).alias("stride_hz"),
    )


MIDDLE = "round(coalesce(list_sort(list({c}) FILTER ({c} IS NOT NULL))[count({c}) // 2 + 1], 0), 6) AS {c}"


@register(
    f"WITH {TRACKS} SELECT coalesce(who, '(unconfirmed)') AS who, count(*) AS tracks, {', '.join(MIDDLE.format(c=c) for c in ('avg_speed', 'straightness', 'moving_frac', 'stride_hz'))}, count(stride_hz) AS gaits FROM tracks GROUP BY 1",
    *DET,
)
def m3_motion_report(t: Tables) -> DataFrame:
    found = motion.report(tracks(t))
    return found.select("who", "tracks", *(F.round(c, 6).alias(c) for c in ("avg_speed", "straightness", "moving_frac", "stride_hz")), "gaits")


@register(f"WITH {TRACKS} SELECT clip_id, count(*) FILTER (n_hits >= 3) AS tracks, count(*) AS raw FROM tracks GROUP BY clip_id HAVING count(*) FILTER (n_hits >= 3) >= 2", *DET)
def m3_pair_clips(t: Tables) -> DataFrame:
    return motion.pair_clips(tracks(t), sustained=3)


LABELS = """labels AS (SELECT source, started_at, CASE WHEN n % 3 = 0 THEN 'raccoon' END AS species, n % 3 = 1 AS verify, n % 2 = 0 AS sets_name, CASE WHEN n % 4 = 0 THEN 'stan' END AS name FROM visits)"""


@register(
    f"""WITH {LABELS}, f AS (SELECT s.id, s.source, s.started_at, coalesce(l.species, s.species) AS species, CASE WHEN l.species IS NOT NULL THEN 1.0 ELSE s.confidence END AS species_confidence, CASE WHEN l.species IS NOT NULL THEN 'human' ELSE 'model' END AS species_source,
      CASE WHEN l.species IS NOT NULL OR l.verify THEN 1 ELSE 0 END AS verified, s.individual, CASE WHEN l.species IS NOT NULL THEN s.species END AS model_species, l.sets_name, l.name FROM stamped s JOIN labels l ON l.source = s.source AND l.started_at = s.started_at),
    m AS (SELECT source, started_at, arg_min(species, (-n, species)) AS main FROM (SELECT source, started_at, species, count(*) AS n FROM f WHERE sets_name AND species IS NOT NULL GROUP BY ALL) GROUP BY ALL)
    SELECT f.id, f.species, f.species_confidence, f.species_source, f.verified, f.model_species, CASE WHEN sets_name AND (m.main IS NULL OR f.species = m.main) THEN f.name ELSE f.individual END AS individual,
      CASE WHEN sets_name AND (m.main IS NULL OR f.species = m.main) THEN CASE WHEN f.name IS NOT NULL THEN 'human' END ELSE 'auto' END AS individual_source FROM f LEFT JOIN m ON m.source = f.source AND m.started_at = f.started_at""",
    *STAMPED, "visits",
)
def l5_apply_visit_label(t: Tables) -> DataFrame:
    """What people said of each visit, put on its rows: species, confirmations and names."""
    visit = F.concat_ws("|", F.col("source").cast("string"), F.col("started_at").cast("string")).alias("visit")
    none = F.lit(None).cast("string")
    rows = t.stamped.select(
        "id", visit, "species", F.col("confidence").alias("species_confidence"), F.lit("model").alias("species_source"), F.lit(0).alias("verified"), "individual", F.lit("auto").alias("individual_source"),
        none.alias("labelled_at"), none.alias("labeled_by"), none.alias("model_species"),
    )
    n = F.col("n")
    labels = t.visits.select(visit, F.when(n % 3 == 0, "raccoon").alias("species"), (n % 3 == 1).alias("verify"), (n % 2 == 0).alias("sets_name"), F.when(n % 4 == 0, "stan").alias("name"), F.lit("now").alias("at"), F.lit("me").alias("by"))
    return ledger.apply_visit_label(rows, labels).select("id", "species", "species_confidence", "species_source", "verified", "model_species", "individual", "individual_source")


@register(
    """WITH spans AS (SELECT source, started_at AS a0, ended_at AS a1, 'v' || n AS label FROM visits WHERE n >= 2) SELECT d.id, s.label FROM detections d JOIN spans s ON s.source = d.source AND d.ts BETWEEN s.a0 AND s.a1""", "detections", "flagged", "stamped", "visits"
)
def l5_labels_of_spans(t: Tables) -> DataFrame:
    """The rows that labelled spans of time hold, by instants."""
    spans = t.visits.where("n >= 2").select("source", F.col("started_at").alias("a0"), F.col("ended_at").alias("a1"), F.concat(F.lit("v"), F.col("n").cast("string")).alias("label"))
    return ledger.labels_of_spans(spans, t.detections)


@register("SELECT frame // 20 AS video, CASE WHEN bool_or(n >= 2) THEN 'group' ELSE 'individual' END AS scope FROM (SELECT frame, count(*) FILTER (score >= 0.9) AS n FROM boxes GROUP BY frame) GROUP BY 1", "boxes")
def a48_video_scope(t: Tables) -> DataFrame:
    frames = t.boxes.groupBy("frame").agg(F.count_if(F.col("score") >= 0.9).alias("n_animals"))
    return decisions.video_scope(frames.select(F.floor(F.col("frame") / 20).alias("video"), "n_animals"))


@register("SELECT sha256(text) AS sha, min(source) AS individual, count(*) AS frames FROM documents WHERE text IS NOT NULL GROUP BY 1")
def s22_video_hashes(t: Tables) -> DataFrame:
    return ledger.video_hashes(t.read("documents").select(F.sha2("text", 256).alias("sha"), F.col("source").alias("individual")))


@register(f"WITH {TRACKS} SELECT clip_id, track, CASE WHEN clip_id % 3 = 0 THEN CASE WHEN clip_id % 2 = 0 THEN 'stan' END ELSE who END AS individual, CASE WHEN clip_id % 3 = 0 THEN CASE WHEN clip_id % 2 = 0 THEN 'human' END WHEN who IS NOT NULL THEN 'auto' END AS individual_source FROM tracks", *DET)
def l22_track_identity(t: Tables) -> DataFrame:
    """Names that people gave tracks, and took from them."""
    key = F.concat_ws("|", F.col("clip_id").cast("string"), "track")
    rows = tracks(t).select("clip_id", F.col("track").alias("t"), key.alias("track"), F.col("who").alias("individual"), F.when(F.col("who").isNotNull(), "auto").alias("individual_source"))
    names = rows.where("clip_id % 3 = 0").select("track", F.when(F.col("clip_id") % 2 == 0, "stan").alias("name"))
    return ledger.set_tracks(rows, names).select("clip_id", F.col("t").alias("track"), "individual", "individual_source")


@register("SELECT species, count(*) AS n FROM detections GROUP BY species", *DET)
def e30_latest_artifact(t: Tables) -> DataFrame:
    """The newest of two saved reports, by the time in its name."""
    root = new_folder(t.spark, "reports")
    n = t.detections.groupBy("species").agg(F.count(F.lit(1)).alias("n"))
    for stamp, report in (("20240501T080000", n), ("20240430T230000", n.limit(1))):
        stores.save_report(report, root, stamp)
    return stores.latest_report(t.spark, root).select("species", "n")


PROFILE = f"""WITH x AS (SELECT v.*, s.species, (epoch_us(v.ended_at) - epoch_us(v.started_at)) / 1e6 AS dwell FROM visits v JOIN visit_species s ON v.source = s.source AND v.started_at = s.started_at),
    hours AS (SELECT species, hour(started_at) AS hour, count(*) AS n FROM x GROUP BY ALL), peaks AS (SELECT species, arg_min(hour, (-n, hour)) AS peak FROM hours GROUP BY species),
    windows AS ({window_sql('SELECT species AS key, hour, n FROM hours', 0.8)}),
    prof AS (SELECT species, count(*) AS visits, count(DISTINCT CAST(started_at AS DATE)) AS days, round_even(count(*) / count(DISTINCT CAST(started_at AS DATE)), 1) AS per_day, min(started_at) AS first, max(started_at) AS last,
      list_sort(list(dwell))[count(*) // 2 + 1] AS dwell_median, max(dwell) AS dwell_max, round_even(sum(n) / count(*), 1) AS crops_per_visit FROM x GROUP BY species),
    kinds AS (SELECT species, 2 * count(*) FILTER (hour(started_at) < 6 OR hour(started_at) >= 18) > count(*) AS nocturnal FROM x GROUP BY species),
    suns AS (SELECT x.species, k.nocturnal, x.started_at, round_even((epoch_us(started_at) - epoch_us(date_trunc('day', started_at))) / 6e7 - 60 * CASE WHEN NOT k.nocturnal THEN 6 WHEN hour(started_at) < 6 THEN -6 ELSE 18 END, 0) AS minutes FROM x JOIN kinds k USING (species)),
    anchors AS (SELECT species, CASE WHEN nocturnal THEN 'dusk' ELSE 'dawn' END AS anchor, list_sort(list(minutes))[count(*) // 2 + 1] AS minutes FROM suns GROUP BY ALL)"""


@register(PROFILE + " SELECT p.*, k.peak, w.start_hour, w.end_hour, a.anchor, a.minutes FROM prof p JOIN peaks k USING (species) JOIN windows w USING (species) JOIN anchors a USING (species)", *VS)
def a41_species_profile(t: Tables) -> DataFrame:
    """How each species behaves, and when it comes by the sun."""
    v = named_visits(t)
    return profiles.profile(v, "species").join(profiles.sun_anchor(v, "species")[0].select("species", "anchor", "minutes"), "species", "left")


@register(PROFILE + " SELECT species, strftime(started_at, '%G-W%V') AS week, count(*) AS n, list_sort(list(minutes))[count(*) // 2 + 1] AS minutes FROM suns GROUP BY ALL HAVING count(*) >= 5", *VS)
def a41_sun_weeks(t: Tables) -> DataFrame:
    """The drift of arrivals against the sun, week by week."""
    return profiles.sun_anchor(named_visits(t), "species")[1]


@register(
    PROFILE + """, sets AS (SELECT DISTINCT source, started_at, species FROM stamped), often AS (SELECT a.species AS a, b.species AS b, count(*) AS n FROM sets a JOIN sets b ON a.source = b.source AND a.started_at = b.started_at AND a.species < b.species GROUP BY ALL ORDER BY n DESC, a.species, b.species LIMIT 12),
    newest AS (SELECT * FROM (SELECT * FROM x ORDER BY started_at DESC, source LIMIT 40) WHERE species <> 'error'),
    flags AS (SELECT n.source, n.started_at, n.species, CASE WHEN coalesce(p.visits, 0) < 3 THEN 'thin' WHEN (CASE WHEN w.start_hour <= w.end_hour THEN hour(n.started_at) BETWEEN w.start_hour AND w.end_hour ELSE hour(n.started_at) >= w.start_hour OR hour(n.started_at) <= w.end_hour END)
      AND (n.dwell < 5 OR n.dwell / coalesce(nullif(p.dwell_median, 0), 1) BETWEEN 0.15 AND 8) THEN 'fits' ELSE 'odd' END AS verdict FROM newest n LEFT JOIN prof p USING (species) LEFT JOIN windows w USING (species))
    SELECT 'species' AS part, species AS a, NULL AS b, visits AS n FROM prof WHERE species <> 'error' UNION ALL SELECT 'pair', a, b, n FROM often UNION ALL SELECT 'flag', species || '|' || source || '|' || strftime(started_at, '%Y-%m-%d %H:%M:%S'), verdict, NULL FROM flags""",
    *VS,
)
def a19_overview(t: Tables) -> DataFrame:
    """The behaviour page: species, the pairs that meet most, and how the newest visits fit."""
    species, pairs, flags = profiles.overview(named_visits(t), t.stamped, denied=("error",))
    none = lambda kind: F.lit(None).cast(kind)
    rows = species.select(F.lit("species").alias("part"), F.col("species").alias("a"), none("string").alias("b"), F.col("visits").alias("n"))
    rows = rows.unionByName(pairs.select(F.lit("pair").alias("part"), "a", "b", F.col("visits").alias("n")))
    name = F.concat_ws("|", "species", F.col("source").cast("string"), F.date_format("started_at", "yyyy-MM-dd HH:mm:ss"))
    return rows.unionByName(flags.select(F.lit("flag").alias("part"), name.alias("a"), F.col("verdict").alias("b"), none("long").alias("n")))


@register("SELECT source, arg_max(ts, (ts, id)) AS started_at, count(*) AS epoch FROM detections WHERE species = 'signup' GROUP BY source", *DET)
def s32_epoch_start(t: Tables) -> DataFrame:
    """Of the view epochs that each bump opened, the newest one of each source and its start."""
    opened = ledger.epochs(t.detections.where("species = 'signup'").select("source", F.col("ts").alias("at")))
    return ledger.latest(opened, ["source"], "epoch", ["started_at", "epoch"]).select("source", "started_at", "epoch")


@register("SELECT id, species, strftime(ts, '%Y-%m-%d %H:%M:%S') AS added FROM detections WHERE species = 'click' AND k % 7 <> 0 ORDER BY ts DESC, id DESC LIMIT 40", *DET)
def s36_favourites(t: Tables) -> DataFrame:
    """The newest forty favourites of one kind that were not taken away again."""
    events = t.detections.select("id", "species", "ts", F.when(F.col("k") % 7 == 0, F.col("ts")).alias("deleted_at"))
    found = ledger.newest(ledger.live(events, also=F.col("species") == "click"), 40, at="ts", order="id")
    return found.select("id", "species", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("added"))


@register("SELECT id, source, names FROM (SELECT id, source, ts, CASE WHEN k % 2 = 0 THEN 'stan,' || individual ELSE '' END AS names FROM detections WHERE species = 'signup') ORDER BY ts DESC, id DESC LIMIT 30", *DET)
def s38_recent_sightings(t: Tables) -> DataFrame:
    """The newest thirty sightings with the names that their JSON holds; text that is none gives no names."""
    json = F.when(F.col("k") % 2 == 0, F.to_json(F.array(F.lit("stan"), "individual"))).otherwise("stan?")
    found = ledger.newest(t.detections.where("species = 'signup'").withColumn("json", json), 30, at="ts", order="id")
    return found.select("id", "source", F.array_join(columns.json_names("json"), ",").alias("names"))


@register("SELECT id, source, CASE WHEN k < 10 THEN ts WHEN k < 20 THEN TIMESTAMP '2024-03-01' END AS deleted_at FROM detections WHERE species = 'click'", *DET)
def l12_tombstones(t: Tables) -> DataFrame:
    """Zones that people removed get a tombstone; one that was removed before keeps its first."""
    zones = t.detections.where("species = 'click'").select("id", "source", "k", F.when(F.col("k") < 10, F.col("ts")).alias("deleted_at"))
    return ledger.bury(zones, zones.where("k < 20"), F.lit("2024-03-01").cast("timestamp_ntz")).drop("k")


@register("SELECT id, source FROM detections WHERE species = 'click' AND k >= 20", *DET)
def s39_live_zones(t: Tables) -> DataFrame:
    """The zones that are left after removals."""
    return ledger.live(l12_tombstones(t)).select("id", "source")


@register("SELECT source, count(*) AS n FROM (SELECT source, bool_or(k >= 50) AS enabled, bool_or(k = 13) AS gone FROM detections GROUP BY source) WHERE enabled AND NOT gone GROUP BY source", *DET)
def s40_cameras(t: Tables) -> DataFrame:
    """Cameras that are there and switched on, without what opens them."""
    rows = t.detections.groupBy("source").agg(F.bool_or(F.col("k") >= 50).alias("enabled"), F.max(F.when(F.col("k") == 13, F.col("ts"))).alias("deleted_at"), F.lit("hunter2").alias("password"), F.lit("root").alias("username"))
    found = ledger.live(rows, also=F.col("enabled"), hidden=("password", "username"))
    return found.select("source", F.lit(1).cast("long").alias("n"), *(c for c in ("password", "username") if c in found.columns))


@register("SELECT id, CASE WHEN k < 5 THEN CASE WHEN k % 2 = 0 THEN 'stan' END ELSE individual END AS individual, CASE WHEN k < 5 THEN CASE WHEN k % 2 = 0 THEN 'human' END ELSE 'auto' END AS individual_source, k < 5 AS stamped FROM detections", *DET)
def l17_set_or_clear(t: Tables) -> DataFrame:
    """Single names that people set or cleared."""
    rows = t.detections.select("id", "individual", F.lit("auto").alias("individual_source"), F.lit(None).cast("timestamp_ntz").alias("labelled_at"))
    given = t.detections.where("k < 5").select("id", F.when(F.col("k") % 2 == 0, "stan").alias("name"), F.col("ts").alias("at"))
    return ledger.set_names(rows, given).select("id", "individual", "individual_source", F.col("labelled_at").isNotNull().alias("stamped"))


def held_back(t: Tables) -> DataFrame:
    """Errors as suppressed rows, each third one by another mechanism, one in ten with a decision that can't be read."""
    detail = F.when(F.col("k") % 10 == 0, "{").otherwise(F.to_json(F.struct(F.lit("suppress").alias("decision"), F.col("individual").alias("reason"))))
    d = t.detections.where("species = 'error'")
    return d.select("id", "k", F.col("ts").alias("suppressed_at"), F.when(F.col("k") % 3 == 0, "static").otherwise("refimg").alias("suppressed_by"), F.col("k").alias("suppress_ref_id"), detail.alias("suppress_detail"))


@register("SELECT id, CASE WHEN k % 10 = 0 THEN NULL ELSE individual END AS reason FROM detections WHERE species = 'error' AND k % 3 <> 0 AND ts >= TIMESTAMP '2024-01-30 00:00:00' - INTERVAL 7 DAY", *DET)
def p12_suppressed_rows(t: Tables) -> DataFrame:
    """What one mechanism suppressed in the last week, and why."""
    found = ledger.suppressed(held_back(t), by="refimg", now=F.lit("2024-01-30").cast("timestamp_ntz"))
    return found.select("id", "decision.reason")


@register("SELECT id, CASE WHEN k < 50 THEN NULL ELSE CASE WHEN k % 3 = 0 THEN 'static' ELSE 'refimg' END END AS suppressed_by, CASE WHEN k < 50 THEN NULL ELSE k END AS suppress_ref_id FROM detections WHERE species = 'error'", *DET)
def l28_cleared_suppression(t: Tables) -> DataFrame:
    """Rows that people freed have no column of a suppression left."""
    rows = held_back(t)
    return ledger.clear_suppression(rows, rows.where("k < 50")).select("id", "suppressed_by", "suppress_ref_id")


@register("SELECT count(*) FILTER (source LIKE 'ref:%') AS found, count(*) FILTER (NOT coalesce(source LIKE 'ref:%', FALSE)) AS others FROM (SELECT CASE WHEN doc_id % 3 = 0 THEN 'ref:' || source WHEN doc_id % 3 = 1 THEN source || ':ref:' END AS source FROM documents)")
def p21_reference_sources(t: Tables) -> DataFrame:
    """Sources that only hold references, by their prefix; no source is none."""
    named = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("ref:"), "source")).when(F.col("doc_id") % 3 == 1, F.concat("source", F.lit(":ref:")))
    is_one = ledger.is_reference_source(named)
    return t.read("documents").agg(F.count_if(is_one).alias("found"), F.count_if(~is_one).alias("others"))


@register("SELECT frame FROM (SELECT DISTINCT frame // 7 AS frame FROM boxes) WHERE frame NOT IN (SELECT frame // 7 FROM boxes WHERE score >= 0.9)", "boxes")
def p24_orphan_frames(t: Tables) -> DataFrame:
    """Frames kept for bursts of which no detection is left."""
    path = F.concat(F.lit("frames/"), F.floor(F.col("frame") / 7).cast("string"), F.lit(".jpg")).alias("frame_path")
    frames, rows = t.boxes.select(path, F.floor(F.col("frame") / 7).alias("frame")).distinct(), t.boxes.where("score >= 0.9").select(path)
    return ledger.orphans(frames, rows).select("frame")


@register(f"WITH {TRACKS} SELECT clip_id, track, stride_hz, row_number() OVER (ORDER BY straightness DESC, clip_id || '|' || track) - 1 AS place FROM tracks WHERE stride_hz IS NOT NULL AND straightness >= 0.2 AND clip_id % 2 = 0", *DET)
def s47_gait_export(t: Tables) -> DataFrame:
    """Tracks with a clear stride that have a vector, the clearest first."""
    key = F.concat_ws("|", F.col("clip_id").cast("string"), "track")
    rows = tracks(t).select("clip_id", F.col("track").alias("t"), key.alias("track"), "stride_hz", F.col("straightness").alias("strength"), F.lit(1.0).alias("walk_s"))
    found = exports.gait_rows(rows, rows.where("clip_id % 2 = 0").select("track", F.lit("stan").alias("name")), least=0.2)
    return found.select("clip_id", F.col("t").alias("track"), "stride_hz", F.col("place").cast("long").alias("place"))


@register(
    """WITH s AS (SELECT id, source AS visit, CASE WHEN k / 100.0 <= 0.35 THEN sqrt(k / 100.0 / 0.35) ELSE power(0.35 / (k / 100.0), 0.75) END * (0.7 + 0.3 * confidence) AS score FROM detections WHERE k > 0),
    b AS (SELECT visit, arg_max(id, (score, -id)) AS id, max(score) AS score FROM s GROUP BY visit) SELECT visit, id, round(score, 6) AS score FROM b ORDER BY b.score DESC, id LIMIT 12""",
    *DET,
)
def a50_plate_shortlist(t: Tables) -> DataFrame:
    """Twelve pictures, one a visit, among which the plate is chosen."""
    found = exports.plate_shortlist(t.detections.select("id", F.col("source").alias("visit"), (F.col("k") / 100.0).alias("share"), "confidence"))
    return found.select("visit", "id", F.round("score", 6).alias("score"))


@register(
    """WITH t AS (SELECT source, species, started_at, min(ts) AS a, max(ts) AS b, count(DISTINCT k) AS kinds FROM stamped WHERE k >= 20 GROUP BY ALL)
    SELECT s.species, c.clip_id, CASE WHEN c.detections >= 2 THEN 'several' WHEN count(t.source) = 0 THEN 'no visit' WHEN max(t.kinds) > 1 THEN 'mixed' ELSE 'linked' END AS outcome
    FROM clips c CROSS JOIN (SELECT DISTINCT species FROM t) s LEFT JOIN t ON t.species = s.species AND c.source = t.source AND c.start_at <= t.b AND c.end_at >= t.a GROUP BY s.species, c.clip_id, c.detections""",
    *STAMPED, "clip_flagged", "clip_stamped", "clips",
)
def l34_link_all_species(t: Tables) -> DataFrame:
    """What becomes of each clip's track, for every species that has named visits."""
    named = t.stamped.where("k >= 20").groupBy("source", "species", "started_at").agg(F.min("ts").alias("b0"), F.max("ts").alias("b1"), F.count_distinct("k").alias("kinds"))
    c = t.clips.select("source", "clip_id", F.col("start_at").alias("a0"), F.col("end_at").alias("a1"))
    kinds = intervals.overlap_join(c, named.drop("started_at")).groupBy("species", "clip_id").agg(F.max("kinds").alias("kinds"))
    every = t.clips.select("clip_id", "detections").withColumn("species", F.explode(F.array(*(F.lit(s) for s in sorted(r[0] for r in named.select("species").distinct().collect())))))
    outcome = F.when(F.col("detections") >= 2, "several").when(F.col("kinds").isNull(), "no visit").when(F.col("kinds") > 1, "mixed").otherwise("linked")
    return every.join(kinds, ["species", "clip_id"], "left").select("species", "clip_id", outcome.alias("outcome"))
