"""Queries of stored records: clips, references, states, favourites, zones, scans and the writes that change them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.functions.columns import micros
from visitlens.operators import intervals, ledger, places, profiles, sessions
from visitlens.plans.geometry import night_frames
from visitlens.plans.registry import CLIPS, DET, STAMPED, VISITS, register
from visitlens.sources.fixtures import Tables


@register("SELECT clip_id, source, start_at, end_at, coalesce(nullif(detections, 0) / 2.0, epoch_us(end_at - start_at) / 1e6) AS seconds FROM (SELECT * FROM clips WHERE detections < 5)".replace("epoch_us(end_at - start_at)", "(epoch_us(end_at) - epoch_us(start_at))"), *CLIPS)
def s12_playable_clips(t: Tables) -> DataFrame:
    """Clips that were not pruned, with their length by frames or else by their span."""
    span = columns.seconds_between("start_at", "end_at")
    return t.clips.where("detections < 5").select("clip_id", "source", "start_at", "end_at", F.coalesce(F.nullif("detections", F.lit(0)) / 2.0, span).alias("seconds"))


@register("SELECT DISTINCT c.source || '|' || strftime(c.end_at, '%Y%m%d%H%M%S') AS key FROM clips c", *CLIPS)
def s17_video_keys(t: Tables) -> DataFrame:
    return t.clips.select(F.concat_ws("|", F.col("source").cast("string"), F.date_format("end_at", "yyyyMMddHHmmss")).alias("key")).distinct()


@register("SELECT d.id, d.k AS ref_id, c.name, c.vec_id % 2 = 0 AS retired FROM detections d LEFT JOIN crops c ON c.vec_id = d.k WHERE d.species = 'view'", *DET, "crops")
def s30_reference_by_id(t: Tables) -> DataFrame:
    """The reference that each suppressed row names, retired or not."""
    references = t.crops.select(F.col("vec_id").alias("ref_id"), "name", (F.col("vec_id") % 2 == 0).alias("retired"))
    return ledger.with_reference(t.detections.where("species = 'view'").select("id", F.col("k").alias("ref_id")), references)


@register("SELECT individual AS name, arg_max(species, (ts, id)) AS status FROM detections GROUP BY individual", *DET)
def s33_statuses(t: Tables) -> DataFrame:
    return ledger.latest(t.detections.select(F.col("individual").alias("name"), F.col("species").alias("status"), "ts", "id"), ["name"], "ts", ["status"], "id")


@register("SELECT lower(individual) AS name, CAST(max(ts) FILTER (species = 'error') AS DATE) AS last_day, CAST(max(ts) FILTER (species = 'signup') AS DATE) AS returned_on FROM detections WHERE k < 20 GROUP BY lower(individual)", *DET, dates=("last_day", "returned_on"))
def s34_departed_intervals(t: Tables) -> DataFrame:
    last = lambda s: F.to_date(F.max(F.when(F.col("species") == s, F.col("ts"))))
    return t.detections.where("k < 20").groupBy(F.lower("individual").alias("name")).agg(last("error").alias("last_day"), last("signup").alias("returned_on"))


@register("SELECT id, individual, CASE WHEN k % 2 = 0 THEN ts END AS dated FROM detections WHERE individual = 'k7' OR individual = 'k8'", *DET)
def s35_life_events(t: Tables) -> DataFrame:
    rows = t.detections.where("individual in ('k7', 'k8')").select("id", "individual", F.when(F.col("k") % 2 == 0, F.col("ts")).alias("dated"), "ts")
    return rows.orderBy(F.desc(F.coalesce("dated", "ts")), F.desc("id")).drop("ts")


@register("SELECT DISTINCT source, started_at FROM stamped WHERE species = 'purchase'", *STAMPED)
def s37_favourite_keys(t: Tables) -> DataFrame:
    return t.stamped.where("species = 'purchase'").select("source", "started_at").distinct()


@register("SELECT species, id, rk AS rank FROM (SELECT species, id, row_number() OVER (PARTITION BY species ORDER BY confidence DESC, id) AS rk FROM detections WHERE k <> 13) WHERE rk <= 5", *DET)
def s41_decoy_tray(t: Tables) -> DataFrame:
    return profiles.top_per_group(t.detections.where("k <> 13"), "species", 5, F.desc("confidence"), F.col("id")).select("species", "id", "rank")


#: Where in the order of qualities the pictures are taken.
SPREAD = [0.0, 0.04, 0.10, 0.20, 0.33, 0.48, 0.62, 0.75, 0.86, 0.95]


@register(
    f"""WITH r AS (SELECT vec_id, quality, row_number() OVER (ORDER BY quality, vec_id) - 1 AS position, count(*) OVER () AS n FROM crops WHERE quality IS NOT NULL),
    p AS (SELECT DISTINCT CAST(round_even(p * (n - 1), 0) AS BIGINT) AS position FROM (SELECT unnest({SPREAD}) AS p) s, (SELECT max(n) AS n FROM r) m)
    SELECT vec_id, quality, position, vec_id % 24 >= 20 OR vec_id % 24 < 6 AS night FROM r JOIN p USING (position)""",
    "crops",
)
def s46_quality_spread(t: Tables) -> DataFrame:
    """Ten crops from the softest to the crispest, by their place among all; with the hour, whether it was night."""
    found = ledger.at_shares(t.crops.where("quality is not null").select("vec_id", "quality"), SPREAD, "quality", "vec_id")
    hour = F.col("vec_id") % 24
    return found.select("vec_id", "quality", "position", ((hour >= 20) | (hour < 6)).alias("night"))


@register("SELECT event_id FROM events WHERE NOT EXISTS (SELECT 1 FROM documents WHERE doc_id = event_id)")
def s48_cross_check(t: Tables) -> DataFrame:
    """Rows whose file is not there, over all rows."""
    from visitlens.sources.stores import missing_files

    files = t.read("documents").select(F.col("doc_id").cast("string").alias("path"))
    rows = t.read("events").select(F.col("event_id").cast("string").alias("file"))
    return missing_files(rows, files, "file").select(F.col("file").cast("long").alias("event_id"))


@register("SELECT event_id, ts AS instant, CAST(ts AS DATE) AS day FROM events", dates=("day",))
def p1_parse_times(t: Tables) -> DataFrame:
    """Instants and days from ISO text."""
    text = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    rows = t.read("events").select("event_id", text.alias("text"))
    return rows.select("event_id", F.expr("try_cast(text as timestamp_ntz)").alias("instant"), columns.as_date("text").alias("day"))


@register("SELECT c.clip_id FROM clips c WHERE c.detections >= 2 AND c.clip_id NOT IN (SELECT doc_id FROM documents)", *CLIPS)
def p10_pending_tracklets(t: Tables) -> DataFrame:
    done = t.read("documents").select(F.col("doc_id").alias("clip_id"))
    return t.clips.where("detections >= 2").select("clip_id").join(done, "clip_id", "left_anti")


@register("SELECT conv_id, turn, coalesce(nullif(role, ''), 'user') AS who, len([role, role || '2']) AS names FROM conversations")
def p13_sightings_decoded(t: Tables) -> DataFrame:
    """Names from a JSON list; one that can't be read has none."""
    text = F.concat(F.lit('["'), "role", F.lit('", "'), "role", F.lit('2"]'))
    return t.read("conversations").select("conv_id", "turn", F.coalesce(F.nullif("role", F.lit("")), F.lit("user")).alias("who"), F.size(columns.json_names(text)).cast("long").alias("names"))


def imported(t: Tables) -> tuple[DataFrame, DataFrame]:
    """Boxes on a coarse grid at forty sources, some with a vector for their picture; and marks in the middle of each source's numbers."""
    boxes, _ = night_frames(t)
    number = F.col("at") * 1000 + F.col("seq")
    rows = boxes.select((F.col("at") % 40).alias("source"), number.alias("id"), (F.col("at") * 60.0).alias("at_s"), *places.SIDES)
    rows = rows.withColumn("vec_id", F.col("id") % 3001).join(t.crops.select("vec_id", F.col("embedding").alias("thumb")), "vec_id", "left").drop("vec_id")
    return rows, rows.groupBy("source").agg(F.floor(F.max("id") / 2).alias("mark"))


@register()
def p23_import_sweep(t: Tables) -> DataFrame:
    """The rows of each import that a place dropped, and why; rows up to the mark of their source aren't judged."""
    dropped, _ = places.sweep(*imported(t), min_n=4, min_span_s=3 * 3600.0)
    return dropped.select("source", "id", "place", "n", "span_s", "reason", F.array_join(F.transform("anchor", lambda x: x.cast("long").cast("string")), ",").alias("anchor"))


# Label writes


@register("SELECT id, CASE WHEN id IN (SELECT k FROM detections WHERE species = 'purchase') THEN 'bulk' ELSE individual END AS individual FROM detections", *DET)
def l7_bulk_individual(t: Tables) -> DataFrame:
    named = t.detections.where("species = 'purchase'").select(F.col("k").alias("id"), F.lit("bulk").alias("bulk")).distinct()
    return t.detections.join(named, "id", "left").select("id", F.coalesce("bulk", "individual").alias("individual"))


@register(
    """WITH s AS (SELECT id, source, ts AS a0, ts + INTERVAL 1 HOUR AS a1 FROM detections WHERE species = 'signup')
    SELECT id, EXISTS (SELECT 1 FROM s o WHERE o.source = s.source AND o.id > s.id AND o.a0 <= s.a1 AND o.a1 >= s.a0) AS superseded FROM s""",
    *DET,
)
def l8_superseded_sightings(t: Tables) -> DataFrame:
    """A later sighting that overlaps takes an earlier one's place."""
    s = t.detections.where("species = 'signup'").select("id", "source", F.col("ts").alias("a0"), (F.col("ts") + F.expr("INTERVAL 1 HOUR")).alias("a1"))
    later = s.select("source", F.col("a0").alias("b0"), F.col("a1").alias("b1"), F.col("id").alias("other"))
    hit = intervals.overlap_join(s, later).where("other > id").select("id").distinct().withColumn("hit", F.lit(True))
    return s.select("id").join(hit, "id", "left").select("id", F.coalesce("hit", F.lit(False)).alias("superseded"))


@register("SELECT individual AS name, string_agg(CAST(id AS VARCHAR), ',' ORDER BY ts, id) AS events FROM detections WHERE species = 'signup' AND k < 20 GROUP BY individual", *DET)
def l16_life_event_log(t: Tables) -> DataFrame:
    rows = t.detections.where("species = 'signup' and k < 20")
    order = F.array_sort(F.collect_list(F.struct("ts", "id")))
    return rows.groupBy(F.col("individual").alias("name")).agg(F.array_join(F.transform(order, lambda x: x["id"].cast("string")), ",").alias("events"))


@register("SELECT c.clip_id, count(d.id) AS boxes, max(d.confidence) AS max_conf FROM clips c JOIN detections d ON d.source = c.source AND d.ts BETWEEN c.start_at AND c.end_at GROUP BY c.clip_id", *CLIPS)
def l33_scan_backfill(t: Tables) -> DataFrame:
    """Boxes and best confidence of each clip, recomputed from what lies inside it."""
    c = t.clips.select("source", "clip_id", F.col("start_at").alias("a0"), F.col("end_at").alias("a1"))
    d = t.detections.select("source", "id", "confidence", F.col("ts").alias("b0"), F.col("ts").alias("b1"))
    return intervals.overlap_join(c, d).groupBy("clip_id").agg(F.count("id").alias("boxes"), F.max("confidence").alias("max_conf"))


@register("SELECT source, ts AS moment, CASE WHEN species = 'error' THEN 'down' ELSE 'up' END AS event, lag(species) OVER (PARTITION BY source ORDER BY ts) IS DISTINCT FROM species AS changed FROM detections WHERE species IN ('error', 'signup')", *DET)
def l24_coverage_transitions(t: Tables) -> DataFrame:
    rows = sessions.with_previous(t.detections.where("species in ('error', 'signup')"), "species")
    changed = ~F.col("before").eqNullSafe(F.col("species"))
    return rows.select("source", F.col("ts").alias("moment"), F.when(F.col("species") == "error", "down").otherwise("up").alias("event"), changed.alias("changed"))


@register("SELECT individual AS name, arg_max(id, (ts, id)) AS avatar FROM detections WHERE species = 'purchase' AND individual IN (SELECT individual FROM detections WHERE species = 'view') GROUP BY individual", *DET)
def l25_avatar_pins(t: Tables) -> DataFrame:
    """A pin holds only for someone who was seen."""
    pins = t.detections.where("species = 'purchase'").join(t.detections.where("species = 'view'").select("individual"), "individual", "left_semi")
    return ledger.latest(pins.withColumnRenamed("individual", "name").withColumn("avatar", F.col("id")), ["name"], "ts", ["avatar"], "id")


@register("SELECT source, k FROM detections WHERE species = 'purchase' EXCEPT SELECT source, k FROM detections WHERE species = 'click'", *DET)
def l26_favourites_removed(t: Tables) -> DataFrame:
    pick = lambda s: t.detections.where(F.col("species") == s).select("source", "k")
    return pick("purchase").distinct().join(pick("click"), ["source", "k"], "left_anti")


@register("SELECT source, arg_max(individual, (ts, id)) AS note FROM detections WHERE species = 'click' GROUP BY source", *DET)
def l27_favourite_notes(t: Tables) -> DataFrame:
    return ledger.latest(t.detections.where("species = 'click'").withColumn("note", F.col("individual")), ["source"], "ts", ["note"], "id")


@register(
    """WITH e AS (SELECT source, ts, row_number() OVER (PARTITION BY source ORDER BY ts) AS epoch FROM detections WHERE species = 'signup')
    SELECT source, epoch, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS retired_at FROM e""",
    *DET,
)
def l30_retired_references(t: Tables) -> DataFrame:
    bumps = t.detections.where("species = 'signup'").select("source", F.col("ts").alias("at"))
    return ledger.epochs(bumps).select("source", "epoch", F.col("ended_at").alias("retired_at"))


@register("SELECT frame, seq, least(x1, x2) AS x1, least(y1, y2) AS y1, greatest(x1, x2) AS x2, greatest(y1, y2) AS y2 FROM boxes WHERE seq = 2", "boxes")
def l31_zone_corners(t: Tables) -> DataFrame:
    low, high = (lambda a, b: F.least(a, b)), (lambda a, b: F.greatest(a, b))
    return t.boxes.where("seq = 2").select("frame", "seq", low("x1", "x2").alias("x1"), low("y1", "y2").alias("y1"), high("x1", "x2").alias("x2"), high("y1", "y2").alias("y2"))


@register("SELECT source, arg_max(k, (ts, id)) AS setting, arg_min(individual, (ts, id)) AS created_by FROM detections WHERE species = 'click' GROUP BY source", *DET)
def l32_cameras_upserted(t: Tables) -> DataFrame:
    """The newest settings of each source, and who first added it."""
    at = F.struct("ts", "id")
    return t.detections.where("species = 'click'").groupBy("source").agg(F.max_by("k", at).alias("setting"), F.min_by("individual", at).alias("created_by"))


@register("SELECT min(doc_id) AS doc_id, sha256(text) AS content_sha256 FROM documents WHERE text IS NOT NULL GROUP BY sha256(text)")
def l35_certified_references(t: Tables) -> DataFrame:
    """One reference for each content."""
    return t.read("documents").where("text is not null").groupBy(F.sha2("text", 256).alias("content_sha256")).agg(F.min("doc_id").alias("doc_id"))


# Pages over visits and favourites


@register(
    """SELECT d.source, d.k, c.start_at IS NULL AS gone FROM (SELECT DISTINCT source, k, ts FROM detections WHERE species = 'view' AND k % 2 = 0) d LEFT JOIN (SELECT * FROM clips WHERE detections >= 2) c
    ON d.source = c.source AND d.ts = c.start_at""",
    *CLIPS,
)
def j27_favourites_resolved(t: Tables) -> DataFrame:
    """Favourites by their lasting key; one whose visit is gone stays, and says so."""
    kept = t.detections.where("species = 'view' and k % 2 = 0").select("source", "k", "ts").distinct()
    now = t.clips.where("detections >= 2").select("source", F.col("start_at").alias("ts"), F.lit(True).alias("there"))
    return kept.join(now, ["source", "ts"], "left").select("source", "k", F.col("there").isNull().alias("gone"))


@register("SELECT source, started_at, ended_at, n FROM visits WHERE TIMESTAMP '2024-01-10 12:00:00' BETWEEN started_at AND ended_at", *VISITS)
def j28_visit_at(t: Tables) -> DataFrame:
    return t.visits.where("timestamp_ntz'2024-01-10 12:00:00' between started_at and ended_at").select("source", "started_at", "ended_at", "n")


@register("SELECT clip_id, source, detections, rk AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY start_at DESC) AS rk FROM clips) WHERE rk <= 5", *CLIPS)
def j30_clips_for_individual(t: Tables) -> DataFrame:
    return profiles.top_per_group(t.clips, "source", 5, F.desc("start_at")).select("clip_id", "source", "detections", "rank")


@register(
    """SELECT individual, count(*) AS crops, count(DISTINCT source) AS sources, count(DISTINCT (source, started_at)) AS visits, min(ts) AS first, max(ts) AS last, count(*) FILTER (species = 'purchase') AS verified
    FROM stamped GROUP BY individual""",
    *STAMPED,
)
def j31_individual_profile(t: Tables) -> DataFrame:
    return t.stamped.groupBy("individual").agg(
        F.count(F.lit(1)).alias("crops"), F.count_distinct("source").alias("sources"), F.count_distinct(F.struct("source", "started_at")).alias("visits"), F.min("ts").alias("first"), F.max("ts").alias("last"), F.count_if(F.col("species") == "purchase").alias("verified")
    )


@register(
    """WITH m AS (SELECT c.clip_id, d.species, count(*) AS n FROM clips c JOIN detections d ON c.source = d.source AND d.ts BETWEEN c.start_at - INTERVAL 1 HOUR AND c.end_at + INTERVAL 1 HOUR GROUP BY ALL)
    SELECT clip_id, arg_min(species, (-n, species)) AS species FROM m GROUP BY clip_id""",
    *CLIPS,
)
def a37_clip_species(t: Tables) -> DataFrame:
    pad = F.expr("INTERVAL 1 HOUR")
    c = t.clips.select("source", "clip_id", (F.col("start_at") - pad).alias("a0"), (F.col("end_at") + pad).alias("a1"))
    d = t.detections.select("source", "species", F.col("ts").alias("b0"), F.col("ts").alias("b1"))
    n = intervals.overlap_join(c, d).groupBy("clip_id", "species").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("clip_id").agg(F.min_by("species", F.struct((-F.col("n")).alias("less"), "species")).alias("species"))


