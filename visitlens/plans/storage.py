"""Queries that write tables, ledgers and exports, read them back, and follow streams over them to their end."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.operators import evaluation, exports, identity, ledger, vectors
from visitlens.plans.identity import PROTO, blended, matcher
from visitlens.plans.registry import CLIPS, DET, VISITS, register
from visitlens.plans.streams import finish
from visitlens.plans.vectors import CROPS
from visitlens.sources import schema, stores, versions
from visitlens.sources.fixtures import Tables
from visitlens.sources.scratch import new_folder
from visitlens.streaming import live


def text(ts: str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd HH:mm:ss")


def as_rows(t: Tables) -> DataFrame:
    return t.detections.select("id", text("ts").alias("timestamp"), F.col("source").cast("string").alias("source"), "species", "confidence")


@register("SELECT id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS timestamp, CAST(source AS VARCHAR) AS source, species, CASE WHEN id % 2 = 0 THEN confidence END AS confidence FROM detections", *DET)
def s4_append_detections(t: Tables) -> DataFrame:
    """Rows appended in two parts; the older one lacks a column, which readers find empty."""
    root = new_folder(t.spark, "store")
    stores.append(as_rows(t).where("id % 2 = 0"), root, "detections")
    as_rows(t).where("id % 2 = 1").drop("confidence").write.mode("append").parquet(f"{root}/detections")
    return schema.read_table(t.spark, root, "detections").select("id", "timestamp", "source", "species", "confidence")


@register("SELECT count(*) AS columns, count(*) FILTER (c = 'visit_id') AS has_visit FROM (SELECT unnest(['id', 'visit_id', 'species']) AS c)")
def s3_evolved_schema(t: Tables) -> DataFrame:
    """A table of few columns read in the declared shape: what it lacks is there, what isn't declared is not."""
    root = new_folder(t.spark, "evolve")
    t.detections.select("id", "species", F.lit(1).alias("stray")).write.parquet(f"{root}/detections")
    found = schema.read_table(t.spark, root, "detections")
    wanted = [c for c in found.columns if c in ("id", "visit_id", "species", "stray")]
    return found.limit(1).select(F.lit(len(wanted)).cast("long").alias("columns"), F.lit(wanted.count("visit_id")).cast("long").alias("has_visit"))


@register("SELECT clip_id, strftime(start_at, '%Y-%m-%d %H:%M:%S') AS started_at, detections FROM clips", *CLIPS)
def s5_append_clips(t: Tables) -> DataFrame:
    root = new_folder(t.spark, "clips")
    stores.append(t.clips.select(F.col("clip_id").alias("id"), F.col("source").cast("string").alias("source"), text("start_at").alias("started_at"), F.col("detections").cast("int").alias("detection_count")), root, "clips")
    return schema.read_table(t.spark, root, "clips").select(F.col("id").alias("clip_id"), "started_at", F.col("detection_count").cast("long").alias("detections"))


@register("SELECT source % 16 AS part, clip_id, CASE WHEN source % 16 < 4 THEN 2 ELSE 1 END AS version FROM clips", *CLIPS)
def s6_replace_tracks(t: Tables) -> DataFrame:
    """The tracks of clips that were scanned anew replace the old ones; the others stay as they are."""
    root = new_folder(t.spark, "tracks")
    rows = t.clips.select((F.col("source") % 16).alias("part"), "clip_id", F.lit(1).alias("version"))
    versions.replace(rows, root, "part")
    versions.replace(rows.where("part < 4").withColumn("version", F.lit(2)), root, "part", gone=[])
    return versions.read(t.spark, root, rows.schema)


@register("SELECT vec_id, len(embedding) AS dim, CAST(round(list_sum(CAST(embedding AS DOUBLE[])) * 1000) AS BIGINT) AS total FROM crops", *CROPS)
def s7_append_vectors(t: Tables) -> DataFrame:
    """Vectors appended in the declared table and read back."""
    root = new_folder(t.spark, "vectors")
    stores.append(t.crops.select("vec_id", F.col("vec_id").alias("id"), F.col("vec_id").alias("detection_id"), F.size("embedding").alias("dim"), "embedding"), root, "detection_embeddings")
    found = schema.read_table(t.spark, root, "detection_embeddings")
    return found.select(F.col("detection_id").alias("vec_id"), F.col("dim").cast("long").alias("dim"), F.round(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double")) * 1000).cast("long").alias("total"))


@register("SELECT DISTINCT CAST(source AS VARCHAR) || '|' || strftime(ts, '%Y%m%d%H') AS skip_key FROM detections", *DET)
def s18_ledger_lines(t: Tables) -> DataFrame:
    """Keys appended to a ledger of lines in two runs that overlap, read as a set; blank lines are none."""
    path = new_folder(t.spark, "ledger")
    keys = t.detections.select("id", F.concat_ws("|", F.col("source").cast("string"), F.date_format("ts", "yyyyMMddHH")).alias("value"))
    keys.where("id % 3 > 0").select("value").write.mode("append").text(path)
    keys.where("id % 3 < 2").select("value").unionByName(keys.limit(1).select(F.lit("  ").alias("value"))).write.mode("append").text(path)
    return stores.read_ledger(t.spark, path).distinct()


@register("SELECT CAST(id AS VARCHAR) AS id, CAST(source AS VARCHAR) AS source FROM detections", *DET)
def s23_csv_bundle(t: Tables) -> DataFrame:
    """The CSV export read back: no private column is in it."""
    out = new_folder(t.spark, "bundle")
    stores.export_csv({"cameras": t.detections.select("id", "source", F.lit("hunter2").alias("password"), F.lit("root").alias("username"))}, out)
    return t.spark.read.csv(f"{out}/cameras", header=True)


@register("SELECT count(*) FILTER (k % 3 = 0) AS added, count(*) FILTER (k % 3 = 1) AS removed, CASE WHEN count(*) FILTER (k % 3 = 1) > 50 THEN 1 ELSE 0 END AS alarm FROM detections", *DET)
def s24_ledger_export(t: Tables) -> DataFrame:
    """Human verdicts as JSON lines: how many came and went since the last export, and whether too many went."""
    rows = t.detections.select("id", "species", "k")
    counts = stores.export_ledger(rows.where("k % 3 <> 1"), new_folder(t.spark, "ledger"), rows.where("k % 3 <> 0"))
    return t.spark.createDataFrame([tuple(counts[c] for c in ("added", "removed", "alarm"))], "added long, removed long, alarm int")


@register("SELECT id, species, k = 13 AS gone FROM detections", *DET)
def s27_deletion_manifest(t: Tables) -> DataFrame:
    """What a deletion takes away is written to the manifest first; together with the rest it is all rows."""
    path = new_folder(t.spark, "manifest")
    rows = t.detections.select("id", "species", "k")
    left = ledger.remove(rows, rows.where("k = 13"), ["id"], path)
    return left.select("id", "species", F.lit(False).alias("gone")).unionByName(t.spark.read.schema(rows.schema).parquet(path).select("id", "species", F.lit(True).alias("gone")))


@register("SELECT vec_id, round(embedding[1], 6) AS first FROM crops", *CROPS)
def f29_decoded_vectors(t: Tables) -> DataFrame:
    """Vectors kept as blobs of 32-bit floats, decoded."""
    @F.pandas_udf("binary")
    def blob(v: pd.Series) -> pd.Series:
        return v.map(lambda x: x.astype("<f4").tobytes())

    stored = t.crops.select("vec_id", blob("embedding").alias("embedding"))
    return stores.decode_vectors(stored).select("vec_id", F.round(F.col("embedding")[0].cast("double"), 6).alias("first"))


@register("SELECT clip_id, end_at - to_microseconds(CAST((detections * 2.5) * 1000000 AS BIGINT)) AS started_at FROM clips", *CLIPS)
def f39_video_spans(t: Tables) -> DataFrame:
    """When each video began: as long before it was written as it lasts."""
    media = t.clips.select("clip_id", F.col("end_at").cast("timestamp").alias("modificationTime"), (F.col("detections") * 2.5).alias("duration_s"))
    return stores.video_span(media).select("clip_id", F.col("started_at").cast("timestamp_ntz").alias("started_at"))


@register(
    """SELECT id, CASE WHEN k % 4 = 0 THEN NULL ELSE CAST(ts AS DATE) END AS day, strftime(ts, '%G-W%V') AS week, species LIKE '%_c1' OR k % 5 = 0 AS placeholder,
    CASE WHEN k = 0 THEN NULL WHEN k / 50.0 > 1.15 THEN 'approaching' WHEN k / 50.0 < 0.85 THEN 'retreating' ELSE 'steady' END AS approach FROM detections""",
    *DET, dates=("day",),
)
def p2_dates_and_labels(t: Tables) -> DataFrame:
    """Dates from texts that may not hold one, weeks, placeholder names and approaches."""
    d = t.detections
    name = F.when(F.col("k") % 5 == 0, "fox_c12").otherwise("stan_c")
    return d.select(
        "id", columns.as_date(F.when(F.col("k") % 4 == 0, "soon").otherwise(text("ts"))).alias("day"), columns.iso_week("ts").alias("week"), columns.is_placeholder(name).alias("placeholder"),
        columns.approach_label(F.nullif(F.col("k"), F.lit(0)) / 50.0).alias("approach"),
    )


@register("SELECT a.source, a.started_at, coalesce(a.started_at <= b.ended_at AND a.ended_at >= b.started_at, FALSE) AS meets FROM visits a LEFT JOIN (SELECT source, min(started_at) AS started_at, min(ended_at) AS ended_at FROM visits WHERE n > 1 GROUP BY source) b ON a.source = b.source", *VISITS)
def f11_spans_that_meet(t: Tables) -> DataFrame:
    first = t.visits.where("n > 1").groupBy("source").agg(F.min("started_at").alias("b0"), F.min("ended_at").alias("b1"))
    return t.visits.join(first, "source", "left").select("source", "started_at", columns.spans_overlap("started_at", "ended_at", "b0", "b1").alias("meets"))


@register("WITH p AS (SELECT o_orderkey AS id, o_totalprice AS x, CAST(o_custkey AS DOUBLE) AS y FROM orders), e AS (SELECT min(x) AS x0, min(y) AS y0, greatest(max(x) - min(x), max(y) - min(y)) AS s FROM p) SELECT id, round((x - x0) / s, 9) AS x, round((y - y0) / s, 9) AS y FROM p, e")
def f34_unit_square(t: Tables) -> DataFrame:
    points = t.read("orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").cast("double").alias("x"), F.col("o_custkey").cast("double").alias("y"))
    return vectors.unit_square(points).select("id", F.round("x", 9).alias("x"), F.round("y", 9).alias("y"))


@register()
def e26_fold_splits(t: Tables) -> DataFrame:
    """Seeded folds of the names that people gave: each position once a repeat."""
    n = t.crops.select("name", "night").distinct().count()
    return t.spark.createDataFrame(evaluation.fold_table(n, 5, 2, 7), "repeat long, fold long, position long")


# Streams over a given table, to their end


def boxes_stream(t: Tables) -> DataFrame:
    path = f"{t.sf_dir}/lineitem.parque[t]"
    rows = t.spark.readStream.schema(t.read("lineitem").schema).parquet(path)
    x, y = (F.round(F.col("l_quantity") / 10) * 100).cast("double"), (F.round(F.col("l_extendedprice") % 500 / 100) * 100).cast("double")
    return rows.select((F.col("l_suppkey") % 20).cast("string").alias("source"), F.floor(F.col("l_orderkey") / 100_000_000).alias("epoch"), (F.col("l_orderkey") * 60.0 + F.col("l_linenumber")).alias("at_s"), x.alias("x1"), y.alias("y1"), (x + 80).alias("x2"), (y + 80).alias("y2"))


@register()
def g9_recurring_places(t: Tables) -> DataFrame:
    """Places where boxes come back, with their events and days, as the stream leaves them: the last state of each source."""
    out = new_folder(t.spark, "places")

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = live.recurrences(boxes_stream(t)).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    rows = t.spark.read.schema("source string, epoch long, cluster long, events long, days long, batch int").option("basePath", f"{out}/rows").parquet(f"{out}/rows")
    last = rows.groupBy("source").agg(F.max("batch").alias("batch"))
    return rows.join(last, ["source", "batch"]).drop("batch")


@register()
def m7_view_changes(t: Tables) -> DataFrame:
    """Lasting changes of view at forty cameras, from day frames that stay unlike the view."""
    path = f"{t.sf_dir}/lineitem.parque[t]"
    rows = t.spark.readStream.schema(t.read("lineitem").schema).parquet(path)
    marks = rows.select((F.col("l_suppkey") % 40).cast("string").alias("source"), (F.col("l_orderkey") * 60.0 + F.col("l_linenumber")).alias("at_s"), (F.col("l_linenumber") != 1).alias("day"), F.when(F.floor(F.col("l_orderkey") / 50) % 2 == 0, 0.9).otherwise(0.2).alias("corr"))
    return finish(t, live.view_changes(marks))


@register("SELECT id, upper(species) AS label FROM detections", *DET)
def r2_label_loop(t: Tables) -> DataFrame:
    """New rows labelled batch by batch by the polling loop, stopped when it has caught up."""
    out = new_folder(t.spark, "labels")
    rows = t.spark.readStream.schema(t.read("events").schema).parquet(f"{t.sf_dir}/events.parque[t]").select(F.col("event_id").alias("id"), F.col("event_type").alias("species"))
    query = live.label_loop(rows, lambda b: b.select("id", F.upper("species").alias("label")), f"{out}/rows", f"{out}/state", every="0 seconds")
    query.processAllAvailable()
    query.stop()
    return t.spark.read.schema("id long, label string, batch int").option("basePath", f"{out}/rows").parquet(f"{out}/rows").drop("batch")


@register("SELECT event_id AS id, CAST(user_id AS VARCHAR) AS source, value / 500 AS confidence FROM events")
def r1_continuous_append(t: Tables) -> DataFrame:
    """Rows appended to the store as a capture thread drops its files."""
    drop = new_folder(t.spark, "drop")
    given = t.detections.select("id", F.col("source").cast("string").alias("source"), "confidence")
    for part in range(2):
        given.where(F.pmod("id", F.lit(2)) == part).write.mode("append").parquet(drop)
    return finish(t, live.watch(t.spark, drop, "id long, source string, confidence double", per_trigger=1))


# Label writes, guards and exports that the page shows


@register("SELECT source, started_at, ended_at, n FROM visits WHERE source % 4 <> 0", *VISITS)
def l21_cleared_visits(t: Tables) -> DataFrame:
    """Visits of some sources cleared for a rebuild: their partitions go, the others are not touched."""
    root = new_folder(t.spark, "visits")
    rows = t.visits.select("source", "started_at", "ended_at", "n", (F.col("source") % 4).alias("part"))
    versions.replace(rows, root, "part")
    versions.replace(rows.limit(0), root, "part", gone=[0])
    return versions.read(t.spark, root, rows.schema).drop("part")


@register("SELECT c.clip_id, s.n AS boxes, s.best AS max_conf, s.n IS NOT NULL AS scanned FROM clips c LEFT JOIN (SELECT source, count(*) AS n, max(confidence) AS best FROM detections WHERE species = 'purchase' GROUP BY source) s ON s.source = c.source", *CLIPS)
def l23_scanned_clips(t: Tables) -> DataFrame:
    """The newest scan of each clip stamped on it; a clip that was never scanned has nulls."""
    scans = t.clips.select("clip_id", "source").join(t.detections.where("species = 'purchase'").groupBy("source").agg(F.count(F.lit(1)).alias("boxes"), F.max("confidence").alias("max_conf")), "source")
    old = scans.select("clip_id", F.lit("2024-01-01").alias("at"), F.lit(0).cast("long").alias("boxes"), F.lit(0.0).alias("max_conf"))
    events = old.unionByName(scans.select("clip_id", F.lit("2024-02-01").alias("at"), "boxes", "max_conf"))
    return ledger.stamped(t.clips.select("clip_id"), events, ["clip_id"], "at", ["boxes", "max_conf"]).select("clip_id", "boxes", "max_conf", F.col("at").isNotNull().alias("scanned"))


@register("SELECT source, arg_max(id, (ts, id)) AS id, count(*) AS saved, count(*) FILTER (species NOT IN ('view', 'click')) AS refused FROM detections GROUP BY source HAVING count(*) FILTER (species IN ('view', 'click')) > 0".replace("arg_max(id, (ts, id))", "arg_max(id, (ts, id)) FILTER (species IN ('view', 'click'))").replace("count(*) AS saved", "count(*) FILTER (species IN ('view', 'click')) AS saved"), *DET)
def l29_saved_references(t: Tables) -> DataFrame:
    """References of a known light are saved, the others refused; the newest of each source."""
    rows = t.detections.select("id", "source", "ts", F.col("species").alias("illumination"), F.lit("frame").alias("provenance"))
    good, refused = ledger.valid_references(rows, lights=["view", "click"])
    newest = ledger.latest(good, ["source"], "ts", ["id"], "id").join(good.groupBy("source").agg(F.count(F.lit(1)).alias("saved")), "source")
    return newest.join(refused.groupBy("source").agg(F.count(F.lit(1)).alias("refused")), "source", "left").select("source", "id", "saved", F.coalesce("refused", F.lit(0)).cast("long").alias("refused"))


@register(PROTO + " SELECT p.source, p.visit, count(t.visit) AS pool, count(DISTINCT t.name) AS names FROM protos p LEFT JOIN templates t ON t.source = p.source GROUP BY p.source, p.visit", "crops")
def p20_template_pool(t: Tables) -> DataFrame:
    """How many templates each visit may be ranked against: those of its own source, none where it has none."""
    protos, _, made = matcher(t)
    return identity.template_pool(protos.select("source", "visit"), made)


@register(
    PROTO + """, g AS (SELECT t.source, t.name, dim, x FROM (SELECT source, name, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM templates) t), a AS (SELECT name, dim, avg(x) AS x FROM g GROUP BY ALL), counted AS (SELECT name, count(*) AS tracklets FROM templates GROUP BY name)
    SELECT a.name, any_value(c.tracklets) AS tracklets, round(sqrt(sum(power(x, 2))) / nullif(sqrt(sum(power(x, 2))), 0), 6) AS norm FROM a JOIN counted c USING (name) GROUP BY a.name""",
    "crops",
)
def a47_fold_centroids(t: Tables) -> DataFrame:
    """One unit vector and a count for each name, over all sources."""
    made = identity.fold_centroids(matcher(t)[2])
    return made.select("name", "tracklets", F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm"))


@register("SELECT id, k / 100.0 AS notch, CASE WHEN value < 50 THEN NULL ELSE value / 100 END AS mask FROM detections", *DET)
def m14_appearance_only(t: Tables) -> DataFrame:
    """The traits that may rank: those of appearance; how an animal behaves is refused."""
    rows = t.detections.select("id", F.array(*(F.struct(F.lit(axis).alias("axis"), F.lit(name).alias("trait"), v.cast("double").alias("value")) for axis, name, v in (("appearance", "notch", F.col("k") / 100.0), ("appearance", "mask", F.when(F.col("value") >= 50, F.col("value") / 100)), ("appearance", "whim", F.lit(1.0))))).alias("traits"))
    return exports.appearance_traits(rows, "traits", ["notch", "mask"]).select("id", "notch", "mask")


@register()
def a51_poses(t: Tables) -> DataFrame:
    """The twelve largest poses of one name."""
    crops = t.crops.where("name = 3").select("name", F.col("vec_id").alias("id"), "quality", F.col("night").cast("string").alias("at"), vectors.unit("embedding").alias("embedding"))
    return identity.pose_groups(crops, distance=0.6).where("pose < 12").select("name", "pose", "n", "cohesion")


@register(
    "WITH named AS (SELECT DISTINCT source, started_at FROM stamped WHERE individual = 'k7'), v AS (SELECT v.* FROM visits v JOIN named n ON n.source = v.source AND n.started_at = v.started_at)"
    " SELECT DISTINCT c.clip_id, c.source, c.detections FROM clips c JOIN v ON v.source = c.source AND c.start_at <= v.ended_at AND c.end_at >= v.started_at",
    *CLIPS, "flagged", "stamped", "visits",
)
def a52_clips_of_name(t: Tables) -> DataFrame:
    """The clips that overlap a visit of one name."""
    named = t.stamped.where("individual = 'k7'").select("source", "started_at").distinct()
    return exports.clips_of(t.visits.join(named, ["source", "started_at"]), t.clips).select("clip_id", "source", "detections")


@register()
def a53_unblend(t: Tables) -> DataFrame:
    """The animals of each visit: by its tracks in clips where they tell two apart, else by its stills."""
    crops, made, logged = blended(t)
    stills = identity.unblend_stills(crops, made, logged, threshold=0.2)
    rows = t.crops.select(F.col("visit").cast("long").alias("visit"), F.col("vec_id").alias("id"), vectors.unit("embedding").alias("embedding"))
    return exports.unblended(identity.unblend_clips(rows, distance=0.9), stills).select("visit", "basis", "cluster", "n")


@register("SELECT 'labels' AS file, count(*) AS rows_out FROM detections WHERE k <> 13 UNION ALL SELECT 'species', count(DISTINCT species) FROM detections WHERE k <> 13", *DET)
def s26_public_dataset(t: Tables) -> DataFrame:
    """The public extracts, without what is denied, as they are read back."""
    out = new_folder(t.spark, "public")
    rows = t.detections.select("id", "species", "confidence", F.col("k").alias("owner"))
    exports.public_dataset({"labels": rows, "species": rows.groupBy("species", "owner").agg(F.count(F.lit(1)).alias("n"))}, out, denied=t.spark.createDataFrame([(13,)], "owner long"), key="owner")
    of = lambda name, c: t.spark.read.json(f"{out}/{name}").agg(F.count_distinct(c).alias("rows_out")).select(F.lit(name).alias("file"), "rows_out")
    return of("labels", "id").unionByName(of("species", "species"))


@register()
def s42_appearance(t: Tables) -> DataFrame:
    """Crops and prototypes of names in one plane: the basis is fitted on the crops, and both are scaled together."""
    protos = vectors.centroids(t.crops, ["name"])
    found = exports.appearance(t.crops.select("vec_id", "name", "embedding"), protos)
    return found.select("kind", "id", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register(PROTO + " SELECT source, visit, list(name ORDER BY rk)[1] AS first, count(*) AS choices FROM ranked WHERE rk <= 3 AND (source, visit) IN (SELECT (source, visit) FROM labels ORDER BY source, visit LIMIT 24) GROUP BY source, visit", "crops")
def s44_matching_game(t: Tables) -> DataFrame:
    """A sample of named visits, each with three names to choose from."""
    protos, labels, made = matcher(t)
    asked = labels.orderBy("source", "visit").limit(24).select("source", "visit")
    found = identity.suggestions(protos.join(F.broadcast(asked), ["source", "visit"], "left_semi"), made, k=3)
    return found.groupBy("source", "visit").agg(F.min_by("name", "rank").alias("first"), F.count(F.lit(1)).alias("choices"))
