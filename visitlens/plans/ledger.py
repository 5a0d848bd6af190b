"""Queries over label events, imports and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.functions.columns import name_key
from visitlens.operators import ledger
from visitlens.plans.registry import DET, STAMPED, register
from visitlens.sources.fixtures import Tables

#: Label events: purchases relabel the detection that their number points to.
EVENTS = "events_l AS (SELECT k AS id, ts AS moment, CASE WHEN value > 250 THEN 'fox' ELSE 'hare' END AS species FROM detections WHERE species = 'purchase')"


def label_events(t: Tables) -> DataFrame:
    return t.detections.where("species = 'purchase'").select(F.col("k").alias("id"), F.col("ts").alias("at"), F.when(F.col("value") > 250, "fox").otherwise("hare").alias("species"))


LATEST = "WITH " + EVENTS + ", newest AS (SELECT id, arg_max(species, moment) AS human FROM events_l GROUP BY id)"


@register(LATEST + " SELECT id, human AS species FROM newest", *DET)
def l1_latest_species(t: Tables) -> DataFrame:
    return ledger.latest(label_events(t), ["id"], "at", ["species"])


@register(LATEST + """ SELECT d.id, coalesce(human, species) AS species, CASE WHEN human IS NOT NULL THEN species END AS model_species, CAST(CASE WHEN human IS NOT NULL THEN 1 END AS BIGINT) AS verified
    FROM detections d LEFT JOIN newest n ON d.id = n.id""", *DET)  # fmt: skip
def l2_corrected_species(t: Tables) -> DataFrame:
    return ledger.apply_labels(t.detections, label_events(t))


@register("SELECT id, arg_max(v, moment) AS verified FROM (SELECT k AS id, ts AS moment, CAST(value > 250 AS INTEGER) AS v FROM detections WHERE species = 'signup') GROUP BY id", *DET)
def l3_verified(t: Tables) -> DataFrame:
    e = t.detections.where("species = 'signup'").select(F.col("k").alias("id"), F.col("ts").alias("at"), (F.col("value") > 250).cast("int").alias("verified"))
    return ledger.latest(e, ["id"], "at", ["verified"])


@register("SELECT s.id, 'n' || (s.source % 7) AS name FROM stamped s JOIN (SELECT source, started_at, min(ts) AS m FROM stamped WHERE k >= 90 GROUP BY ALL) l ON s.source = l.source AND s.started_at = l.started_at", *STAMPED)
def l4_label_visits(t: Tables) -> DataFrame:
    """A person names whole visits: all their members get the name."""
    labelled = t.stamped.where("k >= 90").select("source", "started_at").distinct()
    return t.stamped.join(labelled, ["source", "started_at"], "left_semi").select("id", F.concat(F.lit("n"), (F.col("source") % 7).cast("string")).alias("name"))


@register("SELECT id, CASE WHEN individual IN ('k1', 'k2', 'k3') THEN 'K0' ELSE individual END AS individual FROM detections", *DET)
def l6_renamed(t: Tables) -> DataFrame:
    names = t.detections.where("k between 1 and 3").select(F.upper("individual").alias("old"), F.lit("K0").alias("new")).distinct()
    return ledger.renamed(t.detections.select("id", "individual"), names, "individual")


@register("SELECT lower(individual) AS name, arg_max(species, (ts, id)) AS status, max(ts) AS moment FROM detections WHERE species IN ('signup', 'error') GROUP BY lower(individual)", *DET)
def l9_status(t: Tables) -> DataFrame:
    e = t.detections.where("species in ('signup', 'error')").select(F.lower("individual").alias("name"), F.col("species").alias("status"), F.col("ts").alias("moment"), "id")
    return ledger.latest(e, ["name"], "moment", ["status", "moment"], "id")


@register("SELECT source, k, min(ts) AS added FROM detections WHERE species = 'purchase' GROUP BY source, k", *DET)
def l10_favourites(t: Tables) -> DataFrame:
    """Adding twice is the same as once."""
    return t.detections.where("species = 'purchase'").groupBy("source", "k").agg(F.min("ts").alias("added"))


@register("SELECT d.id, d.species, d.id IN (SELECT k FROM detections WHERE species = 'error') AS suppressed FROM detections d", *DET)
def l11_suppressed(t: Tables) -> DataFrame:
    flagged = t.detections.where("species = 'error'").select(F.col("k").alias("id")).distinct().withColumn("hit", F.lit(True))
    return t.detections.join(flagged, "id", "left").select("id", "species", F.coalesce("hit", F.lit(False)).alias("suppressed"))


@register("SELECT DISTINCT source, k FROM detections WHERE species = 'signup' EXCEPT SELECT source, k FROM detections WHERE species = 'error'", *DET)
def l13_seed_once(t: Tables) -> DataFrame:
    """Only keys that were never seen are seeded."""
    seen = t.detections.where("species = 'error'").select("source", "k")
    return t.detections.where("species = 'signup'").select("source", "k").distinct().join(seen, ["source", "k"], "left_anti")


@register("SELECT source, row_number() OVER (PARTITION BY source ORDER BY ts) AS epoch, ts AS started_at, lead(ts) OVER (PARTITION BY source ORDER BY ts) AS ended_at FROM detections WHERE species = 'signup'", *DET)
def l14_epochs(t: Tables) -> DataFrame:
    return ledger.epochs(t.detections.where("species = 'signup'").select("source", F.col("ts").alias("at")))


@register("SELECT source, max(epoch) AS epoch, max(started_at) AS started_at FROM (SELECT source, row_number() OVER (PARTITION BY source ORDER BY ts) AS epoch, ts AS started_at FROM detections WHERE species = 'signup') GROUP BY source", *DET)
def s31_current_epoch(t: Tables) -> DataFrame:
    return l14_epochs(t).groupBy("source").agg(F.max("epoch").alias("epoch"), F.max("started_at").alias("started_at"))


@register("SELECT id, species FROM detections d WHERE NOT EXISTS (SELECT 1 FROM detections e WHERE e.species = 'error' AND e.source = d.source AND e.k = d.k)", *DET)
def l15_static_delete(t: Tables) -> DataFrame:
    return ledger.remove(t.detections, t.detections.where("species = 'error'"), ["source", "k"]).select("id", "species")


@register("SELECT d.id, n.note FROM detections d LEFT JOIN (SELECT k, arg_max(CAST(value AS INTEGER), (ts, id)) AS note FROM detections WHERE species = 'click' GROUP BY k) n ON d.id = n.k", *DET)
def l18_quality_side_table(t: Tables) -> DataFrame:
    notes = ledger.latest(t.detections.where("species = 'click'").withColumn("note", F.rint("value").cast("int")), ["k"], "ts", ["note"], "id").select(F.col("k").alias("id"), "note")
    return t.detections.select("id").join(notes, "id", "left")


@register(
    """WITH o AS (SELECT DISTINCT individual, species FROM detections WHERE ts < TIMESTAMP '2024-01-15 00:00:00'), n AS (SELECT DISTINCT individual, species FROM detections WHERE k % 9 <> 0)
    SELECT *, 'added' AS change FROM (SELECT * FROM n EXCEPT SELECT * FROM o) UNION ALL SELECT *, 'removed' FROM (SELECT * FROM o EXCEPT SELECT * FROM n)""",
    *DET,
)
def u1_ledger_diff(t: Tables) -> DataFrame:
    rows = lambda c: t.detections.where(c).select("individual", "species")
    return ledger.difference(rows("ts < timestamp_ntz'2024-01-15 00:00:00'"), rows("k % 9 <> 0"))


@register("SELECT source AS key FROM detections WHERE species = 'error' UNION SELECT k FROM detections WHERE species = 'view'", *DET)
def u2_key_union(t: Tables) -> DataFrame:
    return t.detections.where("species = 'error'").select(F.col("source").alias("key")).union(t.detections.where("species = 'view'").select("k")).distinct()


@register("SELECT id FROM detections WHERE species = 'view' AND id NOT IN (SELECT k FROM detections WHERE species = 'error')", *DET)
def u3_work_difference(t: Tables) -> DataFrame:
    done = t.detections.where("species = 'error'").select(F.col("k").alias("id"))
    return t.detections.where("species = 'view'").select("id").join(done, "id", "left_anti")


@register("SELECT 'view' AS kind, id, confidence, NULL AS name FROM detections WHERE species = 'view' UNION ALL SELECT 'sign', id, NULL, individual FROM detections WHERE species = 'signup'", *DET)
def u5_mixed_union(t: Tables) -> DataFrame:
    views = t.detections.where("species = 'view'").select(F.lit("view").alias("kind"), "id", "confidence")
    signs = t.detections.where("species = 'signup'").select(F.lit("sign").alias("kind"), "id", F.col("individual").alias("name"))
    return views.unionByName(signs, allowMissingColumns=True)


@register(
    """WITH o AS (SELECT individual AS metric, round(avg(confidence), 6) AS was FROM detections WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY individual),
    n AS (SELECT individual AS metric, round(avg(confidence), 6) AS now FROM detections WHERE ts >= TIMESTAMP '2024-01-15 00:00:00' AND k % 9 <> 0 GROUP BY individual)
    SELECT coalesce(o.metric, n.metric) AS metric, was, now, CASE WHEN was IS NULL THEN 'new' WHEN now IS NULL THEN 'gone' WHEN abs(now - was) <= 0.02 THEN 'same' WHEN now > was THEN 'better' ELSE 'worse' END AS verdict
    FROM o FULL JOIN n ON o.metric = n.metric""",
    *DET,
)
def u6_artifact_diff(t: Tables) -> DataFrame:
    metrics = lambda c: t.detections.where(c).groupBy(F.col("individual").alias("metric")).agg(F.round(F.avg("confidence"), 6).alias("value"))
    return ledger.compare_metrics(metrics("ts < timestamp_ntz'2024-01-15 00:00:00'"), metrics("ts >= timestamp_ntz'2024-01-15 00:00:00' and k % 9 <> 0"), 0.02)


IMPORT = """WITH b AS (SELECT doc_id, source AS owner, sha256(text) AS sha FROM documents WHERE doc_id % 2 = 1 OR text IS NULL),
    e AS (SELECT sha256(text) AS sha, min(source) AS held FROM documents WHERE doc_id % 2 = 0 GROUP BY ALL),
    h AS (SELECT sha, min(doc_id) AS first, arg_min(owner, doc_id) AS head FROM b GROUP BY sha)
    SELECT b.doc_id, b.owner, CASE WHEN b.sha IS NULL THEN 'UNREADABLE' WHEN coalesce(e.held, CASE WHEN h.first <> b.doc_id THEN h.head END) IS NULL THEN 'NEW'
    WHEN coalesce(e.held, CASE WHEN h.first <> b.doc_id THEN h.head END) = b.owner THEN 'DUPLICATE' ELSE 'CONFLICT' END AS state FROM b LEFT JOIN e ON b.sha = e.sha LEFT JOIN h ON b.sha = h.sha"""


@register(IMPORT)
def s20_import_plan(t: Tables) -> DataFrame:
    """The odd documents are a batch to import; the even ones are there already."""
    docs = t.read("documents")
    batch = docs.where("doc_id % 2 = 1 or text is null").select("doc_id", F.col("source").alias("owner"), "text")
    existing = docs.where("doc_id % 2 = 0").select(F.sha2("text", 256).alias("sha"), F.col("source").alias("owner"))
    return ledger.plan_import(batch, existing, content=F.col("text"), order="doc_id").select("doc_id", "owner", "state")


@register("SELECT sha256(text) AS sha, min(source) AS owner, count(*) AS n FROM documents GROUP BY sha256(text)")
def s21_existing_hashes(t: Tables) -> DataFrame:
    return t.read("documents").groupBy(F.sha2("text", 256).alias("sha")).agg(F.min("source").alias("owner"), F.count(F.lit(1)).alias("n"))


@register("SELECT DISTINCT user_id || '|' || strftime(ts, '%Y%m%d%H%M%S') AS key FROM events")
def s15_skip_keys(t: Tables) -> DataFrame:
    return t.detections.select(F.concat_ws("|", F.col("source").cast("string"), F.date_format("ts", "yyyyMMddHHmmss")).alias("key")).distinct()


@register("SELECT DISTINCT regexp_extract(url, '([0-9]+)', 1) AS key FROM pages WHERE regexp_extract(url, '([0-9]+)', 1) <> ''")
def s16_recovered_keys(t: Tables) -> DataFrame:
    key = F.regexp_extract("url", "([0-9]+)", 1)
    return t.read("pages").select(key.alias("key")).where("key <> ''").distinct()


@register("SELECT arg_max(id, (ts, id)) AS id, source FROM detections WHERE species = 'signup' GROUP BY source", *DET)
def s29_latest_reference(t: Tables) -> DataFrame:
    return ledger.latest(t.detections.where("species = 'signup'"), ["source"], "ts", ["id"], "id").select("id", "source")


@register("SELECT id, CASE WHEN k < 10 THEN 'departed' ELSE 'here' END AS state FROM detections WHERE k < 50", *DET)
def p14_departed(t: Tables) -> DataFrame:
    """Names that left: a left join on the name without case, as the list of the departed has it."""
    gone = t.detections.where("k < 10").select(F.upper("individual").alias("name")).distinct().withColumn("gone", F.lit(True))
    rows = t.detections.where("k < 50")
    return rows.join(gone, F.lower("individual") == F.lower("name"), "left").select("id", F.when(F.col("gone"), "departed").otherwise("here").alias("state"))


@register("SELECT id, species FROM detections ORDER BY ts DESC, id DESC LIMIT 50", *DET)
def w17_recent(t: Tables) -> DataFrame:
    return t.detections.orderBy(F.desc("ts"), F.desc("id")).select("id", "species").limit(50)


@register("SELECT conv_id, count(*) AS turns, list_aggregate(list_sort(list_distinct(list(lower(trim(role))))), 'string_agg', ',') AS names FROM conversations GROUP BY conv_id")
def f5_name_sets(t: Tables) -> DataFrame:
    held = t.read("conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("turns"), F.collect_set("role").alias("names"))
    return held.select("conv_id", "turns", F.array_join(name_key("names"), ",").alias("names"))


@register("SELECT source, k, row_number() OVER (PARTITION BY source ORDER BY confidence DESC, id) AS place, id FROM detections QUALIFY place <= 3", *DET)
def w1_top_per_group(t: Tables) -> DataFrame:
    w = Window.partitionBy("source").orderBy(F.desc("confidence"), "id")
    return t.detections.withColumn("place", F.row_number().over(w).cast("long")).where("place <= 3").select("source", "k", "place", "id")
