"""Queries of identity resolution."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.operators import geometry, identity, review, vectors
from visitlens.plans.registry import register
from visitlens.plans.vectors import DIMS
from visitlens.sources.fixtures import Tables
from visitlens.sources.scratch import kept

GOOD = DIMS.replace("FROM crops", "FROM crops WHERE quality >= 0.3")
#: Prototypes of the visits of each source; a visit here is the crops of one night.
PROTO = f"""WITH e AS (SELECT source, date_diff('day', DATE '2024-01-01', night) AS visit, vec_id, dim, x FROM ({GOOD})),
    n AS (SELECT source, visit, count(DISTINCT vec_id) AS crops FROM e GROUP BY source, visit HAVING count(DISTINCT vec_id) >= 3),
    m AS (SELECT e.source, e.visit, dim, avg(x) AS x FROM e JOIN n ON e.source = n.source AND e.visit = n.visit GROUP BY e.source, e.visit, dim),
    protos AS (SELECT source, visit, list(x / norm ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY source, visit)) AS norm FROM m) GROUP BY source, visit),
    labels AS (SELECT source, visit, 'n' || (visit % 4) AS name FROM protos WHERE visit % 3 <> 0),
    templates AS (SELECT p.source, p.visit, l.name, p.v FROM protos p JOIN labels l ON p.source = l.source AND p.visit = l.visit WHERE p.visit % 7 <> 0),
    sims AS (SELECT p.source, p.visit, t.name, max(list_inner_product(p.v, t.v)) AS s FROM protos p JOIN templates t ON p.source = t.source AND p.visit <> t.visit GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY source, visit ORDER BY s DESC, name) AS rk FROM sims)"""


def night_visits(t: Tables) -> DataFrame:
    return t.crops.withColumn("visit", F.datediff("night", F.lit("2024-01-01").cast("date")).cast("long"))


def matcher(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prototypes, human labels (of two visits in three) and templates (without the visits of several animals)."""
    protos = identity.visit_prototypes(night_visits(t), gate=0.3)
    labels = protos.where("visit % 3 <> 0").select("source", "visit", F.concat(F.lit("n"), (F.col("visit") % 4).cast("string")).alias("name"))
    multi = protos.where("visit % 7 = 0").select("source", "visit")
    return protos, labels, identity.templates(protos, labels, multi)


@register(PROTO + " SELECT p.source, p.visit, n.crops, round(p.v[1], 6) AS first FROM protos p JOIN n ON p.source = n.source AND p.visit = n.visit", "crops")
def i1_prototypes(t: Tables) -> DataFrame:
    return identity.visit_prototypes(night_visits(t), gate=0.3).select("source", "visit", "crops", F.round(F.col("embedding")[0], 6).alias("first"))


@register(PROTO + " SELECT source, visit, name FROM templates", "crops")
def i3_templates(t: Tables) -> DataFrame:
    return matcher(t)[2].select("source", "visit", "name")


@register(PROTO + " SELECT source, visit, rk AS rank, name, round(s, 6) AS similarity, s < 0.31 AS novel FROM ranked WHERE rk <= 3", "crops")
def i5_suggestions(t: Tables) -> DataFrame:
    protos, _, made = matcher(t)
    return identity.suggestions(protos, made).withColumn("similarity", F.round("similarity", 6))


@register(
    PROTO + """, b AS (SELECT source, visit, max(name) FILTER (rk = 1) AS best, max(s) AS s, max(s) - coalesce(max(s) FILTER (rk = 2), 0) AS lead FROM ranked GROUP BY source, visit),
    c AS (SELECT name, count(*) AS templates FROM templates GROUP BY name),
    r AS (SELECT p.source, p.visit, b.best, b.s, b.lead, CASE WHEN l.name IS NOT NULL THEN 'labelled' WHEN b.best IS NULL THEN 'no templates' WHEN c.templates < 2 THEN 'few templates' WHEN b.s < 0.2 THEN 'unlike' WHEN b.lead < 0.02 THEN 'close second' END AS reason
      FROM protos p LEFT JOIN b ON p.source = b.source AND p.visit = b.visit LEFT JOIN c ON c.name = b.best LEFT JOIN labels l ON l.source = p.source AND l.visit = p.visit)
    SELECT source, visit, CASE WHEN reason IS NULL THEN best END AS name, reason, round(s, 6) AS similarity, round(lead, 6) AS lead FROM r""",
    "crops",
)
def i7_auto_assign(t: Tables) -> DataFrame:
    protos, labels, made = matcher(t)
    out = identity.auto_assign(protos, made, labels, threshold=0.2, margin=0.02, min_templates=2)
    return out.select("source", "visit", "name", "reason", F.round("similarity", 6).alias("similarity"), F.round("lead", 6).alias("lead"))


def numbered_protos(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Prototypes, labels and templates of crops of one name and night at a source: visits whose numbers are their own."""
    day = F.datediff("night", F.lit("2024-01-01").cast("date"))
    crops = t.crops.withColumn("visit", ((day * 10 + F.col("name")) * 3 + F.col("source")).cast("long"))
    protos = identity.visit_prototypes(crops, min_crops=1, gate=0.3).withColumn("multi", F.col("visit") % 11 == 0)
    labels = protos.where(F.xxhash64("visit") % 3 == 0).select("source", "visit", F.concat(F.lit("n"), (F.floor(F.col("visit") / 3) % 10).cast("string")).alias("name"))
    return protos, labels, identity.templates(protos, labels, protos.where("multi").select("source", "visit"))


@register()
def i6_refit(t: Tables) -> DataFrame:
    """Unnamed visits that fit a template of their source, and groups of likeness of those that fit none, over whole sources."""
    protos, labels, made = numbered_protos(t)
    fits, novel = identity.refit(protos, made, labels, novelty=0.5, distance=0.6)
    found = fits.select("source", F.array("visit").alias("visits"), "name", F.round("similarity", 3).alias("similarity"), F.lit(None).cast("double").alias("cohesion"))
    groups = novel.select("source", "visits", F.lit(None).cast("string").alias("name"), F.lit(None).cast("double").alias("similarity"), "cohesion")
    return found.unionByName(groups).withColumn("visits", F.array_join(F.transform("visits", lambda v: v.cast("string")), ","))


@register(
    """WITH s AS (SELECT conv_id AS visit, turn AS side, CASE WHEN turn = 0 THEN 'a' END AS recognised FROM conversations WHERE turn < 2)
    SELECT visit, side, CASE WHEN recognised IS NOT NULL THEN 'a' WHEN count(recognised) OVER (PARTITION BY visit) > 0 THEN 'b' END AS name FROM s"""
)
def g18_elimination(t: Tables) -> DataFrame:
    sides = t.read("conversations").where("turn < 2").select(
        F.col("conv_id").alias("visit"), F.col("turn").alias("side"), F.when(F.col("turn") == 0, "a").alias("recognised"), F.array(F.lit("a"), F.lit("b")).alias("names")
    )
    return identity.eliminate(sides)


@register(
    """WITH i AS (SELECT a.frame, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) * greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) AS both_,
      (a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) AS sum_ FROM boxes a JOIN boxes b ON a.frame = b.frame AND a.seq < b.seq),
    f AS (SELECT DISTINCT frame // 10 AS visit, frame FROM i WHERE both_ / (sum_ - both_) < 0.45) SELECT visit, count(*) AS frames FROM f GROUP BY visit HAVING count(*) >= 3""",
    "boxes",
)
def i2_multi_animal(t: Tables) -> DataFrame:
    return identity.co_present_visits(geometry.pair_ious(t.boxes).withColumn("visit", F.floor(F.col("frame") / 10)))


@register(PROTO + " SELECT name, count(*) AS templates FROM templates GROUP BY name", "crops")
def i4_usable_templates(t: Tables) -> DataFrame:
    return matcher(t)[2].groupBy("name").agg(F.count(F.lit(1)).alias("templates"))


@register()
def i8_bootstrap(t: Tables) -> DataFrame:
    """All visits without a name in groups of likeness, over the whole store."""
    protos, labels, _ = numbered_protos(t)
    rows = protos.join(labels, ["source", "visit"], "left_anti").withColumn("key", F.lit(0))
    groups = identity.visit_groups(rows, distance=0.6)
    text = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    return groups.select(text("visits"), "n", "cohesion", text("multi"))


@register(
    PROTO + """, held AS (SELECT name, count(*) AS templates, max(visit) AS newest FROM templates GROUP BY name), d AS (SELECT *, (SELECT max(visit) FROM protos) - newest AS age FROM held)
    SELECT lower(name) AS name, templates, age, CASE WHEN age >= 14 THEN 'lapsed' WHEN age >= 7 THEN 'fading' ELSE 'fresh' END AS state FROM d""",
    "crops",
)
def i9_lapse_by_name(t: Tables) -> DataFrame:
    protos, _, made = matcher(t)
    n = made.groupBy("name").agg(F.count(F.lit(1)).alias("templates"), F.max("visit").alias("newest"))
    d = n.crossJoin(F.broadcast(protos.agg(F.max("visit").alias("now")))).withColumn("age", F.col("now") - F.col("newest"))
    return d.select(F.lower("name").alias("name"), "templates", "age", columns.lapse_state("age", "templates").alias("state"))


@register(
    PROTO + """, m2 AS (SELECT source, name, dim, avg(x) AS x FROM (SELECT source, name, generate_subscripts(v, 1) AS dim, unnest(v) AS x FROM templates) GROUP BY source, name, dim)
    SELECT source, name, round(sqrt(sum(x * x)), 6) AS norm FROM m2 GROUP BY source, name""",
    "crops",
)
def i10_template_means(t: Tables) -> DataFrame:
    m = vectors.mean_vectors(matcher(t)[2], ["source", "name"])
    return m.select("source", "name", F.round(F.sqrt(vectors.dot("embedding", "embedding")), 6).alias("norm"))


@register(
    PROTO + """, a AS (SELECT source, visit, max(name) FILTER (rk = 1) AS looks FROM ranked GROUP BY source, visit)
    SELECT p.source, p.visit, a.looks, CASE WHEN n.crops < 5 THEN 'thin' WHEN n.crops <= 12 THEN 'fits' ELSE 'odd' END AS behaves FROM protos p JOIN n ON p.source = n.source AND p.visit = n.visit LEFT JOIN a ON p.source = a.source AND p.visit = a.visit""",
    "crops",
)
def i12_two_axes(t: Tables) -> DataFrame:
    """What a visit looks like beside how it behaves; the two are never merged."""
    protos, _, made = matcher(t)
    looks = identity.suggestions(protos, made, k=1).select("source", "visit", F.col("name").alias("looks"))
    behaves = F.when(F.col("crops") < 5, "thin").when(F.col("crops") <= 12, "fits").otherwise("odd")
    return protos.join(looks, ["source", "visit"], "left").select("source", "visit", "looks", behaves.alias("behaves"))


@register()
def g16_unblend(t: Tables) -> DataFrame:
    """Crops of each source and night parted into groups of likeness, each with the name it resembles most."""
    rows = t.crops.select("source", F.col("night").cast("string").alias("night"), F.col("vec_id").alias("id"), "embedding")
    parts = geometry.linkage(rows, ["source", "night"], cut=0.95).join(rows, ["source", "night", "id"])
    means = vectors.centroids(parts, ["source", "night", "cluster"]).withColumn("probe", F.struct("source", "night", "cluster"))
    best = vectors.best_two(vectors.rank_against(means.select("probe", "embedding"), vectors.centroids(t.crops, ["name"])))
    return best.select("probe.source", "probe.night", "probe.cluster", F.col("best").alias("name"), F.round("similarity", 4).alias("similarity"))


def blended(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Crops of visits of twenty frames, each with the vector of a number made of its own where there is one; templates; logs."""
    visit = F.floor(F.col("frame") / 20).cast("long")
    number = F.col("frame") * 1000 + F.col("seq") * 100 + F.round(F.col("score") * 100).cast("long")
    b = t.boxes.select(visit.alias("visit"), number.alias("id"), F.col("frame").cast("double").alias("at_s"), "x1", "y1", "x2", "y2", F.col("score").alias("quality"))
    b = b.groupBy("visit", "id").agg(*(F.min(c).alias(c) for c in b.columns[2:])).withColumn("vec_id", (F.col("id") * 31) % 3001)
    seen = t.crops.select("vec_id", "embedding", F.concat(F.lit("n"), F.col("name").cast("string")).alias("named"))
    crops = b.join(seen, "vec_id", "left").withColumn("source", F.col("visit") % 3).withColumn("label", F.when(F.col("id") % 50 == 0, F.col("named"))).drop("vec_id", "named")
    made = vectors.centroids(t.crops.select("source", F.concat(F.lit("n"), F.col("name").cast("string")).alias("name"), "embedding"), ["source", "name"])
    logged = crops.where("visit % 2 = 0").groupBy("visit").agg(F.array(F.concat(F.lit("n"), (F.col("visit") % 10).cast("string")), F.concat(F.lit("n"), ((F.col("visit") + 3) % 10).cast("string"))).alias("names"))
    return crops, made, logged


@register()
def g17_unblend_stills(t: Tables) -> DataFrame:
    """The animals of each visit by its crops, with suggestions and names from the visit's log."""
    found = identity.unblend_stills(*blended(t), threshold=0.2)
    joined = lambda c: F.array_join(F.transform(c, lambda v: v.cast("string")), ",").alias(c)
    hints = F.array_join(F.transform("suggestions", lambda s: F.concat_ws(":", s["name"], s["similarity"].cast("string"))), ",").alias("suggestions")
    return found.select("visit", "cluster", joined("ids"), "n", "n_crops", "cohesion", joined("reps"), "label", hints, "name", F.array_join("choices", ",").alias("choices"))


@register()
def g5_still_tracklets(t: Tables) -> DataFrame:
    b = t.boxes.select(F.floor(F.col("frame") / 20).alias("visit"), (F.col("frame") * 100 + F.col("seq") * 10 + F.floor(F.col("score") * 9)).alias("id"), F.col("frame").cast("double").alias("at_s"), "x1", "y1", "x2", "y2")
    return geometry.still_tracklets(b).withColumn("apart", F.concat_ws(",", "apart"))


@register()
def g11_frozen_scenes(t: Tables) -> DataFrame:
    """Scenes of each night at a source, where a crop comes each minute and a vector stands for its thumbnail."""
    visit = F.datediff("night", F.lit("2024-01-01").cast("date")) * 10 + F.col("source")
    rows = t.crops.select(visit.cast("long").alias("visit"), F.col("vec_id").alias("id"), (F.col("vec_id") * 60.0).alias("at_s"), F.col("embedding").alias("thumb"))
    return geometry.frozen_scenes(rows, most=0.95, min_n=3)


@register()
def g19_elimination_of_many(t: Tables) -> DataFrame:
    """Groups of likeness of a night at a source, whose log gives the names of three of its crops."""
    visit = (F.datediff("night", F.lit("2024-01-01").cast("date")) * 10 + F.col("source")).cast("long")
    rows = t.crops.select(visit.alias("visit"), F.col("vec_id").alias("id"), "name", "embedding")
    parts = geometry.linkage(rows, ["visit"], cut=0.95).join(rows, ["visit", "id"])
    sizes = parts.groupBy("visit", "cluster").agg(F.count(F.lit(1)).alias("n"), F.min("name").cast("string").alias("first"))
    label = F.when(F.col("cluster") == 0, F.col("first"))
    groups = vectors.centroids(parts, ["visit", "cluster"]).join(sizes.select("visit", "cluster", "n", label.alias("label")), ["visit", "cluster"])
    logged = rows.groupBy("visit").agg(F.slice(F.array_sort(F.collect_set(F.col("name").cast("string"))), 1, 3).alias("names"))
    made = vectors.centroids(t.crops, ["name"]).withColumn("name", F.col("name").cast("string"))
    return identity.resolve_logged(groups, logged, made, threshold=0.2)


@register()
def m13_frozen(t: Tables) -> DataFrame:
    return geometry.frozen(t.crops.select(F.col("visit").alias("group"), F.col("embedding").alias("thumb"))).select("group", "n", F.round("dissimilarity", 4).alias("dissimilarity"))


@register("SELECT source, visit, count(*) AS frames FROM crops GROUP BY source, visit", "crops")
def a44_visit_frames(t: Tables) -> DataFrame:
    """Over all crops of a visit, embedded or not."""
    return t.crops.groupBy("source", "visit").agg(F.count(F.lit(1)).alias("frames"))


#: A visit each forty minutes at each source; marks, freshness and the pool of the queue.
QUEUE = PROTO + """, v AS (SELECT n.source, n.visit, TIMESTAMP '2024-01-01' + to_minutes(40 * n.visit) AS started_at, TIMESTAMP '2024-01-01' + to_minutes(40 * n.visit + n.crops) AS ended_at, n.crops AS n, n.visit % 7 = 0 AS multi FROM n),
    marks AS (SELECT p.source, p.visit, (SELECT l.name FROM labels l WHERE l.source = p.source AND l.visit = p.visit) AS confirmed_as, CASE WHEN p.visit % 6 = 0 THEN 'n' || (p.visit % 4) END AS auto_as, p.visit % 15 = 0 AS rejected FROM protos p),
    fresh AS (SELECT name, (SELECT max(visit) FROM v) - max(visit) AS days FROM templates GROUP BY name),
    fresher AS (SELECT *, CASE WHEN days >= 4 THEN 'stale' ELSE 'fresh' END AS lapse FROM fresh),
    pool AS (SELECT * FROM v WHERE started_at >= (SELECT max(started_at) FROM v) - INTERVAL 48 HOUR),
    looks AS (SELECT source, visit, max(name) FILTER (rk = 1) AS name, max(s) AS s, max(s) - coalesce(max(s) FILTER (rk = 2), 0) AS lead,
      string_agg(r.name || ':' || printf('%.4f', s) || ':' || f.lapse, ',' ORDER BY rk) FILTER (rk <= 3) AS candidates FROM ranked r JOIN fresher f USING (name) GROUP BY source, visit)"""


def queue_inputs(t: Tables) -> dict[str, DataFrame]:
    protos, labels, made = matcher(t)
    protos = kept(protos, "queue-protos")
    begin = F.lit("2024-01-01").cast("timestamp_ntz")
    after = lambda minutes: F.timestamp_add("MINUTE", minutes.cast("int"), begin)
    visits = protos.select("source", "visit", after(F.col("visit") * 40).alias("started_at"), after(F.col("visit") * 40 + F.col("crops")).alias("ended_at"), F.col("crops").alias("n"), (F.col("visit") % 7 == 0).alias("multi"))
    kinds = [labels.select("source", "visit", F.lit("confirmed").alias("kind"), "name")]
    kinds.append(protos.where("visit % 6 = 0").select("source", "visit", F.lit("auto").alias("kind"), F.concat(F.lit("n"), (F.col("visit") % 4).cast("string")).alias("name")))
    kinds.append(protos.where("visit % 15 = 0").select("source", "visit", F.lit("rejected").alias("kind"), F.lit(None).cast("string").alias("name")))
    newest = made.groupBy("name").agg(F.max("visit").alias("newest")).crossJoin(F.broadcast(protos.agg(F.max("visit").alias("last"))))
    freshness = newest.select("name", (F.col("last") - F.col("newest")).alias("days")).withColumn("lapse", F.when(F.col("days") >= 4, "stale").otherwise("fresh"))
    return {"visits": visits, "protos": protos, "template_rows": made, "marks": kinds[0].unionByName(kinds[1]).unionByName(kinds[2]), "freshness": freshness}


@register(
    QUEUE + """, near AS (SELECT *, lag(visit) OVER w AS a, lag(started_at) OVER w AS at_a, lead(visit) OVER w AS b, lead(started_at) OVER w AS at_b FROM pool WINDOW w AS (PARTITION BY source ORDER BY started_at, visit)),
    side AS (SELECT n.source, n.visit, 0 AS o, n.a AS other, epoch(n.started_at) - epoch(n.at_a) AS gap FROM near n UNION ALL SELECT n.source, n.visit, 1, n.b, epoch(n.at_b) - epoch(n.started_at) FROM near n),
    told AS (SELECT s.source, s.visit, arg_min(l.name || ':' || s.other || ':' || CAST(s.gap AS BIGINT) || ':' || CASE WHEN o = 0 THEN 'after' ELSE 'before' END, (gap, o)) AS context
      FROM side s JOIN labels l ON l.source = s.source AND l.visit = s.other WHERE s.gap <= 3600 GROUP BY s.source, s.visit)
    SELECT p.source, p.visit, p.started_at, (epoch(p.ended_at) - epoch(p.started_at))::DOUBLE AS dwell_s, p.n, p.multi, m.confirmed_as, m.auto_as, m.rejected, coalesce(l.candidates, '') AS candidates, coalesce(l.s < 0.2, FALSE) AS novel,
      p.source NOT IN (SELECT source FROM templates) AS cross_source, CASE WHEN m.confirmed_as IS NULL THEN t.context END AS context
    FROM pool p JOIN marks m ON m.source = p.source AND m.visit = p.visit LEFT JOIN looks l ON l.source = p.source AND l.visit = p.visit LEFT JOIN told t ON t.source = p.source AND t.visit = p.visit
    ORDER BY p.started_at DESC, p.source, p.visit LIMIT 40""",
    "crops",
)
def a31_identity_queue(t: Tables) -> DataFrame:
    """The first forty visits of the last two days with what is known of each."""
    page = review.review_queue(**queue_inputs(t), limit=40, novelty=0.2)
    offered = F.transform("candidates", lambda c: F.concat_ws(":", c["name"], F.format_string("%.4f", c["similarity"]), c["lapse"]))
    context = F.when(F.col("context").isNotNull(), F.concat_ws(":", "context.name", F.col("context.visit").cast("string"), F.col("context.gap_s").cast("string"), "context.direction"))
    return page.withColumn("candidates", F.coalesce(F.array_join(offered, ","), F.lit(""))).withColumn("context", context)


@register(
    QUEUE + """, q AS (SELECT p.source, p.visit, p.multi, m.*, l.name, l.s, l.lead, f.days FROM v p JOIN marks m ON m.source = p.source AND m.visit = p.visit LEFT JOIN looks l ON l.source = p.source AND l.visit = p.visit LEFT JOIN fresh f ON f.name = l.name)
    SELECT 'unreviewed_auto' AS mode, source, visit FROM q WHERE auto_as IS NOT NULL AND confirmed_as IS NULL AND NOT rejected
    UNION ALL SELECT 'ambiguous', source, visit FROM q WHERE confirmed_as IS NULL AND NOT rejected AND NOT multi AND s >= 0.1 AND lead < 0.1
    UNION ALL SELECT 'stale', source, visit FROM q WHERE confirmed_as IS NULL AND NOT rejected AND NOT multi AND s >= 0.1 AND days >= 2""".replace("m.*", "m.confirmed_as, m.auto_as, m.rejected"),
    "crops",
)
def p18_queue_modes(t: Tables) -> DataFrame:
    """What each mode of the queue shows, over all visits."""
    given = queue_inputs(t)
    n = given["visits"].count()
    of = lambda m: review.review_queue(**given, mode=m, since_h=0, limit=max(1, n), novelty=0.1, clears=0.1, margin=0.1, stale_days=2).select(F.lit(m).alias("mode"), "source", "visit")
    return of("unreviewed_auto").unionByName(of("ambiguous")).unionByName(of("stale"))
