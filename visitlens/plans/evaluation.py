"""Queries of the evaluation layer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions.columns import micros
from visitlens.operators import evaluation, sessions, vectors
from visitlens.plans.registry import DET, register
from visitlens.plans.vectors import DIMS, unit_sql
from visitlens.sources.fixtures import Tables
from visitlens.sources.scratch import kept

#: Graded verdicts: the species that was seen, the one that was said, and how surely.
GRADED = """graded AS (SELECT id, species AS y_true, CASE WHEN k < 70 THEN species WHEN k < 85 THEN 'view' ELSE 'click' END AS y_pred, k / 100.0 AS confidence,
    CAST(species = CASE WHEN k < 70 THEN species WHEN k < 85 THEN 'view' ELSE 'click' END AS INTEGER) AS correct FROM detections)"""
#: Scored pairs: a coarse score, with ties, and whether the pair is right.
SCORED = "scored AS (SELECT floor(value / 10) / 50 AS score, CASE WHEN k + floor(value / 25) >= 50 THEN 1 ELSE 0 END AS label FROM detections)"


def graded(t: Tables) -> DataFrame:
    pred = F.when(F.col("k") < 70, F.col("species")).when(F.col("k") < 85, "view").otherwise("click")
    rows = t.detections.select("id", F.col("species").alias("y_true"), pred.alias("y_pred"), (F.col("k") / 100.0).alias("confidence"))
    return rows.withColumn("correct", (F.col("y_true") == F.col("y_pred")).cast("int"))


def scored(t: Tables) -> DataFrame:
    return t.detections.select((F.floor(F.col("value") / 10) / 50).alias("score"), (F.col("k") + F.floor(F.col("value") / 25) >= 50).cast("int").alias("label"))


@register("WITH " + GRADED + " SELECT y_true, y_pred, count(*) AS n FROM graded GROUP BY ALL", *DET)
def e1_confusion(t: Tables) -> DataFrame:
    return evaluation.confusion(graded(t))


@register(
    "WITH " + GRADED + """, l AS (SELECT DISTINCT y_true AS label FROM graded UNION SELECT DISTINCT y_pred FROM graded),
    c AS (SELECT label, (SELECT count(*) FROM graded WHERE y_true = label) AS support, (SELECT count(*) FROM graded WHERE y_pred = label) AS predicted,
      (SELECT count(*) FROM graded WHERE y_true = label AND y_pred = label) AS tp FROM l)
    SELECT label, support, round(tp / predicted, 6) AS precision, round(tp / support, 6) AS recall, round(2 * tp / (predicted + support), 6) AS f1 FROM c""",
    *DET,
)
def e2_precision_recall(t: Tables) -> DataFrame:
    return evaluation.precision_recall(graded(t)).select("label", "support", *(F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")))


EDGE_LIST = "[" + ", ".join(f"CAST({e!r} AS DOUBLE)" for e in evaluation.EDGES) + "]"
BINNED = GRADED + f", binned AS (SELECT *, least(len(list_filter({EDGE_LIST}, lambda e: e <= CAST(confidence AS DOUBLE))) - 1, 9) AS bin FROM graded)"


@register("WITH " + BINNED + " SELECT bin, count(*) AS n, round(avg(CAST(confidence AS DOUBLE)), 6) AS confidence, round(avg(correct), 6) AS accuracy FROM binned GROUP BY bin", *DET)
def e3_reliability(t: Tables) -> DataFrame:
    return evaluation.reliability(graded(t)).select("bin", "n", F.round("confidence", 6).alias("confidence"), F.round("accuracy", 6).alias("accuracy"))


@register("WITH " + BINNED + ", b AS (SELECT count(*) AS n, avg(CAST(confidence AS DOUBLE)) AS c, avg(correct) AS a FROM binned GROUP BY bin) SELECT round(sum(n * abs(c - a)) / sum(n), 6) AS ece FROM b", *DET)
def e3_calibration_error(t: Tables) -> DataFrame:
    return evaluation.calibration_error(graded(t)).select(F.round("ece", 6).alias("ece"))


@register(
    "WITH " + SCORED + """, r AS (SELECT label, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored),
    s AS (SELECT sum(r) FILTER (label = 1) AS s, count(*) FILTER (label = 1) AS p, count(*) FILTER (label = 0) AS n FROM r) SELECT round(CAST((s - p * (p + 1) / 2.0) / (p * n) AS DOUBLE), 6) AS auc FROM s""",
    *DET,
)
def e4_roc_auc(t: Tables) -> DataFrame:
    return evaluation.roc_auc(scored(t)).select(F.round("auc", 6).alias("auc"))


@register(
    "WITH " + SCORED + """, c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score)
    SELECT score, CAST(sum(pos) OVER (ORDER BY score DESC) AS BIGINT) AS tp, CAST(sum(neg) OVER (ORDER BY score DESC) AS BIGINT) AS fp FROM c""",
    *DET,
)
def e5_roc_curve(t: Tables) -> DataFrame:
    return evaluation.curve(scored(t)).select("score", F.col("cum_pos").alias("tp"), F.col("cum_neg").alias("fp"))


@register(
    "WITH " + SCORED + """, c AS (SELECT score, count(*) FILTER (label = 1) AS pos, count(*) FILTER (label = 0) AS neg FROM scored GROUP BY score),
    j AS (SELECT score, sum(pos) OVER w / sum(pos) OVER () - sum(neg) OVER w / sum(neg) OVER () AS j FROM c WINDOW w AS (ORDER BY score DESC))
    SELECT arg_min(score, (-round(j, 12), score)) AS threshold, round(max(j), 6) AS youden FROM j""",
    *DET,
)
def e6_best_threshold(t: Tables) -> DataFrame:
    return evaluation.best_threshold(scored(t)).select("threshold", F.round("youden", 6).alias("youden"))


@register("WITH n AS (SELECT species AS label, count(*) AS n FROM detections GROUP BY species) SELECT max((n, label))[2] AS answer, round(max(n) / sum(n), 6) AS share, round(1 / count(*), 6) AS even FROM n", *DET)
def e7_majority(t: Tables) -> DataFrame:
    return evaluation.majority(t.detections.select(F.col("species").alias("label"))).select("answer", F.round("share", 6).alias("share"), F.round("even", 6).alias("even"))


@register("SELECT score, CAST(rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS DOUBLE) AS rank FROM scored_rows".replace("scored_rows", "(SELECT floor(value / 10) / 50 AS score FROM detections)"), *DET)
def w19_average_ranks(t: Tables) -> DataFrame:
    counts = scored(t).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    ranks = evaluation.running(counts, "score", ["n"]).select("score", (F.col("cum_n") - (F.col("n") - 1) / 2.0).alias("rank"))
    return scored(t).select("score").join(ranks, "score")


#: Units of leave-one-out: a unit vector for each (name, night).
UNITS = unit_sql("name, night", DIMS) + """, units AS (SELECT name * 100000 + date_diff('day', DATE '2024-01-01', night) AS probe, name AS truth, night, v FROM u)"""
PAIRS = UNITS + """, pairs AS (SELECT a.probe, a.truth, a.night, b.truth AS name, b.night AS name_night, list_inner_product(a.v, b.v) AS s FROM units a JOIN units b ON a.probe <> b.probe)"""
LOO = PAIRS + """, best AS (SELECT probe, truth, name, max(s) AS s FROM pairs WHERE NOT (truth = name AND night = name_night) {embargo} GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, name) AS rk FROM best),
    loo AS (SELECT probe, truth, max(name) FILTER (rk = 1) AS answer, max(s) AS similarity, max(s) - coalesce(max(s) FILTER (rk = 2), 0) AS lead FROM ranked GROUP BY probe, truth)"""


def units(t: Tables) -> DataFrame:
    u = vectors.centroids(t.crops, ["name", "night"])
    probe = F.col("name") * 100000 + F.datediff("night", F.lit("2024-01-01").cast("date"))
    return u.select(probe.alias("probe"), F.col("name").alias("truth"), "night", F.col("embedding").alias("v"))


def scores(t: Tables, *embargoes: int) -> DataFrame:
    """The best template of each name for each unit, under each rule."""
    u = units(t).withColumn("day", F.datediff("night", F.lit("1970-01-01").cast("date")))
    return kept(evaluation.name_scores(u, embargoes=embargoes), "name-scores")


def left_out(t: Tables) -> DataFrame:
    """Leave-one-out of all units."""
    return evaluation.answers(scores(t).where(F.col("rule") == evaluation.BLOCKED))


@register(LOO.format(embargo="") + " SELECT probe, truth, answer, round(similarity, 6) AS similarity, round(lead, 6) AS lead FROM loo", "crops")
def e8_leave_one_out(t: Tables) -> DataFrame:
    return left_out(t).select("probe", "truth", "answer", F.round("similarity", 6).alias("similarity"), F.round("lead", 6).alias("lead"))


@register(LOO.format(embargo="") + " SELECT count(*) AS probes, count(*) FILTER (similarity >= 0.3 AND lead >= 0.02) AS assigned, count(*) FILTER (similarity >= 0.3 AND lead >= 0.02 AND answer <> truth) AS wrong FROM loo", "crops")
def e9_evaluate_point(t: Tables) -> DataFrame:
    hit = (F.col("similarity") >= 0.3) & (F.col("lead") >= 0.02)
    loo = left_out(t)
    return loo.agg(F.count(F.lit(1)).alias("probes"), F.count_if(hit).alias("assigned"), F.count_if(hit & (F.col("answer") != F.col("truth"))).alias("wrong"))


THRESHOLDS, MARGINS = [round(0.1 + 0.05 * i, 2) for i in range(17)], [round(0.02 * i, 2) for i in range(11)]
GRID = f"t(threshold) AS (SELECT unnest([{', '.join(map(str, THRESHOLDS))}])), g(margin) AS (SELECT unnest([{', '.join(map(str, MARGINS))}]))"
SWEPT = LOO.format(embargo="") + f""", {GRID}, swept AS (SELECT CAST(threshold AS DOUBLE) AS threshold, CAST(margin AS DOUBLE) AS margin, count(*) AS assigned, count(*) FILTER (answer <> truth) AS wrong
    FROM loo JOIN t ON similarity >= CAST(threshold AS DOUBLE) JOIN g ON lead >= CAST(margin AS DOUBLE) GROUP BY ALL)"""


@register(SWEPT + " SELECT * FROM swept", "crops")
def e10_sweep(t: Tables) -> DataFrame:
    return evaluation.sweep(left_out(t), THRESHOLDS, MARGINS)


@register(SWEPT + ", p AS (SELECT min((-assigned, -threshold, -margin)) AS x FROM swept WHERE wrong = 0) SELECT -x[2] AS threshold, -x[3] AS margin, -x[1] AS assigned FROM p WHERE x IS NOT NULL", "crops")
def e11_select_point(t: Tables) -> DataFrame:
    return evaluation.select_point(e10_sweep(t))


def embargo_sql(days: list[int]) -> str:
    parts = []
    for d in days:
        gap = f"AND abs(date_diff('day', night, name_night)) > {d}"
        parts.append(
            f"SELECT {d} AS days, count(*) AS probes, count(*) FILTER (answer = truth) AS right_ones FROM (SELECT probe, truth, arg_min(name, (-s, name)) AS answer FROM (SELECT probe, truth, name, max(s) AS s FROM pairs "
            f"WHERE NOT (truth = name AND night = name_night) {gap} GROUP BY ALL) GROUP BY probe, truth)"
        )
    return PAIRS + " " + " UNION ALL ".join(parts)


EMBARGOES = [0, 1, 3, 7]


@register(embargo_sql(EMBARGOES), "crops")
def e19_embargo_curve(t: Tables) -> DataFrame:
    """Leave-one-out with templates at least so many days away, for all embargoes in one pass over the pairs."""
    found = evaluation.right_ones(scores(t, *EMBARGOES).where(~F.col("rule").isin(evaluation.FREE, evaluation.BLOCKED)))
    return found.select(F.col("rule").cast("int").alias("days"), "probes", "right_ones")


@register(
    PAIRS + """, f AS (SELECT 'blocked' AS kind, probe, truth, name, s FROM pairs WHERE NOT (truth = name AND night = name_night) UNION ALL SELECT 'free', probe, truth, name, s FROM pairs),
    a AS (SELECT kind, probe, truth, arg_min(name, (-s, name)) AS answer FROM f GROUP BY kind, probe, truth) SELECT kind, count(*) AS probes, count(*) FILTER (answer = truth) AS right_ones FROM a GROUP BY kind""",
    "crops",
)
def e22_gap_report(t: Tables) -> DataFrame:
    return evaluation.right_ones(scores(t)).withColumnRenamed("rule", "kind")


@register(
    SWEPT + f""", f AS (SELECT 'blocked' AS part, probe, truth, name, s FROM pairs WHERE NOT (truth = name AND night = name_night) UNION ALL SELECT 'free', probe, truth, name, s FROM pairs
      {' '.join(f"UNION ALL SELECT '{d}', probe, truth, name, s FROM pairs WHERE NOT (truth = name AND night = name_night) AND abs(date_diff('day', night, name_night)) > {d}" for d in EMBARGOES)}),
    a AS (SELECT part, probe, truth, arg_min(name, (-s, name)) AS answer FROM f GROUP BY part, probe, truth)
    SELECT part, NULL::DOUBLE AS threshold, NULL::DOUBLE AS margin, count(*) AS probes, count(*) FILTER (answer = truth) AS right_ones FROM a GROUP BY part
    UNION ALL SELECT 'sweep', threshold, margin, assigned, assigned - wrong FROM swept
    UNION ALL SELECT 'chosen', -x[2], -x[3], -x[1], -x[1] FROM (SELECT min((-assigned, -threshold, -margin)) AS x FROM swept WHERE wrong = 0) WHERE x IS NOT NULL""",
    "crops",
)
def e17_identity_report(t: Tables) -> DataFrame:
    """The whole evaluation of names from one pass over all products: answers with and without blocking and under
    embargoes, the sweep of operating points, and the point it selects."""
    found = scores(t, *EMBARGOES)
    none = F.lit(None).cast("double")
    parts = evaluation.right_ones(found).select(F.col("rule").alias("part"), none.alias("threshold"), none.alias("margin"), "probes", "right_ones")
    swept = kept(evaluation.sweep(evaluation.answers(found.where(F.col("rule") == evaluation.BLOCKED)), THRESHOLDS, MARGINS), "swept")
    points = swept.select(F.lit("sweep").alias("part"), "threshold", "margin", F.col("assigned").alias("probes"), (F.col("assigned") - F.col("wrong")).alias("right_ones"))
    best = evaluation.select_point(swept).select(F.lit("chosen").alias("part"), "threshold", "margin", F.col("assigned").alias("probes"), F.col("assigned").alias("right_ones"))
    return parts.unionByName(points).unionByName(best)


@register(
    """WITH n AS (SELECT id, individual, lag(individual) OVER w AS before, epoch_us(ts) - epoch_us(lag(ts) OVER w) AS gap FROM detections WINDOW w AS (PARTITION BY source ORDER BY ts, id))
    SELECT count(*) FILTER (gap <= 86400000000) AS near, count(*) FILTER (gap <= 86400000000 AND individual = before) AS right_ones FROM n""",
    *DET,
)
def e15_adjacency(t: Tables) -> DataFrame:
    """How often the detection before, at most a day ago, was of the same animal; a busy source is ordered day by day."""
    rows = t.detections.select("source", "ts", "id", "individual", F.struct("individual", micros("ts").alias("us")).alias("seen"))
    n = sessions.with_previous(rows, "seen").select("individual", F.col("before.individual").alias("before"), (micros("ts") - F.col("before.us")).alias("gap"))
    near = F.col("gap") <= 86_400_000_000
    return n.agg(F.count_if(near).alias("near"), F.count_if(near & (F.col("individual") == F.col("before"))).alias("right_ones"))


@register(
    "WITH " + GRADED + """ SELECT CASE WHEN hour(d.ts) BETWEEN 6 AND 17 THEN 'day' ELSE 'night' END AS period, y_true, count(*) AS n, CAST(sum(correct) AS BIGINT) AS right_ones FROM graded g JOIN detections d ON g.id = d.id GROUP BY ALL""",
    *DET,
)
def e16_species_eval(t: Tables) -> DataFrame:
    period = F.when(F.hour("ts").between(6, 17), "day").otherwise("night")
    g = graded(t).join(t.detections.select("id", period.alias("period")), "id")
    return g.groupBy("period", "y_true").agg(F.count(F.lit(1)).alias("n"), F.sum("correct").alias("right_ones"))


@register()
def e14_forward_replay(t: Tables) -> DataFrame:
    by = t.crops.select("source", F.col("vec_id").alias("key"), (F.col("vec_id") * 3600.0).alias("at_s"), F.col("name").cast("string").alias("truth"), (F.col("vec_id") % 4 == 0).alias("by_human"), "embedding")
    return evaluation.forward_replay(by, threshold=0.5, margin=0.02, horizon_days=14)
