"""Queries of filters, projections, pages and scalar functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.functions import columns
from visitlens.functions.columns import micros
from visitlens.plans.registry import DET, register
from visitlens.sources.fixtures import Tables


@register("SELECT id, species, source, count(*) OVER () AS total FROM detections WHERE species = 'view' AND ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-12 00:00:00' ORDER BY id DESC LIMIT 50 OFFSET 20", *DET)
def p3_crops_page(t: Tables) -> DataFrame:
    rows = t.detections.where("species = 'view' and ts >= timestamp_ntz'2024-01-05 00:00:00' and ts < timestamp_ntz'2024-01-12 00:00:00'")
    page = rows.orderBy(F.desc("id")).offset(20).limit(50).select("id", "species", "source")
    return page.crossJoin(rows.agg(F.count(F.lit(1)).alias("total")))


@register("SELECT id, source FROM detections WHERE species = 'click' ORDER BY id DESC LIMIT 100", *DET)
def p4_species_slice(t: Tables) -> DataFrame:
    return t.detections.where("species = 'click'").orderBy(F.desc("id")).limit(100).select("id", "source")


@register("SELECT id, individual LIKE '%9' AS group_like, regexp_matches(individual || '_c' || k, '_c[0-9]+$') AS placeholder FROM detections", *DET)
def p6_name_predicates(t: Tables) -> DataFrame:
    return t.detections.select("id", F.endswith("individual", F.lit("9")).alias("group_like"), columns.is_placeholder(F.concat("individual", F.lit("_c"), F.col("k").cast("string"))).alias("placeholder"))


@register("SELECT id FROM detections WHERE species <> 'error' AND confidence >= 0.5 AND k < 80", *DET)
def p8_pending_classification(t: Tables) -> DataFrame:
    return t.detections.where("species <> 'error' and confidence >= 0.5 and k < 80").select("id")


@register("SELECT id, ts FROM detections WHERE source = 7 AND ts >= TIMESTAMP '2024-01-03 00:00:00' AND ts < TIMESTAMP '2024-01-25 00:00:00' AND id > 100", *DET)
def p11_window_rows(t: Tables) -> DataFrame:
    return t.detections.where("source = 7 and ts >= timestamp_ntz'2024-01-03 00:00:00' and ts < timestamp_ntz'2024-01-25 00:00:00' and id > 100").select("id", "ts")


@register("SELECT id, CASE WHEN species = 'error' THEN 'rejected' WHEN k < 70 THEN 'confirmed' WHEN k < 85 THEN 'corrected_recovered' ELSE 'corrected_lost' END AS verdict, CASE WHEN species = 'error' THEN NULL ELSE CAST(k < 70 AS INTEGER) END AS correct FROM detections", *DET)
def p17_verdicts(t: Tables) -> DataFrame:
    verdict = F.when(F.col("species") == "error", "rejected").when(F.col("k") < 70, "confirmed").when(F.col("k") < 85, "corrected_recovered").otherwise("corrected_lost")
    return t.detections.select("id", verdict.alias("verdict"), F.when(F.col("species") != "error", (F.col("k") < 70).cast("int")).alias("correct"))


@register("SELECT id, individual FROM detections WHERE id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')", *DET)
def p19_privacy_deny(t: Tables) -> DataFrame:
    deny = t.read("documents").where("lang = 'en'").select(F.col("doc_id").alias("id"))
    return t.detections.join(deny, "id", "left_anti").select("id", "individual")


@register("SELECT source, species, count(*) AS n, min(ts) AS first FROM detections GROUP BY ALL HAVING count(*) >= 10 AND max(ts) - min(ts) >= INTERVAL 60 MINUTE", *DET)
def p22_static_clusters(t: Tables) -> DataFrame:
    g = t.detections.groupBy("source", "species").agg(F.count(F.lit(1)).alias("n"), F.min("ts").alias("first"), F.max("ts").alias("last"))
    return g.where((F.col("n") >= 10) & (micros("last") - micros("first") >= 3_600_000_000)).select("source", "species", "n", "first")


@register("SELECT o.o_orderkey, c.c_mktsegment, n.n_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey WHERE o.o_totalprice >= 400000")
def j3_three_way(t: Tables) -> DataFrame:
    o = t.read("orders").where("o_totalprice >= 400000").select("o_orderkey", F.col("o_custkey").alias("c_custkey"))
    c = t.read("customer").select("c_custkey", "c_mktsegment", F.col("c_nationkey").alias("n_nationkey"))
    return o.join(c, "c_custkey").join(t.read("nation").select("n_nationkey", "n_name"), "n_nationkey").select("o_orderkey", "c_mktsegment", "n_name")


@register("SELECT l.l_orderkey, count(*) AS parts, round(avg(p.p_retailprice), 4) AS price FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey GROUP BY l.l_orderkey")
def j2_equi_tracks(t: Tables) -> DataFrame:
    p = t.read("part").select(F.col("p_partkey").alias("l_partkey"), "p_retailprice")
    return t.read("lineitem").select("l_orderkey", "l_partkey").join(p, "l_partkey").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("parts"), F.round(F.avg("p_retailprice"), 4).alias("price"))


@register("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)")
def j5_anti(t: Tables) -> DataFrame:
    return t.read("customer").select("c_custkey").join(t.read("orders").select(F.col("o_custkey").alias("c_custkey")), "c_custkey", "left_anti")


@register("SELECT c_custkey FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def j6_semi(t: Tables) -> DataFrame:
    o = t.read("orders").where("o_orderstatus = 'P'").select(F.col("o_custkey").alias("c_custkey"))
    return t.read("customer").select("c_custkey").join(o, "c_custkey", "left_semi")


@register("SELECT DISTINCT o.o_custkey FROM orders o JOIN lineitem l ON o.o_orderkey = l.l_orderkey WHERE l.l_returnflag = 'R'")
def j7_join_distinct(t: Tables) -> DataFrame:
    returned = t.read("lineitem").where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"))
    return t.read("orders").join(returned, "o_orderkey", "left_semi").select("o_custkey").distinct()


@register("SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders FROM customer")
def j8_scalar_subquery(t: Tables) -> DataFrame:
    n = t.read("orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("orders"))
    return t.read("customer").select("c_custkey").join(n, "c_custkey", "left").select("c_custkey", F.coalesce("orders", F.lit(0)).alias("orders"))


@register("SELECT id, CAST(ts - INTERVAL 12 HOUR AS DATE) AS night, CAST(ts AS DATE) AS day, strftime(ts, '%G-W%V') AS week FROM detections", *DET, dates=("night", "day"))
def f7_night_day_week(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.night_key("ts").alias("night"), F.to_date("ts").alias("day"), columns.iso_week("ts").alias("week"))


@register("SELECT id, round((epoch_us(TIMESTAMP '2024-02-05 00:00:00') - epoch_us(ts)) / 86400e6, 1) AS days FROM detections", *DET)
def f26_days_since(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.days_since("ts", F.lit("2024-02-05").cast("timestamp_ntz")).alias("days"))


POINTS = [(0.0, 0.82), (1.0, 0.71), (3.0, 0.63), (7.0, 0.48), (14.0, 0.35), (21.0, 0.22)]


def interpolation_sql(x: str) -> str:
    cases = [f"WHEN {x} <= {POINTS[0][0]} THEN {POINTS[0][1]}"]
    cases += [f"WHEN {x} <= {b} THEN {y} + ({x} - {a}) * ({z} - {y}) / ({b} - {a})" for (a, y), (b, z) in zip(POINTS, POINTS[1:], strict=False)]
    return "CASE " + " ".join(cases) + f" ELSE {POINTS[-1][1]} END"


@register(f"SELECT id, round(CAST({interpolation_sql('(k / 4.0)')} AS DOUBLE), 6) AS expected FROM detections", *DET)
def f24_expected_top1(t: Tables) -> DataFrame:
    return t.detections.select("id", F.round(columns.expected_top1(F.col("k") / 4.0, POINTS), 6).alias("expected"))


@register("SELECT id, round(CASE WHEN k = 0 THEN 0 WHEN k / 100 <= 0.35 THEN sqrt(k / 100 / 0.35) ELSE power(0.35 / (k / 100), 0.75) END, 6) AS term FROM detections", *DET)
def f20_size_term(t: Tables) -> DataFrame:
    return t.detections.select("id", F.round(columns.size_term(F.col("k") / 100), 6).alias("term"))


@register("SELECT id, round(50 * (1 - cos(2 * pi() * (k % 28) / 28))) AS light FROM detections", *DET)
def d20_moon_light(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.moon_light(F.col("k") % 28).alias("light"))


@register("SELECT id, confidence >= 0.5 AS rejected FROM detections", *DET)
def f38_gate(t: Tables) -> DataFrame:
    return t.detections.select("id", (F.col("confidence") >= 0.5).alias("rejected"))


@register("SELECT doc_id, source || '/' || lang AS path, upper(substr(lang, 1, 1)) || substr(lang, 2) AS caption, list_aggregate([lang, source], 'string_agg', ', ') AS line FROM documents")
def f1_text(t: Tables) -> DataFrame:
    path = columns.web_path(F.concat("source", F.lit("\\"), "lang"))
    return t.read("documents").select("doc_id", path.alias("path"), columns.capitalised("lang").alias("caption"), F.array_join(F.array("lang", "source"), ", ").alias("line"))


@register("SELECT DISTINCT label FROM (SELECT lower(source) AS label FROM documents UNION SELECT lower(lang) FROM documents)")
def f42_labels(t: Tables) -> DataFrame:
    d = t.read("documents")
    return d.select(F.lower("source").alias("label")).union(d.select(F.lower("lang"))).distinct()


@register("SELECT id, CASE WHEN hour(ts) % 12 = 0 THEN 12 ELSE hour(ts) % 12 END || ':' || lpad(CAST(minute(ts) AS VARCHAR), 2, '0') || CASE WHEN hour(ts) < 12 THEN ' AM' ELSE ' PM' END AS clock FROM detections", *DET)
def f4_clock(t: Tables) -> DataFrame:
    return t.detections.select("id", columns.clock_label("ts").alias("clock"))


@register("SELECT id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM (SELECT event_id AS id, props FROM events)")
def f36_json_path(t: Tables) -> DataFrame:
    return t.read("events").select(F.col("event_id").alias("id"), F.expr("try_cast(get_json_object(props, '$.k') as bigint)").alias("k"))


@register(
    """WITH p AS (SELECT id, k, CASE WHEN k < 5 THEN 4 WHEN confidence < 0.1 THEN 3 WHEN confidence < 0.2 THEN 2 END AS priority FROM detections)
    SELECT id, priority FROM p WHERE priority IS NOT NULL ORDER BY priority DESC, id LIMIT 200""",
    *DET,
)
def w15_review_queue(t: Tables) -> DataFrame:
    priority = F.when(F.col("k") < 5, 4).when(F.col("confidence") < 0.1, 3).when(F.col("confidence") < 0.2, 2)
    return t.detections.select("id", priority.alias("priority")).where("priority is not null").orderBy(F.desc("priority"), "id").limit(200)


@register(
    """WITH t AS (SELECT *, CASE WHEN confidence >= 0.9 AND k >= 50 THEN 1 WHEN confidence >= 0.7 THEN 2 WHEN confidence >= 0.4 THEN 3 ELSE 4 END AS tier FROM detections)
    SELECT individual, arg_min(id, (tier, species <> 'purchase', -confidence, id)) AS avatar FROM t GROUP BY individual""",
    *DET,
)
def w4_avatar(t: Tables) -> DataFrame:
    """The first tier of falling demands that anything meets; what people picked first, then the best."""
    tier = F.when((F.col("confidence") >= 0.9) & (F.col("k") >= 50), 1).when(F.col("confidence") >= 0.7, 2).when(F.col("confidence") >= 0.4, 3).otherwise(4)
    order = F.struct(tier.alias("tier"), (F.col("species") != "purchase").alias("machine"), (-F.col("confidence")).alias("worse"), "id")
    return t.detections.groupBy("individual").agg(F.min_by("id", order).alias("avatar"))


@register("SELECT l_orderkey, l_linenumber, l_shipdate FROM lineitem WHERE l_quantity >= 49 ORDER BY l_shipdate IS NULL, l_shipdate, l_orderkey, l_linenumber, l_partkey LIMIT 100")
def w3_nulls_last(t: Tables) -> DataFrame:
    rows = t.read("lineitem").where("l_quantity >= 49")
    return rows.orderBy(F.asc_nulls_last("l_shipdate"), "l_orderkey", "l_linenumber", "l_partkey").select("l_orderkey", F.col("l_linenumber"), "l_shipdate").limit(100)


@register(
    """WITH b AS (SELECT source, id, ts, confidence, ntile(8) OVER (PARTITION BY source ORDER BY ts, id) AS bin FROM detections)
    SELECT source, bin, arg_min(id, (-confidence, id)) AS id FROM b GROUP BY source, bin""",
    *DET,
)
def w12_frames_per_bin(t: Tables) -> DataFrame:
    """The best frame of each of eight equal parts of a source's frames."""
    from pyspark.sql.window import Window

    binned = t.detections.withColumn("bin", F.ntile(8).over(Window.partitionBy("source").orderBy("ts", "id")).cast("long"))
    return binned.groupBy("source", "bin").agg(F.min_by("id", F.struct((-F.col("confidence")).alias("worse"), "id")).alias("id"))
