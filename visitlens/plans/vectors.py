"""Queries over embedding vectors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.operators import showcase, vectors
from visitlens.plans.registry import register
from visitlens.sources.fixtures import Tables

CROPS = ("crops",)
DIMS = "SELECT vec_id, name, source, visit, quality, night, generate_subscripts(embedding, 1) AS dim, CAST(unnest(embedding) AS DOUBLE) AS x FROM crops"


def unit_sql(keys: str, rows: str) -> str:
    """Table expressions m (means by dimension) and u (unit vectors as lists) of groups of ``rows``."""
    return f"""WITH e AS ({rows}), m AS (SELECT {keys}, dim, avg(x) AS x FROM e GROUP BY {keys}, dim),
    u AS (SELECT {keys}, list(x / norm ORDER BY dim) AS v FROM (SELECT *, sqrt(sum(x * x) OVER (PARTITION BY {keys})) AS norm FROM m) GROUP BY {keys})"""


@register("SELECT vec_id, name, source FROM crops WHERE quality >= 0.5", *CROPS)
def s10_load_vectors(t: Tables) -> DataFrame:
    return t.crops.where("quality >= 0.5").select("vec_id", "name", "source")


@register("SELECT vec_id, round(list_inner_product(CAST(embedding AS DOUBLE[]), CAST(embedding AS DOUBLE[])), 6) AS square FROM crops", *CROPS)
def f30_self_product(t: Tables) -> DataFrame:
    return t.crops.select("vec_id", F.round(vectors.dot("embedding", "embedding"), 6).alias("square"))


@register(
    f"WITH e AS ({DIMS}), s AS (SELECT name, dim, sum(x) AS s, count(*) AS n FROM e GROUP BY name, dim) SELECT name, max(n) AS n, round((sum(s * s) - max(n)) / (max(n) * (max(n) - 1)), 6) AS cohesion FROM s GROUP BY name", *CROPS
)
def f31_mean_pairwise(t: Tables) -> DataFrame:
    return vectors.mean_pairwise(t.crops, ["name"]).withColumn("cohesion", F.round("cohesion", 6))


TOP = f"SELECT * FROM ({DIMS}) WHERE vec_id IN (SELECT vec_id FROM (SELECT vec_id, row_number() OVER (PARTITION BY name ORDER BY quality DESC, vec_id) AS rk FROM crops) WHERE rk <= 40)"


@register(unit_sql("name", TOP) + " SELECT name, dim - 1 AS dim, round(v, 6) AS x FROM (SELECT name, generate_subscripts(v, 1) AS dim, unnest(v) AS v FROM u)", *CROPS)
def f32_prototypes(t: Tables) -> DataFrame:
    p = vectors.prototypes(t.crops, ["name"])
    return p.select("name", F.posexplode("embedding").alias("dim", "x")).select("name", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("x"))


@register(unit_sql("name", DIMS) + " SELECT name, round(v[1], 6) AS first, round(list_sum(v), 6) AS total FROM u", *CROPS)
def i11_centroids(t: Tables) -> DataFrame:
    c = vectors.centroids(t.crops, ["name"])
    return c.select("name", F.round(F.col("embedding")[0], 6).alias("first"), F.round(F.aggregate("embedding", F.lit(0.0), lambda a, b: a + b), 6).alias("total"))


@register(
    unit_sql("name", DIMS) + """, r AS (SELECT c.vec_id AS probe, u.name, list_inner_product(CAST(c.embedding AS DOUBLE[]), u.v) AS s FROM crops c CROSS JOIN u),
    k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, name) AS rk FROM r)
    SELECT probe, max(name) FILTER (rk = 1) AS best, round(max(s), 6) AS similarity, round(max(s) - coalesce(max(s) FILTER (rk = 2), 0), 6) AS lead FROM k GROUP BY probe""",
    *CROPS,
)
def j25_match_centroids(t: Tables) -> DataFrame:
    probes = t.crops.select(F.col("vec_id").alias("probe"), "embedding")
    found = vectors.best_two(vectors.rank_against(probes, vectors.centroids(t.crops, ["name"])))
    return found.select("probe", "best", F.round("similarity", 6).alias("similarity"), F.round("lead", 6).alias("lead"))


@register(
    unit_sql("name", DIMS) + """ SELECT c.vec_id AS probe, u.name, round(list_inner_product(CAST(c.embedding AS DOUBLE[]), u.v), 6) AS similarity FROM crops c JOIN u ON true
    WHERE list_inner_product(CAST(c.embedding AS DOUBLE[]), u.v) >= 0.4""",
    *CROPS,
)
def j26_clip_match(t: Tables) -> DataFrame:
    probes = t.crops.select(F.col("vec_id").alias("probe"), "embedding")
    found = vectors.rank_against(probes, vectors.centroids(t.crops, ["name"]))
    return found.where("similarity >= 0.4").select("probe", "name", F.round("similarity", 6).alias("similarity"))


@register(
    unit_sql("source, name", DIMS) + """, r AS (SELECT c.vec_id AS probe, u.name, list_inner_product(CAST(c.embedding AS DOUBLE[]), u.v) AS s FROM crops c JOIN u ON c.source = u.source),
    k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, name) AS rk FROM r) SELECT probe, name, rk AS rank, round(s, 6) AS similarity FROM k WHERE rk <= 3""",
    *CROPS,
)
def j24_rank_templates(t: Tables) -> DataFrame:
    """A probe meets templates of its own source only."""
    from visitlens.operators.profiles import top_per_group

    probes = t.crops.select(F.col("vec_id").alias("probe"), "source", "embedding")
    ranked = vectors.rank_against(probes, vectors.centroids(t.crops, ["source", "name"]), ["source"])
    top = top_per_group(ranked, "probe", 3, F.desc("similarity"), F.col("name"))
    return top.select("probe", "name", "rank", F.round("similarity", 6).alias("similarity"))


@register(
    """WITH p AS (SELECT * FROM crops WHERE vec_id % 100 = 0), s AS (SELECT p.vec_id AS probe, c.vec_id AS other, list_inner_product(CAST(p.embedding AS DOUBLE[]), CAST(c.embedding AS DOUBLE[])) AS s
    FROM p JOIN crops c ON c.vec_id <> p.vec_id AND c.night <> p.night),
    k AS (SELECT *, row_number() OVER (PARTITION BY probe ORDER BY s DESC, other) AS rk FROM s) SELECT probe, other, rk AS rank, round(s, 6) AS similarity FROM k WHERE rk <= 10""",
    *CROPS,
)
def j23_neighbours(t: Tables) -> DataFrame:
    """The ten nearest vectors of other nights to a stated set of probes, against all rows; the best of each task first."""
    c = t.crops
    probes = c.where("vec_id % 100 = 0").select(F.col("vec_id").alias("probe"), F.col("night").alias("probe_night"), F.col("embedding").alias("p"))
    pairs = c.join(probes, (F.col("vec_id") != F.col("probe")) & (F.col("night") != F.col("probe_night")))
    near = pairs.select("probe", F.col("vec_id").alias("other"), vectors.dot("p", "embedding").alias("s"))
    from visitlens.operators.profiles import top_per_group

    return top_per_group(near, "probe", 10, F.desc("s"), F.col("other")).select("probe", "other", "rank", F.round("s", 6).alias("similarity"))


@register(
    """WITH p AS (SELECT a.name = b.name AS same, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM crops a JOIN crops b ON a.visit = b.visit AND a.vec_id < b.vec_id)
    SELECT same, count(*) AS n, round(avg(s), 6) AS mean, round(median(s), 6) AS median, round(quantile_cont(s, 0.1), 6) AS p10, round(quantile_cont(s, 0.9), 6) AS p90, round(min(s), 6) AS low, round(max(s), 6) AS high FROM p GROUP BY same""",
    *CROPS,
)
def e20_pair_separation(t: Tables) -> DataFrame:
    a = t.crops.select("visit", F.col("vec_id").alias("a"), F.col("name").alias("name_a"), F.col("embedding").alias("va"))
    b = t.crops.select("visit", F.col("vec_id").alias("b"), F.col("name").alias("name_b"), F.col("embedding").alias("vb"))
    s = a.join(b, "visit").where("a < b").select((F.col("name_a") == F.col("name_b")).alias("same"), vectors.dot("va", "vb").alias("s"))
    r = lambda c, n: F.round(c, 6).alias(n)
    return s.groupBy("same").agg(
        F.count(F.lit(1)).alias("n"), r(F.avg("s"), "mean"), r(F.expr("percentile(s, 0.5)"), "median"), r(F.expr("percentile(s, 0.1)"), "p10"), r(F.expr("percentile(s, 0.9)"), "p90"), r(F.min("s"), "low"), r(F.max("s"), "high")
    )


@register(
    """WITH p AS (SELECT a.night, a.name = b.name AS same, list_inner_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS s FROM crops a JOIN crops b ON a.night = b.night AND a.vec_id < b.vec_id)
    SELECT night, same, count(*) AS n, round(max(s), 6) AS best FROM p GROUP BY night, same""",
    *CROPS, dates=("night",),
)
def j22_night_pairs(t: Tables) -> DataFrame:
    a = t.crops.select("night", F.col("vec_id").alias("a"), F.col("name").alias("name_a"), F.col("embedding").alias("va"))
    b = t.crops.select("night", F.col("vec_id").alias("b"), F.col("name").alias("name_b"), F.col("embedding").alias("vb"))
    s = a.join(b, "night").where("a < b").select("night", (F.col("name_a") == F.col("name_b")).alias("same"), vectors.dot("va", "vb").alias("s"))
    return s.groupBy("night", "same").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("s"), 6).alias("best"))


@register()
def f33_principal_plane(t: Tables) -> DataFrame:
    plane = vectors.unit_square(vectors.principal_plane(t.crops.select("vec_id", "name", "embedding")))
    return plane.select("vec_id", "name", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"))


@register("SELECT vec_id, name FROM crops WHERE vec_id NOT IN (SELECT vec_id FROM crops WHERE quality < 0.3)", *CROPS)
def p9_pending_embedding(t: Tables) -> DataFrame:
    done = t.crops.where("quality < 0.3").select("vec_id")
    return t.crops.join(done, "vec_id", "left_anti").select("vec_id", "name")


@register("SELECT c.vec_id, d.species FROM crops c LEFT JOIN detections d ON c.vec_id = d.id AND d.confidence >= 0.5", "detections", *CROPS)
def j4_left_outer(t: Tables) -> DataFrame:
    d = t.detections.where("confidence >= 0.5").select(F.col("id").alias("vec_id"), "species")
    return t.crops.select("vec_id").join(d, "vec_id", "left")


@register("SELECT c.vec_id, d.species, d.source FROM crops c JOIN detections d ON c.vec_id = d.id WHERE d.confidence >= 0.5", "detections", *CROPS)
def j1_equi(t: Tables) -> DataFrame:
    d = t.detections.where("confidence >= 0.5").select(F.col("id").alias("vec_id"), "species", "source")
    return t.crops.select("vec_id").join(d, "vec_id")


@register()
def s43_featured_pairs(t: Tables) -> DataFrame:
    """Three pairs that tell the story; prototypes are of a name and night."""
    crops = t.crops.select(F.col("vec_id").alias("id"), "visit", "name", vectors.unit("embedding").alias("embedding"))
    day = F.datediff("night", F.lit("2024-01-01").cast("date"))
    protos = vectors.centroids(t.crops, ["name", "night"]).select((F.col("name") * 100_000 + day).cast("long").alias("id"), "name", "embedding")
    return showcase.featured_pairs(crops, protos)
