"""Vector analytics: prototypes, centroids, rankings and pair statistics over arrays of floats."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def dot(a: Column | str, b: Column | str) -> Column:
    """The inner product in double precision, in the order of the elements."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def unit(v: Column | str) -> Column:
    v = F.col(v) if isinstance(v, str) else v
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.transform(v, lambda x: F.when(norm > 0, x.cast("double") / norm).otherwise(0.0))


def mean_vectors(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """The mean of each group's vectors by dimension, in a form that adds up before the shuffle."""
    exploded = rows.select(*keys, F.posexplode(vector).alias("dim", "x"))
    means = exploded.groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("x"))
    packed = F.transform(F.array_sort(F.collect_list(F.struct("dim", "x"))), lambda s: s["x"])
    return means.groupBy(*keys).agg(packed.alias(vector))


def centroids(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    return mean_vectors(rows, keys, vector).withColumn(vector, unit(vector))


def prototypes(rows: DataFrame, keys: list[str], *, top_k: int = 40, quality: str = "quality", order: str = "vec_id") -> DataFrame:
    """Unit mean of each group's ``top_k`` best vectors; a missing quality counts as 0."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(F.coalesce(quality, F.lit(0.0))), order))
    return centroids(rows.withColumn("__rank", rank).where(F.col("__rank") <= top_k), keys)


def rank_against(probes: DataFrame, templates: DataFrame, on: list[str] | None = None, *, most: int = 10_000) -> DataFrame:
    """Each probe (probe, embedding) with its similarity to each template (name, embedding) of the same keys.

    Without keys, templates are reference individuals: a row for each, ``most`` at most, else it raises.
    """
    if not on and templates.limit(most + 1).count() > most:
        raise ValueError(f"more than {most} templates need keys to be ranked by")
    t = templates.withColumnRenamed("embedding", "__t")
    pairs = probes.join(t, on) if on else probes.crossJoin(t)
    return pairs.withColumn("similarity", dot("embedding", "__t")).drop("embedding", "__t")


def best_two(ranked: DataFrame, probe: str = "probe", name: str = "name") -> DataFrame:
    """Best name, its similarity, and its lead over the runner-up, which is 0 where there is none."""
    per_name = ranked.groupBy(probe, name).agg(F.max("similarity").alias("similarity"))
    held = per_name.groupBy(probe).agg(F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("less"), F.col(name).alias("name")))), 1, 2).alias("top"))
    second = F.when(F.size("top") > 1, -F.col("top")[1]["less"]).otherwise(0.0)
    return held.select(probe, F.col("top")[0]["name"].alias("best"), (-F.col("top")[0]["less"]).alias("similarity"), (-F.col("top")[0]["less"] - second).alias("lead"))


def mean_pairwise(rows: DataFrame, keys: list[str], vector: str = "embedding") -> DataFrame:
    """Mean cosine of all pairs of a group's unit vectors, from the norm of their sum; 0 for fewer than two."""
    sums = rows.select(*keys, F.posexplode(vector).alias("dim", "x")).groupBy(*keys, "dim").agg(F.sum(F.col("x").cast("double")).alias("s"), F.count(F.lit(1)).alias("n"))
    folded = sums.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("square"), F.max("n").alias("n"))
    n = F.col("n")
    return folded.select(*keys, n, F.when(n < 2, 0.0).otherwise((F.col("square") - n) / (n * (n - 1))).alias("cohesion"))


def principal_plane(rows: DataFrame, vector: str = "embedding", fit: DataFrame | None = None) -> DataFrame:
    """Projection of the centred vectors on the two main axes of ``fit`` (their own unless given); each axis points to its largest loading."""
    fit = rows if fit is None else fit
    import numpy as np
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector

    model = PCA(k=2, inputCol="__v", outputCol="__p").fit(fit.select(array_to_vector(F.transform(vector, lambda x: x.cast("double"))).alias("__v")))
    axes = model.pc.toArray()
    axes = axes * np.sign(axes[np.abs(axes).argmax(axis=0), [0, 1]])
    mean = mean_vectors(fit.select(F.lit(1).alias("all"), vector), ["all"]).select(F.col(vector).alias("__m"))
    centred = rows.crossJoin(F.broadcast(mean)).withColumn("__c", F.zip_with(vector, "__m", lambda a, b: a.cast("double") - b))
    x, y = (dot("__c", F.array(*(F.lit(float(v)) for v in axes[:, i]))) for i in (0, 1))
    return centred.withColumn("x", x).withColumn("y", y).drop("__c", "__m")


def unit_square(points: DataFrame) -> DataFrame:
    """x and y moved and scaled into the unit square with the aspect kept."""
    edge = points.agg(F.min("x").alias("x0"), F.max("x").alias("x9"), F.min("y").alias("y0"), F.max("y").alias("y9"))
    scale = F.greatest(F.col("x9") - F.col("x0"), F.col("y9") - F.col("y0"), F.lit(1e-12))
    return points.crossJoin(F.broadcast(edge)).withColumn("x", (F.col("x") - F.col("x0")) / scale).withColumn("y", (F.col("y") - F.col("y0")) / scale).drop("x0", "x9", "y0", "y9")
