"""Visits kept up to date while rows come late, in any order.

Rows and visits lie in tables of replaceable partitions by day. Rows that arrive touch the visits within a gap of them; only
the days of those visits are read and made anew, so two visits that a late row joins become one.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.functions.columns import micros
from visitlens.operators import sessions
from visitlens.sources import versions
from visitlens.sources.scratch import dropped, kept

ROWS = "id long, ts timestamp_ntz, source long, confidence double, day string"
VISITS = "source long, started_at timestamp_ntz, ended_at timestamp_ntz, n long, max_confidence double, rep_id long, day string"


def arrive(batch: DataFrame, root: str, gap_s: float) -> None:
    """Take in ``batch`` (id, ts, source, confidence) and bring the visits under ``root`` up to date.

    A row that came before (same id) counts once. Rows without an id, source or time are left out. What is read: the
    visits and rows of the days from a gap before to a gap after the batch's rows, and of all days of visits that
    touch them. Rows are committed before visits; a run that died in between is mended by sending the batch again.
    """
    spark = batch.sparkSession
    day = F.date_format("ts", "yyyy-MM-dd").alias("day")
    batch = kept(batch.where("id is not null and source is not null and ts is not null").select("id", F.col("ts").cast("timestamp_ntz").alias("ts"), "source", "confidence", day).dropDuplicates(["id"]), "late-batch")
    if batch.isEmpty():
        return
    rows_at, visits_at = f"{root}/rows", f"{root}/visits"
    gap = F.lit(int(gap_s * 1e6))
    visits = versions.read(spark, visits_at, VISITS)
    near = batch.select("source", (micros("ts") - gap).alias("lo"), (micros("ts") + gap).alias("hi"))
    # Days as buckets of an equality join: a visit is met in each day that it spans.
    a = near.withColumn("bucket", F.explode(_days("lo", "hi")))
    v = visits.withColumn("bucket", F.explode(_days(micros("started_at"), micros("ended_at"))))
    met = v.join(a, ["source", "bucket"]).where((micros("started_at") <= F.col("hi")) & (micros("ended_at") >= F.col("lo")))
    touched = kept(met.select(*visits.columns).distinct(), "late-touched")

    # Rows that are new go to their days; each day's rows are rewritten as a whole.
    days = [r["day"] for r in batch.select("day").distinct().collect()]
    there = _of_days(spark, rows_at, ROWS, days)
    fresh = there.unionByName(batch.join(there.select("id"), "id", "left_anti")) if days else there
    versions.replace(fresh, rows_at, "day", gone=days)

    spans = touched.select("source", micros("started_at").alias("lo"), micros("ended_at").alias("hi")).unionByName(batch.select("source", micros("ts").alias("lo"), micros("ts").alias("hi")))
    spans = kept(spans.withColumn("bucket", F.explode(_days("lo", "hi"))).distinct(), "late-spans")
    wanted = [r["day"] for r in spans.select(F.date_format(F.timestamp_micros(F.col("bucket") * sessions.DAY_US), "yyyy-MM-dd").alias("day")).distinct().collect()]
    rows = _of_days(spark, rows_at, ROWS, wanted).withColumn("bucket", F.floor(micros("ts") / sessions.DAY_US))
    inside = rows.join(spans, ["source", "bucket"]).where((micros("ts") >= F.col("lo")) & (micros("ts") <= F.col("hi")))
    again = sessions.visits(inside.select("id", "ts", "source", "confidence").distinct(), gap_s).withColumn("day", F.date_format("started_at", "yyyy-MM-dd"))
    again = kept(again.select(*visits.columns), "late-visits")

    old = [r["day"] for r in touched.select("day").unionByName(again.select("day")).distinct().collect()]
    stay = _of_days(spark, visits_at, VISITS, old).join(touched.select("source", "started_at"), ["source", "started_at"], "left_anti")
    versions.replace(stay.select(*visits.columns).unionByName(again), visits_at, "day", gone=old)
    dropped(batch, touched, spans, again)


def rebuild(root: str, spark: SparkSession, gap_s: float) -> int:
    """All visits made anew from all rows and committed at once; readers of the version before aren't disturbed."""
    made = sessions.visits(versions.read(spark, f"{root}/rows", ROWS), gap_s).withColumn("day", F.date_format("started_at", "yyyy-MM-dd"))
    return versions.replace(made, f"{root}/visits", "day")


def _days(lo, hi):
    lo, hi = (F.col(c) if isinstance(c, str) else c for c in (lo, hi))
    return F.sequence(F.floor(lo / sessions.DAY_US), F.floor(hi / sessions.DAY_US))


def _of_days(spark: SparkSession, root: str, schema: str, days: list[str]) -> DataFrame:
    held = versions.folders(spark, root)
    paths = [f"{root}/{held[d]}" for d in days if d in held]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)
