"""Adapters from the given tables to the engine's domain tables."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.operators import sessions

#: The visit gap and the clip gap that suit the sparse event table.
VISIT_GAP_S, CLIP_GAP_S = 6 * 3600, 2 * 3600


class Tables:
    """The given tables by name, and the domain tables that derive from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def detections(self) -> DataFrame:
        k = F.regexp_extract("props", "([0-9]+)", 1)
        return self.read("events").select(
            F.col("event_id").alias("id"),
            F.col("ts").cast("timestamp_ntz").alias("ts"),
            F.col("user_id").alias("source"),
            F.col("event_type").alias("species"),
            (F.col("value") / 500).alias("confidence"),
            F.concat(F.lit("k"), k).alias("individual"),
            F.expr(f"try_cast({'regexp_extract(props, ' + repr('([0-9]+)') + ', 1)'} as bigint)").alias("k"),
            "value",
        )

    @cached_property
    def stamped(self) -> DataFrame:
        return sessions.stamp_visits(self.detections, VISIT_GAP_S)

    @cached_property
    def visits(self) -> DataFrame:
        return sessions.visits(self.detections, VISIT_GAP_S)

    @cached_property
    def clips(self) -> DataFrame:
        views = self.detections.where("species = 'view'")
        made = sessions.visits(views, CLIP_GAP_S, extra=[F.min("id").alias("clip_id")])
        return made.select("source", F.col("started_at").alias("start_at"), F.col("ended_at").alias("end_at"), "clip_id", F.col("n").alias("detections"), "max_confidence")

    @cached_property
    def boxes(self) -> DataFrame:
        y = F.col("l_extendedprice") - 500 * F.floor(F.col("l_extendedprice") / 500)
        x = F.col("l_quantity") * 10
        return self.read("lineitem").select(
            F.col("l_orderkey").alias("frame"),
            F.col("l_linenumber").cast("long").alias("seq"),
            x.alias("x1"),
            y.alias("y1"),
            (x + 40 + F.col("l_tax") * 1000).alias("x2"),
            (y + 40 + F.col("l_discount") * 1000).alias("y2"),
            (F.col("l_partkey") % 100 / 100.0).alias("score"),
            F.col("l_returnflag").alias("species"),
        )

    @cached_property
    def crops(self) -> DataFrame:
        v = F.col("vec_id")
        return self.read("embeddings").select(
            "vec_id",
            F.col("label").cast("long").alias("name"),
            "embedding",
            (v % 3).alias("source"),
            F.floor(v / 5).alias("visit"),
            (v * 7919 % 1000 / 1000.0).alias("quality"),
            F.date_add(F.lit("2024-01-01").cast("date"), F.floor(v / 20).cast("int")).alias("night"),
        )
