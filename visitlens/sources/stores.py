"""Appending, replacing, exporting and importing tables and files."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from visitlens.sources.schema import PRIVATE, conform


def append(df: DataFrame, root: str, table: str) -> None:
    conform(df, table).write.mode("append").parquet(f"{root}/{table}")


def replace_partitions(df: DataFrame, root: str, table: str, by: str) -> None:
    """Rewrite only the partitions of ``by`` that ``df`` holds: the tracks of the clips that were scanned anew."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(f"{root}/{table}")


def export_csv(tables: dict[str, DataFrame], out: str) -> None:
    """One CSV folder per table without private columns, and a dictionary of all columns."""
    spark = next(iter(tables.values())).sparkSession
    kept = {name: df.select([c for c in df.columns if c not in PRIVATE]) for name, df in tables.items()}
    for name, df in kept.items():
        df.write.mode("overwrite").csv(f"{out}/{name}", header=True)
    words = [(name, f.name, f.dataType.simpleString()) for name, df in kept.items() for f in df.schema.fields]
    spark.createDataFrame(words, "table string, column string, type string").coalesce(1).write.mode("overwrite").csv(f"{out}/dictionary", header=True)


def export_ledger(rows: DataFrame, out: str, previous: DataFrame | None = None, alarm: int = 50) -> dict[str, int]:
    """Write human verdicts as JSON lines; returns how many lines came and went since ``previous`` and whether too many went."""
    rows.write.mode("overwrite").json(out)
    if previous is None:
        return {"added": rows.distinct().count(), "removed": 0, "alarm": 0}
    added, removed = rows.subtract(previous).count(), previous.subtract(rows).count()
    return {"added": added, "removed": removed, "alarm": int(removed > alarm)}


def save_report(report: DataFrame, root: str, stamp: str) -> None:
    report.coalesce(1).write.mode("overwrite").json(f"{root}/report-{stamp}")


def latest_report(spark: SparkSession, root: str) -> DataFrame | None:
    """The newest saved report by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in fs.listStatus(path)) if fs.exists(path) else []
    names = [n for n in names if n.startswith("report-")]
    return spark.read.json(f"{root}/{names[-1]}") if names else None


def read_media(spark: SparkSession, folder: str, pattern: str = "*", *, streaming: bool = False) -> DataFrame:
    """Files of a folder with a key of stem and modification second; as a stream, the folder is watched."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true")
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    stem = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1)
    return reader.load(folder).withColumn("skip_key", F.concat_ws("|", stem, F.date_format("modificationTime", "yyyyMMddHHmmss")))


def unseen(media: DataFrame, done: DataFrame) -> DataFrame:
    """Media whose key is not among those imported before."""
    return media.join(done.select("skip_key").distinct(), "skip_key", "left_anti")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("skip_key")).where("skip_key <> ''")


def video_span(media: DataFrame) -> DataFrame:
    """A video ends when its file was last written and began its duration (seconds) earlier."""
    start = F.timestamp_micros(F.unix_micros("modificationTime") - (F.col("duration_s") * 1e6).cast("long"))
    return media.select("*", start.alias("started_at"), F.col("modificationTime").alias("ended_at"))


def decode_vectors(rows: DataFrame, column: str = "embedding") -> DataFrame:
    """Blobs of 32-bit floats as arrays, by Arrow batches."""
    @F.pandas_udf("array<float>")
    def decode(blobs: pd.Series) -> pd.Series:
        return blobs.map(lambda b: None if b is None else np.frombuffer(b, "<f4"))

    return rows.withColumn(column, decode(column))


def missing_files(rows: DataFrame, files: DataFrame, column: str) -> DataFrame:
    """Rows whose file is not in a listing (path)."""
    return rows.join(files.select(F.col("path").alias(column)).distinct(), column, "left_anti")
