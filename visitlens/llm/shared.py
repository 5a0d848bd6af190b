"""Tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A table of keys is broadcast up to so many rows (some tens of MB); beyond, it is joined by a shuffle.
BROADCAST_ROWS = 1 << 20


def shared_dir(spark: SparkSession) -> str:
    """The cluster's ``spark.checkpoint.dir``; a new local folder only where none is set (tests, one machine)."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        option = spark.sparkContext._jsc.sc().getCheckpointDir()
        found = option.get() if option.isDefined() else None
    if not found:
        found = "file://" + tempfile.mkdtemp(prefix="visitlens-")
        spark.sparkContext.setCheckpointDir(found)
    return found.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/visitlens/{name}-{uuid.uuid4().hex}"


def write_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: the lineage ends there, and any executor can reread it."""
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 2000, size: str = "8m") -> None:
    """Batches of so many rows and bytes for Python, unless the cluster sets its own.

    Those of 10,000 whole texts take 100 MB and more a task, and a few very long texts would fill one of any number of rows.
    """
    for key, most in (("maxRecordsPerBatch", rows), ("maxBytesPerBatch", size)):
        key = f"spark.sql.execution.arrow.{key}"
        if not spark.sparkContext.getConf().contains(key):
            spark.conf.set(key, most)


def numbered(df: DataFrame, name: str, number: str = "__rid", *, stored: bool = False) -> DataFrame:
    """``df`` with a number for each row in column ``number``, written once, so a rerun can't deal the numbers anew.

    ``stored`` says that ``df`` scans Parquet files, each once, with no more than columns selected and rows filtered. Then
    a row's number comes from its file and its place there, and only the list of files is written, not the rows.
    """
    if number in df.columns:
        raise ValueError(f"column {number} is reserved")
    if not stored:
        return write_table(df.withColumn(number, F.monotonically_increasing_id()), name)
    spark, at = df.sparkSession, df.metadataColumn("_metadata")
    paths = sorted(r["file"] for r in df.select(at["file_path"].alias("file")).distinct().collect())
    files = write_table(spark.createDataFrame(list(enumerate(paths)), "n long, file string").coalesce(1), name)
    placed = df.select("*", F.struct(at["file_path"].alias("file"), at["row_index"].alias("row")).alias(number))
    held = placed.join(F.broadcast(files), placed[number]["file"] == files["file"])
    return held.select(*(placed[f"`{c}`"] for c in df.columns), (F.shiftleft(files["n"], 33) + placed[number]["row"]).alias(number))


def bounded(table: DataFrame) -> DataFrame:
    """A written table for the small side of a join: broadcast if it is small enough."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


def drawn(rows: DataFrame, key: Column, most: int, n_rows: int) -> DataFrame:
    """About ``4 * most`` of ``n_rows`` rows by the hash ``key``, so that no task sends a sample of its own to the driver."""
    if n_rows <= 4 * most:
        return rows
    return rows.where(F.pmod(F.shiftright(key, 20), F.lit(1 << 40)) < int(4 * most / n_rows * (1 << 40)))


def discard(*tables: DataFrame) -> None:
    """Delete written tables that nothing needs any more."""
    for table in tables:
        for folder in {file.rsplit("/", 1)[0] for file in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


@contextmanager
def shuffles_deleted(spark: SparkSession):
    """Within the block, Spark deletes the shuffle files of a query when it ends, not when the driver collects its garbage.

    A query that is run twice shuffles twice then, so the block is for steps that each write their table.
    """
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    was = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        if was is None:
            spark.conf.unset(key)
        else:
            spark.conf.set(key, was)


@contextmanager
def batches(spark: SparkSession, rows: int = 2000, size: str = "8m"):
    """Within the block, Python gets batches of at most so many rows and bytes; afterwards the session is as it was.

    What runs after the block has the session's own batches, so write the result inside.
    """
    keys = {"spark.sql.execution.arrow.maxRecordsPerBatch": rows, "spark.sql.execution.arrow.maxBytesPerBatch": size}
    was = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)
