"""Tables whose partitions are replaced by writing aside and then committing one small file.

A version is a file that names the folder of each partition. It is written once and never changed, so a reader of one
version sees all of it while newer ones are made, and a writer that dies leaves the last version as it was.
"""

from __future__ import annotations

import json
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), p


def versions(spark: SparkSession, root: str) -> list[int]:
    fs, path = _fs(spark, f"{root}/_versions")
    return sorted(int(s.getPath().getName()[:-5]) for s in fs.listStatus(path) if s.getPath().getName().endswith(".json")) if fs.exists(path) else []


def folders(spark: SparkSession, root: str, version: int | None = None) -> dict[str, str]:
    """The folder of each partition in a version, the newest one unless told."""
    known = versions(spark, root)
    if not known:
        return {}
    text = spark.read.text(f"{root}/_versions/{known[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
    return json.loads(text)


def read(spark: SparkSession, root: str, schema, version: int | None = None) -> DataFrame:
    """All rows of a version; none where there is no version yet."""
    paths = [f"{root}/{p}" for p in folders(spark, root, version).values()]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def replace(df: DataFrame, root: str, by: str, gone: list | None = None) -> int:
    """Commit a version in which the partitions that ``df`` has are as in ``df`` and those of ``gone`` (``None``: all
    others) are away. Returns its number. Raises if another writer has committed meanwhile; nothing is changed then (on file
    systems that create a file only once).

    ``by`` is a column of a bounded number of values, such as days; its values are told apart by their text.
    """
    spark = df.sparkSession
    known = versions(spark, root)
    held = folders(spark, root) if gone is not None else {}
    at = f"data/{uuid.uuid4().hex}"
    named = df.withColumn("__part", F.coalesce(F.col(by).cast("string"), F.lit("null")))
    named.repartition("__part").write.partitionBy("__part").parquet(f"{root}/{at}")
    fs, path = _fs(spark, f"{root}/{at}")
    made = [s.getPath().getName() for s in fs.listStatus(path) if s.getPath().getName().startswith("__part=")]
    away = {"null" if g is None else str(g) for g in gone or []}
    found = {k: p for k, p in held.items() if k not in away} | {m.removeprefix("__part="): f"{at}/{m}" for m in made}
    number = (known[-1] if known else 0) + 1
    fs, path = _fs(spark, f"{root}/_versions/{number:012d}.json")
    try:
        out = fs.create(path, False)  # fails where the file is: one writer wins
    except Py4JJavaError as e:
        raise RuntimeError(f"version {number} of {root} is there already") from e
    out.write(bytearray(json.dumps(found).encode()))
    out.close()
    return number
