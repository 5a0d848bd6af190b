"""Line deduplication with levelled sorted runs of line hashes.

Batches come in descending order of document id. A run is a table bucketed and sorted by line hash. Each batch is
merge-anti-joined with the runs: lines that no run holds are seen for the first time, so their keeper is in this batch,
and they become a run of their own; the others only add to the counts. Runs of one level are compacted into one of the
next level, so a batch meets few runs. Buckets line up, so no run is ever shuffled again.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import discard, new_path, numbered, shuffles_deleted, write_table

#: Stripped at both ends of a line.
SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
KEY = ["h1", "h2"]


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineRuns:
    """The runs of line hashes: (h1, h2, doc_id, rid of the keeper), and the counts by batch."""

    def __init__(self, spark: SparkSession, *, buckets: int | None = None, fanout: int = 2):
        self.spark, self.fanout = spark, fanout
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[list[DataFrame]] = [[]]
        self.counts: list[DataFrame] = []
        self.names: dict[DataFrame, str] = {}

    def _sorted_run(self, df: DataFrame, *, deal: bool) -> DataFrame:
        name = f"visitlens_run_{uuid.uuid4().hex}"
        df = df.repartition(self.buckets, *KEY) if deal else df
        writer = df.write.bucketBy(self.buckets, *KEY).sortBy(*KEY).option("path", new_path(self.spark, "line-run"))
        writer.saveAsTable(name)
        run = self.spark.table(name)
        self.names[run] = name
        return run

    def _drop(self, runs: list[DataFrame]) -> None:
        discard(*runs)
        for run in runs:
            self.spark.sql(f"DROP TABLE {self.names.pop(run)}")

    def drop_all(self) -> None:
        self._drop(list(self.names))

    def runs(self) -> list[DataFrame]:
        return [r for level in self.levels for r in level]

    def add(self, lines: DataFrame) -> None:
        """Take a batch of (h1, h2, doc_id, rid), whose ids are all below those of earlier batches."""
        held = lines.groupBy(*KEY, "doc_id", "rid").agg(F.count(F.lit(1)).alias("times"))
        batch = self._sorted_run(
            held.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max(F.struct("doc_id", "rid")).alias("keeper")), deal=True
        )
        self.counts.append(batch.select(*KEY, "n"))
        fresh = batch.select(*KEY, "keeper")
        for run in self.runs():
            fresh = fresh.hint("merge").join(run.select(*KEY), KEY, "left_anti")
        self.levels[0].append(self._sorted_run(fresh, deal=False))
        self._compact()

    def _compact(self) -> None:
        level = 0
        while len(self.levels[level]) > self.fanout:
            merged = self.levels[level][0]
            for run in self.levels[level][1:]:
                merged = merged.unionByName(run)  # no line is in two runs
            if level + 1 == len(self.levels):
                self.levels.append([])
            self.levels[level + 1].append(self._sorted_run(merged, deal=True))
            self._drop(self.levels[level])
            self.levels[level] = []
            level += 1

    def lookup(self, min_docs: int) -> DataFrame:
        """(h1, h2, keeper) of the lines that at least ``min_docs`` documents hold."""
        counts, runs = self.counts[0], self.runs()
        for more in self.counts[1:]:
            counts = counts.unionByName(more)
        keepers = runs[0]
        for run in runs[1:]:
            keepers = keepers.unionByName(run)
        common = counts.groupBy(*KEY).agg(F.sum("n").alias("n")).where(F.col("n") >= min_docs)
        return write_table(common.join(keepers, KEY).select(*KEY, "keeper"), "line-common")


def line_hashes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 20) -> DataFrame:
    """(doc_id, rid, pos, h1, h2) of every line whose key has ``min_chars`` code points or more."""
    number = F.col("__rid") if "__rid" in docs.columns else F.monotonically_increasing_id()
    rows = docs.select(F.col(id_col).alias("doc_id"), number.alias("rid"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    lines = rows.select("doc_id", "rid", F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))
    lines = lines.select("doc_id", "rid", "pos", line_key(F.col("line")).alias("key"))
    return lines.where(F.char_length("key") >= min_chars).select(
        "doc_id", "rid", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(7), F.col("key")).alias("h2")
    )


def id_cuts(lines: DataFrame, batches: int, sample: int = 10_000) -> list:
    """Ids, falling, that part ``lines`` in about equal batches, from a bounded sample of them."""
    some = lines.where("doc_id is not null").orderBy(F.xxhash64("rid", "pos")).limit(sample).select("doc_id")
    ids = sorted(r["doc_id"] for r in some.collect())
    return sorted({ids[len(ids) * i // batches] for i in range(1, batches)} if ids else (), reverse=True)


def line_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 3,
    batch_lines: int = 1 << 32,
    fanout: int = 2,
    stored: bool = False,
) -> DataFrame:
    """Take common lines out of every document but the one with the largest id.

    A line's key is the line stripped of ASCII white space, A-Z lower-cased. Keys of ``min_chars`` code points held by
    ``min_docs`` documents or more (rows, each counted once) lose all their lines except in the row with the largest
    id; a null id is smaller than any other, and of rows that share the largest id one keeps the lines. Keys are
    compared by 128 bits of hash. A null text is empty and has one empty line. There are at least ``batches`` batches,
    and more so that one has about ``batch_lines`` lines; ids of any type that Spark orders are parted.
    Returns all columns of ``docs``, the text as kept (an emptied text is ""), and n_lines and n_dropped, which replace
    any of these names. Columns __rid and __drop are reserved. Of ``stored`` docs (see ``numbered``) no copy is written.
    """
    spark = docs.sparkSession
    if "__drop" in docs.columns:
        raise ValueError("column __drop is reserved")
    docs, given = numbered(docs, "line-input", stored=stored), docs
    with shuffles_deleted(spark):
        lines = write_table(line_hashes(docs, id_col=id_col, text_col=text_col, min_chars=min_chars), "lines")
        cuts = id_cuts(lines, max(batches, -(-lines.count() // batch_lines)))
        runs = LineRuns(spark, fanout=fanout)
        for i in range(len(cuts) + 1):
            at = F.lit(True)
            if i < len(cuts):
                at = F.col("doc_id") > cuts[i]
            if i:
                below = F.col("doc_id") <= cuts[i - 1]
                at = (at & below) if i < len(cuts) else (below | F.col("doc_id").isNull())
            runs.add(lines.where(at).select("doc_id", "rid", *KEY))
        common = runs.lookup(min_docs)
        runs.drop_all()
        drops = (
            lines.join(common, KEY)
            .where(F.col("rid") != F.col("keeper.rid"))
            .groupBy(F.col("rid").alias("__rid"))
            .agg(F.collect_list("pos").alias("__drop"))
        )
        drops = write_table(drops, "line-drops")
        discard(lines, common)
    # The same join at any size, so disk stays in proportion; texts are not sorted.
    joined = docs.join(drops.hint("shuffle_hash"), "__rid", "left").drop("__rid")
    fields = [f for f in given.schema.fields if f.name not in ("n_lines", "n_dropped")]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch[text_col].to_pylist(), batch["__drop"].to_pylist(), strict=True):
                rows = (text or "").split("\n")
                gone = set(drop or ())
                texts.append("\n".join(x for i, x in enumerate(rows) if i not in gone) if gone else text or "")
                n_lines.append(len(rows))
                n_dropped.append(len(gone))
            out = [pa.array(texts, pa.string()) if f.name == text_col else batch[f.name] for f in fields]
            out += [pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            yield pa.RecordBatch.from_arrays(out, [f.name for f in fields] + ["n_lines", "n_dropped"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + ", n_lines long, n_dropped long"
    return joined.mapInArrow(rewrite, schema)
