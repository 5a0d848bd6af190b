"""Exact deduplication by two-pass Bloom filtering.

Pass one counts, per bit of a filter, whether it was set once or more often; bits that were set more than once make
the filter of possibly repeated hashes. Pass two tests every row against it. Rows that it clears are surely unique and
go straight through; only the others are shuffled, by the SHA-256 of their text, and grouped exactly. A filter has a
bounded size; a larger corpus is taken in ranges of hashes, each with a filter of its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.core.broadcast import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import write_table

#: Bits of a filter segment that one task merges.
SEGMENT_BITS = 1 << 14


def filter_bits(rows: int, bits_per_row: int, max_bits: int) -> int:
    """A power of two, of at least one segment and at most ``max_bits``."""
    return min(max_bits, max(SEGMENT_BITS, 1 << max(1, rows * bits_per_row - 1).bit_length()))


def positions(h: np.ndarray, hashes: int, bits: int) -> np.ndarray:
    """The filter positions of 64-bit hashes, one row each, by double hashing."""
    h = h.astype(np.uint64)
    step = ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(13)) | np.uint64(1)
    with np.errstate(over="ignore"):
        p = h[:, None] + np.arange(hashes, dtype=np.uint64)[None, :] * step[:, None]
    return (p ^ (p >> np.uint64(33))) & np.uint64(bits - 1)


def repeated_filter(hashes: DataFrame, bits: int, n_hashes: int) -> bytes:
    """The packed filter of the bits that column ``h`` sets more than once; ``bits / 8`` bytes reach the driver."""
    segment = np.uint64(SEGMENT_BITS)

    def each_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            at, n = np.unique(positions(pdf["h"].to_numpy(np.int64), n_hashes, bits).ravel(), return_counts=True)
            seg = (at // segment).astype(np.int64)
            cut = np.flatnonzero(np.diff(seg)) + 1
            rows = [
                (int(seg[i[0]]), (at[i] % segment).astype("<u2").tobytes(), np.minimum(n[i], 2).astype(np.uint8).tobytes())
                for i in np.split(np.arange(len(at)), cut)
                if len(i)
            ]
            yield pd.DataFrame(rows, columns=["seg", "at", "n"])

    def merge(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros(SEGMENT_BITS, np.int64)
        for at, n in zip(pdf["at"], pdf["n"], strict=True):
            total[np.frombuffer(at, "<u2")] += np.frombuffer(n, np.uint8)
        return pd.DataFrame({"seg": [key[0]], "bits": [np.packbits(total > 1).tobytes()]})

    merged = (
        hashes.select("h")
        .mapInPandas(each_task, "seg long, at binary, n binary")
        .groupBy("seg")
        .applyInPandas(merge, "seg long, bits binary")
    )
    packed = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        at = row["seg"] * (SEGMENT_BITS // 8)
        packed[at : at + SEGMENT_BITS // 8] = np.frombuffer(row["bits"], np.uint8)
    return packed.tobytes()


def _asked(packed: Broadcast, bits: int, hashes: int):
    """A function of hashes that says which of them the filter has."""

    @F.pandas_udf("boolean")
    def maybe_repeated(h: pd.Series) -> pd.Series:
        at = positions(h.to_numpy(np.int64), hashes, bits)
        held = np.frombuffer(packed.value, np.uint8)
        hit = (held[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint64(7) - (at & np.uint64(7))).astype(np.uint8)) & 1
        return pd.Series(hit.all(axis=1))

    return maybe_repeated


def exact_dedup(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise=lambda text: text,
    bits_per_row: int = 16,
    hashes: int = 4,
    max_bits: int = 1 << 29,
) -> DataFrame:
    """Mark the row that stays of each group of equal texts: the one with the largest id.

    ``docs`` is read once. ``normalise`` maps the text column to what is compared. A null text counts as empty; a null id is smaller than any
    other; of rows that share id and text exactly one is kept. Other columns are not read. A filter is at most
    ``max_bits / 8`` bytes (64 MB) on the driver and in each task, enough for 33 million rows; more rows make more ranges
    of hashes, whose filters are built and asked one after the other.
    Returns doc_id, keep_id, group_size, kept and text_sha256, a row for each input row.
    """
    spark = docs.sparkSession
    text: Column = normalise(F.coalesce(F.col(text_col), F.lit("")))
    seen = write_table(
        docs.select(
            F.col(id_col).alias("doc_id"),
            F.monotonically_increasing_id().alias("rid"),
            F.sha2(text, 256).alias("text_sha256"),
            F.xxhash64(text).alias("h"),
        ),
        "exact-hashes",
    )
    n = seen.count()
    ranges = max(1, -(-n * bits_per_row // max_bits))
    bits = filter_bits(-(-n // ranges), bits_per_row, max_bits)
    parts = []
    for k in range(ranges):
        part = seen.where(F.pmod(F.shiftright("h", 40), F.lit(ranges)) == k) if ranges > 1 else seen
        packed = spark.sparkContext.broadcast(repeated_filter(part, bits, hashes))
        part = part.withColumn("maybe", _asked(packed, bits, hashes)("h")).drop("h")
        if ranges > 1:
            part = write_table(part, "exact-flags")
            packed.unpersist()
        parts.append(part)
    flagged = reduce(DataFrame.unionByName, parts)
    again = flagged.where("maybe").drop("maybe")
    groups = write_table(
        again.groupBy("text_sha256").agg(
            F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size")
        ),
        "exact-groups",
    )
    out = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]
    straight = flagged.where("not maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256"
    )
    return straight.select(out).unionByName(
        again.join(groups, "text_sha256")
        .select("*", F.col("keep.doc_id").alias("keep_id"), (F.col("keep.rid") == F.col("rid")).alias("kept"))
        .select(out)
    )
