"""Pairs of pictures that tell what the engine can and can't tell apart."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from visitlens.operators.blocks import Gather, over_pairs, packed
from visitlens.sources.scratch import kept

#: Bins of a cosine in which pairs are counted before those of one bin are ranked.
BINS = 1 << 16


def best_pair(rows: DataFrame, *, size: int = 256) -> DataFrame:
    """(a, b, similarity): the two ids of one key that are most alike; of equal pairs the one with the smallest ids. A block
    pair hands on its own best only."""

    def each(x: dict, y: dict, s: np.ndarray) -> pd.DataFrame:
        a, b = np.minimum(x["ids"][:, None], y["ids"][None]), np.maximum(x["ids"][:, None], y["ids"][None])
        s = np.where(a < b, s, -np.inf)
        i, j = np.nonzero(s == s.max(initial=-np.inf))
        k = min(range(len(i)), key=lambda n: (a[i[n], j[n]], b[i[n], j[n]]), default=None)
        one = [] if k is None or s[i[k], j[k]] == -np.inf else [(a[i[k], j[k]], b[i[k], j[k]], s[i[k], j[k]])]
        return pd.DataFrame(one, columns=["a", "b", "similarity"])

    found = over_pairs(packed(rows, size=size), each, "a long, b long, similarity double")
    top = found.agg(F.min(F.struct((-F.col("similarity")).alias("less"), "a", "b")).alias("x")).where("x is not null")
    return top.select("x.a", "x.b", (-F.col("x.less")).alias("similarity"))


class Counts(Gather):
    """How many pairs of a task lie in each bin."""

    def __init__(self):
        self.n = np.zeros(BINS, np.int64)

    def add(self, x: dict, y: dict, found: np.ndarray) -> Iterator[pd.DataFrame]:
        self.n += np.bincount(found, minlength=BINS)
        return iter(())

    def close(self) -> Iterator[pd.DataFrame]:
        bins = np.flatnonzero(self.n)
        yield pd.DataFrame({"bin": bins, "n": self.n[bins]})


def middle_pair(rows: DataFrame, *, size: int = 256) -> DataFrame:
    """(a, b, similarity): of all pairs of different tags, by rising likeness and then by ids, the one in the middle (the
    upper of two).

    Pairs are counted by bins of their likeness first; only those of the bin that holds the middle are ranked.
    """
    blocks = packed(rows.select(F.lit(0).alias("key"), "id", "tag", "embedding"), size=size)

    def pairs(x: dict, y: dict, s: np.ndarray) -> tuple[np.ndarray, ...]:
        a, b = np.minimum(x["ids"][:, None], y["ids"][None]), np.maximum(x["ids"][:, None], y["ids"][None])
        good = x["tags"][:, None] != y["tags"][None]
        good &= x["ids"][:, None] < y["ids"][None] if x["block"] == y["block"] else a < b
        bins = np.clip(((s + 1) / 2 * BINS).astype(np.int64), 0, BINS - 1)
        return a[good], b[good], s[good], bins[good]

    counts = {r["bin"]: r["n"] for r in over_pairs(blocks, lambda x, y, s: pairs(x, y, s)[3], "bin long, n long", gather=Counts).groupBy("bin").agg(F.sum("n").alias("n")).collect()}
    total, before, wanted = sum(counts.values()), 0, None
    for b in sorted(counts):
        if before + counts[b] > total // 2:
            wanted = b
            break
        before += counts[b]
    if wanted is None:
        return rows.sparkSession.createDataFrame([], "a long, b long, similarity double")

    def inside(x: dict, y: dict, s: np.ndarray) -> pd.DataFrame:
        a, b, p, bins = pairs(x, y, s)
        return pd.DataFrame({"a": a, "b": b, "similarity": p})[bins == wanted]

    ranked = over_pairs(blocks, inside, "a long, b long, similarity double").orderBy("similarity", "a", "b")
    return ranked.offset(total // 2 - before).limit(1)


def featured_pairs(crops: DataFrame, protos: DataFrame) -> DataFrame:
    """(kind, a, b, similarity, names): three pairs that tell the story, similarities to two digits.

    ``same_visit``: the most alike crops of one visit of one name; ``cross_session``: the most alike prototypes of one name;
    ``different``: the middle one of all pairs of prototypes of different names. ``crops``: id, visit, name, embedding; ``protos``:
    id, name, embedding, both with unit vectors. A kind without a pair has no row.
    """
    protos = kept(protos.select("id", "name", "embedding"), "featured")
    of = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "a", "b", F.round("similarity", 2).alias("similarity"))
    burst = best_pair(crops.select(F.concat_ws("|", F.col("name").cast("string"), F.col("visit").cast("string")).alias("key"), "id", "embedding"))
    session = best_pair(protos.select(F.col("name").cast("string").alias("key"), "id", "embedding"))
    differ = middle_pair(protos.withColumn("tag", F.xxhash64("name")))
    named = kept(of(burst, "same_visit").unionByName(of(session, "cross_session")).unionByName(of(differ, "different")), "featured-pairs")
    names = lambda side: protos.select(F.col("id").alias(side), F.col("name").cast("string").alias(f"name_{side}"))
    told = named.where("kind <> 'same_visit'").join(names("a"), "a").join(names("b"), "b")
    told = told.select("kind", "a", "b", "similarity", F.when(F.col("name_a") == F.col("name_b"), F.col("name_a")).otherwise(F.concat_ws(",", "name_a", "name_b")).alias("names"))
    return named.where("kind = 'same_visit'").withColumn("names", F.lit(None).cast("string")).unionByName(told)
