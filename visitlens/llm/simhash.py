"""SimHash near-deduplication with a vantage-point tree over fingerprints.

Distinct fingerprints are dealt into the leaves (shards) of a vantage-point tree that is fitted on a bounded sample. A
fingerprint is at home in one shard. A pair that the tree parts lies near the border where it was parted, so the one on
the inner side also visits the outer side, wherever the triangle bound leaves room for a partner. Each shard then holds
every pair of its residents and of its visitors with residents, and links each fingerprint to the least one that it
reaches inside the shard; no list of all pairs is made. Connected components of these links join the shards.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import bounded, discard, numbered, shuffles_deleted, write_table

SEED = 42


def shingle_hashes(text: str | None, width: int) -> np.ndarray:
    """XXH64 of every run of ``width`` words, in order; of all words where there are fewer; nothing without words."""
    words = (text or "").encode("utf-8").lower().split()  # ASCII letters and white space only
    if not words:
        return np.empty(0, np.uint64)
    n = max(1, len(words) - width + 1)
    runs = map(b" ".join, zip(*(words[i : i + n] for i in range(width)), strict=True)) if len(words) >= width else [b" ".join(words)]
    return np.fromiter(map(xxhash.xxh64_intdigest, runs, repeat(SEED)), np.uint64, n)


def fingerprint(h: np.ndarray) -> int:
    """The bits that are set in more than half of the hashes, as an unsigned number."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), 255 * 64):  # in rows of bytes that cannot overflow
        bits = np.unpackbits(h[i : i + 255 * 64].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        whole = len(bits) // 255 * 255
        counts += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        counts += bits[whole:].sum(axis=0, dtype=np.uint8)
    return int.from_bytes(np.packbits(2 * counts > len(h)).tobytes(), "big")


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def distance(a: np.ndarray, b) -> np.ndarray:
    return np.bitwise_count(a ^ b)


class VantageTree:
    """Inner nodes (vantage point, radius, inside, outside); a negative child -1 - s is shard s."""

    def __init__(self, sample: np.ndarray, leaf: int, seed: int = 1):
        self.nodes: list[list[int]] = []
        self.shards = 0
        self._draw = np.random.default_rng(seed)
        self.root = self._grow(np.unique(sample), leaf)

    def _grow(self, points: np.ndarray, leaf: int) -> int:
        if len(points) > leaf:
            best = None
            for v in self._draw.choice(points, min(8, len(points)), replace=False):
                d = distance(points, v)
                by = np.bincount(d, minlength=65)
                inside = np.cumsum(by)
                for radius in range(64):
                    less = min(inside[radius], len(points) - inside[radius]) / len(points)
                    if less >= 0.2:
                        border = by[max(0, radius - 1) : radius + 3].sum() / len(points)
                        cost = border / -np.log2(1 - less)  # copies for each halving
                        if best is None or cost < best[0]:
                            best = (cost, int(v), radius, d)
            if best:
                at = len(self.nodes)
                _, v, radius, d = best
                self.nodes.append([v, radius, 0, 0])
                self.nodes[at][2] = self._grow(points[d <= radius], leaf)
                self.nodes[at][3] = self._grow(points[d > radius], leaf)
                return at
        self.shards += 1
        return -self.shards

    def route(self, points: np.ndarray, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, shard, at home) of every shard that each point belongs to or visits."""
        rows, shards, homes = [], [], []
        todo = [(self.root, np.arange(len(points)), True)]
        while todo:
            node, at, home = todo.pop()
            if not len(at):
                continue
            if node < 0:
                rows.append(at)
                shards.append(np.full(len(at), -1 - node))
                homes.append(np.full(len(at), home))
                continue
            v, radius, inside, outside = self.nodes[node]
            d = distance(points[at], np.uint64(v)).astype(np.int64)
            if home:
                todo += [(inside, at[d <= radius], True), (outside, at[d > radius], True)]
                todo.append((outside, at[(d <= radius) & (d + reach > radius)], False))
            else:
                todo += [(inside, at[d - reach <= radius], False), (outside, at[d + reach > radius], False)]
        if not rows:
            return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
        return np.concatenate(rows), np.concatenate(shards), np.concatenate(homes)


def _find(parent: np.ndarray, x: np.ndarray) -> np.ndarray:
    while True:
        up = parent[x]
        if (up == x).all():
            return x
        x = up


def _unite(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = _find(parent, a), _find(parent, b)
        apart = a != b
        a, b = a[apart], b[apart]
        np.minimum.at(parent, np.maximum(a, b), np.minimum(a, b))


def local_roots(points: np.ndarray, n_home: int, reach: int, block: int = 1 << 20) -> np.ndarray:
    """For each point the least index reachable over pairs of which one is at home (the first ``n_home``)."""
    parent = np.arange(len(points))
    home = points[:n_home]
    step = max(1, block // max(1, n_home))
    for i in range(0, len(points), step):
        rows, cols = np.nonzero(distance(points[i : i + step, None], home[None, :]) <= reach)
        rows = rows + i
        linked = rows > cols
        _unite(parent, rows[linked], cols[linked])
    return _find(parent, np.arange(len(points)))


def shard_roots(points: np.ndarray, n_home: int, reach: int, leaf: int = 2048) -> np.ndarray:
    """As ``local_roots``; a shard with many residents is parted by a tree of its own, so work stays near-linear."""
    if n_home <= 2 * leaf:
        return local_roots(points, n_home, reach)
    row, part, home = VantageTree(points[:n_home], leaf).route(points, reach)
    order = np.lexsort((row, ~home, part))
    row, part, home = row[order], part[order], home[order]
    parent = np.arange(len(points))
    for some in np.split(np.arange(len(row)), np.flatnonzero(np.diff(part)) + 1):
        at = row[some]
        root = at[local_roots(points[at], int(home[some].sum()), reach)]
        linked = root != at
        _unite(parent, at[linked], root[linked])
    return _find(parent, np.arange(len(points)))


def near_links(points: DataFrame, *, reach: int, shard: int = 4096, sample: int = 1 << 18) -> DataFrame:
    """Links (a, b) whose components are those of all pairs of ``points`` (fp long, distinct) within ``reach`` bits.

    The tree is fitted on at most about ``sample`` fingerprints (2 MB), so shards have about ``shard`` residents up to
    ``sample * shard / 16`` fingerprints; larger shards are parted by trees of their own inside their tasks. Every
    fingerprint is dealt and compared.
    """
    spark = points.sparkSession
    n = points.count()
    drawn = points.sample(False, min(1.0, sample / n), seed=1).limit(2 * sample) if n > sample else points
    some = drawn.select("fp").toArrow()["fp"].to_numpy().astype(np.int64).view(np.uint64)
    tree = spark.sparkContext.broadcast(VantageTree(some, max(16, int(shard * min(1.0, len(some) / max(1, n))))))

    def deal(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            fp = pdf["fp"].to_numpy(np.int64)
            row, shards, home = tree.value.route(fp.view(np.uint64), reach)
            yield pd.DataFrame({"shard": shards, "fp": fp[row], "home": home})

    def link(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["home", "fp"], ascending=[False, True])
        fp = pdf["fp"].to_numpy(np.int64)
        root = shard_roots(fp.view(np.uint64), int(pdf["home"].sum()), reach)
        linked = root != np.arange(len(fp))
        return pd.DataFrame({"a": fp[linked], "b": fp[root[linked]]})

    dealt = points.select("fp").mapInPandas(deal, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInPandas(link, "a long, b long")


def fingerprints(docs: DataFrame, *, width: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, rid, fp) of every row; a null or empty text has fingerprint zero."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = [signed(fingerprint(shingle_hashes(t.as_py(), width))) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["rid"], pa.array(fp, pa.int64())], ["doc_id", "rid", "fp"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("rid"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, rid long, fp long")


def simhash_components(docs: DataFrame, *, width: int = 5, reach: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint every document and join those that chains of pairs within ``reach`` bits connect.

    Shingles are runs of ``width`` words of the whole text, repeats included. Returns doc_id, fingerprint (16 hex
    digits) and component_id, the smallest non-null doc_id of the component (null where all are null). Texts without
    words have fingerprint zero, which links like any other. Each row is a document, repeated rows included.
    """
    rows = write_table(fingerprints(docs, width=width, id_col=id_col, text_col=text_col), "fingerprints")
    points = write_table(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "fingerprint-points")
    found = write_table(connected_components(near_links(points, reach=reach)), "fingerprint-components")
    named = points.join(found, points["fp"] == found["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("component")
    )
    named = write_table(named, "fingerprint-named")
    least = named.groupBy("component").agg(F.min("least").alias("component_id"))
    ids = write_table(named.join(least, "component").select("fp", "component_id"), "fingerprint-ids")
    return rows.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


#: Texts of so many shingles must share more than one rare shingle.
LONG = 64


def rare_shingles(u: np.ndarray, similarity: float, common: np.ndarray, times: np.ndarray) -> np.ndarray:
    """Those of the distinct shingles ``u`` of which any text of that ``similarity`` shares one, rarest first.

    Of n shingles all but ceil(similarity * n) - 1 suffice, if all texts order them alike: by ``times`` (those of the
    sorted ``common``, 0 elsewhere), then by value. The order is for speed alone. With one more for each ``LONG`` of
    them, similar texts share one more for each ``LONG`` of the shorter text.
    """
    rank = np.zeros(len(u), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, u), len(common) - 1)
        rank = np.where(common[at] == u, times[at], 0)
    most = max(0, len(u) - math.ceil(similarity * len(u) - 1e-9) + 1 + len(u) // LONG)
    return u[np.lexsort((u, rank))[:most]]


#: Longs of a text's parity sketch: bit i says whether an odd number of its shingles falls into class i.
SKETCH = 8


def parity_sketch(u: np.ndarray) -> np.ndarray:
    """Two sets differ in at least as many elements as their sketches differ in bits."""
    return np.packbits(np.bincount((u >> np.uint64(7)) % np.uint64(64 * SKETCH), minlength=64 * SKETCH) % 2 == 1).view(">i8")


def common_shingles(texts: DataFrame, *, width: int, sample: int = 16, most: int = 1 << 18) -> tuple[np.ndarray, np.ndarray]:
    """Shingles that stand in more than two texts of one in ``sample``, sorted, and in how many; at most ``most`` (4 MB)."""

    def some(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(shingle_hashes(t.as_py(), width)) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *found]).view(np.int64))], ["key"])

    drawn = texts.where(F.pmod(F.xxhash64("rid"), F.lit(sample)) == 0).select("text").mapInArrow(some, "key long")
    top = drawn.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 2").orderBy(F.desc("n"), "key").limit(most).toArrow()
    common, times = top["key"].to_numpy().view(np.uint64), top["n"].to_numpy()
    order = np.argsort(common)
    return common[order], times[order]


def shingled(texts: DataFrame, *, width: int, similarity: float) -> DataFrame:
    """(rid, doc_id, n, s1, s2, fp, bits, keys) of ``texts`` (rid, doc_id, text), written once.

    n distinct shingles with the digest s1, s2 of their set; the fingerprint; the parity sketch; the rare shingles.
    """
    held = texts.sparkSession.sparkContext.broadcast(common_shingles(texts, width=width))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, digests, fps, bits, keys = [], [], [], [], []
            for t in batch["text"]:
                h = shingle_hashes(t.as_py(), width)
                u = np.unique(h)
                n.append(len(u))
                digests.append(np.frombuffer(xxhash.xxh3_128_digest(u.tobytes()), "<i8"))
                fps.append(signed(fingerprint(h)))
                bits.append(parity_sketch(u))
                keys.append(rare_shingles(u, similarity, *held.value).view(np.int64))
            s = np.array(digests, np.int64).reshape(-1, 2)
            flat = pa.array(np.concatenate([np.empty(0, np.int64), *keys]))
            ends = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
            sketches = pa.FixedSizeListArray.from_arrays(pa.array(np.concatenate([np.empty(0, np.int64), *bits]).astype(np.int64)), SKETCH)
            columns = [batch["rid"], batch["doc_id"], pa.array(n, pa.int32()), pa.array(s[:, 0]), pa.array(s[:, 1]), pa.array(fps, pa.int64())]
            columns += [sketches.cast(pa.list_(pa.int64())), pa.ListArray.from_arrays(ends, flat)]
            yield pa.RecordBatch.from_arrays(columns, ["rid", "doc_id", "n", "s1", "s2", "fp", "bits", "keys"])

    kind = texts.schema["doc_id"].dataType.simpleString()
    schema = f"rid long, doc_id {kind}, n int, s1 long, s2 long, fp long, bits array<long>, keys array<long>"
    return write_table(texts.select("rid", "doc_id", "text").mapInArrow(each, schema), "near-rows")


def _sharing(pairs: DataFrame, similarity: float) -> DataFrame:
    """(rid, other) of the texts x and y that share as many rare shingles as similar ones do; a row for each such shingle.

    Where one suffices, the first is looked at: lengths and its places bound what the texts can have in common.
    """
    both = F.lit(1) + F.least(F.col("x.n") - F.col("x.pos"), F.col("y.n") - F.col("y.pos")) - 1
    bounded = both >= similarity / (1 + similarity) * (F.col("x.n") + F.col("y.n")) - 1e-6
    more = F.floor(F.least("x.n", "y.n") / LONG)
    alike = F.least("x.n", "y.n") >= similarity * F.greatest("x.n", "y.n") - 1e-6
    found = pairs.where(alike & ((more > 0) | bounded)).select(F.col("x.rid").alias("rid"), F.col("y.rid").alias("other"), more.alias("more"))
    return found.groupBy("rid", "other", "more").agg(F.count(F.lit(1)).alias("times")).where("times > more").select("rid", "other")


def _sketches_allow(x: str, y: str, similarity: float) -> Column:
    """Whether sets with these sketches can be so similar."""
    apart = reduce(lambda a, b: a + b, (F.bit_count(F.col(f"{x}.bits")[i].bitwiseXOR(F.col(f"{y}.bits")[i])) for i in range(SKETCH)))
    return apart <= (1 - similarity) / (1 + similarity) * (F.col(f"{x}.n") + F.col(f"{y}.n")) + 1e-6


def near_dedup(
    docs: DataFrame, *, width: int = 5, similarity: float = 0.8, reach: int = 3, id_col: str = "doc_id", text_col: str = "text", stored: bool = False
) -> DataFrame:
    """Keep the row with the smallest id of each group of near-duplicate texts (Jaccard of word shingles).

    Texts with equal sets of shingles are joined first and then stand for one. The vantage-point tree gives links
    between fingerprints within ``reach`` bits. Fingerprints of texts of similarity 0.8 differ by up to 14 bits, where
    the triangle bound prunes nothing, so the others come from an exact prefix filter: two texts so similar share one
    of their rare shingles. Each text is compared with the text that shares most with others, and with the first, of
    those with one of its rare shingles; then every pair of texts that share a rare shingle and are not joined yet is
    tested by lengths, shared shingles and parity sketches, inside the join, and compared where these allow it. So no pair is
    lost, however short the texts or common their passages. All are compared by the exact Jaccard similarity of their
    shingle sets; components of verified pairs are the groups. Null and empty texts, and others without words, are
    alike. A null id is larger than any other here; of rows that share the smallest id one stays. Returns the columns
    of ``docs``, of which none may be called __rid. Of ``stored`` docs (see ``numbered``) no copy is written.
    """
    rows = numbered(docs, "near-input", stored=stored)
    with shuffles_deleted(docs.sparkSession):
        gone = bounded(_later_copies(rows, width=width, similarity=similarity, reach=reach, id_col=id_col, text_col=text_col))
    return rows.join(gone, "__rid", "left_anti").select(docs.columns)


def _later_copies(rows: DataFrame, *, width: int, similarity: float, reach: int, id_col: str, text_col: str) -> DataFrame:
    """(__rid) of the rows that ``near_dedup`` drops, written; the tables in between are deleted as soon as they are used up."""
    texts = rows.select(F.col("__rid").alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    held = shingled(texts, width=width, similarity=similarity)
    least = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    heads = held.groupBy("s1", "s2").agg(F.min_by("rid", least).alias("head"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    heads = write_table(heads, "near-heads")
    twins = write_table(held.select("rid", "s1", "s2").join(heads, ["s1", "s2"]).where("rid <> head").select("rid", "head"), "near-twins")
    discard(heads)
    alone = held.join(bounded(twins.select("rid")), "rid", "left_anti")
    points = write_table(alone.groupBy("fp").agg(F.min("rid").alias("rid")), "near-points")
    found = near_links(points, reach=reach).join(points.select(F.col("fp").alias("a"), "rid"), "a").join(points.select(F.col("fp").alias("b"), F.col("rid").alias("other")), "b")
    same = alone.select("rid", "fp").join(points.select("fp", F.col("rid").alias("other")), "fp")
    candidates = [found.select("rid", "other"), same.where("rid <> other").select("rid", "other")]

    keys = alone.select("rid", "n", F.posexplode("keys").alias("pos", "key"))
    times = write_table(keys.groupBy("key").agg(F.count(F.lit(1)).alias("times")).where("times > 1"), "near-times")
    shared = write_table(keys.join(times, "key"), "near-keys")
    discard(times)
    fame = write_table(shared.groupBy("rid").agg(F.sum("times").alias("fame")), "near-fame")
    one = F.struct("rid", "n", "pos")
    hubs = shared.join(fame, "rid").groupBy("key").agg(F.max_by(one, F.struct("fame", -F.col("rid"))).alias("hub"), F.min(one).alias("first"))
    hubs = write_table(hubs, "near-hubs")
    discard(fame)
    stars = shared.select("key", one.alias("x")).join(hubs, "key").select("x", F.explode(F.array_distinct(F.array("hub", "first"))).alias("y"))
    candidates.append(_sharing(stars, similarity))

    sketches = held.select("rid", F.struct("n", "bits").alias("at"))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = [np.unique(shingle_hashes(t.as_py(), width)).view(np.int64) for t in batch["text"]]
            flat, ends = pa.array(np.concatenate([np.empty(0, np.int64), *s])), pa.array(np.cumsum([0, *map(len, s)]), pa.int32())
            yield pa.RecordBatch.from_arrays([batch["rid"], pa.ListArray.from_arrays(ends, flat)], ["rid", "shingles"])

    both = F.size(F.array_intersect("x", "y"))
    alike = both >= similarity * (F.size("x") + F.size("y") - both)

    def verified(pairs: DataFrame) -> DataFrame:
        pairs = pairs.where("rid <> other").select(F.greatest("rid", "other").alias("a"), F.least("rid", "other").alias("b")).distinct()
        pairs = pairs.join(sketches.select(F.col("rid").alias("a"), F.col("at").alias("x")), "a").join(sketches.select(F.col("rid").alias("b"), F.col("at").alias("y")), "b")
        pairs = write_table(pairs.where(_sketches_allow("x", "y", similarity)).select("a", "b"), "near-pairs")
        wanted = write_table(pairs.select(F.explode(F.array("a", "b")).alias("rid")).distinct(), "near-wanted")
        found = texts.select("rid", "text").join(bounded(wanted), "rid", "left_semi").mapInArrow(sets, "rid long, shingles array<long>")
        shingles = write_table(found, "near-shingles")
        near = pairs.join(shingles.select(F.col("rid").alias("a"), F.col("shingles").alias("x")), "a").join(shingles.select(F.col("rid").alias("b"), F.col("shingles").alias("y")), "b")
        near = write_table(near.where(alike).select("a", "b"), "near-verified")
        discard(pairs, wanted, shingles)
        return near

    near = verified(reduce(DataFrame.unionByName, candidates))
    discard(points, hubs)
    begun = write_table(connected_components(near), "near-begun")
    joined = shared.join(begun, shared["rid"] == begun["node"], "left").select("key", "rid", "n", "pos", F.coalesce("component", "rid").alias("component"))
    joined = write_table(joined, "near-joined")
    discard(shared, begun)
    ends = joined.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("key")
    apart = joined.join(ends, "key", "left_semi").join(held.select("rid", "bits"), "rid").select("key", F.struct("rid", "n", "pos", "component", "bits").alias("x"))
    apart = write_table(apart, "near-apart")
    discard(joined)
    rest = apart.join(apart.select("key", F.col("x").alias("y")), "key").where(F.col("x.component") < F.col("y.component"))
    more = verified(_sharing(rest.where(_sketches_allow("x", "y", similarity)), similarity))
    discard(apart)
    groups = write_table(connected_components(near.unionByName(more)), "near-groups")
    members = held.select("rid", "doc_id").join(twins, "rid", "left").withColumn("node", F.coalesce("head", "rid")).join(groups, "node", "left")
    members = write_table(members.select("rid", "doc_id", F.coalesce("component", "node").alias("component")), "near-members")
    discard(held, twins, near, more, groups)
    stay = members.groupBy("component").agg(F.min_by("rid", least).alias("stay"), F.count(F.lit(1)).alias("times")).where("times > 1").drop("times")
    stay = write_table(stay, "near-stay")
    gone = write_table(members.join(stay, "component").where("rid <> stay").select(F.col("rid").alias("__rid")), "near-gone")
    discard(members, stay)
    return gone
