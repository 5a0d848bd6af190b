"""All pairs of vectors by blocks: packed rows, pairs of blocks that a bound leaves, one matrix product for each.

A task holds some blocks at a time, whatever the number of vectors of a key. Blocks are of vectors that lie together, so
pairs of blocks are dropped by the angle between their centres, less the widest angles inside.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from visitlens.sources.scratch import kept


def _codes(x: np.ndarray, bits: int = 16) -> np.ndarray:
    """Sign bits under fixed random directions; vectors that lie together mostly share the leading ones."""
    side = np.random.default_rng(5).standard_normal((x.shape[1], bits))
    return ((x @ side) > 0) @ (1 << np.arange(bits)[::-1])


def packed(rows: DataFrame, *, size: int = 256) -> DataFrame:
    """Blocks (key, block, n, ids, tags, vectors, centre, reach) of at most ``size`` of ``rows`` (key, id, embedding: unit
    vectors, and tag: a number that goes with an id, 0 unless given).

    Rows without a vector are left out. ``reach`` is the widest angle between a block's centre and its vectors.
    """
    if "tag" not in rows.columns:
        rows = rows.withColumn("tag", F.lit(0))
    key_type = rows.schema["key"].dataType.simpleString()

    def coded(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            x = np.stack(f["embedding"].to_numpy()).astype(float) if len(f) else np.zeros((0, 1))
            yield f.assign(code=_codes(x).astype(np.int32))

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        number, held = TaskContext.get().partitionId() << 32, []

        def close() -> pd.DataFrame:
            x = np.stack([r.embedding for r in held]).astype(float)
            c = x.sum(0)
            c = c / max(np.linalg.norm(c), 1e-12)
            reach = float(np.arccos(np.clip(x @ c, -1, 1)).max())
            ids, tags = (np.array([getattr(r, c) for r in held], "<i8").tobytes() for c in ("id", "tag"))
            return pd.DataFrame([(held[0].key, number, len(held), ids, tags, x.astype("<f8").tobytes(), c.tolist(), reach)], columns=["key", "block", "n", "ids", "tags", "vectors", "centre", "reach"])

        for f in frames:
            for r in f.itertuples(index=False):
                if held and (len(held) == size or r.key != held[0].key):
                    yield close()
                    number, held = number + 1, []
                held.append(r)
        if held:
            yield close()

    given = rows.select("key", F.col("id").cast("long").alias("id"), F.col("tag").cast("long").alias("tag"), F.col("embedding").cast("array<double>").alias("embedding")).where("embedding is not null and key is not null")
    given = given.mapInPandas(coded, f"key {key_type}, id long, tag long, embedding array<double>, code int")
    dealt = given.repartitionByRange("key", "code", "id").sortWithinPartitions("key", "code", "id")
    return kept(dealt.mapInPandas(cut, f"key {key_type}, block long, n int, ids binary, tags binary, vectors binary, centre array<double>, reach double"), "blocks")


class Gather:
    """What a task makes of its pairs of blocks before it hands rows on; the default is all that ``each`` returned."""

    def add(self, x: dict, y: dict, found: object) -> Iterator[pd.DataFrame]:
        yield found

    def close(self) -> Iterator[pd.DataFrame]:
        return iter(())


def over_pairs(blocks: DataFrame, each: Callable[[dict, dict, np.ndarray], object], schema: str, *, least: float = -1.0, gather: Callable[[], Gather] = Gather, directed: bool = False, tiles: int = 12) -> DataFrame:
    """What ``each`` (block, block, their products) returns for the pairs of blocks of a key, itself included, that can hold
    a product of ``least``. A pair comes once; a block with itself gives both orders of its rows in the products.

    Blocks of a key are laid in ``tiles`` of at most 32 MB, and a task takes two tiles: it holds one and goes through the other, so a vector is moved once
    for each tile and not for each block. A new ``gather`` sees all that comes of two tiles. With ``directed`` a task takes a tile as
    the first block of pairs with all blocks of the key (both orders come, and a block with itself once), so a gather sees all there is for its blocks.
    """
    key = blocks.schema["key"].dataType.simpleString()
    size = blocks.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length("vectors")).alias("bytes"))
    height = F.greatest(F.lit(1), F.least(F.ceil(F.col("n") / tiles), F.floor(F.lit(32e6) / F.greatest("bytes", F.lit(1)))))
    size = size.select("key", F.ceil(F.col("n") / height).cast("int").alias("of"), height.cast("long").alias("height"))
    # One row a block, without its vectors.
    place = (F.row_number().over(Window.partitionBy("key").orderBy("block")) - 1).alias("place")
    tile = blocks.select("key", "block", place).join(size, "key").select(F.col("block"), F.floor(F.col("place") / F.col("height")).cast("int").alias("tile"), "of")
    laid = blocks.join(tile, "block")
    pairs = lambda low, high, make: F.transform(F.sequence(low, high), lambda u: F.struct(*(x.cast("int").alias(n) for n, x in zip(("a", "b"), make(u), strict=True))))
    t, last = F.col("tile"), F.col("of") - 1
    if directed:
        held, passing = F.array(F.struct(t.alias("a"), F.lit(-1).alias("b"))), pairs(F.lit(0), last, lambda u: (u, F.lit(-1)))
    else:
        held, passing = pairs(t, last, lambda u: (t, u)), F.when(t > 0, pairs(F.lit(0), F.greatest(t - 1, F.lit(0)), lambda u: (u, t))).otherwise(F.array().cast("array<struct<a:int,b:int>>"))
    columns = ["key", "block", "n", "ids", "tags", "vectors", "centre", "reach"]
    both = laid.select(*columns, F.explode(held).alias("p"), F.lit(0).alias("side")).unionByName(laid.select(*columns, F.explode(passing).alias("p"), F.lit(1).alias("side")))
    dealt = both.select(*columns, "p.a", "p.b", "side").repartition("key", "a", "b").sortWithinPartitions("key", "a", "b", "side", "block")

    def read(r: tuple) -> dict:
        return {"key": r.key, "block": r.block, "ids": np.frombuffer(r.ids, "<i8"), "tags": np.frombuffer(r.tags, "<i8"), "x": np.frombuffer(r.vectors, "<f8").reshape(r.n, -1), "centre": np.asarray(r.centre), "reach": r.reach}

    def near(x: dict, y: dict) -> bool:
        if least <= -1 or x["block"] == y["block"]:
            return True
        apart = np.arccos(np.clip(x["centre"] @ y["centre"], -1, 1)) - x["reach"] - y["reach"] - 1e-6
        return np.cos(max(0.0, apart)) >= least

    def products(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, first, made = None, [], None
        for f in frames:
            for r in f.itertuples(index=False):
                if (r.key, r.a, r.b) != at:
                    if made:
                        yield from made.close()
                    at, first, made = (r.key, r.a, r.b), [], gather()
                y = read(r)
                if r.side == 0:
                    first.append({**y, **{c: y[c].copy() for c in ("ids", "tags", "x")}})
                    if directed or r.a != r.b:
                        continue
                for x in first:
                    if near(x, y):
                        yield from made.add(x, y, each(x, y, x["x"] @ y["x"].T))
        if made:
            yield from made.close()

    return dealt.mapInPandas(products, schema)


def similar_pairs(rows: DataFrame, least: float, *, size: int = 256) -> DataFrame:
    """(a, b, similarity) of the pairs of ids of one key, a < b, whose cosine exceeds ``least``; all of them, each once."""

    def pairs(x: dict, y: dict, s: np.ndarray) -> pd.DataFrame:
        i, j = np.nonzero(s > least)
        a, b = x["ids"][i], y["ids"][j]
        once = a < b if x["block"] == y["block"] else a != b
        return pd.DataFrame({"a": np.minimum(a, b)[once], "b": np.maximum(a, b)[once], "similarity": s[i, j][once]})

    return over_pairs(packed(rows, size=size), pairs, "a long, b long, similarity double", least=least)


class Forest(Gather):
    """As few links as keep together what is linked: one for each time that two parts meet."""

    def __init__(self):
        self.start: dict[int, int] = {}
        self.parent = np.zeros(0, np.int64)

    def roots(self, block: dict) -> np.ndarray:
        if block["block"] not in self.start:
            self.start[block["block"]] = len(self.parent)
            self.parent = np.concatenate([self.parent, np.arange(len(block["ids"])) + len(self.parent)])
        at = self.parent[self.start[block["block"]] :][: len(block["ids"])]
        while not np.array_equal(at, up := self.parent[at]):
            at = up
        self.parent[self.start[block["block"]] :][: len(at)] = at
        return at

    def add(self, x: dict, y: dict, found: np.ndarray) -> Iterator[pd.DataFrame]:
        self.roots(x), self.roots(y)
        a, b = self.roots(x), self.roots(y)
        i, j = np.nonzero(found & (a[:, None] != b[None]))
        if not len(i):
            return
        _, one = np.unique(np.stack([a[i], b[j]], 1), axis=0, return_index=True)
        links = []
        for n in one.tolist():
            u, v = a[i[n]], b[j[n]]
            while self.parent[u] != u:
                u = self.parent[u]
            while self.parent[v] != v:
                v = self.parent[v]
            if u != v:
                self.parent[max(u, v)] = min(u, v)
                links.append((x["ids"][i[n]], y["ids"][j[n]]))
        yield pd.DataFrame(links, columns=["a", "b"])


def links(rows: DataFrame, least: float, *, size: int = 256) -> DataFrame:
    """(a, b): pairs of ids of one key whose cosine exceeds ``least``, as many as it takes to join all that such pairs join."""
    return over_pairs(packed(rows, size=size), lambda x, y, s: s > least, "a long, b long", least=least, gather=Forest)


class _Nearest(Gather):
    """The best of each tag for the probes of a tile, or the best of all; of equal ones the smallest tag."""

    def __init__(self):
        self.held: dict[int, tuple[dict, dict[int, np.ndarray]]] = {}

    def add(self, x: dict, y: dict, found: tuple[list[int], np.ndarray] | None) -> Iterator[pd.DataFrame]:
        if found is not None:
            own = self.held.setdefault(x["block"], (x, {}))[1]
            for j, tag in enumerate(found[0]):
                own[tag] = np.maximum(own[tag], found[1][:, j]) if tag in own else found[1][:, j]
        return iter(())

    def close(self) -> Iterator[pd.DataFrame]:
        for x, own in self.held.values():
            for tag, top in own.items():
                i = np.flatnonzero((top > -np.inf) & (x["tags"] < 0))
                yield pd.DataFrame({"key": x["key"], "id": x["ids"][i], "tag": tag, "similarity": top[i]})


class _Best(Gather):
    def __init__(self):
        self.held: dict[int, tuple[dict, np.ndarray, np.ndarray]] = {}

    def add(self, x: dict, y: dict, found: tuple[list[int], np.ndarray] | None) -> Iterator[pd.DataFrame]:
        if found is not None:
            n = len(x["ids"])
            _, top, tag = self.held.setdefault(x["block"], (x, np.full(n, -np.inf), np.full(n, -1, np.int64)))
            j = found[1].argmax(1)
            new, names = found[1][np.arange(n), j], np.array(found[0])[j]
            better = (new > top) | ((new == top) & (names < tag))
            top[better], tag[better] = new[better], names[better]
        return iter(())

    def close(self) -> Iterator[pd.DataFrame]:
        for x, top, tag in self.held.values():
            i = np.flatnonzero((top > -np.inf) & (x["tags"] < 0))
            yield pd.DataFrame({"key": x["key"], "id": x["ids"][i], "tag": tag[i], "similarity": top[i]})


def nearest(probes: DataFrame, templates: DataFrame, *, every_tag: bool = False, others: bool = False, size: int = 256) -> DataFrame:
    """(key, id, tag, similarity): the template of each probe's key that is most alike, of equal ones that with the smallest tag;
    with ``every_tag`` the best of each tag. ``probes``: key, id, embedding; ``templates`` also tag, from 0. With ``others`` a template of the probe's own id doesn't count."""
    rows = probes.select("key", "id", F.lit(-1).cast("long").alias("tag"), "embedding").unionByName(templates.select("key", "id", F.col("tag").cast("long").alias("tag"), "embedding"))

    def each(x: dict, y: dict, s: np.ndarray) -> tuple[list[int], np.ndarray] | None:
        by = np.argsort(y["tags"], kind="stable")
        by = by[y["tags"][by] >= 0]
        if not len(by) or not (x["tags"] < 0).any():
            return None
        s, tags = s[:, by], y["tags"][by]
        if others:
            s = np.where(x["ids"][:, None] != y["ids"][by][None], s, -np.inf)
        starts = np.flatnonzero(np.r_[True, np.diff(tags) != 0])
        return tags[starts].tolist(), np.maximum.reduceat(s, starts, axis=1)

    kind = probes.schema["key"].dataType.simpleString()
    return over_pairs(packed(rows, size=size), each, f"key {kind}, id long, tag long, similarity double", gather=_Nearest if every_tag else _Best, directed=True)
