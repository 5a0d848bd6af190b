"""Exact ranked lexical search over blocked posting lists.

Documents become vectors of term impacts, are ordered by similarity (the nearest of a bounded number of centres, then sign
bits of random projections) and cut into chunks. In a chunk each term's posting list is clustered once more, by the nearest of a few of its own
documents, into blocks; a block keeps the coordinatewise maximum of its documents' vectors. For a set of terms the sum of
a block's maxima bounds the score of every document in it, so a block is skipped if that bound, with the smallest id in
it, would rank behind the item's current tenth document; else its documents are scored from the forward vectors.

Lists that can't decide are not opened: an item's terms in order of their greatest impacts, as long as their sum stays
below the item's tenth score (terms without which no document gets there must be met in another list).
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import batches, discard, drawn, write_table

#: Bytes to the lower case of A-Z and, where they part terms, to a space; all bytes beyond ASCII belong to terms.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if chr(b).isalnum() or b > 127 else 32 for b in range(128)) + bytes(range(128, 256))
LAST_ID = (1 << 63) - 1


def terms(text: str) -> list[bytes]:
    """The terms of a text in UTF-8: runs of letters, digits and characters beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(FOLD).split()


def forward_vectors(docs: DataFrame, vocabulary: dict[bytes, int]) -> DataFrame:
    """A written table (rid, doc_id, n, terms, tfs): of each row the number of its terms and those that the vocabulary has."""
    known = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voc = known.value
        for b in batches:
            n, at, tf = [], [], []
            for text in b.column("text"):
                words = terms(text.as_py() or "")
                own = Counter(w for w in words if w in voc)
                n.append(len(words))
                at.append([voc[w] for w in own])
                tf.append(list(own.values()))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(at, pa.list_(pa.int32())), pa.array(tf, pa.list_(pa.int32()))], ["doc_id", "n", "terms", "tfs"])

    found = docs.mapInArrow(read, "doc_id long, n long, terms array<int>, tfs array<int>").withColumn("rid", F.monotonically_increasing_id())
    written = write_table(found, "lexical-forward")
    known.destroy()
    return written


class Items:
    """A block of queries: the terms of each, by number."""

    def __init__(self, rows: list[tuple[object, bytes]]):
        self.ids = list(dict.fromkeys(i for i, _ in rows))
        numbers = {i: k for k, i in enumerate(self.ids)}
        self.vocabulary = {t: k for k, t in enumerate(sorted({t for _, t in rows if t is not None}))}
        own = defaultdict(set)
        for i, t in rows:
            if t is not None:
                own[numbers[i]].add(self.vocabulary[t])
        self.terms = [np.array(sorted(own[k]), np.int64) for k in range(len(self.ids))]


class Chunk:
    """Documents that lie near each other: a matrix of impacts over the terms they have, and the blocks of each term's list."""

    def __init__(self, ids: np.ndarray, own: np.ndarray, terms: np.ndarray, impacts: np.ndarray, *, block: int = 32):
        """``impacts`` of ``terms`` (by number) in the documents ``own`` (by position)."""
        self.ids, self.block = ids, block
        self.columns, at = np.unique(terms, return_inverse=True)
        self.impacts = np.zeros((len(ids), len(self.columns)), np.int64)
        self.impacts[own, at] = impacts
        self.most = self.impacts.max(0, initial=0)
        self.lists: dict[int, list[tuple[np.ndarray, np.ndarray, int]]] = {}

    def blocks(self, column: int) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, coordinatewise maxima, smallest id) of each block of a term's list; clustered when first asked for."""
        if column not in self.lists:
            holds, groups = np.flatnonzero(self.impacts[:, column]), []
            if len(holds) > self.block:
                own = self.impacts[holds].astype(np.float32)
                pivots = own[:: self.block]
                near = (own @ (pivots / (np.sqrt((pivots * pivots).sum(1, keepdims=True)) + 1e-9)).T).argmax(1)
                for p in range(len(pivots)):
                    part = holds[near == p]
                    groups += [g for g in np.array_split(part, max(1, -(-len(part) // (2 * self.block)))) if len(g)]
            elif len(holds):
                groups = [holds]
            self.lists[column] = [(g, self.impacts[g].max(0), int(self.ids[g].min())) for g in groups]
        return self.lists[column]

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The columns of those of the terms that the chunk has."""
        at = np.searchsorted(self.columns, wanted)
        at[at == len(self.columns)] = 0
        return at[self.columns[at] == wanted] if len(self.columns) else at[:0]


class Top:
    """The best k (score, id, row) of an item; equal scores go by id, then by row."""

    def __init__(self, k: int, floor: int):
        self.k, self.floor = k, floor
        self.rows: list[tuple[int, int, int]] = []

    def behind(self, score: int, least_id: int) -> bool:
        """Whether a document with at most this score and at least this id surely doesn't enter."""
        if score < max(1, self.floor):
            return True
        return len(self.rows) == self.k and (-score, least_id) > self.rows[-1][:2]

    def offer(self, scores: np.ndarray, ids: np.ndarray, numbers: np.ndarray) -> None:
        least = max(1, self.floor, -self.rows[-1][0] if len(self.rows) == self.k else 1)
        good = np.flatnonzero(scores >= least)
        if len(good) > self.k:
            good = good[np.lexsort([numbers[good], ids[good], -scores[good]])[: self.k]]
        if len(good):
            self.rows = sorted(self.rows + [(-int(scores[i]), int(ids[i]), int(numbers[i])) for i in good])[: self.k]


def search_chunk(chunk: Chunk, numbers: np.ndarray, item: np.ndarray, essential: np.ndarray, top: Top) -> int:
    """Offer the documents of a chunk that may enter an item's list; returns how many were scored."""
    at = chunk.find(item)
    bounded = [(int(summary[at].sum()), docs, least) for column in chunk.find(essential) for docs, summary, least in chunk.blocks(int(column))]
    done, scored = np.zeros(len(chunk.ids), bool), 0
    for bound, docs, least in sorted(bounded, key=lambda x: -x[0]):
        if top.behind(bound, least):
            continue
        docs = docs[~done[docs]]
        if len(docs):
            done[docs] = True
            top.offer(chunk.impacts[docs][:, at].sum(1), chunk.ids[docs], numbers[docs])
            scored += len(docs)
    return scored


def essential_terms(item: np.ndarray, greatest: np.ndarray, floor: int) -> np.ndarray:
    """The terms whose lists must be opened: a document that has none of them stays below the floor."""
    by = item[np.argsort(greatest[item], kind="stable")]
    return np.sort(by[np.cumsum(greatest[by]) >= max(1, floor)])


#: Dimensions into which terms are hashed for ordering documents, and the sign bits that order them within a centre.
FOLDED, SIGNS = 512, 16


def directions(n: int, own: np.ndarray, terms: np.ndarray, impacts: np.ndarray) -> np.ndarray:
    """Unit vectors of ``n`` documents over hashed terms; zero where a document has none."""
    m = np.zeros((n, FOLDED), np.float32)
    np.add.at(m, (own, (terms.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)).astype(np.int64) % FOLDED), impacts)
    return m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), 1e-9)


def fit_centres(m: np.ndarray, most: int, rounds: int = 4) -> np.ndarray:
    """Centres of unit vectors by spherical k-means."""
    m = m[(m != 0).any(1)]
    if not len(m):
        return np.zeros((1, FOLDED), np.float32)
    centres = m[np.linspace(0, len(m) - 1, min(most, len(m))).astype(int)]
    for _ in range(rounds):
        sums = np.zeros_like(centres)
        np.add.at(sums, (m @ centres.T).argmax(1), m)
        size = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(size > 0, sums / np.maximum(size, 1e-9), centres)
    return centres


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    doc_id: str = "doc_id",
    doc_text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    items_at_once: int = 4096,
    chunk_rows: int = 512,
    sample_rows: int = 2048,
    centres: int = 64,
    seeds: int = 64,
) -> DataFrame:
    """item_id, rank, doc_id, score: the ``k`` documents with the highest scores above 0 for each item.

    Null and empty texts have no terms. Rows that share an id are documents of their own; equal scores go by the smaller
    id, a null one (or the greatest long) last and returned as null. Items that share an id (null is one as well) are one item with the terms of
    all; an item without terms, or whose terms no document has, has no row. Other columns are not read. Statistics, lists
    and scores are of all rows; only the centres that order the documents are fitted on ``sample_rows`` of them, and the
    first floors come from about ``seeds`` documents of each item's rarest terms. Items go in blocks of about ``items_at_once``, by a hash of their
    ids; the driver and each task hold the terms of one block, and lists are kept of terms that the block has.
    """
    spark = docs.sparkSession
    asked = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text"))
    parts = max(1, -(-asked.select("item").distinct().count() // items_at_once))
    kind, found = items.schema[item_id].dataType.simpleString(), None
    with batches(spark, rows=chunk_rows, size="16m"):
        for part in range(parts):
            own = asked if parts == 1 else asked.where(F.pmod(F.xxhash64("item"), F.lit(parts)) == part)
            block = Items([(r["item"], t) for r in own.toLocalIterator() for t in terms(r["text"] or "") or [None]])
            ranked = _ranked_block(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(doc_text).alias("text")), block, k, sample_rows, centres, seeds)
            names = spark.createDataFrame(list(enumerate(block.ids)), f"item int, item_id {kind}")
            ranked = ranked.join(F.broadcast(names), "item").select("item_id", "rank", "doc_id", "score")
            found = ranked if found is None else found.unionByName(ranked)
    return found


TOPS = "item int, score long, id long, rid long"


def _emit(item: list[int], rows: list[tuple[int, int, int]]) -> pa.RecordBatch:
    s, i, r = zip(*rows, strict=True) if rows else ((), (), ())
    return pa.RecordBatch.from_arrays([pa.array(item, pa.int32()), pa.array([-x for x in s], pa.int64()), pa.array(i, pa.int64()), pa.array(r, pa.int64())], ["item", "score", "id", "rid"])


def _ranked_block(docs: DataFrame, items: Items, k: int, sample_rows: int, n_centres: int, seeds: int) -> DataFrame:
    spark, width = docs.sparkSession, len(items.vocabulary)
    forward = forward_vectors(docs, items.vocabulary)
    total = forward.agg(F.count_if(F.col("n") > 0).alias("docs"), F.sum("n").alias("length")).first()
    n_docs, length = total["docs"], max(1, total["length"] or 0)
    frequency = np.zeros(width, np.int64)
    for r in forward.select(F.explode("terms").alias("t")).groupBy("t").count().toLocalIterator():
        frequency[r["t"]] = r["count"]
    weight = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(f) + 1))) for f in frequency], np.int64)

    # Of each item the rarest terms, until their documents are enough.
    asked_by = defaultdict(list)
    for number, own in enumerate(items.terms):
        by = own[np.argsort(frequency[own], kind="stable")]
        for t in by[: 1 + int(np.searchsorted(np.cumsum(frequency[by]), seeds))].tolist():
            asked_by[t].append(number)
    shared = spark.sparkContext.broadcast({"weight": weight, "frequency": frequency, "asked": dict(asked_by), "items": items.terms, "docs": n_docs, "length": length})
    first = write_table(forward.mapInArrow(_first_look(shared, k, seeds), TOPS), "lexical-first")
    greatest = np.zeros(width, np.int64)
    for r in first.where("item < 0").groupBy("item").agg(F.max("score").alias("score")).toLocalIterator():
        greatest[-1 - r["item"]] = r["score"]
    floors = np.zeros(len(items.ids), np.int64)
    for r in _ranked(first.where("item >= 0"), k).where(F.col("rank") == k).toLocalIterator():
        floors[r["item"]] = r["score"]
    essential = [essential_terms(own, greatest, int(f)) for own, f in zip(items.terms, floors, strict=True)]

    few = drawn(forward.where(F.size("terms") > 0), F.xxhash64("rid"), sample_rows, n_docs).orderBy(F.xxhash64("rid")).limit(sample_rows).select("n", "terms", "tfs").collect()
    sizes, flat = [len(r["terms"]) for r in few], [np.concatenate([np.array(r[c], np.int64) for r in few]) if few else np.zeros(0, np.int64) for c in ("terms", "tfs")]
    own = np.repeat(np.arange(len(few)), sizes)
    centres = fit_centres(directions(len(few), own, flat[0], impacts(shared.value, np.array([r["n"] for r in few], np.int64)[own], flat[1], flat[0])), n_centres)
    placed = forward.where(F.size("terms") > 0).mapInArrow(_place(shared, centres), "doc_id long, n long, terms array<int>, tfs array<int>, rid long, cell int, signs int")
    tasks = max(1, min(int(frequency.sum()) // 500_000, 100_000))
    order = ["cell", "signs", "rid"]
    plan = spark.sparkContext.broadcast({"floors": floors, "essential": essential})
    tops = write_table(placed.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(_search(shared, plan, k), TOPS), "lexical-tops")
    ranked = _ranked(tops, k).where(F.col("rank") <= k)
    result = write_table(ranked.select("item", "rank", F.when(F.col("id") != LAST_ID, F.col("id")).alias("doc_id"), "score"), "lexical-result")
    discard(forward, first, tops)
    shared.destroy()
    plan.destroy()
    return result


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    """``rank`` of each row in its item; a task hands on its own best k of each item only."""
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), "id", "rid"))).where(F.col("rank") <= k)


def impacts(known: dict, n: np.ndarray, tf: np.ndarray, t: np.ndarray) -> np.ndarray:
    """What terms ``t``, ``tf`` times in documents of ``n`` terms, add to a score; all in 64-bit integers."""
    m = 100 - 90 + (90 * n * known["docs"]) // known["length"]
    return known["weight"][t] * ((1_000_000_000 * tf) // (1000 * tf + 8 * m))


def _flat(b: pa.RecordBatch) -> tuple[np.ndarray, ...]:
    """ids (null: the greatest), rows' numbers, and for each posting the position of its document, n, term, tf."""
    sizes = pc.list_value_length(b.column("terms")).to_numpy(zero_copy_only=False)
    own = np.repeat(np.arange(len(b)), sizes)
    of = lambda c: b.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    ids = b.column("doc_id").fill_null(LAST_ID).to_numpy(zero_copy_only=False)
    return ids, b.column("rid").to_numpy(zero_copy_only=False), own, b.column("n").to_numpy(zero_copy_only=False)[own], of("terms"), of("tfs")


def _first_look(shared: Broadcast, k: int, seeds: int):
    """Each task's best k of some documents for each item (a bound from below), and as item -1-t the greatest impact of each term t."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        greatest, tops = np.full(len(known["weight"]), -1, np.int64), {}
        share = np.minimum(1.0, seeds / np.maximum(1, known["frequency"]))
        seeded = np.zeros(len(share), bool)
        seeded[list(known["asked"])] = True
        for b in batches:
            ids, numbers, own, n, t, tf = _flat(b)
            adds = impacts(known, n, tf, t)
            np.maximum.at(greatest, t, adds)
            with np.errstate(over="ignore"):
                draw = (numbers[own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + t.astype(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(11)
            chosen = np.flatnonzero(seeded[t] & (draw < share[t] * 2.0**53))
            wanted = sorted({(int(own[i]), item) for i in chosen for item in known["asked"][int(t[i])]})
            starts = np.searchsorted(own, np.arange(len(b) + 1))
            for d, item in wanted:
                part = slice(starts[d], starts[d + 1])
                score = adds[part][np.isin(t[part], known["items"][item])].sum()
                tops.setdefault(item, Top(k, 0)).offer(np.array([score]), ids[d : d + 1], numbers[d : d + 1])
        have = np.flatnonzero(greatest >= 0)
        yield _emit((-1 - have).tolist(), [(-int(x), 0, 0) for x in greatest[have]])
        yield _emit([i for i, x in tops.items() for _ in x.rows], [r for x in tops.values() for r in x.rows])

    return look


def _place(shared: Broadcast, centres: np.ndarray):
    """The nearest centre of each document and its signs under fixed random projections."""

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        random = np.random.default_rng(11).standard_normal((FOLDED, SIGNS)).astype(np.float32)
        for b in batches:
            _, _, own, n, t, tf = _flat(b)
            m = directions(len(b), own, t, impacts(shared.value, n, tf, t))
            signs = ((m @ random) > 0) @ (1 << np.arange(SIGNS))
            cell = (m @ centres.T).argmax(1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell, pa.int32()), pa.array(signs, pa.int32())], [*b.schema.names, "cell", "signs"])

    return place


def _search(shared: Broadcast, plan: Broadcast, k: int, most_cells: int = 1 << 24):
    """Each task's best k for each item; a batch is a chunk, parted further where its matrix would be too large."""

    def chunks(b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        if len(b) > 1 and len(b) * len(pc.unique(b.column("terms").flatten())) > most_cells:
            yield from chunks(b.slice(0, len(b) // 2))
            yield from chunks(b.slice(len(b) // 2))
        else:
            yield b

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, floors, essential = shared.value, plan.value["floors"], plan.value["essential"]
        items = known["items"]
        some = np.array([i for i, own in enumerate(items) if len(own) and len(essential[i])], np.int64)
        starts = lambda lists: np.concatenate([[0], np.cumsum([len(lists[i]) for i in some])[:-1]]) if len(some) else np.zeros(0, int)
        all_terms, all_essential = (np.concatenate([x[i] for i in some]) if len(some) else np.zeros(0, int) for x in (items, essential))
        at_terms, at_essential = starts(items), starts(essential)
        tops, most, has = {i: Top(k, int(floors[i])) for i in some.tolist()}, np.zeros(len(known["weight"]), np.int64), np.zeros(len(known["weight"]), bool)
        for b in (c for batch in batches for c in chunks(batch)) if len(some) else ():
            ids, numbers, own, n, t, tf = _flat(b)
            chunk = Chunk(ids, own, t, impacts(known, n, tf, t))
            most[chunk.columns], has[chunk.columns] = chunk.most, True
            bounds, meets = np.add.reduceat(most[all_terms], at_terms), np.logical_or.reduceat(has[all_essential], at_essential)
            least = int(ids.min())
            for j in np.flatnonzero(meets):
                i = int(some[j])
                if not tops[i].behind(int(bounds[j]), least):
                    search_chunk(chunk, numbers, items[i], essential[i], tops[i])
            most[chunk.columns], has[chunk.columns] = 0, False
        yield _emit([i for i, x in tops.items() for _ in x.rows], [r for x in tops.values() for r in x.rows])

    return search
