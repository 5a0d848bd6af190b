"""Benchmark decontamination by q-gram lemma filtering.

Texts and benchmark items are reduced to lower-case letters and digits with single spaces. A region of n characters that
matches with at most e edits shares at least n + 1 - q * (e + 1) q-grams, all of whose diagonals lie within e of each
other. So shared q-grams are counted in overlapping diagonal bands, and only bands that can hold such a region are
kept. Of these, shorter grams give a second and sharper bound, and all parts of the item that are long enough and still
meet it are verified by banded alignment.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .shared import write_table

#: A multiplier for rolling hashes, and the base of its bitmap of present hashes.
BASE, MIX = 0x100000001B3 * 2 + 1, 0x9E3779B97F4A7C15
#: The length of the grams of a band's second test, and a character that no text has.
FINE, NOWHERE = 5, 0xFFFFFFFF


@cache
def _fold_table() -> np.ndarray:
    """For each code point its lower-case letter or digit; 0 for what separates words."""
    return np.fromiter((ord(c.lower()[0]) if c.isalnum() else 0 for c in map(chr, range(0x110000))), np.uint32, 0x110000)


def fold(text: str, table: np.ndarray) -> np.ndarray:
    """Code points of the folded text: words of letters and digits, with one space between them."""
    raw = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    c = table[raw]
    words = c != 0
    ahead = np.concatenate([words[1:], [False]])
    keep = words | (ahead & (np.cumsum(words) > 0))
    return np.where(words, c, 32)[keep].astype(np.uint32)


def gram_hashes(c: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit hash of each run of ``q`` code points, put together from runs of powers of two."""
    if len(c) < q:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        part, width, power = c.astype(np.uint64) * np.uint64(MIX), 1, np.uint64(BASE)
        out, done = None, 0
        left = q
        while left:
            if left & 1:
                n = len(c) - q + 1
                piece = part[done : done + n]
                out = piece.copy() if out is None else out * _power(width) + piece
                done += width
            left >>= 1
            if left:
                part = part[: len(part) - width] * power + part[width:]
                power = power * power
                width *= 2
        return (out ^ (out >> np.uint64(29))) * np.uint64(MIX)


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def edits_within(a: np.ndarray, b: np.ndarray, most: int) -> int:
    """The edit distance of two texts, or ``most + 1`` if it is greater: a table of the diagonals up to ``most`` off."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    if len(a) == len(b) and (a == b).all():
        return 0
    far, width = most + 1, 2 * most + 1
    offsets = np.arange(-most, most + 1)
    row = np.where(offsets >= 0, offsets, far)
    padded = np.concatenate([np.full(most + 1, -1, np.int64), b.astype(np.int64), np.full(most + 1, -2, np.int64)])
    for i in range(1, len(a) + 1):
        cols = offsets + i
        there = (cols >= 0) & (cols <= len(b))
        other = padded[np.clip(cols + most, 0, len(padded) - 1)]
        best = row + ((other != a[i - 1]) | (cols < 1))
        best[cols == 0] = i
        best[:-1] = np.minimum(best[:-1], row[1:] + 1)
        best = np.where(there, best, far)
        best = np.minimum.accumulate(best - np.arange(width)) + np.arange(width)  # insertions
        row = np.where(there, np.minimum(best, far), far)
        if row.min() > most:
            return far
    return int(min(row[len(b) - len(a) + most], far))


@dataclass
class GramIndex:
    """Where each q-gram of a block of benchmark items stands; a bitmap says quickly that one stands nowhere."""

    items: list[object]
    texts: list[np.ndarray]
    need: np.ndarray
    edits: np.ndarray
    least: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    item_of: np.ndarray
    offset: np.ndarray
    bitmap: np.ndarray
    shift: int


def _measures(length: int, error: float, least_chars: int, share: float) -> tuple[int, int]:
    """How many characters of an item of ``length`` a leak covers at least, and the edits that the whole item may have."""
    return min(length, max(least_chars, int(share * length))), int(error * length)


def _allowed(length: int, edits: int, n: np.ndarray | int) -> np.ndarray | int:
    """The edits that a part of ``n`` characters may have."""
    return -(-edits * n // max(1, length))


def gram_length(length: int, *, q: int, error: float, least_chars: int, share: float) -> int:
    """The longest q-gram, of ``q`` at most, of which every part that is a leak shares one with the text."""
    need, edits = _measures(length, error, least_chars, share)
    n = np.arange(max(1, need), length + 1)
    return int(min(q, *(n // (_allowed(length, edits, n) + 1)))) if len(n) else q


def build_index(items: list[tuple[object, str]], *, q: int, error: float, least_chars: int, share: float) -> GramIndex:
    table = _fold_table()
    texts = [fold(t or "", table) for _, t in items]
    # A leak covers so many characters of its item, with so many edits.
    need, edits = np.array([_measures(len(t), error, least_chars, share) for t in texts], np.int64).reshape(-1, 2).T
    parts = [np.arange(k, len(t) + 1) for t, k in zip(texts, need, strict=True)]
    least = np.array([max(1, (n + 1 - q * (_allowed(len(t), int(e), n) + 1)).min()) for t, e, n in zip(texts, edits, parts, strict=True)], np.int64)
    hashes = [gram_hashes(t, q) for t in texts]
    h = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    item = np.repeat(np.arange(len(texts)), [len(x) for x in hashes]) if hashes else np.empty(0, np.int64)
    offset = np.concatenate([np.arange(len(x)) for x in hashes]) if hashes else np.empty(0, np.int64)
    order = np.argsort(h, kind="stable")
    grams, first = np.unique(h[order], return_index=True)
    bits = max(16, min(26, int(len(grams) * 32).bit_length()))
    bitmap = np.zeros(1 << bits, bool)
    bitmap[(grams >> np.uint64(64 - bits)).astype(np.int64)] = True
    ids = [i for i, _ in items]
    return GramIndex(ids, texts, need, edits, least, grams, np.append(first, len(h)), item[order], offset[order], bitmap, 64 - bits)


def find_leaks(texts: list[np.ndarray], index: GramIndex, q: int, most_pairs: int = 1 << 21) -> list[tuple[int, int, int, int, int]]:
    """(text, item, start, end, edits) of verified regions, in folded characters; at most one per text and item.

    At most about ``most_pairs`` pairs of a place in a text and one in an item are held at once. A text and an item that
    alone have more (long runs of one letter) are not paired: all bands of the text are verified instead.
    """
    joined, starts = _joined(texts, q)
    at, place = _known_grams(joined, index, q)
    if not len(at):
        return []
    text = np.searchsorted(starts, at, side="right") - 1
    pos, times = at - starts[text], index.first[place + 1] - index.first[place]
    begin = np.flatnonzero(np.concatenate([[True], np.diff(text) != 0]))
    sizes, ends = np.add.reduceat(times, begin), np.append(begin[1:], len(text))
    found: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    low = 0
    for k in range(len(begin)):
        if sizes[k] > most_pairs:
            _find_in_one(texts, int(text[begin[k]]), pos[begin[k] : ends[k]], place[begin[k] : ends[k]], index, q, most_pairs, found)
            low = k + 1
        elif k + 1 == len(begin) or sizes[low : k + 2].sum() > most_pairs:
            some = slice(begin[low], ends[k])
            row, item, offset = _postings(place[some], index)
            _verify(texts, text[some][row], item, pos[some][row], offset, index, q, found)
            low = k + 1
    return list(found.values())


def _joined(texts: list[np.ndarray], q: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts after one another, and where each begins; no q-gram reaches from one into the next unnoticed."""
    lengths = np.array([len(t) for t in texts], np.int64)
    gap = np.zeros(q, np.uint32)
    joined = np.concatenate([gap, *(x for t in texts for x in (t, gap))])
    return joined, q + np.concatenate([[0], np.cumsum(lengths + q)[:-1]])


def _known_grams(joined: np.ndarray, index: GramIndex, q: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the q-grams that the index has, and the numbers of those grams."""
    h = gram_hashes(joined, q)
    at = np.flatnonzero(index.bitmap[(h >> np.uint64(index.shift)).astype(np.int64)])
    place = np.minimum(np.searchsorted(index.grams, h[at]), len(index.grams) - 1)
    real = index.grams[place] == h[at] if len(at) else np.zeros(0, bool)
    return at[real], place[real]


def _postings(place: np.ndarray, index: GramIndex) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of ``place``, item, offset) of every posting of the grams."""
    times = index.first[place + 1] - index.first[place]
    posting = np.repeat(index.first[place] - np.concatenate([[0], np.cumsum(times)[:-1]]), times) + np.arange(times.sum())
    return np.repeat(np.arange(len(place)), times), index.item_of[posting], index.offset[posting]


def _find_in_one(texts: list[np.ndarray], t: int, pos: np.ndarray, place: np.ndarray, index: GramIndex, q: int, most_pairs: int, found: dict) -> None:
    """Leaks into one text with very many pairs: ranges of items in turn, and items with too many by bands alone."""
    cuts = np.flatnonzero(np.diff(np.cumsum(index.first[place + 1] - index.first[place]) // most_pairs)) + 1
    chunks = np.split(np.arange(len(place)), cuts)
    n = np.zeros(len(index.texts), np.int64)
    for c in chunks:
        n += np.bincount(_postings(place[c], index)[1], minlength=len(n))
    for item in np.flatnonzero(n > most_pairs):
        half = int(index.edits[item]) + 1
        for low in range(-len(index.texts[item]), len(texts[t]), half):
            part = leaked_part(index.texts[item], texts[t], int(index.need[item]), int(index.edits[item]), low, low + 2 * half - 1)
            if part:
                found[t, int(item)] = (t, int(item), *part)
                break
    light = np.flatnonzero((n > 0) & (n <= most_pairs))
    for some in np.split(light, np.flatnonzero(np.diff(np.cumsum(n[light]) // most_pairs)) + 1):
        kept: list[tuple[np.ndarray, ...]] = []
        for c in chunks:
            row, item, offset = _postings(place[c], index)
            mine = np.isin(item, some)
            kept.append((item[mine], pos[c][row[mine]], offset[mine]))
        item, where, offset = (np.concatenate(x) for x in zip(*kept, strict=True))
        _verify(texts, np.full(len(item), t), item, where, offset, index, q, found)


def _verify(texts: list[np.ndarray], text: np.ndarray, item: np.ndarray, pos: np.ndarray, offset: np.ndarray, index: GramIndex, q: int, found: dict) -> None:
    """Put the leaks among all hits of some texts and items into ``found``."""
    # Overlapping bands: each diagonal lies in two, so any run of diagonals of up to a band's half lies whole in one.
    half = index.edits[item] + 1
    band = (pos - offset + (1 << 40)) // half
    text, item, pos, offset = (np.concatenate([x, x]) for x in (text, item, pos, offset))
    band = np.concatenate([band, band + 1])
    order = np.lexsort((offset, pos, band, item, text))
    t, i, d, p, o = text[order], item[order], band[order], pos[order], offset[order]
    first = np.flatnonzero(np.concatenate([[True], (np.diff(t) != 0) | (np.diff(i) != 0) | (np.diff(d) != 0)])) if len(t) else np.empty(0, np.int64)
    last = np.append(first[1:], len(order))
    full = last - first >= index.least[i[first]]
    for s, e in zip(first[full], last[full], strict=True):
        key = (int(t[s]), int(i[s]))
        if key in found:
            continue
        whole, there, need, edits = index.texts[key[1]], texts[key[0]], int(index.need[key[1]]), int(index.edits[key[1]])
        ps, pe, os, oe = int(p[s]), int(p[e - 1]) + q, int(o[s]), int(o[e - 1]) + q
        if oe - os >= need and pe - ps == oe - os and (there[ps:pe] == whole[os:oe]).all():
            found[key] = (*key, ps, pe, 0)
            continue
        low = (int(d[s]) - 1) * (edits + 1) - (1 << 40)
        part = leaked_part(whole, there, need, edits, low, low + 2 * edits + 1, (q, o[s:e]))
        if part:
            found[key] = (*key, *part)


def find_short(texts: list[np.ndarray], index: GramIndex, size: int) -> list[tuple[int, int, int, int, int]]:
    """As ``find_leaks`` for items of ``size`` characters, too few for edits: the whole item, as words of the text."""
    joined, starts = _joined(texts, size)
    at, place = _known_grams(joined, index, size)
    parted = (joined == 32) | (joined == 0)
    whole = parted[at - 1] & parted[at + size] if len(at) else np.zeros(0, bool)
    at, place = at[whole], place[whole]
    text = np.searchsorted(starts, at, side="right") - 1
    _, one = np.unique(np.stack([text, place]), axis=1, return_index=True)
    row, item, _ = _postings(place[one], index)
    begin = (at - starts[text])[one][row]
    return [(int(t), int(i), int(b), int(b) + size, 0) for t, i, b in zip(text[one][row], item, begin, strict=True)]


def leaked_part(
    item: np.ndarray, text: np.ndarray, need: int, edits: int, low: int, high: int, hits: tuple[int, np.ndarray] | None = None
) -> tuple[int, int, int] | None:
    """(start, end, edits) in ``text`` of a part of ``item`` of ``need`` characters or more with few enough edits.

    Diagonals ``low`` to ``high`` are searched; ``hits`` are a gram length and the offsets in the item of the grams that
    stand there. Starts from which no part meets the q-gram bound, by these and by grams of ``FINE`` characters, are
    left out; the others are aligned, up to 256 at once, each with a free start in the text.
    """
    n, width = len(item), high - low + 1
    allowed = np.asarray(_allowed(n, edits, np.arange(n + 1)))
    begin = np.arange(n - need + 1)
    if hits is not None:
        begin = _starts(n, need, hits[0], hits[1], allowed)
    if len(begin) and n >= FINE:
        own = gram_hashes(item, FINE)
        window = np.full(len(own) + width - 1 + FINE - 1, NOWHERE, np.uint32)  # the text from position ``low`` on
        a, b = max(0, low), min(len(text), low + len(window))
        window[a - low : max(a, b) - low] = text[a : max(a, b)]
        same = np.lib.stride_tricks.sliding_window_view(gram_hashes(window, FINE), width) == own[:, None]
        begin = np.intersect1d(begin, _starts(n, need, FINE, np.flatnonzero(same.any(axis=1)), allowed))
    # Most leaks show from one of their first starts; aligning all at once would cost each of them a row.
    done, size = 0, 1
    while done < len(begin):
        found = _aligned(item, text, need, edits, low, width, begin[done : done + size], allowed)
        if found:
            return found
        done, size = done + size, min(256, size * 4)
    return None


def _aligned(item: np.ndarray, text: np.ndarray, need: int, edits: int, low: int, width: int, begin: np.ndarray, allowed: np.ndarray) -> tuple[int, int, int] | None:
    """``leaked_part`` for parts that begin at ``begin``, over ``width`` diagonals from ``low`` on."""
    n, far = len(item), edits + 1
    steps = np.arange(width, dtype=np.int32)
    rows = np.full((len(begin), width), far, np.int32)
    padded = np.full(n + width + 1, -1, np.int64)  # the text from position ``low`` on
    there = np.arange(low, low + len(padded))
    inside = (there >= 0) & (there < len(text))
    padded[inside] = text[there[inside]]
    place = (there >= 0) & (there <= len(text))
    for i in range(int(begin[0]), n):
        rows[begin == i] = np.where(place[i : i + width], 0, far)
        best = rows + (padded[i : i + width] != item[i])
        best[:, :-1] = np.minimum(best[:, :-1], rows[:, 1:] + 1)
        best = np.where(place[i + 1 : i + 1 + width], best, far)
        best = np.minimum.accumulate(best - steps, axis=1) + steps  # insertions
        rows = np.where(place[i + 1 : i + 1 + width], np.minimum(best, far), far)
        rows[begin > i] = far
        live = (begin > i) | (rows.min(axis=1) <= allowed[n - begin])
        if not live.all():
            begin, rows = begin[live], rows[live]
            if not len(begin):
                return None
        ready = np.flatnonzero(begin + need <= i + 1)
        if len(ready):
            least = rows[ready].min(axis=1)
            good = np.flatnonzero(least <= allowed[i + 1 - begin[ready]])
            if len(good):
                at, distance = ready[good[0]], int(least[good[0]])
                end = i + 1 + low + int(rows[at].argmin())
                part = item[begin[at] : i + 1]
                for start in sorted(range(max(0, end - len(part) - distance), min(end, end - len(part) + distance) + 1), key=lambda x: abs(end - len(part) - x)):
                    if edits_within(part, text[start:end], distance) <= distance:
                        return start, end, distance
    return None


def _starts(n: int, need: int, q: int, offsets: np.ndarray, allowed: np.ndarray) -> np.ndarray:
    """The starts from which some part of an item of ``n`` characters has as many hits as a leak of its length must have."""
    hits = np.zeros(n + 1, np.int64)
    hits[np.unique(offsets) + 1] = 1
    before = np.cumsum(hits)  # hits at smaller offsets
    start, length = np.arange(n - need + 1), np.arange(need, n + 1)
    end = start[:, None] + length
    have = np.where(end <= n, before[np.clip(end - q + 1, start[:, None], n)] - before[start][:, None], -1)
    return start[(have >= np.maximum(0, length + 1 - q * (allowed[length] + 1))).any(axis=1)]


class Benchmark:
    """The indexes of one block of benchmark items, by gram length; items of under ``q`` characters by their own length."""

    def __init__(self, items: list[tuple[object, str]], *, q: int, error: float, least_chars: int, share: float):
        limits = {"error": error, "least_chars": least_chars, "share": share}
        folds, by = _fold_table(), {}
        for item in items:
            length = len(fold(item[1], folds))
            if length:
                short = length < q
                by.setdefault((length if short else gram_length(length, q=q, **limits), short), []).append(item)
        self.indexes = [(k, short, build_index(some, q=k, **limits)) for (k, short), some in sorted(by.items())]

    def leaks(self, texts: list[str | None], most_chars: int = 1 << 20) -> list[list[dict]]:
        """The leaks into each text, about ``most_chars`` characters at a time."""
        table, out = _fold_table(), [[] for _ in texts]
        todo, size, base = [], 0, 0
        for i, text in enumerate(texts):
            todo.append(fold(text or "", table))
            size += len(todo[-1])
            if size > most_chars or i + 1 == len(texts):
                for k, short, index in self.indexes:
                    for t, item, start, stop, edits in (find_short if short else find_leaks)(todo, index, k):
                        out[base + t].append({"item_id": index.items[item], "start": start, "end": stop, "edits": edits})
                todo, size, base = [], 0, i + 1
        return out


def _blocks(benchmark: DataFrame, block_chars: int) -> Iterator[list[tuple[object, str]]]:
    block, size = [], 0
    for row in benchmark.select("item_id", "text").toLocalIterator():
        block.append((row["item_id"], row["text"] or ""))
        size += len(block[-1][1])
        if size >= block_chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def benchmark_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    q: int = 12,
    error: float = 0.06,
    least_chars: int = 60,
    share: float = 0.6,
    block_chars: int = 1 << 22,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, leaks) of every row: which items leak into it, and where.

    An item leaks where at least ``share`` of it, and ``least_chars`` characters (the whole item if that is shorter),
    stand in the text with at most ``error`` edits a character. Case, punctuation and white space do not matter. Items
    of fewer than ``q`` letters and digits must stand there whole and as words; items without any can't leak. A null
    text or item is empty; items with one id, or none, count each. Items of which a leak need not share a run of ``q``
    characters are searched by shorter runs. leaks: item_id, start and end in the folded text, edits; rows come in
    the order and number of ``docs``. The index of ``block_chars`` characters of benchmark is broadcast (some 200 MB at
    most); a larger benchmark is taken in blocks, between which the texts are written and read again. Nothing is shuffled.
    """
    item = benchmark.schema["item_id"].dataType
    kind = docs.schema[id_col].dataType.simpleString()
    leak = f"array<struct<item_id: {item.simpleString()}, start: long, end: long, edits: long>>"
    arrow = pa.list_(pa.struct([("item_id", to_arrow_type(item)), ("start", pa.int64()), ("end", pa.int64()), ("edits", pa.int64())]))
    out = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.lit(None).cast(leak).alias("leaks"))

    def searched(rows: DataFrame, held: Broadcast) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                more = held.value.leaks(batch["text"].to_pylist())
                leaks = [(a or []) + b for a, b in zip(batch["leaks"].to_pylist(), more, strict=True)]
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["text"], pa.array(leaks, arrow)], ["doc_id", "text", "leaks"])

        return rows.mapInArrow(each, f"doc_id {kind}, text string, leaks {leak}")

    return _by_blocks(out, benchmark, searched, block_chars, q=q, error=error, least_chars=least_chars, share=share).select("doc_id", F.coalesce("leaks", F.array().cast(leak)).alias("leaks"))


def without_leaks(
    docs: DataFrame, benchmark: DataFrame, *, q: int = 12, error: float = 0.06, least_chars: int = 60, share: float = 0.6, block_chars: int = 1 << 22, text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs``, all columns, into which no item leaks, as ``benchmark_leaks`` says it; nothing is shuffled."""

    def searched(rows: DataFrame, held: Broadcast) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in held.value.leaks(batch[text_col].to_pylist())], pa.bool_()))

        return rows.mapInArrow(each, docs.schema)

    return _by_blocks(docs, benchmark, searched, block_chars, q=q, error=error, least_chars=least_chars, share=share)


def _by_blocks(rows: DataFrame, benchmark: DataFrame, searched: Callable[[DataFrame, Broadcast], DataFrame], block_chars: int, **limits) -> DataFrame:
    spark = rows.sparkSession
    for k, block in enumerate(_blocks(benchmark, block_chars)):
        rows = write_table(rows, "searched") if k else rows  # so a worker holds the index of one block only
        rows = searched(rows, spark.sparkContext.broadcast(Benchmark(block, **limits)))
    return rows
