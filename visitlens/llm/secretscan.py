"""Secret scanning with inferred grammars.

Strict patterns give the base spans. Their credentials, by kind, are strings over character classes; a prefix tree of
them is merged, state by state, wherever Hoeffding's bound finds the states' outcomes compatible, into a probabilistic
automaton. Every other run of credential characters in a text is then scored: its format must be as likely under an
automaton as that of held-out credentials, and far likelier than under a bigram model of the other runs of the corpus.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import write_table

KINDS = ["assign", "access", "hex"]
#: The base patterns. A run of one class is matched whole, so a minimum length equals a later test of it.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS, HEX = re.compile(r"AKIA[A-Z0-9]{16,}"), re.compile(r"[0-9a-f]{24,}")
NAMES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: A candidate is a run of these characters, by class: d digit, h a-f, l g-z, U upper case; others stand for themselves.
CLASSES = bytes(
    ord("d" if "0" <= c <= "9" else "h" if "a" <= c <= "f" else "l" if "g" <= c <= "z" else "U" if "A" <= c <= "Z" else c) if c in "+/_.=-" or (c.isalnum() and i < 128) else 0
    for i, c in enumerate(map(chr, range(256)))
)
RUN, TEXT_RUN, JOINTS = re.compile(rb"[dhlU+/_.=-]{6,}"), re.compile("[A-Za-z0-9+/_.=-]{6,}"), re.compile("[^.=/]{6,}")
LEAST = 6


def symbols(token: str) -> str:
    return token.encode("ascii", "replace").translate(CLASSES).decode("ascii")


def runs(text: str) -> list[bytes]:
    """The classes of every run of ``LEAST`` credential characters or more."""
    return RUN.findall(text.encode("utf-8", "surrogatepass").translate(CLASSES))


def base_spans(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, credential), sorted by start, then kind as listed."""
    found = []
    low = text.lower()
    if any(n in low for n in NAMES):
        found += [(m.start(), m.end(), "assign", m[2]) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), m.end(), "access", m[0]) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), "hex", m[0]) for m in HEX.finditer(text)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


@dataclass
class Automaton:
    """Per state how many strings end there, and the count and target of each symbol."""

    ends: list[int] = field(default_factory=lambda: [0])
    moves: list[dict[str, tuple[int, int]]] = field(default_factory=lambda: [{}])
    least: float = 0.0

    def score(self, text: str) -> float:
        """Log probability of the symbols and the end; minus infinity where the format has no such string."""
        state, total = 0, 0.0
        for c in text:
            move = self.moves[state].get(c)
            if move is None:
                return -math.inf
            total += math.log(move[0] / self._total(state))
            state = move[1]
        end = self.ends[state]
        return total + math.log(end / self._total(state)) if end else -math.inf

    def _total(self, state: int) -> int:
        return self.ends[state] + sum(n for n, _ in self.moves[state].values())


def infer(strings: list[str], alpha: float = 0.05) -> Automaton:
    """Merge compatible states of the prefix tree of ``strings`` (symbols), from the root outwards."""
    a = Automaton()
    for s in strings:
        state = 0
        for c in s:
            n, to = a.moves[state].get(c, (0, len(a.moves)))
            if n == 0:
                a.moves.append({})
                a.ends.append(0)
            a.moves[state][c] = (n + 1, to)
            state = to
        a.ends[state] += 1
    width = math.sqrt(0.5 * math.log(2 / alpha))

    def differ(f1: int, n1: int, f2: int, n2: int) -> bool:
        return bool(n1 and n2) and abs(f1 / n1 - f2 / n2) > width * (1 / math.sqrt(n1) + 1 / math.sqrt(n2))

    def compatible(x: int, y: int) -> bool:
        todo = [(x, y)]
        while todo:
            p, q = todo.pop()
            n1, n2 = a._total(p), a._total(q)
            if differ(a.ends[p], n1, a.ends[q], n2):
                return False
            for c in a.moves[p].keys() | a.moves[q].keys():
                m1, m2 = a.moves[p].get(c), a.moves[q].get(c)
                if differ(m1[0] if m1 else 0, n1, m2[0] if m2 else 0, n2):
                    return False
                if m1 and m2 and m1[1] != m2[1]:
                    todo.append((m1[1], m2[1]))
        return True

    def fold(x: int, y: int) -> None:
        todo = [(x, y)]
        while todo:
            p, q = todo.pop()
            a.ends[p] += a.ends[q]
            for c, (n, to) in a.moves[q].items():
                if c in a.moves[p]:
                    m, there = a.moves[p][c]
                    a.moves[p][c] = (m + n, there)
                    if there != to:
                        todo.append((there, to))
                else:
                    a.moves[p][c] = (n, to)
            a.moves[q], a.ends[q] = {}, 0

    red, seen = [0], {0}
    while True:
        blue = next(((s, c, to) for s in red for c, (_, to) in sorted(a.moves[s].items()) if to not in seen), None)
        if blue is None:
            break
        s, c, to = blue
        for r in red:
            if compatible(r, to):
                a.moves[s][c] = (a.moves[s][c][0], r)
                fold(r, to)
                break
        else:
            red.append(to)
            seen.add(to)
    return a


@dataclass
class Formats:
    """An automaton for each kind, the log probabilities of symbol pairs in runs, and the least log ratio of both."""

    automata: dict[str, Automaton]
    pairs: dict[str, float]
    least_ratio: float
    met: dict[str, tuple[tuple[int, int, str], ...]] = field(default_factory=dict)

    def usual(self, text: str) -> float:
        """The log probability of symbols as a run like any other."""
        return sum(map(self.pairs.__getitem__, map("".join, zip("^" + text, text + "$", strict=True))))

    def kind(self, text: str) -> str | None:
        """The likeliest kind whose format has these symbols."""
        scores = {k: a.score(text) for k, a in self.automata.items()}
        usual = self.usual(text)
        fits = [(x, k) for k, x in scores.items() if x / (len(text) + 1) >= self.automata[k].least and x - usual >= self.least_ratio]
        return max(fits)[1] if fits else None

    def hits(self, run: str) -> tuple[tuple[int, int, str], ...]:
        """(start, end, kind) in a run: the run without full stops at its end, else its parts between ``.``, ``=`` and ``/``."""
        found = self.met.get(run)
        if found is None:
            text = run.rstrip(".")
            kind = self.kind(text) if len(text) >= LEAST else None
            parts = [(0, len(text), kind)] if kind else [(m.start(), m.end(), self.kind(m[0])) for m in JOINTS.finditer(text) if len(m[0]) < len(run)]
            found = tuple(x for x in parts if x[2])
            if len(self.met) > 100_000:
                self.met.clear()
            if len(run) <= 64:
                self.met[run] = found
        return found


def fit_automata(docs: DataFrame, *, fit_rows: int = 1500, fit_chars: int = 200_000, quantile: float = 0.02, least_ratio: float = 16.0) -> Formats:
    """Formats from at most ``fit_rows`` distinct credentials of each kind, by the order of a hash.

    A credential that would take them beyond ``fit_chars`` characters is left out. A fifth of them sets the least mean
    log probability of a symbol: the ``quantile`` of theirs. Kinds with fewer than 20 get no automaton. Pairs of symbols
    are counted in all runs of all texts outside base spans; a run is taken if it is ``exp(least_ratio)`` times likelier as a credential.
    """

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, seen = Counter(), Counter()
            for text in (t.as_py() or "" for t in batch["text"]):
                base = base_spans(text)
                rows.update((k, c) for *_, k, c in base if len(c) <= fit_chars)
                ends = accumulate((e for _, e, *_ in base), max, initial=0)  # base spans come by start; some overlap
                apart = " ".join(text[e:s] for e, s in zip(ends, [*(s for s, *_ in base), len(text)], strict=True)) if base else text
                seen.update(runs(apart))
            for run, n in seen.items():
                text = run.decode("ascii")
                for pair in map("".join, zip("^" + text, text + "$", strict=True)):
                    rows["", pair] += n
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.string()), pa.array([c for _, c in rows], pa.string()), pa.array(rows.values(), pa.int64())], ["kind", "token", "n"])

    tokens = write_table(docs.select("text").mapInArrow(each, "kind string, token string, n long").groupBy("kind", "token").agg(F.sum("n").alias("n")), "secret-tokens")
    pairs = {r["token"]: r["n"] for r in tokens.where("kind = ''").collect()}  # 12 * 12 at most
    signs = "dhlU+/_.=-"
    usual = {}
    for a in "^" + signs:
        total = sum(pairs.get(a + b, 0) for b in signs + "$") + len(signs) + 1
        usual |= {a + b: math.log((pairs.get(a + b, 0) + 1) / total) for b in signs + "$"}
    out = {}
    for kind in KINDS:
        some, size = [], 0
        for r in tokens.where(F.col("kind") == kind).orderBy(F.xxhash64("token"), "token").limit(fit_rows).toLocalIterator():
            if size + len(r["token"]) <= fit_chars:
                some.append(symbols(r["token"]))
                size += len(r["token"])
        if len(some) < 20:
            continue
        held, rest = some[: len(some) // 5], some[len(some) // 5 :]
        automaton = infer(rest)
        scores = sorted(s for s in (automaton.score(t) / (len(t) + 1) for t in held) if s > -math.inf)
        if scores:
            automaton.least = scores[int(quantile * len(scores))]
            out[kind] = automaton
    return Formats(out, usual, least_ratio)


def added_spans(text: str, base: list[tuple[int, int, str, str]], formats: Formats) -> list[tuple[int, int, str]]:
    """Runs of a learned format, apart from base spans; of the kinds that fit the likeliest."""
    if not formats.automata or not any(formats.hits(r.decode("ascii")) for r in runs(text)):
        return []
    found = [(m.start() + s, m.start() + e, k) for m in TEXT_RUN.finditer(text) for s, e, k in formats.hits(symbols(m[0]))]
    starts, ends = [a for a, *_ in base], list(accumulate((b for _, b, *_ in base), max, initial=0))
    return [(s, e, k) for s, e, k in found if ends[bisect_left(starts, e)] <= s]


def scan_secrets(docs: DataFrame, formats: Formats, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and added (arrays of kind, start, end) of every row; code points, end exclusive.

    Every run of six or more credential characters is scored, whatever its length. Arrays are sorted by start, then kind
    as listed. A null text is empty. Nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(formats)
    kind = docs.schema[id_col].dataType.simpleString()
    span = "array<struct<kind: string, start: long, end: long>>"
    arrow = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, added = [], []
            for t in batch["text"]:
                text = t.as_py() or ""
                spans = base_spans(text)
                base.append([{"kind": k, "start": s, "end": e} for s, e, k, _ in spans])
                added.append([{"kind": k, "start": s, "end": e} for s, e, k in added_spans(text, spans, held.value)])
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(base, arrow), pa.array(added, arrow)], ["doc_id", "base", "added"])

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(each, f"doc_id {kind}, base {span}, added {span}")
