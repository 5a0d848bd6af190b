"""Byte-level BPE by prefix dynamic programming.

For every byte prefix of a piece there is exactly one token that can end its encoding: the token that reaches back to a
shorter prefix whose own last token may stand before it. The table of these last tokens gives the encoding of every
prefix by walking back, grows by appending bytes without touching what it holds, and is recomputed after an edit only
from the edited byte on until it is what it was.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64, then the rank), by rank. Read on the driver."""
    with open(path, "rb") as file:
        pairs = [line.split() for line in file if line.strip()]
    tokens: list[bytes] = [b""] * len(pairs)
    for token, rank in pairs:
        tokens[int(rank)] = base64.b64decode(token)
    return tokens


class Vocabulary:
    """Tokens by rank, how each was merged, and which two may stand side by side."""

    def __init__(self, tokens: list[bytes], most: int = 300_000):
        self.tokens, self.most = tokens, most
        self.ranks = {t: i for i, t in enumerate(tokens)}
        self.sizes = [*map(len, tokens)]
        self.longest = max(self.sizes)
        self.halves: list[tuple[int, int] | None] = [self._halves(t) for t in tokens]
        self.merged = {pair: i for i, pair in enumerate(self.halves) if pair}
        self.known: dict[int, bool] = {}
        self.wide = len(tokens)

    def _halves(self, token: bytes) -> tuple[int, int] | None:
        """The two tokens of the last merge that makes ``token``; None for single bytes."""
        if len(token) < 2:
            return None
        limit, parts = self.ranks[token], [token[i : i + 1] for i in range(len(token))]
        while len(parts) > 2:
            ranked = [(self.ranks.get(parts[i] + parts[i + 1], limit), i) for i in range(len(parts) - 1)]
            rank, i = min(ranked)
            if rank >= limit:
                return None  # no merges lead to it, so it never arises
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return self.ranks[parts[0]], self.ranks[parts[1]]

    def arises(self, token: int) -> bool:
        return len(self.tokens[token]) == 1 or self.halves[token] is not None

    def beside(self, left: int, right: int) -> bool:
        """Whether the bytes of both tokens together are encoded as just these two.

        Merges are undone from the latest one back. At each moment the tokens that touch the border are known; had
        they a merge of their own that comes before the one undone last, it would have crossed the border.
        """
        if len(self.known) > self.most:
            self.known.clear()
        found = self.known[left * self.wide + right] = self._unmerge(left, right)
        return found

    def _unmerge(self, left: int, right: int) -> bool:
        # A merge is at (rank, side): of equal ranks the left one comes first.
        bound = len(self.tokens) * 2
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and 2 * crossing < bound:
                return False
            a, b = self.halves[left], self.halves[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                bound, left = 2 * left, a[1]
            else:
                bound, right = 2 * right + 1, b[0]


def extend(v: Vocabulary, piece: bytes, last: list[int], at: int) -> None:
    """Append to ``last`` the last tokens of the prefixes of ``piece`` beyond ``at`` bytes."""
    ranks, met, beside, longest, wide = v.ranks.get, v.known.get, v.beside, v.longest, v.wide
    for end in range(at + 1, len(piece) + 1):
        for start in range(end - 1, max(0, end - longest) - 1, -1):
            token = ranks(piece[start:end])
            if token is None:
                continue
            if start:
                fits = met(last[start] * wide + token)
                if fits is None:
                    fits = beside(last[start], token)
            else:
                fits = v.arises(token)
            if fits:
                last.append(token)
                break
        else:
            raise ValueError("the vocabulary lacks a byte")


def walk_back(v: Vocabulary, last: list[int], end: int) -> list[int]:
    """The encoding of the first ``end`` bytes."""
    sizes, out = v.sizes, []
    while end:
        token = last[end]
        out.append(token)
        end -= sizes[token]
    return out[::-1]


class PrefixTable:
    """The last token of every byte prefix of one piece."""

    def __init__(self, vocabulary: Vocabulary, piece: bytes = b""):
        self.vocabulary, self.piece, self.last = vocabulary, b"", [-1]
        self.append(piece)

    def append(self, more: bytes) -> None:
        at = len(self.piece)
        self.piece = self.piece + more
        extend(self.vocabulary, self.piece, self.last, at)

    def replace(self, start: int, end: int, new: bytes) -> int:
        """Put ``new`` in the place of bytes start to end; returns how many last tokens were found anew.

        Prefixes up to ``start`` stay as they are. A last token depends on the bytes and last tokens that the longest
        token spans, so once as many beyond the edit are what they were, all further ones are too.
        """
        rest, old, longest = self.piece[end:], self.last, self.vocabulary.longest
        self.piece, self.last = self.piece[:start] + new + rest, old[: start + 1]
        moved, begin = start + len(new) - end, start + len(new)
        while len(self.last) <= len(self.piece):
            at = len(self.last) - 1
            extend(self.vocabulary, self.piece[: at + longest], self.last, at)
            size = len(self.last)
            if size - longest > begin and self.last[-longest:] == old[size - longest - moved : size - moved]:
                self.last += old[size - moved :]
                return size - 1 - start
        return len(self.piece) - start

    def tokens(self, end: int | None = None) -> list[int]:
        """The encoding of the first ``end`` bytes."""
        return walk_back(self.vocabulary, self.last, len(self.piece) if end is None else end)


class Encoder:
    """Encodes texts piece by piece. Pieces met before are remembered in two generations of up to ``most`` each."""

    def __init__(self, tokens: list[bytes], pattern: str, most: int = 120_000):
        self.vocabulary, self.pattern = Vocabulary(tokens), regex.compile(pattern)
        self.most, self.known, self.older = most, {}, {}

    def _piece(self, piece: str) -> tuple[int, ...]:
        found = self.older.get(piece)
        if found is None:
            raw = piece.encode("utf-8")
            rank = self.vocabulary.ranks.get(raw)
            if rank is not None:
                found = (rank,)
            else:
                last = [-1]
                extend(self.vocabulary, raw, last, 0)
                found = tuple(walk_back(self.vocabulary, last, len(raw)))
        if len(piece) <= 32:
            if len(self.known) >= self.most:
                self.known, self.older = {}, self.known
            self.known[piece] = found
        return found

    def encode(self, text: str) -> list[int]:
        piece, out = self._piece, []
        for p in self.pattern.findall(text):
            out += self.known.get(p) or piece(p)
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        return b"".join(map(self.vocabulary.tokens.__getitem__, ids))


def encode_texts(docs: DataFrame, *, ranks_path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text", ids: bool = False) -> DataFrame:
    """Token ids of each whole text, decoded again.

    Returns doc_id, n_tokens, ids_sha256 (of the decimal ids, joined by a space), decoded_sha256 (of the decoded bytes),
    and with ``ids`` the ids and the decoded text too. A null or empty text has no tokens. A row is kept for each row,
    in the same partition; nothing is shuffled.
    """
    held = docs.sparkSession.sparkContext.broadcast(Encoder(read_ranks(ranks_path), pattern))  # built once, some 10 MB
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if ids else "")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = held.value
        decimal = [str(i) for i in range(len(encoder.vocabulary.tokens))].__getitem__
        for batch in batches:
            n, ids_hash, decoded_hash, all_ids, texts = [], [], [], [], []
            for text in batch["text"]:
                found = encoder.encode(text.as_py() or "")
                back = encoder.decode(found)
                n.append(len(found))
                ids_hash.append(hashlib.sha256(" ".join(map(decimal, found)).encode()).hexdigest())
                decoded_hash.append(hashlib.sha256(back).hexdigest())
                if ids:
                    all_ids.append(found)
                    texts.append(back.decode("utf-8", "replace"))
            columns = [batch["doc_id"], pa.array(n, pa.int64()), pa.array(ids_hash, pa.string()), pa.array(decoded_hash, pa.string())]
            columns += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(texts, pa.string())] if ids else []
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names[: len(columns)])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(each, schema)
