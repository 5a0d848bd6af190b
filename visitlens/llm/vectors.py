"""Integer vectors in bounded blocks: what the exact searches over embeddings share.

Rows are dealt to cells (the nearest of a bounded number of centres), ordered by cell and cut into blocks of a bounded
number of rows, each one row of a table with its vectors, ids and a tree of its own. Queries are cut into groups alike.
A search joins those (group, block) pairs that the bounds of cells leave, so a task holds one group and one block at a
time, however many rows a cell has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import drawn, write_table

#: Below every score that a pair can have.
NEVER = -(1 << 63)


def integer_vectors(df: DataFrame, id_col: str, vector_col: str, *more: str, scale: int = 256) -> DataFrame:
    """id, the columns ``more`` and vec: floor(scale * x) of each component as a double; rows whose vector or id is null,
    or whose vector holds a null or non-finite component, are left out."""
    x = F.col(vector_col).cast("array<double>")
    finite = F.forall(x, lambda c: F.coalesce(F.abs(c) < F.lit(float("inf")), F.lit(False)))
    kept = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & finite)
    return kept.select(F.col(id_col).cast("long").alias("id"), *more, F.transform(x, lambda c: F.floor(c * scale)).alias("vec"))


def padded(rows: list, width: int = 0) -> np.ndarray:
    """Rows of integers as one matrix; a shorter row ends with zeros."""
    found = np.zeros((len(rows), max([width, *map(len, rows)])), np.int64)
    for i, row in enumerate(rows):
        found[i, : len(row)] = row
    return found


def pack(matrix: np.ndarray) -> bytes:
    """The integers in as few bytes each as they need: how many, the rows, the width, the values."""
    top = max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)) - 1)
    size = 2 if top < 1 << 15 else 4 if top < 1 << 31 else 8
    return np.array([size, *matrix.shape], "<i4").tobytes() + matrix.astype(f"<i{size}").tobytes()


#: Bytes before the values.
HEAD = 12


def unpack(data: bytes) -> np.ndarray:
    size, rows, width = np.frombuffer(data, "<i4", 3)
    return np.frombuffer(data, f"<i{size}", offset=HEAD).reshape(rows, width)


def unpack_rows(rows: list[bytes]) -> np.ndarray:
    """Rows that were packed one by one, as one matrix."""
    if len({r[:HEAD] for r in rows}) == 1:
        return np.frombuffer(b"".join(r[HEAD:] for r in rows), f"<i{rows[0][0]}").reshape(len(rows), -1 if len(rows[0]) > HEAD else 0).astype(np.int64)
    return padded([unpack(r)[0] for r in rows])


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    w = max(a.shape[1], b.shape[1])
    return tuple(m if m.shape[1] == w else np.pad(m, ((0, 0), (0, w - m.shape[1]))) for m in (a, b))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """All inner products of two sets of integer rows, exactly; raises where one could leave 64 bits."""
    a, b = same_width(a, b)
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if top < 1 << 52:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    if top < 1 << 62:
        return a.astype(np.int64) @ b.astype(np.int64).T
    raise OverflowError("inner products of these vectors don't fit in 64 bits")


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of two sets of rows."""
    a, b = (m.astype(np.float64) for m in same_width(a, b))
    square = (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def sample(rows: DataFrame, most: int, n_rows: int) -> np.ndarray:
    """At most ``most`` vectors of about four times as many that a hash of the id draws; all of so few rows."""
    found = drawn(rows.select("id", "vec"), F.xxhash64("id"), most, n_rows).orderBy(F.xxhash64("id"), "id", "vec").limit(most).collect()
    return padded([r["vec"] for r in found])


def dealt(rows: DataFrame, centres: np.ndarray, name: str) -> DataFrame:
    """A written table (id, label, cell, vec packed) of ``rows`` (id, label, vec); the cell is the nearest centre."""

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors = padded(b.column("vec").to_pylist())
            near = distances(vectors, centres).argmin(1) if len(vectors) else []
            cells = pa.array(near, pa.int32())
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), cells, pa.array([pack(v[None]) for v in vectors], pa.binary())], ["id", "label", "cell", "vec"])

    return write_table(rows.select("id", F.col("label").cast("long").alias("label"), "vec").mapInArrow(deal, "id long, label long, cell int, vec binary"), name)


def blocks(rows: DataFrame, n_rows: int, size: int, build: Callable[[np.ndarray, np.ndarray, np.ndarray, int], dict[str, object]], schema: str, name: str) -> DataFrame:
    """A written table of blocks (block, cell and what ``build`` returns) of at most ``size`` rows of one cell.

    ``build`` takes ids, labels (a null one as NEVER), vectors and the cell. Rows are ordered by cell and dealt by range,
    a hot cell to many tasks.
    """
    fields = [f.strip().split(" ")[0] for f in schema.split(",")]
    full = f"block long, cell int, {schema}"
    types = rows.sparkSession.createDataFrame([], full).schema

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_schema

        shape, base, made, held = to_arrow_schema(types), TaskContext.get().partitionId() << 32, 0, []

        def close() -> pa.RecordBatch:
            ids, labels, cells, vectors = zip(*held, strict=True)
            found = build(np.array(ids, np.int64), np.array([NEVER if x is None else x for x in labels], np.int64), unpack_rows(list(vectors)), cells[0])
            values = [base + made, cells[0], *(found[f] for f in fields)]
            return pa.RecordBatch.from_arrays([pa.array([v], t.type) for v, t in zip(values, shape, strict=True)], schema=shape)

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("id", "label", "cell", "vec")), strict=True):
                if held and (len(held) == size or row[2] != held[0][2]):
                    yield close()
                    made, held = made + 1, []
                held.append(row)
        if held:
            yield close()

    tasks = max(1, -(-n_rows // (2 * size)))
    order = ["cell", F.xxhash64("id"), "id", "label", "vec"]
    return write_table(rows.repartitionByRange(tasks, *order).sortWithinPartitions(*order).mapInArrow(cut, full), name)


def searched(units: DataFrame, groups: DataFrame, data: DataFrame, search: Callable[..., Iterator[pa.RecordBatch]], schema: str, name: str) -> DataFrame:
    """A written table of what ``search`` finds in the pairs ``units`` (group, block) of groups and blocks.

    A pair's row carries its group and its block, at most some hundred KB each; groups are moved to the blocks.
    """
    n = units.count()
    parallel = units.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, min(n, max(2 * parallel, n // 64)))
    paired = units.join(groups, "group").repartition(tasks, "block").join(data, "block")
    return write_table(paired.mapInArrow(search, schema), name)
