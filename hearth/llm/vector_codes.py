"""Vector code compression: product codes by tries over distinct parts.

Vectors of integers are cut into equal parts; every part position has a
codebook of entries. A task sorts the distinct parts of one position that it
holds; equal prefixes then lie together and form a lexicographic trie. The
trie is walked depth first, a bounded block of sister nodes at a time: a node's
vector of distances to all entries is its parent's plus the squared difference
in one dimension, so parts with a common prefix share that work. A leaf takes the smallest
distance (ties to the lower index) and adds its part, weighted by how often it
occurs, to the sums of its entry.

A training round is one pass: tasks send the sums per (part, entry, dimension), Spark adds them
up, and the driver holds only the codebooks (parts x entries x dimensions). Codes are
assigned where the rows lie; nothing but those sums and the error per label is shuffled.

Results: rows that ``vectors.integer_vectors`` drops have none. Rows with a
null id or label keep them; a null id comes last when the first codebook
is filled, equal ids are ordered by their vectors; repeated rows are rows. Fewer rows than entries make a
smaller codebook. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import stored
from hearth.llm.vectors import as_integers, exact_type, integer_vectors, longs, matrix

PARTS, ENTRIES, ROUNDS = 16, 64, 2
#: Rows that a task codes at a time, and trie nodes that are walked side by side.
ROWS, NODES = 65_536, 2_048


class Trie:
    """The distinct rows of ``parts`` in lexicographic order; ``split[i]`` is the first dimension in which
    row i differs from the one before, so the nodes of depth j + 1 begin where ``split <= j``."""

    def __init__(self, parts: np.ndarray):
        n, self.depth = parts.shape
        order = np.lexsort(parts.T[::-1]) if self.depth else np.arange(n)
        rows = parts[order]
        differs = rows[1:] != rows[:-1]
        fresh = np.concatenate([[True], differs.any(axis=1)])
        self.rows = rows[fresh]
        self.split = np.concatenate([[0], differs.argmax(axis=1)[fresh[1:]]]) if self.depth else np.zeros(1, int)
        self.leaf = np.empty(n, np.int64)
        self.leaf[order] = np.cumsum(fresh) - 1
        self.weight = np.bincount(self.leaf)

    def walk(self, entries: np.ndarray, visit: Callable[[np.ndarray, np.ndarray], None]) -> None:
        """``visit(leaves, distances)`` for blocks of leaves, distances to all entries."""
        starts = [np.flatnonzero(self.split <= j) for j in range(self.depth)]

        def descend(depth: int, nodes: np.ndarray, end: int, far: np.ndarray) -> None:
            if depth == self.depth:
                visit(nodes, far)
                return
            every = starts[depth]
            below = every[np.searchsorted(every, nodes[0]):np.searchsorted(every, end)]
            parent = np.searchsorted(nodes, below, side="right") - 1
            for i in range(0, len(below), NODES):
                block = below[i:i + NODES]
                step = self.rows[block, depth][:, None] - entries[:, depth][None, :]
                stop = below[i + NODES] if i + NODES < len(below) else end
                descend(depth + 1, block, stop, far[parent[i:i + NODES]] + step * step)

        descend(0, np.zeros(1, int), len(self.rows), np.zeros((1, len(entries)), self.rows.dtype))


def nearest(parts: np.ndarray, entries: np.ndarray) -> tuple[Trie, np.ndarray, np.ndarray]:
    """The trie of ``parts``, and each leaf's nearest entry and its distance."""
    trie = Trie(parts)
    code, far = np.empty(len(trie.rows), np.int64), np.empty(len(trie.rows), parts.dtype)

    def visit(leaves: np.ndarray, distances: np.ndarray) -> None:
        code[leaves] = distances.argmin(axis=1)
        far[leaves] = np.take_along_axis(distances, code[leaves][:, None], 1)[:, 0]

    trie.walk(entries, visit)
    return trie, code, far


def _blocks(batches: Iterator[pa.RecordBatch], rows: int = ROWS) -> Iterator[pa.Table]:
    held, n = [], 0
    for b in batches:
        held.append(b)
        n += b.num_rows
        if n >= rows:
            yield pa.Table.from_batches(held)
            held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def _integers(q: np.ndarray, books: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors (rows, parts, dimensions) and codebooks in a type that holds all distances and sums."""
    top = float(max(np.abs(q).max(initial=0), max((abs(x) for x in books.ravel()), default=0))) + 1
    kind = exact_type(max(4 * top * top * q.shape[1], top * len(q)))
    return as_integers(q, kind).reshape(len(q), books.shape[0], books.shape[2]), books.astype(kind)


def train_round(vectors: DataFrame, n: int, books: np.ndarray) -> np.ndarray:
    """Codebooks (parts, entries, dimensions) after one assignment; an entry becomes the floored mean of its parts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(books.shape, object), np.zeros(books.shape[:2], object)
        for table in _blocks(batches):
            q, own = _integers(matrix(table.column("q"), n), books)
            for p in range(books.shape[0]):
                trie, code, _ = nearest(q[:, p], own[p])
                here, many = np.zeros(own[p].shape, own.dtype), np.zeros(books.shape[1], np.int64)
                np.add.at(here, code, trie.rows * trie.weight[:, None])
                np.add.at(many, code, trie.weight)
                sums[p] += here.astype(object)
                counts[p] += many.astype(object)
        at = [(p, e) for p in range(books.shape[0]) for e in range(books.shape[1]) if counts[p, e]]
        yield pa.RecordBatch.from_pydict({
            "part": pa.array([p for p, e in at for _ in range(books.shape[2])], pa.int32()),
            "entry": pa.array([e for p, e in at for _ in range(books.shape[2])], pa.int32()),
            "position": pa.array([i for _ in at for i in range(books.shape[2])], pa.int32()),
            "many": pa.array([int(counts[p, e]) for p, e in at for _ in range(books.shape[2])], pa.int64()),
            "total": pa.array([Decimal(int(x)) for p, e in at for x in sums[p, e]], pa.decimal128(38, 0))})

    rows = vectors.select("q").mapInArrow(run, "part int, entry int, position int, many bigint, total decimal(38,0)")
    new = books.copy()
    for r in rows.groupBy("part", "entry", "position").agg(F.sum("many").alias("many"), F.sum("total").alias("total")).collect():
        new[r.part, r.entry, r.position] = int(r.total) // r.many
    return new


def first_books(vectors: DataFrame, n: int, parts: int, entries: int) -> np.ndarray:
    """The parts of the rows with the smallest ids, ascending."""
    rows = vectors.orderBy(F.asc_nulls_last("key"), "q").select("q").limit(entries).collect()
    flat = np.array([[int(x) for x in r.q] for r in rows], object).reshape(len(rows), parts, n // parts)
    return flat.transpose(1, 0, 2)


def compress(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
             entries: int = ENTRIES, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray]:
    """(row_id, key, label, code, error) per usable row, and the codebooks (parts, entries, dimensions).

    ``code`` has two hex digits per part, so ``entries`` is at most 256."""
    if not 0 < entries <= 256:
        raise ValueError("codes of two hex digits name 1 to 256 entries")
    vectors, n = integer_vectors(df, key, label, vector, multiple_of=parts)
    books = first_books(vectors, n, parts, entries)
    for _ in range(rounds if n else 0):
        books = train_round(vectors, n, books)
    digits = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _blocks(batches):
            q, own = _integers(matrix(table.column("q"), n), books)
            codes, error = np.zeros((len(q), parts), np.int64), np.zeros(len(q), own.dtype)
            for p in range(parts):
                trie, c, far = nearest(q[:, p], own[p])
                codes[:, p] = c[trie.leaf]
                error = error + far[trie.leaf]
            text = digits[codes].reshape(len(q), 2 * parts).view(f"S{2 * parts}")[:, 0].astype(str)
            yield pa.RecordBatch.from_arrays([*(table.column(c).combine_chunks() for c in ("row_id", "key", "label")),
                                              pa.array(text, pa.string()), pa.array(longs(error))], ["row_id", "key", "label", "code", "error"])

    return vectors.mapInArrow(code, "row_id bigint, key bigint, label bigint, code string, error bigint"), books


def books_text(books: np.ndarray) -> str:
    return ",".join(str(int(x)) for x in books.ravel())


def vector_codes(df: DataFrame, key: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = PARTS,
                 entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """key, code, error, label_error (errors summed over equal labels, nulls together), codebooks_sha256."""
    codes, books = compress(df, key, vector, label, parts, entries, rounds)
    codes = stored(codes, "vector-codes")
    by_label = stored(codes.groupBy(F.col("label").alias("l")).agg(F.sum("error").alias("label_error")), "label-errors")
    return codes.join(by_label, F.col("label").eqNullSafe(F.col("l"))).select(
        F.col("key").alias(key), "code", "error", "label_error",
        F.lit(hashlib.sha256(books_text(books).encode()).hexdigest()).alias("codebooks_sha256"))


def decode(codes: list[str], books: np.ndarray) -> np.ndarray:
    """The vectors that code strings stand for."""
    at = np.array([[int(c[i:i + 2], 16) for i in range(0, len(c), 2)] for c in codes]).reshape(len(codes), books.shape[0])
    return books[np.arange(books.shape[0]), at].reshape(len(codes), -1)
