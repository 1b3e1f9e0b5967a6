"""Hard-negative mining by exact tile products.

Vectors are rows of integers. Anchors (a stated query set) meet all rows in
blocks: a bounded wave of anchors is broadcast, and every task multiplies it with the
tiles of rows that it reads. A tile product runs by Strassen's recursion on int64 tiles: halves
in all three dimensions, odd sizes padded with zeros, seven products in place
of eight, exact additions; small tiles are multiplied directly. Integer sums wrap modulo 2^64 inside and come out exact,
because the final scores are proved to fit (else Python integers are used).

Two passes per wave. The first keeps, per anchor, a heap of the best
rows of its own label (its positives); the second keeps, per anchor and positive, a heap of
the best rows of other labels inside the positive's window. Heaps hold k entries
and merge: tasks merge over their tiles, Spark merges over tasks (a
window limit that cuts each task's share before the shuffle). Nothing is emitted per pair.

The driver sees one wave at a time: its anchors and their positives.

Results: rows without label or usable vector (``vectors.integer_vectors``) take
no part. A null id is no anchor and comes last among equal scores. Repeated rows are rows: each is an anchor, and may be another's
positive. An empty table gives an empty table; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hearth.llm.common import stored
from hearth.llm.vectors import as_integers, exact_type, integer_vectors, longs, matrix

POSITIVES = NEGATIVES = 5
#: Sizes up to here are multiplied directly.
LEAF = 32
#: Rows of a tile, and anchors multiplied with it at a time.
TILE, ANCHORS = 4_096, 256
#: Bytes of anchor vectors in one wave (what is broadcast and what the driver holds).
WAVE_BYTES = 8 << 20
LOWEST = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray, leaf: int = LEAF) -> np.ndarray:
    """``a @ b.T`` for a (m, k) and b (n, k)."""
    m, k, n = a.shape[0], a.shape[1], b.shape[0]
    if min(m, k, n) <= leaf:
        return a @ b.T if a.dtype == object else np.einsum("ik,jk->ij", a, b)

    def quarters(x: np.ndarray) -> tuple:
        r, c = -(-x.shape[0] // 2), -(-x.shape[1] // 2)
        if x.shape != (2 * r, 2 * c):
            x = np.pad(x, ((0, 2 * r - x.shape[0]), (0, 2 * c - x.shape[1])))
        return tuple(np.ascontiguousarray(q) for q in (x[:r, :c], x[:r, c:], x[r:, :c], x[r:, c:]))

    a11, a12, a21, a22 = quarters(a)
    b11, b21, b12, b22 = quarters(b)
    p1 = strassen(a11 + a22, b11 + b22, leaf)
    p2 = strassen(a21 + a22, b11, leaf)
    p3 = strassen(a11, b12 - b22, leaf)
    p4 = strassen(a22, b21 - b11, leaf)
    p5 = strassen(a11 + a12, b22, leaf)
    p6 = strassen(a21 - a11, b11 + b12, leaf)
    p7 = strassen(a12 - a22, b21 + b22, leaf)
    r, c = p1.shape
    out = np.empty((2 * r, 2 * c), p1.dtype)
    out[:r, :c] = p1 + p4 - p5 + p7
    out[:r, c:] = p3 + p5
    out[r:, :c] = p2 + p4
    out[r:, c:] = p1 - p2 + p3 + p6
    return out[:m, :n]


def scores(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of ``a`` and ``b`` (integers kept as doubles)."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    kind = exact_type(top)
    return longs(strassen(as_integers(a, kind), as_integers(b, kind)))


class Heaps:
    """The ``k`` best (score, then smaller id, null ids last) entries per slot; merging is pushing."""

    def __init__(self, slots: int, k: int):
        self.k, self.floor = k, np.full(slots, LOWEST)
        self.slot = self.score = self.id = self.row = np.empty(0, np.int64)
        self.null = np.empty(0, bool)

    def push(self, slot: np.ndarray, score: np.ndarray, id_: np.ndarray, null: np.ndarray, row: np.ndarray) -> None:
        if not len(slot):
            return
        columns = [np.concatenate(p) for p in ((self.slot, slot), (self.score, score), (self.id, id_), (self.null, null), (self.row, row))]
        order = np.lexsort((columns[2], columns[3], ~columns[1], columns[0]))
        columns = [c[order] for c in columns]
        first = np.searchsorted(columns[0], columns[0])
        place = np.arange(len(order)) - first
        full = columns[0][place == self.k - 1]
        self.floor[full] = columns[1][place == self.k - 1]
        self.slot, self.score, self.id, self.null, self.row = (c[place < self.k] for c in columns)


@dataclass
class Wave:
    """Anchors of one wave: row ids (ascending), labels, vectors, and the windows [low, high] of their positives."""
    row: np.ndarray
    label: np.ndarray
    q: np.ndarray
    low: np.ndarray | None = None
    high: np.ndarray | None = None


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for i in range(0, b.num_rows, TILE):
            yield b.slice(i, TILE)


def _own_label(wave: Wave, part: slice, heaps: Heaps, s: np.ndarray, row: np.ndarray, label: np.ndarray, push: Callable) -> None:
    take = (wave.label[part][:, None] == label[None, :]) & (s >= heaps.floor[part][:, None])
    own = np.searchsorted(wave.row[part], row)
    own[own == len(wave.row[part])] = 0
    same = np.flatnonzero(wave.row[part][own] == row)
    take[own[same], same] = False
    a, c = np.nonzero(take)
    push(a + part.start, s[a, c], c)


def _in_window(wave: Wave, part: slice, heaps: Heaps, s: np.ndarray, row: np.ndarray, label: np.ndarray, push: Callable) -> None:
    places = wave.low.shape[1]
    floor = np.maximum(wave.low[part], heaps.floor.reshape(-1, places)[part])
    a, c = np.nonzero((wave.label[part][:, None] != label[None, :]) & (s >= floor.min(axis=1)[:, None]) & (s <= wave.high[part].max(axis=1)[:, None]))
    found = s[a, c]
    fits = (found[:, None] >= floor[a]) & (found[:, None] <= wave.high[part][a])
    at, place = np.nonzero(fits)
    push((a[at] + part.start) * places + place, found[at], c[at])


def _mine(rows: DataFrame, n: int, wave: Wave, slots: int, k: int, step: Callable) -> DataFrame:
    """(slot, score, key, row_id): the k best entries per slot over all rows."""
    held = rows.sparkSession.sparkContext.broadcast(wave)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w, heaps = held.value, Heaps(slots, k)
        for tile in _tiles(batches):
            q = matrix(tile.column("q"), n)
            row, label = tile.column("row_id").to_numpy(), tile.column("label").to_numpy()
            null = np.asarray(tile.column("key").is_null())
            key = tile.column("key").fill_null(0).to_numpy()
            for i in range(0, len(w.row), ANCHORS):
                part = slice(i, min(i + ANCHORS, len(w.row)))
                step(w, part, heaps, scores(w.q[part], q), row, label,
                     lambda slot, score, c: heaps.push(slot, score, key[c], null[c], row[c]))
        yield pa.RecordBatch.from_pydict({
            "slot": pa.array(heaps.slot), "score": pa.array(heaps.score), "key": pa.array(heaps.id, mask=heaps.null), "row_id": pa.array(heaps.row)})

    best = Window.partitionBy("slot").orderBy(F.desc("score"), F.asc_nulls_last("key"), "row_id")
    return (rows.select("row_id", "key", "label", "q").mapInArrow(run, "slot bigint, score bigint, key bigint, row_id bigint")
            .withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k))


def _wave(anchors: DataFrame, n: int) -> tuple[Wave, pa.Array]:
    t = anchors.select("row_id", "key", "label", "q").toArrow().sort_by("row_id")
    t = t.combine_chunks()
    return Wave(t.column("row_id").to_numpy(), t.column("label").to_numpy(), matrix(t.column("q"), n)), t.column("key").to_numpy()


def hard_negatives(df: DataFrame, is_anchor: Column, key: str = "vec_id", vector: str = "embedding", label: str = "label",
                   positives: int = POSITIVES, negatives: int = NEGATIVES, margin: tuple[int, int] = (4, 5),
                   wave_bytes: int = WAVE_BYTES) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on ``key``. Per anchor the ``positives`` best other rows of its label; per
    positive the ``negatives`` best rows of other labels with margin * positive_score <= negative_score <= positive_score,
    where ``margin`` is a fraction (numerator, denominator)."""
    rows, n = integer_vectors(df.select(key, label, vector), key, label, vector)
    rows = rows.filter("label IS NOT NULL")
    spark = df.sparkSession
    anchors = stored(rows.withColumnRenamed("key", key).filter(is_anchor).withColumnRenamed(key, "key"), "anchors")
    many = anchors.count()
    waves = -(-many * max(n, 1) * 8 // wave_bytes)
    up, down = margin
    found = []
    for i in range(waves):
        wave, ids = _wave(anchors.filter(F.pmod(F.xxhash64("row_id"), F.lit(waves)) == i), n)
        if not len(ids):
            continue
        top = _mine(rows, n, wave, len(ids), positives, _own_label).toArrow()
        slot, rank = top.column("slot").to_numpy(), top.column("rank").to_numpy() - 1
        # An empty window for places without a positive.
        wave.low, wave.high = (np.full((len(ids), positives), v) for v in (1, 0))
        best = top.column("score").to_numpy()
        wave.high[slot, rank] = best
        wave.low[slot, rank] = [-(-up * int(s) // down) for s in best]
        pairs = spark.createDataFrame(pa.table({
            "slot": pa.array(slot * positives + rank), "anchor_id": pa.array(ids[slot]), "positive_id": top.column("key"),
            "positive_score": top.column("score")}))
        mined = _mine(rows, n, wave, len(ids) * positives, negatives, _in_window)
        found.append(stored(mined.join(F.broadcast(pairs), "slot").select(
            "anchor_id", "positive_id", "rank", F.col("key").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")), "hard-negatives"))
    if not found:
        return spark.createDataFrame([], "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint")
    return reduce(DataFrame.unionByName, found)
