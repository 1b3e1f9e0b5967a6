"""Sharding by fixed virtual slots.

Every record is hashed by its key into one of ``n_slots`` (thousands) virtual
slots. Bytes and rows are summed per slot, and a small slot-to-shard map with
a version number decides where each slot lives; rebalancing edits the map,
never the hash. A slot too heavy to be placed as a whole (one key with a
large part of all rows) is divided into *pieces* by row id, and the map is
kept per piece.

The numbers that reach the driver are one row per slot and per piece of a
heavy slot; their count depends on ``n_slots`` and ``n_shards`` only. Rows
are numbered without a gap inside each shard from per-cell counts, where a
cell is at most about ``CELL_ROWS`` rows of a piece, so no task holds a shard.

DataFrame functions only; the map is edited on the driver.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from hearth.llm.common import literal_array, literal_table, stored

N_SLOTS = 4096
#: Rows of a numbering cell.
CELL_ROWS = 20_000
#: A piece weighs at most this part of a shard (if its records are smaller).
PIECE_PART = 64


@dataclass(frozen=True)
class SlotMap:
    """One version of the map: the pieces of each slot, and the shard of each (slot, piece)."""

    version: int
    n_shards: int
    pieces: tuple[int, ...]
    shard: dict[tuple[int, int], int]

    def table(self, spark: SparkSession) -> DataFrame:
        rows = [(self.version, self.n_shards, s, self.pieces[s], p, h) for (s, p), h in sorted(self.shard.items())]
        return literal_table(spark, rows, "version int, n_shards int, slot int, pieces int, piece int, shard int")

    def save(self, spark: SparkSession, path: str) -> None:
        """Write as ``path/version=N``; a version is never overwritten."""
        self.table(spark).drop("version").write.parquet(f"{path.rstrip('/')}/version={self.version}")

    @staticmethod
    def load(spark: SparkSession, path: str, version: int) -> SlotMap:
        rows = spark.read.parquet(f"{path.rstrip('/')}/version={version}").collect()  # n_slots and pieces: bounded
        pieces = {r.slot: r.pieces for r in rows}
        return SlotMap(version, rows[0].n_shards, tuple(pieces[s] for s in range(len(pieces))),
                       {(r.slot, r.piece): r.shard for r in rows})

    def of(self, slot: Column, piece: Column) -> Column:
        """The shard of a record, from array literals (no join)."""
        first, flat = [], []
        for s, n in enumerate(self.pieces):
            first.append(len(flat))
            flat += [self.shard[s, p] for p in range(n)]
        at = F.element_at(literal_array(first), slot + 1) + piece
        return F.element_at(literal_array(flat), (at + 1).cast("int")).cast("int")


def records(docs: DataFrame, key: str = "doc_id", text: str = "text", n_slots: int = N_SLOTS) -> DataFrame:
    """(key, size, text_crc32, virtual_slot, row_id), stored. Size: UTF-8 bytes of the text plus 1."""
    t = F.col(text).cast("binary")
    narrow = docs.select(
        F.col(key), (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("bigint").alias("size"),
        F.crc32(F.coalesce(t, F.lit(b""))).alias("text_crc32"),
        F.pmod(F.xxhash64(F.col(key)), F.lit(n_slots)).cast("int").alias("virtual_slot"),
        F.monotonically_increasing_id().alias("row_id"))
    return stored(narrow, "shard-records")


def _cell(n: Column) -> Column:
    return F.pmod(F.xxhash64(F.col("row_id"), F.lit(7)), n).cast("int")


def _pieces(slots: list, n_slots: int, n_shards: int) -> list[int]:
    total = sum(r.bytes for r in slots)
    most = max(1, total // (n_shards * PIECE_PART))
    # Slots of ordinary weight stay whole even when there are few of them per shard.
    most = max(most, 4 * total // n_slots)
    pieces = [1] * n_slots
    for r in slots:
        if r.bytes > most:
            pieces[r.virtual_slot] = min(r.rows, -(-r.bytes // most))
    return pieces


def build_map(weights: dict[tuple[int, int], int], pieces: list[int], n_shards: int) -> SlotMap:
    """First version: the heaviest piece goes to the lightest shard. Empty slots are placed too."""
    load = [(0, 0, h) for h in range(n_shards)]  # bytes, pieces, shard
    shard = {}
    everything = [(weights.get((s, p), 0), s, p) for s in range(len(pieces)) for p in range(pieces[s])]
    for w, s, p in sorted(everything, key=lambda x: (-x[0], x[1], x[2])):
        b, n, h = heapq.heappop(load)
        shard[s, p] = h
        heapq.heappush(load, (b + w, n + 1, h))
    return SlotMap(1, n_shards, tuple(pieces), shard)


def rebalance(old: SlotMap, weights: dict[tuple[int, int], int], n_shards: int) -> SlotMap:
    """The next version for ``n_shards``: pieces leave closed shards and shards above the mean, the
    heaviest that still fits first, for the lightest shard; all other pieces stay."""
    load = dict.fromkeys(range(n_shards), 0)
    held: dict[int, list[tuple[int, int, int]]] = {h: [] for h in range(n_shards)}
    loose = []
    for (s, p), h in old.shard.items():
        w = weights.get((s, p), 0)
        if h < n_shards:
            load[h] += w
            held[h].append((w, s, p))
        else:
            loose.append((w, s, p))
    mean = sum(weights.values()) / n_shards
    for h in range(n_shards):
        for w, s, p in sorted(held[h], reverse=True):
            if w and load[h] - w >= mean:
                load[h] -= w
                loose.append((w, s, p))
    shard = dict(old.shard)
    heap = [(b, h) for h, b in load.items()]
    heapq.heapify(heap)
    for w, s, p in sorted(loose, reverse=True):
        b, h = heapq.heappop(heap)
        shard[s, p] = h
        heapq.heappush(heap, (b + w, h))
    return SlotMap(old.version + 1, n_shards, old.pieces, shard)


def slot_weights(rec: DataFrame, n_shards: int, n_slots: int = N_SLOTS) -> tuple[dict[tuple[int, int], int], list[int], list[int]]:
    """(bytes of each (slot, piece), pieces of each slot, rows of each slot)."""
    slots = rec.groupBy("virtual_slot").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows")).collect()
    pieces = _pieces(slots, n_slots, n_shards)
    rows = [0] * n_slots
    weights = {}
    for r in slots:
        rows[r.virtual_slot] = r.rows
        weights[r.virtual_slot, 0] = r.bytes
    heavy = [s for s in range(n_slots) if pieces[s] > 1]
    if heavy:
        n = F.element_at(literal_array(pieces), F.col("virtual_slot") + 1)
        parts = (rec.filter(n > 1).groupBy("virtual_slot", _cell(n).alias("piece"))
                 .agg(F.sum("size").alias("bytes")).collect())
        weights = {k: v for k, v in weights.items() if pieces[k[0]] == 1}
        weights |= {(r.virtual_slot, r.piece): r.bytes for r in parts}
    return weights, pieces, rows


def assign(rec: DataFrame, slot_map: SlotMap, slot_rows: list[int], following: SlotMap | None = None) -> DataFrame:
    """``rec`` with shard and position: 0, 1, 2, ... inside each shard, in cell and key order. With a
    ``following`` version of the map, next_shard is the shard there.

    A record's cell follows from its row id, cells are numbered by a window each (about CELL_ROWS
    rows), and a cell's first position is the running sum of the counts of the shard's cells."""
    pieces = slot_map.pieces
    n = F.element_at(literal_array(pieces), F.col("virtual_slot") + 1)
    cells = [-(-max(r, 1) // CELL_ROWS) for r in slot_rows]
    per_slot = F.element_at(literal_array(cells), F.col("virtual_slot") + 1)
    placed = (rec.withColumn("piece", _cell(n))
              .withColumn("shard", slot_map.of(F.col("virtual_slot"), F.col("piece")))
              .withColumn("cell", F.pmod(F.xxhash64("row_id", F.lit(11)), per_slot).cast("int")))
    if following:
        placed = placed.withColumn("next_shard", following.of(F.col("virtual_slot"), F.col("piece")))
    cell = ["virtual_slot", "piece", "cell"]
    counts = placed.groupBy("shard", *cell).agg(F.count("*").alias("rows"))
    before = (F.sum("rows").over(W.partitionBy("shard").orderBy(*cell).rowsBetween(W.unboundedPreceding, -1)))
    first = counts.select(*cell, F.coalesce(before, F.lit(0)).alias("first"))
    key = rec.columns[0]
    row = F.row_number().over(W.partitionBy(*cell).orderBy(key, "row_id")) - 1
    return (placed.withColumn("row", row).join(first, cell)
            .withColumn("position", (F.col("first") + F.col("row")).cast("bigint"))
            .drop("piece", "cell", "row", "first"))


def shard_by_slots(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text",
                   n_slots: int = N_SLOTS, map_path: str | None = None, next_shards: int | None = None) -> DataFrame:
    """One row per record: key, size, text_crc32, virtual_slot, row_id, shard, position; with
    ``next_shards``, also next_shard, the shard by the map rebalanced to so many shards.

    Shards are near equal in bytes. Null keys share one slot, null texts weigh 1; repeated rows are
    placed one by one, and a key with a large part of all rows is divided over several shards. Shards
    may stay empty when there are fewer pieces than shards; an empty table gives an empty table. Other
    columns are ignored. ``map_path``: where to store version 1 of the map, and version 2 if it is
    rebalanced; records are then placed by the maps as read back from there."""
    rec = records(docs, key, text, n_slots)
    weights, pieces, rows = slot_weights(rec, n_shards, n_slots)

    def kept(m: SlotMap) -> SlotMap:
        if not map_path:
            return m
        m.save(docs.sparkSession, map_path)
        return SlotMap.load(docs.sparkSession, map_path, m.version)

    slot_map = kept(build_map(weights, pieces, n_shards))
    following = kept(rebalance(slot_map, weights, next_shards)) if next_shards else None
    return assign(rec, slot_map, rows, following)
