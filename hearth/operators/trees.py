"""Regression trees grown by Spark jobs: bagged forests and second-order boosting.

Features are cut into bins; a **cell** is one combination of bins. All that a tree
needs of the rows is, per cell, a weight ``h`` and a sum ``s`` (bagged rows and their
labels, or rows and residuals), so rows are added up to cells before
anything is shuffled, and the work of a tree depends on its cells.

A forest whose rows have at most ``local_cells`` cells sends each tree's sums, packed, to one task, which grows it whole. Else growth goes
level by level: nodes of more than ``local_cells`` cells are split by
Spark: sums per (tree, node, feature, bin) are grouped aggregates that tasks
combine first, the best split of a node is taken in the executors, and the splits are
joined back to the cells; the driver only counts levels. A node with fewer cells is
one group of bounded size, whose whole subtree is grown in one task, all nodes
of a level at once. Many trees (those of all folds of a cross-validation too) go through the same jobs.

A split's gain is SL^2/(HL+l) + SR^2/(HR+l) - S^2/(H+l), a leaf's value S/(H+l): with l = 0 that is the
largest drop in squared error and the mean; with l > 0 it is second-order boosting of the squared loss with L2 leaf
weights (gradient -S, Hessian H). Ties go to the first feature, then the lowest cut.

A model is a table of nodes below the run's folder. Rows with a null or NaN feature go to the right (large) side;
rows with a null label take no part in a fit. An empty table gives a model that predicts null.
"""

from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator
from dataclasses import asdict, dataclass, field, replace
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators.util import attach
from hearth.session import materialize, scratch_path

#: Nodes with at most so many cells are finished in one task (about 1 GB at 5 features).
LOCAL_CELLS = 2_000_000
#: Bytes of nodes that are broadcast at a time to score rows; larger models are scored by joins.
CHUNK_BYTES, MODEL_BYTES = 32 << 20, 512 << 20
#: Levels that Spark splits at most (a node's number above must fit 31 bits).
MAX_LEVELS = 30

KEYS = ["model", "tree", "node"]
#: ``asked``: whether the cell's leaf is to be told.
STATE = "model int, tree int, node bigint, cell binary, h double, s double, asked boolean"
NODES = "model int, tree int, id bigint, left bigint, right bigint, feature int, bin int, value double, cover double, gain double"


@dataclass(frozen=True)
class TreeSettings:
    """How to fit. ``depth`` None: until leaves are pure. ``bagged``: every tree draws its own rows (each row
    Poisson(1) times, by a hash of row and tree) and the trees' mean predicts; else each round fits what the earlier ones
    left, and ``rate`` times the sum is added to the mean label."""
    bagged: bool
    trees: int
    depth: int | None
    rate: float = 1.0
    l2: float = 0.0
    min_child: float = 1.0
    max_bins: int = 256
    seed: int = 42
    bootstrap: bool = True
    local_cells: int = field(default=LOCAL_CELLS, compare=False)


# --- bins and cells ---------------------------------------------------------------------------------------------

def bin_edges(df: DataFrame, features: list[str], max_bins: int) -> list[list[float]]:
    """Ascending cuts per feature; a value belongs to the first cut that is not below it. Between all distinct values if
    there are at most ``max_bins``, else at approximate quantiles."""
    x = {f: F.col(f).cast("double") for f in features}
    about = df.agg(*[F.approx_count_distinct(x[f], 0.02).alias(f) for f in features]).first()
    edges = {}
    for f in features:
        if about[f] <= 1.1 * max_bins:
            values = df.select(x[f].alias("x")).filter("x IS NOT NULL AND NOT isnan(x)").distinct().limit(max_bins + 1).collect()
            if len(values) <= max_bins:
                v = sorted(r.x for r in values)
                edges[f] = [(a + b) / 2 for a, b in zip(v, v[1:])]
    wide = [f for f in features if f not in edges]
    if wide:
        probs = [i / max_bins for i in range(1, max_bins)]
        row = df.agg(*[F.percentile_approx(x[f], probs, 10_000).alias(f) for f in wide]).first()
        edges |= {f: sorted(set(row[f] or [])) for f in wide}
    return [edges[f] for f in features]


def to_bins(x: np.ndarray, edges: list[list[float]]) -> np.ndarray:
    out = np.empty(x.shape, ">u2")
    for j, e in enumerate(edges):
        out[:, j] = np.searchsorted(np.asarray(e), np.where(np.isnan(x[:, j]), np.inf, x[:, j]))
    return out


def _rows(x: pd.Series, p: int) -> np.ndarray:
    """A column of arrays as a matrix, nulls as NaN."""
    return np.array([[np.nan if v is None else v for v in r] for r in x], float).reshape(len(x), p)


def _cells_of(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows as byte strings, and each row's number among them."""
    flat = np.ascontiguousarray(bins).view(np.dtype((np.void, 2 * bins.shape[1])))[:, 0]
    return np.unique(flat, return_inverse=True)


def _binary(cells: np.ndarray) -> pa.Array:
    return pa.array([bytes(c) for c in cells], pa.binary())


def _bins(cells: pa.ChunkedArray | pa.Array, p: int) -> np.ndarray:
    return np.frombuffer(b"".join(cells.to_pylist()), ">u2").reshape(-1, p).astype(np.int64)


_POISSON = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(16)])


def bag_weights(row_hash: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """Poisson(1) counts (rows, trees) from the rows' 64-bit hashes: the same wherever a row lies."""
    with np.errstate(over="ignore"):
        z = row_hash.astype(np.uint64)[:, None] + (np.arange(trees, dtype=np.uint64) + np.uint64(1 + 65537 * seed)) * np.uint64(0x9E3779B97F4A7C15)
        z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
        z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    u = ((z ^ z >> np.uint64(31)) >> np.uint64(11)).astype(np.float64) * 2.0 ** -53
    return np.searchsorted(_POISSON, u, side="right").astype(np.float64)


def root_cells(rows: DataFrame, features: list[str], edges: list[list[float]], settings: TreeSettings, models: int = 1) -> DataFrame:
    """STATE of all trees' roots. ``rows``: features, label, row_hash, fold. With ``models`` > 1, model m learns from the other folds,
    and the cells of fold m, which are asked, go along without weight. Boosting asks all cells."""
    trees = settings.trees if settings.bagged else 1
    bagged = settings.bagged and settings.bootstrap

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
            y, fold = b.column("label").to_numpy(), b.column("fold").to_numpy()
            cells, at = _cells_of(to_bins(x, edges))
            names = _binary(cells)
            w = bag_weights(b.column("row_hash").to_numpy().view(np.uint64), trees, settings.seed) if bagged else np.ones((len(y), trees))
            for m in range(models):
                mine = fold != m if models > 1 else np.ones(len(y), bool)
                asked = np.full(len(cells), not settings.bagged)
                if models > 1:
                    asked[at[~mine]] = True
                for t in range(trees):
                    h = np.bincount(at[mine], w[mine, t], len(cells))
                    s = np.bincount(at[mine], w[mine, t] * y[mine], len(cells))
                    k = np.flatnonzero((h > 0) | asked)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(np.full(len(k), m, np.int32)), pa.array(np.full(len(k), t, np.int32)), pa.array(np.full(len(k), 1 << 32, np.int64)),
                        names.take(pa.array(k)), pa.array(h[k]), pa.array(s[k]), pa.array(asked[k])], ["model", "tree", "node", "cell", "h", "s", "asked"])

    r = rows.select(*[F.col(f).cast("double").alias(f) for f in features], "label", "row_hash", "fold").mapInArrow(run, STATE)
    return r.groupBy("model", "tree", "node", "cell").agg(F.sum("h").alias("h"), F.sum("s").alias("s"), F.max("asked").alias("asked"))


# --- growth inside one group ------------------------------------------------------------------------------------

def _score(s: np.ndarray, h: np.ndarray, l2: float) -> np.ndarray:
    return s * s / np.maximum(h + l2, 1e-300)


def grow_group(bins: np.ndarray, h: np.ndarray, s: np.ndarray, settings: TreeSettings, depth: int | None) -> tuple[dict, np.ndarray]:
    """A whole (sub)tree over cells: columns of its nodes (ids from 0 in order of making), and each cell's leaf. A level's sums per (node, bin)
    are a dense table where that is small beside the cells, else sums of sorted runs."""
    n, p = bins.shape
    left, right, feature, cut, value, cover, gained = ([] for _ in range(7))

    def make(hs: np.ndarray, ss: np.ndarray) -> None:
        for a, x in ((left, -1), (right, -1), (feature, -1), (cut, -1), (gained, 0.0)):
            a.append(np.full(len(hs), x))
        value.append(np.divide(ss, hs + settings.l2, out=np.zeros(len(hs)), where=hs + settings.l2 > 0))
        cover.append(hs)

    hs, ss = np.array([h.sum()]), np.array([s.sum()])
    make(hs, ss)
    made, first, level = 1, 0, 0  # nodes, id of the level's first node
    leaf = np.zeros(n, np.int64)
    # Cells of nodes that may still be split, and their node's place in the level.
    live, local, own_bins = np.arange(n), np.zeros(n, np.int64), np.ascontiguousarray(bins.T, np.int32)
    widths = [int(b.max()) + 1 if n else 1 for b in own_bins]
    while len(live) and (depth is None or level < depth):
        k = made - first
        hv, sv = h[live], s[live]
        best, what, where = np.full(k, -np.inf), np.zeros(k, np.int64), np.zeros(k, np.int64)
        parent = _score(ss, hs, settings.l2)

        def gains(hl: np.ndarray, sl: np.ndarray, h0: np.ndarray, s0: np.ndarray, above: np.ndarray) -> np.ndarray:
            hr, sr = h0 - hl, s0 - sl
            fits = (hl >= settings.min_child) & (hr >= settings.min_child) & (hl > 0) & (hr > 0)
            return np.where(fits, _score(sl, hl, settings.l2) + _score(sr, hr, settings.l2) - above, -np.inf)

        for j, wide in enumerate(widths):
            if wide == 1:
                continue
            slot = local * wide + own_bins[j]
            if k * wide <= 4 * len(live):
                hl = np.bincount(slot, hv, k * wide).reshape(k, wide).cumsum(axis=1)[:, :-1]
                sl = np.bincount(slot, sv, k * wide).reshape(k, wide).cumsum(axis=1)[:, :-1]
                gain = gains(hl, sl, hs[:, None], ss[:, None], parent[:, None])
                at = gain.argmax(axis=1)
                nodes, top = np.arange(k), gain[np.arange(k), at]
            else:
                o = np.argsort(slot)
                key = slot[o]
                ends = np.flatnonzero(np.r_[key[1:] != key[:-1], True])
                own, b = np.divmod(key[ends], wide)
                ch, cs = np.cumsum(hv[o])[ends], np.cumsum(sv[o])[ends]
                last = np.flatnonzero(np.r_[own[1:] != own[:-1], True])  # every node of a level has cells
                i = np.flatnonzero(own[1:] == own[:-1])
                if not len(i):
                    continue
                of = own[i]
                gain = gains(ch[i] - np.r_[0.0, ch[last]][of], cs[i] - np.r_[0.0, cs[last]][of], hs[of], ss[of], parent[of])
                edge = np.flatnonzero(np.r_[True, of[1:] != of[:-1]])
                most = np.full(k, -np.inf)
                most[of[edge]] = np.maximum.reduceat(gain, edge)
                hit = np.flatnonzero(gain == most[of])
                hit = hit[np.r_[True, of[hit][1:] != of[hit][:-1]]]
                nodes, top, at = of[hit], gain[hit], b[i[hit]]
            better = top > best[nodes] + 1e-12 * np.abs(parent[nodes])
            nodes = nodes[better]
            best[nodes], what[nodes], where[nodes] = top[better], j, at[better]
        split = best > 1e-10 * (np.abs(parent) + 1e-300)
        child = np.where(split, made + 2 * (np.cumsum(split) - 1), -1)
        left[-1], right[-1] = child, np.where(split, child + 1, -1)
        feature[-1], cut[-1], gained[-1] = np.where(split, what, -1), np.where(split, where, -1), np.where(split, best, 0.0)
        goes = split[local]
        leaf[live[~goes]] = first + local[~goes]
        live, local, own_bins = live[goes], local[goes], own_bins[:, goes]
        if not len(live):
            break
        local = child[local] + (own_bins[what[local], np.arange(len(live))] > where[local]) - made
        m = 2 * int(split.sum())
        hs, ss = np.bincount(local, h[live], m), np.bincount(local, s[live], m)
        make(hs, ss)
        first, made, level = made, made + m, level + 1
    leaf[live] = first + local
    columns = {"left": left, "right": right, "feature": feature, "bin": cut, "value": value, "cover": cover, "gain": gained}
    return {c: np.concatenate(x) for c, x in columns.items()}, leaf


def _table(nodes: dict, model: int, tree: int, root: int) -> pa.Table:
    """Nodes of a group under their numbers in the whole tree (the root's number, then counted)."""
    def number(x: np.ndarray) -> np.ndarray:
        return np.where(x < 0, -1, x + root)
    n = len(nodes["left"])
    return pa.table({"model": pa.array(np.full(n, model, np.int32)), "tree": pa.array(np.full(n, tree, np.int32)), "id": np.arange(n) + root,
                     "left": number(nodes["left"]), "right": number(nodes["right"]), "feature": nodes["feature"].astype(np.int32),
                     "bin": nodes["bin"].astype(np.int32), "value": nodes["value"], "cover": nodes["cover"], "gain": nodes["gain"]})


def _parallel(df: DataFrame, keys: list[str]) -> DataFrame:
    """Groups dealt to a fixed number of tasks: their work is not told by their bytes."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism), *keys)


# --- growth by Spark --------------------------------------------------------------------------------------------

def _bin_of(cell: Column, feature: Column) -> Column:
    return F.conv(F.hex(F.substring(cell, 2 * feature + 1, F.lit(2))), 16, 10).cast("int")


def _level(big: DataFrame, p: int, settings: TreeSettings) -> DataFrame:
    """KEYS, feature, bin, gain, h, s of every node of ``big``: its best split (feature -1: none)."""
    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            bins = _bins(b.column("cell"), p)
            keys = np.column_stack([b.column(c).to_numpy() for c in KEYS])
            for j in range(p):
                name, at = np.unique(np.column_stack([keys, bins[:, j]]), axis=0, return_inverse=True)
                at = at.ravel()
                yield pa.RecordBatch.from_arrays([
                    pa.array(name[:, 0].astype(np.int32)), pa.array(name[:, 1].astype(np.int32)), pa.array(name[:, 2]), pa.array(np.full(len(name), j, np.int32)),
                    pa.array(name[:, 3].astype(np.int32)), pa.array(np.bincount(at, b.column("h").to_numpy())), pa.array(np.bincount(at, b.column("s").to_numpy()))],
                    [*KEYS, "feature", "bin", "h", "s"])

    sums = big.mapInArrow(partial, "model int, tree int, node bigint, feature int, bin int, h double, s double")
    sums = sums.groupBy(*KEYS, "feature", "bin").agg(F.sum("h").alias("h"), F.sum("s").alias("s"))

    def best(t: pa.Table) -> pa.Table:
        """One node: at most features x bins rows."""
        f = t.to_pandas().sort_values(["feature", "bin"])
        one = f[f.feature == 0]
        h, s = one.h.sum(), one.s.sum()
        parent = _score(s, h, settings.l2)
        found = (-np.inf, -1, -1)
        for j, g in f.groupby("feature"):
            hl, sl = g.h.cumsum().to_numpy()[:-1], g.s.cumsum().to_numpy()[:-1]
            fits = (hl >= settings.min_child) & (h - hl >= settings.min_child) & (hl > 0) & (h - hl > 0)
            gain = np.where(fits, _score(sl, hl, settings.l2) + _score(s - sl, h - hl, settings.l2) - parent, -np.inf)
            if len(gain) and gain.max() > found[0] + 1e-12 * abs(parent):
                found = (gain.max(), int(j), int(g.bin.to_numpy()[gain.argmax()]))
        if not found[0] > 1e-10 * (abs(parent) + 1e-300):
            found = (0.0, -1, -1)
        return pa.table({**{c: t.column(c)[:1] for c in KEYS}, "feature": pa.array([found[1]], pa.int32()), "bin": pa.array([found[2]], pa.int32()),
                         "gain": pa.array([float(found[0])]), "h0": pa.array([float(h)]), "s0": pa.array([float(s)])})

    return _parallel(sums, KEYS).groupBy(*KEYS).applyInArrow(best, "model int, tree int, node bigint, feature int, bin int, gain double, h0 double, s0 double")


def grow(state: DataFrame, p: int, settings: TreeSettings) -> tuple[DataFrame, DataFrame]:
    """(NODES; model, tree, cell, h, s and the leaf's value of the asked cells) of the trees whose roots ``state`` holds."""
    nodes, settled, level = [], [], 0
    state = materialize(state, "cells")
    while settings.depth is None or level < settings.depth:
        size = materialize(state.groupBy(*KEYS).count().filter(F.col("count") > settings.local_cells).select(*KEYS), "big-nodes")
        if level >= MAX_LEVELS or size.isEmpty():
            break
        big = state.join(size, KEYS, "left_semi")
        splits = materialize(_level(big, p, settings), "splits")
        child = F.when(F.col("feature") >= 0, F.shiftleft(F.shiftright("node", 32) * 2, 32))
        mean = F.when(F.col("h0") + settings.l2 > 0, F.col("s0") / (F.col("h0") + settings.l2)).otherwise(0.0)
        nodes.append(splits.select("model", "tree", F.col("node").alias("id"), F.coalesce(child, F.lit(-1)).alias("left"),
                                   F.coalesce(child + (1 << 32), F.lit(-1)).alias("right"), "feature", "bin", mean.alias("value"), F.col("h0").alias("cover"), "gain"))
        moved = big.join(splits, KEYS)
        settled.append(moved.filter("feature < 0 AND asked").select("model", "tree", "cell", "h", "s", mean.alias("value")))
        right = _bin_of(F.col("cell"), F.col("feature")) > F.col("bin")
        moved = moved.filter("feature >= 0").select("model", "tree", (child + F.when(right, F.lit(1 << 32)).otherwise(0)).alias("node"), "cell", "h", "s", "asked")
        # Nodes that are not big wait below their number, whose highest bit tells their level.
        state, level = materialize(state.join(size, KEYS, "left_anti").unionByName(moved), "cells"), level + 1

    depth = settings.depth

    def finish(t: pa.Table) -> tuple[dict, np.ndarray, int, int, int]:
        model, tree, root = (t.column(c)[0].as_py() for c in KEYS)
        above = (root >> 32).bit_length() - 1
        return *grow_group(_bins(t.column("cell"), p), t.column("h").to_numpy(), t.column("s").to_numpy(), settings,
                           None if depth is None else depth - above), model, tree, root

    def leaves(t: pa.Table) -> pa.Table:
        """Nodes (no cell) and settled cells (no id) of one group, in one table."""
        t = t.sort_by("cell")
        made, leaf, model, tree, root = finish(t)
        own = _table(made, model, tree, root)
        told = t.append_column("value", pa.array(made["value"][leaf])).filter(t.column("asked")).select(["model", "tree", "cell", "h", "s", "value"])
        return pa.concat_tables([own, told], promote_options="default").select(BOTH)

    both = materialize(_parallel(state, KEYS).groupBy(*KEYS).applyInArrow(
        leaves, NODES + ", cell binary, h double, s double"), "grown")
    nodes.append(both.filter("id IS NOT NULL").select(*[c.split()[0] for c in NODES.split(", ")]))
    settled.append(both.filter("id IS NULL").select("model", "tree", "cell", "h", "s", "value"))
    return reduce(DataFrame.unionByName, nodes), reduce(DataFrame.unionByName, settled)


BOTH = [c.split()[0] for c in NODES.split(", ")] + ["cell", "h", "s"]


# --- forests whose trees are finished in one task each --------------------------------------------------------

#: Sums of a tree, gathered by a task before they go on, and draws (rows x trees) made at a time.
PACKED, DRAWS = 8192, 2_000_000


def _cell_udf(edges: list[list[float]]):
    @F.pandas_udf("binary")
    def cell(x: pd.Series) -> pd.Series:
        bins = to_bins(_rows(x, len(edges)), edges)
        return pd.Series([b.tobytes() for b in bins])
    return cell


def _with_cells(rows: DataFrame, features: list[str], edges: list[list[float]]) -> DataFrame:
    """(cell, fold, label, row_hash) of training rows."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = np.column_stack([b.column(f).to_numpy(zero_copy_only=False).astype(float) for f in features])
                cells = _binary(np.ascontiguousarray(to_bins(x, edges)).view(np.dtype((np.void, 2 * len(features))))[:, 0])
                yield pa.RecordBatch.from_arrays([cells, b.column("fold"), b.column("label"), b.column("row_hash")], ["cell", "fold", "label", "row_hash"])

    r = rows.select(*[F.col(f).cast("double").alias(f) for f in features], "label", "row_hash", "fold")
    return r.mapInArrow(run, "cell binary, fold int, label double, row_hash bigint")


def packed_cells(rows: DataFrame, p: int, settings: TreeSettings, models: int = 1) -> DataFrame:
    """(tree, cells, folds, h, s): what trees need of their rows, many cells to a record, as bytes. ``rows``: ``_with_cells``. Rows are
    dealt and sorted by cell (a frequent cell's rows by their hash), so a task adds up its own cells and sends each on about once
    per tree, without a row per (tree, cell). With ``models`` > 1 sums are by fold, and cells without weight go along."""
    spark, trees = rows.sparkSession, settings.trees
    bagged = settings.bagged and settings.bootstrap

    def records(cells: list, folds: list, h: list, s: list) -> Iterator[pa.RecordBatch]:
        c, f, hs, ss = np.concatenate(cells), np.concatenate(folds), np.concatenate(h), np.concatenate(s)
        out = []
        for t in range(trees):
            k = np.flatnonzero(hs[:, t] > 0) if models == 1 else slice(None)
            out.append((t, c[k].tobytes(), f[k].tobytes(), hs[k, t].tobytes(), ss[k, t].tobytes()))
        out = [r for r in out if r[1]]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.int32()), *[pa.array([r[i] for r in out], pa.binary()) for i in range(1, 5)]],
                                             ["tree", "cells", "folds", "h", "s"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, step = ([], [], [], []), 0, max(1, DRAWS // trees)
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                b = batch.slice(at, step)
                cell = np.frombuffer(b"".join(b.column("cell").to_pylist()), np.dtype((np.void, 2 * p)))
                fold, y = b.column("fold").to_numpy().astype(np.int32), b.column("label").to_numpy()
                start = np.flatnonzero(np.r_[True, (cell[1:] != cell[:-1]) | (fold[1:] != fold[:-1])])
                w = bag_weights(b.column("row_hash").to_numpy().view(np.uint64), trees, settings.seed) if bagged else np.ones((len(y), trees))
                # A part's weights are whole numbers below 2^24.
                for a, x in zip(held, (cell[start], fold[start], np.add.reduceat(w, start, axis=0).astype(np.float32), np.add.reduceat(w * y[:, None], start, axis=0))):
                    a.append(x)
                n += len(start)
                if n >= PACKED:
                    yield from records(*held)
                    held, n = ([], [], [], []), 0
        if n:
            yield from records(*held)

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = rows.repartitionByRange(tasks, "cell", "row_hash").sortWithinPartitions("cell", "fold", "row_hash")
    return dealt.mapInArrow(run, "tree int, cells binary, folds binary, h binary, s binary").repartition(max(tasks, min(2 * trees, 1000)), "tree")


def _distinct(bins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct rows in ascending order, and each row's number among them."""
    code, size = np.zeros(len(bins), np.int64), 1
    for b in bins.T:
        wide = int(b.max()) + 1
        size *= wide
        if size >= 1 << 62:
            u, at = np.unique(bins, axis=0, return_inverse=True)
            return u, at.ravel()
        code = code * wide + b
    _, first, at = np.unique(code, return_index=True, return_inverse=True)
    return bins[first], at


def _unpack(t: pa.Table, p: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct cells of one tree; per sum its cell's number, its fold, h and s."""
    def joined(c: str, kind) -> np.ndarray:
        return np.frombuffer(b"".join(t.column(c).to_pylist()), kind)
    bins = joined("cells", ">u2").reshape(-1, p).astype(np.int64)
    # In the order of their bytes: sums do not depend on which record came first.
    s, folds = joined("s", float), joined("folds", np.int32)
    cells, at = _distinct(bins)
    o = np.lexsort((s, folds, at))
    return cells, at[o], folds[o], joined("h", np.float32).astype(float)[o], s[o]


def grow_packed(packed: DataFrame, p: int, settings: TreeSettings) -> DataFrame:
    """NODES of the trees of ``packed``, each grown whole in one task."""
    def run(t: pa.Table) -> pa.Table:
        cells, at, _, h, s = _unpack(t, p)
        nodes = grow_group(cells, np.bincount(at, h, len(cells)), np.bincount(at, s, len(cells)), settings, settings.depth)[0]
        return _table(nodes, 0, t.column("tree")[0].as_py(), 1 << 32)

    return packed.groupBy("tree").applyInArrow(run, NODES)


#: Cells whose values go together to where they are added up over the trees.
TOLD = 16_384


def tell_packed(packed: DataFrame, p: int, settings: TreeSettings, models: int) -> DataFrame:
    """(model, cell, prediction) of each fold's cells, by the forest of the other folds."""
    def grown(t: pa.Table) -> pa.Table:
        cells, at, fold, h, s = _unpack(t, p)
        tree, out = t.column("tree")[0].as_py(), []
        for m in range(models):
            own = fold != m
            hm, sm = np.bincount(at[own], h[own], len(cells)), np.bincount(at[own], s[own], len(cells))
            asked = np.zeros(len(cells), bool)
            asked[at[~own]] = True
            k = np.flatnonzero((hm > 0) | asked)
            nodes, leaf = grow_group(cells[k], hm[k], sm[k], settings, settings.depth)
            told, value = cells[k[asked[k]]].astype(">u2"), nodes["value"][leaf[asked[k]]]
            # A fold's cells are the same, in the same order, for every tree.
            out += [(m, a // TOLD, tree, told[a:a + TOLD].tobytes() if tree == 0 else b"", value[a:a + TOLD].tobytes()) for a in range(0, len(told), TOLD)]
        return pa.table([pa.array([r[i] for r in out], x) for i, x in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["model", "part", "tree", "cells", "value"])

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("tree")
        cells = _split(b"".join(t.column("cells").to_pylist()), 2 * p)
        total = sum(np.frombuffer(v, float) for v in t.column("value").to_pylist()) / settings.trees
        return pa.table({"model": pa.array(np.full(len(cells), t.column("model")[0].as_py(), np.int32)), "cell": cells, "prediction": total})

    told = packed.groupBy("tree").applyInArrow(grown, "model int, part int, tree int, cells binary, value binary")
    return told.groupBy("model", "part").applyInArrow(added, "model int, cell binary, prediction double")


def _split(cells: bytes, width: int) -> pa.Array:
    return _binary(np.frombuffer(cells, np.dtype((np.void, width))))


def fits_a_task(rows: DataFrame, settings: TreeSettings) -> bool:
    """Whether all cells of ``rows`` (``_with_cells``) may be in one task."""
    return rows.select("cell").distinct().count() <= settings.local_cells


# --- fits -------------------------------------------------------------------------------------------------------

@dataclass
class TreeModel:
    """Nodes (a stored table), how features are cut, and how trees add up. ``imputer``: SQL that adds ``__imp_<feature>``."""
    path: str
    features: list[str]
    edges: list[list[float]]
    settings: TreeSettings
    base: float | None
    imputer: str

    @property
    def nodes(self) -> DataFrame:
        return SparkSession.getActiveSession().read.schema(NODES).parquet(f"{self.path}/nodes")

    def impute(self, df: DataFrame) -> DataFrame:
        from pyspark.ml.feature import SQLTransformer
        return SQLTransformer(statement=self.imputer).transform(df)

    def save(self, path: str) -> str:
        spark = SparkSession.getActiveSession()
        about = {"features": self.features, "edges": self.edges, "settings": asdict(self.settings), "base": self.base, "imputer": self.imputer}
        if path != self.path:
            self.nodes.write.mode("overwrite").parquet(f"{path}/nodes")
        # Written last: a folder without it holds no model.
        spark.createDataFrame([(json.dumps(about),)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")
        return path

    @staticmethod
    def load(path: str) -> TreeModel:
        about = json.loads(SparkSession.getActiveSession().read.text(f"{path}/about", wholetext=True).first()[0])
        return TreeModel(path, about["features"], about["edges"], TreeSettings(**about["settings"]), about["base"], about["imputer"])

    def importances(self) -> DataFrame:
        """(feature number, importance): each tree's gains by feature as shares, averaged over the trees that split."""
        per = self.nodes.filter("feature >= 0").groupBy("tree", "feature").agg(F.sum("gain").alias("g"))
        total = per.groupBy("tree").agg(F.sum("g").alias("all"))
        shares = per.join(total, "tree").groupBy("feature").agg(F.sum(F.col("g") / F.col("all")).alias("g"))
        return attach(shares, per.agg(F.count_distinct("tree").alias("n"))).select("feature", (F.col("g") / F.col("n")).alias("importance"))

    def transform(self, df: DataFrame, chunk_bytes: int = CHUNK_BYTES, model_bytes: int = MODEL_BYTES) -> DataFrame:
        """``df`` (imputed) with ``prediction``."""
        rows = self.impute(df)
        columns = rows.columns
        if self.base is None:
            return rows.withColumn("prediction", F.lit(None).cast("double"))
        sizes = {r.tree: r["count"] for r in self.nodes.groupBy("tree").count().collect()}  # one row per tree
        each = 40
        if sum(sizes.values()) * each > model_bytes or max(sizes.values()) * each > chunk_bytes:
            scored = self._by_cells(rows)
        else:
            chunks, held = [[]], 0
            for t, n in sorted(sizes.items()):
                if held and held + n * each > chunk_bytes:
                    chunks.append([])
                    held = 0
                chunks[-1].append(t)
                held += n * each
            x = F.array(*[F.col(f"__imp_{f}").cast("double") for f in self.features])
            scored = rows.withColumns({"__x": x, "__sum": F.lit(0.0)})
            for chunk in chunks:
                scored = self._add_chunk(scored, chunk)
        total = F.col("__sum") * self.settings.rate / (len(sizes) if self.settings.bagged else 1) + F.lit(self.base)
        return scored.select(*columns, total.alias("prediction"))

    def _add_chunk(self, scored: DataFrame, trees: list[int]) -> DataFrame:
        held = scored.sparkSession.sparkContext.broadcast(chunk_arrays(self.nodes.filter(F.col("tree").isin(trees))))
        edges = self.edges

        @F.pandas_udf("double")
        def add(x: pd.Series, so_far: pd.Series) -> pd.Series:
            if not len(x):
                return so_far
            bins = to_bins(_rows(x, len(edges)), edges).astype(np.int64)
            total = so_far.to_numpy().copy()
            for tree in held.value:
                total += tree["value"][walk(tree, bins)]
            return pd.Series(total)

        return scored.withColumn("__sum", add("__x", "__sum"))

    def _by_cells(self, rows: DataFrame) -> DataFrame:
        """The same for any size of model: trees meet the distinct cells of the rows, not the rows."""
        x = F.array(*[F.col(f"__imp_{f}").cast("double") for f in self.features])
        own = materialize(rows.withColumn("__cell", _cell_udf(self.edges)(x)), "rows-to-score")
        sums = over_trees(self, own.select(F.col("__cell").alias("cell")).distinct(), 1, lambda tree, bins: tree["value"][walk(tree, bins)][:, None])
        return own.join(sums.select(F.col("cell").alias("__cell"), F.col("sums")[0].alias("__sum")), "__cell")


#: Cells that a tree meets at a time.
CHUNK_CELLS = 2_000_000


def over_trees(model: TreeModel, cells: DataFrame, width: int, work: Callable[[dict, np.ndarray], np.ndarray]) -> DataFrame:
    """(cell, sums): for each of the distinct ``cells``, the sums over all trees of ``work`` (tree, bins of n cells) -> n x width. A task holds one tree
    and the bytes of a chunk of cells; a chunk's results are added up in pieces. Stored."""
    spark, p = model.nodes.sparkSession, len(model.features)
    cells = materialize(cells, "cells-to-score")
    piece = max(1, TOLD // width)
    chunks = max(1, -(-cells.count() // CHUNK_CELLS))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, part = [], 0, 0
        for b in batches:
            if b.num_rows:
                chunk = b.column("chunk")[0].as_py()
                held += b.column("cell").to_pylist()
                while len(held) >= piece:
                    yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([b"".join(held[:piece])])], ["chunk", "part", "cells"])
                    held, part = held[piece:], part + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([part], pa.int32()), pa.array([b"".join(held)])], ["chunk", "part", "cells"])

    dealt = cells.repartition(chunks, "cell").select("cell", F.spark_partition_id().alias("chunk"))
    packed = materialize(dealt.mapInArrow(pack, "chunk int, part int, cells binary"), "packed-cells")
    trees = materialize(model.nodes.select("tree").distinct(), "trees")  # one row per tree
    n = trees.count()

    def meet(nodes: pa.Table, parts: pa.Table) -> pa.Table:
        out = []
        if nodes.num_rows and parts.num_rows:
            tree = _arrays_of(nodes)[0]
            number = nodes.column("tree")[0].as_py()
            for r in parts.sort_by("part").select(["of_chunk", "part", "cells"]).to_pylist():
                bins = np.frombuffer(r["cells"], ">u2").reshape(-1, p).astype(np.int64)
                out.append((r["of_chunk"], r["part"], number, r["cells"], np.ascontiguousarray(work(tree, bins), float).tobytes()))
        return pa.table([pa.array([r[i] for r in out], x) for i, x in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.binary()))],
                        ["chunk", "part", "tree", "cells", "sums"])

    def added(t: pa.Table) -> pa.Table:
        t = t.sort_by("tree")
        total = sum(np.frombuffer(v, float) for v in t.column("sums").to_pylist())
        own = _split(t.column("cells")[0].as_py(), 2 * p)
        return pa.table({"cell": own, "sums": pa.ListArray.from_arrays(pa.array(np.arange(len(own) + 1) * width, pa.int32()), pa.array(total))})

    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism, min(2 * n, 1000))
    nodes = model.nodes.select("tree", "id", "left", "right", "feature", "bin", "value", "cover")
    nodes = nodes.crossJoin(F.broadcast(packed.select("chunk").distinct())).repartition(tasks, "tree", "chunk")  # one row per chunk
    own = [F.col("chunk").alias("of_chunk"), F.col("tree").alias("of_tree")]  # other names than the nodes': both come from the same tables
    parts = packed.crossJoin(F.broadcast(trees)).select(*own, "part", "cells").repartition(tasks, "of_tree", "of_chunk")
    met = nodes.groupBy("tree", "chunk").cogroup(parts.groupBy("of_tree", "of_chunk")).applyInArrow(meet, "chunk int, part int, tree int, cells binary, sums binary")
    return materialize(met.groupBy("chunk", "part").applyInArrow(added, "cell binary, sums array<double>"), "cell-sums")


def chunk_arrays(nodes: DataFrame) -> list[dict]:
    """Trees as arrays, children by position."""
    return _arrays_of(nodes.select("tree", "id", "left", "right", "feature", "bin", "value", "cover").toArrow())


def _arrays_of(t: pa.Table) -> list[dict]:
    t = t.sort_by([("tree", "ascending"), ("id", "ascending")])
    c = {n: t.column(n).to_numpy() for n in t.column_names}
    cuts = np.r_[np.flatnonzero(np.r_[True, c["tree"][1:] != c["tree"][:-1]]), len(c["tree"])]
    out = []
    for a, b in zip(cuts, cuts[1:]):
        tree = {n: x[a:b] for n, x in c.items()}
        for side in ("left", "right"):
            tree[side] = np.where(tree[side] < 0, -1, np.searchsorted(tree["id"], tree[side])).astype(np.int32)
        out.append(tree)
    return out


def walk(tree: dict, bins: np.ndarray) -> np.ndarray:
    """The leaf's position for each row."""
    at, live = np.zeros(len(bins), np.int64), np.arange(len(bins))
    while len(live):
        f = tree["feature"][at[live]]
        live = live[f >= 0]
        here = at[live]
        right = bins[live, tree["feature"][here]] > tree["bin"][here]
        at[live] = np.where(right, tree["right"][here], tree["left"][here])
    return at


def training_rows(df: DataFrame, features: list[str], label: str, imputer, fold: Column | None = None) -> DataFrame:
    """Imputed features, label, row_hash and fold of the rows with a label, stored. A row's hash is that of its id, or of its
    features and label where there is none."""
    x = imputer.transform(df)
    own = ["id"] if "id" in df.columns else [*features, label]
    rows = x.select(*[F.col(f"__imp_{f}").cast("double").alias(f) for f in features], F.col(label).cast("double").alias("label"),
                    F.xxhash64(*own).alias("row_hash"), (F.lit(0) if fold is None else fold).cast("int").alias("fold"))
    # Every row is worked on once per tree, so rows are dealt to all cores however few bytes they have.
    tasks = 2 * df.sparkSession.sparkContext.defaultParallelism
    return materialize(rows.filter(F.col("label").isNotNull() & ~F.isnan("label")).repartition(tasks), "training-rows")


def boost_group(bins: np.ndarray, h: np.ndarray, s: np.ndarray, settings: TreeSettings) -> Iterator[dict]:
    """All rounds over the cells of one model: after each, what it left."""
    s = s.copy()
    for _ in range(settings.trees):
        nodes, leaf = grow_group(bins, h, s, settings, settings.depth)
        s -= h * nodes["value"][leaf] * settings.rate
        yield nodes


def _boosted(root: DataFrame, p: int, settings: TreeSettings) -> DataFrame:
    """Nodes of all rounds. ``root``: cells with the sums of labels less the base."""
    if root.count() <= settings.local_cells:
        def run(t: pa.Table) -> pa.Table:
            t = t.sort_by("cell")
            rounds = boost_group(_bins(t.column("cell"), p), t.column("h").to_numpy(), t.column("s").to_numpy(), settings)
            return pa.concat_tables([_table(nodes, 0, i, 1 << 32) for i, nodes in enumerate(rounds)])

        return root.groupBy("model").applyInArrow(run, NODES)
    nodes, state = [], root
    for i in range(settings.trees):
        made, settled = grow(state.select("model", F.lit(i).alias("tree"), F.lit(1 << 32).alias("node"), "cell", "h", "s", "asked"), p, settings)
        nodes.append(materialize(made, "round"))
        state = settled.select("model", "cell", "h", F.lit(True).alias("asked"), (F.col("s") - F.col("h") * F.col("value") * settings.rate).alias("s"))
        state = materialize(state, "left")
    return reduce(DataFrame.unionByName, nodes)


def fit_trees(df: DataFrame, features: list[str], label: str, settings: TreeSettings, imputer) -> TreeModel:
    """``imputer``: a fitted SQL transformer that adds ``__imp_<feature>``."""
    rows = training_rows(df, features, label, imputer)
    edges = bin_edges(rows, features, settings.max_bins)
    path = scratch_path(df.sparkSession, "trees")
    root = root_cells(rows, features, edges, settings)
    if settings.bagged:
        base = None if rows.isEmpty() else 0.0
        celled = _with_cells(rows, features, edges)
        if fits_a_task(celled, settings):
            nodes = grow_packed(packed_cells(celled, len(features), settings), len(features), settings)
        else:
            nodes = grow(root, len(features), settings)[0]
    else:
        base = rows.agg(F.avg("label")).first()[0]
        root = materialize(root.withColumn("s", F.col("s") - F.col("h") * F.lit(base)), "cells")
        nodes = _boosted(root, len(features), settings)
    nodes.write.parquet(f"{path}/nodes")
    model = TreeModel(path, features, edges, settings, base, imputer.getStatement())
    model.save(path)
    return model


def out_of_fold(df: DataFrame, features: list[str], label: str, settings: TreeSettings, imputer, fold: Column, k: int) -> DataFrame:
    """(fold, label, prediction) of all rows, each by a forest of the other folds. All folds' trees grow in the same jobs; the cells
    of a fold go through its forest's splits with weight 0, so no model is written or scored."""
    rows = training_rows(df, features, label, imputer, fold)
    edges = bin_edges(rows, features, settings.max_bins)
    celled = _with_cells(rows, features, edges)
    if fits_a_task(celled, settings):
        scores = tell_packed(packed_cells(celled, len(features), settings, models=k), len(features), settings, k)
    else:
        settled = grow(root_cells(rows, features, edges, settings, models=k), len(features), settings)[1]
        scores = settled.groupBy("model", "cell").agg((F.sum("value") / settings.trees).alias("prediction"), F.count("*").alias("n")).filter(F.col("n") == settings.trees)
    scores = materialize(scores.select(F.col("model").alias("fold"), "cell", "prediction"), "out-of-fold")
    asked = rows.select("fold", "label", _cell_udf(edges)(F.array(*features)).alias("cell"))
    return asked.join(scores, ["fold", "cell"]).select("fold", "label", "prediction")


# --- attribution ------------------------------------------------------------------------------------------------

def leaf_paths(tree: dict, p: int) -> dict:
    """Per leaf: its value, the bins [low, high] of each feature that lead to it, and per feature the share of the cover that
    follows the path at that feature's splits."""
    n = len(tree["left"])
    low, high, share = np.zeros((n, p), np.int32), np.full((n, p), 1 << 16, np.int32), np.ones((n, p))
    front = np.zeros(1, np.int64)
    while len(front):
        front = front[tree["feature"][front] >= 0]
        f, cut, below = tree["feature"][front], tree["bin"][front], []
        for side, bound in (("left", high), ("right", low)):
            child = tree[side][front]
            for a in (low, high, share):
                a[child] = a[front]
            bound[child, f] = np.minimum(high[front, f], cut) if side == "left" else np.maximum(low[front, f], cut + 1)
            share[child, f] *= tree["cover"][child] / tree["cover"][front]
            below.append(child)
        front = np.concatenate(below)
    leaf = np.flatnonzero(tree["feature"] < 0)
    return {"low": low[leaf], "high": high[leaf], "share": share[leaf], "value": tree["value"][leaf]}


def path_attribution(leaves: dict, x: np.ndarray, block: int = 1 << 16) -> np.ndarray:
    """[value without any feature, value, contribution of each feature] of one row of bins, summed over leaves.

    On a path, feature j passes on o_j (1 if the row follows the path there) when known and z_j (the cover's share) when not.
    Its Shapley value is value * (o_j - z_j) * integral over t in [0, 1] of the product over i != j of (z_i (1 - t) + o_i t):
    the integral gives every subset its weight. The product is a polynomial in t, which Gauss-Legendre points sum
    exactly, so a leaf costs about features^2 / 2 steps and not 2^features."""
    p = len(x)
    points, weights = np.polynomial.legendre.leggauss(max(1, (p + 1) // 2))
    out = np.zeros(p + 2)
    for a in range(0, len(leaves["value"]), block):
        z, value = leaves["share"][a:a + block], leaves["value"][a:a + block]
        o = ((x >= leaves["low"][a:a + block]) & (x <= leaves["high"][a:a + block])).astype(float)
        out[0] += value @ z.prod(axis=1)
        out[1] += value @ o.prod(axis=1)
        for t, w in zip((points + 1) / 2, weights / 2):
            step = z * (1 - t) + o * t
            before, behind = np.ones_like(step), np.ones_like(step)
            np.cumprod(step[:, :-1], axis=1, out=before[:, 1:])
            behind[:, :-1] = np.cumprod(step[:, :0:-1], axis=1)[:, ::-1]
            out[2:] += w * (value @ ((o - z) * before * behind))
    return out


def attributions(model: TreeModel, rows: DataFrame, chunk_bytes: int = CHUNK_BYTES, model_bytes: int = MODEL_BYTES) -> DataFrame:
    """``rows`` (imputed) with ``__phi``: [base, prediction, contributions]. Rows stream past the leaves, which are broadcast in
    chunks of trees of bounded bytes; a larger model's trees meet the rows' distinct cells, a tree to a task."""
    p, edges = len(model.features), model.edges
    sizes = {r.tree: r["count"] for r in model.nodes.groupBy("tree").count().collect()}  # one row per tree
    scale = model.settings.rate / (len(sizes) if model.settings.bagged else 1)
    each, chunks, held = 8 * (2 * p + 1), [[]], 0
    for t, n in sorted(sizes.items()):
        if held and held + n * each > chunk_bytes:
            chunks.append([])
            held = 0
        chunks[-1].append(t)
        held += n * each
    x = F.array(*[F.col(f"__imp_{f}").cast("double") for f in model.features])
    if sum(sizes.values()) * each > model_bytes or max(sizes.values(), default=0) * each > chunk_bytes:
        return _attributions_by_cells(model, rows.withColumn("__cell", _cell_udf(edges)(x)), scale)
    start = F.array(*[F.lit(float(model.base or 0.0))] * 2, *[F.lit(0.0)] * p)
    out = rows.withColumns({"__x": x, "__phi": start})
    for chunk in filter(None, chunks):
        paths = [leaf_paths(t, p) for t in chunk_arrays(model.nodes.filter(F.col("tree").isin(chunk)))]
        leaves = {c: np.concatenate([t[c] for t in paths]) for c in paths[0]}
        out = out.withColumn("__phi", _adds_paths(rows.sparkSession.sparkContext.broadcast(leaves), edges, scale)("__x", "__phi"))
    return out.drop("__x")


def _attributions_by_cells(model: TreeModel, rows: DataFrame, scale: float) -> DataFrame:
    p, base = len(model.features), float(model.base or 0.0)

    def work(tree: dict, bins: np.ndarray) -> np.ndarray:
        leaves = leaf_paths(tree, p)
        return np.array([path_attribution(leaves, b) for b in bins])

    own = materialize(rows, "rows-to-explain")
    sums = over_trees(model, own.select(F.col("__cell").alias("cell")).distinct(), p + 2, work)
    phi = F.array(*[F.col("sums")[i] * scale + (base if i < 2 else 0.0) for i in range(p + 2)])
    return own.join(sums.select(F.col("cell").alias("__cell"), phi.alias("__phi")), "__cell").drop("__cell")


def _adds_paths(leaves, edges: list[list[float]], scale: float):
    @F.pandas_udf("array<double>")
    def add(x: pd.Series, so_far: pd.Series) -> pd.Series:
        if not len(x):
            return so_far
        bins = to_bins(_rows(x, len(edges)), edges).astype(np.int64)
        return pd.Series([np.asarray(a) + scale * path_attribution(leaves.value, b) for a, b in zip(so_far, bins)])
    return add
