"""Quality scores: ridge regression on random Fourier features of document
statistics, then isotonic calibration.

1. Each text is reduced to the statistics in ``STATISTICS`` inside its row.
2. cos(Wx + b) with Gaussian W approximates a Gaussian kernel on the
   standardised statistics. Each task sums its rows' normal equations; the sums
   are added row by row of the matrix, so the driver solves one (D + 1)-square
   system whatever the number of rows.
3. Part of the labelled rows is kept from the fit; their raw scores are
   counted in ``BINS`` bins, and pooling adjacent violators over the bins gives a
   monotone map to probabilities.

All labelled rows that may be learnt from are used; there is no sample.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.llm.common import stored

STATISTICS = ["bytes", "words", "word_length", "longest_word", "capitals", "digits", "symbols", "bangs", "bars", "stops",
              "spaces", "newlines", "non_ascii", "entropy", "distinct_words", "top_word", "distinct_pairs", "same_lines", "line_words", "closed_lines"]
FEATURES = 256
#: Width of the kernel, in units of the square root of the number of statistics.
WIDTH = 1.0
RIDGE = 1e-3
BINS = 1000
LOW, HIGH = -0.5, 1.5
THRESHOLD = 0.7


def _set(chars: bytes) -> np.ndarray:
    return np.isin(np.arange(256), list(chars))


_CAPITAL, _SMALL, _DIGIT = _set(bytes(range(65, 91))), _set(bytes(range(97, 123))), _set(b"0123456789")
_SYMBOL, _SPACE, _STOP = _set(b"#*$%&<>~^=_\\{}[]@"), _set(b" \t\n\x0b\x0c\r"), _set(b".,;:?")


def statistics(data: bytes) -> list[float]:
    """The statistics of one UTF-8 text; all 0 for an empty one."""
    if not data:
        return [0.0] * len(STATISTICS)
    n = len(data)
    count = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    part = count[count > 0] / n
    words = data.split()
    m = len(words)
    seen = Counter(words)
    lines = [x for x in data.split(b"\n") if x.strip()]
    k = max(len(lines), 1)
    letters = max(int(count[_CAPITAL].sum() + count[_SMALL].sum()), 1)
    return [np.log1p(n), np.log1p(m), n / max(m, 1) if m else 0.0, np.log1p(max(map(len, words), default=0)),
            count[_CAPITAL].sum() / letters, count[_DIGIT].sum() / n, np.log1p(100 * count[_SYMBOL].sum() / n), np.log1p(100 * count[33] / n),
            np.log1p(100 * count[124] / n), count[_STOP].sum() / n, count[_SPACE].sum() / n, count[10] / n, count[128:].sum() / n,
            float(-(part * np.log2(part)).sum()), len(seen) / max(m, 1), max(seen.values(), default=0) / max(m, 1),
            len(set(zip(words, words[1:]))) / max(m - 1, 1), 1 - len(set(lines)) / k, np.log1p(m / k),
            sum(x.rstrip()[-1:] in (b".", b"?", b"!", b":") for x in lines) / k]


def statistics_column(text: Column) -> Column:
    @F.pandas_udf("array<double>")
    def stats(texts: pd.Series) -> pd.Series:
        return pd.Series([[float(x) for x in statistics(t or b"")] for t in texts])
    return stats(text.cast("binary"))


def pool_adjacent(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The non-decreasing sequence nearest to ``values`` in weighted least squares."""
    blocks: list[list[float]] = []  # mean, weight, length
    for v, w in zip(values, weights):
        blocks.append([v, w, 1])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v2, w2, n2 = blocks.pop()
            v1, w1, n1 = blocks.pop()
            blocks.append([(v1 * w1 + v2 * w2) / (w1 + w2), w1 + w2, n1 + n2])
    return np.repeat([b[0] for b in blocks], [int(b[2]) for b in blocks])


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    at: np.ndarray  # raw scores, ascending
    value: np.ndarray  # their calibrated scores
    features: int
    seed: int

    def transform(self, stats: np.ndarray) -> np.ndarray:
        """Random Fourier features and a constant."""
        r = np.random.default_rng(self.seed)
        w = r.normal(0, 1 / (WIDTH * np.sqrt(stats.shape[1])), (stats.shape[1], self.features))
        b = r.uniform(0, 2 * np.pi, self.features)
        z = np.clip((stats - self.mean) / self.scale, -8, 8) @ w + b
        return np.hstack([np.sqrt(2 / self.features) * np.cos(z), np.ones((len(stats), 1))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.transform(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        raw = self.raw(stats)
        return np.clip(np.interp(raw, self.at, self.value) if len(self.at) else raw, 0, 1)


def _array(batch: pa.RecordBatch, name: str) -> np.ndarray:
    column = batch.column(name)
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _normal_equations(rows: DataFrame, model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Sums of zz' and zy over ``rows`` (stats, y)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((model.features + 1, model.features + 2))
        for batch in batches:
            if batch.num_rows:
                z = model.transform(_array(batch, "stats"))
                total += z.T @ np.hstack([z, batch.column("y").to_numpy(zero_copy_only=False)[:, None]])
        yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], ["i", "v"])

    def add(group: pa.Table) -> pa.Table:
        v = group["v"].combine_chunks()
        return pa.table({"i": group["i"][:1], "v": pa.array([v.flatten().to_numpy().reshape(len(v), -1).sum(axis=0)], pa.list_(pa.float64()))})

    parts = rows.select("stats", "y").mapInArrow(run, "i int, v array<double>")
    out = np.zeros((model.features + 1, model.features + 2))
    for r in parts.groupBy("i").applyInArrow(add, "i int, v array<double>").collect():  # D + 1 rows
        out[r.i] += r.v
    return out[:, :-1], out[:, -1]


def fit(rows: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = 42) -> Model:
    """Fit on ``rows`` (stats, y in 0..1, calibrate boolean); the rows to calibrate with are not fitted.

    Without a row to fit the raw score is 0.5; without one to calibrate with it is only clipped."""
    d = len(STATISTICS)
    train = rows.filter("NOT calibrate")
    cells = [f(F.col("stats")[i]) for i in range(d) for f in (F.avg, F.stddev_pop)]
    moments = train.agg(F.count("*").alias("n"), *cells).first()
    mean = np.array([moments[1 + 2 * i] or 0.0 for i in range(d)])
    scale = np.array([moments[2 + 2 * i] or 1.0 for i in range(d)])
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), np.zeros(features + 1), np.zeros(0), np.zeros(0), features, seed)
    if not moments["n"]:
        model.weights[-1] = 0.5
        return model
    zz, zy = _normal_equations(train, model)
    penalty = np.full(features + 1, ridge * moments["n"] / features)
    penalty[-1] = 0
    model.weights = np.linalg.solve(zz + np.diag(penalty) + 1e-9 * np.eye(features + 1), zy)

    bin_ = F.least(F.greatest(F.floor((F.col("raw") - LOW) / (HIGH - LOW) * BINS), F.lit(0)), F.lit(BINS - 1))
    bins = (rows.filter("calibrate").select(_apply(model.raw, "stats").alias("raw"), "y").groupBy(bin_.alias("b"))
            .agg(F.avg("raw").alias("raw"), F.avg("y").alias("y"), F.count("*").alias("n")).orderBy("b").collect())
    model.at = np.array([r.raw for r in bins])
    model.value = pool_adjacent(np.array([r.y for r in bins]), np.array([float(r.n) for r in bins]))
    return model


def _apply(f, column: str) -> Column:
    @F.pandas_udf("double")
    def g(stats: pd.Series) -> pd.Series:
        return pd.Series(f(np.array(stats.tolist())) if len(stats) else np.zeros(0))
    return g(F.col(column))


def quality_scores(docs: DataFrame, labels: DataFrame, held_out: Column, calibrate: Column, key: str = "doc_id",
                   text: str = "text", label: str = "quality", threshold: float = THRESHOLD) -> DataFrame:
    """(key, held_out, score, predicted) per row of ``docs``.

    ``labels``: (key, label 0 or 1); ``held_out`` and ``calibrate`` are conditions on the key: held-out rows
    are never learnt from, the others calibrate or are fitted. Null labels are left out; several
    labels of a key are averaged. Only the text's statistics are inputs. Null texts count as empty and
    are scored like any other; rows with a null key are scored and not held out; repeated rows get
    equal scores; other columns are ignored; an empty table gives an empty table."""
    stats = stored(docs.select(F.col(key).alias("_key"), statistics_column(F.col(text)).alias("stats")), "quality-stats")
    y = (labels.filter(F.col(label).isNotNull()).select(F.col(key).alias("_key"), F.col(label))
         .groupBy("_key").agg(F.avg(label).cast("double").alias("y")))
    known = stored(stats.join(y, "_key").withColumnRenamed("_key", key).filter(~held_out)
                   .select("stats", "y", F.coalesce(calibrate, F.lit(False)).alias("calibrate")), "quality-train")
    model = fit(known)
    return (stats.withColumnRenamed("_key", key)
            .select(key, F.coalesce(held_out, F.lit(False)).alias("held_out"), _apply(model.score, "stats").alias("score"))
            .withColumn("predicted", (F.col("score") >= threshold).cast("int")))
