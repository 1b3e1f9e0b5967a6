"""Quality classifier: pieces against brute force, held-out accuracy."""

import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from hearth.llm import quality_classifier as q
from hearth.llm.common import table
from hearth.llm.queries import QUERIES
from tests.llm.util import SF, docs, sample_docs, tables_dir

LABELS = "doc_id bigint, quality int, toxic int"


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    got = QUERIES["op5_rff_quality"](spark, sf)
    rows = got.join(table(spark, sf, "labels"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)
    test = [r for r in rows if r.held_out]
    good = [r.predicted for r in test if r.quality == 1]
    bad = [r.predicted for r in test if r.quality == 0]
    print("kept good", np.mean(good), "kept bad", np.mean(bad), len(good), len(bad))
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.1
    # Calibration: the mean score is near the share of good ones.
    assert abs(np.mean([r.score for r in test]) - np.mean([r.quality for r in test])) < 0.03


def test_labels_of_held_out_rows_are_not_used(spark, tmp_path):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    other = labels.withColumn("quality", F.when(out, 1 - F.col("quality")).otherwise(F.col("quality")))
    a = QUERIES["op5_rff_quality"](spark, tables_dir(tmp_path, spark, documents=d, labels=labels))
    second = tmp_path / "second"
    second.mkdir()
    b = QUERIES["op5_rff_quality"](spark, tables_dir(second, spark, documents=d.withColumn("source", F.lit("x")), labels=other))
    a, b = ({r.doc_id: r.score for r in x.collect()} for x in (a, b))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


def test_awkward_tables(spark, tmp_path):
    df = sample_docs(spark, 30)
    odd = spark.createDataFrame([(0, None, 0), (0, 1, 0), (1, 0, None), (None, 1, 0), (10_002, 0, 1), (10_002, 1, 1), (10_004, 0, 0)], LABELS)
    got = QUERIES["op5_rff_quality"](spark, tables_dir(tmp_path, spark, documents=df, labels=odd)).collect()
    assert len(got) == 42 and all(0 <= r.score <= 1 for r in got)
    assert len({r.score for r in got if r.doc_id == 10_004}) == 1
    none = spark.createDataFrame([], LABELS)
    assert {r.score for r in q.quality_scores(df, none, F.lit(False), F.lit(True)).collect()} == {0.5}
    assert q.quality_scores(docs(spark, []), odd, F.lit(False), F.lit(True)).count() == 0


def test_normal_equations_against_least_squares(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, len(q.STATISTICS)))
    y = (x[:, 0] > 0).astype(float)
    rows = spark.createDataFrame([(a.tolist(), float(b), False) for a, b in zip(x, y)], "stats array<double>, y double, calibrate boolean").repartition(5)
    model = q.fit(rows, features=40, ridge=0.1)
    z = model.transform(x)
    penalty = np.diag([0.1 * 200 / 40] * 40 + [0])
    assert np.allclose(model.weights, np.linalg.solve(z.T @ z + penalty, z.T @ y), atol=1e-6)
    # The features' products approximate a Gaussian kernel.
    wide = q.Model(np.zeros(20), np.ones(20), np.zeros(20_001), np.zeros(0), np.zeros(0), 20_000, 1)
    f = wide.transform(x[:20])[:, :-1]
    near = np.exp(-((x[:20, None] - x[None, :20]) ** 2).sum(axis=2) / (2 * 20))
    assert np.abs(f @ f.T - near).max() < 0.05


@settings(deadline=None, max_examples=50)
@given(st.lists(st.tuples(st.floats(0, 1), st.integers(1, 5)), min_size=1, max_size=12))
def test_isotonic(pairs):
    v, w = map(np.array, zip(*pairs))
    got = q.pool_adjacent(v, w.astype(float))
    assert (np.diff(got) >= -1e-12).all()
    # Minimax formula.
    avg = lambda i, j: np.average(v[i:j + 1], weights=w[i:j + 1])
    n = len(v)
    want = [max(min(avg(i, j) for j in range(k, n)) for i in range(k + 1)) for k in range(n)]
    assert np.allclose(got, want)


def test_statistics_of_odd_texts():
    for data in (b"", b" ", b"\n\n", b"word", "é😀".encode(), b"a" * 100_000, b"x y " * 20_000):
        s = q.statistics(data)
        assert len(s) == len(q.STATISTICS) and np.isfinite(s).all()
    assert pytest.approx(q.statistics(b"AB cd")[4]) == 0.5
