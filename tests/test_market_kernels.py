"""Correlation blocks, fast Gauss transform and Poisson bootstrap against their definitions."""

import contextlib
import hashlib
import io
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import market as mk
from tests.conftest import SF_SMALL
from hearth.sources import fixtures as sfx


def plan(df):
    with contextlib.redirect_stdout(io.StringIO()) as text:
        df.explain()
    return text.getvalue()


def test_correlation_of_holes_and_constants(spark):
    r = np.random.default_rng(4)
    x = r.normal(1e6, 1, (500, 5))
    x[:, 1] += x[:, 0]
    x[:, 3] = 7.0
    holes = r.random((500, 5)) < 0.3
    holes[:, 0] = False
    holes[250:, 4], holes[:250, 2] = True, True  # columns 2 and 4 never meet
    rows = [tuple(None if h else float(v) for v, h in zip(a, b)) for a, b in zip(x, holes)]
    cols = [f"c{i}" for i in range(5)]
    df = spark.createDataFrame(rows, ", ".join(f"{c} double" for c in cols)).repartition(6)
    got = {(q.col_a, q.col_b): q.r for q in mk.correlation_matrix(df, cols).collect()}
    assert len(got) == 25
    for i in range(5):
        for j in range(5):
            both = ~holes[:, i] & ~holes[:, j]
            a, b = x[both, i], x[both, j]
            if len(a) < 2 or a.min() == a.max() or b.min() == b.max():
                assert got[f"c{i}", f"c{j}"] is None
            else:
                assert got[f"c{i}", f"c{j}"] == pytest.approx(1.0 if i == j else np.corrcoef(a, b)[0, 1], abs=1e-9)


def test_correlation_does_not_fan_out(spark):
    df = sfx.sales(spark, SF_SMALL)
    p = plan(mk.correlation_matrix(df))
    above, below = p.split("HashAggregate", 1)
    assert "Generate" in above and "Generate" not in below and p.count("MapInArrow") == 1  # pairs are mirrored above the aggregate
    empty = mk.correlation_matrix(df.limit(0), ["price", "grade"]).collect()
    assert len(empty) == 4 and all(r.r is None for r in empty)


@pytest.mark.parametrize("case", ["spread", "outlier", "equal ends"])
def test_density_against_the_definition(spark, case):
    r = np.random.default_rng(5)
    x = {"spread": r.lognormal(3, 0.5, 700), "outlier": np.r_[r.normal(0, 1, 300), 1e5], "equal ends": np.r_[np.zeros(40), np.ones(60)]}[case]
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "price double").repartition(5)
    got = mk.price_density(df).orderBy("i").collect()
    bw = x.std(ddof=1) * len(x) ** -0.2
    grid = np.linspace(x.min() - 3 * bw, x.max() + 3 * bw, 200)
    want = np.exp(-0.5 * ((grid[:, None] - x[None]) / bw) ** 2).sum(axis=1) / (len(x) * bw * math.sqrt(2 * math.pi))
    assert [g.x for g in got] == pytest.approx(grid.tolist(), rel=1e-12, abs=1e-9)
    assert np.abs(np.array([g.density for g in got]) - want).max() < 1e-12 / bw


def test_density_bounds_and_odd_tables(spark):
    h = mk.CELL / 2
    assert 1.09 * sum(h ** k / math.sqrt(math.factorial(k)) for k in range(mk.MOMENTS, 60)) < 2e-14 and math.exp(-mk.REACH ** 2 / 2) < 3e-20
    assert mk._hermite(5) == [[1], [0, 1], [-1, 0, 1], [0, -3, 0, 1], [3, 0, -6, 0, 1]]
    one = spark.createDataFrame([(3.0,)] * 5, "price double")
    for df in (one, one.limit(0), one.limit(1)):
        assert all(r.density is None for r in mk.price_density(df).collect())


def test_density_rows_are_not_fanned_out(spark):
    """Rows are grouped to cells before any grid point is made."""
    p = plan(mk.price_density(sfx.sales(spark, SF_SMALL))).split("Generate")
    assert len(p) > 1 and "__cell" in "".join(p[1:])


def test_bootstrap_is_repeatable_and_near_the_normal_form(spark):
    df = sfx.sales(spark, SF_SMALL)
    a, b = ({r.grade: r for r in mk.grade_price_bootstrap(x).collect()} for x in (df, df.orderBy(F.rand(2)).repartition(9)))
    normal = {r.grade: r for r in mk.grade_price_bar(df).collect()}
    assert a.keys() == b.keys() == normal.keys()
    for g, r in a.items():
        assert (r.ci_low, r.ci_high) == pytest.approx((b[g].ci_low, b[g].ci_high), rel=1e-12) and r.n == normal[g].n
        if r.n >= 50:  # 1,000 replicates: the width within a tenth or so of the closed form
            assert (r.ci_high - r.ci_low) / (normal[g].ci_high - normal[g].ci_low) == pytest.approx(1, abs=0.15)
            assert r.ci_low < r.avg_price < r.ci_high


def test_hashes_of_many_keys():
    for length in (0, 1, 4, 9, 40, 51, 52, 70):
        keys = np.random.default_rng(length).integers(0, 256, (20, length)).astype(np.uint8)
        for suffix in (b"-42-0", b"-42-124"):
            words = np.column_stack(mk.md5_words(keys, suffix)).astype("<u4")
            assert [w.tobytes() for w in words] == [hashlib.md5(k.tobytes() + suffix).digest() for k in keys]


def test_bootstrap_sums_by_hand_and_without_a_row_per_draw(spark):
    """Sums against hashes taken one by one; rows are not fanned out to replicates."""
    rows = [(i * 37, "ab"[i % 3 > 0], i / 4) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, grade string, price double")
    steps = mk.poisson_steps()
    want = {}
    for i, g, y in rows:
        for b in range(11):
            h = hashlib.md5(f"{i}-42-{b // 8}".encode()).hexdigest()
            w = sum(int(h[4 * (b % 8):4 * (b % 8) + 4], 16) >= t for t in steps)
            a = want.get((g, b), (0, 0.0))
            want[g, b] = (a[0] + w, a[1] + w * y)
    sums = mk.bootstrap_sums(df, "grade", "price", 11)
    got = {(r.grade, r.replicate): (r.weight, r.total) for r in sums.collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-12) for k in got)
    assert "Generate" not in plan(sums)


def test_bootstrap_weights(spark):
    df = spark.range(20_000).select("id", F.lit(1).alias("grade"), F.lit(2.0).alias("price"))
    sums = mk.bootstrap_sums(df, "grade", "price", 20).collect()
    assert sorted(s.replicate for s in sums) == list(range(20)) and all(s.total == 2 * s.weight for s in sums)
    assert abs(np.mean([s.weight for s in sums]) / 20_000 - 1) < 0.01 and 60 < np.std([s.weight for s in sums]) < 260
    odd = spark.createDataFrame([(1, None, 2.0), (None, 1, 2.0), (2, 1, None)], "id long, grade int, price double")
    assert mk.bootstrap_sums(odd, "grade", "price", 8).count() == 0
    assert [(r.grade, r.n, r.ci_low) for r in mk.grade_price_bootstrap(odd, replicates=8).collect()] == [(1, 1, None)]


def round_bins(values, bins):
    """All round widths from small to large, the first that is coarse enough."""
    lo, hi = min(values), max(values)
    for k in range(-12, 12):
        for m in (2, 5, 10):
            w = m * 10.0 ** k if k >= 0 else m / 10.0 ** -k
            first, last = math.floor(lo / w), math.floor(hi / w)
            if last - first + 1 <= bins:
                return [(i - first, i * w, (i + 1) * w, sum(math.floor(v / w) == i for v in values))
                        for i in range(first, last + 1)]


@pytest.mark.parametrize("values, bins", [
    ([78_000.0, 120_500.0, 450_000.0, 450_000.0, 7_700_000.0], 50),
    ([-3.2, -0.1, 0.0, 0.4, 9.9], 7),
    ([0.001, 0.0035, 0.0099], 4),
    ([0.0, 100.0], 50),  # the rough width is itself round, but its bins are one too many
    ([1.0, 1000.0], 2),
    ([-1.0, 1.0], 2),
    ([0.0, 10.0], 10),
    ([999_999.5, 1_000_000.5], 3),
])
def test_round_histogram(spark, values, bins):
    df = spark.createDataFrame([(v,) for v in values] + [(None,), (float("nan"),)], "price double")
    got = [tuple(r) for r in mk.round_histogram(df.repartition(3), bins=bins).orderBy("bin").collect()]
    assert got == round_bins(values, bins)
    assert sum(r[3] for r in got) == len(values) and len(got) <= bins


def test_round_histogram_edges(spark):
    t = "price double"
    assert mk.round_histogram(spark.createDataFrame([], t)).count() == 0
    assert mk.round_histogram(spark.createDataFrame([(None,), (float("nan"),)], t)).count() == 0
    assert [tuple(r) for r in mk.round_histogram(spark.createDataFrame([(0.0,)] * 3, t)).collect()] == [(0, 0.0, 10.0, 3)]
    assert [tuple(r) for r in mk.round_histogram(spark.createDataFrame([(-437.0,)] * 2, t)).collect()] == [(0, -500.0, -400.0, 2)]
    with pytest.raises(Exception, match="infinite"):
        mk.round_histogram(spark.createDataFrame([(1.0,), (float("inf"),)], t)).collect()
    with pytest.raises(ValueError):
        mk.round_histogram(spark.createDataFrame([(1.0,)], t), bins=1)
