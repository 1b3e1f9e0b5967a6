"""The tree learner against brute force, and its distributed steps against the local ones."""

import itertools
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from hearth.operators import ml, trees
from hearth.session import scratch_path

FEATURES = ["a", "b", "c"]


def table(spark, n=400, seed=1, nulls=False):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        a, b, c = r.randint(0, 12), r.randint(0, 5), r.choice([0, 1])
        y = 100 * (a > 6) + 10 * b * c + r.randint(0, 9)
        rows.append((i, None if nulls and i % 11 == 0 else float(a), float(b), float(c), float(y)))
    return spark.createDataFrame(rows, "id long, a double, b double, c double, price double")


def plain(depth=None, trees_=1, **options):
    return ml.forest_estimator(trees_, depth, bootstrap=False, **options)


def brute_tree(rows, depth, l2=0.0, min_child=1.0):
    """Exhaustive search over all cuts; returns a function of a row. rows: (x, y)."""
    n, s = len(rows), sum(y for _, y in rows)
    value = s / (n + l2)
    best = (1e-10 * (s * s / (n + l2)), None)
    for j in range(len(rows[0][0])):
        for cut in sorted({x[j] for x, _ in rows})[:-1]:
            left = [y for x, y in rows if x[j] <= cut]
            hl, sl = len(left), sum(left)
            gain = sl * sl / (hl + l2) + (s - sl) ** 2 / (n - hl + l2) - s * s / (n + l2)
            if hl >= min_child and n - hl >= min_child and gain > best[0] + 1e-12 * s * s / (n + l2) * (best[1] is not None):
                best = (gain, (j, cut))
    if best[1] is None or depth == 0:
        return lambda x: value
    j, cut = best[1]
    down = None if depth is None else depth - 1
    low, high = brute_tree([r for r in rows if r[0][j] <= cut], down, l2), brute_tree([r for r in rows if r[0][j] > cut], down, l2)
    return lambda x: low(x) if x[j] <= cut else high(x)


def local(df):
    return [((r.a, r.b, r.c), r.price) for r in df.collect()]


def predictions(model, df):
    return [r.prediction for r in model.transform(df).orderBy("id").collect()]


@pytest.mark.parametrize("depth", [0, 1, 3, None])
@pytest.mark.parametrize("cells", [200_000, 15])
def test_tree_against_brute_force(spark, depth, cells):
    df = table(spark)
    m = ml.fit(df, plain(depth, local_cells=cells), FEATURES)
    f = brute_tree(local(df), depth)
    assert predictions(m, df) == pytest.approx([f((r.a, r.b, r.c)) for r in df.orderBy("id").collect()], rel=1e-12)


def shape(model):
    """Trees as nested tuples: what they are, whatever their nodes' numbers."""
    nodes = {(r.tree, r.id): r for r in model.nodes.collect()}

    def of(t, i):
        r = nodes[t, i]
        if r.feature < 0:
            return (round(r.value, 9), r.cover)
        return (r.feature, r.bin, round(r.gain, 6), r.cover, of(t, r.left), of(t, r.right))
    return [of(t, min(i for u, i in nodes if u == t)) for t in sorted({t for t, _ in nodes})]


@pytest.mark.parametrize("cells", [1, 8, 40])
def test_levels_by_spark_grow_the_same_trees(spark, cells):
    df = table(spark)
    one = shape(ml.fit(df, ml.forest_estimator(4, 6), FEATURES))
    assert shape(ml.fit(df.repartition(7), ml.forest_estimator(4, 6, local_cells=cells), FEATURES)) == one


@pytest.mark.parametrize("l2, cells", [(0.0, 200_000), (1.0, 200_000), (1.0, 20)])
def test_boosting_against_brute_force(spark, l2, cells):
    df = table(spark, 150)
    m = ml.fit(df, ml.boosted_estimator(4, 2, 0.3, l2, local_cells=cells), FEATURES)
    rows = local(df)
    base = sum(y for _, y in rows) / len(rows)
    now = [base] * len(rows)
    for _ in range(4):
        f = brute_tree([(x, y - p) for (x, y), p in zip(rows, now)], 2, l2)
        now = [p + 0.3 * f(x) for (x, _), p in zip(rows, now)]
    got = {r.id: r.prediction for r in m.transform(df).collect()}
    assert [got[r.id] for r in df.collect()] == pytest.approx(now, rel=1e-9)


def test_bags_are_poisson_and_belong_to_rows(spark):
    w = trees.bag_weights(np.arange(20_000, dtype=np.uint64) * np.uint64(7919), 50, 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02 and abs((w == 0).mean() - math.exp(-1)) < 0.005
    assert abs(np.corrcoef(w[:, 0], w[:, 1])[0, 1]) < 0.03
    df = table(spark)
    a, b = (shape(ml.fit(x, ml.forest_estimator(3, 4), FEATURES)) for x in (df, df.orderBy(F.rand(5)).repartition(9)))
    assert a == b and a != shape(ml.fit(df, ml.forest_estimator(3, 4, seed=7), FEATURES))


def test_folds_grown_together_equal_folds_fitted_alone(spark):
    df = table(spark)
    settings = ml.forest_estimator(6, 5)
    got = ml.cross_validate(df, settings, k=3, features=FEATURES).orderBy("fold").collect()
    f = df.withColumn("fold", ml.fold_of(3))
    for r in got:
        m = ml.fit(f.filter(F.col("fold") != r.fold), settings, FEATURES)
        want = ml.regression_metrics(m.transform(f.filter(F.col("fold") == r.fold)).withColumnRenamed("price", "label")).first()
        assert r.n == want.n and r.r2 == pytest.approx(want.r2, abs=1e-9)
    small = ml.cross_validate(df.repartition(5), ml.forest_estimator(6, 5, local_cells=25), k=3, features=FEATURES).orderBy("fold").collect()
    assert [r.r2 for r in small] == pytest.approx([r.r2 for r in got], abs=1e-9)


def test_boosted_and_linear_folds(spark):
    df = table(spark)
    f = df.withColumn("fold", ml.fold_of(3))
    for e in (ml.boosted_estimator(3, 2, 0.3), ml.linear_estimator()):
        for r in ml.cross_validate(df, e, k=3, features=FEATURES).collect():
            m = ml.fit(f.filter(F.col("fold") != r.fold), e, FEATURES)
            want = ml.regression_metrics(m.transform(f.filter(F.col("fold") == r.fold)).withColumnRenamed("price", "label")).first()
            assert r.r2 == pytest.approx(want.r2, abs=1e-9)


def test_scoring_by_joins_and_chunks(spark):
    df = table(spark, nulls=True)
    m = ml.fit(df, ml.forest_estimator(5, 6), FEATURES)
    whole = predictions(m, df)
    for options in ({"chunk_bytes": 6_000}, {"model_bytes": 0}, {"chunk_bytes": 100}):
        got = {r.id: r.prediction for r in m.transform(df, **options).collect()}
        assert [got[i] for i in sorted(got)] == pytest.approx(whole, rel=1e-12)


def test_large_models_meet_distinct_cells(spark, monkeypatch):
    """A model over the limit scores and explains by the rows' distinct cells, in pieces, and not row by row and level by level."""
    df = table(spark, nulls=True)
    m = ml.fit(df, ml.forest_estimator(5, 6), FEATURES)
    met = []
    own = trees.over_trees
    monkeypatch.setattr(trees, "over_trees", lambda model, cells, width, work: met.append(cells.count()) or own(model, cells, width, work))
    monkeypatch.setattr(trees, "TOLD", 7)
    monkeypatch.setattr(trees, "CHUNK_CELLS", 50)
    whole = predictions(m, df)
    got = {r.id: r.prediction for r in m.transform(df, model_bytes=0).collect()}
    assert [got[i] for i in sorted(got)] == pytest.approx(whole, rel=1e-12)
    few = m.impute(df.filter("id < 30"))
    want = {r.id: r["__phi"] for r in trees.attributions(m, few).collect()}
    phi = {r.id: r["__phi"] for r in trees.attributions(m, few, model_bytes=0).collect()}
    assert phi.keys() == want.keys() and all(phi[i] == pytest.approx(want[i], rel=1e-9, abs=1e-9) for i in phi)
    assert len(met) == 2 and met[0] <= 13 * 6 * 2


def test_packed_sums_are_those_of_the_rows(spark):
    """A forest's sums travel many cells to a record, not a row per tree and cell."""
    df = table(spark)
    rows = df.select("a", "b", "c", F.col("price").alias("label"), F.xxhash64("id").alias("row_hash"), (F.col("id") % 3).cast("int").alias("fold"))
    edges = trees.bin_edges(rows, FEATURES, 256)
    settings = ml.forest_estimator(4, 3)
    plain_sums = {}
    for r in trees.root_cells(rows, FEATURES, edges, settings).collect():
        plain_sums[r.tree, bytes(r.cell)] = (r.h, r.s)
    packed = trees.packed_cells(trees._with_cells(rows, FEATURES, edges), 3, settings).collect()
    got = {}
    for r in packed:
        cells = [r.cells[i:i + 6] for i in range(0, len(r.cells), 6)]
        for c, h, s in zip(cells, np.frombuffer(r.h, np.float32), np.frombuffer(r.s, float)):
            a, b = got.get((r.tree, bytes(c)), (0, 0))
            got[r.tree, bytes(c)] = (a + h, b + s)
    assert got.keys() == plain_sums.keys() and all(got[k] == pytest.approx(plain_sums[k], rel=1e-12) for k in got)
    assert len(packed) < len(plain_sums) / 4


def test_tables_and_sorted_runs_find_the_same_cuts():
    """Deep levels have more (node, bin) slots than cells; both ways split alike, down to pure leaves."""
    r = np.random.default_rng(3)
    bins, _ = trees._distinct(r.integers(0, (300, 5, 2), (3000, 3)))
    y = (bins[:, 0] * 7 % 31 + bins[:, 1] * 3).astype(float)
    nodes, leaf = trees.grow_group(bins, np.ones(len(y)), y, ml.forest_estimator(1, None), None)
    assert np.abs(nodes["value"][leaf] - y).max() < 1e-9 and len(nodes["left"]) > 1000
    inner = nodes["feature"] >= 0
    assert (nodes["cover"][inner] == nodes["cover"][nodes["left"][inner]] + nodes["cover"][nodes["right"][inner]]).all()


def test_save_load(spark):
    df = table(spark)
    m = ml.fit(df, ml.boosted_estimator(3, 3, 0.3, 1.0), FEATURES)
    back = ml.load_model(ml.save_model(m, scratch_path(spark, "tree-model")))
    assert isinstance(back, trees.TreeModel) and predictions(back, df) == predictions(m, df) and back.settings == m.settings


def test_odd_tables(spark):
    empty = table(spark, 0)
    for e in (ml.forest_estimator(2, 3), ml.boosted_estimator(2, 2, 0.3)):
        m = ml.fit(empty, e, FEATURES)
        assert [r.prediction for r in m.transform(table(spark, 3)).collect()] == [None] * 3
    same = table(spark, 50).withColumn("price", F.lit(5.0))
    assert set(predictions(ml.fit(same, ml.forest_estimator(2, None), FEATURES), same)) == {5.0}
    some = table(spark, 60).withColumn("price", F.when(F.col("id") % 3 > 0, F.col("price")))
    assert predictions(ml.fit(some, plain(2), FEATURES), some) == pytest.approx(predictions(ml.fit(some.filter("price IS NOT NULL"), plain(2), FEATURES), some))
    constant = table(spark, 30).withColumns({c: F.lit(1.0) for c in FEATURES})
    assert len(set(predictions(ml.fit(constant, plain(4), FEATURES), constant))) == 1


def test_wide_features_are_cut_at_quantiles(spark):
    df = spark.range(5000).select("id", (F.col("id") * 1.5).alias("a"), F.lit(1.0).alias("b"), (F.col("id") % 7).cast("double").alias("price"))
    edges = trees.bin_edges(df, ["a", "b"], 64)
    assert 55 <= len(edges[0]) <= 63 and edges[0] == sorted(edges[0]) and edges[1] == []
    assert np.bincount(trees.to_bins(np.array([[r.a, r.b] for r in df.collect()]), edges)[:, 0]).max() < 200


def value(nodes, i, x, known):
    r = nodes[i]
    if r.feature < 0:
        return r.value
    if r.feature in known:
        return value(nodes, r.right if x[r.feature] > r.bin else r.left, x, known)
    return sum(nodes[c].cover * value(nodes, c, x, known) for c in (r.left, r.right)) / r.cover


@pytest.mark.parametrize("chunk_bytes", [32 << 20, 2_000])
def test_attribution_against_the_definition(spark, chunk_bytes):
    df = table(spark, nulls=True)
    m = ml.fit(df, ml.forest_estimator(3, 5), FEATURES)
    rows = trees.attributions(m, m.impute(df.limit(25)), chunk_bytes).collect()
    per = {}
    for r in m.nodes.collect():
        per.setdefault(r.tree, {})[r.id] = r
    for row in rows:
        x = trees.to_bins(np.array([[row[f"__imp_{f}"] for f in FEATURES]], float), m.edges)[0].astype(int)
        for j in range(3):
            rest = [i for i in range(3) if i != j]
            want = np.mean([sum(math.factorial(len(s)) * math.factorial(2 - len(s)) / 6 * (value(t, 1 << 32, x, {*s, j}) - value(t, 1 << 32, x, set(s)))
                                for k in range(3) for s in itertools.combinations(rest, k)) for t in per.values()])
            assert row["__phi"][2 + j] == pytest.approx(want, rel=1e-9, abs=1e-9)
        assert sum(row["__phi"][2:]) + row["__phi"][0] == pytest.approx(row["__phi"][1], rel=1e-12)


def test_attribution_of_twenty_features(spark):
    r = np.random.default_rng(2)
    x = r.integers(0, 6, (600, 20))
    y = x[:, :10].sum(axis=1) * 3 + x[:, 3] * x[:, 11]
    names = [f"x{i}" for i in range(20)]
    df = spark.createDataFrame([(i, *map(float, a), float(b)) for i, (a, b) in enumerate(zip(x, y))], ", ".join(["id long", *[f"{n} double" for n in names], "price double"]))
    m = ml.fit(df, ml.boosted_estimator(8, 6, 0.3, 1.0), names)
    got = ml.shapley_values(m, df, names, n_explain=None)
    scored = {s.id: s.prediction for s in m.transform(df).collect()}
    per = got.groupBy("row_id", "base_value").agg(F.sum("contribution").alias("s"), F.count("*").alias("n")).collect()
    assert len(per) == 600 and all(p.n == 20 and p.base_value + p.s == pytest.approx(scored[p.row_id], rel=1e-9) for p in per)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and "Cartesian" not in plan


def test_importance_of_one_split(spark):
    df = table(spark)
    imp = {r.feature: r.importance for r in ml.feature_importance(ml.fit(df, plain(1), FEATURES), FEATURES).collect()}
    assert imp == {"a": 1.0, "b": 0.0, "c": 0.0}
