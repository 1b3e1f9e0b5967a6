"""Property checks for the model operators (fast tree settings)."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from hearth.operators import ml
from hearth.schema import MODEL_FEATURES
from hearth.sources import fixtures as sfx


@pytest.fixture(scope="module")
def sales(spark):
    return sfx.sales(spark, SF_SMALL).cache()


def test_split_disjoint_covering_repartition_stable(sales):
    train, test = ml.split(sales)
    a = {r.id for r in train.select("id").collect()}
    b = {r.id for r in test.select("id").collect()}
    assert not (a & b) and len(a | b) == sales.count()
    assert 0.15 < len(b) / (len(a) + len(b)) < 0.25
    _, test7 = ml.split(sales.repartition(7))
    assert {r.id for r in test7.select("id").collect()} == b


def test_linear_recovers_plane(spark):
    rows = [(i, float(a), float(b), 3.0 * a + 2.0 * b + 1.0) for i, (a, b) in
            enumerate((x % 17, (x * 7) % 13) for x in range(200))]
    df = spark.createDataFrame(rows, "id long, a double, b double, price double")
    m = ml.fit(df, ml.linear_estimator(), ["a", "b"])
    lr = m.stages[-1]
    assert lr.coefficients.toArray() == pytest.approx([3.0, 2.0], abs=1e-9)
    assert lr.intercept == pytest.approx(1.0, abs=1e-9)
    met = ml.regression_metrics(m.transform(df).withColumn("label", F.col("price"))).first()
    assert met.r2 == pytest.approx(1.0, abs=1e-12) and met.mae == pytest.approx(0.0, abs=1e-8)


def test_train_models_and_compare(sales):
    tr = ml.train_models(sales, fast=True)
    cmp = ml.compare_models(tr).collect()
    assert len(cmp) == 4 and sum(r.best for r in cmp) == 1
    best = [r for r in cmp if r.best][0]
    assert best.r2 == max(r.r2 for r in cmp)
    imp = ml.feature_importance(tr.models["Random Forest"], tr.features).collect()
    assert sum(r.importance for r in imp) == pytest.approx(1.0) and all(r.importance >= 0 for r in imp)


def test_prepare_features_requires_two(sales):
    with pytest.raises(ml.TooFewFeatures):
        ml.prepare_features(sales.select("id", "price", "grade"))
    df, feats = ml.prepare_features(sales)
    assert feats == MODEL_FEATURES and df.filter(F.col("features").isNull()).count() == 0


def test_save_load_same_predictions(spark, sales):
    from hearth.session import scratch_path
    train, test = ml.split(sales)
    m = ml.fit(train, ml.forest_estimator(5, 4))
    p = ml.save_model(m, scratch_path(spark, "model-test"))
    back = ml.load_model(p)
    a = [r.prediction for r in m.transform(test).orderBy("id").collect()]
    b = [r.prediction for r in back.transform(test).orderBy("id").collect()]
    assert a == b


def test_cross_validate_shape(sales):
    cv = ml.cross_validate(sales, ml.linear_estimator(), k=5).collect()
    assert sorted(r.fold for r in cv) == [0, 1, 2, 3, 4]
    scores = np.array([r.r2 for r in cv])
    assert cv[0].mean_r2 == pytest.approx(scores.mean()) and cv[0].std_r2 == pytest.approx(scores.std())


def test_cross_validate_scores_each_fold_once(sales):
    cv = ml.cross_validate(sales, ml.forest_estimator(5, 4), k=3).collect()
    assert sorted(r.fold for r in cv) == [0, 1, 2] and sum(r.n for r in cv) == sales.count()
    assert cv[0].std_r2 == pytest.approx(np.std([r.r2 for r in cv]))


def test_metrics_against_numpy_in_one_pass(spark, sales):
    import contextlib
    import io
    df = sales.selectExpr("price AS label", "sqft_living * 100.0 + grade AS prediction", "grade")
    m = ml.regression_metrics(df).first()
    y, p = (np.array([r[i] for r in df.collect()], float) for i in (0, 1))
    assert m.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum(), rel=1e-9)
    assert m.mae == pytest.approx(np.abs(y - p).mean()) and m.n == len(y)
    assert ml.regression_metrics(df, by=["grade"]).count() == sales.select("grade").distinct().count()
    with contextlib.redirect_stdout(io.StringIO()) as text:
        ml.regression_metrics(df).explain()
    assert text.getvalue().count("InMemoryTableScan") == 1


def test_predict_by_name(sales):
    train, test = ml.split(sales)
    models = {ml.FOREST: ml.fit(train, ml.forest_estimator(3, 3)), "Linear Regression": ml.fit(train, ml.linear_estimator())}
    forest, line, other = ([r.prediction for r in ml.predict(models, test, n).orderBy("id").collect()] for n in (ml.FOREST, "Linear Regression", "?"))
    assert forest == other and forest != line


def test_linear_shapley_adds_up(sales):
    train, test = ml.split(sales)
    m = ml.fit(train, ml.linear_estimator())
    v = ml.linear_shapley(m, test, train, MODEL_FEATURES, n_explain=20)
    per = v.groupBy("row_id", "base_value", "prediction").agg(F.sum("contribution").alias("s")).collect()
    assert len(per) == 20 and all(r.s == pytest.approx(r.prediction - r.base_value, rel=1e-9, abs=1e-6) for r in per)


def test_one_hot_drops_first_level(spark):
    df = spark.createDataFrame([(1, "Large"), (2, "Small"), (3, "Medium")], "id long, c string")
    out = ml.one_hot(df, "c")
    assert out.columns == ["id", "c_Medium", "c_Small"]
    assert ml.one_hot(df, "c", ["Large", "Medium", "Small", "Tiny"]).columns == ["id", "c_Medium", "c_Small", "c_Tiny"]
    got = {r.id: (r.c_Medium, r.c_Small) for r in out.collect()}
    assert got == {1: (0, 0), 2: (0, 1), 3: (1, 0)}


def test_stored_fits_follow_data_and_parameters(spark, sales):
    train, test = ml.split(sales)
    a = ml.fit_stored(train, ml.forest_estimator(3, 3))
    b = ml.fit_stored(train, ml.forest_estimator(3, 3))
    assert a.path == b.path
    assert ml.fit_stored(train, ml.forest_estimator(3, 2)).path != a.path
    assert ml.fit_stored(train.filter("id % 9 > 0"), ml.forest_estimator(3, 3)).path != a.path
    assert [r.prediction for r in a.transform(test).orderBy("id").collect()] == [r.prediction for r in ml.fit(train, ml.forest_estimator(3, 3)).transform(test).orderBy("id").collect()]
