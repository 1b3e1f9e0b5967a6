"""Registered queries: models. Split, encodings, scaling, the one-feature
least-squares fits (also predicted, validated, saved, explained), the
metrics and small trees (the best cut over all cuts, second-order leaf values, a tree's importances, its
predictions) are checked against SQL values; queries on tree models at full settings also return what
must hold of their whole result, and the SQL says that it does. Equal fits of
one run are shared through ``ml.fit_stored``, which reads the training rows to
know that they are equal."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearth.functions.features import size_category
from hearth.operators import ml
from hearth.operators.util import attach, round_doubles
from hearth.plans.registry import register
from hearth.schema import MODEL_FEATURES
from hearth.session import scratch_path
from hearth.sources import fixtures as sfx

TEST = "substr(md5(CAST(id AS VARCHAR) || '-42'), 1, 4) < '3333'"


def _s(spark, d):
    return sfx.sales(spark, d)


@register("split", f"SELECT id, {TEST} AS is_test FROM sales")
def q_split(spark, d):
    return _s(spark, d).select("id", ml.test_flag().alias("is_test"))


@register("one_hot", """
SELECT id, CAST(size_category = 'Medium' AS INTEGER) AS size_category_Medium,
       CAST(size_category = 'Small' AS INTEGER) AS size_category_Small
FROM (SELECT id, CASE WHEN sqft_living < 1500 THEN 'Small' WHEN sqft_living < 3000 THEN 'Medium'
                      ELSE 'Large' END AS size_category FROM sales)""")
def q_one_hot(spark, d):
    s = _s(spark, d).select("id", size_category().alias("size_category"))
    return ml.one_hot(s, "size_category", ["Small", "Medium", "Large"])


@register("one_hot_vectors", """
WITH l AS (SELECT zipcode, row_number() OVER (ORDER BY zipcode) - 1 AS r, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(zipcode AS VARCHAR) AS zipcode FROM sales WHERE zipcode IS NOT NULL))
SELECT id, CAST(n - 1 AS INTEGER) AS size, CASE WHEN r > 0 THEN CAST(r - 1 AS INTEGER) END AS position FROM sales LEFT JOIN l ON CAST(sales.zipcode AS VARCHAR) = l.zipcode""")
def q_one_hot_vectors(spark, d):
    """A column of many levels, as sparse vectors; where the 1 stands."""
    from pyspark.ml.functions import vector_to_array
    v = ml.one_hot_vectors(_s(spark, d).select("id", F.col("zipcode").cast("string").alias("zipcode")), "zipcode", "v")
    a = vector_to_array("v")
    return v.select("id", F.size(a).alias("size"), F.nullif(F.array_position(a, F.lit(1.0)).cast("int"), F.lit(0)).alias("at")).select("id", "size", (F.col("at") - 1).alias("position"))


def _std_sql() -> str:
    feats = MODEL_FEATURES
    stats = ", ".join(f"avg({c}) AS mu_{c}, stddev_pop({c}) AS sd_{c}" for c in feats)
    cols = ", ".join(f"round(({c} - mu_{c}) / CASE WHEN sd_{c} = 0 OR sd_{c} IS NULL THEN 1.0E0 ELSE sd_{c} END, 6)"
                     f" + 0.0E0 AS {c}" for c in feats)
    return (f"WITH st AS (SELECT {stats} FROM sales WHERE NOT ({TEST}))\n"
            f"SELECT id, {cols} FROM sales CROSS JOIN st WHERE {TEST}")


@register("standardize", _std_sql())
def q_standardize(spark, d):
    train, test = ml.split(_s(spark, d).select("id", *MODEL_FEATURES))
    _, t = ml.standardize(train, test, MODEL_FEATURES)
    return round_doubles(t, 6)


@register("fit_linear", f"""
SELECT round(regr_intercept(price, sqft_living), 2) AS intercept, round(regr_slope(price, sqft_living), 6) AS slope,
       count(*) AS n_train
FROM sales WHERE NOT ({TEST})""")
def q_fit_linear(spark, d):
    train, _ = ml.split(_s(spark, d))
    m = ml.fit(train, ml.linear_estimator(), ["sqft_living"], min_features=1)
    lr = m.stages[-1]
    coef = lr.coefficients.toArray()
    n = train.count()
    return spark.createDataFrame(
        [(round(float(lr.intercept), 2), round(float(coef.sum()), 6), n)],
        "intercept double, slope double, n_train bigint")


@register("regression_metrics", f"""
WITH tr AS (SELECT * FROM sales WHERE NOT ({TEST})),
te AS (SELECT * FROM sales WHERE {TEST}),
zm AS (SELECT zipcode, avg(price) AS yhat FROM tr GROUP BY zipcode),
pr AS (SELECT te.price AS y, zm.yhat AS p FROM te JOIN zm ON te.zipcode = zm.zipcode)
SELECT count(*) AS n, round(avg(abs(y - p)), 4) AS mae, round(sqrt(avg((y - p) * (y - p))), 4) AS rmse,
       round(1 - sum((y - p) * (y - p)) / (SELECT sum((y - m) * (y - m)) FROM pr, (SELECT avg(y) AS m FROM pr)), 8) AS r2
FROM pr""")
def q_metrics(spark, d):
    train, test = ml.split(_s(spark, d))
    zm = train.groupBy("zipcode").agg(F.avg("price").alias("prediction"))
    pr = test.join(zm, "zipcode").select(F.col("price").alias("label"), "prediction")
    return round_doubles(ml.regression_metrics(pr), 4, {"r2": 8})


def _scored(model, test):
    return model.transform(test).withColumn("label", F.col("price").cast("double"))


# Cuts between all distinct values, whatever their number here; deeper fits use ml.MAX_BINS.
ALL_CUTS = 65_000


def _small_tree(train, depth: int = 1, **options):
    """One tree over all training rows and all cuts."""
    return ml.fit_stored(train, ml.forest_estimator(1, depth, max_bins=ALL_CUTS, bootstrap=False, **options))


def _first_cut(model) -> tuple:
    """(feature, cut, values left and right, gain) of the first tree's root."""
    nodes = {r.id: r for r in model.nodes.filter("tree = 0").collect()}  # three rows
    root = nodes[min(nodes)]
    return (model.features[root.feature], model.edges[root.feature][root.bin], nodes[root.left].value, nodes[root.right].value, root.gain)


def _fit_check(spark, d, name: str, floor: float, stump):
    """Fit a model at full settings, score the hold-out part, and say what must hold of its metrics; beside it the first cut of a model of depth 1, by value."""
    train, test = ml.split(_s(spark, d))
    met = ml.regression_metrics(_scored(ml.fit_stored(train, ml.estimators()[name]), test))
    feature, cut, left, right, gain = _first_cut(ml.fit_stored(train, stump))
    return round_doubles(met.select(
        "n", (F.col("mae") <= F.col("rmse")).alias("mae_within_rmse"), (F.col("r2") >= floor).alias("r2_reaches_floor"),
        F.lit(feature).alias("cut_feature"), F.lit(cut).alias("cut_at"), F.lit(left).alias("left_value"), F.lit(right).alias("right_value"),
        F.lit(gain / 1e15).alias("gain")), 5, {"gain": 8})


_LONG = " UNION ALL ".join(f"SELECT rid, {j} AS j, '{c}' AS f, CAST({c} AS DOUBLE) AS x, y FROM tr" for j, c in enumerate(MODEL_FEATURES))


def _cuts(rows: str, l2: float, by: str = "") -> str:
    """Every cut of ``rows`` (j, f, x, y and the columns ``by``) with its sums and its gain."""
    own = f"{by}, " if by else ""
    return f"""
  SELECT {own}j, f, (x + nx) / 2 AS cut, sl / (hl + {l2}) AS left_value, (s - sl) / (h - hl + {l2}) AS right_value,
         sl * sl / (hl + {l2}) + (s - sl) * (s - sl) / (h - hl + {l2}) - s * s / (h + {l2}) AS gain
  FROM (SELECT *, sum(n) OVER w AS hl, sum(sx) OVER w AS sl, lead(x) OVER w AS nx,
               sum(n) OVER (PARTITION BY {own}j) AS h, sum(sx) OVER (PARTITION BY {own}j) AS s
        FROM (SELECT {own}j, f, x, count(*) AS n, sum(y) AS sx FROM {rows} GROUP BY {own}j, f, x)
        WINDOW w AS (PARTITION BY {own}j ORDER BY x))
  WHERE nx IS NOT NULL"""


def _first_cut_sql(label: str, l2: float) -> str:
    return f"""
WITH s AS (SELECT *, avg(price) OVER () AS mean FROM sales WHERE NOT ({TEST})),
tr AS (SELECT id AS rid, {label} AS y, {', '.join(MODEL_FEATURES)} FROM s),
long AS ({_LONG}),
best AS (SELECT * FROM ({_cuts("long", l2)}) ORDER BY gain DESC, j, cut LIMIT 1)"""


def _fit_sql(label: str, l2: float) -> str:
    return f"""{_first_cut_sql(label, l2)}
SELECT (SELECT count(*) FROM sales WHERE {TEST}) AS n, true AS mae_within_rmse, true AS r2_reaches_floor, f AS cut_feature, round(cut, 5) AS cut_at,
       round(left_value, 5) AS left_value, round(right_value, 5) AS right_value, round(gain / 1e15, 8) AS gain
FROM best"""


# What the models reach on this fixture at full settings, rounded down.
R2_FLOOR = 0.9


@register("prepare_features", """
SELECT id, coalesce(CAST(bedrooms AS DOUBLE), (SELECT quantile_cont(bedrooms, 0.5) FROM sales)) AS f_bedrooms,
       coalesce(CAST(bathrooms AS DOUBLE), (SELECT quantile_cont(bathrooms, 0.5) FROM sales)) AS f_bathrooms,
       coalesce(CAST(sqft_living AS DOUBLE), (SELECT quantile_cont(sqft_living, 0.5) FROM sales)) AS f_sqft_living,
       coalesce(CAST(floors AS DOUBLE), (SELECT quantile_cont(floors, 0.5) FROM sales)) AS f_floors,
       coalesce(CAST(grade AS DOUBLE), (SELECT quantile_cont(grade, 0.5) FROM sales)) AS f_grade,
       price AS label
FROM sales""")
def q_prepare(spark, d):
    return _unpacked(_s(spark, d))


def _unpacked(sales):
    """The assembled feature vector, unpacked to one column per feature."""
    from pyspark.ml.functions import vector_to_array
    df, feats = ml.prepare_features(sales)
    arr = vector_to_array("features")
    return df.select("id", *[arr[i].alias(f"f_{c}") for i, c in enumerate(feats)], "label")


@register("prepare_features_missing", """
WITH holes AS (SELECT id, price, CASE WHEN id % 7 = 1 THEN NULL ELSE grade END AS grade, bathrooms, floors,
                      CASE WHEN id % 11 = 2 THEN NULL ELSE bedrooms END AS bedrooms,
                      CASE WHEN id % 13 = 3 THEN NULL ELSE sqft_living END AS sqft_living FROM sales),
m AS (SELECT quantile_cont(grade, 0.5) AS g, quantile_cont(bedrooms, 0.5) AS b, quantile_cont(sqft_living, 0.5) AS s FROM holes)
SELECT id, coalesce(CAST(bedrooms AS DOUBLE), b) AS f_bedrooms, CAST(bathrooms AS DOUBLE) AS f_bathrooms,
       coalesce(CAST(sqft_living AS DOUBLE), s) AS f_sqft_living, CAST(floors AS DOUBLE) AS f_floors,
       coalesce(CAST(grade AS DOUBLE), g) AS f_grade, price AS label
FROM holes CROSS JOIN m""")
def q_prepare_missing(spark, d):
    """The same over sales with missing features, so that the medians are used."""
    i = F.col("id")
    return _unpacked(_s(spark, d).withColumns({
        "grade": F.when(i % 7 != 1, F.col("grade")), "bedrooms": F.when(i % 11 != 2, F.col("bedrooms")),
        "sqft_living": F.when(i % 13 != 3, F.col("sqft_living"))}))


@register("fit_forest", _fit_sql("price", 0.0))
def q_fit_forest(spark, d):
    return _fit_check(spark, d, "Random Forest", R2_FLOOR, ml.forest_estimator(1, 1, max_bins=ALL_CUTS, bootstrap=False))


@register("fit_boosted_a", _fit_sql("price - mean", 1.0))
def q_fit_boosted_a(spark, d):
    return _fit_check(spark, d, "XGBoost", R2_FLOOR, ml.boosted_estimator(1, 1, 0.3, 1.0, max_bins=ALL_CUTS))


@register("fit_boosted_b", _fit_sql("price - mean", 0.0))
def q_fit_boosted_b(spark, d):
    return _fit_check(spark, d, "Gradient Boosting", R2_FLOOR, ml.boosted_estimator(1, 1, 0.1, max_bins=ALL_CUTS))


@register("compare_models", f"""
SELECT CAST(r.range AS INTEGER) AS rank, r.range = 1 AS best, (SELECT count(*) FROM sales WHERE {TEST}) AS n, true AS in_order,
       'Gradient Boosting, Linear Regression, Random Forest, XGBoost' AS models
FROM range(1, 5) r""")
def q_compare_models(spark, d):
    """The four models at full settings, ranked; names and order are held as properties."""
    c = ml.compare_models(ml.train_models(_s(spark, d), fitter=ml.fit_stored))
    w = Window.orderBy("rank")  # four rows
    return c.select("rank", "best", "n", F.coalesce(F.lag("r2").over(w) >= F.col("r2"), F.lit(True)).alias("in_order"),
                    F.array_join(F.array_sort(F.collect_set("model").over(Window.partitionBy())), ", ").alias("models"))


@register("predict", f"""{_first_cut_sql("price", 0.0)}
SELECT id, price, true AS in_range, true AS falls_back,
       round(CASE WHEN CASE j {' '.join(f"WHEN {j} THEN CAST({c} AS DOUBLE)" for j, c in enumerate(MODEL_FEATURES))} END <= cut THEN left_value ELSE right_value END, 2) AS by_one_cut
FROM sales CROSS JOIN best WHERE {TEST}""")
def q_predict(spark, d):
    """Every hold-out row by the forest, by name and by a name that is not there: a forest's
    prediction is a mean of training prices, so it lies in their range; and by a tree of one cut."""
    train, test = ml.split(_s(spark, d))
    models = {ml.FOREST: ml.fit_stored(train, ml.forest_estimator()), "Linear Regression": ml.fit(train, ml.linear_estimator())}
    a = ml.predict(models, test, ml.FOREST).select("id", "price", "prediction")
    b = ml.predict(models, test, "no such model").select("id", F.col("prediction").alias("other"))
    c = _small_tree(train).transform(test).select("id", F.round("prediction", 2).alias("by_one_cut"))
    bounds = train.agg(F.min("price").alias("lo"), F.max("price").alias("hi"))
    return attach(a.join(b, "id").join(c, "id"), bounds).select(
        "id", "price", ((F.col("prediction") >= F.col("lo")) & (F.col("prediction") <= F.col("hi"))).alias("in_range"),
        (F.col("prediction") == F.col("other")).alias("falls_back"), "by_one_cut")


LINE = f"SELECT regr_slope(price, sqft_living) AS b, regr_intercept(price, sqft_living) AS a FROM sales WHERE NOT ({TEST})"


@register("predict_linear", f"""
WITH m AS ({LINE}) SELECT id, price, round(a + b * sqft_living, 2) AS prediction FROM sales CROSS JOIN m WHERE {TEST}""")
def q_predict_linear(spark, d):
    train, test = ml.split(_s(spark, d))
    models = {"Linear Regression": ml.fit(train, ml.linear_estimator(), ["sqft_living"], min_features=1)}
    return round_doubles(ml.predict(models, test, "Linear Regression").select("id", "price", "prediction"), 2)


@register("feature_importance", f"""{_first_cut_sql("price", 0.0)},
halves AS (SELECT l.rid, l.x <= b.cut AS low FROM long l JOIN best b USING (j)),
sides AS (SELECT low, j, f, x, y FROM long JOIN halves USING (rid)),
next AS (SELECT * FROM ({_cuts("sides", 0.0, "low")}) QUALIFY row_number() OVER (PARTITION BY low ORDER BY gain DESC, j, cut) = 1),
made AS (SELECT f, gain FROM best UNION ALL SELECT f, gain FROM next)
SELECT feature, round(coalesce((SELECT sum(gain) FROM made WHERE f = feature), 0) / (SELECT sum(gain) FROM made), 8) AS tree_importance,
       true AS forest_in_range, true AS forest_sums_to_one
FROM (SELECT unnest({MODEL_FEATURES!r}) AS feature)""")
def q_importance(spark, d):
    """Shares of a tree of depth 2, by value; beside them what must hold of the forest's at full settings."""
    train, _ = ml.split(_s(spark, d))
    forest = ml.feature_importance(ml.fit_stored(train, ml.forest_estimator()), MODEL_FEATURES)
    small = ml.feature_importance(_small_tree(train, 2), MODEL_FEATURES)
    total = F.sum(F.col("of_forest")).over(Window.partitionBy())  # five rows
    return small.join(forest.withColumnRenamed("importance", "of_forest"), "feature").select(
        "feature", F.round("importance", 8).alias("tree_importance"), F.col("of_forest").between(0, 1).alias("forest_in_range"),
        (F.abs(total - 1) < 1e-9).alias("forest_sums_to_one"))


FOLD = "CAST(floor(CAST(CAST('0x' || substr(md5(CAST(id AS VARCHAR) || '-43'), 1, 8) AS UBIGINT) AS DOUBLE) / 4294967296.0E0 * 5) AS INTEGER)"


@register("cross_validate", f"""
SELECT {FOLD} AS fold, count(*) AS n, true AS r2_reaches_floor, true AS summary_fits FROM sales GROUP BY 1""")
def q_cv(spark, d):
    """5-fold R^2 of the forest at full settings."""
    cv = ml.cross_validate(_s(spark, d))
    every = Window.partitionBy()  # five rows
    return cv.select("fold", "n", (F.col("r2") >= R2_FLOOR).alias("r2_reaches_floor"),
                     ((F.abs(F.avg("r2").over(every) - F.col("mean_r2")) < 1e-9)
                      & (F.abs(F.stddev_pop("r2").over(every) - F.col("std_r2")) < 1e-9)).alias("summary_fits"))


@register("cross_validate_linear", f"""
WITH s AS (SELECT {FOLD} AS fold, price AS y, CAST(sqft_living AS DOUBLE) AS x FROM sales),
m AS (SELECT k.range AS fold, regr_slope(y, x) AS b, regr_intercept(y, x) AS a FROM s JOIN range(5) k ON s.fold <> k.range GROUP BY 1),
e AS (SELECT s.fold, y, y - (a + b * x) AS e FROM s JOIN m USING (fold)),
r AS (SELECT fold, count(*) AS n, 1 - sum(e * e) / (var_pop(y) * count(*)) AS r2 FROM e GROUP BY fold)
SELECT fold, n, round(r2, 8) AS r2, round((SELECT avg(r2) FROM r), 8) AS mean_r2, round((SELECT stddev_pop(r2) FROM r), 8) AS std_r2 FROM r""")
def q_cv_linear(spark, d):
    return round_doubles(ml.cross_validate(_s(spark, d), ml.linear_estimator(), features=["sqft_living"], min_features=1), 8)


@register("save_model", """
SELECT unnest(['org.apache.spark.ml.feature.SQLTransformer', 'org.apache.spark.ml.feature.VectorAssembler',
               'org.apache.spark.ml.regression.LinearRegressionModel']) AS class WHERE (SELECT count(*) FROM sales) > 0""")
def q_save_model(spark, d):
    """Persist the fitted pipeline; the saved stages' classes, read back from the model folder."""
    train, _ = ml.split(_s(spark, d))
    path = ml.save_model(ml.fit(train, ml.linear_estimator()), scratch_path(spark, "models/linear_regression"))
    return spark.read.json(f"{path}/stages/*/metadata").select("class")


@register("load_model", f"""
WITH m AS ({LINE}), p AS (SELECT id, round(a + b * sqft_living, 2) AS p FROM sales CROSS JOIN m WHERE {TEST})
SELECT id, p AS before, p AS after FROM p""")
def q_load_model(spark, d):
    """Save, load, and score the hold-out part with both."""
    train, test = ml.split(_s(spark, d))
    m = ml.fit(train, ml.linear_estimator(), ["sqft_living"], min_features=1)
    back = ml.load_model(ml.save_model(m, scratch_path(spark, "models/linear_regression")))
    a = m.transform(test).select("id", F.col("prediction").alias("before"))
    b = back.transform(test).select("id", F.col("prediction").alias("after"))
    return round_doubles(a.join(b, "id"), 2)


SAMPLE = "ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT"


def _shap(spark, d, n_explain: int):
    """The notebook explains a 100-tree forest without a depth limit on the five features with 100 sampled test rows."""
    train, test = ml.split(_s(spark, d))
    m = ml.fit_stored(train, ml.forest_estimator(100, None))
    values = ml.shapley_values(m, test, MODEL_FEATURES, n_explain)
    scored = ml.predict(m, test).select(F.col("id").alias("row_id"), F.col("prediction").alias("scored"))
    return values, scored


@register("shapley_attribution", f"""
WITH s AS (SELECT id FROM sales WHERE {TEST} {SAMPLE} 100)
SELECT id AS row_id, CAST(5 AS BIGINT) AS n_features, true AS adds_up, true AS same_base FROM s""")
def q_shap(spark, d):
    """Per explained row: base value + contributions = the forest's prediction, and one base value for all."""
    values, scored = _shap(spark, d, 100)
    per = values.groupBy("row_id", "base_value").agg(F.count("*").alias("n_features"), F.sum("contribution").alias("s"))
    base = F.max("base_value").over(Window.partitionBy()) - F.min("base_value").over(Window.partitionBy())  # 100 rows
    return per.join(scored, "row_id").select(
        "row_id", "n_features", (F.abs(F.col("base_value") + F.col("s") - F.col("scored")) <= 1e-9 * F.abs("scored")).alias("adds_up"),
        (base <= 1e-9 * F.col("base_value")).alias("same_base"))


@register("shapley_row", f"""
WITH s AS (SELECT id FROM sales WHERE {TEST} {SAMPLE} 1)
SELECT id AS row_id, 'bathrooms bedrooms floors grade sqft_living' AS features, true AS adds_up, true AS largest_first FROM s""")
def q_shap_row(spark, d):
    """One row's attribution, largest magnitude first; the row is picked before anything is scored."""
    values, scored = _shap(spark, d, 1)
    one = ml.shapley_row(values, values.agg(F.min("row_id")).first()[0])
    w = Window.orderBy(F.monotonically_increasing_id())  # five rows
    one = one.withColumn("larger", F.coalesce(F.abs(F.lag("contribution").over(w)) >= F.abs("contribution"), F.lit(True)))
    per = one.groupBy("row_id", "base_value").agg(
        F.array_join(F.array_sort(F.collect_list("feature")), " ").alias("features"), F.sum("contribution").alias("s"),
        F.bool_and("larger").alias("largest_first"))
    return per.join(scored, "row_id").select(
        "row_id", "features", (F.abs(F.col("base_value") + F.col("s") - F.col("scored")) <= 1e-9 * F.abs("scored")).alias("adds_up"), "largest_first")


@register("shapley_linear", f"""
WITH m AS ({LINE}), t AS (SELECT avg(sqft_living) AS mu FROM sales WHERE NOT ({TEST}))
SELECT id AS row_id, 'sqft_living' AS feature, round(b * (sqft_living - mu), 2) AS contribution, round(a + b * mu, 2) AS base_value
FROM sales CROSS JOIN m CROSS JOIN t WHERE {TEST}""")
def q_shap_linear(spark, d):
    """The closed form of a linear model, for every hold-out row."""
    train, test = ml.split(_s(spark, d))
    m = ml.fit(train, ml.linear_estimator(), ["sqft_living"], min_features=1)
    v = ml.linear_shapley(m, test, train, ["sqft_living"], n_explain=None)
    return round_doubles(v.select("row_id", "feature", "contribution", "base_value"), 2)
