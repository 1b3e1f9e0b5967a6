"""Price models: split, features, fit, evaluate, explain.

Linear models are Spark ML's; forests and boosted trees are grown by
``trees``. The driver holds only fitted parameters. Splits and folds are a
hash of the key, so they do not depend on partitioning and read the same in
SQL. Steps of a tree's growth are written to the shared checkpoint folder, so a
lost executor costs a step, not the lineage.
"""

from __future__ import annotations

import hashlib
from dataclasses import asdict, dataclass
from functools import reduce

import numpy as np
from pyspark.ml import PipelineModel
from pyspark.ml.feature import OneHotEncoder, VectorAssembler
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hearth.operators.clean import impute_median
from hearth.operators.topn import sample_n
from hearth.operators.trees import TreeModel, TreeSettings, attributions, fit_trees, out_of_fold, training_rows
from hearth.operators.util import attach
from hearth.schema import MODEL_FEATURES, TARGET
from hearth.session import ensure_checkpoint_dir, materialize

# The reference's model settings.
RANDOM_STATE = 42
TEST_SIZE = 0.2
FOREST = "Random Forest"
FOREST_TREES, FOREST_DEPTH = 200, 20
BOOSTED_A = dict(maxIter=150, maxDepth=8, stepSize=0.3, l2=1.0)
BOOSTED_B = dict(maxIter=150, maxDepth=6, stepSize=0.1)


# Values a tree may split a feature at. 256 is the default of common boosting
# libraries; Spark's own 32 squeezes a wide feature into 32 values.
MAX_BINS = 256


class TooFewFeatures(ValueError):
    pass


def hash_unit(seed: int = RANDOM_STATE, key: str = "id", digits: int = 8) -> Column:
    """A number in [0, 1) from the hash of (key, seed)."""
    h = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, digits)
    return F.conv(h, 16, 10).cast("double") / float(16 ** digits)


def test_flag(test_size: float = TEST_SIZE, seed: int = RANDOM_STATE, key: str = "id") -> Column:
    """True for the hold-out part: the first four hex digits of the hash
    below ``test_size`` (0.2 -> '3333')."""
    thr = format(int(test_size * 65536), "04x")
    h = F.substring(F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}"))), 1, 4)
    return h < F.lit(thr)


def split(df: DataFrame, test_size: float = TEST_SIZE, seed: int = RANDOM_STATE,
          key: str = "id") -> tuple[DataFrame, DataFrame]:
    t = test_flag(test_size, seed, key)
    return df.filter(~t), df.filter(t)


def fold_of(k: int = 5, seed: int = RANDOM_STATE, key: str = "id") -> Column:
    return F.floor(hash_unit(seed + 1, key) * k).cast("int")


def available_features(df: DataFrame, features: list[str] | None = None,
                       min_features: int = 2) -> list[str]:
    feats = [f for f in (features or MODEL_FEATURES) if f in df.columns]
    if len(feats) < min_features:
        raise TooFewFeatures(f"the table has {len(feats)} of the features {', '.join(features or MODEL_FEATURES)}; needed are {min_features}")
    return feats


def prepare_features(df: DataFrame, features: list[str] | None = None, target: str = TARGET,
                     out: str = "features") -> tuple[DataFrame, list[str]]:
    """Keep the present features (at least two), fill their NULLs with the
    column medians, assemble a vector."""
    feats = available_features(df, features)
    filled = impute_median(df, feats)
    va = VectorAssembler(inputCols=feats, outputCol=out, handleInvalid="keep")
    return va.transform(filled).withColumn("label", F.col(target).cast("double")), feats


#: Levels that become columns at most when the caller does not name them.
MAX_LEVELS = 1000


def one_hot(df: DataFrame, col: str, levels: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Dummy columns for a string column, one per level but the alphabetically
    first (pandas ``get_dummies(drop_first=True)``). ``levels`` is the list
    of known levels; without it the distinct levels are read, at most ``MAX_LEVELS``
    (``one_hot_vectors`` takes any number). A value outside the list has all 0."""
    prefix = prefix or col
    if levels is None:
        levels = [r[0] for r in df.select(col).distinct().filter(F.col(col).isNotNull()).limit(MAX_LEVELS + 1).collect()]
        if len(levels) > MAX_LEVELS:
            raise ValueError(f"{col} has over {MAX_LEVELS} levels; use one_hot_vectors")
    dummies = [F.coalesce(F.col(col) == lab, F.lit(False)).cast("int").alias(f"{prefix}_{lab}") for lab in sorted(levels)[1:]]
    return df.select(*[c for c in df.columns if c != col], *dummies)


def level_dictionary(df: DataFrame, col: str) -> DataFrame:
    """(level, rank) of the non-null levels in ascending order, ranks from 0, as a stored table. Levels are dealt to ranges; a level's rank
    is its place in its range after all levels of the ranges before, so no task holds more than its range."""
    levels = df.select(F.col(col).alias("level")).filter("level IS NOT NULL").distinct()
    ranged = materialize(levels.repartitionByRange("level").select("level", F.spark_partition_id().alias("part")), "levels")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
    offsets = ranged.groupBy("part").count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("offset"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("level"))
    return materialize(ranged.withColumn("place", place).join(offsets, "part").select("level", (F.col("offset") + F.col("place") - 1).alias("rank")), "level-ranks")


def one_hot_vectors(df: DataFrame, col: str, out: str | None = None) -> DataFrame:
    """``df`` with a sparse vector of the dummies that ``one_hot`` would make as columns: position j is 1 for the level of rank
    j + 1; the first level and null have all 0. The levels stay in a table that is joined (by size, Spark's choice), so their number is
    not limited by the driver or the width of a row."""
    ranks = level_dictionary(df, col)
    n = ranks.count()
    name = out or f"{col}_dummies"
    if n < 2:
        return df.withColumn(name, array_to_vector(F.expr("cast(array() as array<double>)")))
    index = ranks.select(F.col("level").alias("__level"), F.pmod(F.col("rank") - 1, F.lit(n)).cast("double").alias("__index"))
    joined = df.join(index, F.col(col) == F.col("__level"), "left").drop("__level").withColumn("__index", F.coalesce("__index", F.lit(float(n - 1))))
    # The encoder drops the last index, which the first level and null have; a table of just that index tells it the size.
    size = df.sparkSession.createDataFrame([(float(n - 1),)], "__index double")
    return OneHotEncoder(inputCols=["__index"], outputCols=[name], dropLast=True).fit(size).transform(joined).drop("__index")


def standardize(train: DataFrame, test: DataFrame, cols: list[str]) -> tuple[DataFrame, DataFrame]:
    """Fit mean and population std on ``train`` (one aggregate), apply to
    both parts through a broadcast one-row frame. A constant column scales
    by 1, as in scikit-learn."""
    stats = train.agg(*[F.avg(c).alias(f"__mu_{c}") for c in cols],
                      *[F.stddev_pop(c).alias(f"__sd_{c}") for c in cols])

    def apply(df: DataFrame) -> DataFrame:
        j = attach(df, stats)
        scaled = []
        for c in df.columns:
            if c in cols:
                sd = F.col(f"__sd_{c}")
                sd = F.when((sd == 0) | sd.isNull(), F.lit(1.0)).otherwise(sd)
                scaled.append(((F.col(c) - F.col(f"__mu_{c}")) / sd).alias(c))
            else:
                scaled.append(F.col(c))
        return j.select(*scaled)

    return apply(train), apply(test)


def linear_estimator():
    return LinearRegression(featuresCol="features", labelCol="label", regParam=0.0,
                            elasticNetParam=0.0, standardization=False, solver="normal")


def forest_estimator(num_trees: int = FOREST_TREES, max_depth: int | None = FOREST_DEPTH,
                     seed: int = RANDOM_STATE, max_bins: int = MAX_BINS, **options) -> TreeSettings:
    """Bagged trees; every split looks at all features, as the reference's
    regression forest does. ``max_depth`` None grows until leaves are pure."""
    return TreeSettings(bagged=True, trees=num_trees, depth=max_depth, seed=seed, max_bins=max_bins, **options)


def boosted_estimator(maxIter: int, maxDepth: int, stepSize: float, l2: float = 0.0, seed: int = RANDOM_STATE,
                      max_bins: int = MAX_BINS, **options) -> TreeSettings:
    """Gradient-boosted trees of the squared loss, from the mean label on; ``l2`` weighs on the leaf
    values and in the gain (second-order boosting with regularised leaves), 0 is plain gradient boosting."""
    return TreeSettings(bagged=False, trees=maxIter, depth=maxDepth, rate=stepSize, l2=l2, seed=seed, max_bins=max_bins, **options)


def estimators(fast: bool = False) -> dict:
    """The reference's four models (``fast`` shrinks the tree settings for
    tests only)."""
    if fast:
        return {"Linear Regression": linear_estimator(),
                "Random Forest": forest_estimator(10, 5),
                "XGBoost": boosted_estimator(5, 3, 0.3, 1.0),
                "Gradient Boosting": boosted_estimator(5, 3, 0.1)}
    return {"Linear Regression": linear_estimator(),
            "Random Forest": forest_estimator(),
            "XGBoost": boosted_estimator(**BOOSTED_A),
            "Gradient Boosting": boosted_estimator(**BOOSTED_B)}


Model = PipelineModel | TreeModel


def fit(df: DataFrame, estimator, features: list[str] | None = None,
        min_features: int = 2) -> Model:
    """Impute + assemble + estimator as one PipelineModel, or a TreeModel for
    tree settings (medians are fitted on ``df``, i.e. on the training part)."""
    ensure_checkpoint_dir(df.sparkSession)
    feats = available_features(df, features, min_features)
    meds = _median_imputer(df, feats)
    if isinstance(estimator, TreeSettings):
        return fit_trees(df, feats, TARGET, estimator, meds)
    va = VectorAssembler(inputCols=[f"__imp_{c}" for c in feats], outputCol="features",
                         handleInvalid="keep")
    train = va.transform(meds.transform(df)).select("features", F.col(TARGET).cast("double").alias("label")).persist()
    try:
        model = estimator.fit(train)
    finally:
        train.unpersist()
    return PipelineModel(stages=[meds, va, model])


def fit_stored(df: DataFrame, estimator, features: list[str] | None = None,
               min_features: int = 2) -> Model:
    """``fit`` through a store of models below the run's scratch folder. A model
    is found by what it was fitted on and how: the estimator's class and all
    its parameters, the features, and the count and hash sum of the training
    rows (one scan of ``df``). So the result is that of a new fit, whatever ran
    before; equal fits of one run are done once."""
    feats = available_features(df, features, min_features)
    rows = df.select(F.xxhash64(*feats, TARGET).cast("decimal(20,0)").alias("h")).agg(F.count("*"), F.sum("h")).first()
    is_tree = isinstance(estimator, TreeSettings)
    params = sorted(asdict(estimator).items()) if is_tree else sorted((p.name, str(v)) for p, v in estimator.extractParamMap().items())
    name = hashlib.md5(repr((type(estimator).__name__, params, feats, tuple(rows))).encode()).hexdigest()
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/hearth/{spark.sparkContext.applicationId}/models/{name}"
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{'about' if is_tree else 'metadata'}/_SUCCESS")
    if not marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker):
        save_model(fit(df, estimator, feats, min_features), path)
    return load_model(path)


def _median_imputer(df: DataFrame, feats: list[str]):
    """An exact-median imputer as a fitted transformer: a SQLTransformer that
    adds ``__imp_<f>`` = coalesce(f, median) with the medians (a handful of
    scalars from one aggregate) as literals. Input columns pass through, so
    the fitted pipeline scores any frame that has the feature columns."""
    from pyspark.ml.feature import SQLTransformer
    from hearth.operators.quantiles import column_medians
    row = column_medians(df, feats).first()
    exprs = []
    for c in feats:
        m = row[f"__med_{c}"]
        lit = "NULL" if m is None else repr(float(m))
        exprs.append(f"coalesce(CAST(`{c}` AS DOUBLE), CAST({lit} AS DOUBLE)) AS `__imp_{c}`")
    return SQLTransformer(statement=f"SELECT *, {', '.join(exprs)} FROM __THIS__")


def predict(models: Model | dict[str, Model], df: DataFrame, name: str = FOREST) -> DataFrame:
    """Score ``df`` by one model, or by the named one of several; a name that
    is not there falls back to the forest."""
    if isinstance(models, dict):
        models = models[name if name in models else FOREST]
    return models.transform(df)


def regression_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction",
                       by: list[str] = ()) -> DataFrame:
    """MAE, RMSE, R^2 and n, in one row or one per group of ``by``. One pass:
    the total sum of squares is the population variance times n."""
    y, p = F.col(label).cast("double"), F.col(prediction).cast("double")
    d = df.select(*by, y.alias("y"), p.alias("p")).filter(F.col("y").isNotNull() & F.col("p").isNotNull())
    e = F.col("y") - F.col("p")
    agg = d.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"), F.sum(e * e).alias("__sse"),
        (F.var_pop("y") * F.count(F.lit(1))).alias("__sst"))
    return agg.select(*by, "n", "mae", "rmse",
                      (F.lit(1.0) - F.try_divide(F.col("__sse"), F.col("__sst"))).alias("r2"))


@dataclass
class Trained:
    models: dict
    metrics: DataFrame
    features: list[str]


def train_models(df: DataFrame, features: list[str] | None = None, fast: bool = False,
                 test_size: float = TEST_SIZE, seed: int = RANDOM_STATE, fitter=fit) -> Trained:
    """Fit the four models on the train part (by ``fit`` or ``fit_stored``) and
    score the test part. The result holds the models and the metrics."""
    feats = available_features(df, features)
    train, test = split(df, test_size, seed)
    models, rows = {}, None
    for name, est in estimators(fast).items():
        m = fitter(train, est, feats)
        models[name] = m
        met = regression_metrics(m.transform(test).withColumn("label", F.col(TARGET).cast("double")))
        met = met.select(F.lit(name).alias("model"), "*")
        rows = met if rows is None else rows.unionByName(met)
    return Trained(models, rows, feats)


def compare_models(trained: Trained) -> DataFrame:
    """One row per model, best R^2 first, with the best flagged."""
    w = Window.orderBy(F.desc_nulls_last("r2"), "model")  # four rows
    return trained.metrics.withColumn("rank", F.row_number().over(w)) \
                          .withColumn("best", F.col("rank") == 1)


def feature_importance(model: TreeModel, features: list[str], n: int | None = None) -> DataFrame:
    """Forest importances (non-negative, sum 1), highest first; a feature that no tree splits on has 0."""
    names = model.importances().sparkSession.createDataFrame(list(enumerate(features)), "feature_no int, feature string")
    imp = model.importances().withColumnRenamed("feature", "feature_no")
    out = names.join(imp, "feature_no", "left").select("feature", F.coalesce("importance", F.lit(0.0)).alias("importance"))
    out = out.orderBy(F.desc("importance"), "feature")
    return out.limit(n) if n else out


def cross_validate(df: DataFrame, estimator=None, k: int = 5, features: list[str] | None = None,
                   seed: int = RANDOM_STATE, min_features: int = 2) -> DataFrame:
    """k-fold R^2 (folds from the key hash), the forest by default: one row
    per fold, with mean and population std of the scores on every row.

    Missing features are filled with the whole table's medians, as the reference does, so folds, features and
    labels are written once. A forest's folds are grown together (``trees.out_of_fold``); a linear model's come from one pass of
    grouped sums (``_linear_out_of_fold``); other learners are fitted fold by fold on that table."""
    feats = available_features(df, features, min_features)
    estimator = estimator or forest_estimator()
    fold, meds = fold_of(k, seed), _median_imputer(df, feats)
    if isinstance(estimator, TreeSettings) and estimator.bagged:
        scored = out_of_fold(df, feats, TARGET, estimator, meds, fold, k)
    else:
        rows = training_rows(df, feats, TARGET, meds, fold)
        if isinstance(estimator, LinearRegression):
            scored = _linear_out_of_fold(rows, feats, k)
        else:
            named = rows.withColumnRenamed("label", TARGET)
            parts = [fit(named.filter(F.col("fold") != i), estimator, feats, min_features).transform(named.filter(F.col("fold") == i)) for i in range(k)]
            scored = reduce(DataFrame.unionByName, [p.select("fold", F.col(TARGET).alias("label"), "prediction") for p in parts])
    scores = regression_metrics(scored, by=["fold"])
    every = Window.partitionBy()  # k rows
    return scores.select("fold", "n", "r2", F.avg("r2").over(every).alias("mean_r2"),
                         F.stddev_pop("r2").over(every).alias("std_r2"))


def _linear_out_of_fold(rows: DataFrame, feats: list[str], k: int) -> DataFrame:
    """(fold, label, prediction): least squares of the other folds for each row. Sums of products per fold, about the whole table's
    means, are one grouped aggregate; a fold's model solves the normal equations of all sums less its own."""
    means = rows.agg(*[F.avg(c) for c in [*feats, "label"]]).first()
    if means[0] is None:
        return rows.select("fold", "label", F.lit(None).cast("double").alias("prediction"))
    z = [F.lit(1.0), *[F.col(c) - F.lit(m) for c, m in zip([*feats, "label"], means)]]
    pairs = [(i, j) for i in range(len(z)) for j in range(i, len(z))]
    sums = {r["fold"]: r for r in rows.groupBy("fold").agg(*[F.sum(z[i] * z[j]).alias(f"s{i}_{j}") for i, j in pairs]).collect()}  # k rows
    gram = {f: np.zeros((len(z), len(z))) for f in sums}
    for f, r in sums.items():
        for i, j in pairs:
            gram[f][i, j] = gram[f][j, i] = r[f"s{i}_{j}"]
    prediction = F.lit(None).cast("double")
    for f in gram:
        g = sum((gram[o] for o in gram if o != f), np.zeros((len(z), len(z))))
        beta = np.linalg.lstsq(g[:-1, :-1], g[:-1, -1], rcond=None)[0]
        value = F.lit(float(beta[0] + means[-1]))
        for b, c in zip(beta[1:], z[1:-1]):
            value = value + F.lit(float(b)) * c
        prediction = F.when(F.col("fold") == f, value).otherwise(prediction)
    return rows.select("fold", "label", prediction.alias("prediction"))


def save_model(model: Model, path: str) -> str:
    if isinstance(model, TreeModel):
        return model.save(path)
    model.write().overwrite().save(path)
    return path


def load_model(path: str) -> Model:
    """A model by what its folder holds."""
    spark = SparkSession.getActiveSession()
    about = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/about")
    if about.getFileSystem(spark._jsc.hadoopConfiguration()).exists(about):
        return TreeModel.load(path)
    return PipelineModel.load(path)


def shapley_values(model: TreeModel, explain: DataFrame, features: list[str],
                   n_explain: int | None = 100, seed: int = RANDOM_STATE) -> DataFrame:
    """Shapley attributions of a tree model by its paths, with node covers in place of a background sample
    (``trees.path_attribution``; no sum over subsets of features).

    ``n_explain`` rows are explained (None: all). Rows stream past the leaves: no join. Output: (row_id,
    base_value, prediction, feature, contribution), where base_value + the contributions = prediction."""
    spark = explain.sparkSession
    sample = sample_n(explain, n_explain, seed).repartition(2 * spark.sparkContext.defaultParallelism) if n_explain else explain
    rows = attributions(model, model.impute(sample).select(F.col("id").alias("row_id"), *[f"__imp_{f}" for f in model.features]))
    phi = F.col("__phi")
    return rows.select("row_id", phi[0].alias("base_value"), phi[1].alias("prediction"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), phi[i + 2].alias("contribution")) for i, c in enumerate(features)])))


def linear_shapley(model: PipelineModel, explain: DataFrame, train: DataFrame, features: list[str],
                   n_explain: int | None = 100, seed: int = RANDOM_STATE) -> DataFrame:
    """The closed form for a linear model: beta_i * (x_i - mean of the training part's x_i); same output."""
    lr = model.stages[-1]
    beta = [float(b) for b in lr.coefficients.toArray()]
    imputed = [F.col(f"__imp_{c}").cast("double") for c in features]
    means = model.stages[0].transform(train).agg(*[F.avg(x).alias(f"__m{i}") for i, x in enumerate(imputed)])
    rows = model.stages[0].transform(sample_n(explain, n_explain, seed) if n_explain else explain)
    j = attach(rows.select(F.col("id").alias("row_id"), *[x.alias(f"__x{i}") for i, x in enumerate(imputed)]), means)
    base, pred = F.lit(float(lr.intercept)), F.lit(float(lr.intercept))
    for i, b in enumerate(beta):
        base, pred = base + b * F.col(f"__m{i}"), pred + b * F.col(f"__x{i}")
    return j.select("row_id", base.alias("base_value"), pred.alias("prediction"), F.inline(F.array(*[
        F.struct(F.lit(c).alias("feature"), (beta[i] * (F.col(f"__x{i}") - F.col(f"__m{i}"))).alias("contribution"))
        for i, c in enumerate(features)])))


def shapley_summary(values: DataFrame) -> DataFrame:
    """Mean absolute contribution per feature (the bar summary)."""
    return values.groupBy("feature").agg(F.avg(F.abs("contribution")).alias("mean_abs_contribution"))


def shapley_row(values: DataFrame, row_id: int) -> DataFrame:
    """One row's base value and contributions, largest magnitude first."""
    return values.filter(F.col("row_id") == row_id).orderBy(F.desc(F.abs("contribution")), "feature")
