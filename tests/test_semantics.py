"""Hand-made frames for the missing-value, tie and error rules (R1-R16)."""

import math

import pytest
from pyspark.sql import functions as F

from hearth.functions import features as fx
from hearth.operators import clean, market, topn, valuation
from hearth.operators.quantiles import exact_percentiles


def test_nan_becomes_null(spark):  # R1, R2
    df = spark.createDataFrame([(1, float("nan"), 9), (2, 100.0, 8), (3, None, 7)],
                               "id long, price double, grade int")
    c = clean.nan_to_null(df)
    assert c.filter(F.col("price").isNull()).count() == 2
    assert c.agg(F.avg("price")).first()[0] == 100.0


def test_null_keys_dropped(spark):  # R3
    df = spark.createDataFrame([(1, None, 5.0, 1), (2, 98001, 7.0, 1)],
                               "id long, zipcode int, price double, year int")
    got = market.zipcode_mean_price(df).collect()
    assert [r.zipcode for r in got] == [98001]


def test_ties_break_on_id(spark):  # R5
    df = spark.createDataFrame([(i, 100.0) for i in [5, 3, 9, 1]], "id long, price double")
    got = [r.id for r in topn.top_price(df.repartition(3), 2).collect()]
    assert got == [1, 3]


def test_singleton_std_is_null(spark):  # R6
    df = spark.createDataFrame([(1, 98001, 10.0, 1000, 7, 1.0), (2, 98002, 5.0, 900, 7, 1.0),
                                (3, 98002, 6.0, 800, 8, 1.0)],
                               "id long, zipcode int, price double, sqft_living long, grade int, price_per_sqft double")
    r = {x.zipcode: x for x in market.neighborhood_ranking(df).collect()}
    assert r[98001].price_std is None and r[98001].investment_potential is None
    assert r[98002].investment_potential is not None


def test_zero_and_null_sqft(spark):  # R8, R9
    df = spark.createDataFrame([(1, 100.0, 0), (2, 100.0, None), (3, 100.0, 50)],
                               "id long, price double, sqft_living long")
    got = {r.id: r.p for r in df.select("id", fx.price_per_sqft().alias("p")).collect()}
    assert got == {1: 100.0, 2: None, 3: 2.0}
    raw = {r.id: r.p for r in df.select("id", fx.price_per_sqft(floor=False).alias("p")).collect()}
    assert raw[1] is None


def test_constant_column_correlation_is_null(spark):  # R10
    df = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0), (1.0, 5.0)], "a double, b double")
    r = {(x.col_a, x.col_b): x.r for x in market.correlation_matrix(df, ["a", "b"]).collect()}
    assert r[("a", "b")] is None and r[("a", "a")] is None and r[("b", "b")] == 1.0


def test_pairwise_complete_correlation(spark):  # R11
    rows = [(1.0, 2.0, None), (2.0, None, 1.0), (3.0, 6.5, 2.0), (4.0, 8.0, 2.5), (5.0, 9.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    r = {(x.col_a, x.col_b): x.r for x in market.correlation_matrix(df, ["a", "b", "c"]).collect()}
    import numpy as np
    a = np.array([1, 3, 4, 5.0]); b = np.array([2, 6.5, 8, 9.0])
    assert r[("a", "b")] == pytest.approx(np.corrcoef(a, b)[0, 1], rel=1e-12)
    assert r[("b", "a")] == r[("a", "b")]


def test_bad_dates_become_null(spark):  # R12
    df = spark.createDataFrame([(1, "20140502T000000"), (2, "bad-date"), (3, None)], "id long, date string")
    got = {r.id: r.date for r in clean.parse_dates(df).collect()}
    assert str(got[1]) == "2014-05-02 00:00:00" and got[2] is None and got[3] is None
    with pytest.raises(Exception):
        clean.parse_dates(df.filter("id = 2"), lenient=False).collect()


def test_truncation_toward_zero(spark):  # R13
    assert spark.range(1).select(F.lit(-1.7).cast("int")).first()[0] == -1


def test_exact_median_matches_numpy(spark):  # R7
    import numpy as np
    vals = [float(x) for x in np.random.default_rng(3).normal(0, 1, 301)]
    df = spark.createDataFrame([(i % 3, v) for i, v in enumerate(vals)], "g int, v double")
    got = {r.g: r.m for r in exact_percentiles(df, "v", ["g"], [0.5], ["m"], accuracy=16).collect()}
    for g in range(3):
        assert got[g] == pytest.approx(float(np.median(vals[g::3])), abs=1e-12)


def test_validate_rules(spark):
    good = spark.createDataFrame([(1.0, 1, 1.0, 100, 1.0, 7, 98001, 47.0, -122.0)],
                                 "price double, bedrooms int, bathrooms double, sqft_living long, "
                                 "floors double, grade int, zipcode int, lat double, long double")
    assert clean.validate(good) is good
    with pytest.raises(clean.InvalidTable, match="no row"):
        clean.validate(good.limit(0))
    with pytest.raises(clean.InvalidTable, match="no column lat"):
        clean.validate(good.drop("lat"))
    with pytest.raises(clean.InvalidTable, match="not a number"):
        clean.validate(good.withColumn("price", F.lit("x")))
    with pytest.raises(clean.InvalidTable, match="1 rows have a price"):
        clean.validate(good.withColumn("price", F.lit(-1.0)))
    with pytest.raises(clean.InvalidTable, match="1 rows have fewer"):
        clean.validate(good.withColumn("bedrooms", F.lit(-1)))


def test_optional_columns_absent(spark):
    df = spark.createDataFrame([(1, 100.0, 1, 1.0, 3500, 1.0, 9, 98001, 47.0, -122.0)],
                               "id long, price double, bedrooms int, bathrooms double, sqft_living long, "
                               "floors double, grade int, zipcode int, lat double, long double")
    c = clean.clean_sales(df)
    assert "year" not in c.columns
    s = c.select(fx.investment_score(c.columns).alias("s")).first().s
    assert s == 50  # grade 30 + sqft 20; absent columns add nothing
    assert topn.top_investments(c).columns == ["id", "price", "zipcode", "investment_score",
                                               "sqft_living", "grade"]


def test_valuation_null_zip(spark):
    df = spark.createDataFrame([(1, None, 10.0), (2, 98001, 10.0), (3, 98001, 5.0)],
                               "id long, zipcode int, price_per_sqft double")
    got = {r.id: r.valuation_ratio for r in valuation.valuation_ratio(df).collect()}
    assert got[1] is None and got[2] == pytest.approx(10 / 7.5) and got[3] == pytest.approx(5 / 7.5)


def test_intent_substring_rules(spark):
    from hearth.functions.text import intent
    df = spark.createDataFrame([("Which areas are good?",), ("What are the current price trends?",),
                                ("xyz",), ("Nearby area",)], "text string")
    got = [r.i for r in df.select(intent("text").alias("i")).collect()]
    assert got == ["greeting", "price", "fallback", "map"]


def test_size_category_missing_is_large(spark):
    df = spark.createDataFrame([(None,), (1000,), (2000,), (3000,)], "sqft_living long")
    got = [r.c for r in df.select(fx.size_category().alias("c")).collect()]
    assert got == ["Large", "Small", "Medium", "Large"]


def test_histogram_covers_all_rows(spark):
    df = spark.createDataFrame([(float(i),) for i in range(101)], "price double")
    h = sorted(market.price_histogram(df, bins=10).collect(), key=lambda r: r.bin)
    assert len(h) == 10 and sum(r["count"] for r in h) == 101
    assert h[-1]["count"] == 11  # last bin closed


def test_density_integrates_to_one(spark):
    import numpy as np
    vals = np.random.default_rng(1).normal(10, 2, 500)
    df = spark.createDataFrame([(float(v),) for v in vals], "price double")
    d = sorted(market.price_density(df).collect(), key=lambda r: r.i)
    xs = np.array([r.x for r in d]); ys = np.array([r.density for r in d])
    assert np.trapezoid(ys, xs) == pytest.approx(1.0, abs=1e-3)


def test_auto_histogram_numpy_rule(spark):
    import numpy as np
    vals = np.random.default_rng(2).lognormal(3, 1, 997)
    df = spark.createDataFrame([(float(v),) for v in vals], "price double")
    h = market.auto_histogram(df).collect()
    assert len(h) == len(np.histogram_bin_edges(vals, bins="auto")) - 1
    assert sum(r["count"] for r in h) == 997


def test_box_stats_whiskers(spark):
    vals = [1.0, 2.0, 3.0, 4.0, 5.0, 100.0]
    df = spark.createDataFrame([(v,) for v in vals], "price double")
    r = market.box_stats(df).first()
    import numpy as np
    q1, q3 = np.percentile(vals, [25, 75])
    assert r.q1 == q1 and r.q3 == q3 and r.upper_whisker == 5.0 and r.n_outliers == 1
    assert math.isclose(r.median, 3.5)


def test_percentile_empty_and_all_null(spark):
    df = spark.createDataFrame([(None,), (None,)], "v double")
    r = exact_percentiles(df, "v", [], [0.5], ["m"]).collect()
    assert len(r) == 1 and r[0].m is None
    r = exact_percentiles(df.limit(0), "v", [], [0.25, 0.75], ["a", "b"]).collect()
    assert len(r) == 1 and r[0].a is None and r[0].b is None


def test_percentile_hot_group_uses_bracket(spark):
    """A group holding most rows, sketch accuracy far below its size: the
    bracket path runs and the answer is still exact."""
    import numpy as np
    rng = np.random.default_rng(7)
    vals = rng.integers(0, 50, 5000).astype(float)  # heavy ties
    g = np.where(np.arange(5000) < 4000, 0, 1 + np.arange(5000) % 5)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, vals)], "g int, v double")
    got = {r.g: (r.q1, r.q2, r.q3) for r in
           exact_percentiles(df, "v", ["g"], [0.1, 0.5, 0.97], ["q1", "q2", "q3"], accuracy=100).collect()}
    for k in got:
        ref = np.percentile(vals[g == k], [10, 50, 97])
        assert got[k] == pytest.approx(tuple(ref), abs=1e-12)


def test_percentile_refinement_rounds(spark):
    """Brackets wider than ``max_bracket`` are narrowed by extra passes and
    the answer stays exact (small accuracy and bound force several rounds)."""
    import numpy as np
    rng = np.random.default_rng(11)
    n = 20000
    vals = np.round(rng.lognormal(5, 1.5, n), 3)
    vals[:3000] = 42.0  # a block of ties
    g = np.where(np.arange(n) < 15000, 0, 1)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(g, vals)], "g int, v double")
    probs = [0.0, 0.05, 0.5, 0.9, 1.0]
    got = {r.g: tuple(r[1:]) for r in exact_percentiles(
        df, "v", ["g"], probs, ["a", "b", "c", "d", "e"], accuracy=100, max_bracket=60).collect()}
    for k in got:
        ref = np.percentile(vals[g == k], [p * 100 for p in probs])
        assert got[k] == pytest.approx(tuple(ref), abs=1e-9)
    glob = exact_percentiles(df, "v", [], [0.5], ["m"], accuracy=100, max_bracket=60).first().m
    assert glob == pytest.approx(float(np.median(vals)), abs=1e-9)


def test_approximate_mode_close_to_exact(spark):
    import numpy as np
    vals = np.random.default_rng(5).lognormal(10, 1, 3000)
    df = spark.createDataFrame([(i % 4, float(v)) for i, v in enumerate(vals)], "g int, v double")
    ex = {r.g: r.m for r in exact_percentiles(df, "v", ["g"], [0.5], ["m"]).collect()}
    ap = {r.g: r.m for r in exact_percentiles(df, "v", ["g"], [0.5], ["m"], exact=False).collect()}
    for g in range(4):
        sub = np.sort(vals[g::4])
        assert ex[g] == pytest.approx(float(np.median(sub)), rel=1e-12)
        # the approximate answer is an element within the rank error
        rank = np.searchsorted(sub, ap[g])
        assert abs(rank - len(sub) / 2) <= len(sub) / 1000 + 2
    kp = market.market_kpis(df.withColumnRenamed("v", "price")
                            .withColumn("sqft_living", F.lit(1)).withColumn("bedrooms", F.lit(1)),
                            exact=False).first()
    assert kp.n_properties == 3000


def test_percentile_rounds_run_out(spark):
    """Brackets that stay too wide fail the query instead of reaching one task."""
    df = spark.range(5000).select(F.col("id").cast("double").alias("v"))
    with pytest.raises(ValueError, match="distinct values after"):
        exact_percentiles(df, "v", [], [0.5], accuracy=10, max_bracket=1)


def test_a_changed_table_fails_the_second_pass(spark):
    from hearth.session import scratch_path
    path = scratch_path(spark, "changing")
    spark.range(100).selectExpr("CAST(id AS DOUBLE) AS v").write.parquet(path)
    q = exact_percentiles(spark.read.parquet(path), "v", [], [0.5], ["m"])
    spark.range(7).selectExpr("CAST(id AS DOUBLE) AS v").write.mode("append").parquet(path)
    q2 = exact_percentiles(spark.read.parquet(path), "v", [], [0.5], ["m"])
    assert q2.first().m == 46.0
    spark.range(1000).selectExpr("CAST(id AS DOUBLE) AS v").write.mode("overwrite").parquet(path)
    spark.catalog.refreshByPath(path)
    with pytest.raises(Exception):
        q.collect()


def test_search_counts_without_a_match(spark):
    from hearth.operators import search
    df = spark.createDataFrame([(1, 5.0, 2, 1.0, 100, 7, 98001, 3)], "id long, price double, bedrooms int, bathrooms double, sqft_living long, grade int, zipcode int, condition int")
    none = search.listing_search(df, 10).collect()
    assert len(none) == 1 and none[0].n_matches == 0 and none[0].id is None
    assert search.listing_search(df, 0, n=None).first().n_matches == 1
    assert search.listing_count(df, price_min=10).first().n_matches == 0
    assert search.search_cards(df, price_min=1).count() == 1


def test_recent_chat_breaks_ties_by_id(spark):
    rows = [(1, 7, "u", "a", 3), (2, 7, "u", "b", 3), (3, 7, "u", "c", 2)]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "id long, session_id long, role string, content string, timestamp long")
        assert [x.content for x in valuation.recent_chat(df, 2).orderBy("rn").collect()] == ["b", "a"]


def test_checkpoint_folder_is_needed_on_a_cluster():
    from types import SimpleNamespace
    from hearth.session import ensure_checkpoint_dir
    fake = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None),
                           sparkContext=SimpleNamespace(getCheckpointDir=lambda: None, master="spark://host:7077"))
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        ensure_checkpoint_dir(fake)
