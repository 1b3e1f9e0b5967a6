"""Registered queries: derived features, scores, labels, map points."""

from __future__ import annotations

from hearth.functions import features as fx
from hearth.operators import features as fo
from hearth.operators.topn import scatter_projection
from hearth.operators.util import round_doubles
from hearth.plans.registry import register
from hearth.sources import fixtures as sfx

# Written out here, so that a changed rule in the library turns these queries red.
BASIC_SQL = """CAST(CASE WHEN grade >= 8 THEN 30 ELSE 0 END + CASE WHEN waterfront = 1 THEN 30 ELSE 0 END
             + CASE WHEN sqft_living > 3000 THEN 20 ELSE 0 END + CASE WHEN condition >= 4 THEN 20 ELSE 0 END AS INTEGER)"""
SCORE_SQL = """CAST(least(100, CASE WHEN grade >= 8 THEN 30 ELSE 0 END + CASE WHEN waterfront = 1 THEN 30 ELSE 0 END
             + CASE WHEN sqft_living > 3000 THEN 20 ELSE 0 END + CASE WHEN condition >= 4 THEN 20 ELSE 0 END
             + CASE WHEN view >= 3 THEN 15 ELSE 0 END + CASE WHEN yr_renovated > 2000 THEN 10 ELSE 0 END) AS INTEGER)"""


def _s(spark, d):
    return sfx.sales(spark, d)


@register("price_per_sqft", """
SELECT id, round(price_per_sqft, 6) AS price_per_sqft,
       round(price / CAST(NULLIF(sqft_living, 0) AS DOUBLE), 6) AS price_per_sqft_raw FROM sales""")
def q_price_per_sqft(spark, d):
    s = _s(spark, d)
    return round_doubles(s.select("id", "price_per_sqft",
                                  fx.price_per_sqft(floor=False).alias("price_per_sqft_raw")), 6)


@register("house_age", "SELECT id, 2025 - yr_built AS house_age FROM sales")
def q_house_age(spark, d):
    return _s(spark, d).select("id", fx.house_age().alias("house_age"))


@register("renovated_flag", "SELECT id, CASE WHEN yr_renovated > 0 THEN 1 ELSE 0 END AS renovated FROM sales")
def q_renovated(spark, d):
    return _s(spark, d).select("id", fx.renovated_flag().alias("renovated"))


@register("total_sqft", "SELECT id, sqft_above + sqft_basement AS total_sqft FROM sales")
def q_total_sqft(spark, d):
    return _s(spark, d).select("id", fx.total_sqft().alias("total_sqft"))


@register("luxury_flag", "SELECT id, CASE WHEN price > 1000000 THEN 1 ELSE 0 END AS luxury_house FROM sales")
def q_luxury_flag(spark, d):
    return _s(spark, d).select("id", fx.luxury_flag().alias("luxury_house"))


@register("size_category", """
SELECT id, CASE WHEN sqft_living < 1500 THEN 'Small' WHEN sqft_living < 3000 THEN 'Medium'
                ELSE 'Large' END AS size_category FROM sales""")
def q_size_category(spark, d):
    return _s(spark, d).select("id", fx.size_category().alias("size_category"))


@register("investment_score_basic", f"SELECT id, {BASIC_SQL} AS investment_score FROM sales")
def q_score_basic(spark, d):
    return _s(spark, d).select("id", fx.investment_score_basic().cast("int").alias("investment_score"))


@register("investment_score", f"SELECT id, {SCORE_SQL} AS investment_score FROM sales")
def q_score(spark, d):
    s = _s(spark, d)
    return s.select("id", fx.investment_score(s.columns).alias("investment_score"))


@register("investment_label", f"""
SELECT id, CASE WHEN s >= 80 THEN 'Excellent' WHEN s >= 60 THEN 'Good' WHEN s >= 40 THEN 'Average'
                ELSE 'Risky' END AS investment_label
FROM (SELECT id, {BASIC_SQL} AS s FROM sales)""")
def q_label(spark, d):
    s = _s(spark, d).select("id", fx.investment_score_basic().alias("s"))
    return s.select("id", fx.investment_label("s").alias("investment_label"))


@register("value_drivers", """
SELECT id, concat_ws(' ', CASE WHEN waterfront = 1 THEN 'Waterfront property increases value.' END,
                          CASE WHEN grade >= 8 THEN 'High construction quality detected.' END) AS value_drivers
FROM sales""")
def q_value_drivers(spark, d):
    return _s(spark, d).select("id", fx.value_drivers().alias("value_drivers"))


@register("value_score", "SELECT id, round(sqft_living / price * 100000.0E0, 6) AS value_score FROM sales")
def q_value_score(spark, d):
    return round_doubles(_s(spark, d).select("id", fx.value_score().alias("value_score")), 6)


@register("marker_class", """
SELECT id, round(lat, 6) AS lat, round(long, 6) AS long, price,
       CASE WHEN price < (SELECT quantile_cont(price, 0.5) FROM sales) THEN 'green' ELSE 'red' END AS marker
FROM sales""")
def q_marker_class(spark, d):
    return round_doubles(fo.marker_class(_s(spark, d)), 6)


@register("heat_points", "SELECT id, round(lat, 6) AS lat, round(long, 6) AS long, "
                         "round(price / 1e6, 6) AS weight FROM sales")
def q_heat_points(spark, d):
    return round_doubles(fo.heat_points(_s(spark, d)), 6)


@register("display_format", """
WITH m AS (SELECT zipcode, quantile_cont(price_per_sqft, 0.5) AS zm FROM sales
           WHERE zipcode IS NOT NULL GROUP BY zipcode)
SELECT id, '$' || format('{:,.0f}', price) AS price_text,
       '$' || format('{:,.0f}', price_per_sqft) AS price_per_sqft_text,
       format('{:,.1f}', bathrooms) AS bathrooms_text,
       format('{:,.2f}', price_per_sqft / zm * 100.0E0) || '%' AS valuation_text,
       'Sqft Living' AS label
FROM sales LEFT JOIN m USING (zipcode)""")
def q_display_format(spark, d):
    return fo.display_format(_s(spark, d))


@register("notebook_features", """
SELECT id, 2025 - yr_built AS house_age, CASE WHEN yr_renovated > 0 THEN 1 ELSE 0 END AS renovated,
  sqft_above + sqft_basement AS total_sqft, round(price / CAST(NULLIF(sqft_living, 0) AS DOUBLE), 6) AS price_per_sqft_raw,
  CASE WHEN price > 1000000 THEN 1 ELSE 0 END AS luxury_house,
  CASE WHEN sqft_living < 1500 THEN 'Small' WHEN sqft_living < 3000 THEN 'Medium' ELSE 'Large' END AS size_category
FROM sales""")
def q_notebook_features(spark, d):
    f = fo.add_notebook_features(_s(spark, d))
    return round_doubles(f.select("id", "house_age", "renovated", "total_sqft", "price_per_sqft_raw",
                                  "luxury_house", "size_category"), 6)


@register("scatter_projection", """
SELECT id, sqft_living, price, grade, bedrooms FROM sales
ORDER BY md5(CAST(id AS VARCHAR) || '-42'), id LIMIT 2000""")
def q_scatter(spark, d):
    return scatter_projection(_s(spark, d), ["sqft_living", "price", "grade", "bedrooms"], 2000)
