"""Registered queries: filters, recommendations, comparison, top-n, samples."""

from __future__ import annotations

from hearth import sinks
from hearth.operators import search as se
from hearth.operators import topn as tn
from hearth.operators.util import round_doubles
from hearth.plans.registry import register
from hearth.session import scratch_path
from hearth.sources import fixtures as sfx

SAMPLE_ORDER = "md5(CAST(id AS VARCHAR) || '-42'), id"
ALL_SALES = ("id, date, price, bedrooms, bathrooms, sqft_living, sqft_lot, floors, waterfront, view, condition, "
             "grade, yr_built, yr_renovated, zipcode, round(lat, 6) AS lat, round(long, 6) AS long, sqft_above, "
             "sqft_basement, round(price_per_sqft, 6) AS price_per_sqft, year, month")


def _s(spark, d):
    return sfx.sales(spark, d)


def _r6(df):
    return round_doubles(df, 6)


@register("area_filter", f"SELECT {ALL_SALES} FROM sales WHERE zipcode = 98010 ORDER BY id LIMIT 20")
def q_area_filter(spark, d):
    return _r6(se.area_filter(_s(spark, d), 98010, 20))


@register("map_filter", f"""
WITH b AS (SELECT CAST(trunc(quantile_cont(price, 0.1)) AS BIGINT) AS lo,
                  CAST(trunc(quantile_cont(price, 0.9)) AS BIGINT) AS hi, min(grade) AS g FROM sales)
SELECT {ALL_SALES} FROM sales CROSS JOIN b WHERE price >= lo AND price <= hi AND grade >= g
ORDER BY {SAMPLE_ORDER} LIMIT 500""")
def q_map_filter(spark, d):
    return _r6(se.map_filter(_s(spark, d), n=500))


@register("map_filter_clustered", f"""
SELECT {ALL_SALES} FROM sales WHERE price BETWEEN 400000 AND 1200000 AND grade >= 5 ORDER BY {SAMPLE_ORDER} LIMIT 500""")
def q_map_filter_clustered(spark, d):
    """The same on a table written along a space-filling curve, with given bounds."""
    path = sinks.write_clustered(_s(spark, d), scratch_path(spark, "clustered"))
    return _r6(se.map_filter(spark.read.parquet(path), 400_000, 1_200_000, 5, n=500))


@register("luxury_listings", f"SELECT {ALL_SALES} FROM sales WHERE price > 1000000 ORDER BY id LIMIT 10")
def q_luxury(spark, d):
    return _r6(se.luxury_listings(_s(spark, d)))


@register("recommend_basic", f"""
SELECT {ALL_SALES} FROM sales WHERE price <= 500000 AND bedrooms = 3 ORDER BY id LIMIT 10""")
def q_recommend_basic(spark, d):
    return _r6(se.recommend_basic(_s(spark, d), 500000, 3))


@register("recommend", """
SELECT id, price, bedrooms, bathrooms, sqft_living, zipcode, grade,
       round(sqft_living / price * 100000.0E0, 6) AS value_score
FROM sales WHERE price <= 500000 AND bedrooms = 3 AND grade >= 7
ORDER BY sqft_living / price * 100000.0E0 DESC NULLS LAST, id LIMIT 10""")
def q_recommend(spark, d):
    return _r6(se.recommend(_s(spark, d), 500000, 3, 7))


@register("recommend_bounds", """
SELECT max(price) AS max_price, max(bedrooms) AS max_bedrooms, min(grade) AS min_grade,
       max(grade) AS max_grade FROM sales""")
def q_recommend_bounds(spark, d):
    return se.recommend_bounds(_s(spark, d))


@register("listing_search", """
WITH f AS (SELECT * FROM sales WHERE price >= 100000 AND bedrooms >= 2 AND price <= 900000)
SELECT id, price, bedrooms, bathrooms, sqft_living, grade, zipcode, condition,
       (SELECT count(*) FROM f) AS n_matches
FROM f ORDER BY id LIMIT 50""")
def q_listing_search(spark, d):
    return se.listing_search(_s(spark, d), 100000, 900000, 2)


@register("listing_search_none", """
SELECT CAST(NULL AS BIGINT) AS id, CAST(NULL AS DOUBLE) AS price, CAST(NULL AS INTEGER) AS bedrooms, CAST(NULL AS DOUBLE) AS bathrooms,
       CAST(NULL AS BIGINT) AS sqft_living, CAST(NULL AS INTEGER) AS grade, CAST(NULL AS INTEGER) AS zipcode,
       CAST(NULL AS INTEGER) AS condition, CAST(count_if(price < 0) AS BIGINT) AS n_matches
FROM sales""")
def q_listing_search_none(spark, d):
    """A search without a match still returns its count."""
    return se.listing_search(_s(spark, d), -10, -1)


@register("listing_count", """
SELECT CAST(count_if(price >= 100000 AND price <= 900000 AND bedrooms >= 2) AS BIGINT) AS n_matches FROM sales""")
def q_listing_count(spark, d):
    return se.listing_count(_s(spark, d), price_min=100000, price_max=900000, min_bedrooms=2)


@register("search_cards", """
WITH f AS (SELECT * FROM sales WHERE price >= 100000 AND bedrooms >= 2 AND price <= 900000)
SELECT id, price, bedrooms, bathrooms, sqft_living, grade, zipcode, condition,
       (SELECT count(*) FROM f) AS n_matches
FROM f ORDER BY id LIMIT 12""")
def q_search_cards(spark, d):
    return se.search_cards(_s(spark, d), price_min=100000, price_max=900000, min_bedrooms=2)


@register("compare_listings", """
WITH two AS (SELECT * FROM sales WHERE id IN (1, 2)),
u AS (UNPIVOT (SELECT id, CAST(price AS DOUBLE) AS price, CAST(bedrooms AS DOUBLE) AS bedrooms,
                      CAST(bathrooms AS DOUBLE) AS bathrooms, CAST(sqft_living AS DOUBLE) AS sqft_living,
                      CAST(floors AS DOUBLE) AS floors, CAST(grade AS DOUBLE) AS grade,
                      CAST(condition AS DOUBLE) AS condition, CAST(waterfront AS DOUBLE) AS waterfront FROM two)
      ON price, bedrooms, bathrooms, sqft_living, floors, grade, condition, waterfront
      INTO NAME feature VALUE value)
SELECT CAST(list_position(['price', 'bedrooms', 'bathrooms', 'sqft_living', 'floors', 'grade', 'condition',
                           'waterfront'], feature) AS INTEGER) AS position,
       feature,
       CASE feature WHEN 'price' THEN 'Price' WHEN 'bedrooms' THEN 'Bedrooms' WHEN 'bathrooms' THEN 'Bathrooms'
            WHEN 'sqft_living' THEN 'Sqft Living' WHEN 'floors' THEN 'Floors' WHEN 'grade' THEN 'Grade'
            WHEN 'condition' THEN 'Condition' ELSE 'Waterfront' END AS label,
       max(CASE WHEN id = 1 THEN value END) AS property_a, max(CASE WHEN id = 2 THEN value END) AS property_b
FROM u GROUP BY feature""")
def q_compare(spark, d):
    return se.compare_listings(_s(spark, d), 1, 2)


@register("compare_radar", """
WITH two AS (SELECT * FROM sales WHERE id IN (1, 2)),
u AS (UNPIVOT (SELECT id, CAST(bedrooms AS DOUBLE) AS bedrooms,
                      CAST(bathrooms AS DOUBLE) AS bathrooms, CAST(sqft_living AS DOUBLE) AS sqft_living,
                      CAST(floors AS DOUBLE) AS floors, CAST(grade AS DOUBLE) AS grade,
                      CAST(condition AS DOUBLE) AS condition, CAST(waterfront AS DOUBLE) AS waterfront FROM two)
      ON bedrooms, bathrooms, sqft_living, floors, grade, condition, waterfront
      INTO NAME feature VALUE value),
w AS (SELECT CAST(list_position(['price', 'bedrooms', 'bathrooms', 'sqft_living', 'floors', 'grade', 'condition',
                           'waterfront'], feature) AS INTEGER) AS position,
       feature,
       CASE feature WHEN 'bedrooms' THEN 'Bedrooms' WHEN 'bathrooms' THEN 'Bathrooms'
            WHEN 'sqft_living' THEN 'Sqft Living' WHEN 'floors' THEN 'Floors' WHEN 'grade' THEN 'Grade'
            WHEN 'condition' THEN 'Condition' ELSE 'Waterfront' END AS label,
       max(CASE WHEN id = 1 THEN value END) AS property_a, max(CASE WHEN id = 2 THEN value END) AS property_b
FROM u GROUP BY feature)
SELECT *, (SELECT greatest(max(property_a), max(property_b)) FROM w) AS axis_max FROM w""")
def q_radar(spark, d):
    return se.compare_radar(_s(spark, d), 1, 2)


@register("top_price", """
SELECT id, price, bedrooms, bathrooms, sqft_living, grade, zipcode FROM sales
ORDER BY price DESC NULLS LAST, id LIMIT 10""")
def q_top_price(spark, d):
    return tn.top_price(_s(spark, d))


@register("top_investments", """
SELECT id, price, zipcode, CAST(least(100, CASE WHEN grade >= 8 THEN 30 ELSE 0 END + CASE WHEN waterfront = 1 THEN 30 ELSE 0 END
             + CASE WHEN sqft_living > 3000 THEN 20 ELSE 0 END + CASE WHEN condition >= 4 THEN 20 ELSE 0 END
             + CASE WHEN view >= 3 THEN 15 ELSE 0 END + CASE WHEN yr_renovated > 2000 THEN 10 ELSE 0 END) AS INTEGER)
  AS investment_score, sqft_living, grade, condition, waterfront, view, yr_renovated
FROM sales ORDER BY investment_score DESC, id LIMIT 10""")
def q_top_investments(spark, d):
    return tn.top_investments(_s(spark, d))


@register("cheapest_per_sqft", f"SELECT {ALL_SALES} FROM sales ORDER BY price_per_sqft ASC NULLS LAST, id LIMIT 10")
def q_cheapest(spark, d):
    return _r6(tn.cheapest_per_sqft(_s(spark, d)))


@register("preview", f"SELECT {ALL_SALES} FROM sales ORDER BY id LIMIT 5")
def q_preview(spark, d):
    return _r6(tn.preview(_s(spark, d)))


@register("first_markers", "SELECT id, round(lat, 6) AS lat, round(long, 6) AS long, price, bedrooms "
                           "FROM sales ORDER BY id LIMIT 300")
def q_first_markers(spark, d):
    return _r6(tn.first_markers(_s(spark, d)))


@register("distinct_sorted", "SELECT DISTINCT zipcode FROM sales WHERE zipcode IS NOT NULL ORDER BY zipcode")
def q_distinct(spark, d):
    return tn.distinct_sorted(_s(spark, d))


@register("sample_n", f"SELECT {ALL_SALES} FROM sales ORDER BY {SAMPLE_ORDER} LIMIT 1000")
def q_sample(spark, d):
    return _r6(tn.sample_n(_s(spark, d), 1000))
