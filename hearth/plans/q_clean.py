"""Registered queries: validation and cleaning."""

from __future__ import annotations

from pyspark.sql import functions as F

from hearth.operators import clean
from hearth.operators.util import round_doubles
from hearth.plans.registry import register
from hearth.sources import fixtures as fx

SALES_DOUBLES = ["price", "bathrooms", "floors", "lat", "long", "price_per_sqft"]


def rounded_replace(cols, dp=6, exclude=()):
    """DuckDB ``REPLACE`` clause rounding the listed floating columns."""
    items = [f"round({c}, {dp}) AS {c}" for c in cols if c not in exclude]
    return f"REPLACE ({', '.join(items)})"


RAW_COLS = ("id, date, price, bedrooms, bathrooms, sqft_living, sqft_lot, floors, waterfront, view, "
            "condition, grade, yr_built, yr_renovated, zipcode, lat, long, sqft_above, sqft_basement")


@register("validate", """
SELECT 'no_rows' AS "check", CAST(CASE WHEN count(*) = 0 THEN 1 ELSE 0 END AS BIGINT) AS failures FROM raw_sales
UNION ALL SELECT 'negative_price', CAST(count_if(price < 0) AS BIGINT) FROM raw_sales
UNION ALL SELECT 'negative_bedrooms', CAST(count_if(bedrooms < 0) AS BIGINT) FROM raw_sales""")
def q_validate(spark, d):
    return clean.validation_report(fx.raw_sales(spark, d))


@register("validate_failing", """
SELECT 'no_rows' AS "check", CAST(0 AS BIGINT) AS failures WHERE (SELECT count(*) FROM raw_sales) > 0
UNION ALL SELECT 'negative_price', CAST(count_if(id % 40 = 3) AS BIGINT) FROM raw_sales
UNION ALL SELECT 'negative_bedrooms', CAST(count_if(id % 90 = 5) AS BIGINT) FROM raw_sales""")
def q_validate_failing(spark, d):
    """The same report over sales some of which break the rules."""
    raw = fx.raw_sales(spark, d)
    broken = raw.withColumns({"price": F.when(F.col("id") % 40 == 3, -F.col("price") - 1).otherwise(F.col("price")),
                              "bedrooms": F.when(F.col("id") % 90 == 5, -F.col("bedrooms")).otherwise(F.col("bedrooms"))})
    return clean.validation_report(broken)


@register("drop_duplicates", f"SELECT DISTINCT * {rounded_replace(SALES_DOUBLES[:-1])} FROM sales_dup")
def q_drop_duplicates(spark, d):
    return round_doubles(clean.drop_duplicates(fx.sales_dup(spark, d)), 6)


@register("drop_columns", f"SELECT * EXCLUDE (id, price) {rounded_replace(SALES_DOUBLES, exclude=('price',))} FROM sales")
def q_drop_columns(spark, d):
    return round_doubles(clean.drop_columns(fx.sales(spark, d), "id", "price"), 6)


@register("fill_defaults", "SELECT id, coalesce(waterfront, 0) AS waterfront, coalesce(view, 0) AS view, "
                           "coalesce(condition, 0) AS condition FROM raw_sales")
def q_fill_defaults(spark, d):
    return clean.fill_defaults(fx.raw_sales(spark, d)).select("id", "waterfront", "view", "condition")


@register("parse_dates", "SELECT id, try_strptime(date, '%Y%m%dT%H%M%S') AS date FROM raw_sales")
def q_parse_dates(spark, d):
    return clean.parse_dates(fx.raw_sales(spark, d)).select("id", "date")


@register("date_parts", "SELECT id, year, month FROM sales")
def q_date_parts(spark, d):
    raw = clean.parse_dates(fx.raw_sales(spark, d))
    return clean.date_parts(raw).select("id", "year", "month")


@register("impute_median", """
SELECT id, coalesce(CAST(year AS DOUBLE), (SELECT quantile_cont(year, 0.5) FROM sales)) AS year,
       coalesce(CAST(month AS DOUBLE), (SELECT quantile_cont(month, 0.5) FROM sales)) AS month
FROM sales""")
def q_impute_median(spark, d):
    return clean.impute_median(fx.sales(spark, d), ["year", "month"]).select("id", "year", "month")


@register("preprocess", f"SELECT * {rounded_replace(SALES_DOUBLES)} FROM sales")
def q_preprocess(spark, d):
    return round_doubles(fx.sales(spark, d), 6)
