"""DataFrame-level feature steps (the Column builders live in
``hearth.functions.features``)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions import features as fx
from hearth.operators.quantiles import exact_percentiles
from hearth.operators.util import attach
from hearth.operators.valuation import valuation_ratio


def add_notebook_features(df: DataFrame, year: int = fx.CURRENT_YEAR) -> DataFrame:
    """house_age, renovated, total_sqft, price_per_sqft (no floor),
    luxury_house, size_category, in the notebook's order."""
    return df.select(
        "*",
        fx.house_age(year=year).alias("house_age"),
        fx.renovated_flag().alias("renovated"),
        fx.total_sqft().alias("total_sqft"),
        F.try_divide(F.col("price").cast("double"), F.col("sqft_living").cast("double")).alias("price_per_sqft_raw"),
        fx.luxury_flag().alias("luxury_house"),
        fx.size_category().alias("size_category"))


def add_scores(df: DataFrame) -> DataFrame:
    """investment_score_basic, investment_score (profile), label, drivers."""
    s = df.select("*", fx.investment_score_basic().alias("investment_score_basic"),
                  fx.investment_score(df.columns).alias("investment_score"))
    return s.select("*", fx.investment_label("investment_score_basic").alias("investment_label"),
                    fx.value_drivers().alias("value_drivers"))


def marker_class(df: DataFrame, exact: bool = True) -> DataFrame:
    """green below the table's median price, else red (median computed once,
    attached as a broadcast one-row frame)."""
    med = exact_percentiles(df, "price", [], [0.5], ["__median"], exact=exact)
    return attach(df, med).select(
        "id", "lat", "long", "price",
        F.when(F.col("price") < F.col("__median"), F.lit("green")).otherwise(F.lit("red")).alias("marker"))


def heat_points(df: DataFrame) -> DataFrame:
    return df.select("id", "lat", "long", fx.heat_weight().alias("weight"))


def display_format(df: DataFrame) -> DataFrame:
    """Display texts: price and price per sqft as ``$1,234``, bathrooms with one
    decimal, the valuation ratio as a percent, and a titled feature label."""
    return valuation_ratio(df).select(
        "id", fx.dollars(F.col("price")).alias("price_text"),
        fx.dollars(F.col("price_per_sqft")).alias("price_per_sqft_text"),
        F.format_number(F.col("bathrooms"), 1).alias("bathrooms_text"),
        fx.percent(F.col("valuation_ratio") * 100.0).alias("valuation_text"),
        fx.feature_title(F.lit("sqft_living")).alias("label"))
