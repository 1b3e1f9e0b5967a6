"""Filters, lookups, recommendations and side-by-side comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hearth.functions.features import feature_title, value_score
from hearth.operators.quantiles import exact_percentiles
from hearth.operators.topn import sample_n
from hearth.operators.util import attach, present

# Listing cards of a result page, and column names.
CARDS = 12
COMPARE_FEATURES = ["price", "bedrooms", "bathrooms", "sqft_living", "floors", "grade"]
SEARCH_COLUMNS = ["id", "price", "bedrooms", "bathrooms", "sqft_living", "grade", "zipcode", "condition"]
RECOMMEND_COLUMNS = ["id", "price", "bedrooms", "bathrooms", "sqft_living", "zipcode", "grade",
                     "value_score"]


def area_filter(df: DataFrame, zipcode: int, n: int | None = 20) -> DataFrame:
    r = df.filter(F.col("zipcode") == zipcode).orderBy("id")
    return r.limit(n) if n else r


def map_filter(df: DataFrame, price_min: float | None = None, price_max: float | None = None,
               min_grade: int | None = None, n: int = 500, seed: int = 42,
               exact: bool = True) -> DataFrame:
    """price in [lo, hi] and grade >= g, then an exact sample of ``n`` rows.

    Defaults: lo/hi = int of the 10th/90th percentile, g = min grade. They are
    computed in the plan (one-row frame, broadcast), not collected. With all three given nothing is
    computed, and the bounds reach the scan (a table by ``sinks.write_clustered`` skips what lies outside)."""
    if None not in (price_min, price_max, min_grade):
        return sample_n(df.filter(F.col("price").between(float(price_min), float(price_max)) & (F.col("grade") >= min_grade)), n, seed)
    bounds = exact_percentiles(df, "price", [], [0.1, 0.9], ["__p10", "__p90"], exact=exact,
                               extra={"__gmin": F.min("grade")})
    lo = F.lit(float(price_min)) if price_min is not None else F.col("__p10").cast("bigint").cast("double")
    hi = F.lit(float(price_max)) if price_max is not None else F.col("__p90").cast("bigint").cast("double")
    g = F.lit(min_grade) if min_grade is not None else F.col("__gmin")
    f = attach(df, bounds).filter((F.col("price") >= lo) & (F.col("price") <= hi) & (F.col("grade") >= g))
    f = f.drop("__p10", "__p90", "__gmin")
    return sample_n(f, n, seed)


def luxury_listings(df: DataFrame, threshold: float = 1_000_000, n: int = 10) -> DataFrame:
    return df.filter(F.col("price") > threshold).orderBy("id").limit(n)


def recommend_basic(df: DataFrame, budget: float, bedrooms: int, n: int = 10) -> DataFrame:
    r = df.filter((F.col("price") <= budget) & (F.col("bedrooms") == bedrooms))
    return r.orderBy("id").limit(n)


def recommend(df: DataFrame, budget: float, bedrooms: int, min_grade: int, n: int = 10) -> DataFrame:
    """Matches ranked by value_score = sqft_living / price * 100000."""
    r = df.filter((F.col("price") <= budget) & (F.col("bedrooms") == bedrooms)
                  & (F.col("grade") >= min_grade))
    r = r.withColumn("value_score", value_score())
    return r.select(*present(r, RECOMMEND_COLUMNS)).orderBy(F.desc_nulls_last("value_score"), "id").limit(n)


def recommend_bounds(df: DataFrame) -> DataFrame:
    return df.agg(F.max("price").alias("max_price"), F.max("bedrooms").alias("max_bedrooms"),
                  F.min("grade").alias("min_grade"), F.max("grade").alias("max_grade"))


def listing_search(df: DataFrame, price_min: float = 0, price_max: float | None = None,
                   min_bedrooms: int = 0, status: str | None = None, featured: bool | None = None,
                   n: int | None = 50) -> DataFrame:
    """The total match count and the filtered listings (first ``n`` by id).
    A search without a match is one row: count 0 and no listing."""
    cond = (F.col("price") >= price_min) & (F.col("bedrooms") >= min_bedrooms)
    if price_max is not None:
        cond = cond & (F.col("price") <= price_max)
    if status is not None and "status" in df.columns:
        cond = cond & (F.lower(F.col("status")) == status.lower())
    if featured is not None and "featured" in df.columns:
        cond = cond & (F.col("featured") == int(featured))
    f = df.filter(cond)
    rows = f.select(*present(f, SEARCH_COLUMNS)).orderBy("id")
    rows = rows.limit(n) if n else rows
    total = f.agg(F.count(F.lit(1)).alias("n_matches"))
    none = total.filter("n_matches = 0")
    return attach(rows, total).unionByName(none, allowMissingColumns=True)


def search_cards(df: DataFrame, **kw) -> DataFrame:
    """The first twelve matches, as the result page shows them, with the count."""
    return listing_search(df, **{**kw, "n": CARDS})


def listing_count(df: DataFrame, **kw) -> DataFrame:
    """The number of matches, 0 included."""
    return listing_search(df, **{**kw, "n": 1}).select("n_matches")


def compare_listings(df: DataFrame, a: int, b: int) -> DataFrame:
    """Two listings side by side: (feature, property_a, property_b).

    ``filter(id in (a, b))`` is pushed into the scan; the unpivot and the
    regrouping handle two rows only."""
    feats = COMPARE_FEATURES + present(df, ["condition", "waterfront"])
    two = df.filter(F.col("id").isin(a, b)).select("id", *[F.col(c).cast("double").alias(c) for c in feats])
    long = two.unpivot("id", feats, "feature", "value")
    wide = long.groupBy("feature").agg(
        F.max(F.when(F.col("id") == a, F.col("value"))).alias("property_a"),
        F.max(F.when(F.col("id") == b, F.col("value"))).alias("property_b"))
    order = F.array_position(F.array(*[F.lit(c) for c in feats]), F.col("feature")).cast("int")
    return wide.select(order.alias("position"), "feature", feature_title(F.col("feature")).alias("label"),
                       "property_a", "property_b")


def compare_radar(df: DataFrame, a: int, b: int) -> DataFrame:
    """The radar inputs: every compared numeric feature except price, plus
    the shared axis maximum."""
    c = compare_listings(df, a, b).filter(F.col("feature") != "price")
    mx = c.agg(F.greatest(F.max("property_a"), F.max("property_b")).alias("axis_max"))
    return attach(c, mx)
