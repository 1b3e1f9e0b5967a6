"""Sorts, limits and samples. Every ordering ends in ``id`` so a limit
selects the same rows on any partitioning (R5); ``orderBy(...).limit(n)``
plans as TakeOrderedAndProject (per-partition top-n, then a merge of n rows
per partition)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hearth.functions.features import investment_score
from hearth.operators.util import present

TOP_PRICE_COLUMNS = ["id", "price", "bedrooms", "bathrooms", "sqft_living", "grade", "zipcode"]


def top_price(df: DataFrame, n: int = 10) -> DataFrame:
    return df.select(*present(df, TOP_PRICE_COLUMNS)).orderBy(F.desc_nulls_last("price"), "id").limit(n)


def top_investments(df: DataFrame, n: int = 10) -> DataFrame:
    cols = ["id", "price", "zipcode", "investment_score", "sqft_living"]
    cols += present(df, ["grade", "condition", "waterfront", "view", "yr_renovated"])
    s = df.withColumn("investment_score", investment_score(df.columns))
    return s.select(*cols).orderBy(F.desc("investment_score"), "id").limit(n)


def cheapest_per_sqft(df: DataFrame, n: int = 10) -> DataFrame:
    return df.orderBy(F.asc_nulls_last("price_per_sqft"), "id").limit(n)


def latest(df: DataFrame, ts: str, n: int, cols: list[str] | None = None, key: str = "id") -> DataFrame:
    out = df.orderBy(F.desc_nulls_last(ts), F.desc(key)).limit(n)
    return out.select(*cols) if cols else out


def recent_events(df: DataFrame, n: int = 50) -> DataFrame:
    return latest(df, "timestamp", n, ["id", "event_type", "event_data", "user_id", "timestamp"])


def recent_api_calls(df: DataFrame, n: int = 100) -> DataFrame:
    return latest(df, "timestamp", n, ["id", "endpoint", "method", "status_code",
                                       "response_time", "timestamp"])


def preview(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("id").limit(n)


def first_markers(df: DataFrame, n: int = 300) -> DataFrame:
    return df.orderBy("id").limit(n).select("id", "lat", "long", "price", "bedrooms")


def distinct_sorted(df: DataFrame, col: str = "zipcode") -> DataFrame:
    return df.select(col).filter(F.col(col).isNotNull()).distinct().orderBy(col)


def sample_key(seed: int = 42, key: str = "id") -> Column:
    """A hash of the key and seed: a deterministic random order that does
    not depend on partitioning, with the same text in SQL engines."""
    return F.md5(F.concat(F.col(key).cast("string"), F.lit(f"-{seed}")))


def sample_n(df: DataFrame, n: int, seed: int = 42, key: str = "id") -> DataFrame:
    """Exactly ``min(n, rows)`` rows without replacement (a top-n by the
    hash, so memory is ``n`` rows per partition)."""
    return df.orderBy(sample_key(seed, key), key).limit(n)


def scatter_projection(df: DataFrame, cols: list[str], n: int = 2000, seed: int = 42) -> DataFrame:
    """The columns behind a 2-D / 3-D / matrix scatter of a sample."""
    return sample_n(df.select(*(["id"] + [c for c in cols if c != "id"])), n, seed)
