"""Valuation against the local median, and per-group recency windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.operators.quantiles import exact_percentiles, join_on_keys
from hearth.session import materialize

UNDERVALUED_COLUMNS = ["id", "price", "zipcode", "price_per_sqft", "sqft_living",
                       "bedrooms", "valuation_ratio", "grade"]


def valuation_ratio(df: DataFrame, by: str = "zipcode", value: str = "price_per_sqft",
                    exact: bool = True) -> DataFrame:
    """``value / median(value) within the row's zipcode``, row-aligned.

    Not a window: ``median().over(partitionBy(zipcode))`` would sort a whole
    zipcode in one task. The two columns the medians need are materialized
    once and both passes of the skew-safe selection read them; the medians are
    materialized too, so the planner knows their size and broadcasts them
    when it is small (else a skew-aware shuffle join). Rows with a NULL
    zipcode get NULL, as in the reference.
    """
    narrow = materialize(df.select(by, value).filter(F.col(by).isNotNull()), "valuation")
    med = materialize(exact_percentiles(narrow, value, [by], [0.5], ["__group_median"], exact=exact), "medians")
    j = join_on_keys(df, med, [by], "left", null_safe=False)
    return j.withColumn("valuation_ratio", F.try_divide(F.col(value), F.col("__group_median"))) \
            .drop("__group_median")


def undervalued(df: DataFrame, n: int | None = 10, threshold: float = 0.8,
                exact: bool = True) -> DataFrame:
    """Sales priced below ``threshold`` of their zipcode's median price per
    sqft: the ``n`` lowest ratios in order (ties by id), or all of them in no
    order (None)."""
    r = valuation_ratio(df, exact=exact).filter(F.col("valuation_ratio") < threshold)
    r = r.select(*[c for c in UNDERVALUED_COLUMNS if c in r.columns])
    return r.orderBy(F.asc_nulls_last("valuation_ratio"), "id").limit(n) if n else r


def latest_per_group(df: DataFrame, group: str, order: list, n: int) -> DataFrame:
    """The last ``n`` rows of every group (``row_number <= n``).

    Spark plans this with a WindowGroupLimit before the shuffle, so each
    partition forwards at most ``n`` rows per group: a hot group costs no
    more than a cold one downstream."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def recent_chat(df: DataFrame, n: int = 50) -> DataFrame:
    """Last ``n`` messages of every session; ``rn`` 1 is the newest, the larger
    id first among equal times (the reference shows them oldest first:
    order by rn desc)."""
    return latest_per_group(df, "session_id", [F.desc("timestamp"), F.desc("id")], n).select(
        "session_id", "rn", "id", "role", "content", "timestamp")


def recent_notifications(df: DataFrame, n: int = 10) -> DataFrame:
    return latest_per_group(df, "user_id", [F.desc("created_at"), F.desc("id")], n).select(
        "user_id", "rn", "id", "title", "message", "type", "is_read", "created_at")
