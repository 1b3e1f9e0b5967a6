"""Event, API and notification log reads (the reference's analytic SQL)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hearth.operators.topn import latest


def event_type_counts(df: DataFrame) -> DataFrame:
    """count and last time per event type, with the share of all events
    (the pie). The total is summed over the grouped result."""
    g = df.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"),
                                     F.max("timestamp").alias("last_event"))
    # A window without partitions over one row per event type: no second scan.
    total = F.sum("count").over(Window.partitionBy())
    return g.select("event_type", "count", "last_event", (F.col("count") / total).alias("share"))


def status_distribution(df: DataFrame, last: int = 100, keep_missing: bool = False) -> DataFrame:
    """Calls per status code among the last ``last`` calls. A failed call has
    no status and drops out, as in the reference, unless ``keep_missing``."""
    recent = latest(df, "timestamp", last)
    if not keep_missing:
        recent = recent.filter(F.col("status_code").isNotNull())
    return recent.groupBy("status_code").agg(F.count(F.lit(1)).alias("count"))


def endpoint_latency(df: DataFrame, last: int = 100, n: int = 10) -> DataFrame:
    recent = latest(df, "timestamp", last)
    g = recent.filter(F.col("endpoint").isNotNull()).groupBy("endpoint").agg(
        F.avg("response_time").alias("response_time"))
    return g.orderBy(F.desc_nulls_last("response_time"), "endpoint").limit(n)


def unread_counts(df: DataFrame, user_id: int | None = None) -> DataFrame:
    """Unread notifications per user (all users, or one)."""
    f = df.filter(F.col("is_read") == 0)
    if user_id is not None:
        f = f.filter(F.col("user_id") == user_id)
    return f.groupBy("user_id").agg(F.count(F.lit(1)).alias("unread"))
