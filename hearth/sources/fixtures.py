"""Fixtures with the reference's input shapes, derived by Spark from the
given tables (see FIXTURES.md). Each is a lazy DataFrame, so every query's
work grows with the tables it reads.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hearth.operators.clean import clean_sales
from hearth.sources.tables import read_table

# The twelve sentences of the ``messages`` fixture, in order.
MESSAGE_SENTENCES = [
    "Hello there",
    "How much does a house cost",
    "What are the best investment opportunities?",
    "What are the current price trends?",
    "Show me the market overview",
    "Compare two homes",
    "Which areas have the best investment potential?",
    "Explain the random forest algorithm",
    "What can you do",
    "good job",
    "xyz",
    "Nearby area",
]


def _null_int() -> Column:
    return F.lit(None).cast("int")


def raw_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders JOIN customer``: one sale per order.

    The join is on ``o_custkey``; AQE picks broadcast or sort-merge from the
    runtime size of the customer side and splits a hot customer key when the
    sort-merge path is taken, so no size is assumed here.
    """
    o = read_table(spark, sf_dir, "orders").select(
        "o_orderkey", "o_custkey", "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    j = o.join(c, o.o_custkey == c.c_custkey, "inner")
    k, cu, tp = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    return j.select(
        k.alias("id"),
        F.when(k % 101 == 7, F.lit("bad-date"))
         .otherwise(F.date_format("o_orderdate", "yyyyMMdd'T'HHmmss")).alias("date"),
        (tp * 4.0).alias("price"),
        (1 + (cu + k) % 6).cast("int").alias("bedrooms"),
        (1.0 + (k % 13) * 0.25).alias("bathrooms"),
        F.when(k % 997 == 1, F.lit(0).cast("bigint"))
         .otherwise((400 + F.floor(tp / 110.0) + (k * 37) % 1200).cast("bigint"))
         .alias("sqft_living"),
        (1000 + (k * 53) % 9000).cast("bigint").alias("sqft_lot"),
        (1.0 + (k % 5) * 0.5).alias("floors"),
        F.when(k % 17 == 3, _null_int()).when(k % 31 == 0, F.lit(1)).otherwise(F.lit(0))
         .cast("int").alias("waterfront"),
        F.when(k % 29 == 5, _null_int()).otherwise(k % 5).cast("int").alias("view"),
        F.when(k % 23 == 4, _null_int()).otherwise(1 + cu % 5).cast("int").alias("condition"),
        F.least(F.lit(13).cast("bigint"), 3 + F.floor(tp / 60000.0) + cu % 4)
         .cast("int").alias("grade"),
        (1900 + cu % 116).cast("int").alias("yr_built"),
        F.when(k % 20 == 0, 1985 + k % 31).otherwise(0).cast("int").alias("yr_renovated"),
        F.when(k == 0, F.lit(98199)).otherwise(98001 + F.col("c_nationkey"))
         .cast("int").alias("zipcode"),
        (47.1 + (cu % 700) / 1000.0).alias("lat"),
        (-122.5 + (k % 900) / 1000.0).alias("long"),
        (400 + (k * 37) % 1200).cast("bigint").alias("sqft_above"),
        ((k % 3) * 250).cast("bigint").alias("sqft_basement"),
    )


def sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cleaned sales: defaults filled, date parsed, price_per_sqft, year, month."""
    return clean_sales(raw_sales(spark, sf_dir))


def sales_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``raw_sales`` plus an exact copy of every row with ``id % 50 = 0``."""
    r = raw_sales(spark, sf_dir)
    return r.unionByName(r.filter(F.col("id") % 50 == 0))


def analytics_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"), "event_type",
                    F.col("props").alias("event_data"), "user_id",
                    F.col("ts").alias("timestamp"))


def api_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("id"),
        F.concat(F.lit("/api/v1/"), F.col("event_type")).alias("endpoint"),
        F.when(eid % 3 == 0, F.lit("POST")).otherwise(F.lit("GET")).alias("method"),
        F.when(F.col("event_type") == "error", _null_int())
         .when(eid % 11 == 0, F.lit(404)).otherwise(F.lit(200)).cast("int").alias("status_code"),
        (F.abs(F.col("value")) / 100.0).alias("response_time"),
        F.concat(F.lit("10.0."), (F.col("user_id") % 256).cast("string"), F.lit("."),
                 (eid % 256).cast("string")).alias("client_ip"),
        F.col("ts").alias("timestamp"),
    )


def notifications(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return e.select(
        eid.alias("id"), "user_id",
        F.col("event_type").alias("title"),
        F.concat(F.lit("event "), eid.cast("string")).alias("message"),
        F.when(F.col("event_type") == "error", F.lit("error")).otherwise(F.lit("info")).alias("type"),
        (eid % 2).cast("int").alias("is_read"),
        F.col("ts").alias("created_at"),
    )


def chat_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns; ``turn`` stands in for the timestamp."""
    c = read_table(spark, sf_dir, "conversations")
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("conv_id").alias("session_id"), "role",
                    F.col("text").alias("content"), F.col("turn").alias("timestamp"))


def _sentence(idx: Column) -> Column:
    arr = F.array(*[F.lit(s) for s in MESSAGE_SENTENCES])
    return F.element_at(arr, (idx + 1).cast("int"))


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read_table(spark, sf_dir, "events")
    return e.select(F.col("event_id").alias("id"),
                    _sentence(F.col("event_id") % len(MESSAGE_SENTENCES)).alias("text"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON weather payload per event. ``wind`` is absent when
    ``event_id % 7 = 0`` and ``weather`` is empty when ``event_id % 13 = 0``.
    """
    e = read_table(spark, sf_dir, "events")
    eid = F.col("event_id")
    v = F.col("value")
    s = lambda c: c.cast("string")
    main = F.concat(F.lit('"main": {"temp": '), s(v), F.lit(', "feels_like": '), s(v - 1.5),
                    F.lit(', "humidity": '), s(eid % 100), F.lit(', "pressure": '),
                    s(1000 + eid % 40), F.lit("}"))
    weather = F.when(eid % 13 == 0, F.lit('"weather": []')).otherwise(
        F.concat(F.lit('"weather": [{"description": "'), F.col("event_type"),
                 F.lit(' sky", "icon": "'), s(eid % 10), F.lit('d"}]')))
    wind = F.when(eid % 7 == 0, F.lit("")).otherwise(
        F.concat(F.lit(', "wind": {"speed": '), s(eid % 15), F.lit("}")))
    payload = F.concat(F.lit("{"), main, F.lit(", "), weather, wind, F.lit("}"))
    return e.select(eid.alias("id"), payload.alias("payload"))
