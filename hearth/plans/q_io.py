"""Registered queries: sources and sinks, checked by read-back."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Window
from pyspark.sql import functions as F

from hearth import sinks
from hearth.operators import market as mk
from hearth.operators.util import round_doubles
from hearth.plans.q_market import SUMMARY_ROWS, _corr_sql, _summary_rows
from hearth.plans.registry import register
from hearth.schema import RAW_SALES_SCHEMA
from hearth.session import scratch_path
from hearth.sources import files as fi
from hearth.sources import fixtures as sfx

RAW_ROUNDED = ("SELECT * REPLACE (round(price, 6) AS price, round(bathrooms, 6) AS bathrooms, "
               "round(floors, 6) AS floors, round(lat, 6) AS lat, round(long, 6) AS long) FROM raw_sales")


@register("scan_csv", RAW_ROUNDED)
def q_scan_csv(spark, d):
    """Land raw sales as CSV (``land_upload``), scan it back with the
    explicit schema."""
    landing = scratch_path(spark, "landing")
    part = sinks.land_upload(sfx.raw_sales(spark, d), landing, "20240101_000000")
    return round_doubles(fi.scan_csv(spark, part), 6)


@register("land_upload", RAW_ROUNDED.replace("FROM raw_sales", ", '20240101_000000' AS load_ts, 'sales' AS name FROM raw_sales"))
def q_land_upload(spark, d):
    landing = scratch_path(spark, "landing")
    sinks.land_upload(sfx.raw_sales(spark, d), landing, "20240101_000000")
    from pyspark.sql import types as T
    schema = T.StructType(RAW_SALES_SCHEMA.fields + [T.StructField("load_ts", T.StringType()), T.StructField("name", T.StringType())])
    back = spark.read.schema(schema).option("header", True).csv(landing)
    return round_doubles(back, 6)


@register("export_csv", RAW_ROUNDED)
def q_export_csv(spark, d):
    p = sinks.export_csv(sfx.raw_sales(spark, d), scratch_path(spark, "export"))
    return round_doubles(fi.scan_csv(spark, p), 6)


@register("snapshot_cache", RAW_ROUNDED.replace("FROM raw_sales", "FROM raw_sales ORDER BY id LIMIT 1000"))
def q_snapshot(spark, d):
    t = sinks.snapshot_cache(sfx.raw_sales(spark, d), scratch_path(spark, "properties_cache"))
    return round_doubles(t, 6)


@register("scan_table", """
SELECT event_type, count(*) AS count, max(timestamp) AS last_event FROM analytics_events
WHERE user_id >= 10 GROUP BY event_type""")
def q_scan_table(spark, d):
    return fi.scan_table(
        spark,
        "SELECT event_type, COUNT(*) AS count, MAX(timestamp) AS last_event "
        "FROM analytics_events WHERE user_id >= ? GROUP BY event_type",
        args=[10], views={"analytics_events": sfx.analytics_events(spark, d)})


@register("append_listing", """
SELECT id, 'Listing ' || CAST(id AS VARCHAR) AS title, 'Derived listing' AS description, price, bedrooms,
       bathrooms, sqft_living, zipcode, coalesce(grade, 7) AS grade, coalesce(condition, 3) AS condition,
       coalesce(waterfront, 0) AS waterfront, coalesce(view, 0) AS view, 'active' AS status, 0 AS featured
FROM (SELECT id, price, bedrooms, bathrooms, sqft_living, zipcode,
             CASE WHEN id % 7 = 0 THEN NULL ELSE grade END AS grade, condition, waterfront, view
      FROM raw_sales)""")
def q_append_listing(spark, d):
    r = sfx.raw_sales(spark, d)
    new = r.select("id", F.concat(F.lit("Listing "), F.col("id").cast("string")).alias("title"),
                   F.lit("Derived listing").alias("description"), "price", "bedrooms", "bathrooms",
                   "sqft_living", "zipcode",
                   F.when(F.col("id") % 7 == 0, F.lit(None).cast("int")).otherwise(F.col("grade")).alias("grade"),
                   "condition", "waterfront", "view")
    path = scratch_path(spark, "listings")
    for part, batch in ((0, "even"), (1, "odd"), (0, "even")):  # the last is a rerun
        sinks.append_listing(new.filter(F.col("id") % 2 == part), path, batch)
    return sinks.read_appended(spark, path).drop("created_at", "updated_at")


@register("append_load_event", """
SELECT 'data_load' AS event_type, '{"rows":' || CAST(count(*) AS VARCHAR) || ',"columns":22}' AS event_data,
       CAST(1 AS BIGINT) AS user_id, 's-1' AS session_id
FROM sales""")
def q_append_load_event(spark, d):
    path = scratch_path(spark, "events")
    for _ in range(2):  # one load, reported twice
        sinks.append_load_event(sfx.sales(spark, d), path, 1, "s-1", batch="load-1")
    return sinks.read_appended(spark, path).drop("timestamp")  # the time of the call


@register("export_summary_csv", SUMMARY_ROWS)
def q_export_summary_csv(spark, d):
    """The CSV read back; its nested values are JSON text."""
    p = sinks.export_summary_csv(mk.summary_stats(sfx.sales(spark, d)), scratch_path(spark, "summary_csv"))
    back = spark.read.option("header", True).csv(p)
    return _summary_rows(back.withColumns({
        "price_range": F.from_json("price_range", "min double, max double"),
        "correlation_matrix": F.from_json("correlation_matrix", "array<struct<col_a:string,col_b:string,r:double>>")}))


@register("export_summary_json", SUMMARY_ROWS)
def q_export_summary_json(spark, d):
    p = sinks.export_summary_json(mk.summary_stats(sfx.sales(spark, d)), scratch_path(spark, "summary_json"))
    return _summary_rows(spark.read.json(p))


@register("export_correlation_json", _corr_sql())
def q_export_corr(spark, d):
    p = sinks.export_correlation_json(mk.correlation_matrix(sfx.sales(spark, d)), scratch_path(spark, "corr"))
    back = spark.read.schema("correlation map<string,map<string,double>>").json(p)
    pairs = back.select(F.explode("correlation").alias("col_a", "m")).select("col_a", F.explode("m").alias("col_b", "r"))
    return round_doubles(pairs, 6)


@register("upload_catalog", """
SELECT load_ts, name, CAST(n AS BIGINT) AS n_files, true AS size_is_that_of_the_files, true AS uploaded_just_now, row_number() OVER (ORDER BY load_ts DESC, name) AS place
FROM (VALUES ('20240102_000000', 'second', 1), ('20240101_000000', 'first', 3), ('20240101_000000', 'other', 2)) AS u(load_ts, name, n)
WHERE (SELECT count(*) FROM raw_sales) > 2""")
def q_upload_catalog(spark, d):
    """Three uploads of known numbers of files. Sizes are held against the bytes that the files hold, times against the clock."""
    landing, raw = scratch_path(spark, "landing"), sfx.raw_sales(spark, d)
    started = datetime.now(timezone.utc).replace(second=0, microsecond=0)
    for ts, name, n in (("20240101_000000", "first", 3), ("20240101_000000", "other", 2), ("20240102_000000", "second", 1)):
        sinks.land_upload(raw.repartition(n), landing, ts, name)
    held = fi.held_bytes(spark, landing)
    w = Window.orderBy(F.desc("load_ts"), "name")  # one row per upload
    return fi.upload_catalog(spark, landing).join(held, "name").select(
        "load_ts", "name", "n_files", (F.abs(F.col("size_mb") - F.col("bytes") / 1048576) <= 0.005001).alias("size_is_that_of_the_files"),
        (F.col("uploaded") >= started.strftime("%Y-%m-%d %H:%M")).alias("uploaded_just_now"), F.row_number().over(w).cast("bigint").alias("place"))
