"""Sinks and sources by read-back; the streaming aggregate resumes from its
checkpoint and equals the batch result."""

import os

from pyspark.sql import functions as F

from tests.conftest import SF_SMALL
from hearth import sinks
from hearth.operators import logs, market
from hearth.session import scratch_path
from hearth.sources import files, fixtures as sfx
from hearth.sources.tables import read_table


def test_csv_round_trip_and_catalog(spark):
    raw = sfx.raw_sales(spark, SF_SMALL)
    landing = scratch_path(spark, "t-landing")
    part = sinks.land_upload(raw, landing, "20240101_000000")
    back = files.scan_csv(spark, part)
    assert back.exceptAll(raw).count() == 0 and raw.exceptAll(back).count() == 0
    sinks.land_upload(raw.limit(10), landing, "20240301_000000", "later")
    sinks.land_upload(raw.limit(10), landing, "20240301_000000", "again")
    cat = files.upload_catalog(spark, landing).collect()
    assert [(r.load_ts, r.name) for r in cat] == [("20240301_000000", "again"), ("20240301_000000", "later"), ("20240101_000000", "sales")]
    assert all(r.n_files > 0 and r.uploaded for r in cat) and cat[2].size_mb > 0


def test_listing_defaults(spark):
    df = spark.createDataFrame([(1, "a", 10.0, None, None)], "id long, title string, price double, grade int, status string")
    r = sinks.with_listing_defaults(df).first()
    assert r.grade == 7 and r.condition == 3 and r.waterfront == 0 and r.view == 0
    assert r.status == "active" and r.featured == 0 and r.created_at is not None


def test_summary_exports(spark):
    s = market.summary_stats(sfx.sales(spark, SF_SMALL))
    pj = sinks.export_summary_json(s, scratch_path(spark, "t-sj"))
    back = spark.read.json(pj).first()
    assert back.total_properties == 1500 and back.price_range.min <= back.price_range.max
    pc = sinks.export_summary_csv(s, scratch_path(spark, "t-sc"))
    row = spark.read.option("header", True).csv(pc).first()
    assert row.correlation_matrix.startswith("[")


def test_flatten_observation_missing_keys(spark):
    df = spark.createDataFrame([(1, '{"main": {"temp": 10.5}, "weather": []}'),
                                (2, '{"main": {"temp": 1, "humidity": 50}, "weather": [{"description": "light rain", "icon": "10d"}], "wind": {"speed": 3.5}}')],
                               "id long, payload string")
    got = {r.id: r for r in files.flatten_observation(df).collect()}
    assert got[1].temperature == 10.5 and got[1].description is None and got[1].wind_speed is None
    assert got[2].description == "Light Rain" and got[2].icon == "10d" and got[2].wind_speed == 3.5


def test_scan_table_binds_parameters(spark):
    ev = sfx.analytics_events(spark, SF_SMALL)
    q = files.scan_table(spark, "SELECT count(*) AS n FROM ev WHERE event_type = ?", ["error"], {"ev": ev})
    assert q.first().n == ev.filter(F.col("event_type") == "error").count()


def test_stream_resumes_and_matches_batch(spark):
    from hearth.streaming.events import latest_counts, run_event_counts
    ev = read_table(spark, SF_SMALL, "events")
    src = scratch_path(spark, "t-stream-src")
    ckpt = scratch_path(spark, "t-stream-ckpt")
    out = scratch_path(spark, "t-stream-out")
    ev.filter(F.col("event_id") % 2 == 0).write.parquet(f"{src}/a")
    run_event_counts(spark, f"{src}/*", out, ckpt)
    first = {r.event_type: r["count"] for r in latest_counts(spark, out).collect()}
    ev.filter(F.col("event_id") % 2 == 1).write.parquet(f"{src}/b")
    run_event_counts(spark, f"{src}/*", out, ckpt)  # resumes: only part b is new
    got = {r.event_type: (r["count"], r.last_event) for r in latest_counts(spark, out).collect()}
    want = {r.event_type: (r["count"], r.last_event)
            for r in logs.event_type_counts(sfx.analytics_events(spark, SF_SMALL)).collect()}
    assert got == want and sum(first.values()) < sum(c for c, _ in got.values())


def test_landing_is_idempotent_per_load(spark):
    raw = sfx.raw_sales(spark, SF_SMALL)
    landing = scratch_path(spark, "t-landing2")
    sinks.land_upload(raw, landing, "a")
    sinks.land_upload(raw, landing, "a")
    sinks.land_upload(raw.limit(10), landing, "b")
    back = spark.read.option("header", True).csv(landing)
    got = {r.load_ts: r["count"] for r in back.groupBy("load_ts").count().collect()}
    assert got == {"a": raw.count(), "b": 10}


def test_stream_reads_a_folder_and_a_file_and_skips_unfinished_epochs(spark, tmp_path):
    import os
    from hearth.plans.registry import QUERIES, load_all
    from hearth.streaming.events import latest_counts, run_event_counts
    load_all()
    ev = read_table(spark, SF_SMALL, "events")
    ev.repartition(3).write.parquet(f"{tmp_path}/events.parquet")
    want = {tuple(r) for r in QUERIES["event_type_counts_stream"](spark, SF_SMALL).collect()}
    assert {tuple(r) for r in QUERIES["event_type_counts_stream"](spark, str(tmp_path)).collect()} == want
    out = run_event_counts(spark, f"{tmp_path}/events.parquet*", f"{tmp_path}/out")
    os.makedirs(f"{tmp_path}/out/epoch=99")  # a writer that died
    assert latest_counts(spark, out).count() == len(want)


def test_held_bytes_are_read_in_splits(spark, tmp_path):
    """Every byte of an upload counts, and no task reads a file whole."""
    part = sinks.land_upload(spark.range(3000).select("id", F.concat(F.lit("\u00e4,\r x"), F.col("id").cast("string")).alias("t")).coalesce(1), str(tmp_path), "20240101_000000", "one")
    size = sum(os.path.getsize(os.path.join(part, f)) for f in os.listdir(part) if f.endswith(".csv"))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        assert [tuple(r) for r in files.held_bytes(spark, str(tmp_path)).collect()] == [("one", size)]
        assert spark.read.text(part).rdd.getNumPartitions() > 1
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
