"""Batched appends, the clustered layout and the level dictionary."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from hearth import sinks
from hearth.operators import ml, search
from hearth.session import scratch_path
from tests.conftest import SF_SMALL
from hearth.sources import fixtures as sfx


def test_a_batch_is_added_once(spark):
    path = scratch_path(spark, "batches")
    for batch in ("a", "b", "a"):
        sinks.append_batch(spark.range(5).withColumn("batch_of", F.lit(batch)), path, batch)
    assert sinks.committed_batches(spark, path) == ["a", "b"] and sinks.read_appended(spark, path).count() == 10
    for _ in range(2):
        sinks.append_batch(spark.range(5).withColumn("batch_of", F.lit("own")), path)
    assert sinks.read_appended(spark, path).count() == 20


def test_a_batch_that_broke_off_is_not_seen_and_is_replaced(spark, monkeypatch):
    path = scratch_path(spark, "batches")
    sinks.append_batch(spark.range(3), path, "first")
    commit = sinks._commit
    monkeypatch.setattr(sinks, "_commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
    with pytest.raises(OSError):
        sinks.append_batch(spark.range(100), path, "second")
    assert sinks.read_appended(spark, path).count() == 3
    monkeypatch.setattr(sinks, "_commit", commit)
    sinks.append_batch(spark.range(7), path, "second")
    assert sinks.read_appended(spark, path).count() == 10


def test_appends_of_listings_and_loads(spark):
    path = scratch_path(spark, "batches")
    with pytest.raises(ValueError):
        sinks.read_appended(spark, path)
    assert sinks.read_appended(spark, path, "id long").count() == 0
    for name in ("../x", "", "a/b"):
        with pytest.raises(ValueError):
            sinks.append_batch(spark.range(1), path, name or "/")
    for _ in range(2):
        sinks.append_listing(spark.range(4).withColumn("price", F.lit(1.0)), path, "l1")
    assert sorted((r.id, r.grade, r.status) for r in sinks.read_appended(spark, path).collect()) == [(i, 7, "active") for i in range(4)]


def rows_read(df):
    """Rows that the scans of a collected plan gave on, by Spark's own counter."""
    df.collect()
    total = 0

    def visit(node):
        nonlocal total
        if "Scan parquet" in node.nodeName():
            total += node.metrics().apply("numOutputRows").value()
        kids = node.children()
        for i in range(kids.size()):
            visit(kids.apply(i))
        if node.nodeName() == "AdaptiveSparkPlan":
            visit(node.executedPlan())
        if hasattr(node, "plan") and "QueryStage" in node.nodeName():
            visit(node.plan())
    visit(df._jdf.queryExecution().executedPlan())
    return total


def test_a_clustered_table_reads_less(spark):
    sales = sfx.sales(spark, SF_SMALL.replace("0.001", "0.01")).coalesce(1)
    plain, near = scratch_path(spark, "plain"), scratch_path(spark, "near")
    sales.write.parquet(plain)
    sinks.write_clustered(sales, near, files=64)  # two cuts in each of three columns
    n = sales.count()
    box = (F.col("lat") < 47.25) & (F.col("long") < -122.2) & F.col("price").between(3e5, 9e5)
    results = []
    for path in (plain, near):
        t = spark.read.parquet(path)
        results.append(([sorted(map(tuple, x.collect())) for x in (t.filter(box), search.map_filter(t, 400_000, 700_000, 4, n=300))],
                        [rows_read(x) for x in (t.filter(box), t.filter(F.col("price") < 2e5), t.filter(F.col("lat") > 47.7))]))
    (same, all_), (found, some) = results
    assert found == same and all(a == n for a in all_)
    assert some[0] < 0.25 * n and some[1] < 0.5 * n and some[2] < 0.5 * n


def test_clustered_order_takes_nulls(spark):
    df = spark.createDataFrame([(None, 1.0), (2.0, None), (3.0, 4.0), (None, None)], "a double, b double")
    path = sinks.write_clustered(df, scratch_path(spark, "near"), ("a", "b"))
    assert sorted(map(str, spark.read.parquet(path).collect())) == sorted(map(str, df.collect()))
    assert spark.read.parquet(sinks.write_clustered(df.limit(0), scratch_path(spark, "near"), ("a", "b"))).count() == 0


def test_vectors_of_levels_equal_the_columns(spark):
    df = spark.createDataFrame([(i, c) for i, c in enumerate(["b", "a", None, "d", "c", "a", "b"])], "id long, c string")
    wide = {r.id: [r[f"c_{x}"] for x in "bcd"] for r in ml.one_hot(df, "c").collect()}
    got = ml.one_hot_vectors(df, "c").select("id", vector_to_array("c_dummies").alias("v")).collect()
    assert {r.id: [int(x) for x in r.v] for r in got} == wide
    for few in (df.filter("c = 'a' OR c IS NULL"), df.limit(0)):
        assert all(r.c_dummies.size == 0 for r in ml.one_hot_vectors(few, "c").collect())


def test_many_levels(spark):
    n = 300_000
    df = spark.range(n).select("id", F.format_string("%07d", F.pmod(F.col("id") * 7919, F.lit(n))).alias("c"))
    ranks = ml.level_dictionary(df, "c")
    assert ranks.count() == n and ranks.filter(F.col("level").cast("bigint") != F.col("rank")).isEmpty()
    v = ml.one_hot_vectors(df, "c", "v").filter("id IN (0, 1, 2)").collect()
    assert {r.id: (r.v.size, r.v.indices.tolist()) for r in v} == {i: (n - 1, [i * 7919 % n - 1] if i else []) for i in range(3)}
    with pytest.raises(ValueError):
        ml.one_hot(df, "c")
