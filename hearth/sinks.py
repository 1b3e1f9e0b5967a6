"""Sinks: landing, snapshot, exports and appends.

Writes are distributed (one file per task); nothing is coalesced into one
task. A table that is appended to is a folder of batches with a manifest: a batch's files
are written first, its entry in the manifest last, and ``read_appended`` reads the batches that the manifest
names. So a batch that is run again is not added twice, and one that broke off before its
entry is not seen; run again, it replaces its files.
"""

from __future__ import annotations

import re
import uuid
from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Column defaults of the listings table.
LISTING_DEFAULTS = {"waterfront": 0, "view": 0, "condition": 3, "grade": 7,
                    "status": "active", "featured": 0}
LISTING_COLUMNS = ["id", "title", "description", "price", "bedrooms", "bathrooms", "sqft_living",
                   "zipcode", "grade", "condition", "waterfront", "view", "status", "featured",
                   "created_at", "updated_at"]


def land_upload(df: DataFrame, landing: str, load_ts: str | None = None, name: str = "sales") -> str:
    """Persist a loaded table under a partition of ``landing`` that carries the
    load time and the upload's name. Only that partition is replaced
    (dynamic overwrite), so re-running a load is idempotent and other loads stay."""
    ts = load_ts or datetime.now().strftime("%Y%m%d_%H%M%S")
    (df.withColumns({"load_ts": F.lit(ts), "name": F.lit(name)}).write.mode("overwrite")
       .option("partitionOverwriteMode", "dynamic").partitionBy("load_ts", "name")
       .option("header", True).csv(landing))
    return f"{landing.rstrip('/')}/load_ts={ts}/name={name}"


def snapshot_cache(df: DataFrame, path: str, table: str = "properties_cache", n: int = 1000) -> DataFrame:
    """First ``n`` rows by id -> table ``table`` (replaced on each load)."""
    spark = df.sparkSession
    (df.orderBy("id").limit(n).write.mode("overwrite").format("parquet")
       .option("path", path).saveAsTable(table))
    return spark.table(table)


def clustered_order(df: DataFrame, cols: list[str], bits: int = 6) -> Column:
    """A number along a space-filling curve (Morton order) over ``cols``: each value's place among 2^bits approximate quantiles, the
    places' bits interleaved. Rows near each other in all columns get numbers near each other; null counts as the smallest."""
    row = df.agg(*[F.percentile_approx(F.col(c).cast("double"), [i / 2 ** bits for i in range(1, 2 ** bits)], 1000).alias(f"q{i}") for i, c in enumerate(cols)]).first()
    out = F.lit(0).cast("bigint")
    for i, c in enumerate(cols):
        cuts = F.array(*[F.lit(float(q)) for q in sorted(set(row[f"q{i}"] or []))]) if row[f"q{i}"] else F.expr("cast(array() as array<double>)")
        place = F.size(F.filter(cuts, lambda q: q < F.col(c).cast("double")))
        for b in range(bits):
            out = out + F.shiftleft(F.shiftright(place, b).bitwiseAND(F.lit(1)).cast("bigint"), b * len(cols) + i)
    return out


def write_clustered(df: DataFrame, path: str, cols: tuple[str, ...] = ("lat", "long", "price"), files: int | None = None,
                    row_group_bytes: int | None = None) -> str:
    """Write ``df`` as Parquet in the order of ``clustered_order``: every file and row group covers a small box of ``cols``, so
    a filter on any of them (``map_filter``, ``listing_search``, ``area_filter`` on such a table) skips the others by their
    minima and maxima. ``files``: number of ranges (None: Spark's shuffle partitions)."""
    place = df.withColumn("__place", clustered_order(df, list(cols)))
    ranged = place.repartitionByRange(files, "__place") if files else place.repartitionByRange("__place")
    writer = ranged.sortWithinPartitions("__place").drop("__place").write.mode("overwrite")
    if row_group_bytes:
        writer = writer.option("parquet.block.size", row_group_bytes)
    writer.parquet(path)
    return path


def export_csv(df: DataFrame, path: str) -> str:
    df.write.mode("overwrite").option("header", True).csv(path)
    return path


def _nested_as_text(df: DataFrame) -> DataFrame:
    from pyspark.sql import types as T
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            cols.append(F.to_json(F.col(f.name)).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def export_summary_csv(summary: DataFrame, path: str) -> str:
    """The summary record as one CSV row; nested values as JSON text."""
    _nested_as_text(summary).write.mode("overwrite").option("header", True).csv(path)
    return path


def export_summary_json(summary: DataFrame, path: str) -> str:
    summary.write.mode("overwrite").json(path)
    return path


def export_correlation_json(corr: DataFrame, path: str) -> str:
    """Correlation matrix as ``{col_a: {col_b: r}}`` JSON (one small row:
    p^2 entries, bounded by the column count)."""
    inner = corr.groupBy("col_a").agg(F.map_from_entries(F.collect_list(F.struct("col_b", "r"))).alias("m"))
    outer = inner.agg(F.map_from_entries(F.collect_list(F.struct("col_a", "m"))).alias("correlation"))
    outer.write.mode("overwrite").json(path)
    return path


def with_listing_defaults(df: DataFrame) -> DataFrame:
    """Apply the column defaults and timestamps to new listings."""
    now = F.current_timestamp().cast("timestamp_ntz")
    cols = []
    for c in LISTING_COLUMNS:
        if c in ("created_at", "updated_at"):
            cols.append((F.coalesce(F.col(c), now) if c in df.columns else now).alias(c))
        elif c in LISTING_DEFAULTS:
            d = F.lit(LISTING_DEFAULTS[c])
            cols.append((F.coalesce(F.col(c), d) if c in df.columns else d).alias(c))
        else:
            cols.append(F.col(c) if c in df.columns else F.lit(None).alias(c))
    return df.select(*cols)


BATCH_NAME = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*")


def _fs_path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _commit(spark: SparkSession, path: str, batch: str) -> None:
    fs, entry = _fs_path(spark, f"{path}/_batches/{batch}")
    fs.createNewFile(entry)


def committed_batches(spark: SparkSession, path: str) -> list[str]:
    """Names of the batches in the manifest, sorted."""
    fs, folder = _fs_path(spark, f"{path.rstrip('/')}/_batches")
    return sorted(f.getPath().getName() for f in fs.listStatus(folder)) if fs.exists(folder) else []


def append_batch(df: DataFrame, path: str, batch: str | None = None) -> str:
    """Add ``df`` to the table at ``path`` as ``batch`` (None: one of its own, added on every call). A batch that is
    there already is left as it is. One writer per batch at a time; different batches may be written side by side."""
    spark, path, batch = df.sparkSession, path.rstrip("/"), batch or uuid.uuid4().hex
    if not BATCH_NAME.fullmatch(batch):
        raise ValueError(f"a batch is named by letters, digits, '.', '_' and '-': {batch!r}")
    if batch not in committed_batches(spark, path):
        df.write.mode("overwrite").parquet(f"{path}/data/batch={batch}")
        _commit(spark, path, batch)
    return path


def read_appended(spark: SparkSession, path: str, schema=None) -> DataFrame:
    """The rows of all batches in the manifest. Without any, an empty table of ``schema``, which is needed then."""
    path = path.rstrip("/")
    folders = [f"{path}/data/batch={b}" for b in committed_batches(spark, path)]
    if not folders:
        if schema is None:
            raise ValueError(f"no batch at {path}, and no schema given")
        return spark.createDataFrame([], schema)
    reader = spark.read if schema is None else spark.read.schema(schema)
    return reader.parquet(*folders)


def append_listing(df: DataFrame, path: str, batch: str | None = None) -> str:
    return append_batch(with_listing_defaults(df), path, batch)


def append_load_event(df: DataFrame, path: str, user_id: int | None = None,
                      session_id: str | None = None, batch: str | None = None) -> str:
    """Record a ``data_load`` event with JSON ``{rows, columns}``: the row
    count is a global count aggregate, the column count is schema."""
    ev = df.agg(F.count(F.lit(1)).alias("rows")).select(
        F.lit("data_load").alias("event_type"),
        F.to_json(F.struct(F.col("rows"), F.lit(len(df.columns)).alias("columns"))).alias("event_data"),
        F.lit(user_id).cast("bigint").alias("user_id"), F.lit(session_id).cast("string").alias("session_id"),
        F.current_timestamp().cast("timestamp_ntz").alias("timestamp"))
    return append_batch(ev, path, batch)
