"""File and table sources: CSV scan, parameterised SQL, the landed-file
catalog and the nested observation payload."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.schema import OBSERVATION_SCHEMA, RAW_SALES_SCHEMA


def scan_csv(spark: SparkSession, path: str, schema: T.StructType = RAW_SALES_SCHEMA,
             strict: bool = True) -> DataFrame:
    """CSV with a header and an explicit schema (no inference pass over the
    data). ``strict`` fails the job on a malformed line, like the reference's
    parse error; otherwise malformed fields become NULL."""
    return (spark.read.schema(schema).option("header", True)
            .option("mode", "FAILFAST" if strict else "PERMISSIVE").csv(path))


def scan_table(spark: SparkSession, query: str, args: list | dict | None = None,
               views: dict[str, DataFrame] | None = None) -> DataFrame:
    """Run SQL text with bound parameters over named frames.

    Positional ``?`` markers take a list, named ``:name`` markers a dict;
    values are bound by Spark, never spliced into the text."""
    for name, df in (views or {}).items():
        df.createOrReplaceTempView(name)
    return spark.sql(query, args=args) if args is not None else spark.sql(query)


def upload_catalog(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """One row per upload (``land_upload``), newest load first: load time, name,
    number of files, size in MB (2 dp), last modified. Only file metadata is
    read (the content column is pruned)."""
    files = (spark.read.format("binaryFile").option("pathGlobFilter", pattern)
             .option("recursiveFileLookup", True).load(folder)
             .select("path", "length", "modificationTime"))
    uploads = files.groupBy(
        F.regexp_extract("path", "/load_ts=([^/]+)/", 1).alias("load_ts"),
        F.regexp_extract("path", "/name=([^/]+)/", 1).alias("name"))
    return uploads.agg(
        F.count(F.lit(1)).alias("n_files"),
        F.round(F.sum("length") / 1048576.0, 2).alias("size_mb"),
        F.date_format(F.max("modificationTime"), "yyyy-MM-dd HH:mm").alias("uploaded"),
    ).orderBy(F.desc("load_ts"), "name")


def held_bytes(spark: SparkSession, folder: str, pattern: str = "*.csv") -> DataFrame:
    """(name, bytes) of the uploads below ``folder``, counted by reading every line (a line and its end). Files are read in splits, so a
    file of any size is not held whole by a task; a last line without an end counts one byte too many."""
    lines = (spark.read.option("pathGlobFilter", pattern).option("recursiveFileLookup", True).option("lineSep", "\n").text(folder)
             .select(F.regexp_extract("_metadata.file_path", "/name=([^/]+)/", 1).alias("name"), (F.octet_length("value") + 1).cast("bigint").alias("n")))
    return lines.groupBy("name").agg(F.sum("n").alias("bytes"))


def flatten_observation(df: DataFrame, col: str = "payload") -> DataFrame:
    """Nested weather JSON -> one flat row: temperature, feels_like,
    humidity, pressure, title-cased first description, wind speed, icon.
    Missing keys and an empty ``weather`` list give NULL."""
    o = F.from_json(F.col(col), OBSERVATION_SCHEMA)
    p = df.select("id", o.alias("o"))
    first = F.get(F.col("o.weather"), 0)
    return p.select(
        "id",
        F.col("o.main.temp").alias("temperature"),
        F.col("o.main.feels_like").alias("feels_like"),
        F.col("o.main.humidity").alias("humidity"),
        F.col("o.main.pressure").alias("pressure"),
        F.initcap(first.getField("description")).alias("description"),
        F.col("o.wind.speed").alias("wind_speed"),
        first.getField("icon").alias("icon"),
    )
