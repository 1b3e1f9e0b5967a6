"""``event_type_counts`` maintained incrementally.

The analytics-event log grows by appended files. The same aggregate as the
batch operator runs as a streaming query over the log folder: the state
store keeps one row per event type, each trigger folds in only new files,
and the checkpoint (in the shared checkpoint folder) lets a restarted query
resume where it stopped. Each trigger's complete result, with the shares
added, is written to a folder of its own epoch; readers take the newest
complete one (``latest_counts``), so they always see a whole snapshot, also
while the next one is written or after a crash.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearth.session import scratch_path

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def event_counts_state(events: DataFrame) -> DataFrame:
    """The stateful part: count and last time per event type."""
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("count"),
                                            F.max("ts").alias("last_event"))


def _publish(path: str):
    def write(batch: DataFrame, epoch: int) -> None:
        total = F.sum("count").over(Window.partitionBy())  # one row per event type
        out = batch.select("event_type", "count", "last_event", (F.col("count") / total).alias("share"))
        out.write.mode("overwrite").parquet(f"{path}/epoch={epoch}")
    return write


def latest_counts(spark: SparkSession, output: str) -> DataFrame:
    """The newest epoch of the published table that is complete (its writer
    left the success marker)."""
    base = spark._jvm.org.apache.hadoop.fs.Path(output)
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    done = fs.globStatus(spark._jvm.org.apache.hadoop.fs.Path(f"{output}/epoch=*/_SUCCESS"))
    epochs = [int(s.getPath().getParent().getName().split("=")[1]) for s in done or []]
    if not epochs:
        raise ValueError(f"no epoch has been published below {output}")
    return spark.read.parquet(f"{output}/epoch={max(epochs)}")


def run_event_counts(spark: SparkSession, source: str, output: str | None = None,
                     checkpoint: str | None = None, files_per_trigger: int | None = None) -> str:
    """Process every file that ``source`` (a file, a folder or a glob of them)
    holds now with ``availableNow`` and return the folder of the published epochs."""
    output = output or scratch_path(spark, "event_type_counts")
    checkpoint = checkpoint or scratch_path(spark, "event_type_counts_ckpt")
    reader = spark.readStream.schema(EVENTS_SCHEMA)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    counts = event_counts_state(reader.parquet(source))
    q = (counts.writeStream.outputMode("complete").foreachBatch(_publish(output))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return output
