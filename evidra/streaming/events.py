"""Structured Streaming over an event log: windowed counts with a watermark, and the running effective state."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidra.sources.shared import new_folder


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """The event files at ``path`` as a stream, in the schema of the batch table."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    return spark.readStream.schema(schema).option("pathGlobFilter", "*.parquet").parquet(path) if not name.endswith(".parquet") else spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)


def window_counts(events: DataFrame, window: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """(window_start, event_type, n, total) of tumbling windows, in the session's time zone; once the newest event is ``late`` behind
    a window's end, the window is closed and later rows of it are left out."""
    grouped = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late).groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return grouped.select(F.col("w.start").alias("window_start"), "event_type", "n", "total")


def drained(stream: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Runs ``stream`` in update mode over all that its source has now and gives the last row of each of ``keys``: a batch writes only
    what it changed, under its number, and state behind the watermark is dropped. A batch that is repeated after a failure
    overwrites itself."""
    spark = stream.sparkSession
    out = new_folder(spark, name)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    query = stream.writeStream.outputMode("update").option("checkpointLocation", f"{out}-state").foreachBatch(write).trigger(availableNow=True).start()
    query.awaitTermination()
    found = spark.read.parquet(out)
    values = [c for c in stream.columns if c not in keys]
    last = found.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("v"))
    return last.select(*keys, "v.*").select(*stream.columns)
