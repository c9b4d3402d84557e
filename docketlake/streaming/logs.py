"""Checkpoint logs as streams: new records arrive as files, the latest per key is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def read_log(spark: SparkSession, folder: str, schema: str, max_files: int = 1000) -> DataFrame:
    return spark.readStream.schema(schema).option("mode", "DROPMALFORMED").option("maxFilesPerTrigger", max_files).json(folder)


def first_records(stream: DataFrame, keys: list[str], time: str, delay: str = "1 day") -> DataFrame:
    """The first record of each key; state older than the watermark is dropped."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark(keys)


def windowed_totals(stream: DataFrame, time: str, window: str, by: list[str], delay: str = "1 hour") -> DataFrame:
    """Records and cost per window and group; late records count until the watermark passes."""
    return stream.withWatermark(time, delay).groupBy(F.window(time, window).alias("window"), *by).agg(F.count("*").alias("records"), F.round(F.sum("cost_usd"), 6).alias("cost_usd")).select("window.start", "window.end", *by, "records", "cost_usd")


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Appends what is there to a Parquet table and stops; the next call goes on from it."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
