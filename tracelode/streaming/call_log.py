"""An extension: model calls as a stream. The study's call log is a batch append; this gives the same figures by the hour as calls arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def read_calls(spark: SparkSession, path: str, schema: T.StructType, files_a_batch: int = 100, pattern: str = "*.parquet") -> DataFrame:
    """Arriving Parquet files; a time stamp without zone is taken as UTC by the session's zone, as a watermark needs."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).option("pathGlobFilter", pattern).parquet(path)
    return raw.withColumn("ts", F.col("ts").cast("timestamp"))


def hourly(calls: DataFrame, late: str = "2 hours", key: str = "event_type", value: str = "value") -> DataFrame:
    """Calls and mean latency an hour and kind; rows later than ``late`` are not waited for."""
    windowed = calls.withWatermark("ts", late).groupBy(F.window("ts", "1 hour").alias("w"), key)
    return windowed.agg(F.count("*").alias("n_calls"), F.avg(value).alias("mean_latency")).select(F.col("w.start").alias("hour"), key, "n_calls", "mean_latency")


def without_repeats(calls: DataFrame, key: str, late: str = "2 hours") -> DataFrame:
    """Each call once, however often it is delivered within the watermark."""
    return calls.withWatermark("ts", late).dropDuplicatesWithinWatermark([key])


def append(out: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Write closed windows once each, for what is there now."""
    return out.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
