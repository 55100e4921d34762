"""Submissions as a stream: windowed counts with a watermark, and trajectories kept up to date.

An extension of the batch operators for logs that arrive continuously.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def read_log(spark: SparkSession, path: str, schema: StructType, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def activity(stream: DataFrame, ts: str, keys: Sequence[str], late: str = "1 hour", width: str = "1 day") -> DataFrame:
    """Submissions and mean value by key and window; rows later than the watermark are dropped.

    Event times without a zone are taken in the session's.
    """
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).groupBy(F.window(ts, width), *keys).agg(F.count("*").alias("n"), F.avg("value").alias("avg_value"))


def distinct_submissions(stream: DataFrame, ts: str, keys: Sequence[str], late: str = "1 hour") -> DataFrame:
    """The first arrival of each key; state is bounded by the watermark."""
    return stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late).dropDuplicatesWithinWatermark(list(keys))


def start(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, **trigger):
    """Run a batch plan on each micro-batch; a repeated batch id must have the same effect."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
