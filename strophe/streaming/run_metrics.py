"""Windowed aggregates of a run log that is still written. An extension: batch and stream share the aggregation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def windowed(log: DataFrame, time: str, *by: str, value: str = "value", width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(window_start, by..., n, mean, std): per tumbling window of event time; rows later than ``late`` are dropped on streams."""
    rows = log.withWatermark(time, late) if log.isStreaming else log
    out = rows.groupBy(F.window(time, width), *by).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.stddev_pop(value).alias("std"))
    return out.select(F.col("window.start").alias("window_start"), *by, "n", "mean", "std")


def read_stream(spark: SparkSession, folder: str, schema: StructType | str, kind: str = "json") -> DataFrame:
    """New files of a folder as a stream."""
    return spark.readStream.schema(schema).format(kind).load(folder)


def write_stream(df: DataFrame, folder: str, checkpoint: str):
    """Append finished windows as Parquet, each once, resuming from ``checkpoint``; what is there now, then stop."""
    return df.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
