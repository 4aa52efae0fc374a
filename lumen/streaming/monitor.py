"""Serving statistics over a stream of prediction records.

An extension of the batch summary: tumbling windows with a watermark.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def windows(events: DataFrame, at: str, group: str, value: str, error: Column, length: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """start, group, n, errors, mean, max of each window; works on a stream and on a table alike. Records later than `late` are dropped by a stream."""
    rows = events.withWatermark(at, late) if events.isStreaming else events
    return rows.groupBy(F.window(at, length).alias("w"), F.col(group).alias("group")).agg(F.count("*").alias("n"), F.count_if(error).alias("errors"), F.avg(value).alias("mean"), F.max(value).alias("max")).select(F.col("w.start").alias("start"), "group", "n", "errors", "mean", "max")


def run_to_end(spark: SparkSession, out: DataFrame, sink: str, checkpoint: str) -> DataFrame:
    """Process all that a stream's source holds now, append it as Parquet, and read it."""
    q = out.writeStream.format("parquet").outputMode("append").option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(out.schema).parquet(sink)
