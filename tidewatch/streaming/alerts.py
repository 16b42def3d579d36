"""Streams: windows of a sender's activity with a watermark, and fitted tables joined to a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidewatch.operators import features
from tidewatch.sources.shared import new_path


def hourly_bursts(stream: DataFrame, late: str = "1 hour", least: int = 3) -> DataFrame:
    """Tumbling hours per sender with `least` transfers or more; stream has sender, ts (timestamp), amount."""
    w = F.window("ts", "1 hour")
    out = stream.withWatermark("ts", late).groupBy("sender", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("amount").alias("amount_sum"))
    return out.where(F.col("n") >= least).select("sender", F.col("w.start").alias("hour"), "n", "amount_sum")


def daily_counts(stream: DataFrame, late: str = "1 day") -> DataFrame:
    out = stream.withWatermark("ts", late).groupBy("sender", F.window("ts", "1 day").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return out.select("sender", F.col("w.start").alias("day"), "n")


def apply_rulers(stream: DataFrame, profiles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Features of fitted tables on a stream: stream-static left joins, no state."""
    return features.apply_pairs(features.apply_profiles(features.border_flags(features.amount_flags(stream)), profiles), pairs)


def drained(spark: SparkSession, rows: DataFrame, plan: Callable[[DataFrame], DataFrame], mode: str) -> DataFrame:
    """What a streaming plan has put out once it has read all of rows, written as files and streamed from there.

    mode "complete": the state of all windows at the end; "append": the rows as they come. Checkpoints lie in the shared folder.
    """
    at = new_path(spark, "stream")
    rows.write.parquet(f"{at}/in")
    stream = plan(spark.readStream.schema(rows.schema).parquet(f"{at}/in"))
    schema = stream.schema
    writer = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{at}/checkpoint").trigger(availableNow=True)
    if mode == "complete":
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{at}/out")).start()
    else:
        query = writer.format("parquet").option("path", f"{at}/out").start()
    query.awaitTermination()
    return spark.read.schema(schema).parquet(f"{at}/out")
