"""Streaming forms of the windowed operators, for an unbounded table of events (event_id, ts, user_id, event_type, value).

Late rows are taken up to the watermark; state older than it is dropped, so it does not grow with the stream.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, folder: str, file_glob: str, per_trigger: int | None = None) -> DataFrame:
    """A stream of the Parquet files of a folder; ts as a timestamp (event time)."""
    schema = spark.read.option("pathGlobFilter", file_glob).parquet(folder).schema
    r = spark.readStream.schema(schema).option("pathGlobFilter", file_glob)
    if per_trigger:
        r = r.option("maxFilesPerTrigger", per_trigger)
    return r.parquet(folder).withColumn("ts", F.col("ts").cast("timestamp"))


def window_counts(events: DataFrame, length: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """(start, event_type, n, total): tumbling windows, or sliding ones with ``slide``."""
    w = F.window("ts", length, slide) if slide else F.window("ts", length)
    out = events.withWatermark("ts", late).groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str, late: str = "1 hour") -> DataFrame:
    """(user_id, start, n): sessions that end after a gap without events."""
    out = events.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.col("w.start").alias("start"), "n")


def run_available(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Runs a streaming plan over all that is there, into a Parquet table, and returns the table."""
    q = df.writeStream.format("parquet").outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(out)


def run_complete(df: DataFrame, collected: str, checkpoint: str) -> DataFrame:
    """Runs an aggregation to the end of what is there, every batch replacing the result at ``collected``."""
    def keep(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(collected)

    q = df.writeStream.foreachBatch(keep).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).parquet(collected)
