"""The conversation log and the event log as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from lumbre.operators import memory
from lumbre.sources import formats


def turns(spark: SparkSession, folder: str, files: int = 100) -> DataFrame:
    """New turns as JSON lines arrive in a folder."""
    return spark.readStream.schema(formats.TURN).option("maxFilesPerTrigger", files).json(folder)


def registered(stream: DataFrame, delay: str = "1 day") -> DataFrame:
    """Turns scrubbed and dated, each key once while its copies arrive within ``delay`` of each other."""
    timed = stream.where("thread_id is not null and turn_id is not null").withColumn("momento", memory.moment(F.col("ts"))).withWatermark("momento", delay)
    return memory.register(timed.dropDuplicatesWithinWatermark(["thread_id", "turn_id"]))


def append(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Append to a table of files until the input there is now is used up; restarts go on from the checkpoint."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def upsert_feedback(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Feedback (thread_id, turn_id, pulgar, edicion) kept beside the log as one row per key, the latest batch's values winning.

    Every batch writes a new version (a folder by batch id), so a batch that is run again writes the same.
    """

    def merge(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        news = batch.groupBy("thread_id", "turn_id").agg(F.max("pulgar").alias("pulgar"), F.max("edicion").alias("edicion"))
        if number:
            old = spark.read.parquet(f"{table}/{number - 1}")
            both = old.withColumnsRenamed({"pulgar": "__p", "edicion": "__e"}).join(news, ["thread_id", "turn_id"], "full")
            news = both.select("thread_id", "turn_id", F.coalesce("pulgar", "__p").alias("pulgar"), F.coalesce("edicion", "__e").alias("edicion"))
        news.write.mode("overwrite").parquet(f"{table}/{number}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed(events: DataFrame, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and sums by window and type (ts, event_type, value), late events until ``delay`` counted."""
    return events.withWatermark("ts", delay).groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("inicio"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    return events.withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n")).select("user_id", F.col("session_window.start").alias("inicio"), "n")
