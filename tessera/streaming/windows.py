"""Windowed aggregation of event streams, and its batch equivalent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _marked(events: DataFrame, late: str) -> DataFrame:
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)


def tumbling(events: DataFrame, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Per window and event type the number of events and the sum of values; streams drop state behind the watermark."""
    # A watermark needs a timestamp with a zone; the window's start goes back to the table's type.
    kind = dict(events.dtypes)["ts"]
    source = _marked(events, late) if events.isStreaming else events
    per = source.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return per.select(F.col("w.start").cast(kind).alias("window_start"), "event_type", "n", "total")


def stream_once(events: DataFrame, name: str, checkpoint: str, width: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Run a stream over all that is there now and return the table of its windows."""
    q = tumbling(events, width, late).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return events.sparkSession.table(name)


def follow(events: DataFrame, path: str, checkpoint: str, width: str = "1 day", late: str = "2 hours") -> None:
    """Run a stream over what is there now and put the windows that it changed under path, a folder a micro-batch.

    A repeated batch overwrites its folder, so restarts from the checkpoint count nothing twice; nothing comes to the driver.
    """

    def put(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    query = tumbling(events, width, late).writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def followed(spark: SparkSession, path: str) -> DataFrame:
    """The windows as the last batch that changed each left them."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("window_start", "event_type").agg(F.max_by(F.struct("n", "total"), "batch").alias("x"))
    return last.select("window_start", "event_type", "x.n", "x.total")


def distinct_events(events: DataFrame, key: str = "event_id", late: str = "2 hours") -> DataFrame:
    """Each event once; a stream forgets ids behind the watermark."""
    return _marked(events, late).dropDuplicatesWithinWatermark([key]) if events.isStreaming else events.dropDuplicates([key])
