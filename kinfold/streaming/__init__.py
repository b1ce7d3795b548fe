"""Embeddings as a stream: each batch appends to the cache what is newer than what it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from kinfold.operators import cache


def append_embeddings(stream: DataFrame, path: str, checkpoint: str, delay: str = "1 day") -> StreamingQuery:
    """``stream`` has model, paper_id, embedding, embedding_date. Repeats within ``delay`` are dropped by state, older ones by the cache itself; a batch that is run again appends nothing."""
    once = stream.withWatermark("embedding_date", delay).dropDuplicatesWithinWatermark(["model", "paper_id", "embedding_date"])

    def write(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        new = cache.latest(batch)
        try:
            held = spark.read.parquet(path).select("model", "paper_id", "embedding_date")
        except Exception as e:  # the first batch finds no cache
            if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
                raise
            held = None
        cache.append(new if held is None else cache.delta(held, new).select(*new.columns), path, f"stream-{number}")

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def rating_windows(events: DataFrame, window: str = "1 hour", delay: str = "2 hours") -> DataFrame:
    """Counts by event type in tumbling windows of event time; late events beyond ``delay`` are dropped. The same plan serves tables and streams."""
    e = events.withWatermark("ts", delay) if events.isStreaming else events
    return e.groupBy(F.window("ts", window).alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", "total")
