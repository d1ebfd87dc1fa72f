"""Result rows as a stream: redeliveries dropped within a watermark, running metrics per event-time window."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from averis.functions.names import method_key, pair_key, split_key


def prediction_stream(spark: SparkSession, folder: str, schema, files_per_trigger: int = 16) -> DataFrame:
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)
    return s.select("row_id", "topic", "masking", method_key("model").alias("method"), "run", split_key("split").alias("split"), pair_key("pair").alias("pair"), "y_true", "y_pred", "score", "received_at")


def first_deliveries(stream: DataFrame, delay: str = "7 days") -> DataFrame:
    """Exactly one copy of each identifier among those received within ``delay`` of each other; state is bounded by it."""
    return stream.withWatermark("received_at", delay).dropDuplicatesWithinWatermark(["topic", "masking", "method", "run", "split", "pair"])


def windowed_confusion(stream: DataFrame, window: str = "1 day") -> DataFrame:
    n = lambda t, p: F.count_if((F.col("y_true") == t) & (F.col("y_pred") == p))
    return stream.groupBy(F.window("received_at", window), "masking", "method").agg(n(1, 1).alias("tp"), n(1, 0).alias("fn"), n(0, 1).alias("fp"), n(0, 0).alias("tn"))


def to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> StreamingQuery:
    return stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
