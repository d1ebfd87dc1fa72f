"""Streaming queries, run to the end of what is there, and checked against their batch form."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from averis.plans.delivery import _METHOD, _SPLIT, sql_pair
from averis.session import shared_dir, table
from averis.streaming import deliveries as D


def st1_stream_deduplicated(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identifiers of predictions after streaming deduplication over the whole delivery time."""
    t = table(spark, sf_dir, "predictions")
    base = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    src = spark.readStream.schema(t.schema).parquet(f"{sf_dir}/predictions.parquet*")
    s = src.select("topic", "masking", D.method_key("model").alias("method"), "run", D.split_key("split").alias("split"), D.pair_key("pair").alias("pair"), F.coalesce("received_at", F.to_timestamp(F.lit("2025-01-01"))).alias("received_at"))
    q = D.to_table(D.first_deliveries(s, "3650 days").drop("received_at"), base + "/out", base + "/checkpoint")
    q.awaitTermination()
    return spark.read.parquet(base + "/out").groupBy("topic", "masking", "method", "run", "split").agg(F.count(F.lit(1)).alias("n"))


QUERIES = {"st1_stream_deduplicated": st1_stream_deduplicated}
SQL = {"st1_stream_deduplicated": f"SELECT topic, masking, {_METHOD} AS method, run, {_SPLIT} AS split, count(DISTINCT {sql_pair('pair')}) AS n FROM predictions GROUP BY ALL"}
