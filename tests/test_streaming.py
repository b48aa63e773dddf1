"""Streamed bars are those of the batch operator, once the watermark has passed them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tickloom.operators.prep import resample_ohlcv
from tickloom.queries.base import ticks
from tickloom.streaming import stream_bars


def test_stream_agrees_with_batch(spark, tables, tmp_path):
    own = ticks(spark, tables).withColumn("ts", F.col("ts").cast("timestamp"))
    own.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(own.schema).parquet(str(tmp_path / "in"))
    query = stream_bars(stream, "1h", "2 hours", order=("ts", "event_id")).writeStream.format("memory").queryName("bars_out").outputMode("append").option("checkpointLocation", str(tmp_path / "state")).start()
    query.processAllAvailable()
    query.stop()
    found = {tuple(r) for r in spark.table("bars_out").collect()}
    batch = {tuple(r) for r in resample_ohlcv(own, "1h", order=("ts", "event_id")).collect()}
    assert found and found <= batch and len(batch) - len(found) < 20
