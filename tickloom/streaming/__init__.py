"""Bars from an unbounded stream of ticks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..core import KEY, OHLC, Key
from ..operators.prep import FREQUENCIES


def stream_bars(ticks: DataFrame, freq: str = "1min", delay: str = "10 minutes", key: Key = KEY, order: Key = ("ts",)) -> DataFrame:
    """``resample_ohlcv`` for a stream: a bar is emitted once the watermark, ``delay`` behind the latest tick, has passed
    it; later ticks of that bar are dropped. State holds the open bars only."""
    by = F.struct(*order)
    grouped = ticks.withWatermark("ts", delay).groupBy(*key, F.window("ts", FREQUENCIES.get(freq, freq)).alias("_w")).agg(
        F.min_by("open", by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", by).alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.select(*key, F.col("_w.start").alias("ts"), *OHLC, "volume")
