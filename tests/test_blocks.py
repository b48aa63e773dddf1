"""Blocks of one long series against the same operators in one partition."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tests.helpers import close_to, series, values
from tickloom import blocks
from tickloom.core import averages, with_bar_idx
from tickloom.functions import indicators as ind
from tickloom.operators import returns as ret
from tickloom.operators import signals as sig

SIZES = (7, 64)


def same(found, wanted, *columns):
    assert found.columns == wanted.columns
    rows = [df.orderBy("bar_idx").select(*columns).collect() for df in (found, wanted)]
    for c in columns:
        close_to([r[c] for r in rows[0]], [r[c] for r in rows[1]])


def bars(spark, n=300, gaps=()):
    rng, price, close = random.Random(3), 100.0, []
    for i in range(n):
        price = max(1.0, price + rng.gauss(0.02, 0.8))
        close.append(None if i in gaps else price)
    top = [None if c is None else c + 0.4 for c in close]
    low = [None if c is None else c - 0.3 for c in close]
    return series(spark, open=[c and c - 0.1 for c in close], high=top, low=low, close=close).cache()


@pytest.mark.parametrize("size", SIZES)
def test_rolling(spark, size):
    own = bars(spark, 120, gaps=(40,))
    same(blocks.sma(own, n=14, size=size), ind.sma(own, n=14), "sma")
    same(blocks.in_blocks(own, lambda x, key: ind.stochastic(x, 14, 3, 3, key), 17, size), ind.stochastic(own, 14, 3, 3), "stoch_k", "stoch_d")


@pytest.mark.parametrize("seed", ["sma", "first"])
@pytest.mark.parametrize(("size", "gaps"), [(1, ()), (7, ()), (7, (0, 1, 2, 9)), (64, (150,)), (1000, (0,))])
def test_averages(spark, seed, size, gaps):
    own, inputs = bars(spark, 200, gaps), {"fast": ("close", 2.0 / 11, 10), "slow": ("close", 1.0 / 30, 30)}
    same(blocks.averages(own, inputs, seed, size), averages(own, inputs, seed), *inputs)


def test_range(spark):
    own = bars(spark)
    same(blocks.atr(own, size=7), ind.atr(own), "atr")


@pytest.mark.parametrize("size", SIZES)
def test_returns_and_metrics(spark, size):
    own = sig.sig_donchian(bars(spark), 10).cache()
    same(blocks.sig_donchian(bars(spark), 10, size=size), own, "signal")
    wanted = ret.bar_returns(own, commission=0.001).cache()
    same(blocks.bar_returns(own, commission=0.001, size=size), wanted, "active", "bar_return", "strategy_return", "equity_curve")
    same(blocks.drawdown_pct(wanted, size=size), ret.drawdown_pct(wanted), "drawdown_pct")
    close_to(list(blocks.metrics_bar(wanted, size=size).first())[1:], list(ret.metrics_bar(wanted).first())[1:])


def test_running_passes_over_missing_values(spark):
    own = series(spark, close=[None, 2, None, 5, 1, None])
    found = blocks.running(own, {k: (k, "close") for k in blocks.RUNNING}, 2).cache()
    close_to(values(found, "sum"), [None, 2, 2, 7, 8, 8])
    close_to(values(found, "product"), [None, 2, 2, 10, 10, 10])
    close_to(values(found, "max"), [None, 2, 2, 5, 5, 5])
    close_to(values(found, "min"), [None, 2, 2, 2, 1, 1])
    close_to(values(found, "last"), [None, 2, 2, 5, 1, 1])


def test_numbers(spark):
    own = bars(spark, 100).drop("bar_idx")
    own = own.unionByName(own.limit(1).withColumn("ts", F.lit(None).cast("timestamp"))).unionByName(own.withColumn("symbol", F.lit("b")))
    for hours in (24, 24 * 9):
        found = blocks.number_bars(own, hours)
        assert sorted(found.collect(), key=str) == sorted(with_bar_idx(own).select(found.columns).collect(), key=str)


def test_odd_tables(spark):
    own = bars(spark, 20)
    assert blocks.metrics_bar(own.limit(0).withColumn("strategy_return", F.lit(0.1))).count() == 0
    assert blocks.ema(own.withColumn("symbol", F.lit(None).cast("string"))).count() == 0
    with pytest.raises(ValueError, match="reserved"):
        blocks.sma(own.withColumn("_own", F.lit(1)))
    with pytest.raises(ValueError, match="size"):
        blocks.sma(own, size=0)


def test_one_series_uses_all_partitions(spark):
    start = F.lit("2020-01-01").cast("timestamp")
    long = spark.range(200_000).select(
        F.lit("a").alias("symbol"), F.col("id").alias("bar_idx"), (start + F.make_interval(mins=F.col("id").cast("int"))).alias("ts"),
        *[(100 + F.sin(F.col("id") / 50)).alias(c) for c in ("open", "high", "low", "close")],
    )
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # small partitions would be joined
    try:
        found = blocks.ema(long, n=20, size=4096)
        plan = found._jdf.queryExecution().executedPlan().toString()
        used = found.groupBy(F.spark_partition_id().alias("p")).agg(F.count("ema").alias("n")).collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
    assert len(used) == 4 and max(r["n"] for r in used) < 100_000
    assert sum(r["n"] for r in used) == 200_000 - 19
    assert plan.count("ReusedExchange") >= 1  # the bars are shuffled once
