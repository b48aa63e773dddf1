"""Hand values of the indicators."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import close_to, series, values
from tickloom.core import linear_recurrences
from tickloom.functions import indicators as ind


def test_sma(spark):
    close_to(values(ind.sma(series(spark, close=[1, 2, 3, 4, 5]), n=3), "sma"), [None, None, 2, 3, 4])
    close_to(values(ind.sma(series(spark, close=[1, None, 3, 4, 5]), n=3), "sma"), [None, None, None, None, 4])


def test_seeded_averages(spark):
    bars = series(spark, close=[1, 2, 3, 4, 5, 6, 7])
    close_to(values(ind.ema(bars, n=3), "ema")[2:4], [2.0, 3.0])
    close_to(values(ind.rma(bars, n=3), "rma")[2:4], [2.0, 2 + 2 / 3])


def test_a_gap_after_the_seed_breaks_a_seeded_average(spark):
    found = values(ind.ema(series(spark, close=[1, 2, 3, None, 5, 6]), n=3), "ema")
    close_to(found, [None, None, 2, None, None, None])


def test_length_one_is_the_input(spark):
    close_to(values(ind.ema(series(spark, close=[3, 1, 2]), n=1), "ema"), [3, 1, 2])


def test_lengths_must_be_positive(spark):
    with pytest.raises(ValueError):
        ind.ema(series(spark, close=[1.0]), n=0)


def test_true_range(spark):
    close_to(values(ind.true_range(series(spark, high=[10, 12, 11], low=[8, 9, 8], close=[9, 11, 9])), "true_range"), [2, 3, 3])
    close_to(values(ind.true_range(series(spark, high=[10, 15], low=[8, 13], close=[9, 14])), "true_range"), [2, 6])


def test_atr_is_the_average_of_the_true_range(spark):
    bars = series(spark, high=[10, 12, 11, 14, 13], low=[8, 9, 8, 10, 11], close=[9, 11, 9, 13, 12])
    tr = ind.true_range(bars, "tr")
    close_to(values(ind.atr(bars, 3), "atr"), values(ind.rma(tr, "tr", 3, "r"), "r"))


def test_adx_of_a_steady_rise(spark):
    up = list(range(100, 150))
    found = values(ind.adx(series(spark, high=[x + 1 for x in up], low=[x - 1 for x in up], close=up), 14), "adx")
    assert all(0 <= x <= 100 + 1e-9 for x in found if x is not None) and found[-1] > 20


@pytest.mark.parametrize("step,above", [(1, True), (-1, False)])
def test_rsi(spark, step, above):
    found = values(ind.rsi(series(spark, close=[100 + step * i for i in range(40)]), n=14), "rsi")
    assert all(0 <= x <= 100 + 1e-9 for x in found if x is not None)
    assert found[-1] > 70 if above else found[-1] < 30


def test_flat_rsi(spark):
    flat = series(spark, close=[5.0] * 20)
    assert values(ind.rsi(flat, n=5), "rsi")[-1] == 50
    assert values(ind.rsi(flat, n=5, method="first"), "rsi")[-1] is None


def test_crosses(spark):
    assert values(ind.crossover(series(spark, close=[1, 2, 3, 4, 3, 2]), "close", 2.5), "cross_up") == [False, False, True, False, False, False]
    assert values(ind.crossunder(series(spark, close=[4, 3, 2, 1, 2, 3]), "close", 2.5), "cross_down") == [False, False, True, False, False, False]


def test_extremes(spark):
    close_to(values(ind.highest(series(spark, close=[1, 3, 2, 5, 4]), "close", 3), "highest"), [None, None, 3, 5, 5])
    close_to(values(ind.lowest(series(spark, close=[3, 1, 4, 2, 5]), "close", 3), "lowest"), [None, None, 1, 1, 2])


def test_consolidation_without_tests_is_false(spark):
    found = ind.consolidation_flag(series(spark, close=[1, 2, 3]), None, None, None, None)
    assert values(found, "consolidating") == [False] * 3


@settings(max_examples=5, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.floats(0.5, 500), min_size=3, max_size=300), st.integers(2, 60))
def test_unseeded_average_is_that_of_pandas(spark, closes, span):
    found = values(ind.ema(series(spark, close=closes), n=span, seed="first"), "ema")
    assert np.allclose(found, pd.Series(closes).ewm(span=span, adjust=False).mean())


def test_recurrence_over_a_long_series(spark):
    n, a = 3000, 0.97
    df = spark.range(n).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_idx"), (F.col("id") % 17).cast("double").alias("b"))
    found = values(linear_recurrences(df, {"y": (F.col("b"), a)}), "y")
    y, wanted = 0.0, []
    for i in range(n):
        y = a * y + i % 17
        wanted.append(y)
    assert np.allclose(found, wanted, rtol=1e-12)
