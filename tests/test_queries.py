"""A spread of the queries against their SQL; the driver runs them all."""

from __future__ import annotations

import pytest

from tests.helpers import by_sql, rows_of
from tickloom.queries import QUERIES, SQL

SPREAD = [
    "resample_ohlcv", "split_adjust", "filter_rth", "infer_frequency", "ema_seeded", "dmi", "rsi_first", "macd_seeded", "stochastic", "consolidation_flag", "sig_donchian", "sig_trend_rsi",
    "combine_hold", "entry_filters", "bar_returns", "metrics_bar", "trades_from_signals", "risk_ratios", "grid_search", "permute_bars", "fold_scores", "walk_forward", "first_touch_exit", "trailing_exit",
    "number_bars", "atr_seeded_blocks", "sig_donchian_blocks", "metrics_bar_blocks", "grid_signals", "reconcile_lines", "p_value", "resolve_overlaps", "size_and_pnl", "time_exit", "mark_to_market", "parse_trade_datetime", "detect_epoch_unit", "write_report", "compare_trades", "reconcile_summary", "script_inventory", "read_bars_csv", "write_bar_cache", "parse_mixed_timestamps", "custom_entry_exit",
]


@pytest.mark.parametrize("name", SPREAD)
def test_query_gives_the_rows_of_its_sql(spark, tables, name):
    found, wanted = QUERIES[name](spark, tables).toPandas(), by_sql(SQL[name], tables)
    assert sorted(found.columns) == sorted(wanted.columns)
    assert rows_of(found) == rows_of(wanted)


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0


def test_full_validation_gives_the_rows_of_its_sql(spark, tables):
    found, wanted = QUERIES["full_validation"](spark, tables).toPandas(), by_sql(SQL["full_validation"], tables)
    assert sorted(found.columns) == sorted(wanted.columns) and rows_of(found) == rows_of(wanted)
