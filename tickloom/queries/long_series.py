"""Queries of series cut into blocks: the same rows as the operators that keep a series together."""

from __future__ import annotations

from .. import blocks
from ..operators.prep import resample_ohlcv
from . import indicators, signals_returns
from .base import BARS, SQL, bars, query, r6, stamp, ticks, with_

ID = ("symbol", "bar_idx")

#: Series of the tables have some hundred bars.
SIZE = 128


@query(with_(BARS) + "SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, bar_idx FROM bars")
def number_bars(spark, sf):
    return blocks.number_bars(resample_ohlcv(ticks(spark, sf), "1h", order=("ts", "event_id"))).select("symbol", stamp(), "bar_idx")


@query(SQL["sma"])
def sma_blocks(spark, sf):
    return blocks.sma(bars(spark, sf), "close", indicators.N, size=SIZE).select(*ID, *r6("sma"))


@query(SQL["ema_seeded"])
def ema_seeded_blocks(spark, sf):
    return blocks.ema(bars(spark, sf), "close", indicators.N, "value", size=SIZE).select(*ID, *r6("value"))


@query(SQL["rma_first"])
def rma_first_blocks(spark, sf):
    return blocks.rma(bars(spark, sf), "close", indicators.N, "value", seed="first", size=SIZE).select(*ID, *r6("value"))


@query(SQL["atr_seeded"])
def atr_seeded_blocks(spark, sf):
    return blocks.atr(bars(spark, sf), indicators.N, size=SIZE).select(*ID, *r6("atr"))


@query(SQL["sig_donchian"])
def sig_donchian_blocks(spark, sf):
    return blocks.sig_donchian(bars(spark, sf), 20, size=SIZE).select(*ID, "signal")


@query(SQL["bar_returns"])
def bar_returns_blocks(spark, sf):
    found = blocks.bar_returns(blocks.sig_donchian(bars(spark, sf), 20, size=SIZE), commission=0.001, size=SIZE)
    return found.select(*ID, "active", *r6("bar_return", "strategy_return"))


@query(SQL["drawdown_pct"])
def drawdown_pct_blocks(spark, sf):
    curve = blocks.equity_curve(signals_returns.small(spark, sf), size=SIZE)
    return blocks.drawdown_pct(curve, size=SIZE).select(*ID, *r6("drawdown_pct"))


@query(SQL["metrics_bar"])
def metrics_bar_blocks(spark, sf):
    return signals_returns.shown_metrics(blocks.metrics_bar(signals_returns.small(spark, sf), size=SIZE), "symbol")
