"""From signals to returns, equity, metrics and trades."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEY, Key, lag, ordered, so_far

PERIODS_PER_YEAR = 252


def bar_returns(df: DataFrame, signal: str = "signal", commission: float = 0.0, check: bool = True, key: Key = KEY) -> DataFrame:
    """Add ``active``, ``bar_return``, ``strategy_return`` and ``equity_curve``.

    A signal acts from the next bar. Where the acting position changes, the bar's return runs from its open, else from
    the last close. With a commission, the first bar has no return, as its change of position is unknown.
    """
    close = F.col("close")
    if check:
        close = F.when(close <= 0, F.raise_error(F.lit("close prices must be strictly positive"))).otherwise(close)
    found = df.withColumn("_close", close).withColumn("active", F.coalesce(lag(F.coalesce(F.col(signal), F.lit(0)), 1, key), F.lit(0)).cast("double"))
    found = found.withColumns({"_was": lag("active", 1, key), "_prev": lag("_close", 1, key)})
    held = F.try_divide(F.col("_close"), F.col("_prev")) - 1
    if "open" in df.columns:
        changed = F.col("_was").isNull() | (F.col("_was") != F.col("active"))
        held = F.when(changed, F.try_divide(F.col("_close") - F.col("open"), F.col("open"))).otherwise(held)
    found = found.withColumn("bar_return", held)
    gained = F.col("active") * F.col("bar_return")
    if commission > 0:
        gained = gained - F.abs(F.col("active") - F.col("_was")) * commission
    found = found.withColumn("strategy_return", gained).drop("_close", "_was", "_prev")
    return equity_curve(found, key=key)


def equity_curve(df: DataFrame, ret: str = "strategy_return", out: str = "equity_curve", key: Key = KEY) -> DataFrame:
    """Running product of 1 + return; a missing return counts as 0."""
    return df.withColumn(out, F.product(1 + F.coalesce(F.col(ret), F.lit(0.0))).over(so_far(key)))


def equity_log(df: DataFrame, ret: str = "strategy_return", out: str = "equity_log", key: Key = KEY) -> DataFrame:
    return df.withColumn(out, F.exp(F.sum(F.coalesce(F.col(ret), F.lit(0.0))).over(so_far(key))))


def drawdown_pct(df: DataFrame, equity: str = "equity_curve", out: str = "drawdown_pct", key: Key = KEY) -> DataFrame:
    peak = F.max(equity).over(so_far(key))
    return df.withColumn("_peak", peak).withColumn(out, 100.0 * F.try_divide(F.col(equity) - F.col("_peak"), F.col("_peak"))).drop("_peak")


def metrics_bar(df: DataFrame, ret: str = "strategy_return", key: Key = KEY) -> DataFrame:
    """Ten metrics for each series, over its bars that have a return. ``profit_factor`` is infinite without a loss."""
    r = F.col(ret)
    found = df.withColumn("_eq", F.when(r.isNotNull(), F.product(1 + F.coalesce(r, F.lit(0.0))).over(so_far(key))))
    return metrics_of(found.withColumn("_dd", F.try_divide(F.col("_eq"), F.max("_eq").over(so_far(key))) - 1), ret, key)


def metrics_of(found: DataFrame, ret: str, key: Key) -> DataFrame:
    """The metrics from returns whose drawdowns ``_dd`` are known."""
    r = F.col(ret)
    n = F.count(r)
    sums = found.groupBy(*key).agg(
        n.alias("_n"), F.coalesce(F.sum(F.when(r > 0, r)), F.lit(0.0)).alias("_gain"), F.abs(F.coalesce(F.sum(F.when(r < 0, r)), F.lit(0.0))).alias("_loss"),
        F.avg(r).alias("_mean"), F.stddev_samp(r).alias("_sd"), F.abs(F.coalesce(F.min("_dd"), F.lit(0.0))).alias("max_drawdown"),
        F.coalesce(F.product(1 + r), F.lit(1.0)).alias("_final"), F.count_if(r > 0).alias("_wins"), F.count_if(r < 0).alias("_losses"),
        F.count_if(r != 0).alias("num_trades"),
    )
    some = F.col("_n") > 0
    per_year = F.when(some & (F.col("_final") > 0), F.pow(F.col("_final"), F.lit(float(PERIODS_PER_YEAR)) / F.nullif(F.col("_n"), F.lit(0))) - 1).otherwise(0.0)
    return sums.select(
        *key,
        F.when(F.col("_loss") > 0, F.try_divide("_gain", "_loss")).when(F.col("_gain") > 0, F.lit(math.inf)).otherwise(0.0).alias("profit_factor"),
        F.when(F.col("_sd") > 0, F.try_divide("_mean", "_sd") * math.sqrt(PERIODS_PER_YEAR)).otherwise(0.0).alias("sharpe_ratio"),
        "max_drawdown", (F.col("_final") - 1).alias("total_return"),
        F.coalesce(F.try_divide("_wins", "_n"), F.lit(0.0)).alias("win_rate"),
        F.coalesce(F.try_divide("_gain", "_wins"), F.lit(0.0)).alias("avg_win"), F.coalesce(-F.try_divide("_loss", "_losses"), F.lit(0.0)).alias("avg_loss"),
        "num_trades", F.coalesce(F.col("_mean"), F.lit(0.0)).alias("expectancy"),
        F.when(F.col("max_drawdown") > 0, F.try_divide(per_year, "max_drawdown")).otherwise(0.0).alias("calmar_ratio"),
    )


def trades_from_signals(df: DataFrame, signal: str = "signal", fill: str = "next", key: Key = KEY) -> DataFrame:
    """One row for each closed run of an unchanged position: entry and exit at the opens of the bars where it changes.

    ``fill='next'``: the position that acts on a bar is the last bar's signal. ``fill='legacy'``: it is the bar's own.
    A position that stands on the first bar, and one still open at the end, give no trade.
    """
    own = F.coalesce(F.col(signal), F.lit(0))
    if fill == "next":
        acting = F.coalesce(lag(own, 1, key), F.lit(0))
    elif fill == "legacy":
        acting = own
    else:
        raise ValueError("fill is 'next' or 'legacy'")
    runs = df.withColumn("_pos", acting).withColumn("_before", lag("_pos", 1, key)).filter(F.col("_before").isNotNull() & (F.col("_before") != F.col("_pos")))
    w = ordered(key)
    runs = runs.withColumns({"exit_time": F.lead("ts").over(w), "exit_bar": F.lead("bar_idx").over(w), "exit_price": F.lead("open").over(w)})
    side = F.when(F.col("_pos") > 0, 1).otherwise(-1)
    trades = runs.filter((F.col("_pos") != 0) & F.col("exit_bar").isNotNull()).select(
        *key, F.when(F.col("_pos") > 0, "LONG").otherwise("SHORT").alias("direction"), F.col("ts").alias("entry_time"), F.col("bar_idx").alias("entry_bar"),
        F.col("open").alias("entry_price"), "exit_time", "exit_bar", "exit_price",
        ((F.try_divide(F.col("exit_price"), F.col("open")) - 1) * side * 100).alias("pnl_pct"), (F.col("exit_bar") - F.col("bar_idx")).alias("bars_held"),
    )
    number = F.row_number().over(_by_entry(key))
    return trades.withColumn("trade_id", number.cast("long"))


def _by_entry(key: Key):
    return Window.partitionBy(*key).orderBy("entry_bar")


def trade_stats(trades: DataFrame, pnl: str = "pnl", key: Key = KEY) -> DataFrame:
    """Counts and sums of closed trades; a loser is one without profit. ``profit_factor`` is infinite without a loss."""
    p = F.col(pnl)
    sums = trades.filter(p.isNotNull()).groupBy(*key).agg(
        F.count(p).alias("total_trades"), F.count_if(p > 0).alias("winning_trades"), F.count_if(p <= 0).alias("losing_trades"), F.sum(p).alias("total_pnl"), F.avg(p).alias("avg_pnl"),
        F.coalesce(F.avg(F.when(p > 0, p)), F.lit(0.0)).alias("avg_winner"), F.coalesce(F.avg(F.when(p <= 0, p)), F.lit(0.0)).alias("avg_loser"),
        F.coalesce(F.sum(F.when(p > 0, p)), F.lit(0.0)).alias("_gain"), F.abs(F.coalesce(F.sum(F.when(p <= 0, p)), F.lit(0.0))).alias("_loss"),
    )
    return sums.withColumns({
        "win_rate": 100.0 * F.col("winning_trades") / F.col("total_trades"),
        "profit_factor": F.when(F.col("_loss") > 0, F.try_divide("_gain", "_loss")).otherwise(F.lit(math.inf)),
    }).drop("_gain", "_loss")


def risk_ratios(curve: DataFrame, equity: str = "equity", initial_capital: float = 10_000.0, key: Key = KEY) -> DataFrame:
    """From an equity curve: drawdown in money and as a share of the initial capital, Sharpe, Sortino (population
    deviations) and Calmar on the linear annual return."""
    e, year = F.col(equity), float(PERIODS_PER_YEAR)
    peak = F.greatest(F.max(e).over(so_far(key)), F.lit(initial_capital))
    steps = curve.withColumns({"_dd": peak - e, "_before": lag(equity, 1, key)}).withColumn("_r", F.try_divide(e - F.col("_before"), F.col("_before")))
    r = F.col("_r")
    sums = steps.groupBy(*key).agg(
        F.max("_dd").alias("max_drawdown"), F.avg(r).alias("_mean"), F.stddev_pop(r).alias("_sd"), F.stddev_pop(F.when(r < 0, r)).alias("_down"),
        F.count(F.lit(1)).alias("_n"), F.min_by(e, "bar_idx").alias("_first"), F.max_by(e, "bar_idx").alias("_last"),
    ).withColumn("max_drawdown_pct", F.col("max_drawdown") / initial_capital * 100)
    ratio = lambda sd: F.when(F.col(sd) > 0, F.try_divide("_mean", sd) * math.sqrt(year)).otherwise(0.0)
    annual = (F.try_divide("_last", "_first") - 1) * (F.lit(year) / F.col("_n"))
    return sums.select(*key, "max_drawdown", "max_drawdown_pct", ratio("_sd").alias("sharpe_ratio"), ratio("_down").alias("sortino_ratio"), F.when(F.col("max_drawdown_pct") > 0, F.try_divide(annual * 100, "max_drawdown_pct")).otherwise(0.0).alias("calmar_ratio"))


def _stamp(c: str) -> Column:
    midnight = (F.hour(c) == 0) & (F.minute(c) == 0)
    return F.when(midnight, F.date_format(c, "yyyy-MM-dd")).otherwise(F.date_format(c, "yyyy-MM-dd HH:mm"))


def display_trades(trades: DataFrame) -> DataFrame:
    """Trades for reading: dates without a midnight time, prices and percentages to two places."""
    return trades.withColumns({**{c: _stamp(c) for c in ("entry_time", "exit_time")}, **{c: F.round(c, 2) for c in ("entry_price", "exit_price", "pnl_pct")}})


def perm_histogram(scores: DataFrame, score: str = "score", bins: int = 35, key: Key = ()) -> DataFrame:
    """Counts of the finite scores in equal bins from their minimum to their maximum (which is in the last bin)."""
    finite = scores.filter(F.col(score).isNotNull() & ~F.isnan(score) & (F.abs(score) < math.inf))
    bounds = finite.groupBy(*key).agg(F.min(score).alias("_low"), F.max(score).alias("_high"))
    placed = finite.join(bounds, list(key)) if key else finite.crossJoin(bounds)  # one row without a key
    wide = F.col("_high") > F.col("_low")
    number = F.when(wide, F.least(F.floor((F.col(score) - F.col("_low")) / F.nullif((F.col("_high") - F.col("_low")) / bins, F.lit(0.0))) + 1, F.lit(bins))).otherwise(1)
    return placed.withColumn("bin", number.cast("int")).groupBy(*key, "bin").agg(F.count(F.lit(1)).alias("n"), F.min(score).alias("least"), F.max(score).alias("most"))
