"""Writers: the bar cache, trades, equity, reports and JSON results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Columns of an exported trade (fixed values).
TRADE_COLUMNS = [
    "trade_id", "entry_time", "entry_price", "entry_bar", "direction", "qty", "entry_value", "exit_time", "exit_price", "exit_bar", "exit_signal", "pnl", "pnl_pct",
    "commission", "bars_in_trade", "max_favorable_excursion", "max_adverse_excursion",
]


def write_bar_cache(bars: DataFrame, path: str) -> None:
    """Replace the partitions ``(symbol, interval)`` that the bars hold; others stay."""
    bars.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("symbol", "interval").parquet(path)


def write_bucketed_bars(bars: DataFrame, table: str, path: str, buckets: int = 200, key: tuple[str, ...] = ("symbol",)) -> None:
    """Replace the table by these bars, hashed by series into ``buckets`` and sorted within: chains of windows over a series that
    read it with ``spark.table`` need no shuffle. A shuffle first makes one file a bucket. Give about 128 MB of bars a bucket;
    series longer than that are cut into blocks instead (``blocks``)."""
    placed = bars.repartition(buckets, *key)
    placed.write.mode("overwrite").format("parquet").bucketBy(buckets, *key).sortBy(*key, "bar_idx").option("path", path).saveAsTable(table)


def write_trades(trades: DataFrame, path: str, keep: tuple[str, ...] = ()) -> None:
    """Trades as CSV, 17 columns; those that the frame lacks are empty."""
    shown = [F.col(c) if c in trades.columns else F.lit(None).cast("string").alias(c) for c in TRADE_COLUMNS]
    trades.select(*keep, *shown).write.mode("overwrite").csv(path, header=True)


def write_equity(curve: DataFrame, path: str, time: str = "ts", equity: str = "equity", keep: tuple[str, ...] = ()) -> None:
    curve.select(*keep, F.col(time).alias("time"), F.col(equity).alias("equity")).write.mode("overwrite").csv(path, header=True)


#: Sections of a report: for each its heading and, by column, the figures and their forms.
REPORT = {
    "trades": {"total_trades": "%d trades", "winning_trades": "%d won", "losing_trades": "%d lost", "win_rate": "%.2f %% won"},
    "profit": {"total_pnl": "%,.2f in all", "avg_pnl": "%,.2f a trade", "avg_winner": "%,.2f a trade won", "avg_loser": "%,.2f a trade lost", "profit_factor": "%.2f gained for each unit lost"},
    "risk": {"max_drawdown": "%,.2f deepest fall", "max_drawdown_pct": "%.2f %% deepest fall", "sharpe_ratio": "%.2f Sharpe", "sortino_ratio": "%.2f Sortino", "calmar_ratio": "%.2f Calmar"},
}


def report_lines(stats: DataFrame, key: tuple[str, ...] = ("symbol",)) -> DataFrame:
    """The figures of each row as text, a line each below the heading of its section; what the frame lacks or is missing in
    a row is left out, and a section without figures too."""
    sections = []
    for heading, figures in REPORT.items():
        lines = [F.when(F.col(c).isNotNull(), F.format_string(f"  {form}", F.col(c))) for c, form in figures.items() if c in stats.columns]
        if lines:
            text = F.nullif(F.concat_ws("\n", *lines), F.lit(""))
            sections.append(F.concat(F.lit(f"{heading}\n"), text))
    return stats.select(*key, F.concat_ws("\n", *sections).alias("report"))


def write_report(reports: DataFrame, path: str) -> None:
    reports.select("report").write.mode("overwrite").text(path)


def write_results_json(results: DataFrame, path: str) -> None:
    results.write.mode("overwrite").json(path)
