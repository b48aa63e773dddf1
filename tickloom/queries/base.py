"""Shared inputs of the queries: bars out of ``events`` and ``lineitem``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..core import OHLC, with_bar_idx
from ..operators.prep import resample_ohlcv, ticks_to_bars

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a query under its own name, with its SQL."""

    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            SQL[name or f.__name__] = sql.strip()
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ticks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as ticks: symbol is the event type, the price its value plus one."""
    price = F.col("value") + 1.0
    return table(spark, sf_dir, "events").select(F.col("event_type").alias("symbol"), "ts", "event_id", *[price.alias(c) for c in OHLC], F.lit(1.0).alias("volume"))


def bars(spark: SparkSession, sf_dir: str, freq: str = "1h") -> DataFrame:
    return with_bar_idx(resample_ohlcv(ticks(spark, sf_dir), freq, order=("ts", "event_id")))


def brand_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each part brand out of lineitem; the whole row orders the prices of a day."""
    items = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey"))
    rows = items.select("p_brand", F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    order = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    return ticks_to_bars(rows, F.col("l_extendedprice") / F.col("l_quantity"), "1d", "p_brand", order)


def supplier_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of each supplier out of lineitem."""
    order = ("ts", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax")
    rows = table(spark, sf_dir, "lineitem").withColumnRenamed("l_shipdate", "ts")
    return ticks_to_bars(rows, F.col("l_extendedprice") / F.col("l_quantity"), "1d", "l_suppkey", order)


def r6(*columns: str) -> list[Column]:
    return [F.round(c, 6).alias(c) for c in columns]


def stamp(c: str = "ts", out: str | None = None) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss").alias(out or c)


TICKS = "ticks AS (SELECT event_type AS symbol, ts, event_id, value + 1.0 AS price FROM events)"


def bars_cte(bucket: str = "date_trunc('hour', ts)", name: str = "bars", source: str = "ticks") -> str:
    return f"""{name}_raw AS (
  SELECT symbol, {bucket} AS ts, first(price ORDER BY ts, event_id) AS open, max(price) AS high, min(price) AS low,
    last(price ORDER BY ts, event_id) AS close, count(*)::DOUBLE AS volume
  FROM {source} GROUP BY ALL
), {name} AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM {name}_raw)"""


BARS = f"{TICKS}, {bars_cte()}"

#: Frames of the last n rows of a series.
def over(n: int | None = None, shift: int = 0) -> str:
    if n is None:
        return "OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)"
    return f"OVER (PARTITION BY symbol ORDER BY bar_idx ROWS BETWEEN {n - 1 + shift} PRECEDING AND {f'{shift} PRECEDING' if shift else 'CURRENT ROW'})"


def strict(agg: str, x: str, n: int) -> str:
    return f"CASE WHEN count({x}) {over(n)} = {n} THEN {agg}({x}) {over(n)} END"


LAG = "OVER (PARTITION BY symbol ORDER BY bar_idx)"


def ewm(name: str, source: str, x: str, alpha: str, n: int, seed: str = "sma") -> str:
    """CTEs that end in ``name (symbol, bar_idx, y)``: the closed form of an exponential average."""
    start = strict("avg", "x", n) if seed == "sma" else "x"
    return f"""{name}_s AS (SELECT symbol, bar_idx, x, {start} AS sd FROM (SELECT symbol, bar_idx, {x} AS x FROM {source})),
{name}_f AS (SELECT symbol, min(bar_idx) AS i0 FROM {name}_s WHERE sd IS NOT NULL GROUP BY symbol),
{name}_b AS (SELECT s.symbol, s.bar_idx, CASE WHEN s.bar_idx = i0 THEN sd ELSE {alpha} * x END AS b FROM {name}_s s JOIN {name}_f f ON f.symbol = s.symbol WHERE s.bar_idx >= i0),
{name} AS (SELECT t.symbol, t.bar_idx, sum(power(1.0 - {alpha}, t.bar_idx - u.bar_idx) * u.b) AS y FROM {name}_b t JOIN {name}_b u ON u.symbol = t.symbol AND u.bar_idx <= t.bar_idx GROUP BY t.symbol, t.bar_idx)"""


def with_(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"
