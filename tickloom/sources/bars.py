"""Readers: delimited and Parquet bars under many headings, timestamps in many forms, lists of trades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..core import OHLC
from ..operators.prep import filter_rth
from .layouts import read_layouts

#: Headings by canonical name, the first found wins; compared without case and outer spaces (fixed values).
ALIASES = {
    "open": ["open", "o", "open_price"],
    "high": ["high", "h", "high_price"],
    "low": ["low", "l", "low_price"],
    "close": ["close", "c", "close_price", "adj close", "adj_close"],
    "volume": ["volume", "v", "vol"],
    "ts": ["timestamp", "date", "datetime", "time"],
}

#: Headings of external trade lists (fixed values).
TRADE_ALIASES = {
    "entry_time": ["entry time", "entry_time", "entrytime", "entry date", "entry_date"],
    "exit_time": ["exit time", "exit_time", "exittime", "exit date", "exit_date"],
    "entry_price": ["entry price", "entry_price", "entryprice", "entry"],
    "exit_price": ["exit price", "exit_price", "exitprice", "exit"],
    "exit_signal": ["exit signal", "exit_signal", "exitsignal", "signal", "type"],
    "pnl": ["profit", "pnl", "p&l", "profit/loss", "net profit"],
    "pnl_pct": ["profit %", "pnl %", "profit_pct", "return", "return %"],
}

#: Forms of trade times in order, each with the pattern that it must match (fixed values).
TRADE_TIMES = [
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}:\d{1,2}$", "y-M-d H:m:s"),
    (r"^\d{4}-\d{1,2}-\d{1,2} \d{1,2}:\d{1,2}$", "y-M-d H:m"),
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "y-M-d"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "M/d/y H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "M/d/y H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/y"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}:\d{1,2}$", "d/M/y H:m:s"),
    (r"^\d{1,2}/\d{1,2}/\d{4} \d{1,2}:\d{1,2}$", "d/M/y H:m"),
    (r"^\d{1,2}/\d{1,2}/\d{4}$", "d/M/y"),
]

#: Other names of symbols (fixed values).
SYMBOLS = {"NDX": "QQQ", "NASDAQ:NDX": "QQQ", "SPX": "SPY", "SP500": "SPY", "BTC": "BTC-USD", "BTCUSD": "BTC-USD"}

#: Microseconds in a unit of epoch time, in the order of preference.
UNITS = {"s": 1_000_000.0, "ms": 1_000.0, "us": 1.0, "ns": 0.001}


def _found(columns: list[str], aliases: dict[str, list[str]]) -> dict[str, str]:
    by_name = {c.lower().strip(): c for c in columns}
    return {std: by_name[first] for std, names in aliases.items() if (first := next((n for n in names if n in by_name), None))}


def _numbered(df: DataFrame) -> DataFrame:
    """Rows with ``_row``: 0, 1, 2 and so on by partition and place in it. The sizes of the partitions, a row each, are added
    up and joined; nothing else is gathered."""
    placed = df.withColumn("_row", F.monotonically_increasing_id())
    part = F.shiftright("_row", 33)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))
    joined = placed.withColumn("_part", part).join(before, "_part")
    return joined.withColumn("_row", F.col("_before") + F.col("_row").bitwiseAND((1 << 33) - 1)).drop("_part", "_before")


def resolve_columns(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Columns under their canonical names and types; bad cells become NULL, a missing volume 0. Without a time column the
    rows are numbered from 0 in the order in which they are read: partitions are counted first, so nothing is gathered."""
    found = _found(df.columns, ALIASES)
    missing = [c for c in OHLC if c not in found]
    if missing:
        raise ValueError(f"Missing prices: no heading stands for {missing} among {df.columns}")
    number = lambda c: F.expr(f"try_cast(`{c}` AS double)")
    kinds = dict(df.dtypes)
    if "ts" in found:
        ts = F.col(f"`{found['ts']}`") if kinds[found["ts"]].startswith("timestamp") else F.expr(f"try_cast(`{found['ts']}` AS timestamp)")
    else:
        df = _numbered(df)
        ts = F.col("_row")
    volume = number(found["volume"]) if "volume" in found else F.lit(0.0)
    return df.select(*keep, ts.alias("ts"), *[number(found[c]).alias(c) for c in OHLC], volume.alias("volume"))


def _together(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)


def read_bars_csv(spark: SparkSession, path: str | list[str], sep: str | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """Delimited bars, each file by its own heading and, unless ``sep`` is given, its own delimiter; rows without all four
    prices are left out. A sort is left to what needs it. Of files without a time column, each layout is numbered by itself."""
    return _together([resolve_columns(raw, keep) for raw in read_layouts(spark, path, sep)]).dropna(subset=list(OHLC))


def read_bars_strict(spark: SparkSession, path: str | list[str], time_column: str | None = None, unlabelled: bool = False, rth_only: bool = False, keep: tuple[str, ...] = (), sep: str | None = None) -> DataFrame:
    """As above, but each file must have a time column: ``time_column``, one of the usual headings, or with ``unlabelled``
    its first column. ``rth_only`` keeps regular (local) hours."""
    bars = _together([_timed(raw, time_column, unlabelled, keep) for raw in read_layouts(spark, path, sep)]).dropna(subset=list(OHLC))
    return filter_rth(bars, "local") if rth_only else bars


def _timed(raw: DataFrame, time_column: str | None, unlabelled: bool, keep: tuple[str, ...]) -> DataFrame:
    name = time_column or _found(raw.columns, {"ts": ["time", "date", "datetime", "timestamp"]}).get("ts") or (raw.columns[0] if unlabelled else None)
    if name is None or name not in raw.columns:
        raise ValueError(f"No time column found in {raw.columns}")
    others = [c for c in raw.columns if c != name and c.lower().strip() not in ALIASES["ts"]]
    return resolve_columns(raw.select(F.col(f"`{name}`").alias("timestamp"), *[f"`{c}`" for c in others]), keep)


def read_bars_parquet(spark: SparkSession, path: str, keep: tuple[str, ...] = ()) -> DataFrame:
    return resolve_columns(spark.read.parquet(path), keep)


def _instant(c: Column, unit: str) -> Column:
    micros = c * UNITS[unit]
    return F.when(F.abs(micros) < 9.2e18, F.timestamp_micros(micros.cast("long")))


def detect_epoch_unit(df: DataFrame, column: str, key: tuple[str, ...] = ()) -> DataFrame:
    """``unit`` (s, ms, us or ns) and ``score`` of a column of epoch numbers: 100 times the share of years from 1980 to 2100,
    10 times the share of valid values, 1 for a span; the first of equals wins, -1 if nothing is valid."""
    x = F.expr(f"try_cast(`{column}` AS double)")
    sums = []
    for u in UNITS:
        # Years that calendars of 64-bit nanoseconds can hold; others aren't valid.
        micros = x * UNITS[u]
        valid = F.when((micros > -9.2233e15) & (micros < 9.2233e15), _instant(x, u))
        inside = F.avg(F.when(valid.isNotNull(), F.year(valid).between(1980, 2100).cast("double")))
        share = F.count(valid) / F.count(F.lit(1))
        span = F.when(F.max(valid) > F.min(valid), 1.0).otherwise(0.0)
        sums.append(F.when(F.count(valid) > 0, inside * 100.0 + share * 10.0 + span).otherwise(-1.0).alias(f"_{u}"))
    scored = df.groupBy(*key).agg(*sums)
    top = F.greatest(*[F.col(f"_{u}") for u in UNITS])
    unit = F.coalesce(*[F.when(F.col(f"_{u}") == top, F.lit(u)) for u in UNITS])
    return scored.select(*key, unit.alias("unit"), top.alias("score"))


def parse_mixed_timestamps(df: DataFrame, column: str, key: tuple[str, ...] = (), out: str = "ts") -> DataFrame:
    """Epoch numbers and texts in one column as times. If 80 % or more of a series are numbers, those come first and texts
    fill the gaps, else the other way round."""
    unit = detect_epoch_unit(df, column, key).drop("score")
    x = F.expr(f"try_cast(`{column}` AS double)")
    share = df.groupBy(*key).agg(F.avg(x.isNotNull().cast("double")).alias("_share"))
    known = unit.join(share, list(key)) if key else unit.crossJoin(share)  # one row each without a key
    joined = df.join(known, list(key)) if key else df.crossJoin(known)
    numeric = F.coalesce(*[F.when(F.col("unit") == u, _instant(x, u)) for u in UNITS])
    text = F.when(x.isNull(), F.expr(f"try_cast(`{column}` AS timestamp)"))
    return joined.withColumn(out, F.when(F.col("_share") >= 0.8, F.coalesce(numeric, text)).otherwise(F.coalesce(text, numeric))).drop("unit", "_share")


def parse_trade_datetime(c: Column) -> Column:
    """Nine forms in order; where both could be meant, the month comes first. No match gives NULL."""
    text = c.cast("string")
    return F.coalesce(*[F.when(text.rlike(pattern), F.try_to_timestamp(text, F.lit(form))) for pattern, form in TRADE_TIMES])


def external_trades(raw: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """A trade list under its canonical names; absent columns are NULL, a missing P&L 0."""
    found = _found(raw.columns, TRADE_ALIASES)
    number = lambda c: F.expr(f"try_cast(`{found[c]}` AS double)") if c in found else F.lit(None).cast("double")
    time = lambda c: parse_trade_datetime(F.col(f"`{found[c]}`")) if c in found else F.lit(None).cast("timestamp")
    signal = F.col(f"`{found['exit_signal']}`").cast("string") if "exit_signal" in found else F.lit(None).cast("string")
    return raw.select(
        *keep, time("entry_time").alias("entry_time"), time("exit_time").alias("exit_time"), number("entry_price").alias("entry_price"), number("exit_price").alias("exit_price"),
        signal.alias("exit_signal"), F.coalesce(number("pnl"), F.lit(0.0)).alias("pnl"), F.coalesce(number("pnl_pct"), F.lit(0.0)).alias("pnl_pct"),
    )


def read_external_trades(spark: SparkSession, path: str | list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """Trade lists, each file by its own heading."""
    return _together([external_trades(raw, keep) for raw in read_layouts(spark, path, ",")])


def canonical_symbol(c: Column) -> Column:
    """Symbols under other names by the fixed map."""
    out = F.upper(F.trim(c))
    known = F.create_map(*[F.lit(x) for pair in SYMBOLS.items() for x in pair])
    return F.coalesce(F.try_element_at(known, out), out)


def load_bars_by_symbol(spark: SparkSession, path: str, symbol: str, interval: str) -> DataFrame:
    """Bars of one symbol and interval from the cache that ``write_bar_cache`` keeps; only their partition is read."""
    name = SYMBOLS.get(symbol.upper().strip(), symbol.upper().strip())
    return spark.read.parquet(path).filter((F.col("symbol") == name) & (F.col("interval") == interval))
