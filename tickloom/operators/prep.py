"""Bar preparation: resampling, adjustment, session filters, quality checks and dataset profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEY, OHLC, Key, whole, with_bar_idx
from .asof import as_of

#: Bar sizes by name (fixed values).
FREQUENCIES = {"1min": "1 minute", "5min": "5 minutes", "15min": "15 minutes", "30min": "30 minutes", "1h": "1 hour", "4h": "4 hours", "1d": "1 day"}

#: Session bounds in minutes of the day, half open: UTC and local (fixed values).
RTH_UTC, RTH_LOCAL = (13 * 60 + 30, 21 * 60), (9 * 60 + 30, 16 * 60)

#: Labels of the usual gaps between bars, in seconds (fixed values).
GAPS = {60: "1m", 300: "5m", 900: "15m", 1800: "30m", 3600: "1H", 14400: "4H", 86400: "1D"}


def resample_ohlcv(df: DataFrame, freq: str = "1h", key: Key = KEY, order: Key = ("ts",), offset: str | None = None) -> DataFrame:
    """Bars of a coarser size: first open, highest, lowest, last close, summed volume; empty buckets give no bar.

    ``order`` decides first and last within a bucket. Partial aggregation runs before the one shuffle.
    """
    size = FREQUENCIES.get(freq, freq)
    bucket = F.window("ts", size, size, offset) if offset else F.window("ts", size)
    by = F.struct(*order)
    grouped = df.groupBy(*key, bucket.alias("_w")).agg(
        F.min_by("open", by).alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", by).alias("close"), F.sum("volume").alias("volume")
    )
    return grouped.select(*key, F.col("_w.start").alias("ts"), *OHLC, "volume")


def resample_offset(df: DataFrame, key: Key = KEY, order: Key = ("ts",)) -> DataFrame:
    """Hourly bars that begin at half past."""
    return resample_ohlcv(df, "1h", key, order, "30 minutes")


def split_adjust(df: DataFrame, splits: DataFrame, key: Key = KEY) -> DataFrame:
    """Divide the prices before each split by its ratio; later splits compound. ``splits``: key, ``split_ts``, ``ratio``.
    One pass over the bars of a series, whatever the number of its splits."""
    w = Window.partitionBy(*key).orderBy("split_ts")
    dated = splits.filter(F.col("split_ts").isNotNull()).groupBy(*key, "split_ts").agg(F.product("ratio").alias("ratio"))
    steps = dated.select(*key, F.col("split_ts").alias("ts"), F.product("ratio").over(w.rowsBetween(0, Window.unboundedFollowing)).alias("_factor"))
    factor = F.coalesce("_factor", F.lit(1.0))
    found = as_of(df, steps, ("_factor",), "ts", key, "forward", equal=False)
    return found.select(*[(F.col(c) / factor).alias(c) if c in OHLC else F.col(c) for c in df.columns])


def filter_session_hours(df: DataFrame, start: int = 12, end: int = 21) -> DataFrame:
    return df.filter(F.hour("ts").between(start, end))


def filter_rth(df: DataFrame, tz: str = "auto", key: Key = KEY) -> DataFrame:
    """Regular trading hours. ``auto`` takes the times of a series as UTC if their median hour is above 12."""
    minute = F.hour("ts") * 60 + F.minute("ts")
    inside = {"utc": (minute >= RTH_UTC[0]) & (minute < RTH_UTC[1]), "local": (minute >= RTH_LOCAL[0]) & (minute < RTH_LOCAL[1])}
    if tz in inside:
        return df.filter(inside[tz])
    middle = df.groupBy(*key).agg((F.median(F.hour("ts")) > 12).alias("_utc"))
    return df.join(middle, list(key)).filter(F.when(F.col("_utc"), inside["utc"]).otherwise(inside["local"])).drop("_utc")


def clamp_range(df: DataFrame, availability: DataFrame, start: str, end: str, today: str, dataset: str = "dataset") -> DataFrame:
    """Bars of [start, end), clamped to the dataset's first day and to the day before ``today``; where nothing is left,
    the 30 days after the clamped start. ``availability``: ``dataset``, ``available_from``."""
    low = F.greatest(F.to_timestamp(F.lit(start)), F.col("available_from"))
    high = F.least(F.to_timestamp(F.lit(end)), F.to_timestamp(F.lit(today)) - F.expr("INTERVAL 1 DAY"))
    bounds = availability.select(dataset, low.alias("_low"), high.alias("_high"))
    bounds = bounds.withColumn("_high", F.when(F.col("_high") <= F.col("_low"), F.col("_low") + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("_high")))
    return df.join(bounds, dataset).filter((F.col("ts") >= F.col("_low")) & (F.col("ts") < F.col("_high"))).drop("_low", "_high")


def normalize_vendor_bars(df: DataFrame, time: str = "ts_event", symbol: str = "symbol") -> DataFrame:
    """A vendor's frame (time in nanoseconds) as bars; missing columns are 0.0."""
    found = [F.col(c).cast("double").alias(c) if c in df.columns else F.lit(0.0).alias(c) for c in (*OHLC, "volume")]
    return df.select(F.col(symbol).alias("symbol"), F.timestamp_micros(F.expr(f"`{time}` div 1000")).alias("ts"), *found)


def classify_exchange(df: DataFrame, listings: DataFrame, default: str = "NASDAQ", symbol: str = "symbol") -> DataFrame:
    """``listings``: ``symbol``, ``exchange``; symbols not listed get the default."""
    listed = listings.select(F.upper(F.trim("symbol")).alias("_listed"), F.col("exchange").alias("_exchange")).dropDuplicates(["_listed"])
    joined = df.join(listed, F.upper(F.trim(F.col(symbol))) == F.col("_listed"), "left")
    return joined.withColumn("exchange", F.coalesce("_exchange", F.lit(default))).drop("_listed", "_exchange")


def union_chunks(*frames: DataFrame) -> DataFrame:
    """Append pulls of the same instrument and order them by time."""
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out.orderBy("ts")


def ohlc_quality(df: DataFrame, key: Key = KEY) -> DataFrame:
    """Bars, range, missing cells by column, and bars whose high or low isn't the extreme."""
    o, h, low, c = (F.col(x) for x in OHLC)
    return df.groupBy(*key).agg(
        F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"),
        *[F.count_if(F.col(x).isNull() | F.isnan(x)).alias(f"missing_{x}") for x in OHLC],
        F.count_if((h < low) | (h < o) | (h < c)).alias("bad_high"), F.count_if((low > h) | (low > o) | (low > c)).alias("bad_low"),
    )


def monotonic_check(df: DataFrame, ingest: str, key: Key = KEY) -> DataFrame:
    """How many rows, in order of ingestion, don't come after the row before."""
    before = F.lag("ts").over(Window.partitionBy(*key).orderBy(ingest))
    return df.withColumn("_before", before).groupBy(*key).agg(F.count_if(F.col("ts") <= F.col("_before")).alias("n_backward"))


def require_positive(df: DataFrame, columns: Key = OHLC, on_bad: str = "raise") -> DataFrame:
    """Fail on prices that aren't finite and positive, or with ``on_bad='drop'`` leave their bars out."""
    bad = F.lit(False)
    for c in columns:
        bad = bad | F.col(c).isNull() | F.isnan(c) | (F.col(c) <= 0) | (F.col(c) == float("inf"))
    if on_bad == "drop":
        return df.filter(~bad)
    first = columns[0]
    return df.withColumn(first, F.when(bad, F.raise_error(F.lit("prices must be finite and strictly positive"))).otherwise(F.col(first)))


def dataset_profile(df: DataFrame, source: str = "table", key: Key = KEY) -> DataFrame:
    found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_bars"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))
    return found.withColumns({"source": F.lit(source), "columns": F.lit(",".join(df.columns))})


def bars_per_day(df: DataFrame, key: Key = KEY) -> DataFrame:
    return df.groupBy(*key, F.to_date("ts").alias("_day")).agg(F.count(F.lit(1)).alias("_n")).groupBy(*key).agg(F.avg("_n").alias("bars_per_day"))


def infer_frequency(df: DataFrame, key: Key = KEY) -> DataFrame:
    """``frequency`` of each series from the median gap of its distinct times."""
    times = df.select(*key, "ts").filter("ts IS NOT NULL").dropDuplicates()
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = micros - F.lag(micros).over(Window.partitionBy(*key).orderBy("ts"))
    found = times.withColumn("_gap", gap / 1e6).groupBy(*key).agg(F.median("_gap").alias("_median"), F.count(F.lit(1)).alias("_n"))
    label: Column = F.concat(F.floor("_median").cast("string"), F.lit("s"))
    for seconds, name in reversed(GAPS.items()):
        label = F.when(F.abs(F.col("_median") - seconds) < 1, F.lit(name)).otherwise(label)
    return found.select(*key, F.when(F.col("_n") < 3, F.lit("unknown")).otherwise(label).alias("frequency"))


def dataset_inventory(df: DataFrame, fmt: str = "parquet", key: Key = ("file",)) -> DataFrame:
    """A row for each file of bars: size, OHLC columns, missing cells, range, frequency and whether it is usable."""
    has = all(c in df.columns for c in OHLC)
    missing = sum((F.count_if(F.col(c).isNull() | F.isnan(c)) for c in OHLC if c in df.columns), F.lit(0))
    found = df.groupBy(*key).agg(F.count(F.lit(1)).alias("rows"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), missing.cast("long").alias("missing_ohlc"))
    found = found.join(infer_frequency(df, key), list(key), "left")
    fine = F.lit(has) & (F.col("missing_ohlc") == 0)
    return found.withColumns({"format": F.lit(fmt), "has_ohlc": F.lit(has), "frequency": F.coalesce("frequency", F.lit("unknown")), "status": F.when(fine, "VALID").otherwise("ISSUES")})


def best_dataset(inventory: DataFrame, name: str = "file") -> DataFrame:
    """The largest usable dataset; the name breaks ties."""
    return inventory.filter("status = 'VALID'").orderBy(F.desc("rows"), name).limit(1)


def train_bars(n: int, years: float, per_day: float, days_per_year: int = 252) -> int:
    """Bars of a training span of ``years``; where that is all there is, 70 %, and 20 at least."""
    bars = int(years * days_per_year * per_day)
    return bars if bars < n else max(20, int(n * 0.7))


def train_split(df: DataFrame, years: float = 4, per_day: float = 1, days_per_year: int = 252, key: Key = KEY) -> DataFrame:
    n = F.count(F.lit(1)).over(whole(key))
    bars = int(years * days_per_year * per_day)
    most = F.when(F.lit(bars) < n, F.lit(bars)).otherwise(F.greatest(F.lit(20), F.floor(n * 0.7).cast("int")))
    return df.withColumn("_most", most).filter(F.col("bar_idx") < F.col("_most")).drop("_most")


def downsample(df: DataFrame, most: int = 5000, key: Key = KEY) -> DataFrame:
    """Every k-th bar of series longer than ``most``, k = n div most."""
    k = F.greatest(F.lit(1), F.floor(F.count(F.lit(1)).over(whole(key)) / most))
    return df.withColumn("_k", k).filter(F.col("bar_idx") % F.col("_k") == 0).drop("_k")


def ticks_to_bars(ticks: DataFrame, price: Column, freq: str, symbol: str, order: Key) -> DataFrame:
    """Single prices as bars, numbered; the volume is the number of prices."""
    ticks = ticks.withColumns({"symbol": F.col(symbol), **dict.fromkeys(OHLC, price), "volume": F.lit(1.0)})
    return with_bar_idx(resample_ohlcv(ticks, freq, KEY, order))
