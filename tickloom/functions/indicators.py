"""Technical indicators: each adds columns to bars that carry ``bar_idx``.

Two families differ at the start of a series: seeded averages begin with a simple mean, unseeded ones with the first
value. Windows are strict: a short window, or a missing value within it, gives NULL.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import KEY, ColumnLike, Key, averages, col, lag, rolling, strict


def sma(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "sma", key: Key = KEY) -> DataFrame:
    return df.withColumn(out, strict(n, F.avg, c, key))


def ema(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "ema", seed: str = "sma", key: Key = KEY, min_periods: int = 0) -> DataFrame:
    """``min_periods`` masks the first bars of the unseeded form."""
    found = averages(df, {out: (c, 2.0 / (n + 1), n)}, seed, key)
    return found.withColumn(out, F.when(F.col("bar_idx") >= min_periods - 1, F.col(out))) if min_periods else found


def rma(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "rma", seed: str = "sma", key: Key = KEY) -> DataFrame:
    return averages(df, {out: (c, 1.0 / n, n)}, seed, key)


def true_range(df: DataFrame, out: str = "true_range", key: Key = KEY) -> DataFrame:
    before = lag("close", 1, key)
    range_ = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
    whole = F.col("high").isNotNull() & F.col("low").isNotNull() & ((F.col("bar_idx") == 0) | before.isNotNull())
    return df.withColumn(out, F.when(whole, range_))


def atr(df: DataFrame, n: int = 14, out: str = "atr", seed: str = "sma", key: Key = KEY) -> DataFrame:
    return rma(true_range(df, "_tr", key), "_tr", n, out, seed, key).drop("_tr")


def dmi(df: DataFrame, n: int = 14, key: Key = KEY) -> DataFrame:
    """``plus_di``, ``minus_di`` and ``adx``."""
    up, down = F.col("high") - lag("high", 1, key), lag("low", 1, key) - F.col("low")
    moves = true_range(df, "_tr", key).withColumns({"_up": up, "_down": down})
    known = F.col("_up").isNotNull() & F.col("_down").isNotNull()
    plus = F.when(known, F.when((F.col("_up") > F.col("_down")) & (F.col("_up") > 0), F.col("_up")).otherwise(0.0))
    minus = F.when(known, F.when((F.col("_down") > F.col("_up")) & (F.col("_down") > 0), F.col("_down")).otherwise(0.0))
    smooth = averages(moves, {"_str": ("_tr", 1.0 / n, n), "_plus": (plus, 1.0 / n, n), "_minus": (minus, 1.0 / n, n)}, "sma", key)
    share = {"plus_di": 100.0 * F.try_divide("_plus", F.nullif(F.col("_str"), F.lit(0.0))), "minus_di": 100.0 * F.try_divide("_minus", F.nullif(F.col("_str"), F.lit(0.0)))}
    both = F.col("plus_di") + F.col("minus_di")
    dx = F.when(both == 0, F.lit(0.0)).otherwise(100.0 * F.try_divide(F.abs(F.col("plus_di") - F.col("minus_di")), both))
    return averages(smooth.withColumns(share), {"adx": (dx, 1.0 / n, n)}, "sma", key).drop("_tr", "_up", "_down", "_str", "_plus", "_minus")


def adx(df: DataFrame, n: int = 14, key: Key = KEY) -> DataFrame:
    return dmi(df, n, key).drop("plus_di", "minus_di")


def _strength(gain: Column, loss: Column, flat: Column) -> Column:
    return F.when(loss == 0, F.when(gain > 0, F.lit(100.0)).otherwise(flat)).otherwise(100.0 - 100.0 / (1.0 + gain / F.nullif(loss, F.lit(0.0))))


def rsi(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "rsi", method: str = "seeded", key: Key = KEY) -> DataFrame:
    """``seeded``: averages start with a mean, flat series give 50. ``first``: they start with 0, flat gives NULL.
    ``rolling``: simple means of the last n changes, flat gives NULL."""
    change = col(c) - lag(c, 1, key)
    moved = df.withColumn("_d", change)
    gain, loss = F.greatest(F.col("_d"), F.lit(0.0)), F.greatest(-F.col("_d"), F.lit(0.0))
    gain, loss = F.when(F.col("_d").isNotNull(), gain), F.when(F.col("_d").isNotNull(), loss)
    none = F.lit(None).cast("double")
    if method == "rolling":
        found = moved.withColumns({"_g": F.coalesce(gain, F.lit(0.0)), "_l": F.coalesce(loss, F.lit(0.0))}).withColumns({"_g": strict(n, F.avg, "_g", key), "_l": strict(n, F.avg, "_l", key)})
    elif method == "first":
        found = averages(moved, {"_g": (F.coalesce(gain, F.lit(0.0)), 1.0 / n, n), "_l": (F.coalesce(loss, F.lit(0.0)), 1.0 / n, n)}, "first", key)
    elif method == "seeded":
        found = averages(moved, {"_g": (gain, 1.0 / n, n), "_l": (loss, 1.0 / n, n)}, "sma", key)
    else:
        raise ValueError("method is 'seeded', 'first' or 'rolling'")
    value = _strength(F.col("_g"), F.col("_l"), F.lit(50.0) if method == "seeded" else none)
    return found.withColumn(out, F.when(F.col("_g").isNotNull() & F.col("_l").isNotNull(), value)).drop("_d", "_g", "_l")


def macd(df: DataFrame, c: ColumnLike = "close", fast: int = 12, slow: int = 26, signal: int = 9, seed: str = "sma", key: Key = KEY) -> DataFrame:
    """``macd``, ``macd_signal`` and ``macd_hist``; the signal line has its own seed."""
    lines = averages(df, {"_fast": (c, 2.0 / (fast + 1), fast), "_slow": (c, 2.0 / (slow + 1), slow)}, seed, key)
    lines = averages(lines.withColumn("macd", F.col("_fast") - F.col("_slow")), {"macd_signal": ("macd", 2.0 / (signal + 1), signal)}, seed, key)
    return lines.withColumn("macd_hist", F.col("macd") - F.col("macd_signal")).drop("_fast", "_slow")


def bollinger(df: DataFrame, c: ColumnLike = "close", n: int = 20, mult: float = 2.0, key: Key = KEY) -> DataFrame:
    found = df.withColumns({"bb_mid": strict(n, F.avg, c, key), "_sd": strict(n, F.stddev_pop, c, key)})
    return found.withColumns({"bb_upper": F.col("bb_mid") + mult * F.col("_sd"), "bb_lower": F.col("bb_mid") - mult * F.col("_sd")}).drop("_sd")


def stochastic(df: DataFrame, n: int = 14, smooth_k: int = 1, smooth_d: int = 3, key: Key = KEY) -> DataFrame:
    """``stoch_k`` (50 in a flat window) and ``stoch_d``."""
    top, bottom = strict(n, F.max, "high", key), strict(n, F.min, "low", key)
    found = df.withColumns({"_hh": top, "_ll": bottom})
    raw = F.when(F.col("_hh") == F.col("_ll"), F.lit(50.0)).otherwise(100.0 * (F.col("close") - F.col("_ll")) / F.nullif(F.col("_hh") - F.col("_ll"), F.lit(0.0)))
    found = found.withColumn("_k", F.when(F.col("_hh").isNotNull() & F.col("_ll").isNotNull(), raw))
    found = found.withColumn("stoch_k", strict(smooth_k, F.avg, "_k", key) if smooth_k > 1 else F.col("_k"))
    return found.withColumn("stoch_d", strict(smooth_d, F.avg, "stoch_k", key)).drop("_hh", "_ll", "_k")


def highest(df: DataFrame, c: ColumnLike = "high", n: int = 14, out: str = "highest", key: Key = KEY) -> DataFrame:
    return df.withColumn(out, strict(n, F.max, c, key))


def lowest(df: DataFrame, c: ColumnLike = "low", n: int = 14, out: str = "lowest", key: Key = KEY) -> DataFrame:
    return df.withColumn(out, strict(n, F.min, c, key))


def _level(c: ColumnLike | float) -> Column:
    return F.lit(float(c)) if isinstance(c, (int, float)) else col(c)


def crossover(df: DataFrame, a: ColumnLike, b: ColumnLike | float, out: str = "cross_up", key: Key = KEY) -> DataFrame:
    """a stands above b now and did not on the bar before; missing values give false. b may be a number."""
    found = df.withColumns({"_a": col(a), "_b": _level(b)})
    return found.withColumn(out, F.coalesce((F.col("_a") > F.col("_b")) & (lag("_a", 1, key) <= lag("_b", 1, key)), F.lit(False))).drop("_a", "_b")


def crossunder(df: DataFrame, a: ColumnLike, b: ColumnLike | float, out: str = "cross_down", key: Key = KEY) -> DataFrame:
    found = df.withColumns({"_a": col(a), "_b": _level(b)})
    return found.withColumn(out, F.coalesce((F.col("_a") < F.col("_b")) & (lag("_a", 1, key) >= lag("_b", 1, key)), F.lit(False))).drop("_a", "_b")


def atr_oscillator(df: DataFrame, ema_n: int = 21, atr_n: int = 14, smooth: int = 3, mult: float = 3.0, scale: float = 100.0, out: str = "oscillator", key: Key = KEY) -> DataFrame:
    """Distance from an average in units of the range, smoothed; NULL where the range is 0."""
    found = ema(atr(df, atr_n, "_atr", "sma", key), "close", ema_n, "_ema", "sma", key)
    raw = F.when(F.col("_atr") != 0, (F.col("close") - F.col("_ema")) / F.nullif(mult * F.col("_atr"), F.lit(0.0)) * scale)
    return ema(found.withColumn("_raw", raw), "_raw", smooth, out, "sma", key).drop("_atr", "_ema", "_raw")


def ema_slope_pct(df: DataFrame, n: int = 21, k: int = 5, out: str = "ema_slope_pct", key: Key = KEY) -> DataFrame:
    found = ema(df, "close", n, "_ema", "sma", key).withColumn("_was", lag("_ema", k, key))
    return found.withColumn(out, 100.0 * F.try_divide(F.col("_ema") - F.col("_was"), F.nullif(F.col("_was"), F.lit(0.0)))).drop("_ema", "_was")


def range_compression_pct(df: DataFrame, k: int = 20, out: str = "range_pct", key: Key = KEY) -> DataFrame:
    top, bottom = F.max("high").over(rolling(k, key)), F.min("low").over(rolling(k, key))
    found = df.withColumns({"_hh": top, "_ll": bottom})
    return found.withColumn(out, F.when((F.col("bar_idx") >= k) & (F.col("_ll") > 0), 100.0 * (F.col("_hh") - F.col("_ll")) / F.nullif(F.col("_ll"), F.lit(0.0)))).drop("_hh", "_ll")


def consolidation_flag(df: DataFrame, slope_below: float | None = 0.5, range_below: float | None = 5.0, adx_below: float | None = 20.0, fast_slow: tuple[int, int] | None = (9, 21), n: int = 21, k: int = 20, adx_n: int = 14, out: str = "consolidating", key: Key = KEY) -> DataFrame:
    """All the tests that can be made on a bar hold; false if none can."""
    found, tests, scratch = df, [], []
    if slope_below is not None:
        found = ema_slope_pct(found, n, k, "_slope", key)
        tests.append(F.col("_slope") < slope_below)
        scratch.append("_slope")
    if range_below is not None:
        found = range_compression_pct(found, k, "_range", key)
        tests.append(F.col("_range") < range_below)
        scratch.append("_range")
    if fast_slow is not None:
        found = averages(found, {"_f": ("close", 2.0 / (fast_slow[0] + 1), fast_slow[0]), "_s": ("close", 2.0 / (fast_slow[1] + 1), fast_slow[1])}, "sma", key)
        tests.append(F.col("_f") < F.col("_s"))
        scratch += ["_f", "_s"]
    if adx_below is not None:
        found = adx(found, adx_n, key)
        tests.append(F.col("adx") < adx_below)
        scratch.append("adx")
    if not tests:
        return df.withColumn(out, F.lit(False))
    made = F.array_compact(F.array(*tests))
    return found.withColumn(out, (F.size(made) > 0) & F.forall(made, lambda t: t)).drop(*scratch)


def lag_value(df: DataFrame, c: ColumnLike, n: int, out: str = "lagged", key: Key = KEY) -> DataFrame:
    return df.withColumn(out, lag(c, n, key))


def math_max_min_na(df: DataFrame, a: ColumnLike, b: ColumnLike) -> DataFrame:
    """``larger`` and ``smaller`` of two columns (NULL if one is missing) and ``is_na`` of the first."""
    both = reduce(lambda x, y: x & y, [col(a).isNotNull(), col(b).isNotNull()])
    return df.withColumns({"larger": F.when(both, F.greatest(col(a), col(b))), "smaller": F.when(both, F.least(col(a), col(b))), "is_na": col(a).isNull()})
