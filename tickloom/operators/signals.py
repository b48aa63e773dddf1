"""Signals: each strategy adds an integer column of -1, 0 and 1 to bars that carry ``bar_idx``.

A strategy is a function ``f(df, key=..., out=..., **params) -> df``; other columns stay as they are.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import KEY, ColumnLike, Key, averages, hold, lag, ordered, prior, so_far, strict
from ..functions import indicators as ind


def _held(df: DataFrame, raw: Column, out: str, key: Key, *scratch: str) -> DataFrame:
    """Carry the last decision (NULL: none) forward."""
    return df.withColumn("_raw", raw).withColumn(out, hold("_raw", key).cast("int")).drop("_raw", *scratch)


def _averages(df: DataFrame, fast: int, slow: int, key: Key, c: ColumnLike = "close") -> DataFrame:
    return averages(df, {"_fast": (c, 2.0 / (fast + 1), fast), "_slow": (c, 2.0 / (slow + 1), slow)}, "first", key)


def sig_donchian(df: DataFrame, lookback: int = 20, source: str = "close", out: str = "signal", key: Key = KEY) -> DataFrame:
    """1 at or above the highest of the prior bars, -1 at or below the lowest, held; 0 while there are too few."""
    found = donchian_levels(df, lookback, source, key)
    return donchian_signal(found.withColumn("_held", hold("_raw", key)), out)


def donchian_levels(df: DataFrame, lookback: int, source: str, key: Key) -> DataFrame:
    """The levels ``_hi`` and ``_lo`` of the prior bars and the decision ``_raw`` of each bar."""
    if lookback < 2:
        raise ValueError("lookback must be >= 2")
    w, full = prior(lookback, key), F.count(source).over(prior(lookback, key)) == lookback
    found = df.withColumns({"_hi": F.when(full, F.max(source).over(w)), "_lo": F.when(full, F.min(source).over(w))})
    return found.withColumn("_raw", F.when(F.col(source) >= F.col("_hi"), 1).when(F.col(source) <= F.col("_lo"), -1))


def donchian_signal(found: DataFrame, out: str) -> DataFrame:
    held = F.when(F.col("_hi").isNotNull(), F.coalesce("_held", F.lit(0))).otherwise(0).cast("int")
    return found.withColumn(out, held).drop("_hi", "_lo", "_raw", "_held")


def _donchian_decided(df: DataFrame, lookback: int = 20, source: str = "close", out: str = "decided", key: Key = KEY) -> DataFrame:
    """Whether the breakout decides on a bar, whatever came before its look-back."""
    return donchian_levels(df, lookback, source, key).withColumn(out, F.col("_raw").isNotNull()).drop("_hi", "_lo", "_raw")


def _donchian_memory(lookback: int = 20, source: str = "close") -> int:
    return lookback


def _donchian_grid(bars: DataFrame, params: Sequence[Mapping], key: Key) -> DataFrame | None:
    """The breakout for many lookbacks at once, as rows ``param_id`` and ``signal``.

    Extremes of the last 2 ** j bars come from those of half as many; any lookback is covered by two such runs. So a window for
    each power of two serves all sets, and the number of windows grows with the logarithm of the longest.
    """
    sources = {p.get("source", "close") for p in params}
    if len(sources) > 1 or any(set(p) - {"lookback", "source"} for p in params):
        return None
    source, lookbacks = sources.pop(), [p.get("lookback", 20) for p in params]
    if min(lookbacks) < 2:
        raise ValueError("lookback must be >= 2")
    w, x = ordered(key), F.col(source)

    def both(a: Column, b: Column, *names: str) -> Column:
        """Extremes of two runs; a missing value in one makes the whole missing."""
        known = a["hi"].isNotNull() & b["hi"].isNotNull()
        return F.struct(F.when(known, F.greatest(a["hi"], b["hi"])).alias(names[0]), F.when(known, F.least(a["lo"], b["lo"])).alias(names[1]))

    levels = range(max(lookbacks).bit_length())
    longest = {j: max([n for n in lookbacks if n.bit_length() - 1 == j], default=0) - (1 << j) for j in levels}
    out = bars.withColumn("_m0", F.lag(F.struct(x.alias("hi"), x.alias("lo")), 1).over(w))
    for j in levels:
        if j:
            before = F.lag(f"_m{j - 1}", 1 << (j - 1)).over(w)
            out = out.withColumn("_b", before).withColumn(f"_m{j}", both(F.col(f"_m{j - 1}"), F.col("_b"), "hi", "lo")).drop("_b")
        if longest[j] > 0:  # the runs that end up to so many bars earlier
            out = out.withColumn(f"_l{j}", F.collect_list(f"_m{j}").over(w.rowsBetween(-longest[j], 0)))
    runs = F.array(*[F.col(f"_l{j}") if longest[j] > 0 else F.array(f"_m{j}") for j in levels])
    sets = F.array(*[F.struct(F.lit(n.bit_length() - 1).alias("level"), F.lit(n - (1 << (n.bit_length() - 1))).alias("far")) for n in lookbacks])
    out = out.withColumn("_runs", runs)

    def channel(t: Column) -> Column:
        own = F.get("_runs", t["level"])
        return both(F.get(own, F.size(own) - 1), F.get(own, F.size(own) - 1 - t["far"]), "_hi", "_lo")

    rows = out.select(*bars.columns, F.posexplode(F.transform(sets, channel)).alias("param_id", "_set")).select(*bars.columns, "param_id", "_set.*")
    rows = rows.withColumn("_raw", F.when(x >= F.col("_hi"), 1).when(x <= F.col("_lo"), -1))
    return donchian_signal(rows.withColumn("_held", hold("_raw", [*key, "param_id"])), "signal").select(*bars.columns, "param_id", "signal")


sig_donchian.grid = _donchian_grid
sig_donchian.decided, sig_donchian.memory = _donchian_decided, _donchian_memory


def sig_ema_long_flat(df: DataFrame, fast_period: int = 12, slow_period: int = 26, source: str = "close", out: str = "signal", key: Key = KEY) -> DataFrame:
    """1 after a cross up, 0 after a cross down; 0 until both averages have their full number of bars."""
    if fast_period >= slow_period:
        raise ValueError("fast_period must be < slow_period")
    found = _averages(df, fast_period, slow_period, key, source)
    bars = F.count(source).over(so_far(key))
    found = found.withColumns({"_fast": F.when(bars >= fast_period, F.col("_fast")), "_slow": F.when(bars >= slow_period, F.col("_slow"))})
    f, s, f1, s1 = F.col("_fast"), F.col("_slow"), lag("_fast", 1, key), lag("_slow", 1, key)
    raw = F.when((f > s) & (f1 <= s1), 1).when((f < s) & (f1 >= s1), 0)
    held = found.withColumn("_raw", raw).withColumn("_held", hold("_raw", key))
    return held.withColumn(out, F.when(f.isNotNull() & s.isNotNull(), F.col("_held")).otherwise(0).cast("int")).drop("_fast", "_slow", "_raw", "_held")


def _trend_rsi(df: DataFrame, fast: int, slow: int, rsi_n: int, long_level: float, short_level: float, method: str, out: str, key: Key) -> DataFrame:
    found = ind.rsi(_averages(df, fast, slow, key), "close", rsi_n, "_rsi", method, key).withColumn("_was", lag("_rsi", 1, key))
    up = (F.col("_fast") > F.col("_slow")) & (F.col("_rsi") > long_level) & (F.col("_was") <= long_level)
    down = (F.col("_fast") < F.col("_slow")) & (F.col("_rsi") < short_level) & (F.col("_was") >= short_level)
    # Both can't hold on one bar: the trend has one direction.
    return _held(found, F.when(up, 1).when(down, -1), out, key, "_fast", "_slow", "_rsi", "_was")


def sig_trend_rsi(df: DataFrame, fast_len: int = 20, slow_len: int = 50, rsi_len: int = 14, rsi_pull_long: float = 45.0, rsi_pull_short: float = 55.0, out: str = "signal", key: Key = KEY) -> DataFrame:
    found = _trend_rsi(df, fast_len, slow_len, rsi_len, rsi_pull_long, rsi_pull_short, "first", out, key)
    return found.withColumn(out, F.when(F.col("bar_idx") < slow_len, 0).otherwise(F.col(out)))


def sig_hl_breakout(df: DataFrame, lookback: int = 20, out: str = "signal", key: Key = KEY) -> DataFrame:
    """Breakout beyond a range that holds the current bar itself, so it never fires; kept for completeness."""
    found = df.withColumns({"_hi": strict(lookback, F.max, "high", key), "_lo": strict(lookback, F.min, "low", key)})
    return _held(found, F.when(F.col("close") < F.col("_lo"), -1).when(F.col("close") > F.col("_hi"), 1), out, key, "_hi", "_lo")


def sig_ema_reverse(df: DataFrame, fast_length: int = 10, slow_length: int = 30, out: str = "signal", key: Key = KEY) -> DataFrame:
    found = _averages(df, fast_length, slow_length, key)
    f, s, f1, s1 = F.col("_fast"), F.col("_slow"), lag("_fast", 1, key), lag("_slow", 1, key)
    return _held(found, F.when((f < s) & (f1 >= s1), -1).when((f > s) & (f1 <= s1), 1), out, key, "_fast", "_slow")


def sig_macd_zero(df: DataFrame, out: str = "signal", key: Key = KEY) -> DataFrame:
    """The MACD line (always 12/26/9) crosses zero."""
    found = ind.macd(df, "close", 12, 26, 9, "first", key).withColumn("_was", lag("macd", 1, key))
    raw = F.when((F.col("macd") < 0) & (F.col("_was") >= 0), -1).when((F.col("macd") > 0) & (F.col("_was") <= 0), 1)
    return _held(found, raw, out, key, "macd", "macd_signal", "macd_hist", "_was")


def sig_rsi_levels(df: DataFrame, rsi_len: int = 14, os_level: float = 30.0, ob_level: float = 70.0, out: str = "signal", key: Key = KEY) -> DataFrame:
    found = ind.rsi(df, "close", rsi_len, "_rsi", "rolling", key).withColumn("_was", lag("_rsi", 1, key))
    raw = F.when((F.col("_rsi") < ob_level) & (F.col("_was") >= ob_level), -1).when((F.col("_rsi") > os_level) & (F.col("_was") <= os_level), 1)
    return _held(found, raw, out, key, "_rsi", "_was")


def sig_trend_rsi_rolling(df: DataFrame, fast_len: int = 20, slow_len: int = 50, rsi_len: int = 14, rsi_pull: float = 45.0, rsi_pull_short: float = 55.0, out: str = "signal", key: Key = KEY) -> DataFrame:
    return _trend_rsi(df, fast_len, slow_len, rsi_len, rsi_pull, rsi_pull_short, "rolling", out, key)


def sig_trend_rsi_band(df: DataFrame, fast_len: int = 20, slow_len: int = 50, rsi_len: int = 14, rsi_min: float = 45.0, rsi_max: float = 70.0, use_shorts: bool = False, out: str = "signal", key: Key = KEY) -> DataFrame:
    found = ind.rsi(_averages(df, fast_len, slow_len, key), "close", rsi_len, "_rsi", "rolling", key)
    up = (F.col("_fast") > F.col("_slow")) & (F.col("_rsi") > rsi_min) & (F.col("_rsi") < rsi_max)
    down = F.lit(use_shorts) & (F.col("_fast") < F.col("_slow")) & (F.col("_rsi") < 100 - rsi_min)
    return _held(found, F.when(down, -1).when(up, 1), out, key, "_fast", "_slow", "_rsi")


def sig_oscillator(df: DataFrame, entry_threshold: float = -50.0, extreme: float = -100.0, out: str = "signal", key: Key = KEY) -> DataFrame:
    """1 once the (unseeded) oscillator leaves a low level upwards, for ever."""
    found = averages(ind.atr(df, 14, "_atr", "first", key), {"_pivot": ("close", 2.0 / 22, 21)}, "first", key)
    raw = F.when(F.col("_atr") != 0, (F.col("close") - F.col("_pivot")) / F.nullif(3.0 * F.col("_atr"), F.lit(0.0)) * 100)
    found = averages(found.withColumn("_dist", raw), {"_osc": ("_dist", 0.5, 3)}, "first", key).withColumn("_was", lag("_osc", 1, key))
    leaves = lambda level: (F.col("_was") <= level) & (F.col("_osc") > level)
    return _held(found, F.when(leaves(entry_threshold) | leaves(extreme), 1), out, key, "_atr", "_pivot", "_dist", "_osc", "_was")


def sig_sma_cross(df: DataFrame, fast: int = 10, slow: int = 30, out: str = "signal", key: Key = KEY) -> DataFrame:
    f, s = strict(fast, F.avg, "close", key), strict(slow, F.avg, "close", key)
    found = df.withColumns({"_fast": f, "_slow": s})
    return found.withColumn(out, F.when(F.col("_fast") > F.col("_slow"), 1).when(F.col("_fast") < F.col("_slow"), -1).otherwise(0)).drop("_fast", "_slow")


def sig_momentum_sign(df: DataFrame, lookback: int = 10, out: str = "signal", key: Key = KEY) -> DataFrame:
    found = df.withColumn("_r", F.ln(F.try_divide(F.col("close"), lag("close", 1, key))))
    return found.withColumn(out, F.coalesce(F.signum(strict(lookback, F.avg, "_r", key)), F.lit(0.0)).cast("int")).drop("_r")


def combine_hold(df: DataFrame, entries: list[tuple[Column, int]], flat_exits: bool = False, out: str = "signal", key: Key = KEY) -> DataFrame:
    """Entries (condition, value) in order, later ones win. A value of 0 is carried over like no decision, unless ``flat_exits``."""
    raw = F.lit(None).cast("int")
    for condition, value in entries:
        raw = F.when(F.coalesce(condition, F.lit(False)), F.lit(value)).otherwise(raw)
    return _held(df, raw if flat_exits else F.nullif(raw, F.lit(0)), out, key)


def entry_filters(df: DataFrame, ema_pair: tuple[str, str] | None = None, ema_level: str | None = None, adx_min: float | None = None, rsi_band: tuple[float, float] | None = None, rsi_ob_os: tuple[float, float] | None = None, momentum: tuple[str, str] | None = None, veto: str | None = None, shorts: bool = False, out: str = "direction") -> DataFrame:
    """``long``, ``short`` or NULL for each bar, from indicator columns; long wins. Bar 0 never enters.

    A missing average pair, ADX, RSI or momentum column value rules the bar out; a missing level doesn't.
    """
    no, yes = F.lit(False), F.lit(True)
    known, long_ok, short_ok = F.col("bar_idx") >= 1, yes, F.lit(shorts)
    if veto:
        known = known & ~F.coalesce(F.col(veto), no)
    if ema_pair:
        fast, slow = map(F.col, ema_pair)
        known, long_ok, short_ok = known & fast.isNotNull() & slow.isNotNull(), long_ok & (fast > slow), short_ok & (fast < slow)
    if ema_level:
        long_ok = long_ok & F.coalesce(F.col("close") >= F.col(ema_level), yes)
    if adx_min is not None:
        known, long_ok, short_ok = known & F.col("adx").isNotNull(), long_ok & (F.col("adx") >= adx_min), short_ok & (F.col("adx") >= adx_min)
    if rsi_band or rsi_ob_os:
        r = F.col("rsi")
        known = known & r.isNotNull()
        if rsi_band and (rsi_band[0] > 0 or rsi_band[1] < 100):
            long_ok, short_ok = long_ok & (r > rsi_band[0]) & (r < rsi_band[1]), short_ok & (r < 100 - rsi_band[0])
        elif rsi_ob_os:
            long_ok = long_ok & (r <= rsi_ob_os[0]) & (r >= rsi_ob_os[1])
    if momentum:
        fast, slow = map(F.col, momentum)
        known, long_ok = known & fast.isNotNull() & slow.isNotNull(), long_ok & (fast > slow)
    known, long_ok, short_ok = (F.coalesce(c, no) for c in (known, long_ok, short_ok))
    return df.withColumn(out, F.when(known & long_ok, F.lit("long")).when(known & short_ok, F.lit("short")))


def entry_oscillator(df: DataFrame, threshold: float = -50.0, osc: str = "oscillator", ema_level: str | None = None, veto: str | None = None, out: str = "direction", key: Key = KEY) -> DataFrame:
    """``long`` where the oscillator crosses above the threshold, unless below the average or vetoed."""
    found = df.withColumn("_was", lag(osc, 1, key))
    fires = (F.col("_was") <= threshold) & (F.col(osc) > threshold)
    if ema_level:
        fires = fires & F.coalesce(F.col("close") >= F.col(ema_level), F.lit(True))
    if veto:
        fires = fires & ~F.coalesce(F.col(veto), F.lit(False))
    return found.withColumn(out, F.when(F.coalesce(fires, F.lit(False)), F.lit("long"))).drop("_was")


def extreme_lookback(df: DataFrame, threshold: float = -50.0, extreme: float = -110.0, bars: int = 10, osc: str = "oscillator", out: str = "extreme_entry", key: Key = KEY) -> DataFrame:
    """The oscillator crosses the threshold and was at an extreme within the bars before."""
    found = df.withColumns({"_was": lag(osc, 1, key), "_low": F.min(osc).over(prior(bars, key))})
    return found.withColumn(out, F.coalesce((F.col("_was") <= threshold) & (F.col(osc) > threshold) & (F.col("_low") <= extreme), F.lit(False))).drop("_was", "_low")


def signal_counts(df: DataFrame, signal: str = "signal", key: Key = KEY) -> DataFrame:
    s = F.col(signal)
    return df.groupBy(*key).agg(F.count_if(s > 0).alias("n_long"), F.count_if(s < 0).alias("n_short"), F.count_if(s == 0).alias("n_flat"))


