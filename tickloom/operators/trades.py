"""Trades with stops, targets and trailing exits, built from candidate entries by searches along the bars and windows.

The steps: ``candidate_entries`` -> ``initial_levels`` -> an exit (``first_touch_exit``, ``trailing_exit``,
``close_signal_exit``, ``custom_exit``) -> ``resolve_overlaps`` -> ``size_and_pnl`` -> ``mark_to_market``. A candidate is
followed until it leaves or its series ends (reason ``Open``). Exits are sought in a pyramid of extremes, so that a trade
reads a few nodes however long it lasts. ``horizon`` asks for a time exit: a trade still open after so many bars leaves at
that bar's close with reason ``Time``.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEY, OHLC, Key, lag, ordered, so_far
from ..sources.scratch import materialise
from .asof import as_of
from .pyramid import Pyramid, Trail

#: Names of the exits (fixed values).
STOP, TRAIL, TARGET, OVERBOUGHT, SIGNAL, TIME, OPEN = "SL", "Trail", "PT", "OB", "Signal", "Time", "Open"


def skip_invalid_bars(bars: DataFrame) -> DataFrame:
    """Bars with all four prices; the others neither fill nor signal."""
    return bars.dropna(subset=list(OHLC))


def candidate_entries(bars: DataFrame, direction: str = "direction", atr: str | None = None, key: Key = KEY) -> DataFrame:
    """A row for each bar with a direction: it fills at the open of the next bar. ``atr``: carried along from the signal."""
    w = ordered(key)
    found = bars.withColumns({"entry_bar": F.lead("bar_idx").over(w), "entry_time": F.lead("ts").over(w), "entry_price": F.lead("open").over(w)})
    found = found.filter(F.col(direction).isNotNull() & F.col("entry_bar").isNotNull())
    extra = [F.col(atr).alias("entry_atr")] if atr else []
    return found.select(*key, F.col("bar_idx").alias("signal_bar"), F.col(direction).alias("direction"), "entry_bar", "entry_time", "entry_price", *extra)


def _side(direction: str = "direction") -> Column:
    return F.when(F.col(direction) == "short", -1.0).otherwise(1.0)


def initial_levels(entries: DataFrame, sl_atr: float = 0.0, tp_atr: float = 0.0, stop_pct: float = 0.0, target_pct: float = 0.0, trailing: bool = False) -> DataFrame:
    """``stop_price`` and ``target_price``: multiples of the ATR, else percentages; a percentage target only without trailing
    and without an ATR target."""
    p, none = F.col("entry_price"), F.lit(None).cast("double")
    stop = target = none
    if sl_atr > 0:
        atr = F.when(F.col("entry_atr") > 0, F.col("entry_atr"))
        stop = p - _side() * atr * sl_atr
        target = p + _side() * atr * tp_atr if tp_atr > 0 else none
    elif stop_pct > 0:
        stop = p * (1 - _side() * stop_pct / 100.0)
    if target_pct > 0 and tp_atr <= 0 and not trailing:
        target = p * (1 + _side() * target_pct / 100.0)
    return entries.withColumns({"stop_price": stop, "target_price": target})


def _searches(entries: DataFrame, bars: DataFrame, horizon: int | None, key: Key) -> DataFrame:
    """Entries that look for their exits after the entry bar, up to the end of the series or the horizon."""
    if horizon is None:
        return entries.withColumns({"_from": F.col("entry_bar"), "_until": F.lit(2**62)})
    return entries.withColumns({"_from": F.col("entry_bar"), "_until": F.col("entry_bar") + horizon})


def _at_exit(found: DataFrame, bars: DataFrame, columns: Key, key: Key) -> DataFrame:
    """Searches with the bar that they found, if any: ``at_time, at_open, at_high, at_low, at_close`` and ``at_<column>``."""
    names = {"ts": "at_time", **{c: f"at_{c}" for c in (*OHLC, *columns)}}
    at = bars.select(*key, F.col("bar_idx").alias("_bar"), *[F.col(c).alias(n) for c, n in names.items()])
    # Those that found none meet no bar; their keys differ, so they don't gather in one place.
    return found.withColumn("_bar", F.coalesce("_at", -1 - F.abs(F.col("entry_bar")))).join(at, [*key, "_bar"], "left").drop("_bar")


def _closed(entries: DataFrame, met: DataFrame, bar: Column, time: Column, price: Column, reason: Column, at_open: bool, bars: DataFrame, horizon: int | None, key: Key) -> DataFrame:
    """Entries with the exits that they met (``bar`` is NULL for none); such leave at the horizon if there is one, or stay open.
    A reason without a bar stands for an exit that nothing fills."""
    hit, ran, late = reason.isNotNull(), F.lit(False), {c: F.lit(None) for c in ("_bar", "_time", "_close")}
    if horizon is not None:
        last = bars.select(*key, F.col("bar_idx").alias("_bar"), F.col("ts").alias("_time"), F.col("close").alias("_close"))
        met = met.withColumn("_bar", F.col("entry_bar") + horizon).join(last, [*key, "_bar"], "left")
        ran, late = F.col("_close").isNotNull(), {c: F.col(c) for c in late}
    return met.select(
        *entries.columns, F.when(hit, bar).when(ran, late["_bar"]).cast("long").alias("exit_bar"), F.when(hit, time).when(ran, late["_time"]).alias("exit_time"),
        F.when(hit, price).when(ran, late["_close"]).cast("double").alias("exit_price"), F.when(hit, reason).when(ran, F.lit(TIME)).otherwise(F.lit(OPEN)).alias("exit_signal"),
        (hit & F.lit(at_open)).alias("fills_at_open"),
    )


def _touch(stop: Column, target: Column, key: Key) -> tuple[Column, Column, Column]:
    """Whether stop or target trades on a bar, at which price, and why; gaps fill at the open. Both: the bar's colour decides."""
    long = F.col("direction") != "short"
    o, h, low = F.col("at_open"), F.col("at_high"), F.col("at_low")
    stopped = F.coalesce(F.when(long, F.least(o, low) <= stop).otherwise(F.greatest(o, h) >= stop), F.lit(False))
    reached = F.coalesce(F.when(long, F.greatest(o, h) >= target).otherwise(F.least(o, low) <= target), F.lit(False))
    stop_fill = F.when(long, F.least(o, stop)).otherwise(F.greatest(o, stop))
    target_fill = F.when(long, F.greatest(o, target)).otherwise(F.least(o, target))
    takes_stop = stopped & (~reached | (F.col("at_close") < o))
    return stopped | reached, F.when(takes_stop, stop_fill).otherwise(target_fill), F.when(takes_stop, F.lit(STOP)).otherwise(F.lit(TARGET))


#: Room for rounding between a sum of a bar's own numbers and the level that a trade sees, as a share of both.
ROUNDING = 1e-12


def first_touch_exit(entries: DataFrame, bars: DataFrame, horizon: int | None = None, sl_atr: float = 0.0, tp_atr: float = 0.0, atr: str = "atr", static_stop: bool = False, key: Key = KEY) -> DataFrame:
    """Exit on the first later bar where a level trades.

    With ``sl_atr`` the levels follow each bar's own ATR (a missing one leaves the initial levels). A percentage stop is
    watched only with ``static_stop``.
    """
    dynamic = sl_atr > 0
    down, up = F.least("open", "low"), F.greatest("open", "high")
    sums = {"_down": down, "_up": up}
    if dynamic:
        # What follows a bar's ATR is sought by sums of its prices and its ATR, the rest by its prices.
        known = F.col(atr) > 0
        low = lambda by: F.when(known, _moved(down + F.col(atr) * by, down, F.col(atr) * by, -1))
        high = lambda by: F.when(known, _moved(up + F.col(atr) * by, up, F.col(atr) * by, 1))
        sums = {"_down": F.when(~F.coalesce(known, F.lit(False)), down), "_up": F.when(~F.coalesce(known, F.lit(False)), up), "_sl_long": low(sl_atr), "_sl_short": high(-sl_atr)}
        if tp_atr > 0:
            sums |= {"_tp_long": high(-tp_atr), "_tp_short": low(tp_atr)}
        else:
            sums |= {"_tp_long": up, "_tp_short": down}
    extra = (atr,) if dynamic else ()
    bars = materialise(bars.select(*key, "bar_idx", "ts", *OHLC, *extra).withColumns(sums), "path-bars")
    lows, highs = [c for c in ("_down", "_sl_long", "_tp_short") if c in sums], [c for c in ("_up", "_sl_short", "_tp_long") if c in sums]
    pyramid = Pyramid(bars, lows, highs, key=key)
    long, p, stop, target = F.col("direction") != "short", F.col("entry_price"), F.col("stop_price"), F.col("target_price")
    if not dynamic and not static_stop:
        stop = F.lit(None).cast("double")
    any_of = lambda *tests: reduce(Column.__or__, [F.coalesce(t, F.lit(False)) for t in tests])

    def hit(x: Column, _: Column) -> Column:
        longs, shorts = [x["_down"] <= stop, x["_up"] >= target], [x["_up"] >= stop, x["_down"] <= target]
        if dynamic:
            below, above = p + F.abs(p) * ROUNDING, p - F.abs(p) * ROUNDING
            longs, shorts = [*longs, x["_sl_long"] <= below], [*shorts, x["_sl_short"] >= above]
            to_long, to_short = (above, below) if tp_atr > 0 else (target, target)
            longs, shorts = [*longs, x["_tp_long"] >= to_long], [*shorts, x["_tp_short"] <= to_short]
        return F.when(long, any_of(*longs)).otherwise(any_of(*shorts))

    at_stop, at_target = stop, target
    if dynamic:
        now = F.col(f"at_{atr}")
        at_stop = F.when(now > 0, p - _side() * now * sl_atr).otherwise(stop)
        at_target = F.when(now > 0, p + _side() * now * tp_atr).otherwise(target) if tp_atr > 0 else target
    touched, price, reason = _touch(F.col("_stop"), F.col("_target"), key)
    exits = [(F.col("_at"), F.col("at_time"), price, F.when(F.col("_at").isNotNull(), reason))]
    levels = {"_stop": at_stop, "_target": at_target}
    open_, done = _searches(entries, bars, horizon, key), []
    while True:
        met = _at_exit(pyramid.first(open_, hit), bars, extra, key).withColumns(levels)
        if not dynamic:
            return _closed(entries, met, *exits[0], False, bars, horizon, key)
        # A bar within the room for rounding that doesn't touch after all: look on from there.
        met = materialise(met, "touched")
        missed = F.col("_at").isNotNull() & ~touched
        done.append(met.filter(~missed))
        open_ = met.filter(missed).withColumn("_from", F.col("_at")).select(*entries.columns, "_from", "_until")
        if open_.isEmpty():
            return _closed(entries, reduce(DataFrame.unionByName, done), *exits[0], False, bars, horizon, key)


def _moved(total: Column, a: Column, b: Column, way: int) -> Column:
    """A sum moved by the room for rounding, down or up."""
    return total + F.lit(way * ROUNDING) * (F.abs(a) + F.abs(b))


def _entry_bar(entries: DataFrame, bars: DataFrame, key: Key, **columns: str) -> DataFrame:
    """Entries with columns of the bar on which they fill."""
    first = bars.select(*key, F.col("bar_idx").alias("entry_bar"), *[F.col(c).alias(n) for n, c in columns.items()])
    return entries.join(first, [*key, "entry_bar"])


def trailing_exit(entries: DataFrame, bars: DataFrame, activation_pct: float, trailing_pct: float, horizon: int | None = None, key: Key = KEY) -> DataFrame:
    """Intrabar trailing stop: active once the price has moved by ``activation_pct``, then ``trailing_pct`` behind the best
    price since entry (the entry bar's included); it never loosens."""
    long = F.col("direction") != "short"
    level = F.col("entry_price") * (1 + _side() * activation_pct / 100.0)
    # Shorts trail the lowest low: with all signs turned, that is the highest.
    behind, ahead = 1 - trailing_pct / 100.0, 1 + trailing_pct / 100.0
    sums = {"_down": F.least("open", "low"), "_up": -F.greatest("open", "high"), "_low": -F.col("low")}
    bars = materialise(bars.select(*key, "bar_idx", "ts", *OHLC).withColumns(sums), "path-bars")
    pyramid = Pyramid(bars, ("_down", "_up"), ("high", "_low"), {"_long": Trail("_down", "high", behind), "_short": Trail("_up", "_low", ahead)}, key)
    started = _entry_bar(_searches(entries, bars, horizon, key), bars, key, _high0="high", _low0="low")
    started = started.withColumn("_top", F.when(long, F.greatest("_high0", "entry_price")).otherwise(-F.least("_low0", "entry_price")))
    best = lambda m, x: F.greatest(m, F.when(long, x["high"]).otherwise(x["_low"]))
    active = pyramid.first(started, lambda x, m: F.when(long, x["high"] >= level).otherwise(-x["_low"] <= level), F.col("_top"), best)
    active = _begun(active, "_top")

    def trails(x: Column, m: Column) -> Column:
        return F.when(long, x["_long"] | F.coalesce(x["_down"] <= m * behind, F.lit(False))).otherwise(x["_short"] | F.coalesce(x["_up"] <= m * ahead, F.lit(False)))

    met = _at_exit(pyramid.first(active, trails, F.col("_top"), best), bars, (), key)
    trail = F.when(long, F.greatest("_carried", "at_high") * behind).otherwise(F.least(-F.col("_carried"), "at_low") * ahead)
    price = F.when(long, F.least("at_open", trail)).otherwise(F.greatest("at_open", trail))
    return _closed(entries, met, F.col("_at"), F.col("at_time"), price, F.when(F.col("_at").isNotNull(), TRAIL), False, bars, horizon, key)


def _begun(active: DataFrame, carried: str) -> DataFrame:
    """Searches that go on from the bar they found, that one included. Those without one end before they begin."""
    from_, until = F.coalesce(F.col("_at") - 1, F.col("_from")), F.when(F.col("_at").isNull(), -1).otherwise(F.col("_until")).cast("long")
    return active.withColumns({"_from": from_, "_until": until, carried: F.col("_carried")}).drop("_at", "_carried")


def _next_open(entries: DataFrame, met: DataFrame, reason: Column, bars: DataFrame, horizon: int | None, key: Key) -> DataFrame:
    """The bar that a search found queues an exit at the open of the bar after it; without one the trade stays open."""
    fill = bars.select(*key, F.col("bar_idx").alias("_next"), F.col("ts").alias("_fill_time"), F.col("open").alias("_fill"))
    queued = met.withColumn("_next", F.coalesce(F.col("_at") + 1, -1 - F.abs(F.col("entry_bar")))).join(fill, [*key, "_next"], "left")
    filled = F.col("_fill").isNotNull()
    reason = F.when(F.col("_at").isNotNull(), F.when(filled, reason).otherwise(OPEN))
    return _closed(entries, queued, F.when(filled, F.col("_next")), F.col("_fill_time"), F.col("_fill"), reason, True, bars, horizon, key)


def close_signal_exit(entries: DataFrame, bars: DataFrame, stop_pct: float = 0.0, activation_pct: float = 0.0, trailing_pct: float = 0.0, osc: str | None = None, ob_level: float = 100.0, horizon: int | None = None, key: Key = KEY) -> DataFrame:
    """Exits judged at the close and filled at the next open: stop, then trailing stop behind the highest close (both for
    longs only), then the oscillator falling through its overbought level."""
    falls = (lag(osc, 1, key) >= ob_level) & (F.col(osc) < ob_level) if osc else F.lit(False)
    bars = materialise(bars.select(*key, "bar_idx", "ts", *OHLC, F.coalesce(falls, F.lit(False)).cast("int").alias("_falls")), "path-bars")
    behind = 1 - trailing_pct / 100.0
    pyramid = Pyramid(bars.withColumn("_low", F.col("close")), ("_low",), ("close", "_falls"), {"_trails": Trail("_low", "close", behind)}, key)
    long, p = F.col("direction") != "short", F.col("entry_price")
    stopped = lambda c: long & (c <= p * (1 - stop_pct / 100.0)) if stop_pct > 0 else F.lit(False)
    searches = _searches(entries, bars, horizon, key)
    found = pyramid.first(searches, lambda x, m: F.coalesce(stopped(x["_low"]), F.lit(False)) | (x["_falls"] == 1)).drop("_carried").withColumnRenamed("_at", "_other")
    found = found.withColumn("_trailed", F.lit(None).cast("long"))
    if trailing_pct > 0:
        best = lambda m, x: F.greatest(m, x["close"])
        started = _entry_bar(found.drop("_trailed"), bars, key, _close0="close").withColumn("_best", F.greatest("_close0", "entry_price"))
        active = pyramid.first(started, lambda x, m: long & ((x["close"] - p) / p * 100 >= activation_pct), F.col("_best"), best)
        found = pyramid.first(_begun(active, "_best"), lambda x, m: x["_trails"] | F.coalesce(x["_low"] <= m * behind, F.lit(False)), F.col("_best"), best).drop("_carried").withColumnRenamed("_at", "_trailed")
    met = _at_exit(found.withColumn("_at", F.least("_other", "_trailed")), bars, (), key)
    why = F.when(stopped(F.col("at_close")), STOP).when(F.col("_at") == F.col("_trailed"), TRAIL).otherwise(OVERBOUGHT)
    return _next_open(entries, met, why, bars, horizon, key)


def custom_exit(entries: DataFrame, bars: DataFrame, condition: str, horizon: int | None = None, key: Key = KEY) -> DataFrame:
    """Exit at the open after the first bar on which the Boolean column ``condition`` holds."""
    bars = materialise(bars.select(*key, "bar_idx", "ts", *OHLC, F.coalesce(condition, F.lit(False)).cast("int").alias("_leaves")), "path-bars")
    found = Pyramid(bars, (), ("_leaves",), key=key).first(_searches(entries, bars, horizon, key), lambda x, m: x["_leaves"] == 1)
    return _next_open(entries, found, F.lit(SIGNAL), bars, horizon, key)


def _streamed(rows: DataFrame, by: list[str], order: list[str], step: Callable, start: float, out: str, key: Key) -> DataFrame:
    """Run ``step`` over the rows of each series in order, batch by batch: only the state of one series is held."""
    named = rows.withColumn("_series", F.xxhash64(*key))
    schema = ", ".join([*[f"`{c}` {t}" for c, t in rows.select(*by).dtypes], out])

    def run(batches):
        series, state = None, start
        for pdf in batches:
            made, places = [], []
            columns = [pdf[c].tolist() for c in ("_series", *order)]
            for i, (own, *values) in enumerate(zip(*columns, strict=True)):
                if own != series:
                    series, state = own, start
                state, result = step(state, *values)
                if result is not None:
                    places.append(i)
                    made.append(result)
            if made:
                extra = pd.DataFrame(made, columns=[c.split()[0] for c in out.split(", ")], index=pdf.index[places])
                yield pd.concat([pdf.loc[pdf.index[places], by], extra], axis=1)

    return named.repartition(*key).sortWithinPartitions(*key, *order).select("_series", *dict.fromkeys([*by, *order])).mapInPandas(run, schema)


def resolve_overlaps(trades: DataFrame, key: Key = KEY) -> DataFrame:
    """One position at a time: drop candidates whose signal falls into a trade that was taken.

    After an exit within a bar the next signal may come one bar later, after an exit at an open on that bar. A candidate that
    comes when all before it have left is taken for certain. Every candidate points to the first that may follow it, up to
    the next certain one; the pointers are doubled until all that is reached is marked: log2 rounds of the most trades taken
    between two certain ones. Candidates of one bar count as one, free again at their earliest exit.
    """
    trades = materialise(trades, "candidates")  # read twice
    free = F.when(F.col("exit_bar").isNull(), F.lit(2**62)).when(F.col("fills_at_open"), F.col("exit_bar")).otherwise(F.col("exit_bar") + 1)
    nodes = trades.filter("signal_bar IS NOT NULL").groupBy(*key, F.col("signal_bar").cast("long").alias("bar_idx")).agg(F.min(free).cast("long").alias("_free"))
    before = F.max("_free").over(ordered(key).rowsBetween(Window.unboundedPreceding, -1))
    nodes = nodes.withColumns({"_node": F.col("bar_idx"), "_sure": F.coalesce(F.col("bar_idx") >= before, F.lit(True))})
    later = nodes.select(*key, "bar_idx", F.col("_node").alias("_next"), F.col("_sure").alias("_stops"))
    asks = nodes.withColumn("bar_idx", F.greatest("_free", F.col("bar_idx") + 1))
    found = as_of(asks, later, ("_next", "_stops"), "bar_idx", key, "forward")
    found = materialise(found.select(*key, "_node", "_sure", F.when(~F.col("_stops"), F.col("_next")).alias("_next")), "pointers")
    taken = found.filter("_sure").select(*key, "_node")
    links = found.filter("_next IS NOT NULL").select(*key, "_node", "_next")
    while not links.isEmpty():
        reached = taken.join(links, [*key, "_node"]).select(*key, F.col("_next").alias("_node"))
        taken = materialise(taken.unionByName(reached), "reached")
        onward = links.select(*key, F.col("_node").alias("_next"), F.col("_next").alias("_last"))
        links = materialise(links.join(onward, [*key, "_next"]).select(*key, "_node", F.col("_last").alias("_next")), "pointers")
    return trades.join(taken.withColumnRenamed("_node", "signal_bar"), [*key, "signal_bar"])


def excursions(trades: DataFrame, bars: DataFrame, key: Key = KEY) -> DataFrame:
    """``mfe_pct`` and ``mae_pct`` (largest favourable and adverse moves, 0 at least) and ``bars_in_trade``, from the entry
    bar to the exit bar; a trade that leaves at an open doesn't see that bar."""
    last = F.col("exit_bar") - F.when(F.col("fills_at_open"), 1).otherwise(0)
    own = bars.select(*key, "bar_idx", F.col("low").alias("_lo"), F.col("high").alias("_hi"))
    spans = trades.withColumns({"_from": F.col("entry_bar"), "_until": F.when(F.col("exit_bar").isNull(), -1).otherwise(F.greatest(last, "entry_bar")).cast("long")})
    seen = Pyramid(own, ("_lo",), ("_hi",), key=key).ranges(spans)
    long, p, any_bar = F.col("direction") != "short", F.col("entry_price"), F.col("_bars") > 0
    up, down = (F.col("_hi") - p) / p * 100, (p - F.col("_lo")) / p * 100
    return seen.select(
        *trades.columns, F.when(any_bar, F.greatest(F.lit(0.0), F.when(long, up).otherwise(down))).alias("mfe_pct"),
        F.when(any_bar, F.greatest(F.lit(0.0), F.when(long, down).otherwise(up))).alias("mae_pct"), F.when(any_bar, F.col("_bars")).alias("bars_in_trade"),
    )


def size_and_pnl(trades: DataFrame, capital: float = 10_000.0, size_pct: float = 100.0, commission_pct: float = 0.0, key: Key = KEY) -> DataFrame:
    """Whole units for a share of the equity, which chains from trade to trade; commission on both sides.

    Trades too small for one unit are left out; ids are dense. An open trade has a size but no P&L. Cash moves by the net
    P&L for both directions. The sorted prices stream by with the cash; the results are joined to the trades.
    """
    trades, rate = materialise(trades, "taken"), commission_pct / 100.0  # read twice
    short = F.coalesce(F.col("direction") == "short", F.lit(False))
    rows = trades.select(*key, "entry_bar", "signal_bar", F.col("entry_price").alias("_in"), F.coalesce("exit_price", F.lit(float("nan"))).alias("_out"), short.alias("_short"))

    def step(state: tuple, _entry: int, _signal: int, price: float, out: float, short: bool) -> tuple[tuple, tuple | None]:
        cash, count = state
        qty = math.floor(cash * (size_pct / 100.0) / price) if price > 0 else 0
        if qty <= 0:
            return state, None
        value, left = qty * price, qty * out
        open_ = out != out
        fees = (value + (0.0 if open_ else left)) * rate
        pnl = None if open_ else (value - left if short else left - value) - fees
        cash += pnl or 0.0
        return (cash, count + 1), (count + 1, qty, value, fees, pnl, cash)

    out = "trade_id bigint, qty bigint, entry_value double, commission double, pnl double, cash_after double"
    by = [*key, "entry_bar", "signal_bar"]
    sized = _streamed(rows, by, ["entry_bar", "signal_bar", "_in", "_out", "_short"], step, (float(capital), 0), out, key)
    return trades.join(sized, by).withColumn("pnl_pct", F.try_divide("pnl", "entry_value") * 100.0)


def mark_to_market(trades: DataFrame, bars: DataFrame, capital: float = 10_000.0, commission_pct: float = 0.0, key: Key = KEY) -> DataFrame:
    """``equity``, ``peak`` and ``drawdown`` of every bar: the cash, and while a trade is open its gain at the close."""
    rate = commission_pct / 100.0
    trades = materialise(trades, "trades")  # read twice
    # A trade opens at its entry bar and is carried on until one opens or closes; a bar that closes one may open the next.
    opens = trades.filter(F.col("exit_bar").isNull() | (F.col("exit_bar") > F.col("entry_bar")))
    opens = opens.select(*key, F.col("entry_bar").alias("bar_idx"), F.struct("qty", "entry_price", _side().alias("side")).alias("_opens"))
    paid = trades.filter(F.col("exit_bar").isNotNull()).select(*key, F.col("exit_bar").alias("bar_idx"), "cash_after")
    joined = bars.join(opens, [*key, "bar_idx"], "left").join(paid, [*key, "bar_idx"], "left")
    event = F.when(F.col("_opens").isNotNull(), F.struct(F.lit(True).alias("open"), F.col("_opens").alias("trade"))).when(F.col("cash_after").isNotNull(), F.struct(F.lit(False).alias("open"), F.col("_opens").alias("trade")))
    joined = joined.withColumn("_held", F.last(event, ignorenulls=True).over(so_far(key)))
    joined = joined.withColumns({c: F.when(F.col("_held.open"), F.col(f"_held.trade.{c}")) for c in ("qty", "entry_price", "side")})
    cash = F.coalesce(F.last("cash_after", ignorenulls=True).over(so_far(key)), F.lit(float(capital)))
    gain = F.coalesce(F.col("qty") * F.col("side") * (F.col("close") - F.col("entry_price")) - F.col("qty") * F.col("entry_price") * rate, F.lit(0.0))
    found = joined.withColumn("_cash", cash).withColumn("equity", F.col("_cash") + gain)
    found = found.withColumn("peak", F.greatest(F.max("equity").over(so_far(key)), F.lit(float(capital))))
    return found.select(*bars.columns, "equity", "peak", (F.col("peak") - F.col("equity")).alias("drawdown"))
