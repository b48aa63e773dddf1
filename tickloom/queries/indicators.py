"""Queries of the indicators, on hourly bars of the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from .base import BARS, LAG, bars, ewm, over, query, r6, strict, with_

N = 14
A_EMA, A_RMA = "(2.0 / 15)", "(1.0 / 14)"
ID = ("symbol", "bar_idx")
J = "LEFT JOIN {0} ON {0}.symbol = b.symbol AND {0}.bar_idx = b.bar_idx"


def _y(name: str, source: str = "bars") -> str:
    return f"SELECT b.symbol, b.bar_idx, round({name}.y, 6) AS {{}} FROM {source} b {J.format(name)}"


@query(with_(BARS) + f"SELECT symbol, bar_idx, round({strict('avg', 'close', N)}, 6) AS sma FROM bars")
def sma(spark, sf):
    return ind.sma(bars(spark, sf), "close", N).select(*ID, *r6("sma"))


def _average(name, alpha, seed, f, **options):
    sql = with_(BARS, ewm("y1", "bars", "close", alpha, N, seed)) + _y("y1").format("value")
    query(sql, name)(lambda spark, sf: f(bars(spark, sf), "close", N, "value", seed=seed, **options).select(*ID, *r6("value")))


_average("ema_seeded", A_EMA, "sma", ind.ema)
_average("rma_seeded", A_RMA, "sma", ind.rma)
_average("rma_first", A_RMA, "first", ind.rma)


@query(with_(BARS, ewm("y1", "bars", "close", A_EMA, N, "first")) + f"SELECT b.symbol, b.bar_idx, round(CASE WHEN b.bar_idx >= 13 THEN y1.y END, 6) AS value FROM bars b {J.format('y1')}")
def ema_first(spark, sf):
    return ind.ema(bars(spark, sf), "close", N, "value", seed="first", min_periods=N).select(*ID, *r6("value"))


TR = f"""tr AS (SELECT *, CASE WHEN bar_idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) END AS tr FROM bars)"""


@query(with_(BARS, TR) + "SELECT symbol, bar_idx, round(tr, 6) AS true_range FROM tr")
def true_range(spark, sf):
    return ind.true_range(bars(spark, sf)).select(*ID, *r6("true_range"))


for _seed, _name in (("sma", "atr_seeded"), ("first", "atr_first")):
    query(with_(BARS, TR, ewm("y1", "tr", "tr", A_RMA, N, _seed)) + _y("y1").format("atr"), _name)(
        lambda spark, sf, seed=_seed: ind.atr(bars(spark, sf), N, seed=seed).select(*ID, *r6("atr"))
    )

DMI = (
    BARS, TR,
    f"mv AS (SELECT *, high - lag(high) {LAG} AS up, lag(low) {LAG} - low AS down FROM tr)",
    "dm AS (SELECT *, CASE WHEN up IS NOT NULL THEN CASE WHEN up > down AND up > 0 THEN up ELSE 0.0 END END AS p, CASE WHEN up IS NOT NULL THEN CASE WHEN down > up AND down > 0 THEN down ELSE 0.0 END END AS m FROM mv)",
    ewm("st", "dm", "tr", A_RMA, N), ewm("sp", "dm", "p", A_RMA, N), ewm("sm", "dm", "m", A_RMA, N),
    f"di AS (SELECT b.symbol, b.bar_idx, 100 * sp.y / nullif(st.y, 0) AS pdi, 100 * sm.y / nullif(st.y, 0) AS mdi FROM bars b {J.format('st')} {J.format('sp')} {J.format('sm')})",
    "dx AS (SELECT *, CASE WHEN pdi + mdi = 0 THEN 0.0 ELSE 100 * abs(pdi - mdi) / (pdi + mdi) END AS dx FROM di)",
    ewm("ad", "dx", "dx", A_RMA, N),
)


@query(with_(*DMI) + f"SELECT b.symbol, b.bar_idx, round(b.pdi, 6) AS plus_di, round(b.mdi, 6) AS minus_di, round(ad.y, 6) AS adx FROM di b {J.format('ad')}")
def dmi(spark, sf):
    return ind.dmi(bars(spark, sf), N).select(*ID, *r6("plus_di", "minus_di", "adx"))


@query(with_(*DMI) + _y("ad").format("adx"))
def adx(spark, sf):
    return ind.adx(bars(spark, sf), N).select(*ID, *r6("adx"))


CHANGE = f"ch AS (SELECT *, close - lag(close) {LAG} AS d FROM bars), gl AS (SELECT *, CASE WHEN d IS NOT NULL THEN greatest(d, 0.0) END AS g, CASE WHEN d IS NOT NULL THEN greatest(-d, 0.0) END AS l, CASE WHEN d > 0 THEN d ELSE 0.0 END AS g0, CASE WHEN d < 0 THEN -d ELSE 0.0 END AS l0 FROM ch)"


def rsi_value(g: str, l: str, flat: str) -> str:
    return f"CASE WHEN {l} = 0 THEN CASE WHEN {g} > 0 THEN 100.0 ELSE {flat} END ELSE 100 - 100 / (1 + {g} / nullif({l}, 0)) END"


for _method, _name, _seed, _g, _l, _flat in (("seeded", "rsi_seeded", "sma", "g", "l", "50.0"), ("first", "rsi_first", "first", "g0", "l0", "NULL")):
    query(
        with_(BARS, CHANGE, ewm("ag", "gl", _g, A_RMA, N, _seed), ewm("al", "gl", _l, A_RMA, N, _seed))
        + f"SELECT b.symbol, b.bar_idx, round({rsi_value('ag.y', 'al.y', _flat)}, 6) AS rsi FROM bars b {J.format('ag')} {J.format('al')}",
        _name,
    )(lambda spark, sf, method=_method: ind.rsi(bars(spark, sf), "close", N, method=method).select(*ID, *r6("rsi")))

RSI_ROLLING = f"{CHANGE}, rr AS (SELECT *, {strict('avg', 'g0', N)} AS ag, {strict('avg', 'l0', N)} AS al FROM gl), rsi AS (SELECT *, {rsi_value('ag', 'al', 'NULL')} AS rsi FROM rr)"


@query(with_(BARS, RSI_ROLLING) + "SELECT symbol, bar_idx, round(CASE WHEN ag IS NOT NULL THEN rsi END, 6) AS rsi FROM rsi")
def rsi_rolling(spark, sf):
    return ind.rsi(bars(spark, sf), "close", N, method="rolling").select(*ID, *r6("rsi"))


def macd_ctes(seed: str) -> tuple[str, ...]:
    return (
        ewm("mf", "bars", "close", "(2.0 / 13)", 12, seed), ewm("ms", "bars", "close", "(2.0 / 27)", 26, seed),
        f"md AS (SELECT b.symbol, b.bar_idx, mf.y - ms.y AS macd FROM bars b {J.format('mf')} {J.format('ms')})", ewm("mg", "md", "macd", "(2.0 / 10)", 9, seed),
    )


for _seed, _name in (("sma", "macd_seeded"), ("first", "macd_first")):
    query(
        with_(BARS, *macd_ctes(_seed)) + f"SELECT b.symbol, b.bar_idx, round(b.macd, 6) AS macd, round(mg.y, 6) AS macd_signal, round(b.macd - mg.y, 6) AS macd_hist FROM md b {J.format('mg')}", _name
    )(lambda spark, sf, seed=_seed: ind.macd(bars(spark, sf), seed=seed).select(*ID, *r6("macd", "macd_signal", "macd_hist")))


@query(with_(BARS) + f"""SELECT symbol, bar_idx, round(m, 6) AS bb_mid, round(m + 2 * s, 6) AS bb_upper, round(m - 2 * s, 6) AS bb_lower
FROM (SELECT *, {strict('avg', 'close', 20)} AS m, {strict('stddev_pop', 'close', 20)} AS s FROM bars)""")
def bollinger(spark, sf):
    return ind.bollinger(bars(spark, sf)).select(*ID, *r6("bb_mid", "bb_upper", "bb_lower"))


@query(with_(BARS, f"hl AS (SELECT *, {strict('max', 'high', N)} AS hh, {strict('min', 'low', N)} AS ll FROM bars)",
    "raw AS (SELECT *, CASE WHEN hh IS NULL OR ll IS NULL THEN NULL WHEN hh = ll THEN 50.0 ELSE 100 * (close - ll) / (hh - ll) END AS k0 FROM hl)",
    f"k AS (SELECT *, {strict('avg', 'k0', 3)} AS k FROM raw)") + f"SELECT symbol, bar_idx, round(k, 6) AS stoch_k, round({strict('avg', 'k', 3)}, 6) AS stoch_d FROM k")
def stochastic(spark, sf):
    return ind.stochastic(bars(spark, sf), N, 3, 3).select(*ID, *r6("stoch_k", "stoch_d"))


@query(with_(BARS) + f"SELECT symbol, bar_idx, round({strict('max', 'high', N)}, 6) AS highest FROM bars")
def highest(spark, sf):
    return ind.highest(bars(spark, sf), "high", N).select(*ID, *r6("highest"))


@query(with_(BARS) + f"SELECT symbol, bar_idx, round({strict('min', 'low', N)}, 6) AS lowest FROM bars")
def lowest(spark, sf):
    return ind.lowest(bars(spark, sf), "low", N).select(*ID, *r6("lowest"))


CROSS = f"x AS (SELECT *, {strict('avg', 'close', 5)} AS a, {strict('avg', 'close', 20)} AS b FROM bars)"


@query(with_(BARS, CROSS) + f"SELECT symbol, bar_idx, coalesce(a > b AND lag(a) {LAG} <= lag(b) {LAG}, false) AS cross_up FROM x")
def crossover(spark, sf):
    both = ind.sma(ind.sma(bars(spark, sf), "close", 5, "a"), "close", 20, "b")
    return ind.crossover(both, "a", "b").select(*ID, "cross_up")


@query(with_(BARS, CROSS) + f"SELECT symbol, bar_idx, coalesce(a < 50.0 AND lag(a) {LAG} >= 50.0, false) AS cross_down FROM x")
def crossunder(spark, sf):
    return ind.crossunder(ind.sma(bars(spark, sf), "close", 5, "a"), "a", 50.0).select(*ID, "cross_down")


OSC = (
    TR, ewm("oa", "tr", "tr", A_RMA, 14), ewm("oe", "bars", "close", "(2.0 / 22)", 21),
    f"od AS (SELECT b.symbol, b.bar_idx, CASE WHEN oa.y <> 0 THEN (b.close - oe.y) / (3.0 * oa.y) * 100 END AS d FROM bars b {J.format('oa')} {J.format('oe')})",
    ewm("os", "od", "d", "(2.0 / 4)", 3),
)


@query(with_(BARS, *OSC) + _y("os").format("oscillator"))
def atr_oscillator(spark, sf):
    return ind.atr_oscillator(bars(spark, sf)).select(*ID, *r6("oscillator"))


SLOPE = (ewm("se", "bars", "close", "(2.0 / 22)", 21), f"sl AS (SELECT b.symbol, b.bar_idx, se.y AS e, lag(se.y, 5) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS e5 FROM bars b {J.format('se')})")


@query(with_(BARS, *SLOPE) + "SELECT symbol, bar_idx, round(100 * (e - e5) / nullif(e5, 0), 6) AS ema_slope_pct FROM sl")
def ema_slope_pct(spark, sf):
    return ind.ema_slope_pct(bars(spark, sf), 21, 5).select(*ID, *r6("ema_slope_pct"))


RANGE = f"rg AS (SELECT *, CASE WHEN bar_idx >= 20 AND min(low) {over(20)} > 0 THEN 100 * (max(high) {over(20)} - min(low) {over(20)}) / min(low) {over(20)} END AS range_pct FROM bars)"


@query(with_(BARS, RANGE) + "SELECT symbol, bar_idx, round(range_pct, 6) AS range_pct FROM rg")
def range_compression_pct(spark, sf):
    return ind.range_compression_pct(bars(spark, sf), 20).select(*ID, *r6("range_pct"))


FLAG = (
    *DMI, RANGE, ewm("se", "bars", "close", "(2.0 / 22)", 21),
    f"sl AS (SELECT b.symbol, b.bar_idx, se.y AS e, lag(se.y, 20) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS e5 FROM bars b {J.format('se')})",
    ewm("cf", "bars", "close", "(2.0 / 10)", 9), ewm("cs", "bars", "close", "(2.0 / 22)", 21),
    f"fl AS (SELECT b.symbol, b.bar_idx, list_filter([100 * (sl.e - sl.e5) / nullif(sl.e5, 0) < 2.0, rg.range_pct < 20000.0, cf.y < cs.y, ad.y < 30.0], lambda t: t IS NOT NULL) AS ts FROM bars b {J.format('sl')} {J.format('rg')} {J.format('cf')} {J.format('cs')} {J.format('ad')})",
)


@query(with_(*FLAG) + "SELECT symbol, bar_idx, len(ts) > 0 AND len(list_filter(ts, lambda t: NOT t)) = 0 AS consolidating FROM fl")
def consolidation_flag(spark, sf):
    return ind.consolidation_flag(bars(spark, sf), 2.0, 20000.0, 30.0, (9, 21), 21, 20, 14).select(*ID, "consolidating")


@query(with_(BARS) + f"SELECT symbol, bar_idx, round(lag(close, 3) {LAG}, 6) AS lagged FROM bars")
def lag_value(spark, sf):
    return ind.lag_value(bars(spark, sf), "close", 3).select(*ID, *r6("lagged"))


@query(with_(BARS, f"l AS (SELECT *, lag(close) {LAG} AS before FROM bars)") + """SELECT symbol, bar_idx, round(CASE WHEN before IS NOT NULL THEN greatest(before, close) END, 6) AS larger,
  round(CASE WHEN before IS NOT NULL THEN least(before, close) END, 6) AS smaller, before IS NULL AS is_na FROM l""")
def math_max_min_na(spark, sf):
    lagged = ind.lag_value(bars(spark, sf), "close", 1, "before")
    return ind.math_max_min_na(lagged, F.col("before"), F.col("close")).select(*ID, *r6("larger", "smaller"), "is_na")
