"""Queries of signals, returns, metrics and signal trades."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import returns as ret
from ..operators import signals as sig
from .base import BARS, LAG, bars, brand_bars, ewm, over, query, r6, stamp, strict, with_
from .indicators import CHANGE, OSC, RSI_ROLLING, TR, J, macd_ctes, rsi_value

ID = ("symbol", "bar_idx")


def held(source: str, raw: str, name: str = "sg", extra: str = "") -> str:
    """CTE ``name``: the last decision carried forward."""
    return f"{name} AS (SELECT *, coalesce(last_value(raw IGNORE NULLS) {over()}, 0)::INTEGER AS held FROM (SELECT *, {raw} AS raw{extra} FROM {source}))"


SHOW = "SELECT symbol, bar_idx, held AS signal FROM sg"


def donchian(source: str = "bars", n: int = 20, name: str = "sg") -> str:
    hi, lo, full = (f"{f} {over(n, 1)}" for f in ("max(close)", "min(close)", "count(close)"))
    return f"""{name}_c AS (SELECT *, CASE WHEN {full} = {n} THEN {hi} END AS hi, CASE WHEN {full} = {n} THEN {lo} END AS lo FROM {source}),
{name}_h AS (SELECT *, last_value(CASE WHEN close >= hi THEN 1 WHEN close <= lo THEN -1 END IGNORE NULLS) {over()} AS h FROM {name}_c),
{name} AS (SELECT *, CASE WHEN hi IS NOT NULL THEN coalesce(h, 0) ELSE 0 END::INTEGER AS signal FROM {name}_h)"""


@query(with_(BARS, donchian()) + "SELECT symbol, bar_idx, signal FROM sg")
def sig_donchian(spark, sf):
    return sig.sig_donchian(bars(spark, sf), 20).select(*ID, "signal")


def pair(fast: int, slow: int) -> tuple[str, ...]:
    return (
        ewm("ef", "bars", "close", f"(2.0 / {fast + 1})", fast, "first"), ewm("es", "bars", "close", f"(2.0 / {slow + 1})", slow, "first"),
        f"pr AS (SELECT b.*, ef.y AS f, es.y AS s FROM bars b {J.format('ef')} {J.format('es')})", f"pl AS (SELECT *, lag(f) {LAG} AS f1, lag(s) {LAG} AS s1 FROM pr)",
    )


@query(with_(BARS, *pair(12, 26)[:2], f"pr AS (SELECT b.*, CASE WHEN b.bar_idx >= 11 THEN ef.y END AS f, CASE WHEN b.bar_idx >= 25 THEN es.y END AS s FROM bars b {J.format('ef')} {J.format('es')})",
    pair(12, 26)[3], held("pl", "CASE WHEN f > s AND f1 <= s1 THEN 1 WHEN f < s AND f1 >= s1 THEN 0 END")) + "SELECT symbol, bar_idx, CASE WHEN f IS NULL OR s IS NULL THEN 0 ELSE held END::INTEGER AS signal FROM sg")
def sig_ema_long_flat(spark, sf):
    return sig.sig_ema_long_flat(bars(spark, sf)).select(*ID, "signal")


RSI_FIRST = (CHANGE, ewm("ag", "gl", "g0", "(1.0 / 14)", 14, "first"), ewm("al", "gl", "l0", "(1.0 / 14)", 14, "first"))
TREND = f"tr_ AS (SELECT b.*, {rsi_value('ag.y', 'al.y', 'NULL')} AS r FROM pl b {J.format('ag')} {J.format('al')}), tl AS (SELECT *, lag(r) {LAG} AS r1 FROM tr_)"
PULL = "CASE WHEN f > s AND r > 45 AND r1 <= 45 THEN 1 WHEN f < s AND r < 55 AND r1 >= 55 THEN -1 END"


@query(with_(BARS, *pair(20, 50), *RSI_FIRST, TREND, held("tl", PULL)) + "SELECT symbol, bar_idx, CASE WHEN bar_idx < 50 THEN 0 ELSE held END::INTEGER AS signal FROM sg")
def sig_trend_rsi(spark, sf):
    return sig.sig_trend_rsi(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, f"hl AS (SELECT *, {strict('max', 'high', 20)} AS hi, {strict('min', 'low', 20)} AS lo FROM bars)", held("hl", "CASE WHEN close < lo THEN -1 WHEN close > hi THEN 1 END")) + SHOW)
def sig_hl_breakout(spark, sf):
    return sig.sig_hl_breakout(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, *pair(10, 30), held("pl", "CASE WHEN f < s AND f1 >= s1 THEN -1 WHEN f > s AND f1 <= s1 THEN 1 END")) + SHOW)
def sig_ema_reverse(spark, sf):
    return sig.sig_ema_reverse(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, *macd_ctes("first")[:3], f"ml AS (SELECT *, lag(macd) {LAG} AS m1 FROM md)", held("ml", "CASE WHEN macd < 0 AND m1 >= 0 THEN -1 WHEN macd > 0 AND m1 <= 0 THEN 1 END")) + SHOW)
def sig_macd_zero(spark, sf):
    return sig.sig_macd_zero(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, RSI_ROLLING, f"rl AS (SELECT *, lag(rsi) {LAG} AS r1 FROM (SELECT * REPLACE (CASE WHEN ag IS NOT NULL THEN rsi END AS rsi) FROM rsi))", held("rl", "CASE WHEN rsi < 70 AND r1 >= 70 THEN -1 WHEN rsi > 30 AND r1 <= 30 THEN 1 END")) + SHOW)
def sig_rsi_levels(spark, sf):
    return sig.sig_rsi_levels(bars(spark, sf)).select(*ID, "signal")


ROLLING_TREND = (RSI_ROLLING, f"tr_ AS (SELECT b.*, CASE WHEN rsi.ag IS NOT NULL THEN rsi.rsi END AS r FROM pl b {J.format('rsi')}), tl AS (SELECT *, lag(r) {LAG} AS r1 FROM tr_)")


@query(with_(BARS, *pair(20, 50), *ROLLING_TREND, held("tl", PULL)) + SHOW)
def sig_trend_rsi_rolling(spark, sf):
    return sig.sig_trend_rsi_rolling(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, *pair(20, 50), *ROLLING_TREND, held("tl", "CASE WHEN f < s AND r < 55 THEN -1 WHEN f > s AND r > 45 AND r < 70 THEN 1 END")) + SHOW)
def sig_trend_rsi_band(spark, sf):
    return sig.sig_trend_rsi_band(bars(spark, sf), use_shorts=True).select(*ID, "signal")


OSC_FIRST = (
    TR, ewm("qa", "tr", "tr", "(1.0 / 14)", 14, "first"), ewm("qp", "bars", "close", "(2.0 / 22)", 21, "first"),
    f"qd AS (SELECT b.symbol, b.bar_idx, CASE WHEN qa.y <> 0 THEN (b.close - qp.y) / (3.0 * qa.y) * 100 END AS d FROM bars b {J.format('qa')} {J.format('qp')})",
    ewm("qo", "qd", "d", "0.5", 3, "first"), f"ql AS (SELECT b.*, qo.y AS o, lag(qo.y) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS o1 FROM bars b {J.format('qo')})",
)


@query(with_(BARS, *OSC_FIRST, held("ql", "CASE WHEN (o1 <= -50 AND o > -50) OR (o1 <= -100 AND o > -100) THEN 1 END")) + SHOW)
def sig_oscillator(spark, sf):
    return sig.sig_oscillator(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, f"sm AS (SELECT *, {strict('avg', 'close', 10)} AS f, {strict('avg', 'close', 30)} AS s FROM bars)") + "SELECT symbol, bar_idx, CASE WHEN f > s THEN 1 WHEN f < s THEN -1 ELSE 0 END AS signal FROM sm")
def sig_sma_cross(spark, sf):
    return sig.sig_sma_cross(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, f"rt AS (SELECT *, ln(close / lag(close) {LAG}) AS r FROM bars)") + f"SELECT symbol, bar_idx, coalesce(sign({strict('avg', 'r', 10)}), 0)::INTEGER AS signal FROM rt")
def sig_momentum_sign(spark, sf):
    return sig.sig_momentum_sign(bars(spark, sf)).select(*ID, "signal")


@query(with_(BARS, f"sm AS (SELECT *, {strict('avg', 'close', 5)} AS f, {strict('avg', 'close', 20)} AS s FROM bars)", held("sm", "nullif(CASE WHEN close > 100 THEN 0 WHEN f < s THEN -1 WHEN f > s THEN 1 END, 0)")) + SHOW)
def combine_hold(spark, sf):
    both = ind.sma(ind.sma(bars(spark, sf), "close", 5, "f"), "close", 20, "s")
    return sig.combine_hold(both, [(F.col("f") > F.col("s"), 1), (F.col("f") < F.col("s"), -1), (F.col("close") > 100, 0)]).select(*ID, "signal")


FILTERS = (
    f"fm AS (SELECT *, {strict('avg', 'close', 5)} AS f, {strict('avg', 'close', 20)} AS s, {strict('avg', 'close', 50)} AS lv FROM bars)", RSI_ROLLING,
    f"fi AS (SELECT b.*, CASE WHEN rsi.ag IS NOT NULL THEN rsi.rsi END AS r FROM fm b {J.format('rsi')})",
)


@query(with_(BARS, *FILTERS) + """SELECT symbol, bar_idx, CASE WHEN bar_idx < 1 OR f IS NULL OR s IS NULL OR r IS NULL THEN NULL
  WHEN f > s AND coalesce(close >= lv, true) AND r > 40 AND r < 80 THEN 'long' WHEN f < s AND r < 60 THEN 'short' END AS direction FROM fi""")
def entry_filters(spark, sf):
    own = ind.rsi(ind.sma(ind.sma(ind.sma(bars(spark, sf), "close", 5, "f"), "close", 20, "s"), "close", 50, "lv"), "close", 14, "rsi", "rolling")
    return sig.entry_filters(own, ema_pair=("f", "s"), ema_level="lv", rsi_band=(40.0, 80.0), shorts=True).select(*ID, "direction")


OSC_LAG = f"ol AS (SELECT b.*, os.y AS o, lag(os.y) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx) AS o1, {strict('avg', 'b.close', 50).replace('symbol', 'b.symbol').replace('bar_idx', 'b.bar_idx')} AS lv FROM bars b {J.format('os')})"


@query(with_(BARS, *OSC, OSC_LAG) + "SELECT symbol, bar_idx, CASE WHEN o1 <= -10 AND o > -10 AND coalesce(close >= lv, true) THEN 'long' END AS direction FROM ol")
def entry_oscillator(spark, sf):
    own = ind.sma(ind.atr_oscillator(bars(spark, sf)), "close", 50, "lv")
    return sig.entry_oscillator(own, -10.0, ema_level="lv").select(*ID, "direction")


@query(with_(BARS, *OSC, OSC_LAG) + f"SELECT symbol, bar_idx, coalesce(o1 <= -10 AND o > -10 AND min(o) {over(10, 1)} <= -25, false) AS extreme_entry FROM ol")
def extreme_lookback(spark, sf):
    return sig.extreme_lookback(ind.atr_oscillator(bars(spark, sf)), -10.0, -25.0).select(*ID, "extreme_entry")


@query(with_(BARS, donchian()) + "SELECT symbol, count(*) FILTER (signal > 0) AS n_long, count(*) FILTER (signal < 0) AS n_short, count(*) FILTER (signal = 0) AS n_flat FROM sg GROUP BY symbol")
def signal_counts(spark, sf):
    return sig.signal_counts(sig.sig_donchian(bars(spark, sf)))


def returns_ctes(commission: float = 0.0, source: str = "sg", signal: str = "signal", part: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY bar_idx)"
    cost = f" - abs(active - was) * {commission}" if commission else ""
    return f"""ac AS (SELECT *, coalesce(lag({signal}) {w}, 0)::DOUBLE AS active FROM {source}),
ad_ AS (SELECT *, lag(active) {w} AS was, lag(close) {w} AS prev FROM ac),
br AS (SELECT *, CASE WHEN was IS NULL OR was <> active THEN (close - open) / open ELSE close / prev - 1 END AS bar_return FROM ad_),
rs AS (SELECT *, active * bar_return{cost} AS r FROM br),
eq AS (SELECT *, exp(sum(ln(1 + coalesce(r, 0))) OVER (PARTITION BY {part} ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)) AS equity FROM rs)"""


DONCHIAN = (BARS, donchian())


# At these prices a return can be below -1, so the logarithm above would fail; the product needs its sign.
def equity_cte(part: str = "symbol") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"
    return f"eq AS (SELECT *, product(1 + coalesce(r, 0)) {w} AS equity FROM rs)"


def returns_sql(commission: float = 0.0, source: str = "sg", part: str = "symbol") -> tuple[str, str]:
    body = returns_ctes(commission, source, "signal", part)
    return body[: body.index("eq AS (")].rstrip().rstrip(","), equity_cte(part)


RETURNS = (*DONCHIAN, *returns_sql())


def run(spark, sf, commission=0.0):
    return ret.bar_returns(sig.sig_donchian(bars(spark, sf)), commission=commission)


@query(with_(*DONCHIAN, *returns_sql(0.001)) + "SELECT symbol, bar_idx, active + 0.0 AS active, round(bar_return, 6) + 0.0 AS bar_return, round(r, 6) + 0.0 AS strategy_return FROM eq")
def bar_returns(spark, sf):
    return run(spark, sf, 0.001).select(*ID, "active", *r6("bar_return", "strategy_return"))


SMALL = (BARS, donchian(), returns_sql()[0].replace("active * bar_return AS r", "active * bar_return * 0.01 AS r"), equity_cte())


def small(spark, sf):
    """Returns a hundredth as large: those of the events are too wild for a curve."""
    return run(spark, sf).withColumn("strategy_return", F.col("strategy_return") * 0.01)


@query(with_(*SMALL) + "SELECT symbol, bar_idx, round(equity, 6) AS equity_curve FROM eq")
def equity_curve(spark, sf):
    return ret.equity_curve(small(spark, sf)).select(*ID, *r6("equity_curve"))


@query(with_(*SMALL) + f"SELECT symbol, bar_idx, round(exp(sum(coalesce(r, 0)) {over()}), 6) AS equity_log FROM eq")
def equity_log(spark, sf):
    return ret.equity_log(small(spark, sf)).select(*ID, *r6("equity_log"))


@query(with_(*SMALL) + f"SELECT symbol, bar_idx, round(100 * (equity - max(equity) {over()}) / max(equity) {over()}, 6) AS drawdown_pct FROM eq")
def drawdown_pct(spark, sf):
    return ret.drawdown_pct(ret.equity_curve(small(spark, sf))).select(*ID, *r6("drawdown_pct"))


def metrics_sql(part: str = "symbol", source: str = "eq") -> str:
    w = f"OVER (PARTITION BY {part} ORDER BY bar_idx ROWS UNBOUNDED PRECEDING)"
    return f"""SELECT {part}, round(CASE WHEN loss > 0 THEN gain / loss WHEN gain > 0 THEN NULL ELSE 0 END, 6) AS profit_factor, round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END, 6) AS sharpe_ratio,
  round(mdd, 6) AS max_drawdown, round(final - 1, 6) AS total_return, round(wins / n, 6) AS win_rate, round(CASE WHEN wins > 0 THEN gain / wins ELSE 0 END, 6) AS avg_win, round(CASE WHEN losses > 0 THEN -loss / losses ELSE 0 END, 6) AS avg_loss,
  num_trades, round(mean, 6) AS expectancy, round(CASE WHEN mdd > 0 THEN (CASE WHEN final > 0 THEN power(final, 252.0 / n) - 1 ELSE 0 END) / mdd ELSE 0 END, 6) AS calmar_ratio
FROM (SELECT {part}, count(r)::DOUBLE AS n, coalesce(sum(r) FILTER (r > 0), 0) AS gain, abs(coalesce(sum(r) FILTER (r < 0), 0)) AS loss, avg(r) AS mean, stddev_samp(r) AS sd, abs(min(dd)) AS mdd, last(equity ORDER BY bar_idx) AS final,
  (count(*) FILTER (r > 0))::DOUBLE AS wins, (count(*) FILTER (r < 0))::DOUBLE AS losses, count(*) FILTER (r <> 0) AS num_trades
  FROM (SELECT *, equity / max(equity) {w} - 1 AS dd FROM {source}) GROUP BY {part})"""


RATIOS = ("profit_factor", "sharpe_ratio", "max_drawdown", "total_return", "win_rate", "avg_win", "avg_loss", "expectancy", "calmar_ratio")


def shown_metrics(df, *key):
    """An infinite profit factor is shown as NULL."""
    finite = F.when(F.col("profit_factor") < float("inf"), F.round("profit_factor", 6)).alias("profit_factor")
    return df.select(*key, finite, *r6(*RATIOS[1:]), "num_trades")


@query(with_(*SMALL) + metrics_sql())
def metrics_bar(spark, sf):
    return shown_metrics(ret.metrics_bar(small(spark, sf)), "symbol")


def trades_sql(source: str = "sg", acting: str = "coalesce(lag(signal) OVER (PARTITION BY symbol ORDER BY bar_idx), 0)") -> str:
    return f"""tp AS (SELECT *, {acting} AS pos FROM {source}), tb AS (SELECT *, lag(pos) {LAG} AS before FROM tp),
tc AS (SELECT * FROM tb WHERE before IS NOT NULL AND before <> pos),
te AS (SELECT *, lead(ts) {LAG} AS exit_ts, lead(bar_idx) {LAG} AS exit_bar, lead(open) {LAG} AS exit_price FROM tc),
trades AS (SELECT symbol, CASE WHEN pos > 0 THEN 'LONG' ELSE 'SHORT' END AS direction, ts AS entry_ts, bar_idx AS entry_bar, open AS entry_price, exit_ts, exit_bar, exit_price,
  (exit_price / open - 1) * CASE WHEN pos > 0 THEN 1 ELSE -1 END * 100 AS pnl_pct, exit_bar - bar_idx AS bars_held, row_number() OVER (PARTITION BY symbol ORDER BY bar_idx) AS trade_id
  FROM te WHERE pos <> 0 AND exit_bar IS NOT NULL)"""


TRADE_COLUMNS = "symbol, trade_id, direction, strftime(entry_ts, '%Y-%m-%d %H:%M:%S') AS entry_time, entry_bar, round(entry_price, 6) AS entry_price, strftime(exit_ts, '%Y-%m-%d %H:%M:%S') AS exit_time, exit_bar, round(exit_price, 6) AS exit_price, round(pnl_pct, 6) AS pnl_pct, bars_held"


def shown_trades(df):
    return df.select("symbol", "trade_id", "direction", stamp("entry_time"), "entry_bar", *r6("entry_price"), stamp("exit_time"), "exit_bar", *r6("exit_price", "pnl_pct"), "bars_held")


@query(with_(*DONCHIAN, trades_sql()) + f"SELECT {TRADE_COLUMNS} FROM trades")
def trades_from_signals(spark, sf):
    return shown_trades(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))))


@query(with_(*DONCHIAN, trades_sql(acting="signal")) + f"SELECT {TRADE_COLUMNS} FROM trades")
def trades_from_signals_legacy(spark, sf):
    return shown_trades(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf)), fill="legacy"))


@query(with_(*DONCHIAN, trades_sql()) + """SELECT symbol, count(*) AS total_trades, count(*) FILTER (pnl_pct > 0) AS winning_trades, count(*) FILTER (pnl_pct <= 0) AS losing_trades, round(sum(pnl_pct), 6) AS total_pnl, round(avg(pnl_pct), 6) AS avg_pnl,
  round(coalesce(avg(pnl_pct) FILTER (pnl_pct > 0), 0), 6) AS avg_winner, round(coalesce(avg(pnl_pct) FILTER (pnl_pct <= 0), 0), 6) AS avg_loser, round(100.0 * count(*) FILTER (pnl_pct > 0) / count(*), 6) AS win_rate,
  round(coalesce(sum(pnl_pct) FILTER (pnl_pct > 0), 0) / nullif(abs(sum(pnl_pct) FILTER (pnl_pct <= 0)), 0), 6) AS profit_factor FROM trades GROUP BY symbol""")
def trade_stats(spark, sf):
    found = ret.trade_stats(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))), "pnl_pct")
    pf = F.when(F.col("profit_factor") < float("inf"), F.round("profit_factor", 6)).alias("profit_factor")
    return found.select("symbol", "total_trades", "winning_trades", "losing_trades", *r6("total_pnl", "avg_pnl", "avg_winner", "avg_loser", "win_rate"), pf)


@query(with_(*SMALL, "cv AS (SELECT symbol, bar_idx, 10000 * equity AS e FROM eq)",
    f"cs AS (SELECT *, greatest(max(e) {over()}, 10000) - e AS dd, e / lag(e) {LAG} - 1 AS x FROM cv)",
    "cg AS (SELECT symbol, max(dd) AS mdd, avg(x) AS mean, stddev_pop(x) AS sd, stddev_pop(x) FILTER (x < -1e-12) AS down, count(*) AS n, first(e ORDER BY bar_idx) AS e0, last(e ORDER BY bar_idx) AS e1 FROM cs GROUP BY symbol)") + """SELECT symbol, round(mdd, 6) AS max_drawdown, round(mdd / 100, 6) AS max_drawdown_pct,
  round(CASE WHEN sd > 0 THEN mean / sd * sqrt(252) ELSE 0 END, 6) AS sharpe_ratio, round(CASE WHEN down > 0 THEN mean / down * sqrt(252) ELSE 0 END, 6) AS sortino_ratio, round(CASE WHEN mdd > 0 THEN (e1 / e0 - 1) * (252.0 / n) * 100 / (mdd / 100) ELSE 0 END, 6) AS calmar_ratio FROM cg""")  # fmt: skip
def risk_ratios(spark, sf):
    curve = ret.equity_curve(small(spark, sf)).select(*ID, (F.col("equity_curve") * 10000).alias("equity"))
    return ret.risk_ratios(curve, "equity", 10000.0).select("symbol", *r6("max_drawdown", "max_drawdown_pct", "sharpe_ratio", "sortino_ratio", "calmar_ratio"))


@query(with_(*DONCHIAN, trades_sql()) + """SELECT symbol, trade_id, CASE WHEN hour(entry_ts) = 0 AND minute(entry_ts) = 0 THEN strftime(entry_ts, '%Y-%m-%d') ELSE strftime(entry_ts, '%Y-%m-%d %H:%M') END AS entry_time,
  CASE WHEN hour(exit_ts) = 0 AND minute(exit_ts) = 0 THEN strftime(exit_ts, '%Y-%m-%d') ELSE strftime(exit_ts, '%Y-%m-%d %H:%M') END AS exit_time, round(entry_price, 2) AS entry_price, round(exit_price, 2) AS exit_price, bars_held FROM trades""")
def display_trades(spark, sf):
    return ret.display_trades(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf)))).select("symbol", "trade_id", "entry_time", "exit_time", "entry_price", "exit_price", "bars_held")


@query(with_(BARS, "lim AS (SELECT symbol, min(close) AS lo, max(close) AS hi FROM bars GROUP BY symbol)") + """SELECT symbol, bin, count(*) AS n, round(min(close), 6) AS least, round(max(close), 6) AS most
FROM (SELECT b.symbol, close, CASE WHEN hi > lo THEN least(floor((close - lo) / ((hi - lo) / 35)) + 1, 35) ELSE 1 END::INTEGER AS bin FROM bars b JOIN lim ON lim.symbol = b.symbol) GROUP BY ALL""")
def perm_histogram(spark, sf):
    found = ret.perm_histogram(bars(spark, sf).withColumnRenamed("close", "score"), "score", 35, ("symbol",))
    return found.select("symbol", "bin", "n", *r6("least", "most"))


BRAND = """bt AS (SELECT p_brand AS symbol, date_trunc('day', l_shipdate) AS ts, l_extendedprice / l_quantity AS price, (l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax) AS o
  FROM lineitem JOIN part ON l_partkey = p_partkey),
bb AS (SELECT symbol, ts, arg_min(price, o) AS open, max(price) AS high, min(price) AS low, arg_max(price, o) AS close FROM bt GROUP BY ALL),
bars AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY ts) - 1 AS bar_idx FROM bb)"""


@query(with_(BRAND, donchian(n=20), returns_sql()[0].replace("active * bar_return AS r", "active * bar_return * 0.01 AS r"), equity_cte()) + metrics_sql())
def metrics_brand(spark, sf):
    """The flagship chain over daily bars of every part brand."""
    found = ret.bar_returns(sig.sig_donchian(brand_bars(spark, sf))).withColumn("strategy_return", F.col("strategy_return") * 0.01)
    return shown_metrics(ret.metrics_bar(found), "symbol")
