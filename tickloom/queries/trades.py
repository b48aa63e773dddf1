"""Queries of trades with stops and targets: entries at moving-average crosses on hourly bars."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import indicators as ind
from ..operators import trades as tr
from .base import BARS, LAG, bars, over, query, r6, stamp, strict, with_

H = 40
TS = "strftime({0}, '%Y-%m-%d %H:%M:%S')"


def setup(spark, sf):
    """Bars with a direction where two averages cross, and a simple range average as ``atr``."""
    own = ind.sma(ind.sma(bars(spark, sf), "close", 3, "f"), "close", 8, "s")
    own = ind.sma(ind.true_range(own, "_tr"), "_tr", 5, "atr").drop("_tr")
    own = ind.crossunder(ind.crossover(own, "f", "s", "up"), "f", "s", "down")
    return own.withColumn("direction", F.when(F.col("up"), "long").when(F.col("down"), "short"))


SETUP = f"""sx AS (SELECT *, {strict('avg', 'close', 3)} AS f, {strict('avg', 'close', 8)} AS s, CASE WHEN bar_idx = 0 THEN high - low ELSE greatest(high - low, abs(high - lag(close) {LAG}), abs(low - lag(close) {LAG})) END AS tr FROM bars),
sy AS (SELECT *, {strict('avg', 'tr', 5)} AS atr, CASE WHEN f > s AND lag(f) {LAG} <= lag(s) {LAG} THEN 'long' WHEN f < s AND lag(f) {LAG} >= lag(s) {LAG} THEN 'short' END AS direction FROM sx),
en AS (SELECT * FROM (SELECT symbol, bar_idx AS signal_bar, direction, atr AS entry_atr, lead(bar_idx) {LAG} AS entry_bar, lead(ts) {LAG} AS entry_time, lead(open) {LAG} AS entry_price FROM sy) WHERE direction IS NOT NULL AND entry_bar IS NOT NULL),
ex AS (SELECT *, CASE WHEN direction = 'short' THEN -1.0 ELSE 1.0 END AS side FROM en)"""


def path(levels: str, extra: str = "", horizon: int | None = None) -> str:
    """CTEs up to ``pt``: entries with levels, and each later bar, up to a horizon if there is one."""
    until = f" AND b.bar_idx <= e.entry_bar + {horizon}" if horizon else ""
    return f"""lv AS (SELECT *, {levels} FROM ex), pt AS (SELECT e.*, b.bar_idx AS at_bar, b.ts AS at_time, b.open AS o, b.high AS h, b.low AS l, b.close AS c, b.atr AS at_atr{extra}
  FROM lv e JOIN sy b ON b.symbol = e.symbol AND b.bar_idx > e.entry_bar{until})"""


FIRST = "SELECT symbol, signal_bar, first(at_bar ORDER BY at_bar) AS xbar, first(at_time ORDER BY at_bar) AS xtime, first(price ORDER BY at_bar) AS xprice, first(reason ORDER BY at_bar) AS xreason, {0} AS at_open FROM hit GROUP BY symbol, signal_bar"

def closed(horizon: int | None = None) -> str:
    late = f"e.entry_bar + {horizon}" if horizon else "NULL"
    return f"""cl AS (SELECT e.*, CASE WHEN x.signal_bar IS NOT NULL THEN x.xbar ELSE z.bar_idx END AS exit_bar, CASE WHEN x.signal_bar IS NOT NULL THEN x.xtime ELSE z.ts END AS exit_time,
  CASE WHEN x.signal_bar IS NOT NULL THEN x.xprice ELSE z.close END AS exit_price, CASE WHEN x.signal_bar IS NOT NULL THEN x.xreason WHEN z.bar_idx IS NOT NULL THEN 'Time' ELSE 'Open' END AS exit_signal, coalesce(x.at_open, false) AS fills_at_open
  FROM lv e LEFT JOIN fx x ON x.symbol = e.symbol AND x.signal_bar = e.signal_bar LEFT JOIN sy z ON z.symbol = e.symbol AND z.bar_idx = {late})"""


CLOSED = closed()

SHOWN = f"symbol, signal_bar, direction, entry_bar, {TS.format('entry_time')} AS entry_time, round(entry_price, 6) AS entry_price, exit_bar, {TS.format('exit_time')} AS exit_time, round(exit_price, 6) AS exit_price, exit_signal"


def shown(df):
    return df.select("symbol", "signal_bar", "direction", "entry_bar", stamp("entry_time"), *r6("entry_price"), "exit_bar", stamp("exit_time"), *r6("exit_price"), "exit_signal")


@query(with_(BARS, "hole AS (SELECT * REPLACE (CASE WHEN bar_idx % 9 = 4 THEN NULL ELSE low END AS low) FROM bars)") + "SELECT symbol, bar_idx, round(close, 6) AS close FROM hole WHERE low IS NOT NULL")
def skip_invalid_bars(spark, sf):
    own = bars(spark, sf).withColumn("low", F.when(F.col("bar_idx") % 9 != 4, F.col("low")))
    return tr.skip_invalid_bars(own).select("symbol", "bar_idx", *r6("close"))


@query(with_(BARS, SETUP) + f"SELECT symbol, signal_bar, direction, entry_bar, {TS.format('entry_time')} AS entry_time, round(entry_price, 6) AS entry_price, round(entry_atr, 6) AS entry_atr FROM en")
def candidate_entries(spark, sf):
    return tr.candidate_entries(setup(spark, sf), atr="atr").select("symbol", "signal_bar", "direction", "entry_bar", stamp("entry_time"), *r6("entry_price", "entry_atr"))


ATR_LEVELS = "CASE WHEN entry_atr > 0 THEN entry_price - side * entry_atr * 0.8 END AS stop_price, CASE WHEN entry_atr > 0 THEN entry_price + side * entry_atr * 1.0 END AS target_price"
PCT_LEVELS = "entry_price * (1 - side * 40.0 / 100.0) AS stop_price, entry_price * (1 + side * 60.0 / 100.0) AS target_price"


@query(with_(BARS, SETUP, f"lv AS (SELECT *, {ATR_LEVELS} FROM ex)") + "SELECT symbol, signal_bar, round(stop_price, 6) AS stop_price, round(target_price, 6) AS target_price FROM lv")
def initial_levels(spark, sf):
    entries = tr.candidate_entries(setup(spark, sf), atr="atr")
    return tr.initial_levels(entries, sl_atr=0.8, tp_atr=1.0).select("symbol", "signal_bar", *r6("stop_price", "target_price"))


def touched(stop: str, target: str, horizon: int | None = None) -> str:
    return f"""tl AS (SELECT *, {stop} AS sp, {target} AS tp FROM pt),
tt AS (SELECT *, coalesce(CASE WHEN side > 0 THEN least(o, l) <= sp ELSE greatest(o, h) >= sp END, false) AS st, coalesce(CASE WHEN side > 0 THEN greatest(o, h) >= tp ELSE least(o, l) <= tp END, false) AS ta FROM tl),
tk AS (SELECT *, st AND (NOT ta OR c < o) AS stops FROM tt WHERE st OR ta),
hit AS (SELECT *, CASE WHEN stops THEN CASE WHEN side > 0 THEN least(o, sp) ELSE greatest(o, sp) END ELSE CASE WHEN side > 0 THEN greatest(o, tp) ELSE least(o, tp) END END AS price, CASE WHEN stops THEN 'SL' ELSE 'PT' END AS reason FROM tk),
fx AS ({FIRST.format('false')}), {closed(horizon)}"""


DYNAMIC = (BARS, SETUP, path(ATR_LEVELS), touched("CASE WHEN at_atr > 0 THEN entry_price - side * at_atr * 0.8 ELSE stop_price END", "CASE WHEN at_atr > 0 THEN entry_price + side * at_atr * 1.0 ELSE target_price END"))
STATIC = (BARS, SETUP, path(PCT_LEVELS), touched("stop_price", "target_price"))


def dynamic(spark, sf):
    own = setup(spark, sf)
    return own, tr.first_touch_exit(tr.initial_levels(tr.candidate_entries(own, atr="atr"), sl_atr=0.8, tp_atr=1.0), own, None, 0.8, 1.0)


def static(spark, sf):
    own = setup(spark, sf)
    return own, tr.first_touch_exit(tr.initial_levels(tr.candidate_entries(own), stop_pct=40.0, target_pct=60.0), own, static_stop=True)


@query(with_(*DYNAMIC) + f"SELECT {SHOWN} FROM cl")
def first_touch_exit(spark, sf):
    return shown(dynamic(spark, sf)[1])


@query(with_(*STATIC) + f"SELECT {SHOWN} FROM cl")
def first_touch_exit_pct(spark, sf):
    return shown(static(spark, sf)[1])


@query(with_(BARS, SETUP, path(PCT_LEVELS, horizon=H), touched("stop_price", "target_price", H)) + f"SELECT {SHOWN} FROM cl")
def time_exit(spark, sf):
    """The same with a time exit after 40 bars."""
    own = setup(spark, sf)
    return shown(tr.first_touch_exit(tr.initial_levels(tr.candidate_entries(own), stop_pct=40.0, target_pct=60.0), own, H, static_stop=True))


RUN = "OVER (PARTITION BY symbol, signal_bar ORDER BY at_bar ROWS UNBOUNDED PRECEDING)"


@query(with_(BARS, SETUP, "ex2 AS (SELECT e.*, b.high AS h0, b.low AS l0, b.close AS c0 FROM ex e JOIN sy b ON b.symbol = e.symbol AND b.bar_idx = e.entry_bar)", path("1 AS one").replace("FROM ex)", "FROM ex2)"),
    f"tg AS (SELECT *, greatest(max(h) {RUN}, h0, entry_price) AS top, least(min(l) {RUN}, l0, entry_price) AS bot, max(CASE WHEN side > 0 THEN h >= entry_price * (1 + 10.0 / 100.0) ELSE l <= entry_price * (1 - 10.0 / 100.0) END) {RUN} AS active FROM pt)",
    "th AS (SELECT *, CASE WHEN active THEN CASE WHEN side > 0 THEN top * (1 - 5.0 / 100.0) ELSE bot * (1 + 5.0 / 100.0) END END AS trail FROM tg)",
    "hit AS (SELECT *, CASE WHEN side > 0 THEN least(o, trail) ELSE greatest(o, trail) END AS price, 'Trail' AS reason FROM th WHERE CASE WHEN side > 0 THEN least(o, l) <= trail ELSE greatest(o, h) >= trail END)",
    f"fx AS ({FIRST.format('false')})", CLOSED) + f"SELECT {SHOWN} FROM cl")
def trailing_exit(spark, sf):
    own = setup(spark, sf)
    return shown(tr.trailing_exit(tr.candidate_entries(own), own, 10.0, 5.0))


NEXT_OPEN = """q AS (SELECT h.symbol, h.signal_bar, h.at_bar + 1 AS qbar, h.reason FROM (SELECT symbol, signal_bar, min(at_bar) AS at_bar, first(reason ORDER BY at_bar) AS reason FROM hit GROUP BY symbol, signal_bar) h),
fx AS (SELECT q.symbol, q.signal_bar, b.bar_idx AS xbar, b.ts AS xtime, b.open AS xprice, CASE WHEN b.open IS NULL THEN 'Open' ELSE q.reason END AS xreason, true AS at_open FROM q LEFT JOIN sy b ON b.symbol = q.symbol AND b.bar_idx = q.qbar)"""


@query(with_(BARS, SETUP, "ex2 AS (SELECT e.*, b.close AS c0 FROM ex e JOIN sy b ON b.symbol = e.symbol AND b.bar_idx = e.entry_bar)",
    f"sz AS (SELECT *, lag(f) {LAG} AS f1 FROM sy)", path("1 AS one", ", b.f AS osc, b.f1 AS osc1").replace("FROM ex)", "FROM ex2)").replace("JOIN sy b", "JOIN sz b"),
    f"tg AS (SELECT *, greatest(max(c) {RUN}, c0, entry_price) AS best, max((c - entry_price) / entry_price * 100 >= 20.0) {RUN} AS active FROM pt)",
    "th AS (SELECT *, CASE WHEN side > 0 AND c <= entry_price * (1 - 50.0 / 100.0) THEN 'SL' WHEN side > 0 AND active AND c <= best * (1 - 30.0 / 100.0) THEN 'Trail' WHEN osc1 >= 60.0 AND osc < 60.0 THEN 'OB' END AS reason FROM tg)",
    "hit AS (SELECT * FROM th WHERE reason IS NOT NULL)", NEXT_OPEN, CLOSED) + f"SELECT {SHOWN} FROM cl")
def close_signal_exit(spark, sf):
    own = setup(spark, sf)
    return shown(tr.close_signal_exit(tr.candidate_entries(own), own, 50.0, 20.0, 30.0, "f", 60.0))


@query(with_(BARS, SETUP, path("1 AS one"), "hit AS (SELECT *, 'Signal' AS reason FROM pt WHERE c > 2 * o)", NEXT_OPEN, CLOSED) + f"SELECT {SHOWN} FROM cl")
def custom_exit(spark, sf):
    own = setup(spark, sf).withColumn("leaves", F.col("close") > 2 * F.col("open"))
    return shown(tr.custom_exit(tr.candidate_entries(own), own, "leaves"))


#: A recursive query walks from each trade taken to the first candidate that may follow it.
TAKEN = """RECURSIVE fr AS (SELECT *, CASE WHEN exit_bar IS NULL THEN 4611686018427387904 WHEN fills_at_open THEN exit_bar ELSE exit_bar + 1 END AS free FROM cl),
go AS (SELECT symbol, signal_bar, free FROM fr WHERE signal_bar = (SELECT min(f2.signal_bar) FROM fr f2 WHERE f2.symbol = fr.symbol)
  UNION ALL SELECT x.symbol, x.signal_bar, x.free FROM go JOIN fr x ON x.symbol = go.symbol AND x.signal_bar = (SELECT min(f3.signal_bar) FROM fr f3 WHERE f3.symbol = go.symbol AND f3.signal_bar >= go.free)),
rt AS (SELECT cl.* FROM cl JOIN go ON go.symbol = cl.symbol AND go.signal_bar = cl.signal_bar)"""


def recursive(*ctes: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(c.removeprefix("RECURSIVE ") for c in ctes) + "\n"


@query(recursive(*STATIC, TAKEN) + f"SELECT {SHOWN} FROM rt")
def resolve_overlaps(spark, sf):
    return shown(tr.resolve_overlaps(static(spark, sf)[1]))


EXCURSIONS = """SELECT t.symbol, t.signal_bar, round(greatest(0.0, max(CASE WHEN side > 0 THEN (high - entry_price) / entry_price * 100 ELSE (entry_price - low) / entry_price * 100 END)), 6) AS mfe_pct,
  round(greatest(0.0, max(CASE WHEN side > 0 THEN (entry_price - low) / entry_price * 100 ELSE (high - entry_price) / entry_price * 100 END)), 6) AS mae_pct, count(*) AS bars_in_trade
FROM rt t JOIN sy b ON b.symbol = t.symbol AND b.bar_idx BETWEEN t.entry_bar AND t.exit_bar WHERE t.exit_bar IS NOT NULL GROUP BY t.symbol, t.signal_bar"""


@query(recursive(*STATIC, TAKEN) + EXCURSIONS)
def excursions(spark, sf):
    own, found = static(spark, sf)
    taken = tr.resolve_overlaps(found).filter("exit_bar IS NOT NULL")
    return tr.excursions(taken, own).select("symbol", "signal_bar", *r6("mfe_pct", "mae_pct"), "bars_in_trade")


#: Cash after each trade: a recursive query over the trades of a symbol in order.
SIZED = """nr AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_bar) AS k FROM rt),
ca AS (SELECT symbol, 0::BIGINT AS k, 10000.0::DOUBLE AS cash, 0::BIGINT AS qty, NULL::DOUBLE AS fees, NULL::DOUBLE AS pnl FROM nr GROUP BY symbol
  UNION ALL SELECT symbol, k, cash + CASE WHEN qty > 0 THEN coalesce(pnl, 0) ELSE 0 END, qty, fees, pnl FROM (
    SELECT n.symbol, n.k, ca.cash, floor(ca.cash * 0.5 / n.entry_price)::BIGINT AS qty,
      (floor(ca.cash * 0.5 / n.entry_price) * n.entry_price + coalesce(floor(ca.cash * 0.5 / n.entry_price) * n.exit_price, 0.0)) * 0.001 AS fees,
      n.side * (floor(ca.cash * 0.5 / n.entry_price) * n.exit_price - floor(ca.cash * 0.5 / n.entry_price) * n.entry_price) - (floor(ca.cash * 0.5 / n.entry_price) * n.entry_price + coalesce(floor(ca.cash * 0.5 / n.entry_price) * n.exit_price, 0.0)) * 0.001 AS pnl
    FROM ca JOIN nr n ON n.symbol = ca.symbol AND n.k = ca.k + 1)),
sd AS (SELECT nr.*, ca.cash AS cash_after, ca.qty, ca.fees, ca.pnl, row_number() OVER (PARTITION BY nr.symbol ORDER BY nr.entry_bar) AS trade_id FROM nr JOIN ca ON ca.symbol = nr.symbol AND ca.k = nr.k WHERE ca.qty > 0)"""


def sized(spark, sf):
    own, found = static(spark, sf)
    return own, tr.size_and_pnl(tr.resolve_overlaps(found), 10_000.0, 50.0, 0.1)


@query(recursive(*STATIC, TAKEN, SIZED) + """SELECT symbol, trade_id, entry_bar, exit_bar, qty, round(qty * entry_price, 4) AS entry_value, round(fees, 4) AS commission, round(pnl, 4) AS pnl, round(pnl / (qty * entry_price) * 100, 4) AS pnl_pct, round(cash_after, 4) AS cash_after FROM sd""")
def size_and_pnl(spark, sf):
    four = [F.round(c, 4).alias(c) for c in ("entry_value", "commission", "pnl", "pnl_pct", "cash_after")]
    return sized(spark, sf)[1].select("symbol", "trade_id", "entry_bar", "exit_bar", "qty", *four)


@query(recursive(*STATIC, TAKEN, SIZED, f"""mm AS (SELECT b.symbol, b.bar_idx, coalesce(last_value(p.cash_after IGNORE NULLS) OVER (PARTITION BY b.symbol ORDER BY b.bar_idx ROWS UNBOUNDED PRECEDING), 10000.0)
    + coalesce(t.qty * t.side * (b.close - t.entry_price) - t.qty * t.entry_price * 0.001, 0.0) AS equity
  FROM sy b LEFT JOIN sd t ON t.symbol = b.symbol AND b.bar_idx >= t.entry_bar AND b.bar_idx < coalesce(t.exit_bar, 1000000000) LEFT JOIN sd p ON p.symbol = b.symbol AND p.exit_bar = b.bar_idx)""")
    + f"SELECT symbol, bar_idx, round(equity, 4) AS equity, round(greatest(max(equity) {over()}, 10000.0), 4) AS peak, round(greatest(max(equity) {over()}, 10000.0) - equity, 4) AS drawdown FROM mm")
def mark_to_market(spark, sf):
    own, trades = sized(spark, sf)
    return tr.mark_to_market(trades, own, 10_000.0, 0.1).select("symbol", "bar_idx", *[F.round(c, 4).alias(c) for c in ("equity", "peak", "drawdown")])
