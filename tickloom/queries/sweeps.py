"""Queries of grid search, permutation and walk-forward, with the breakout strategy on hourly bars."""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import signals as sig
from ..plans import sweep
from .base import BARS, bars, query, r6, table, with_
from .signals_returns import RATIOS, donchian, metrics_sql, returns_sql, shown_metrics

LOOKBACKS = (10, 20, 30)
PARAMS = [{"lookback": n} for n in LOOKBACKS]
TRAIN, STEP, DIGITS = 300, 100, 6
#: Permutations to look at one by one, and those of the tests: the operators' own numbers.
PERMS, IS_PERMS, WF_PERMS = 4, 1000, 200
LABEL = "CASE param_id WHEN 0 THEN 'lookback=10' WHEN 1 THEN 'lookback=20' ELSE 'lookback=30' END"


def renamed(sql: str, suffix: str) -> str:
    return re.sub(r"\b(ac|ad_|br|rs|eq)\b", rf"\1{suffix}", sql)


def swept(source: str, name: str) -> str:
    """CTEs up to ``{name}_all``: a series ``symbol`` for each series ``grp`` of the source and ``param_id``, with signals."""
    parts = [donchian(source, n, f"{name}{i}") for i, n in enumerate(LOOKBACKS)]
    rows = " UNION ALL ".join(f"SELECT symbol || '#{i}' AS symbol, symbol AS grp, {i} AS param_id, bar_idx, ts, open, close, signal FROM {name}{i}" for i in range(len(LOOKBACKS)))
    return ", ".join([*parts, f"{name}_all AS ({rows})"])


def factor(cte: str, group: str) -> str:
    gain, loss = "coalesce(sum(r) FILTER (r > 0), 0)", "abs(coalesce(sum(r) FILTER (r < 0), 0))"
    return f"SELECT {group}, CASE WHEN {loss} > 0 THEN round({gain} / {loss}, {DIGITS}) WHEN {gain} > 0 THEN 'inf'::DOUBLE ELSE 0 END AS score FROM {cte} GROUP BY {group}"


def searched(source: str, name: str) -> str:
    """CTEs up to ``{name}_best (grp, param_id, score)``."""
    steps = [renamed(x, name) for x in returns_sql(source=f"{name}_all")]
    return ", ".join([swept(source, name), steps[0], f"{name}_sc AS ({factor(f'rs{name}', 'grp, param_id')})",
        f"{name}_best AS (SELECT grp, param_id, score FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC, param_id) AS k FROM {name}_sc) WHERE k = 1)"])


def finite(c: str) -> str:
    return f"CASE WHEN {c} < 'inf'::DOUBLE THEN {c} END"


def shown(c: str, out: str | None = None):
    return F.when(F.abs(F.col(c)) < float("inf"), F.round(c, 6)).alias(out or c)


@query("""SELECT (rank_a * (SELECT count(DISTINCT o_orderpriority) FROM orders) + rank_b)::BIGINT AS param_id, a AS brand, b AS priority
FROM (SELECT a, row_number() OVER (ORDER BY a) - 1 AS rank_a FROM (SELECT DISTINCT p_brand AS a FROM part)), (SELECT b, row_number() OVER (ORDER BY b) - 1 AS rank_b FROM (SELECT DISTINCT o_orderpriority AS b FROM orders))""")
def expand_grid(spark, sf):
    return sweep.expand_grid({"brand": table(spark, sf, "part").select("p_brand"), "priority": table(spark, sf, "orders").select("o_orderpriority")})


@query(with_(BARS, searched("bars", "g")) + f"SELECT grp AS symbol, param_id, {finite('score')} AS score, {LABEL} AS params FROM g_best")
def grid_search(spark, sf):
    found = sweep.grid_search(bars(spark, sf), sig.sig_donchian, PARAMS, digits=DIGITS)
    return found.select("symbol", "param_id", shown("score"), "params")


def scoped(tag: str, *ctes: str) -> str:
    """The CTEs under names of their own, so that two studies fit into one statement."""
    text = ", ".join(ctes)
    names = set(re.findall(r"(\w+) AS \((?=SELECT|WITH|\s*SELECT)", text))
    return re.sub(rf"(?<![.'\w])({'|'.join(sorted(names, key=len, reverse=True))})(?=\W|$)", rf"\1{tag}", text)


def permuted(start: int, seed: int, real: bool = False, source: str = "bars", perms: int = PERMS) -> str:
    """CTEs up to ``pb``: permutations of ``bars`` (0: the bars), as series ``symbol``."""
    tail = f"bar_idx >= {start}"
    first = f"SELECT symbol || '@0' AS symbol, symbol AS grp, 0 AS perm_id, bar_idx, ts, open, high, low, close FROM {source} UNION ALL " if real else ""
    head = f" UNION ALL SELECT b.symbol || '@' || perm_id, b.symbol, perm_id, bar_idx, ts, open, high, low, close FROM {source} b, perms WHERE bar_idx < {start}" if start else ""
    return f"""perms AS (SELECT unnest(range(1, {perms + 1})) AS perm_id),
lg AS (SELECT *, ln(open) AS lo, ln(high) - ln(open) AS rh, ln(low) - ln(open) AS rl, ln(close) - ln(open) AS rc, ln(open) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY bar_idx) AS gap, max(bar_idx) OVER (PARTITION BY symbol) AS z FROM {source}),
sh AS (SELECT symbol, perm_id, rh, rl, rc, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY md5(concat_ws('|', {seed}, perm_id, 'bar', bar_idx))) - 1 AS pos FROM lg, perms WHERE {tail}),
gp AS (SELECT symbol, perm_id, gap, row_number() OVER (PARTITION BY symbol, perm_id ORDER BY md5(concat_ws('|', {seed}, perm_id, 'gap', bar_idx))) AS pos FROM lg, perms WHERE bar_idx > {start}),
jn AS (SELECT s.symbol, s.perm_id, s.pos, s.rh, s.rl, s.rc, gp.gap, lg.ts, lg.bar_idx, lg.z, lg.lo, lg.open AS real_open, lg.close AS real_close FROM sh s LEFT JOIN gp ON gp.symbol = s.symbol AND gp.perm_id = s.perm_id AND gp.pos = s.pos JOIN lg ON lg.symbol = s.symbol AND lg.bar_idx = s.pos + {start}),
st AS (SELECT *, CASE WHEN pos = 0 THEN lo ELSE lag(rc) OVER (PARTITION BY symbol, perm_id ORDER BY pos) + gap END AS step FROM jn),
cu AS (SELECT *, sum(step) OVER (PARTITION BY symbol, perm_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS ol FROM st),
oc AS (SELECT *, CASE WHEN pos = 0 THEN real_open ELSE exp(ol) END AS o, CASE WHEN bar_idx = z THEN real_close ELSE exp(ol + rc) END AS c FROM cu),
pb AS ({first}SELECT symbol || '@' || perm_id AS symbol, symbol AS grp, perm_id, bar_idx, ts, o AS open, greatest(exp(ol + rh), o, c) AS high, least(exp(ol + rl), o, c) AS low, c AS close FROM oc{head})"""


@query(with_(BARS, permuted(0, 7)) + "SELECT grp AS symbol, perm_id, bar_idx, round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close FROM pb")
def permute_bars(spark, sf):
    return sweep.permute_bars(bars(spark, sf), PERMS, 7).select("symbol", "perm_id", "bar_idx", *r6("open", "high", "low", "close"))


GRID = tuple(range(2, 66))


@query(with_(BARS, *[donchian("bars", n, f"d{n}") for n in GRID]) + " UNION ALL ".join(f"SELECT symbol, {i} AS param_id, count(*) AS n, sum(signal)::BIGINT AS total, sum(signal * bar_idx)::BIGINT AS placed FROM d{n} GROUP BY symbol" for i, n in enumerate(GRID)))
def grid_signals(spark, sf):
    """Signals of 64 lookbacks made together: their number, sum and places."""
    found = sweep.sweep(bars(spark, sf), sig.sig_donchian, [{"lookback": n} for n in GRID])
    return found.groupBy("symbol", "param_id").agg(F.count(F.lit(1)).alias("n"), F.sum("signal").alias("total"), F.sum(F.col("signal") * F.col("bar_idx")).alias("placed"))


@query(with_("sc AS (SELECT p_brand AS symbol, p_partkey AS k, p_retailprice AS s, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS perm_id FROM part)", "rl AS (SELECT symbol, s AS real_score FROM sc WHERE perm_id = 0)")
    + """SELECT sc.symbol, any_value(real_score) AS real_score, count(*) - 1 AS n_perms, round((1 + count(*) FILTER (perm_id > 0 AND s >= real_score)) / count(*)::DOUBLE, 6) AS p_value,
  (1 + count(*) FILTER (perm_id > 0 AND s >= real_score)) / count(*)::DOUBLE < 0.05 AS passed FROM sc JOIN rl ON rl.symbol = sc.symbol GROUP BY sc.symbol""")  # fmt: skip
def p_value(spark, sf):
    part = table(spark, sf, "part").select(F.col("p_brand").alias("symbol"), F.col("p_retailprice").alias("score"), "p_partkey")
    numbered = part.withColumn("perm_id", F.row_number().over(Window.partitionBy("symbol").orderBy("p_partkey")) - 1)
    return sweep.p_value(numbered).withColumn("p_value", F.round("p_value", 6))


def tested(scores_cte: str) -> str:
    """Rows of a permutation test out of ``(grp, perm_id, score)``."""
    return f"""SELECT s.grp AS symbol, {finite('max(r.score)')} AS real_score, count(*) FILTER (s.perm_id > 0) AS n_perms, round((1 + count(*) FILTER (s.perm_id > 0 AND s.score >= r.score)) / count(*)::DOUBLE, 6) AS p_value
FROM {scores_cte} s JOIN {scores_cte} r ON r.grp = s.grp AND r.perm_id = 0 GROUP BY s.grp"""


def is_test(source: str = "bars") -> tuple[str, ...]:
    best = "ib AS (SELECT pb.grp, pb.perm_id, any_value(i_best.score) AS score, any_value(i_best.param_id) AS param_id FROM i_best JOIN (SELECT DISTINCT symbol, grp, perm_id FROM pb) pb ON pb.symbol = i_best.grp GROUP BY pb.grp, pb.perm_id)"
    return permuted(0, 7, True, source, IS_PERMS), searched("pb", "i"), best


IS_TEST = is_test()


def is_test_rows(df):
    return df.select("symbol", shown("real_score"), "n_perms", F.round("p_value", 6).alias("p_value"))


@query(with_(BARS, *IS_TEST) + tested("ib"))
def is_perm_test(spark, sf):
    return is_test_rows(sweep.is_perm_test(bars(spark, sf), sig.sig_donchian, PARAMS, IS_PERMS, digits=DIGITS))


def folds(source: str = "bars") -> str:
    return f"""nn AS (SELECT symbol, count(*) AS n FROM {source} GROUP BY symbol),
fd AS (SELECT symbol, unnest(range(0, ceil((n - {TRAIN}) / {STEP}.0)::BIGINT)) AS fold_id FROM nn WHERE n > {TRAIN}),
fb AS (SELECT b.symbol || '%' || fold_id AS symbol, b.symbol AS whole_symbol, fold_id, b.bar_idx - fold_id * {STEP} AS bar_idx, b.bar_idx AS source_idx, ts, open, high, low, close FROM {source} b JOIN fd ON fd.symbol = b.symbol
  WHERE b.bar_idx >= fold_id * {STEP} AND b.bar_idx < fold_id * {STEP} + {TRAIN})"""


@query(with_(BARS, folds()) + "SELECT whole_symbol AS symbol, fold_id, bar_idx, source_idx, round(close, 6) AS close FROM fb")
def wf_folds(spark, sf):
    return sweep.wf_folds(bars(spark, sf), TRAIN, STEP).select("symbol", "fold_id", "bar_idx", "source_idx", *r6("close"))


@query(with_(BARS, folds(), searched("fb", "f")) + f"SELECT own.symbol, own.fold_id, f_sc.param_id, {finite('f_sc.score')} AS score FROM f_sc JOIN (SELECT DISTINCT symbol AS grp, whole_symbol AS symbol, fold_id FROM fb) own ON own.grp = f_sc.grp")
def fold_scores(spark, sf):
    return sweep.fold_scores(bars(spark, sf), sig.sig_donchian, PARAMS, TRAIN, STEP, digits=DIGITS).select("symbol", "fold_id", "param_id", shown("score"))


def walked(source: str = "bars") -> str:
    """CTEs up to ``rsw``: out-of-sample returns ``r`` of ``symbol``."""
    picked = f"""wn AS (SELECT DISTINCT fb.whole_symbol AS symbol, fb.fold_id, f_best.param_id FROM f_best JOIN fb ON fb.symbol = f_best.grp),
wl AS (SELECT a.grp AS symbol, a.bar_idx, a.ts, a.open, a.close, CASE WHEN a.bar_idx >= {TRAIN} THEN coalesce(a.signal, 0) ELSE 0 END AS signal, wn.fold_id
  FROM h_all a LEFT JOIN wn ON wn.symbol = a.grp AND wn.fold_id = (a.bar_idx - {TRAIN}) // {STEP} AND a.bar_idx >= {TRAIN} WHERE CASE WHEN a.bar_idx >= {TRAIN} THEN a.param_id = wn.param_id ELSE a.param_id = 0 END)"""
    return ", ".join([folds(source), searched("fb", "f"), swept(source, "h"), picked, renamed(returns_sql(source="wl")[0], "w")])


@query(with_(BARS, walked()) + f"SELECT symbol, bar_idx, signal, round(bar_return, 6) AS bar_return, round(r, 6) + 0.0 AS strategy_return FROM rsw WHERE bar_idx >= {TRAIN}")
def walk_forward(spark, sf):
    found = sweep.walk_forward(bars(spark, sf), sig.sig_donchian, PARAMS, TRAIN, STEP, digits=DIGITS)
    return found.select("symbol", "bar_idx", "signal", *r6("bar_return", "strategy_return"))


WF_TEST = (permuted(TRAIN, 9, True, perms=WF_PERMS), walked("pb"), f"wf AS ({factor(f'(SELECT * FROM rsw WHERE bar_idx >= {TRAIN})', 'symbol')})", "wg AS (SELECT split_part(symbol, '@', 1) AS grp, split_part(symbol, '@', 2)::INTEGER AS perm_id, score FROM wf)")


@query(with_(BARS, *WF_TEST) + tested("wg"))
def wf_perm_test(spark, sf):
    return is_test_rows(sweep.wf_perm_test(bars(spark, sf), sig.sig_donchian, PARAMS, WF_PERMS, TRAIN, STEP, digits=DIGITS))


VERDICT = """CASE WHEN is_p_value >= 0.05 OR wf_p_value >= 0.05 THEN 'OVERFIT' WHEN oos_profit_factor < 1.1 THEN 'POOR' ELSE 'VALIDATED' END AS verdict,
  CASE WHEN is_p_value >= 0.05 THEN 'STEP_2_IS_PERMUTATION' WHEN wf_p_value >= 0.05 THEN 'STEP_4_WF_PERMUTATION' WHEN oos_profit_factor < 1.1 THEN 'STEP_3_OOS_WEAK' END AS failed_step,
  CASE WHEN is_p_value >= 0.05 THEN is_p_value WHEN wf_p_value >= 0.05 THEN wf_p_value END AS failed_p_value"""
STEPS = "vs AS (SELECT p_partkey, p_size / 100.0 AS is_p_value, (p_partkey % 13) / 100.0 AS wf_p_value, p_retailprice / 1000.0 AS oos_profit_factor FROM part)"


@query(with_(STEPS) + f"SELECT p_partkey, {VERDICT} FROM vs")
def verdict(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", (F.col("p_size") / 100.0).alias("is_p_value"), ((F.col("p_partkey") % 13) / 100.0).alias("wf_p_value"), (F.col("p_retailprice") / 1000.0).alias("oos_profit_factor"))
    return sweep.verdict(part).select("p_partkey", "verdict", "failed_step", "failed_p_value")


#: The in-sample test on the training bars and the walk-forward test on all, side by side.
FULL = (
    BARS, f"tb AS (SELECT * FROM bars WHERE bar_idx < {TRAIN})", scoped("_one", *is_test("tb")), scoped("_two", *WF_TEST), f"it AS ({tested('ib_one')})", f"wt AS ({tested('wg_two')})",
    "bp AS (SELECT grp AS symbol, param_id FROM ib_one WHERE perm_id = 0)",
    "vs AS (SELECT it.symbol, bp.param_id, it.real_score AS is_profit_factor, it.p_value AS is_p_value, wt.real_score AS oos_profit_factor, wt.p_value AS wf_p_value FROM it JOIN wt ON wt.symbol = it.symbol JOIN bp ON bp.symbol = it.symbol)",
)


@query(with_(*FULL) + f"SELECT symbol, param_id, {LABEL} AS params, is_profit_factor, is_p_value, oos_profit_factor, wf_p_value, {VERDICT} FROM vs")
def full_validation(spark, sf):
    found = sweep.full_validation(bars(spark, sf), sig.sig_donchian, PARAMS, TRAIN, STEP, IS_PERMS, WF_PERMS, digits=DIGITS)
    return found.select("symbol", "param_id", "params", shown("is_profit_factor"), *r6("is_p_value"), shown("oos_profit_factor"), *r6("wf_p_value"), "verdict", "failed_step", *r6("failed_p_value"))


QUICK = (f"tb AS (SELECT * FROM bars WHERE bar_idx < {TRAIN})", searched("tb", "q"), swept("bars", "u"), *[renamed(x, "u") for x in returns_sql(source="u_all")])
QUICK_ROWS = f"""SELECT split_part(m.symbol, '#', 1) AS symbol, q.param_id, {finite('q.score')} AS is_profit_factor, {', '.join('m.' + c for c in (*RATIOS, 'num_trades'))}
FROM ({metrics_sql(source='equ')}) m JOIN q_best q ON q.grp || '#' || q.param_id = m.symbol"""


@query(with_(BARS, *QUICK) + QUICK_ROWS)
def quick_validation(spark, sf):
    found = sweep.quick_validation(bars(spark, sf), sig.sig_donchian, PARAMS, TRAIN, digits=DIGITS)
    return shown_metrics(found, "symbol", "param_id", shown("is_profit_factor"))


def _batch(spark, sf):
    def broken(df, key, out, lookback):
        raise ValueError("no such strategy")

    return sweep.batch_validate(bars(spark, sf), {"breakout": (sig.sig_donchian, PARAMS), "again": (sig.sig_donchian, PARAMS), "broken": (broken, PARAMS)}, TRAIN, digits=DIGITS)


BATCH = f"""SELECT strategy, symbol, status, verdict, score FROM (
  SELECT s AS strategy, grp AS symbol, 'OK' AS status, 'QUICK' AS verdict, {finite('score')} AS score FROM q_best, (SELECT unnest(['breakout', 'again']) AS s)
  UNION ALL SELECT 'broken', symbol, 'ERROR', 'ERROR', NULL FROM bars GROUP BY symbol)"""


@query(with_(BARS, *QUICK[:2]) + BATCH)
def batch_validate(spark, sf):
    return _batch(spark, sf).select("strategy", "symbol", "status", "verdict", shown("is_profit_factor", "score"))


@query(with_(BARS, *QUICK[:2]) + f"SELECT strategy, status, count(*) AS n FROM ({BATCH}) GROUP BY ALL")
def batch_summary(spark, sf):
    return sweep.batch_summary(_batch(spark, sf), "status", ("strategy",))

