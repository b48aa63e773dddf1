"""Queries of trade reconciliation, of script corpora and of the extension points."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import plugins
from ..operators import corpus, reconcile
from ..operators import returns as ret
from ..operators import signals as sig
from .base import BARS, LAG, bars, query, r6, table, with_
from .signals_returns import DONCHIAN, donchian, trades_sql

CODES = ", ".join(f"('{a}', '{b}')" for a, b in reconcile.REASONS.items())
PRIORITIES = "['SL', 'Take Profit', ' trail ', 'OB', 'Something']"


@query(with_(f"codes AS (SELECT * FROM (VALUES {CODES}) v(a, b))", f"raw AS (SELECT o_orderkey, {PRIORITIES}[(o_orderkey % 5 + 1)::INTEGER] AS reason FROM orders)") + "SELECT o_orderkey, coalesce(b, trim(lower(reason))) AS code FROM raw LEFT JOIN codes ON a = trim(lower(reason))")
def normalize_exit_reason(spark, sf):
    words = F.array(*[F.lit(w) for w in ("SL", "Take Profit", " trail ", "OB", "Something")])
    reason = F.get(words, (F.col("o_orderkey") % 5).cast("int"))
    return table(spark, sf, "orders").select("o_orderkey", reconcile.normalize_exit_reason(reason).alias("code"))


def lists(spark, sf):
    """Our trades, and the same as somebody else's with some changes; of one symbol theirs lacks two trades."""
    ours = ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))).withColumns({"pnl": F.col("pnl_pct"), "exit_signal": F.when(F.col("trade_id") % 2 == 0, "PT").otherwise("SL")})
    i = F.col("trade_id")
    theirs = ours.withColumns({
        "entry_time": F.when(i % 7 == 0, F.expr("entry_time + INTERVAL 2 MINUTES")).otherwise(F.col("entry_time")), "exit_price": F.when(i % 5 == 0, F.col("exit_price") + 1).otherwise(F.col("exit_price")),
        "exit_signal": F.when(i % 10 == 5, F.lit("take profit")).when(i % 2 == 0, F.lit("Profit Target")).otherwise(F.lit("Stop Loss")), "pnl": F.when(i % 6 == 0, F.col("pnl") * 1.1).otherwise(F.col("pnl")),
    }).filter((F.col("symbol") != "click") | (i > 2))
    return ours, theirs


LISTS = (*DONCHIAN, trades_sql(), "ours AS (SELECT *, pnl_pct AS pnl, CASE WHEN trade_id % 2 = 0 THEN 'profit_target' ELSE 'stop_loss' END AS code FROM trades)",
    """theirs AS (SELECT symbol, trade_id, CASE WHEN trade_id % 7 = 0 THEN entry_ts + INTERVAL 2 MINUTE ELSE entry_ts END AS entry_ts, exit_ts, entry_price, CASE WHEN trade_id % 5 = 0 THEN exit_price + 1 ELSE exit_price END AS exit_price,
  CASE WHEN trade_id % 10 = 5 OR trade_id % 2 = 0 THEN 'profit_target' ELSE 'stop_loss' END AS code, CASE WHEN trade_id % 6 = 0 THEN pnl * 1.1 ELSE pnl END AS pnl FROM ours WHERE symbol <> 'click' OR trade_id > 2)""",
    "o AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) - 1 AS trade_idx, count(*) OVER (PARTITION BY symbol) AS n FROM ours)", "t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY entry_ts) - 1 AS trade_idx, count(*) OVER (PARTITION BY symbol) AS n FROM theirs)",
    """cp AS (SELECT o.symbol, o.trade_idx, o.n AS n_our, t.n AS n_their, o.entry_bar, o.code AS oc, t.code AS tc, list_filter([CASE WHEN abs(epoch_us(o.entry_ts) - epoch_us(t.entry_ts)) > 60000000 THEN 'entry_time' END, CASE WHEN abs(epoch_us(o.exit_ts) - epoch_us(t.exit_ts)) > 60000000 THEN 'exit_time' END,
  CASE WHEN abs(o.entry_price - t.entry_price) > 0.01 THEN 'entry_price' END, CASE WHEN abs(o.exit_price - t.exit_price) > 0.01 THEN 'exit_price' END, CASE WHEN o.code <> t.code THEN 'exit_signal' END,
  CASE WHEN CASE WHEN t.pnl <> 0 THEN abs(o.pnl - t.pnl) / abs(t.pnl) * 100 > 2 ELSE abs(o.pnl) > 1 END THEN 'pnl' END], lambda x: x IS NOT NULL) AS diffs FROM o JOIN t ON t.symbol = o.symbol AND t.trade_idx = o.trade_idx)""")  # fmt: skip


def compared(spark, sf):
    ours, theirs = lists(spark, sf)
    return ours, theirs, reconcile.compare_trades(reconcile.match_trades(ours, theirs))


@query(with_(*LISTS) + "SELECT o.symbol, o.trade_idx, o.trade_id AS our_id, t.trade_id AS their_id, o.n AS n_our, t.n AS n_their FROM o JOIN t ON t.symbol = o.symbol AND t.trade_idx = o.trade_idx")
def match_trades(spark, sf):
    return reconcile.match_trades(*lists(spark, sf)).select("symbol", "trade_idx", F.col("our.trade_id").alias("our_id"), F.col("their.trade_id").alias("their_id"), "n_our", "n_their")


@query(with_(*LISTS) + "SELECT symbol, trade_idx, array_to_string(diffs, ',') AS differences, len(diffs) = 0 AS matched FROM cp")
def compare_trades(spark, sf):
    return compared(spark, sf)[2].select("symbol", "trade_idx", F.array_join("differences", ",").alias("differences"), "matched")


SUMMARY = """sm AS (SELECT a.symbol, a.n AS n_ours, b.n AS n_theirs, a.p AS our_total_pnl, b.p AS their_total_pnl, ok, bad, first_bad FROM (SELECT symbol, count(*) AS n, sum(pnl) AS p FROM ours GROUP BY symbol) a
  JOIN (SELECT symbol, count(*) AS n, sum(pnl) AS p FROM theirs GROUP BY symbol) b ON b.symbol = a.symbol
  JOIN (SELECT symbol, count(*) FILTER (len(diffs) = 0) AS ok, count(*) FILTER (len(diffs) > 0) AS bad, arg_min('number ' || (trade_idx + 1) || ' differs in ' || array_to_string(diffs, ', '), trade_idx) FILTER (len(diffs) > 0) AS first_bad FROM cp GROUP BY symbol) c ON c.symbol = a.symbol)"""


@query(with_(*LISTS, SUMMARY) + """SELECT symbol, abs(n_ours - n_theirs) <= 1 AND bad = 0 AS passed, CASE WHEN abs(n_ours - n_theirs) > 1 THEN n_ours || ' own trades against ' || n_theirs || ' external ones' WHEN bad = 0 THEN ok || ' trades agree' ELSE first_bad END AS message,
  CASE WHEN abs(n_ours - n_theirs) > 1 THEN 0 ELSE ok + bad END AS compared, CASE WHEN abs(n_ours - n_theirs) > 1 THEN 0 ELSE ok END AS matched, CASE WHEN abs(n_ours - n_theirs) > 1 THEN 0 ELSE bad END AS mismatched,
  round(our_total_pnl, 6) AS our_total_pnl, round(their_total_pnl, 6) AS their_total_pnl, round(our_total_pnl - their_total_pnl, 6) + 0.0 AS pnl_difference, round(coalesce(abs(our_total_pnl - their_total_pnl) / nullif(abs(their_total_pnl), 0) * 100, 0), 6) AS pnl_difference_pct FROM sm""")
def reconcile_summary(spark, sf):
    found = reconcile.reconcile_summary(*compared(spark, sf))
    return found.select("symbol", "passed", "message", "compared", "matched", "mismatched", *r6("our_total_pnl", "their_total_pnl", "pnl_difference", "pnl_difference_pct"))


@query(with_(*LISTS, "ln AS (SELECT symbol, string_agg('  number ' || (trade_idx + 1) || ' differs in ' || array_to_string(diffs, ', '), chr(10) ORDER BY trade_idx) AS bad_lines, count(*) AS n FROM cp WHERE len(diffs) > 0 GROUP BY symbol)") + "SELECT symbol, bad_lines, n AS n_lines FROM ln")
def reconcile_report(spark, sf):
    ours, theirs, found = compared(spark, sf)
    reports = reconcile.reconcile_report(reconcile.reconcile_summary(ours, theirs, found), found, most=2**31 - 1)
    lines = F.filter(F.split("report", "\n"), lambda x: x.startswith("  number "))
    return reports.select("symbol", F.array_join(lines, "\n").alias("bad_lines"), F.size(lines).cast("long").alias("n_lines"))


VERDICTS = """vd AS (SELECT *, abs(n_ours - n_theirs) > 1 AS far FROM sm)"""


@query(with_(*LISTS, SUMMARY, VERDICTS) + """SELECT symbol, 0 AS section, NULL::BIGINT AS trade_idx, CASE WHEN NOT far AND bad = 0 THEN 'agrees: ' ELSE 'does not agree: ' END
  || CASE WHEN far THEN n_ours || ' own trades against ' || n_theirs || ' external ones' WHEN bad = 0 THEN ok || ' trades agree' ELSE first_bad END AS line FROM vd
UNION ALL SELECT symbol, 1, NULL, CASE WHEN far THEN 0 ELSE ok END || ' of ' || CASE WHEN far THEN 0 ELSE ok + bad END || ' pairs agree' FROM vd
UNION ALL SELECT symbol, 2, NULL, printf('total P&L %.2f, external %.2f, apart by %.2f', our_total_pnl, their_total_pnl, our_total_pnl - their_total_pnl) FROM vd
UNION ALL SELECT symbol, 3, trade_idx, '  number ' || (trade_idx + 1) || ' differs in ' || array_to_string(diffs, ', ') FROM cp WHERE len(diffs) > 0""")
def reconcile_lines(spark, sf):
    ours, theirs, found = compared(spark, sf)
    return reconcile.reconcile_lines(reconcile.reconcile_summary(ours, theirs, found), found)


CATEGORIES = """ct AS (SELECT symbol, trade_idx, entry_bar, list_concat(list_transform(diffs, lambda d: d || '_mismatch'), CASE WHEN list_contains(diffs, 'exit_signal') AND list_contains(diffs, 'exit_price') THEN ['stop_target_fill_mismatch'] ELSE [] END) AS cs FROM cp)"""


@query(with_(*LISTS, CATEGORIES) + "SELECT symbol, category, count(*) AS n FROM (SELECT symbol, unnest(cs) AS category FROM ct) GROUP BY ALL")
def mismatch_breakdown(spark, sf):
    return reconcile.mismatch_breakdown(compared(spark, sf)[2])


@query(with_(*LISTS, CATEGORIES) + "SELECT symbol, min(trade_idx) + 1 AS trade_number, arg_min(entry_bar, trade_idx) AS our_entry_bar, array_to_string(arg_min(cs, trade_idx), ',') AS categories FROM ct WHERE len(cs) > 0 GROUP BY symbol")
def first_divergence(spark, sf):
    return reconcile.first_divergence(compared(spark, sf)[2]).withColumn("categories", F.array_join("categories", ","))


@query(with_(*DONCHIAN, trades_sql()) + "SELECT t.symbol, count(*) AS n_entries, round(100.0 * count(*) FILTER (NOT hour(entry_ts) BETWEEN 6 AND 18) / count(*), 6) AS outside_pct FROM trades t GROUP BY t.symbol")
def session_coverage(spark, sf):
    own = bars(spark, sf)
    trades = ret.trades_from_signals(sig.sig_donchian(own))
    return reconcile.session_coverage(trades, own.filter(F.hour("ts").between(6, 18))).select("symbol", "n_entries", *r6("outside_pct"))


#: Scripts made of the documents: a declaration, some calls, then the text itself.
SCRIPTS = """scripts AS (SELECT doc_id, 'file-' || doc_id || '.txt' AS path, CASE WHEN doc_id % 3 = 0 THEN 'strategy("' || source || '  ' || lang || '")' ELSE '' END || chr(10) || CASE WHEN doc_id % 2 = 0 THEN 'x = ta.rsi(close, ' || (doc_id % 5) || ') and ta.ema(close, 9)' ELSE 'crossover(a, b) strategy.exit' END || chr(10) || text AS text FROM documents)"""


def scripts(spark, sf):
    i = F.col("doc_id")
    head = F.when(i % 3 == 0, F.concat(F.lit('strategy("'), "source", F.lit("  "), "lang", F.lit('")'))).otherwise(F.lit(""))
    body = F.when(i % 2 == 0, F.concat(F.lit("x = ta.rsi(close, "), (i % 5).cast("string"), F.lit(") and ta.ema(close, 9)"))).otherwise(F.lit("crossover(a, b) strategy.exit"))
    text = F.concat(head, F.lit("\n"), body, F.lit("\n"), "text")
    return table(spark, sf, "documents").select("doc_id", F.concat(F.lit("file-"), i.cast("string"), F.lit(".txt")).alias("path"), text.alias("text"))


def _contains(words: list[str]) -> str:
    return " OR ".join(f"contains(lower(text), '{w}')" for w in words)


PRIORITY = f"CASE WHEN {_contains(corpus.COMPLEX)} THEN 3 WHEN {_contains(corpus.MEDIUM)} THEN 2 ELSE 1 END AS priority, coalesce(nullif(concat_ws('; ', {', '.join(f'CASE WHEN contains(lower(text), {w!r}) THEN {t!r} END' for w, t in corpus.TAGS.items())}), ''), 'Custom logic') AS description"


@query(with_(SCRIPTS) + f"SELECT doc_id, {PRIORITY} FROM scripts")
def script_priority(spark, sf):
    return corpus.script_priority(scripts(spark, sf)).select("doc_id", "priority", "description")


@query(with_(SCRIPTS, """nm AS (SELECT path, text, coalesce(nullif(regexp_extract(text, 'strategy\\s*\\(\\s*[''"]([^''"]+)[''"]', 1), ''), regexp_extract(path, '([^/]+?)(\\.[^./]*)?$', 1)) AS name, sha1(text) AS digest FROM scripts)""")
    + f"SELECT path, name, digest, {PRIORITY} FROM (SELECT *, row_number() OVER (PARTITION BY regexp_replace(trim(lower(name)), '\\s+', ' ', 'g'), digest ORDER BY path) AS k FROM nm) WHERE k = 1")
def script_inventory(spark, sf):
    return corpus.script_inventory(scripts(spark, sf)).select("path", "name", "digest", "priority", "description")


@query(with_(SCRIPTS, """cl AS (SELECT unnest(regexp_extract_all(text, 'ta\\.(\\w+)\\s*\\(([^)]+)\\)', 1)) AS function, unnest(regexp_extract_all(text, 'ta\\.(\\w+)\\s*\\(([^)]+)\\)', 2)) AS arguments FROM scripts)""") + "SELECT function, count(*) AS n_calls, count(DISTINCT arguments) AS n_arguments FROM cl GROUP BY function")
def indicator_census(spark, sf):
    return corpus.indicator_census(scripts(spark, sf))


@query(with_(BARS, donchian(n=15)) + "SELECT symbol, bar_idx, signal FROM sg")
def strategy_plugin(spark, sf):
    return bars(spark, sf).transform(plugins.strategy_plugin(sig.sig_donchian, lookback=15)).select("symbol", "bar_idx", "signal")


@query(with_(BARS) + f"SELECT symbol, bar_idx, CASE WHEN close > lag(close) {LAG} THEN 1 WHEN close < lag(close) {LAG} THEN -1 ELSE 0 END AS signal FROM bars")
def pandas_strategy(spark, sf):
    def rising(pdf):
        moved = pdf["close"].diff()
        return (moved > 0).astype(int) - (moved < 0).astype(int)

    return plugins.pandas_strategy(bars(spark, sf), rising).select("symbol", "bar_idx", "signal")


@query(with_(BARS, donchian(), "bd AS (SELECT symbol, CASE WHEN symbol = 'click' AND bar_idx % 10 = 0 THEN 2 WHEN symbol = 'view' AND bar_idx % 20 = 0 THEN NULL ELSE signal END AS signal FROM sg WHERE symbol <> 'purchase' OR bar_idx > 4)", "n AS (SELECT symbol, count(*) AS n_bars FROM bars GROUP BY symbol)")
    + """SELECT n.symbol, n_bars, count(bd.symbol) AS n_signals, count(*) FILTER (signal IS NULL) AS n_missing, count(*) FILTER (signal NOT IN (-1, 0, 1)) AS n_other, n_bars = count(bd.symbol) AND count(*) FILTER (signal IS NULL) = 0 AND count(*) FILTER (signal NOT IN (-1, 0, 1)) = 0 AS valid
FROM n LEFT JOIN bd ON bd.symbol = n.symbol GROUP BY n.symbol, n_bars""")  # fmt: skip
def signal_contract_check(spark, sf):
    own = bars(spark, sf)
    i, s = F.col("bar_idx"), F.col("symbol")
    bad = sig.sig_donchian(own).withColumn("signal", F.when((s == "click") & (i % 10 == 0), 2).when((s == "view") & (i % 20 == 0), F.lit(None).cast("int")).otherwise(F.col("signal")))
    return plugins.signal_contract_check(own, bad.filter((s != "purchase") | (i > 4)))


@query(with_(BARS, "mk AS (SELECT symbol, bar_idx AS signal_bar, bar_idx + 1 AS entry_bar FROM bars WHERE close > 2 * open)", f"nx AS (SELECT symbol, bar_idx, open FROM bars)",
    """lv AS (SELECT m.*, n.open AS entry_price FROM mk m JOIN nx n ON n.symbol = m.symbol AND n.bar_idx = m.entry_bar),
fr AS (SELECT l.symbol, l.signal_bar, min(b.bar_idx) + 1 AS qbar FROM lv l JOIN bars b ON b.symbol = l.symbol AND b.bar_idx > l.entry_bar AND b.close < 0.5 * b.open GROUP BY ALL)""")
    + """SELECT l.symbol, l.signal_bar, l.entry_bar, round(l.entry_price, 6) AS entry_price, q.bar_idx AS exit_bar, round(q.open, 6) AS exit_price, CASE WHEN q.open IS NULL THEN 'Open' ELSE 'Signal' END AS exit_signal
FROM lv l LEFT JOIN fr f ON f.symbol = l.symbol AND f.signal_bar = l.signal_bar LEFT JOIN bars q ON q.symbol = l.symbol AND q.bar_idx = f.qbar""")  # fmt: skip
def custom_entry_exit(spark, sf):
    found = plugins.custom_entry_exit(bars(spark, sf), F.col("close") > 2 * F.col("open"), F.col("close") < 0.5 * F.col("open"))
    return found.select("symbol", "signal_bar", "entry_bar", *r6("entry_price"), "exit_bar", *r6("exit_price"), "exit_signal")


