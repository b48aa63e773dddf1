"""Queries of readers and writers: bars and trades of the tables are written and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import returns as ret
from ..operators import signals as sig
from ..sources import bars as src
from ..sources import sinks
from ..sources.scratch import fresh_path
from .base import BARS, bars, query, r6, stamp, table, with_
from .preparation import OUT, PRICES, TS, shown
from .signals_returns import DONCHIAN, SMALL, small, trades_sql



def written(spark, df, sep=",", name="bars"):
    path = fresh_path(spark, name)
    df.write.csv(path, header=True, sep=sep)
    return path


def in_layouts(spark, df, row, forms, name="bars"):
    """Files below one path, ``row`` dealt over the forms: each a delimiter and the columns in the order of its files."""
    path = fresh_path(spark, name)
    for i, (sep, columns) in enumerate(forms):
        df.filter(row % len(forms) == i).select(*[F.col(c).alias(heading) for c, heading in columns]).write.csv(f"{path}/{i}", header=True, sep=sep)
    return f"{path}/*"


@query(with_(BARS) + f"SELECT symbol, {TS}, {OUT} FROM bars WHERE bar_idx % 10 <> 3")
def read_bars_csv(spark, sf):
    """Four layouts below one path, with delimiters, headings and orders of their own, and some prices that are no numbers."""
    own = bars(spark, sf).withColumn("close", F.when(F.col("bar_idx") % 10 == 3, F.lit("n/a")).otherwise(F.col("close").cast("string")))
    forms = [
        ("\t", [("symbol", "symbol"), ("ts", "Date"), ("open", "Open_Price"), ("high", "H"), ("low", "LOW"), ("close", "Adj Close"), ("volume", "Vol")]),
        (",", [("ts", "timestamp"), ("close", "close"), ("open", "open"), ("high", "high"), ("low", "low"), ("volume", "volume"), ("symbol", "symbol")]),
        (";", [("volume", " V "), ("low", "L"), ("high", "High_Price"), ("symbol", "symbol"), ("open", "o"), ("close", "C"), ("ts", "time")]),
        (",", [("high", "h"), ("low", "l"), ("open", "o"), ("close", "close_price"), ("symbol", "symbol"), ("ts", "datetime"), ("volume", "v")]),
    ]
    return shown(src.read_bars_csv(spark, in_layouts(spark, own, F.col("bar_idx"), forms), keep=("symbol",)))


@query("SELECT p_partkey, p_retailprice AS open, p_retailprice AS high, p_retailprice AS low, p_retailprice AS close, p_size::DOUBLE AS volume FROM part")
def resolve_columns(spark, sf):
    part = table(spark, sf, "part")
    raw = part.select("p_partkey", *[F.col("p_retailprice").cast("string").alias(c) for c in ("O", "High_Price", " low ", "Adj_Close")], F.col("p_size").alias("VOLUME"), F.current_date().alias("Date"))
    return src.resolve_columns(raw, ("p_partkey",)).select("p_partkey", "open", "high", "low", "close", "volume")


@query(with_(BARS) + f"SELECT symbol, {TS}, {OUT} FROM bars WHERE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960")
def read_bars_strict(spark, sf):
    """The first column is the time where no heading says so; three layouts below one path."""
    plain = [("ts", "when"), ("symbol", "symbol"), *[(c, c) for c in PRICES]]
    forms = [(",", plain), ("\t", [("symbol", "symbol"), *[(c, c) for c in reversed(PRICES)], ("ts", "Date")]), (";", [("close", "close"), ("ts", "time"), ("open", "open"), ("low", "low"), ("high", "high"), ("symbol", "symbol"), ("volume", "vol")])]
    path = in_layouts(spark, bars(spark, sf), F.col("bar_idx"), forms)
    return shown(src.read_bars_strict(spark, path, unlabelled=True, rth_only=True, keep=("symbol",)))


@query(with_(BARS) + f"SELECT symbol, {TS}, {OUT} FROM bars")
def read_bars_parquet(spark, sf):
    path = fresh_path(spark, "bars")
    bars(spark, sf).withColumnRenamed("ts", "datetime").write.parquet(path)
    return shown(src.read_bars_parquet(spark, path, ("symbol",)))




def mixed(spark, sf):
    """Times of the events as seconds, milliseconds, texts or a mix, by event type."""
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"), "ts")
    seconds, millis, text = F.floor(F.col("us") / 1_000_000).cast("string"), F.floor(F.col("us") / 1000).cast("string"), F.date_format("ts", "yyyy-MM-dd HH:mm:ss")
    raw = F.when(F.col("symbol") == "click", seconds).when(F.col("symbol") == "view", millis).when(F.col("symbol") == "purchase", text).otherwise(F.when(F.col("event_id") % 10 == 0, text).otherwise(seconds))
    return e.withColumn("raw", raw)


@query("SELECT event_type AS symbol, event_id, strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') AS ts FROM events")
def parse_mixed_timestamps(spark, sf):
    return src.parse_mixed_timestamps(mixed(spark, sf).drop("ts"), "raw", ("symbol",)).select("symbol", "event_id", stamp())


@query("""SELECT u || '-' || event_type AS symbol, u AS unit, CASE WHEN max(ts) > min(ts) THEN 111.0 ELSE 110.0 END AS score FROM events, (SELECT unnest(['s', 'ms', 'us', 'ns']) AS u) GROUP BY ALL
UNION ALL SELECT 'none-' || event_type, 's', -1.0 FROM events GROUP BY event_type""")
def detect_epoch_unit(spark, sf):
    """All events in each unit, and texts that are no numbers."""
    e = table(spark, sf, "events").select("event_type", F.unix_micros(F.col("ts").cast("timestamp")).alias("us"))
    forms = {"s": F.floor(F.col("us") / 1_000_000), "ms": F.floor(F.col("us") / 1000), "us": F.col("us"), "ns": F.col("us") * 1000}
    rows = F.array(*[F.struct(F.concat(F.lit(f"{u}-"), "event_type").alias("symbol"), x.cast("string").alias("raw")) for u, x in forms.items()], F.struct(F.concat(F.lit("none-"), "event_type").alias("symbol"), F.lit("n/a").alias("raw")))
    return src.detect_epoch_unit(e.select(F.explode(rows).alias("r")).select("r.*"), "raw", ("symbol",)).select("symbol", "unit", F.round("score", 6).alias("score"))


@query("""SELECT o_orderkey, strftime(CASE o_orderkey % 4 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('day', o_orderdate) WHEN 2 THEN date_trunc('minute', o_orderdate)
  ELSE CASE WHEN day(o_orderdate) > 12 THEN date_trunc('day', o_orderdate) ELSE make_date(year(o_orderdate), day(o_orderdate), month(o_orderdate))::TIMESTAMP END END, '%Y-%m-%d %H:%M:%S') AS ts FROM orders""")
def parse_trade_datetime(spark, sf):
    """Every order's date in one of four forms; a day up to 12 that stands first is read as the month."""
    orders = table(spark, sf, "orders").select("o_orderkey", "o_orderdate")
    forms = ["yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MM/dd/yyyy HH:mm", "dd/MM/yyyy"]
    text = F.coalesce(*[F.when(F.col("o_orderkey") % 4 == i, F.date_format("o_orderdate", f)) for i, f in enumerate(forms)])
    return orders.select("o_orderkey", F.date_format(src.parse_trade_datetime(text), "yyyy-MM-dd HH:mm:ss").alias("ts"))


EXTERNAL = "symbol, {0} AS entry_time, {1} AS exit_time, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, CASE WHEN trade_id % 2 = 0 THEN 'Take Profit' ELSE 'SL' END AS exit_signal, round(pnl_pct, 6) AS pnl"


def external_csv(spark, sf):
    """Trades as external lists in three layouts: headings with spaces or without, times as month/day/year or year-month-day."""
    trades = ret.trades_from_signals(sig.sig_donchian(bars(spark, sf)))
    time = lambda c: F.when(F.col("trade_id") % 3 == 1, F.date_format(c, "yyyy-MM-dd HH:mm:ss")).otherwise(F.date_format(c, "MM/dd/yyyy HH:mm:ss"))
    reason = F.when(F.col("trade_id") % 2 == 0, "Take Profit").otherwise("SL")
    own = trades.withColumns({"entry_time": time("entry_time"), "exit_time": time("exit_time"), "reason": reason})
    columns = ("symbol", "entry_time", "exit_time", "entry_price", "exit_price", "reason", "pnl_pct")
    headings = [
        ("symbol", "Entry Time", "Exit Time", "Entry Price", "Exit Price", "Exit Signal", "Net Profit"),
        ("symbol", "entry_date", "exit_date", "entry", "exit", "type", "pnl"),
        ("symbol", "EntryTime", "ExitTime", "EntryPrice", "ExitPrice", "Signal", "P&L"),
    ]
    forms = [(",", list(zip(columns, h))) for h in headings]
    forms[1] = (",", forms[1][1][::-1])
    return in_layouts(spark, own, F.col("trade_id"), forms, "external")


@query(with_(*DONCHIAN, trades_sql()) + "SELECT " + EXTERNAL.format("strftime(entry_ts, '%Y-%m-%d %H:%M:%S')", "strftime(exit_ts, '%Y-%m-%d %H:%M:%S')") + " FROM trades")
def read_external_trades(spark, sf):
    found = src.read_external_trades(spark, external_csv(spark, sf), ("symbol",))
    return found.select("symbol", stamp("entry_time"), stamp("exit_time"), *r6("entry_price", "exit_price"), "exit_signal", *r6("pnl"))


def cached(spark, sf):
    path = fresh_path(spark, "cache")
    own = bars(spark, sf).drop("bar_idx").withColumn("interval", F.lit("1h"))
    renamed = own.withColumn("symbol", F.when(F.col("symbol") == "click", "QQQ").otherwise(F.col("symbol")))
    sinks.write_bar_cache(renamed, path)
    sinks.write_bar_cache(renamed.filter("symbol = 'QQQ'").withColumn("volume", F.col("volume") * 2), path)
    return path


@query(with_(BARS) + f"SELECT 'QQQ' AS symbol, {TS}, {OUT.replace('round(volume, 6)', 'round(volume * 2, 6)')} FROM bars WHERE symbol = 'click'")
def load_bars_by_symbol(spark, sf):
    return shown(src.load_bars_by_symbol(spark, cached(spark, sf), "ndx", "1h"))


@query(with_(BARS) + f"SELECT CASE WHEN symbol = 'click' THEN 'QQQ' ELSE symbol END AS symbol, {TS}, {OUT.replace('round(volume, 6)', chr(114) + 'ound(CASE WHEN symbol = ' + repr('click') + ' THEN volume * 2 ELSE volume END, 6)')} FROM bars")
def write_bar_cache(spark, sf):
    return shown(spark.read.parquet(cached(spark, sf)))


@query(with_(*DONCHIAN, trades_sql()) + "SELECT symbol, trade_id, entry_bar, lower(direction) AS direction, round(entry_price, 6) AS entry_price, round(exit_price, 6) AS exit_price, round(pnl_pct, 6) AS pnl_pct, 18 AS n_columns FROM trades")
def write_trades(spark, sf):
    path = fresh_path(spark, "trades")
    trades = ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))).withColumn("direction", F.lower("direction"))
    sinks.write_trades(trades, path, ("symbol",))
    back = spark.read.csv(path, header=True, inferSchema=True)
    return back.select("symbol", F.col("trade_id").cast("long").alias("trade_id"), F.col("entry_bar").cast("long").alias("entry_bar"), "direction", *r6("entry_price", "exit_price", "pnl_pct"), F.lit(len(back.columns)).alias("n_columns"))


@query(with_(*SMALL) + "SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS time, round(equity, 6) AS equity FROM eq")
def write_equity(spark, sf):
    path = fresh_path(spark, "equity")
    sinks.write_equity(ret.equity_curve(small(spark, sf)), path, equity="equity_curve", keep=("symbol",))
    back = spark.read.schema("symbol string, time timestamp_ntz, equity double").csv(path, header=True)
    return back.select("symbol", stamp("time"), *r6("equity"))


@query(with_(*DONCHIAN, trades_sql()) + """SELECT line, count(*) AS n FROM (SELECT unnest(list_filter(['trades', 'profit', '  ' || count(*) || ' trades', '  ' || count(*) FILTER (pnl_pct > 0) || ' won', '  ' || count(*) FILTER (pnl_pct <= 0) || ' lost'], lambda x: x IS NOT NULL)) AS line FROM trades GROUP BY symbol) GROUP BY line""")
def write_report(spark, sf):
    path = fresh_path(spark, "report")
    stats = ret.trade_stats(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))), "pnl_pct")
    sinks.write_report(sinks.report_lines(stats), path)
    lines = spark.read.text(path).withColumnRenamed("value", "line").filter(F.col("line").rlike(r"^(trades|profit|risk|  \d+ (trades|won|lost))$"))
    return lines.groupBy("line").agg(F.count(F.lit(1)).alias("n"))


@query(with_(*DONCHIAN, trades_sql()) + "SELECT symbol, count(*) AS total_trades, round(avg(pnl_pct), 6) AS avg_pnl FROM trades GROUP BY symbol")
def write_results_json(spark, sf):
    path = fresh_path(spark, "results")
    stats = ret.trade_stats(ret.trades_from_signals(sig.sig_donchian(bars(spark, sf))), "pnl_pct")
    sinks.write_results_json(stats, path)
    return spark.read.schema("symbol string, total_trades long, avg_pnl double").json(path).select("symbol", "total_trades", *r6("avg_pnl"))
