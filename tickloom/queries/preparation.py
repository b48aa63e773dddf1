"""Queries of bar preparation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import prep
from .base import BARS, TICKS, bars, bars_cte, query, r6, stamp, table, ticks, with_

OUT = "round(open, 6) AS open, round(high, 6) AS high, round(low, 6) AS low, round(close, 6) AS close, round(volume, 6) AS volume"
TS = "strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts"
PRICES = ("open", "high", "low", "close", "volume")


def shown(df):
    return df.select("symbol", stamp(), *r6(*PRICES))


@query(with_(TICKS, bars_cte("time_bucket(INTERVAL 4 HOUR, ts)")) + f"SELECT symbol, {TS}, {OUT} FROM bars")
def resample_ohlcv(spark, sf):
    return shown(prep.resample_ohlcv(ticks(spark, sf), "4h", order=("ts", "event_id")))


@query(with_(TICKS, bars_cte("date_trunc('hour', ts - INTERVAL 30 MINUTE) + INTERVAL 30 MINUTE")) + f"SELECT symbol, {TS}, {OUT} FROM bars")
def resample_offset(spark, sf):
    return shown(prep.resample_offset(ticks(spark, sf), order=("ts", "event_id")))


SPLITS = """splits AS (SELECT symbol, min(ts) + INTERVAL 5 DAY AS t, 2.0 AS ratio FROM bars GROUP BY symbol UNION ALL SELECT symbol, min(ts) + INTERVAL 12 DAY, 3.0 FROM bars GROUP BY symbol)"""


@query(with_(BARS, SPLITS) + f"""SELECT symbol, {TS}, round(open / f, 6) AS open, round(high / f, 6) AS high, round(low / f, 6) AS low, round(close / f, 6) AS close, round(volume, 6) AS volume
FROM (SELECT b.*, coalesce((SELECT product(ratio) FROM splits s WHERE s.symbol = b.symbol AND b.ts < s.t), 1.0) AS f FROM bars b)""")
def split_adjust(spark, sf):
    own = bars(spark, sf)
    first = own.groupBy("symbol").agg(F.min("ts").alias("t"))
    after = lambda days, ratio: first.select("symbol", F.expr(f"t + INTERVAL {days} DAYS").alias("split_ts"), F.lit(ratio).alias("ratio"))
    return shown(prep.split_adjust(own, after(5, 2.0).union(after(12, 3.0))))


@query(with_(BARS) + f"SELECT symbol, {TS}, {OUT} FROM bars WHERE hour(ts) BETWEEN 12 AND 21")
def filter_session_hours(spark, sf):
    return shown(prep.filter_session_hours(bars(spark, sf)))


@query(with_(TICKS, bars_cte("time_bucket(INTERVAL 30 MINUTE, ts)"), "m AS (SELECT symbol, median(hour(ts)) > 12 AS utc FROM bars GROUP BY symbol)") + f"""SELECT b.symbol, {TS}, {OUT} FROM bars b JOIN m ON m.symbol = b.symbol
WHERE CASE WHEN utc THEN hour(ts) * 60 + minute(ts) >= 810 AND hour(ts) * 60 + minute(ts) < 1260 ELSE hour(ts) * 60 + minute(ts) >= 570 AND hour(ts) * 60 + minute(ts) < 960 END""")
def filter_rth(spark, sf):
    return shown(prep.filter_rth(prep.resample_ohlcv(ticks(spark, sf), "30min", order=("ts", "event_id"))))


@query(with_(BARS, "av AS (SELECT symbol, min(ts) + INTERVAL 3 DAY AS a, max(ts) AS z FROM bars GROUP BY symbol)",
    "bo AS (SELECT symbol, greatest(TIMESTAMP '1990-01-01', a) AS lo, least(TIMESTAMP '2100-01-01', TIMESTAMP '2024-01-20' - INTERVAL 1 DAY) AS h FROM av)",
    "bd AS (SELECT symbol, lo, CASE WHEN h <= lo THEN lo + INTERVAL 30 DAY ELSE h END AS hi FROM bo)") + f"SELECT b.symbol, {TS}, {OUT} FROM bars b JOIN bd ON bd.symbol = b.symbol WHERE ts >= lo AND ts < hi")
def clamp_range(spark, sf):
    own = bars(spark, sf)
    available = own.groupBy(F.col("symbol").alias("dataset")).agg(F.expr("min(ts) + INTERVAL 3 DAYS").alias("available_from"))
    return shown(prep.clamp_range(own.withColumn("dataset", F.col("symbol")), available, "1990-01-01", "2100-01-01", "2024-01-20"))


@query("SELECT event_type AS symbol, epoch_us(ts) AS us, value AS open, value AS high, value AS low, value AS close, 0.0::DOUBLE AS volume FROM events")
def normalize_vendor_bars(spark, sf):
    e = table(spark, sf, "events")
    nanos = F.expr("(timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', ts)) * 1000").alias("ts_event")
    raw = e.select(F.col("event_type").alias("symbol"), nanos, *[F.col("value").alias(c) for c in ("open", "high", "low", "close")])
    return prep.normalize_vendor_bars(raw).select("symbol", F.unix_micros("ts").alias("us"), "open", "high", "low", "close", "volume")


LISTED = "listed AS (SELECT DISTINCT upper(p_brand) AS s, CASE WHEN p_brand LIKE '%1' THEN 'NYSE' ELSE 'NASDAQ' END AS x FROM part WHERE p_brand LIKE 'Brand#1%' OR p_brand LIKE 'Brand#2%')"


@query(with_(LISTED) + "SELECT p_partkey, p_brand AS symbol, coalesce(x, 'NASDAQ') AS exchange FROM part LEFT JOIN listed ON s = upper(p_brand)")
def classify_exchange(spark, sf):
    part = table(spark, sf, "part").select("p_partkey", F.col("p_brand").alias("symbol"))
    listings = part.filter(F.col("symbol").like("Brand#1%") | F.col("symbol").like("Brand#2%")).select("symbol", F.when(F.col("symbol").like("%1"), "NYSE").otherwise("NASDAQ").alias("exchange")).distinct()
    return prep.classify_exchange(part, listings)


@query(with_(BARS) + f"SELECT symbol, {TS}, {OUT} FROM bars")
def union_chunks(spark, sf):
    own = bars(spark, sf)
    return shown(prep.union_chunks(own.filter(F.dayofmonth("ts") < 10), own.filter(F.dayofmonth("ts").between(10, 19)), own.filter(F.dayofmonth("ts") >= 20)))


ODD = "odd AS (SELECT * REPLACE (CASE WHEN bar_idx % 50 = 7 THEN low - 1 ELSE high END AS high, CASE WHEN bar_idx % 40 = 3 THEN NULL ELSE close END AS close) FROM bars)"


def odd_bars(spark, sf):
    b = F.col("bar_idx")
    return bars(spark, sf).withColumns({"high": F.when(b % 50 == 7, F.col("low") - 1).otherwise(F.col("high")), "close": F.when(b % 40 != 3, F.col("close"))})


@query(with_(BARS, ODD) + """SELECT symbol, count(*) AS n_bars, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  count(*) FILTER (open IS NULL) AS missing_open, count(*) FILTER (high IS NULL) AS missing_high, count(*) FILTER (low IS NULL) AS missing_low, count(*) FILTER (close IS NULL) AS missing_close,
  count(*) FILTER (coalesce(high < low, false) OR coalesce(high < open, false) OR coalesce(high < close, false)) AS bad_high,
  count(*) FILTER (coalesce(low > high, false) OR coalesce(low > open, false) OR coalesce(low > close, false)) AS bad_low FROM odd GROUP BY symbol""")
def ohlc_quality(spark, sf):
    return prep.ohlc_quality(odd_bars(spark, sf)).withColumns({"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@query("SELECT event_type AS symbol, count(*) FILTER (ts <= before) AS n_backward FROM (SELECT *, lag(ts) OVER (PARTITION BY event_type ORDER BY user_id, event_id) AS before FROM events) GROUP BY event_type")
def monotonic_check(spark, sf):
    e = table(spark, sf, "events").select(F.col("event_type").alias("symbol"), "ts", F.struct("user_id", "event_id").alias("arrival"))
    return prep.monotonic_check(e, "arrival")


@query(with_(BARS, ODD) + f"SELECT symbol, {TS}, {OUT} FROM odd WHERE close IS NOT NULL AND high > 0 AND low > 0 AND open > 0 AND close > 0")
def require_positive(spark, sf):
    return shown(prep.require_positive(odd_bars(spark, sf), on_bad="drop"))


@query(with_(BARS) + """SELECT symbol, 'events' AS source, count(*) AS n_bars, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  'symbol,ts,open,high,low,close,volume,bar_idx' AS columns FROM bars GROUP BY symbol""")
def dataset_profile(spark, sf):
    return prep.dataset_profile(bars(spark, sf), "events").withColumns({"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@query(with_(BARS) + "SELECT symbol, round(avg(n), 6) AS bars_per_day FROM (SELECT symbol, ts::DATE AS d, count(*) AS n FROM bars GROUP BY ALL) GROUP BY symbol")
def bars_per_day(spark, sf):
    return prep.bars_per_day(bars(spark, sf)).select("symbol", *r6("bars_per_day"))


FREQ = """gaps AS (SELECT file, epoch_us(ts) / 1e6 - lag(epoch_us(ts) / 1e6) OVER (PARTITION BY file ORDER BY ts) AS g FROM (SELECT DISTINCT file, ts FROM src)),
freq AS (SELECT file, CASE WHEN count(*) < 3 THEN 'unknown' WHEN abs(median(g) - 60) < 1 THEN '1m' WHEN abs(median(g) - 300) < 1 THEN '5m' WHEN abs(median(g) - 900) < 1 THEN '15m' WHEN abs(median(g) - 1800) < 1 THEN '30m'
  WHEN abs(median(g) - 3600) < 1 THEN '1H' WHEN abs(median(g) - 14400) < 1 THEN '4H' WHEN abs(median(g) - 86400) < 1 THEN '1D' ELSE floor(median(g))::BIGINT || 's' END AS frequency FROM gaps GROUP BY file)"""
SRC = "src AS (SELECT symbol AS file, ts, close FROM bars UNION ALL SELECT 'ticks-' || symbol, ts, price FROM ticks)"


@query(with_(BARS, SRC, FREQ) + "SELECT file AS symbol, frequency FROM freq")
def infer_frequency(spark, sf):
    own, raw = bars(spark, sf).select("symbol", "ts"), ticks(spark, sf).select(F.concat(F.lit("ticks-"), "symbol").alias("symbol"), "ts")
    return prep.infer_frequency(own.union(raw))


INVENTORY = (BARS, ODD, "both_ AS (SELECT symbol || '-1' AS file, ts, open, high, low, close FROM bars UNION ALL SELECT symbol || '-2', ts, open, high, low, close FROM odd)", "src AS (SELECT file, ts FROM both_)", FREQ)


def inventory(spark, sf):
    named = lambda df, n: df.withColumn("file", F.concat("symbol", F.lit(f"-{n}"))).select("file", "ts", "open", "high", "low", "close")
    return prep.dataset_inventory(named(bars(spark, sf), 1).union(named(odd_bars(spark, sf), 2)), "parquet")


INVENTORY_SQL = """SELECT b.file, count(*) AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts,
  count(*) FILTER (open IS NULL) + count(*) FILTER (high IS NULL) + count(*) FILTER (low IS NULL) + count(*) FILTER (close IS NULL) AS missing_ohlc,
  'parquet' AS format, true AS has_ohlc, any_value(frequency) AS frequency, CASE WHEN count(*) FILTER (close IS NULL) = 0 THEN 'VALID' ELSE 'ISSUES' END AS status
FROM both_ b JOIN freq ON freq.file = b.file GROUP BY b.file"""


@query(with_(*INVENTORY) + INVENTORY_SQL)
def dataset_inventory(spark, sf):
    return inventory(spark, sf).withColumns({"first_ts": stamp("first_ts"), "last_ts": stamp("last_ts")})


@query(with_(*INVENTORY) + f"SELECT file, rows FROM ({INVENTORY_SQL}) WHERE status = 'VALID' ORDER BY rows DESC, file LIMIT 1")
def best_dataset(spark, sf):
    return prep.best_dataset(inventory(spark, sf)).select("file", "rows")


@query(with_(BARS, "n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)") + f"""SELECT b.symbol, {TS}, round(close, 6) AS close FROM bars b JOIN n ON n.symbol = b.symbol
WHERE bar_idx < CASE WHEN 604 < n THEN 604 ELSE greatest(20, floor(n * 0.7)) END""")
def train_split(spark, sf):
    return prep.train_split(bars(spark, sf), years=0.1, per_day=24).select("symbol", stamp(), *r6("close"))


@query(with_(BARS, "n AS (SELECT symbol, count(*) AS n FROM bars GROUP BY symbol)") + f"SELECT b.symbol, {TS}, round(close, 6) AS close FROM bars b JOIN n ON n.symbol = b.symbol WHERE bar_idx % greatest(1, n // 100) = 0")
def downsample(spark, sf):
    return prep.downsample(bars(spark, sf), 100).select("symbol", stamp(), *r6("close"))


