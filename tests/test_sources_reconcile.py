"""Hand values of readers and of reconciliation."""

from __future__ import annotations

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tickloom.operators import prep, reconcile
from tickloom.sources import bars as src
from tickloom.sources.layouts import layouts

OURS = "symbol string, entry_time timestamp, exit_time timestamp, entry_price double, exit_price double, exit_signal string, pnl double, entry_bar long"
THEIRS = OURS.replace(", entry_bar long", "")


def write(tmp_path, text, name="bars.csv"):
    (tmp_path / name).write_text(text)
    return str(tmp_path / name)


@pytest.mark.parametrize("sep", [",", "\t", ";"])
def test_delimited_bars(spark, tmp_path, sep):
    text = "Date,Open,High,Low,Close,Volume\n2024-01-01,100,105,95,102,1000\n2024-01-02,102,107,100,105,1200\n".replace(",", sep)
    rows = src.read_bars_csv(spark, write(tmp_path, text)).orderBy("ts").collect()
    assert [r["close"] for r in rows] == [102.0, 105.0] and rows[0]["ts"] == datetime(2024, 1, 1)


def test_adjusted_close_and_missing_volume(spark, tmp_path):
    row = src.read_bars_csv(spark, write(tmp_path, "Date,Open,High,Low,Adj Close\n2024-01-01,1,3,0.5,2\n")).first()
    assert row["close"] == 2.0 and row["volume"] == 0.0


def test_the_delimiter_is_sought_in_2048_characters(spark, tmp_path):
    """Short lines: more than fifty of them count."""
    text = "o;h;l;c\n" + "1,5\n" * 4 + "1;2;0;1\n" * 300
    seps = lambda *args: [x.sep for x in layouts(spark, write(tmp_path, *args))]
    assert seps(text) == [";"]
    assert seps("a,b\n" + ",\n" * 60 + ";;;;;\n" * 200, "b.csv") == [";"]
    assert seps("", "c.csv") == []
    strict = src.read_bars_strict(spark, write(tmp_path, "date;open;high;low;close\n2024-01-01;1;2;0.5;1.5\n", "d.csv"))
    assert strict.first()["close"] == 1.5


def test_rows_without_a_time_are_numbered(spark):
    df = spark.range(0, 1000, 1, 7).select(*[F.col("id").cast("double").alias(c) for c in ("open", "high", "low", "close")])
    assert [(r["ts"], r["close"]) for r in src.resolve_columns(df).orderBy("ts").collect()] == [(i, float(i)) for i in range(1000)]
    assert src.resolve_columns(df.limit(0)).count() == 0


def test_each_file_is_read_by_its_own_heading(spark, tmp_path):
    """Swapped columns, other delimiters, other names, no volume, a quoted heading, an empty file, names with odd signs."""
    write(tmp_path, "Date,Open,High,Low,Close,Volume\n2024-01-01,1,2,0.5,1.5,10\n", "a.csv")
    write(tmp_path, "Date,Close,Open,High,Low\n2024-01-02,1.5,1,2,0.5\n", "b [1] 100%+.csv")
    write(tmp_path, "L;H;O;C;Time;v\r\n0.5;2;1;1.5;2024-01-03;7\r\n", "c.csv")
    write(tmp_path, '\n"close_price"\t"open_price"\t"low_price"\t"high_price"\t"timestamp"\n1.5\t1\t0.5\t2\t2024-01-04\n', "d.csv")
    write(tmp_path, "Date,Close,Open,High,Low\n2024-01-05,1.5,1,2,0.5\n2024-01-06,x,1,2,0.5\n", "e.csv")
    write(tmp_path, "", "f.csv")
    rows = src.read_bars_csv(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r["ts"].day for r in rows] == [1, 2, 3, 4, 5]
    assert {(r["open"], r["high"], r["low"], r["close"]) for r in rows} == {(1.0, 2.0, 0.5, 1.5)}
    assert [r["volume"] for r in rows] == [10.0, 0.0, 7.0, 0.0, 0.0]
    found = layouts(spark, str(tmp_path))
    assert sorted(len(x.files) for x in found) == [1, 1, 1, 2]
    strict = src.read_bars_strict(spark, str(tmp_path)).orderBy("ts").collect()
    assert [r["close"] for r in strict] == [1.5] * 5


def test_folders_that_name_columns(spark, tmp_path):
    for symbol, text in (("A", "Date,Open,High,Low,Close\n2024-01-01,1,2,0.5,1.5\n"), ("B", "Close;Open;High;Low;Date\n1.5;1;2;0.5;2024-01-01\n")):
        (tmp_path / f"symbol={symbol}").mkdir()
        write(tmp_path / f"symbol={symbol}", text)
    rows = src.read_bars_csv(spark, str(tmp_path), keep=("symbol",)).orderBy("symbol").collect()
    assert [(r["symbol"], r["open"], r["close"]) for r in rows] == [("A", 1.0, 1.5), ("B", 1.0, 1.5)]


def test_trade_lists_of_several_headings(spark, tmp_path):
    write(tmp_path, "Entry Time,Exit Time,Entry Price,Exit Price,Profit\n01/02/2024 10:00,01/02/2024 11:00,1,2,5\n", "a.csv")
    write(tmp_path, "exit,entry,exit_date,entry_date,type\n2,1,2024-01-03 11:00,2024-01-03 10:00,SL\n", "b.csv")
    rows = src.read_external_trades(spark, str(tmp_path)).orderBy("entry_time").collect()
    assert [(r["entry_price"], r["exit_price"], r["pnl"], r["exit_signal"]) for r in rows] == [(1.0, 2.0, 5.0, None), (1.0, 2.0, 0.0, "SL")]
    assert [r["entry_time"].day for r in rows] == [2, 3]


def test_missing_prices_are_named(spark, tmp_path):
    with pytest.raises(ValueError, match="Missing"):
        src.read_bars_csv(spark, write(tmp_path, "foo,bar\n1,2\n"))


def test_strict_reader_needs_a_time(spark, tmp_path):
    path = write(tmp_path, "when,open,high,low,close\n2024-01-01 10:00:00,1,2,0.5,1.5\n")
    with pytest.raises(ValueError, match="time column"):
        src.read_bars_strict(spark, path)
    assert src.read_bars_strict(spark, path, unlabelled=True).first()["ts"] == datetime(2024, 1, 1, 10)


@pytest.mark.parametrize("raw", [["1581712200", "1581712260"], ["1581712200000", "1581712260000"], ["2020-02-14 20:30:00", "2020-02-14 20:31:00"]])
def test_mixed_timestamps(spark, raw):
    df = spark.createDataFrame([(r,) for r in raw], "raw string")
    assert src.parse_mixed_timestamps(df, "raw").orderBy("ts").first()["ts"] == datetime(2020, 2, 14, 20, 30)


def test_trade_times_prefer_the_month(spark):
    df = spark.createDataFrame([("03/04/2024 10:00",), ("13/04/2024",), ("2024-01-02",), ("soon",)], "t string")
    found = [r[0] for r in df.select(src.parse_trade_datetime(F.col("t"))).collect()]
    assert found == [datetime(2024, 3, 4, 10), datetime(2024, 4, 13), datetime(2024, 1, 2), None]


def test_frequency(spark):
    start = datetime(2024, 1, 1)
    df = spark.createDataFrame([("a", start + timedelta(hours=i)) for i in range(5)] + [("b", start)], "symbol string, ts timestamp")
    assert {r["symbol"]: r["frequency"] for r in prep.infer_frequency(df).collect()} == {"a": "1H", "b": "unknown"}


def test_splits_compound(spark):
    start = datetime(2024, 1, 1)
    bars = spark.createDataFrame([("a", start + timedelta(days=i), 12.0, 12.0, 12.0, 12.0, 1.0) for i in range(3)], "symbol string, ts timestamp, open double, high double, low double, close double, volume double")
    splits = spark.createDataFrame([("a", start + timedelta(days=1), 2.0), ("a", start + timedelta(days=2), 3.0)], "symbol string, split_ts timestamp, ratio double")
    assert [r["close"] for r in prep.split_adjust(bars, splits).orderBy("ts").collect()] == [2.0, 4.0, 12.0]


def pair(spark, exit_price, reason, pnl):
    t = datetime(2025, 1, 2, 10)
    ours = spark.createDataFrame([("a", t, t + timedelta(hours=2), 100.0, 95.0, "SL", -5.0, 10)], OURS)
    theirs = spark.createDataFrame([("a", t, t + timedelta(hours=2), 100.0, exit_price, reason, pnl)], THEIRS)
    return ours, theirs, reconcile.compare_trades(reconcile.match_trades(ours, theirs))


def test_stop_against_target(spark):
    ours, theirs, found = pair(spark, 105.0, "PT", 5.0)
    counts = {r["category"]: r["n"] for r in reconcile.mismatch_breakdown(found).collect()}
    assert counts["exit_signal_mismatch"] == 1 and counts["stop_target_fill_mismatch"] == 1
    first = reconcile.first_divergence(found).first()
    assert first["trade_number"] == 1 and first["our_entry_bar"] == 10
    assert not reconcile.reconcile_summary(ours, theirs, found).first()["passed"]


def test_equal_trades_pass(spark):
    ours, theirs, found = pair(spark, 95.005, "stop", -5.05)
    row = reconcile.reconcile_summary(ours, theirs, found).first()
    assert row["passed"] and row["message"] == "1 trades agree"
    assert reconcile.mismatch_breakdown(found).count() == 0


def test_hours_outside_the_bars(spark):
    start = datetime(2025, 1, 2)
    theirs = spark.createDataFrame([("a", start + timedelta(days=i, hours=1)) for i in range(24)], "symbol string, entry_time timestamp")
    bars = spark.createDataFrame([("a", start + timedelta(days=i, hours=h)) for i in range(24) for h in range(13, 21)], "symbol string, ts timestamp")
    row = reconcile.session_coverage(theirs, bars).first()
    assert row["outside_pct"] == 100.0 and "absent from the bars" in row["blocker"]
