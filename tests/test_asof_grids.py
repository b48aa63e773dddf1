"""Values as of a time, grids made together, bucketed bars and long reports."""

from __future__ import annotations

import uuid
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tests.helpers import close_to, series, values
from tests.test_blocks import bars
from tickloom.operators import prep, reconcile
from tickloom.operators import returns as ret
from tickloom.operators import signals as sig
from tickloom.operators.asof import as_of
from tickloom.plans import sweep
from tickloom.sources import sinks

DAY0 = datetime(2024, 1, 1)


def known(spark, *days):
    return spark.createDataFrame([("a", None if d is None else DAY0 + timedelta(days=d), v) for d, v in days], "symbol string, ts timestamp, v int")


@pytest.mark.parametrize(
    ("direction", "equal", "wanted"),
    [("backward", True, [None, 1, 1, 3]), ("backward", False, [None, None, 1, 1]), ("forward", True, [1, 1, 3, 3]), ("forward", False, [1, 3, 3, None])],
)
def test_as_of(spark, direction, equal, wanted):
    own = series(spark, close=[1, 2, 3, 4])
    found = as_of(own, known(spark, (1, 1), (3, 3), (None, 9)), ("v",), direction=direction, equal=equal)
    assert values(found, "v") == wanted and found.columns == [*own.columns, "v"]


def test_as_of_without_time_or_key(spark):
    own = series(spark, close=[1, 2])
    other = known(spark, (0, 5)).unionByName(known(spark, (0, 7)).withColumn("symbol", F.lit(None).cast("string")))
    odd = own.withColumn("ts", F.when(F.col("bar_idx") == 1, F.col("ts"))).withColumn("symbol", F.when(F.col("bar_idx") == 0, F.col("symbol")))
    assert values(as_of(odd, other, ("v",)), "v") == [None, None]
    assert values(as_of(own, other.limit(0), ("v",)), "v") == [None, None]
    assert as_of(own.limit(0), other, ("v",)).count() == 0
    with pytest.raises(ValueError, match="direction"):
        as_of(own, other, ("v",), direction="nearest")


def test_a_thousand_splits_are_one_pass(spark):
    own = series(spark, close=[float(2**10)] * 20)
    splits = spark.range(1000).select(F.lit("a").alias("symbol"), (F.lit(DAY0) + F.make_interval(hours=F.col("id").cast("int") + 240)).alias("split_ts"), F.lit(1.001).alias("ratio"))
    found = prep.split_adjust(own, splits)
    left = [sum(1 for h in range(240, 1240) if h > 24 * day) for day in range(20)]
    close_to(values(found, "close"), [1024 / 1.001**n for n in left])
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_grid_gives_the_signals_of_single_sets(spark):
    own, params = bars(spark, 150, gaps=(60,)), [{"lookback": n} for n in (2, 3, 4, 7, 8, 9, 31, 32, 64, 65, 149, 200)]
    together = sweep.sweep(own, sig.sig_donchian, params)
    apart = own
    for i, p in enumerate(params):
        apart = sig.sig_donchian(apart, out=f"s{i}", **p)
    wanted = {r["bar_idx"]: [r[f"s{i}"] for i in range(len(params))] for r in apart.collect()}
    found = together.select("bar_idx", "param_id", "signal").collect()
    assert len(found) == 150 * len(params)
    assert all(r["signal"] == wanted[r["bar_idx"]][r["param_id"]] for r in found)
    assert together.columns == [*own.columns, "param_id", "signal"]


def test_grid_of_256_has_few_windows(spark):
    found = sweep.sweep(bars(spark, 50), sig.sig_donchian, [{"lookback": n} for n in range(2, 258)])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("windowspecdefinition(") < 20
    with pytest.raises(ValueError, match="lookback"):
        sweep.sweep(bars(spark, 50), sig.sig_donchian, [{"lookback": n} for n in range(1, 20)])


def test_bucketed_bars_need_no_shuffle(spark, tmp_path):
    name = f"bars_{uuid.uuid4().hex}"
    sinks.write_bucketed_bars(sig.sig_donchian(bars(spark, 100), 10), name, str(tmp_path / "bars"), buckets=4)
    try:
        found = ret.metrics_bar(ret.bar_returns(spark.table(name)))
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        wanted = ret.metrics_bar(ret.bar_returns(sig.sig_donchian(bars(spark, 100), 10)))
        close_to(list(found.first())[1:], list(wanted.first())[1:])
    finally:
        spark.sql(f"DROP TABLE {name}")


def test_p_value_passes_over_missing_scores(spark):
    rows = [("a", 0, 2.0), ("a", 1, 2.0), ("a", 2, 1.0), ("a", 3, None), ("b", 0, None), ("b", 1, 1.0)]
    found = {r["symbol"]: r for r in sweep.p_value(spark.createDataFrame(rows, "symbol string, perm_id int, score double")).collect()}
    assert (found["a"]["n_perms"], found["a"]["p_value"]) == (2, pytest.approx(2 / 3))
    assert (found["b"]["n_perms"], found["b"]["p_value"], found["b"]["real_score"]) == (1, 0.5, None)


def test_long_reports_say_what_they_leave_out(spark):
    summary = spark.createDataFrame([("a", False, "number 1 differs in pnl", 5, 1, 4, 1.0, 2.0, -1.0)], "symbol string, passed boolean, message string, compared int, matched int, mismatched int, our_total_pnl double, their_total_pnl double, pnl_difference double")
    compared = spark.createDataFrame([("a", i, i == 4, [] if i == 4 else ["pnl"]) for i in range(5)], "symbol string, trade_idx long, matched boolean, differences array<string>")
    text = reconcile.reconcile_report(summary, compared, most=2).first()["report"].split("\n")
    assert text[-3:] == ["  number 1 differs in pnl", "  number 2 differs in pnl", "  and 2 more"] and len(text) == 6
    lines = reconcile.reconcile_lines(summary, compared).orderBy("section", "trade_idx").collect()
    assert [r["line"] for r in lines][:3] == text[:3] and len(lines) == 7
