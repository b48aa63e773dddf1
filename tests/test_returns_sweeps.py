"""Hand values of returns, metrics, permutations and walk-forward."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from tests.helpers import close_to, series, values
from tickloom.operators import returns as ret
from tickloom.operators import signals as sig
from tickloom.operators import pyramid
from tickloom.operators import trades as tr
from tickloom.plans import sweep


def walk(spark, n, seed=1):
    rng, price, rows = random.Random(seed), 100.0, []
    for _ in range(n):
        before, price = price, max(1.0, price + rng.gauss(0.02, 0.8))
        rows.append((before, max(before, price) + 0.3, max(0.5, min(before, price) - 0.3), price))
    o, h, low, c = zip(*rows, strict=True)
    return series(spark, open=list(o), high=list(h), low=list(low), close=list(c))


def test_returns_without_opens(spark):
    bars = series(spark, close=[100, 110, 121], signal=[1, 1, 1]).drop("open")
    close_to(values(ret.bar_returns(bars), "strategy_return"), [None, 0.1, 0.1])


def test_first_bar_with_commission_has_no_return(spark):
    bars = series(spark, open=[99, 100, 110], close=[100, 110, 121], signal=[1, 1, 1])
    assert values(ret.bar_returns(bars, commission=0.01), "strategy_return")[0] is None


def test_prices_must_be_positive(spark):
    with pytest.raises(PySparkException, match="strictly positive"):
        ret.bar_returns(series(spark, close=[1, 0, 2], signal=[1, 1, 1])).collect()


def test_metrics(spark):
    row = ret.metrics_bar(series(spark, close=[1, 1, 1, 1], strategy_return=[0.1, -0.05, 0.02, -0.01])).first()
    assert math.isclose(row["profit_factor"], 2.0) and row["num_trades"] == 4 and row["win_rate"] == 0.5
    none = ret.metrics_bar(series(spark, close=[1, 1], strategy_return=[0.1, 0.2])).first()
    assert none["profit_factor"] == math.inf


def test_metrics_of_missing_returns_are_zero(spark):
    bars = series(spark, close=[1, 1]).withColumn("strategy_return", F.lit(None).cast("double"))
    row = ret.metrics_bar(bars).first()
    assert row["profit_factor"] == 0 and row["total_return"] == 0 and row["calmar_ratio"] == 0


def test_donchian(spark):
    bars = series(spark, close=[10, 11, 12, 11, 10, 9, 10, 11, 12])
    assert set(values(sig.sig_donchian(bars, 3), "signal")) <= {-1, 0, 1}
    with pytest.raises(ValueError):
        sig.sig_donchian(bars, 1)


def test_trades_fill_one_bar_after_the_signal(spark):
    bars = series(spark, open=[1, 2, 3, 4, 5], close=[1, 2, 3, 4, 5], signal=[0, 1, 1, 0, 0])
    row = ret.trades_from_signals(bars).first()
    assert (row["entry_bar"], row["exit_bar"], row["entry_price"], row["exit_price"]) == (2, 4, 3.0, 5.0)
    legacy = ret.trades_from_signals(bars, fill="legacy").first()
    assert (legacy["entry_bar"], legacy["exit_bar"]) == (1, 3)


@pytest.mark.parametrize("real,perms,p", [(2.0, [1.0, 2.5, 2.0], 0.75), (3.0, [2.0, 4.0, 3.0], 0.75)])
def test_p_value(spark, real, perms, p):
    df = spark.createDataFrame([("a", 0, real), *[("a", i + 1, s) for i, s in enumerate(perms)]], "symbol string, perm_id int, score double")
    row = sweep.p_value(df).first()
    assert row["p_value"] == p and not row["passed"]


def test_permutations_keep_anchors_and_geometry(spark):
    bars = walk(spark, 200)
    real = bars.orderBy("bar_idx").collect()
    rows = sweep.permute_bars(bars, 2, seed=3).orderBy("perm_id", "bar_idx").collect()
    assert len(rows) == 400
    for p in (1, 2):
        own = [r for r in rows if r["perm_id"] == p]
        assert own[0]["open"] == real[0]["open"] and own[-1]["close"] == real[-1]["close"]
        assert all(r["high"] >= max(r["open"], r["close"]) and r["low"] <= min(r["open"], r["close"]) for r in own)
        shapes = sorted(round(math.log(r["close"] / r["open"]), 9) for r in own[:-1])
        assert len(set(shapes) & {round(math.log(r["close"] / r["open"]), 9) for r in real}) > 190


def test_permutation_leaves_the_head_alone(spark):
    bars = walk(spark, 60)
    real = {r["bar_idx"]: r for r in bars.collect()}
    for r in sweep.permute_bars(bars, 1, start_index=40).collect():
        if r["bar_idx"] < 40:
            assert r["close"] == real[r["bar_idx"]]["close"]


def test_a_single_bar_is_returned_as_it_is(spark):
    bars = walk(spark, 1)
    assert sweep.permute_bars(bars, 2).select("close").distinct().collect() == bars.select("close").collect()


def test_walk_forward_length(spark):
    found = sweep.walk_forward(walk(spark, 300), sig.sig_donchian, [{"lookback": 5}, {"lookback": 10}], train=126, step=30)
    assert found.count() == 174


def test_grids():
    assert sweep.param_sets({"a": [1, 2], "b": [3]}) == [{"a": 1, "b": 3}, {"a": 2, "b": 3}]
    assert sweep.param_sets({"a": [1, 9], "b": [5]}, lambda p: p["a"] < p["b"]) == [{"a": 1, "b": 5}]
    for bad in ({"a": []}, []):
        with pytest.raises(ValueError):
            sweep.param_sets(bad)


def test_verdicts(spark):
    df = spark.createDataFrame([(0.2, 0.01, 2.0), (0.01, 0.2, 2.0), (0.01, 0.01, 1.0), (0.01, 0.01, 1.2)], "is_p_value double, wf_p_value double, oos_profit_factor double")
    assert [r["verdict"] for r in sweep.verdict(df).collect()] == ["OVERFIT", "OVERFIT", "POOR", "VALIDATED"]


def test_validation_tells_trends_from_luck(spark):
    """Long swings up and down can be followed, a random walk can't."""
    rng, price, rows = random.Random(4), 100.0, []
    for i in range(500):
        before, price = price, price * math.exp(0.02 * (1 if i // 50 % 2 else -1) + rng.gauss(0, 0.004))
        rows.append((before, max(before, price) * 1.001, min(before, price) * 0.999, price))
    o, h, low, c = zip(*rows, strict=True)
    swings = series(spark, open=list(o), high=list(h), low=list(low), close=list(c)).withColumn("symbol", F.lit("swings"))
    both = swings.unionByName(walk(spark, 500, 2))
    found = {r["symbol"]: r for r in sweep.full_validation(both, sig.sig_donchian, [{"lookback": 5}, {"lookback": 10}], 300, 50, 40, 40, digits=6).collect()}
    assert found["swings"]["verdict"] == "VALIDATED" and found["swings"]["is_p_value"] < 0.05
    assert found["a"]["verdict"] == "OVERFIT" and found["a"]["failed_step"] in ("STEP_2_IS_PERMUTATION", "STEP_4_WF_PERMUTATION")


def test_stop_and_target_on_one_bar(spark):
    bars = series(spark, open=[10, 10, 10, 10], high=[10, 10, 12, 10], low=[10, 10, 8, 10], close=[10, 10, 9, 10]).withColumn("direction", F.when(F.col("bar_idx") == 0, "long"))
    entries = tr.initial_levels(tr.candidate_entries(bars), stop_pct=10.0, target_pct=10.0)
    row = tr.first_touch_exit(entries, bars, 10, static_stop=True).first()
    assert (row["exit_bar"], row["exit_signal"], row["exit_price"]) == (2, "SL", 9.0)  # it closed below its open


def test_gap_fills_at_the_open(spark):
    bars = series(spark, open=[10, 10, 7], high=[10, 10, 7], low=[10, 10, 6], close=[10, 10, 6]).withColumn("direction", F.when(F.col("bar_idx") == 0, "long"))
    entries = tr.initial_levels(tr.candidate_entries(bars), stop_pct=10.0)
    assert tr.first_touch_exit(entries, bars, 10, static_stop=True).first()["exit_price"] == 7.0


def test_trades_last_until_a_level_trades_or_the_series_ends(spark):
    n = 900
    flat = [100.0] * n
    low = [98.0 if i == 700 else 99.5 for i in range(n)]
    bars = series(spark, open=flat, high=[100.5] * n, low=low, close=flat).withColumn("direction", F.when(F.col("bar_idx").isin(3, 750), "long"))
    bars = bars.withColumn("leaves", F.col("bar_idx") == 640)
    entries = tr.initial_levels(tr.candidate_entries(bars), stop_pct=1.0)
    found = {r["signal_bar"]: (r["exit_bar"], r["exit_signal"], r["exit_price"]) for r in tr.first_touch_exit(entries, bars, static_stop=True).collect()}
    assert found == {3: (700, "SL", 99.0), 750: (None, "Open", None)}
    found = {r["signal_bar"]: (r["exit_bar"], r["exit_signal"]) for r in tr.first_touch_exit(entries, bars, 500, static_stop=True).collect()}
    assert found == {3: (504, "Time"), 750: (None, "Open")}
    found = {r["signal_bar"]: (r["exit_bar"], r["exit_signal"]) for r in tr.custom_exit(entries, bars, "leaves").collect()}
    assert found == {3: (641, "Signal"), 750: (None, "Open")}
    trail = bars.withColumns({"high": F.when(F.col("bar_idx") == 20, 110.0).otherwise(F.col("high")), "low": F.when(F.col("bar_idx") == 620, 98.9).otherwise(F.lit(99.5))})
    found = {r["signal_bar"]: (r["exit_bar"], r["exit_signal"]) for r in tr.trailing_exit(entries, trail, 5.0, 10.0).collect()}
    assert found == {3: (620, "Trail"), 750: (None, "Open")}  # active since bar 20, 99 is reached in a later block
    found = {r["signal_bar"]: (r["exit_bar"], r["exit_signal"]) for r in tr.close_signal_exit(entries, bars.withColumn("close", F.when(F.col("bar_idx") == 666, 90.0).otherwise(F.col("close"))), stop_pct=5.0).collect()}
    assert found == {3: (667, "SL"), 750: (None, "Open")}


@pytest.mark.parametrize("bits", [1, 2, 4])
def test_blocks_do_not_change_exits(spark, monkeypatch, bits):
    monkeypatch.setattr(pyramid, "BITS", bits)
    bars = walk(spark, 120, 3).withColumn("direction", F.when(F.col("bar_idx") % 7 == 0, "long").when(F.col("bar_idx") % 7 == 3, "short"))
    rows = {r["bar_idx"]: r for r in bars.collect()}
    for r in tr.trailing_exit(tr.candidate_entries(bars), bars, 1.0, 1.0).collect():
        long, e = r["direction"] != "short", r["entry_price"]
        top, bottom, on, left = max(e, rows[r["entry_bar"]]["high"]), min(e, rows[r["entry_bar"]]["low"]), False, (None, "Open")
        for i in range(r["entry_bar"] + 1, 120):
            b = rows[i]
            top, bottom = max(top, b["high"]), min(bottom, b["low"])
            on = on or (b["high"] >= e * 1.01 if long else b["low"] <= e * (1 - 1.0 / 100.0))
            if on and (min(b["open"], b["low"]) <= top * (1 - 1.0 / 100.0) if long else max(b["open"], b["high"]) >= bottom * (1 + 1.0 / 100.0)):
                left = (i, "Trail")
                break
        assert (r["exit_bar"], r["exit_signal"]) == left


def gapped(spark, n, seed):
    """A walk with an ATR that is missing at times, long bars, ties and missing bars."""
    rng, price, rows = random.Random(seed), 100.0, []
    for i in range(n):
        o, price = price, round(price * math.exp(rng.gauss(0, 0.02)), 1)
        rows.append(("a" if i % 2 else "b", i // 2, o, max(o, price) + rng.choice([0.0, 0.0, 1.5]), min(o, price) - rng.choice([0.0, 0.0, 1.5]), price, rng.choice([None, 0.0, 0.5, 1.0, 2.0]), rng.choice(["long", "short", None])))
    rows = [r for r in rows if r[1] % 11 != 5]
    frame = spark.createDataFrame(rows, "symbol string, bar_idx long, open double, high double, low double, close double, atr double, direction string")
    return frame.withColumn("ts", F.timestamp_seconds(F.col("bar_idx") * 3600)), rows


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_first_touch_against_a_walk_over_the_bars(spark, monkeypatch, bits):
    monkeypatch.setattr(pyramid, "BITS", bits)
    bars, rows = gapped(spark, 400, bits)
    entries = tr.candidate_entries(bars, atr="atr")
    for sl, tp in ((0.0, 0.0), (3.0, 4.0), (2.5, 0.0)):
        levels = tr.initial_levels(entries, sl_atr=sl, tp_atr=tp, stop_pct=3.0, target_pct=4.0)
        for horizon in (None, 9):
            for r in tr.first_touch_exit(levels, bars, horizon, sl, tp, static_stop=True).collect():
                want, side, p = (None, "Open"), -1.0 if r["direction"] == "short" else 1.0, r["entry_price"]
                later = [x for x in rows if x[0] == r["symbol"] and x[1] > r["entry_bar"] and (horizon is None or x[1] <= r["entry_bar"] + horizon)]
                for _, i, o, h, low, c, atr, _ in later:
                    stop, target = r["stop_price"], r["target_price"]
                    if sl and atr:
                        stop, target = p - side * atr * sl, p + side * atr * tp if tp else target
                    near, far = (min(o, low), max(o, h)) if side > 0 else (-max(o, h), -min(o, low))
                    stopped, reached = stop is not None and near <= side * stop, target is not None and far >= side * target
                    if stopped or reached:
                        want = (i, "SL" if stopped and (not reached or c < o) else "PT")
                        break
                else:
                    if horizon and any(x[0] == r["symbol"] and x[1] == r["entry_bar"] + horizon for x in rows):
                        want = (r["entry_bar"] + horizon, "Time")
                assert (r["exit_bar"], r["exit_signal"]) == want


@pytest.mark.parametrize("bits", [1, 3, 6])
def test_ranges_against_all_bars(spark, monkeypatch, bits):
    monkeypatch.setattr(pyramid, "BITS", bits)
    bars, rows = gapped(spark, 500, 7)
    spans = spark.createDataFrame([(s, a, b) for s in ("a", "b", "c") for a in range(0, 250, 17) for b in (a - 1, a, a + 1, a + 7, a + 64, 249, 400)], "symbol string, _from long, _until long")
    for r in pyramid.Pyramid(bars, ("low",), ("high",)).ranges(spans).collect():
        inside = [x for x in rows if x[0] == r["symbol"] and r["_from"] <= x[1] <= r["_until"]]
        assert (r["low"], r["high"], r["_bars"]) == (min((x[4] for x in inside), default=None), max((x[3] for x in inside), default=None), len(inside))


def test_a_level_that_never_trades_costs_few_nodes(spark, monkeypatch):
    """A search reads a node a level, however many bars there are."""
    monkeypatch.setattr(pyramid, "BITS", 3)
    bars = spark.range(5000).select(F.lit("a").alias("symbol"), F.col("id").alias("bar_idx"), F.lit(1.0).alias("low"))
    tree = pyramid.Pyramid(bars, ("low",))
    read = spark.sparkContext.accumulator(0)
    met = pyramid.Pyramid._met

    def counted(self, *args):
        out = met(self, *args)
        read.add(out.filter("parts IS NOT NULL").count())
        return out

    monkeypatch.setattr(pyramid.Pyramid, "_met", counted)
    searches = bars.filter("bar_idx % 100 = 3").select("symbol", F.col("bar_idx").alias("_from"), F.lit(10**9).alias("_until"))
    assert tree.first(searches, lambda x, m: x["low"] < 0.5).filter("_at IS NOT NULL").count() == 0
    assert tree.levels == 5 and read.value <= 5 * 50


def test_one_position_at_a_time_and_chained_sizes(spark):
    rows = [(k, i, i + 1, 10.0 + i % 3, (i + 4 if i % 5 else None), 11.0 if i % 5 else None, i % 2 == 0, "short" if i % 3 == 0 else "long") for k in ("a", "b") for i in range(40)]
    trades = spark.createDataFrame(rows, "symbol string, signal_bar long, entry_bar long, entry_price double, exit_bar long, exit_price double, fills_at_open boolean, direction string")
    taken = tr.resolve_overlaps(trades.filter("signal_bar % 5 <> 0 OR signal_bar > 20"))
    got = {k: sorted(r["signal_bar"] for r in taken.collect() if r["symbol"] == k) for k in ("a", "b")}
    want, free = [], 0
    for _, i, _, _, out, _, at_open, _ in rows[:40]:
        if (i % 5 or i > 20) and i >= free:
            want.append(i)
            free = 10**9 if out is None else out if at_open else out + 1
    assert got == {"a": want, "b": want}
    sized = tr.size_and_pnl(taken, 500.0, 50.0, 1.0).filter("symbol = 'b'").orderBy("trade_id").collect()
    cash, ids = 500.0, 0
    by_bar = {r[1]: r for r in rows[40:]}
    for i in want:
        _, _, _, price, _, out, _, side = by_bar[i]
        qty = math.floor(cash * 0.5 / price)
        if qty > 0:
            r = sized[ids]
            ids += 1
            fees = (qty * price + (qty * out if out else 0.0)) * 0.01
            pnl = None if out is None else (1 if side == "long" else -1) * (qty * out - qty * price) - fees
            cash += pnl or 0.0
            assert (r["trade_id"], r["signal_bar"], r["qty"]) == (ids, i, qty) and math.isclose(r["cash_after"], cash) and (r["pnl"] is None) == (pnl is None)
    assert ids == len(sized)


def test_empty_bars_give_empty_results(spark):
    empty = series(spark, close=[1.0]).limit(0)
    assert ret.metrics_bar(ret.bar_returns(sig.sig_donchian(empty))).count() == 0
    assert sweep.permute_bars(empty, 3).count() == 0
    assert ret.trades_from_signals(sig.sig_donchian(empty)).count() == 0


def test_overlaps_by_pointers_are_those_of_a_walk(spark):
    rng, rows = random.Random(5), []
    for symbol, longest, n in (("A", 4, 300), ("B", 40, 300), ("C", 2, 1), ("D", 3000, 200)):
        for bar in sorted(rng.sample(range(600), n)):
            leaves = bar + rng.randint(1, longest)
            rows.append((symbol, bar, None if leaves > 590 else leaves, rng.random() < 0.5))
    rows.append(("A", None, 5, True))
    trades = spark.createDataFrame(rows, "symbol string, signal_bar long, exit_bar long, fills_at_open boolean").withColumn("bar_idx", F.lit("x"))
    want, free = [], {}
    for symbol, bar, leaves, at_open in rows:
        if bar is not None and bar >= free.get(symbol, -1):
            want.append((symbol, bar))
            free[symbol] = math.inf if leaves is None else leaves + (not at_open)
    found = tr.resolve_overlaps(trades)
    assert sorted((r["symbol"], r["signal_bar"]) for r in found.collect()) == sorted(want) and found.columns == ["symbol", "signal_bar", "exit_bar", "fills_at_open", "bar_idx"]
    assert tr.resolve_overlaps(trades.limit(0)).count() == 0


@pytest.mark.parametrize("train,step,lookbacks,opens", [(60, 20, (2, 5, 30), True), (40, 7, (3, 39, 40, 55), True), (25, 1, (4, 9), False), (10, 50, (2, 3), True), (200, 20, (5, 8), True)])
def test_fold_scores_from_running_sums_are_those_of_copied_bars(spark, train, step, lookbacks, opens):
    bars = walk(spark, 150, seed=train).withColumn("close", F.when(F.col("bar_idx") != 77, F.col("close"))).withColumn("fold", F.lit("kept"))
    bars = bars.unionByName(walk(spark, 90, seed=step).withColumns({"symbol": F.lit("other"), "fold": F.lit("kept")}))
    bars = bars if opens else bars.drop("open")
    params = [{"lookback": n} for n in lookbacks]
    want = sweep.scores(sweep.wf_folds(bars, train, step), sig.sig_donchian, params, key=("symbol", "fold_id"), digits=6)
    found = sweep.fold_scores(bars, sig.sig_donchian, params, train, step, digits=6)
    rows = lambda df: sorted(tuple(r) for r in df.select("symbol", "fold_id", "param_id", "score").collect())
    assert rows(found) == rows(want)
    assert bool(rows(want)) == (train < 150)
