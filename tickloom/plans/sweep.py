"""Grid search, bar permutation and walk-forward tests.

Parameters, permutations and folds are key columns, so a whole study is one plan. A strategy is a function
``f(df, key=..., out=..., **params) -> df`` that adds a signal column by windows over the key.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEY, OHLC, Key, ordered, so_far, whole
from ..operators.returns import bar_returns, metrics_bar

Strategy = Callable[..., DataFrame]
Params = Sequence[Mapping[str, object]]

ALPHA, WEAK_FACTOR = 0.05, 1.1

#: Sets from which on a strategy that can makes them together; below, windows of their own are the smaller plan.
SHARED = 8


def param_sets(grid: Mapping[str, Iterable] | Params, allowed: Callable[[Mapping], bool] | None = None) -> list[dict]:
    """All combinations in key order, or a list of sets as it is; ``allowed`` leaves out combinations that make no sense."""
    if isinstance(grid, Mapping):
        values = [list(v) for v in grid.values()]
        if not all(values):
            raise ValueError("each parameter needs a value at least")
        found = [dict(zip(grid, combo, strict=True)) for combo in itertools.product(*values)]
    else:
        found = [dict(p) for p in grid]
        if not found:
            raise ValueError("there must be a set of parameters at least")
    return [p for p in found if allowed is None or allowed(p)]


def expand_grid(values: Mapping[str, DataFrame]) -> DataFrame:
    """The same over one-column frames of values: ``param_id`` follows the order of the product."""
    out, total = None, F.lit(0)
    for name, frame in values.items():
        own = frame.select(F.col(frame.columns[0]).alias(name)).distinct()
        listed = own.agg(F.sort_array(F.collect_set(name)).alias("_all")).select(F.posexplode("_all").alias(f"_{name}", name), F.size("_all").alias(f"_n_{name}"))
        out = listed if out is None else out.crossJoin(listed)  # the product is the result; each side is a list of values
        total = total * F.col(f"_n_{name}") + F.col(f"_{name}")
    return out.select(total.cast("long").alias("param_id"), *values)


def sweep(bars: DataFrame, strategy: Strategy, params: Params, key: Key = KEY) -> DataFrame:
    """Bars times parameter sets: ``param_id`` and ``signal``. All sets share the bars' one shuffle and sort.

    A strategy with an attribute ``grid`` makes the signals of many sets together: ``grid(bars, params, key)`` gives these
    rows, or None where it can't."""
    shared = getattr(strategy, "grid", None)
    found = shared(bars, params, key) if shared and len(params) >= SHARED else None
    if found is not None:
        return found
    out = bars
    for i, p in enumerate(params):
        out = strategy(out, key=key, out=f"_sig_{i}", **p)
    signals = F.array(*[F.col(f"_sig_{i}") for i in range(len(params))])
    return out.select(*bars.columns, F.posexplode(signals).alias("param_id", "signal"))


def scores(bars: DataFrame, strategy: Strategy, params: Params, metric: str = "profit_factor", key: Key = KEY, digits: int | None = None) -> DataFrame:
    """``score`` of each series and parameter set; ``digits`` rounds it, which settles ties."""
    by = [*key, "param_id"]
    found = metrics_bar(bar_returns(sweep(bars, strategy, params, key), key=by), key=by)
    score = F.col(metric).cast("double")
    if digits is not None:
        score = F.when(F.abs(score) < float("inf"), F.round(score, digits)).otherwise(score)
    return found.select(*by, score.alias("score"))


def best(scored: DataFrame, key: Key = KEY) -> DataFrame:
    """The best set of each series; the first of equals wins, missing scores don't take part."""
    valid = scored.filter(F.col("score").isNotNull() & ~F.isnan("score"))
    return valid.groupBy(*key).agg(F.max(F.struct("score", (-F.col("param_id")).alias("rank"))).alias("_b")).select(*key, (-F.col("_b.rank")).alias("param_id"), F.col("_b.score").alias("score"))


def param_label(params: Params, param_id: str = "param_id") -> Column:
    """A set as text, for reports."""
    labels = F.array(*[F.lit(",".join(f"{k}={v}" for k, v in p.items())) for p in params])
    return F.get(labels, F.col(param_id))


def grid_search(bars: DataFrame, strategy: Strategy, params: Params, metric: str = "profit_factor", key: Key = KEY, digits: int | None = None) -> DataFrame:
    """``param_id``, ``params`` and ``score`` of the best set of each series; series without a valid score have no row."""
    return best(scores(bars, strategy, params, metric, key, digits), key).withColumn("params", param_label(params))


def permute_bars(bars: DataFrame, n_perms: int, seed: int = 7, start_index: int = 0, include_real: bool = False, key: Key = KEY) -> DataFrame:
    """Permutations ``perm_id`` 1 to n of each series (0: the series itself, if asked for).

    Shapes of bars and the gaps between them are shuffled separately, in the order of a hash; the first open and the last
    close stay, high and low are repaired, and bars before ``start_index`` are left alone. Each bar deals three cards
    (its place, its shape, its gap) which are numbered and put together within one partitioning by series and permutation.
    """
    if start_index < 0:
        raise ValueError("start_index must not be negative")
    positive = F.lit(True)
    for c in OHLC:
        positive = positive & (F.col(c) > 0) & (F.col(c) < float("inf"))
    checked = bars.withColumn("open", F.when(F.coalesce(positive, F.lit(False)), F.col("open")).otherwise(F.raise_error(F.lit("prices must be strictly positive and finite"))))
    logs = {f"_{c}": F.ln(c) for c in OHLC}
    before = F.lag("_close").over(ordered(key))
    own = checked.withColumns(logs).withColumn("_gap", F.col("_open") - before).withColumn("_n", F.count(F.lit(1)).over(whole(key)))
    tail = own.filter((F.col("bar_idx") >= start_index) & (F.col("_n") - start_index > 1))
    by = [*key, "perm_id"]
    dealt = tail.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n_perms)))).repartition(*by)
    order = lambda kind: F.md5(F.concat_ws("|", F.lit(seed), "perm_id", F.lit(kind), "bar_idx"))
    keep = [c for c in bars.columns if c not in (*key, *OHLC)]
    slot = F.struct(*[F.col(c) for c in keep], F.col("_open"), F.col("_close"), *[F.col(c).alias(f"real_{c}") for c in OHLC])
    shape = F.struct((F.col("_high") - F.col("_open")).alias("h"), (F.col("_low") - F.col("_open")).alias("l"), (F.col("_close") - F.col("_open")).alias("c"))
    card = lambda kind, rank, **parts: F.struct(F.lit(kind).alias("kind"), rank.alias("rank"), *[parts[p].alias(p) if p in parts else F.lit(None).cast(t).alias(p) for p, t in types.items()])
    types = {"slot": tail.select(slot.alias("x")).schema[0].dataType, "shape": tail.select(shape.alias("x")).schema[0].dataType, "gap": "double"}
    cards = F.array(
        card("slot", F.lpad(F.col("bar_idx").cast("string"), 12, "0"), slot=slot), card("shape", order("bar"), shape=shape),
        card("gap", F.when(F.col("bar_idx") > start_index, order("gap")), gap=F.col("_gap")),
    )
    numbered = dealt.select(*by, F.explode(cards).alias("k")).select(*by, "k.*").filter("rank IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(*by, "kind").orderBy("rank")) - 1 + F.when(F.col("kind") == "gap", 1).otherwise(0)
    joined = numbered.withColumn("pos", place).groupBy(*by, "pos").agg(F.max("slot").alias("slot"), F.max("shape").alias("shape"), F.max("gap").alias("gap"))
    w = Window.partitionBy(*by).orderBy("pos")
    moved = joined.withColumn("_step", F.when(F.col("pos") == 0, F.col("slot._open")).otherwise(F.lag("shape.c").over(w) + F.col("gap")))
    moved = moved.withColumns({"_o": F.sum("_step").over(w.rowsBetween(Window.unboundedPreceding, 0)), "_last": F.lead("pos").over(w).isNull()})
    opened = F.when(F.col("pos") == 0, F.col("slot.real_open")).otherwise(F.exp("_o"))
    closed = F.when(F.col("_last"), F.col("slot.real_close")).otherwise(F.exp(F.col("_o") + F.col("shape.c")))
    made = moved.withColumns({"open": opened, "close": closed})
    made = made.withColumns({
        "high": F.greatest(F.exp(F.col("_o") + F.col("shape.h")), "open", "close"), "low": F.least(F.exp(F.col("_o") + F.col("shape.l")), "open", "close"),
        **{c: F.col(f"slot.{c}") for c in keep},
    })
    columns = [*bars.columns, "perm_id"]
    out = made.select(*columns)
    fixed = own.filter((F.col("bar_idx") < start_index) | (F.col("_n") - start_index <= 1))
    head = fixed.withColumn("perm_id", F.explode(F.sequence(F.lit(1), F.lit(n_perms))))
    out = out.unionByName(head.select(*columns))
    return out.unionByName(bars.withColumn("perm_id", F.lit(0)).select(*columns)) if include_real else out


def p_value(scored: DataFrame, score: str = "score", key: Key = KEY, alpha: float = ALPHA) -> DataFrame:
    """From scores by ``perm_id`` (0: the real one): share of permutations at least as good, the real one counted in."""
    real = F.max(F.when(F.col("perm_id") == 0, F.col(score))).over(whole(key))
    drawn = F.when(F.col("perm_id") > 0, F.col(score))
    sums = scored.withColumns({"_real": real, "_drawn": drawn}).groupBy(*key).agg(
        F.max("_real").alias("real_score"), F.count("_drawn").alias("n_perms"), F.count_if(F.col("_drawn") >= F.col("_real")).alias("_better")
    )
    p = (1 + F.col("_better")) / (1 + F.col("n_perms"))
    return sums.select(*key, "real_score", "n_perms", p.alias("p_value"), (p < alpha).alias("passed"))


def is_perm_test(bars: DataFrame, strategy: Strategy, params: Params, n_perms: int, seed: int = 7, metric: str = "profit_factor", key: Key = KEY, digits: int | None = None) -> DataFrame:
    """In-sample permutation test: optimise the series and each permutation of it; ``param_id`` is the series' best."""
    if n_perms <= 0:
        raise ValueError("there must be a permutation at least")
    by = [*key, "perm_id"]
    found = grid_search(permute_bars(bars, n_perms, seed, include_real=True, key=key), strategy, params, metric, by, digits)
    chosen = F.max(F.when(F.col("perm_id") == 0, F.col("param_id"))).alias("param_id")
    return p_value(found, key=key).join(found.groupBy(*key).agg(chosen), list(key))


def wf_folds(bars: DataFrame, train: int, step: int, key: Key = KEY) -> DataFrame:
    """Training rows of each fold: fold k learns from ``train`` bars on from k * step and is applied to the ``step`` after
    them. ``bar_idx`` starts anew in each fold; ``source_idx`` is the bar's own."""
    i, n = F.col("bar_idx"), F.count(F.lit(1)).over(whole(key))
    folds = F.ceil((F.col("_n") - train) / step)
    low = F.greatest(F.lit(0), F.ceil((i - train + 1) / step)).cast("long")
    high = F.least(F.floor(i / step), folds - 1).cast("long")
    rows = bars.withColumn("_n", n).withColumns({"_low": low, "_high": high}).filter("_low <= _high")
    rows = rows.withColumn("fold_id", F.explode(F.sequence("_low", "_high"))).withColumn("source_idx", i)
    return rows.withColumn("bar_idx", i - F.col("fold_id") * step).drop("_n", "_low", "_high")


def fold_scores(bars: DataFrame, strategy: Strategy, params: Params, train: int, step: int, key: Key = KEY, digits: int | None = None) -> DataFrame:
    """``score`` (profit factor) of each series, fold and set, as of ``scores`` over ``wf_folds``, without a copy of the bars for
    each fold: a row for each bar and set.

    For strategies that say how far they look back (``memory(**params)``, bars) and on which bars they decide anew
    (``decided(df, key=..., out=..., **params)``, a Boolean column); before the first decision they are flat. From the first
    decision in a fold on, signals are those of the whole series, so gains and losses are differences of running sums. Only the
    bar after that decision is another: the fold enters there from flat. Returns must be finite.
    """
    by, n_sets = [*key, "param_id"], range(len(params))
    out = bars.withColumn("_n", F.count(F.lit(1)).over(whole(key)))
    for i, p in enumerate(params):
        out = strategy.decided(strategy(out, key=key, out=f"_sig_{i}", **p), key=key, out=f"_set_{i}", **p)
    sets = F.array(*[F.struct(F.col(f"_sig_{i}").alias("signal"), F.col(f"_set_{i}").alias("_set"), F.lit(strategy.memory(**params[i])).cast("long").alias("_memory")) for i in n_sets])
    prices = [c for c in ("open", "close") if c in bars.columns]
    rows = out.select(*key, "bar_idx", *prices, "_n", F.posexplode(sets).alias("param_id", "_p")).select("*", "_p.*").drop("_p")
    r, w = F.col("strategy_return"), ordered(by)
    rows = bar_returns(rows, key=by)
    entry = r
    if "open" in prices:
        entry = F.when(F.col("active") != 0, F.col("active") * F.try_divide(F.col("close") - F.col("open"), F.col("open")))
    parts = {"gain": F.when(r > 0, r).otherwise(0.0), "loss": F.when(r < 0, -r).otherwise(0.0), "wins": F.when(r > 0, 1).otherwise(0), "losses": F.when(r < 0, 1).otherwise(0)}
    rows = rows.withColumn("_entry", entry).withColumns({f"_{c}": F.sum(x).over(so_far(by)) for c, x in parts.items()})
    sums = F.struct(*[F.col(f"_{c}").alias(c) for c in parts])
    rows = rows.withColumn("_entered", F.lead(F.struct("bar_idx", sums.alias("sums"), F.col("_entry").alias("r"))).over(w))
    # Backwards from the last bar: the nearest decision from this bar on.
    back = Window.partitionBy(*by).orderBy(F.col("bar_idx").desc()).rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_first", F.last(F.when(F.col("_set"), F.struct(F.col("_entered").alias("at"))), ignorenulls=True).over(back))
    folds, begins, ends = F.ceil((F.col("_n") - train) / step), F.col("bar_idx") - F.col("_memory"), F.col("bar_idx") - (train - 1)

    def event(at: Column, first: Column, last: Column) -> Column:
        fold = F.floor(at / step)
        return F.when((at >= 0) & (at % step == 0) & (fold < folds), F.struct(fold.alias("fold_id"), first.alias("first"), last.alias("last")))

    none_first, none_last = F.when(F.lit(False), F.col("_first.at")), F.when(F.lit(False), sums)
    events = rows.select(*by, F.explode(F.array(event(begins, F.col("_first.at"), none_last), event(ends, none_first, sums))).alias("_e")).filter("_e IS NOT NULL").select(*by, "_e.*")
    met = events.groupBy(*key, "fold_id", "param_id").agg(F.max("first").alias("first"), F.max("last").alias("last"))
    inside, own = F.col("first.bar_idx") <= F.col("fold_id") * step + train - 1, F.col("first.r")
    change = {"gain": F.greatest(own, F.lit(0.0)), "loss": F.greatest(-own, F.lit(0.0)), "wins": (own > 0).cast("int"), "losses": (own < 0).cast("int")}
    met = met.withColumns({f"_{c}": F.when(inside, F.col(f"last.{c}") - F.col(f"first.sums.{c}") + F.coalesce(x, F.lit(0))) for c, x in change.items()})
    score = F.when(F.col("_losses") > 0, F.when(F.col("_wins") > 0, F.try_divide("_gain", "_loss")).otherwise(0.0)).when(F.col("_wins") > 0, F.lit(float("inf"))).otherwise(0.0)
    if digits is not None:
        score = F.when(score < float("inf"), F.round(score, digits)).otherwise(score)
    return met.select(*key, "fold_id", "param_id", score.alias("score"))


def walk_forward(bars: DataFrame, strategy: Strategy, params: Params, train: int, step: int = 30, metric: str = "profit_factor", key: Key = KEY, digits: int | None = None, reoptimise: bool = True) -> DataFrame:
    """Out-of-sample returns: each block of ``step`` bars acts on the set that was best on the ``train`` bars before it.

    Signals of the applied block see the whole history (they look back only), those of the training start in its slice.
    With one set, or ``reoptimise=False`` (the first set), nothing is optimised. Series of ``train`` bars or fewer give no rows.
    Folds are scored by ``fold_scores`` where the strategy allows it and scores are rounded (so that ties stay ties), else by copies.
    """
    if train < 1 or step < 1:
        raise ValueError("train and step must be at least 1")
    out = bars
    for i, p in enumerate(params):
        out = strategy(out, key=key, out=f"_sig_{i}", **p)
    chosen = F.array(*[F.col(f"_sig_{i}") for i in range(len(params))])
    out = out.withColumn("_signals", chosen).drop(*[f"_sig_{i}" for i in range(len(params))])
    if reoptimise and len(params) > 1:
        if metric == "profit_factor" and digits is not None and hasattr(strategy, "decided"):
            scored = fold_scores(bars, strategy, params, train, step, key, digits)
        else:
            scored = scores(wf_folds(bars, train, step, key), strategy, params, metric, [*key, "fold_id"], digits)
        winners = best(scored, [*key, "fold_id"]).drop("score")
        placed = out.withColumn("fold_id", F.when(F.col("bar_idx") >= train, F.floor((F.col("bar_idx") - train) / step)))
        joined = placed.join(winners, [*key, "fold_id"], "left")
    else:
        joined = out.withColumn("param_id", F.lit(0))
    live = F.col("bar_idx") >= train if reoptimise and len(params) > 1 else F.lit(True)
    signal = F.when(live, F.coalesce(F.get("_signals", F.col("param_id")), F.lit(0))).otherwise(0)
    run = bar_returns(joined.withColumn("signal", signal).drop("_signals"), key=key)
    return run.filter(F.col("bar_idx") >= train)


def wf_perm_test(bars: DataFrame, strategy: Strategy, params: Params, n_perms: int, train: int, step: int = 30, seed: int = 9, metric: str = "profit_factor", key: Key = KEY, digits: int | None = None) -> DataFrame:
    """Permute the bars after the first training window and walk forward again; scores are out-of-sample profit factors."""
    if n_perms <= 0:
        raise ValueError("there must be a permutation at least")
    by = [*key, "perm_id"]
    every = permute_bars(bars, n_perms, seed, train, include_real=True, key=key)
    found = metrics_bar(walk_forward(every, strategy, params, train, step, metric, by, digits), key=by)
    factor = F.col("profit_factor")
    if digits is not None:
        factor = F.when(factor < float("inf"), F.round(factor, digits)).otherwise(factor)
    return p_value(found.withColumn("score", factor), key=key)


def verdict(df: DataFrame, is_p: str = "is_p_value", wf_p: str = "wf_p_value", oos_pf: str = "oos_profit_factor") -> DataFrame:
    """``verdict``, ``failed_step`` and ``failed_p_value`` from the results of the steps."""
    luck, weak, poor = F.col(is_p) >= ALPHA, F.col(wf_p) >= ALPHA, F.col(oos_pf) < WEAK_FACTOR
    return df.withColumns({
        "verdict": F.when(luck | weak, "OVERFIT").when(poor, "POOR").otherwise("VALIDATED"),
        "failed_step": F.when(luck, "STEP_2_IS_PERMUTATION").when(weak, "STEP_4_WF_PERMUTATION").when(poor, "STEP_3_OOS_WEAK"),
        "failed_p_value": F.when(luck, F.col(is_p)).when(weak, F.col(wf_p)),
    })


def full_validation(bars: DataFrame, strategy: Strategy, params: Params, train: int, step: int = 30, n_is: int = 1000, n_wf: int = 200, key: Key = KEY, digits: int | None = None) -> DataFrame:
    """All four steps, a row for each series. The optimum of step 1 and the walk of step 3 are the permutation 0 of the
    tests, so nothing is computed twice."""
    within = is_perm_test(bars.filter(F.col("bar_idx") < train), strategy, params, n_is, key=key, digits=digits)
    beyond = wf_perm_test(bars, strategy, params, n_wf, train, step, key=key, digits=digits)
    one = within.select(*key, "param_id", param_label(params).alias("params"), F.col("real_score").alias("is_profit_factor"), F.col("p_value").alias("is_p_value"))
    two = beyond.select(*key, F.col("real_score").alias("oos_profit_factor"), F.col("p_value").alias("wf_p_value"))
    return verdict(one.join(two, list(key)))


def quick_validation(bars: DataFrame, strategy: Strategy, params: Params, train: int, key: Key = KEY, digits: int | None = None) -> DataFrame:
    """Step 1, then the metrics of the winner over all bars."""
    winner = grid_search(bars.filter(F.col("bar_idx") < train), strategy, params, key=key, digits=digits)
    by = [*key, "param_id"]
    everywhere = metrics_bar(bar_returns(sweep(bars, strategy, params, key), key=by), key=by)
    return winner.withColumnRenamed("score", "is_profit_factor").join(everywhere, by).withColumn("verdict", F.lit("QUICK"))


def batch_validate(bars: DataFrame, strategies: Mapping[str, tuple[Strategy, Params]], train: int, key: Key = KEY, digits: int | None = None) -> DataFrame:
    """``quick_validation`` of several strategies in one frame. A strategy whose plan can't be made gives an ERROR row for
    each series, with the message in ``params``."""
    out = None
    for name, (strategy, params) in strategies.items():
        try:
            found = quick_validation(bars, strategy, params, train, key, digits).withColumn("status", F.lit("OK"))
        except (ValueError, TypeError) as e:
            found = bars.select(*key).distinct().withColumns({"params": F.lit(str(e)), "verdict": F.lit("ERROR"), "status": F.lit("ERROR")})
        found = found.withColumn("strategy", F.lit(name))
        out = found if out is None else out.unionByName(found, allowMissingColumns=True)
    return out


def batch_summary(results: DataFrame, status: str = "verdict", key: Key = ()) -> DataFrame:
    """How many results have each status."""
    return results.groupBy(*key, status).agg(F.count(F.lit(1)).alias("n"))

