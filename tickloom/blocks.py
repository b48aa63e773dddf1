"""One long series in many tasks: its bars cut into blocks of equal numbers.

The operators elsewhere keep a series in one partition. Those here give the same values and partition by series and block.
Frames of fixed length see the bars before their block through a halo: copies of the last bars of the blocks before.
Averages and running values are computed within blocks first; a table with one row a block, over which alone a window spans
the whole series, gives each block what it carries in, and joins back on the partitioning that the bars already have.

``bar_idx`` numbers the bars from 0 without gaps (``number_bars``). Rows with a missing key belong to no series and are left
out. An empty table gives an empty one. Columns named ``_block`` or ``_own`` are reserved.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .core import KEY, ColumnLike, Key, col, lag, linear_recurrences, so_far, strict
from .functions import indicators as ind
from .operators import returns, signals

#: Bars in a block: 20 million bars make 306 tasks, and a halo of a thousand bars is 1.5 % more rows.
SIZE = 1 << 16

#: Running values: the aggregate, how its value within a block joins what was carried in, and how blocks add up.
RUNNING: dict[str, tuple[Callable, Callable, Callable]] = {
    "sum": (F.sum, lambda x, y: F.coalesce(x + y, x, y), F.sum),
    "product": (F.product, lambda x, y: F.coalesce(x * y, x, y), F.product),
    "max": (F.max, F.greatest, F.max),
    "min": (F.min, F.least, F.min),
    "last": (lambda c: F.last(c, ignorenulls=True), F.coalesce, lambda c: F.last(c, ignorenulls=True)),
}


def number_bars(df: DataFrame, hours: int = 24, key: Key = KEY, order: str = "ts") -> DataFrame:
    """``bar_idx`` without a window over a whole series: the bars are counted by spans of ``hours``, the counts added up over a row a
    span, and the bars numbered within spans. Choose ``hours`` so that a span holds some ten thousand bars. Missing times come first."""
    if hours < 1:
        raise ValueError("hours must be at least 1")
    day = F.unix_date(F.to_date(order)).cast("long")
    span = F.coalesce(F.floor((day * 24 + F.hour(order)) / hours).cast("long"), F.lit(-(2**62)))
    placed = _series(df, key).withColumn("_block", span)
    counts = placed.groupBy(*key, "_block").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*key, "_block", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(*key, "_block").orderBy(order)) - 1
    return placed.withColumn("_within", within).join(starts, [*key, "_block"]).withColumn("bar_idx", F.col("_start") + F.col("_within")).select(*[c for c in df.columns if c != "bar_idx"], "bar_idx")


def _series(df: DataFrame, key: Key) -> DataFrame:
    for c in key:
        df = df.filter(F.col(c).isNotNull())
    return df


def cut(df: DataFrame, look_back: int = 0, size: int = SIZE, key: Key = KEY) -> DataFrame:
    """Bars with their ``_block``, and copies of the last ``look_back`` bars before each block (``_own`` is false)."""
    if size < 1 or look_back < 0:
        raise ValueError("size must be at least 1, look_back not negative")
    clash = {"_block", "_own"} & set(df.columns)
    if clash:
        raise ValueError(f"reserved columns: {sorted(clash)}")
    own = F.expr(f"bar_idx div {size}")
    placed = _series(df, key)
    if not look_back:
        return placed.withColumns({"_block": own, "_own": F.lit(True)})
    placed = placed.withColumn("_block", F.explode(F.sequence(own, F.expr(f"(bar_idx + {look_back}) div {size}"))))
    return placed.withColumn("_own", F.col("_block") == own)


def uncut(df: DataFrame) -> DataFrame:
    return df.filter("_own").drop("_block", "_own")


def in_blocks(df: DataFrame, f: Callable[..., DataFrame], look_back: int, size: int = SIZE, key: Key = KEY) -> DataFrame:
    """``f(df, key=...)`` block by block. ``look_back`` is how many bars before its own a value depends on, all steps of ``f`` together;
    what ``f`` gives must not depend on earlier ones. So any rolling indicator runs, or ``groupBy(...).applyInPandas`` over bounded groups."""
    return uncut(f(cut(df, look_back, size, key), key=[*key, "_block"]))


def _carried(df: DataFrame, ends: dict[str, Column], carry: Callable[[DataFrame], dict[str, Column]], key: Key) -> DataFrame:
    """Add what each block takes over from those before: ``ends`` of each block, ``carry`` over a row a block."""
    rows = df.filter("_own").groupBy(*key, "_block").agg(*[c.alias(name) for name, c in ends.items()])
    return df.join(rows.select(*key, "_block", *[c.alias(name) for name, c in carry(rows).items()]), [*key, "_block"], "left")


def _before(key: Key):
    return Window.partitionBy(*key).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)


def _running(df: DataFrame, values: dict[str, tuple[str, ColumnLike]], key: Key) -> DataFrame:
    """Running values over whole series, for bars that are cut: ``{out: (kind, input)}`` with the kinds of ``RUNNING``.

    Missing inputs are passed over; the value is NULL before the first. Halo bars don't count, their values mean nothing.
    """
    by = [*key, "_block"]
    df = df.withColumns({f"_x_{out}": F.when(F.col("_own"), col(c)) for out, (_, c) in values.items()})
    aggregates = {out: RUNNING[kind] for out, (kind, _) in values.items()}
    ends, within = {}, {}
    for out, (kind, _) in values.items():
        x = F.col(f"_x_{out}")
        ends[f"_c_{out}"] = F.max_by(x, F.when(x.isNotNull(), F.col("bar_idx"))) if kind == "last" else aggregates[out][0](x)
        within[out] = aggregates[out][0](x).over(so_far(by))
    carry = lambda _rows: {f"_c_{out}": aggregates[out][2](F.col(f"_c_{out}")).over(_before(key)) for out in values}
    found = _carried(df.withColumns(within), ends, carry, key)
    joined = {out: aggregates[out][1](F.col(out), F.col(f"_c_{out}")) for out in values}
    return found.withColumns(joined).drop(*[f"_x_{out}" for out in values], *[f"_c_{out}" for out in values])


def running(df: DataFrame, values: dict[str, tuple[str, ColumnLike]], size: int = SIZE, key: Key = KEY) -> DataFrame:
    """Running ``sum``, ``product``, ``max``, ``min`` or ``last`` of each series: ``{out: (kind, input)}``."""
    return uncut(_running(cut(df, 0, size, key), values, key))


def _averages(df: DataFrame, inputs: dict[str, tuple[ColumnLike, float, int]], seed: str, size: int, key: Key) -> DataFrame:
    """``core.averages`` for bars that are cut with a halo of the longest length less one, and as many more as the inputs look back.

    The first start and the last gap before a block settle whether its bars have a value. Within a block an average
    starts from nothing; what came before adds a ** (bars since the block's start) times the value at its end.
    """
    if seed not in ("sma", "first"):
        raise ValueError("seed is 'sma' or 'first'")
    if any(not 0 < alpha <= 1 or n < 1 for _, alpha, n in inputs.values()):
        raise ValueError("lengths must be at least 1")
    by = [*key, "_block"]
    out = df.withColumns({f"_in_{k}": col(c).cast("double") for k, (c, _, _) in inputs.items()})
    out = out.withColumns({f"_seed_{k}": strict(n, F.avg, f"_in_{k}", by) if seed == "sma" else F.col(f"_in_{k}") for k, (_, _, n) in inputs.items()})
    seen = {}
    for k in inputs:
        seen[f"_from_{k}"] = ("min", F.when(F.col(f"_seed_{k}").isNotNull(), F.col("bar_idx")))
        seen[f"_gap_{k}"] = ("max", F.when(F.col(f"_in_{k}").isNull(), F.col("bar_idx")))
    out = _running(out, seen, key)
    scans = {}
    for k, (_, alpha, _) in inputs.items():
        at, later = F.col("bar_idx") == F.col(f"_from_{k}"), F.col("bar_idx") > F.col(f"_from_{k}")
        scans[k] = (F.when(F.col("_own"), F.when(at, F.col(f"_seed_{k}")).when(later, F.lit(alpha) * F.col(f"_in_{k}"))), 1 - alpha)
    out = linear_recurrences(out, scans, by)

    def carry(rows: DataFrame) -> dict[str, Column]:
        return {f"_carry_{k}": lag(f"_end_{k}", 1, key) for k in inputs}

    ends = out.filter("_own").groupBy(*by).agg(*[F.max_by(k, "bar_idx").alias(f"_last_{k}") for k in inputs]).withColumn("bar_idx", F.col("_block"))
    ends = linear_recurrences(ends, {f"_end_{k}": (F.col(f"_last_{k}"), (1 - alpha) ** size) for k, (_, alpha, _) in inputs.items()}, key)
    ends = ends.withColumns(carry(ends)).select(*by, *[f"_carry_{k}" for k in inputs])
    out = out.join(ends, by, "left")
    result = {}
    for k, (_, alpha, _) in inputs.items():
        since = (F.col("bar_idx") - F.col("_block") * size + 1).cast("double")
        value = F.col(k) + F.pow(F.lit(1.0 - alpha), since) * F.coalesce(f"_carry_{k}", F.lit(0.0))
        started = F.col("bar_idx") >= F.col(f"_from_{k}")
        whole = F.coalesce(F.col(f"_gap_{k}") < F.col(f"_from_{k}"), F.lit(True)) if seed == "sma" else F.col(f"_in_{k}").isNotNull()
        result[k] = F.when(F.col("_own") & started & whole, value)
    return out.withColumns(result).drop(*[f"{p}_{k}" for p in ("_in", "_seed", "_from", "_gap", "_carry") for k in inputs])


def averages(df: DataFrame, inputs: dict[str, tuple[ColumnLike, float, int]], seed: str, size: int = SIZE, key: Key = KEY) -> DataFrame:
    """Exponential averages ``{name: (input, alpha, length)}``, as in ``core.averages``; inputs are columns of the bar itself."""
    halo = max((n - 1 for _, _, n in inputs.values()), default=0) if seed == "sma" else 0
    return uncut(_averages(cut(df, halo, size, key), inputs, seed, size, key))


def sma(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "sma", size: int = SIZE, key: Key = KEY) -> DataFrame:
    return in_blocks(df, lambda x, key: ind.sma(x, c, n, out, key), n - 1, size, key)


def ema(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "ema", seed: str = "sma", size: int = SIZE, key: Key = KEY) -> DataFrame:
    return averages(df, {out: (c, 2.0 / (n + 1), n)}, seed, size, key)


def rma(df: DataFrame, c: ColumnLike = "close", n: int = 14, out: str = "rma", seed: str = "sma", size: int = SIZE, key: Key = KEY) -> DataFrame:
    return averages(df, {out: (c, 1.0 / n, n)}, seed, size, key)


def atr(df: DataFrame, n: int = 14, out: str = "atr", seed: str = "sma", size: int = SIZE, key: Key = KEY) -> DataFrame:
    ranges = ind.true_range(cut(df, n, size, key), "_tr", [*key, "_block"])
    return uncut(_averages(ranges, {out: ("_tr", 1.0 / n, n)}, seed, size, key)).drop("_tr")


def sig_donchian(df: DataFrame, lookback: int = 20, source: str = "close", out: str = "signal", size: int = SIZE, key: Key = KEY) -> DataFrame:
    """The channel breakout, its last decision carried over from block to block."""
    levels = signals.donchian_levels(cut(df, lookback, size, key), lookback, source, [*key, "_block"])
    found = _running(levels, {"_held": ("last", "_raw")}, key)
    return uncut(signals.donchian_signal(found, out))


def bar_returns(df: DataFrame, signal: str = "signal", commission: float = 0.0, check: bool = True, size: int = SIZE, key: Key = KEY) -> DataFrame:
    """``active``, ``bar_return``, ``strategy_return`` and ``equity_curve``. A return looks two signals back."""
    found = returns.bar_returns(cut(df, 2, size, key), signal, commission, check, [*key, "_block"]).drop("equity_curve")
    return uncut(_growth(found, "strategy_return", "equity_curve", key))


def _growth(df: DataFrame, ret: str, out: str, key: Key) -> DataFrame:
    return _running(df, {out: ("product", 1 + F.coalesce(F.col(ret), F.lit(0.0)))}, key)


def equity_curve(df: DataFrame, ret: str = "strategy_return", out: str = "equity_curve", size: int = SIZE, key: Key = KEY) -> DataFrame:
    return uncut(_growth(cut(df, 0, size, key), ret, out, key))


def drawdown_pct(df: DataFrame, equity: str = "equity_curve", out: str = "drawdown_pct", size: int = SIZE, key: Key = KEY) -> DataFrame:
    peak = F.col("_peak")
    return running(df, {"_peak": ("max", equity)}, size, key).withColumn(out, 100.0 * F.try_divide(F.col(equity) - peak, peak)).drop("_peak")


def metrics_bar(df: DataFrame, ret: str = "strategy_return", size: int = SIZE, key: Key = KEY) -> DataFrame:
    """The metrics of ``returns.metrics_bar``: two carries, then one aggregation that combines before its shuffle."""
    found = _growth(cut(df, 0, size, key), ret, "_eq", key).withColumn("_eq", F.when(F.col(ret).isNotNull(), F.col("_eq")))
    found = uncut(_running(found, {"_top": ("max", "_eq")}, key))
    return returns.metrics_of(found.withColumn("_dd", F.try_divide("_eq", "_top") - 1), ret, key)
