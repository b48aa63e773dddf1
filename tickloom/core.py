"""Keys, bar order, window frames and recurrences that all operators share.

Bars are rows ``symbol, ts, open, high, low, close, volume``; ``key`` names the columns of a series (``symbol`` alone, or
with ``param_id``, ``perm_id``, ``fold_id`` in sweeps) and ``bar_idx`` numbers its bars from 0. A missing value is NULL,
never NaN. Every operator adds or replaces columns by windows over one partitioning and ordering, so a chain of them
costs one shuffle and one sort.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

KEY = ("symbol",)
OHLC = ("open", "high", "low", "close")
Key = Sequence[str]
ColumnLike = Column | str


def col(c: ColumnLike) -> Column:
    return F.col(c) if isinstance(c, str) else c


def with_bar_idx(df: DataFrame, key: Key = KEY, order: str | Sequence[str] = "ts") -> DataFrame:
    """Number the rows of each series from 0."""
    by = [order] if isinstance(order, str) else list(order)
    return df.withColumn("bar_idx", F.row_number().over(Window.partitionBy(*key).orderBy(*by)).cast("long") - 1)


def ordered(key: Key = KEY) -> WindowSpec:
    return Window.partitionBy(*key).orderBy("bar_idx")


def rolling(n: int, key: Key = KEY) -> WindowSpec:
    """The last n bars, the current one included."""
    return ordered(key).rowsBetween(-(n - 1), 0)


def prior(n: int, key: Key = KEY) -> WindowSpec:
    """The n bars before the current one."""
    return ordered(key).rowsBetween(-n, -1)


def so_far(key: Key = KEY) -> WindowSpec:
    return ordered(key).rowsBetween(Window.unboundedPreceding, 0)


def whole(key: Key = KEY) -> WindowSpec:
    return Window.partitionBy(*key)


def lag(c: ColumnLike, n: int = 1, key: Key = KEY) -> Column:
    return F.lag(col(c), n).over(ordered(key))


def strict(n: int, agg, c: ColumnLike, key: Key = KEY) -> Column:
    """``agg`` over the last n bars; NULL while there are fewer, or if one of them is missing."""
    return F.when(F.count(col(c)).over(rolling(n, key)) == n, agg(col(c)).over(rolling(n, key)))


def hold(raw: ColumnLike, key: Key = KEY) -> Column:
    """Carry the last decision forward; 0 before the first."""
    return F.coalesce(F.last(col(raw), ignorenulls=True).over(so_far(key)), F.lit(0))


def count_if(c: Column) -> Column:
    return F.count_if(c)


def linear_recurrences(df: DataFrame, inputs: dict[str, tuple[Column, float]], key: Key = KEY) -> DataFrame:
    """Add columns y with y[i] = a * y[i-1] + b[i] (b NULL counts as 0), for ``{name: (b, a)}`` and 0 <= a < 1.

    Evaluated as a prefix scan by doubling: after t steps a row holds the sum over its last 2**t inputs. The scan stops
    once a**(2**t) is below the resolution of a double, so its depth depends on ``a``, never on the number of bars.
    All names advance together, on one partitioning and sort.
    """
    steps = {name: max(0, math.ceil(math.log2(max(1.0, 41.5 / -math.log(a))))) if a > 0 else 0 for name, (_, a) in inputs.items()}
    out = df.withColumns({name: F.coalesce(b.cast("double"), F.lit(0.0)) for name, (b, _) in inputs.items()})
    for t in range(max(steps.values(), default=0)):
        width = 1 << t
        moved = {name: F.col(name) + F.lit(a**width) * F.coalesce(lag(name, width, key), F.lit(0.0)) for name, (_, a) in inputs.items() if t < steps[name]}
        out = out.withColumns(moved)
    return out


def averages(df: DataFrame, inputs: dict[str, tuple[ColumnLike, float, int]], seed: str, key: Key = KEY) -> DataFrame:
    """Exponential averages ``{name: (input, alpha, length)}``.

    ``seed='sma'``: starts with the mean of the first window of ``length`` values without a gap; a missing input after
    that makes everything later missing. ``seed='first'``: starts with the first value; missing inputs count as no bar.
    """
    if seed not in ("sma", "first"):
        raise ValueError("seed is 'sma' or 'first'")
    if any(not 0 < alpha <= 1 or n < 1 for _, alpha, n in inputs.values()):
        raise ValueError("lengths must be at least 1")
    out = df.withColumns({f"_in_{k}": col(c).cast("double") for k, (c, _, _) in inputs.items()})
    first, scans, result, scratch = {}, {}, {}, [f"_in_{k}" for k in inputs]
    for k, (_, _, n) in inputs.items():
        x = F.col(f"_in_{k}")
        start = strict(n, F.avg, x, key) if seed == "sma" else x
        first[f"_seed_{k}"] = start
        scratch += [f"_seed_{k}", f"_from_{k}", f"_ok_{k}"]
    out = out.withColumns(first)
    out = out.withColumns({f"_from_{k}": F.min(F.when(F.col(f"_seed_{k}").isNotNull(), F.col("bar_idx"))).over(so_far(key)) for k in inputs})
    later = {k: F.col("bar_idx") > F.col(f"_from_{k}") for k in inputs}
    out = out.withColumns({f"_ok_{k}": F.count_if(later[k] & F.col(f"_in_{k}").isNull()).over(so_far(key)) == 0 for k in inputs})
    for k, (_, alpha, _) in inputs.items():
        at = F.col("bar_idx") == F.col(f"_from_{k}")
        scans[k] = (F.when(at, F.col(f"_seed_{k}")).when(later[k], F.lit(alpha) * F.col(f"_in_{k}")), 1 - alpha)
        seen = F.col(f"_from_{k}").isNotNull()
        result[k] = F.when(seen & F.col(f"_ok_{k}") if seed == "sma" else seen & F.col(f"_in_{k}").isNotNull(), F.col(k))
    return linear_recurrences(out, scans, key).withColumns(result).drop(*scratch)
