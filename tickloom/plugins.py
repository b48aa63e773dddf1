"""Extension points: strategies of one's own, as DataFrame functions, pandas code or Boolean columns."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .core import KEY, Key
from .operators.trades import candidate_entries, custom_exit


def strategy_plugin(f: Callable[..., DataFrame], key: Key = KEY, out: str = "signal", **params) -> Callable[[DataFrame], DataFrame]:
    """A strategy with its parameters, for ``DataFrame.transform`` and the sweeps."""
    return lambda df: f(df, key=key, out=out, **params)


def pandas_strategy(df: DataFrame, f: Callable[[pd.DataFrame], pd.Series], out: str = "signal", key: Key = KEY) -> DataFrame:
    """Signals from pandas code over each whole series, in the order of its bars. A series must fit into one task, so this
    is for code that can't be written as windows."""
    schema = ", ".join(f"`{c}` {t}" for c, t in df.dtypes if c != out)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("bar_idx", ignore_index=True)
        return pdf.assign(**{out: pd.Series(f(pdf)).fillna(0).astype("int32").to_numpy()})

    return df.drop(out).groupBy(*key).applyInPandas(run, f"{schema}, `{out}` int")


def signal_contract_check(bars: DataFrame, signals: DataFrame, signal: str = "signal", key: Key = KEY) -> DataFrame:
    """A row for each series: missing bars, missing values, values other than -1, 0 and 1, and whether all is well."""
    counted = bars.groupBy(*key).agg(F.count(F.lit(1)).alias("n_bars"))
    s = F.col(signal)
    made = signals.groupBy(*key).agg(F.count(F.lit(1)).alias("n_signals"), F.count_if(s.isNull()).alias("n_missing"), F.count_if(~s.isin(-1, 0, 1)).alias("n_other"))
    joined = counted.join(made, list(key), "left").fillna(0, ["n_signals", "n_missing", "n_other"])
    return joined.withColumn("valid", (F.col("n_bars") == F.col("n_signals")) & (F.col("n_missing") == 0) & (F.col("n_other") == 0))


def custom_entry_exit(bars: DataFrame, entry: Column, leave: Column, horizon: int | None = None, key: Key = KEY) -> DataFrame:
    """Long trades between bars where ``entry`` and ``leave`` hold, each filled at the next open."""
    marked = bars.withColumns({"direction": F.when(F.coalesce(entry, F.lit(False)), F.lit("long")), "_leave": F.coalesce(leave, F.lit(False))})
    return custom_exit(candidate_entries(marked, key=key), marked, "_leave", horizon, key)
