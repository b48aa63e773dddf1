"""Latest known values: each row gets what the last row of another table before it says."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..core import KEY, Key


def as_of(df: DataFrame, other: DataFrame, values: Key, on: str = "ts", key: Key = KEY, direction: str = "backward", equal: bool = True) -> DataFrame:
    """Add ``values`` of the nearest row of ``other`` at or before ``on`` (``direction='forward'``: at or after; without ``equal``
    strictly so). Both tables in one sort: a pass over the rows of a series, however many rows the other table has of it.

    Rows without such a row, time or key get NULL; rows of ``other`` without a time or key don't count. Of several at one time
    one counts, so give their times once. ``values`` replace columns of the same name. The order of equal rows is kept by no one.
    """
    if direction not in ("backward", "forward"):
        raise ValueError("direction is 'backward' or 'forward'")
    kinds = {f.name: f.dataType for f in df.schema}
    known = other.select(*[F.col(k).cast(kinds[k]).alias(k) for k in key], F.col(on).cast(kinds[on]).alias(on), F.struct(*values).alias("_known"))
    for c in (*key, on):
        known = known.filter(F.col(c).isNotNull())
    both = df.withColumn("_asks", F.lit(True)).unionByName(known.withColumn("_asks", F.lit(False)), allowMissingColumns=True)
    time = F.col(on).asc_nulls_first() if direction == "backward" else F.col(on).desc_nulls_last()
    w = Window.partitionBy(*key).orderBy(time, F.col("_asks").asc() if equal else F.col("_asks").desc()).rowsBetween(Window.unboundedPreceding, 0)
    found = both.withColumn("_known", F.last("_known", ignorenulls=True).over(w)).filter("_asks")
    placed = F.col(on).isNotNull()
    return found.withColumns({v: F.when(placed, F.col(f"_known.{v}")) for v in values}).select(*[c for c in df.columns if c not in values], *values)
