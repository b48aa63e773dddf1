"""Extremes of blocks of bars, blocks of blocks and so on, for searches along a series.

A node holds its ``2 ** BITS`` parts as an array: of level 1 they are bars, above that the extremes of nodes of the level below.
A search from a bar on looks at the parts that come after it in its node of level 1, then in that node's parent and so on up,
and follows the first part that can hold what is sought down to the bar. It reads a node a level on either way, whatever the
length of the series or of the way to go; all searches go along together, one join for each level.

What a part is asked must be such that a node answers for all its bars: a comparison of a least or largest value with a
number that the search brings along, or a question of one value after another (``Trail``). Numbers can be carried: the
largest value so far, say.

Numbers of bars may have gaps; missing values are passed over.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..core import KEY, Key
from ..sources.scratch import materialise

#: A node has 2 ** BITS parts.
BITS = 6


@dataclass(frozen=True)
class Trail:
    """Whether ``low`` is at most ``factor`` times the largest ``high`` up to it."""

    low: str
    high: str
    factor: float


@dataclass
class Pyramid:
    """``lows`` and ``highs`` name the columns of the bars whose least or largest value counts; ``trails`` what is asked of two
    of them in order."""

    bars: DataFrame
    lows: Sequence[str] = ()
    highs: Sequence[str] = ()
    trails: dict[str, Trail] = field(default_factory=dict)
    key: Key = KEY

    def __post_init__(self) -> None:
        self.bits = BITS
        self.names = [*self.lows, *self.highs]
        trail = [(F.coalesce(F.col(t.low) <= F.col(t.high) * t.factor, F.lit(False))).alias(n) for n, t in self.trails.items()]
        parts = self.bars.select(*self.key, F.col("bar_idx").alias("at"), *self.names, *trail, F.lit(1).cast("long").alias("bars"))
        first = materialise(self._nodes(parts), "pyramid-1")
        last = first.agg(F.max("block")).first()[0]
        self.levels, self.tables = 1, {1: first}
        above = []
        while last is not None and last >> (self.bits * (self.levels - 1)) > 0:
            self.levels += 1
            below = above[-1] if above else first
            above.append(self._nodes(self._summed(below)))
        if len(above) == 1:
            self.tables[2] = above[0]  # read once in each search
        elif above:
            tops = materialise(reduce(DataFrame.unionByName, [t.withColumn("level", F.lit(i)) for i, t in enumerate(above, 2)]), "pyramid")
            self.tables |= {i: tops.filter(F.col("level") == i).drop("level") for i in range(2, self.levels + 1)}

    def _nodes(self, parts: DataFrame) -> DataFrame:
        """Parts by node, in order: ``block`` and ``parts``."""
        part = F.struct("at", *self.names, *self.trails, "bars")
        return parts.groupBy(*self.key, F.shiftright("at", self.bits).alias("block")).agg(F.array_sort(F.collect_list(part)).alias("parts"))

    def _summed(self, nodes: DataFrame) -> DataFrame:
        """A part for each node."""
        pick = lambda name: F.transform("parts", lambda x: x[name])
        out = [*[F.array_min(pick(c)).alias(c) for c in self.lows], *[F.array_max(pick(c)).alias(c) for c in self.highs]]
        out += [self._trailed(name, t).alias(name) for name, t in self.trails.items()]
        bars = F.aggregate("parts", F.lit(0).cast("long"), lambda n, x: n + x["bars"])
        return nodes.select(*self.key, F.col("block").alias("at"), *out, bars.alias("bars"))

    def _trailed(self, name: str, t: Trail) -> Column:
        """Whether the trail is met within a part, or by a part and one before it."""

        def step(acc: Column, x: Column) -> Column:
            met = acc["found"] | x[name] | F.coalesce(x[t.low] <= acc["top"] * t.factor, F.lit(False))
            return F.struct(F.greatest(acc["top"], x[t.high]).alias("top"), met.alias("found"))

        start = F.struct(F.lit(None).cast(dict(self.bars.dtypes)[t.high]).alias("top"), F.lit(False).alias("found"))
        return F.aggregate("parts", start, step)["found"]

    # ---- searches ----

    def _met(self, work: DataFrame, level: int, block: Column) -> DataFrame:
        """``work`` with ``_block`` and the ``parts`` of that node of ``level``. Rows that want none (a null block) meet nothing; their keys
        differ, so they don't gather in one place."""
        table = self.tables[level].withColumnRenamed("block", "_block")
        return work.withColumn("_block", F.coalesce(block, -1 - F.abs(F.col("_from")))).join(table, [*self.key, "_block"], "left")

    def first(self, searches: DataFrame, hit: Callable[[Column, Column], Column], start: Column | None = None, carry: Callable[[Column, Column], Column] | None = None) -> DataFrame:
        """Searches with ``_at``, the first bar after ``_from`` and up to ``_until`` for which ``hit(part, carried)`` holds, and
        ``_carried``, the number carried up to the bar before it: ``start``, changed by ``carry(carried, part)`` at each part."""
        start = F.lit(0.0) if start is None else start
        carry = carry or (lambda m, x: m)
        none = F.lit(None)

        def scan(parts: Column, begin: Column, level: int) -> Column:
            def step(acc: Column, x: Column) -> Column:
                met = F.struct(acc["m"].alias("m"), F.lit(level).cast("int").alias("level"), x["at"].cast("long").alias("at"))
                passed = F.struct(carry(acc["m"], x).cast("double").alias("m"), none.cast("int").alias("level"), none.cast("long").alias("at"))
                return F.when(acc["level"].isNotNull(), acc).when(F.coalesce(hit(x, acc["m"]), F.lit(False)), met).otherwise(passed)

            return F.aggregate(parts, F.struct(begin.cast("double").alias("m"), none.cast("int").alias("level"), none.cast("long").alias("at")), step)

        columns = [F.col(f"`{c}`") for c in searches.columns]
        found = searches.withColumn("_found", F.struct(start.cast("double").alias("m"), none.cast("int").alias("level"), none.cast("long").alias("at")))
        after = lambda met, parts, level: met.select(*columns, F.when(F.col("parts").isNotNull(), scan(parts, F.col("_found.m"), level)).otherwise(F.col("_found")).alias("_found"))
        for level in range(1, self.levels + 1):
            shift = self.bits * (level - 1)
            unit = F.shiftright(F.col("_from") + (1 << shift), shift)
            # At a node's first part, the levels above take over.
            wanted = F.col("_found.level").isNull() & (F.shiftleft(unit, shift) <= F.col("_until"))
            if level < self.levels:
                wanted &= unit.bitwiseAND((1 << self.bits) - 1) > 0
            met = self._met(found, level, F.when(wanted, F.shiftright(unit, self.bits)))
            found = after(met, self._later(unit), level)
        for level in range(self.levels, 1, -1):
            met = self._met(found, level - 1, F.when(F.col("_found.level") == level, F.col("_found.at")))
            found = after(met, F.col("parts"), level - 1)
        at = F.when(F.col("_found.at") <= F.col("_until"), F.col("_found.at"))
        return found.select(*columns, at.alias("_at"), F.col("_found.m").alias("_carried"))

    @staticmethod
    def _later(unit: Column) -> Column:
        return F.filter("parts", lambda x: x["at"] >= unit)

    def ranges(self, searches: DataFrame, until: str = "_until") -> DataFrame:
        """Searches with the extremes of all names over the bars from ``_from`` to ``until``, and ``_bars``, their number."""
        size = (1 << self.bits) - 1
        kinds = dict(self.bars.dtypes)
        work = searches.withColumns({"_a": F.col("_from"), "_b": F.col(until), **{c: F.lit(None).cast(kinds[c]) for c in self.names}, "_bars": F.lit(0).cast("long")})
        a, b = F.col("_a"), F.col("_b")
        for level in range(1, self.levels + 1):
            node_a, node_b, open_ = F.shiftright(a, self.bits), F.shiftright(b, self.bits), a <= b
            left = F.when(open_ & ((node_a == node_b) | (a.bitwiseAND(size) > 0)), node_a)
            right = F.when(open_ & (node_a != node_b) & (b.bitwiseAND(size) < size), node_b)
            for node in (left, right) if level < self.levels else (F.when(open_, node_a),):
                work = self._met(work.drop("parts", "_block"), level, node)
                inside = F.expr("filter(parts, x -> x.at >= _a and x.at <= _b)")
                pick = lambda name: F.transform(inside, lambda x: x[name])  # noqa: B023, E731
                more = F.coalesce(F.aggregate(inside, F.lit(0).cast("long"), lambda n, x: n + x["bars"]), F.lit(0).cast("long"))
                work = work.withColumns({**{c: F.least(c, F.array_min(pick(c))) for c in self.lows}, **{c: F.greatest(c, F.array_max(pick(c))) for c in self.highs}, "_bars": F.col("_bars") + more})
            met = node_a == node_b
            up = {"_a": F.when(met, 1).otherwise(F.shiftright(a + size, self.bits)), "_b": F.when(met, 0).otherwise(F.shiftright(b + 1, self.bits) - 1)}
            work = work.withColumns({c: x.cast("long") for c, x in up.items()})
        return work.drop("_a", "_b", "parts", "_block")
