"""Near-duplicates by the share of common word shingles, found through SimHash prints and verified with whole sets.

Texts with the same set of shingles are one node. Nodes meet in groups under keys of ``ROWS`` least hashes each, ``BANDS``
keys a node: a pair that shares 0.8 of its shingles misses all of them with probability 2e-4 (blocks of the prints can't key
a radius as wide as 0.8 needs). Within a group the pivot tables of the prints discard pairs, and those within ``RADIUS``
bits (a pair at 0.8 differs in 10 of 64 on average and in more than 22 once in 30,000) are candidates; sets so small that
a print says little are candidates without it. The candidates' components get each set once, and there pairs that aren't
linked yet are verified, nearest prints first. Links of verified pairs make the groups: no other pair is ever linked.

Large groups are dealt out as tiles, so that no task holds more than two tiles. Sets are compared by 32 bits of each hash.

Defined cases: a null text is the empty text; texts without words are alike; with fewer words than a shingle has, the
whole sequence is the one shingle; repeated rows are kept once; rows with a null id go last within their group.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import simhash
from .common import free_names, if_small, materialise, named, small_batches, spread
from .components import components
from .simhash import dealt, fingerprint, forest, near_pairs, pivot_table, shingle_hashes, whole_units

SIZE, LEAST = 5, 0.8
BANDS, ROWS = 12, 3
RADIUS = 22
#: Sets of up to FEW shingles are compared without their prints, those of MANY and more by them; a similar pair is in one class.
FEW, MANY = 20, 17
TILE = 512

_mixers = np.random.default_rng(23).integers(0, 2**63, (2, BANDS * ROWS), dtype=np.uint64)
FLIPS, FACTORS = _mixers[0], _mixers[1] | np.uint64(1)


def shingle_set(text: str | None, size: int = SIZE) -> np.ndarray:
    """Sorted distinct hashes of the shingles."""
    return np.unique(shingle_hashes(text if isinstance(text, str) else None, size))


def band_keys(own: np.ndarray) -> np.ndarray:
    """A key for each band out of the least of ROWS hashes of the set; none for an empty set."""
    if not len(own):
        return np.zeros(0, np.int64)
    least = np.full(BANDS * ROWS, 2**64 - 1, np.uint64)
    for i in range(0, len(own), 4096):
        least = np.minimum(least, ((own[i : i + 4096] ^ FLIPS[:, None]) * FACTORS[:, None]).min(1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = (keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
        keys ^= keys >> np.uint64(32)
    return keys.view(np.int64)


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = np.concatenate([a, b])
    both.sort()
    shared = int((both[1:] == both[:-1]).sum())
    return shared / (len(both) - shared)


def _summary(size: int):
    @F.pandas_udf("set_key long, n int, fp long, keys array<long>, own binary")
    def of(texts: pd.Series) -> pd.DataFrame:
        sets = [shingle_set(t, size) for t in texts]
        longs = lambda values: np.array(values, np.uint64).view(np.int64)
        return pd.DataFrame({
            "set_key": longs([xxhash.xxh64_intdigest(s.tobytes()) for s in sets]), "n": np.array([len(s) for s in sets], np.int32), "fp": longs([fingerprint(s) for s in sets]),
            "keys": [band_keys(s) for s in sets], "own": [np.unique((s >> np.uint64(32)).astype(np.uint32)).tobytes() for s in sets],
        })

    return of


def _candidates(least: float):
    """Links among the nodes of each unit whose prints and sizes allow the similarity."""

    def run(batches):
        for pdf, bounds in whole_units(batches, ("few", "key", "i", "j")):
            prints, side, n, few = pdf["fp"].to_numpy().view(np.uint64), pdf["side"].to_numpy(), pdf["n"].to_numpy(), pdf["few"].to_numpy()
            cuts, found = np.array(bounds), []
            for kind, radius in ((0, RADIUS), (1, 64)):
                own = cuts[np.flatnonzero(few[cuts[:-1]] == kind)]
                if len(own):
                    low, high = int(own[0]), int(cuts[np.searchsorted(cuts, own[-1]) + 1])
                    units = cuts[(cuts >= low) & (cuts <= high)] - low
                    i, j = near_pairs(prints[low:high], pivot_table(prints[low:high]), side[low:high], units, radius)
                    i, j = i + low, j + low
                    fits = np.minimum(n[i], n[j]) >= least * np.maximum(n[i], n[j]) - 1e-9
                    found.append((i[fits], j[fits]))
            root = forest(len(pdf), *map(np.concatenate, zip(*found, strict=True)))
            moved = np.flatnonzero(root != np.arange(len(pdf)))
            if len(moved):
                node = pdf["node"].to_numpy()
                yield pd.DataFrame({"a": node[moved], "b": node[root[moved]]})

    return run


def verified_links(node_sets: list[np.ndarray], prints: np.ndarray, n: np.ndarray, side: np.ndarray, least: float = LEAST) -> list[tuple[int, int]]:
    """Pairs of places that share ``least`` of their shingles, as many as connect all that do; those with the nearest prints
    are read first, and none whose ends are connected. Where both sides occur, of pairs of different sides only."""
    i, j = np.triu_indices(len(prints), 1)
    if side.any() and not side.all():
        mixed = side[i] != side[j]
        i, j = i[mixed], j[mixed]
    bits = np.bitwise_count(prints[i] ^ prints[j])
    low, high = np.minimum(n[i], n[j]), np.maximum(n[i], n[j])
    fits = (low >= least * high - 1e-9) & ((bits <= RADIUS) | (high <= FEW))
    order = np.flatnonzero(fits)[np.argsort(bits[fits], kind="stable")]
    i, j = i[order], j[order]
    root, made = np.arange(len(prints)), []
    while len(i):
        for a, b in zip(i[:256].tolist(), j[:256].tolist(), strict=True):
            x, y = a, b
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            if x != y and similarity(node_sets[a], node_sets[b]) >= least - 1e-9:
                root[max(x, y)] = min(x, y)
                made.append((a, b))
        while ((deeper := root[root]) != root).any():
            root = deeper
        i, j = i[256:], j[256:]
        apart = root[i] != root[j]
        i, j = i[apart], j[apart]
    return made


def _verify(least: float):
    def run(batches):
        for pdf, bounds in whole_units(batches, ("root", "i", "j")):
            node, n, side = pdf["node"].to_numpy(), pdf["n"].to_numpy(), pdf["side"].to_numpy()
            prints = pdf["fp"].to_numpy().view(np.uint64)
            rows = []
            for s, e in itertools.pairwise(bounds):
                sets = [np.frombuffer(own, np.uint32) for own in pdf["own"].iloc[s:e]]
                rows += [(node[s + a], node[s + b]) for a, b in verified_links(sets, prints[s:e], n[s:e], side[s:e], least)]
            if rows:
                yield pd.DataFrame(rows, columns=["a", "b"])

    return run


def _groups(rows: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """``node, root`` of every node that is linked with another."""
    few = F.filter(F.array(F.when(F.col("n") >= MANY, 0), F.when(F.col("n") <= FEW, 1)), lambda k: k.isNotNull())
    entries = nodes.select(F.col("set_key").alias("node"), "n", "fp", F.explode(few).alias("few"), "keys").select("node", "n", "fp", "few", F.explode("keys").alias("key"))
    near = dealt(entries, ("few", "key"), ("n", "fp"), simhash.TILE).mapInPandas(_candidates(least), "a long, b long").distinct()
    around = materialise(components(near), "candidates")
    # One row of each node carries its set to the other candidates of its component.
    first = around.join(spread(nodes.select(F.col("set_key").alias("node"), "row")), "node")
    first = first.select(F.col("node").alias("set_key"), F.col("row.none").alias("none"), F.col("row.id").alias("_key"), F.col("row.part").alias("part"), "root")
    own = rows.select("set_key", F.col("row.none").alias("none"), F.col("row.id").alias("_key"), F.col("row.part").alias("part"), "n", "fp", "own")
    by = ["set_key", "none", "_key", "part"]
    members = own.join(spread(first), by).dropDuplicates(by).select(F.col("set_key").alias("node"), "n", "fp", "own", "root")
    links = dealt(materialise(members, "members"), ("root",), ("n", "fp", "own"), TILE).mapInPandas(_verify(least), "a long, b long")
    return components(links)


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = SIZE, least: float = LEAST) -> DataFrame:
    """The rows of ``docs`` that stand for their group of near-duplicates: the one of smallest id (null ids last)."""
    part = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    row = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col).cast("long"), F.lit(0)).alias("id"), part.alias("part"))
    rows = small_batches(docs.select(row.alias("row"), F.col(text_col).alias("_text"))).withColumn("s", _summary(size)("_text")).select("row", "s.*")
    rows = materialise(rows, "shingle-sets")
    nodes = rows.groupBy("set_key").agg(F.min("row").alias("row"), F.first("n").alias("n"), F.first("fp").alias("fp"), F.first("keys").alias("keys"))
    nodes = materialise(nodes, "nodes")
    label = _groups(rows, nodes, least).withColumnRenamed("node", "set_key")
    rooted = nodes.select("set_key", "row").join(label, "set_key", "left").withColumn("root", F.coalesce("root", "set_key"))
    kept = rooted.groupBy("root").agg(F.min("row").alias("row")).select("row")
    # What goes is less than what stays: it is what the texts are joined with, if they need to be moved at all.
    seen = rows.groupBy("row").agg(F.count(F.lit(1)).alias("n"))
    judged = seen.join(kept.withColumn("stays", F.lit(True)), "row", "left")
    other = materialise(judged.filter(F.col("stays").isNull() | (F.col("n") > 1)).select("row", F.coalesce("stays", F.lit(False)).alias("stays")), "not-once")
    key, mark = free_names(docs, "_row", "_stays")
    marks = if_small(other.select(F.col("row").alias(key), F.col("stays").alias(mark)), 40)
    found = docs.withColumn(key, row).join(marks, key, "left")
    once = found.filter(F.col(mark).isNull()).select(*named(docs))
    repeated = found.filter(mark).dropDuplicates([key]).select(*named(docs))
    return once.unionByName(repeated) if other.filter("stays").head(1) else once
