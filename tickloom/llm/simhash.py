"""SimHash near-duplicates found through pivot distance tables.

Distinct fingerprints are linked when at most ``distance`` bits differ. Candidate groups come from an exact scheme: of
``distance + 2`` bit blocks two at least are equal in any linked pair, so each fingerprint joins one group for each
choice of two blocks. Within a group the table of Hamming distances to the pivots discards the pairs whose largest coordinate difference exceeds ``distance`` (the triangle inequality: no link is lost), and only the survivors are
compared bit by bit. Large groups are dealt out as tiles, so that no task ever holds more than two tiles, and every tile
pair returns a spanning forest of its links rather than the links.

Defined cases: a null text is the empty text; a text without words has fingerprint zero and is linked like any other;
with fewer words than a shingle has, the whole sequence is the one shingle; equal fingerprints are always linked;
repeated rows get equal results; rows with a null id are linked, but name a component only if it has no other id.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free_names, materialise, named, small_batches, spread
from .components import components

BITS = 64
SEED = 42
#: Number of reference fingerprints; they are drawn from a fixed seed.
PIVOTS = 16
#: Fingerprints of one tile of a large group; groups of up to SMALL_UNIT are compared all together.
TILE = 2048
SMALL_UNIT = 64


def _starts_and_ends(text: str | None) -> tuple[bytes, list[int], list[int]]:
    words = (text or "").encode("utf-8").translate(ASCII_LOWER).split()  # bytes.split() cuts at U+0020 and U+0009 to U+000D
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    return b" ".join(words), (ends - sizes).tolist(), ends.tolist()


def shingle_hashes(text: str | None, size: int = 3) -> np.ndarray:
    """XXH64 of every shingle of ``size`` words, repeats included."""
    joined, starts, ends = _starts_and_ends(text)
    if not starts:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh64_intdigest
    last = ends[size - 1 :] or ends[-1:]
    return np.fromiter([h(joined[a:b], SEED) for a, b in zip(starts, last)], np.uint64, len(last))


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    if not len(hashes):
        return 0
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), 1 << 14):
        part = np.ascontiguousarray(hashes[i : i + (1 << 14)]).view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(hashes), bitorder="little").view(np.uint64)[0])


def with_fingerprint(docs: DataFrame, text_col: str = "text", out_col: str = "fingerprint", size: int = 3) -> DataFrame:
    """``docs`` with the fingerprint as a (signed) long."""

    @F.pandas_udf("long")
    def of(texts: pd.Series) -> pd.Series:
        prints = [fingerprint(shingle_hashes(t if isinstance(t, str) else None, size)) for t in texts]
        return pd.Series(np.array(prints, np.uint64).view(np.int64))

    return small_batches(docs).withColumn(out_col, of(F.col(f"`{text_col}`")))


def pivots(count: int = PIVOTS) -> list[int]:
    return np.random.default_rng(7).integers(-(2**63), 2**63 - 1, count, dtype=np.int64).tolist()


def _groups(fp: Column, distance: int) -> Column:
    """Array of (table, key): the bits of each choice of two out of ``distance + 2`` blocks."""
    edges = np.linspace(0, BITS, distance + 3).round().astype(int).tolist()
    masks = [((1 << b) - (1 << a)) for a, b in itertools.pairwise(edges)]
    signed = [m - (1 << BITS) if m >= 1 << (BITS - 1) else m for m in masks]
    pairs = list(itertools.combinations(signed, 2))
    return F.array(*[F.struct(F.lit(t).alias("t"), fp.bitwiseAND(F.lit(a | b)).alias("key")) for t, (a, b) in enumerate(pairs)])


def _links(prints: np.ndarray, table: np.ndarray, other: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within ``distance``; where both sides occur in ``other``, of pairs of different sides only."""
    order = np.argsort(table[:, 0], kind="stable")
    prints, table, side = prints[order], table[order], other[order]
    split = side.any() and not side.all()
    first = table[:, 0]
    upto = np.searchsorted(first, first + distance, "right")
    counts = upto - np.arange(len(prints)) - 1
    out_i, out_j = [], []
    bounds = np.concatenate([[0], np.cumsum(counts)])
    at = 0
    while at < len(prints):  # rows whose pairs fill a block of about two million
        stop = max(at + 1, int(np.searchsorted(bounds, bounds[at] + 2_000_000, "right")) - 1)
        n = counts[at:stop]
        i = np.repeat(np.arange(at, stop), n)
        j = i + 1 + np.arange(len(i)) - np.repeat(bounds[at:stop] - bounds[at], n)
        if split:
            mixed = side[i] != side[j]
            i, j = i[mixed], j[mixed]
        for k in range(1, table.shape[1]):
            near = np.abs(table[i, k] - table[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        out_i.append(order[i[near]])
        out_j.append(order[j[near]])
        at = stop
    return np.concatenate(out_i), np.concatenate(out_j)


def _small_units(prints: np.ndarray, table: np.ndarray, bounds: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs within ``distance`` of all small units at once: each row against the next, the one after it, and so on. Sides of
    tiles aren't told apart here: pairs within one tile are links as well."""
    sizes = np.diff(bounds)
    unit = np.repeat(np.where(sizes <= SMALL_UNIT, np.arange(len(sizes)), -1), sizes)
    rows = np.flatnonzero(unit >= 0)
    out_i, out_j = [], []
    for step in range(1, SMALL_UNIT):
        rows = rows[rows + step < len(prints)]
        rows = rows[unit[rows] == unit[rows + step]]
        if not len(rows):
            break
        i, j = rows, rows + step
        for k in range(table.shape[1]):
            near = np.abs(table[i, k] - table[j, k]) <= distance
            i, j = i[near], j[near]
        near = np.bitwise_count(prints[i] ^ prints[j]) <= distance
        out_i.append(i[near])
        out_j.append(j[near])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_i]), np.concatenate([none, *out_j])


def forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index that each of n nodes reaches over the links."""
    root = np.arange(n)
    while len(i):
        a, b = root[i], root[j]
        low, high = np.minimum(a, b), np.maximum(a, b)
        np.minimum.at(root, high, low)
        while (deeper := root[root]).tobytes() != root.tobytes():
            root = deeper
        open_ = root[i] != root[j]
        i, j = i[open_], j[open_]
    return root


def pivot_table(prints: np.ndarray) -> np.ndarray:
    """Hamming distances of each print (a row) to each pivot."""
    return np.bitwise_count(prints[:, None] ^ np.array(pivots(), np.int64).view(np.uint64)).astype(np.int16)


def near_pairs(prints: np.ndarray, table: np.ndarray, side: np.ndarray, bounds: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Indices of the pairs within ``distance`` in each unit (the rows between two bounds)."""
    found = [_small_units(prints, table, bounds, distance)]
    for s, e in itertools.pairwise(bounds.tolist()):
        if e - s > SMALL_UNIT:
            i, j = _links(prints[s:e], table[s:e], side[s:e], distance)
            found.append((i + s, j + s))
    i, j = map(np.concatenate, zip(*found, strict=True))
    return i, j


def whole_units(batches, names: tuple[str, ...]):
    """Frames that hold whole runs of equal values of ``names`` (integers), and the bounds of the runs; a run may span batches."""
    rest = None
    for pdf in batches:
        pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        values = pdf[list(names)].to_numpy(np.int64)
        cuts = np.flatnonzero((values[1:] != values[:-1]).any(1)) + 1
        last = int(cuts[-1]) if len(cuts) else 0
        if last:
            yield pdf.iloc[:last], [0, *cuts.tolist()]
        rest = pdf.iloc[last:].reset_index(drop=True)
    if rest is not None and len(rest):
        yield rest, [0, len(rest)]


def dealt(entries: DataFrame, by: tuple[str, ...], payload: tuple[str, ...], tile: int) -> DataFrame:
    """The groups ``by`` of two ``node`` and more, as units ``*by, i, j`` that stand together and in order.

    A group of more than ``tile`` nodes is cut into tiles by a hash; a unit holds one tile (i = j) or two, told apart by
    ``side``, and every pair of nodes meets in one unit at least.
    """
    sizes = entries.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")).filter("_n > 1")
    shared = entries.join(spread(sizes), list(by))
    shared = shared.withColumn("tiles", F.ceil(F.col("_n") / tile)).withColumn("tile", F.pmod(F.xxhash64("node"), F.col("tiles")))
    other = shared.select(*by, "node", *payload, "tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).alias("with"))
    unit = [F.least("tile", "with").alias("i"), F.greatest("tile", "with").alias("j")]
    units = other.select(*by, *unit, "node", *payload, (F.col("tile") > F.col("with")).alias("side"))
    return units.repartition(*by, "i", "j").sortWithinPartitions(*by, "i", "j")


def _edges_of_units(distance: int):
    def run(batches):
        for pdf, bounds in whole_units(batches, ("t", "key", "i", "j")):
            prints = pdf["node"].to_numpy().view(np.uint64)
            table = np.frombuffer(b"".join(pdf["near"]), np.uint8).reshape(len(pdf), -1).astype(np.int16)
            root = forest(len(pdf), *near_pairs(prints, table, pdf["side"].to_numpy(), np.array(bounds), distance))
            moved = np.flatnonzero(root != np.arange(len(pdf)))
            if len(moved):
                yield pd.DataFrame({"a": prints[moved].view(np.int64), "b": prints[root[moved]].view(np.int64)})

    return run


def linked_fingerprints(prints: DataFrame, distance: int = 3) -> DataFrame:
    """Edges ``a, b`` whose components are those of all pairs of the distinct longs ``fp`` within ``distance`` bits."""
    table = F.concat(*[F.unhex(F.lpad(F.hex(F.bit_count(F.col("fp").bitwiseXOR(F.lit(p)))), 2, "0")) for p in pivots()])
    entries = prints.select(F.col("fp").alias("node"), table.alias("near"), F.explode(_groups(F.col("fp"), distance)).alias("g")).select("node", "near", "g.t", "g.key")
    return dealt(entries, ("t", "key"), ("near",), TILE).mapInPandas(_edges_of_units(distance), "a long, b long").distinct()


def _prints(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    own = docs.select(F.col(id_col).alias("_id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("_part"), F.col(text_col).alias("_text"))
    return materialise(with_fingerprint(own, "_text", "fp", size).select("_id", "_part", "fp"), "fingerprints")


def _roots(nodes: DataFrame, distance: int) -> DataFrame:
    """``nodes`` (distinct ``fp``) with ``root``, which is the same for all fingerprints of a component."""
    label = components(linked_fingerprints(nodes.select("fp"), distance)).withColumnRenamed("node", "fp")
    return nodes.join(label, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """``doc_id`` (as ``id_col``), ``fingerprint`` long and ``component_id``: the smallest id reachable over links."""
    prints = _prints(docs, id_col, text_col, size)
    named = materialise(_roots(prints.groupBy("fp").agg(F.min("_id").alias("least")), distance), "components")
    best = named.groupBy("root").agg(F.min("least").alias("component_id"))
    found = named.join(spread(best), "root").select("fp", "component_id")
    return prints.join(spread(found), "fp").select(F.col("_id").alias(id_col), F.col("fp").alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, distance: int = 3) -> DataFrame:
    """The rows of ``docs`` that stand for their component: the one of smallest id (null ids last)."""
    prints = _prints(docs, id_col, text_col, size)
    row = F.struct(F.col("_id").isNull().alias("none"), F.coalesce("_id", F.lit(0)).alias("id"), F.col("_part").alias("part"))
    named_ = materialise(_roots(prints.groupBy("fp").agg(F.min(row).alias("row")), distance), "components")
    (key,) = free_names(docs, "_row")
    kept = named_.groupBy("root").agg(F.min("row").alias(key)).select(key)
    own = F.struct(F.col(id_col).isNull().alias("none"), F.coalesce(F.col(id_col), F.lit(0)).alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("part"))
    return docs.withColumn(key, own).join(kept, key, "left_semi").dropDuplicates([key]).select(*named(docs))
