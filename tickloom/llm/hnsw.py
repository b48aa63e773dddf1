"""Approximate nearest neighbours: one navigable small-world graph for each shard, shard results merged.

Distinct vectors are hashed to shards of about ``shard_bytes``. A task builds the layered graph of its shard as flat
arrays (for each layer, a row of neighbour numbers for each node) and stores it as one row. Nodes enter a layer in batches:
each is linked to near nodes before it that aren't nearer to one another, and those take it up in the same way. As shards
are bounded, the near nodes come from products of a batch with the nodes before it. Every block of queries is sent to
every shard, searched there by the graph, and the shards' nearest are merged. Scores are exact cosines in double precision
of the original vectors.

Defined cases: vectors that are null, zero, or hold null or non-finite components take no part, neither as candidates nor
as queries, nor do rows with a null id; vectors of another length than the query aren't compared with it; of equal
vectors the smallest ids count (as many as can be in a result); ties go to the smaller id; a repeated row is one
candidate and one query; rows of one id with several vectors are queries of their own, each with ranks from 1, and no row
of the query's id is in its result; fewer candidates than ``k`` give fewer rows; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

M, NEAR, EF_SEARCH = 16, 48, 256
#: Bytes of the vectors (in double precision) of a shard and of a block of queries: a shard is sent for each block and a query
#: for each shard. Building costs the square of a shard, and a search of ``EF_SEARCH`` finds less in a larger one.
SHARD_BYTES, QUERY_BYTES = 16 << 20, 64 << 20


class Graph:
    """Layers of flat neighbour arrays over unit vectors; -1 fills up a row. Layers hold the first nodes, fewer at the top."""

    def __init__(self, unit: np.ndarray, layers: list[np.ndarray], nodes: list[np.ndarray], entry: int) -> None:
        self.unit, self.layers, self.nodes, self.entry = unit, layers, nodes, entry

    @classmethod
    def build(cls, unit: np.ndarray, m: int = M, near: int = NEAR, seed: int = 3) -> Graph:
        n = len(unit)
        level = np.minimum((-np.log(np.random.default_rng(seed).random(n) + 1e-12) / math.log(m)).astype(int), 6)
        order = np.argsort(-level, kind="stable")  # the top layer comes first, so the entry is in place
        graph = cls(unit[order], [], [order.astype(np.int32)], 0)
        for top in range(int(level.max(initial=0)) + 1):
            graph.layers.append(graph._layer(int((level >= top).sum()), 2 * m if top == 0 else m, m, near))
        return graph

    def _layer(self, count: int, width: int, m: int, near: int) -> np.ndarray:
        rows = np.full((count, width), -1, np.int32)
        done = 1
        while done < count:
            stop = min(count, done + max(1, min(256, done // 4)))
            scores = self.unit[done:stop] @ self.unit[:stop].T
            scores[np.arange(stop) >= np.arange(done, stop)[:, None]] = -np.inf  # only nodes before it
            if stop > near:
                found = np.argpartition(-scores, near - 1, axis=1)[:, :near]
            else:
                found = np.tile(np.arange(stop), (stop - done, 1))
            at = np.take_along_axis(scores, found, 1)
            own = self._choose(np.where(at > -np.inf, found, -1), at, m)
            rows[done:stop, : own.shape[1]] = own
            self._take_up(rows, own, done)
            done = stop
        return rows

    def _take_up(self, rows: np.ndarray, own: np.ndarray, done: int) -> None:
        """Give the nodes that new ones are linked to the links back."""
        r, c = np.nonzero(own >= 0)
        to, new = own[r, c], r + done
        score = np.einsum("ij,ij->i", self.unit[to], self.unit[new])
        order = np.lexsort((-score, to))
        to, new = to[order], new[order]
        others, first, count = np.unique(to, return_index=True, return_counts=True)
        place = np.arange(len(to)) - np.repeat(first, count)
        most = rows.shape[1]  # no more than these could stay
        incoming = np.full((len(others), min(most, int(count.max()))), -1, np.int64)
        held = place < most
        incoming[np.repeat(np.arange(len(others)), count)[held], place[held]] = new[held]
        block = max(1, (1 << 22) // ((most + incoming.shape[1]) * self.unit.shape[1]))
        for i in range(0, len(others), block):
            node = others[i : i + block]
            cand = np.concatenate([rows[node], incoming[i : i + block]], 1)
            at = np.einsum("ijk,ik->ij", self.unit[np.maximum(cand, 0)], self.unit[node])
            rows[node] = self._choose(cand, np.where(cand >= 0, at, -np.inf), most)

    def _choose(self, cand: np.ndarray, near: np.ndarray, most: int) -> np.ndarray:
        """Of each row of candidates the nearest, leaving out what lies nearer to one already chosen; filled up with the
        nearest left out. -1 stands for none."""
        order = np.argsort(-near, 1, kind="stable")
        cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
        vectors = self.unit[np.maximum(cand, 0)]
        mutual = vectors @ vectors.transpose(0, 2, 1)
        open_, chosen, count = cand >= 0, np.zeros(cand.shape, bool), np.zeros(len(cand), int)
        for i in range(cand.shape[1]):
            take = open_[:, i] & (count < most)
            chosen[:, i] = take
            count += take
            open_ &= ~(take[:, None] & (mutual[:, i] >= near))
        rank = np.where(chosen, 0, np.where(cand >= 0, 1, 2))
        best = np.argsort(rank, 1, kind="stable")[:, :most]
        return np.take_along_axis(cand, best, 1).astype(np.int32)

    def _beam(self, queries: np.ndarray, start: np.ndarray, layer: int, ef: int, size: int) -> tuple[np.ndarray, np.ndarray]:
        """The ``ef`` best nodes (ids, similarities; best first) that a greedy search of each query finds in a layer."""
        rows, q = self.layers[layer], len(queries)
        seen = np.zeros((q, max(size, 1)), bool)
        ids = np.full((q, ef), -1, np.int64)
        near = np.full((q, ef), -np.inf, np.float32)
        opened = np.ones((q, ef), bool)
        ids[:, 0] = start[:, 0]
        near[:, 0] = (self.unit[start[:, 0]] * queries).sum(1)
        opened[:, 0] = False
        seen[np.arange(q), start[:, 0]] = True
        active = np.arange(q)
        while len(active):
            waiting = ~opened[active]
            going = waiting.any(1)
            active, waiting = active[going], waiting[going]
            if not len(active):
                break
            pick = waiting.argmax(1)  # the best unopened, as rows are sorted
            opened[active, pick] = True
            around = rows[ids[active, pick]].astype(np.int64)
            fresh = around >= 0
            fresh &= ~seen[active[:, None], np.where(fresh, around, 0)]
            seen[np.repeat(active, fresh.sum(1)), around[fresh]] = True
            found = np.full(around.shape, -np.inf, np.float32)
            r, c = np.nonzero(fresh)
            found[r, c] = np.einsum("ij,ij->i", self.unit[around[r, c]], queries[active[r]])
            all_near = np.concatenate([near[active], found], 1)
            order = np.argsort(-all_near, 1, kind="stable")[:, :ef]
            all_ids = np.concatenate([ids[active], np.where(fresh, around, -1)], 1)
            near[active] = np.take_along_axis(all_near, order, 1)
            ids[active] = np.take_along_axis(all_ids, order, 1)
            opened[active] = np.take_along_axis(np.concatenate([opened[active], ~fresh], 1), order, 1)
        return ids, near

    def search(self, queries: np.ndarray, k: int, ef: int = EF_SEARCH) -> np.ndarray:
        """Positions (in the order given to ``build``) of up to k nearest, -1 where there are fewer."""
        found = []
        for i in range(0, len(queries), 256):
            own = queries[i : i + 256]
            start = np.zeros((len(own), 1), np.int64)
            for layer in range(len(self.layers) - 1, 0, -1):
                start = self._beam(own, start, layer, 1, len(self.unit))[0][:, :1]
            found.append(self._beam(own, start, 0, max(ef, k), len(self.unit))[0][:, :k])
        ids = np.concatenate(found)
        return np.where(ids >= 0, self.nodes[0][np.maximum(ids, 0)], -1)

    def to_bytes(self) -> bytes:
        return np.concatenate([np.array([len(self.layers), self.entry], np.int32), *[np.array(x.shape, np.int32) for x in self.layers], *[x.ravel() for x in self.layers], self.nodes[0]]).astype("<i4").tobytes()

    @classmethod
    def from_bytes(cls, data: bytes, unit: np.ndarray) -> Graph:
        flat = np.frombuffer(data, "<i4")
        count, entry = int(flat[0]), int(flat[1])
        shapes, at, layers = flat[2 : 2 + 2 * count].reshape(-1, 2), 2 + 2 * count, []
        for rows, cols in shapes.tolist():
            layers.append(flat[at : at + rows * cols].reshape(rows, cols))
            at += rows * cols
        back = flat[at:]
        return cls(unit[back], layers, [back], entry)


def _unit(vectors: np.ndarray) -> np.ndarray:
    scaled = vectors / np.abs(vectors).max(1, keepdims=True)  # no overflow or underflow of the squares
    return (scaled / np.sqrt((scaled * scaled).sum(1, keepdims=True))).astype(np.float32)


def cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Row by row, in double precision; rows whose squares would leave its range are scaled first."""

    def fit(v: np.ndarray) -> np.ndarray:
        top = np.abs(v).max(1, keepdims=True)
        return np.where((top > 1e100) | (top < 1e-100), v / top, v)

    a, b = fit(a), fit(b)
    return (a * b).sum(1) / (np.sqrt((a * a).sum(1)) * np.sqrt((b * b).sum(1)))


def _vectors(column: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in column])


def _build(pdf: pd.DataFrame) -> pd.DataFrame:
    vectors = _vectors(pdf["vec"])
    graph = Graph.build(_unit(vectors))
    members = [np.asarray(m, np.int64) for m in pdf["members"]]
    return pd.DataFrame({
        "shard": [int(pdf["shard"].iloc[0])], "dims": [vectors.shape[1]], "graph": [graph.to_bytes()], "vectors": [vectors.tobytes()],
        "counts": [np.array([len(m) for m in members], np.int32).tobytes()], "members": [np.concatenate(members).tobytes()],
    })


INDEX = "shard long, dims int, graph binary, vectors binary, counts binary, members binary"


def valid_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    some = F.exists(vec, lambda x: x != 0)
    return df.filter(F.col(id_col).isNotNull() & vec.isNotNull() & F.coalesce(finite, F.lit(False)) & F.coalesce(some, F.lit(False))).select(F.col(id_col).cast("long").alias("vec_id"), vec.alias("vec"))


def build_index(rows: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", k: int = 5, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row for each shard, materialised. Every distinct vector is in one; its members are its ``k + 1`` smallest ids."""
    own = valid_vectors(rows, id_col, vec_col).distinct()
    least = own.withColumn("r", F.row_number().over(Window.partitionBy("vec").orderBy("vec_id"))).filter(F.col("r") <= k + 1)
    distinct = least.groupBy("vec").agg(F.sort_array(F.collect_list("vec_id")).alias("members"))
    distinct = materialise(distinct.withColumn("dims", F.size("vec")), "vectors")
    shards = max(1, math.ceil((distinct.agg(F.sum("dims")).first()[0] or 0) * 8 / shard_bytes))
    dealt = distinct.withColumn("shard", F.pmod(F.xxhash64("vec"), F.lit(shards)) * 65536 + F.col("dims"))
    return materialise(dealt.groupBy("shard").applyInPandas(_build, INDEX), "hnsw")


def _search(k: int, ef: int):
    def run(queries: pd.DataFrame, index: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(queries) and len(index):
            shard = index.iloc[0]
            vectors = np.frombuffer(shard["vectors"], np.float64).reshape(-1, int(shard["dims"]))
            graph = Graph.from_bytes(shard["graph"], _unit(vectors))
            counts = np.frombuffer(shard["counts"], np.int32)
            members = np.split(np.frombuffer(shard["members"], np.int64), np.cumsum(counts)[:-1])
            wanted = _vectors(queries["vec"])
            found = graph.search(_unit(wanted), k + 1, ef)
            for query_id, part, q, at in zip(queries["vec_id"], queries["part"], wanted, found, strict=True):
                at = at[at >= 0]
                scores = cosines(np.broadcast_to(q, (len(at), len(q))), vectors[at])
                pairs = sorted((-s, v) for s, i in zip(scores.tolist(), at.tolist(), strict=True) for v in members[i].tolist() if v != query_id)
                rows += [(query_id, part, v, -s) for s, v in pairs[:k]]
        return pd.DataFrame(rows, columns=["query_id", "part", "vec_id", "score"]).astype({"query_id": "int64", "part": "int64", "vec_id": "int64", "score": "float64"})

    return run


def nearest(queries: DataFrame, index: DataFrame, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", ef: int = EF_SEARCH, query_bytes: int = QUERY_BYTES) -> DataFrame:
    """``query_id, rank, vec_id, score``: the k nearest found of each query, its own id left out."""
    own = valid_vectors(queries, id_col, vec_col).distinct().withColumn("part", F.xxhash64("vec"))
    shards = index.select("shard", "dims")
    blocks = max(1, math.ceil((own.agg(F.sum(F.size("vec"))).first()[0] or 0) * 8 / query_bytes))
    asked = own.withColumn("block", F.pmod(F.xxhash64("vec_id", "part"), F.lit(blocks))).withColumn("dims", F.size("vec"))
    # Each query goes to every shard: a stated query set against all rows, in blocks. A shard is sent once for each block.
    sent = asked.join(shards.withColumnRenamed("shard", "to"), "dims").select("to", "block", "vec_id", "part", "vec")
    copies = index.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).withColumn("block", F.col("block").cast("long"))
    found = sent.groupBy("to", "block").cogroup(copies.groupBy("shard", "block")).applyInPandas(_search(k, ef), "query_id long, part long, vec_id long, score double")
    order = Window.partitionBy("query_id", "part").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
