"""Stupid-backoff scores from n-gram counts of the whole corpus.

Documents are dealt out in chunks by a hash. Each chunk counts its own distinct n-grams first and sends them, packed as
sorted arrays, to the count tables, which are partitioned by ranges of the n-gram hash. A table adds up what all chunks
sent and answers every chunk with the totals of the n-grams that it asked for. The chunk's documents are joined to these
answers and each document sums its scores. A frequent n-gram is one entry for each chunk, however often it stands there.

A word's score is count(n-gram) / count(context), for the longest n-gram with other occurrences, times ``alpha`` for each
order given up. With ``leave_out`` (the default) a document's own occurrences don't count, or it would explain itself. A
word that no other document holds scores ``alpha`` ** orders / (words elsewhere + 1).

Defined cases: words are ``[^\\x20\\x09-\\x0D]+`` after A-Z are lower-cased; a null, empty or blank text has 0 words, sum 0
and a null mean; repeated rows are documents of their own (equal ids with equal texts share a chunk); null ids and very long texts are ordinary; an empty table
gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ASCII_LOWER

ORDER, ALPHA = 3, 0.4
#: Bits of an n-gram's hash. Of d distinct n-grams of the corpus a share of about d / 2**BITS meets another one's hash:
#: two in a million at 10 billion.
BITS = 52
CHUNK_BYTES = 4 << 20
RESULT = "id long, n_words long, log_sum double, log_mean double"


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def pack(values: np.ndarray) -> bytes:
    """Unsigned integers as byte planes, without the planes that are all zero."""
    values = np.ascontiguousarray(values, "<u8")
    width = max(1, (int(values.max()).bit_length() + 7) // 8) if len(values) else 1
    return bytes([width]) + values.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def unpack(data: bytes) -> np.ndarray:
    planes = np.frombuffer(data, np.uint8, offset=1).reshape(data[0], -1)
    out = np.zeros((planes.shape[1], 8), np.uint8)
    out[:, : data[0]] = planes.T
    return out.reshape(-1).view("<u8")


def pack_sparse(values: np.ndarray) -> bytes:
    """Unsigned integers of which most are zero: a bit for each, and the others packed."""
    return len(values).to_bytes(4, "little") + np.packbits(values > 0).tobytes() + pack(values[values > 0])


def unpack_sparse(data: bytes) -> np.ndarray:
    n = int.from_bytes(data[:4], "little")
    stop = 4 + (n + 7) // 8
    out = np.zeros(n, np.uint64)
    out[np.unpackbits(np.frombuffer(data[4:stop], np.uint8), count=n).astype(bool)] = unpack(data[stop:])
    return out


class Chunk:
    """N-gram hashes of a list of texts: ``keys[n - 1]`` for every word that ends an n-gram of order n within its text."""

    def __init__(self, texts: list[str | None], order: int) -> None:
        known = _Hashes()
        hashes = [self._words(t, known) for t in texts]
        self.sizes = np.array([len(h) for h in hashes], np.int64)
        base = np.concatenate([np.zeros(0, np.uint64), *hashes])
        del known, hashes
        self.doc = np.repeat(np.arange(len(texts), dtype=np.int32), self.sizes)
        self.place = (np.arange(len(base)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)).astype(np.int32)
        self.keys, now = [], base * np.uint64(0x9E3779B97F4A7C15) ^ (base >> np.uint64(29))
        self.ends = []
        for n in range(1, order + 1):
            if n > 1:
                now = now[:-1] * np.uint64(0xC2B2AE3D27D4EB4F) + base[n - 1 :] if len(base) >= n else now[:0]
                now = now ^ (now >> np.uint64(31))
            mixed = now * np.uint64(0xD6E8FEB86659FD93)  # spreads the keys over the ranges
            mixed ^= mixed >> np.uint64(32)
            ends = np.flatnonzero(self.place >= n - 1).astype(np.int32)
            self.ends.append(ends)
            self.keys.append(mixed[ends - (n - 1)] >> np.uint64(64 - BITS))

    @staticmethod
    def _words(text: str | None, known: _Hashes) -> np.ndarray:
        words = text.encode("utf-8").translate(ASCII_LOWER).split() if isinstance(text, str) else []
        return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))

    def distinct(self, inverse: bool = False):
        found = np.concatenate(self.keys)
        self.keys = []  # once is enough
        return np.unique(found, return_inverse=inverse, return_counts=True)


def _count(order: int, bits: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        keys, counts = Chunk(list(pdf["text"]), order).distinct()
        table = (keys >> np.uint64(BITS - bits)).astype(np.int64) if bits else np.zeros(len(keys), np.int64)
        cuts = np.flatnonzero(np.diff(table, prepend=-1))
        bounds = [*cuts.tolist(), len(keys)]
        rows = [(int(table[s]), pack(np.diff(keys[s:e], prepend=keys[s] >> np.uint64(BITS - bits) << np.uint64(BITS - bits) if bits else np.uint64(0))), pack_sparse(counts[s:e] - 1)) for s, e in zip(bounds, bounds[1:])]
        out = pd.DataFrame(rows, columns=["table", "keys", "counts"])
        return out.assign(chunk=pdf["chunk"].iloc[0])[["table", "chunk", "keys", "counts"]]

    return run


def _total(pdf: pd.DataFrame) -> pd.DataFrame:
    keys = [np.cumsum(unpack(k), dtype=np.uint64) for k in pdf["keys"]]  # within the table's own range
    counts = [unpack_sparse(c) + np.uint64(1) for c in pdf["counts"]]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    totals = np.bincount(where, np.concatenate(counts), len(distinct)).astype(np.uint64)
    bounds = np.cumsum([0, *[len(k) for k in keys]])
    others = [pack_sparse(totals[where[s:e]] - c) for s, e, c in zip(bounds, bounds[1:], counts)]
    return pd.DataFrame({"chunk": pdf["chunk"], "table": pdf["table"], "others": others})


def score_texts(chunk: Chunk, where: np.ndarray, totals: np.ndarray, words: int, order: int, alpha: float, leave_out: bool) -> np.ndarray:
    """Summed log scores by text; ``where``: the number of each key in ``totals``, orders one after another."""
    count = totals[where].astype(np.float64)
    elsewhere = np.full(len(chunk.sizes), float(words))
    if leave_out:
        pairs = np.concatenate([chunk.doc[e] for e in chunk.ends]) * np.int64(max(1, len(totals))) + where
        _, pair, own = np.unique(pairs, return_inverse=True, return_counts=True)
        del pairs
        count -= own[pair]
        del pair, own
        elsewhere -= chunk.sizes
    bounds = np.cumsum([0, *[len(e) for e in chunk.ends]])
    by_order = []
    for n in range(order):
        full = np.zeros(len(chunk.doc))
        full[chunk.ends[n]] = count[bounds[n] : bounds[n + 1]]
        by_order.append(full)
    start = np.minimum(order, chunk.place + 1)
    value = alpha**start / (elsewhere[chunk.doc] + 1)
    open_ = np.ones(len(chunk.doc), bool)
    for n in range(order, 0, -1):
        top = by_order[n - 1]
        below = elsewhere[chunk.doc] if n == 1 else np.append(0.0, by_order[n - 2][:-1])
        hit = open_ & (start >= n) & (top > 0)
        value[hit] = alpha ** (start[hit] - n) * top[hit] / below[hit]
        open_ &= ~hit
    return np.bincount(chunk.doc, np.log(value), len(chunk.sizes))


def _score(order: int, alpha: float, words: int, leave_out: bool):
    def run(docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        chunk = Chunk(list(docs["text"]), order)
        _, where, own = chunk.distinct(inverse=True)
        others = [unpack_sparse(t) for t in answers.sort_values("table")["others"]]
        totals = np.concatenate([np.zeros(0, np.uint64), *others]) + own.astype(np.uint64)
        sums = score_texts(chunk, where, totals, words, order, alpha, leave_out)
        means = np.divide(sums, chunk.sizes, out=np.full(len(sums), np.nan), where=chunk.sizes > 0)
        out = pd.DataFrame({"id": docs["id"].astype("Int64"), "n_words": chunk.sizes, "log_sum": sums})
        return out.assign(log_mean=pd.array(np.where(np.isnan(means), None, means), "Float64"))

    return run


def backoff_scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, alpha: float = ALPHA, leave_out: bool = True, chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """``doc_id`` (as ``id_col``), ``n_words``, ``log_sum`` and ``log_mean`` of the natural logs of the words' scores."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    size, words = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0)), F.coalesce(F.sum(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))), F.lit(0))).first()
    chunks = max(1, math.ceil(size / chunk_bytes))
    bits = math.ceil(math.log2(chunks))
    own = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    own = own.select("id", "text", F.pmod(F.xxhash64("id", "text"), F.lit(chunks)).alias("chunk"))
    asked = own.groupBy("chunk").applyInPandas(_count(order, bits), "table long, chunk long, keys binary, counts binary")
    answered = asked.groupBy("table").applyInPandas(_total, "chunk long, table long, others binary")
    scored = own.groupBy("chunk").cogroup(answered.groupBy("chunk")).applyInPandas(_score(order, alpha, words, leave_out), RESULT)
    return scored.withColumnRenamed("id", id_col)
