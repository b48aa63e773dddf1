"""Packing of tokenised documents into windows of several lengths.

A document is its tokens and an end token. Whole windows of the longest length are cut off its front; what is left is routed
to the shortest window that holds it. Each tier is then packed, longest windows first: a window opens with a piece of its own
tier, its gap is filled with the longest pieces of shorter tiers that fit, and where none fits a piece is cut so that the
window is full to the token. A task packs the rows of its partition as they come, holds at most ``POOL`` tokens, and leaves
one window that isn't full (that one is padded to the longest length). Nothing is shuffled but a count for each task and
tier: running sums of these number the sequences from 0, long windows first, and the number modulo the number of steps deals
them to steps. So the steps' tokens, padding included, differ by one longest window at most.

Words recur, so a task asks the tokenizer only for the units it hasn't seen: a text is cut before each space that stands
between two characters other than white space, where byte-level pre-tokenizers of this kind cut as well.

Defined cases: a null or empty text has the end token alone; repeated rows and null ids are documents of their own; strings
that look like special tokens are ordinary text; a very long text is tokenised unit by unit and becomes many windows; an
empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import if_small, materialise, small_batches

#: Window lengths. All are powers of two.
TIERS = (1024, 512, 256, 128)
END = 0
#: Tokens that a task gathers before it packs them.
POOL = 1 << 20
#: Tokens of a step, about.
STEP_TOKENS = 1 << 16
#: Units that a worker remembers.
MEMORY = 3 << 19
#: Characters of the texts that are tokenised at once.
TEXT_CHARS = 4 << 20


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Token ids of texts, by way of units that are remembered.

    A unit stands for itself with the space before it; the first unit of a text has none.
    """

    #: A space with white space, or nothing, beside it.
    ODD = re.compile(r" (?:\s|(?<=\s )|\Z)")
    CUT = re.compile(r"(?<=\S) (?=\S)")

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.model._resize_cache(0)  # what it is asked is new to it
        vocabulary = self.tokenizer.get_vocab()
        #: Bytes of each token: a byte-level vocabulary writes each as one character.
        self.bytes = np.zeros(max(vocabulary.values()) + 1, np.int64)
        self.bytes[list(vocabulary.values())] = [len(t) for t in vocabulary]
        #: Each unit's ids as bytes.
        self.known: dict[str, bytes] = {}

    def _learn(self, units: list[str]) -> dict[str, bytes]:
        """Tokenise new units as one text, and find where each ends by the bytes of its tokens."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join([f" {u}" for u in units])], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.searchsorted(np.cumsum(self.bytes[ids]), np.cumsum([len(u.encode()) + 1 for u in units])) + 1
        data, stops = ids.tobytes(), (ends * 4).tolist()
        if len(self.known) + len(units) > MEMORY:
            self.known.clear()
        learned = dict(zip(units, [data[s:e] for s, e in zip([0, *stops], stops)]))
        self.known |= learned
        return learned

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, and the end token."""
        parts = [self.CUT.split(x) if x[:1] == " " or self.ODD.search(x) else x.split(" ") for x in texts]
        found = [list(map(self.known.get, units)) for units in parts]
        new = dict.fromkeys(u for units, ids in zip(parts, found) if None in ids for u, k in zip(units, ids) if k is None)
        if new:
            learned = self._learn(list(new))
            found = [[learned[u] if k is None else k for u, k in zip(units, ids)] if None in ids else ids for units, ids in zip(parts, found)]
        heads = self.tokenizer.encode_batch_fast([units[0] for units in parts], add_special_tokens=False)
        end = np.array([END], np.uint32).tobytes()
        return [np.frombuffer(np.array(head.ids, np.uint32).tobytes() + b"".join(ids[1:]) + end, np.uint32) for head, ids in zip(heads, found)]


class Packer:
    """Fills windows. A piece is ``(document, start, ids)``; ``put`` and ``close`` give ``(window length, pieces)``."""

    def __init__(self, tiers: tuple[int, ...], pool: int) -> None:
        self.tiers, self.pool, self.held = tiers, pool, 0
        self.shelves: list[list[tuple]] = [[] for _ in range(tiers[0])]
        self.lengths: list[int] = []

    def _shelve(self, piece: tuple) -> None:
        n = len(piece[2])
        if not self.shelves[n]:
            insort(self.lengths, n)
        self.shelves[n].append(piece)

    def _take(self, place: int) -> tuple:
        n = self.lengths[place]
        piece = self.shelves[n].pop()
        if not self.shelves[n]:
            del self.lengths[place]
        return piece

    def put(self, document: int, ids: np.ndarray) -> Iterator[tuple[int, list[tuple]]]:
        longest = self.tiers[0]
        whole = len(ids) // longest * longest
        for start in range(0, whole, longest):
            yield longest, [(document, start, ids[start : start + longest])]
        if whole < len(ids):
            self._shelve((document, whole, ids[whole:]))
            self.held += len(ids) - whole
        if self.held > self.pool:
            yield from self._pack()

    def close(self) -> Iterator[tuple[int, list[tuple]]]:
        """Pack what is left; the last window may have a gap."""
        yield from self._pack()
        rest = [self._take(0) for _ in range(sum(map(len, self.shelves)))]
        if rest:
            yield self.tiers[0], rest

    def _pack(self) -> Iterator[tuple[int, list[tuple]]]:
        for tier, shorter in zip(self.tiers, (*self.tiers[1:], 0)):
            # The longest piece left, if it is one of this tier.
            while self.lengths and self.lengths[-1] > shorter:
                window, gap = [first := self._take(-1)], tier - len(first[2])
                while gap and self.lengths:
                    place = bisect_right(self.lengths, gap)
                    piece = self._take(place - 1 if place else 0)
                    if not place:  # none fits: cut the shortest
                        document, start, ids = piece
                        piece = document, start, ids[:gap]
                        self._shelve((document, start + gap, ids[gap:]))
                    window.append(piece)
                    gap -= len(piece[2])
                if gap:  # nothing is left: the window waits for more
                    for piece in window:
                        self._shelve(piece)
                    self.held = tier - gap
                    return
                yield tier, window
        self.held = 0


_PIECES = "part int, tier int, number long, start long, length long, ids_crc32 long, doc_tokens long, offset long"
_ENCODERS: dict[str, Encoder] = {}


def _packing(path: str, tiers: tuple[int, ...], pool: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _ENCODERS:
            _ENCODERS[path] = Encoder(path)
        encoder, packer, part, counts = _ENCODERS[path], Packer(tiers, pool), TaskContext.get().partitionId(), dict.fromkeys(tiers, 0)
        rows: list[tuple] = []
        kind = pa.int64()

        def note(found: Iterator[tuple[int, list[tuple]]]) -> None:
            for tier, pieces in found:
                offset = 0
                for (doc_id, tokens), start, ids in pieces:
                    rows.append((doc_id, part, tier, counts[tier], start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), tokens, offset))
                    offset += len(ids)
                counts[tier] += 1

        def batch() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [()] * len(names)
            types = [kind, pa.int32(), pa.int32(), *[pa.int64()] * 6]
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)
            rows.clear()
            return out

        waiting: list[tuple] = []

        def flush() -> None:
            texts = [text or "" for _, text in waiting]
            for (doc_id, _), ids in zip(waiting, encoder.encode(texts)):
                note(packer.put((doc_id, len(ids)), ids))
            waiting.clear()

        size = 0
        for got in batches:
            kind = got.column(0).type
            for doc_id, text in zip(got.column(0).to_pylist(), got.column(1).to_pylist()):
                waiting.append((doc_id, text))
                size += len(text or "")
                if size > TEXT_CHARS:
                    flush()
                    size = 0
                    yield batch()
        if waiting:
            flush()
        note(packer.close())
        yield batch()

    return run


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, tiers: tuple[int, ...] = TIERS, step_tokens: int = STEP_TOKENS, pool: int = POOL) -> DataFrame:
    """One row for each piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, window, step``.

    ``window`` is the length that the sequence is padded to; ``tiers`` are powers of two, the longest first.
    """
    if list(tiers) != sorted(set(tiers), reverse=True) or any(t < 1 or t & (t - 1) for t in tiers):
        raise ValueError("tiers are distinct powers of two, the longest first")
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", *[c.split()[0] for c in _PIECES.split(", ")]]
    run = _packing(path or tokenizer_path(), tuple(tiers), pool, names)
    pieces = materialise(small_batches(source).mapInArrow(run, f"doc_id {kind}, {_PIECES}"), "pieces")
    counts = pieces.groupBy("tier", "part").agg((F.max("number") + 1).alias("n"))
    totals = {r["tier"]: (r["n"], r["n"] * r["tier"]) for r in counts.groupBy("tier").agg(F.sum("n").alias("n")).collect()}
    steps = max(1, -(-sum(t for _, t in totals.values()) // step_tokens))
    before, ahead = 0, F.lit(0)
    for tier in tiers:  # sequences of longer windows come first
        ahead = F.when(F.col("tier") == tier, before).otherwise(ahead)
        before += totals.get(tier, (0, 0))[0]
    earlier = F.sum("n").over(Window.partitionBy("tier").orderBy("part")) - F.col("n")
    bases = if_small(counts.select("tier", "part", (earlier + ahead).alias("base")), 32)
    out = pieces.join(bases, ["tier", "part"]).withColumn("sequence_id", (F.col("base") + F.col("number")).cast("long"))
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", F.col("tier").alias("window"), (F.col("sequence_id") % steps).alias("step"))
