"""SentencePiece encoding and decoding: an Aho-Corasick automaton over the pieces drives a single-pass Viterbi.

The model file gives the pieces and their scores; it is read on the driver and shipped as a fixed-size list. A text is
walked once: at each character the automaton's output links name every piece that ends there, and each relaxes the best
score of that position. Characters that no piece covers are spelled as byte pieces. No piece crosses from a
non-space to the space before the next word, so the best path of a text is that of its words, and words already seen are
looked up. Texts are not normalised, so decoding returns them exactly.

Defined cases: a null text has null pieces and decodes to null; an empty text has no pieces and decodes to the empty
text; the space mark itself (U+2581) in a text is spelled in bytes; repeated rows and extra columns pass through.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections import deque
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small_batches

SPACE = "▁"
#: Piece types of the model format (fixed values).
NORMAL, USER_DEFINED, BYTE = 1, 4, 6
#: ASCII marks that often end a word.
MARKS = ".,;:!?|*$%&#\"()[]{}<>/=+"
#: Characters below this code, and the space mark, have a column in the automaton's table.
COMMON = 0x180
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


def _fields(data: bytes):
    """(number, value) of each field of a protocol-buffer message; floats as float, messages and strings as bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = data[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    while at < len(data):
        number, kind = divmod(varint(), 8)
        if kind == 0:
            yield number, varint()
        elif kind == 2:
            size = varint()
            yield number, data[at : at + size]
            at += size
        else:
            size = {1: 8, 5: 4}[kind]
            yield number, struct.unpack("<d" if size == 8 else "<f", data[at : at + size])[0]
            at += size


def read_pieces(path: str = MODEL) -> list[tuple[str, float, int]]:
    """(piece, score, type) by id."""
    with open(path, "rb") as f:
        data = f.read()
    pieces = []
    for number, value in _fields(data):
        if number == 1:
            own = dict(_fields(value))
            pieces.append((own.get(1, b"").decode("utf-8"), float(own.get(2, 0.0)), int(own.get(3, NORMAL))))
    return pieces


class _Remembered(dict):
    """Packed ids of words, which stand for ``prefix`` and the word. In two halves: when the newer one is full, the older one
    is forgotten. Words are cut further where no piece goes across: at characters of no piece, and before marks at the end."""

    def __init__(self, model: PieceModel, prefix: str, most: int = 120_000) -> None:
        self.model, self.prefix, self.most, self.older = model, prefix, most, {}

    def __missing__(self, word: str) -> bytes:
        model = self.model
        if word and word[-1] in MARKS and "\n" not in word:
            core = word.rstrip(MARKS)
            if core and core[-1].isalnum() and core[-1] not in model.odd:
                return self[core] + model.bare[word[len(core) :]]
        if model.line_end is not None and "\n" in word:
            head, _, rest = word.partition("\n")
            return self[head] + model.line_end + model.bare[rest]
        ids = self.older.get(word)
        if ids is None:
            ids = _packed(model.best_path(self.prefix + word))
        if len(word) < 64:
            self.make_room()
            self[word] = ids
        return ids

    def make_room(self) -> None:
        if len(self) >= self.most:
            self.older = dict(self)
            self.clear()


def _packed(ids: list[int]) -> bytes:
    return array("i", ids).tobytes()


class PieceModel:
    """Encoder and decoder; the automaton is built at first use in each worker."""

    def __init__(self, pieces: list[tuple[str, float, int]]) -> None:
        self.pieces = pieces
        self.ready = False

    def __getstate__(self) -> dict:
        return {"pieces": self.pieces, "ready": False}

    def _prepare(self) -> None:
        self.byte_ids = {int(p[3:5], 16): i for i, (p, _, kind) in enumerate(self.pieces) if kind == BYTE}
        if len(self.byte_ids) < 256:
            raise ValueError("the model has no pieces for all bytes, so not every text can be encoded")
        usable = [(p, s, i) for i, (p, s, kind) in enumerate(self.pieces) if kind in (NORMAL, USER_DEFINED) and p]
        if any(re.search(f"[^{SPACE}]{SPACE}", p) for p, _, _ in usable):
            raise ValueError("a piece crosses words")
        self.unknown = min((s for _, s, _ in usable), default=0.0) - 10.0
        step: list[dict[str, int]] = [{}]
        ends: list[tuple[int, int, float] | None] = [None]
        for p, s, i in usable:
            at = 0
            for ch in p:
                if ch not in step[at]:
                    step[at][ch] = len(step)
                    step.append({})
                    ends.append(None)
                at = step[at][ch]
            if ends[at] is None or s > ends[at][2]:
                ends[at] = (i, len(p), s)
        fail, order = [0] * len(step), []  # order: by depth, so that what a failure link leads to comes first
        waiting = deque([0])
        while waiting:
            at = waiting.popleft()
            order.append(at)
            for ch, to in step[at].items():
                if at:
                    back = fail[at]
                    while back and ch not in step[back]:
                        back = fail[back]
                    fail[to] = step[back].get(ch, 0)
                waiting.append(to)
        self.step, self.fail = step, fail
        # The output links of each state, followed to their end: (piece id, characters, score), the longest first.
        self.chain: list[tuple[tuple[int, int, float], ...]] = [()] * len(step)
        for at in order:
            self.chain[at] = ((ends[at],) if ends[at] else ()) + self.chain[fail[at]]
        inside = {pair for p, _, _ in usable for pair in zip(p, p[1:])}
        self.odd = {a for a, b in inside if a.isalnum() and b in MARKS}  # letters with a mark after them in a piece
        self.line_end = None if any("\n" in p for p, _, _ in usable) else _packed([self.byte_ids[10]])
        self.known, self.bare = _Remembered(self, SPACE), _Remembered(self, "")
        self._tabulate(order)
        self.raw = [bytes([int(p[3:5], 16)]) if kind == BYTE else p.replace(SPACE, " ").encode() if kind in (NORMAL, USER_DEFINED) else b"" for p, _, kind in self.pieces]
        self.ready = True

    def _move(self, state: int, ch: str) -> int:
        """The next state, over failure links if need be; kept as a step of its own."""
        at = state
        while at and ch not in self.step[at]:
            at = self.fail[at]
        self.step[state][ch] = to = self.step[at].get(ch, 0)
        return to

    def best_path(self, text: str) -> list[int]:
        """Ids of the segmentation of largest total score; ties go to the longer last piece."""
        step, chain, unknown = self.step, self.chain, self.unknown
        best, came, sizes = [0.0], [-1], [1]  # the last piece of each best path and its length; -1: a character in bytes
        state, i, top = 0, 0, 0.0
        for ch in text:
            i += 1
            to = step[state].get(ch)
            state = self._move(state, ch) if to is None else to
            top += unknown
            by, length = -1, 1
            for piece, size, score in chain[state]:
                total = best[i - size] + score
                if total > top:
                    top, by, length = total, piece, size
            best.append(top)
            came.append(by)
            sizes.append(length)
        ids: list[int] = []
        while i:
            if came[i] >= 0:
                ids.append(came[i])
            else:
                ids.extend(self.byte_ids[b] for b in reversed((" " if text[i - 1] == SPACE else text[i - 1]).encode("utf-8")))
            i -= sizes[i]
        ids.reverse()
        return ids

    def _tabulate(self, order: list[int]) -> None:
        """The automaton as arrays, for many words at once: moves over the common characters, failure links followed, and
        each state's output links in a row."""
        chars = sorted({ch for edges in self.step for ch in edges if ch == SPACE or ord(ch) < COMMON})
        self.column = np.full(COMMON + 1, len(chars), np.int64)  # the last column: a character that no piece has
        for k, ch in enumerate(chars):
            self.column[min(ord(ch), COMMON)] = k
        self.moves = np.zeros((len(self.step), len(chars) + 1), np.uint16 if len(self.step) < 65536 else np.int32)
        number = {ch: k for k, ch in enumerate(chars)}
        for at in order:
            if at:
                self.moves[at] = self.moves[self.fail[at]]
            own = [(number[ch], to) for ch, to in self.step[at].items() if ch in number]
            if own:
                self.moves[at, [k for k, _ in own]] = [to for _, to in own]
        self.outputs = np.fromiter(map(len, self.chain), np.int64, len(self.chain))
        self.first = np.cumsum(self.outputs) - self.outputs
        rows = [x for c in self.chain for x in c]
        self.out_id, self.out_size, self.out_score = (np.array([r[k] for r in rows], t) for k, t in enumerate((np.int32, np.int64, np.float64)))

    def best_paths(self, words: list[str]) -> list[bytes]:
        """``best_path`` of many words of common characters, all of them advancing together; packed."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        codes = np.frombuffer("".join(words).encode("utf-32-le"), "<u4").astype(np.int64)
        columns = self.column[np.minimum(codes, COMMON)]
        order = np.argsort(-sizes, kind="stable")  # the longest first, so that those still going are a prefix
        sizes, starts = sizes[order], (np.cumsum(sizes) - sizes)[order]
        n, longest = len(words), int(sizes.max(initial=0))
        best = np.zeros((n, longest + 1))
        came, back = np.full((n, longest + 1), -1, np.int32), np.ones((n, longest + 1), np.int64)
        state = np.zeros(n, np.int64)
        for i in range(1, longest + 1):
            going = int(np.searchsorted(-sizes, -i, "right"))
            state = self.moves[state[:going], columns[starts[:going] + i - 1]].astype(np.int64)
            top = best[:going, i - 1] + self.unknown
            count, first = self.outputs[state], self.first[state]
            rows = np.flatnonzero(count)
            k = 0
            while len(rows):
                out = first[rows] + k
                size = self.out_size[out]
                total = best[rows, i - size] + self.out_score[out]
                better = total > top[rows]
                hit = rows[better]
                top[hit] = total[better]
                came[hit, i], back[hit, i] = self.out_id[out[better]], size[better]
                k += 1
                rows = rows[count[rows] > k]
            best[:going, i] = top
        ids, at, turn = np.zeros((n, longest), np.int32), sizes.copy(), np.zeros(n, np.int64)
        live = np.flatnonzero(at > 0)
        while len(live):
            turn[live] += 1
            ids[live, longest - turn[live]] = came[live, at[live]]
            at[live] -= back[live, at[live]]
            live = live[at[live] > 0]
        out: list[bytes] = [b""] * n
        for row, k, n_ids in zip(order.tolist(), range(n), turn.tolist(), strict=True):
            found = ids[k, longest - n_ids :]
            out[row] = found.tobytes()
        for row in np.flatnonzero((ids < 0).any(1)).tolist():  # characters in bytes
            out[order[row]] = _packed(self.best_path(words[order[row]]))
        return out

    def encode_all(self, texts: list[str | None]) -> list[np.ndarray | None]:
        """``encode`` of some texts, after their new words have been learned all at once."""
        if not self.ready:
            self._prepare()
        plain = [t.split(" ") if t and SPACE not in t and "  " not in t else None for t in texts]
        self.learn([words for words in plain if words])
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, words)), np.int32) if words else None if t is None else self.encode(t) for t, words in zip(texts, plain, strict=True)]

    def learn(self, texts: list[list[str]]) -> None:
        """Remember those words of some texts that are new."""
        known, older = self.known, self.known.older
        words = set(chain.from_iterable(texts))
        cores = set(map(str.rstrip, [w for w in words if w not in known], repeat(MARKS)))
        new = [w for w in cores if w and w not in known and w not in older and len(w) < 40 and "\n" not in w and (w.isascii() or max(w) < chr(COMMON))]
        for k in range(0, len(new), 4096):
            part = new[k : k + 4096]
            known.make_room()
            known.update(zip(part, self.best_paths([SPACE + w for w in part]), strict=True))

    def _part(self, part: str, first: dict[str, bytes]) -> bytes:
        """Ids of a text without the space mark; ``first`` encodes its first word."""
        if "  " not in part:
            word, *words = part.split(" ")
            return first[word] + b"".join(map(self.known.__getitem__, words))
        ids = []
        for run in re.findall(" *[^ ]+| +", (" " if first is self.known else "") + part):  # pieces may hold several spaces
            word = run.lstrip(" ")
            single = len(run) - len(word) == 1 and word
            ids.append(self.known[word] if single else self.bare[run.replace(" ", SPACE)])
        return b"".join(ids)

    def encode(self, text: str) -> np.ndarray:
        if not self.ready:
            self._prepare()
        if not text:
            return np.zeros(0, np.int32)
        mark = _packed([self.byte_ids[b] for b in SPACE.encode("utf-8")])
        parts = (self._part(part, self.bare if k else self.known) for k, part in enumerate(text.split(SPACE)))
        return np.frombuffer(mark.join(parts), np.int32)

    def decode(self, ids) -> str:
        if not self.ready:
            self._prepare()
        raw = self.raw
        return b"".join([raw[i] for i in ids])[1:].decode("utf-8", "replace")


_BUILT: dict[int, PieceModel] = {}


def _built(pieces: list[tuple[str, float, int]]) -> PieceModel:
    """The worker's own automaton for these pieces, kept from task to task."""
    key = hash(tuple(pieces))
    if key not in _BUILT:
        _BUILT[key] = PieceModel(pieces)
    return _BUILT[key]


#: Texts that a worker encodes or decodes at a time; what it returns is one buffer that grows.
SLICE = 256


def encode_pieces(text: Column, pieces: list[tuple[str, float, int]]) -> Column:
    @F.arrow_udf("array<int>")
    def encode(texts: pa.Array) -> pa.Array:
        model = _built(pieces)
        flat, sizes, none = bytearray(), [], []
        for k in range(0, len(texts), SLICE):
            for ids in model.encode_all(texts.slice(k, SLICE).to_pylist()):
                none.append(ids is None)
                sizes.append(0 if ids is None else len(ids))
                if ids is not None:
                    flat += ids.data
        offsets = np.concatenate([[0], np.cumsum(np.array(sizes, np.int64))]).astype(np.int32)
        values = pa.Array.from_buffers(pa.int32(), len(flat) // 4, [None, pa.py_buffer(flat)])
        return pa.ListArray.from_arrays(pa.array(offsets), values, mask=pa.array(none, pa.bool_()))

    return encode(text)


def decode_pieces(ids: Column, pieces: list[tuple[str, float, int]]) -> Column:
    @F.arrow_udf("string")
    def decode(rows: pa.Array) -> pa.Array:
        model = _built(pieces)
        flat, offsets, valid = rows.values.to_numpy(zero_copy_only=False), rows.offsets.to_numpy(), rows.is_valid().to_numpy(zero_copy_only=False)
        spans = list(zip(offsets, offsets[1:], valid))
        parts = [pa.array([model.decode(flat[a:b].tolist()) if ok else None for a, b, ok in spans[k : k + SLICE]], pa.string()) for k in range(0, len(spans), SLICE)]
        return pa.concat_arrays(parts) if parts else pa.array([], pa.string())

    return decode(ids)


def encode_documents(docs: DataFrame, model: str = MODEL, text_col: str = "text", out_col: str = "pieces") -> DataFrame:
    """``docs`` with an array of piece ids."""
    return small_batches(docs).withColumn(out_col, encode_pieces(F.col(f"`{text_col}`"), read_pieces(model)))


def decode_documents(docs: DataFrame, model: str = MODEL, pieces_col: str = "pieces", out_col: str = "decoded") -> DataFrame:
    return small_batches(docs).withColumn(out_col, decode_pieces(F.col(f"`{pieces_col}`"), read_pieces(model)))
