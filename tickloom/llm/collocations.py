"""Phrases whose words stand together more often than their parts let expect, by mining level by level.

Texts are cut into pieces and words once: each task writes, for each language, its words as numbers in reading order beside
its own vocabulary. A phrase can't be more frequent than its parts. So after the words each level takes the phrases of one more
word whose two parts were found frequent, first all but the last word, then all but the first.

A level, that of the words too, is first tallied by a key of ``KEY`` bits for each phrase instead of its text: each task adds up
what it meets and hands on, for each of ``BUCKETS`` ranges of keys, the steps from key to key and the counts up to the support,
compressed. Phrases that share a key are added together, so a tally is never below a phrase's count: whatever is frequent is
found, and little else. Only then the words and phrases found at all levels are counted as texts, which makes the results exact.
Texts travel sorted and compressed: a task adds up what it finds, and deals it to buckets of some thousand phrases each.

What was found reaches the chunks as a bit filter of ``BITS_A_KEY`` bits a phrase, ``BITS`` at most. A false positive of the
filter only lets a phrase be counted in vain; however full the filter gets, all results are exact.

Defined cases: a null text is empty, a null language is ``und``; repeated rows count as often as they stand there; pieces
end at ``[.,;:!?\\x0A-\\x0D]``, words at spaces and tabs, so words may hold any other character; A-Z are lower-cased, other
letters stay; equal scores are ordered by count and then by the phrase's UTF-8 bytes; very long texts are ordinary; an
empty table gives an empty result; extra columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import LOWER, UPPER, if_small, materialise, small_batches

LONGEST, SUPPORT, COVERED, TOP = 4, 30, 80, 2000
#: Words of a chunk.
CHUNK = 1 << 19
#: Bytes of counted texts that a task holds before it adds them up; if more than half are left then, it hands them on.
HELD = 48 << 20
#: Phrases of a bucket of texts, about.
TEXTS = 1 << 13
#: Bits of a phrase's hash that are its key, and of those the last, by which keys of one bucket differ.
KEY, LOW = 38, 28
BUCKETS = 1 << KEY - LOW
#: Keys that a task adds up at once.
TALLIED = 1 << 22
#: Bits of the filters of frequent phrases: for each, and at most.
BITS_A_KEY, BITS = 16, 1 << 28
#: Parts in which the best phrases of a language are first looked for.
PARTS = 16

#: Lower case; what ends a piece becomes a line feed, a tab a space.
_SIGNS = bytes.maketrans(UPPER.encode() + b".,;:!?\x0b\x0c\r\t", LOWER.encode() + b"\n" * 9 + b" ")
END = b"\n"

_CHUNKS = "lang string, part int, no int, n long, words array<string>, counts array<long>, ids binary"
_CHUNK_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.int64()), pa.binary()]
_FOUND = "lang string, phrase string, n_words int, a long"
_TEXTS = "lang string, bucket int, size int, raw long, packed binary"
_TEXT_TYPES = [pa.string(), pa.int32(), pa.int32(), pa.int64(), pa.binary()]
_TALLIES = "bucket int, size int, packed binary"
_TALLY_TYPES = [pa.int32(), pa.int32(), pa.binary()]


def _planes(numbers: np.ndarray) -> bytes:
    """Numbers as all their first bytes, all their second and so on: what is alike stands together."""
    return numbers.view(np.uint8).reshape(-1, numbers.itemsize).T.tobytes()


def _from_planes(data, kind: str) -> np.ndarray:
    return np.frombuffer(data, np.uint8).reshape(np.dtype(kind).itemsize, -1).T.copy().view(kind).ravel()


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _batch(ddl: str, types: list[pa.DataType], columns: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) if isinstance(c, list) else c.cast(t) for c, t in zip(columns, types)], [x.split()[0] for x in ddl.split(", ")])


def _chunks(size: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, no = TaskContext.get().partitionId(), 0
        open_chunks: dict[str, tuple[_Numbers, list[np.ndarray]]] = {}
        held = 0

        def close(lang: str) -> pa.RecordBatch:
            nonlocal no, held
            numbers, found = open_chunks.pop(lang)
            ids = np.concatenate(found)
            counts = np.bincount(ids, minlength=len(numbers))
            words = [w.decode() for w in numbers]
            n = int(counts.sum() - counts[0])
            row = [[lang], [part], [no], [n], [words[1:]], [counts[1:].tolist()], [_planes(ids.astype("<i4"))]]
            no, held = no + 1, held - len(ids)
            return _batch(_CHUNKS, _CHUNK_TYPES, row)

        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                numbers, found = open_chunks.setdefault(lang, (_Numbers({END: 0}), []))
                words = text.encode().translate(_SIGNS).replace(END, b" \n ").split(b" ")
                ids = np.fromiter(map(numbers.__getitem__, filter(None, words)), np.int32)
                found += [ids, np.zeros(1, np.int32)]
                held += len(ids) + 1
                while held > size:  # the language of which most is held
                    yield close(max(open_chunks, key=lambda k: sum(map(len, open_chunks[k][1]))))
        for lang in list(open_chunks):
            yield close(lang)

    return run


# ---- filters ----

#: Bits by which a hash is turned before that of the next word is added.
TURN = 21
#: Where a filter's three bits are read off a key that stands twice in a row.
SHIFTS = (0, 13, 26)


def bit_filter(keys: DataFrame, bits: int | None) -> np.ndarray:
    """Bits of the filter of ``key``, packed: three bits a key. Their number is a power of two; if not given, it follows that of the keys."""
    bits = bits or min(BITS, 1 << max(20, (keys.count() * BITS_A_KEY - 1).bit_length()))
    twice = F.col("key").bitwiseOR(F.shiftleft("key", KEY))
    place = F.explode(F.array(*[F.shiftrightunsigned(twice, s).bitwiseAND(F.lit(bits - 1)) for s in SHIFTS]))
    found = keys.select(place.alias("bit")).groupBy(F.shiftright("bit", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, cast(bit % 64 as int))")).alias("bits"))
    got = found.toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[got["word"].to_numpy()] = got["bits"].to_numpy()
    return out


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode(), 42)


def _hashes(words: pa.Array) -> np.ndarray:
    return np.fromiter(map(_hash, words.to_pylist()), np.uint64, len(words))


def _start(lang: str) -> np.ndarray:
    """What the hash of a language's phrases starts from."""
    return np.full(1, _hash(f"{lang}\t"), np.uint64)


def _next(h: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases that go on with one more word."""
    return (h << np.uint64(TURN) | h >> np.uint64(64 - TURN)) ^ words


def _keys(h: np.ndarray) -> np.ndarray:
    return h >> np.uint64(64 - KEY)


def _passes(bits: np.ndarray, keys: np.ndarray) -> np.ndarray:
    twice = keys | keys << np.uint64(KEY)
    out = np.ones(len(keys), bool)
    for s in SHIFTS:
        bit = (twice >> np.uint64(s)) & np.uint64(len(bits) * 64 - 1)
        out &= (bits[(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63)).astype(np.int64)) & 1 == 1
    return out


# ---- counting in a chunk ----


class _Chunk:
    """A chunk's words by place. Phrases of n words start at the first ``len(ids) - n + 1`` places; ``inside[n - 1]`` tells which
    of these lie in one piece."""

    def __init__(self, lang: str, words: pa.Array, ids: np.ndarray, longest: int) -> None:
        self.lang, self.ids = lang, ids
        self.words = pa.concat_arrays([pa.array([""], pa.string()), words])
        self.hashes = _hashes(self.words)
        self.inside = [ids > 0]
        for n in range(2, longest + 1):
            self.inside.append(self.inside[-1][: max(0, len(ids) - n + 1)] & (ids[n - 1 :] > 0))

    def keys(self, longest: int) -> list[np.ndarray]:
        """Keys of the phrases of 1 to ``longest`` words at each place."""
        of_words = self.hashes[self.ids]
        out = [_next(_start(self.lang), of_words)]
        for n in range(2, longest + 1):
            out.append(_next(out[-1][: max(0, len(self.ids) - n + 1)], of_words[n - 1 :]))
        return [_keys(h) for h in out]

    def counted_words(self, chosen: np.ndarray, keys: np.ndarray) -> pa.Table:
        """How often the words of some numbers occur."""
        return pa.table({"phrase": self.words.take(pa.array(chosen)), "key": keys, "n": np.bincount(self.ids, minlength=len(self.words))[chosen]})

    def counted(self, spots: np.ndarray, n: int, keys: np.ndarray) -> pa.Table:
        """The distinct phrases of ``n`` words at some places, and how many there are of each."""
        code = self.ids[spots]
        for i in range(1, n):
            __, first, code, counts = np.unique(code << 32 | self.ids[spots + i], return_index=True, return_inverse=True, return_counts=True)
        places = spots[first]
        text = pc.binary_join_element_wise(*[self.words.take(pa.array(self.ids[places + i])) for i in range(n)], " ")
        return pa.table({"phrase": text, "key": keys[places], "n": counts})


def _opened(batches: Iterator[pa.RecordBatch], longest: int) -> Iterator[_Chunk]:
    for batch in batches:
        for lang, words, ids in zip(*[batch.column(c) for c in ("lang", "words", "ids")]):
            yield _Chunk(lang.as_py(), words.values, _from_planes(ids.as_buffer(), "<i4").astype(np.int64), longest)


def _tallying(found_in, support: int):
    """Tallies of the keys, each with its count or None for ones, that ``found_in`` yields from some chunks."""
    kind = np.min_scalar_type(support).newbyteorder("<")

    def tallied(found: list[np.ndarray], times: list[np.ndarray | None]) -> Iterator[pa.RecordBatch]:
        if times[0] is None:
            keys, counts = np.unique(np.concatenate(found), return_counts=True)
        else:
            keys, at = np.unique(np.concatenate(found), return_inverse=True)
            counts = np.bincount(at, np.minimum(np.concatenate(times), support))
        counts = np.minimum(counts, support).astype(kind)
        edges = np.searchsorted(keys, np.arange(BUCKETS + 1, dtype=np.uint64) << np.uint64(LOW))
        held = np.flatnonzero(np.diff(edges))
        low = (keys & np.uint64((1 << LOW) - 1)).astype("<u4")
        steps = np.diff(low, prepend=low[:1])
        steps[edges[held]] = low[edges[held]]
        for some in np.array_split(held, -(-len(held) // 64)):
            cut = [slice(edges[b], edges[b + 1]) for b in some]
            packed = [pa.compress(_planes(steps[c]) + counts[c].tobytes(), "zstd", asbytes=True) for c in cut]
            yield _batch(_TALLIES, _TALLY_TYPES, [some.tolist(), [c.stop - c.start for c in cut], packed])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, times, size = [], [], 0
        for keys, counts in found_in(batches):
            if size and size + len(keys) > TALLIED:
                yield from tallied(found, times)
                found, times, size = [], [], 0
            if len(keys):
                found.append(keys)
                times.append(counts)
                size += len(keys)
        if size:
            yield from tallied(found, times)

    return run


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Keys and counts of the chunks' words."""
    for batch in batches:
        for lang, words, counts in zip(*[batch.column(c) for c in ("lang", "words", "counts")]):
            yield _keys(_next(_start(lang.as_py()), _hashes(words.values))), counts.values.to_numpy()


def _longer(bits, n: int):
    """Keys of the phrases of ``n`` words whose parts of one word less pass the filter."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, None]]:
        for chunk in _opened(batches, n):
            keys = chunk.keys(n)
            part = _passes(bits.value, keys[n - 2]) & chunk.inside[n - 2]
            yield keys[n - 1][part[:-1] & part[1:] & chunk.inside[n - 1]], None

    return run


def _frequent(support: int):
    """Keys of a bucket whose tallies add up to the support."""
    kind = np.min_scalar_type(support).newbyteorder("<")

    def run(tallies: pa.Table) -> pa.Table:
        found = []
        for size, packed in zip(tallies["size"].to_pylist(), tallies["packed"]):
            data = pa.decompress(packed.as_buffer(), size * (4 + kind.itemsize), "zstd")
            keys = np.cumsum(_from_planes(data[: 4 * size], "<u4"), dtype=np.uint64)
            found.append(keys << np.uint64(32) | np.frombuffer(data, kind, offset=4 * size))
        both = np.sort(np.concatenate(found))
        keys = both >> np.uint64(32)
        first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
        often = np.add.reduceat(both & np.uint64(0xFFFFFFFF), first) >= support
        bucket = np.uint64(tallies["bucket"][0].as_py()) << np.uint64(LOW)
        return pa.table({"key": pa.array((keys[first[often]] | bucket).astype(np.int64))})

    return run


def _added_up(tables: list[pa.Table]) -> pa.Table:
    found = pa.concat_tables(tables).group_by("phrase", use_threads=False).aggregate([("key", "min"), ("n", "sum")])
    return pa.table({"phrase": found["phrase"], "key": found["key_min"], "n": found["n_sum"]})


def _packed(lang: str, found: pa.Table, buckets: int) -> Iterator[pa.RecordBatch]:
    """Distinct phrases with their counts by bucket, as lengths, counts and texts in their order."""
    found = found.take(pc.sort_indices(found["phrase"]))
    of = (found["key"].to_numpy() & np.uint64(buckets - 1)).astype(np.int32)
    order = np.argsort(of, kind="stable")
    found = found.take(pa.array(order)).combine_chunks()
    edges = np.searchsorted(of[order], np.arange(buckets + 1))
    texts, counts = pa.concat_arrays(found["phrase"].chunks), found["n"].to_numpy()
    __, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, "<i4", len(texts) + 1, 4 * texts.offset)
    held = np.flatnonzero(np.diff(edges))
    for some in np.array_split(held, -(-len(held) // 64)):
        raw = []
        for b in some:
            s, e = edges[b], edges[b + 1]
            raw.append(_planes(np.diff(offsets[s : e + 1]).astype("<u4")) + _planes(counts[s:e].astype("<i8")) + data[offsets[s] : offsets[e]].to_pybytes())
        sizes = [edges[b + 1] - edges[b] for b in some]
        yield _batch(_TEXTS, _TEXT_TYPES, [[lang] * len(some), some.tolist(), sizes, list(map(len, raw)), [pa.compress(r, "zstd", asbytes=True) for r in raw]])


def _counting(word_bits, bits, longest: int, buckets: int):
    """Counts of the words and of the phrases that pass their filters."""

    def counted(chunk: _Chunk) -> Iterator[pa.Table]:
        words = _keys(_next(_start(chunk.lang), chunk.hashes))
        at = np.flatnonzero(_passes(word_bits.value, words))
        at = at[at > 0]
        yield chunk.counted_words(at, words[at])
        keys = chunk.keys(longest)
        for n in range(2, longest + 1):
            at = np.flatnonzero(chunk.inside[n - 1] & _passes(bits.value, keys[n - 1]))
            if len(at):
                yield chunk.counted(at, n, keys[n - 1])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[pa.Table]] = {}
        size = 0

        def emptied() -> Iterator[pa.RecordBatch]:
            for lang, tables in held.items():
                if any(map(len, tables)):
                    yield from _packed(lang, _added_up(tables), buckets)
            held.clear()

        for chunk in _opened(batches, longest):
            for table in counted(chunk):
                held.setdefault(chunk.lang, []).append(table)
                size += table.nbytes
            if size > HELD:
                for lang in held:
                    held[lang] = [_added_up(held[lang])]
                size = sum(t.nbytes for [t] in held.values())
                if size > HELD // 2:
                    yield from emptied()
                    size = 0
        yield from emptied()

    return run


def _summed(support: int):
    """Phrases of a bucket that reach the support, with their counts from all tasks."""

    def run(packed: pa.Table) -> pa.Table:
        held, size = [], 0
        for rows, raw, data in zip(packed["size"].to_pylist(), packed["raw"].to_pylist(), packed["packed"]):
            data = pa.decompress(data.as_buffer(), raw, "zstd")
            offsets = np.concatenate([[0], np.cumsum(_from_planes(data[: 4 * rows], "<u4"))]).astype("<i4")
            texts = pa.StringArray.from_buffers(rows, pa.py_buffer(offsets), data[12 * rows :])
            held.append(pa.table({"phrase": texts, "key": np.zeros(rows, np.uint64), "n": _from_planes(data[4 * rows : 12 * rows], "<i8")}))
            size += held[-1].nbytes
            if size > HELD:
                held = [_added_up(held)]
                size = 0
        found = _added_up(held)
        found = found.filter(pc.greater_equal(found["n"], support))
        lang = pa.array([packed["lang"][0].as_py()] * len(found), pa.string())
        n_words = pc.add(pc.count_substring(found["phrase"], " "), 1).cast(pa.int32())
        return pa.table({"lang": lang, "phrase": found["phrase"], "n_words": n_words, "a": found["n"].cast(pa.int64())})

    return run


#: Chunks that a task is handed at once.
HANDED = 4


@contextmanager
def _few_rows(spark: SparkSession) -> Iterator[None]:
    """Arrow batches of few rows for what runs inside: a chunk is a row of megabytes."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(HANDED))
    try:
        yield
    finally:
        spark.conf.set(name, before)


def mine(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, chunk: int = CHUNK, bits: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``lang, phrase, n_words, a`` of all phrases of up to ``longest`` words that stand ``support`` times in a language, and
    ``lang, n``, the words of each language."""
    spark = docs.sparkSession
    source = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    chunks = materialise(small_batches(source).mapInArrow(_chunks(chunk), _CHUNKS), "word-chunks", compression="zstd")
    totals = chunks.groupBy("lang").agg(F.sum("n").alias("n"))
    slim = chunks.select("lang", "words", "ids")

    def frequent_keys(tallies: DataFrame) -> DataFrame:
        with _few_rows(spark):
            return materialise(tallies.groupBy("bucket").applyInArrow(_frequent(support), "key long"), "frequent-keys")

    keys, found, filters = frequent_keys(chunks.select("lang", "words", "counts").mapInArrow(_tallying(_words, support), _TALLIES)), [], []
    for n in range(2, longest + 1):
        filters.append(spark.sparkContext.broadcast(bit_filter(keys, bits)))
        keys = frequent_keys(slim.mapInArrow(_tallying(_longer(filters[-1], n), support), _TALLIES))
        found.append(keys)
    found = reduce(DataFrame.unionAll, found)
    filled = spark.sparkContext.broadcast(bit_filter(found, bits))
    buckets = min(1 << 20, 1 << max(4, (found.count() // TEXTS).bit_length()))
    counted = slim.mapInArrow(_counting(filters[0], filled, longest, buckets), _TEXTS)
    with _few_rows(spark):
        return materialise(counted.groupBy("lang", "bucket").applyInArrow(_summed(support), _FOUND), "frequent-phrases"), totals


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", support: int = SUPPORT, longest: int = LONGEST, covered: int = COVERED, top: int = TOP, **options) -> DataFrame:
    """Each language's first ``top`` phrases: ``lang, rank, phrase, a, l, r, n, score``.

    The score is floor(2000000 * a / (l + r)) of the cut that gives the lowest; phrases are left out that lie in a longer
    frequent one with ``covered`` percent of their count or more.
    """
    counts, totals = mine(docs, text_col, lang_col, support, longest, **options)
    phrases = counts.filter(F.col("n_words") > 1)
    words = F.split(F.col("phrase"), " ", -1)
    part = lambda start, length: F.array_join(F.slice("words", start, length), " ")
    split = phrases.withColumn("words", words)
    cuts = split.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("n_words") - 1)))
    cuts = cuts.select("lang", "phrase", "a", "k", part(F.lit(1), F.col("k")).alias("head"), part(F.col("k") + 1, F.col("n_words") - F.col("k")).alias("tail"))
    light = if_small(counts.select("lang", "phrase", "a"), F.octet_length("phrase") + 40)
    side = lambda name, to: light.select("lang", F.col("phrase").alias(name), F.col("a").alias(to))
    scored = cuts.join(side("head", "l"), ["lang", "head"]).join(side("tail", "r"), ["lang", "tail"])
    score = F.expr("(cast(a as decimal(20,0)) * cast(2000000 as decimal(7,0))) div (cast(l as decimal(19,0)) + cast(r as decimal(19,0)))")
    best = scored.groupBy("lang", "phrase", "a").agg(F.min(F.struct(score.cast("long").alias("score"), "k", "l", "r")).alias("cut"))
    inner = split.filter(F.col("n_words") > 2).withColumn("size", F.explode(F.sequence(F.lit(2), F.col("n_words") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("n_words") - F.col("size") + 1)))
    longer = inner.groupBy("lang", part(F.col("start"), F.col("size")).alias("phrase")).agg(F.max("a").alias("longer"))
    kept = best.join(longer, ["lang", "phrase"], "left").filter(F.col("longer").isNull() | (F.col("longer").cast("decimal(20,0)") * 100 < F.col("a").cast("decimal(20,0)") * covered))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    first = kept.withColumn("place", F.row_number().over(Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(PARTS))).orderBy(*order))).filter(F.col("place") <= top)
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).filter(F.col("rank") <= top)
    return ranked.join(if_small(totals, 32), "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
