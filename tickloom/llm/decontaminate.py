"""Benchmark decontamination: n-gram seeds join training passages to test items, Smith-Waterman scores them.

An item's seeds are its n-grams of up to ``size`` words: as many words as any alignment that reaches the threshold must
have in a run (``seed_rule``; two words at 0.6 for all but the shortest items). A document in which as many seeds of an
item stand together as such an alignment must hold is aligned there with the whole item, word by word; so no alignment
that reaches the threshold is lost. The score as a share of the item's own tells verbatim, edited and paraphrased copies.

The seeds of the items reach the tasks as a lookup table while they are few (``small`` is checked against their
words, and their bytes too). Beyond that documents are found by each item's rarest seeds through a shuffle, and texts are read for
the hits only: an item of n seeds of which an alignment holds q is found by its n - q + 1 seeds in the fewest documents,
since q others don't exist. The q - 1 others, however common, are only counted for documents already found.

Defined cases: null and empty texts match nothing; items of few words have seeds of one word; items without words
match nothing; repeated rows give their matches once; a repeated item id with
several texts counts as several items of that name; rows with a null id match like others; extra columns don't matter.
"""

from __future__ import annotations

import math
import re
from collections import defaultdict

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import ASCII_LOWER, free_names, if_small, materialise, named, small_batches

SIZE = 3
#: Words of items that may be sent to every task (about 150 MB as a table of seeds there), and bytes a word.
SMALL, WORD_BYTES = 500_000, 16
MATCH, MISMATCH, GAP = 2, -1, -1
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    return _WORDS.findall((text or "").encode("utf-8").translate(ASCII_LOWER))


def grams_of(words: list[bytes], size: int = SIZE) -> list[tuple[bytes, ...]]:
    return list(zip(*[words[i:] for i in range(size)])) or ([tuple(words)] if words else [])


def smith_waterman(item: np.ndarray, passage: np.ndarray) -> tuple[int, int, int]:
    """Best local score of two sequences of word numbers, and where its passage ends (exclusive) and begins.

    A row at a time: gaps along the row are a running maximum, since each costs the same.
    """
    n = len(passage)
    ramp = np.arange(n + 1) * -GAP
    row, begin = np.zeros(n + 1, np.int64), np.arange(n + 1)
    best, stop, start = 0, 0, 0
    for word in item:
        take = row[:-1] + np.where(passage == word, MATCH, MISMATCH)
        down = row[1:] + GAP
        new, from_ = np.zeros(n + 1, np.int64), np.arange(n + 1)
        diagonal = take >= down
        new[1:] = np.maximum(np.maximum(take, down), 0)
        from_[1:] = np.where(new[1:] == 0, from_[1:], np.where(diagonal, begin[:-1], begin[1:]))
        lifted = new + ramp
        top = np.maximum.accumulate(lifted)
        at = np.maximum.accumulate(np.where(lifted == top, np.arange(n + 1), 0))
        row, begin = top - ramp, from_[at]
        k = int(row.argmax())
        if row[k] > best:
            best, stop, start = int(row[k]), k, int(begin[k])
    return best, stop, start


def points_for(n: int, threshold: float) -> int:
    """The least alignment score with which an item of ``n`` words reaches the threshold."""
    return max(1, math.ceil(threshold * MATCH * n - 1e-9))


def seed_rule(n: int, threshold: float, size: int = SIZE) -> tuple[int, int, int]:
    """Words of a seed, the least number of them in an alignment that reaches the threshold, and its longest passage.

    An alignment with m matches and b gaps or mismatches scores 2m - b, so b is at most 2m less the points wanted. Its
    matches form b + 1 runs at most, which hold m - (s - 1)(b + 1) seeds of s words at least: fewest where m is n, or, for
    single words, where b is 0. The longest seeds that can't be missing are taken. The passage has m + b words at most.
    """
    points = points_for(n, threshold)
    breaks = max(0, MATCH * n - points)
    least = -(-points // MATCH)
    for s in range(min(size, n), 1, -1):
        need = min(m - (s - 1) * (MATCH * m - points + 1) for m in (least, n))
        if need > 0:
            return s, need, n + breaks
    return 1, least, n + breaks


class Items:
    """The test items by number, and the items of each seed; each item has seeds of its own size."""

    def __init__(self, rows: list[tuple[int, str]], threshold: float, size: int = SIZE) -> None:
        self.ids, self.words, self.threshold = [r[0] for r in rows], [words_of(r[1]) for r in rows], threshold
        self.rules = [seed_rule(len(w), threshold, size) for w in self.words]
        places: dict[tuple[bytes, ...], dict[int, None]] = defaultdict(dict)
        for k, words in enumerate(self.words):
            for gram in grams_of(words, self.rules[k][0]):
                places[gram][k] = None
        self.places = {g: list(own) for g, own in places.items()}
        self.sizes = sorted({len(g) for g in self.places})
        self._numbers: dict[int, tuple[dict[bytes, int], np.ndarray]] = {}

    def found(self, words: list[bytes]) -> list[tuple[int, tuple[bytes, ...]]]:
        """(position, seed) for every seed of the items in the words."""
        places = self.places
        return [(i, g) for n in self.sizes for i, g in enumerate(zip(*[words[k:] for k in range(n)])) if g in places]

    def numbers(self, k: int) -> tuple[dict[bytes, int], np.ndarray]:
        """Numbers of the words of an item, and the item in them."""
        if k not in self._numbers:
            item = self.words[k]
            numbers = {w: n for n, w in enumerate(dict.fromkeys(item))}
            self._numbers[k] = numbers, np.fromiter((numbers[w] for w in item), np.int64, len(item))
        return self._numbers[k]


def passages(at: list[int], rule: tuple[int, int, int], n_words: int) -> list[tuple[int, int]]:
    """Spans of words outside which no alignment reaches the threshold: around seeds that stand close enough together."""
    s, need, longest = rule
    spans: list[tuple[int, int]] = []
    for first, last in zip(at, at[need - 1 :]):
        if last + s - first <= longest:
            low, high = max(0, last + s - longest), min(n_words, first + longest)
            if spans and low <= spans[-1][1]:
                spans[-1] = (min(low, spans[-1][0]), max(high, spans[-1][1]))
            else:
                spans.append((low, high))
    return spans


def matches(items: Items, words: list[bytes]) -> list[tuple[int, float, int, int]]:
    """(item id, score, first word, words) of each item whose best alignment reaches the threshold."""
    hits: dict[int, list[int]] = defaultdict(list)
    for i, gram in items.found(words):
        for k in items.places[gram]:
            hits[k].append(i)
    out = []
    for k, at in hits.items():
        rule, n = items.rules[k], len(items.words[k])
        if len(at) < rule[1]:
            continue
        points, best = points_for(n, items.threshold), (0, 0, 0)
        for low, high in passages(at, rule, len(words)):
            numbers, own = items.numbers(k)
            passage = np.fromiter((numbers.get(w, -1) for w in words[low:high]), np.int64, high - low)
            # As many words of the item as matches are needed must stand within the longest passage.
            known = np.concatenate([[0], np.cumsum(passage >= 0)])
            reach = min(rule[2], high - low)
            if (known[reach:] - known[: len(known) - reach]).max() * MATCH < points:
                continue
            score, stop, start = smith_waterman(own, passage)
            best = max(best, (score, low + start, low + stop))
        if best[0] >= points:
            out.append((items.ids[k], best[0] / (MATCH * n), best[1], best[2] - best[1]))
    return out


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", threshold: float = 0.6, size: int = SIZE, small: int = SMALL) -> DataFrame:
    """A row for each document and item whose alignment reaches ``threshold``: ids, ``score``, ``first_word``, ``n_words``."""
    own = items.select(F.col(item_col).cast("long").alias("item_id"), F.coalesce(F.col(item_text_col), F.lit("")).alias("text"))

    @F.pandas_udf("long")
    def n_words(texts: pd.Series) -> pd.Series:
        return pd.Series([len(words_of(t)) for t in texts], dtype="int64")

    words, used = own.agg(F.coalesce(F.sum(n_words("text")), F.lit(0)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    if words > small or used > small * WORD_BYTES:
        return _joined(docs, own, id_col, text_col, threshold, size)
    docs = small_batches(docs)
    sent = docs.sparkSession.sparkContext.broadcast([(r["item_id"], r["text"]) for r in own.orderBy("item_id", "text").collect()])

    def align(batches):
        known = Items(sent.value, threshold, size)
        for pdf in batches:
            rows = []
            for doc_id, text in zip(pdf["id"].astype("Int64"), pdf["text"], strict=True):
                if isinstance(text, str):
                    rows += [(doc_id, *m) for m in matches(known, words_of(text))]
            if rows:
                yield _frame(rows)

    return _named(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInPandas(align, SCHEMA), id_col)


SCHEMA = "id long, item_id long, score double, first_word long, n_words long"


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=[c.split()[0] for c in SCHEMA.split(", ")])
    return out.astype({"id": "Int64", "item_id": "Int64", "score": "float64"})


def clean(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` without a match. A row is known by its id and its text, so a null id is no hindrance."""
    part = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    key, own_text = free_names(docs, "_part", "_text")
    # Matches carry the hash of their text in the place of the id, and one text matches alike under any id.
    own = docs.select(part.alias(key), F.col(text_col).alias(own_text))
    found = materialise(contaminated(own, items, key, own_text, **options).select(key).distinct(), "contaminated")
    return docs.withColumn(key, part).join(if_small(found, 16), key, "left_anti").select(*named(docs))


def _named(found: DataFrame, id_col: str) -> DataFrame:
    return found.distinct().withColumnRenamed("id", id_col)


def rarest(seeds: DataFrame, counts: DataFrame) -> DataFrame:
    """``rare`` for each of ``seeds`` (``item_id, item_part, need, gram, n`` times in the item): whether it is one of those in the
    fewest documents, ties by hash, of which no ``need`` seeds of the item can do without one. The others hold ``need`` - 1 places
    of the item at most. Seeds of no document count as well."""
    item = Window.partitionBy("item_id", "item_part")
    known = seeds.join(counts, "gram", "left").withColumn("n_docs", F.coalesce("n_docs", F.lit(0)))
    before = F.sum("n").over(item.orderBy("n_docs", "gram").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")
    known = known.withColumns({"_before": before, "_all": F.sum("n").over(item)})
    return known.withColumn("rare", F.col("_before") < F.col("_all") - F.col("need") + 1).drop("_before", "_all")


def _joined(docs: DataFrame, items: DataFrame, id_col: str, text_col: str, threshold: float, size: int) -> DataFrame:
    """The same for items too many for a lookup table: the items' rarest seeds and the documents' n-grams meet in a shuffle by
    hash. For the pairs so found the other seeds are counted; a document is read for an item if it holds as many of the item's
    seeds as an alignment that reaches the threshold must have."""
    def digests(words: list[bytes], size: int) -> np.ndarray:
        return np.array([xxhash.xxh64_intdigest(b" ".join(g)) for g in zip(*[words[i:] for i in range(size)])], np.uint64).view(np.int64)

    @F.pandas_udf("array<long>")
    def seeds(texts: pd.Series) -> pd.Series:
        found = [words_of(t) for t in texts]
        return pd.Series([digests(w, seed_rule(len(w), threshold, size)[0]) for w in found])

    @F.pandas_udf("size int, need long")
    def rules(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([seed_rule(len(words_of(t)), threshold, size)[:2] for t in texts], columns=["size", "need"])

    tests = items.select("item_id", F.xxhash64("text").alias("item_part"), F.col("text").alias("item")).distinct().withColumn("rule", rules("item"))
    sizes = sorted(r[0] for r in tests.select("rule.size").distinct().collect())

    @F.pandas_udf("array<long>")
    def every_seed(texts: pd.Series) -> pd.Series:
        found = [words_of(t if isinstance(t, str) else None) for t in texts]
        return pd.Series([np.unique(np.concatenate([np.zeros(0, np.int64), *[digests(w, n) for n in sizes]])) for w in found])

    corpus = small_batches(docs).select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text_col), F.lit(""))).alias("part"), F.col(text_col).alias("text"))
    theirs = tests.select("item_id", "item_part", F.col("rule.need").alias("need"), F.explode(seeds("item")).alias("gram")).groupBy("item_id", "item_part", "need", "gram").agg(F.count(F.lit(1)).alias("n"))
    theirs = materialise(theirs, "item-seeds")
    ours = corpus.select("id", "part", F.explode(every_seed("text")).alias("gram"))
    ours = materialise(ours.join(if_small(theirs.select("gram").distinct(), 16), "gram", "left_semi"), "document-seeds")
    ranked = materialise(rarest(theirs, ours.groupBy("gram").agg(F.count(F.lit(1)).alias("n_docs"))), "ranked-seeds")
    pair = ["id", "part", "item_id", "item_part", "need"]
    met = materialise(ours.join(ranked.filter("rare"), "gram").groupBy(*pair).agg(F.sum("n").alias("n")), "met-by-rare-seeds")
    common = ranked.filter("NOT rare").select(F.col("item_id").alias("test"), F.col("item_part").alias("test_part"), "gram", F.col("n").alias("more"))
    asked = met.filter("n < need").join(common, (F.col("item_part") == F.col("test_part")) & F.col("item_id").eqNullSafe(F.col("test")))
    holds = ours.select(F.col("id").alias("doc"), F.col("part").alias("doc_part"), F.col("gram").alias("own"))
    held = asked.join(holds, (F.col("gram") == F.col("own")) & (F.col("part") == F.col("doc_part")) & F.col("id").eqNullSafe(F.col("doc")))
    shared = held.groupBy(*pair, "n").agg(F.sum("more").alias("more")).filter("n + more >= need").select(*pair)
    pairs = met.filter("n >= need").select(*pair).unionByName(shared).drop("need").distinct()
    read = corpus.select(F.col("id").alias("doc"), F.col("part").alias("doc_part"), "text").distinct()
    texts = pairs.join(read, (F.col("part") == F.col("doc_part")) & F.col("id").eqNullSafe(F.col("doc"))).select("id", "text", "item_id", "item_part")
    every = tests.select(F.col("item_part").alias("test_part"), F.col("item_id").alias("test"), "item")
    both = texts.join(every, (F.col("item_part") == F.col("test_part")) & F.col("item_id").eqNullSafe(F.col("test"))).select("id", "text", "item_id", "item")

    def align(batches):
        for pdf in batches:
            rows = []
            for doc_id, text, item_id, item in zip(pdf["id"].astype("Int64"), pdf["text"], pdf["item_id"].astype("Int64"), pdf["item"], strict=True):
                rows += [(doc_id, *m) for m in matches(Items([(item_id, item)], threshold, size), words_of(text))]
            if rows:
                yield _frame(rows)

    return _named(both.mapInPandas(align, SCHEMA), id_col)
