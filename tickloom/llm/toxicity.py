"""Toxicity scores from a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A text's features are the hashed n-grams (UTF-8 bytes of the lower-cased text) that it holds, and those that it holds at
least twice and three times. The fit takes the log ratio of the smoothed shares of toxic and other documents with a
feature as its scale, and trains a logistic classifier on the scaled features. All of this uses a bounded sample of
labelled documents; scores are for whole texts.

Features are hashed and counted in Spark. Only those that some fit can use (``min_docs``, ``min_ratio``) reach the driver,
as integers: its memory doesn't depend on the length of the texts but for the features that tell the classes apart.

Defined cases: null and empty texts have no features and get the score of the intercept; with only one class to learn
from, every text gets that class's share; rows with a null id are scored but not learned from; of several texts under
one id the least is learned from; repeated rows get equal scores; extra columns are carried through, one named like the
output is replaced.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, small_batches

BITS = 22
SIZES = (4, 6, 8)
#: An n-gram counts as a feature for each of its first occurrences, up to so many.
LEVELS = 3


class Hasher:
    """Distinct hashed features of a text: n-grams that it holds at least once, twice and three times."""

    def __init__(self) -> None:
        self.seen = np.zeros(1 << BITS, np.int32)
        self.count = np.arange(1 << 16, dtype=np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        raw = np.frombuffer(f" {text or ''} ".lower().encode("utf-8"), np.uint8).astype(np.uint32)
        return np.concatenate([level for n in SIZES for level in self._levels(self._grams(raw, n))])

    def _grams(self, raw: np.ndarray, n: int) -> np.ndarray:
        size = max(0, len(raw) - n + 1)
        h = np.full(size, n, np.uint32)
        for i in range(n):
            h *= np.uint32(0x01000193)
            h ^= raw[i : i + size]
        h *= np.uint32(0x9E3779B1)
        return h >> np.uint32(32 - BITS)

    def _levels(self, h: np.ndarray):
        """Values that occur, then those that occur again, and so on; each under a code of its own."""
        if len(h) > len(self.count):
            self.count = np.arange(len(h), dtype=np.int32)
        for level in range(LEVELS):
            at = self.count[: len(h)]
            self.seen[h] = at  # the last place of each value wins
            last = self.seen[h] == at
            yield h[last] ^ np.uint32(level * 0x5BD1E995 & (1 << BITS) - 1)
            h = h[~last]


class NaiveBayesLinear:
    def __init__(self, weights: np.ndarray, intercept: float) -> None:
        self.weights, self.intercept = weights, intercept

    def __getstate__(self) -> tuple:
        """Few features have a weight: they travel to the tasks, not the whole table."""
        used = np.flatnonzero(self.weights).astype(np.int32)
        return used, self.weights[used], self.intercept

    def __setstate__(self, state: tuple) -> None:
        used, weights, self.intercept = state
        self.weights = np.zeros(1 << BITS, np.float32)
        self.weights[used] = weights

    def scores(self, texts: list[str | None]) -> np.ndarray:
        hasher = Hasher()
        return _sigmoid(np.array([self.weights[hasher(t if isinstance(t, str) else None)].sum(dtype=np.float64) for t in texts], np.float64) + self.intercept)


class Rows:
    """Features of documents one after another: those of document i are ``col[start[i] : start[i + 1]]``."""

    def __init__(self, rows: list[np.ndarray]) -> None:
        self.start = np.concatenate([[0], np.cumsum([len(r) for r in rows])]).astype(np.int64)
        self.col = np.concatenate([np.zeros(0, np.int32), *rows]).astype(np.int32)

    def __len__(self) -> int:
        return len(self.start) - 1

    def blocks(self, most: int = 1 << 19):
        """Ranges of documents that hold about ``most`` features, with those and the document of each."""
        low = 0
        while low < len(self):
            high = max(low + 1, int(np.searchsorted(self.start, self.start[low] + most, "right")) - 1)
            yield low, high, self.col[self.start[low] : self.start[high]], np.repeat(np.arange(high - low, dtype=np.int32), np.diff(self.start[low : high + 1]))
            low = high

    def sums(self, values: np.ndarray) -> np.ndarray:
        """The sum of ``values`` over the features of each document."""
        out = np.zeros(len(self))
        for low, high, col, row in self.blocks():
            out[low:high] = np.bincount(row, values[col], high - low)
        return out

    def spread(self, of_rows: np.ndarray, n: int) -> np.ndarray:
        """For each of n features the sum of ``of_rows`` over the documents that hold it."""
        out = np.zeros(n)
        for low, high, col, row in self.blocks():
            out += np.bincount(col, of_rows[low:high][row], n)
        return out


def _solve(rows: Rows, n: int, y: np.ndarray, inside: np.ndarray, min_docs: int, min_ratio: float, penalty: float, steps: int) -> tuple[np.ndarray, float]:
    """Weights of the n features and the intercept, learned from the documents ``inside``, for classes of equal weight;
    features in few documents or with an even ratio get no weight."""
    inside = inside.astype(np.float64)
    toxic, other = rows.spread(inside * y, n), rows.spread(inside * (1 - y), n)
    n_toxic, n_other = (inside * y).sum(), (inside * (1 - y)).sum()
    # Shares of documents with the feature, so that an even feature has ratio 0.
    ratio = np.log((toxic + 1) / (n_toxic + 2)) - np.log((other + 1) / (n_other + 2))
    scale = np.where((toxic + other >= min_docs) & (np.abs(ratio) >= min_ratio), ratio, 0.0)
    size = n_toxic + n_other
    scale /= max(1.0, np.sqrt((rows.sums(scale * scale) * inside).sum() / size))
    w, b, m, v = np.zeros(n), 0.0, np.zeros(n + 1), np.zeros(n + 1)
    cost = inside * np.where(y == 1, size / (2 * n_toxic), size / (2 * n_other)) / size
    for step in range(1, steps + 1):
        error = cost * (_sigmoid(rows.sums(scale * w) + b) - y)
        grad = np.append(scale * rows.spread(error, n) + penalty * w / size, error.sum())
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        move = 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w * scale, float(b)


def _calibrate(margin: np.ndarray, y: np.ndarray, share: float) -> tuple[float, float]:
    """Slope and offset that turn margins of unseen documents into log odds, for a share of label 1 as in all rows."""
    a, b = 1.0, 0.0
    cost = np.where(y == 1, share / y.sum(), (1 - share) / (len(y) - y.sum()))
    for _ in range(50):  # Newton steps, with a light pull towards slope 1
        p = _sigmoid(a * margin + b)
        r, h = cost * (p - y), cost * p * (1 - p) + 1e-9
        grad = np.array([(r * margin).sum() + 1e-3 * (a - 1), r.sum()])
        hess = np.array([[(h * margin * margin).sum() + 1e-3, (h * margin).sum()], [(h * margin).sum(), h.sum() + 1e-6]])
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -0.5, 0.5), b - np.clip(move[1], -1, 1)
    return max(float(a), 0.05), float(b)


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(codes: np.ndarray, rows: Rows, labels: np.ndarray, part: np.ndarray, share: float, min_docs: int = 5, min_ratio: float = 1.5, penalty: float = 3e-3, steps: int = 200) -> NaiveBayesLinear:
    """``rows`` hold places in ``codes``, the features that may be used; ``part``: the fold of each document, in which its
    margin is measured for the calibration; ``share``: of label 1 among all rows."""
    y = np.asarray(labels, np.float64)
    share = min(max(share, 1e-6), 1 - 1e-6)
    dense = np.zeros(1 << BITS, np.float32)
    if not len(y) or y.min() == y.max():
        return NaiveBayesLinear(dense, float(np.log(share / (1 - share))))
    options = (min_docs, min_ratio, penalty, steps)
    margin = np.zeros(len(y))
    for k in np.unique(part):
        inside = part != k
        if 0 < y[inside].sum() < inside.sum():
            weights, b = _solve(rows, len(codes), y, inside, *options)
            margin[~inside] = rows.sums(weights)[~inside] + b
    weights, b = _solve(rows, len(codes), y, np.ones(len(y), bool), *options)
    slope, offset = _calibrate(margin, y, share)
    dense[codes] = weights * slope
    return NaiveBayesLinear(dense, slope * b + offset)


#: Ranges of codes that are counted apart, and partitions of the sample, whose size is bounded.
RANGES, SAMPLE_PARTS = 64, 16


def _counted(folds: int):
    """Counts of documents by code for each class and fold, a row for each range of codes: codes that occur (as 16-bit
    offsets) and their counts."""

    def run(batches):
        hasher, counts = Hasher(), np.zeros((2 * folds, 1 << BITS), np.uint16)
        for pdf in batches:
            for text, mark, part in zip(pdf["text"], pdf["mark"], pdf["part"], strict=True):
                counts[mark * folds + part, hasher(text)] += 1
        for k, own in enumerate(np.split(counts, RANGES, axis=1)):
            found = np.flatnonzero(own.any(0))
            yield pd.DataFrame({"k": [k], "codes": [found.astype(np.uint16).tobytes()], "counts": [own[:, found].tobytes()]})

    return run


def _passing(sizes: np.ndarray, min_docs: int, min_ratio: float):
    """Of each range a bit for every code that passes in the whole sample or without one of the folds."""
    folds = sizes.shape[1]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.zeros((2, folds, (1 << BITS) // RANGES))
        for codes, counts in zip(pdf["codes"], pdf["counts"], strict=True):
            at = np.frombuffer(codes, np.uint16)
            total[:, :, at] += np.frombuffer(counts, np.uint16).reshape(2, folds, len(at))
        keep = np.zeros(total.shape[2], bool)
        for used in [np.ones(folds, bool), *(np.arange(folds) != k for k in range(folds))]:
            docs, of = total[:, used].sum(1), sizes[:, used].sum(1)
            ratio = np.log((docs[1] + 1) / (of[1] + 2)) - np.log((docs[0] + 1) / (of[0] + 2))
            keep |= (docs.sum(0) >= min_docs) & (np.abs(ratio) >= min_ratio - 1e-9)
        return pd.DataFrame({"k": pdf["k"].iloc[:1], "keep": [np.packbits(keep).tobytes()]})

    return run


def _useful(sample: DataFrame, folds: int, min_docs: int, min_ratio: float) -> np.ndarray:
    """A bit for each code that some fit can use."""
    sizes = np.zeros((2, folds))
    for r in sample.groupBy("mark", "part").agg(F.count(F.lit(1)).alias("n")).collect():
        sizes[r["mark"], r["part"]] = r["n"]
    counts = sample.select("text", "mark", "part").mapInPandas(_counted(folds), "k int, codes binary, counts binary")
    found = counts.groupBy("k").applyInPandas(_passing(sizes, min_docs, min_ratio), "k int, keep binary").collect()
    keep = np.zeros((RANGES, (1 << BITS) // RANGES // 8), np.uint8)
    for r in found:
        keep[r["k"]] = np.frombuffer(r["keep"], np.uint8)
    return keep.ravel()


def _features(sample: DataFrame, keep: np.ndarray) -> DataFrame:
    """``sample`` with ``features``: the features of ``text`` by their places among all wanted codes (a bit for each code),
    packed as 32-bit integers."""

    @F.pandas_udf("binary")
    def of(texts: pd.Series) -> pd.Series:
        hasher, bits = Hasher(), np.unpackbits(keep).astype(bool)
        place = np.cumsum(bits, dtype=np.int32) - 1
        return pd.Series([place[f[bits[f]]].tobytes() for f in map(hasher, texts)])

    return sample.withColumn("features", of("text"))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_class: int = 4000, folds: int = 3, min_docs: int = 5, min_ratio: float = 1.5) -> NaiveBayesLinear:
    """Fit on at most ``per_class`` labelled documents of each class; ``labels`` holds the rows that may be learned from."""
    marks = labels.filter(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("_doc")).agg(F.max(label_col).cast("int").alias("mark"))
    share = marks.agg(F.avg("mark")).first()[0] or 0.0
    order = marks.filter("_doc IS NOT NULL")
    chosen = [order.filter(F.col("mark") == k).orderBy(F.xxhash64("_doc"), "_doc").limit(per_class) for k in (0, 1)]
    chosen = F.broadcast(chosen[0].union(chosen[1]))  # 2 * per_class rows at most
    own = docs.select(F.col(id_col).alias("_doc"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    sample = own.join(chosen, "_doc").groupBy("_doc", "mark").agg(F.min("text").alias("text"))
    sample = sample.withColumn("part", F.pmod(F.xxhash64(F.lit(1), "_doc"), F.lit(folds)).cast("int"))
    sample = materialise(sample.repartition(SAMPLE_PARTS, "_doc"), "toxicity-sample")
    keep = _useful(small_batches(sample), folds, min_docs, min_ratio)
    # 2 * per_class rows, of features that tell the classes apart.
    found = _features(sample, keep).select("_doc", "mark", "part", "features").orderBy("_doc").toPandas()
    discard(sample)
    rows = Rows([np.frombuffer(f, np.int32) for f in found["features"]])
    return fit(np.flatnonzero(np.unpackbits(keep)), rows, found["mark"].to_numpy(), found["part"].to_numpy(), share, min_docs, min_ratio)


def score(docs: DataFrame, model: NaiveBayesLinear, text_col: str = "text", out_col: str = "toxicity") -> DataFrame:
    """``docs`` with a column of scores from 0 to 1."""

    @F.pandas_udf("double")
    def scores(texts: pd.Series) -> pd.Series:
        return pd.Series(model.scores(list(texts)))

    return small_batches(docs).withColumn(out_col, scores(F.col(f"`{text_col}`")))
