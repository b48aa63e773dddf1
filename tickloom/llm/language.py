"""Language identification with a small byte convolutional network.

The network (one-hot bytes, filters of several widths, max pooling, a softmax layer) is trained in numpy on a bounded
sample of labelled documents and then applied to fixed-length windows that together cover every byte of a text. The
window logits are averaged, weighted by the bytes they hold.

Defined cases: a null text, or one without a letter, is ``und`` with score 0; with no labelled row to learn from, every
text is ``und``; rows with a null id are scored but not learned from; repeated rows get equal results; extra columns are
carried through.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import free_names, small_batches

WINDOW = 256
WIDTHS = (2, 3, 4)
UNKNOWN = "und"


def has_letter(text: str | None) -> bool:
    """Whether a character of the general category L is in the text."""
    return isinstance(text, str) and any(map(str.isalpha, text))


def window_bytes(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Windows (n, WINDOW) of the lower-cased UTF-8 text, overlapping so that no filter position is lost; bytes in each."""
    raw = np.frombuffer(text.lower().encode("utf-8"), np.uint8)
    stride = WINDOW - max(WIDTHS) + 1
    n = max(1, -(-(len(raw) - max(WIDTHS) + 1) // stride))
    padded = np.zeros((n - 1) * stride + WINDOW, np.uint8)
    padded[: len(raw)] = raw[: len(padded)]
    windows = np.lib.stride_tricks.as_strided(padded, (n, WINDOW), (stride, 1))
    held = np.full(n, stride, np.float32)
    held[-1] = max(1, len(raw) - (n - 1) * stride)
    return windows, held


class ByteConvNet:
    def __init__(self, classes: list[str], filters: int = 8, seed: int = 1) -> None:
        rng = np.random.default_rng(seed)
        self.classes, self.filters = classes, filters
        self.weights = [rng.normal(0, 0.1, (w, 256, filters)).astype(np.float32) for w in WIDTHS]
        for w in self.weights:
            w[:, 0] = 0  # padding
        self.bias = np.zeros(filters * len(WIDTHS), np.float32)
        self.dense = rng.normal(0, 0.3, (filters * len(WIDTHS), len(classes))).astype(np.float32)
        self.offset = np.zeros(len(classes), np.float32)
        self.tables: tuple[np.ndarray, np.ndarray] | None = None

    def _parts(self) -> list[np.ndarray]:
        return [*self.weights, self.bias, self.dense, self.offset]

    def compile(self) -> None:
        """Tables for pairs of bytes: offsets 0 and 1 for all filters, offsets 2 and 3 for those wide enough."""
        a, b = np.divmod(np.arange(65536), 256)
        first = np.concatenate([w[0][b] + w[1][a] for w in self.weights], 1)  # little-endian pairs: low byte first
        wide = [w for w in self.weights if len(w) > 2]
        second = np.concatenate([w[2][b] + (w[3][a] if len(w) > 3 else 0) for w in wide], 1)
        self.tables = (np.ascontiguousarray(first, np.float32), np.ascontiguousarray(second, np.float32))

    def places(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Features and where each filter is largest, straight from the filters: for training, where tables wouldn't last."""
        span, values = WINDOW - max(WIDTHS) + 1, []
        for w in self.weights:
            x = w[0].take(windows[:, :span], axis=0)
            for o in range(1, len(w)):
                x += w[o].take(windows[:, o : o + span], axis=0)
            values.append(x)
        x = np.concatenate(values, 2)
        at = x.argmax(1)
        return np.maximum(np.take_along_axis(x, at[:, None], 1)[:, 0] + self.bias, 0), at

    def features(self, windows: np.ndarray) -> np.ndarray:
        pairs = windows[:, :-1].astype(np.uint16) | (windows[:, 1:].astype(np.uint16) << 8)
        first, second = self.tables
        narrow = self.filters * sum(w <= 2 for w in WIDTHS)
        span = WINDOW - max(WIDTHS) + 1
        x = first.take(pairs[:, :span], axis=0)
        x[:, :, narrow:] += second.take(pairs[:, 2 : 2 + span], axis=0)
        return np.maximum(x.max(1) + self.bias, 0)

    def logits(self, windows: np.ndarray) -> np.ndarray:
        out = [self.features(windows[i : i + 64]) @ self.dense + self.offset for i in range(0, len(windows), 64)]
        return np.concatenate(out)

    def fit(self, windows: np.ndarray, labels: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.01, seed: int = 2) -> ByteConvNet:
        rng = np.random.default_rng(seed)
        first = [np.zeros_like(p) for p in self._parts()]
        second = [np.zeros_like(p) for p in self._parts()]
        step, total = 0, epochs * -(-len(windows) // batch)
        for _ in range(epochs):
            order = rng.permutation(len(windows))
            for i in range(0, len(order), batch):
                chosen = order[i : i + batch]
                x, y = windows[chosen], labels[chosen]
                h, at = self.places(x)
                z = h @ self.dense + self.offset
                p = np.exp(z - z.max(1, keepdims=True))
                p /= p.sum(1, keepdims=True)
                p[np.arange(len(y)), y] -= 1
                p /= len(y)
                back = (p @ self.dense.T) * (h > 0)
                grads = []
                for k, w in enumerate(self.weights):
                    own = slice(k * self.filters, (k + 1) * self.filters)
                    g = np.zeros_like(w)
                    for o in range(len(w)):
                        seen = np.take_along_axis(x, at[:, own] + o, 1)
                        np.add.at(g[o], (seen, np.arange(self.filters)[None, :]), back[:, own])
                    g[:, 0] = 0
                    grads.append(g)
                grads += [back.sum(0), h.T @ p, p.sum(0)]
                step += 1
                pace = rate * (1 - step / (total + 1))
                for part, g, m, v in zip(self._parts(), grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    part -= pace * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        self.compile()
        return self

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = []
        for text in texts:
            if not self.classes or not has_letter(text):
                out.append((UNKNOWN, 0.0))
                continue
            windows, held = window_bytes(text)
            z = sum(self.logits(windows[i : i + 1024]).T @ held[i : i + 1024] for i in range(0, len(windows), 1024)) / held.sum()
            p = np.exp(z - z.max())
            k = int(p.argmax())
            out.append((self.classes[k], float(p[k] / p.sum())))
        return out


def sample_labelled(docs: DataFrame, label: Column, learnable: Column, per_class: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``_id, _label, _text`` of up to ``per_class`` documents of each class, by a hash of the id; of several texts under one
    id the least.

    The classes are counted first, and only ids whose hash lies in the share that must hold the sample go on to be ordered:
    so no class, however frequent, is gathered in one task.
    """
    known = docs.filter(learnable).select(F.col(id_col).alias("_id"), label.alias("_label")).filter("_id IS NOT NULL AND _label IS NOT NULL").distinct()
    sizes = known.groupBy("_label").agg(F.count(F.lit(1)).alias("_n"))
    draw = F.pmod(F.xxhash64("_id"), F.lit(1 << 30)) * F.col("_n") / float(1 << 30)
    # Twice the sample and a hundred: fewer than ``per_class`` of them come up with a chance below 1e-12.
    drawn = known.join(sizes, "_label").filter(draw < 2 * per_class + 100)
    order = Window.partitionBy("_label").orderBy(F.pmod(F.xxhash64("_id"), F.lit(1 << 30)), "_id")
    chosen = drawn.withColumn("_place", F.row_number().over(order)).filter(F.col("_place") <= per_class).select("_id", "_label")
    own = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text"))
    found = own.join(F.broadcast(chosen), "_id")  # per_class rows for each class at most
    return found.groupBy("_id", "_label").agg(F.min("_text").alias("_text"))


def train(docs: DataFrame, lang: Column, learnable: Column, id_col: str = "doc_id", text_col: str = "text", per_language: int = 500, windows_each: int = 4) -> ByteConvNet:
    """Fit on at most ``per_language`` documents of each language, ``windows_each`` windows drawn from anywhere in each.

    The windows are cut in tasks: the driver gets these alone, however long the texts are.
    """
    sample = sample_labelled(docs, lang, learnable, per_language, id_col, text_col)

    @F.pandas_udf("binary")
    def cut(texts: pd.Series) -> pd.Series:
        out = []
        for text in texts:
            if has_letter(text):
                windows, _ = window_bytes(text)
                chosen = np.random.default_rng(len(windows)).choice(len(windows), min(windows_each, len(windows)), replace=False)
                out.append(windows[np.sort(chosen)].tobytes())
            else:
                out.append(b"")
        return pd.Series(out)

    rows = small_batches(sample).select("_id", "_label", cut("_text").alias("windows")).orderBy("_id", "_label").toPandas()
    classes = sorted(rows["_label"].unique())
    x = [np.frombuffer(w, np.uint8).reshape(-1, WINDOW) for w in rows["windows"]]
    y = [classes.index(label) for label, w in zip(rows["_label"], x, strict=True) for _ in range(len(w))]
    if not y:
        return ByteConvNet([])
    return ByteConvNet(classes).fit(np.concatenate(x), np.array(y))


def identify(docs: DataFrame, net: ByteConvNet, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """``docs`` with a struct column ``lang string, score double``."""

    @F.pandas_udf("lang string, score double")
    def predict(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(net.predict(list(texts)), columns=["lang", "score"]).astype({"score": "float64"})

    return small_batches(docs).withColumn(out_col, predict(F.col(f"`{text_col}`")))


def with_letters(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text has a letter: what ``identify`` doesn't call unknown, whether or not anything was learned."""

    @F.pandas_udf("boolean")
    def lettered(texts: pd.Series) -> pd.Series:
        return pd.Series([has_letter(t) for t in texts], dtype=bool)

    return small_batches(docs).filter(lettered(F.col(f"`{text_col}`")))
