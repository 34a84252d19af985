"""Quality classifier: Bradley-Terry ranking of documents from preference pairs, thresholded by quantile.

A pair prefers a document of label 1 to one of label 0. The chance that i beats j is the logistic function of
the difference of their scores, and a score is linear in the features, so the fit is a logistic regression on
differences of features. All pairs of all labelled rows count: with the rows of each class summed by narrow bins of
their score, a pass over the rows gives the loss over all pairs and its gradient.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_size, discard, hashed_words, map_texts, prepare, staged
from recollect.llm.toxicity import _platt

IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
#: Bins of the scores in a pass over the labelled rows.
BINS = 2048
#: Weight of the ridge on the squared weights; most Newton steps.
RIDGE = 1e-3
STEPS = 40
#: Deviations beyond which a feature counts as so many.
MOST = 8

#: Bytes of text whose features are made at once: a worker keeps 32 to 64 bytes of powers for each.
AT_ONCE = 1 << 18

_CLASS = np.zeros(256, np.uint8)  # of bytes: 1 upper, 2 lower or part of a non-ASCII character, 3 digit, 4 space, 5 , or ., 6 other
for _b in range(256):
    _c = chr(_b)
    _CLASS[_b] = 2 if _b >= 128 or "a" <= _c <= "z" else 1 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 4 if _b == 32 or 9 <= _b <= 13 else 5 if _c in ",." else 6
FEATURES = ("upper", "digit", "comma", "symbol", "ends_symbol", "bar", "no_letter", "same_as_before", "repeats", "word_length", "long_words", "lines", "words", "few_words")


def features(texts: Sequence[bytes]) -> np.ndarray:
    """A row of FEATURES for each text: shares of bytes and words, mean lengths and logarithms of counts."""
    out = np.zeros((len(texts), len(FEATURES)))
    for lo, hi in by_size(texts, AT_ONCE):
        data = b"\n".join(texts[lo:hi]) + b"\n"
        a = np.frombuffer(data, np.uint8)
        kind = _CLASS[a]
        sizes = np.array([len(t) for t in texts[lo:hi]], np.int64)
        offsets = np.cumsum(sizes + 1) - sizes - 1
        starts, ends, h = hashed_words(data, IS_WORD)
        edge = np.searchsorted(starts, np.append(offsets, len(data)))
        n = np.diff(edge)
        doc = np.repeat(np.arange(hi - lo), n)

        def per_byte(mask: np.ndarray) -> np.ndarray:
            return np.add.reduceat(mask, offsets, dtype=np.int64) / np.maximum(1, sizes)

        def per_word(values: np.ndarray) -> np.ndarray:
            return np.bincount(doc, values, hi - lo) / np.maximum(1, n)

        length = (ends - starts).astype(np.float64)
        letters = np.concatenate(([0], np.cumsum((kind == 1) | (kind == 2))))
        before = np.concatenate(([False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])))
        order = np.lexsort((h, doc))
        again = np.zeros(len(h), bool)
        again[order[1:]] = (h[order[1:]] == h[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
        out[lo:hi] = np.stack(
            (
                per_byte(kind == 1), per_byte(kind == 3), per_byte(kind == 5), per_byte(kind == 6),
                per_word(kind[ends - 1] == 6) if len(ends) else np.zeros(hi - lo),
                per_byte(a == 124), per_word(letters[ends] == letters[starts]), per_word(before), per_word(again),
                per_word(length), per_word(length > 12), per_byte(a == 10), np.log1p(n), n < 5,
            ),
            axis=1,
        )
    return out


@dataclass
class Model:
    """Weights of the scaled features; slope and threshold turn a score into a probability."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    slope: float
    threshold: float

    def rank(self, x: np.ndarray) -> np.ndarray:
        """Bradley-Terry scores. A feature beyond MOST deviations counts as MOST."""
        return np.clip((x - self.mean) / self.scale, -MOST, MOST) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * (self.rank(x) - self.threshold), -40, 40)))


def _pairs(n1: np.ndarray, z1: np.ndarray, n0: np.ndarray, z0: np.ndarray, within: Sequence[np.ndarray], w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """The mean loss over all pairs of a row of label 1 and one of label 0, its gradient and about its curvature.

    n and z are the number and the mean features of the rows of each bin; a bin's rows count with its mean score.
    `within` has each class's mean covariance in a bin, which the curvature alone needs.
    """
    gap = (z1 @ w)[:, None] - (z0 @ w)[None, :]
    share = (n1 / n1.sum())[:, None] * (n0 / n0.sum())[None, :]
    wrong = 1 / (1 + np.exp(np.clip(gap, -40, 40)))
    loss = float((share * np.logaddexp(0, -gap)).sum()) + RIDGE / 2 * float(w @ w)
    p = share * wrong
    grad = z0.T @ p.sum(axis=0) - z1.T @ p.sum(axis=1) + RIDGE * w
    h = p * (1 - wrong)
    a, b, cross = h.sum(axis=1), h.sum(axis=0), z1.T @ h @ z0
    curved = (z1.T * a) @ z1 + (z0.T * b) @ z0 - cross - cross.T + a.sum() * within[1] + b.sum() * within[0]
    return loss, grad, curved + RIDGE * np.eye(len(w))


def _nth(values: DataFrame, n: int) -> float:
    """Midway between the n-th smallest s of `values` (from 1) and the one after it, exactly, by passes over bins."""
    low, high = values.agg(F.min("s"), F.max("s")).first()
    rest = n
    while low < high:
        at = F.least(F.lit(BINS - 1), F.floor((F.col("s") - low) / (high - low) * BINS))
        for _, count, first, last in sorted(values.where(F.col("s").between(low, high)).groupBy(at.alias("bin")).agg(F.count("*"), F.min("s"), F.max("s")).collect()):
            if rest <= count:
                low, high = first, last
                break
            rest -= count
    up_to, after = values.agg(F.count(F.when(F.col("s") <= low, 1)), F.min(F.when(F.col("s") > low, F.col("s")))).first()
    return low if up_to > n or after is None else (low + after) / 2


def _exact(x: np.ndarray | float) -> np.ndarray:
    """x to nine digits: sums in another order give the same model."""
    return np.array([float(f"{v:.9g}") for v in np.ravel(x)])


def fit(rows: DataFrame) -> Model:
    """Fit scores to all preference pairs of `rows` (y 0 or 1, x the FEATURES), then set the threshold.

    Newton steps, each a pass over the rows that brings sums by class and bin of the score to the driver. The
    threshold is the quantile of all labelled rows at the share of label 0: as many rows as are labelled 0 fall
    below it. It lies midway between the scores around that quantile, and there the probability is 0.5. Without rows
    of both classes all texts get a score of 1 or 0, the one label known, or 0.5 for none.
    """
    k = len(FEATURES)
    x = [F.col("x")[i] for i in range(k)]
    n, ones, *stats = rows.agg(F.count("*"), F.sum("y"), *(F.avg(c) for c in x), *(F.stddev_pop(c) for c in x)).first()
    if not n or not 0 < ones < n:
        return Model(np.zeros(k), np.ones(k), np.zeros(k), 1.0, 0.0 if not n else -20.0 if ones else 20.0)
    mean, scale = _exact(stats[:k]), _exact(stats[k:])
    scale[scale < 1e-9] = 1.0
    names = [f"z{i}" for i in range(k)]
    z = rows.select("y", *(F.greatest(F.lit(-float(MOST)), F.least(F.lit(float(MOST)), (c - float(m)) / float(d))).alias(a) for c, m, d, a in zip(x, mean, scale, names, strict=True)))

    def scored(w: np.ndarray) -> DataFrame:
        return z.withColumn("s", sum((F.col(a) * float(v) for a, v in zip(names, w, strict=True)), F.lit(0.0)))

    def products(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, k, k))
        for frame in frames:
            y, *columns = (c.to_numpy(zero_copy_only=False) for c in frame.columns)
            own = np.stack(columns)
            for side in (0, 1):
                total[side] += own[:, y == side] @ own[:, y == side].T
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size)), pa.array(total.ravel())], names=["at", "v"])

    square = np.zeros(2 * k * k)
    for at, v in z.mapInArrow(products, "at bigint, v double").groupBy("at").agg(F.sum("v")).collect():
        square[at] = v
    square = square.reshape(2, k, k)

    def measured(w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        wide = max(2 * MOST * float(np.abs(w).sum()), 1e-9) / BINS
        got = np.array([tuple(r) for r in scored(w).groupBy("y", F.floor(F.col("s") / wide).alias("bin")).agg(F.count("*"), *(F.sum(a) for a in names)).drop("bin").collect()], float)
        sides = [(r[:, 1], r[:, 2:] / r[:, 1:2]) for r in (got[got[:, 0] == side] for side in (0, 1))]
        within = [(square[side] - (means.T * count) @ means) / count.sum() for side, (count, means) in enumerate(sides)]
        return _pairs(*sides[1], *sides[0], within, w)

    w = np.zeros(k)
    loss, grad, curved = measured(w)
    for _ in range(STEPS):
        step = -np.linalg.solve(curved, grad)
        if float(-grad @ step) < 1e-10:
            break
        size = 1.0
        while True:
            then = measured(w + size * step)
            if then[0] <= loss or size < 1e-3:
                break
            size /= 2
        if then[0] > loss:
            break
        w, (loss, grad, curved) = w + size * step, then
    w = _exact(np.round(w, 6))
    found = scored(w)
    cut = float(_exact(_nth(found, n - ones))[0])
    low, high = found.agg(F.min("s"), F.max("s")).first()
    wide = max(high - low, 1e-9) / (2 * BINS)
    bins = found.groupBy("y", F.floor((F.col("s") - low) / wide).alias("bin")).agg(F.count("*"), F.sum("s")).collect()
    y, _, count, total = (np.array(c, float) for c in zip(*sorted(bins, key=lambda r: (r[0], r[1])), strict=True))
    slope, _ = _platt(total / count - cut, y, count)
    return Model(mean, scale, w, max(float(_exact(slope)[0]), 1e-3), cut)


def _bytes(texts: Sequence[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "quality", id_col: str = "doc_id", text_col: str = "text") -> Model:
    """Fit a Model on all labelled rows whose id meets the condition `learn`.

    Labels that are null or without a text are left out. The texts become features before they meet the labels, so
    that only features are shuffled.
    """
    prepare(docs.sparkSession)
    usable = labels.where(F.col(label).isin(0, 1) & learn(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(label).cast("int").alias("y")).distinct()
    texts = docs.where(learn(F.col(id_col))).select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = map_texts(texts, "text", "x array<double>", lambda: lambda texts: [list(features(_bytes(texts)))])
    rows = staged(rows.join(usable, "id").select("y", "x"), "labelled")
    model = fit(rows)
    discard(rows)
    return model


def score(docs: DataFrame, model: Model, text_col: str = "text", keep_text: bool = False) -> DataFrame:
    """docs' other columns, and with `keep_text` the text, with score, 0 to 1.

    Null and empty texts are scored as texts without words.
    """
    prepare(docs.sparkSession)
    return map_texts(docs, text_col, "score double", lambda: lambda texts: [model.score(features(_bytes(texts)))], keep_text=keep_text)
