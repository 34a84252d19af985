"""Toxicity scores: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word's vector is the mean of the vectors of its character n-grams, a text's the mean over its words, and a
linear layer with softmax gives the two classes. Misspelt or inflected words nobody labelled share most
n-grams with known ones, and so most of their vector.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import MULTIPLIER, _powers, by_size, hashed_words, map_texts, prepare
from recollect.llm.spotsigs import IS_WORD

#: Sizes of the n-grams in bytes of UTF-8, with < and > around each word.
SIZES = (3, 4, 5, 6, 7, 8)
BITS = 18
DIM = 16
#: Most labelled rows of each class that the model is fitted on, by order of a hash of the id.
MOST_LABELLED = 1500
#: Texts that damp the step of an n-gram: one that occurs in as many moves half as far as its gradient asks for.
SHRINK = 20
#: Length taken from each vector in a batch of an epoch, at rate 1 and for an n-gram whose curvature is of one text.
LASSO = 10
SEED = 7


def folded(text: str | None) -> bytes:
    return (text or "").lower().encode("utf-8", "surrogatepass")


def grams(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, word by word, and how many each word has: never none."""
    data = np.frombuffer(b"".join(b"<" + w + b">" for w in words), np.uint8)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 2
    power, inverse = _powers(len(data) + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[: len(data)])))
    ends = np.repeat(np.cumsum(lengths), lengths)
    place, out, at = np.arange(len(data)), [], []
    for n in SIZES:
        p = place[place + n <= ends]
        h = (sums[p + n] - sums[p]) * inverse[p] + np.uint64(n)
        h ^= h >> np.uint64(32)
        out.append((h * MULTIPLIER) >> np.uint64(64 - BITS))
        at.append(p)
    owner = np.repeat(np.arange(len(words)), lengths)[np.concatenate(at)]
    order = np.argsort(owner, kind="stable")
    return np.concatenate(out)[order].astype(np.int64), np.bincount(owner, minlength=len(words))


def bags(texts: Sequence[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray, np.ndarray]:
    """The distinct words of the texts; and for each distinct (text, word) text, word and count."""
    words: dict[bytes, int] = {}
    rows, cols, counts = [], [], []
    for k, text in enumerate(texts):
        starts, ends, h = hashed_words(text, IS_WORD)
        _, first, times = np.unique(h, return_index=True, return_counts=True)
        for i, n in zip(first.tolist(), times.tolist(), strict=True):
            rows.append(k)
            cols.append(words.setdefault(text[starts[i] : ends[i]], len(words)))
            counts.append(n)
    return list(words), np.array(rows, np.int64), np.array(cols, np.int64), np.array(counts, np.float64)


@dataclass
class Model:
    """What scoring needs: the softmax's margin of each n-gram bucket, and the calibration of a text's mean."""

    margin: np.ndarray
    slope: float
    offset: float

    def score(self, texts: Sequence[bytes]) -> np.ndarray:
        """Probability of the toxic class for each text."""
        out = np.zeros(len(texts))
        for lo, hi in by_size(texts):
            data = b" ".join(texts[lo:hi])
            starts, ends, h = hashed_words(data, IS_WORD)
            _, first, word = np.unique(h, return_index=True, return_inverse=True)
            if not len(first):
                continue
            buckets, n = grams([data[s:e] for s, e in zip(starts[first].tolist(), ends[first].tolist(), strict=True)])
            value = np.add.reduceat(self.margin[buckets], np.cumsum(n) - n) / n
            total = np.concatenate(([0.0], np.cumsum(value[word])))
            edge = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]]))
            out[lo:hi] = (total[edge[1:]] - total[edge[:-1]]) / np.maximum(1, np.diff(edge))
        return 1 / (1 + np.exp(-np.clip(self.slope * out + self.offset, -40, 40)))


def _platt(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a logistic regression on one feature, by Newton steps with a slight ridge."""
    scale = float(np.std(x)) or 1.0
    a = np.stack((x / scale, np.ones_like(x)), axis=1)
    w = np.zeros(2)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        grad = a.T @ (weight * (p - y)) + 1e-3 * w
        hess = (a * (weight * p * (1 - p))[:, None]).T @ a + 1e-3 * np.eye(2)
        w -= np.linalg.solve(hess, grad)
    return float(w[0] / scale), float(w[1])


def text_grams(n_texts: int, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, buckets: np.ndarray, n: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Each text's distinct n-gram buckets with their shares in the mean over its words of the means over n-grams."""
    at = np.cumsum(n) - n
    edge = np.searchsorted(rows, np.arange(n_texts + 1))
    out = []
    for lo, hi in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
        word, times = cols[lo:hi], counts[lo:hi]
        size = n[word]
        place = np.repeat(at[word] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        own, of = np.unique(buckets[place], return_inverse=True)
        out.append((own.astype(np.int32), np.bincount(of, np.repeat(times / (times.sum() * size), size), len(own)).astype(np.float32)))
    return out


def _together(bags: Sequence[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """N-gram, share and text of all entries of some texts."""
    gram, share = (np.concatenate([np.zeros(0, t), *(x[k] for x in bags)]) for k, t in ((0, np.int32), (1, np.float32)))
    return gram, share, np.repeat(np.arange(len(bags), dtype=np.int32), [len(x[0]) for x in bags])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def gradients(e: np.ndarray, w: np.ndarray, b: float, entries: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, float]:
    """The weighted log loss of some texts; its gradient by n-gram, to be multiplied by w; that of w; that of b.

    A softmax of two classes depends on the difference w of its two columns alone. All texts' gradients by their
    vectors are then multiples of w, so those of the n-grams are kept as one number each.
    """
    gram, share, text = entries
    p = _sigmoid(np.bincount(text, share * (e @ w)[gram], len(y)) + b)
    d = weight * (p - y)
    by_gram = np.bincount(gram, share * d[text], len(e)).astype(e.dtype)
    loss = -float((weight * np.log(np.where(y == 1, p, 1 - p) + 1e-12)).sum())
    return loss, by_gram, by_gram @ e, float(d.sum())


def fit(texts: Sequence[bytes], toxic: Sequence[int], share: float, epochs: int = 24, rate: float = 0.5, batch: int = 64) -> Model:
    """Fit the vectors of all n-grams and the softmax together, from random starts, in minibatches.

    A step of an n-gram's vector is its gradient over the curvature it can have, the sum of its squared shares in
    the texts, raised by SHRINK texts: so n-grams of one text move little and those of very many texts no further
    than need be. After each epoch all vectors are shortened by LASSO (a group lasso), by which those that tell
    nothing become zero, and the rate falls linearly. Both classes weigh the same. A fifth of the rows is left
    out of the fit: it chooses the epoch with the least loss, and calibrates the scores with classes weighted to
    `share`, the share of toxic rows among all that are labelled. Without rows of both classes every text gets
    the same score, `share`.
    """
    y = np.asarray(toxic, np.float64)
    blank = Model(np.zeros(1 << BITS), 0.0, float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))))
    if not 0 < y.sum() < len(y):
        return blank
    rng = np.random.default_rng(SEED)
    held = np.zeros(len(y), bool)
    for k in (0, 1):
        own = rng.permutation(np.flatnonzero(y == k))
        held[own[: len(own) // 5]] = True
    words, rows, cols, counts = bags(texts)
    if not words:
        return blank
    buckets, n = grams(words)
    used, buckets = np.unique(buckets, return_inverse=True)
    text = text_grams(len(y), rows, cols, counts, buckets, n)
    own = np.flatnonzero(~held)
    left_out = held if 0 < y[held].sum() < held.sum() else ~held

    def weights(part: np.ndarray) -> np.ndarray:
        ones = y[part].sum()
        return np.where(y == 1, part.sum() / (2 * max(1, ones)), part.sum() / (2 * max(1, part.sum() - ones)))

    weight, check_weight = weights(~held), weights(left_out)[left_out]
    check, check_y = _together([text[i] for i in np.flatnonzero(left_out)]), y[left_out]
    parts = np.array_split(rng.permutation(own), max(1, len(own) // batch))
    entries = [_together([text[i] for i in part]) for part in parts]
    squares = sum(np.bincount(g, s.astype(np.float64) ** 2, len(used)) for g, s, _ in entries)
    typical = squares.sum() / max(1, sum(len(g) for g, _, _ in entries)) or 1.0
    curvature = squares + SHRINK * typical
    step = (1 / curvature).astype(np.float32)
    shorten = (LASSO * len(parts) * np.sqrt(typical / curvature)).astype(np.float32)
    e = rng.normal(0, 0.1, (len(used), DIM)).astype(np.float32)
    w = rng.normal(0, DIM**-0.5, DIM).astype(np.float32)
    b, best, margin = 0.0, np.inf, np.zeros(1 << BITS)
    for epoch in range(epochs):
        r = np.float32(rate * (1 - epoch / epochs))
        for k in rng.permutation(len(parts)).tolist():
            _, by_gram, d_w, d_b = gradients(e, w, b, entries[k], y[parts[k]], weight[parts[k]])
            e -= np.outer(r * step * by_gram, w)
            w -= np.float32(0.01) * r * d_w / max(1e-9, float(np.sqrt(d_w @ d_w)))
            b -= 0.02 * float(r) * d_b / len(parts[k])
        length = np.sqrt(np.einsum("ij,ij->i", e, e))
        e *= np.maximum(0, 1 - r * shorten / np.maximum(length, 1e-9))[:, None]
        loss = gradients(e, w, b, check, check_y, check_weight)[0]
        if loss < best:
            best = loss
            margin[used] = e @ w
    x = np.bincount(check[2], check[1] * margin[used][check[0]], len(check_y))
    prior = np.where(check_y == 1, share / max(1, check_y.sum()), (1 - share) / max(1, (1 - check_y).sum()))
    return Model(margin, *_platt(x, check_y, prior * len(check_y)))


def labelled(docs: DataFrame, labels: DataFrame, label: str, learn, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> tuple[DataFrame, float]:
    """(id, text, label) of at most `most` rows of each class, first by a hash of the id; the share of class 1.

    `learn` is the condition on the id under which a label may be used. Labels that are null or without a
    text are left out.
    """
    usable = labels.where(F.col(label).isin(0, 1) & learn(F.col(id_col))).select(id_col, label).distinct()
    n, ones = usable.agg(F.count("*"), F.sum(label)).first()
    parts = [usable.where(F.col(label) == k).orderBy(F.xxhash64(id_col), id_col).limit(most) for k in (0, 1)]
    few = F.broadcast(parts[0].union(parts[1]))  # at most 2 * most ids
    return docs.select(id_col, text_col).join(few, id_col), (ones or 0) / n if n else 0.5


def train(docs: DataFrame, labels: DataFrame, learn, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most: int = MOST_LABELLED) -> Model:
    """Fit a Model on labelled rows; see labelled() for which. They are brought to the driver: 2 * most texts."""
    rows, share = labelled(docs, labels, label, learn, id_col, text_col, most)
    got = sorted(rows.collect(), key=lambda r: (r[id_col], r[text_col] or ""))
    return fit([folded(r[text_col]) for r in got], [r[label] for r in got], share)


def score(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs' other columns with score, the probability of the toxic class; null and empty texts are scored too."""
    spark = prepare(docs.sparkSession)
    shared = spark.sparkContext.broadcast(model)  # 2^BITS numbers
    return map_texts(docs, text_col, "score double", lambda: lambda texts: [shared.value.score([folded(t) for t in texts])])
