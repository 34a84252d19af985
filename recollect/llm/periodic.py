"""Periodic run detection: the maximal stretches of words that repeat with a smallest period (Gusfield and Stoye).

A run of period q and of `least` words or more holds words q apart for at least `least // 2` words, so each of its
words lies in a window of that many words that occurs again in its stretch. Windows by hash narrow a text to
such stretches; equal hashes of different windows only widen them. On the stretches' own words the method is exact:

1. Ranks of all windows of 2^k words, and from them the suffix order, common prefixes and suffixes of two places.
2. Lempel-Ziv blocks. Each tandem repeat whose first occurrence ends in a block touches the block's border, and two
   common extensions a length there find one occurrence that covers the first of each.
3. Places in the suffix tree are intervals of the suffix order. From each repeat found a suffix link and a step by
   the repeat's own first word lead to its rotation, at the same occurrence as long as that goes on and then at
   any other below the node, until all rotations are marked. Roots that are powers have a shorter period and go.
4. The leaves below the marked nodes are all occurrences; those at consecutive places with one period are a run.

A text is worked on in one task: some hundred bytes of memory a word of a stretch. No words, a null or an empty text:
no runs. Rows of equal ids or texts are taken each by itself.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from recollect.llm import common

SPACES = b" \t\n\x0b\x0c\r"
_IS_WORD = np.ones(256, bool)
_IS_WORD[list(SPACES)] = False
#: Words of stretches that share one suffix order.
TOGETHER = 1 << 17


class Suffixes:
    """Ranks of the windows of 2^k symbols of a sequence whose last symbol stands nowhere else."""

    def __init__(self, symbols: np.ndarray) -> None:
        self.n = n = len(symbols)
        rank = np.unique(symbols, return_inverse=True)[1]
        self.levels = [self._padded(rank)]
        while n and rank.max() + 1 < n:
            step = 1 << (len(self.levels) - 1)
            second = np.zeros(n, np.int64)
            second[: max(0, n - step)] = rank[step:] + 1
            rank = np.unique(rank.astype(np.int64) * (n + 1) + second, return_inverse=True)[1]
            self.levels.append(self._padded(rank))
        self.rank = rank
        self.order = np.empty(n, np.int64)
        self.order[rank] = np.arange(n)
        lcp = np.zeros(n, np.int32)
        lcp[1:] = self.ahead(self.order[:-1], self.order[1:])
        self.least = [lcp]  # least[k][r]: smallest common prefix within lcp[r : r + 2^k]
        while 2 << (len(self.least) - 1) <= n:
            half = 1 << (len(self.least) - 1)
            self.least.append(np.minimum(self.least[-1][:-half], self.least[-1][half:]))

    @staticmethod
    def _padded(rank: np.ndarray) -> np.ndarray:
        return np.append(rank, -1).astype(np.int32)

    def ahead(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols from two different places on are equal."""
        a, b = a.copy(), b.copy()
        began = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            same = self.levels[k][a] == self.levels[k][b]
            a[same] += 1 << k
            b[same] += 1 << k
        return a - began

    def behind(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols before two different places are equal."""
        a, b = a.copy(), b.copy()
        began = a.copy()
        for k in range(len(self.levels) - 1, -1, -1):
            size = 1 << k
            fits = (a >= size) & (b >= size)
            same = fits & (self.levels[k][np.where(fits, a - size, 0)] == self.levels[k][np.where(fits, b - size, 0)])
            a[same] -= size
            b[same] -= size
        return began - a

    def node(self, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last rank of the suffixes that share the `size` symbols from `at` on."""
        low, high = self.rank[at].copy(), self.rank[at].copy()
        for k in range(len(self.least) - 1, -1, -1):
            table, step = self.least[k], 1 << k
            fits = low >= step  # lcp[low - step + 1 : low + 1]
            go = fits & (table[np.where(fits, low - step + 1, 0)] >= size)
            low[go] -= step
            fits = high + step < self.n
            go = fits & (table[np.where(fits, high + 1, 0)] >= size)
            high[go] += step
        return low, high

    def child(self, low: np.ndarray, high: np.ndarray, size: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """A suffix below each node that goes on with the symbol (by rank), and whether there is one."""
        first, low, last = self.levels[0], low.copy(), high
        high = high + 1
        while (open_ := low < high).any():
            mid = (low + high) // 2
            less = first[np.minimum(self.order[np.minimum(mid, self.n - 1)] + size, self.n)] < symbol
            low = np.where(open_ & less, mid + 1, low)
            high = np.where(open_ & ~less, mid, high)
        at = self.order[np.minimum(low, self.n - 1)]
        return at, (low <= last) & (first[np.minimum(at + size, self.n)] == symbol)


def blocks(text: Suffixes) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each the longest stretch that also starts earlier, or one new symbol."""
    before, after, stack = [-1] * text.n, [-1] * text.n, []
    for i in text.order.tolist():
        while stack and stack[-1] > i:
            after[stack.pop()] = i
        if stack:
            before[i] = stack[-1]
        stack.append(i)
    here, longest = np.arange(text.n), np.zeros(text.n, np.int64)
    for other in (np.array(before), np.array(after)):
        known = other >= 0
        longest[known] = np.maximum(longest[known], text.ahead(here[known], other[known]))
    out, i, steps = [], 0, np.maximum(longest, 1).tolist()
    while i < text.n:
        out.append(i)
        i += steps[i]
    return np.array(out, np.int64)


def _counted(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of the sizes 0, 1 .. size - 1, with the number of the size."""
    owner = np.repeat(np.arange(len(sizes)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def covering(text: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """(place, half) of tandem repeats, among them one that reaches the first occurrence of each by rotations."""
    start = blocks(text)
    size = np.diff(np.append(start, text.n))
    found = []
    owner, k = _counted(size)  # the centre lies in the block and the right half ends in a later one
    k, border = k + 1, start[owner] + size[owner]
    ok = border < text.n
    found.append((border[ok] - k[ok], border[ok], k[ok], np.full(ok.sum(), text.n), np.full(ok.sum(), False)))
    owner, k = _counted(size + np.append(size[1:], 0))  # begins before the block, centre in it
    k, border = k + 1, start[owner]
    ok = border + k < text.n
    found.append((border[ok], border[ok] + k[ok], k[ok], (border + size[owner])[ok], np.full(ok.sum(), True)))
    left, right, half, end, before = (np.concatenate(x) for x in zip(*found, strict=True))
    keep = text.levels[0][left] == text.levels[0][right]
    left, right, half, end, before = left[keep], right[keep], half[keep], end[keep], before[keep]
    ahead, behind = text.ahead(left, right), text.behind(left, right)
    at = np.maximum(left - behind, left - half + 1)
    keep = (ahead + behind >= half) & (~before | (behind > 0) & (at + half <= end))
    return at[keep], half[keep]


def primitive(text: Suffixes, at: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Whether the root of each tandem repeat is no power of a shorter one."""
    out = np.ones(len(at), bool)
    most = int(half.max(initial=1))
    factor = np.arange(most + 1)  # some prime factor of each number
    for p in range(2, int(most**0.5) + 1):
        if factor[p] == p:
            factor[p * p :: p] = p
    left = half.copy()
    while (more := np.flatnonzero(left > 1)).size:
        part = half[more] // factor[left[more]]
        out[more] &= text.ahead(at[more], at[more] + part) < 2 * half[more] - part
        left[more] //= factor[left[more]]
    return out


def vocabulary(text: Suffixes, at: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(half, first rank, last rank) of the node of each different tandem repeat, from a covering set."""
    marked = np.empty(0, np.int64)
    parts = []
    while len(at):
        last = at + text.ahead(at, at + half) - half  # the rotations that stand at this occurrence
        first = np.lexsort((at, last, half))
        one = np.concatenate(([True], (np.diff(half[first]) != 0) | (np.diff(last[first]) != 0)))
        at, half, last = at[first][one], half[first][one], last[first][one]
        whole = last - at >= half - 1
        owner, step = _counted(np.minimum(last - at + 1, half))
        place, size = at[owner] + step, half[owner]
        low, high = text.node(place, 2 * size)
        key, kept = np.unique(low * (text.n + 1) + size, return_index=True)
        new = ~np.isin(key, marked, assume_unique=True)
        parts.append((size[kept[new]], low[kept[new]], high[kept[new]]))
        marked = np.concatenate((marked, key[new]))
        # the occurrence does not go on, but another below its node may
        at, half, last = at[~whole], half[~whole], last[~whole]
        low, high = text.node(last, 2 * half)
        other, there = text.child(low, high, 2 * half, text.levels[0][last])
        at, half = other[there] + 1, half[there]
        low, _ = text.node(at, 2 * half)
        fresh = ~np.isin(low * (text.n + 1) + half, marked)
        at, half = at[fresh], half[fresh]
    if not parts:
        return (np.empty(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def runs_of(symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, length, period) of all maximal runs of two periods or more; the last symbol stands nowhere else."""
    text = Suffixes(symbols)
    at, half = covering(text)
    root = primitive(text, at, half)
    half, low, high = vocabulary(text, at[root], half[root])
    owner, step = _counted(high - low + 1)
    half, place = half[owner], text.order[low[owner] + step]
    sort = np.lexsort((place, half))
    half, place = half[sort], place[sort]
    new = np.flatnonzero(np.concatenate(([True], (np.diff(half) != 0) | (np.diff(place) != 1))[: len(half)]))
    final = np.append(new[1:], len(half)) - 1 if len(new) else new
    return place[new], place[final] - place[new] + 2 * half[new], half[new]


def _stretches(hashes: np.ndarray, piece: np.ndarray, size: int) -> list[tuple[int, int]]:
    """[start, end) of words covered by windows of `size` words that occur twice in their piece, then stretch."""
    window = common.window_hashes(hashes, size)
    base = np.arange(len(window))
    base = base[piece[base] == piece[base + size - 1]] if len(base) else base
    while True:
        key = window[base] ^ (piece[base].astype(np.uint64) + np.uint64(1)) * common.MULTIPLIER
        order = np.argsort(key, kind="stable")
        same = key[order][1:] == key[order][:-1]
        twice = np.zeros(len(base), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        step = np.zeros(len(hashes) + 1, np.int64)
        np.add.at(step, base[twice], 1)
        np.add.at(step, base[twice] + size, -1)
        covered = np.cumsum(step[:-1]) > 0
        starts = covered.copy()
        starts[1:] &= ~covered[:-1] | (piece[1:] != piece[:-1])
        if twice.all():
            edges = np.flatnonzero(starts)
            ends = np.flatnonzero(covered & np.append(~covered[1:] | (piece[1:] != piece[:-1]), True)[: len(covered)]) + 1
            return list(zip(edges.tolist(), ends.tolist(), strict=True))
        base, piece = base[twice], np.cumsum(starts)


def find(texts: list[bytes], least: int = 12) -> list[list[tuple[int, int, int]]]:
    """For each text its runs (start, length, period) of `least` words or more, by start, then period."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    found: list[tuple[int, int, int, list[bytes]]] = []  # text, first word, words
    for lo, hi in common.by_size(texts):
        starts, _, hashes = common.hashed_words(b"\n".join(texts[lo:hi]), _IS_WORD)
        offsets = np.cumsum([0, *(len(t) + 1 for t in texts[lo:hi])])
        piece = np.searchsorted(offsets, starts, "right") - 1
        first = np.searchsorted(starts, offsets[:-1])
        words: dict[int, list[bytes]] = {}
        for a, b in _stretches(hashes, piece, max(1, least // 2)):
            k = int(piece[a])
            if k not in words:
                words[k] = texts[lo + k].split()
            at = int(a - first[k])
            found.append((lo + k, at, b - a, words[k][at : at + b - a]))
    for lo, hi in _together([f[2] for f in found]):
        known: dict[bytes, int] = {}
        symbols: list[int] = []
        places = []
        for k, (_, _, n, stretch) in enumerate(found[lo:hi]):
            places.append(len(symbols))
            symbols += [known.setdefault(w, len(known)) for w in stretch]
            symbols.append(-1 - k)  # no match goes beyond a stretch
        start, length, period = runs_of(np.array(symbols, np.int64))
        owner = np.searchsorted(places, start, "right") - 1
        for s, n, p, k in zip(start.tolist(), length.tolist(), period.tolist(), owner.tolist(), strict=True):
            if n >= least:
                text, at, _, _ = found[lo + k]
                out[text].append((s - places[k] + at, n, p))
    for x in out:
        x.sort(key=lambda r: (r[0], r[2]))
    return out


def _together(sizes: list[int]) -> list[tuple[int, int]]:
    out, start, total = [], 0, 0
    for i, n in enumerate(sizes):
        if total and total + n > TOGETHER:
            out.append((start, i))
            start, total = i, 0
        total += n + 1
    if start < len(sizes):
        out.append((start, len(sizes)))
    return out


def collapsed(words: list[bytes], found: list[tuple[int, int, int]]) -> list[bytes]:
    """The words without what any run repeats after its first period."""
    step = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        step[start + period] += 1
        step[start + length] -= 1
    keep = np.cumsum(step[:-1]) == 0
    return [w for w, k in zip(words, keep.tolist(), strict=True) if k]


def find_runs(docs: DataFrame, text_col: str = "text", least: int = 12) -> DataFrame:
    """docs without the text, with n_words, runs (start, length, period; by start, then period) and collapsed.

    `collapsed` is the words, joined by one space, without what a run repeats. Words are divided by ASCII white space.
    A run has `least` words at least, 2 or more, and two periods at least; columns of the new names are replaced.
    """
    common.prepare(docs.sparkSession)
    if least < 2:
        raise ValueError("a run has two words at least")

    def make():
        def work(texts: list) -> list[list]:
            data = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
            sizes, rows, kept = [], [], []
            for text, found in zip(data, find(data, least), strict=True):
                words = text.split()
                sizes.append(len(words))
                rows.append([{"start": s, "length": n, "period": p} for s, n, p in found])
                kept.append(b" ".join(collapsed(words, found) if found else words).decode("utf-8", "surrogatepass"))
            return [sizes, rows, kept]

        return work

    return common.map_texts(docs, text_col, "n_words bigint, runs array<struct<start: bigint, length: bigint, period: bigint>>, collapsed string", make)
