"""Benchmark decontamination: a broadcast hash set of test n-grams against every window of the documents."""

from __future__ import annotations

import bisect
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import by_size, hashed_words, map_texts, prepare, runs, staged, window_hashes

#: A-Z become a-z, any other byte that is no ASCII letter, ASCII digit or part of a non-ASCII character a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))
IS_WORD = np.array([b != 32 for b in range(256)])
WINDOW = 10
#: Most windows of the benchmark that one pass broadcasts; more are taken in several passes.
MOST_WINDOWS = 500_000
#: Bytes of text that are scanned at once: a worker keeps 32 to 64 bytes of powers for each.
AT_ONCE = 1 << 18


def folded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").translate(FOLD)


def _item_windows(items: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """(item, n, window): the distinct windows of each item, folded and joined by a space; n is their number of words."""

    def rows(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = set()
            for item, text in zip(x["item"], x["text"], strict=True):
                words = folded(text).split()
                n = min(size, len(words))
                out.update((item, n, b" ".join(words[i : i + n])) for i in range(len(words) - n + 1 if n else 0))
            yield pd.DataFrame(list(out), columns=["item", "n", "window"])

    named = items.select(F.col(id_col).cast("string").alias("item"), F.col(text_col).alias("text"))
    return named.mapInPandas(rows, "item string, n int, window binary").distinct()


class _Windows:
    """The hash set of one pass: by number of words, a bit map over hashes and the windows by hash."""

    def __init__(self, rows: list) -> None:
        grouped: dict[bytes, list[str]] = {}
        for r in rows:
            grouped.setdefault(bytes(r["window"]), []).append(r["item"])
        self.items = grouped
        self.hashes: dict[int, np.ndarray] = {}
        self.maps: dict[int, np.ndarray] = {}
        for n in sorted({r["n"] for r in rows}):
            own = [w for w in grouped if w.count(b" ") == n - 1]
            h = np.array([window_hashes(hashed_words(w, IS_WORD)[2], n)[0] for w in own], np.uint64)
            self.hashes[n] = np.unique(h)
            bits = max(16, (8 * len(own)).bit_length())
            self.maps[n] = np.zeros(1 << bits, bool)
            self.maps[n][h >> np.uint64(64 - bits)] = True

    def hits(self, h: np.ndarray, n: int) -> np.ndarray:
        """Positions in h, hashes of windows of n words, that may be windows of the benchmark."""
        near = np.flatnonzero(self.maps[n][h >> np.uint64(64 - (len(self.maps[n]).bit_length() - 1))])
        at = np.searchsorted(self.hashes[n], h[near])
        at[at == len(self.hashes[n])] = 0
        return near[self.hashes[n][at] == h[near]]


_NEW = "n_words bigint, spans array<struct<start: bigint, end: bigint>>, items array<string>"


def _scanner(spark: SparkSession, rows: list) -> Callable[[list], list]:
    """From texts to n_words, spans (a run of hit words each) and items of the windows in rows."""
    found = spark.sparkContext.broadcast(_Windows(rows))

    def scan(texts: list) -> list:
        known: _Windows = found.value
        texts = [folded(t) for t in texts]
        words, spans, items = [0] * len(texts), [[] for _ in texts], [[] for _ in texts]
        for lo, hi in by_size(texts, AT_ONCE):
            data = b" ".join(texts[lo:hi])
            starts, ends, h = hashed_words(data, IS_WORD)
            firsts = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in texts[lo:hi]])).tolist()  # the word at which each text begins
            words[lo:hi] = np.diff(firsts).tolist()
            at: dict[int, list] = {}
            for n in known.maps:
                for p in known.hits(window_hashes(h, n), n).tolist():
                    k = bisect.bisect_right(firsts, p) - 1
                    window = b" ".join(data[s:e] for s, e in zip(starts[p : p + n].tolist(), ends[p : p + n].tolist(), strict=True))
                    if p + n <= firsts[k + 1] and window in known.items:
                        at.setdefault(k, []).append((p - firsts[k], n, window))
            for k, hits in at.items():
                mask = np.zeros(words[lo + k], bool)
                own: set[str] = set()
                for p, n, window in hits:
                    mask[p : p + n] = True
                    own.update(known.items[window])
                spans[lo + k] = [{"start": s, "end": e} for s, e in runs(mask)]
                items[lo + k] = sorted(own)
        return [words, spans, items]

    return scan


def _scan(docs: DataFrame, rows: list, text_col: str) -> DataFrame:
    scan = _scanner(docs.sparkSession, rows)
    return map_texts(docs, text_col, _NEW, lambda: scan)


def _dealt(benchmark: DataFrame, item_col: str, item_text: str, size: int, most: int) -> tuple[DataFrame, int]:
    """The windows, written once, with the number of the pass that takes them, and the number of passes."""
    windows = staged(_item_windows(benchmark, item_col, item_text, size), "windows")
    passes = max(1, -(-windows.count() // most))
    return windows.select("item", "n", "window", F.pmod(F.xxhash64("window"), F.lit(passes)).alias("pass")), passes


def _of_pass(dealt: DataFrame, k: int) -> list:
    return dealt.where(F.col("pass") == k).select("item", "n", "window").collect()  # about `most` rows


def find(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """docs without the text, and n_words, spans (runs of hit words, [start, end) in words) and items.

    A word is hit if it lies inside an occurrence of a window of `size` consecutive words of an item; an item
    of fewer words, but not none, is one window. items are the ids, as sorted strings, of all items with
    occurring windows. Null and empty texts have no words and no hits; items without words, or of null id,
    match nothing or go unnamed. Repeated rows are judged alike. Columns of the
    new names are replaced.

    The benchmark's size is counted first. Each pass broadcasts at most about `most` (window, item) rows, dealt
    by hash. Where there are several, each writes its rows in the shared folder and the next reads them, so that
    one pass's hash set is in memory at a time; nothing is shuffled.
    """
    prepare(docs.sparkSession)
    dealt, passes = _dealt(benchmark, item_col, item_text, size, most)
    taken = {text_col, "n_words", "spans", "items"}
    names = [c for c in docs.columns if c not in taken]
    base = docs.select(*(F.col(c).alias(f"_{i}") for i, c in enumerate(names)), F.col(text_col).alias("t"), F.col(text_col).alias("u"))
    out = None
    for k in range(passes):
        rows = _of_pass(dealt, k)
        if out is None:
            out = _scan(base.drop("u") if passes == 1 else base, rows, "t")
            continue
        out = staged(out, "pass")
        again = _scan(out.select(*out.columns, F.col("spans").alias("s"), F.col("items").alias("i"), F.col("u").alias("t")), rows, "t")
        out = again.withColumn("spans", F.concat("s", "spans")).withColumn("items", F.array_sort(F.array_distinct(F.concat("i", "items")))).drop("s", "i")
    if passes > 1:
        joined = F.expr(
            """aggregate(array_sort(spans), CAST(array() AS ARRAY<STRUCT<start: BIGINT, end: BIGINT>>), (a, x) ->
               CASE WHEN size(a) > 0 AND element_at(a, -1).end >= x.start
               THEN concat(slice(a, 1, size(a) - 1), array(named_struct('start', element_at(a, -1).start, 'end', greatest(element_at(a, -1).end, x.end))))
               ELSE concat(a, array(x)) END)"""
        )
        out = out.withColumn("spans", joined)
    return out.select(*(F.col(f"_{i}").alias(c) for i, c in enumerate(names)), "n_words", "spans", "items")


def remove(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", size: int = WINDOW, most: int = MOST_WINDOWS) -> DataFrame:
    """docs with the hit words, and what stands between two hit words of a run, replaced by a line end.

    The columns are those of docs, n_chars with the new length where there is one. A text without hits stays
    as it is; a null text stays null. Hits are as in find().
    """
    spark = prepare(docs.sparkSession)
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    text = f"c{names.index(text_col)}"
    dealt, passes = _dealt(benchmark, item_col, item_text, size, most)
    if passes == 1:
        scan = _scanner(spark, _of_pass(dealt, 0))
        out = map_texts(docs.toDF(*plain), text, f"{text} string", lambda: lambda texts: [[cut(t, s) for t, s in zip(texts, scan(texts)[1], strict=True)]])
    else:
        found = find(docs.toDF(*plain).withColumn("whole", F.col(text)), benchmark, text, item_col, item_text, size, most)
        slim = found.select(*(c for c in plain if c != text), F.struct("whole", "spans").alias("cut"))
        out = map_texts(slim, "cut", f"{text} string", lambda: lambda rows: [[cut(r["whole"], r["spans"]) for r in rows]])
    if "n_chars" in names:
        out = out.withColumn(f"c{names.index('n_chars')}", F.length(text).cast("bigint"))
    return out.select(*plain).toDF(*names)


def cut(text: str | None, spans) -> str | None:
    """text without the words of the spans."""
    if text is None or not len(spans):
        return text
    data = text.encode("utf-8", "surrogatepass")
    starts, ends, _ = hashed_words(data.translate(FOLD), IS_WORD)
    out, at = [], 0
    for s in spans:
        out += [data[at : starts[s["start"]]], b"\n"]
        at = ends[s["end"] - 1]
    return b"".join([*out, data[at:]]).decode("utf-8", "surrogatepass")
