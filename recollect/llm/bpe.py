"""BPE encoding and decoding for word-level vocabularies, in batched numpy merge rounds.

The symbols of many distinct words stand in one flat array. A round finds, by binary search over the sorted
pair keys, the rank of every adjacent pair, takes each word's lowest, merges that pair wherever it stands in
the word from the left, and drops the words in which nothing is left to merge.

A long word would need a round over all its symbols for nearly each merge. Words above LONG bytes therefore share
rounds of another kind: a round takes the lowest rank of all of them, merges at the places known for it, and looks
up the pairs beside those places alone, so that it costs what it merges.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import prepare

# Fixed values of the vocabulary file's format: its split pattern, and white space as that pattern knows it.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_SEPARATORS = re.compile("[\x1c-\x1f]")  # white space for str.split(), not for the pattern
#: Most distinct chunks of text, and most words, whose ids a task remembers.
REMEMBER = 200_000
#: Bytes above which a word is merged by the places of each rank; the ids are the same on either side.
LONG = 256


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(others)) for b in range(256)]


class Vocabulary:
    """Merge tables of a vocabulary file (JSON), small enough to broadcast: its size is the file's."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = dict(model["vocab"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.size = max([*vocab.values(), *self.special.values()]) + 1
        self.tokens = [""] * self.size
        self.numbers = list(range(self.size))  # one object for each id, however often it is remembered
        for token, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = token
        suffix = model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], np.int64)
        self.last = np.array([vocab[s + suffix] for s in symbols], np.int64)
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], np.int64)[order]


class Encoder:
    """Encodes whole texts with a Vocabulary; remembers the chunks between white space it has seen."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.v = vocabulary
        self.split = regex.compile(SPLIT + "|\n")  # chunks have no white space: a line each
        self.specials = re.compile("(" + "|".join(map(re.escape, vocabulary.special)) + ")") if vocabulary.special else None
        self.seen: dict[str, tuple[int, ...]] = {}
        self.words: dict[str, tuple[int, ...]] = {}

    def merge(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word (none empty): the words up to LONG bytes together, and the longer ones together."""
        out: list[tuple[int, ...]] = [()] * len(words)
        for part, merged in (([k for k, w in enumerate(words) if len(w) <= LONG], self.merge_short), ([k for k, w in enumerate(words) if len(w) > LONG], self.merge_long)):
            for k, ids in zip(part, merged([words[k] for k in part]), strict=True):
                out[k] = ids
        return out

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The place of each pair in the sorted keys, or -1."""
        key = left * self.v.size + right
        at = np.minimum(np.searchsorted(self.v.keys, key), len(self.v.keys) - 1)
        return np.where(self.v.keys[at] == key, at, -1)

    def merge_long(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word, by rounds that touch only the symbols that stand beside a merge.

        Words don't meet, so the lowest rank of all of them is the lowest of each word that has it. Symbols are
        linked to the next and the one before; a place stands for the pair that begins there.
        """
        if not words:
            return []
        v = self.v
        data = np.frombuffer(b"".join(words), np.uint8)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ids = v.inner[data]
        ids[ends - 1] = v.last[data[ends - 1]]
        n = len(ids)
        following, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        following[ends - 1] = n  # n and -1: none
        before[ends[:-1]] = -1
        pair = np.full(n, -1)  # the place in the keys of the pair that begins here
        waiting: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def note(places: np.ndarray) -> None:
            """Look up the pairs that begin at `places` and queue them by rank."""
            at = np.full(len(places), -1)
            inside = following[places] < n
            at[inside] = self.look_up(ids[places[inside]], ids[following[places[inside]]])
            pair[places] = at
            places, at = places[at >= 0], at[at >= 0]
            rank = v.ranks[at]
            order = np.argsort(rank, kind="stable")
            places, rank = places[order], rank[order]
            cut = np.flatnonzero(np.diff(rank)) + 1
            for r, part in zip(rank[np.concatenate(([0], cut))].tolist() if len(rank) else [], np.split(places, cut), strict=False):
                if r not in waiting:
                    heapq.heappush(queue, r)
                    waiting[r] = []
                waiting[r].append(part)

        note(np.arange(n))
        while queue:
            r = heapq.heappop(queue)
            places = np.unique(np.concatenate(waiting.pop(r)))
            places = places[pair[places] >= 0]
            places = places[v.ranks[pair[places]] == r]  # the others have changed since
            if not len(places):
                continue
            # of pairs that overlap, aaa, every other one from the left
            chained = np.concatenate(([False], following[places[:-1]] == places[1:]))
            at = np.arange(len(places))
            first = places[(at - np.maximum.accumulate(np.where(chained, -1, at))) % 2 == 0]
            second = following[first]
            ids[first] = v.merged[pair[first]]
            pair[second] = -1
            ids[second] = -1
            after = following[second]
            following[first] = after
            before[after[after < n]] = first[after < n]
            previous = before[first]
            note(np.unique(np.concatenate((first, previous[previous >= 0]))))
        return [tuple(map(v.numbers.__getitem__, part[part >= 0].tolist())) for part in np.split(ids, ends[:-1])]

    def merge_short(self, words: Sequence[bytes]) -> list[tuple[int, ...]]:
        """The ids of each word, by rounds over the symbols of all words."""
        if not words:
            return []
        v, out = self.v, [()] * len(words)
        data = np.frombuffer(b"".join(words), np.uint8)
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        ids = v.inner[data]
        ends = np.cumsum(lengths)
        ids[ends - 1] = v.last[data[ends - 1]]
        names = np.arange(len(words))
        never = np.int64(len(v.keys))
        while len(names):
            starts = np.cumsum(lengths) - lengths
            owner = np.repeat(np.arange(len(names)), lengths)
            at, rank = np.full(len(ids), -1), np.full(len(ids), never)
            inside = np.flatnonzero(owner[:-1] == owner[1:])
            at[inside] = self.look_up(ids[inside], ids[inside + 1])
            good = np.flatnonzero(at >= 0)
            rank[good] = v.ranks[at[good]]
            best = np.minimum.reduceat(rank, starts)
            done = best == never
            if done.any():
                for k in np.flatnonzero(done).tolist():
                    out[names[k]] = tuple(map(v.numbers.__getitem__, ids[starts[k] : starts[k] + lengths[k]].tolist()))
                stay = ~done[owner]
                ids, at, rank = ids[stay], at[stay], rank[stay]
                names, lengths, best = names[~done], lengths[~done], best[~done]
                if not len(names):
                    break
                owner = np.repeat(np.arange(len(names)), lengths)
            chosen = rank == best[owner]
            place = np.arange(len(ids))
            run = place - np.maximum.accumulate(np.where(chosen, -1, place))
            chosen &= run % 2 == 1  # of pairs that overlap, aaa, every other one from the left
            first = np.flatnonzero(chosen)
            ids[first] = v.merged[at[first]]
            lengths = lengths - np.bincount(owner[first], minlength=len(names))
            keep = np.ones(len(ids), bool)
            keep[first + 1] = False
            ids = ids[keep]
        return out

    def learn(self, chunks: set[str]) -> None:
        """Put the ids of all chunks (text without white space) into `seen`."""
        new = list(chunks - self.seen.keys())
        if len(self.seen) + len(new) > REMEMBER:
            self.seen = {c: self.seen[c] for c in chunks if c in self.seen}
        if len(self.words) > REMEMBER:
            self.words.clear()
        plans: dict[str, list[int | list[str]]] = {}
        if self.specials and self.specials.search("\n".join(new)):
            for chunk in filter(self.specials.search, new):
                plans[chunk] = [self.v.special[p] if p in self.v.special else self.split.findall(self.folded(p)) for p in self.specials.split(chunk)]
            new = [c for c in new if c not in plans]
        found = self.split.findall(self.folded("\n".join(new)))
        words = list({*found, *(w for plan in plans.values() for p in plan if isinstance(p, list) for w in p)} - self.words.keys() - {"\n"})
        self.words.update(zip(words, self.merge([w.encode("utf-8") for w in words]), strict=True))
        at, ids = 0, ()
        for w in found:
            if w == "\n":
                self.seen[new[at]] = ids
                at, ids = at + 1, ()
            else:
                ids = ids + self.words[w] if ids else self.words[w]
        if new:
            self.seen[new[at]] = ids
        for chunk, plan in plans.items():
            self.seen[chunk] = tuple(i for p in plan for i in ([p] if isinstance(p, int) else (i for w in p for i in self.words[w])))

    @staticmethod
    def folded(text: str) -> str:
        """Each character is lower-cased alone, so a capital sigma never becomes a final one."""
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def encode(self, texts: Sequence[str | None], most: int = 1 << 20) -> Iterator[list[int]]:
        """The ids of each text; chunks are learnt for about `most` characters at a time."""
        group: list[list[str]] = []
        size = 0
        for k, text in enumerate(texts):
            text = text or ""
            group.append([c for c in SPACE.split(text) if c] if _SEPARATORS.search(text) else text.split())
            size += len(text)
            if size >= most or k == len(texts) - 1:
                self.learn({c for chunks in group for c in chunks})
                for chunks in group:
                    ids: list[int] = []
                    for c in chunks:
                        ids += self.seen[c]
                    yield ids
                group, size = [], 0


def decode(ids: Sequence[int], tokens: Sequence[str]) -> str:
    """The tokens of the ids joined by a space, as a vocabulary file without a decoder means it."""
    return " ".join([tokens[i] for i in ids])


def encode_decode(docs: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """docs' other columns with ids array<int> and decoded string, the text those ids stand for.

    `vocabulary` is the path of a vocabulary file, read on the driver and broadcast. Strings of special
    tokens in a text become those tokens. Null and empty texts have no ids and decode to ''. Rows are
    independent of each other; columns named ids or decoded are replaced.
    """
    spark = prepare(docs.sparkSession)
    tables = spark.sparkContext.broadcast(Vocabulary(vocabulary))
    keep = [c for c in docs.columns if c not in (text_col, "ids", "decoded")]
    slim = docs.select(*keep, text_col)
    schema = slim.select(*keep, F.expr("CAST(NULL AS ARRAY<INT>) AS ids"), F.lit("").alias("decoded")).schema

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tables.value)
        tokens = tables.value.tokens
        for frame in frames:
            for lo in range(0, frame.num_rows, 512):
                x = frame.slice(lo, 512)
                flat: list[int] = []
                ends, decoded = [0], []
                for ids in encoder.encode(x.column(len(keep)).to_pylist()):
                    flat += ids
                    ends.append(len(flat))
                    decoded.append(decode(ids, tokens))
                lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.array(flat, np.int32)))
                yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], lists, pa.array(decoded, pa.string())], names=[*keep, "ids", "decoded"])

    return slim.mapInArrow(batches, schema)
