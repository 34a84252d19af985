"""Substring dedup through fixed-block anchors.

Documents are dealt into chunks. Blocks of 10 consecutive words that do not overlap are the reference index;
any run of 20 words holds a whole block. Every rolling window of 10 words probes the index by its hash. Hits
are extended to the windows of 20 words around them, which are compared by a 96-bit digest of their words,
and the windows that repeat run together to maximal exact repeats.

A chunk sends each hash once, however often it occurs there, so a hot passage costs one entry a chunk and no
pair of documents is ever formed. The answers return to the chunk, which finds its own later copies itself.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import by_size, hashed_words, parallelism, prepare, runs, window_hashes, word_offsets

WORDS = 20
BLOCK = 10
IS_WORD = np.array([not (b == 32 or 9 <= b <= 13) for b in range(256)])
DIGEST = 12
#: Bytes of text in a chunk, on average. Chunks times buckets are the rows that carry the index, each a packed array.
CHUNK_BYTES = 8 << 20
NULL_ID = -(1 << 63)
_LOW = np.uint64(0xFFFFFFFF)


class _Chunk:
    """The texts of one chunk: for each the number of words and the hashes of its rolling windows."""

    def __init__(self, frame: pd.DataFrame, block: int, parts: int) -> None:
        ids = frame["id"].to_numpy(np.int64)
        order = np.argsort(ids, kind="stable")
        self.ids = ids[order]
        self.texts = [(t or "").encode("utf-8", "surrogatepass") for t in frame["text"].to_numpy()[order]]
        self.n_words = np.zeros(len(order), np.int64)
        each: list[np.ndarray] = []
        for lo, hi in by_size(self.texts):
            data = b" ".join(self.texts[lo:hi])
            starts, _, h = hashed_words(data, IS_WORD)
            first = np.searchsorted(starts, np.cumsum([0] + [len(t) + 1 for t in self.texts[lo:hi]]))
            self.n_words[lo:hi] = np.diff(first)
            each += [window_hashes(h[a:b], block) for a, b in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        self.counts = np.array([len(x) for x in each], np.int64)
        self.first = np.cumsum(self.counts) - self.counts
        h = np.concatenate(each) if each else np.empty(0, np.uint64)
        #: Bucket and the value within the bucket; the bits between them are dropped.
        self.keys = ((h >> np.uint64(32)) % np.uint64(parts)) << np.uint64(32) | (h & _LOW)
        self.position = np.arange(len(h)) - np.repeat(self.first, self.counts)

    def windows(self, hot: np.ndarray, size: int, block: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row, start and digest of each window that holds a hit, in the order of ids and starts."""
        is_hot = np.isin(self.keys, hot) if len(hot) else np.zeros(len(self.keys), bool)
        rows, starts_at, digests = [np.empty(0, np.int64)], [np.empty(0, np.int64)], []
        digest = xxhash.xxh3_128_digest
        for row in np.unique(np.searchsorted(self.first, np.flatnonzero(is_hot), "right") - 1).tolist():
            while self.counts[row] == 0:  # rows without windows share their offset with the next
                row -= 1
            n = int(self.n_words[row]) - size + 1
            if n <= 0:
                continue
            hits = np.flatnonzero(is_hot[self.first[row] : self.first[row] + self.counts[row]])
            steps = np.zeros(n + 1, np.int32)
            np.add.at(steps, np.clip(hits - (size - block), 0, n), 1)
            np.add.at(steps, np.clip(hits + 1, 0, n), -1)
            at = np.flatnonzero(np.cumsum(steps[:n]) > 0)
            words = self.texts[row].split()
            joined = b" ".join(words)
            starts, ends = word_offsets(words)
            digests.append(b"".join([digest(joined[s:e])[:DIGEST] for s, e in zip(starts[at].tolist(), ends[at + size - 1].tolist(), strict=True)]))
            rows.append(np.full(len(at), row))
            starts_at.append(at)
        return np.concatenate(rows), np.concatenate(starts_at), _joined(digests, f"V{DIGEST}")


def _ordered(digests: np.ndarray, *then: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order by digest and then by `then`, and for each place in it that of the first of the same digest."""
    parts = np.ascontiguousarray(digests).view("<u4").reshape(-1, 3)
    order = np.lexsort((*then[::-1], parts[:, 0], parts[:, 1], parts[:, 2]))
    same = (parts[order][1:] == parts[order][:-1]).all(axis=1)
    first = np.concatenate(([True], ~same)) if len(order) else np.empty(0, bool)
    return order, np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))


def _joined(blobs, dtype: str) -> np.ndarray:
    return np.frombuffer(b"".join(blobs), dtype)


def find_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, chunks: int | None = None) -> DataFrame:
    """(id_col bigint, n_words, removed, kept_text) for every row of docs.

    Words are runs of anything but ASCII white space. A word is removed if a window of `size` consecutive
    words covers it whose word sequence also starts earlier: in a document of smaller id, or before in the
    same one. `removed` are the maximal runs of such words, [start, end) in words; kept_text the other words
    joined by one space. Null and empty texts have no words. A null id comes before all others; the
    least bigint stands for it; repeated rows of one id are one document, and so each stays as it is unless it repeats something earlier.
    Windows are judged on the input. Other columns are not read.

    There are `chunks` chunks, by default as many as shuffle partitions or more, so that each has about
    CHUNK_BYTES of text. A task holds one chunk and its hashes, about ten times the chunk's text.
    """
    spark = prepare(docs.sparkSession)
    block = size // 2  # any `size` words hold a whole aligned block of half as many
    parts = chunks or max(parallelism(spark), -(-(docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0) // CHUNK_BYTES))
    named = docs.select(F.coalesce(F.col(id_col).cast("bigint"), F.lit(NULL_ID)).alias("id"), F.col(text_col).alias("text"), F.pmod(F.xxhash64(id_col), F.lit(parts)).cast("int").alias("chunk"))
    dealt = named.repartition(parts, "chunk").groupBy("chunk")

    def index(x: pd.DataFrame) -> pd.DataFrame:
        c = _Chunk(x, block, parts)
        keys, back, counts = np.unique(c.keys, return_inverse=True, return_counts=True)
        has_block = np.zeros(len(keys), bool)
        has_block[back[c.position % block == 0]] = True
        bucket = (keys >> np.uint64(32)).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        rows = []
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)], strict=True) if len(keys) else []:
            rows.append((int(bucket[lo]), int(x["chunk"].iloc[0]), (keys[lo:hi] & _LOW).astype("<u4").tobytes(), np.packbits(has_block[lo:hi]).tobytes(), np.packbits(counts[lo:hi] > 1).tobytes()))
        return pd.DataFrame(rows, columns=["bucket", "chunk", "keys", "blocks", "several"])

    def probe(x: pd.DataFrame) -> pd.DataFrame:
        sizes = [len(k) // 4 for k in x["keys"]]
        keys = _joined(x["keys"], "<u4")
        blocks, several = (np.concatenate([np.unpackbits(np.frombuffer(f, np.uint8), count=n) for f, n in zip(x[c], sizes, strict=True)]) for c in ("blocks", "several"))
        order = np.argsort(keys, kind="stable")
        heads = np.concatenate(([True], np.diff(keys[order]) != 0))
        group = np.cumsum(heads) - 1
        times = np.bincount(group) + np.bincount(group, several[order])
        hot = np.empty(len(keys), bool)
        hot[order] = ((times > 1) & (np.bincount(group, blocks[order]) > 0))[group]
        bucket = int(x["bucket"].iloc[0])
        rows, at = [], 0
        for chunk, n in zip(x["chunk"], sizes, strict=True):
            own = keys[at : at + n][hot[at : at + n]]
            at += n
            if len(own):
                rows.append((chunk, 0, (own.astype(np.uint64) | np.uint64(bucket << 32)).astype("<u8").tobytes()))
        return pd.DataFrame(rows, columns=["chunk", "kind", "data"])

    def extend(texts: pd.DataFrame, hot: pd.DataFrame) -> pd.DataFrame:
        columns = ["bucket", "chunk", "digests", "ids", "at"]
        if not len(texts) or not len(hot):
            return pd.DataFrame([], columns=columns)
        c = _Chunk(texts, block, parts)
        row, at, digests = c.windows(_joined(hot["data"], "<u8"), size, block)
        order, lead = _ordered(digests, c.ids[row], at)
        earliest = order[lead == np.arange(len(order))]
        bucket = (digests[earliest].view("<u4").reshape(-1, 3)[:, 0] % parts).astype(np.int64)
        by_bucket = np.argsort(bucket, kind="stable")
        earliest, bucket = earliest[by_bucket], bucket[by_bucket]
        chunk, cuts = int(texts["chunk"].iloc[0]), np.flatnonzero(np.diff(bucket)) + 1
        spans = zip([0, *cuts.tolist()], [*cuts.tolist(), len(earliest)], strict=True) if len(earliest) else []
        return pd.DataFrame([(int(bucket[lo]), chunk, digests[e].tobytes(), c.ids[row[e]].astype("<i8").tobytes(), at[e].astype("<i4").tobytes()) for lo, hi in spans for e in [earliest[lo:hi]]], columns=columns)

    def earlier(x: pd.DataFrame) -> pd.DataFrame:
        digests = _joined(x["digests"], f"V{DIGEST}")
        ids, at = _joined(x["ids"], "<i8"), _joined(x["at"], "<i4")
        chunk = np.repeat(x["chunk"].to_numpy(), [len(d) // DIGEST for d in x["digests"]])
        order, lead = _ordered(digests, ids, at)
        late = np.zeros(len(order), bool)
        late[order] = (ids[order[lead]] != ids[order]) | (at[order[lead]] != at[order])
        found = pd.DataFrame({"chunk": chunk[late], "k": np.flatnonzero(late)})
        return pd.DataFrame([(c, 1, digests[g["k"].to_numpy()].tobytes()) for c, g in found.groupby("chunk")], columns=["chunk", "kind", "data"])

    def settle(texts: pd.DataFrame, replies: pd.DataFrame) -> pd.DataFrame:
        if not len(texts):
            return pd.DataFrame([], columns=[id_col, "n_words", "removed", "kept_text"])
        c = _Chunk(texts, block, parts)
        foreign = _joined(replies["data"][replies["kind"] == 1], f"V{DIGEST}")
        row, at, digests = c.windows(_joined(replies["data"][replies["kind"] == 0], "<u8"), size, block)
        none = np.full(len(foreign), -1)
        own, place = np.concatenate((np.full(len(foreign), 0), np.full(len(row), 1))), np.concatenate((none, at))
        ids = np.concatenate((none, c.ids[row]))
        order, lead = _ordered(np.concatenate((foreign, digests)), own, ids, place)
        head = order[lead]
        late = np.zeros(len(order), bool)
        late[order] = (own[head] == 0) | (ids[head] != ids[order]) | (place[head] != place[order])
        late = late[len(foreign) :]
        spans: dict[int, list[tuple[int, int]]] = {}
        edges = np.flatnonzero(np.diff(row[late])) + 1
        for own_rows, own_at in zip(np.split(row[late], edges), np.split(at[late], edges), strict=True):
            if len(own_rows):
                steps = np.zeros(c.n_words[own_rows[0]] + 1, np.int32)
                np.add.at(steps, own_at, 1)
                np.add.at(steps, own_at + size, -1)
                spans[int(own_rows[0])] = runs(np.cumsum(steps)[:-1] > 0)
        kept = []
        for row, text in enumerate(c.texts):
            words, out, at = text.split(), [], 0
            for s, e in spans.get(row, []):
                out += words[at:s]
                at = e
            kept.append(b" ".join(out + words[at:]).decode("utf-8", "surrogatepass"))
        ids = pd.array(c.ids, "Int64")
        ids[c.ids == NULL_ID] = pd.NA
        return pd.DataFrame({id_col: ids, "n_words": c.n_words, "removed": [[{"start": s, "end": e} for s, e in spans.get(r, [])] for r in range(len(kept))], "kept_text": kept})

    indexed = dealt.applyInPandas(index, "bucket int, chunk int, keys binary, blocks binary, several binary")
    hot = indexed.groupBy("bucket").applyInPandas(probe, "chunk int, kind int, data binary")
    windows = dealt.cogroup(hot.groupBy("chunk")).applyInPandas(extend, "bucket int, chunk int, digests binary, ids binary, at binary")
    late = windows.groupBy("bucket").applyInPandas(earlier, "chunk int, kind int, data binary")
    return dealt.cogroup(hot.union(late).groupBy("chunk")).applyInPandas(settle, f"`{id_col}` bigint, n_words bigint, removed array<struct<start: bigint, end: bigint>>, kept_text string")
