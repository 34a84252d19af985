"""Near copies: texts whose fingerprints SimHash links, or whose word shingles have a high Jaccard similarity.

The shingles are put in one order of all texts, the rarest first. Of n shingles, two texts of similarity t or
more share one among the first n - ceil(t n) + 1 of both, and at the first that they share enough of both must
be left. These first shingles travel as packed arrays, a few bytes each, and only those that different texts share
become rows. Texts that share such a shingle are compared by their whole sets: first each with the least text of
its shingle, then all those that are still in different groups. Before that, the parities of a set's shingles
by their last bits, as many parities as the set has shingles or more, bound how much two sets differ from below.
No pair is lost; the counts that give the order come from a sample and bear on the work alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import discard, hashed_words, map_texts, parallelism, prepare, staged, window_hashes
from recollect.llm.components import components
from recollect.llm.simhash import fingerprint, links

WORDS = 5
LIKENESS = 0.8
#: Shingles are counted in about so many documents; at most so many common ones are put last.
SAMPLE = 10_000
MOST_COMMON = 100_000
#: Least number of parities kept of a set, a power of two.
BITS = 64
#: Pairs of texts that a task looks at at once.
AT_ONCE = 1 << 19
#: Bytes of text whose first shingles make up a bucket, on average; first shingles that a task packs at once.
BUCKET_BYTES = 64 << 20
PACKED = 1 << 18
IN_WORD = np.ones(256, bool)
IN_WORD[[0x20, *range(0x09, 0x0E)]] = False


def _lower(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass").lower()


def shingles(text: str | None, size: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the runs of `size` words; of fewer words, of the whole sequence."""
    words = hashed_words(_lower(text), IN_WORD)[2]
    return np.unique(window_hashes(words, min(size, max(1, len(words)))))


def _node(text: str | None) -> int:
    """The same for texts of the same words."""
    return int(np.uint64(xxhash.xxh3_64_intdigest(b" ".join(_lower(text).split()), 7)).view(np.int64))


def prefix(own: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The first shingles of `own` (sorted), one of which any set of similarity `least` shares among its own first."""
    weight = np.zeros(len(own), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, own), len(common) - 1)
        weight = np.where(common[at] == own, counts[at], 0)
    return own[np.argsort(weight, kind="stable")[: len(own) - math.ceil(least * len(own) - 1e-9) + 1]]


def parities(own: np.ndarray) -> np.ndarray:
    """Whether the shingles of each value of their last bits are odd in number, for a power of two of values.

    Two sets differ in at least as many shingles as their parities do. There are as many as shingles or more: with
    far fewer, the parities of any two long sets differ in about half, which tells nothing.
    """
    size = max(BITS, 1 << max(0, len(own) - 1).bit_length())
    odd = np.bincount((own & np.uint64(size - 1)).astype(np.int64), minlength=size) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _differing(s: str, t: str) -> Column:
    """The number of parities that differ between two arrays, the longer one folded to the other's length."""
    least = F.least(F.size(s), F.size(t))

    def folded(v: str, i: Column) -> Column:
        return F.aggregate(F.sequence(i, F.size(v) - 1, least), F.lit(0).cast("bigint"), lambda x, k: x.bitwiseXOR(F.element_at(v, k + 1)))

    return F.aggregate(F.sequence(F.lit(0), least - 1), F.lit(0), lambda n, i: n + F.bit_count(folded(s, i).bitwiseXOR(folded(t, i))))


def _common(slim: DataFrame, size: int, sample: int) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of about `sample` documents, sorted, and their counts."""
    share = min(1.0, sample / max(1, slim.count()))
    few = slim.where(F.shiftrightunsigned(F.xxhash64("id", F.length("text")), 11) < int(share * (1 << 53))) if share < 1 else slim
    each = map_texts(few, "text", "s array<bigint>", lambda: lambda texts: [[shingles(t, size).view(np.int64) for t in texts]])
    found = each.select(F.explode("s").alias("s")).groupBy("s").count().where("count > 2").orderBy(F.desc("count"), "s").limit(MOST_COMMON).toPandas()
    values = found["s"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(values)
    return values[order], found["count"].to_numpy(np.int64)[order]


def _shared(slim: DataFrame, common: np.ndarray, counts: np.ndarray, size: int, least: float) -> DataFrame:
    """(key, node, at): the first shingles that texts of different words share; at is a place in the first ones.

    A key is the bucket and 32 further bits of a shingle's hash, so that shingles may meet that are not the same;
    places over 65,535 are given as that.
    """
    text_bytes = slim.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(parallelism(slim.sparkSession), -(-text_bytes // BUCKET_BYTES))

    def pack(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, nodes, places, held, seen = [], [], [], 0, set()

        def rows() -> pa.RecordBatch:
            h = np.concatenate(keys)
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            low, node, at = (h[order] & np.uint64(0xFFFFFFFF)).astype("<u4"), np.concatenate(nodes)[order], np.concatenate(places)[order]
            some = np.flatnonzero(np.diff(cuts)).tolist()
            parts = [[x[cuts[b] : cuts[b + 1]].tobytes() for b in some] for x in (low, node, at)]
            return pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), *(pa.array(x, pa.binary()) for x in parts)], names=["bucket", "keys", "nodes", "places"])

        for frame in frames:
            for value in frame.column(0):
                text = value.as_py()
                node = _node(text)
                if node in seen:  # a copy within what is packed at once adds nothing
                    continue
                seen.add(node)
                own = shingles(text, size)
                first = prefix(own, common, counts, least) if len(own) else own
                keys.append(first)
                nodes.append(np.full(len(first), node, "<i8"))
                places.append(np.minimum(np.arange(len(first)), 65_535).astype("<u2"))
                held += len(first)
                if held >= PACKED:
                    yield rows()
                    keys, nodes, places, held, seen = [], [], [], 0, set()
        if held:
            yield rows()

    def meet(x: pd.DataFrame) -> pd.DataFrame:
        keys, nodes, places = (np.frombuffer(b"".join(x[c]), kind) for c, kind in (("keys", "<u4"), ("nodes", "<i8"), ("places", "<u2")))
        order = np.lexsort((places, nodes, keys))
        keys, nodes, places = keys[order], nodes[order], places[order]
        new_key = np.concatenate(([True], keys[1:] != keys[:-1]))
        new = new_key | np.concatenate(([True], nodes[1:] != nodes[:-1]))
        group = np.cumsum(new_key) - 1
        kept = new & (np.bincount(group, new) > 1)[group]
        return pd.DataFrame({"key": (int(x["bucket"].iloc[0]) << 32) | keys[kept].astype(np.int64), "node": nodes[kept], "at": places[kept].astype(np.int32)})

    packed = slim.select("text").mapInArrow(pack, "bucket int, keys binary, nodes binary, places binary")
    return packed.repartition(buckets, "bucket").groupBy("bucket").applyInPandas(meet, "key bigint, node bigint, at int")


def _may_reach(n: Column, at: Column, m: Column, to: Column, least: float) -> Column:
    """Whether sets of n and m shingles whose first common one stands at `at` and `to` can be similar enough."""
    return F.least(n - at, m - to) >= F.ceil(least / (1 + least) * (n + m) - 1e-9)


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = WORDS, least: float = LIKENESS, most: int = 512, sample: int = SAMPLE) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs, as simhash.near_duplicates, with the links of `least` too.

    Two texts are also linked if their sets of word shingles have that Jaccard similarity. Other columns are
    not read.
    """
    prepare(docs.sparkSession)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    common, counts = _common(slim, size, sample)

    def read() -> Callable[[list], list]:
        def work(texts: list) -> list:
            sets = [shingles(t, size) for t in texts]
            return [np.array([fingerprint(t) for t in texts], np.uint64).view(np.int64), [_node(t) for t in texts], [len(s) for s in sets], [parities(s) for s in sets]]

        return work

    rows = staged(map_texts(slim, "text", "fp bigint, node bigint, n int, bits array<bigint>", read), "prints")
    classes = rows.groupBy("fp").agg(F.min("id").alias("least"))
    roots = components(links(rows))
    classes = staged(classes.join(roots, classes.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root")), "classes")
    each = rows.groupBy("node").agg(F.min("id").alias("id"), F.first("fp").alias("fp"), F.first("n").alias("n"), F.first("bits").alias("bits"))
    each = staged(each.join(classes.select("fp", "root"), "fp").drop("fp"), "nodes")
    marks = staged(_shared(slim, common, counts, size, least), "marks").join(each.select("node", "root", "n"), "node")
    several = marks.groupBy("key").agg(F.min("root").alias("p"), F.max("root").alias("q")).where("p <> q").select("key")
    shared = staged(marks.join(several, "key"), "shared")

    def compared(pairs: DataFrame) -> DataFrame:
        """(a, b) of roots: the pairs (x, y, a, b) whose whole sets are similar."""
        own = each.select("node", "n", "bits")
        both = pairs.join(own.toDF("x", "n", "s"), "x").join(own.toDF("y", "m", "t"), "y")
        pairs = staged(both.where(_differing("s", "t") <= (1 - least) / (1 + least) * (F.col("n") + F.col("m")) + 1e-9).select("x", "y", "a", "b"), "close")
        wanted = staged(pairs.select(F.col("x").alias("node")).union(pairs.select("y")).distinct(), "wanted")
        # a written table has a known size, so that few ids are broadcast and the texts stay where they are
        ids = staged(each.join(wanted, "node").where("id is not null").select("id").distinct(), "ids")
        own = slim.join(ids, "id", "left_semi").union(slim.where("id is null"))
        sets = map_texts(own, "text", "node bigint, s array<bigint>", lambda: lambda texts: [[_node(t) for t in texts], [shingles(t, size).view(np.int64) for t in texts]])
        sets = staged(sets.join(wanted, "node", "left_semi").groupBy("node").agg(F.first("s").alias("s")), "sets")
        both = pairs.join(sets.select(F.col("node").alias("x"), F.col("s").alias("s")), "x").join(sets.select(F.col("node").alias("y"), F.col("s").alias("t")), "y")
        both = both.withColumn("both", F.size(F.array_intersect("s", "t")))
        found = staged(both.where(F.col("both") / (F.size("s") + F.size("t") - F.col("both")) >= least).select("a", "b").distinct(), "links")
        discard(pairs, wanted, ids, sets)
        return found

    heads = shared.groupBy("key").agg(F.min(F.struct("node", "root", "n", "at")).alias("h"))
    stars = shared.join(heads, "key").where((F.col("root") != F.col("h.root")) & _may_reach(F.col("n"), F.col("at"), F.col("h.n"), F.col("h.at"), least))
    stars = staged(stars.select(F.col("node").alias("x"), F.col("h.node").alias("y"), F.col("root").alias("a"), F.col("h.root").alias("b")).distinct(), "pairs")
    grouped = staged(components(compared(stars)), "grouped")
    now = shared.join(grouped.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").withColumn("whole", F.coalesce("whole", "root"))
    apart = now.groupBy("key").agg(F.count("*").alias("m"), F.min("whole").alias("p"), F.max("whole").alias("q")).where("p <> q").select("key", "m")
    # a key of many texts is dealt out as pairs of blocks
    dealt = now.join(apart, "key").withColumn("blocks", F.ceil(F.col("m") / most)).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "block", "node", "whole", "n", "at")
    # as rows in order, not as lists: a batch of lists can take any number of bytes
    dealt = dealt.repartition(parallelism(docs.sparkSession), "key", "low", "high").sortWithinPartitions("key", "low", "high")

    def crossed(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, out, waiting = np.zeros((8, 0), np.int64), [], 0
        for frame in chain(frames, [None]):
            if frame is not None:
                held = np.concatenate((held, [c.to_numpy(zero_copy_only=False).astype(np.int64) for c in frame.columns]), axis=1)
            starts = np.flatnonzero(np.concatenate((np.ones(min(1, held.shape[1]), bool), (held[:3, 1:] != held[:3, :-1]).any(axis=0))))
            if frame is not None:
                starts, end = starts[:-1], starts[-1] if len(starts) else 0  # the last group may go on
            else:
                end = held.shape[1]
            size = np.diff(np.append(starts, end))
            before = np.cumsum(size * (size - 1) // 2)
            lo = 0
            while lo < len(size):
                hi = max(lo + 1, int(np.searchsorted(before, (before[lo - 1] if lo else 0) + AT_ONCE)))
                out.append(met(held[:, starts[lo] : starts[hi] if hi < len(size) else end], size[lo:hi]))
                waiting += out[-1].shape[1]
                lo = hi
                if waiting >= AT_ONCE:  # pairs share many shingles
                    yield once(out)
                    out, waiting = [], 0
            held = held[:, end:]
        if waiting:
            yield once(out)

    def once(parts: list[np.ndarray]) -> pa.RecordBatch:
        pairs = np.concatenate(parts, axis=1)
        pairs = pairs[:, np.lexsort((pairs[1], pairs[0]))]
        new = np.ones(pairs.shape[1], bool)
        new[1:] = (pairs[:2, 1:] != pairs[:2, :-1]).any(axis=0)
        return pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[:, new]], names=["x", "y", "a", "b"])

    def met(rows: np.ndarray, size: np.ndarray) -> np.ndarray:
        """The pairs within groups of these sizes that can be similar enough."""
        _, low, high, block, node, whole, n, at = rows
        later = np.repeat(np.cumsum(size), size) - np.arange(len(node)) - 1
        i = np.repeat(np.arange(len(node)), later)
        j = i + 1 + np.arange(len(i)) - np.repeat(np.cumsum(later) - later, later)
        fit = (whole[i] != whole[j]) & ((low[i] == high[i]) | (block[i] != block[j]))
        i, j = i[fit], j[fit]
        fit = np.minimum(n[i] - at[i], n[j] - at[j]) >= np.ceil(least / (1 + least) * (n[i] + n[j]) - 1e-9)
        i, j = i[fit], j[fit]
        i, j = np.where(node[i] > node[j], i, j), np.where(node[i] > node[j], j, i)
        return np.stack((node[i], node[j], whole[i], whole[j]))

    rest = dealt.mapInArrow(crossed, "x bigint, y bigint, a bigint, b bigint").distinct().join(stars, ["x", "y"], "left_anti")
    # the groups found first are joined as wholes, so that their links are not followed again
    joined = components(compared(staged(rest, "pairs")))
    ends = classes.join(grouped.select(F.col("node").alias("root"), F.col("root").alias("first")), "root", "left").select("fp", "least", F.coalesce("first", "root").alias("root"))
    ends = ends.join(joined.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left").select("fp", "least", F.coalesce("whole", "root").alias("root"))
    ends = staged(ends, "ends")
    named = ends.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(ends.join(named, "root").select("fp", "component_id"), "fp").select(F.col("id").alias(id_col), "fp", "component_id")
