"""Recall for many prompts at once.

What `search.recall`, `with_recent` and `graph.activate` do for one prompt is done here for a table of prompts: a task
holds a block of nodes, prompts pass by a few hundred at a time, and of each prompt the best `k` of the block leave the
task; only these partial lists are shuffled and merged. Neither prompts nor nodes pass through the driver, and no
task holds more than a block and some prompts. Time phrases give a prompt its window, results that fall short of the limit
are filled up with the window's newest nodes, and the best results activate their neighbours. Reading changes nothing:
`touches` are the accesses of direct hits, for `touch_all` to apply.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.temporal import has_phrase, only_time, window, without_phrases
from recollect.functions.text import QUESTION, words
from recollect.model import PARAMS, Params, days_between
from recollect.operators.graph import both_ways, factor, touched
from recollect.operators.search import BETWEEN, IDENTITY_WORDS, K1, STOP_WORDS, B, alive, blended, final_score, normalised
from recollect.operators.vectors import nearest
from recollect.sources.tables import staged

#: Prompts that are scored at once, and nodes of a block.
GROUP, BLOCK = 256, 20_000
#: A term is common in a block if one in so many of its nodes has it; numbers in the matrix of common terms.
SPARSE, MATRIX = 16, 8_000_000
#: Parts of the join of candidates with nodes, so that a node that many prompts find is dealt.
SALTS = 16


def plan(prompts: DataFrame, now: Column) -> DataFrame:
    """Prompts (prompt_id, prompt, embedding) with query, after, before, asks, only_time and terms.

    A time phrase is taken out of the query and gives the window. A null prompt has no terms.
    """
    text = F.coalesce(F.col("prompt"), F.lit(""))
    timed, w = has_phrase(text), window(text, now)
    p = prompts.select("prompt_id", "embedding", F.when(timed, w["after"]).alias("after"), F.when(timed, w["before"]).alias("before"), F.when(timed, without_phrases(text)).otherwise(text).alias("query"))
    raw = F.array_remove(F.split(F.lower(F.regexp_replace("query", r"[^\p{L}\p{N}_\s]", " ")), r"\s+"), "")
    p = p.withColumns({"asks": F.col("query").rlike(QUESTION), "only_time": only_time(F.col("query")), "raw": raw})
    long = F.filter("raw", lambda t: F.length(t) > 1)
    topical = F.filter(long, lambda t: ~t.isin(*STOP_WORDS))
    terms = F.when(F.size(topical) > 0, topical).otherwise(long)
    own = F.when((F.size(terms) > 0) & F.arrays_overlap("raw", F.array(*map(F.lit, IDENTITY_WORDS))), F.array(F.lit("about_self"))).otherwise(F.array().cast("array<string>"))
    return p.withColumn("terms", F.concat(terms, own)).drop("raw")


def _empty(*names: str) -> pd.DataFrame:
    return pd.DataFrame({n: [] for n in names})


def _ranked(rows: DataFrame, k: int) -> DataFrame:
    order = W.partitionBy("prompt_id").orderBy(F.desc("score"), "id")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


class _Block:
    """The postings (key, id, w) of a block of nodes: lists of common terms as rows of a matrix, the others as they are."""

    def __init__(self, key: np.ndarray, ids: pa.Array, w: np.ndarray):
        named = ids.dictionary_encode()
        first = pc.array_sort_indices(named.dictionary)
        self.ids, place = named.dictionary.take(first), np.argsort(first.to_numpy())[named.indices.to_numpy()]
        self.keys, code, counts = np.unique(key, return_inverse=True, return_counts=True)
        order = np.lexsort((place, code))
        self.place, self.w, self.ends = place[order], w[order], np.append(0, np.cumsum(counts))
        common = np.flatnonzero(counts * SPARSE >= len(self.ids))
        common = common[np.argsort(-counts[common], kind="stable")][: max(1, MATRIX // len(self.ids))]
        self.row, self.matrix = np.full(len(self.keys), -1), np.zeros((len(common), len(self.ids)))
        self.row[common] = np.arange(len(common))
        for r, c in enumerate(common):
            self.matrix[r, self.place[self.ends[c] : self.ends[c + 1]]] = self.w[self.ends[c] : self.ends[c + 1]]

    def scores(self, prompt: np.ndarray, code: np.ndarray, weight: np.ndarray, n: int) -> np.ndarray:
        """The score of each node for each of n prompts, from rows (prompt, code of a key that is there, weight)."""
        common = self.row[code] >= 0
        asked = np.zeros((n, len(self.matrix)))
        asked[prompt[common], self.row[code[common]]] = weight[common]
        out = asked @ self.matrix
        for p, c, x in zip(prompt[~common], code[~common], weight[~common], strict=True):
            at = slice(self.ends[c], self.ends[c + 1])
            out[p, self.place[at]] += x * self.w[at]
        return out

    def every(self, codes: np.ndarray) -> np.ndarray:
        """Places of the nodes that have all the keys, from the rarest on."""
        codes = codes[np.argsort(np.diff(self.ends)[codes], kind="stable")]
        at = self.place[self.ends[codes[0]] : self.ends[codes[0] + 1]]
        for c in codes[1:]:
            if not len(at):
                break
            at = at[self.matrix[self.row[c], at] > 0] if self.row[c] >= 0 else np.intersect1d(at, self.place[self.ends[c] : self.ends[c + 1]], assume_unique=True)
        return at


def _best(group: np.ndarray, place: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Which rows are the k best of their group; ties by place."""
    order = np.lexsort((place, -score, group))
    g = group[order]
    return order[np.arange(len(g)) - np.searchsorted(g, g) < k]


def _scored(block: _Block, rows: pa.Table, k: int) -> pa.RecordBatch:
    """The k best nodes of the block for each prompt of the rows (prompt_id, key, x), and the k best of those that have every key."""
    named = rows.column("prompt_id").combine_chunks().dictionary_encode()
    prompt, key, weight, n = named.indices.to_numpy(), rows.column("key").to_numpy(), rows.column("x").to_numpy(), len(named.dictionary)
    code = np.minimum(np.searchsorted(block.keys, key), len(block.keys) - 1)
    there = block.keys[code] == key
    s = block.scores(prompt[there], code[there], weight[there], n)
    least = np.partition(s, -k, axis=1)[:, -k, None] - 2e-6 if s.shape[1] > k else -1.0  # scores are compared as rounded to six places
    i, j = np.nonzero((s > 0) & (s >= least))
    keep = _best(i, j, np.round(s[i, j], 6), k)
    found = [np.stack([i[keep], j[keep]])]
    whole = np.flatnonzero((np.bincount(prompt, there, n) == np.bincount(prompt, minlength=n)) & (np.bincount(prompt, minlength=n) > 0))
    starts = np.searchsorted(prompt, np.arange(n + 1))
    every = [(p, at) for p in whole if len(at := block.every(code[starts[p] : starts[p + 1]]))]
    if every:
        i, j = np.concatenate([np.full(len(at), p) for p, at in every]), np.concatenate([at for _, at in every])
        keep = _best(i, j, np.round(s[i, j], 6), k)
        found.append(np.stack([i[keep], j[keep]]))
        both, at = np.unique(np.concatenate([x[0] * s.shape[1] + x[1] for x in found]), return_index=True)
        has = np.isin(both, i * s.shape[1] + j)
    else:
        both, has = found[0][0] * s.shape[1] + found[0][1], np.zeros(found[0].shape[1], bool)
    i, j = np.divmod(both, s.shape[1])
    return pa.RecordBatch.from_arrays([named.dictionary.take(pa.array(i)), block.ids.take(pa.array(j)), pa.array(np.round(s[i, j], 6)), pa.array(has)], names=["prompt_id", "id", "score", "every"])


def text_lists(planned: DataFrame, index, k: int, params: Params = PARAMS) -> DataFrame:
    """(prompt_id, id, score, rank): the k best nodes by BM25 of each planned prompt, from the stored index.

    Where some node has every term of a prompt, only such nodes count, as in search.bm25. A task holds the postings of
    a block of nodes, which travel once, and the terms of all prompts pass by, a few hundred prompts at a time.
    """
    docs, total, _ = index.totals()
    mean, blocks = (total / docs if docs else 0.0), max(1, docs // BLOCK, 2 * planned.sparkSession.sparkContext.defaultParallelism)
    each = planned.select("prompt_id", F.explode("terms").alias("term")).groupBy("prompt_id", F.array_remove(F.split("term", BETWEEN), "").alias("parts")).agg(F.count("*").alias("m"))
    each = staged(each.withColumn("name", F.array_join("parts", " ")), "terms")
    names = staged(each.select("name", "parts").distinct().withColumn("key", F.monotonically_increasing_id()), "keys")
    found = staged(index.counts(names.select("key", "parts"), params.field_weights), "counts").where("tf > 0")
    frequency = found.groupBy("key").agg(F.count("*").alias("d"))
    ratio = (F.lit(float(docs)) - F.col("d") + 0.5) / (F.col("d") + 0.5)
    idf = F.when(F.log(ratio) > 0, F.log(ratio)).otherwise(1e-6)
    left = each.join(names.select("name", "key"), "name").join(frequency, "key", "left").select("prompt_id", "key", (F.col("m") * idf).alias("x"))
    below = F.col("tf") + K1 * (1 - B + B * F.col("n") / F.lit(mean))
    right = found.select("key", "id", (F.col("tf") * (K1 + 1) / below).alias("x"), F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("b"))
    kinds = f"prompt_id {dict(planned.dtypes)['prompt_id']}, id {dict(found.dtypes)['id']}, score double, every boolean"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, block, rest = [], None, []

        def sent(last: bool) -> Iterator[pa.RecordBatch]:
            rows = pa.Table.from_batches(rest)
            ends = np.append(np.flatnonzero(pc.not_equal(rows.column("prompt_id")[1:], rows.column("prompt_id")[:-1]).to_numpy()) + 1, rows.num_rows)
            ends, lo = ends if last else ends[:-1], 0  # the last prompt's terms may go on in the next batch
            for at in range(0, len(ends), GROUP):
                hi = int(ends[min(len(ends), at + GROUP) - 1])
                yield _scored(block, rows.slice(lo, hi - lo), k)
                lo = hi
            rest[:] = rows.slice(lo).to_batches()

        for x in batches:
            n = x.column("prompt_id").null_count
            if n:
                held.append(x.slice(0, n).select(["key", "id", "x"]))
            if n == x.num_rows or not held:
                continue
            if block is None:
                t = pa.Table.from_batches(held)
                block = _Block(t.column("key").to_numpy(), t.column("id").combine_chunks(), t.column("x").to_numpy())
            rest.append(x.slice(n).select(["prompt_id", "key", "x"]))
            yield from sent(False)
        if rest:
            yield from sent(True)

    passing = left.withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = right.unionByName(passing, allowMissingColumns=True).repartitionById(blocks, F.col("b")).sortWithinPartitions(F.asc_nulls_first("prompt_id"))
    lists = dealt.mapInArrow(score, kinds)
    some_all = F.max("every").over(W.partitionBy("prompt_id"))
    return _ranked(lists.withColumn("some_all", some_all).where("every or not some_all").select("prompt_id", "id", "score"), k)


def vector_lists(planned: DataFrame, vectors: DataFrame, k: int, least: float) -> DataFrame:
    """(prompt_id, id, score, rank): the k most similar vectors of each prompt that has an embedding."""
    key = F.lit(0).alias("key")
    near = nearest(planned.select(F.col("prompt_id").alias("id"), "embedding", key), vectors.select("id", "embedding", key), k, least=least)
    return near.select(F.col("id").alias("prompt_id"), F.col("other").alias("id"), F.col("similarity").alias("score"), "rank")


def newest(windows: DataFrame, nodes: DataFrame, k: int, blocks: int) -> DataFrame:
    """(after, before, id, created): the k newest nodes within each window; ties by id."""
    kinds = f"after timestamp, before timestamp, id {dict(nodes.dtypes)['id']}, created timestamp"

    def pick(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        out = [_empty("after", "before", "id", "created")]
        b = b.sort_values(["created", "id"], ascending=[False, True])
        times = -b["created"].to_numpy().astype("datetime64[us]").astype(np.int64)
        for after, before in zip(a["after"], a["before"], strict=True):
            lo = np.searchsorted(times, -np.datetime64(before, "us").astype(np.int64), "left")
            hi = np.searchsorted(times, -np.datetime64(after, "us").astype(np.int64), "right")
            if lo < hi:
                out.append(b.iloc[lo : min(hi, lo + k)][["id", "created"]].assign(after=after, before=before))
        return pd.concat(out[1:])[["after", "before", "id", "created"]] if len(out) > 1 else out[0]

    asked = windows.select("after", "before").distinct().withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    dealt = nodes.where("created is not null").select("id", "created").withColumn("b", F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int"))
    found = asked.groupBy("b").cogroup(dealt.groupBy("b")).applyInPandas(pick, kinds)
    order = W.partitionBy("after", "before").orderBy(F.desc("created"), "id")
    return found.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k).drop("_r")


def _direct(planned: DataFrame, nodes: DataFrame, fused: DataFrame, now: Column, limit: int, params: Params) -> DataFrame:
    """(prompt_id, id, score) of the candidates (prompt_id, id, rrf, similarity), filtered, cut and boosted."""
    own = W.partitionBy("prompt_id")
    candidates = fused.select("prompt_id", "id", normalised(F.col("rrf"), own, params).alias("rrf"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    candidates = staged(candidates.withColumn("salt", F.pmod(F.xxhash64("prompt_id"), F.lit(SALTS))), "candidates")
    narrow = nodes.join(candidates.select("id").distinct(), "id", "left_semi").select("id", "tier", "title", "confidence", "last_accessed", "access_count", "valid_until", "created", F.length("content").alias("length"))
    salted = narrow.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    d = candidates.join(salted, ["id", "salt"]).join(planned.select("prompt_id", "query", "asks", "after", "before"), "prompt_id")
    base = F.round(blended(F.col("rrf"), F.col("similarity"), F.col("length"), F.col("asks"), params), 9)
    inside = F.col("after").isNull() | ((F.col("created") >= F.col("after")) & (F.col("created") <= F.col("before")))
    kept = d.withColumn("base", base).where(alive(now) & inside)
    cut = kept.withColumn("_r", F.row_number().over(own.orderBy(F.desc("base"), "id"))).where(F.col("_r") <= limit)
    scored = cut.withColumn("score", final_score(F.col("base"), F.col("asks"), words(F.col("query")), now, params))
    return scored.where(F.col("score") >= params.min_result_score).select("prompt_id", "id", "score")


def _filled(planned: DataFrame, direct: DataFrame, nodes: DataFrame, limit: int, blocks: int) -> DataFrame:
    """Direct results and, up to the limit, the newest nodes of the prompt's window; these alone for prompts only of time."""
    timed = planned.where("after is not null").select("prompt_id", "after", "before", "only_time")
    bare = timed.where("only_time").select("prompt_id")
    kept = direct.join(bare, "prompt_id", "left_anti")
    have = timed.join(kept.groupBy("prompt_id").agg(F.count("*").alias("have")), "prompt_id", "left").fillna(0, ["have"])
    short = have.where(F.col("have") < limit)
    recent = short.join(newest(timed, nodes, 2 * limit, blocks), ["after", "before"]).join(kept.select("prompt_id", "id"), ["prompt_id", "id"], "left_anti")
    more = recent.withColumn("_r", F.row_number().over(W.partitionBy("prompt_id").orderBy(F.desc("created"), "id"))).where(F.col("_r") <= limit - F.col("have"))
    return kept.withColumn("source", F.lit("hybrid")).unionByName(more.select("prompt_id", "id", F.lit(0.001).alias("score"), F.lit("temporal").alias("source")))


def activate_all(results: DataFrame, edges: DataFrame, nodes: DataFrame, params: Params = PARAMS) -> DataFrame:
    """graph.activate for the results (prompt_id, id, score, source) of each prompt."""
    own = W.partitionBy("prompt_id")
    best = results.withColumn("_r", F.row_number().over(own.orderBy(F.desc("score"), "id"))).where(F.col("_r") <= params.activation_seeds)
    seeds = best.select("prompt_id", F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    wanted = both_ways(edges).withColumnRenamed("id", "seed").join(seeds, "seed")
    met = wanted.select("prompt_id", "seed", F.col("other").alias("id"), "edge_type", F.round(F.col("seed_score") * F.col("weight") * factor(F.col("edge_type")) * params.activation_decay, 6).alias("score"))
    fresh = met.join(results.select("prompt_id", "id"), ["prompt_id", "id"], "left_anti")
    order = F.row_number().over(W.partitionBy("prompt_id", "seed").orderBy(F.desc("score"), "id", "edge_type"))
    strongest = fresh.withColumn("_r", order).where(F.col("_r") <= params.activation_per_seed)
    found = strongest.groupBy("prompt_id", "id").agg(F.max(F.struct("score", F.struct((-F.col("seed")).alias("s"), "edge_type").alias("by"))).alias("m"))
    found = found.select("prompt_id", "id", F.col("m.score").alias("score"), (-F.col("m.by.s")).alias("activated_by"), F.col("m.by.edge_type").alias("activation_edge"))
    found = found.join(nodes.select("id"), "id", "left_semi").withColumn("source", F.when(F.col("activation_edge") == "contradicts", "conflict").otherwise("activated"))
    none = F.lit(None)
    direct = results.select("prompt_id", "id", "score", "source", none.cast(found.schema["activated_by"].dataType).alias("activated_by"), none.cast("string").alias("activation_edge"))
    return direct.unionByName(found)


def recall_all(prompts: DataFrame, nodes: DataFrame, vectors: DataFrame, index, edges: DataFrame | None, now: Column, limit: int = 10, params: Params = PARAMS, overfetch: int = 3) -> DataFrame:
    """(prompt_id, id, score, source, activated_by, activation_edge) for prompts (prompt_id, prompt, embedding).

    Each prompt's rows are those of search.recall with the time window that its phrases give, filled up and
    activated. A prompt without an embedding is searched by text alone, one without terms by vector alone. Null
    prompt ids are left out; a repeated prompt id is an error of the caller, whose lists would mix.
    """
    planned = staged(plan(prompts.where("prompt_id is not null"), now), "prompts")
    k, blocks = limit * overfetch, max(1, index.totals()[0] // BLOCK, index.parallelism())
    scale = lambda plain, by: F.when(F.col("asks"), plain * by).otherwise(plain)
    near = staged(vector_lists(planned, vectors, k, params.similarity_threshold), "near")
    asks = planned.select("prompt_id", "asks")
    parts = [(text_lists(planned, index, k, params), scale(params.fts_weight, params.question_fts_scale)), (near, scale(params.vector_weight, params.question_vector_scale))]
    shares = [x.join(asks, "prompt_id").select("prompt_id", "id", (weight / (params.rrf_k + F.col("rank"))).alias("part")) for x, weight in parts]
    fused = reduce(DataFrame.unionByName, shares).groupBy("prompt_id", "id").agg(F.sum("part").alias("rrf"))
    fused = fused.join(near.select("prompt_id", "id", F.col("score").alias("similarity")), ["prompt_id", "id"], "left")
    direct = staged(_direct(planned, nodes, fused, now, limit, params), "direct")
    results = _filled(planned, direct, nodes, limit, blocks)
    if edges is None:
        return results.withColumns({"activated_by": F.lit(None).cast(dict(nodes.dtypes)["id"]), "activation_edge": F.lit(None).cast("string")})
    return activate_all(staged(results, "results"), edges, nodes, params)


def touches(results: DataFrame) -> DataFrame:
    """(id, touches): how many prompts hit a node directly; what was only activated is not accessed."""
    return results.where(~F.col("source").isin("activated", "conflict")).groupBy("id").agg(F.count("*").alias("touches"))


def touch_all(nodes: DataFrame, hits: DataFrame, now: Column, params: Params = PARAMS) -> DataFrame:
    """Nodes after their accesses `now`, one after another: count, times and stability."""
    hit = nodes.join(hits.select("id", F.col("touches").alias("_n")), "id", "left")
    anchor = F.coalesce("last_review", "last_accessed") if "last_review" in nodes.columns else F.col("last_accessed")
    first = touched(F.col("stability"), days_between(now, anchor), params)
    stability = F.aggregate(F.sequence(F.lit(1).cast("bigint"), F.col("_n")), first, lambda s, i: F.when(i > 1, touched(s, F.lit(0.0), params)).otherwise(s))
    new = {"stability": stability, "access_count": F.col("access_count") + F.col("_n"), "last_accessed": now, "last_review": now}
    return hit.select(*(F.when(F.col("_n").isNotNull(), new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in nodes.columns))
