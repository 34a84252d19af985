"""Retrieval: full-text and vector search, rank fusion, and the scores built on them."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import QUESTION, words
from recollect.model import PARAMS, Params, days_between
from recollect.operators.vectors import top_k

# Words that a full-text query leaves out, and those that ask for the user's own memories.
STOP_WORDS = """
a an the is are was were be been being have has had do does did will would could should may might shall can need dare
ought user i me my we our you your he she it they them this that these those am not no nor so if or and but for of to
in on at by with from as into about what which who whom when where why how all any each every both few more most other
some such than too very just because also
""".split()
IDENTITY_WORDS = ["user", "i", "me", "my", "we", "our", "you", "your"]
BETWEEN = r"[^\p{L}\p{N}]+"
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
K1, B = 1.2, 0.75


def query_terms(query: str) -> list[str]:
    """The terms of a full-text query; about_self is added where it asks about the user."""
    raw = re.sub(r"[^\w\s]", " ", query).lower().split()
    terms = [t for t in raw if t not in STOP_WORDS and len(t) > 1] or [t for t in raw if len(t) > 1]
    return terms + ["about_self"] * bool(terms and set(raw) & set(IDENTITY_WORDS))


def tokens(text: Column, fold: bool = False) -> Column:
    low = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(F.translate(low, *ACCENTS) if fold else low, BETWEEN), "")


def phrase(term: str) -> list[str]:
    """The words of a term; more than one are a phrase."""
    return re.findall(r"[^\W_]+", term)


def _occurrences(tokens: Column, term: str) -> Column:
    """How often a term stands among the tokens; a term of several words is a phrase."""
    parts = phrase(term)
    if len(parts) == 1:
        return F.size(F.filter(tokens, lambda t: t == parts[0]))
    here = [F.slice(tokens, k + 1, F.greatest(F.size(tokens) - len(parts) + 1, F.lit(0))) for k in range(len(parts))]
    matches = [_equal_to(h, p) for h, p in zip(here, parts, strict=True)]
    both = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x & y), matches)
    return F.size(F.filter(both, lambda x: F.coalesce(x, F.lit(False))))


def _equal_to(tokens: Column, word: str) -> Column:
    return F.transform(tokens, lambda t: t == word)


def bm25(nodes: DataFrame, terms: list[str], params: Params = PARAMS, mode: str = "and_or", fold: bool = False, stem=None) -> DataFrame:
    """(id, score) of the nodes that match, score rounded to six places.

    mode: "and" takes nodes with every term, "or" with any, "and_or" those with every term if there are some.
    The terms are counted in one narrow pass; only a row of corpus statistics is gathered and joined back.
    `stem` maps a column of tokens and a list of terms to their stems.
    """
    if not terms:
        return nodes.select("id", F.lit(0.0).alias("score")).limit(0)
    fields = [tokens(F.col(c), fold) if c != "tags" else tokens(F.array_join("tags", " "), fold) for c in ("title", "content", "tags")]
    t = nodes.select("id", *(f.alias(f"f{k}") for k, f in enumerate(fields)))
    if stem:
        t, terms = stem(t, ["f0", "f1", "f2"]), stem(None, terms)
    counts = [sum((F.lit(w) * _occurrences(F.col(f"f{k}"), term) for k, w in enumerate(params.field_weights)), F.lit(0.0)) for term in terms]
    t = t.select("id", (F.size("f0") + F.size("f1") + F.size("f2")).alias("n"), F.array(*counts).alias("tf"))
    return scored(t, len(terms), mode)


def scored(counts: DataFrame, terms: int, mode: str, docs: float | None = None, mean: float | None = None) -> DataFrame:
    """(id, score) from counts (id, n, tf: weighted count of each term); unless given, docs and mean are those of counts."""
    every = F.forall("tf", lambda x: x > 0)
    found = [F.sum(F.when(F.col("tf")[k] > 0, 1).otherwise(0)).alias(f"d{k}") for k in range(terms)]
    known = [F.lit(docs), F.lit(mean)] if docs is not None else [F.count("*"), F.avg("n")]
    stats = counts.agg(known[0].alias("docs"), known[1].alias("mean"), F.max(every).alias("some_all"), *found)
    t = counts.where(F.exists("tf", lambda x: x > 0)).crossJoin(F.broadcast(stats))  # one row
    wanted = {"and": every, "or": F.lit(True), "and_or": every | ~F.col("some_all")}[mode]
    score = F.lit(0.0)
    for k in range(terms):
        ratio = (F.col("docs") - F.col(f"d{k}") + 0.5) / (F.col(f"d{k}") + 0.5)
        idf = F.when(F.log(ratio) > 0, F.log(ratio)).otherwise(1e-6)
        f = F.col("tf")[k]
        score = score + idf * f * (K1 + 1) / (f + K1 * (1 - B + B * F.col("n") / F.col("mean")))
    return t.where(wanted).select("id", F.round(score, 6).alias("score"))


def ranked(found: DataFrame, score: str, k: int) -> DataFrame:
    """The k best with their rank from 1; ties by id. The window holds k rows."""
    best = found.orderBy(F.desc(score), "id").limit(k)
    return best.withColumn("rank", F.row_number().over(W.orderBy(F.desc(score), "id")))


def fuse(lists: list[tuple[DataFrame, float]], k: int = PARAMS.rrf_k) -> DataFrame:
    """(id, rrf): the sum over ranked lists of weight / (k + rank)."""
    parts = [x.select("id", (F.lit(float(w)) / (k + F.col("rank"))).alias("part")) for x, w in lists]
    return reduce(DataFrame.unionByName, parts).groupBy("id").agg(F.sum("part").alias("rrf"))


def normalised(score: Column, over: W, params: Params = PARAMS) -> Column:
    """From 0 to 1 over the window if the scores are apart, else as a share of the greatest."""
    high, low = F.max(score).over(over), F.min(score).over(over)
    return F.when((high > 0) & (high - low > high * params.min_spread_ratio), (score - low) / (high - low)).when(high > 0, score / high).otherwise(score)


def blended(rrf: Column, similarity: Column, length: Column, question: Column, params: Params = PARAMS) -> Column:
    """Normalised rank score and similarity, the latter damped for long contents; without similarity, damped itself."""
    weight = F.when(question, params.question_blend).otherwise(params.similarity_blend)
    damped = similarity * F.when(length > params.length_threshold, F.greatest(F.lit(0.1), params.length_threshold / length)).otherwise(1.0)
    return F.when(similarity > 0, (1 - weight) * rrf + weight * damped).otherwise(rrf * params.fts_only_dampening)


def final_score(base: Column, question: Column, query_words: Column, now: Column, params: Params = PARAMS) -> Column:
    """Base score with the boosts for title, confidence, tier, recency and accesses, rounded to six places."""
    asked = F.array_distinct(query_words)
    shared = F.size(F.array_intersect(F.filter(asked, lambda w: F.length(w) > 2), words(F.coalesce("title", F.lit("")))))
    boost = F.when(question | (F.size(asked) == 0), 1.0).otherwise(1 + params.title_boost * shared / F.size(asked))
    adjusted = base * boost * (0.4 + 0.6 * F.coalesce("confidence", F.lit(1.0)))
    tier = F.when(F.col("tier") == "core", 1 + params.core_boost).when(F.col("tier") == "archival", 1 - params.archival_penalty).otherwise(1.0)
    days = F.greatest(days_between(now, F.col("last_accessed")), F.lit(0.0))
    recency = adjusted * params.recency_weight * F.exp(-days * 0.6931471805599453 / params.recency_half_life_days)
    access = adjusted * params.access_weight * F.log1p(F.coalesce("access_count", F.lit(0)).cast("double")) / 3.044522437723423
    return F.round(adjusted * tier + recency + access, 6)


def alive(now: Column) -> Column:
    return F.col("valid_until").isNull() | (F.col("valid_until") > now)


def wanted(types=None, tiers=None, spaces=None, tags=None, after: Column | None = None, before: Column | None = None) -> Column:
    """The filters of a search as one condition; those not given hold."""
    out = F.lit(True)
    for name, values in (("type", types), ("tier", tiers), ("space", spaces)):
        if values:
            out = out & F.col(name).isin(*values)
    if tags:
        out = out & F.arrays_overlap("tags", F.array(*map(F.lit, tags)))
    if after is not None:
        out = out & (F.col("created") >= after)
    if before is not None:
        out = out & (F.col("created") <= before)
    return out


def recall(nodes: DataFrame, vectors: DataFrame | None, query: str, vector: list[float] | None, now: Column, limit: int = 10, filters: Column | None = None, params: Params = PARAMS, overfetch: int = 3, stem=None, index=None) -> DataFrame:
    """Hybrid search: id, score, source and the node's columns, best first, at most `limit` rows.

    The candidates are the best of either list; filters run after the lists are cut, and `limit` cuts by the
    base score before the boosts reorder, so a boost lifts no row past the cut. Without vectors the full-text
    list stands alone. All joins meet at most 2 * overfetch * limit candidates. With a stored `index` of the
    nodes' texts (sources.fulltext) the terms are looked up there, without reading the texts.
    """
    asks = re.search(QUESTION, query or "", re.ASCII) is not None
    text_weight, vector_weight = (params.fts_weight * params.question_fts_scale, params.vector_weight * params.question_vector_scale) if asks else (params.fts_weight, params.vector_weight)
    k = limit * overfetch
    terms = query_terms(query)
    text = ranked(index.search(terms, params.field_weights) if index else bm25(nodes, terms, params, stem=stem), "score", k)
    lists, near = [(text, text_weight)], None
    if vectors is not None and vector is not None:
        near = ranked(top_k(vectors, vector, k, params.similarity_threshold), "similarity", k)
        lists.append((near, vector_weight))
    fused = fuse(lists, params.rrf_k)
    fused = fused.join(near.select("id", "similarity"), "id", "left") if near is not None else fused.withColumn("similarity", F.lit(None).cast("double"))
    candidates = fused.select("id", normalised(F.col("rrf"), W.partitionBy(F.lit(1)), params).alias("rrf"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    question = F.lit(asks)
    few = candidates.collect()  # at most 2k rows; their ids reach the scan of the nodes
    candidates = nodes.sparkSession.createDataFrame(few, candidates.schema)
    joined = nodes.where(F.col("id").isin([r["id"] for r in few])).join(F.broadcast(candidates), "id")
    base = F.round(blended(F.col("rrf"), F.col("similarity"), F.length("content"), question, params), 9)
    kept = joined.withColumn("base", base).where(alive(now) & (filters if filters is not None else F.lit(True)))
    cut = kept.orderBy(F.desc("base"), "id").limit(limit)
    scored = cut.withColumn("score", final_score(F.col("base"), question, words(F.lit(query)), now, params))
    return scored.where(F.col("score") >= params.min_result_score).withColumn("source", F.lit("hybrid")).drop("rrf", "similarity", "base").orderBy(F.desc("score"), "id")


def by_space(results: DataFrame, space: str | None, params: Params = PARAMS) -> DataFrame:
    """Scores by where a memory belongs: the asked space, no space, or another."""
    factor = F.when(F.col("space").isNull(), params.global_space).when(F.col("space") == F.lit(space), 1.0).otherwise(params.other_space)
    return results.withColumn("score", F.round(F.col("score") * factor, 6)).orderBy(F.desc("score"), "id") if space else results


def with_recent(results: DataFrame, nodes: DataFrame, condition: Column, limit: int) -> DataFrame:
    """Results filled up to `limit` with the newest nodes that meet the condition, at a score of 0.001."""
    recent = nodes.where(condition).join(F.broadcast(results.select("id")), "id", "left_anti").orderBy(F.desc("created"), "id").limit(limit)
    order = F.row_number().over(W.orderBy(F.desc("created"), "id"))
    more = recent.withColumn("_n", order).crossJoin(F.broadcast(results.agg(F.count("*").alias("_have")))).where(F.col("_n") <= limit - F.col("_have"))
    return results.unionByName(more.withColumn("score", F.lit(0.001)).withColumn("source", F.lit("temporal")).drop("_n", "_have"))


def rerank(results: DataFrame, model_score: Column, params: Params = PARAMS) -> DataFrame:
    """Blend a cross-encoder's raw score, squashed to 0..1, with the score; drop what stays below the least."""
    s = params.rerank_alpha / (1 + F.exp(-model_score)) + (1 - params.rerank_alpha) * F.col("score")
    return results.withColumn("score", F.round(s, 6)).where(F.col("score") >= params.rerank_min).orderBy(F.desc("score"), "id")
