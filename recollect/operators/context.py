"""Prompt-time context: intents, gates, the whisper pipeline and the core context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.temporal import window, without_phrases
from recollect.functions.text import first_sentence
from recollect.model import ALWAYS_KEPT_TYPES, PARAMS, Params
from recollect.operators.search import alive
from recollect.operators.vectors import dot

CONVERSATION_MARGIN = 0.15


def category_scores(prompts: DataFrame, archetypes: DataFrame) -> DataFrame:
    """(id, category, score): each prompt's greatest similarity to the archetypes (category, embedding) of a category.

    The archetypes are a fixed list of a few dozen rows, which is broadcast.
    """
    a = F.broadcast(archetypes.select("category", F.col("embedding").alias("archetype")))
    return prompts.crossJoin(a).groupBy("id", "category").agg(F.round(F.max(dot(F.col("embedding"), F.col("archetype"))), 6).alias("score"))


def intents(scores: DataFrame, threshold: float = PARAMS.intent_threshold) -> DataFrame:
    """(id, categories): what reaches the threshold, sorted; 'general' if nothing does.

    'conversational' gives way to another category within the margin, and else stands alone; 'continuation'
    gives way to 'identity'.
    """
    m = F.map_from_entries(F.sort_array(F.collect_list(F.struct("category", "score"))))
    each = scores.groupBy("id").agg(m.alias("m")).withColumn("hit", F.map_filter("m", lambda _, s: s >= threshold))
    talk = F.element_at("m", F.lit("conversational"))
    others = F.map_filter("hit", lambda c, _: c != "conversational")
    strong = F.size(F.map_filter(others, lambda _, s: s >= talk - CONVERSATION_MARGIN)) > 0
    kept = F.when(F.map_contains_key("hit", "conversational") & (F.size(others) > 0), F.when(strong, F.map_keys(others)).otherwise(F.array(F.lit("conversational")))).otherwise(F.map_keys("hit"))
    out = each.select("id", kept.alias("c"))
    named = F.when(F.array_contains("c", "identity"), F.array_remove("c", "continuation")).otherwise(F.col("c"))
    return out.select("id", F.when(F.size(named) == 0, F.array(F.lit("general"))).otherwise(F.array_sort(named)).alias("categories"))


def search_plan(prompts: DataFrame, now: Column) -> DataFrame:
    """Prompts (id, prompt, categories) with the window and the query that their search takes."""
    timed, w = F.array_contains("categories", "temporal"), window(F.col("prompt"), now)
    goes_on = F.array_contains("categories", "continuation")
    return prompts.select(
        "*", F.when(timed, w["after"]).when(goes_on, now - F.expr("INTERVAL 3 DAYS")).alias("created_after"), F.when(timed, w["before"]).alias("created_before"),
        F.when(timed, without_phrases(F.col("prompt"))).otherwise(F.col("prompt")).alias("query"),
    )


def session_buffers(prompts: DataFrame, most: int = PARAMS.buffer_prompts, gap: int = PARAMS.buffer_gap_seconds) -> DataFrame:
    """Prompts (session, ts, id) with the ids of the last `most` before each that are at most `gap` seconds old."""
    before = W.partitionBy("session").orderBy("ts", "id").rowsBetween(-most, -1)
    held = F.collect_list(F.struct("ts", "id")).over(before)
    recent = F.filter(held, lambda p: F.col("ts").cast("double") - p["ts"].cast("double") <= gap)
    return prompts.withColumn("buffer", F.transform(recent, lambda p: p["id"]))


def every_nth(prompts: DataFrame, n: int = 10) -> DataFrame:
    """The prompts of each session at which a multiple of n is reached."""
    order = F.row_number().over(W.partitionBy("session").orderBy("ts", "id"))
    return prompts.withColumn("number", order).where(F.col("number") % n == 0)


def topic_shift(prompts: DataFrame, last: int = 3, threshold: float = PARAMS.topic_shift) -> DataFrame:
    """Prompts (session, ts, id, embedding) with their similarity to the mean of the session's last ones.

    `same_topic` marks those above the threshold, for which nothing is put forward. A session's first prompt
    has no similarity.
    """
    before = W.partitionBy("session").orderBy("ts", "id").rowsBetween(-last, -1)
    held = prompts.withColumn("_held", F.collect_list("embedding").over(before))
    size = F.size("_held")
    each = F.transform("embedding", lambda _, i: F.aggregate("_held", F.lit(0.0), lambda s, v: s + v[i].cast("double")) / size)
    c = held.withColumn("_mean", F.when(size > 0, each)).withColumn("similarity", F.round(dot(F.col("embedding"), F.col("_mean")) / F.sqrt(dot(F.col("_mean"), F.col("_mean")) * dot(F.col("embedding"), F.col("embedding"))), 6))
    return c.select("session", "ts", "id", "similarity", F.coalesce(F.col("similarity") > threshold, F.lit(False)).alias("same_topic"))


def identity_ids(nodes: DataFrame, edges: DataFrame, self_id) -> DataFrame:
    """(id): the user's own node, what it defines, and what is tagged about_self."""
    own = nodes.where(F.col("id") == self_id).select("id")
    defined = edges.where((F.col("source_id") == self_id) & (F.col("edge_type") == "defines")).select(F.col("target_id").alias("id"))
    return own.union(defined).union(nodes.where(F.array_contains("tags", "about_self")).select("id")).distinct()


def content_limit(count: Column, params: Params = PARAMS) -> Column:
    """Characters for each of `count` memories."""
    return F.least(F.lit(params.content_most), F.greatest(F.lit(params.content_least), F.floor(params.content_budget / count))).cast("int")


def whisper(results: DataFrame, nodes: DataFrame, identities: DataFrame, temporal: bool = False, identity_only: bool = False, defined: DataFrame | None = None, params: Params = PARAMS) -> DataFrame:
    """whisper_all for one prompt's results (id, score, source): section, place, id, type, score, content."""
    one = results.sparkSession.createDataFrame([(0, temporal, identity_only)], "prompt_id int, temporal boolean, identity_only boolean")
    return whisper_all(results.withColumn("prompt_id", F.lit(0)), one, nodes, identities, defined, params).drop("prompt_id")


def whisper_all(results: DataFrame, prompts: DataFrame, nodes: DataFrame, identities: DataFrame, defined: DataFrame | None = None, params: Params = PARAMS) -> DataFrame:
    """What to put before each prompt (prompt_id, temporal, identity_only), from its results (prompt_id, id, score,
    source): prompt_id, section, place, id, type, score, content.

    Results below the least score go, unless they only fill up by time; without a time intent the gate drops
    all below it. Identity memories come first, persons and preferences always, the others up to a few; the
    rest share what is left. Identity hits alone need the least score themselves. For prompts about identity
    without a hit, `defined` nodes stand in. A prompt's windows hold its results, tens of rows.
    """
    timed, least = F.col("temporal"), params.whisper_min_score
    r = results.select("prompt_id", "id", "score", "source").join(prompts.select("prompt_id", "temporal", "identity_only"), "prompt_id")
    r = r.where((F.col("score") >= F.when(timed, min(0.30, least)).otherwise(least)) | (F.col("source") == "temporal")).where(timed | (F.col("score") >= params.injection_gate))
    facts = ["type", "tier", "created", "content"]
    d = r.join(nodes.select("id", *facts), "id").join(identities.select("id", F.lit(True).alias("_own")), "id", "left").withColumn("own", F.coalesce("_own", F.lit(False))).drop("_own")
    everything = W.partitionBy("prompt_id")
    topical, best_own = F.max((~F.col("own")).cast("int")).over(everything), F.max(F.when(F.col("own"), F.col("score"))).over(everything)
    d = d.withColumn("_t", topical).withColumn("_b", best_own).where(F.col("identity_only") | (F.col("_t") == 1) | (F.col("_b") >= least)).drop("_t", "_b")
    if defined is not None:
        bare = prompts.where("identity_only").select("prompt_id", "temporal", "identity_only").join(d.where("own").select("prompt_id").distinct(), "prompt_id", "left_anti")
        stand_in = defined.select("id", *facts).withColumns({"score": F.lit(0.0), "source": F.lit("identity"), "own": F.lit(True), "identity_only": F.lit(True)})
        d = d.unionByName(stand_in.join(bare, "identity_only").select(*d.columns))
    moment = F.when(timed, F.col("created"))
    order = [moment.desc(), F.when(timed, 0.0).otherwise(F.col("score")).desc(), "id"]
    always = F.col("own") & F.col("type").isin(*ALWAYS_KEPT_TYPES)
    d = d.withColumn("_k", F.when(always, 0).when(F.col("own"), 1).otherwise(2))
    d = d.withColumn("_n", F.row_number().over(W.partitionBy("prompt_id", "_k").orderBy(*order))).withColumn("_always", F.sum((F.col("_k") == 0).cast("int")).over(everything))
    d = d.where((F.col("_k") != 1) | (F.col("_n") <= F.greatest(F.lit(params.whisper_identity) - F.col("_always"), F.lit(0))))
    d = d.withColumn("_own_n", F.sum((F.col("_k") < 2).cast("int")).over(everything))
    d = d.where((F.col("_k") < 2) | (F.col("_n") <= F.greatest(F.lit(params.whisper_max) - F.col("_own_n"), F.lit(0))))
    limit = content_limit(F.count("*").over(everything), params)
    section = F.when(F.col("_k") < 2, "identity").when(F.col("tier") == "core", "core").otherwise("working")
    place = F.row_number().over(W.partitionBy("prompt_id", "section").orderBy("_k", "_n"))
    return d.withColumn("_l", limit).withColumn("section", section).withColumn("place", place).select("prompt_id", "section", "place", "id", "type", "score", first_sentence(F.col("content"), F.col("_l")).alias("content"))


def by_space_and_importance(nodes: DataFrame, space: str | None, cap: int = PARAMS.context_cap) -> DataFrame:
    """(bucket, id, importance): core nodes of the space, of none, of others, then working nodes of the space.

    The cap falls on that order. It is a top-k, not a sort of all nodes.
    """
    core = F.when(F.col("space") == F.lit(space), 0).when(F.col("space").isNull(), 1).otherwise(2)
    bucket = F.when(F.col("tier") == "core", core).when((F.col("tier") == "working") & (F.col("space") == F.lit(space)), 3)
    return nodes.select(bucket.alias("bucket"), "id", "importance").where("bucket is not null").orderBy("bucket", F.desc("importance"), "id").limit(cap)


def hint_scores(nodes: DataFrame, vectors: DataFrame, hint: list[float], k: int) -> DataFrame:
    """(id, score): similarity to a hint and importance, .7 and .3; no vector counts as no similarity."""
    s = dot(F.col("embedding"), F.array(*map(F.lit, map(float, hint))))
    d = nodes.join(vectors.select("id", "embedding"), "id", "left")
    weight = F.when(F.coalesce("importance", F.lit(0.0)) == 0, 0.5).otherwise(F.col("importance"))
    return d.select("id", F.round(0.7 * F.coalesce(s, F.lit(0.0)) + 0.3 * weight, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def core_context(nodes: DataFrame, edges: DataFrame, self_id, space: str | None, now: Column, cap: int = PARAMS.context_cap) -> DataFrame:
    """(section, id, title, importance): identity, then core and working memories under the cap.

    Nodes whose id or title an identity memory has are left out of the other sections.
    """
    live = nodes.where(alive(now) & F.col("tier").isin("core", "working"))
    own = live.join(identity_ids(nodes, edges, self_id), "id", "left_semi").where("tier = 'core'")
    rest = live.join(own.select("id"), "id", "left_anti").join(own.select("title").where("title is not null").distinct(), "title", "left_anti")
    picked = by_space_and_importance(rest, space, cap).join(rest.select("id", "title", "tier"), "id")
    return own.select(F.lit("identity").alias("section"), "id", "title", "importance").union(picked.select(F.col("tier").alias("section"), "id", "title", "importance"))


def node_text(heading: Column, kind: Column, tier: Column, content: Column) -> Column:
    """A memory as a paragraph."""
    return F.concat(F.lit("**"), F.coalesce(heading, F.lit("Untitled")), F.lit("** ["), kind, F.lit("/"), tier, F.lit("]\n"), content)


def formatted(rows: DataFrame, sections: list[str]) -> DataFrame:
    """One row of text: a heading for each section and its memories in order. For results, not for whole tables."""
    order = F.array_position(F.array(*map(F.lit, sections)), F.col("section"))
    lines = rows.withColumn("_s", order).groupBy("_s", "section").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("place", "content"))), lambda x: F.concat(F.lit("- "), x["content"])), "\n").alias("body"))
    return lines.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_s", F.concat(F.lit("## "), "section", F.lit("\n"), "body").alias("t")))), lambda x: x["t"]), "\n\n").alias("text"))
