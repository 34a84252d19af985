"""Remembering: links of new memories, and memories that a model found in conversations."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.functions.text import json_part, strip, title
from recollect.model import NODE_TYPES, PARAMS, Params
from recollect.operators.pairs import ROUNDS, SETTLED, unlinked
from recollect.operators.vectors import nearest_before, pairs_above
from recollect.sources.tables import staged

#: Shortest conversation, in characters without white space at its ends, that is asked about.
LEAST_CHARS = 50
#: How deep `memories` may stand inside `memories`.
DEEPEST = 4
ITEM = "content string, type string, title string, tags array<string>, about_self boolean, confidence double"


def links_on_remember(new: DataFrame, nodes: DataFrame, vectors: DataFrame | None, edges: DataFrame, now: Column, threshold: float = PARAMS.link_threshold, k: int = 6, params: Params = PARAMS) -> DataFrame:
    """Edges (source_id, target_id, edge_type, weight, created) that new memories (id, embedding, place) get.

    Each is linked to its k nearest among the stored vectors and the new memories of a smaller place, if the
    similarity, less a penalty across spaces, reaches the threshold and no edge joins the two. Remembering in
    portions gives the edges of remembering all at once.
    """
    near = nearest_before(new, vectors, k)
    for side in ("id", "other"):
        near = near.join(nodes.select(F.col("id").alias(side), F.coalesce("space", F.lit("")).alias(f"space_{side}")), side)
    scored = near.withColumn("similarity", F.round(F.col("similarity") - F.when(F.col("space_id") != F.col("space_other"), params.cross_space_penalty).otherwise(0.0), 6))
    fit = scored.where(F.col("similarity") >= threshold).select("id", "other", "similarity", F.least("id", "other").alias("a"), F.greatest("id", "other").alias("b"))
    return unlinked(fit, edges).select(F.col("id").alias("source_id"), F.col("other").alias("target_id"), F.lit("related_to").alias("edge_type"), F.round("similarity", 3).alias("weight"), now.alias("created"))


def memories_in(answers: DataFrame, extra_tags: list[str] | None = None) -> DataFrame:
    """(conv_id, item, content, title, type, tags, about_self, confidence) from models' answers (conv_id, content, answer).

    Answers may stand in prose or fences; a list stands alone or below `memories`, up to four deep. What is no object
    or has no content is left out; unknown types are facts, missing titles come from the content, confidence is
    0.7 unless given. `item` is the place in the answer's list. Short conversations and unreadable answers give none.
    """
    found = answers.where(F.length(strip(F.col("content"))) >= LEAST_CHARS).select("conv_id", json_part(F.col("answer")).alias("j"))
    for _ in range(DEEPEST):
        found = found.select("conv_id", F.coalesce(F.get_json_object("j", "$.memories"), "j").alias("j"))
    items = found.where(F.col("j").startswith("[")).select("conv_id", F.posexplode(F.from_json("j", "array<string>")).alias("item", "m"))
    m = items.where(F.col("m").startswith("{")).select("conv_id", "item", F.from_json("m", ITEM).alias("m")).select("conv_id", "item", "m.*")
    content = strip(F.coalesce("content", F.lit("")))
    kind = F.when(F.col("type").isin(*NODE_TYPES), F.col("type")).otherwise("fact")
    heading = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(title(content))
    tags = F.concat(F.coalesce("tags", F.array().cast("array<string>")), F.array(*map(F.lit, ["auto-ingested", *(extra_tags or [])])))
    return m.where(content != "").select("conv_id", "item", content.alias("content"), heading.alias("title"), kind.alias("type"), tags.alias("tags"), F.coalesce("about_self", F.lit(False)).alias("about_self"), F.coalesce("confidence", F.lit(0.7)).alias("confidence"))


def first_taken(items: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(id): items (id, place) taken in order of place, unless they conflict (a, b: ids) with one taken before.

    In each round an item without an undecided earlier neighbour is taken and its later neighbours go; after a
    few rounds a leftover of bounded size is settled in order in one task.
    """
    kind = dict(items.dtypes)["id"]
    place = items.select("id", "place")
    e = conflicts.join(place.toDF("a", "pa"), "a").join(place.toDF("b", "pb"), "b").where("pa != pb")
    first = F.col("pa") < F.col("pb")
    e = staged(e.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("early"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("late"), F.greatest("pa", "pb").alias("place")).distinct(), "conflicts")

    def settle(x: pd.DataFrame) -> pd.DataFrame:
        gone: set = set()
        for _, late, early in sorted(x.groupby(["place", "late"])["early"].apply(list).reset_index().itertuples(index=False, name=None), key=lambda r: r[0]):
            if any(i not in gone for i in early):
                gone.add(late)
        return pd.DataFrame({"id": sorted(gone)})

    dropped: list[DataFrame] = []
    while n := e.count():
        if len(dropped) >= ROUNDS and n <= SETTLED:
            dropped.append(staged(e.groupBy().applyInPandas(settle, f"id {kind}"), "dropped"))
            break
        free = e.select(F.col("early").alias("id")).distinct().join(e.select(F.col("late").alias("id")).distinct(), "id", "left_anti")
        gone = staged(e.join(free.withColumnRenamed("id", "early"), "early", "left_semi").select(F.col("late").alias("id")).distinct(), "dropped")
        dropped.append(gone)
        e = staged(e.join(gone.withColumnRenamed("id", "late"), "late", "left_anti").join(gone.withColumnRenamed("id", "early"), "early", "left_anti").join(free.withColumnRenamed("id", "early"), "early", "left_anti"), "conflicts")
    return items.select("id").join(reduce(DataFrame.unionByName, dropped), "id", "left_anti") if dropped else items.select("id")


def new_memories(items: DataFrame, stored: DataFrame | None, threshold: float = PARAMS.auto_merge) -> DataFrame:
    """(id): items (id, place, embedding) that are like no stored vector and none taken before them.

    The store is met by the items alone; among the items only pairs that reach the threshold are formed into rows.
    An item without an embedding is new.
    """
    known = items.where("embedding is not null")
    if stored is not None:
        at_once = known.select("id", "embedding", F.lit(0).alias("place"))  # none of them is before another
        seen = nearest_before(at_once, stored.select(F.lit("0").cast(dict(items.dtypes)["id"]).alias("id"), "embedding"), 1).where(F.col("similarity") >= threshold).select("id")
        items = staged(items.join(seen, "id", "left_anti"), "unseen")
        known = items.where("embedding is not null")
    return first_taken(items, pairs_above(known.select("id", "embedding"), threshold).select("a", "b"))
