"""Maintenance: candidate batches, the jobs over them, and the order in which all run."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.model import PARAMS, Params
from recollect.operators import graph, lifecycle, pairs
from recollect.operators.vectors import knn
from recollect.sources.tables import staged, upsert

#: The order of a full pass.
ORDER = ("importance", "duplicates", "conflicts", "links", "spaces", "consolidation", "decay")


@dataclass
class Store:
    """The tables of a store, each a DataFrame; jobs return a new one."""

    nodes: DataFrame
    edges: DataFrame
    vectors: DataFrame
    checked: DataFrame | None = None
    history: list[DataFrame] = field(default_factory=list)


@dataclass
class Verdicts:
    """Judgements from outside on candidate pairs and clusters; without them a job leaves its candidates alone."""

    links: DataFrame | None = None  # a, b, link
    conflicts: DataFrame | None = None  # a, b, conflict, same_subject, kind
    duplicates: DataFrame | None = None  # a, b, same
    summaries: DataFrame | None = None  # seed, id, title, content


def batches(store: Store, params: Params = PARAMS, most: int | None = 8, most_clusters: int | None = 4, chars: int = 400) -> dict[str, DataFrame]:
    """The candidates for outside judgement, best first, with the beginnings of their contents.

    `most` and `most_clusters` are the size of a report; None gives all candidates.
    """
    nearest = staged(knn(store.vectors, 20), "nearest")  # once for all of them
    near, close = nearest.where("rank <= 15"), nearest.where("rank <= 6")
    found = {
        "links": pairs.link_candidates(close, store.nodes, store.edges, store.checked, params.link_threshold, params),
        "conflicts": pairs.conflict_candidates(near, store.nodes, store.edges, params.similarity_threshold),
        "duplicates": pairs.duplicate_candidates(close, store.nodes),
    }
    text = store.nodes.select("id", F.substring("content", 1, chars).alias("content"))
    out = {}
    for name, p in found.items():
        p = p.orderBy(F.desc("similarity"), "a", "b")
        p = p.limit(most) if most else p
        for s in "ab":
            p = p.join(text.select(F.col("id").alias(s), F.col("content").alias(f"content_{s}")), s)
        out[name] = p
    members = pairs.clusters(nearest, store.nodes)
    if most_clusters:
        members = members.join(members.groupBy("seed").count().orderBy(F.desc("count"), "seed").limit(most_clusters).select("seed"), "seed", "left_semi")
    return out | {"clusters": members.join(text, "id")}


def run_job(name: str, store: Store, verdicts: Verdicts, now: Column, params: Params = PARAMS) -> Store:
    """The store after one job."""
    n, e, v, c = store.nodes, store.edges, store.vectors, store.checked
    if name == "importance":
        new = graph.importance(n, e, now, params).where("changed").select("id", "importance")
        return Store(lifecycle.update(n, new, now), e, v, c, store.history)
    if name == "decay":
        return Store(lifecycle.moved(n, graph.decayed(n, now, params), "archival"), e, v, c, store.history)
    if name == "spaces":
        return Store(lifecycle.update(n, graph.space_votes(n, e).select("id", "space"), now), e, v, c, store.history)
    if name == "links" and verdicts.links is not None:
        found = pairs.link_candidates(knn(v, 6), n, e, c, params.link_threshold, params).orderBy(F.desc("similarity"), "a", "b").limit(params.max_links)
        edges, checked = lifecycle.verdict_edges(found, verdicts.links, now)
        return Store(n, e.unionByName(edges, allowMissingColumns=True), v, checked if c is None else upsert(c, checked, "node_a", "node_b"), store.history)
    if name == "conflicts" and verdicts.conflicts is not None:
        found = pairs.conflict_candidates(knn(v, 15), n, e, params.similarity_threshold)
        return Store(n, e.unionByName(lifecycle.conflict_edges(found, verdicts.conflicts, n, now), allowMissingColumns=True), v, c, store.history)
    if name == "duplicates" and verdicts.duplicates is not None:
        found = pairs.duplicate_candidates(knn(v, 6), n).join(verdicts.duplicates.where("same").select("a", "b"), ["a", "b"])
        plan = pairs.merge_plan(found, n, params.auto_merge).where("auto")
        nodes, edges, history = lifecycle.merge(n, e, plan, now)
        return Store(nodes, edges, v.join(nodes.select("id"), "id", "left_semi"), c, [*store.history, history])
    if name == "consolidation" and verdicts.summaries is not None:
        nodes, edges = lifecycle.consolidate(n, e, pairs.clusters(knn(v, 20), n), verdicts.summaries, now)
        return Store(nodes, edges, v, c, store.history)
    return store


def proposals(store: Store, duplicates: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Merges below the automatic score, as pending proposals (type, status, source_nodes, reason)."""
    plan = pairs.merge_plan(duplicates, store.nodes, params.auto_merge).where("NOT auto")
    return plan.select(F.lit("merge").alias("type"), F.lit("pending").alias("status"), F.array(F.col("keep").cast("string"), F.col("drop").cast("string")).alias("source_nodes"), F.concat(F.lit("score "), F.col("score").cast("string")).alias("reason"))


@dataclass
class Status:
    runs: int = 0
    errors: int = 0
    last_error: str | None = None
    last_run: float | None = None
    seconds: float = 0.0


def run_all(store: Store, verdicts: Verdicts, now: Column, params: Params = PARAMS, names: tuple[str, ...] = ORDER, save: Callable[[str, Store], Store] | None = None) -> tuple[Store, dict[str, Status]]:
    """All jobs in order and how each went; a job that fails leaves the store as it was.

    `save` writes the store after each job and returns it as read again, which cuts its lineage.
    """
    status = {n: Status() for n in names}
    for name in names:
        s, began = status[name], time.time()
        s.runs, s.last_run = s.runs + 1, began
        try:
            after = run_job(name, store, verdicts, now, params)
            store = save(name, after) if save else after
        except Exception as failure:  # noqa: BLE001  reported, as one job must not stop the others
            s.errors, s.last_error = s.errors + 1, str(failure)
        s.seconds = time.time() - began
    return store, status
