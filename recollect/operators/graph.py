"""Graph operators: neighbours, spreading activation, centrality, importance, decay and votes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from recollect.model import EDGE_FACTORS, PARAMS, UNKNOWN_FACTOR, Params, days_between


def both_ways(edges: DataFrame) -> DataFrame:
    """Each edge in either direction: (id, other, edge_type, weight)."""
    a = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "edge_type", "weight")
    return a.union(edges.select("target_id", "source_id", "edge_type", "weight"))


def neighbours(edges: DataFrame, start: DataFrame, depth: int = 1, edge_types: list[str] | None = None) -> DataFrame:
    """(start, id, hops): what lies within `depth` edges of each start (column id), by the fewest hops.

    One equi-join a hop over both directions of the edges; each hop drops what an earlier one reached.
    """
    linked = both_ways(edges.where(F.col("edge_type").isin(*edge_types)) if edge_types else edges).select(F.col("id").alias("at"), "other").distinct()
    seen = start.select(F.col("id").alias("start"), "id", F.lit(0).alias("hops")).distinct()
    frontier = seen
    for hop in range(1, depth + 1):
        step = frontier.join(linked, frontier.id == linked.at).select("start", F.col("other").alias("id")).distinct()
        frontier = step.join(seen, ["start", "id"], "left_anti").withColumn("hops", F.lit(hop))
        seen = seen.unionByName(frontier)
    return seen.where("hops > 0")


def factor(edge_type: Column) -> Column:
    pairs = [F.lit(x) for item in EDGE_FACTORS.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), edge_type), F.lit(UNKNOWN_FACTOR))


def activate(results: DataFrame, edges: DataFrame, nodes: DataFrame, params: Params = PARAMS) -> DataFrame:
    """Results (id, score, source) and the neighbours their best rows activate.

    Each of the first `activation_seeds` rows activates its `activation_per_seed` strongest neighbours that
    are no results themselves; a neighbour keeps its strongest activation. Adds activated_by, activation_edge.
    """
    seeds = results.orderBy(F.desc("score"), "id").limit(params.activation_seeds).select(F.col("id").alias("seed"), F.col("score").alias("seed_score"))
    met = both_ways(edges).join(F.broadcast(seeds), F.col("id") == F.col("seed")).select("seed", F.col("other").alias("id"), "edge_type", (F.col("seed_score") * F.col("weight") * factor(F.col("edge_type")) * params.activation_decay).alias("score"))
    fresh = met.join(F.broadcast(results.select("id")), "id", "left_anti").withColumn("score", F.round("score", 6))
    order = F.row_number().over(W.partitionBy("seed").orderBy(F.desc("score"), "id", "edge_type"))
    strongest = fresh.withColumn("_r", order).where(F.col("_r") <= params.activation_per_seed)
    best = strongest.groupBy("id").agg(F.max(F.struct("score", F.struct((-F.col("seed")).alias("s"), "edge_type").alias("by"))).alias("m"))
    found = best.select("id", F.col("m.score").alias("score"), (-F.col("m.by.s")).alias("activated_by"), F.col("m.by.edge_type").alias("activation_edge"))
    found = found.join(nodes.select("id"), "id", "left_semi").withColumn("source", F.when(F.col("activation_edge") == "contradicts", "conflict").otherwise("activated"))
    none = F.lit(None)
    direct = results.select("id", "score", "source", none.cast(found.schema["activated_by"].dataType).alias("activated_by"), none.cast("string").alias("activation_edge"))
    return direct.unionByName(found).orderBy(F.desc("score"), "id")


def degree(edges: DataFrame) -> DataFrame:
    """(id, degree): edges at either end; a loop counts twice. Summed before the shuffle."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def retrievability(now: Column, anchor: Column, stability: Column, least_days: float = 0.0) -> Column:
    s = F.when(stability.isNull() | (stability == 0), 1.0).otherwise(stability)
    return F.exp(-F.greatest(days_between(now, anchor), F.lit(least_days)) / s)


def importance(nodes: DataFrame, edges: DataFrame, now: Column, params: Params = PARAMS) -> DataFrame:
    """(id, old, importance) from accesses, centrality and recency; `changed` where it moves by 0.01 or more."""
    d = nodes.join(degree(edges), "id", "left")
    access = F.least(F.lit(1.0), F.log1p(F.coalesce("access_count", F.lit(0)).cast("double")) / F.log1p(F.lit(float(params.access_reference))))
    edge = F.least(F.lit(1.0), F.log1p(F.coalesce("degree", F.lit(0)).cast("double")) / F.log1p(F.lit(float(params.edge_reference))))
    anchor = F.coalesce("last_review", "last_accessed") if "last_review" in nodes.columns else F.col("last_accessed")
    recency = F.coalesce(retrievability(now, anchor, F.col("stability")), F.lit(0.0))
    total = params.importance_access + params.importance_edges + params.importance_recency
    raw = (params.importance_access * access + params.importance_edges * edge + params.importance_recency * recency) / total
    new = F.greatest(F.lit(0.0), F.least(F.lit(1.0), raw))
    old = F.coalesce("importance", F.lit(0.5))
    return d.select("id", old.alias("old"), F.round(new, 4).alias("importance"), (F.round(F.abs(new - old), 9) >= 0.01).alias("changed"))


def decayed(nodes: DataFrame, now: Column, params: Params = PARAMS, keep: Column | None = None) -> DataFrame:
    """Working nodes of little importance that have faded: (id, retrievability); they go to the archive."""
    anchor = F.coalesce("last_review", "last_accessed") if "last_review" in nodes.columns else F.col("last_accessed")
    r = F.round(retrievability(now, anchor, F.col("stability"), 0.001), 6)
    spare = F.lit(True) if keep is None else ~keep
    return nodes.where((F.col("tier") == "working") & (F.col("importance") < params.decay_importance) & spare).select("id", r.alias("retrievability")).where(F.col("retrievability") < params.decay_retrievability)


def touched(stability: Column, days: Column, params: Params = PARAMS) -> Column:
    """Stability after an access `days` after the one before."""
    s = F.when(stability.isNull() | (stability == 0), 1.0).otherwise(stability)
    r = F.exp(-F.greatest(days, F.lit(0.001)) / s)
    return F.round(F.least(F.lit(params.stability_cap), s * params.stability_growth * F.pow(r, F.lit(-0.2))), 2)


def fold_touches(events: DataFrame, params: Params = PARAMS, start: float = 1.0) -> DataFrame:
    """(id, accesses, stability, last) after all accesses of each id (columns id, ts), in their order.

    The first access only sets the clock. The touches do not commute, so a fold over the sorted list of an
    id's times stands for them.
    """
    times = events.groupBy("id").agg(F.array_sort(F.collect_list("ts")).alias("times"))
    begin = F.struct(F.lit(start).alias("s"), F.col("times")[0].alias("last"))
    out = F.aggregate(F.slice("times", 2, F.greatest(F.size("times"), F.lit(1))), begin, lambda a, t: F.struct(touched(a["s"], days_between(t, a["last"]), params).alias("s"), t.alias("last")))
    return times.select("id", F.size("times").cast("bigint").alias("accesses"), out.alias("o")).select("id", "accesses", F.col("o.s").alias("stability"), F.col("o.last").alias("last"))


def unassigned(space: Column) -> Column:
    return space.isNull() | (space == "")


def space_votes(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, space, votes): for each node without a space, that of most neighbours; ties to the first by name."""
    lone = nodes.where(unassigned(F.col("space"))).select("id")
    spaces = nodes.where(~unassigned(F.col("space"))).select(F.col("id").alias("other"), "space")
    votes = both_ways(edges).select("id", "other").join(lone, "id", "left_semi").join(spaces, "other").groupBy("id", "space").agg(F.count("*").alias("votes"))
    order = F.row_number().over(W.partitionBy("id").orderBy(F.desc("votes"), "space"))
    return votes.withColumn("_r", order).where("_r = 1").drop("_r")


def majority(groups: DataFrame, key: str, value: str) -> DataFrame:
    """(key, value): the commonest value of each group, null among them; ties to the first, nulls last."""
    n = groups.groupBy(key, value).agg(F.count("*").alias("n"))
    order = F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), F.asc_nulls_last(value)))
    return n.withColumn("_r", order).where("_r = 1").select(key, value)
