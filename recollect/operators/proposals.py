"""Proposals as an append-only log, folded to the latest state of each."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.operators import lifecycle
from recollect.sources.tables import upsert

COLUMNS = ["id", "type", "status", "source_nodes", "proposed_action", "reason", "created", "resolved"]


def current(log: DataFrame) -> DataFrame:
    """The last state of each proposal; a resolved one stays resolved, by its first resolution."""
    last = F.min_by(F.struct(*COLUMNS), F.struct(F.when(F.col("resolved").isNull(), 1).otherwise(0), "resolved", "status"))
    return log.groupBy("id").agg(last.alias("p")).select("p.*")


def pending(log: DataFrame) -> DataFrame:
    return current(log).where("status = 'pending'")


def propose(log: DataFrame, found: DataFrame, kind: str, now: Column, action: str) -> DataFrame:
    """New rows of the log, from pairs (keep, drop, score) of which no node stands in a pending proposal of the kind.

    A pair of which a proposal was resolved can be proposed again, under a new id, since ids hold the moment.
    """
    busy = pending(log).where(F.col("type") == kind).select(F.explode("source_nodes").alias("node")).distinct()
    p = found.select(F.col("keep").cast("string").alias("keep"), F.col("drop").cast("string").alias("drop"), "score")
    for side in ("keep", "drop"):
        p = p.join(busy.withColumnRenamed("node", side), side, "left_anti")
    key = F.sha2(F.concat_ws("|", F.lit(kind), "keep", "drop", now.cast("string")), 256)
    reason = F.concat(F.lit("score "), F.col("score").cast("string"))
    return p.select(key.alias("id"), F.lit(kind).alias("type"), F.lit("pending").alias("status"), F.array("keep", "drop").alias("source_nodes"), F.lit(action).alias("proposed_action"), reason.alias("reason"), now.alias("created"), F.lit(None).cast("timestamp").alias("resolved"))


def resolve(log: DataFrame, decisions: DataFrame, now: Column) -> DataFrame:
    """New rows of the log, from decisions (id, status: approved or rejected) on what is still pending.

    Decisions on anything else do nothing, so that resolving twice is resolving once. Of two decisions on one
    proposal rejection counts.
    """
    said = decisions.where(F.col("status").isin("approved", "rejected")).groupBy("id").agg(F.max("status").alias("said"))
    return pending(log).join(said, "id").withColumn("status", F.col("said")).withColumn("resolved", now).select(*COLUMNS)


def approved_pairs(resolved: DataFrame, kind: str, like: Column | str = "string") -> DataFrame:
    """(keep, drop) of approved proposals of two nodes; `like` is the nodes' id type."""
    two = resolved.where((F.col("status") == "approved") & (F.col("type") == kind) & (F.size("source_nodes") == 2))
    return two.select(F.col("source_nodes")[0].cast(like).alias("keep"), F.col("source_nodes")[1].cast(like).alias("drop"))


def apply(resolved: DataFrame, nodes: DataFrame, edges: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, history) after the approved rows of resolve(): merges are made, conflicts get an edge.

    Proposals whose nodes have gone since do nothing.
    """
    kind = dict(nodes.dtypes)["id"]
    known = nodes.select("id")
    there = lambda p: p.join(known.withColumnRenamed("id", "keep"), "keep", "left_semi").join(known.withColumnRenamed("id", "drop"), "drop", "left_semi")
    clash = there(approved_pairs(resolved, "conflict", kind)).select(F.col("keep").alias("source_id"), F.col("drop").alias("target_id"), F.lit("contradicts").alias("edge_type"), F.lit(0.5).alias("weight"), now.alias("created"))
    edges = upsert(edges, clash, "source_id", "target_id", "edge_type").select(*edges.columns)
    return lifecycle.merge(nodes, edges, there(approved_pairs(resolved, "merge", kind)), now)
