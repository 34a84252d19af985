"""Data model: enumerations, parameters, schemas, and the views of the driver's tables as a memory store."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import title
from recollect.operators.vectors import pairs_above

# The enumerations, in their order, and the weight factors of edge types.
NODE_TYPES = ["fact", "decision", "preference", "event", "person", "project", "concept", "procedure", "goal", "observation"]
TIERS = ["core", "working", "archival"]
EDGE_TYPES = ["related_to", "supports", "contradicts", "part_of", "derived_from", "preceded_by", "caused_by", "depends_on", "instance_of", "defines", "evolved_from"]
EDGE_FACTORS = {
    "supports": 1.0, "part_of": 1.0, "depends_on": 1.0, "defines": 1.0, "derived_from": 1.0, "evolved_from": 0.8,
    "related_to": 0.7, "instance_of": 0.7, "caused_by": 0.7, "preceded_by": 0.7, "contradicts": 0.4,
}
UNKNOWN_FACTOR = 0.5
BELIEF_TYPES = ["preference", "fact", "observation", "goal"]
ALWAYS_KEPT_TYPES = ["person", "preference"]

NODE_SCHEMA = (
    "id string, type string, tier string, source string, space string, title string, content string, created timestamp, updated timestamp, last_accessed timestamp, "
    "access_count bigint, confidence double, importance double, valid_until timestamp, stability double, last_review timestamp, tags array<string>, content_hash string"
)
EDGE_SCHEMA = "source_id string, target_id string, edge_type string, weight double, created timestamp, reason string"
PROPOSAL_SCHEMA = "id string, type string, status string, source_nodes array<string>, proposed_action string, reason string, created timestamp, resolved timestamp"
MERGE_SCHEMA = "id string, proposal_id string, kept_node_id string, removed_node_id string, removed_node_snapshot string, original_edges string, inserted_edges string, merged_at timestamp, undone_at timestamp"
CHECKED_SCHEMA = "node_a string, node_b string, result string, checked_at timestamp"
AUDIT_SCHEMA = "id bigint, operation string, node_id string, node_snapshot string, detail string, performed_at timestamp"


@dataclass(frozen=True)
class Params:
    """The numbers that are part of the queries' meaning."""

    fts_weight: float = 0.4
    vector_weight: float = 0.6
    similarity_threshold: float = 0.4
    rrf_k: int = 60
    similarity_blend: float = 0.5
    fts_only_dampening: float = 0.5
    min_result_score: float = 0.1
    min_spread_ratio: float = 0.05
    question_fts_scale: float = 0.3
    question_vector_scale: float = 1.5
    question_blend: float = 0.85
    title_boost: float = 2.0
    length_threshold: int = 300
    recency_weight: float = 0.05
    recency_half_life_days: float = 7.0
    access_weight: float = 0.05
    core_boost: float = 0.1
    archival_penalty: float = 0.1
    activation_decay: float = 0.5
    activation_seeds: int = 5
    activation_per_seed: int = 3
    link_threshold: float = 0.65
    cross_space_penalty: float = 0.1
    max_links: int = 500
    auto_merge: float = 0.85
    importance_access: float = 0.34
    importance_edges: float = 0.33
    importance_recency: float = 0.33
    access_reference: int = 50
    edge_reference: int = 20
    decay_importance: float = 0.5
    decay_retrievability: float = 0.3
    stability_growth: float = 1.5
    stability_cap: float = 365.0
    whisper_max: int = 8
    whisper_min_score: float = 0.45
    whisper_identity: int = 5
    injection_gate: float = 0.55
    rerank_min: float = 0.4
    rerank_alpha: float = 0.4
    rerank_chars: int = 512
    intent_threshold: float = 0.65
    topic_shift: float = 0.75
    content_budget: int = 1500
    content_least: int = 100
    content_most: int = 600
    buffer_prompts: int = 5
    buffer_gap_seconds: int = 600
    global_space: float = 1.0
    other_space: float = 0.6
    core_cap: int = 50
    context_cap: int = 20
    embed_chars: int = 512
    ingest_chars: int = 100_000
    #: BM25 weights of title, content and tags.
    field_weights: tuple[float, float, float] = (1.0, 5.0, 3.0)


PARAMS = Params()
#: The moment at which all queries over the driver's tables stand.
NOW = "2024-02-01 00:00:00"


def now() -> Column:
    return F.lit(NOW).cast("timestamp")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with their times as moments; they are stored as UTC without a zone."""
    e = table(spark, sf_dir, "events")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def days_between(later: Column, earlier: Column) -> Column:
    return (later.cast("double") - earlier.cast("double")) / 86400.0


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as memories; labels give confidence and expiry, events the accesses."""
    seen = events(spark, sf_dir).groupBy("user_id").agg(F.count("*").alias("n"), F.max("ts").alias("last"))
    base = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left")
    d = base.join(seen, base.doc_id == seen.user_id, "left")
    created = F.timestamp_seconds(F.lit(1704067200) + F.col("doc_id") * 60)
    accesses = F.coalesce("n", F.lit(0)).cast("bigint")
    return d.select(
        F.col("doc_id").alias("id"),
        F.element_at(F.array(*map(F.lit, NODE_TYPES)), (F.col("doc_id") % 10 + 1).cast("int")).alias("type"),
        F.when(F.col("doc_id") % 10 == 0, "core").when(F.col("doc_id") % 10 >= 8, "archival").otherwise("working").alias("tier"),
        F.col("source").alias("space"),
        title(F.col("text")).alias("title"),
        F.col("text").alias("content"),
        created.alias("created"),
        created.alias("updated"),
        F.coalesce("last", created).alias("last_accessed"),
        accesses.alias("access_count"),
        F.when(F.col("quality") == 1, 1.0).when(F.col("quality") == 0, 0.5).otherwise(0.8).alias("confidence"),
        F.round((F.col("doc_id") % 17) / 16.0, 4).alias("importance"),
        F.when(F.col("toxic") == 1, F.lit("2024-01-15 00:00:00").cast("timestamp")).alias("valid_until"),
        F.least(F.lit(30.0), F.greatest(F.lit(1.0), accesses * 2.0)).alias("stability"),
        F.when(F.col("doc_id") % 7 == 0, F.array("lang", F.lit("about_self"))).otherwise(F.array("lang")).alias("tags"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), "embedding")


def edges(spark: SparkSession, sf_dir: str, threshold: float = 0.30, among: DataFrame | None = None) -> DataFrame:
    """Similar vectors as typed edges, from the smaller id to the larger; where given, those between ids of `among`."""
    v = vectors(spark, sf_dir)
    pairs = pairs_above(v if among is None else v.join(among.select("id"), "id", "left_semi"), threshold)
    kind = F.element_at(F.array(*map(F.lit, EDGE_TYPES)), ((F.col("a") + F.col("b")) % 11 + 1).cast("int"))
    return pairs.select(F.col("a").alias("source_id"), F.col("b").alias("target_id"), kind.alias("edge_type"), F.round("similarity", 3).alias("weight"), F.timestamp_seconds(F.lit(1704067200) + F.col("b") * 60).alias("created"))
