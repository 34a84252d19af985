"""Nodes by id or by the beginning of an id; and what came of which file."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Ids of this length are whole; shorter ones may be beginnings.
WHOLE = 36


def write_sorted(rows: DataFrame, path: str, files: int, key: str = "id") -> None:
    """rows by ranges of the key, with a table of each file's least and greatest key beside them."""
    rows.repartitionByRange(files, key).sortWithinPartitions(key).write.parquet(f"{path}/rows")
    stored = rows.sparkSession.read.schema(rows.schema).parquet(f"{path}/rows")
    ends = stored.select(F.input_file_name().alias("file"), key).groupBy("file").agg(F.min(key).alias("low"), F.max(key).alias("high"))
    ends.coalesce(1).write.parquet(f"{path}/files")


def read_by_prefix(spark: SparkSession, path: str, prefixes: list[str], key: str = "id") -> DataFrame:
    """The rows whose key begins with one of the prefixes, from the files that can hold such keys alone."""
    ends = spark.read.parquet(f"{path}/files")
    may = [(F.col("low").cast("string") <= F.lit(p + "\U0010ffff")) & (F.col("high").cast("string") >= F.lit(p)) for p in prefixes]
    files = [r["file"] for r in ends.where(reduce(Column.__or__, may, F.lit(False))).collect()]  # as many as the prefixes meet
    schema = spark.read.parquet(f"{path}/rows").schema
    if not files:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(*files).where(reduce(Column.__or__, [F.col(key).startswith(p) for p in prefixes]))


def resolved_ids(asked: DataFrame, rows: DataFrame, key: str = "id") -> DataFrame:
    """(asked, id): the row of each asked id, or, for a short one that is no id, the least id that begins with it.

    Beginnings meet the rows by equality, once for each length that occurs, at most WHOLE - 1. An empty or null
    asked id finds nothing.
    """
    a = asked.select(F.col(asked.columns[0]).alias("asked")).where("asked != ''").distinct()
    ids = rows.select(F.col(key).alias("id"))
    exact = a.join(ids, F.col("asked") == F.col("id"), "left_semi").select("asked", F.col("asked").alias("id"))
    short = a.where(F.length("asked") < WHOLE).join(exact.select("asked"), "asked", "left_anti")
    sizes = sorted(r[0] for r in short.select(F.length("asked")).distinct().collect())
    found = [short.where(F.length("asked") == n).join(ids.select(F.substring("id", 1, n).alias("asked"), "id"), "asked").groupBy("asked").agg(F.min("id").alias("id")) for n in sizes]
    return reduce(DataFrame.unionByName, found, exact)


def recall_nodes(asked: DataFrame, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(asked, id, title, content, neighbours): each asked node with its edges either way, by the other's id.

    `neighbours` holds other, edge_type, weight and the other's title; a node without edges has none.
    """
    found = resolved_ids(asked, nodes)
    out = edges.select(F.col("source_id").alias("id"), F.col("target_id").alias("other"), "edge_type", "weight")
    both = out.union(edges.select("target_id", "source_id", "edge_type", "weight")).join(found.select("id").distinct(), "id", "left_semi")
    named = both.join(nodes.select(F.col("id").alias("other"), F.col("title").alias("other_title")), "other")
    near = named.groupBy("id").agg(F.array_sort(F.collect_set(F.struct("other", "edge_type", "weight", "other_title"))).alias("neighbours"))
    whole = found.join(nodes.select("id", "title", "content"), "id").join(near, "id", "left")
    kind = near.schema["neighbours"].dataType
    return whole.select("asked", "id", "title", "content", F.coalesce("neighbours", F.array().cast(kind)).alias("neighbours"))


def self_profile(nodes: DataFrame, edges: DataFrame, self_id) -> DataFrame:
    """The nodes that the user's own node defines or that define it."""
    e = edges.where("edge_type = 'defines'")
    ids = e.where(F.col("source_id") == self_id).select(F.col("target_id").alias("id")).union(e.where(F.col("target_id") == self_id).select("source_id"))
    return nodes.join(ids.where(F.col("id") != self_id).distinct(), "id", "left_semi")


# Versions of files: one row for each time a path was read or found gone


def recorded(log: DataFrame, read: DataFrame, version: int) -> DataFrame:
    """The log (path, version, content_hash, node_ids, deleted) with the paths read (path, content_hash, node_ids) now."""
    return log.unionByName(read.select("path", F.lit(version).cast("int").alias("version"), "content_hash", "node_ids", F.lit(False).alias("deleted")))


def removed(log: DataFrame, listed: DataFrame, version: int) -> DataFrame:
    """The log with a tombstone for each live path that a listing (path) lacks."""
    gone = live(log).join(listed.select("path"), "path", "left_anti")
    return log.unionByName(gone.select("path", F.lit(version).cast("int").alias("version"), "content_hash", F.array().cast("array<string>").alias("node_ids"), F.lit(True).alias("deleted")))


def restored(log: DataFrame, paths: DataFrame, version: int) -> DataFrame:
    """The log with the last content of the given deleted paths (path) live again."""
    last = _last(log).where("deleted").join(paths.select("path"), "path", "left_semi")
    return log.unionByName(last.select("path", F.lit(version).cast("int").alias("version"), "content_hash", F.array().cast("array<string>").alias("node_ids"), F.lit(False).alias("deleted")))


def _last(log: DataFrame) -> DataFrame:
    return log.groupBy("path").agg(F.max_by(F.struct("content_hash", "deleted"), "version").alias("s")).select("path", "s.*")


def live(log: DataFrame) -> DataFrame:
    """(path, content_hash) of the paths that are there."""
    return _last(log).where("not deleted").select("path", "content_hash")


def provenance(log: DataFrame) -> DataFrame:
    """(path, node_ids): all nodes that came of any version of each path, whether it is there or not."""
    return log.groupBy("path").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("node_ids")))).alias("node_ids"))


def soft_deleted(nodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """Nodes with deleted_at set for those of ids that have none."""
    base = nodes if "deleted_at" in nodes.columns else nodes.withColumn("deleted_at", F.lit(None).cast("timestamp"))
    hit = base.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.coalesce("deleted_at", F.when(F.col("_hit"), now))).select(*base.columns)


def undeleted(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    hit = nodes.join(ids.select("id").distinct().withColumn("_hit", F.lit(True)), "id", "left")
    return hit.withColumn("deleted_at", F.when(F.col("_hit").isNull(), F.col("deleted_at"))).select(*nodes.columns)


def visible(nodes: DataFrame) -> DataFrame:
    return nodes.where("deleted_at is null")
