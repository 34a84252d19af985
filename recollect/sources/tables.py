"""Tables in the shared folder: staging, upserts and differences."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import content_hash


#: The local folder taken where spark.checkpoint.dir is unset.
_OWN: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, whose files go when the application ends."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not folder and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="recollect-"))
    path = f"{(folder or _OWN[0]).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again; cuts the lineage of loops."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upsert(rows: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """rows, with those of a key in `new` replaced and the rest of `new` added."""
    return rows.join(new.select(*key).distinct(), list(key), "left_anti").unionByName(new, allowMissingColumns=True)


def without(rows: DataFrame, ids: DataFrame, column: str = "id") -> DataFrame:
    return rows.join(ids.select(F.col(ids.columns[0]).alias(column)).distinct(), column, "left_anti")


def index_diff(indexed: DataFrame, found: DataFrame) -> DataFrame:
    """(id, change): added, updated or removed, by the hash of the content (columns id, content_hash)."""
    a, b = indexed.select("id", F.col("content_hash").alias("old")), found.select("id", F.col("content_hash").alias("new"))
    change = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").when(F.col("old") != F.col("new"), "updated")
    return a.join(b, "id", "full_outer").select("id", change.alias("change")).where("change is not null")


def hashed(rows: DataFrame, content: Column | None = None) -> DataFrame:
    return rows.withColumn("content_hash", content_hash(F.col("content") if content is None else content))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges whose target exists; of edges of one type between two nodes the first by source stays."""
    known = edges.join(nodes.select(F.col("id").alias("target_id")), "target_id", "left_semi")
    least, most = F.least("source_id", "target_id"), F.greatest("source_id", "target_id")
    first = F.min(F.struct("source_id", "target_id", *(c for c in edges.columns if c not in ("source_id", "target_id", "edge_type")))).alias("e")
    return known.groupBy(least.alias("_l"), most.alias("_m"), "edge_type").agg(first).select("e.*", "edge_type").select(*edges.columns)


def postings(nodes: DataFrame) -> DataFrame:
    """(id, field, term, position): the full-text index."""
    from recollect.operators.search import tokens

    fields = {"title": F.col("title"), "content": F.col("content"), "tags": F.array_join("tags", " ")}
    parts = [nodes.select("id", F.lit(n).alias("field"), F.posexplode(tokens(c)).alias("position", "term")) for n, c in fields.items()]
    return parts[0].union(parts[1]).union(parts[2]).select("id", "field", "term", "position")
