"""Memories as markdown files with a YAML head: reading, writing and finding what changed."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pandas as pd
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import content_hash, strip, title

#: The line that ends a head, and what belongs to it.
END = r"\r?\n---[ \t]*(?:\r?\n|\z)"
SCALARS = ("id", "type", "tier", "source", "space", "title", "created", "updated", "last_accessed", "access_count", "confidence", "importance", "valid_until", "stability", "last_review")
#: Scalars of free text, which are written in quotes.
TEXTS = ("id", "source", "space", "title")
#: What a scalar without a value is written as.
NOTHING = ("", "null", "~", '""', "''")
ITEM = r"""\s*("(?:[^"\\]|\\.)*"|'(?:[^']|'')*'|[^,]+)"""
CONNECTION = r"(?m)^[ \t]*- target:[ \t]*(\S+)\s*\n[ \t]+edge:[ \t]*(\S+)(?:\s*\n[ \t]+weight:[ \t]*([0-9.eE+-]+))?"


def _unquoted(raw: Column) -> Column:
    """A scalar without its quotes; the escapes of JSON count within double ones, two quotes are one in single ones."""
    inner = F.substring(raw, F.lit(2), F.length(raw) - 2)
    double = F.coalesce(F.get_json_object(F.concat(F.lit('{"v":'), raw, F.lit("}")), "$.v"), inner)
    pair = F.length(raw) >= 2
    return F.when(pair & raw.startswith('"') & raw.endswith('"'), double).when(pair & raw.startswith("'") & raw.endswith("'"), F.replace(inner, F.lit("''"), F.lit("'"))).otherwise(raw)


def _list(head: Column, raw: Column, key: str) -> Column:
    """The items of a list, in brackets or a line each."""
    flow = F.regexp_extract_all(F.regexp_replace(raw, r"^\[|\]$", ""), F.lit(ITEM), F.lit(1))
    block = F.regexp_extract_all(F.regexp_extract(head, rf"(?m)^{key}:[ \t]*\n((?:[ \t]*- .*(?:\n|\z))+)", 1), F.lit(r"(?m)^[ \t]*- (.*)$"), F.lit(1))
    items = F.when(raw.startswith("["), flow).when(raw == "", block).otherwise(F.array().cast("array<string>"))
    return F.filter(F.transform(F.coalesce(items, F.array().cast("array<string>")), lambda x: _unquoted(strip(x))), lambda x: x != "")


def parse(files: DataFrame) -> DataFrame:
    """Rows of NODE_SCHEMA and their connections, from files (path, text); files without a head or id are left out.

    What a head lacks takes its default: tier working, confidence 1, importance .5, stability 1, no accesses,
    last access as updated, updated as created. Times without a zone are UTC. Of a key given twice the last
    counts. The text is cut once and each line of the head is read once.
    """
    cut = files.where(F.col("text").rlike(r"\A---\r?\n")).select(F.split("text", END, 2).alias("p")).where(F.size("p") == 2)
    head = F.regexp_replace(F.regexp_replace(F.col("p")[0], r"\A---(?:\r?\n)?", ""), "\r\n", "\n")
    t = cut.select(head.alias("h"), strip(F.col("p")[1]).alias("content"))
    # asked of the head, for a filter on what is made of it below would be pushed under all those steps and repeat them
    t = t.where(~strip(F.regexp_extract("h", r"(?s)(?:\A|.*\n)id:([^\n]*)", 1)).isin(*NOTHING))
    t = t.withColumn("lines", F.filter(F.split("h", "\n"), lambda x: x.rlike("^[A-Za-z_]+:")))
    t = t.withColumn("keys", F.reverse(F.transform("lines", lambda x: F.substring_index(x, ":", 1))))
    last = F.filter("lines", lambda x, i: F.array_position("keys", F.substring_index(x, ":", 1)) == F.size("keys") - i)
    pair = lambda x: F.struct(F.substring_index(x, ":", 1), strip(F.substring(x, F.instr(x, ":") + 1, F.length(x))))
    t = t.withColumn("raw", F.map_from_entries(F.transform(last, pair)))
    t = t.withColumn("m", F.transform_values("raw", lambda _, v: _unquoted(v)))

    def scalar(key: str) -> Column:
        return F.when(~F.col("raw")[key].isin(*NOTHING), F.col("m")[key])

    time = lambda k: scalar(k).try_cast("timestamp")
    number = lambda k, d: F.coalesce(scalar(k).try_cast("double"), F.lit(d))
    created = time("created")
    updated = F.coalesce(time("updated"), created)
    links = F.when(F.map_contains_key("raw", "connections"), F.regexp_extract_all("h", F.lit(CONNECTION), F.lit(0))).otherwise(F.array().cast("array<string>"))
    part = lambda x, key: _unquoted(F.regexp_extract(x, rf"{key}:[ \t]*(\S+)", 1))
    connection = lambda x: F.struct(part(x, "target").alias("target"), part(x, "edge").alias("edge"), F.coalesce(part(x, "weight").try_cast("double"), F.lit(0.5)).alias("weight"))
    out = t.select(
        scalar("id").alias("id"), F.coalesce(scalar("type"), F.lit("fact")).alias("type"), F.coalesce(scalar("tier"), F.lit("working")).alias("tier"), scalar("source").alias("source"), scalar("space").alias("space"),
        F.coalesce(scalar("title"), title(F.col("content"))).alias("title"), "content", created.alias("created"), updated.alias("updated"), F.coalesce(time("last_accessed"), updated).alias("last_accessed"),
        number("access_count", 0.0).cast("bigint").alias("access_count"), number("confidence", 1.0).alias("confidence"), number("importance", 0.5).alias("importance"), time("valid_until").alias("valid_until"),
        number("stability", 1.0).alias("stability"), time("last_review").alias("last_review"), _list(F.col("h"), F.col("raw")["tags"], "tags").alias("tags"), content_hash(F.col("content")).alias("content_hash"), F.transform(links, connection).alias("connections"),
    )
    return out


def read(spark: SparkSession, folder: str) -> DataFrame:
    """The memories of all *.md files below a folder."""
    files = spark.read.option("pathGlobFilter", "*.md").option("recursiveFileLookup", True).text(folder, wholetext=True)
    return parse(files.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text")))


def edges_of(parsed: DataFrame) -> DataFrame:
    """(source_id, target_id, edge_type, weight) of the connections."""
    return parsed.select("id", F.explode("connections").alias("c")).select(F.col("id").alias("source_id"), F.col("c.target").alias("target_id"), F.col("c.edge").alias("edge_type"), F.col("c.weight").alias("weight"))


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """nodes with the edges that leave each as `connections`, sorted by target and type."""
    own = edges.groupBy(F.col("source_id").cast("string").alias("id")).agg(F.sort_array(F.collect_list(F.struct(F.col("target_id").cast("string").alias("target"), F.col("edge_type").alias("edge"), F.col("weight").cast("double").alias("weight")))).alias("connections"))
    return nodes.withColumn("id", F.col("id").cast("string")).join(own, "id", "left")


def _quoted(value: Column) -> Column:
    """A text in double quotes, with the escapes of JSON, on one line."""
    whole = F.to_json(F.array(value))
    return F.substring(whole, F.lit(2), F.length(whole) - 2)


def render(nodes: DataFrame) -> DataFrame:
    """(id, text): each node of NODE_SCHEMA as a file's text, with its `connections` if there are any.

    Empty optional keys are left out and a null content is an empty one. Ids of connections hold no white space.
    """
    lines = []
    for k in SCALARS:
        value = F.col(k).cast("string") if k in nodes.columns else F.lit(None).cast("string")
        lines.append(F.when(value.isNotNull(), F.concat(F.lit(f"{k}: "), _quoted(value) if k in TEXTS else value)))
    if "tags" in nodes.columns:
        lines.append(F.when(F.size("tags") > 0, F.concat(F.lit("tags: "), F.to_json("tags"))))
    if "connections" in nodes.columns:
        one = lambda c: F.concat(F.lit("- target: "), _quoted(c["target"]), F.lit("\n  edge: "), c["edge"], F.lit("\n  weight: "), F.coalesce(c["weight"], F.lit(0.5)).cast("string"))
        lines.append(F.when(F.size("connections") > 0, F.concat(F.lit("connections:\n"), F.array_join(F.transform("connections", one), "\n"))))
    return nodes.select(F.col("id").cast("string").alias("id"), F.concat(F.lit("---\n"), F.concat_ws("\n", *lines), F.lit("\n---\n"), F.coalesce("content", F.lit(""))).alias("text"))


def file_name(node_id: str) -> str:
    """The name of a node's file: its id, escaped where a path could not hold it, or a digest of a very long one."""
    name = quote(node_id, safe="")
    if len(name) > 200:
        return hashlib.sha256(node_id.encode("utf-8", "surrogatepass")).hexdigest() + ".md"
    return (f"%{ord(name[0]):02X}{name[1:]}" if name[:1] in "._" else name) + ".md"


def write(nodes: DataFrame, folder: str) -> int:
    """Write each node with an id as a file of its own in `folder`, and return how many were written.

    The folder is a URI that pyarrow knows, such as file:// or hdfs://. A file is written under another name and
    then renamed, so that a task that runs again replaces it whole. Files of other nodes stay.
    """

    def save(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, local = fs.FileSystem.from_uri(folder)
        files.create_dir(local, recursive=True)
        for x in frames:
            for node_id, text in zip(x["id"], x["text"], strict=True):
                draft = f"{local}/.{uuid.uuid4().hex}"
                with files.open_output_stream(draft, compression=None) as out:
                    out.write(text.encode("utf-8", "surrogatepass"))
                files.move(draft, f"{local}/{file_name(node_id)}")
            yield pd.DataFrame({"n": [len(x)]})

    done = render(nodes.where("id is not null")).mapInPandas(save, "n bigint")
    return done.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
