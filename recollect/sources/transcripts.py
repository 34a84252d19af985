"""Transcripts: JSON lines of messages, as conversations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.functions.text import glob_pattern, space_of_folder, strip

BLOCKS = "array<struct<type: string, text: string>>"


def message_text(kind: Column, content: Column) -> Column:
    """What a message says: a user's text or text blocks, an assistant's text blocks; null if nothing."""
    blocks = F.from_json(content, BLOCKS)
    said = F.filter(F.transform(F.filter(blocks, lambda b: b["type"] == "text"), lambda b: strip(b["text"])), lambda t: t != "")
    joined = F.when(F.size(said) > 0, F.array_join(said, "\n"))
    is_list = content.startswith("[")
    return F.when(kind == "user", F.when(is_list, joined).otherwise(F.nullif(strip(content), F.lit("")))).when((kind == "assistant") & is_list, joined)


def parse(lines: DataFrame) -> DataFrame:
    """(path, line, role, text) of lines (path, line, value) that say something; lines that are no JSON are left out."""
    kind, content = F.get_json_object("value", "$.type"), F.get_json_object("value", "$.message.content")
    return lines.select("path", "line", kind.alias("role"), message_text(kind, content).alias("text")).where("text is not null")


def conversations(messages: DataFrame) -> DataFrame:
    """(path, text, user_turns, chars): a row for each transcript, its messages in order."""
    said = F.concat(F.when(F.col("role") == "user", "User: ").otherwise("Assistant: "), "text")
    g = messages.withColumn("said", said).groupBy("path").agg(F.sort_array(F.collect_list(F.struct("line", "said"))).alias("m"), F.sum((F.col("role") == "user").cast("int")).alias("user_turns"), F.sum(F.length("text")).alias("chars"))
    return g.select("path", F.array_join(F.transform("m", lambda x: x["said"]), "\n\n").alias("text"), "user_turns", "chars")


def read(spark: SparkSession, folder: str, after: str | None = None) -> DataFrame:
    """Messages of all *.jsonl files below a folder, of those changed since `after` if given."""
    reader = spark.read.option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True)
    files = (reader.option("modifiedAfter", after) if after else reader).text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return parse(files.select("path", F.posexplode(F.split("value", "\n")).alias("line", "value")))


def discovered(spark: SparkSession, folder: str, ignore: tuple[str, ...] = (), limit: int | None = None) -> DataFrame:
    """(path, modified, size, space) of the transcripts below a folder, the newest first."""
    f = spark.read.format("binaryFile").option("pathGlobFilter", "*.jsonl").option("recursiveFileLookup", True).load(folder)
    f = f.select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), space_of_folder(F.element_at(F.split("path", "/"), -2)).alias("space"))
    for g in ignore:
        f = f.where(~F.col("path").rlike(glob_pattern(g)))
    f = f.orderBy(F.desc("modified"), "path")
    return f.limit(limit) if limit else f


def resumed(messages: DataFrame, cursors: DataFrame) -> DataFrame:
    """Messages beyond each transcript's cursor (path, line)."""
    m = messages.join(cursors.select("path", F.col("line").alias("_from")), "path", "left")
    return m.where(F.col("line") >= F.coalesce("_from", F.lit(0))).drop("_from")
