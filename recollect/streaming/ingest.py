"""Structured Streaming: files that change, prompts in sessions, and accesses as they come."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.functions.text import content_hash


#: Batches after which the state is written whole, so that a start reads at most so many folders.
COMPACT = 16


def relative_path(file: Column, root: str) -> Column:
    """The path of a file, given as an encoded URI, below the folder `root`; the whole path if it is not below it.

    What stands between the last @ of the name and its extension is left out: it names the version.
    """
    plain = F.regexp_replace(file, r"^[A-Za-z][A-Za-z0-9+.-]*:(//[^/]*)?", "")
    plain = F.url_decode(F.regexp_replace(plain, r"\+", "%2B"))
    top = F.lit(root.rstrip("/") + "/")
    below = F.when(F.startswith(plain, top), F.substring(plain, F.length(top) + 1, F.length(plain))).otherwise(plain)
    return F.regexp_replace(below, r"@[^@/]*?(\.[^.@/]*)?$", "$1")


def _place(spark: SparkSession, folder: str):
    """The file system and the full path of a folder, as Hadoop sees them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return files, files.makeQualified(path)


def new_versions(spark: SparkSession, folder: str, suffix: str = "*.md") -> DataFrame:
    """A stream of (path, text, content_hash, modified) of files below a folder.

    Spark's file source reads a name once, so a changed file has to come under a new name: `notes/a@2.md` is a
    version of `notes/a.md`. Files of one name in two folders are two paths, as are `a.v1.md` and `a.v2.md`.
    """
    s = spark.readStream.option("wholetext", True).option("pathGlobFilter", suffix).option("recursiveFileLookup", True).format("text").load(folder)
    path = relative_path(F.col("_metadata.file_path"), _place(spark, folder)[1].toUri().getPath())
    return s.select(path.alias("path"), F.col("value").alias("text"), content_hash(F.col("value")).alias("content_hash"), F.col("_metadata.file_modification_time").alias("modified"))


def once_for_each_content(seen: DataFrame, batch: DataFrame, least_chars: int = 10) -> DataFrame:
    """The last version of each path in a batch that is long enough and not the one last seen (path, content_hash).

    `seen` has one row for each path, so that a file that returns to an earlier content counts as changed.
    """
    last = batch.groupBy("path").agg(F.max(F.struct("modified", "content_hash", "text")).alias("v")).select("path", "v.*")
    return last.where(F.length(F.trim("text")) >= least_chars).join(seen.select("path", "content_hash"), ["path", "content_hash"], "left_anti")


def last_seen(spark: SparkSession, state_path: str, before: int | None = None) -> DataFrame:
    """(path, content_hash, number): the last content of each path among the batches of a number under `before`.

    No folder, or none of such a batch, is an empty table; a folder that cannot be read is an error.
    """
    files, place = _place(spark, state_path)
    names = sorted(f.getPath().getName() for f in files.listStatus(place)) if files.exists(place) else []
    names = [n for n in names if n[:1].isdigit() and (before is None or int(n.partition("-")[0]) < before)]
    whole = max((i for i, n in enumerate(names) if n.endswith("-whole")), default=0)
    schema = "path string, content_hash string, number bigint"
    if not names:
        return spark.createDataFrame([], schema)
    rows = spark.read.schema(schema).parquet(*(f"{place.toString()}/{n}" for n in names[whole:]))
    return rows.groupBy("path").agg(F.max_by("content_hash", "number").alias("content_hash"), F.max("number").alias("number"))


def gone(seen: DataFrame, present: DataFrame) -> DataFrame:
    """The rows of `seen` whose path is not among those of `present`: files that were deleted."""
    return seen.join(present.select("path"), "path", "left_anti")


def ingest(stream: DataFrame, state_path: str, checkpoint: str, handle: Callable[[DataFrame], None], once: bool = False):
    """Start a query that hands each batch's new contents to `handle` and then records them: at least once each.

    The state belongs to the checkpoint: a folder a batch, written anew if the batch is run again, and the last
    content of all paths every COMPACT batches. `once` takes what is there and stops, which catches up after a pause.
    """

    def each(batch: DataFrame, number: int) -> None:
        seen = last_seen(batch.sparkSession, state_path, number)
        fresh = once_for_each_content(seen, batch).persist()
        try:
            handle(fresh)
            rows = fresh.select("path", "content_hash", F.lit(number).cast("bigint").alias("number"))
            whole = number % COMPACT == COMPACT - 1
            if whole:
                rows = gone(seen, rows).unionByName(rows)
            rows.write.mode("overwrite").parquet(f"{state_path}/{number:012d}{'-whole' if whole else ''}")
        finally:
            fresh.unpersist()

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w.trigger(processingTime="2 seconds")).start()


def access_counts(accesses: DataFrame, watermark: str = "1 hour", width: str = "1 day") -> DataFrame:
    """A stream of (window, id, accesses, last) from accesses (id, ts); what is later than the watermark is dropped."""
    return accesses.withWatermark("ts", watermark).groupBy(F.window("ts", width), "id").agg(F.count("*").alias("accesses"), F.max("ts").alias("last"))


def sessions(prompts: DataFrame, gap: str = "10 minutes", watermark: str = "1 hour") -> DataFrame:
    """A stream of (session, start, end, prompts) of spans without a pause of `gap`."""
    g = prompts.withWatermark("ts", watermark).groupBy(F.session_window("ts", gap).alias("w"), "session").agg(F.count("*").alias("prompts"))
    return g.select("session", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "prompts")


def buffered(prompts: DataFrame, most: int = 5, gap: int = 600) -> DataFrame:
    """A stream of (session, ts, prompt, buffer, number, every_tenth) from prompts (session, ts, prompt).

    The buffer holds up to `most` earlier prompts of the session that are at most `gap` seconds old.
    """
    out = "session string, ts timestamp, prompt string, buffer array<string>, number bigint, every_tenth boolean"

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, number = (list(zip(*state.get[:2], strict=True)), state.get[2]) if state.exists else ([], 0)
        rows = pd.concat(list(frames)).sort_values(["ts", "prompt"], kind="stable")
        done = []
        for ts, prompt in zip(rows["ts"], rows["prompt"], strict=True):
            held = [(t, p) for t, p in held if (ts - pd.Timestamp(t)).total_seconds() <= gap][-most:]
            number += 1
            done.append((key[0], ts, prompt, [p for _, p in held], number, number % 10 == 0))
            held = [*held, (ts.to_pydatetime(), prompt)][-most:]
        state.update(([t for t, _ in held], [p for _, p in held], number))
        yield pd.DataFrame(done, columns=["session", "ts", "prompt", "buffer", "number", "every_tenth"])

    return prompts.groupBy("session").applyInPandasWithState(step, out, "times array<timestamp>, prompts array<string>, number bigint", "append", GroupStateTimeout.NoTimeout)
