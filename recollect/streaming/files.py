"""A stream source that sees files edited in place, appended to and deleted, and the quiet end of a session.

The source lists a folder on any filesystem that pyarrow knows. Its offset maps each path to size, time of change
and the byte up to which it was read, so that a checkpoint holds what was seen. Files of an `append` suffix are
read by line from that byte on, to the last whole line; if they shrink they are read anew. Other files are read whole
whenever size or time differ. A file that is gone gives one row. Listing is done by the driver, reading by tasks, a
range of lines or a file each. An edit that leaves size and time as they are isn't seen; a batch that is repeated
after a failure reads what the file holds then.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from recollect.sources.transcripts import message_text

#: kind: file (its whole content), line (one of an appended file, `at` its first byte) or gone.
SCHEMA = "path string, kind string, at bigint, content string, modified timestamp"
#: Bytes of lines that one task reads; a longer line is read whole.
RANGE = 64 << 20
_TAIL = 1 << 16


@dataclass
class Span(InputPartition):
    path: str
    kind: str
    start: int
    end: int
    modified: float


class EditedFilesReader(DataSourceStreamReader):
    def __init__(self, options: dict) -> None:
        self.uri = options["path"]
        self.suffixes = tuple(x for x in options.get("suffixes", ".md,.jsonl").split(",") if x)
        self.append = tuple(x for x in options.get("append", ".jsonl").split(",") if x)
        self.lookback = float(options.get("lookbackhours", options.get("lookbackHours", "0")))

    def _open(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.uri)

    def _listing(self) -> dict[str, tuple[int, float]]:
        files, base = self._open()
        found = files.get_file_info(fs.FileSelector(base, recursive=True, allow_not_found=True))
        return {f.path[len(base) :].lstrip("/"): (f.size, f.mtime_ns / 1e9) for f in found if f.type == fs.FileType.File and f.path.endswith(self.suffixes)}

    def initialOffset(self) -> dict:
        """What is passed over at the first start: by lookback hours nothing (0), all (negative) or what is older.

        A file passed over is read whole once it changes.
        """
        if not self.lookback:
            return {"files": "{}"}
        import time

        since = time.time() - self.lookback * 3600 if self.lookback > 0 else float("inf")
        return {"files": json.dumps({p: [n, t, 0] for p, (n, t) in self._listing().items() if t < since})}

    def latestOffset(self) -> dict:
        files, base = self._open()
        out = {}
        for path, (size, time) in sorted(self._listing().items()):
            out[path] = [size, time, self._whole_lines(files, f"{base}/{path}", size) if path.endswith(self.append) else size]
        return {"files": json.dumps(out)}

    @staticmethod
    def _whole_lines(files: fs.FileSystem, path: str, size: int) -> int:
        """The byte after the last line break."""
        try:
            with files.open_input_file(path) as f:
                end = size
                while end > 0:
                    start = max(0, end - _TAIL)
                    at = f.read_at(end - start, start).rfind(b"\n")
                    if at >= 0:
                        return start + at + 1
                    end = start
        except FileNotFoundError:
            pass
        return 0

    def partitions(self, start: dict, end: dict) -> list[Span]:
        old, new, out = json.loads(start["files"]), json.loads(end["files"]), []
        for path, (size, time, upto) in new.items():
            before = old.get(path)
            if before and before[:2] == [size, time]:
                continue
            if path.endswith(self.append):
                at = before[2] if before and before[2] <= upto and before[0] <= size else 0
                out += [Span(path, "line", lo, min(lo + RANGE, upto), time) for lo in range(at, upto, RANGE)]
            else:
                out.append(Span(path, "file", 0, size, time))
        return out + [Span(p, "gone", 0, 0, v[1]) for p, v in old.items() if p not in new]

    def read(self, partition: Span) -> Iterator[tuple]:
        p, modified = partition, datetime.fromtimestamp(partition.modified, UTC)
        if p.kind == "gone":
            yield (p.path, "gone", 0, None, modified)
            return
        files, base = self._open()
        try:
            with files.open_input_file(f"{base}/{p.path}") as f:
                if p.kind == "file":
                    yield (p.path, "file", 0, f.read().decode("utf-8", "replace"), modified)
                    return
                at = max(0, p.start - 1)
                f.seek(at)
                if p.start:  # a line that began before belongs to the range before; none did if this byte is a break
                    at += len(_line(f))
                while at < p.end:
                    line = _line(f)
                    if not line:
                        return
                    yield (p.path, "line", at, line.rstrip(b"\r\n").decode("utf-8", "replace"), modified)
                    at += len(line)
        except FileNotFoundError:
            return  # the next listing says that it is gone

    def commit(self, end: dict) -> None:
        pass


def _line(f) -> bytes:
    """The next line with its break, read in small pieces."""
    out = b""
    while True:
        at = f.tell()
        piece = f.read(_TAIL)
        cut = piece.find(b"\n")
        if cut >= 0:
            f.seek(at + cut + 1)
            return out + piece[: cut + 1]
        if not piece:
            return out
        out += piece


class EditedFiles(DataSource):
    """Options: path (a URI), suffixes, append (comma-separated), lookbackHours."""

    @classmethod
    def name(cls) -> str:
        return "edited_files"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> EditedFilesReader:  # noqa: ARG002
        return EditedFilesReader(dict(self.options))


def edited_files(spark: SparkSession, uri: str, **options: str) -> DataFrame:
    """A stream of rows (SCHEMA) for the files below a URI."""
    spark.dataSource.register(EditedFiles)
    return spark.readStream.format("edited_files").options(**options).option("path", uri).load()


def quiet_sessions(rows: DataFrame, quiet_seconds: float = 60, least_turns: int = 5) -> DataFrame:
    """A stream of (path, start, end, turns): what to take in of a transcript once nothing has come for a while.

    From rows of edited_files. New lines start the wait again. A session of fewer than `least_turns` turns of the
    user waits for more; after it was given out, later lines are given from where it ended. A transcript that begins
    anew, or is gone, is forgotten.
    """
    kind, body = F.get_json_object("content", "$.type"), F.get_json_object("content", "$.message.content")
    said = F.when((kind == "user") & message_text(kind, body).isNotNull(), 1).otherwise(0)
    end = F.col("at") + F.coalesce(F.octet_length("content"), F.lit(0)) + 1
    lines = rows.where("kind in ('line', 'gone')").select("path", (F.col("kind") == "gone").alias("gone"), "at", end.cast("bigint").alias("end"), said.alias("turn"))

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        start, upto, turns = state.get if state.exists else (0, 0, 0)
        if state.hasTimedOut:
            if turns >= least_turns and upto > start:
                state.update((upto, upto, turns))
                yield pd.DataFrame({"path": [key[0]], "start": [start], "end": [upto], "turns": [turns]})
            return
        x = pd.concat(list(frames)).sort_values("at", kind="stable")
        if x["gone"].any():
            x = x[~x["gone"]]
            start, upto, turns = 0, 0, 0
            if not len(x):
                state.remove()
                return
        if int(x["at"].iloc[0]) < upto:  # it was rewritten
            start, turns = 0, 0
        state.update((start, int(x["end"].max()), turns + int(x["turn"].sum())))
        state.setTimeoutDuration(int(quiet_seconds * 1000))

    out = "path string, start bigint, end bigint, turns bigint"
    return lines.groupBy("path").applyInPandasWithState(step, out, "start bigint, upto bigint, turns bigint", "append", GroupStateTimeout.ProcessingTimeTimeout)
