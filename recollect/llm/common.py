"""Shared helpers of the training-data operators: staging folder, worker set-up and word hashing."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StructType

from recollect.session import prepare as prepare  # noqa: PLC0414  for the operators

#: Odd multiplier of the rolling word-window hash.
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


#: The local folder taken where spark.checkpoint.dir is unset.
_OWN: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from spark.checkpoint.dir; a local one where that is unset, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and not _OWN:
        _OWN.append("file://" + tempfile.mkdtemp(prefix="recollect-"))
    return (folder or _OWN[0]).rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, which goes when the application ends."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    sc = spark.sparkContext
    jpath = sc._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def staged(df: DataFrame, name: str) -> DataFrame:
    """df written as Parquet in the shared folder and read again: cuts lineage and survives lost executors."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Delete the files of tables that staged() wrote; nothing may read them any more."""
    for table in tables:
        jvm, conf = table.sparkSession.sparkContext._jvm, table.sparkSession.sparkContext._jsc.hadoopConfiguration()
        for path in {f.rpartition("/")[0] for f in table.inputFiles()}:
            jpath = jvm.org.apache.hadoop.fs.Path(path)
            jpath.getFileSystem(conf).delete(jpath, True)


def parallelism(spark: SparkSession) -> int:
    """The session's number of shuffle partitions, which its owner sizes to the data."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def map_texts(docs: DataFrame, text_col: str, new: str, make: Callable[[], Callable[[list], list]], most: int = 1024, keep_text: bool = False) -> DataFrame:
    """docs' columns but the text, and those of `new` (a schema string), from the texts alone.

    `make` runs once a task and gives a function from some texts to a list of values for each new column. All
    other columns, and with `keep_text` the text, pass untouched as Arrow arrays; those of a new name are replaced.
    """
    fields = StructType.fromDDL(new).fields
    keep = [c for c in docs.columns if c != text_col and c not in {f.name for f in fields}]
    slim = docs.select(*keep, text_col)
    types = [to_arrow_type(f.dataType) for f in fields]
    passed = len(keep) + keep_text
    names = [*[*keep, text_col][:passed], *(f.name for f in fields)]

    def batches(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for frame in frames:
            for lo in range(0, frame.num_rows, most):
                x = frame.slice(lo, most)
                columns = work(x.column(len(keep)).to_pylist())
                yield pa.RecordBatch.from_arrays([*x.columns[:passed], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], names=names)

    return slim.mapInArrow(batches, StructType([*slim.schema.fields[:passed], *fields]))


def window_hashes(hashes: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of `size` consecutive word hashes; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = hashes[:n].copy()
    for j in range(1, size):
        out *= MULTIPLIER
        out += hashes[j : j + n]
    out ^= out >> np.uint64(31)  # the high bits of a product mix well, the low ones don't
    out *= MULTIPLIER
    out ^= out >> np.uint64(29)
    return out


def word_offsets(words: Sequence[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word in the words joined by one byte."""
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    return ends - lengths, ends


def runs(mask: np.ndarray) -> list[tuple[int, int]]:
    """[start, end) of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))

_BASE = 0x5851F42D4C957F2D  # odd, so it has an inverse modulo 2^64
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _POWERS or len(_POWERS[0]) < n:
        size = 1 << max(16, n.bit_length())
        _POWERS[:] = []
        for x in (_BASE, pow(_BASE, -1, 1 << 64)):
            p = np.full(size, x, np.uint64)
            p[0] = 1
            _POWERS.append(np.cumprod(p, dtype=np.uint64))
    return _POWERS[0], _POWERS[1]


def hashed_words(data: bytes, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each maximal run of bytes for which is_word (by byte value) holds.

    The hash is the bytes' polynomial modulo 2^64 from prefix sums, then mixed. What it finds must be
    verified: it is no digest.
    """
    a = np.frombuffer(data, np.uint8)
    inside = is_word[a]
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(a) and inside[0]:
        edges = np.concatenate(([0], edges))
    if len(a) and inside[-1]:
        edges = np.concatenate((edges, [len(a)]))
    starts, ends = edges[::2], edges[1::2]
    power, inverse = _powers(len(a) + 1)
    sums = np.empty(len(a) + 1, np.uint64)
    sums[0] = 0
    np.cumsum((a.astype(np.uint64) + np.uint64(1)) * power[: len(a)], out=sums[1:])
    h = (sums[ends] - sums[starts]) * inverse[starts]
    h ^= h >> np.uint64(32)
    h *= MULTIPLIER
    h ^= h >> np.uint64(29)
    return starts, ends, h


def by_size(texts: Sequence[bytes], most: int = 1 << 20) -> list[tuple[int, int]]:
    """Ranges of texts that together have `most` bytes, or are one longer text."""
    out, start, size = [], 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            out.append((start, i))
            start, size = i, 0
        size += len(t) + 1
    if start < len(texts):
        out.append((start, len(texts)))
    return out
