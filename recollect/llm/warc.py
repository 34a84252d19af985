"""WARC archives as a table of chunks.

Writing: each task streams its records to one compressed archive, a gzip member a record; copies of a payload
are revisit records that refer to one response. Reading: a record becomes rows of record identifier and chunk
number, with the digest of the payload so far, so that no payload has to be held whole.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm.common import prepare, scratch_path, staged

CHUNK = 1 << 20
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
DATE = "2024-01-01T00:00:00Z"
CHUNKS = "record_id string, target string, record_type string, refers_to string, stated_bytes bigint, stated_digest string, chunk_no int, data binary, bytes_so_far bigint, digest_so_far string, is_last boolean"


def base32_sha1(digest: bytes) -> str:
    return base64.b32encode(digest).decode("ascii")


def _one_line(value: str | None) -> str:
    return " ".join((value or "").split())


def _record(out, page_id, url: str | None, payload: bytes, refers_to) -> None:
    """Write one record as a gzip member, the payload in pieces of CHUNK."""
    head = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_one_line(url)}",
        f"WARC-Payload-Digest: sha1:{base32_sha1(hashlib.sha1(payload).digest())}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(HTTP) + (len(payload) if refers_to is None else 0)}",
    ]
    if refers_to is not None:
        head[5:5] = ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    out.write(z.compress("\r\n".join([*head, "", ""]).encode("utf-8", "surrogatepass") + HTTP))
    if refers_to is None:
        for k in range(0, len(payload), CHUNK):
            out.write(z.compress(payload[k : k + CHUNK]))
    out.write(z.compress(b"\r\n\r\n") + z.flush())


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html") -> DataFrame:
    """Write a record for each row; returns (path, records) for the archives of the tasks that succeeded.

    Payloads are the UTF-8 bytes of payload_col (null: empty). Of rows with equal payloads of at least
    `min_bytes`, that with the largest id is the response and the others revisit it; repeated rows of that id
    are responses too. Rows of null id are responses to which nothing refers. `folder` is a URI that every
    executor can write to, by default a new one in the shared folder. Files of failed attempts are in no row.
    """
    spark = prepare(pages.sparkSession)
    to = folder or scratch_path(spark, "warc")
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.coalesce(payload_col, F.lit("")).alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1(F.col("payload").cast("binary"))))
    groups = rows.where(F.octet_length("payload") >= min_bytes).groupBy("digest").agg(F.max("id").alias("last"), F.count("*").alias("n")).where("n > 1").drop("n")
    # only groups of copies are on the right; a payload of very many copies is split by adaptive execution
    joined = rows.join(groups, "digest", "left").select(F.col("id").cast("string").alias("id"), "url", "payload", F.when(F.col("id") < F.col("last"), F.col("last")).cast("string").alias("refers_to"))

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        stream, n, path = None, 0, f"{to}/{uuid.uuid4().hex}.warc.gz"
        for x in frames:
            if stream is None:
                files, local = fs.FileSystem.from_uri(path)
                files.create_dir(local.rpartition("/")[0], recursive=True)
                stream = files.open_output_stream(local, compression=None)
            for i, url, payload, r in zip(x["id"], x["url"], x["payload"], x["refers_to"], strict=True):
                _record(stream, i or "null", url, payload.encode("utf-8", "surrogatepass"), r)
                n += 1
        if stream is not None:
            stream.close()
            yield pd.DataFrame({"path": [path], "records": [n]})

    return staged(joined.mapInPandas(tasks, "path string, records bigint"), "archives")


class _Member:
    """Bytes of a gzip file, inflated as they are asked for."""

    def __init__(self, stream) -> None:
        self.stream, self.z, self.ready = stream, zlib.decompressobj(31), b""

    def more(self) -> bool:
        """Inflate some more; false at the end of the file."""
        raw = self.z.unused_data if self.z.eof else self.z.unconsumed_tail
        if self.z.eof:
            self.z = zlib.decompressobj(31)
        raw = raw or self.stream.read(CHUNK // 4)
        if not raw:
            return False
        self.ready += self.z.decompress(raw, CHUNK)
        return True

    def until(self, mark: bytes) -> bytes | None:
        """Bytes up to and with the mark; None at the end of the file."""
        while (k := self.ready.find(mark)) < 0:
            if not self.more():
                return None
        out, self.ready = self.ready[: k + len(mark)], self.ready[k + len(mark) :]
        return out

    def take(self, most: int) -> bytes:
        """Between one and `most` bytes."""
        while not self.ready:
            if not self.more():
                raise EOFError("the archive ends inside a record")
        out, self.ready = self.ready[:most], self.ready[most:]
        return out


def records(stream, chunk: int = CHUNK, data: bool = True) -> Iterator[tuple]:
    """Rows of the CHUNKS schema for all records of a gzip stream; the payload is never held whole."""
    source = _Member(stream)
    while (head := source.until(b"\r\n\r\n")) is not None:
        lines = head.decode("utf-8", "surrogatepass").strip("\r\n").split("\r\n")
        fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        left = int(fields["content-length"])
        if left and fields.get("content-type", "").startswith("application/http"):
            left -= len(source.until(b"\r\n\r\n"))
        known = (
            fields["warc-record-id"].strip("<>"), fields.get("warc-target-uri"), fields["warc-type"], fields["warc-refers-to"].strip("<>") if "warc-refers-to" in fields else None,
            int(fields["x-payload-length"]) if "x-payload-length" in fields else None, fields.get("warc-payload-digest", "").removeprefix("sha1:") or None,
        )
        sha, done, number, piece = hashlib.sha1(), 0, 0, []
        held = 0
        while True:
            while left and held < chunk:
                got = source.take(min(left, chunk - held))
                left -= len(got)
                held += len(got)
                sha.update(got)
                if data:
                    piece.append(got)
            done += held
            yield (*known, number, b"".join(piece) if data else None, done, base32_sha1(sha.digest()), left == 0)
            if not left:
                break
            number, held, piece = number + 1, 0, []
        source.until(b"\r\n\r\n")


def read(spark: SparkSession, archives: DataFrame, chunk: int = CHUNK, data: bool = True) -> DataFrame:
    """The records of `archives` (path) as rows of CHUNKS: a row for each chunk of a payload, one for an empty one.

    digest_so_far is the SHA-1 of the payload up to the chunk's end, in the last row that of all of it. A
    revisit has no payload of its own; stated_bytes and stated_digest are those its header gives. Without
    `data` the payload is read and digested but not returned.
    """
    prepare(spark)
    names = CHUNKS.replace(" string", "").replace(" bigint", "").replace(" int", "").replace(" binary", "").replace(" boolean", "").split(", ")

    def tasks(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            for path in x["path"]:
                files, local = fs.FileSystem.from_uri(path)
                with files.open_input_stream(local, compression=None) as stream:
                    rows, size = [], 0
                    for r in records(stream, chunk, data):
                        rows.append(r)
                        size += len(r[7] or b"") + 200
                        if size > 8 * CHUNK:
                            yield frame_of(rows)
                            rows, size = [], 0
                    if rows:
                        yield frame_of(rows)

    def frame_of(rows: list[tuple]) -> pd.DataFrame:
        return pd.DataFrame(rows, columns=names).astype({"stated_bytes": "Int64"})

    n = max(1, archives.count())
    return archives.select("path").repartition(n).mapInPandas(tasks, CHUNKS)
