"""SimHash near-duplicates linked through deletion-variant signatures.

A 64-bit fingerprint is cut into two halves. Of two fingerprints that differ in at most three bits, one
half differs in at most one. Each half is indexed once for every bit position with that bit taken out
("one wildcard"), so such halves share a variant; fingerprints that share one are compared exactly. A key
that gathers more than `most` fingerprints is cut again in the same way within the other half, and once
more within the rest, so that no link is lost and a bucket holds at most 2^11 fingerprints.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import map_texts, parallelism, prepare, staged, word_offsets
from recollect.llm.components import components

DISTANCE = 3
SEED = 42


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash of the text's word shingles of `size` words, repeats included; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII white space only
    n = len(words) - size + 1
    if not words:
        return 0
    joined = b" ".join(words)
    if n <= 0:
        return xxhash.xxh64_intdigest(joined, SEED)
    starts, ends = word_offsets(words)
    h = xxhash.xxh64_intdigest
    hashes = np.array([h(joined[s:e], SEED) for s, e in zip(starts[:n].tolist(), ends[size - 1 :].tolist(), strict=True)], "<u8")
    counts = np.zeros(64, np.int64)
    for k in range(0, n, 8192):  # a very long text takes no more memory than this many at once
        bits = np.unpackbits(hashes[k : k + 8192].view(np.uint8), bitorder="little").view(np.uint64).reshape(-1, 8)
        lanes = np.add.reduceat(bits, np.arange(0, len(bits), 255), axis=0)  # eight counts of at most 255 in each number
        counts += lanes.view(np.uint8).sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", size: int = 3) -> DataFrame:
    """All columns of docs but the text, and fp bigint. A null text has no words: fp 0."""
    return map_texts(docs, text_col, "fp bigint", lambda: lambda texts: [np.array([fingerprint(t, size) for t in texts], np.uint64).view(np.int64)])


def forest(values: np.ndarray, distance: int = DISTANCE) -> list[tuple[int, int]]:
    """Links that join all of `values` (distinct, uint64) that are connected within the distance, none twice."""
    links, rest = [], np.arange(len(values))
    while len(rest):
        frontier, rest = [rest[0]], rest[1:]
        while frontier and len(rest):
            k = frontier.pop()
            near = np.bitwise_count(values[rest] ^ values[k]) <= distance
            links += [(int(k), int(x)) for x in rest[near]]
            frontier += rest[near].tolist()
            rest = rest[~near]
    return links


def _variants(df: DataFrame, name: str, width: int, part: str) -> DataFrame:
    """A row for each of the two parts of the lowest `width` bits of `part` and each wildcard within it.

    Adds the key `name` and `rest`, the other half of those bits.
    """
    half = width // 2
    mask = (1 << half) - 1
    rows = df.withColumn("_i", F.explode(F.sequence(F.lit(0), F.lit(2 * half - 1))))
    own = f"(shiftrightunsigned({part}, CAST({half} * (_i DIV {half}) AS INT)) & {mask}L)"
    other = f"(shiftrightunsigned({part}, CAST({half} * (1 - _i DIV {half}) AS INT)) & {mask}L)"
    wild = f"~shiftleft(1L, CAST(_i % {half} AS INT))"
    return rows.withColumn(name, F.expr(f"({own} & {wild}) | shiftleft(CAST(_i AS BIGINT), 32)")).withColumn("rest", F.expr(other)).drop("_i")


def links(prints: DataFrame, most: int = 512) -> DataFrame:
    """(a, b) bigint: links between distinct fingerprints of `prints` (fp) at DISTANCE bits or fewer.

    The links of a bucket are a spanning forest of it, so that the components are those of all pairs while a
    bucket of m fingerprints gives fewer than m rows.
    """
    # dealt anew after the distinct, whose few bytes adaptive execution would leave to a few tasks
    level = prints.select("fp").where("fp is not null").distinct().repartition(parallelism(prints.sparkSession))
    keys, width, part = [], 64, "fp"
    found = None

    def linked(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out: set[tuple[int, int]] = set()
            for members in x["members"]:
                values = np.sort(np.asarray(members, np.int64))
                pairs = forest(values.view(np.uint64))
                out.update((int(values[b]), int(values[a])) if values[a] < values[b] else (int(values[a]), int(values[b])) for a, b in pairs)
            yield pd.DataFrame(list(out), columns=["a", "b"], dtype="int64")

    while width > 8:
        key = f"k{len(keys)}"
        keys.append(key)
        level = _variants(level, key, width, part)
        last = width == 16
        if not last:
            hot = staged(level.groupBy(*keys).count().where(F.col("count") > most).select(*keys), "hot")
            small = level.join(hot, keys, "left_anti")
        else:
            small = level
        buckets = small.groupBy(*keys).agg(F.collect_list("fp").alias("members")).where(F.size("members") > 1).select("members")
        out = buckets.mapInPandas(linked, "a bigint, b bigint")
        found = out if found is None else found.union(out)
        if last or hot.isEmpty():
            break
        level = level.join(hot, keys, "left_semi")
        width, part = width // 2, "rest"
    return found.distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, most: int = 512) -> DataFrame:
    """(id_col, fp, component_id) for every row of docs.

    component_id is the smallest id reachable over links of DISTANCE bits or fewer, the row's own included.
    Texts that are null, empty or without words have fingerprint 0 and link with each other. Repeated rows
    stay, with equal results. A row of null id has the component of its fingerprint, null if no id is in it.
    Other columns are not read.
    """
    prepare(docs.sparkSession)
    rows = staged(fingerprints(docs.select(id_col, text_col), text_col, size), "fingerprints")
    each = rows.groupBy("fp").agg(F.min(id_col).alias("least"))
    roots = components(links(rows, most))
    each = each.join(roots, each.fp == roots.node, "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    each = staged(each, "classes")
    named = each.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(each.join(named, "root").select("fp", "component_id"), "fp").select(id_col, "fp", "component_id")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, found: DataFrame | None = None) -> DataFrame:
    """docs without the rows whose component has a smaller id; of repeated rows one stays.

    `found` has the components (id_col, component_id); near_duplicates() of docs unless given. Rows of null id
    cannot be named and are kept, repeated ones once. The columns are those of docs.
    """
    found = near_duplicates(docs, id_col, text_col, size) if found is None else staged(found, "found")
    lost = staged(found.where(F.col(id_col) > F.col("component_id")).select(id_col).distinct(), "lost")
    kept = docs.join(lost, id_col, "left_anti").select(*docs.columns)
    if found.groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.dropDuplicates([id_col, text_col])
