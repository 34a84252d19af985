"""A stored inverted index: postings by term, in segments that upserts add to.

Layout below one folder: `postings/segment=s/bucket=b` holds a row for each term and node (places of the term in the
fields, counts, the node's number of tokens), sorted by term, and with more nodes over more files, so that a
common term spans many; `docs/segment=s` a row a node; `gone/segment=s` the ids whose rows in earlier segments no longer count; and
`manifest` one row a segment, written last, so that a segment without it was not finished and is not read.
A search lists the buckets of its terms alone, and their files' statistics skip other terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.operators.search import phrase, scored, tokens
from recollect.sources.tables import scratch_path

FIELDS = ("title", "content", "tags")
#: Places of the second and third field begin at its multiples, so that no phrase spans two fields.
SPAN = 1 << 32
#: Nodes whose postings of one bucket share a file at most.
NODES_A_FILE = 1_000_000
MANIFEST = "segment int, docs bigint, tokens bigint, gone_docs bigint, gone_tokens bigint, buckets int, fold boolean, stemmed boolean, id_type string"


@dataclass(frozen=True)
class TextIndex:
    """A stored index; `stem` maps token columns and term lists to stems, as in search.bm25."""

    spark: SparkSession = field(repr=False)
    path: str
    buckets: int = 64
    fold: bool = False
    stem: object = None

    # Writing

    def _manifest(self) -> list:
        reader = self.spark.read.schema(MANIFEST)
        try:
            return reader.parquet(f"{self.path}/manifest").orderBy("segment").collect()  # one row a segment
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return []
            raise

    def _tokens(self, nodes: DataFrame) -> DataFrame:
        cols = [tokens(F.array_join("tags", " ") if c == "tags" else F.col(c), self.fold).alias(f"f{k}") for k, c in enumerate(FIELDS)]
        t = nodes.select("id", *cols)
        return self.stem(t, ["f0", "f1", "f2"]) if self.stem else t

    def add(self, nodes: DataFrame, removed: DataFrame | None = None) -> TextIndex:
        """A new segment of nodes (id, title, content, tags), which replace those of their ids; `removed` ids go.

        Of rows of one id in `nodes` any one is taken; null ids are left out.
        """
        known = self._manifest()
        segment = len(known) and known[-1]["segment"] + 1
        t, kind = self._tokens(nodes.where("id is not null").dropDuplicates(["id"])), dict(nodes.dtypes)["id"]
        ids = nodes.where("id is not null").select("id").distinct()
        sizes = F.size("f0") + F.size("f1") + F.size("f2")
        found = t.select("id", sizes.cast("bigint").alias("n"), "f0", "f1", "f2").mapInArrow(_posted, f"term string, id {kind}, n bigint, tf0 int, tf1 int, tf2 int, places array<bigint>")
        path = f"{self.path}/postings/segment={segment}"
        self._write_postings(found.withColumn("bucket", _bucket(F.col("term"), self.buckets)), path, ids.count())
        # every posting holds its node's number of tokens, so that the texts are cut into tokens once
        sized = self.spark.read.schema(f"id {kind}, n bigint").parquet(path).groupBy("id").agg(F.max("n").alias("n"))
        ids.join(sized, "id", "left").fillna(0, ["n"]).write.mode("overwrite").parquet(f"{self.path}/docs/segment={segment}")
        docs = self.spark.read.schema(f"id {kind}, n bigint").parquet(f"{self.path}/docs/segment={segment}")
        have = docs.agg(F.count("*").alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b")).first()

        gone = None
        if known:
            live = self._live_docs(known)
            out = docs.select("id") if removed is None else docs.select("id").union(removed.select("id")).distinct()
            live.join(out, "id", "left_semi").select("id", "n").write.mode("overwrite").parquet(f"{self.path}/gone/segment={segment}")
            gone = self.spark.read.parquet(f"{self.path}/gone/segment={segment}").agg(F.count("*").alias("a"), F.coalesce(F.sum("n"), F.lit(0)).alias("b")).first()
        row = (segment, have["a"], have["b"], gone["a"] if gone else 0, gone["b"] if gone else 0, self.buckets, self.fold, self.stem is not None, dict(nodes.dtypes)["id"])
        self.spark.createDataFrame([row], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.path}/manifest")
        return self

    def _write_postings(self, rows: DataFrame, path: str, docs: int) -> None:
        """Rows by bucket and term; a bucket is dealt over more tasks with more nodes, since each may hold one term."""
        salt = F.pmod(F.xxhash64("id"), F.lit(1 + docs // NODES_A_FILE))
        n = self.parallelism()
        rows.repartition(n, "bucket", salt).sortWithinPartitions("bucket", "term").write.mode("overwrite").partitionBy("bucket").parquet(path)

    def remove(self, ids: DataFrame) -> TextIndex:
        """The nodes of ids (column id) are found no more."""
        kind = dict(ids.dtypes)["id"]
        return self.add(self.spark.createDataFrame([], f"id {kind}, title string, content string, tags array<string>"), ids)

    def compact(self, path: str) -> TextIndex:
        """One segment without what is gone, at a new path."""
        known, out = self._manifest(), TextIndex(self.spark, path, self.buckets, self.fold, self.stem)
        docs, found = self._live_docs(known).drop("segment"), self._postings(known).drop("segment")
        docs.write.parquet(f"{path}/docs/segment=0")
        docs_n, total, _ = self.totals(known)
        self._write_postings(found, f"{path}/postings/segment=0", docs_n)
        self.spark.createDataFrame([(0, docs_n, total, 0, 0, self.buckets, self.fold, self.stem is not None, known[-1]["id_type"])], MANIFEST).coalesce(1).write.parquet(f"{path}/manifest")
        return out

    # Reading

    def _gone(self, known: list) -> DataFrame | None:
        """(id, below): of each id the last segment that takes its earlier rows away."""
        parts = [k["segment"] for k in known if k["gone_docs"]]
        if not parts:
            return None
        each = [self.spark.read.parquet(f"{self.path}/gone/segment={s}").select("id", F.lit(s).alias("below")) for s in parts]
        return reduce(DataFrame.unionByName, each).groupBy("id").agg(F.max("below").alias("below"))

    def _without_gone(self, rows: DataFrame, known: list) -> DataFrame:
        gone = self._gone(known)
        return rows if gone is None else rows.join(gone, "id", "left").where("below is null or segment >= below").drop("below")

    def _live_docs(self, known: list) -> DataFrame:
        each = [self.spark.read.schema(f"id {k['id_type']}, n bigint").parquet(f"{self.path}/docs/segment={k['segment']}").withColumn("segment", F.lit(k["segment"])) for k in known]
        return self._without_gone(reduce(DataFrame.unionByName, each), known)

    def _postings(self, known: list, terms: list[str] | None = None) -> DataFrame:
        schema = f"term string, id {known[-1]['id_type']}, n bigint, tf0 int, tf1 int, tf2 int, places array<bigint>, bucket int"
        each = []
        for k in known:
            if k["docs"]:
                rows = self.spark.read.schema(schema).parquet(f"{self.path}/postings/segment={k['segment']}")
                if terms is not None:
                    rows = rows.where(F.col("bucket").isin(sorted({zlib.crc32(t.encode()) % self.buckets for t in terms})) & F.col("term").isin(sorted(terms)))
                each.append(rows.withColumn("segment", F.lit(k["segment"])))
        rows = reduce(DataFrame.unionByName, each) if each else self.spark.createDataFrame([], schema + ", segment int")
        return self._without_gone(rows, known)

    def totals(self, known: list | None = None) -> tuple[int, int, int]:
        """Live nodes, their tokens and the number of segments."""
        known = self._manifest() if known is None else known
        return sum(k["docs"] - k["gone_docs"] for k in known), sum(k["tokens"] - k["gone_tokens"] for k in known), len(known)

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(term, id, n, tf0, tf1, tf2, places, bucket) of live nodes; of the given terms, which are taken as stored."""
        return self._postings(self._manifest(), terms).drop("segment")

    def terms(self) -> DataFrame:
        """(term, docs, n): live document and term frequencies, over all fields."""
        return self.postings().groupBy("term").agg(F.count("*").alias("docs"), F.sum(F.expr("tf0 + tf1 + tf2")).alias("n"))

    def parallelism(self) -> int:
        return max(1, int(self.spark.conf.get("spark.sql.shuffle.partitions")))

    def counts(self, keys: DataFrame, weights: tuple[float, ...]) -> DataFrame:
        """(key, id, n, tf): the weighted counts of many terms (key, parts: its words; several are a phrase)."""
        split = keys.select("key", F.posexplode("parts").alias("k", "term"), F.size("parts").alias("parts")).withColumn("bucket", _bucket(F.col("term"), self.buckets))
        found = self.postings().join(split, ["bucket", "term"])
        single = found.where("parts = 1").select("key", "id", "n", _sum(weights, lambda k: F.col(f"tf{k}")).alias("tf"))
        starts = found.where("parts > 1").select("key", "id", "n", "parts", F.explode("places").alias("at"), "k").withColumn("at", F.col("at") - F.col("k"))
        whole = starts.groupBy("key", "id", "n", "parts", "at").agg(F.count("*").alias("met")).where("met = parts")
        phrases = whole.groupBy("key", "id", "n").agg(_sum(weights, lambda k: F.sum((F.floor(F.col("at") / SPAN) == k).cast("int"))).alias("tf"))
        return single.unionByName(phrases)

    def search(self, query: list[str], weights: tuple[float, ...], mode: str = "and_or") -> DataFrame:
        """(id, score) as search.bm25 over the nodes, read from the buckets of the query's terms."""
        known = self._manifest()
        query = self.stem(None, query) if self.stem else query
        parts = [phrase(t) for t in query]
        words = sorted({w for p in parts for w in p})
        if not known or not words:
            kind = known[-1]["id_type"] if known else "bigint"
            return self.spark.createDataFrame([], f"id {kind}, score double")
        docs, total, _ = self.totals(known)
        rows = self._postings(known, words)
        place = {w: F.max(F.when(F.col("term") == w, F.col("places"))) for w in words if any(w in p and len(p) > 1 for p in parts)}
        single = {w: [F.coalesce(F.sum(F.when(F.col("term") == w, F.col(f"tf{k}"))), F.lit(0)) for k in range(len(FIELDS))] for w in words}
        aggs = [c.alias(f"p{words.index(w)}") for w, c in place.items()] + [c.alias(f"c{words.index(w)}_{k}") for w, cs in single.items() for k, c in enumerate(cs)]
        each = rows.groupBy("id").agg(F.max("n").alias("n"), *aggs)
        tf = [_weighted(p, words, weights) for p in parts]
        return scored(each.select("id", "n", F.array(*tf).alias("tf")), len(parts), mode, float(docs), total / docs if docs else 0.0)


_STORED: dict[tuple, TextIndex] = {}


def stored(spark: SparkSession, name: str, nodes: Callable[[], DataFrame], **options) -> TextIndex:
    """The index called `name` in the shared folder, built once an application from the nodes."""
    key = (spark.sparkContext.applicationId, name, *options.items())
    if key not in _STORED:
        _STORED[key] = TextIndex(spark, scratch_path(spark, "text-index"), **options).add(nodes())
    return _STORED[key]


def _posted(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Postings of rows (id, n, tokens of each field): a node's tokens stand together, so that nothing is shuffled."""
    for x in frames:
        lists = x.columns[2:]
        sizes = [np.diff(c.offsets.to_numpy()) for c in lists]
        owner = np.concatenate([np.repeat(np.arange(x.num_rows), s) for s in sizes])
        at = np.concatenate([np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s) + k * SPAN for k, s in enumerate(sizes)])
        terms = pa.concat_arrays([c.flatten() for c in lists]).dictionary_encode()
        code = terms.indices.to_numpy()
        order = np.lexsort((at, code, owner))
        owner, code, at = owner[order], code[order], at[order]
        new = np.flatnonzero(np.concatenate(([True], (owner[1:] != owner[:-1]) | (code[1:] != code[:-1])))[: len(owner)])
        tf = [np.add.reduceat((at // SPAN == k).astype(np.int32), new) if len(new) else new for k in range(len(FIELDS))]
        places = pa.ListArray.from_arrays(pa.array(np.append(new, len(at)).astype(np.int32)), pa.array(at))
        who = pa.array(owner[new])
        columns = [terms.dictionary.take(pa.array(code[new])), x.column(0).take(who), x.column(1).take(who), *(pa.array(c.astype(np.int32)) for c in tf), places]
        yield pa.RecordBatch.from_arrays(columns, names=["term", "id", "n", "tf0", "tf1", "tf2", "places"])


def _bucket(term: Column, buckets: int) -> Column:
    return (F.crc32(F.encode(term, "UTF-8")) % buckets).cast("int")


def _sum(weights: tuple[float, ...], count: Callable[[int], Column]) -> Column:
    return reduce(Column.__add__, [F.lit(float(w)) * count(k) for k, w in enumerate(weights)])


def _weighted(parts: list[str], words: list[str], weights: tuple[float, ...]) -> Column:
    """The weighted count of a term, or of a phrase from the places of its words."""
    if len(parts) == 1:
        return _sum(weights, lambda k: F.col(f"c{words.index(parts[0])}_{k}"))
    both = reduce(F.array_intersect, [_shifted(F.col(f"p{words.index(w)}"), k) for k, w in enumerate(parts)])
    return _sum(weights, lambda k: F.coalesce(F.size(_inside(both, k)), F.lit(0)))


def _shifted(places: Column, by: int) -> Column:
    return F.transform(places, lambda x: x - by)


def _inside(places: Column, field: int) -> Column:
    return F.filter(places, lambda x: F.floor(x / SPAN) == field)
