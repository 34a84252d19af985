"""The corpus pipeline: five stages over `documents`, each written as Parquet and read again by the next.

Near-duplicates are texts whose five-word shingles have a Jaccard similarity of 0.8 or more, and those of the
SimHash operator's own contract: three-word shingles, three bits.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recollect.llm import bpe, copies, decontaminate, pii, quality, simhash
from recollect.llm.common import staged
from recollect.llm.queries import VOCABULARY, table


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score reaches the threshold, fitted on all labels; all, if nothing is labelled."""
    model = quality.train(docs, table(spark, sf_dir, "labels"), lambda i: F.lit(True))
    plain = [f"c{i}" for i in range(len(docs.columns))]
    scored = quality.score(docs.toDF(*plain), model, f"c{docs.columns.index('text')}", keep_text=True)
    return scored.where("score >= 0.5").select(*plain).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of the smallest id of each group of near copies."""
    return simhash.keep_first(docs, found=copies.near_copies(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the words inside windows of the benchmark."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind."""
    return pii.redact(docs, pii.train(docs))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digest of the text that they decode to."""
    found = bpe.encode_decode(docs.select("doc_id", "lang", "source", "text"), VOCABULARY)
    return found.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("quality", keep_good), ("near_duplicates", keep_one_of_each), ("decontaminate", cut_benchmark), ("pii", redact), ("bpe", tokenize)]
#: Fitted scores and fingerprints are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
