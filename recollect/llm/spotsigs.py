"""SpotSigs fingerprints: chains of content words after common-word anchors, compared by pruned Jaccard."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import MULTIPLIER, hashed_words, map_texts, parallelism, prepare, staged

#: Common words of English, French, German and Spanish, which anchor the signatures.
COMMON = """
the of and to in is it that was for on are with as be at by this from or an have not but they which
le la les de des du et un une que qui dans pour par sur est en au ne pas se il elle ce
der die das und den dem ein eine ist von zu mit sich auf nicht auch im es sie er wie aus
el los las y del una por con para se su al lo como no
""".split()
CHAIN = 2
#: A text with more content words than this for each anchor gets the signatures of its runs of words too.
SPARSE = 8
#: Bytes of words in lower-cased text: ASCII letters and digits, and all non-ASCII characters.
IS_WORD = np.array([b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 for b in range(256)])
_ANCHORS = np.unique(np.concatenate([hashed_words(w.encode(), IS_WORD)[2] for w in COMMON]))


def signatures(text: str | None, chain: int = CHAIN) -> np.ndarray:
    """The distinct signatures of a text, sorted; never none.

    A signature is an anchor with the `chain` content words (those that are no anchors) that follow it, or
    as many as there are. A text without anchors, without content words or with over SPARSE content words for each
    anchor has a signature for each run of `chain` words too, so that short lines, lists, tables and other
    languages are told apart by all their words; one without words has that of the empty text.
    """
    _, _, h = hashed_words((text or "").lower().encode("utf-8", "surrogatepass"), IS_WORD)
    at = np.minimum(np.searchsorted(_ANCHORS, h), len(_ANCHORS) - 1)
    common = _ANCHORS[at] == h
    content, out = h[~common], np.empty(0, np.uint64)
    after = np.cumsum(~common)[common]  # content words before the anchor: the index of the next one
    if len(content):
        out, padded = h[common], np.concatenate((content, np.zeros(chain, np.uint64)))
        for j in range(chain):
            out = (out * MULTIPLIER) ^ padded[np.minimum(after + j, len(padded) - 1)]
            out ^= out >> np.uint64(31)
    if not len(content) or len(content) > SPARSE * len(after):
        run, padded = h.copy(), np.concatenate((h, np.zeros(chain, np.uint64)))
        for j in range(1, chain):
            run = (run * MULTIPLIER) ^ padded[j : j + len(h)]
            run ^= run >> np.uint64(31)
        out = np.concatenate((out, run))
    return np.unique(out * MULTIPLIER) if len(out) else np.zeros(1, np.uint64)


def fingerprint(sigs: np.ndarray) -> str:
    """A name for the set of signatures: its size and a 128-bit digest."""
    return f"{len(sigs)}-{xxhash.xxh3_128_hexdigest(sigs.tobytes())}"


def jaccard(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard similarity of two sorted sets."""
    both = len(a) + len(b) - len(np.union1d(a, b))
    return both / (len(a) + len(b) - both)


def fingerprints(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """docs' other columns with fingerprint string and signatures array<bigint>.

    Equal texts have equal fingerprints; null is as empty. Columns of those names are replaced.
    """
    prepare(docs.sparkSession)

    def work(texts: list) -> list:
        sets = [signatures(t) for t in texts]
        return [[fingerprint(s) for s in sets], [s.view(np.int64) for s in sets]]

    return map_texts(docs, text_col, "fingerprint string, signatures array<bigint>", lambda: work)


def near_pairs(prints: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(a, b, similarity) for pairs of distinct fingerprints whose sets' Jaccard similarity reaches threshold.

    `prints` is the result of fingerprints(); copies share a fingerprint and need no pairs. Sets are dealt
    into bands of set size, each 1/threshold as wide as it starts, and meet only their own band and the next.
    Similar sets share one of the first size - ceil(threshold * size) + 1 signatures in one order of all sets, the
    rarest first: by the number of sets that have the signature, from a count of all.
    """
    base = float(1 / threshold)
    sets = staged(prints.select("fingerprint", "signatures").dropDuplicates(["fingerprint"]).withColumn("n", F.size("signatures")), "sets")
    each = sets.select("fingerprint", "n", F.explode("signatures").alias("signature"))
    counted = each.join(each.groupBy("signature").agg(F.count("*").alias("times")), "signature")
    ordered = counted.groupBy("fingerprint", "n").agg(F.transform(F.sort_array(F.collect_list(F.struct("times", "signature"))), lambda x: x["signature"]).alias("signatures"))
    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(float(np.log(base))) + 1e-9).cast("int")
    lead = ordered.withColumn("band", band).withColumn("signature", F.explode(F.expr(f"slice(signatures, 1, n - CAST(ceil({threshold} * n - 1e-9) AS INT) + 1)")))
    left = lead.select(F.col("fingerprint").alias("a"), F.col("n").alias("na"), "signature", F.explode(F.array("band", F.col("band") + 1)).alias("band"))
    right = lead.select(F.col("fingerprint").alias("b"), F.col("n").alias("nb"), "signature", "band")
    met = left.join(right, ["signature", "band"]).where(f"(na < nb OR (na = nb AND a < b)) AND na >= {threshold} * nb - 1e-9").select("a", "b").distinct()
    sa = sets.select(F.col("fingerprint").alias("a"), F.col("signatures").alias("sa"))
    sb = sets.select(F.col("fingerprint").alias("b"), F.col("signatures").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    scored = met.join(sa, "a").join(sb, "b").withColumn("similarity", both / (F.size("sa") + F.size("sb") - both))
    return scored.where(F.col("similarity") >= threshold - 1e-9).select("a", "b", "similarity")


def _compare(ids: list, texts: list[str], sets: list[np.ndarray]) -> list[tuple]:
    """A result row for each text but the last, which is only the next of the one before."""
    rows = []
    for k in range(len(texts) - 1):
        text, half = texts[k], len(texts[k]) // 2
        edited = text[: len(text) - half] + texts[k + 1][:half]
        digest = hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest()
        other = signatures(edited)
        rows.append((ids[k], len(text), digest, fingerprint(sets[k]), fingerprint(other), jaccard(sets[k], other), jaccard(sets[k], sets[k + 1])))
    return rows


def edit_likeness(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's fingerprint against that of an edited form of it and of the next text, by descending id.

    The edited form has the last half of the characters replaced by the first as many, or all, of the next
    text; the last row's next is the first. Returns id_col, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next for every row. Null texts are empty; rows of one id follow
    each other in the order of a hash of their text; a null id comes last; a single row is its own next.

    Rows are dealt by range of id and walked in order. Only the first and last row of each range meet their
    neighbours in a second step, so that the texts are shuffled once and few of them are stored.
    """
    spark = prepare(docs.sparkSession)
    kind = dict(docs.dtypes)[id_col]
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(text_col, F.lit("")).alias("text"))
    named = F.col("id").cast("string").alias("id")  # pandas would make nullable integers floats
    order = [F.col("id").desc_nulls_last(), F.xxhash64("text")]
    result = ["id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
    schema = "id string, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def walk(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last = TaskContext.get().partitionId(), None
        for frame in frames:
            for lo in range(0, len(frame), 256):
                ids, texts = frame["id"].iloc[lo : lo + 256].tolist(), frame["text"].iloc[lo : lo + 256].tolist()
                sets = [signatures(t) for t in texts]
                ends = []
                if last is None:
                    ends = [(part, "head", ids[0], texts[0])]
                else:
                    ids, texts, sets = [last[0], *ids], [last[1], *texts], [last[2], *sets]
                last = (ids[-1], texts[-1], sets[-1])
                yield frame_of([*((part, "row", r[0], None, *r[1:]) for r in _compare(ids, texts, sets)), *((*e, *[None] * 6) for e in ends)])
        if last is not None:
            yield frame_of([(part, "tail", last[0], last[1], *[None] * 6)])

    def frame_of(out: list[tuple]) -> pd.DataFrame:
        x = pd.DataFrame(out, columns=["part", "kind", "id", "text", *result[1:]])
        return x.astype({"n_chars": "Int64", "near_edited": "float64", "near_next": "float64"})

    def meet(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in frames:
            out = []
            for i, text, after in zip(x["id"].tolist(), x["text"], x["after"], strict=True):
                out += _compare([i], [text, after], [signatures(text), signatures(after)])
            yield pd.DataFrame(out, columns=result)

    dealt = rows.repartitionByRange(parallelism(spark), *order).sortWithinPartitions(*order)
    walked = staged(dealt.select(named, "text").mapInPandas(walk, f"part int, kind string, id string, text string, {schema.partition(', ')[2]}"), "walked")
    ends = walked.where("kind <> 'row'").select("part", "kind", "id", "text")
    heads = ends.where("kind = 'head'").select("part", F.col("text").alias("after"))
    one_row_a_range = Window.orderBy("part")  # as many rows as ranges, whatever the data
    parts = heads.select("part").withColumn("_next", F.lead("part").over(one_row_a_range)).withColumn("_first", F.min("part").over(Window.partitionBy(F.lit(1))))
    turn = parts.select("part", F.coalesce("_next", "_first").alias("next"))
    tails = ends.where("kind = 'tail'").join(turn, "part").join(heads.withColumnRenamed("part", "next"), "next")
    met = tails.select("id", "text", "after").mapInPandas(meet, schema)
    return walked.where("kind = 'row'").select(*result).union(met).select(F.col("id").cast(kind).alias(id_col), *result[1:])
