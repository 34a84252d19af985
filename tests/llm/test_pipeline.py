"""The queries and the pipeline of the training-data operators."""

import re

import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from recollect.llm import queries
from tests.llm.test_copies import _groups
from tests.llm.test_documents import _folded, _personal
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_queries_have_the_rows_of_their_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLE[name], SF)


def test_every_operator_has_one_query():
    assert [int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES] == list(range(1, 14))


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        before, docs = docs, stage(spark, docs, SF).cache()
        kept[name] = {r.doc_id: r for r in docs.collect()}
        if name != "bpe":
            assert docs.columns == columns
        if name == "quality":
            labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
            wrong = sum((i in kept[name]) != (q == 1) for i, q in labels.items())
            assert wrong <= 0.03 * len(labels)
        if name == "near_duplicates":
            ids, texts = zip(*sorted((r.doc_id, r.text) for r in before.collect()), strict=True)
            least, beyond = _groups(texts)
            assert kept[name].keys() == {ids[k] for k in least} and beyond > 0
        if name == "decontaminate":
            windows = {tuple(w[k : k + 10]) for (t,) in spark.read.parquet(f"{SF}/benchmark.parquet").select("text").collect() for w in [_folded(t)] for k in range(max(1, len(w) - 9))}
            assert not [i for i, r in kept[name].items() for w in [_folded(r.text)] if any(tuple(w[k : k + 10]) in windows for k in range(len(w)))]
            assert kept[name].keys() == kept["near_duplicates"].keys()
        if name == "pii":
            assert not [i for i, r in kept[name].items() if _personal(r.text)]
            assert all(r.n_chars == len(r.text) for r in kept[name].values())
    library = Tokenizer.from_file(queries.VOCABULARY)
    for i, r in kept["bpe"].items():
        assert r.ids == library.encode(kept["pii"][i].text, add_special_tokens=False).ids
    again = corpus_pipeline.run(spark, SF)
    assert {(r.doc_id, r.n_tokens) for r in again.select("doc_id", "n_tokens").collect()} == {(i, len(r.ids)) for i, r in kept["bpe"].items()}


def test_rows_of_the_scored_queries(spark):
    for name, label, parts, held, least in (("op3_quality", "quality", 3, 1, 0.5), ("op7_toxicity", "toxic", 4, 2, 0.3)):
        r = queries.QUERIES[name](spark, SF)
        assert r.columns == ["doc_id", "held_out", "score", "predicted"] and r.count() == 200
        assert r.where((F.col("predicted") == 1) != (F.col("score") >= least)).count() == 0
        assert r.where(F.col("held_out") != (F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts == held)).count() == 0
