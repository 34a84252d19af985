"""The stored index against the scan, over upserts, removals and compaction."""

import random

import pytest
from pyspark.sql import functions as F

from recollect.functions.porter import stemming
from recollect.model import PARAMS, nodes
from recollect.operators import search
from recollect.sources.fulltext import TextIndex

SF = "/root/testdata/sf0.001"
SCHEMA = "id string, title string, content string, tags array<string>"
QUERIES = [(["alpha", "beta"], "and"), (["alpha", "about_self"], "or"), (["the", "nosuchword"], "and_or"), (["gamma_beta", "alpha", "alpha"], "and_or")]


def made(rng, ids):
    words = ["alpha", "beta", "gamma", "the", "Été", "about", "self", "x1", "running"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(rng.randint(0, n)))
    return [(i, rng.choice([None, text(4)]), rng.choice([None, "", text(30), text(30)]), rng.choice([None, [], ["about_self"], ["alpha", "beta"]])) for i in ids]


def rows(df):
    return sorted((r.id, r.score) for r in df.collect())


def same(index, live, stem=None, fold=False, queries=QUERIES):
    for terms, mode in queries:
        assert rows(index.search(terms, PARAMS.field_weights, mode)) == rows(search.bm25(live, terms, mode=mode, stem=stem, fold=fold)), (terms, mode)


@pytest.mark.parametrize("stem", [None, stemming])
def test_upserts_equal_a_rebuild(spark, tmp_path, stem):
    rng = random.Random(5)
    first = made(rng, [f"n{i}" for i in range(60)])
    index = TextIndex(spark, f"file://{tmp_path}/index", buckets=8, stem=stem, fold=bool(stem)).add(spark.createDataFrame(first, SCHEMA))
    same(index, spark.createDataFrame(first, SCHEMA), stem, bool(stem), QUERIES[:1])
    if stem:
        assert rows(index.search(["runs"], PARAMS.field_weights)) == rows(index.search(["running"], PARAMS.field_weights)) != []
        return
    second = made(rng, [f"n{i}" for i in range(40, 90)])
    index.add(spark.createDataFrame([*second, (None, "alpha", "alpha", None)], SCHEMA))
    live = {r[0]: r for r in first} | {r[0]: r for r in second}
    index.remove(spark.createDataFrame([("n3",), ("n50",), ("unknown",)], "id string"))
    third = made(rng, ["n3", "n41", "n90"])
    index.add(spark.createDataFrame(third, SCHEMA))
    live = {k: r for k, r in live.items() if k not in ("n3", "n50")} | {r[0]: r for r in third}
    whole = spark.createDataFrame(list(live.values()), SCHEMA)
    same(index, whole)
    again = index.compact(f"file://{tmp_path}/compact")
    same(again, whole, queries=QUERIES[1:2])
    rebuilt = TextIndex(spark, f"file://{tmp_path}/rebuilt", buckets=8).add(whole)
    assert index.totals()[:2] == again.totals()[:2] == rebuilt.totals()[:2] and again.totals()[2] == 1
    listed = [sorted((r.term, r.docs, r.n) for r in x.terms().collect()) for x in (index, again, rebuilt)]
    assert listed[0] == listed[1] == listed[2]


def test_an_unfinished_segment_is_not_read(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/index").add(spark.createDataFrame([("a", "alpha", "", None)], SCHEMA))
    spark.createDataFrame([("b", 1)], "id string, n bigint").write.parquet(f"file://{tmp_path}/index/docs/segment=1")
    assert [r[0] for r in rows(index.search(["alpha"], PARAMS.field_weights))] == ["a"]
    index.add(spark.createDataFrame([("c", "alpha", "", None)], SCHEMA))
    assert [r[0] for r in rows(index.search(["alpha"], PARAMS.field_weights))] == ["a", "c"]


def test_nothing_stored(spark, tmp_path):
    index = TextIndex(spark, f"file://{tmp_path}/none")
    assert index.search(["alpha"], PARAMS.field_weights).collect() == index.search([], PARAMS.field_weights).collect() == []
    index.add(spark.createDataFrame([], SCHEMA))
    assert index.search(["alpha"], PARAMS.field_weights).collect() == []


def test_a_search_reads_the_buckets_of_its_terms(spark, tmp_path):
    n = nodes(spark, SF)
    index = TextIndex(spark, f"file://{tmp_path}/index").add(n)
    found = index.search(["token", "the"], PARAMS.field_weights, "or")
    assert rows(found) == rows(search.bm25(n, ["token", "the"], mode="or"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan
    assert "PushedFilters" in plan and "In(term" in plan
    read = {f.split("/bucket=")[1].split("/")[0] for f in index.postings(["the"]).select(F.input_file_name().alias("f")).toPandas()["f"]}
    assert len(read) == 1
