"""Recall for many prompts against recall for each by itself."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recollect.functions.temporal import only_time, window, without_phrases
from recollect.model import PARAMS, edges, nodes, now, vectors
from recollect.operators import batch, graph, search
from recollect.sources.fulltext import TextIndex
from recollect.sources.tables import staged

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def store(spark, tmp_path_factory):
    n = staged(nodes(spark, SF), "nodes")
    index = TextIndex(spark, f"file://{tmp_path_factory.mktemp('index')}/x").add(n.select("id", "title", "content", "tags"))
    return n, staged(vectors(spark, SF), "vectors"), index, staged(edges(spark, SF), "edges")


def one(spark, store, prompt, embedding, limit, params):
    """The same by the operators for one prompt."""
    n, v, _, e = store
    text = spark.createDataFrame([(prompt or "",)], "p string")
    timed = text.select(batch.has_phrase(F.col("p")).alias("t"), window(F.col("p"), now()).alias("w"), without_phrases(F.col("p")).alias("q")).first()
    query = timed.q if timed.t else prompt or ""
    condition = (F.col("created") >= F.lit(timed.w.after)) & (F.col("created") <= F.lit(timed.w.before)) if timed.t else None
    found = staged(search.recall(n, v, query, embedding, now(), limit, condition, params).select("id", "score", "source"), "one")
    if timed.t:
        if spark.createDataFrame([(query,)], "q string").select(only_time(F.col("q"))).first()[0]:
            found = found.limit(0)
        columns = n.select("id", "created", F.lit(0.0).alias("score"), F.lit("").alias("source"))
        found = staged(search.with_recent(found.join(n.select("id", "created"), "id"), columns.drop("score", "source"), condition, limit).select("id", "score", "source"), "filled")
    return sorted(map(tuple, graph.activate(found, e, n, params).select("id", "score", "source", "activated_by").collect()))


def test_each_prompt_gets_what_it_gets_alone(spark, store, monkeypatch):
    monkeypatch.setattr(batch, "GROUP", 3)
    rng = random.Random(2)
    some = store[1].collect()
    content = [r.content for r in store[0].orderBy("id").limit(60).collect()]
    topic = lambda: " ".join(rng.choice(content).split()[3:9])
    prompts = [topic(), topic() + " last month", "what did we do in the past 31 days", "where is " + topic(), "the", "", None, "my " + topic(), topic() + " foo_bar"]
    rows = [(k, p, some[k].embedding if k % 3 else None) for k, p in enumerate(prompts)] + [(None, "none", None)]
    params = batch.Params(similarity_threshold=0.1, min_result_score=0.0)
    df = spark.createDataFrame(rows, "prompt_id bigint, prompt string, embedding array<float>")
    n, v, index, e = store
    got = batch.recall_all(df, n, v, index, e, now(), 6, params)
    found = {k: [] for k in range(len(prompts))}
    for r in got.collect():
        found[r.prompt_id].append((r.id, r.score, r.source, r.activated_by))
    sources = {x[2] for rs in found.values() for x in rs}
    assert sources >= {"hybrid", "temporal", "activated"}
    for k, prompt, embedding in rows[:-1]:
        assert sorted(found[k]) == one(spark, store, prompt, embedding, 6, params), prompt
    hits = {r.id: r.touches for r in batch.touches(got).collect()}
    direct = [x[0] for rs in found.values() for x in rs if x[2] in ("hybrid", "temporal")]
    assert hits == {i: direct.count(i) for i in set(direct)}


def test_touches_fold_one_after_another(spark):
    n = spark.createDataFrame([(1, 2.0, 3, "2024-01-01"), (2, None, 0, "2024-01-01"), (3, 5.0, 1, "2024-01-01")], "id bigint, stability double, access_count bigint, at string").withColumn("last_accessed", F.to_timestamp("at")).drop("at")
    hits = spark.createDataFrame([(1, 3), (2, 1)], "id bigint, touches bigint")
    from recollect.operators.lifecycle import touch

    want = n
    for ids in ([1, 2], [1], [1]):
        want = touch(want, spark.createDataFrame([(i,) for i in ids], "id bigint"), now())
    assert sorted(map(tuple, batch.touch_all(n, hits, now()).collect())) == sorted(map(tuple, want.collect()))
    assert PARAMS.stability_cap >= 1


def test_a_block_scores_many_prompts_as_one_by_one(monkeypatch):
    """Common terms by a matrix, rare ones by their lists, the nodes with every term apart; ties by id."""
    monkeypatch.setattr(batch, "MATRIX", 90)  # three of the common terms
    rng = random.Random(5)
    held = {(key, node): rng.choice([0.5, 1.0, 2.0]) for key in range(12) for node in range(30) if rng.random() < (0.9 if key < 6 else 0.04)}
    block = batch._Block(np.array([k for k, _ in held]), pa.array([f"n{i:02}" for _, i in held]), np.array(list(held.values())))
    assert len(block.matrix) == 3
    rows = [(f"p{p}", key, rng.choice([0.25, 1.0])) for p in range(40) for key in sorted(rng.sample(range(15), 1 + p % 5))]
    got = batch._scored(block, pa.table({"prompt_id": [r[0] for r in rows], "key": [r[1] for r in rows], "x": [r[2] for r in rows]}), 4).to_pylist()
    want = set()
    for p in {r[0] for r in rows}:
        asked = [(key, x) for q, key, x in rows if q == p]
        scores = {i: sum(x * held.get((key, i), 0) for key, x in asked) for i in range(30)}
        every = {i for i in range(30) if all((key, i) in held for key, _ in asked)}
        best = lambda nodes: sorted(nodes, key=lambda i: (-round(scores[i], 6), i))[:4]  # noqa: B023, E731
        want |= {(p, f"n{i:02}", round(scores[i], 6), i in every) for i in [*best([i for i in scores if scores[i] > 0]), *best(every)]}
    assert len(got) == len(want) and {(r["prompt_id"], r["id"], r["score"], r["every"]) for r in got} == want


def test_postings_travel_once_for_all_prompts(spark, store):
    """However many groups of prompts there are, a posting is dealt to its block alone."""
    words = " ".join(store[0].orderBy("id").first().content.split()[3:9])
    asked = spark.range(5000).select(F.col("id").alias("prompt_id"), F.lit(words).alias("prompt"), F.lit(None).cast("array<float>").alias("embedding"))
    lists = batch.text_lists(staged(batch.plan(asked, now()), "prompts"), store[2], 3)
    each = lists.select("id", "score", "rank").distinct().count()
    assert each > 0 and lists.count() == 5000 * each
    assert "CoGroup" not in lists._jdf.queryExecution().toString()
