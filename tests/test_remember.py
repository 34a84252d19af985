"""Links on remembering, ingestion and the order-dependent rules, against loops."""

import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.model import now
from recollect.operators import pairs, remember


def unit(rng, n, d=6):
    x = np.array([[rng.gauss(0, 1) for _ in range(d)] for _ in range(n)])
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


def test_remembering_in_portions_links_as_all_at_once(spark):
    rng = random.Random(1)
    v = unit(rng, 90)
    rows = [(i, v[i].tolist(), i) for i in range(90)]
    new = spark.createDataFrame(rows, "id bigint, embedding array<float>, place bigint")
    nodes = spark.createDataFrame([(i, [None, "", "s", "t"][i % 4]) for i in range(90)], "id bigint, space string")
    old = spark.createDataFrame([(5, 3, "related_to", 0.5)], "source_id bigint, target_id bigint, edge_type string, weight double")
    plain = lambda df: sorted((r.source_id, r.target_id, r.weight) for r in df.collect())
    whole = plain(remember.links_on_remember(new, nodes, None, old, now(), 0.5))
    want, s = [], np.round(v.astype(np.float64) @ v.astype(np.float64).T, 6)
    for i in range(90):
        for j in sorted(range(i), key=lambda j: (-s[i, j], j))[:6]:
            at = round(s[i, j] - (0.1 if ([None, "", "s", "t"][i % 4] or "") != ([None, "", "s", "t"][j % 4] or "") else 0), 6)
            if at >= 0.5 and {i, j} != {5, 3}:
                want.append((i, j, round(at, 3)))
    assert [w[:2] for w in whole] == [w[:2] for w in sorted(want)] and np.allclose([w[2] for w in whole], [w[2] for w in sorted(want)], atol=0.0011)
    halves = remember.links_on_remember(new.where("id < 40"), nodes, None, old, now(), 0.5)
    later = remember.links_on_remember(new.where("id >= 40"), nodes, new.where("id < 40"), old, now(), 0.5)
    assert plain(halves.union(later)) == whole
    assert remember.links_on_remember(new.limit(0), nodes, new, old, now()).collect() == []


def test_answers_become_memories(spark):
    long = "a conversation of more than fifty characters, at least one more"
    item = {"content": " Likes tea. ", "type": "preference", "title": "", "tags": ["x"], "about_self": True, "confidence": 0.9, "more": {"a": 1}}
    answers = [
        (1, long, json.dumps({"memories": [item, "no object", {"content": " "}, {"title": "t"}, {"content": "Second\nline", "type": "odd"}]})),
        (2, long, "Sure:\n```json\n" + json.dumps([item]) + "\n```"), (3, long, json.dumps({"memories": {"memories": {"memories": [item]}}})),
        (4, "short", json.dumps([item])), (5, long, "no answer"), (6, long, None), (7, None, json.dumps([item])), (8, long, '{"memories": 3}'), (9, long, "[]"),
    ]
    got = remember.memories_in(spark.createDataFrame(answers, "conv_id bigint, content string, answer string"), ["more"])
    rows = sorted((r.conv_id, r.item, r.content, r.title, r.type, r.tags, r.about_self, r.confidence) for r in got.collect())
    tea = ("Likes tea.", "Likes tea.", "preference", ["x", "auto-ingested", "more"], True, 0.9)
    assert rows == [(1, 0, *tea), (1, 4, "Second\nline", "Second", "fact", ["auto-ingested", "more"], False, 0.7), (2, 0, *tea), (3, 0, *tea)]


@pytest.mark.parametrize("threshold", [0.3, 0.8])
def test_items_are_taken_in_order(spark, threshold):
    rng = random.Random(4)
    v = unit(rng, 150)
    order = list(range(150))
    rng.shuffle(order)
    items = [(i, order[i], v[i].tolist() if i % 9 else None) for i in range(120)]
    s, taken = v.astype(np.float64) @ v.astype(np.float64).T, []
    for i, _, e in sorted(items, key=lambda r: r[1]):
        if e is None or (not any(s[i, j] >= threshold for j in range(120, 150)) and not any(s[i, j] >= threshold for j in taken if j % 9)):
            taken.append(i)
    got = remember.new_memories(spark.createDataFrame(items, "id bigint, place bigint, embedding array<float>"), spark.createDataFrame([(i, v[i].tolist()) for i in range(120, 150)], "id bigint, embedding array<float>"), threshold)
    assert sorted(r.id for r in got.collect()) == sorted(taken)


def test_chains_settle_in_few_rounds(spark, monkeypatch):
    n, written = 5000, []
    plain = pairs.__dict__.get("staged") or __import__("recollect.sources.tables", fromlist=["staged"]).staged
    monkeypatch.setattr("recollect.sources.tables.staged", lambda df, name: written.append(name) or plain(df, name))
    monkeypatch.setattr(remember, "staged", lambda df, name: written.append(name) or plain(df, name))
    items = spark.range(n).select("id", F.col("id").alias("place"))
    chain = spark.range(n - 1).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    assert [r.id for r in remember.first_taken(items, chain).orderBy("id").collect()] == list(range(0, n, 2))
    near = chain.select(F.col("a").alias("id"), F.col("b").alias("other"), F.lit(0.9).alias("similarity"))
    nodes = spark.range(n).select("id", F.lit("working").alias("tier"), F.lit("x").alias("content"), F.lit("2024-01-01").alias("updated"))
    got = sorted((r.seed, r.id) for r in pairs.clusters(near, nodes).collect())
    assert got == [(s, i) for s in range(0, n, 2) for i in (s, s + 1)]
    scored = chain.withColumn("score", 1 - F.col("a") / 10000)
    assert sorted((r.keep, r.drop) for r in pairs.merge_plan(scored, nodes).collect()) == [(a, a + 1) for a in range(0, n - 1, 2)]
    assert len(written) < 3 * 10


def test_a_store_may_have_other_ids_than_the_items(spark):
    """the store's ids are of no use to ingest, and none is null on the way to the workers."""
    v = unit(random.Random(6), 40)
    items = spark.createDataFrame([(f"m{i}", i, v[i].tolist()) for i in range(20)], "id string, place bigint, embedding array<float>")
    stored = spark.createDataFrame([(i, v[i].tolist()) for i in range(15, 40)], "id bigint, embedding array<float>")
    s = v.astype(np.float64) @ v.astype(np.float64).T
    taken = []
    for i in range(20):
        if not any(s[i, j] >= 0.8 for j in [*range(15, 40), *taken]):
            taken.append(i)
    assert sorted(r.id for r in remember.new_memories(items, stored, 0.8).collect()) == sorted(f"m{i}" for i in taken)
