"""Texts for an agent, word by word."""

from pyspark.sql import functions as F

from recollect.model import now
from recollect.operators import formats

NODES = "id string, type string, tier string, space string, title string, content string"


def test_search_results_in_three_sections(spark):
    schema = "prompt_id int, id string, score double, source string, activated_by string, activation_edge string, type string, tier string, title string, content string, created timestamp"
    when = spark.sql("SELECT TIMESTAMP '2024-01-02 03:04:05' AS t").first().t
    rows = [
        (1, "b", 0.5, "hybrid", None, None, "fact", "core", "Title", " body ", when), (1, "a", 0.75, "temporal", None, None, "goal", "working", None, "x" * 201, None),
        (1, "c", 0.1, "activated", "abcdefghijk", "supports", "fact", "core", "", "first words", when), (1, "d", 0.2, "conflict", "b", "contradicts", "fact", "core", "D", None, when),
    ]
    got = {r.prompt_id: r.text for r in formats.search_results(spark.createDataFrame(rows, schema), spark.createDataFrame([(1,), (2,), (2,)], "prompt_id int")).collect()}
    assert got == {
        1: "Found 2 memories (+2 related):\n\n1. [goal] " + "x" * 60 + "...\n   ID: a | Tier: working | Score: 0.750 | Created: \n   " + "x" * 200 + "...\n\n"
        "2. [fact] Title\n   ID: b | Tier: core | Score: 0.500 | Created: 2024-01-02T03:04:05\n   body\n\n"
        "--- Related (via graph) ---\n\n1. [fact] first words\n   ID: c | Score: 0.100 | via supports from abcdefgh...\n   first words\n\n"
        "--- Conflicting context ---\n\n1. [fact] D\n   ID: d | Score: 0.200 | contradicts b...\n",
        2: formats.NOTHING,
    }


def test_pages_of_nodes(spark):
    nodes = spark.createDataFrame([("a", "fact", "core", None, "A", "body of a"), ("b", "goal", "working", "s", "", "body of b"), ("c", "fact", "core", "", "C", None)], NODES)
    edges = spark.createDataFrame([("a", "b", "supports", 0.55), ("gone", "a", "defines", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    got = {r.id: r.text for r in formats.node_pages(nodes, edges).collect()}
    assert got["c"] == "## [fact] C\nID: c\nTier: core | Space: unassigned"
    assert got["a"].startswith("## [fact] A\nID: a\nTier: core | Space: unassigned\n\nbody of a\n\n### Connections\n  → supports (0.")
    assert got["a"].endswith(") b\n  ← defines (1.0) gone\n\n---\n### Nearby Memories\n- [goal] body of b (id: b...)")
    assert "  ← supports (0." in got["b"] and got["b"].endswith("- [fact] A (id: a...)")


def test_sections_and_identities(spark):
    rows = spark.createDataFrame([(2, "second-long-id", "fact", "S", "text"), (1, "first", "person", "F", "")], "place int, id string, type string, title string, content string")
    assert formats.section(rows, "About the User", with_ids=True).first().text == "# About the User\n\n- **[person]** F (id: first)\n\n- **[fact]** S (id: second-l)\n  text\n"
    assert formats.section(rows.limit(0), "Project: p", empty=formats.NO_PROJECT).first().text == "# Project: p\n\n" + formats.NO_PROJECT
    people = spark.createDataFrame([(k, t) for k, t in enumerate(["person", "fact", "fact", "preference", "goal"])], "id int, type string")
    scores = spark.createDataFrame([(1, 0.2), (2, 0.9), (0, 0.1)], "id int, score double")
    kept = lambda most: sorted(r.id for r in formats.kept_identities(people, scores, most).collect())
    assert (kept(3), kept(4), kept(1), kept(10)) == ([0, 2, 3], [0, 1, 2, 3], [0, 3], [0, 1, 2, 3, 4])
    young = spark.range(5).withColumn("created", now())
    edges = spark.createDataFrame([(1, 2)], "source_id bigint, target_id bigint")
    assert [r[0] for r in formats.unprocessed(young, edges, now(), 3).collect()] == [4] and formats.unprocessed(young, edges, now(), 4).collect() == []
    assert formats.unprocessed(young.withColumn("created", F.lit("2020-01-01").cast("timestamp")), edges, now(), 0).collect() == []
