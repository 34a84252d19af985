"""Proposals, lookups, tombstones and provenance."""

from pyspark.sql import functions as F

from recollect.model import PROPOSAL_SCHEMA, now
from recollect.operators import proposals
from recollect.sources import lookup


def at(moment):
    return F.lit(moment).cast("timestamp")


def test_a_job_run_twice_proposes_once(spark):
    log = spark.createDataFrame([], PROPOSAL_SCHEMA)
    pairs = spark.createDataFrame([(1, 2, 0.7), (3, 4, 0.65), (5, 6, 0.8)], "keep bigint, drop bigint, score double")
    new = proposals.propose(log, pairs, "merge", at("2024-02-01"), "merge two memories")
    log = spark.createDataFrame(new.collect(), PROPOSAL_SCHEMA)
    assert log.count() == 3 and proposals.pending(log).count() == 3
    more = spark.createDataFrame([(2, 9, 0.9), (7, 8, 0.6), (1, 2, 0.7)], "keep bigint, drop bigint, score double")
    assert [r.source_nodes for r in proposals.propose(log, more, "merge", at("2024-02-02"), "a").collect()] == [["7", "8"]]
    ids = {tuple(r.source_nodes): r.id for r in log.collect()}
    said = spark.createDataFrame([(ids["1", "2"], "approved"), (ids["3", "4"], "rejected"), (ids["5", "6"], "odd"), ("unknown", "approved")], "id string, status string")
    done = spark.createDataFrame(proposals.resolve(log, said, at("2024-02-03")).collect(), PROPOSAL_SCHEMA)
    assert sorted(r.status for r in done.collect()) == ["approved", "rejected"]
    log = log.union(done)
    assert proposals.resolve(log, said, at("2024-02-04")).count() == 0
    again = said.where("status != 'odd'").withColumn("status", F.lit("rejected"))
    assert proposals.resolve(log, again, at("2024-02-05")).count() == 0
    assert {tuple(r.source_nodes): r.status for r in proposals.current(log).collect()} == {("1", "2"): "approved", ("3", "4"): "rejected", ("5", "6"): "pending"}
    assert [r.source_nodes for r in proposals.propose(log, pairs, "merge", at("2024-02-06"), "a").orderBy("source_nodes").collect()] == [["1", "2"], ["3", "4"]]

    nodes = spark.createDataFrame([(i, f"n{i}", ["t"]) for i in (1, 2, 3, 5, 6)], "id bigint, content string, tags array<string>").withColumn("updated", now())
    edges = spark.createDataFrame([(2, 5, "supports", 0.5)], "source_id bigint, target_id bigint, edge_type string, weight double").withColumn("created", now())
    clash = proposals.propose(log, spark.createDataFrame([(3, 5, 0.5), (3, 99, 0.5)], "keep bigint, drop bigint, score double"), "conflict", now(), "conflict").withColumn("status", F.lit("approved")).withColumn("resolved", now())
    n, e, history = proposals.apply(done.union(clash), nodes, edges, now())
    assert sorted(r.id for r in n.collect()) == [1, 3, 5, 6]
    assert sorted((r.source_id, r.target_id, r.edge_type) for r in e.collect()) == [(1, 5, "supports"), (3, 5, "contradicts")]
    assert [(r.kept_node_id, r.removed_node_id) for r in history.collect()] == [(1, 2)]


def test_lookups_read_the_files_they_need(spark, tmp_path):
    rows = spark.range(2000).select(F.sha2(F.col("id").cast("string"), 256).substr(1, 36).alias("id"), F.col("id").alias("n"))
    path = f"file://{tmp_path}/nodes"
    lookup.write_sorted(rows, path, 16)
    known = sorted(r.id for r in rows.collect())
    got = lookup.read_by_prefix(spark, path, [known[700][:5]])
    assert [r.id for r in got.orderBy("id").collect()] == [i for i in known if i.startswith(known[700][:5])]
    assert len(got.inputFiles()) <= 2 and len(spark.read.parquet(f"{path}/rows").inputFiles()) >= 12
    assert sorted(r.id for r in lookup.read_by_prefix(spark, path, ["zzz", known[3]]).collect()) == [known[3]]
    assert lookup.read_by_prefix(spark, path, ["zzz"]).collect() == lookup.read_by_prefix(spark, path, []).collect() == []
    asked = [known[5], known[9][:7], known[9][:1], "zzz", "", None]
    found = {r.asked: r.id for r in lookup.resolved_ids(spark.createDataFrame([(a,) for a in asked], "a string"), rows).collect()}
    assert found == {known[5]: known[5], known[9][:7]: min(i for i in known if i.startswith(known[9][:7])), known[9][:1]: min(i for i in known if i.startswith(known[9][:1]))}


def test_recall_of_nodes_and_of_the_own_profile(spark):
    nodes = spark.createDataFrame([("abc", "A", "a"), ("abd", "B", "b"), ("me", "Me", "m"), ("x", "X", "x")], "id string, title string, content string")
    edges = spark.createDataFrame([("abc", "x", "supports", 0.5), ("me", "abc", "defines", 1.0), ("x", "me", "defines", 1.0), ("me", "me", "defines", 1.0), ("abc", "gone", "supports", 0.1)], "source_id string, target_id string, edge_type string, weight double")
    got = {r.asked: (r.id, [(n.other, n.edge_type, n.other_title) for n in r.neighbours]) for r in lookup.recall_nodes(spark.createDataFrame([("ab",), ("abd",), ("none",)], "a string"), nodes, edges).collect()}
    assert got == {"ab": ("abc", [("me", "defines", "Me"), ("x", "supports", "X")]), "abd": ("abd", [])}
    assert sorted(r.id for r in lookup.self_profile(nodes, edges, "me").collect()) == ["abc", "x"]


def test_three_versions_of_files(spark):
    read = lambda rows: spark.createDataFrame(rows, "path string, content_hash string, node_ids array<string>")
    names = lambda rows: spark.createDataFrame([(r,) for r in rows], "path string")
    log = spark.createDataFrame([], "path string, version int, content_hash string, node_ids array<string>, deleted boolean")
    log = lookup.recorded(log, read([("a", "h1", ["n1", "n2"]), ("b", "h2", ["n3"])]), 1)
    log = lookup.recorded(log, read([("a", "h3", ["n4", "n1"])]), 2)
    log = lookup.removed(log, names(["a"]), 3)
    state = lambda x: sorted((r.path, r.content_hash) for r in lookup.live(x).collect())
    assert state(log) == [("a", "h3")]
    assert lookup.removed(log, names(["a"]), 4).count() == log.count()  # a tombstone once
    assert {r.path: r.node_ids for r in lookup.provenance(log).collect()} == {"a": ["n1", "n2", "n4"], "b": ["n3"]}
    assert state(lookup.restored(log, names(["b", "unknown"]), 4)) == [("a", "h3"), ("b", "h2")]
    nodes = spark.createDataFrame([("n1",), ("n2",)], "id string")
    one = lookup.soft_deleted(nodes, names(["n1"]).toDF("id"), at("2024-01-01"))
    two = lookup.soft_deleted(one, names(["n1", "n2"]).toDF("id"), at("2024-01-02"))
    assert [r.id for r in lookup.visible(one).collect()] == ["n2"] and lookup.visible(two).count() == 0
    assert sorted(str(r.deleted_at)[:10] for r in two.collect()) == ["2024-01-01", "2024-01-02"]
    assert [r.id for r in lookup.visible(lookup.undeleted(two, names(["n1"]).toDF("id"))).collect()] == ["n1"]
