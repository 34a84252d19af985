"""Operators on hand-made rows, with the numbers that follow from their definitions."""

import math
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from recollect.functions import porter, temporal, text
from recollect.model import PARAMS, now
from recollect.operators import context, graph, lifecycle, pairs, search
from recollect.plans import maintenance
from recollect.sources import markdown, tables, transcripts

T = datetime(2024, 1, 31)


def one(spark, column, **values):
    df = spark.range(1).select(*(F.lit(v).alias(k) for k, v in values.items()))
    return df.select(column.alias("x")).first().x


def nodes(spark, *rows):
    base = {"type": "fact", "tier": "working", "space": None, "title": "t", "content": "some words", "created": T, "updated": T, "last_accessed": T, "access_count": 0, "confidence": 1.0, "importance": 0.5, "valid_until": None, "stability": 1.0, "tags": []}
    schema = "id bigint, type string, tier string, space string, title string, content string, created timestamp, updated timestamp, last_accessed timestamp, access_count bigint, confidence double, importance double, valid_until timestamp, stability double, tags array<string>"
    return spark.createDataFrame([{**base, "id": k, **r} for k, r in enumerate(rows)], schema)


def edges(spark, *rows):
    return spark.createDataFrame([(*r, T)[:5] for r in rows], "source_id bigint, target_id bigint, edge_type string, weight double, created timestamp")


def test_titles_and_sentences(spark):
    c = F.col("c")
    assert one(spark, text.title(c), c="  short line \nnext") == "short line"
    assert one(spark, text.title(c), c="word " * 30) == ("word " * 12).strip() + "…"
    assert one(spark, text.title(c), c="x" * 80) == "x" * 60 + "…"
    assert one(spark, text.first_sentence(c, 20), c="One two. Three four five six") == "One two."
    assert one(spark, text.first_sentence(c, 20), c="One; two three four. five six") == "One two three four. "[:0] + "One; two three four."
    assert one(spark, text.first_sentence(c, 5), c="abcdefgh") == "abcde"
    assert one(spark, text.json_part(c), c='Here: {"a": 1} done') == '{"a": 1}'
    assert one(spark, text.space_of_path(c), c="/home/me/work/api/") == "api" and one(spark, text.space_of_path(c), c="/home/me") is None
    assert one(spark, F.lit("a/node_modules/b").rlike(text.glob_pattern("**/node_modules/*")))
    assert one(spark, text.merge_preview(c)[1], c="a\n---\nb") == "b"
    assert one(spark, text.rerank_text(F.lit("T"), c), c="body") == "T: body"


def test_time_windows(spark):
    p = F.col("p")
    for prompt, days in (("what did we do yesterday", (2, 1)), ("last 3 days", (3, 0)), ("past 2 weeks", (28, 14)), ("last week", (14, 7)), ("hello", (3, 0)), ("last 1 month", (30, 0))):
        w = one(spark, temporal.window(p, now()), p=prompt)
        assert ((datetime(2024, 2, 1) - w.after).days, (datetime(2024, 2, 1) - w.before).days) == days
    assert one(spark, temporal.without_phrases(p), p="changes to the API in the last 3 days") == "changes to the API"
    assert one(spark, temporal.only_time(p), p="what did we do last week") and not one(spark, temporal.only_time(p), p="the parser last week")


@pytest.mark.parametrize(("word", "root"), [("caresses", "caress"), ("ponies", "poni"), ("agreed", "agre"), ("motoring", "motor"), ("hopping", "hop"), ("relational", "relat"), ("happy", "happi"), ("controlling", "control"), ("adjustment", "adjust"), ("sky", "sky")])
def test_stems(word, root):
    assert porter.stem(word) == root


def test_rank_fusion(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("z", 3)], "id string, rank int")
    assert {r.id: r.rrf for r in search.fuse([(a, 1.0)]).collect()} == {"x": 1 / 61, "y": 1 / 62, "z": 1 / 63}
    assert {r.id: r.rrf for r in search.fuse([(a, 1.0), (a.limit(1), 1.0)]).collect()}["x"] == pytest.approx(2 / 61)


def test_full_text_terms(spark):
    assert search.query_terms("What is MY favourite editor?") == ["favourite", "editor", "about_self"]
    assert search.query_terms("where do I live?")[-1] == "about_self" and search.query_terms("...") == []
    n = nodes(spark, {"content": "red fox", "tags": ["about_self"]}, {"content": "red dog"}, {"content": "blue self about"})
    hit = lambda terms, **o: {r.id for r in search.bm25(n, terms, **o).collect()}
    assert hit(["red", "fox"]) == {0} and hit(["red", "whale"]) == {0, 1} and hit(["about_self"]) == {0} and hit([]) == set()


def test_recall_cuts_before_it_boosts(spark):
    n = nodes(spark, *[{"content": f"topic {'topic ' * (5 - k)}", "title": "topic" if k == 4 else "other"} for k in range(5)], {"content": "topic", "valid_until": datetime(2024, 1, 1)})
    r = search.recall(n, None, "topic", None, now(), limit=3, params=PARAMS.__class__(min_result_score=0.0)).collect()
    assert len(r) <= 3 and 5 not in {x.id for x in r}
    assert search.rerank(spark.createDataFrame([(1, 0.5)], "id int, score double"), F.lit(0.0)).first().score == pytest.approx(0.4 * 0.5 + 0.6 * 0.5)


def test_activation(spark):
    n = nodes(spark, *[{}] * 8)
    found = spark.createDataFrame([(0, 0.8, "hybrid")], "id bigint, score double, source string")
    e = edges(spark, (0, 1, "supports", 0.9), (2, 0, "contradicts", 0.9), (0, 3, "related_to", 0.5), (0, 4, "related_to", 0.1), (0, 0, "supports", 1.0))
    r = {x.id: (x.score, x.source) for x in graph.activate(found, e, n).collect()}
    assert r[1] == (0.36, "activated") and r[2] == (pytest.approx(0.8 * 0.9 * 0.4 * 0.5), "conflict") and 4 not in r and len(r) == 4


def test_neighbours_depth(spark):
    e = edges(spark, (0, 1, "supports", 1.0), (2, 1, "supports", 1.0), (2, 3, "defines", 1.0))
    got = lambda d, k=None: {(r.id, r.hops) for r in graph.neighbours(e, spark.createDataFrame([(0,)], "id bigint"), d, k).collect()}
    assert got(1) == {(1, 1)} and got(3) == {(1, 1), (2, 2), (3, 3)} and got(3, ["supports"]) == {(1, 1), (2, 2)}


def test_touch_and_fold(spark):
    assert one(spark, graph.touched(F.col("s"), F.lit(1.0)), s=1.0) == round(1.5 * math.exp(-1) ** -0.2, 2)
    assert one(spark, graph.touched(F.col("s"), F.lit(1.0)), s=364.0) == 365.0
    e = spark.createDataFrame([(1, T), (1, datetime(2024, 1, 30)), (2, T)], "id bigint, ts timestamp")
    r = {x.id: (x.accesses, x.stability) for x in graph.fold_touches(e).collect()}
    assert r == {1: (2, round(1.5 * math.exp(-1) ** -0.2, 2)), 2: (1, 1.0)}


def test_merge_and_undo(spark):
    n = nodes(spark, {"tags": ["a"]}, {"tags": ["b", "a"]}, {}, {})
    e = edges(spark, (1, 2, "supports", 0.9), (0, 1, "related_to", 0.5), (0, 2, "defines", 0.4), (3, 1, "supports", 0.3))
    m = spark.createDataFrame([(0, 1)], "keep bigint, drop bigint")
    n2, e2, h = lifecycle.merge(n, e, m, now())
    h = tables.staged(h, "history")
    key = lambda d: {(r.source_id, r.target_id, r.edge_type) for r in d.collect()}
    assert key(e2) == {(0, 2, "supports"), (0, 2, "defines"), (3, 0, "supports")}
    assert {r.id: r.tags for r in n2.collect()}[0] == ["a", "b"]
    n3, e3 = lifecycle.undo(n2, e2, h)
    assert key(e3) == key(e) and {r.id for r in n3.collect()} == {0, 1, 2, 3}


def test_store_changes(spark):
    n, e = nodes(spark, {}, {"tier": "core"}, {}), edges(spark, (0, 1, "supports", 1.0))
    new = spark.createDataFrame([(9, "A new memory")], "id bigint, content string")
    added = {r.id: r for r in lifecycle.remember(n, new, now()).collect()}[9]
    assert (added.title, added.tier, added.confidence) == ("A new memory", "working", 1.0)
    assert {r.id: r.title for r in lifecycle.update(n, spark.createDataFrame([(0, "x")], "id bigint, title string"), now()).collect()} == {0: "x", 1: "t", 2: "t"}
    left, few = lifecycle.delete(n, e, spark.createDataFrame([(0,)], "id bigint"))
    assert left.count() == 2 and few.count() == 0
    diff = tables.index_diff(spark.createDataFrame([("a", "1"), ("b", "1")], "id string, content_hash string"), spark.createDataFrame([("b", "2"), ("c", "1")], "id string, content_hash string"))
    assert {(r.id, r.change) for r in diff.collect()} == {("a", "removed"), ("b", "updated"), ("c", "added")}


def test_verdicts(spark):
    n = nodes(spark, {"created": T}, {"created": datetime(2024, 1, 1)})
    p = spark.createDataFrame([(0, 1, 0.71234)], "a bigint, b bigint, similarity double")
    made, checked = lifecycle.verdict_edges(p, spark.createDataFrame([(0, 1, "Relevant")], "a bigint, b bigint, link string"), now())
    assert (made.first().edge_type, made.first().weight, checked.count()) == ("related_to", 0.712, 1)
    c = lifecycle.conflict_edges(p, spark.createDataFrame([(0, 1, True, True, "change")], "a bigint, b bigint, conflict boolean, same_subject boolean, kind string"), n, now()).first()
    assert (c.source_id, c.target_id, c.edge_type) == (0, 1, "evolved_from")
    assert pairs.unlinked(p, edges(spark, (1, 0, "supports", 1.0))).count() == 0


def test_full_maintenance_pass(spark):
    n = nodes(spark, {"importance": 0.1, "last_accessed": datetime(2023, 1, 1)}, {"content": "same text here", "title": "same"}, {"content": "same text here", "title": "same"}, {"space": "x"})
    v = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 1.0]), (3, [0.6, 0.8])], "id bigint, embedding array<float>")
    store = maintenance.Store(n, edges(spark, (1, 3, "supports", 1.0)), v)
    same = spark.createDataFrame([(1, 2, True)], "a bigint, b bigint, same boolean")
    after, status = maintenance.run_all(store, maintenance.Verdicts(duplicates=same), now())
    assert all(s.errors == 0 for s in status.values()), status
    r = {x.id: x for x in after.nodes.collect()}
    assert 2 not in r and r[1].space == "x" and r[0].tier == "archival"
    assert {(r.a, r.b) for r in maintenance.batches(store)["duplicates"].collect()} == {(1, 2), (0, 3)}


def test_intents(spark):
    s = spark.createDataFrame([(1, "conversational", 0.9), (1, "temporal", 0.8), (2, "conversational", 0.95), (2, "temporal", 0.66), (3, "identity", 0.7), (3, "continuation", 0.8), (4, "identity", 0.1)], "id int, category string, score double")
    assert {r.id: r.categories for r in context.intents(s).collect()} == {1: ["temporal"], 2: ["conversational"], 3: ["identity"], 4: ["general"]}


def test_whisper_guards(spark):
    n = nodes(spark, {"type": "person", "tags": ["about_self"]}, {"tags": ["about_self"]}, {}, {"tier": "core"})
    own = spark.createDataFrame([(0,), (1,)], "id bigint")
    r = lambda *x: spark.createDataFrame([(*v, "hybrid") for v in x], "id bigint, score double, source string")
    got = context.whisper(r((0, 0.6), (2, 0.9), (3, 0.7)), n, own).collect()
    assert {x.section: x.id for x in got} == {"identity": 0, "working": 2, "core": 3}
    assert context.whisper(r((2, 0.5)), n, own).count() == 0
    assert context.whisper(r((1, 0.31)), n, own, temporal=True).count() == 0


def test_markdown(spark):
    body = "---\nid: 'n1'\ntype: person\ntags: [a, b]\ncreated: 2024-01-01T10:00:00+00:00\nconnections:\n- target: n2\n  edge: supports\n  weight: 0.7\n---\n\nHello *there*\n"
    r = markdown.parse(spark.createDataFrame([("f.md", body), ("bad.md", "no head"), ("e.md", "---\ntitle: x\n---\nno id")], "path string, text string")).collect()
    assert len(r) == 1 and (r[0].id, r[0].tier, r[0].tags, r[0].content) == ("n1", "working", ["a", "b"], "Hello *there*")
    assert [tuple(c) for c in r[0].connections] == [("n2", "supports", 0.7)] and r[0].last_accessed == datetime(2024, 1, 1, 10)


def test_markdown_on_disk(spark, tmp_path):
    from recollect.model import NODE_SCHEMA

    t = datetime(2024, 1, 2, 3, 4, 5)
    titles = {"n1": "it's \"so\": a \\\\ b", "a/b": "two\nlines", ".x": "# no comment", "_y": "null", "ü ß": "'quoted'", "l" * 300: "---", "n%41": ""}
    tags = {"n1": ["a, b", "c]d", 'e"f', "g'h"], ".x": ["x"]}
    rows = [(i, "fact", "core", "me: you", None, v, f"content\n---\nof {i}", t, t, t, 3, 0.1, 0.5, None, 1e-5, None, tags.get(i, []), None) for i, v in titles.items()]
    n = spark.createDataFrame(rows, NODE_SCHEMA)
    e = spark.createDataFrame([("n1", "a/b", "supports", 0.7), ("n1", ".x", "part_of", 1e-7), (".x", "n1", "defines", 1.0), ("gone", "n1", "defines", 1.0)], "source_id string, target_id string, edge_type string, weight double")
    folder = f"file://{tmp_path}/notes"
    for _ in range(2):  # written again, the files are replaced
        assert markdown.write(markdown.connected(n, e), folder) == len(titles)
    assert len(list((tmp_path / "notes").iterdir())) == len(titles)
    back = markdown.read(spark, folder)
    got = {r.id: r for r in back.collect()}
    assert {i: r.title for i, r in got.items()} == {**titles, "n%41": "content"}
    assert {i: r.tags for i, r in got.items() if r.tags} == tags
    assert all(r.content == f"content\n---\nof {i}" and (r.source, r.space, r.created, r.access_count, r.confidence, r.stability) == ("me: you", None, t, 3, 0.1, 1e-5) for i, r in got.items())
    assert {tuple(r) for r in markdown.edges_of(back).collect()} == {("n1", "a/b", "supports", 0.7), ("n1", ".x", "part_of", 1e-7), (".x", "n1", "defines", 1.0)}
    assert markdown.write(n.limit(0), folder) == 0


def test_markdown_heads(spark):
    texts = ["---\r\nid: a\r\ntags:\r\n- x\r\n- 'y z'\r\nid: b\r\n---\r\nbody", "---\nid: 'it''s'\ntags: [p, 'q, r', \"s\\u0041\"]\n---", "---\n---\nno id", "---\nid: c\nno end", "", None]
    got = markdown.parse(spark.createDataFrame([(x,) for x in texts], "text string")).collect()
    assert [(r.id, r.tags, r.content) for r in got] == [("b", ["x", "y z"], "body"), ("it's", ["p", "q, r", "sA"], "")]


def test_transcripts(spark, tmp_path):
    lines = ['{"type": "user", "message": {"content": "hi"}}', "not json", '{"type": "assistant", "message": {"content": [{"type": "text", "text": " yes "}, {"type": "tool_use", "id": 1}]}}', '{"type": "user", "message": {"content": [{"type": "tool_result", "text": "x"}]}}', '{"type": "summary"}']
    (tmp_path / "-home-me-api").mkdir()
    (tmp_path / "-home-me-api" / "s.jsonl").write_text("\n".join(lines))
    m = transcripts.read(spark, str(tmp_path))
    c = transcripts.conversations(m).first()
    assert (c.text, c.user_turns) == ("User: hi\n\nAssistant: yes", 1)
    assert transcripts.discovered(spark, str(tmp_path)).first().space == "api"
    assert transcripts.discovered(spark, str(tmp_path), ("**/*api*/*",)).count() == 0
