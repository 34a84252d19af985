"""Streams that take what is there and stop."""

from datetime import datetime, timedelta

from recollect.streaming import ingest


def test_each_content_is_handled_once(spark, tmp_path):
    source, state, checkpoint = tmp_path / "in", tmp_path / "state", tmp_path / "check"
    source.mkdir()
    handled = []

    def run():
        q = ingest.ingest(ingest.new_versions(spark, str(source)), str(state), str(checkpoint), lambda b: handled.extend((r.path, r.text) for r in b.collect()), once=True)
        q.awaitTermination()

    (source / "a@1.md").write_text("first content of a")
    (source / "tiny@1.md").write_text("tiny")
    run()
    (source / "a@2.md").write_text("first content of a")
    (source / "b@1.md").write_text("content of b here")
    run()
    (source / "a@3.md").write_text("second content of a")
    run()
    (source / "a@4.md").write_text("first content of a")
    run()
    assert handled == [("a.md", "first content of a"), ("b.md", "content of b here"), ("a.md", "second content of a"), ("a.md", "first content of a")]
    seen = ingest.last_seen(spark, str(state))
    assert {r.path for r in seen.collect()} == {"a.md", "b.md"}
    assert [r.path for r in ingest.gone(seen, spark.createDataFrame([("a.md",)], "path string")).collect()] == ["b.md"]


def test_files_of_one_name_stay_apart(spark, tmp_path):
    source = tmp_path / "in put"
    names = ["a/notes.md", "b/notes@7.md", "x.v1.md", "x.v2.md", "c+d/100%.md"]
    for n in names:
        (source / n).parent.mkdir(parents=True, exist_ok=True)
        (source / n).write_text(f"the content of {n}")
    handled = []
    for _ in range(2):
        ingest.ingest(ingest.new_versions(spark, str(source)), str(tmp_path / "state"), str(tmp_path / "check"), lambda b: handled.extend(r.path for r in b.collect()), once=True).awaitTermination()
    assert sorted(handled) == ["a/notes.md", "b/notes.md", "c+d/100%.md", "x.v1.md", "x.v2.md"]


def test_state_is_written_whole_now_and_then(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "COMPACT", 2)
    source, state = tmp_path / "in", tmp_path / "state"
    source.mkdir()
    handled = []
    for k, n in enumerate(["a@1.md", "b@1.md", "a@2.md"]):
        (source / n).write_text("the same content" if k < 2 else "another content")
        ingest.ingest(ingest.new_versions(spark, str(source)), str(state), str(tmp_path / "check"), lambda b: handled.extend(r.path for r in b.collect()), once=True).awaitTermination()
    assert handled == ["a.md", "b.md", "a.md"]
    assert sorted(p.name for p in state.iterdir()) == ["000000000000", "000000000001-whole", "000000000002"]
    assert {(r.path, r.number) for r in ingest.last_seen(spark, str(state)).collect()} == {("a.md", 2), ("b.md", 1)}


def test_prompt_buffers(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    rows = [("s", t + timedelta(minutes=4 * k), f"p{k}") for k in range(11)] + [("z", t, "q")]
    spark.createDataFrame(rows, "session string, ts timestamp, prompt string").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ts timestamp, prompt string").parquet(str(tmp_path / "in"))
    q = ingest.buffered(stream).writeStream.format("memory").queryName("buffers").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    got = {r.prompt: r for r in spark.table("buffers").collect()}
    assert got["p5"].buffer == ["p3", "p4"] and got["p0"].buffer == [] and got["p9"].every_tenth and not got["p10"].every_tenth


def test_sessions(spark, tmp_path):
    t = datetime(2024, 1, 1, 12)
    spark.createDataFrame([("s", t), ("s", t + timedelta(minutes=5)), ("s", t + timedelta(minutes=40)), ("late", t + timedelta(days=3))], "session string, ts timestamp").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("session string, ts timestamp").parquet(str(tmp_path / "in"))
    q = ingest.sessions(stream).writeStream.format("memory").queryName("spans").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    q.awaitTermination()
    assert sorted(r.prompts for r in spark.table("spans").where("session = 's'").collect()) == [1, 2]
