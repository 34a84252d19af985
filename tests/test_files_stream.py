"""Files edited in place, transcripts read from a byte on, deletions, and the quiet end of sessions."""

import json
import os
import time

from recollect.streaming import files


def start(df, tmp_path, name, out, seconds="0 seconds"):
    def take(batch, _):
        out.extend(map(tuple, batch.collect()))

    return df.writeStream.foreachBatch(take).option("checkpointLocation", f"file://{tmp_path}/{name}").trigger(processingTime=seconds).start()


def write(path, text, mode="w", age=None):
    path.parent.mkdir(parents=True, exist_ok=True)
    with path.open(mode) as f:
        f.write(text)
    if age is not None:
        os.utime(path, (time.time() - age, time.time() - age))


def test_edits_appends_and_deletions(spark, tmp_path):
    folder, out = tmp_path / "in", []
    write(folder / "notes/a.md", "one")
    write(folder / "s.jsonl", "l1\nl2\nhal")
    write(folder / "other.txt", "no")
    df = files.edited_files(spark, f"file://{folder}").select("path", "kind", "at", "content")
    q = start(df, tmp_path, "check", out)
    try:
        q.processAllAvailable()
        assert sorted(out) == [("notes/a.md", "file", 0, "one"), ("s.jsonl", "line", 0, "l1"), ("s.jsonl", "line", 3, "l2")]
        out.clear()
        write(folder / "notes/a.md", "two, under its own name")
        write(folder / "s.jsonl", "f\nl4\n", "a")
        q.processAllAvailable()
        assert sorted(out) == [("notes/a.md", "file", 0, "two, under its own name"), ("s.jsonl", "line", 6, "half"), ("s.jsonl", "line", 11, "l4")]
    finally:
        q.stop()
    out.clear()
    (folder / "notes/a.md").unlink()
    write(folder / "s.jsonl", "new\n")  # shorter than before
    q = start(df, tmp_path, "check", out)  # goes on from its checkpoint
    try:
        q.processAllAvailable()
        assert sorted(out, key=str) == [("notes/a.md", "gone", 0, None), ("s.jsonl", "line", 0, "new")]
        out.clear()
        q.processAllAvailable()
        assert out == []
    finally:
        q.stop()


def test_lookback(tmp_path):
    write(tmp_path / "old.jsonl", "a\n", age=7200)
    write(tmp_path / "young.jsonl", "b\n", age=60)
    read = lambda hours: files.EditedFilesReader({"path": f"file://{tmp_path}", "lookbackHours": hours})
    names = lambda r, begin: [(s.path, s.start, s.end) for s in r.partitions(begin, r.latestOffset())]
    assert names(read("0"), read("0").initialOffset()) == [("old.jsonl", 0, 2), ("young.jsonl", 0, 2)]
    assert names(read("1"), read("1").initialOffset()) == [("young.jsonl", 0, 2)]
    begin = read("-1").initialOffset()
    assert names(read("-1"), begin) == []
    write(tmp_path / "old.jsonl", "c\n", "a")
    assert names(read("-1"), begin) == [("old.jsonl", 0, 4)]  # passed over at first, whole once it changes


def test_ranges_share_no_line(tmp_path, monkeypatch):
    monkeypatch.setattr(files, "RANGE", 7)
    monkeypatch.setattr(files, "_TAIL", 3)
    lines = ["a", "", "a long line of many bytes", "é" * 9, "x", "y" * 7, "z"]
    write(tmp_path / "s.jsonl", "\n".join(lines) + "\nrest")
    r = files.EditedFilesReader({"path": f"file://{tmp_path}"})
    rows = [row for span in r.partitions(r.initialOffset(), r.latestOffset()) for row in r.read(span)]
    assert [row[3] for row in rows] == lines
    assert [row[2] for row in rows] == [sum(len(x.encode()) + 1 for x in lines[:k]) for k in range(len(lines))]


def turn(text, kind="user"):
    return json.dumps({"type": kind, "message": {"content": text}}) + "\n"


def test_sessions_are_given_once_they_are_quiet(spark, tmp_path):
    folder, out = tmp_path / "in", []
    q = start(files.quiet_sessions(files.edited_files(spark, f"file://{folder}"), quiet_seconds=4, least_turns=3), tmp_path, "check", out, "1 second")
    first = "".join(turn(f"t{k}") for k in range(3)) + turn("", "user") + "no json\n"
    try:
        write(folder / "few.jsonl", turn("one") + turn("two"))
        write(folder / "p/many.jsonl", first[:20])
        began = time.time()
        while time.time() - began < 6:  # lines that keep coming put it off
            write(folder / "p/many.jsonl", first[: 20 + int((time.time() - began) * 15)])
            time.sleep(0.5)
        write(folder / "p/many.jsonl", first)
        assert out == []
        deadline = time.time() + 60
        while not out and time.time() < deadline:
            time.sleep(0.5)
        assert out == [("p/many.jsonl", 0, len(first), 3)]
        write(folder / "few.jsonl", turn("three"), "a")
        write(folder / "p/many.jsonl", turn("later"), "a")
        deadline = time.time() + 60
        while len(out) < 3 and time.time() < deadline:
            time.sleep(0.5)
        few = len(turn("one") + turn("two") + turn("three"))
        assert sorted(out[1:]) == [("few.jsonl", 0, few, 3), ("p/many.jsonl", len(first), len(first) + len(turn("later")), 4)]
    finally:
        q.stop()
