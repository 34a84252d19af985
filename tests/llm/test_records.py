"""Chat formatting and WARC archives."""

import base64
import gzip
import hashlib
import io
import random

from pyspark.sql import functions as F

from recollect.llm import chat, warc

PARTS = ["</s>", "<s>", "[INST]", "[/INST]", "\\", "<", "s", ">", "/", "[", "]", "a", "\n", "<<SYS>>", "<</SYS>>", "<<ROLE>>", "<</ROLE>>", "<</TURN>>", "é", "😀", "", ""]


def test_turns_come_back():
    rng = random.Random(1)
    for _ in range(500):
        turns = [(rng.choice(["user", "assistant", "system", "tool", "", "odd<<ROLE>>\\"]), "".join(rng.choice(PARTS) for _ in range(rng.randrange(8)))) for _ in range(rng.randrange(6))]
        full, spans, rewrites = chat.locate(chat.marked, turns)
        assert chat.read_back(full) == turns and not rewrites
        assert [chat.unescape(full[c:d]) for *_, c, d in spans] == [t for _, t in turns]
        assert "".join(full[a:b] for a, b, _, _ in spans) == full


def test_long_conversations_take_a_short_context():
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(400)]
    full, spans, rewrites = chat.locate(chat.marked, turns)
    assert not rewrites and [full[c:d] for *_, c, d in spans] == [t for _, t in turns]

    calls = []

    def numbered(ts):  # what a turn looks like depends on how many came before
        calls.append(len(ts))
        return "".join(f"{k}:{t};" for k, (_, t) in enumerate(ts))

    full, spans, rewrites = chat.locate(numbered, turns)
    assert not rewrites and [full[c:d] for *_, c, d in spans] == [t for _, t in turns] and max(calls) == 400


def test_history_rewritten_late_is_seen():
    """A template that folds old turns only from 100 turns on, and shows them all again at the end."""
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(400)]
    folds = lambda ts: "".join(f"{r}:{t};" for r, t in (ts if len(ts) < 100 or len(ts) == 400 else ts[-50:]))
    full, spans, rewrites = chat.locate(folds, turns)
    assert rewrites and [full[c:d] for *_, c, d in spans] == [t for _, t in turns]
    assert not chat.locate(folds, turns[:99])[2]


def test_places_of_repeated_and_empty_texts():
    quoted = lambda ts: "^" + "".join(f"<{t}><>" for _, t in ts)
    full, spans, rewrites = chat.locate(quoted, [("u", ""), ("u", "><"), ("u", "\ue000")])
    assert not rewrites and [full[c:d] for *_, c, d in spans] == ["", "><", "\ue000"] and spans[0][0] == 1


def test_rewritten_history_is_seen():
    def forgetful(ts):
        return "".join(f"{r}:{t if k == len(ts) - 1 or r != 'assistant' else '...'};" for k, (r, t) in enumerate(ts))

    full, spans, rewrites = chat.locate(forgetful, [("user", "hi"), ("assistant", "long thought"), ("user", "x")])
    assert rewrites and full[spans[2][2] : spans[2][3]] == "x"


def test_format_chats(spark):
    rows = [(1, 1, "assistant", "b"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "user", "x"), (2, 0, "user", "x"), (None, 0, "assistant", "y"), ((1 << 60) + 1, 0, "user", "w " * 20000)]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("formatted", F.lit(1)).withColumn("conv", F.lit(None).cast("int"))
    got = {r.conv_id: chat.read_back(r.formatted) for r in chat.format_chats(df).collect()}
    assert got[1] == [("", ""), ("user", "a"), ("assistant", "b")]
    assert got[2] == [("user", "x")] * 2 and got[None] == [("assistant", "y")] and (1 << 60) + 1 in got
    assert chat.format_chats(df.limit(0)).count() == 0


def _pages(spark):
    big = "".join(chr(97 + k % 26) for k in range(3_000_000)) + "é"
    rows = [(1, "http://a", "same"), (2, "http://b", "same"), (3, None, None), (4, "u", ""), (5, "x y\r\nz", "pay\r\n\r\nload"), (7, "d", "same"), (7, "d", "same"), ((1 << 60) + 1, "e", big), (9, "e", big), (None, "n", "same")]
    return rows, spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("digest", F.lit(1)).repartition(3)


def test_warc_round_trip(spark):
    rows, pages = _pages(spark)
    archives = warc.write(pages)
    chunks = warc.read(spark, archives, chunk=1_000_000).collect()
    last = [c for c in chunks if c.is_last]
    assert len(last) == len(rows) == archives.agg(F.sum("records")).first()[0]
    kinds = sorted((c.record_id, c.record_type, c.refers_to) for c in last)
    page = "urn:page:"
    big = (1 << 60) + 1
    assert kinds == sorted([(page + "1", "revisit", page + "7"), (page + "2", "revisit", page + "7"), (page + "3", "revisit", page + "4"), (page + "4", "response", None), (page + "5", "response", None), (page + "7", "response", None), (page + "7", "response", None), (page + str(big), "response", None), (page + "9", "revisit", page + str(big)), (page + "null", "response", None)])
    for c in last:
        html = next(h for i, _, h in rows if page + str("null" if i is None else i) == c.record_id) or ""
        digest = base64.b32encode(hashlib.sha1(html.encode()).digest()).decode()
        assert (c.stated_bytes, c.stated_digest) == (len(html.encode()), digest)
        if c.record_type == "response":
            assert (c.bytes_so_far, c.digest_so_far) == (len(html.encode()), digest)
    parts = sorted((c.chunk_no, bytes(c.data)) for c in chunks if c.record_id == page + str(big))
    assert [k for k, _ in parts] == [0, 1, 2, 3] and b"".join(d for _, d in parts).decode() == next(h for i, _, h in rows if i == big)
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_least_size_of_copies(spark):
    _, pages = _pages(spark)
    last = warc.read(spark, warc.write(pages, min_bytes=1000), data=False).where("is_last")
    assert {r.record_id for r in last.where("record_type = 'revisit'").collect()} == {"urn:page:9"}


def test_archives_are_plain_warc():
    out = io.BytesIO()
    warc._record(out, 1, "http://a", b"x" * 10, None)
    warc._record(out, 2, "http://b", b"x" * 10, 1)
    text = gzip.decompress(out.getvalue())
    assert text.count(b"WARC/1.1\r\n") == 2 and text.endswith(b"\r\n\r\n")
    assert [r[2] for r in warc.records(io.BytesIO(out.getvalue()))] == ["response", "revisit"]
