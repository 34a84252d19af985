"""The prefix trie against dictionaries, with shards small enough that most nodes are heavy."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from recollect.llm import trie
from recollect.llm.queries import ORACLE, op13_prefix_trie
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def brute(convs):
    """Rows of the nodes of conversations, id -> list of (role, text)."""
    members = defaultdict(list)
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(c)
    children = defaultdict(list)
    for node in members:
        if node:
            children[node[:-1]].append(node)
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[x] for x in children[node]) or 1
        saved[node] = sum(saved[x] for x in children[node]) + ((len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0)
    sha = lambda cs: hashlib.sha256(",".join(map(str, sorted(cs))).encode()).hexdigest()
    return sorted((min(m), len(n), min(members[n[:-1]]) if n else None, len(m), len(children[n]), leaves[n], saved[n], sha([c for c in m if len(convs[c]) == len(n)])) for n, m in members.items())


def found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=lambda r: (r[0], r[1]))


def ordered(rows):
    convs = defaultdict(list)
    for c, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        convs[c].append((role or "", text or ""))
    return convs


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = []
    for c in range(-20, 200):
        for t in range(rng.choice([1, 2, 3, 5, 9])):
            out.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["", "a", "ab", "é"]) if t or c % 3 else "the same first turn"))
    out += [(300, t, "user", f"turn {t % 7}") for t in range(700)] + [(301, t, "user", f"turn {t % 7}") for t in range(690)]
    out += [(c, t, "user", "copy") for c in range(400, 460) for t in range(3)]
    out += [(500, None, None, None), (500, 1, "user", None), (500, 1, "user", None), (500, 1, "system", "tie"), (None, 1, "user", "no conversation"), (501, 0, "a", "bc"), (502, 0, "ab", "c")]
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("most", [1, 40, 100_000])
def test_nodes_are_those_of_brute_force(spark, rows, most, monkeypatch):
    monkeypatch.setattr(trie, "PIECE", 64)
    monkeypatch.setattr(trie, "LISTED", 4)
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumns({c: F.lit(None).cast("int") for c in ("id", "depth", "part", "key", "size")})
    assert found(trie.conversation_trie(df.repartition(5), most)) == brute(ordered(rows))


def test_nothing_and_one_turn(spark):
    schema = "conv_id bigint, turn bigint, role string, text string"
    assert trie.conversation_trie(spark.createDataFrame([], schema)).collect() == []
    assert trie.conversation_trie(spark.createDataFrame([(None, 1, "user", "x")], schema)).collect() == []
    assert found(trie.conversation_trie(spark.createDataFrame([(5, 1, "user", "x" * 100_000)], schema))) == brute({5: [("user", "x" * 100_000)]})


def test_louds_holds_the_trie():
    words = ["", "a", "ab", "abc", "b", "ba", "bb", "bba"]
    kids = [sum(len(w) == len(v) + 1 and w.startswith(v) for w in words) for v in sorted(words, key=lambda w: (len(w), w))]
    bits = trie.Louds(np.array(kids), np.zeros((len(words), 2), np.uint64))
    assert bits.degrees().tolist() == kids
    assert bits.parents().tolist() == [0, 0, 0, 1, 2, 2, 3, 5]
    assert bits.levels() == [(0, 1), (1, 3), (3, 6), (6, 8)]
    assert bits.rolled_up(np.ones(8)).tolist() == [8, 3, 4, 2, 1, 2, 1, 1]


def test_query(spark, tmp_path):
    """Some conversations lack the one they begin with, some are short and lack turns of their own."""
    own = spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").where("conv_id % 10 != 0 or turn < 2")
    more = [(c, t, None if t == 1 else "user", f"turn {t}" if t else None) for c in range(1001, 1060) for t in range(c % 4)]
    spark_df = own.union(spark.createDataFrame(more, own.schema))
    spark_df.coalesce(1).write.parquet(f"{tmp_path}/made")
    (next((tmp_path / "made").glob("*.parquet"))).rename(tmp_path / "conversations.parquet")
    convs = ordered([tuple(r) for r in spark_df.collect()])
    rebuilt = {}
    for c, turns in convs.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = convs.get(c - c % 5, [])[:h] + turns[h:]
    assert any(not t for t in rebuilt.values())
    got = op13_prefix_trie(spark, str(tmp_path))
    assert found(got) == brute(rebuilt)
    names, rows = duck_rows(ORACLE["op13_prefix_trie"], str(tmp_path), ["conversations"])
    assert spark_rows(got) == (names, rows)
