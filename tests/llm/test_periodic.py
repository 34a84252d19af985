"""Runs of repeated words against brute force, and the query against its contract written anew."""

import hashlib
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from recollect.llm import periodic
from recollect.llm.queries import op11_periodic

SF = "/root/testdata/sf0.001"


def brute(words, least=12):
    out = []
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i < len(words) - q:
            j = i
            while j < len(words) - q and words[j] == words[j + q]:
                j += 1
            size = j - i + q
            if j > i and size >= max(2 * q, least):
                part = words[i : i + size]
                if not any(part[p:] == part[:-p] for p in range(1, q)):
                    out.append((i, size, q))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def fibonacci(n):
    a, b = "a", "ab"
    while len(b) < n:
        a, b = b, b + a
    return list(b[:n])


def made(rng):
    n, letters = rng.randint(0, 120), "abcdefgh"[: rng.choice([1, 2, 2, 3, 4, 8])]
    words = [rng.choice(letters) for _ in range(n)]
    if n and rng.random() < 0.6:
        a, p = rng.randrange(n), rng.randint(1, max(1, n // 3))
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


@pytest.mark.parametrize("least", [2, 7, 12])
def test_runs_are_those_of_brute_force(least):
    rng = random.Random(7)
    cases = [[], ["a"], ["a"] * 80, fibonacci(200), ["a", "b"] * 40, (["a", "b", "c"] * 4 + ["x"]) * 5, *(made(rng) for _ in range(300))]
    together = periodic.find([" ".join(w).encode() for w in cases], least)
    for words, found in zip(cases, together, strict=True):
        assert found == brute(words, least)
        assert periodic.find([" ".join(words).encode()], least)[0] == found  # whatever else is in the batch


def test_long_texts_take_linear_room():
    rng = random.Random(8)
    for n, p in [(60000, 1), (60000, 1700), (60000, 29999)]:
        head = [f"w{rng.randrange(5000)}" for _ in range(p)]
        words = ["first", *(head[i % p] for i in range(n))]
        found = periodic.find([" ".join(words).encode()])[0]
        assert (1, n, p) in found
        assert periodic.collapsed(words, [(1, n, p)]) == words[: p + 1]
    assert len(periodic.find([" ".join(fibonacci(20000)).encode()])[0]) > 100


def test_odd_rows(spark):
    rows = [(None, "a b " * 9), (1, None), (1, ""), (2, " \n\t"), (3, "é x " * 7), (3, "é x " * 7), (4, "a\x0bb\x0c" * 8), (5, "word " * 40000)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").withColumns({c: F.lit(None).cast("int") for c in ("runs", "n_words", "collapsed", "start")})
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.find_runs(docs).collect())
    assert got == [
        (-1, 18, [(0, 18, 2)], "a b"), (1, 0, [], ""), (1, 0, [], ""), (2, 0, [], ""), (3, 7, [], " ".join(["é x"] * 7)), (3, 7, [], " ".join(["é x"] * 7)),
        (4, 16, [(0, 16, 2)], "a b"), (5, 40000, [(0, 40000, 1)], "word"),
    ]
    assert periodic.find_runs(docs.limit(0)).collect() == []


def test_query_on_the_documents(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in op11_periodic(spark, SF).collect()}
    assert got.keys() == texts.keys()
    sha, planted = lambda s: hashlib.sha256(s.encode()).hexdigest(), 0
    for k, text in texts.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        h, n = zlib.crc32(str(k).encode()), len(words)
        if n > 3000:  # brute force is quadratic; such texts are held by the tests above
            continue
        if h % 10 == 0 and n:
            planted += 1
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        runs = brute(words)
        gone = {i for s, size, q in runs for i in range(s + q, s + size)}
        best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
        row = got[k]
        assert (row.n_runs, row.start, row.length, row.period) == (len(runs), *best)
        assert row.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert row.runs_sha256 == sha("".join(f"{s},{size},{q}\n" for s, size, q in runs))
        assert row.collapsed_sha256 == sha(" ".join(w for i, w in enumerate(words) if i not in gone))
    assert planted > 5
