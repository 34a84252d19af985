"""Near copies against brute force."""

import random

import pytest

from recollect.llm import copies, simhash


def _sets(text, size=5):
    w = (text or "").lower().split()
    return {tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set()


def _groups(texts):
    """The smallest index of each one's group, by all pairs."""
    sets, prints, root = [_sets(t) for t in texts], [simhash.fingerprint(t) for t in texts], list(range(len(texts)))
    jaccard = 0
    for i in range(len(texts)):
        for j in range(i):
            near = (prints[i] ^ prints[j]).bit_count() <= 3
            like = bool(sets[i]) and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
            jaccard += like and not near
            if (near or like) and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root, jaccard


def _texts():
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(3000)}"
    line = " ".join(word() for _ in range(12))
    out = [None, "", "one two", "One  two"]
    for k in range(30):
        own = [word() for _ in range(rng.choice([20, 60, 150]))]
        base = [*line.split(), *own] if k % 3 == 0 else own
        out.append(" ".join(base))
        for _ in range(3):  # each a few words from the one before, so that groups are chains
            base = list(base)
            for _ in range(rng.choice([1, 2, 4])):
                base[rng.randrange(len(base))] = word()
            out.append(" ".join(base))
    return out


@pytest.mark.parametrize("most", [512, 3])
def test_near_copies_are_those_of_all_pairs(spark, most):
    texts = _texts()
    want, jaccard = _groups(texts)
    assert jaccard > 20  # fingerprints alone lose these
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in copies.near_copies(docs, most=most, sample=60).collect()}
    assert got == dict(enumerate(want))


def test_pipeline_keeps_one_of_near_copies(spark):
    import corpus_pipeline

    texts = _texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    kept = {r.doc_id for r in corpus_pipeline.keep_one_of_each(spark, docs, "").collect()}
    assert kept == set(_groups(texts)[0])


def test_parities_tell_long_sets_apart():
    import numpy as np

    rng = np.random.default_rng(5)
    for n in (60, 4000):  # a fixed 1,024 parities of 4,000 shingles never reached the bound
        own, other = (np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(2))
        a, b = (np.unpackbits(copies.parities(x).view(np.uint8)) for x in (own, other))
        assert len(a) == len(b) >= n
        assert (a != b).sum() > (1 - copies.LIKENESS) / (1 + copies.LIKENESS) * 2 * n
        near = np.append(own[: -n // 20], other[: n // 20])
        c = np.unpackbits(copies.parities(near).view(np.uint8))
        assert (a != c).sum() <= len(np.setxor1d(own, near))


def test_parities_of_different_lengths_are_folded(spark):
    import numpy as np

    rng = np.random.default_rng(6)
    own = np.unique(rng.integers(0, 1 << 63, 140).astype(np.uint64))  # 256 parities; 120 of these have 128
    rows = [(copies.parities(own).tolist(), copies.parities(own[:k]).tolist(), 140 - k) for k in (140, 130, 120, 50)]
    found = spark.createDataFrame(rows, "s array<bigint>, t array<bigint>, d int").select(copies._differing("s", "t").alias("n"), copies._differing("t", "s").alias("m"), "d").collect()
    assert all(r.n == r.m <= r.d for r in found)
    assert [r.n for r in found][0] == 0 < found[1].n
