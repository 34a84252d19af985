"""The document operators against brute force, on a fixture of odd texts and a part of the synthetic documents."""

import hashlib
import random
import re
import time
from itertools import combinations

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from recollect.llm import bpe, decontaminate, pii, quality, simhash, spotsigs, substring, toxicity
from recollect.llm.components import components
from recollect.llm.queries import VOCABULARY

SF = "/root/testdata/sf0.001"
BIG = (1 << 60) + 1


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(4)
    vocabulary = ["alpha", "Beta", "the", "of", "gamma", "x1", "straße", "Été", "a.b@c.de", "10.0.0.1", "+49 (30) 1234567"]
    base = " ".join(rng.choice(vocabulary) for _ in range(60))
    near = base.split()
    near[30] = "changed"
    odd = [None, "", " \n\t ", "!?;", "one", "one two", base, base, " ".join(near), base + " tail words here", "word " * 3000, " ".join(rng.choice(vocabulary) for _ in range(9000)), "\x00\x01\x02 \x03 control", "日本語 テキスト 😀", "no spaces" + "x" * 5000]
    out = [(k, t) for k, t in enumerate(odd)] + [(3, odd[3]), (6, odd[6]), (BIG, base + " more"), (None, base), (None, "lonely null id")]
    out += [(1000 + r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    return out


@pytest.fixture(scope="module")
def docs(spark, rows):
    """With extra columns whose names the operators use themselves, and nulls in them."""
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    extra = ["fp", "score", "spans", "items", "n_words", "base", "removed", "chunk", "fingerprint", "decoded", "id", "component_id"]
    return df.withColumns({c: F.lit(None).cast("int") if k % 2 else F.lit(k) for k, c in enumerate(extra)})


def test_simhash_of_one_text():
    def brute(text):
        w = text.encode().lower().split()
        s = [b" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [b" ".join(w)] if w else []
        n = [sum(xxhash.xxh64_intdigest(x, 42) >> b & 1 for x in s) for b in range(64)]
        return sum((2 * n[b] > len(s)) << b for b in range(64))

    for t in ["", "a", "A b", "a b c", "It is IT is it is", "word " * 700, "Straße ÄÖ ü"]:
        assert simhash.fingerprint(t) == brute(t)
    assert simhash.fingerprint(None) == 0


def _classes(rows):
    prints = [simhash.fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if (prints[a] ^ prints[b]).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return [(i, least.get(find(k))) for k, (i, _) in enumerate(rows)]


@pytest.mark.parametrize("most", [512, 2])
def test_near_duplicates(docs, rows, most):
    """Also with buckets so small that every key is cut again and again."""
    got = [(r.doc_id, r.component_id) for r in simhash.near_duplicates(docs, most=most).collect()]
    key = lambda x: (str(x[0]), str(x[1]))
    assert sorted(got, key=key) == sorted(_classes(rows), key=key)


def test_links_within_dense_groups(spark):
    """Many fingerprints that share all but a few bits: the forest joins what all pairs join."""
    rng = random.Random(2)
    values = {0x0123456789ABCDEF ^ sum(1 << b for b in rng.sample(range(64), rng.randrange(8))) for _ in range(300)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    found = {r.node: r.root for r in components(simhash.links(df, most=4)).collect()}
    root = {v: v for v in signed}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(signed, 2):
        if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= 3:
            root[max(find(a), find(b))] = min(find(a), find(b))
    assert all(found.get(v, v) == find(v) for v in signed)


def test_keep_first(docs, rows):
    kept = simhash.keep_first(docs)
    assert kept.columns == docs.columns
    want = {(i, t) for (i, t), (_, c) in zip(rows, _classes(rows), strict=True) if i is None or i == c}
    got = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_components_of_chain_and_star(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 199), (199, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 160)} | {199: 199, 200: 199}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _folded(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


@pytest.mark.parametrize("most", [1_000_000, 40])
def test_decontaminate(spark, docs, rows, most):
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()] + [(900, "One two"), (901, None), (902, " ".join(["word"] * 12)), (903, "!"), (None, "alpha"), (904, "ONE two")]
    found = decontaminate.find(docs, spark.createDataFrame(items, "item_id bigint, text string"), most=most)
    windows = {}
    for i, t in items:
        w = _folded(t)
        for k in range(len(w) - min(10, len(w)) + 1 if w else 0):
            windows.setdefault(tuple(w[k : k + 10]), set()).add(str(i) if i is not None else None)
    want = []
    for i, t in rows:
        w, hit, own = _folded(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[x]
        want.append((i, len(w), len(hit), sorted(x for x in own if x)))
    key = lambda x: (str(x[0]), x[1:])
    got = [(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), [x for x in r["items"] if x]) for r in found.collect()]
    assert sorted(got, key=key) == sorted(want, key=key)
    kept = decontaminate.remove(docs, spark.createDataFrame([x for x in items if x[0] is not None], "item_id bigint, text string"))
    assert kept.columns == docs.columns and kept.where("text is null").count() == 1
    assert not [t for (t,) in kept.select("text").collect() if any(tuple(_folded(t)[k : k + 10]) in windows for k in range(len(_folded(t)))) and "alpha" not in _folded(t)]
    assert decontaminate.find(docs, spark.createDataFrame([], "item_id bigint, text string")).where("size(spans) > 0").count() == 0


def test_one_hash_set_at_a_time(spark, docs):
    """Of many passes the plan that is left runs the last alone."""
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(12))) for k in range(200)], "item_id bigint, text string")
    plan = decontaminate.find(docs, items, most=100)._jdf.queryExecution().toString()
    assert plan.split("== Physical Plan ==")[1].count("MapInArrow") == 1


@pytest.mark.parametrize("chunks", [1, 7])
def test_repeats(docs, rows, chunks):
    texts = {}
    for i, t in rows:
        texts.setdefault(substring.NULL_ID if i is None else i, []).append(t)
    seen, want = {}, []
    windows = []
    for i, ts in texts.items():
        for t in ts:
            w = (t or "").encode().split()
            windows += [(tuple(w[k : k + 20]), (i, k)) for k in range(len(w) - 19)]
    for x, at in windows:
        seen[x] = min(at, seen.get(x, at))
    for i, ts in texts.items():
        for t in ts:
            w, gone = (t or "").encode().split(), set()
            for k in range(len(w) - 19):
                if seen[tuple(w[k : k + 20])] < (i, k):
                    gone.update(range(k, k + 20))
            want.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    got = [(substring.NULL_ID if r.doc_id is None else r.doc_id, r.n_words, sum(s.end - s.start for s in r.removed), r.kept_text) for r in substring.find_repeats(docs, chunks=chunks).collect()]
    assert sorted(got) == sorted(want)


def test_bpe_is_the_librarys(docs, rows):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(VOCABULARY)
    rng = random.Random(9)
    letters = "abcde éÀßΣσςİıÅǺ́ '’sS\n\t\x1c\x85\xa0 ​0123①½漢字かな😀!?#$|İﬁ"
    more = ["".join(rng.choice(letters) for _ in range(rng.randrange(60))) for _ in range(500)] + ["aaaa aaaaaaa", "<|startoftext|>hi<|endoftext|> x<|endoftext|><|endoftext", "a" * 4000]
    encoder = bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    for text, ids in zip(more, encoder.encode(more), strict=True):
        assert ids == library.encode(text, add_special_tokens=False).ids
        assert bpe.decode(ids, encoder.v.tokens) == library.decode(ids, skip_special_tokens=False)
    got = sorted((str(r.doc_id), r.ids, r.decoded) for r in bpe.encode_decode(docs.drop("id"), VOCABULARY).collect())
    whole = [(str(i), (e := library.encode(t or "", add_special_tokens=False)).ids, library.decode(e.ids, skip_special_tokens=False)) for i, t in rows]
    assert got == sorted(whole)


def test_bpe_merges_a_word_once(monkeypatch):
    """With other punctuation beside it, in another text, and when what is remembered is cut."""
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "REMEMBER", 12)
    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    special = next(iter(encoder.v.special))
    merged, merge = [], encoder.merge
    monkeypatch.setattr(encoder, "merge", lambda words: (merged.extend(words), merge(words))[1])
    texts = ["ciónarción, Ciónarción.", f"(ciónarción) x{special}Σας{special} {special}", None, "", "ciónarción; \x1c e\u0301t\u00e9 \u0301a 12it's"]
    texts += [" ".join(f"ciónarción w{k}{c}" for c in "abcdefgh") for k in range(6)] + texts
    for at, text in enumerate(texts):
        ids = next(encoder.encode([text]))
        assert ids == library.encode(text or "", add_special_tokens=False).ids
        assert len(encoder.seen) <= 12 + len((text or "").split()) and len(encoder.words) <= 12 + 3 * len((text or "").split())
        if at == 1:
            assert merged.count("ciónarción".encode()) == 1


def test_bpe_of_long_words():
    """Long words go by places of ranks: the library's ids, those of the other rounds, and no quadratic time."""
    from tokenizers import Tokenizer

    library, encoder = Tokenizer.from_file(VOCABULARY), bpe.Encoder(bpe.Vocabulary(VOCABULARY))
    rng = random.Random(4)
    words = ["".join(rng.choice(alphabet) for _ in range(n)) for n in (bpe.LONG, bpe.LONG + 1, 1000, 50_000) for alphabet in ("a", "ab", "etaoin", "abcdefghijklmnopqrstuvwxyz", "éßя漢字")]
    for word, ids in zip(words, encoder.merge([w.encode() for w in words]), strict=True):
        assert list(ids) == library.encode(word, add_special_tokens=False).ids
    some = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(1, 600))).encode() for _ in range(400)]
    assert encoder.merge(some) == encoder.merge_long(some) == encoder.merge_short(some)
    assert encoder.merge([]) == []
    started = time.process_time()
    encoder.merge(["".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1 << 20)).encode()])
    assert time.process_time() - started < 20


def test_spotsigs(docs, rows):
    r = spotsigs.edit_likeness(docs).collect()
    assert len(r) == len(rows)
    order = sorted((x for x in rows if x[0] is not None), key=lambda x: -x[0])
    ids = [i for i, _ in order]
    by_id = {x.doc_id: x for x in r}
    for k, (i, t) in enumerate(order[:-1]):
        if ids.count(i) > 1 or ids.count(order[k + 1][0]) > 1:
            continue
        t, after = t or "", order[k + 1][1] or ""
        edited = t[: len(t) - len(t) // 2] + after[: len(t) // 2]
        a, b, c = (spotsigs.signatures(x) for x in (t, edited, after))
        x = by_id[i]
        assert (x.n_chars, x.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (x.fingerprint, x.edited_fingerprint) == (spotsigs.fingerprint(a), spotsigs.fingerprint(b))
        assert abs(x.near_edited - spotsigs.jaccard(a, b)) < 1e-12 and abs(x.near_next - spotsigs.jaccard(a, c)) < 1e-12


def test_signatures_are_the_chains(rows):
    """The chains as tuples of words, written anew: as many, and as much in common, as the signatures."""
    word = re.compile("(?:[0-9a-z]|[^\x00-\x7f])+")

    def chains(text):
        words = word.findall((text or "").lower())
        content = [w for w in words if w not in spotsigs.COMMON]
        out = {(w, *[x for x in words[k + 1 :] if x not in spotsigs.COMMON][:2]) for k, w in enumerate(words) if w in spotsigs.COMMON} if content else set()
        if not content or len(content) > 8 * (len(words) - len(content)):
            out |= {("run", *words[k : k + 2]) for k in range(len(words))}
        return out or {()}

    few = [t for _, t in rows if len(t or "") < 4000][:120] + ["of", "the of", "alpha of beta", "alpha beta gamma delta eps zeta eta theta iota of kappa"]
    sets, want = [spotsigs.signatures(t) for t in few], [chains(t) for t in few]
    assert [len(s) for s in sets] == [len(w) for w in want]
    for i, j in combinations(range(len(few)), 2):
        assert abs(spotsigs.jaccard(sets[i], sets[j]) - len(want[i] & want[j]) / len(want[i] | want[j])) < 1e-12


def test_spotsigs_pairs(docs, rows):
    sets = {spotsigs.fingerprint(s): set(s.tolist()) for s in (spotsigs.signatures(t) for _, t in rows)}
    for least in (0.5, 0.8):
        got = {frozenset((x.a, x.b)) for x in spotsigs.near_pairs(spotsigs.fingerprints(docs), least).collect()}
        assert got == {frozenset((a, b)) for a, b in combinations(sets, 2) if len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b]) - 1e-9}


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def _personal(text):
    out = []
    for i, (k, p) in enumerate(PATTERNS.items()):
        for m in re.finditer(p, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            twice = [int(c) * (2 if n % 2 else 1) for n, c in enumerate(reversed(d))]
            good = {"email": True, "ip": all(int(x) <= 255 for x in m[0].split(".")) if k == "ip" else 0, "card": 16 <= len(d) <= 19 and sum(v - 9 * (v > 9) for v in twice) % 10 == 0, "phone": 8 <= len(d) <= 15}[k]
            out += [(i, m.start(), m.end())] * bool(good)
    return out


def test_pii(spark, docs, rows):
    rng = random.Random(5)
    parts = ["a", "b.", "@", ".", "..", "-", "%", "+", "1", "255", "300", "007", ".1", "+1 ", "(682) ", "555-", "5413", " ", "  ", "\n", "é", "😀", "\x01", "\x03", "\x04", "x.y@z.com", "4242424242424242", "4242 4242 4242 4242", "192.168.0.1"]
    more = [(2 * BIG + k, "".join(rng.choice(parts) for _ in range(rng.randrange(25)))) for k in range(1500)] + [(2 * BIG + 5000 + k, t) for k, t in enumerate(["9" * 20000, "a." * 3000 + "@b.c" + ".d" * 3000, "1." * 5000, "1 " * 9000, "+" + "1" * 5000])]
    everything = docs.select("doc_id", "text", "base", "spans").union(spark.createDataFrame(more, "doc_id bigint, text string").selectExpr("doc_id", "text", "1", "2"))
    trees = pii.train(everything)
    assert trees is not None and len(trees.trees) == pii.TREES
    texts = {i: t for i, t in [*rows, *more]}
    for r in pii.find(everything, trees).collect():
        if r.doc_id is not None:
            base = [(s.kind, s.start, s.end) for s in r.base]
            assert base == _personal(texts[r.doc_id])
            assert set(base) <= {(s.kind, s.start, s.end) for s in r.spans}
    gone = pii.redact(everything, trees)
    assert gone.columns == everything.columns and gone.where("text is null").count() == 1
    assert not [r.text for r in gone.collect() if _personal(r.text)]
    assert pii.train(docs.limit(0)) is None
    assert pii.find(docs, None).where("size(spans) <> size(base)").count() == 0


def test_trees_find_what_no_pattern_does(spark):
    """Values planted with another seed between other words: recall and precision of what the trees add."""
    words = [("la casa verde", "y el río"), ("call me", "or not"), ("", ""), ("zwischen", "Häusern")]
    docs = spark.createDataFrame([(k, f"{a} tree stone {b}") for k, (a, b) in enumerate(words * 5)], "doc_id bigint, text string")
    trees = pii.train(docs)
    texts = pii.planted(words, 1500, seed=77)
    found = {r.doc_id: r for r in pii.find(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(texts)], "doc_id bigint, text string"), trees).collect()}
    place = lambda spans: {(s.start, s.end) for s in spans}
    more = [(place(found[k].spans) - place(found[k].base), set(own) - place(found[k].base)) for k, (_, own) in enumerate(texts)]
    added, missed, right = (sum(map(len, x)) for x in ([a for a, _ in more], [w - a for a, w in more], [a & w for a, w in more]))
    assert added > 150 and right >= 0.97 * added and right >= 0.75 * (right + missed)
    known = ["two cards 7536784127813050 4845168114407329 here", "phone +1 (843) 555-7672 170.106.47.218 host", "nothing 2390409500648960 1.2.3 2024-05-17 at all"]
    got = [r.spans for r in pii.find(spark.createDataFrame(list(enumerate(known)), "doc_id bigint, text string"), trees).orderBy("doc_id").collect()]
    assert [[(pii.KINDS[s.kind], known[k][s.start : s.end]) for s in x] for k, x in enumerate(got)] == [[("card", "7536784127813050"), ("card", "4845168114407329")], [("ip", "170.106.47.218"), ("phone", "+1 (843) 555-7672")], []]


def test_long_texts_take_time_in_proportion(spark):
    """Training reads many spans of one text without pairing them."""
    rng = random.Random(6)
    words = ["alpha", "beta", "a.b@c.de", "10.0.0.1", "+49 (30) 1234567", "4242 4242 4242 4242", "77"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    took = []
    for n in (2_000, 20_000):
        docs = spark.createDataFrame([(1, text(n))], "doc_id bigint, text string")
        began = time.time()
        pii.redact(docs, pii.train(docs)).write.format("noop").mode("overwrite").save()
        took.append(time.time() - began)
    assert took[1] < 4 * took[0] + 20


def test_trees_apply_as_they_were_fitted(spark):
    rng = np.random.default_rng(0)
    x = rng.integers(0, 5, (400, len(pii.FEATURES))).astype(float)
    y = ((x[:, 1] > 2) ^ (x[:, 4] > 3)).astype(float)
    t = pii.boost(x, y)
    want = t.bias + sum(pii._apply(k, x) for k in t.trees)
    df = spark.createDataFrame([(i, dict(zip(pii.FEATURES, map(float, r), strict=True))) for i, r in enumerate(x)], "i int, f struct<" + ", ".join(f"{n}: double" for n in pii.FEATURES) + ">")
    got = [r.m for r in df.select("i", t.margin(F.col("f")).alias("m")).orderBy("i").collect()]
    assert np.allclose(got, want) and ((want > 0) == (y > 0)).mean() > 0.95
    assert pii.boost(x, np.ones(400)) is None


def _accuracy(spark, name, label, parts, held, train, score, least, share):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{d}/labels.parquet")
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts
    model = train(docs, labels, lambda i: F.crc32(i.cast("string").cast("binary")) % parts != held)
    r = score(docs.where(rest == held).join(labels, "doc_id"), model).select("score", label).collect()
    right = sum((x.score >= share) == (x[label] == 1) for x in r)
    assert right / len(r) > least, (name, right, len(r))
    return [(x.score, x[label]) for x in r]


def test_quality_of_held_out_rows(spark):
    _accuracy(spark, "quality", "quality", 3, 1, quality.train, quality.score, 0.99, 0.5)


def test_quality_is_fitted_on_all_labelled_rows_and_pairs(spark):
    """More rows of either class than the 1,500 that once were taken."""
    rng = random.Random(8)
    words = ["plain", "words", "of", "text", "42", "###", "a,b", "|", "SHOUT", "wonderfulness"]
    texts = [" ".join(rng.choices(words, range(1, 11) if rng.random() < 0.5 else range(10, 0, -1), k=rng.randrange(1, 30))) for _ in range(4000)]
    good = [int(t.count("#") + t.count("|") < 5 + rng.randrange(3)) for t in texts]
    assert 1600 < sum(good) < 2400
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    labels = spark.createDataFrame(list(enumerate(good)), "doc_id bigint, quality int")
    model = quality.train(docs, labels, lambda i: F.lit(True))
    x, y = quality.features([t.encode() for t in texts]), np.array(good)
    assert np.allclose(model.mean, x.mean(axis=0))
    z = np.clip((x - x.mean(axis=0)) / model.scale, -quality.MOST, quality.MOST)
    a, b = z[y == 1], z[y == 0]
    wrong = 1 / (1 + np.exp((a @ model.weights)[:, None] - (b @ model.weights)[None, :]))
    grad = (b.T @ wrong.sum(axis=0) - a.T @ wrong.sum(axis=1)) / wrong.size + quality.RIDGE * model.weights
    assert np.abs(grad).max() < 2e-3  # the least loss over all pairs; at no weights it is about 0.3
    assert (model.rank(x) < model.threshold).sum() == (y == 0).sum()


def test_toxicity_of_held_out_rows(spark):
    scored = sorted(_accuracy(spark, "toxicity", "toxic", 4, 2, toxicity.train, toxicity.score, 0.94, 0.3), reverse=True)
    hits = np.cumsum([k for _, k in scored])
    assert max(h for i, h in enumerate(hits.tolist(), 1) if h >= 0.9 * i) >= 0.8 * hits[-1]


def test_toxicity_gradients_are_those_of_the_loss():
    """One step's gradients by vectors, softmax and offset against finite differences."""
    rng = np.random.default_rng(3)
    texts = [toxicity.folded(t) for t in ("walk tree house", "stupid idiot walk walk", "", "river stone tree idiots")]
    words, rows, cols, counts = toxicity.bags(texts)
    used, buckets = np.unique(toxicity.grams(words)[0], return_inverse=True)
    text = toxicity.text_grams(4, rows, cols, counts, buckets, toxicity.grams(words)[1])
    assert [round(float(s.sum()), 5) for _, s in text] == [1, 1, 0, 1]
    entries, y, weight = toxicity._together(text), np.array([0.0, 1, 0, 1]), np.array([1.0, 2, 0.5, 3])
    e, w, b = rng.normal(0, 1, (len(used), 3)), rng.normal(0, 1, 3), 0.2
    loss = lambda e, w, b: toxicity.gradients(e, w, b, entries, y, weight)[0]
    _, by_gram, d_w, d_b = toxicity.gradients(e, w, b, entries, y, weight)
    t = 1e-6
    for i, j in ((0, 0), (5, 1), (len(used) - 1, 2)):
        shift = np.zeros_like(e)
        shift[i, j] = t
        assert np.isclose((loss(e + shift, w, b) - loss(e - shift, w, b)) / (2 * t), by_gram[i] * w[j], atol=1e-6)
    for j in range(3):
        shift = np.eye(3)[j] * t
        assert np.isclose((loss(e, w + shift, b) - loss(e, w - shift, b)) / (2 * t), d_w[j], atol=1e-6)
    assert np.isclose((loss(e, w, b + t) - loss(e, w, b - t)) / (2 * t), d_b, atol=1e-6)


def test_scores_of_odd_rows(spark, docs):
    labels = spark.createDataFrame([(k, k % 2, k % 2) for k in range(14)] + [(3, None, None), (None, 1, 1), (77777, 1, 0)], "doc_id bigint, quality int, toxic int")
    for m in (quality, toxicity):
        for some in (labels, labels.limit(0), labels.where("quality = 1 OR quality IS NULL")):
            out = m.score(docs, m.train(docs, some, lambda i: F.lit(True)))
            assert out.count() == docs.count() and out.where("score IS NULL OR score < 0 OR score > 1").count() == 0
        assert m.score(docs.limit(0), m.train(docs.limit(0), labels, lambda i: F.lit(True))).count() == 0


def test_a_misspelling_nobody_labelled_counts():
    rng = random.Random(1)
    clean = ["walk", "tree", "house", "green", "river", "stone", "cloud", "paper"]
    bad = ["stupidity", "stupidly", "stupids", "idiotic", "idiots", "idiotism"]
    texts = [" ".join(rng.choice(clean) for _ in range(40)) + (" " + rng.choice(bad) if k % 2 else "") for k in range(400)]
    model = toxicity.fit([toxicity.folded(t) for t in texts], [k % 2 for k in range(400)], 0.5)
    a, b = model.score([toxicity.folded("walk tree stupidest idiotz house " * 4), toxicity.folded("walk tree house river stone " * 4)])
    assert a > 0.5 > b


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    assert simhash.near_duplicates(none).count() == 0
    assert substring.find_repeats(none).count() == 0
    assert spotsigs.edit_likeness(none).count() == 0
    assert bpe.encode_decode(none, VOCABULARY).count() == 0
    assert simhash.keep_first(none).columns == docs.columns
    assert spotsigs.edit_likeness(docs.where("doc_id = 6").limit(1)).first().near_next == 1.0
