"""Personal data by candidate gradient boosting, in DataFrame functions throughout.

High-recall generators propose overlapping spans: anything around an @ sign, whole and trimmed, and every run of
up to GROUPS neighbouring groups of digits. Boosted trees score each from its format and context, and a threshold
for each kind, calibrated on rows left out of the fit, selects those to add to what the fixed patterns find.

The labels do not come from the fixed patterns. Values of many formats, right ones and ones that fail a check, are
planted between words of the documents, alone or side by side; a candidate is right if it is exactly a planted
value. Candidates of the documents themselves that pass no check at all are further wrong ones. The trees are
fitted on the driver on a bounded number of candidates and applied as a SQL expression.

The patterns avoid repeated groups, which Java matches by recursion: separators that stand between two
characters of a token are first replaced by a mark of equal length, so that a token is a run of one class.
"""

from __future__ import annotations

import random
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KINDS = ("email", "ip", "card", "phone")
MARK, BREAK, DASH, DOT = "\x01", "\x02", "\x03", "\x04"  # around matches; other uses of controls; card and email separators
SPAN = "array<struct<start: bigint, end: bigint, value: string>>"

_EMAIL = rf"(?:(?<![A-Za-z0-9._%+{DOT}-])|\G)[A-Za-z0-9._%+{DOT}-]++@[A-Za-z0-9-]++{DOT}[A-Za-z0-9{DOT}-]++"
_IP = r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"
_CARD = rf"[0-9{DASH}]{{16,}}+"
_PHONE = r"\+[0-9][ ().0-9-]+[0-9]"
#: Generators: anything around an @ sign, and anything like a number with separators.
_LOOSE_MAIL = r"[^\s@<>,;|]{1,64}@[^\s@<>,;|]{3,128}"
_LOOSE_NUMBER = r"[+(]{0,2}[0-9][0-9 ().+-]{5,}[0-9]"
#: Most groups of digits, and the numbers of digits, of a proposed number.
GROUPS, LEAST_DIGITS, MOST_DIGITS = 6, 7, 19
CONTEXT = 24
_HINT = r"(?i)\b(?:e-?mail|mail|phone|tel|call|fax|mobile|card|visa|account|ip|address|host|contact)\b"
FEATURES = (
    "length", "digits", "letters", "dots", "spaces", "dashes", "brackets", "at", "plus", "groups", "longest", "shortest", "first", "luhn", "small_parts",
    "host", "edges", "hint", "letter_before", "letter_after", "mark_before", "mark_after", "groups_before", "groups_after",
)

#: The trees are fitted on so many planted values and at most so many other candidates, from about so many documents,
#: by order of a hash of the id.
PLANTED = 4000
MOST_CANDIDATES = 2000
MOST_DOCUMENTS = 10_000
TREES, DEPTH, RATE = 30, 4, 0.3
PRECISION = 0.99
SEED = 11
_BLOCK = 128


def _clean(text: Column) -> Column:
    """The text with the control characters used as marks replaced, character for character."""
    return F.translate(F.coalesce(text, F.lit("")), MARK + BREAK + DASH + DOT, "\x05" * 4)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is evaluated once however often body names it."""
    return F.transform(F.array(value), body)[0]


def _sums(lengths: Column) -> Column:
    """For each element of an array of bigint the sum of those before it, block by block."""
    total = lambda a: F.aggregate(a, F.lit(0).cast("bigint"), lambda s, x: s + x)
    plain = lambda a: F.transform(a, lambda _, i: total(F.slice(a, F.lit(1), i)))
    cut = lambda a: F.transform(F.sequence(F.lit(0), F.floor(F.size(a) / _BLOCK).cast("int")), lambda k: F.slice(a, k * _BLOCK + 1, F.lit(_BLOCK)))
    moved = lambda a, at: F.transform(plain(a), lambda x: x + at)
    return _let(_let(lengths, cut), lambda b: _let(plain(F.transform(b, total)), lambda at: F.flatten(F.transform(b, lambda a, k: moved(a, F.get(at, k))))))


def _found(text: Column, pattern: str, context: bool = False) -> Column:
    """All matches, leftmost first and without overlap, with their place in code points.

    With context each also has up to CONTEXT characters before it and one after it, none of them another match's.
    """
    pieces = F.split(F.regexp_replace(text, pattern, f"{MARK}$0{MARK}"), MARK, -1)

    def spans(p: Column, at: Column) -> Column:
        def span(x: Column, i: Column) -> Column:
            own = [F.get(at, i).alias("start"), (F.get(at, i) + F.length(x)).alias("end"), x.alias("value")]
            if context:
                own += [F.right(F.get(p, i - 1), F.lit(CONTEXT)).alias("before"), F.left(F.get(p, i + 1), F.lit(1)).alias("after")]
            return F.struct(F.lit(i % 2 == 1).alias("inside"), F.struct(*own).alias("span"))

        return F.transform(F.filter(F.transform(p, span), lambda x: x["inside"]), lambda x: x["span"])

    return _let(pieces, lambda p: _let(_sums(F.transform(p, lambda x: F.length(x).cast("bigint"))), lambda at: spans(p, at)))


def _if(condition: Column, spans: Column, kind: str = SPAN) -> Column:
    return F.when(condition, spans).otherwise(F.expr(f"CAST(array() AS {kind})"))


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: _luhn_digit(d.cast("int"), i))
    return F.aggregate(each, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def _luhn_digit(d: Column, place: Column) -> Column:
    twice = d * 2
    return F.when(place % 2 == 0, d).otherwise(F.when(twice > 9, twice - 9).otherwise(twice))


def _small_parts(value: Column) -> Column:
    """Whether all parts between dots are at most 255; leading zeros do not count."""
    part = lambda p: F.regexp_replace(p, "^0+", "")
    return F.forall(F.split(value, r"\."), lambda p: (F.length(part(p)) < 4) & (F.coalesce(F.try_to_number(part(p), F.lit("999")), F.lit(0)) <= 255))


def base_spans(text: Column) -> dict[str, Column]:
    """kind -> array<struct<start, end, value>>, by start: what the fixed patterns and their checks accept."""
    dotted = F.regexp_replace(text, r"(?<=[A-Za-z0-9-])\.(?=[A-Za-z0-9-])", DOT)
    dashed = F.regexp_replace(text, r"(?<=[0-9])[ -](?=[0-9])", DASH)
    n = lambda s: F.length(_digits(s["value"]))
    return {
        "email": _if(F.contains(text, F.lit("@")), _found(dotted, _EMAIL)),
        "ip": F.filter(_if(text.rlike(r"[0-9]\.[0-9]+\.[0-9]"), _found(text, _IP)), lambda s: _small_parts(s["value"])),
        "card": F.filter(_if(text.rlike(r"[0-9][0-9 -]{14,}[0-9]"), _found(dashed, _CARD)), lambda s: n(s).between(16, 19) & luhn(_digits(s["value"]))),
        "phone": F.filter(_if(F.contains(text, F.lit("+")), _found(text, _PHONE)), lambda s: n(s).between(8, 15)),
    }


_CANDIDATE = "array<struct<start: bigint, end: bigint, value: string, before: string, after: string, groups_before: int, groups_after: int>>"


def _proposed(start: Column, end: Column, value: Column, before: Column, after: Column, ahead: Column, behind: Column) -> Column:
    names = ("start", "end", "value", "before", "after", "groups_before", "groups_after")
    return F.struct(*(c.alias(n) for c, n in zip((start, end, value, before, after, ahead, behind), names, strict=True)))


def _mails(text: Column) -> Column:
    """Each loose match, and what is left of it between its first and last letter or digit."""
    none = F.lit(0)

    def both(m: Column) -> Column:
        head = F.length(F.regexp_extract(m["value"], r"^[^\p{L}\p{N}]*", 0))
        tail = F.length(F.regexp_extract(m["value"], r"[^\p{L}\p{N}]*$", 0))
        whole = _proposed(m["start"], m["end"], m["value"], m["before"], m["after"], none, none)
        inner = F.substring(m["value"], head + 1, F.length(m["value"]) - head - tail)
        edge = lambda size, char, other: F.when(size > 0, char).otherwise(other)
        before = edge(head, F.concat(m["before"], F.left(m["value"], head)), m["before"])
        after = edge(tail, F.left(F.right(m["value"], tail), F.lit(1)), m["after"])
        trimmed = _proposed(m["start"] + head, m["end"] - tail, inner, before, after, none, none)
        return F.when(head + tail > 0, F.array(whole, trimmed)).otherwise(F.array(whole))

    return F.flatten(F.transform(_found(text, _LOOSE_MAIL, context=True), both))


def _numbers(text: Column) -> Column:
    """Of each run of digits and separators every row of up to GROUPS groups of digits, with a + or ( before it."""

    def parts(run: Column) -> Column:
        tokens = F.regexp_extract_all(run["value"], F.lit(r"[^0-9]*[0-9]+"), F.lit(0))

        def rows(t: Column, at: Column) -> Column:
            def row(i: Column, k: Column) -> Column:
                first, last = F.get(t, i), i + k
                gap = F.length(F.regexp_extract(first, r"^[^0-9]*?(?=[+(]*[0-9])", 0))
                value = F.substr(F.array_join(F.slice(t, i + 1, k + 1), ""), gap + 1)
                before = F.when(i == 0, run["before"]).otherwise(F.concat(F.get(t, i - 1), F.left(first, gap)))
                after = F.when(last + 1 < F.size(t), F.left(F.get(t, last + 1), F.lit(1))).otherwise(run["after"])
                return _proposed(run["start"] + F.get(at, i) + gap, run["start"] + F.get(at, last) + F.length(F.get(t, last)), value, before, after, i, F.size(t) - 1 - last)

            every = F.flatten(F.transform(t, lambda _, i: F.transform(F.sequence(F.lit(0), F.least(F.lit(GROUPS - 1), F.size(t) - 1 - i)), lambda k: row(i, k))))
            return F.filter(every, lambda c: F.length(_digits(c["value"])).between(LEAST_DIGITS, MOST_DIGITS))

        return _let(tokens, lambda t: _let(_sums(F.transform(t, lambda x: F.length(x).cast("bigint"))), lambda at: rows(t, at)))

    return F.flatten(F.transform(_found(text, _LOOSE_NUMBER, context=True), parts))


def candidates(text: Column) -> Column:
    """What the generators propose, overlaps included: start, end, value, before, after, and the groups around it."""
    return F.concat(_if(F.contains(text, F.lit("@")), _mails(text), _CANDIDATE), _if(text.rlike(r"[0-9][0-9 ().+-]{5,}[0-9]"), _numbers(text), _CANDIDATE))


def _features(c: Column) -> Column:
    v = c["value"]
    count = lambda pattern: F.length(v) - F.length(F.regexp_replace(v, pattern, ""))
    digits = F.length(_digits(v))
    last, groups = F.right(c["before"], F.lit(1)), F.filter(F.split(v, "[^0-9]+"), lambda x: x != "")
    flag = lambda x: F.coalesce(x, F.lit(False)).cast("int")
    values = {
        "length": F.length(v), "digits": digits, "letters": count(r"\p{L}"), "dots": count(r"\."), "spaces": count(" "), "dashes": count("-"), "brackets": count("[()]"), "at": count("@"),
        "plus": flag(v.startswith("+")), "groups": F.size(groups), "longest": F.coalesce(F.array_max(F.transform(groups, lambda x: F.length(x))), F.lit(0)),
        "shortest": F.coalesce(F.array_min(F.transform(groups, lambda x: F.length(x))), F.lit(0)), "first": F.coalesce(F.left(_digits(v), F.lit(1)).try_cast("int"), F.lit(-1)),
        "luhn": flag(F.when(digits.between(16, 19), luhn(_digits(v)))), "small_parts": flag(F.when((count(r"\.") == 3) & (digits == F.length(v) - 3), _small_parts(v))),
        "host": flag(v.rlike(r"@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}$")), "edges": flag(v.rlike(r"^[\p{L}\p{N}+(]")) + flag(v.rlike(r"[\p{L}\p{N}]$")),
        "hint": flag(c["before"].rlike(_HINT)), "letter_before": flag(last.rlike(r"\p{L}")), "letter_after": flag(c["after"].rlike(r"\p{L}")),
        "mark_before": flag(last.rlike(r"[.+/_-]")), "mark_after": flag(c["after"].rlike(r"[+/_-]")), "groups_before": F.least(c["groups_before"], F.lit(GROUPS)), "groups_after": F.least(c["groups_after"], F.lit(GROUPS)),
    }
    return F.struct(*(values[n].cast("double").alias(n) for n in FEATURES))


@dataclass
class Trees:
    """Boosted regression trees over FEATURES: nested (feature, limit, low, high) or leaf values; a threshold for each kind."""

    trees: list
    bias: float
    thresholds: list[float]

    def margin(self, f: Column) -> Column:
        """The sum of the trees for a struct of FEATURES; the trees are array literals, so that the plan stays small."""
        size = (1 << DEPTH) - 1
        limits, leaves = np.full((len(self.trees), size), np.inf), np.zeros((len(self.trees), size + 1))
        features = np.zeros((len(self.trees), size), int)

        def fill(k: int, node, at: int) -> None:
            if isinstance(node, tuple):
                features[k, at], limits[k, at] = node[:2]
                fill(k, node[2], 2 * at + 1)
                fill(k, node[3], 2 * at + 2)
            elif at < size:  # an early leaf: the way on is always the low one
                fill(k, node, 2 * at + 1)
            else:
                leaves[k, at - size] = node

        for k, t in enumerate(self.trees):
            fill(k, t, 0)
        limits[np.isinf(limits)] = np.finfo(float).max
        feature = F.expr(f"array({', '.join(map(str, features.ravel().tolist()))})")
        limit, leaf = (F.expr(f"array({', '.join(f'{float(v)!r}D' for v in x.ravel())})") for x in (limits, leaves))

        def walk(v: Column, k: Column) -> Column:
            step = lambda at, _: at * 2 + 1 + (F.get(v, F.get(feature, k * size + at)) > F.get(limit, k * size + at)).cast("int")
            return F.get(leaf, k * (size + 1) + F.aggregate(F.sequence(F.lit(1), F.lit(DEPTH)), F.lit(0), step) - size)

        values = F.array(*(f[n] for n in FEATURES))
        return _let(values, lambda v: F.aggregate(F.sequence(F.lit(0), F.lit(len(self.trees) - 1)), F.lit(self.bias), lambda total, k: total + walk(v, k)))


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int):
    """A regression tree by exact splits on the logistic loss's gradients."""
    value = float(-RATE * grad.sum() / (hess.sum() + 1))
    if depth == 0 or len(x) < 20:
        return value
    best, parent = (1e-6, None), grad.sum() ** 2 / (hess.sum() + 1)
    for k in range(x.shape[1]):
        order = np.argsort(x[:, k], kind="stable")
        v = x[order, k]
        g, h = np.cumsum(grad[order])[:-1], np.cumsum(hess[order])[:-1]
        gain = g**2 / (h + 1) + (grad.sum() - g) ** 2 / (hess.sum() - h + 1) - parent
        gain[v[1:] == v[:-1]] = 0
        if len(gain) and (i := int(np.argmax(gain))) >= 0 and gain[i] > best[0]:
            best = (gain[i], (k, float((v[i] + v[i + 1]) / 2)))
    if best[1] is None:
        return value
    k, limit = best[1]
    low = x[:, k] <= limit
    return (k, limit, _grow(x[low], grad[low], hess[low], depth - 1), _grow(x[~low], grad[~low], hess[~low], depth - 1))


def _apply(tree, x: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(x), tree)
    k, limit, low, high = tree
    return np.where(x[:, k] <= limit, _apply(low, x), _apply(high, x))


def _kinds(x: np.ndarray) -> np.ndarray:
    """The kind, a place in KINDS, of each row of features; as _kind()."""
    at, dots, digits, length = (x[:, FEATURES.index(n)] for n in ("at", "dots", "digits", "length"))
    return np.where(at > 0, 0, np.where((dots == 3) & (digits == length - 3), 1, np.where(digits > 15, 2, 3)))


def boost(x: np.ndarray, y: np.ndarray) -> Trees | None:
    """Fit trees on four fifths of the rows; calibrate on the rest.

    A kind's threshold is the least margin at and above which PRECISION of its left-out rows are right; where no
    margin is that precise nothing of the kind is added. None if that holds for all kinds, or if there are not
    rows of both classes in both parts.
    """
    held = np.arange(len(y)) % 5 == 0
    if any(len(set(y[p].tolist())) < 2 for p in (held, ~held)):
        return None
    a, b = x[~held], y[~held]
    bias = float(np.log(b.mean() / (1 - b.mean())))
    margin, trees = np.full(len(a), bias), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        trees.append(_grow(a, p - b, p * (1 - p), DEPTH))
        margin += _apply(trees[-1], a)
    thresholds = []
    for k in range(len(KINDS)):
        own = held & (_kinds(x) == k)
        out = bias + sum(_apply(t, x[own]) for t in trees)
        order = np.argsort(-out, kind="stable")
        right = np.cumsum(y[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero((right >= PRECISION) & (np.append(np.diff(out[order]), -1) < 0)) if own.any() else []
        thresholds.append(max(0.0, float(out[order][ok[-1]])) if len(ok) else float("inf"))
    return Trees(trees, bias, thresholds) if min(thresholds) < float("inf") else None


def _checked(rng: random.Random, n: int, right: bool) -> str:
    """n digits that pass the Luhn check, or fail it."""
    d = [rng.randrange(1, 10), *(rng.randrange(10) for _ in range(n - 2))]
    total = sum(x if (n - i) % 2 else 2 * x - 9 * (x > 4) for i, x in enumerate(d))
    return "".join(map(str, [*d, (-total + (0 if right else rng.randrange(1, 10))) % 10]))


def _value(rng: random.Random) -> tuple[bool, str]:
    """A value to plant, and whether it is personal data."""
    number = lambda n: "".join(str(rng.randrange(10)) for _ in range(n))
    name = lambda letters: "".join(rng.choice(letters) for _ in range(rng.randrange(3, 9)))
    plain, wide = "abcdefghijklmnopqrstuvwxyz", "abcdeghiklmnorstuwzäöüéñß"
    right = rng.random() < 0.6
    kind = rng.choice(KINDS)
    if kind == "email":
        letters = rng.choice((plain, wide))
        local = name(letters) + rng.choice(("", "." + name(letters), str(rng.randrange(100)), "_" + name(plain), "+" + name(plain)))
        if right:
            return True, f"{local}@{name(letters)}.{rng.choice(('com', 'org', 'de', 'fr', 'example.com', 'co.uk'))}"
        return False, rng.choice((f"@{name(plain)}", f"{local}@{name(plain)}", f"{local}@{rng.randrange(10)}.{rng.randrange(100)}", f"{local}@@{name(plain)}.com"))
    if kind == "ip":
        part = [rng.randrange(1, 256) for _ in range(4)]
        if not right:
            part = rng.choice(([*part[:3], rng.randrange(256, 999)], part[:3] + [1000 + part[3]], [300 + part[0], *part[1:]], [*part, part[0], part[1]]))
        return right, ".".join(map(str, part))
    if kind == "card":
        digits = _checked(rng, rng.choice((16, 16, 16, 19)), right)
        return right, rng.choice(("", " ", "-", ".")).join(digits[k : k + 4] for k in range(0, len(digits), 4))
    area, mid, end = number(3), number(3), number(4)
    if right:
        code = "+" + str(rng.randrange(1, 100))
        tight = f"{code}{area}{mid}{end}"
        pairs = " ".join((code, number(1), number(2), number(2), number(2), number(2)))
        return True, rng.choice((f"{code} ({area}) {mid}-{end}", f"{code} {area} {mid} {end}", f"{code}-{area}-{mid}-{end}", f"{code} {area}{mid}{end}", tight, pairs, f"({area}) {mid}-{end}", f"{area}-{mid}-{end}", f"{area}.{mid}.{end}"))
    day, month, year = rng.randrange(10, 29), rng.randrange(10, 13), rng.randrange(1900, 2100)
    return False, rng.choice((number(rng.randrange(7, 20)), f"{year}-{month}-{day}", f"{day}.{month}.{year}", f"{year}-{year + 9}", f"978-3-{number(2)}-{number(6)}-{number(1)}", f"{number(1)}.{number(8)}", f"{number(4)} {number(4)}", f"{number(2)} {number(3)} {number(2)}", name("0123456789abcdef") + number(9) + name("abcdef"), f"{number(5)}-{number(6)}"))


def planted(contexts: list[tuple[str, str]], n: int = PLANTED, seed: int = SEED) -> list[tuple[str, list[tuple[int, int]]]]:
    """n values, one or two together, between words: the text and the places, in code points, of personal data in it."""
    rng, out, left = random.Random(seed), [], n
    while left > 0 and contexts:
        text, own = rng.choice(contexts)[0] + " ", []
        for k in range(min(left, rng.choice((1, 2)))):
            right, value = _value(rng)
            text += rng.choice((" ", " ", ", ", "\n")) if k else ""
            own += [(len(text), len(text) + len(value))] * right
            text, left = text + value, left - 1
        out.append((text + rng.choice((" ", ", ", ". ", "\n")) + rng.choice(contexts)[1], own))
    return out


def _table(spark: SparkSession, texts: list[str]) -> DataFrame:
    """(id, text) by place; from Arrow, so that executors start no Python workers to unpickle rows."""
    return spark.createDataFrame(pa.table({"id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())}))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", most: int = MOST_CANDIDATES, documents: int = MOST_DOCUMENTS) -> Trees | None:
    """Fit on values planted between words of the documents, and on candidates of theirs that pass no check.

    About `documents` documents are read, those whose hash of the id falls below their share of all, so that what
    is gathered does not grow with the data: a few words of each of at most `most` of them, and the features of at
    most `most` candidates. None without documents.
    """
    share = min(1.0, documents / max(1, docs.count()))
    chosen = docs.where(F.shiftrightunsigned(F.xxhash64(id_col), 11) < int(share * (1 << 53))) if share < 1 else docs
    chosen = chosen.select(F.col(id_col).alias("id"), _clean(F.col(text_col)).alias("text"))
    words = chosen.select("id", *(F.regexp_replace(F.substring("text", at, 4 * CONTEXT), "[0-9@+]+", " ").alias(n) for n, at in (("a", 1), ("b", -4 * CONTEXT))))
    contexts = words.orderBy(F.xxhash64("id"), "id", "a", "b").limit(most).collect()
    texts = planted([(r["a"][-CONTEXT:].strip(), r["b"][:CONTEXT].strip()) for r in contexts])
    if not texts:
        return None
    proposed, features = F.explode(candidates(F.col("text"))).alias("c"), _features(F.col("c")).alias("f")
    snippets = _table(docs.sparkSession, [t for t, _ in texts]).select("id", proposed)
    right = [(r["id"], r["start"], r["end"], tuple(r["f"])) for r in snippets.select("id", "c.start", "c.end", features).collect()]
    own = chosen.select("id", proposed).orderBy(F.xxhash64("id", "c.start", "c.end"), "id", "c.start", "c.end").limit(most).select(features)
    f = lambda n: F.col(f"f.{n}")
    unclear = (f("luhn") == 1) | (f("small_parts") == 1) | (f("host") == 1) | (f("plus") == 1) | (f("groups").between(3, GROUPS) & (f("groups_before") == 0) & (f("at") == 0))
    wrong = [tuple(r["f"]) for r in own.where(~unclear).collect()]
    rows = sorted([(v, float((start, end) in texts[k][1])) for k, start, end, v in right] + [(v, 0.0) for v in wrong])
    random.Random(SEED).shuffle(rows)
    return boost(np.array([v for v, _ in rows], float).reshape(-1, len(FEATURES)), np.array([y for _, y in rows], float))


def _kind(f: Column) -> Column:
    """A place in KINDS."""
    return F.when(f["at"] > 0, 0).when((f["dots"] == 3) & (f["digits"] == f["length"] - 3), 1).when(f["digits"] > 15, 2).otherwise(3)


def _chosen(base: Column, scored: Column) -> Column:
    """The candidates that touch no base span; of those that overlap each other, from the left, the one of the higher margin."""
    item = "struct<start: bigint, extra: int, end: bigint, kind: int, margin: double>"
    place = lambda s, extra, margin: F.struct(s["start"].alias("start"), F.lit(extra).alias("extra"), s["end"].alias("end"), s["kind"].alias("kind"), margin.alias("margin"))
    items = F.array_sort(F.concat(F.transform(base, lambda s: place(s, 0, F.lit(None).cast("double"))), F.transform(scored, lambda s: place(s, 1, s["margin"]))))
    start = F.struct(F.lit(-1).cast("bigint").alias("cover"), F.expr(f"CAST(NULL AS {item})").alias("last"), F.expr(f"CAST(array() AS array<{item}>)").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        last, fixed = acc["last"], x["extra"] == 0
        meets = last.isNotNull() & (last["end"] > x["start"])
        taken = ~fixed & (x["start"] >= acc["cover"]) & (~meets | (x["margin"] > last["margin"]))
        now = F.when(taken, x).when(fixed & meets, F.expr(f"CAST(NULL AS {item})")).otherwise(last)
        out = F.when(taken & last.isNotNull() & ~meets, F.concat(acc["out"], F.array(last))).otherwise(acc["out"])
        return F.struct(F.when(fixed, F.greatest(acc["cover"], x["end"])).otherwise(acc["cover"]).alias("cover"), now.alias("last"), out.alias("out"))

    done = F.aggregate(items, start, step, lambda acc: F.when(acc["last"].isNull(), acc["out"]).otherwise(F.concat(acc["out"], F.array(acc["last"]))))
    return F.transform(done, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))


def find(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """docs' columns with base and spans, each array<struct<kind int, start, end>> sorted by kind and start.

    kind is a place in KINDS; offsets are code points, end exclusive. base are the spans of the fixed
    patterns; spans are those and the candidates that the trees select, of which none overlaps a base span or
    another. Null and empty texts have none. Rows are judged one by one; columns of the new names are replaced.
    """
    keep = [c for c in docs.columns if c not in ("base", "spans")]
    t = docs.select(*keep, _clean(F.col(text_col)).alias("__text"))
    plain = t.select(*keep, "__text", *(s.alias(f"__{k}") for k, s in base_spans(F.col("__text")).items()))
    named = [F.transform(f"__{k}", _numbered(i)) for i, k in enumerate(KINDS)]
    out = plain.withColumn("base", F.concat(*named)).drop(*(f"__{k}" for k in KINDS))
    if trees is None:
        return out.withColumn("spans", F.col("base")).drop("__text")
    least = F.array(*map(F.lit, trees.thresholds))

    def scored(c: Column) -> Column:
        return _let(_features(c), lambda f: F.struct(_kind(f).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), trees.margin(f).alias("margin")))

    extra = F.filter(F.transform(candidates(F.col("__text")), scored), lambda c: c["margin"] >= F.get(least, c["kind"]))
    more = _let(extra, lambda x: _if(F.size(x) > 0, _chosen(F.col("base"), x), "array<struct<kind: int, start: bigint, end: bigint>>"))
    return out.withColumn("spans", F.array_sort(F.concat("base", more))).drop("__text")


def _numbered(i: int) -> Callable[[Column], Column]:
    return lambda s: F.struct(F.lit(i).alias("kind"), s["start"].alias("start"), s["end"].alias("end"))


def digest_text(spans: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", name(s), s["start"].cast("string"), s["end"].cast("string"))), ",")


#: Rounds of the fixed patterns over what a replacement next to it has uncovered.
ROUNDS = 3


def redact(docs: DataFrame, trees: Trees | None, text_col: str = "text") -> DataFrame:
    """docs with each span replaced by its kind in brackets; of spans that overlap, the first names both.

    A replaced span can uncover a match that its characters were part of: texts with spans are searched by the
    fixed patterns up to ROUNDS times more. A text without spans stays as it is; a null text stays null; n_chars,
    where there is one, is counted anew.
    """
    names = docs.columns
    plain = [f"c{i}" for i in range(len(names))]
    own = f"c{names.index(text_col)}"
    kind = "array<struct<kind: int, start: bigint, end: bigint>>"
    label = lambda s: F.get(F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS)), s["kind"])

    def cut(text: Column, spans: Column) -> Column:
        piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))
        by_place = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
        begin = F.struct(F.lit(0).cast("bigint").alias("at"), F.expr("CAST(array() AS ARRAY<STRING>)").alias("out"))

        def step(acc: Column, s: Column) -> Column:
            new = s["start"] >= acc["at"]
            parts = F.when(new, F.concat(acc["out"], F.array(piece(acc["at"], s["start"]), label(s)))).otherwise(acc["out"])
            return F.struct(F.greatest(acc["at"], -s["back"]).alias("at"), parts.alias("out"))

        return F.aggregate(by_place, begin, step, lambda acc: F.concat(F.array_join(acc["out"], ""), piece(acc["at"], F.length(text).cast("bigint"))))

    def searched(text: Column) -> Column:
        spans = F.concat(*(F.transform(s, _numbered(i)) for i, s in enumerate(base_spans(_clean(text)).values())))
        return F.struct(text.alias("text"), F.coalesce(spans, F.expr(f"CAST(array() AS {kind})")).alias("spans"))

    # one fold in one expression: as a chain of columns a later filter on the text would be rewritten through them all
    once = lambda acc, _: F.when(F.size(acc["spans"]) == 0, acc).otherwise(_let(cut(acc["text"], acc["spans"]), searched))
    start = F.struct(F.col(own).alias("text"), F.col("spans").cast(kind).alias("spans"))
    out = find(docs.toDF(*plain), trees, own).withColumn(own, F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS)), start, once, lambda acc: acc["text"]))
    if "n_chars" in names:
        out = out.withColumn(f"c{names.index('n_chars')}", F.length(own).cast("bigint"))
    return out.select(*plain).toDF(*names)
