"""Scalar text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Word characters as Unicode has them, in Java's regular expressions.
NOT_WORD = r"[^\p{L}\p{N}_\s]"

# The words that open a question.
QUESTION = r"(?i)^\s*(where|what|who|whom|when|why|how|which|is|are|was|were|do|does|did|can|could|should|would|will)\b"

# Names that language models give to conflict and link types.
CONFLICT_ALIASES = {
    "evolution": "evolution", "tension": "tension", "none": "none", "disagreement": "tension", "contradiction": "tension",
    "conflict": "tension", "change": "evolution", "update": "evolution", "revised": "evolution", "refinement": "evolution",
}
LINK_ALIASES = {
    "supports": "supports", "contradicts": "contradicts", "related_to": "related_to", "none": "none", "support": "supports", "contradict": "contradicts",
    "contradiction": "contradicts", "related": "related_to", "relevant": "related_to", "part_of": "part_of", "derived_from": "derived_from",
    "depends_on": "depends_on", "dependency": "depends_on",
}


def strip(text: Column) -> Column:
    """Without white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def _cut_at_word(text: Column, most: int, end: str) -> Column:
    head = F.regexp_replace(F.substring(text, 1, most), " [^ ]*$", "")
    return F.when(F.length(text) <= most, text).when(head == "", F.substring(text, 1, most)).otherwise(F.concat(head, F.lit(end)))


def title(content: Column, most: int = 60) -> Column:
    """The first line, cut at a word's end."""
    return _cut_at_word(strip(F.split(strip(content), "\n")[0]), most, "…")


def excerpt(content: Column, most: int = 60) -> Column:
    return _cut_at_word(F.regexp_replace(content, "\n", " "), most, "...")


def embedding_text(heading: Column, content: Column, most: int = 512) -> Column:
    return strip(F.concat_ws(" ", F.coalesce(heading, F.lit("")), F.substring(content, 1, most)))


def first_sentence(content: Column, most: Column | int) -> Column:
    """Up to the first of four sentence ends, in their order, that stands inside `most`; else cut there."""
    text, most = strip(content), F.lit(most) if isinstance(most, int) else most
    out = F.when(F.length(text) <= most, text)
    for end in (". ", ".\n", "; ", "\n"):
        at = F.instr(text, end) - 1
        out = out.when((at > 0) & (at < most), F.substring(text, F.lit(1), at + 1))
    return out.otherwise(F.substring(text, F.lit(1), most.cast("int")))


def rerank_text(heading: Column, content: Column, most: int = 512) -> Column:
    return F.when(heading.isNull() | (heading == ""), F.substring(content, 1, most)).when(heading == content, heading).otherwise(F.concat(heading, F.lit(": "), F.substring(content, 1, most)))


def words(text: Column) -> Column:
    """Lower-cased words without punctuation."""
    return F.filter(F.split(F.lower(F.regexp_replace(text, NOT_WORD, "")), r"\s+"), lambda w: w != "")


def is_question(text: Column) -> Column:
    return text.rlike(QUESTION)


def too_short(prompt: Column) -> Column:
    return F.length(F.regexp_replace(prompt, "[^a-zA-Z0-9]", "")) <= 2


def token_jaccard(a: Column, b: Column) -> Column:
    """Of the sets of lower-cased words between white space; 0 if either is empty."""
    x, y = (F.array_distinct(F.filter(F.split(F.lower(c), r"\s+"), lambda w: w != "")) for c in (a, b))
    return F.when((F.size(x) == 0) | (F.size(y) == 0), 0.0).otherwise(F.size(F.array_intersect(x, y)) / F.size(F.array_union(x, y)))


def edit_ratio(a: Column, b: Column) -> Column:
    """1 less the edit distance over the longer length; 0 if either is null or empty."""
    x, y = strip(F.lower(a)), strip(F.lower(b))
    some = (F.length(x) > 0) & (F.length(y) > 0)
    return F.coalesce(F.when(some, 1 - F.levenshtein(x, y) / F.greatest(F.length(x), F.length(y))), F.lit(0.0))


def duplicate_score(similarity: Column, title_ratio: Column, overlap: Column) -> Column:
    return 0.6 * similarity + 0.2 * title_ratio + 0.2 * overlap


def json_part(text: Column) -> Column:
    """The JSON inside a model's answer: all of it, a fenced block, or what the outermost brackets enclose."""
    whole = strip(text)
    fenced = strip(F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1))
    braces, brackets = F.regexp_extract(text, r"(?s)(\{.*\})", 1), F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    out = None
    for c in (whole, fenced, braces, brackets):
        good = (c.startswith("{") | c.startswith("[")) & F.try_parse_json(c).isNotNull()
        out = F.when(good, c) if out is None else out.when(good, c)
    return out


def alias(raw: Column, names: dict[str, str], default: str) -> Column:
    pairs = [F.lit(x) for item in names.items() for x in item]
    return F.coalesce(F.element_at(F.create_map(*pairs), strip(F.lower(raw))), F.lit(default))


def space_of_folder(encoded: Column) -> Column:
    """The last part of a folder name in which - stands for the separators."""
    return F.element_at(F.split(F.regexp_replace(encoded, "^-+", ""), "-"), -1)


def space_of_path(path: Column) -> Column:
    """The last folder of a path; none for a home folder or the root."""
    p = F.regexp_replace(path, "/+$", "")
    home = p.rlike(r"^(/home/[^/]+|/Users/[^/]+|/root)?$")
    return F.when(~home, F.element_at(F.split(p, "/"), -1))


def glob_pattern(glob: str) -> str:
    """A regular expression for a path glob: ** as *, and a leading */ may be missing."""
    g = glob.replace("**", "*")

    def one(x: str) -> str:
        return "".join(".*" if c == "*" else "." if c == "?" else "\\" + c if not c.isalnum() else c for c in x)

    return "^(?:" + "|".join(dict.fromkeys((one(g), one(g.removeprefix("*/"))))) + ")$"


def slug(heading: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.lower(heading), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def merge_preview(action: Column) -> tuple[Column, Column]:
    """What stands before and after the line that parts a proposal's text."""
    parts = F.split(action, "\n---\n", 2)
    return parts[0], F.try_element_at(parts, F.lit(2))


def token_cost(chars: Column, model: Column, prices: list[tuple[str, float, float]], output_share: float = 0.15) -> Column:
    """Price of reading `chars` and writing a share of it; the first name found in the model's counts, per million tokens."""
    tokens = F.floor(chars / 4)
    out = None
    for name, read, write in prices:
        cost = (tokens * read + F.floor(tokens * output_share) * write) / 1e6
        out = F.when(F.contains(model, F.lit(name)), cost) if out is None else out.when(F.contains(model, F.lit(name)), cost)
    return out
