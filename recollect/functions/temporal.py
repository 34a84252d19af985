"""Time phrases in prompts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from recollect.functions.text import strip

# Phrases with the days at which their window begins and ends, in the order they are tried.
WINDOWS = [
    (r"(?i)\btoday\b", 1, 0),
    (r"(?i)\byesterday\b", 2, 1),
    (r"(?i)\blast\s+week\b", 14, 7),
    (r"(?i)\bthis\s+week\b", 7, 0),
    (r"(?i)\blast\s+month\b", 60, 30),
    (r"(?i)\brecently\b|\blately\b", 3, 0),
]
NUMERIC = r"(?i)\b(?:last|past)\s+(\d+)\s+(hours?|days?|weeks?|months?)\b"
STRIPPED = [w[0] for w in WINDOWS[:-1]] + [r"(?i)\brecently\b|\blately\b|\brecent\b", NUMERIC]
DANGLING = r"(?i)\b(?:in|during|from|over|for)\s+(?:the\s+)?(?=\s*$|\s*,)"
HOURS = {"hour": 1, "day": 24, "week": 168, "month": 720}
DEFAULT_DAYS = 3


def has_phrase(prompt: Column) -> Column:
    out = prompt.rlike(NUMERIC)
    for pattern, _, _ in WINDOWS:
        out = out | prompt.rlike(pattern)
    return out


def window(prompt: Column, now: Column) -> Column:
    """struct<after, before>: the span of time a prompt asks about; the last days if it names none."""
    count = F.regexp_extract(prompt, NUMERIC, 1).try_cast("bigint")
    unit = F.regexp_replace(F.lower(F.regexp_extract(prompt, NUMERIC, 2)), "s$", "")
    per = F.element_at(F.create_map(*[F.lit(x) for p in HOURS.items() for x in p]), unit)
    hours, earlier = count * per, unit.isin("week", "month") & (count > 1)
    begin = F.when(count.isNotNull(), F.when(earlier, hours * 2).otherwise(hours))
    end = F.when(count.isNotNull(), F.when(earlier, hours).otherwise(0))
    for pattern, a, b in WINDOWS:
        begin, end = begin.when(prompt.rlike(pattern), a * 24), end.when(prompt.rlike(pattern), b * 24)
    back = lambda h: F.timestamp_seconds(now.cast("bigint") - h * 3600)
    return F.struct(back(begin.otherwise(DEFAULT_DAYS * 24)).alias("after"), back(end.otherwise(0)).alias("before"))


def without_phrases(prompt: Column) -> Column:
    for pattern in STRIPPED:
        prompt = F.regexp_replace(prompt, pattern, "")
    return strip(F.regexp_replace(F.regexp_replace(prompt, DANGLING, ""), r"\s{2,}", " "))


# Words that leave nothing to search for.
FILLER = """
what did we do i you the a is are was were have has had been be will would could should can may might shall on in at
to for of with by from up about into through during before after above below between out off over under again further
then once here there when where why how all each every both few more most other some such no not only own same so than
too very just because as until while and but or nor if that which who whom this these those am an any work worked
working me my our us show tell give get
""".split()


def only_time(prompt: Column) -> Column:
    """Whether nothing but filler words is left without the time phrases."""
    left = F.filter(F.split(F.lower(F.regexp_replace(without_phrases(prompt), r"[^\p{L}\p{N}_\s]", "")), r"\s+"), lambda w: w != "")
    return F.size(F.array_except(left, F.array(*map(F.lit, FILLER)))) == 0
