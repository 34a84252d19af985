"""HTML extraction: the main text of a page from the container that its host's pages agree on.

A first pass scores each page's containers: the share of the page's prose that one holds against the share of its own
text that is prose (their harmonic mean), a little more for article and main. Prose is the text of blocks outside of
menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments, and not mostly links. A page
votes with its best container, named by its path: tags and classes from the root, digits generalised. Spark adds
the votes up by host, partial sums first, and each page is read again with the best of its host's `PATHS` leading paths
that it has; a page with none of them takes its own best container.

Decisions by name: see JUNK and JUNK_TAGS. A class or id whose last word is in JUNK names junk, unless it says `with` or
`has`; root, body and main are never junk by name. Headings in an article's header stay. Where all of a page would be
junk by class, classes are ignored. Character references are decoded, white space (Unicode's) within a block is one space, a
line break is white space. Null or empty html, or none of it prose: an empty text. A null url is a host of its own.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm import common

#: Paths kept for each host; the rest of its pages take their own best container.
PATHS = 8
#: Rows of leading paths that are broadcast; beyond that they meet the pages by a salted join.
BROADCAST = 100_000
SALTS = 64
#: Bytes of a path; what is longer is cut at the front, where paths of a host are alike.
LONGEST = 400

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe noembed noframes xmp svg math".split())
JUNK_TAGS = frozenset("nav header footer aside form button select menu dialog head object canvas audio video map".split()) | RAW
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
CONTAINERS = frozenset("html body article main section div td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: What a start tag closes, up to the nearest of the second set.
_LIST, _TABLE = frozenset("ul ol menu".split()), frozenset({"table"})
CLOSES = {"li": (frozenset({"li"}), _LIST), "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})), "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})), "tr": (frozenset({"tr"}), _TABLE), "td": (frozenset({"td", "th"}), _TABLE | {"tr"}), "th": (frozenset({"td", "th"}), _TABLE | {"tr"}), "option": (frozenset({"option"}), frozenset({"select"}))}
JUNK = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored sponsors promo promos promotion banner banners sidebar sidebars side aside rail widget widgets menu menus nav navbar navigation breadcrumb breadcrumbs header masthead topbar "
    "footer footers foot comment comments commentlist respond disqus reply replies discussion cookie cookies consent gdpr notice notices alert alerts disclaimer popup modal overlay newsletter subscribe subscription signup login share sharing social "
    "related recommended recommendations toolbar pager pagination paging copyright legal search skip tags tagcloud hidden".split()
)
COMMENT_WORDS = frozenset("comment comments commentlist reply replies respond disqus discussion".split())

_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|\b(hidden)\b")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_DIGITS = re.compile(r"\d+")
_HOST = r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)"


class Block:
    """A block's text, its element and whether it lies in junk by tag or by class."""

    __slots__ = ("heading", "linked", "named", "node", "tagged", "text")

    def __init__(self, node: int, text: str, linked: int, tagged: bool, named: bool) -> None:
        self.node, self.text, self.linked, self.tagged, self.named = node, text, linked, tagged, named


def _names(attributes: str) -> tuple[list[str], bool]:
    """Names in class, id and role, and whether the element is hidden."""
    out, hidden = [], False
    for key, a, b, c, alone in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), a or b or c
        if key in ("class", "id", "role"):
            out += value.split()
        elif alone or key == "hidden" or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I)) or (key == "aria-hidden" and value == "true"):
            hidden = True
    return out, hidden


def _junk_name(name: str) -> bool:
    words = [w.lower() for w in _WORDS.findall(name)]
    return bool(words) and words[-1] in JUNK and not {"with", "has", "no"} & set(words)


class Page:
    """The elements that hold containers, and the blocks of text in page order."""

    def __init__(self, html: str) -> None:
        self.parent, self.tag, self.path, self.blocks = [-1], [""], [""], []
        self._stack: list[tuple[str, int, bool, bool]] = [("", 0, False, False)]  # tag, element, junk by tag, by class
        self._text: list[str] = []
        self._links, self._linked = 0, 0
        self._read(html)

    def _flush(self) -> None:
        text = " ".join("".join(self._text).split())
        if text:
            _, node, tagged, named = self._stack[-1]
            self.blocks.append(Block(node, text, self._linked, tagged, named))
        self._text.clear()
        self._linked = 0

    def _pop_to(self, at: int) -> None:
        if any(s[0] in BLOCKS for s in self._stack[at:]):
            self._flush()
        self._links -= sum(s[0] == "a" for s in self._stack[at:])
        del self._stack[at:]

    def _words(self, raw: str) -> None:
        if raw:
            text = unescape(raw) if "&" in raw else raw
            self._text.append(text)
            if self._links:
                self._linked += len(text.strip())

    def _read(self, html: str) -> None:
        at, end, tag_at, lower = 0, len(html), _TAG, None
        while at < end:
            mark = html.find("<", at)
            if mark < 0:
                self._words(html[at:])
                break
            self._words(html[at:mark])
            if html.startswith("<!--", mark):
                stop = html.find("-->", mark + 4)
                at = end if stop < 0 else stop + 3
                continue
            if html.startswith(("<!", "<?"), mark):
                stop = html.find(">", mark)
                at = end if stop < 0 else stop + 1
                continue
            found = tag_at.match(html, mark)
            if not found and html[mark + 1 : mark + 2].isalpha() | html.startswith("</", mark):
                tag_at = _PLAIN_TAG  # a quote that never ends
                found = tag_at.match(html, mark)
            if not found:
                self._words("<")
                at = mark + 1
                continue
            at = found.end()
            closing, tag, attributes = found.group(1), found.group(2).lower(), found.group(3)
            if closing:
                self._end(tag)
                continue
            self._start(tag, attributes)
            if tag in RAW:
                lower = lower or html.lower()
                stop = lower.find(f"</{tag}", at)
                if stop < 0:
                    stop = at if tag in ("svg", "math", "iframe") else end
                at = stop
                self._end(tag)
                stop = html.find(">", at)
                at = at if html[at : at + 2] != "</" else end if stop < 0 else stop + 1
        self._stack[1:] and self._pop_to(1)
        self._flush()

    def _end(self, tag: str) -> None:
        for i in range(len(self._stack) - 1, 0, -1):
            if self._stack[i][0] == tag:
                self._pop_to(i)
                return
        if tag == "br":
            self._text.append(" ")

    def _start(self, tag: str, attributes: str) -> None:
        if tag == "br":
            self._text.append(" ")
            return
        if tag in CLOSES:
            same, beyond = CLOSES[tag]
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] in beyond:
                    break
                if self._stack[i][0] in same:
                    self._pop_to(i)
                    break
        if tag in BLOCKS:
            for i in range(len(self._stack) - 1, 0, -1):
                if self._stack[i][0] == "p":
                    self._pop_to(i)
                    break
                if self._stack[i][0] in BLOCKS:
                    break
            self._flush()
        if tag in VOID:
            return
        _, node, tagged, named = self._stack[-1]
        names, hidden = _names(attributes) if attributes else ([], False)
        fixed = tag in ("html", "body", "main")
        comment = any(w.lower() in COMMENT_WORDS for n in names for w in _WORDS.findall(n))
        if tag in ("article", "main") and not comment and not any(s[0] in RAW or s[0] == "form" for s in self._stack):
            tagged = False  # a menu that was never closed doesn't hold the article
        tagged = tagged or hidden or (tag in JUNK_TAGS and not fixed)
        if tag in HEADINGS and self._stack[-1][0] in ("header", "hgroup") and any(s[0] in ("article", "main") for s in self._stack):
            tagged = named = False
        named = named or (not fixed and (comment if tag == "article" else any(_junk_name(n) for n in names)))
        if tag in CONTAINERS:
            step = ".".join([tag, *sorted({_DIGITS.sub("#", n) for n in names})]) if not fixed else tag
            self.parent.append(node)
            self.tag.append(tag)
            self.path.append(f"{self.path[node]}>{step}"[-LONGEST:])
            node = len(self.parent) - 1
        if tag == "a":
            self._links += 1
        self._stack.append((tag, node, tagged, named))

    def _good(self) -> list[bool]:
        out = [not (b.tagged or b.named) and 2 * b.linked <= len(b.text) for b in self.blocks]
        return out if any(out) else [not b.tagged for b in self.blocks]

    def scores(self) -> list[float]:
        """For each element, how well it holds the prose and nothing else, 0 to 1.1."""
        n = len(self.parent)
        prose, whole = [0] * n, [0] * n
        for b, good in zip(self.blocks, self._good(), strict=True):
            whole[b.node] += len(b.text)
            prose[b.node] += len(b.text) * good
        for i in range(n - 1, 0, -1):
            whole[self.parent[i]] += whole[i]
            prose[self.parent[i]] += prose[i]
        return [2 * prose[i] / (prose[0] + whole[i]) + 0.1 * (self.tag[i] in ("article", "main")) if prose[i] else 0.0 for i in range(n)]

    def best(self) -> int:
        """The container of the highest score; of equal ones the innermost, then the first. 0 if nothing is prose."""
        scores = self.scores()
        top = max(scores)
        if not top:
            return 0
        return max((i for i, s in enumerate(scores) if s == top), key=lambda i: (self.path[i].count(">"), -i))

    def text(self, paths: list[str]) -> str:
        """The prose in the elements of the first of the paths that gives some, else in the best container."""
        good = self._good()
        for path in paths:
            if path in self.path:
                inside = [p == path for p in self.path]
                for i in range(1, len(inside)):
                    inside[i] |= inside[self.parent[i]]
                if out := "\n".join(b.text for b, g in zip(self.blocks, good, strict=True) if g and inside[b.node]):
                    return out
        best = self.best()
        inside = [i == best for i in range(len(self.path))]
        for i in range(1, len(inside)):
            inside[i] |= inside[self.parent[i]]
        return "\n".join(b.text for b, g in zip(self.blocks, good, strict=True) if g and inside[b.node])


def votes(pages: DataFrame) -> DataFrame:
    """(host, path, weight, pages): the votes of pages (host, html) for their best containers, summed by host."""

    def cast(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in frames:
            weight: dict[tuple, float] = defaultdict(float)
            count: Counter = Counter()
            for host, html in zip(x.column(0).to_pylist(), x.column(1).to_pylist(), strict=True):
                page = Page(html)
                best = page.best()
                if best:
                    weight[host, page.path[best]] += round(page.scores()[best], 3)
                    count[host, page.path[best]] += 1
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in weight], pa.string()), pa.array([k[1] for k in weight], pa.string()), pa.array([round(1000 * w) for w in weight.values()], pa.int64()), pa.array([count[k] for k in weight], pa.int64())], names=["host", "path", "weight", "pages"])

    seen = pages.where("html is not null").mapInArrow(cast, "host string, path string, weight bigint, pages bigint")
    return seen.groupBy("host", "path").agg(F.sum("weight").alias("weight"), F.sum("pages").alias("pages"))


def winners(cast: DataFrame) -> DataFrame:
    """(host, paths): the leading paths of each host, most votes first, then the longest, then by name."""
    order = Window.partitionBy("host").orderBy(F.desc("weight"), F.desc(F.length("path")), "path")
    lead = cast.withColumn("place", F.row_number().over(order)).where(F.col("place") <= PATHS)
    return lead.groupBy("host").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "path"))), lambda s: s["path"]).alias("paths"))


def extract(pages: DataFrame) -> DataFrame:
    """pages (url, html and others) without the html, with text; a text column that was there is replaced."""
    spark = common.prepare(pages.sparkSession)
    plain = {c: f"c{i}" for i, c in enumerate(pages.columns)}
    renamed = pages.toDF(*plain.values())
    url, html = plain["url"], plain["html"]
    host = F.coalesce(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(""))
    leading = common.staged(winners(votes(renamed.select(host.alias("host"), F.col(html).alias("html")))), "paths")
    found = renamed.withColumn("host", host)
    if leading.count() <= BROADCAST:
        found = found.join(F.broadcast(leading), "host", "left")
    else:  # a host of many pages is dealt over the salts
        salted = leading.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        found = found.withColumn("salt", F.pmod(F.xxhash64(*plain.values()), F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"], "left")
    keep = [c for name, c in plain.items() if name not in ("html", "text")]
    slim = found.select(*keep, html, "paths")

    def read(frames: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in frames:
            texts = [Page(h).text(p or []) if h else "" for h, p in zip(x.column(len(keep)).to_pylist(), x.column(len(keep) + 1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*x.columns[: len(keep)], pa.array(texts, pa.string())], names=[*keep, "text"])

    out = slim.mapInArrow(read, slim.select(*keep).schema.add("text", "string"))
    return out.toDF(*(name for name in plain if name not in ("html", "text")), "text")
