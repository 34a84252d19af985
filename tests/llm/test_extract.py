"""Main texts of hand-made pages of several hosts, and the query against the pages' own form."""

import re
from html import unescape

import pytest
from pyspark.sql import functions as F

from recollect.llm import extract
from recollect.llm.queries import op12_extract

SF = "/root/testdata/sf0.001"
PROSE = "This is a sentence of the article, long enough to be prose"


def soup(n, body):
    return f"""<!doctype html><HTML><head><title>Title {n}</title><style>p{{}}</style><script>if (a < b) document.write("<p>no</p>")</script></head>
<body class="has-sidebar"><div id="top-header"><h1>Site name</h1></div><div class="main-nav"><ul><li><a href="/">Home</a><li><a href=/x>More</a></ul></div>
<div class="cookie-notice"><p>We use cookies, many of them, all of the time.</p></div>
<div class="wrap-{n}"><div class="post-content" id="post-{n}">{body}</div><div class="sidebar"><p>{PROSE} of the side.</p></div>
<section class="comments"><article class="comment"><p>{PROSE} by a reader.</p></article></section></div>
<form><p>Your name</p><input name="n"><textarea>text</textarea></form><footer><p>&copy; Site</p></footer></body></html>"""


PAGES = [
    # host a: no semantic tags; paths agree once digits are generalised
    *((k, f"http://A.example.com/{k}", soup(k, f"<h2>Head {k}</h2><p>{PROSE} {k}.<p>Second &amp; <b>bold</b>\n  text&nbsp;here.<div class='ad'>Buy this</div><ul><li>one<li>two</ul><br>tail"), f"Head {k}\n{PROSE} {k}.\nSecond & bold text here.\none\ntwo\ntail") for k in range(6)),
    # a short page of host a: its menu-like text would win by itself, its host's path decides
    (10, "http://a.example.com/10", soup(10, "<p>Short.</p>").replace("</form>", f"</form><div class='box'><p>{PROSE} elsewhere on the page, which only this page has.</p></div>"), "Short."),
    # another host: article, header with a heading, unclosed tags, nested junk
    (20, "https://b.example.org:8080/x?y", f"<nav>menu<article><header><h1>Name</h1><p>by line</p></header><p>{PROSE}.<br>next<!-- <p>no</p> --><aside>side</aside><p hidden>no</p><p style='display:none'>no</p><p>&#233;&eacute; &lt;tag&gt; 1 < 2</article><footer>foot", f"Name\n{PROSE}. next\néé <tag> 1 < 2"),
    (21, None, f"<p>{PROSE}</p><p><a href=x>only a link of the page</a></p>", PROSE),
    (22, "http://c.example.org", None, ""), (23, "http://c.example.org", "", ""), (24, "http://c.example.org", "<script>x</script><nav>menu</nav>", ""),
    (25, "http://c.example.org", "plain text & more", "plain text & more"), (26, "not a url", "<div class='sidebar'><p>all of the page is by class a side</p></div>", "all of the page is by class a side"),
    (27, "http://d.example.org", f"<p title='never ends>{PROSE}</p><p>more</p>", f"{PROSE}\nmore"), (28, "http://d.example.org", "<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
    (29, "http://d.example.org", "<table><tr><td>a<td>b<tr><td>c</table>", "a\nb\nc"), (None, "http://d.example.org", "<p>null id</p>", "null id"), (30, "http://d.example.org", "<p>" + "long " * 200_000 + "</p>", ("long " * 200_000).strip()),
]


@pytest.mark.parametrize("most", [0, 100_000])
def test_hand_made_pages(spark, monkeypatch, most):
    monkeypatch.setattr(extract, "BROADCAST", most)
    df = spark.createDataFrame([p[:3] for p in PAGES] * 2, "page_id bigint, url string, html string").withColumns({c: F.lit(None).cast("int") for c in ("host", "path", "paths", "text", "salt", "c0")})
    got = extract.extract(df)
    assert got.columns == ["page_id", "url", "host", "path", "paths", "salt", "c0", "text"]
    rows = got.collect()
    assert len(rows) == 2 * len(PAGES)
    want = {p[0]: p[3] for p in PAGES}
    for r in rows:
        assert r.text == want[r.page_id], r.page_id
    assert extract.extract(df.limit(0)).collect() == []


def test_votes_are_sums_by_host(spark):
    df = spark.createDataFrame([("h", p[2]) for p in PAGES[:6]] + [("h", None), ("g", "<article><p>x</p></article>")], "host string, html string")
    got = {(r.host, r.path): r.pages for r in extract.votes(df.repartition(3)).collect()}
    assert got == {("h", ">html>body>div.wrap-#>div.post-#.post-content"): 6, ("g", ">article"): 1}
    assert {r.host: r.paths for r in extract.winners(extract.votes(df)).collect()} == {"h": [">html>body>div.wrap-#>div.post-#.post-content"], "g": [">article"]}


def test_query(spark):
    """The pages have one article each; its blocks begin at h1, p and li."""
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = {r.page_id: r for r in op12_extract(spark, SF).collect()}
    assert got.keys() == pages.keys()
    for k, page in pages.items():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S).group(1)
        parts = re.split(r"</?(?:h1|p|li|ul|div)(?: [^>]*)?>", inner)
        blocks = [" ".join(unescape(re.sub(r"<[^>]*>", " " if "<br>" in b else "", b)).split()) for b in parts]
        assert got[k].text == "\n".join(b for b in blocks if b)
        assert got[k].n_chars == len(got[k].text) and got[k].url == page.url
