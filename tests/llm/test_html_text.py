"""Page text against hand-made pages and a plain reading of the given pages."""

import html
import random
import re

from graftwork.llm import html_text
from graftwork.llm.catalog import QUERIES

SF_DIR = "/root/testdata/sf0.01"

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><article>x";</script></head>
<body class="has-sidebar"><header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav>
<div class="cookie-notice">We use cookies on this site and you agree to all of them now.</div>
<!-- <p>hidden</p> --><div class="ad">Buy now, this long advert wants to look like text to you.</div>
<article><header><h1>Title &amp; more</h1></header><p>First   <b>bold</b>text.<br>Second&nbsp;line<p>Un<i>closed</p>
<p>ok</p><ul><li>one<li>two</ul><table><tr><td>a</td><td>b</td></tr></table>
<form><label>Name</label><input name=x><button>Go</button></form><aside>See also this long list of other things.</aside>
<section id="comments"><p>A reader says quite a lot of words here, all of them unwanted.</p></section></article>
<div class="sidebar-widget"><p>Other posts that are long enough to be text of the page.</p></div>
<footer>&copy; all rights</footer></body></html>"""


def test_article():
    assert html_text.main_text(PAGE) == "Title & more First boldtext. Second line Unclosed ok one two a b"


def test_without_article():
    long = "A sentence of the story with many words in it that goes on for quite a while. " * 4
    page = f"<body><div class=menu><a href=/>Home</a></div><div><a href=/x>x</a> <a href=/y>yy</a></div><div id=content><h2>Head</h2><p>{long}</p><p>short</p><p>{long}</p></div><div class=footer>end</div>"
    text = html_text.main_text(page)
    assert text == f"Head {long.strip()} short {long.strip()}"


def test_odd_pages(spark):
    pages = [None, "", "plain text only", "<", "<p", "</p></div>x", "<article></article>", "&lt;b&gt; &#x41;", "<p>" * 3000 + "deep", "<article>" + "<p>word</p>" * 20_000]
    df = spark.createDataFrame([(i, None, p, "t") for i, p in enumerate(pages)], "page_id long, url string, html string, text string")
    got = {r["page_id"]: r for r in html_text.extract(df).collect()}
    assert len(got) == len(pages)
    assert [got[i]["text"] for i in (0, 1, 2, 6, 7)] == ["", "", "plain text only", "", "<b> A"]
    assert got[8]["text"] == "deep" and got[9]["text"] == " ".join(["word"] * 20_000)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())
    assert html_text.extract(df.limit(0)).count() == 0


def _plain(page):
    body = page[page.index("<article>") + 9 : page.index("</article>")]
    parts = re.split(r"<[^>]+>", body)
    return " ".join(" ".join(html.unescape(x).split()) for x in parts if x.strip())


def test_query(spark):
    pages = {r["page_id"]: r["html"] for r in spark.read.parquet(f"{SF_DIR}/pages.parquet").collect()}
    rows = QUERIES["op3_html_text"](spark, SF_DIR).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r["text"] == _plain(pages[r["page_id"]])
        assert r["n_chars"] == len(r["text"])


LONG = "A sentence of the story with many words in it that goes on for quite a while. " * 4


def test_labels_lose_no_article_text():
    inner = f"<h2 id=sharing-results>Sharing</h2><p id=copyright-law>Law</p><section id=related-work><h3 class=search>How</h3><p>{LONG}</p></section>"
    for page in (f"<article>{inner}<div class=notice><p>{LONG}</p></div><div class='ad'>Buy</div></article>", f"<div class='layout has-sidebar'><div class=sidebar><main>{inner}<p>{LONG}</p></main></div></div>", f"<div class='banner'>{inner}<p>{LONG}</p></div>"):
        assert html_text.main_text(page) == f"Sharing Law How {LONG.strip()} {LONG.strip()}"


def test_short_parts_without_article():
    cells = "<table><tr><td>a</td><td>b</td></tr><tr><td>c</td><td>d</td></tr></table>"
    verse = "<div><p>one</p><p>two</p><p>three</p><p>four</p></div><section><h2><a href=/h>Linked heading</a></h2><p>five</p></section>"
    page = f"<body><div><a href=/x>x</a></div><div id=content><p>{LONG}</p><p>{LONG}</p>{cells}{verse}<p>{LONG}</p></div><div><a href=/y>y</a></div></body>"
    text = f"{LONG.strip()} {LONG.strip()} a b c d one two three four Linked heading five {LONG.strip()}"
    assert html_text.main_text(page) == text


SHORT = LONG.strip()


def test_compound_labels_inside_an_article():
    for name in ("user-comment-list", "reader-comments", "post-share", "site-footer", "ad-slot-top", "article-ad", "articleAd", "comments_area"):
        page = f"<article><h1>Head</h1><p>{LONG}</p><div class='{name}'><p>Short</p></div><p>{LONG}</p><p>end</p></article>"
        assert html_text.main_text(page) == f"Head {SHORT} {SHORT} end", name
    for name in ("reader-comments", "article-ad", "ad-slot-top", "newsletter-signup"):
        page = f"<article><p>{LONG}</p><p>{LONG}</p><div class='{name}'><p>{LONG}</p></div></article>"
        assert html_text.main_text(page) == f"{SHORT} {SHORT}", name
    for name in ("has-sidebar", "comments-open", "no-ads", "lead", "body-text"):
        page = f"<article><p>{LONG}</p><div class='{name}'><p>Short</p></div><p>{LONG}</p></article>"
        assert html_text.main_text(page) == f"{SHORT} Short {SHORT}", name


def test_forms():
    around = f"<body><form action=/><div id=c><h1>Head</h1><p>{LONG}</p><p>ok</p><label>Find</label><input><p>{LONG}</p></div></form></body>"
    assert html_text.main_text(around) == f"Head {SHORT} ok {SHORT}"
    assert html_text.main_text(f"<form><article><p>One</p></article><p>{LONG}</p></form>") == "One"
    inside = f"<article><p>{LONG}</p><form><p>Send us your words</p></form><form><p>{LONG}</p></form><p>{LONG}</p></article>"
    assert html_text.main_text(inside) == f"{SHORT} {SHORT}"


def test_formulas_stay_in_their_sentence():
    formula = "<math><semantics><mrow><msup><mi>x</mi><mn>2</mn></msup><mo>=</mo><mi>y</mi></mrow><annotation encoding=tex>x^2=y</annotation></semantics></math>"
    assert html_text.main_text(f"<article><p>We see {formula} here.</p></article>") == "We see x2=y here."


def test_teasers_beside_the_main_part():
    main = f"<main><h1>Head</h1><p>{LONG}</p><p>mid</p><p>{LONG}</p></main>"
    teaser = f"<article><h2>Other</h2><p>{SHORT[:80]}</p></article>"
    assert html_text.main_text(f"<body>{main}{teaser}{teaser}</body>") == f"Head {SHORT} mid {SHORT}"


def test_generated_pages():
    """Every mix of parts around and inside an article against the list of kept blocks."""
    rng = random.Random(4)
    noise = [
        "<nav><a href=/>Home</a></nav>", "<div class='site-footer'>Foot words</div>", "<div class=ad-slot>Buy it now</div>",
        "<form><label>Mail</label><input></form>", "<section class=reader-comments><p>I like it</p></section>",
        "<aside>See also</aside>", "<script>var a = 1;</script>", "<div class='cookie-box'>We use cookies</div>",
    ]
    for _ in range(200):
        blocks = ["Head"] + [rng.choice([SHORT, SHORT[:120], "short", "a &amp; b"]) for _ in range(rng.randint(2, 8))] + [SHORT]
        inner = "".join(f"<p>{b}</p>" + (rng.choice(noise) if rng.random() < 0.4 else "") for b in blocks)
        tag = rng.choice(["article", "main"])
        page = "".join(rng.sample(noise, 3)) + f"<{tag}>{inner}</{tag}>" + "".join(rng.sample(noise, 3))
        page = rng.choice(["<body>{}</body>", "<body><form>{}</form></body>", "<div class='page has-sidebar'>{}</div>"]).format(page)
        assert html_text.main_text(page) == " ".join(html.unescape(b) for b in blocks)
