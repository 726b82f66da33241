import itertools
import random
import re

from quillgrid.llm import maintext


def test_cut_is_minimal():
    for seed in range(60):
        rnd = random.Random(seed)
        n = rnd.randint(1, 9)
        scores = [rnd.gauss(0, 1.2) for _ in range(n)]
        edges = [(a, b, rnd.random()) for a, b in itertools.combinations(range(n), 2) if rnd.random() < 0.5]
        best = min(maintext.cost(scores, edges, list(x)) for x in itertools.product([False, True], repeat=n))
        assert abs(maintext.cost(scores, edges, maintext.min_cut(scores, edges)) - best) < 1e-9


PAGE = """<!DOCTYPE html><html><head><title>T</title><script>var t="</p>";</script><style>p{}</style></head><body class="has-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/a>Home</a></li></ul></nav><div class="cookie-notice">We use cookies on this site to serve you.</div>
<div id="content"><h2>The  title&nbsp;&amp; more</h2><p><b>First paragraph<br>of some length, with words.<br><p>Second &lt;one&gt;.</p><ul><li>Item</ul>
<div class="ad">Buy this now, it is cheap and good.</div><p>Third.</p><form><p>Your name please, and your address.</p></form></div>
<aside><p>Related things that you may want to read today.</p></aside>
<section class="comments"><article class="comment"><p>I liked this article a lot, thank you for it.</p></article></section><footer>&copy; 2024 Site</footer></body></html>"""


def test_page_without_article():
    assert maintext.main_text(PAGE).split("\n\n") == ["The title & more", "First paragraph of some length, with words.", "Second <one>.", "Item", "Third."]


def test_broken_and_empty_pages():
    assert maintext.main_text(None) == maintext.main_text("") == maintext.main_text("<nav><a>x</a></nav>") == ""
    assert maintext.main_text("<article><p>Unclosed text, that goes on") == "Unclosed text, that goes on"
    assert maintext.main_text("<article><p>One.</p>" + "<p>More words here.</p>" * 5000).count("\n\n") == 5000
    assert maintext.main_text("<article><p>a < b and c</p><!-- x <p>no</p> --><p>d</p>") == "a < b and c\n\nd"


def expected(page):
    """The article of the test pages, cut out by their one known layout."""
    article = re.search(r"<article>(.*?)(?:</article>|$)", page, re.DOTALL)[1]
    import html

    parts = re.split(r"</?(?:p|h1)>", article)
    texts = [re.sub(r"\s+", " ", html.unescape(re.sub(r"<br>", " ", p).replace("<b>", ""))).strip() for p in parts]
    return "\n\n".join(t for t in texts if t)


def test_query_matches_the_known_layout(spark):
    from quillgrid.llm.queries import op4_main_text

    at = "/root/testdata/sf0.01"
    pages = {r.page_id: r for r in spark.read.parquet(f"{at}/pages.parquet").collect()}
    got = op4_main_text(spark, at).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == expected(pages[r.page_id].html) and r.n_chars == len(r.text) and r.url == pages[r.page_id].url


def test_rows(spark):
    df = spark.createDataFrame([(1, "u", None, "t"), (1, "u", None, "t"), (None, None, PAGE, None)], "page_id long, url string, html string, text string")
    assert sorted((r.page_id or 0, r.n_chars > 0) for r in maintext.extract(df).collect()) == [(0, True), (1, False), (1, False)]
    assert maintext.extract(df.limit(0)).count() == 0
