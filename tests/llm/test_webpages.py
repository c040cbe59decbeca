"""The labeller against the containers' meaning, and parsing of odd pages."""

import html
import re
import time

import numpy as np
import pyarrow.parquet as pq
import pytest
from compare import DATA

from episode_mart.llm import webpages
from episode_mart.llm.queries import QUERIES


def plain(page):
    """The article by its tags, which the test tables all have."""
    inside = re.search(r"<article>(.*?)</article>", page, re.DOTALL)[1]
    blocks = re.split(r"</?(?:p|h1|h2|ul|li|div|blockquote)\b[^>]*>", inside)
    texts = (" ".join(html.unescape(re.sub(r"<br>", " ", re.sub(r"</?(?:b|a|i|em)\b[^>]*>", "", b))).split()) for b in blocks)
    return "\n".join(t for t in texts if t)


def test_articles_are_extracted_whole(spark):
    pages = pq.read_table(f"{DATA}/sf0.01/pages.parquet").to_pylist()
    got = {r["page_id"]: r for r in QUERIES["op3_page_text"](spark, f"{DATA}/sf0.01").collect()}
    assert len(got) == len(pages)
    right = sum(got[p["page_id"]]["text"] == plain(p["html"]) for p in pages)
    assert right >= 0.995 * len(pages)
    assert all(r["n_chars"] == len(r["text"]) for r in got.values())


@pytest.fixture(scope="module")
def labeller():
    pages = pq.read_table(f"{DATA}/sf0.01/pages.parquet").to_pylist()
    return webpages.train([p["html"] for p in pages[:150]])


LONG = "Anha the of are haedre anti the theaatnd or it ing thshst the thsh, the erntea erthat edti theaeres thhe inonha. "
PAGE = f"""<html><head><title>No</title><style>p {{}}</style></head><body><header><a href=/>Home</a> Site</header>
<nav><ul><li><a>One</a><li><a>Two</a></ul></nav><div class="cookie-notice">We use cookies. <button>OK</button></div>
<main><h1>Title &amp;
 more</h1><p>{LONG}<p>{LONG} a &lt; b<br>c<script>var x = "<p>no</p>";</script><!-- no --></main>
<aside class=sidebar><p>{LONG}</aside><section id="comments"><p>{LONG}</p></section>
<form><label>Name</label><input></form><div class="ad">{LONG}</div><footer>&copy; Site</footer>"""


def test_unseen_containers(labeller):
    text, blocks, kept = webpages._extracted(labeller, [PAGE])[0]
    assert text == f"Title & more\n{LONG.strip()}\n{LONG.strip()} a < b c"
    assert (blocks, kept) == (13, 3)


@pytest.mark.parametrize("page", ["", "<", "<p", "<!-- open", "<script>x", "</p></div>", "<p>&nbsp;</p>", "<div " * 2000,
                                  "<p a='\">x", "<p>" * 3000, "<![CDATA[x]]>"])
def test_odd_pages(labeller, page):
    text, blocks, kept = webpages._extracted(labeller, [page])[0]
    assert kept <= blocks and isinstance(text, str)


@pytest.mark.parametrize("piece", ["<script ", "<a ", "</b></i></p>", "<a<", "<div>x", '<a ">"', "<a '\"", "<!-- ", "<p><b>x</div>",
                                   "<a b='", "</section", "<li class=a>", "</script "])
def test_long_broken_pages(piece):
    """Time in proportion to the page: a mebibyte of any piece is parsed within seconds."""
    began = time.process_time()
    webpages.blocks_of("<p>" + piece * (2**20 // len(piece)) + ">")
    webpages.blocks_of("<p>" + piece * (2**20 // len(piece)))
    assert time.process_time() - began < 20


def test_carried_states_equal_one_run(labeller):
    blocks = webpages.blocks_of(PAGE * 7)
    at_once = labeller.probabilities(*webpages.padded([[webpages.vector(b) for b in blocks]]))[0]
    for chunk in (1, 5, len(blocks), 1000):
        assert np.allclose(labeller.long(blocks, chunk), at_once, atol=1e-5)


def test_quotes_and_names():
    def texts(page):
        return [b.text for b in webpages.blocks_of(page)]
    assert texts('<p title="a>b">c</p>d') == ["c", "d"]
    assert texts("<p title='a\">b'>c") == ["c"]
    assert texts('<p title="a>b') == ["b"]  # the quote never closes: the tag ends at the first >
    assert texts("a < b and c > d") == ["a < b and c > d"]
    assert texts("a<b and <") == ["a<b and <"]
    assert texts("<title-bar>a</title-bar>b<title>c</title>d") == ["a", "bd"]
    assert texts("a<!-- > -->b<!-- c") == ["ab"]


def test_gradients():
    rng = np.random.default_rng(3)
    net = webpages.Labeller()
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, mask = rng.normal(size=(2, 4, webpages.WIDTH)), np.array([[1, 1, 1, 1], [1, 1, 0, 0.0]])
    y = rng.integers(0, 2, (2, 4)).astype(float)

    def loss():
        p = net.probabilities(x, mask)
        return -(mask * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / mask.sum()

    grads = net.gradients(x, mask, y)
    for name, at in (("xf", (5, 7)), ("hb", (2, 20)), ("bf", (3,)), ("out", (9, 0)), ("xb", (130, 50)), ("hf", (1, 40))):
        was = net.p[name][at]
        net.p[name][at] = was + 1e-3
        up = loss()
        net.p[name][at] = was - 1e-3
        down = loss()
        net.p[name][at] = was
        assert abs((up - down) / 2e-3 - grads[name][at]) < 2e-3 * max(1, abs(grads[name][at]))


def test_rows_without_pages(spark, labeller):
    rows = [(1, None, "x"), (2, "", None), (2, "", None), (3, "<article><p>A b.", "y")]
    df = spark.createDataFrame(rows, "page_id long, html string, text string")
    got = webpages.extract(df, labeller).orderBy("page_id").collect()
    assert [(r["page_id"], r["n_chars"]) for r in got[:3]] == [(1, 0), (2, 0), (2, 0)] and len(got) == 4
    assert webpages.extract(df.limit(0), labeller).count() == 0
    webpages.learn(df.limit(0))
