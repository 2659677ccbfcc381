import html
import re

import numpy as np
import pytest

from loomgraph.llm import htmltext, layouts
from loomgraph.llm.lstm import BiLstm, padded

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def model():
    return htmltext.learn_labeller()


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_blocks():
    page = (
        "<!doctype html><html><head><title>T</title><style>p{}</style></head><body><!-- a <p>no</p> -->"
        "<p>One <b>t</b>wo &amp;amp; &lt;x&gt;\n\t three<br>four<p>five<ul><li>a<li>b</ul>"
        "<script>var s = '</p><p>no';</script><div title='a > b'>six<span>7</span></div><select><option>no</select>eight"
    )
    assert texts(page) == ["One two &amp; <x> three", "four", "five", "a", "b", "six7", "eight"]
    path = [e[0] for e in htmltext.blocks(page)[3].path]
    assert path == ["html", "body", "ul", "li"]


def test_broken_markup():
    assert texts("") == [] and texts("plain & text") == ["plain & text"]
    assert texts("a </b></div> c <p>d</i>e") == ["a", "c", "de"]
    assert texts("<p>x <a href='open>y</p> z") != []
    assert texts("<p>x</p><script>var a = 1;") == ["x"]
    assert texts("<p>x</p><!-- open") == ["x"]
    assert texts("1 < 2 and 3 > 2") == ["1 < 2 and 3 > 2"]
    for page in ("<div>" * 20_000 + "x", "<a <b " * 20_000, "<p title=\"" * 20_000, "<" * 50_000, "<p>a" * 20_000):
        htmltext.blocks(page)


def test_unseen_layouts(model):
    right = total = 0
    pages = layouts.draw_pages(150, seed=99)
    found = [htmltext.blocks(p) for p in pages]
    truth = [[layouts.MARK in b.text for b in page] for page in found]
    for page in found:
        for b in page:
            b.text = b.text.replace(layouts.MARK, "") or "."
    for want, got in zip(truth, htmltext.label(model, found), strict=True):
        right, total = right + int((np.array(want, bool) == got).sum()), total + len(want)
    assert right / total > 0.97


def article(page):
    """The article of the sample pages, cut out by hand: they are all of one kind."""
    inner = re.search(r"<article>(.*?)(?:</article>|$)", page, re.S)[1]
    parts = re.split(r"</?(?:p|h1|br)>", inner)
    parts = [" ".join(html.unescape(re.sub(r"</?b>", "", x)).split()) for x in parts]
    return " ".join(x for x in parts if x)


def test_sample_pages(spark):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    want = {r.page_id: article(r.html) for r in pages.collect()}
    rows = htmltext.extract_pages(pages).collect()
    assert {r.page_id: r.text for r in rows} == want
    assert all(r.n_chars == len(r.text) for r in rows)


def test_odd_rows(spark):
    rows = spark.createDataFrame(
        [(1, None, None, "a"), (2, "u", "", "b"), (None, "v", "<article><p>Some words, here.</p></article>", "c")],
        "page_id long, url string, html string, text string",
    )
    got = {r.page_id: (r.url, r.text, r.n_chars) for r in htmltext.extract_pages(rows).collect()}
    assert got[1] == (None, "", 0) and got[2] == ("u", "", 0) and got[None][0] == "v"
    assert htmltext.extract_pages(rows.limit(0)).count() == 0


def test_gradients():
    rng = np.random.default_rng(1)
    model = BiLstm.new(3, 4, 2)
    rows = [rng.normal(size=(n, 3)) for n in (2, 5)]
    x, mask = padded(rows)
    for p in model.parameters:
        p.resize(p.shape)
    model.ahead = [p.astype(np.float64) for p in model.ahead]
    model.back = [p.astype(np.float64) for p in model.back]
    model.out, model.bias = model.out.astype(np.float64), model.bias.astype(np.float64)
    x, target = x.astype(np.float64), (rng.random(mask.shape) < 0.5).astype(np.float64)

    def loss():
        p = model.predict(x, mask)
        return float(-((target * np.log(p) + (1 - target) * np.log(1 - p)) * mask).sum() / mask.sum())

    for p, g in zip(model.parameters, model.gradients(x, mask, target), strict=True):
        at = tuple(rng.integers(0, n) for n in p.shape)
        p[at] += 1e-3
        more = loss()
        p[at] -= 2e-3
        less = loss()
        p[at] += 1e-3
        assert abs((more - less) / 2e-3 - g[at]) < 2e-4
