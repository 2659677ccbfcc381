import numpy as np

from loomgraph.llm import htmltext


def texts(page):
    return [b.text for b in htmltext.blocks(page)]


def test_unclosed_controls_hide_no_article():
    assert texts("<div><svg class=x/>a<p>b</p></div>c") == ["a", "b", "c"]
    assert texts("<div><svg class=x><path d='m'><p>a <b>b</b></p>c</div>") == ["a b", "c"]
    assert texts("<p>a<svg><text>no</text> <b>b</b></p>") == ["a", "b"]
    for control in ("button", "canvas", "object", "select", "video"):
        page = f"<div>a<{control}>no<p>b</p><p>c <i>d</i></p></div><p>e</p>"
        assert texts(page) == ["a", "b", "c d", "e"]
        assert texts(page.removesuffix("</div><p>e</p>")) == ["a", "b", "c d"]
        assert texts(f"<div>a<{control}>no<p>no</p><svg><p>no</p></{control}>b<p>c</p></div>") == ["a", "b", "c"]
    assert texts("<p>a <canvas/> b</p>") == ["a", "b"]
    assert texts("<p>a</p><button>no<p>b</p><button>no</button>c") == ["a", "b", "c"]
    assert texts("<svg><foreignObject><p>no</p></foreignObject></svg><template><p>no</p></template><p>a") == ["a"]


def test_tail_with_a_less_than():
    assert texts("<p>x</p> <3 and a long tail") == ["x", "<3 and a long tail"]
    assert texts("<p>x</p> < 3") == ["x", "< 3"]
    assert texts("<p>x</p> <a href") == texts("<p>x</p></a") == texts("<p>x</p><!-- a") == ["x"]


def test_ancestors_at_any_depth_count():
    def features(name, deep):
        page = f"<p>z</p><section class={name}>" + "<div>" * deep + "<p>a</p><i>b</i>" + "</div>" * deep + "</section><p>c"
        return htmltext.block_features(htmltext.blocks(page))

    for deep in (1, 30, 3000):
        one, other = features("comments", deep), features("article", deep)
        assert (one[1] != other[1]).any() and (one[2] != other[2]).any()
        assert np.array_equal(one[0], other[0]) and np.array_equal(one[3], other[3])


def plainly(block):
    row = np.zeros(htmltext.PATH_BITS)
    for depth, (_, names, _, _) in enumerate(reversed(block.path)):
        row[list(names)] += 1.0 if depth < 3 else 0.5
    if block.path:
        row[block.path[-1][2]] += 1
    return np.minimum(row, 2)


def test_path_features():
    for page in htmltext.draw_pages(20, seed=5):
        found = htmltext.blocks(page)
        rows = htmltext.block_features(found)[:, : htmltext.PATH_BITS]
        assert all(np.array_equal(row, plainly(b)) for row, b in zip(rows, found, strict=True))
