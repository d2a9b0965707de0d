import html as entities
import re

import numpy as np
import pyarrow.parquet as pq

from veilframe.llm import html, queries


def by_hand(page):
    """The article of the test pages, cut by their known template."""
    found = re.search(r"<article>(.*?)</article>", page, re.S)
    parts = re.split(r"</?(?:p|h1)>", found[1].replace("<br>", " ")) if found else []
    texts = [" ".join(entities.unescape(re.sub(r"<[^>]+>", "", p)).split()) for p in parts]
    return "\n".join(filter(None, texts))


def test_query_equals_template(spark, sf_dir):
    pages = {r["page_id"]: r for r in pq.read_table(f"{sf_dir}/pages.parquet").to_pylist()}
    got = queries.queries()["op9_main_text"](spark, sf_dir).collect()
    assert len(got) == len(pages)
    for r in got:
        assert r.text == by_hand(pages[r.page_id]["html"]) and r.n_chars == len(r.text) and r.url == pages[r.page_id]["url"]


def test_held_out_accuracy():
    model, right, n = html.trained(), 0, 0
    for seed in range(150):
        page, labels = html.labelled_page(77_000_000 + seed)
        if page:
            right, n = right + int((model.label([page])[0] == (labels > 0)).sum()), n + len(page)
    assert right / n > 0.97


def test_gradients_are_numeric_gradients():
    model, rng = html.Labeller.fresh(3), np.random.default_rng(0)
    model = html.Labeller([w.astype(np.float64) for w in model.weights])
    x, lengths, y = rng.normal(size=(2, 3, html.DIMS)), np.array([3, 2]), np.array([[1, 0, 1], [0, 1, 0]], float)
    _, grads = model.gradients(x, lengths, y)
    for w, g in zip(model.weights, grads, strict=True):
        at = np.unravel_index(np.argmax(np.abs(g)), g.shape)
        keep, losses = w[at], []
        for d in (1e-3, -1e-3):
            w[at] = keep + d
            losses.append(model.gradients(x, lengths, y)[0])
        w[at] = keep
        assert np.isclose((losses[0] - losses[1]) / 2e-3, g[at], rtol=0.05, atol=1e-4)


def test_edges(spark):
    whole = "<article><h1>T</h1><p>A &amp; b&#8217;s\n text.<p>Second one here, it is.</article>"
    pages = [None, "", "<", "<p", "<!-- x", "<script>a</p>", whole, whole, "<article>" + "<p>Some words of prose, here.</p>" * 20_000 + "</article>"]
    rows = [(i, f"u{i}", p, "x") for i, p in enumerate(pages)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = {r.page_id: r.text for r in html.main_text(df).collect()}
    assert [got[i] for i in range(6)] == [""] * 6 and got[6] == got[7]
    assert got[6].split("\n") == ["T", "A & b’s text.", "Second one here, it is."]
    assert got[8].count("\n") == 19_999
    assert html.main_text(df.limit(0)).count() == 0


def test_blocks():
    found = html.blocks("<div class='a b'>x <b>y</b>z<br>q<ul><li>one<li><a href=#>two</a></ul>tail<script>if(a<b){}</script></div>")
    assert [b.text for b in found] == ["x yz q", "one", "two", "tail"]
    assert found[1].path == ("div", "=a", "=b", "ul", "li") and found[2].linked == 3


def test_silent_and_embedded_elements():
    said = lambda page: [b.text for b in html.blocks(page)]
    assert said("<p>one <svg class='i'/> two <math><mi>x</mi><mo>=</mo><mn>1</mn></math></p><p>three</p>") == ["one two x=1", "three"]
    assert said("<p>a<svg><title>t</title><text>no</text><svg>x</svg></svg> b <object data='x'>shown</object></p>") == ["a b shown"]
    assert said("<article><p>first <video src='v'> gone</p><p>second</p><select><option>no<p>no</article><p>third") == ["first", "second", "third"]
    assert said("<p>one<script>if (a < b) '</p>'</script></p><title>no</title>two<style>x") == ["one", "two"]
    assert said("<svg><p>no</p>") == [] and said("</svg>yes</select>") == ["yes"]


def test_deep_pages_are_linear():
    import time
    import tracemalloc

    assert [b.path for b in html.blocks("<div class=a>x<p>y</div>z<ul><li>q")] == [("div", "=a"), ("div", "=a", "p"), (), ("ul", "li")]
    model, took = html.trained(), []
    for n in (4_000, 16_000):
        page = "<div>abc def " * n + "</b></section>" * n
        tracemalloc.start()
        began = time.process_time()
        found = html.blocks(page)
        labels = model.label([found])[0]
        took.append((time.process_time() - began, tracemalloc.get_traced_memory()[1]))
        tracemalloc.stop()
        assert len(found) == len(labels) == n
    assert took[1][0] < 10 * took[0][0] and took[1][1] < 6 * took[0][1]


def test_slices_of_a_long_page(monkeypatch):
    model = html.trained()
    page = html.blocks("".join(f"<nav>{i} x</nav><article><h1>T</h1><p>Some words of prose, here.</article>" for i in range(150)))
    whole = model.label([page])[0]
    monkeypatch.setattr(html, "SLICE", 64)
    assert (model.label([page])[0] == whole).all() and 0 < whole.sum() < len(page)
