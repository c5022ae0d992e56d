import html
import itertools
import math
import random
import re
import time

import numpy as np
import pytest
from karstline.llm import htmlcrf as h


@pytest.fixture(scope="module")
def field():
    return h.fit()


def test_blocks_follow_markup():
    page = """<p>a <b>b</b>&amp;&nbsp;c<br>d<p>e<ul><li>f<li>g</ul><script>var t="</p>x";</script><!-- <p>no</p> --><div title="a>b">h<span> i</span></div>
    <style>p{}</style>1 < 2 &lt;b&gt; <td>k<td>l</table><textarea>no</textarea>m<p"""
    assert [b.text for b in h.blocks_of(page)] == ["a b& c d", "e", "f", "g", "h i", "1 < 2 <b>", "k", "l", "m"]
    assert [b.text for b in h.blocks_of("<a href='x'>y</a> plain <script>never closed")] == ["y plain"]
    assert [b.text for b in h.blocks_of("<p>a <math><mi>x</mi><mo>=</mo><mn>1</mn></math> b <object>c</object><noscript>d</noscript><button>e</button><select><option>f<option>g</select>")] == ["a x=1 b c", "d", "e", "f", "g"]
    assert [b.text for b in h.blocks_of("<iframe>no</iframe>a<iframe>b<p>c<noframes>d")] == ["a b".replace(" ", ""), "cd"]
    assert h.blocks_of("") == [] and h.blocks_of("<><<") [0].text == "<><<"


def test_viterbi_finds_the_best_chain():
    rng = random.Random(0)
    for _ in range(40):
        w = np.array([[rng.gauss(0, 1), rng.gauss(0, 1)] for _ in range(4)])
        field = h.Field({str(i): i for i in range(4)}, w, np.array([[rng.gauss(0, 1) for _ in "ab"] for _ in "ab"]), np.array([0.3, -0.2]))
        chain = [[str(i) for i in range(4) if rng.random() < 0.6] for _ in range(6)]

        def total(labels, field=field, chain=chain):
            s = field.first[labels[0]] + sum(field.weights[int(f), y] for x, y in zip(chain, labels, strict=True) for f in x)
            return s + sum(field.moves[a, b] for a, b in itertools.pairwise(labels))

        best = max(itertools.product((0, 1), repeat=6), key=total)
        assert math.isclose(total(field.decode(chain)), total(best))
    assert field.decode([]) == []


def test_training_raises_the_likelihood_of_gold_chains():
    pages = [([["x"], ["y"], ["y"]], [0, 1, 1]), ([["x"], ["x"], ["y"]], [0, 0, 1]), ([["y"]], [1])]
    field = h.train(pages, passes=60)
    assert [field.decode(c) for c, _ in pages] == [y for _, y in pages]


def test_held_out_accuracy(field):
    wrong = total = 0
    for page, labels in h.labelled_pages(200, seed=77):
        got = field.decode([h.features(b, b.text) for b in h.blocks_of(page)])
        wrong += sum(a != b for a, b in zip(got, labels, strict=True))
        total += len(labels)
    assert wrong < 0.015 * total


def test_layouts_of_other_makes(field):
    page = """<!DOCTYPE html><html><head><title>T</title></head><body><header><nav><a href=/>Home</a></nav></header>
    <div class="cookie-notice">We use cookies.</div><main><article><h1>The  title</h1><p>First &amp; last paragraph of it.</p>
    <p>Second one, with <a href=x>a link</a> in it.</p><aside class="related"><p>Read this too</p></aside></article></main>
    <section id="comments"><p>Great text, thanks!</p></section><form><p>Sign up here</p><input></form><footer><p>&copy; 2020 Me</p></footer></body></html>"""
    assert h.main_text(field, page) == "The title\nFirst & last paragraph of it.\nSecond one, with a link in it."


def test_extract_odd_rows(spark, field):
    long = "<article>" + "<p>One sentence stands here.</p>" * 3000 + "</article>"
    rows = [(1, "u", None, 1), (1, "u", None, 1), (None, None, "", 2), (3, "v", long, 3), (4, "w", "<nav><a>x</a></nav>", 4)]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, text int").selectExpr("*", "1 AS n_chars", "2 AS `a.b`")
    got = h.extract(frame, field).collect()
    assert got[0].asDict().keys() == {"page_id", "url", "text", "n_chars"} and len(got) == 5
    assert sorted(r.n_chars for r in got)[:4] == [0, 0, 0, 0] and max(got, key=lambda r: r.n_chars).text.count("\n") == 2999
    assert h.extract(frame.limit(0), field).collect() == []


def test_digits_are_counted_over_the_whole_block():
    late = "word " * 100 + "1234567890 " * 100 + "end"
    (block,) = h.blocks_of(f"<p>{late}</p>")
    assert "digits:3" in h.features(block, block.text)


def test_features_by_name_and_by_weight_agree(field):
    for page, _ in h.labelled_pages(40, seed=5):
        blocks = h.blocks_of(page)
        assert field.label(blocks, [b.text for b in blocks]) == field.decode([h.features(b, b.text) for b in blocks])


def test_broken_and_deep_pages_cost_by_their_length(field):
    for deep in ("<div>", "<p><div class=a{}>", "<ul><li>", "<p><table><tr><td>", "</b><i>", "<math>"):
        seconds = []
        for n in (2000, 16000):
            page = "<article><p>One sentence stands here.</p>" + "".join(deep.format(i) + "x. " for i in range(n))
            start = time.process_time()
            assert len(h.main_text(field, page)) >= len("One sentence stands here.")
            seconds.append(time.process_time() - start)
        assert seconds[1] < 30 * seconds[0] + 0.5


def test_article_text_in_odd_elements_stays(field):
    page = "<nav><a href=/>Home</a></nav><article><h1>Title of it</h1><p>Let <math><mi>x</mi><mo>&lt;</mo><mn>2</mn></math> hold, as shown.</p><p>See <object>the drawing here</object> for more.</p><button>Subscribe</button></article>"
    assert h.main_text(field, page) == "Title of it\nLet x<2 hold, as shown.\nSee the drawing here for more."


def test_pages_table(spark, field):
    """The table's articles stand in <article>; what is in it, block by block, is the whole result."""
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r.text for r in h.extract(pages, field).collect()}
    for r in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = [html.unescape(re.sub(r"<br>", " ", re.sub(r"</?b>", "", x))) for x in re.split(r"</?(?:p|h\d|div|ul|li)>", inner)]
        assert got[r.page_id] == "\n".join(y for x in blocks if (y := " ".join(x.split())))
