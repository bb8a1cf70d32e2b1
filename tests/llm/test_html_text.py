import time

import numpy as np
import pytest
from strandloom.llm import block_labeller as L
from strandloom.llm import html_text as H

WORDS = "river stone light falls under trees wind slow grass cloud".split()


def text(rng, n):
    return " ".join(rng.choice(WORDS, n)).capitalize() + "."


def page(i):
    rng = np.random.default_rng(i)
    body = "".join(f"<p>{text(rng, int(rng.integers(4, 30)))}</p>" for _ in range(int(rng.integers(2, 7))))
    menu = "".join(f'<li><a href="/{k}">{rng.choice(WORDS)}</a></li>' for k in range(4))
    return f'<!DOCTYPE html><html><head><title>x</title><script>var a="<p>no</p>";</script></head><body><nav><ul>{menu}</ul></nav><div class="ad">{text(rng, 5)}</div><article><h1>{text(rng, 3)}</h1>{body}</article><footer>&copy; {text(rng, 4)}</footer></body></html>'


def test_blocks():
    got = [b.text for b in H.blocks('<p>a &lt;b&gt; <b>bold</b>\n\t x&nbsp;y<p title="1>0">two<br>lines<!-- no <p> --> on</p>1 < 2<script>if (a<b) "</p>"</script><ul><li>i<li>j</ul>tail<!-- open <p>gone')]
    assert got == ["a <b> bold x y", "two lines on", "1 < 2", "i", "j", "tail"]
    assert H.blocks(None) == H.blocks("") == H.blocks("<div>  </div>") == []
    assert H.blocks('<div class="Side bar"><a href=x>link</a> on')[0] == L.Block(("div", "c:side", "c:bar"), "link on", 4)
    assert len(H.blocks("<div>x" * 40)[-1].path) == 40 and len(H.blocks("<div>x" * 3000)[-1].path) == 2 * H.DEPTH


def test_gradients():
    rng = np.random.default_rng(1)
    pages = [H.blocks(page(i)) for i in range(3)]
    own, y = [L.Page(p) for p in pages], [H.roles(p) for p in pages]
    w = {k: v.astype(float) for k, v in L.fresh_weights().items()}
    _, g = L.gradients(own, y, w)
    for k in w:
        i = np.unravel_index(np.argmax(np.abs(g[k])), g[k].shape)
        loss = []
        for step in (1e-3, -1e-3):
            w[k][i] += step
            loss.append(L.gradients(own, y, w)[0])
            w[k][i] -= step
        assert g[k][i] == pytest.approx((loss[0] - loss[1]) / 2e-3, rel=2e-2, abs=1e-5)
    assert rng is not None


def test_scores_do_not_depend_on_the_batch():
    w = L.fresh_weights()
    own = [L.Page(H.blocks(page(i))) for i in range(6)] + [L.Page([])]
    together, alone = L.scores(own, w), [L.scores([p], w)[0] for p in own]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, alone))


@pytest.mark.parametrize("piece", ["<a ", '<p title="x ', "<div>x", "<p><div><foo>x</p>", "</section>", "<a '> ", "<script>", "<!-- x ", "<table><tr><td>x", "&amp;<", '<div class="a b c d e f g h i j k l m n o p q r s">x', '<p ">" ', "<p x='\">' "])
def test_long_malformed_pages_take_linear_time(piece):
    for tail in ("", ">", "'", '"> "'):
        page = piece * (1_000_000 // len(piece)) + tail
        began = time.process_time()
        H.blocks(page)
        assert time.process_time() - began < 10


def test_tags_end_where_quotes_say():
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts('<p title="a > b">x</p>') == ["x"]
    assert texts("<p title='a > b\" >x</p><p>y</p>") == ["b\" >x", "y"]
    assert texts("<div>x <b y") == ["x <b y"] and texts("a < b > c") == ["a < b > c"]
    assert texts("<p>one<script>two</p>") == ["one"] and texts("<p>one<SCRIPT>two</script  ><p>three") == ["one", "three"]


SCHEMA = "page_id long, url string, html string, main_text int"
#: Layouts written by hand: H and B stand for the headline and the paragraphs, the rest is furniture.
LAYOUTS = [
    '<html><body><div id="header"><a href="/">{f}</a></div><div id="content"><h1>{h}</h1>{b}</div><div id="footer">{f}</div></body></html>',
    '<body><header><h2>{f}</h2></header><div class="wrapper"><div class="sidebar"><ul><li><a href=x>{f}</a><li><a href=y>{f}</a></ul></div><div class="post"><h2>{h}</h2>{b}</div></div></body>',
    "<body><table><tr><td class=menu><a href=a>{f}</a></td><td><h3>{h}</h3>{b}</td></tr></table><p class=copyright>{f}</p></body>",
    '<main><section><h1>{h}</h1>{b}</section><form><label>{f}</label><input></form></main><aside>{f}</aside>',
    '<div class="cookie notice">{f}</div><section class="story"><h1>{h}</h1><div class="ad">{f}</div>{b}<ul class="comments"><li>{f}<li>{f}</ul></section>',
    '<nav><a href=1>{f}</a></nav><div><div><div class="entry"><h1>{h}</h1>{b}</div></div></div><div class="related"><a href=2>{f}</a></div>',
]


def layout(k, i):
    """(page, its main text as it was written)."""
    rng = np.random.default_rng(1000 * k + i)
    head, paragraphs = text(rng, 4), [text(rng, int(rng.integers(12, 40))) for _ in range(int(rng.integers(3, 8)))]
    page, body = LAYOUTS[k], "".join(f"<p>{x}</p>" for x in paragraphs)
    while "{f}" in page:
        page = page.replace("{f}", text(rng, int(rng.integers(2, 7))), 1)
    return page.replace("{h}", head).replace("{b}", body), "\n".join([head, *paragraphs])


@pytest.mark.parametrize("kinds", [[0], [0, 1, 2, 3, 4, 5]])
def test_written_layouts_give_what_was_written(spark, kinds):
    """The truth is what the pages were written from, not what the labels of training say."""
    shown = [(i, "u", layout(kinds[i % len(kinds)], i)[0], 0) for i in range(120)]
    weights = H.model(spark.createDataFrame(shown, SCHEMA))
    unseen = {i: layout(kinds[i % len(kinds)], i) for i in range(500, 560)}
    out = H.extracted(spark.createDataFrame([(i, "u", page, 0) for i, (page, _) in unseen.items()], SCHEMA), ["page_id"], weights).collect()
    assert sum(r.main_text == unseen[r.page_id][1] for r in out) >= 54


def test_main_text(spark):
    df = spark.createDataFrame([(i, "u", page(i), 1) for i in range(60)] + [(100, None, None, None), (101, "u", "", None), (5, "u", page(5), 1)], SCHEMA)
    weights = H.model(df)
    fresh = [(200 + i, "u", page(500 + i).replace("<article>", '<div id="content">').replace("</article>", '</div><div class="comments"><p>What a fine page.</p></div>'), 1) for i in range(20)]
    out = {r.page_id: r for r in H.extracted(df.union(spark.createDataFrame(fresh, SCHEMA)), ["page_id", "url"], weights).collect()}
    main = lambda i: "\n".join(b.text for b in H.blocks(page(i)) if "article" in b.path)
    assert sum(out[i].main_text == main(i) for i in range(60)) >= 58
    assert all(out[i].n_chars == len(out[i].main_text) for i in range(60))
    assert sum(out[200 + i].main_text == main(500 + i) for i in range(20)) >= 16
    assert out[100].main_text == out[101].main_text == ""
    assert H.extracted(df.limit(0), ["page_id"], H.model(df.limit(0))).collect() == []
