import random
import time

import numpy as np
import pytest

from personagraph.llm import html_blocks as H

from . import fixtures


def page(rng, k):
    main = [fixtures.prose(rng, rng.randint(5, 60)).replace("\n", " ") for _ in range(rng.randint(1, 8))]
    around = lambda n: " ".join(fixtures.prose(rng, n).split())
    body = f"<h1>{around(5)}</h1>" + "".join(f"<p>{x}</p>" for x in main)
    html = (
        f"<!DOCTYPE html><html><head><title>{around(4)}</title><script>var a='<p>no</p>';</script></head><body><nav><ul>"
        + "".join(f"<li><a href='/'>{around(1)}</a></li>" for _ in range(rng.randint(2, 6)))
        + f"</ul></nav><!-- {k} --><div class=\"ad\">{around(rng.randint(3, 25))}</div><article>{body}</article>"
        + f"<footer>&copy; {around(6)}</footer></body></html>"
    )
    return html


@pytest.fixture(scope="module")
def model():
    rng = random.Random(1)
    return H.fit_texts([page(rng, k) for k in range(80)])


def test_blocks():
    found = H.blocks(
        "lead<p>a  b<b>c</b>\n d<p>e &amp; f&nbsp;g<br>h<script>x<p>y</script><!-- <p>z --><ul><li>i<li>j</ul><a href='>'>k</a><p"
    )
    assert [b.text for b in found] == ["lead", "a bc d", "e & f g", "h", "i", "j", "k"]
    assert found[4].path == ("ul", "li") and found[6].link_share == 1.0
    assert H.blocks("") == [] and H.blocks("<p></p>") == []


def test_blocks_behind_drawings_and_custom_elements():
    texts = lambda page: [b.text for b in H.blocks(page)]
    for ahead in (
        "<svg-icon name=x></svg-icon>", "<math-renderer>", "<template-card></template-card>", "<svg class=i/>", "<svg class='i' />", "<math/>",
        "<svg><path d='M0'/>", "<svg><title>t</title><svg><text>x</text></svg>y</svg>", "<style-guide/>",
    ):
        assert texts(f"{ahead}<article><p>body</p></article>") == ["body"], ahead
    assert texts("<p>a <svg viewBox='0'><title>t</title><style>p{}</style><text>x</text></svg>b</p><p>c") == ["a b", "c"]
    assert texts("<p>let <math><semantics><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></semantics></math> hold</p>") == ["let x=1 hold"]
    assert texts("<svg><foreignObject><p>seen</p></foreignObject><text>x</text></svg><p>d<template><p>x</template><p>e") == ["seen", "d", "e"]


def test_held_out_pages(model):
    rng = random.Random(2)
    found = [H.blocks(page(rng, k)) for k in range(150)]
    exact = sum(kept == [b for b, y in zip(f, H.own_labels(f)) if y] for f, kept in zip(found, H.main_blocks(model, found)))
    assert exact >= 145
    others = [b for f in found for b in f]
    shown = [H.rewritten(f, H.own_labels(f), others, rng) for f in found]
    kept = H.main_blocks(model, [f for f, _ in shown])
    right = total = 0
    for (f, labels), k in zip(shown, kept):
        ids = set(map(id, k))
        right += sum((id(b) in ids) == bool(y) for b, y in zip(f, labels))
        total += len(f)
    assert right / total > 0.97


def test_gradients():
    rng = np.random.default_rng(0)
    model = H.Labeller(3, hidden=3)
    model.w = {k: v.astype(np.float64) for k, v in model.w.items()}
    x = rng.normal(size=(4, 2, H.DIMS))
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], float)
    y = rng.integers(0, 2, (4, 2)).astype(float)

    def loss():
        z = model.logits(x, mask)
        return ((np.logaddexp(0, z) - y * z) * mask).sum() / mask.sum()

    grads = model.gradients(x, mask, y)
    for name in ("fx", "fh", "bb", "bh", "o", "ob"):
        at = tuple(rng.integers(0, n) for n in model.w[name].shape)
        model.w[name][at] += 1e-3
        up = loss()
        model.w[name][at] -= 2e-3
        down = loss()
        model.w[name][at] += 1e-3
        assert abs((up - down) / 2e-3 - grads[name][at]) < 1e-3


def test_extract(spark, model):
    rng = random.Random(3)
    rows = [(k, f"http://{k}/", page(rng, k)) for k in range(20)]
    long = "<article>" + "".join(f"<p>{fixtures.prose(rng, 12)}</p>" for _ in range(3000)) + "</article>"
    rows += [(20, None, None), (21, "u", ""), (None, "u", rows[0][2]), (0, "http://0/", rows[0][2]), (22, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS text", "1 AS n_chars")
    got = H.extract(df, model).collect()
    want = [(r[0], r[1], " ".join(b.text for b in H.main_blocks(model, [H.blocks(r[2] or "")])[0])) for r in rows]
    assert sorted(str(tuple(r)[:3]) for r in got) == sorted(map(str, want))
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    assert H.extract(df.limit(0)).collect() == []


def test_comments_and_quotes_end_as_in_browsers():
    texts = lambda page: [b.text for b in H.blocks(page)]
    assert texts("<!--><article>body</article>") == ["body"]
    assert texts("<!---><p>body</p>") == ["body"]
    assert texts("<!-- a > b --><p>body</p><!-- x --!><p>more</p><!-- open <p>none") == ["body", "more"]
    assert texts('<p>a</p><a title="5" tall">text A</a><p>mid</p><a title="6" tall">text B</a>') == ["a", "text A", "mid", "text B"]
    assert texts("<p title=don't>hello</p><p title=can't>world</p>") == ["hello", "world"]
    assert texts("<p title = 'a > b' x=\"c > d\">in</p><p data-x=>out</p><p a='never closed>lost") == ["in", "out", "lost"]


@pytest.mark.parametrize(
    "piece", ["<div>x", "<b>x</i>", "<p><b>", "<i><div><b></i>", "<hr><b>x", '<a title="', "<svg><div>x", "<li><b>x", "<!--", "<p a=\"'"]
)
def test_deep_and_open_pages_cost_their_length(piece):
    def seconds(n):
        started = time.process_time()
        H.vectors(H.blocks(piece * n))
        return time.process_time() - started

    seconds(2000)
    few, many = (min(seconds(n) for _ in range(3)) for n in (4000, 32000))
    assert many < 40 * few + 0.2


def test_paths_of_deep_levels():
    found = H.blocks("<main class='story x1'><b><div id=a><a href=z><p>one</p></a></div><p>two")
    assert [b.path for b in found] == [("main", "story", "x", "b", "div", "a", "p"), ("main", "story", "x", "b", "p")]
    assert [b.link_share for b in found] == [1.0, 0.0]
    again = [H.Block(H.level_of(b.path), b.text, b.link_share) for b in found]
    assert (H.vectors(found) == H.vectors(again)).all()
