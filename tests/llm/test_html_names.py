"""Names of elements against structure: articles aren't lost by a name, parts without a known name aren't kept for it; and the
field's training against sums over all labellings."""

import itertools
import math

import numpy as np
import pytest

from tracegraph.llm import html_text as h

SIDE = "outbrain talkback userposts livefyre author-card donate taboola readers-say shoutbox mailing paidpost zergnet contributors upnext tipjar membership sitemap".split()
PROSE = f"<h1>A title</h1><p>{h._P}</p><p>{h._P}</p>"


@pytest.fixture(scope="module")
def model():
    made = [(b, [x.label or 0 for x in b]) for b in map(h.blocks_of, h.layouts())]
    return h.fit([list(zip(b, y, strict=True)) for b, y in made])


def page(body):
    return f'<body><nav><a href="/">Home</a></nav>{body}<footer>&copy; Us</footer></body>'


def test_an_article_is_not_lost_by_its_name(model):
    known = [x for _, names in h.PARTS.values() for x in names.split()]
    for name in [*SIDE, *known, "story-footer-note", "advert-free", "comment-free", "promotion-round", "widget-review"]:
        assert model.text(page(f'<article class="{name}">{PROSE}</article>')).count(h._P) == 2, name
    for name in "story-footer-note form-of-address header-image-story advert-free comment-free".split():
        assert model.text(page(f'<div class="{name}">{PROSE}<p>{h._Q}</p></div>')).count(h._P) == 2, name


def test_prose_after_the_article_goes_under_any_name(model):
    for name in SIDE:
        assert h._Q not in model.text(page(f'<article>{PROSE}</article><div class="{name}"><p>{h._Q}</p></div>')), name


def test_a_copyright_line_goes(model):
    text = model.text(f'<body><div class="top"><a href="/">Home</a></div><div class="post">{PROSE}</div><p>Copyright 2020 Us. All rights reserved.</p></body>')
    assert text.count(h._P) == 2 and "Copyright" not in text


def test_nothing_inside_an_article_is_dropped_for_its_tag(model):
    got = model.text(page(f"<article>{PROSE}<p>Energy <math><mi>E</mi><mo>=</mo><mi>m</mi></math> is known.</p><p>Press <button>Go</button> now.</p><p>Then <object>fall back</object> and <svg><text>label</text></svg> end.</p><noscript><p>No script here.</p></noscript></article>"))
    for x in ("Energy E=m is known.", "Press Go now.", "Then fall back and label end.", "No script here."):
        assert x in got.split("\n\n")


P, Q, R = "Some other words of a text that nobody has seen before are written here, and then it stops.", "It says more.", "Plain words"
SHAPES = {
    "sections": "".join(f"<section><h2>{R} {i}</h2><p>{P} {i}</p><p>{Q} {i}</p></section>" for i in range(4)),
    "divs": "".join(f"<div><p>{P} {i}</p></div>" for i in range(5)),
    "named divs": "".join(f'<div class="para-{c}"><p>{Q} {c}</p></div>' for c in "abcde") + f"<p>{P}</p>",
    "deep": f"<div><div><div><p>{P} 1</p><p>{Q} 2</p></div></div></div><p>{P} 3</p>",
    "lists": f"<p>{P} 1</p><ul><li>{R} 2</li><li>{Q} 3</li></ul><ol><li><p>{P} 4</p></li></ol>",
    "quote": f"<p>{P} 1</p><blockquote><p>{Q} 2</p></blockquote><p>{P} 3</p><pre>code 4</pre>",
    "table": f"<p>{P} 1</p><table><tr><td>{R} 2</td><td>{R} 3</td></tr><tr><td><p>{Q} 4</p></td><td>x 5</td></tr></table>",
    "figure": f"<p>{P} 1</p><figure><img><figcaption>{Q} 2</figcaption></figure><div class='caption'>{R} 3</div>",
    "details": f"<p>{P} 1</p><details><summary>{R} 2</summary><p>{Q} 3</p></details><noscript><p>{Q} 4</p></noscript><center><p>{Q} 5</p></center>",
    "definitions": f"<dl><dt>{R} 1</dt><dd>{P} 2</dd><dt>{R} 3</dt><dd><p>{Q} 4</p></dd></dl>",
}


@pytest.mark.parametrize("shape", SHAPES)
def test_articles_of_any_shape_are_whole(model, shape):
    inner = "<h1>Title</h1>" + SHAPES[shape]
    for around in ("<article>{}</article>", "<div class=post>{}</div>", "<main><div>{}</div></main>", "<div>{}</div>"):
        got = model.text(page(around.format(inner)))
        assert got.split("\n\n") == [b.text for b in h.blocks_of(inner)], around


def test_a_named_part_inside_an_article_goes(model):
    for name in (x for _, names in h.PARTS.values() for x in names.split()):
        assert h._Q not in model.text(page(f'<article>{PROSE}<div class="{name}"><p>{h._Q}</p></div></article>')), name


def test_the_field_against_all_labellings():
    """At the fitted weights the gradient of the likelihood, with its penalty, is nearly nothing; expectations are taken by
    enumeration. Decoding finds the best labelling."""
    pages = [[(b, int("data" in b.text)) for b in h.blocks_of(x)] for x in (
        "<p>data one.</p><p>x</p><div>data two</div>", '<ul><li>a</li><li class="c">data</li></ul>', "<h1>b</h1><p>data</p><p>c</p><p>d</p>", "<p>data</p><p>e</p><h1>data</h1>", "<p>f</p>")]
    m = h.fit(pages)
    names = list(m.weights)
    grad, pair_grad = dict.fromkeys(names, 0.0), np.zeros((2, 2))
    for p in pages:
        top = h.page_features([b for b, _ in p])
        feats = [b.features + h.block_features(b, top) for b, _ in p]
        score = lambda ys: sum(sum(m.weights[f] for f in fs) for fs, y in zip(feats, ys, strict=True) if y) + sum(m.pair[a, b] for a, b in itertools.pairwise(ys))  # noqa: B023, E731
        every = {ys: math.exp(score(ys)) for ys in itertools.product((0, 1), repeat=len(p))}
        z = sum(every.values())
        gold = tuple(y for _, y in p)
        for ys, w in [(gold, 1.0), *((ys, -w / z) for ys, w in every.items())]:
            for fs, y in zip(feats, ys, strict=True):
                for f in fs if y else ():
                    grad[f] += w
            for a, b in itertools.pairwise(ys):
                pair_grad[a, b] += w
        blocks = [b for b, _ in p]
        for b in blocks:
            b.score = sum(m.weights[f] for f in b.features)
        assert tuple(m.decode(blocks)) == max(every, key=every.get) == gold
    n = len(pages)
    assert max(abs(g / n - h.PENALTY * m.weights[f]) for f, g in grad.items()) < 2e-3
    assert np.abs(pair_grad / n - h.PENALTY * m.pair).max() < 2e-3
