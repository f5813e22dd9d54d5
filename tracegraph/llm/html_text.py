"""Main text of web pages: a linear-chain conditional random field over the leaf blocks of the document tree.

A page is cut into leaf blocks (text between the borders of block elements) in page order. The field scores a block as
article or not from features of its ancestors (tags, the tags of the four nearest by their distance, whole tokens of
class, id and role that describe a state, and the words of all others; html and body say nothing), from its place in or outside the page's article and
main elements, and from the shape of its text; it scores neighbouring labels together, and Viterbi decoding picks the best
labelling of the page.

It is trained by gradient ascent on the likelihood of labelled pages: the pages of ``layouts``, labelled by construction,
which have menus, headers, sidebars, adverts, notices, forms, comments and footers under many names, around, beside and
inside articles with and without an article element; and about SAMPLE_PAGES pages of the table, chosen by a hash of the
id and labelled by their own layout (``weak_labels``).

A null page is an empty one; a page without article blocks has an empty text. Nothing else is dropped or capped. Time
and memory are in proportion to a page's length, whatever its nesting and however broken its tags.
"""

from __future__ import annotations

import html as entities
import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import text_udf

SAMPLE_PAGES = 100
EPOCHS, RATE, PENALTY = 30, 0.1, 1e-4

INLINE = frozenset(
    "a abbr acronym b bdi bdo big br button cite code data del dfn em font i img input ins kbd label mark math object picture q ruby s samp "
    "small source span strike strong sub sup svg time tt u var wbr".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style title textarea iframe noembed xmp template".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("head script style title textarea iframe noembed template".split())
#: An opening tag on the left ends an open element on the right.
CLOSES = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "body": ("head",),
}
SCOPE = frozenset("html body article section main aside nav header footer div table td th ul ol dl form blockquote figure".split())

#: Tags of a page's frame, wherever they stand; and tags that say nothing about what they hold.
FRAME = frozenset("nav aside footer form dialog menu".split())
PLAIN = frozenset("html body div span p section".split())
#: A token that begins or ends with one of these describes a state of the page, and its other words name no part of it.
STATE = frozenset("has no not is free with without open opened closed enabled disabled active visible".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
#: The same where quotes are not closed.
_LOOSE = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?][^>]*(?:>|\Z)|</?[a-zA-Z][^>]*\Z|[^<]+|<", re.S)
_TAG = re.compile(r"</?[a-zA-Z]")
_NAMED = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    features: list[str]  # of its ancestors that are none of the four nearest's own; only where ``blocks_of`` is asked for them
    near: list[str]  # of the nearest ancestors
    score: float  # of the ancestors' features, summed up
    inside: bool  # in an article or main element
    home: int  # the number of the element around the nearest one
    text: str
    linked: int  # characters inside links
    label: int | None = None
    most: bool = False  # the element around the nearest one holds more of the page's text outside links than any other


class _Open:
    __slots__ = ("tag", "at", "number", "tokens", "seen", "new", "score", "hidden", "label")


def _features(tag: str, attributes: str) -> tuple[list[str], list[str]]:
    """Features of an element that hold for all below it, and those of its names alone."""
    if tag in ("html", "body"):
        return [], []
    if tag in ("article", "main"):  # what they are called is their subject
        attributes = ""
    tokens = [t for n in _NAMED.finditer(attributes) for t in (n[2] or n[3] or n[4] or "").split()] if "=" in attributes else []
    names = []
    for t in tokens:
        words = [w.lower() for w in _WORD.findall(t)]
        state = not words or STATE.intersection((words[0], words[-1]))
        names += [f"token={t.lower()}"] if state else [f"word={w.removesuffix('s')}" for w in words]
    return ([] if tag in PLAIN else [f"in={tag}"]) + names, names


def blocks_of(page: str, weights: dict[str, float] | None = None) -> list[Block]:
    """The leaf blocks of a page that have visible text; with ``weights`` their ancestors' features are summed up at once,
    else they are listed."""
    out: list[Block] = []
    stack: list[_Open] = []  # all open elements
    frame: list[_Open] = []  # those that are no inline elements
    open_: Counter[str] = Counter()
    features: Counter[str] = Counter()  # of the open elements
    run: list[str] = []
    linked = pos = number = 0
    size = len(page)
    tokens = _TOKEN

    def flush() -> None:
        nonlocal run, linked
        text = " ".join(entities.unescape("".join(run)).split()) if run else ""
        if text:
            near = [o for o in frame[-4:] if o.tag not in ("html", "body")][::-1]
            names = [f"{k}:{o.tag}" for k, o in enumerate(near)] + [f"near {t}" for o in near[:2] for t in o.tokens]
            inside = open_["article"] + open_["main"] > 0
            if inside and open_["header"]:
                names.append("heading of the article" if near and near[0].tag in ("h1", "h2", "h3") else "head of the article")
            listed = [] if weights is not None else sorted({f for o in frame for f in o.new})
            label = next((o.label for o in reversed(frame) if o.label is not None), None) if weights is None else None
            out.append(Block(listed, names, frame[-1].score if frame else 0.0, inside, frame[-2].number if len(frame) > 1 else -1, text, linked, label))
        run, linked = [], 0

    def close_to(k: int) -> None:
        if len(frame) and frame[-1].at >= k:
            flush()
        for o in stack[k:]:
            open_[o.tag] -= 1
            features.subtract(o.seen)
        del stack[k:]
        while frame and frame[-1].at >= k:
            frame.pop()

    while pos < size:
        m = tokens.match(page, pos)
        if m[0] == "<" and tokens is _TOKEN and _TAG.match(page, pos):
            tokens = _LOOSE  # a quote that is never closed: from here on none is trusted
            m = tokens.match(page, pos)
        pos = m.end()
        tag = m[2]
        if tag is None:
            if m[0][0] == "<" and len(m[0]) > 1:
                continue  # a comment, a declaration, or a tag cut off by the end
            if not (stack and stack[-1].hidden):
                run.append(m[0])
                linked += len(m[0]) if open_["a"] else 0
            continue
        tag = tag.lower()
        if m[1]:
            if open_[tag]:
                close_to(next(i for i in range(len(stack) - 1, -1, -1) if stack[i].tag == tag))
            elif tag in ("br", "p"):
                flush() if tag == "p" else run.append(" ")
            continue
        inline = tag in INLINE or open_["math"] + open_["svg"] > 0
        if not inline:
            flush()
            ends = (*CLOSES.get(tag, ()), "p")
            if any(open_[t] for t in ends):
                for o in reversed(frame):
                    if o.tag in ends:
                        close_to(o.at)
                        break
                    if o.tag in SCOPE:
                        break
        elif tag == "br":
            run.append("\n")
        if tag in VOID or (inline and re.search(r"(?:^|[\s\"'])/$", m[3])):
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\b[^>]*(?:>|\Z)", re.I).search(page, pos)
            pos = end.end() if end else size
            continue
        o = _Open()
        number += 1
        o.tag, o.at, o.number, o.label = tag, len(stack), number, None
        o.seen, o.tokens = ([], []) if inline else _features(tag, m[3])
        o.new = [f for f in dict.fromkeys(o.seen) if not features[f]]
        features.update(o.seen)
        o.hidden = tag in HIDDEN or bool(stack and stack[-1].hidden)
        if not inline:
            o.score = (frame[-1].score if frame else 0.0) + (sum(weights.get(f, 0.0) for f in o.new) if weights is not None else 0.0)
            if weights is None and 'data-label="' in m[3]:
                o.label = int(m[3].split('data-label="')[1][0])
            frame.append(o)
        stack.append(o)
        open_[tag] += 1
    flush()
    best = fullest(out)
    for b in out:
        b.most = b.home == best
    return out


def fullest(blocks: list[Block]) -> int:
    """The number of the element that directly holds the most text outside links."""
    held: defaultdict[int, int] = defaultdict(int)
    for b in blocks:
        held[b.home] += len(b.text) - b.linked
    return max(held, key=held.__getitem__, default=-1)


def page_features(blocks: list[Block]) -> str:
    """What holds for all blocks outside article and main elements."""
    return "outside the article" if any(b.inside for b in blocks) else "no article"


def block_features(block: Block, page: str) -> list[str]:
    """A block's own features, beside those of its ancestors."""
    n = len(block.text)
    out = ["bias", f"length={min(7, n.bit_length() // 2)}", "inside" if block.inside else page, *block.near]
    if block.linked * 2 > n:
        out.append("linked")
    if block.most:
        out.append("most text")
    if block.text[0] == "©":
        out.append("copyright")
    if block.text[-1] in ".!?…":
        out.append("sentence end")
    return out


def weak_labels(blocks: list[Block]) -> list[int]:
    """Labels by a page's own layout: 1 inside an article or main element and in no element of a page's frame, of a header
    there the headings alone. Where a page has no such element, 1 in the element that directly holds the most text outside
    links."""
    if any(b.inside for b in blocks):
        return [int(b.inside and not any(f"in={t}" in b.features for t in FRAME) and "head of the article" not in b.near) for b in blocks]
    return [int(b.most and b.linked * 2 <= len(b.text)) for b in blocks]


@dataclass
class Model:
    """Weights of the features for the label 1, and of neighbouring labels."""

    weights: dict[str, float]
    pair: np.ndarray

    def score(self, block: Block, page: str = "no article") -> float:
        return block.score + sum(self.weights.get(f, 0.0) for f in block_features(block, page))

    def decode(self, blocks: list[Block]) -> list[int]:
        """The likeliest labels, by Viterbi's recursion; of equals the one that leaves out."""
        (p00, p01), (p10, p11) = self.pair.tolist()
        a = b = 0.0
        back: list[tuple[int, int]] = []
        page = page_features(blocks)
        for i, block in enumerate(blocks):
            s = self.score(block, page)
            if i == 0:
                a, b = 0.0, s
                continue
            to0, to1 = (a + p00, b + p10), (a + p01, b + p11)
            back.append((int(to0[1] > to0[0]), int(to1[1] > to1[0])))
            a, b = max(to0), max(to1) + s
        if not blocks:
            return []
        out = [int(b > a)]
        for k in reversed(back):
            out.append(k[out[-1]])
        return out[::-1]

    def text(self, page: str | None) -> str:
        blocks = blocks_of(page or "", self.weights)
        return "\n\n".join(b.text for b, keep in zip(blocks, self.decode(blocks), strict=True) if keep)


def fit(pages: list[list[tuple[Block, int]]]) -> Model:
    """Maximum likelihood with a small quadratic penalty, by Adam over all pages at once."""
    pages = [p for p in pages if p]
    names: dict[str, int] = {}
    rows, cols, first = [], [], []
    n = 0
    for p in pages:
        first.append(n)
        page = page_features([b for b, _ in p])
        for b, _ in p:
            for f in b.features + block_features(b, page):
                rows.append(n)
                cols.append(names.setdefault(f, len(names)))
            n += 1
    rows, cols, first = np.array(rows), np.array(cols), np.array(first)
    y = np.array([label for p in pages for _, label in p])
    length = np.diff(np.append(first, n))
    w, pair = np.zeros(len(names)), np.zeros((2, 2))
    T = int(length.max(initial=0))
    inside = np.arange(T)[:, None] < length  # T x pages
    at = np.minimum(first + np.arange(T)[:, None], max(0, n - 1))
    gold = np.zeros((2, 2))
    follow = np.setdiff1d(np.arange(n), first)
    np.add.at(gold, (y[follow - 1], y[follow]), 1)
    moment = [np.zeros(len(names) + 4), np.zeros(len(names) + 4)]
    lse = np.logaddexp
    for step in range(1, EPOCHS * 10 + 1):
        s = np.bincount(rows, weights=w[cols], minlength=n)
        e = np.where(inside, s[at], 0.0)
        alpha, beta = np.zeros((T, len(pages), 2)), np.zeros((T, len(pages), 2))
        alpha[0, :, 1] = e[0]
        for t in range(1, T):
            go = inside[t]
            for j in (0, 1):
                alpha[t, :, j] = np.where(go, lse(alpha[t - 1, :, 0] + pair[0, j], alpha[t - 1, :, 1] + pair[1, j]) + j * e[t], alpha[t - 1, :, j])
        for t in range(T - 2, -1, -1):
            go = inside[t + 1]
            for i in (0, 1):
                beta[t, :, i] = np.where(go, lse(pair[i, 0] + beta[t + 1, :, 0], pair[i, 1] + e[t + 1] + beta[t + 1, :, 1]), 0.0)
        z = lse(alpha[-1, :, 0], alpha[-1, :, 1])
        p1 = np.exp(alpha[:, :, 1] + beta[:, :, 1] - z)
        prob = np.zeros(n)
        prob[at[inside]] = p1[inside]
        expect = np.zeros((2, 2))
        for t in range(1, T):
            for i in (0, 1):
                for j in (0, 1):
                    expect[i, j] += np.exp(alpha[t - 1, :, i] + pair[i, j] + j * e[t] + beta[t, :, j] - z)[inside[t]].sum()
        grad = np.concatenate([np.bincount(cols, weights=(y - prob)[rows], minlength=len(names)), (gold - expect).ravel()]) / max(1, len(pages))
        grad -= PENALTY * np.concatenate([w, pair.ravel()])
        moment[0] += 0.1 * (grad - moment[0])
        moment[1] += 0.01 * (grad * grad - moment[1])
        move = RATE * (moment[0] / (1 - 0.9**step)) / (np.sqrt(moment[1] / (1 - 0.99**step)) + 1e-8)
        w, pair = w + move[:-4], pair + move[-4:].reshape(2, 2)
    return Model({f: float(w[i]) for f, i in names.items()}, pair)


_P = "Some sentences of the article follow one another here, long enough to be read, and end as sentences do."
_Q = "A second paragraph says more about it. It has two sentences."
_R = "Short words"
#: Parts of a page's frame: for each how it is written in tags alone, and the names that elements without such tags have.
#: {} holds what a part says.
PARTS = {
    "menu": ("<nav>{}</nav>", "menu nav navbar navigation main-menu breadcrumb breadcrumbs pagination pager toc-links skip-links"),
    "header": ("<header>{}</header>", "header site-header masthead page-header topbar branding"),
    "sidebar": ("<aside>{}</aside>", "sidebar side-bar rail widget widgets related related-posts recommended recommendations most-read trending popular"),
    "advert": ("<aside>{}</aside>", "ad ads ad-slot advert adverts advertisement advertising sponsored sponsor promo promotion banner"),
    "notice": ("<dialog>{}</dialog>", "notice cookie-notice cookies consent cookie-banner alert popup modal overlay paywall newsletter subscribe"),
    "form": ("<form>{}</form>", "form search search-form login signup contact-form feedback-form poll"),
    "comments": ("<section id=comments>{}</section>", "comments comment comment-list comments-area reader-comments responses response replies reply discussion disqus_thread reactions respond guestbook"),
    "share": ("<footer>{}</footer>", "share sharing social social-links tags tag-list toolbar post-meta byline author-bio"),
    "footer": ("<footer>{}</footer>", "footer site-footer page-footer copyright legal colophon bottom"),
}
_LINKS = '<ul><li><a href="/a">First</a></li><li><a href="/b">Second one</a></li></ul>'
_SAYS = {
    "menu": [_LINKS, f"<p>{_R}</p>{_LINKS}"], "header": [f"<div>{_R}</div>", f"<p>{_Q}</p>{_LINKS}"], "sidebar": [f"<h3>{_R}</h3><p>{_Q}</p>{_LINKS}", f"<p>{_P}</p>"],
    "advert": [_Q, f"<p>{_P}</p>"], "notice": [f"<p>{_Q}</p>", _P], "form": [f"<p>{_Q}</p><label>{_R}</label>", f"<h3>{_R}</h3><p>{_P}</p>"],
    "comments": [f"<h3>{_R}</h3><div><p>{_P}</p></div><div><p>{_Q}</p></div>", f"<p>{_P}</p><p>{_P}</p><p>{_Q}</p>", f"<article><p>{_P}</p></article><article><p>{_Q}</p></article>"],
    "share": [f'<a href="/s">{_R}</a>', f"<p>{_R}</p>"], "footer": [f"&copy; {_R}", f"<p>{_Q}</p>{_LINKS}"],
}
#: Articles and their names; a header's headings are the article's, what else it says is not.
_ARTICLE = [
    f"<h1>{_R}</h1><p>{_P}</p><p>{_Q}</p>|<p>{_P}</p>",
    f'<header><h1>{_R}</h1><p data-label="0">{_R}</p></header><p>{_P}</p><h2>{_R}</h2><ul><li>{_R}</li><li>{_Q}</li></ul>|<p>{_Q}</p>',
    f"<h1>{_R}</h1><div>{_P}</div><blockquote>{_P}</blockquote>|<table><tr><td>{_R}</td><td>{_R}</td></tr></table><p>{_Q}</p>",
    f"<h1>{_R}</h1><section><h2>{_R}</h2><p>{_P}</p></section>|<section><p>{_Q}</p><pre>a b</pre><figure><figcaption>{_Q}</figcaption></figure></section>",
    f"<p>{_P}</p><p>{_P}</p>|<dl><dt>{_R}</dt><dd>{_Q}</dd></dl><p>{_Q}</p>",
    f"<h1>{_R}</h1><div><p>{_P}</p></div><div><p>{_Q}</p></div>|<div><p>{_P}</p></div><div><p>{_R}</p></div>",
    f"<h1>{_R}</h1><div><div><p>{_P}</p><p>{_Q}</p></div></div>|<div>{_R}</div><p>{_P}</p>",
    f"<p>{_P}</p><blockquote><p>{_Q}</p></blockquote>|<ul><li><p>{_P}</p></li></ul><dl><dt>{_R}</dt><dd><p>{_Q}</p></dd></dl>",
    f"<p>{_P}</p><details><summary>{_R}</summary><p>{_Q}</p></details>|<noscript><p>{_Q}</p></noscript><center><p>{_Q}</p></center>",
]
_NAMES = "content post entry article story main text post-content entry-content article-body main-content page has-sidebar comments-open no-ads".split()


def _blanks() -> Iterator[str]:
    """Names that say nothing, each once: an element that has one is known by its place, its links and its text alone."""
    for k in itertools.count(26**3):
        name = ""
        while k:
            k, c = divmod(k, 26)
            name += chr(97 + c)
        yield name


def layouts() -> list[str]:
    """Labelled pages; data-label on an element holds for all blocks inside it that have no nearer one. Each name of each
    part is seen outside and inside of articles of different make; parts of links alone also without a name."""
    out = []
    for k, a in enumerate(_ARTICLE * 4):
        links = f'<div data-label="0"><a href="/">{_R}</a>{" <a href=/c>More</a>" if k % 2 else ""}</div>'
        out.append(f'<body>{links}<div data-label="1">{a.replace("|", "")}</div>{links}</body>')
    bodies, names, blank = itertools.cycle(_ARTICLE), itertools.cycle(_NAMES), _blanks()
    around = [
        lambda a, n: f'<article class="{n}" data-label="1">{a}</article>',
        lambda a, n: f'<div class="{n}" data-label="1">{a}</div>',
        lambda a, n: f'<main data-label="1"><div id="{n}">{a}</div></main>',
        lambda a, n: f'<div data-label="1">{a}</div>',
    ]
    shapes = itertools.cycle(around)
    for part, (tagged, named) in PARTS.items():
        says = itertools.cycle(_SAYS[part])
        ways = [tagged, *(f'<div class="{n}">{{}}</div>' if k % 2 else f'<section id="{n}">{{}}</section>' for k, n in enumerate(named.split()))]
        if part in ("menu", "notice"):
            ways.append(f'<div role="{"navigation" if part == "menu" else "alert"}">{{}}</div>')
        for k, way in enumerate(ways):
            for inner in (False, True) * (2 if k else 8):
                piece = f'<div data-label="0">{way.format(next(says))}</div>' if not inner else way.replace(">", ' data-label="0">', 1).format(next(says))
                first, second = next(bodies).split("|")
                if inner and part in ("sidebar", "advert", "notice", "form", "comments", "share"):
                    page = next(shapes)(first + piece + second, next(names))
                else:
                    page = next(shapes)(first + second, next(names))
                    page = piece + page if part in ("menu", "header", "notice", "advert") else page + piece
                    if part in ("sidebar", "advert", "notice", "form", "comments"):  # the same without a name, after the article
                        first, second = next(bodies).split("|")
                        plain = f'<div class="{next(blank)}" data-label="0">{next(says)}</div>'
                        out.append(f'<body><nav data-label="0">{_LINKS}</nav><article class="{next(blank)}" data-label="1">{first + second}</article>{plain}<footer data-label="0">&copy; {_R}</footer></body>')
                out.append(f'<body class="single has-sidebar comments-open"><nav data-label="0">{_LINKS}</nav>{page}<footer data-label="0">&copy; {_R}</footer></body>')
    # names in which a part's word does not name a part: such an element holds most of its page
    for part, (_, named) in PARTS.items():
        for k, word in enumerate(named.split()):
            body = next(bodies).replace("|", f"<p>{_P}</p><p>{_Q}</p>")
            name = (f"story-{word}-note", f"{word}-of-address", f"long-{word}-story")[k % 3]
            # and the plain word, on one paragraph inside an article
            first, second = next(bodies).split("|")
            own = f'<div class="{word}" data-label="0"><p>{(_P, _Q)[k % 2]}</p></div>'
            out.append(f'<body><nav data-label="0">{_LINKS}</nav><article data-label="1">{first + (own + second if k % 4 < 2 else second + own)}</article><footer data-label="0">&copy; {_R}</footer></body>')
            side = f'<div class="{word}" data-label="0">{next(itertools.cycle(_SAYS[part]))}</div>' if k % 2 else ""
            out.append(f'<body><nav data-label="0">{_LINKS}</nav><div class="{name}" data-label="1">{body}</div>{side}<footer data-label="0">&copy; {_R}</footer></body>')
    return out


def train(pages: DataFrame, sample: int = SAMPLE_PAGES) -> Model:
    # ids first, so that no partition sends its pages to the driver; rows with a null id teach nothing
    some = pages.where("html is not null and page_id is not null")
    ids = [r.page_id for r in some.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(sample).collect()]
    found = {r.page_id: r for r in some.where(F.col("page_id").isin(ids)).groupBy("page_id").agg(F.min("html").alias("html")).collect()}
    marked = [(b, weak_labels(b)) for b in (blocks_of(found[i].html) for i in dict.fromkeys(ids))]
    made = [(b, [x.label or 0 for x in b]) for b in map(blocks_of, layouts())]
    return fit([list(zip(b, y, strict=True)) for b, y in marked + made])


def extract(pages: DataFrame, model: Model) -> DataFrame:
    """(page_id, url, text, n_chars) of every page."""

    def make():
        return lambda html: pa.array([model.text(x) for x in html.to_pylist()], pa.string())

    out = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", text_udf(make, "string")("html").alias("text"))
    return out.withColumn("n_chars", F.length("text").cast("long"))


def op5_html_extraction(spark, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extract(pages, train(pages))
