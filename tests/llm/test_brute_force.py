"""Models against plain ones: Kneser-Ney by dictionaries, statistics and scores by loops, the field by enumeration."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tracegraph.llm import html_text, perplexity, quality

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def some_texts(seed: int, n: int) -> list:
    r = random.Random(seed)
    parts = ["the", "cat", "sat", "Ünter", "näh", "a|b", "#*", "x" * 20, "no.", "no!", "12", "<p>", "the", "of"]
    texts = [r.choice(["", " "]) + "".join(r.choice(parts) + r.choice([" ", " ", "\n", "\t", "  "]) for _ in range(r.randint(1, 60))) for _ in range(n)]
    return [*texts, texts[0], None, "", " \n ", "one", "same same same same", "語 語"]


def spelled(text: str | None) -> bytes:
    """A space, then each word and a space."""
    words = WORD.findall((text or "").encode())
    return b" " + b"".join(w + b" " for w in words) if words else b""


def plain_kneser_ney(texts: list, order: int):
    """p(n-gram): the probability of its last byte after the others, from dictionaries of counts."""
    level = [collections.Counter() for _ in range(order + 1)]
    for s in map(spelled, texts):
        for i in range(1, len(s)):
            g = s[max(0, i - order + 1) : i + 1]
            level[len(g)][g] += 1
    for k in range(order, 1, -1):
        for g in list(level[k]):
            level[k - 1][g[1:]] += 1
    discount = [None]
    for counts in level[1:]:
        n = [None] + [sum(v == j for v in counts.values()) for j in (1, 2, 3, 4)]
        y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.0
        discount.append([None] + [max(0.0, min(j, j - (j + 1) * y * n[j + 1] / n[j])) if n[j] else 0.5 * j for j in (1, 2, 3)])
    after = [collections.defaultdict(dict) for _ in level]
    for k, counts in enumerate(level):
        for g, v in counts.items():
            after[k][g[:-1]][g[-1]] = v

    def p(g: bytes) -> float:
        if not g:
            return 1 / 256
        k = len(g)
        seen = after[k].get(g[:-1])
        if not seen:
            return p(g[1:])
        cut = {b: discount[k][min(v, 3)] for b, v in seen.items()}
        total = sum(seen.values())
        own = (seen[g[-1]] - cut[g[-1]]) / total if g[-1] in seen else 0.0
        return own + sum(cut.values()) / total * p(g[1:])

    return p


def test_perplexities_equal_plain_kneser_ney(spark):
    taught, other = some_texts(1, 40), some_texts(2, 12) + ["quite unknown wörds"]
    schema = "doc_id long, text string, lang string"
    model = perplexity.train(spark.createDataFrame([(t,) for t in taught], "text string"))
    docs = spark.createDataFrame([(i, t, "en") for i, t in enumerate(taught + other)], schema)
    got = {r.doc_id: r.log_ppl for r in perplexity.measured(docs, model).collect()}
    p = plain_kneser_ney(taught, perplexity.ORDER)
    for i, text in enumerate(taught + other):
        s = spelled(text)
        if not s:
            assert got[i] is None
            continue
        want = -sum(math.log(p(s[max(0, k - perplexity.ORDER + 1) : k + 1])) for k in range(1, len(s))) / (len(s) - 1)
        assert got[i] == pytest.approx(want, abs=1e-9)


def plain_statistics(text: str | None) -> list[float]:
    raw = (text or "").encode()
    if not raw:
        return [0.0] * 21
    sets = [
        set(range(97, 123)), set(range(65, 91)), set(range(48, 58)), set(b" \t\r\x0b\x0c"), set(b"\n"), set(b".,;:'\"?-()"), set(b"|"), set(b"!"), set(b"#*$%&"),
        set(b"<>{}[]=/\\_@"), set(), set(range(128, 256)),
    ]
    sets[10] = set(range(256)).difference(*sets)
    words = WORD.findall(raw)
    some = max(1, len(words))
    size = [len(w) for w in words]
    mean = sum(size) / some
    triples = list(zip(words, words[1:], words[2:], strict=False))
    odd = sets[6] | sets[7] | sets[8] | sets[9] | sets[10]
    return [
        *(sum(b in s for b in raw) / len(raw) for s in sets),
        math.log(1 + len(words)),
        mean,
        math.sqrt(max(0.0, sum(n * n for n in size) / some - mean * mean)),
        len(set(words)) / some,
        len(set(triples)) / max(1, len(triples)) if triples else 0.0,
        sum(a == b for a, b in itertools.pairwise(words)) / some,
        math.log(1 + len(words) / (raw.count(b"\n") + 1)),
        sum(n > 15 for n in size) / some,
        sum(w[-1] in odd for w in words) / some,
    ]


def test_statistics_equal_plain_loops():
    texts = some_texts(5, 60)
    got = quality.statistics(pa.array(texts, pa.string()))
    assert np.allclose(got, [plain_statistics(t) for t in texts], atol=1e-9)


def test_quality_scores_equal_a_plain_fit(spark):
    """Moments, ridge solution by least squares on all rows at once, calibration by the min-max formula."""
    r = random.Random(8)
    texts = [t for t in some_texts(6, 150) if t]
    labels = [int(("#*" in t) == (r.random() < 0.2)) for t in texts]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(zip(texts, labels, strict=True))], "doc_id long, text string, label int").repartition(5)
    model = quality.train(quality.with_statistics(df).select("stats", "label"))
    got = {x.doc_id: x.quality_score for x in quality.with_scores(df, model).collect()}

    x, y = quality.statistics(pa.array(texts)), np.array(labels, float)
    mean, dev = x.mean(0), x.std(0)
    z = np.clip((x - mean) / np.where(dev > 1e-9, dev, 1.0), -6, 6)
    words = np.array([len(WORD.findall(t.encode())) for t in texts])
    size_of_text = z[:, 12].copy()
    z *= (words / (words + quality.TRUST_WORDS))[:, None]
    z[:, 12] = size_of_text
    g = np.random.default_rng(11)
    w, b = g.standard_normal((21, quality.FEATURES)) / quality.WIDTH, g.uniform(0, 2 * np.pi, quality.FEATURES)
    c = np.array([[math.sqrt(2 / quality.FEATURES) * math.cos(v) for v in row] + [1.0] for row in z @ w + b])

    def solved(rows: np.ndarray) -> np.ndarray:
        penalty = np.sqrt(np.array([quality.RIDGE * rows.sum() + 1e-9] * quality.FEATURES + [1e-9]))
        return np.linalg.lstsq(np.vstack([c[rows], np.diag(penalty)]), np.concatenate([y[rows], 0 * penalty]), rcond=None)[0]

    every = np.ones(len(y), bool)
    # the halves' rule is the operator's own: a bit of a hash of the row
    with np.errstate(over="ignore"):
        second = quality.mix(np.add.reduce(np.ascontiguousarray(x).view(np.uint64), axis=1)) >> np.uint64(63) == 1
    assert second.any() and not second.all()
    own = np.where(second, c @ solved(~second), c @ solved(second))
    at = np.clip(np.rint((own + 0.5) * (quality.BINS / 2)), 0, quality.BINS)
    bins = np.unique(at)
    ones, n = np.array([[y[at == k].sum(), (at == k).sum()] for k in bins]).T
    level = [max(min(ones[j : k + 1].sum() / n[j : k + 1].sum() for k in range(i, len(bins))) for j in range(i + 1)) for i in range(len(bins))]
    want = np.interp(c @ solved(every), bins / (quality.BINS / 2) - 0.5, level)
    assert [got[i] for i in range(len(texts))] == pytest.approx(list(want), abs=1e-5)


def test_field_is_fitted_by_the_enumerated_gradient(monkeypatch):
    """Ten steps with gradients summed over all labellings of each page."""
    monkeypatch.setattr(html_text, "EPOCHS", 1)
    r = random.Random(3)
    pages = []
    for size in (1, 4, 3, 6, 2):
        blocks = [html_text.Block([f"0:{r.choice('abc')}"], [f"near {r.choice('xy')}"], 0.0, r.random() < 0.4, k // 2, "some text" + r.choice([".", "", "©"]) * r.randint(0, 9), r.choice([0, 8])) for k in range(size)]
        pages.append([(b, r.randint(0, 1)) for b in blocks])
    model = html_text.fit(pages)

    rows = [[b.features + html_text.block_features(b, html_text.page_features([x for x, _ in p])) for b, _ in p] for p in pages]
    keys = sorted({f for p in rows for fs in p for f in fs}) + [(i, j) for i in (0, 1) for j in (0, 1)]
    value, first, second = dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0), dict.fromkeys(keys, 0.0)

    def counts(features, labels):
        return collections.Counter([f for fs, k in zip(features, labels, strict=True) if k for f in fs] + list(itertools.pairwise(labels)))

    for step in range(1, 11):
        grad = {k: -html_text.PENALTY * v for k, v in value.items()}
        for features, page in zip(rows, pages, strict=True):
            found = [counts(features, y) for y in itertools.product((0, 1), repeat=len(page))]
            mass = [math.exp(sum(value[k] * m for k, m in f.items())) for f in found]
            for f, m in zip(found, mass, strict=True):
                for k, times in f.items():
                    grad[k] -= times * m / sum(mass) / len(pages)
            for k, times in counts(features, [label for _, label in page]).items():
                grad[k] += times / len(pages)
        for k in keys:
            first[k] += 0.1 * (grad[k] - first[k])
            second[k] += 0.01 * (grad[k] ** 2 - second[k])
            value[k] += html_text.RATE * first[k] / (1 - 0.9**step) / (math.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)
    assert model.pair.ravel() == pytest.approx([value[i, j] for i in (0, 1) for j in (0, 1)], abs=1e-6)
    assert {k: model.weights.get(k, 0.0) for k in keys if isinstance(k, str)} == pytest.approx({k: value[k] for k in keys if isinstance(k, str)}, abs=1e-6)
