"""Exact duplicates, periodic runs and the Merkle manifest against brute force."""

import hashlib
import itertools
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tracegraph.llm import bytewords, exact_dedup, merkle, periodic_runs

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(x):
    return hashlib.sha256(x.encode()).hexdigest()


def corpus():
    r = random.Random(11)
    words = "alpha beta Gamma delta épée 字 x1 -- , the".split()
    docs = [(i, " ".join(r.choice(words) for _ in range(r.randint(0, 60))), r.choice(["en", "de", "Ü", None]), r.choice(["s", None]), i) for i in range(200)]
    docs += [(200 + i, docs[i % 9][1].upper() if i % 2 else docs[i % 9][1], "en", "s", None) for i in range(60)]
    docs += [(300, None, None, None, None), (301, "", "", "", 0), (302, " \n ", "en", "s", 1), (303, "éÀ", "en", "s", 1), (304, "ÉÀ", "en", "s", 1)]
    docs += [(305, "same row", "fr", "s", 1)] * 3 + [(None, "no id", "fr", "s", 1)] * 2 + [(None, "one id", "fr", "s", 1), (306, "one ID", "fr", "s", 1)]
    docs += [(400 + i, ("tic tac\ttoe " * r.randint(1, 9)) + " ".join(r.choice("ab") for _ in range(30)), "xx", "s", 1) for i in range(30)]
    docs.append((500, " ".join(r.choice(["a", "b"]) for _ in range(3000)) + " z" * 5000 + " " + "y" * 70_000, "en", "s", 1))
    return docs


@pytest.fixture(scope="module")
def docs(spark):
    """Columns of names that the operators use themselves stand beside."""
    return spark.createDataFrame(corpus(), SCHEMA).withColumns({c: F.lit("mine") for c in ("row", "print", "sha", "size", "pos", "tree", "runs", "_p")}).repartition(7)


def table(spark, rows, tmp_path):
    spark.createDataFrame(rows, SCHEMA).repartition(5).write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


# exact duplicates


def test_filters_lose_nothing():
    r = random.Random(2)
    for _ in range(200):
        bits = r.randint(0, 6)
        number = r.randrange(1 << bits)

        def made():
            low = r.choice([64 - bits, 9])
            prints = np.array(sorted({(number << (64 - bits)) | r.randrange(1 << low) for _ in range(r.randint(0, 40))}), np.uint64)
            return prints, np.array([r.choice([1, 1, 7, 10**12]) for _ in prints], np.int64)

        a, b = made(), made()
        total = {}
        for prints, counts in (a, b):
            back = exact_dedup.unpack(exact_dedup.pack(prints, counts, bits), number)
            assert (back[0] == prints).all() and (back[1] == counts).all()
            for x, c in zip(prints.tolist(), counts.tolist(), strict=True):
                total[x] = total.get(x, 0) + c
        both = exact_dedup.unpack(exact_dedup.merge([exact_dedup.pack(*a, bits), exact_dedup.pack(*b, bits)], number, bits), number)
        assert list(zip(both[0].tolist(), both[1].tolist(), strict=True)) == sorted(total.items())


def test_filters_of_many_slices(spark):
    values = [(x * 0x9E3779B97F4A7C15 % 2**64 - 2**63,) for x in list(range(5000)) + list(range(0, 5000, 3)) * 2]
    prints = spark.createDataFrame(values, "print long").repartition(6)
    filters = exact_dedup.merged(exact_dedup.partition_filters(prints, 4), 4)
    assert filters.count() == 16
    got = {r["print"]: r.n for r in exact_dedup.counted(filters).collect()}
    assert got == {values[x][0]: 3 for x in range(0, 5000, 3)}


@pytest.mark.parametrize(("broadcast", "hot"), [(10**6, 0.001), (0, 0.001), (10**6, 0.02)])
def test_exact_groups(spark, docs, monkeypatch, broadcast, hot):
    monkeypatch.setattr(exact_dedup, "BROADCAST_PRINTS", broadcast)
    monkeypatch.setattr(exact_dedup, "HOT", hot)
    rows = exact_dedup.groups(docs).collect()
    want = {}
    for i, t, *_ in corpus():
        want.setdefault((t or "").translate(FOLD), []).append(i)
    by_text = {sha(k): v for k, v in want.items()}
    assert len(rows) == len(corpus())
    kept = {}
    for r in rows:
        ids = by_text[r.text_sha256]
        assert r.group_size == len(ids)
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        assert not r.kept or r.doc_id == r.keep_id
        kept[r.text_sha256] = kept.get(r.text_sha256, 0) + r.kept
    assert kept == dict.fromkeys(by_text, 1)


def test_keep_one(spark, docs):
    left = exact_dedup.keep_one(docs)
    assert left.columns == docs.columns
    texts = [(r.text or "").translate(FOLD) for r in left.collect()]
    assert sorted(texts) == sorted({(t or "").translate(FOLD) for _, t, *_ in corpus()})
    assert exact_dedup.keep_one(docs.limit(0)).count() == 0


# periodic runs


def brute_runs(w):
    out = set()
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            if w[i] != w[i + q]:
                i += 1
                continue
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            n = i + q - s
            if n >= max(6, 4 * q) and all(w[s : s + n - d] != w[s + d : s + n] for d in range(1, q)):
                out.add((s, n, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def test_lyndon_arrays():
    r = random.Random(1)
    for _ in range(1500):
        s = [r.randrange(r.randint(1, 3)) for _ in range(r.randint(1, 12))]
        s = [sorted(set(s)).index(x) for x in s]
        lyndon = lambda w: all(w < w[i:] for i in range(1, len(w)))
        assert periodic_runs.lyndon_array(s) == [max(k for k in range(1, len(s) - i + 1) if lyndon(s[i : i + k])) for i in range(len(s))]


def test_runs_and_the_stretches_that_hold_them():
    r = random.Random(3)
    for _ in range(1500):
        w = []
        for _ in range(r.randint(1, 5)):
            w += [r.randrange(r.randint(1, 4)) for _ in range(r.randint(1, 6))] * r.randint(1, 7)
            w = w[: len(w) - r.randint(0, 2)]
        h = np.array([x * 0x9E3779B97F4A7C15 % 2**64 for x in w], np.uint64)
        assert periodic_runs.runs_of(h) == brute_runs(w)
        found = [(a + s, n, q) for a, b in periodic_runs.stretches(h, np.zeros(len(w), np.int64)) for s, n, q in periodic_runs.runs_of(h[a:b])]
        assert sorted(found) == sorted(brute_runs(w))


def collapsed(w, runs):
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def words(t):
    return [x.decode() for x in (t or "").encode().split()]


def test_words_are_joined_in_pieces(monkeypatch):
    monkeypatch.setattr(periodic_runs, "PIECE", 3)
    w = bytewords.words_of(pa.array(["a b  c\td é f g h"]))
    for keep in itertools.product([True, False], repeat=8):
        assert periodic_runs._collapsed(w.data, w.start, w.end, np.array(keep)).decode() == " ".join(itertools.compress("a b c d é f g h".split(), keep))


def test_runs_of_texts(spark, docs):
    out = periodic_runs.with_runs(docs)
    assert set(out.columns) == {*docs.columns, "collapsed"}
    for r in out.select("text", "runs", "collapsed").collect():
        w = words(r.text)
        runs = [(x.start, x.length, x.period) for x in r.runs]
        if len(w) < 4000:
            assert runs == brute_runs(w)
        else:
            assert any(q == 1 and n == 5000 for _, n, q in runs)
        assert r.collapsed == collapsed(w, runs)
    assert periodic_runs.with_runs(docs.limit(0)).count() == 0


def test_periodic_query(spark, tmp_path):
    rows = [d for d in corpus() if d[0] != 500]
    got = {}
    for r in periodic_runs.op12_periodic_runs(spark, table(spark, rows, tmp_path)).collect():
        got.setdefault(r.doc_id, []).append(r)
    tails = 0
    for i, t, *_ in rows:
        w = words(t)
        n, h = len(w), zlib.crc32(str(i).encode())
        if i is not None and h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (k - a) % p] for k in range(a, n)]
            tails += 1
        runs = brute_runs(w)
        best = min(((-m, s, q) for s, m, q in runs), default=None)
        want = (len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4), sha("".join(f"{s},{m},{q}\n" for s, m, q in runs)), sha(collapsed(w, runs)))
        assert want in [tuple(r)[1:] for r in got[i]]
    assert tails > 10


# Merkle manifest


def field(x):
    return "-" if x is None else f"{len(str(x).encode())}:{x}"


def brute_manifest(rows):
    """{(doc_id, leaf): (subroot, root, proof, folded, verified)}"""
    leaf = lambda d, t: sha("".join(map(field, (d[0], d[3], d[2], d[4], t))))
    groups = {}
    for d in rows:
        claim = d[1].translate(FOLD) if d[1] is not None and d[0] is not None and zlib.crc32(str(d[0]).encode()) % 3 == 0 else d[1]
        groups.setdefault(d[2], []).append((d[0], leaf(d, d[1]), leaf(d, claim)))

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            below = levels[-1]
            levels.append([sha("".join(below[k : k + 8])) for k in range(0, len(below), 8)])
        return levels

    def way(levels, at):
        for below in levels[:-1]:
            run = below[at - at % 8 : at - at % 8 + 8]
            yield at % 8, run[: at % 8], run[at % 8 + 1 :]
            at //= 8

    names = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for g in names:
        groups[g].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[g] = grow([x[1] for x in groups[g]])
    top = grow([trees[g][-1][0] for g in names])
    out = {}
    for k, g in enumerate(names):
        for i, (doc, own, claim) in enumerate(groups[g]):
            path = [*way(trees[g], i), *way(top, k)]
            now = claim
            for _, left, right in path:
                now = sha("".join(left) + now + "".join(right))
            out.setdefault((doc, own), []).append((trees[g][-1][0], top[-1][0], sha("".join("".join(a) + "".join(b) for _, a, b in path)), now, now == top[-1][0]))
    return out


@pytest.mark.parametrize("levels", [4, 1])
def test_manifest(spark, tmp_path, levels):
    rows = corpus() + [(1000 + i, f"T{i}", f"l{i:03}", None, i) for i in range(30)]
    got = {}
    for r in merkle.op13_merkle_manifest(spark, table(spark, rows, tmp_path), levels).collect():
        got.setdefault((r.doc_id, r.leaf), []).append(tuple(r)[2:])
    want = brute_manifest(rows)
    assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
    assert {x[-1] for v in want.values() for x in v} == {True, False}


def test_manifest_of_few_rows(spark, tmp_path):
    one = merkle.op13_merkle_manifest(spark, table(spark, [(3, "a", "en", "s", 1)], tmp_path)).collect()
    assert len(one) == 1 and one[0].leaf == one[0].subroot == one[0].root and one[0].proof_sha256 == sha("")
    assert merkle.op13_merkle_manifest(spark, table(spark, [], tmp_path)).count() == 0
