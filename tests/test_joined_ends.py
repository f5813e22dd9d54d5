"""Ends joined a turn at a time, and bends cut in rounds and in tasks, are those of the plain order."""

import random

import pytest

from tracegraph.operators import repair


def greedy(candidates):
    used, made = set(), []
    for q in sorted(candidates, key=lambda q: (q.turn, q.src, q.dst)):
        if not used & {q.src, q.dst}:
            used |= {q.src, q.dst}
            made.append((q.src, q.dst, q.turn))
    return sorted(made)


@pytest.mark.parametrize("faced, part, together", [(64, 512, 1 << 16), (1, 3, 5)])
def test_ends_joined_by_turns_equal_the_order_of_all(spark, monkeypatch, faced, part, together):
    r = random.Random(11)
    nodes, edges = [], []
    for c in range(150):
        p = [r.randrange(14) for _ in range(3)]
        for i in range(4):
            nodes.append((c * 10 + i, *p))
            edges += [(c * 10 + i - 1, c * 10 + i)] if i else []
            p = [x + r.randrange(-4, 5) for x in p]
    n, e = spark.createDataFrame(nodes, "nid long, x long, y long, z long"), spark.createDataFrame(edges, "src long, dst long")
    want = repair.connect_candidates(n, e).collect()
    turns = []
    facing, match = repair._facing, repair.match_ends
    monkeypatch.setattr(repair, "_facing", lambda t, w, half, turn, open_: turns.append(turn) or facing(t, w, half, turn, open_))
    monkeypatch.setattr(repair, "match_ends", lambda c: match(c, together))
    monkeypatch.setattr(repair, "FACED", faced)
    monkeypatch.setattr(repair, "PART", part)
    got = repair.joined_ends(n, e).collect()
    assert len(want) > 100 and sorted(map(tuple, got)) == greedy(want)
    assert turns[-1] == 45 and (faced > 1) == (len(turns) == 1)


def test_bends_left_by_rounds_are_cut_by_tasks(spark, monkeypatch):
    bends = [(1000 * c + i, 1000 * c + i - 1, 1000 * c + i + 1) for c in range(5) for i in range(1, 41)] + [(9000 + i, 9000 + i - 1, 9000 + i + 1) for i in range(1, 9)]
    names = []
    real = repair.saved
    monkeypatch.setattr(repair, "saved", lambda df, name="table", instead_of=None: names.append(name) or real(df, name, instead_of))
    got = repair.cut_in_order(spark.createDataFrame(bends, "nid long, lo long, hi long"), 50)
    assert sorted(q.nid for q in got.collect()) == sorted(nid for nid, _, _ in bends if nid % 2)
    assert len(names) < 12  # a round for each bend of a chain before


def _copies(n_kinds, copies, seed):
    """Chains of three nodes, some joined end to end of a short one, each ``copies`` times at the same places."""
    r = random.Random(seed)
    nodes, edges = [], []
    for c in range(n_kinds):
        p, d = [r.randrange(10) for _ in range(3)], [r.choice((-2, -1, 1, 2)) for _ in range(3)]
        for k in r.sample(range(copies), copies):
            first = (k * n_kinds + c) * 3
            nodes += [(first + i, *(x + i * y for x, y in zip(p, d))) for i in range(3)]
            edges += [(first, first + 1), (first + 1, first + 2)]
    return nodes, edges


@pytest.mark.parametrize("faced, held", [(64, 1 << 21), (1, 1 << 21), (64, 40)])
def test_copies_of_ends_are_paired_as_kinds(spark, monkeypatch, faced, held):
    """30 kinds of chains, 12 of each: pairs of kinds are a hundredth of the candidates, and give what all of them give."""
    nodes, edges = _copies(30, 12, 3)
    n, e = spark.createDataFrame(nodes, "nid long, x long, y long, z long"), spark.createDataFrame(edges, "src long, dst long")
    want = repair.connect_candidates(n, e).collect()
    pairs, matched = [], repair._matched
    monkeypatch.setattr(repair, "FACED", faced)
    monkeypatch.setattr(repair, "HELD", held)
    monkeypatch.setattr(repair, "_matched", lambda p, ends, now: pairs.append(p.count()) or matched(p, ends, now))
    got = repair.joined_ends(n, e).collect()
    assert sorted(map(tuple, got)) == greedy(want) and len(got) > 50
    assert max(pairs) * 100 < len(want)


def test_lowest_ends_of_one_turn_are_joined_first():
    import pyarrow as pa

    r = random.Random(5)
    for _ in range(200):
        kinds = {k: r.sample(range(k * 10, k * 10 + 100, 7), r.randrange(1, 6)) for k in range(6)}
        nids = sorted({x for xs in kinds.values() for x in xs})
        own = {x: r.choice([k for k, xs in kinds.items() if x in xs]) for x in nids}
        met = {x: x for x in nids}
        for a, b in zip(*[iter(r.sample(nids, len(nids) // 2 * 2))] * 2):
            if r.random() < 0.3:
                met[a], met[b] = b, a
        pairs = sorted({(*sorted(r.sample(range(6), 2)), float(r.randrange(3))) for _ in range(7)})
        pairs = [p for p in pairs if all(k in own.values() for k in p[:2])]
        pairs = list({p[:2]: p for p in pairs}.values())
        every = sorted((t, min(x, y), max(x, y)) for a, b, t in pairs for x in nids for y in nids if own[x] == a and own[y] == b and met[x] != y)
        used, want = set(), []
        for t, x, y in every:
            if not used & {x, y}:
                used |= {x, y}
                want.append((x, y, t))
        table = lambda rows, names: pa.table({c: pa.array(v) for c, v in zip(names, zip(*rows))}) if rows else None
        if pairs:
            got = repair._by_kinds(table(pairs, ("src", "dst", "turn")), table([(own[x], x, met[x]) for x in nids], ("kind", "nid", "met")))
            assert sorted(tuple(q.values()) for q in got.to_pylist()) == sorted(want)
