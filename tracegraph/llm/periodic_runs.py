"""Periodic runs of words by Lyndon roots.

A run is a stretch of consecutive words with smallest period q, at least LEAST_LENGTH words and LEAST_PERIODS periods
long, that no neighbouring word extends. The words of a text are ranked, and phase one of Baier's suffix sorting groups
its suffixes by their longest Lyndon prefix; the sizes of those prefixes are the Lyndon array. That is done under the order
of the ranks and under its reverse: every run has a Lyndon root that is the longest one of its place under one of the two.
Roots grow to runs by longest common extensions, a block of doubling size at a time.

Only stretches that can hold a run are sorted: all of a run's words lie in four words in a row that occur again in the
text, no farther away than a quarter of the stretch. This loses none, as a run of q is at least 2 q + 4 words long.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import text_udf, words_of

LEAST_LENGTH, LEAST_PERIODS = 6, 4
#: Words in a row that a run has twice; LEAST_LENGTH and LEAST_PERIODS times q are both at least 2 q + GRAM.
GRAM = 4
#: Words that are joined at a time.
PIECE = 1 << 17
RETURNS = "struct<runs: array<struct<start: long, length: long, period: long>>, collapsed: string>"


def lyndon_array(ranks: list[int]) -> list[int]:
    """For each place the length of the longest Lyndon word that starts there; ``ranks`` are 0 to the greatest, each there.

    Groups are numbered by their place in the order of suffixes and taken from the highest to the lowest. Each member
    points to the last suffix before it in a lower group; such a suffix moves up to a new group behind what is left of its
    own, the farther the more members point to it, and its Lyndon prefix grows by theirs.
    """
    n = len(ranks)
    count = [0] * n
    members: list[list[int]] = [[] for _ in range(n)]
    length = [1] * n
    below, first = 0, []
    for c in np.bincount(ranks).tolist() if n else []:
        first.append(below)
        below += c
    group = [first[r] for r in ranks]
    for i, g in enumerate(group):
        members[g].append(i)
        count[g] += 1
    before = [-1] * n
    for g in range(n - 1, -1, -1):
        if not count[g]:
            continue
        times: dict[int, int] = {}
        for i in sorted(i for i in members[g] if group[i] == g):  # the others have moved up
            p = i - 1
            while p >= 0 and group[p] >= g:
                p = before[p]
            before[i] = p
            if p >= 0:
                times[p] = times.get(p, 0) + 1
        members[g] = []
        by_times: dict[int, dict[int, list[int]]] = {}
        for p, k in times.items():
            by_times.setdefault(k, {}).setdefault(group[p], []).append(p)
        own = length[g]
        for k in sorted(by_times, reverse=True):
            for old, moved in by_times[k].items():
                count[old] -= len(moved)
                new = old + count[old]
                longer = length[old] + k * own
                for p in moved:
                    group[p] = new
                count[new], members[new], length[new] = len(moved), moved, longer
    return [length[g] for g in group]


def common(raw: bytes, a: int, b: int, n: int, back: bool = False) -> int:
    """How many of at most ``n`` equal 4-byte ranks follow places ``a`` and ``b``, or precede them: blocks double until one
    differs, which is then halved."""

    def equal(lo: int, hi: int) -> bool:
        if back:
            return raw[4 * (a - hi) : 4 * (a - lo)] == raw[4 * (b - hi) : 4 * (b - lo)]
        return raw[4 * (a + lo) : 4 * (a + hi)] == raw[4 * (b + lo) : 4 * (b + hi)]

    done, size = 0, 8
    while done < n:
        end = min(done + size, n)
        if not equal(done, end):
            while end - done > 1:
                mid = (done + end) // 2
                if equal(done, mid):
                    done = mid
                else:
                    end = mid
            return done
        done, size = end, size * 2
    return done


def runs_of(codes: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a sequence of numbers, by start, then period."""
    _, ranks = np.unique(codes, return_inverse=True)
    n, top = len(ranks), int(ranks.max(initial=0))
    raw, found = ranks.astype("<u4").tobytes(), set()
    for order in (ranks, top - ranks):
        roots = np.array(lyndon_array(order.tolist()), np.int64)
        # a run's first root has two more after it: both ends of what they share are looked at first
        at = np.flatnonzero(np.arange(n) + 3 * roots <= n)
        p = roots[at]
        at = at[(ranks[at] == ranks[at + p]) & (ranks[at + 2 * p - 1] == ranks[at + 3 * p - 1])]
        reach: dict[int, int] = {}
        for i, q in zip(at.tolist(), roots[at].tolist(), strict=True):
            if i + q <= reach.get(q, 0):
                continue
            right = common(raw, i, i + q, n - i - q)
            if right < 2 * q:
                continue
            left = common(raw, i, i + q, i, back=True)
            reach[q] = i + q + right
            if left + q + right >= max(LEAST_LENGTH, LEAST_PERIODS * q):
                found.add((i - left, left + q + right, q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def stretches(words: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of words (their hashes, and the text of each) that can hold a run."""
    n = len(words)
    if n < LEAST_LENGTH:
        return []
    with np.errstate(over="ignore"):
        gram = np.zeros(n - GRAM + 1, np.uint64)
        for k in range(GRAM):
            gram = gram * np.uint64(0x9E3779B97F4A7C15) + (words[k : k + len(gram)] ^ (words[k : k + len(gram)] >> np.uint64(29)))
    whole = np.flatnonzero(doc[: len(gram)] == doc[GRAM - 1 :])
    order = whole[np.lexsort((whole, gram[whole], doc[whole]))]
    same = (gram[order[1:]] == gram[order[:-1]]) & (doc[order[1:]] == doc[order[:-1]])
    away = np.where(same, order[1:] - order[:-1], n)
    near = np.full(n, n, np.int64)
    if len(order):
        near[order] = np.minimum(np.append(away, n), np.append(n, away))
    found: list[tuple[int, int]] = []
    limit = np.full(n, n - 1, np.int64)
    for _ in range(8):
        hit = np.flatnonzero(near <= limit)
        covered = np.zeros(n + 1, np.int64)
        np.add.at(covered, hit, 1)
        np.add.at(covered, hit + GRAM, -1)
        on = np.cumsum(covered)[:n] > 0
        cut = np.append(True, doc[1:] != doc[:-1])
        edge = np.flatnonzero(np.append(np.append(True, (on[1:] != on[:-1]) | cut[1:]), True))
        size = np.diff(edge)
        keep = on[edge[:-1]] & (size >= LEAST_LENGTH)
        new = list(zip(edge[:-1][keep].tolist(), edge[1:][keep].tolist(), strict=True))
        if new == found:
            break
        found, limit = new, np.full(n, -1, np.int64)
        for a, b in found:
            limit[a : b - GRAM + 1] = (b - a) // LEAST_PERIODS
    return found


def _collapsed(data: np.ndarray, start: np.ndarray, end: np.ndarray, keep: np.ndarray) -> bytes:
    """The kept words, one space between them; PIECE words are Python objects at a time."""
    parts = []
    for a in range(0, len(start), PIECE):
        b = min(a + PIECE, len(start))
        part = b" ".join(compress(data[start[a] : end[b - 1]].tobytes().split(), keep[a:b].tolist()))
        if part:
            parts.append(part)
    return b" ".join(parts)


def _finder() -> Callable[[pa.Array], pa.Array]:
    def find(texts: pa.Array) -> pa.Array:
        w = words_of(texts)
        first = np.searchsorted(w.doc, np.arange(len(texts) + 1))
        runs: list[list[tuple[int, int, int]]] = [[] for _ in range(len(texts))]
        keep = np.ones(len(w.doc), bool)
        for a, b in stretches(w.hash, w.doc):
            of = int(w.doc[a])
            for start, length, period in runs_of(w.hash[a:b]):
                runs[of].append((a + start - int(first[of]), length, period))
                keep[a + start + period : a + start + length] = False
        flat = [r for of in runs for r in sorted(of, key=lambda r: (r[0], r[2]))]
        offsets = pa.array(np.cumsum([0, *map(len, runs)]), pa.int32())
        values = pa.StructArray.from_arrays([pa.array([r[i] for r in flat], pa.int64()) for i in range(3)], names=["start", "length", "period"])
        texts_ = [_collapsed(w.data, w.start[a:b], w.end[a:b], keep[a:b]).decode() for a, b in zip(first[:-1], first[1:], strict=True)]
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(offsets, values), pa.array(texts_, pa.string())], names=["runs", "collapsed"])

    return find


def with_runs(docs: DataFrame, text: str | Column = "text", runs: str = "runs", collapsed: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of ``text`` (start, length, period, in words) and the text without the repetitions: each
    word in a run after the run's first period is dropped, the others are joined by one space.

    A null or empty text has no runs and an empty collapsed text. Columns of the given names are replaced."""
    own = docs.withColumn("_tg_runs", text_udf(_finder, RETURNS)(text))
    return own.withColumns({runs: F.col("_tg_runs.runs"), collapsed: F.col("_tg_runs.collapsed")}).drop("_tg_runs")


def repeated_tail() -> Column:
    """The text of ``documents``; every tenth one, by the CRC of its doc_id, ends in a repeated stretch of its words."""
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    words = F.regexp_extract_all(F.col("text"), F.lit("([^\\x20\\x09-\\x0D]+)"), F.lit(1))
    n, g = F.size(words), F.floor(h / 10)
    a = (g % n).cast("int")
    p = (F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))).cast("int")
    block = F.slice(words, a + 1, F.least(p, n - a))
    tail = F.flatten(F.array_repeat(block, F.ceil((n - a) / p).cast("int")))
    made = F.array_join(F.slice(F.concat(F.slice(words, F.lit(1), a), tail), F.lit(1), n), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(F.col("text"))


def op12_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Runs of every document, some given a repeated tail."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", repeated_tail().alias("text"))
    found = with_runs(docs)
    found = found.withColumn("best", F.array_min(F.transform("runs", lambda r: F.struct((-r["length"]).alias("less"), r["start"].alias("start"), r["period"].alias("period")))))
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    length, period = -F.col("best.less"), F.col("best.period")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        F.col("best.start").alias("start"),
        length.alias("length"),
        period.alias("period"),
        F.floor(length * 1000 / period).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
