"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

A window is WINDOW consecutive words of an item; an item of fewer words, but not none, is one window. Training texts
are streamed through the automaton, which tracks the longest match that ends at each word; a word inside any occurrence
of a window is hit. Automata are flat arrays, broadcast: at most 30 bytes for each word of the items. Their size is
bounded: each is built from about SHARD_CHARS characters of items, a pass over the texts has as many automata as
PASS_CHARS allow (some 100 MB in a worker), and where that is not all, the texts pass again, written down in between.

A null text has no words. Items without words are no items; an item with a null id marks words as hit, but has no name.
Repeated rows are each answered; columns beside doc_id and text stay in Spark and are passed through by ``remove_spans``.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import NOT_ALNUM, Words, text_udf, words_of
from tracegraph.store import saved

WINDOW = 10
#: Characters of items in one automaton, and in those of one pass.
SHARD_CHARS, PASS_CHARS = 2_000_000, 16_000_000
#: A text with more than this share of its words hit is removed whole.
MAX_COVERAGE = 0.5


class _Builder:
    """The states of a suffix automaton while items are added."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.len = [-1], [0]

    def _new(self, length: int, nxt: dict[int, int], link: int) -> int:
        self.len.append(length)
        self.next.append(nxt)
        self.link.append(link)
        return len(self.len) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """A copy of state q for the words no longer than those of p and c."""
        copy = self._new(self.len[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def add(self, last: int, c: int) -> int:
        q = self.next[last].get(c)
        if q is not None:
            return q if self.len[q] == self.len[last] + 1 else self._split(last, q, c)
        cur = self._new(self.len[last] + 1, {}, 0)
        p = last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = cur
            p = self.link[p]
        if p >= 0:
            q = self.next[p][c]
            self.link[cur] = q if self.len[q] == self.len[p] + 1 else self._split(p, q, c)
        return cur


def _lists(rows: list) -> tuple[array, array]:
    """Lists of numbers as one list and the places where they begin."""
    first, flat = array("i", [0]), array("i")
    for r in rows:
        flat.extend(r)
        first.append(len(flat))
    return first, flat


class Automaton:
    """Suffix automaton of several word sequences, in flat arrays; words are numbered by the place of their hash in
    ``vocabulary``. An item is (name, word hashes); a name may be None."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocabulary = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.names = sorted({name for name, _ in items if name is not None})
        place = {name: i for i, name in enumerate(self.names)}
        words = [np.searchsorted(self.vocabulary, h).tolist() for _, h in items]
        states = _Builder()
        for w in words:
            last = 0
            for c in w:
                last = states.add(last, c)
        n = len(states.len)
        self.link, self.len = array("i", states.link), array("i", states.len)
        #: Of each state, the words that lead on, sorted, and where to.
        order = [sorted(nxt.items()) for nxt in states.next]
        self.first, self.word = _lists([[c for c, _ in o] for o in order])
        self.to = _lists([[v for _, v in o] for o in order])[1]
        del states, order
        #: For each state the ancestor that holds its suffix of window length.
        self.full = array("i", [-1]) * n
        #: Items by the state that holds one of their windows of full length; shorter items by the state that holds them.
        inside: dict[int, set[int]] = {}
        whole: dict[int, list[tuple[int, int]]] = {}
        for v in sorted(range(1, n), key=self.len.__getitem__):
            up = self.link[v]
            self.full[v] = v if self.len[up] < window <= self.len[v] else self.full[up]
        for (name, _), w in zip(items, words, strict=True):
            v, i = 0, place.get(name, -1)
            for c in w:
                v = self.step(v, c)
                if i >= 0 and self.full[v] >= 0:
                    inside.setdefault(self.full[v], set()).add(i)
            if 0 < len(w) < window:
                while self.len[self.link[v]] >= len(w):
                    v = self.link[v]
                whole.setdefault(v, []).append((len(w), i))
        self.items = {v: array("i", sorted(x)) for v, x in inside.items()}
        self.short = whole
        #: For each state the nearest one up the links that holds a shorter item, itself included.
        self.ends = array("i", [-1]) * n
        for v in sorted(range(1, n), key=self.len.__getitem__) if whole else ():
            self.ends[v] = v if v in whole else self.ends[self.link[v]]
        #: The least length of a window, and the pairs of neighbouring words that occur in an item.
        self.least = min((min(window, len(w)) for w in words), default=window)
        pairs = [np.array(w[:-1], np.int64) * len(self.vocabulary) + w[1:] for w in words if len(w) > 1]
        self.pairs = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.sieve = np.zeros(1 << 16, bool)
        self.sieve[self.vocabulary >> np.uint64(48)] = True

    def step(self, v: int, c: int) -> int:
        """The state after word c, or -1."""
        lo, hi = self.first[v], self.first[v + 1]
        k = bisect_left(self.word, c, lo, hi) if hi - lo > 1 else lo
        return self.to[k] if k < hi and self.word[k] == c else -1

    def candidate_runs(self, words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, and the runs of words outside of which no window occurs: known words, in known pairs."""
        ids = np.full(len(words.hash), -1, np.int64)
        maybe = np.flatnonzero(self.sieve[words.hash >> np.uint64(48)])
        at = np.searchsorted(self.vocabulary, words.hash[maybe])
        at[at == len(self.vocabulary)] = 0
        known = self.vocabulary[at] == words.hash[maybe] if len(self.vocabulary) else np.zeros(len(maybe), bool)
        ids[maybe[known]] = at[known]
        same = (words.doc[1:] == words.doc[:-1]) & (ids[1:] >= 0) & (ids[:-1] >= 0)
        if self.least > 1 and len(self.pairs):
            both = np.flatnonzero(same)
            key = ids[both] * len(self.vocabulary) + ids[both + 1]
            at = np.searchsorted(self.pairs, key)
            at[at == len(self.pairs)] = 0
            same[both[self.pairs[at] != key]] = False
        start = np.flatnonzero((ids >= 0) & ~np.concatenate([[False], same])) if len(ids) else np.zeros(0, np.int64)
        end = np.flatnonzero((ids >= 0) & ~np.concatenate([same, [False]])) + 1 if len(ids) else start
        long = end - start >= self.least
        return ids, start[long], end[long]

    def spans(self, ids: list[int]) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(first, last, items) of each window that occurs in this run of word numbers."""
        v = length = 0
        for i, c in enumerate(ids):
            to = self.step(v, c)
            while to < 0 and v:
                v = self.link[v]
                length = self.len[v]
                to = self.step(v, c)
            if to >= 0:
                v = to
                length += 1
            if length >= self.window:
                yield i - self.window + 1, i, self.items.get(self.full[v], ())
            end = self.ends[v]
            while end >= 0:
                for m, item in self.short[end]:
                    if m <= length:
                        yield i - m + 1, i, (item,) if item >= 0 else ()
                end = self.ends[self.link[end]]


def match_batch(automata: list[Automaton], texts: pa.Array) -> tuple[Words, np.ndarray, list[set[str]]]:
    """The words, which of them are hit, and each text's items."""
    words = words_of(texts, NOT_ALNUM, fold=True)
    edge = np.zeros(len(words.hash) + 1, np.int64)
    found: list[set[str]] = [set() for _ in range(len(texts))]
    for automaton in automata:
        ids, starts, ends = automaton.candidate_runs(words)
        for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
            for first, last, items in automaton.spans(ids[s:e].tolist()):
                edge[s + first] += 1
                edge[s + last + 1] -= 1
                found[words.doc[s]].update(automaton.names[i] for i in items)
    return words, np.cumsum(edge)[:-1] > 0, found


def item_shards(items: DataFrame, limit: int | None = None) -> Iterator[list[tuple[str | None, np.ndarray]]]:
    """The items, ``limit`` characters or so at a time (SHARD_CHARS), with the hashes of their words. Equal items are one."""
    items = items.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text")).where("text is not null").distinct()
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    shards = max(1, -(-total // (limit or SHARD_CHARS)))
    for k in range(shards):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(shards)) == k).collect()
        words = words_of(pa.array([r.text for r in rows], pa.string()), NOT_ALNUM, fold=True)
        cut = np.searchsorted(words.doc, np.arange(len(rows) + 1))
        yield [(r.item_id, words.hash[cut[i] : cut[i + 1]]) for i, r in enumerate(rows) if cut[i + 1] > cut[i]]


def _flags(words: Words, hit: np.ndarray, n: int) -> list[bytes]:
    """Each text's hits as packed bits."""
    cut = np.searchsorted(words.doc, np.arange(n + 1))
    return [np.packbits(hit[cut[i] : cut[i + 1]]).tobytes() if hit[cut[i] : cut[i + 1]].any() else b"" for i in range(n)]


_MATCH = "n_words long, hits binary, items array<string>"


def _matcher(shared) -> Callable[[], Callable[[pa.Array], pa.Array]]:
    def make() -> Callable[[pa.Array], pa.Array]:
        automata = shared.value

        def of(texts: pa.Array) -> pa.Array:
            n = len(texts)
            words, hit, found = match_batch(automata, texts)
            names = [sorted(x) for x in found]
            return pa.StructArray.from_arrays([pa.array(words.per_doc(n), pa.int64()), pa.array(_flags(words, hit, n), pa.binary()), pa.array(names, pa.list_(pa.string()))], names=["n_words", "hits", "items"])

        return of

    return make


def match(docs: DataFrame, items: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``_tg_match``, a struct of n_words, hits (binary, a bit for each word, first word first; empty: none)
    and items (array of string, those with an occurring window, sorted)."""
    spark = docs.sparkSession
    out, held, passes = docs.drop("_tg_match"), [], []
    for shard in item_shards(items):
        held.append(Automaton(shard))
        if len(held) * SHARD_CHARS >= PASS_CHARS:
            passes.append(spark.sparkContext.broadcast(held))
            held = []
    if held or not passes:
        passes.append(spark.sparkContext.broadcast(held))
    for k, shared in enumerate(passes):
        column = text_udf(_matcher(shared), _MATCH)(F.col(text))
        if not k:
            out = out.withColumn("_tg_match", column)
            continue
        out = saved(out, "matched").withColumn("_tg_more", column)
        joined = F.struct(
            F.col("_tg_match.n_words").alias("n_words"),
            text_or(F.col("_tg_match.hits"), F.col("_tg_more.hits")).alias("hits"),
            F.sort_array(F.array_union("_tg_match.items", "_tg_more.items")).alias("items"),
        )
        out = out.withColumn("_tg_match", joined).drop("_tg_more")
    return out


def text_or(a, b):
    """The bits set in either of two columns of hits."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for x, y in batches:
            yield pa.array([_either(p, q) for p, q in zip(x.to_pylist(), y.to_pylist(), strict=True)], pa.binary())

    return F.arrow_udf(run, "binary")(a, b)


def _either(a: bytes, b: bytes) -> bytes:
    if not a or not b:
        return a or b
    return (np.frombuffer(a, np.uint8) | np.frombuffer(b, np.uint8)).tobytes()


def bits(flags: Column) -> Column:
    """How many bits are set in a binary column: its hexadecimal digits without their zero bits, written out in ones."""
    digits, ones = F.hex(flags), None
    for n, set_ in ((1, "1248"), (2, "3569AC"), (3, "7BDE"), (4, "F")):
        part = F.lit(n) * (F.length(digits) - F.length(F.translate(digits, set_, "")))
        ones = part if ones is None else ones + part
    return ones.cast("long")


def digest(matched: DataFrame) -> DataFrame:
    """Counts of ``match``'s result: n_words, n_hit, n_items, items_sha256 and contaminated for each document."""
    n_hit = bits(F.col("_tg_match.hits"))
    return matched.select("doc_id", F.col("_tg_match.n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("_tg_match.items").alias("items")).select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated")
    )


def remove_spans(docs: DataFrame, items: DataFrame, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` with every hit span cut out of its text (a line end stands in for it); a text with a larger share of hit
    words than ``max_coverage`` is removed whole. Other texts are unchanged. ``n_chars``, where there is one, follows."""

    def run(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, hits in batches:
            yield pa.array([_without(t, h) if h else None for t, h in zip(texts.to_pylist(), hits.to_pylist(), strict=True)], pa.string())

    found = match(docs, items)
    hits = F.col("_tg_match.hits")
    found = found.withColumn("_tg_hit", bits(hits)).where(F.col("_tg_hit") <= max_coverage * F.col("_tg_match.n_words"))
    # only texts that lose something go to Python
    touched = F.when(F.col("_tg_hit") > 0, F.col("text"))
    found = found.withColumn("_tg_text", F.arrow_udf(run, "string")(touched, hits))
    changed = {"text": F.coalesce("_tg_text", "text")}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col("_tg_text").isNotNull(), F.length("_tg_text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType)
    return found.withColumns(changed).select(*(f"`{c}`" for c in docs.columns))


def _without(text: str, flags: bytes) -> str:
    words = words_of(pa.array([text], pa.string()), NOT_ALNUM, fold=True)
    hit = np.unpackbits(np.frombuffer(flags, np.uint8))[: len(words.start)].astype(bool)
    raw, out, at = words.data.tobytes(), [], 0
    edge = np.flatnonzero(np.diff(np.concatenate([[False], hit, [False]]).astype(np.int8)))
    for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
        out.append(raw[at : words.start[a]])
        at = int(words.end[b - 1])
    return b"\n".join([*out, raw[at:]]).decode()


def op10_benchmark_decontamination(spark, sf_dir: str) -> DataFrame:
    """Every document's words, hit words and items of ``benchmark``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return digest(match(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))


OP10_SQL = r"""
with d as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from documents),
b as (
  select cast(item_id as varchar) item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') w from benchmark),
win as (
  select distinct item_id, least(10, len(w)) m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') g
  from (select item_id, w, unnest(generate_series(1, greatest(len(w) - 9, 1))) i from b where len(w) > 0)),
sizes as (select distinct m from win),
runs as (
  select doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') g
  from (select doc_id, w, m, unnest(generate_series(1, len(w) - m + 1)) i from d, sizes where len(w) >= m)),
occ as (select r.doc_id, r.m, r.i, win.item_id from runs r join win on r.g = win.g and r.m = win.m),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + m - 1)) p from (select distinct doc_id, i, m from occ)) group by 1),
its as (select doc_id, count(*) n_items, string_agg(item_id, ',' order by item_id) s from (select distinct doc_id, item_id from occ where item_id is not null) group by 1)
select d.doc_id, cast(len(d.w) as bigint) n_words, cast(coalesce(n_hit, 0) as bigint) n_hit, cast(coalesce(n_items, 0) as bigint) n_items,
       sha256(coalesce(s, '')) items_sha256, coalesce(n_hit, 0) > 0 contaminated
from d left join hit using (doc_id) left join its using (doc_id)
"""
