"""Near-duplicate documents: an n-gram Jaccard join with Bayesian candidate pruning.

1. Every text becomes a set of five-word shingles and a MinHash signature. Texts of equal words are one class; only its
   representative (the least doc_id) goes on, with the number of its copies, under a number of its own.
2. Classes that agree on a band of the signature are candidates. A band's bucket of any size is cut into blocks, and
   each pair of blocks is a unit of work of its own. In a unit the MinHash values are compared a few at a time; a pair
   is dropped as soon as the posterior probability that it reaches the threshold falls below the tolerance (BayesLSH).
   A unit returns a spanning forest of the pairs that are left, never the pairs.
3. The forests' components hold every pair that is left. Each component is again cut into pairs of blocks, to which the
   texts are sent; there the pairs pass the same pruning and are then verified exactly on their shingle sets. A unit
   returns, for each class, how many documents it links to and a forest of the verified links.

Results are per row: its class id (the least doc_id of its connected group) and its number of links, counted over
documents, so copies count although they are never expanded. A text without words links to nothing. Rows with a null
doc_id take part like any other: they are answered with a null doc_id, and a group in which no row has an id has a null
class id. Repeated rows count as copies of each other, and so do different texts under one doc_id if their words agree.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.operators.components import hook, star_edges
from tracegraph.llm.bytewords import SLICE, mix, release, shingle_hashes, slices, words_of
from tracegraph.store import saved

WIDTH = 5
THRESHOLD = 0.8
#: Bands and rows: a pair at the threshold shares no band with probability (1 - 0.8 ** 4) ** 24, about 3e-6.
BANDS, ROWS = 24, 4
#: Posterior probability of reaching the threshold below which a candidate is dropped.
TOLERANCE = 1e-6
STEP = 8
#: Rows of a bucket's block, and words of a component's block.
BLOCK_ROWS, BLOCK_WORDS = 512, 400_000

K = BANDS * ROWS
_rng = np.random.Generator(np.random.PCG64(7))
_XOR = _rng.integers(0, 1 << 32, K, dtype=np.uint32)
_MUL = _rng.integers(0, 1 << 31, K, dtype=np.uint32) * np.uint32(2) + np.uint32(1)


def minhash(shingles: np.ndarray, of: np.ndarray, n: int) -> np.ndarray:
    """n x K least values; a text without shingles has the largest value throughout."""
    out = np.full((n, K), 0xFFFFFFFF, np.uint32)
    if not len(of):
        return out
    count = np.bincount(of, minlength=n)
    has = np.flatnonzero(count)
    at = np.concatenate([[0], np.cumsum(count[has])])
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    # a few texts at a time, so that the values stay in the processor's cache
    lo = 0
    while lo < len(has):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + 65536, side="right")) - 1)
        part, starts = x[at[lo] : at[hi]], at[lo:hi] - at[lo]
        for k in range(K):
            out[has[lo:hi], k] = np.minimum.reduceat((part ^ _XOR[k]) * _MUL[k], starts)
        lo = hi
    return out


@cache
def min_matches(threshold: float, tolerance: float) -> np.ndarray:
    """least[n]: the fewest matches among n compared values with which a pair stays a candidate (uniform prior)."""
    s = (np.arange(4000) + 0.5) / 4000
    least = np.zeros(K + 1, np.int64)
    for n in range(1, K + 1):
        for m in range(n + 1):
            log = m * np.log(s) + (n - m) * np.log1p(-s)
            p = np.exp(log - log.max())
            if p[s >= threshold].sum() / p.sum() >= tolerance:
                break
        least[n] = m
    return least


def prune(sig: np.ndarray, a: np.ndarray, b: np.ndarray, least: np.ndarray) -> np.ndarray:
    """Which of the pairs (a, b) of rows of ``sig`` are left after comparing their values step by step."""
    alive = np.arange(len(a))
    matches = np.zeros(len(a), np.int64)
    for k in range(0, K, STEP):
        matches = matches + (sig[a[alive], k : k + STEP] == sig[b[alive], k : k + STEP]).sum(1)
        stay = matches >= least[k + STEP]
        alive, matches = alive[stay], matches[stay]
        if not len(alive):
            break
    return alive


def run_pairs(key: np.ndarray, side: np.ndarray | None = None, most: int = 1 << 19) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of positions with equal keys (and, if given, unlike sides), some at a time; ``key`` is sorted."""
    n, d = len(key), 1
    left = np.arange(n)
    got: list[np.ndarray] = []
    have = 0
    while True:
        left = left[left + d < n]
        left = left[key[left] == key[left + d]]
        if not len(left):
            break
        a = left if side is None else left[side[left] != side[left + d]]
        got.append(np.stack([a, a + d]))
        have += len(a)
        if have >= most:
            yield tuple(np.concatenate(got, axis=1))
            got, have = [], 0
        d += 1
    if have:
        yield tuple(np.concatenate(got, axis=1))


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, limit=SLICE):
            n = part.num_rows
            words = words_of(part.column("text"), fold=True)
            sh, of = shingle_hashes(words.hash, words.doc, n, WIDTH)
            count = words.per_doc(n)
            key = text_keys(words.hash, words.doc, n)
            sig = minhash(sh, of, n)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in _ROW), _binary(key), pa.array(count), _binary(sig)], names=[*_ROW, "key", "n_words", "sig"])
    release()


#: What tells a row apart: whether its doc_id is null, the doc_id or else a hash of the text, and a hash of the text.
_ROW = ("no_id", "id", "text_id")


def _identified(docs: DataFrame, *columns: str) -> DataFrame:
    """``docs`` with the columns of _ROW, under these names."""
    doc_id, text = F.col("doc_id").cast("long"), F.xxhash64("text")
    return docs.withColumns(dict(zip(columns, (doc_id.isNull(), F.coalesce(doc_id, text), text), strict=True)))


def text_keys(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """n x 2 hashes of each text's sequence of words."""
    out = np.zeros((n, 2), np.uint64)
    count = np.bincount(doc, minlength=n)
    has = np.flatnonzero(count)
    if len(has):
        at = np.concatenate([[0], np.cumsum(count[has])])
        place = (np.arange(len(h)) - np.repeat(at[:-1], count[has])).astype(np.uint64)
        with np.errstate(over="ignore"):
            for j, salt in enumerate((0x51ED270B3F2C9A11, 0xA0761D6478BD642F)):
                out[has, j] = mix(np.add.reduceat(mix(h ^ mix(place + np.uint64(salt))), at[:-1]) + count[has].astype(np.uint64))
    return out


def _binary(rows: np.ndarray) -> pa.Array:
    rows = np.ascontiguousarray(rows)
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1] * rows.itemsize), len(rows), [None, pa.py_buffer(rows)]).cast(pa.binary())


def _matrix(column: pa.ChunkedArray, width: int, kind: type = np.uint32) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _band_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sig = _matrix(batch.column("sig"), K).astype(np.uint64)
        with np.errstate(over="ignore"):
            for b in range(BANDS):
                h = np.full(len(sig), b + 1, np.uint64)
                for k in range(b * ROWS, (b + 1) * ROWS):
                    h = mix(h * np.uint64(0x9E3779B97F4A7C15) + sig[:, k])
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), batch.column("cid")], names=["band", "cid"])


def _forest(table: pa.Table) -> pa.Table:
    """Bucket unit: rows (band, part, cid, sig), part 0 or 1 (unlike parts are compared), or 2 (all with all)."""
    band = table.column("band").to_numpy()
    order = np.argsort(band, kind="stable")
    band, rep, part = band[order], table.column("cid").to_numpy()[order], table.column("part").to_numpy()[order]
    sig = _matrix(table.column("sig"), K)[order]
    least = min_matches(THRESHOLD, TOLERANCE)
    root = np.arange(len(rep))
    for a, b in run_pairs(band, None if len(part) and part[0] == 2 else part):
        alive = prune(sig, a, b, least)
        hook(root, a[alive], b[alive])
    out = np.flatnonzero(root != np.arange(len(root)))
    return pa.table({"src": rep[out], "dst": rep[root[out]]})


def _verify(table: pa.Table) -> pa.Table:
    """Component unit: exact links among its texts. Rows (comp, part, cid, copies, key, text); a text that hasn't its
    class's key belongs to another row of the same id, and of several that have it one is enough."""
    comp = table.column("comp").to_numpy()
    order = np.argsort(comp, kind="stable")
    table = table.take(pa.array(order))
    keys: list[bytes] = []
    sets, sig = [], []
    for piece in slices(table.select(["text"]).combine_chunks().to_batches()[0], limit=SLICE):
        words = words_of(piece.column("text"), fold=True)
        sh, of = shingle_hashes(words.hash, words.doc, piece.num_rows, WIDTH)
        sig.append(minhash(sh, of, piece.num_rows))
        at = np.searchsorted(of, np.arange(piece.num_rows + 1))
        sets += [np.unique(sh[at[i] : at[i + 1]]) for i in range(piece.num_rows)]
        keys += [k.tobytes() for k in text_keys(words.hash, words.doc, piece.num_rows)]
    own: dict[bytes, int] = {}
    for i, (key, wanted) in enumerate(zip(keys, table.column("key").to_pylist(), strict=True)):
        if key == wanted:
            own.setdefault(key, i)
    mine = list(own.values())
    table, comp = table.drop_columns("text").take(pa.array(mine, pa.int64())), comp[order][mine]
    part, rep, copies = (table.column(c).to_numpy() for c in ("part", "cid", "copies"))
    n = len(mine)
    sets, sig = [sets[i] for i in mine], np.concatenate(sig)[mine]
    size = np.array([len(s) for s in sets])
    least = min_matches(THRESHOLD, TOLERANCE)
    links, root = np.zeros(n, np.int64), np.arange(n)
    for a, b in run_pairs(comp, None if part[0] == 2 else part):
        fits = np.minimum(size[a], size[b]) >= THRESHOLD * np.maximum(size[a], size[b]) - 1e-9
        a, b = a[fits], b[fits]
        alive = prune(sig, a, b, least)
        a, b = a[alive], b[alive]
        yes = _reach(sets, size, a, b)
        a, b = a[yes], b[yes]
        np.add.at(links, a, copies[b])
        np.add.at(links, b, copies[a])
        hook(root, a, b)
    return pa.table({"cid": rep, "links": links, "root": rep[root]})


def _reach(sets: list[np.ndarray], size: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs have an exact Jaccard similarity of at least the threshold."""
    yes = np.zeros(len(a), bool)
    order = np.argsort(a, kind="stable")
    for run in np.split(order, np.flatnonzero(np.diff(a[order])) + 1) if len(order) else []:
        mine = sets[a[run[0]]]
        theirs = np.concatenate([sets[j] for j in b[run]])
        at = np.searchsorted(mine, theirs)
        at[at == len(mine)] = 0
        ends = np.cumsum(size[b[run]])
        common = np.diff(np.concatenate([[0], np.cumsum(mine[at] == theirs)[ends - 1]]))
        yes[run] = common >= THRESHOLD * (len(mine) + size[b[run]] - common) - 1e-9
    return yes


def _units(df: DataFrame, group: str, blocks: F.Column, bundles: int) -> DataFrame:
    """Adds unit and part. A group of one block shares a unit with other small groups; one of more is sent once to each
    pair of its blocks, so that a unit never holds more than two of them."""
    own = F.pmod(F.xxhash64("cid"), F.col("blocks"))
    df = df.withColumn("blocks", blocks.cast("long")).withColumn("own", F.when(F.col("blocks") > 1, own).otherwise(F.lit(0)))
    df = df.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    return df.select(
        *(c for c in df.columns if c not in ("blocks", "own", "other")),
        F.when(F.col("blocks") == 1, F.pmod(F.xxhash64(group), F.lit(bundles))).otherwise(F.xxhash64(group, lo, hi)).alias("unit"),
        F.when(lo == hi, F.lit(2)).when(F.col("own") == lo, F.lit(0)).otherwise(F.lit(1)).alias("part"),
        (F.col("blocks") > 1).alias("cut"),
    )


def grouped(docs: DataFrame) -> DataFrame:
    """(no_id, id, text_id, n_words, group, rep, class, n_links), one row per row of ``docs`` (doc_id, text). A row is told
    apart by the first three; group is a number (null without words); rep and class are the structs (no_id, id) of the
    least row, by doc_id, with the same words and of the group; rows with an id come before those without."""
    rows = _identified(docs.select("doc_id", F.col("text").cast("string").alias("text")), *_ROW).drop("doc_id")
    kinds = "no_id boolean, id long, text_id long"
    signed = saved(rows.mapInArrow(_signatures, f"{kinds}, key binary, n_words long, sig binary"), "signed")
    classes = (
        signed.where("n_words > 0")
        .groupBy("key")
        .agg(F.min(F.struct(*_ROW)).alias("row"), F.count(F.lit(1)).alias("copies"), F.first("n_words").alias("n_words"), F.first("sig").alias("sig"))
    )
    classes = saved(classes.withColumn("cid", F.monotonically_increasing_id()), "classes")  # written down: the numbers stay

    bands = classes.select("cid", "sig").mapInArrow(_band_keys, "band long, cid long")
    shared = bands.groupBy("band").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    members = saved(bands.join(shared, "band").select("band", "cid", "size"), "members")
    n_members = members.count()
    units = _units(members, "band", F.ceil(F.col("size") / BLOCK_ROWS), max(1, n_members // (2 * BLOCK_ROWS)))
    units = units.join(classes.select("cid", "sig"), "cid")
    forest = units.groupBy("unit", "cut").applyInArrow(_forest, "src long, dst long").distinct()
    near = star_edges(saved(forest, "forest"))

    held = classes.select("cid", "key", "row", "copies", "n_words").join(near.select(F.col("nid").alias("cid"), "comp"), "cid")
    held = saved(held, "held")
    sizes = held.groupBy("comp").agg(F.sum("n_words").alias("words"))
    held = held.join(sizes, "comp").select(*(F.col(f"row.{c}").alias(c) for c in _ROW), "key", "cid", "comp", "copies", "words")
    # texts are many at any size: sorted, never held in memory; repeated rows go before they meet in a unit
    held = held.join(rows.hint("merge"), list(_ROW)).dropDuplicates([*_ROW, "cid", "text"]).drop(*_ROW)
    total = (sizes.agg(F.sum("words")).first()[0] or 0) // BLOCK_WORDS
    units = _units(held, "comp", F.ceil(F.col("words") / BLOCK_WORDS), max(1, total))
    exact = saved(units.groupBy("unit", "cut").applyInArrow(_verify, "cid long, links long, root long"), "exact")
    linked = star_edges(exact.select(F.col("cid").alias("src"), F.col("root").alias("dst")))

    rep = F.struct("row.no_id", "row.id")
    found = classes.select("cid", "key", "copies", rep.alias("rep")).join(linked.select(F.col("nid").alias("cid"), "comp"), "cid", "left")
    found = saved(found.withColumn("comp", F.coalesce("comp", "cid")), "found")
    found = found.join(found.groupBy("comp").agg(F.min("rep").alias("class")), "comp")
    found = found.join(exact.groupBy("cid").agg(F.sum("links").alias("links")), "cid", "left")
    none = F.struct("no_id", "id")
    return (
        signed.select(*_ROW, "n_words", "key")
        .join(found, "key", "left")
        .select(
            *_ROW,
            "n_words",
            F.col("comp").alias("group"),
            F.coalesce("rep", none).alias("rep"),
            F.coalesce("class", none).alias("class"),
            (F.coalesce("links", F.lit(0)) + F.coalesce(F.col("copies") - 1, F.lit(0))).alias("n_links"),
        )
    )


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, rep_id, class_id, n_links), one row per row of ``docs`` (doc_id, text).

    rep_id: the least doc_id with the same words; class_id: the least of the group joined by links; n_links: documents
    with a shingle similarity of THRESHOLD or more, copies included, itself not.
    """
    known = lambda no_id, id_: F.when(~F.col(no_id), F.col(id_))
    return grouped(docs).select(known("no_id", "id").alias("doc_id"), known("rep.no_id", "rep.id").alias("rep_id"), known("class.no_id", "class.id").alias("class_id"), "n_links")


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` without near duplicates: of each group the document with the least doc_id stays, once; of a
    group without ids one row does.

    Texts without words are no duplicates of anything and all stay, as do repeated rows of them. Rows are looked up by
    doc_id and a hash of the text, in Spark alone.
    """
    own = [f"_tg_{c}" for c in _ROW]
    first = (F.col("no_id") == F.col("class.no_id")) & (F.col("id") == F.col("class.id"))
    found = grouped(docs).where((F.col("n_words") == 0) | first).select(*(F.col(c).alias(o) for c, o in zip(_ROW, own, strict=True)), F.col("group").alias("_tg_group")).distinct()
    kept = _identified(docs, *own).join(found, own)
    # texts of a group under one id are copies, as are repeated rows
    once = kept.where("_tg_group is not null").dropDuplicates([*own[:2], "_tg_group"])
    return once.unionByName(kept.where("_tg_group is null")).select(*(f"`{c}`" for c in docs.columns))


def op1_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """Every document of ``documents`` with its class id and its number of links."""
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
