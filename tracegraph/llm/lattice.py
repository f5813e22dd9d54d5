"""Language-model scoring by a subword lattice: the marginal probability of a text over all its segmentations.

The units are the pieces of an existing vocabulary file, all single bytes, and the whole words of the training texts. A
text is read as its words (A-Z folded), each with a space before it, then an end. Its probability is the sum over all
ways to cut it into units; no unit reaches past a word, so the sum is a product over words. A word's factor sums up, by a forward
recursion in log space, the lattice of its pieces, and an arc over the whole word.

Texts come in parts, one for each language of the training texts. In a part the arc over a word has the word's discounted
share of the part's tokens (absolute discounting). Of the mass that the discounts leave, SHARED goes to the word's share
of all training tokens, discounted as well, and the rest to the pieces; all words and the end sum to one. A text's
probability is the sum over all parts of the
part's share of the training texts times the text's probability in it, over all its words, frequent or not: the marginal
over parts and segmentations. A text's own language is never looked at when it is scored.

The vocabulary's own scores give the pieces' prior weights: the piece of rank r weighs 1 / (r + 10). ROUNDS rounds of
expectation maximisation over all distinct training words, with forward-backward counts, then fit the weights; the prior
counts as PRIOR pieces, so that no piece is impossible. Words of up to LONG bytes are read many at a time; a longer one
arc by arc, which takes time (some microseconds a byte) and memory (some 20 bytes a byte) in proportion to its length.

Beside it stands a unigram base over whole words. Words' counts are those of all training texts. A word that has at
least FREQUENT of all tokens is broadcast (never more than 1 / FREQUENT words, some 30 bytes each); all others are looked
up by a join, in which no key is hot, as each has fewer occurrences than that.

Beside the score stands that of the pieces alone (``pieces_score``): each word the sum over its cuts into pieces, without
arcs over whole words and without parts; the end has its share of the training tokens, half of all where there is none.

A null text is empty: no words, only the end. Repeated rows are each scored. A row with a null doc_id is not held out, and
teaches, as in the other queries that hold documents out.
"""

from __future__ import annotations

import math
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import FOLD, hash_words, release, slices, words_of
from tracegraph.store import saved

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
ROUNDS, PRIOR = 2, 1000.0
FREQUENT = 2.0**-21
SHARED = 0.1
#: Bytes of words in one run of the recursion, length of a long word, and its arcs' beginnings at a time.
CHUNK, LONG, STRETCH = 1 << 20, 256, 1 << 14


def read_pieces(path: str = VOCABULARY) -> list[tuple[bytes, float]]:
    """Pieces as bytes, with their prior probabilities; every single byte is among them.

    The file's scores fall by one from rank to rank. Pieces with A-Z, with white space inside, or without a text of
    their own can't occur in a folded word.
    """
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    weight: dict[bytes, float] = {bytes([b]): 1e-4 for b in range(256)}
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or model.is_byte(i))]
    best = max((model.get_score(i) for i in ids), default=0.0)
    for i in ids:
        piece = model.id_to_piece(i).replace("▁", " ")
        if piece == piece.translate(_FOLD_TEXT) and " " not in piece[1:] and not any(c in piece for c in "\t\n\r\x0b\x0c"):
            raw = piece.encode()
            weight[raw] = weight.get(raw, 0.0) + 1 / (best - model.get_score(i) + 10)
    total = sum(weight.values())
    return [(p, w / total) for p, w in weight.items()]


_FOLD_TEXT = {c: c + 32 for c in range(65, 91)}


class Lattice:
    """The pieces as a tree of bytes, with log-probabilities."""

    def __init__(self, pieces: list[bytes], log_p: np.ndarray):
        self.log_p = log_p
        first = np.array([p[:1] == b" " for p in pieces])
        #: A word is one piece with a space, then others until the next space: with this factor all words sum to one.
        self.log_word = float(np.log(np.exp(log_p[first]).sum() / np.exp(log_p).sum()) - np.log(np.exp(log_p[first]).sum()))
        children: list[dict[int, int]] = [{}]
        piece = [-1]
        for k, p in enumerate(pieces):
            v = 0
            for b in p:
                if b not in children[v]:
                    children[v][b] = len(children)
                    children.append({})
                    piece.append(-1)
                v = children[v][b]
            piece[v] = k
        self.next = np.zeros((len(children), 256), np.int32)
        for v, c in enumerate(children):
            for b, u in c.items():
                self.next[v, b] = u
        self.piece = np.array(piece, np.int32)

    def forward(self, x: np.ndarray, keep: list | None = None) -> np.ndarray:
        """n x (T + 1) log-probabilities of the beginnings of the rows of x (n x T bytes)."""
        n, T = x.shape
        alpha = np.full((n, T + 1), -np.inf)
        alpha[:, 0] = 0
        for i in range(T):
            rows = np.arange(n)
            node = self.next[0, x[:, i]]
            for j in range(i + 1, T + 1):
                k = self.piece[node]
                hit = np.flatnonzero(k >= 0)
                if len(hit):
                    r, k = rows[hit], k[hit]
                    alpha[r, j] = np.logaddexp(alpha[r, j], alpha[r, i] + self.log_p[k])
                    if keep is not None:
                        keep.append((i, j, r, k))
                if j == T:
                    break
                node = self.next[node, x[rows, j]]
                on = np.flatnonzero(node)
                if not len(on):
                    break
                rows, node = rows[on], node[on]
        return alpha

    def expected(self, x: np.ndarray, weight: np.ndarray, out: np.ndarray) -> None:
        """Adds to ``out`` how often each piece is expected in the rows of x, each row counted ``weight`` times."""
        arcs: list = []
        alpha = self.forward(x, arcs)
        beta = np.full_like(alpha, -np.inf)
        beta[:, -1] = 0
        for i, j, r, k in reversed(arcs):
            beta[r, i] = np.logaddexp(beta[r, i], beta[r, j] + self.log_p[k])
        total = alpha[:, -1]
        for i, j, r, k in arcs:
            out += np.bincount(k, weights=weight[r] * np.exp(alpha[r, i] + self.log_p[k] + beta[r, j] - total[r]), minlength=len(out))


    def arcs(self, x: np.ndarray, lo: int, hi: int) -> Iterator[tuple[int, list[tuple[int, int]]]]:
        """(i, [(j, piece), ...]) for each place i from lo to hi of one word x: the pieces that reach from i to j."""
        start = np.arange(lo, hi)
        rows, node = start, self.next[0, x[lo:hi]]
        found_i, found_j, found_k = [], [], []
        size = 1
        while len(rows):
            k = self.piece[node]
            hit = k >= 0
            found_i.append(rows[hit])
            found_j.append(rows[hit] + size)
            found_k.append(k[hit])
            on = (node > 0) & (rows + size < len(x))
            rows, node = rows[on], node[on]
            node = self.next[node, x[rows + size]]
            on = node > 0
            rows, node = rows[on], node[on]
            size += 1
        i, j, k = (np.concatenate(f) for f in (found_i, found_j, found_k))
        order = np.argsort(i, kind="stable")
        cut = np.searchsorted(i[order], np.arange(lo, hi + 1)).tolist()
        pairs = list(zip(j[order].tolist(), k[order].tolist(), strict=True))
        for n in range(hi - lo):
            yield lo + n, pairs[cut[n] : cut[n + 1]]

    def forward_long(self, x: np.ndarray) -> array:
        """The log-probabilities of the beginnings of one word x, arc by arc."""
        T, p = len(x), self.log_p.tolist()
        alpha = array("d", [-math.inf]) * (T + 1)
        alpha[0] = 0.0
        for lo in range(0, T, STRETCH):
            for i, out in self.arcs(x, lo, min(T, lo + STRETCH)):
                a = alpha[i]
                for j, k in out:
                    alpha[j] = _added(alpha[j], a + p[k])
        return alpha

    def expected_long(self, x: np.ndarray, out: np.ndarray) -> None:
        """``expected`` for one long word."""
        T, p, alpha = len(x), self.log_p.tolist(), self.forward_long(x)
        beta = array("d", [-math.inf]) * (T + 1)
        beta[T] = 0.0
        for lo in range((T - 1) // STRETCH * STRETCH, -1, -STRETCH):
            for i, arcs in reversed(list(self.arcs(x, lo, min(T, lo + STRETCH)))):
                for j, k in arcs:
                    b = p[k] + beta[j]
                    beta[i] = _added(beta[i], b)
                    out[k] += math.exp(alpha[i] + b - alpha[T])


def _added(a: float, b: float) -> float:
    """log(exp(a) + exp(b))"""
    if a < b:
        a, b = b, a
    return a + math.log1p(math.exp(b - a)) if b > -math.inf else a


def spaced(words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(numbers of the words, rows of their bytes after a space) for each length, some rows at a time; a long word alone."""
    size = np.array([len(w) for w in words], np.int64)
    data = np.frombuffer(b"".join(words), np.uint8)
    start = np.cumsum(size) - size
    for length in np.unique(size).tolist():
        every = np.flatnonzero(size == length)
        for part in np.array_split(every, len(every) if length > LONG else -(-len(every) * (length + 1) // CHUNK)):
            x = np.full((len(part), length + 1), 32, np.uint8)
            x[:, 1:] = data[start[part][:, None] + np.arange(length)]
            yield part, x


def _distinct_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Distinct words of each part in a batch (part -1: texts that teach nothing), and how often its texts have them."""
    for batch in batches:
        for part in slices(batch):
            words = words_of(part.column("text"), fold=True)
            which = part.column("part").to_numpy(zero_copy_only=False)[words.doc] if len(words.doc) else np.zeros(0, np.int64)
            raw = FOLD[words.data].tobytes()
            for k in np.unique(which).tolist():
                mine = np.flatnonzero(which == k)
                _, first, count = np.unique(words.hash[mine], return_index=True, return_counts=True)
                at = mine[first]
                texts = [raw[s:e] for s, e in zip(words.start[at].tolist(), words.end[at].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.binary()), pa.array(np.full(len(at), k, np.int32)), pa.array((count if k >= 0 else count * 0).astype(np.int64))], names=["word", "part", "n"])
    release()


def fit(words: DataFrame, pieces: list[tuple[bytes, float]], rounds: int = ROUNDS) -> Lattice:
    """The lattice fitted to the distinct words in ``words`` (word, n) that have an n over 0."""
    names, prior = [p for p, _ in pieces], np.array([w for _, w in pieces])
    log_p = np.log(prior)
    spark = words.sparkSession
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast((names, log_p))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            lattice = Lattice(*shared.value)
            out = np.zeros(len(lattice.log_p))
            for batch in batches:
                for lo in range(0, batch.num_rows, 100_000):
                    b = batch.slice(lo, 100_000)
                    for _, x in spaced(b.column("word").to_pylist()):
                        if x.shape[1] > LONG + 1:
                            lattice.expected_long(x[0], out)
                        else:
                            lattice.expected(x, np.ones(len(x)), out)
            release()
            some = np.flatnonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(out[some])], names=["piece", "n"])

        got = words.where("n > 0").mapInArrow(run, "piece long, n double").groupBy("piece").agg(F.sum("n").alias("n")).collect()
        count = np.zeros(len(names))
        for r in got:
            count[r.piece] = r.n
        log_p = np.log((count + PRIOR * prior) / (count.sum() + PRIOR))
    return Lattice(names, log_p)


def score(docs: DataFrame, taught: Column, vocabulary: str = VOCABULARY) -> DataFrame:
    """(doc_id, taught, n_tokens, n_known, train_tokens, base_score, score, pieces_score) of every document; scores are log10.

    ``docs``: doc_id, text, lang. ``taught``: a condition on its columns; where it holds, the text is learnt from.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce(taught, F.lit(False)).alias("taught"))
    langs = docs.where("taught").groupBy("lang").count().orderBy(F.desc("count"), "lang").collect()
    ends = np.array([r["count"] for r in langs] or [0], float)
    parts, all_ends = len(ends), int(ends.sum())
    part = F.lit(-1)
    if langs:
        names = F.create_map(*(x for k, r in enumerate(langs) for x in (F.lit(r.lang), F.lit(k))))
        part = F.when(F.col("taught"), names[F.col("lang")]).otherwise(-1)
    counted = docs.select("text", part.alias("part")).mapInArrow(_distinct_words, "word binary, part int, n long").groupBy("word", "part").agg(F.sum("n").alias("n"))
    words = counted.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list(F.when(F.col("n") > 0, F.struct("part", "n"))).alias("by_part"))
    words = saved(words, "words")

    def masses(n: Column) -> list[Column]:
        return [F.sum(n), F.count_if(n > 0), F.count_if(n == 1), F.count_if(n == 2)]

    of_all = np.array([x or 0 for x in words.agg(*masses(F.col("n"))).first()], float)
    of_part = np.zeros((parts, 4))
    for r in words.select(F.explode("by_part").alias("p")).select("p.part", "p.n").groupBy("part").agg(*masses(F.col("n"))).collect():
        of_part[r[0]] = r[1:]

    def smoothed(stats: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Tokens, discount, and the mass that the discounts leave. Texts without a word leave none, and no texts half of
        all: other texts' words are still possible."""
        tokens = stats[..., 0] + ends
        discount = np.where(stats[..., 2] > 0, stats[..., 2] / np.maximum(stats[..., 2] + 2 * stats[..., 3], 1), 0.5)
        left = np.where(tokens > 0, discount * stats[..., 1] / np.maximum(tokens, 1), 0.5)
        return np.maximum(tokens, 1), discount, np.maximum(left, 1e-9)

    N, V = int(of_all[0]) + all_ends, int(of_all[1]) + (all_ends > 0)
    tokens, discount, left = smoothed(of_all, np.float64(all_ends))
    part_tokens, part_discount, part_left = smoothed(of_part, ends)
    lattice = fit(words.select("word", "n"), read_pieces(vocabulary))
    shared = spark.sparkContext.broadcast(lattice)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 100_000):
                b = batch.slice(lo, 100_000)
                texts, n = b.column("word").to_pylist(), b.column("n").to_numpy()
                pieces = np.zeros(len(texts))
                for which, x in spaced(texts):
                    pieces[which] = shared.value.forward_long(x[0])[-1] if x.shape[1] > LONG + 1 else shared.value.forward(x)[:, -1]
                with np.errstate(divide="ignore"):
                    pieces += shared.value.log_word
                    log_p = np.logaddexp(np.log(SHARED * np.maximum(n - discount, 0) / tokens), pieces + np.log(1 - SHARED + SHARED * left))
                by = b.column("by_part")
                size = by.value_lengths().to_numpy()
                k, m = (by.flatten().field(i).to_numpy() for i in (0, 1))
                own = np.log(np.maximum(m - part_discount[k], 0) / (part_tokens[k] * part_left[k]) + 1e-300)
                gain = np.logaddexp(0, own - np.repeat(log_p, size))
                flat = pa.StructArray.from_arrays([pa.array(k.astype(np.int32)), pa.array(gain.astype(np.float32))], names=["k", "g"])
                gains = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32()), flat)
                yield pa.RecordBatch.from_arrays([pa.array(hash_words(texts).view(np.int64)), b.column("n"), pa.array(log_p.astype(np.float32)), pa.array(pieces.astype(np.float32)), gains], names=["h", "n", "log_p", "pieces", "gains"])
        release()

    known = saved(words.mapInArrow(weigh, "h long, n long, log_p float, pieces float, gains array<struct<k:int,g:float>>"), "known")
    often = known.where(F.col("n") >= max(1, N * FREQUENT)).toArrow().sort_by("h").combine_chunks()
    gains = often.column("gains").combine_chunks() if often.num_rows else None
    flat = [gains.flatten().field(i).to_numpy() for i in (0, 1)] if gains is not None else [np.zeros(0, np.int32), np.zeros(0, np.float32)]
    first_gain = np.concatenate([[0], np.cumsum(gains.value_lengths().to_numpy())]) if gains is not None else np.zeros(1, np.int64)
    table = spark.sparkContext.broadcast((*(often.column(c).to_numpy() for c in ("h", "n", "log_p", "pieces")), first_gain, *flat))
    fixed = float(np.log10(N + 0.1 * (V + 1)))

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, counts, log_p, pieces, first_gain, gain_k, gain = table.value
        base = np.log10(counts + 0.1)
        for batch in batches:
            for b in slices(batch, limit=1 << 21):
                n = b.num_rows
                w = words_of(b.column("text"), fold=True)
                h = w.hash.view(np.int64)
                distinct, inverse = np.unique(h, return_inverse=True)
                at = np.searchsorted(keys, distinct)
                at[at == len(keys)] = 0
                hit = (keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool))[inverse]
                doc, at = w.doc[hit], at[inverse[hit]]
                of = lambda v: np.bincount(doc, weights=v, minlength=n).astype(np.float64)  # noqa: B023, E731  (of nothing it counts in integers)
                size = first_gain[at + 1] - first_gain[at] if len(at) else np.zeros(0, np.int64)
                place = np.repeat(first_gain[at] - np.cumsum(size) + size, size) + np.arange(size.sum())
                of_parts = np.bincount(np.repeat(doc, size) * parts + gain_k[place], weights=gain[place], minlength=n * parts).astype(np.float64)
                cut = np.concatenate([[0], np.cumsum(np.bincount(w.doc[~hit], minlength=n))])
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column("row"), b.column("doc_id"), b.column("taught"), pa.array(w.per_doc(n)), pa.array(np.bincount(doc[counts[at] > 0], minlength=n)),
                        pa.array(of(base[at])), pa.array(of(log_p[at])), pa.array(of(pieces[at])), pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * parts, pa.int32()), pa.array(of_parts)),
                        pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(h[~hit])),
                    ],
                    names=["row", "doc_id", "taught", "n_words", "n_known", "base", "log_p", "pieces", "by_part", "rare"],
                )
        release()

    numbered = docs.drop("lang").withColumn("row", F.monotonically_increasing_id())
    rows = numbered.mapInArrow(sums, "row long, doc_id long, taught boolean, n_words long, n_known long, base double, log_p double, pieces double, by_part array<double>, rare array<long>")
    rows = saved(rows, "rows")
    found = rows.select("row", F.explode("rare").alias("h")).join(known, "h")
    # a line for the word itself and one for each part that has it; a document's lines meet once
    none = F.struct(F.lit(-1).alias("k"), F.lit(0.0).cast("float").alias("g"))
    lines = found.select("row", "n", "log_p", "pieces", F.explode(F.concat(F.array(none), "gains")).alias("x")).select("row", "n", "log_p", "pieces", "x.k", "x.g").repartition("row")
    own = F.when(F.col("k") < 0, 1)
    lines = lines.groupBy("row", "k").agg(
        F.sum(own * (F.col("n") > 0).cast("long")).alias("known"),
        F.sum(own * F.log10(F.col("n") + 0.1)).alias("base"),
        F.sum(own * F.col("log_p").cast("double")).alias("log_p"),
        F.sum(own * F.col("pieces").cast("double")).alias("pieces"),
        F.sum(F.col("g").cast("double")).alias("g"),
    )
    rare = lines.groupBy("row").agg(
        F.sum("known").alias("r_known"),
        F.sum("base").alias("r_base"),
        F.sum("log_p").alias("r_log_p"),
        F.sum("pieces").alias("r_pieces"),
        F.map_from_entries(F.collect_list(F.when(F.col("k") >= 0, F.struct("k", "g")))).alias("r_parts"),
    )
    c = lambda x: F.coalesce(F.col(x), F.lit(0))
    # in each part: its share of the texts, its end, and for each word the mass left to all parts
    with np.errstate(divide="ignore"):
        first = np.log(ends / all_ends) + np.log(ends / part_tokens + part_left * SHARED * all_ends / tokens) if all_ends else np.log(np.array([0.5]))
    stay = np.log(part_left) if all_ends else np.zeros(1)
    constant = lambda v: F.array(*(F.lit(float(x)) for x in v))
    every = F.transform(
        F.arrays_zip("by_part", constant(first).alias("first"), constant(stay).alias("stay")),
        lambda p, k: p["by_part"] + p["first"] + p["stay"] * F.col("n_words") + F.coalesce(F.try_element_at("r_parts", k), F.lit(0.0)),
    )
    end = all_ends / N if all_ends else 0.5
    # training texts without a word leave no word a chance but this
    word = math.log(max(1 - end, 1e-9))
    last = float(np.log10(all_ends + 0.1))
    out = rows.drop("rare").join(rare, "row", "left").withColumn("every", every).withColumn("top", F.array_max("every"))
    total = F.col("top") + F.log(F.aggregate("every", F.lit(0.0), lambda s, x: s + F.exp(x - F.col("top"))))
    return out.select(
        "doc_id",
        "taught",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + c("r_known") + int(all_ends > 0)).alias("n_known"),
        F.lit(N).cast("long").alias("train_tokens"),
        (F.col("base") + c("r_base") + last - (F.col("n_words") + 1) * fixed).alias("base_score"),
        ((F.col("log_p") + c("r_log_p") + total) / math.log(10)).alias("score"),
        ((F.col("pieces") + c("r_pieces") + F.col("n_words") * word + math.log(end)) / math.log(10)).alias("pieces_score"),
    )


def op9_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every document's base and lattice scores."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(10)) == 0, F.lit(False))
    out = score(docs, ~held_out).withColumn("held_out", ~F.col("taught"))
    return out.select("doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score", "pieces_score")
