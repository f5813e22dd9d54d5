"""Quality rules: plain counts of a text, and its n-gram perplexity under a modified Kneser-Ney model.

The model predicts each byte of each word (``[^\\x20\\x09-\\x0D]+``) and the space after it from up to ORDER - 1 bytes
before it in the text, across words, which are one space apart. Spark counts the n-grams of all texts, takes continuation
counts, discounts and contexts' weights from them, and keeps the probability of every counted n-gram in a table. Those
with at least RARE of all occurrences (never more than 1 / RARE) are broadcast; all others are looked up by a join.

A text's log-perplexity is the mean over all its bytes in words and their ends. Each language has a band around its
median, BAND times the scaled median absolute deviation to either side and wider for short texts; texts outside, above
or below, are rejected. Texts that fail the plain rules are rejected before. Texts with a null language form a group.
A null or empty text has no words, fails the plain rules and has no perplexity.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import SLICE, SPACES, Words, mix, release, shingle_hashes, slices, string_buffers, words_of
from tracegraph.store import saved

ORDER = 5
RARE = 2.0**-22
#: Half-width of a band in scaled deviations, chosen on labels (README), and the number of words at which it is sqrt(2) as wide.
BAND, SHORT = 2.25, 60
MIN_WORDS, MAX_REPEAT_PERCENT = 10, 20
#: Languages up to which their bands, a row each, are broadcast; beyond, the join is shuffled.
BROADCAST_LANGUAGES = 10_000

_NEWLINE = np.arange(256) == 10
_SYMBOL = np.isin(np.arange(256), list(b"#*$%&|<>"))
_NOT_TAIL = (np.arange(256) & 0xC0) != 0x80


def _marked(data: np.ndarray, table: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """How many bytes of each span are in ``table``."""
    total = np.concatenate([[0], np.cumsum(table[data], dtype=np.int64)])
    return total[end] - total[start]


def rule_counts(texts: pa.Array) -> tuple[Words, dict[str, np.ndarray]]:
    """The words, and n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(texts)
    data, offsets = string_buffers(texts)
    words = words_of(texts)
    lines = words_of(texts, _NEWLINE)
    worded = _marked(lines.data, ~SPACES, lines.start, lines.end) > 0
    own = mix(lines.hash ^ mix(lines.doc.astype(np.uint64)))[worded]
    line_doc = lines.doc[worded]
    _, first = np.unique(own, return_index=True)
    dup = np.bincount(line_doc, minlength=n) - np.bincount(line_doc[first], minlength=n)
    sh, of = shingle_hashes(words.hash, words.doc, n, 5)
    count = words.per_doc(n)
    enough = count[of] >= 5
    sh, of = sh[enough], of[enough]
    repeat = np.zeros(n, np.int64)
    if len(sh):
        key = mix(sh ^ mix(of.astype(np.uint64) + np.uint64(7)))
        order = np.argsort(key, kind="stable")
        same = np.flatnonzero(key[order[1:]] == key[order[:-1]])
        twice = np.zeros(len(sh), bool)
        twice[order[same]] = twice[order[same + 1]] = True
        # window w of its text begins at the text's word w
        base = np.concatenate([[0], np.cumsum(count)])[:-1]
        windows = np.concatenate([[0], np.cumsum(np.where(count >= 5, count - 4, 0))])[:-1]
        at = (np.arange(len(sh)) - windows[of] + base[of])[twice]
        edge = np.zeros(len(words.hash) + 1, np.int64)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + 5, -1)
        repeat = np.bincount(words.doc[np.cumsum(edge)[:-1] > 0], minlength=n)
    chars = np.bincount(words.doc, weights=_marked(words.data, _NOT_TAIL, words.start, words.end), minlength=n).astype(np.int64)
    return words, {
        "n_words": count,
        "word_chars": chars,
        "n_symbols": _marked(data, _SYMBOL, offsets[:-1], offsets[1:]),
        "n_dup_lines": dup,
        "n_repeat_words": repeat,
    }


def grams(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, key) of the longest n-gram at every byte of each word and at the space after it, across words.

    A key has the n-gram's bytes, the last one lowest, and its length in the top byte; the first byte of an n-gram
    shorter than ORDER is the space before the text.
    """
    n = words.end - words.start + 1
    ends = np.cumsum(n)
    s = np.full(int(ends[-1]) if len(n) else 0, 32, np.uint64)
    body = np.ones(len(s), bool)
    body[ends - 1] = False
    word = np.repeat(np.arange(len(n)), n)[body]
    s[body] = words.data[np.flatnonzero(body) - (ends - n)[word] + words.start[word]]
    of = np.repeat(words.doc, n)
    first = np.searchsorted(of, of, side="left") if len(of) else of
    place = np.arange(len(of)) - first
    size = np.minimum(place + 2, ORDER)
    key = s.copy()
    for k in range(1, ORDER):
        back = np.full(len(of), 32, np.uint64)
        back[k:] = np.where(place[k:] >= k, s[: len(s) - k], np.uint64(32))
        key |= np.where(size > k, back << np.uint64(8 * k), np.uint64(0))
    return of, key | (size.astype(np.uint64) << np.uint64(56))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys: list = [np.zeros(0, np.uint64)]
    counts: list = [np.zeros(0, np.int64)]

    def merge() -> None:
        every, inverse = np.unique(np.concatenate(keys), return_inverse=True)
        counts[:] = [np.bincount(inverse, weights=np.concatenate(counts), minlength=len(every)).astype(np.int64)]
        keys[:] = [every]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(keys[0].view(np.int64)), pa.array(counts[0])], names=["gram", "n"])

    for b in batches:
        for part in slices(b, limit=SLICE):
            key, n = np.unique(grams(words_of(part.column("text")))[1], return_counts=True)
            keys.append(key)
            counts.append(n)
            if sum(map(len, keys)) > 4_000_000:
                merge()
                if len(keys[0]) > 2_000_000:
                    yield batch()
                    keys[:], counts[:] = [keys[0][:0]], [counts[0][:0]]
    merge()
    yield batch()
    release()


def _last(gram: Column, size: int) -> Column:
    """The last ``size`` bytes of n-grams."""
    return gram.bitwiseAND(F.lit((1 << (8 * size)) - 1)).bitwiseOR(F.lit(size << 56))


def _context(gram: Column, size: int) -> Column:
    """n-grams of ``size`` bytes without their last byte."""
    return F.shiftright(gram.bitwiseAND(F.lit((1 << (8 * size)) - 1)), 8).bitwiseOR(F.lit((size - 1) << 56))


@dataclass
class Model:
    """For each order the table of its n-grams (gram, p), with their interpolated probabilities, and that of its contexts
    (ctx, rest), with the weight of what is shorter; the frequent n-grams' keys, sorted, and log-probabilities."""

    levels: list[DataFrame]
    contexts: list[DataFrame]
    keys: np.ndarray
    log_p: np.ndarray

    def scored(self, grams: DataFrame) -> DataFrame:
        """(gram, log_p) of distinct n-grams (gram), counted or not."""
        known = self.levels[0]
        for level in self.levels[1:]:
            known = known.unionAll(level)
        found = saved(grams.select("gram").join(known, "gram", "left"), "found")
        new = found.where("p is null").select("gram")
        if new.isEmpty():
            return found.select("gram", F.log("p").alias("log_p"))
        new = new.withColumn("p", F.lit(1 / 256))
        size = F.shiftrightunsigned("gram", 56)
        for k, (level, contexts) in enumerate(zip(self.levels, self.contexts, strict=True), 1):
            new = new.withColumn("_g", F.when(size >= k, _last(F.col("gram"), k))).withColumn("_c", F.when(size >= k, _context(F.col("_g"), k)))
            new = new.join(level.select(F.col("gram").alias("_g"), F.col("p").alias("_p")), "_g", "left").join(contexts.withColumnRenamed("ctx", "_c"), "_c", "left")
            new = saved(new.select("gram", F.coalesce("_p", F.col("rest") * F.col("p"), "p").alias("p")), "new")
        return found.where("p is not null").unionAll(new).select("gram", F.log("p").alias("log_p"))

    def log_probabilities(self, key: np.ndarray) -> np.ndarray:
        """Natural logarithms of the probabilities of the last bytes of some n-grams ``key``, looked up in the tables."""
        spark = self.levels[0].sparkSession
        distinct, inverse = np.unique(key.view(np.int64), return_inverse=True)
        got = self.scored(spark.createDataFrame([(int(g),) for g in distinct], "gram long")).toArrow().sort_by("gram")
        return got.column("log_p").to_numpy()[inverse]


def train(texts: DataFrame) -> Model:
    """Modified Kneser-Ney over the words of ``texts`` (text)."""
    counted = texts.select("text").mapInArrow(_count_grams, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))
    counted = saved(counted, "grams")
    size = F.shiftrightunsigned("gram", 56)
    parts, above = [], None
    for k in range(ORDER, 0, -1):
        level = counted.where(size == k)
        if above is not None:  # how many bytes stand before it; a text's beginning keeps its counts
            level = level.union(above.groupBy(_last(F.col("gram"), k).alias("gram")).agg(F.count(F.lit(1)).alias("n")))
            level = level.groupBy("gram").agg(F.sum("n").alias("n"))
        level = saved(level, f"level{k}")
        got = level.agg(*(F.count_if(F.col("n") == j) for j in (1, 2, 3, 4))).first()
        n1, n2, n3, n4 = (x or 0 for x in got)
        y = n1 / (n1 + 2 * n2) if n1 else 0.0
        d = [max(0.0, min(float(j), j - (j + 1) * y * b / a)) if a else 0.5 * j for j, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        discount = F.when(F.col("n") == 1, d[0]).when(F.col("n") == 2, d[1]).otherwise(d[2])
        level = level.select("gram", _context(F.col("gram"), k).alias("ctx"), (F.col("n") - discount).alias("kept"), "n")
        contexts = saved(level.groupBy("ctx").agg(F.sum("n").alias("total"), F.sum("kept").alias("kept")), f"contexts{k}")
        parts.append((level, contexts))
        above = level
    levels, contexts = [], []
    for k, (level, ctx) in enumerate(reversed(parts), 1):
        ctx = ctx.select("ctx", "total", (1 - F.col("kept") / F.col("total")).alias("rest"))
        own = level.join(ctx, "ctx").select("gram", (F.col("kept") / F.col("total")).alias("p"), "rest", _last(F.col("gram"), k - 1).alias("_g"))
        shorter = own.withColumn("below", F.lit(1 / 256)) if k == 1 else own.join(levels[-1].select(F.col("gram").alias("_g"), F.col("p").alias("below")), "_g")
        levels.append(saved(shorter.select("gram", (F.col("p") + F.col("rest") * F.col("below")).alias("p")), f"order{k}"))
        contexts.append(ctx.select("ctx", "rest"))
    model = Model(levels, contexts, np.zeros(0, np.uint64), np.zeros(0))
    total = counted.agg(F.sum("n")).first()[0] or 0
    often = model.scored(counted.where(F.col("n") >= RARE * total)).toArrow()
    keys = often.column("gram").to_numpy().view(np.uint64)
    order = np.argsort(keys)
    model.keys, model.log_p = keys[order], often.column("log_p").to_numpy()[order].astype(np.float64)
    return model


def measured(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, log_ppl) of every document; log_ppl is
    null without words."""
    shared = docs.sparkSession.sparkContext.broadcast((model.keys, model.log_p))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, log_p = shared.value
        for batch in batches:
            for part in slices(batch, limit=SLICE):
                n = part.num_rows
                words, counts = rule_counts(part.column("text"))
                of, key = grams(words)
                distinct, inverse = np.unique(key, return_inverse=True)
                at = np.searchsorted(keys, distinct)
                at[at == len(keys)] = 0
                hit = keys[at] == distinct if len(keys) else np.zeros(len(distinct), bool)
                value = np.where(hit, log_p[at], 0.0) if len(keys) else np.zeros(len(distinct))
                total = np.bincount(of, weights=value[inverse], minlength=n).astype(np.float64)
                cold = ~hit[inverse]
                cut = np.concatenate([[0], np.cumsum(np.bincount(of[cold], minlength=n))])
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("row"), part.column("doc_id"), part.column("lang"), *(pa.array(counts[c].astype(np.int64)) for c in names),
                        pa.array(total), pa.array(np.bincount(of, minlength=n)), pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(key[cold].view(np.int64))),
                    ],
                    names=["row", "doc_id", "lang", *names, "total", "steps", "cold"],
                )
        release()

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "lang", "text")
    rows = numbered.mapInArrow(run, f"row long, doc_id long, lang string, {', '.join(f'{c} long' for c in names)}, total double, steps long, cold array<long>")
    rows = saved(rows, "rows")
    cold = rows.select("row", F.explode("cold").alias("gram"))
    # an n-gram that is not in the arrays has fewer occurrences than they ask for: no key is hot
    more = cold.join(model.scored(cold.select("gram").distinct()), "gram").groupBy("row").agg(F.sum("log_p").alias("more"))
    total = F.col("total") + F.coalesce("more", F.lit(0.0))
    return rows.drop("cold").join(more, "row", "left").select("doc_id", "lang", *names, F.when(F.col("steps") > 0, -total / F.col("steps")).alias("log_ppl"))


def judged(rows: DataFrame, band: float = BAND) -> DataFrame:
    """``measured`` rows, written down, with base_failed, lower, upper (the band of the language) and kept."""
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    rows = rows.withColumn("base_failed", failed).withColumn("_lang", F.when(F.col("lang").isNull(), "n").otherwise(F.concat(F.lit("s"), F.col("lang"))))
    good = rows.where("not base_failed and log_ppl is not null")
    middle = saved(good.groupBy("_lang").agg(F.percentile_approx("log_ppl", 0.5, 10_000).alias("middle")), "middle")
    few = middle.count() <= BROADCAST_LANGUAGES
    joined = lambda a, b, how="inner": a.join(F.broadcast(b) if few else b, "_lang", how)
    # null without words: a division by zero is an error
    wide = F.when(F.col("n_words") > 0, F.sqrt(1 + F.lit(float(SHORT)) / F.col("n_words")))
    away = F.abs(F.col("log_ppl") - F.col("middle")) / wide
    spread = joined(good, middle).groupBy("_lang").agg((1.4826 * F.percentile_approx(away, 0.5, 10_000)).alias("spread"), F.first("middle").alias("middle"))
    half = band * F.col("spread") * wide
    out = joined(rows, saved(spread, "spread"), "left").withColumn("lower", F.col("middle") - half).withColumn("upper", F.col("middle") + half)
    inside = F.coalesce(F.col("log_ppl").between(F.col("lower"), F.col("upper")), F.lit(True))
    return out.withColumn("kept", ~F.col("base_failed") & inside).drop("_lang", "middle", "spread")


def op7_quality_rules(spark, sf_dir: str) -> DataFrame:
    """Every document's counts and verdict."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return judged(saved(measured(docs, train(docs)), "measured")).drop("lang")


OP7_SQL = None
