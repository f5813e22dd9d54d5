"""Quality classifier: random Fourier features of document statistics, ridge regression, isotonic calibration.

Statistics of the whole text (shares of kinds of bytes, word lengths, repetition, line shape) are standardised and sent
through FEATURES random cosines, which approximate a Gaussian kernel. Each partition sums its part of the normal
equations, for two halves of the rows (by a hash of the statistics); the sums of all partitions are added up and solved
for ridge scores. A monotone step function (isotonic regression) turns scores into probabilities; it is fitted on binned
scores that each half gets from the other's equations, so that it has not seen the rows it is fitted on. Every labelled
row takes part.

A null text is an empty one; an empty text gets a score like any other. Labels that are null teach nothing; without any
label every score is 0.5. A document with two label rows counts twice.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import mix, string_buffers, text_udf, words_of
from tracegraph.store import saved

#: Random cosines, the kernel's width in standardised units, the ridge penalty per row, and bins of the calibration.
FEATURES, WIDTH, RIDGE, BINS = 256, 4.0, 1e-4, 2000
#: Words at which a text's statistics count half.
TRUST_WORDS = 6

_KINDS = ["lower", "upper", "digit", "space", "line", "stop", "bar", "bang", "symbol", "markup", "other", "high"]
_KIND = np.full(256, _KINDS.index("other"), np.uint8)
for _name, _bytes in {
    "lower": range(97, 123), "upper": range(65, 91), "digit": range(48, 58), "space": b" \t\r\x0b\x0c", "line": b"\n", "stop": b".,;:'\"?-()",
    "bar": b"|", "bang": b"!", "symbol": b"#*$%&", "markup": b"<>{}[]=/\\_@", "high": range(128, 256),
}.items():
    _KIND[list(_bytes)] = _KINDS.index(_name)
NAMES = [
    *(f"share_{k}" for k in _KINDS),
    "log_words", "word_bytes", "word_bytes_dev", "distinct_words", "distinct_triples", "same_as_last", "words_per_line", "long_words", "odd_ends",
]


def statistics(texts: pa.Array) -> np.ndarray:
    """n x len(NAMES); all are 0 for an empty text."""
    n = len(texts)
    data, offsets = string_buffers(texts)
    size = np.diff(offsets)
    out = np.zeros((n, len(NAMES)))
    kinds = np.zeros((n, len(_KINDS)))
    for lo in range(0, len(data), 1 << 22):  # a few megabytes at a time
        part = data[lo : lo + (1 << 22)]
        first, last = np.searchsorted(offsets, [lo, lo + len(part) - 1], side="right") - 1
        cut = np.clip(offsets[first : last + 2] - lo, 0, len(part))
        code = np.repeat(np.arange(last - first + 1) * len(_KINDS), np.diff(cut)) + _KIND[part]
        kinds[first : last + 1] += np.bincount(code, minlength=(last - first + 1) * len(_KINDS)).reshape(-1, len(_KINDS))
    lines = kinds[:, _KINDS.index("line")] + 1
    out[:, : len(_KINDS)] = kinds / np.maximum(size, 1)[:, None]
    words = words_of(texts)
    count = words.per_doc(n)
    some = np.maximum(count, 1)
    length = (words.end - words.start).astype(float)
    total = np.bincount(words.doc, weights=length, minlength=n)
    square = np.bincount(words.doc, weights=length * length, minlength=n)
    mean = total / some
    own = words.hash ^ mix(words.doc.astype(np.uint64) + np.uint64(1))
    out[:, 12] = np.log1p(count)
    out[:, 13] = mean
    out[:, 14] = np.sqrt(np.maximum(square / some - mean * mean, 0))
    out[:, 15] = _distinct(own, words.doc, n) / some
    if len(own) > 2:
        with np.errstate(over="ignore"):
            triple = own[:-2] * np.uint64(3) + own[1:-1] * np.uint64(5) + own[2:] * np.uint64(7)
        inside = words.doc[:-2] == words.doc[2:]
        at = words.doc[:-2][inside]
        out[:, 16] = _distinct(mix(triple[inside]), at, n) / np.maximum(np.bincount(at, minlength=n), 1)
    same = np.flatnonzero(own[1:] == own[:-1])
    out[:, 17] = np.bincount(words.doc[same], minlength=n) / some
    out[:, 18] = np.log1p(count / lines)
    out[:, 19] = np.bincount(words.doc[length > 15], minlength=n) / some
    if len(own):
        odd = np.isin(_KIND[words.data[words.end - 1]], [_KINDS.index(k) for k in ("bar", "bang", "symbol", "markup", "other")])
        out[:, 20] = np.bincount(words.doc[odd], minlength=n) / some
    out[size == 0] = 0
    return out


def _distinct(own: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    _, first = np.unique(own, return_index=True)
    return np.bincount(doc[first], minlength=n)


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # of the cosines and the constant
    steps: tuple[np.ndarray, np.ndarray]  # calibration: ridge scores and probabilities

    def cosines(self, x: np.ndarray) -> np.ndarray:
        g = np.random.default_rng(11)
        w, b = g.standard_normal((x.shape[1], FEATURES)) / WIDTH, g.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((x - self.mean) / self.scale, -6, 6)
        z *= self.trust(x)
        return np.concatenate([np.sqrt(2 / FEATURES) * np.cos(z @ w + b), np.ones((len(x), 1))], 1)

    @staticmethod
    def trust(x: np.ndarray) -> np.ndarray:
        """Shares of a few words say little: they are drawn to the mean, the more the fewer words there are."""
        count = np.expm1(x[:, NAMES.index("log_words")])
        trust = np.repeat((count / (count + TRUST_WORDS))[:, None], x.shape[1], 1)
        trust[:, NAMES.index("log_words")] = 1
        return trust

    def ridge(self, x: np.ndarray) -> np.ndarray:
        return self.cosines(x) @ self.weights

    def scores(self, x: np.ndarray) -> np.ndarray:
        at, p = self.steps
        return np.clip(np.interp(self.ridge(x), at, p), 0, 1) if len(at) else np.full(len(x), 0.5)


def with_statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with its ``text`` replaced by ``stats``, the binary row of ``statistics``; a column of that name goes."""
    packed = lambda texts: pa.array([r.tobytes() for r in statistics(texts)], pa.binary())
    return docs.withColumn("stats", text_udf(lambda: packed, "binary")("text")).drop("text")


def _matrix(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, len(NAMES))


def _added(table: pa.Table) -> pa.Table:
    rows = np.frombuffer(b"".join(table.column("part").to_pylist()), np.float64).reshape(table.num_rows, -1)
    return pa.table({"row": table.column("row").slice(0, 1), "part": pa.array([rows.sum(0).tobytes()], pa.binary())})


def _sums(df: DataFrame, per_batch, width: int) -> np.ndarray:
    """The sum over all partitions of the matrices that ``per_batch`` makes: each partition adds up its own, then rows of
    the same number meet, sixteen partitions' worth at first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            if b.num_rows:
                m = per_batch(b)
                total = m if total is None else total + m
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int32()), pa.array([r.tobytes() for r in total], pa.binary())], names=["row", "part"])

    parts = df.mapInArrow(run, "row int, part binary").withColumn("of", F.pmod(F.spark_partition_id(), F.lit(16)))
    added = parts.groupBy("row", "of").applyInArrow(_added, "row int, part binary").groupBy("row").applyInArrow(_added, "row int, part binary")
    rows = sorted((r.row, bytes(r.part)) for r in added.collect())
    return np.frombuffer(b"".join(p for _, p in rows), np.float64).reshape(-1, width) if rows else np.zeros((0, width))


def isotonic(y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The non-decreasing values nearest to y in weighted squares (pool adjacent violators)."""
    value, weight, size = [], [], []
    for a, b in zip(y.tolist(), w.tolist(), strict=True):
        value.append(a)
        weight.append(b)
        size.append(1)
        while len(value) > 1 and value[-2] >= value[-1]:
            total = weight[-2] + weight[-1]
            value[-2] = (value[-2] * weight[-2] + value[-1] * weight[-1]) / total
            weight[-2], size[-2] = total, size[-2] + size[-1]
            del value[-1], weight[-1], size[-1]
    return np.repeat(value, size)


def train(stats: DataFrame) -> Model:
    """A model from rows (stats, label); label is 0 or 1, other values and nulls are left out."""
    rows = stats.where("label in (0, 1)").select("stats", F.col("label").cast("double").alias("label"))
    d = len(NAMES)
    moments = _sums(rows, lambda b: np.stack([(x := _matrix(b.column("stats"))).sum(0), (x * x).sum(0), np.full(d, len(x))]), d)
    empty = Model(np.zeros(d), np.ones(d), np.zeros(FEATURES + 1), (np.zeros(0), np.zeros(0)))
    if not len(moments):
        return empty
    n = moments[2, 0]
    mean = moments[0] / n
    scale = np.sqrt(np.maximum(moments[1] / n - mean * mean, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), empty.weights, empty.steps)

    def half(x: np.ndarray) -> np.ndarray:
        """False or True by a hash of the statistics."""
        with np.errstate(over="ignore"):
            return mix(np.add.reduce(np.ascontiguousarray(x).view(np.uint64), axis=1)) >> np.uint64(63) == 1

    def normal(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column("stats"))
        z, y, second = model.cosines(x), b.column("label").to_numpy(), half(x)
        own = [(z[k], y[k]) for k in (~second, second)]
        return np.concatenate([np.concatenate([u.T @ np.concatenate([u, v[:, None]], 1), np.full((1, FEATURES + 2), len(u))]) for u, v in own])

    def solved(sums: np.ndarray) -> np.ndarray:
        penalty = np.diag([*[RIDGE * sums[-1, 0]] * FEATURES, 0.0])
        return np.linalg.solve(sums[:-1, :-1] + penalty + 1e-9 * np.eye(FEATURES + 1), sums[:-1, -1])

    sums = _sums(rows, normal, FEATURES + 2).reshape(2, FEATURES + 2, FEATURES + 2)
    model.weights = solved(sums.sum(0))
    other = np.stack([solved(sums[1 - k]) if sums[1 - k, -1, 0] else model.weights for k in (0, 1)])

    def binned(b: pa.RecordBatch) -> np.ndarray:
        x = _matrix(b.column("stats"))
        score = np.where(half(x), *(model.cosines(x) @ other[k] for k in (1, 0)))
        at = np.clip(np.rint((score + 0.5) * (BINS / 2)), 0, BINS).astype(np.int64)
        return np.stack([np.bincount(at, minlength=BINS + 1), np.bincount(at, weights=b.column("label").to_numpy(), minlength=BINS + 1)]).astype(float)

    count, ones = _sums(rows, binned, BINS + 1)
    seen = np.flatnonzero(count)
    model.steps = (seen / (BINS / 2) - 0.5, isotonic(ones[seen] / count[seen], count[seen]))
    return model


def scored(stats: DataFrame, model: Model) -> DataFrame:
    """``stats`` with ``score`` in place of its statistics."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for b in batches:
            yield pa.array(model.scores(_matrix(b)))

    return stats.withColumn("score", F.arrow_udf(run, "double")("stats")).drop("stats")


def with_scores(docs: DataFrame, model: Model) -> DataFrame:
    """``docs``, all its columns, with ``quality_score``, which replaces a column of that name."""
    return docs.withColumn("quality_score", text_udf(lambda: lambda texts: pa.array(model.scores(statistics(texts))), "double")("text"))


def labelled(stats: DataFrame, labels: DataFrame) -> DataFrame:
    """(stats, label) of the documents that have a quality label."""
    return stats.join(labels.select("doc_id", F.col("quality").alias("label")).where("label is not null"), "doc_id").select("stats", "label")


def op4_quality_classifier(spark, sf_dir: str) -> DataFrame:
    """Every document's quality score."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(3)) == 1, F.lit(False))
    stats = saved(with_statistics(docs), "stats").withColumn("held_out", held_out)
    model = train(labelled(stats.where("not held_out"), spark.read.parquet(f"{sf_dir}/labels.parquet")))
    return scored(stats, model).select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
