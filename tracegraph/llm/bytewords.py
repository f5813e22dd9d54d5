"""Words of UTF-8 text as numpy arrays: no Python object is made per word.

A word is a maximal run of bytes outside a separator class; every separator used here is ASCII, so no character is cut.
A word's 64-bit hash depends on its bytes (A-Z folded when asked) and length alone and is the same in every process.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

#: Separators of ``[^\x20\x09-\x0D]+``.
SPACES = np.isin(np.arange(256), [0x20, *range(0x09, 0x0E)])
#: Separators of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` once A-Z are folded.
NOT_ALNUM = np.array([c < 0x80 and not chr(c).isalnum() for c in range(256)])

FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32

#: Bytes hashed at a time; the temporaries take about forty times this.
SLICE = 1 << 21

_MULT = np.uint64(0x9E3779B97F4A7C15)
_rng = np.random.Generator(np.random.PCG64(20240229))
_TABLE = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers = np.ones(1, np.uint64)


def _power_table(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        m = max(n, 256)
        with np.errstate(over="ignore"):
            _powers = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(m, np.uint64(0xD6E8FEB86659FD93))]))
    return _powers


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every input bit."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


@dataclass
class Words:
    """The words of several texts, in order: word i is ``data[start[i]:end[i]]`` and belongs to text ``doc[i]``."""

    data: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    hash: np.ndarray

    def per_doc(self, n: int) -> np.ndarray:
        return np.bincount(self.doc, minlength=n)


def string_buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the n + 1 offsets; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = texts.fill_null("" if not pa.types.is_binary(texts.type) else b"")
    big = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, offsets, data = texts.buffers()
    offsets = np.frombuffer(offsets, np.int64 if big else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    first = offsets[0] if len(offsets) else 0
    return data[first : offsets[-1] if len(offsets) else 0], offsets - first


def _spans(sep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.flatnonzero(np.diff(np.concatenate([[True], sep, [True]]).astype(np.int8)))
    return edge[::2], edge[1::2]


def words_of(texts: pa.Array, separators: np.ndarray = SPACES, fold: bool = False) -> Words:
    """All words of all texts. Texts are told apart even without a separator between them."""
    data, offsets = string_buffers(texts)
    starts, ends, hashes = [], [], []
    lo = 0
    while lo < len(data):
        hi = min(lo + SLICE, len(data))
        if hi < len(data):  # cut between words
            for reach in (4096, SLICE, None):
                ahead = np.flatnonzero(separators[data[hi : hi + reach if reach else None]])
                if len(ahead):
                    break
            hi = hi + int(ahead[0]) if len(ahead) else len(data)
        piece = data[lo:hi]
        sep = separators[piece]
        inner = np.unique(offsets[(offsets > lo) & (offsets < hi)]) - lo
        s, e = _spans(sep)
        if len(inner) and len(s):
            inner = inner[~sep[inner] & ~sep[inner - 1]]  # a text ends inside a run of word bytes
            if len(inner):
                s, e = np.sort(np.concatenate([s, inner])), np.sort(np.concatenate([e, inner]))
        if len(s):
            starts.append(s + lo)
            ends.append(e + lo)
            hashes.append(span_hashes(piece, s, e, fold))
        lo = hi
    start = np.concatenate(starts) if starts else np.zeros(0, np.int64)
    end = np.concatenate(ends) if ends else np.zeros(0, np.int64)
    h = np.concatenate(hashes) if hashes else np.zeros(0, np.uint64)
    doc = np.searchsorted(offsets, start, side="right") - 1
    return Words(data, start, end, doc, h)


def span_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, fold: bool = False) -> np.ndarray:
    """Hash of each span ``data[start:end]``; spans are not empty and do not overlap."""
    n = end - start
    at = np.concatenate([[0], np.cumsum(n)])
    index = np.arange(at[-1]) - np.repeat(at[:-1], n)
    b = data[index + np.repeat(start, n)]
    if fold:
        b = FOLD[b]
    with np.errstate(over="ignore"):
        h = np.add.reduceat(_TABLE[b] * _power_table(int(n.max()))[index], at[:-1])
        return mix(h + n.astype(np.uint64) * _MULT)


def hash_words(words: list[bytes]) -> np.ndarray:
    """The hashes ``words_of`` gives to these words (each not empty)."""
    if not words:
        return np.zeros(0, np.uint64)
    n = np.array([len(w) for w in words])
    end = np.cumsum(n)
    return span_hashes(np.frombuffer(b"".join(words), np.uint8), end - n, end)


def slices(batch: pa.RecordBatch, column: str = "text", limit: int = 4 * SLICE) -> Iterator[pa.RecordBatch]:
    """The batch in runs of rows of about ``limit`` bytes of text; a longer text is a run of its own."""
    _, offsets = string_buffers(batch.column(batch.schema.get_field_index(column)))
    lo = 0
    while lo < batch.num_rows:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + limit, side="right")) - 1)
        yield batch.slice(lo, hi - lo)
        lo = hi


def shingle_hashes(h: np.ndarray, doc: np.ndarray, n_docs: int, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words and each run's text; a text of fewer words, but not none, is one run."""
    count = np.bincount(doc, minlength=n_docs)
    first = np.concatenate([[0], np.cumsum(count)])[:-1]
    with np.errstate(over="ignore"):
        acc = np.zeros(max(0, len(h) - width + 1), np.uint64)
        if len(acc):
            for k in range(width):
                acc = acc * _MULT + h[k : k + len(acc)]
        whole = doc[: len(acc)] == doc[width - 1 :][: len(acc)] if len(acc) else np.zeros(0, bool)
        out, of = acc[whole], doc[: len(acc)][whole]
        few = np.flatnonzero((count > 0) & (count < width))
        if len(few):
            short = np.zeros(len(few), np.uint64)
            for k in range(width - 1):
                has = count[few] > k
                short[has] = short[has] * _MULT + h[first[few[has]] + k]
            out, of = np.concatenate([out, short]), np.concatenate([of, few])
            order = np.argsort(of, kind="stable")
            out, of = out[order], of[order]
    return mix(out), of


def release() -> None:
    """Gives a Python worker's free memory back to the machine: workers outlive their tasks and are many."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def text_udf(make: Callable[[], Callable[[pa.Array], pa.Array]], returns: str, limit: int = SLICE):
    """A column function of a text column. ``make`` is called once in each task and gives a function from texts to as
    many values of type ``returns``; it gets about ``limit`` bytes at a time, a longer text by itself. Only the texts go
    to Python and only the values come back: whatever else a row has stays in Spark, under any name."""

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        f = make()
        for texts in batches:
            out = [f(part.column(0)) for part in slices(pa.RecordBatch.from_arrays([texts], names=["text"]), limit=limit)]
            yield pa.concat_arrays(out or [f(texts)])
        release()

    return F.arrow_udf(run, returns)
