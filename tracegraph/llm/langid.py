"""Language ID: a bidirectional gated recurrent network over bytes, trained in numpy by backpropagation through time.

The network reads the whole text byte by byte in both directions and labels every position with a distribution over
languages; a text's probabilities are the mean over all its positions. So that many positions are read at once, a text is
cut into windows of CORE bytes (at borders of characters), each read with the CONTEXT bytes before it (forwards) or after
it (backwards): every position is labelled once, with states that have read at least CONTEXT bytes of its own text on
either side, across words and lines, or all there are.

Training uses a bounded sample: about SAMPLE_DOCS labelled texts of each language, chosen by a hash of the id, and
WINDOWS windows of each, at places chosen by a hash of the text. A text that is null or has no letter is ``und`` with
score 0; without any language to learn every text is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.llm.bytewords import slices, string_buffers, text_udf

UNKNOWN = "und"
#: Texts of a language in the training sample, about; windows of each, and their bytes.
SAMPLE_DOCS, WINDOWS, TRAIN_CORE = 400, 3, 64
HIDDEN, EMBED = 12, 10
CORE, CONTEXT = 480, 32
#: Lengths to which the last windows of texts are filled up, and windows read side by side.
LENGTHS, WIDTH = (32, 64, 128, 240, CORE), 1024
#: Stands for what is before or after a text.
OUTSIDE = 256


def _sigmoid(x: np.ndarray) -> np.ndarray:
    """In place."""
    x *= np.float32(0.5)
    np.tanh(x, out=x)
    x += np.float32(1)
    x *= np.float32(0.5)
    return x


class Gru:
    """Parameters of the network and its passes. Arrays are (features x sequences), a step at a time."""

    def __init__(self, classes: int, seed: int = 1):
        g = np.random.default_rng(seed)
        r = lambda *s: (g.standard_normal(s) / np.sqrt(s[-1])).astype(np.float32)
        self.p = {"E": (0.3 * g.standard_normal((EMBED, 257))).astype(np.float32), "o": np.zeros((classes, 1), np.float32)}
        for d in "fb":
            self.p |= {f"W{d}": r(3 * HIDDEN, EMBED), f"U{d}": r(3 * HIDDEN, HIDDEN), f"c{d}": np.zeros((3 * HIDDEN, 1), np.float32), f"O{d}": r(classes, HIDDEN)}

    def steps(self, x: np.ndarray, d: str) -> Iterator[tuple[np.ndarray, ...]]:
        """(state before, update gate, reset gate, candidate, recurrent part of it, state) after each row of x (T x n),
        read in order; the arrays are the caller's to keep."""
        p, H = self.p, HIDDEN
        table, U = p[f"W{d}"] @ p["E"] + p[f"c{d}"], p[f"U{d}"]
        h = np.zeros((H, x.shape[1]), p["E"].dtype)
        for now in x:
            a, u = table.take(now, axis=1, mode="clip"), U @ h
            zr = a[: 2 * H]
            zr += u[: 2 * H]
            _sigmoid(zr)
            uc = u[2 * H :]
            c = zr[H:] * uc
            c += a[2 * H :]
            np.tanh(c, out=c)
            new = h - c
            new *= zr[:H]
            new += c
            yield h, zr[:H], zr[H:], c, uc, new
            h = new

    def labels(self, ahead: np.ndarray, back: np.ndarray, size: np.ndarray) -> np.ndarray:
        """classes x n: the label probabilities summed over the first ``size`` positions of each window. ``ahead`` has
        CONTEXT rows before the window's, ``back`` the window's last row first and CONTEXT rows before it."""
        p = self.p
        length = len(ahead) - CONTEXT
        logits = np.empty((length, *p["o"].shape[:1], ahead.shape[1]), np.float32)
        for t, (*_, h) in enumerate(self.steps(ahead, "f")):
            if t >= CONTEXT:
                np.matmul(p["Of"], h, out=logits[t - CONTEXT])
        out = np.zeros(logits.shape[1:])
        for t, (*_, h) in enumerate(self.steps(back, "b")):
            if t >= CONTEXT:
                at = length - 1 - (t - CONTEXT)
                q = logits[at]
                q += p["Ob"] @ h
                q += p["o"]
                q -= q.max(0)
                np.exp(q, out=q)
                q *= (size > at) / q.sum(0)
                out += q
        return out

    def gradients(self, ahead: np.ndarray, back: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Cross-entropy of the label of every position, weighted by window, and its gradients by backpropagation through
        time. target: classes x n."""
        p, H = self.p, HIDDEN
        length = len(ahead) - CONTEXT
        kept = {"f": list(self.steps(ahead, "f")), "b": list(self.steps(back, "b"))}
        own = {"f": np.stack([k[-1] for k in kept["f"][CONTEXT:]]), "b": np.stack([k[-1] for k in kept["b"][CONTEXT:]][::-1])}
        logits = p["Of"] @ own["f"] + p["Ob"] @ own["b"] + p["o"]
        logits -= logits.max(1, keepdims=True)
        e = np.exp(logits)
        q = e / e.sum(1, keepdims=True)
        w = weight * (size > np.arange(length)[:, None])  # length x n
        loss = float(-(w * (target * np.log(q + 1e-9)).sum(1)).sum())
        dl = (q - target) * w[:, None, :]
        grad = {k: np.zeros_like(v) for k, v in p.items()}
        grad["o"] = dl.sum((0, 2))[:, None]
        for d, x in (("f", ahead), ("b", back)):
            grad[f"O{d}"] = np.einsum("tcn,thn->ch", dl, own[d], optimize=True)
            U, dh, dtable = p[f"U{d}"], np.zeros_like(kept[d][0][0]), np.zeros((3 * H, 257), p["E"].dtype)
            douts = p[f"O{d}"].T @ dl
            for t in range(len(x) - 1, -1, -1):
                h, z, r, c, uc, _ = kept[d][t]
                if t >= CONTEXT:
                    dh = dh + douts[t - CONTEXT if d == "f" else length - 1 - (t - CONTEXT)]
                da = np.empty((3 * H, x.shape[1]), p["E"].dtype)
                dc = dh * (1 - z) * (1 - c * c)
                da[:H] = dh * (h - c) * z * (1 - z)
                da[H : 2 * H] = dc * uc * r * (1 - r)
                da[2 * H :] = dc
                du = da.copy()
                du[2 * H :] = dc * r
                grad[f"U{d}"] += du @ h.T
                dtable += da @ _ONE_HOT[x[t]]
                dh = dh * z + U.T @ du
            grad["E"] += p[f"W{d}"].T @ dtable
            grad[f"W{d}"] += dtable @ p["E"].T
            grad[f"c{d}"] += dtable.sum(1, keepdims=True)
        return loss, grad

    def fit(self, ahead: np.ndarray, back: np.ndarray, size: np.ndarray, target: np.ndarray, weight: np.ndarray, steps: int, batch: int = 256, rate: float = 0.02, seed: int = 2) -> None:
        """Adam over batches of windows."""
        g = np.random.default_rng(seed)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        todo: list[np.ndarray] = []
        for step in range(1, steps + 1):
            if not todo:
                todo = np.array_split(g.permutation(len(size)), -(-len(size) // batch))
            part = todo.pop()
            w = weight[part] / max((weight[part] * size[part]).sum(), 1e-9)
            _, grad = self.gradients(ahead[:, part], back[:, part], size[part], target[:, part], w)
            lr = rate * min(1, step / 10) * (1 - 0.95 * step / steps)
            for name, v in grad.items():
                m[name] += 0.1 * (v - m[name])
                s[name] += 0.002 * (v * v - s[name])
                self.p[name] -= (lr * m[name] / (1 - 0.9**step) / (np.sqrt(s[name] / (1 - 0.998**step)) + 1e-8)).astype(self.p[name].dtype)


_ONE_HOT = np.eye(257, dtype=np.float32)


def windows(offsets: np.ndarray, data: np.ndarray, core: int = CORE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, start, size) of the windows of all texts: ``core`` bytes or up to 3 fewer, so that none ends in a character."""
    n = np.diff(offsets)
    pieces = -(-n // core)
    text = np.repeat(np.arange(len(n)), pieces)
    nth = np.arange(len(text)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    cut = offsets[text] + nth * core
    for _ in range(3):
        inside = (nth > 0) & ((data[cut] & 0xC0) == 0x80)
        cut[inside] -= 1
    last = np.append(text[1:] != text[:-1], True) if len(text) else np.zeros(0, bool)
    end = np.where(last, offsets[text + 1], np.append(cut[1:], 0)) if len(text) else cut
    return text, cut, end - cut


def laid_out(data: np.ndarray, start: np.ndarray, length: int, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The (CONTEXT + length) x n bytes read forwards and backwards for windows at ``start`` of texts from lo to hi."""

    def read(place: np.ndarray) -> np.ndarray:
        return np.where((place >= lo) & (place < hi), data[np.clip(place, 0, len(data) - 1)].astype(np.int64), OUTSIDE)

    return read(start + np.arange(-CONTEXT, length)[:, None]), read(start + np.arange(length + CONTEXT - 1, -1, -1)[:, None])


class Model:
    def __init__(self, languages: list[str], net: Gru):
        self.languages, self.net = languages, net

    def documents(self, texts: pa.Array) -> np.ndarray:
        """n x languages: the mean probability over all positions; zeros for an empty text."""
        data, offsets = string_buffers(texts)
        text, start, size = windows(offsets, data)
        sums = np.zeros((len(texts), len(self.languages)))
        bucket = np.searchsorted(LENGTHS, size)
        for k, length in enumerate(LENGTHS):
            of = np.flatnonzero(bucket == k if k < len(LENGTHS) - 1 else bucket >= k)
            width = max(1, min(WIDTH, (1 << 22) // (length * len(self.languages))))
            for part in np.array_split(of, -(-len(of) // width)) if len(of) else ():
                t = text[part]
                p = self.net.labels(*laid_out(data, start[part], length, offsets[t], offsets[t + 1]), size[part])
                np.add.at(sums, t, p.T)
        return sums / np.maximum(np.diff(offsets), 1)[:, None]

    def answers(self) -> Callable[[pa.Array], pa.Array]:
        names = np.array([*self.languages, UNKNOWN], dtype=object)

        def of(texts: pa.Array) -> pa.Array:
            n = len(texts)
            best, score = np.full(n, -1), np.zeros(n)
            if self.languages and n:
                p = self.documents(texts)
                letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_numpy(zero_copy_only=False)
                best, score = np.where(letters, p.argmax(1), -1), np.where(letters, p.max(1), 0.0)
            return pa.StructArray.from_arrays([pa.array(names[best].tolist(), pa.string()), pa.array(np.clip(score, 0, 1), pa.float64())], names=["lang", "score"])

        return of


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each text up to WINDOWS windows of TRAIN_CORE bytes: the bytes from CONTEXT before to CONTEXT after, with how
    many of those are before."""
    for batch in batches:
        for part in slices(batch):
            data, offsets = string_buffers(part.column("text"))
            langs, raw, before, size = [], [], [], []
            for lang, lo, hi in zip(part.column("lang").to_pylist(), offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                every = -(-(hi - lo) // TRAIN_CORE)
                place = np.random.default_rng(hi - lo).permutation(every)[:WINDOWS].tolist() if every > 0 else []
                for k in place:
                    a, b = lo + k * TRAIN_CORE, min(hi, lo + (k + 1) * TRAIN_CORE)
                    from_ = max(lo, a - CONTEXT)
                    langs.append(lang)
                    raw.append(data[from_ : min(hi, b + CONTEXT)].tobytes())
                    before.append(a - from_)
                    size.append(b - a)
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(raw, pa.binary()), pa.array(before, pa.int32()), pa.array(size, pa.int32())], names=["lang", "raw", "before", "size"])


def train(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """A model of the languages in ``labelled`` (doc_id, text, lang); rows with a null lang or text teach nothing."""
    rows = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counts = {r.lang: r["count"] for r in rows.groupBy("lang").count().collect()}
    languages = sorted(counts)
    if not languages:
        return Model([], Gru(1))
    # a hash of the id against each language's share of its texts
    share = F.create_map(*(x for k in languages for x in (F.lit(k), F.lit(min(1.0, sample_docs / counts[k])))))
    draw = F.pmod(F.xxhash64(F.lit("sample"), "doc_id"), F.lit(1 << 30)) / (1 << 30)
    # rows of one null id share their draw; their number is bounded by a second draw on the text
    also = F.col("doc_id").isNotNull() | (F.pmod(F.xxhash64(F.lit("sample"), "text"), F.lit(1 << 30)) / (1 << 30) < share[F.col("lang")])
    found = rows.where((F.col("doc_id").isNull() | (draw < share[F.col("lang")])) & also).mapInArrow(_training_windows, "lang string, raw binary, before int, size int").collect()
    found = sorted(found, key=lambda r: (r.lang, bytes(r.raw), r.before))
    net = Gru(len(languages))
    if found:
        n = np.array([len(r.raw) for r in found])
        hi = np.cumsum(n)
        lo = hi - n
        data = np.frombuffer(b"".join(bytes(r.raw) for r in found), np.uint8)
        ahead, back = laid_out(data, lo + [r.before for r in found], TRAIN_CORE, lo, hi)
        code = np.array([languages.index(r.lang) for r in found])
        weight = (1 / np.bincount(code, minlength=len(languages)))[code].astype(np.float32)  # as if all languages had as many windows
        target = np.eye(len(languages), dtype=np.float32)[:, code]
        net.fit(ahead, back, np.array([r.size for r in found]), target, weight, steps=int(np.clip(len(found) / 256 * 8, 80, 400)))
    return Model(languages, net)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` with lang_pred and lang_score (the probability of that language). Reads ``text`` alone;
    columns of these names that ``docs`` may have are replaced."""
    found = docs.withColumn("_tg_language", text_udf(model.answers, "lang string, score double")("text"))
    return found.withColumns({"lang_pred": F.col("_tg_language.lang"), "lang_score": F.col("_tg_language.score")}).drop("_tg_language")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document's predicted language."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(4)) == 2, F.lit(False))
    model = train(docs.where(~held_out))
    found = predict(docs.select("doc_id", "text", held_out.alias("held_out")), model)
    return found.select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"))
