"""Exact duplicates by counting quotient filters.

A text's fingerprint is the 64-bit hash of its text with A-Z lower-cased. Each task packs the fingerprints it reads into
filters, one for each slice of the range of fingerprints (their high bits); the filters of a slice then meet in one task
and are merged by their sorted remainders. Neither step loses a bit: a filter unpacks to the fingerprints and counts that
went in, so filters of other days or other tables merge as well. Fingerprints counted more than once route their rows to
the verification of bytes: rows are grouped by the whole text, copies pre-aggregated in the task that reads them.

A null text counts as empty. Of equal texts the row with the largest doc_id stays, a null one only if all are null; of rows
that repeat that doc_id one stays, whichever. Columns of the input are read by name (doc_id, text); others don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.store import saved

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Fingerprints that a slice holds at most on average, and that a task packs at a time.
SLICE_ROWS, PACK_ROWS = 1 << 15, 1 << 20
#: Repeated fingerprints up to which they are broadcast (16 bytes each); beyond, rows meet them by a shuffle.
BROADCAST_PRINTS = 2_000_000
#: A group of more than this share of all rows meets its rows by a broadcast: there are at most 1 / HOT such groups.
HOT = 0.001


def normal(text: str | Column = "text") -> Column:
    return F.translate(F.coalesce(text, F.lit("")), UPPER, UPPER.lower())


def slice_bits(rows: int) -> int:
    """High bits that number the slices of a table of so many rows."""
    return max(0, (max(rows, 1) - 1) // SLICE_ROWS).bit_length()


def pack(prints: np.ndarray, counts: np.ndarray, bits: int) -> bytes:
    """A counting quotient filter of one slice: ``prints`` (sorted, distinct, equal in their high ``bits``), ``counts`` > 0.

    Below the slice's bits a print is a quotient and a remainder. A bit for each quotient tells whether it has a run, a bit
    for each slot whether a run ends there; slots hold remainders in order. Counts above 1 stand aside, by slot.
    """
    n = len(prints)
    q = min(max(n - 1, 0).bit_length(), 64 - bits)
    r = 64 - bits - q
    own = prints & np.uint64((1 << (64 - bits)) - 1)
    quotient = (own >> np.uint64(r)).astype(np.int64) if r < 64 else np.zeros(n, np.int64)
    rest = own & np.uint64((1 << r) - 1)
    occupied = np.zeros(1 << q, bool)
    occupied[quotient] = True
    ends = np.append(quotient[1:] != quotient[:-1], True) if n else np.zeros(0, bool)
    width = -(-r // 8)
    slots = rest.astype("<u8").view(np.uint8).reshape(n, 8)[:, :width]
    many = np.flatnonzero(counts > 1)
    head = np.array([bits, q, n, len(many)], "<i8")
    parts = (head, np.packbits(occupied), np.packbits(ends), np.ascontiguousarray(slots), many.astype("<i8"), counts[many].astype("<i8"))
    return b"".join(p.tobytes() for p in parts)


def unpack(raw: bytes, number: int) -> tuple[np.ndarray, np.ndarray]:
    """The prints and counts that ``pack`` was given for slice ``number``."""
    bits, q, n, m = (int(x) for x in np.frombuffer(raw, "<i8", 4))
    r = 64 - bits - q
    width, at = -(-r // 8), 32
    sizes = [-(-(1 << q) // 8), -(-n // 8), n * width]
    occupied, ends, slots = (np.frombuffer(raw, np.uint8, s, at + sum(sizes[:i])) for i, s in enumerate(sizes))
    at += sum(sizes)
    many, found = np.frombuffer(raw, "<i8", m, at), np.frombuffer(raw, "<i8", m, at + 8 * m)
    ends = np.unpackbits(ends, count=n)
    run = np.cumsum(ends) - ends
    quotient = np.flatnonzero(np.unpackbits(occupied, count=1 << q))[run].astype(np.uint64)
    rest = np.zeros((n, 8), np.uint8)
    rest[:, :width] = slots.reshape(n, width)
    prints = rest.view("<u8").ravel().astype(np.uint64)
    if r < 64:
        prints = prints | (quotient << np.uint64(r))
    if bits:
        prints = prints | np.uint64(number << (64 - bits))
    counts = np.ones(n, np.int64)
    counts[many] = found
    return prints, counts


def merge(filters: list[bytes], number: int, bits: int) -> bytes:
    """One filter with the counts of all of a slice's filters."""
    parts = [unpack(f, number) for f in filters]
    prints, counts = (np.concatenate([p[i] for p in parts]) for i in (0, 1))
    order = np.argsort(prints, kind="stable")  # sorted stretches: a merge
    prints, counts = prints[order], counts[order]
    first = np.flatnonzero(np.append(True, prints[1:] != prints[:-1])) if len(prints) else np.zeros(0, np.int64)
    return pack(prints[first], np.add.reduceat(counts, first) if len(first) else counts, bits)


def partition_filters(prints: DataFrame, bits: int) -> DataFrame:
    """(slice, filter): the filters of each task's own fingerprints (print)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def packed() -> pa.RecordBatch:
            found, counts = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            number = (found >> np.uint64(64 - bits)).astype(np.int64) if bits else np.zeros(len(found), np.int64)
            first = np.flatnonzero(np.append(True, number[1:] != number[:-1]))
            cuts = zip(first, [*first[1:], len(found)], strict=True)
            filters = [pack(found[a:b], counts[a:b], bits) for a, b in cuts]
            return pa.RecordBatch.from_arrays([pa.array(number[first]), pa.array(filters, pa.binary())], names=["slice", "filter"])

        for b in batches:
            if b.num_rows:
                held.append(b.column(0).to_numpy().astype(np.int64).view(np.uint64))
            if sum(map(len, held)) >= PACK_ROWS:
                yield packed()
        if held:
            yield packed()

    return prints.select("print").mapInArrow(run, "slice long, filter binary")


def merged(filters: DataFrame, bits: int) -> DataFrame:
    """(slice, filter): one filter for each slice."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        number = int(group["slice"].iloc[0])
        return pd.DataFrame({"slice": [number], "filter": [merge(list(group["filter"]), number, bits)]})

    return filters.groupBy("slice").applyInPandas(run, "slice long, filter binary")


def counted(filters: DataFrame, least: int = 2) -> DataFrame:
    """(print, n): the fingerprints that ``filters`` count ``least`` times or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for number, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                prints, counts = unpack(raw.as_py(), number)
                many = counts >= least
                yield pa.RecordBatch.from_arrays([pa.array(prints[many].view(np.int64)), pa.array(counts[many])], names=["print", "n"])

    return filters.select("slice", "filter").mapInArrow(run, "print long, n long")


def groups(docs: DataFrame, row: Column | None = None) -> DataFrame:
    """(row, doc_id, keep_id, group_size, kept, text_sha256) of every row of ``docs``; ``row`` is a column that tells rows
    apart, by default a number given while reading."""
    text = docs.select("doc_id", normal().alias("norm"), (F.monotonically_increasing_id() if row is None else row).alias("row"))
    key = [F.xxhash64("norm").alias("print"), F.sha2("norm", 256).alias("sha")]
    ids = saved(text.select("row", "doc_id", *key), "prints")
    rows = ids.count()
    bits = slice_bits(rows)
    filters = saved(merged(partition_filters(ids, bits), bits), "filters")
    again = saved(counted(filters).select("print"), "again")
    again = F.broadcast(again) if again.count() <= BROADCAST_PRINTS else again

    # rows of one print and digest must be one text: as many as have the bytes of its most frequent text
    bytes_ = text.select(*key, "norm").join(again, "print", "left_semi").groupBy("print", "sha", "norm").agg(F.count(F.lit(1)).alias("n"))
    verified = bytes_.groupBy("print", "sha").agg(F.max("n").alias("n"))
    best = F.coalesce(F.max_by("row", "doc_id"), F.max("row"))
    found = ids.join(again, "print", "left_semi").groupBy("print", "sha").agg(F.max("doc_id").alias("keep_id"), best.alias("keep_row"), F.count(F.lit(1)).alias("size"))
    wrong = F.raise_error(F.lit("different texts have one fingerprint and one digest")).cast("long")
    found = found.join(verified, ["print", "sha"]).withColumn("size", F.when(F.col("size") == F.col("n"), F.col("size")).otherwise(wrong)).drop("n")
    found = saved(found.where("size > 1"), "copies")

    hot = F.col("size") > rows * HOT
    near = ids.join(F.broadcast(found.where(hot)), ["print", "sha"], "left")  # fewer than 1 / HOT rows
    far = near.where("size is null").select("row", "doc_id", "print", "sha").join(found.where(~hot), ["print", "sha"], "left")
    out = near.where("size is not null").unionByName(far)
    single = F.col("size").isNull()
    return out.select(
        "row",
        "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("size", F.lit(1).cast("long")).alias("group_size"),
        (single | (F.col("row") == F.col("keep_row"))).alias("kept"),
        F.col("sha").alias("text_sha256"),
    )


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that stay, with their columns."""
    own = saved(docs.withColumn("_tg_row", F.monotonically_increasing_id()), "rows")
    gone = groups(own, F.col("_tg_row")).where("not kept").select(F.col("row").alias("_tg_row"))
    return own.join(gone, "_tg_row", "left_anti").select(*docs.columns)


def op11_exact_dedup(spark, sf_dir: str) -> DataFrame:
    """Every document with the one that stays for it."""
    return groups(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("row")


OP11_SQL = f"""
with t as (select doc_id, translate(coalesce(text, ''), '{UPPER}', '{UPPER.lower()}') norm from documents),
g as (select norm, max(doc_id) keep_id, count(*) group_size from t group by 1)
select doc_id, keep_id, group_size, doc_id is not distinct from keep_id kept, sha256(norm) text_sha256 from t join g using (norm)
"""
