"""Connected components by contraction.

First each task turns the edges it has read into a forest of stars of their own, some at a time. In each round every label
then gives way to the least one next to it, by an order that changes from round to round, and only edges between different
labels are left: on average a third of a chain's labels stay, so that all rounds together cost little more than the first.
A graph of FEW edges, or what is left of a larger one, is joined in one task. In the end the labels of the rounds are put
together, the last first.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.store import saved

MAX_ROUNDS = 60
#: Edges that a task joins at a time.
LOCAL = 1 << 20
#: Edges up to which one task joins all that are left.
FEW = 1 << 17


def hook(root: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Joins a[i] and b[i] in the forest ``root``; afterwards root[x] is the least position joined to x."""
    while len(a):
        ra, rb = root[a], root[b]
        differ = ra != rb
        a, b, ra, rb = a[differ], b[differ], ra[differ], rb[differ]
        if not len(a):
            break
        np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
        while True:
            up = root[root]
            if np.array_equal(up, root):
                break
            root[:] = up


def _local_stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[np.ndarray] = []

    def stars() -> pa.RecordBatch:
        ends = np.concatenate(held, axis=1) if held else np.zeros((2, 0), np.int64)
        held.clear()
        ids, at = np.unique(ends, return_inverse=True)
        at = at.reshape(ends.shape)
        root = np.arange(len(ids))
        hook(root, at[0], at[1])
        own = np.flatnonzero(root != np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids[own]), pa.array(ids[root[own]])], names=["u", "m"])

    for b in batches:
        held.append(np.stack([b.column(0).to_numpy(), b.column(1).to_numpy()]).astype(np.int64))
        if sum(x.shape[1] for x in held) >= LOCAL:
            yield stars()
    yield stars()


def _with_least(e: DataFrame, least: DataFrame) -> DataFrame:
    """``e`` with the least of its u. The join's key is an expression: so it is dealt apart from the aggregation, and
    Spark may split the rows of a node with many neighbours among tasks."""
    own = least.select(F.col("u").alias("of"), "least")
    return e.join(own, F.bitwise_not("u") == F.bitwise_not("of")).drop("of")


def star_edges(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """(nid, comp): every node that has an edge to another one, with the least node of its component.

    Self-loops and rows with a null end are ignored; ``edges`` may repeat an edge or give it in both directions.
    """
    a, b = F.col(src).cast("long"), F.col(dst).cast("long")
    e = saved(edges.where(a != b).select(a.alias("u"), b.alias("m")).mapInArrow(_local_stars, "u long, m long"), "star")
    turns: list[DataFrame] = []
    while (left := e.count()) > FEW:
        if len(turns) == MAX_ROUNDS:
            raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
        # each label points to the least one next to it, or to itself, and takes on the label two steps farther; from the
        # second turn on by orders of their own, so that no run of rising labels stays one
        turn = len(turns)
        rank = F.col if turn == 0 else lambda c, turn=turn: F.xxhash64(c, F.lit(turn))
        both = e.unionAll(e.select(F.col("m").alias("u"), F.col("u").alias("m")))
        least = both.groupBy("u").agg(F.min_by("m", rank("m")).alias("label"), F.min(rank("m")).alias("at"))
        least = saved(least.select("u", F.when(F.col("at") < rank("u"), F.col("label")).otherwise(F.col("u")).alias("label")), "least")
        on = least.select(F.col("u").alias("label"), F.col("label").alias("farther"))
        labels = saved(least.join(on, "label").select("u", F.col("farther").alias("label")), "labels", instead_of=least)
        rest, least = e, labels.withColumnRenamed("label", "least")
        for _ in "um":
            # the label in place of u; the other end's turn is next
            rest = _with_least(rest, least).select(F.col("m").alias("u"), F.col("least").alias("m"))
        e = saved(rest.where("u <> m").distinct(), "star", instead_of=e)
        turns.append(labels)
    found = None
    if left:
        small = saved(e.coalesce(1).mapInArrow(_local_stars, "u long, m long"), "small")
        found = small.withColumnRenamed("m", "label").unionAll(small.select(F.col("m").alias("u"), F.col("m").alias("label")).distinct())
    for labels in reversed(turns):
        if found is not None:
            on = found.select(F.col("u").alias("label"), F.col("label").alias("last"))
            labels = saved(labels.join(on, "label", "left").select("u", F.coalesce("last", "label").alias("label")), "labels", instead_of=labels)
        found = labels
    if found is None:
        found = e.select("u", F.col("m").alias("label"))
    least = found.groupBy("label").agg(F.min("u").alias("comp"))
    return saved(found.join(least, "label").select(F.col("u").alias("nid"), "comp"), "comp")
