"""Edits of nodes and edges as joins, and the replay of an edit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.operators.graph import adjacency, canonical, components
from tracegraph.store import saved


def add_nodes(nodes: DataFrame, new: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The nodes with ``new`` added (status 1 and checked 0 where null), and the rows rejected for a null or taken nid."""
    new = new.withColumn("status", F.coalesce("status", F.lit(1))).withColumn("checked", F.coalesce("checked", F.lit(0)))
    first = new.dropDuplicates(["nid"])
    good = first.where("nid is not null").join(nodes.select("nid"), "nid", "left_anti")
    bad = new.where("nid is null").unionByName(new.join(nodes.select("nid"), "nid", "left_semi"))
    return nodes.unionByName(good.select(*nodes.columns)), bad


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Canonical edges with those of ``new`` added that are not there; of equal new ones the least creator stays."""
    lo, hi = F.least("src", "dst"), F.greatest("src", "dst")
    new = new.select(lo.alias("src"), hi.alias("dst"), "creator").groupBy("src", "dst").agg(F.min("creator").alias("creator"))
    return edges.select("src", "dst", "creator").unionByName(new.join(edges, ["src", "dst"], "left_anti").select("src", "dst", "creator"))


def delete_nodes(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges without the nodes of ``gone`` (nid)."""
    left = edges.join(gone.select(F.col("nid").alias("src")), "src", "left_anti").join(gone.select(F.col("nid").alias("dst")), "dst", "left_anti")
    return nodes.join(gone.select("nid"), "nid", "left_anti").select(*nodes.columns), left.select(*edges.columns)


def delete_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """Edges without the pairs of ``gone`` (src, dst), in either orientation."""
    pairs = canonical(gone).select(F.col("src").alias("_a"), F.col("dst").alias("_b"))
    return edges.join(pairs, (F.least("src", "dst") == F.col("_a")) & (F.greatest("src", "dst") == F.col("_b")), "left_anti")


def patch(nodes: DataFrame, changes: DataFrame, *columns: str) -> DataFrame:
    """``nodes`` with ``columns`` taken from ``changes`` (nid and they) where it has a value."""
    new = changes.select("nid", *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = nodes.join(new, "nid", "left")
    for c in columns:
        out = out.withColumn(c, F.coalesce(f"_new_{c}", c))
    return out.select(*nodes.columns)


def update_nodes(nodes: DataFrame, changes: DataFrame, stamp: str, *columns: str) -> DataFrame:
    """``patch``, and ``date`` set to ``stamp`` where a value differs from what was there."""
    new = changes.select("nid", F.lit(True).alias("_hit"), *(F.col(c).alias(f"_new_{c}") for c in columns))
    out = nodes.join(new, "nid", "left")
    differs = F.lit(False)
    for c in columns:
        differs = differs | (F.col(f"_new_{c}").isNotNull() & ~F.col(f"_new_{c}").eqNullSafe(F.col(c)))
    out = out.withColumn("_differs", F.coalesce(F.col("_hit") & differs, F.lit(False)))
    for c in columns:
        out = out.withColumn(c, F.when(F.col("_differs"), F.coalesce(f"_new_{c}", c)).otherwise(F.col(c)))
    return out.withColumn("date", F.when(F.col("_differs"), F.lit(stamp)).otherwise(F.col("date"))).select(*nodes.columns)


def replay(nodes: DataFrame, edges: DataFrame, edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the log ``edits`` (seq, nid, action, arg, and other for edits of edges).

    A node's fate is its last delete_node or add_node. Its type and its checked flag come from its last change_type, check
    or uncheck, each, that is later than its last delete_node: a node that was deleted and added again starts afresh, at
    the origin, without edges. A deleted node takes its edges along. An add_edge or delete_edge names the ends nid and
    other, in either order; the pair's last edit holds, an added edge only if it is later than the last delete_node of
    both ends and both are there at the end. A pair that was there all along keeps its row.
    """
    return apply_summaries(nodes, edges, *summaries(edits))


def summaries(edits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What a log says of each node and of each pair: enough to replay it, a row for each however long the log is.

    Of nodes: the last add_node or delete_node (fate) and its seq, the seq of the last delete_node (gone), the last
    change_type (kind) and the last check or uncheck (flag), with their seqs. Of pairs (a < b): the last edit, its seq, and
    whether it was ever cut. An edit that comes twice counts once."""
    if "other" not in edits.columns:
        edits = edits.withColumn("other", F.lit(None).cast("long"))
    of = lambda *names: F.when(F.col("action").isin(*names), F.col("seq"))
    fate, kind, flag = of("add_node", "delete_node"), of("change_type"), of("check", "uncheck")
    node = edits.where(F.coalesce(fate, kind, flag).isNotNull() & F.col("nid").isNotNull()).groupBy("nid").agg(
        F.max_by("action", fate).alias("fate"), F.max(fate).alias("fate_seq"), F.max(of("delete_node")).alias("gone"),
        F.max_by(F.col("arg").cast("long"), kind).alias("kind"), F.max(kind).alias("kind_seq"),
        F.max_by(F.when(F.col("action") == "check", 1).otherwise(-1), flag).alias("flag"), F.max(flag).alias("flag_seq"),
    )
    pairs = edits.where("action in ('add_edge', 'delete_edge') and nid is not null and other is not null")
    pairs = pairs.groupBy(F.least("nid", "other").alias("a"), F.greatest("nid", "other").alias("b")).agg(
        F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"), F.max(F.col("action") == "delete_edge").alias("cut")
    )
    return node, pairs


def merged_summaries(node: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """One row for each node and pair of the summaries of several logs."""
    last = lambda c: (F.max_by(c, c + "_seq").alias(c), F.max(c + "_seq").alias(c + "_seq"))
    node = node.groupBy("nid").agg(*last("fate"), F.max("gone").alias("gone"), *last("kind"), *last("flag"))
    pairs = pairs.groupBy("a", "b").agg(F.max_by("action", "seq").alias("action"), F.max("seq").alias("seq"), F.max("cut").alias("cut"))
    return node, pairs


def apply_summaries(nodes: DataFrame, edges: DataFrame, node: DataFrame, pairs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after the log that the summaries are of."""
    deleted = node.where("gone is not null").select("nid", "gone")
    kept, left = delete_nodes(nodes, edges, deleted)
    added = node.where("fate = 'add_node'").select("nid").join(kept.select("nid"), "nid", "left_anti")
    blank = added.select(
        *(F.col("nid") if c == "nid" else F.lit({"status": 1, "checked": 0, "type": 0, "x": 0, "y": 0, "z": 0, "creator": "edit"}.get(c)).cast(t).alias(c) for c, t in nodes.dtypes)
    )
    kinds = dict(nodes.dtypes)
    since = lambda c: F.when(F.col("gone").isNull() | (F.col(c + "_seq") > F.col("gone")), F.col(c))
    new = node.select("nid", since("kind").cast(kinds["type"]).alias("type"), since("flag").cast(kinds["checked"]).alias("checked"))
    nodes = patch(kept.unionByName(blank), new, "type", "checked")

    own = left.withColumns({"_a": F.least("src", "dst"), "_b": F.greatest("src", "dst")})
    cut = pairs.where("cut").select(F.col("a").alias("_a"), F.col("b").alias("_b"))
    stay = own.join(cut, ["_a", "_b"], "left_anti")
    made = pairs.where("action = 'add_edge'").join(stay.select(F.col("_a").alias("a"), F.col("_b").alias("b")), ["a", "b"], "left_anti")
    for end in ("a", "b"):
        made = made.join(deleted.withColumnRenamed("nid", end), end, "left").where("gone is null or seq > gone").drop("gone")
        made = made.join(nodes.select(F.col("nid").alias(end)), end, "left_semi")
    made = made.select(F.col("a").alias("src"), F.col("b").alias("dst"), F.lit("edit").alias("creator"))
    return nodes, stay.select("src", "dst", "creator").unionByName(made)


def proofread(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """``nodes`` (with comp) after the log was submitted in proofreading mode, in which nodes, edges, types and the centre's
    own check are not written, only flags: each check submits its node's component, and what was unchecked in that
    component before gets checked -1. As nothing is cut or joined, a node is flagged if its first uncheck is earlier than
    its component's last check. Nodes without a component are left as they are."""
    of = lambda name: F.when(F.col("action") == name, F.col("seq"))
    log = edits.where("action in ('check', 'uncheck')").groupBy("nid").agg(F.min(of("uncheck")).alias("first"), F.max(of("check")).alias("last"))
    log = log.join(nodes.select("nid", "comp"), "nid").where("comp is not null")
    sent = log.groupBy("comp").agg(F.max("last").alias("sent")).where("sent is not null")
    return patch(nodes, log.join(sent, "comp").where("first < sent").select("nid", F.lit(-1).alias("checked")), "checked")


def until(edits: DataFrame, seq: int) -> DataFrame:
    """The log without what came after ``seq``."""
    return edits.where(F.col("seq") <= seq)


def last_task(edits: DataFrame) -> DataFrame:
    """(nid, seq) of the last node that was checked."""
    return edits.where("action = 'check'").agg(F.max_by("nid", "seq").alias("nid"), F.max("seq").alias("seq"))


def reopened(nodes: DataFrame, edits: DataFrame) -> DataFrame:
    """``nodes`` with the last node that was checked flagged again (checked -1)."""
    return patch(nodes, last_task(edits).select("nid", F.lit(-1).alias("checked")), "checked")


def highest(segments: DataFrame) -> DataFrame:
    """(max_sid, max_version) of segments (sid, version), 0 where there are none."""
    return segments.agg(*(F.coalesce(F.max(c), F.lit(0)).cast("long").alias(f"max_{c}") for c in ("sid", "version")))


def reset_around(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """``nodes`` without those of ``gone``, whose neighbours become unseen (checked 0)."""
    near = adjacency(edges).join(gone.select("nid"), "nid", "left_semi").select(F.col("nbr").alias("nid")).distinct()
    left, _ = delete_nodes(nodes, edges, gone)
    return patch(left, near.withColumn("checked", F.lit(0)), "checked")


def removed_edges(edges: DataFrame, gone: DataFrame) -> DataFrame:
    """The edges that go with the nodes of ``gone``: what the log of an edit has to name."""
    ids = gone.select("nid").distinct()
    src = edges.join(ids.withColumnRenamed("nid", "src"), "src", "left_semi").select(*edges.columns)
    return src.unionByName(edges.join(ids.withColumnRenamed("nid", "src"), "src", "left_anti").join(ids.withColumnRenamed("nid", "dst"), "dst", "left_semi").select(*edges.columns))


def new_centres(nodes: DataFrame, edges: DataFrame, gone: DataFrame) -> DataFrame:
    """(gone, centre, size, parts): for each node of ``gone`` that has neighbours left after all of them are removed, the
    neighbour in the largest component of what is left (of equals the least), that component's size, and into how many
    components its neighbours fall."""
    left, rest = delete_nodes(nodes.select("nid"), edges, gone)
    comp = saved(components(left, rest), "rest")
    sizes = comp.groupBy("comp").agg(F.count(F.lit(1)).alias("size"))
    near = adjacency(edges).join(gone.select("nid"), "nid", "left_semi").where("nid <> nbr").distinct()
    near = near.join(comp.select(F.col("nid").alias("nbr"), "comp"), "nbr").join(sizes, "comp")
    best = F.min(F.struct((-F.col("size")).alias("size"), F.col("nbr").alias("nbr")))
    return near.groupBy(F.col("nid").alias("gone")).agg(best.alias("b"), F.count_distinct("comp").alias("parts")).select("gone", F.col("b.nbr").alias("centre"), (-F.col("b.size")).alias("size"), "parts")
