"""A Merkle manifest of a table: digests of rows, a tree for each group of them, one root, and proofs.

Leaves are numbered in each group by sorted ranges. ARITY nodes in a row become their digest, level by level; the leaves
below a node LEVELS higher are a superblock. Superblocks are reduced in a task each, their nodes are superblocks of a next stage, until
a group has one node; so are the groups' nodes, up to the root. What lies outside a superblock on the ways to the root, its
outer nodes, comes back down stage by stage. Then a superblock's leaves and its outer nodes are cogrouped: one task builds
the block's own levels again, joins both parts of each leaf's proof and folds the leaf, or one claimed in its place, up to
the root. No task holds more than a superblock.
"""

from __future__ import annotations

from hashlib import sha256

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracegraph.operators.numbers import numbered
from tracegraph.store import saved

ARITY, LEVELS = 8, 4
#: Groups up to which their table is broadcast; beyond, leaves meet it by a shuffle.
BROADCAST_GROUPS = 100_000
#: Hexadecimal digits of a digest.
WIDE = 64


def leaf_digest(*values: Column) -> Column:
    """SHA-256 of the values in a row: ``-`` for a null, else the number of its UTF-8 bytes, a colon and the value."""
    texts = [v.cast("string") for v in values]
    return F.sha2(F.concat(*(F.when(t.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t)) for t in texts)), 256)


def _digest(text: str) -> str:
    return sha256(text.encode()).hexdigest()


def local_levels(nodes: list[str], size: int, levels: int) -> list[list[str]]:
    """The levels above ``nodes``, a superblock of a level of ``size`` nodes, themselves first: as many as the group has
    levels left, ``levels`` at most."""
    out = [nodes]
    while size > 1 and len(out) <= levels:
        below = out[-1]
        out.append([_digest("".join(below[k : k + ARITY])) for k in range(0, len(below), ARITY)])
        size = -(-size // ARITY)
    return out


def siblings(grown: list[list[str]], at: int) -> list[tuple[int, str]]:
    """(place in its run, the digests of the run's others in a row) of node ``at`` and of those above it."""
    out = []
    for below in grown[:-1]:
        k = at - at % ARITY
        run = below[k : k + ARITY]
        out.append((at - k, "".join(run[: at - k] + run[at - k + 1 :])))
        at //= ARITY
    return out


def to_text(path: list[tuple[int, str]]) -> str:
    return "".join(f"{place}:{others};" for place, others in path)


def from_text(path: str) -> list[tuple[int, str]]:
    return [(int(place), others) for place, others in (level.split(":") for level in path.split(";")[:-1])]


def fold(leaf: str, path: list[tuple[int, str]]) -> str:
    """The root that a leaf leads to along its siblings."""
    for place, others in path:
        leaf = _digest(others[: WIDE * place] + leaf + others[WIDE * place :])
    return leaf


def _in_blocks(nodes: DataFrame, block: int) -> DataFrame:
    return nodes.withColumn("block", F.floor(F.col("pos") / block).cast("long"))


def reduced(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, size, digest): the nodes of superblocks of ``nodes`` (tree, pos, size, digest). ``size`` is the number of
    nodes of the tree at this level."""
    wide = ARITY**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        size = int(block["size"].iloc[0])
        top = local_levels(block["digest"].tolist(), size, levels)[-1][0]
        return pd.DataFrame({"tree": [block["tree"].iloc[0]], "pos": [block["block"].iloc[0]], "size": [-(-size // wide)], "digest": [top]})

    return _in_blocks(nodes, wide).groupBy("tree", "block").applyInPandas(run, "tree long, pos long, size long, digest string")


def paths_to_top(nodes: DataFrame, levels: int = LEVELS) -> DataFrame:
    """(tree, pos, path, top): the siblings on the way from each node to its tree's top, and the top's digest."""
    wide = ARITY**levels

    def run(block: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos")
        grown = local_levels(block["digest"].tolist(), int(block["size"].iloc[0]), levels)
        out = block[["tree", "pos", "block", "size"]].copy()
        out["path"] = [to_text(siblings(grown, i)) for i in range(len(block))]
        out["top"] = grown[-1][0]
        return out

    stages = []
    while True:
        stage = saved(_in_blocks(nodes, wide).groupBy("tree", "block").applyInPandas(run, "tree long, pos long, block long, size long, path string, top string"), "stage")
        stages.append(stage)
        if stage.where(F.col("size") > wide).isEmpty():
            break
        nodes = stage.where(F.col("pos") % wide == 0).select("tree", F.col("block").alias("pos"), F.ceil(F.col("size") / wide).cast("long").alias("size"), F.col("top").alias("digest"))
    out = stages.pop().select("tree", "pos", "path", "top")
    while stages:
        above = out.select("tree", F.col("pos").alias("block"), F.col("path").alias("_above"), F.col("top").alias("_top"))
        out = stages.pop().join(above, ["tree", "block"]).select("tree", "pos", F.concat("path", "_above").alias("path"), F.col("_top").alias("top"))
    return out


def verified(leaves: DataFrame, id_: str = "doc_id", group: str = "lang", levels: int = LEVELS) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified) of each of ``leaves`` (id, group, leaf, claim).

    Leaves of a group ascend by id, nulls first, then by digest; groups ascend, null first. The proof is the digest of all
    siblings from the leaf to the root. ``folded_root`` is where ``claim`` leads to along them, and ``verified`` tells
    whether that is the root."""
    kind = dict(leaves.dtypes)[id_]
    rows = leaves.select(F.col(id_).alias("id"), F.col(group).alias("grp"), "leaf", "claim", F.monotonically_increasing_id().alias("row"))
    placed = saved(numbered(saved(rows, "leaves"), "n", "grp", "id", "leaf", "row"), "placed")
    trees = placed.groupBy("grp").agg(F.min("n").alias("first"), F.count(F.lit(1)).alias("size"))
    trees = saved(numbered(trees, "tree", "grp").withColumn("tree", F.col("tree") - 1), "trees")
    n_trees = trees.count()
    few = n_trees <= BROADCAST_GROUPS
    of = trees.withColumnRenamed("grp", "_grp")
    placed = placed.join(F.broadcast(of) if few else of, F.col("grp").eqNullSafe(F.col("_grp")))
    # pandas has no whole numbers that may be null: ids travel as text
    placed = saved(placed.select(F.col("id").cast("string").alias("id"), "leaf", "claim", "tree", (F.col("n") - F.col("first")).alias("pos"), "size"), "numbered")

    outer = saved(paths_to_top(reduced(placed.select("tree", "pos", "size", F.col("leaf").alias("digest")), levels), levels), "outer")
    # the tops of the groups are the leaves of one more tree
    tops = outer.where("pos = 0").select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("pos"), F.lit(n_trees).cast("long").alias("size"), F.col("top").alias("digest"))
    up = paths_to_top(tops, levels).select(F.col("pos").alias("tree"), F.col("path").alias("_up"), F.col("top").alias("root"))
    outer = outer.join(F.broadcast(up) if few else up, "tree").select("tree", F.col("pos").alias("block"), F.concat("path", "_up").alias("path"), F.col("top").alias("subroot"), "root")

    def finish(block: pd.DataFrame, outside: pd.DataFrame) -> pd.DataFrame:
        block = block.sort_values("pos", kind="stable")
        grown = local_levels(block["leaf"].tolist(), int(block["size"].iloc[0]), levels)
        path, subroot, root = outside[["path", "subroot", "root"]].iloc[0]
        above = from_text(path)
        rest = "".join(others for _, others in above)
        proofs, folded = [], []
        for i, claim in enumerate(block["claim"]):
            own = siblings(grown, i)
            proofs.append(_digest("".join(others for _, others in own) + rest))
            folded.append(fold(claim, own + above))
        out = block[["id", "leaf"]].copy()
        out["subroot"], out["root"], out["proof_sha256"], out["folded_root"] = subroot, root, proofs, folded
        out["verified"] = out["folded_root"] == root
        return out

    both = _in_blocks(placed, ARITY**levels).groupBy("tree", "block").cogroup(outer.groupBy("tree", "block"))
    out = both.applyInPandas(finish, "id string, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")
    return out.select(F.col("id").cast(kind).alias(id_), *out.columns[1:])


FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def op13_merkle_manifest(spark, sf_dir: str, levels: int = LEVELS) -> DataFrame:
    """The manifest of all documents, against a copy in which every third text, by the CRC of its doc_id, is lower-cased.
    A row with a null doc_id is never altered."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    cols = [F.col(c) for c in FIELDS]
    other = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0
    leaf = leaf_digest(*cols)
    claim = F.when(other, leaf_digest(*cols[:-1], F.translate("text", UPPER, UPPER.lower()))).otherwise(leaf)
    return verified(docs.select("doc_id", "lang", leaf.alias("leaf"), claim.alias("claim")), levels=levels)


def _field_sql(c: str) -> str:
    return f"case when {c} is null then '-' else octet_length(encode(cast({c} as varchar))) || ':' || {c} end"


#: CRC-32 of a decimal doc_id, a byte at a time, in SQL.
_CRC_SQL = """xor(list_reduce([4294967295] || list_transform(range(1, length(doc_id::varchar) + 1), lambda i: ascii(substr(doc_id::varchar, i, 1))::bigint),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, _: xor(x >> 1, 3988292384 * (x & 1)))), 4294967295)"""
OP13_SQL = f"""
with recursive l as (select *, {" || ".join(map(_field_sql, FIELDS[:-1]))} head from documents),
lf as (select doc_id, lang, sha256(head || {_field_sql("text")}) leaf,
  sha256(head || case when doc_id is not null and {_CRC_SQL} % 3 = 0 then {_field_sql(f"translate(text, '{UPPER}', '{UPPER.lower()}')")} else {_field_sql("text")} end) claim from l),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 pos, row_number() over () r from lf),
t(lang, lvl, pos, d, n) as (select lang, 0, pos, leaf, count(*) over (partition by lang) from p
  union all select lang, lvl + 1, pos // 8, sha256(string_agg(d, '' order by pos)), any_value((n + 7) // 8) from t where n > 1 group by lang, lvl, pos // 8),
top as (select lang, d subroot, row_number() over (order by lang nulls first) - 1 k from t where n = 1),
u(lvl, pos, d, n) as (select 0, k, subroot, count(*) over () from top
  union all select lvl + 1, pos // 8, sha256(string_agg(d, '' order by pos)), any_value((n + 7) // 8) from u where n > 1 group by lvl, pos // 8),
s as (select r, lvl s, (p.pos >> (3 * lvl)) % 8 place, coalesce(string_agg(d, '' order by t.pos) filter (t.pos <> p.pos >> (3 * lvl)), '') others
        from p join t on t.lang is not distinct from p.lang and n > 1 and t.pos // 8 = p.pos >> (3 * lvl + 3) group by r, lvl, p.pos
      union all select r, 100 + lvl, (k >> (3 * lvl)) % 8, coalesce(string_agg(d, '' order by u.pos) filter (u.pos <> k >> (3 * lvl)), '')
        from p join top on top.lang is not distinct from p.lang join u on n > 1 and u.pos // 8 = k >> (3 * lvl + 3) group by r, lvl, k),
o as (select *, row_number() over (partition by r order by s) i from s),
f(r, i, d) as (select r, 0, claim from p union all select o.r, o.i, sha256(substr(others, 1, 64 * place) || d || substr(others, 64 * place + 1)) from f join o on o.r = f.r and o.i = f.i + 1),
z as (select r, arg_max(d, i) folded_root from f group by 1), q as (select r, sha256(string_agg(others, '' order by s)) proof from s group by 1)
select doc_id, leaf, subroot, (select d from u where n = 1) root, coalesce(proof, sha256('')) proof_sha256, folded_root, folded_root = (select d from u where n = 1) verified
from p join top on top.lang is not distinct from p.lang join z using (r) left join q using (r)
"""
