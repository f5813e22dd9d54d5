"""Adapter tables: the driver's tables in the shape of trace graphs, points, voxels, images and edit logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def f1_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(
        (F.col("event_id") + 1).cast("long").alias("nid"),
        F.expr("timestampdiff(HOUR, timestamp_ntz'2024-01-01', ts)").cast("long").alias("x"),
        F.floor("value").cast("long").alias("y"),
        F.col("user_id").cast("long").alias("z"),
        F.col("event_type").alias("creator"),
        F.when((F.col("event_type") == "signup") & (F.col("user_id") % 10 == 0), 1).otherwise(0).alias("type"),
        F.when(F.col("event_id") % 50 == 0, -1).when(F.col("event_id") % 3 == 0, 0).otherwise(1).alias("checked"),
        F.lit(1).alias("status"),
        F.col("user_id").cast("long").alias("user_id"),
        "ts",
    )


def f1_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_user = W.partitionBy("user_id").orderBy("ts", "nid")
    n = f1_nodes(spark, sf_dir).withColumn("src", F.lag("nid").over(per_user)).withColumn("px", F.lag("x").over(per_user))
    return n.where("x - px <= 24").select("src", F.col("nid").alias("dst"), "creator")


def f1_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sid, ord, x, y, z, type): the chains of F1 in order, sid the first nid."""
    per_user = W.partitionBy("user_id").orderBy("ts", "nid")
    n = f1_nodes(spark, sf_dir).withColumn("px", F.lag("x").over(per_user))
    n = n.withColumn("part", F.sum(F.when((F.col("x") - F.col("px")) <= 24, 0).otherwise(1)).over(per_user))
    inside = W.partitionBy("user_id", "part").orderBy("ts", "nid")
    return n.select(F.first("nid").over(inside).alias("sid"), (F.row_number().over(inside) - 1).cast("long").alias("ord"), "x", "y", "z", "type")


def f2_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders of each customer as a chain, hung on the customer at every third order key."""
    o = _table(spark, sf_dir, "orders").select((F.col("o_orderkey") * 2).cast("long").alias("o"), (F.col("o_custkey") * 2 + 1).cast("long").alias("c"), "o_orderdate")
    chain = o.select(F.lag("o").over(W.partitionBy("c").orderBy("o_orderdate", "o")).alias("src"), F.col("o").alias("dst")).where("src is not null")
    hung = o.where("o % 3 = 0").select(F.col("o").alias("src"), F.col("c").alias("dst"))
    pairs = chain.unionAll(hung).distinct()
    return pairs.withColumn("creator", F.when(F.col("src") % 3 == 0, "seger").otherwise("tester"))


def f2_nodes(spark: SparkSession, sf_dir: str, edges: DataFrame | None = None) -> DataFrame:
    e = f2_edges(spark, sf_dir) if edges is None else edges
    n = e.select(F.col("src").alias("nid")).union(e.select("dst")).distinct()
    return n.select("nid", (F.col("nid") * 37 % 509).alias("x"), (F.col("nid") * 101 % 383).alias("y"), (F.col("nid") % 251).alias("z"))


def f3_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").cast("long").alias("nid"), *(F.floor(F.col("embedding")[i].cast("double") * 100).cast("long").alias(k) for i, k in enumerate("xyz")))


def _voxels(spark: SparkSession, sf_dir: str, mod: int, *extra: str) -> DataFrame:
    li = _table(spark, sf_dir, "lineitem")
    z = F.col("l_quantity").cast("int")
    return li.groupBy(
        *(F.col(c).alias("image") for c in extra),
        (F.col("l_partkey") % mod).cast("int").alias("x"),
        (F.col("l_suppkey") % mod).cast("int").alias("y"),
        (z if mod == 40 else z % mod).alias("z"),
    ).agg(F.max(F.floor(F.col("l_extendedprice") / 2)).cast("int").alias("v"))


def f4_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir, 40)


def f5_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxels(spark, sf_dir, 16, "l_returnflag")


def f6_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    t = F.col("event_type")
    action = F.when(t == "signup", "add_node").when(t == "click", "check").when(t == "view", "uncheck").when(t == "error", "delete_node").otherwise("change_type")
    return e.select(F.col("event_id").cast("long").alias("seq"), (F.col("event_id") % 500 + 1).cast("long").alias("nid"), action.alias("action"), (F.col("user_id") % 8).cast("int").alias("arg"))


#: The same tables as common table expressions.
F1 = """n as (select cast(event_id + 1 as bigint) nid, date_diff('hour', timestamp '2024-01-01', ts) x, cast(floor(value) as bigint) y,
  cast(user_id as bigint) z, event_type creator, case when event_type = 'signup' and user_id % 10 = 0 then 1 else 0 end type,
  case when event_id % 50 = 0 then -1 when event_id % 3 = 0 then 0 else 1 end checked, 1 status, user_id, ts from events),
l as (select *, lag(nid) over (partition by user_id order by ts, nid) p, lag(x) over (partition by user_id order by ts, nid) px from n),
e as (select p src, nid dst, creator from l where x - px <= 24)"""
SEGMENTS = """q as (select *, sum(case when x - px <= 24 then 0 else 1 end) over (partition by user_id order by ts, nid) part from l),
s as (select first_value(nid) over (partition by user_id, part order by ts, nid) sid, row_number() over (partition by user_id, part order by ts, nid) - 1 ord, nid, x, y, z, type from q)"""
F2 = """oc as (select cast(o_orderkey * 2 as bigint) o, cast(o_custkey * 2 + 1 as bigint) c, o_orderdate from orders),
ch as (select lag(o) over (partition by c order by o_orderdate, o) src, o dst from oc union all select o, c from oc where o % 3 = 0),
e as (select distinct src, dst, case when src % 3 = 0 then 'seger' else 'tester' end creator from ch where src is not null),
n as (select nid, nid * 37 % 509 x, nid * 101 % 383 y, nid % 251 z from (select src nid from e union select dst from e))"""
F3 = """n as (select cast(vec_id as bigint) nid, cast(floor(cast(embedding[1] as double) * 100) as bigint) x, cast(floor(cast(embedding[2] as double) * 100) as bigint) y,
  cast(floor(cast(embedding[3] as double) * 100) as bigint) z from embeddings)"""
F4 = """vox as (select cast(l_partkey % 40 as int) x, cast(l_suppkey % 40 as int) y, cast(l_quantity as int) z, cast(max(floor(l_extendedprice / 2)) as int) v
  from lineitem group by 1, 2, 3)"""
F5 = """img as (select l_returnflag image, cast(l_partkey % 16 as int) x, cast(l_suppkey % 16 as int) y, cast(l_quantity as int) % 16 z,
  cast(max(floor(l_extendedprice / 2)) as int) v from lineitem group by 1, 2, 3, 4)"""
F6 = """ed as (select cast(event_id as bigint) seq, cast(event_id % 500 + 1 as bigint) nid, case event_type when 'signup' then 'add_node' when 'click' then 'check'
  when 'view' then 'uncheck' when 'error' then 'delete_node' else 'change_type' end action, cast(user_id % 8 as int) arg from events)"""
#: Degrees and components of n and e.
ADJ = "adj as (select src s, dst d from e union all select dst, src from e)"
DEG = ADJ + ", deg as (select n.nid, count(adj.s) degree from n left join adj on adj.s = n.nid group by 1)"
COMP = "r(nid, m) as (select nid, nid from n union select adj.d, r.m from r join adj on adj.s = r.nid), comp as (select nid, min(m) comp from r group by 1)"
GRAPH = f"{DEG}, {COMP}, g as (select n.*, degree, comp from n join deg using (nid) join comp using (nid))"
PENDING = "(checked = -1 or (degree = 1 and checked = 0))"
