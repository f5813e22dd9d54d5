"""Registered queries: each operator over the adapter tables, with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES, every_third
from tracegraph.operators import augment, dense, edits, graph, grid, paths, repair, review, voxels
from tracegraph.plans.fixtures import (
    ADJ, COMP, DEG, F1, F2, F3, F4, F5, F6, GRAPH, PENDING, SEGMENTS,
    f1_edges, f1_nodes, f1_segments, f2_edges, f2_nodes, f3_points, f4_voxels, f5_images, f6_edits,
)
from tracegraph.sources import layout, tables
from tracegraph.store import new_path, saved

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _f1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return f1_nodes(spark, d), f1_edges(spark, d)


def _g1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """F1 with degree and comp, and its edges."""
    n, e = _f1(spark, d)
    e = saved(e, "edges")
    return review.with_components(n, e), e


def _c1(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """F1 with comp, its edges, and what ``star_edges`` gives for them."""
    n, e = _f1(spark, d)
    e = saved(e.select("src", "dst"), "edges")
    found = graph.star_edges(e)
    return saved(graph.components(n, e, found), "graph"), e, found


def _rois(spark: SparkSession, d: str) -> DataFrame:
    """A box for each supplier."""
    s = spark.read.parquet(f"{d}/supplier.parquet")
    k = F.col("s_suppkey").cast("long")
    return s.select(k.alias("roi"), (k % 7).alias("x0"), (k % 11 * 30).alias("y0"), (k % 13 * 40).alias("z0"), (200 + k % 100).alias("sx"), (300 + k % 90).alias("sy"), (250 + k % 400).alias("sz"))


ROIS = "roi as (select cast(s_suppkey as bigint) roi, s_suppkey % 7 x0, s_suppkey % 11 * 30 y0, s_suppkey % 13 * 40 z0, 200 + s_suppkey % 100 sx, 300 + s_suppkey % 90 sy, 250 + s_suppkey % 400 sz from supplier)"
NODE = "nid, x, y, z, creator, cast(type as bigint) type, cast(checked as bigint) checked"


def _node(df: DataFrame) -> DataFrame:
    return df.select("nid", *AXES, "creator", F.col("type").cast("long"), F.col("checked").cast("long"))


# sources


@query(f"with {F1} select {NODE} from n where creator = 'click' and checked = 1")
def read_nodes(spark, d):
    return _node(f1_nodes(spark, d).where("creator = 'click' and checked = 1"))


@query(f"with {F1} select src, dst, creator from e where creator = 'view'")
def read_edges(spark, d):
    return f1_edges(spark, d).where("creator = 'view'")


@query(f"with {F2} select src, dst, creator from e where creator <> 'seger'")
def edges_not_seger(spark, d):
    return tables.not_by(f2_edges(spark, d))


@query(f"with {F1}, {SEGMENTS} select sid, ord, cast(x as double) x, cast(y as double) y, cast(z as double) z from s")
def read_segments(spark, d):
    s = f1_segments(spark, d).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ord", *AXES))).alias("p"))
    text = s.select("sid", F.to_json(F.transform("p", lambda p: F.array(p["x"], p["y"], p["z"]))).alias("points"))
    return tables.parse_segments(text)


@query(f"with {F1}, {SEGMENTS} select row_number() over (order by sid, ord) nid, sid, x, y, z, 'seger' creator, cast(0 as bigint) type from s")
def segments_to_nodes(spark, d):
    return tables.ingest_segments(f1_segments(spark, d))[0].select("nid", "sid", *AXES, "creator", F.col("type").cast("long"))


@query(f"with {F1}, {SEGMENTS}, k as (select row_number() over (order by sid, ord) nid, sid, ord from s) select nid src, nxt dst from (select nid, lead(nid) over (partition by sid order by ord) nxt from k) where nxt is not null")
def segments_to_edges(spark, d):
    return tables.ingest_segments(f1_segments(spark, d))[1].select("src", "dst")


def _swc(spark, d):
    """Lines of a file for each chain of F1: point i hangs on point i - 1."""
    s = f1_segments(spark, d)
    parent = F.when(F.col("ord") == 0, -1).otherwise(F.col("ord"))
    return s.select(F.format_string("f%08d.swc", "sid").alias("file"), F.concat_ws(" ", F.col("ord") + 1, "type", "x", "y", "z", F.lit("1.0"), parent).alias("value"))


SWC = f"""{F1}, {SEGMENTS}, good as (select sid, max(ord) + 1 top from s group by 1 having sum(type) = 1),
base as (select sid, coalesce(sum(top + 2) over (order by sid rows between unbounded preceding and 1 preceding), 0) b from good)"""


@query(f"with {SWC} select cast(ord + 1 + b as bigint) nid, cast(x as double) x, cast(y as double) y, cast(z as double) z, cast(type as bigint) type from s join base using (sid)")
def swc_nodes(spark, d):
    return tables.import_swc(tables.parse_swc(_swc(spark, d)))[0].select("nid", *AXES, F.col("type").cast("long"))


@query(f"with {SWC} select cast(ord + 1 + b as bigint) src, cast(ord + b as bigint) dst, 'terafly' creator from s join base using (sid) where ord > 0")
def swc_edges(spark, d):
    return tables.import_swc(tables.parse_swc(_swc(spark, d)))[1]


PARENTS = f"""{F1}, {GRAPH}, root as (select comp, coalesce(min(case when type = 1 then nid end), min(nid)) root, sum(type) somas from g group by 1),
t(nid, parent) as (select root, cast(-1 as bigint) from root union select adj.d, t.nid from t join adj on adj.s = t.nid where adj.d <> t.parent)"""


@query(f"""with recursive {PARENTS} select case when somas = 0 then 'no_soma_' when somas = 1 then '' else 'many_soma_' end || 'neuron_' || root || '.swc' file, g.nid,
printf('%d %d %.1f %.1f %.1f 1.0 %d', g.nid, g.type, g.x::double, g.y::double, g.z::double, t.parent) value from g join t using (nid) join root using (comp)""")
def swc_lines(spark, d):
    return tables.swc_lines(*_c1(spark, d))


@query(f"with recursive {PARENTS} select case when somas = 0 then 'no_soma_' when somas = 1 then '' else 'many_soma_' end || 'neuron_' || root || '.swc' file, count(*) * 3 length from g join root using (comp) group by 1")
def swc_lengths(spark, d):
    return tables.total_length(tables.swc_lines(*_c1(spark, d)))


def _old(spark, d):
    n, e = _f1(spark, d)
    old = n.select("nid", F.concat(F.lit("["), F.concat_ws(",", F.col("x") + 0.5, "y", -F.col("z")), F.lit("]")).alias("coord"), "creator", "type", "checked", "status")
    a = e.select("src", F.col("dst").alias("des"), "creator", (F.col("dst") % 7).alias("date"))
    return old, a.unionAll(a.select(F.col("des").alias("src"), F.col("src").alias("des"), F.lit("zz").alias("creator"), F.col("src") % 7))


@query(f"with {F1} select nid, x, y, -z z from n")
def migrated_nodes(spark, d):
    return tables.migrate(*_old(spark, d))[0].select("nid", *AXES)


@query(f"""with {F1}, b as (select src, dst, creator, dst % 7 date from e union all select dst, src, 'zz', src % 7 from e)
select least(src, dst) src, greatest(src, dst) dst, arg_min(creator, (date, creator)) creator, min(date) date from b group by 1, 2""")
def migrated_edges(spark, d):
    return tables.migrate(*_old(spark, d))[1]


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@query(" union all ".join(f"select '{t}' as name, (select count(*) from (describe {t})) n_columns, count(*) n_rows from {t}" for t in TABLES))
def table_profile(spark, d):
    return tables.profile({t: spark.read.parquet(f"{d}/{t}.parquet") for t in TABLES})


#: Tables whose columns are profiled, all of them.
PROFILED = {
    "region": ["r_regionkey", "r_name"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "labels": ["doc_id", "quality", "toxic"],
    "benchmark": ["item_id", "text"],
}


def _profile_sql(spec: dict[str, list[str]]) -> str:
    kind = "case typeof(any_value({c})) when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'TIMESTAMP' then 'timestamp_ntz' else lower(typeof(any_value({c}))) end"
    one = "select '{t}' as name, {i}::bigint as place, '{c}' as \"column\", " + kind + " as type, (select \"null\" = 'YES' from (describe {t}) where column_name = '{c}') nullable, count(*) n_rows, count(*) - count({c}) n_null, count(distinct {c}) = count(*) is_key from {t}"
    return " union all ".join(one.format(t=t, i=i, c=c) for t, cs in spec.items() for i, c in enumerate(cs))


@query(_profile_sql(PROFILED))
def column_profile(spark, d):
    return tables.column_profile({t: spark.read.parquet(f"{d}/{t}.parquet") for t in PROFILED})


def _mirror_sql(padding: str) -> str:
    at = {k: f"(({k}.i + {o}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2}" for k, o, n in zip("xyz", (-3, 30, -2), (40, 40, 51), strict=True)}
    src = {k: (f"case when {m} < {n} then {m} else {2 * n - 2} - {m} end" if padding == "reflect" else f"{k}.i + {o}") for (k, m), o, n in zip(at.items(), (-3, 30, -2), (40, 40, 51), strict=True)}
    return f"""with {F4}, a as (select unnest(generate_series(0, 15)) i)
select x.i x, y.i y, z.i z, cast(coalesce(v, 0) as bigint) v from a x, a y, a z left join vox on vox.x = {src['x']} and vox.y = {src['y']} and vox.z = {src['z']}"""


@query(_mirror_sql("constant"))
def crop_constant(spark, d):
    return tables.crop(f4_voxels(spark, d), [-3, 30, -2], [16, 16, 16], [40, 40, 51])


@query(_mirror_sql("reflect"))
def crop_reflect(spark, d):
    return tables.crop(f4_voxels(spark, d), [-3, 30, -2], [16, 16, 16], [40, 40, 51], "reflect")


#: Corners of crops: one for each supplier, some beyond the volume.
CORNERS = "roi as (select cast(s_suppkey as bigint) roi, s_suppkey * 7 % 53 - 9 x0, s_suppkey * 11 % 50 - 6 y0, s_suppkey * 3 % 61 - 7 z0 from supplier)"


def _crops_sql(padding: str) -> str:
    at = {k: f"{k}0 + {k}.i" for k in "xyz"}
    if padding == "reflect":
        at = {k: f"case when (({c}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} < {n} then (({c}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} else {2 * n - 2} - (({c}) % {2 * n - 2} + {2 * n - 2}) % {2 * n - 2} end" for (k, c), n in zip(at.items(), (40, 40, 51), strict=True)}
    return f"""with {F4}, {CORNERS}, a as (select unnest(generate_series(0, 7)) i),
p as (select roi, x.i x, y.i y, z.i z, {at['x']} vx, {at['y']} vy, {at['z']} vz from roi, a x, a y, a z)
select roi, p.x, p.y, p.z, coalesce(v, 0)::bigint v from p left join vox on vox.x = vx and vox.y = vy and vox.z = vz"""


def _corners(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey").cast("long")
    return spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("roi"), (k * 7 % 53 - 9).alias("x0"), (k * 11 % 50 - 6).alias("y0"), (k * 3 % 61 - 7).alias("z0"))


@query(_crops_sql("constant"))
def crops_constant(spark, d):
    return dense.unpacked(dense.crops(_corners(spark, d), f4_voxels(spark, d), 8, [40, 40, 51]), 8)


@query(_crops_sql("reflect"))
def crops_reflect(spark, d):
    return dense.unpacked(dense.crops(_corners(spark, d), f4_voxels(spark, d), 8, [40, 40, 51], "reflect"), 8)


@query(f"with {F4} select x, y, z, v from vox where x >= 5 and x < 20 and y >= 8 and y < 30 and z >= 10 and z < 25")
def slab(spark, d):
    return tables.slab(f4_voxels(spark, d), [5, 8, 10], [20, 30, 25])


def _level_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Sizes of the volume at five levels, each of half the voxels, a last odd one kept."""
    at = f4_voxels(spark, d).select(F.explode(F.sequence(F.lit(0), F.lit(4))).alias("level"), *AXES)
    return at.groupBy(F.col("level").cast("long").alias("level")).agg(*((F.max(F.floor(F.col(k) / F.pow(F.lit(2), F.col("level")))) + 1).cast("long").alias("s" + k) for k in AXES))


def _laid_out(spark: SparkSession, rows: DataFrame, side: int) -> str:
    path = new_path(spark, "cells")
    layout.write_cells(rows, path, side)
    return path


@query(SQL["slab"])
def slab_by_cells(spark, d):
    return layout.read_box(spark, _laid_out(spark, f4_voxels(spark, d), 4), [5, 8, 10], [20, 30, 25])


def _levels_sql(width: tuple[str, str, str], low: tuple[float, float, float]) -> str:
    sizes = "sz as (select cast(l as bigint) level, max(x >> l) + 1 sx, max(y >> l) + 1 sy, max(z >> l) + 1 sz from vox, (select unnest(generate_series(0, 4))::int l) group by 1)"
    px = {k: f"{w}::double / s{k}" for k, w in zip("xyz", width, strict=True)}
    spacing = ", ".join(f"{px[k]} p{k}" for k in "xyz")
    origin = ", ".join(f"trunc(trunc({a}::double) / ({px[k]}))::bigint o{k}" for k, a in zip("xyz", low, strict=True))
    return f"with {F4}, {sizes}, base as (select sx bx, sy by_, sz bz from sz where level = 0) select level, sx::bigint sx, sy::bigint sy, sz::bigint sz, {spacing}, {origin} from sz, base"


@query(_levels_sql(("(31.5 - (-20.25))", "(180.0 - 15.75)", "(3000.0 - 333.3)"), (-20.25, 15.75, 333.3)))
def level_info(spark, d):
    return tables.level_info(_level_sizes(spark, d), [-20.25, 15.75, 333.3], [31.5, 180.0, 3000.0])


@query(_levels_sql(("bx", "by_", "bz"), (0, 0, 0)))
def level_info_without_extent(spark, d):
    return tables.level_info(_level_sizes(spark, d))


@query(f"with {F1} select cast(floor(x / 16.0) as bigint) tx, cast(floor(y / 16.0) as bigint) ty, cast(floor(z / 16.0) as bigint) tz, count(*) n from (select distinct x, y, z from n) group by 1, 2, 3")
def raster_tiles(spark, d):
    return tables.raster_tiles(f1_nodes(spark, d))


@query(f"with {F1}, p as (select distinct x % 40 x, y % 40 y, z % 51 z from n where creator = 'click'), a as (select unnest(generate_series(0, 39)) x), b as (select unnest(generate_series(0, 39)) y), c as (select unnest(generate_series(0, 50)) z) select a.x, b.y, c.z, cast(p.x is not null as bigint) m from a, b, c left join p on p.x = a.x and p.y = b.y and p.z = c.z")
def mask_volume(spark, d):
    p = f1_nodes(spark, d).where("creator = 'click'").select((F.col("x") % 40).alias("x"), (F.col("y") % 40).alias("y"), (F.col("z") % 51).alias("z"))
    return tables.unpacked_mask(tables.mask_volume(p, [40, 40, 51]), [40, 40, 51])


# edits


def _new_nodes(spark, d):
    return f2_nodes(spark, d).select("nid", *AXES, F.lit("new").alias("creator"), F.lit(0).alias("type"), F.lit(None).cast("int").alias("checked"), F.lit(None).cast("int").alias("status"))


NEW = F2.replace("n as (", "n2 as (").replace("e as (", "e2 as (").replace("from e ", "from e2 ").replace("from e)", "from e2)")


@query(f"with {F1}, {NEW} select {NODE} from n union all select nid, x, y, z, 'new', 0, 0 from n2 where nid not in (select nid from n)")
def add_nodes(spark, d):
    n = f1_nodes(spark, d).select("nid", *AXES, "creator", "type", "checked", "status")
    return _node(edits.add_nodes(n, _new_nodes(spark, d))[0])


@query(f"with {F1}, {NEW}, c as (select least(src, dst) src, greatest(src, dst) dst, creator from e) select * from c union all select * from (select least(src, dst) src, greatest(src, dst) dst, min(creator) creator from e2 group by 1, 2) where (src, dst) not in (select (src, dst) from c)")
def add_edges(spark, d):
    e = f1_edges(spark, d).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"), "creator")
    return edits.add_edges(e, f2_edges(spark, d))


@query(f"with {F1} select {NODE} from n where nid % 10 <> 0")
def delete_nodes(spark, d):
    n, e = _f1(spark, d)
    return _node(edits.delete_nodes(n, e, n.where("nid % 10 = 0"))[0])


@query(f"with {F1} select src, dst, creator from e where src % 10 <> 0 and dst % 10 <> 0")
def delete_cascade(spark, d):
    n, e = _f1(spark, d)
    return edits.delete_nodes(n, e, n.where("nid % 10 = 0"))[1]


@query(f"with {F1} select src, dst, creator from e where src % 7 <> 0")
def delete_edges(spark, d):
    e = f1_edges(spark, d)
    return edits.delete_edges(e, e.where("src % 7 = 0").select(F.col("dst").alias("src"), F.col("src").alias("dst")))


@query(f"with {F1} select nid, x, y, z, creator, cast(case when nid % 4 = 0 then 2 else type end as bigint) type, cast(checked as bigint) checked from n")
def change_type(spark, d):
    n = f1_nodes(spark, d)
    return _node(edits.patch(n, n.where("nid % 4 = 0").select("nid", F.lit(2).alias("type")), "type"))


@query(f"with {F1} select nid, cast(case when nid % 5 = 0 then 0 else checked end as bigint) checked, case when nid % 5 = 0 and checked <> 0 then 'now' else 'then' end date from n")
def update_nodes(spark, d):
    n = f1_nodes(spark, d).withColumn("date", F.lit("then"))
    return edits.update_nodes(n, n.where("nid % 5 = 0").select("nid", F.lit(0).alias("checked")), "now", "checked").select("nid", F.col("checked").cast("long"), "date")


@query(f"with {F1} select nid, x, y, z, creator, cast(type as bigint) type, cast(case when nid % 6 = 0 then 1 when nid % 6 = 1 then -1 else checked end as bigint) checked from n")
def check_nodes(spark, d):
    n = f1_nodes(spark, d)
    return _node(edits.patch(n, n.where("nid % 6 < 2").select("nid", F.when(F.col("nid") % 6 == 0, 1).otherwise(-1).alias("checked")), "checked"))


@query(f"with {F1} select coalesce(max(nid), 0) max_nid from n")
def max_nid(spark, d):
    return f1_nodes(spark, d).agg(F.coalesce(F.max("nid"), F.lit(0)).cast("long").alias("max_nid"))


def _replay_sql(log: str) -> str:
    return f"""{F1}, {F6}, log as (select * from ed where {log}),
fate as (select nid, arg_max(action, seq) fate from log where action in ('add_node', 'delete_node') group by 1),
del as (select distinct nid from log where action = 'delete_node'),
gone as (select nid, max(seq) gone from log where action = 'delete_node' group by 1),
late as (select log.* from log left join gone using (nid) where gone is null or seq > gone),
kind as (select nid, arg_max(arg, seq) arg from late where action = 'change_type' group by 1),
flag as (select nid, arg_max(case when action = 'check' then 1 else -1 end, seq) f from late where action in ('check', 'uncheck') group by 1),
base as (select nid, x, y, z, creator, type, checked from n where nid not in (select nid from del)
         union all select nid, 0, 0, 0, 'edit', 0, 0 from fate where fate = 'add_node' and nid not in (select nid from n where nid not in (select nid from del))),
done as (select nid, x, y, z, creator, cast(coalesce(kind.arg, type) as bigint) type, cast(coalesce(flag.f, checked) as bigint) checked from base left join kind using (nid) left join flag using (nid))"""


@query(f"with {_replay_sql('true')} select * from done")
def edit_replay(spark, d):
    return _node(edits.replay(*_f1(spark, d), f6_edits(spark, d))[0])


@query(f"with {_replay_sql('true')} select src, dst, creator from e where src not in (select nid from del) and dst not in (select nid from del)")
def edit_replay_edges(spark, d):
    return edits.replay(*_f1(spark, d), f6_edits(spark, d))[1]


@query(f"with {_replay_sql('seq <= 400')} select * from done")
def edit_rollback(spark, d):
    return _node(edits.replay(*_f1(spark, d), edits.until(f6_edits(spark, d), 400))[0])


@query(f"""with recursive {F1}, {F6}, {ADJ}, {COMP}, lg as (select nid, comp, min(case when action = 'uncheck' then seq end) f, max(case when action = 'check' then seq end) s from ed join comp using (nid) group by all),
sent as (select comp, max(s) sent from lg group by 1) select nid, x, y, z, creator, cast(type as bigint) type, cast(case when f < sent then -1 else checked end as bigint) checked from n left join lg using (nid) left join sent using (comp)""")
def edit_proofread(spark, d):
    return _node(edits.proofread(_g1(spark, d)[0], f6_edits(spark, d)))


def _edge_log(spark, d):
    """The node log with an edit of an edge of F1, or of a pair that is none, beside every third edit."""
    log = f6_edits(spark, d)
    pair = log.where("seq % 3 = 0").select(
        (F.col("seq") * 2 + 1).alias("seq"), F.col("nid"), F.when(F.col("seq") % 2 == 0, "add_edge").otherwise("delete_edge").alias("action"), "arg", (F.col("nid") * 7 % 500 + 1).alias("other")
    )
    cut = f1_edges(spark, d).where("src <= 500 and dst % 2 = 0").select((F.col("dst") * 4 + 1).alias("seq"), F.col("dst").alias("nid"), F.lit("delete_edge").alias("action"), F.lit(0).alias("arg"), F.col("src").alias("other"))
    return log.select((F.col("seq") * 2).alias("seq"), "nid", "action", "arg", F.lit(None).cast("long").alias("other")).unionByName(pair).unionByName(cut)


@query(f"""with {_replay_sql('true')},
pl as (select seq * 2 + 1 seq, least(nid, nid * 7 % 500 + 1) a, greatest(nid, nid * 7 % 500 + 1) b, case when seq % 2 = 0 then 'add_edge' else 'delete_edge' end action from ed where seq % 3 = 0
       union all select dst * 4 + 1, least(src, dst), greatest(src, dst), 'delete_edge' from e where src <= 500 and dst % 2 = 0),
pp as (select a, b, arg_max(action, seq) action, max(seq) seq, bool_or(action = 'delete_edge') cut from pl group by 1, 2),
stay as (select src, dst, creator from e where src not in (select nid from del) and dst not in (select nid from del) and (least(src, dst), greatest(src, dst)) not in (select (a, b) from pp where cut))
select src, dst, creator from stay union all
select a, b, 'edit' from pp left join gone ga on ga.nid = a left join gone gb on gb.nid = b
where action = 'add_edge' and (a, b) not in (select (least(src, dst), greatest(src, dst)) from stay) and (ga.gone is null or pp.seq > ga.gone * 2) and (gb.gone is null or pp.seq > gb.gone * 2)
  and a in (select nid from done) and b in (select nid from done)""")
def edge_edit_replay(spark, d):
    return edits.replay(*_f1(spark, d), _edge_log(spark, d))[1].select("src", "dst", "creator")


@query(f"with {F1}, {F6}, t as (select arg_max(nid, seq) nid from ed where action = 'check') select nid, x, y, z, creator, cast(type as bigint) type, cast(case when nid = (select nid from t) then -1 else checked end as bigint) checked from n")
def edit_reopen(spark, d):
    return _node(edits.reopened(f1_nodes(spark, d), f6_edits(spark, d)))


@query(f"with {F6} select arg_max(nid, seq) nid, max(seq) seq from ed where action = 'check'")
def last_task(spark, d):
    return edits.last_task(f6_edits(spark, d))


@query(f"with {F1}, {ADJ} select nid, x, y, z, creator, cast(type as bigint) type, cast(case when nid in (select d from adj where s % 50 = 0) then 0 else checked end as bigint) checked from n where nid % 50 <> 0")
def reset_around(spark, d):
    n, e = _f1(spark, d)
    return _node(edits.reset_around(n, e, n.where("nid % 50 = 0")))


@query(f"with {F1} select src, dst, creator from e where src % 50 = 0 or dst % 50 = 0")
def removed_edges(spark, d):
    n, e = _f1(spark, d)
    return edits.removed_edges(e, n.where("nid % 50 = 0"))


@query(f"""with recursive {F2.replace('n as (', 'n0 as (').replace('e as (', 'e0 as (').replace('from e ', 'from e0 ').replace('from e)', 'from e0)')},
n as (select nid from n0 where nid % 10 <> 0), e as (select src, dst from e0 where src % 10 <> 0 and dst % 10 <> 0), {ADJ}, {COMP}, z as (select comp, count(*) size from comp group by 1),
near as (select distinct s gone, d nbr from (select src s, dst d from e0 union all select dst, src from e0) where s % 10 = 0 and s <> d)
select gone, arg_min(nbr, (-size, nbr)) centre, max(size) size, count(distinct comp) parts from near join comp on comp.nid = nbr join z using (comp) group by 1""")
def new_centres(spark, d):
    n, e = f2_nodes(spark, d), f2_edges(spark, d)
    return edits.new_centres(n, e, n.where("nid % 10 = 0"))


def _versioned(spark, d):
    return f1_segments(spark, d).withColumn("version", F.col("sid") % 5)


@query(f"with {F1}, {SEGMENTS} select max(sid) max_sid, max(sid % 5) max_version from s")
def max_sid_version(spark, d):
    return edits.highest(_versioned(spark, d))


@query(f"""with {F1}, {SEGMENTS}, k as (select max(sid) m from s where sid % 2 = 0), r as (select sid, row_number() over (order by sid) + m "new" from (select distinct sid from s where sid % 2 = 1), k)
select "new" sid, ord, x, y, z, cast(5 as bigint) as version, '2024-01-01' date from s join r using (sid)""")
def stamped_segments(spark, d):
    old, new = (_versioned(spark, d).where(f"sid % 2 = {k}") for k in (0, 1))
    top = edits.highest(old).first()
    return tables.new_segments(new, top.max_sid, 4, "2024-01-01")


# boxes and tiles


@query(f"with {F1} select nid from n where x >= 100 and x < 400 and y >= 10 and y < 300 and z >= 5 and z < 700")
def roi_nodes(spark, d):
    return f1_nodes(spark, d).where("x >= 100 and x < 400 and y >= 10 and y < 300 and z >= 5 and z < 700").select("nid")


@query(SQL["roi_nodes"])
def roi_nodes_by_cells(spark, d):
    path = _laid_out(spark, f1_nodes(spark, d).select("nid", *AXES), 64)
    return layout.read_box(spark, path, [100, 10, 5], [400, 300, 700]).select("nid")


@query(f"with {F3} select a.nid, b.nid m from n a, n b where a.nid <> b.nid and abs(a.x - b.x) <= 6 and abs(a.y - b.y) <= 6 and abs(a.z - b.z) <= 6")
def box_pairs(spark, d):
    p = f3_points(spark, d)
    return grid.box_pairs(p, p, 6).select("nid", "m")


@query(SQL["box_pairs"])
def box_pairs_by_leaves(spark, d):
    p = f3_points(spark, d)
    return grid.box_pairs(p, p, 6, capacity=4).select("nid", "m")


def _near_sql(k: int) -> str:
    return f"""with recursive {F2}, {ADJ}, {COMP}, g as (select n.*, comp from n join comp using (nid)),
p as (select a.nid, b.nid m, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) dist from g a join g b on abs(a.x - b.x) <= 8 and abs(a.y - b.y) <= 8 and abs(a.z - b.z) <= 8 and a.comp <> b.comp),
o as (select *, row_number() over (partition by nid order by dist, m) rank, count(*) over (partition by nid) c from p)
select nid, m, dist, rank from o where c >= {k} and rank <= {k}"""


def _near(spark, d, k, **how):
    n, e = f2_nodes(spark, d), f2_edges(spark, d)
    g = saved(graph.components(n, e), "graph")
    return grid.nearest_foreign(g, g, 8, k, **how)


@query(_near_sql(1))
def nearest_foreign(spark, d):
    return _near(spark, d, 1)


@query(_near_sql(2))
def two_nearest_foreign(spark, d):
    return _near(spark, d, 2)


@query(_near_sql(2))
def two_nearest_foreign_by_leaves(spark, d):
    return _near(spark, d, 2, capacity=2)


@query(f"""with recursive {F1}, {GRAPH}, big as (select comp from g group by 1 having count(*) > 10),
p as (select a.nid, b.nid m, b.degree, round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6) dist from g a join g b on abs(a.x - b.x) <= 6 and abs(a.y - b.y) <= 6 and abs(a.z - b.z) <= 6 and a.comp <> b.comp
      where a.degree = 1 and a.checked = 0 and a.comp in (select comp from big)),
o as (select *, row_number() over (partition by nid order by dist, m) k from p) select distinct m nid from o where k = 1 and degree = 2""")
def junctions(spark, d):
    g, e = _g1(spark, d)
    return grid.uncheck_junctions(g, e)


def _tiles_sql(n: str, clip: bool) -> str:
    s = {k: f"least(128, s{k} - t{k} * 128)" if clip else "128" for k in "xyz"}
    gen = {k: f"unnest(generate_series(0, {n.format('s' + k)} - 1)) t{k}" for k in "xyz"}
    return f"""with {ROIS}, a as (select *, {gen['x']} from roi), b as (select *, {gen['y']} from a), c as (select *, {gen['z']} from b)
select roi, x0 + tx * 128 x0, y0 + ty * 128 y0, z0 + tz * 128 z0, {s['x']}::bigint sx, {s['y']}::bigint sy, {s['z']}::bigint sz from c"""


@query(_tiles_sql("cast(ceil({} / 128.0) as bigint)", True))
def tiles_clipped(spark, d):
    return grid.tiles(_rois(spark, d), 128)


@query(_tiles_sql("cast(floor({} / 128.0) as bigint)", True))
def tiles_whole(spark, d):
    return grid.tiles(_rois(spark, d), 128, True)


@query(f"""with {ROIS}, a as (select *, unnest(generate_series(0, cast(floor((sx - 100) / 80.0) as bigint))) tx from roi), b as (select *, unnest(generate_series(0, cast(floor((sy - 100) / 80.0) as bigint))) ty from a),
c as (select *, unnest(generate_series(0, cast(floor((sz - 100) / 80.0) as bigint))) tz from b) select roi, x0 + tx * 80 x0, y0 + ty * 80 y0, z0 + tz * 80 z0, 100::bigint sx, 100::bigint sy, 100::bigint sz from c""")
def tiles_sliding(spark, d):
    return grid.sliding(_rois(spark, d), 100, 20)


def _spliced_sql(size: int, splices: int) -> str:
    """Cuts where the reference's rule puts them: all z of a roi are looked at."""
    at = f"c % {splices} = 0 or c % {size} = 0" if size % splices == 0 else f"(c - z0) % {size} = 0"
    return f"""with {ROIS}, zs as (select *, unnest(generate_series(z0, z0 + sz - 1)) c from roi), cuts as (select roi, c from zs where c = z0 or {at}),
zz as (select roi.*, c, coalesce(lead(c) over (partition by roi order by c), z0 + sz) nxt from roi join cuts using (roi)),
a as (select *, unnest(generate_series(0, cast(ceil(sx / {size}.0) as bigint) - 1)) tx from zz), b as (select *, unnest(generate_series(0, cast(ceil(sy / {size}.0) as bigint) - 1)) ty from a)
select roi, x0 + tx * {size} x0, y0 + ty * {size} y0, c z0, least({size}, sx - tx * {size})::bigint sx, least({size}, sy - ty * {size})::bigint sy, nxt - c sz from b"""


@query(_spliced_sql(300, 150))
def tiles_spliced(spark, d):
    return grid.spliced(_rois(spark, d), 300, 150)


@query(_spliced_sql(300, 200))
def tiles_spliced_by_size(spark, d):
    return grid.spliced(_rois(spark, d), 300, 200)


HALO = """h as (select x, y, z, v, unnest(generate_series(greatest(0, cast(floor((x - 4) / 16.0) as bigint)), cast(floor((x + 4) / 16.0) as bigint))) tx from vox),
h2 as (select *, unnest(generate_series(greatest(0, cast(floor((y - 4) / 16.0) as bigint)), cast(floor((y + 4) / 16.0) as bigint))) ty from h),
h3 as (select *, unnest(generate_series(greatest(0, cast(floor((z - 4) / 16.0) as bigint)), cast(floor((z + 4) / 16.0) as bigint))) tz from h2),
tile as (select *, tx = x // 16 and ty = y // 16 and tz = z // 16 core from h3)"""


@query(f"with {F4}, {HALO} select tx, ty, tz, count(*) n, count(*) filter (core) n_core from tile group by 1, 2, 3")
def halo_tiles(spark, d):
    return grid.haloed(f4_voxels(spark, d), 16).groupBy("tx", "ty", "tz").agg(F.count(F.lit(1)).alias("n"), F.count_if("core").alias("n_core"))


@query(f"with {F1} select nid, cast(trunc(x * 1.0 / 4) as bigint) x, cast(trunc(y * 1.0 / 4) as bigint) y, cast(trunc(z * 1.0 / 4) as bigint) z from n")
def points_to_level(spark, d):
    lv = tables.levels(spark, [2000, 2000, 2000], [0, 0, 0])
    return grid.to_level(f1_nodes(spark, d).withColumn("level", F.lit(0).cast("long")), lv, 2)


@query("with s as (select max(l_orderkey) a, max(l_partkey) b, max(l_suppkey) c from lineitem), i as (select unnest(generate_series(0, 4)) l) select coalesce(min(l), 0)::bigint as level from i, s where (a >> l) < 1000 and (b >> l) < 1000 and (c >> l) < 1000")
def overview_level(spark, d):
    m = spark.read.parquet(f"{d}/lineitem.parquet").agg(F.max("l_orderkey").alias("a"), F.max("l_partkey").alias("b"), F.max("l_suppkey").alias("c")).first()
    return grid.overview_level(tables.levels(spark, [m.a, m.b, m.c], [0, 0, 0]))


@query(f"""with {F4}, ray as (select cast(s_suppkey as bigint) ray, s_suppkey % 40 ax, s_suppkey * 7 % 40 ay, 0 az, s_suppkey * 3 % 40 bx, s_suppkey * 11 % 40 b2, 50 bz from supplier),
k as (select *, greatest(1, cast(ceil(2 * sqrt((bx - ax) ** 2 + (b2 - ay) ** 2 + (bz - az) ** 2)) as bigint)) c from ray), i as (select *, unnest(generate_series(0, c)) i from k),
pts as (select ray, i, cast(greatest(0, least(39, floor(round(ax + (bx - ax) * i / c::double, 9)))) as int) x, cast(greatest(0, least(39, floor(round(ay + (b2 - ay) * i / c::double, 9)))) as int) y, cast(greatest(0, least(50, floor(round(az + (bz - az) * i / c::double, 9)))) as int) z from i),
o as (select ray, pts.x, pts.y, pts.z, coalesce(v, 0) v, row_number() over (partition by ray order by coalesce(v, 0) desc, i) r from pts left join vox using (x, y, z)) select ray, x, y, z, v from o where r = 1""")
def ray_pick(spark, d):
    k = F.col("s_suppkey").cast("long")
    rays = spark.read.parquet(f"{d}/supplier.parquet").select(k.alias("ray"), (k % 40).alias("ax"), (k * 7 % 40).alias("ay"), F.lit(0).alias("az"), (k * 3 % 40).alias("bx"), (k * 11 % 40).alias("by"), F.lit(50).alias("bz"))
    return voxels.ray_pick(rays, f4_voxels(spark, d), [40, 40, 51])


@query(f"with {F1} select src, dst, least(a.x, b.x) - 5.0::double lox, least(a.y, b.y) - 5.0::double loy, least(a.z, b.z) - 5.0::double loz, greatest(a.x, b.x) + 5.0::double hix, greatest(a.y, b.y) + 5.0::double hiy, greatest(a.z, b.z) + 5.0::double hiz from e join n a on a.nid = src join n b on b.nid = dst")
def edge_boxes(spark, d):
    n, e = _f1(spark, d)
    return grid.edge_boxes(e, n)


@query(f"with {F1} select nid, x - 100 x, y - 10 y, z - 5 z from n where x >= 100 and x < 400 and y >= 10 and y < 300 and z >= 5 and z < 700")
def local_points(spark, d):
    return grid.local(f1_nodes(spark, d), [100, 10, 5], [300, 290, 695]).select("nid", *AXES)


# graphs; the ends of the edges of F1 and F2 are all nodes of theirs


@query(f"with {F2}, {DEG} select nid, degree, case when degree = 0 then 'isolated' when degree = 1 then 'terminal' when degree = 2 then 'path' else 'branch' end as class from deg")
def degree(spark, d):
    return graph.degree(f2_nodes(spark, d).select("nid"), f2_edges(spark, d))


@query(f"with {F1} select src, dst, e.creator from e join n a on a.nid = src join n b on b.nid = dst where a.x < 300 and b.x < 300")
def induced_edges(spark, d):
    n, e = _f1(spark, d)
    return graph.induced(n.where("x < 300"), e)


@query(f"with recursive {F1}, {ADJ}, {COMP} select nid, comp from comp")
def components(spark, d):
    n, e = _f1(spark, d)
    return graph.components(n.select("nid"), e)


def _path_sql(source: str, longer: int) -> str:
    return f"""{source}, c0 as (select distinct least(src, dst) src, greatest(src, dst) dst from e where src <> dst), d0 as (select nid, count(c0.src) k from n left join c0 on nid in (src, dst) group by 1),
pl as (select nid from d0 where k < 3), ce as (select src, dst from c0 where src in (select nid from pl) and dst in (select nid from pl)),
ca as (select src s, dst d from ce union all select dst, src from ce), ck as (select pl.nid, count(ca.s) k from pl left join ca on ca.s = pl.nid group by 1),
cr(nid, m) as (select nid, nid from pl union select ca.d, cr.m from cr join ca on ca.s = cr.nid), cc as (select nid, min(m) comp from cr group by 1),
st as (select comp, min(nid) start from cc join ck using (nid) where k = 1 group by 1 having count(*) = 2), sz as (select comp, count(*) size from cc group by 1 having count(*) > {longer}),
w(comp, ord, nid, prev) as (select comp, 0::bigint, start, -1::bigint from st join sz using (comp) union select w.comp, w.ord + 1, ca.d, w.nid from w join ca on ca.s = w.nid and ca.d <> w.prev)"""


@query(f"with recursive {_path_sql(F1, 3)} select comp, ord, nid from w")
def paths_f1(spark, d):
    return paths.paths(None, f1_edges(spark, d), 3)


@query(f"with recursive {_path_sql(F1.replace('x - px <= 24', "x - px <= 24 and creator = 'click'"), 1)} select comp, ord, nid from w")
def paths_by_creator(spark, d):
    return paths.paths_by(None, f1_edges(spark, d), "click", 1)


@query(f"with recursive {_path_sql(F2.replace('e as (select distinct src', 'e0 as (select distinct src').replace('n as (select nid, nid * 37', "e as (select * from e0 where creator = 'tester'), n as (select nid, nid * 37").replace('select src nid from e union select dst from e', 'select src nid from e0 union select dst from e0'), 2)} select comp, ord, nid from w")
def paths_branched_by_creator(spark, d):
    return paths.paths_by(None, f2_edges(spark, d), "tester", 2)


@query(f"with recursive {_path_sql(F2, 1)} select comp, ord, nid from w")
def paths_branched(spark, d):
    return paths.paths(None, f2_edges(spark, d), 1)


@query(f"with recursive {_path_sql(F1, 3)}, {F4} select comp, ord, w.nid, cast(coalesce(v, 0) as bigint) v from w join n using (nid) left join vox on vox.x = n.x and vox.y = n.y and vox.z = n.z")
def path_values(spark, d):
    n, e = _f1(spark, d)
    p = paths.paths(None, e, 3).join(n.select("nid", *AXES), "nid")
    return voxels.along(p, f4_voxels(spark, d)).select("comp", "ord", "nid", F.col("v").cast("long"))


@query(f"with recursive {F2}, {ADJ}, {COMP}, k as (select count(*) n_edges from (select distinct least(src, dst), greatest(src, dst) from e)) select (select count(*) from n) - (select count(distinct comp) from comp) forest_edges")
def forest_size(spark, d):
    return graph.spanning_forest(f2_edges(spark, d)).agg(F.count(F.lit(1)).alias("forest_edges"))


#: Kruskal's forest of F2 in (src, dst) order: an edge is in it if the edges before it do not join its ends.
FOREST = f"""{NEW}, ce as (select *, row_number() over (order by src, dst) i from (select distinct least(src, dst) src, greatest(src, dst) dst from e2 where src <> dst)),
ca as (select i, src s, dst d from ce union all select i, dst, src from ce),
cf(i, pos) as (select i, src from ce union select cf.i, ca.d from cf join ca on ca.s = cf.pos and ca.i < cf.i),
forest as (select src, dst from ce where not exists (select 1 from cf where cf.i = ce.i and cf.pos = ce.dst))"""


@query(f"with recursive {FOREST} select src, dst from forest")
def forest_edges(spark, d):
    return graph.spanning_forest(f2_edges(spark, d))


@query(f"""with recursive {FOREST}, fa as (select src s, dst d from forest union all select dst, src from forest), fr(nid, m) as (select nid, nid from n2 union select fa.d, fr.m from fr join fa on fa.s = fr.nid),
root as (select distinct m nid from (select nid, min(m) m from fr group by nid)), h(nid, k) as (select nid, 0::bigint from root union select fa.d, h.k + 1 from h join fa on fa.s = h.nid where h.k < 100)
select nid, min(k) hops from h group by 1""")
def forest_hops(spark, d):
    edges = saved(f2_edges(spark, d).select("src", "dst"), "edges")
    comp = graph.star_edges(edges)
    forest = graph.spanning_forest(edges, comp)
    roots = graph.components(f2_nodes(spark, d).select("nid"), forest, comp).groupBy("comp").agg(F.min("nid").alias("nid")).select("nid")
    return graph.hops(forest, roots, comp=comp)


@query(f"""with recursive {F1.replace("e as (", "e0 as (")}, e as (select src, dst from e0 where src % 97 <> 0 union all select nid, nid + 1 from n where nid % 89 = 0 and nid + 1 in (select nid from n)), {ADJ}, {COMP} select nid, comp from comp""")
def components_after_edit(spark, d):
    n, e = _f1(spark, d)
    removed, added = e.where("src % 97 = 0"), n.where("nid % 89 = 0").select(F.col("nid").alias("src"), (F.col("nid") + 1).alias("dst"))
    added = added.join(n.select(F.col("nid").alias("dst")), "dst", "left_semi").select("src", "dst")
    before = saved(graph.components(n.select("nid"), e), "before")
    after = e.where("src % 97 <> 0").select("src", "dst").unionAll(added)
    return graph.update_components(before, after, added, removed)


@query(f"with recursive {PARENTS} select nid, parent from t")
def parents(spark, d):
    g, e, found = _c1(spark, d)
    roots = g.groupBy("comp").agg(F.coalesce(F.min(F.when(F.col("type") == 1, F.col("nid"))), F.min("nid")).alias("nid"))
    return graph.rooted_forest(e, roots, found)


@query(f"""with recursive {F2}, {DEG}, c as (select min(nid) nid from deg where degree = (select max(degree) from deg)),
h(nid, k) as (select nid, 0 from c union select adj.d, h.k + case when h.nid <> (select nid from c) and degree >= 3 then 1 else 0 end from h join adj on adj.s = h.nid join deg on deg.nid = h.nid where k < 11)
select nid, min(k)::bigint hops from h group by 1 having min(k) < 10""")
def branch_order(spark, d):
    e = saved(f2_edges(spark, d).select("src", "dst"), "edges")
    n = f2_nodes(spark, d, e)
    deg = saved(graph.degree(n.select("nid"), e), "degrees")
    start = deg.orderBy(F.desc("degree"), "nid").limit(1)
    return graph.hops(e, start, deg.select("nid", (F.col("degree") >= 3).cast("long").alias("cost"))).where("hops < 10")


@query(f"""with recursive {F1}, {GRAPH}, c as (select comp from g group by 1 having count(*) > 10), h(nid, k) as (select comp, 0 from c union select adj.d, h.k + 1 from h join adj on adj.s = h.nid where k < 200)
select nid, hops from (select nid, min(k)::bigint hops from h group by 1) join g using (nid) where {PENDING}""")
def pending_by_hops(spark, d):
    g, e = _g1(spark, d)
    large = g.groupBy("comp").count().where("count > 10")
    own = saved(g.join(large, "comp", "left_semi"), "own")
    far = graph.hops(e, own.where("nid = comp"), comp=own)
    return far.join(own.where(review.pending()).select("nid"), "nid").orderBy("hops", "nid")


@query(f"""with recursive {F1}, {DEG}, w(nid, step, pos, prev) as (select nid, 0::bigint, nid, -1::bigint from deg where degree = 1 union all
select w.nid, w.step + 1, adj.d, w.pos from w join adj on adj.s = w.pos and adj.d <> w.prev join deg on deg.nid = w.pos where w.step < 5 and degree <= 2) select nid, step, pos as "at" from w""")
def end_walks(spark, d):
    n, e = _f1(spark, d)
    return paths.walk_from_ends(graph.degree(n, e).where("degree = 1"), e)


INFO = f"""{F1}, {GRAPH}, len as (select a.comp, sum(round(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2), 6)) len from e join g a on a.nid = src join g b on b.nid = dst group by 1)"""


@query(f"""with recursive {INFO} select comp, count(*) size, count(*) filter (degree = 1) ends, count(*) filter (degree >= 3) branches, cast(coalesce(floor(round(any_value(len), 3)), 0) as bigint) length
from g left join len using (comp) group by comp having count(*) filter ({PENDING}) = 0""")
def annotation_info(spark, d):
    return review.annotation_info(*_g1(spark, d))


@query(f"with recursive {F1}, {GRAPH}, f as (select comp from g group by 1 having count(*) filter ({PENDING}) = 0) select comp, nid, case when degree >= 3 then 'branch' when degree = 1 then 'end' else 'node' end as role from g join f using (comp)")
def annotation_members(spark, d):
    return review.annotation_members(_g1(spark, d)[0])


@query(f"with recursive {F1}, {GRAPH}, z as (select comp, count(*) size from g group by 1 having count(*) > 10) select nid, comp, size from g join z using (comp) where size >= 20")
def long_components(spark, d):
    return review.by_size(_g1(spark, d)[0]).select("nid", "comp", "size")


@query(f"""with recursive {F2}, blk as (select nid from n where x >= 90 and x <= 350 and y >= 40 and y <= 350), be as (select src, dst from e where src in (select nid from blk) and dst in (select nid from blk)),
ba as (select src s, dst d from be union all select dst, src from be), br(nid, m) as (select nid, nid from blk union select ba.d, br.m from br join ba on ba.s = br.nid), bc as (select nid, min(m) comp from br group by 1)
select nid from bc where comp in (select comp from bc group by 1 having count(*) <= 4 and max(case when nid = 1 then 1 else 0 end) = 0)""")
def purge(spark, d):
    return review.purge(f2_nodes(spark, d), f2_edges(spark, d), 1, [100, 50, 10], [230, 280, 1000])


@query(f"with {F1} select src, dst, creator from e where src % 9 <> 0 and dst % 9 <> 0")
def dangling(spark, d):
    n, e = _f1(spark, d)
    return review.dangling(n.where("nid % 9 <> 0"), e)


@query(f"""with recursive {_path_sql(F2, 1)}, t as (select comp, max(ord) last from w group by 1), tip as (select w.comp, w.ord, w.nid, last from w join t using (comp) where ord = 0 or ord = last),
a2 as (select distinct s, d from (select src s, dst d from e union all select dst, src from e)),
o as (select tip.comp, tip.ord, min(last) last, min(a2.d) nid from tip join a2 on a2.s = tip.nid where not exists (select 1 from w where w.comp = tip.comp and w.nid = a2.d) group by 1, 2 having count(*) = 1)
select comp, ord, nid from w union all select comp, case when ord = 0 then -1 else last + 1 end, nid from o""")
def branched_paths(spark, d):
    return paths.paths(None, f2_edges(spark, d), 1, branches=True)


@query(f"""with recursive {FOREST}, fa as (select src s, dst d from forest union all select dst, src from forest), fr(nid, m) as (select nid, nid from n2 union select fa.d, fr.m from fr join fa on fa.s = fr.nid),
fc as (select nid, min(m) fcomp from fr group by 1), n as (select nid from fc where fcomp in (select fcomp from fc group by 1 having count(*) > 10)),
e as (select src, dst from forest where src in (select nid from n)), {_path_sql("one as (select 1)", 1).replace("ce as (", "pe as (").replace("from ce", "from pe").replace("ca as (", "pa as (").replace("from ca ", "from pa ").replace("ca.", "pa.").replace("join ca ", "join pa ").replace("left join ca", "left join pa")},
t as (select comp, max(ord) last from w group by 1), tip as (select w.comp, w.ord, w.nid, last from w join t using (comp) where ord = 0 or ord = last),
a2 as (select distinct s, d from (select src s, dst d from e union all select dst, src from e)),
o as (select tip.comp, tip.ord, min(last) last, min(a2.d) nid from tip join a2 on a2.s = tip.nid where not exists (select 1 from w where w.comp = tip.comp and w.nid = a2.d) group by 1, 2 having count(*) = 1)
select comp, ord, nid from w union all select comp, case when ord = 0 then -1 else last + 1 end, nid from o""")
def coloured_paths(spark, d):
    return paths.coloured_paths(None, f2_edges(spark, d))


BOX = "n1 as (select * from n where x >= 100 and x <= 500 and y >= 0 and y <= 300 and z >= 0 and z <= 900)"


@query(f"""with recursive {F1}, {BOX}, {F4},
k0 as (select distinct least(src, dst) src, greatest(src, dst) dst from e where src in (select nid from n1) and dst in (select nid from n1) and src <> dst),
k1 as (select nid, count(k0.src) k from n1 left join k0 on nid in (src, dst) group by 1), pl as (select nid from k1 where k < 3),
pe as (select src, dst from k0 where src in (select nid from pl) and dst in (select nid from pl)), pa as (select src s, dst d from pe union all select dst, src from pe),
pk as (select pl.nid, count(pa.s) k from pl left join pa on pa.s = pl.nid group by 1),
cr(nid, m) as (select nid, nid from pl union select pa.d, cr.m from cr join pa on pa.s = cr.nid), cc as (select nid, min(m) comp from cr group by 1),
st as (select comp, min(nid) start from cc join pk using (nid) where k = 1 group by 1 having count(*) = 2), sz as (select comp from cc group by 1 having count(*) >= 5),
w(comp, ord, nid, prev) as (select comp, 0::bigint, start, -1::bigint from st join sz using (comp) union select w.comp, w.ord + 1, pa.d, w.nid from w join pa on pa.s = w.nid and pa.d <> w.prev)
select comp, ord, w.nid, n1.x - 100 x, n1.y y, n1.z z, cast(coalesce(v, 0) as bigint) v from w join n1 on n1.nid = w.nid left join vox on vox.x = n1.x and vox.y = n1.y and vox.z = n1.z""")
def segments_within(spark, d):
    n, e = _f1(spark, d)
    return paths.segments_within(n, e, f4_voxels(spark, d), [100, 0, 0], [400, 300, 900], 5).withColumn("v", F.col("v").cast("long"))


@query()
def dense_skeleton(spark, d):
    """Between the points of F1's chains in a box, folded into the volume."""
    n, e = _f1(spark, d)
    inside = n.select("nid", (F.col("x") % 40).alias("x"), (F.col("y") % 40).alias("y"), (F.col("z") % 51).alias("z"))
    return voxels.dense_skeleton(paths.segments_within(inside, e, f4_voxels(spark, d), [0, 0, 0], [39, 20, 50], 3), f4_voxels(spark, d))


@query(f"with {F1}, {SEGMENTS}, k as (select sid, count(*) c from s group by 1) select count(*) filter (c >= 2) chains, count(*) filter (c = 1) points, sum(c)::bigint total from k")
def segment_counts(spark, d):
    return paths.chain_counts(f1_segments(spark, d), "sid")


@query(f"with {F1} select case when e.creator in ('click', 'view') then e.creator else 'default' end creator, count(*) n_edges, sum(b.x - a.x)::bigint dx, sum(b.y - a.y)::bigint dy, sum(b.z - a.z)::bigint dz from e join n a on a.nid = src join n b on b.nid = dst group by 1")
def edges_by_creator(spark, d):
    n, e = _f1(spark, d)
    found = grid.edges_by_creator(e, n, ["click", "view"])
    return found.select("creator", "n_edges", *(F.col("d" + k).cast("long").alias("d" + k) for k in AXES))


# repair


def _angle_sql(u: tuple[str, str, str], v: tuple[str, str, str]) -> str:
    (a, b, c), (x, y, z) = u, v
    across = " + ".join(f"({p}) ** 2" for p in (f"{b} * {z} - {c} * {y}", f"{c} * {x} - {a} * {z}", f"{a} * {y} - {b} * {x}"))
    return f"case when {a} ** 2 + {b} ** 2 + {c} ** 2 > 0 and {x} ** 2 + {y} ** 2 + {z} ** 2 > 0 then round(degrees(atan2(sqrt(({across})::double), ({a} * {x} + {b} * {y} + {c} * {z})::double)), 6) end"


BENDS = f"""{F1}, {DEG}, t as (select a.s nid, a.d lo, b.d hi from adj a join adj b on a.s = b.s and a.d < b.d join deg on deg.nid = a.s where degree = 2),
u as (select t.*, l.x - n.x ux, l.y - n.y uy, l.z - n.z uz, h.x - n.x vx, h.y - n.y vy, h.z - n.z vz from t join n on n.nid = t.nid join n l on l.nid = lo join n h on h.nid = hi),
ang as (select nid, lo, hi, {_angle_sql(("ux", "uy", "uz"), ("vx", "vy", "vz"))} angle from u)"""


@query(f"with {BENDS} select nid, lo, hi, angle from ang")
def bend_angles(spark, d):
    return repair.bend_angles(*_f1(spark, d))


@query(f"with {BENDS} select nid from ang where angle < 100")
def sharp_bends(spark, d):
    return repair.sharp_bends(*_f1(spark, d)).select("nid")


@query(f"""with recursive {BENDS}, o as (select nid, lo, hi, row_number() over (order by nid) i from ang where angle < 100),
s(i, cut) as (select 0::bigint, []::bigint[] union all select o.i, case when list_contains(cut, lo) or list_contains(cut, hi) then cut else list_append(cut, nid) end from s join o on o.i = s.i + 1)
select unnest(cut) nid from s where i = (select max(i) from o)""")
def sharp_bends_in_order(spark, d):
    return repair.cut_in_order(repair.sharp_bends(*_f1(spark, d)))


def _candidates_sql(e: str) -> str:
    """Candidates (can) among the ends of the edges ``e`` of n."""
    return f"""cadj as (select src s, dst d from {e} union all select dst, src from {e}), cdeg as (select n.nid, count(cadj.s) degree from n left join cadj on cadj.s = n.nid group by 1),
tip as (select n.nid, x, y, z from cdeg join n using (nid) where degree = 1),
w(nid, step, pos, prev) as (select nid, 0::bigint, nid, -1::bigint from tip union all
  select w.nid, w.step + 1, cadj.d, w.pos from w join cadj on cadj.s = w.pos and cadj.d <> w.prev join cdeg on cdeg.nid = w.pos where w.step < 5 and degree <= 2),
one as (select a.nid, a.step, q.x - p.x dx, q.y - p.y dy, q.z - p.z dz from w a join w b on b.nid = a.nid and b.step = a.step + 1 join n p on p.nid = a.pos join n q on q.nid = b.pos),
way as (select nid, sum(dx) dx, sum(dy) dy, sum(dz) dz from one where step % 3 = 0 group by 1),
pr as (select a.nid src, b.nid dst, p.dx, p.dy, p.dz, q.dx ex, q.dy ey, q.dz ez, f.dx fx, f.dy fy, f.dz fz, g.dx gx, g.dy gy, g.dz gz, b.x - a.x ax, b.y - a.y ay, b.z - a.z az
  from tip a join tip b on a.nid < b.nid and abs(a.x - b.x) <= 6 and abs(a.y - b.y) <= 6 and abs(a.z - b.z) <= 6
  join way p on p.nid = a.nid join way q on q.nid = b.nid join one f on f.nid = a.nid and f.step = 0 join one g on g.nid = b.nid and g.step = 0
  where not exists (select 1 from w where w.nid = a.nid and w.pos = b.nid) and not exists (select 1 from w where w.nid = b.nid and w.pos = a.nid)),
sc as (select src, dst, {_angle_sql(("dx", "dy", "dz"), ("(-ex)", "(-ey)", "(-ez)"))} turn, {_angle_sql(("fx", "fy", "fz"), ("ax", "ay", "az"))} near, {_angle_sql(("gx", "gy", "gz"), ("(-ax)", "(-ay)", "(-az)"))} far from pr),
can as (select src, dst, turn, least(near, far) bend from sc where turn <= 45 and near >= 120 and far >= 120)"""


#: F1 folded into a cube of side FOLD, so that ends lie close enough to compete.
FOLD = 60
FOLDED = F1.replace("n as (", "n0 as (", 1).replace("from n)", "from n0)").replace(" from n0), e as", " from n0), e as") + f", n as (select * replace (x % {FOLD} as x, y % {FOLD} as y, z % {FOLD} as z) from n0)"


def _folded(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    n, e = _f1(spark, d)
    return n.withColumns({k: F.col(k) % FOLD for k in AXES}), e


@query(f"with recursive {F1}, {_candidates_sql('e')} select src, dst, turn, bend from can")
def connect_candidates(spark, d):
    return repair.connect_candidates(*_f1(spark, d))


MATCHED = """cr as materialized (select src, dst, turn, row_number() over (order by turn, src, dst) i from can),
mt(i, used, src, dst, turn) as (select 0::bigint, []::bigint[], null::bigint, null::bigint, null::double union all
  select cr.i, case when list_contains(used, cr.src) or list_contains(used, cr.dst) then used else list_concat(used, [cr.src, cr.dst]) end,
    case when list_contains(used, cr.src) or list_contains(used, cr.dst) then null else cr.src end, cr.dst, cr.turn from mt join cr on cr.i = mt.i + 1),
made as (select src, dst, turn from mt where src is not null)"""


@query(f"with recursive {FOLDED}, {_candidates_sql('e')}, {MATCHED} select src, dst, turn from made")
def matched_ends(spark, d):
    return repair.joined_ends(*_folded(spark, d))


BENT = f"""{FOLDED}, {DEG}, t as (select a.s nid, a.d lo, b.d hi from adj a join adj b on a.s = b.s and a.d < b.d join deg on deg.nid = a.s where degree = 2),
u as (select t.*, l.x - n.x ux, l.y - n.y uy, l.z - n.z uz, h.x - n.x vx, h.y - n.y vy, h.z - n.z vz from t join n on n.nid = t.nid join n l on l.nid = lo join n h on h.nid = hi),
ang as (select nid, lo, hi, {_angle_sql(("ux", "uy", "uz"), ("vx", "vy", "vz"))} angle from u),
bo as materialized (select nid, lo, hi, row_number() over (order by nid) i from ang where angle < 100),
bs(i, cut) as (select 0::bigint, []::bigint[] union all select bo.i, case when list_contains(cut, lo) or list_contains(cut, hi) then cut else list_append(cut, nid) end from bs join bo on bo.i = bs.i + 1),
gone as (select unnest(cut) nid from bs where i = (select max(i) from bs)), e1 as (select src, dst, creator from e where src not in (select nid from gone) and dst not in (select nid from gone)),
{_candidates_sql('e1')}, {MATCHED}"""


@query(f"with recursive {BENT} select src, dst, creator from e1 union all select src, dst, 'connector' from made")
def auto_connect(spark, d):
    return repair.auto_connect(*_folded(spark, d))[1]


@query(f"with recursive {BENT} select nid, cast(case when nid in (select src from made union all select dst from made) then -1 else checked end as bigint) checked from n")
def reopened_ends(spark, d):
    return repair.auto_connect(*_folded(spark, d))[0].select("nid", F.col("checked").cast("long"))


@query(f"with {F1} select src, dst, round(sqrt(((a.x - b.x) ** 2 + (a.y - b.y) ** 2 + (a.z - b.z) ** 2)::double), 6) length from e join n a on a.nid = src join n b on b.nid = dst")
def edge_lengths(spark, d):
    n, e = _f1(spark, d)
    return repair.edge_lengths(e, n)


@query(f"with {F1}, {SEGMENTS}, k as (select s.*, count(*) over (partition by sid) c from s) select sid, x, y, z from k where (ord % 3 = 0 and ord < c - 2) or ord = c - 1")
def down_sampled(spark, d):
    s = f1_segments(spark, d).groupBy("sid").agg(F.sort_array(F.collect_list(F.struct("ord", *AXES))).alias("p"))
    return s.select("sid", F.explode(every_third(F.col("p"))).alias("p")).select("sid", *(F.col(f"p.{k}") for k in AXES))


@query(f"""with recursive {F1}, {DEG}, w(nid, step, pos, prev) as (select nid, 0::bigint, nid, -1::bigint from deg where degree = 1 union all
select w.nid, w.step + 1, adj.d, w.pos from w join adj on adj.s = w.pos and adj.d <> w.prev join deg on deg.nid = w.pos where w.step < 4 and degree <= 2)
select w.nid, round(a.x + (a.x - b.x) / 4.0, 6)::double x, round(a.y + (a.y - b.y) / 4.0, 6)::double y, round(a.z + (a.z - b.z) / 4.0, 6)::double z from w join n a on a.nid = w.nid join n b on b.nid = w.pos where step = 4""")
def next_points(spark, d):
    return repair.next_points(*_f1(spark, d))


def brightest(track):
    """A model that reads the crop: to its first brightest voxel; nowhere in a dark one."""
    cube = track["crop"].iloc[0]
    at = np.unravel_index(int(cube.argmax()), cube.shape) if cube.any() else (16, 16, 16)
    return np.array([at]) - 16.0


@query(f"""with recursive {FOLDED.replace(f"z % {FOLD}", "z % 51").replace(f"x % {FOLD}", "x % 40").replace(f"y % {FOLD}", "y % 40")}, {DEG}, {F4},
w(nid, step, pos, prev) as (select nid, 0::bigint, nid, -1::bigint from deg where degree = 1 union all
select w.nid, w.step + 1, adj.d, w.pos from w join adj on adj.s = w.pos and adj.d <> w.prev join deg on deg.nid = w.pos where w.step < 4 and degree <= 2),
tip as (select n.nid, n.x, n.y, n.z from w join n on n.nid = w.nid where step = 4),
c as (select nid, arg_max((v.x, v.y, v.z), (v, -v.x, -v.y, -v.z)) p from tip join vox v on v.x >= tip.x - 16 and v.x < tip.x + 16 and v.y >= tip.y - 16 and v.y < tip.y + 16 and v.z >= tip.z - 16 and v.z < tip.z + 16 where v > 0 group by 1)
select tip.nid, coalesce(p[1], tip.x)::double x, coalesce(p[2], tip.y)::double y, coalesce(p[3], tip.z)::double z from tip left join c using (nid)""")
def next_points_by_image(spark, d):
    n, e = _f1(spark, d)
    inside = n.select("nid", (F.col("x") % 40).alias("x"), (F.col("y") % 40).alias("y"), (F.col("z") % 51).alias("z"))
    return repair.next_points(inside, e, model=brightest, voxels=f4_voxels(spark, d), image=[40, 40, 51])


@query(f"""with recursive {F1}, {DEG}, w(nid, step, pos, prev) as (select nid, 0::bigint, nid, -1::bigint from deg where degree = 1 union all
select w.nid, w.step + 1, adj.d, w.pos from w join adj on adj.s = w.pos and adj.d <> w.prev join deg on deg.nid = w.pos where w.step < 4 and degree <= 2),
k as (select nid, (select max(nid) from n) + row_number() over (order by nid) new from w where step = 4)
select src, dst, creator from e union all select nid, new, 'extend' from k""")
def extended_edges(spark, d):
    n, e = _f1(spark, d)
    return repair.extended(n, e, repair.next_points(n, e))[1]


def _interpolated(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """F1, folded into the volume, with its long edges replaced."""
    n, e = _f1(spark, d)
    inside = n.select("nid", (F.col("x") % 40).alias("x"), (F.col("y") % 40).alias("y"), (F.col("z") % 51).alias("z"), "creator", "type", "checked")
    return repair.interpolated(inside, e, f4_voxels(spark, d))


@query()
def interpolated_edges(spark, d):
    return _interpolated(spark, d)[1]


@query()
def interpolated_nodes(spark, d):
    return _interpolated(spark, d)[0]


# review


@query(f"with recursive {F1}, {GRAPH} select nid, comp from g where {PENDING}")
def pending(spark, d):
    return _g1(spark, d)[0].where(review.pending()).select("nid", "comp")


METER = f"{F1}, {GRAPH}, m as (select comp, count(*) size, count(*) filter ({PENDING}) pending from g group by 1)"


@query(f"with recursive {METER} select comp, size, pending from m")
def component_meter(spark, d):
    return review.meter(_g1(spark, d)[0])


@query(f"with recursive {METER}, t as (select comp, size from m where pending > 0 order by size desc, comp limit 1) select comp, size, min(nid) nid from g join t using (comp) where {PENDING} group by 1, 2")
def next_task(spark, d):
    return review.next_task(_g1(spark, d)[0])


@query(f"""with recursive {F1}, c as (select x, y, z from n where nid = 500), blk as (select nid, type from n, c where abs(n.x - c.x) <= 150 and abs(n.y - c.y) <= 150 and abs(n.z - c.z) <= 150),
be as (select src, dst from e where src in (select nid from blk) and dst in (select nid from blk)), ba as (select src s, dst d from be union all select dst, src from be),
br(nid, m) as (select nid, nid from blk union select ba.d, br.m from br join ba on ba.s = br.nid), bc as (select nid, min(m) comp from br group by 1)
select nid, comp, case when nid = 500 then 'centre' when type = 1 then 'soma' else 'node' end marker from bc join blk using (nid)""")
def local_view(spark, d):
    n, e = _f1(spark, d)
    return review.local_view(n, e, 500, 150)


@query(f"""with {F1}, c as (select x, y, z from n where nid = 500), blk as (select nid from n, c where abs(n.x - c.x) <= 150 and abs(n.y - c.y) <= 150 and abs(n.z - c.z) <= 150)
select distinct src, dst, b.x - a.x dx, b.y - a.y dy, b.z - a.z dz from e join n a on a.nid = src join n b on b.nid = dst where src in (select nid from blk) or dst in (select nid from blk)""")
def local_edges(spark, d):
    return review.local_edges(*_f1(spark, d), 500, 150)


@query(f"with recursive {F1}, {GRAPH} select nid, comp from g where comp in (select comp from g group by 1 having count(*) > 10)")
def overview(spark, d):
    return review.overview(*_g1(spark, d))[0].select("nid", "comp")


@query(f"with recursive {F1}, {GRAPH}, k as (select nid from g where nid % 9 <> 0 and comp in (select comp from g where nid % 9 <> 0 group by 1 having count(*) > 10)) select src, dst, creator from e where src in (select nid from k) and dst in (select nid from k)")
def overview_edges(spark, d):
    n, e = _g1(spark, d)
    return review.overview(n.where("nid % 9 <> 0"), e)[1]


@query(f"with {F3.replace('n as (', 'p as (')}, {F4} select cast(least(floor(avg(v) / 2), 200) as bigint) lo, round(avg(v) + stddev_pop(v), 4) hi from p join vox on abs(p.x) % 40 = vox.x and abs(p.y) % 40 = vox.y and abs(p.z) % 40 = vox.z")
def contrast(spark, d):
    p = f3_points(spark, d).select("nid", *((F.abs(k) % 40).alias(k) for k in AXES))
    return review.contrast(p, f4_voxels(spark, d))


# voxels


TILE = "x // 16 tx, y // 16 ty, z // 16 tz"


def _tiled(spark, d):
    return f4_voxels(spark, d).select("*", *(F.floor(F.col(k) / 16).alias("t" + k) for k in AXES))


@query(f"with {F4}, t as (select *, {TILE} from vox), m as (select tx, ty, tz, min(v) lo, max(v) hi from t group by 1, 2, 3) select x, y, z, round(case when hi > lo then (v - lo) / (hi - lo)::double else 0.0 end, 6) norm from t join m using (tx, ty, tz)")
def min_max(spark, d):
    return voxels.min_max(_tiled(spark, d), "tx", "ty", "tz").select(*AXES, F.round("norm", 6).alias("norm"))


CLIP = f"""{F4}, t as (select *, {TILE} from vox), o as (select *, row_number() over (partition by tx, ty, tz order by v) - 1 i, count(*) over (partition by tx, ty, tz) c from t),
m as (select tx, ty, tz, min(v) lo, min(case when i = greatest(cast(floor(c * 0.9999::double) as bigint) - 1, 0) then v end) hi from o group by 1, 2, 3)"""


@query(f"with {CLIP} select x, y, z, round(case when hi > lo then (least(v, hi) - lo) / (hi - lo)::double else 0.0 end, 6) norm from t join m using (tx, ty, tz)")
def clip_normalise(spark, d):
    return voxels.clip_normalise(_tiled(spark, d), "tx", "ty", "tz").select(*AXES, F.round("norm", 6).alias("norm"))


@query(f"with {CLIP} select x, y, z, cast(case when hi > lo then least(v, hi) else lo end as bigint) v from t join m using (tx, ty, tz)")
def denormalise(spark, d):
    back = voxels.denormalise(voxels.clip_normalise(_tiled(spark, d), "tx", "ty", "tz"))
    return back.select(*AXES, F.col("v").cast("long"))


SCORED = f"{F4}, {HALO}, m as (select tx, ty, tz, min(v) lo, max(v) hi from tile group by 1, 2, 3), sc as (select x, y, z, v, case when hi > lo then (v - lo) / (hi - lo)::double else 0.0 end norm from tile join m using (tx, ty, tz) where core)"


@query(f"with {SCORED} select x, y, z, v, round(norm, 6) norm from sc")
def score_tiles(spark, d):
    return voxels.score_tiles(f4_voxels(spark, d), 16).withColumn("norm", F.round("norm", 6))


def _block_volume() -> str:
    return " * ".join(f"(least({n}, t{k} * 16 + 20) - greatest(0, t{k} * 16 - 4))" for k, n in zip("xyz", (40, 40, 51), strict=True))


@query(f"""with {F4}, {HALO}, m as (select tx, ty, tz, case when count(*) < {_block_volume()} then 0 else min(v) end lo, max(v) hi from tile group by 1, 2, 3)
select x, y, z, v, round(case when hi > lo then (v - lo) / (hi - lo)::double else 0.0 end, 6) norm from tile join m using (tx, ty, tz) where core""")
def score_dense(spark, d):
    return dense.score_dense(f4_voxels(spark, d), [40, 40, 51], 16).withColumn("norm", F.round("norm", 6))


@query(f"with {SCORED} select x, y, z, v from sc where norm >= 0.5 and v > 20000")
def mask(spark, d):
    return voxels.mask(voxels.score_tiles(f4_voxels(spark, d), 16), background=20000).select(*AXES, "v")


def _bright(spark, d):
    """What a background threshold of 45,000 leaves."""
    return f4_voxels(spark, d).where("v > 45000")


@query(f"""with recursive {F4}, b as (select (x::bigint * 1048576 + y) * 1048576 + z nid, x, y, z from vox where v > 45000), o as (select unnest(generate_series(-1, 1)) i),
nb as (select nid s, x + i.i x, y + j.i y, z + k.i z from b, o i, o j, o k), adj as (select s, b.nid d from nb join b using (x, y, z) where s <> b.nid),
r(nid, m) using key (nid) as (select nid, nid from b union select adj.d, min(r.m) from r join adj on adj.s = r.nid join recurring.r old on old.nid = adj.d where r.m < old.m group by 1),
z as (select m region, count(*) size from r group by 1 having count(*) >= 50) select x, y, z, region, size from b join r using (nid) join z on region = m""")
def regions(spark, d):
    return voxels.large_regions(_bright(spark, d)).select(*AXES, "region", "size")


@query()
def skeleton_segments(spark, d):
    return voxels.skeleton_segments(_bright(spark, d))


@query()
def process_volume(spark, d):
    return voxels.process_volume(f4_voxels(spark, d), 16, background=45_000)


@query(f"with {F4}, s as (select * from vox), o as (select unnest(generate_series(-5, 5)) i), ball as (select a.i dx, b.i dy, c.i dz from o a, o b, o c where a.i * a.i + b.i * b.i + c.i * c.i <= 25), p as (select s.x, s.y, s.z, s.v, ((s.x + dx) % 78 + 78) % 78 sx, ((s.y + dy) % 78 + 78) % 78 sy, ((s.z + dz) % 100 + 100) % 100 sz from s, ball), q as (select x, y, z, v, case when sx < 40 then sx else 78 - sx end sx, case when sy < 40 then sy else 78 - sy end sy, case when sz < 51 then sz else 100 - sz end sz from p) select q.x, q.y, q.z, q.v, round(count(*) filter (coalesce(w.v, 0) < q.v) / (select count(*) from ball)::double, 6) rank, round((q.v - (select min(v) from s)) / ((select max(v) from s) - (select min(v) from s))::double, 6) norm from q left join s w on w.x = sx and w.y = sy and w.z = sz group by 1, 2, 3, 4")
def rank_filter(spark, d):
    return voxels.rank_filter(f4_voxels(spark, d), [40, 40, 51])


def _image(spark, d, name):
    return f5_images(spark, d).where(F.col("image") == name).drop("image")


@query(f"with {F5} select x, y, z, max(v) v from img where image in ('A', 'N') group by 1, 2, 3")
def overlay(spark, d):
    return voxels.overlay(_image(spark, d, "A"), _image(spark, d, "N"))


@query(f"with {F5} select x, y, z, max(case when v > 20000 then 1 else 0 end) m from img where image in ('A', 'R') group by 1, 2, 3")
def union_masks(spark, d):
    m = [_image(spark, d, i).select(*AXES, (F.col("v") > 20000).cast("int").alias("m")) for i in "AR"]
    return voxels.union_masks(*m)


@query(f"""with {F5}, s as (select v, sum(count(*)) over (order by v) / (sum(count(*)) over ())::double q from img where image = 'A' group by v),
t as (select v, sum(count(*)) over (order by v) / (sum(count(*)) over ())::double q from img where image = 'N' group by v),
k as (select s.v, s.q, (select max(t.q) from t where t.q <= s.q) q0, (select min(t.q) from t where t.q >= s.q) q1 from s)
select k.v::bigint v, cast(floor(round(coalesce(case when k.q1 > k.q0 then a.v + (k.q - k.q0) / (k.q1 - k.q0) * (b.v - a.v) else a.v::double end, b.v, a.v), 6)) as bigint) as to_v from k left join t a on a.q = k.q0 left join t b on b.q = k.q1""")
def histogram_match(spark, d):
    return voxels.match_histogram(_image(spark, d, "A"), _image(spark, d, "N")).withColumnRenamed("to", "to_v")


def _files(spark, d):
    c = spark.read.parquet(f"{d}/customer.parquet").select("c_custkey")
    return c.select(F.concat(F.when(F.col("c_custkey") % 2 == 0, "img_").otherwise("mask_"), (F.col("c_custkey") % 61).cast("string"), F.lit(".tif")).alias("name"))


@query("with f as (select case when c_custkey % 2 = 0 then 'img' else 'mask' end kind, cast(c_custkey % 61 as varchar) id from customer) select id from f group by 1 having count(distinct kind) = 2")
def image_pairs(spark, d):
    return augment.paired(_files(spark, d))


def _triples_sql(ids: str, n: int) -> str:
    """Draws (r) of three of ``ids``."""
    h = [f"cast('0x' || substr(md5('0:' || sample || ':{k}'), 1, 13) as bigint) % ((select count(*) from nm) - {k})" for k in range(3)]
    return f"""nm as (select id, row_number() over (order by id) - 1 i from ({ids})), dr as (select unnest(generate_series(1, {n})) sample),
d1 as (select sample, {h[0]} a, {h[1]} b, {h[2]} c from dr), d2 as (select sample, a, b + (b >= a)::int b, c from d1),
d3 as (select sample, a, b, c + (c >= least(a, b))::int c, greatest(a, b) top from d2), d4 as (select sample, a, b, c + (c >= top)::int c from d3),
r as (select sample::int as sample, place, id from (select sample, 1 place, a i from d4 union all select sample, 2, b from d4 union all select sample, 3, c from d4) join nm using (i))"""


@query(f"""with f as (select case when c_custkey % 2 = 0 then 'img' else 'mask' end kind, cast(c_custkey % 61 as varchar) id from customer),
{_triples_sql("select id from f group by 1 having count(distinct kind) = 2", 20)} select sample, place, id from r""")
def image_triples(spark, d):
    return augment.triples(augment.paired(_files(spark, d)), 20)


def _drawn_sql(tiles: str, n: int) -> str:
    """bl: ``n`` of ``tiles`` (roi, x0, y0, z0) at the first places of a keyed permutation."""

    def turned(rows: str) -> str:
        out = f"select number, x // b l, x % b r, a, b, n from ({rows})"
        for k in range(4):
            to, by, most = ("l", "r", "a") if k % 2 == 0 else ("r", "l", "b")
            out = f"select * replace (({to} + cast('0x' || substr(md5('0:{k}:' || {by}), 1, 13) as bigint)) % {most} as {to}) from ({out})"
        return f"select number, l * b + r x, a, b, n from ({out})"

    return f"""ti as (select row_number() over (order by roi, x0, y0, z0) - 1 i, * from ({tiles})), cn as (select count(*) n, cast(ceil(sqrt(count(*))) as bigint) a from ti),
tu(number, x, a, b, n) as ({turned(f"select unnest(generate_series(1, least({n}, n))) number, number - 1 x, a, (n + a - 1) // a b, n from cn")} union all {turned("select * from tu where x >= n")}),
bl as (select number::int number, ti.* exclude (i) from tu join ti on i = x where x < n)"""


@query("with recursive " + _drawn_sql(_tiles_sql("cast(floor({} / 128.0) as bigint)", True), 50) + " select * from bl")
def background_blocks(spark, d):
    return augment.background_blocks(_rois(spark, d), 128, 50)


#: Background images: seven, of lineitem's line numbers, 300 x 260 x 130 voxels.
BACK_SIZE = (300, 260, 130)
BACK = """back as (select l_linenumber::bigint roi, (l_partkey % 300)::int x, (l_suppkey % 260)::int y, (l_orderkey % 130)::int z, cast(max(floor(l_extendedprice / 2)) as int) v from lineitem group by 1, 2, 3, 4),
""" + _drawn_sql("select distinct roi, tx * 128 x0, ty * 128 y0, 0 z0 from back, (select unnest(generate_series(0, 1)) tx), (select unnest(generate_series(0, 1)) ty)", 10)


@query(f"""with recursive {F5}, {BACK}, {_triples_sql("select distinct image id from img", 4)},
ov as (select sample, x, y, z, max(v) v from img join r on image = id where place < 3 group by all), mk as (select sample, x, y, z, max(case when v > 20000 then 1 else 0 end) m from img join r on image = id where place < 3 group by all),
s as (select sample, v, sum(count(*)) over (partition by sample order by v) / (sum(count(*)) over (partition by sample))::double q from ov group by sample, v),
t as (select sample, v, sum(count(*)) over (partition by sample order by v) / (sum(count(*)) over (partition by sample))::double q from img join r on image = id where place = 3 group by sample, v),
lo as (select s.*, t.v r0, t.q q0 from s asof left join t on s.sample = t.sample and s.q >= t.q), hi as (select lo.*, t.v r1, t.q q1 from lo asof left join t on lo.sample = t.sample and lo.q <= t.q),
k as (select sample, v, cast(floor(round(coalesce(case when q1 > q0 then r0 + (q - q0) / (q1 - q0) * (r1 - r0) else r0::double end, r1, r0), 6)) as bigint) tv from hi)
select ov.sample, ov.x, ov.y, ov.z, k.tv v, m from ov join k using (sample, v) join mk on mk.sample = ov.sample and mk.x = ov.x and mk.y = ov.y and mk.z = ov.z
union all select number + 4, x - x0, y - y0, z - z0, v, 0 from bl join back on back.roi = bl.roi and x >= x0 and x < x0 + 128 and y >= y0 and y < y0 + 128 and z >= z0 and z < z0 + 128""")
def generated_set(spark, d):
    images = f5_images(spark, d)
    names = images.select("image").distinct()
    files = names.select(F.concat(F.lit("img_"), "image", F.lit(".tif")).alias("name")).union(names.select(F.concat(F.lit("mask_"), "image", F.lit(".tif"))))
    masks = images.select("image", *AXES, (F.col("v") > 20000).cast("int").alias("m"))
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    at = {k: (F.col(c) % n).cast("int").alias(k) for k, c, n in zip(AXES, ("l_partkey", "l_suppkey", "l_orderkey"), BACK_SIZE, strict=True)}
    back = saved(li.groupBy(F.col("l_linenumber").cast("long").alias("roi"), *at.values()).agg(F.max(F.floor(F.col("l_extendedprice") / 2)).cast("int").alias("v")), "back")
    rois = back.select("roi").distinct().select("roi", *(F.lit(0).cast("long").alias(f"{k}0") for k in AXES), *(F.lit(n).cast("long").alias(f"s{k}") for k, n in zip(AXES, BACK_SIZE, strict=True)))
    return augment.gen_dataset(images, masks, files, back, rois, 4, 10)
