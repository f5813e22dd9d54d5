"""Readers, importers and writers of nodes, edges, segments, swc text and voxel tiles."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tracegraph.functions.geometry import AXES
from tracegraph.operators.components import star_edges
from tracegraph.operators.graph import rooted_forest
from tracegraph.operators.grid import mirror
from tracegraph.operators.numbers import numbered, summed_before


def read(spark: SparkSession, path: str, where: str | None = None) -> DataFrame:
    """A table, with a predicate that goes down to the scan."""
    out = spark.read.parquet(path)
    return out.where(where) if where else out


def not_by(edges: DataFrame, creator: str = "seger") -> DataFrame:
    """Edges made by anyone else; a null creator drops out."""
    return edges.where(F.col("creator") != creator)


def parse_segments(segments: DataFrame) -> DataFrame:
    """(sid, ord, x, y, z) of segments whose points are text, ``[[x,y,z],...]``."""
    pts = segments.select("sid", F.posexplode(F.from_json("points", "array<array<double>>")).alias("ord", "p"))
    return pts.select("sid", F.col("ord").cast("long"), *(F.col("p")[i].alias(k) for i, k in enumerate(AXES)))


def ingest_segments(points: DataFrame, first_nid: int = 0) -> tuple[DataFrame, DataFrame]:
    """Nodes and chained edges of segments (sid, ord, x, y, z); nids follow ``first_nid`` in (sid, ord) order."""
    nodes = numbered(points, "nid", "sid", "ord").withColumn("nid", F.col("nid") + first_nid)
    nodes = nodes.select("nid", "sid", "ord", *AXES, F.lit("seger").alias("creator"), F.lit(1).alias("status"), F.lit(0).alias("type"), F.lit(0).alias("checked"))
    nxt = F.lead("nid").over(W.partitionBy("sid").orderBy("ord"))
    edges = nodes.select(F.col("nid").alias("src"), nxt.alias("dst"), "creator").where("dst is not null")
    return nodes.drop("ord"), edges


def new_segments(points: DataFrame, max_sid: int, max_version: int, date: str) -> DataFrame:
    """``points`` (sid, ord, x, y, z) of segments to be taken into a store: sids go on from ``max_sid`` in their own order,
    and all get the next version and the date."""
    ids = numbered(points.select("sid").distinct(), "new", "sid").withColumn("new", F.col("new") + max_sid)
    return points.join(ids, "sid").select(F.col("new").alias("sid"), "ord", *AXES, F.lit(max_version + 1).cast("long").alias("version"), F.lit(date).alias("date"))


def read_swc(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): the lines of all swc files of a folder, each with the name of its file."""
    lines = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.swc").text(path)
    return lines.select(F.col("_metadata.file_name").alias("file"), "value")


def parse_swc(lines: DataFrame) -> DataFrame:
    """(file, n, type, x, y, z, parent) of swc lines (file, value); comments and blank lines go."""
    f = F.split(F.trim("value"), r"\s+")
    body = lines.where("trim(value) <> '' and not startswith(trim(value), '#')")
    return body.select("file", f[0].cast("long").alias("n"), f[1].cast("int").alias("type"), *(f[i + 2].cast("double").alias(k) for i, k in enumerate(AXES)), f[6].cast("long").alias("parent"))


def import_swc(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of parsed swc files with exactly one soma; ids move up by the highest id before, plus 2, for each
    file in order of its name. A root's parent gives no edge."""
    good = rows.groupBy("file").agg(F.count_if(F.col("type") == 1).alias("somas"), F.max("n").alias("top")).where("somas = 1")
    moved = rows.join(summed_before(good.select("file", (F.col("top") + 2).alias("size")), "size", "base", "file").select("file", "base"), "file")
    nodes = moved.select((F.col("n") + F.col("base")).alias("nid"), *AXES, (F.col("type") == 1).cast("int").alias("type"), F.lit(1).alias("checked"), "file")
    edges = moved.where("parent > 0").select((F.col("n") + F.col("base")).alias("src"), (F.col("parent") + F.col("base")).alias("dst"), F.lit("terafly").alias("creator"))
    return nodes, edges


def swc_lines(nodes: DataFrame, edges: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """(file, nid, value): a rooted tree for each component of ``nodes`` (with comp), from its least soma, else its least
    node; the file's prefix tells no soma, one or many. ``found``: what ``star_edges`` gives for ``edges``, if it is there."""
    per = nodes.groupBy("comp").agg(F.count_if(F.col("type") == 1).alias("somas"), F.min(F.when(F.col("type") == 1, F.col("nid"))).alias("soma"), F.min("nid").alias("least"))
    roots = per.select("comp", "somas", F.coalesce("soma", "least").alias("root"))
    parents = rooted_forest(edges, roots.select(F.col("root").alias("nid")), star_edges(edges) if found is None else found)
    prefix = F.when(F.col("somas") == 0, "no_soma_").when(F.col("somas") == 1, "").otherwise("many_soma_")
    rows = nodes.join(parents, "nid").join(roots, "comp")
    value = F.format_string("%d %d %.1f %.1f %.1f 1.0 %d", "nid", F.col("type").cast("int"), *(F.col(k).cast("double") for k in AXES), "parent")
    return rows.select(F.concat(prefix, F.lit("neuron_"), F.col("root").cast("string"), F.lit(".swc")).alias("file"), "nid", value.alias("value"))


def total_length(lines: DataFrame) -> DataFrame:
    """(file, length): three voxels a node, the spacing at which chains are sampled."""
    return lines.groupBy("file").agg((F.count(F.lit(1)) * 3).alias("length"))


def write_swc(lines: DataFrame, path: str) -> None:
    """A folder of text for each file; lines in order of nid."""
    lines.repartition("file").sortWithinPartitions("file", "nid").select("file", "value").write.partitionBy("file").text(path)


def migrate(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Old tables to new: coordinates from text, cut to whole numbers; the two directions of an edge folded to one, of
    which the earliest date, then the least creator, stays."""
    c = F.from_json("coord", "array<double>")
    new = nodes.select("nid", *(c[i].cast("int").cast("long").alias(k) for i, k in enumerate(AXES)), "creator", "type", "checked", "status")
    lo, hi = F.least("src", "des"), F.greatest("src", "des")
    folded = edges.groupBy(lo.alias("src"), hi.alias("dst")).agg(F.min(F.struct("date", "creator")).alias("k"))
    return new, folded.select("src", "dst", "k.creator", "k.date")


def profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n_columns, n_rows) of each table."""
    out = None
    for name, df in tables.items():
        row = df.agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(name).alias("name"), F.lit(len(df.columns)).cast("long").alias("n_columns"), "n_rows")
        out = row if out is None else out.unionAll(row)
    return out


def column_profile(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, place, column, type, nullable, n_rows, n_null, is_key) of each column; is_key: no value is null or occurs twice."""
    out = None
    for name, df in tables.items():
        for i, f in enumerate(df.schema):
            counts = df.groupBy(F.col(f"`{f.name}`").alias("v")).agg(F.count(F.lit(1)).alias("n"))
            row = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"), F.coalesce(F.sum(F.when(F.col("v").isNull(), F.col("n"))), F.lit(0)).alias("n_null"), F.coalesce(F.max("n"), F.lit(0)).alias("most"))
            row = row.select(
                F.lit(name).alias("name"), F.lit(i).cast("long").alias("place"), F.lit(f.name).alias("column"), F.lit(f.dataType.simpleString()).alias("type"), F.lit(f.nullable).alias("nullable"),
                "n_rows", "n_null", ((F.col("most") <= 1) & (F.col("n_null") == 0)).alias("is_key"),
            )
            out = row if out is None else out.unionAll(row)
    return out


def slab(voxels: DataFrame, low: list[int], high: list[int]) -> DataFrame:
    """Voxels in the half-open box from ``low`` to ``high``."""
    for k, a, b in zip(AXES, low, high, strict=True):
        voxels = voxels.where((F.col(k) >= a) & (F.col(k) < b))
    return voxels


def crop(voxels: DataFrame, low: list[int], size: list[int], image: list[int], padding: str = "constant") -> DataFrame:
    """(x, y, z, v) of every voxel of a box, coordinates from its origin; outside the image (sizes ``image``) 0, or, with
    padding ``reflect``, the mirrored voxel. A voxel without a row is 0."""
    spark = voxels.sparkSession
    box = spark.range(1).select(F.lit(0).alias("_"))
    for k, n in zip(AXES, size, strict=True):
        box = box.withColumn(k, F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    for k, o, n in zip(AXES, low, image, strict=True):
        at = F.col(k) + o
        at = mirror(at, F.lit(n)) if padding == "reflect" else F.when((at >= 0) & (at < n), at)
        box = box.withColumn("s" + k, at)
    found = voxels.select(*(F.col(k).alias("s" + k) for k in AXES), "v")
    return box.join(found, ["sx", "sy", "sz"], "left").select(*(F.col(k).cast("long").alias(k) for k in AXES), F.coalesce("v", F.lit(0)).cast("long").alias("v"))


def levels(spark: SparkSession, sizes: list[int], origin: list[float]) -> DataFrame:
    """(level, spacing, sx, sy, sz, ox, oy, oz): five levels, each half as fine."""
    rows = [(i, float(1 << i), *(s >> i for s in sizes), *(int(o / (1 << i)) for o in origin)) for i in range(5)]
    return spark.createDataFrame(rows, "level long, spacing double, sx long, sy long, sz long, ox long, oy long, oz long")


def level_info(sizes: DataFrame, low: list[float] | None = None, high: list[float] | None = None) -> DataFrame:
    """``sizes`` (level, sx, sy, sz), the voxels of an image at each level, with its spacing on each axis (px, py, pz), the
    physical extent from ``low`` to ``high`` over its size, and the image's origin (ox, oy, oz), the corner ``low`` in
    voxels. Without an extent the voxels of level 0 are the unit and the origin is 0."""
    if low is None or high is None:
        base = sizes.where("level = 0").select(*(F.col("s" + k).cast("double").alias("w" + k) for k in AXES), *(F.lit(0.0).alias("l" + k) for k in AXES))
        out = sizes.crossJoin(F.broadcast(base))  # one row
    else:
        out = sizes.select("*", *(F.lit(float(h - a)).alias("w" + k) for k, a, h in zip(AXES, low, high, strict=True)), *(F.lit(float(a)).alias("l" + k) for k, a in zip(AXES, low, strict=True)))
    out = out.select("*", *((F.col("w" + k) / F.col("s" + k)).alias("p" + k) for k in AXES))
    # the origin is cut to whole units first, then to whole voxels
    return out.select(*sizes.columns, *("p" + k for k in AXES), *((F.col("l" + k).cast("long") / F.col("p" + k)).cast("long").alias("o" + k) for k in AXES))


def raster_tiles(points: DataFrame, size: int = 16) -> DataFrame:
    """(tx, ty, tz, n): the distinct voxels of points (x, y, z) by tile."""
    cells = points.select(*(F.col(k).cast("int").cast("long").alias(k) for k in AXES)).distinct()
    return cells.groupBy(*(F.floor(F.col(k) / size).alias("t" + k) for k in AXES)).agg(F.count(F.lit(1)).alias("n"))


def mask_volume(points: DataFrame, image: list[int], size: int = 16) -> DataFrame:
    """(tx, ty, tz, data): the tiles of side ``size`` of a 0/1 volume with the image's shape, a byte a voxel, x first, 1 at
    the voxels of ``points``; the last tiles are clipped. Points outside the image are left out. A task holds a tile."""
    counts = [-(-n // size) for n in image]
    tiles = points.sparkSession.range(counts[0] * counts[1] * counts[2]).select(
        F.floor(F.col("id") / (counts[1] * counts[2])).alias("tx"), (F.floor(F.col("id") / counts[2]) % counts[1]).alias("ty"), (F.col("id") % counts[2]).alias("tz")
    )
    cells = points.select(*(F.floor(k).cast("long").alias(k) for k in AXES)).distinct()
    for k, n in zip(AXES, image, strict=True):
        cells = cells.where((F.col(k) >= 0) & (F.col(k) < n))
    cells = cells.select(*(F.floor(F.col(k) / size).alias("t" + k) for k in AXES), *AXES)

    def run(cube: pd.DataFrame) -> pd.DataFrame:
        corner = [int(cube["t" + k].iloc[0]) * size for k in AXES]
        volume = np.zeros([min(size, n - c) for n, c in zip(image, corner, strict=True)], np.uint8)
        own = cube.dropna(subset=list(AXES))
        volume[tuple(own[k].to_numpy(np.int64) - c for k, c in zip(AXES, corner, strict=True))] = 1
        return pd.DataFrame([(*(c // size for c in corner), volume.tobytes())], columns=["tx", "ty", "tz", "data"])

    return tiles.join(cells, ["tx", "ty", "tz"], "left").groupBy("tx", "ty", "tz").applyInPandas(run, "tx long, ty long, tz long, data binary")


def write_mask(tiles: DataFrame, path: str) -> None:
    """A raster's tiles as a table, a folder for each slab of tiles."""
    tiles.repartition("tx").write.partitionBy("tx").parquet(path)


def unpacked_mask(tiles: DataFrame, image: list[int], size: int = 16) -> DataFrame:
    """(x, y, z, m): every voxel of a 0/1 volume's tiles."""
    wide = {k: F.least(F.lit(size), F.lit(n) - F.col("t" + k) * size) for k, n in zip(AXES, image, strict=True)}
    digits = tiles.select("tx", "ty", "tz", F.posexplode(F.split(F.regexp_replace(F.hex("data"), "0([01])", "$1"), "")).alias("i", "m")).where("m <> ''")
    i = F.col("i")
    x, y, z = F.floor(i / (wide["y"] * wide["z"])), F.floor(i / wide["z"]) % wide["y"], i % wide["z"]
    return digits.select(*((F.col("t" + k) * size + v).cast("long").alias(k) for k, v in (("x", x), ("y", y), ("z", z))), F.col("m").cast("long").alias("m"))
