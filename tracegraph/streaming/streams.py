"""Edits and tiles as streams."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tracegraph.operators.edits import apply_summaries, merged_summaries, summaries
from tracegraph.operators.voxels import default_scorer, mask, score_haloed, skeleton_segments, tile_segments
from tracegraph.store import forget, saved

NODE = "nid long, fate string, fate_seq long, gone long, kind long, kind_seq long, flag int, flag_seq long"
PAIR = "a long, b long, action string, seq long, cut boolean"


class _Folder:
    """Finished tables of a folder, named by the batches they hold (first-last)."""

    def __init__(self, spark: SparkSession, root: str):
        self.root, path = root, spark._jvm.org.apache.hadoop.fs.Path
        self.path, self.fs = path, path(root).getFileSystem(spark._jsc.hadoopConfiguration())

    def spans(self) -> list[tuple[int, int]]:
        """The widest finished ones: none lies inside another."""
        if not self.fs.exists(self.path(self.root)):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(self.path(self.root))]
        found = [tuple(map(int, x.split("-"))) for x in names if re.fullmatch(r"\d+-\d+", x) and self.fs.exists(self.path(f"{self.root}/{x}/pair/_SUCCESS"))]
        return sorted(s for s in found if not any(t != s and t[0] <= s[0] and s[1] <= t[1] for t in found))

    def read(self, spark: SparkSession, spans: list[tuple[int, int]]) -> tuple[DataFrame, DataFrame]:
        if not spans:
            return spark.createDataFrame([], NODE), spark.createDataFrame([], PAIR)
        out = [spark.read.schema(schema).parquet(*(f"{self.root}/{a}-{b}/{part}" for a, b in spans)) for part, schema in (("node", NODE), ("pair", PAIR))]
        return out[0], out[1]

    def write(self, node: DataFrame, pair: DataFrame, span: tuple[int, int]) -> None:
        for name, df in (("node", node), ("pair", pair)):
            df.write.mode("overwrite").parquet(f"{self.root}/{span[0]}-{span[1]}/{name}")

    def delete(self, span: tuple[int, int]) -> None:
        self.fs.delete(self.path(f"{self.root}/{span[0]}-{span[1]}"), True)


def submit(batch: DataFrame, batch_id: int, out: str) -> None:
    """Adds a batch of edits to the state in ``out``: its summary, a row for each node and pair, joins those of the batches
    before as the digits of a binary counter carry, so that a row is merged again a number of times that grows with the
    logarithm of the number of batches, and there are as few tables. A batch that runs again changes nothing."""
    spark = batch.sparkSession
    folder = _Folder(spark, f"{out}/state")
    if any(a <= batch_id <= b for a, b in folder.spans()):
        spans = folder.spans()
    else:
        node, pair = summaries(batch)
        folder.write(*(df.select(*(F.col(c.split()[0]).cast(c.split()[1]) for c in schema.split(", "))) for df, schema in ((node, NODE), (pair, PAIR))), (batch_id, batch_id))
        spans = folder.spans()
    while len(spans) > 1 and spans[-2][1] - spans[-2][0] <= spans[-1][1] - spans[-1][0]:
        two = spans[-2:]
        both = (two[0][0], two[1][1])
        folder.write(*merged_summaries(*folder.read(spark, two)), both)
        for s in two:
            folder.delete(s)
        spans = folder.spans()


def edit_stream(spark: SparkSession, path: str, schema: str, out: str, checkpoint: str) -> StreamingQuery:
    """Adds each micro-batch of edits to the state in ``out``; its work is that of the batch and of the merges due
    (``submit``), not of all edits so far. A restart goes on from the state, and neither loses nor doubles edits."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.writeStream.foreachBatch(lambda batch, n: submit(batch, n, out)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def state(spark: SparkSession, schema: str, nodes: DataFrame, edges: DataFrame, out: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges after all edits so far: a row for each node and pair that was ever edited is read, not the log."""
    folder = _Folder(spark, f"{out}/state")
    return apply_summaries(nodes, edges, *merged_summaries(*folder.read(spark, folder.spans())))


def tile_stream(
    spark: SparkSession, path: str, schema: str, out: str, checkpoint: str, scorer: Callable = default_scorer, background: int = 150, longer_than: int = 6,
    size: int | None = None, image: list[int] | None = None, least: int = 50,
) -> StreamingQuery:
    """Scores tiles as files arrive and appends the segments (sid, ord, x, y, z) of their masks, each inside its tile, and a
    line of progress (batch, tiles, segments). Each file holds whole tiles, so no state is kept between them; a batch that
    runs again writes the same folders.

    Tiles are rows (tile, x, y, z, v). With ``size``, they are cubes of that side of an image (sizes ``image``) with their
    halos, rows (tx, ty, tz, x, y, z, v, core), and become the segments that ``voxels.process_volume`` gives with ``clip``:
    small regions go and the tile's border is cleared."""

    def score(tile: pd.DataFrame) -> pd.DataFrame:
        tile["norm"] = scorer(tile)
        return tile[(tile["norm"] >= 0.5) & (tile["v"] > background)]

    def batch(df: DataFrame, batch_id: int) -> None:
        if size is None:
            kinds = ", ".join(f"{n} {t}" for n, t in df.dtypes)
            found = saved(df.groupBy("tile").applyInPandas(score, f"{kinds}, norm double"), "mask")
            made, tiles = skeleton_segments(found, longer_than, "tile"), F.count_distinct("tile")
        else:
            found = saved(mask(score_haloed(df, scorer), background=background).select("x", "y", "z"), "mask")
            made, tiles = tile_segments(found, size, image, least, longer_than), F.count_distinct("tx", "ty", "tz")
        made.write.mode("overwrite").parquet(f"{out}/segments/batch={batch_id}")
        segments = df.sparkSession.read.schema("sid long").parquet(f"{out}/segments/batch={batch_id}")
        progress = df.agg(tiles.alias("tiles")).crossJoin(segments.agg(F.count_distinct("sid").alias("segments")))  # one row each
        progress.write.mode("overwrite").parquet(f"{out}/progress/batch={batch_id}")
        forget(found)

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)
    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
