"""Augmented image sets: pairs of images and masks, seeded draws, background blocks, and the whole set in one job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracegraph.functions.geometry import AXES
from tracegraph.operators.numbers import numbered, permuted, summed_before
from tracegraph.operators.voxels import match_histogram
from tracegraph.store import saved


def paired(files: DataFrame) -> DataFrame:
    """(id): ids that have both an ``img_`` and a ``mask_`` file (name)."""
    ids = files.select(F.regexp_extract("name", r"^(img|mask)_(\w+)\.", 1).alias("kind"), F.regexp_extract("name", r"^(img|mask)_(\w+)\.", 2).alias("id")).where("kind <> ''")
    return ids.groupBy("id").agg(F.count_distinct("kind").alias("n")).where("n = 2").select("id")


def triples(ids: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(sample, place, id): n draws of 3 distinct ids, the same for the same seed.

    The ids are numbered once. A draw hashes three numbers, each among what the ones before it leave: the work is a row a
    draw, however many ids there are. Fewer than 3 ids give no draws."""
    own = saved(numbered(ids.select("id").distinct(), "number", "id"), "ids")
    many = own.count()
    if many < 3:
        return own.select(F.lit(1).alias("sample"), F.lit(1).alias("place"), "id").limit(0)
    hashed = lambda k: F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("sample").cast("string"), F.lit(str(k)))), 1, 13), 16, 10).cast("long") % (many - k)
    beyond = lambda x, y: x + (x >= y).cast("long")
    draws = ids.sparkSession.range(1, n + 1).select(F.col("id").cast("int").alias("sample"))
    draws = draws.withColumn("a", hashed(0)).withColumn("b", beyond(hashed(1), F.col("a")))
    third = beyond(beyond(hashed(2), F.least("a", "b")), F.greatest("a", "b"))
    draws = draws.select("sample", F.posexplode(F.array("a", "b", third)).alias("place", "number"))
    return draws.select("sample", (F.col("place") + 1).alias("place"), (F.col("number") + 1).alias("number")).join(own, "number").select("sample", "place", "id")


def background_blocks(images: DataFrame, size: int, n: int, seed: int = 0) -> DataFrame:
    """(number, roi, x0, y0, z0, sx, sy, sz): up to ``n`` complete tiles of background images (roi, x0 to z0, sx to sz), drawn
    by a keyed permutation of the tiles' numbers and numbered from 1.

    No tile is made that isn't drawn: an image has as many numbers as tiles, and a draw finds its image by the interval that
    its number is in. Tiles are numbered by image, then x, y, z."""
    per = {k: F.expr(f"s{k} div {size}").cast("long") for k in AXES}
    own = images.select("roi", *(F.col(k + "0").cast("long").alias(k + "0") for k in AXES), *(per[k].alias("n" + k) for k in AXES))
    own = own.withColumn("n", F.col("nx") * F.col("ny") * F.col("nz")).where("nx > 0 and ny > 0 and nz > 0")
    own = saved(summed_before(own, "n", "first", "roi", "x0", "y0", "z0"), "numbered")
    count, total = own.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    draws = images.sparkSession.range(min(n, total)).select((F.col("id") + 1).cast("int").alias("number"), F.col("id").alias("i"))
    draws = permuted(draws, "i", total, seed)
    # intervals and draws meet in cells as wide as the mean image: twice as many rows as images, at most
    wide = max(1, total // max(1, count))
    own = own.withColumn("cell", F.explode(F.expr(f"sequence(first div {wide}, (first + n - 1) div {wide})")))
    found = draws.withColumn("cell", F.expr(f"i div {wide}")).join(own, "cell").where("i >= first and i < first + n").withColumn("i", F.expr("i - first"))
    at = {"x": "i div (ny * nz)", "y": "i div nz % ny", "z": "i % nz"}
    return found.select(
        "number", "roi", *((F.col(k + "0") + F.expr(at[k]) * size).alias(k + "0") for k in AXES), *(F.lit(size).cast("long").alias("s" + k) for k in AXES)
    )


def generate(images: DataFrame, masks: DataFrame, files: DataFrame, n: int, seed: int = 0) -> DataFrame:
    """(sample, x, y, z, v, m): for each draw of three images the overlay of the first two, matched to the histogram of the
    third, with the union of the first two's masks. ``images`` (image, x, y, z, v) and ``masks`` (image, x, y, z, m) have a
    row for each voxel; one that only the masks have is 0 in the image, one that only the images have is 0 in the mask."""
    drawn = saved(triples(paired(files), n, seed).select("sample", "place", F.col("id").alias("image")), "drawn")
    two, third = drawn.where("place < 3"), drawn.where("place = 3")
    over = images.join(two, "image").groupBy("sample", *AXES).agg(F.max("v").cast("long").alias("v"))
    over = saved(over, "overlay")
    scale = match_histogram(over, images.join(third, "image").select("sample", "v"), "sample")
    matched = over.join(scale, ["sample", "v"]).select("sample", *AXES, F.col("to").alias("v"))
    mask = masks.join(two, "image").groupBy("sample", *AXES).agg(F.least(F.max("m"), F.lit(1)).cast("int").alias("m"))
    both = matched.join(mask, ["sample", *AXES], "full")
    return both.select("sample", *AXES, F.coalesce("v", F.lit(0).cast("long")).alias("v"), F.coalesce("m", F.lit(0)).alias("m"))


def background_samples(images: DataFrame, blocks: DataFrame, first: int) -> DataFrame:
    """(sample, x, y, z, v, m): the voxels of background images (roi, x, y, z, v) in ``blocks``, from each block's corner,
    with an empty mask; samples are numbered on from ``first``."""
    box = blocks.select((F.col("number") + first).cast("int").alias("sample"), "roi", "x0", "y0", "z0", F.col("sx").alias("side"))
    # an equi-join on the cell of a block's side that holds a block's corner or one before it
    near = images
    for k in AXES:
        near = near.withColumn("c" + k, F.explode(F.array(*(F.floor(F.col(k) / _SIDE) - i for i in (0, 1)))))
    box = box.select("*", *(F.floor(F.col(k + "0") / _SIDE).alias("c" + k) for k in AXES))
    found = near.join(box, ["roi", "cx", "cy", "cz"])
    for k in AXES:
        found = found.where((F.col(k) >= F.col(k + "0")) & (F.col(k) < F.col(k + "0") + F.col("side")))
    return found.select("sample", *((F.col(k) - F.col(k + "0")).alias(k) for k in AXES), "v", F.lit(0).alias("m"))


_SIDE = 128


def gen_dataset(images: DataFrame, masks: DataFrame, files: DataFrame, background: DataFrame, rois: DataFrame, n_fg: int, n_bg: int, seed: int = 0) -> DataFrame:
    """The whole set: ``n_fg`` samples of ``generate``, then up to ``n_bg`` whole blocks of background images (``rois`` and
    their voxels), numbered on."""
    made = generate(images, masks, files, n_fg, seed)
    blocks = saved(background_blocks(rois, _SIDE, n_bg, seed), "blocks")
    return made.unionByName(background_samples(background, blocks, n_fg).select(*(F.col(c).cast(t).alias(c) for c, t in made.dtypes)))


def write_set(samples: DataFrame, path: str) -> None:
    """A folder for each sample."""
    samples.repartition("sample").write.partitionBy("sample").parquet(path)
