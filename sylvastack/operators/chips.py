"""Chips: dense arrays of a cell's pixels, and crops and flips that keep image and label aligned."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def chip_window(pixels: DataFrame, size: int, bands: list[str], keys: tuple[str, ...] = ()) -> DataFrame:
    """(keys, chip_id, row, col, bands): every place of every chip that has a pixel; masked and missing pixels are 0.

    Pixels need row and col of the whole image; a chip is a block of ``size``.
    """
    at = lambda c: F.floor(F.col(c) / size).cast("int")
    inside = pixels.withColumns({"chip_row": at("row"), "chip_col": at("col")})
    chips = inside.select(*keys, "chip_row", "chip_col").distinct()
    places = chips.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(size - 1)))).withColumn("c", F.explode(F.sequence(F.lit(0), F.lit(size - 1))))
    own = inside.select(*keys, "chip_row", "chip_col", F.pmod("row", F.lit(size)).alias("r"), F.pmod("col", F.lit(size)).alias("c"), *bands)
    full = places.join(own, [*keys, "chip_row", "chip_col", "r", "c"], "left")
    chip = F.format_string("chip%05d_%05d", "chip_row", "chip_col")
    return full.select(*keys, chip.alias("chip_id"), F.col("r").alias("row"), F.col("c").alias("col"), *(F.coalesce(F.col(b), F.lit(0)).alias(b) for b in bands))


def chips_from_pixels(places: DataFrame, bands: list[str], keys: tuple[str, ...] = ("chip_id",)) -> DataFrame:
    """One record a chip: each band as an array in row-major order."""
    rows = places.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row", "col", *bands))).alias("_rows"))
    return rows.select(*keys, *(F.col(f"_rows.{b}").alias(b) for b in bands))


def chips_to_pixels(chips: DataFrame, size: int, bands: list[str], keys: tuple[str, ...] = ("chip_id",)) -> DataFrame:
    flat = chips.select(*keys, F.posexplode(F.arrays_zip(*bands)))
    return flat.select(*keys, F.floor(F.col("pos") / size).cast("int").alias("row"), (F.col("pos") % size).alias("col"), *(F.col(f"col.{b}").alias(b) for b in bands))


def grid_crop(pixels: DataFrame, size: int, crop: int) -> DataFrame:
    """``block`` in block-row-major order, row and col inside it; every pixel is in one block."""
    if size % crop:
        raise ValueError("the crop must divide the chip")
    block = F.floor(F.col("row") / crop) * (size // crop) + F.floor(F.col("col") / crop)
    return pixels.withColumns({"block": block.cast("int"), "row": F.col("row") % crop, "col": F.col("col") % crop})


def draw(key: str, seed: int, salt: str, n: int) -> Column:
    """0..n-1 from a digest of the key: the same on every engine."""
    return (F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(f"{seed}{salt}"), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long") % n).cast("int")


def random_crop(pixels: DataFrame, size: int, crop: int, seed: int, key: str = "chip_id") -> DataFrame:
    """One window a chip, the same for all its bands; row and col count from the window."""
    top, left = draw(key, seed, "r", size - crop + 1), draw(key, seed, "c", size - crop + 1)
    moved = pixels.withColumns({"row": F.col("row") - top, "col": F.col("col") - left})
    return moved.where(F.col("row").between(0, crop - 1) & F.col("col").between(0, crop - 1))


def augment_flip(pixels: DataFrame, size: int, seed: int, key: str = "chip_id") -> DataFrame:
    flip = lambda c, salt: F.when(draw(key, seed, salt, 2) == 1, size - 1 - F.col(c)).otherwise(F.col(c))
    return pixels.withColumns({"row": flip("row", "v"), "col": flip("col", "h")})


def augment_rotate(pixels: DataFrame, size: int, seed: int, bands: list[str], key: str = "chip_id", turn: float = 0.2) -> DataFrame:
    """Each chip turned by up to ``turn`` of a circle about its centre: every output place takes its nearest source place, reflected at the edges."""
    angle = (draw(key, seed, "a", 20_001) / 10_000.0 - 1) * (turn * 2 * math.pi)
    mid = (size - 1) / 2
    y, x = F.col("row") - mid, F.col("col") - mid

    def reflected(c: Column) -> Column:
        m = F.pmod(F.round(c).cast("int"), F.lit(2 * size))
        return F.when(m >= size, 2 * size - 1 - m).otherwise(m)

    source = pixels.select(key, "row", "col").withColumns({"_r": reflected(F.cos(angle) * y + F.sin(angle) * x + mid), "_c": reflected(F.cos(angle) * x - F.sin(angle) * y + mid)})
    values = pixels.select(key, F.col("row").alias("_r"), F.col("col").alias("_c"), *bands)
    return source.join(values, [key, "_r", "_c"]).select(key, "row", "col", *bands)


def turn_records(chips: DataFrame, size: int, seed: int, bands: list[str], key: str = "chip_id", turn: float = 0.2) -> DataFrame:
    """``augment_rotate`` on records of whole chips, arrays in row-major order: the places that a turn reads are found once, and every band is gathered by them. No shuffle."""
    angle = (draw(key, seed, "a", 20_001) / 10_000.0 - 1) * (turn * 2 * math.pi)
    mid = (size - 1) / 2

    def reflected(c: Column) -> Column:
        m = F.pmod(F.round(c).cast("int"), F.lit(2 * size))
        return F.when(m >= size, 2 * size - 1 - m).otherwise(m)

    def source(at: Column) -> Column:
        y, x = F.floor(at / size) - mid, at % size - mid
        return (reflected(F.col("_cos") * y + F.col("_sin") * x + mid) * size + reflected(F.col("_cos") * x - F.col("_sin") * y + mid)).cast("int")

    turned = chips.withColumns({"_cos": F.cos(angle), "_sin": F.sin(angle)}).withColumn("_from", F.transform(F.sequence(F.lit(0), F.lit(size * size - 1)), source))
    gather = lambda b: F.transform("_from", lambda i: F.get(F.col(b), i))
    return turned.withColumns({b: gather(b) for b in bands}).drop("_cos", "_sin", "_from")


def batch_ids(df: DataFrame, order: list[str], size: int = 32, by: list[str] | None = None) -> DataFrame:
    """``batch``: rows in batches of ``size`` in order within each group."""
    at = F.row_number().over(Window.partitionBy(*(by or [])).orderBy(*order))
    return df.withColumn("batch", F.floor((at - 1) / size).cast("int"))


def repeat_epochs(df: DataFrame, epochs: int) -> DataFrame:
    return df.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))


def train_dataset(chips_px: DataFrame, size: int, crop: int, epochs: int, seed: int, bands: list[str], batch: int = 32, turn: float = 0.0, stats_share: int = 1) -> DataFrame:
    """Seeded order, one random window a chip and epoch, turned by up to ``turn`` of a circle, flipped, normalised bands, batches by chip.

    The bands' statistics are those of one chip in ``stats_share``, by a digest. Batches are counted in slices of the
    seeded order: each slice's first place comes from the counts of the slices before it, so no task orders an epoch.
    """
    from .assess import band_stats, scaled

    some = chips_px.where(draw("chip_id", seed, "n", stats_share) == 0)
    rows = repeat_epochs(scaled(chips_px, band_stats(some, bands), bands), epochs).withColumn("_key", F.concat_ws("@", "chip_id", "epoch"))
    cropped = random_crop(rows, size, crop, seed, "_key")
    if turn:
        keys, others = ("_key", "chip_id", "epoch"), [c for c in cropped.columns if c not in ("_key", "chip_id", "epoch", "row", "col")]
        cropped = chips_to_pixels(turn_records(chips_from_pixels(cropped, others, keys), crop, seed, others, "_key", turn), crop, others, keys)
    cropped = augment_flip(cropped, crop, seed, "_key")
    order = cropped.select("epoch", "chip_id", "_key").distinct().withColumn("shuffle", F.md5(F.concat_ws(":", F.lit(str(seed)), "_key"))).withColumn("_slice", F.substring("shuffle", 1, 3))
    before = Window.partitionBy("epoch").orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    counts = order.groupBy("epoch", "_slice").agg(F.count("*").alias("_n"))  # at most 4096 slices an epoch
    first = counts.select("epoch", "_slice", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    at = F.row_number().over(Window.partitionBy("epoch", "_slice").orderBy("shuffle", "_key")) - 1
    placed = order.withColumn("_at", at).join(first, ["epoch", "_slice"]).select("_key", F.floor((F.col("_first") + F.col("_at")) / batch).cast("int").alias("batch"))
    return cropped.join(placed, "_key").drop("_key")


def test_dataset(chips_px: DataFrame, size: int, crop: int) -> DataFrame:
    return grid_crop(chips_px, size, crop)
