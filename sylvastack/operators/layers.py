"""Land-cover and disturbance layers: scans, per-pixel classes, and their reduction to the 60 m grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bands import MAX_ELEVATION, PIXEL, update_mask
from ..functions.geo import snap
from ..functions.mask import blend, self_mask, unmask


def landcover_year(landcover: DataFrame, year: int, first_year: int = 1984) -> DataFrame:
    """(pixel_id, lc) of a year, not before ``first_year``: the first image of the year."""
    return landcover.where(F.col("year") == max(year, first_year)).groupBy("pixel_id").agg(F.min_by("lc", "acquired").alias("lc"))


def check_disturbance(layer: DataFrame) -> DataFrame:
    """Year-coded layer with NULL for never; zero and less count as never."""
    return layer.withColumns({c: F.when(F.col(c) > 0, F.col(c)) for c in ("fire_year", "harvest_year")})


def dem(elevation: DataFrame) -> DataFrame:
    """Fine over coarse, as a share of the highest elevation."""
    return elevation.select("pixel_id", (F.coalesce("fine", "coarse") / MAX_ELEVATION).alias("dem"))


def reduce_resolution(df: DataFrame, values: list[str], keys: tuple[str, ...] = (), step: float = PIXEL) -> DataFrame:
    """(keys, col, row, values): the largest value of all fine pixels in a coarse one."""
    return df.groupBy(*keys, snap(F.col("x"), step).alias("col"), snap(F.col("y"), step).alias("row")).agg(*(F.max(v).alias(v) for v in values))


def treed(lc: str = "lc") -> Column:
    return F.when((F.col(lc) == 81) | (F.col(lc) >= 210), 1).otherwise(0)


def not_water(lc: str = "lc") -> Column:
    return F.when(F.col(lc) != 20, 1).otherwise(0)


def basemap(trees: DataFrame, waters: DataFrame) -> DataFrame:
    """(pixel_id, base): 0 other, 1 trees of one land-cover map, 2 water of another on top."""
    a = trees.select("pixel_id", treed().alias("treed"))
    b = waters.select("pixel_id", not_water().alias("dry"))
    return a.join(b, "pixel_id").select("pixel_id", F.coalesce(F.when(F.col("dry") == 0, 2), F.col("treed")).alias("base"))


def basemaps(landcover: DataFrame, years: DataFrame, lookback: int = 0, first_year: int | None = None, key: str = "pixel_id") -> DataFrame:
    """(key, bases): one row a pixel with a map from each of ``years`` to its base: water of the year on the trees of ``lookback`` years before.

    Neither is taken before ``first_year``, the first of the land cover (None: the least in ``landcover``), so every
    scene year has a base. ``landcover`` may have several fine pixels of one ``key``, told apart by x and y: the first
    image of a year counts for each, and their classes are reduced by the largest value. Each land-cover year is handed
    to the scene years that read it, so one aggregation over ``key`` does it. ``years`` is a small table.
    """
    first = landcover.agg(F.min("year").alias("_first")) if first_year is None else landcover.sparkSession.createDataFrame([(first_year,)], "_first int")
    clamp = lambda back: F.greatest(F.col("year") - back, F.col("_first")).alias("read")
    reads = years.select("year").distinct().join(F.broadcast(first))
    reads = reads.select("year", clamp(lookback), F.lit("treed").alias("what")).unionByName(reads.select("year", clamp(0), F.lit("dry").alias("what")))
    reads = reads.groupBy("read").agg(F.collect_list(F.struct("year", "what")).alias("uses"))
    fine = landcover.repartition(key).groupBy(key, "x", "y", "year").agg(F.min_by("lc", "acquired").alias("lc"))
    coarse = fine.groupBy(key, "year").agg(F.max(treed()).alias("treed"), F.max(not_water()).alias("dry"))
    used = coarse.join(F.broadcast(reads), F.col("year") == F.col("read")).select(key, "treed", "dry", F.explode("uses").alias("u"))
    by_year = used.groupBy(key, F.col("u.year").alias("year")).agg(F.max(F.when(F.col("u.what") == "treed", F.col("treed"))).alias("treed"), F.max(F.when(F.col("u.what") == "dry", F.col("dry"))).alias("dry"))
    base = F.coalesce(F.when(F.col("dry") == 0, 2), F.col("treed"))
    return by_year.groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct("year", base.alias("base")))).alias("bases"))


def disturbance_years(layer: DataFrame, keys: tuple[str, ...] = ("pixel_id",)) -> DataFrame:
    """(keys, fire_years, harvest_years): the distinct years in which any fine pixel of a coarse one burned or was cut, from one reduction for all years."""
    return layer.groupBy(*keys).agg(*(F.collect_set(c).alias(f"{c}s") for c in ("fire_year", "harvest_year")))


def reduced_event(years: Column, year: Column | int, before: bool = False) -> Column:
    """1 where any fine pixel has its event in the year, or an earlier one; 0 elsewhere."""
    hit = F.coalesce(F.array_min(years) < year, F.lit(False)) if before else F.array_contains(years, year)
    return hit.cast("int")


def event_map(layer: str, year: Column | int, before: bool = False) -> Column:
    """1 where the layer has the year, or an earlier one; 0 elsewhere."""
    hit = F.col(layer) < year if before else F.col(layer) == year
    return unmask(hit.cast("int"))


def disturbance_map(year: Column | int, as_written: bool = False) -> Column:
    """0 none, 1 previous fire, 2 fire, 3 previous harvest, 4 harvest; fire lies on harvest.

    as_written: the unmasked fire layer covers harvest everywhere, as the formula stands in its source.
    """
    fire, fire_before, harvest, harvest_before = (event_map(c, year, b) for c, b in (("fire_year", False), ("fire_year", True), ("harvest_year", False), ("harvest_year", True)))
    fires = blend(self_mask(fire_before), update_mask(F.lit(2), fire))
    if as_written:
        return blend(fire_before, update_mask(F.lit(2), fire)).cast("int")
    harvests = blend(update_mask(F.lit(3), harvest_before), update_mask(F.lit(4), harvest))
    return F.coalesce(fires, harvests, F.lit(0)).cast("int")


def disturbed_regions(year: Column | int) -> Column:
    return F.greatest(event_map("fire_year", year), event_map("harvest_year", year))


def annual_label(base: Column, disturbance: Column) -> Column:
    """Class 1..7 from the base map and the disturbance map."""
    return blend(base + 1, self_mask(disturbance) + 3).cast("int")


def mode_pyramids(df: DataFrame, value: str, levels: int) -> DataFrame:
    """(level, row, col, value): all overviews up to 2^``levels`` coarser from one pass over the pixels, the most frequent class of each place, the smallest of equals.

    Pixels are counted by class at level 1; all coarser levels add those counts up. A place of the top level lies in one
    task, where every level below it is counted without another shuffle.
    """
    top = [F.floor(F.col(c) / (1 << levels)).alias(f"_{c}") for c in ("row", "col")]
    placed = df.where(F.col(value).isNotNull()).select("row", "col", value, *top).repartition("_row", "_col")
    own = ("_row", "_col")
    finest = placed.groupBy(*own, F.floor(F.col("row") / 2).alias("r"), F.floor(F.col("col") / 2).alias("c"), value).agg(F.count("*").alias("n"))
    at = lambda c: F.floor(F.col(c) / F.pow(F.lit(2), F.col("level") - 1))
    every = finest.withColumn("level", F.explode(F.sequence(F.lit(1), F.lit(levels)))).groupBy(*own, "level", at("r").alias("row"), at("c").alias("col"), value).agg(F.sum("n").alias("n"))
    return every.groupBy(*own, "level", "row", "col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value)).select("level", "row", "col", value)


def mode_pyramid(df: DataFrame, value: str, level: int) -> DataFrame:
    """(row, col, value) of the overview 2^level coarser: the most frequent class, the smallest of equals."""
    k = 1 << level
    counted = df.groupBy(F.floor(F.col("row") / k).alias("row"), F.floor(F.col("col") / k).alias("col"), value).agg(F.count("*").alias("n"))
    return counted.groupBy("row", "col").agg(F.min_by(value, F.struct(-F.col("n"), F.col(value))).alias(value))


def ever_land(landcover: DataFrame) -> DataFrame:
    """(pixel_id, land): 1 if the pixel is land in any year."""
    land = F.when((F.col("lc") > 0) & (F.col("lc") != 20), 1).otherwise(0)
    return landcover.groupBy("pixel_id").agg(F.max(land).alias("land"))


def area_hectares(df: DataFrame, *by: str, pixel: float = PIXEL) -> DataFrame:
    """Pixels and hectares of each group."""
    return df.groupBy(*by).agg(F.count("*").alias("n"), F.round(F.count("*") * (pixel * pixel / 10_000), 2).alias("ha"))
