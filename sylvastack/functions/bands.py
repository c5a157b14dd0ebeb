"""Band arithmetic: bit fields, scaling, spectral indices, and the class codes they are used with."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .mask import normalized_difference, update_mask

# Model bands in order, class codes, season and scale constants.
BANDS = ["nir", "red_edge", "red", "green", "tca", "ndvi", "dem"]
HISTORICAL = ["historical_" + b for b in BANDS[:6]]
NONE, NONFOREST, FOREST, WATER, PREVIOUS_FIRE, FIRE, PREVIOUS_HARVEST, HARVEST, CLOUD, SHADOW = range(10)
N_CLASSES = 10
LANDCOVER_CODES = [0, 20, 31, 32, 33, 40, 50, 80, 81, 100, 210, 220, 230]
FIRST_DOY, LAST_DOY = 172, 282
MAX_ELEVATION = 3000.0
PIXEL = 60.0


def bitwise_extract(value: Column, from_bit: int, to_bit: int | None = None) -> Column:
    """The integer in bits from_bit..to_bit, both included."""
    width = 1 + (from_bit if to_bit is None else to_bit) - from_bit
    return F.shiftright(value, from_bit).bitwiseAND(F.lit((1 << width) - 1))


def qa_clear_tm(df: DataFrame, bands: list[str], qa: str = "qa") -> DataFrame:
    """Bands stay where bit 6 is set and bit 4 is not."""
    clear = ((bitwise_extract(F.col(qa), 6) == 1) & (bitwise_extract(F.col(qa), 4) != 1)).cast("int")
    return df.withColumns({b: update_mask(F.col(b), clear) for b in bands})


def qa_clear_mss(df: DataFrame, bands: list[str], qa: str = "qa") -> DataFrame:
    """Bands stay where bit 3 is not set."""
    clear = (bitwise_extract(F.col(qa), 3) == 0).cast("int")
    return df.withColumns({b: update_mask(F.col(b), clear) for b in bands})


def qa_mask_column(df: DataFrame, qa: str = "qa") -> DataFrame:
    return df.withColumn("qa_mask", (bitwise_extract(F.col(qa), 3) == 0).cast("int"))


def tm_scale(df: DataFrame, optical: list[str], thermal: list[str]) -> DataFrame:
    scaled = {b: F.col(b) * 0.0000275 - 0.2 for b in optical} | {b: F.col(b) * 0.00341802 + 149.0 for b in thermal}
    return df.withColumns(scaled)


def nbr(nir: Column, swir: Column) -> Column:
    return normalized_difference(nir, swir)


def process_tm(df: DataFrame, nir: str = "sr_b4", swir: str = "sr_b7", thermal: str = "st_b6", qa: str = "qa") -> DataFrame:
    """Scale, add nbr, and keep clear pixels."""
    scaled = tm_scale(df, [nir, swir], [thermal]).withColumn("nbr", nbr(F.col(nir), F.col(swir)))
    return qa_clear_tm(scaled, [nir, swir, thermal, "nbr"], qa)


def ndvi(nir: Column, red: Column) -> Column:
    return F.when(nir + red != 0, (nir - red) / (nir + red))


#: Published tasselled-cap weights of green, red, red edge, near infrared; parameters, not part of any input.
BRIGHTNESS = {"green": 0.433, "red": 0.632, "red_edge": 0.586, "nir": 0.264}
GREENNESS = {"green": -0.290, "red": -0.562, "red_edge": 0.600, "nir": 0.491}


def tasselled_cap_angle(weights: tuple[dict, dict] = (BRIGHTNESS, GREENNESS)) -> Column:
    """Degrees of atan(greenness / brightness)."""
    brightness, greenness = (reduce(lambda a, b: a + b, (F.col(k) * v for k, v in w.items())) for w in weights)
    return F.when(brightness != 0, F.degrees(F.atan(greenness / brightness)))


def normalize_tca(tca: Column) -> Column:
    return tca / 90.0


def toa(dn: Column, gain: Column, offset: Column, sun_elevation: Column) -> Column:
    """Reflectance from a digital number; gain, offset and sun elevation (degrees) come with the scene."""
    return (dn * gain + offset) / F.sin(F.radians(sun_elevation))


def preprocess(df: DataFrame, dem: DataFrame, gain: Column | None = None, offset: Column | None = None, sun_elevation: Column | None = None) -> DataFrame:
    """Reflectance of the four bands, tca / 90, ndvi, and elevation by pixel; the elevation table joins once on pixel_id.

    ``gain``, ``offset`` and ``sun_elevation`` come with the scene; without them the bands are reflectances already.
    Rows with x and y are put on the grid of ``PIXEL`` metres: grid_col, grid_row.
    """
    out = df if gain is None else df.withColumns({b: toa(F.col(b), gain, offset, sun_elevation) for b in BANDS[:4]})
    out = out.withColumn("tca", normalize_tca(tasselled_cap_angle())).withColumn("ndvi", ndvi(F.col("nir"), F.col("red")))
    if {"x", "y"} <= set(df.columns):
        out = out.withColumns({"grid_col": F.floor(F.col("x") / PIXEL), "grid_row": F.floor(F.col("y") / PIXEL)})
    return out.join(dem.select("pixel_id", "dem"), "pixel_id", "left")


def occlusion_code(occlusion: Column) -> Column:
    """0 clear, 1 cloud, 2 shadow: NULL, 8 or 9."""
    return F.nullif(occlusion, F.lit(0)) + 7


def select_bands(df: DataFrame, bands: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    return df.select(*keep, *(F.col(b).cast("float").alias(b) for b in bands))


def rename_bands(df: DataFrame, bands: list[str], prefix: str = "historical_") -> DataFrame:
    return df.withColumnsRenamed({b: prefix + b for b in bands})


def landcover_remap(code: Column) -> Column:
    """Land-cover code to its place in the list of codes; NULL for others."""
    return F.nullif(F.array_position(F.array(*map(F.lit, LANDCOVER_CODES)), code) - 1, F.lit(-1)).cast("int")


def class_weight(label: Column) -> Column:
    return F.when(label.isin(PREVIOUS_FIRE, FIRE, PREVIOUS_HARVEST, HARVEST), 1.5).otherwise(1.0)


def one_hot(label: Column, n: int = N_CLASSES) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (i == label).cast("double"))


def argmax(p: Column) -> Column:
    """Place of the largest value, the first of equals."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def gather(p: Column, places: list[int]) -> Column:
    return F.array(*(p[i] for i in places))


#: The smoothed distribution of each label.
SMOOTHED = [
    [1, 0, 0, 0, 0, 0, 0, 0, 0, 0],
    [0, 0.8, 0, 0, 0.05, 0.05, 0.05, 0.05, 0, 0],
    [0, 0, 1, 0, 0, 0, 0, 0, 0, 0],
    [0, 0, 0, 1, 0, 0, 0, 0, 0, 0],
    [0, 0.05, 0, 0, 0.85, 0.1, 0, 0, 0, 0],
    [0, 0.05, 0, 0, 0.1, 0.85, 0, 0, 0, 0],
    [0, 0.05, 0, 0, 0, 0, 0.85, 0.1, 0, 0],
    [0, 0.05, 0, 0, 0, 0, 0.1, 0.85, 0, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 1, 0],
    [0, 0, 0, 0, 0, 0, 0, 0, 0, 1],
]


def smooth_labels(df: DataFrame, label: str = "label") -> DataFrame:
    """``p``: the smoothed vector of a label, from a table of ten rows."""
    rows = df.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(SMOOTHED)], "_label int, p array<double>")
    return df.join(F.broadcast(rows), F.col(label) == F.col("_label"), "left").drop("_label")
