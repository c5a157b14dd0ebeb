"""Scene labels: gating by what the scene can already show, and the precedence of all layers.

All that a label needs of a pixel is brought to one row a pixel (``second_sensor``, ``pixel_layers``), so scene pixels meet it
in joins on pixel_id alone, and a scene's own pixels give their median in a window over pixel_id. Inputs that are stored in
buckets by pixel_id (``sources.store``) are labelled without a shuffle; others are shuffled once each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bands import FIRE, HARVEST, PREVIOUS_FIRE, PREVIOUS_HARVEST, bitwise_extract, occlusion_code
from .layers import basemaps, disturbance_years, reduced_event

#: Scenes that may enter a median: a cloud share up to this, in season.
MEDIAN_CLOUD = 20


def disturbance_gate(df: DataFrame) -> DataFrame:
    """``gate``: 1 where the disturbance shows, 0 where not, NULL where the sensor that decides saw nothing.

    One sensor decides for a whole scene: ``by_nbr`` says that coincident scenes of the second sensor cover it. Then nbr
    at most its median; else tca at most its median where bit 3 of ``qa`` is not set.
    """
    by_nbr = F.col("nbr") <= F.col("median_nbr")
    by_tca = F.when(bitwise_extract(F.col("qa"), 3) == 0, F.col("tca") <= F.col("median_tca"))
    return df.withColumn("gate", F.when(F.col("by_nbr"), by_nbr).otherwise(by_tca).cast("int"))


def label_image(df: DataFrame, fire_lookback: int = 3, harvest_lookback: int = 10) -> Column:
    """Class of a pixel in a scene; needs base, fire_year, harvest_year, year, gate, occlusion, and fire_now and harvest_now if they are reduced from finer pixels.

    From low to high: base map, previous harvest, previous fire, gated harvest, gated fire, cloud and shadow. NULL where all are.
    """
    year, gate = F.col("year"), F.col("gate") != 0
    past = lambda c, n: (F.col(c) < year) & (F.col(c) >= year - n)
    now = lambda c: (F.col(f"{c}_now") != 0) if f"{c}_now" in df.columns else F.col(f"{c}_year") == year
    return F.coalesce(
        occlusion_code(F.col("occlusion")),
        F.when(now("fire") & gate, FIRE),
        F.when(now("harvest") & gate, HARVEST),
        F.when(past("fire_year", fire_lookback), PREVIOUS_FIRE),
        F.when(past("harvest_year", harvest_lookback), PREVIOUS_HARVEST),
        F.col("base") + 1,
    ).cast("int")


def first_sensor(pixels: DataFrame, scenes: DataFrame, coincident: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """``pixels`` with year, clear_scene, by_nbr and other_ids, if ``coincident`` has lists, of their scene, and its columns in ``keep``; catalogues join on scene_id."""
    usable = (F.col("cloud_cover") <= MEDIAN_CLOUD) & F.col("in_season")
    facts = scenes.select("scene_id", "year", usable.alias("clear_scene"), *(c for c in keep if c != "year"))
    met = ["other_ids", F.col("other_ids").isNotNull().alias("by_nbr")] if "other_ids" in coincident.columns else ["by_nbr"]
    return pixels.join(facts.join(coincident.select("scene_id", *met), "scene_id"), "scene_id")


def second_sensor(pixels: DataFrame, scenes: DataFrame) -> DataFrame:
    """(pixel_id, seen, median_nbr): one row a pixel of the second sensor: what each scene saw, NULLs left out, and the median of the clear scenes.

    ``pixels``: scene_id, pixel_id, nbr, one row each. The map grows with a pixel's archive, not with the table.
    """
    usable = (F.col("cloud_cover") <= MEDIAN_CLOUD) & F.col("in_season")
    rows = pixels.where("nbr is not null").join(scenes.select("scene_id", usable.alias("_ok")), "scene_id")
    return rows.groupBy("pixel_id").agg(F.map_from_entries(F.collect_list(F.struct("scene_id", "nbr"))).alias("seen"), F.median(F.when(F.col("_ok"), F.col("nbr"))).alias("median_nbr"))


def second_sensor_met(met: DataFrame) -> DataFrame:
    """(pixel_id, seen, median_nbr) from the rows of ``sources.second_sensor.nbr_met``: ``seen`` has what decides each scene of the first sensor.

    The median is that of every value as often as clear scenes saw it. The map grows with what the first sensor saw of the pixel.
    """
    shown = lambda before: F.map_from_entries(F.collect_list(F.when(F.col("before") == before, F.struct("scene_id", "nbr"))))
    grouped = met.groupBy("pixel_id").agg(shown(False).alias("now"), shown(True).alias("before"), F.percentile(F.when(F.col("n").isNotNull(), F.col("nbr")), F.lit(0.5), F.col("n")).alias("median_nbr"))
    return grouped.select("pixel_id", F.map_zip_with("now", "before", lambda _, now, before: F.coalesce(now, before)).alias("seen"), "median_nbr")


def pixel_layers(near: DataFrame, fine: DataFrame, landcover: DataFrame, years: DataFrame, lookback: int = 1, first_year: int | None = None) -> DataFrame:
    """(pixel_id, fire_year, harvest_year, fire_years, harvest_years, bases): all layers, one row a pixel.

    ``near`` has the event years at the pixel itself, ``fine`` those of the finer pixels in it, ``landcover`` its finer
    pixels by year; all carry pixel_id. Event years are reduced once for all scene years.
    """
    own = near.select("pixel_id", "fire_year", "harvest_year")
    return own.join(disturbance_years(fine), "pixel_id", "left").join(basemaps(landcover, years, lookback, first_year), "pixel_id", "left")


def labelled(first: DataFrame, second: DataFrame, layers: DataFrame, medians: DataFrame | None = None) -> DataFrame:
    """``first`` with gate and label, and what they come from. Joins are on pixel_id; the medians of tca over a pixel's clear scenes come from ``first`` itself, or from ``medians``.

    A scene that coincident ones cover is decided by the last of them that saw the pixel: in order of other_ids, where ``first``
    has them and ``second`` has what each saw, else ``second`` has what decides each scene.
    """
    if medians is None:
        over = Window.partitionBy("pixel_id")
        rows = first.withColumn("median_tca", F.percentile(F.when(F.col("clear_scene"), F.col("tca")), F.lit(0.5)).over(over))
    else:
        rows = first.join(medians.select("pixel_id", "median_tca"), "pixel_id", "left")
    rows = rows.join(second, "pixel_id", "left").join(layers, "pixel_id", "left")
    # Null where no coincident scene saw the pixel; the ids of few scenes are looked up, last one first.
    by_list = "other_ids" in rows.columns
    last = F.try_element_at("seen", F.col("scene_id")) if not by_list else F.get(F.filter(F.transform(F.reverse("other_ids"), lambda i: F.try_element_at("seen", i)), lambda x: x.isNotNull()), 0)
    rows = rows.withColumns({
        "nbr": F.when(F.col("by_nbr") & F.col("seen").isNotNull(), last),
        "base": F.try_element_at("bases", F.col("year")),
        "fire_now": F.coalesce(reduced_event(F.col("fire_years"), F.col("year")), F.lit(0)),
        "harvest_now": F.coalesce(reduced_event(F.col("harvest_years"), F.col("year")), F.lit(0)),
    })
    rows = disturbance_gate(rows).drop("seen", "bases", "fire_years", "harvest_years", "other_ids")
    return rows.withColumn("label", label_image(rows))
