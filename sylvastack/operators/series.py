"""Class probabilities through time: the Bayesian update, annual reduction, and the rules that clean annual series."""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.bands import CLOUD, FIRE, FOREST, HARVEST, NONFOREST, PREVIOUS_FIRE, PREVIOUS_HARVEST, SHADOW


def _checked(leveler: float, on_zero: str) -> None:
    if not 0 <= leveler <= 1:
        raise ValueError("leveler must lie between 0 and 1")
    if on_zero not in ("nan", "carry"):
        raise ValueError("on_zero is nan or carry")


def bulcp(df: DataFrame, leveler: float = 0.8, key: str = "pixel_id", order: str = "t", p: str = "p", on_zero: str = "nan") -> DataFrame:
    """(key, order, p): the posterior after each observation.

    The first posterior is the first observation; later ones are leveler * normalised product + (1 - leveler) / classes.
    An ordered list a pixel, folded by one expression: nothing leaves the JVM, and a step copies the list so far; for
    series of many hundred steps take ``bulcp_arrow``. Where all products are zero the posterior is NaN from there on, or
    with ``on_zero`` carry the posterior before it.
    """
    _checked(leveler, on_zero)

    def step(done, row):
        last = F.element_at(done, -1)["p"]
        product = F.zip_with(last, row["p"], lambda a, b: a * b)
        total = F.aggregate(product, F.lit(0.0), lambda s, x: s + x)
        rest = (1 - leveler) / F.size(product)
        fresh = F.transform(product, lambda x: F.when(total == 0, F.lit(float("nan"))).otherwise(x / total) * leveler + rest)
        fresh = F.when(total == 0, last).otherwise(fresh) if on_zero == "carry" else fresh
        return F.concat(done, F.array(F.struct(row["t"].alias("t"), fresh.alias("p"))))

    rows = df.select(key, F.struct(F.col(order).alias("t"), F.col(p).cast("array<double>").alias("p")).alias("r"))
    lists = rows.groupBy(key).agg(F.array_sort(F.collect_list("r")).alias("rows"))
    folded = lists.select(key, F.aggregate(F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0))), F.slice("rows", 1, 1), step).alias("out"))
    return folded.select(key, F.explode("out").alias("o")).select(key, F.col("o.t").alias(order), F.col("o.p").alias(p))


def bulcp_arrow(df: DataFrame, leveler: float = 0.8, key: str = "pixel_id", order: str = "t", p: str = "p", on_zero: str = "nan") -> DataFrame:
    """The same for long series: one numpy fold a pixel, in time linear in its length."""
    _checked(leveler, on_zero)

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(order)
        x = np.stack(rows[p].to_list()).astype(float)
        for i in range(1, len(x)):
            product = x[i - 1] * x[i]
            total = product.sum()
            if total == 0 and on_zero == "carry":
                x[i] = x[i - 1]
                continue
            with np.errstate(invalid="ignore"):
                x[i] = leveler * product / total + (1 - leveler) / x.shape[1]
        return pd.DataFrame({key: rows[key], order: rows[order], p: list(x)})

    kinds = {c: df.schema[c].dataType.simpleString() for c in (key, order)}
    out = df.select(key, order, p).groupBy(key).applyInPandas(fold, f"{key} {kinds[key]}, {order} {kinds[order]}, {p} array<double>")
    return out.withColumn(p, F.transform(p, lambda x: F.coalesce(x, F.lit(float("nan")))))  # Arrow takes pandas' NaN for a null


def last_per_year(df: DataFrame, key: str = "pixel_id", order: str = "acquired") -> DataFrame:
    """The last row of each key and year."""
    at = F.row_number().over(Window.partitionBy(key, "year").orderBy(F.desc(order)))
    return df.withColumn("_at", at).where("_at = 1").drop("_at")


def drop_occluded(df: DataFrame, cls: str = "cls") -> DataFrame:
    return df.where(~F.col(cls).isin(CLOUD, SHADOW))


def drop_unsure(df: DataFrame, threshold: float, p: str = "p") -> DataFrame:
    """Rows whose best class reaches the threshold, where a disturbance and its later state count as one."""
    c = F.col(p)
    joined = F.array(*(c[i] for i in range(4)), c[PREVIOUS_FIRE] + c[FIRE], c[PREVIOUS_HARVEST] + c[HARVEST], c[CLOUD], c[SHADOW])
    return df.where(F.array_max(joined) >= threshold)


def drop_false_positives(df: DataFrame, key: str = "pixel_id", cls: str = "cls") -> DataFrame:
    """Pixels that are disturbed throughout, or exactly once, go."""
    hit = F.col(cls).isin(PREVIOUS_FIRE, FIRE, PREVIOUS_HARVEST, HARVEST)
    w = Window.partitionBy(key)
    out = df.withColumns({"_hits": F.count_if(hit).over(w), "_all": F.count("*").over(w)})
    return out.where((F.col("_hits") != F.col("_all")) & (F.col("_hits") != 1)).drop("_hits", "_all")


def event_years(df: DataFrame, current: int, previous: int, key: str = "pixel_id", cls: str = "cls", order: str = "acquired") -> DataFrame:
    """(key, event_year): years in which a series turns from forest to an event.

    Equal classes in a row are one run. forest, current, previous, forest or non-forest: the year of the first current
    observation. forest, previous with unseen years between: the year before the first previous observation.
    """
    w = Window.partitionBy(key).orderBy(order)
    runs = df.withColumns({"_before": F.lag(cls).over(w), "_last_year": F.lag("year").over(w)}).where(F.col("_before").isNull() | (F.col("_before") != F.col(cls)))
    ahead = {f"_n{i}": F.lead(cls, i).over(w) for i in (1, 2)}
    seen = runs.withColumns(ahead)
    burn = (F.col("_before") == FOREST) & (F.col(cls) == current) & (F.col("_n1") == previous) & F.col("_n2").isin(NONFOREST, FOREST)
    gap = (F.col("_before") == FOREST) & (F.col(cls) == previous) & (F.col("year") - F.col("_last_year") > 1)
    return seen.withColumn("event_year", F.when(burn, F.col("year")).when(gap, F.col("year") - 1)).where("event_year is not null").select(key, "event_year").distinct()


def annual_maps(df: DataFrame, leveler: float = 0.8, threshold: float = 0.3) -> DataFrame:
    """(pixel_id, year, cls, fire, harvest): the fused class at the end of each year, and the years of fires and harvests.

    ``df``: pixel_id, t, year, p. The fused series loses clouds, shadows and observations whose best class stays under
    ``threshold``, then pixels that are disturbed throughout or once; what turns from forest to an event in the rest
    gives its year. cls is NULL in an event's year without an observation.
    """
    fused = bulcp(df, leveler).join(df.select("pixel_id", "t", "year"), ["pixel_id", "t"]).withColumn("cls", (F.array_position("p", F.array_max("p")) - 1).cast("int"))
    sure = drop_false_positives(drop_unsure(drop_occluded(fused), threshold))
    fires, harvests = (event_years(sure, now, before, order="t").select("pixel_id", F.col("event_year").alias("year"), F.lit(1).alias(name)) for now, before, name in ((FIRE, PREVIOUS_FIRE, "fire"), (HARVEST, PREVIOUS_HARVEST, "harvest")))
    out = last_per_year(fused, order="t").select("pixel_id", "year", "cls").join(fires, ["pixel_id", "year"], "full").join(harvests, ["pixel_id", "year"], "full")
    return out.select("pixel_id", "year", "cls", F.coalesce("fire", F.lit(0)).alias("fire"), F.coalesce("harvest", F.lit(0)).alias("harvest"))
