"""Cells and samples: seeded orders that every engine repeats, heads by stratum, exact splits, and the sampling workflow."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .scenes import image_overlap, union_collections


def shuffle_key(seed: int | str, *keys: str) -> Column:
    """A seeded digest to order by; ties go to the keys."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(F.col(k).cast("string") for k in keys)))


def top_property(grid: DataFrame, prop: str, count: int, kind: str) -> DataFrame:
    """The ``count`` cells with the largest positive property, tagged with their kind."""
    return grid.where(F.col(prop) > 0).orderBy(F.desc(prop), "id").limit(count).withColumn("disturbance_type", F.lit(kind))


def random_undisturbed(grid: DataFrame, count: int, seed: int = 42) -> DataFrame:
    return grid.where((F.col("fire") == 0) & (F.col("harvest") == 0)).orderBy(shuffle_key(seed, "id"), "id").limit(count).withColumn("disturbance_type", F.lit("undisturbed"))


def head_by(df: DataFrame, by: list[str], order: list[Column], count: int | Column) -> DataFrame:
    """The first ``count`` rows of each group."""
    at = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= count).drop("_at")


def distinct_priority(sets: list[DataFrame], key: str = "id") -> DataFrame:
    """One row for each key: that of the earliest set which has it."""
    ranked = union_collections(*(s.withColumn("_prio", F.lit(i)) for i, s in enumerate(sets)))
    return head_by(ranked, [key], [F.col("_prio")], 1).drop("_prio")


def exact_split(df: DataFrame, by: list[str], shares: tuple[float, float, float] = (0.7, 0.15, 0.15), seed: int = 111, key: str = "id") -> DataFrame:
    """``split``: floor shares of each group in seeded order; rows beyond the three floors are dropped."""
    if abs(sum(shares) - 1) > 1e-9:
        raise ValueError("shares must sum to 1")
    n = F.count("*").over(Window.partitionBy(*by))
    at = F.row_number().over(Window.partitionBy(*by).orderBy(shuffle_key(seed, key), key))
    floors = [F.floor(F.round(n * s, 9)) for s in shares]
    out = df.withColumns({"_at": at, "_a": floors[0], "_b": floors[0] + floors[1], "_c": floors[0] + floors[1] + floors[2]})
    name = F.when(F.col("_at") <= F.col("_a"), "train").when(F.col("_at") <= F.col("_b"), "test").when(F.col("_at") <= F.col("_c"), "val")
    return out.withColumn("split", name).where("split is not null").drop("_at", "_a", "_b", "_c")


def sample_cells(grid: DataFrame, scenes: DataFrame, counts: dict[str, int], shares: tuple[float, float, float] = (0.7, 0.15, 0.15), by: str = "ecozone") -> DataFrame:
    """Per region: twice the wanted top fire, top harvest and random undisturbed cells; one row a cell, fire first;
    cells without a scene go; each type back to its count; exact three-way split; a seeded order over all."""
    parts = []
    for kind in ("fire", "harvest"):
        parts.append(head_by(grid.where(F.col(kind) > 0), [by], [F.desc(kind), F.col("id")], 2 * counts[kind]).withColumn("disturbance_type", F.lit(kind)))
    calm = grid.where((F.col("fire") == 0) & (F.col("harvest") == 0))
    parts.append(head_by(calm, [by], [shuffle_key(42, "id"), F.col("id")], 2 * counts["undisturbed"]).withColumn("disturbance_type", F.lit("undisturbed")))
    seen = image_overlap(distinct_priority(parts), scenes).where("num_overlapping_images > 0")
    rank = F.when(F.col("disturbance_type") == "fire", F.lpad((F.lit(10**9) - F.col("fire")).cast("string"), 12, "0")).when(F.col("disturbance_type") == "harvest", F.lpad((F.lit(10**9) - F.col("harvest")).cast("string"), 12, "0")).otherwise(shuffle_key(42, "id"))
    wanted = F.element_at(F.create_map(*(x for k, v in counts.items() for x in (F.lit(k), F.lit(v)))), F.col("disturbance_type"))
    kept = head_by(seen, [by, "disturbance_type"], [rank, F.col("id")], wanted)
    return exact_split(kept, [by, "disturbance_type"], shares).withColumn("shuffle", shuffle_key(1001, "id"))


def unused_cells(cells: DataFrame, used: DataFrame, key: str = "cell_id") -> DataFrame:
    return cells.join(used.select(key).distinct(), key, "left_anti")


def model2_cells(cells: DataFrame, used: DataFrame, sizes: tuple[int, int, int] = (700, 150, 150), seed: int = 1001) -> DataFrame:
    """Cells never used, in seeded order: the first for training, the next for tests, the next for validation."""
    total = sum(sizes)
    head = unused_cells(cells, used).withColumn("shuffle", shuffle_key(seed, "id")).orderBy("shuffle", "id").limit(total)
    at = F.row_number().over(Window.orderBy("shuffle", "id"))  # over at most ``total`` rows
    return head.withColumn("_at", at).withColumn("split", F.when(F.col("_at") <= sizes[0], "train").when(F.col("_at") <= sizes[0] + sizes[1], "test").otherwise("val")).drop("_at")


def area_shares(regions: DataFrame, area: Column, key: str = "ecozone_id") -> DataFrame:
    """(key, area, share) of the total."""
    sums = regions.groupBy(key).agg(F.sum(area).alias("area"))
    return sums.join(F.broadcast(sums.agg(F.sum("area").alias("_all")))).select(key, "area", (F.col("area") / F.col("_all")).alias("share"))


def quota(shares: DataFrame, wanted: dict[str, int]) -> DataFrame:
    return shares.withColumns({f"{k}_quota": F.ceil(F.round(F.col("share") * v, 9)) for k, v in wanted.items()})


def stratified_sample(df: DataFrame, per_class: int, by: list[str], bands: list[str], key: str = "pixel_id", seed: int = 7) -> DataFrame:
    """Up to ``per_class`` rows of each group whose bands are all there."""
    return head_by(df.dropna(subset=bands) if bands else df, by, [shuffle_key(seed, key), F.col(key)], per_class)


def sampled_counts(pixels: DataFrame, flags: list[str], by: str, size: int = 2500, seed: int = 1, key: str = "pixel_id") -> DataFrame:
    """(by, one count a flag): non-NULL flags among ``size`` sampled pixels of each cell."""
    return head_by(pixels, [by], [shuffle_key(seed, key), F.col(key)], size).groupBy(by).agg(*(F.count(f).alias(f) for f in flags))


def sampled_events(pixels: DataFrame, events: dict[str, str], by: str, years: DataFrame, size: int = 2500, seed: int = 1, key: str = "pixel_id") -> DataFrame:
    """(by, year, one count an event): in each year, how many of a cell's ``size`` sampled pixels have the event; ``events`` names the column with its year.

    The sample does not depend on the year, so it is taken first: each task keeps the least digests of its part of a cell,
    and those meet in one shuffle. Only the years of the sampled pixels, one short list a cell, meet the years of the archive.
    """
    sampled = head_by(pixels, [by], [shuffle_key(seed, key), F.col(key)], size)
    lists = sampled.groupBy(by).agg(*(F.collect_list(c).alias(f"_{k}") for k, c in events.items()))
    counts = (F.size(F.filter(f"_{k}", lambda y: y == F.col("year"))).cast("long").alias(k) for k in events)
    return lists.crossJoin(F.broadcast(years.select("year"))).select(by, "year", *counts)
