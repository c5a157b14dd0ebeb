"""Scene catalogues: searches, cell joins by tile, coincident scenes, and per-pixel composites."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.bands import FIRST_DOY, LAST_DOY
from ..functions.geo import BOX, box_area, level_join, tiles
from ..functions.rings import region_join

TILE = 24_000.0
#: Scenes of a day that are one group, and pairs of scenes that a task looks at together.
PART, PAIRS = 4_096, 1 << 20
#: Cells of equal year and centre that meet scenes together; so few that a list is repeated well within a block of a file's compression.
CELLS = 64


def scene_search(scenes: DataFrame, box: tuple[float, float, float, float] | None = None, years: tuple[int, int] | None = None, doys: tuple[int, int] = (FIRST_DOY, LAST_DOY), max_cloud: float = 100) -> DataFrame:
    """Scenes that touch a box in inclusive ranges of years and days, up to a cloud share; all of it reaches the scan."""
    out = scenes.where(F.col("doy").between(*doys) & (F.col("cloud_cover") <= max_cloud))
    if years:
        out = out.where(F.col("year").between(*years))
    if box:
        xmin, ymin, xmax, ymax = box
        out = out.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))
    return out


def union_collections(*parts: DataFrame) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def cell_region(cells: DataFrame, regions: DataFrame, key: str = "cell_id", region: str = "ecozone_id", order: str = "part_id") -> DataFrame:
    """(key, region): the first region, by ``order``, that touches a cell. Regions are polygons if they have ``rings``, else boxes."""
    if "rings" in regions.columns:
        pairs = region_join(cells.select(key, *BOX), regions.select(region, order, "rings", *BOX))
    else:
        pairs = level_join(cells.select(key, *BOX), regions.select(region, order, *BOX), finer=0)
    return pairs.groupBy(F.col(f"l.{key}").alias(key)).agg(F.min_by(f"r.{region}", f"r.{order}").alias(region))


def _centred(cells: DataFrame) -> DataFrame:
    cx, cy = (F.col("xmin") + F.col("xmax")) / 2, (F.col("ymin") + F.col("ymax")) / 2
    return cells.withColumns({"xmin": cx, "xmax": cx, "ymin": cy, "ymax": cy})


def cell_scenes(cells: DataFrame, scenes: DataFrame, doys: tuple[int, int] = (FIRST_DOY, LAST_DOY), of_cell: tuple[Column, ...] = (), of_scene: tuple[Column, ...] = ()) -> DataFrame:
    """(id, scene_id, of_cell, of_scene): scenes of a cell's year and season that cover the cell's centre.

    Columns of either side travel with it, named by their aliases, so the pairs need not meet their tables again.
    Cells of equal year and centre have the same scenes: they meet them as lists of ``CELLS`` at most, and a list comes out whole
    for one scene after the other, so that columns of the result repeat themselves and take little space where it is written.
    """
    here = ["year", *BOX]
    each = _centred(cells.select(F.struct("id", F.struct(F.lit(0), *of_cell).alias("facts")).alias("cell"), *here))
    part = F.floor((F.row_number().over(Window.partitionBy(*here).orderBy("cell.id")) - 1) / CELLS)
    a = each.withColumn("part", part).groupBy(*here, "part").agg(F.collect_list("cell").alias("cells"))
    b = scenes.where(F.col("doy").between(*doys)).select("scene_id", "year", *BOX, F.struct(F.lit(0), *of_scene).alias("facts"))
    pairs = level_join(a, b, on=F.col("l.year") == F.col("r.year"), deal=("year",))
    pairs = pairs.select(F.explode("l.cells").alias("cell"), F.col("r.scene_id").alias("scene_id"), F.col("r.facts").alias("facts"))
    names = lambda at, kind: [F.col(at)[f.name].alias(f.name) for f in kind.fields[1:]]
    return pairs.select(F.col("cell.id").alias("id"), "scene_id", *names("cell.facts", pairs.schema["cell"].dataType["facts"].dataType), *names("facts", pairs.schema["facts"].dataType))


def image_overlap(cells: DataFrame, scenes: DataFrame, doys: tuple[int, int] = (FIRST_DOY, LAST_DOY)) -> DataFrame:
    """The cells with ``num_overlapping_images``, 0 included.

    Scenes are taken along the same paths again and again: equal footprints of a year are counted first, and equal centres
    are asked for once, so the join grows with the places there are and not with cells times scenes.
    """
    at = cells.withColumns({"_x": (F.col("xmin") + F.col("xmax")) / 2, "_y": (F.col("ymin") + F.col("ymax")) / 2})
    points = at.select("year", F.col("_x").alias("xmin"), F.col("_y").alias("ymin"), F.col("_x").alias("xmax"), F.col("_y").alias("ymax")).distinct()
    prints = scenes.where(F.col("doy").between(*doys)).groupBy("year", *BOX).agg(F.count("*").alias("_n"))
    met = level_join(points, prints, on=F.col("l.year") == F.col("r.year"))
    n = met.groupBy(F.col("l.year").alias("year"), F.col("l.xmin").alias("_x"), F.col("l.ymin").alias("_y")).agg(F.sum("r._n").alias("n"))
    return at.join(n, ["year", "_x", "_y"], "left").select(*cells.columns, F.coalesce("n", F.lit(0)).alias("num_overlapping_images"))


def union_area(x0: np.ndarray, y0: np.ndarray, x1: np.ndarray, y1: np.ndarray, strips: int = 512) -> float:
    """Area of the union of boxes: a sweep over the sorted x-edges that keeps, for each stretch between sorted y-edges, how many boxes cover it.

    Counts come from differences at the boxes' corners, for ``strips`` edges at once, so memory is strips x edges.
    """
    if len(x0) < 2:
        return float(((x1 - x0) * (y1 - y0)).sum())
    (xs, at_x), (ys, at_y) = (np.unique(np.concatenate(e), return_inverse=True) for e in ((x0, x1), (y0, y1)))
    n, width, height = len(x0), np.append(np.diff(xs), 0.0), np.append(np.diff(ys), 0.0)
    edge, low, high = at_x, np.tile(at_y[:n], 2), np.tile(at_y[n:], 2)
    sign = np.repeat([1, -1], n)
    total, before = 0.0, np.zeros(len(ys), np.int64)
    for first in range(0, len(xs), strips):
        here = (edge >= first) & (edge < first + strips)
        change = np.zeros((min(strips, len(xs) - first), len(ys)), np.int64)
        np.add.at(change, (edge[here] - first, low[here]), sign[here])
        np.add.at(change, (edge[here] - first, high[here]), -sign[here])
        change[0] += before
        step = change.cumsum(axis=0)
        before = step[-1]
        total += float(width[first : first + strips] @ ((step.cumsum(axis=1) > 0) @ height))
    return total


def union_areas(*edges: list[np.ndarray], few: int = 24, cells: int = 1 << 22) -> np.ndarray:
    """``union_area`` of many rows (x0, y0, x1, y1, an array of boxes each): rows with equally many boxes, ``few`` at most, are swept together."""
    sizes = np.array([len(x) for x in edges[0]], np.int64)
    out = np.zeros(len(sizes))
    for n in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == n)
        if n > few:
            out[rows] = [union_area(*(e[i] for e in edges)) for i in rows]
            continue
        step = max(1, cells // (4 * n * n))
        for part in (rows[lo : lo + step] for lo in range(0, len(rows), step)):
            x0, y0, x1, y1 = (np.stack([e[i] for i in part]) for e in edges)
            xs, ys = np.sort(np.hstack([x0, x1]), axis=1), np.sort(np.hstack([y0, y1]), axis=1)
            held = np.zeros((len(part), 2 * n - 1, 2 * n - 1), bool)
            inside = lambda v, lo, hi: (v[:, :-1] >= lo[:, None]) & (v[:, :-1] < hi[:, None])
            for b in range(n):
                held |= inside(xs, x0[:, b], x1[:, b])[:, :, None] & inside(ys, y0[:, b], y1[:, b])[:, None, :]
            out[part] = (np.diff(xs, axis=1) * (held @ np.diff(ys, axis=1)[:, :, None])[:, :, 0]).sum(axis=1)
    return out


@F.pandas_udf(T.DoubleType())
def _covered(x0: pd.Series, y0: pd.Series, x1: pd.Series, y1: pd.Series) -> pd.Series:
    return pd.Series(union_areas(x0.to_list(), y0.to_list(), x1.to_list(), y1.to_list()), dtype="float64")


def covered_area(boxes: Column) -> Column:
    """Area of the union of each row's array of boxes."""
    return _covered(*(boxes[c] for c in BOX))


def union_coverage(footprints: DataFrame, area: DataFrame, by: str, tile: float = TILE) -> DataFrame:
    """(by, ratio): area of the union of each group's boxes over that of the area of interest, a box of one row; what lies outside it doesn't count.

    Boxes are cut to tiles, and a tile's boxes meet in one task, so a group of any size is spread. Groups that miss the area have no row.
    """
    aoi = area.select(*(F.col(c).alias(f"_{c}") for c in BOX))  # one row
    cut = [f(c, f"_{c}").alias(c) for c, f in zip(BOX, (F.greatest, F.greatest, F.least, F.least))]
    inside = footprints.join(F.broadcast(aoi)).select(by, *cut, box_area("_").alias("_all")).where("xmin < xmax and ymin < ymax")
    tiled = inside.withColumn("_t", F.explode(tiles(tile)))
    edges = [F.greatest("xmin", F.col("_t.tx") * tile), F.greatest("ymin", F.col("_t.ty") * tile), F.least("xmax", (F.col("_t.tx") + 1) * tile), F.least("ymax", (F.col("_t.ty") + 1) * tile)]
    pieces = tiled.select(by, "_t", "_all", F.struct(*(e.alias(c) for c, e in zip(BOX, edges))).alias("_b")).where("_b.xmin < _b.xmax and _b.ymin < _b.ymax")
    covered = pieces.groupBy(by, "_t", "_all").agg(F.collect_set("_b").alias("_b")).select(by, "_all", covered_area(F.col("_b")).alias("_a"))
    return covered.groupBy(by, "_all").agg(F.sum("_a").alias("_a")).select(by, (F.col("_a") / F.col("_all")).alias("ratio"))


def covered_areas(a: list[np.ndarray], b: list[np.ndarray], cells: int = 1 << 22) -> np.ndarray:
    """What the boxes ``b`` cover together of each box of ``a`` (x0, y0, x1, y1 each).

    All edges make a lattice; the covered area up to each of its corners, added up once, gives that of any box by its four
    corners. A lattice of over ``cells`` corners is cut: half of ``a`` meets the part of ``b`` in its bounds.
    """
    out = np.zeros(len(a[0]))
    todo, there = [np.flatnonzero(np.isfinite(sum(a)))], np.flatnonzero(np.isfinite(sum(b)))
    b = [v[there] for v in b]
    while todo:
        at = todo.pop()
        if not len(at):
            continue
        x0, y0, x1, y1 = (v[at] for v in a)
        low, high = (x0.min(), y0.min()), (x1.max(), y1.max())
        near = np.flatnonzero((b[0] < high[0]) & (b[2] > low[0]) & (b[1] < high[1]) & (b[3] > low[1]))
        u0, v0, u1, v1 = np.maximum(b[0][near], low[0]), np.maximum(b[1][near], low[1]), np.minimum(b[2][near], high[0]), np.minimum(b[3][near], high[1])
        xs, ys = np.unique(np.concatenate([x0, x1, u0, u1])), np.unique(np.concatenate([y0, y1, v0, v1]))
        if len(near) and len(xs) * len(ys) > cells:
            if len(at) > 1:
                order = at[np.argsort(x0 if high[0] - low[0] >= high[1] - low[1] else y0, kind="stable")]
                todo += [order[: len(at) // 2], order[len(at) // 2 :]]
            else:
                out[at] = union_area(u0, v0, u1, v1)
            continue
        change = np.zeros((len(xs), len(ys)), np.int32)
        (i0, i1), (j0, j1) = ([np.searchsorted(edges, v) for v in pair] for edges, pair in ((xs, (u0, u1)), (ys, (v0, v1))))
        for i, j, by in ((i0, j0, 1), (i1, j1, 1), (i0, j1, -1), (i1, j0, -1)):
            np.add.at(change, (i, j), by)
        held = change.cumsum(axis=0).cumsum(axis=1)[:-1, :-1] > 0
        upto = np.zeros(change.shape)
        upto[1:, 1:] = (held * np.diff(xs)[:, None] * np.diff(ys)).cumsum(axis=0).cumsum(axis=1)
        (i0, i1), (j0, j1) = ([np.searchsorted(edges, v) for v in pair] for edges, pair in ((xs, (x0, x1)), (ys, (y0, y1))))
        out[at] = upto[i1, j1] - upto[i0, j1] - upto[i1, j0] + upto[i0, j0]
    return out


def _distinct(boxes: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The rows in an order in which equal boxes lie together, and where in it each different one begins."""
    order = np.lexsort(boxes)
    return order, np.flatnonzero(np.r_[True, np.any([v[order][1:] != v[order][:-1] for v in boxes], axis=0)][: len(order)])


def _footprints(mine: pa.Table, theirs: pa.Table, lists: bool) -> pa.Table:
    """For each different footprint of a day its scenes, what the others of its window cover of it together, and their ids in order of (acquired, id).

    Without ``lists`` there is only whether there are any, as ``met``.
    """
    if not mine.num_rows:
        ids = pa.list_(theirs["other_id"].type)
        return pa.table([pa.array([], ids), *(pa.array([], pa.float64()) for _ in "ab"), pa.array([], ids if lists else pa.bool_())], names=["scene_ids", "area", "covered", "other_ids" if lists else "met"])
    a = [mine[c].to_numpy() for c in BOX]
    order, first = _distinct(a)
    boxes = [v[order[first]] for v in a]
    own = pa.ListArray.from_arrays(pa.array(np.r_[first, len(order)].astype(np.int32)), mine["scene_id"].combine_chunks().take(pa.array(order)))
    area = mine["area"].combine_chunks().take(pa.array(order[first]))
    theirs = theirs.sort_by([("other_day", "ascending"), ("other_id", "ascending")]) if theirs.num_rows else theirs
    b = [theirs[f"other_{c}"].to_numpy() if theirs.num_rows else np.zeros(0) for c in BOX]
    again, once = _distinct(b)
    theirs_once = [v[again[once]] for v in b]
    meets = lambda part, of: (part[0] <= of[2]) & (of[0] <= part[2]) & (part[1] <= of[3]) & (of[1] <= part[3])
    them = b if lists else theirs_once
    counts, met = [], []
    step = max(1, PAIRS // max(1, len(them[0])))
    for lo in range(0, len(first), step):
        i, j = np.nonzero(meets([v[lo : lo + step, None] for v in boxes], them))
        counts.append(np.bincount(i, minlength=min(step, len(first) - lo)))
        met.append(j)
    counts = np.concatenate([np.zeros(0, np.int64), *counts])
    out = pa.table({"scene_ids": own, "area": area, "covered": pa.array(covered_areas(boxes, theirs_once))})
    if not lists:
        return out.append_column("met", pa.array(counts > 0))
    ids = theirs["other_id"].combine_chunks().take(pa.array(np.concatenate(met))) if theirs.num_rows else pa.array([], own.type.value_type)
    return out.append_column("other_ids", pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(counts)].astype(np.int32)), ids))


def _meeting(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    return _footprints(mine, theirs, True)


def _meeting_share(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    return _footprints(mine, theirs, False)


def coincident_scenes(scenes: DataFrame, others: DataFrame, coverage: float = 0.99, days: int = 1, part: int = PART, lists: bool = True, shown: Callable[[Column], Column] = lambda ids: ids) -> DataFrame:
    """(scene_id, share, other_ids): the scenes of ``others`` from ``days`` before to less than ``days`` after, in order of (acquired, id).

    share is how much of the footprint they cover together; where it is less than ``coverage``, other_ids is NULL. The pairs
    grow with the square of a day's scenes, so they are not shuffled: a day's scenes, ``part`` at most, meet the others of
    its window in one group, where equal footprints are asked for once: they have the same share and list. A list holds what one
    footprint meets; ``shown`` is what to make of it before it is repeated for its scenes, which come out after each other.
    Without ``lists`` by_nbr stands in their place, whether there is one, and the result grows with the scenes.
    """
    kind = scenes.schema["scene_id"].dataType.simpleString()
    a = scenes.select("scene_id", F.col("acquired").alias("day"), *BOX, box_area().alias("area"))
    parts = a.where("day is not null").groupBy("day").agg(F.ceil(F.count("*") / part).cast("int").alias("_parts"))
    a = a.join(parts, "day", "left").withColumn("_part", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("scene_id"), "_parts")).otherwise(0).cast("int")).drop("_parts")
    window = F.explode(F.sequence(F.date_sub("acquired", days - 1), F.date_add("acquired", days))).alias("day")
    b = others.where("acquired is not null").select(F.col("scene_id").cast(kind).alias("other_id"), F.col("acquired").alias("other_day"), *(F.col(c).alias(f"other_{c}") for c in BOX), window)
    b = b.join(parts, "day").withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    groups = a.groupBy("day", "_part").cogroup(b.groupBy("day", "_part"))
    met = groups.applyInArrow(_meeting if lists else _meeting_share, f"scene_ids array<{kind}>, area double, covered double, " + (f"other_ids array<{kind}>" if lists else "met boolean"))
    some = F.size("other_ids") > 0 if lists else F.col("met")
    met = met.withColumn("share", F.coalesce(F.when(some, F.round(F.col("covered") / F.col("area"), 9)), F.lit(0.0)))
    enough = some & (F.col("share") >= coverage)
    kept = F.when(enough, shown(F.col("other_ids"))).alias("other_ids") if lists else enough.alias("by_nbr")
    return met.select(F.col("scene_ids"), "share", kept).select(F.explode("scene_ids").alias("scene_id"), "share", "other_ids" if lists else "by_nbr")


def mosaic(df: DataFrame, key: str, value: str, order: Column) -> DataFrame:
    """The last non-NULL value of each key."""
    return df.where(F.col(value).isNotNull()).groupBy(key).agg(F.max_by(value, order).alias(value))


def least_cloudy(scenes: DataFrame, *by: str) -> DataFrame:
    """The scene with the least cloud of each group, the smaller id of equals."""
    return scenes.groupBy(*by).agg(F.min_by("scene_id", F.struct("cloud_cover", "scene_id")).alias("scene_id"))


def pixel_median(df: DataFrame, key: str, value: str, name: str, where: Column | None = None) -> DataFrame:
    return (df if where is None else df.where(where)).groupBy(key).agg(F.median(value).alias(name))


def _clear(max_cloud: float) -> Column:
    """Observations of the season, under a cloud share, where bit 3 of the quality band is not set."""
    return (F.col("cloud_cover") <= max_cloud) & F.col("doy").between(FIRST_DOY, LAST_DOY) & (F.shiftright("qa", 3).bitwiseAND(F.lit(1)) == 0)


def lookback_pairs(targets: DataFrame, observations: DataFrame, lookback: int = 3, max_cloud: float = 20, values: tuple[str, ...] = ("v",), keep: tuple[str, ...] = ("acquired",)) -> DataFrame:
    """(pixel_id, year, keep, values): each target's clear in-season observations of the ``lookback`` years before: an equi-join on pixel and year."""
    clear = observations.where(_clear(max_cloud))
    keyed = clear.select("pixel_id", F.explode(F.sequence(F.col("year") + 1, F.col("year") + lookback)).alias("year"), *keep, *values)
    return targets.select("pixel_id", "year").join(keyed, ["pixel_id", "year"])


def _middle(ordered: Column) -> Column:
    """The median of a sorted array, NULL for an empty one."""
    n = F.size(ordered)
    at = lambda i: F.get(ordered, F.floor(i / 2).cast("int"))
    return F.when(n > 0, (at(n - 1) + at(n)) / 2)


def sorted_runs(observations: DataFrame, values: tuple[str, ...], max_cloud: float = 20) -> DataFrame:
    """(pixel_id, year, ``run_`` and each value's name): the clear in-season values of a pixel's year in order; empty where nothing was clear."""
    ok = _clear(max_cloud)
    return observations.groupBy("pixel_id", "year").agg(*(F.array_sort(F.collect_list(F.when(ok, F.col(v)))).alias(f"run_{v}") for v in values))


def lookback_median(targets: DataFrame, observations: DataFrame, lookback: int = 3, max_cloud: float = 20, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Every target with ``historical_`` and each value's name: the median of each band, NULL where nothing was seen.

    A pixel's year is one sorted run a band. A frame over years hands each target the runs of the years before; they are
    merged, as sorting joined runs does, and the middle is taken: no observation is repeated for the years that look back at it.
    """
    wanted = targets.select("pixel_id", "year").withColumn("_target", F.lit(True))
    runs = sorted_runs(observations, values, max_cloud).withColumn("_target", F.lit(False))
    frame = Window.partitionBy("pixel_id").orderBy("year").rangeBetween(-lookback, -1)
    met = runs.unionByName(wanted, allowMissingColumns=True).withColumns({f"run_{v}": F.collect_list(f"run_{v}").over(frame) for v in values}).where("_target")
    return met.select("pixel_id", "year", *(_middle(F.array_sort(F.flatten(f"run_{v}"))).alias(f"historical_{v}") for v in values))


def lookback_medians_of(observations: DataFrame, values: tuple[str, ...], lookback: int = 3, max_cloud: float = 20) -> list[Column]:
    """``historical_`` columns for the rows of ``observations`` themselves: a frame over the years of a pixel's rows, in one sort."""
    frame = Window.partitionBy("pixel_id").orderBy("year").rangeBetween(-lookback, -1)
    return [F.percentile(F.when(_clear(max_cloud), F.col(v)), F.lit(0.5)).over(frame).alias(f"historical_{v}") for v in values]


def rolling_lookback_median(observations: DataFrame, lookback: int = 3, max_cloud: float = 20, values: tuple[str, ...] = ("v",)) -> DataFrame:
    """Every observation with the medians of the clear in-season ones of the years before its own."""
    return observations.select("pixel_id", "acquired", *lookback_medians_of(observations, values, lookback, max_cloud))


def coverage_ratio(pixels: DataFrame, total: DataFrame, by: str) -> DataFrame:
    """(by, ratio): share of all pixels that each group covers."""
    everything = total.agg(F.countDistinct("pixel_id").alias("n"))
    return pixels.groupBy(by).agg(F.countDistinct("pixel_id").alias("k")).join(F.broadcast(everything)).select(by, (F.col("k") / F.col("n")).alias("ratio"))
