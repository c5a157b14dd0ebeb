"""Polygons as rings: an array of rings, each an array of points (x, y) in order, the last joined to the first.

A point is inside by the even-odd rule over all rings, so one value holds regions of several parts and holes in them.
Coordinates are projected metres. Everything here is an expression that stays in the JVM, but for the clipped area.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .geo import BOX, covering_grid, level_join


def rings_of(vertices: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """(keys, rings, xmin, ymin, xmax, ymax) of a table with ring, i, x and y: one row a polygon, with its box. Rings of under three points enclose nothing."""
    ring = vertices.groupBy(*keys, "ring").agg(F.array_sort(F.collect_list(F.struct("i", "x", "y"))).alias("_p"), *(f(c).alias(f"{c}{e}") for c in ("x", "y") for f, e in ((F.min, "min"), (F.max, "max"))))
    points = F.transform("_p", lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    return ring.groupBy(*keys).agg(F.collect_list(points).alias("rings"), *((F.min if c.endswith("min") else F.max)(c).alias(c) for c in BOX))


def edges(rings: Column) -> Column:
    """All edges as structs (a, b) of points."""
    following = lambda r: F.concat(F.slice(r, 2, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))
    return F.flatten(F.transform(rings, lambda r: F.zip_with(r, following(r), lambda a, b: F.struct(a.alias("a"), b.alias("b")))))


def contains(rings: Column, x: Column, y: Column) -> Column:
    """A ray to the right of the point crosses an odd number of edges. Of points on an edge, those at a lower or left side of a region count as inside."""
    crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (x < (e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]) / (e["b"]["y"] - e["a"]["y"]) + e["a"]["x"])
    return F.size(F.filter(edges(rings), crosses)) % 2 == 1


def touches(rings: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """The polygon and the box share a point: an edge meets the box, or no edge does and the box lies inside."""

    def meets(e: Column) -> Column:
        a, b = e["a"], e["b"]
        near = (F.least(a["x"], b["x"]) <= xmax) & (F.greatest(a["x"], b["x"]) >= xmin) & (F.least(a["y"], b["y"]) <= ymax) & (F.greatest(a["y"], b["y"]) >= ymin)
        side = lambda px, py: (b["x"] - a["x"]) * (py - a["y"]) - (b["y"] - a["y"]) * (px - a["x"])
        corners = [side(px, py) for px in (xmin, xmax) for py in (ymin, ymax)]
        return near & (F.least(*corners) <= 0) & (F.greatest(*corners) >= 0)

    return F.exists(edges(rings), meets) | contains(rings, (xmin + xmax) / 2, (ymin + ymax) / 2)


def _clip(points: np.ndarray, box: tuple[float, float, float, float]) -> np.ndarray:
    """A ring cut to a box, side by side."""
    for axis, bound, sign in ((0, box[0], 1), (0, box[2], -1), (1, box[1], 1), (1, box[3], -1)):
        if not len(points):
            return points
        after = np.roll(points, -1, axis=0)
        here, there = sign * (points[:, axis] - bound), sign * (after[:, axis] - bound)
        kept = []
        for p, q, d, e in zip(points, after, here, there):
            if d >= 0:
                kept.append(p)
            if (d >= 0) != (e >= 0):
                kept.append(p + (q - p) * (d / (d - e)))
        points = np.array(kept).reshape(-1, 2)
    return points


def clipped_ring_area(x: np.ndarray, y: np.ndarray, box: tuple[float, float, float, float]) -> float:
    """Signed area of a ring within a box, positive if it runs against the clock."""
    points = _clip(np.column_stack([x, y]), box)
    following = np.roll(points, -1, axis=0)
    return float((points[:, 0] * following[:, 1] - following[:, 0] * points[:, 1]).sum() / 2) if len(points) else 0.0


@F.pandas_udf(T.DoubleType())
def _area(xs: pd.Series, ys: pd.Series, xmin: pd.Series, ymin: pd.Series, xmax: pd.Series, ymax: pd.Series) -> pd.Series:
    return pd.Series([sum(clipped_ring_area(np.asarray(x), np.asarray(y), box) for x, y in zip(a, b)) for a, b, *box in zip(xs, ys, xmin, ymin, xmax, ymax)], dtype="float64")


def clipped_area(rings: Column, xmin: Column, ymin: Column, xmax: Column, ymax: Column) -> Column:
    """Area of the polygon within a box. Outer rings run against the clock and holes with it, so that their areas add up."""
    part = lambda c: F.transform(rings, lambda r: F.transform(r, lambda p: p[c]))
    return _area(part("x"), part("y"), xmin, ymin, xmax, ymax)


def region_join(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """Pairs of boxes (alias l) and polygons (alias r) that share a point: an equi-join on tiles of their boxes, then the test on rings."""
    return level_join(boxes, regions, how=touches(F.col("r.rings"), *(F.col(f"l.{c}") for c in BOX)), finer=0)


def covering_cells(areas: DataFrame, chip: int, overlap: int = 0) -> DataFrame:
    """Cells of the grid over each area's box that touch the polygon itself."""
    grid = covering_grid(areas.select(*BOX, "rings"), chip, overlap, keep=("rings",))
    return grid.where(touches(F.col("rings"), *(F.col(c) for c in BOX))).drop("rings")
