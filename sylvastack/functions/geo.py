"""Planar boxes in projected metres: box arithmetic, the covering grid, affine transforms, and joins by tile key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bands import PIXEL

BOX = ("xmin", "ymin", "xmax", "ymax")
DEALT = 4


def overlaps(a: str, b: str) -> Column:
    """Boxes of the aliases share a point; edges count."""
    c = F.col
    return (c(f"{a}.xmin") <= c(f"{b}.xmax")) & (c(f"{b}.xmin") <= c(f"{a}.xmax")) & (c(f"{a}.ymin") <= c(f"{b}.ymax")) & (c(f"{b}.ymin") <= c(f"{a}.ymax"))


def filter_bounds(df: DataFrame, xmin: float, ymin: float, xmax: float, ymax: float) -> DataFrame:
    return df.where((F.col("xmin") <= xmax) & (F.col("xmax") >= xmin) & (F.col("ymin") <= ymax) & (F.col("ymax") >= ymin))


def box_area(prefix: str = "") -> Column:
    c = lambda n: F.col(prefix + n)
    return (c("xmax") - c("xmin")) * (c("ymax") - c("ymin"))


def shared_area(a: str, b: str) -> Column:
    """Area that the boxes of two aliases have in common."""
    c = F.col
    width = F.least(c(f"{a}.xmax"), c(f"{b}.xmax")) - F.greatest(c(f"{a}.xmin"), c(f"{b}.xmin"))
    height = F.least(c(f"{a}.ymax"), c(f"{b}.ymax")) - F.greatest(c(f"{a}.ymin"), c(f"{b}.ymin"))
    return F.greatest(width, F.lit(0.0)) * F.greatest(height, F.lit(0.0))


def bbox_ops(df: DataFrame, buffer: float) -> DataFrame:
    return df.withColumns({
        "cx": (F.col("xmin") + F.col("xmax")) / 2, "cy": (F.col("ymin") + F.col("ymax")) / 2, "area": box_area(),
        "bxmin": F.col("xmin") - buffer, "bymin": F.col("ymin") - buffer, "bxmax": F.col("xmax") + buffer, "bymax": F.col("ymax") + buffer,
    })


def snap(value: Column, step: float = PIXEL) -> Column:
    return F.floor(value / step).cast("long")


def pixel_to_world(df: DataFrame, x0: str, y0: str) -> DataFrame:
    return df.withColumns({"x": F.col(x0) + PIXEL * F.col("col"), "y": F.col(y0) - PIXEL * F.col("row")})


def world_to_pixel(df: DataFrame, x0: str, y0: str) -> DataFrame:
    return df.withColumns({"col": F.floor((F.col("x") - F.col(x0)) / PIXEL).cast("int"), "row": F.floor((F.col(y0) - F.col("y")) / PIXEL).cast("int")})


def tiles(tile: float, box: str = "") -> Column:
    """Every tile that a box touches, as structs (tx, ty)."""
    c = lambda n: F.floor(F.col(box + n) / tile).cast("int")
    return F.flatten(F.transform(F.sequence(c("xmin"), c("xmax")), lambda x: F.transform(F.sequence(c("ymin"), c("ymax")), lambda y: F.struct(x.alias("tx"), y.alias("ty")))))


def tile_join(left: DataFrame, right: DataFrame, tile: float, on: Column | None = None, how: Column | None = None) -> DataFrame:
    """Pairs of rows with overlapping boxes, aliases ``l`` and ``r``: an equi-join on tiles, each pair only in its last shared tile.

    ``on`` adds equalities to the join key, ``how`` further conditions; both may use the aliases.
    """
    a = left.withColumn("_tile", F.explode(tiles(tile))).alias("l")
    b = right.withColumn("_tile", F.explode(tiles(tile))).alias("r")
    first = lambda axis: F.greatest(F.floor(F.col(f"l.{axis}min") / tile), F.floor(F.col(f"r.{axis}min") / tile))
    once = (F.col("l._tile.tx") == first("x")) & (F.col("l._tile.ty") == first("y"))
    key = F.col("l._tile") == F.col("r._tile")
    for extra in (on, how):
        key = key if extra is None else key & extra
    return a.join(b, key & overlaps("l", "r") & once)


def _levelled(df: DataFrame, finer: int) -> DataFrame:
    """``_level``: the binary logarithm of the tile that a box is stored in, by its longer side; boxes under a metre count as a metre."""
    side = F.greatest(F.col("xmax") - F.col("xmin"), F.col("ymax") - F.col("ymin"), F.lit(1.0))
    return df.withColumn("_level", F.ceil(F.log2(side)).cast("int") - finer)


def _levels(df: DataFrame) -> DataFrame:
    """One row: the levels of a side and the longest sides on each."""
    each = df.groupBy("_level").agg(F.max(F.col("xmax") - F.col("xmin")).alias("w"), F.max(F.col("ymax") - F.col("ymin")).alias("h"))
    return each.agg(F.collect_list(F.struct(F.col("_level").alias("level"), "w", "h")).alias("_levels"))


def _level_keys(df: DataFrame, others: DataFrame, stored: int, smaller: bool) -> DataFrame:
    """``_key``: a row's own key, and one for each tile of a level of the other side in which a box that touches it can be stored.

    ``stored``: the number that marks the own keys; a row looks up levels above its own, or from it on unless ``smaller``.
    """
    tile = lambda v, level: F.floor(v / F.pow(F.lit(2.0), level)).cast("int")
    key = lambda kind, level, x, y: F.struct(F.lit(kind).alias("kind"), level.alias("level"), x.alias("x"), y.alias("y"))
    own = F.array(key(stored, F.col("_level"), tile(F.col("xmin"), F.col("_level")), tile(F.col("ymin"), F.col("_level"))))
    wanted = F.filter("_levels", lambda l: l["level"] > F.col("_level") if smaller else l["level"] >= F.col("_level"))
    span = lambda axis, long, l: F.sequence(tile(F.col(f"{axis}min") - l[long], l["level"]), tile(F.col(f"{axis}max"), l["level"]))
    at = lambda l: F.flatten(F.transform(span("x", "w", l), lambda x: F.transform(span("y", "h", l), lambda y: key(1 - stored, l["level"], x, y))))
    return df.withColumn("_levels", others.scalar()).withColumn("_key", F.explode(F.concat(own, F.flatten(F.transform(wanted, at))))).drop("_levels")


def level_join(left: DataFrame, right: DataFrame, on: Column | None = None, how: Column | None = None, finer: int = 1, deal: tuple[str, ...] = ()) -> DataFrame:
    """Pairs of rows with overlapping boxes, aliases ``l`` and ``r``, where boxes may have any sizes: an equi-join on tiles of a quadtree.

    A box is stored once, in the tile of its lower left corner on the level of its size; the smaller box of a pair looks
    the larger one up, so a row has a few keys for each level of the other side (points and boxes alike) and a pair meets
    once. ``finer``: levels below the box's size on which it is stored; more of them give more keys and fewer candidates.
    ``on`` adds equalities to the join key, ``how`` further conditions; both may use the aliases. ``deal``: the columns of
    ``right`` in ``on``, where far more comes out than goes in; it is then dealt to ``DEALT`` times the shuffle partitions, however small they are.
    """
    left, right = _levelled(left, finer), _levelled(right, finer)
    a, b = _level_keys(left, _levels(right), 0, False).alias("l"), _level_keys(right, _levels(left), 1, True).alias("r")
    if deal:
        b = b.repartition(DEALT * int(b.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_key", *deal).alias("r")
    key = F.col("l._key") == F.col("r._key")
    for extra in (on, how):
        key = key if extra is None else key & extra
    return a.join(b, key & overlaps("l", "r"))


def covering_grid(areas: DataFrame, chip: int, overlap: int = 0, keep: tuple[str, ...] = ()) -> DataFrame:
    """Cells that touch the box of an area: stride (chip - overlap) pixels from the origin, box grown by ``overlap`` pixels each side, and the window that a reader takes.

    cell_id comes from the tile's place in the area's lattice, so no global order is needed.
    """
    stride, grow = (chip - overlap) * PIXEL, overlap * PIXEL
    low = lambda n: F.floor(F.col(n) / stride).cast("int")
    across = low("xmax") - low("xmin") + 1
    grid = areas.withColumn("tx", F.explode(F.sequence(low("xmin"), low("xmax")))).withColumn("ty", F.explode(F.sequence(low("ymin"), low("ymax"))))
    place = (F.col("ty") - low("ymin")) * across + (F.col("tx") - low("xmin"))
    return grid.select(
        place.cast("long").alias("cell_id"), "tx", "ty",
        (F.col("tx") * stride - grow).alias("xmin"), (F.col("ty") * stride - grow).alias("ymin"),
        ((F.col("tx") + 1) * stride + grow).alias("xmax"), ((F.col("ty") + 1) * stride + grow).alias("ymax"),
        F.lit(chip * PIXEL).alias("window"), *keep,
    )
