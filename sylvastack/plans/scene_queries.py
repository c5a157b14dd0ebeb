"""Queries on scene catalogues, joins of cells, regions and scenes, composites, and scene labels."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import geo as G
from ..functions import rings as R
from ..operators import label as LB
from ..operators import layers as L
from ..operators import sampling as SA
from ..operators import scenes as S
from ..sources.store import bucketed
from ..sources.workspace import fresh_folder
from .layer_queries import BASES, TCA
from .registry import query

r6 = lambda c, name: F.round(c, 6).alias(name)
_HIT = "{a}.xmin <= {b}.xmax and {b}.xmin <= {a}.xmax and {a}.ymin <= {b}.ymax and {b}.ymin <= {a}.ymax"


@query("scene_search", "select scene_id, acquired, cloud_cover from scenes where doy between 172 and 282 and cloud_cover <= 20 and year between 1995 and 1999 and xmin <= 60000 and xmax >= 10000 and ymin <= 60000 and ymax >= 10000")
def _(t):
    return S.scene_search(t.scenes, (10000, 10000, 60000, 60000), (1995, 1999), max_cloud=20).select("scene_id", "acquired", "cloud_cover")


@query("tm_union", "select scene_id, sensor, year from scenes where sensor = 'TM'")
def _(t):
    tm = t.scenes.where("sensor = 'TM'")
    parts = [tm.where(F.col("scene_id") % 4 == i) for i in range(4)]
    return S.union_collections(*parts).select("scene_id", "sensor", "year")


@query("ecozone_scan", "select distinct ecozone_id from ecozones")
def _(t):
    return t.ecozones.select("ecozone_id").distinct()


@query("cell_scan", "select cell_id, ecozone from cell_years")
def _(t):
    return t.cell_years.select("cell_id", "ecozone")


@query("calendar_filter", "select scene_id from scenes where doy between 172 and 282 and cloud_cover <= 20 and acquired >= date '1996-01-01' and acquired < date '1998-01-01'")
def _(t):
    inside = (F.col("acquired") >= F.lit("1996-01-01").cast("date")) & (F.col("acquired") < F.lit("1998-01-01").cast("date"))
    return S.scene_search(t.scenes, max_cloud=20).where(inside).select("scene_id")


@query("property_filter", "select id from cell_years where fire > 100 and harvest = 0 and year >= 1996")
def _(t):
    return t.cell_years.where((F.col("fire") > 100) & (F.col("harvest") == 0) & (F.col("year") >= 1996)).select("id")


@query("clip", "select pixel_id, x, y from disturbance where x >= 600 and x < 1800 and y >= 0 and y < 1500")
def _(t):
    return t.disturbance.where("x >= 600 and x < 1800 and y >= 0 and y < 1500").select("pixel_id", "x", "y")


@query("filter_bounds", "select scene_id from scenes where xmin <= 50000 and xmax >= 30000 and ymin <= 50000 and ymax >= 30000")
def _(t):
    return G.filter_bounds(t.scenes, 30000, 30000, 50000, 50000).select("scene_id")


@query("tile_join", f"select r.part_id, count(*) n from scenes l join ecozones r on {_HIT.format(a='l', b='r')} group by 1")
def _(t):
    pairs = G.tile_join(t.scenes.select("scene_id", *G.BOX), t.ecozones.select("part_id", *G.BOX), S.TILE)
    return pairs.groupBy(F.col("r.part_id").alias("part_id")).agg(F.count("*").alias("n"))


@query("cell_ecozone", f"select c.id, arg_min(e.ecozone_id, e.part_id)::int ecozone_id from cell_years c join ecozones e on {_HIT.format(a='c', b='e')} group by 1")
def _(t):
    return S.cell_region(t.cell_years, t.ecozones, key="id")


def _touching(box, name):
    """SQL that names ``name``: (key of b, part_id, ecozone_id) of boxes b, a SELECT with k and its edges, and the parts of region_corners that they touch."""
    side = "(x1 - x0) * ({y} - y0) - (y1 - y0) * ({x} - x0)"
    corners = ", ".join(side.format(x=x, y=y) for x in ("b.xmin", "b.xmax") for y in ("b.ymin", "b.ymax"))
    return f"""b as ({box}), ed as (select ecozone_id, part_id, x x0, y y0, coalesce(lead(x) over w, first(x) over w) x1, coalesce(lead(y) over w, first(y) over w) y1 from region_corners window w as (partition by part_id, ring order by i)),
    hit as (select k, part_id, any_value(ecozone_id) ecozone_id,
      bool_or(least(x0, x1) <= b.xmax and greatest(x0, x1) >= b.xmin and least(y0, y1) <= b.ymax and greatest(y0, y1) >= b.ymin and least({corners}) <= 0 and greatest({corners}) >= 0) edge,
      count(*) filter ((y0 > (b.ymin + b.ymax) / 2) <> (y1 > (b.ymin + b.ymax) / 2) and (b.xmin + b.xmax) / 2 < (x1 - x0) * ((b.ymin + b.ymax) / 2 - y0) / (y1 - y0) + x0) crossed from b, ed group by 1, 2),
    {name} as (select k, part_id, ecozone_id from hit where edge or crossed % 2 = 1)"""


def _regions(t):
    return R.rings_of(t.region_corners, ("ecozone_id", "part_id"))


@query("cell_region_polygon", f"with {_touching('select id k, xmin, ymin, xmax, ymax from cell_years', 'tp')} select k id, arg_min(ecozone_id, part_id)::int ecozone_id from tp group by 1")
def _(t):
    return S.cell_region(t.cell_years, _regions(t), key="id")


@query("filter_bounds_polygon", f"with {_touching('select scene_id k, xmin, ymin, xmax, ymax from scenes where cloud_cover <= 5', 'tp')} select distinct k scene_id from tp where ecozone_id = 1")
def _(t):
    """Scenes that touch any part of a region."""
    return R.region_join(S.scene_search(t.scenes, doys=(1, 366), max_cloud=5).select("scene_id", *G.BOX), _regions(t).where("ecozone_id = 1")).select(F.col("l.scene_id").alias("scene_id")).distinct()


@query("covering_grid_polygon", f"""with {_touching("select part || ':' || tx || ':' || ty k, part, tx, ty, tx * 7200.0::double - 480 xmin, ty * 7200.0::double - 480 ymin, (tx + 1) * 7200.0::double + 480 xmax, (ty + 1) * 7200.0::double + 480 ymax from (select part, tx, unnest(generate_series(y0, y1)) ty from (select *, unnest(generate_series(x0, x1)) tx from (select part_id part, floor(min(x) / 7200)::bigint x0, floor(max(x) / 7200)::bigint x1, floor(min(y) / 7200)::bigint y0, floor(max(y) / 7200)::bigint y1 from region_corners group by 1) q) q) q", 'tp')}
    select b.tx::int tx, b.ty::int ty, b.xmin, b.ymax from tp join b on b.k = tp.k and b.part = tp.part_id""")
def _(t):
    """The cells of each part's grid that touch the part itself."""
    return R.covering_cells(_regions(t), 128, 8).select("tx", "ty", "xmin", "ymax")


@query("region_cell_area", f"""with ed as (select part_id, x x0, y y0, coalesce(lead(x) over w, first(x) over w) x1, coalesce(lead(y) over w, first(y) over w) y1 from region_corners window w as (partition by part_id, ring order by i)) select part_id, round(sum(x0 * y1 - x1 * y0) / 2, 3) area from ed group by 1""")
def _(t):
    """Area of each part, added up from what of it lies in each tile of a lattice."""
    cut = _regions(t).withColumn("_t", F.explode(G.tiles(5000.0)))
    box = [F.col("_t.tx") * 5000.0, F.col("_t.ty") * 5000.0, (F.col("_t.tx") + 1) * 5000.0, (F.col("_t.ty") + 1) * 5000.0]
    return cut.select("part_id", R.clipped_area(F.col("rings"), *box).alias("a")).groupBy("part_id").agg(F.round(F.sum("a"), 3).alias("area"))


_SEEN = "cell_years c join scenes s on c.year = s.year and s.doy between 172 and 282 and (c.xmin+c.xmax)/2 between s.xmin and s.xmax and (c.ymin+c.ymax)/2 between s.ymin and s.ymax"


@query("image_overlap", f"select c.id, coalesce(n, 0) num_overlapping_images from cell_years c left join (select c.id, count(*) n from {_SEEN} group by 1) k on c.id = k.id")
def _(t):
    return S.image_overlap(t.cell_years, t.scenes).select("id", "num_overlapping_images")


@query("cell_scene_fanout", f"select c.id, s.scene_id from {_SEEN}")
def _(t):
    return S.cell_scenes(t.cell_years, t.scenes)


#: Scenes of the second sensor count where they cover this share of a footprint together.
COVERAGE = 0.5
#: Names m (footprints), met (their coincident scenes, cut to them) and co (share and ids); the union's area is the sum over the lattice of all edges.
_COINCIDE = f"""m as (select * from scenes where sensor = 'MSS'), tm as (select * from scenes where sensor = 'TM'),
    met as (select l.scene_id, r.scene_id other_id, r.acquired, greatest(l.xmin, r.xmin) x0, greatest(l.ymin, r.ymin) y0, least(l.xmax, r.xmax) x1, least(l.ymax, r.ymax) y1, (l.xmax - l.xmin) * (l.ymax - l.ymin) area
      from m l join tm r on r.acquired >= l.acquired - 1 and r.acquired < l.acquired + 1 and {_HIT.format(a='l', b='r')}),
    ex as (select scene_id, v a, lead(v) over (partition by scene_id order by v) b from (select scene_id, x0 v from met union select scene_id, x1 from met) q),
    ey as (select scene_id, v a, lead(v) over (partition by scene_id order by v) b from (select scene_id, y0 v from met union select scene_id, y1 from met) q),
    un as (select ex.scene_id, sum((ex.b - ex.a) * (ey.b - ey.a)) covered from ex join ey on ex.scene_id = ey.scene_id
      where exists (select 1 from met c where c.scene_id = ex.scene_id and x0 <= ex.a and x1 >= ex.b and y0 <= ey.a and y1 >= ey.b) group by 1),
    al as (select met.scene_id, round(coalesce(any_value(covered), 0) / any_value(area), 9) share, list(other_id order by acquired, other_id) ids from met left join un on met.scene_id = un.scene_id group by 1),
    co as (select m.scene_id, coalesce(share, 0) share, case when share >= {COVERAGE} then ids end ids from m left join al on m.scene_id = al.scene_id)"""


def coincident(t, **how):
    return S.coincident_scenes(t.scenes.where("sensor = 'MSS'"), t.scenes.where("sensor = 'TM'"), COVERAGE, **how)


@query("coincident_scene", f"with {_COINCIDE} select scene_id, share, array_to_string(ids, ',') other_ids from co")
def _(t):
    return coincident(t, shown=lambda ids: F.array_join(ids.cast("array<string>"), ",")).select("scene_id", "share", "other_ids")


_LATTICE = """with aoi as (select 12000 x0, 12000 y0, 84000 x1, 84000 y1),
    c as (select distinct year, x, unnest(generate_series(greatest(ymin, y0)::bigint, least(ymax, y1)::bigint - 1, 1000)) y from (select *, unnest(generate_series(greatest(xmin, x0)::bigint, least(xmax, x1)::bigint - 1, 1000)) x from scenes, aoi where cloud_cover <= 5 and doy between 172 and 282) q)
    select year, count(*) / 5184.0::double ratio from c group by 1"""


@query("footprint_coverage", _LATTICE)
def _(t):
    """Share of an area of interest that a year's nearly cloudless footprints cover together; all edges lie on whole kilometres, which the SQL counts."""
    aoi = t.spark.createDataFrame([(12000.0, 12000.0, 84000.0, 84000.0)], "xmin double, ymin double, xmax double, ymax double")
    return S.union_coverage(S.scene_search(t.scenes, max_cloud=5), aoi, "year")


_CLEAR = "cloud_cover <= 20 and doy between 172 and 282 and (qa // 8) % 2 = 0"
_TARGET = "select distinct pixel_id, year from observations"


@query("lookback_pairs", f"select a.pixel_id, a.year, b.acquired, b.v from ({_TARGET}) a join (select * from observations where {_CLEAR}) b on a.pixel_id = b.pixel_id and b.year between a.year - 3 and a.year - 1")
def _(t):
    return S.lookback_pairs(t.observations.select("pixel_id", "year").distinct(), t.observations)


@query("lookback_median", f"select a.pixel_id, a.year, round(median(b.v), 6) historical_v from ({_TARGET}) a left join (select * from observations where {_CLEAR}) b on a.pixel_id = b.pixel_id and b.year between a.year - 3 and a.year - 1 group by 1, 2")
def _(t):
    out = S.lookback_median(t.observations.select("pixel_id", "year").distinct(), t.observations)
    return out.select("pixel_id", "year", r6(F.col("historical_v"), "historical_v"))


@query("rolling_lookback_median", f"select pixel_id, acquired, round(quantile_cont(case when {_CLEAR} then v end, 0.5) over (partition by pixel_id order by year range between 3 preceding and 1 preceding), 6) historical_v from observations")
def _(t):
    return S.rolling_lookback_median(t.observations).select("pixel_id", "acquired", r6(F.col("historical_v"), "historical_v"))


@query("median_tca", f"select pixel_id, round(median({TCA} / 90.0), 6) median_tca from pixels p join scenes s on p.scene_id = s.scene_id where cloud_cover <= 20 and doy between 172 and 282 group by 1")
def _(t):
    rows = t.pixels.join(S.scene_search(t.scenes, max_cloud=20).select("scene_id"), "scene_id").withColumn("tca", B.normalize_tca(B.tasselled_cap_angle()))
    return S.pixel_median(rows, "pixel_id", "tca", "m").select("pixel_id", r6(F.col("m"), "median_tca"))


_NBR = "case when (qa // 64) % 2 = 1 and (qa // 16) % 2 <> 1 and sr_b4 >= 0 and sr_b7 >= 0 and sr_b4 + sr_b7 <> 0 then (sr_b4 - sr_b7) / (sr_b4 + sr_b7) end"


def _tm(t, scenes):
    return B.qa_clear_tm(t.tm_pixels_of(scenes).withColumn("nbr", B.nbr(F.col("sr_b4"), F.col("sr_b7"))), ["nbr"])


@query("median_nbr", f"select pixel_id, round(median({_NBR}), 6) median_nbr from tm_pixels p join scenes s on p.scene_id = s.scene_id where cloud_cover <= 20 and doy between 172 and 282 group by 1")
def _(t):
    rows = _tm(t, S.scene_search(t.scenes, max_cloud=20).select("scene_id"))
    return S.pixel_median(rows, "pixel_id", "nbr", "m").select("pixel_id", r6(F.col("m"), "median_nbr"))


@query("mosaic", "select pixel_id, nir from (select pixel_id, nir, row_number() over (partition by pixel_id order by scene_id desc) n from pixels where occlusion = 0) where n = 1")
def _(t):
    clear = t.pixels.withColumn("nir", F.when(F.col("occlusion") == 0, F.col("nir")))
    return S.mosaic(clear, "pixel_id", "nir", F.col("scene_id"))


@query("least_cloudy", "select year, scene_id from (select year, scene_id, row_number() over (partition by year order by cloud_cover, scene_id) n from scenes) where n = 1")
def _(t):
    return S.least_cloudy(t.scenes, "year")


@query("coverage_ratio", "select scene_id, count(distinct pixel_id)::double / (select count(distinct pixel_id) from disturbance) ratio from pixels group by 1")
def _(t):
    return S.coverage_ratio(t.pixels, t.disturbance, "scene_id")


@query("id_lookup", "select s.scene_id, s.acquired from scenes s join (select distinct l_orderkey k from lineitem) l on s.scene_id = l.k")
def _(t):
    return t.lineitem.select(F.col("l_orderkey").alias("scene_id")).distinct().join(t.scenes, "scene_id").select("scene_id", "acquired")


@query("doy", "select scene_id, doy - 1 - 171 as d from scenes")
def _(t):
    return t.scenes.select("scene_id", (F.dayofyear("acquired") - 1 - 171).alias("d"))


@query("date_window", "select scene_id, acquired - 1 lo, acquired + 1 hi, make_date(year, 1, 1) jan, make_date(year, 12, 31) dec from scenes")
def _(t):
    day = lambda m, d: F.make_date("year", F.lit(m), F.lit(d))
    return t.scenes.select("scene_id", F.date_sub("acquired", 1).alias("lo"), F.date_add("acquired", 1).alias("hi"), day(1, 1).alias("jan"), day(12, 31).alias("dec"))


@query("ecozone_index", "select id, coalesce(i, -1)::int idx from cell_years c left join (select ecozone_id, row_number() over (order by ecozone_id) - 1 i from (select distinct ecozone_id from ecozones)) e on c.ecozone = e.ecozone_id")
def _(t):
    ids = t.ecozones.agg(F.array_sort(F.collect_set("ecozone_id")).alias("ids"))  # regions are a fixed small layer
    return t.cell_years.join(F.broadcast(ids)).select("id", (F.array_position("ids", F.col("ecozone")) - 1).cast("int").alias("idx"))


@query("centroid_lonlat", "select scene_id, (xmin + xmax) / 2 cx, (ymin + ymax) / 2 cy from scenes")
def _(t):
    return G.bbox_ops(t.scenes, 0).select("scene_id", "cx", "cy")


@query("id_format", "select id, format('cell{:05d}_image{:05d}', cell_id, year) f, concat('ecozone', ecozone, '/', segment) g from cell_years")
def _(t):
    return t.cell_years.select("id", F.format_string("cell%05d_image%05d", "cell_id", "year").alias("f"), F.concat(F.lit("ecozone"), "ecozone", F.lit("/"), "segment").alias("g"))


@query("pixel_to_world", "select p.scene_id, pixel_id, s.xmin + 60.0 * col x, s.ymax - 60.0 * row y from pixels p join scenes s on p.scene_id = s.scene_id")
def _(t):
    rows = t.pixels.join(t.scenes.select("scene_id", "xmin", "ymax"), "scene_id")
    return G.pixel_to_world(rows, "xmin", "ymax").select("scene_id", "pixel_id", "x", "y")


@query("world_to_pixel", "select pixel_id, floor((x + 10) / 60)::int as col, floor((6000 - y) / 60)::int as row from disturbance")
def _(t):
    return G.world_to_pixel(t.disturbance.withColumns({"x0": F.lit(-10), "y0": F.lit(6000)}), "x0", "y0").select("pixel_id", "col", "row")


@query("snap_to_grid", "select pixel_id, floor(x / 240)::bigint cx, floor(y / 240)::bigint cy from disturbance30")
def _(t):
    return t.disturbance30.select("pixel_id", G.snap(F.col("x"), 240).alias("cx"), G.snap(F.col("y"), 240).alias("cy"))


_GRID = """select ((ty - floor(a.ymin / 7200)) * (floor(a.xmax / 7200) - floor(a.xmin / 7200) + 1) + tx - floor(a.xmin / 7200))::bigint cell_id, tx::int tx, ty::int ty, tx * 7200.0::double - 480 xmin, ty * 7200.0::double - 480 ymin, (tx + 1) * 7200.0::double + 480 xmax, (ty + 1) * 7200.0::double + 480 ymax, 7680.0::double "window"
    from (select *, unnest(generate_series(floor(a.ymin / 7200)::bigint, floor(a.ymax / 7200)::bigint)) ty from (select *, unnest(generate_series(floor(a.xmin / 7200)::bigint, floor(a.xmax / 7200)::bigint)) tx from (select min(xmin) xmin, min(ymin) ymin, max(xmax) xmax, max(ymax) ymax from scenes) a) a) a"""


def _aoi(t):
    return t.scenes.agg(*(F.min(c).alias(c) for c in ("xmin", "ymin")), *(F.max(c).alias(c) for c in ("xmax", "ymax")))


@query("covering_grid", _GRID)
def _(t):
    return G.covering_grid(_aoi(t), 128, 8)


@query("bbox_ops", "select scene_id, (xmin + xmax) / 2 cx, (xmax - xmin) * (ymax - ymin) area, xmin - 480 bxmin, ymax + 480 bymax from scenes")
def _(t):
    return G.bbox_ops(t.scenes, 480).select("scene_id", "cx", "area", "bxmin", "bymax")


@query("grid_row_ids", "select id, row_number() over (order by ymin, xmin, id) - 1 cell_id from cell_years")
def _(t):
    # Counts by ymin give each strip's offset, so no task sorts all cells.
    from pyspark.sql.window import Window

    strips = t.cell_years.groupBy("ymin").agg(F.count("*").alias("n"))
    offset = strips.withColumn("_base", F.coalesce(F.sum("n").over(Window.orderBy("ymin").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    at = F.row_number().over(Window.partitionBy("ymin").orderBy("xmin", "id")) - 1
    return t.cell_years.withColumn("_at", at).join(offset.select("ymin", "_base"), "ymin").select("id", (F.col("_base") + F.col("_at")).alias("cell_id"))


def _mss(t):
    """Scene pixels of the first sensor."""
    return t.pixels.join(t.scenes.where("sensor = 'MSS'").select("scene_id"), "scene_id")


def label_inputs(t, keep=()):
    """What the labels of the first sensor's scenes are made from: its pixels with their scene's facts, the second sensor and all layers by pixel."""
    shots = t.scenes.withColumn("in_season", F.col("doy").between(B.FIRST_DOY, B.LAST_DOY))
    pixels = t.pixels.withColumn("tca", B.normalize_tca(B.tasselled_cap_angle()))
    path = fresh_folder(t.spark, "covered")  # a row a scene, written as both sides ask for it
    coincident(t, lists=False).select("scene_id", "by_nbr").write.parquet(path)
    covered = t.spark.read.schema("scene_id long, by_nbr boolean").parquet(path)
    first = LB.first_sensor(pixels, shots.where("sensor = 'MSS'"), covered, keep)
    met = t.nbr_met(shots, (F.col("cloud_cover") <= LB.MEDIAN_CLOUD) & F.col("in_season"), covered.where("by_nbr"))
    return first, LB.second_sensor_met(met), LB.pixel_layers(t.disturbance, t.fine_disturbance, t.fine_landcover, t.years)


def _labelled(t, keep=()):
    """Pixels of the scenes of the first sensor with their label: base map of the year on the trees of the year before."""
    return LB.labelled(*label_inputs(t, keep))


_LABELS = f"""{_COINCIDE},
    ok as (select scene_id, sensor from scenes where cloud_cover <= 20 and doy between 172 and 282),
    nb as (select scene_id, pixel_id, case when (qa // 64) % 2 = 1 and (qa // 16) % 2 <> 1 and a >= 0 and b >= 0 and a + b <> 0 then (a - b) / (a + b) end nbr
      from (select scene_id, pixel_id, qa, sr_b4 * 0.0000275::double - 0.2::double a, sr_b7 * 0.0000275::double - 0.2::double b from tm_pixels) q),
    mt as (select pixel_id, median({TCA} / 90.0) median_tca from pixels p join ok on p.scene_id = ok.scene_id where sensor = 'MSS' group by 1),
    mn as (select pixel_id, median(nbr) median_nbr from nb join ok on nb.scene_id = ok.scene_id where sensor = 'TM' group by 1),
    {BASES},
    fd as (select pixel_id, list(distinct fire_year) fires, list(distinct harvest_year) harvests from fine_disturbance group by 1),
    mo as (select e.scene_id, nb.pixel_id, arg_max(nbr, place) nbr from (select scene_id, unnest(ids) other_id, generate_subscripts(ids, 1) place from co where ids is not null) e join nb on nb.scene_id = e.other_id where nbr is not null group by 1, 2),
    j as (select p.scene_id, p.pixel_id, s.year, fire_year, harvest_year, occlusion, base, {TCA} / 90.0 tca, p.qa, mo.nbr, median_tca, median_nbr, s.doy, co.ids is not null by_nbr, coalesce(list_contains(fires, s.year), false) fire_now, coalesce(list_contains(harvests, s.year), false) harvest_now
      from pixels p join scenes s on p.scene_id = s.scene_id join co on p.scene_id = co.scene_id left join disturbance d on p.pixel_id = d.pixel_id left join fd on p.pixel_id = fd.pixel_id left join bs on p.pixel_id = bs.pixel_id and s.year = bs.year
      left join mt on p.pixel_id = mt.pixel_id left join mn on p.pixel_id = mn.pixel_id left join mo on p.scene_id = mo.scene_id and p.pixel_id = mo.pixel_id),
    g as (select *, case when by_nbr then nbr <= median_nbr when (qa // 8) % 2 = 0 then tca <= median_tca end::int gate from j),
    k as (select *, coalesce(nullif(occlusion, 0) + 7, case when fire_now and gate <> 0 then 5 end, case when harvest_now and gate <> 0 then 7 end,
      case when fire_year < year and fire_year >= year - 3 then 4 end, case when harvest_year < year and harvest_year >= year - 10 then 6 end, base + 1)::int as label from g) """
_LABELLED = "with " + _LABELS


@query("disturbance_gate", _LABELLED + "select scene_id, pixel_id, gate from k")
def _(t):
    return _labelled(t).select("scene_id", "pixel_id", "gate")


@query("label_image", _LABELLED + "select scene_id, pixel_id, label from k")
def _(t):
    return _labelled(t).select("scene_id", "pixel_id", "label")


@query("add_label", _LABELLED + "select p.scene_id, p.pixel_id, p.nir, k.label from pixels p join k on p.scene_id = k.scene_id and p.pixel_id = k.pixel_id")
def _(t):
    return _labelled(t).select("scene_id", "pixel_id", "nir", "label")


_GAIN, _SUN = "(0.001::double * (1 + s.scene_id % 5))", "radians(20 + s.scene_id % 60)"
_TOA = ", ".join(f"({b} * {_GAIN} + 0.01::double) / sin({_SUN}) {b}" for b in B.BANDS[:4])
_PREPARED = f"""pr as (select p.scene_id, p.pixel_id, p.qa, s.year, s.doy, s.cloud_cover, s.xmin + 60.0 * p.col x, s.ymax - 60.0 * p.row y, {_TOA} from pixels p join scenes s on p.scene_id = s.scene_id where sensor = 'MSS'),
    pq as (select *, {TCA} / 90.0 tca, (nir - red) / (nir + red) ndvi from pr),
    hs as (select a.pixel_id, a.year, {", ".join(f"median(b.{b}) historical_{b}" for b in B.BANDS[:6])} from (select distinct pixel_id, year from pq) a
      left join (select * from pq where {_CLEAR}) b on a.pixel_id = b.pixel_id and b.year between a.year - 3 and a.year - 1 group by 1, 2),
    pp as (select pq.scene_id, pq.pixel_id, pq.x, pq.y, {", ".join(f"round({'coalesce(fine, coarse) / 3000.0' if b == 'dem' else ('hs.' if b in B.HISTORICAL else 'pq.') + b}, 5)::float {b}" for b in [*B.BANDS, *B.HISTORICAL])}
      from pq left join elevation e on pq.pixel_id = e.pixel_id left join hs on pq.pixel_id = hs.pixel_id and pq.year = hs.year)"""
_BANDS13 = ", ".join([*B.BANDS, *B.HISTORICAL])


def _sun():
    """Gain, offset and sun elevation, which come with the scene."""
    return (1 + F.col("scene_id") % 5) * 0.001, F.lit(0.01), 20 + F.col("scene_id") % 60


_SCENE_FACTS = ("year", "doy", "cloud_cover", "xmin", "ymax")


def with_bands(t, rows, keep):
    """The 13 model bands of scene pixels that carry their scene's facts, beside ``keep``: reflectance, derived bands, elevation, and each band's history, in a frame over the pixel's own years."""
    out = B.preprocess(G.pixel_to_world(rows, "xmin", "ymax"), L.dem(t.elevation), *_sun())
    histories = S.lookback_medians_of(out, tuple(B.BANDS[:6]))
    bands = [*B.BANDS, *B.HISTORICAL]
    return B.select_bands(out.select("*", *histories).withColumns({c: F.round(c, 5) for c in bands}), bands, keep)


def prepared(t, keep=("scene_id", "pixel_id")):
    """The 13 model bands of every scene pixel of the first sensor."""
    facts = t.scenes.where("sensor = 'MSS'").select("scene_id", *_SCENE_FACTS)
    return with_bands(t, t.pixels.join(facts, "scene_id"), keep)


def prepared_and_labelled(t, keep=("scene_id", "pixel_id", "label")):
    """The 13 bands and the label of every scene pixel, both on one row: the label is made from the bands as they came."""
    return with_bands(t, _labelled(t, _SCENE_FACTS), keep)


@query("prepare_image", f"with {_PREPARED} select scene_id, pixel_id, {_BANDS13} from pp")
def _(t):
    return prepared(t)


@query("prepare_image_and_label", f"{_LABELLED}, {_PREPARED} select pp.scene_id, pp.pixel_id, {", ".join("pp." + b for b in [*B.BANDS, *B.HISTORICAL])}, k.label from pp join k on pp.scene_id = k.scene_id and pp.pixel_id = k.pixel_id")
def _(t):
    return prepared_and_labelled(t)


@query("label_image_stored", _LABELLED + "select scene_id, pixel_id, label from k")
def _(t):
    """The same labels from the stored layout: inputs are written once in buckets by pixel_id, and labelling them needs no shuffle."""
    return LB.labelled(*(bucketed(df, name) for df, name in zip(label_inputs(t), ("first", "second", "layers")))).select("scene_id", "pixel_id", "label")


@query("export_metadata", f"""select c.id, s.scene_id, s.doy - 172 doy, coalesce(e.i, -1)::int ecozone_idx, (s.xmin + s.xmax) / 2 cx, (s.ymin + s.ymax) / 2 cy from {_SEEN}
    left join (select ecozone_id, row_number() over (order by ecozone_id) - 1 i from (select distinct ecozone_id from ecozones)) e on c.ecozone = e.ecozone_id""")
def export_metadata(t):
    """The day of the season, the place of the cell's region in the list of all regions, -1 if it isn't there, and the scene's centre, for each scene of each cell."""
    ids = t.ecozones.agg(F.array_sort(F.collect_set("ecozone_id")).alias("ids"))  # regions are a fixed small layer
    cells = t.cell_years.withColumn("ecozone_idx", F.coalesce(F.array_position(ids.scalar(), F.col("ecozone")) - 1, F.lit(-1)).cast("int"))
    centre = [((F.col(low) + F.col(high)) / 2).alias(c) for low, high, c in (("xmin", "xmax", "cx"), ("ymin", "ymax", "cy"))]
    pairs = S.cell_scenes(cells, t.scenes, of_cell=(F.col("ecozone_idx"),), of_scene=((F.col("doy") - 172).alias("doy"), *centre))
    return pairs.select("id", "scene_id", "doy", "ecozone_idx", "cx", "cy")


_ALL_THERE = " and ".join(f"{b} is not null" for b in [*B.BANDS, *B.HISTORICAL])
_LABELLED_BANDS = f"{_LABELLED}, {_PREPARED}, lp as (select pp.*, k.label, k.year from pp join k on pp.scene_id = k.scene_id and pp.pixel_id = k.pixel_id)"


@query("stratified_sample", _LABELLED_BANDS + f" select scene_id, pixel_id, label, {_BANDS13} from (select *, row_number() over (partition by scene_id, label order by md5('7:' || pixel_id), pixel_id) n from lp where {_ALL_THERE}) where n <= 2")
def _(t):
    """Points of each class in each scene, as far as no band is missing."""
    bands = [*B.BANDS, *B.HISTORICAL]
    return SA.stratified_sample(prepared_and_labelled(t), 2, ["scene_id", "label"], bands).select("scene_id", "pixel_id", "label", *bands)


@query("sample_points", _LABELLED_BANDS + f""" select id, scene_id, pixel_id, label, year, {_BANDS13} from (select c.id, lp.*, row_number() over (partition by c.id, lp.scene_id, label order by md5('7:' || lp.pixel_id), lp.pixel_id) n
    from {_SEEN} join lp on lp.scene_id = s.scene_id where lp.x >= c.xmin and lp.x < c.xmax and lp.y >= c.ymin and lp.y < c.ymax and {" and ".join("lp." + b + " is not null" for b in [*B.BANDS, *B.HISTORICAL])}) where n <= 2""")
def _(t):
    """Labelled points of each class in every scene of a cell, cut to the cell, with all 13 bands; points where one is missing are left out."""
    cells = t.cell_years.select("id", _place().alias("place"))
    return placed_points(t).join(cells, "place").select("id", "scene_id", "pixel_id", "label", "year", *_BANDS)


_BANDS = [*B.BANDS, *B.HISTORICAL]


def _place():
    return F.struct("year", *G.BOX)


#: What points need of a pixel beside its bands.
POINT = ("scene_id", "pixel_id", "x", "y", "year", "label")


def placed_points(t, pixels=None):
    """The points of ``sample_points`` once for all cells of equal year and box, which is their ``place``: those cells have the same points. ``pixels``: the labelled pixels, if they are there already.

    Cells repeat places again and again, so points and scenes meet places and not cells, and neither pairs nor the sample grow with cells times scenes.
    """
    places = t.cell_years.select("year", *G.BOX).distinct().withColumn("id", _place())
    seen = S.cell_scenes(places, t.scenes).withColumnRenamed("id", "place")
    points = (prepared_and_labelled(t, POINT) if pixels is None else pixels).join(seen, "scene_id")
    inside = (F.col("x") >= F.col("place.xmin")) & (F.col("x") < F.col("place.xmax")) & (F.col("y") >= F.col("place.ymin")) & (F.col("y") < F.col("place.ymax"))
    return SA.stratified_sample(points.where(inside), 2, ["place", "scene_id", "label"], _BANDS).select("place", "scene_id", "pixel_id", "label", "year", *_BANDS)


def training_points(t, pixels=None):
    """Each point of ``sample_points`` once, with ``cells``, how many of them have it."""
    n = t.cell_years.groupBy(_place().alias("place")).agg(F.count("*").alias("n"))
    return placed_points(t, pixels).join(n, "place").groupBy("scene_id", "pixel_id", "label", "year", *_BANDS).agg(F.sum("n").alias("cells"))
