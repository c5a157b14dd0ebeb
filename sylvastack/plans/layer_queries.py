"""Queries on land-cover and disturbance layers, masks, and band arithmetic."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import geo as G
from ..functions import mask as M
from ..operators import layers as L
from .registry import query

r6 = lambda c, name: F.round(c, 6).alias(name)
CODES = ", ".join(map(str, B.LANDCOVER_CODES))
DIST = "case when fire_year = year then 2 when fire_year < year then 1 when harvest_year = year then 4 when harvest_year < year then 3 else 0 end"


def _by_year(t):
    return t.disturbance.crossJoin(F.broadcast(t.years))  # a row for each year of the archive


@query("landcover_year", "select pixel_id, arg_min(lc, acquired)::int lc from landcover where year = greatest(1996, (select min(year) from landcover)) group by 1")
def _(t):
    return L.landcover_year(t.landcover, 1996, first_year=1997)


@query("disturbance_scan", "select pixel_id, fire_year, harvest_year from disturbance")
def _(t):
    return L.check_disturbance(t.disturbance).select("pixel_id", "fire_year", "harvest_year")


@query("dem", "select pixel_id, round(coalesce(fine, coarse) / 3000.0, 6) dem from elevation")
def _(t):
    return L.dem(t.elevation).select("pixel_id", r6(F.col("dem"), "dem"))


@query("select_bands", "select scene_id, pixel_id, nir::float nir, red_edge::float red_edge, red::float red, green::float green from pixels")
def _(t):
    return B.select_bands(t.pixels, B.BANDS[:4], ("scene_id", "pixel_id"))


@query("rename_regex", "select scene_id, pixel_id, nir historical_nir, red historical_red from pixels")
def _(t):
    return B.rename_bands(t.pixels.select("scene_id", "pixel_id", "nir", "red"), ["nir", "red"])


@query("update_mask", "select scene_id, pixel_id, case when occlusion <> 0 then nir end nir from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", M.update_mask(F.col("nir"), F.col("occlusion")).alias("nir"))


@query("self_mask", "select scene_id, pixel_id, nullif(occlusion, 0) occlusion from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", M.self_mask(F.col("occlusion")).alias("occlusion"))


@query("unmask", "select pixel_id, coalesce(fire_year, 0) fire_year from disturbance")
def _(t):
    return t.disturbance.select("pixel_id", M.unmask(F.col("fire_year")).alias("fire_year"))


@query("blend", "select pixel_id, coalesce(fire_year, harvest_year) y from disturbance")
def _(t):
    return t.disturbance.select("pixel_id", M.blend(F.col("harvest_year"), F.col("fire_year")).alias("y"))


@query("mask_and_or", "select pixel_id, case when fire_year is not null and harvest_year is not null then (fire_year > 1997 and harvest_year > 1997)::int end a, case when fire_year is not null and harvest_year is not null then (fire_year > 1997 or harvest_year > 1997)::int end o from disturbance")
def _(t):
    a, b = ((F.col(c) > 1997).cast("int") for c in ("fire_year", "harvest_year"))
    return t.disturbance.select("pixel_id", M.both(a, b).alias("a"), M.either(a, b).alias("o"))


@query("set_property", "select scene_id, cloud_cover / 100.0 cloud_share from scenes")
def _(t):
    return t.scenes.withColumns({"cloud_share": F.col("cloud_cover") / 100.0}).select("scene_id", "cloud_share")


@query("conditional", "select scene_id, case when sensor = 'TM' then cloud_cover else -1 end v from scenes")
def _(t):
    return t.scenes.select("scene_id", F.when(F.col("sensor") == "TM", F.col("cloud_cover")).otherwise(-1).alias("v"))


@query("landcover_remap", f"select pixel_id, year, acquired, (list_position([{CODES}], lc) - 1)::int dense from landcover_archive")
def _(t):
    return t.landcover_archive.select("pixel_id", "year", "acquired", B.landcover_remap(F.col("lc")).alias("dense"))


@query("class_weight", "select vec_id, case when label in (4,5,6,7) then 1.5 else 1.0 end::double w from embeddings")
def _(t):
    return t.embeddings.select("vec_id", B.class_weight(F.col("label")).alias("w"))


_REDUCED = "select floor(x/60)::bigint as col, floor(y/60)::bigint as row, max({v})::int v from disturbance30 group by 1, 2"


@query("reduce_resolution", _REDUCED.format(v="case when fire_year is not null then 1 else 0 end"))
def _(t):
    return L.reduce_resolution(t.disturbance30.withColumn("v", F.col("fire_year").isNotNull().cast("int")), ["v"])


@query("treed_mask", _REDUCED.format(v="case when lc = 81 or lc >= 210 then 1 else 0 end"))
def _(t):
    return L.reduce_resolution(t.disturbance30.withColumn("v", L.treed()), ["v"])


@query("water_mask", _REDUCED.format(v="case when lc <> 20 then 1 else 0 end"))
def _(t):
    return L.reduce_resolution(t.disturbance30.withColumn("v", L.not_water()), ["v"])


def _map(name, layer, op):
    @query(name, f"select year, floor(x/60)::bigint as col, floor(y/60)::bigint as row, max(coalesce(({layer} {op} year)::int, 0))::int v from disturbance30, years group by 1, 2, 3")
    def _(t):
        # Reduced to the years of each coarse pixel first; only coarse pixels meet the years of the archive.
        place = t.disturbance30.withColumns({"col": G.snap(F.col("x")), "row": G.snap(F.col("y"))})
        rows = L.disturbance_years(place, ("col", "row")).crossJoin(F.broadcast(t.years))
        return rows.select("year", "col", "row", L.reduced_event(F.col(f"{layer}s"), F.col("year"), op == "<").alias("v"))


for _n, _l, _o in (("fire_map", "fire_year", "="), ("harvest_map", "harvest_year", "="), ("previous_fire_map", "fire_year", "<"), ("previous_harvest_map", "harvest_year", "<")):
    _map(_n, _l, _o)


@query("basemap", """with w as (select pixel_id, arg_min(lc, acquired) lc from landcover where year = 1998 group by 1), f as (select pixel_id, arg_min(lc, acquired) lc from landcover where year = 1997 group by 1)
    select f.pixel_id, case when w.lc = 20 then 2 when f.lc = 81 or f.lc >= 210 then 1 else 0 end base from f join w on f.pixel_id = w.pixel_id""")
def _(t):
    return L.basemap(L.landcover_year(t.landcover, 1997, first_year=1997), L.landcover_year(t.landcover, 1998, first_year=1997))


#: Names bs: the base of each pixel in each scene year, from finer pixels; neither map is older than the land cover.
BASES = """fy as (select pixel_id, x, y, year, arg_min(lc, acquired) lc from fine_landcover group by all),
    ry as (select pixel_id, year, max(case when lc = 81 or lc >= 210 then 1 else 0 end) treed, max(case when lc <> 20 then 1 else 0 end) dry from fy group by all),
    fl as (select min(year) y from fine_landcover),
    bs as (select w.pixel_id, years.year, case when w.dry = 0 then 2 else f.treed end base from years, fl, ry w, ry f where w.year = greatest(years.year, fl.y) and f.pixel_id = w.pixel_id and f.year = greatest(years.year - 1, fl.y))"""


@query("basemaps", f"with {BASES} select pixel_id, year, base from bs")
def _(t):
    """The base of every year of the archive, those before the land cover included."""
    return L.basemaps(t.fine_landcover, t.years, lookback=1).select("pixel_id", F.explode("bases").alias("year", "base"))


@query("disturbance_map", f"select pixel_id, year, {DIST} d from disturbance, years")
def _(t):
    return _by_year(t).select("pixel_id", "year", L.disturbance_map(F.col("year")).alias("d"))


@query("disturbance_map_as_written", "select pixel_id, year, case when fire_year = year then 2 when fire_year < year then 1 else 0 end d from disturbance, years")
def _(t):
    return _by_year(t).select("pixel_id", "year", L.disturbance_map(F.col("year"), as_written=True).alias("d"))


@query("disturbed_regions", "select pixel_id, year, greatest(coalesce((fire_year = year)::int, 0), coalesce((harvest_year = year)::int, 0)) d from disturbance, years")
def _(t):
    return _by_year(t).select("pixel_id", "year", L.disturbed_regions(F.col("year")).alias("d"))


_LABEL = f"case when ({DIST}) > 0 then ({DIST}) + 3 when lc = 20 then 3 when lc = 81 or lc >= 210 then 2 else 1 end"


def annual_labels(t):
    base = F.coalesce(F.when(L.not_water() == 0, 2), L.treed())
    return _by_year(t).select("pixel_id", "year", L.annual_label(base, L.disturbance_map(F.col("year"))).alias("cls"))


@query("annual_label", f"select pixel_id, year, {_LABEL} cls from disturbance, years")
def _(t):
    return annual_labels(t)


@query("annual_class_area", f"select year, cls, count(*) n, round(count(*) * 0.36::double, 2) ha from (select year, {_LABEL} cls from disturbance, years) group by 1, 2")
def _(t):
    return L.area_hectares(annual_labels(t), "year", "cls")


@query("proportional_area", "select lc, count(*) n, round(count(*) * 0.36::double, 2) ha from landcover_archive group by 1")
def _(t):
    return L.area_hectares(t.landcover_archive, "lc")


@query("mode_pyramid", """select r as row, c as col, arg_min(lc, k)::int lc from (select floor(y/240)::bigint r, floor(x/240)::bigint c, lc, row_number() over (partition by floor(y/240), floor(x/240) order by count(*) desc, lc) k from disturbance group by floor(y/240), floor(x/240), lc) group by 1, 2""")
def _(t):
    grid = t.disturbance.select((F.col("y") / 60).alias("row"), (F.col("x") / 60).alias("col"), "lc")
    return L.mode_pyramid(grid, "lc", 2)


@query("mode_pyramids", " union all ".join(f"select {k} as level, r as row, c as col, arg_min(lc, k)::int lc from (select floor(y/{60 << k})::bigint r, floor(x/{60 << k})::bigint c, lc, row_number() over (partition by floor(y/{60 << k}), floor(x/{60 << k}) order by count(*) desc, lc) k from disturbance group by floor(y/{60 << k}), floor(x/{60 << k}), lc) q group by 2, 3" for k in (1, 2, 3, 4)))
def _(t):
    return L.mode_pyramids(t.disturbance.select((F.col("y") / 60).cast("long").alias("row"), (F.col("x") / 60).cast("long").alias("col"), "lc"), "lc", 4)


@query("ever_land", "select pixel_id, max(case when lc > 0 and lc <> 20 then 1 else 0 end)::int land from landcover group by 1")
def _(t):
    return L.ever_land(t.landcover)


@query("qa_clear_tm", "select scene_id, pixel_id, case when (qa // 64) % 2 = 1 and (qa // 16) % 2 <> 1 then sr_b4 end sr_b4 from tm_pixels")
def _(t):
    return B.qa_clear_tm(t.tm_pixels, ["sr_b4"]).select("scene_id", "pixel_id", "sr_b4")


@query("qa_clear_mss", "select scene_id, pixel_id, case when (qa // 8) % 2 = 0 then nir end nir from pixels")
def _(t):
    return B.qa_clear_mss(t.pixels, ["nir"]).select("scene_id", "pixel_id", "nir")


@query("qa_mask_column", "select scene_id, pixel_id, ((qa // 8) % 2 = 0)::int qa_mask from pixels")
def _(t):
    return B.qa_mask_column(t.pixels).select("scene_id", "pixel_id", "qa_mask")


@query("bitwise_extract", "select scene_id, pixel_id, (qa // 8) % 8 v from tm_pixels")
def _(t):
    return t.tm_pixels.select("scene_id", "pixel_id", B.bitwise_extract(F.col("qa"), 3, 5).alias("v"))


@query("tm_scale", "select scene_id, pixel_id, sr_b4 * 0.0000275::double - 0.2::double sr_b4, st_b6 * 0.00341802::double + 149.0::double st_b6 from tm_pixels")
def _(t):
    return B.tm_scale(t.tm_pixels, ["sr_b4"], ["st_b6"]).select("scene_id", "pixel_id", "sr_b4", "st_b6")


@query("nbr", "select scene_id, pixel_id, round(case when sr_b4 >= 0 and sr_b7 >= 0 and sr_b4 + sr_b7 <> 0 then (sr_b4 - sr_b7) / (sr_b4 + sr_b7) end, 6) nbr from tm_pixels")
def _(t):
    return t.tm_pixels.select("scene_id", "pixel_id", r6(B.nbr(F.col("sr_b4"), F.col("sr_b7")), "nbr"))


@query("process_tm", """with s as (select scene_id, pixel_id, sr_b4 * 0.0000275::double - 0.2 a, sr_b7 * 0.0000275::double - 0.2 b, (qa // 64) % 2 = 1 and (qa // 16) % 2 <> 1 ok from tm_pixels)
    select scene_id, pixel_id, round(case when ok and a >= 0 and b >= 0 and a + b <> 0 then (a - b) / (a + b) end, 5) nbr from s""")
def _(t):
    return B.process_tm(t.tm_pixels).select("scene_id", "pixel_id", F.round("nbr", 5).alias("nbr"))


@query("ndvi", "select scene_id, pixel_id, round(case when nir + red <> 0 then (nir - red) / (nir + red) end, 6) ndvi from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", r6(B.ndvi(F.col("nir"), F.col("red")), "ndvi"))


TCA = "degrees(atan((green * -0.290 + red * -0.562 + red_edge * 0.600 + nir * 0.491) / (green * 0.433 + red * 0.632 + red_edge * 0.586 + nir * 0.264)))"


@query("tasselled_cap", f"select scene_id, pixel_id, round({TCA}, 6) tca from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", r6(B.tasselled_cap_angle(), "tca"))


@query("normalize_tca", f"select scene_id, pixel_id, round({TCA} / 90.0, 6) tca from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", r6(B.normalize_tca(B.tasselled_cap_angle()), "tca"))


@query("toa", "select p.scene_id, pixel_id, round((qa * (0.001 * (1 + s.scene_id % 5)) + 0.01) / sin(radians(20 + s.scene_id % 60)), 6) toa from pixels p join scenes s on p.scene_id = s.scene_id")
def _(t):
    rows = t.pixels.join(t.scenes.select("scene_id"), "scene_id")
    gain, sun = (1 + F.col("scene_id") % 5) * 0.001, 20 + F.col("scene_id") % 60
    return rows.select("scene_id", "pixel_id", r6(B.toa(F.col("qa"), gain, F.lit(0.01), sun), "toa"))


_LIT = ", ".join(f"({b} * (0.001 * (1 + s.scene_id % 5)) + 0.01) / sin(radians(20 + s.scene_id % 60)) {b}" for b in B.BANDS[:4])


@query("preprocess", f"""with pr as (select p.scene_id, p.pixel_id, s.xmin + 60.0 * p.col x, s.ymax - 60.0 * p.row y, {_LIT} from pixels p join scenes s on p.scene_id = s.scene_id)
    select scene_id, p.pixel_id, round(nir, 6) nir, round({TCA} / 90.0, 6) tca, round((nir - red) / (nir + red), 6) ndvi, round(coalesce(fine, coarse) / 3000.0, 6) dem, floor(x / 60)::bigint grid_col, floor(y / 60)::bigint grid_row from pr p left join elevation e on p.pixel_id = e.pixel_id""")
def _(t):
    rows = G.pixel_to_world(t.pixels.join(t.scenes.select("scene_id", "xmin", "ymax"), "scene_id"), "xmin", "ymax")
    out = B.preprocess(rows, L.dem(t.elevation), (1 + F.col("scene_id") % 5) * 0.001, F.lit(0.01), 20 + F.col("scene_id") % 60)
    return out.select("scene_id", "pixel_id", *(r6(F.col(c), c) for c in ("nir", "tca", "ndvi", "dem")), "grid_col", "grid_row")


@query("occlusion_code", "select scene_id, pixel_id, nullif(occlusion, 0) + 7 code from pixels")
def _(t):
    return t.pixels.select("scene_id", "pixel_id", B.occlusion_code(F.col("occlusion")).alias("code"))


@query("label_smoothing", "select vec_id, case label when 1 then 0.8 when 4 then 0.85 when 5 then 0.85 when 6 then 0.85 when 7 then 0.85 else 1.0 end::double own, case label when 1 then 0.05 when 4 then 0.1 when 5 then 0.85 else 0.0 end::double fire from embeddings")
def _(t):
    out = B.smooth_labels(t.embeddings.select("vec_id", "label"))
    return out.select("vec_id", F.col("p")[F.col("label")].alias("own"), F.col("p")[5].alias("fire"))


@query("one_hot", "select vec_id, list_transform(range(10), lambda i: (i = label)::double) p from embeddings")
def _(t):
    return t.embeddings.select("vec_id", B.one_hot(F.col("label")).alias("p"))


@query("argmax", "select pixel_id, t, (list_position(p, list_max(p)) - 1)::int cls from class_probs")
def _(t):
    return t.class_probs.select("pixel_id", "t", B.argmax(F.col("p")).alias("cls"))


@query("gather_bands", "select vec_id, [embedding[1], embedding[4], embedding[8]] v from embeddings")
def _(t):
    return t.embeddings.select("vec_id", B.gather(F.col("embedding"), [0, 3, 7]).alias("v"))


@query("split_inputs", "select vec_id, embedding[1:7] current, embedding[8:13] historical from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.slice("embedding", 1, 7).alias("current"), F.slice("embedding", 8, 6).alias("historical"))


@query("assemble_vector", "select p.scene_id, pixel_id, [s.doy::float, nir::float, red_edge::float, red::float, green::float] features from pixels p join scenes s on p.scene_id = s.scene_id")
def _(t):
    scenes = t.scenes.select("scene_id", "doy")
    rows = t.pixels.join(scenes, "scene_id")
    return rows.select("scene_id", "pixel_id", F.array(F.col("doy").cast("float"), *(F.col(b).cast("float") for b in B.BANDS[:4])).alias("features"))


@query("add_bands", "select p.scene_id, p.pixel_id, p.nir, d.fire_year, e.fine from pixels p left join disturbance d on p.pixel_id = d.pixel_id left join elevation e on p.pixel_id = e.pixel_id")
def _(t):
    out = t.pixels.join(t.disturbance, "pixel_id", "left").join(t.elevation, "pixel_id", "left")
    return out.select("scene_id", "pixel_id", "nir", "fire_year", "fine")
