"""Queries on cells, samples, series, chips and assessment."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import bands as B
from ..functions import geo as G
from ..operators import assess as A
from ..operators import chips as C
from ..operators import sampling as SA
from ..operators import scenes as S
from ..operators import series as W
from .registry import query
from .scene_queries import _SEEN

_Y = "cell_years"


@query("top_fire", f"select id, fire, 'fire' disturbance_type from {_Y} where fire > 0 order by fire desc, id limit 100")
def _(t):
    return SA.top_property(t.cell_years, "fire", 100, "fire").select("id", "fire", "disturbance_type")


@query("top_harvest", f"select id, harvest, 'harvest' disturbance_type from {_Y} where harvest > 0 order by harvest desc, id limit 100")
def _(t):
    return SA.top_property(t.cell_years, "harvest", 100, "harvest").select("id", "harvest", "disturbance_type")


@query("random_undisturbed", f"select id, 'undisturbed' disturbance_type from {_Y} where fire = 0 and harvest = 0 order by md5('42:' || id), id limit 100")
def _(t):
    return SA.random_undisturbed(t.cell_years, 100).select("id", "disturbance_type")


@query("slice", f"select id from {_Y} order by fire desc, id limit 30 offset 20")
def _(t):
    return t.cell_years.orderBy(F.desc("fire"), "id").offset(20).limit(30).select("id")


@query("seeded_shuffle", f"select id, md5('1001:' || id) shuffle from {_Y}")
def _(t):
    return t.cell_years.select("id", SA.shuffle_key(1001, "id").alias("shuffle"))


@query("head_n", f"select id from (select id, md5('1001:' || id) s from {_Y}) order by s, id limit 20")
def _(t):
    return t.cell_years.orderBy(SA.shuffle_key(1001, "id"), "id").limit(20).select("id")


@query("take_subset", "select vec_id from embeddings order by md5('9:' || vec_id), vec_id limit 64")
def _(t):
    return t.embeddings.select("vec_id").orderBy(SA.shuffle_key(9, "vec_id"), "vec_id").limit(64)


@query("union_all", f"select id, fire v from {_Y} where fire > 0 union all select id, harvest v from {_Y} where harvest > 0")
def _(t):
    return S.union_collections(*(t.cell_years.where(F.col(c) > 0).select("id", F.col(c).alias("v")) for c in ("fire", "harvest")))


@query("distinct_values", f"select distinct ecozone, segment from {_Y}")
def _(t):
    return t.cell_years.select("ecozone", "segment").distinct()


@query("except_ids", f"select id from {_Y} except select id from {_Y} where fire > 0")
def _(t):
    return t.cell_years.select("id").subtract(t.cell_years.where("fire > 0").select("id"))


@query("repeat_epochs", "select vec_id, e::int epoch from embeddings, range(3) r(e)")
def _(t):
    return C.repeat_epochs(t.embeddings.select("vec_id"), 3)


@query("unused_cells", f"select cell_id from {_Y} where cell_id not in (select cell_id from {_Y} where fire > 0)")
def _(t):
    return SA.unused_cells(t.cell_years, t.cell_years.where("fire > 0")).select("cell_id")


@query("model2_cells", f"select id, case when n <= 70 then 'train' when n <= 85 then 'test' else 'val' end split from (select id, row_number() over (order by md5('1001:' || id), id) n from {_Y} where fire = 0) where n <= 100")
def _(t):
    return SA.model2_cells(t.cell_years, t.cell_years.where("fire > 0"), (70, 15, 15)).select("id", "split")


@query("cell_year_cross", "select c_custkey cell_id, y::int as year from customer, range(1985, 1996) r(y)")
def _(t):
    return t.customer.select(F.col("c_custkey").alias("cell_id"), F.explode(F.sequence(F.lit(1985), F.lit(1995))).alias("year"))


@query("strata_cross", f"select ecozone, segment from (select distinct ecozone from {_Y}), (select distinct segment from {_Y})")
def _(t):
    return t.cell_years.select("ecozone").distinct().crossJoin(t.cell_years.select("segment").distinct())


_SHARE = "select ecozone_id, sum((xmax - xmin) * (ymax - ymin)) area from ecozones group by 1"


@query("ecozone_area_share", f"select ecozone_id, area, area / sum(area) over () share from ({_SHARE})")
def _(t):
    return SA.area_shares(t.ecozones, G.box_area())


@query("quota_ceil", f"select ecozone_id, ceil(round(1200 * area / (select sum(area) from ({_SHARE})), 9))::bigint fire_quota, ceil(round(600 * area / (select sum(area) from ({_SHARE})), 9))::bigint undisturbed_quota from ({_SHARE})")
def _(t):
    return SA.quota(SA.area_shares(t.ecozones, G.box_area()), {"fire": 1200, "undisturbed": 600}).select("ecozone_id", "fire_quota", "undisturbed_quota")


@query("exact_split", f"""select id, case when k <= a then 'train' when k <= a + b then 'test' else 'val' end split from (select id, row_number() over (partition by ecozone order by md5('111:' || id), id) k,
    floor(round(count(*) over (partition by ecozone) * 0.7::double, 9)) a, floor(round(count(*) over (partition by ecozone) * 0.15::double, 9)) b from {_Y}) where k <= a + 2 * b""")
def _(t):
    return SA.exact_split(t.cell_years, ["ecozone"]).select("id", "split")


@query("distinct_priority", f"select id, case when fire > 0 then 'fire' when harvest > 0 then 'harvest' else 'undisturbed' end kind from {_Y}")
def _(t):
    c = t.cell_years
    sets = [c.where("fire > 0"), c.where("harvest > 0"), c]
    return SA.distinct_priority([s.select("id").withColumn("kind", F.lit(k)) for s, k in zip(sets, ("fire", "harvest", "undisturbed"))])


_SAMPLE = f"""with s as (
      select *, 'fire' kind, 0 prio from (select *, row_number() over (partition by ecozone order by fire desc, id) n from {_Y} where fire > 0) where n <= 40
      union all select *, 'harvest', 1 from (select *, row_number() over (partition by ecozone order by harvest desc, id) n from {_Y} where harvest > 0) where n <= 40
      union all select *, 'undisturbed', 2 from (select *, row_number() over (partition by ecozone order by md5('42:' || id), id) n from {_Y} where fire = 0 and harvest = 0) where n <= 20),
    d as (select * from (select *, row_number() over (partition by id order by prio) one from s) where one = 1 and id in (select c.id from {_SEEN})),
    r as (select *, row_number() over (partition by ecozone, kind order by case kind when 'fire' then lpad((1000000000 - fire)::varchar, 12, '0') when 'harvest' then lpad((1000000000 - harvest)::varchar, 12, '0') else md5('42:' || id) end, id) k from d),
    h as (select * from r where k <= case kind when 'undisturbed' then 10 else 20 end),
    f as (select *, count(*) over (partition by ecozone, kind) m, row_number() over (partition by ecozone, kind order by md5('111:' || id), id) p from h)
    select id, kind disturbance_type, case when p <= floor(round(m * 0.7::double, 9)) then 'train' when p <= floor(round(m * 0.7::double, 9)) + floor(round(m * 0.15::double, 9)) then 'test' else 'val' end split, md5('1001:' || id) shuffle
    from f where p <= floor(round(m * 0.7::double, 9)) + 2 * floor(round(m * 0.15::double, 9))"""


@query("sample_cells", _SAMPLE)
def _(t):
    return SA.sample_cells(t.cell_years, t.scenes, {"fire": 20, "harvest": 20, "undisturbed": 10}).select("id", "disturbance_type", "split", "shuffle")


@query("land_sample_count", """select cell, land from (select cell, count(land) land from (select *, row_number() over (partition by cell order by md5('1:' || pixel_id), pixel_id) k from
    (select pixel_id, floor(pixel_id / 64)::bigint cell, nullif(max(case when lc > 0 and lc <> 20 then 1 else 0 end), 0) land from landcover group by pixel_id)) where k <= 50 group by 1) where land >= 20""")
def _(t):
    from ..operators.layers import ever_land

    land = ever_land(t.landcover).select("pixel_id", F.floor(F.col("pixel_id") / 64).alias("cell"), F.nullif("land", F.lit(0)).alias("land"))
    return SA.sampled_counts(land, ["land"], "cell", 50).where("land >= 20")


def _counts(t):
    cells = t.disturbance.withColumn("cell", F.floor(F.col("pixel_id") / 64))
    counted = SA.sampled_events(cells, {"fire": "fire_year", "harvest": "harvest_year"}, "cell", t.years, 50)
    return counted.withColumn("cell", F.concat_ws("_", "cell", "year"))


_COUNTS = """select cell, count(fire) fire, count(harvest) harvest from (select *, row_number() over (partition by cell order by md5('1:' || pixel_id), pixel_id) k from
    (select pixel_id, concat(floor(pixel_id / 64)::bigint, '_', year) cell, case when fire_year = year then 1 end fire, case when harvest_year = year then 1 end harvest from disturbance, years)) where k <= 50 group by 1"""


@query("disturbance_counts", _COUNTS)
def _(t):
    return _counts(t).select("cell", "fire", "harvest")


@query("annual_grids", f"select split_part(cell, '_', 1)::bigint cell_id, split_part(cell, '_', 2)::int as year, cell id, fire, harvest from ({_COUNTS})")
def _(t):
    return _counts(t).select(F.split_part("cell", F.lit("_"), F.lit(1)).cast("long").alias("cell_id"), F.split_part("cell", F.lit("_"), F.lit(2)).cast("int").alias("year"), F.col("cell").alias("id"), "fire", "harvest")


@query("collection_size", f"select ecozone, count(*) n, count(distinct year) n_years from {_Y} group by 1")
def _(t):
    return t.cell_years.groupBy("ecozone").agg(F.count("*").alias("n"), F.countDistinct("year").alias("n_years"))


@query("batch_ids", "select user_id, event_id, floor((row_number() over (partition by user_id order by event_id) - 1) / 32)::int batch from events")
def _(t):
    return C.batch_ids(t.events.select("user_id", "event_id"), ["event_id"], by=["user_id"])


@query("shard_split", "select vec_id, case when ('0x' || substr(md5('5s:' || vec_id), 1, 8))::bigint % 10 = 0 then 'test' else 'train' end split from embeddings")
def _(t):
    return t.embeddings.select("vec_id", F.when(C.draw("vec_id", 5, "s", 10) == 0, "test").otherwise("train").alias("split"))


_FOLD = """with recursive b(pixel_id, t, p) as (
      select pixel_id, t, p from class_probs where t = 0
      union all
      select c.pixel_id, c.t, list_transform(list_zip(b.p, c.p), lambda z: 0.8 * z[1] * z[2] / list_sum(list_transform(list_zip(b.p, c.p), lambda q: q[1] * q[2])) + 0.2 / len(c.p)) from b join class_probs c on b.pixel_id = c.pixel_id and c.t = b.t + 1) """
_FOLD_ROWS = "list_transform(p, lambda x: round(x, 6)) p"


@query("bulcp", _FOLD + f"select pixel_id, t, {_FOLD_ROWS} from b")
def _(t):
    out = W.bulcp(t.class_probs)
    return out.select("pixel_id", "t", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


@query("bulcp_arrow", _FOLD + f"select pixel_id, t, {_FOLD_ROWS} from b")
def _(t):
    return W.bulcp_arrow(t.class_probs).select("pixel_id", "t", F.transform("p", lambda x: F.round(x, 6)).alias("p"))


def _events(current, previous):
    return f"""select distinct pixel_id, y as year from (select pixel_id, case when b = 2 and cls = {current} and n1 = {previous} and n2 in (1, 2) then year when b = 2 and cls = {previous} and year - ly > 1 then year - 1 end y from r) q where y is not null"""


_FUSED = """, fu as (select pixel_id, t, (1985 + floor(t / 3))::int as year, p, (list_position(p, list_max(p)) - 1)::int cls from b),
      su as (select *, count(*) filter (cls in (4, 5, 6, 7)) over (partition by pixel_id) h, count(*) over (partition by pixel_id) n from fu
        where cls not in (8, 9) and greatest(p[1], p[2], p[3], p[4], p[5] + p[6], p[7] + p[8], p[9], p[10]) >= 0.3),
      a as (select *, lag(cls) over w b, lag(year) over w ly from su where h <> n and h <> 1 window w as (partition by pixel_id order by t)),
      r as (select *, lead(cls) over v n1, lead(cls, 2) over v n2 from a where b is null or b <> cls window v as (partition by pixel_id order by t)),
      ev as (select pixel_id, year, max(f) fire, max(h) harvest from (select pixel_id, year, 1 f, 0 h from (""" + _events(5, 4) + ") x union all select pixel_id, year, 0, 1 from (" + _events(7, 6) + """) x) q group by 1, 2),
      la as (select pixel_id, year, cls from (select *, row_number() over (partition by pixel_id, year order by t desc) k from fu) q where k = 1) """


@query("annual_maps", _FOLD + _FUSED + "select coalesce(la.pixel_id, ev.pixel_id) pixel_id, coalesce(la.year, ev.year) as year, cls, coalesce(fire, 0) fire, coalesce(harvest, 0) harvest from la full join ev on la.pixel_id = ev.pixel_id and la.year = ev.year")
def _(t):
    return W.annual_maps(t.class_probs.withColumn("year", (1985 + F.floor(F.col("t") / 3)).cast("int")))


@query("last_per_year", "select pixel_id, year, cls from (select *, row_number() over (partition by pixel_id, year order by acquired desc) k from class_series) where k = 1")
def _(t):
    return W.last_per_year(t.class_series).select("pixel_id", "year", "cls")


@query("annual_drop_occluded", "select pixel_id, acquired, cls from class_series where cls not in (8, 9)")
def _(t):
    return W.drop_occluded(t.class_series).select("pixel_id", "acquired", "cls")


@query("annual_confidence", "select pixel_id, t from class_probs where greatest(p[1], p[2], p[3], p[4], p[5] + p[6], p[7] + p[8], p[9], p[10]) >= 0.3")
def _(t):
    return W.drop_unsure(t.class_probs, 0.3).select("pixel_id", "t")


@query("annual_false_positive", "select pixel_id, acquired, cls from (select *, count(*) filter (cls in (4,5,6,7)) over (partition by pixel_id) h, count(*) over (partition by pixel_id) n from class_series) where h <> n and h <> 1")
def _(t):
    return W.drop_false_positives(t.class_series).select("pixel_id", "acquired", "cls")


def _pattern(name, current, previous):
    # Classes fold onto the four that the rule reads, so that patterns occur.
    fold = f"case when cls < 4 then 2 when cls < 6 then {current} when cls < 8 then {previous} else 1 end"
    sql = f"""with s as (select pixel_id, acquired, year, {fold} cls from class_series),
      a as (select *, lag(cls) over w b, lag(year) over w ly from s window w as (partition by pixel_id order by acquired)),
      r as (select *, lead(cls) over v n1, lead(cls, 2) over v n2 from a where b is null or b <> cls window v as (partition by pixel_id order by acquired))
      select distinct pixel_id, event_year from (select pixel_id, case when b = 2 and cls = {current} and n1 = {previous} and n2 in (1, 2) then year when b = 2 and cls = {previous} and year - ly > 1 then year - 1 end event_year from r) where event_year is not null"""

    @query(name, sql)
    def _(t):
        c = F.col("cls")
        folded = F.when(c < 4, 2).when(c < 6, current).when(c < 8, previous).otherwise(1)
        return W.event_years(t.class_series.withColumn("cls", folded), current, previous)


_pattern("annual_burn_pattern", B.FIRE, B.PREVIOUS_FIRE)
_pattern("annual_harvest_pattern", B.HARVEST, B.PREVIOUS_HARVEST)


_PRED = "select label as true, (list_position(embedding[1:10], list_max(embedding[1:10])) - 1)::int pred from embeddings"


@query("confusion_matrix", "select r.i::int pred, " + ", ".join(f"coalesce(t{i}, 0)::bigint t{i}" for i in range(10)) + f" from range(10) r(i) left join (select pred, " + ", ".join(f'count(*) filter ("true" = {i}) t{i}' for i in range(10)) + f" from ({_PRED.replace('as true', 'as \"true\"')}) group by 1) k on r.i = k.pred")
def _(t):
    rows = t.embeddings.select(F.col("label").alias("true"), B.argmax(F.slice("embedding", 1, 10)).alias("pred"))
    return A.confusion_matrix(rows)


@query("band_stats", "select round(avg(nir), 6) nir_mean, round(var_pop(nir), 6) nir_var, round(avg(red), 6) red_mean, round(var_pop(red), 6) red_var from pixels")
def _(t):
    out = A.band_stats(t.pixels, ["nir", "red"])
    return out.select(*(F.round(c, 6).alias(c) for c in out.columns))


@query("normalize", "select scene_id, pixel_id, round((nir - (select avg(nir) from pixels)) / sqrt((select var_pop(nir) from pixels)), 5) nir from pixels")
def _(t):
    return A.normalize(t.pixels.select("scene_id", "pixel_id", "nir"), ["nir"]).withColumn("nir", F.round("nir", 5))


@query("stretch_bounds", "select scene_id, round(avg(nir) - 0.5 * stddev_pop(nir), 9) vmin, round(avg(nir) + 0.5 * stddev_pop(nir), 9) vmax from pixels group by 1")
def _(t):
    return A.stretch_bounds(t.pixels, "scene_id", "nir").select("scene_id", F.round("vmin", 9).alias("vmin"), F.round("vmax", 9).alias("vmax"))


@query("stack_predictions", "select pixel_id, list(round(p[1], 6) order by t) stack from class_probs group by 1")
def _(t):
    return A.stack_predictions(t.class_probs).select("pixel_id", F.transform("stack", lambda r: F.round(r["p"][0], 6)).alias("stack"))


_YEARS = list(range(1995, 2002))


@query("to_bands", "select pixel_id, " + ", ".join(f"max(case when year = {y} then v end) b{y}" for y in _YEARS) + " from observations group by 1")
def _(t):
    return A.to_bands(t.observations, "pixel_id", "year", "v", _YEARS)


@query("split_bands", f"select pixel_id, year, max(v) v from observations where year between {_YEARS[0]} and {_YEARS[-1]} group by 1, 2")
def _(t):
    return A.split_bands(A.to_bands(t.observations, "pixel_id", "year", "v", _YEARS), "pixel_id", _YEARS, "year", "v")


_PART = "select p_partkey, floor(p_partkey / 64)::int r, (p_partkey % 64)::int c, p_retailprice v, p_size % 10 label from part"
_PLACES = f"""(select format('chip{{:05d}}_{{:05d}}', k.cr, k.cc) chip_id, r.i::int as row, c.i::int as col, coalesce(v, 0)::double v, coalesce(label, 0)::int as label
    from (select distinct (r // 8) cr, (c // 8) cc from ({_PART})) k cross join range(8) r(i) cross join range(8) c(i) left join ({_PART}) p on p.r = k.cr * 8 + r.i and p.c = k.cc * 8 + c.i)"""


def places(t):
    part = t.part.select(F.floor(F.col("p_partkey") / 64).cast("int").alias("row"), (F.col("p_partkey") % 64).cast("int").alias("col"), F.col("p_retailprice").alias("v"), (F.col("p_size") % 10).alias("label"))
    return C.chip_window(part, 8, ["v", "label"])


@query("chip_window", f"select chip_id, row, col, v, label from {_PLACES}")
def _(t):
    return places(t)


@query("chips_from_pixels", f"select chip_id, list(v order by row, col) v, list(label order by row, col) as label from {_PLACES} group by 1")
def _(t):
    return C.chips_from_pixels(places(t), ["v", "label"])


@query("chips_to_pixels", f"select chip_id, row, col, v, label from {_PLACES}")
def _(t):
    return C.chips_to_pixels(C.chips_from_pixels(places(t), ["v", "label"]), 8, ["v", "label"])


@query("grid_crop", f"select chip_id, ((row // 4) * 2 + (col // 4))::int block, row % 4 as row, col % 4 as col, v from {_PLACES}")
def _(t):
    return C.grid_crop(places(t), 8, 4).select("chip_id", "block", "row", "col", "v")


_DRAW = "(('0x' || substr(md5('3{s}:' || chip_id), 1, 8))::bigint % {n})::int"


@query("random_crop", f"select chip_id, row - a as row, col - b as col, v from (select *, {_DRAW.format(s='r', n=5)} a, {_DRAW.format(s='c', n=5)} b from {_PLACES}) where row - a between 0 and 3 and col - b between 0 and 3")
def _(t):
    return C.random_crop(places(t), 8, 4, 3).select("chip_id", "row", "col", "v")


@query("zip_xy", f"select chip_id, row - a as row, col - b as col, v, label from (select *, {_DRAW.format(s='r', n=5)} a, {_DRAW.format(s='c', n=5)} b from {_PLACES}) where row - a between 0 and 3 and col - b between 0 and 3")
def _(t):
    return C.random_crop(places(t), 8, 4, 3)


@query("augment_flip", f"select chip_id, case when {_DRAW.format(s='v', n=2)} = 1 then 7 - row else row end as row, case when {_DRAW.format(s='h', n=2)} = 1 then 7 - col else col end as col, v from {_PLACES}")
def _(t):
    return C.augment_flip(places(t), 8, 3).select("chip_id", "row", "col", "v")


_TURN = "((('0x' || substr(md5('3a:' || {k}), 1, 8))::bigint % 20001)::int / 10000.0 - 1) * 0.4 * pi()"


def _turned(k, rows, size):
    """SQL that turns each group ``k`` of places about its centre: nearest source place, mirrored at the edges."""
    mid = (size - 1) / 2
    back = lambda c: f"(case when ({c}) % {2 * size} >= {size} then {2 * size - 1} - ({c}) % {2 * size} else ({c}) % {2 * size} end)"
    line = lambda a, b, c, d: f"(round({a}({_TURN.format(k=k)}) * ({b} - {mid}) {c} {d} + {mid})::int + {2 * size * size})"
    r = line("cos", "row", "+", f"sin({_TURN.format(k=k)}) * (col - {mid})")
    c = line("cos", "col", "-", f"sin({_TURN.format(k=k)}) * (row - {mid})")
    return f"(select *, {back(r)} sr, {back(c)} sc from {rows})"


@query("augment_rotate", f"select t.chip_id, t.row, t.col, s.v, s.label from {_turned('chip_id', _PLACES, 8)} t join {_PLACES} s on t.chip_id = s.chip_id and t.sr = s.row and t.sc = s.col")
def _(t):
    return C.augment_rotate(places(t), 8, 3, ["v", "label"])


_TRAIN = f"""with pl as (select * from {_PLACES}),
    st as (select avg(v) m, var_pop(v) s from pl where ('0x' || substr(md5('3n:' || chip_id), 1, 8))::bigint % 2 = 0),
    ep as (select chip_id, row, col, case when s > 0 then (v - m) / sqrt(s) end v, label, e::int epoch, chip_id || '@' || e k from pl, st, range(2) r(e)),
    cr as (select * replace (row - ('0x' || substr(md5('3r:' || k), 1, 8))::bigint % 5 as row, col - ('0x' || substr(md5('3c:' || k), 1, 8))::bigint % 5 as col) from ep),
    wi as (select * from cr where row between 0 and 3 and col between 0 and 3),
    tu as (select t.k, t.chip_id, t.epoch, t.row, t.col, s.v, s.label from {_turned('k', 'wi', 4)} t join wi s on t.k = s.k and t.sr = s.row and t.sc = s.col),
    od as (select k, floor((row_number() over (partition by epoch order by md5('3:' || k), k) - 1) / 32)::int batch from (select distinct k, epoch from tu) q)
    select chip_id, epoch, case when ('0x' || substr(md5('3v:' || tu.k), 1, 8))::bigint % 2 = 1 then 3 - row else row end::int as row, case when ('0x' || substr(md5('3h:' || tu.k), 1, 8))::bigint % 2 = 1 then 3 - col else col end::int as col, round(v, 6) v, label, batch
    from tu join od on tu.k = od.k"""


@query("train_dataset", _TRAIN)
def _(t):
    out = C.train_dataset(places(t), 8, 4, 2, 3, ["v"], turn=0.2, stats_share=2)
    return out.select("chip_id", "epoch", "row", "col", F.round("v", 6).alias("v"), "label", "batch")


@query("test_dataset", f"select chip_id, ((row // 4) * 2 + (col // 4))::int block, row % 4 as row, col % 4 as col, v, label from {_PLACES}")
def _(t):
    return C.test_dataset(places(t), 8, 4)
