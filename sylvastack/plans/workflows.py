"""End-to-end workflows: files in and out, training export, scoring, map building, and the online update."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import bands as B
from ..functions import geo as G
from ..operators import assess as A
from ..operators import chips as C
from ..operators import sampling as SA
from ..operators import scenes as S
from ..operators import scoring as SC
from ..operators import series as W
from ..sources import files
from ..sources.workspace import fresh_folder
from ..streaming.bulcp_stream import bulcp_stream, rocksdb
from .registry import query
from .sample_queries import _FOLD, _FOLD_ROWS, _PLACES, _SAMPLE, places
from .scene_queries import _LABELLED, _PREPARED, _SEEN, POINT, prepared_and_labelled, training_points

def _records(t):
    kinds = F.concat(F.lit("type"), F.col("chip_id").substr(-1, 1))
    return C.chips_from_pixels(places(t), ["v", "label"]).withColumns({"ecozone": F.abs(F.crc32("chip_id") % 5).cast("int"), "disturbance_type": kinds})


@query("chip_export", f"select chip_id, count(*) n from {_PLACES} group by 1")
def _(t):
    chips = _records(t)
    path = fresh_folder(t.spark, "chips")
    files.write_chips(chips, path)
    return t.spark.read.parquet(path).select("chip_id", F.size("v").cast("long").alias("n"))


@query("chip_read", f"select chip_id, list(v order by row, col) v from {_PLACES} group by 1")
def _(t):
    chips = _records(t)
    path = fresh_folder(t.spark, "chips")
    files.write_chips(chips, path)
    return files.read_chips(t.spark, f"{path}/ecozone=*/disturbance_type=*", chips.schema, path).select("chip_id", "v")


def _in_files(t, files_of=20):
    """Vectors written to one folder for each hash of their id, so that file names are in a known order."""
    path = fresh_folder(t.spark, "shards")
    rows = t.embeddings.select("vec_id", "label", F.format_string("%04d", C.draw("vec_id", 5, "s", files_of)).alias("part"))
    rows.repartition("part").write.partitionBy("part").parquet(path)
    return path, T.StructType([*rows.schema.fields[:2], T.StructField("part", T.StringType())])


@query("shard_read", "select vec_id, label, case when k % 10 = 0 then 'test' else 'train' end split from (select vec_id, label, ('0x' || substr(md5('5s:' || vec_id), 1, 8))::bigint % 20 k from embeddings)")
def _(t):
    """Shards of whole files: every tenth file is for tests, the others for training."""
    path, schema = _in_files(t)
    test, train = (files.read_shards(t.spark, path, 10, own, schema).withColumn("split", F.lit(name)) for name, own in (("test", (0,)), ("train", tuple(range(1, 10)))))
    return test.unionByName(train).select("vec_id", "label", "split")


@query("table_export", "select id, year, fire from cell_years")
def _(t):
    path = fresh_folder(t.spark, "table")
    files.export_table(t.cell_years.select("id", "year", "fire"), path, "year")
    return t.spark.read.parquet(path)


_TILES = f"""select format('cell{{:05d}}_image{{:05d}}', split_part(chip_id, '_', 2)::int, substr(chip_id, 5, 5)::int) as name, 60.0::double scale_x, 0.0::double translate_x, -60.0::double scale_y, 480.0::double translate_y, 'EPSG:3978' crs, 1 bands, 8 height, 8 width, 'int' dtype, list(label order by row, col) as data from {_PLACES} group by chip_id"""


@query("map_tiles_write", _TILES)
def _(t):
    rows = places(t).select(F.split("chip_id", "_")[1].cast("int").alias("cell_id"), F.substring("chip_id", 5, 5).cast("int").alias("image"), "row", "col", F.col("label").alias("cls"), F.lit(0.0).alias("xmin"), F.lit(480.0).alias("ymax"))
    path = fresh_folder(t.spark, "tiles")
    files.map_tiles(rows).write.parquet(path)
    return t.spark.read.parquet(path).select("name", "transform.scale_x", "transform.translate_x", "transform.scale_y", "transform.translate_y", "crs", "bands", "height", "width", "dtype", "data")


_BANDS13 = [*B.BANDS, *B.HISTORICAL]


def _whole_pixels(t):
    """Scene pixels of the first sensor that have all 13 bands, with their label; written once, as a forest is fitted on some and scores all of them."""
    path = fresh_folder(t.spark, "whole")
    prepared_and_labelled(t, POINT).dropna(subset=_BANDS13).write.parquet(path)
    return t.spark.read.parquet(path)


def _model(t, pixels):
    """A forest on the points sampled in cells, with all 13 bands; a point weighs as many times as cells have it."""
    path = fresh_folder(t.spark, "points")  # a forest reads its points several times
    training_points(t, pixels).write.parquet(path)
    return SC.train_pixels(t.spark.read.parquet(path), _BANDS13, times="cells")


@query("train_pixels")
def _(t):
    """The class of every pixel that has all 13 bands, by a forest on the sampled points."""
    pixels = _whole_pixels(t)
    out = SC.score_pixels(pixels, _model(t, pixels), ["scene_id", "pixel_id"], _BANDS13)
    return out.select("scene_id", "pixel_id", B.argmax(F.col("p")).alias("cls"))


@query("score_chips", f"select chip_id, avg(v) m from {_PLACES} group by 1")
def _(t):
    chips = C.chips_from_pixels(places(t), ["v"])
    scored = SC.score_chips(chips, lambda batch: batch["v"].map(lambda v: [float(v.mean())]), "chip_id string")
    return scored.select("chip_id", F.col("out")[0].alias("m"))


@query("score_chips_model")
def _(t):
    """A model trained on the chips' own pixels, written to a file and applied to whole chips: how often each chip has its likeliest class, and how sure it is."""
    pixels, path = places(t), f"{fresh_folder(t.spark, 'model')}/weights"
    SC.train_chip_model(pixels.where("label is not null"), ["v"], path)
    scored = SC.score_chips_with(C.chips_from_pixels(pixels, ["v"]), path, SC.chip_classes(["v"]), ("chip_id",), "cls array<int>, confidence array<double>")
    times = F.transform(F.array_distinct("classes"), lambda c: F.struct((-F.size(F.filter("classes", lambda x: x == c))).alias("n"), c.alias("c")))
    first = scored.withColumnRenamed("cls", "classes").withColumn("first", F.array_min(times))
    return first.select("chip_id", "first.c", (-F.col("first.n")).alias("n"), F.round(F.aggregate("confidence", F.lit(0.0), lambda s, x: s + x) / F.size("confidence"), 6).alias("confidence")).withColumnRenamed("c", "cls")


_CHIPPED = f"""x as (select id, kind disturbance_type{_SAMPLE.split("select id, kind disturbance_type", 1)[1]}),
    ic as (select x.id, x.disturbance_type, x.split, c.ecozone, s.scene_id, s.doy, (s.xmin + s.xmax) / 2 cx, (s.ymin + s.ymax) / 2 cy, c.xmin, c.ymin, c.xmax, c.ymax from {_SEEN} join x on x.id = c.id),
    pv as (select ic.*, floor((ic.ymax - pp.y) / 60)::int r, floor((pp.x - ic.xmin) / 60)::int q, pp.nir, pp.historical_tca, k.label from ic join pp on pp.scene_id = ic.scene_id join k on k.scene_id = pp.scene_id and k.pixel_id = pp.pixel_id
      where pp.x >= ic.xmin and pp.x < ic.xmax and pp.y > ic.ymin and pp.y <= ic.ymax)"""


def _patches(t, size=16):
    """A record for each patch of a sampled cell in each scene that covers it: 13 bands and the label as arrays, and the scene's metadata."""
    cells = SA.sample_cells(t.cell_years, t.scenes, {"fire": 20, "harvest": 20, "undisturbed": 10})
    seen = S.cell_scenes(cells, t.scenes, of_cell=tuple(F.col(c).alias(c) for c in ("ecozone", "disturbance_type", "split", *G.BOX)))
    meta = t.scenes.select("scene_id", (F.col("doy") - 172).cast("float").alias("doy"), ((F.col("xmin") + F.col("xmax")) / 2).alias("cx"), ((F.col("ymin") + F.col("ymax")) / 2).alias("cy"))
    bands = [*B.BANDS, *B.HISTORICAL]
    pixels = prepared_and_labelled(t, ("scene_id", "pixel_id", "x", "y", "label"))
    inside = (F.col("x") >= F.col("xmin")) & (F.col("x") < F.col("xmax")) & (F.col("y") > F.col("ymin")) & (F.col("y") <= F.col("ymax"))
    own = pixels.join(seen, "scene_id").where(inside)
    own = own.select("id", "scene_id", F.floor((F.col("ymax") - F.col("y")) / B.PIXEL).cast("int").alias("row"), F.floor((F.col("x") - F.col("xmin")) / B.PIXEL).cast("int").alias("col"), *bands, "label")
    own = own.groupBy("id", "scene_id", "row", "col").agg(*(F.max(c).alias(c) for c in [*bands, "label"]))  # one pixel a place
    chips = C.chips_from_pixels(C.chip_window(own, size, [*bands, "label"], ("id", "scene_id")), [*bands, "label"], ("id", "scene_id", "chip_id"))
    return chips.join(seen.select("id", "scene_id", "ecozone", "disturbance_type", "split"), ["id", "scene_id"]).join(meta, "scene_id")


@query("export_training_patches", f"""{_LABELLED}, {_PREPARED}, {_SAMPLE[5:].rsplit("select id, kind disturbance_type", 1)[0]}, {_CHIPPED},
    one as (select id, scene_id, r, q, max(nir) nir, max(historical_tca) historical_tca, max(label) as label from pv group by all)
    select one.id, one.scene_id, disturbance_type, split, ecozone, (doy - 172)::float doy, cx, cy, format('chip{{:05d}}_{{:05d}}', one.r // 16, one.q // 16) chip_id, 256 n, round(sum(coalesce(nir, 0)), 3) nir, round(sum(coalesce(historical_tca, 0)), 3) historical_tca, sum(coalesce(label, 0))::bigint as label
    from one join ic on one.id = ic.id and one.scene_id = ic.scene_id group by all""")
def _(t):
    """The records are written by stratum and read again; each band and the label is shown by its size and its sum."""
    path = fresh_folder(t.spark, "patches")
    files.write_chips(_patches(t), path)
    back = t.spark.read.parquet(path)
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double")), 3).alias(c)
    return back.select("id", "scene_id", "disturbance_type", "split", "ecozone", "doy", "cx", "cy", "chip_id", F.size("dem").alias("n"), total("nir"), total("historical_tca"), F.aggregate("label", F.lit(0).cast("long"), lambda s, x: s + x).alias("label"))


@query("build_maps")
def _(t):
    """Score every scene pixel, stack by time, fuse, reduce to years by the rules, and write the maps and their tiles."""
    pixels = _whole_pixels(t)
    scored = SC.score_pixels(pixels, _model(t, pixels), ["scene_id", "pixel_id"], _BANDS13)
    dated = scored.join(t.scenes.select("scene_id", "acquired", "year"), "scene_id")
    stacks = A.stack_predictions(dated.withColumn("o", F.struct("acquired", "scene_id", "year")), order="o")
    rows = stacks.select("pixel_id", F.posexplode("stack").alias("t", "s")).select("pixel_id", "t", F.col("s.t.year").alias("year"), F.col("s.p").alias("p"))
    maps, tiles, series = (fresh_folder(t.spark, n) for n in ("maps", "tiles", "series"))
    rows.write.parquet(series)  # the maps read it several times
    W.annual_maps(t.spark.read.parquet(series)).write.partitionBy("year").parquet(maps)
    annual = t.spark.read.parquet(maps)
    at = annual.select(F.floor(F.col("pixel_id") / 4096).cast("int").alias("cell_id"), F.col("year").alias("image"), F.floor(F.col("pixel_id") % 4096 / 64).cast("int").alias("row"), (F.col("pixel_id") % 64).cast("int").alias("col"), "cls", F.lit(0.0).alias("xmin"), F.lit(3840.0).alias("ymax"))
    files.map_tiles(at).write.parquet(tiles)
    return annual


def in_ranges(df, steps_each=10):
    """The posteriors when ``df`` arrives as a stream in ranges of t, a micro-batch each, written in that order."""
    return replayed(df, bulcp_stream, steps_each)


def replayed(df, program, steps_each=10):
    """The output of a streaming program when ``df`` arrives in ranges of t: a micro-batch each, and a restart from the checkpoint before each."""
    spark = df.sparkSession
    steps, source, out, marks = (fresh_folder(spark, n) for n in ("stream-steps", "stream-in", "stream-out", "stream-marks"))
    ranged = df.withColumn("_range", F.floor(F.col("t") / steps_each))
    ranged.repartition("_range", "pixel_id").write.partitionBy("_range").parquet(steps)
    ranged = spark.read.schema(T.StructType([*df.schema, T.StructField("_range", T.LongType())])).parquet(steps)
    df.limit(0).write.parquet(source)  # a stream's folder must exist
    stream = program(spark.readStream.schema(df.schema).parquet(source))
    with rocksdb(spark):
        for (part,) in ranged.select("_range").where("_range is not null").distinct().orderBy("_range").toLocalIterator():
            ranged.where(F.col("_range") == part).drop("_range").write.mode("append").parquet(source)
            stream.writeStream.format("parquet").option("checkpointLocation", marks).trigger(availableNow=True).start(out).awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


@query("bulcp_stream", _FOLD + f"select pixel_id, t, {_FOLD_ROWS} from b")
def _(t):
    return in_ranges(t.class_probs.select("pixel_id", "t", "p")).select("pixel_id", "t", F.transform("p", lambda x: F.round(x, 6)).alias("p"))
