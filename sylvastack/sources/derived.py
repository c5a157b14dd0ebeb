"""Domain tables derived from the star-schema tables, as one SELECT each that Spark and DuckDB both run."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession

from .second_sensor import nbr_met, tm_pixels

BASE = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "embeddings"]

_LC = "case cast({k} % 13 as int) when 0 then 0 when 1 then 20 when 2 then 31 when 3 then 32 when 4 then 33 when 5 then 40 when 6 then 50 when 7 then 80 when 8 then 81 when 9 then 100 when 10 then 210 when 11 then 220 else 230 end"
_FIRE = "case when p_size % 5 = 0 then cast(1995 + p_size % 7 as int) end"
_HARVEST = "case when p_size % 4 = 0 then cast(1995 + p_partkey % 7 as int) end"
_SUBS = "(select 0 as k union all select 1 as k union all select 2 as k union all select 3 as k) as subs"

#: Name: SQL over base tables and earlier names.
TABLES = {
    "scenes": """select o_orderkey as scene_id, cast(o_orderdate as date) as acquired, cast(year(o_orderdate) as int) as year, cast(dayofyear(o_orderdate) as int) as doy,
        cast(o_orderkey % 101 as int) as cloud_cover, case when o_orderkey % 3 = 0 then 'TM' else 'MSS' end as sensor,
        cast(((o_custkey*37)%96)*1000 as double) as xmin, cast(((o_orderkey*53)%96)*1000 as double) as ymin,
        cast(((o_custkey*37)%96)*1000+24000 as double) as xmax, cast(((o_orderkey*53)%96)*1000+24000 as double) as ymax from orders""",
    "years": "select distinct cast(year(o_orderdate) as int) as year from orders",
    "pixels": """select l_orderkey as scene_id, l_partkey as pixel_id, cast(floor(l_partkey/64) as int) as row, cast(l_partkey % 64 as int) as col,
        max(l_extendedprice)/100000 as nir, max(l_quantity)/50 as red_edge, max(l_discount) as red, max(l_tax) as green,
        cast(max(l_quantity) as int) as qa, cast(min(l_quantity) as int) % 3 as occlusion from lineitem group by l_orderkey, l_partkey""",
    # The second sensor sees what it saw itself, the pixels of scenes that it meets within a day, and those of its customer's other scenes.
    "tm_pixels": """select scene_id, pixel_id, cast(floor(max(price)) as int) as sr_b4, cast(floor(max(quantity)*1000) as int) as sr_b7, cast(floor(max(price)/2) as int) as st_b6, max(qa) as qa
        from (select l_orderkey as scene_id, l_partkey as pixel_id, l_extendedprice as price, l_quantity as quantity, cast(l_quantity as int)*3 as qa from lineitem
          union all select tm.scene_id, l_partkey as pixel_id, l_extendedprice*(5 + tm.scene_id % 7)/10 as price, l_quantity as quantity, case when cast(l_quantity as int) % 5 = 0 then 16 else 64 end as qa
            from lineitem join scenes mss on l_orderkey = mss.scene_id join (select scene_id, acquired as day, xmin, ymin, xmax, ymax from scenes where sensor = 'TM'
              union all select scene_id, acquired + 1 as day, xmin, ymin, xmax, ymax from scenes where sensor = 'TM') as tm on mss.acquired = tm.day
            where mss.sensor = 'MSS' and (mss.scene_id + tm.scene_id) % 2 = 0 and mss.xmin < tm.xmax and tm.xmin < mss.xmax and mss.ymin < tm.ymax and tm.ymin < mss.ymax
          union all select t.o_orderkey as scene_id, l_partkey as pixel_id, l_extendedprice*(4 + t.o_orderkey % 9)/10 as price, l_quantity as quantity, case when cast(l_quantity as int) % 5 = 0 then 16 else 64 end as qa
            from lineitem join orders m on l_orderkey = m.o_orderkey join orders t on m.o_custkey = t.o_custkey where m.o_orderkey % 3 <> 0 and t.o_orderkey % 6 = 0) as seen group by scene_id, pixel_id""",
    # Land cover begins two years after the first scenes. Finer pixels lie four in a pixel, whose id they carry.
    "disturbance": f"""select p_partkey as pixel_id, cast((p_partkey%64)*60 as double) as x, cast(floor(p_partkey/64)*60 as double) as y,
        {_FIRE} as fire_year, {_HARVEST} as harvest_year, {_LC.format(k="p_partkey")} as lc from part""",
    "disturbance30": f"""select p_partkey as pixel_id, cast((p_partkey%64)*30 as double) as x, cast(floor(p_partkey/64)*30 as double) as y,
        {_FIRE} as fire_year, {_HARVEST} as harvest_year, {_LC.format(k="p_size")} as lc from part""",
    "landcover": f"""select p_partkey as pixel_id, cast((p_partkey%64)*60 as double) as x, cast(floor(p_partkey/64)*60 as double) as y, year, cast(m as int) as acquired,
        {_LC.format(k="(p_partkey + year*3 + m)")} as lc from part, years, (select 1 as m union all select 2 as m) as months where year >= 1997""",
    # The same for every year, with those before the base maps begin.
    "landcover_archive": f"""select p_partkey as pixel_id, cast((p_partkey%64)*60 as double) as x, cast(floor(p_partkey/64)*60 as double) as y, year, cast(m as int) as acquired,
        {_LC.format(k="(p_partkey + year*3 + m)")} as lc from part, years, (select 1 as m union all select 2 as m) as months""",
    "fine_landcover": f"""select p_partkey as pixel_id, cast((p_partkey%64)*60 + (k%2)*30 as double) as x, cast(floor(p_partkey/64)*60 + floor(k/2)*30 as double) as y, year, cast(m as int) as acquired,
        {_LC.format(k="(p_partkey + year*3 + m + k*5)")} as lc from part, years, (select 1 as m union all select 2 as m) as months, {_SUBS} where year >= 1997""",
    "fine_disturbance": f"""select p_partkey as pixel_id, cast((p_partkey%64)*60 + (k%2)*30 as double) as x, cast(floor(p_partkey/64)*60 + floor(k/2)*30 as double) as y,
        case when (p_size + k*3) % 5 = 0 then cast(1995 + (p_size + k) % 7 as int) end as fire_year, case when (p_size + k) % 4 = 0 then cast(1995 + (p_partkey + k) % 7 as int) end as harvest_year from part, {_SUBS}""",
    "elevation": "select p_partkey as pixel_id, case when p_size % 4 <> 0 then p_retailprice end as fine, case when p_size % 9 <> 0 then p_retailprice + p_size end as coarse from part",
    "ecozones": """select n_regionkey as ecozone_id, n_nationkey as part_id, (n_nationkey%5)*24000.0e0 as xmin, floor(n_nationkey/5)*24000.0e0 as ymin,
        (n_nationkey%5)*24000.0e0+24000.0e0 as xmax, floor(n_nationkey/5)*24000.0e0+24000.0e0 as ymax from nation""",
    # Five corners a part, against the clock; each third part has a hole, with the clock.
    "region_corners": """select n_regionkey as ecozone_id, n_nationkey as part_id, ring, i, (n_nationkey%5)*24000.0e0 + dx as x, floor(n_nationkey/5)*24000.0e0 + dy as y from nation,
        (select 0 as ring, 0 as i, 12000 as dx, 0 as dy union all select 0, 1, 24000, 9000 union all select 0, 2, 18000, 24000 union all select 0, 3, 11000, 17000 union all select 0, 4, 0, 8000
          union all select 1, 0, 9000, 9000 union all select 1, 1, 13000, 14000 union all select 1, 2, 15000, 8000) as corners where ring = 0 or n_nationkey % 3 = 0""",
    "observations": """select l_partkey as pixel_id, cast(l_shipdate as date) as acquired, cast(year(l_shipdate) as int) as year, cast(dayofyear(l_shipdate) as int) as doy,
        max(l_extendedprice) as v, cast(max(l_quantity) as int) as qa, cast(max(l_orderkey) % 101 as int) as cloud_cover from lineitem group by l_partkey, cast(l_shipdate as date), year(l_shipdate), dayofyear(l_shipdate)""",
    "cell_years": """select concat(cast(c_custkey as varchar(20)), '_', cast(1995 + c_custkey % 7 as varchar(20))) as id, c_custkey as cell_id, cast(1995 + c_custkey % 7 as int) as year, n_regionkey as ecozone,
        case when c_custkey % 3 = 0 and c_acctbal > 0 then cast(floor(c_acctbal) as int) else 0 end as fire,
        case when c_custkey % 4 = 0 and c_acctbal > 0 then cast(floor(c_acctbal/2) as int) else 0 end as harvest, c_mktsegment as segment,
        cast((c_custkey*41 % 96)*1000 as double) as xmin, cast((c_custkey*67 % 96)*1000 as double) as ymin,
        cast((c_custkey*41 % 96)*1000+30720 as double) as xmax, cast((c_custkey*67 % 96)*1000+30720 as double) as ymax
        from customer, nation where c_nationkey = n_nationkey""",
    "class_series": """select l_partkey as pixel_id, cast(l_shipdate as date) as acquired, cast(year(l_shipdate) as int) as year, cast(max(l_quantity) as int) % 10 as cls,
        max(l_tax)*5+0.5 as conf from lineitem group by l_partkey, cast(l_shipdate as date), year(l_shipdate)""",
}
SPARK_ONLY = {"class_probs": "select cast(floor(vec_id/50) as bigint) as pixel_id, cast(vec_id % 50 as int) as t, label, transform(e, x -> x / aggregate(e, 0D, (a,b) -> a+b)) as p from (select vec_id, label, transform(slice(embedding,1,10), x -> abs(cast(x as double))) as e from embeddings)"}
DUCKDB_ONLY = {"class_probs": "select cast(floor(vec_id/50) as bigint) as pixel_id, cast(vec_id % 50 as int) as t, label, list_transform(e, lambda x: x/list_sum(e)) as p from (select vec_id, label, list_transform(embedding[1:10], lambda x: abs(cast(x as double))) as e from embeddings)"}


class Tables:
    """Attribute access to base and derived tables of one folder; nothing is read before it is asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.spark, self.sf_dir = spark, sf_dir

    def tm_pixels_of(self, scenes: DataFrame) -> DataFrame:
        """``tm_pixels`` of some scenes only."""
        return tm_pixels(self.lineitem, self.scenes, self.orders, scenes)

    def nbr_met(self, scenes: DataFrame, clear: Column, decides: DataFrame) -> DataFrame:
        """The second sensor's pixels as ``second_sensor.nbr_met`` reduces them; ``scenes`` may have further columns."""
        return nbr_met(self.lineitem, scenes, self.orders, clear, decides)

    def __getattr__(self, name: str) -> DataFrame:
        if name in BASE:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name == "tm_pixels":  # the rows of its SQL, without a shuffle of all that the sensor sees
            return tm_pixels(self.lineitem, self.scenes, self.orders)
        sql = SPARK_ONLY.get(name) or TABLES[name]
        uses = {n for n in [*BASE, *TABLES] if re.search(rf"\b(from|join|,)\s*{n}\b", sql)}
        return self.spark.sql(re.sub(rf"\b(from|join|,)(\s*)({'|'.join(sorted(uses, key=len, reverse=True))})\b", r"\1\2{\3}", sql), **{n: getattr(self, n) for n in uses})


def with_tables(sql: str) -> str:
    """DuckDB SQL with the derived tables that it names, put in front as common table expressions."""
    every = TABLES | DUCKDB_ONLY
    needed: list[str] = []

    def need(text: str) -> None:
        for name in every:
            if re.search(rf"\b(from|join|,)\s*{name}\b", text) and name not in needed:
                need(every[name])
                needed.append(name)

    need(sql)
    head = ", ".join(f"{n} as ({every[n]})" for n in needed)
    body = sql.strip()
    if not head:
        return body
    if m := re.match(r"with\s+(recursive\s+)?", body, re.I):
        return f"with {m[1] or ''}{head}, {body[m.end():]}"
    return f"with {head} {body}"
