"""Queries of spatial, nearest and grid joins."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.operators import grids, layers, raster, spatial

HAV = "2*6371.0E0*ASIN(SQRT(LEAST(1,POWER(SIN(RADIANS(b.y-a.y)/2),2)+COS(RADIANS(a.y))*COS(RADIANS(b.y))*POWER(SIN(RADIANS(b.x-a.x)/2),2))))"


@query(
    "c1_point_in_polygon", "detection_id n_name",
    """m AS (SELECT detection_id, MIN(n_name) AS n_name FROM detections JOIN polygons
          ON ABS(longitude-cx)/hx + ABS(latitude-cy)/hy < 1 GROUP BY 1)
       SELECT detection_id, COALESCE(m.n_name,'Unknown') AS n_name FROM detections LEFT JOIN m USING (detection_id)""",
    "detections polygons",
)
def c1(t):
    return spatial.tag_points(t.detections, t.polygons, "detection_id", ["n_name"])


@query(
    "c2_nearest_regular_axis", "detection_id i_up:i i_down:i",
    """SELECT detection_id, LEAST(GREATEST(FLOOR((latitude-50.2E0)/0.5E0+0.5E0),0),3) AS i_up,
       LEAST(GREATEST(CEIL((latitude-51.7E0)/(-0.5E0)-0.5E0),0),3) AS i_down FROM detections""",
    "detections",
)
def c2(t):
    return t.detections.withColumns(
        {
            "i_up": spatial.nearest_index("latitude", 50.2, 0.5, 4),
            "i_down": spatial.nearest_index("latitude", 51.7, -0.5, 4),
        }
    )


@query(
    "c2_nearest_irregular_axis", "detection_id nearest:d6",
    """ax AS (SELECT DISTINCT 100.0E0 + s_suppkey*s_suppkey/900.0E0 AS v FROM supplier WHERE s_suppkey < 50),
       c AS (SELECT v, (v+LAG(v) OVER (ORDER BY v))/2 AS lo, (v+LEAD(v) OVER (ORDER BY v))/2 AS hi FROM ax)
       SELECT detection_id, v AS nearest FROM detections JOIN c ON longitude >= COALESCE(lo,-1e9) AND longitude < COALESCE(hi,1e9)""",
    "detections",
)
def c2_irregular(t):
    axis = t.table("supplier").filter("s_suppkey < 50").select(
        (F.lit(100.0) + F.col("s_suppkey") * F.col("s_suppkey") / 900.0).alias("axis_value")
    )
    return spatial.nearest_on_axis(t.detections, "longitude", axis)


@query(
    "c3_raster_sample", "detection_id elev_v:d4",
    """SELECT detection_id, v AS elev_v FROM detections LEFT JOIN raster
       ON r=FLOOR((latitude-50.1E0)/0.05E0) AND c=FLOOR((longitude-100.2E0)/0.05E0)""",
    "detections raster",
)
def c3(t):
    return spatial.sample_raster(
        t.detections, t.raster, (100.2, 0.05, 50.1, 0.05), ["v"], prefix="elev_"
    )


_TILE_SQL = """tl AS (SELECT detection_id, CAST(FLOOR((longitude+180)/10) AS BIGINT) AS h, CAST(FLOOR((90-latitude)/10) AS BIGINT) AS v,
    CAST(LEAST(FLOOR(((90-latitude)/10-FLOOR((90-latitude)/10))*2400),2399) AS BIGINT) AS "row",
    CAST(LEAST(FLOOR(((longitude+180)/10-FLOOR((longitude+180)/10))*2400),2399) AS BIGINT) AS col, longitude<=180 AS valid FROM detections)"""


@query(
    "c4_tile_address", "detection_id h:i v:i pixel_row:i col:i valid:b",
    _TILE_SQL + """SELECT detection_id, h, v, "row" AS pixel_row, col, valid FROM tl""", "detections",
)
def c4(t):
    return spatial.tile_address(t.detections).withColumnRenamed("row", "pixel_row")


@query(
    "c4_tile_sample", "detection_id radiance:d4",
    _TILE_SQL + """, px AS (SELECT CAST(r AS BIGINT)*12+1900 AS "row", CAST(c AS BIGINT)*12 AS col, v AS radiance FROM raster)
      SELECT detection_id, radiance FROM tl LEFT JOIN px ON px."row"=tl."row"//12*12+4 AND px.col=tl.col//12*12""",
    "detections raster",
)
def c4_sample(t):
    snapped = spatial.tile_address(t.detections).withColumns(
        {
            "row": F.floor(F.col("row") / 12) * 12 + 4, "col": F.floor(F.col("col") / 12) * 12,
        }
    )
    pixels = t.raster.select(
        F.lit(28).cast("long").alias("h"),
        F.lit(3).cast("long").alias("v"),
        (F.col("r").cast("long") * 12 + 1900).alias("row"),
        (F.col("c").cast("long") * 12).alias("col"), F.col("v").alias("radiance"),
    )
    return spatial.sample_tiles(snapped, pixels, ["radiance"])


@query(
    "c5_nearest_year", "row_id source_year:i",
    """y AS (SELECT DISTINCT YEAR(acq_date) AS y FROM detections WHERE YEAR(acq_date) IN (1996,1998,2001)),
       p AS (SELECT row_id, CASE WHEN lat_key%7=0 THEN NULL ELSE YEAR(date) END AS year FROM predictions),
       c AS (SELECT row_id, year, y, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY ABS(y-year), y) AS k FROM p, y)
       SELECT row_id, CASE WHEN year IS NULL THEN 2001 ELSE y END AS source_year FROM c WHERE k=1""",
    "detections predictions",
)
def c5(t):
    years = t.detections.select(F.year("acq_date").alias("available_year")).filter(
        "available_year in (1996, 1998, 2001)"
    ).distinct()
    rows = t.predictions.withColumn(
        "year", F.when(F.pmod("lat_key", F.lit(7)) != 0, F.year("date"))
    )
    return spatial.nearest_year(rows, years)


@query(
    "c6_month_lookup", "detection_id mean:d6 max:d3",
    """m AS (SELECT lat_key-500 AS i, (lon_key-1000)/5 AS j, MONTH(date) AS month, AVG(v) AS mean, MAX(v) AS max FROM cube GROUP BY 1,2,3),
       d AS (SELECT detection_id, MONTH(acq_date) AS month, LEAST(GREATEST(FLOOR((latitude-50.003E0)/0.1E0+0.5E0),0),19) AS i,
         LEAST(GREATEST(FLOOR((longitude-100.003E0)/0.5E0+0.5E0),0),4) AS j FROM detections)
       SELECT detection_id, mean, max FROM d LEFT JOIN m USING (i, j, month)""",
    "detections cube",
)
def c6(t):
    from cindergrid.operators import series

    monthly = series.monthly_climatology(t.cube).withColumns(
        {"_i": F.col("lat_key") - 500, "_j": ((F.col("lon_key") - 1000) / 5).cast("long")}
    ).drop("lat_key", "lon_key")
    return series.month_lookup(
        t.detections.select("detection_id", "latitude", "longitude", F.col("acq_date").alias("date")),
        monthly, (50.003, 0.1, 20), (100.003, 0.5, 5),
    )


@query(
    "c7_bilinear_sample", "detection_id v:d6",
    """d AS (SELECT detection_id, (latitude-50.1E0)/0.05E0 AS fy, (longitude-100.2E0)/0.05E0 AS fx FROM detections),
       e AS (SELECT *, CAST(FLOOR(fy) AS BIGINT) AS r, CAST(FLOOR(fx) AS BIGINT) AS c FROM d)
       SELECT detection_id, (a.v*(1-(fy-e.r))*(1-(fx-e.c)) + b.v*(1-(fy-e.r))*(fx-e.c)
         + g.v*(fy-e.r)*(1-(fx-e.c)) + h.v*(fy-e.r)*(fx-e.c)) AS v FROM e
       LEFT JOIN raster a ON a.r=e.r AND a.c=e.c LEFT JOIN raster b ON b.r=e.r AND b.c=e.c+1
       LEFT JOIN raster g ON g.r=e.r+1 AND g.c=e.c LEFT JOIN raster h ON h.r=e.r+1 AND h.c=e.c+1""",
    "detections raster",
)
def c7(t):
    return spatial.bilinear_sample(t.detections, t.raster, 100.2, 0.05, 50.1, 0.05)


@query(
    "c8_fill_from_nearest", "r:i c:i v:d4",
    """g AS (SELECT r, c, CASE WHEN src=1 OR (r BETWEEN 5 AND 15 AND c BETWEEN 10 AND 30) THEN NULL ELSE v END AS v FROM raster),
       n AS (SELECT a.r, a.c, b.v, ROW_NUMBER() OVER (PARTITION BY a.r, a.c ORDER BY (a.r-b.r)*(a.r-b.r)+(a.c-b.c)*(a.c-b.c), b.r, b.c) AS k
         FROM g a, g b WHERE a.v IS NULL AND b.v IS NOT NULL)
       SELECT g.r, g.c, COALESCE(g.v, n.v) AS v FROM g LEFT JOIN n ON n.r=g.r AND n.c=g.c AND n.k=1""",
    "raster",
)
def c8(t):
    hole = (F.col("src") == 1) | (F.col("r").between(5, 15) & F.col("c").between(10, 30))
    return raster.fill_from_nearest(t.raster.withColumn("v", F.when(~hole, F.col("v"))))


@query(
    "c9_polygon_mean", "x:d6 y:d6 mean_value:d6 polygons:i",
    """sp AS (SELECT DISTINCT longitude AS x, latitude AS y FROM detections),
       eg AS (SELECT n_nationkey AS k, cx, cy, hx, hy, cx+a*hx AS x1, cy+b*hy AS y1, cx+c*hx AS x2, cy+d*hy AS y2 FROM polygons,
         (VALUES (1,0,0,1),(0,1,-1,0),(-1,0,0,-1),(0,-1,1,0)) AS v(a,b,c,d)),
       kk AS (SELECT PI()*6371.0E0/180 AS kd),
       pl AS (SELECT x, y, k, ABS(x-cx)/hx+ABS(y-cy)/hy < 1 AS ins, (x1-x)*COS(RADIANS(y))*kd AS ax, (y1-y)*kd AS ay,
         (x2-x1)*COS(RADIANS(y))*kd AS dx, (y2-y1)*kd AS dy FROM sp, eg, kk
         WHERE ABS(x-cx) < hx+0.3E0 AND ABS(y-cy) < hy+0.2E0),
       al AS (SELECT *, LEAST(GREATEST(-(ax*dx+ay*dy)/(dx*dx+dy*dy),0),1) AS u FROM pl),
       mt AS (SELECT DISTINCT x, y, k FROM al WHERE ins OR SQRT(POWER(ax+u*dx,2)+POWER(ay+u*dy,2)) <= 10)
       SELECT x, y, AVG(k) AS mean_value, COUNT(*) AS polygons FROM mt GROUP BY 1,2""",
    "detections polygons",
)
def c9(t):
    spots = t.detections.select("longitude", "latitude").distinct()
    out = spatial.polygon_mean(
        spots, t.polygons.withColumn("value", F.col("n_nationkey").cast("double")), "value", 10.0
    )
    return out.withColumnsRenamed({"longitude": "x", "latitude": "y", "value": "mean_value"})


_FRAGMENT_SQL = """fp AS (SELECT YEAR(date) AS y, MIN(date) AS d0, MAX(date) AS d1 FROM cube GROUP BY 1),
  fr AS (SELECT CONCAT('late',CAST(y AS VARCHAR)) AS id, 1 AS pr, d0-40 AS d0, d1 AS d1, 50.0E0 AS a0, 50.9E0 AS a1 FROM fp WHERE y>=1998
    UNION ALL SELECT CONCAT('all',CAST(y AS VARCHAR)), 2, d0-200, d1, 50.0E0, 51.5E0 FROM fp),
  hit AS (SELECT detection_id, id, ROW_NUMBER() OVER (PARTITION BY detection_id ORDER BY pr, id) AS k FROM detections JOIN fr
    ON d0 <= acq_date-29 AND d1 >= acq_date AND latitude BETWEEN a0-0.05E0 AND a1+0.05E0 AND longitude BETWEEN 100.0E0-0.05E0 AND 102.0E0+0.05E0),
  ro AS (SELECT d.detection_id, acq_date, id AS fragment_id FROM detections d LEFT JOIN hit ON hit.detection_id=d.detection_id AND k=1)"""


def _fragments(t):
    per = t.cube.groupBy(F.year("date").alias("y")).agg(F.min("date").alias("a"), F.max("date").alias("b"))
    kinds = F.explode(
        F.array(
            F.struct(F.lit("late").alias("n"), F.lit(1).alias("p"), F.lit(40).alias("k"), F.lit(50.9).alias("m")),
            F.struct(F.lit("all").alias("n"), F.lit(2).alias("p"), F.lit(200).alias("k"), F.lit(51.5).alias("m")),
        )
    )
    return per.withColumn("s", kinds).filter("s.n = 'all' or y >= 1998").select(
        F.col("s.p").alias("priority"), F.concat("s.n", F.col("y").cast("string")).alias("fragment_id"),
        F.date_sub("a", F.col("s.k")).alias("first_date"), F.col("b").alias("last_date"),
        F.lit(50.0).alias("lat_min"), F.col("s.m").alias("lat_max"),
        F.lit(100.0).alias("lon_min"), F.lit(102.0).alias("lon_max"),
        F.lit(180).alias("lon_convention"),
    )


def _routed(t):
    return spatial.route_fragments(t.detections, _fragments(t), 30, "detection_id", date="acq_date")


@query("c10_fragment_routing", "detection_id fragment_id", _FRAGMENT_SQL + "SELECT * FROM ro", "detections cube")
def c10(t):
    return _routed(t)


@query(
    "c11_coverage_report",
    "variable required_from:t required_to:t covered_rows:i missing_rows:i",
    _FRAGMENT_SQL + """, v AS (SELECT 't2m' AS variable, * FROM ro UNION ALL
        SELECT 'tp', detection_id, acq_date, CASE WHEN fragment_id LIKE 'late%' THEN fragment_id END FROM ro)
      SELECT variable, MIN(acq_date) AS required_from, MAX(acq_date) AS required_to, COUNT(fragment_id) AS covered_rows,
       COUNT(*)-COUNT(fragment_id) AS missing_rows FROM v GROUP BY 1""",
    "detections cube",
)
def c11(t):
    return spatial.coverage_report(_per_variable(t), date="acq_date")


def _per_variable(t):
    r = _routed(t)
    late = F.when(F.col("fragment_id").startswith("late"), F.col("fragment_id"))
    pairs = F.explode(
        F.array(
            F.struct(F.lit("t2m").alias("v"), F.col("fragment_id").alias("f")),
            F.struct(F.lit("tp").alias("v"), late.alias("f")),
        )
    )
    return r.select("detection_id", "acq_date", pairs.alias("p")).select(
        "detection_id", "acq_date", F.col("p.v").alias("variable"), F.col("p.f").alias("fragment_id")
    )


@query(
    "c11_fully_covered", "detection_id", _FRAGMENT_SQL + "SELECT detection_id FROM ro WHERE fragment_id LIKE 'late%'",
    "detections cube",
)
def c11_rows(t):
    return spatial.fully_covered(_per_variable(t), "detection_id")


_BUF = """ps AS (SELECT DISTINCT country, lat_key, lon_key, date FROM predictions WHERE is_fire=1 AND prob_raw>0.9E0),
  bl AS (SELECT DISTINCT country, lat_key+a AS lat_key, lon_key+b AS lon_key, date+d AS date FROM ps,
    (VALUES (-1),(0),(1)) AS x(a), (VALUES (-1),(0),(1)) AS y(b), (VALUES (-2),(-1),(0),(1),(2)) AS z(d))"""


@query(
    "c13_buffer_anti_join", "row_id",
    _BUF + """SELECT row_id FROM predictions p WHERE NOT EXISTS (SELECT 1 FROM bl WHERE bl.country=p.country AND
      bl.lat_key=p.lat_key AND bl.lon_key=p.lon_key AND bl.date=p.date)""",
    "predictions",
)
def c13(t):
    return grids.drop_buffered(
        t.predictions, t.predictions.filter("is_fire = 1 AND prob_raw > 0.9"), 1, 2
    )


@query(
    "c14_label_grid", "country lat_key:i lon_key:i date:t is_fire:i eval_weight:d1",
    """ce AS (SELECT DISTINCT country, lat_key, lon_key FROM predictions),
       d AS (SELECT CAST(x AS DATE) AS date FROM range(DATE '1998-03-01', DATE '1998-04-01', INTERVAL 1 DAY) AS t(x)),
       l AS (SELECT DISTINCT country, lat_key, lon_key, date FROM predictions WHERE is_fire=1)
       SELECT ce.country, ce.lat_key, ce.lon_key, d.date, CASE WHEN l.date IS NULL THEN 0 ELSE 1 END AS is_fire, 1 AS eval_weight
       FROM ce CROSS JOIN d LEFT JOIN l ON l.country=ce.country AND l.lat_key=ce.lat_key AND l.lon_key=ce.lon_key AND l.date=d.date""",
    "predictions",
)
def c14(t):
    cells = t.predictions.select("country", "lat_key", "lon_key").distinct()
    return grids.label_grid(
        grids.cell_dates(cells, date(1998, 3, 1), date(1998, 3, 31)), t.predictions.filter("is_fire = 1")
    )


@query(
    "c16_per_unique_key", "row_id cell_mean:d6",
    """SELECT row_id, v AS cell_mean FROM predictions p LEFT JOIN (SELECT lat_key, lon_key, AVG(v) AS v FROM cube GROUP BY 1,2) c
       USING (lat_key, lon_key)""",
    "predictions cube",
)
def c16(t):
    means = t.cube.groupBy("lat_key", "lon_key").agg(F.avg("v").alias("cell_mean"))
    return grids.per_unique_key(
        t.predictions, ["lat_key", "lon_key"],
        lambda keys: keys.join(means, ["lat_key", "lon_key"], "left"),
    )


@query(
    "c17_feature_assembly", "row_id is_fire:i a:d6 b:d6",
    """SELECT row_id, is_fire, prob_raw*2 AS a, eval_weight+1 AS b FROM predictions""",
    "predictions",
)
def c17(t):
    p = t.predictions
    anchors = p.select("row_id", "is_fire")
    first = p.select("row_id", (F.col("prob_raw") * 2).alias("a"), F.lit(9).alias("is_fire"))
    second = p.select("row_id", (F.col("eval_weight") + 1).alias("b"), F.lit(-1.0).alias("a"))
    return grids.assemble(anchors, [first, second], ["row_id"])


@query(
    "c18_static_strata", "row_id ecoregion burnable:b",
    """ce AS (SELECT DISTINCT country, lat_key, lon_key FROM predictions WHERE lon_key%3<>0)
       SELECT row_id, CASE WHEN ce.country IS NULL THEN 'Unknown' ELSE CONCAT('E',CAST(p.lat_key%4 AS VARCHAR)) END AS ecoregion,
        CASE WHEN ce.country IS NULL THEN TRUE ELSE p.lon_key%2=0 END AS burnable
       FROM predictions p LEFT JOIN ce ON ce.country=p.country AND ce.lat_key=p.lat_key AND ce.lon_key=p.lon_key""",
    "predictions",
)
def c18(t):
    cells = t.predictions.select("country", "lat_key", "lon_key").distinct().filter(
        F.pmod("lon_key", F.lit(3)) != 0
    ).withColumns(
        {
            "ecoregion": F.concat(F.lit("E"), F.pmod("lat_key", F.lit(4)).cast("string")),
            "burnable": F.pmod("lon_key", F.lit(2)) == 0,
        }
    )
    return grids.static_strata(t.predictions, cells, {"ecoregion": "Unknown", "burnable": True})


@query(
    "c19_region_membership", "row_id region",
    """SELECT row_id, r_name AS region FROM predictions JOIN regions ON lat_key BETWEEN lat_min AND lat_max AND
       lon_key BETWEEN lon_min AND lon_max UNION ALL SELECT row_id, 'global' FROM predictions""",
    "predictions regions",
)
def c19(t):
    from cindergrid.operators.regions import region_rows

    return region_rows(t.predictions, t.regions, include_global=True)


@query(
    "c20_semi_join_cells", "row_id",
    """SELECT row_id FROM predictions WHERE (lat_key, lon_key) IN (SELECT (lat_key, lon_key) FROM cube)""",
    "predictions cube",
)
def c20(t):
    return spatial.semi_join_cells(t.predictions, t.cube)


@query(
    "c21_align_rows", "row_id position:i prob_raw:d9",
    """SELECT row_id, ROW_NUMBER() OVER (PARTITION BY country, date, lat_key, lon_key ORDER BY md5(row_id)) AS position, prob_raw
       FROM predictions""",
    "predictions",
)
def c21(t):
    from pyspark.sql import Window

    p = t.predictions
    w = Window.partitionBy("country", "date", "lat_key", "lon_key").orderBy(F.md5("row_id"))
    order = p.select("row_id", F.row_number().over(w).alias("position"))
    return grids.align_rows(p.select("row_id", "prob_raw"), order, ["row_id"])


@query(
    "c22_block_replacement", "row_id is_fire:i prob_raw:d9 eval_weight:d3",
    """SELECT row_id, is_fire, 1-prob_raw AS prob_raw, eval_weight*3 AS eval_weight FROM predictions""",
    "predictions",
)
def c22(t):
    base = t.predictions.select("row_id", "is_fire", "prob_raw", "eval_weight")
    other = base.select(
        "row_id", (1 - F.col("prob_raw")).alias("prob_raw"), (F.col("eval_weight") * 3).alias("eval_weight")
    )
    return grids.replace_block(base, other, ["prob_raw", "eval_weight"], ["row_id"])


_EXTENTS = """e AS (SELECT country, MIN(lat_key)+CAST(SUBSTR(country,2) AS INT) AS lat_min, MAX(lat_key) AS lat_max, MIN(lon_key) AS lon_min,
    MAX(lon_key)-3*CAST(SUBSTR(country,2) AS INT) AS lon_max, MIN(date) AS d0, MAX(date) AS d1 FROM predictions GROUP BY 1),
  b AS (SELECT MAX(lat_min) AS a0, MIN(lat_max) AS a1, MAX(lon_min) AS o0, MIN(lon_max) AS o1, MAX(d0) AS d0, MIN(d1) AS d1 FROM e)"""


def _footprint(t):
    k = F.substring("country", 2, 1).cast("int")
    e = t.predictions.groupBy("country").agg(
        F.min("lat_key").alias("lat_min"), F.max("lat_key").alias("lat_max"),
        F.min("lon_key").alias("lon_min"), F.max("lon_key").alias("lon_max"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    ).withColumns({"lat_min": F.col("lat_min") + k, "lon_max": F.col("lon_max") - 3 * k})
    return spatial.common_footprint(e)


@query(
    "c23_common_footprint", "lat_min:i lat_max:i lon_min:i lon_max:i first_date:t last_date:t overlaps:b",
    _EXTENTS + """SELECT a0 AS lat_min, a1 AS lat_max, o0 AS lon_min, o1 AS lon_max, d0 AS first_date, d1 AS last_date,
      a0<=a1 AND o0<=o1 AND d0<=d1 AS overlaps FROM b""",
    "predictions",
)
def c23(t):
    return _footprint(t)


@query(
    "c23_footprint_rows", "row_id",
    _EXTENTS + """SELECT row_id FROM predictions, b WHERE lat_key BETWEEN a0 AND a1 AND lon_key BETWEEN o0 AND o1
      AND date BETWEEN d0 AND d1""",
    "predictions",
)
def c23_rows(t):
    box = _footprint(t).drop("overlaps")
    return spatial.inside_footprint(t.predictions, box)


@query(
    "c24_nearest_event", "x:d6 y:d6 nearest_km:d6",
    f"""a AS (SELECT 100.013E0 + c*0.05E0 AS x, 50.017E0 + r*0.05E0 AS y FROM raster),
      b AS (SELECT DISTINCT longitude AS x, latitude AS y FROM detections)
      SELECT a.x, a.y, MIN({HAV}) AS nearest_km FROM a, b GROUP BY 1,2""",
    "detections raster",
)
def c24(t):
    spots = t.raster.select((F.lit(100.013) + F.col("c") * 0.05).alias("longitude"), (F.lit(50.017) + F.col("r") * 0.05).alias("latitude"))
    return spatial.nearest_event_km(spots, t.detections).withColumnsRenamed({"longitude": "x", "latitude": "y"})


@query(
    "c25_events_within", "x:d6 y:d6 count_5km:i density_5km:d9 count_25km:i density_25km:d9",
    # an event within 25 km lies in the place's own bucket or beside it
    f"""h AS (SELECT longitude AS x, latitude AS y, COUNT(*) AS n, FLOOR(longitude/0.45E0) AS bx, FLOOR(latitude/0.25E0) AS by FROM detections GROUP BY ALL),
      g AS (SELECT a.x, a.y, b.n, {HAV} AS d FROM h a, (VALUES (-1),(0),(1)) AS u(i), (VALUES (-1),(0),(1)) AS v(j), h b
        WHERE b.bx=a.bx+i AND b.by=a.by+j),
      f AS (SELECT x, y, SUM(n) FILTER (d<=5) AS a, SUM(n) FILTER (d<=25) AS b FROM g GROUP BY 1,2)
      SELECT x, y, a AS count_5km, a/(PI()*25) AS density_5km, b AS count_25km, b/(PI()*625) AS density_25km FROM f""",
    "detections",
)
def c25(t):
    return spatial.counts_within(t.detections, t.detections, [5.0, 25.0]).withColumnsRenamed(
        {"longitude": "x", "latitude": "y"}
    )


@query(
    "c26_grid_difference", "month:i cells:i mae:d6 rmse:d6 max_abs:d3",
    """a AS (SELECT *, YEAR(date) AS y, MONTH(date) AS month, DAY(date) AS dd FROM cube)
       SELECT a.month, COUNT(*) AS cells, AVG(ABS(a.v-b.v)) AS mae, SQRT(AVG(POWER(a.v-b.v,2))) AS rmse, MAX(ABS(a.v-b.v)) AS max_abs
       FROM a JOIN a b ON a.y=1998 AND b.y=1999 AND a.month=b.month AND a.dd=b.dd AND a.lat_key=b.lat_key AND a.lon_key=b.lon_key GROUP BY 1""",
    "cube",
)
def c26(t):
    c = t.cube.withColumns({"month": F.month("date"), "dd": F.dayofmonth("date")})
    return spatial.grid_difference(
        c.filter(F.year("date") == 1998), c.filter(F.year("date") == 1999),
        ["lat_key", "lon_key", "month", "dd"], group=["month"],
    )


@query(
    "c27_static_layers", "detection_id v:d3 v_soil:i",
    """l AS (SELECT lat_key-500 AS i, (lon_key-1000)/5 AS j, ARG_MAX(v, date) AS v FROM cube GROUP BY 1,2),
       d AS (SELECT detection_id, LEAST(GREATEST(FLOOR((latitude-50.003E0)/0.1E0+0.5E0),0),19) AS i,
         LEAST(GREATEST(FLOOR((longitude-100.003E0)/0.5E0+0.5E0),0),4) AS j FROM detections)
       SELECT detection_id, v, CASE WHEN CAST(v AS INT)%3=0 THEN 99 ELSE CAST(v AS INT) END AS v_soil FROM d LEFT JOIN l USING (i,j)""",
    "detections cube",
)
def c27(t):
    base = t.cube.withColumns(
        {"i": F.col("lat_key") - 500, "j": ((F.col("lon_key") - 1000) / 5).cast("long")}
    )
    axes = ((50.003, 0.1, 20), (100.003, 0.5, 5))
    soil = base.withColumn("v", F.when(F.col("v").cast("int") % 3 != 0, F.col("v")))
    return layers.attach_layers(
        t.detections,
        {"cover": (base, axes, ["v"], {}), "soil": (soil, axes, ["v"], {"v_soil": 99})},
    )


@query(
    "c28_dated_lights", "detection_id radiance:d4 quality:i source_year:i",
    """y AS (SELECT detection_id, latitude, CAST(FLOOR((latitude-50.1E0)/0.05E0) AS INT) AS r, CAST(FLOOR((longitude-100.2E0)/0.05E0) AS INT) AS c,
         CASE WHEN YEAR(acq_date)<=1997 THEN 1996 ELSE 2000 END AS source_year FROM detections),
       s AS (SELECT y.*, v, src FROM y LEFT JOIN raster USING (r, c)),
       q AS (SELECT *, CASE WHEN v IS NULL OR (r+c+source_year)%5=0 THEN NULL ELSE (r*3+c)%4 END AS qf FROM s)
       SELECT detection_id, source_year, COALESCE(qf,255) AS quality, CASE WHEN qf IS NULL THEN v*0.5E0
         WHEN latitude>51.5E0 AND src<1 THEN 0 WHEN qf IN (0,1) THEN v+source_year END AS radiance FROM q""",
    "detections raster",
)
def c28(t):
    transform = (100.2, 0.05, 50.1, 0.05)
    tile_years = F.explode(F.array(F.lit(1996), F.lit(2000)))
    tiles = t.raster.withColumn("source_year", tile_years).filter(
        F.pmod(F.col("r") + F.col("c") + F.col("source_year"), F.lit(5)) != 0
    ).select(
        "source_year", "r", "c", (F.col("v") + F.col("source_year")).alias("radiance"),
        F.pmod(F.col("r") * 3 + F.col("c"), F.lit(4)).alias("quality"),
    )
    static = t.raster.select("r", "c", (F.col("v") * 0.5).alias("static_light"), F.col("src").alias("coverage"))
    years = t.raster.select(tile_years.alias("available_year")).distinct()
    rows = t.detections.withColumn("year", F.when(F.year("acq_date") <= 1997, 1996).otherwise(2000))
    return layers.attach_lights(rows, static, tiles, years, transform, north=51.5)
