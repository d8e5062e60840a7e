"""Queries of the scan, cube and keyed-table operators."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cindergrid.catalog.base import query, scratch
from cindergrid.operators import spatial
from cindergrid.sources import cubes, detections, tables

LO, HI = date(1997, 1, 1), date(1999, 12, 31)


@query(
    "a1_detection_scan",
    "detection_id country acq_date:t latitude:d9 longitude:d9 brightness:d3 confidence:d3",
    """SELECT * FROM detections WHERE country IN ('C0','C2','C9')
       AND acq_date BETWEEN DATE '1997-01-01' AND DATE '1999-12-31'""",
    "detections",
)
def a1(t):
    return detections.select_detections(t.detections, ["C0", "C2", "C9"], LO, HI)


@query(
    "a1_file_scan", "country year:i acq_date:t latitude:d6 longitude:d6 brightness:d3 confidence:d3",
    """SELECT country, YEAR(acq_date) AS year, acq_date, latitude, longitude, brightness, confidence FROM detections
       WHERE country IN ('C0','C2') AND acq_date BETWEEN DATE '1997-06-01' AND DATE '1998-05-31'""",
    "detections",
)
def a1_files(t):
    root = scratch(t.spark, "detections")
    # files of more years and countries than the scan wants
    for year in (1996, 1997, 1998):
        for country in ("C0", "C1", "C2"):
            own = t.detections.filter((F.year("acq_date") == year) & (F.col("country") == country))
            own.select(*detections.REQUIRED).write.option("header", True).csv(
                f"{root}/modis/{year}/modis_{year}_{country}.csv"
            )
    return detections.scan_detections(t.spark, root, ["C0", "C2", "C9"], date(1997, 6, 1), date(1998, 5, 31))


@query(
    "a3_country_tagging", "n_name year:i detections:i",
    """m AS (SELECT detection_id, acq_date, MIN(n_name) AS n_name FROM detections, polygons
         WHERE ABS(longitude-cx)/hx + ABS(latitude-cy)/hy < 1 GROUP BY 1,2)
       SELECT n_name, YEAR(acq_date) AS year, COUNT(*) AS detections FROM m GROUP BY 1,2""",
    "detections polygons",
)
def a3(t):
    tagged = spatial.tag_points(t.detections, t.polygons, "detection_id", ["n_name"], how="inner")
    path = scratch(t.spark, "tagged")
    detections.write_by_country(
        tagged.select("n_name", F.year("acq_date").alias("year"), "detection_id"),
        path, "n_name", ["year"],
    )
    back = t.spark.read.parquet(path)
    return back.groupBy("n_name", "year").agg(F.count(F.lit(1)).alias("detections"))


@query(
    "a4_ordered_union", "lat_key:i lon_key:i date:t v:d3 source_year:i",
    """a AS (SELECT date, lat_key, lon_key, v, 0 AS src, NULL AS source_year FROM cube
             WHERE YEAR(date) <= 1998),
       b AS (SELECT date, lat_key, lon_key, v*2 AS v, 1 AS src, YEAR(date) AS source_year FROM cube
             WHERE YEAR(date) >= 1998),
       u AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY date, lat_key, lon_key ORDER BY src DESC) AS k
             FROM (SELECT * FROM a UNION ALL SELECT * FROM b))
       SELECT * FROM u WHERE k=1""",
    "cube",
)
def a4(t):
    old = t.cube.filter(F.year("date") <= 1998)
    new = t.cube.filter(F.year("date") >= 1998).withColumns(
        {"v": F.col("v") * 2, "source_year": F.year("date")}
    )
    return tables.ordered_union(
        [old, new], ["date", "lat_key", "lon_key", "v", "source_year"],
        ["date", "lat_key", "lon_key"],
    )


@query(
    "a5_normalise_cube", "date:t latitude:d6 longitude:d6 v:d3",
    """SELECT acq_date AS date, ROUND(latitude,1) AS latitude,
         (ROUND(longitude*3,0) + 180) % 360 - 180 AS longitude, ARG_MIN(brightness, detection_id) AS v
       FROM detections GROUP BY 1,2,3""",
    "detections",
)
def a5(t):
    raw = t.detections.select(
        F.col("acq_date").alias("valid_time"), F.round("latitude", 1).alias("latitude"),
        F.round(F.col("longitude") * 3, 0).alias("longitude"), F.col("brightness").alias("v"),
        F.col("detection_id").alias("seq"),
    )
    return cubes.normalise_cube(raw)


@query(
    "a6_ensemble_mean", "date:t lat_key:i lon_key:i v:d6",
    """SELECT date, lat_key, lon_key, AVG(prob_raw) AS v FROM predictions GROUP BY 1,2,3""",
    "predictions",
)
def a6(t):
    members = t.predictions.withColumnRenamed("prob_raw", "v")
    return cubes.ensemble_mean(members)


@query(
    "a7_deaccumulate", "date:t lat_key:i lon_key:i v:d3",
    """SELECT date, lat_key, lon_key, CASE WHEN b IS NULL THEN v WHEN v > b THEN v - b ELSE 0 END AS v
       FROM (SELECT *, LAG(v) OVER (PARTITION BY lat_key, lon_key ORDER BY date) AS b FROM cube)""",
    "cube",
)
def a7(t):
    return cubes.deaccumulate(t.cube)


@query(
    "a8_vector_magnitude", "date:t lat_key:i lon_key:i speed:d6",
    "SELECT date, lat_key, lon_key, SQRT(v*v + (v*0.5E0+1)*(v*0.5E0+1)) AS speed FROM cube",
    "cube",
)
def a8(t):
    other = t.cube.withColumn("v", F.col("v") * 0.5 + 1)
    return cubes.magnitude(t.cube, other)


@query(
    "a9_merge_shards", "date:t lat_key:i lon_key:i v:d3",
    """SELECT date, lat_key, lon_key, v FROM cube WHERE date BETWEEN DATE '1997-01-01' AND
       DATE '1999-12-31' AND lat_key*0.1E0 BETWEEN 50.25E0 AND 51.15E0
       AND lon_key*0.1E0 BETWEEN 100.45E0 AND 101.55E0""",
    "cube",
)
def a9(t):
    c = t.cube.withColumns(
        {"latitude": F.col("lat_key") * F.lit(0.1), "longitude": F.col("lon_key") * F.lit(0.1)}
    )
    shards = [c.filter(F.year("date") == y) for y in range(1995, 2002)]
    return cubes.merge_shards(shards, (LO, HI), (50.3, 100.5, 51.1, 101.5))


_SOURCES = """src AS (SELECT *, CONCAT('era', CAST(YEAR(date) AS VARCHAR)) AS source FROM cube
    WHERE YEAR(date) < 1999 OR lat_key < 510),
  ps AS (SELECT source, MIN(date) AS first_date, MAX(date) AS last_date, COUNT(DISTINCT date) AS days,
      MIN(lat_key) AS lat_min, MAX(lat_key) AS lat_max, COUNT(DISTINCT lat_key) AS n_lat,
      MIN(lon_key) AS lon_min, MAX(lon_key) AS lon_max, COUNT(DISTINCT lon_key) AS n_lon
    FROM src GROUP BY 1)"""


def _sources(t):
    return t.cube.filter((F.year("date") < 1999) | (F.col("lat_key") < 510)).withColumn(
        "source", F.concat(F.lit("era"), F.year("date").cast("string"))
    )


@query(
    "a10_fragment_catalogue",
    "sources first_date:t last_date:t days:i lat_min:i lat_max:i n_lat:i lon_min:i lon_max:i "
    "n_lon:i lat_step:d6 lon_step:d6 area:i priority:i",
    _SOURCES + """, f AS (SELECT lat_min, lat_max, n_lat, lon_min, lon_max, n_lon,
        MIN(first_date) AS first_date, MAX(last_date) AS last_date, SUM(days) AS days,
        STRING_AGG(source, ';' ORDER BY source) AS sources FROM ps GROUP BY 1,2,3,4,5,6),
      g AS (SELECT *, (lat_max-lat_min)*0.1E0/(n_lat-1) AS lat_step,
        (lon_max-lon_min)*0.1E0/(n_lon-1) AS lon_step,
        (lat_max-lat_min)*(lon_max-lon_min) AS area FROM f)
      SELECT *, ROW_NUMBER() OVER (ORDER BY lat_step, lon_step, area, sources) AS priority FROM g""",
    "cube",
)
def a10(t):
    return cubes.fragment_catalogue(_sources(t))


@query(
    "a11_coverage_audit",
    "variable year:i days:i expected_days:i reason repair_priority:i",
    _SOURCES + """, fr AS (SELECT 'v' AS variable, CAST(source[4:] AS INT) AS year, * FROM ps),
      w AS (SELECT 'v' AS variable, y AS year FROM range(1994, 2003) AS r(y)),
      j AS (SELECT w.variable, w.year, COALESCE(days,0) AS days, days AS raw_days,
          lat_min<=500 AND lat_max>=512 AND lon_min<=1000 AND lon_max>=1020 AS ok,
          DAYOFYEAR(MAKE_DATE(w.year,12,31)) AS expected_days
        FROM w LEFT JOIN fr USING (variable, year)),
      r AS (SELECT *, CASE WHEN raw_days IS NULL THEN 'missing_file' WHEN NOT ok THEN 'domain_too_small'
          WHEN days < expected_days THEN 'missing_days' ELSE 'complete' END AS reason FROM j)
      SELECT variable, year, days, expected_days, reason, CASE reason WHEN 'missing_file' THEN 0
        WHEN 'domain_too_small' THEN 1 WHEN 'missing_days' THEN 2 ELSE 3 END AS repair_priority FROM r""",
    "cube",
)
def a11(t):
    per_year = (
        _sources(t)
        .groupBy(F.lit("v").alias("variable"), F.year("date").alias("year"))
        .agg(
            F.count_distinct("date").alias("days"),
            F.min("lat_key").alias("lat_min"), F.max("lat_key").alias("lat_max"),
            F.min("lon_key").alias("lon_min"), F.max("lon_key").alias("lon_max"),
        )
    )
    return cubes.coverage_audit(per_year, per_year, (1994, 2002), (500, 1000, 512, 1020))


@query(
    "a12_country_sink", "source_country rows:i brightness:d3",
    """SELECT country AS source_country, COUNT(*) AS rows, SUM(brightness) AS brightness
       FROM detections GROUP BY 1""",
    "detections",
)
def a12(t):
    path = scratch(t.spark, "features")
    features = t.detections.withColumnRenamed("country", "_source_country")
    detections.write_by_country(features, path)
    back = t.spark.read.parquet(path)
    return back.groupBy(F.col("_source_country").alias("source_country")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("brightness").alias("brightness")
    )


@query(
    "a13_upsert", "country lat_key:i month:i n:i total:d3",
    """o AS (SELECT country, lat_key, MONTH(date) AS month, COUNT(*) AS n, SUM(eval_weight) AS total
             FROM predictions GROUP BY 1,2,3),
       nw AS (SELECT country, lat_key, month, n*10 AS n, total*2 AS total FROM o WHERE lat_key < 506
              UNION ALL SELECT 'new' AS country, lat_key, 13 AS month, n, total FROM o WHERE month=1)
       SELECT * FROM o WHERE NOT EXISTS (SELECT 1 FROM nw WHERE nw.country=o.country AND
         nw.lat_key=o.lat_key AND nw.month=o.month) UNION ALL SELECT * FROM nw""",
    "predictions",
)
def a13(t):
    old = t.predictions.groupBy("country", "lat_key", F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("eval_weight").alias("total")
    )
    new = old.filter("lat_key < 506").withColumns({"n": F.expr("n*10"), "total": F.expr("total*2")})
    new = new.unionByName(
        old.filter("month = 1").withColumns({"country": F.lit("new"), "month": F.lit(13)})
    )
    return tables.upsert(old, new, ["country", "lat_key", "month"])


@query(
    "a14_sample_cache", "requested:i missing:i resolved:i",
    """r AS (SELECT DISTINCT lat_key, lon_key, date FROM predictions),
       c AS (SELECT DISTINCT lat_key, lon_key, date FROM cube WHERE YEAR(date) <= 1999)
       SELECT COUNT(*) AS requested, COUNT(*) FILTER (c.date IS NULL) AS missing,
         COUNT(*) FILTER (c.date IS NOT NULL) AS resolved
       FROM r LEFT JOIN c ON r.lat_key=c.lat_key AND r.lon_key=c.lon_key AND r.date=c.date""",
    "predictions cube",
)
def a14(t):
    cache = t.cube.filter(F.year("date") <= 1999)
    return tables.cache_misses(t.predictions, cache, ["lat_key", "lon_key", "date"])


@query(
    "a14_cache_resolved", "row_id lat_key:i lon_key:i date:t v:d3",
    """SELECT row_id, p.lat_key, p.lon_key, p.date, CASE WHEN YEAR(p.date) <= 1999 AND c.v IS NOT NULL
         THEN c.v ELSE p.lat_key + p.lon_key END AS v FROM predictions p LEFT JOIN cube c
       ON p.lat_key=c.lat_key AND p.lon_key=c.lon_key AND p.date=c.date""",
    "predictions cube",
)
def a14_rows(t):
    cache = t.cube.filter(F.year("date") <= 1999)
    served, _ = tables.resolve_cache(
        t.predictions, cache, ["lat_key", "lon_key", "date"],
        lambda miss: miss.withColumn("v", (F.col("lat_key") + F.col("lon_key")).cast("double")),
    )
    return served


@query(
    "a15_cache_validity", "excess_rows:i cached_rows:i cached_positives:i valid:b",
    """h AS (SELECT lat_key, lon_key, date, COUNT(*) AS n FROM predictions WHERE YEAR(date)=1998
             GROUP BY 1,2,3),
       w AS (SELECT lat_key, lon_key, date, COUNT(*) AS n FROM predictions WHERE model_name='m1'
             GROUP BY 1,2,3),
       x AS (SELECT SUM(GREATEST(h.n-COALESCE(w.n,0),0)) AS excess_rows, SUM(h.n) AS cached_rows
             FROM h LEFT JOIN w USING (lat_key, lon_key, date))
       SELECT excess_rows, cached_rows, (SELECT SUM(is_fire) FROM predictions WHERE YEAR(date)=1998)
         AS cached_positives, excess_rows=0 AS valid FROM x""",
    "predictions",
)
def a15(t):
    p = t.predictions
    return tables.is_multiset_subset(
        p.filter(F.year("date") == 1998), p.filter("model_name = 'm1'"),
        ["lat_key", "lon_key", "date"], "is_fire", 10,
    )


@query(
    "a16_narrow_types", "country rows:i brightness:d2 types",
    """SELECT country, COUNT(*) AS rows, SUM(brightness) AS brightness,
       'detections:int,brightness:float' AS types FROM detections GROUP BY 1""",
    "detections",
)
def a16(t):
    narrow = detections.narrow_types(
        t.detections.groupBy("country", "acq_date").agg(
            F.count(F.lit(1)).alias("detections"), F.sum("brightness").alias("brightness")
        )
    )
    types = ",".join(f"{c}:{k}" for c, k in narrow.dtypes if c in ("detections", "brightness"))
    return narrow.groupBy("country").agg(
        F.sum("detections").alias("rows"),
        F.sum(F.col("brightness").cast("double")).alias("brightness"),
        F.lit(types).alias("types"),
    )


@query(
    "a17_grid_pivot", "row:i col:i score:d6",
    """g AS (SELECT DISTINCT lat_key-500 AS row, lon_key-1000 AS col FROM cube
             UNION SELECT lat_key-480 AS row, lon_key-1000 AS col FROM cube),
       s AS (SELECT CAST(round_even((latitude-50.0E0)/0.1E0,0) AS BIGINT) AS row,
                    CAST(round_even((longitude-100.0E0)/0.1E0,0) AS BIGINT) AS col,
                    AVG(confidence) AS score FROM detections GROUP BY 1,2)
       SELECT row, col, score FROM g LEFT JOIN s USING (row, col)""",
    "detections cube",
)
def a17(t):
    cells = t.cube.select(
        F.explode(F.array(F.col("lat_key") - 500, F.col("lat_key") - 480)).alias("row"),
        (F.col("lon_key") - 1000).alias("col"),
    ).distinct()
    return cubes.to_grid(t.detections, cells, 100.0, 50.0, 0.1, "confidence").withColumnRenamed(
        "confidence", "score"
    )
