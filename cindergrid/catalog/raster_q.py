"""Queries of raster neighbourhood jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.operators import raster

_BOX = """b AS (SELECT MIN(r) AS r0, MAX(r) AS r1, MIN(c) AS c0, MAX(c) AS c1 FROM raster)"""


@query(
    "g1_box_statistics", "r:i c:i min:d4 max:d4 mean:d6 std:d5",
    _BOX + """, x AS (SELECT a.r, a.c, s.v FROM raster a CROSS JOIN b CROSS JOIN range(-2,3) AS p(i) CROSS JOIN range(-2,3) AS q(j)
        JOIN raster s ON s.r=LEAST(GREATEST(a.r+i,r0),r1) AND s.c=LEAST(GREATEST(a.c+j,c0),c1))
      SELECT r, c, MIN(v) AS min, MAX(v) AS max, AVG(v) AS mean, STDDEV_POP(v) AS std FROM x GROUP BY 1,2""",
    "raster",
)
def g1(t):
    return raster.box_statistics(t.raster, raster.half_window(0.2, 0.05))


@query(
    "g1_point_box_statistics", "detection_id min:d4 max:d4 mean:d6 std:d5",
    _BOX + """, x AS (SELECT a.r, a.c, s.v FROM raster a CROSS JOIN b CROSS JOIN range(-1,2) AS p(i) CROSS JOIN range(-1,2) AS q(j)
        JOIN raster s ON s.r=LEAST(GREATEST(a.r+i,r0),r1) AND s.c=LEAST(GREATEST(a.c+j,c0),c1)),
      g AS (SELECT r, c, MIN(v) AS min, MAX(v) AS max, AVG(v) AS mean, STDDEV_POP(v) AS std FROM x GROUP BY 1,2)
      SELECT detection_id, min, max, mean, std FROM detections LEFT JOIN g
       ON g.r=LEAST(GREATEST(CEIL((latitude-50.003E0)/0.05E0),0),b_r1()) AND g.c=LEAST(GREATEST(CEIL((longitude-100.003E0)/0.05E0),0),49)"""
    .replace("b_r1()", "(SELECT r1 FROM b)"),
    "detections raster",
)
def g1_points(t):
    # the axis length is the raster's own; 40 rows at the test scale, more above
    rows = t.raster.agg(F.max("r").alias("m")).scalar()
    stats = raster.box_statistics(t.raster, 1)
    pts = t.detections.withColumn("_m", rows).withColumns(
        {
            "r": F.least(F.greatest(F.ceil((F.col("latitude") - 50.003) / 0.05), F.lit(0)), F.col("_m"))
            .cast("long"),
            "c": raster.insertion_index("longitude", 100.003, 0.05, 50),
        }
    )
    longs = {"r": F.col("r").cast("long"), "c": F.col("c").cast("long")}
    return pts.join(stats.withColumns(longs), ["r", "c"], "left")


@query(
    "g2_gradient_statistics", "r:i c:i gradient_min:d5 gradient_max:d5 gradient_mean:d5 gradient_std:d4",
    _BOX + """, x AS (SELECT a.r, a.c, i, j, s.v FROM raster a CROSS JOIN b CROSS JOIN range(-2,3) AS p(i) CROSS JOIN range(-2,3) AS q(j)
        JOIN raster s ON s.r=LEAST(GREATEST(a.r+i,r0),r1) AND s.c=LEAST(GREATEST(a.c+j,c0),c1)),
      y AS (SELECT *, LAG(v) OVER wi AS vi0, LEAD(v) OVER wi AS vi1, LAG(v) OVER wj AS vj0, LEAD(v) OVER wj AS vj1 FROM x
        WINDOW wi AS (PARTITION BY r, c, j ORDER BY i), wj AS (PARTITION BY r, c, i ORDER BY j)),
      m AS (SELECT r, c, SQRT(POWER((CASE WHEN i=-2 THEN vi1-v WHEN i=2 THEN v-vi0 ELSE (vi1-vi0)/2 END)/0.5E0,2)
        + POWER((CASE WHEN j=-2 THEN vj1-v WHEN j=2 THEN v-vj0 ELSE (vj1-vj0)/2 END)/0.25E0,2)) AS g FROM y)
      SELECT r, c, MIN(g) AS gradient_min, MAX(g) AS gradient_max, AVG(g) AS gradient_mean, STDDEV_POP(g) AS gradient_std FROM m GROUP BY 1,2""",
    "raster",
)
def g2(t):
    return raster.gradient_statistics(t.raster, 2, 0.5, 0.25)


_KERNEL = "k AS (SELECT i, EXP(-0.5E0*POWER(i/1.5E0,2)) AS w FROM range(-6,7) AS r(i)), kn AS (SELECT i, w/SUM(w) OVER () AS w FROM k)"


@query(
    "g3_gaussian_density", "r:i c:i density:d8",
    _KERNEL + """, x AS (SELECT a.r, a.c, SUM(s.src*p.w*q.w) AS d FROM raster a CROSS JOIN kn p CROSS JOIN kn q
        JOIN raster s ON s.r=a.r+p.i AND s.c=a.c+q.i GROUP BY 1,2)
      SELECT r, c, COALESCE(d,0) AS density FROM x""",
    "raster",
)
def g3(t):
    return raster.gaussian_density(t.raster, 1.5)


@query(
    "g4_gaussian_smooth", "r:i c:i smooth:d5",
    _KERNEL + "," + _BOX + """, g AS (SELECT r, c, CASE WHEN src=1 THEN NULL ELSE v END AS v FROM raster),
      x AS (SELECT a.r, a.c, SUM(s.v*p.w*q.w)/SUM(CASE WHEN s.v IS NOT NULL THEN p.w*q.w END) AS d FROM g a CROSS JOIN b CROSS JOIN kn p CROSS JOIN kn q
        JOIN g s ON s.r=LEAST(GREATEST(a.r+p.i,r0),r1) AND s.c=LEAST(GREATEST(a.c+q.i,c0),c1) GROUP BY 1,2)
      SELECT r, c, d AS smooth FROM x""",
    "raster",
)
def g4(t):
    return raster.gaussian_smooth(t.raster.withColumn("v", F.when(F.col("src") == 0, F.col("v"))), 1.5)


@query(
    "g5_box_density", "r:i c:i density:d9 density_even:d9",
    """o AS (SELECT a.r, a.c, SUM(s.src) FILTER (s.r BETWEEN a.r-2 AND a.r+2 AND s.c BETWEEN a.c-2 AND a.c+2)/25.0E0 AS density,
         SUM(s.src) FILTER (s.r BETWEEN a.r-2 AND a.r+1 AND s.c BETWEEN a.c-2 AND a.c+1)/16.0E0 AS density_even
         FROM raster a JOIN raster s ON s.r BETWEEN a.r-2 AND a.r+2 AND s.c BETWEEN a.c-2 AND a.c+2 GROUP BY 1,2)
       SELECT * FROM o""",
    "raster",
)
def g5(t):
    return raster.box_density(raster.box_density(t.raster, 5), 4, out="density_even")


_DIST = "SQRT(POWER((a.r-s.r)*0.5E0,2)+POWER((a.c-s.c)*0.25E0,2))"


@query(
    "g6_distance_to_source", "r:i c:i distance:d6",
    f"SELECT a.r, a.c, MIN({_DIST}) AS distance FROM raster a, raster s WHERE s.src=1 GROUP BY 1,2", "raster",
)
def g6(t):
    return raster.distance_to_source(t.raster, 0.5, 0.25)


@query(
    "g7_coast_distance", "r:i c:i coast_km:d5 coast_closed_km:d5",
    """m AS (SELECT r, c, CASE WHEN (r*31+c*17)%100 < 70 THEN 1 ELSE 0 END AS m FROM raster),
       nb AS (SELECT * FROM (VALUES (0,0),(1,0),(-1,0),(0,1),(0,-1)) AS v(i,j)),
       di AS (SELECT a.r, a.c, MAX(s.m) AS m FROM m a CROSS JOIN nb JOIN m s ON s.r=a.r+i AND s.c=a.c+j GROUP BY 1,2),
       er AS (SELECT a.r, a.c, CASE WHEN COUNT(s.m)=5 THEN MIN(s.m) ELSE 0 END AS m FROM di a CROSS JOIN nb JOIN di s ON s.r=a.r+i AND s.c=a.c+j GROUP BY 1,2),
       d1 AS (SELECT a.r, a.c, MIN(CASE WHEN s.m=0 THEN """ + _DIST + """ END)-MIN(CASE WHEN s.m=1 THEN """ + _DIST + """ END) AS d FROM m a, m s GROUP BY 1,2),
       d2 AS (SELECT a.r, a.c, MIN(CASE WHEN s.m=0 THEN """ + _DIST + """ END)-MIN(CASE WHEN s.m=1 THEN """ + _DIST + """ END) AS d FROM er a, er s GROUP BY 1,2)
       SELECT d1.r, d1.c, d1.d*111.1E0 AS coast_km, d2.d*111.1E0 AS coast_closed_km FROM d1 JOIN d2 USING (r,c)""",
    "raster",
)
def g7(t):
    mask = t.raster.withColumn("landseamask", F.pmod(F.col("r") * 31 + F.col("c") * 17, F.lit(100)))
    return raster.coast_distance(mask, 0.5, 0.25)


@query(
    "g8_light_screening", "id:i radiance:d4 quality:i present:i",
    """x AS (SELECT p_partkey AS id, p_retailprice AS v, CASE WHEN p_partkey%7=0 THEN NULL ELSE p_partkey%4 END AS q, p_partkey%3 AS cov,
         40.0E0+p_partkey%40 AS lat FROM part),
       y AS (SELECT id, COALESCE(q,255) AS quality, CASE WHEN q IS NULL THEN v/2 WHEN lat>65 AND cov<1 THEN 0 WHEN q IN (0,1) THEN v END AS radiance FROM x)
       SELECT *, COALESCE(CAST(radiance>600 AS INT),0) AS present FROM y""",
)
def g8(t):
    k = F.col("p_partkey")
    x = t.table("part").select(
        k.alias("id"), F.col("p_retailprice").alias("radiance"),
        F.when(F.pmod(k, F.lit(7)) != 0, F.pmod(k, F.lit(4))).alias("quality"),
        F.pmod(k, F.lit(3)).alias("coverage"), (F.pmod(k, F.lit(40)) + 40.0).alias("latitude"),
        (F.col("p_retailprice") / 2).alias("static"),
    )
    return raster.presence(raster.screen_radiance(x, north=65.0, fallback="static"), "radiance", 600)


@query(
    "g9_rasterise_lines", "r:i c:i",
    """w AS (SELECT l_orderkey AS way, md5(detection_id) AS seq, longitude AS x, latitude AS y FROM (SELECT *, CAST(split_part(detection_id,':',1) AS BIGINT)
          AS l_orderkey FROM detections) WHERE l_orderkey%3<>0 AND NOT (l_orderkey%5=0)),
       p AS (SELECT way, seq, (x-100.0E0)/0.02E0 AS fx, (52.0E0-y)/0.02E0 AS fy FROM w),
       s AS (SELECT fx, fy, LEAD(fx) OVER q AS gx, LEAD(fy) OVER q AS gy FROM p WINDOW q AS (PARTITION BY way ORDER BY seq)),
       n AS (SELECT *, CAST(GREATEST(CEIL(GREATEST(ABS(gx-fx),ABS(gy-fy))),1) AS INT) AS n FROM s WHERE gx IS NOT NULL),
       e AS (SELECT *, UNNEST(range(0,n+1)) AS i FROM n)
       SELECT DISTINCT CAST(FLOOR(fy+(gy-fy)*(i/n)+0.5E0) AS BIGINT) AS r, CAST(FLOOR(fx+(gx-fx)*(i/n)+0.5E0) AS BIGINT) AS c FROM e
       WHERE FLOOR(fy+(gy-fy)*(i/n)+0.5E0) BETWEEN 0 AND 99 AND FLOOR(fx+(gx-fx)*(i/n)+0.5E0) BETWEEN 0 AND 119""",
    "detections",
)
def g9(t):
    way = F.split_part("detection_id", F.lit(":"), F.lit(1)).cast("long")
    v = t.detections.withColumn("way_id", way).select(
        "way_id", F.md5("detection_id").alias("seq"), F.col("longitude").alias("x"),
        F.col("latitude").alias("y"),
        F.when(F.pmod("way_id", F.lit(3)) == 0, "footway").otherwise("primary").alias("class"),
        F.when(F.pmod("way_id", F.lit(5)) == 0, "private").alias("access"),
    )
    return raster.rasterise_lines(v, 100.0, 52.0, 0.02, 100, 120, classes=["primary"])


@query(
    "g10_upsample", "r:i c:i v:d8",
    _BOX + """, t AS (SELECT a AS r, z AS c, a//3 AS i, z//3 AS j, (a%3)/3.0E0 AS y, (z%3)/3.0E0 AS x FROM b,
        range(0, r1*3+1) AS p(a), range(0, c1*3+1) AS q(z))
      SELECT t.r, t.c, LEAST(GREATEST((e.v*(1-y)*(1-x)+COALESCE(f.v,0)*(1-y)*x+COALESCE(g.v,0)*y*(1-x)+COALESCE(h.v,0)*y*x)/2000,0),1) AS v
      FROM t JOIN raster e ON e.r=i AND e.c=j LEFT JOIN raster f ON f.r=i AND f.c=j+1 LEFT JOIN raster g ON g.r=i+1 AND g.c=j
      LEFT JOIN raster h ON h.r=i+1 AND h.c=j+1""",
    "raster",
)
def g10(t):
    return raster.upsample(t.raster.withColumn("v", F.col("v") / 2000), 3, clip=True)
