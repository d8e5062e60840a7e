"""Queries of negatives, deployment samples, splits and weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.catalog.reports_q import SPLIT, with_split
from cindergrid.functions.labels import StaticContext
from cindergrid.operators import grids, ranking, sampling
from cindergrid.operators.draws import permutation_sql
from cindergrid.plans import targets

START, END = "1995-01-01", "2001-12-31"
PERIOD = "1997-01-01", "1999-12-31"  # of the jobs whose period is shorter than the table's
CD = "country lat_key:i lon_key:i date:t"


def _hex(text):
    return f"('0x'||substr(md5({text}),1,8))::BIGINT"


_KEY = "country||':'||lat_key||':'||lon_key||':'||date"
BASE = """ce AS (SELECT DISTINCT country, lat_key, lon_key, CONCAT('E',CAST(lat_key%4 AS VARCHAR)) AS ecoregion_name,
    lon_key%2=0 AS burnable, CONCAT('L',CAST(lon_key%3 AS VARCHAR)) AS landcover_key, (lat_key*7+lon_key)%29=0 AS city FROM predictions),
  po AS (SELECT DISTINCT country, lat_key, lon_key, date, CONCAT('E',CAST(lat_key%4 AS VARCHAR)) AS ecoregion_name,
    lon_key%2=0 AS burnable, CONCAT('L',CAST(lon_key%3 AS VARCHAR)) AS landcover_key FROM predictions
    WHERE is_fire=1)"""


def _strata(df):
    return df.withColumns(
        {
            "ecoregion_name": F.concat(F.lit("E"), F.pmod("lat_key", F.lit(4)).cast("string")),
            "burnable": F.pmod("lon_key", F.lit(2)) == 0,
            "landcover_key": F.concat(F.lit("L"), F.pmod("lon_key", F.lit(3)).cast("string")),
        }
    )


def _cells(t):
    c = t.predictions.select("country", "lat_key", "lon_key").distinct()
    return _strata(c).withColumn(
        "large_city_hard", F.pmod(F.col("lat_key") * 7 + F.col("lon_key"), F.lit(29)) == 0
    )


def _positives(t):
    fires = t.predictions.filter("is_fire = 1")
    return _strata(fires.select("country", "lat_key", "lon_key", "date").distinct())


_DAYS = f"""dy AS (SELECT CAST(x AS DATE) AS date FROM range(DATE '{START}', DATE '{END}'+1, INTERVAL 1 DAY) AS t(x)),
  dm AS (SELECT MONTH(date) AS m, list_sort(LIST(date)) AS days FROM dy GROUP BY 1)"""
_BLOCKED = """bl AS (SELECT DISTINCT country, lat_key+a AS lat_key, lon_key+b AS lon_key, date+d AS date FROM po,
    (VALUES (-1),(0),(1)) AS x(a), (VALUES (-1),(0),(1)) AS y(b), (VALUES (-1),(0),(1)) AS z(d))"""
_CD = "country, lat_key, lon_key, date"


def _near_sql(rounds):
    """Ring draws of all positives in their first rounds."""
    return f"""rg AS (SELECT ROW_NUMBER() OVER (ORDER BY a,b) - 1 AS j, a, b FROM range(-5,6) AS x(a), range(-5,6) AS y(b)
    WHERE GREATEST(ABS(a),ABS(b)) BETWEEN 2 AND 5),
  ni AS (SELECT {_CD}, i, 1680 AS n, {_hex(f"'42:near:'||{_KEY}")} AS k FROM po, range(0,{rounds}) AS r(i)),
  {permutation_sql("nv", "ni", _CD)},
  nm AS (SELECT country, lat_key+a AS lat_key, lon_key+b AS lon_key, date+CAST(v%15-7 AS INT) AS date, i AS r, GREATEST(ABS(a),ABS(b)) AS distance,
    ABS(v%15-7) AS gap_days FROM nv JOIN rg ON j = v//15),
  near AS (SELECT {_CD}, m.r AS r, m.d AS distance, m.g AS gap_days, md5('42:near:'||{_KEY}) AS h FROM (
    SELECT {_CD}, MIN({{'r': r, 'd': distance, 'g': gap_days}}) AS m FROM nm WHERE date BETWEEN DATE '{START}' AND DATE '{END}'
      AND (country, lat_key, lon_key) IN (SELECT (country, lat_key, lon_key) FROM ce) GROUP BY ALL))"""


def _city_sql(rounds):
    return f"""ci AS (SELECT country, lat_key, lon_key, i, (SELECT COUNT(*) FROM dy) AS n, {_hex("'42:city:'||country||':'||lat_key||':'||lon_key")} AS k
    FROM ce, range(0,{rounds}) AS r(i) WHERE city),
  {permutation_sql("cv", "ci", "country, lat_key, lon_key")},
  cm AS (SELECT country, lat_key, lon_key, DATE '{START}' + CAST(v AS INT) AS date, i AS r FROM cv WHERE i < n),
  city AS (SELECT *, md5('42:city:'||{_KEY}) AS h FROM cm)"""


#: stratum, short name, columns of the pool, whether months match
_STRATA_SQL = [
    ("same_season", "ss", ["country"], True),
    ("same_ecoregion", "se", ["country", "ecoregion_name"], True),
    ("same_burnable_landcover", "sl", ["country", "burnable", "landcover_key"], True),
    ("random_background", "rb", [], False),
]


def _matched_sql(stratum, tag, keys, month, rounds):
    """Draws of all groups in their first rounds; every positive's own pool has cells here."""
    name = f"42:{stratum}"
    pool = "||'|'||".join([f"'{len(keys)}'", *[f"CAST({k} AS VARCHAR)" for k in keys]])
    m, days = ("MONTH(date)", "len(dm.days)") if month else ("0", "(SELECT COUNT(*) FROM dy)")
    day = "dm.days[v % ds + 1]" if month else f"DATE '{START}' + CAST(v % ds AS INT)"
    return f"""{tag}_p AS (SELECT country, lat_key, lon_key, {pool} AS pool, ROW_NUMBER() OVER (PARTITION BY {pool}
    ORDER BY md5('{name}:pool:'||country||':'||lat_key||':'||lon_key)) - 1 AS cell, COUNT(*) OVER (PARTITION BY {pool}) AS sz FROM ce),
  {tag}_g AS (SELECT {pool} AS pool, {m} AS mo, COUNT(*) AS c FROM po GROUP BY ALL),
  {tag}_n AS (SELECT g.pool, g.mo, c, {days} AS ds, p.sz * {days} AS n, {_hex(f"'{name}:perm:'||g.pool||':'||g.mo")} AS k
    FROM {tag}_g g JOIN {tag}_p p ON p.pool=g.pool AND p.cell=0 LEFT JOIN dm ON dm.m=g.mo),
  {tag}_i AS (SELECT pool, mo, c, ds, n, k, UNNEST(range(0, LEAST(n, c*{rounds}))) AS i FROM {tag}_n),
  {permutation_sql(f"{tag}_v", f"{tag}_i", "pool, mo, c, ds")},
  {tag}_o AS (SELECT p.country, p.lat_key, p.lon_key, {day} AS date, MIN(i // c) AS r FROM {tag}_v v
    JOIN {tag}_p p ON p.pool=v.pool AND p.cell=v.v//ds LEFT JOIN dm ON dm.m=v.mo GROUP BY ALL),
  {tag} AS (SELECT *, md5('{name}:order:'||{_KEY}) AS h FROM {tag}_o)"""


_QUOTAS = """n AS (SELECT CAST(CEIL(ROUND(COUNT(*)*{odds},9)) AS BIGINT) AS t FROM po),
  w AS (SELECT * FROM (VALUES ('near_fire_hard',0,0.25E0),('large_city_hard',1,0.10E0),('same_season',2,0.20E0),('same_ecoregion',3,0.20E0),
    ('same_burnable_landcover',4,0.20E0),('random_background',5,0.05E0)) AS v(stratum,p,w)),
  f AS (SELECT stratum, t, p, w, FLOOR(t*w) AS fl, ROUND(t*w-FLOOR(t*w),9) AS fr FROM n, w),
  rq AS (SELECT *, ROW_NUMBER() OVER (ORDER BY fr DESC, w DESC, p) AS k, t-SUM(fl) OVER () AS left_over FROM f),
  q AS (SELECT stratum, p, t, CAST(fl+CASE WHEN k<=left_over THEN 1 ELSE 0 END AS BIGINT) AS quota FROM rq)"""


def _first(source, tag, quota, closed, more=""):
    """The first free rows of a stratum in the order of its rounds."""
    return f"""{tag} AS (SELECT {_CD}{more}, rn FROM (SELECT *, ROW_NUMBER() OVER (ORDER BY r, h) AS rn FROM {source} s
    WHERE NOT EXISTS (FROM {closed} x WHERE x.country=s.country AND x.lat_key=s.lat_key AND x.lon_key=s.lon_key AND x.date=s.date)) WHERE rn <= {quota})"""


def _quota(stratum):
    return f"(SELECT quota FROM q WHERE stratum='{stratum}')"


def _quotas(t):
    return {r["stratum"]: r["quota"] for r in sampling.stratum_quotas(_positives(t)).collect()}


@query(
    "f4_candidate_cells", "country lat_key:i lon_key:i",
    """g AS (SELECT n_name AS country, a AS lat_key, b AS lon_key FROM polygons, range(503,521) AS ra(a), range(1001,1036) AS rb(b)
          WHERE ABS(b*0.1E0-cx)/hx + ABS(a*0.1E0-cy)/hy < 1)
       SELECT MIN(country) AS country, lat_key, lon_key FROM g GROUP BY 2,3""",
    "polygons",
)
def f4(t):
    return grids.candidate_cells(t.polygons, (50.3, 100.1, 52.0, 103.5), 0.1)


@query(
    "f5_static_strata", "country lat_key:i lon_key:i ecoregion_name burnable:b large_city_hard:b landcover_key",
    """ce AS (SELECT DISTINCT country, lat_key, lon_key, lat_key*0.1E0 AS la, lon_key*0.1E0 AS lo FROM predictions),
       e AS (SELECT ce.country, lat_key, lon_key, MIN(n_name) AS n FROM ce JOIN polygons ON ABS(lo-cx)/hx + ABS(la-cy)/hy < 1 GROUP BY 1,2,3),
       s AS (SELECT ce.*, n, v, src FROM ce LEFT JOIN e USING (country, lat_key, lon_key) LEFT JOIN raster ON r=lat_key-500 AND c=lon_key-990)
       SELECT country, lat_key, lon_key, COALESCE(n,'Unknown') AS ecoregion_name, COALESCE(v>=1000,TRUE) AS burnable,
         COALESCE(v>=1080,FALSE) AS large_city_hard,
         CONCAT_WS('|', COALESCE(CAST(CAST(FLOOR(v/50) AS BIGINT) AS VARCHAR),'missing'), COALESCE(CAST(src AS VARCHAR),'missing')) AS landcover_key FROM s""",
    "predictions polygons raster",
)
def f5(t):
    cells = t.predictions.select("country", "lat_key", "lon_key").distinct()
    layer = t.raster.select(
        (F.col("r") + 500).cast("long").alias("lat_key"), (F.col("c") + 990).cast("long").alias("lon_key"),
        F.col("v").alias("cover"), F.col("v").alias("population"),
        F.floor(F.col("v") / 50).alias("cover_class"), F.col("src").alias("wet"),
    )
    settings = StaticContext(
        require_land=False, cover_columns=("cover",), min_cover=1000.0, city_min_population=1080.0
    )
    return targets.cell_strata(
        cells, t.polygons, layer, settings, landcover=["cover_class", "wet"], attr="n_name"
    )


@query(
    "f6_near_event_negatives", CD + " distance:i gap_days:i",
    ",".join([BASE, _QUOTAS.format(odds="9.0E0"), _near_sql(40), _BLOCKED, _first("near", "fr", _quota("near_fire_hard"), "bl", ", distance, gap_days")])
    + f" SELECT {_CD}, distance, gap_days FROM fr",
    "predictions",
)
def f6(t):
    pos = sampling.cut(_positives(t))
    return sampling.stratum_negatives("near_fire_hard", _quotas(t)["near_fire_hard"], pos, _cells(t), START, END, grids.blocked_keys(pos))


@query(
    "f7_city_negatives", CD,
    ",".join([BASE, _DAYS, _QUOTAS.format(odds="9.0E0"), _city_sql(2557), _BLOCKED, _first("city", "fr", _quota("large_city_hard"), "bl")])
    + f" SELECT {_CD} FROM fr",
    "predictions",
)
def f7(t):
    pos = sampling.cut(_positives(t))
    return sampling.stratum_negatives("large_city_hard", _quotas(t)["large_city_hard"], pos, _cells(t), START, END, grids.blocked_keys(pos))


@query(
    "f8_matched_negatives", "stratum " + CD,
    ",".join([BASE, _DAYS, _QUOTAS.format(odds="9.0E0"), _BLOCKED, *[_matched_sql(*row, 24) for row in _STRATA_SQL],
              *[_first(tag, f"{tag}_f", _quota(name), "bl") for name, tag, *_ in _STRATA_SQL]])
    + " " + " UNION ALL ".join(f"SELECT '{name}' AS stratum, {_CD} FROM {tag}_f" for name, tag, *_ in _STRATA_SQL),
    "predictions",
)
def f8(t):
    pos, cells, quotas = sampling.cut(_positives(t)), _cells(t), _quotas(t)
    pool = None
    for name, *_ in _STRATA_SQL:
        c = sampling.stratum_negatives(name, quotas[name], pos, cells, START, END, grids.blocked_keys(pos)).withColumn("stratum", F.lit(name))
        pool = c if pool is None else pool.unionByName(c)
    return pool


@query(
    "f9_stratum_quotas", "stratum target:i quota:i",
    ",".join([BASE, _QUOTAS.format(odds="9.0E0")]) + " SELECT stratum, t AS target, quota FROM q",
    "predictions",
)
def f9_quotas(t):
    return sampling.stratum_quotas(_positives(t))


def _f9_sql():
    """Stratum after stratum; each leaves out what is buffered or taken before."""
    none = ", CAST(NULL AS DOUBLE) AS distance, CAST(NULL AS DOUBLE) AS gap_days"
    parts = [BASE, _DAYS, _QUOTAS.format(odds="4.0E0"), _BLOCKED, _near_sql(40), _city_sql(2557), *[_matched_sql(*row, 48) for row in _STRATA_SQL]]
    closed, held = "bl", []
    for i, (name, source) in enumerate([("near_fire_hard", "near"), ("large_city_hard", "city"), *[(n, t) for n, t, *_ in _STRATA_SQL]]):
        quota = _quota(name)
        if name == "random_background":
            quota = "(SELECT t FROM n) - " + " - ".join(f"(SELECT COUNT(*) FROM {tag})" for tag in held)
        parts.append(_first(source, f"t{i}", quota, closed, ", distance, gap_days" if i == 0 else none))
        parts.append(f"x{i} AS (SELECT {_CD} FROM {closed} UNION ALL SELECT {_CD} FROM t{i})")
        closed = f"x{i}"
        held.append(f"t{i}")
    rows = " UNION ALL ".join(f"SELECT {i} AS p, * FROM {tag}" for i, tag in enumerate(held))
    short = "(SELECT t FROM n) - " + " - ".join(f"(SELECT COUNT(*) FROM {tag})" for tag in held[:-1]) + " - quota"
    return ",".join(parts) + f""", al AS ({rows}), nc AS (SELECT COUNT(*) AS al, COUNT(*) FILTER (city) AS ci FROM ce),
  ch AS (SELECT al.*, stratum, LEAST((CASE WHEN p=5 AND rn>quota THEN {short} ELSE quota END) / ((CASE WHEN p=1 THEN ci ELSE nc.al END)*2557.0E0), 1) AS c
    FROM al JOIN q USING (p), nc)
  SELECT {_CD}, stratum, distance, gap_days, c AS sampling_probability, 1/c AS sample_weight FROM ch"""


@query(
    "f9_stratified_negatives",
    CD + " stratum distance:d1 gap_days:d1 sampling_probability:d9 sample_weight:d5",
    _f9_sql(), "predictions",
)
def f9(t):
    out = sampling.stratified_negatives(_positives(t), _cells(t), START, END, positive_fraction=0.2)
    return out.withColumnsRenamed(
        {"nearest_positive_distance_cells": "distance", "nearest_positive_delta_days": "gap_days"}
    )


@query(
    "f10_area_negatives", "country rows:i blocked:i",
    # the number is fixed by polygon area and time; no drawn row may be buffered
    """SELECT n_name AS country, ROUND(2*hx*hy*POWER(PI()*6371.0E0/180,2)*COS(RADIANS(cy))/10*0.2E0*(1095/365.25E0),0) AS rows, 0 AS blocked FROM polygons""",
    "polygons",
)
def f10(t):
    pos = t.predictions.filter("is_fire = 1").withColumn(
        "country", F.concat(F.lit("NATION_"), F.pmod("lat_key", F.lit(25)).cast("string"))
    )
    out = sampling.area_negatives(t.polygons, pos, 0.2, *PERIOD)
    bad = grids.blocked_keys(pos).withColumn("_bad", F.lit(1))
    return out.join(bad, list(sampling.CELL_DAY), "left").groupBy("country").agg(
        F.count(F.lit(1)).alias("rows"), F.count("_bad").alias("blocked")
    )


@query("f11_target_job", "country stratum month:i rows:i positives:i soft:d4 history:i")
def f11(t):
    target = targets.build_target(t.detections, _cells(t), *PERIOD)
    return target.groupBy("country", "negative_stratum", F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("count").alias("positives"),
        F.sum("soft_label").alias("soft"), F.sum("past_event_count_r1_30_365d").alias("history"),
    ).withColumnRenamed("negative_stratum", "stratum")


_HASHED = """hs AS (SELECT *, date_trunc('month',date) AS mo, md5('42:'||row_id) AS h FROM predictions)"""


@query(
    "f12_weighted_sample", "row_id is_fire:i eval_weight:d9",
    _HASHED + """, ng AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, mo ORDER BY h) AS k, COUNT(*) OVER (PARTITION BY country, mo) AS n
        FROM hs WHERE is_fire=0)
      SELECT row_id, is_fire, n/LEAST(GREATEST(round_even(n*0.1E0,0),1),n) AS eval_weight FROM ng WHERE k <= GREATEST(round_even(n*0.1E0,0),1)
      UNION ALL SELECT row_id, is_fire, 1 FROM hs WHERE is_fire=1""",
    "predictions",
)
def f12(t):
    p = t.predictions.withColumn("mo", F.trunc("date", "month"))
    return sampling.weighted_sample(p, 0.1, ["country", "mo"], ["row_id"])


@query(
    "f12_plain_fraction", "row_id is_fire:i eval_weight:d9",
    _HASHED + """, ng AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY country, mo ORDER BY h) AS k, COUNT(*) OVER (PARTITION BY country, mo) AS n FROM hs)
      SELECT row_id, is_fire, n/GREATEST(round_even(n*0.05E0,0),1) AS eval_weight FROM ng WHERE k <= GREATEST(round_even(n*0.05E0,0),1)""",
    "predictions",
)
def f12_plain(t):
    p = t.predictions.withColumn("mo", F.trunc("date", "month"))
    return sampling.weighted_sample(p, 0.05, ["country", "mo"], ["row_id"], keep_positives=False)


@query(
    "f12_lazy_sample", "country month:t rows:i positives:i weight:d4",
    """ce AS (SELECT country, COUNT(*) AS c FROM (SELECT DISTINCT country, lat_key, lon_key FROM predictions) GROUP BY 1),
       mo AS (SELECT CAST(x AS DATE) AS month FROM range(DATE '1997-01-01', DATE '2000-01-01', INTERVAL 1 MONTH) AS t(x)),
       ps AS (SELECT country, date_trunc('month',date) AS month, COUNT(*) AS p FROM (SELECT DISTINCT country, lat_key, lon_key, date FROM predictions
          WHERE is_fire=1) GROUP BY 1,2),
       s AS (SELECT country, mo.month, c*DAY(LAST_DAY(mo.month)) AS n, COALESCE(p,0) AS p FROM ce CROSS JOIN mo LEFT JOIN ps USING (country, month))
       SELECT country, month, round_even((n-p)*0.05E0,0)+p AS rows, p AS positives, n AS weight FROM s""",
    "predictions",
)
def f12_lazy(t):
    out = sampling.lazy_sample(_cells(t), t.predictions.filter("is_fire = 1"), *PERIOD, 0.05)
    return out.groupBy("country", F.trunc("date", "month").alias("month")).agg(
        F.count(F.lit(1)).alias("rows"), F.sum("is_fire").alias("positives"),
        F.sum("eval_weight").alias("weight"),
    )


@query(
    "f13_deployment_grid", "country month:i cell_days:i events:i weight:d3",
    """kd AS (SELECT country, CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
         CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key, acq_date, detection_id FROM detections),
       cd AS (SELECT lat_key, lon_key, acq_date, COUNT(*) AS n FROM kd GROUP BY 1,2,3),
       ex AS (SELECT DISTINCT lat_key+a AS lat_key, lon_key+b AS lon_key, acq_date AS date FROM cd,
         (VALUES (0,0,0),(1,1,0),(2,-1,0),(3,0,1),(4,0,-1)) AS o(k,a,b) WHERE k < n),
       g AS (SELECT n_name AS country, a AS lat_key, b AS lon_key FROM polygons, range(500,524) AS ra(a), range(1000,1039) AS rb(b)
          WHERE ABS(b*0.1E0-cx)/hx + ABS(a*0.1E0-cy)/hy < 1),
       u AS (SELECT MIN(country) AS country, lat_key, lon_key FROM g GROUP BY 2,3),
       d AS (SELECT CAST(x AS DATE) AS date FROM range(DATE '1998-01-01', DATE '1998-07-01', INTERVAL 1 DAY) AS t(x))
       SELECT country, MONTH(d.date) AS month, COUNT(*) AS cell_days, COUNT(ex.date) AS events, COUNT(*) AS weight
       FROM u CROSS JOIN d LEFT JOIN ex ON ex.lat_key=u.lat_key AND ex.lon_key=u.lon_key AND ex.date=d.date GROUP BY 1,2""",
    "detections polygons",
)
def f13(t):
    grid = targets.deployment_grid(
        t.polygons, t.detections, "1998-01-01", "1998-06-30", (50.0, 100.0, 52.3, 103.8)
    )
    return grid.groupBy("country", F.month("date").alias("month")).agg(
        F.count(F.lit(1)).alias("cell_days"), F.sum("is_fire").alias("events"),
        F.sum("eval_weight").alias("weight"),
    )


@query(
    "f14_sampled_days", "row_id eval_weight:d6",
    """d AS (SELECT DISTINCT date, date_trunc('month',date) AS m FROM predictions),
       i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m ORDER BY date)-1 AS i, COUNT(*) OVER (PARTITION BY m) AS n FROM d),
       k AS (SELECT * FROM i WHERE n<=4 OR i IN (0, round_even((n-1)/3.0E0,0), round_even(2*(n-1)/3.0E0,0), n-1)),
       f AS (SELECT date, n/COUNT(*) OVER (PARTITION BY m) AS f FROM k)
       SELECT row_id, eval_weight*f AS eval_weight FROM predictions JOIN f USING (date)""",
    "predictions",
)
def f14(t):
    return sampling.sample_days(t.predictions, 4)


@query(
    "f15_split_by_dates", "row_id split code:i",
    f"SELECT row_id, {SPLIT} AS split, CASE {SPLIT} WHEN 'train' THEN 0 WHEN 'validation' THEN 1 ELSE 2 END AS code FROM predictions",
    "predictions",
)
def f15(t):
    s = sampling.split_by_dates(t.predictions, "1998-01-01", "2000-01-01")
    return s.withColumn("code", sampling.split_code())


@query(
    "f15_split_by_fraction", "row_id split",
    """r AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY date, md5('0:'||row_id)) AS k, COUNT(*) OVER () AS n FROM predictions),
       s AS (SELECT *, CEIL(n*0.2E0) AS nt, CEIL((n-CEIL(n*0.2E0))*0.1E0) AS nv FROM r)
       SELECT row_id, CASE WHEN k > n-nt THEN 'test' WHEN k > n-nt-nv THEN 'validation' ELSE 'train' END AS split FROM s""",
    "predictions",
)
def f15_fraction(t):
    return sampling.split_by_fraction(t.predictions, 0.2, 0.1, "row_id")


@query(
    "f15_split_by_years", "row_id split",
    """SELECT row_id, CASE WHEN YEAR(date) BETWEEN 1996 AND 1998 THEN 'train' WHEN YEAR(date)=1999 THEN 'validation'
       WHEN YEAR(date)=2000 THEN 'test' END AS split FROM predictions""",
    "predictions",
)
def f15_years(t):
    return sampling.split_by_years(
        t.predictions, {"train": (1996, 1998), "validation": (1999, 1999), "test": (2000, 2000)}
    )


@query(
    "f16_stratified_rows", "row_id is_fire:i",
    """c AS (SELECT is_fire, COUNT(*) AS c FROM predictions GROUP BY 1),
       r AS (SELECT is_fire, ROUND(c*5000.0E0/SUM(c) OVER (),9) AS raw FROM c),
       q AS (SELECT is_fire, FLOOR(raw) + CASE WHEN ROW_NUMBER() OVER (ORDER BY raw-FLOOR(raw) DESC, is_fire) <= 5000-SUM(FLOOR(raw)) OVER () THEN 1 ELSE 0 END AS q FROM r),
       h AS (SELECT row_id, is_fire, ROW_NUMBER() OVER (PARTITION BY is_fire ORDER BY md5('42:'||row_id)) AS k FROM predictions)
       SELECT row_id, is_fire FROM h JOIN q USING (is_fire) WHERE k<=q""",
    "predictions",
)
def f16(t):
    return sampling.stratified_rows(t.predictions, 5000, "row_id")


@query(
    "f16_negative_ratio", "row_id is_fire:i",
    """h AS (SELECT row_id, is_fire, ROW_NUMBER() OVER (PARTITION BY is_fire ORDER BY md5('42:'||row_id)) AS k FROM predictions),
       n AS (SELECT FLOOR(SUM(is_fire)*0.5E0) AS n FROM predictions)
       SELECT row_id, is_fire FROM h, n WHERE is_fire=1 OR k<=n""",
    "predictions",
)
def f16_ratio(t):
    return sampling.negative_ratio_rows(t.predictions, 0.5, "row_id")


@query(
    "f16_row_fraction", "row_id",
    """h AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY md5('42:'||row_id)) AS k, COUNT(*) OVER () AS n FROM predictions)
       SELECT row_id FROM h WHERE k <= round_even(n*0.07E0,0)""",
    "predictions",
)
def f16_fraction(t):
    return sampling.fraction_rows(t.predictions, 0.07, "row_id")


@query("f17_bootstrap_error", "model_name average_precision_error:d6 roc_auc_error:d6")
def f17(t):
    return sampling.bootstrap_error(
        t.predictions, "row_id",
        lambda rows, g: ranking.ranking_from_prefix(ranking.ranked_once(rows, p="prob_raw", group=g), g),
        trials=10, group=["model_name"], p="prob_raw",
    )


@query(
    "f18_exclude_years", "row_id kind",
    """SELECT row_id, 'some' AS kind FROM predictions WHERE YEAR(date) NOT IN (1998, 2001) UNION ALL
       SELECT row_id, 'fallback' FROM predictions""",
    "predictions",
)
def f18(t):
    some = sampling.exclude_years(t.predictions, [1998, 2001]).withColumn("kind", F.lit("some"))
    every = sampling.exclude_years(t.predictions, range(1990, 2010)).withColumn("kind", F.lit("fallback"))
    return some.unionByName(every)


@query(
    "f19_training_weights", "row_id train_weight:d9 class_weight:d9",
    """b AS (SELECT row_id, is_fire, POWER(eval_weight,0.5E0) AS w FROM predictions),
       c AS (SELECT quantile_cont(w,0.9) AS cap FROM b), m AS (SELECT AVG(LEAST(w,cap)) AS m FROM b, c),
       n AS (SELECT is_fire, SUM(COUNT(*)) OVER ()/(COUNT(*) OVER ()*COUNT(*)) AS cw FROM predictions GROUP BY 1)
       SELECT row_id, LEAST(w,cap)/m AS train_weight, cw AS class_weight FROM b, c, m, n WHERE n.is_fire=b.is_fire""",
    "predictions",
)
def f19(t):
    w = sampling.training_weights(t.predictions, "eval_weight", 0.5, 0.9)
    return sampling.class_weights(w)


@query(
    "f20_soft_label_expansion", "row_id is_fire:i soft_weight:d9",
    """s AS (SELECT row_id, is_fire, CASE WHEN lat_key%3=0 THEN 0.0E0 ELSE prob_raw END AS s FROM predictions)
       SELECT row_id, is_fire, CASE WHEN is_fire=0 AND s>0 THEN 1-s ELSE 1 END AS soft_weight FROM s UNION ALL
       SELECT row_id, 1, s FROM s WHERE is_fire=0 AND s>0""",
    "predictions",
)
def f20(t):
    soft = F.when(F.pmod("lat_key", F.lit(3)) == 0, 0.0).otherwise(F.col("prob_raw"))
    return sampling.expand_soft_labels(t.predictions.withColumn("soft_label", soft))
