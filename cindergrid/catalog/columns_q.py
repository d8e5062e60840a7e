"""Queries of projections, filters and detection jobs."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.functions import calendar, cells, labels, names, probability
from cindergrid.operators import columns, detections, regions

T = labels.DetectionThresholds(brightness=380, confidence=85, brightness_high_lat=360,
                               confidence_high_lat=70)
# cell-day grouping shared by several statements
KEYED = """kd AS (SELECT *, CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
   CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key FROM detections)"""
CELL_DAYS = KEYED + """, cd AS (SELECT lat_key, lon_key, acq_date, ARG_MIN(country, detection_id) AS country,
   AVG(brightness) AS brightness, AVG(confidence) AS confidence, COUNT(*) AS count
   FROM kd GROUP BY 1,2,3)"""
EXPANDED = CELL_DAYS + """, ex AS (SELECT cd.country, cd.lat_key+a AS lat_key, cd.lon_key+b AS lon_key,
   acq_date FROM cd, (VALUES (0,0,0),(1,1,0),(2,-1,0),(3,0,1),(4,0,-1)) AS o(k,a,b) WHERE k < count)"""


@query(
    "b1_confidence_scale", "country max_confidence:d3 scale threshold:d3",
    """SELECT country, MAX(confidence) AS max_confidence,
       CASE WHEN quantile_cont(confidence,0.95)>1 OR MAX(confidence)>1 THEN 'percent_0_100'
         ELSE 'fraction_0_1' END AS scale,
       CASE WHEN MAX(confidence)>1 THEN 85.0E0 ELSE 0.85E0 END AS threshold
       FROM detections GROUP BY 1""",
    "detections",
)
def b1(t):
    return labels.confidence_scale(t.detections, "confidence", 0.85, ["country"])


@query(
    "b2_detection_filter", "detection_id latitude:d6 longitude:d6 brightness:d3 confidence:d3",
    """d AS (SELECT detection_id, latitude+7 AS latitude, longitude-56 AS longitude, brightness, confidence
             FROM detections)
       SELECT * FROM d WHERE (NOT ABS(latitude)>58 AND brightness>380 AND confidence>85)
        OR (ABS(latitude)>58 AND brightness>360 AND confidence>70)
        OR (latitude>58 AND longitude<45 AND brightness>330 AND confidence>55)""",
    "detections",
)
def b2(t):
    moved = t.detections.withColumns(
        {"latitude": F.col("latitude") + 7, "longitude": F.col("longitude") - 56}
    )
    return moved.filter(labels.detection_filter(T))


@query(
    "b3_grid_snapping", "detection_id lat_key:i lon_key:i lat_rounded:d6 lon_rounded:d6",
    KEYED + """SELECT detection_id, lat_key, lon_key, lat_key*0.1E0 AS lat_rounded,
      lon_key*0.1E0 AS lon_rounded FROM kd""",
    "detections",
)
def b3(t):
    return cells.with_cell_keys(t.detections)


@query(
    "b4_box_filter", "detection_id latitude:d6 longitude:d6",
    """SELECT detection_id, latitude, longitude FROM detections WHERE latitude BETWEEN 50.4E0-1e-7
       AND 51.2E0+1e-7 AND longitude BETWEEN 100.5E0-1e-7 AND 101.9E0+1e-7""",
    "detections",
)
def b4(t):
    return t.detections.filter(
        cells.in_box("latitude", "longitude", (50.4, 100.5, 51.2, 101.9), 0.1 * 1e-6)
    )


@query(
    "b5_date_parts", "detection_id day:i month:i year:i shifted_valid:b",
    """SELECT detection_id, DAY(acq_date) AS day, MONTH(acq_date) AS month, YEAR(acq_date) AS year,
       DAY(acq_date)+2 <= DAY(LAST_DAY(acq_date)) AS shifted_valid FROM detections""",
    "detections",
)
def b5(t):
    parts = t.detections.withColumns(calendar.date_parts("acq_date"))
    return parts.withColumn("_d", F.col("day") + 2).withColumn(
        "shifted_valid", calendar.valid_date(day="_d")
    )


@query(
    "b6_calendar_features",
    "detection_id is_weekend_today:i is_weekend_yesterday:i is_weekend_today_or_yesterday:i "
    "is_holiday_today:i is_holiday_yesterday:i is_holiday_today_or_yesterday:i",
    """h AS (SELECT * FROM (VALUES ('r',101),('r',102),('r',103),('r',104),('r',105),('r',106),('r',107),
        ('r',108),('r',223),('r',308),('r',501),('r',509),('r',612),('r',1104),('s',101),('s',107),
        ('s',308),('s',501),('s',509),('c',101),('c',501),('c',1225)) AS v(k,md)),
      d AS (SELECT detection_id, acq_date AS t, acq_date-1 AS y, CASE country WHEN 'C0' THEN 'r'
        WHEN 'C1' THEN 's' ELSE 'c' END AS k FROM detections),
      f AS (SELECT detection_id, CAST(ISODOW(t)>=6 AS INT) AS wt, CAST(ISODOW(y)>=6 AS INT) AS wy,
        CAST((k, MONTH(t)*100+DAY(t)) IN (SELECT (k,md) FROM h) AS INT) AS ht,
        CAST((k, MONTH(y)*100+DAY(y)) IN (SELECT (k,md) FROM h) AS INT) AS hy FROM d)
      SELECT detection_id, wt AS is_weekend_today, wy AS is_weekend_yesterday,
        GREATEST(wt,wy) AS is_weekend_today_or_yesterday, ht AS is_holiday_today,
        hy AS is_holiday_yesterday, GREATEST(ht,hy) AS is_holiday_today_or_yesterday FROM f""",
    "detections",
)
def b6(t):
    named = t.detections.withColumn(
        "country",
        F.when(F.col("country") == "C0", "Russian Federation")
        .when(F.col("country") == "C1", " Kazakhstan")
        .otherwise(F.col("country")),
    )
    return calendar.add_calendar_features(named, "acq_date")


_STATIC = labels.StaticContext(
    cover_columns=("cover_high", "cover_low"), min_cover=30.0, light_columns=("radiance",),
    max_light=1800.0, population_columns=("population",), max_population=48.0,
    city_min_population=40.0, city_light_columns=("radiance",), city_min_light=1900.0,
)
_STATIC_SQL = """st AS (SELECT p_partkey AS id, CAST(p_partkey*37 % 100 AS DOUBLE) AS landseamask,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 61 AS DOUBLE) END AS cover_high,
    CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE CAST(p_partkey % 53 AS DOUBLE) END AS cover_low,
    p_retailprice AS radiance, CAST(p_size AS DOUBLE) AS population FROM part),
  mk AS (SELECT *, landseamask < 70 AND COALESCE(GREATEST(cover_high,cover_low) >= 30, TRUE) AS burnable,
    COALESCE(radiance > 1800,FALSE) OR COALESCE(population > 48,FALSE) AS urban,
    (population >= 40 OR radiance >= 1900) AND landseamask < 70 AS city FROM st)"""


def _static(t):
    k = F.col("p_partkey")
    missing = F.pmod(k, F.lit(11)) == 0
    return t.table("part").select(
        k.alias("id"),
        F.pmod(k * 37, F.lit(100)).cast("double").alias("landseamask"),
        F.when(~missing, F.pmod(k, F.lit(61)).cast("double")).alias("cover_high"),
        F.when(~missing, F.pmod(k, F.lit(53)).cast("double")).alias("cover_low"),
        F.col("p_retailprice").alias("radiance"),
        F.col("p_size").cast("double").alias("population"),
    )


@query("b7_burnable_mask", "id:i burnable:b", _STATIC_SQL + "SELECT id, burnable FROM mk")
def b7(t):
    s = _static(t)
    return s.withColumn("burnable", labels.burnable_mask(s.columns, _STATIC))


@query("b8_urban_mask", "id:i urban:b", _STATIC_SQL + "SELECT id, urban FROM mk")
def b8(t):
    s = _static(t)
    return s.withColumn("urban", labels.urban_artifact_mask(s.columns, _STATIC))


@query("b9_large_city_mask", "id:i city:b", _STATIC_SQL + "SELECT id, city FROM mk")
def b9(t):
    s = _static(t)
    return s.withColumn("city", labels.large_city_mask(s.columns, _STATIC))


@query(
    "b10_label_filter_report",
    "input_rows:i removed_non_burnable:i removed_urban_artifact:i removed_total:i output_rows:i",
    _STATIC_SQL + """SELECT COUNT(*) AS input_rows, COUNT(*) FILTER (NOT burnable) AS removed_non_burnable,
      COUNT(*) FILTER (burnable AND urban) AS removed_urban_artifact,
      COUNT(*) FILTER (NOT burnable OR urban) AS removed_total,
      COUNT(*) FILTER (burnable AND NOT urban) AS output_rows FROM mk""",
)
def b10(t):
    return labels.label_filter_report(_static(t), _STATIC)


@query("b10_label_filter", "id:i", _STATIC_SQL + "SELECT id FROM mk WHERE burnable AND NOT urban")
def b10_rows(t):
    return labels.filter_labels(_static(t), _STATIC)


@query(
    "b11_boost_weight", "detection_id weight:i",
    """SELECT detection_id, GREATEST(1, CASE WHEN latitude BETWEEN 50.5E0 AND 51.0E0 THEN 3 END,
       CASE WHEN longitude >= 101.2E0 AND latitude <= 51.5E0 THEN 2 END,
       CASE WHEN latitude >= 51.7E0 THEN 5 END) AS weight FROM detections""",
    "detections",
)
def b11(t):
    boxes = [
        {"min_lat": 50.5, "max_lat": 51.0, "multiplier": 3},
        {"min_lon": 101.2, "max_lat": 51.5, "multiplier": 2},
        {"min_lat": 51.7, "multiplier": 5},
    ]
    return t.detections.withColumn("weight", labels.boost_weight("latitude", "longitude", boxes))


@query(
    "b12_soft_label", "row_id soft_label:d9",
    """SELECT row_id, CASE WHEN is_fire>0 THEN 1.0E0 WHEN lat_key%8<=5 AND lon_key%10<=7 THEN
       0.35E0*EXP(-GREATEST(lat_key%8-1,0)/2.0E0)*EXP(-GREATEST(lon_key%10,0)/7.0E0) ELSE 0 END
       AS soft_label FROM predictions""",
    "predictions",
)
def b12(t):
    p = t.predictions.withColumns(
        {"dist": F.pmod("lat_key", F.lit(8)), "delta": F.pmod("lon_key", F.lit(10))}
    )
    return p.withColumn("soft_label", labels.soft_label("is_fire", "dist", "delta"))


@query(
    "b13_sea_filter", "id:i landseamask:d3", _STATIC_SQL + "SELECT id, landseamask FROM st WHERE landseamask < 70"
)
def b13(t):
    return columns.drop_sea_rows(_static(t), 70)


@query(
    "b14_prior_shift", "row_id adjusted:d9 from_logit:d9",
    """SELECT row_id, 1/(1+EXP(-(LN(prob_raw/(1-prob_raw)) + LN(0.001E0/0.999E0) - LN(0.15E0/0.85E0)))) AS adjusted,
       1/(1+EXP(-((prob_raw*8-4) + LN(0.001E0/0.999E0) - LN(0.15E0/0.85E0)))) AS from_logit FROM predictions""",
    "predictions",
)
def b14(t):
    return t.predictions.withColumns(
        {
            "adjusted": probability.prior_shift("prob_raw", 0.15, 0.001),
            "from_logit": probability.prior_shift(F.col("prob_raw") * 8 - 4, 0.15, 0.001, True),
        }
    )


@query(
    "b15_probability_links", "row_id logit:d9 sigmoid:d9 event_probability:d9",
    """SELECT row_id, LN(prob_raw/(1-prob_raw)) AS logit, 1/(1+EXP(-(prob_raw*40-20))) AS sigmoid,
       1-EXP(-LEAST(GREATEST(eval_weight-5,0),50)) AS event_probability FROM predictions""",
    "predictions",
)
def b15(t):
    return t.predictions.withColumns(
        {
            "logit": probability.logit("prob_raw"),
            "sigmoid": probability.sigmoid(F.col("prob_raw") * 40 - 20),
            "event_probability": probability.intensity_to_probability(F.col("eval_weight") - 5),
        }
    )


@query(
    "b16_score_normalisation", "row_id minmax:d9 clipped:d9 raw_min:d6 raw_max:d6 raw_mean:d6",
    """s AS (SELECT MIN(eval_weight) AS lo, MAX(eval_weight) AS hi, AVG(eval_weight) AS me FROM predictions)
       SELECT row_id, (eval_weight-lo)/(hi-lo) AS minmax, LEAST(GREATEST(eval_weight/30-0.2E0,0),1) AS clipped,
       lo AS raw_min, hi AS raw_max, me AS raw_mean FROM predictions, s""",
    "predictions",
)
def b16(t):
    p = columns.minmax_scores(t.predictions, "eval_weight", "minmax")
    return p.withColumn("clipped", columns.clip_unit(F.col("eval_weight") / 30 - 0.2))


@query(
    "b17_coordinate_encodings",
    "detection_id lat_scaled:d9 lon_scaled:d9 lat_sin:d9 lat_cos:d9 lon_sin:d9 lon_cos:d9",
    """SELECT detection_id, latitude/90 AS lat_scaled, longitude/180 AS lon_scaled,
       SIN(RADIANS(latitude)) AS lat_sin, COS(RADIANS(latitude)) AS lat_cos,
       SIN(RADIANS(longitude)) AS lon_sin, COS(RADIANS(longitude)) AS lon_cos FROM detections""",
    "detections",
)
def b17(t):
    return t.detections.withColumns(cells.coordinate_encodings("latitude", "longitude"))


@query(
    "b18_season_region", "row_id season region",
    """m AS (SELECT row_id, r_name, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY r_regionkey) AS k
         FROM predictions JOIN regions ON lat_key BETWEEN lat_min AND lat_max
          AND lon_key BETWEEN lon_min AND lon_max)
       SELECT p.row_id, CASE WHEN MONTH(date) IN (12,1,2) THEN 'winter' WHEN MONTH(date) IN (3,4,5)
         THEN 'spring' WHEN MONTH(date) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season,
         COALESCE(r_name,'other') AS region
       FROM predictions p LEFT JOIN m ON m.row_id=p.row_id AND k=1""",
    "predictions regions",
)
def b18(t):
    p = t.predictions.withColumn("season", calendar.season(F.month("date")))
    return regions.first_region(p, t.regions)


@query(
    "b19_cell_area", "detection_id area_kha:d9",
    """SELECT detection_id, 6371.0088E0*6371.0088E0*RADIANS(0.1E0)*(SIN(RADIANS(latitude)+RADIANS(0.05E0))
       - SIN(RADIANS(latitude)-RADIANS(0.05E0)))/10 AS area_kha FROM detections""",
    "detections",
)
def b19(t):
    return t.detections.withColumn("area_kha", cells.cell_area_kha("latitude"))


@query(
    "b20_lead_days", "row_id lead_hours_days:i lead_days:i",
    """SELECT row_id, CAST(round_even(lat_key*24/24.0E0,0) AS BIGINT) AS lead_hours_days,
       CAST(round_even(eval_weight/4,0) AS BIGINT) AS lead_days FROM predictions""",
    "predictions",
)
def b20(t):
    p = t.predictions.withColumns(
        {"lead_a": F.col("lat_key") * 24, "lead_b": F.col("eval_weight") / 4}
    )
    p = columns.lead_days(p, "lead_a", "lead_hours_days")
    return columns.lead_days(p, "lead_b", "lead_days")


@query(
    "b21_model_input_fill", "id:i landseamask:d6 cover_high:d6 cover_low:d6 slope:d6 soil:i ecoregion",
    _STATIC_SQL + """, a AS (SELECT AVG(cover_high) AS ch, AVG(cover_low) AS cl FROM st)
      SELECT id, landseamask, COALESCE(cover_high, ch) AS cover_high, COALESCE(cover_low, cl) AS cover_low,
       0.0 AS slope, CASE WHEN id%7=0 THEN 99 ELSE id%7 END AS soil,
       CASE WHEN id%5=0 THEN 'Unknown' ELSE CONCAT('E',CAST(id%5 AS VARCHAR)) END AS ecoregion FROM st, a""",
)
def b21(t):
    s = _static(t).withColumns(
        {
            "soil": F.nullif(F.pmod("id", F.lit(7)), F.lit(0)),
            "ecoregion": F.when(
                F.pmod("id", F.lit(5)) != 0, F.concat(F.lit("E"), F.pmod("id", F.lit(5)))
            ),
        }
    )
    return columns.fill_model_inputs(
        s, numeric=["landseamask", "cover_high", "cover_low", "slope"],
        string_categories=["ecoregion"], numeric_categories=["soil"],
    )


@query(
    "b22_category_normalisation", "id:i soil:i ecoregion population:d3",
    """SELECT p_partkey AS id, p_partkey%7 AS soil, CASE WHEN p_partkey%5=0 THEN 'missing' ELSE
       CONCAT('E',CAST(p_partkey%5 AS VARCHAR)) END AS ecoregion,
       CASE WHEN p_size%4=0 THEN 0 ELSE p_size END AS population FROM part""",
)
def b22(t):
    s = _static(t).withColumns(
        {
            "soil": F.nullif(F.pmod("id", F.lit(7)), F.lit(0)),
            "ecoregion": F.when(
                F.pmod("id", F.lit(5)) != 0, F.concat(F.lit("E"), F.pmod("id", F.lit(5)))
            ),
            "population": F.when(F.col("population") % 4 != 0, F.col("population")),
        }
    )
    return columns.normalise_categories(s, ["soil"], ["ecoregion"], ["population"])


@query(
    "b23_column_selection", "country brightness:d3 kept:i dropped:i missing:i",
    """SELECT country, brightness, 2 AS kept, 5 AS dropped, 1 AS missing FROM detections""",
    "detections",
)
def b23(t):
    chosen, report = columns.select_columns(
        t.detections,
        keep=["country", "brightness", "confidence", "latitude", "longitude", "acq_date",
              "detection_id", "ghost"],
        exact=["confidence"], prefixes=["lat", "lon"], ignored=["detection_id"],
    )
    counts = report.agg(
        F.struct(
            F.count_if(F.col("status") == "kept").alias("kept"),
            F.count_if(F.col("status").startswith("dropped")).alias("dropped"),
            F.count_if(F.col("status") == "missing").alias("missing"),
        )
    ).scalar()
    return chosen.withColumn("_r", counts).select("*", "_r.*")


def _feature_names(t):
    """Feature names derived from the part names, brands and sizes."""
    p = t.table("part")
    stem = F.element_at(
        F.array(*[F.lit(s) for s in _STEMS]), (F.pmod("p_partkey", F.lit(len(_STEMS))) + 1).cast("int")
    )
    return p.select(F.concat_ws("_", stem, F.col("p_size").cast("string")).alias("feature")).distinct()


_STEMS = [
    "t2m_mean", "tp_sum", "fire_index_fwi", "road_density_gaussian", "ecoregion_name", "elevation",
    "lat", "past_fire_count_r1", "dayofyear_sin", "landseamask", "population", "night_light", "soil_type",
]
_NAMES_SQL = f"""fn AS (SELECT DISTINCT CONCAT({_STEMS!r}[CAST(p_partkey % {len(_STEMS)} AS INT)+1], '_',
    CAST(p_size AS VARCHAR)) AS feature FROM part),
  ct AS (SELECT feature, regexp_extract(feature, '^(.*)_[0-9]+$', 1) AS stem,
    CAST(regexp_extract(feature, '_([0-9]+)$', 1) AS INT) AS wd FROM fn),
  gr AS (SELECT ct.*, sg, mg FROM ct JOIN (VALUES
    ('t2m_mean','weather_history','climate_t2m'),('tp_sum','weather_history','climate_tp'),
    ('fire_index_fwi','fire_weather_fwi','fire_index'),('road_density_gaussian','anthropogenic','infrastructure'),
    ('ecoregion_name','vegetation_fuel_ecoregion','ecoregion'),('elevation','terrain_topography','geospatial'),
    ('lat','other','geospatial'),('past_fire_count_r1','historical_fire_context','past'),
    ('dayofyear_sin','seasonality','time'),('landseamask','coast_landmask','land_static'),
    ('population','anthropogenic','geospatial'),('night_light','anthropogenic','night_lights'),
    ('soil_type','vegetation_fuel_ecoregion','land_static')) AS v(stem,sg,mg) USING (stem))"""


@query(
    "b24_feature_catalogue", "feature study_group model_group window_days:i",
    _NAMES_SQL + "SELECT feature, sg AS study_group, mg AS model_group, wd AS window_days FROM gr",
)
def b24(t):
    return names.feature_catalogue(_feature_names(t))


@query(
    "b24_ablation_sets", "feature_set features:i",
    _NAMES_SQL + """, s AS (SELECT feature, UNNEST(list_filter([
      'full', CASE WHEN sg='weather_history' THEN 'weather_only' END,
      CASE WHEN sg='fire_weather_fwi' THEN 'fwi_only' END,
      CASE WHEN sg<>'anthropogenic' THEN 'no_anthropogenic' END,
      CASE WHEN stem<>'ecoregion_name' THEN 'no_ecoregion' END,
      CASE WHEN stem NOT IN ('lat','landseamask') THEN 'no_geography' END,
      CASE WHEN sg<>'vegetation_fuel_ecoregion' THEN 'no_fuel_ecoregion_vegetation' END,
      CASE WHEN sg<>'terrain_topography' THEN 'no_terrain' END,
      CASE WHEN sg<>'seasonality' THEN 'no_seasonality' END,
      CASE WHEN sg<>'historical_fire_context' THEN 'no_history' END,
      CASE WHEN sg<>'weather_history' THEN 'no_temporal_history' END,
      CASE WHEN NOT (sg='weather_history' AND wd>30) THEN 'shorter_sequence_30d' END,
      CASE WHEN stem<>'dayofyear_sin' THEN 'no_periodic_seasonality' END,
      CASE WHEN stem<>'road_density_gaussian' THEN 'no_gaussian_smoothing' END,
      CASE WHEN sg NOT IN ('weather_history','fire_weather_fwi') THEN 'static_only' END,
      CASE WHEN sg IN ('weather_history','fire_weather_fwi') THEN 'dynamic_weather_fwi_only' END],
      lambda x: x IS NOT NULL)) AS feature_set FROM gr)
      SELECT feature_set, COUNT(*) AS features FROM s GROUP BY 1""",
)
def b24_sets(t):
    sets = names.ablation_sets(names.feature_catalogue(_feature_names(t)))
    return sets.groupBy("feature_set").agg(F.count(F.lit(1)).alias("features"))


@query(
    "b24_lead_subset", "feature",
    _NAMES_SQL + "SELECT feature FROM gr WHERE sg<>'weather_history' OR feature LIKE '%\\_7%' ESCAPE '\\'",
)
def b24_lead(t):
    return names.lead_limited(names.feature_catalogue(_feature_names(t)), 7)


@query(
    "b27_presentation", "region year:i rows:i share:d3",
    """r AS (SELECT country AS region, YEAR(date) AS year, COUNT(*) AS rows, AVG(prob_raw) AS share
        FROM predictions GROUP BY 1,2)
       SELECT region, year, rows, ROUND(share,3) AS share FROM r WHERE year IS NOT NULL
       ORDER BY share DESC, region, year LIMIT 12""",
    "predictions",
)
def b27(t):
    table = t.predictions.groupBy(F.col("country").alias("area"), F.year("date").alias("year")).agg(
        F.count(F.lit(1)).alias("rows"), F.avg("prob_raw").alias("mean_probability")
    )
    return columns.present(
        columns.annual_rows(table),
        rename={"area": "region", "year": "year", "rows": "rows", "mean_probability": "share"},
        digits={"share": 3}, order=[("share", False), ("region", True), ("year", True)], limit=12,
    )


@query(
    "b28_country_alias", "n_nationkey:i polygon_name display_name",
    """SELECT n_nationkey, CASE n_nationkey%4 WHEN 0 THEN 'Russia' WHEN 1 THEN 'South Korea'
       WHEN 2 THEN 'Republic of Serbia' ELSE n_name END AS polygon_name,
       CASE n_nationkey%4 WHEN 0 THEN 'Russian Federation' WHEN 1 THEN 'Republic of Korea'
       WHEN 2 THEN 'Serbia' ELSE REPLACE(n_name,'_',' ') END AS display_name FROM nation""",
)
def b28(t):
    file_name = (
        F.when(F.col("n_nationkey") % 4 == 0, "Russian_Federation")
        .when(F.col("n_nationkey") % 4 == 1, "Republic_of_Korea")
        .when(F.col("n_nationkey") % 4 == 2, "Serbia")
        .otherwise(F.col("n_name"))
    )
    return columns.with_country_names(t.table("nation").withColumn("country", file_name))


@query(
    "b29_input_ablation", "id:i cover_high:d3 cover_low:d3 population:d3",
    _STATIC_SQL + "SELECT id, 0.0 AS cover_high, 0.0 AS cover_low, population FROM st",
)
def b29(t):
    return columns.ablate_inputs(_static(t), prefixes=["cover_"])


@query(
    "c12_stationary_removals", "country input_rows:i removed_rows:i output_rows:i",
    """s AS (SELECT country, latitude, longitude FROM detections GROUP BY 1,2,3
        HAVING COUNT(DISTINCT date_trunc('month', acq_date)) >= 6)
       SELECT country, COUNT(*) AS input_rows, COUNT(*) FILTER ((country,latitude,longitude) IN
         (SELECT (country,latitude,longitude) FROM s)) AS removed_rows,
         COUNT(*) FILTER ((country,latitude,longitude) NOT IN (SELECT (country,latitude,longitude) FROM s))
         AS output_rows FROM detections GROUP BY 1""",
    "detections",
)
def c12(t):
    return detections.stationary_removals(
        t.detections, detections.stationary_catalogue(t.detections, 6)
    )


@query(
    "c12_drop_stationary", "detection_id",
    """s AS (SELECT country, latitude, longitude FROM detections GROUP BY 1,2,3
        HAVING COUNT(DISTINCT date_trunc('month', acq_date)) >= 6)
       SELECT detection_id FROM detections WHERE (country,latitude,longitude) NOT IN
        (SELECT (country,latitude,longitude) FROM s)""",
    "detections",
)
def c12_rows(t):
    return detections.drop_stationary(
        t.detections, detections.stationary_catalogue(t.detections, 6)
    )


@query(
    "c15_relabel", "row_id is_fire:i",
    """k AS (SELECT DISTINCT country, lat_key, lon_key, date FROM predictions
         WHERE is_fire=1 AND prob_raw>0.5E0)
       SELECT row_id, CASE WHEN (country,lat_key,lon_key,date) IN
        (SELECT (country,lat_key,lon_key,date) FROM k) THEN 1 ELSE 0 END AS is_fire FROM predictions""",
    "predictions",
)
def c15(t):
    return detections.relabel(t.predictions, t.predictions.filter("is_fire = 1 AND prob_raw > 0.5"))


@query(
    "d1_cell_days", "lat_key:i lon_key:i acq_date:t country brightness:d6 confidence:d6 count:i",
    CELL_DAYS + "SELECT * FROM cd", "detections",
)
def d1(t):
    return detections.cell_days(t.detections)


@query(
    "d3_expand_positives", "country lat_key:i lon_key:i acq_date:t copies:i",
    EXPANDED + "SELECT country, lat_key, lon_key, acq_date, COUNT(*) AS copies FROM ex GROUP BY 1,2,3,4",
    "detections",
)
def d3(t):
    ex = detections.expand_positives(detections.cell_days(t.detections))
    return ex.groupBy("country", *detections.KEY).agg(F.sum("count").alias("copies"))


@query(
    "d4_stationary_catalogue",
    "country latitude:d9 longitude:d9 unique_months:i first_month last_month months",
    """SELECT country, latitude, longitude, COUNT(DISTINCT strftime(acq_date,'%Y-%m')) AS unique_months,
       MIN(strftime(acq_date,'%Y-%m')) AS first_month, MAX(strftime(acq_date,'%Y-%m')) AS last_month,
       STRING_AGG(DISTINCT strftime(acq_date,'%Y-%m'), ';' ORDER BY strftime(acq_date,'%Y-%m')) AS months
       FROM detections GROUP BY 1,2,3 HAVING COUNT(DISTINCT strftime(acq_date,'%Y-%m')) >= 6""",
    "detections",
)
def d4(t):
    return detections.stationary_catalogue(t.detections, 6)


@query(
    "d5_positive_labels", "country lat_key:i lon_key:i acq_date:t is_fire:i",
    EXPANDED + "SELECT DISTINCT country, lat_key, lon_key, acq_date, 1 AS is_fire FROM ex", "detections",
)
def d5(t):
    return detections.positive_labels(t.detections)


@query(
    "d5_positive_key_counts", "country lat_key:i lon_key:i acq_date:t detections:i",
    KEYED + "SELECT country, lat_key, lon_key, acq_date, COUNT(*) AS detections FROM kd GROUP BY 1,2,3,4",
    "detections",
)
def d5_counts(t):
    return detections.positive_key_counts(t.detections)
