"""Queries of the aggregation and report tables."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.operators import detections, drift, grids, ranking, series, spatial, summaries

CAL = "p AS (SELECT *, prob_raw*0.4E0 AS prob_cal FROM predictions)"
P = dict(p="prob_raw")
MEMBERS = """rg AS (SELECT p.*, r_name AS region FROM predictions p JOIN regions
    ON lat_key BETWEEN lat_min AND lat_max AND lon_key BETWEEN lon_min AND lon_max)"""
SPLIT = """CASE WHEN date < DATE '1998-01-01' THEN 'train' WHEN date < DATE '2000-01-01' THEN 'validation'
    ELSE 'test' END"""


def with_split(df):
    return df.withColumn(
        "split",
        F.when(F.col("date") < "1998-01-01", "train")
        .when(F.col("date") < "2000-01-01", "validation").otherwise("test"),
    )


@query(
    "d2_binary_grid", "country lat_key:i lon_key:i date:t is_fire:i",
    """kd AS (SELECT CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
         CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key, acq_date FROM detections),
       f AS (SELECT DISTINCT lat_key, lon_key, acq_date FROM kd),
       g AS (SELECT n_name AS country, a AS lat_key, b AS lon_key FROM polygons, range(500,525) AS ra(a),
          range(1000,1040) AS rb(b) WHERE ABS(b*0.1E0-cx)/hx + ABS(a*0.1E0-cy)/hy < 1),
       u AS (SELECT MIN(country) AS country, lat_key, lon_key FROM g GROUP BY 2,3),
       d AS (SELECT CAST(x AS DATE) AS date FROM range(DATE '1998-06-01', DATE '1998-07-31', INTERVAL 1 DAY) AS t(x))
       SELECT u.country, u.lat_key, u.lon_key, d.date, CASE WHEN f.acq_date IS NULL THEN 0 ELSE 1 END AS is_fire
       FROM u CROSS JOIN d LEFT JOIN f ON f.lat_key=u.lat_key AND f.lon_key=u.lon_key AND f.acq_date=d.date""",
    "detections polygons",
)
def d2(t):
    cells = grids.candidate_cells(t.polygons, (50.0, 100.0, 52.4, 103.9), 0.1)
    keys = detections.positive_key_counts(t.detections).withColumnRenamed("acq_date", "date")
    return grids.label_grid(
        grids.cell_dates(cells, date(1998, 6, 1), date(1998, 7, 30)),
        keys, on=("lat_key", "lon_key", "date"),
    )


@query(
    "d6_monthly_climatology",
    "lat_key:i lon_key:i month:i mean:d6 std:d6 min:d3 max:d3 median:d6",
    """SELECT lat_key, lon_key, MONTH(date) AS month, AVG(v) AS mean, STDDEV_POP(v) AS std, MIN(v) AS min,
       MAX(v) AS max, MEDIAN(v) AS median FROM cube GROUP BY 1,2,3""",
    "cube",
)
def d6(t):
    return series.monthly_climatology(t.cube)


@query(
    "d7_monthly_trends",
    "lat_key:i lon_key:i month:i years:i mean_slope:d6 max_slope:d6 median_slope:d6",
    """m AS (SELECT lat_key, lon_key, YEAR(date) AS year, MONTH(date) AS month, AVG(v) AS a, MAX(v) AS x,
         MEDIAN(v) AS d FROM cube GROUP BY 1,2,3,4)
       SELECT lat_key, lon_key, month, COUNT(*) AS years,
        CASE WHEN COUNT(*)>1 THEN REGR_SLOPE(a, year+(month-1)/12.0E0) END AS mean_slope,
        CASE WHEN COUNT(*)>1 THEN REGR_SLOPE(x, year+(month-1)/12.0E0) END AS max_slope,
        CASE WHEN COUNT(*)>1 THEN REGR_SLOPE(d, year+(month-1)/12.0E0) END AS median_slope
       FROM m GROUP BY 1,2,3""",
    "cube",
)
def d7(t):
    return series.monthly_trends(t.cube)


@query(
    "d8_feature_quality", "feature mean:d6 std:d6 null_share:d9 issue",
    """x AS (SELECT brightness AS a, CASE WHEN confidence<60 THEN NULL ELSE confidence END AS b,
         CAST(NULL AS DOUBLE) AS c, 5.0E0 AS d FROM detections),
       u AS (SELECT 'a' AS feature, a AS v FROM x UNION ALL SELECT 'b', b FROM x UNION ALL SELECT 'c', c FROM x
         UNION ALL SELECT 'd', d FROM x),
       g AS (SELECT feature, AVG(v) AS mean, STDDEV_POP(v) AS std, 1-COUNT(v)/COUNT(*) AS null_share,
         COUNT(v) AS n FROM u GROUP BY 1)
       SELECT feature, mean, std, null_share, CASE WHEN n=0 THEN 'all_null' WHEN null_share>0.5 THEN 'many_nulls'
         WHEN std=0 THEN 'constant' ELSE 'ok' END AS issue FROM g""",
    "detections",
)
def d8(t):
    d = t.detections
    x = d.select(
        F.col("brightness").alias("a"),
        F.when(F.col("confidence") >= 60, F.col("confidence")).alias("b"),
        F.lit(None).cast("double").alias("c"), F.lit(5.0).alias("d"),
    )
    return summaries.feature_quality(x, ["a", "b", "c", "d"])


@query(
    "d9_dataset_statistics",
    "split region year:i rows:i unique_cells:i cell_days:i positives:i negatives:i positive_rate:d9 "
    "lat_min:i lat_max:i lon_min:i lon_max:i first_date:t last_date:t",
    MEMBERS + f""", al AS (SELECT {SPLIT} AS split, region, YEAR(date) AS y, lat_key, lon_key, date, is_fire FROM rg
       UNION ALL SELECT {SPLIT}, 'global', YEAR(date), lat_key, lon_key, date, is_fire FROM predictions),
      yy AS (SELECT split, region, y AS year, lat_key, lon_key, date, is_fire FROM al
       UNION ALL SELECT split, region, NULL, lat_key, lon_key, date, is_fire FROM al)
      SELECT split, region, year, COUNT(*) AS rows, COUNT(DISTINCT (lat_key,lon_key)) AS unique_cells,
       COUNT(DISTINCT (lat_key,lon_key,date)) AS cell_days, SUM(is_fire) AS positives,
       COUNT(*)-SUM(is_fire) AS negatives, AVG(is_fire) AS positive_rate, MIN(lat_key) AS lat_min,
       MAX(lat_key) AS lat_max, MIN(lon_key) AS lon_min, MAX(lon_key) AS lon_max, MIN(date) AS first_date,
       MAX(date) AS last_date FROM yy GROUP BY 1,2,3""",
    "predictions regions",
)
def d9(t):
    return summaries.dataset_statistics(with_split(t.predictions), t.regions)


@query(
    "d10_grid_resolution", "resolution:d9",
    """x AS (SELECT DISTINCT latitude AS x FROM detections),
       s AS (SELECT ROUND(x - LAG(x) OVER (ORDER BY x), 9) AS d FROM x)
       SELECT MEDIAN(d) AS resolution FROM s WHERE d > 0""",
    "detections",
)
def d10(t):
    return summaries.infer_resolution(t.detections, "latitude")


@query(
    "d11_count_calibration", "country month:i expected:d5 observed:d3 expected_observed_count_ratio:d9",
    """SELECT country, MONTH(date) AS month, SUM(prob_raw*eval_weight) AS expected,
       SUM(is_fire*eval_weight) AS observed, SUM(prob_raw*eval_weight)/SUM(is_fire*eval_weight)
       AS expected_observed_count_ratio FROM predictions GROUP BY 1,2""",
    "predictions",
)
def d11(t):
    keyed = t.predictions.withColumn("month", F.month("date"))
    return summaries.count_calibration(keyed, ["country", "month"], **P)


@query(
    "d12_prevalence_audit",
    "model_name support:i denominator denominator_count:d3 event_count:d3 event_rate:d9",
    """SELECT model_name, COUNT(*) AS support, 'deployment_weighted_grid_cell_days' AS denominator,
        SUM(eval_weight) AS denominator_count, SUM(is_fire*eval_weight) AS event_count,
        SUM(is_fire*eval_weight)/SUM(eval_weight) AS event_rate FROM predictions GROUP BY 1
       UNION ALL SELECT model_name, COUNT(*), 'evaluated_rows_unweighted', COUNT(*), SUM(is_fire), AVG(is_fire)
       FROM predictions GROUP BY 1""",
    "predictions",
)
def d12(t):
    return summaries.prevalence_audit(t.predictions, group=["model_name"])


@query(
    "d13_count_correction",
    "model_name raw_expected:d5 calibrated_expected:d5 observed:d3 raw_ratio:d9 calibrated_ratio:d9 "
    "raw_mean:d9 calibrated_mean:d9 reduction_factor:d9",
    CAL + """, a AS (SELECT model_name, SUM(prob_raw*eval_weight) AS re, SUM(prob_cal*eval_weight) AS ce,
        SUM(is_fire*eval_weight) AS o, SUM(eval_weight) AS w FROM p GROUP BY 1)
      SELECT model_name, re AS raw_expected, ce AS calibrated_expected, o AS observed, re/o AS raw_ratio,
       ce/o AS calibrated_ratio, re/w AS raw_mean, ce/w AS calibrated_mean, (re/o)/(ce/o) AS reduction_factor FROM a""",
    "predictions",
)
def d13(t):
    p = t.predictions.withColumn("prob_calibrated", F.col("prob_raw") * 0.4)
    return summaries.count_correction(p, group=["model_name"])


@query(
    "d14_daily_mae", "model_name daily_mae:d7 days:i",
    """d AS (SELECT model_name, date, SUM(prob_raw*eval_weight) AS e, SUM(is_fire*eval_weight) AS o
         FROM predictions GROUP BY 1,2)
       SELECT model_name, AVG(ABS(e-o)) AS daily_mae, COUNT(*) AS days FROM d GROUP BY 1""",
    "predictions",
)
def d14(t):
    return summaries.daily_mae(t.predictions, group=["model_name"], **P)


@query(
    "d15_coarse_cells", "date:t lat_key:i lon_key:i support:i eval_weight:d3 is_fire:i prob:d9",
    """SELECT date, CAST(FLOOR(lat_key/5) AS BIGINT) AS lat_key, CAST(FLOOR(lon_key/5) AS BIGINT) AS lon_key,
       COUNT(*) AS support, SUM(eval_weight) AS eval_weight, MAX(is_fire) AS is_fire,
       SUM(prob_raw*eval_weight)/SUM(eval_weight) AS prob FROM predictions GROUP BY 1,2,3""",
    "predictions",
)
def d15(t):
    return summaries.coarse_cells(t.predictions, 5, **P)


@query(
    "d16_neighbourhood_labels", "row_id near_label:i",
    """ps AS (SELECT DISTINCT date, lat_key+a AS lat_key, lon_key+b AS lon_key FROM predictions,
         (VALUES (-1),(0),(1)) AS x(a), (VALUES (-1),(0),(1)) AS y(b) WHERE is_fire=1)
       SELECT row_id, CASE WHEN ps.date IS NULL THEN 0 ELSE 1 END AS near_label
       FROM predictions p LEFT JOIN ps ON ps.date=p.date AND ps.lat_key=p.lat_key AND ps.lon_key=p.lon_key""",
    "predictions",
)
def d16(t):
    return spatial.neighbourhood_labels(t.predictions, 1)


@query(
    "d17_radius_labels", "row_id tolerant:i",
    """g AS (SELECT row_id, is_fire, YEAR(date)*100+MONTH(date) AS ym, lat_key*0.1E0 AS lat, lon_key*0.1E0 AS lon
          FROM predictions),
       ps AS (SELECT DISTINCT ym, lat, lon FROM g WHERE is_fire=1),
       k AS (SELECT ym, GREATEST(COS(RADIANS(AVG(lat))),0.2E0) AS k FROM ps GROUP BY 1),
       sp AS (SELECT DISTINCT ym, lat, lon FROM g),
       h AS (SELECT DISTINCT sp.ym, sp.lat, sp.lon FROM sp JOIN ps USING (ym) JOIN k USING (ym)
          WHERE POWER(sp.lat-ps.lat,2)+POWER((sp.lon-ps.lon)*k,2) <= 0.115E0*0.115E0)
       SELECT row_id, GREATEST(is_fire, CASE WHEN h.ym IS NULL THEN 0 ELSE 1 END) AS tolerant
       FROM g LEFT JOIN h ON h.ym=g.ym AND h.lat=g.lat AND h.lon=g.lon""",
    "predictions",
)
def d17(t):
    p = t.predictions.withColumns(
        {
            "ym": F.year("date") * 100 + F.month("date"),
            "lat": F.col("lat_key") * F.lit(0.1), "lon": F.col("lon_key") * F.lit(0.1),
        }
    )
    return spatial.tolerant_labels(p, 0.115, ["ym"])


_PART_SQL = """COUNT(*) AS rows, SUM(eval_weight) AS weighted_support, SUM(prob_raw*eval_weight) AS expected_raw,
    SUM(is_fire*eval_weight) AS observed"""
_PART_SHAPE = "rows:i weighted_support:d3 expected_raw:d5 observed:d3"


@query(
    "d18_month_partials", f"month:i {_PART_SHAPE}",
    f"SELECT MONTH(date) AS month, {_PART_SQL} FROM predictions GROUP BY 1", "predictions",
)
def d18_month(t):
    # two chunks, then merged by summing again
    p = t.predictions
    parts = summaries.month_partials(p.filter("model_name = 'm0'"), **P).unionByName(
        summaries.month_partials(p.filter("model_name <> 'm0'"), **P)
    )
    return summaries.merge_partials(parts, ["month"])


@query(
    "d18_period_partials", f"model_name region period_start:t period_end:t month:i {_PART_SHAPE}",
    MEMBERS + f"""SELECT model_name, region, date_trunc('week',date) AS period_start,
      date_trunc('week',date)+INTERVAL 6 DAY AS period_end, MONTH(date) AS month, {_PART_SQL}
      FROM rg GROUP BY 1,2,3,4,5""",
    "predictions regions",
)
def d18_period(t):
    return summaries.period_partials(t.predictions, t.regions, "week", **P)


@query(
    "d18_cell_partials", f"model_name region year:i month:i lat_key:i lon_key:i {_PART_SHAPE}",
    MEMBERS + f"""SELECT model_name, region, YEAR(date) AS year, MONTH(date) AS month, lat_key, lon_key,
      {_PART_SQL} FROM rg GROUP BY 1,2,3,4,5,6""",
    "predictions regions",
)
def d18_cells(t):
    return summaries.cell_partials(t.predictions, t.regions, **P)


@query(
    "d19_observed_expected_merge", f"country month:i {_PART_SHAPE}",
    f"""o AS (SELECT country, MONTH(date) AS month, {_PART_SQL} FROM predictions GROUP BY 1,2),
      e AS (SELECT country, MONTH(date) AS month, SUM(prob_raw*eval_weight) AS ex FROM predictions
        WHERE DAY(date) <= 10 AND country <> 'C3' GROUP BY 1,2)
      SELECT o.country, o.month, rows, weighted_support, COALESCE(ex,0) AS expected_raw, observed
      FROM o LEFT JOIN e USING (country, month)""",
    "predictions",
)
def d19(t):
    p = t.predictions.withColumn("month", F.month("date"))
    keys = ["country", "month"]
    full = summaries._partials(p, keys, "prob_raw", "eval_weight", "is_fire")
    sampled = p.filter((F.dayofmonth("date") <= 10) & (F.col("country") != "C3"))
    part = summaries._partials(sampled, keys, "prob_raw", "eval_weight", "is_fire")
    return summaries.merge_expected(full, part, keys)


_SCALES_SQL = f"""m0 AS (SELECT MONTH(date) AS month, {_PART_SQL} FROM predictions GROUP BY 1),
  m AS (SELECT month, rows, weighted_support, CASE WHEN month=2 THEN 0 ELSE expected_raw END AS expected_raw, observed FROM m0),
  g AS (SELECT SUM(observed)/SUM(expected_raw) AS g FROM m),
  sc AS (SELECT m.*, CASE WHEN expected_raw>0 THEN observed/expected_raw ELSE g END AS probability_scale FROM m, g)"""


def _scales(t):
    m = summaries.month_partials(t.predictions, **P)
    return summaries.monthly_scales(
        m.withColumn("expected_raw", F.when(F.col("month") == 2, 0.0).otherwise(F.col("expected_raw")))
    )


@query(
    "d20_monthly_scales", "month:i probability_scale:d9 mean_before:d9 mean_after:d9 observed_prevalence:d9",
    _SCALES_SQL + """SELECT month, probability_scale, expected_raw/weighted_support AS mean_before,
      LEAST(expected_raw/weighted_support*probability_scale,1) AS mean_after,
      observed/weighted_support AS observed_prevalence FROM sc""",
    "predictions",
)
def d20(t):
    return _scales(t)


@query(
    "d20_scaled_counts", "country month:i expected:d5",
    _SCALES_SQL + f""", c AS (SELECT country, MONTH(date) AS month, {_PART_SQL} FROM predictions GROUP BY 1,2)
      SELECT country, month, LEAST(c.expected_raw*probability_scale, c.weighted_support) AS expected
      FROM c JOIN sc USING (month)""",
    "predictions",
)
def d20_apply(t):
    p = t.predictions.withColumn("month", F.month("date"))
    table = summaries._partials(p, ["country", "month"], "prob_raw", "eval_weight", "is_fire")
    return summaries.apply_scales(table, _scales(t))


@query(
    "d21_count_series",
    "model_name region period_start:t period_end:t weighted_support:d3 expected:d5 observed:d3 error:d5 abs_error:d5",
    MEMBERS + """, al AS (SELECT model_name, region, date, eval_weight, prob_raw, is_fire FROM rg UNION ALL
       SELECT model_name, 'global', date, eval_weight, prob_raw, is_fire FROM predictions)
      SELECT model_name, region, date_trunc('week',date) AS period_start,
       date_trunc('week',date)+INTERVAL 6 DAY AS period_end, SUM(eval_weight) AS weighted_support,
       SUM(prob_raw*eval_weight) AS expected, SUM(is_fire*eval_weight) AS observed,
       SUM(prob_raw*eval_weight)-SUM(is_fire*eval_weight) AS error,
       ABS(SUM(prob_raw*eval_weight)-SUM(is_fire*eval_weight)) AS abs_error FROM al GROUP BY 1,2,3,4""",
    "predictions regions",
)
def d21(t):
    return summaries.count_series(t.predictions, t.regions, "week", **P)


@query(
    "d21_region_month_series", "region month_start:t month_end:t cell_days:i detections:i",
    """s AS (SELECT country, latitude, longitude FROM detections GROUP BY 1,2,3
         HAVING COUNT(DISTINCT strftime(acq_date,'%Y-%m')) >= 6),
       k AS (SELECT *, CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
          CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key FROM detections
         WHERE brightness>380 AND confidence>85 AND (country,latitude,longitude) NOT IN
           (SELECT (country,latitude,longitude) FROM s)),
       cd AS (SELECT lat_key, lon_key, acq_date, COUNT(*) AS n FROM k GROUP BY 1,2,3),
       ex AS (SELECT lat_key+a AS lat_key, lon_key+b AS lon_key, acq_date, CASE WHEN k=0 THEN n ELSE 0 END AS n
         FROM cd, (VALUES (0,0,0),(1,1,0),(2,-1,0),(3,0,1),(4,0,-1)) AS o(k,a,b) WHERE k < n),
       al AS (SELECT r_name AS region, ex.* FROM ex JOIN regions ON lat_key BETWEEN lat_min AND lat_max
         AND lon_key BETWEEN lon_min AND lon_max UNION ALL SELECT 'global', ex.* FROM ex)
       SELECT region, date_trunc('month',acq_date) AS month_start, LAST_DAY(acq_date) AS month_end,
        COUNT(DISTINCT (lat_key,lon_key,acq_date)) AS cell_days, SUM(n) AS detections FROM al GROUP BY 1,2,3""",
    "detections regions",
)
def d21_flagship(t):
    """Event-positive cell-days per region and month, end to end from raw detections."""
    from cindergrid.plans.targets import region_month_counts

    return region_month_counts(t.detections, t.regions)


_MAPS_SQL = """y AS (SELECT model_name, YEAR(date) AS yr, lat_key, lon_key, SUM(eval_weight) AS w,
    SUM(prob_raw*eval_weight) AS e, SUM(is_fire*eval_weight) AS o FROM predictions GROUP BY 1,2,3,4),
  ny AS (SELECT model_name, COUNT(DISTINCT yr) AS n FROM y GROUP BY 1),
  mp AS (SELECT model_name, CAST(yr AS VARCHAR) AS map, lat_key, lon_key, w, e, o FROM y UNION ALL
    SELECT model_name, 'annual_mean', lat_key, lon_key, SUM(w)/MAX(n), SUM(e)/MAX(n), SUM(o)/MAX(n)
    FROM y JOIN ny USING (model_name) GROUP BY 1,3,4)"""


@query(
    "d22_error_maps",
    "model_name map lat_key:i lon_key:i weighted_support:d6 expected:d5 observed:d5 expected_risk:d9 "
    "observed_risk:d9 error:d5 abs_error:d5",
    _MAPS_SQL + """SELECT model_name, map, lat_key, lon_key, w AS weighted_support, e AS expected, o AS observed,
      e/w AS expected_risk, o/w AS observed_risk, e-o AS error, ABS(e-o) AS abs_error FROM mp""",
    "predictions",
)
def d22(t):
    return summaries.error_maps(t.predictions, **P)


@query(
    "d22_map_summary", "model_name map cells:i expected:d4 observed:d4 abs_error:d4 max_abs_error:d5 mean_error:d5",
    _MAPS_SQL + """SELECT model_name, map, COUNT(*) AS cells, SUM(e) AS expected, SUM(o) AS observed,
      SUM(ABS(e-o)) AS abs_error, MAX(ABS(e-o)) AS max_abs_error, AVG(e-o) AS mean_error FROM mp GROUP BY 1,2""",
    "predictions",
)
def d22_summary(t):
    return summaries.map_summary(summaries.error_maps(t.predictions, **P))


@query(
    "d22_smoothed_risk", "model_name map lat_key:i lon_key:i smoothed_observed_risk:d7",
    _MAPS_SQL + """, b AS (SELECT model_name, map, MIN(lat_key) AS a0, MAX(lat_key) AS a1, MIN(lon_key) AS b0,
        MAX(lon_key) AS b1 FROM mp GROUP BY 1,2),
      w AS (SELECT k, EXP(-0.5E0*k*k) AS w FROM range(-4,5) AS r(k)),
      x AS (SELECT mp.model_name, mp.map, mp.lat_key, mp.lon_key, s.o/s.w AS v, wa.w*wb.w AS w
        FROM mp JOIN b USING (model_name, map) CROSS JOIN w wa CROSS JOIN w wb
        JOIN mp s ON s.model_name=mp.model_name AND s.map=mp.map
          AND s.lat_key=LEAST(GREATEST(mp.lat_key+wa.k,a0),a1) AND s.lon_key=LEAST(GREATEST(mp.lon_key+wb.k,b0),b1))
      SELECT model_name, map, lat_key, lon_key, SUM(v*w)/SUM(w) AS smoothed_observed_risk FROM x GROUP BY 1,2,3,4""",
    "predictions",
)
def d22_smooth(t):
    return summaries.smoothed_error_maps(summaries.error_maps(t.predictions, **P))


_SLICE_SQL = f"""s AS (SELECT {SPLIT} AS split, YEAR(date) AS year, CONCAT('E',CAST(lat_key%4 AS VARCHAR)) AS ecoregion,
    MONTH(date) AS month, is_fire, prob_raw, CASE WHEN prob_raw>=0.6E0 THEN 1 ELSE 0 END AS pred FROM predictions)"""


def _slices(t):
    return with_split(t.predictions).withColumns(
        {
            "year": F.year("date"), "month": F.month("date"),
            "ecoregion": F.concat(F.lit("E"), F.pmod("lat_key", F.lit(4)).cast("string")),
            "pred": (F.col("prob_raw") >= 0.6).cast("int"),
        }
    )


@query(
    "d23_error_slices",
    "split year:i ecoregion month:i rows:i positives:i predicted_positives:i tp:i fp:i fn:i tn:i "
    "mean_probability:d9 prevalence:d9 precision:d9 recall:d9 error_count:i error_rank:i",
    _SLICE_SQL + """, g AS (SELECT split, year, ecoregion, month, COUNT(*) AS rows, SUM(is_fire) AS positives,
       SUM(pred) AS predicted_positives, SUM(is_fire*pred) AS tp, SUM((1-is_fire)*pred) AS fp,
       SUM(is_fire*(1-pred)) AS fn, SUM((1-is_fire)*(1-pred)) AS tn, AVG(prob_raw) AS mean_probability
       FROM s GROUP BY 1,2,3,4 HAVING COUNT(*)>=50),
      r AS (SELECT *, positives/rows AS prevalence, CASE WHEN tp+fp>0 THEN tp/(tp+fp) END AS precision,
       CASE WHEN positives>0 THEN tp/positives END AS recall, fp+fn AS error_count,
       ROW_NUMBER() OVER (PARTITION BY split, year ORDER BY fp+fn DESC, ecoregion, month) AS error_rank FROM g)
      SELECT * FROM r WHERE error_rank<=25""",
    "predictions",
)
def d23(t):
    return drift.error_slices(_slices(t), p="prob_raw")


@query(
    "d24_historical_prior", "row_id prior:d9",
    f"""a AS (SELECT *, {SPLIT} AS split, MONTH(date) AS month FROM predictions),
      g AS (SELECT AVG(is_fire) AS g FROM a WHERE split='train'),
      h AS (SELECT lat_key, lon_key, month, SUM(is_fire) AS p, COUNT(*) AS n FROM a WHERE split='train' GROUP BY 1,2,3)
      SELECT row_id, COALESCE((p+g*50)/(n+50), g) AS prior FROM a CROSS JOIN g
      LEFT JOIN h USING (lat_key, lon_key, month) WHERE split='test'""",
    "predictions",
)
def d24(t):
    rows = with_split(t.predictions).withColumn("month", F.month("date"))
    return drift.historical_prior(
        rows.filter("split = 'train'"), rows.filter("split = 'test'"), ["lat_key", "lon_key", "month"]
    )


_JS_SQL = _SLICE_SQL + """, v AS (SELECT split, year, is_fire, UNNEST(['month','ecoregion']) AS feature,
    UNNEST([CAST(month AS VARCHAR), ecoregion]) AS value FROM s),
  c AS (SELECT split, year, feature, value, COUNT(*) AS a, SUM(is_fire) AS p FROM v GROUP BY 1,2,3,4),
  l AS (SELECT split, year, feature, value, 'all' AS population, CAST(a AS DOUBLE) AS n FROM c UNION ALL
        SELECT split, year, feature, value, 'positive', CAST(p AS DOUBLE) FROM c),
  q AS (SELECT feature, population, value, SUM(n) AS n FROM l WHERE split='train' GROUP BY 1,2,3),
  qs AS (SELECT *, n/SUM(n) OVER (PARTITION BY feature, population) AS q FROM q),
  ps AS (SELECT *, n/SUM(n) OVER (PARTITION BY split, year, feature, population) AS p FROM l WHERE split<>'train'),
  gr AS (SELECT DISTINCT split, year, feature, population FROM ps),
  bo AS (SELECT g.split, g.year, g.feature, g.population, qs.value, q, COALESCE(p,0) AS p FROM gr g JOIN qs USING (feature, population)
     LEFT JOIN ps ON ps.split=g.split AND ps.year=g.year AND ps.feature=g.feature AND ps.population=g.population AND ps.value=qs.value),
  js AS (SELECT split, year, feature, population, 0.5E0*SUM(CASE WHEN p>0 THEN p*LOG2(p/((p+q)/2)) ELSE 0 END
     + CASE WHEN q>0 THEN q*LOG2(q/((p+q)/2)) ELSE 0 END) AS js_bits FROM bo GROUP BY 1,2,3,4)"""


@query("d25_js_divergence", "split year:i feature population js_bits:d9", _JS_SQL + "SELECT * FROM js", "predictions")
def d25(t):
    rows = _slices(t)
    return drift.js_divergence(
        rows.filter("split = 'train'"), rows.filter("split <> 'train'"), ["month", "ecoregion"]
    )


_PSI_SQL = f"""a AS (SELECT {SPLIT} AS split, YEAR(date) AS year, prob_raw AS f1,
    CASE WHEN lat_key%9=0 THEN NULL ELSE eval_weight END AS f2 FROM predictions),
  v AS (SELECT split, year, UNNEST(['f1','f2']) AS feature, UNNEST([f1,f2]) AS x FROM a),
  q AS (SELECT feature, list_sort(list_distinct(quantile_cont(x,[0.1,0.2,0.3,0.4,0.5,0.6,0.7,0.8,0.9]))) AS cuts FROM v
     WHERE split='train' GROUP BY 1),
  b AS (SELECT split, year, v.feature, CASE WHEN x IS NULL THEN -1 ELSE len(list_filter(cuts, lambda c: c < x)) END AS bin
     FROM v JOIN q ON q.feature=v.feature),
  tr AS (SELECT feature, bin, COUNT(*) AS n FROM b WHERE split='train' GROUP BY 1,2),
  ev AS (SELECT split, year, feature, bin, COUNT(*) AS n FROM b WHERE split<>'train' GROUP BY 1,2,3,4),
  gr AS (SELECT DISTINCT split, year, e.feature, UNNEST(range(-1, CAST(len(cuts) AS INT)+1)) AS bin FROM ev e JOIN q ON q.feature=e.feature),
  j AS (SELECT g.*, GREATEST(COALESCE(tr.n,0),1e-9) AS p0, GREATEST(COALESCE(ev.n,0),1e-9) AS q0 FROM gr g
     LEFT JOIN tr ON tr.feature=g.feature AND tr.bin=g.bin
     LEFT JOIN ev ON ev.split=g.split AND ev.year=g.year AND ev.feature=g.feature AND ev.bin=g.bin),
  k AS (SELECT *, p0/SUM(p0) OVER w AS p, q0/SUM(q0) OVER w AS q FROM j WINDOW w AS (PARTITION BY split, year, feature)),
  psi AS (SELECT split, year, feature, SUM((q-p)*LN(q/p)) AS psi FROM k GROUP BY 1,2,3)"""


def _psi_rows(t):
    return with_split(t.predictions).withColumns(
        {
            "year": F.year("date"), "f1": F.col("prob_raw"),
            "f2": F.when(F.pmod("lat_key", F.lit(9)) != 0, F.col("eval_weight")),
        }
    )


def _numeric_psi(t):
    rows = _psi_rows(t)
    return drift.numeric_psi(
        rows.filter("split = 'train'"), rows.filter("split <> 'train'"), ["f1", "f2"], ["split", "year"]
    )


@query("d26_numeric_psi", "split year:i feature psi:d8", _PSI_SQL + "SELECT * FROM psi", "predictions")
def d26(t):
    return _numeric_psi(t)


@query(
    "d26_categorical_psi", "split year:i feature psi:d8",
    f"""a AS (SELECT {SPLIT} AS split, YEAR(date) AS year, CAST(lat_key AS VARCHAR) AS x FROM predictions),
      r AS (SELECT x, COUNT(*) AS n FROM a WHERE split='train' GROUP BY 1),
      h AS (SELECT x, ROW_NUMBER() OVER (ORDER BY n DESC, x) AS k FROM r),
      b AS (SELECT split, year, CASE WHEN k<=12 THEN a.x ELSE '<other>' END AS bin FROM a LEFT JOIN h ON h.x=a.x),
      tr AS (SELECT bin, COUNT(*) AS n FROM b WHERE split='train' GROUP BY 1),
      ev AS (SELECT split, year, bin, COUNT(*) AS n FROM b WHERE split<>'train' GROUP BY 1,2,3),
      gr AS (SELECT DISTINCT split, year, tr.bin FROM ev, tr),
      j AS (SELECT g.*, GREATEST(COALESCE(tr.n,0),1e-9) AS p0, GREATEST(COALESCE(ev.n,0),1e-9) AS q0 FROM gr g
        LEFT JOIN tr ON tr.bin=g.bin LEFT JOIN ev ON ev.split=g.split AND ev.year=g.year AND ev.bin=g.bin),
      k AS (SELECT *, p0/SUM(p0) OVER w AS p, q0/SUM(q0) OVER w AS q FROM j WINDOW w AS (PARTITION BY split, year))
      SELECT split, year, 'lat' AS feature, SUM((q-p)*LN(q/p)) AS psi FROM k GROUP BY 1,2""",
    "predictions",
)
def d26_categorical(t):
    rows = _psi_rows(t).withColumn("lat", F.col("lat_key").cast("string"))
    return drift.categorical_psi(
        rows.filter("split = 'train'"), rows.filter("split <> 'train'"), ["lat"], ["split", "year"], 12
    )





def _importance(t):
    """Importance weights of the two drift features: how often each is known."""
    rows = _psi_rows(t)
    wide = rows.agg(F.count("f1").alias("f1"), F.count("f2").alias("f2"))
    return wide.unpivot([], ["f1", "f2"], "feature", "importance_weight").withColumn(
        "importance_weight", F.col("importance_weight").cast("double")
    )


_WEIGHTS_SQL = """im AS (SELECT 'f1' AS feature, COUNT(f1) AS w FROM a UNION ALL SELECT 'f2', COUNT(f2) FROM a),
  iw AS (SELECT feature, w/SUM(w) OVER () AS weight FROM im)"""


@query(
    "d26_shift_summary", "split year:i weighted_feature_shift:d8 mean_feature_psi:d8 max_feature_psi:d8",
    _PSI_SQL + "," + _WEIGHTS_SQL + """ SELECT split, year, SUM(weight*psi) AS weighted_feature_shift,
      AVG(psi) AS mean_feature_psi, MAX(psi) AS max_feature_psi FROM psi JOIN iw USING (feature) GROUP BY 1,2""",
    "predictions",
)
def d26_summary(t):
    return drift.shift_summary(_numeric_psi(t), _importance(t), ["split", "year"])


@query(
    "d27_difficulty_table",
    "split year:i rows:i ranking_difficulty:d6 operational_difficulty:d6 weighted_feature_shift:d8 js_bits:d9 difficulty_rank:i",
    _SLICE_SQL + f""", fs AS (WITH {_PSI_SQL},{_WEIGHTS_SQL} SELECT split, year, SUM(weight*psi) AS weighted_feature_shift
        FROM psi JOIN iw USING (feature) GROUP BY 1,2),
      cs AS (WITH {_JS_SQL} SELECT split, year, SUM(js_bits) AS js_bits FROM js WHERE population='all' GROUP BY 1,2),
      m AS (SELECT split, year, COUNT(*) AS rows, SUM(is_fire*pred) AS tp, SUM(is_fire) AS p, SUM(pred) AS h FROM s
        WHERE split<>'train' GROUP BY 1,2),
      d AS (SELECT split, year, rows, CASE WHEN year=1999 THEN NULL ELSE ROUND(100*(1-tp/h),6) END AS ranking_difficulty,
        ROUND(100*(1-2*tp/(p+h)),6) AS operational_difficulty FROM m)
      SELECT d.*, weighted_feature_shift, js_bits, DENSE_RANK() OVER (ORDER BY
        COALESCE(ranking_difficulty, operational_difficulty) DESC) AS difficulty_rank
      FROM d LEFT JOIN fs USING (split, year) LEFT JOIN cs USING (split, year)""",
    "predictions",
)
def d27(t):
    rows = _slices(t)
    later = rows.filter("split <> 'train'")
    hit = ranking.threshold_metrics(later, 0.6, p="prob_raw", group=["split", "year"])
    metrics = hit.select(
        "split", "year", (F.col("tp") + F.col("fp") + F.col("fn") + F.col("tn")).alias("rows"),
        F.when(F.col("year") != 1999, F.round(100 * (1 - F.col("precision")), 6))
        .alias("ranking_difficulty"),
        F.round(100 * (1 - F.col("f1")), 6).alias("operational_difficulty"),
    )
    shift = drift.shift_summary(_numeric_psi(t), _importance(t), ["split", "year"])
    js = drift.js_divergence(rows.filter("split = 'train'"), later, ["month", "ecoregion"])
    mix = js.filter("population = 'all'").groupBy("split", "year").agg(F.sum("js_bits").alias("js_bits"))
    return drift.difficulty_table(metrics, shift, mix)


_METRICS_SQL = f"""mt AS (SELECT CONCAT('v',CAST(lat_key%4 AS VARCHAR)) AS variant, country AS region,
    {SPLIT} AS period, AVG(prob_raw) AS mean_prob, SUM(eval_weight*POWER(prob_raw-is_fire,2))/SUM(eval_weight) AS brier_score
    FROM predictions GROUP BY 1,2,3)"""


def _metric_table(t):
    p = with_split(t.predictions).withColumns(
        {
            "variant": F.concat(F.lit("v"), F.pmod("lat_key", F.lit(4)).cast("string")),
            "region": F.col("country"), "period": F.col("split"),
            "_sq": F.col("eval_weight") * F.pow(F.col("prob_raw") - F.col("is_fire"), F.lit(2)),
        }
    )
    return p.groupBy("variant", "region", "period").agg(
        F.avg("prob_raw").alias("mean_prob"),
        (F.sum("_sq") / F.sum("eval_weight")).alias("brier_score"),
    )


@query(
    "d28_ablation_deltas", "variant region period mean_prob:d9 brier_score:d9 delta_mean_prob_vs_full:d9 delta_brier_score_vs_full:d9",
    _METRICS_SQL + """SELECT a.*, f.mean_prob-a.mean_prob AS delta_mean_prob_vs_full, f.brier_score-a.brier_score AS delta_brier_score_vs_full
      FROM mt a LEFT JOIN mt f ON f.variant='v0' AND f.region=a.region AND f.period=a.period""",
    "predictions",
)
def d28(t):
    return summaries.ablation_deltas(_metric_table(t), ["mean_prob", "brier_score"], full="v0")


_LONG_SQL = _METRICS_SQL + """, lg AS (SELECT variant, region, period, 'mean_prob' AS metric, mean_prob AS value FROM mt
    UNION ALL SELECT variant, region, period, 'brier_score', brier_score FROM mt)"""


def _long(t):
    return summaries.melt(_metric_table(t), ["variant", "region", "period"], ["mean_prob", "brier_score"])


@query("d29_melt", "variant region period metric value:d9", _LONG_SQL + "SELECT * FROM lg", "predictions")
def d29(t):
    return _long(t)


_RANK_SQL = _LONG_SQL + """, rk AS (SELECT *, CASE WHEN metric='brier_score' THEN 'min' ELSE 'max' END AS direction,
    ROW_NUMBER() OVER (PARTITION BY metric, region, period ORDER BY CASE WHEN metric='brier_score' THEN value
      ELSE -value END, variant) AS rank FROM lg)"""


@query(
    "d30_model_ranking", "variant region period metric value:d9 direction rank:i",
    _RANK_SQL + "SELECT * FROM rk", "predictions",
)
def d30(t):
    return summaries.rank_models(_long(t), ("metric", "region", "period"), "variant")


@query(
    "d30_best_rows", "variant region period metric value:d9",
    _RANK_SQL + "SELECT * FROM rk WHERE rank=1", "predictions",
)
def d30_best(t):
    return summaries.best_rows(_long(t), ("metric", "region", "period"), "variant")


_TRIAL_SQL = f"""lg AS (SELECT CAST(lon_key AS INT) AS trial, {SPLIT} AS split, 'log_loss' AS metric,
    -AVG(is_fire*LN(prob_raw)+(1-is_fire)*LN(1-prob_raw)) AS value FROM predictions GROUP BY 1,2),
  wd AS (SELECT trial, -MAX(CASE WHEN split='train' THEN value END) AS tr, -MAX(CASE WHEN split='validation' THEN value END) AS va,
    -MAX(CASE WHEN split='test' THEN value END) AS te FROM lg GROUP BY 1),
  ob AS (SELECT trial, GREATEST(tr-te,0) AS train_minus_test, ABS(va-te) AS validation_test_abs,
    GREATEST(tr-va,0) AS train_minus_validation,
    va-0.5E0*GREATEST(tr-te,0)-0.25E0*ABS(va-te)-0.1E0*GREATEST(tr-va,0) AS objective FROM wd)"""


def _trials(t):
    p = with_split(t.predictions)
    loss = -(F.col("is_fire") * F.log("prob_raw") + (1 - F.col("is_fire")) * F.log1p(-F.col("prob_raw")))
    long = p.groupBy(F.col("lon_key").alias("trial"), "split").agg(F.avg(loss).alias("value"))
    return summaries.trial_objective(
        long.withColumn("metric", F.lit("log_loss")), "log_loss", "validation", (0.5, 0.25, 0.1)
    )


@query(
    "d31_trial_objective",
    "trial:i train_minus_test:d9 validation_test_abs:d9 train_minus_validation:d9 objective:d9",
    _TRIAL_SQL + "SELECT * FROM ob", "predictions",
)
def d31(t):
    return _trials(t)


@query(
    "d30_leaderboard", "trial:i objective:d9 place:i",
    _TRIAL_SQL + "SELECT trial, objective, ROW_NUMBER() OVER (ORDER BY objective DESC, trial) AS place FROM ob",
    "predictions",
)
def d30_board(t):
    return summaries.leaderboard(_trials(t))


_IMP_SQL = """raw AS (SELECT CONCAT('m',CAST(p_partkey%3 AS VARCHAR)) AS method,
    CONCAT([ 't2m','road','population','elevation','xyz'][CAST(p_size%5 AS INT)+1],'_',CAST(p_size AS VARCHAR)) AS feature,
    SUM(p_retailprice*(p_partkey%5-2)) AS importance FROM part GROUP BY 1,2),
  im AS (SELECT *, CASE WHEN feature LIKE 't2m%' THEN 'climate_t2m' WHEN feature LIKE 'road%' THEN 'infrastructure'
     WHEN feature LIKE 'xyz%' THEN 'xyz' ELSE 'geospatial' END AS grp, ABS(importance) AS ab, GREATEST(importance,0) AS po FROM raw),
  it AS (SELECT *, po/SUM(po) OVER (PARTITION BY method) AS np, ab/SUM(ab) OVER (PARTITION BY method) AS na,
     ROW_NUMBER() OVER (PARTITION BY method ORDER BY importance DESC, feature) AS rank FROM im),
  cb AS (SELECT feature, grp, COUNT(rank) AS methods_present, AVG(rank) AS mean_rank, AVG(np) AS mni FROM it GROUP BY 1,2),
  cn AS (SELECT *, ROW_NUMBER() OVER (ORDER BY mean_rank, mni DESC, feature) AS consensus_rank FROM cb)"""


def _importances(t):
    p = t.table("part")
    stem = F.element_at(
        F.array(*[F.lit(s) for s in ("t2m", "road", "population", "elevation", "xyz")]),
        (F.pmod("p_size", F.lit(5)) + 1).cast("int"),
    )
    raw = p.groupBy(
        F.concat(F.lit("m"), F.pmod("p_partkey", F.lit(3)).cast("string")).alias("method"),
        F.concat_ws("_", stem, F.col("p_size").cast("string")).alias("feature"),
    ).agg(F.sum(F.col("p_retailprice") * (F.pmod("p_partkey", F.lit(5)) - 2)).alias("importance"))
    return summaries.importance_table(raw)


@query(
    "d32_importance_table",
    "method feature group_name importance:d5 normalized_importance:d9 normalized_abs_importance:d9 rank:i",
    _IMP_SQL + """SELECT method, feature, grp AS group_name, importance, np AS normalized_importance,
      na AS normalized_abs_importance, rank FROM it""",
)
def d32(t):
    return _importances(t).withColumnRenamed("group", "group_name")


@query(
    "d32_group_importance",
    "method group_name feature_count:i importance:d5 max_feature_importance:d5 normalized_importance:d9 rank:i",
    _IMP_SQL + """, g AS (SELECT method, grp, COUNT(*) AS n, SUM(importance) AS s, SUM(po) AS p, MAX(importance) AS mx FROM it GROUP BY 1,2)
      SELECT method, grp AS group_name, n AS feature_count, s AS importance, mx AS max_feature_importance,
       p/SUM(p) OVER (PARTITION BY method) AS normalized_importance,
       ROW_NUMBER() OVER (PARTITION BY method ORDER BY p DESC, grp) AS rank FROM g""",
)
def d32_groups(t):
    return summaries.group_importance(_importances(t)).withColumnRenamed("group", "group_name")


@query(
    "d32_consensus", "feature group_name methods_present:i mean_rank:d9 mean_normalized_importance:d9 consensus_rank:i",
    _IMP_SQL + """SELECT feature, grp AS group_name, methods_present, mean_rank, mni AS mean_normalized_importance,
      consensus_rank FROM cn""",
)
def d32_consensus(t):
    return summaries.combine_importances(_importances(t)).withColumnRenamed("group", "group_name")


@query(
    "d32_consensus_groups",
    "group_name feature_count:i group_score:d9 best_consensus_rank:i mean_consensus_rank:d9 normalized_group_score:d9 rank:i",
    _IMP_SQL + """, g AS (SELECT grp, COUNT(*) AS n, SUM(mni) AS s, MIN(consensus_rank) AS b, AVG(consensus_rank) AS m FROM cn GROUP BY 1)
      SELECT grp AS group_name, n AS feature_count, s AS group_score, b AS best_consensus_rank, m AS mean_consensus_rank,
       s/SUM(s) OVER () AS normalized_group_score, ROW_NUMBER() OVER (ORDER BY s DESC, b) AS rank FROM g""",
)
def d32_consensus_groups(t):
    return summaries.consensus_groups(
        summaries.combine_importances(_importances(t))
    ).withColumnRenamed("group", "group_name")


@query(
    "d33_split_summary", "split rows:i positives:i negatives:i positive_rate:d9 first_date:t last_date:t",
    f"""SELECT {SPLIT} AS split, COUNT(*) AS rows, SUM(is_fire) AS positives, COUNT(*)-SUM(is_fire) AS negatives,
      AVG(is_fire) AS positive_rate, MIN(date) AS first_date, MAX(date) AS last_date FROM predictions GROUP BY 1""",
    "predictions",
)
def d33(t):
    return summaries.split_summary(with_split(t.predictions))


@query(
    "d34_overall_yearly", "split scope year:i mean_prob:d9",
    f"""a AS (SELECT {SPLIT} AS s, YEAR(date) AS y, prob_raw FROM predictions)
      SELECT s AS split, 'overall' AS scope, NULL AS year, AVG(prob_raw) AS mean_prob FROM a WHERE s='test' GROUP BY 1
      UNION ALL SELECT CONCAT(s,'_',CAST(y AS VARCHAR)), 'yearly', y, AVG(prob_raw) FROM a WHERE s='test' GROUP BY s, y""",
    "predictions",
)
def d34(t):
    p = with_split(t.predictions)
    keys = F.explode(
        F.array(F.col("split"), F.concat_ws("_", F.col("split"), F.year("date").cast("string")))
    )
    metrics = p.select(keys.alias("split"), "prob_raw").groupBy("split").agg(
        F.avg("prob_raw").alias("mean_prob")
    )
    return summaries.overall_and_yearly(metrics)


@query(
    "d35_combined_table", "model_name region mean_prob:d9 support:i extra:d3 region_label",
    """a AS (SELECT model_name, r_name AS region, AVG(prob_raw) AS mean_prob, COUNT(*) AS support,
         MAX(lat_min) AS a, MAX(lat_max) AS b, MAX(lon_min) AS c, MAX(lon_max) AS d
       FROM predictions JOIN regions ON lat_key BETWEEN lat_min AND lat_max AND lon_key BETWEEN lon_min AND lon_max
       GROUP BY 1,2)
       SELECT model_name, region, mean_prob, CASE WHEN model_name='m0' THEN support END AS support, NULL AS extra,
        printf('%s [%d..%d, %d..%d]', region, a, b, c, d) AS region_label FROM a""",
    "predictions regions",
)
def d35(t):
    from cindergrid.operators.regions import region_rows

    by = region_rows(t.predictions, t.regions).groupBy("model_name", "region").agg(
        F.avg("prob_raw").alias("mean_prob"), F.count(F.lit(1)).alias("support")
    )
    tables = [by.filter("model_name = 'm0'"), by.filter("model_name = 'm1'").drop("support")]
    return summaries.combined_table(
        tables, t.regions, ["model_name", "region", "mean_prob", "support", "extra"],
        ["model_name", "region"],
    )
