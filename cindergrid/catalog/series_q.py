"""Queries of lookback series, event history and tensors."""

from __future__ import annotations

from datetime import date

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.operators import detections, series

N = 30
# gap-free daily series of every cell; interpolation inside, extrapolation at the ends
SPINE = """sp AS (SELECT MIN(date) AS a, MAX(date) AS b FROM cube),
  dy AS (SELECT lat_key, lon_key, CAST(d AS DATE) AS date FROM (SELECT DISTINCT lat_key, lon_key FROM cube),
    sp, range(sp.a, sp.b + INTERVAL 1 DAY, INTERVAL 1 DAY) AS r(d)),
  fu AS (SELECT lat_key, lon_key, date, date - DATE '1970-01-01' AS t, v FROM dy LEFT JOIN cube USING (lat_key, lon_key, date)),
  kn AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY lat_key, lon_key ORDER BY t) AS i,
    COUNT(*) OVER (PARTITION BY lat_key, lon_key) AS n FROM fu WHERE v IS NOT NULL),
  en AS (SELECT lat_key, lon_key, MAX(t) FILTER (i=1) AS at1, MAX(v) FILTER (i=1) AS av1, MAX(t) FILTER (i=2) AS at2,
    MAX(v) FILTER (i=2) AS av2, MAX(t) FILTER (i=n) AS zt1, MAX(v) FILTER (i=n) AS zv1,
    MAX(t) FILTER (i=n-1) AS zt2, MAX(v) FILTER (i=n-1) AS zv2 FROM kn GROUP BY 1,2),
  pn AS (SELECT *, LAST_VALUE(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER p AS pt,
    LAST_VALUE(v IGNORE NULLS) OVER p AS pv,
    FIRST_VALUE(CASE WHEN v IS NOT NULL THEN t END IGNORE NULLS) OVER q AS nt, FIRST_VALUE(v IGNORE NULLS) OVER q AS nv
   FROM fu WINDOW p AS (PARTITION BY lat_key, lon_key ORDER BY t ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW),
     q AS (PARTITION BY lat_key, lon_key ORDER BY t ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
  dl AS (SELECT lat_key, lon_key, date, t, CASE WHEN v IS NOT NULL THEN v
     WHEN pt IS NOT NULL AND nt IS NOT NULL THEN pv+(nv-pv)*(t-pt)/(nt-pt)
     WHEN pt IS NULL THEN av1+(av2-av1)*(t-at1)/(at2-at1) ELSE zv2+(zv1-zv2)*(t-zt2)/(zt1-zt2) END AS v
   FROM pn JOIN en USING (lat_key, lon_key)),
  """
# the last 30 daily values of every observed cell-day
BACK = SPINE + f"""la AS (SELECT lat_key, lon_key, date, LIST(v) OVER w AS s FROM dl
    WINDOW w AS (PARTITION BY lat_key, lon_key ORDER BY t ROWS BETWEEN {N - 1} PRECEDING AND CURRENT ROW)),
  bk AS (SELECT c.lat_key, c.lon_key, c.date, CASE WHEN len(s)={N} THEN s END AS s FROM cube c JOIN la
    ON la.lat_key=c.lat_key AND la.lon_key=c.lon_key AND la.date=c.date)
  """
KEY = "lat_key:i lon_key:i date:t"


def _back(t):
    return series.lookback(t.cube.select("lat_key", "lon_key", "date"), t.cube, N)


@query(
    "e0_lookback", f"{KEY} days:i first:d6 last:d6 total:d5",
    BACK + """SELECT lat_key, lon_key, date, len(s) AS days, s[1] AS first, s[30] AS last, list_sum(s) AS total FROM bk""",
    "cube",
)
def e0(t):
    s = F.col("series")
    return _back(t).withColumns(
        {
            "days": F.when(s.isNotNull(), F.size(s)), "first": F.element_at(s, 1),
            "last": F.element_at(s, -1), "total": F.aggregate(s, F.lit(0.0), lambda a, x: a + x),
        }
    )


def _feature_query(name, columns, sql_columns, digits=6):
    shape = f"{KEY} " + " ".join(f"{c}:d{digits}" for c in columns)
    sql = BACK + f"SELECT lat_key, lon_key, date, {sql_columns} FROM bk"

    @query(name, shape, sql, "cube")
    def build(t):
        return series.lookback_features(t.cube.select("lat_key", "lon_key", "date"), {"v": t.cube}, N, columns)

    return build


_feature_query("e1_lag", ["v_lag_1", "v_lag_7", "v_lag_30"],
               "s[30] AS v_lag_1, s[24] AS v_lag_7, s[1] AS v_lag_30")
_feature_query(
    "e2_mean_std", ["v_mean_7", "v_std_7", "v_mean_30", "v_std_30"],
    "list_avg(s[24:30]) AS v_mean_7, list_stddev_pop(s[24:30]) AS v_std_7, "
    "list_avg(s) AS v_mean_30, list_stddev_pop(s) AS v_std_30",
)
_feature_query(
    "e3_min_max_median", ["v_min_7", "v_max_14", "v_median_7", "v_median_30"],
    "list_min(s[24:30]) AS v_min_7, list_max(s[17:30]) AS v_max_14, list_median(s[24:30]) AS v_median_7, "
    "list_median(s) AS v_median_30",
)
_feature_query(
    "e4_ewm", ["v_ewm_7", "v_ewm_14"],
    "list_reduce(s, lambda a, x: a + (x-a)*0.25E0) AS v_ewm_7, "
    "list_reduce(s, lambda a, x: a + (x-a)*2.0E0/15) AS v_ewm_14",
)
_feature_query(
    "e5_diff_pct", ["v_diff_1", "v_diff_7", "v_pct_change_1", "v_pct_change_7"],
    "s[30]-s[29] AS v_diff_1, s[30]-s[23] AS v_diff_7, (s[30]-s[29])/NULLIF(s[29],0) AS v_pct_change_1, "
    "(s[30]-s[23])/NULLIF(s[23],0) AS v_pct_change_7",
)


@query(
    "e6_autocorr", f"{KEY} v_autocorr_1:d6 v_autocorr_7:d6",
    BACK + """, a1 AS (SELECT lat_key, lon_key, date, CORR(x,y) AS c FROM (SELECT lat_key, lon_key, date, UNNEST(s[1:29]) AS x,
        UNNEST(s[2:30]) AS y FROM bk) GROUP BY 1,2,3),
      a7 AS (SELECT lat_key, lon_key, date, CORR(x,y) AS c FROM (SELECT lat_key, lon_key, date, UNNEST(s[1:23]) AS x,
        UNNEST(s[8:30]) AS y FROM bk) GROUP BY 1,2,3)
      SELECT bk.lat_key, bk.lon_key, bk.date, a1.c AS v_autocorr_1, a7.c AS v_autocorr_7 FROM bk
      LEFT JOIN a1 USING (lat_key, lon_key, date) LEFT JOIN a7 USING (lat_key, lon_key, date)""",
    "cube",
)
def e6(t):
    return series.lookback_features(t.cube.select("lat_key", "lon_key", "date"), {"v": t.cube}, N, ["v_autocorr_1", "v_autocorr_7"])


@query(
    "e7_fft_peaks", f"{KEY} v_fft_peak_1:d4 v_fft_peak_2:d4 v_fft_peak_3:d4",
    BACK + """, ex AS (SELECT lat_key, lon_key, date, UNNEST(s) AS x, UNNEST(range(30)) AS i FROM bk),
      ft AS (SELECT lat_key, lon_key, date, k, SQRT(POWER(SUM(x*COS(2*PI()*k*i/30)),2)+POWER(SUM(x*SIN(2*PI()*k*i/30)),2)) AS m
        FROM ex, range(1,16) AS r(k) GROUP BY 1,2,3,4),
      tp AS (SELECT lat_key, lon_key, date, list_sort(LIST(m),'DESC') AS p FROM ft GROUP BY 1,2,3)
      SELECT bk.lat_key, bk.lon_key, bk.date, p[1] AS v_fft_peak_1, p[2] AS v_fft_peak_2, p[3] AS v_fft_peak_3
      FROM bk LEFT JOIN tp USING (lat_key, lon_key, date)""",
    "cube",
)
def e7(t):
    names = ["v_fft_peak_1", "v_fft_peak_2", "v_fft_peak_3"]
    back = _back(t).withColumn("_f", series.fft_peaks(F.col("series")))
    return back.withColumns({n: F.try_element_at("_f", F.lit(i + 1)) for i, n in enumerate(names)})


@query(
    "e8_cumprod", f"{KEY} v_cumprod:d6",
    BACK + """SELECT lat_key, lon_key, date, CASE WHEN list_min(s) > 0 THEN
      list_reduce(list_transform(s, lambda x: x/40), lambda a, x: a*x) END AS v_cumprod FROM bk""",
    "cube",
)
def e8(t):
    scaled = _back(t).withColumn("series", F.transform("series", lambda x: x / 40))
    return series.add_features(scaled, ["v_cumprod"], {"v": "series"})


@query(
    "e9_trend", f"{KEY} v_trend_slope_7:d6 v_trend_intercept_7:d6 v_trend_slope_30:d6 v_trend_intercept_30:d6",
    BACK + """, tr AS (SELECT lat_key, lon_key, date, list_sum(list_transform(s[24:30], lambda x, i: x*(i-4)))/28.0E0 AS c,
        list_sum(list_transform(s, lambda x, i: x*(i-15.5E0)))/2247.5E0 AS a, list_avg(s[24:30]) AS m, list_avg(s) AS n FROM bk)
      SELECT lat_key, lon_key, date, c AS v_trend_slope_7, m-3*c AS v_trend_intercept_7, a AS v_trend_slope_30,
       n-14.5E0*a AS v_trend_intercept_30 FROM tr""",
    "cube",
)
def e9(t):
    names = ["v_trend_slope_7", "v_trend_intercept_7", "v_trend_slope_30", "v_trend_intercept_30"]
    return series.lookback_features(t.cube.select("lat_key", "lon_key", "date"), {"v": t.cube}, N, names)


@query(
    "e10_grid_features", "lat_key:i lon_key:i v_mean_7:d6 v_max_30:d6 v_lag_3:d6 v_trend_slope_14:d6",
    SPINE + """x AS (SELECT lat_key, lon_key, t - (DATE '1999-06-30' - DATE '1970-01-01') + 29 AS i, v FROM dl
        WHERE date BETWEEN DATE '1999-06-01' AND DATE '1999-06-30')
      SELECT lat_key, lon_key, AVG(v) FILTER (i>=23) AS v_mean_7, MAX(v) AS v_max_30, MAX(v) FILTER (i=27) AS v_lag_3,
       REGR_SLOPE(v,i) FILTER (i>=16) AS v_trend_slope_14 FROM x GROUP BY 1,2""",
    "cube",
)
def e10(t):
    names = ["v_mean_7", "v_max_30", "v_lag_3", "v_trend_slope_14"]
    return series.grid_features(t.cube, date(1999, 6, 30), N, names, "v")


_EVENTS = """ev AS (SELECT country, CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
    CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key, acq_date AS date, COUNT(*) AS w FROM detections
    WHERE brightness > 360 GROUP BY 1,2,3,4),
  ro AS (SELECT row_id, country, lat_key, lon_key, date FROM predictions)"""


def _history(t, **kw):
    from cindergrid.functions.cells import with_cell_keys

    ev = with_cell_keys(t.detections.filter("brightness > 360")).withColumnsRenamed(
        {"acq_date": "date"}
    ).withColumn("count", F.lit(1))
    return series.event_history(t.predictions, ev, **kw)


def _near(r):
    return (f"ev.country=ro.country AND ev.lat_key BETWEEN ro.lat_key-{r} AND ro.lat_key+{r} "
            f"AND ev.lon_key BETWEEN ro.lon_key-{r} AND ro.lon_key+{r}")


@query(
    "e11_event_history",
    "row_id past_event_count_r0_1_30d:i past_event_count_r0_31_365d:i past_event_count_r1_1_30d:i past_event_count_r1_31_365d:i",
    _EVENTS + f""", p0 AS (SELECT row_id, SUM(w) FILTER (ro.date-ev.date BETWEEN 1 AND 30) AS a,
        SUM(w) FILTER (ro.date-ev.date BETWEEN 31 AND 365) AS b FROM ro JOIN ev ON {_near(0)} GROUP BY 1),
      p1 AS (SELECT row_id, SUM(w) FILTER (ro.date-ev.date BETWEEN 1 AND 30) AS a,
        SUM(w) FILTER (ro.date-ev.date BETWEEN 31 AND 365) AS b FROM ro JOIN ev ON {_near(1)} GROUP BY 1)
      SELECT ro.row_id, COALESCE(p0.a,0) AS past_event_count_r0_1_30d, COALESCE(p0.b,0) AS past_event_count_r0_31_365d,
       COALESCE(p1.a,0) AS past_event_count_r1_1_30d, COALESCE(p1.b,0) AS past_event_count_r1_31_365d
      FROM ro LEFT JOIN p0 USING (row_id) LEFT JOIN p1 USING (row_id)""",
    "detections predictions",
)
def e11(t):
    return _history(t, radii=[0, 1], windows={"1_30d": (1, 30), "31_365d": (31, 365)})


@query(
    "e12_days_since_event", "row_id days_since_event_r0:i days_since_event_r1:i",
    _EVENTS + f""", p0 AS (SELECT row_id, MIN(ro.date-ev.date) AS g FROM ro JOIN ev ON {_near(0)} AND ro.date-ev.date>=30 GROUP BY 1),
      p1 AS (SELECT row_id, MIN(ro.date-ev.date) AS g FROM ro JOIN ev ON {_near(1)} AND ro.date-ev.date>=30 GROUP BY 1)
      SELECT ro.row_id, LEAST(COALESCE(p0.g,366),366) AS days_since_event_r0, LEAST(COALESCE(p1.g,366),366) AS days_since_event_r1
      FROM ro LEFT JOIN p0 USING (row_id) LEFT JOIN p1 USING (row_id)""",
    "detections predictions",
)
def e12(t):
    return _history(t, radii=[], windows={}, days_since_radii=[0, 1])


@query(
    "e13_scoring_history", "lat_key:i lon_key:i date:t past_event_count_r1_1_60d:i days_since_event_r1:i",
    """kd AS (SELECT *, CAST(round_even(latitude/0.1E0,0) AS BIGINT) AS lat_key,
         CAST(round_even(longitude/0.1E0,0) AS BIGINT) AS lon_key FROM detections
        WHERE acq_date BETWEEN DATE '1998-01-01' AND DATE '1999-01-31'),
       cd AS (SELECT lat_key, lon_key, acq_date, COUNT(*) AS n FROM kd GROUP BY 1,2,3),
       ev AS (SELECT lat_key+a AS lat_key, lon_key+b AS lon_key, acq_date AS date FROM cd,
         (VALUES (0,0,0),(1,1,0),(2,-1,0),(3,0,1),(4,0,-1)) AS o(k,a,b) WHERE k < n),
       ro AS (SELECT DISTINCT lat_key, lon_key, date FROM predictions WHERE date BETWEEN DATE '1999-01-01' AND DATE '1999-01-31'),
       h AS (SELECT ro.lat_key, ro.lon_key, ro.date, COUNT(*) FILTER (ro.date-ev.date BETWEEN 1 AND 60) AS c,
         MIN(ro.date-ev.date) FILTER (ro.date-ev.date>=30) AS g FROM ro JOIN ev ON ev.lat_key BETWEEN ro.lat_key-1 AND ro.lat_key+1
         AND ev.lon_key BETWEEN ro.lon_key-1 AND ro.lon_key+1 GROUP BY 1,2,3)
       SELECT ro.lat_key, ro.lon_key, ro.date, COALESCE(c,0) AS past_event_count_r1_1_60d,
         LEAST(COALESCE(g,366),366) AS days_since_event_r1 FROM ro LEFT JOIN h USING (lat_key, lon_key, date)""",
    "detections predictions",
)
def e13(t):
    from cindergrid.plans.targets import scoring_history

    rows = t.predictions.filter(F.col("date").between("1999-01-01", "1999-01-31")).select(
        "lat_key", "lon_key", "date"
    ).distinct()
    return scoring_history(
        rows, t.detections, date(1999, 1, 1), date(1999, 1, 31), 365,
        radii=[1], windows={"1_60d": (1, 60)}, days_since_radii=[1],
    )


@query(
    "e14_channel_tensor", f"{KEY} channels:i a_first:d4 b_last:d4 a_mid:d4",
    BACK + """SELECT lat_key, lon_key, date, CASE WHEN s IS NOT NULL THEN 2 ELSE 2 END AS channels, CAST(s[1] AS FLOAT) AS a_first,
      s[30]/2 AS b_last, CAST(s[15] AS FLOAT) AS a_mid FROM bk""",
    "cube",
)
def e14(t):
    rows = t.cube.select("lat_key", "lon_key", "date")
    half = t.cube.withColumn("v", F.col("v") / 2)
    out = series.channel_tensor(rows, {"a": t.cube, "b": half}, N)
    x = F.col("tensor")
    return out.withColumns(
        {
            "channels": F.size(x), "a_first": F.element_at(F.element_at(x, 1), 1),
            "b_last": F.element_at(F.element_at(x, 2), -1),
            "a_mid": F.element_at(F.element_at(x, 1), 15),
        }
    )


@query(
    "e14_spatial_patch", f"{KEY} corner:d4 centre:d4 total:d3",
    """c AS (SELECT lat_key, lon_key, date, v FROM cube),
       x AS (SELECT a.lat_key, a.lon_key, a.date, a.v AS cv, i, j, COALESCE(b.v, a.v) AS v FROM c a
         CROSS JOIN (VALUES (-1),(0),(1)) AS p(i) CROSS JOIN (VALUES (-1),(0),(1)) AS q(j)
         LEFT JOIN c b ON b.lat_key=a.lat_key+i AND b.lon_key=a.lon_key+5*j AND b.date=a.date)
       SELECT lat_key, lon_key, date, MAX(v) FILTER (i=-1 AND j=1) AS corner, MAX(cv) AS centre, SUM(v) AS total
       FROM x GROUP BY 1,2,3""",
    "cube",
)
def e14_patch(t):
    rows = t.cube.select("lat_key", "lon_key", "date")
    out = series.spatial_patch(rows, t.cube, 1, (1, 5))
    at = lambda i, j: F.element_at(F.element_at("patch", i), j)
    total = F.aggregate(F.flatten("patch"), F.lit(0.0), lambda a, x: a + x.cast("double"))
    return out.withColumns({"corner": at(1, 3), "centre": at(2, 2), "total": total})
