"""Queries of evaluation tables, periods, calibration and models."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.catalog.metrics import G
from cindergrid.catalog.reports_q import MEMBERS, SPLIT, with_split
from cindergrid.functions import calendar, names
from cindergrid.operators import calibrate, evaluation, models, periods, regions
from cindergrid.plans import evaluations

# --- M14-M17 --------------------------------------------------------------------


@query(
    "m14_yearly_summary",
    "split year:i support:i tp:d1 precision:d9 recall:d9 f1:d9 average_precision:d9 roc_auc:d9 brier_score:d9 log_loss:d9 "
    "best_f1_threshold:d12 best_f1:d9 precision_at_positives:d9 ece:d9 probability_p95:d9 pos_median:d9 pos_p25:d9 "
    "neg_p90:d9 average_precision_lift:d7 normalized_average_precision:d9 f1_gap:d9 threshold_logit_delta:d7 score_gap:d9 "
    "ranking_difficulty:d7 auc_difficulty:d7 operational_difficulty:d7",
    f"""a AS (SELECT *, {SPLIT} AS split, YEAR(date) AS year FROM predictions),
      sc AS (SELECT split, year, prob_raw AS s, SUM(is_fire) AS pos, SUM(1-is_fire) AS neg FROM a GROUP BY 1,2,3),
      rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY split, year) AS tot,
        SUM(neg) OVER (PARTITION BY split, year) AS totn FROM sc WINDOW w AS (PARTITION BY split, year ORDER BY s DESC
        ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      rm AS (SELECT split, year, SUM(pos*tp/(tp+fp))/MAX(tot) AS ap, SUM(neg*(tp-pos/2))/(MAX(tot)*MAX(totn)) AS auc FROM rk GROUP BY 1,2),
      bf AS (SELECT split, year, s, f FROM (SELECT split, year, s, 2*(tp/(tp+fp))*(tp/tot)/(tp/(tp+fp)+tp/tot+1e-12) AS f,
        ROW_NUMBER() OVER (PARTITION BY split, year ORDER BY ROUND(2*(tp/(tp+fp))*(tp/tot)/(tp/(tp+fp)+tp/tot+1e-12),12) DESC, s) AS k FROM rk) WHERE k=1),
      tk AS (SELECT split, year, SUM(is_fire)/COUNT(*) AS pk FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY split, year ORDER BY prob_raw DESC, md5(row_id)) AS k,
        SUM(is_fire) OVER (PARTITION BY split, year) AS n FROM a) WHERE k<=n GROUP BY 1,2),
      eb AS (SELECT split, year, LEAST(CAST(FLOOR(prob_raw*10) AS INT),9) AS b, COUNT(*) AS n, AVG(prob_raw) AS mp, AVG(is_fire) AS my FROM a GROUP BY 1,2,3),
      ec AS (SELECT split, year, SUM(n*ABS(mp-my))/SUM(n) AS ece FROM eb GROUP BY 1,2),
      ag AS (SELECT split, year, COUNT(*) AS support, SUM(CASE WHEN prob_raw>=0.6E0 AND is_fire=1 THEN 1 ELSE 0 END) AS tp,
        SUM(CASE WHEN prob_raw>=0.6E0 AND is_fire=0 THEN 1 ELSE 0 END) AS fp, SUM(CASE WHEN prob_raw<0.6E0 AND is_fire=1 THEN 1 ELSE 0 END) AS fn,
        AVG(POWER(prob_raw-is_fire,2)) AS brier_score, -AVG(is_fire*LN(prob_raw)+(1-is_fire)*LN(1-prob_raw)) AS log_loss,
        AVG(is_fire) AS pi, quantile_cont(prob_raw,0.95) AS probability_p95, quantile_cont(prob_raw,0.5) FILTER (is_fire=1) AS pos_median,
        quantile_cont(prob_raw,0.25) FILTER (is_fire=1) AS pos_p25, quantile_cont(prob_raw,0.9) FILTER (is_fire=0) AS neg_p90,
        AVG(prob_raw) FILTER (is_fire=1)-AVG(prob_raw) FILTER (is_fire=0) AS score_gap FROM a GROUP BY 1,2),
      j AS (SELECT *, 2*tp/(2*tp+fp+fn) AS f1, (ap-pi)/(1-pi) AS nap FROM ag JOIN rm USING (split, year) JOIN bf USING (split, year)
        JOIN tk USING (split, year) JOIN ec USING (split, year))
      SELECT split, year, support, tp, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, f1, ap AS average_precision, auc AS roc_auc, brier_score, log_loss,
       s AS best_f1_threshold, f AS best_f1, pk AS precision_at_positives, ece, probability_p95, pos_median, pos_p25, neg_p90, ap/pi AS average_precision_lift,
       nap AS normalized_average_precision, f-f1 AS f1_gap, LN(s/(1-s))-LN(0.6E0/0.4E0) AS threshold_logit_delta, score_gap,
       100*(1-LEAST(GREATEST(nap,0),1)) AS ranking_difficulty, 100*(1-LEAST(GREATEST(auc,0.5E0),1))/0.5E0 AS auc_difficulty,
       100*(1-f1) AS operational_difficulty FROM j""",
    "predictions",
)
def m14(t):
    rows = with_split(t.predictions).withColumn("year", F.year("date"))
    return evaluation.yearly_summary(rows, 0.6, "row_id", p="prob_raw")


_SCOPED = MEMBERS + """, al AS (SELECT model_name, region, date, eval_weight AS w, prob_raw AS p, is_fire AS y FROM rg UNION ALL
    SELECT model_name, 'global', date, eval_weight, prob_raw, is_fire FROM predictions),
  so AS (SELECT model_name, region, 'all' AS scope, w, p, y FROM al UNION ALL SELECT model_name, region, CAST(YEAR(date) AS VARCHAR), w, p, y FROM al
    UNION ALL SELECT model_name, region, 'late', w, p, y FROM al WHERE date BETWEEN DATE '1999-07-01' AND DATE '2001-06-30'),
  sc AS (SELECT model_name, region, scope, p AS s, SUM(w*y) AS pos, SUM(w*(1-y)) AS neg FROM so GROUP BY 1,2,3,4),
  rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY model_name, region, scope) AS tot,
    SUM(neg) OVER (PARTITION BY model_name, region, scope) AS totn FROM sc
    WINDOW w AS (PARTITION BY model_name, region, scope ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""


@query(
    "m15_metric_table",
    "model_name region scope weighted_support:d3 observed:d3 expected:d4 brier_score:d9 log_loss:d9 count_ratio:d8 "
    "average_precision:d9 roc_auc:d9 max_f1:d9 max_f1_threshold:d12",
    _SCOPED + """, rm AS (SELECT model_name, region, scope, SUM(pos*tp/(tp+fp))/MAX(tot) AS average_precision,
        SUM(neg*(tp-pos/2))/(MAX(tot)*MAX(totn)) AS roc_auc FROM rk GROUP BY 1,2,3),
      bf AS (SELECT model_name, region, scope, s, f FROM (SELECT *, 2*tp/(tp+fp+tot) AS f, ROW_NUMBER() OVER (PARTITION BY model_name, region, scope
        ORDER BY ROUND(2*tp/(tp+fp+tot),12) DESC, s DESC) AS k FROM rk) WHERE k=1),
      ag AS (SELECT model_name, region, scope, SUM(w) AS weighted_support, SUM(w*y) AS observed, SUM(w*p) AS expected,
        SUM(w*POWER(p-y,2))/SUM(w) AS brier_score, -SUM(w*(y*LN(p)+(1-y)*LN(1-p)))/SUM(w) AS log_loss FROM so GROUP BY 1,2,3)
      SELECT ag.*, expected/observed AS count_ratio, average_precision, roc_auc, f AS max_f1, s AS max_f1_threshold FROM ag
      JOIN rm USING (model_name, region, scope) JOIN bf USING (model_name, region, scope)""",
    "predictions regions",
)
def m15(t):
    return evaluation.metric_table(
        t.predictions, t.regions, {"late": ("1999-07-01", "2001-06-30")}, p="prob_raw"
    )


@query(
    "m15_metric_errors",
    "model_name region scope average_precision:d9 average_precision_error:d6 roc_auc_error:d6",
)
def m15_errors(t):
    return evaluation.metric_table(t.predictions, t.regions, p="prob_raw", key="row_id", trials=4)


@query(
    "m16_spatial_scales",
    "model_name scale support:i weighted_support:d3 brier_score:d9 average_precision:d9 roc_auc:d9",
    """ps AS (SELECT DISTINCT model_name, date, lat_key+a AS lat_key, lon_key+b AS lon_key FROM predictions,
         (VALUES (-1),(0),(1)) AS x(a), (VALUES (-1),(0),(1)) AS y(b) WHERE is_fire=1),
       al AS (SELECT model_name, 'exact' AS scale, is_fire AS y, prob_raw AS p, eval_weight AS w FROM predictions UNION ALL
         SELECT p.model_name, '3x3', CASE WHEN ps.date IS NULL THEN 0 ELSE 1 END, prob_raw, eval_weight FROM predictions p LEFT JOIN ps
           ON ps.model_name=p.model_name AND ps.date=p.date AND ps.lat_key=p.lat_key AND ps.lon_key=p.lon_key UNION ALL
         SELECT model_name, '0.5deg', MAX(is_fire), ROUND(SUM(prob_raw*eval_weight)/SUM(eval_weight),12), SUM(eval_weight) FROM predictions
           GROUP BY model_name, date, FLOOR(lat_key/5), FLOOR(lon_key/5) UNION ALL
         SELECT model_name, '1deg', MAX(is_fire), ROUND(SUM(prob_raw*eval_weight)/SUM(eval_weight),12), SUM(eval_weight) FROM predictions
           GROUP BY model_name, date, FLOOR(lat_key/10), FLOOR(lon_key/10)),
       sc AS (SELECT model_name, scale, p AS s, SUM(w*y) AS pos, SUM(w*(1-y)) AS neg FROM al GROUP BY 1,2,3),
       rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM sc
         WINDOW w AS (PARTITION BY model_name, scale ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       rm AS (SELECT model_name, scale, SUM(pos*tp/(tp+fp))/SUM(pos) AS average_precision, SUM(neg*(tp-pos/2))/(SUM(pos)*SUM(neg)) AS roc_auc FROM rk GROUP BY 1,2),
       ag AS (SELECT model_name, scale, COUNT(*) AS support, SUM(w) AS weighted_support, SUM(w*POWER(p-y,2))/SUM(w) AS brier_score FROM al GROUP BY 1,2)
       SELECT * FROM ag JOIN rm USING (model_name, scale)""",
    "predictions",
)
def m16(t):
    return evaluation.spatial_scale_table(t.predictions, p="prob_raw")


@query(
    "m17_index_ranking",
    "model_name average_precision:d9 roc_auc:d9 threshold:d9 f1:d9 raw_threshold:d6",
    """x AS (SELECT model_name, is_fire, eval_weight, CASE WHEN lon_key%11=0 THEN NULL ELSE prob_raw*40-5 END AS ix FROM predictions),
       sp AS (SELECT MIN(ix) AS lo, MAX(ix) AS hi FROM x),
       sc AS (SELECT model_name, LEAST(GREATEST((ix-lo)/(hi-lo),1e-12),1-1e-12) AS s, SUM(eval_weight*is_fire) AS pos, SUM(eval_weight*(1-is_fire)) AS neg
         FROM x, sp WHERE ix IS NOT NULL GROUP BY 1,2),
       rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY model_name) AS tot, SUM(neg) OVER (PARTITION BY model_name) AS totn
         FROM sc WINDOW w AS (PARTITION BY model_name ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
       rm AS (SELECT model_name, SUM(pos*tp/(tp+fp))/MAX(tot) AS average_precision, SUM(neg*(tp-pos/2))/(MAX(tot)*MAX(totn)) AS roc_auc FROM rk GROUP BY 1),
       bf AS (SELECT model_name, s AS threshold, f AS f1 FROM (SELECT *, 2*tp/(tp+fp+tot) AS f, ROW_NUMBER() OVER (PARTITION BY model_name
         ORDER BY ROUND(2*tp/(tp+fp+tot),12) DESC, s DESC) AS k FROM rk) WHERE k=1)
       SELECT rm.*, threshold, f1, lo+threshold*(hi-lo) AS raw_threshold FROM rm JOIN bf USING (model_name), sp""",
    "predictions",
)
def m17(t):
    return evaluation.index_ranking(_with_index(t), "ix")


def _with_index(t):
    return t.predictions.withColumn(
        "ix", F.when(F.pmod("lon_key", F.lit(11)) != 0, F.col("prob_raw") * 40 - 5)
    )


@query(
    "m17_index_coverage", "month:t rows:i covered_rows:i days:i covered_days:i",
    """d AS (SELECT date, COUNT(*) AS n, COUNT(*) FILTER (lon_key%11<>0) AS k FROM predictions GROUP BY 1)
       SELECT date_trunc('month',date) AS month, SUM(n) AS rows, SUM(k) AS covered_rows, COUNT(*) AS days, COUNT(*) FILTER (k>0) AS covered_days FROM d GROUP BY 1""",
    "predictions",
)
def m17_coverage(t):
    return evaluation.index_coverage(_with_index(t), "ix")


# --- M18-M22 --------------------------------------------------------------------

_WIN = MEMBERS + """, al AS (SELECT region, date, lat_key, lon_key, eval_weight AS w, prob_raw AS p, is_fire AS y FROM rg UNION ALL
    SELECT 'global', date, lat_key, lon_key, eval_weight, prob_raw, is_fire FROM predictions),
  rd AS (SELECT region, MIN(date) AS d0, LEAST(MAX(date), (SELECT MAX(date) FROM predictions)-6) AS d1 FROM al GROUP BY 1),
  wi AS (SELECT al.*, date-CAST(k AS INT) AS st FROM al JOIN rd USING (region), range(0,7) AS r(k) WHERE date-CAST(k AS INT) BETWEEN d0 AND d1)"""
_PERIODS = _WIN + """, sc AS (SELECT region, st, p AS s, SUM(w*y) AS pos, SUM(w*(1-y)) AS neg FROM wi GROUP BY 1,2,3),
  rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp FROM sc
    WINDOW w AS (PARTITION BY region, st ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  rm AS (SELECT region, st, CASE WHEN SUM(pos)>0 AND SUM(neg)>0 THEN SUM(CASE WHEN pos>0 THEN pos*tp/(tp+fp) ELSE 0 END)/SUM(pos) END AS average_precision,
    CASE WHEN SUM(pos)>0 AND SUM(neg)>0 THEN SUM(neg*(tp-pos/2))/(SUM(pos)*SUM(neg)) END AS roc_auc FROM rk GROUP BY 1,2),
  ag AS (SELECT region, st, COUNT(*) AS support, SUM(w) AS weighted_support, SUM(y) AS positive_rows,
    COUNT(DISTINCT CASE WHEN y=1 THEN lat_key*100000+lon_key END) AS observed_positive_locations,
    SUM(p*w) AS expected, SUM(y*w) AS observed, SUM(w*POWER(p-y,2))/SUM(w) AS brier_score, MAX(p) AS max_probability FROM wi GROUP BY 1,2),
  pm AS (SELECT region, st AS period_start, st+6 AS period_end, support, weighted_support, positive_rows, observed_positive_locations, expected, observed,
    ABS(expected-observed) AS count_abs_error, CASE WHEN expected>0 AND observed>0 THEN ABS(LN(expected/observed)) END AS count_abs_log_error,
    average_precision, roc_auc, brier_score, max_probability FROM ag JOIN rm USING (region, st))"""


def _periods(t, radius=0.0, rankings=("exact",)):
    return periods.period_metrics(t.predictions, t.regions, 7, radius, p="prob_raw", rankings=rankings)


@query(
    "m18_period_metrics",
    "region period_start:t period_end:t support:i weighted_support:d3 positive_rows:i observed_positive_locations:i expected:d5 observed:d3 "
    "count_abs_error:d5 count_abs_log_error:d7 average_precision:d9 roc_auc:d9 brier_score:d9 max_probability:d12",
    _PERIODS + " SELECT * FROM pm", "predictions regions",
)
def m18(t):
    return _periods(t)


@query(
    "m18_tolerant_periods", "region period_start:t tolerant_positive_rows:i tolerant_positive_locations:i tolerant_brier_score:d9",
    _WIN + """, sp AS (SELECT region, st, lat_key, lon_key, MAX(y) AS y FROM wi GROUP BY 1,2,3,4),
      ps AS (SELECT * FROM sp WHERE y=1),
      k AS (SELECT region, st, GREATEST(COS(RADIANS(AVG(lat_key*0.1E0))),0.2E0) AS k FROM ps GROUP BY 1,2),
      h AS (SELECT DISTINCT sp.region, sp.st, sp.lat_key, sp.lon_key FROM sp JOIN ps USING (region, st) JOIN k USING (region, st)
        WHERE POWER((sp.lat_key-ps.lat_key)*0.1E0,2)+POWER((sp.lon_key-ps.lon_key)*0.1E0*k,2) <= 0.115E0*0.115E0),
      w2 AS (SELECT wi.*, CASE WHEN y=1 OR h.st IS NOT NULL THEN 1 ELSE 0 END AS ty FROM wi LEFT JOIN h ON h.region=wi.region AND h.st=wi.st
        AND h.lat_key=wi.lat_key AND h.lon_key=wi.lon_key)
      SELECT region, st AS period_start, SUM(ty) AS tolerant_positive_rows,
       COUNT(DISTINCT CASE WHEN ty=1 THEN lat_key*100000+lon_key END) AS tolerant_positive_locations,
       SUM(w*POWER(p-ty,2))/SUM(w) AS tolerant_brier_score FROM w2 GROUP BY 1,2""",
    "predictions regions",
)
def m18_tolerant(t):
    return _periods(t, 0.115, rankings=())


_GREEDY = """c1 AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY region ORDER BY {order}, period_start) AS k FROM {src}),
  g1 AS (SELECT * FROM c1 WHERE k=1),
  c2 AS (SELECT c1.*, ROW_NUMBER() OVER (PARTITION BY region ORDER BY c1.k) AS j FROM c1 JOIN g1 USING (region)
    WHERE NOT (c1.period_start<=g1.period_end AND c1.period_end>=g1.period_start)),
  g2 AS (SELECT * FROM c2 WHERE j=1),
  c3 AS (SELECT c2.*, ROW_NUMBER() OVER (PARTITION BY region ORDER BY c2.k) AS i FROM c2 JOIN g2 USING (region)
    WHERE NOT (c2.period_start<=g2.period_end AND c2.period_end>=g2.period_start)),
  g3 AS (SELECT * FROM c3 WHERE i=1),
  gp AS (SELECT region, 1 AS period_rank, period_start, period_end, average_precision FROM g1 UNION ALL
    SELECT region, 2, period_start, period_end, average_precision FROM g2 UNION ALL
    SELECT region, 3, period_start, period_end, average_precision FROM g3)"""
_BEST = "ok AS (SELECT * FROM pm WHERE observed_positive_locations>=5 AND average_precision IS NOT NULL)"


@query(
    "m19_best_periods", "region period_rank:i period_start:t period_end:t average_precision:d9",
    _PERIODS + "," + _BEST + "," + _GREEDY.format(src="ok", order="ROUND(average_precision,9) DESC, ROUND(count_abs_error,9), ROUND(brier_score,9)")
    + " SELECT * FROM gp",
    "predictions regions",
)
def m19(t):
    return periods.select_best_periods(_periods(t), "average_precision", min_positives=5)


_SHAPE = _PERIODS + """, od AS (SELECT region, date, SUM(y*w) AS o FROM al GROUP BY 1,2),
  sp AS (SELECT region, period_start, period_end, i, COALESCE(o,0) AS o FROM (SELECT region, period_start, period_end, i, period_start+CAST(i AS INT) AS date
    FROM pm, range(0,7) AS r(i)) z LEFT JOIN od USING (region, date)),
  sh AS (SELECT region, period_start, SUM(o) AS t, ARG_MAX(i, o*1000-i) AS pk, SUM(o*i)/NULLIF(SUM(o),0) AS cm,
    SUM(o) FILTER (i<2)/NULLIF(SUM(o),0) AS fq, SUM(o) FILTER (i>=1 AND i<6)/NULLIF(SUM(o),0) AS mh FROM sp GROUP BY 1,2),
  ac AS (SELECT pm.*, CASE WHEN t>0 THEN pk END AS observed_peak_day, cm AS observed_center_of_mass, fq AS first_quarter_fraction, mh AS middle_half_fraction,
    0.35E0*GREATEST(0,1-ABS((CASE WHEN t>0 THEN pk END)-3.0E0)/3)+0.30E0*GREATEST(0,1-ABS(cm-3.0E0)/3)+0.20E0*mh+0.15E0*GREATEST(0,1-fq) AS centered_activity_score
    FROM pm JOIN sh USING (region, period_start))"""


@query(
    "m20_activity_shape",
    "region period_start:t observed_peak_day:i observed_center_of_mass:d8 first_quarter_fraction:d8 middle_half_fraction:d8 centered_activity_score:d8",
    _SHAPE + """SELECT region, period_start, observed_peak_day, observed_center_of_mass, first_quarter_fraction, middle_half_fraction,
      CASE WHEN observed_peak_day IS NOT NULL THEN centered_activity_score END AS centered_activity_score FROM ac""",
    "predictions regions",
)
def m20(t):
    return periods.activity_shape(_periods(t), t.predictions, t.regions)


@query(
    "m20_centered_selection", "region period_rank:i period_start:t period_end:t average_precision:d9",
    _SHAPE + """, se AS (SELECT * FROM ac WHERE MONTH(period_start) NOT IN (12,1) AND MONTH(period_end) NOT IN (12,1)),
      ok AS (SELECT * FROM se WHERE observed_positive_locations>=5 AND average_precision IS NOT NULL AND observed_peak_day BETWEEN 1 AND 5
        AND first_quarter_fraction<=0.45E0 AND middle_half_fraction>=0.35E0),""" + _GREEDY.format(
        src="ok", order="ROUND(average_precision,9) DESC, ROUND(centered_activity_score,9) DESC, ROUND(count_abs_error,9), ROUND(brier_score,9)"
    ) + " SELECT * FROM gp",
    "predictions regions",
)
def m20_selection(t):
    shaped = periods.activity_shape(_periods(t), t.predictions, t.regions)
    shaped = shaped.withColumn("centered_activity_score", F.round("centered_activity_score", 12))
    kept = periods.season_filter(shaped, [12, 1])
    return periods.select_centered_periods(kept, "average_precision", min_positives=5)


_WINDOWS = """sel AS (SELECT region, date_trunc('month', MIN(date))+INTERVAL 18 MONTH AS period_start FROM al GROUP BY 1),
  se2 AS (SELECT region, CAST(period_start AS DATE) AS period_start, CAST(period_start AS DATE)+13 AS period_end, 1 AS period_rank FROM sel)"""


def _windows(t):
    rows = regions.region_rows(t.predictions, t.regions, include_global=True)
    first = rows.groupBy("region").agg(F.add_months(F.trunc(F.min("date"), "month"), 18).alias("period_start"))
    return first.select("region", "period_start", F.date_add("period_start", 13).alias("period_end"),
                        F.lit(1).alias("period_rank"))


@query(
    "m21_period_daily_series", "region date:t lead_day:i expected:d5 observed:d3 area_kha:d7",
    _WIN + "," + _WINDOWS + """, le AS (SELECT region, date, lat_key, lon_key, w, p, y, CAST(1+lon_key%3 AS BIGINT) AS lead_day FROM al),
      da AS (SELECT region, period_start, period_start+CAST(i AS INT) AS date FROM se2, range(0,14) AS r(i)),
      ex AS (SELECT region, date, lead_day, SUM(p*w) AS expected FROM le GROUP BY 1,2,3),
      ld AS (SELECT DISTINCT region, period_start, lead_day FROM da JOIN ex USING (region, date)),
      ob AS (SELECT region, date, SUM(y*w) AS observed FROM le GROUP BY 1,2),
      ar AS (SELECT region, date, SUM(6371.0088E0*6371.0088E0*RADIANS(0.1E0)*(SIN(RADIANS(lat_key*0.1E0)+RADIANS(0.05E0))-SIN(RADIANS(lat_key*0.1E0)-RADIANS(0.05E0)))/10) AS a
        FROM (SELECT DISTINCT region, date, lat_key, lon_key FROM le WHERE y=1) GROUP BY 1,2)
      SELECT da.region, da.date, lead_day, COALESCE(expected,0) AS expected, COALESCE(observed,0) AS observed, COALESCE(a,0) AS area_kha
      FROM da JOIN ld USING (region, period_start) LEFT JOIN ex USING (region, date, lead_day) LEFT JOIN ob USING (region, date) LEFT JOIN ar USING (region, date)""",
    "predictions regions",
)
def m21(t):
    p = t.predictions.withColumn("lead_hours", (F.pmod("lon_key", F.lit(3)) + 1) * 24)
    return periods.period_daily_series(p, _windows(t), t.regions, "lead_hours", p="prob_raw")


@query(
    "m22_aligned_periods", "region period_start:t period_end:t reference_rank:i average_precision:d9 support:i",
    _PERIODS + "," + _BEST + "," + _GREEDY.format(src="ok", order="ROUND(average_precision,9) DESC, ROUND(count_abs_error,9), ROUND(brier_score,9)") + """
      SELECT pm.region, pm.period_start, pm.period_end, period_rank AS reference_rank, pm.average_precision, support
      FROM pm JOIN gp ON gp.region=pm.region AND gp.period_start=pm.period_start AND gp.period_end=pm.period_end""",
    "predictions regions",
)
def m22(t):
    metrics = _periods(t)
    picks = periods.select_best_periods(metrics, "average_precision", min_positives=5)
    # every metric row once more with a worse score: the best of the two is kept
    worse = metrics.withColumn("average_precision", F.col("average_precision") - 1)
    return periods.align_to_reference(
        metrics.unionByName(worse), picks, [F.col("average_precision").desc_nulls_last()]
    )


# --- M23-M28 --------------------------------------------------------------------


def _monthly(t):
    return t.predictions.withColumn("month", F.month("date"))


_BALANCE = "month:i gap:d4 observed:d3"


def _balance(df, p="prob_calibrated"):
    w = F.col("eval_weight")
    return df.groupBy("month").agg(
        (F.sum(w * F.col(p)) / F.sum(w * F.col("is_fire")) - 1).alias("gap"),
        F.sum(w * F.col("is_fire")).alias("observed"),
    )


@query(
    "m23_platt", "month:i gap:d3 observed:d3",
    # an unpenalised fit with month dummies balances every month
    "SELECT MONTH(date) AS month, 0 AS gap, SUM(is_fire*eval_weight) AS observed FROM predictions GROUP BY 1", "predictions",
)
def m23(t):
    rows = _monthly(t)
    return _balance(calibrate.PlattCalibrator(["month", "country"]).fit(rows).apply(rows))


@query(
    "m24_prior_offsets", _BALANCE,
    "SELECT MONTH(date) AS month, 0 AS gap, SUM(is_fire*eval_weight) AS observed FROM predictions GROUP BY 1", "predictions",
)
def m24(t):
    rows = _monthly(t)
    offsets = calibrate.fit_offsets(rows, ["month"])
    return _balance(calibrate.apply_offsets(rows, offsets, ["month"]))


@query(
    "m25_calibration_metadata",
    "method rows:i positives:i weighted_support:d3 observed:d3 expected_before:d4 expected_after:d4 first_date:t last_date:t prevalence:d9 ratio_before:d8 ratio_after:d8",
    """SELECT 'scaled' AS method, COUNT(*) AS rows, SUM(is_fire) AS positives, SUM(eval_weight) AS weighted_support, SUM(eval_weight*is_fire) AS observed,
       SUM(eval_weight*prob_raw) AS expected_before, SUM(eval_weight*prob_raw*0.5E0) AS expected_after, MIN(date) AS first_date, MAX(date) AS last_date,
       SUM(eval_weight*is_fire)/SUM(eval_weight) AS prevalence, SUM(eval_weight*prob_raw)/SUM(eval_weight*is_fire) AS ratio_before,
       SUM(eval_weight*prob_raw*0.5E0)/SUM(eval_weight*is_fire) AS ratio_after FROM predictions""",
    "predictions",
)
def m25(t):
    rows = t.predictions.withColumn("prob_calibrated", F.col("prob_raw") * 0.5)
    return calibrate.calibration_metadata(rows, "scaled")


@query(
    "m26_platt_prevalence", "method rows:i observed:d3 ratio_after:d6",
    """SELECT 'platt' AS method, COUNT(*) AS rows, SUM(eval_weight*is_fire) AS observed, 1 AS ratio_after FROM predictions""",
    "predictions",
)
def m26(t):
    return calibrate.platt_with_prevalence(t.predictions)[1]


@query(
    "m27_quantile_map", "key mapped:d3",
    """s AS (SELECT row_id, ROW_NUMBER() OVER (ORDER BY prob_raw, md5(row_id))-1 AS i, COUNT(*) OVER () AS n FROM predictions),
       tr AS (SELECT v, ROW_NUMBER() OVER (ORDER BY v)-1 AS i, COUNT(*) OVER () AS m FROM cube)
       SELECT row_id AS key, v AS mapped FROM s, (SELECT MAX(m) AS m FROM tr) z JOIN tr ON tr.i=CAST(FLOOR(CAST(s.i AS DOUBLE)*(z.m-1)/(s.n-1)) AS BIGINT)""",
    "predictions cube",
)
def m27(t):
    scores = t.predictions.select(F.col("row_id").alias("key"), F.col("prob_raw").alias("score"))
    return calibrate.quantile_map(scores, t.cube.select(F.col("v").alias("truth")))


@query(
    "m27_ratio_threshold", "event_rate:d9 threshold:d9",
    """r AS (SELECT AVG(is_fire) AS f, COUNT(*) AS n FROM predictions), o AS (SELECT prob_raw AS p, ROW_NUMBER() OVER (ORDER BY prob_raw)-1 AS i FROM predictions),
       h AS (SELECT f, (1-f)*(n-1) AS h FROM r)
       SELECT f AS event_rate, MAX(p) FILTER (i=FLOOR(h))+(MAX(p) FILTER (i=CEIL(h))-MAX(p) FILTER (i=FLOOR(h)))*(MAX(h)-FLOOR(MAX(h))) AS threshold
       FROM o, h GROUP BY f""",
    "predictions",
)
def m27_threshold(t):
    scores = t.predictions.select(F.col("prob_raw").alias("score"))
    return calibrate.ratio_threshold(scores, t.predictions.select(F.col("is_fire").alias("truth")))


_POLICY = f"""a AS (SELECT p.*, {SPLIT} AS split, CASE WHEN MONTH(date) IN (12,1,2) THEN 'winter' WHEN MONTH(date) IN (3,4,5)
     THEN 'spring' WHEN MONTH(date) IN (6,7,8) THEN 'summer' ELSE 'autumn' END AS season FROM predictions p),
  rx AS (SELECT row_id, r_name, ROW_NUMBER() OVER (PARTITION BY row_id ORDER BY r_regionkey) AS k FROM predictions JOIN regions
     ON lat_key BETWEEN lat_min AND lat_max AND lon_key BETWEEN lon_min AND lon_max),
  b AS (SELECT a.*, COALESCE(r_name,'other')||'|'||season AS grp FROM a LEFT JOIN rx ON rx.row_id=a.row_id AND k=1),
  va AS (SELECT grp, prob_raw, is_fire FROM b WHERE split='validation' UNION ALL SELECT '<all>', prob_raw, is_fire FROM b WHERE split='validation'),
  sc AS (SELECT grp, prob_raw AS s, SUM(is_fire) AS pos, SUM(1-is_fire) AS neg FROM va GROUP BY 1,2),
  rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(pos) OVER (PARTITION BY grp) AS tot FROM sc
    WINDOW w AS (PARTITION BY grp ORDER BY s DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  ff AS (SELECT grp, s, 2*(tp/(tp+fp))*(tp/tot)/(tp/(tp+fp)+tp/tot+1e-12) AS f FROM rk),
  bf AS (SELECT grp, s, f FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY grp ORDER BY ROUND(f,12) DESC, s) AS k FROM ff) WHERE k=1),
  sz AS (SELECT grp, COUNT(*) AS support, SUM(is_fire) AS positives FROM va WHERE grp<>'<all>' GROUP BY 1),
  pl AS (SELECT sz.grp, support, positives, support-positives AS negatives, support>=600 AND positives>=20 AND support-positives>=20 AS ok, bf.s, bf.f,
    (SELECT s FROM bf WHERE grp='<all>') AS g FROM sz JOIN bf ON bf.grp=sz.grp)"""


def _policy_rows(t):
    rows = with_split(t.predictions).withColumn("season", calendar.season(F.month("date")))
    return regions.first_region(rows, t.regions)


def _policy(t):
    rows = _policy_rows(t).filter("split = 'validation'")
    return calibrate.threshold_policy(rows, "region_season", "prob_raw", min_rows=600)


@query(
    "m28_threshold_policy", "group_name support:i positives:i negatives:i threshold:d12 validation_f1:d9 reason",
    _POLICY + """SELECT grp AS group_name, support, positives, negatives, CASE WHEN ok THEN s ELSE g END AS threshold, CASE WHEN ok THEN f END AS validation_f1,
      CASE WHEN ok THEN 'validation_f1_max' ELSE 'too_few_rows' END AS reason FROM pl""",
    "predictions regions",
)
def m28(t):
    return _policy(t).withColumnRenamed("group", "group_name")


@query(
    "m28_policy_metrics", "region tp:d1 fp:d1 fn:d1 tn:d1 f1:d9",
    _POLICY + """, te AS (SELECT split_part(b.grp,'|',1) AS region, is_fire, CASE WHEN prob_raw >= COALESCE(CASE WHEN ok THEN s ELSE g END, (SELECT MAX(g) FROM pl))
        THEN 1 ELSE 0 END AS pred FROM b LEFT JOIN pl ON pl.grp=b.grp WHERE split='test'),
      c AS (SELECT region, SUM(is_fire*pred) AS tp, SUM((1-is_fire)*pred) AS fp, SUM(is_fire*(1-pred)) AS fn, SUM((1-is_fire)*(1-pred)) AS tn FROM te GROUP BY 1)
      SELECT *, 2*tp/(2*tp+fp+fn) AS f1 FROM c""",
    "predictions regions",
)
def m28_metrics(t):
    from cindergrid.operators.ranking import threshold_metrics

    test = _policy_rows(t).filter("split = 'test'")
    scored = calibrate.apply_policy(test, _policy(t), "region_season", "prob_raw")
    return threshold_metrics(scored, 0.5, p="pred", group=["region"])


# --- M29, M30, N ----------------------------------------------------------------

NUMERIC = ["lat_key", "lon_key", "month", "hint", "load"]


def _features(t):
    """Model inputs whose signal is a noisy view of the label."""
    p = t.predictions.withColumn("month", F.month("date"))
    return p.withColumns(
        {
            "hint": F.col("prob_raw") + 0.3 * F.col("is_fire"),
            "load": F.when(F.pmod("lon_key", F.lit(7)) != 0, F.col("eval_weight")),
        }
    ).drop("prob_raw")


TRAIN, TEST = "date < '1999-01-01'", "date >= '1999-01-01'"
_MODEL_SHAPE = "model_name average_precision:d6 roc_auc:d6"


def _model_query(name, fit):
    @query(name, _MODEL_SHAPE)
    def build(t):
        from cindergrid.operators.ranking import ranked_once, ranking_from_prefix

        rows = _features(t)
        scored = fit(rows.filter(TRAIN)).score(rows.filter(TEST))
        return ranking_from_prefix(ranked_once(scored, p="prob_raw", group=G), G)

    return build


_model_query("n1_logistic", lambda d: models.fit_logistic(d, NUMERIC, ["country"], weight="eval_weight"))
_model_query("n2_poisson_rate", lambda d: models.fit_poisson(d, NUMERIC))
_model_query("n3_random_forest", lambda d: models.fit_forest(d, NUMERIC, ["country"]))
_model_query("n4_boosted_trees", lambda d: models.fit_boosted(d, NUMERIC, ["country"], weight="eval_weight"))


def _equations(rows, residual):
    """Weighted sums of residual times input, relative to the input's; zero for a fitted model."""
    inputs = {"one": F.lit(1.0), **{c: F.col(c).cast("double") for c in ("lat_key", "month", "hint")}}
    w = F.col("eval_weight") * residual
    sums = rows.agg(*[(F.sum(w * x) / F.sum(F.col("eval_weight") * x)).alias(n) for n, x in inputs.items()])
    return sums.select(F.explode(F.map_from_arrays(F.array(*map(F.lit, inputs)), F.array(*map(F.col, inputs)))).alias("input", "gap"))


_ZERO = "SELECT input, 0 AS gap FROM (VALUES ('one'), ('lat_key'), ('month'), ('hint')) AS v(input)"


@query("n1_score_equations", "input gap:d3", _ZERO)
def n1_equations(t):
    rows = _features(t).filter(TRAIN)
    scored = models.fit_logistic(rows, NUMERIC, ["country"], weight="eval_weight").score(rows)
    return _equations(scored, F.col("prob_raw") - F.col("is_fire"))


@query("n2_score_equations", "input gap:d3", _ZERO)
def n2_equations(t):
    rows = _features(t).filter(TRAIN)
    scored = models.fit_poisson(rows, NUMERIC, weight="eval_weight").score(rows)
    # the rate behind the probability; positives weigh more in the fit
    rate = -F.log1p(-F.col("prob_raw"))
    boost = F.when(F.col("is_fire") > 0, models.POISSON_POSITIVE_WEIGHT).otherwise(1.0)
    return _equations(scored, boost * (rate - F.col("is_fire")))


@query("m29_permutation_importance", "feature_group mean_drop:d6 std_drop:d6 trials:i")
def m29(t):
    rows = _features(t).select("row_id", "date", *NUMERIC, "is_fire", "eval_weight")
    model = models.fit_logistic(rows.filter(TRAIN), NUMERIC)
    groups = {"hint": ["hint"], "place": ["lat_key", "lon_key"], "season": ["month"]}
    return evaluation.permutation_importance(
        rows.filter(TEST).drop("date"), model.score, groups, "row_id", trials=2, p="prob_raw"
    )


@query("m30_label_sensitivity", "variant support:i brier_score:d6 average_precision:d6 roc_auc:d6")
def m30(t):
    rows = _features(t).drop("is_fire")
    p = t.predictions
    labels = {
        "standard": p.filter("is_fire = 1"),
        "strict": p.filter("is_fire = 1 and eval_weight > 20"),
    }
    return evaluations.label_sensitivity(rows, labels, NUMERIC, TRAIN, TEST, ratios=(None, 1.0))


@query(
    "m30_label_support", "variant support:i",
    """SELECT l||':'||r AS variant, (SELECT COUNT(*) FROM predictions WHERE date >= DATE '1999-01-01') AS support
       FROM (VALUES ('standard'), ('strict')) AS a(l), (VALUES ('all'), ('1.0')) AS b(r)""",
    "predictions",
)
def m30_support(t):
    return m30(t).select("variant", "support")


@query("m30_lead_sensitivity", "lead_days:i support:i average_precision:d6 roc_auc:d6")
def m30_lead(t):
    rows = _features(t).withColumns(
        {"t2m_mean_7": F.col("hint"), "t2m_mean_30": F.col("load"), "elevation": F.col("lat_key")}
    )
    # the columns each lead time may use, decided by the feature catalogue
    known = ["t2m_mean_7", "t2m_mean_30", "elevation"]
    table = t.spark.createDataFrame([(c,) for c in known], "feature string")
    catalogue = names.feature_catalogue(table)
    by_lead = {
        lead: [r["feature"] for r in names.lead_limited(catalogue, lead).select("feature").collect()]
        for lead in (7, 30)
    }
    return evaluations.lead_sensitivity(rows, by_lead, TRAIN, TEST)


@query("n5_calibrated_evaluation", "model_name region scope weighted_support:d3 observed:d3 average_precision:d6 count_ratio:d4")
def n5(t):
    rows = _features(t)
    model = models.fit_logistic(rows.filter(TRAIN), NUMERIC, weight="eval_weight")
    tables = evaluations.calibrated_evaluation(
        model, rows.filter("year(date) = 1999"), rows.filter("year(date) >= 2000"), t.regions
    )
    return tables["metrics"]


@query("n6_forecast", "lat_key:i lon_key:i date:t score:d9")
def n6(t):
    from cindergrid.operators import series

    names_ = ["v_mean_7", "v_max_30", "v_lag_1"]
    rows = t.predictions.filter("date < '1999-01-01'").withColumn("month", F.month("date"))
    cells = t.cube.select("lat_key", "lon_key").distinct()
    known = rows.join(cells, ["lat_key", "lon_key"], "left_semi")
    train = series.add_features(series.lookback(known, t.cube, 30), names_, {"v": "series"})
    numeric = [*names_, "month", "static"]
    static = t.raster.groupBy(
        (F.pmod("r", F.lit(20)) + 500).cast("long").alias("lat_key"),
        (F.floor(F.pmod("c", F.lit(25)) / 5) * 5 + 1000).cast("long").alias("lon_key"),
    ).agg(F.avg("v").alias("static"))
    model = models.fit_logistic(train.join(static, ["lat_key", "lon_key"], "left"), numeric)
    return evaluations.forecast(model, cells, t.cube, static, "1999-06-30", 5, 30, names_, numeric)


@query(
    "n6_forecast_days", "lat_key:i lon_key:i date:t scored:i",
    """SELECT lat_key, lon_key, DATE '1999-06-30' + CAST(i AS INT) AS date, 1 AS scored
       FROM (SELECT DISTINCT lat_key, lon_key FROM cube), range(1, 6) AS r(i)""",
    "cube",
)
def n6_days(t):
    inside = F.col("score").between(0.0, 1.0)
    return n6(t).groupBy("lat_key", "lon_key", "date").agg(F.sum(F.when(inside, 1).otherwise(0)).alias("scored"))


@query(
    "n7_diagnostics", "model_name region period_start:t weighted_support:d3 expected:d4 observed:d3 error:d4",
    MEMBERS + """, d AS (SELECT DISTINCT date, date_trunc('month',date) AS m FROM predictions),
      i AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY m ORDER BY date)-1 AS i, COUNT(*) OVER (PARTITION BY m) AS n FROM d),
      k AS (SELECT * FROM i WHERE n<=10 OR list_contains(list_transform(range(0,10), lambda j: CAST(round_even(j*(n-1)/9.0E0,0) AS BIGINT)), i)),
      f AS (SELECT date, n/COUNT(*) OVER (PARTITION BY m) AS f FROM k),
      se AS (SELECT MONTH(date) AS month, SUM(prob_raw*eval_weight*f) AS e FROM predictions JOIN f USING (date) GROUP BY 1),
      sm AS (SELECT MONTH(date) AS month, SUM(is_fire*eval_weight) AS o FROM predictions GROUP BY 1),
      sc AS (SELECT month, o/e AS scale FROM sm JOIN se USING (month)),
      pe AS (SELECT model_name, region, date_trunc('month',date) AS ps, SUM(prob_raw*eval_weight*f) AS e FROM rg JOIN f USING (date) GROUP BY 1,2,3),
      po AS (SELECT model_name, region, date_trunc('month',date) AS ps, SUM(eval_weight) AS w, SUM(is_fire*eval_weight) AS o FROM rg GROUP BY 1,2,3),
      x AS (SELECT po.*, LEAST(COALESCE(e,0)*scale, w) AS e FROM po LEFT JOIN pe USING (model_name, region, ps) JOIN sc ON sc.month=MONTH(ps))
      SELECT model_name, region, ps AS period_start, w AS weighted_support, e AS expected, o AS observed, e-o AS error FROM x""",
    "predictions regions",
)
def n7(t):
    return evaluations.diagnostics(t.predictions, t.regions, days_per_month=10)["series"]


@query("n8_source_comparison", "trained_on tested_on support:i average_precision:d5 roc_auc:d5")
def n8(t):
    other = t.cube.filter("lat_key < 515").withColumn("v", F.col("v") * 0.9 + 3)
    rows = _features(t)
    return evaluations.source_comparison(
        rows, t.cube, other, 30, ["v_mean_7", "v_max_30"], ["lat_key", "month", "hint"], TRAIN, TEST
    )


@query(
    "n9_timelines", "region date:t expected:d4 observed:d3 area_kha:d6",
    _SHAPE + """, ok AS (SELECT * FROM ac WHERE observed_positive_locations>=1 AND average_precision IS NOT NULL AND observed_peak_day BETWEEN 1 AND 5
        AND first_quarter_fraction<=0.45E0 AND middle_half_fraction>=0.35E0),""" + _GREEDY.format(
        src="ok", order="ROUND(average_precision,9) DESC, ROUND(centered_activity_score,9) DESC, ROUND(count_abs_error,9), ROUND(brier_score,9)"
    ) + """, da AS (SELECT region, period_start+CAST(i AS INT) AS date FROM gp, range(0,7) AS r(i) WHERE period_rank<=2),
      ex AS (SELECT region, date, SUM(p*w) AS e, SUM(y*w) AS o FROM al GROUP BY 1,2),
      ar AS (SELECT region, date, SUM(6371.0088E0*6371.0088E0*RADIANS(0.1E0)*(SIN(RADIANS(lat_key*0.1E0)+RADIANS(0.05E0))-SIN(RADIANS(lat_key*0.1E0)-RADIANS(0.05E0)))/10) AS a
        FROM (SELECT DISTINCT region, date, lat_key, lon_key FROM al WHERE y=1) GROUP BY 1,2)
      SELECT da.region, da.date, COALESCE(e,0) AS expected, COALESCE(o,0) AS observed, COALESCE(a,0) AS area_kha
      FROM da LEFT JOIN ex USING (region, date) LEFT JOIN ar USING (region, date)""",
    "predictions regions",
)
def n9(t):
    return evaluations.timelines(t.predictions, t.regions)["series"]
