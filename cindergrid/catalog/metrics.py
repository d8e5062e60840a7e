"""Queries of the ranking, reliability and threshold metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from cindergrid.catalog.base import query
from cindergrid.functions.probability import logit, sigmoid
from cindergrid.operators import ranking

G = ["model_name"]
P = dict(p="prob_raw", w="eval_weight", group=G)

# running positives and weight from the top, one row per (model, score)
RANKED = """
sc AS (SELECT model_name, prob_raw AS s, SUM(eval_weight*is_fire) AS pos,
              SUM(eval_weight*(1-is_fire)) AS neg, COUNT(*) AS n
       FROM predictions GROUP BY 1,2),
rk AS (SELECT *, SUM(pos) OVER w AS tp, SUM(neg) OVER w AS fp, SUM(n) OVER w AS nn,
              SUM(pos) OVER (PARTITION BY model_name) AS tot,
              SUM(neg) OVER (PARTITION BY model_name) AS totn
       FROM sc WINDOW w AS (PARTITION BY model_name ORDER BY s DESC
                            ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""
UNWEIGHTED = RANKED.replace("eval_weight*is_fire", "is_fire").replace(
    "eval_weight*(1-is_fire)", "1-is_fire"
)

# rows in score order, ties by md5 of the row key
ROWS_DOWN = """
ro AS (SELECT *, SUM(eval_weight) OVER w AS cw, ROW_NUMBER() OVER w AS rn,
              SUM(eval_weight) OVER (PARTITION BY model_name) AS tw,
              SUM(eval_weight*is_fire) OVER (PARTITION BY model_name) AS tpos,
              SUM(is_fire) OVER (PARTITION BY model_name) AS kpos
       FROM predictions
       WINDOW w AS (PARTITION BY model_name ORDER BY prob_raw DESC, md5(row_id)
                    ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))
"""


@query(
    "m1_brier_logloss",
    "model_name support:i weighted_support:d4 brier_score:d9 log_loss:d9 mean_probability:d9 prevalence:d9",
    """SELECT model_name, COUNT(*) AS support, SUM(eval_weight) AS weighted_support,
       SUM(eval_weight*POWER(prob_raw-is_fire,2))/SUM(eval_weight) AS brier_score,
       -SUM(eval_weight*(is_fire*LN(prob_raw)+(1-is_fire)*LN(1-prob_raw)))/SUM(eval_weight) AS log_loss,
       SUM(eval_weight*prob_raw)/SUM(eval_weight) AS mean_probability,
       SUM(eval_weight*is_fire)/SUM(eval_weight) AS prevalence
       FROM predictions GROUP BY 1""",
    "predictions",
)
def m1(t):
    return ranking.weighted_scores(t.predictions, **P)


@query(
    "m2_average_precision", "model_name average_precision:d9",
    RANKED + "SELECT model_name, SUM(pos*tp/(tp+fp))/MAX(tot) AS average_precision FROM rk GROUP BY 1",
    "predictions",
)
def m2(t):
    return ranking.ranking_metrics(t.predictions, **P)


@query(
    "m3_roc_auc", "model_name roc_auc:d9",
    RANKED + "SELECT model_name, SUM(neg*(tp-pos/2))/(MAX(tot)*MAX(totn)) AS roc_auc FROM rk GROUP BY 1",
    "predictions",
)
def m3(t):
    return ranking.ranking_metrics(t.predictions, **P)


# scores and weights that are missing or not a number in some rows
_GAPS = """, CASE WHEN lat_key % 7 = 0 THEN NULL WHEN lon_key % 11 = 0 THEN CAST('NaN' AS DOUBLE) ELSE prob_raw END AS p,
    CASE WHEN lat_key % 5 = 0 AND lon_key % 3 = 0 THEN NULL ELSE eval_weight END AS w FROM predictions"""
_VALID = "WHERE p IS NOT NULL AND NOT ISNAN(p) AND w IS NOT NULL"


def _gaps(t):
    c = F.col
    return t.predictions.withColumns(
        {
            "p": F.when(c("lat_key") % 7 == 0, None).when(c("lon_key") % 11 == 0, float("nan")).otherwise(c("prob_raw")),
            "w": F.when((c("lat_key") % 5 == 0) & (c("lon_key") % 3 == 0), None).otherwise(c("eval_weight")),
        }
    )


@query(
    "m1_missing_scores",
    "model_name support:i weighted_support:d4 brier_score:d9 log_loss:d9 mean_probability:d9 prevalence:d9",
    f"""g AS (SELECT model_name, is_fire{_GAPS})
       SELECT model_name, COUNT(*) AS support, SUM(w) AS weighted_support, SUM(w*POWER(p-is_fire,2))/SUM(w) AS brier_score,
       -SUM(w*(is_fire*LN(p)+(1-is_fire)*LN(1-p)))/SUM(w) AS log_loss, SUM(w*p)/SUM(w) AS mean_probability,
       SUM(w*is_fire)/SUM(w) AS prevalence FROM g {_VALID} GROUP BY 1""",
    "predictions",
)
def m1_missing(t):
    return ranking.weighted_scores(_gaps(t), p="p", w="w", group=G)


@query(
    "m3_missing_scores", "model_name average_precision:d9 roc_auc:d9",
    f"""g AS (SELECT model_name, is_fire{_GAPS}),
      """ + RANKED.replace("FROM predictions", f"FROM g {_VALID}").replace("prob_raw", "p").replace("eval_weight", "w")
    + """SELECT model_name, SUM(pos*tp/(tp+fp))/MAX(tot) AS average_precision,
        SUM(neg*(tp-pos/2))/(MAX(tot)*MAX(totn)) AS roc_auc FROM rk GROUP BY 1""",
    "predictions",
)
def m3_missing(t):
    return ranking.ranking_metrics(_gaps(t), p="p", w="w", group=G)


@query(
    "m4_threshold_metrics",
    "model_name tp:d1 fp:d1 fn:d1 tn:d1 precision:d9 recall:d9 f1:d9 accuracy:d9 fpr:d9 fnr:d9",
    """c AS (SELECT model_name,
        SUM(CASE WHEN prob_raw>=0.6E0 AND is_fire=1 THEN 1 ELSE 0 END) AS tp,
        SUM(CASE WHEN prob_raw>=0.6E0 AND is_fire=0 THEN 1 ELSE 0 END) AS fp,
        SUM(CASE WHEN prob_raw<0.6E0 AND is_fire=1 THEN 1 ELSE 0 END) AS fn,
        SUM(CASE WHEN prob_raw<0.6E0 AND is_fire=0 THEN 1 ELSE 0 END) AS tn
       FROM predictions GROUP BY 1)
       SELECT *, tp/(tp+fp) AS precision, tp/(tp+fn) AS recall, 2*tp/(2*tp+fp+fn) AS f1,
         (tp+tn)/(tp+fp+fn+tn) AS accuracy, fp/(fp+tn) AS fpr, fn/(fn+tp) AS fnr FROM c""",
    "predictions",
)
def m4(t):
    return ranking.threshold_metrics(t.predictions, 0.6, p="prob_raw", group=G)


@query(
    "m5_pr_curve_sampled",
    "model_name threshold:d12 precision:d9 recall:d9 point:i points:i",
    RANKED + """, cu AS (SELECT model_name, s AS threshold, tp/(tp+fp) AS precision, tp/tot AS recall,
         ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY s DESC) AS point,
         COUNT(*) OVER (PARTITION BY model_name) AS points FROM rk),
       slots AS (SELECT DISTINCT model_name,
           CAST(FLOOR(CAST(j AS DOUBLE)*(points-1)/499) AS BIGINT)+1 AS point
         FROM (SELECT DISTINCT model_name, points FROM cu), range(500) AS r(j))
       SELECT cu.* FROM cu JOIN slots USING (model_name, point)""",
    "predictions",
)
def m5(t):
    return ranking.pr_curve_sampled(ranking.pr_curve(t.predictions, **P), 500)


_BIN_SELECT = """SELECT model_name, bin, COUNT(*) AS n_unweighted, SUM(eval_weight) AS n_weighted,
   MIN(prob_raw) AS prob_min, MAX(prob_raw) AS prob_max,
   SUM(prob_raw*eval_weight)/SUM(eval_weight) AS mean_predicted_probability,
   SUM(is_fire*eval_weight)/SUM(eval_weight) AS observed_prevalence,
   SUM(prob_raw*eval_weight) AS expected, SUM(is_fire*eval_weight) AS observed,
   SUM(prob_raw*eval_weight)/SUM(is_fire*eval_weight) AS expected_observed_count_ratio
   FROM b GROUP BY 1,2"""
_BIN_SHAPE = (
    "model_name bin:i n_unweighted:i n_weighted:d3 prob_min:d12 prob_max:d12 "
    "mean_predicted_probability:d9 observed_prevalence:d9 expected:d5 observed:d3 "
    "expected_observed_count_ratio:d7"
)
_ROWS_UP = """ro AS (SELECT *, SUM(eval_weight) OVER (PARTITION BY model_name
      ORDER BY prob_raw, md5(row_id) ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cw,
      SUM(eval_weight) OVER (PARTITION BY model_name) AS tw FROM predictions)"""
_EQUAL_COUNT = _ROWS_UP + """, b AS (SELECT model_name, is_fire, eval_weight, prob_raw,
    len(list_filter(range(1,20), lambda k: tw*k/20 < cw)) AS bin FROM ro)"""


@query("m6_reliability_equal_count", _BIN_SHAPE, _EQUAL_COUNT + _BIN_SELECT, "predictions")
def m6(t):
    return ranking.reliability_bins(t.predictions, 20, "equal_count", "row_id", **P)


@query(
    "m6_reliability_equal_width", _BIN_SHAPE,
    "b AS (SELECT *, LEAST(CAST(FLOOR(prob_raw*16) AS INT), 15) AS bin FROM predictions) " + _BIN_SELECT,
    "predictions",
)
def m6_width(t):
    return ranking.reliability_bins(t.predictions, 16, "equal_width", **P)


@query(
    "m6_reliability_log", _BIN_SHAPE,
    """b AS (SELECT *, len(list_filter([1e-6,1e-5,1e-4,1e-3,1e-2,1e-1], lambda e: prob_raw >= CAST(e AS DOUBLE)))
       AS bin FROM predictions) """ + _BIN_SELECT,
    "predictions",
)
def m6_log(t):
    return ranking.reliability_bins(t.predictions, 7, "log", **P)


@query(
    "m7_reliability_summary",
    "model_name reliability_ece:d9 reliability_mce:d9 reliability_rmse:d9",
    _EQUAL_COUNT + f""", bt AS ({_BIN_SELECT}),
      e AS (SELECT *, ABS(mean_predicted_probability-observed_prevalence) AS er FROM bt)
      SELECT model_name, SUM(n_weighted*er)/SUM(n_weighted) AS reliability_ece,
        MAX(er) AS reliability_mce, SQRT(SUM(n_weighted*er*er)/SUM(n_weighted)) AS reliability_rmse
      FROM e GROUP BY 1""",
    "predictions",
)
def m7(t):
    bins = ranking.reliability_bins(t.predictions, 20, "equal_count", "row_id", **P)
    return ranking.reliability_summary(bins, G)


@query(
    "m7_ece_uniform", "model_name ece:d9",
    """b AS (SELECT model_name, LEAST(CAST(FLOOR(prob_raw*10) AS INT), 9) AS bin, COUNT(*) AS n,
        AVG(prob_raw) AS mp, AVG(is_fire) AS my FROM predictions GROUP BY 1,2)
       SELECT model_name, SUM(n*ABS(mp-my))/SUM(n) AS ece FROM b GROUP BY 1""",
    "predictions",
)
def m7_uniform(t):
    return ranking.ece_uniform(t.predictions, p="prob_raw", group=G)


@query("m8_calibration_line", "model_name calibration_slope:d7 calibration_intercept:d7")
def m8(t):
    return ranking.calibration_line(t.predictions, **P)


@query(
    "m8_score_equations", "model_name residual:d4 residual_x:d4 observed:d3",
    # at the optimum of an unpenalised logistic fit both weighted residual sums vanish
    "SELECT model_name, 0 AS residual, 0 AS residual_x, SUM(is_fire*eval_weight) AS observed FROM predictions GROUP BY 1",
    "predictions",
)
def m8_equations(t):
    line = ranking.calibration_line(t.predictions, **P)
    x = logit("prob_raw")
    mu = sigmoid(F.col("calibration_intercept") + F.col("calibration_slope") * x)
    r = F.col("eval_weight") * (F.col("is_fire") - mu)
    # one row per model: a sorted join would lay all rows of a model into one task
    return t.predictions.join(F.broadcast(line), "model_name").groupBy("model_name").agg(
        F.sum(r).alias("residual"), F.sum(r * x).alias("residual_x"),
        F.sum(F.col("is_fire") * F.col("eval_weight")).alias("observed"),
    )


@query(
    "m9_risk_concentration",
    "model_name q_label top_fraction_observed:d9 top_weighted_support:d3 captured_positives:d3 "
    "observed_positives:d3 recall_at_top_q:d9 precision_at_top_q:d9 lift_at_q:d7 "
    "average_precision:d9 observed_prevalence:d9 ap_lift:d7",
    RANKED + "," + ROWS_DOWN + """,
     ap AS (SELECT model_name, SUM(pos*tp/(tp+fp))/MAX(tot) AS average_precision FROM rk GROUP BY 1),
     q AS (SELECT * FROM (VALUES ('top_0.1pct',0.001E0),('top_0.5pct',0.005E0),('top_1pct',0.01E0),
                                 ('top_5pct',0.05E0)) AS v(q_label,f)),
     h AS (SELECT model_name, q_label, SUM(eval_weight) AS top, SUM(eval_weight*is_fire) AS cap,
             MAX(tpos) AS tpos, MAX(tw) AS tw
           FROM ro, q WHERE cw-eval_weight < tw*f GROUP BY 1,2)
     SELECT h.model_name, q_label, top/tw AS top_fraction_observed, top AS top_weighted_support,
       cap AS captured_positives, tpos AS observed_positives, cap/tpos AS recall_at_top_q,
       cap/top AS precision_at_top_q, (cap/tpos)/(top/tw) AS lift_at_q, average_precision,
       tpos/tw AS observed_prevalence, average_precision/(tpos/tw) AS ap_lift
     FROM h JOIN ap USING (model_name)""",
    "predictions",
)
def m9(t):
    return ranking.risk_concentration(t.predictions, "row_id", **P)


_F1_SHAPE = "model_name threshold:d12 f1:d9 precision:d9 recall:d9 predicted_weight:d3"


def _f1_sql(ranked, order, where="TRUE"):
    return ranked + f""", f AS (SELECT model_name, s AS threshold, 2*tp/(tp+fp+tot) AS f1,
        tp/(tp+fp) AS precision, tp/tot AS recall, tp+fp AS predicted_weight FROM rk),
      p AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY model_name
              ORDER BY ROUND(f1,12) DESC, threshold {order}) AS k FROM f WHERE {where})
      SELECT model_name, threshold, f1, precision, recall, predicted_weight FROM p WHERE k=1"""


@query("m10_max_f1", _F1_SHAPE, _f1_sql(RANKED, "DESC"), "predictions")
def m10(t):
    return ranking.best_f1(ranking.ranked_scores(t.predictions, **P), G)


@query(
    "m11_f1_threshold_constrained", _F1_SHAPE,
    _f1_sql(UNWEIGHTED, "ASC", "precision >= 0.2E0 AND recall >= 0.4E0"), "predictions",
)
def m11(t):
    ranked = ranking.ranked_scores(t.predictions, p="prob_raw", w=None, group=G)
    return ranking.best_f1(ranked, G, "lowest", min_precision=0.2, min_recall=0.4)


@query(
    "m12_f1_threshold_highest", _F1_SHAPE,
    UNWEIGHTED + """, f AS (SELECT model_name, s AS threshold, 2*tp/(tp+fp+tot) AS f1,
        tp/(tp+fp) AS precision, tp/tot AS recall, tp+fp AS predicted_weight FROM rk),
      b AS (SELECT model_name, MAX(f1) AS top FROM f GROUP BY 1),
      p AS (SELECT f.*, ROW_NUMBER() OVER (PARTITION BY model_name ORDER BY threshold DESC) AS k
            FROM f JOIN b USING (model_name) WHERE ABS(f1-top) <= 1e-8 + 1e-5*top)
      SELECT model_name, threshold, f1, precision, recall, predicted_weight FROM p WHERE k=1""",
    "predictions",
)
def m12(t):
    ranked = ranking.ranked_scores(t.predictions, p="prob_raw", w=None, group=G)
    # no score reaches this precision, so the constraint is ignored
    return ranking.best_f1(ranked, G, "highest", min_precision=1.1, unsatisfied="ignore", close=True)


@query(
    "m13_top_k", "model_name k:i hits:i precision:d9 recall:d9",
    ROWS_DOWN + """SELECT model_name, MAX(kpos) AS k, SUM(is_fire) AS hits,
        SUM(is_fire)/MAX(kpos) AS precision, SUM(is_fire)/MAX(kpos) AS recall
      FROM ro WHERE rn <= kpos GROUP BY 1""",
    "predictions",
)
def m13(t):
    return ranking.top_k_at_positives(t.predictions, "row_id", p="prob_raw", group=G)
