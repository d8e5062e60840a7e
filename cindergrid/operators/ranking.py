"""Order-dependent metrics on one distributed prefix-sum core.

Nothing here sorts a whole group in one task. Rows are first collapsed to one
row per (group, score), which settles ties and removes most of the data; the
distinct scores are cut into balanced buckets by approximate quantiles; bucket
totals (a few thousand rows per group) give the offsets; and the running sums
are windows over (group, bucket) only.

Where ties must be split row by row, rows of the affected scores are ordered by
the md5 of their key, and the leading hash digits split a single hot score over
many tasks.
"""

from __future__ import annotations

import math
import sys

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cindergrid.functions.labels import finite
from cindergrid.functions.probability import EPS, clip, logit, ratio, ratio_or_zero
from cindergrid.session import cut

BUCKET_BITS = 10
ROWS_PER_BUCKET = 250_000
TIE_DIGITS = 2


def _over(group, *more):
    return Window.partitionBy(*group, *more)


def metric_rows(df, y="is_fire", p="prob", w="eval_weight", group=(), keep=()) -> DataFrame:
    """Rows fit for a metric: finite label, probability and positive weight.

    The filter names each value once: it moves below the projection that makes the
    score, and every mention there computes the score anew. NaN is above all numbers.
    """
    yy, pp = _double(y), _double(p)
    ww = _double(w) if w else F.lit(1.0)
    top = F.lit(sys.float_info.max)
    fit = (F.abs(yy) <= top) & (F.abs(pp) <= top)
    if w:
        fit = fit & (ww > 0) & (ww <= top)
    held = F.least(F.greatest(pp, F.lit(EPS)), F.lit(1.0 - EPS))
    return df.filter(fit).select(
        *group, *keep, yy.alias("_y"), held.alias("_p"), ww.alias("_w")
    )


def _double(column) -> Column:
    return (F.col(column) if isinstance(column, str) else column).cast("double")


def collapse(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """One row per (group, score): positive weight, negative weight, rows."""
    rows = metric_rows(df, y, p, w, group)
    return rows.groupBy(*group, F.col("_p").alias("score")).agg(
        F.sum(F.col("_y") * F.col("_w")).alias("pos"),
        F.sum((1 - F.col("_y")) * F.col("_w")).alias("neg"),
        F.count(F.lit(1)).cast("double").alias("n"),
    )


def with_score_bucket(df, value: str, bits: int = BUCKET_BITS, rows_per_bucket=None) -> DataFrame:
    """Add _bucket, an order-preserving balanced bucket of a numeric column.

    The 2**bits - 1 cut points are one scalar sub-query of approximate
    quantiles; a row finds its bucket by binary search over them. Neighbouring
    buckets are then merged until they are worth a task: a small table has one.
    """
    size = 1 << bits
    # one foldable text literal: a literal per cut point would bloat the plan
    at = F.split(F.lit(",".join(str(i / size) for i in range(1, size))), ",").cast("array<double>")
    wanted = F.ceil(F.count(value) / (rows_per_bucket or ROWS_PER_BUCKET))
    wanted = F.least(F.greatest(wanted, F.lit(1)), F.lit(size))
    cuts = df.agg(
        F.struct(
            F.percentile_approx(value, at, F.lit(size * 20)).alias("at"),
            F.ceil(F.lit(size) / wanted).alias("merge"),
        ).alias("cuts")
    ).scalar()
    # one projection per halving keeps every step a generated array read; written
    # as one expression the steps would nest into each other
    placed = df.withColumns({"_cuts": cuts, "_bucket": F.lit(0)})
    for bit in reversed(range(bits)):
        probe = F.get("_cuts.at", F.col("_bucket") + ((1 << bit) - 1))
        placed = placed.withColumn(
            "_bucket",
            F.col("_bucket") + F.when(probe < F.col(value), 1 << bit).otherwise(0),
        )
    merged = F.floor(F.col("_bucket") / F.col("_cuts.merge")).cast("int")
    return placed.withColumn("_bucket", F.coalesce(merged, F.lit(0))).drop("_cuts")


def running_sums(df, order: str, measures, group=(), descending=True, totals=True) -> DataFrame:
    """Inclusive running sums cum_<m> along `order`, and tot_<m> per group.

    `order` must be unique within a group (collapse first).
    """
    bucketed = with_score_bucket(df, order)
    sums = bucketed.groupBy(*group, "_bucket").agg(*[F.sum(m).alias(f"_s_{m}") for m in measures])
    by_bucket = F.col("_bucket").desc() if descending else F.col("_bucket").asc()
    ahead = _over(group).orderBy(by_bucket).rowsBetween(Window.unboundedPreceding, -1)
    cols = [
        F.coalesce(F.sum(f"_s_{m}").over(ahead), F.lit(0.0)).alias(f"_off_{m}") for m in measures
    ]
    if totals:
        cols += [F.sum(f"_s_{m}").over(_over(group)).alias(f"tot_{m}") for m in measures]
    offsets = sums.select(*group, "_bucket", *cols)
    by_value = F.col(order).desc() if descending else F.col(order).asc()
    within = (
        _over(group, "_bucket").orderBy(by_value).rowsBetween(Window.unboundedPreceding, 0)
    )
    joined = bucketed.join(offsets, [*group, "_bucket"])
    out = joined.withColumns(
        {f"cum_{m}": F.col(f"_off_{m}") + F.sum(m).over(within) for m in measures}
    )
    return out.drop("_bucket", *[f"_off_{m}" for m in measures])


def tie_positions(rows, key: Column, weight: str, group=(), score="_p") -> DataFrame:
    """Running weight of each row inside its (group, score), in md5(key) order.

    Adds _hash and _within (inclusive). A hot score is spread over
    16**TIE_DIGITS hash slices, so no task ever sorts all its rows.
    """
    keyed = rows.withColumn("_hash", F.md5(key.cast("string"))).withColumn(
        "_slice", F.substring("_hash", 1, TIE_DIGITS)
    )
    at = [*group, score]
    before = _over(at).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = keyed.groupBy(*at, "_slice").agg(F.sum(weight).alias("_sw")).select(
        *at, "_slice", F.coalesce(F.sum("_sw").over(before), F.lit(0.0)).alias("_ahead")
    )
    local = _over(at, "_slice").orderBy("_hash").rowsBetween(Window.unboundedPreceding, 0)
    return (
        keyed.join(slices, [*at, "_slice"])
        .withColumn("_within", F.col("_ahead") + F.sum(weight).over(local))
        .drop("_slice", "_ahead")
    )


def row_positions(rows, value: str, key: Column, group=(), descending=False) -> DataFrame:
    """Exact 0-based position of every row in (value, md5(key)) order: _pos."""
    ones = rows.withColumn("_one", F.lit(1.0))
    counts = ones.groupBy(*group, value).agg(F.sum("_one").alias("_cnt"))
    starts = running_sums(counts, value, ["_cnt"], group, descending).select(
        *group, value, (F.col("cum__cnt") - F.col("_cnt")).alias("_start"), "tot__cnt"
    )
    inside = tie_positions(ones, key, "_one", group, value)
    return (
        inside.join(starts, [*group, value])
        .withColumn("_pos", (F.col("_start") + F.col("_within") - 1).cast("long"))
        .withColumn("_size", F.col("tot__cnt").cast("long"))
        .drop("_start", "_within", "_hash", "_one", "tot__cnt")
    )


def exact_quantiles(df, value: str, qs: dict[str, float], group=()) -> DataFrame:
    """Linear-interpolated quantiles per group, without holding a group in one task."""
    counts = (
        df.filter(finite(value).isNotNull())
        .groupBy(*group, F.col(value).cast("double").alias("_v"))
        .agg(F.count(F.lit(1)).cast("double").alias("_n"))
    )
    ranked = running_sums(counts, "_v", ["_n"], group, descending=False)
    lo, hi = F.col("cum__n") - F.col("_n"), F.col("cum__n")
    aggs, finals = [], []
    for name, q in qs.items():
        h = F.lit(float(q)) * (F.col("tot__n") - 1)
        low, high = F.floor(h), F.ceil(h)
        aggs += [
            F.max(F.when((low >= lo) & (low < hi), F.col("_v"))).alias(f"_lo_{name}"),
            F.max(F.when((high >= lo) & (high < hi), F.col("_v"))).alias(f"_hi_{name}"),
            F.max(h - low).alias(f"_fr_{name}"),
        ]
        a, b = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        finals.append((a + (b - a) * F.col(f"_fr_{name}")).alias(name))
    return ranked.groupBy(*group).agg(*aggs).select(*group, *finals)


# --- scalar metrics -------------------------------------------------------------


def weighted_scores(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """Weighted Brier score, log-loss, mean probability and prevalence."""
    rows = metric_rows(df, y, p, w, group)
    yy, pp, ww = F.col("_y"), F.col("_p"), F.col("_w")
    loss = -(yy * F.log(pp) + (1 - yy) * F.log1p(-pp))
    return (
        rows.groupBy(*group)
        .agg(
            F.count(F.lit(1)).alias("support"),
            F.sum(ww).alias("_sw"),
            F.sum(ww * (pp - yy) * (pp - yy)).alias("_b"),
            F.sum(ww * loss).alias("_l"),
            F.sum(ww * pp).alias("_e"),
            F.sum(ww * yy).alias("_o"),
        )
        .select(
            *group,
            "support",
            F.col("_sw").alias("weighted_support"),
            ratio("_b", "_sw").alias("brier_score"),
            ratio("_l", "_sw").alias("log_loss"),
            ratio("_e", "_sw").alias("mean_probability"),
            ratio("_o", "_sw").alias("prevalence"),
        )
    )


def ranked_scores(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """Collapsed scores with running positive / negative weight from the top."""
    return running_sums(collapse(df, y, p, w, group), "score", ["pos", "neg", "n"], group)


def ranking_metrics(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """Weighted average precision and ROC-AUC with ties; NULL if one class only."""
    return ranking_from_prefix(ranked_scores(df, y, p, w, group), group)


def ranked_once(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """Ranked scores whose collapsed rows are written once to the checkpoint folder.

    For scores that cost work (models, scaled indices) or rankings read by several
    tables: cut points, bucket sums and running sums each read the collapsed rows.
    """
    return running_sums(cut(collapse(df, y, p, w, group)), "score", ["pos", "neg", "n"], group)


def score_table(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """The columns of weighted_scores and ranking_metrics, from one ranking written once."""
    ranked = ranked_once(df, y, p, w, group)
    s, pos, neg = F.col("score"), F.col("pos"), F.col("neg")
    total = F.sum(pos + neg)
    return ranked.groupBy(*group).agg(
        F.sum("n").cast("long").alias("support"),
        total.alias("weighted_support"),
        (F.sum(pos * (1 - s) * (1 - s) + neg * s * s) / total).alias("brier_score"),
        (-F.sum(pos * F.log(s) + neg * F.log1p(-s)) / total).alias("log_loss"),
        (F.sum((pos + neg) * s) / total).alias("mean_probability"),
        (F.sum(pos) / total).alias("prevalence"),
        *_ranking_sums(),
    )


def ranking_from_prefix(ranked: DataFrame, group=()) -> DataFrame:
    return ranked.groupBy(*group).agg(*_ranking_sums())


def _ranking_sums() -> list[Column]:
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    both = (F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)
    step = F.col("pos") * tp / (tp + fp)
    above = F.col("neg") * (tp - F.col("pos") / 2)
    return [
        F.when(both, F.sum(step) / F.max("tot_pos")).alias("average_precision"),
        F.when(both, F.sum(above) / (F.max("tot_pos") * F.max("tot_neg"))).alias("roc_auc"),
    ]


def threshold_metrics(
    df, threshold, y="is_fire", p="prob", w=None, group=(), zero_division=0.0
) -> DataFrame:
    """Confusion counts and rates at a threshold (number or column)."""
    ww = F.col(w).cast("double") if w else F.lit(1.0)
    t = F.lit(float(threshold)) if isinstance(threshold, (int, float)) else threshold
    hit, yes = F.col(p) >= t, F.col(y) == 1
    counts = df.groupBy(*group).agg(
        *[
            F.coalesce(F.sum(F.when(c, ww)), F.lit(0.0)).alias(name)
            for name, c in (
                ("tp", hit & yes), ("fp", hit & ~yes), ("fn", ~hit & yes), ("tn", ~hit & ~yes),
            )
        ]
    )
    return counts.withColumns(confusion_rates(zero_division))


def confusion_rates(zero_division=0.0) -> dict[str, Column]:
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    div = ratio_or_zero if zero_division == 0.0 else ratio
    return {
        "precision": div(tp, tp + fp),
        "recall": div(tp, tp + fn),
        "f1": div(2 * tp, 2 * tp + fp + fn),
        "accuracy": div(tp + tn, tp + fp + fn + tn),
        "fpr": ratio_or_zero(fp, fp + tn),
        "fnr": ratio_or_zero(fn, fn + tp),
    }


def pr_curve(df, y="is_fire", p="prob", w="eval_weight", group=()) -> DataFrame:
    """Precision and recall at every distinct score, with its position from the top."""
    base = collapse(df, y, p, w, group).withColumn("one", F.lit(1.0))
    ranked = running_sums(base, "score", ["pos", "neg", "one"], group)
    return ranked.select(
        *group,
        F.col("score").alias("threshold"),
        ratio("cum_pos", F.col("cum_pos") + F.col("cum_neg")).alias("precision"),
        ratio("cum_pos", "tot_pos").alias("recall"),
        F.col("cum_one").cast("long").alias("point"),
        F.col("tot_one").cast("long").alias("points"),
    )


def pr_curve_sampled(curve: DataFrame, max_points: int) -> DataFrame:
    """At most max_points of a curve, evenly spaced, both ends kept."""
    i, n = F.col("point") - 1, F.col("points")
    slots = F.lit(max_points - 1)
    # i is kept when some j in 0..max-1 has floor(j*(n-1)/(max-1)) = i
    j = F.ceil(i * slots / (n - 1))
    kept = (j <= slots) & (F.floor(j * (n - 1) / slots) == i)
    return curve.filter((n <= max_points) | kept)


# --- thresholds -----------------------------------------------------------------


def best_f1(ranked: DataFrame, group=(), ties="highest", min_precision=None, min_recall=None,
            unsatisfied="default", epsilon=0.0, close=False) -> DataFrame:
    """F1-optimal score per group from a ranked table.

    ties: which score wins equal F1 ("highest" or "lowest"). If no score meets
    the constraints, "default" yields threshold 0.5 and "ignore" drops them.
    close: F1 values within 1e-5 of the best, relatively, count as equal to it.
    """
    tp, fp = F.col("cum_pos"), F.col("cum_neg")
    prec, rec = ratio_or_zero(tp, tp + fp), ratio_or_zero(tp, F.col("tot_pos"))
    f1 = (
        ratio_or_zero(2 * tp, tp + fp + F.col("tot_pos"))
        if not epsilon
        else 2 * prec * rec / (prec + rec + epsilon)
    )
    ok = F.lit(True)
    if min_precision is not None:
        ok = ok & (prec >= min_precision)
    if min_recall is not None:
        ok = ok & (rec >= min_recall)
    s = F.col("score")
    # 12 decimals stand for "equal" F1, so ties do not hang on float noise
    level = F.round(f1, 12)
    if close:
        key = list(group) or ["_all"]
        ranked = ranked if group else ranked.withColumn("_all", F.lit(1))
        tops = ranked.groupBy(*key).agg(F.max(F.when(ok, f1)).alias("_top"), F.max(f1).alias("_top_any"))
        ranked = ranked.join(tops, key)
        top = F.col("_top") if unsatisfied == "default" else F.coalesce("_top", "_top_any")
        # whoever is near enough shares the first place
        level = F.when(f1 >= top * (1 - 1e-5) - 1e-8, F.lit(2.0)).otherwise(F.round(f1, 12) - 1)
    order = F.struct(level.alias("f"), (s if ties == "highest" else -s).alias("s"))
    pick = F.struct(
        s.alias("threshold"), f1.alias("f1"), prec.alias("precision"), rec.alias("recall"),
        (tp + fp).alias("predicted_weight"),
    )
    best = ranked.groupBy(*group).agg(
        F.max_by(F.when(ok, pick), F.when(ok, order)).alias("_ok"),
        F.max_by(pick, order).alias("_any"),
        ((F.max("tot_pos") > 0) & (F.max("tot_neg") > 0)).alias("_both"),
    )
    chosen = F.col("_ok") if unsatisfied == "default" else F.coalesce("_ok", "_any")
    best = best.withColumn("_c", F.when(F.col("_both"), chosen))
    return best.select(
        *group,
        F.coalesce("_c.threshold", F.lit(0.5)).alias("threshold"),
        F.col("_c.f1").alias("f1"),
        F.col("_c.precision").alias("precision"),
        F.col("_c.recall").alias("recall"),
        F.col("_c.predicted_weight").alias("predicted_weight"),
    )


# --- shares of the ranking ------------------------------------------------------


def top_share(
    df, cutoffs: dict[str, Column], key: str, y="is_fire", p="prob", w="eval_weight", group=()
) -> DataFrame:
    """Weight and positives captured from the top, up to the first row reaching a cutoff.

    cutoffs: label -> column over total_weight and total_pos. Only the rows of
    the score each cutoff falls into are ordered one by one.
    """
    rows = metric_rows(df, y, p, w, group, keep=[key])
    ranked = running_sums(collapse(df, y, p, w, group), "score", ["pos", "neg"], group)
    ranked = ranked.withColumns(
        {
            "total_pos": F.col("tot_pos"),
            "total_weight": F.col("tot_pos") + F.col("tot_neg"),
            "_cum": F.col("cum_pos") + F.col("cum_neg"),
        }
    )
    ask = F.explode(
        F.array(*[F.struct(F.lit(k).alias("q"), c.cast("double").alias("cut"))
                  for k, c in cutoffs.items()])
    )
    start_w = F.col("_cum") - F.col("pos") - F.col("neg")
    asked = ranked.select("*", ask.alias("_a"))
    cut = F.col("_a.cut")
    crossing = asked.filter((start_w < cut) & (cut <= F.col("_cum"))).select(
        *group,
        F.col("score").alias("_p"),
        F.col("_a.q").alias("q"),
        cut.alias("cut"),
        start_w.alias("_w0"),
        (F.col("cum_pos") - F.col("pos")).alias("_pos0"),
        "total_pos",
        "total_weight",
    )
    touched = crossing.select(*group, "_p").distinct()
    inside = tie_positions(
        rows.join(touched, [*group, "_p"], "left_semi"), F.col(key), "_w", group
    )
    hit = inside.join(crossing, [*group, "_p"]).filter(
        F.col("_w0") + F.col("_within") - F.col("_w") < F.col("cut")
    )
    return hit.groupBy(*group, "q").agg(
        F.max("cut").alias("cutoff"),
        (F.max("_w0") + F.sum("_w")).alias("top_weight"),
        (F.max("_pos0") + F.sum(F.col("_w") * F.col("_y"))).alias("captured"),
        F.max("total_pos").alias("total_pos"),
        F.max("total_weight").alias("total_weight"),
    )


def risk_concentration(
    df, key, fractions=(0.001, 0.005, 0.01, 0.05), y="is_fire", p="prob", w="eval_weight", group=()
) -> DataFrame:
    """Recall, precision and lift in the top shares of total weight, with AP lift."""
    cuts = {f"top_{100 * f:g}pct": F.col("total_weight") * f for f in fractions}
    share = top_share(df, cuts, key, y, p, w, group)
    ap = ranking_metrics(df, y, p, w, group).select(*group, "average_precision")
    wide = share.join(ap, list(group)) if group else share.withColumn(
        "average_precision", ap.scalar()
    )
    part = ratio("top_weight", "total_weight")
    recall = ratio("captured", "total_pos")
    prevalence = ratio("total_pos", "total_weight")
    return wide.select(
        *group,
        F.col("q").alias("q_label"),
        part.alias("top_fraction_observed"),
        F.col("top_weight").alias("top_weighted_support"),
        F.col("captured").alias("captured_positives"),
        F.col("total_pos").alias("observed_positives"),
        recall.alias("recall_at_top_q"),
        ratio("captured", "top_weight").alias("precision_at_top_q"),
        ratio(recall, part).alias("lift_at_q"),
        "average_precision",
        prevalence.alias("observed_prevalence"),
        ratio("average_precision", prevalence).alias("ap_lift"),
    )


def top_k_at_positives(df, key, y="is_fire", p="prob", group=()) -> DataFrame:
    """Precision and recall among the k best rows, k = number of positives."""
    share = top_share(df, {"k": F.col("total_pos")}, key, y, p, None, group)
    return share.select(
        *group,
        F.col("cutoff").cast("long").alias("k"),
        F.col("captured").cast("long").alias("hits"),
        ratio("captured", "cutoff").alias("precision"),
        ratio("captured", "total_pos").alias("recall"),
    )


# --- reliability ----------------------------------------------------------------

def _bin_table(parts: DataFrame, group) -> DataFrame:
    g = parts.groupBy(*group, "bin").agg(
        F.sum("n").alias("n_unweighted"),
        F.sum("w").alias("n_weighted"),
        F.min("lo").alias("prob_min"),
        F.max("hi").alias("prob_max"),
        F.sum("e").alias("expected"),
        F.sum("o").alias("observed"),
    )
    return g.withColumns(
        {
            "mean_predicted_probability": F.col("expected") / F.col("n_weighted"),
            "observed_prevalence": F.col("observed") / F.col("n_weighted"),
            "expected_observed_count_ratio": ratio("expected", F.nullif("observed", F.lit(0.0))),
        }
    )


def reliability_bins(
    df, n_bins=20, strategy="equal_count", key=None, y="is_fire", p="prob", w="eval_weight",
    group=(),
) -> DataFrame:
    """Reliability table over equal-weight, equal-width or log-spaced bins."""
    base = collapse(df, y, p, w, group)
    part = [
        F.col("n").cast("long").alias("n"),
        (F.col("pos") + F.col("neg")).alias("w"),
        F.col("score").alias("lo"),
        F.col("score").alias("hi"),
        (F.col("score") * (F.col("pos") + F.col("neg"))).alias("e"),
        F.col("pos").alias("o"),
    ]
    if strategy != "equal_count":
        edges = _fixed_edges(n_bins, strategy)
        where = F.aggregate(
            F.array(*[F.lit(e) for e in edges]),
            F.lit(0),
            lambda acc, e: acc + (F.col("score") >= e).cast("int"),
        )
        return _bin_table(base.select(*group, where.alias("bin"), *part), group)

    ranked = running_sums(base, "score", ["pos", "neg"], group, descending=False)
    total = F.col("tot_pos") + F.col("tot_neg")
    ranked = ranked.withColumns(
        {"_c1": F.col("cum_pos") + F.col("cum_neg"), "_total": total}
    ).withColumn("_c0", F.col("_c1") - F.col("pos") - F.col("neg"))

    def bins_below(edge, strict):
        ks = F.sequence(F.lit(1), F.lit(max(n_bins - 1, 1)))
        target = lambda k: F.col("_total") * k / n_bins
        return F.size(
            F.filter(ks, lambda k: (target(k) < edge) if strict else (target(k) <= edge))
        )

    if n_bins == 1:
        return _bin_table(base.select(*group, F.lit(0).alias("bin"), *part), group)
    first, last = bins_below(F.col("_c0"), False), bins_below(F.col("_c1"), True)
    ranked = ranked.withColumns({"_first": first, "_last": last})
    whole = ranked.filter("_first = _last").select(*group, F.col("_first").alias("bin"), *part)
    split = ranked.filter("_first <> _last").select(
        *group, F.col("score").alias("_p"), "_c0", "_total"
    )
    rows = metric_rows(df, y, p, w, group, keep=[key])
    touched = rows.join(split.select(*group, "_p"), [*group, "_p"], "left_semi")
    placed = tie_positions(touched, F.col(key), "_w", group).join(split, [*group, "_p"])
    placed = placed.withColumn("_at", F.col("_c0") + F.col("_within"))
    loose = placed.select(
        *group,
        bins_below(F.col("_at"), True).alias("bin"),
        F.lit(1).cast("long").alias("n"),
        F.col("_w").alias("w"),
        F.col("_p").alias("lo"),
        F.col("_p").alias("hi"),
        (F.col("_p") * F.col("_w")).alias("e"),
        (F.col("_y") * F.col("_w")).alias("o"),
    )
    return _bin_table(whole.unionByName(loose), group)


def _fixed_edges(n_bins: int, strategy: str) -> list[float]:
    if strategy == "equal_width":
        return [i / n_bins for i in range(1, n_bins)]
    if strategy == "log":
        return [10 ** (-6 + 6 * i / (n_bins - 1)) for i in range(n_bins - 1)]
    raise ValueError(f"unknown binning strategy {strategy!r}")


def reliability_summary(bins: DataFrame, group=()) -> DataFrame:
    """Weighted ECE, largest error and RMSE over reliability bins."""
    err = F.abs(F.col("mean_predicted_probability") - F.col("observed_prevalence"))
    w = F.col("n_weighted")
    return bins.groupBy(*group).agg(
        (F.sum(w * err) / F.sum(w)).alias("reliability_ece"),
        F.max(err).alias("reliability_mce"),
        F.sqrt(F.sum(w * err * err) / F.sum(w)).alias("reliability_rmse"),
    )


def ece_uniform(df, bins=10, y="is_fire", p="prob", group=()) -> DataFrame:
    """Unweighted ECE over equal-width bins, the last one closed on the right."""
    b = clip(F.floor(F.col(p) * bins), None, bins - 1)
    t = df.groupBy(*group, b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg(y).alias("my")
    )
    return t.groupBy(*group).agg(
        (F.sum(F.col("n") * F.abs(F.col("mp") - F.col("my"))) / F.sum("n")).alias("ece")
    )


def calibration_line(
    df, y="is_fire", p="prob", w="eval_weight", group=(), steps=30, tolerance=1e-10
) -> DataFrame:
    """Slope and intercept of the unpenalised weighted logistic fit of the label on logit(p).

    Newton steps over collapsed scores; each step is one distributed aggregation
    of five sums, and only those sums (one row per group) reach the driver.
    """
    base = collapse(df, y, p, w, group).withColumn("_x", logit("score")).persist()
    g = list(group)
    spark = base.sparkSession
    schema = T.StructType(
        [*base.select(*g).schema.fields, T.StructField("b0", T.DoubleType()),
         T.StructField("b1", T.DoubleType())]
    )
    sizes = base.groupBy(*g).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n")).collect()
    both = [r for r in sizes if r["p"] > 0 and r["n"] > 0]
    # the flat fit is a safe start: Newton from a steep line can run away
    state = {tuple(r[k] for k in g): (math.log(r["p"] / r["n"]), 0.0) for r in both}
    skipped = [tuple(r[k] for k in g) for r in sizes if r not in both]
    live = dict(state)
    for _ in range(steps):
        if not live:
            break
        coef = spark.createDataFrame([(*k, *b) for k, b in live.items()], schema)
        # one row per group: a sorted join would lay a whole group into one task
        j = base.join(F.broadcast(coef), g) if g else base.withColumns(
            {"b0": F.lit(live[()][0]), "b1": F.lit(live[()][1])}
        )
        x, total = F.col("_x"), F.col("pos") + F.col("neg")
        mu = 1 / (1 + F.exp(-(F.col("b0") + F.col("b1") * x)))
        v, r = total * mu * (1 - mu), F.col("pos") - total * mu
        sums = j.groupBy(*g).agg(
            F.sum(v).alias("h00"), F.sum(v * x).alias("h01"), F.sum(v * x * x).alias("h11"),
            F.sum(r).alias("g0"), F.sum(r * x).alias("g1"),
        )
        after = {}
        for row in sums.collect():
            k = tuple(row[c] for c in g)
            det = row["h00"] * row["h11"] - row["h01"] ** 2
            if abs(det) < 1e-300:
                continue
            d0 = (row["h11"] * row["g0"] - row["h01"] * row["g1"]) / det
            d1 = (row["h00"] * row["g1"] - row["h01"] * row["g0"]) / det
            damp = min(1.0, 2.0 / max(abs(d0), abs(d1), 1e-300))
            state[k] = (live[k][0] + damp * d0, live[k][1] + damp * d1)
            if abs(d0) + abs(d1) > tolerance:
                after[k] = state[k]
        live = after
    base.unpersist()
    rows = [(*k, *b) for k, b in state.items()] + [(*k, None, None) for k in skipped]
    return spark.createDataFrame(rows, schema).select(
        *g, F.col("b1").alias("calibration_slope"), F.col("b0").alias("calibration_intercept")
    )
