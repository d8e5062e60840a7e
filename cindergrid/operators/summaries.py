"""Count, prevalence, period and spatial report tables over prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.calendar import period_end, period_start
from cindergrid.functions.labels import finite
from cindergrid.functions.probability import clip, ratio
from cindergrid.operators.raster import gaussian_smooth
from cindergrid.operators.regions import region_rows


def expected(p="prob", w="eval_weight") -> Column:
    return F.sum(F.col(p) * F.col(w))


def observed(y="is_fire", w="eval_weight") -> Column:
    return F.sum(F.col(y) * F.col(w))


def feature_quality(df, columns, max_null_share=0.5) -> DataFrame:
    """One wide aggregation over all columns, unpivoted to one row per column."""
    aggs = [F.count(F.lit(1)).alias("_rows")]
    for c in columns:
        v = finite(c)
        aggs += [
            F.count(v).alias(f"{c}__n"), F.avg(v).alias(f"{c}__m"), F.stddev_pop(v).alias(f"{c}__s")
        ]
    wide = df.agg(*aggs)
    rows = F.explode(
        F.array(
            *[
                F.struct(
                    F.lit(c).alias("feature"), F.col(f"{c}__n").alias("n"),
                    F.col(f"{c}__m").alias("mean"), F.col(f"{c}__s").alias("std"),
                )
                for c in columns
            ]
        )
    )
    out = wide.select("_rows", rows.alias("r")).select(
        "r.feature", F.col("r.mean").alias("mean"), F.col("r.std").alias("std"),
        (1 - F.col("r.n") / F.col("_rows")).alias("null_share"),
        (F.col("r.n") == 0).alias("_empty"),
    )
    issue = (
        F.when(F.col("_empty"), "all_null")
        .when(F.col("null_share") > max_null_share, "many_nulls")
        .when(F.col("std") == 0, "constant")
        .otherwise("ok")
    )
    return out.withColumn("issue", issue).drop("_empty")


def infer_resolution(df, column, digits=9) -> DataFrame:
    """Median positive step between neighbouring distinct coordinates.

    Differences are counted per value, so only distinct coordinates are ordered
    and the median comes from the counts of the distinct steps.
    """
    from cindergrid.operators.ranking import exact_quantiles, with_score_bucket

    axis = df.select(F.col(column).cast("double").alias("_x")).distinct()
    b = with_score_bucket(axis, "_x")
    w = Window.partitionBy("_bucket").orderBy("_x")
    ends = b.groupBy("_bucket").agg(F.min("_x").alias("_lo"), F.max("_x").alias("_hi"))
    # joins of one bucket to the next: at most one per bucket
    seams = ends.select((F.col("_lo") - F.lag("_hi").over(Window.orderBy("_bucket"))).alias("_d"))
    steps = b.select((F.col("_x") - F.lag("_x").over(w)).alias("_d")).unionByName(seams)
    steps = steps.filter(F.col("_d") > 0).withColumn("_d", F.round("_d", digits))
    return exact_quantiles(steps, "_d", {"resolution": 0.5})


def dataset_statistics(df, regions=None, split="split", date="date", label="is_fire") -> DataFrame:
    """Bounds, unique cells and days, positives and rate per split, region and year.

    The year NULL row of each (split, region) covers all its years.
    """
    # cell-days and then cells first: repeated rows shrink before they are copied
    # into regions and years, and no task holds one group's distinct keys
    cell_day = df.groupBy(split, "lat_key", "lon_key", date).agg(
        F.count(F.lit(1)).alias("_n"), F.sum(label).alias("_p")
    ).withColumn("year", F.explode(F.array(F.year(date), F.lit(None).cast("int"))))
    cell = cell_day.groupBy(split, "year", "lat_key", "lon_key").agg(
        F.sum("_n").alias("_n"), F.sum("_p").alias("_p"), F.count(F.lit(1)).alias("_days"),
        F.min(date).alias("_d0"), F.max(date).alias("_d1"),
    )
    group = [split, "year"]
    if regions is not None:
        cell = region_rows(cell, regions, include_global=True)
        group.append("region")
    return cell.groupBy(*group).agg(
        F.sum("_n").alias("rows"),
        F.count(F.lit(1)).alias("unique_cells"),
        F.sum("_days").alias("cell_days"),
        F.sum("_p").alias("positives"),
        (F.sum("_n") - F.sum("_p")).alias("negatives"),
        (F.sum("_p") / F.sum("_n")).alias("positive_rate"),
        F.min("lat_key").alias("lat_min"), F.max("lat_key").alias("lat_max"),
        F.min("lon_key").alias("lon_min"), F.max("lon_key").alias("lon_max"),
        F.min("_d0").alias("first_date"), F.max("_d1").alias("last_date"),
    )


def count_calibration(df, group, p="prob", w="eval_weight", y="is_fire") -> DataFrame:
    return df.groupBy(*group).agg(
        expected(p, w).alias("expected"), observed(y, w).alias("observed")
    ).withColumn(
        "expected_observed_count_ratio", ratio("expected", F.nullif("observed", F.lit(0.0)))
    )


def prevalence_audit(df, w="eval_weight", y="is_fire", group=()) -> DataFrame:
    """Weighted and unweighted denominators of one table, two rows per group."""
    base = df.groupBy(*group).agg(
        F.count(F.lit(1)).cast("double").alias("n"),
        F.sum(w).alias("sw"),
        F.sum(y).cast("double").alias("sy"),
        observed(y, w).alias("swy"),
    )
    both = F.explode(
        F.array(
            F.struct(F.lit("deployment_weighted_grid_cell_days").alias("denominator"),
                     F.col("sw").alias("count"), F.col("swy").alias("events")),
            F.struct(F.lit("evaluated_rows_unweighted").alias("denominator"),
                     F.col("n").alias("count"), F.col("sy").alias("events")),
        )
    )
    return base.select(*group, F.col("n").cast("long").alias("support"), both.alias("x")).select(
        *group, "support", "x.denominator", F.col("x.count").alias("denominator_count"),
        F.col("x.events").alias("event_count"), ratio("x.events", "x.count").alias("event_rate"),
    )


def count_correction(df, raw="prob_raw", cal="prob_calibrated", w="eval_weight", y="is_fire",
                     group=()) -> DataFrame:
    """Expected / observed before and after calibration and the reduction factor."""
    base = df.groupBy(*group).agg(
        expected(raw, w).alias("raw_expected"),
        expected(cal, w).alias("calibrated_expected"),
        observed(y, w).alias("observed"),
        F.sum(w).alias("_sw"),
    )
    with_ratio = base.withColumns(
        {
            "raw_ratio": ratio("raw_expected", "observed"),
            "calibrated_ratio": ratio("calibrated_expected", "observed"),
            "raw_mean": ratio("raw_expected", "_sw"),
            "calibrated_mean": ratio("calibrated_expected", "_sw"),
        }
    ).drop("_sw")
    return with_ratio.withColumn("reduction_factor", ratio("raw_ratio", "calibrated_ratio"))


def daily_mae(df, date="date", p="prob", w="eval_weight", y="is_fire", group=()) -> DataFrame:
    day = df.groupBy(*group, date).agg(expected(p, w).alias("_e"), observed(y, w).alias("_o"))
    return day.groupBy(*group).agg(
        F.avg(F.abs(F.col("_e") - F.col("_o"))).alias("daily_mae"), F.count(F.lit(1)).alias("days")
    )


def coarse_cells(df, factor: int, date="date", p="prob", w="eval_weight", y="is_fire",
                 group=()) -> DataFrame:
    """Cells merged by a whole factor per day: any label, weighted mean score."""
    block = lambda c: F.floor(F.col(c) / factor).cast("long").alias(c)
    return df.groupBy(*group, date, block("lat_key"), block("lon_key")).agg(
        F.count(F.lit(1)).alias("support"),
        F.sum(w).alias("eval_weight"),
        F.max(y).alias("is_fire"),
        ratio(expected(p, w), F.sum(w)).alias("prob"),
    )


# --- additive partials ----------------------------------------------------------

_SUMS = ("rows", "weighted_support", "expected_raw", "observed")


def _partials(df, keys, p, w, y) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(w).alias("weighted_support"),
        expected(p, w).alias("expected_raw"),
        observed(y, w).alias("observed"),
    )


def month_partials(df, p="prob", w="eval_weight", y="is_fire") -> DataFrame:
    return _partials(df.withColumn("month", F.month("date")), ["month"], p, w, y)


def period_partials(df, regions, frequency="month", p="prob", w="eval_weight", y="is_fire"):
    keyed = df.withColumns(
        {
            "month": F.month("date"),
            "period_start": period_start("date", frequency),
            "period_end": period_end("date", frequency),
        }
    )
    # rows shrink to period x cell sums before they are copied into regions
    small = _partials(
        keyed, ["model_name", "period_start", "period_end", "month", "lat_key", "lon_key"], p, w, y
    )
    return merge_partials(
        region_rows(small, regions), ["model_name", "region", "period_start", "period_end", "month"]
    )


def cell_partials(df, regions, p="prob", w="eval_weight", y="is_fire") -> DataFrame:
    keyed = df.withColumns({"year": F.year("date"), "month": F.month("date")})
    small = _partials(keyed, ["model_name", "year", "month", "lat_key", "lon_key"], p, w, y)
    return region_rows(small, regions).select(
        "model_name", "region", "year", "month", "lat_key", "lon_key", *_SUMS
    )


def merge_partials(parts, keys) -> DataFrame:
    """Partial tables of any number of chunks merged by summing again."""
    return parts.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _SUMS])


def merge_expected(observed_table, expected_table, keys) -> DataFrame:
    """Observed sums with expected sums joined on; no expected row means 0."""
    e = expected_table.groupBy(*keys).agg(F.sum("expected_raw").alias("expected_raw"))
    return observed_table.drop("expected_raw").join(e, list(keys), "left").withColumn(
        "expected_raw", F.coalesce("expected_raw", F.lit(0.0))
    )


def monthly_scales(monthly, enabled=True) -> DataFrame:
    """Observed / expected per month; months without expectation use the global ratio."""
    total = monthly.agg(
        F.when(F.sum("expected_raw") > 0, F.sum("observed") / F.sum("expected_raw"))
        .otherwise(1.0).alias("g")
    ).scalar()
    e, o, s = F.col("expected_raw"), F.col("observed"), F.col("weighted_support")
    scale = F.when(e > 0, o / e).otherwise(total) if enabled else F.lit(1.0)
    before = F.when(s > 0, e / s).otherwise(0.0)
    return monthly.withColumn("probability_scale", scale).withColumns(
        {
            "mean_before": before,
            "mean_after": clip(before * F.col("probability_scale"), None, 1.0),
            "observed_prevalence": F.when(s > 0, o / s).otherwise(0.0),
        }
    )


def apply_scales(table, scales) -> DataFrame:
    """Expected counts scaled by month and capped at the support."""
    joined = table.join(scales.select("month", "probability_scale"), "month", "left")
    scaled = F.col("expected_raw") * F.coalesce("probability_scale", F.lit(1.0))
    return joined.withColumn("expected", F.least(scaled, F.col("weighted_support"))).drop(
        "probability_scale"
    )


def count_series(df, regions, frequency, p="prob", w="eval_weight", y="is_fire",
                 model="model_name") -> DataFrame:
    """Expected, observed and error by region and day / week to Sunday / month."""
    small = df.groupBy(
        model, "lat_key", "lon_key", period_start("date", frequency).alias("period_start"),
        period_end("date", frequency).alias("period_end"),
    ).agg(F.sum(w).alias("weighted_support"), expected(p, w).alias("expected"),
          observed(y, w).alias("observed"))
    return region_rows(small, regions, include_global=True).groupBy(
        model, "region", "period_start", "period_end"
    ).agg(
        *[F.sum(c).alias(c) for c in ("weighted_support", "expected", "observed")]
    ).withColumns(
        {
            "error": F.col("expected") - F.col("observed"),
            "abs_error": F.abs(F.col("expected") - F.col("observed")),
        }
    )


def _risk_columns(t: DataFrame) -> DataFrame:
    return t.withColumns(
        {
            "expected_risk": ratio("expected", "weighted_support"),
            "observed_risk": ratio("observed", "weighted_support"),
            "error": F.col("expected") - F.col("observed"),
            "abs_error": F.abs(F.col("expected") - F.col("observed")),
        }
    )


def error_maps(df, p="prob", w="eval_weight", y="is_fire", group=("model_name",)) -> DataFrame:
    """Per-cell maps: one per year, and the multi-year mean (sums / number of years)."""
    yearly = df.groupBy(*group, F.year("date").alias("year"), "lat_key", "lon_key").agg(
        F.sum(w).alias("weighted_support"), expected(p, w).alias("expected"),
        observed(y, w).alias("observed"),
    )
    years = yearly.select(*group, "year").distinct().groupBy(*group).agg(
        F.count(F.lit(1)).alias("_years")
    )
    sums = yearly.groupBy(*group, "lat_key", "lon_key").agg(
        *[F.sum(c).alias(c) for c in ("weighted_support", "expected", "observed")]
    )
    mean = sums.join(years, list(group)).select(
        *group, F.lit("annual_mean").alias("map"), "lat_key", "lon_key",
        *[(F.col(c) / F.col("_years")).alias(c)
          for c in ("weighted_support", "expected", "observed")],
    )
    each = yearly.withColumn("map", F.col("year").cast("string")).drop("year")
    return _risk_columns(each.unionByName(mean))


def smoothed_error_maps(maps, sigma=1.0, group=("model_name", "map")) -> DataFrame:
    """Maps with the observed risk smoothed over known cells."""
    cells = maps.select(
        *group, F.col("lat_key").alias("r"), F.col("lon_key").alias("c"),
        F.col("observed_risk").alias("v"),
    )
    smooth = gaussian_smooth(cells, sigma, group=group).select(
        *group, F.col("r").alias("lat_key"), F.col("c").alias("lon_key"),
        F.col("smooth").alias("smoothed_observed_risk"),
    )
    return maps.join(smooth, [*group, "lat_key", "lon_key"], "left")


def map_summary(maps, group=("model_name", "map")) -> DataFrame:
    return maps.groupBy(*group).agg(
        F.count(F.lit(1)).alias("cells"),
        F.sum("expected").alias("expected"),
        F.sum("observed").alias("observed"),
        F.sum("abs_error").alias("abs_error"),
        F.max("abs_error").alias("max_abs_error"),
        F.avg("error").alias("mean_error"),
    )


# --- metric-table jobs ----------------------------------------------------------

# A metric whose name holds one of these is better when smaller.
SMALLER_IS_BETTER = ["loss", "logloss", "brier", "error", "ece", "mce", "rmse", "mae"]


def direction(metric="metric") -> Column:
    small = F.lower(F.col(metric)).rlike("|".join(SMALLER_IS_BETTER))
    return F.when(small, "min").otherwise("max")


def melt(table, ids, metrics) -> DataFrame:
    return table.unpivot(list(ids), list(metrics), "metric", "value")


def rank_models(long, group=("metric", "region", "split"), model="model_name") -> DataFrame:
    """Rank of every model per metric in that metric's direction; NULL values last."""
    signed = F.when(direction() == "min", F.col("value")).otherwise(-F.col("value"))
    w = Window.partitionBy(*group).orderBy(signed.asc_nulls_last(), F.col(model))
    return long.withColumns({"direction": direction(), "rank": F.row_number().over(w)})


def best_rows(long, group=("metric", "region", "split"), model="model_name") -> DataFrame:
    ranked = rank_models(long.filter(finite("value").isNotNull()), group, model)
    return ranked.filter("rank = 1")


def ablation_deltas(table, metrics, keys=("region", "period"), variant="variant", full="full"):
    """What the `full` variant of the same row has more of each metric than the variant."""
    base = table.filter(F.col(variant) == full).select(
        *keys, *[F.col(m).alias(f"_f_{m}") for m in metrics]
    )
    out = table.join(base, list(keys), "left")
    return out.withColumns(
        {f"delta_{m}_vs_full": F.col(f"_f_{m}") - F.col(m) for m in metrics}
    ).drop(*[f"_f_{m}" for m in metrics])


def trial_objective(long, metric, split="validation", weights=(0.0, 0.0, 0.0)) -> DataFrame:
    """Objective of each trial: split metric minus weighted generalisation gaps."""
    sign = -1.0 if metric == "log_loss" else 1.0
    wide = long.filter(F.col("metric") == metric).groupBy("trial").pivot(
        "split", ["train", "validation", "test"]
    ).agg(F.max(finite("value") * sign))
    tr, va, te = F.col("train"), F.col("validation"), F.col("test")
    gaps = {
        "train_minus_test": F.when((tr - te).isNotNull(), F.greatest(tr - te, F.lit(0.0))),
        "validation_test_abs": F.abs(va - te),
        "train_minus_validation": F.when((tr - va).isNotNull(), F.greatest(tr - va, F.lit(0.0))),
    }
    out = wide.withColumns(gaps)
    penalty = sum(
        (F.coalesce(F.col(g), F.lit(0.0)) * float(w) for g, w in zip(gaps, weights)), F.lit(0.0)
    )
    return out.withColumn("objective", F.col(split) - penalty)


def leaderboard(objectives) -> DataFrame:
    w = Window.orderBy(F.col("objective").desc_nulls_last(), "trial")
    return objectives.withColumn("place", F.row_number().over(w))


def importance_table(raw, method="method", group_of=None) -> DataFrame:
    """Importances with positive and absolute shares and ranks, per method."""
    from cindergrid.functions.names import model_group

    v = F.col("importance")
    out = raw.withColumns(
        {
            "group": group_of if group_of is not None else model_group("feature"),
            "importance_abs": F.abs(v),
            "importance_positive": clip(v, 0.0),
        }
    )
    w = Window.partitionBy(method)
    share = lambda c: F.coalesce(
        ratio(F.col(c), F.sum(c).over(w)), F.lit(0.0)
    )
    return out.withColumns(
        {
            "normalized_importance": share("importance_positive"),
            "normalized_abs_importance": share("importance_abs"),
            "rank": F.row_number().over(w.orderBy(v.desc_nulls_last(), "feature")),
        }
    )


def group_importance(table, method="method") -> DataFrame:
    g = table.groupBy(method, "group").agg(
        F.count("feature").alias("feature_count"),
        F.sum("importance").alias("importance"),
        F.sum("importance_positive").alias("importance_positive"),
        F.sum("importance_abs").alias("importance_abs"),
        F.max("importance").alias("max_feature_importance"),
    )
    w = Window.partitionBy(method)
    pos = F.sum("importance_positive").over(w)
    norm = F.coalesce(ratio(F.col("importance_positive"), pos), F.lit(0.0))
    norm_abs = F.coalesce(ratio("importance_abs", F.sum("importance_abs").over(w)), F.lit(0.0))
    g = g.withColumns({"normalized_importance": norm, "normalized_abs_importance": norm_abs,
                       "_by": F.when(pos > 0, norm).otherwise(norm_abs)})
    return g.withColumn(
        "rank", F.row_number().over(w.orderBy(F.col("_by").desc(), "group"))
    ).drop("_by")


def combine_importances(table, method="method") -> DataFrame:
    """Mean rank and share over methods and the consensus rank of each feature."""
    c = table.groupBy("feature", "group").agg(
        F.count("rank").alias("methods_present"),
        F.avg("rank").alias("mean_rank"),
        F.avg("normalized_importance").alias("mean_normalized_importance"),
    )
    w = Window.orderBy("mean_rank", F.col("mean_normalized_importance").desc(), "feature")
    return c.withColumn("consensus_rank", F.row_number().over(w))


def consensus_groups(consensus) -> DataFrame:
    g = consensus.groupBy("group").agg(
        F.count("feature").alias("feature_count"),
        F.sum("mean_normalized_importance").alias("group_score"),
        F.min("consensus_rank").alias("best_consensus_rank"),
        F.avg("consensus_rank").alias("mean_consensus_rank"),
    )
    total = F.sum("group_score").over(Window.partitionBy())
    w = Window.orderBy(F.col("group_score").desc(), "best_consensus_rank")
    return g.withColumns(
        {
            "normalized_group_score": F.coalesce(ratio("group_score", total), F.lit(0.0)),
            "rank": F.row_number().over(w),
        }
    )


def split_summary(df, split="split", label="is_fire", date="date") -> DataFrame:
    """Rows, class counts and date range of each split."""
    return df.groupBy(split).agg(
        F.count(F.lit(1)).alias("rows"),
        F.sum(label).alias("positives"),
        (F.count(F.lit(1)) - F.sum(label)).alias("negatives"),
        F.avg(label).alias("positive_rate"),
        F.min(date).alias("first_date"),
        F.max(date).alias("last_date"),
    )


def overall_and_yearly(metrics, split="split", base="test") -> DataFrame:
    """Rows of a split and of its yearly parts (`test_2021`), with the year taken out."""
    year = F.regexp_extract(split, rf"^{base}_(\d{{4}})$", 1)
    kept = metrics.filter((F.col(split) == base) | F.col(split).rlike(rf"^{base}_\d{{4}}$"))
    return kept.withColumns(
        {
            "scope": F.when(F.col(split) == base, "overall").otherwise("yearly"),
            "year": F.when(year != "", year.cast("int")),
        }
    )


def combined_table(tables, regions, columns, order) -> DataFrame:
    """Metric tables of several models: fixed columns, region bounds, stable order."""
    from functools import reduce

    both = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), tables)
    boxes = regions.select(
        F.col("r_name").alias("region"), "lat_min", "lat_max", "lon_min", "lon_max"
    )
    for c in columns:
        if c not in both.columns:
            both = both.withColumn(c, F.lit(None).cast("double"))
    joined = both.select(*columns).join(boxes, "region", "left")
    label = F.when(
        F.col("lat_min").isNotNull(),
        F.format_string("%s [%d..%d, %d..%d]", "region", "lat_min", "lat_max", "lon_min",
                        "lon_max"),
    ).otherwise(F.col("region"))
    return joined.withColumn("region_label", label).orderBy(*order)
