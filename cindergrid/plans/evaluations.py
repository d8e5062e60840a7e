"""Composed evaluation, diagnostics, forecast and comparison jobs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.probability import prior_shift
from cindergrid.operators import (
    calibrate, columns, evaluation, grids, models, periods, ranking, sampling, series, spatial,
    summaries,
)
from cindergrid.session import cut
from cindergrid.sources import cubes


def calibrated_evaluation(
    model, calibration, test, regions, group=("month",), method="offset", trials=0
) -> dict[str, DataFrame]:
    """Score the calibration grid, fit the calibrator, score the test grid, report.

    The scored test grid feeds every table, so it is written once to the
    checkpoint folder.
    """
    scored_cal = model.score(calibration)
    scored = cut(model.score(test))
    if method == "platt":
        calibrated = calibrate.PlattCalibrator(group).fit(scored_cal).apply(scored)
    else:
        offsets = calibrate.fit_offsets(scored_cal, group)
        calibrated = calibrate.apply_offsets(scored, offsets, group)
    p = "prob_calibrated"
    tables = {
        "predictions": calibrated,
        "metrics": evaluation.metric_table(calibrated, regions, p=p, key="row_id", trials=trials),
        "risk": ranking.risk_concentration(calibrated, "row_id", p=p, group=["model_name"]),
        "scales": evaluation.spatial_scale_table(calibrated, p=p),
        "prevalence": summaries.prevalence_audit(calibrated, group=["model_name"]),
        "correction": summaries.count_correction(calibrated, group=["model_name"]),
        "by_month": summaries.count_calibration(calibrated, ["month"], p=p),
        "metadata": calibrate.calibration_metadata(calibrated, method),
    }
    return tables


def forecast(
    model, cells, cube, layers_by_cell, on_date, days, n_days, features, numeric,
    train_prior=0.15, deploy_prior=0.001,
) -> DataFrame:
    """Scores of every cell for each of the next days, corrected to the deployment prior.

    Series features are taken once per cell, from the last observed day.
    """
    first = F.date_add(F.lit(on_date).cast("date"), 1)
    plan = cells.withColumn(
        "date", F.explode(F.sequence(first, F.date_add(F.lit(on_date).cast("date"), days)))
    )
    weather = series.grid_features(cube, on_date, n_days, features, "v").drop("date")
    wide = grids.assemble(plan, [weather, layers_by_cell], ["lat_key", "lon_key"])
    wide = wide.withColumn("month", F.month("date").cast("double"))
    filled = columns.fill_model_inputs(wide, numeric)
    scored = model.score(filled)
    return scored.withColumn("score", prior_shift("prob_raw", train_prior, deploy_prior))


def forecast_grid(scores, grid, step=0.1) -> DataFrame:
    """One day's forecast on its full grid."""
    at = scores.select(
        (F.col("lat_key") * F.lit(step)).alias("latitude"),
        (F.col("lon_key") * F.lit(step)).alias("longitude"), "score",
    )
    return cubes.to_grid(at, grid, 0.0, 0.0, step)


def diagnostics(df, regions, days_per_month=None, frequency="month", p="prob_raw") -> dict:
    """Partials, observed/expected merge, monthly scales, series and error maps.

    Expected counts may come from sampled days; observed counts use every row.
    """
    sampled = sampling.sample_days(df, days_per_month) if days_per_month else df
    scales = summaries.monthly_scales(
        summaries.merge_expected(
            summaries.month_partials(df, p=p), summaries.month_partials(sampled, p=p), ["month"]
        )
    )
    keys = ["model_name", "region", "period_start", "period_end", "month"]
    series_table = summaries.apply_scales(
        summaries.merge_expected(
            summaries.period_partials(df, regions, frequency, p=p),
            summaries.period_partials(sampled, regions, frequency, p=p), keys,
        ),
        scales,
    )
    cell_keys = ["model_name", "region", "year", "month", "lat_key", "lon_key"]
    cells = summaries.apply_scales(
        summaries.merge_expected(
            summaries.cell_partials(df, regions, p=p),
            summaries.cell_partials(sampled, regions, p=p), cell_keys,
        ),
        scales,
    )
    per_year = cells.groupBy("model_name", "region", "year", "lat_key", "lon_key").agg(
        *[F.sum(c).alias(c) for c in ("weighted_support", "expected", "observed")]
    )
    maps = summaries._risk_columns(
        per_year.withColumn("map", F.concat_ws(":", "region", F.col("year").cast("string")))
    )
    by_period = series_table.groupBy("model_name", "region", "period_start", "period_end").agg(
        *[F.sum(c).alias(c) for c in ("weighted_support", "expected", "observed")]
    ).withColumn("error", F.col("expected") - F.col("observed"))
    return {
        "scales": scales, "series": by_period, "maps": maps,
        "summary": summaries.map_summary(maps),
    }


def label_sensitivity(features, label_sets, numeric, train, test, key="row_id", ratios=(None,),
                      on=("country", "lat_key", "lon_key", "date")) -> DataFrame:
    """One logistic run per label definition and negative ratio, same features.

    label_sets: name -> table of positive keys. train / test: filter expressions.
    The rows are labelled by all sets in one join and written once, with what the runs need.
    """
    from cindergrid.operators.detections import label_flags

    flags = {name: f"_hit_{i}" for i, name in enumerate(label_sets)}
    rows = label_flags(features, {flags[n]: keys for n, keys in label_sets.items()}, on)
    rows = cut(
        rows.withColumns({"_train": F.expr(train), "_test": F.expr(test)}).filter("_train or _test"),
        *dict.fromkeys([*numeric, key, "eval_weight", "_train", "_test", *flags.values()]),
    )
    tables = []
    for name, flag in flags.items():
        for ratio in ratios:
            named = rows.withColumn("is_fire", F.col(flag))
            fit_rows = named.filter("_train").select(*dict.fromkeys([*numeric, key, "is_fire"]))
            if ratio is not None:
                # a fit reads its rows several times
                fit_rows = cut(sampling.negative_ratio_rows(fit_rows, ratio, key), *numeric, "is_fire")
            model = models.fit_logistic(fit_rows, numeric)
            scored = model.score(named.filter("_test")).withColumn(
                "variant", F.lit(f"{name}:{'all' if ratio is None else ratio}")
            )
            tables.append(scored.select("variant", "is_fire", "prob_raw", "eval_weight"))
    both = reduce(lambda a, b: a.unionByName(b), tables)
    return ranking.score_table(both, p="prob_raw", group=["variant"])


def lead_sensitivity(features, by_lead, train, test) -> DataFrame:
    """One logistic run per lead time, each with the columns that lead time can see."""
    tables = []
    for lead, numeric in by_lead.items():
        model = models.fit_logistic(features.filter(train), numeric)
        tables.append(
            model.score(features.filter(test)).select(
                F.lit(int(lead)).alias("lead_days"), "is_fire", "prob_raw", "eval_weight"
            )
        )
    both = reduce(lambda a, b: a.unionByName(b), tables)
    return ranking.score_table(both, p="prob_raw", group=["lead_days"])


def source_comparison(rows, cube_a, cube_b, n_days, features, numeric, train, test) -> DataFrame:
    """Same rows, weather from source A or B: trained and tested across sources.

    Only rows inside the common footprint with a full lookback in both sources
    take part.
    """
    extent = lambda c: c.agg(
        F.min("lat_key").alias("lat_min"), F.max("lat_key").alias("lat_max"),
        F.min("lon_key").alias("lon_min"), F.max("lon_key").alias("lon_max"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"),
    )
    box = spatial.common_footprint(extent(cube_a).unionByName(extent(cube_b))).drop("overlaps")
    inside = spatial.inside_footprint(rows, box)

    def with_source(cube):
        back = series.lookback(inside, cube, n_days)
        return series.add_features(back, features, {"v": "series"})

    a, b = with_source(cube_a), with_source(cube_b)
    both = b.filter(F.col("series").isNotNull()).select("row_id")
    a = a.filter(F.col("series").isNotNull()).join(both, "row_id", "left_semi").drop("series")
    b = grids.replace_block(a, b.select("row_id", *features), features, ["row_id"])
    a, b = cut(a), cut(b)
    tables = []
    for fit_name, fit_rows in (("a", a), ("b", b)):
        model = models.fit_logistic(fit_rows.filter(train), [*numeric, *features])
        for test_name, test_rows in (("a", a), ("b", b)):
            tables.append(
                model.score(test_rows.filter(test)).select(
                    F.lit(fit_name).alias("trained_on"), F.lit(test_name).alias("tested_on"),
                    "is_fire", "prob_raw", "eval_weight",
                )
            )
    every = reduce(lambda x, y: x.unionByName(y), tables)
    return ranking.score_table(every, p="prob_raw", group=["trained_on", "tested_on"])


def timelines(df, regions, window_days=7, radius_deg=0.0, top=2, p="prob_raw") -> dict:
    """Period metrics, activity shape, centred selection and the daily series of the picks."""
    metrics = periods.period_metrics(df, regions, window_days, radius_deg, p=p)
    shaped = periods.activity_shape(metrics, df, regions)
    picks = periods.select_centered_periods(shaped, "average_precision", top=top)
    return {
        "metrics": shaped, "selection": picks,
        "series": periods.period_daily_series(df, picks, regions, p=p),
    }
