"""Sliding periods per region: metrics, selection, activity shape and daily series."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cindergrid.functions.cells import cell_area_kha, cell_coord
from cindergrid.functions.probability import ratio
from cindergrid.operators import ranking, spatial
from cindergrid.operators.columns import lead_days
from cindergrid.operators.regions import region_rows
from cindergrid.session import cut


BLOCKS_OF = 4  # windows: a block of starts, with the days that its windows reach into, is at most 5/4 of its own days
TASKS = 96


def _starts(date, span, window_days) -> Column:
    """The window starts that cover a date; `span` holds the region's first and last start."""
    first = F.greatest(F.date_sub(date, window_days - 1), span["_first"])
    last = F.least(date, span["_last"])
    # an empty span would count backwards
    return F.when(first <= last, F.sequence(first, last))


def _window_starts(rows, spans, window_days) -> DataFrame:
    """Each dated row once per window start that covers it.

    `spans` maps regions to their first and last start: a join on the region would put
    a third of all rows behind one key.
    """
    at = rows.withColumn("_m", spans).withColumn("_s", F.element_at("_m", F.col("region"))).drop("_m")
    return at.withColumn("period_start", F.explode(_starts(F.col("date"), F.col("_s"), window_days))).drop("_s")


def _window_ranking(rows, regions, spans, window_days, label) -> DataFrame:
    """Average precision and ROC-AUC of every window, from rows with _p, _w and a label.

    Rows go once to each block of window starts that can see them; copies per region and
    window are made, merged by score and ranked inside the block's task, so only the rows
    themselves are exchanged and nothing but one window's scores is in order at once.
    `label` is a column that may look at `period_start`. Rows may carry their region.
    """
    size = BLOCKS_OF * window_days
    day = F.unix_date("date")
    blocks = F.sequence(F.floor((day - (window_days - 1)) / size), F.floor(day / size))
    dealt = rows.withColumn("_block", F.explode(blocks)).repartition(TASKS, "_block")
    held = dealt if "region" in rows.columns else region_rows(dealt, regions, include_global=True)
    win = _window_starts(held, spans, window_days).filter(F.floor(F.unix_date("period_start") / size) == F.col("_block"))
    g = ["_block", "region", "period_start"]
    scores = ranking.collapse(win.withColumn("_l", label), "_l", "_p", "_w", g)
    above = Window.partitionBy(*g).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    ranked = scores.withColumns({f"cum_{m}": F.sum(m).over(above) for m in ("pos", "neg")})
    totals = ranked.withColumns({"tot_pos": F.col("cum_pos"), "tot_neg": F.col("cum_neg")})
    return ranking.ranking_from_prefix(totals, g).drop("_block")


def period_metrics(
    df, regions, window_days, radius_deg=0.0, full_periods=True, p="prob", y="is_fire",
    w="eval_weight", resolution=0.1, rankings=("exact", "tolerant"),
) -> DataFrame:
    """Every window of `window_days` starting on every day, per region; the result is written.

    Sums of a window are sums of its days; labels are tolerant by cell and window, so
    tolerant sums come from cell-days. Only scores are ranked window by window.
    `rankings` names the labels whose average precision and ROC-AUC are wanted.
    """
    base = df.select("date", "lat_key", "lon_key", F.col(y).alias("_y"), F.col(p).alias("_p"), F.col(w).alias("_w"))
    last_day = df.agg(F.max("date")).scalar()
    pp, ww, yy = F.col("_p"), F.col("_w"), F.col("_y")
    known = base.filter(F.col("lat_key").isNotNull() & F.col("lon_key").isNotNull())
    seen = region_rows(base.select("date", "lat_key", "lon_key"), regions, include_global=True)
    days = seen.groupBy("region").agg(F.min("date").alias("_first"), F.max("date").alias("_last"))
    if full_periods:
        days = days.withColumn("_max", last_day).withColumn(
            "_last", F.least("_last", F.date_sub("_max", window_days - 1))
        ).drop("_max")
    # one row per region; read back, so that every use of it costs nothing
    spans = cut(days).agg(F.map_from_entries(F.collect_list(F.struct("region", F.struct("_first", "_last"))))).scalar()
    g = ["region", "period_start"]

    daily = region_rows(known, regions, include_global=True).groupBy("region", "date").agg(
        F.count(F.lit(1)).alias("support"), F.sum(ww).alias("weighted_support"), F.sum(yy).alias("positive_rows"),
        F.sum(pp * ww).alias("expected"), F.sum(yy * ww).alias("observed"), F.max("_p").alias("max_probability"),
        F.sum(ww * (pp - yy) * (pp - yy)).alias("_b"),
    )
    sums = _window_starts(daily, spans, window_days).groupBy(*g).agg(
        *[F.sum(c).alias(c) for c in ("support", "weighted_support", "positive_rows", "expected", "observed", "_b")],
        F.max("max_probability").alias("max_probability"),
    )

    scored = F.when(pp.isNotNull(), ww)
    cells = known.groupBy("date", "lat_key", "lon_key").agg(
        F.max("_y").alias("_y"), F.count(F.lit(1)).alias("_n"), F.sum(scored).alias("_w"),
        F.sum(pp * ww).alias("_wp"), F.sum(pp * pp * ww).alias("_wpp"),
    )
    in_region = region_rows(cells, regions, include_global=True)
    measures = ("_n", "_w", "_wp", "_wpp")
    spots = _window_starts(in_region, spans, window_days).groupBy(*g, "lat_key", "lon_key").agg(
        F.max("_y").alias("is_fire"), *[F.sum(c).alias(c) for c in measures]
    ).withColumns({"lat": cell_coord("lat_key", resolution), "lon": cell_coord("lon_key", resolution)})
    if radius_deg > 0:
        spots = spatial.tolerant_labels(cut(spots), radius_deg, g)
    else:
        spots = spots.withColumn("tolerant", F.col("is_fire"))
    t = F.col("tolerant")
    places = spots.groupBy(*g).agg(
        F.count_if(F.col("is_fire") > 0).alias("observed_positive_locations"),
        F.count_if(t > 0).alias("tolerant_positive_locations"),
        F.sum(F.col("_n") * t).alias("tolerant_positive_rows"),
        F.sum(F.col("_wpp") - 2 * t * F.col("_wp") + t * t * F.col("_w")).alias("_bt"),
    )
    out = sums.join(places, g)
    if "exact" in rankings:
        exact = _window_ranking(known, regions, spans, window_days, F.col("_y"))
        out = out.join(exact, g)
    if "tolerant" in rankings:
        # the starts whose windows make a cell-day's cell positive travel with its rows
        spread = F.explode(F.sequence(F.col("period_start"), F.date_add("period_start", window_days - 1)))
        marked = spots.filter(t > 0).select("region", "lat_key", "lon_key", "period_start", t.alias("t"), spread.alias("date"))
        on = ["region", "date", "lat_key", "lon_key"]
        marked = marked.groupBy(*on).agg(F.map_from_entries(F.collect_list(F.struct("period_start", "t"))).alias("_t"))
        merged = known.groupBy("date", "lat_key", "lon_key", "_y", "_p").agg(F.sum("_w").alias("_w"))
        rows = region_rows(merged, regions, include_global=True).join(marked, on, "left")
        label = F.coalesce(F.try_element_at("_t", F.col("period_start")), F.greatest("_y", F.lit(0)))
        tolerant = _window_ranking(rows, regions, spans, window_days, label)
        out = out.join(tolerant.withColumnsRenamed({c: f"tolerant_{c}" for c in ("average_precision", "roc_auc")}), g)
    e, o = F.col("expected"), F.col("observed")
    some = (e > 0) & (o > 0)
    return cut(out.withColumns(
        {
            "period_end": F.date_add("period_start", window_days - 1),
            "window_days": F.lit(window_days),
            "count_ratio": F.when(some, e / o),
            "count_abs_error": F.abs(e - o),
            "count_abs_log_error": F.when(some, F.abs(F.log(e / o))),
            "mean_probability": ratio(e, "weighted_support"),
            "brier_score": ratio("_b", "weighted_support"),
            "tolerant_brier_score": ratio("_bt", "weighted_support"),
        }
    ).drop("_b", "_bt"))


def greedy_periods(candidates, order, top, extra=(), overlap=False) -> DataFrame:
    """Best non-overlapping periods per region, in the given sort order.

    order: columns, already signed so that smaller is better. A region has at
    most one candidate per day, so its ordered list is small.
    """
    keys = [F.coalesce(c, F.lit(float("inf"))).alias(f"k{i}") for i, c in enumerate(order)]
    item = F.struct(*keys, "period_start", "period_end", *extra)
    listed = candidates.groupBy("region").agg(F.array_sort(F.collect_list(item)).alias("_all"))
    kind = listed.schema["_all"].dataType
    empty = F.array().cast(kind)

    def add(acc, x):
        clash = F.exists(
            acc, lambda a: (x["period_start"] <= a["period_end"]) & (x["period_end"] >= a["period_start"])
        )
        free = F.lit(True) if overlap else ~clash
        return F.when((F.size(acc) < top) & free, F.concat(acc, F.array(x))).otherwise(acc)

    picked = listed.select("region", F.aggregate("_all", empty, add).alias("_p"))
    return picked.select("region", F.posexplode("_p").alias("_i", "_x")).select(
        "region", (F.col("_i") + 1).alias("period_rank"),
        *[F.col(f"_x.{c}").alias(c) for c in ("period_start", "period_end", *extra)],
    )


def select_best_periods(metrics, metric, minimise=False, min_positives=1, top=3, overlap=False):
    """Top periods per region by a metric, then count error, Brier score and start."""
    v = F.col(metric)
    ok = metrics.filter(
        (F.col("observed_positive_locations") >= min_positives) & v.isNotNull() & ~F.isnan(v)
    )
    # rounded, so that equal values tie whatever order they were summed in
    order = [
        F.round(v if minimise else -v, 9), F.round("count_abs_error", 9), F.round("brier_score", 9)
    ]
    return greedy_periods(ok, order, top, [metric], overlap)


def season_filter(metrics, excluded_months) -> DataFrame:
    """Periods with no day in an excluded month."""
    if not excluded_months:
        return metrics
    days = F.transform(F.sequence("period_start", "period_end"), lambda d: F.month(d))
    bad = F.array(*[F.lit(m) for m in excluded_months])
    return metrics.filter(
        (F.col("period_end") >= F.col("period_start")) & ~F.arrays_overlap(days, bad)
    )


def activity_shape(metrics, df, regions, y="is_fire", w="eval_weight") -> DataFrame:
    """Peak day, centre of mass and concentration of the observed counts of each period."""
    seen = df.select("date", "lat_key", "lon_key", (F.col(y) * F.col(w)).alias("_o"))
    daily = region_rows(seen, regions, include_global=True).groupBy("region", "date").agg(
        F.sum("_o").alias("_o")
    )
    spine = metrics.select("region", "period_start", "period_end").distinct().withColumn(
        "date", F.explode(F.sequence("period_start", "period_end"))
    )
    full = spine.join(daily, ["region", "date"], "left").withColumns(
        {
            "_o": F.coalesce("_o", F.lit(0.0)),
            "_i": F.datediff("date", "period_start"),
            "_n": F.datediff("period_end", "period_start") + 1,
        }
    )
    i, n, o = F.col("_i"), F.col("_n"), F.col("_o")
    shape = full.groupBy("region", "period_start", "period_end").agg(
        F.sum(o).alias("_t"), F.max(n).alias("_n"),
        F.max_by(i, F.struct(o, -i)).cast("double").alias("_peak"), F.sum(o * i).alias("_m"),
        F.sum(F.when(i < F.greatest(F.lit(1), F.ceil(n * 0.25)), o).otherwise(0.0)).alias("_q"),
        F.sum(
            F.when((i >= F.floor(n * 0.25)) & (i < F.least(n, F.ceil(n * 0.75))), o).otherwise(0.0)
        ).alias("_h"),
    )
    t = F.col("_t")
    centre = F.greatest((F.col("_n") - 1) / 2.0, F.lit(1.0))
    closeness = lambda c: F.greatest(F.lit(0.0), 1 - F.abs(c - centre) / centre)
    mass, first, middle = F.col("_m") / t, F.col("_q") / t, F.col("_h") / t
    score = (
        0.35 * closeness(F.col("_peak")) + 0.30 * closeness(mass) + 0.20 * middle
        + 0.15 * F.greatest(F.lit(0.0), 1 - first)
    )
    some = t > 0
    out = shape.select(
        "region", "period_start", "period_end",
        F.when(some, F.col("_peak")).alias("observed_peak_day"),
        F.when(some, mass).alias("observed_center_of_mass"),
        F.when(some, first).alias("first_quarter_fraction"),
        F.when(some, middle).alias("middle_half_fraction"),
        F.when(some, score).alias("centered_activity_score"),
    )
    return metrics.join(out, ["region", "period_start", "period_end"], "left")


def select_centered_periods(
    shaped, metric, minimise=False, min_positives=1, top=3, overlap=False, peak=(0.25, 0.75),
    max_first=0.45, min_middle=0.35,
) -> DataFrame:
    """Periods with their activity in the middle; regions without any fall back to the score."""
    v = F.col(metric)
    ok = shaped.filter(
        (F.col("observed_positive_locations") >= min_positives) & v.isNotNull() & ~F.isnan(v)
    )
    last = F.greatest(F.col("window_days") - 1, F.lit(1))
    fits = (
        F.col("observed_peak_day").between(F.floor(last * peak[0]), F.ceil(last * peak[1]))
        & (F.col("first_quarter_fraction") <= max_first)
        & (F.col("middle_half_fraction") >= min_middle)
    )
    flagged = ok.withColumn("_fit", F.coalesce(fits, F.lit(False)))
    by = Window.partitionBy("region")
    flagged = flagged.withColumns(
        {
            "_any": F.max("_fit").over(by),
            "_scored": F.max(F.col("centered_activity_score").isNotNull()).over(by),
        }
    )
    kept = flagged.filter(
        F.when(F.col("_any"), F.col("_fit"))
        .when(F.col("_scored"), F.col("centered_activity_score").isNotNull()).otherwise(True)
    )
    # rounded, so that equal values tie whatever order they were summed in
    signed = F.round(v if minimise else -v, 9)
    own = -F.round(F.coalesce(F.col("centered_activity_score"), F.lit(0.0)), 9)
    order = [
        F.when(F.col("_any") | ~F.col("_scored"), signed).otherwise(own),
        F.when(F.col("_any"), own).when(F.col("_scored"), signed).otherwise(F.lit(0.0)),
        F.round("count_abs_error", 9), F.round("brier_score", 9),
    ]
    picked = greedy_periods(kept, order, top, [metric, "centered_activity_score", "_any", "_scored"], overlap)
    reason = (
        F.when(F.col("_any"), "").when(F.col("_scored"), "ranked_by_centered_score")
        .otherwise("ranked_by_metric")
    )
    return picked.withColumn("fallback", reason).drop("_any", "_scored")


def period_daily_series(
    df, selections, regions, lead=None, max_lead=10, p="prob", y="is_fire", w="eval_weight",
    resolution=0.1,
) -> DataFrame:
    """Zero-filled daily expected (per lead day), observed counts and burned-cell area."""
    keyed = df.withColumn("lead_day", F.lit(0).cast("long")) if lead is None else lead_days(
        df, lead, "lead_day"
    ).filter(F.col("lead_day").between(1, max_lead))
    spans = selections.select("region", "period_start", "period_end").distinct()
    spine = spans.withColumn("date", F.explode(F.sequence("period_start", "period_end")))

    lean = keyed.groupBy("date", "lat_key", "lon_key", "lead_day").agg(
        F.sum(F.col(p) * F.col(w)).alias("_e"), F.sum(F.col(y) * F.col(w)).alias("_o"),
        F.max(y).alias("_y"),
    )
    rows = region_rows(lean, regions, include_global=True)
    expected = rows.groupBy("region", "date", "lead_day").agg(F.sum("_e").alias("expected"))
    cell = rows.groupBy("region", "date", "lat_key", "lon_key").agg(
        F.sum("_o").alias("_o"), F.max("_y").alias("_y")
    )
    area = cell_area_kha(cell_coord("lat_key", resolution), resolution)
    counts = cell.groupBy("region", "date").agg(
        F.sum("_o").alias("observed"),
        F.sum(F.when(F.col("_y") > 0, area).otherwise(0.0)).alias("area_kha"),
    )
    leads = spine.join(expected, ["region", "date"]).select(
        "region", "period_start", "lead_day"
    ).distinct()
    grid = spine.join(leads, ["region", "period_start"])
    out = grid.join(expected, ["region", "date", "lead_day"], "left").join(
        counts, ["region", "date"], "left"
    )
    return out.na.fill(0.0, ["expected", "observed", "area_kha"])


def align_to_reference(metrics, reference, order) -> DataFrame:
    """For every reference window the best metric row with the same region and dates."""
    on = ["region", "period_start", "period_end"]
    w = Window.partitionBy(*on, "reference_rank").orderBy(*order)
    ref = reference.select(*on, F.col("period_rank").alias("reference_rank"))
    return metrics.join(ref, on).withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


