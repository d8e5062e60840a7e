"""End-to-end jobs from raw detections to targets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.calendar import period_end, period_start
from cindergrid.functions.labels import DetectionThresholds, detection_filter
from cindergrid.operators import detections as det
from cindergrid.operators.regions import region_rows
from cindergrid.session import cut


def region_month_counts(
    raw, regions, thresholds=DetectionThresholds(brightness=380, confidence=85), min_months=6
) -> DataFrame:
    """Event-positive cell-days and detections per region and month.

    Thresholds, stationary-source removal, cell-day grouping and neighbour
    expansion; the implicit region `global` holds everything.
    """
    steady = det.stationary_catalogue(raw, min_months)
    kept = det.drop_stationary(raw.filter(detection_filter(thresholds)), steady)
    cells = det.cell_days(kept).withColumn("_n", F.col("count"))
    moved = det.expand_positives(cells.withColumns({"_la": F.col("lat_key"), "_lo": F.col("lon_key")}))
    own = (F.col("_la") == F.col("lat_key")) & (F.col("_lo") == F.col("lon_key"))
    per_cell_day = moved.groupBy("lat_key", "lon_key", "acq_date").agg(
        F.sum(F.when(own, F.col("_n")).otherwise(0)).alias("_n")
    )
    return region_rows(per_cell_day, regions, include_global=True).groupBy(
        "region",
        period_start("acq_date", "month").alias("month_start"),
        period_end("acq_date", "month").alias("month_end"),
    ).agg(F.count(F.lit(1)).alias("cell_days"), F.sum("_n").alias("detections"))


def scoring_history(
    rows, raw, start, end, lookback_days, radii, windows, days_since_radii=(), min_lag=30, cap=365
) -> DataFrame:
    """Event history for rows to be scored; only detections of the lookback are read.

    Scoring rows may not know their country, so history is by cell alone.
    """
    from datetime import timedelta

    from cindergrid.operators.series import event_history
    from cindergrid.sources.detections import select_detections

    seen = select_detections(raw, None, start - timedelta(days=lookback_days), end)
    events = det.expand_positives(det.cell_days(seen)).withColumnRenamed("acq_date", "date")
    return event_history(
        rows, events, radii, windows, days_since_radii, min_lag, cap, key=("lat_key", "lon_key")
    )


def cell_strata(cells, ecoregions, layer, settings, landcover, attr="name", resolution=0.1,
                cell=("lat_key", "lon_key")) -> DataFrame:
    """Static strata of candidate cells: ecoregion, burnable, large city, land-cover key."""
    from cindergrid.functions.cells import cell_coord
    from cindergrid.functions.labels import burnable_mask, large_city_mask
    from cindergrid.operators.spatial import tag_points

    spots = cells.withColumns(
        {
            "latitude": cell_coord("lat_key", resolution),
            "longitude": cell_coord("lon_key", resolution),
        }
    )
    named = tag_points(spots, ecoregions, "country", [attr]).drop("latitude", "longitude")
    joined = named.join(layer, list(cell), "left")
    key = F.concat_ws(
        "|", *[F.coalesce(F.col(c).cast("string"), F.lit("missing")) for c in landcover]
    )
    cols = joined.columns
    return joined.select(
        *cells.columns, F.col(attr).alias("ecoregion_name"),
        burnable_mask(cols, settings).alias("burnable"),
        large_city_mask(cols, settings).alias("large_city_hard"), key.alias("landcover_key"),
    )


def deployment_grid(
    polygons, raw, start, end, bounds=None, fraction=None, expand=True, resolution=0.1, seed=42
) -> DataFrame:
    """Labelled cell-days of all countries over a period, whole or as a weighted sample.

    Labels are by cell and day; a cell belongs to one country.
    """
    from cindergrid.operators import grids, sampling

    cells = grids.candidate_cells(polygons, bounds, resolution)
    found = det.positive_labels(raw, resolution, expand=expand).select(
        "lat_key", "lon_key", F.col("acq_date").alias("date")
    ).distinct()
    if fraction is None:
        return grids.label_grid(
            grids.cell_dates(cells, start, end), found, on=("lat_key", "lon_key", "date")
        )
    labels = found.join(cells, ["lat_key", "lon_key"])
    return sampling.lazy_sample(cells, labels, start, end, fraction, seed)


def build_target(
    raw, cells, start, end, thresholds=DetectionThresholds(brightness=420, confidence=85),
    boxes=(), positive_fraction=0.2, radii=(0, 1), windows=None, seed=42,
) -> DataFrame:
    """The full target job: positives, matched negatives, soft labels and history.

    The cells, the positives and the labelled rows are each read several times further
    on, so they are written once to the checkpoint folder.
    """
    from cindergrid.functions.labels import soft_label
    from cindergrid.operators.sampling import stratified_negatives
    from cindergrid.operators.series import event_history

    cells = cut(cells)
    kept = raw.filter(detection_filter(thresholds)).filter(
        F.col("acq_date").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    )
    found = det.expand_positives(det.cell_days(kept, boxes=boxes)).withColumnRenamed(
        "acq_date", "date"
    )
    inside = cut(
        found.join(
            cells.select("country", "lat_key", "lon_key"), ["country", "lat_key", "lon_key"],
            "left_semi",
        )
    )
    static = cells.select(
        "country", "lat_key", "lon_key", "ecoregion_name", "burnable", "landcover_key"
    )
    positives = inside.select("country", "lat_key", "lon_key", "date").distinct().join(
        static, ["country", "lat_key", "lon_key"], "left"
    )
    negatives = stratified_negatives(positives, cells, start, end, positive_fraction, seed=seed)
    none = F.lit(None).cast("double")
    rows = inside.select(
        "country", "lat_key", "lon_key", "date", F.col("count").cast("int").alias("count"),
        F.lit("positive").alias("negative_stratum"), none.alias("nearest_positive_distance_cells"),
        none.alias("nearest_positive_delta_days"), F.lit(1.0).alias("sample_weight"),
    ).unionByName(
        negatives.withColumnRenamed("stratum", "negative_stratum").drop("sampling_probability")
    )
    labelled = cut(rows.withColumn("soft_label", soft_label()))
    spans = windows or {"30_365d": (30, 365)}
    return event_history(labelled, inside, list(radii), spans, list(radii), 30, 365)
