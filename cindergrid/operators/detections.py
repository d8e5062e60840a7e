"""From detections to event cell-days, labels and persistent hot-spot catalogues."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cindergrid.functions.cells import with_cell_keys
from cindergrid.functions.labels import boost_weight

KEY = ("lat_key", "lon_key", "acq_date")


def stationary_catalogue(df, min_months: int = 3) -> DataFrame:
    """Exact positions seen in at least `min_months` distinct calendar months."""
    months = F.array_sort(F.collect_set(F.date_format("acq_date", "yyyy-MM")))
    return (
        df.groupBy("country", "latitude", "longitude")
        .agg(months.alias("_m"))
        .filter(F.size("_m") >= min_months)
        .select(
            "country",
            "latitude",
            "longitude",
            F.size("_m").alias("unique_months"),
            F.element_at("_m", 1).alias("first_month"),
            F.element_at("_m", -1).alias("last_month"),
            F.array_join("_m", ";").alias("months"),
        )
    )


def drop_stationary(df, catalogue) -> DataFrame:
    at = ["country", "latitude", "longitude"]
    return df.join(catalogue.select(*at).distinct(), at, "left_anti")


def stationary_removals(df, catalogue) -> DataFrame:
    """Rows before, removed and kept, per country, without joining rows twice."""
    at = ["country", "latitude", "longitude"]
    per_point = df.groupBy(*at).agg(F.count(F.lit(1)).alias("n"))
    flagged = per_point.join(
        catalogue.select(*at, F.lit(True).alias("_hit")).distinct(), at, "left"
    )
    n, hit = F.col("n"), F.coalesce(F.col("_hit"), F.lit(False))
    return flagged.groupBy("country").agg(
        F.sum("n").alias("input_rows"),
        F.sum(F.when(hit, n).otherwise(0)).alias("removed_rows"),
        F.sum(F.when(hit, 0).otherwise(n)).alias("output_rows"),
    )


def cell_days(df, resolution=0.1, boxes=(), order="detection_id") -> DataFrame:
    """One row per (cell, day): mean brightness and confidence, summed weight.

    Country is the one of the first detection by id.
    """
    weighted = with_cell_keys(df, resolution=resolution).withColumn(
        "count", boost_weight("latitude", "longitude", boxes)
    )
    return weighted.groupBy(*KEY).agg(
        F.min_by("country", order).alias("country"),
        F.avg("brightness").alias("brightness"),
        F.avg("confidence").alias("confidence"),
        F.sum("count").alias("count"),
    )


# Neighbour order north, south, east, west as (dlat, dlon).
NEIGHBOURS = [(1, 0), (-1, 0), (0, 1), (0, -1)]


def expand_positives(cells) -> DataFrame:
    """A cell-day of weight c becomes itself and min(c-1, 4) neighbours, all weight 1."""
    places = F.array(
        *[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in [(0, 0), *NEIGHBOURS]]
    )
    take = F.least(F.greatest(F.col("count"), F.lit(1)), F.lit(1 + len(NEIGHBOURS)))
    moved = cells.withColumn("_p", F.explode(F.slice(places, F.lit(1), take.cast("int"))))
    return moved.withColumns(
        {
            "lat_key": F.col("lat_key") + F.col("_p.a"),
            "lon_key": F.col("lon_key") + F.col("_p.b"),
            "count": F.lit(1),
        }
    ).drop("_p")


def positive_labels(df, resolution=0.1, boxes=(), expand=True) -> DataFrame:
    """Distinct event cell-days with is_fire = 1."""
    cells = cell_days(df, resolution, boxes)
    if expand:
        cells = expand_positives(cells)
    return cells.select("country", *KEY).distinct().withColumn("is_fire", F.lit(1))


def positive_key_counts(df, resolution=0.1) -> DataFrame:
    """Detections behind every event cell-day."""
    return with_cell_keys(df, resolution=resolution).groupBy("country", *KEY).agg(
        F.count(F.lit(1)).alias("detections")
    )


def label_flags(rows, key_sets, on=("country", "lat_key", "lon_key", "date")) -> DataFrame:
    """One 0/1 column per set of positive keys, all from one join. key_sets: column -> keys."""
    parts = [
        keys.select(*on, *[F.lit(int(c == name)).alias(c) for c in key_sets])
        for name, keys in key_sets.items()
    ]
    marked = reduce(lambda a, b: a.unionByName(b), parts).groupBy(*on).agg(
        *[F.max(c).alias(c) for c in key_sets]
    )
    return rows.join(marked, list(on), "left").withColumns(
        {c: F.coalesce(c, F.lit(0)) for c in key_sets}
    )


def relabel(rows, keys, on=("country", "lat_key", "lon_key", "date")) -> DataFrame:
    """is_fire = 1 where the row's key is in the positive key set."""
    marked = keys.select(*on).distinct().withColumn("_hit", F.lit(1))
    return rows.join(marked, list(on), "left").withColumn(
        "is_fire", F.coalesce("_hit", F.lit(0))
    ).drop("_hit")
